"""Evidence and lineage graphs: bounded walks, closures, status and belief."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.text import content_id
from corpuslens.operators.lineage import cut, small
from corpuslens.operators.pathblocks import ends_of_two, whole_numbers


def hops(edges: DataFrame, roots: DataFrame, most: int, keep: Callable = cut, origins: bool = False, once: bool = False) -> DataFrame:
    """Breadth-first distances: ``root, node, depth`` up to ``most`` hops along ``edges(src, dst)``.

    With ``origins`` each root has its own walk; else roots start together and ``root`` is absent.  A round is one
    equi-join and one anti-join with what was seen; ``keep`` is applied each round to cut the lineage.

    With ``once`` the last round of walks over whole numbers is neither shuffled nor kept: its rows arise in blocks
    (``ends_of_two``) whenever the result is read, which pays where that is once.
    """
    key = ["root", "node"] if origins else ["node"]
    first = roots.select(F.col("node").alias("root"), "node") if origins else roots.select("node")
    seen = keep(first.distinct().withColumn("depth", F.lit(0)))
    front = seen
    once = once and origins and most > 1 and whole_numbers(edges, "src", "dst") and whole_numbers(roots, "node")
    e = edges.select("src", "dst") if once else edges.select("src", "dst").distinct()  # steps are made distinct anyhow
    for depth in range(1, most + 1):
        if once and depth == most:
            ends = ends_of_two(front.select(F.col("root").alias("src"), F.col("node").alias("mid")), e.select(F.col("src").alias("mid"), "dst"), seen=seen.select(F.col("root").alias("src"), F.col("node").alias("dst")))
            lost = e.where("dst is null").select("src").distinct()
            if not lost.isEmpty():  # a null end is a node without a name, which no walk has seen
                ends = ends.unionByName(front.join(small(lost), front.node == lost.src).select(F.col("root").alias("src"), F.lit(None).cast(e.schema["dst"].dataType).alias("dst")).distinct())
            return seen.unionByName(ends.select(F.col("src").alias("root"), F.col("dst").alias("node"), F.lit(depth).alias("depth")))
        step = front.join(e, front.node == e.src).select(*[c for c in key if c == "root"], F.col("dst").alias("node")).distinct()
        front = keep(step.join(seen, key, "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(front) if once else keep(seen.unionByName(front))
    return seen


def simple_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """Directed paths without repeats of up to ``most`` edges between sources and targets: ``path, length``."""
    e = edges.select("src", "dst").distinct()
    front = sources.select(F.array("node").alias("path"))
    found = None
    for n in range(1, most + 1):
        front = front.join(e, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        front = front.select(F.concat("path", F.array("dst")).alias("path"))
        hit = front.join(targets, F.element_at("path", -1) == targets.node, "left_semi").withColumn("length", F.lit(n))
        found = hit if found is None else found.unionByName(hit)
    return found


#: Most paths that a part of a source's paths is planned for, and most ends of a node that stay in one list.
PATHS, ENDS = 1 << 21, 1_024


def paths_of_two(first: DataFrame, last: DataFrame) -> DataFrame:
    """``src, dst, n_paths, first_path``: paths without repeats of an edge of ``first(src, dst)`` and one of ``last(src, dst)``, by their ends.

    The first path is the smallest as text.  Where nodes are whole numbers, blocks of sources meet blocks of ends
    (``ends_of_two``) and no path is shuffled.  Else the ends of a middle node are shuffled as a list to the source, so a
    path takes one value there, and paths are counted where they arise; a source with more than PATHS is dealt by its ends.
    """
    a = first.select("src", F.col("dst").alias("mid")).where("src <> mid")
    b = last.select(F.col("src").alias("mid"), "dst").where("mid <> dst")
    order, back = _text_order(a, "mid")
    text = lambda at: F.concat_ws(">", F.col("src").cast("string"), back(F.col(at)), F.col("dst").cast("string")).alias("first_path")
    if whole_numbers(a.withColumn("at", order), "src", "mid", "at") and whole_numbers(b, "mid", "dst"):
        found = ends_of_two(a.withColumn("v", order), b, "first")
        return found.select("src", "dst", F.col("n").alias("n_paths"), text("least"))
    a, b = cut(a.distinct()), cut(b.distinct())
    n = b.groupBy("mid").agg(F.count("*").alias("n"))
    parts = cut(a.join(n, "mid").groupBy("src").agg(F.sum("n").alias("paths")))
    total = parts.agg(F.sum("paths")).first()[0] or 0
    hashed = lambda x, m: F.pmod(F.xxhash64(x), m)
    lists = b.join(n, "mid").groupBy("mid", hashed(F.col("dst"), F.ceil(F.col("n") / ENDS))).agg(F.collect_list("dst").alias("ends"))
    rows = a.join(lists, "mid").join(small(parts.select("src", F.ceil(F.col("paths") / PATHS).alias("parts"))), "src")
    rows = rows.select("src", "mid", order.alias("at"), "ends", "parts", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    mine = F.when(F.col("parts") == 1, F.col("ends")).otherwise(F.filter("ends", lambda x: hashed(x, F.col("parts")) == F.col("part")))
    dealt = rows.select("src", "part", "at", mine.alias("ends")).repartition(max(1, -(-total // PATHS)), "src", "part")
    paths = dealt.select("src", "part", "at", F.explode("ends").alias("dst")).where("src <> dst")
    found = paths.groupBy("src", "part", "dst").agg(F.count("*").alias("n_paths"), F.min("at").alias("at"))
    return found.select("src", "dst", "n_paths", text("at"))


def _text_order(rows: DataFrame, node: str) -> tuple[Column, Callable]:
    """What sorts like the text of ``node`` and a ``>``, and that text from it: a number where nodes are whole numbers below 10^15.

    ``>`` sorts after digits, so a number is filled with nines; of equal ones the longer is first.
    """
    least, most = rows.agg(F.min(node), F.max(node)).first()
    if not isinstance(most, int) or least < 0 or most >= 10**15:
        return F.concat(F.col(node).cast("string"), F.lit(">")), lambda at: F.left(at, F.length(at) - 1)
    scale = lambda length: F.element_at(F.array(*[F.lit(10 ** (15 - i)).cast("long") for i in range(1, 16)]), length)
    x, length = F.col(node).cast("long"), F.length(F.col(node).cast("string"))
    left = lambda at: scale((31 - at.bitwiseAND(F.lit(31).cast("long"))).cast("int"))
    return ((x + 1) * scale(length) - 1) * 32 + 31 - length, lambda at: (((F.shiftright(at, 5) + 1) / left(at)).cast("long") - 1).cast("string")


def status_at(valid_from: Column, valid_to: Column, retracted_at: Column, as_of: Column) -> Column:
    return (
        F.when(retracted_at <= as_of, "retracted").when(valid_from > as_of, "future").when(valid_to <= as_of, "expired").otherwise("active")
    )


def beliefs(events: DataFrame, claim: str, source: str, strength: Column, supports: Column, margin: float = 0.15) -> DataFrame:
    """Noisy-or support and contradiction of each claim from the strongest event of each source, and a status."""
    best = events.groupBy(claim, source, supports.alias("_for")).agg(F.max(strength).alias("_s"))
    gather = lambda c: 1 - F.exp(F.sum(F.when(c, F.log1p(-F.least(F.col("_s"), F.lit(0.999999)))).otherwise(0.0)))
    g = best.groupBy(claim).agg(gather(F.col("_for")).alias("support"), gather(~F.col("_for")).alias("contradiction"))
    gap = F.col("support") - F.col("contradiction")
    return g.withColumn("status", F.when(F.abs(gap) < margin, "conflicted").when(gap > 0, "supported").otherwise("contradicted"))


def upstream(edges: DataFrame, roots: DataFrame, most: int, keep: Callable = cut) -> DataFrame:
    """``root, node, depth`` of the nodes from which each root is reached in up to ``most`` hops."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return hops(back, roots, most, keep, origins=True).where("depth > 0")


def weighted_paths(edges: DataFrame, sources: DataFrame, weight: str, most: int, by_ends: bool = False) -> DataFrame:
    """Directed paths without repeats from each source: ``src, dst, path, hops, length`` with the summed ``weight``.

    With ``by_ends`` paths are counted by their ends: ``src, dst, hops, n_paths, shortest, longest``.  Up to two edges over
    whole numbers are counted where they arise, in blocks (``ends_of_two``), and no path is shuffled.
    """
    if by_ends and most <= 2 and whole_numbers(edges, "src", "dst") and whole_numbers(sources, "node"):
        return _counted_paths(edges, sources, weight, most)
    e = edges.groupBy(F.col("src").alias("a"), F.col("dst").alias("b")).agg(F.min(weight).alias("w"))
    front = sources.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.array("node").alias("path"), F.lit(0).alias("hops"), F.lit(0.0).alias("length"))
    found = []
    for n in range(1, most + 1):
        step = front.join(e, front.dst == e.a).where(~F.array_contains("path", F.col("b")))
        front = step.select("src", F.col("b").alias("dst"), F.concat("path", F.array("b")).alias("path"), F.lit(n).alias("hops"), (F.col("length") + F.col("w")).alias("length"))
        found.append(front)
    found = reduce(DataFrame.unionByName, found)
    return _by_ends(found) if by_ends else found


def _by_ends(paths: DataFrame) -> DataFrame:
    return paths.groupBy("src", "dst", "hops").agg(F.count("*").alias("n_paths"), F.min("length").alias("shortest"), F.max("length").alias("longest"))


def _counted_paths(edges: DataFrame, sources: DataFrame, weight: str, most: int) -> DataFrame:
    e = cut(edges.select("src", "dst", F.col(weight).alias("w")).where("src <> dst"))
    times = sources.groupBy(F.col("node").alias("src")).agg(F.count("*").alias("times"))
    again = cut(times.where("times > 1"))
    first = e.join(small(times.select("src")), "src", "left_semi")
    one = first.groupBy("src", "dst").agg(F.min("w").alias("length"))
    found = _by_ends(one.withColumn("hops", F.lit(1)))
    if most == 2:
        two = ends_of_two(first.select("src", F.col("dst").alias("mid"), F.col("w").alias("v")), e.select(F.col("src").alias("mid"), "dst", F.col("w").alias("v")), "both")
        found = found.unionByName(two.select("src", "dst", F.lit(2).alias("hops"), F.col("n").alias("n_paths"), F.col("least").alias("shortest"), F.col("most").alias("longest")))
    if not again.isEmpty():  # a source given more than once has its paths as often
        found = found.join(small(again), "src", "left").withColumn("n_paths", F.col("n_paths") * F.coalesce("times", F.lit(1))).drop("times")
    return found


def scored_paths(edges: DataFrame, seeds: DataFrame, most: int, top: int) -> DataFrame:
    """The best ``top`` ends of undirected paths from each seed: ``seed, dst, score, position``.

    A path's score is the product of its edges' ``confidence`` over 1 + 0.15 times its length; an end has its best path's.
    """
    both = edges.select("src", "dst", "confidence").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "confidence"))
    both = both.groupBy(F.col("src").alias("a"), F.col("dst").alias("b")).agg(F.max("confidence").alias("c"))
    front = seeds.select(F.col("node").alias("seed"), F.col("node").alias("dst"), F.array("node").alias("path"), F.lit(1.0).alias("score"))
    found = []
    for n in range(1, most + 1):
        step = front.join(both, front.dst == both.a).where(~F.array_contains("path", F.col("b")))
        front = step.select("seed", F.col("b").alias("dst"), F.concat("path", F.array("b")).alias("path"), (F.col("score") * F.col("c")).alias("score"))
        found.append(front.select("seed", "dst", (F.col("score") / (1 + 0.15 * n)).alias("score")))
    best = reduce(DataFrame.unionByName, found).groupBy("seed", "dst").agg(F.max("score").alias("score"))
    order = Window.partitionBy("seed").orderBy(F.desc(F.round("score", 9)), "dst")
    return best.withColumn("position", F.row_number().over(order)).where(F.col("position") <= top)


def document_graph(docs: DataFrame, owner: str, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Typed nodes ``type, id, key`` of documents and of their lines with text, and the edges between them.

    Ids are derived from content (owner, key, type and line number), so reruns agree.
    """
    document = content_id(F.col(owner), F.col(key), F.lit("document"))
    lines = docs.select(owner, key, F.posexplode(F.split(text, "\n", -1)).alias("n", "line")).where(F.trim(F.col("line"), F.lit(" \t\r")) != "")
    section = content_id(F.col(owner), F.col(key), F.lit("section"), F.col("n"))
    nodes = docs.select(F.lit("document").alias("type"), document.alias("id"), F.col(key).alias("key")).unionByName(lines.select(F.lit("section").alias("type"), section.alias("id"), F.col(key).alias("key")))
    return nodes, lines.select(F.lit("contains").alias("type"), content_id(document, section).alias("id"), document.alias("src"), section.alias("dst"))


def nearest_origins(edges: DataFrame, roots: DataFrame, most: int) -> DataFrame:
    """``node, depth, origins``: the least number of hops from any root, and the roots at that distance."""
    h = hops(edges, roots, most, origins=True)
    least = h.groupBy("node").agg(F.min("depth").alias("depth"))
    return h.join(least, ["node", "depth"]).groupBy("node", "depth").agg(F.collect_set("root").alias("origins"))  # roots of one node


def topological_levels(edges: DataFrame, most: int = 64, keep: Callable = cut) -> DataFrame:
    """``node, level``: nodes without an open predecessor are peeled off, level by level; nodes on a cycle have none."""
    e = keep(edges.select("src", "dst").distinct())
    left = keep(e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct())
    done = None
    for level in range(most):
        free = keep(left.join(e.select(F.col("dst").alias("node")), "node", "left_anti"))
        if free.isEmpty():
            break
        found = free.withColumn("level", F.lit(level))
        done = found if done is None else done.unionByName(found)
        left = keep(left.join(free, "node", "left_anti"))
        e = keep(e.join(free.select(F.col("node").alias("src")), "src", "left_anti"))
    return done if done is not None else left.withColumn("level", F.lit(0))


def neighbours_across(edges: DataFrame, documents: DataFrame, kinds: tuple[str, ...] = ()) -> DataFrame:
    """Edges of ``edges(src, dst, kind)`` whose ends lie in different ``documents(node, doc)``, with both documents."""
    e = edges.where(F.col("kind").isin(*kinds)) if kinds else edges
    a = documents.select(F.col("node").alias("src"), F.col("doc").alias("src_doc"))
    b = documents.select(F.col("node").alias("dst"), F.col("doc").alias("dst_doc"))
    return e.join(a, "src").join(b, "dst").where("src_doc <> dst_doc").select("src", "dst", "kind", "src_doc", "dst_doc")


def hyperedges(members: DataFrame, edge: str, role: str, member: str) -> DataFrame:
    """``edge, role, members, role_id``: sorted distinct members of each role of a relation, and the digest of them."""
    g = members.groupBy(edge, role).agg(F.sort_array(F.collect_set(F.col(member).cast("string"))).alias("members"))
    return g.withColumn("role_id", F.sha2(F.concat_ws("|", F.col(edge).cast("string"), F.col(role), F.concat_ws(",", "members")), 256))


def annotated(nodes: DataFrame, statuses: DataFrame, key: str, at: str, status: str, usable: Column) -> DataFrame:
    """Nodes with their latest status and a flag; nodes without one are ``unknown`` and usable."""
    last = statuses.groupBy(key).agg(F.max_by(status, F.struct(at, status)).alias(status))
    return nodes.join(last, key, "left").withColumn("usable", F.coalesce(usable, F.lit(True))).withColumn(status, F.coalesce(status, F.lit("unknown")))


def invalidated(edges: DataFrame, events: DataFrame, most: int, recomputable: Column, most_impact: int, keep: Callable = cut) -> DataFrame:
    """Artefacts that each event makes stale: ``root, node, depth, recompute, over``.

    ``over`` marks events that reach more than ``most_impact`` artefacts: their rows stay, for a person to decide.
    """
    reached = hops(edges, events, most, keep, origins=True)
    size = reached.groupBy("root").agg(F.count("*").alias("_n"))
    return reached.join(size, "root").select("root", "node", "depth", recomputable.alias("recompute"), (F.col("_n") > most_impact).alias("over"))


def retention(artifacts: DataFrame, parents: DataFrame, roots: DataFrame, now: Column, keep_latest: int, young: int, most: int, keep: Callable = cut) -> DataFrame:
    """``id, reason`` of each artefact: protected, latest, young or deletable, the first that holds.

    ``artifacts(id, owner, kind, at)``; a protected root keeps its ancestors of up to ``most`` steps along
    ``parents(src, dst)`` from child to parent; ``at``, ``now`` and ``young`` are in seconds.
    """
    held = hops(parents, roots, most, keep).select(F.col("node").alias("id"), F.lit(True).alias("_held"))
    nth = F.row_number().over(Window.partitionBy("owner", "kind").orderBy(F.desc("at"), F.desc("id")))
    a = artifacts.withColumn("_nth", nth).join(held, "id", "left")
    age = now - F.col("at")
    reason = F.when(F.col("_held"), "protected").when(F.col("_nth") <= keep_latest, "latest").when(age < young, "young").otherwise("deletable")
    return a.select("id", reason.alias("reason"))


def proof_report(cited: DataFrame, nodes: DataFrame, edges: DataFrame, claim: str) -> DataFrame:
    """``n, node_coverage, edge_coverage, missing, valid``: what claims cite (``node, src, dst``) against what is known."""
    j = cited.join(nodes.select("node", F.lit(True).alias("_n")).distinct(), "node", "left").join(edges.select("src", "dst", F.lit(True).alias("_e")).distinct(), ["src", "dst"], "left")
    rate = lambda c: F.avg(F.when(F.col(c), 1.0).otherwise(0.0))
    g = j.groupBy(claim).agg(F.count("*").alias("n"), rate("_n").alias("node_coverage"), rate("_e").alias("edge_coverage"), F.sort_array(F.collect_set(F.when(F.col("_n").isNull(), F.col("node")))).alias("missing"))
    return g.withColumn("valid", (F.col("node_coverage") == 1) & (F.col("edge_coverage") == 1))


def readiness(rows: DataFrame, group: str, item: str, state: Column) -> DataFrame:
    """``reviewed, unreviewed, unknown, ready``: sorted items of each group by ``state`` (null: unknown)."""
    s = rows.select(group, item, F.coalesce(state, F.lit("unknown")).alias("_s"))
    of = lambda k: F.sort_array(F.collect_set(F.when(F.col("_s") == k, F.col(item)))).alias(k)
    g = s.groupBy(group).agg(of("reviewed"), of("unreviewed"), of("unknown"))
    return g.withColumn("ready", (F.size("reviewed") > 0) & (F.size("unreviewed") == 0) & (F.size("unknown") == 0))


def support_of(paths: DataFrame, kinds: DataFrame, allowed: tuple[str, ...], per_source: int, limit: int) -> DataFrame:
    """The best scored path ends of each seed whose kind is allowed: ``seed, dst, source, score, position``.

    ``paths(seed, dst, score)``; ``kinds(dst, kind, source)``; up to ``per_source`` of a source and ``limit`` in all.
    """
    rank = (F.desc(F.round("score", 9)), "dst")
    j = paths.select("seed", "dst", "score").join(kinds.where(F.col("kind").isin(*allowed)), "dst")
    j = j.withColumn("_n", F.row_number().over(Window.partitionBy("seed", "source").orderBy(*rank))).where(F.col("_n") <= per_source)
    j = j.withColumn("position", F.row_number().over(Window.partitionBy("seed").orderBy(*rank))).where(F.col("position") <= limit)
    return j.select("seed", "dst", "source", "score", "position")


def reranked_paths(paths: DataFrame, scores: DataFrame, group: str, path: str, top: int) -> DataFrame:
    """Paths by a given score, or their own where none is given: adds ``score, position``, the first ``top``."""
    j = paths.join(scores.select(path, F.col("given")), path, "left").withColumn("score", F.coalesce("given", "path_score")).drop("given")
    order = Window.partitionBy(group).orderBy(F.desc("score"), path)
    return j.withColumn("position", F.row_number().over(order)).where(F.col("position") <= top)


def revised_beliefs(events: DataFrame, as_of: Column, half_life: float | None = None, margin: float = 0.15) -> DataFrame:
    """``claim, status, support, contradiction, confidence, n_active`` of each claim of ``events(claim, evidence, source, stance, retracts, confidence, at)``.

    Events up to ``as_of`` count (seconds).  A ``retract`` event takes away the evidence that it names; the others weigh
    their confidence, halved every ``half_life`` seconds.  A source counts with its strongest support and its strongest
    contradiction, sources combine as independent chances.  A claim without active events is unknown.
    """
    seen = events.where(F.col("at") <= as_of)
    gone = seen.where("stance = 'retract' and retracts is not null").select("claim", F.col("retracts").alias("evidence")).distinct()
    active = seen.where("stance <> 'retract'").join(gone, ["claim", "evidence"], "left_anti")
    weight = F.col("confidence") if half_life is None else F.col("confidence") * F.pow(F.lit(0.5), F.greatest(as_of - F.col("at"), F.lit(0.0)) / half_life)
    best = active.groupBy("claim", "source", "stance").agg(F.max(weight).alias("w"), F.count("*").alias("n"))
    sure = lambda s: F.max(F.when((F.col("stance") == s) & (F.col("w") >= 1), 1).otherwise(0)) == 1
    rest = lambda s: F.sum(F.when((F.col("stance") == s) & (F.col("w") < 1), F.log1p(-F.col("w"))).otherwise(0.0))
    chance = lambda s: F.when(sure(s), 1.0).otherwise(1 - F.exp(rest(s)))
    g = best.groupBy("claim").agg(chance("support").alias("support"), chance("contradict").alias("contradiction"), F.sum("n").alias("n_active"))
    g = seen.select("claim").distinct().join(g, "claim", "left").na.fill(0)
    gap, total = F.col("support") - F.col("contradiction"), F.col("support") + F.col("contradiction")
    status = F.when(total == 0, "unknown").when((F.col("support") > 0) & (F.col("contradiction") > 0) & (F.abs(gap) <= margin), "conflicted").when(gap >= 0, "supported").otherwise("contradicted")
    return g.select("claim", status.alias("status"), "support", "contradiction", F.when(total > 0, F.abs(gap) / total).otherwise(0.0).alias("confidence"), "n_active")
