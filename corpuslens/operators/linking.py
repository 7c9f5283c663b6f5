"""Links between parts of documents and records: regions, captions, mentions, staged matches, nearby points, corrections."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.operators.lineage import cut, small


def overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of two boxes with sides ``x0, y0, x1, y1``; 0 where they don't meet or have no area."""
    width = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    height = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    both = width * height
    whole = area(a) + area(b) - both
    return F.when(whole > 0, both / whole).otherwise(0.0)


def _sides(prefix: str) -> dict[str, Column]:
    return {s: F.col(f"{prefix}.{s}") for s in ("x0", "y0", "x1", "y1")}


def region_blocks(regions: DataFrame, blocks: DataFrame, least: float = 0.2) -> DataFrame:
    """The block of the same page that fits each region best: ``doc, region, block, score``.

    Both hold ``doc, page, role, hash, x0, y0, x1, y1`` and their id, and score by overlap, 1 for an equal hash and 0.25 for
    an equal role.  Equal best scores are ambiguous, and such regions have no row.  A page holds few blocks.
    """
    j = regions.alias("r").join(blocks.alias("b"), ["doc", "page"])
    score = overlap(_sides("r"), _sides("b")) + F.when(F.col("r.hash") == F.col("b.hash"), 1.0).otherwise(0.0) + F.when(F.col("r.role") == F.col("b.role"), 0.25).otherwise(0.0)
    j = j.select("doc", "region", "block", F.round(score, 9).alias("score")).where(F.col("score") >= least)
    best = j.groupBy("doc", "region").agg(F.max("score").alias("score"))
    found = j.join(best, ["doc", "region", "score"]).groupBy("doc", "region", "score").agg(F.min("block").alias("block"), F.count("*").alias("n"))
    return found.where("n = 1").select("doc", "region", "block", "score")


def caption_links(captions: DataFrame, targets: DataFrame, near: float = 0.08, far: float = 0.18) -> DataFrame:
    """The figure or table that each caption names or stands nearest to: ``doc, caption, target, confidence``.

    An equal label is distance 0 (0.98); else the vertical gap plus a quarter of the gap between centres, up to ``near``
    (0.85) or ``far`` (0.65).
    """
    j = captions.alias("c").join(targets.alias("t"), ["doc", "page"])
    c, t = _sides("c"), _sides("t")
    named = F.coalesce(F.col("c.label") == F.col("t.label"), F.lit(False))
    gap = F.least(F.abs(c["y0"] - t["y1"]), F.abs(t["y0"] - c["y1"])) + 0.25 * F.abs((c["x0"] + c["x1"] - t["x0"] - t["x1"]) / 2)
    j = j.select("doc", "caption", "target", named.alias("named"), F.round(F.when(named, 0.0).otherwise(gap), 9).alias("distance"))
    best = j.groupBy("doc", "caption").agg(F.min(F.struct("distance", "target", "named")).alias("x"))
    confidence = F.when(F.col("x.named"), 0.98).when(F.col("x.distance") <= near, 0.85).when(F.col("x.distance") <= far, 0.65)
    return best.select("doc", "caption", F.col("x.target").alias("target"), confidence.alias("confidence")).where("confidence is not null")


def reference_links(blocks: DataFrame, label: Column, pattern: str) -> DataFrame:
    """Mentions in ``blocks(doc, block, text)`` of labels that another block of the document carries: ``doc, block, target``.

    ``label`` gives a block's own label or an empty string; the first block with a label has it.  ``pattern`` has one group.
    """
    owned = blocks.select("doc", "block", label.alias("label")).where("label <> ''").groupBy("doc", "label").agg(F.min("block").alias("target"))
    mentions = blocks.select("doc", "block", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), 1))).alias("label"))
    return mentions.join(owned, ["doc", "label"]).where("block <> target").select("doc", "block", "target").distinct()


def staged_match(left: DataFrame, right: DataFrame, stages: Sequence[tuple[str, Sequence[tuple[str, str]]]], key: str = "id", target: str = "target") -> DataFrame:
    """``key, target, how``: the first stage whose columns are equal decides; null columns match nothing.

    ``stages`` are (name, [(left column, right column), ...]).  More than one target in a stage is ``ambiguous``, none in all
    is ``unmatched``.
    """
    rest, found = left, []
    for name, columns in stages:
        # first and last target of each key: one row a key and task is shuffled, however many targets share it
        known = right.groupBy(*[F.col(b).alias(f"_{i}") for i, (_, b) in enumerate(columns)]).agg(F.min(target).alias("_t"), F.max(target).alias("_last"), F.count("*").alias("_n"))
        test = reduce(lambda a, b: a & b, [F.col(a) == F.col(f"_{i}") for i, (a, _) in enumerate(columns)])
        j = rest.join(known, test, "left")
        hit = j.where("_n is not null")
        one = F.col("_t") == F.col("_last")
        found.append(hit.select(key, F.when(one, F.col("_t")).alias(target), F.when(one, name).otherwise("ambiguous").alias("how")))
        rest = j.where("_n is null").select(*left.columns)
    found.append(rest.select(key, F.lit(None).cast(right.schema[target].dataType).alias(target), F.lit("unmatched").alias("how")))
    return reduce(DataFrame.unionByName, found)


def near_points(left: DataFrame, right: DataFrame, tolerance: float) -> DataFrame:
    """Pairs within ``tolerance`` of each other in the same reference system: ``id, node, distance``.

    Both hold ``crs, x, y``.  Right points are put into their cell and the eight around it, so pairs meet by equality.
    """
    cell = lambda c: F.floor(F.col(c) / tolerance)
    around = right.withColumn("cx", F.explode(F.transform(F.array(*[F.lit(i) for i in (-1, 0, 1)]), lambda i: cell("x") + i)))
    around = around.withColumn("cy", F.explode(F.transform(F.array(*[F.lit(i) for i in (-1, 0, 1)]), lambda i: cell("y") + i)))
    j = left.withColumns({"cx": cell("x"), "cy": cell("y")}).alias("a").join(around.alias("b"), ["crs", "cx", "cy"])
    dx, dy = F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")
    distance = F.sqrt(dx * dx + dy * dy)
    near = (distance <= tolerance - 1e-6) | (F.round(distance, 6) <= tolerance)  # rounding costs more than the rest of a pair
    return j.where(near).select("id", "node", F.round(distance, 6).alias("distance"))


def apply_corrections(records: DataFrame, corrections: DataFrame, key: str = "id", value: str = "value") -> DataFrame:
    """Adds ``applied`` and replaces ``value`` where a correction names the digest of the present value.

    ``corrections(key, previous, corrected, at)``; the latest one that fits counts.
    """
    digest = F.sha2(F.coalesce(F.col(value), F.lit("")), 256)
    last = corrections.groupBy(key, "previous").agg(F.max_by("corrected", F.struct("at", "corrected")).alias("_new"), F.lit(True).alias("_hit"))
    j = records.withColumn("previous", digest).join(last, [key, "previous"], "left")
    hit = F.coalesce("_hit", F.lit(False))
    return j.withColumn(value, F.when(hit, F.col("_new")).otherwise(F.col(value))).withColumn("applied", hit).drop("_new", "_hit", "previous")


def chained_tables(tables: DataFrame, same: Sequence[str]) -> DataFrame:
    """Adds ``chain``: tables of a document on consecutive pages with equal ``same`` columns have one number, from 1."""
    w = Window.partitionBy("doc").orderBy("page", "block")
    joined = F.lag("page").over(w) == F.col("page") - 1
    for c in same:
        joined = joined & F.lag(c).over(w).eqNullSafe(F.col(c))
    starts = F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)
    return tables.withColumn("_s", starts).withColumn("chain", F.sum("_s").over(w)).drop("_s")


def series_records(series: DataFrame, locations: DataFrame, group: Sequence[str], at: str, place: str) -> DataFrame:
    """One record for each series: ``first, last, n`` and the ``location`` whose alias is its ``place``."""
    s = series.groupBy(*group).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))
    return s.join(locations.groupBy(F.col("alias").alias(place)).agg(F.min("location").alias("location")), place, "left")


def search_nodes(queries: DataFrame, nodes: DataFrame, top: int = 20, favoured: Sequence[str] = (), exclude: Column | None = None, penalty: float | None = None) -> DataFrame:
    """The best ``top`` nodes of each query: ``query_id, node, score, position``.

    ``queries(query_id, text)`` and ``nodes(node, type, label, text)``.  A node scores 2 for an equal label, 1.5 for each
    term in its label, 1 + ln(1 + count) for each term, the share of terms it holds, and 0.25 for a favoured type.  Nodes
    under ``exclude`` are left out; with ``penalty`` scores shrink by that much of the node's ``risk``.

    Equal queries, and nodes that differ only by their id or in words no query holds, are scored once: rows grow with the
    different ones.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    q = queries.select("query_id", F.array_distinct(words("text")).alias("terms")).withColumn("phrase", F.array_join("terms", " "))
    if exclude is not None:
        nodes = nodes.where(~F.coalesce(exclude, F.lit(False)))
    risk = F.col("risk") if penalty is not None else F.lit(0.0)
    n = nodes.select("node", "type", F.lower("label").alias("low"), words("label").alias("in_label"), words(F.concat_ws(" ", "label", "text")).alias("t"), risk.alias("risk"))
    asked = q.select(F.explode("terms").alias("term")).distinct()
    held = n.select("*", F.explode("t").alias("term")).join(small(asked), "term", "left_semi").groupBy("node", "type", "low", "in_label", "risk", "term").agg(F.count("*").alias("tf"))
    one = F.when(F.array_contains("in_label", F.col("term")), 1.5).otherwise(0.0) + 1.0 + F.log1p("tf")
    kinds = held.withColumn("one", one).groupBy("node", "type", "low", "risk").agg(F.sort_array(F.collect_list(F.struct("term", "one"))).alias("profile"))
    kinds = kinds.withColumn("kind", F.sha2(F.to_json(F.struct("type", "low", "risk", "profile")), 256))
    firsts = kinds.withColumn("nth", F.row_number().over(Window.partitionBy("kind").orderBy("node"))).where(F.col("nth") <= top)
    firsts = cut(firsts)  # equal but for their id, so a query's best hold no more than these of a kind
    terms = firsts.where("nth = 1").select("kind", "type", "low", "risk", F.explode("profile").alias("p")).select("kind", "type", "low", "risk", "p.term", "p.one")
    forms = q.select("phrase", F.size("terms").alias("n_terms"), F.explode("terms").alias("term")).distinct()
    g = terms.join(forms, "term").groupBy("phrase", "n_terms", "kind", "type", "low", "risk").agg(F.sum("one").alias("s"), F.count("*").alias("matched"))
    score = F.when(F.col("phrase") == F.col("low"), 2.0).otherwise(0.0) + F.col("s") + F.col("matched") / F.col("n_terms")
    score = score + F.when(F.col("type").isin(*favoured), 0.25).otherwise(0.0) if favoured else score
    if penalty is not None:
        score = score * F.greatest(F.lit(0.0), 1 - penalty * F.col("risk"))
    g = g.select("phrase", "kind", "type", "low", F.round(score, 9).alias("score"))
    g = g.withColumn("_n", F.dense_rank().over(Window.partitionBy("phrase").orderBy(F.desc("score"), "type", "low"))).where(F.col("_n") <= top)
    order = Window.partitionBy("phrase").orderBy(F.desc("score"), "type", "low", "node")
    best = g.drop("_n").join(firsts.select("kind", "node"), "kind").withColumn("position", F.row_number().over(order)).where(F.col("position") <= top)
    return q.select("query_id", "phrase").join(best, "phrase").select("query_id", "node", "score", "position")


#: A word that prose defines, and its definition; a panel's letter in a caption, and what follows.  Fixed values.
DEFINES = r"(?i)(?:\bwhere\b|\bwith\b|\blet\b|\bdenote(?:s|d)?\b)?\s*([A-Za-z][A-Za-z0-9_]{0,31}|[α-ωΑ-Ω])\s+(?:is|denotes|represents|means|=)\s+([^.;]{2,300})"
PANEL = r"(?:^|[\s,;])\(?([A-Za-z])\)\s*([^;]{0,300})"


def _matches(text: str, pattern: str, first: str, second: str) -> Column:
    """Both groups of each match, with the match's number."""
    groups = [F.regexp_extract_all(text, F.lit(pattern), i) for i in (1, 2)]
    tidy = lambda x: F.regexp_replace(F.regexp_replace(x, r"\s+", " "), "^ | $", "")
    return F.transform(F.arrays_zip(groups[0].alias("a"), groups[1].alias("b")), lambda x, i: F.struct(i.alias("nth"), x["a"].alias(first), tidy(x["b"]).alias(second)))


def formula_symbols(prose: DataFrame, formulas: DataFrame, window: int = 4) -> DataFrame:
    """``doc, formula, symbol, definition, source, confidence`` of the symbols that formulas or prose near them define.

    ``prose(doc, position, block, text)`` and ``formulas(doc, position, block, text, symbols)`` share the reading order; a
    definition reaches formulas up to ``window`` places away that hold its symbol in any case.  ``symbols`` maps what the
    formula itself defines.  The first definition of a block counts.  Definitions are dealt to the places they reach and meet
    formulas by equality, so no document is paired with itself.
    """
    own = formulas.select("doc", F.col("block").alias("formula"), F.explode("symbols").alias("symbol", "definition"), F.col("block").alias("source"), F.lit(1.0).alias("confidence"))
    said = prose.select("doc", "position", F.col("block").alias("source"), F.explode(_matches("text", DEFINES, "symbol", "definition")).alias("m"))
    said = said.groupBy("doc", "position", "source", "m.symbol").agg(F.min_by("m.definition", "m.nth").alias("definition"))
    reached = said.withColumn("position", F.explode(F.sequence(F.col("position") - window, F.col("position") + window)))
    f = formulas.select("doc", "position", F.col("block").alias("formula"), F.lower("text").alias("_text"))
    near = reached.join(f, ["doc", "position"]).where("contains(_text, lower(symbol)) and formula <> source")
    return own.unionByName(near.select("doc", "formula", "symbol", "definition", "source", F.lit(0.82).alias("confidence")))


def figure_panels(panels: DataFrame, captions: DataFrame) -> DataFrame:
    """``doc, figure, panel, label, description, evidence, confidence``: what captions say of each panel of a figure.

    ``panels(doc, page, figure, panel, label, caption)`` carry their figure's own caption, which is read first, then
    ``captions(doc, page, position, block, text)`` of the page in order.  A panel without a letter is left out; one that no
    caption names has an empty description, and its figure is the evidence, as it is for an own caption that no block holds.
    """
    p = panels.withColumn("_label", F.regexp_replace(F.lower("label"), r"^[() ]+|[() ]+$", "")).where("_label <> ''")
    blocks = captions.groupBy("doc", "page", "text").agg(F.min_by("block", "position").alias("block"), F.min("position").alias("position"))
    said = blocks.select("doc", "page", "block", "position", F.explode(_matches("text", PANEL, "letter", "description")).alias("m"))
    said = said.select("doc", "page", F.lower("m.letter").alias("_label"), F.struct("position", "m.nth", "m.description", "block").alias("m"))
    on_page = said.groupBy("doc", "page", "_label").agg(F.min("m").alias("page_m"))
    held = p.join(blocks.select("doc", "page", F.col("text").alias("caption"), F.col("block").alias("own_block")), ["doc", "page", "caption"], "left").join(on_page, ["doc", "page", "_label"], "left")
    first = F.filter(_matches("caption", PANEL, "letter", "description"), lambda m: F.lower(m["letter"]) == F.col("_label"))
    held = held.withColumn("own", F.get(F.coalesce(first, F.array().cast("array<struct<nth:int,letter:string,description:string>>")), F.lit(0)))
    description = F.when(F.col("own").isNotNull(), F.col("own.description")).otherwise(F.coalesce("page_m.description", F.lit("")))
    evidence = F.when(F.col("own").isNotNull(), F.coalesce("own_block", "figure")).otherwise(F.coalesce("page_m.block", "figure"))
    return held.select("doc", "figure", "panel", "label", description.alias("description"), evidence.alias("evidence"), F.when(description != "", 0.92).otherwise(0.70).alias("confidence"))
