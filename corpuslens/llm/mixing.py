"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

All steps are DataFrame operations.  A hash deals a source's documents into blocks, and a source's quota is a number of
places in its permuted sequence of blocks, read in turn as often as the target asks.  A binary tree divides the vector of
quotas among output shards: each node's left child gets a multivariate hypergeometric draw of the node's counts.  A
leaf's count of a source is a run of the source's permuted blocks that no other leaf has; rows are shuffled in their
output shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import BROADCAST_KEYS, WORD, written

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, CAP = 1.5, 2.0
#: Blocks a source is dealt into, and parts of the block in which a quota ends.
BLOCKS, PARTS = 256, 4096
SEED = 20240229
#: Depth of the splitting tree: 2 ** DEPTH output shards.
DEPTH = 3
#: A shard's rows are shuffled in parts: least number, and bytes of a part at so many bytes a word.
LEAF_PARTS, PART_BYTES, WORD_BYTES = 64, 128 << 20, 8


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def drawn(*keys: str | Column, stream: int) -> Column:
    """A repeatable draw for a key: a 64-bit hash, independent between streams."""
    return F.xxhash64(F.lit(SEED + stream), *keys)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Targets by source from ``source, source_size`` (one row for each source).

    Sources ordered by code point, null last, have the given weights in turn and share ``share`` times all sizes.  A
    target stops at ``cap`` times its source's size and the excess is shared anew by weight until none is above.  In
    closed form: with sources ordered by cap / weight, those before the first whose fair share fits are capped.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    ranked = sizes.withColumn("nth", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("nth", F.lit(len(weights))) + 1)
    limits = ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap)
    upto = Window.orderBy(F.col("most") / F.col("weight"), "nth")
    every = upto.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = upto.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        limits.withColumn("total", F.sum("source_size").over(every) * share)
        .withColumn("capped", F.coalesce(F.sum("most").over(earlier), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)))
        .withColumn("fair", (F.col("total") - F.col("capped")) / F.col("open"))
    )
    fits = F.when(F.col("fair") * F.col("weight") <= F.col("most"), F.col("fair"))
    level = level.withColumn("level", F.first(fits, True).over(every))
    return level.select(
        "source",
        "source_size",
        F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"),
    )


def _lower_half(units: DataFrame, level: int) -> DataFrame:
    """Counts by ``node, source`` of the units with the smaller draws, half of each node's units (rounded down).

    ``units`` has a row for each unit of ``node, source``.  The draws' bins are summed first, so that a window orders bins
    and then one bin's units only, however many units a node has.
    """
    bins = 1 << 12
    draw = drawn("node", "source", "unit", stream=10 + level)
    drawn_units = units.withColumn("draw", draw).withColumn("bin", F.pmod("draw", F.lit(bins)))
    by_bin = drawn_units.groupBy("node", "bin").agg(F.count("*").alias("n"))
    order, node = Window.partitionBy("node").orderBy("bin"), Window.partitionBy("node")
    cut = by_bin.withColumn("upto", F.sum("n").over(order)).withColumn("half", F.floor(F.sum("n").over(node) / 2))
    cut = cut.select("node", "bin", F.when(F.col("upto") <= F.col("half"), F.col("n")).otherwise(F.greatest(F.lit(0), F.col("half") - F.col("upto") + F.col("n"))).alias("take"), "n")
    placed = drawn_units.join(cut, ["node", "bin"])
    inside = Window.partitionBy("node", "bin").orderBy("draw", "source", "unit")
    border = placed.where("take > 0 and take < n").withColumn("nth", F.row_number().over(inside)).where("nth <= take")
    lower = placed.where("take = n").select("node", "source").unionByName(border.select("node", "source"))
    return lower.groupBy("node", "source").agg(F.count("*").alias("left"))


def splitting_tree(quotas: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Divides ``source, quota`` among ``2 ** depth`` leaves: ``source, leaf, begin, places``.

    A node's units are its places of all sources; half of them, drawn without replacement, go left, so the left child's
    counts by source are multivariate hypergeometric given the node's.  Quotas are exact: a source's leaves are
    consecutive runs [begin, begin + places) that fill its quota.
    """
    nodes = quotas.where("quota > 0").select("source", F.lit(0).alias("node"), F.col("quota").cast("long").alias("places"))
    for level in range(depth):
        units = nodes.select("node", "source", F.explode(F.sequence(F.lit(1), F.col("places").cast("int"))).alias("unit"))
        left = _lower_half(units, level).withColumnRenamed("node", "l_node").withColumnRenamed("source", "l_source")
        both = nodes.join(left, (nodes.node == left.l_node) & nodes.source.eqNullSafe(left.l_source), "left")
        got = F.coalesce("left", F.lit(0).cast("long"))
        sides = F.array(F.struct((F.col("node") * 2).alias("node"), got.alias("places")), F.struct((F.col("node") * 2 + 1).alias("node"), (F.col("places") - got).alias("places")))
        nodes = both.select("source", F.explode(sides).alias("x")).select("source", "x.node", "x.places").where("places > 0")
        nodes = written(nodes, "mix-nodes")
    run = Window.partitionBy("source").orderBy("node")
    return nodes.select("source", F.col("node").alias("leaf"), (F.sum("places").over(run) - F.col("places")).alias("begin"), "places")


def _row_draw(docs: DataFrame, source: str, text: str, key: str) -> Column:
    """A draw that depends on a row's key, source and text alone: equal rows have equal draws, whatever the partitions."""
    return drawn(docs[key].cast("string"), docs[source], F.crc32(docs[text].cast("binary")), stream=1)


def _block(draw: Column) -> Column:
    return F.pmod(draw, F.lit(BLOCKS)).cast("int")


def _place(source: Column, block: Column) -> Column:
    """The block's place in its source's permutation, an affine one with an odd factor: 0 to BLOCKS - 1."""
    factor = F.pmod(drawn(source, stream=2), F.lit(BLOCKS // 2)).cast("int") * 2 + 1
    return F.pmod(block * factor + F.pmod(drawn(source, stream=3), F.lit(BLOCKS)).cast("int"), F.lit(BLOCKS))


def _part(draw: Column) -> Column:
    return F.pmod(F.shiftrightunsigned(draw, 16), F.lit(PARTS)).cast("int")


def source_plan(rows: DataFrame) -> DataFrame:
    """One row for each source of ``rows(source, size, draw)``: where its quota ends and which leaf has which places.

    Returns ``source, source_size, target, border, border_part, border_draw, share, quota, leaves``: ``border`` counts whole
    blocks from the first pass on; in the block after them, parts below ``border_part`` and, inside that part, draws below
    ``border_draw`` are taken whole, and a row of that draw gives ``share`` words.  ``leaves`` lists begin and leaf.

    Sums by (source, block), by part of one block a source, and the rows of one such part are all that is ordered: a
    source with most rows is still dealt over BLOCKS x PARTS groups.
    """
    place = _place(F.col("source"), _block(F.col("draw")))
    blocks = written(rows.groupBy("source", place.alias("place")).agg(F.sum("size").alias("words")), "mix-blocks")
    targets = source_targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")))

    def last_fit(sums: DataFrame, at: str, left: str) -> DataFrame:
        """``source, at, left`` of the first group, in order of ``at``, that ``left`` words don't hold whole."""
        order = Window.partitionBy("source").orderBy(at)
        sums = sums.withColumn("over", F.sum("words").over(order)).where(F.col("over") > F.col(left))
        return sums.groupBy("source").agg(F.min_by(F.struct(at, (F.col(left) - F.col("over") + F.col("words")).alias("left")), at).alias("x")).select("source", "x.*")

    quota = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    quota = written(quota.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-quota")
    rest = quota.select(F.col("source").alias("q_source"), "rest")
    first = last_fit(blocks.join(rest, blocks.source.eqNullSafe(rest.q_source)), "place", "rest")
    first = written(first.withColumnRenamed("left", "room"), "mix-border")

    f = F.broadcast(first.select(F.col("source").alias("f_source"), F.col("place").alias("f_place"), "room")) if first.count() <= BROADCAST_KEYS // 16 else first.select(F.col("source").alias("f_source"), F.col("place").alias("f_place"), "room")
    inside = rows.withColumn("place", place).join(f, F.col("source").eqNullSafe(f.f_source) & (F.col("place") == f.f_place))
    inside = inside.select("source", "size", "draw", "room", _part(F.col("draw")).alias("part"))
    parts = inside.groupBy("source", "part").agg(F.sum("size").alias("words"), F.any_value("room").alias("room"))
    second = written(last_fit(parts, "part", "room").withColumnRenamed("left", "part_room"), "mix-part")
    g = second.select(F.col("source").alias("g_source"), F.col("part").alias("g_part"), "part_room")
    third = inside.join(g, F.col("source").eqNullSafe(g.g_source) & (F.col("part") == g.g_part))
    third = third.groupBy("source", "draw").agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.any_value("part_room").alias("part_room"))
    ends = last_fit(third, "draw", "part_room")
    ends = ends.withColumnRenamed("source", "e_source").join(
        third.select(F.col("source").alias("t_source"), F.col("draw").alias("t_draw"), "n"), F.col("e_source").eqNullSafe(F.col("t_source")) & (F.col("draw") == F.col("t_draw"))
    ).select("e_source", "draw", F.floor(F.col("left") / F.col("n")).alias("share"))

    s1, s2 = first.select(F.col("source").alias("f_source"), F.col("place").alias("f_place")), second.select(F.col("source").alias("g_source"), F.col("part").alias("g_part"))
    plan = quota.join(s1, quota.source.eqNullSafe(s1.f_source), "left").join(s2, quota.source.eqNullSafe(s2.g_source), "left")
    plan = plan.join(ends, quota.source.eqNullSafe(ends.e_source), "left").select(
        quota.source, F.col("source_size").cast("long").alias("source_size"), "target",
        (F.col("whole") * BLOCKS + F.when(F.col("source_size") > 0, F.coalesce("f_place", F.lit(BLOCKS))).otherwise(0)).cast("long").alias("border"),
        F.coalesce("g_part", F.lit(0)).alias("border_part"), F.col("draw").alias("border_draw"), F.coalesce("share", F.lit(0).cast("long")).alias("share"),
    )
    plan = plan.withColumn("quota", F.col("border") + F.when(F.col("border_draw").isNotNull(), 1).otherwise(0))
    plan = written(plan, "mix-plan")
    leaves = splitting_tree(plan.select("source", "quota")).groupBy(F.col("source").alias("l_source")).agg(
        F.array_sort(F.collect_list(F.struct("begin", "leaf"))).alias("leaves")  # 2 ** DEPTH entries at most
    )
    return written(plan.join(leaves, plan.source.eqNullSafe(leaves.l_source), "left").drop("l_source"), "mix-sources")


def _with_plan(docs: DataFrame, plan: DataFrame, source: str, text: str, key: str) -> DataFrame:
    """``docs`` with a struct of what the mix takes of each row: ``mix`` is named so that no column of ``docs`` clashes.

    Returns all columns of ``docs`` in a struct ``d``, and ``size, draw, p`` (the source's plan) and ``taken_places``: the
    (leaf, words) of each pass, read from the leaves of the tree.  The table of sources is broadcast while it is small.
    """
    body = F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)])
    rows = docs.select(body.alias("d"), docs[source].alias("source"), n_words(docs[text]).alias("size"), _row_draw(docs, source, text, key).alias("draw"))
    p = plan.select(F.col("source").alias("p_source"), F.struct("source_size", "target", "border", "border_part", "border_draw", "share", "leaves").alias("p"))
    if plan.count() <= BROADCAST_KEYS // 16:
        p = F.broadcast(p)
    rows = rows.join(p, rows.source.eqNullSafe(p.p_source))
    at = _place(F.col("source"), _block(F.col("draw")))
    part, edge = _part(F.col("draw")), F.col("p.border_draw")
    inside = F.when(part < F.col("p.border_part"), F.col("size")).when(part > F.col("p.border_part"), 0)
    inside = inside.when(F.col("draw") < edge, F.col("size")).when(F.col("draw") == edge, F.col("p.share")).otherwise(0)
    words = lambda place: F.when(place < F.col("p.border"), F.col("size")).when((place == F.col("p.border")) & edge.isNotNull(), inside).otherwise(0)
    leaf = lambda place: F.element_at(F.filter("p.leaves", lambda x: x["begin"] <= place), -1)["leaf"]
    passes = F.transform(F.array(*[at.cast("long") + F.lit(j * BLOCKS) for j in range(int(CAP) + 1)]), lambda x: F.struct(leaf(x).alias("leaf"), words(x).cast("long").alias("words")))
    return rows.withColumn("taken_places", F.filter(passes, lambda x: x["words"] > 0))


def _drawn_rows(docs: DataFrame, source: str, text: str, key: str) -> DataFrame:
    return written(docs.select(docs[source].alias("source"), n_words(docs[text]).alias("size"), _row_draw(docs, source, text, key).alias("draw")), "mix-rows")


def plan_mixture(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each document with its source's target and what the leaves of the splitting tree take of it.

    Returns ``doc_id, size, source_size, target, taken, passes, out_shards``: ``out_shards`` lists the leaf of each pass,
    ``taken`` sums the words of the passes.  A null or blank text has size 0 and takes nothing; a null source is a source
    of its own, last in order; equal rows are taken alike, and where a quota ends among them they share what is left;
    an empty table gives no rows; other columns are ignored.  Reruns agree, however the rows are dealt over files.
    """
    plan = source_plan(_drawn_rows(docs, source, text, key))
    rows = _with_plan(docs.select(docs[key], docs[source], docs[text]), plan, source, text, key)
    words = F.aggregate("taken_places", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return rows.select(
        F.col("d.c0").alias("doc_id"), "size", F.col("p.source_size").alias("source_size"), F.col("p.target").alias("target"),
        words.alias("taken"), F.size("taken_places").alias("passes"), F.transform("taken_places", lambda x: x["leaf"]).alias("out_shards"),
    )


def mixed_documents(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """The mixture itself: the columns of ``docs``, a row for each pass, dealt by output shard and shuffled inside.

    The last pass of a row in which a source's quota ends is cut to its first words, so that the source meets its target.
    What the mix takes of a row depends on the row alone, so texts are shuffled once, to their output shard, in parts that
    grow in number with the words of the mixture.  Nulls, repeats and empty tables are treated as in ``plan_mixture``.
    """
    plan = source_plan(_drawn_rows(docs, source, text, key))
    rows = _with_plan(docs, plan, source, text, key)
    rows = rows.select("d", "size", "draw", F.posexplode("taken_places").alias("pass", "x"))
    words = plan.agg(F.sum("target")).first()[0] or 0
    parts = max(LEAF_PARTS, int(words * WORD_BYTES / (2**DEPTH * PART_BYTES)))
    rows = rows.repartition(F.col("x.leaf"), F.pmod(F.col("draw"), F.lit(parts)))
    rows = rows.sortWithinPartitions("x.leaf", drawn("draw", "pass", stream=4), "draw", "pass")
    at = docs.columns.index(text)
    body = F.col(f"d.c{at}")
    first = F.slice(F.regexp_extract_all(body, F.lit(f"({WORD})"), 1), F.lit(1), F.col("x.words").cast("int"))
    cut = F.when(F.col("x.words") < F.col("size"), F.array_join(first, " ")).otherwise(body)
    return rows.select(*[(cut if i == at else F.col(f"d.c{i}")).alias(c) for i, c in enumerate(docs.columns)])
