"""Near-duplicates by ProbMinHash.

Five-word shingles weighted by their counts arrive in exponential time; the first arrival in each of M registers, with
early termination, makes a signature whose agreement estimates the probability Jaccard similarity.  Bands of registers
give candidates, which are verified with the exact similarity; classes are connected components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm import bloom
from corpuslens.llm.common import Words, arrow_map, chunks, key_type, mix, ragged, signed, windows, without, written
from corpuslens.llm.components import connected_components

SHINGLE, THRESHOLD = 5, 0.8
#: 32 bands of 6 registers: a pair at similarity 0.8 meets in a band but for 6 in 100,000, at 0.9 but for 1 in 10^10.
BANDS, ROWS = 32, 6
REGISTERS = BANDS * ROWS
#: Arrivals drawn at once.
DRAWS = 1 << 15

#: Texts and shingles of a block, about; a block of long texts has fewer of them.
BLOCK, BLOCK_SHINGLES = 512, 1 << 18
#: Shingles that a unit compares at once: bounds its tables of texts by shingles.
COLUMNS = 4096

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle, count), ordered by text and shingle; a shorter text is one shingle of all its words."""
    h, at = windows(words.hash, words.doc, size)
    doc = words.doc[at]
    n = np.diff(words.bounds)
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        whole = [np.frombuffer(hashlib.blake2b(words.hash[words.bounds[i] : words.bounds[i + 1]].tobytes(), digest_size=8).digest(), np.uint64)[0] for i in short]
        h, doc = np.concatenate([h, np.array(whole, np.uint64)]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return doc[first], h[first], np.diff(np.append(first, len(h)))


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash signature of each text: the element that arrives first in every register.

    An element's arrivals form a Poisson process of rate ``weight`` whose points fall into random registers; times and
    registers depend on the element alone.  An element stops once it comes later than all registers' first arrivals.
    """
    first = np.full(n_docs * registers, np.inf)
    sig = np.zeros(n_docs * registers, np.uint64)
    time, turn = np.zeros(len(element)), 0
    live = np.arange(len(element))
    while len(live):
        each = int(np.clip(DRAWS // len(live), 1, 64))
        with np.errstate(over="ignore"):
            seed = element[live][:, None] + _GOLD * np.arange(2 * turn + 1, 2 * (turn + each) + 1, 2, dtype=np.uint64)
            u = mix(seed)
            k = (mix(seed + _GOLD) % np.uint64(registers)).astype(np.int64)
        gap = -np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[live][:, None]
        t = time[live][:, None] + np.cumsum(gap, axis=1)
        time[live] = t[:, -1]
        cell = (doc[live][:, None] * registers + k).ravel()
        t, owner = t.ravel(), np.repeat(live, each)
        sooner = np.flatnonzero(t < first[cell])
        sooner = sooner[np.argsort(-t[sooner], kind="stable")]  # the earliest is written last
        first[cell[sooner]] = t[sooner]
        sig[cell[sooner]] = element[owner[sooner]]
        last = first.reshape(n_docs, registers).max(axis=1)
        live = live[time[live] < last[doc[live]]]
        turn += each
    return sig.reshape(n_docs, registers)


def _keys(words: Words) -> list[bytes]:
    """16-byte hash of each text's words: equal for texts that differ in white space only."""
    return [hashlib.blake2b(words.hash[a:b].tobytes(), digest_size=16).digest() for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, raw, off in chunks(batch.column("text")):
            words = Words(raw, off)
            doc, element, count = shingles(words)
            sig = signatures(doc, element, count.astype(float), hi - lo)
            with np.errstate(over="ignore"):
                band = np.zeros((hi - lo, BANDS), np.uint64)
                for j in range(ROWS):
                    band = mix(band * _GOLD + sig.reshape(hi - lo, BANDS, ROWS)[:, :, j])
                band = mix(band + np.arange(BANDS, dtype=np.uint64) * _GOLD)
            some = np.diff(words.bounds) > 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(lo, hi - lo),
                    pa.array(_keys(words), pa.binary()),
                    pa.array(np.diff(words.bounds), pa.int64()),
                    ragged(signed(band[some].ravel()), np.where(some, BANDS, 0), pa.int64()),
                ],
                ["doc_id", "key", "n_words", "bands"],
            )


def _with_shingles(wanted: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, off in chunks(batch.column("text")):
                words = Words(raw, off)
                keys = _keys(words)
                take = np.array([bloom.holds(wanted, k) for k in keys], bool) & (np.diff(words.bounds) > 0)
                if not take.any():
                    continue
                doc, element, count = shingles(words)
                at = np.searchsorted(doc, np.arange(hi - lo + 1))
                picked = np.flatnonzero(take)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([keys[i] for i in picked], pa.binary()),
                        pa.array([element[at[i] : at[i + 1]].tobytes() for i in picked], pa.binary()),
                        pa.array([b"" if (c := count[at[i] : at[i + 1]]).max() == 1 else c.astype(np.int64).tobytes() for i in picked], pa.binary()),
                    ],
                    ["key", "shingles", "counts"],
                )

    return run


def probability_jaccard(a: np.ndarray, v: np.ndarray, b: np.ndarray, w: np.ndarray) -> float:
    """Exact probability Jaccard similarity of two weighted sets (sorted distinct elements and weights).

    The sum over common d of 1 / sum over all e of max(v_e / v_d, w_e / w_d): elements ordered by v / w make each
    inner sum two cumulative sums.  With equal weights it is the Jaccard similarity of the sets.
    """
    common, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    if v[0] == 1 and w[0] == 1 and v.max() == 1 and w.max() == 1:
        return len(common) / (len(a) + len(b) - len(common))
    only_v, only_w = v.sum() - v[i].sum(), w.sum() - w[j].sum()
    cv, cw = v[i].astype(float), w[j].astype(float)
    order = np.argsort(cv / cw, kind="stable")
    cv, cw = cv[order], cw[order]
    above = only_v + np.cumsum(cv[::-1])[::-1]  # elements whose v / w is as large or larger
    below = only_w + np.cumsum(cw) - cw
    return float(np.sum(1.0 / (above / cv + below / cw)))


def _weighted(rows: pa.RecordBatch | pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Shingles and weights of each row; no counts stand for weights of 1."""
    h = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
    counts = rows.column("counts").to_pylist()
    return h, [np.frombuffer(c, np.int64) if c else np.ones(len(x), np.int64) for x, c in zip(h, counts, strict=True)]


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, shingle, share): each shingle's share of its text's weight."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            part = batch.slice(lo, 64)
            h, w = _weighted(part)
            owner = np.repeat(np.arange(len(h)), [len(x) for x in h])
            share = np.concatenate([x / x.sum() for x in w])
            yield pa.RecordBatch.from_arrays(
                [part.column("key").take(pa.array(owner)), pa.array(signed(np.concatenate(h)), pa.int64()), pa.array(share)], ["key", "shingle", "share"]
            )


def own_share(texts: DataFrame) -> DataFrame:
    """``key, own``: the share of a text's weight in shingles that no other of these texts holds.

    One partially aggregated count of shingles; a shingle found once brings its text along, so nothing is joined back.
    """
    each = texts.select("key", "shingles", "counts").transform(arrow_map, _exploded, "key binary, shingle long, share double")
    once = each.groupBy("shingle").agg(F.count("*").alias("n"), F.min("key").alias("key"), F.min("share").alias("share")).where("n = 1")
    return once.groupBy("key").agg(F.sum("share").alias("own"))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("a_shingles", "a_counts", "b_shingles", "b_counts")]
        sims = []
        for sa, ca, sb, cb in zip(*cols, strict=True):
            a, b = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
            v = np.frombuffer(ca, np.int64) if ca else np.ones(len(a), np.int64)
            w = np.frombuffer(cb, np.int64) if cb else np.ones(len(b), np.int64)
            sims.append(probability_jaccard(a, v, b, w))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sims, pa.float64())], ["a", "b", "sim"])


def _overlaps(h: list[np.ndarray], w: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each two texts: how many distinct shingles they share, and the share of the first's weight in those.

    Shingles that one text alone holds can't add to either, so they are left out; the others are taken COLUMNS at a time.
    """
    n, total = len(h), np.array([x.sum() for x in w], float)
    _, at, held = np.unique(np.concatenate(h), return_inverse=True, return_counts=True)
    text, weight = np.repeat(np.arange(n), [len(x) for x in h]), np.concatenate(w)
    some = held[at] > 1
    column = (np.cumsum(held > 1) - 1)[at[some]]
    order = np.argsort(column, kind="stable")
    column, text, weight = column[order], text[some][order], weight[some][order]
    shared, share = np.zeros((n, n)), np.zeros((n, n))
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, (lo, lo + COLUMNS)))
        holds, weighs = np.zeros((2, n, COLUMNS), np.float32)
        holds[text[part], column[part] - lo] = 1
        weighs[text[part], column[part] - lo] = weight[part]
        shared += holds @ holds.T
        share += weighs @ holds.T
    return shared, share / total[:, None]


def _cross_links(threshold: float):
    """Links between texts of different labels of one unit: blocks i and j of a band (or one block).

    Of texts that repeat no shingle the similarity is the Jaccard index of their sets.  Others are compared in full where
    the smaller of the two shares of weight in common, which no probability Jaccard similarity exceeds, reaches
    ``threshold``.
    """

    def run(unit: pa.Table) -> pa.Table:
        keys, label, block = (unit.column(c).to_pylist() for c in ("key", "label", "block"))
        names = {x: i for i, x in enumerate(sorted(set(label)))}
        lab, blk = np.array([names[x] for x in label]), np.array(block)
        i, j = unit.column("i")[0].as_py(), unit.column("j")[0].as_py()
        test = (lab[:, None] != lab[None, :]) & ((blk[:, None] == i) & (blk[None, :] == j))
        if i == j:
            test &= np.tri(len(keys), k=-1, dtype=bool)
        links = []
        if test.any():
            h, w = _weighted(unit)
            plain, size = np.array([x.max() == 1 for x in w]), np.array([len(x) for x in h], float)
            shared, share = _overlaps(h, w)
            both = plain[:, None] & plain[None, :]
            jaccard = shared / (size[:, None] + size[None, :] - shared)
            links = np.argwhere(test & both & (jaccard >= threshold)).tolist()
            near = test & ~both & (np.minimum(share, share.T) >= threshold - 1e-6)
            links += [(a, b) for a, b in np.argwhere(near) if probability_jaccard(h[a], w[a], h[b], w[b]) >= threshold]
        return pa.table({"a": pa.array([keys[a] for a, _ in links], pa.binary()), "b": pa.array([keys[b] for _, b in links], pa.binary())})

    return run


def cross_links(rows: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links ``a, b`` between members of different labels of each band of ``rows(band, key, label)``.

    A band's members are dealt into blocks of about BLOCK texts and BLOCK_SHINGLES shingles; every two blocks are one
    unit of bounded size that a task compares within, so no pair becomes a row unless it is a link.
    """
    blocks = F.greatest(F.count("*") / F.lit(float(BLOCK)), F.sum("n_shingles") / F.lit(float(BLOCK_SHINGLES)))
    rows = rows.join(texts.select("key", "n_shingles"), "key")
    sizes = rows.groupBy("band").agg(F.ceil(blocks).cast("int").alias("blocks"))
    dealt = rows.join(sizes, "band").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j")))
    units = dealt.select("band", "key", "label", "block", F.explode(others).alias("u")).select("band", "key", "label", "block", "u.i", "u.j")
    return units.join(texts.select("key", "shingles", "counts"), "key").groupBy("band", "i", "j").applyInArrow(_cross_links(threshold), "a binary, b binary").distinct()


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Exact similarity of candidate pairs ``a, b`` (keys): both sides' shingles come by equi-joins."""
    left = texts.select(F.col("key").alias("a"), F.col("shingles").alias("a_shingles"), F.col("counts").alias("a_counts"))
    right = texts.select(F.col("key").alias("b"), F.col("shingles").alias("b_shingles"), F.col("counts").alias("b_counts"))
    return pairs.join(left, "a").join(right, "b").transform(arrow_map, _verify, "a binary, b binary, sim double")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The class of every row: ``doc_id, class_id, class_size, class_texts, keep``.

    Rows whose texts have the same words, or a probability Jaccard similarity of ``threshold`` or more, are linked;
    ``class_id`` is the smallest doc_id of the linked rows, ``class_texts`` the number of different texts, ``keep``
    marks one row of each class.  A null, empty or blank text is a class of its own for each row; a text under five
    words matches equal words only; repeated rows are members each (one is kept, the others not); an empty table gives
    no rows; other columns are ignored.

    Equal texts are one row from the first shuffle on, so a large group of copies costs one text.  A text that has more
    than 1 - threshold of its weight for itself is left out, for its similarity to others can't reach it.  In each
    bucket all are compared with one leader, and what that leaves in several components with two drawn members; buckets
    that still hold several components are compared in full, between components, in blocks of bounded size.  So every
    two texts that meet in a band are compared or linked through others; no bucket is capped.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = key_type(docs, key)
    signed_rows = written(rows.transform(arrow_map, _banded, f"doc_id {kind}, key binary, n_words long, bands array<long>"), "nd-rows")
    some = signed_rows.where("n_words > 0")
    texts = written(some.groupBy("key").agg(F.first("bands").alias("bands"), F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")), "nd-texts")

    banded = texts.select("key", F.explode("bands").alias("band"))
    sizes = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    multi = written(banded.join(sizes.select("band"), "band"), "nd-buckets")
    keys = written(multi.select("key").distinct(), "nd-wanted")
    wanted = bloom.build(keys)
    found = docs.select(F.col(text).cast("string").alias("text")).transform(arrow_map, _with_shingles(wanted), "key binary, shingles binary, counts binary")
    found = found.join(keys, "key", "left_semi").groupBy("key").agg(F.first("shingles").alias("shingles"), F.first("counts").alias("counts"))
    found = written(found.withColumn("n_shingles", (F.octet_length("shingles") / 8).cast("long")), "nd-shingles")

    reach = 1 - threshold + 1e-9
    eligible = multi.join(own_share(found), "key", "left").select("band", "key", F.coalesce("own", F.lit(0.0)).alias("own")).where(F.col("own") <= reach)
    eligible = written(eligible, "nd-eligible")

    # the leader has little of its own, which other texts of its bucket resemble most; ties by a draw for each band
    draw = F.struct(F.round("own", 2).alias("own"), F.xxhash64("band", "key").alias("draw"), F.col("key").alias("key"))
    leaders = eligible.groupBy("band").agg(F.min(draw).alias("first"), F.count("*").alias("n")).where("n > 1")
    leaders = leaders.select("band", F.col("first.key").alias("lead"), "n")
    members = written(eligible.join(leaders, "band").where("key != lead").select("band", "key", "lead", "n"), "nd-members")
    pairs = written(members.select(F.col("key").alias("a"), F.col("lead").alias("b")).distinct(), "nd-pairs")
    links = written(verified(pairs, found).where(F.col("sim") >= threshold).select("a", "b"), "nd-links")
    labels = connected_components(links)

    def split_bands(rows: DataFrame) -> DataFrame:
        """Rows of bands with members of several components, as these stand now."""
        now = labels.select(F.col("node").alias("key"), "label")
        rows = rows.join(now, "key", "left").select("band", "key", F.coalesce("label", "key").alias("label"))
        several = rows.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi")
        return written(rows.join(several.select("band"), "band", "left_semi"), "nd-split")

    # two drawn members of each such band against those of other components, then whatever is left of other components
    split = split_bands(members.where("n > 2").select("band", "key"))
    draw = F.struct(F.xxhash64("band", "key").alias("draw"), F.col("key"), F.col("label"))
    drawn = split.groupBy("band").agg(F.min(draw).alias("x"), F.max(draw).alias("y")).select("band", F.explode(F.array("x", "y")).alias("z"))
    more = split.join(drawn, "band").where(F.col("label") != F.col("z.label"))
    more = written(more.select(F.least("key", "z.key").alias("a"), F.greatest("key", "z.key").alias("b")).distinct(), "nd-more")
    drawn_links = lambda: verified(more, found).where(F.col("sim") >= threshold).select("a", "b")
    rest_links = lambda: cross_links(split_bands(split.select("band", "key")), found, threshold)
    for step in (drawn_links, rest_links):
        extra = written(step(), "nd-extra")
        if not extra.isEmpty():
            links = written(links.unionByName(extra), "nd-links")
            labels = connected_components(links)

    owner = texts.join(labels.withColumnRenamed("node", "key"), "key", "left").select(
        "key", "doc_id", "copies", F.coalesce("label", "key").alias("label")
    )
    classes = owner.groupBy("label").agg(
        F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size"), F.count("*").alias("class_texts")
    )
    owner = owner.join(classes, "label").select("key", "class_id", "class_size", "class_texts", (F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("first_text"))
    return _one_kept(signed_rows.select("doc_id", "key", "n_words"), owner)


def _one_kept(rows: DataFrame, owner: DataFrame) -> DataFrame:
    """Joins classes to rows; of rows with the kept key and doc_id, the one with the smallest place is kept."""
    rows = written(rows.withColumn("place", F.monotonically_increasing_id()), "nd-places")
    blank = rows.where("n_words = 0").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"),
        F.lit(1).cast("long").alias("class_texts"), F.lit(True).alias("keep"),
    )
    full = rows.where("n_words > 0").join(owner, "key")
    lead = full.where(F.col("first_text") & F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("key").agg(F.min("place").alias("kept_place"))
    full = full.join(lead, "key", "left").select(
        "doc_id", "class_id", "class_size", "class_texts", F.coalesce(F.col("place") == F.col("kept_place"), F.lit(False)).alias("keep")
    )
    return full.unionByName(blank)


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The columns of ``docs`` for one row of each class; rows are named by ``key``, so rows of one key stay together."""
    classes = near_duplicates(docs, text, key, threshold).groupBy(F.col("doc_id").alias("gone")).agg(F.max("keep").alias("keep"))
    return without(docs, key, written(classes.where("not keep").select("gone"), "nd-gone"))
