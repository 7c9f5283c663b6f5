"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so that a re-parameterised question keeps its template.  Hashes of
template windows are joined with the benchmark's; along each alignment the placeholders' values must map one to one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm import bloom
from corpuslens.llm.common import Words, arrow_map, chunks, key_type, mix, ragged, signed, without, written

WINDOW = 5
#: Share of an item's tokens that matched windows must cover in a document, and places of the item that must hold plain words
#: on an alignment whose values differ: with fewer, one-to-one slots alone would make any list of amounts a copy.
MIN_COVERED, MIN_WORDS = 0.5, 3

#: Fixed values.
UNITS = (
    "mm", "cm", "m", "km", "in", "ft", "yd", "mi", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles",
    "meter", "meters", "metre", "metres", "kilometers", "kilometres", "mg", "g", "kg", "gram", "grams", "kilograms",
    "lb", "lbs", "pounds", "oz", "ounces", "ml", "l", "liter", "liters", "litre", "litres", "gallons", "s", "sec",
    "seconds", "second", "minute", "minutes", "min", "h", "hour", "hours", "day", "days", "week", "weeks", "month",
    "months", "year", "years", "dollars", "dollar", "euros", "euro", "cents", "percent", "degrees", "mph", "kph",
)

NUMBER, NAME, UNIT = (mix(np.array([i], np.uint64))[0] for i in (101, 102, 103))

_BREAK = np.ones(256, bool)
_BREAK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_ENDS = np.zeros(256, bool)
_ENDS[[0x2E, 0x21, 0x3F, 0x3A, 0x0A, 0x0D]] = True


def _unit_hashes() -> np.ndarray:
    column = pa.array(list(UNITS), pa.large_string())
    words = [Words(raw, off, _BREAK, _LOWER).hash for _, _, raw, off in chunks(column)]
    return np.sort(np.concatenate(words))


_UNITS = _unit_hashes()


def templates(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(template token, value, is placeholder, text) of a run of texts, runs of numbers and of names merged.

    A token is a run of letters and digits; a number starts with a digit; a name starts with a capital (A to Z, or À to Þ)
    and doesn't follow a sentence end or the text's start; a unit follows a number.  Values are hashes of the tokens as written.
    """
    words = Words(raw, off, _BREAK, _LOWER)
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.int64)
    lead = raw[words.start]
    new_doc = np.ones(n, bool)
    new_doc[1:] = words.doc[1:] != words.doc[:-1]
    ends = np.concatenate([[0], np.cumsum(_ENDS[raw])])
    prior = np.concatenate([[0], words.end[:-1]])
    opens = new_doc | (ends[words.start] > ends[prior])
    number = (lead >= 0x30) & (lead <= 0x39)
    second = raw[np.minimum(words.start + 1, len(raw) - 1)]
    accented = (lead == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
    name = (((lead >= 0x41) & (lead <= 0x5A)) | accented) & ~opens
    after = np.zeros(n, bool)
    after[1:] = number[:-1] & ~new_doc[1:]
    unit = after & np.isin(words.hash, _UNITS)
    token = words.hash.copy()
    token[number], token[name], token[unit] = NUMBER, NAME, UNIT
    # runs of one kind are one token
    merged = np.zeros(n, bool)
    merged[1:] = ((number[1:] & number[:-1]) | (name[1:] & name[:-1])) & ~new_doc[1:]
    first = np.flatnonzero(~merged)
    with np.errstate(over="ignore"):
        place = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
        value = np.add.reduceat(mix(words.hash + place.astype(np.uint64)), first)
    return token[first], value, (number | name | unit)[first], words.doc[first]


def _windows_of(size: int, known: np.ndarray | None):
    """Windows of each size up to ``size`` that the filter ``known`` lets through: (row, id, n, pos, hash, slots in order, places of plain words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, off in chunks(batch.column("text")):
                token, value, slot, doc = templates(raw, off)
                length = np.bincount(doc, minlength=hi - lo)
                start = np.concatenate([[0], np.cumsum(length)])[:-1]
                cum = np.concatenate([[0], np.cumsum(slot)])
                slot_value = value[slot]
                for w in range(1, size + 1):
                    m = len(token) - w + 1
                    if m <= 0:
                        continue
                    with np.errstate(over="ignore"):
                        h = np.full(m, np.uint64(w))
                        plain = np.zeros(m, np.int64)
                        for j in range(w):
                            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + token[j : m + j])
                            plain |= (~slot[j : m + j]).astype(np.int64) << j
                    at = np.flatnonzero(doc[:m] == doc[w - 1 :])
                    if known is None and w < size:  # the benchmark: a short item is one window
                        at = at[length[doc[at]] == w]
                    elif known is not None:
                        at = at[bloom.holds_long(known, h[at])]
                    if not len(at):
                        continue
                    owner = pa.array(doc[at] + lo)
                    sizes = cum[at + w] - cum[at]
                    flat = np.repeat(cum[at], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("row").take(owner),
                            batch.column("id").take(owner),
                            pa.array(length[doc[at]], pa.int64()),
                            pa.array(at - start[doc[at]], pa.int64()),
                            pa.array(np.full(len(at), w), pa.int32()),
                            pa.array(signed(h[at]), pa.int64()),
                            ragged(signed(slot_value[flat]), sizes, pa.int64()),
                            pa.array(plain[at], pa.int64()),
                        ],
                        ["row", "id", "n", "pos", "width", "hash", "slots", "plain"],
                    )

    return run


def _schema(kind: str) -> str:
    return f"row long, id {kind}, n long, pos long, width int, hash long, slots array<long>, plain long"


def _covered(positions: Column, width: Column) -> Column:
    following = F.concat(F.slice(positions, F.lit(2), F.greatest(F.size(positions) - 1, F.lit(0))), F.array(F.lit(1 << 40)))
    return F.aggregate(F.zip_with(positions, following, lambda a, b: F.least(b - a, width)), F.lit(0).cast("long"), lambda a, x: a + x)


def _words(pos: str, width: str, plain: str) -> Column:
    """Places of the item that hold plain words in a window."""
    bits = F.filter(F.sequence(F.lit(0), F.col(width) - 1), lambda j: F.getbit(F.col(plain), j) == 1)
    return F.transform(bits, lambda j: F.col(pos) + j)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    min_covered: float = MIN_COVERED,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """(document, benchmark item) pairs: ``row, doc_id, item_id, covered, item_tokens, verbatim``.

    A pair is listed if windows on alignments with consistent slots cover ``min_covered`` of the item's tokens; an alignment
    on which a slot value differs also needs plain words at ``min_words`` places of the item, however many slots it holds.
    ``verbatim`` says that no slot value differs.  Null and empty texts on either side match nothing; an item shorter
    than a window matches as a whole; repeated rows are listed each; an empty table gives no rows; other columns are
    ignored.

    Items are windowed once; a Bloom filter of their windows drops most others inside the scan, whatever the size of the
    benchmark, and the join on the window's hash drops the rest.
    """
    items = benchmark.select(F.col(item).alias("id"), F.col(item_text).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    items = written(items.transform(arrow_map, _windows_of(window, None), _schema(key_type(benchmark, item))), "bench-windows")
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    known = bloom.build_long(written(items.select("hash").distinct(), "bench-hashes"), "hash")
    hits = rows.transform(arrow_map, _windows_of(window, known), _schema(key_type(docs, key)))
    b = items.select(
        F.col("row").alias("item_row"), F.col("id").alias("item_id"), F.col("n").alias("item_tokens"),
        F.col("pos").alias("item_pos"), F.col("width").alias("item_width"), "hash", F.col("slots").alias("item_slots"), "plain",
    )
    pairs = hits.drop("plain").join(b, "hash").where("width = item_width").select(
        "row", F.col("id").alias("doc_id"), "item_row", "item_id", "item_tokens", "item_pos", "width", "plain",
        (F.col("pos") - F.col("item_pos")).alias("shift"),
        F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d")).alias("slots"),
    )
    # one alignment holds at most one window for each place of the item
    lines = pairs.groupBy("row", "doc_id", "item_row", "item_id", "item_tokens", "width", "shift").agg(
        F.collect_set("item_pos").alias("at"),
        F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots"),
        F.array_distinct(F.flatten(F.collect_set(_words("item_pos", "width", "plain")))).alias("words"),
    )
    values = lambda side: F.size(F.array_distinct(F.transform("slots", lambda x: x[side])))
    agrees = (values("i") == F.size("slots")) & (values("d") == F.size("slots"))
    told = F.size("words") >= min_words
    lines = lines.withColumn("same", F.forall("slots", lambda x: x["i"] == x["d"])).where(F.col("same") | (agrees & told))
    whole = lines.groupBy("row", "doc_id", "item_row", "item_id", "item_tokens", "width").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("at"), F.min("same").alias("verbatim")
    )
    whole = whole.withColumn("covered", _covered(F.col("at"), F.col("width").cast("long")))
    return whole.where(F.col("covered") >= min_covered * F.col("item_tokens")).select(
        "row", "doc_id", "item_id", "covered", "item_tokens", "verbatim"
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", **limits) -> DataFrame:
    """The columns of ``docs`` without the contaminated documents, by ``key``."""
    bad = contaminated(docs, benchmark, text, key, **limits).select(F.col("doc_id").alias("bad_id")).distinct()
    return without(docs, key, written(bad, "contaminated"))
