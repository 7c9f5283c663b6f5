"""Language identification with language-bitmask n-gram filters.

One Bloom filter holds the frequent n-grams of all languages: each slot is a bit mask of languages, so a look-up ANDs
the slots of an n-gram and gets every language that contains it.  Per-language counts over a text, corrected for the
filter's false positives, decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import arrow_map, chunks, key_type, mix, signed, written

UNKNOWN = "und"
N = 4
#: Documents a language whose n-grams are counted, those with the smallest hash of doc_id; a documented bound.
SAMPLE = 400
#: An n-gram belongs to a language if it occurs in this share of its sample, and in MIN_DOCS documents.
MIN_SHARE, MIN_DOCS = 0.01, 2
#: Slots a filter has for each n-gram of the language with most of them, and least slots.
PER_GRAM, LEAST_SLOTS, HASHES = 12, 1 << 16, 3
#: Languages of a mask word; a slot has as many words as all languages need.
WORD_LANGUAGES = 64
#: A text is rejected below this share of n-grams known to its language.
MIN_SCORE = 0.3

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_FOLD = np.where(_LETTER, np.arange(256), 0x20).astype(np.uint64)


@dataclass
class Filters:
    languages: list[str]
    slots: np.ndarray  #: (words, slots) masks, slots a power of two
    false_rate: np.ndarray  #: by language


def remainder(doc_id: Column) -> Column:
    """The fold of a row: crc32 of doc_id as text, mod 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def grams(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, text) of every run of N bytes of lower-case text with a letter; other bytes are spaces, as are borders."""
    n, size = len(off) - 1, np.diff(off)
    wide = np.full(len(raw) + n + 1, 0x20, np.uint64)
    owner = np.repeat(np.arange(n), size)
    wide[np.arange(len(raw)) + owner + 1] = _FOLD[raw]
    if len(wide) < N:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(wide) - N + 1
    g = wide[:m].copy()
    for j in range(1, N):
        g = (g << np.uint64(8)) | wide[j : m + j]
    begin = np.arange(n) + off[:-1]  # the space before each text
    doc = np.searchsorted(begin, np.arange(m), side="right") - 1
    inside = np.arange(m) + N <= (begin + size + 2)[doc]
    inside &= g != np.uint64(0x20202020)
    return g[inside], doc[inside]


def _slots(g: np.ndarray, slots: int) -> list[np.ndarray]:
    h = mix(g + np.uint64(1))
    return [((h >> np.uint64(20 * i)) % np.uint64(slots)).astype(np.int64) for i in range(HASHES)]


def _lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.fill_null("") if column.null_count else column)


def _distinct_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, raw, off in chunks(_lowered(batch.column("text"))):
            g, doc = grams(raw, off)
            pairs = np.unique(np.stack([doc.astype(np.uint64), g], axis=1), axis=0)
            langs = batch.column("lang").slice(lo, hi - lo).take(pa.array(pairs[:, 0].astype(np.int64)))
            yield pa.RecordBatch.from_arrays([langs, pa.array(signed(pairs[:, 1]), pa.int64())], ["lang", "gram"])


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Filters:
    """Filters from rows with a language and text whose fold is not 0.

    The sample is SAMPLE rows a language; n-grams are counted by Spark, and the frequent ones come to the driver, as many
    as that sample holds.  The filter is sized by the language with most n-grams.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("k")) != 0))
    draw = F.xxhash64("k")
    first = Window.partitionBy("lang").orderBy("draw")
    cut = rows.select("lang", draw.alias("draw")).withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= SAMPLE)
    cut = written(cut.groupBy("lang").agg(F.max("draw").alias("cut"), F.max("nth").alias("n")), "lang-cuts")
    picked = rows.join(cut, "lang").where(draw <= F.col("cut"))
    picked = picked.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(draw, "text"))).where(F.col("nth") <= SAMPLE)
    counted = picked.select("lang", "text").transform(arrow_map, _distinct_grams, "lang string, gram long").groupBy("lang", "gram").count()
    least = F.greatest(F.lit(MIN_DOCS), F.ceil(F.col("n") * MIN_SHARE))
    often = counted.join(cut.select("lang", "n"), "lang").where(F.col("count") >= least)
    table = often.select("lang", "gram").toArrow()
    languages = sorted(r.lang for r in cut.select("lang").collect())
    owner = pc.index_in(table["lang"], pa.array(languages, pa.string())).to_numpy()
    order = np.argsort(owner, kind="stable")
    g, bounds = table["gram"].to_numpy().view(np.uint64)[order], np.searchsorted(owner[order], np.arange(len(languages) + 1))
    size = max(LEAST_SLOTS, 1 << (int(np.diff(bounds).max(initial=1)) * PER_GRAM - 1).bit_length())
    slots = np.zeros((max(1, -(-len(languages) // WORD_LANGUAGES)), size), np.uint64)
    for i in range(len(languages)):
        for s in _slots(g[bounds[i] : bounds[i + 1]], size):
            slots[i // WORD_LANGUAGES, s] |= np.uint64(1) << np.uint64(i % WORD_LANGUAGES)
    fill = np.array([np.mean((slots[i // WORD_LANGUAGES] >> np.uint64(i % WORD_LANGUAGES)) & np.uint64(1)) for i in range(len(languages))])
    return Filters(languages, slots, fill**HASHES)


def _has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def _predict(filters: Filters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_lang = len(filters.languages)
        for batch in batches:
            for lo, hi, raw, off in chunks(_lowered(batch.column("text"))):
                g, doc = grams(raw, off)
                at = _slots(g, filters.slots.shape[1])
                total = np.bincount(doc, minlength=hi - lo)
                count = np.zeros((hi - lo, max(1, n_lang)))
                for i in range(n_lang):
                    if i % WORD_LANGUAGES == 0:
                        mask = np.full(len(g), ~np.uint64(0))
                        for s in at:
                            mask &= filters.slots[i // WORD_LANGUAGES, s]
                    got = np.bincount(doc[(mask >> np.uint64(i % WORD_LANGUAGES)) & np.uint64(1) == 1], minlength=hi - lo)
                    rate = filters.false_rate[i]
                    count[:, i] = np.clip((got - total * rate) / max(1e-9, 1 - rate), 0, None)
                best = count.argmax(axis=1)
                score = np.clip(count[np.arange(hi - lo), best] / np.maximum(total, 1), 0, 1)
                ascii_letter = np.bincount(np.repeat(np.arange(hi - lo), np.diff(off))[(raw >= 0x61) & (raw <= 0x7A)], minlength=hi - lo) > 0
                texts = batch.column("text").slice(lo, hi - lo)
                known = [n_lang > 0 and bool(a or _has_letter(texts[i].as_py())) for i, a in enumerate(ascii_letter)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row").slice(lo, hi - lo),
                        pa.array([filters.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], pa.string()),
                        pa.array(np.where(known, score, 0.0), pa.float64()),
                    ],
                    ["row", "lang_pred", "score"],
                )

    return run


def _predict_with_id(filters: Filters):
    run = _predict(filters)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in run(iter([batch.select(["row", "text"])])):
                ids = batch.column("doc_id").slice(at, part.num_rows)
                at += part.num_rows
                yield pa.RecordBatch.from_arrays([ids, part.column("lang_pred"), part.column("score")], ["doc_id", "lang_pred", "score"])

    return both


def identify(docs: DataFrame, filters: Filters | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row: a learned language, or ``und`` for a text without letters.

    The score is the share of the text's n-grams that its language contains, after correction; equal counts go to the
    first language by name.  A null text is ``und`` with score 0; so is every text if no language could be learned;
    repeated rows are judged each; an empty table gives no rows; other columns are ignored.  One pass, no shuffle; the
    filter sent to tasks has one bit a language in each slot.
    """
    filters = filters or train(docs, text=text, key=key)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("row", F.lit(0).cast("long"))
    out = rows.transform(arrow_map, _predict_with_id(filters), f"doc_id {key_type(docs, key)}, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, filters: Filters | None = None, text: str = "text", key: str = "doc_id", min_score: float = MIN_SCORE) -> DataFrame:
    """The columns of ``docs`` for rows with a known language and at least ``min_score``; one pass over whole rows."""
    filters = filters or train(docs, text=text, key=key)
    run = _predict(filters)
    columns, place = docs.columns, docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = batch.column(place)
            narrow = pa.RecordBatch.from_arrays([pa.array(np.zeros(batch.num_rows, np.int64)), body], ["row", "text"])
            good = [pc.and_(pc.not_equal(p.column("lang_pred"), UNKNOWN), pc.greater_equal(p.column("score"), min_score)) for p in run(iter([narrow]))]
            if good:
                yield batch.filter(pa.chunked_array(good).combine_chunks())

    return docs.transform(arrow_map, keep, docs.schema).select(*columns)
