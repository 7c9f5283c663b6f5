"""Line deduplication with a log-template tree.

Lines are parsed by a tree of fixed depth: token count, then leading tokens.  In a leaf, a token is constant where
enough of the leaf's lines have it at its place, else a variable field.  Templates that recur across documents are
dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm import bloom
from corpuslens.llm.common import Words, arrow_map, chunks, key_type, mix, ragged, signed, small, written

#: Leading tokens of the tree.
DEPTH = 3
#: A template is dropped if it recurs in so many documents; lines under MIN_TOKENS tokens are left alone.
MIN_DOCS, MIN_TOKENS = 10, 3
#: A place is constant if MIN_DOCS lines have its token, and in a second template of the line also this share of the leaf's lines;
#: a template needs MIN_CONSTANT of its places constant.
MIN_SHARE, MIN_CONSTANT = 0.02, 0.6

_DIGITS = np.zeros(256, np.int64)
_DIGITS[0x30:0x3A] = 1
_VARIABLE = mix(np.array([7], np.uint64))[0]
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class Lines:
    """Lines of a run of texts with a word: text, number in the text, and masked tokens (a token with a digit varies)."""

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        words = Words(raw, off)
        breaks = np.concatenate([[0], np.cumsum(raw == 0x0A)])
        line = breaks[words.start]  # newlines so far: a word holds none
        digits = np.concatenate([[0], np.cumsum(_DIGITS[raw])])
        self.token = np.where(digits[words.end] > digits[words.start], _VARIABLE, words.hash)
        new = np.ones(len(words), bool)
        new[1:] = (line[1:] != line[:-1]) | (words.doc[1:] != words.doc[:-1])
        self.first = np.flatnonzero(new)
        self.size = np.diff(np.append(self.first, len(words)))
        self.doc = words.doc[self.first]
        self.number = line[self.first] - breaks[off[self.doc]]
        n = len(self.first)
        leaf = mix(self.size.astype(np.uint64) + np.uint64(1))
        with np.errstate(over="ignore"):
            for j in range(DEPTH):
                has = self.size > j
                at = np.where(has, self.first + j, 0)
                leaf = np.where(has, mix(leaf * _GOLD + self.token[at] if len(words) else leaf), leaf)
            place = np.arange(len(words)) - np.repeat(self.first, self.size)
            parts = mix(self.token + place.astype(np.uint64) * _GOLD)
            self.hash = mix(np.add.reduceat(parts, self.first) + leaf) if n else np.zeros(0, np.uint64)
        self.leaf = leaf
        self.bytes = words.end[self.first + self.size - 1] - words.start[self.first] if n else np.zeros(0, np.int64)


def _leaves(min_tokens: int):
    """Leaves of each text, once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, off in chunks(batch.column("text")):
                x = Lines(raw, off)
                long = x.size >= min_tokens
                pairs = np.unique(np.stack([x.doc[long].astype(np.uint64), x.leaf[long]], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(signed(pairs[:, 1]), pa.int64())], ["leaf"])

    return run


_NAMES = ["row", "doc_id", "number", "leaf", "line", "bytes", "tokens"]


def _lines_in(wanted: np.ndarray, min_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, raw, off in chunks(batch.column("text")):
                x = Lines(raw, off)
                n = len(off) - 1
                empty = pa.array(np.zeros(n, np.int64))
                lines = pa.array(np.bincount(x.doc, minlength=n).astype(np.int64))
                yield pa.RecordBatch.from_arrays(  # one row a text: number -1, and the lines with a word as bytes
                    [batch.column("row").slice(lo, n), batch.column("doc_id").slice(lo, n), pa.array(np.full(n, -1)), empty, empty, lines, ragged(np.zeros(0, np.int64), np.zeros(n, np.int64), pa.int64())],
                    _NAMES,
                )
                take = np.flatnonzero((x.size >= min_tokens) & bloom.holds_long(wanted, x.leaf))
                if not len(take):
                    continue
                size = x.size[take]
                flat = np.repeat(x.first[take] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row").take(pa.array(x.doc[take] + lo)),
                        batch.column("doc_id").take(pa.array(x.doc[take] + lo)),
                        pa.array(x.number[take], pa.int64()),
                        pa.array(signed(x.leaf[take]), pa.int64()),
                        pa.array(signed(x.hash[take]), pa.int64()),
                        pa.array(x.bytes[take], pa.int64()),
                        ragged(signed(x.token[flat]), size, pa.int64()),
                    ],
                    _NAMES,
                )

    return run


def line_templates(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``leaf, line, template`` of the distinct lines of ``lines(leaf, line, tokens)`` whose template is constant enough.

    A line has up to two templates: one whose constant tokens are found in ``min_docs`` lines, whatever the leaf's size,
    and one whose tokens also have MIN_SHARE of the leaf, in which frequent values of a field vary.  Equal lines are one
    row with a count before tokens are counted, so a line that fills the corpus costs one row.
    """
    distinct = written(lines.groupBy("leaf", "line").agg(F.first("tokens").alias("tokens"), F.count("*").alias("n")), "line-distinct")
    leaf_lines = distinct.groupBy("leaf").agg(F.sum("n").alias("leaf_n"))
    each = distinct.select("leaf", "line", "n", F.posexplode("tokens").alias("place", "token"))
    support = each.groupBy("leaf", "place", "token").agg(F.sum("n").alias("support")).where(F.col("support") >= min_docs)
    support = support.join(leaf_lines, "leaf").select("leaf", "place", "token", (F.col("support") >= MIN_SHARE * F.col("leaf_n")).alias("wide"))
    variable = int(_VARIABLE.view(np.int64))
    fixed = each.where(F.col("token") != variable).join(support, ["leaf", "place", "token"])
    place = F.struct("place", "token")
    fixed = fixed.groupBy("leaf", "line").agg(  # the places of one line
        F.array_sort(F.collect_list(place)).alias("fixed"), F.array_sort(F.collect_list(F.when(F.col("wide"), place))).alias("wide")
    )
    with_size = fixed.join(distinct.select("leaf", "line", F.size("tokens").alias("size")), ["leaf", "line"])
    both = with_size.select("leaf", "line", "size", F.explode(F.array_distinct(F.array("fixed", "wide"))).alias("fixed"))
    return both.where(F.size("fixed") >= MIN_CONSTANT * F.col("size")).select(
        "leaf", "line", F.xxhash64("leaf", "size", "fixed").alias("template")
    )


def recurring_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(rows, dropped): ``row, doc_id, n_lines`` of every row, and ``row, doc_id, number, template, bytes`` of each line to drop.

    ``number`` counts the lines of a text from 0, ``n_lines`` those with a word.  Rows are numbered in one scan whose result
    is written, so what is joined later agrees on them.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    often = rows.select("text").transform(arrow_map, _leaves(min_tokens), "leaf long").groupBy("leaf").count().where(F.col("count") >= min_docs)
    often = written(often.select("leaf"), "leaves")
    wanted = bloom.build_long(often, "leaf")
    schema = f"row long, doc_id {key_type(docs, key)}, number long, leaf long, line long, bytes long, tokens array<long>"
    every = written(rows.transform(arrow_map, _lines_in(wanted, min_tokens), schema), "leaf-lines")
    lines = every.where("number >= 0")
    parsed = written(line_templates(lines.join(often, "leaf", "left_semi"), min_docs), "line-templates")
    placed = lines.select("row", "leaf", "line").join(small(parsed), ["leaf", "line"])
    recur = written(placed.select("template", "row").distinct().groupBy("template").count().where(F.col("count") >= min_docs).select("template"), "line-recur")
    gone = written(parsed.join(small(recur), "template").groupBy("leaf", "line").agg(F.min("template").alias("template")), "line-gone")
    dropped = lines.join(small(gone), ["leaf", "line"]).select("row", "doc_id", "number", "template", "bytes")
    return every.where("number < 0").select("row", "doc_id", F.col("bytes").alias("n_lines")), dropped


def line_report(docs: DataFrame, text: str = "text", key: str = "doc_id", min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """``doc_id, n_lines, n_dropped, dropped, dropped_bytes`` of every row; ``dropped`` lists line numbers from 0.

    ``n_lines`` counts lines with a word.  A null text counts as empty; repeated rows count as documents each; lines
    under ``min_tokens`` tokens stay; an empty table gives no rows; other columns are ignored.
    """
    rows, dropped = recurring_lines(docs, text, key, min_docs, min_tokens)
    per_row = dropped.groupBy("row").agg(  # the lines of one text
        F.count("*").alias("n_dropped"), F.array_sort(F.collect_list("number")).alias("dropped"), F.sum("bytes").alias("dropped_bytes")
    )
    return rows.join(per_row, "row", "left").select(
        "doc_id", "n_lines",
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(F.array_join(F.col("dropped").cast("array<string>"), ","), F.lit("")).alias("dropped"),
        F.coalesce("dropped_bytes", F.lit(0)).cast("long").alias("dropped_bytes"),
    )


def cleaned_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """The columns of ``docs`` with the recurring lines taken out of the text; rows are named by ``key``."""
    _, dropped = recurring_lines(docs, text, key, min_docs, min_tokens)
    gone = dropped.groupBy(F.col("doc_id").alias("gone_id")).agg(F.collect_set("number").alias("gone_lines"))  # the lines of one key
    both = docs.join(gone, docs[key].eqNullSafe(gone.gone_id), "left")
    left = F.filter(F.split(docs[text], "\n", -1), lambda x, i: ~F.array_contains(gone["gone_lines"], i.cast("long")))
    body = F.when(gone["gone_lines"].isNull(), docs[text]).otherwise(F.array_join(left, "\n"))
    return both.select(*[body.alias(c) if c == text else docs[c] for c in docs.columns])
