"""Preparing documents: chunks and claims."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.text import content_id


def fixed_chunks(docs: DataFrame, size: int = 1000, overlap: int = 120, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, chunk_no, chunk, chunk_id``: overlapping pieces of ``size`` characters."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / F.lit(float(step))).cast("int"))
    rows = docs.where(F.col(text) != "").select(key, text, F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    rows = rows.withColumn("chunk", F.substring(F.col(text), F.col("chunk_no") * step + 1, F.lit(size)))
    return rows.select(key, "chunk_no", "chunk", content_id(F.col(key), F.col("chunk_no"), F.col("chunk")).alias("chunk_id"))


def atomic_claims(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Sentence claims with their ordinal and content id."""
    parts = F.transform(F.split(text, "[.!?]+"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    claims = rows.select(*keys, F.posexplode(F.filter(parts, lambda x: x != "")).alias("ordinal", "claim"))
    return claims.withColumn("claim_id", content_id(*[F.col(k) for k in keys], F.col("ordinal"), F.col("claim")))


def _packed(units: list[str], most: int) -> Iterator[str]:
    held = ""
    for unit in units:
        if held and len(held) + 1 + len(unit) > most:
            yield held
            held = ""
        while len(unit) > most:
            yield unit[:most]
            unit = unit[most:]
        held = f"{held} {unit}".strip() if held else unit
    if held:
        yield held


def semantic_chunks(docs: DataFrame, most: int = 1200, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, chunk_no, chunk``: paragraphs packed up to ``most`` characters; longer ones by words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                units = []
                for p in (body or "").split("\n"):
                    p = " ".join(p.split())
                    units += [p] if len(p) <= most else p.split(" ")
                chunks = list(_packed([u for u in units if u], most))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(chunks), pa.int64()), pa.array(range(len(chunks)), pa.int32()), pa.array(chunks, pa.string())],
                    ["doc_id", "chunk_no", "chunk"],
                )

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, chunk_no int, chunk string")


def seeded_order(rows: DataFrame, key: str, seed: int, epoch: int, ranges: int = 256) -> DataFrame:
    """``key, nth``: a repeatable random order of an epoch, from 1; a run resumes at any place in it.

    Draws fall into ``ranges`` ranges; counts of the ranges place each, and rows are ordered inside their range only.
    """
    draw = F.xxhash64(F.lit(seed), F.lit(epoch), F.col(key))
    drawn = rows.select(key, draw.alias("_draw"), F.pmod(F.shiftrightunsigned(draw, 32), F.lit(ranges)).cast("int").alias("_range"))
    counts = drawn.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # ranges rows
    place = F.row_number().over(Window.partitionBy("_range").orderBy("_draw", key))
    return drawn.withColumn("_place", place).join(F.broadcast(before), "_range").select(key, (F.col("_before") + F.col("_place")).alias("nth"))
