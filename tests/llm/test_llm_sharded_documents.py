"""Rows that keep their texts through the shard stage, and the pipeline's mixture against its plan."""

import collections
import re
import zlib

import pytest
from pyspark.sql import functions as F

from corpuslens.llm import mixing, sharding

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, slot int"


def rows():
    texts = ["", None, "ä" * 50, "one two", "x" * 400_000] + ["copy " * 20] * 40
    return [(i if i % 7 else None, t, "abc"[i % 3], i) for i, t in enumerate(texts)] + [(5, "same", "a", 1)] * 30


def check(got, source, shards):
    assert collections.Counter((r.doc_id, r.text, r.source, r.doc_slot) for r in got) == collections.Counter(source)
    assert all(r.size == len((r.text or "").encode()) + 1 and r.text_crc32 == (None if r.text is None else zlib.crc32(r.text.encode())) for r in got)
    places = collections.defaultdict(list)
    for r in got:
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and set(places) <= set(range(shards))


@pytest.mark.parametrize("part_bytes", [64, 1 << 27])
def test_rows_keep_their_texts(spark, tmp_path, monkeypatch, part_bytes):
    monkeypatch.setattr(sharding, "PART_BYTES", part_bytes)
    df = spark.createDataFrame(rows(), SCHEMA)
    check(sharding.sharded_documents(df, 4).collect(), rows(), 4)
    df.repartition(3).write.parquet(str(tmp_path / "docs"))
    read = spark.read.parquet(str(tmp_path / "docs"))
    out = sharding.sharded_documents(read, 4)
    check(out.collect(), rows(), 4)
    out.write.parquet(str(tmp_path / "out"))
    files = collections.defaultdict(list)
    for r in spark.read.parquet(str(tmp_path / "out")).select("shard", "slot", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i")).collect():
        files[r.f, r.shard].append((r.i, r.slot))
    assert sum(len(v) for v in files.values()) == len(rows())
    assert sharding.sharded_documents(read.limit(0), 4).count() == 0


def test_pipeline_keeps_the_mixture(spark):
    """What the last stage returns holds the texts of the mixture, by source as many words as the plan takes."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    done = corpus_pipeline.shard(spark, mixed, SF)
    words = collections.Counter()
    for r in done.select("source", "text").collect():
        words[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    plan = mixing.plan_mixture(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("n")).collect()
    assert dict(words) == {r.source: r.n for r in plan}
    assert set(docs.columns) < set(done.columns)
