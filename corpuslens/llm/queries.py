"""The registered queries of this subpackage: one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import decontam, langid, line_rules, linetree, mixing, pii, probminhash, quality_crf, sharding, spelling, tokalign, urlgraph, warc
from corpuslens.llm.common import written

SHARDS = 8


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_records(_table(spark, sf_dir, "documents"), SHARDS)


def op2_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan_documents(_table(spark, sf_dir, "documents"))


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.line_verdicts(_table(spark, sf_dir, "documents"))


def op4_template_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return written(found.select("doc_id", "item_id", "covered", "item_tokens", "verbatim"), "contaminated")


def op5_bitmask_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(langid.identify(_table(spark, sf_dir, "documents")), "languages")


def op6_link_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlgraph.judge_urls(_table(spark, sf_dir, "pages"))


def op7_splitting_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mixture(_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "passes", F.array_join(F.col("out_shards").cast("array<string>"), ",").alias("out_shards"))


def op8_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return written(quality_crf.score_documents(docs, quality_crf.train(docs, _table(spark, sf_dir, "labels"))), "quality")


def op9_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = probminhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_size", "class_texts", "keep")


def op10_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linetree.line_report(_table(spark, sf_dir, "documents"))


def op11_content_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_report(_table(spark, sf_dir, "pages"))


def op12_spill_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokalign.align_documents(_table(spark, sf_dir, "documents"))


def op13_pivotal_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(_table(spark, sf_dir, "documents"), drop_every=199))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_virtual_slots": op1_virtual_slots,
        "op2_contextual_pii": op2_contextual_pii,
        "op3_line_frequency": op3_line_frequency,
        "op4_template_windows": op4_template_windows,
        "op5_bitmask_filters": op5_bitmask_filters,
        "op6_link_propagation": op6_link_propagation,
        "op7_splitting_tree": op7_splitting_tree,
        "op8_line_crf": op8_line_crf,
        "op9_probminhash": op9_probminhash,
        "op10_template_tree": op10_template_tree,
        "op11_content_archive": op11_content_archive,
        "op12_spill_counting": op12_spill_counting,
        "op13_pivotal_grams": op13_pivotal_grams,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {}
