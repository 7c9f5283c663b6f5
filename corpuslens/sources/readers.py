"""Readers and writers of corpora, judgements and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORPUS = T.StructType([T.StructField(c, T.StringType()) for c in ("_id", "title", "text")])
QUERIES = T.StructType([T.StructField(c, T.StringType()) for c in ("_id", "text")])


def _unique(df: DataFrame, key: str) -> DataFrame:
    again = df.groupBy(key).count().where("count > 1").limit(1).collect()
    if again:
        raise ValueError(f"{key} {again[0][0]!r} is given twice")
    return df


def retrieval_set(spark: SparkSession, root: str, split: str = "test") -> dict[str, DataFrame]:
    """``corpus``, ``queries`` and ``qrels`` from JSON lines and a tab-separated file; only scores above 0 stay."""
    corpus = _unique(spark.read.schema(CORPUS).json(f"{root}/corpus.jsonl"), "_id")
    title = F.coalesce("title", F.lit(""))
    text = F.when(title != "", F.concat(title, F.lit("\n\n"), F.coalesce("text", F.lit("")))).otherwise(F.coalesce("text", F.lit("")))
    queries = _unique(spark.read.schema(QUERIES).json(f"{root}/queries.jsonl"), "_id")
    qrels = spark.read.schema("query_id string, doc_id string, score double").csv(f"{root}/qrels/{split}.tsv", sep="\t", header=True)
    return {
        "corpus": corpus.select(F.col("_id").alias("doc_id"), text.alias("text")),
        "queries": queries.select(F.col("_id").alias("query_id"), "text"),
        "qrels": qrels.where("score > 0"),
    }


def judgements(spark: SparkSession, path: str, kind: str = "trec", least: float = 1.0) -> DataFrame:
    """``query_id, doc_id, relevance`` from TREC lines (3 or 4 columns), JSON lines or a JSON array."""
    if kind == "trec":
        parts = F.split(F.trim("value"), r"\s+")
        n = F.size("p")
        rows = spark.read.text(path).where(F.trim("value") != "").select(parts.alias("p")).where(n.isin(3, 4))
        rows = rows.select(F.col("p")[0].alias("query_id"), F.element_at("p", n - 1).alias("doc_id"), F.element_at("p", -1).cast("double").alias("relevance"))
    else:
        schema = "query_id string, doc_id string, relevance double"
        rows = spark.read.schema(schema).json(path, multiLine=kind == "array")
    return rows.where(F.col("relevance") >= least)


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``path, bytes, sha256`` of the files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_problems(found: DataFrame, stated: DataFrame) -> DataFrame:
    """Files that are missing, unlisted or differ: ``path, problem``."""
    j = stated.select("path", F.col("sha256").alias("want")).join(found.select("path", F.col("sha256").alias("got")), "path", "full_outer")
    problem = F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "unlisted").when(F.col("got") != F.col("want"), "differs")
    return j.select("path", problem.alias("problem")).where("problem is not null")


def write_generation(df: DataFrame, root: str, generation: int) -> None:
    """One generation as Parquet, and the pointer to it after it is complete."""
    df.write.mode("overwrite").parquet(f"{root}/generation={generation}")
    df.sparkSession.createDataFrame([(generation,)], "generation int").coalesce(1).write.mode("overwrite").parquet(f"{root}/current")


def read_current(spark: SparkSession, root: str) -> DataFrame:
    current = spark.read.parquet(f"{root}/current").first()[0]
    return spark.read.parquet(f"{root}/generation={current}")


def quarantined(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected lines) of JSON lines read with a declared schema."""
    parsed = F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = spark.read.text(path).where(F.trim("value") != "").select(parsed.alias("r"))
    return rows.where("r._bad is null").select("r.*").drop("_bad"), rows.where("r._bad is not null").select(F.col("r._bad").alias("line"))
