"""Event streams: limits, quotas, objectives, first-event dedup and latest state, as batch twins and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def rolling_counts(events: DataFrame, key: str, seconds: int, limit: int) -> DataFrame:
    """Requests of a key in the last ``seconds`` at each event, and whether they are within the limit."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy(key).orderBy("_t").rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.withColumn("_t", t).withColumn("recent", F.count("*").over(w)).withColumn("allowed", F.col("recent") <= limit).drop("_t")


def tumbling_quota(events: DataFrame, key: str, window: str, limit: float, value: str = "value") -> DataFrame:
    """Units used and left by key and fixed window; also runs on a stream with a watermark."""
    g = events.groupBy(key, F.window("ts", window).alias("w")).agg(F.count("*").alias("requests"), F.sum(value).alias("units"))
    return g.select(key, F.col("w.start").alias("start"), "requests", "units", F.greatest(F.lit(0.0), limit - F.coalesce("units", F.lit(0.0))).alias("remaining"))


def first_events(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first event of each key; later ones with the same key are repeats."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def streamed(spark: SparkSession, path: str, schema, shape, watermark: str, out: str, checkpoint: str, mode: str = "append") -> None:
    """Runs ``shape`` over a Parquet directory as a stream until all is read, and writes Parquet.

    ``shape`` takes and returns a DataFrame; late rows beyond ``watermark`` of ``ts`` are dropped.
    """
    events = spark.readStream.schema(schema).parquet(path)
    events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    q = shape(events).writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def deduplicated_stream(events: DataFrame, keys: list[str]) -> DataFrame:
    """First event of each key within the watermark, with bounded state."""
    return events.dropDuplicatesWithinWatermark(keys)
