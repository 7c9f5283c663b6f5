"""Entities and times that queries name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.text import replaced
from corpuslens.operators.lineage import small

#: Words for the join of aliases; dates and years in a query.  Fixed values.
WORD = r"(?U)(\w+)"
DATE = r"(?<!\d)\d{4}-\d{2}-\d{2}(?!\d)"
YEAR = r"(?<!\d)(1\d{3}|20\d{2}|2100)(?!\d)"
DAY = 86_400.0


def named_entities(queries: DataFrame, aliases: DataFrame, key: str = "query_id", text: str = "text") -> DataFrame:
    """``key, alias, surface, entity, name`` of each alias that a query holds as whole words, in any case, once an alias.

    ``aliases(alias, entity, name)`` meet the queries' runs of as many words by an equi-join, and the alias itself is then
    looked for between word borders; ``surface`` is its first place as the query writes it.  An alias without a word is
    refused.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(WORD), 1)
    a = aliases.select("alias", "entity", "name").where("alias is not null").withColumn("_w", words(F.trim("alias"))).withColumn("_n", F.size("_w"))
    run = F.when(F.col("_n") > 0, F.array_join("_w", "\x1f")).otherwise(F.raise_error(F.lit("an alias without a word")))
    a = a.select(F.trim("alias").alias("alias"), "entity", "name", "_n", run.alias("_run"))
    lengths = F.broadcast(a.select("_n").distinct().agg(F.array_sort(F.collect_set("_n")).alias("_sizes")))  # one row
    q = queries.select(key, F.trim(text).alias("_text"), words(F.col(text)).alias("_w")).join(lengths, F.lit(True))
    starts = lambda n: F.transform(F.sequence(F.lit(0), F.size("_w") - n), lambda i: F.array_join(F.slice("_w", i + 1, n), "\x1f"))
    runs = F.flatten(F.transform("_sizes", lambda n: F.when(F.size("_w") >= n, starts(n)).otherwise(F.array().cast("array<string>"))))
    met = q.select(key, "_text", F.explode(F.array_distinct(runs)).alias("_run")).join(small(a), "_run")
    quoted = F.regexp_replace("alias", r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    pattern = F.concat(F.lit(r"(?iU)(?<!\w)"), quoted, F.lit(r"(?!\w)"))
    found = met.withColumn("surface", F.regexp_substr("_text", pattern)).where("surface is not null")
    return found.select(key, "alias", "surface", "entity", "name").distinct()


def named_times(queries: DataFrame, key: str = "query_id", text: str = "text") -> DataFrame:
    """``key, start_utc, end_utc, precision, surface`` of the dates of a query and of the years outside of them, in seconds."""
    t = F.coalesce(F.col(text), F.lit(""))
    start = lambda x: F.unix_seconds(F.try_to_timestamp(x, F.lit("yyyy-MM-dd"))).cast("double")
    real = lambda x: F.try_to_timestamp(x, F.lit("yyyy-MM-dd")).isNotNull() & ~x.startswith("0000")
    days = F.filter(F.regexp_extract_all(t, F.lit(f"({DATE})"), 1), real)
    years = F.regexp_extract_all(replaced(t, DATE, "x", real), F.lit(YEAR), 1)
    of_year = lambda y: start(F.concat(y, F.lit("-01-01")))
    row = lambda a, b, kind, x: F.struct(a.alias("start_utc"), (b - 1e-6).alias("end_utc"), F.lit(kind).alias("precision"), x.alias("surface"))
    ranges = F.concat(
        F.transform(days, lambda x: row(start(x), start(x) + DAY, "day", x)),
        F.transform(years, lambda y: row(of_year(y), of_year((y.cast("int") + 1).cast("string")), "year", y)),
    )
    return queries.select(key, F.explode(ranges).alias("r")).select(key, "r.*")
