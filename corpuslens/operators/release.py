"""Sensitive spans of texts, and what may leave to which destination under a table of rules."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NATIVE = "native"
#: What the native detector looks for; fixed values.  A secret's span is its value, not its name.
EMAIL = re.compile(r"(?<![\w.+-])([A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,63})(?![\w.-])", re.I)
IPV4 = re.compile(r"(?<!\d)(?:\d{1,3}\.){3}\d{1,3}(?!\d)")
SECRET = re.compile(r"(?i)\b(api[_-]?key|secret|token|password|passwd|bearer)\b\s*[:=]\s*['\"]?([A-Za-z0-9_./+\-=]{8,})")
CARD = re.compile(r"(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)")
#: All categories that a rule may name; fixed values.
CATEGORIES = ("email", "phone", "address", "person_name", "government_id", "payment_card", "financial", "health", "secret", "ip_address", "custom_sensitive")
ACTIONS = ("allow", "redact", "block")


def luhn(number: str) -> bool:
    digits = [int(c) for c in number if c.isdigit()]
    if not 13 <= len(digits) <= 19 or len(set(digits)) == 1:
        return False
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0


def _is_address(text: str) -> bool:
    try:
        ipaddress.ip_address(text)
    except ValueError:
        return False
    return True


def text_spans(text: str) -> Iterator[tuple[int, int, str, float]]:
    """(start, end, category, confidence) in code points, end exclusive."""
    for pattern, group, category, confidence, holds in (
        (EMAIL, 1, "email", 0.99, None), (IPV4, 0, "ip_address", 0.95, _is_address), (SECRET, 2, "secret", 0.95, None), (CARD, 0, "payment_card", 0.99, luhn),
    ):
        for m in pattern.finditer(text):
            if holds is None or holds(m[group]):
                yield *m.span(group), category, confidence


def sensitive_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, start, end, category, confidence, detector`` of every span that the native detector finds; null texts have none."""

    def run(batches):
        for batch in batches:
            rows = [(i, *span) for i, t in enumerate(batch[1].to_pylist()) if t for span in text_spans(t)]
            columns = list(zip(*rows)) or [()] * 5
            at = pa.array(columns[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch[0].take(at), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.float64()), pa.array([NATIVE] * len(at))],
                names=[key, "start", "end", "category", "confidence", "detector"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, start long, end long, category string, confidence double, detector string")


def complete_rules(policies: DataFrame, rules: DataFrame) -> DataFrame:
    """``destination, category, action, minimum`` for all categories: those without a rule have their policy's default.

    Has at most destinations x categories rows.  A category with two rules for one destination is refused.
    """
    each = policies.select("destination", "default_action", F.explode(F.array(*map(F.lit, CATEGORIES))).alias("category"))
    named = rules.groupBy("destination", "category").agg(F.count("*").alias("_n"), F.first("action").alias("action"), F.first("minimum").alias("minimum"))
    one = F.when(F.coalesce(F.col("_n"), F.lit(1)) > 1, F.raise_error(F.lit("two rules for one category"))).otherwise(F.coalesce("action", "default_action"))
    return each.join(named, ["destination", "category"], "left").select("destination", "category", one.alias("action"), F.coalesce("minimum", F.lit(0.0)).alias("minimum"))


def redaction_segments(spans: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, start, end, label``: overlapping spans as one segment, named by its categories; spans that only touch stay apart."""
    by = Window.partitionBy(*keys).orderBy("start", "end", "category")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("_new", F.when(before.isNull() | (F.col("start") >= before), 1).otherwise(0)).withColumn("_island", F.sum("_new").over(by))
    label = F.concat(F.lit("[REDACTED:"), F.array_join(F.array_sort(F.collect_set("category")), "+"), F.lit("]"))
    return islands.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), label.alias("label")).drop("_island")


@F.pandas_udf(T.StringType())
def _rebuilt(text: pd.Series, segments: pd.Series) -> pd.Series:
    def one(t, found):
        if found is None or not len(found):
            return t
        parts, at = [], 0
        for s in found:
            parts += [t[at : s["start"]], s["label"]]
            at = s["end"]
        return "".join([*parts, t[at:]])

    return pd.Series([one(t, s) for t, s in zip(text, segments)], dtype=object)


def release_texts(docs: DataFrame, spans: DataFrame, scans: DataFrame, policies: DataFrame, rules: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, destination, action, reasons, n_spans, released`` of every text and destination.

    ``spans`` and ``scans(key, detector)`` hold what detectors found and which of them looked at a text;
    ``policies(destination, default_action, required)`` names the detectors that must have done so, and
    ``rules(destination, category, action, minimum)`` the action on a span of at least that confidence.  A missing
    detector or one blocking span blocks the text (``released`` is null); else spans to redact are merged and replaced;
    else the text leaves as it is.  Null texts count as empty.  Policies and rules are small by their meaning: they are
    joined by broadcast after ``complete_rules`` bounds them.
    """
    full = F.broadcast(complete_rules(policies, rules))
    acting = spans.join(full, "category").where("confidence >= minimum")
    blocks = acting.groupBy(key, "destination").agg(F.max((F.col("action") == "block").cast("int")).alias("blocks"), F.count("*").alias("n_spans"))
    pieces = redaction_segments(acting.where("action = 'redact'").select(key, "destination", "start", "end", "category"), [key, "destination"])
    pieces = pieces.groupBy(key, "destination").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("segments"))
    seen = scans.groupBy(key).agg(F.collect_set("detector").alias("detectors"))
    targets = F.broadcast(policies.select(F.collect_list(F.struct("destination", F.coalesce("required", F.array().cast("array<string>")).alias("required"))).over(Window.partitionBy()).alias("all")).limit(1))
    every = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text")).join(targets, F.lit(True)).select(key, "_text", F.explode("all").alias("p")).select(key, "_text", "p.*")
    joined = every.join(seen, key, "left").join(blocks, [key, "destination"], "left").join(pieces, [key, "destination"], "left")
    missing = F.size(F.array_except("required", F.array_append(F.coalesce("detectors", F.array().cast("array<string>")), F.lit(NATIVE)))) > 0
    blocked = F.coalesce(F.col("blocks") == 1, F.lit(False))
    cut = F.col("segments").isNotNull()
    reasons = F.array_compact(F.array(F.when(missing, "required_detector_attestation_missing"), F.when(blocked, "blocking_sensitive_category_detected"), F.when(~missing & ~blocked & cut, "sensitive_spans_redacted")))
    stop = missing | blocked
    return joined.select(
        key, "destination", F.when(stop, "block").when(cut, "redact").otherwise("allow").alias("action"), F.array_sort(reasons).alias("reasons"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.when(~stop, _rebuilt(F.col("_text"), F.col("segments"))).alias("released"),
    )
