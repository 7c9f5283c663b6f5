"""Quality rules with cross-document line frequency.  DataFrame functions only.

Normalised lines are hashed, distinct documents are counted per host and line, lines above the host's limit are
removed, and documents that this depletes are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import WORD, small, without, written

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"

#: A line is over the limit of its host in more than MIN_DOCS documents and more than HOST_SHARE of the host's, and in more
#: than MOST_DOCS documents of a host of any size.
MIN_DOCS, HOST_SHARE, MOST_DOCS = 20, 0.002, 1000
#: A document is depleted if fewer than KEEP_SHARE of its words, or KEEP_WORDS words, are left.
KEEP_SHARE, KEEP_WORDS = 0.3, 50


def normalised_line(line: Column) -> Column:
    """Lower case, digits as 0, outer space dropped, inner space single."""
    spaced = F.regexp_replace(F.lower(line), SPACE + "+", " ")
    return F.regexp_replace(F.trim(spaced), "[0-9]+", "0")


def repeat_words(words: Column, size: int = 3) -> Column:
    """Words inside ``size``-word windows that occur twice or more in the array, the first occurrence included.

    Window hashes are sorted with their positions; equal neighbours mark positions; the union of the marked windows is
    a sum of capped gaps.  All steps are n log n in the number of words.
    """
    n = F.size(words)
    grams = F.arrays_zip(*[F.slice(words, F.lit(i + 1), F.greatest(n - (size - 1), F.lit(0))).alias(f"w{i}") for i in range(size)])
    return F.transform(grams, lambda x: F.xxhash64(*[x[f"w{i}"] for i in range(size)]))


def _covered(positions: Column, size: int) -> Column:
    """Number of places covered by windows of ``size`` that start at the given sorted positions."""
    following = F.concat(F.slice(positions, F.lit(2), F.greatest(F.size(positions) - 1, F.lit(0))), F.array(F.lit(1 << 30)))
    gaps = F.zip_with(positions, following, lambda a, b: F.least(b - a, F.lit(size)))
    return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)


def _marked(pairs: Column) -> Column:
    """Positions of hashes found twice or more, from sorted (hash, position) structs."""
    n = F.size(pairs)
    nothing = F.struct(F.lit(None).cast("long").alias("h"), F.lit(None).cast("int").alias("i"))
    before = F.concat(F.array(nothing), F.slice(pairs, F.lit(1), F.greatest(n - 1, F.lit(0))))
    after = F.concat(F.slice(pairs, F.lit(2), F.greatest(n - 1, F.lit(0))), F.array(nothing))
    near = F.filter(
        F.arrays_zip(pairs.alias("p"), before.alias("b"), after.alias("a")),
        lambda x: (x.p.h == x.b.h) | (x.p.h == x.a.h),
    )
    return F.array_sort(F.transform(near, lambda x: x.p.i))


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of each whole text.  No shuffle."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(WORD))
    step = docs.select(
        "*",
        body.alias("_body"),
        F.regexp_extract_all(body, F.lit(f"({WORD})"), 1).alias("_words"),
        lines.alias("_lines"),
    )
    step = step.select(
        *[c for c in step.columns if c not in ("_body", "_words", "_lines")],
        F.size("_words").cast("long").alias("n_words"),
        (F.length("_body") - F.regexp_count("_body", F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count("_body", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_words")).alias("_grams"),
    )
    pairs = F.sort_array(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct("_grams")) < F.size("_grams")
    step = step.withColumn("_pairs", F.when(repeats, pairs))
    covered = _covered(_marked(F.col("_pairs")), 3)
    return step.withColumn(
        "n_repeat_words", F.when(F.col("_pairs").isNull(), F.lit(0)).otherwise(covered).cast("long")
    ).drop("_grams", "_pairs")


def line_verdicts(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    key: str = "doc_id",
    min_docs: int = MIN_DOCS,
    host_share: float = HOST_SHARE,
    keep_share: float = KEEP_SHARE,
    keep_words: int = KEEP_WORDS,
    most_docs: int = MOST_DOCS,
) -> DataFrame:
    """Base counts and the verdict of every document.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines,
    removed_lines, removed_words``.  A null text counts as empty and fails the base rules; a null host is a host of its
    own; repeated rows are documents of their own; an empty table gives no rows; other columns are ignored.

    A line is one row (hash of host and line, words): the text is never shuffled.  Lines are distinct inside a
    document before the count, so the count needs no distinct, and counts are partially summed before the shuffle.
    """
    d = docs.select(
        F.col(key).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    lines = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1), lambda x: x.rlike(WORD))
    hashed = F.transform(
        lines,
        lambda x: F.struct(
            F.xxhash64(F.col("host"), normalised_line(x)).alias("h"),
            F.regexp_count(x, F.lit(WORD)).cast("int").alias("w"),
        ),
    )
    base = written(text_counts(d.withColumn("lines", hashed)).drop("text"), "line-rules")

    host_docs = base.groupBy("host").count()
    limits = host_docs.select(
        F.col("host").alias("l_host"), F.greatest(F.lit(float(min_docs)), F.least(F.col("count") * host_share, F.lit(float(most_docs)))).alias("most")
    )
    each = base.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x.h))).alias("h"))
    counts = each.groupBy("h").agg(F.count("*").alias("docs"), F.any_value("host").alias("host"))
    often = counts.where(F.col("docs") > min_docs)
    often = often.join(limits, often.host.eqNullSafe(limits.l_host)).where(F.col("docs") > F.col("most")).select("h")

    # the few lines over a limit go to the rows, so a line found everywhere is no hot key of a shuffle
    often = small(written(often, "line-often"))
    every = base.select("row", F.explode("lines").alias("x")).select("row", "x.h", "x.w")
    gone = every.join(often, "h").groupBy("row").agg(F.count("*").alias("lines_gone"), F.sum("w").alias("words_gone"))
    removed_words = F.coalesce("words_gone", F.lit(0)).cast("long")
    left = F.col("n_words") - removed_words
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = (left < keep_share * F.col("n_words")) | (left < keep_words)
    return base.join(gone, "row", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & ~depleted).alias("kept"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce("lines_gone", F.lit(0)).cast("long").alias("removed_lines"),
        removed_words.alias("removed_words"),
    )


def cleaned_documents(docs: DataFrame, text: str = "text", host: str = "source", key: str = "doc_id", **limits) -> DataFrame:
    """The columns of ``docs`` for the kept documents, by ``key``; see ``line_verdicts``."""
    verdicts = line_verdicts(docs, text, host, key, **limits).groupBy(F.col("doc_id").alias("gone_id")).agg(F.max("kept").alias("kept"))
    return without(docs, key, written(verdicts.where("not kept").select("gone_id"), "line-gone"))
