"""Personal data by bootstrapped contextual extraction.  DataFrame functions only.

Base patterns find e-mail addresses, IPv4 addresses, payment cards and phone numbers; long hexadecimal strings are weak
seeds of secrets.  Seed instances induce lexical patterns (the words around them, a name with ``=`` or ``:`` among them);
patterns and instances form a graph that is scored by turns; identifiers in the contexts of high-confidence patterns that
no base pattern covers are added.  A weak seed is added only where its context makes it one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import written

KINDS = ("email", "ip", "card", "phone")
#: Kinds that only the method adds, with the pattern of their weak seeds and the trust in one.
WEAK, WEAK_TRUST = {"secret": r"^[0-9a-f]{32,}$"}, 0.8
#: Prefix of the kinds that the method adds: ``ctx_email`` to ``ctx_phone`` and ``ctx_secret``, listed after the base ones.
ADDED = "ctx_"

# A match starts only where a run of its characters starts or the match before ends: the same leftmost matches as
# without, but no run is tried again at each of its characters.
_LOCAL = r"[A-Za-z0-9._%+-]"
_LABEL = r"[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What may be an identifier: a run of numbers joined by single spaces, or a token with a digit or an at sign.  Tokens end
#: at white space, quotes, brackets, ``=``, ``&``, ``#``, ``*`` and ``$``; a word that ends a candidate's start is looked past.
_EDGE = r"\x20\x09-\x0D\"'`<>=\[\]{}|&#*$"
CANDIDATE = (
    rf"(?<![^{_EDGE}])(?:[+(]?[0-9][0-9().-]*+(?:\x20[(]?[0-9][0-9().-]*+)++(?![^{_EDGE}.,;:!?%])|[^{_EDGE}0-9@]*+[0-9@][^{_EDGE}]*+)"
)
#: Characters of context on either side in which a pattern's words are sought.
CONTEXT = 48
ROUNDS = 3
BLOCK = 64
#: A pattern is trusted with this share of trusted instances and this many distinct ones; see ``score_graph``.
MIN_CONFIDENCE, MIN_INSTANCES, MIN_TRUST = 0.6, 3, 0.5


_SPAN = "array<struct<start:int,end:int,found:string,left:string,right:string>>"


def _spans(text: Column, pattern: str) -> Column:
    """Matches of a pattern as (start, end, found, left, right): code points, and the text up to CONTEXT on each side.

    Gaps and matches take turns, so starts are sums of lengths; the context ends at the next match on either side.
    """
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    gaps = F.split(text, pattern, -1)
    following = F.slice(gaps, F.lit(2), F.greatest(F.size(gaps) - 1, F.lit(0)))
    zipped = F.arrays_zip(gaps.alias("gap"), found.alias("found"), following.alias("after"))
    none = F.array().cast(_SPAN)

    def step(acc, x):
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["found"])
        one = F.struct(
            begin.alias("start"), end.alias("end"), x["found"].alias("found"),
            F.right(x["gap"], F.lit(CONTEXT)).alias("left"), F.left(x["after"], F.lit(CONTEXT)).alias("right"),
        )
        return F.when(
            x["found"].isNotNull(),
            F.struct(end.alias("at"), F.concat(acc["spans"], F.array(one)).alias("spans")),
        ).otherwise(acc)

    def block(acc, part):
        inner = F.aggregate(part, F.struct(acc["at"].alias("at"), none.alias("spans")), step)
        return F.struct(inner["at"].alias("at"), F.concat(acc["spans"], inner["spans"]).alias("spans"))

    def whole(z):
        # in blocks, for a fold copies all that it has gathered at each step
        starts = F.sequence(F.lit(1), F.greatest(F.size(z), F.lit(1)), F.lit(BLOCK))
        parts = F.transform(starts, lambda i: F.slice(z, i, F.lit(BLOCK)))
        return F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("spans")), block, lambda acc: acc["spans"])

    return F.element_at(F.transform(F.array(zipped), whole), 1)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10)))
    return F.aggregate(F.filter(places, lambda v: v.isNotNull()), F.lit(0).cast("long"), lambda a, v: a + v) % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(found, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))
    n = F.length(_digits(found))
    if kind == "card":
        return n.between(13, 19) & F.when(n.between(13, 19), luhn(_digits(found))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """Array of (start, end, found) of one kind; the cheap test spares most texts the search."""
    gate = {"email": text.contains("@"), "phone": text.contains("+"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")}[kind]
    none = F.array().cast(_SPAN)
    return F.when(gate, F.filter(_spans(text, PATTERNS[kind]), lambda s: _valid(kind, s["found"]))).otherwise(none)


def _word(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}=:]", "")


def contexts(left: Column, right: Column) -> Column:
    """The lexical patterns of one occurrence: two words before, and the words on both sides.

    A context without words on a side (text border, or another candidate) has no pattern there.
    """
    words = lambda x: F.filter(F.transform(F.split(F.trim(F.regexp_replace(F.regexp_replace(x, "([=:])", " $1 "), r"[\x20\x09-\x0D]+", " ")), " "), _word), lambda w: w != "")
    before, after = words(left), words(right)
    n = F.size(before)
    two = F.when(n >= 2, F.concat(F.lit("l2|"), F.concat_ws(" ", F.slice(before, F.greatest(n - 1, F.lit(1)), F.lit(2)))))
    both = F.when((n >= 1) & (F.size(after) >= 1), F.concat(F.lit("lr|"), F.element_at(before, -1), F.lit("|"), F.try_element_at(after, F.lit(1))))
    return F.array_compact(F.array(two, both))


def score_graph(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Confidence of patterns per kind from ``edges(pattern, instance, n)`` and ``seeds(instance, kind, trust)``.

    By turns: a pattern's confidence in a kind is the trust of its distinct instances of that kind over their number,
    drawn towards 0 by one pseudo-instance; an instance's trust is its best pattern's confidence, or that of a seed.
    Returns ``pattern, kind, confidence`` of patterns with at least MIN_INSTANCES distinct instances and
    MIN_CONFIDENCE.  Each turn is two joins and two partially aggregated sums; nothing is gathered per pattern.
    """
    totals = edges.groupBy("pattern").agg(F.count("*").alias("instances"))
    totals = written(totals.where(F.col("instances") >= MIN_INSTANCES), "pii-totals")
    edges = written(edges.join(totals, "pattern"), "pii-edges")
    trust = seeds.select("instance", "kind", "trust")
    for turn in range(rounds):
        scored = (
            edges.join(trust, "instance")
            .groupBy("pattern", "kind")
            .agg(F.sum("trust").alias("sum"), F.any_value("instances").alias("instances"))
            .select("pattern", "kind", (F.col("sum") / (F.col("instances") + 1)).alias("confidence"))
        )
        good = written(scored.where(F.col("confidence") >= MIN_CONFIDENCE), "pii-patterns")
        if turn + 1 < rounds:
            found = edges.join(good, "pattern").groupBy("instance", "kind").agg(F.max("confidence").alias("trust"))
            found = found.where(F.col("trust") >= MIN_TRUST).unionByName(seeds.select("instance", "kind", "trust"))
            trust = written(found.groupBy("instance", "kind").agg(F.max("trust").alias("trust")), "pii-trust")
    return good


def find_spans(docs: DataFrame, text: str = "text", key: str = "doc_id", row: str | None = None) -> DataFrame:
    """All personal data of every row: ``doc_id, row, base, added``, arrays of (kind, start, end).

    ``row`` names a column that numbers the rows; without one they are numbered here.

    A null text is empty; repeated rows are rows of their own; an empty table gives no rows; other columns are ignored.
    The text is scanned once and never shuffled; what follows runs on a table of spans, seeds and candidate tokens.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), (F.col(row) if row else F.monotonically_increasing_id()).alias("row"))
    seen = rows.select(
        "doc_id",
        "row",
        *[base_spans(F.col("text"), k).alias(k) for k in KINDS],
        F.when(F.col("text").rlike("[0-9@]"), _spans(F.col("text"), CANDIDATE)).alias("cand"),
    )

    def seeds_of(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(F.lit(kind).alias("kind"), *[s[c].alias(c) for c in ("start", "end", "found", "left", "right")]))

    seen = seen.select("doc_id", "row", F.concat(*[seeds_of(k) for k in KINDS]).alias("base"), "cand")
    # candidates that no base span touches, without closing punctuation
    free = F.filter("cand", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"])))
    seen = written(seen.withColumn("cand", F.when(F.size("cand") > 0, free)), "pii-spans")

    seed = seen.where(F.size("base") > 0).select("row", F.explode("base").alias("c")).select("row", "c.*")
    other = seen.where(F.size("cand") > 0).select("row", F.explode("cand").alias("c")).select("row", F.lit(None).cast("string").alias("kind"), "c.*")
    # without closing punctuation; an opening one isn't part of it either
    other = other.withColumn("found", F.regexp_replace("found", "[.,;:!?%]+$", ""))
    lead = F.length("found") - F.length(F.regexp_replace("found", r"^[^\p{L}\p{N}+(]+", ""))
    other = other.select("row", "kind", (F.col("start") + lead).alias("start"), (F.col("start") + F.length("found")).alias("end"), F.expr("substring(found, 1)").substr(lead + 1, F.length("found")).alias("found"), "left", "right")
    other = other.where("found != ''")
    occ = seed.unionByName(other).select(
        "row", "start", "end", "kind", F.lower("found").alias("instance"), F.explode(contexts(F.col("left"), F.col("right"))).alias("pattern")
    )
    occ = written(occ, "pii-occurrences")
    edges = occ.groupBy("pattern", "instance").agg(F.count("*").alias("n"))
    seeds = occ.where("kind is not null").select("instance", "kind", F.lit(1.0).alias("trust")).distinct()
    for kind, pattern in WEAK.items():
        weak = occ.where(F.col("kind").isNull() & F.col("instance").rlike(pattern)).select("instance", F.lit(kind).alias("kind"), F.lit(WEAK_TRUST).alias("trust"))
        seeds = seeds.unionByName(weak.distinct())
    good = score_graph(edges, seeds)

    new = occ.where("kind is null").join(good.withColumnRenamed("kind", "as_kind"), "pattern")
    new = new.groupBy("row", "start", "end").agg(F.max_by("as_kind", F.struct("confidence", "as_kind")).alias("as_kind"))
    new = new.groupBy("row").agg(  # the spans of one row
        F.collect_list(F.struct(F.concat(F.lit(ADDED), F.col("as_kind")).alias("kind"), "start", "end")).alias("added")
    )
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    base = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return seen.select("doc_id", "row", base.alias("base")).join(new, "row", "left").withColumn("added", F.coalesce("added", none))


def spans_digest(spans: Column) -> Column:
    """``kind:start:end`` by kind as listed, then start, comma-joined."""
    order = [*KINDS, *[ADDED + k for k in (*KINDS, *WEAK)]]
    rank = F.create_map(*[x for i, k in enumerate(order) for x in (F.lit(k), F.lit(i))])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(rank[s["kind"]].alias("r"), s["start"].alias("a"), s["end"].alias("b"), s["kind"].alias("k"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["k"], s["a"].cast("string"), s["b"].cast("string"))), ",")


def scan_documents(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Digest of ``find_spans``: counts by base kind, the hash of the base spans, and all spans."""
    found = find_spans(docs, text, key)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(spans_digest(F.col("base")), 256).alias("base_sha256"),
        spans_digest(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def masked_documents(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, text`` with each span replaced by its kind in angle brackets; overlapping spans are merged."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "pii-texts")  # numbered once, for the texts meet their spans again
    both = find_spans(rows, "text", "doc_id", "row").join(rows.select("row", "text"), "row")
    ordered = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), s["kind"].alias("k"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.substring(F.col("text"), acc["at"] + 1, F.greatest(s["a"] - acc["at"], F.lit(0)))
        tag = F.when(s["a"] >= acc["at"], F.concat(F.lit("<"), s["k"], F.lit(">"))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["b"]).alias("at"), F.concat(acc["out"], gap, tag).alias("out"))

    masked = F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return both.select("doc_id", masked.alias("text"))
