"""Release of texts, journals and leases, fits, matches, evidence over graphs and imports over the given tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from corpuslens.operators import contexts as C
from corpuslens.operators import evidence as V
from corpuslens.operators import fitting as T
from corpuslens.operators import networks as N
from corpuslens.operators import release as P
from corpuslens.operators.lineage import BROADCAST_ROWS, cut
from corpuslens.plans.catalog import query, table
from corpuslens.plans.statistics import _Z
from corpuslens.plans.tables import _GE, edges
from corpuslens.sources import importing as I
from corpuslens.streaming import journal as J
from corpuslens.streaming import quota as Q

# release of texts


@query("b9_sensitive_spans")
def b9_sensitive_spans(spark, d):
    return P.sensitive_spans(table(spark, d, "documents"))


def _policies(spark):
    policies = [("model_input", "redact", []), ("audit_export", "redact", [P.NATIVE]), ("external_provider", "redact", ["english"])]
    rules = [("model_input", "secret", "block", 0.9), ("audit_export", "ip_address", "allow", 0.0), ("external_provider", "email", "block", 0.5)]
    return (
        spark.createDataFrame(policies, "destination string, default_action string, required array<string>"),
        spark.createDataFrame(rules, "destination string, category string, action string, minimum double"),
    )


@query("b10_release")
def b10_release(spark, d):
    docs = table(spark, d, "documents")
    scans = docs.where("lang = 'en'").select("doc_id", F.lit("english").alias("detector"))  # a second detector, for one language
    got = P.release_texts(docs, P.sensitive_spans(docs), scans, *_policies(spark))
    return got.select("doc_id", "destination", "action", F.array_join("reasons", ",").alias("reasons"), "n_spans", F.sha2(F.col("released").cast("binary"), 256).alias("released_sha256"))


# quotas with leases: an event reserves its value; some are committed, released or renewed later

LIMITS = Q.Limits(requests=3, units=60.0, inflight=2, window=86400, lease=21600)

_LEASES = """e as (select user_id as owner, event_id::varchar as reservation, event_type, greatest(value, 0.01) as units, epoch(ts) as sec from events where value is not null),
  log as (select owner, reservation, 'reserve' as op, units, sec from e union all select owner, reservation, 'commit', units / 2, sec + 3600 from e where event_type = 'purchase'
    union all select owner, reservation, 'release', null, sec + 3600 from e where event_type = 'error' union all select owner, reservation, 'renew', null, sec + 18000 from e where event_type = 'click')"""


def leases(spark, d):
    """``owner, reservation, op, units, token, at``: what users reserve and what becomes of it."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = table(spark, d, "events").where("value is not null").select(
        F.col("user_id").alias("owner"), F.col("event_id").cast("string").alias("reservation"), "event_type", F.greatest("value", F.lit(0.01)).alias("units"), at.alias("at")
    )
    nothing = F.lit(None).cast("double")
    step = lambda op, units, token, late, kind=None: (e if kind is None else e.where(F.col("event_type") == kind)).select(
        "owner", "reservation", F.lit(op).alias("op"), units.alias("units"), F.lit(token).cast("long").alias("token"), (F.col("at") + late).alias("at"))
    units = F.col("units")
    return step("reserve", units, None, 0).unionByName(step("commit", units / 2, 1, 3600, "purchase")).unionByName(step("release", nothing, 1, 3600, "error")).unionByName(step("renew", nothing, 1, 18000, "click"))


@query("j2_quota_leases", f"""with {_LEASES}, m as (select distinct user_id as owner, epoch(ts) as now from events where event_type = 'signup'),
  r as (select m.owner, m.now, reservation, min(sec) filter (op = 'reserve') as began, max(units) filter (op = 'reserve') as units, max(units) filter (op = 'commit') as spent,
    max(sec) filter (op in ('reserve', 'renew')) as held, bool_or(op in ('commit', 'release')) as ended from m join log on m.owner = log.owner and sec <= now group by all),
  s as (select owner, now, floor(began / 86400) = floor(now / 86400) as here, not ended and held + 21600 > now as live, units, spent from r),
  t as (select owner, now, count(*) filter (here and spent is not null) as committed_requests, coalesce(sum(spent) filter (here), 0) as committed_units,
    count(*) filter (here and live) as reserved_requests, coalesce(sum(units) filter (here and live), 0) as reserved_units, count(*) filter (live) as inflight from s group by all)
  select m.owner, round(m.now, 3) as now, (floor(m.now / 86400) * 86400)::bigint as window_start, coalesce(committed_requests, 0) as committed_requests, round(coalesce(committed_units, 0), 6) as committed_units,
    coalesce(reserved_requests, 0) as reserved_requests, round(coalesce(reserved_units, 0), 6) as reserved_units, coalesce(inflight, 0) as inflight,
    greatest(3 - coalesce(committed_requests, 0) - coalesce(reserved_requests, 0), 0) as remaining_requests,
    round(greatest(60 - coalesce(committed_units, 0) - coalesce(reserved_units, 0), 0), 6) as remaining_units from m left join t using (owner, now)""")
def j2_quota_leases(spark, d):
    now = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    moments = table(spark, d, "events").where("event_type = 'signup'").select(F.col("user_id").alias("owner"), now.alias("now"))
    got = Q.lease_snapshot(leases(spark, d), moments, LIMITS)
    six = lambda c: F.round(c, 6).alias(c)
    return got.select("owner", F.round("now", 3).alias("now"), "window_start", "committed_requests", six("committed_units"), "reserved_requests", six("reserved_units"), "inflight", "remaining_requests", six("remaining_units"))


@query("j2_quota_admissions")
def j2_quota_admissions(spark, d):
    got = Q.admissions(leases(spark, d), LIMITS)
    return got.select("owner", "reservation", "op", F.round("at", 3).alias("at"), "status", "token", F.round("units", 6).alias("units"))


# journal of interleaved lists: a view shows four positions, the user's next click uses one of them


def shown(spark, d):
    """``impressions`` and ``outcomes`` of the journal, from views and clicks."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("experiment", F.col("user_id") % 20)
    sides = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.when(F.pmod(F.floor(F.col("event_id") / F.pow(F.lit(2), k)), F.lit(2)) == 1, "a").otherwise("b"))
    i = e.where("event_type = 'view'").select("experiment", F.col("event_id").alias("impression"), F.col("user_id").alias("query"), sides.alias("sides"), "ts")
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(before)
    o = e.withColumn("impression", last).where("event_type = 'click' and impression is not null")
    first = o.withColumn("n", F.row_number().over(Window.partitionBy("impression").orderBy("ts", "event_id"))).where("n = 1")
    return i, first.select("experiment", "impression", F.array((F.col("event_id") % 4).cast("int")).alias("engaged"), "ts")


@query("j17_interleaving_journal", f"""with e as (select *, user_id % 20 as experiment, last_value(case when event_type = 'view' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as seen from events),
  o as (select * from (select *, row_number() over (partition by seen order by ts, event_id) as n from e where event_type = 'click' and seen is not null) where n = 1),
  p as (select i.experiment, case (i.event_id // (2 ** (o.event_id % 4))::bigint) % 2 when 1 then 1 else -1 end as preference from e i join o on i.event_id = o.seen and i.experiment = o.experiment and i.event_type = 'view'
    and o.ts between i.ts and i.ts + interval 1 day),
  g as (select experiment, count(*) as impressions, count(*) filter (preference = 1) as wins_a, count(*) filter (preference = -1) as wins_b, count(*) filter (preference = 0) as ties from p group by 1),
  r as (select *, wins_a + wins_b as n, wins_a / (wins_a + wins_b) as rate from g)
  select experiment, impressions, wins_a, wins_b, ties, round(rate, 6) as rate, round((rate + {_Z}*{_Z}/(2*n)) / (1 + {_Z}*{_Z}/n) - {_Z} * sqrt(rate*(1-rate)/n + {_Z}*{_Z}/(4*n*n)) / (1 + {_Z}*{_Z}/n), 6) as low,
    round((rate + {_Z}*{_Z}/(2*n)) / (1 + {_Z}*{_Z}/n) + {_Z} * sqrt(rate*(1-rate)/n + {_Z}*{_Z}/(4*n*n)) / (1 + {_Z}*{_Z}/n), 6) as high from r""")
def j17_interleaving_journal(spark, d):
    got = J.experiment_results(J.export(J.complete_impressions(*shown(spark, d), "1 day")))
    return got.select("experiment", "impressions", "wins_a", "wins_b", "ties", *[F.round(c, 6).alias(c) for c in ("rate", "low", "high")])


# fits: what is learned from four fifths of the queries, documents or orders, judged on the rest


def _held(column):
    return F.crc32(column.cast("string").cast("binary")) % 5 == 0


def fused_rows(spark, d):
    """``query_id, doc_id, dense, lexical, grade, held``: probabilities by position in each list, grades 0 to 4 by the share of a query's words."""
    from corpuslens.functions.text import index_tokens
    from corpuslens.plans.retrieval import two_lists

    lists = two_lists(spark, d).groupBy("query_id", "doc_id").pivot("list", ["dense", "lexical"]).agg(F.min("position"))
    p = lambda c: F.coalesce(1 / (1.0 + F.col(c)), F.lit(0.02)).alias(c)
    words = lambda t, key, name: table(spark, d, t).select(F.col(key), F.array_distinct(index_tokens(F.col("text"))).alias(name))
    texts = lists.join(words("documents", "doc_id", "there"), "doc_id").join(words("benchmark", "item_id", "asked").withColumnRenamed("item_id", "query_id"), "query_id")
    grade = F.floor(4 * F.size(F.array_intersect("asked", "there")) / F.greatest(F.size("asked"), F.lit(1))).cast("double")
    return cut(texts.select("query_id", "doc_id", p("dense"), p("lexical"), grade.alias("grade"), _held(F.col("query_id")).alias("held")))


def _weights(spark, fit, names):
    rows = [(n, float(w), fit.best_epoch, float(fit.best_loss)) for n, w in zip(names, fit.weights)]
    return spark.createDataFrame(rows, "profile string, weight double, best_epoch int, held_loss double")


@query("h45_fusion_weights")
def h45_fusion_weights(spark, d):
    rows = fused_rows(spark, d).withColumn("relevant", F.col("grade") > 0)
    return _weights(spark, T.fusion_fit(rows, ["dense", "lexical"], "relevant", T.Settings(15, centred=True)), ["dense", "lexical"])


@query("h46_listwise_fusion")
def h46_listwise_fusion(spark, d):
    lists = cut(T.ranking_lists(fused_rows(spark, d), ["dense", "lexical"], "grade"))
    return _weights(spark, T.listwise_fit(lists, 2, T.Settings(15, centred=True)), ["dense", "lexical"])


LETTERS = list("aeionrstdlh")


def letter_rows(spark, d):
    """``doc_id, lang, held`` and the share of some letters in each document, times ten."""
    low, n = F.lower("text"), F.greatest(F.length("text"), F.lit(1))
    share = lambda c: (10.0 * (F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))) / n).alias(f"l_{c}")
    rows = table(spark, d, "documents").where("lang is not null").select("doc_id", "lang", _held(F.col("doc_id")).alias("held"), *[share(c) for c in LETTERS])
    return cut(rows)


@query("h47_domain_classifier")
def h47_domain_classifier(spark, d):
    rows = letter_rows(spark, d)
    labels = [r.lang for r in rows.select("lang").distinct().orderBy("lang").collect()]  # as many as languages
    features = [f"l_{c}" for c in LETTERS]
    fit = T.classifier_fit(rows, features, "lang", labels, T.Settings(15, 0.5, clip=None))
    judged = T.classified(rows, fit.theta, features, labels, "und", 0.3)
    right = F.avg((F.col("predicted") == F.col("lang")).cast("double"))
    return judged.groupBy("held", "lang").agg(F.count("*").alias("n"), right.alias("accuracy"), F.avg("confidence").alias("mean_confidence")).withColumn("best_epoch", F.lit(fit.best_epoch))


PLAN_FEATURES = ["d_quantity", "d_discount", "d_tax", "d_price"]


def plan_pairs(spark, d):
    """An order's first two lines: the one that shipped earlier is preferred."""
    li = table(spark, d, "lineitem").where("l_linenumber <= 2").select("l_orderkey", "l_linenumber", "l_shipdate", F.struct(
        (F.col("l_quantity") / 50).alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), (F.col("l_extendedprice") / 100000).alias("price")).alias("x"))
    pairs = li.groupBy("l_orderkey").agg(F.min_by("x", F.struct("l_shipdate", "l_linenumber")).alias("good"), F.max_by("x", F.struct("l_shipdate", "l_linenumber")).alias("bad"), F.count("*").alias("n"))
    columns = [(F.col(f"good.{c}") - F.col(f"bad.{c}")).alias(f"d_{c}") for c in ("quantity", "discount", "tax", "price")]
    return cut(pairs.where("n = 2").select("l_orderkey", _held(F.col("l_orderkey")).alias("held"), *columns))


@query("h65_plan_ranker")
def h65_plan_ranker(spark, d):
    fit = T.plan_ranker_fit(plan_pairs(spark, d), PLAN_FEATURES, T.Settings(15, 0.5, clip=None))
    rows = [(f, float(t), fit.best_epoch, float(fit.best_loss)) for f, t in zip(PLAN_FEATURES, fit.theta)]
    return spark.createDataFrame(rows, "feature string, weight double, best_epoch int, held_loss double")


# matches of claims: a document's lines are gold, its sentences are proposed


@F.pandas_udf(ArrayType(LongType()))
def _starts(lengths: pd.Series) -> pd.Series:
    """Where each of a row's parts of these lengths begins."""
    return lengths.map(lambda n: None if n is None else np.cumsum(n) - n)


def pieces(spark, d, separator, name):
    """Parts of each document between separators, with their place in it, as claims of three words or more."""
    parts = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "lang", F.split("text", separator).alias("claim"))
    starts = _starts(F.transform("claim", lambda x: (F.length(x) + len(separator.replace("\\", ""))).cast("long")))
    placed = parts.select("doc", "lang", F.posexplode(F.arrays_zip("claim", starts.alias("start"))).alias("n", "x")).select("doc", "lang", "n", "x.*")
    word, gap = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]"
    return placed.where(F.regexp_like(F.lower("claim"), F.lit(f"{word}{gap}(?s:.*?){word}{gap}(?s:.*?){word}"))).select(
        "doc", F.concat_ws(":", "doc", "n").alias(name), F.lit(0).alias("section"), "start", (F.col("start") + F.length("claim")).alias("end"), F.md5("claim").alias("evidence"), "claim",
        F.col("lang").alias("type"), F.when(F.length("claim") > 80, "long").otherwise("short").alias("modality"),
    )


@query("g35_claim_matches")
def g35_claim_matches(spark, d):
    gold, proposals = pieces(spark, d, "\n", "gold_id"), pieces(spark, d, "\\. ", "proposal_id")
    report = V.claim_report(gold, proposals, V.match_claims(gold, proposals))
    return report.select("doc", "n_gold", "n_proposals", "n_matched", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "mean_iou", "mean_token_f1", "type_accuracy", "modality_accuracy")])


# evidence over document graphs: lines are nodes, linked to their neighbours and to the first equal line of other documents


def line_graph(spark, d):
    """``nodes(doc, node, text)``, edges within and across documents."""
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("n", "text")).where(F.size(V.claim_tokens(F.col("text"))) >= 3)
    lines = cut(lines.withColumn("node", F.concat_ws(":", "doc", "n")))
    after = F.lead("node").over(Window.partitionBy("doc").orderBy("n"))
    pairs = lines.select("doc", F.col("node").alias("a"), after.alias("b")).where("b is not null")
    ends = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(0.9).alias("weight")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), F.lit(0.6).alias("weight"))))
    within = pairs.select(F.col("doc").alias("dst_doc"), ends.alias("e")).select("dst_doc", "e.*", F.concat_ws(">", "e.src", "e.dst").alias("edge"))
    first = lines.groupBy(F.md5("text").alias("h")).agg(F.min(F.struct("doc", "n", "node")).alias("first"))
    same = lines.withColumn("h", F.md5("text")).join(first, "h").where("doc <> first.doc")
    both = F.explode(F.array(F.struct(F.col("node").alias("src"), F.col("first.node").alias("dst"), F.col("first.doc").alias("dst_doc")), F.struct(F.col("first.node").alias("src"), F.col("node").alias("dst"), F.col("doc").alias("dst_doc"))))
    across = same.select(both.alias("e")).select("e.*", F.lit(0.9).alias("weight"), F.concat_ws("=", "e.src", "e.dst").alias("edge"))
    return lines, cut(within), cut(across)


#: Most meetings of a word of a line with a query that are counted at once.
PAIRS = 1 << 21


def line_hits(lines, queries):
    """``query, doc, node, score``: the share of a query's words that a line holds, of 0.1 or more.

    A line is shuffled with the numbers of its words that a query holds and counted in its row, so no row is made of a line
    and a query that share few words.
    """
    distinct = F.array_distinct(V.claim_tokens(F.col("text")))
    q = queries.select("query", F.size(distinct).alias("n"), F.explode(distinct).alias("w"))
    if q.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:  # too many to send to every task
        met = q.join(lines.select("doc", "node", F.explode(distinct).alias("w")), "w").groupBy("query", "n", "doc", "node").agg(F.count("*").alias("k"))
        return met.select("query", "doc", "node", (F.col("k") / F.col("n")).alias("score")).where("score >= 0.1")
    asked = q.groupBy("query", "n").agg(F.collect_list("w").alias("words")).collect()
    kind = queries.schema["query"].dataType
    number, shares = _shares([r.words for r in asked], [r.n for r in asked], 0.1)
    ids = lines.select("doc", "node", F.arrow_udf(number, "array<int>")(distinct).alias("ids")).where("size(ids) > 0")
    bags = ids.groupBy("doc", "node").agg(F.flatten(F.collect_list("ids")).alias("ids"))  # ids may repeat
    hits = bags.select("doc", "node", F.explode(F.arrow_udf(shares, "array<struct<form:int,score:double>>")("ids")).alias("x"))
    forms = lines.sparkSession.createDataFrame([(i, r.query) for i, r in enumerate(asked)], StructType([StructField("form", IntegerType()), StructField("query", kind)]))
    return hits.select("doc", "node", "x.*").join(F.broadcast(forms), "form").select("query", "doc", "node", "score")


def _shares(bags: list[list[str]], sizes: list[int], least: float):
    """Functions of Arrow arrays: lists of words as numbers of those that ``bags`` hold; from these ``form, score`` of the bags of which a list holds ``least``."""
    words = sorted({w for bag in bags for w in bag})
    place = {w: i for i, w in enumerate(words)}
    at = np.array([place[w] for bag in bags for w in bag], dtype=np.int64)
    form = np.repeat(np.arange(len(bags)), [len(bag) for bag in bags])[np.argsort(at, kind="stable")]
    n = np.bincount(at, minlength=len(words))
    first, size = np.cumsum(n) - n, np.array(sizes, dtype=np.int64)

    def number(lists: pa.Array) -> pa.Array:
        got = pc.index_in(lists.flatten(), pa.array(words, pa.string())).to_numpy(zero_copy_only=False)
        known = ~np.isnan(got) if got.dtype.kind == "f" else np.ones(len(got), bool)
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        ends = np.concatenate([[0], np.cumsum(known)])[np.concatenate([[0], np.cumsum(lengths)])]
        return pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(got[known].astype(np.int32)))

    def shares(lists: pa.Array) -> pa.Array:
        lengths, ids = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
        row = np.repeat(np.arange(len(lengths)), lengths)
        some, met = np.append(0, np.cumsum(n[ids])), []
        cuts = [0, *(np.flatnonzero(np.diff(some[:-1] // PAIRS)) + 1), len(ids)] if len(ids) else []
        cuts = sorted({int(np.searchsorted(row, row[c])) if 0 < c < len(ids) else int(c) for c in cuts})  # a row's words stay together
        for a, b in zip(cuts, cuts[1:]):
            m = n[ids[a:b]]
            take = np.repeat(first[ids[a:b]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            key, k = np.unique(np.repeat(row[a:b], m) * len(size) + form[take], return_counts=True)
            score = k / size[key % len(size)]
            met.append((key[score >= least], score[score >= least]))
        key, score = (np.concatenate(x) for x in zip(*met)) if met else (np.empty(0, np.int64), np.empty(0))
        ends = np.searchsorted(key, np.arange(len(lengths) + 1) * len(size))
        values = pa.StructArray.from_arrays([pa.array((key % max(1, len(size))).astype(np.int32)), pa.array(score)], ["form", "score"])
        return pa.ListArray.from_arrays(ends.astype(np.int32), values)

    return number, shares


@query("f13_graph_evidence")
def f13_graph_evidence(spark, d):
    lines, within, across = line_graph(spark, d)
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text")
    got = V.graph_set_evidence(line_hits(lines, queries), within, across, per_document=3, most_seeds=20, top=50)
    return got.select("query", "doc", "node", F.round("score", 6).alias("score"), "origin", "seed", F.array_join("lineage", " ").alias("lineage"), "position")


# adjustment sets: an order's lines are variables, an earlier one acts on a later one where their parts fit


def order_graphs(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    name = lambda c: F.concat(F.lit("v"), F.col(c)).alias("node")
    nodes = li.select(F.col("l_orderkey").alias("dag"), name("l_linenumber"), "l_linenumber", "l_partkey", "l_returnflag").distinct()
    a, b = nodes.select("dag", F.col("node").alias("src"), F.col("l_linenumber").alias("i"), F.col("l_partkey").alias("p")), nodes.select("dag", F.col("node").alias("dst"), F.col("l_linenumber").alias("j"), F.col("l_partkey").alias("q"))
    edges_ = a.join(b, "dag").where("i < j and (p + q) % 3 = 0").select("dag", "src", "dst").distinct()
    asked = nodes.groupBy("dag").agg(F.array_sort(F.collect_set(F.when((F.col("l_returnflag") == "A") & ~F.col("node").isin("v2", "v4"), F.col("node")))).alias("adjustment"))
    questions = asked.select(F.col("dag").alias("question"), "dag", F.lit("v2").alias("exposure"), F.lit("v4").alias("outcome"), "adjustment")
    return cut(nodes.select("dag", "node")), cut(edges_), questions


@query("f23_adjustment_sets")
def f23_adjustment_sets(spark, d):
    got = V.adjustment_sets(*order_graphs(spark, d))
    return got.select("question", "valid", "blocked", F.array_join("descendants", ",").alias("descendants"), F.array_join("unknown", ",").alias("unknown"))


# records along a network: what shipped upstream of a customer, shifted by the way to it


@query("f19_travel_time_records", f"""with {_GE}, t as (select src, dst, ((src + dst) % 7 + 1) * 86400.0::double as seconds from e), c as (select c_custkey + 9000000 as target from customer where c_custkey % 100 = 0),
  u1 as (select target, src as node, min(seconds) as seconds from c join t on dst = target group by 1, 2), u2 as (select target, t.src as node, min(u1.seconds + t.seconds) as seconds from u1 join t on t.dst = u1.node group by 1, 2),
  u as (select * from u1 union all select * from u2), r as (select l_partkey + 1000000 as node, epoch(l_shipdate) as sec from lineitem union all select l_suppkey, epoch(l_shipdate) + 86400 from lineitem),
  w as (select epoch(timestamp '1995-01-01') as a, epoch(timestamp '1995-02-01') as b)
  select target, count(*) as n_records, count(distinct u.node) as n_nodes, min(sec)::double as first_at, max(sec)::double as last_at, round(avg(seconds), 3) as mean_seconds from u join r on u.node = r.node, w where sec between a - seconds and b - seconds group by 1""")
def f19_travel_time_records(spark, d):
    e = cut(edges(spark, d).withColumn("seconds", ((F.col("src") + F.col("dst")) % 7 + 1) * 86400.0))
    targets = table(spark, d, "customer").where("c_custkey % 100 = 0").select((F.col("c_custkey") + 9000000).alias("target"))
    seconds = lambda c: (F.unix_micros(F.col(c).cast("timestamp")) / 1e6).alias("at")
    li = table(spark, d, "lineitem").withColumn("record", F.concat_ws(":", "l_orderkey", "l_linenumber"))
    records = li.select("record", (F.col("l_partkey") + 1000000).alias("node"), seconds("l_shipdate")).unionByName(li.select("record", F.col("l_suppkey").alias("node"), (seconds("l_shipdate") + 86400).alias("at")))
    windows = targets.select("target", F.lit(788918400.0).alias("start"), F.lit(791596800.0).alias("end"))
    found = V.shifted_records(V.travel_seconds(e, targets), windows, records, 30 * 86400.0)
    return found.groupBy("target").agg(F.count("*").alias("n_records"), F.count_distinct("node").alias("n_nodes"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.round(F.avg("seconds"), 3).alias("mean_seconds"))


# network meta-analysis: market segments of customers, compared within nations, pooled by region


def segment_contrasts(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    arms = cut(c.groupBy("n_regionkey", "c_nationkey", "c_mktsegment").agg(F.avg("c_acctbal").alias("m"), F.var_samp("c_acctbal").alias("v"), F.count("*").alias("n")).where("n > 1 and v > 0"))
    nxt = lambda c: F.lead(c).over(Window.partitionBy("c_nationkey").orderBy("c_mktsegment"))
    se = F.sqrt(F.col("v") / F.col("n") + nxt("v") / nxt("n"))
    return arms.select(F.col("n_regionkey").alias("network"), F.col("c_mktsegment").alias("a"), nxt("c_mktsegment").alias("b"), (nxt("m") - F.col("m")).alias("effect"), se.alias("se")).where("b is not null")


@query("h36_network_effects")
def h36_network_effects(spark, d):
    got = N.network_effects(segment_contrasts(spark, d))
    return got.select("network", "treatment", "connected", *[F.round(c, 6).alias(c) for c in ("estimate", "se", "low", "high", "residual_q")], "residual_df")


# imports: the given tables in raw layouts, read back

CORPUS = I.CorpusProfile("documents", ("$.doc.id", "$._id"), ("$.doc.body", "$.text"), ("$.doc.title",), ("$.meta.source", "$.source"), {"lang": ("$.meta.lang", "$.language"), "chars": ("$.n",)})


def raw_corpus(spark, d):
    """``json``: documents of English in a nested layout, all others in a flat one."""
    docs = table(spark, d, "documents")
    nested = F.to_json(F.struct(F.struct(F.col("doc_id").alias("id"), F.col("text").alias("body")).alias("doc"), F.struct("source", "lang").alias("meta"), F.col("n_chars").alias("n")))
    flat = F.to_json(F.struct(F.col("doc_id").cast("string").alias("_id"), "text", "source", F.col("lang").alias("language"), F.col("n_chars").alias("n")))
    return docs.select(F.when(F.col("lang") == "en", nested).otherwise(flat).alias("json"))


@query("a3_import_receipt", """select 'documents' as profile, count(*) as n, sum(('0x' || substr(sha256(doc_id::varchar), 1, 15))::hugeint)::varchar as ids_digest,
  (select count(distinct source) from documents) as n_groups, (select sum(('0x' || substr(sha256(source), 1, 15))::hugeint)::varchar from (select distinct source from documents where source is not null)) as groups_digest from documents""")
def a3_import_receipt(spark, d):
    return I.import_corpus(raw_corpus(spark, d), CORPUS)[1]


@query("a3_imported_corpus", "select doc_id::varchar as document_id, md5(text) as text_md5, null::varchar as title, source as source_group, lang, n_chars::varchar as chars, 'documents' as corpus_profile from documents")
def a3_imported_corpus(spark, d):
    rows = I.import_corpus(raw_corpus(spark, d), CORPUS)[0]
    about = lambda k: F.try_element_at("metadata", F.lit(k)).alias(k)
    return rows.select("document_id", F.md5("text").alias("text_md5"), "title", "source_group", about("lang"), about("chars"), about("corpus_profile"))


def raw_benchmarks(spark, d):
    """Turns of conversations as questions in five raw layouts: their answer is the next turn, their context the benchmark's items."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").withColumn("answer", F.lead("text").over(w)).where("role = 'user' and answer is not null")
    c = c.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.trim("text").alias("q"), F.trim("answer").alias("a"), F.concat(F.lit("t"), F.col("conv_id")).alias("t")).where("q <> '' and a <> ''")
    a = F.array
    s = F.struct
    col = F.col
    return {
        "hotpotqa": c.select(F.to_json(s(col("id").alias("_id"), col("q").alias("question"), col("a").alias("answer"), a(a(col("t"), F.lit("0"))).alias("supporting_facts"), a(a(col("t"), col("a"))).alias("context"))).alias("json")),
        "musique": c.select(F.to_json(s(col("id"), col("q").alias("question"), a(col("a")).alias("answers"), a(s(col("t").alias("title"), col("a").alias("paragraph_text"), F.lit(True).alias("is_supporting"))).alias("paragraphs"))).alias("json")),
        "qasper": c.select(F.to_json(s(s(col("q").alias("question"), col("id").alias("question_id"), s(col("a").alias("text")).alias("answers")).alias("question"), F.create_map(col("t"), a(col("a"))).alias("full_text"))).alias("json")),
        "scifact": c.select(F.to_json(s(col("id"), col("q").alias("claim"), col("a").alias("label"), F.create_map(col("t"), a(col("a"))).alias("evidence"))).alias("json")),
        "miracl": c.select(F.to_json(s(col("id").alias("query_id"), col("q").alias("query"), a(col("a")).alias("answers"), a(s(col("t").alias("docid"), col("a").alias("text"))).alias("positive_passages"), F.lit("en").alias("lang"))).alias("json")),
    }


@query("a5_adapted_benchmarks", """with c as (select conv_id || '-' || turn as id, trim(text) as q, trim(lead(text) over (partition by conv_id order by turn)) as a, 't' || conv_id as t, role from conversations),
  u as (select * from c where role = 'user' and a is not null and q <> '' and a <> '')
  select 'hotpotqa' as dataset, id, md5(q) as query_md5, md5(a) as answers_md5, t as relevant, md5(trim(t || chr(10) || a)) as contexts_md5, null::varchar as language from u union all
  select 'musique', id, md5(q), md5(a), t, md5(trim(t || chr(10) || a)), null from u union all select 'qasper', id, md5(q), md5(a), '', md5(trim(t || chr(10) || a)), null from u union all
  select 'scifact', id, md5(q), md5(a), t, md5(''), null from u union all select 'miracl', id, md5(q), md5(a), t, md5(a), 'en' from u""")
def a5_adapted_benchmarks(spark, d):
    each = [I.adapted(raw, name) for name, raw in raw_benchmarks(spark, d).items()]
    rows = each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3]).unionByName(each[4])
    about = lambda k: F.try_element_at("metadata", F.lit(k))
    joined = lambda c: F.array_join(c, "\n")
    return rows.select(
        about("dataset").alias("dataset"), "id", F.md5("query").alias("query_md5"), F.md5(joined("answers")).alias("answers_md5"), joined("relevant_ids").alias("relevant"), F.md5(joined("contexts")).alias("contexts_md5"),
        about("language").alias("language"),
    )


# what queries name: the first three words of benchmark items as aliases, looked for in all documents


def item_aliases(spark, d):
    three = F.regexp_extract("text", r"^\s*(\w+\W+\w+\W+\w+)", 1)
    rows = table(spark, d, "benchmark").select(three.alias("alias"), F.concat(F.lit("item-"), "item_id").alias("entity"), F.substring("text", 1, 40).alias("name"))
    return rows.where("alias <> ''")


@query("b16_named_entities")
def b16_named_entities(spark, d):
    return C.named_entities(table(spark, d, "documents"), item_aliases(spark, d), "doc_id").select("doc_id", "alias", "surface", "entity")


@query("b16_named_times")
def b16_named_times(spark, d):
    got = C.named_times(table(spark, d, "documents"), "doc_id")
    return got.groupBy("doc_id", "start_utc", "precision", "surface").agg(F.count("*").alias("n"))
