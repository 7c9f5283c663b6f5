"""Whole forms of operators whose first query shows a part of them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuslens.operators import assess as A
from corpuslens.operators import calibration as B
from corpuslens.operators import evidence as V
from corpuslens.operators import gates as Q
from corpuslens.operators import graph as G
from corpuslens.operators import multihop as M
from corpuslens.operators import ranking as K
from corpuslens.operators import retrieval as R
from corpuslens.operators import series as T
from corpuslens.operators import statistics as S
from corpuslens.plans.catalog import query, table
from corpuslens.plans.evaluation import _RANKED, judged
from corpuslens.plans.retrieval import _INDEX, _QUERIES, _SEARCH, _queries
from corpuslens.plans.statistics import scored
from corpuslens.plans.tables import points

AS_OF = "timestamp '1997-01-01'"

_BELIEF_EVENTS = """ev as (select l_partkey as claim, l_orderkey || ':' || l_linenumber as evidence, l_suppkey as source, case when l_returnflag = 'R' then 'contradict' else 'support' end as stance, null as retracts, least(l_discount * 8, 1) as confidence, epoch(l_shipdate) as sec from lineitem
  union all select l_partkey, 'r' || l_orderkey || ':' || l_linenumber, l_suppkey, 'retract', l_orderkey || ':' || l_linenumber, 0, epoch(l_shipdate) + 7776000 from lineitem where l_quantity > 45)"""


@query("f24_revised_beliefs", f"""with {_BELIEF_EVENTS}, seen as (select * from ev where sec <= epoch({AS_OF})), act as (select * from seen a where stance <> 'retract' and not exists (select 1 from seen r where r.stance = 'retract' and r.claim = a.claim and r.retracts = a.evidence)),
  b as (select claim, source, stance, max(confidence * pow(0.5, (epoch({AS_OF}) - sec) / 31536000.0)) as w, count(*) as n from act group by all),
  g as (select claim, 1 - coalesce(product(1 - w) filter (stance = 'support'), 1) as s, 1 - coalesce(product(1 - w) filter (stance = 'contradict'), 1) as c, sum(n) as n from b group by 1),
  h as (select claim, coalesce(s, 0) as s, coalesce(c, 0) as c, coalesce(n, 0) as n from (select distinct claim from seen) left join g using (claim))
  select claim, case when s + c = 0 then 'unknown' when s > 0 and c > 0 and abs(s - c) <= 0.15 then 'conflicted' when s >= c then 'supported' else 'contradicted' end as status, round(s + 1e-9, 6) as support, round(c + 1e-9, 6) as contradiction,
    round(case when s + c > 0 then abs(s - c) / (s + c) else 0 end + 1e-9, 6) as confidence, n::bigint as n_active from h""")
def f24_revised_beliefs(spark, d):
    li = table(spark, d, "lineitem")
    at = F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 1e6
    name = F.concat_ws(":", "l_orderkey", "l_linenumber")
    row = lambda df, evidence, stance, retracts, confidence, at: df.select(F.col("l_partkey").alias("claim"), evidence.alias("evidence"), F.col("l_suppkey").alias("source"), stance.alias("stance"), retracts.alias("retracts"), confidence.alias("confidence"), at.alias("at"))
    said = row(li, name, F.when(F.col("l_returnflag") == "R", "contradict").otherwise("support"), F.lit(None).cast("string"), F.least(F.col("l_discount") * 8, F.lit(1.0)), at)
    back = row(li.where("l_quantity > 45"), F.concat(F.lit("r"), name), F.lit("retract"), name, F.lit(0.0), at + 7776000)
    got = G.revised_beliefs(said.unionByName(back), F.unix_seconds(F.expr(AS_OF)).cast("double"), 31536000.0)
    return got.select("claim", "status", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("support", "contradiction", "confidence")], "n_active")


@query("k4_hydrograph_deltas", """with s as (select user_id, event_id % 2 as side, epoch(ts) as t, value as v from events where value is not null),
  p as (select user_id, side, v as peak, t as peak_time from (select *, row_number() over (partition by user_id, side order by v desc, t) as r from s) where r = 1),
  i as (select user_id, side, coalesce(sum(x), 0) as volume from (select user_id, side, (v + lag(v) over w) / 2 * (t - lag(t) over w) as x from s window w as (partition by user_id, side order by t)) group by 1, 2), j as (select * from p join i using (user_id, side))
  select a.user_id, round(b.peak - a.peak, 6) as peak_delta, round(b.peak_time - a.peak_time, 3) as peak_time_delta, round((b.volume - a.volume) / 1000, 3) as volume_delta from j a join j b on a.user_id = b.user_id and a.side = 0 and b.side = 1""")
def k4_hydrograph_deltas(spark, d):
    side = lambda i: points(spark, d).where(F.col("event_id") % 2 == i)
    got = T.compared_hydrographs(side(0), side(1), ["user_id"], "t", "v")
    return got.select("user_id", F.round("peak_delta", 6).alias("peak_delta"), F.round("peak_time_delta", 3).alias("peak_time_delta"), F.round(F.col("volume_delta") / 1000, 3).alias("volume_delta"))


@query("g18_position_bias", f"""with {_RANKED}, m as (select position, avg(case when gain > 0 then 1.0 else 0.0 end) as score from ranked left join qrels using (query_id, doc_id) group by 1), l as (select list(score order by position) as s from m)
  select (select count(*) from m) as n_positions, round((select max(score) - min(score) from m), 6) as score_range, round((select (s[1] + s[-1]) / 2 - s[len(s) // 2 + 1] from l), 6) as edge_to_middle_gap, round((select regr_slope(score, position) from m), 6) as slope""")
def g18_position_bias(spark, d):
    j = judged(spark, d)
    means = j.groupBy("position").agg(F.avg(F.coalesce(F.col("gain") > 0, F.lit(False)).cast("double")).alias("score"))
    return A.position_report(means).select("n_positions", *[F.round(c, 6).alias(c) for c in ("score_range", "edge_to_middle_gap", "slope")])


def _psi_sql(name, kind):
    return f"""{name} as (select profile, sum((greatest(b, 1e-6) - greatest(a, 1e-6)) * ln(greatest(b, 1e-6) / greatest(a, 1e-6))) as psi from (select profile, kind, coalesce(n0, 0) / sum(n0) over (partition by profile) as a, coalesce(n1, 0) / sum(n1) over (partition by profile) as b from (
    select profile, {kind} as kind, count(*) filter (half = 0) as n0, count(*) filter (half = 1) as n1 from h group by 1, 2)) group by 1)"""


@query("h23_adaptation_reasons", f"""with h as (select user_id % 20 as profile, event_type, floor(value / 20) as bin, value, ts, (event_id * 2 >= (select max(event_id) from events))::int as half, (select max(ts) from events) as now from events where value is not null),
  {_psi_sql("a", "event_type")}, {_psi_sql("b", "bin")}, c as (select profile, avg(least(value / 100, 1)) filter (half = 0) - avg(least(value / 100, 1)) filter (half = 1) as score_drop, avg((ts < now - interval 25 day)::int) as stale_share, avg((event_type = 'error')::int) as failed_share from h group by 1),
  s as (select c.*, a.psi as query_psi, b.psi as language_psi, greatest(a.psi, b.psi) as psi from c join a using (profile) join b using (profile)),
  r as (select *, concat_ws(',', case when psi >= 0.2 then 'distribution_shift_critical' when psi >= 0.05 then 'distribution_shift_detected' end, case when score_drop >= 0.01 then 'retrieval_quality_dropped' end, case when stale_share >= 0.17 then 'stale_document_fraction_high' end, case when failed_share >= 0.22 then 'index_update_failures_high' end) as reasons from s)
  select profile, case when reasons = '' then 'stable' when psi >= 0.2 or failed_share >= 0.22 then 'urgent_rebuild' else 'shadow_rebuild' end as action, reasons, round(query_psi, 6) as query_psi, round(language_psi, 6) as language_psi, round(score_drop, 6) as score_drop, round(stale_share, 6) as stale_share from r""")
def h23_adaptation_reasons(spark, d):
    e = table(spark, d, "events").where("value is not null").withColumn("profile", F.col("user_id") % 20).withColumn("bin", F.floor(F.col("value") / 20))
    ends = table(spark, d, "events").agg(F.max("event_id").alias("last"), F.max("ts").alias("now"))
    h = e.crossJoin(F.broadcast(ends)).withColumn("half", (F.col("event_id") * 2 >= F.col("last")).cast("int"))  # one row
    half = lambda i, c=None: F.when(F.col("half") == i, 1 if c is None else c)

    def psi(kind, name):
        n = h.groupBy("profile", kind).agg(F.count(half(0)).alias("n0"), F.count(half(1)).alias("n1"))
        totals = n.groupBy("profile").agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"))
        shares = n.join(totals, "profile").withColumn("a", F.col("n0") / F.col("t0")).withColumn("b", F.col("n1") / F.col("t1"))
        return shares.groupBy("profile").agg(S.stability_index(F.col("a"), F.col("b")).alias(name))

    score = F.least(F.col("value") / 100, F.lit(1.0))
    rest = h.groupBy("profile").agg(
        (F.avg(half(0, score)) - F.avg(half(1, score))).alias("score_drop"), F.avg((F.col("ts") < F.col("now") - F.expr("interval 25 days")).cast("int")).alias("stale_share"),
        F.avg((F.col("event_type") == "error").cast("int")).alias("failed_share"),
    )
    snapshots = rest.join(psi("event_type", "query_psi"), "profile").join(psi("bin", "language_psi"), "profile")
    got = A.index_adaptation(snapshots, 0.05, 0.2, 0.01, 0.17, 0.22)
    return got.select("profile", "action", F.array_join("reasons", ",").alias("reasons"), *[F.round(c, 6).alias(c) for c in ("query_psi", "language_psi", "score_drop", "stale_share")])


# answers that need several documents: an order's lines are facts, or evidence for its priority

_MULTIHOP = r"""f as (select o_orderkey as ex, l_linenumber as fact, l_suppkey::varchar as doc, case when l_linenumber % 2 = 0 then l_linenumber::varchar end as loc from lineitem join orders on l_orderkey = o_orderkey where l_returnflag = 'R'),
  v as (select l_orderkey as ex, l_suppkey::varchar as doc, [l_linenumber::varchar, (l_linenumber + 1)::varchar] as locs, nullif(l_linenumber % 3, 0) as hop, case when l_discount > 0.02 then 1 end as source from lineitem where l_quantity > 15),
  u as (select distinct ex, doc, list_sort(locs) as locs from v), m as (select f.ex, fact, f.doc, locs from f join u on f.ex = u.ex and f.doc = u.doc where loc is null or list_contains(locs, loc)),
  nf as (select ex, count(distinct fact) as n, count(distinct doc) as nd from f group by 1), ng as (select ex, count(*) as n, count(distinct doc) as nd, count(distinct hop) as hops, count(*) filter (hop is not null and source is not null) as lin from v group by 1),
  nu as (select ex, count(*) as n from u group by 1), nm as (select ex, count(distinct fact) as matched, count(distinct (doc, locs)) as matching from m group by 1), sh as (select ex, count(distinct f.doc) as n from f join v using (ex, doc) group by 1),
  t as (select o_orderkey as ex, regexp_extract_all(lower(o_orderpriority), '[\p{L}\p{N}_]+') as a, regexp_extract_all(lower(case when o_custkey % 3 = 0 then o_orderpriority when o_custkey % 3 = 1 then o_orderstatus || ' ' || o_orderpriority else '' end), '[\p{L}\p{N}_]+') as b from orders),
  x as (select t.ex, (array_to_string(a, ' ') = array_to_string(b, ' '))::int::double as answer_exact, case when len(a) + len(b) = 0 then 1 else 2 * list_sum(list_transform(list_distinct(a), lambda w: least(len(list_filter(a, lambda y: y = w)), len(list_filter(b, lambda y: y = w))))) / (len(a) + len(b)) end as answer_f1,
    case when coalesce(ng.nd, 0) > 0 then coalesce(sh.n, 0) / ng.nd when coalesce(nf.nd, 0) = 0 then 1 else 0 end as dp, case when coalesce(nf.nd, 0) > 0 then coalesce(sh.n, 0) / nf.nd else 1 end as dr,
    case when coalesce(nu.n, 0) > 0 then coalesce(matching, 0) / nu.n when coalesce(nf.n, 0) = 0 then 1 else 0 end as sp, case when coalesce(nf.n, 0) > 0 then coalesce(matched, 0) / nf.n else 1 end as sr,
    (coalesce(matched, 0) = coalesce(nf.n, 0))::int::double as path_complete, least(coalesce(hops, 0) / 2, 1) as hop_coverage, case when coalesce(ng.n, 0) > 0 then lin / ng.n else 1 end as lineage_validity, coalesce(ng.n, 0)::double as n_evidence, (len(b) = 0)::int::double as abstained
    from t left join nf using (ex) left join ng using (ex) left join nu using (ex) left join nm using (ex) left join sh using (ex)),
  y as (select *, case when dp + dr > 0 then 2 * dp * dr / (dp + dr) else 0 end as df, case when sp + sr > 0 then 2 * sp * sr / (sp + sr) else 0 end as sf from x)"""


def _multihop(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    text = lambda c: F.col(c).cast("string")
    examples = o.select(F.col("o_orderkey").alias("example"), F.array("o_orderpriority").alias("answers"), F.lit(2).alias("required_hops"))
    facts = li.where("l_returnflag = 'R'").join(o.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").select(
        F.col("l_orderkey").alias("example"), F.col("l_linenumber").alias("fact"), text("l_suppkey").alias("doc"), F.when(F.col("l_linenumber") % 2 == 0, text("l_linenumber")).alias("locator"))
    said = F.when(F.col("o_custkey") % 3 == 0, F.col("o_orderpriority")).when(F.col("o_custkey") % 3 == 1, F.concat_ws(" ", "o_orderstatus", "o_orderpriority")).otherwise("")
    predictions = o.select(F.col("o_orderkey").alias("example"), said.alias("answer"), F.lit(False).alias("abstained"))
    evidence = li.where("l_quantity > 15").select(
        F.col("l_orderkey").alias("example"), F.lit("e").alias("evidence"), text("l_suppkey").alias("doc"), F.array(text("l_linenumber"), (F.col("l_linenumber") + 1).cast("string")).alias("locators"),
        F.nullif(F.col("l_linenumber") % 3, F.lit(0)).alias("hop"), F.when(F.col("l_discount") > 0.02, "s").alias("source"))
    return M.multihop_metrics(examples, facts, predictions, evidence)


_SIX = {"document_precision": "dp", "document_recall": "dr", "document_f1": "df", "support_precision": "sp", "support_recall": "sr", "support_f1": "sf", "answer_support": "answer_f1 * sr"}


@query("g10_multihop_metrics", f"with {_MULTIHOP} select ex as example, {', '.join(f'round({_SIX.get(m, m)} + 1e-9, 6) as {m}' for m in M.METRICS)} from y")
def g10_multihop_metrics(spark, d):
    return _multihop(spark, d).select("example", *[F.round(F.col(m) + 1e-9, 6).alias(m) for m in M.METRICS])


@query("g11_mean_multihop", f"with {_MULTIHOP} select count(*) as n_examples, {', '.join(f'round(avg({_SIX.get(m, m)}) + 1e-9, 6) as {m}' for m in M.METRICS)} from y")
def g11_mean_multihop(spark, d):
    return M.mean_multihop(_multihop(spark, d)).select("n_examples", *[F.round(F.col(m) + 1e-9, 6).alias(m) for m in M.METRICS])


# federated search: a region's suppliers are providers, their nations collections, parts by quantity the hits

_FEDERATED = """s as (select s_suppkey, n_regionkey as provider, n_nationkey as collection from supplier join nation on s_nationkey = n_nationkey), h as (select l_returnflag as request, provider, collection, l_partkey as item, min(l_linestatus) as modality, sum(l_quantity) as q from lineitem join s on l_suppkey = s_suppkey where collection % 7 <> 0 group by 1, 2, 3, 4),
  r as (select *, row_number() over (partition by request, provider, collection order by q desc, item) as rank from h)"""


def _federated(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_regionkey").alias("provider"), F.col("n_nationkey").alias("collection"))
    keys = ["request", "provider", "collection"]
    h = table(spark, d, "lineitem").join(s.where("collection % 7 <> 0"), "l_suppkey").groupBy(F.col("l_returnflag").alias("request"), "provider", "collection", F.col("l_partkey").alias("item")).agg(F.min("l_linestatus").alias("modality"), F.sum("l_quantity").alias("q"))
    hits = h.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("q"), "item"))).drop("q")
    places = s.select("provider", "collection").distinct()
    expected = places.join(F.broadcast(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("request")).distinct()), F.lit(True)).select(*keys)  # three flags
    weights = places.select("provider").distinct().where("provider % 2 = 0").withColumn("weight", 1 + F.col("provider") / 2)
    return K.federated_merge(hits, expected, weights, ("O",), most_per_provider=10, limit=40)


@query("c24_merged_lists", f"""with {_FEDERATED}, w as (select *, row_number() over (partition by request, provider, collection order by rank, item) as n from r where modality = 'O'), x as (select *, (case when provider % 2 = 0 then 1 + provider / 2 else 1 end) / (60 + rank) as score from w where n <= 10),
  b as (select *, row_number() over (partition by request, item order by score desc, provider, collection, rank, item) as m from x), p as (select *, row_number() over (partition by request order by score desc, provider, collection, rank, item) as position from b where m = 1)
  select request, item, provider, collection, round(score, 6) as score, position from p where position <= 40""")
def c24_merged_lists(spark, d):
    return _federated(spark, d)[0].withColumn("score", F.round("score", 6))


@query("c24_missing_collections", f"with {_FEDERATED} select q.request, e.provider, e.collection from (select distinct provider, collection from s) e cross join (select distinct l_returnflag as request from lineitem) q anti join r on r.request = q.request and r.provider = e.provider and r.collection = e.collection")
def c24_missing_collections(spark, d):
    return _federated(spark, d)[1]


@query("e18_source_trust_reasons", """with f as (select s_suppkey as source, least(greatest(s_acctbal / 10000.0, 0), 1) as p, avg(l_tax * 12) as m, avg((l_returnflag <> 'R')::int) as a, avg((l_shipdate >= timestamp '1996-01-01')::int) as fr, least(count(distinct l_partkey) / 700.0, 1) as r,
    case when s_suppkey % 17 = 0 then 'retracted' else 'active' end as status, s_nationkey % 2 = 0 as reviewed, s_nationkey % 3 > 0 as known from supplier join lineitem on s_suppkey = l_suppkey group by all),
  g as (select *, (0.3 * p + 0.25 * m + 0.2 * a + 0.1 * fr + 0.15 * r) as score from f)
  select source, round(score + 1e-9, 6) as score, status = 'active' and p >= 0.5 and reviewed and round(score, 9) >= 0.5 as eligible, coalesce(nullif(concat_ws(',', case when status = 'retracted' then 'blocked_status:retracted' end, case when p < 0.5 then 'weak_provenance_integrity' end,
    case when not reviewed then 'causal_claim_requires_reviewed_source' end, case when round(score, 9) < 0.5 then 'below_policy_score' end, case when not known then 'conflict_of_interest_status_unknown' end), ''), 'policy_eligible') as reasons from g""")
def e18_source_trust_reasons(spark, d):
    li, s = table(spark, d, "lineitem"), table(spark, d, "supplier")
    share = lambda c: F.avg(c.cast("int"))
    g = li.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.avg(F.col("l_tax") * 12).alias("methodology"), share(F.col("l_returnflag") != "R").alias("applicability"), share(F.col("l_shipdate") >= F.expr("timestamp '1996-01-01'")).alias("freshness"),
        F.least(F.count_distinct("l_partkey") / 700.0, F.lit(1.0)).alias("replication"),
    )
    rows = s.join(g, "s_suppkey").select(
        F.col("s_suppkey").alias("source"), F.least(F.greatest(F.col("s_acctbal") / 10000.0, F.lit(0.0)), F.lit(1.0)).alias("provenance"), "methodology", "applicability", "freshness", "replication",
        F.when(F.col("s_suppkey") % 17 == 0, "retracted").otherwise("active").alias("status"), (F.col("s_nationkey") % 2 == 0).alias("reviewed"), (F.col("s_nationkey") % 3 > 0).alias("conflicts_known"),
    )
    return A.source_trust(rows, causal=True).select("source", F.round(F.col("score") + 1e-9, 6).alias("score"), "eligible", F.array_join("reasons", ",").alias("reasons"))


def _metric_pairs(spark, d):
    li = table(spark, d, "lineitem")
    pair = lambda name, a, b: F.struct(F.lit(name).alias("metric"), F.avg(a).alias("baseline"), F.avg(b).alias("candidate"))
    both = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.array(pair("discount", "l_discount", "l_tax"), pair("speed", "l_quantity", F.col("l_extendedprice") / 1000)).alias("m"))
    pairs = both.select("id", F.explode("m").alias("m")).select("m.metric", "id", "m.baseline", "m.candidate")
    rules = spark.createDataFrame([("discount", True, 0.02, False), ("speed", False, 1.0, True)], "metric string, higher_is_better boolean, margin double, require_significance boolean")
    return pairs, rules


@query("h31_promotion")
def h31_promotion(spark, d):
    return M.promotion(*_metric_pairs(spark, d), 100, 100)


# calibrated profiles: types of events are profiles, of which errors score lower for better


@query("h11_isotonic_bins")
def h11_isotonic_bins(spark, d):
    got = B.isotonic_bins(_profile_examples(spark, d))
    return got.select("profile", "bin", F.round("upper", 6).alias("upper"), F.round("probability", 6).alias("probability"), F.round("weight", 6).alias("weight"), F.round("positive", 6).alias("positive"))


def _profile_examples(spark, d):
    return scored(spark, d).select(F.col("event_type").alias("profile"), F.col("value").alias("score"), (F.col("event_type") != "error").alias("higher_is_better"), (F.col("y") == 1).alias("relevant"), (1.0 + F.col("event_id") % 3).alias("weight"))


def _profile_lists(spark, d):
    e = table(spark, d, "events").where("value is not null")
    better = F.when(F.col("event_type") == "error", F.col("value")).otherwise(-F.col("value"))
    position = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(better, "event_id"))
    return e.select(F.col("user_id").alias("query"), F.col("event_type").alias("profile"), (F.col("event_id") % 40).alias("item"), F.col("value").alias("score"), (F.col("event_type") != "error").alias("higher_is_better"), position.alias("position"))


@query("e6_calibrated_profiles")
def e6_calibrated_profiles(spark, d):
    got = B.fused_profiles(_profile_lists(spark, d), B.isotonic_bins(_profile_examples(spark, d)), top=10)
    return got.withColumn("score", F.round("score", 6))


@query("e6_ranked_profiles", """with l as (select user_id as query, event_type as profile, event_id % 40 as item, row_number() over (partition by user_id, event_type order by case when event_type = 'error' then value else -value end, event_id) as position from events where value is not null),
  b as (select query, profile, item, min(position) as position from l group by all), g as (select query, item, sum(1.0 / (60 + position)) as score, count(*) as n_profiles from b group by 1, 2)
  select * from (select query, item, round(score, 6) as score, n_profiles, row_number() over (partition by query order by round(score, 9) desc, item) as position from g) where position <= 10""")
def e6_ranked_profiles(spark, d):
    return B.fused_profiles(_profile_lists(spark, d), top=10).withColumn("score", F.round("score", 6))


# searches for chunks and for both sides of a claim


@query("d18_chunk_search", f"with {_INDEX}, {_QUERIES}, qw as (select query_id, term, (1 + ln(qtf)) * idf as qw from q join idf using (term)), s as (select query_id, doc_id, sum(qw * weight) as score from qw join post using (term) group by 1, 2) select query_id, doc_id, round(score, 6) as score, position from (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as position from s) where position <= 3")
def d18_chunk_search(spark, d):
    return R.chunk_search(_queries(spark, d), table(spark, d, "documents")).withColumn("score", F.round("score", 6))


_BOTH = _SEARCH.replace("from benchmark", f"from (select item_id * 2 as item_id, text from benchmark union all select item_id * 2 + 1, '{R.COUNTER}' || text from benchmark)")


@query("c13_claim_evidence", f"with {_BOTH.rstrip().rstrip(',')} select query_id // 2 as claim_id, case query_id % 2 when 0 then 'support' else 'counter' end as side, doc_id, position, round(score, 6) as score from (select *, round(0.85 * cosine, 9) as score, row_number() over (partition by query_id order by round(0.85 * cosine, 9) desc, cosine desc, doc_id desc) as position from hits) where position <= 5")
def c13_claim_evidence(spark, d):
    claims = table(spark, d, "benchmark").select(F.col("item_id").alias("claim_id"), "text")
    return R.claim_evidence(claims, table(spark, d, "documents")).withColumn("score", F.round("score", 6))


@query("b38_plan_features", """with a as (select o_orderkey, least(o_totalprice / 300000, 1) as complexity, o_custkey % 2 = 0 as exact, o_custkey % 3 = 0 as method, case o_orderkey % 3 when 0 then 'dense' when 1 then 'corpus-sparse' else 'corpus-hybrid' end as mode, o_orderstatus = 'O' as mq, o_orderstatus = 'F' as hyde,
    case when o_orderpriority like '1%' then 'cross' else 'none' end as rr, o_totalprice / 2000 as cost from orders)
  select o_orderkey, 1.0::double as f_bias, round(complexity + 1e-9, 6) as f_complexity, round(least(cost / 100, 1) + 1e-9, 6) as f_cost, (mode = 'dense')::int::double as f_dense, (mode = 'corpus-sparse')::int::double as f_sparse, (mode = 'corpus-hybrid')::int::double as f_hybrid, mq::int::double as f_multi_query, hyde::int::double as f_hyde,
    (rr <> 'none')::int::double as f_reranker, (exact and mode = 'corpus-sparse')::int::double as f_exact_sparse_match, (complexity >= 0.45 and mode = 'corpus-hybrid')::int::double as f_complex_hybrid_match, (method and rr <> 'none')::int::double as f_method_rerank_match from a""")
def b38_plan_features(spark, d):
    k = F.col("o_orderkey") % 3
    a = table(spark, d, "orders").select(
        "o_orderkey", F.least(F.col("o_totalprice") / 300000, F.lit(1.0)).alias("complexity"), (F.col("o_custkey") % 2 == 0).alias("exact_identifier"), (F.col("o_custkey") % 3 == 0).alias("methodological"),
        F.when(k == 0, "dense").when(k == 1, "corpus-sparse").otherwise("corpus-hybrid").alias("mode"), (F.col("o_orderstatus") == "O").alias("multi_query"), (F.col("o_orderstatus") == "F").alias("hyde"),
        F.when(F.col("o_orderpriority").startswith("1"), "cross").otherwise("none").alias("reranker"), (F.col("o_totalprice") / 2000).alias("cost"),
    )
    got = A.plan_features(a)
    return got.select("o_orderkey", *[F.round(F.col(c) + 1e-9, 6).alias(c) if c in ("f_complexity", "f_cost") else F.col(c) for c in got.columns if c.startswith("f_")])


@query("c19_freeboard", """with p as (select n_name as river, l_returnflag as reach, l_partkey % 50 as station, avg(l_quantity) as water from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by 1, 2, 3),
  s as (select c_custkey as structure, n_name as river, case c_custkey % 3 when 0 then 'A' when 1 then 'N' else 'R' end as reach, c_custkey % 60 as station, c_acctbal / 200 as crest from customer join nation on c_nationkey = n_nationkey)
  select structure, round(crest, 6) as crest, round(water / 0.3048, 6) as water, round(crest - water / 0.3048, 6) as freeboard, crest - water / 0.3048 < 0 as overtopping from s left join p using (river, reach, station)""")
def c19_freeboard(spark, d):
    li, s, n, c = (table(spark, d, t) for t in ("lineitem", "supplier", "nation", "customer"))
    p = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    p = p.groupBy(F.upper("n_name").alias("river"), F.col("l_returnflag").alias("reach"), (F.col("l_partkey") % 50).alias("station")).agg(F.avg("l_quantity").alias("water"))
    k = F.col("c_custkey")
    reach = F.when(k % 3 == 0, "a").when(k % 3 == 1, "n").otherwise("r")
    st = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(k.alias("structure"), F.col("n_name").alias("river"), reach.alias("reach"), (k % 60).alias("station"), (F.col("c_acctbal") / 200).alias("crest"), F.lit("ft").alias("unit"), F.lit("d").alias("datum"))
    got = A.freeboard(st, p.withColumn("unit", F.lit("m")).withColumn("datum", F.lit("d")), {"m": 1.0, "ft": 0.3048})
    return got.select("structure", *[F.round(x, 6).alias(x) for x in ("crest", "water", "freeboard")], "overtopping")


_COUNTER = "c as (select s_suppkey as claim from supplier ), e as (select distinct l_suppkey as src, l_partkey + 1000000 as dst from lineitem where l_returnflag = 'R' and l_quantity > 40 union select distinct l_partkey + 1000000, l_suppkey from lineitem where l_returnflag = 'A' and l_quantity > 45)"


@query("f15_counter_evidence", f"""with {_COUNTER}, f1 as (select distinct claim, dst as node from c join e on claim = src), f2 as (select distinct claim, dst as node from f1 join e on node = src), b1 as (select distinct claim, src as node from c join e on claim = dst), b2 as (select distinct claim, src as node from b1 join e on node = dst),
  n as (select claim, 'node' as kind, node from (select * from f1 union select * from f2 union select * from b1 union select * from b2) where node <> claim), nr as (select claim, kind, node::varchar as item, null::varchar as root, row_number() over (partition by claim order by node) as position from n),
  v as (select l_suppkey as claim, 'evidence' as kind, l_orderkey || ':' || l_linenumber as item, l_partkey::varchar as root, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_partkey::varchar, l_orderkey || ':' || l_linenumber) as position from lineitem join c on l_suppkey = claim where l_discount > 0.08)
  select * from nr where position <= 10 union all select * from v where position <= 10""")
def f15_counter_evidence(spark, d):
    li = table(spark, d, "lineitem")
    part = F.col("l_partkey") + 1000000
    edge = lambda rows, a, b: rows.select(a.alias("src"), b.alias("dst"))
    e = edge(li.where("l_returnflag = 'R' and l_quantity > 40"), F.col("l_suppkey"), part).unionByName(edge(li.where("l_returnflag = 'A' and l_quantity > 45"), part, F.col("l_suppkey")))
    claims = table(spark, d, "supplier").select(F.col("s_suppkey").alias("claim"))
    evidence = li.where("l_discount > 0.08").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("item"), F.col("l_partkey").cast("string").alias("root"), F.col("l_extendedprice").alias("score"), F.array("l_suppkey").alias("contradicts"))
    return V.counter_evidence(claims, e, evidence)


# gates on fusion weights and paired runs

_LOGIT = "ln(least(greatest({0}, 1e-12), 1 - 1e-12) / (1 - least(greatest({0}, 1e-12), 1 - 1e-12)))"
_FUSED = f"1 / (1 + exp(-({{0}} * {_LOGIT.format('a')} + {{1}} * {_LOGIT.format('b')})))"
_LOSS = "-avg(y * ln(least(greatest({0}, 1e-12), 1 - 1e-12)) + (1 - y) * ln(1 - least(greatest({0}, 1e-12), 1 - 1e-12)))"


@query("c29_fusion_gate", f"""with r as (select 0.05 + 0.9 * (event_id % 97) / 96.0 as a, least(value / 100, 0.98) + 0.01 as b, (value > 20)::int::double as y from events where value is not null), p as (select y, {_FUSED.format(0.2, 0.8)} as l, {_FUSED.format(0.5, 0.5)} as u from r),
  g as (select count(*) as n, count(*) filter (y = 1) as n_positive, {_LOSS.format('l')} as learned_loss, {_LOSS.format('u')} as uniform_loss, avg(pow(l - y, 2)) as learned_brier, avg(pow(u - y, 2)) as uniform_brier from p)
  select n, n_positive, round(learned_loss, 6) as learned_loss, round(uniform_loss, 6) as uniform_loss, round(learned_brier, 6) as learned_brier, round(uniform_brier, 6) as uniform_brier,
    concat_ws(',', case when learned_brier > 0.25 then 'brier_threshold_exceeded' end, case when uniform_brier - learned_brier < 0 then 'insufficient_brier_improvement' end, case when n < 100 then 'insufficient_evaluation_examples' end, case when uniform_loss - learned_loss < 0 then 'insufficient_log_loss_improvement' end,
      case when n - n_positive < 10 then 'insufficient_negative_examples' end, case when n_positive < 10 then 'insufficient_positive_examples' end, case when learned_loss > 0.7 then 'log_loss_threshold_exceeded' end) as reasons from g""")
def c29_fusion_gate(spark, d):
    e = table(spark, d, "events").where("value is not null")
    rows = e.select((0.05 + 0.9 * (F.col("event_id") % 97) / 96.0).alias("a"), (F.least(F.col("value") / 100, F.lit(0.98)) + 0.01).alias("b"), (F.col("value") > 20).alias("y"))
    got = Q.qualify_fusion(rows, {"a": 0.2, "b": 0.8}, "y")
    return got.select("n", "n_positive", *[F.round(c, 6).alias(c) for c in ("learned_loss", "uniform_loss", "learned_brier", "uniform_brier")], F.array_join("reasons", ",").alias("reasons"))


@query("h48_listwise_gate", f"""with r as (select l_orderkey as q, l_linenumber * 1000000 + l_partkey as item, 0.05 + l_discount * 8 as a, 0.05 + l_tax * 10 as b, floor(l_quantity / 13) as g from lineitem),
  s as (select *, 0.75 * {_LOGIT.format('a')} + 0.25 * {_LOGIT.format('b')} as l, 0.5 * {_LOGIT.format('a')} + 0.5 * {_LOGIT.format('b')} as u from r),
  p as (select q, g, row_number() over (partition by q order by round(l, 9) desc, item) as nl, row_number() over (partition by q order by round(u, 9) desc, item) as nu, row_number() over (partition by q order by g desc, item) as ni from s),
  d as (select q, sum((pow(2, g) - 1) / log2(nl + 1)) filter (nl <= 5) as dl, sum((pow(2, g) - 1) / log2(nu + 1)) filter (nu <= 5) as du, sum((pow(2, g) - 1) / log2(ni + 1)) filter (ni <= 5) as di from p group by 1),
  m as (select count(*) as n_queries, avg(case when di > 0 then dl / di else 0 end) as x, avg(case when di > 0 then du / di else 0 end) as y, avg((di > 0 and dl / di < du / di - 1e-9)::int) as r from d)
  select n_queries, round(x, 6) as learned_ndcg, round(y, 6) as uniform_ndcg, round(r, 6) as regressed, concat_ws(',', case when x - y < 0 then 'insufficient_ndcg_gain' end, case when n_queries < 20 then 'insufficient_queries' end, case when r > 0.2 then 'too_many_regressed_queries' end) as reasons from m""")
def h48_listwise_gate(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("query"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("item"), (0.05 + F.col("l_discount") * 8).alias("a"), (0.05 + F.col("l_tax") * 10).alias("b"), F.floor(F.col("l_quantity") / 13).alias("g"))
    got = Q.qualify_listwise(rows, {"a": 0.75, "b": 0.25}, "g", k=5)
    return got.select("n_queries", *[F.round(c, 6).alias(c) for c in ("learned_ndcg", "uniform_ndcg", "regressed")], F.array_join("reasons", ",").alias("reasons"))


_RUNS = """r as (select l_linenumber as seed, l_returnflag <> 'R' as shadow, l_discount * 10 as recall, (l_quantity > 20)::int as support, (l_tax > 0.04)::int as abstention from lineitem),
  e as (select seed, shadow, unnest([{'metric': 'recall', 'v': recall}, {'metric': 'support', 'v': support}, {'metric': 'abstention', 'v': abstention}], recursive := true) from r),
  k as (select seed, metric, avg(v) filter (not shadow) as current, avg(v) filter (shadow) as shadow from e group by 1, 2),
  b as (select metric, avg(current) as current, avg(shadow) as shadow, avg(shadow - current) as delta, coalesce(stddev_samp(shadow - current), 0) as s, count(*) as n from k where current is not null and shadow is not null group by 1)"""


def _runs(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_linenumber").alias("seed"), F.when(F.col("l_returnflag") != "R", "shadow").otherwise("current").alias("side"), (F.col("l_discount") * 10).alias("recall"), (F.col("l_quantity") > 20).cast("int").alias("support"),
        (F.col("l_tax") > 0.04).cast("int").alias("abstention"))
    return Q.paired_benchmark(rows, ["recall", "support", "abstention"])


@query("h49_paired_benchmark", f"with {_RUNS} select metric, round(current, 6) as current, round(shadow, 6) as shadow, round(delta, 6) as delta, round(delta - 1.96 * s / sqrt(n), 6) as low, round(delta + 1.96 * s / sqrt(n), 6) as high, n as n_seeds from b")
def h49_paired_benchmark(spark, d):
    return _runs(spark, d).select("metric", *[F.round(c, 6).alias(c) for c in ("current", "shadow", "delta", "low", "high")], "n_seeds")


@query("h58_statistical_gate", f"""with {_RUNS}, l as (select metric, delta - 1.96 * s / sqrt(n) as low, n, case metric when 'recall' then 0.03 when 'support' then 0.002 else 0.02 end as margin, case metric when 'recall' then 0.01 end as gain from b),
  m as (select *, low >= -margin as ok, low >= gain as gained from l), q as (select string_agg(distinct x, ',' order by x) as reasons from (select unnest([case when not ok then 'paired_' || metric || '_noninferiority_failed' end, case when gained = false then 'paired_' || metric || '_practical_gain_failed' end, case when n < 3 then 'paired_seed_count_below_minimum' end]) as x from m) where x is not null)
  select metric, ok as noninferior, gained as practical, case when coalesce(reasons, '') <> '' then 'blocked' else 'passed' end as decision, coalesce(reasons, '') as reasons from m, q""")
def h58_statistical_gate(spark, d):
    got = Q.statistical_gate(_runs(spark, d), {"recall": 0.03, "support": 0.002, "abstention": 0.02}, {"recall": 0.01})
    return got.withColumn("reasons", F.array_join("reasons", ","))


@query("h62_metric_comparison")
def h62_metric_comparison(spark, d):
    pairs, _ = _metric_pairs(spark, d)
    return M.compare_metrics(pairs, spark.createDataFrame([("discount", True), ("speed", False)], "metric string, higher_is_better boolean"), 100, 100)
