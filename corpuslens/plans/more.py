"""Further rows: decisions, gates, summaries and views over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuslens.functions import text as X
from corpuslens.functions.numbers import UNITS
from corpuslens.functions.text import pseudonym
from corpuslens.operators import evaluation as E
from corpuslens.operators import governance as V
from corpuslens.operators import series as T
from corpuslens.operators import statistics as S
from corpuslens.plans.catalog import query, table
from corpuslens.plans.evaluation import _CLAIMS, _RANKED, claim_scores, judgements, ranked
from corpuslens.plans.scalars import FIELD_TOKENS_SQL
from corpuslens.plans.statistics import _V, scored
from corpuslens.plans.tables import _GE, _TS, edges, points


def n_of(c, name):
    return F.sum(c.cast("int")).alias(name)


@query("b18_script_shares", r"select doc_id, round(l / n, 6) as latin, round(k / n, 6) as cyrillic, (l / n >= 0.1)::int + (k / n >= 0.1)::int + (g / n >= 0.1)::int + (h / n >= 0.1)::int >= 2 as code_switched, l / n < 0.5 as non_latin from (select doc_id, len(regexp_extract_all(text, '\p{L}')) as n, len(regexp_extract_all(text, '\p{Latin}')) as l, len(regexp_extract_all(text, '\p{Cyrillic}')) as k, len(regexp_extract_all(text, '\p{Greek}')) as g, len(regexp_extract_all(text, '\p{Han}')) as h from documents) where n > 0")
def b18_script_shares(spark, d):
    c = lambda p: F.regexp_count("text", F.lit(p))
    docs = table(spark, d, "documents").select("doc_id", c(r"\p{L}").alias("n"), c(r"\p{IsLatin}").alias("l"), c(r"\p{IsCyrillic}").alias("k"), c(r"\p{IsGreek}").alias("g"), c(r"\p{IsHan}").alias("h")).where("n > 0")
    share = lambda x: F.col(x) / F.col("n")
    scripts = sum(((share(x) >= 0.1).cast("int") for x in "lkgh"), F.lit(0))
    return docs.select("doc_id", F.round(share("l"), 6).alias("latin"), F.round(share("k"), 6).alias("cyrillic"), (scripts >= 2).alias("code_switched"), (share("l") < 0.5).alias("non_latin"))


@query("b30_linear_classifier", f"with t as (select conv_id, turn, len({FIELD_TOKENS_SQL}) as n, length(text) as c from conversations), z as (select conv_id, turn, label, case label when 'short' then 2 - 0.05 * n when 'long' then 0.02 * n when 'dense' then 0.001 * c end as z from t, (values ('short'), ('long'), ('dense')) l(label)), p as (select *, exp(z) / sum(exp(z)) over (partition by conv_id, turn) as p from z) select conv_id, turn, case when p >= 0.4 then label else 'other' end as label, round(p, 6) as p from (select *, row_number() over (partition by conv_id, turn order by z desc, label) as r from p) where r = 1")
def b30_linear_classifier(spark, d):
    n, c = F.size(X.field_tokens(F.col("text"))), F.length("text")
    z = F.array(F.struct((2 - 0.05 * n).alias("z"), F.lit("short").alias("label")), F.struct((0.02 * n).alias("z"), F.lit("long").alias("label")), F.struct((0.001 * c).alias("z"), F.lit("dense").alias("label")))
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.explode(z).alias("s")).select("conv_id", "turn", "s.*")
    w = Window.partitionBy("conv_id", "turn")
    p = rows.withColumn("p", F.exp("z") / F.sum(F.exp("z")).over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("z"), "label"))).where("r = 1")
    return p.select("conv_id", "turn", F.when(F.col("p") >= 0.4, F.col("label")).otherwise("other").alias("label"), F.round("p", 6).alias("p"))


@query("b33_confidence_signals", f"with {_V} select event_id, round((0.5 * conf + coalesce(0.3 * case when event_id % 4 > 0 then y end, 0) + 0.2 * (w - 1) / 2) / (0.7 + case when event_id % 4 > 0 then 0.3 else 0 end), 6) as confidence from v")
def b33_confidence_signals(spark, d):
    third = F.when(F.col("event_id") % 4 > 0, F.col("y"))
    top = 0.5 * F.col("conf") + F.coalesce(0.3 * third, F.lit(0.0)) + 0.2 * (F.col("w") - 1) / 2
    return scored(spark, d).select("event_id", F.round(top / (0.7 + F.when(third.isNotNull(), 0.3).otherwise(0.0)), 6).alias("confidence"))


@query("b36_quantity_sum", "select p_partkey, round((p_size * 0.01 + p_retailprice * 0.001) / 0.01, 6) as total_cm, round(sqrt(pow(0.05 * p_size, 2) + pow(0.1 * p_retailprice * 0.01, 2)), 6) as uncertainty from part")
def b36_quantity_sum(spark, d):
    u = {name: scale for name, _, scale, _ in UNITS}
    total = (F.col("p_size") * u["cm"] + F.col("p_retailprice") * u["mm"]) / u["cm"]
    return table(spark, d, "part").select("p_partkey", F.round(total, 6).alias("total_cm"), F.round(F.sqrt(F.pow(0.05 * F.col("p_size"), 2) + F.pow(0.1 * F.col("p_retailprice") * 0.01, 2)), 6).alias("uncertainty"))


@query("e2_weighted_fusion", f"with {_V} select event_id, round((0.45 * least(greatest(conf, 0), 1) + coalesce(0.4 * case when event_id % 3 > 0 then least(value / 100, 1) end, 0)) / (0.45 + case when event_id % 3 > 0 then 0.4 else 0 end), 6) as score from v")
def e2_weighted_fusion(spark, d):
    has = F.col("event_id") % 3 > 0
    top = 0.45 * F.least(F.greatest(F.col("conf"), F.lit(0.0)), F.lit(1.0)) + F.coalesce(0.4 * F.when(has, F.least(F.col("value") / 100, F.lit(1.0))), F.lit(0.0))
    return scored(spark, d).select("event_id", F.round(top / (0.45 + F.when(has, 0.4).otherwise(0.0)), 6).alias("score"))


@query("e10_hierarchical_selection", "with s as (select l_orderkey as q, l_suppkey as doc, l_linenumber as chunk, l_partkey, l_discount * 10 as own, avg(l_discount * 10) over (partition by l_orderkey) as parent, avg(l_discount * 10) over (partition by l_orderkey, l_suppkey) as section, (coalesce(lag(l_discount * 10) over w, 0) + coalesce(lead(l_discount * 10) over w, 0)) / 2 as near from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey)), c as (select *, round(0.65 * own + 0.15 * parent + 0.1 * section + 0.1 * near, 9) as score from s), r as (select *, row_number() over (partition by q, doc order by score desc, chunk, l_partkey) as rd from c) select q, doc, chunk, round(score + 1e-9, 6) as score from (select *, row_number() over (partition by q order by score desc, chunk, doc, l_partkey) as rq from r where rd <= 1) where rq <= 3")
def e10_hierarchical_selection(spark, d):
    own = F.col("l_discount") * 10
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_suppkey").alias("doc"), F.col("l_linenumber").alias("chunk"), "l_partkey", own.alias("own"))
    s = s.withColumn("parent", F.avg("own").over(Window.partitionBy("q"))).withColumn("section", F.avg("own").over(Window.partitionBy("q", "doc")))
    w = Window.partitionBy("q").orderBy("chunk", "l_partkey", "doc")
    near = (F.coalesce(F.lag("own").over(w), F.lit(0.0)) + F.coalesce(F.lead("own").over(w), F.lit(0.0))) / 2
    s = s.withColumn("near", near).withColumn("score", F.round(0.65 * F.col("own") + 0.15 * F.col("parent") + 0.1 * F.col("section") + 0.1 * F.col("near"), 9))
    s = s.withColumn("rd", F.row_number().over(Window.partitionBy("q", "doc").orderBy(F.desc("score"), "chunk", "l_partkey"))).where("rd <= 1")
    s = s.withColumn("rq", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "chunk", "doc", "l_partkey"))).where("rq <= 3")
    return s.select("q", "doc", "chunk", F.round(F.col("score") + 1e-9, 6).alias("score"))


@query("e15_pareto_choice", "select lang, source, q, cost from (select *, row_number() over (partition by lang order by q desc, cost, source) as r from (select lang, source, count(*) as q, max(n_chars) as cost from documents where lang is not null group by 1, 2) where cost <= 40000) where r = 1")
def e15_pareto_choice(spark, d):
    g = table(spark, d, "documents").where("lang is not null").groupBy("lang", "source").agg(F.count("*").alias("q"), F.max("n_chars").alias("cost")).where("cost <= 40000")
    return V.latest(g, ["lang"], F.desc("q"), "cost", "source")


@query("e20_conformal_set", f"with {_V} select event_type, event_id, round(conf, 6) as conf from (select *, row_number() over (partition by event_type order by conf desc, event_id) as r from v where 1 - conf <= 0.4) where r <= 20")
def e20_conformal_set(spark, d):
    v = scored(spark, d).where(1 - F.col("conf") <= 0.4).withColumn("r", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("conf"), "event_id")))
    return v.where("r <= 20").select("event_type", "event_id", F.round("conf", 6).alias("conf"))


@query("f8_filtered_graph", f"with {_GE}, bad as (select s_suppkey as node from supplier where s_acctbal < 0) select count(*) as n_edges, count(distinct src) as n_src from e where src not in (select node from bad) and dst not in (select node from bad)")
def f8_filtered_graph(spark, d):
    bad = table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("node"))
    e = edges(spark, d)
    kept = e.join(bad, e.src == bad.node, "left_anti").join(bad, F.col("dst") == bad.node, "left_anti")
    return kept.agg(F.count("*").alias("n_edges"), F.countDistinct("src").alias("n_src"))


@query("f25_status_replay", "with a as (select o_orderkey, m, case when o_orderdate > timestamp '1995-01-01' + to_days(m * 365) then 'future' when o_orderdate + interval 700 day <= timestamp '1995-01-01' + to_days(m * 365) then 'expired' else 'active' end as status from orders, range(0, 3) r(m)) select m, status, count(*) as n, count(*) filter (status <> before) as changed from (select *, coalesce(lag(status) over (partition by o_orderkey order by m), status) as before from a) group by 1, 2")
def f25_status_replay(spark, d):
    at = F.lit("1995-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("m") * 365)
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("m"))
    status = F.when(F.col("o_orderdate") > at, "future").when(F.col("o_orderdate") + F.expr("interval 700 days") <= at, "expired").otherwise("active")
    a = o.select("o_orderkey", "m", status.alias("status"))
    before = F.coalesce(F.lag("status").over(Window.partitionBy("o_orderkey").orderBy("m")), F.col("status"))
    return a.withColumn("before", before).groupBy("m", "status").agg(F.count("*").alias("n"), F.count(F.when(F.col("status") != F.col("before"), 1)).alias("changed"))


@query("f30_neighbours", f"with {_GE} select src, kind, dst, place from (select src, kind, dst, row_number() over (partition by src, kind order by dst) as place from (select src, dst, case when dst % 2 = 0 then 'even' else 'odd' end as kind from e)) where place <= 3")
def f30_neighbours(spark, d):
    typed = edges(spark, d).withColumn("kind", F.when(F.col("dst") % 2 == 0, "even").otherwise("odd"))
    place = F.row_number().over(Window.partitionBy("src", "kind").orderBy("dst"))
    return typed.withColumn("place", place).where("place <= 3").select("src", "kind", "dst", "place")


@query("g21_stability", f"with {_RANKED} select query_id, round(count(*) filter (x and y) / count(*), 6) as jaccard from (select coalesce(a.query_id, b.query_id) as query_id, a.doc_id is not null as x, b.doc_id is not null as y from (select * from ranked where position <= 5) a full outer join (select * from ranked where position between 3 and 8) b on a.query_id = b.query_id and a.doc_id = b.doc_id) group by 1")
def g21_stability(spark, d):
    r = ranked(spark, d)
    a = r.where("position <= 5").select("query_id", "doc_id", F.lit(True).alias("x"))
    b = r.where("position between 3 and 8").select("query_id", "doc_id", F.lit(True).alias("y"))
    j = a.join(b, ["query_id", "doc_id"], "full_outer")
    return j.groupBy("query_id").agg(F.round(F.count(F.when(F.col("x") & F.col("y"), 1)) / F.count("*"), 6).alias("jaccard"))


@query("g31_certainty_summary", "select case when p_size > 35 then 'high' when p_size > 15 then 'moderate' else 'low' end as level, count(*) as n, round(avg((p_partkey % 3 = 0)::int), 6) as reviewed from part group by 1")
def g31_certainty_summary(spark, d):
    level = F.when(F.col("p_size") > 35, "high").when(F.col("p_size") > 15, "moderate").otherwise("low")
    return table(spark, d, "part").groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("p_partkey") % 3 == 0).cast("int")), 6).alias("reviewed"))


@query("g32_quality_summary", "select p_brand as design, case when p_size < 20 then 'low' else 'high' end as bias, count(*) as n from part group by grouping sets ((1, 2), (1), ())")
def g32_quality_summary(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("design"), F.when(F.col("p_size") < 20, "low").otherwise("high").alias("bias"))
    return p.rollup("design", "bias").agg(F.count("*").alias("n"))


@query("g38_run_aggregates", "select metric, round(avg(v), 6) as mean, round(median(v), 6) as median from (select event_type as metric, user_id % 10 as run, avg(value) as v from events where value is not null group by 1, 2) group by 1")
def g38_run_aggregates(spark, d):
    r = table(spark, d, "events").where("value is not null").groupBy(F.col("event_type").alias("metric"), (F.col("user_id") % 10).alias("run")).agg(F.avg("value").alias("v"))
    return r.groupBy("metric").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.percentile("v", 0.5), 6).alias("median"))


@query("g42_semantic_gates", f"with {_CLAIMS} select source, round(avg((not abstained)::int), 6) as coverage, avg((not abstained)::int) >= 0.6 and avg(entail) >= 0.4 and avg(contra) <= 0.5 as promoted from s group by 1")
def g42_semantic_gates(spark, d):
    s = claim_scores(spark, d)
    cover = F.avg((~F.col("abstained")).cast("int"))
    return s.groupBy("source").agg(F.round(cover, 6).alias("coverage"), ((cover >= 0.6) & (F.avg("entail") >= 0.4) & (F.avg("contra") <= 0.5)).alias("promoted"))


@query("g47_claim_diversity", f"with {_CLAIMS} select n_sources, count(*) as n_claims from (select claim_id, count(distinct source) as n_sources from s group by 1) group by 1")
def g47_claim_diversity(spark, d):
    return claim_scores(spark, d).groupBy("claim_id").agg(F.countDistinct("source").alias("n_sources")).groupBy("n_sources").agg(F.count("*").alias("n_claims"))


@query("g48_counter_coverage", f"with {_CLAIMS} select round(count(distinct claim_id) filter (contra >= 0.5) / count(distinct claim_id), 6) as coverage from s")
def g48_counter_coverage(spark, d):
    return claim_scores(spark, d).agg(F.round(F.countDistinct(F.when(F.col("contra") >= 0.5, F.col("claim_id"))) / F.countDistinct("claim_id"), 6).alias("coverage"))


@query("g49_path_completeness", f"with {_RANKED} select query_id, round(count(r.doc_id) / count(*), 6) as completeness from (select * from qrels where gain = 3) q left join ranked r using (query_id, doc_id) group by 1")
def g49_path_completeness(spark, d):
    topics, pool = judgements(spark, d)
    pool = pool.where("gain = 3")
    found = E.judged(ranked(spark, d), topics, pool).groupBy("query_id").agg(F.count("gain").alias("n_found"))
    want = E.relevant_counts(topics, pool).join(found, "query_id", "left")
    return want.select("query_id", F.round(F.coalesce("n_found", F.lit(0)) / F.col("n_relevant"), 6).alias("completeness"))


@query("h8_threshold_costs", f"with {_V}, s as (select round(conf, 3) as threshold, count(*) as n, sum(y) as pos from v group by 1), r as (select threshold, sum(n - pos) over (order by threshold desc) as fp, sum(pos) over () - sum(pos) over (order by threshold desc) as fn, sum(n) over () as total from s) select threshold, round((2.0 * fp + 1.0 * fn) / total, 6) as cost from r")
def h8_threshold_costs(spark, d):
    s = scored(spark, d).groupBy(F.round("conf", 3).alias("threshold")).agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    down, every = Window.orderBy(F.desc("threshold")), Window.partitionBy()
    cost = (2.0 * F.sum(F.col("n") - F.col("pos")).over(down) + F.sum("pos").over(every) - F.sum("pos").over(down)) / F.sum("n").over(every)
    return s.select("threshold", F.round(cost, 6).alias("cost"))


@query("h23_index_adaptation", f"with {_V}, g as (select user_id % 20 as profile, avg(conf) filter (event_id % 2 = 0) as a, avg(conf) filter (event_id % 2 = 1) as b, avg((event_type = 'error')::int) as failed from v group by 1) select profile, case when failed > 0.3 or a - b > 0.1 then 'urgent' when failed > 0.2 or a - b > 0.02 then 'shadow' else 'keep' end as action from g where a is not null and b is not null")
def h23_index_adaptation(spark, d):
    half = lambda i: F.avg(F.when(F.col("event_id") % 2 == i, F.col("conf")))
    g = scored(spark, d).groupBy((F.col("user_id") % 20).alias("profile")).agg(half(0).alias("a"), half(1).alias("b"), F.avg((F.col("event_type") == "error").cast("int")).alias("failed"))
    drop = F.col("a") - F.col("b")
    action = F.when((F.col("failed") > 0.3) | (drop > 0.1), "urgent").when((F.col("failed") > 0.2) | (drop > 0.02), "shadow").otherwise("keep")
    return g.where("a is not null and b is not null").select("profile", action.alias("action"))


@query("h51_calibrator_gate", f"with {_V} select event_type, count(*) as n, round(avg(pow(conf - y, 2)), 6) as brier, count(*) >= 50 and avg(pow(conf - y, 2)) <= 0.4 as qualified from v group by 1")
def h51_calibrator_gate(spark, d):
    b = F.avg(F.pow(F.col("conf") - F.col("y"), 2))
    return scored(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.round(b, 6).alias("brier"), ((F.count("*") >= 50) & (b <= 0.4)).alias("qualified"))


@query("h60_retrieval_calibration", f"with {_V}, r as (select 1 - conf as s, row_number() over (order by 1 - conf, event_id) as k, count(*) over () as n from v where y = 1 and event_type = 'purchase') select round(s, 6) as threshold, n from r where k = least(n, ceil((n + 1) * 0.8))")
def h60_retrieval_calibration(spark, d):
    v = scored(spark, d).where("y = 1 and event_type = 'purchase'").groupBy((1 - F.col("conf")).alias("s")).agg(F.count("*").alias("c"))  # conf has three decimals
    upto = v.withColumn("k", F.sum("c").over(Window.orderBy("s"))).withColumn("n", F.sum("c").over(Window.partitionBy()))
    hit = upto.where(F.col("k") >= F.least(F.col("n"), F.ceil((F.col("n") + 1) * F.lit(0.8))))
    return hit.groupBy("n").agg(F.round(F.min("s"), 6).alias("threshold"))


@query("h66_pairwise_plan_loss", f"with {_CLAIMS} select evidence_id, round(avg(ln(1 + exp(0.2 - entail + contra))), 6) as loss from s group by 1")
def h66_pairwise_plan_loss(spark, d):
    return claim_scores(spark, d).groupBy("evidence_id").agg(F.round(F.avg(F.log1p(F.exp(0.2 - F.col("entail") + F.col("contra")))), 6).alias("loss"))


@query("i4_promotion_gate", """select model, round(cand - base, 6) as gain, list_sort(list_filter([case when cand - base < -1 then 'quality' end, case when cmax > 1.1 * bmax then 'latency' end, case when csum > 1.05 * bsum then 'cost' end], lambda x: x is not null)) as reasons
  from (select user_id % 10 as model, avg(value) filter (event_id % 2 = 1) as cand, avg(value) filter (event_id % 2 = 0) as base, max(value) filter (event_id % 2 = 1) as cmax, max(value) filter (event_id % 2 = 0) as bmax, sum(value) filter (event_id % 2 = 1) as csum, sum(value) filter (event_id % 2 = 0) as bsum from events group by 1)""")
def i4_promotion_gate(spark, d):
    """Candidate (odd events) against baseline (even ones): quality gain, and latency and cost ratios."""
    from corpuslens.operators.assess import promotion_reasons

    side = lambda f, i: f(F.when(F.col("event_id") % 2 == i, F.col("value")))
    g = table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("model")).agg(*[side(f, i).alias(f"{n}{i}") for n, f in (("q", F.avg), ("l", F.max), ("c", F.sum)) for i in (0, 1)])
    return g.select("model", F.round(F.col("q1") - F.col("q0"), 6).alias("gain"), promotion_reasons({"quality": ("q0", "q1", -1.0)}, {"latency": ("l0", "l1", 1.1), "cost": ("c0", "c1", 1.05)}).alias("reasons"))


@query("i7_compaction_plan", "select o_orderkey from (select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) as r from orders where o_orderstatus = 'F' and o_orderpriority <> '1-URGENT' and o_orderdate < timestamp '1994-01-01') where r <= 500")
def i7_compaction_plan(spark, d):
    old = (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") != "1-URGENT") & (F.col("o_orderdate") < F.lit("1994-01-01").cast("timestamp_ntz"))
    return table(spark, d, "orders").where(old).orderBy("o_orderdate", "o_orderkey").limit(500).select("o_orderkey")


@query("i8_data_residency", "select c_custkey, case when r_name = 'EUROPE' and c_mktsegment = 'BUILDING' then 'deny' when r_name in ('EUROPE', 'AMERICA') then 'allow' else 'deny' end as decision from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def i8_data_residency(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    rule = F.when((F.col("r_name") == "EUROPE") & (F.col("c_mktsegment") == "BUILDING"), "deny").when(F.col("r_name").isin("EUROPE", "AMERICA"), "allow").otherwise("deny")
    return j.select("c_custkey", rule.alias("decision"))


@query("i20_claim_assessment", f"with {_CLAIMS} select claim_id, case when max(contra) >= 0.7 and max(contra) > max(entail) then 'contradicted' when max(entail) >= 0.6 then 'supported' else 'rejected' end as state from s where not abstained group by 1")
def i20_claim_assessment(spark, d):
    e, c = F.max("entail"), F.max("contra")
    g = claim_scores(spark, d).where(~F.col("abstained")).groupBy("claim_id")
    return g.agg(F.when((c >= 0.7) & (c > e), "contradicted").when(e >= 0.6, "supported").otherwise("rejected").alias("state"))


@query("i22_review_routing", f"with {_V} select event_id, case when event_type = 'error' then 'block' when conf < 0.3 then 'review' when conf < 0.5 and y = 0 then 'review' else 'auto' end as route, case when event_type = 'error' then 3 when conf < 0.3 then 2 when conf < 0.5 and y = 0 then 1 else 0 end as priority from v")
def i22_review_routing(spark, d):
    bad, low, mid = F.col("event_type") == "error", F.col("conf") < 0.3, (F.col("conf") < 0.5) & (F.col("y") == 0)
    return scored(spark, d).select("event_id", F.when(bad, "block").when(low | mid, "review").otherwise("auto").alias("route"), F.when(bad, 3).when(low, 2).when(mid, 1).otherwise(0).alias("priority"))


@query("i28_reading_order", "select conv_id, turn // 4 as page, turn, lead(turn) over (partition by conv_id, turn // 4 order by turn) as next_turn from conversations where role <> 'system'")
def i28_reading_order(spark, d):
    """Blocks of a page (four turns) in order, without those of the header's role."""
    page = F.floor(F.col("turn") / 4).alias("page")
    c = table(spark, d, "conversations").where("role <> 'system'").select("conv_id", page, "turn")
    return c.withColumn("next_turn", F.lead("turn").over(Window.partitionBy("conv_id", "page").orderBy("turn")))


@query("i29_preferences", "select user_id, sign(sum(case when event_id % 2 = 0 then 1 else -1 end))::int as preference from events where event_type in ('click', 'purchase') group by 1")
def i29_preferences(spark, d):
    e = table(spark, d, "events").where(F.col("event_type").isin("click", "purchase"))
    return e.groupBy("user_id").agg(F.signum(F.sum(F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1))).cast("int").alias("preference"))


@query("j9_private_traces", "select sha256('export-secret' || sha256('export-secret' || user_id)) as owner, event_type, count(*) as n, round(avg(value), 6) as mean from events group by 1, 2")
def j9_private_traces(spark, d):
    owner = pseudonym(F.col("user_id"), "export-secret")
    return table(spark, d, "events").groupBy(owner.alias("owner"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("j11_job_states", """with m as (select user_id, event_type as state, lag(event_type) over (partition by user_id order by ts, event_id) as before, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events where event_type in ('signup', 'purchase', 'error'))
  select user_id, max(state) filter (r = 1) as state, count(*) as n_moves, count(*) filter (not coalesce((before is null and state = 'signup') or (before = 'signup' and state in ('purchase', 'error')) or (before = 'purchase' and state in ('purchase', 'error')) or (before = 'error' and state = 'signup'), false)) as n_illegal from m group by 1""")
def j11_job_states(spark, d):
    """The current state of each job, and its moves that the transition table doesn't allow."""
    allowed = [(None, "signup"), ("signup", "purchase"), ("signup", "error"), ("purchase", "purchase"), ("purchase", "error"), ("error", "signup")]
    e = table(spark, d, "events").where(F.col("event_type").isin("signup", "purchase", "error"))
    return V.guarded_states(e, "user_id", "event_type", ["ts", "event_id"], allowed)


@query("j13_first_feedback", "select user_id, event_type, min(event_id) as event_id from events group by 1, 2")
def j13_first_feedback(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("j14_latest_checkpoint", "select user_id, arg_max(event_id, (ts, event_id)) as event_id, max(ts) as ts from events where event_type = 'signup' group by 1")
def j14_latest_checkpoint(spark, d):
    last = V.latest(table(spark, d, "events").where("event_type = 'signup'"), ["user_id"], F.desc("ts"), F.desc("event_id"))
    return last.select("user_id", "event_id", "ts")


@query("k3_hydrograph", f"with {_TS}, p as (select user_id, v as peak, t as peak_time from (select *, row_number() over (partition by user_id order by v desc, t) as r from s) where r = 1), i as (select user_id, coalesce(sum(x), 0) as volume from (select user_id, (v + lag(v) over w) / 2 * (t - lag(t) over w) as x from s window w as (partition by user_id order by t)) group by 1) select user_id, round(peak, 6) as peak, round(peak_time, 3) as peak_time, case when user_id % 2 = 0 then round(volume / 1000, 3) end as volume from p join i using (user_id)")
def k3_hydrograph(spark, d):
    s = points(spark, d)
    j = T.peaks(s, "user_id", "t", "v").join(T.integral(s, "user_id", "t", "v"), "user_id")
    return j.select("user_id", F.round("peak", 6).alias("peak"), F.round("peak_time", 3).alias("peak_time"), F.when(F.col("user_id") % 2 == 0, F.round(F.col("volume") / 1000, 3)).alias("volume"))


@query("c32_region_selection", "select l_orderkey, l_linenumber, l_partkey from (select *, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber, l_partkey) as r from lineitem where l_returnflag in ('A', 'N')) where r <= 2")
def c32_region_selection(spark, d):
    r = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_partkey"))
    return table(spark, d, "lineitem").where(F.col("l_returnflag").isin("A", "N")).withColumn("r", r).where("r <= 2").select("l_orderkey", "l_linenumber", "l_partkey")


@query("c39_drift_reference", f"with {_V} select event_type, least(floor(conf * 5 + 1e-12), 4)::int as bin, count(*) as n from v group by 1, 2")
def c39_drift_reference(spark, d):
    return S.histogram(scored(spark, d), "conf", [0.0, 0.2, 0.4, 0.6, 0.8, 1.0], ("event_type",)).select("event_type", "bin", "n")


@query("c34_location_match", "select s_suppkey, case when n_name is null then 'unmatched' when k > 1 then 'ambiguous' else 'matched' end as state from supplier left join (select n_regionkey * 5 as id, min(n_name) as n_name, count(*) as k from nation group by 1) on s_nationkey = id")
def c34_location_match(spark, d):
    n = table(spark, d, "nation").groupBy((F.col("n_regionkey") * 5).alias("id")).agg(F.min("n_name").alias("n_name"), F.count("*").alias("k"))
    s = table(spark, d, "supplier")
    j = s.join(n, s.s_nationkey == n.id, "left")
    return j.select("s_suppkey", F.when(F.col("n_name").isNull(), "unmatched").when(F.col("k") > 1, "ambiguous").otherwise("matched").alias("state"))
