"""Gates, mined negatives, snippets, walks and files over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuslens.functions.text import content_id, index_tokens
from corpuslens.operators import assess as A
from corpuslens.operators import graph as G
from corpuslens.operators import retrieval as R
from corpuslens.operators.lineage import shared_path
from corpuslens.plans.catalog import query, table
from corpuslens.plans.evaluation import _PAIRS, _RANKED, answer_pairs, judged, ranked
from corpuslens.plans.retrieval import _SEARCH, _queries
from corpuslens.plans.scalars import TOKENS_SQL
from corpuslens.plans.tables import _GE, edges
from corpuslens.sources import readers

# gates and authority


@query("b31_plan_ranks", "select user_id, event_type, score, row_number() over (partition by user_id order by score desc, event_type) as position from (select user_id, event_type, round(0.5 * count(*) + 0.02 * sum(value), 6) as score from events group by 1, 2)")
def b31_plan_ranks(spark, d):
    e = table(spark, d, "events")
    f = e.select("user_id", "event_type", F.explode(F.create_map(F.lit("n"), F.lit(1.0), F.lit("value"), F.col("value"))).alias("feature", "value"))
    r = A.linear_ranks(f.withColumn("value", F.col("value").cast("double")), {"n": 0.5, "value": 0.02}, "user_id", "event_type")
    r = r.select("user_id", "event_type", F.round("score", 6).alias("score"))
    order = Window.partitionBy("user_id").orderBy(F.desc("score"), "event_type")
    return r.withColumn("position", F.row_number().over(order))


_METRICS = f"""{_RANKED}, m as (select query_id, count(*) filter (hit) / 10.0 as precision_10, count(*) filter (hit and position <= 3) / 3.0 as precision_3, coalesce(max(1.0 / position) filter (hit), 0) as mrr
  from (select r.query_id, position, q.gain is not null as hit from ranked r left join qrels q using (query_id, doc_id)) group by 1),
  a as (select count(*) as n, avg(precision_10) as precision_10, avg(precision_3) as precision_3, avg(mrr) as mrr from m)"""


def _means(spark, d):
    j = judged(spark, d).withColumn("hit", F.col("gain").isNotNull())
    n = lambda c: F.count(F.when(c, 1))
    m = j.groupBy("query_id").agg(
        (n(F.col("hit")) / 10.0).alias("precision_10"), (n(F.col("hit") & (F.col("position") <= 3)) / 3.0).alias("precision_3"),
        F.coalesce(F.max(F.when(F.col("hit"), 1.0 / F.col("position"))), F.lit(0.0)).alias("mrr"),
    )
    return m.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("precision_10", "precision_3", "mrr")])


@query("g11_mean_metrics", f"with {_METRICS} select n, round(precision_10, 6) as precision_10, round(precision_3, 6) as precision_3, round(mrr, 6) as mrr from a")
def g11_mean_metrics(spark, d):
    return _means(spark, d).select("n", *[F.round(c, 6).alias(c) for c in ("precision_10", "precision_3", "mrr")])


@query("g43_robustness_gates", f"with {_METRICS} select list_sort(list_filter([case when n < 3 then 'n' end, case when precision_10 < 0.9 then 'precision_10' end, case when mrr < 0.2 then 'mrr' end, case when precision_3 > 0.95 then 'precision_3' end], lambda x: x is not null)) as failures from a")
def g43_robustness_gates(spark, d):
    return A.threshold_gates(_means(spark, d), {"n": 3, "precision_10": 0.9, "mrr": 0.2}, {"precision_3": 0.95}).select("failures")


_REGION = "r as (select l_orderkey, case when l_linenumber % 3 = 0 then 'table' else 'text' end as kind, case when l_linenumber = 7 then null else l_discount * 10 end as c, l_tax * 12 as c2, l_returnflag from lineitem)"


def _regions(spark, d):
    kind = F.when(F.col("l_linenumber") % 3 == 0, "table").otherwise("text")
    c = F.when(F.col("l_linenumber") == 7, None).otherwise(F.col("l_discount") * 10)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", kind.alias("kind"), c.alias("c"), (F.col("l_tax") * 12).alias("c2"), "l_returnflag")


_STRUCT = f"{_REGION}, o as (select l_orderkey, count(*) as n_regions, avg(c) as mean_confidence, avg((coalesce(c < 0.5, false))::int) as low_share, avg((kind = 'table')::int) as table_share, avg((c is null)::int) as missing_share from r group by 1)"


@query("i15_structure_rates", f"with {_STRUCT} select l_orderkey, n_regions, round(mean_confidence, 6) as mean_confidence, round(low_share, 6) as low_share, round(table_share, 6) as table_share, round(missing_share, 6) as missing_share from o")
def i15_structure_rates(spark, d):
    o = A.structure_quality(_regions(spark, d), "l_orderkey", "kind", "c")
    return o.select("l_orderkey", "n_regions", *[F.round(c, 6).alias(c) for c in ("mean_confidence", "low_share", "table_share", "missing_share")])


@query("i16_structure_decision", f"""with {_STRUCT} select l_orderkey, case when n_bad = 0 then 'accept' when n_bad = 1 then 'review' else 'reject' end as decision, reasons from (
  select l_orderkey, concat_ws(',', case when low_share > 0.61 then 'low_share' end, case when coalesce(mean_confidence, -1) < 0.42 then 'mean_confidence' end, case when missing_share > 0.21 then 'missing_share' end, case when n_regions < 2 then 'n_regions' end) as reasons, (n_regions < 2)::int + (coalesce(mean_confidence, -1) < 0.42)::int + (low_share > 0.61)::int + (missing_share > 0.21)::int as n_bad from o)""")
def i16_structure_decision(spark, d):
    o = A.structure_quality(_regions(spark, d), "l_orderkey", "kind", "c")
    g = A.threshold_gates(o, {"n_regions": 2, "mean_confidence": 0.42}, {"low_share": 0.61, "missing_share": 0.21})
    n = F.size("failures")
    return g.select("l_orderkey", F.when(n == 0, "accept").when(n == 1, "review").otherwise("reject").alias("decision"), F.array_join("failures", ",").alias("reasons"))


@query("i17_cell_authority", f"with {_REGION} select action, count(*) as n from (select case when f >= 0.55 then 'allow' when f >= 0.25 then 'review' else 'block' end as action from (select least(coalesce(c, -1), c2) as f from r)) group by 1")
def i17_cell_authority(spark, d):
    return A.authority(_regions(spark, d), ["c", "c2"], 0.55, 0.25).groupBy("action").agg(F.count("*").alias("n"))


@query("i25_chart_authority", f"with {_REGION} select l_orderkey, kind, n, case when f >= 0.55 then 'allow' when f >= 0.15 then 'review' else 'block' end as action from (select l_orderkey, kind, count(*) as n, min(least(coalesce(c, -1), c2)) as f from r group by 1, 2)")
def i25_chart_authority(spark, d):
    return A.authority(_regions(spark, d), ["c", "c2"], 0.55, 0.15, ["l_orderkey", "kind"]).select("l_orderkey", "kind", "n", "action")


@query("i26_trend_authority", f"with {_REGION} select l_orderkey, n, case when f >= 0.45 then 'allow' when f >= 0.05 then 'review' else 'block' end as action from (select l_orderkey, count(*) as n, min(coalesce(c, -1)) as f from r group by 1)")
def i26_trend_authority(spark, d):
    return A.authority(_regions(spark, d), ["c"], 0.45, 0.05, ["l_orderkey"]).select("l_orderkey", "n", "action")


@query("i14_poolable", "select l_partkey, count(distinct l_linestatus) = 1 as one_mode, count(distinct l_returnflag) = 1 as one_flag, count(distinct l_linestatus) = 1 and count(distinct l_returnflag) = 1 as poolable from lineitem group by 1")
def i14_poolable(spark, d):
    one = lambda c: F.countDistinct(c) == 1
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(one("l_linestatus").alias("one_mode"), one("l_returnflag").alias("one_flag"), (one("l_linestatus") & one("l_returnflag")).alias("poolable"))


@query("i13_realized_gains", "select event_id, l.doc_id is not null as recorded, coalesce(quality + toxic, -1)::int as gain from events e left join labels l on e.event_id = l.doc_id")
def i13_realized_gains(spark, d):
    e, labels = table(spark, d, "events"), table(spark, d, "labels")
    j = e.join(labels, e.event_id == labels.doc_id, "left")
    return j.select("event_id", F.col("doc_id").isNotNull().alias("recorded"), F.coalesce(F.col("quality") + F.col("toxic"), F.lit(-1)).cast("int").alias("gain"))


@query("h59_certainty", """select l_orderkey, least(4, greatest(1, max(s) + sum(coalesce(a, 0))))::int as level, round(avg((l_returnflag <> 'N')::int), 6) as reviewed_share, count(*) filter (a is null) as unresolved
  from (select l_orderkey, l_returnflag, case when o_orderpriority < '2' then 4 else 2 end as s, case when l_linenumber % 3 = 0 then -1 when l_linenumber = 5 then null else 0 end as a from lineitem join orders on l_orderkey = o_orderkey) group by 1""")
def h59_certainty(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    j = li.join(o, li.l_orderkey == o.o_orderkey).select(
        "l_orderkey", F.when(F.col("o_orderpriority") < "2", 4).otherwise(2).alias("s"), (F.col("l_returnflag") != "N").alias("seen"),
        F.when(F.col("l_linenumber") % 3 == 0, -1).when(F.col("l_linenumber") == 5, None).otherwise(0).alias("a"),
    )
    return A.evidence_certainty(j, ["l_orderkey"], "s", "a", "seen").select("l_orderkey", "level", F.round("reviewed_share", 6).alias("reviewed_share"), "unresolved")


_EX = "ex as (select event_id, user_id, event_type = 'error' as ab, event_id % 3 as truth, (event_id * 7) % 3 as pred, 1 + event_id * 5 % 11 as a0, 1 + event_id * 5 % 7 as a1, 1 + event_id * 3 % 5 as a2 from events), pr as (select *, a0 / (a0 + a1 + a2) as p0, a1 / (a0 + a1 + a2) as p1, a2 / (a0 + a1 + a2) as p2 from ex)"


def _examples(spark, d):
    e = F.col("event_id")
    a = [1 + e * 5 % 11, 1 + e * 5 % 7, 1 + e * 3 % 5]
    total = a[0] + a[1] + a[2]
    return table(spark, d, "events").select("event_id", "user_id", (F.col("event_type") == "error").alias("ab"), (e % 3).alias("truth"), (e * 7 % 3).alias("pred"), *[(x / total).alias(f"p{i}") for i, x in enumerate(a)])


@query("g41_multiclass_brier", f"with {_EX} select user_id, count(*) as n, round(avg(pow(p0 - (truth = 0)::int, 2) + pow(p1 - (truth = 1)::int, 2) + pow(p2 - (truth = 2)::int, 2)), 6) as brier from pr where not ab group by 1")
def g41_multiclass_brier(spark, d):
    return A.multiclass_brier(_examples(spark, d), {0: "p0", 1: "p1", 2: "p2"}, "truth", "ab", ["user_id"]).withColumn("brier", F.round("brier", 6))


@query("g23_semantic_report", f"with {_EX} select user_id, round(avg((not ab)::int), 6) as coverage, round(avg((pred = truth)::int) filter (not ab), 6) as accuracy, round(avg((pred <> 2)::int) filter (not ab and truth = 2), 6) as miss_rate from pr group by 1")
def g23_semantic_report(spark, d):
    r = A.semantic_report(_examples(spark, d), "pred", "truth", "ab", 2, ["user_id"])
    return r.select("user_id", *[F.round(c, 6).alias(c) for c in ("coverage", "accuracy", "miss_rate")])


@query("h50_abstention_threshold", """with p as (select event_type, floor(value)::int as c, count(*) as n, sum((event_id % 4 = 0)::int) as bad from events group by 1, 2),
  k as (select event_type, c, sum(n) over (partition by event_type order by c desc) / sum(n) over (partition by event_type) as coverage, sum(bad) over (partition by event_type order by c desc) / sum(n) over (partition by event_type order by c desc) as risk from p)
  select event_type, max(coverage)::double as coverage, arg_max(c, coverage) as threshold, round(arg_max(risk, coverage), 6) as risk from k where risk <= 0.26 and coverage >= 0.05 group by 1""")
def h50_abstention_threshold(spark, d):
    e = table(spark, d, "events").select("event_type", F.floor("value").cast("int").alias("c"), (F.col("event_id") % 4 == 0).alias("bad"))
    t = A.abstention_threshold(e, ["event_type"], "c", "bad", 0.26, 0.05)
    return t.select("event_type", "coverage", "threshold", F.round("risk", 6).alias("risk"))


@query("h52_interleaving_gate", """select user_id, n, decisive, round(low, 6) as low, n >= 5 and decisive >= 3 and low > 0.1 as passed from (select *, case when decisive > 0 then (wins / decisive + 1.959964 * 1.959964 / (2 * decisive) - 1.959964 * sqrt(wins / decisive * (1 - wins / decisive) / decisive + 1.959964 * 1.959964 / (4 * decisive * decisive))) / (1 + 1.959964 * 1.959964 / decisive) else 0 end as low
  from (select user_id, count(*) as n, count(*) filter (event_type in ('click', 'purchase')) as decisive, count(*) filter (event_type = 'click')::double as wins from events group by 1))""")
def h52_interleaving_gate(spark, d):
    k = F.col("event_type")
    g = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count(F.when(k.isin("click", "purchase"), 1)).alias("decisive"), F.count(F.when(k == "click", 1)).alias("wins"))
    g = g.withColumn("low", A.wilson_low(F.col("wins"), F.col("decisive")))
    return g.select("user_id", "n", "decisive", F.round("low", 6).alias("low"), ((F.col("n") >= 5) & (F.col("decisive") >= 3) & (F.col("low") > 0.1)).alias("passed"))


@query("e14_pareto_frontier", """with p as (select c_custkey, c_acctbal as quality, c_custkey % 97 as latency, c_nationkey as cost, c_custkey * 7 % 89 as memory from customer)
  select c_custkey from p a where not exists (select 1 from p b where b.quality >= a.quality and b.latency <= a.latency and b.cost <= a.cost and b.memory <= a.memory and (b.quality > a.quality or b.latency < a.latency or b.cost < a.cost or b.memory < a.memory))""")
def e14_pareto_frontier(spark, d):
    k = F.col("c_custkey")
    p = table(spark, d, "customer").select(k, F.col("c_acctbal").alias("quality"), (k % 97).alias("latency"), F.col("c_nationkey").alias("cost"), (k * 7 % 89).alias("memory"))
    return A.pareto_frontier(p, ["quality"], ["latency", "cost", "memory"]).select("c_custkey")


# text and retrieval


@query("g39_unsupported_claims", f"""with {_PAIRS}, c as (select conv_id, turn, ta, list_distinct(regexp_extract_all(c, '[\\p{{L}}\\p{{N}}_]+')) as t from (select conv_id, turn, ta, unnest(regexp_split_to_array(lower(b), '[.!?]+')) as c from t))
  select conv_id, turn, count(*) as n_claims, round(avg((len(list_intersect(t, list_distinct(ta))) / len(t) < 0.5)::int), 6) as unsupported_rate from c where len(t) > 0 group by 1, 2""")
def g39_unsupported_claims(spark, d):
    r = A.unsupported_claims(answer_pairs(spark, d), ["conv_id", "turn"], "b", "ta")
    return r.select("conv_id", "turn", "n_claims", F.round("unsupported_rate", 6).alias("unsupported_rate"))


@query("g12_rouge_l")
def g12_rouge_l(spark, d):
    return answer_pairs(spark, d).select("conv_id", "turn", F.round(A.rouge_l("ta", "tb"), 6).alias("rouge_l"))


@query("g40_best_reference")
def g40_best_reference(spark, d):
    """The best score of each conversation's answers against the turn before, its references."""
    return answer_pairs(spark, d).select("conv_id", A.rouge_l("ta", "tb").alias("s")).groupBy("conv_id").agg(F.round(F.max("s"), 6).alias("best"))


@query("g16_counterfactual_citations", f"""with {_RANKED} select query_id, avg((gain = 1)::int) as expected, avg((gain = 3)::int) as decoy, avg((gain is null)::int) as unknown from (select r.query_id, gain from ranked r left join qrels q using (query_id, doc_id)) group by 1""".replace("(gain = 1)::int", "coalesce(gain = 1, false)::int").replace("(gain = 3)::int", "coalesce(gain = 3, false)::int"))
def g16_counterfactual_citations(spark, d):
    j = judged(spark, d)
    share = lambda c, name: F.avg(F.when(c, 1.0).otherwise(0.0)).alias(name)
    return j.groupBy("query_id").agg(share(F.col("gain") == 1, "expected"), share(F.col("gain") == 3, "decoy"), share(F.col("gain").isNull(), "unknown"))


_MINED = f"""{_RANKED}, k as (select r.query_id, r.doc_id, position, q.gain is not null or position <= 2 as out from ranked r left join qrels q using (query_id, doc_id)),
  mined as (select query_id, doc_id, position, refused from (select *, row_number() over (partition by query_id order by position, doc_id) as nth from (select *, sum(out::int) over (partition by query_id) as refused from k) where not out) where nth <= 5)"""


@query("c12_mined_negatives", f"with {_MINED} select query_id, doc_id, position, refused::bigint as refused from mined")
def c12_mined_negatives(spark, d):
    r = judged(spark, d)
    return A.mined_negatives(r.drop("gain"), r.where("gain is not null"))


@query("i10_mined_generation", f"with {_MINED} select count(*) as n_negatives, count(distinct query_id) as n_queries, sum(position)::bigint as positions from mined")
def i10_mined_generation(spark, d):
    r = judged(spark, d)
    m = A.mined_negatives(r.drop("gain"), r.where("gain is not null"))
    return m.agg(F.count("*").alias("n_negatives"), F.countDistinct("query_id").alias("n_queries"), F.sum("position").alias("positions"))


@query("c14_cache_lookup", """select query_id, entry_id, round(s, 6) as similarity from (select a.vec_id as query_id, b.vec_id as entry_id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as s,
  row_number() over (partition by a.vec_id order by round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) desc, b.vec_id desc) as n
  from embeddings a join embeddings b on a.label = b.label and b.vec_id < a.vec_id where b.vec_id % 5 <> 0 and list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.05 and a.vec_id % 100 = 0) where n = 1""")
def c14_cache_lookup(spark, d):
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("part"), F.col("embedding").alias("q"), F.col("vec_id").alias("at"))
    e = v.select(F.col("vec_id").alias("entry_id"), F.col("label").alias("part"), F.col("embedding").alias("e"), F.col("vec_id").alias("stored"), (F.col("vec_id") % 5 == 0).alias("stale"))
    return A.cache_hits(q, e, R.cosine(F.col("q"), F.col("e")), 0.05).withColumn("similarity", F.round("similarity", 6))


@query("c23_store_repairs", """with m as (select o_orderkey as id, 0 as v, o_orderstatus = 'P' as deleted from orders where o_orderkey % 11 <> 0), s as (select o_orderkey as id, 0 as sv from orders where o_orderkey % 7 <> 0), e as (select o_orderkey as id, case when o_orderkey % 13 = 0 then 1 else 0 end as dv from orders where o_orderkey % 5 <> 0)
  select * from (select id, case when v is null then 'remove_unmanifested' when deleted then case when sv is not null or dv is not null then 'delete_everywhere' end when sv is null and dv is null then 'rebuild_both' when sv is null then 'rebuild_sparse' when dv is null then 'rebuild_dense' when sv <> v or dv <> v then 'reindex' end as action
    from m full outer join s using (id) full outer join e using (id)) where action is not null""")
def c23_store_repairs(spark, d):
    o = table(spark, d, "orders").withColumn("id", F.col("o_orderkey"))
    m = o.where("id % 11 <> 0").select("id", F.lit(0).alias("version"), (F.col("o_orderstatus") == "P").alias("deleted"))
    s = o.where("id % 7 <> 0").select("id", F.lit(0).alias("sparse_version"))
    e = o.where("id % 5 <> 0").select("id", F.when(F.col("id") % 13 == 0, 1).otherwise(0).alias("dense_version"))
    return A.store_repairs(m, s, e, "id")


@query("h61_conformal_sets", f"with {_SEARCH}, k as (select query_id, doc_id, 1 - cosine as nc from hits), kept as (select query_id, doc_id, row_number() over (partition by query_id order by round(nc, 9), doc_id) as position from k where nc <= 0.85) select i.item_id as query_id, doc_id, position, doc_id is null as abstained from benchmark i left join (select * from kept where position <= 5) k on i.item_id = k.query_id")
def h61_conformal_sets(spark, d):
    hits = R.search(_queries(spark, d), table(spark, d, "documents"), top_k=1 << 30).withColumn("nonconformity", 1 - F.col("cosine"))
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    return A.conformal_sets(q, hits, 0.85, 5)


@query("d3_query_snippets", f"""with {_SEARCH}, w as (select query_id, doc_id, text, list_min(list_filter(list_transform(ts, lambda t: instr(lower(text), t)), lambda i: i > 0)) as a0 from (select * from found where position <= 10)
    join documents using (doc_id) join (select query_id, list(term) as ts from q group by 1) using (query_id)), x as (select query_id, doc_id, text, coalesce(a0, 1) as at, greatest(1, coalesce(a0, 1) - 180) as s0, coalesce(a0, 1) + 420 as e from w),
  y as (select *, case when s0 > 1 then s0 - length(regexp_extract(substring(text, 1, s0 - 1), '([^\\t\\n\\v\\f\\r ]*)$', 1)) else s0 end as s, length(regexp_extract(substring(text, e), '^([^\\t\\n\\v\\f\\r ]*)', 1)) as more from x)
  select query_id, doc_id, md5(trim(substring(text, s, e - s + more))) as snippet_md5 from y""")
def d3_query_snippets(spark, d):
    docs, q = table(spark, d, "documents"), _queries(spark, d)
    hits = R.search(q, docs).select("query_id", "doc_id").join(docs.select("doc_id", "text"), "doc_id")
    terms = q.groupBy("query_id").agg(F.collect_set("term").alias("terms"))  # the terms of one query
    return hits.join(terms, "query_id").select("query_id", "doc_id", F.md5(A.snippet(F.col("text"), F.col("terms"))).alias("snippet_md5"))


@query("d15_page_interaction", """with q as (select vec_id as qv, label as q, embedding as qe from embeddings where vec_id % 100 = 0), p as (select vec_id, vec_id // 5 as page, vec_id // 50 as doc, embedding as e from embeddings),
  m as (select q, qv, page, doc, max(list_cosine_similarity(qe::double[], e::double[])) as m from q cross join p group by all), s as (select q, page, doc, avg(m) as score from m group by all),
  r as (select *, row_number() over (partition by q, doc order by round(score, 9) desc, page) as in_doc from s)
  select q, page, doc, round(score, 6) as score, position from (select *, row_number() over (partition by q order by round(score, 9) desc, page) as position from r where in_doc <= 4) where position <= 10""")
def d15_page_interaction(spark, d):
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qv"), F.col("label").alias("q"), F.col("embedding").alias("qe"))
    p = v.select(F.floor(F.col("vec_id") / 5).alias("page"), F.floor(F.col("vec_id") / 50).alias("doc"), F.col("embedding").alias("de"))
    s = R.late_interaction(q, p, ["page", "doc"])
    n = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.round("score", 9)), "page"))
    s = s.withColumn("in_doc", n("q", "doc")).where("in_doc <= 4").withColumn("position", n("q")).where("position <= 10")
    return s.select("q", "page", "doc", F.round("score", 6).alias("score"), "position")


# graphs


@query("f1_evidence_graph", """with l as (select doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) - 1 as n, unnest(string_split(text, chr(10))) as line from documents), s as (select * from l where trim(line, ' ' || chr(9) || chr(13)) <> '')
  select 'node' as kind, 'document' as type, sha256(source || chr(31) || doc_id || chr(31) || 'document') as id from documents
  union all select 'node', 'section', sha256(source || chr(31) || doc_id || chr(31) || 'section' || chr(31) || n) from s
  union all select 'edge', 'contains', sha256(sha256(source || chr(31) || doc_id || chr(31) || 'document') || chr(31) || sha256(source || chr(31) || doc_id || chr(31) || 'section' || chr(31) || n)) from s""")
def f1_evidence_graph(spark, d):
    docs = table(spark, d, "documents")
    nodes, links = G.document_graph(docs, "source", "doc_id", "text")
    return nodes.select(F.lit("node").alias("kind"), "type", "id").unionByName(links.select(F.lit("edge").alias("kind"), "type", "id"))


@query("f9_lineage", f"with {_GE}, r as (select c_custkey + 9000000 as root from customer where c_custkey % 100 = 0), h1 as (select distinct root, src as node from r join e on dst = root), h2 as (select distinct root, e.src as node from h1 join e on e.dst = h1.node) select root, node, min(depth) as depth from (select root, node, 1 as depth from h1 union all select root, node, 2 from h2) group by 1, 2")
def f9_lineage(spark, d):
    back = edges(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    roots = table(spark, d, "customer").where("c_custkey % 100 = 0").select((F.col("c_custkey") + 9000000).alias("node"))
    return G.hops(back, roots, 2, origins=True).where("depth > 0")


@query("f17_upstream", f"with {_GE}, r as (select p_partkey + 1000000 as root from part), h as (select distinct root, src as node from r join e on dst = root) select root - 1000000 as part, count(*) as n_upstream, min(node) as first_node from h group by 1")
def f17_upstream(spark, d):
    roots = table(spark, d, "part").select((F.col("p_partkey") + 1000000).alias("node"))
    up = G.upstream(edges(spark, d), roots, 1)
    return up.groupBy((F.col("root") - 1000000).alias("part")).agg(F.count("*").alias("n_upstream"), F.min("node").alias("first_node"))


@query("f18_path_lengths", f"with {_GE}, w as (select src, dst, (src + dst) % 7 + 1 as len from e) select a.src, b.dst, count(*) as n_paths, min(a.len + b.len) as shortest, max(a.len + b.len) as longest from w a join w b on a.dst = b.src group by 1, 2")
def f18_path_lengths(spark, d):
    w = edges(spark, d).withColumn("len", ((F.col("src") + F.col("dst")) % 7 + 1).cast("double"))
    p = G.weighted_paths(w, table(spark, d, "supplier").select(F.col("s_suppkey").alias("node")), "len", 2, by_ends=True).where("hops = 2")
    return p.select("src", "dst", "n_paths", F.col("shortest").cast("long").alias("shortest"), F.col("longest").cast("long").alias("longest"))


@query("f4_scored_paths", f"""with {_GE}, u as (select src, dst, 0.5 + (src + dst) % 5 / 10.0 as c from e), b as (select * from u union all select dst, src, c from u), s as (select c_custkey + 9000000 as node from customer where c_custkey % 100 = 0),
  p1 as (select node as seed, dst, c from s join b on src = node), p2 as (select seed, b.dst, p1.c * b.c as c from p1 join b on b.src = p1.dst where b.dst <> seed),
  a as (select seed, dst, max(x) as score from (select seed, dst, c / 1.15 as x from p1 union all select seed, dst, c / 1.3 from p2) group by 1, 2)
  select seed, dst, round(score, 6) as score, position from (select *, row_number() over (partition by seed order by round(score, 9) desc, dst) as position from a) where position <= 10""")
def f4_scored_paths(spark, d):
    e = edges(spark, d).withColumn("confidence", 0.5 + (F.col("src") + F.col("dst")) % 5 / 10.0)
    seeds = table(spark, d, "customer").where("c_custkey % 100 = 0").select((F.col("c_custkey") + 9000000).alias("node"))
    return G.scored_paths(e, seeds, 2, 10).withColumn("score", F.round("score", 6))


# series, logs and files


@query("k4_compare_hydrographs", """with s as (select user_id, event_id, event_id % 2 as side, value from events), k as (select user_id, side, max(value) as peak, arg_max(event_id, value * 1e9 - event_id) as at, sum(value) as volume from s group by 1, 2)
  select a.user_id, round(b.peak - a.peak, 6) as peak_delta, round(b.volume - a.volume, 4) as volume_delta from k a join k b on a.user_id = b.user_id and a.side = 0 and b.side = 1""")
def k4_compare_hydrographs(spark, d):
    k = table(spark, d, "events").groupBy("user_id", (F.col("event_id") % 2).alias("side")).agg(F.max("value").alias("peak"), F.sum("value").alias("volume"))
    a, b = k.where("side = 0").alias("a"), k.where("side = 1").alias("b")
    return a.join(b, "user_id").select("user_id", F.round(F.col("b.peak") - F.col("a.peak"), 6).alias("peak_delta"), F.round(F.col("b.volume") - F.col("a.volume"), 4).alias("volume_delta"))


@query("j7_multihop_runs", "select conv_id, count(*) as n, max(turn) as last_turn, arg_max(role, turn) as last_role, count(*) filter (role = 'user') as n_user, round(avg(length(text)), 6) as mean_chars from conversations group by 1")
def j7_multihop_runs(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("n"), F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"), F.count(F.when(F.col("role") == "user", 1)).alias("n_user"),
        F.round(F.avg(F.length("text")), 6).alias("mean_chars"),
    )


@query("i11_resumable_order")
def i11_resumable_order(spark, d):
    """The part of a seeded order that is left after a third of it: a window within ranges of the draw keeps it spread."""
    from corpuslens.operators.prepare import seeded_order

    docs = table(spark, d, "documents").select("doc_id")
    return seeded_order(docs, "doc_id", 7, 1).where(F.col("nth") > docs.count() // 3)


@query("a1_retrieval_set", "select (select count(*) from documents) as n_docs, (select count(*) from benchmark) as n_queries, (select count(*) from documents where doc_id % 3 > 0) as n_qrels, (select sum(length(source || chr(10) || chr(10) || text)) from documents)::bigint as n_chars")
def a1_retrieval_set(spark, d):
    """The given tables as JSON lines and a tab-separated file, read back as a retrieval set."""
    root, docs = shared_path(spark, "files"), table(spark, d, "documents")
    docs.select(F.col("doc_id").cast("string").alias("_id"), F.col("source").alias("title"), "text").write.json(f"{root}/corpus.jsonl")
    table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("_id"), "text").write.json(f"{root}/queries.jsonl")
    docs.select((F.col("doc_id") % 40).alias("query_id"), "doc_id", (F.col("doc_id") % 3).alias("score")).write.csv(f"{root}/qrels/test.tsv", sep="\t", header=True)
    got = readers.retrieval_set(spark, root)
    n = lambda t, name: got[t].agg(F.count("*").alias(name))
    chars = got["corpus"].agg(F.sum(F.length("text")).alias("n_chars"))
    return n("corpus", "n_docs").join(n("queries", "n_queries")).join(n("qrels", "n_qrels")).join(chars)  # one row each


@query("a2_judgements", "select (doc_id % 40)::varchar as query_id, count(*) as n, count(distinct doc_id) as n_docs from documents where doc_id % 3 >= 1 group by 1")
def a2_judgements(spark, d):
    path = shared_path(spark, "files")
    line = F.concat_ws(" ", (F.col("doc_id") % 40).cast("string"), F.lit("0"), F.col("doc_id").cast("string"), (F.col("doc_id") % 3).cast("string"))
    table(spark, d, "documents").select(line.alias("value")).write.text(path)
    return readers.judgements(spark, path).groupBy("query_id").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query("a9_report_csv", "select l_orderkey, l_linenumber, l_linestatus, l_quantity from lineitem where l_returnflag = 'R'")
def a9_report_csv(spark, d):
    """A flat report written as CSV, read back with its declared schema."""
    path = shared_path(spark, "files")
    rows = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_linestatus", "l_quantity")
    rows.write.csv(path, header=True)
    return spark.read.schema(rows.schema).csv(path, header=True)


@query("a12_manifest", "select 'missing' as problem, 1::bigint as n union all select 'differs', 1")
def a12_manifest(spark, d):
    """A manifest of written files that states one file too many and one wrong digest."""
    path = shared_path(spark, "files")
    table(spark, d, "benchmark").repartition(4).write.parquet(path)
    found = readers.file_manifest(spark, path).where(F.col("path").endswith(".parquet")).select("path", "bytes", "sha256")
    first = found.agg(F.min("path").alias("first"))
    stated = found.join(F.broadcast(first)).select("path", "bytes", F.when(F.col("path") == F.col("first"), "0").otherwise(F.col("sha256")).alias("sha256"))  # one row
    gone = found.agg(F.lit("nowhere").alias("path"), F.lit(0).cast("long").alias("bytes"), F.lit("0").alias("sha256"))
    return readers.manifest_problems(found, stated.unionByName(gone)).groupBy("problem").agg(F.count("*").alias("n"))


@query("e9_heuristic_rerank", f"""with {_SEARCH}, qt as (select item_id as query_id, {TOKENS_SQL} as qt from benchmark), h as (select query_id, doc_id, qt, {TOKENS_SQL} as t from found join documents using (doc_id) join qt using (query_id) where position <= 10),
  c as (select query_id, doc_id, sum(least(qtf, coalesce(tf.tf, 0))) / sum(qtf) as coverage from (select query_id, doc_id from h) join q using (query_id) left join tf using (doc_id, term) group by 1, 2),
  a as (select query_id, doc_id, qt, t, list_filter(list_transform(range(1, len(t) + 1), lambda i: case when list_contains(qt, t[i]) then i end), lambda i: i is not null) as p from h)
  select query_id, doc_id, round(least(1.0, 0.65 * coverage + 0.2 * case when len(p) > 0 then least(1.0, len(p) / (list_max(p) - list_min(p) + 1)) else 0 end + 0.15 * contains(array_to_string(t, ' '), array_to_string(qt, ' '))::int), 6) as score from a join c using (query_id, doc_id)""")
def e9_heuristic_rerank(spark, d):
    docs, b = table(spark, d, "documents"), table(spark, d, "benchmark")
    hits = R.search(_queries(spark, d), docs).select("query_id", "doc_id").join(docs.select("doc_id", index_tokens(F.col("text")).alias("t")), "doc_id")
    hits = hits.join(b.select(F.col("item_id").alias("query_id"), index_tokens(F.col("text")).alias("qt")), "query_id")
    return A.heuristic_scores(hits, "qt", "t").select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query("b19_scripts", r"select doc_id, script, round(k / n, 6) as share from (select doc_id, len(regexp_extract_all(text, '\p{L}')) as n, unnest(['latin', 'cyrillic', 'greek', 'han', 'arabic']) as script, unnest([len(regexp_extract_all(text, '\p{Latin}')), len(regexp_extract_all(text, '\p{Cyrillic}')), len(regexp_extract_all(text, '\p{Greek}')), len(regexp_extract_all(text, '\p{Han}')), len(regexp_extract_all(text, '\p{Arabic}'))]) as k from documents) where n > 0 and k > 0")
def b19_scripts(spark, d):
    """Share of letters of each script that a text holds."""
    count = lambda p: F.regexp_count("text", F.lit(p))
    each = F.array(*[F.struct(F.lit(s.lower()).alias("script"), count(rf"\p{{Is{s}}}").alias("k")) for s in ("Latin", "Cyrillic", "Greek", "Han", "Arabic")])
    rows = table(spark, d, "documents").select("doc_id", count(r"\p{L}").alias("n"), F.explode(each).alias("x")).where("n > 0 and x.k > 0")
    return rows.select("doc_id", "x.script", F.round(F.col("x.k") / F.col("n"), 6).alias("share"))


@query("b37_quantity_product", "select p_partkey, round(p_size * 0.01 * p_retailprice * 60, 6) as value, 'length1 time1' as dimension, round(abs(p_size * 0.01 * p_retailprice * 60) * sqrt(pow(0.05, 2) + pow(0.1, 2)), 6) as uncertainty from part")
def b37_quantity_product(spark, d):
    """Centimetres times minutes in SI units, with relative uncertainties of 5 and 10 per cent."""
    from corpuslens.functions.numbers import product

    rows = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("a"), F.lit("cm").alias("ua"), (F.col("p_size") * 0.05).alias("ea"), F.col("p_retailprice").alias("b"), F.lit("min").alias("ub"), (F.col("p_retailprice") * 0.1).alias("eb"))
    p = product(rows, ("a", "ua", "ea"), ("b", "ub", "eb"))
    return p.select("p_partkey", F.round("value", 6).alias("value"), "dimension", F.round("uncertainty", 6).alias("uncertainty"))


@query("f20_topological_levels", f"with {_GE} select node, max(level) as level from (select src as node, case when src < 1000000 then 0 else 1 end as level from e union select dst, case when dst < 9000000 then 1 else 2 end from e) group by 1")
def f20_topological_levels(spark, d):
    return G.topological_levels(edges(spark, d))


@query("g53_contradiction_clusters", "select l_partkey as citation, count(*) as n_claims, array_to_string(list_sort(list(distinct l_orderkey)), ',') as claims from lineitem where l_returnflag = 'R' group by 1")
def g53_contradiction_clusters(spark, d):
    claims = F.array_join(F.array_sort(F.collect_set("l_orderkey")).cast("array<string>"), ",")  # the claims against one citation
    return table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("citation")).agg(F.count("*").alias("n_claims"), claims.alias("claims"))


@query("i24_bibtex", r"""select doc_id, '@misc{' || doc_id || ',' || chr(10) || '  title = {' || regexp_replace(regexp_replace(string_split(text, chr(10))[1], '[\r\n\t ]+', ' ', 'g'), '([&%$#_{}])', '\\\1', 'g') || '},' || chr(10) || '  note = {' || source || '}' || chr(10) || '}' as entry from documents""")
def i24_bibtex(spark, d):
    from corpuslens.functions.text import bibtex

    title = F.split("text", "\n")[0]
    return table(spark, d, "documents").select("doc_id", bibtex("misc", F.col("doc_id"), {"title": title, "note": F.col("source")}).alias("entry"))


@query("h35_meta_regression", """select event_type, n, round(slope, 6) as slope, round((sy - slope * sx) / sw, 6) as intercept, round(syy - (sy - slope * sx) / sw * sy - slope * sxy, 2) as q from (select *, (sw * sxy - sx * sy) / (sw * sxx - sx * sx) as slope from (
  select event_type, count(*) as n, sum(w) as sw, sum(w * x) as sx, sum(w * y) as sy, sum(w * x * x) as sxx, sum(w * x * y) as sxy, sum(w * y * y) as syy from (select event_type, value as y, event_id % 10 * 1.0 as x, 1.0 + event_id % 3 as w from events) group by 1))""")
def h35_meta_regression(spark, d):
    e = table(spark, d, "events").select("event_type", F.col("value").alias("y"), (F.col("event_id") % 10 * 1.0).cast("double").alias("x"), (1.0 + F.col("event_id") % 3).cast("double").alias("w"))
    r = A.weighted_line(e, ["event_type"], "x", "y", "w")
    return r.select("event_type", "n", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), F.round("q", 2).alias("q"))
