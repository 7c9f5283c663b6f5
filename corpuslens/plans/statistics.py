"""Calibration, drift, tests and summaries over events and line items."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuslens.operators import statistics as S
from corpuslens.plans.catalog import query, table

_V = "v as (select event_id, user_id, event_type, ts, value, floor(value / (value + 20.0) * 1000) / 1000 as conf, case when event_type in ('purchase', 'click') then 1 else 0 end as y, 1.0 + event_id % 3 as w from events where value is not null)"


def scored(spark, d):
    e = table(spark, d, "events").where("value is not null")
    return e.select(
        "event_id", "user_id", "event_type", "ts", "value", (F.floor(F.col("value") / (F.col("value") + 20.0) * 1000) / 1000).alias("conf"),
        F.col("event_type").isin("purchase", "click").cast("int").alias("y"), (1.0 + F.col("event_id") % 3).alias("w"),
    )


_BINS = f"{_V}, b as (select bin, weight, c / weight as confidence, a / weight as accuracy, a / weight - c / weight as gap from (select least(floor(conf * 10), 9)::int as bin, sum(w) as weight, sum(w * conf) as c, sum(w * y) as a from v group by 1))"


@query("h1_reliability_bins", f"with {_BINS} select bin, round(weight, 6) as weight, round(confidence, 6) as confidence, round(accuracy, 6) as accuracy, round(gap, 6) as gap from b")
def h1_reliability_bins(spark, d):
    return S.reliability_bins(scored(spark, d)).select("bin", *[F.round(c, 6).alias(c) for c in ("weight", "confidence", "accuracy", "gap")])


@query("h2_calibration_error", f"with {_BINS} select round(sum(weight * abs(gap)) / sum(weight), 6) as ece from b")
def h2_calibration_error(spark, d):
    return S.calibration_error(S.reliability_bins(scored(spark, d))).select(F.round("ece", 6).alias("ece"))


@query("h3_maximum_error", f"with {_BINS} select round(max(abs(gap)), 6) as mce from b")
def h3_maximum_error(spark, d):
    return S.calibration_error(S.reliability_bins(scored(spark, d))).select(F.round("mce", 6).alias("mce"))


@query("h4_brier", f"with {_V} select event_type, round(sum(w * pow(conf - y, 2)) / sum(w), 6) as brier from v group by 1")
def h4_brier(spark, d):
    return scored(spark, d).groupBy("event_type").agg(F.round(S.brier(F.col("conf"), F.col("y"), F.col("w")), 6).alias("brier"))


@query("h5_log_loss", f"with {_V} select round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) as log_loss from (select y, least(greatest(conf, 1e-12), 1 - 1e-12) as p from v)")
def h5_log_loss(spark, d):
    return scored(spark, d).agg(F.round(S.log_loss(F.col("conf"), F.col("y")), 6).alias("log_loss"))


_RISK = f"{_V}, s as (select round(conf, 3) as threshold, count(*) as n, sum(1 - y) as wrong from v group by 1), r as (select threshold, sum(n) over (order by threshold desc) as answered, sum(wrong) over (order by threshold desc) as wrong, sum(n) over () as total from s)"


@query("h6_risk_coverage", f"with {_RISK} select threshold, round(answered / total, 6) as coverage, round(wrong / answered, 6) as risk from r")
def h6_risk_coverage(spark, d):
    return S.risk_coverage(scored(spark, d)).select("threshold", F.round("coverage", 6).alias("coverage"), F.round("risk", 6).alias("risk"))


@query("h7_abstention_threshold", f"with {_RISK} select threshold, round(cost, 6) as cost from (select threshold, (wrong * 1.0 + (total - answered) * 0.6) / total as cost from r) order by round(cost, 9), threshold limit 1")
def h7_abstention_threshold(spark, d):
    r = S.risk_coverage(scored(spark, d))
    cost = (F.col("wrong") * 1.0 + (F.col("total") - F.col("answered")) * 0.6) / F.col("total")
    return r.select("threshold", cost.alias("cost")).orderBy(F.round("cost", 9), "threshold").limit(1).select("threshold", F.round("cost", 6).alias("cost"))


@query("h9_selective_risk", f"with {_RISK} select c as coverage, round(min_by(wrong / answered, answered), 6) as risk from r, (values (0.25), (0.5), (0.75), (1.0)) t(c) where answered / total >= c - 1e-12 group by 1")
def h9_selective_risk(spark, d):
    r = S.risk_coverage(scored(spark, d))
    c = F.explode(F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75, 1.0)])).alias("c")
    some = r.select("*", c).where(F.col("coverage") >= F.col("c") - 1e-12)
    return some.groupBy(F.col("c").alias("coverage")).agg(F.round(F.min_by("risk", "answered"), 6).alias("risk"))


@query("h12_histogram_calibrator", f"with {_V}, g as (select avg(y) as base from v) select bin, round((sy + 5 * base) / (n + 5), 6) as value from (select least(floor(conf * 10), 9)::int as bin, count(*) as n, sum(y) as sy from v group by 1), g")
def h12_histogram_calibrator(spark, d):
    v = scored(spark, d)
    base = v.agg(F.avg("y").alias("base"))
    b = v.groupBy(F.least(F.floor(F.col("conf") * 10), F.lit(9)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum("y").alias("sy"))
    return b.crossJoin(base).select("bin", F.round((F.col("sy") + 5 * F.col("base")) / (F.col("n") + 5), 6).alias("value"))  # one row


@query("h13_nonconformity_threshold", f"with {_V}, r as (select event_type, 1 - conf as s, row_number() over (partition by event_type order by 1 - conf, event_id) as k, count(*) over (partition by event_type) as n from v) select event_type, round(s, 6) as threshold from r where k = least(n, ceil((n + 1) * 0.9))")
def h13_nonconformity_threshold(spark, d):
    v = scored(spark, d).withColumn("s", 1 - F.col("conf"))
    w = Window.partitionBy("event_type")
    r = v.withColumn("k", F.row_number().over(w.orderBy("s", "event_id"))).withColumn("n", F.count("*").over(w))
    return r.where(F.col("k") == F.least(F.col("n"), F.ceil((F.col("n") + 1) * F.lit(0.9)))).select("event_type", F.round("s", 6).alias("threshold"))


@query("h14_set_coverage", f"with {_V} select round(avg(c), 6) as coverage, count(*) as n_queries from (select user_id, max(case when conf >= 0.5 and y = 1 then 1 else 0 end) as c from v group by 1)")
def h14_set_coverage(spark, d):
    c = scored(spark, d).groupBy("user_id").agg(F.max(((F.col("conf") >= 0.5) & (F.col("y") == 1)).cast("int")).alias("c"))
    return c.agg(F.round(F.avg("c"), 6).alias("coverage"), F.count("*").alias("n_queries"))


@query("h15_selective", f"with {_V} select round(avg((conf >= 0.5)::int), 6) as coverage, round(avg(1 - y) filter (conf >= 0.5), 6) as error, round(avg((conf < 0.5)::int), 6) as abstention from v")
def h15_selective(spark, d):
    on = F.col("conf") >= 0.5
    return scored(spark, d).agg(F.round(F.avg(on.cast("int")), 6).alias("coverage"), F.round(F.avg(F.when(on, 1 - F.col("y"))), 6).alias("error"), F.round(F.avg((~on).cast("int")), 6).alias("abstention"))


@query("h16_uncertainty", f"with {_V} select user_id, round(avg(conf) * (1 - avg(conf)), 6) as total, round(avg(conf * (1 - conf)), 6) as aleatoric, round(var_pop(conf), 6) as epistemic, round(max(conf) - min(conf), 6) as spread from v group by 1")
def h16_uncertainty(spark, d):
    c = F.col("conf")
    return scored(spark, d).groupBy("user_id").agg(F.round(F.avg(c) * (1 - F.avg(c)), 6).alias("total"), F.round(F.avg(c * (1 - c)), 6).alias("aleatoric"), F.round(F.var_pop(c), 6).alias("epistemic"), F.round(F.max(c) - F.min(c), 6).alias("spread"))


@query("h17_combined_uncertainty", f"with {_V} select event_id, round(u + 1e-9, 6) as uncertainty, round(u, 9) > 0.5 as abstain from (select event_id, 0.4 * (1 - conf) + 0.3 * (1 - y) + 0.2 * (event_id % 10) / 10.0 + 0.1 * (w - 1) / 2.0 as u from v)")
def h17_combined_uncertainty(spark, d):
    u = 0.4 * (1 - F.col("conf")) + 0.3 * (1 - F.col("y")) + 0.2 * (F.col("event_id") % 10) / 10.0 + 0.1 * (F.col("w") - 1) / 2.0
    return scored(spark, d).select("event_id", F.round(u + 1e-9, 6).alias("uncertainty"), (F.round(u, 9) > 0.5).alias("abstain"))


_EDGES = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]
_HIST = f"{_V}, hb as (select event_type, half, least(floor(conf * 5 + 1e-12), 4)::int as bin from (select *, event_id % 2 as half from v)), h as (select half, bin, count(*) as n from hb group by 1, 2), hs as (select half, bin, n, n / sum(n) over (partition by half) as share from h)"


@query("h18_histogram", f"with {_HIST} select half, bin, n, round(share, 6) as share from hs")
def h18_histogram(spark, d):
    v = scored(spark, d).withColumn("half", F.col("event_id") % 2)
    return S.histogram(v, "conf", _EDGES, ("half",)).select("half", "bin", "n", F.round("share", 6).alias("share"))


def halves(spark, d):
    v = scored(spark, d).withColumn("half", F.col("event_id") % 2)
    h = S.histogram(v, "conf", _EDGES, ("half",))
    a, b = (h.where(F.col("half") == i).select("bin", F.col("share").alias(n)) for i, n in ((0, "ref"), (1, "cur")))
    return a.join(b, "bin", "full_outer").na.fill(0.0)


_PQ = f"{_HIST}, pq as (select coalesce(a.bin, b.bin) as bin, coalesce(a.share, 0) as r, coalesce(b.share, 0) as c from (select * from hs where half = 0) a full outer join (select * from hs where half = 1) b on a.bin = b.bin)"


@query("h19_stability_index", f"with {_PQ} select round(sum((greatest(c, 1e-6) - greatest(r, 1e-6)) * ln(greatest(c, 1e-6) / greatest(r, 1e-6))), 6) as psi from pq")
def h19_stability_index(spark, d):
    return halves(spark, d).agg(F.round(S.stability_index(F.col("ref"), F.col("cur")), 6).alias("psi"))


_M = "((r + c) / 2)"


@query("h20_js_divergence", f"with {_PQ} select round(sum((case when r > 0 then r * log2(r / {_M}) else 0 end + case when c > 0 then c * log2(c / {_M}) else 0 end) / 2), 6) as jsd from pq")
def h20_js_divergence(spark, d):
    return halves(spark, d).agg(F.round(S.js_divergence(F.col("ref"), F.col("cur")), 6).alias("jsd"))


@query("h21_mean_shift", f"with {_V} select event_type, round((avg(value) filter (event_id % 2 = 1) - avg(value) filter (event_id % 2 = 0)) / abs(avg(value) filter (event_id % 2 = 0)), 6) as shift from v group by 1")
def h21_mean_shift(spark, d):
    a, b = F.avg(F.when(F.col("event_id") % 2 == 0, F.col("value"))), F.avg(F.when(F.col("event_id") % 2 == 1, F.col("value")))
    return scored(spark, d).groupBy("event_type").agg(F.round((b - a) / F.abs(a), 6).alias("shift"))


@query("h22_drift_alerts", f"with {_V}, d as (select user_id % 20 as profile, avg(conf) filter (event_id % 2 = 0) as a, avg(conf) filter (event_id % 2 = 1) as b, count(*) as n from v group by 1) select profile, n, round((b - a) / a, 6) as shift, case when abs((b - a) / a) > 0.1 then 'alert' when abs((b - a) / a) > 0.03 then 'watch' else 'stable' end as state from d where a is not null and b is not null")
def h22_drift_alerts(spark, d):
    a, b = F.avg(F.when(F.col("event_id") % 2 == 0, F.col("conf"))), F.avg(F.when(F.col("event_id") % 2 == 1, F.col("conf")))
    g = scored(spark, d).groupBy((F.col("user_id") % 20).alias("profile")).agg(a.alias("a"), b.alias("b"), F.count("*").alias("n")).where("a is not null and b is not null")
    s = (F.col("b") - F.col("a")) / F.col("a")
    return g.select("profile", "n", F.round(s, 6).alias("shift"), F.when(F.abs(s) > 0.1, "alert").when(F.abs(s) > 0.03, "watch").otherwise("stable").alias("state"))


_PAIR = "p as (select o_orderkey as id, o_totalprice / 1000 as base, o_totalprice / 1000 * (0.9 + (o_orderkey % 21) / 100.0) as cand, o_orderpriority as metric from orders)"


def pairs(spark, d):
    o = table(spark, d, "orders")
    base = F.col("o_totalprice") / 1000
    return o.select(F.col("o_orderkey").alias("id"), base.alias("base"), (base * (0.9 + (F.col("o_orderkey") % 21) / 100.0)).alias("cand"), F.col("o_orderpriority").alias("metric"))


@query("h27_standardized_effect", f"with {_PAIR} select metric, count(*) as n, round(avg(cand - base) / stddev_samp(cand - base), 6) as effect from p group by 1")
def h27_standardized_effect(spark, d):
    diff = F.col("cand") - F.col("base")
    return pairs(spark, d).groupBy("metric").agg(F.count("*").alias("n"), F.round(F.avg(diff) / F.stddev_samp(diff), 6).alias("effect"))


_TESTS = "t as (select user_id % 50 as fam, event_type as test, 1.0 / (1 + count(*) + sum(value)) as p from events where value is not null group by 1, 2)"


def tests(spark, d):
    e = table(spark, d, "events").where("value is not null")
    return e.groupBy((F.col("user_id") % 50).alias("fam"), F.col("event_type").alias("test")).agg((1.0 / (1 + F.count("*") + F.sum("value"))).alias("p"))


@query("h28_holm", f"with {_TESTS}, r as (select *, least(1.0, (count(*) over (partition by fam) - row_number() over (partition by fam order by p, test) + 1) * p) as raw from t) select fam, test, round(max(raw) over (partition by fam order by p, test), 6) as adjusted from r")
def h28_holm(spark, d):
    return S.holm(tests(spark, d), ("fam",)).select("fam", "test", F.round("adjusted", 6).alias("adjusted"))


@query("h29_benjamini_hochberg", f"with {_TESTS}, r as (select *, least(1.0, p * count(*) over (partition by fam) / row_number() over (partition by fam order by p, test)) as raw from t) select fam, test, round(min(raw) over (partition by fam order by p desc, test desc), 6) as adjusted from r")
def h29_benjamini_hochberg(spark, d):
    return S.benjamini_hochberg(tests(spark, d), ("fam",)).select("fam", "test", F.round("adjusted", 6).alias("adjusted"))


@query("h30_noninferiority", f"with {_PAIR} select metric, round(m - 1.96 * s, 6) as low, m - 1.96 * s > -2.0 as passed from (select metric, avg(cand - base) as m, stddev_samp(cand - base) / sqrt(count(*)) as s from p group by 1)")
def h30_noninferiority(spark, d):
    diff = F.col("cand") - F.col("base")
    g = pairs(spark, d).groupBy("metric").agg(F.avg(diff).alias("m"), (F.stddev_samp(diff) / F.sqrt(F.count("*"))).alias("s"))
    low = F.col("m") - 1.96 * F.col("s")
    return g.select("metric", F.round(low, 6).alias("low"), (low > -2.0).alias("passed"))


_Z = 1.959963984540054


@query("h32_interleaving", f"with g as (select l_suppkey as arm, sum((l_quantity > 25)::int) as wins, sum((l_quantity < 25)::int) as losses, sum((l_quantity = 25)::int) as ties from lineitem group by 1), r as (select *, wins + losses as n, wins / (wins + losses) as rate from g where wins + losses > 0) select arm, wins::bigint as wins, ties::bigint as ties, round(rate, 6) as rate, round((rate + {_Z}*{_Z}/(2*n)) / (1 + {_Z}*{_Z}/n) - {_Z} * sqrt(rate*(1-rate)/n + {_Z}*{_Z}/(4*n*n)) / (1 + {_Z}*{_Z}/n), 6) as low, round((rate + {_Z}*{_Z}/(2*n)) / (1 + {_Z}*{_Z}/n) + {_Z} * sqrt(rate*(1-rate)/n + {_Z}*{_Z}/(4*n*n)) / (1 + {_Z}*{_Z}/n), 6) as high from r")
def h32_interleaving(spark, d):
    n = lambda c, name: F.sum(c.cast("int")).alias(name)
    q = F.col("l_quantity")
    g = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("arm")).agg(n(q > 25, "wins"), n(q < 25, "losses"), n(q == 25, "ties")).where("wins + losses > 0")
    low, high = S.wilson(F.col("wins"), F.col("wins") + F.col("losses"))
    return g.select("arm", "wins", "ties", F.round(F.col("wins") / (F.col("wins") + F.col("losses")), 6).alias("rate"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


_STUDY = "st as (select c_nationkey as grp, c_custkey % 12 as study, avg(c_acctbal) / 1000 as effect, var_samp(c_acctbal) / 1e6 / count(*) as variance from customer group by 1, 2 having count(*) > 1)"


def studies(spark, d):
    g = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("grp"), (F.col("c_custkey") % 12).alias("study"))
    s = g.agg((F.avg("c_acctbal") / 1000).alias("effect"), (F.var_samp("c_acctbal") / 1e6 / F.count("*")).alias("variance"), F.count("*").alias("n"))
    return s.where("n > 1").drop("n")


@query(
    "h33_meta_analysis",
    f"""with {_STUDY}, g as (select grp, count(*) as k, sum(1 / variance) as sw, sum(1 / variance / variance) as sw2, sum(effect / variance) as swy, sum(effect * effect / variance) as swyy from st group by 1 having count(*) > 1),
        h as (select *, swy / sw as fixed, greatest(0, swyy - swy * swy / sw) as q, sw - sw2 / sw as c from g),
        t as (select *, case when q > 0 then greatest(0, (q - k + 1) / q) else 0 end as i2, case when c > 0 then greatest(0, (q - k + 1) / c) else 0 end as tau2 from h)
        select grp, any_value(k) as k, round(any_value(fixed), 6) as fixed, round(any_value(i2), 6) as i2, round(any_value(tau2), 6) as tau2, round(sum(effect / (variance + tau2)) / sum(1 / (variance + tau2)), 6) as random from t join st using (grp) group by 1""",
)
def h33_meta_analysis(spark, d):
    m = S.meta_analysis(studies(spark, d), ("grp",)).where("k > 1")
    return m.select("grp", "k", *[F.round(c, 6).alias(c) for c in ("fixed", "i2", "tau2", "random")])


@query("h34_leave_one_out", f"with {_STUDY}, g as (select grp, sum(1 / variance) as sw, sum(effect / variance) as swy from st group by 1 having count(*) > 1) select grp, study, round((swy - effect / variance) / (sw - 1 / variance), 6) as pooled from st join g using (grp)")
def h34_leave_one_out(spark, d):
    s = studies(spark, d)
    w = 1 / F.col("variance")
    g = s.groupBy("grp").agg(F.sum(w).alias("sw"), F.sum(w * F.col("effect")).alias("swy"), F.count("*").alias("k")).where("k > 1")
    return s.join(g, "grp").select("grp", "study", F.round((F.col("swy") - w * F.col("effect")) / (F.col("sw") - w), 6).alias("pooled"))


@query("h37_confounding", "select l_orderkey, l_linenumber, round((1 + l_discount * 10) / (a * b / (a + b - 1)), 6) as adjusted from (select *, 1 + l_tax * 10 as a, 1 + l_quantity / 50 as b from lineitem)")
def h37_confounding(spark, d):
    a, b = 1 + F.col("l_tax") * 10, 1 + F.col("l_quantity") / 50
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round((1 + F.col("l_discount") * 10) / (a * b / (a + b - 1)), 6).alias("adjusted"))


@query("h38_clipped_aggregate", "with v as (select label, vec_id, sqrt(list_dot_product(embedding::double[], embedding::double[])) as norm, embedding[1]::double as x from embeddings) select label, count(*) as cohort, sum((norm > 1)::int)::bigint as clipped, round(avg(x * least(1.0, 1.0 / norm)), 6) as mean_x from v group by 1 having count(*) >= 5")
def h38_clipped_aggregate(spark, d):
    from corpuslens.operators.retrieval import dot

    v = table(spark, d, "embeddings").select("label", F.sqrt(dot(F.col("embedding"), F.col("embedding"))).alias("norm"), F.col("embedding")[0].cast("double").alias("x"))
    g = v.groupBy("label").agg(F.count("*").alias("cohort"), F.sum((F.col("norm") > 1).cast("int")).alias("clipped"), F.round(F.avg(F.col("x") * F.least(F.lit(1.0), 1.0 / F.col("norm"))), 6).alias("mean_x"))
    return g.where("cohort >= 5")


@query("h39_latencies", "select event_type, round(avg(value), 6) as mean, round(median(value), 6) as median, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99, round(max(value), 6) as most from events where value is not null group by 1")
def h39_latencies(spark, d):
    p = lambda q, name: F.round(F.percentile("value", q), 6).alias(name)
    return table(spark, d, "events").where("value is not null").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), p(0.5, "median"), p(0.95, "p95"), p(0.99, "p99"), F.round(F.max("value"), 6).alias("most"))


@query("h40_capacity", "select event_type, count(*) as n, round(count(*) / 3600.0, 6) as throughput, round(avg((event_id % 10 <> 0)::int), 6) as success, round(quantile_disc(value, 0.5), 6) as p50, round(quantile_disc(value, 0.95), 6) as p95 from events where value is not null group by 1")
def h40_capacity(spark, d):
    disc = lambda q, name: F.round(F.expr(f"percentile_disc({q}) within group (order by value)"), 6).alias(name)
    return table(spark, d, "events").where("value is not null").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.count("*") / 3600.0, 6).alias("throughput"), F.round(F.avg((F.col("event_id") % 10 != 0).cast("int")), 6).alias("success"), disc(0.5, "p50"), disc(0.95, "p95"))


@query("h42_cache_lookups", "select user_id % 20 as cache, count(*) filter (event_type = 'view') as hits, count(*) filter (event_type = 'click') as misses, count(*) filter (event_type = 'error') as expired, round(count(*) filter (event_type = 'view') / count(*), 6) as hit_rate from events group by 1")
def h42_cache_lookups(spark, d):
    n = lambda k, name: F.count(F.when(F.col("event_type") == k, 1)).alias(name)
    return table(spark, d, "events").groupBy((F.col("user_id") % 20).alias("cache")).agg(n("view", "hits"), n("click", "misses"), n("error", "expired"), F.round(F.count(F.when(F.col("event_type") == "view", 1)) / F.count("*"), 6).alias("hit_rate"))


@query("h43_quality_slos", "with m as (select event_type as name, avg(value) as v from events where value is not null group by 1), s as (select * from (values ('view', 20.0), ('click', 25.0), ('signup', 10.0), ('refund', 5.0)) t(name, target)) select s.name, case when v is null then 'missing' when v >= target then 'passed' else 'failed' end as state, round(v, 6) as v from s left join m using (name)")
def h43_quality_slos(spark, d):
    m = table(spark, d, "events").where("value is not null").groupBy(F.col("event_type").alias("name")).agg(F.avg("value").alias("v"))
    s = spark.createDataFrame([("view", 20.0), ("click", 25.0), ("signup", 10.0), ("refund", 5.0)], "name string, target double")
    return s.join(m, "name", "left").select("name", F.when(F.col("v").isNull(), "missing").when(F.col("v") >= F.col("target"), "passed").otherwise("failed").alias("state"), F.round("v", 6).alias("v"))


@query("h44_compare_snapshots", "with a as (select user_id % 40 as name, avg(value) as v from events where event_id % 2 = 0 and value is not null group by 1), b as (select user_id % 40 as name, avg(value) as v from events where event_id % 2 = 1 and value is not null group by 1) select name, round(b.v - a.v, 6) as delta, case when a.v is null or b.v is null then 'missing' when abs(b.v - a.v) <= 0.5 then 'unchanged' when b.v > a.v then 'improved' else 'regressed' end as change from a full outer join b using (name)")
def h44_compare_snapshots(spark, d):
    e = table(spark, d, "events").where("value is not null")
    a, b = (e.where(F.col("event_id") % 2 == i).groupBy((F.col("user_id") % 40).alias("name")).agg(F.avg("value").alias(c)) for i, c in ((0, "va"), (1, "vb")))
    delta = F.col("vb") - F.col("va")
    change = F.when(delta.isNull(), "missing").when(F.abs(delta) <= 0.5, "unchanged").when(delta > 0, "improved").otherwise("regressed")
    return a.join(b, "name", "full_outer").select("name", F.round(delta, 6).alias("delta"), change.alias("change"))


_ROWS = "r as (select l_orderkey as id, l_linenumber as j, l_discount * 10 as s, (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) = 1)::int as pos, 1.0 + l_tax * 10 as rel from lineitem)"


def score_rows(spark, d):
    first = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("j"), (F.col("l_discount") * 10).alias("s"), (first == 1).cast("int").alias("pos"), (1.0 + F.col("l_tax") * 10).alias("rel"))


@query("h53_contrastive_loss", f"with {_ROWS} select round(avg(l), 6) as loss from (select id, ln(sum(exp(s / 0.5))) - sum(s * pos) / 0.5 as l from r group by 1)")
def h53_contrastive_loss(spark, d):
    per = score_rows(spark, d).groupBy("id").agg((F.log(F.sum(F.exp(F.col("s") / 0.5))) - F.sum(F.col("s") * F.col("pos")) / 0.5).alias("l"))
    return per.agg(F.round(F.avg("l"), 6).alias("loss"))


@query("h54_pairwise_softplus", f"with {_ROWS} select round(avg(ln(1 + exp(0.5 - p.s + n.s))), 6) as loss from r p join r n on p.id = n.id and p.pos = 1 and n.pos = 0")
def h54_pairwise_softplus(spark, d):
    r = score_rows(spark, d)
    j = r.where("pos = 1").select("id", F.col("s").alias("sp")).join(r.where("pos = 0").select("id", F.col("s").alias("sn")), "id")
    return j.agg(F.round(F.avg(F.log1p(F.exp(0.5 - F.col("sp") + F.col("sn")))), 6).alias("loss"))


@query("h55_listwise_cross_entropy", f"with {_ROWS} select round(avg(l), 6) as loss from (select id, -sum(rel / tot * (s - lse)) as l from (select *, sum(rel) over (partition by id) as tot, ln(sum(exp(s)) over (partition by id)) as lse from r) group by 1)")
def h55_listwise_cross_entropy(spark, d):
    g = score_rows(spark, d).groupBy("id").agg(F.sum("rel").alias("tot"), F.log(F.sum(F.exp("s"))).alias("lse"), F.sum(F.col("rel") * F.col("s")).alias("rs"))
    return g.agg(F.round(F.avg(-(F.col("rs") / F.col("tot") - F.col("lse"))), 6).alias("loss"))


@query("h56_distillation_kl", f"with {_ROWS}, z as (select id, exp(rel / 2) / sum(exp(rel / 2)) over (partition by id) as p, exp(s / 2) / sum(exp(s / 2)) over (partition by id) as q from r) select round(avg(kl), 6) as loss from (select id, 4 * sum(p * ln(p / q)) as kl from z group by 1)")
def h56_distillation_kl(spark, d):
    w = Window.partitionBy("id")
    soft = lambda c: F.exp(F.col(c) / 2) / F.sum(F.exp(F.col(c) / 2)).over(w)
    z = score_rows(spark, d).select("id", soft("rel").alias("p"), soft("s").alias("q"))
    kl = z.groupBy("id").agg((4 * F.sum(F.col("p") * F.log(F.col("p") / F.col("q")))).alias("kl"))
    return kl.agg(F.round(F.avg("kl"), 6).alias("loss"))


@query("h57_activation_penalties", f"with {_ROWS} select round((select avg(l1) from (select id, sum(s) as l1 from r group by 1)), 6) as l1, round(sum(m * m), 6) as flops from (select j, sum(s) / (select count(distinct id) from r) as m from r group by 1)")
def h57_activation_penalties(spark, d):
    r = score_rows(spark, d)
    n = r.agg(F.countDistinct("id").alias("n"), (F.sum("s") / F.countDistinct("id")).alias("l1"))
    per = r.groupBy("j").agg(F.sum("s").alias("t"))
    return per.crossJoin(n).agg(F.round(F.first("l1"), 6).alias("l1"), F.round(F.sum(F.pow(F.col("t") / F.col("n"), 2)), 6).alias("flops"))  # one row


@query("h64_weighted_mean", "select p_brand, round(sum(p_retailprice * p_size) / sum(p_size), 6) as mean, round(sqrt(sum(pow(p_size * 0.05 * p_retailprice, 2))) / sum(p_size), 6) as uncertainty from part group by 1")
def h64_weighted_mean(spark, d):
    x, w = F.col("p_retailprice"), F.col("p_size")
    return table(spark, d, "part").groupBy("p_brand").agg(F.round(F.sum(x * w) / F.sum(w), 6).alias("mean"), F.round(F.sqrt(F.sum(F.pow(w * 0.05 * x, 2))) / F.sum(w), 6).alias("uncertainty"))


@query("h67_listwise_plan_loss", f"with {_ROWS} select round(avg(l), 6) as loss from (select id, -sum((rel - lo) / tot * (s - lse)) as l from (select *, min(rel) over (partition by id) - 0.1 as lo, sum(rel) over (partition by id) - count(*) over (partition by id) * (min(rel) over (partition by id) - 0.1) as tot, ln(sum(exp(s)) over (partition by id)) as lse from r) group by 1)")
def h67_listwise_plan_loss(spark, d):
    w = Window.partitionBy("id")
    r = score_rows(spark, d).withColumn("u", F.col("rel") - F.min("rel").over(w) + 0.1)
    g = r.groupBy("id").agg(F.sum("u").alias("tot"), F.log(F.sum(F.exp("s"))).alias("lse"), F.sum(F.col("u") * F.col("s")).alias("us"))
    return g.agg(F.round(F.avg(F.col("lse") - F.col("us") / F.col("tot")), 6).alias("loss"))


@query("h68_throughput", "select event_type, round(count(*) / (epoch(max(ts)) - epoch(min(ts))), 6) as per_second from events group by 1")
def h68_throughput(spark, d):
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.count("*") / (F.max(t) - F.min(t)), 6).alias("per_second"))


@query("h69_observations", "select event_type as namespace, name, round(v, 6) as v, n from (select event_type, count(*) as n, avg(value) as mean, max(value) as most from events group by 1) unpivot (v for name in (mean, most))")
def h69_observations(spark, d):
    g = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("most"))
    return g.unpivot(["event_type", "n"], ["mean", "most"], "name", "v").where("v is not null").select(F.col("event_type").alias("namespace"), "name", F.round("v", 6).alias("v"), "n")


@query("h10_isotonic_fit")
def h10_isotonic_fit(spark, d):
    return S.isotonic(scored(spark, d), "event_type")


@query("h25_paired_bootstrap")
def h25_paired_bootstrap(spark, d):
    p = pairs(spark, d).select("id", (F.col("cand") - F.col("base")).alias("difference"))
    r = S.paired_resamples(p)
    return r.agg(F.percentile("mean_difference", 0.025).alias("low"), F.percentile("mean_difference", 0.975).alias("high"), F.avg((F.col("mean_difference") > 0).cast("int")).alias("positive"))


@query("h26_permutation_test")
def h26_permutation_test(spark, d):
    return S.sign_flips(pairs(spark, d).select("id", (F.col("cand") - F.col("base")).alias("difference")))
