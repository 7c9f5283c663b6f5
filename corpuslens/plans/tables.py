"""Joins, graphs, governance, series and event logs over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuslens.operators import governance as V
from corpuslens.operators import graph as G
from corpuslens.operators import ranking as K
from corpuslens.operators import series as T
from corpuslens.operators.lineage import cut
from corpuslens.functions.text import redacted
from corpuslens.plans.catalog import query, table
from corpuslens.plans.scalars import TOKENS_SQL
from corpuslens.streaming import events as E


# joins


_MENTIONS = "lower(p_brand) || ' ' || lower(string_split(p_type, ' ')[1])"


@query("c3_entity_resolution", f"""with al as (select distinct p_brand || '/' || string_split(p_type, ' ')[1] as entity, {_MENTIONS} as alias from part),
  m as (select distinct case when p_partkey % 3 = 0 then {_MENTIONS} when p_partkey % 3 = 1 then lower(string_split(p_type, ' ')[1]) || ' the ' || lower(p_brand) else lower(p_brand) || ' ' || lower(p_type) end as mention from part),
  mt as (select distinct mention, unnest(string_split(mention, ' ')) as t from m), atk as (select distinct entity, alias, unnest(string_split(alias, ' ')) as t from al),
  nm as (select mention, count(*) as n from mt group by 1), na as (select entity, alias, count(*) as n from atk group by 1, 2),
  s as (select mention, entity, max(k / (nm.n + na.n - k)) as score from (select mention, entity, alias, count(*)::double as k from mt join atk using (t) group by all) join nm using (mention) join na using (entity, alias) group by 1, 2),
  r as (select *, row_number() over (partition by mention order by round(score, 9) desc, entity) as p, lead(score) over (partition by mention order by round(score, 9) desc, entity) as next from s),
  e as (select mention, min(entity) as entity from m join al on mention = alias group by 1)
  select m.mention, coalesce(e.entity, case when r.score >= 0.6 and r.score - coalesce(r.next, 0) >= 0.05 then r.entity end) as entity,
    case when e.entity is not null then 'exact' when r.score < 0.6 or r.score is null then 'unknown' when r.score - coalesce(r.next, 0) < 0.05 then 'ambiguous' else 'similar' end as how
  from m left join e using (mention) left join r on r.mention = m.mention and p = 1""")
def c3_entity_resolution(spark, d):
    """Mentions as exact aliases, with words added and turned round, and with the whole type."""
    p = table(spark, d, "part")
    brand, kind = F.lower("p_brand"), F.lower(F.split("p_type", " ")[0])
    alias = F.concat_ws(" ", brand, kind)
    aliases = p.select(F.concat_ws("/", "p_brand", F.split("p_type", " ")[0]).alias("entity"), alias.alias("alias"))
    mention = F.when(F.col("p_partkey") % 3 == 0, alias).when(F.col("p_partkey") % 3 == 1, F.concat_ws(" ", kind, F.lit("the"), brand)).otherwise(F.concat_ws(" ", brand, F.lower("p_type")))
    return V.resolve_entities(p.select(mention.alias("mention")), aliases, threshold=0.6).select("mention", "entity", "how")


_BOX = "b as (select c_custkey as id, c_nationkey as var, c_acctbal as x from customer)"


@query("c4_box_overlap", "select s_suppkey, count(*) as n, round(min(c_acctbal), 6) as nearest from supplier join customer on s_nationkey = c_nationkey and c_acctbal between s_acctbal - 500 and s_acctbal + 500 group by 1")
def c4_box_overlap(spark, d):
    """Ranges meet through grid cells: an equi-join on (variable, cell), then the exact test."""
    cell = lambda c: F.floor(c / 1000).cast("int")
    s = table(spark, d, "supplier").withColumn("cell", F.explode(F.sequence(cell(F.col("s_acctbal") - 500), cell(F.col("s_acctbal") + 500))))
    c = table(spark, d, "customer").withColumn("cell", cell(F.col("c_acctbal")))
    j = s.join(c, (s.s_nationkey == c.c_nationkey) & (s.cell == c.cell)).where(F.col("c_acctbal").between(F.col("s_acctbal") - 500, F.col("s_acctbal") + 500))
    return j.groupBy("s_suppkey").agg(F.count("*").alias("n"), F.round(F.min("c_acctbal"), 6).alias("nearest"))


@query("c5_as_of", "select o_orderkey, o_custkey from orders where o_orderdate <= timestamp '1996-06-30' and (o_orderstatus <> 'F' or o_orderdate + interval 400 day > timestamp '1996-06-30')")
def c5_as_of(spark, d):
    at = F.lit("1996-06-30").cast("timestamp_ntz")
    o = table(spark, d, "orders")
    return o.where((F.col("o_orderdate") <= at) & ((F.col("o_orderstatus") != "F") | (F.col("o_orderdate") + F.expr("interval 400 days") > at))).select("o_orderkey", "o_custkey")


@query("c6_multi_hop_groups", "select l_partkey, count(distinct l_linenumber) as n_hops, round(max(l_extendedprice), 6) as best from lineitem group by 1 having count(distinct l_linenumber) >= 2")
def c6_multi_hop_groups(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_linenumber").alias("n_hops"), F.round(F.max("l_extendedprice"), 6).alias("best"))
    return g.where("n_hops >= 2")


@query("c7_corpus_coverage", "select doc_id from labels where doc_id not in (select doc_id from documents where doc_id % 3 <> 0)")
def c7_corpus_coverage(spark, d):
    return table(spark, d, "labels").select("doc_id").join(table(spark, d, "documents").where("doc_id % 3 <> 0"), "doc_id", "left_anti")


@query("c8_result_universe", "select 'extra' as side, doc_id from (select doc_id from documents except select doc_id from labels) union all select 'missing', doc_id from (select doc_id from labels except select doc_id from documents)")
def c8_result_universe(spark, d):
    a, b = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    return a.exceptAll(b).select(F.lit("extra").alias("side"), "doc_id").unionByName(b.exceptAll(a).select(F.lit("missing").alias("side"), "doc_id"))


@query("c9_overlay_labels", "select doc_id, coalesce(quality, 1 - doc_id % 2) as label, quality is not null and quality <> 1 - doc_id % 2 as changed from documents left join labels using (doc_id)")
def c9_overlay_labels(spark, d):
    base = 1 - F.col("doc_id") % 2
    j = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return j.select("doc_id", F.coalesce("quality", base).alias("label"), (F.col("quality").isNotNull() & (F.col("quality") != base)).alias("changed"))


@query("c10_split_leakage", """with s as (select case doc_id % 3 when 0 then 'dev' when 1 then 'test' else 'train' end as split, kind, v from (select doc_id, 'text' as kind, md5(text) as v from documents union all select doc_id, 'source', source from documents)),
  u as (select distinct split, kind, v from s) select a.split as one, b.split as other, a.kind, count(*) as n, min(a.v) as sample from u a join u b on a.kind = b.kind and a.v = b.v and a.split < b.split group by 1, 2, 3""")
def c10_split_leakage(spark, d):
    docs = table(spark, d, "documents")
    split = F.when(F.col("doc_id") % 3 == 0, "dev").when(F.col("doc_id") % 3 == 1, "test").otherwise("train")
    keys = F.explode(F.array(F.struct(F.lit("text").alias("kind"), F.md5("text").alias("v")), F.struct(F.lit("source").alias("kind"), F.col("source").alias("v"))))
    u = docs.select(split.alias("split"), keys.alias("k")).select("split", "k.*").distinct()
    splits = u.groupBy("kind", "v").agg(F.array_sort(F.collect_set("split")).alias("s")).where(F.size("s") > 1)  # three splits at most
    pairs = F.explode(F.expr("filter(flatten(transform(s, x -> transform(s, y -> struct(x as one, y as other)))), p -> p.one < p.other)"))
    return splits.select("kind", "v", pairs.alias("p")).groupBy("p.one", "p.other", "kind").agg(F.count("*").alias("n"), F.min("v").alias("sample"))


@query("c11_hard_negatives", f"""with dt as (select distinct doc_id, unnest({TOKENS_SQL}) as term from documents), dn as (select doc_id, count(*) as n from dt group by 1),
  qt as (select distinct item_id as query_id, unnest({TOKENS_SQL}) as term from benchmark), qn as (select query_id, count(*) as n from qt group by 1),
  s as (select query_id, doc_id, count(*) as shared from qt join dt using (term) group by 1, 2),
  r as (select query_id, doc_id, shared, round(shared / (qn.n + dn.n - shared), 9) as jac from s join qn using (query_id) join dn using (doc_id) where shared / qn.n < 0.9)
  select query_id, doc_id, shared, round(jac, 6) as overlap, place from (select *, row_number() over (partition by query_id order by jac desc, shared desc, doc_id) as place from r) where place <= 5""")
def c11_hard_negatives(spark, d):
    from corpuslens.functions.text import index_tokens

    terms = lambda t, k, as_: table(spark, d, t).select(F.col(k).alias(as_), F.explode(F.array_distinct(index_tokens(F.col("text")))).alias("term"))
    dt, qt = terms("documents", "doc_id", "doc_id"), terms("benchmark", "item_id", "query_id")
    dn, qn = dt.groupBy("doc_id").agg(F.count("*").alias("dn")), qt.groupBy("query_id").agg(F.count("*").alias("qn"))
    s = dt.join(qt, "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("shared")).join(qn, "query_id").join(dn, "doc_id").where(F.col("shared") / F.col("qn") < 0.9)
    s = s.withColumn("jac", F.round(F.col("shared") / (F.col("qn") + F.col("dn") - F.col("shared")), 9))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("jac"), F.desc("shared"), "doc_id"))
    return s.withColumn("place", place).where("place <= 5").select("query_id", "doc_id", "shared", F.round("jac", 6).alias("overlap"), "place")


@query("c15_check_assertions", "select l_orderkey, l_linenumber, case when p_partkey is null then 'missing' when abs(l_extendedprice / l_quantity - p_retailprice) <= greatest(1.0, 0.05 * p_retailprice) then 'consistent' else 'inconsistent' end as status from lineitem left join part on l_partkey = p_partkey and p_partkey % 7 <> 0")
def c15_check_assertions(spark, d):
    p = table(spark, d, "part").where("p_partkey % 7 <> 0")
    li = table(spark, d, "lineitem")
    off = F.abs(F.col("l_extendedprice") / F.col("l_quantity") - F.col("p_retailprice"))
    status = F.when(F.col("p_partkey").isNull(), "missing").when(off <= F.greatest(F.lit(1.0), 0.05 * F.col("p_retailprice")), "consistent").otherwise("inconsistent")
    return li.join(p, li.l_partkey == p.p_partkey, "left").select("l_orderkey", "l_linenumber", status.alias("status"))


_PK = "{n} as (select user_id, max(value) as peak, min(ts) filter (value = m) as peak_ts from (select *, max(value) over (partition by user_id) as m from events where value is not null and event_id % 2 = {i}) group by 1)"


@query("c16_compare_scenarios", f"with {_PK.format(n='a', i=0)}, {_PK.format(n='b', i=1)} select user_id, round(b.peak - a.peak, 6) as delta, round(epoch(b.peak_ts) - epoch(a.peak_ts), 3) as seconds from a join b using (user_id)")
def c16_compare_scenarios(spark, d):
    e = table(spark, d, "events").where("value is not null").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    a, b = (T.peaks(e.where(F.col("event_id") % 2 == i), "user_id", "t", "value") for i in (0, 1))
    j = a.join(b.withColumnsRenamed({"peak": "peak_b", "peak_time": "time_b"}), "user_id")
    return j.select("user_id", F.round(F.col("peak_b") - F.col("peak"), 6).alias("delta"), F.round(F.col("time_b") - F.col("peak_time"), 3).alias("seconds"))


@query("c17_compare_profiles", "with a as (select p_brand, avg(p_retailprice) as v from part where p_partkey % 2 = 0 group by 1), b as (select p_brand, avg(p_retailprice) as v from part where p_partkey % 2 = 1 group by 1) select p_brand, round(b.v - a.v, 6) as delta, a.v is null as missing_base, b.v is null as missing_candidate from a full outer join b using (p_brand)")
def c17_compare_profiles(spark, d):
    p = table(spark, d, "part")
    a, b = (p.where(F.col("p_partkey") % 2 == i).groupBy("p_brand").agg(F.avg("p_retailprice").alias(n)) for i, n in ((0, "va"), (1, "vb")))
    return a.join(b, "p_brand", "full_outer").select("p_brand", F.round(F.col("vb") - F.col("va"), 6).alias("delta"), F.col("va").isNull().alias("missing_base"), F.col("vb").isNull().alias("missing_candidate"))


@query("c18_section_depths", "select s_suppkey, round(s_acctbal - low, 6) as depth from supplier join (select c_nationkey, min(c_acctbal) as low from customer group by 1) on s_nationkey = c_nationkey")
def c18_section_depths(spark, d):
    low = table(spark, d, "customer").groupBy("c_nationkey").agg(F.min("c_acctbal").alias("low"))
    s = table(spark, d, "supplier")
    return s.join(low, s.s_nationkey == low.c_nationkey).select("s_suppkey", F.round(F.col("s_acctbal") - F.col("low"), 6).alias("depth"))


@query("c22_repair_plan", "select doc_id, case when v is null and s is null then 'remove' when v is null then 'reindex' when s is null then 'rebuild' else 'keep' end as action from (select coalesce(a.doc_id, b.doc_id, l.doc_id) as doc_id, a.doc_id as v, b.doc_id as s from (select doc_id from documents where doc_id % 5 <> 0) a full outer join (select doc_id from documents where doc_id % 7 <> 0) b on a.doc_id = b.doc_id full outer join labels l on l.doc_id = coalesce(a.doc_id, b.doc_id))")
def c22_repair_plan(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    a, b = docs.where("doc_id % 5 <> 0").withColumn("v", F.lit(1)), docs.where("doc_id % 7 <> 0").withColumn("s", F.lit(1))
    j = a.join(b, "doc_id", "full_outer").join(table(spark, d, "labels").select("doc_id"), "doc_id", "full_outer")
    action = F.when(F.col("v").isNull() & F.col("s").isNull(), "remove").when(F.col("v").isNull(), "reindex").when(F.col("s").isNull(), "rebuild").otherwise("keep")
    return j.select("doc_id", action.alias("action"))


@query("c24_federated_merge", "with l as (select s_nationkey % 4 as provider, p_partkey, row_number() over (partition by s_nationkey % 4 order by sum(l_quantity) desc, p_partkey) as r from lineitem join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey group by 1, 2) select p_partkey, round(sum((1 + provider * 0.5) / (60 + r)), 6) as score from l where r <= 50 group by 1")
def c24_federated_merge(spark, d):
    li, s = table(spark, d, "lineitem"), table(spark, d, "supplier")
    g = li.join(s, li.l_suppkey == s.s_suppkey).groupBy((F.col("s_nationkey") % 4).alias("provider"), F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("q"))
    g = g.withColumn("r", F.row_number().over(Window.partitionBy("provider").orderBy(F.desc("q"), "p_partkey"))).where("r <= 50")
    return g.groupBy("p_partkey").agg(F.round(F.sum((1 + F.col("provider") * 0.5) / (60 + F.col("r"))), 6).alias("score"))


@query("c25_context_window", "select conv_id, turn, length(coalesce(lag(text) over w, '')) + length(text) + length(coalesce(lead(text) over w, '')) as n_chars from conversations window w as (partition by conv_id order by turn)")
def c25_context_window(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = lambda c: F.length(F.coalesce(c, F.lit("")))
    return table(spark, d, "conversations").select("conv_id", "turn", (n(F.lag("text").over(w)) + F.length("text") + n(F.lead("text").over(w))).alias("n_chars"))


@query("c28_diff_answers", "with a as (select conv_id, turn // 2 as step, md5(text) as h from conversations where role = 'user'), b as (select conv_id, turn // 2 as step, md5(text) as h from conversations where role = 'assistant') select coalesce(a.conv_id, b.conv_id) as conv_id, sum((a.h is null)::int)::bigint as added, sum((b.h is null)::int)::bigint as removed, sum((a.h <> b.h)::int)::bigint as changed from a full outer join b on a.conv_id = b.conv_id and a.step = b.step group by 1")
def c28_diff_answers(spark, d):
    c = table(spark, d, "conversations")
    side = lambda role, n: c.where(F.col("role") == role).select("conv_id", F.floor(F.col("turn") / 2).alias("step"), F.md5("text").alias(n))
    j = side("user", "ha").join(side("assistant", "hb"), ["conv_id", "step"], "full_outer")
    n = lambda x, name: F.sum(x.cast("int")).alias(name)
    return j.groupBy("conv_id").agg(n(F.col("ha").isNull(), "added"), n(F.col("hb").isNull(), "removed"), n(F.col("ha") != F.col("hb"), "changed"))


# fronts, spans and caps


@query("e13_pareto_frontier", "with p as (select s_nationkey as k, round(avg(l_quantity), 2) as q, round(avg(l_discount), 4) as c, round(avg(l_extendedprice), 0) as t from lineitem join supplier on l_suppkey = s_suppkey group by 1) select k, q, c, t from p where not exists (select 1 from p o where o.q >= p.q and o.c <= p.c and o.t <= p.t and (o.q > p.q or o.c < p.c or o.t < p.t))")
def e13_pareto_frontier(spark, d):
    li, s = table(spark, d, "lineitem"), table(spark, d, "supplier")
    p = li.join(s, li.l_suppkey == s.s_suppkey).groupBy(F.col("s_nationkey").alias("k")).agg(F.round(F.avg("l_quantity"), 2).alias("q"), F.round(F.avg("l_discount"), 4).alias("c"), F.round(F.avg("l_extendedprice"), 0).alias("t"))
    return K.frontier(p, "k", ["q"], ["c", "t"])


@query("e19_need_spans", "with s as (select user_id, event_id, value >= 20 as hot, row_number() over (partition by user_id order by event_id) as i, value from events where value is not null), g as (select *, i - row_number() over (partition by user_id, hot order by i) as island from s) select user_id, min(i) as first, count(*) as n, round(avg(value), 6) as mean from g where hot group by user_id, island")
def e19_need_spans(spark, d):
    e = table(spark, d, "events").where("value is not null")
    e = e.withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).withColumn("hot", F.col("value") >= 20)
    return K.runs(e, ["user_id"], "i", "hot").groupBy("user_id", "run").agg(F.min("i").alias("first"), F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).drop("run")


@query("e18_source_trust", "select s_suppkey, round(v + 1e-9, 6) as trust, case when s_acctbal < -500 then 'blocked' when v < 0.4 then 'low' else 'eligible' end as state from (select *, 0.5 * least(greatest(s_acctbal / 10000.0, 0), 1) + 0.3 * (s_nationkey % 5) / 4.0 + 0.2 * (s_suppkey % 3) / 2.0 as v from supplier)")
def e18_source_trust(spark, d):
    v = 0.5 * F.least(F.greatest(F.col("s_acctbal") / 10000.0, F.lit(0.0)), F.lit(1.0)) + 0.3 * (F.col("s_nationkey") % 5) / 4.0 + 0.2 * (F.col("s_suppkey") % 3) / 2.0
    state = F.when(F.col("s_acctbal") < -500, "blocked").when(v < 0.4, "low").otherwise("eligible")
    return table(spark, d, "supplier").select("s_suppkey", F.round(v + 1e-9, 6).alias("trust"), state.alias("state"))


# graphs

_GE = "e as (select distinct l_suppkey as src, l_partkey + 1000000 as dst from lineitem union select distinct l_partkey + 1000000, o_custkey + 9000000 from lineitem join orders on l_orderkey = o_orderkey)"


def edges(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    up = li.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1000000).alias("dst"))
    down = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("l_partkey") + 1000000).alias("src"), (F.col("o_custkey") + 9000000).alias("dst"))
    return up.unionByName(down).distinct()


@query("f2_graph_summary", f"with {_GE} select case when src < 1000000 then 'supplies' else 'sold' end as kind, count(*) as n_edges, count(distinct src) as n_src, count(distinct dst) as n_dst from e group by 1")
def f2_graph_summary(spark, d):
    kind = F.when(F.col("src") < 1000000, "supplies").otherwise("sold")
    return edges(spark, d).groupBy(kind.alias("kind")).agg(F.count("*").alias("n_edges"), F.countDistinct("src").alias("n_src"), F.countDistinct("dst").alias("n_dst"))


@query("f10_impact", f"with {_GE}, r1 as (select distinct a.src as root, a.dst as node from e a where a.src < 1000000), r2 as (select distinct root, e.dst as node from r1 join e on r1.node = e.src) select root, count(*) filter (depth = 1) as direct, count(*) filter (depth = 2) as indirect from (select root, node, 1 as depth from r1 union all select root, node, 2 from r2 where (root, node) not in (select (root, node) from r1)) group by 1")
def f10_impact(spark, d):
    roots = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"))
    h = G.hops(cut(edges(spark, d)), roots, 2, origins=True, once=True).where("depth > 0")
    n = lambda k, name: F.count(F.when(F.col("depth") == k, 1)).alias(name)
    return h.groupBy("root").agg(n(1, "direct"), n(2, "indirect"))


@query("f6_retraction_risk", f"with {_GE}, z as (select s_suppkey as root from supplier where s_suppkey % 4 = 0), h as (select root, root as node, 0 as depth from z union select root, dst, 1 from z join e on src = root union select root, b.dst, 2 from z join e a on a.src = root join e b on b.src = a.dst), m as (select node, min(depth) as depth from h group by 1) select node, depth, round(pow(0.7, depth), 6) as risk, count(distinct root) as n_origins, min(root) as first_origin from h join m using (node, depth) group by 1, 2")
def f6_retraction_risk(spark, d):
    roots = table(spark, d, "supplier").where("s_suppkey % 4 = 0").select(F.col("s_suppkey").alias("node"))
    h = G.nearest_origins(edges(spark, d), roots, 2)
    return h.select("node", "depth", F.round(F.pow(F.lit(0.7), F.col("depth")), 6).alias("risk"), F.size("origins").cast("long").alias("n_origins"), F.array_min("origins").alias("first_origin"))


@query("f3_paths", f"with {_GE} select a.src, b.dst, count(*) as n_paths, min(a.src || '>' || a.dst || '>' || b.dst) as first_path from e a join e b on a.dst = b.src where a.src < 1000000 group by 1, 2")
def f3_paths(spark, d):
    e = cut(edges(spark, d))
    src = table(spark, d, "supplier").select(F.col("s_suppkey").alias("src"))
    return G.paths_of_two(e.join(src, "src", "left_semi"), e.where("dst >= 9000000"))


@query("f5_temporal_status", "select o_orderkey, case when o_orderstatus = 'F' and o_orderdate + interval 200 day <= timestamp '1996-01-01' then 'retracted' when o_orderdate > timestamp '1996-01-01' then 'future' when o_orderdate + interval 900 day <= timestamp '1996-01-01' then 'expired' else 'active' end as status from orders")
def f5_temporal_status(spark, d):
    at, o = F.lit("1996-01-01").cast("timestamp_ntz"), F.col("o_orderdate")
    retracted = F.when(F.col("o_orderstatus") == "F", o + F.expr("interval 200 days"))
    return table(spark, d, "orders").select("o_orderkey", G.status_at(o, o + F.expr("interval 900 days"), retracted, at).alias("status"))


@query("f7_latest_source_status", "select user_id, event_type as status, event_type <> 'error' as usable from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1")
def f7_latest_source_status(spark, d):
    last = V.latest(table(spark, d, "events"), ["user_id"], F.desc("ts"), F.desc("event_id"))
    return last.select("user_id", F.col("event_type").alias("status"), (F.col("event_type") != "error").alias("usable"))


@query("f21_support_clusters", "select l_partkey as target, count(distinct l_suppkey) filter (l_returnflag = 'A') as supports, count(distinct l_suppkey) filter (l_returnflag = 'R') as contradicts from lineitem group by 1")
def f21_support_clusters(spark, d):
    n = lambda k, name: F.countDistinct(F.when(F.col("l_returnflag") == k, F.col("l_suppkey"))).alias(name)
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("target")).agg(n("A", "supports"), n("R", "contradicts"))


@query("f16_hyperedge_projection", "with h as (select l_orderkey as h, l_suppkey as m, count(*) over (partition by l_orderkey) as k from (select distinct l_orderkey, l_suppkey from lineitem)) select a.m as one, b.m as other, round(sum(1.0 / (a.k - 1)), 6) as weight from h a join h b on a.h = b.h and a.m < b.m group by 1, 2")
def f16_hyperedge_projection(spark, d):
    h = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("m"))  # the lines of one order
    pairs = F.explode(F.expr("flatten(transform(m, (x, i) -> transform(slice(m, i + 2, size(m)), y -> struct(x as one, y as other))))"))
    p = h.where(F.size("m") > 1).select(pairs.alias("p"), (1.0 / (F.size("m") - 1)).alias("w"))
    return p.groupBy("p.one", "p.other").agg(F.round(F.sum("w"), 6).alias("weight"))


@query("f24_beliefs", "with b as (select l_partkey as claim, l_suppkey as src, l_returnflag <> 'R' as f, max(l_discount * 5) as s from lineitem group by 1, 2, 3), g as (select claim, 1 - exp(sum(case when f then ln(1 - least(s, 0.999999)) else 0 end)) as a, 1 - exp(sum(case when not f then ln(1 - least(s, 0.999999)) else 0 end)) as c from b group by 1) select claim, round(a + 1e-9, 6) as support, round(c + 1e-9, 6) as contradiction, case when abs(a - c) < 0.15 then 'conflicted' when a > c then 'supported' else 'contradicted' end as status from g")
def f24_beliefs(spark, d):
    li = table(spark, d, "lineitem").withColumnsRenamed({"l_partkey": "claim", "l_suppkey": "src"})
    b = G.beliefs(li, "claim", "src", F.col("l_discount") * 5, F.col("l_returnflag") != "R")
    return b.select("claim", F.round(F.col("support") + 1e-9, 6).alias("support"), F.round(F.col("contradiction") + 1e-9, 6).alias("contradiction"), "status")


# governance


@query("i1_active_judgments", "select user_id, event_type, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as n from events) where n = 1")
def i1_active_judgments(spark, d):
    return V.latest(table(spark, d, "events"), ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "value")


@query("i2_adjudication", "with c as (select l_orderkey as item, l_returnflag as label, count(*) as n from lineitem group by 1, 2), t as (select item, sum(n) as total, max(n) as top, count(*) filter (n = m) as leaders, min(label) filter (n = m) as label from (select *, max(n) over (partition by item) as m from c) group by 1) select item, case when total >= 3 and leaders = 1 and top / total >= 0.6 then label end as gold, case when total >= 3 and leaders = 1 and top / total >= 0.6 then 'gold' else 'open' end as state from t")
def i2_adjudication(spark, d):
    c = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("item"), F.col("l_returnflag").alias("label")).agg(F.count("*").alias("n"))
    c = c.withColumn("m", F.max("n").over(Window.partitionBy("item")))
    lead = F.col("n") == F.col("m")
    t = c.groupBy("item").agg(F.sum("n").alias("total"), F.max("n").alias("top"), F.sum(lead.cast("int")).alias("leaders"), F.min(F.when(lead, F.col("label"))).alias("label"))
    done = (F.col("total") >= 3) & (F.col("leaders") == 1) & (F.col("top") / F.col("total") >= 0.6)
    return t.select("item", F.when(done, F.col("label")).alias("gold"), F.when(done, "gold").otherwise("open").alias("state"))


@query("i3_feedback_batch", "select user_id % 50 as owner, count(*) as examples, count(distinct user_id) as subjects, round(sum(case when event_type = 'error' then -value else value end), 4) as signed_weight from events where value is not null group by 1")
def i3_feedback_batch(spark, d):
    w = F.when(F.col("event_type") == "error", -F.col("value")).otherwise(F.col("value"))
    return table(spark, d, "events").where("value is not null").groupBy((F.col("user_id") % 50).alias("owner")).agg(F.count("*").alias("examples"), F.countDistinct("user_id").alias("subjects"), F.round(F.sum(w), 4).alias("signed_weight"))


@query("i5_current_generation", "select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders) where n = 1")
def i5_current_generation(spark, d):
    return V.latest(table(spark, d, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


@query("i6_retention_plan", "select o_orderkey, case when n <= 2 then 'newest' when o_orderpriority = '1-URGENT' then 'hold' when o_orderstatus = 'O' then 'open' else 'delete' end as reason from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders)")
def i6_retention_plan(spark, d):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    o = table(spark, d, "orders").withColumn("n", n)
    reason = F.when(F.col("n") <= 2, "newest").when(F.col("o_orderpriority") == "1-URGENT", "hold").when(F.col("o_orderstatus") == "O", "open").otherwise("delete")
    return o.select("o_orderkey", reason.alias("reason"))


@query("i9_traffic_assignment", "select user_id, case when u < 0.1 then 'interleaving' when u < 0.5 then 'baseline_only' else 'not_enrolled' end as arm from (select distinct user_id, ('0x' || substr(sha256('salt:spec:' || user_id), 1, 13))::bigint / 4503599627370496.0 as u from events)")
def i9_traffic_assignment(spark, d):
    h = F.sha2(F.concat(F.lit("salt:spec:"), F.col("user_id").cast("string")), 256)
    u = F.conv(F.substring(h, 1, 13), 16, 10).cast("long") / 4503599627370496.0
    arm = F.when(u < 0.1, "interleaving").when(u < 0.5, "baseline_only").otherwise("not_enrolled")
    return table(spark, d, "events").select("user_id").distinct().select("user_id", arm.alias("arm"))


@query("i12_identity_ledger", "select source, count(*) as n, count(distinct md5(text)) as n_texts, count(*) - count(distinct md5(text)) as repeats from documents group by 1")
def i12_identity_ledger(spark, d):
    h = F.countDistinct(F.md5("text"))
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), h.alias("n_texts"), (F.count("*") - h).alias("repeats"))


# event logs

_US = "epoch_us(ts)"


@query("j1_rate_limit", f"select event_id, count(*) over (partition by user_id order by {_US} range between 3599999999 preceding and current row) as recent, count(*) over (partition by user_id order by {_US} range between 3599999999 preceding and current row) <= 3 as allowed from events")
def j1_rate_limit(spark, d):
    return E.rolling_counts(table(spark, d, "events"), "user_id", 3600, 3).select("event_id", "recent", "allowed")


@query("j2_tenant_quota", "select user_id, time_bucket(interval 1 day, ts) as start, count(*) as requests, round(sum(value), 6) as units, round(greatest(0, 50 - coalesce(sum(value), 0)), 6) as remaining from events group by 1, 2")
def j2_tenant_quota(spark, d):
    q = E.tumbling_quota(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "1 day", 50.0)
    return q.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "requests", F.round("units", 6).alias("units"), F.round("remaining", 6).alias("remaining"))


@query("j3_slo", "select user_id % 20 as service, count(*) as n, round(avg((event_type <> 'error')::int), 6) as availability, round(avg((value <= 30)::int), 6) as fast, round(quantile_disc(value, 0.95), 6) as p95, round((0.05 - avg((event_type = 'error')::int)) / 0.05, 6) as budget_left from (select *, row_number() over (partition by user_id % 20 order by ts desc, event_id desc) as r from events where value is not null) where r <= 200 group by 1")
def j3_slo(spark, d):
    svc = F.col("user_id") % 20
    e = table(spark, d, "events").where("value is not null").withColumn("service", svc)
    e = e.withColumn("r", F.row_number().over(Window.partitionBy("service").orderBy(F.desc("ts"), F.desc("event_id")))).where("r <= 200")
    bad = (F.col("event_type") == "error").cast("int")
    return e.groupBy("service").agg(
        F.count("*").alias("n"), F.round(F.avg(1 - bad), 6).alias("availability"), F.round(F.avg((F.col("value") <= 30).cast("int")), 6).alias("fast"),
        F.round(F.expr("percentile_disc(0.95) within group (order by value)"), 6).alias("p95"), F.round((0.05 - F.avg(bad)) / 0.05, 6).alias("budget_left"),
    )


@query("j4_burn_rate", "select user_id % 20 as service, round(avg(b) / 0.05, 6) as long_burn, round(avg(b) filter (ts >= m - interval 2 day) / 0.05, 6) as short_burn, coalesce(avg(b) / 0.05 > 2 and avg(b) filter (ts >= m - interval 2 day) / 0.05 > 2, false) as alert from (select *, (event_type = 'error')::int as b, max(ts) over () as m from events) group by 1")
def j4_burn_rate(spark, d):
    e = table(spark, d, "events")
    e = e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("m")))).withColumn("b", (F.col("event_type") == "error").cast("int"))  # one row
    short = F.avg(F.when(F.col("ts") >= F.col("m") - F.expr("interval 2 days"), F.col("b"))) / 0.05
    long = F.avg("b") / 0.05
    return e.groupBy((F.col("user_id") % 20).alias("service")).agg(F.round(long, 6).alias("long_burn"), F.round(short, 6).alias("short_burn"), F.coalesce((long > 2) & (short > 2), F.lit(False)).alias("alert"))


@query("j5_trace_totals", "select event_type as stage, count(*) as events, sum((event_type = 'error')::int)::bigint as failures, round(sum(value), 4) as duration from events group by rollup (event_type)")
def j5_trace_totals(spark, d):
    e = table(spark, d, "events").withColumn("bad", (F.col("event_type") == "error").cast("int"))
    return e.rollup("event_type").agg(F.count("*").alias("events"), F.sum("bad").alias("failures"), F.round(F.sum("value"), 4).alias("duration")).withColumnRenamed("event_type", "stage")


@query("j6_latest_runs", "select user_id, count(*) as n, sum((event_type = 'error')::int)::bigint as errors, round(avg(value), 6) as mean from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r <= 10 group by 1")
def j6_latest_runs(spark, d):
    e = table(spark, d, "events").withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))).where("r <= 10")
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.sum((F.col("event_type") == "error").cast("int")).alias("errors"), F.round(F.avg("value"), 6).alias("mean"))


@query("j8_trace_retention", "select event_id, r <= 5 as kept from (select event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events)")
def j8_trace_retention(spark, d):
    r = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return table(spark, d, "events").select("event_id", (r <= 5).alias("kept"))


@query("j10_idempotent_events", "select event_id, user_id, event_type from (select *, row_number() over (partition by user_id, event_type, props order by ts, event_id) as n from events) where n = 1")
def j10_idempotent_events(spark, d):
    return E.first_events(table(spark, d, "events"), ["user_id", "event_type", "props"], ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query("j12_dead_letters", "select user_id, count(*) as failed, max(event_id) as last_id from events where event_type = 'error' group by 1")
def j12_dead_letters(spark, d):
    return table(spark, d, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("failed"), F.max("event_id").alias("last_id"))


@query("j16_cache_expiry", "select event_type, sum((ts < m - interval 7 day)::int)::bigint as expired, sum((ts >= m - interval 7 day)::int)::bigint as live from (select *, max(ts) over () as m from events) group by 1")
def j16_cache_expiry(spark, d):
    e = table(spark, d, "events")
    e = e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("m")))).withColumn("old", (F.col("ts") < F.col("m") - F.expr("interval 7 days")).cast("int"))  # one row
    return e.groupBy("event_type").agg(F.sum("old").alias("expired"), F.sum(1 - F.col("old")).alias("live"))


# series

_TS = "s as (select user_id, epoch(ts) as t, value as v, event_id from events where value is not null)"


def points(spark, d):
    return table(spark, d, "events").where("value is not null").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("value").alias("v"), "event_id")


@query("k1_integrate", f"with {_TS} select user_id, round(coalesce(sum(p), 0) / 1000, 3) as volume from (select user_id, (v + lag(v) over w) / 2 * (t - lag(t) over w) as p from s window w as (partition by user_id order by t)) group by 1")
def k1_integrate(spark, d):
    return T.integral(points(spark, d), "user_id", "t", "v").select("user_id", F.round(F.col("volume") / 1000, 3).alias("volume"))


@query("k2_peak", f"with {_TS} select user_id, round(v, 6) as peak, round(t, 3) as peak_time from (select *, row_number() over (partition by user_id order by v desc, t) as n from s) where n = 1")
def k2_peak(spark, d):
    return T.peaks(points(spark, d), "user_id", "t", "v").select("user_id", F.round("peak", 6).alias("peak"), F.round("peak_time", 3).alias("peak_time"))


@query("k5_peak_lag", f"with {_TS}, p as (select * from (select *, row_number() over (partition by user_id order by v desc, t) as n from s) where n = 1) select a.user_id, round(b.t - a.t, 3) as lag_seconds from p a join p b on b.user_id = a.user_id + 1")
def k5_peak_lag(spark, d):
    p = T.peaks(points(spark, d), "user_id", "t", "v").select("user_id", "peak_time")
    q = p.select((F.col("user_id") - 1).alias("user_id"), F.col("peak_time").alias("down"))
    return p.join(q, "user_id").select("user_id", F.round(F.col("down") - F.col("peak_time"), 3).alias("lag_seconds"))


@query("k6_station_order", "select l_orderkey, l_linenumber, l_suppkey from (select *, lag(l_suppkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as before from lineitem) where l_suppkey >= before")
def k6_station_order(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    li = table(spark, d, "lineitem").withColumn("place", F.row_number().over(w))
    return T.neighbours_ordered(li, ["l_orderkey"], "place", "l_suppkey").select("l_orderkey", "l_linenumber", "l_suppkey")


@query("b7_redact_text")
def b7_redact_text(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", redacted(F.col("text")).alias("t"))
    return docs.select("doc_id", F.md5("t").alias("text_md5"), (F.col("t") != F.col("text")).alias("changed"))


@query("b14_semantic_chunks")
def b14_semantic_chunks(spark, d):
    from corpuslens.operators.prepare import semantic_chunks

    return semantic_chunks(table(spark, d, "documents")).select("doc_id", "chunk_no", F.length("chunk").alias("n_chars"))


@query("e3_diverse_selection")
def e3_diverse_selection(spark, d):
    from corpuslens.functions.text import index_tokens
    from corpuslens.plans.retrieval import two_lists

    docs = table(spark, d, "documents").select("doc_id", "source", F.array_distinct(index_tokens(F.col("text"))).alias("tokens"))
    return K.diverse(K.rank_fusion(two_lists(spark, d), {}).join(docs, "doc_id"), 10)


@query("e11_packed_context")
def e11_packed_context(spark, d):
    from corpuslens.plans.retrieval import two_lists

    docs = table(spark, d, "documents").select("doc_id", "source", (F.length("text") / 4).cast("long").alias("n_tokens"))
    return K.packed(K.rank_fusion(two_lists(spark, d), {}).join(docs, "doc_id"), 4000)
