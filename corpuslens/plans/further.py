"""Links, staged matches, node search, graph duties, greedy choices and fusion of scores over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions.numbers import convert
from corpuslens.functions.text import masked_metadata
from corpuslens.operators import assess as A
from corpuslens.operators import evaluation as E
from corpuslens.operators import graph as G
from corpuslens.operators import linking as L
from corpuslens.operators import ranking as K
from corpuslens.operators import retrieval as R
from corpuslens.operators import selection as C
from corpuslens.operators import statistics as S
from corpuslens.operators.lineage import cut
from corpuslens.plans.catalog import query, table
from corpuslens.plans.evaluation import _RANKED, judgements, ranked
from corpuslens.plans.retrieval import _TWO, _bm25, _queries, two_lists
from corpuslens.plans.statistics import _TESTS, tests
from corpuslens.plans.tables import _GE, edges

# parts of documents: an order stands for a document, its lines for the blocks of two pages

_BLOCKS = """b as (select l_orderkey as doc, l_linenumber % 2 as page, l_linenumber * 1000000 + l_partkey as block, l_linestatus, l_returnflag as role, l_suppkey % 5 as hash,
  case when l_suppkey % 3 > 0 then l_returnflag end as label, l_tax * 5 as x0, l_discount * 5 as y0, l_tax * 5 + 0.6 as x1, l_discount * 5 + 0.4 as y1 from lineitem)"""


def _blocks(spark, d):
    c = F.col
    return table(spark, d, "lineitem").select(
        c("l_orderkey").alias("doc"), (c("l_linenumber") % 2).alias("page"), (c("l_linenumber") * 1000000 + c("l_partkey")).alias("block"), "l_linestatus", c("l_returnflag").alias("role"),
        (c("l_suppkey") % 5).alias("hash"), F.when(c("l_suppkey") % 3 > 0, c("l_returnflag")).alias("label"), (c("l_tax") * 5).alias("x0"), (c("l_discount") * 5).alias("y0"),
        (c("l_tax") * 5 + 0.6).alias("x1"), (c("l_discount") * 5 + 0.4).alias("y1"),
    )


@query("c26_region_blocks", f"""with {_BLOCKS}, j as (select r.doc, r.block as region, b.block, greatest(0, least(r.x1, b.x1) - greatest(r.x0, b.x0)) * greatest(0, least(r.y1, b.y1) - greatest(r.y0, b.y0)) as shared,
    (r.x1 - r.x0) * (r.y1 - r.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) as areas, (r.hash = b.hash)::int + 0.25::double * (r.role = b.role)::int as more
    from b r join b on r.doc = b.doc and r.page = b.page and r.l_linestatus = 'O' and b.l_linestatus = 'F'),
  s as (select doc, region, block, round(shared / (areas - shared) + more, 9) as score from j), t as (select * from s where score >= 0.2),
  m as (select *, max(score) over (partition by doc, region) as best from t)
  select doc, region, min(block) as block, round(score, 6) as score from m where score = best group by doc, region, score having count(*) = 1""")
def c26_region_blocks(spark, d):
    b = _blocks(spark, d)
    got = L.region_blocks(b.where("l_linestatus = 'O'").withColumnRenamed("block", "region"), b.where("l_linestatus = 'F'"))
    return got.withColumn("score", F.round("score", 6))


@query("i23_caption_links", f"""with {_BLOCKS}, j as (select c.doc, c.block as caption, t.block as target, coalesce(c.label = t.label, false) as named,
    least(abs(c.y0 - t.y1), abs(t.y0 - c.y1)) + 0.25 * abs((c.x0 + c.x1 - t.x0 - t.x1) / 2) as gap from b c join b t on c.doc = t.doc and c.page = t.page and c.l_linestatus = 'O' and t.l_linestatus = 'F'),
  s as (select *, round(case when named then 0 else gap end, 9) as distance from j),
  m as (select *, row_number() over (partition by doc, caption order by distance, target, named) as n from s)
  select doc, caption, target, case when named then 0.98 when distance <= 0.08 then 0.85 else 0.65 end::double as confidence from m where n = 1 and (named or distance <= 0.18)""")
def i23_caption_links(spark, d):
    b = _blocks(spark, d)
    return L.caption_links(b.where("l_linestatus = 'O'").withColumnRenamed("block", "caption"), b.where("l_linestatus = 'F'").withColumnRenamed("block", "target"))


@query("c36_reference_links", """with b as (select doc_id as doc, unnest(range(1, len(l) + 1)) as block, unnest(l) as text from (select doc_id, string_split(text, chr(10)) as l from documents)),
  o as (select doc, regexp_extract(text, '^([A-Z][a-z]+)', 1) as label, min(block) as target from b group by 1, 2 having label <> ''),
  m as (select distinct doc, block, unnest(regexp_extract_all(text, '([A-Z][a-z]+)')) as label from b)
  select distinct doc, block, target from m join o using (doc, label) where block <> target""")
def c36_reference_links(spark, d):
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("block", "text"))
    lines = lines.withColumn("block", F.col("block") + 1)
    return L.reference_links(lines, F.regexp_extract("text", "^([A-Z][a-z]+)", 1), "([A-Z][a-z]+)")


@query("i18_table_chains", """select doc, page, block, sum(s) over (partition by doc order by page, block)::bigint as chain from (
  select *, case when coalesce(lag(page) over w = page - 1 and lag(role) over w is not distinct from role, false) then 0 else 1 end as s from (
    select l_orderkey as doc, l_linenumber as page, l_partkey * 100000 + l_suppkey as block, l_returnflag as role from lineitem) window w as (partition by doc order by page, block))""")
def i18_table_chains(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"), (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("block"), F.col("l_returnflag").alias("role"))
    return L.chained_tables(t, ["role"]).select("doc", "page", "block", "chain")


# staged matches, points and corrections

_PLACES = """c as (select c_custkey as id, case when c_custkey % 3 = 0 then c_custkey end as own, c_nationkey as nation, floor(c_acctbal / 100)::bigint as band, c_acctbal as x, c_nationkey * 100.0::double as y, c_nationkey % 5 as crs from customer),
  p as (select s_suppkey as target, s_nationkey as nation, floor(s_acctbal / 100)::bigint as band, s_acctbal as x, s_nationkey * 100.0::double as y, s_nationkey % 5 as crs from supplier)"""


def _places(spark, d):
    def place(name, key, prefix, out):
        nation, balance = F.col(f"{prefix}_nationkey"), F.col(f"{prefix}_acctbal")
        return table(spark, d, name).select(F.col(key).alias(out), nation.alias("nation"), F.floor(balance / 100).alias("band"), balance.alias("x"), (nation * 100.0).alias("y"), (nation % 5).alias("crs"))

    c = place("customer", "c_custkey", "c", "id").withColumn("own", F.when(F.col("id") % 3 == 0, F.col("id")))
    return c, place("supplier", "s_suppkey", "s", "target")


@query("c35_cross_sections", f"""with {_PLACES}, a as (select id, count(distinct target) as n, min(target) as t from c join p on own = target group by 1),
  b as (select id, count(distinct target) as n, min(target) as t from c join p on c.nation = p.nation and c.band = p.band group by 1),
  s as (select id, count(distinct target) as n, min(target) as t from c join p on c.band = p.band group by 1)
  select id, case when coalesce(a.n, b.n, s.n) = 1 then coalesce(a.t, b.t, s.t) end as target,
    case when coalesce(a.n, b.n, s.n) > 1 then 'ambiguous' when a.n = 1 then 'id' when b.n = 1 then 'name' when s.n = 1 then 'station' else 'unmatched' end as how
  from c left join a using (id) left join b using (id) left join s using (id)""")
def c35_cross_sections(spark, d):
    c, p = _places(spark, d)
    return L.staged_match(c, p, [("id", [("own", "target")]), ("name", [("nation", "nation"), ("band", "band")]), ("station", [("band", "band")])])


@query("c20_structures", f"""with {_PLACES}, a as (select id, count(distinct target) as n, min(target) as t from c join p on own = target group by 1),
  b as (select id, count(distinct target) as n, min(target) as t from c join p on c.crs = p.crs and round(sqrt((c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y)), 6) <= 150 group by 1),
  s as (select id, count(distinct target) as n, min(target) as t from c join p on c.nation = p.nation group by 1)
  select id, case when coalesce(a.n, b.n, s.n) = 1 then coalesce(a.t, b.t, s.t) end as target,
    case when coalesce(a.n, b.n, s.n) > 1 then 'ambiguous' when a.n = 1 then 'id' when b.n = 1 then 'distance' when s.n = 1 then 'name' else 'unmatched' end as how
  from c left join a using (id) left join b using (id) left join s using (id)""")
def c20_structures(spark, d):
    c, p = _places(spark, d)
    near = L.near_points(c, p.withColumnRenamed("target", "node"), 150.0).select(F.col("id").alias("at"), F.col("node").alias("target"))
    known = cut(L.staged_match(c, p, [("id", [("own", "target")])]))
    rest = c.join(known.where("how = 'unmatched'").select("id"), "id", "left_semi")
    close = cut(L.staged_match(rest, near, [("distance", [("id", "at")])]))  # pairs are met once
    last = L.staged_match(rest.join(close.where("how = 'unmatched'").select("id"), "id", "left_semi"), p, [("name", [("nation", "nation")])])
    return known.where("how <> 'unmatched'").unionByName(close.where("how <> 'unmatched'")).unionByName(last)


@query("c27_corrections", """select d.doc_id as id, case when hit then 'q' || quality else lang end as value, hit as applied from (
  select d.doc_id, lang, quality, coalesce(l.doc_id is not null and sha256(coalesce(lang, '')) = sha256(case when d.doc_id % 2 = 0 then 'en' else 'xx' end), false) as hit from documents d left join labels l using (doc_id)) d""")
def c27_corrections(spark, d):
    records = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("value"))
    previous = F.sha2(F.when(F.col("doc_id") % 2 == 0, "en").otherwise("xx"), 256)
    corrected = F.concat(F.lit("q"), F.col("quality").cast("string"))
    return L.apply_corrections(records, table(spark, d, "labels").select(F.col("doc_id").alias("id"), previous.alias("previous"), corrected.alias("corrected"), F.lit(1).alias("at")))


@query("c33_series_records", "select user_id, event_type, min(epoch_us(ts)) as first, max(epoch_us(ts)) as last, count(*) as n, any_value(c_name) as location from events left join customer on user_id = c_custkey and c_custkey % 2 = 0 group by 1, 2")
def c33_series_records(spark, d):
    e = table(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    known = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("alias"), F.col("c_name").alias("location"))
    return L.series_records(e, known, ["user_id", "event_type"], "at", "user_id")


@query("b8_masked_metadata")
def b8_masked_metadata(spark, d):
    p = table(spark, d, "pages").select("page_id", F.explode(F.create_map(F.lit("url"), F.col("url"), F.lit("html"), F.col("html"))).alias("field", "value"))
    p = p.withColumn("masked", masked_metadata(F.col("value")))
    return p.select("page_id", "field", F.md5("masked").alias("masked_md5"), (F.col("masked") != F.col("value")).alias("changed"))


# node search


def _node_sql(where, score):
    words = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
    return f"""with q as (select p_partkey as query_id, list_distinct({words.format('p_name')}) as terms, {words.format('p_name')} as whole from part where p_partkey % 100 = 0),
  a as (select query_id, len(terms) as n_terms, unnest(terms) as term, (select string_agg(w, ' ') from (select unnest(whole) as w)) as phrase from q),
  n as (select p_partkey as node, p_type as type, lower(p_name) as low, p_size / 100.0 as risk, {words.format('p_name')} as in_label, unnest({words.format("p_name || ' ' || p_brand")}) as term from part {where}),
  h as (select node, type, low, risk, in_label, term, count(*) as tf from n group by all),
  g as (select query_id, node, type, low, n_terms, phrase, risk, sum((case when list_contains(in_label, term) then 1.5 else 0 end)::double + 1 + ln(1 + tf)) as s, count(*) as matched from h join a using (term) group by 1, 2, 3, 4, 5, 6, 7),
  r as (select query_id, node, type, low, round({score}, 9) as score from g)
  select query_id, node, round(score, 6) as score, position from (select *, row_number() over (partition by query_id order by score desc, type, low, node) as position from r) where position <= 20"""


_NODE_SCORE = "(case when phrase = low then 2.0 else 0 end::double + s + matched / n_terms + case when type = 'ECONOMY' then 0.25 else 0 end::double)"


def _node_tables(spark, d):
    p = table(spark, d, "part")
    nodes = p.select(F.col("p_partkey").alias("node"), F.col("p_type").alias("type"), F.col("p_name").alias("label"), F.col("p_brand").alias("text"), (F.col("p_size") / 100.0).alias("risk"))
    return p.where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("text")), nodes


@query("d19_node_search", _node_sql("", _NODE_SCORE))
def d19_node_search(spark, d):
    return L.search_nodes(*_node_tables(spark, d), favoured=("ECONOMY",)).withColumn("score", F.round("score", 6))


@query("d20_governed_node_search", _node_sql("where not p_size > 45", f"{_NODE_SCORE} * greatest(0, 1 - 0.5 * risk)"))
def d20_governed_node_search(spark, d):
    got = L.search_nodes(*_node_tables(spark, d), favoured=("ECONOMY",), exclude=F.col("risk") > 0.45, penalty=0.5)
    return got.withColumn("score", F.round("score", 6))


# graphs


@query("f31_neighbours_across", f"with {_GE} select src, dst, case when src < 1000000 then 'supplies' else 'sold' end as kind, src % 7 as src_doc, dst % 7 as dst_doc from e where src % 7 <> dst % 7 and src < 1000000")
def f31_neighbours_across(spark, d):
    return G.neighbours_across(_typed(spark, d), _owners(spark, d), ("supplies",))


def _typed(spark, d):
    return edges(spark, d).withColumn("kind", F.when(F.col("src") < 1000000, "supplies").otherwise("sold"))


def _owners(spark, d):
    e = edges(spark, d)
    return e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().withColumn("doc", F.col("node") % 7)


@query("f12_paths_across", """with s as (select s_suppkey as node from supplier where s_suppkey % 100 = 0),
  a as materialized (select distinct node, l_partkey + 1000000 as part from s join lineitem on l_suppkey = node where node % 7 <> (l_partkey + 1000000) % 7),
  m as materialized (select distinct part from a), l as materialized (select part, l_orderkey from m join lineitem on l_partkey + 1000000 = part),
  b as materialized (select distinct part, o_custkey + 9000000 as cust from l join orders on l_orderkey = o_orderkey where part % 7 <> (o_custkey + 9000000) % 7)
  select [node, part, cust] as path, 2 as length from a join b using (part)""")
def f12_paths_across(spark, d):
    x = G.neighbours_across(_typed(spark, d), _owners(spark, d))
    sources = table(spark, d, "supplier").where("s_suppkey % 100 = 0").select(F.col("s_suppkey").cast("long").alias("node"))
    targets = table(spark, d, "customer").select((F.col("c_custkey") + 9000000).alias("node"))
    return G.simple_paths(x, sources, targets, 2)


@query("f11_invalidated", f"""with {_GE}, s as (select s_suppkey as root from supplier where s_suppkey % 10 = 0), r1 as (select distinct root, dst as node from s join e on root = src), r2 as (select distinct root, e.dst as node from r1 join e on r1.node = e.src),
  a as (select root, node, min(depth) as depth from (select root, root as node, 0 as depth from s union all select *, 1 from r1 union all select *, 2 from r2) group by 1, 2)
  select root, node, depth, node between 1000000 and 8999999 as recompute, count(*) over (partition by root) > 500 as over from a""")
def f11_invalidated(spark, d):
    events = table(spark, d, "supplier").where("s_suppkey % 10 = 0").select(F.col("s_suppkey").alias("node"))
    return G.invalidated(edges(spark, d), events, 2, F.col("node").between(1000000, 8999999), 500)


@query("f14_support", f"""with {_GE}, u as (select src, dst, 0.5 + (src + dst) % 5 / 10.0 as c from e), b as (select * from u union all select dst, src, c from u), s as (select c_custkey + 9000000 as node from customer where c_custkey % 100 = 0),
  p1 as (select node as seed, dst, c from s join b on src = node), p2 as (select seed, b.dst, p1.c * b.c as c from p1 join b on b.src = p1.dst where b.dst <> seed),
  a as (select seed, dst, max(x) as score from (select seed, dst, c / 1.15 as x from p1 union all select seed, dst, c / 1.3 from p2) group by 1, 2),
  t as (select * from (select *, row_number() over (partition by seed order by round(score, 9) desc, dst) as position from a) where position <= 50),
  k as (select t.seed, t.dst, score, p_brand as source from t join part on dst = p_partkey + 1000000),
  n as (select *, row_number() over (partition by seed, source order by round(score, 9) desc, dst) as n from k)
  select seed, dst, source, round(score, 6) as score, position from (select *, row_number() over (partition by seed order by round(score, 9) desc, dst) as position from n where n <= 2) where position <= 5""")
def f14_support(spark, d):
    e = edges(spark, d).withColumn("confidence", 0.5 + (F.col("src") + F.col("dst")) % 5 / 10.0)
    seeds = table(spark, d, "customer").where("c_custkey % 100 = 0").select((F.col("c_custkey") + 9000000).alias("node"))
    kinds = table(spark, d, "part").select((F.col("p_partkey") + 1000000).alias("dst"), F.lit("part").alias("kind"), F.col("p_brand").alias("source"))
    return G.support_of(G.scored_paths(e, seeds, 2, 50), kinds, ("part",), 2, 5).withColumn("score", F.round("score", 6))


@query("f22_proofs", """with k as (select distinct l_suppkey, l_partkey from lineitem where l_returnflag = 'A')
  select l_orderkey, count(*) as n, round(avg((coalesce(p_size <= 40, false))::int), 6) as node_coverage, round(avg((k.l_suppkey is not null)::int), 6) as edge_coverage,
    coalesce(list_sort(list_distinct(list(l.l_partkey) filter (not coalesce(p_size <= 40, false)))), []) as missing, bool_and(coalesce(p_size <= 40, false)) and bool_and(k.l_suppkey is not null) as valid
  from lineitem l left join part on l.l_partkey = p_partkey left join k on l.l_suppkey = k.l_suppkey and l.l_partkey = k.l_partkey group by 1""")
def f22_proofs(spark, d):
    li = table(spark, d, "lineitem")
    pairs = li.select("l_orderkey", "l_returnflag", F.col("l_partkey").alias("node"), F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    known = table(spark, d, "part").where("p_size <= 40").select(F.col("p_partkey").alias("node"))
    report = G.proof_report(pairs.drop("l_returnflag"), known, pairs.where("l_returnflag = 'A'"), "l_orderkey")
    return report.withColumns({c: F.round(c, 6) for c in ("node_coverage", "edge_coverage")})


@query("f26_retention", """with recursive h as (select event_id as id from events where event_id % 500 = 0 union select id // 8 from h),
  a as (select event_id as id, epoch_us(ts) / 1e6 as sec, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as nth from events)
  select id, case when id in (select id from h) then 'protected' when nth <= 2 then 'latest' when (select max(sec) from a) - sec < 432000 then 'young' else 'deletable' end as reason from a""")
def f26_retention(spark, d):
    e = table(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    a = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("owner"), F.col("event_type").alias("kind"), "at").crossJoin(F.broadcast(e.agg(F.max("at").alias("now"))))  # one row
    parents = e.select(F.col("event_id").alias("src"), F.floor(F.col("event_id") / 8).alias("dst")).where("src <> dst")
    return G.retention(a, parents, e.where("event_id % 500 = 0").select(F.col("event_id").alias("node")), F.col("now"), 2, 432000, 8)


@query("f27_claim_readiness", """select l_orderkey, coalesce(list_sort(list_distinct(list(l_linenumber) filter (l_returnflag = 'R'))), []) as reviewed, coalesce(list_sort(list_distinct(list(l_linenumber) filter (l_returnflag = 'A'))), []) as unreviewed,
  coalesce(list_sort(list_distinct(list(l_linenumber) filter (l_returnflag = 'N'))), []) as unknown, bool_and(l_returnflag = 'R') as ready from lineitem group by 1""")
def f27_claim_readiness(spark, d):
    return G.readiness(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", "reviewed").when(F.col("l_returnflag") == "A", "unreviewed"))


@query("f35_negative_controls", """select user_id, count(distinct event_type) filter (value >= 20) as n_reviewed, count(distinct event_type) filter (value < 5) as n_unreviewed, count(distinct event_type) filter (value >= 5 and value < 20 or value is null) as n_unknown,
  count(*) filter (value >= 20) > 0 and count(*) filter (value < 20 or value is null) = 0 as ready from events group by 1""")
def f35_negative_controls(spark, d):
    state = F.when(F.col("value") >= 20, "reviewed").when(F.col("value") < 5, "unreviewed")
    g = G.readiness(table(spark, d, "events"), "user_id", "event_type", state)
    return g.select("user_id", *[F.size(c).alias(f"n_{c}") for c in ("reviewed", "unreviewed", "unknown")], "ready")


@query("f29_node_status", """with s as (select o_custkey, o_orderstatus, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderstatus desc) as n from orders)
  select c_custkey, coalesce(o_orderstatus, 'unknown') as status, coalesce(o_orderstatus <> 'F', true) as usable from customer left join s on c_custkey = o_custkey and n = 1""")
def f29_node_status(spark, d):
    statuses = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", F.col("o_orderstatus").alias("status"))
    return G.annotated(table(spark, d, "customer").select("c_custkey"), statuses, "c_custkey", "o_orderdate", "status", F.col("status") != "F")


@query("f32_hyperedges", """with m as (select l_orderkey, 'supplier' as role, l_suppkey::varchar as member from lineitem union select l_orderkey, 'part', l_partkey::varchar from lineitem)
  select l_orderkey, role, list(member order by member) as members, sha256(l_orderkey || '|' || role || '|' || string_agg(member, ',' order by member)) as role_id from m group by 1, 2""")
def f32_hyperedges(spark, d):
    members = table(spark, d, "lineitem").select("l_orderkey", F.explode(F.create_map(F.lit("supplier"), F.col("l_suppkey"), F.lit("part"), F.col("l_partkey"))).alias("role", "member"))
    return G.hyperedges(members, "l_orderkey", "role", "member")


@query("f33_reranked_paths", """select user_id, event_id, round(score, 6) as score, position from (select *, row_number() over (partition by user_id order by score desc, event_id) as position from (
  select user_id, event_id, coalesce((quality + toxic) / 2, value / 100) as score from events left join labels on event_id = doc_id)) where position <= 5""")
def f33_reranked_paths(spark, d):
    paths = table(spark, d, "events").select("user_id", "event_id", (F.col("value") / 100).alias("path_score"))
    given = table(spark, d, "labels").select(F.col("doc_id").alias("event_id"), ((F.col("quality") + F.col("toxic")) / 2).alias("given"))
    return G.reranked_paths(paths, given, "user_id", "event_id", 5).select("user_id", "event_id", F.round("score", 6).alias("score"), "position")


@query("f34_network", """select l_suppkey as src, l_partkey as dst, case when l_linestatus = 'O' then 'reach' else 'diversion' end as kind, round(sum(l_quantity * case l_returnflag when 'A' then 1000.0 when 'R' then 0.3048 else 1.0 end), 4) as length_m, count(*) as n from lineitem group by 1, 2, 3""")
def f34_network(spark, d):
    unit = F.when(F.col("l_returnflag") == "A", "km").when(F.col("l_returnflag") == "R", "ft").otherwise("m")
    li = convert(table(spark, d, "lineitem").withColumn("unit", unit), "l_quantity", "unit", F.lit("m"), "length")
    kind = F.when(F.col("l_linestatus") == "O", "reach").otherwise("diversion")
    return li.groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), kind.alias("kind")).agg(F.round(F.sum("length"), 4).alias("length_m"), F.count("*").alias("n"))


# evaluation and gates

_REPORT = f"""with {_RANKED}, j as (select coalesce(r.query_id, g.query_id) as query_id, (r.doc_id is not null and g.doc_id is not null)::int as hit, r.doc_id is not null as a, g.doc_id is not null as b from ranked r full outer join qrels g on r.query_id = g.query_id and r.doc_id = g.doc_id),
  c as (select query_id, sum(hit) as h, count(*) filter (a) as n, count(*) filter (b) as m from j group by 1),
  p as (select query_id, case when n > 0 then h / n when m = 0 then 1 else 0 end::double as precision, case when m > 0 then h / m when n = 0 then 1 else 0 end::double as recall from c),
  f as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from p)"""


@query("g33_graph_selection", f"{_REPORT} select query_id, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from f")
def g33_graph_selection(spark, d):
    r = E.topic_report(ranked(spark, d), *judgements(spark, d))
    return r.select("query_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("g34_graph_means", f"{_REPORT} select count(*) as n, round(avg(precision), 6) as precision, round(avg(recall), 6) as recall, round(avg(f1), 6) as f1 from f")
def g34_graph_means(spark, d):
    r = E.topic_report(ranked(spark, d), *judgements(spark, d))
    return r.agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1")])


@query("g52_series_summary", "select event_type, count(*) as n, count(distinct user_id) as scenarios, list_sort(list_distinct(list(case when value >= 50 then 'high' else 'low' end))) as kinds from events group by 1")
def g52_series_summary(spark, d):
    e = table(spark, d, "events").withColumn("kind", F.when(F.col("value") >= 50, "high").otherwise("low"))
    return A.series_summary(e, ["event_type"], "user_id", "kind")


_BIN = "case when {0} >= 0 and {0} < 10 then 0 when {0} < 25 then 1 when {0} < 50 then 2 when {0} <= 1000 then 3 end"


@query("h24_profile_drift", f"""with b as (select event_type, event_id % 2 as half, {_BIN.format('value')} as bin from events where value >= 0 and value <= 1000), n as (select event_type, half, bin, count(*) as n from b group by 1, 2, 3),
  s as (select *, n / sum(n) over (partition by event_type, half) as share from n),
  j as (select coalesce(x.event_type, y.event_type) as event_type, coalesce(x.share, 0) as r, coalesce(y.share, 0) as c from (select * from s where half = 0) x full outer join (select * from s where half = 1) y on x.event_type = y.event_type and x.bin = y.bin)
  select event_type, round(sum((greatest(c, 1e-6) - greatest(r, 1e-6)) * ln(greatest(c, 1e-6) / greatest(r, 1e-6))), 6) as psi,
    round(sum((case when r > 0 then r * log2(2 * r / (r + c)) else 0 end + case when c > 0 then c * log2(2 * c / (r + c)) else 0 end) / 2), 6) as jsd from j group by 1""")
def h24_profile_drift(spark, d):
    e = table(spark, d, "events")
    g = A.drift_by_profile(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), [0.0, 10.0, 25.0, 50.0, 1000.0], "event_type", "value")
    return g.select("event_type", F.round("psi", 6).alias("psi"), F.round("jsd", 6).alias("jsd"))


@query("h63_promotions", f"""with {_TESTS}, r as (select *, least(1.0, (count(*) over (partition by fam) - row_number() over (partition by fam order by p, test) + 1) * p) as raw from t),
  a as (select fam, test, max(raw) over (partition by fam order by p, test) as adjusted from r)
  select fam, count(*) filter (adjusted <= 0.02) as n_passed, bool_and(adjusted <= 0.02) as promoted from a group by 1""")
def h63_promotions(spark, d):
    adjusted = S.holm(tests(spark, d), ("fam",))
    return adjusted.groupBy("fam").agg(F.count(F.when(F.col("adjusted") <= 0.02, 1)).alias("n_passed"), F.bool_and(F.col("adjusted") <= 0.02).alias("promoted"))


@query("i19_admissible_claims", """select l_orderkey, claim, count(distinct l_suppkey) as cited, count(distinct case when s_acctbal > 0 then l_suppkey end) as admitted, count(distinct case when s_acctbal > 0 then l_suppkey end) >= 2 as kept
  from (select l_orderkey, l_linenumber % 2 as claim, l_suppkey from lineitem) left join supplier on l_suppkey = s_suppkey group by 1, 2""")
def i19_admissible_claims(spark, d):
    li = table(spark, d, "lineitem").withColumn("claim", F.col("l_linenumber") % 2)
    trust = table(spark, d, "supplier").select(F.col("s_suppkey").alias("source"), (F.col("s_acctbal") > 0).alias("admitted"))
    return A.admissible_claims(li, trust, "l_orderkey", "claim", "l_suppkey", 2)


# fusion of scores and greedy choices: pools come from searches of the documents with the benchmark's texts

_SCORES = f"{_TWO}, sc as (select 'dense' as list, query_id, doc_id, cosine0 as p from (select query_id, doc_id, position, cosine as cosine0 from found) where position <= 20 union all select 'lexical', query_id, doc_id, round(score, 6) from bm where position <= 20)"


def _scored_lists(spark, d, k=20):
    docs = table(spark, d, "documents")
    dense = R.search(_queries(spark, d), docs, top_k=k).select(F.lit("dense").alias("list"), "query_id", "doc_id", F.round("cosine", 6).alias("score"))
    lexical = R.top_k(_bm25(spark, d, k), k).select(F.lit("lexical").alias("list"), "query_id", "doc_id", F.round("score", 6).alias("score"))
    return dense.unionByName(lexical)


_CLIP = "least(greatest(least(greatest(p, 0), 1), 1e-6), 1 - 1e-6)"


@query("e7_calibrated_fusion", f"""with {_SCORES}, c as (select query_id, doc_id, case when list = 'dense' then 0.6::double else 0.4::double end as w, 1 / (1 + exp(-(ln({_CLIP} / (1 - {_CLIP})) / case when list = 'dense' then 1.5 else 0.8 end::double + case when list = 'dense' then 0.1 else -0.2 end::double))) as v from sc)
  select query_id, doc_id, round(sum(w * v) / sum(w), 6) as score from c group by 1, 2""")
def e7_calibrated_fusion(spark, d):
    fused = K.weighted_scores(_scored_lists(spark, d), {"dense": 0.6, "lexical": 0.4}, {"dense": (1.5, 0.1), "lexical": (0.8, -0.2)})
    return fused.select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query("e6_logit_fusion", f"""with {_SCORES}, c as (select query_id, doc_id, case when list = 'dense' then 0.6::double else 0.4::double end as w, {_CLIP} as v from sc),
  f as (select query_id, doc_id, 1 / (1 + exp(-sum(w * ln(v / (1 - v))) / sum(w))) as s from c group by 1, 2), g as (select f.*, source from f join documents using (doc_id)),
  r as (select *, row_number() over (partition by query_id, source order by round(s, 9) desc, doc_id desc) as n from g)
  select query_id, doc_id, round(s, 6) as score, position from (select *, row_number() over (partition by query_id order by round(s, 9) desc, doc_id desc) as position from r where n <= 3) where position <= 10""")
def e6_logit_fusion(spark, d):
    fused = K.weighted_scores(_scored_lists(spark, d), {"dense": 0.6, "lexical": 0.4}, logit=True)
    fused = fused.join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return K.capped(fused, 10, 3).select("query_id", "doc_id", F.round("score", 6).alias("score"), "position")


def _tokens(spark, d):
    from corpuslens.functions.text import index_tokens

    return table(spark, d, "documents").select("doc_id", "source", F.array_distinct(index_tokens(F.col("text"))).alias("tokens"))


@query("e4_hybrid_ranking")
def e4_hybrid_ranking(spark, d):
    fused = K.weighted_scores(_scored_lists(spark, d), {"dense": 0.45, "lexical": 0.40})
    return K.diverse(fused.join(_tokens(spark, d), "doc_id"), 5, 0.82, 3)


@query("e8_advanced_ranking")
def e8_advanced_ranking(spark, d):
    lists = _scored_lists(spark, d)
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), 1)).alias("asked"))
    pool = lists.select("query_id", "doc_id").distinct().join(_tokens(spark, d), "doc_id").join(q, "query_id")
    rerank = A.heuristic_scores(pool, "asked", "tokens").select(F.lit("rerank").alias("list"), "query_id", "doc_id", "score")
    fused = K.weighted_scores(lists.unionByName(rerank), {"dense": 0.35, "lexical": 0.3, "rerank": 0.35}, {"dense": (1.5, 0.1), "lexical": (0.8, -0.2)})
    return K.diverse(fused.join(_tokens(spark, d), "doc_id"), 10, 0.75, 3)


@query("e12_packed_evidence")
def e12_packed_evidence(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.greatest(F.lit(1), F.ceil(F.length("text") / 4)).alias("n_tokens"), F.md5("text").alias("kin"))
    toxic = table(spark, d, "labels").select("doc_id", F.col("toxic").cast("double").alias("risk"))
    pool = K.rank_fusion(two_lists(spark, d), {}).join(docs, "doc_id").join(toxic, "doc_id", "left")
    return C.packed_evidence(pool, 4000)


@query("e22_team_draft")
def e22_team_draft(spark, d):
    lists = two_lists(spark, d)
    return C.team_draft(lists.select("query_id", F.when(F.col("list") == "dense", "a").otherwise("b").alias("team"), "doc_id", F.col("position").alias("rank")), 10, "s1")


def _evidence(spark, d):
    e, claims = F.col("event_id"), lambda a, b: F.array(F.col("event_id") % a, 20 + F.col("event_id") % b)
    return table(spark, d, "events").select(F.col("user_id").alias("question"), e.alias("evidence"), F.col("event_type").alias("root"), (F.col("value") / 100).alias("score"), claims(7, 11).alias("claims"), F.when(F.col("event_type") == "error", claims(5, 3)).otherwise(F.array().cast("array<bigint>")).alias("contradicts"))


@query("e16_evidence_cover")
def e16_evidence_cover(spark, d):
    return C.evidence_cover(_evidence(spark, d))


@query("g26_cover_report")
def g26_cover_report(spark, d):
    e = _evidence(spark, d)
    needed = e.select("question").distinct().withColumn("claims", F.sequence(F.lit(0), F.lit(30)).cast("array<bigint>"))
    return C.cover_report(e, C.evidence_cover(e), needed)


@query("e17_labelling_batch")
def e17_labelling_batch(spark, d):
    e = F.col("event_id")
    signal = 0.6 * F.col("value") / 100 + 0.4 * (e % 7) / 7
    pool = table(spark, d, "events").select(F.col("user_id").alias("owner"), e.alias("item"), F.col("event_type").alias("task"), (e % 5).alias("label_group"), (signal / F.sqrt(1.0 + e % 4)).alias("score"), (F.col("value") / 100).alias("uncertainty"), (1.0 + e % 4).alias("cost"))
    done = table(spark, d, "labels").select(F.col("doc_id").alias("item"))
    return C.labelling_batch(pool.join(done, "item", "left_anti"), 12, 20.0, 3, 4)


@query("i21_refined_citations")
def i21_refined_citations(spark, d):
    c = F.col
    rows = table(spark, d, "lineitem").select(
        c("l_orderkey").alias("claim"), c("l_partkey").alias("evidence"), c("l_suppkey").alias("source"), (1 - c("l_discount") * 8).alias("p_support"), (c("l_tax") * 7).alias("p_against"),
        (c("l_quantity") / 50).alias("quality"), (c("l_returnflag") == "A").alias("cited"),
    )
    return C.refined_citations(rows, 3, 0.7, 2).withColumn("combined", F.round("combined", 6))
