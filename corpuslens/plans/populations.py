"""Populations, logged episodes, routes, formula symbols and figure panels over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuslens.operators import evaluation as E
from corpuslens.operators import graphsets as S
from corpuslens.operators import linking as L
from corpuslens.operators import populations as P
from corpuslens.operators.lineage import shared_path
from corpuslens.plans.catalog import query, table
from corpuslens.sources import importing as I

NOW = "1999-06-01"

_LINES = "u as (select * from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_extendedprice, l_quantity) = 1)"


def numbered(spark, d):
    """The lines of orders, the first where several have one number."""
    first = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return table(spark, d, "lineitem").withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")


# a population is a supplier's lines of one flag and year; the last year is what is wanted

_POPULATIONS = f"""l as (select l_returnflag as kind, l_suppkey::varchar as name, year(l_shipdate)::bigint as generation, count(*) as n, max(epoch(l_shipdate)) as made, sum(l_linenumber)::bigint as x from lineitem group by all),
  ph as (select kind, name, kind || name || ':' || generation as id, case x % 5 when 0 then 'building' when 1 then 'failed' else 'ready' end as state, generation, (x % 7 = 6)::int as profile, (x % 11 = 10)::int as sch, 0 as src, n, kind || generation as population, made, x % 13 = 0 as safe, x % 17 = 0 as flying from l),
  de as (select kind, name, max(generation) as generation, arg_max(n, generation) - (arg_max(x, generation) % 19 = 5)::int as n, kind || max(generation) as population from l where name <> '1' group by kind, name),
  al as (select kind, name, kind || name || ':' || (max(generation) - max(x) % 2) as id, max(n) as revision from l group by kind, name having max(x) % 3 > 0)"""


def populations(spark, d):
    """``desired``, ``physical`` and ``aliases`` of ``population_plan``."""
    l = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("kind"), F.col("l_suppkey").cast("string").alias("name"), F.year("l_shipdate").cast("long").alias("generation")).agg(
        F.count("*").alias("n"), F.max(F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 1e6).alias("created_at"), F.sum("l_linenumber").alias("x")
    )
    x, flag = F.col("x"), lambda c: c.cast("int")
    physical = l.select(
        "kind", "name", F.concat("kind", "name", F.lit(":"), "generation").alias("physical_id"), F.when(x % 5 == 0, "building").when(x % 5 == 1, "failed").otherwise("ready").alias("state"),
        "generation", flag(x % 7 == 6).alias("profile"), flag(x % 11 == 10).alias("schema"), F.lit(0).alias("source"), "n", F.concat("kind", "generation").alias("population"), "created_at",
        (x % 13 == 0).alias("protected"), (x % 17 == 0).alias("in_flight"),
    )
    last = l.groupBy("kind", "name").agg(F.max("generation").alias("generation"), F.max_by("n", "generation").alias("n"), F.max_by("x", "generation").alias("x"), F.max("x").alias("most"), F.max("n").alias("revision"))
    zero = lambda c: F.lit(0).alias(c)
    desired = last.where("name <> '1'").select("kind", "name", "generation", zero("profile"), zero("schema"), zero("source"), (F.col("n") - flag(x % 19 == 5)).alias("n"), F.concat("kind", "generation").alias("population"))
    aliases = last.where("most % 3 > 0").select("kind", "name", F.concat("kind", "name", F.lit(":"), F.col("generation") - F.col("most") % 2).alias("physical_id"), "revision")
    return desired, physical, aliases


@query("j18_population_plan", f"""with {_POPULATIONS},
  c as (select ph.*, ph.state = 'ready' and ph.generation = de.generation and profile = 0 and sch = 0 and ph.n = de.n as exact, ph.state = 'building' and (ph.population = de.population or flying) as building,
    ph.generation <> de.generation as g_off, profile <> 0 as p_off, sch <> 0 as s_off from ph join de using (kind, name)),
  k as (select de.kind, de.name, min(c.id) filter (exact) as ready, min(c.id) filter (building) as flight, count(c.id) as cands, bool_or(c.state = 'failed') as failed, bool_or(g_off) as g_off, bool_or(p_off) as p_off, bool_or(s_off) as s_off,
    any_value(al.id) as alias, any_value(al.revision) as revision, coalesce(bool_or(exact and c.id = al.id), false) as bound from de left join c on c.kind = de.kind and c.name = de.name left join al on al.kind = de.kind and al.name = de.name group by all),
  t as (select *, case when bound then 'healthy' when ready is not null then case when alias is null then 'alias_missing' else 'alias_stale' end when flight is not null then 'population_in_flight' when cands = 0 then 'missing'
    when failed then 'failed_population' when g_off then 'generation_drift' when p_off then 'profile_drift' when s_off then 'schema_drift' else 'count_drift' end as status from k),
  o as (select kind, name, id, case when id in (select id from al) then 'live_orphan' when safe or flying or epoch(timestamp '{NOW}') - made < 31536000 then 'protected_orphan' else 'orphan_candidate' end as status from ph
    where id not in (select id from c where exact) and id not in (select flight from k where ready is null and flight is not null))
  select kind, name, status, case when bound then alias else coalesce(ready, flight) end as physical_id, case when status in ('alias_missing', 'alias_stale') then 'bind_alias' when status not in ('healthy', 'population_in_flight') then 'populate' end as action,
    case when status in ('alias_missing', 'alias_stale') then alias end as expected_id, case when status in ('alias_missing', 'alias_stale') then coalesce(revision, 0) end::bigint as expected_revision from t
  union all select kind, name, status, id, case when status = 'orphan_candidate' then 'record_orphan_candidate' end, null, null from o""")
def j18_population_plan(spark, d):
    return P.population_plan(*populations(spark, d), F.unix_micros(F.lit(NOW).cast("timestamp")) / 1e6, 31_536_000.0)


# an episode is a user; what the user's events come to is its outcome

_ACTIONS = "when event_type in ('view', 'click') then 'retrieve' when event_type = 'purchase' then 'answer' else 'verify' end"


@query("g27_episode_report", f"""with s as (select user_id as u, case {_ACTIONS} as a, case when event_id % 3 > 0 then case when value > 60 then 'retrieve' when value > 30 then 'answer' else 'verify' end end as o,
    least(value / 200, 1) as p, value / 100 - 0.4 as gain, event_id % 10 as cost, value * 3 as lat, event_id % 50 as tok from events where event_type <> 'signup'),
  f as (select user_id as u, bool_or(event_type = 'purchase' and value > 100) as s, bool_or(event_type = 'error' and value > 150) as c, count(*) filter (event_type = 'view') < 12 as b, avg(value) / 100 as ut, case when user_id % 4 > 0 then max(value) / 300 end as ou from events group by 1),
  e as (select count(*) as episodes, avg(s::int) as supported_rate, avg(c::int) as contradiction_rate, avg(b::int) as abstention_rate, avg(ut) as mean_utility, avg(greatest(0, ou - ut)) filter (ou is not null) as mean_regret from f)
  select any_value(episodes) as episodes, count(*) as steps, round(avg((a = o)::int) filter (o is not null), 9) as action_accuracy, round(count(*) filter (a = 'retrieve' and o = 'retrieve') / count(*) filter (a = 'retrieve' and o is not null), 9) as retrieve_precision,
    round(count(*) filter (a = 'retrieve' and o = 'retrieve') / count(*) filter (o = 'retrieve'), 9) as retrieve_recall, round(count(*) filter (a = 'retrieve') / any_value(episodes), 9) as mean_retrievals,
    round(avg((gain > 0.1)::int) filter (a = 'retrieve'), 9) as useful_rate, round(avg((gain <= 0.1)::int) filter (a = 'retrieve'), 9) as unnecessary_rate, round(avg(gain) filter (a = 'retrieve'), 6) as mean_gain, round(avg(cost) filter (a = 'retrieve'), 6) as mean_cost,
    round(avg(lat), 6) as mean_latency, round(avg(tok), 6) as mean_tokens, round(any_value(supported_rate), 9) as supported_rate, round(any_value(contradiction_rate), 9) as contradiction_rate, round(any_value(abstention_rate), 9) as abstention_rate,
    round(any_value(mean_utility), 6) as mean_utility, round(any_value(mean_regret), 6) as mean_regret, round(avg(power(p - (a = o)::int, 2)) filter (o is not null), 6) as brier from s, e""")
def g27_episode_report(spark, d):
    e = table(spark, d, "events")
    v, i = F.col("value"), F.col("event_id")
    steps = e.where("event_type <> 'signup'").select(
        F.col("user_id").alias("episode"), i.alias("step"), F.expr(f"case {_ACTIONS}").alias("action"), F.when(i % 3 > 0, F.when(v > 60, "retrieve").when(v > 30, "answer").otherwise("verify")).alias("oracle_action"),
        F.least(v / 200, F.lit(1.0)).alias("probability"), (v / 100 - 0.4).alias("gain"), (i % 10).alias("cost"), (v * 3).alias("latency"), (i % 50).alias("tokens"),
    )
    any_of = lambda kind, least: F.max((F.col("event_type") == kind) & (v > least))
    outcomes = e.groupBy(F.col("user_id").alias("episode")).agg(
        any_of("purchase", 100).alias("supported"), any_of("error", 150).alias("contradicted"), (F.count_if(F.col("event_type") == "view") < 12).alias("abstained"),
        (F.avg(v) / 100).alias("utility"), F.when(F.col("user_id") % 4 > 0, F.max(v) / 300).alias("oracle_utility"),
    )
    got = P.episode_report(steps, outcomes, 0.1)
    six = ("mean_gain", "mean_cost", "mean_latency", "mean_tokens", "mean_utility", "mean_regret", "brier")
    return got.select(*[c if c in ("episodes", "steps") else F.round(c, 6 if c in six else 9).alias(c) for c in got.columns])


# a case is an order, each of its lines the run of a route; the order's priority and customer stand for the analysis

_ROUTES = ("corpus-hybrid", "corpus-sparse", "dense", "scholarly", "web")
_RUNS = f"""{_LINES}, r as (select o_orderkey as c, ['corpus-hybrid', 'corpus-sparse', 'dense', 'scholarly', 'web'][(l_linenumber - 1) % 5 + 1] as route, l_tax * 10 as suf, l_tax >= 0.06 as enough, (l_partkey % 4)::int as hits, case when o_orderkey % 3 > 0 then 4 else 0 end as rel,
    l_quantity * 30 as cost, l_extendedprice / 10 as lat, l_partkey % 29 = 0 as failed, case when o_custkey % 3 = 0 then 'dense' when o_custkey % 3 = 1 then case when o_custkey % 2 = 0 or o_orderpriority like '1%' then 'scholarly' else 'web' end
      when o_orderpriority like '2%' then 'corpus-sparse' when o_orderpriority like '3%' then 'web' when not o_orderpriority like '4%' and (o_custkey % 2 = 0 or o_orderpriority like '1%') then 'scholarly' else 'corpus-hybrid' end as pref
    from u join orders on l_orderkey = o_orderkey where l_linenumber <= 5),
  q as (select *, greatest(0, least(1, 0.65 * suf + 0.35 * case when rel > 0 then hits / rel else suf end)) as quality0 from r),
  s as (select *, round(quality0, 9) as quality, round(quality0 - 0.05 * least(cost / 1000, 1) - 0.05 * least(lat / 10000, 1), 9) as utility, not failed and case when rel > 0 then hits > 0 else enough end as success from q),
  w as (select *, row_number() over (partition by c order by utility desc, quality desc, cost, lat, route desc) as best, row_number() over (partition by c order by case when route = pref then 0 else list_position(['corpus-hybrid', 'corpus-sparse', 'dense', 'scholarly', 'web'], route) end) as own from s),
  x as (select a.c, a.route as selected_route, b.route as best_route, a.success, b.success as best_success, a.route = b.route as correct, round(greatest(0, b.utility - a.utility), 9) as regret, a.cost, a.lat from w a join w b on a.c = b.c and a.own = 1 and b.best = 1)"""


def route_runs(spark, d):
    o, l = table(spark, d, "orders"), numbered(spark, d).where("l_linenumber <= 5")
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    third, urgent = F.col("o_custkey") % 3, lambda p: F.col("o_orderpriority").startswith(p)
    preferred = P.preferred_route(
        F.when(third == 0, "uploaded").when(third == 1, "public").otherwise("mixed"), F.when(F.col("o_custkey") % 2 == 0, "scholarly").otherwise("general"),
        urgent("2"), urgent("3"), urgent("4"), urgent("1"), F.lit("dense"),
    )
    return j.select(
        F.col("o_orderkey").alias("case"), F.get(F.array(*map(F.lit, _ROUTES)), (F.col("l_linenumber") - 1) % 5).alias("route"), preferred.alias("preferred"), (F.col("l_tax") * 10).alias("sufficiency"), (F.col("l_tax") >= 0.06).alias("enough"),
        (F.col("l_partkey") % 4).cast("int").alias("hits"), F.when(F.col("o_orderkey") % 3 > 0, 4).otherwise(0).alias("relevant"), (F.col("l_quantity") * 30).alias("cost"), (F.col("l_extendedprice") / 10).alias("latency"), (F.col("l_partkey") % 29 == 0).alias("failed"),
    )


@query("e21_route_cases", f'with {_RUNS} select c as "case", selected_route, best_route, success, best_success, correct, round(regret, 6) as regret from x')
def e21_route_cases(spark, d):
    got = P.route_cases(route_runs(spark, d))
    return got.select("case", "selected_route", "best_route", "success", "best_success", "correct", F.round("regret", 6).alias("regret"))


@query("e21_route_report", f"""with {_RUNS} select count(*) as cases, round(avg(success::int), 9) as selected_success, round(avg(best_success::int), 9) as oracle_success, round(avg(correct::int), 9) as accuracy,
  round(avg(regret), 6) as mean_regret, round(avg(cost), 6) as mean_cost, round(avg(lat), 4) as mean_latency from x""")
def e21_route_report(spark, d):
    got = P.route_report(P.route_cases(route_runs(spark, d)))
    return got.select("cases", *[F.round(c, 4 if c == "mean_latency" else 6 if c.startswith("mean") else 9).alias(c) for c in got.columns[1:]])


# lines are blocks in reading order, each fifth stands for a formula

_WORD = r"""(?i)(?:\bwhere\b|\bwith\b|\blet\b|\bdenote(?:s|d)?\b)?\s*([A-Za-z][A-Za-z0-9_]{0,31}|[α-ωΑ-Ω])\s+(?:is|denotes|represents|means|=)\s+([^.;]{2,300})"""


@query("c37_formula_symbols", f"""with b as (select doc_id as doc, unnest(range(1, len(l) + 1)) as pos, unnest(l) as text from (select doc_id, string_split(text, chr(10)) as l from documents)),
  f as (select *, lower(text) as held from b where pos % 5 = 0), p as (select * from b where pos % 5 > 0),
  m as (select doc, pos, unnest(a) as symbol, unnest(z) as def, unnest(range(len(a))) as nth from (select doc, pos, regexp_extract_all(text, '{_WORD}', 1) as a, regexp_extract_all(text, '{_WORD}', 2) as z from p)),
  s as (select doc, pos, symbol, arg_min(trim(regexp_replace(def, '\\s+', ' ', 'g')), nth) as definition from m group by all)
  select doc, pos as formula, regexp_extract(text, '^([A-Za-z]+)', 1) as symbol, text as definition, pos as source, 1.0::double as confidence from f where pos % 10 = 0 and regexp_matches(text, '^[A-Za-z]')
  union all select f.doc, f.pos, symbol, definition, s.pos, 0.82::double from s join f on s.doc = f.doc and abs(s.pos - f.pos) <= 4 where contains(held, lower(symbol))""")
def c37_formula_symbols(spark, d):
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("position", "text"))
    lines = lines.withColumn("position", F.col("position").cast("long") + 1).withColumn("block", F.col("position"))
    first = F.regexp_extract("text", "^([A-Za-z]+)", 1)
    own = F.when((F.col("position") % 10 == 0) & (first != ""), F.create_map(first, "text"))
    return L.formula_symbols(lines.where("position % 5 > 0"), lines.where("position % 5 = 0").withColumn("symbols", own))


# an order is a document, its open lines are figures with three panels, the others are captions

_PANELS = _LINES + """, f as (select l_orderkey as doc, l_linenumber // 4 as page, l_linenumber as figure, case when l_partkey % 3 = 0 then 'Figure (A) tax ' || (l_tax * 100)::int || '; (b)  part ' || l_partkey end as own from u where l_linestatus = 'O'),
  p as (select *, unnest(['(A)', 'b', ' ( R ) ', '()']) as label, unnest([0, 1, 2, 3]) as panel from f),
  c as (select l_orderkey as doc, l_linenumber // 4 as page, l_linenumber as block, case when l_partkey % 2 = 0 then '(' || lower(l_returnflag) || ') quantity ' || l_quantity::int || '; (B) supplier ' || l_suppkey else 'as before' end as text from u where l_linestatus = 'F'),
  m as (select doc, page, block, unnest(a) as letter, unnest(z) as def, unnest(range(len(a))) as nth from (select doc, page, block, regexp_extract_all(text, '(?:^|[\\s,;])\\(?([A-Za-z])\\)\\s*([^;]{0,300})', 1) as a, regexp_extract_all(text, '(?:^|[\\s,;])\\(?([A-Za-z])\\)\\s*([^;]{0,300})', 2) as z from c)),
  g as (select doc, page, lower(letter) as key, arg_min({'d': trim(regexp_replace(def, '\\s+', ' ', 'g')), 'b': block}, block * 1000 + nth) as v from m group by all),
  q as (select *, replace(replace(replace(lower(label), '(', ''), ')', ''), ' ', '') as key from p), j as (select q.*, v.d as d, v.b as b from q left join g using (doc, page, key) where key <> ''),
  s as (select *, case when own is not null and key = 'a' then regexp_extract(own, '(tax [0-9]+)', 1) when own is not null and key = 'b' then regexp_extract(own, '(part [0-9]+)', 1) end as mine from j)
"""


@query("c38_figure_panels", f"with {_PANELS} select doc, figure, panel, label, coalesce(mine, d, '') as description, case when mine is not null then figure else coalesce(b, figure) end as evidence, case when coalesce(mine, d, '') <> '' then 0.92 else 0.70 end::double as confidence from s")
def c38_figure_panels(spark, d):
    l = numbered(spark, d).select("*", F.col("l_orderkey").alias("doc"), F.floor(F.col("l_linenumber") / 4).cast("int").alias("page"))
    whole = lambda c: F.round(c).cast("int")
    own = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("Figure (A) tax "), whole(F.col("l_tax") * 100), F.lit("; (b)  part "), "l_partkey"))
    labels = F.array(*map(F.lit, ("(A)", "b", " ( R ) ", "()")))
    panels = l.where("l_linestatus = 'O'").select("doc", "page", F.col("l_linenumber").alias("figure"), own.alias("caption"), F.posexplode(labels).alias("panel", "label"))
    text = F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("("), F.lower("l_returnflag"), F.lit(") quantity "), whole("l_quantity"), F.lit("; (B) supplier "), "l_suppkey")).otherwise("as before")
    return L.figure_panels(panels, l.where("l_linestatus = 'F'").select("doc", "page", F.col("l_linenumber").alias("position"), F.col("l_linenumber").alias("block"), text.alias("text")))


# each document is a member, its lines are nodes; the first lines of neighbouring documents are related


def _joined(*parts):
    return "sha256(" + " || ".join(f"length(coalesce(({p})::varchar, '')) || ':' || coalesce(({p})::varchar, '')" for p in parts) + ")"


@query("f28_graph_set", f"""with m as (select doc_id as doc, 1 as generation, sha256(text) as content, source as profile, md5(text) as graph from documents),
  d as (select {_joined("doc", "generation", "content", "profile", "graph")} as d from m), t as (select count(*) as n, sum(('0x' || substr(sha256(d), 1, 15))::hugeint)::varchar as digest from d),
  k as (select {_joined("'corpus'", "n", "digest")} as set_id from t),
  n as (select doc, generation, graph, 1 as node, 'LINE' as type, sha256(split_part(text, chr(10), 1)) as provenance from m join documents on doc = doc_id), h as (select doc, {_joined("doc", "generation", "graph", "node", "type", "provenance")} as reference from n),
  r as (select a.doc_id || '>' || b.doc_id as relation, a.doc_id as source_doc, b.doc_id as target_doc, case when a.lang = b.lang then 'SUPPORTS' else 'CITES' end as type from documents a join documents b on b.doc_id = a.doc_id + 1)
  select {_joined("set_id", "s.reference", "t.reference", "type", "relation")} as edge_id, set_id, relation, source_doc, target_doc, type from r join h s on source_doc = s.doc join h t on target_doc = t.doc, k""")
def f28_graph_set(spark, d):
    docs = table(spark, d, "documents")
    lines = docs.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("node", "line"))
    nodes = lines.select("doc", (F.col("node") + 1).alias("node"), F.lit("LINE").alias("type"), F.sha2("line", 256).alias("provenance"))
    members = docs.select(F.col("doc_id").alias("doc"), F.lit(1).alias("generation"), F.sha2("text", 256).alias("content"), F.col("source").alias("profile"), F.md5("text").alias("graph"), F.lit(True).alias("current"))
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("lang").alias("next_lang"))
    relations = docs.join(after, "doc_id").select(
        F.concat("doc_id", F.lit(">"), F.col("doc_id") + 1).alias("relation"), F.col("doc_id").alias("source_doc"), F.lit(1).alias("source"), (F.col("doc_id") + 1).alias("target_doc"), F.lit(1).alias("target"),
        F.when(F.col("lang") == F.col("next_lang"), "SUPPORTS").otherwise("CITES").alias("type"), F.lit(1.0).alias("weight"),
    )
    return S.graph_set_edges(members, nodes, relations, "corpus").select("edge_id", "set_id", "relation", "source_doc", "target_doc", "type")


@query("g24_visual_support", """with s as (select l_orderkey as claim, l_discount * 10 as e, l_tax * 10 as c, l_returnflag = 'R' as out from lineitem),
  b as (select claim, max(e) filter (not out) as e, max(c) filter (not out) as c, count(*) as n, count(*) filter (out) as o from s group by 1),
  v as (select *, c >= 0.7 and c > e as against from b)
  select count(*) as claims, sum(n)::bigint as evidence, round(count(e) / count(*), 9) as coverage, round(avg(e), 9) as mean_entailment, round(avg((not against and e >= 0.5)::int), 9) as supported, round(avg(against::int), 9) as contradicted,
    round(avg((not against and e < 0.5)::int), 9) as unsupported, round(sum(o) / sum(n), 9) as abstained from v""")
def g24_visual_support(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("claim_id"), (F.col("l_discount") * 10).alias("entail"), (F.col("l_tax") * 10).alias("contra"), (F.col("l_returnflag") == "R").alias("abstained"))
    got = E.visual_support(s)
    return got.select("claims", "evidence", *[F.round(c, 9).alias(c) for c in got.columns[2:]])


# a part is an item, its lines are cases, rounds the years in which they were shipped


@query("i27_gold_labels", """with c as (select l_partkey as item, l_orderkey * 10 + l_linenumber as id, year(l_shipdate)::int as round, case when l_suppkey % 3 = 0 then 'relevance' else 'support' end as task, case when l_linestatus = 'F' then 'resolved' else 'open' end as state, l_returnflag as label, sha256(l_suppkey::varchar) as evidence from lineitem),
  g as (select * from c qualify row_number() over (partition by item order by round desc, id desc, task desc, state desc, label desc, evidence desc) = 1), k as (select * from g where state = 'resolved' and task = 'support'),
  r as (select count(*) as n, sum(('0x' || substr(sha256(item || '|' || id || '|' || evidence || '|' || label || '|v1|' || round), 1, 15))::hugeint)::varchar as digest from k)
  select item, id as "case", label, round, n, digest from k, r""")
def i27_gold_labels(spark, d):
    l = table(spark, d, "lineitem")
    cases = l.select(
        F.col("l_partkey").alias("item"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("case"), F.year("l_shipdate").alias("round"), F.when(F.col("l_suppkey") % 3 == 0, "relevance").otherwise("support").alias("task"),
        F.when(F.col("l_linestatus") == "F", "resolved").otherwise("open").alias("state"), F.col("l_returnflag").alias("label"), F.lit("v1").alias("schema"), F.sha2(F.col("l_suppkey").cast("string"), 256).alias("evidence"),
    )
    labels, path = I.gold_labels(cases, "support"), shared_path(spark, "gold")
    receipt = I.write_gold(labels, path)
    return spark.read.schema(labels.schema).json(path).select("item", "case", "label", "round").join(F.broadcast(receipt), F.lit(True))  # one row
