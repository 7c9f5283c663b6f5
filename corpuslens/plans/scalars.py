"""Projections and scalar functions over documents, pages, conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions import text as X
from corpuslens.plans.catalog import query, table

STOP_SQL = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
TOKENS_SQL = rf"""list_filter(regexp_extract_all(lower(text), '{X.INDEX_TOKEN}'), lambda t: t not in ({STOP_SQL})
  and (length(t) > 1 or regexp_matches(t, '^[0-9]$') or t in ('x', 'y', 'z', 'r', 'p', 'q')))"""
FIELD_TOKENS_SQL = rf"regexp_extract_all(lower(text), '{X.FIELD_TOKEN}')"
WORDS_SQL = r"list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')"


@query(
    "b1_tokenize",
    f"""select doc_id, len(t) as n_tokens, len(list_distinct(t)) as n_terms, md5(array_to_string(t, ' ')) as tokens_md5
        from (select doc_id, {TOKENS_SQL} as t from documents)""",
)
def b1_tokenize(spark, d):
    t = table(spark, d, "documents").select("doc_id", X.index_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_terms"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query(
    "b2_snippet",
    f"""select doc_id, array_to_string(w[1:40], ' ') || case when len(w) > 40 then '…' else '' end as snippet
        from (select doc_id, {WORDS_SQL} as w from documents)""",
)
def b2_snippet(spark, d):
    return table(spark, d, "documents").select("doc_id", X.snippet(F.col("text")).alias("snippet"))


_URL = r"""select *, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) as scheme,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^#]*)', 1) as rest from pages"""
_URL = f"""select *, regexp_extract(rest, '^([^/?]*)', 1) as authority, regexp_extract(rest, '^[^/?]*([^?]*)', 1) as path0,
  regexp_extract(rest, '\\?(.*)$', 1) as q from ({_URL})"""
_TRACK = ", ".join(f"'{t}'" for t in X.TRACKING)


@query(
    "b3_normalize_url",
    f"""with p as ({_URL}), k as (select *, lower(regexp_extract(authority, '^([^:]*)', 1)) as host,
          regexp_extract(authority, ':([0-9]+)$', 1) as port,
          regexp_replace(case when path0 = '' then '/' else path0 end, '/+', '/', 'g') as path1,
          list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' and lower(string_split(x, '=')[1]) not in ({_TRACK}))) as kept from p)
        select page_id, case when scheme in ('http', 'https') and host <> '' and not contains(authority, '@') then
          scheme || '://' || host || case when port = '' or (scheme = 'http' and port = '80') or (scheme = 'https' and port = '443') then '' else ':' || port end
          || case when path1 <> '/' and ends_with(path1, '/') then regexp_replace(path1, '/$', '') else path1 end
          || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end end as url from k""",
)
def b3_normalize_url(spark, d):
    return table(spark, d, "pages").select("page_id", X.normalized_url(F.col("url")).alias("url"))


TRUSTED = ("example.org", "example.net", "org")


@query(
    "b4_trusted_domain",
    f"""select page_id, host, list_bool_or(list_transform(['example.org', 'example.net', 'org'], lambda s: host = s or ends_with(host, '.' || s))) as trusted
        from (select page_id, lower(regexp_extract(authority, '^([^:]*)', 1)) as host from ({_URL}))""",
)
def b4_trusted_domain(spark, d):
    """Hosts' suffixes are joined to the list of trusted ones: an equi-join, not a test of every pair."""
    pages = table(spark, d, "pages").select("page_id", X.url_host(F.col("url")).alias("host"))
    trusted = spark.createDataFrame([(s,) for s in TRUSTED], "suffix string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    good = pages.select("page_id", F.explode(suffixes).alias("suffix")).join(trusted, "suffix", "left_semi").select("page_id").distinct()
    return pages.join(good.withColumn("trusted", F.lit(True)), "page_id", "left").select("page_id", "host", F.coalesce("trusted", F.lit(False)).alias("trusted"))


@query(
    "b5_page_content",
    r"""with t as (select page_id, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) as title, html,
          trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) as body from pages)
        select page_id, title, length(body) as n_chars, md5(body) as body_md5, len(regexp_extract_all(html, '(?i)href="([^"#]*)"', 1)) as n_links
        from t where length(body) >= 512""",
)
def b5_page_content(spark, d):
    h = F.col("html")
    pages = table(spark, d, "pages").select("page_id", X.page_title(h).alias("title"), X.plain_text(h).alias("body"), F.size(X.page_links(h)).alias("n_links"))
    return pages.where(F.length("body") >= 512).select("page_id", "title", F.length("body").alias("n_chars"), F.md5("body").alias("body_md5"), "n_links")


@query(
    "b6_field_tokens",
    f"""select conv_id, turn, len(t) as n_tokens, md5(array_to_string(t, ' ')) as tokens_md5
        from (select conv_id, turn, {FIELD_TOKENS_SQL} as t from conversations)""",
)
def b6_field_tokens(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", X.field_tokens(F.col("text")).alias("t"))
    return t.select("conv_id", "turn", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


def _signals(docs):
    from corpuslens.operators.governance import injection_signals

    return injection_signals(docs)


_SIGNAL_SQL = " union all ".join(
    f"select doc_id, '{k}' as signal, len(regexp_extract_all(text, '{p}')) as n from documents" for k, p in X.INJECTION
)


@query("b11_injection_signals", f"select doc_id, signal, n, round(least(1.0, 0.55 + 0.15 * n), 6) as severity from ({_SIGNAL_SQL}) where n > 0")
def b11_injection_signals(spark, d):
    return _signals(table(spark, d, "documents"))


@query(
    "b12_content_trust",
    f"""with s as (select doc_id, n, least(1.0, 0.55 + 0.15 * n) as severity from ({_SIGNAL_SQL}) where n > 0),
        g as (select doc_id, count(*) as signals, max(severity) as worst from s group by 1)
        select doc_id, coalesce(signals, 0) as signals, round(coalesce(worst, 0), 6) as worst,
          case when coalesce(worst, 0) >= 0.85 then 'quarantine' when coalesce(signals, 0) >= 2 then 'review'
               when coalesce(signals, 0) = 1 then 'allow_with_warning' else 'allow_as_evidence' end as action
        from documents left join g using (doc_id)""",
)
def b12_content_trust(spark, d):
    from corpuslens.operators.governance import content_trust

    return content_trust(table(spark, d, "documents"))


@query(
    "b13_academic_metadata",
    r"""select doc_id, nullif(rtrim(regexp_extract(s, '(?i)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+\b'), '.,;)'), '') as doi,
          nullif(regexp_extract(s, '\b(?:19|20)\d{2}\b'), '') as year,
          list_filter(list_transform(string_split(s, chr(10)), lambda x: trim(x)), lambda x: length(x) between 5 and 300
            and lower(trim(x, ':')) not in ('abstract', 'introduction', 'methods', 'results', 'references'))[1] as title
        from (select doc_id, substring(text, 1, 8000) as s from documents)""",
)
def b13_academic_metadata(spark, d):
    s = F.substring("text", 1, 8000)
    lines = F.transform(F.split(s, "\n"), lambda x: F.trim(x))
    heads = ("abstract", "introduction", "methods", "results", "references")
    title = F.filter(lines, lambda x: F.length(x).between(5, 300) & ~F.lower(F.btrim(x, F.lit(":"))).isin(*heads))
    none = lambda c: F.when(c != "", c)
    return table(spark, d, "documents").select(
        "doc_id",
        none(F.rtrim(F.regexp_extract(s, r"(?i)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+\b", 0), F.lit(".,;)"))).alias("doi"),
        none(F.regexp_extract(s, r"\b(?:19|20)\d{2}\b", 0)).alias("year"),
        F.try_element_at(title, F.lit(1)).alias("title"),
    )


@query(
    "b15_fixed_chunks",
    r"""select doc_id, chunk_no, sha256(doc_id || chr(31) || chunk_no || chr(31) || chunk) as chunk_id, length(chunk) as n_chars from (
          select doc_id, i as chunk_no, substring(text, i * 880 + 1, 1000) as chunk
          from (select doc_id, text, unnest(range(0, greatest(1, ceil((length(text) - 120) / 880.0)::int))) as i from documents where text <> ''))""",
)
def b15_fixed_chunks(spark, d):
    from corpuslens.operators.prepare import fixed_chunks

    return fixed_chunks(table(spark, d, "documents"), size=1000, overlap=120).select("doc_id", "chunk_no", "chunk_id", F.length("chunk").alias("n_chars"))


@query(
    "b17_temporal_expression",
    r"""with e as (select event_id, case event_id % 6 when 0 then strftime(ts, '%Y-%m-%d') when 1 then strftime(ts, '%Y-%m') when 2 then strftime(ts, '%Y')
            when 3 then strftime(ts, '%Y') || ' to ' || (year(ts) + 2) when 4 then 'last ' || (1 + event_id % 50) || ' days' else 'next week' end as expression, ts::date as ref from events)
        select event_id, case when regexp_full_match(expression, '\d{4}-\d{2}-\d{2}') then expression::date
            when regexp_full_match(expression, '\d{4}-\d{2}') then (expression || '-01')::date
            when regexp_full_match(expression, '\d{4}( to \d{4})?') then (expression[1:4] || '-01-01')::date
            when expression like 'last %' then ref - regexp_extract(expression, '\d+')::int end as start_date,
          case when regexp_full_match(expression, '\d{4}-\d{2}-\d{2}') then expression::date + 1
            when regexp_full_match(expression, '\d{4}-\d{2}') then ((expression || '-01')::date + interval 1 month)::date
            when regexp_full_match(expression, '\d{4}') then ((expression || '-01-01')::date + interval 1 year)::date
            when regexp_full_match(expression, '\d{4} to \d{4}') then ((expression[9:12] || '-01-01')::date + interval 1 year)::date
            when expression like 'last %' then ref end as end_date,
          case when regexp_full_match(expression, '\d{4}-\d{2}-\d{2}') then 'day' when regexp_full_match(expression, '\d{4}-\d{2}') then 'month'
            when regexp_full_match(expression, '\d{4}') then 'year' when regexp_full_match(expression, '\d{4} to \d{4}') then 'range'
            when expression like 'last %' then 'relative' end as precision from e""",
)
def b17_temporal_expression(spark, d):
    from corpuslens.functions.dates import temporal_interval

    k = F.col("event_id") % 6
    year = F.date_format("ts", "yyyy")
    expression = (
        F.when(k == 0, F.date_format("ts", "yyyy-MM-dd")).when(k == 1, F.date_format("ts", "yyyy-MM")).when(k == 2, year)
        .when(k == 3, F.concat(year, F.lit(" to "), (F.year("ts") + 2).cast("string")))
        .when(k == 4, F.concat(F.lit("last "), (1 + F.col("event_id") % 50).cast("string"), F.lit(" days"))).otherwise("next week")
    )
    e = table(spark, d, "events").select("event_id", expression.alias("expression"), F.to_date("ts").alias("ref"))
    return e.select("event_id", temporal_interval(F.col("expression"), F.col("ref")).alias("i")).select("event_id", "i.*")


_FLAGS = {
    "comparative": "compare versus vs difference better worse contrast",
    "temporal": "latest recent before after trend year timeline changed",
    "quantitative": "effect estimate rate risk ratio percent confidence p-value",
    "citation": "cite citation source evidence paper reference",
    "explanatory": "why how explain mechanism cause reason",
}


def _flag_sql(k):
    return f"list_has_any(t, [{', '.join(repr(w) for w in _FLAGS[k].split())}])"


@query(
    "b20_query_analysis",
    f"""with q as (select conv_id, turn, {FIELD_TOKENS_SQL} as t from conversations where role = 'user'),
        f as (select *, {", ".join(f"{_flag_sql(k)} as {k}" for k in _FLAGS)} from q)
        select conv_id, turn, len(t) as n_tokens, round(least((least(len(t) / 40.0, 1.0) + case when comparative then 0.22 else 0 end
            + case when temporal then 0.18 else 0 end + case when quantitative then 0.18 else 0 end + case when explanatory then 0.12 else 0 end) / 1.6, 1.0), 6) as complexity,
          case when comparative then 'comparison' when temporal then 'temporal' when quantitative then 'quantitative'
               when citation then 'evidence_lookup' when explanatory then 'explanation' else 'general' end as intent from f""",
)
def b20_query_analysis(spark, d):
    c = table(spark, d, "conversations").where("role = 'user'")
    t = c.select("conv_id", "turn", X.field_tokens(F.col("text")).alias("t"))
    t = t.select("*", *[F.arrays_overlap("t", F.array(*[F.lit(w) for w in v.split()])).alias(k) for k, v in _FLAGS.items()])
    points = F.least(F.size("t") / 40.0, F.lit(1.0))
    for k, w in (("comparative", 0.22), ("temporal", 0.18), ("quantitative", 0.18), ("explanatory", 0.12)):
        points = points + F.when(F.col(k), w).otherwise(0.0)
    intent = F.when(F.col("comparative"), "comparison").when(F.col("temporal"), "temporal").when(F.col("quantitative"), "quantitative")
    intent = intent.when(F.col("citation"), "evidence_lookup").when(F.col("explanatory"), "explanation").otherwise("general")
    return t.select("conv_id", "turn", F.size("t").alias("n_tokens"), F.round(F.least(points / 1.6, F.lit(1.0)), 6).alias("complexity"), intent.alias("intent"))


@query(
    "b22_numeric_cells",
    """select l_orderkey, l_linenumber, round(case when neg then -v else v end, 6) as value from (
         select *, starts_with(cell, '(') as neg, try_cast(replace(regexp_extract(cell, '([0-9][0-9,.]*)', 1), ',', '') as double) as v from (
           select l_orderkey, l_linenumber, case when l_linenumber % 2 = 0 then '(' || format('{:,.2f}', l_extendedprice) || ')' else format('{:,.2f}', l_extendedprice) end as cell from lineitem))""",
)
def b22_numeric_cells(spark, d):
    from corpuslens.functions.numbers import parse_cell

    shown = F.format_number("l_extendedprice", 2)
    cell = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("("), shown, F.lit(")"))).otherwise(shown)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(parse_cell(cell), 6).alias("value"))


@query("b24_normalized_answer", r"select conv_id, turn, array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ') as answer from conversations where role = 'assistant'")
def b24_normalized_answer(spark, d):
    return table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", X.normalized_answer(F.col("text")).alias("answer"))


@query("b40_answer_hash", r"select conv_id, turn, sha256(array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ')) as answer_hash from conversations")
def b40_answer_hash(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.sha2(X.normalized_answer(F.col("text")), 256).alias("answer_hash"))


@query("b23_entity_text", r"select distinct trim(regexp_replace(lower(p_name), '\s+', ' ', 'g')) as entity from part")
def b23_entity_text(spark, d):
    return table(spark, d, "part").select(F.trim(F.regexp_replace(F.lower("p_name"), r"\s+", " ")).alias("entity")).distinct()


_AGE = "(epoch(top) - epoch(ts))"


@query("b25_freshness", f"select event_id, round(0.1 + 0.9 * pow(0.5, {_AGE} / 86400.0), 6) as freshness from events, (select max(ts) as top from events)")
def b25_freshness(spark, d):
    e = table(spark, d, "events")
    top = e.agg(F.max("ts").alias("top"))
    age = F.unix_micros(F.col("top").cast("timestamp")) / 1e6 - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.crossJoin(F.broadcast(top)).select("event_id", F.round(X.freshness(age, 86400.0, 0.1), 6).alias("freshness"))  # one row


@query(
    "b26_freshness_adjusted",
    f"""select event_id, round(greatest(0, least(1, rel * (0.6 + 0.4 * (0.1 + 0.9 * pow(0.5, {_AGE} / 86400.0))) * case when event_id % 7 = 0 then 0.8 else 1.0 end)), 6) as score
        from (select *, value / (1 + value) as rel from events where value is not null), (select max(ts) as top from events)""",
)
def b26_freshness_adjusted(spark, d):
    e = table(spark, d, "events")
    top = e.agg(F.max("ts").alias("top"))
    e = e.where("value is not null").crossJoin(F.broadcast(top))  # one row
    age = F.unix_micros(F.col("top").cast("timestamp")) / 1e6 - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rel = F.col("value") / (1 + F.col("value"))
    score = rel * (0.6 + 0.4 * X.freshness(age, 86400.0, 0.1)) * F.when(F.col("event_id") % 7 == 0, 0.8).otherwise(1.0)
    return e.select("event_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6).alias("score"))


@query(
    "b27_interval_relation",
    """select relation, count(*) as n from (select case when e1 < s2 then 'before' when s1 > e2 then 'after' when s1 = s2 and e1 = e2 then 'equal'
          when s1 >= s2 and e1 <= e2 then 'during' when s1 <= s2 and e1 >= e2 then 'contains' else 'overlaps' end as relation
        from (select o_orderdate as s1, o_orderdate + interval 30 day as e1, l_shipdate as s2, l_shipdate + interval 20 day as e2 from orders join lineitem on o_orderkey = l_orderkey)) group by 1""",
)
def b27_interval_relation(spark, d):
    from corpuslens.functions.dates import interval_relation

    j = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    rel = interval_relation(F.col("o_orderdate"), F.col("o_orderdate") + F.expr("interval 30 days"), F.col("l_shipdate"), F.col("l_shipdate") + F.expr("interval 20 days"))
    return j.groupBy(rel.alias("relation")).agg(F.count("*").alias("n"))


@query("b28_json_path", "select event_type, json_extract_string(props, '$.' || k) as v, k, count(*) as n from events, (select unnest(['a', 'k', 'page', 'ref', 'country']) as k) group by 1, 2, 3")
def b28_json_path(spark, d):
    paths = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.get_json_object("props", f"$.{k}").alias("v")) for k in ("a", "k", "page", "ref", "country")]))
    return table(spark, d, "events").select("event_type", paths.alias("p")).groupBy("event_type", "p.v", "p.k").agg(F.count("*").alias("n"))


@query("b29_calibrated_score", "select event_id, round(1 / (1 + exp(-(ln(p / (1 - p)) / 1.5 + 0.2))), 6) as score from (select event_id, least(greatest(value / 100.0, 1e-6), 1 - 1e-6) as p from events where value is not null)")
def b29_calibrated_score(spark, d):
    e = table(spark, d, "events").where("value is not null")
    return e.select("event_id", F.round(X.calibrated(F.col("value") / 100.0, 1.5, 0.2), 6).alias("score"))


@query("b32_node_id", "select doc_id, sha256(source || chr(31) || doc_id || chr(31) || '1' || chr(31) || 'document' || chr(31) || lang) as node_id from documents")
def b32_node_id(spark, d):
    return table(spark, d, "documents").select("doc_id", X.content_id(F.col("source"), F.col("doc_id"), F.lit(1), F.lit("document"), F.col("lang")).alias("node_id"))


@query("b34_cost", "select conv_id, round(sum(case when role = 'user' then length(text) / 4.0 * 3 else length(text) / 4.0 * 15 end), 4) as micro_usd from conversations group by 1")
def b34_cost(spark, d):
    price = F.when(F.col("role") == "user", F.length("text") / 4.0 * 3).otherwise(F.length("text") / 4.0 * 15)
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.round(F.sum(price), 4).alias("micro_usd"))


@query(
    "b35_atomic_claims",
    r"""select conv_id, turn, ordinal, sha256(conv_id || chr(31) || turn || chr(31) || ordinal || chr(31) || claim) as claim_id, length(claim) as n_chars from (
          select conv_id, turn, unnest(c) as claim, generate_subscripts(c, 1) - 1 as ordinal from (
            select conv_id, turn, list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') as c
            from conversations where role = 'assistant'))""",
)
def b35_atomic_claims(spark, d):
    from corpuslens.operators.prepare import atomic_claims

    claims = atomic_claims(table(spark, d, "conversations").where("role = 'assistant'"), ["conv_id", "turn"])
    return claims.select("conv_id", "turn", "ordinal", "claim_id", F.length("claim").alias("n_chars"))


@query("b39_nonconformity", "select event_id, round(1 - (value - coalesce(lag(value) over (partition by user_id order by event_id), 0)) / 100.0, 6) as nonconformity from events where value is not null")
def b39_nonconformity(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "events").where("value is not null")
    before = F.coalesce(F.lag("value").over(Window.partitionBy("user_id").orderBy("event_id")), F.lit(0.0))
    return e.select("event_id", F.round(1 - (F.col("value") - before) / 100.0, 6).alias("nonconformity"))


@query("b21_unit_convert", "select p_partkey, round(p_size * u.scale / 0.0254, 6) as inches from part join (values (0, 0.001), (1, 0.01), (2, 1.0), (3, 1000.0)) u(k, scale) on p_partkey % 4 = u.k")
def b21_unit_convert(spark, d):
    from corpuslens.functions.numbers import convert

    unit = F.element_at(F.array(*[F.lit(u) for u in ("mm", "cm", "m", "km")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return convert(table(spark, d, "part").withColumn("unit", unit), "p_size", "unit", F.lit("in"), "inches").select("p_partkey", F.round("inches", 6).alias("inches"))


@query("a13_domain_suffixes", f"select distinct suffix from (select unnest([host, regexp_replace(host, '^www\\.', '')]) as suffix from (select lower(regexp_extract(authority, '^([^:]*)', 1)) as host from ({_URL}))) where suffix <> ''")
def a13_domain_suffixes(spark, d):
    host = X.url_host(F.col("url"))
    return table(spark, d, "pages").select(F.explode(F.array(host, F.regexp_replace(host, r"^www\.", ""))).alias("suffix")).where("suffix <> ''").distinct()


@query("a10_correlation_rows", "select event_id, sha256('o' || user_id) as owner_digest, event_type as state, round(value * 1000, 3) as duration_ms from events where event_type in ('purchase', 'error')")
def a10_correlation_rows(spark, d):
    e = table(spark, d, "events").where(F.col("event_type").isin("purchase", "error"))
    return e.select("event_id", F.sha2(F.concat(F.lit("o"), F.col("user_id").cast("string")), 256).alias("owner_digest"), F.col("event_type").alias("state"), F.round(F.col("value") * 1000, 3).alias("duration_ms"))


@query("a11_feedback_export", "select event_id, event_type, value from events where user_id = (select min(user_id) from events) order by ts desc, event_id limit 100")
def a11_feedback_export(spark, d):
    e = table(spark, d, "events")
    first = e.agg(F.min("user_id").alias("user_id"))
    return e.join(F.broadcast(first), "user_id").orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "event_type", "value")  # one row
