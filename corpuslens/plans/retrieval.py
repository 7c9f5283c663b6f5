"""Search over documents, vectors and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions.text import field_tokens
from corpuslens.operators import retrieval as R
from corpuslens.plans.catalog import query, table
from corpuslens.plans.scalars import FIELD_TOKENS_SQL, TOKENS_SQL

_INDEX = f"""tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest({TOKENS_SQL}) as term from documents) group by 1, 2),
  idf as (select term, count(*) as df, ln((1 + (select count(*) from documents)) / (1.0 + count(*))) + 1 as idf from tf group by 1),
  post as (select doc_id, term, tf, (1 + ln(tf)) * idf as weight from tf join idf using (term)),
  norms as (select doc_id, sqrt(sum(weight * weight)) as norm from post group by 1)"""
_QUERIES = f"""q as (select query_id, term, count(*) as qtf from (select item_id as query_id, unnest({TOKENS_SQL}) as term from benchmark) group by 1, 2)"""
_SEARCH = f"""{_INDEX}, {_QUERIES}, qw as (select query_id, term, (1 + ln(qtf)) * idf as qw from q join idf using (term)),
  qn as (select query_id, sqrt(sum(qw * qw)) as qnorm from qw group by 1),
  dots as (select query_id, doc_id, sum(qw * weight) as dot from qw join post using (term) group by 1, 2),
  hits as (select query_id, doc_id, round(least(1.0, dot / (norm * qnorm)), 9) as cosine from dots join norms using (doc_id) join qn using (query_id)),
  found as (select query_id, doc_id, row_number() over (partition by query_id order by round(0.85 * cosine, 9) desc, cosine desc, doc_id desc) as position,
    round(cosine, 6) as cosine, round(0.85 * cosine, 6) as score from hits)"""


def _queries(spark, d, **kw):
    return R.query_terms(table(spark, d, "benchmark").withColumnRenamed("item_id", "query_id"), **kw)


@query("d1_index", f"with {_INDEX} select doc_id, count(*) as n_terms, sum(tf)::bigint as n_tokens, round(max(weight), 6) as top_weight, round(any_value(norm), 6) as norm from post join norms using (doc_id) group by 1")
def d1_index(spark, d):
    index = R.build_index(table(spark, d, "documents"))
    return index.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.sum("tf").alias("n_tokens"), F.round(F.max("weight"), 6).alias("top_weight"), F.round(F.any_value("norm"), 6).alias("norm"))


@query("d2_search", f"with {_SEARCH} select * from found where position <= 10")
def d2_search(spark, d):
    hits = R.search(_queries(spark, d), table(spark, d, "documents"))
    return hits.select("query_id", "doc_id", "position", F.round("cosine", 6).alias("cosine"), F.round("score", 6).alias("score"))


@query(
    "d4_gather_context",
    f"""with {_SEARCH}, top as (select * from found where position <= 10), n as (select query_id, count(*) as n from top group by 1)
        select query_id, doc_id, position, length(substring(text, 1, (4000 // n)::int)) as n_chars,
          sum(length(substring(text, 1, (4000 // n)::int))) over (partition by query_id order by position)::bigint as total_chars
        from top join n using (query_id) join documents using (doc_id)""",
)
def d4_gather_context(spark, d):
    from pyspark.sql import Window

    docs = table(spark, d, "documents")
    hits = R.search(_queries(spark, d), docs).select("query_id", "doc_id", "position")
    each = hits.withColumn("n", F.count("*").over(Window.partitionBy("query_id"))).join(docs.select("doc_id", "text"), "doc_id")
    each = each.withColumn("n_chars", F.length(F.substring(F.col("text"), F.lit(1), F.floor(4000 / F.col("n")).cast("int"))))
    total = F.sum("n_chars").over(Window.partitionBy("query_id").orderBy("position"))
    return each.select("query_id", "doc_id", "position", "n_chars", total.alias("total_chars"))


_RANK_ROUNDS = 8
_EDGES = "select distinct 's' || l_suppkey as src, 'p' || l_partkey as dst from lineitem union select distinct 'p' || l_partkey, 'c' || o_custkey from lineitem join orders on l_orderkey = o_orderkey"


def _pagerank_sql(edges, rounds):
    steps = ["r0 as (select node, sink, 1.0 / (select count(*) from nodes) as rank from nodes)"]
    for i in range(rounds):
        steps.append(
            f"r{i + 1} as (select n.node, n.sink, 0.15 / t.n + 0.85 * coalesce(t.lost, 0) / t.n + coalesce(g.got, 0) as rank from nodes n cross join"
            f" (select count(*) as n, sum(case when sink then rank end) as lost from r{i}) t left join"
            f" (select dst, sum(0.85 * rank / o) as got from links join r{i} on src = node group by 1) g on g.dst = n.node)"
        )
    return (
        f"with e as ({edges}), outs as (select src, count(*) as o from e group by 1), links as (select e.src, dst, o from e join outs using (src)),"
        " nodes as (select node, o is null as sink from (select src as node from e union select dst from e) left join outs on src = node), "
        + ", ".join(steps)
        + f" select node, round(rank / (select sum(rank) from r{rounds}) * 1000, 6) as rank from r{rounds}"
    )


@query("d5_pagerank", _pagerank_sql(_EDGES, _RANK_ROUNDS))
def d5_pagerank(spark, d):
    """Rank over supplier, part and customer edges."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = li.select(name("s", "l_suppkey").alias("src"), name("p", "l_partkey").alias("dst")).unionByName(
        li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(name("p", "l_partkey").alias("src"), name("c", "o_custkey").alias("dst"))
    ).distinct()
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    ranks = R.pagerank(edges, nodes, _RANK_ROUNDS)
    return ranks.select("node", F.round(F.col("rank") * 1000, 6).alias("rank"))


@query(
    "d6_fetched_link_graph",
    r"""with p as (select page_id, url, lower(regexp_extract(url, '://([^/?#:]*)', 1)) as host, html from pages),
        e as (select p.url as src, unnest(regexp_extract_all(html, '(?i)href="([^"#]*)"', 1)) as dst from p)
        select count(*) as n_edges, count(distinct src) as n_sources from e where dst in (select url from pages)""",
)
def d6_fetched_link_graph(spark, d):
    from corpuslens.functions.text import page_links

    pages = table(spark, d, "pages")
    edges = pages.select(F.col("url").alias("src"), F.explode(page_links(F.col("html"))).alias("dst"))
    kept = edges.join(pages.select(F.col("url").alias("dst")).distinct(), "dst", "left_semi")
    return kept.agg(F.count("*").alias("n_edges"), F.countDistinct("src").alias("n_sources"))


_FIELDS = """fields as (select source as owner_id, doc_id, ordinal, field_type, field_text, doc_id || ':' || ordinal as field_id from (
  select source, doc_id, 0 as ordinal, 'title' as field_type, case when contains(text, chr(10)) then string_split(text, chr(10))[1] else text end as field_text from documents
  union all select source, doc_id, 1, 'content', substring(text, position(chr(10) in text) + 1) from documents where contains(text, chr(10))) where field_text <> '')"""
_FTOK = FIELD_TOKENS_SQL.replace("text", "field_text")


@query(
    "d7_positional_postings",
    f"""with {_FIELDS}, t as (select doc_id, field_id, unnest({_FTOK}) as term, generate_subscripts({_FTOK}, 1) - 1 as pos from fields)
        select field_id, term, count(*) as tf, min(pos) as first_pos, max(pos) as last_pos from t group by 1, 2""",
)
def d7_positional_postings(spark, d):
    post = R.positions(R.sparse_fields(table(spark, d, "documents")))
    return post.select("field_id", "term", "tf", F.element_at("positions", 1).alias("first_pos"), F.element_at("positions", -1).alias("last_pos"))


@query("d8_sparse_fields", f"with {_FIELDS} select owner_id, doc_id, field_id, field_type, length(field_text) as n_chars from fields")
def d8_sparse_fields(spark, d):
    return R.sparse_fields(table(spark, d, "documents")).select("owner_id", "doc_id", "field_id", "field_type", F.length("field_text").alias("n_chars"))


_BM25 = f"""tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest({FIELD_TOKENS_SQL}) as term from documents) group by 1, 2),
  q as (select query_id, term, count(*) as qtf from (select item_id as query_id, unnest({FIELD_TOKENS_SQL}) as term from benchmark) group by 1, 2),
  len as (select doc_id, len({FIELD_TOKENS_SQL}) as len from documents), st as (select count(*) as n, greatest(avg(len), 1.0) as al from len),
  df as (select query_id, term, count(*) as df from tf join q using (term) group by 1, 2),
  raw as (select query_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * greatest(len, 1) / al))) as raw
    from tf join q using (term) join df using (query_id, term) join len using (doc_id) cross join st group by 1, 2),
  scored as (select query_id, doc_id, raw, raw / max(raw) over (partition by query_id) as score from raw),
  bm as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id desc) as position from scored)"""


def _bm25(spark, d, k):
    q = _queries(spark, d, tokens=field_tokens)
    return R.bm25(q, table(spark, d, "documents"), top=k)


@query("d9_bm25", f"with {_BM25} select query_id, doc_id, position, round(raw, 6) as raw, round(score, 6) as score from bm where position <= 10")
def d9_bm25(spark, d):
    return R.top_k(_bm25(spark, d, 10), 10).select("query_id", "doc_id", "position", F.round("raw", 6).alias("raw"), F.round("score", 6).alias("score"))


_WEIGHTS = {"title": 2.5, "content": 1.0}


@query(
    "d10_fielded_search",
    f"""with {_FIELDS}, toks as (select owner_id, doc_id, field_id, field_type, unnest({_FTOK}) as term from fields),
        post as (select owner_id, doc_id, field_id, field_type, term, count(*) as tf from toks group by all),
        len as (select owner_id, field_id, field_type, len({_FTOK}) as len from fields), av as (select owner_id, field_type, avg(len) as al from len group by 1, 2),
        nd as (select owner_id, count(distinct doc_id) as n from fields group by 1),
        q as (select distinct item_id as query_id, 'src' || item_id % 20 as owner_id, unnest({FIELD_TOKENS_SQL}) as term from benchmark),
        hits as (select * from post join q using (owner_id, term)), df as (select query_id, term, count(distinct doc_id) as df from hits group by 1, 2),
        s as (select query_id, doc_id, sum(case when field_type = 'title' then 2.5 else 1.0 end * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / greatest(al, 1.0)))) as score
          from hits join df using (query_id, term) join len using (owner_id, field_id, field_type) join av using (owner_id, field_type) join nd using (owner_id) group by 1, 2)
        select query_id, doc_id, position, round(score, 6) as score from (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id desc) as position from s) where position <= 10""",
)
def d10_fielded_search(spark, d):
    q = _queries(spark, d, tokens=field_tokens).select("query_id", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")).alias("owner_id"), "term")
    hits = R.fielded_search(q, R.sparse_fields(table(spark, d, "documents")), _WEIGHTS)
    return hits.select("query_id", "doc_id", "position", F.round("score", 6).alias("score"))


_COS = "list_cosine_similarity(a.embedding::double[], b.embedding::double[])"


@query(
    "d11_nearest_vectors",
    f"""select * from (select query_id, vec_id, round(s, 6) as similarity, row_number() over (partition by query_id order by round(s, 9) desc, vec_id) as position
        from (select a.vec_id as query_id, b.vec_id as vec_id, {_COS} as s from embeddings a join embeddings b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id)) where position <= 5""",
)
def d11_nearest_vectors(spark, d):
    v = table(spark, d, "embeddings")
    hits = R.nearest(v.where("vec_id % 100 = 0"), v, 5)
    return hits.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "position")


_CENTROID = "select label, i, avg(x) as c from (select label, unnest(range(1, 65)) as i, unnest(embedding)::double as x from embeddings) group by 1, 2"


@query(
    "d12_cosine",
    f"""with c as (select label, list(c order by i) as centre from ({_CENTROID}) group by 1)
        select vec_id, round(list_cosine_similarity(embedding::double[], centre), 6) as cosine from embeddings join c using (label)""",
)
def d12_cosine(spark, d):
    v = table(spark, d, "embeddings")
    c = v.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("c"))
    c = c.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "c"))).alias("s")).select("label", F.transform("s", lambda s: s.c).alias("centre"))
    return v.join(c, "label").select("vec_id", F.round(R.cosine(F.col("embedding"), F.col("centre")), 6).alias("cosine"))


@query(
    "d13_sparse_similarity",
    f"""with {_INDEX}, {_QUERIES}, qw as (select query_id, term, qtf * 1.0 as w from q), qn as (select query_id, sqrt(sum(w * w)) as n from qw group by 1)
        select query_id, count(*) as n_docs, round(max(s), 6) as best, round(avg(s), 6) as mean from (
          select query_id, doc_id, least(1.0, sum(w * weight) / (any_value(n) * any_value(norm))) as s from qw join qn using (query_id) join post using (term) join norms using (doc_id) group by 1, 2) group by 1""",
)
def d13_sparse_similarity(spark, d):
    index = R.build_index(table(spark, d, "documents"))
    q = _queries(spark, d).select("query_id", "term", F.col("qtf").cast("double").alias("w"))
    qn = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n"))
    s = q.join(index, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"), F.any_value("norm").alias("norm"))
    s = s.join(qn, "query_id").select("query_id", F.least(F.lit(1.0), F.col("dot") / (F.col("n") * F.col("norm"))).alias("s"))
    return s.groupBy("query_id").agg(F.count("*").alias("n_docs"), F.round(F.max("s"), 6).alias("best"), F.round(F.avg("s"), 6).alias("mean"))


@query(
    "d14_maxsim",
    """with q as (select vec_id as qv, label as q, embedding as qe from embeddings where vec_id % 100 = 0), d as (select vec_id // 10 as d, embedding as de from embeddings)
       select q, d, round(avg((m + 1) / 2), 6) as score from (select q, d, qv, max(list_cosine_similarity(qe::double[], de::double[])) as m from q cross join d group by 1, 2, 3) group by 1, 2""",
)
def d14_maxsim(spark, d):
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qv"), F.col("label").alias("q"), F.col("embedding").alias("qe"))
    docs = v.select(F.floor(F.col("vec_id") / 10).alias("d"), F.col("embedding").alias("de"))
    return R.late_interaction(q, docs, ["d"]).select("q", "d", F.round((F.col("score") + 1) / 2, 6).alias("score"))


@query("d16_multi_vector", "select label, round(max(s), 6) as best, round(avg(s), 6) as mean, round(list_avg(list_sort(list(s), 'desc')[1:3]), 6) as top3 from (select label, embedding[1]::double as s from embeddings) group by 1")
def d16_multi_vector(spark, d):
    s = table(spark, d, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("s"))
    from pyspark.sql import Window

    top = s.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("s"))))
    return top.groupBy("label").agg(F.round(F.max("s"), 6).alias("best"), F.round(F.avg("s"), 6).alias("mean"), F.round(F.avg(F.when(F.col("n") <= 3, F.col("s"))), 6).alias("top3"))


@query("d17_matryoshka", "select event_id, list_min(list_filter([8, 16, 32, 64], lambda x: x >= 8 + 56 * (0.5 * b + 0.3 * c + 0.2 * u))) as dims from (select event_id, (event_id % 11) / 10.0 as b, (event_id % 7) / 6.0 as c, (event_id % 5) / 4.0 as u from events)")
def d17_matryoshka(spark, d):
    part = lambda m: (F.col("event_id") % m) / F.lit(float(m - 1))
    demand = 0.5 * part(11) + 0.3 * part(7) + 0.2 * part(5)
    dims = F.array(*[F.lit(x) for x in (8, 16, 32, 64)])
    return table(spark, d, "events").select("event_id", F.array_min(F.filter(dims, lambda x: x >= 8 + 56 * demand)).alias("dims"))


@query("c1_postings_join", f"with {_BM25} select query_id, count(*) as n_hits, sum(tf)::bigint as n_tokens from tf join q using (term) group by 1")
def c1_postings_join(spark, d):
    q = _queries(spark, d, tokens=field_tokens)
    tf = R.term_counts(table(spark, d, "documents"), "doc_id", field_tokens(F.col("text")))
    return tf.join(q, "term").groupBy("query_id").agg(F.count("*").alias("n_hits"), F.sum("tf").alias("n_tokens"))


_TWO = f"""{_SEARCH.replace('tf as (', 'tf0 as (', 1).replace('from tf group', 'from tf0 group').replace('from tf join', 'from tf0 join').replace('q as (', 'q0 as (', 1).replace('from q join', 'from q0 join')}, {_BM25},
  lists as (select 'dense' as list, query_id, doc_id, position from found where position <= 20 union all select 'lexical', query_id, doc_id, position from bm where position <= 20)"""


def two_lists(spark, d, k=20):
    docs = table(spark, d, "documents")
    first = R.search(_queries(spark, d), docs, top_k=k).select(F.lit("dense").alias("list"), "query_id", "doc_id", "position")
    second = R.top_k(_bm25(spark, d, k), k).select(F.lit("lexical").alias("list"), "query_id", "doc_id", "position")
    return first.unionByName(second)


@query(
    "e1_reciprocal_rank_fusion",
    f"""with {_TWO}, f as (select query_id, doc_id, sum(case when list = 'dense' then 0.75 else 0.25 end / (60 + position)) as s from lists group by 1, 2)
        select query_id, doc_id, round(s / max(s) over (partition by query_id), 6) as score from f""",
)
def e1_reciprocal_rank_fusion(spark, d):
    from corpuslens.operators.ranking import rank_fusion

    return rank_fusion(two_lists(spark, d), {"dense": 0.75, "lexical": 0.25}).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query(
    "c2_full_outer_evidence",
    f"""with {_TWO}, a as (select query_id, doc_id, position from lists where list = 'dense'), b as (select query_id, doc_id, position from lists where list = 'lexical')
        select coalesce(a.query_id, b.query_id) as query_id, coalesce(a.doc_id, b.doc_id) as doc_id, round(0.7 * coalesce(1.0 / a.position, 0) + 0.3 * coalesce(1.0 / b.position, 0), 6) as score,
          a.doc_id is not null and b.doc_id is not null as in_both from a full outer join b on a.query_id = b.query_id and a.doc_id = b.doc_id""",
)
def c2_full_outer_evidence(spark, d):
    lists = two_lists(spark, d)
    a = lists.where("list = 'dense'").select("query_id", "doc_id", F.col("position").alias("pa"))
    b = lists.where("list = 'lexical'").select("query_id", "doc_id", F.col("position").alias("pb"))
    score = 0.7 * F.coalesce(1.0 / F.col("pa"), F.lit(0.0)) + 0.3 * F.coalesce(1.0 / F.col("pb"), F.lit(0.0))
    return a.join(b, ["query_id", "doc_id"], "full_outer").select("query_id", "doc_id", F.round(score, 6).alias("score"), (F.col("pa").isNotNull() & F.col("pb").isNotNull()).alias("in_both"))


@query(
    "c21_retrieval_change",
    f"""with {_TWO}, a as (select query_id, doc_id, position from lists where list = 'dense'), b as (select query_id, doc_id, position from lists where list = 'lexical')
        select query_id, sum((pa is null)::int)::bigint as added, sum((pb is null)::int)::bigint as removed, sum((pa <> pb)::int)::bigint as moved from (
          select coalesce(a.query_id, b.query_id) as query_id, a.position as pa, b.position as pb from a full outer join b on a.query_id = b.query_id and a.doc_id = b.doc_id) group by 1""",
)
def c21_retrieval_change(spark, d):
    lists = two_lists(spark, d)
    a = lists.where("list = 'dense'").select("query_id", "doc_id", F.col("position").alias("pa"))
    b = lists.where("list = 'lexical'").select("query_id", "doc_id", F.col("position").alias("pb"))
    j = a.join(b, ["query_id", "doc_id"], "full_outer")
    n = lambda c, name: F.sum(c.cast("int")).alias(name)
    return j.groupBy("query_id").agg(n(F.col("pa").isNull(), "added"), n(F.col("pb").isNull(), "removed"), n(F.col("pa") != F.col("pb"), "moved"))


@query(
    "e5_capped_fusion",
    f"""with {_TWO}, f as (select query_id, doc_id, sum(1.0 / (60 + position)) as s from lists group by 1, 2), g as (select f.*, source from f join documents using (doc_id)),
        r as (select *, row_number() over (partition by query_id, source order by round(s, 9) desc, doc_id desc) as in_source from g)
        select query_id, doc_id, round(s, 6) as score, position from (select *, row_number() over (partition by query_id order by round(s, 9) desc, doc_id desc) as position from r where in_source <= 2) where position <= 10""",
)
def e5_capped_fusion(spark, d):
    from corpuslens.operators.ranking import capped, rank_fusion

    fused = rank_fusion(two_lists(spark, d), {}, normalise=False).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return capped(fused, 10, 2).select("query_id", "doc_id", F.round("score", 6).alias("score"), "position")
