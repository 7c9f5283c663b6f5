"""Lexical, dense and link retrieval: inverted index, TF-IDF and BM25 search, vectors and PageRank."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.text import FIELD_TOKEN, field_tokens, index_tokens
from corpuslens.operators.lineage import cut, small


def term_counts(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """``key, term, tf`` of each row.  Counted inside the row, in its sorted tokens, so nothing is shuffled."""
    rows = docs.select(key, F.sort_array(tokens).alias("t"))
    n = F.size("t")
    places = F.when(n > 0, F.sequence(F.lit(1), n))  # null, so no rows, without tokens
    starts = F.filter(places, lambda i: (i == 1) | (F.get("t", i - 1) != F.get("t", i - 2)))
    rows = rows.select(key, "t", starts.alias("s"))
    ends = F.concat(F.slice("s", F.lit(2), F.size("s")), F.array(n + 1))
    each = F.zip_with("s", ends, lambda a, b: F.struct(F.get("t", a - 1).alias("term"), (b - a).cast("long").alias("tf")))
    return rows.select(key, F.explode(each).alias("x")).select(key, "x.term", "x.tf")


def build_index(docs: DataFrame, key: str = "doc_id", tokens: Column | None = None) -> DataFrame:
    """Postings ``key, term, tf, weight, norm`` of the TF-IDF index.

    idf = ln((1 + N) / (1 + df)) + 1; weight = (1 + ln tf) idf; norm = root of the sum of squared weights.
    """
    tf, idf = _term_tables(docs, key, index_tokens(F.col("text")) if tokens is None else tokens)
    weighted = tf.join(small(idf), "term").withColumn("weight", (1 + F.log("tf")) * F.col("idf"))
    norms = weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return weighted.join(norms, key)


def _term_tables(docs: DataFrame, key: str, tokens: Column) -> tuple[DataFrame, DataFrame]:
    """Written tables of ``key, term, tf`` and ``term, df, idf``: texts are tokenised once."""
    tf = cut(term_counts(docs, key, tokens))
    n = docs.agg(F.count("*").alias("n"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    return tf, cut(df.crossJoin(F.broadcast(n)).select("term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")))  # one row


def query_terms(queries: DataFrame, text: str = "text", key: str = "query_id", tokens: Callable = index_tokens) -> DataFrame:
    """``query_id, term, qtf`` of each whole query text."""
    return queries.select(F.col(key).alias("query_id"), F.explode(tokens(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def search(queries: DataFrame, docs: DataFrame, ranks: DataFrame | None = None, top_k: int = 10, lexical_weight: float = 0.85) -> DataFrame:
    """TF-IDF cosine blended with rank: ``query_id, doc_id, position, cosine, score``.

    Texts are tokenised once.  Norms are one sum over the postings by document; only postings of query terms are scored.
    """
    tf, idf = _term_tables(docs, "doc_id", index_tokens(F.col("text")))
    weight = (1 + F.log("tf")) * F.col("idf")
    norms = tf.join(small(idf), "term").groupBy("doc_id").agg(F.sqrt(F.sum(weight * weight)).alias("norm"))
    q = cut(queries.join(idf, "term").withColumn("qw", (1 + F.log("qtf")) * F.col("idf")))
    qn = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("scale"))
    posts = tf.join(small(q.select("term", "idf").distinct()), "term").join(norms, "doc_id").select("doc_id", "term", weight.alias("w"), "norm")
    hits = _products(q.join(qn, "query_id"), cut(posts), top_k if ranks is None else None)  # ranks can lift any row
    hits = hits.withColumn("cosine", F.round(F.least(F.lit(1.0), F.col("share")), 9))
    if ranks is None:
        hits = hits.withColumn("rank", F.lit(0.0))
    else:
        top = ranks.agg(F.max("rank").alias("top_rank"))
        hits = hits.join(ranks, "doc_id", "left").crossJoin(F.broadcast(top))  # one row
        hits = hits.withColumn("rank", F.coalesce(F.col("rank") / F.col("top_rank"), F.lit(0.0)))
    score = F.round(lexical_weight * F.col("cosine") + (1 - lexical_weight) * F.col("rank"), 9)
    hits = hits.withColumn("score", score)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("cosine"), F.desc("rank"), F.desc("doc_id"))
    hits = hits.withColumn("position", F.row_number().over(order)).where(F.col("position") <= top_k)
    return hits.select("query_id", "doc_id", "position", "cosine", "score")


def token_count(text: Column) -> Column:
    """Number of ``field_tokens``, without the tokens."""
    return F.regexp_count(F.lower(text), F.lit(FIELD_TOKEN))


def held_terms(rows: DataFrame, text: str, keys: list[str], terms: DataFrame, on: list[str]) -> DataFrame:
    """``keys, len, term, tf`` of the tokens in ``rows`` that ``terms`` holds too, by an equi-join before they are counted."""
    tokens = rows.select(*keys, field_tokens(F.col(text)).alias("_t")).select(*keys, F.size("_t").alias("len"), F.explode("_t").alias("term"))
    return tokens.join(small(terms), on, "left_semi").groupBy(*keys, "len", "term").agg(F.count("*").alias("tf"))


def bm25(queries: DataFrame, docs: DataFrame, k1: float = 1.2, b: float = 0.75, key: str = "doc_id", text: str = "text", top: int | None = None) -> DataFrame:
    """``query_id, doc_id, raw, score``: BM25 with query term counts, divided by the query's best; with ``top``, its best rows.

    Texts are tokenised once, with their length; only tokens that a query holds leave the scan.
    """
    queries = cut(queries)
    stats = docs.agg(F.count("*").alias("n"), F.greatest(F.avg(token_count(F.col(text))), F.lit(1.0)).alias("avg_len"))
    tf = held_terms(docs.select(F.col(key).alias("doc_id"), text), text, ["doc_id"], queries.select("term").distinct(), ["term"])
    tf = tf.crossJoin(F.broadcast(stats))  # one row
    bottom = F.col("tf") + k1 * (1 - b + b * F.greatest(F.col("len"), F.lit(1)) / F.col("avg_len"))
    posts = cut(tf.select("doc_id", "term", (F.col("tf") * (k1 + 1) / bottom).alias("w"), F.lit(1.0).alias("norm")))  # all postings of query terms, so document frequencies are whole
    df = posts.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    q = cut(queries.join(df, "term").select("query_id", "term", (F.col("qtf") * idf).alias("qw"), F.lit(1.0).alias("scale")))
    best = _products(q, posts, 1, rounded=False).groupBy("query_id").agg(F.max("raw").alias("scale"))
    return _products(cut(q.drop("scale").join(best, "query_id")), posts, top).select("query_id", "doc_id", "raw", F.col("share").alias("score"))


def top_k(scored: DataFrame, k: int, by: str = "score", group: str = "query_id", item: str = "doc_id") -> DataFrame:
    """The best ``k`` of each group with ``position``: rounded score, then item, both descending."""
    order = Window.partitionBy(group).orderBy(F.desc(F.round(by, 9)), F.desc(item))
    return scored.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def sparse_fields(docs: DataFrame, owner: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fields of documents: the first line is the title, the rest content; with a stable id and ordinal."""
    cut = F.instr(text, "\n")
    title = F.when(cut > 0, F.expr(f"substring({text}, 1, instr({text}, '\n') - 1)")).otherwise(F.col(text))
    body = F.when(cut > 0, F.expr(f"substring({text}, instr({text}, '\n') + 1)")).otherwise(F.lit(""))
    fields = F.array(
        F.struct(F.lit("title").alias("field_type"), title.alias("field_text")),
        F.struct(F.lit("content").alias("field_type"), body.alias("field_text")),
    )
    rows = docs.select(F.col(owner).alias("owner_id"), F.col(key).alias("doc_id"), F.posexplode(fields).alias("ordinal", "f")).select("owner_id", "doc_id", "ordinal", "f.*")
    return rows.where(F.col("field_text") != "").withColumn("field_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("ordinal").cast("string")))


def positions(fields: DataFrame) -> DataFrame:
    """Postings of fields: ``owner_id, doc_id, field_id, field_type, term, tf, positions``."""
    each = fields.select("owner_id", "doc_id", "field_id", "field_type", F.posexplode(field_tokens(F.col("field_text"))).alias("pos", "term"))
    return each.groupBy("owner_id", "doc_id", "field_id", "field_type", "term").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def fielded_search(queries: DataFrame, fields: DataFrame, weights: dict[str, float], k1: float = 1.2, b: float = 0.75, limit: int = 10) -> DataFrame:
    """Fielded BM25 inside one owner: ``queries(query_id, owner_id, term)`` joined to the postings of their terms alone."""
    keys = ["owner_id", "doc_id", "field_id", "field_type"]
    queries = cut(queries)
    post = held_terms(fields, "field_text", keys, queries.select("owner_id", "term").distinct(), ["owner_id", "term"])
    averages = fields.groupBy("owner_id", "field_type").agg(F.avg(token_count(F.col("field_text"))).alias("avg_len"))
    n_docs = fields.groupBy("owner_id").agg(F.countDistinct("doc_id").alias("n"))
    hits = cut(post.join(small(queries), ["owner_id", "term"]))
    df = hits.groupBy("query_id", "owner_id", "term").agg(F.countDistinct("doc_id").alias("df"))
    hits = hits.join(df, ["query_id", "owner_id", "term"]).join(averages, ["owner_id", "field_type"]).join(n_docs, "owner_id")
    weight = F.coalesce(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))])[F.col("field_type")], F.lit(1.0))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = weight * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.greatest(F.col("avg_len"), F.lit(1.0))))
    return top_k(hits.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score")), limit)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


#: Most vectors and most queries that meet in a task at once.
BLOCK_ROWS = 8_192
#: The same for weighted terms, of which a text has many.
BLOCK_TERMS = 65_536


def _met(queries: DataFrame, vectors: DataFrame, query: list[str], item: list[str], meet: Callable, schema: str, rows: int | None = None) -> DataFrame:
    """``meet`` over all pairs of a block of ``queries`` and a block of ``vectors``; rows of one ``item`` share a block.

    Both are dealt by hashes to blocks of about ``rows``, or BLOCK_ROWS, rows and shuffled, so a task holds one block of each.
    """
    parts, blocks = (max(1, -(-df.count() // (rows or BLOCK_ROWS))) for df in (vectors, queries))
    hashed = lambda keys, n: F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("_block", hashed(query, blocks)).withColumn("_part", every(parts)).repartition(parts * blocks, "_part", "_block")
    v = vectors.withColumn("_part", hashed(item, parts)).withColumn("_block", every(blocks)).repartition(parts * blocks, "_part", "_block")
    return q.groupBy("_part", "_block").cogroup(v.groupBy("_part", "_block")).applyInPandas(meet, schema)


def _products(queries: DataFrame, postings: DataFrame, k: int | None, rounded: bool = True) -> DataFrame:
    """``query_id, doc_id, raw, share``: sums of ``qw`` times ``w`` over equal terms, and the sum over ``scale`` times ``norm``.

    ``queries(query_id, term, qw, scale)`` and ``postings(doc_id, term, w, norm)`` hold weights above 0 and meet in blocks.
    A block keeps the ``k`` best rows of a query before the shuffle, by share at 9 places, then the larger id; all without ``k``.
    """
    kind, plain = postings.schema["doc_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString() == "bigint"
    named = queries.withColumn("_q", F.col("query_id") if plain else F.to_json(F.struct("query_id")))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if right.duplicated(["doc_id", "term"]).any():  # rows of one id
            right = right.groupby(["doc_id", "term"], as_index=False).agg({"w": "sum", "norm": "first"})
        doc, ids = pd.factorize(right["doc_id"], sort=True)
        norm, found = np.ones(len(ids)), []
        norm[doc] = right["norm"].to_numpy()
        w = right["w"].to_numpy()
        lists = {term: (doc[at], w[at]) for term, at in right.groupby("term").indices.items()}
        for name, rows in left.sort_values("term").groupby("_q", sort=False) if len(right) else ():
            raw = np.zeros(len(ids))
            for term, qw in zip(rows["term"], rows["qw"]):
                if term in lists:
                    at, each = lists[term]
                    raw[at] += qw * each
            hit = np.flatnonzero(raw)
            share = raw[hit] / (norm[hit] * rows["scale"].iloc[0])
            if k is not None and len(hit) > k:
                value = np.floor(np.minimum(share, 1.0) * 1e9 + 0.5) if rounded else share
                some = np.flatnonzero(value >= np.partition(value, len(hit) - k)[len(hit) - k])
                some = some[np.lexsort((-hit[some], -value[some]))[:k]]
                hit, share = hit[some], share[some]
            found.append(pd.DataFrame({"_q": name, "doc_id": ids[hit], "raw": raw[hit], "share": share}))
        return pd.concat(found) if found else pd.DataFrame(columns=["_q", "doc_id", "raw", "share"])

    schema = f"_q {'bigint' if plain else 'string'}, doc_id {kind}, raw double, share double"
    sums = _met(named.select("_q", "term", "qw", "scale"), postings, ["_q"], ["doc_id"], meet, schema, BLOCK_TERMS)
    return sums.withColumnRenamed("_q", "query_id") if plain else sums.join(named.select("_q", "query_id").dropDuplicates(["_q"]), "_q").drop("_q")


def _units(rows: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1 in double precision and which are null; one of length 0 is not a number."""
    null = rows.isna().to_numpy()
    width = next((len(x) for x in rows[~null]), 1)
    x = np.array([np.zeros(width) if n else v for v, n in zip(rows, null)], dtype="float64").reshape(len(rows), width)
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True)), null


def _cosines(q: np.ndarray, v: np.ndarray, nulls: np.ndarray) -> np.ndarray:
    """Cosines of unit vectors: the order of Spark's doubles, not-a-number above all, and null below all, as infinities."""
    s = q @ v.T
    np.nan_to_num(s, copy=False, nan=np.inf)
    s[:, nulls] = -np.inf
    return s


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` most similar vectors of each stated query: ``query_id, vec_id, similarity, position``.

    Exact: every query meets every vector, a block of each at a time as a product of matrices, and a block keeps ``k``
    rows a query before the shuffle.  Similarities have 9 places; ties go to the smaller key, null comes last.
    """
    kind = vectors.schema[key].dataType.simpleString()

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        (q, unknown), (v, nulls) = _units(left["q"]), _units(right[vector])
        ids, keys, found = left["query_id"].to_numpy(), right[key].to_numpy(), []
        most = min(k + 1, len(keys))  # the query itself may be among them
        for at in range(0, len(ids) if most else 0, 256):
            s = _cosines(q[at : at + 256], v, nulls)
            s[unknown[at : at + 256]] = -np.inf
            least = np.partition(s, len(keys) - most, axis=1)[:, len(keys) - most]
            row, place = np.nonzero((s >= least[:, None] - 2e-9) | np.isneginf(least)[:, None])
            value = np.round(s[row, place], 9)
            other = ids[at + row] != keys[place]
            row, place, value = row[other], place[other], value[other]
            order = np.lexsort((keys[place], -value, row))
            row, place, value = row[order], place[order], value[order]
            first = np.searchsorted(row, row)  # where the query's rows begin
            kept = np.arange(len(row)) - first < k
            found.append(pd.DataFrame({"query_id": ids[at + row[kept]], key: keys[place[kept]], "similarity": value[kept]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": ids[:0], key: keys[:0], "similarity": np.zeros(0)})

    q = queries.select(F.col(key).alias("query_id"), F.col(vector).alias("q"))
    pairs = _met(q, vectors.select(key, vector), ["query_id"], [key], meet, f"query_id {kind}, {key} {kind}, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), key)
    best = pairs.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)
    s = F.col("similarity")
    return best.withColumn("similarity", F.when(s == float("-inf"), None).when(s == float("inf"), float("nan")).otherwise(s))


def late_interaction(queries: DataFrame, vectors: DataFrame, docs: list[str]) -> DataFrame:
    """``q, docs, score``: the mean over the vectors of a query of their best cosine in the document.

    ``queries(qv, q, qe)`` are vectors ``qe`` with number ``qv`` of query ``q``; ``vectors`` hold ``docs`` and ``de``.  A
    document's vectors share a block, so what leaves a task is a sum for each query and document, not for each pair.
    """
    kinds = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in docs)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values(docs).reset_index(drop=True)
        starts = np.flatnonzero(~right.duplicated(docs).to_numpy())
        (q, unknown), (v, nulls), out = _units(left["qe"]), _units(right["de"]), []
        for name, rows in left.groupby("q", dropna=False).indices.items() if len(right) else ():
            total, n = np.zeros(len(starts)), np.zeros(len(starts), dtype="int64")
            for at in range(0, len(rows), 256):
                some = rows[at : at + 256]
                s = _cosines(q[some], v, nulls)
                s[unknown[some]] = -np.inf
                best = np.maximum.reduceat(s, starts, axis=1)
                there = ~np.isneginf(best)
                total, n = total + np.where(there, best, 0.0).sum(axis=0), n + there.sum(axis=0)
            out.append(right.loc[starts, docs].assign(q=name, total=total, n=n))
        return pd.concat(out)[["q", *docs, "total", "n"]] if out else pd.DataFrame(columns=["q", *docs, "total", "n"])

    schema = f"q {queries.schema['q'].dataType.simpleString()}, {kinds}, total double, n long"
    sums = _met(queries, vectors.select(*docs, "de"), ["qv"], docs, meet, schema)
    g = sums.groupBy("q", *docs).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    mean = F.when(F.col("n") > 0, F.col("total") / F.greatest(F.col("n"), F.lit(1)))
    return g.select("q", *docs, F.when(F.col("total") == float("inf"), float("nan")).otherwise(mean).alias("score"))


def pagerank(edges: DataFrame, nodes: DataFrame, rounds: int = 20, damping: float = 0.85, keep: Callable = cut, tolerance: float = 0.0) -> DataFrame:
    """``node, rank``; mass at nodes without edges is spread evenly; the sum is 1.

    Stops after ``rounds``, or once a round changes the ranks by less than ``tolerance`` in sum.
    ``keep`` is applied each round to cut the lineage, for a round uses the ranks twice.
    """
    edges = edges.select("src", "dst").distinct()
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    links = keep(edges.join(out, "src"))
    sizes = keep(nodes.select("node").distinct().join(out, F.col("node") == F.col("src"), "left").select("node", F.col("out").isNull().alias("sink")))
    n = sizes.count()
    rank = sizes.select("node", "sink", F.lit(1.0 / n).alias("rank"))
    for _ in range(rounds):
        sink = rank.agg(F.coalesce(F.sum(F.when(F.col("sink"), F.col("rank"))), F.lit(0.0)).alias("lost"))
        got = links.join(rank, links.src == rank.node).groupBy("dst").agg(F.sum(damping * F.col("rank") / F.col("out")).alias("got"))
        new = keep(
            sizes.join(got, sizes.node == got.dst, "left")
            .crossJoin(F.broadcast(sink))  # one row
            .select("node", "sink", (F.lit((1 - damping) / n) + damping * F.col("lost") / n + F.coalesce("got", F.lit(0.0))).alias("rank"))
        )
        moved = tolerance and new.join(rank.select("node", F.col("rank").alias("was")), "node").agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0]
        rank = new
        if tolerance and (moved or 0.0) < tolerance:
            break
    total = rank.agg(F.sum("rank").alias("total"))
    return rank.crossJoin(F.broadcast(total)).select("node", (F.col("rank") / F.col("total")).alias("rank"))  # one row


def chunk_search(queries: DataFrame, chunks: DataFrame, top_k: int = 3, key: str = "doc_id") -> DataFrame:
    """``query_id, key, score, position``: the summed TF-IDF weights of ``queries(query_id, term, qtf)`` in each chunk, not normed; ties by key."""
    tf, idf = _term_tables(chunks, key, index_tokens(F.col("text")))
    q = cut(queries.join(idf, "term").withColumn("qw", (1 + F.log("qtf")) * F.col("idf")))
    hits = tf.join(small(q.select("query_id", "term", "qw", "idf")), "term")
    scores = hits.groupBy("query_id", key).agg(F.sum(F.col("qw") * (1 + F.log("tf")) * F.col("idf")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), key)
    return scores.withColumn("position", F.row_number().over(order)).where(F.col("position") <= top_k)


#: What is asked for the other side of a claim; fixed value.
COUNTER = "Find credible evidence that contradicts, falsifies, or limits this claim: "


def claim_evidence(claims: DataFrame, docs: DataFrame, per_claim: int = 5, counter: bool = True) -> DataFrame:
    """``claim_id, side, doc_id, position, score`` of ``claims(claim_id, text)``: what a search finds for a claim and for its counter-question.

    Both questions of all claims are one batch, so the corpus is read once.
    """
    sides = [F.struct(F.lit("support").alias("side"), F.col("text").alias("asked"))]
    sides += [F.struct(F.lit("counter").alias("side"), F.concat(F.lit(COUNTER), F.col("text")).alias("asked"))] if counter else []
    asked = claims.select("claim_id", F.explode(F.array(*sides)).alias("s")).select(F.struct("claim_id", "s.side").alias("id"), F.col("s.asked").alias("text"))
    found = search(query_terms(asked, key="id"), docs, top_k=per_claim)
    return found.select("query_id.claim_id", "query_id.side", "doc_id", "position", "score")
