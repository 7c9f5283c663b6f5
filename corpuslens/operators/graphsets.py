"""Sets of evidence graphs: members, and edges between their documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.sources.importing import set_digest

MEMBER = ("doc", "generation", "content", "profile", "graph")
NODE = ("doc", "generation", "graph", "node", "node_type", "provenance")


def content_id(*parts):
    """SHA-256 of the parts, each behind its length, so that no two lists of parts give one string."""
    text = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat(*[F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in text]), 256)


def _once(rows: DataFrame, keys: list[str], what: str) -> DataFrame:
    """The rows with ``_ok``, which is refused where a key has several."""
    n = F.when(F.count("*") > 1, F.raise_error(F.lit(f"{what} must be unique")).cast("boolean")).otherwise(True)
    values = [F.first(c).alias(c) for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(*values, n.alias("_ok")).where("_ok").drop("_ok")


def graph_set(members: DataFrame, key: str) -> DataFrame:
    """One row ``set_id, members``: an id from the key and the members' contents, whatever their order.

    ``members(doc, generation, content, profile, graph, current)`` are one a document, all of them current, two at least.
    """
    stale = F.when(~F.coalesce("current", F.lit(False)), F.raise_error(F.lit("every member must be current")).cast("string"))
    digest = F.coalesce(stale, content_id(*map(F.col, MEMBER)))
    totals = _once(members.select(*MEMBER, "current"), ["doc"], "documents").select(digest.alias("d")).agg(F.count("*").alias("members"), set_digest(F.col("d")).alias("digest"))
    few = F.when(F.col("members") < 2, F.raise_error(F.lit("a set has two members or more")).cast("string"))
    return totals.select(F.coalesce(few, content_id(F.lit(key), F.col("members"), F.col("digest"))).alias("set_id"), "members")


def graph_set_edges(members: DataFrame, nodes: DataFrame, relations: DataFrame, key: str) -> DataFrame:
    """``edge_id, set_id, relation, source_doc, source, target_doc, target, type, weight`` of stated relations between members' nodes.

    ``nodes(doc, node, type, provenance)`` belong to members; ``relations(relation, source_doc, source, target_doc, target,
    type, weight)``.  Refused: a repeated document, node or relation, a member that isn't current, a relation inside one
    document or to a node that no member holds.  Both ends are found by joins on (document, node); an id depends on its ends'
    contents and on the set.
    """
    held = _once(nodes.select("doc", "node", F.col("type").alias("node_type"), "provenance"), ["doc", "node"], "nodes")
    held = held.join(members.select("doc", "generation", "graph"), "doc").select("doc", "node", content_id(*map(F.col, NODE)).alias("reference"))
    end = lambda side: held.select(F.col("doc").alias(f"{side}_doc"), F.col("node").alias(side), F.col("reference").alias(f"_{side}"))
    r = _once(relations, ["relation"], "relations")
    r = r.join(end("source"), ["source_doc", "source"], "left").join(end("target"), ["target_doc", "target"], "left")
    bad = F.when(F.col("_source").isNull() | F.col("_target").isNull(), F.raise_error(F.lit("a relation names a node that no member holds")).cast("string"))
    bad = bad.when(F.col("source_doc") == F.col("target_doc"), F.raise_error(F.lit("a relation stays inside one document")).cast("string"))
    one = F.broadcast(graph_set(members, key).select("set_id"))  # one row
    edge = F.coalesce(bad, content_id(F.col("set_id"), F.col("_source"), F.col("_target"), F.col("type"), F.col("relation")))
    return r.join(one, F.lit(True)).select(edge.alias("edge_id"), "set_id", "relation", "source_doc", "source", "target_doc", "target", "type", "weight")
