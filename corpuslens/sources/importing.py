"""Raw JSON rows of foreign layouts as governed corpora and benchmark examples."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.operators.lineage import cut


@dataclass(frozen=True)
class CorpusProfile:
    """Where a layout keeps its fields: JSON paths to try in turn, such as ``$.meta.id``."""

    name: str
    document_id: tuple[str, ...]
    text: tuple[str, ...]
    title: tuple[str, ...] = ()
    source_group: tuple[str, ...] = ()
    metadata: dict[str, tuple[str, ...]] = field(default_factory=dict)


def first_of(value: Column, paths: tuple[str, ...]) -> Column:
    """The first path of a variant that holds something, as text; null where none does or where there are no paths."""
    found = [F.try_variant_get(value, p, "string") for p in paths]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def mapped(raw: DataFrame, profile: CorpusProfile, json: str = "json") -> DataFrame:
    """``document_id, text, title, source_group, metadata`` of each row; metadata keeps what is there and names the profile."""
    v = F.col("_v")
    kept = F.array_compact(F.array(*[F.when(first_of(v, p).isNotNull(), F.struct(F.lit(k).alias("key"), first_of(v, p).alias("value"))) for k, p in profile.metadata.items()]))
    about = F.array(F.struct(F.lit("corpus_profile").alias("key"), F.lit(profile.name).alias("value")))
    entries = F.concat(kept, about) if profile.metadata else about
    rows = raw.select(F.try_parse_json(json).alias("_v"))
    return rows.select(
        first_of(v, profile.document_id).alias("document_id"), first_of(v, profile.text).alias("text"), first_of(v, profile.title).alias("title"),
        first_of(v, profile.source_group).alias("source_group"), F.map_from_entries(entries).alias("metadata"),
    )


def set_digest(ids: Column) -> Column:
    """An aggregate over ids that doesn't depend on their order: the sum of the first 15 hexadecimal digits of their SHA-256."""
    return F.sum(F.conv(F.substring(F.sha2(ids.cast("string"), 256), 1, 15), 16, 10).cast("decimal(38,0)")).cast("string")


def import_corpus(raw: DataFrame, profile: CorpusProfile, expected: int | None = None, json: str = "json") -> tuple[DataFrame, DataFrame]:
    """The mapped rows, written once, and their receipt: ``profile, n, ids_digest, n_groups, groups_digest``.

    Refused are rows that aren't JSON objects with an id and a text, ids that occur twice, an empty corpus, and another
    number of rows than ``expected``.
    """
    rows = cut(mapped(raw, profile, json))
    bad = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("document_id").isNull() | F.col("text").isNull(), 1)).alias("lacking")).first()
    if bad.lacking:
        raise ValueError(f"{bad.lacking} rows lack a document id or text")
    if not bad.n:
        raise ValueError("a corpus may not be empty")
    if expected is not None and bad.n != expected:
        raise ValueError(f"{bad.n} rows, not {expected}")
    twice = rows.groupBy("document_id").agg(F.count("*").alias("n")).where("n > 1").select("document_id").head()
    if twice is not None:
        raise ValueError(f"duplicate document id {twice.document_id!r}")
    groups = rows.where("source_group is not null").select("source_group").distinct().agg(F.count("*").alias("n_groups"), set_digest(F.col("source_group")).alias("groups_digest"))
    receipt = rows.agg(F.lit(profile.name).alias("profile"), F.count("*").alias("n"), set_digest(F.col("document_id")).alias("ids_digest"))
    return rows, receipt.join(groups, F.lit(True))  # one row each


# benchmark examples of five layouts in one schema

_STRINGS = "array<string>"


def _text(value: Column) -> Column:
    """Trimmed text; null, false, zero and empty values are empty."""
    t = F.trim(F.coalesce(value, F.lit("")))
    return F.when(t.isin("false", "0", "0.0", "null", "[]", "{}"), "").otherwise(t)


def _at(json: Column, *paths: str) -> Column:
    """The first path with a value that isn't empty, as text (JSON where it is nested)."""
    return F.coalesce(*[F.nullif(_text(F.get_json_object(json, p)), F.lit("")) for p in paths])


def _plain(item: Column) -> Column:
    """A JSON string without its quotes; anything else as it is."""
    return F.when(item.startswith('"'), F.from_json(F.concat(F.lit("["), item, F.lit("]")), _STRINGS)[0]).otherwise(item)


def _list(json: Column) -> Column:
    """A JSON array as texts (nested values as JSON); null for anything else."""
    return F.when(json.startswith("["), F.from_json(json, _STRINGS))


def _answers(json: Column, deep: int = 2) -> Column:
    """Texts of an answer: one, several, or those under text, answer or answers of an object."""
    several = F.filter(F.transform(_list(json), _text), lambda x: x != "")
    found = F.when(json.isNull(), F.array().cast(_STRINGS)).when(json.startswith("["), several)
    if deep:
        inner = F.coalesce(*[F.get_json_object(json, f"$.{k}") for k in ("text", "answer", "answers")])
        found = found.when(json.startswith("{"), _answers(inner, deep - 1))
    one = _text(_plain(json))
    return found.otherwise(F.when(one != "", F.array(one)).otherwise(F.array().cast(_STRINGS)))


def _joined(title: Column, text: Column) -> Column:
    return F.trim(F.concat(title, F.lit("\n"), text))


def _example(json: Column, id_: Column, query: Column, answers: Column, relevant: Column, contexts: Column, dataset: str, more: Column | None = None) -> list[Column]:
    none = F.array().cast(_STRINGS)
    about = F.create_map(F.lit("dataset"), F.lit(dataset))
    return [
        F.coalesce(id_, F.lit("")).alias("id"), F.coalesce(query, F.lit("")).alias("query"), F.coalesce(answers, none).alias("answers"), F.coalesce(relevant, none).alias("relevant_ids"),
        F.coalesce(contexts, none).alias("contexts"), (about if more is None else F.map_concat(about, more)).alias("metadata"),
    ]


def _hotpotqa(j: Column) -> list[Column]:
    named = F.transform(_list(F.get_json_object(j, "$.supporting_facts")), lambda f: _text(_list(f)[0]))
    parts = F.filter(F.transform(_list(F.get_json_object(j, "$.context")), _list), lambda p: F.size(p) >= 2)
    sentences = lambda p: F.when(p[1].startswith("["), F.array_join(F.transform(_list(p[1]), _text), " ")).otherwise(_text(p[1]))
    relevant = F.filter(F.transform(parts, lambda p: _text(p[0])), lambda t: F.array_contains(F.coalesce(named, F.array().cast(_STRINGS)), t))
    return _example(j, _at(j, "$._id", "$.id"), _at(j, "$.question", "$.query"), _answers(F.get_json_object(j, "$.answer")), relevant, F.transform(parts, lambda p: _joined(_text(p[0]), sentences(p))), "hotpotqa")


def _musique(j: Column) -> list[Column]:
    items = _list(_at(j, "$.paragraphs", "$.contexts"))
    title = lambda p, i: F.coalesce(_at(p, "$.title", "$.idx"), F.when(i > 0, i.cast("string")).otherwise(""))
    text = lambda p, i: F.when(p.startswith("{"), _joined(title(p, i), F.coalesce(_at(p, "$.paragraph_text", "$.text"), F.lit("")))).otherwise(_text(p))
    marked = F.transform(items, lambda p, i: F.when(p.startswith("{") & (F.get_json_object(p, "$.is_supporting") == "true"), title(p, i)))
    return _example(j, _at(j, "$.id", "$._id"), _at(j, "$.question", "$.query"), _answers(_at(j, "$.answer", "$.answers")), F.array_compact(marked), F.transform(items, text), "musique")


def _qasper(j: Column) -> list[Column]:
    q = _at(j, "$.question")
    nested = q.startswith("{")
    query = F.when(nested, _at(q, "$.question", "$.text")).otherwise(q)
    answers = F.when(nested, _answers(F.get_json_object(q, "$.answers"))).otherwise(_answers(_at(j, "$.answers", "$.answer")))
    whole = _at(j, "$.full_text", "$.contexts")
    sections = F.map_entries(F.from_json(F.when(whole.startswith("{"), whole), "map<string,string>"))
    part = lambda s: F.when(s.value.startswith("["), F.transform(_list(s.value), lambda p: _joined(s.key, _text(p)))).otherwise(F.array(_joined(s.key, _text(s.value))))
    listed = F.filter(F.transform(_list(whole), _text), lambda x: x != "")
    contexts = F.when(whole.startswith("{"), F.flatten(F.transform(sections, part))).otherwise(listed)
    id_ = F.when(nested, F.coalesce(_at(q, "$.question_id"), _at(j, "$.id"))).otherwise(_at(j, "$.id"))
    return _example(j, id_, query, answers, F.array().cast(_STRINGS), contexts, "qasper")


def _scifact(j: Column) -> list[Column]:
    e = _at(j, "$.evidence")
    keys = F.map_keys(F.from_json(F.when(e.startswith("{"), e), "map<string,string>"))
    items = F.transform(_list(e), lambda x: F.when(x.startswith("{"), F.coalesce(_at(x, "$.doc_id", "$.document_id"), F.lit(""))).otherwise(_text(x)))
    relevant = F.filter(F.coalesce(keys, items), lambda x: x != "")
    return _example(j, _at(j, "$.id", "$.claim_id"), _at(j, "$.claim", "$.question", "$.query"), _answers(_at(j, "$.label", "$.answer")), relevant, F.array().cast(_STRINGS), "scifact")


def _miracl(j: Column) -> list[Column]:
    items = F.filter(_list(_at(j, "$.positive_passages", "$.positives")), lambda x: x.startswith("{"))
    ids = F.filter(F.transform(items, lambda x: _at(x, "$.docid", "$.id")), lambda x: x.isNotNull())
    texts = F.filter(F.transform(items, lambda x: _at(x, "$.text", "$.passage")), lambda x: x.isNotNull())
    lang = _at(j, "$.lang")
    more = F.when(lang.isNotNull(), F.create_map(F.lit("language"), lang)).otherwise(F.create_map().cast("map<string,string>"))
    return _example(j, _at(j, "$.query_id", "$.id"), _at(j, "$.query", "$.question"), _answers(F.get_json_object(j, "$.answers")), ids, texts, "miracl", more)


ADAPTERS = {"hotpotqa": _hotpotqa, "musique": _musique, "qasper": _qasper, "scifact": _scifact, "miracl": _miracl}


def adapted(raw: DataFrame, dataset: str, json: str = "json") -> DataFrame:
    """``id, query, answers, relevant_ids, contexts, metadata`` of raw rows of one of the ADAPTERS' layouts.

    Only JSON functions in the row: no shuffle, no Python.  A row without a query is refused.
    """
    if dataset.lower() not in ADAPTERS:
        raise ValueError(f"unsupported benchmark dataset: {dataset}")
    rows = raw.select(*ADAPTERS[dataset.lower()](F.col(json)))
    asked = F.when(F.col("query") != "", F.col("query")).otherwise(F.raise_error(F.lit("benchmark rows must have a query")))
    return rows.withColumn("query", asked)


# gold labels

GOLD = ("item", "case", "evidence", "label", "schema", "round")


def gold_labels(cases: DataFrame, task: str) -> DataFrame:
    """The records of ``GOLD`` of items whose latest case of any task is resolved and of ``task``.

    ``cases(item, case, round, task, state, label, schema, evidence)``; of several cases of a round the largest id counts.
    A resolved case without a label is refused.
    """
    last = cases.groupBy("item").agg(F.max(F.struct("round", "case", "task", "state", "label", "schema", "evidence")).alias("c"))
    done = last.select("item", "c.*").where((F.col("state") == "resolved") & (F.col("task") == task))
    label = F.coalesce(F.col("label").cast("string"), F.raise_error(F.lit("a resolved case has no label")).cast("string"))
    return done.withColumn("label", label).select(*GOLD)


def write_gold(labels: DataFrame, path: str) -> DataFrame:
    """Writes gold labels as JSON lines in order of their items, part by part, and returns their receipt: ``n, digest``.

    The digest doesn't depend on how the rows are dealt over files, so a reader can compute it again.  A path that exists
    isn't written again, and a manifest without labels is refused.
    """
    labels.orderBy("item").write.mode("errorifexists").json(path)
    return gold_receipt(labels.sparkSession.read.schema(labels.schema).json(path))


def gold_receipt(labels: DataFrame) -> DataFrame:
    record = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in GOLD])
    n = F.when(F.count("*") == 0, F.raise_error(F.lit("there are no gold labels")).cast("long")).otherwise(F.count("*"))
    return labels.agg(n.alias("n"), set_digest(record).alias("digest"))
