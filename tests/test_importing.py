"""Imports by paths, adapters and named contexts: hand-made rows and brute force."""

import datetime
import json
import re

import pytest

from corpuslens.operators import contexts
from corpuslens.plans import catalog, mechanisms
from corpuslens.sources import importing

SF = "/root/testdata/sf0.001"
PROFILE = importing.CorpusProfile("p", ("$.id", "$.meta.key"), ("$.body", "$.text"), ("$.title",), ("$.src",), {"year": ("$.y", "$.meta.year"), "tag": ("$.tags[0]",)})


def raw(spark, rows):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in rows], "json string")


def test_paths_fall_back(spark):
    rows = [{"id": 7, "body": "one", "title": "T", "src": "s", "y": 1999, "tags": ["a", "b"]}, {"meta": {"key": "k", "year": "2001"}, "text": "zwei", "src": "s"}, {"id": 0, "text": ""}]
    got, receipt = importing.import_corpus(raw(spark, rows), PROFILE, expected=3)
    assert {(r.document_id, r.text, r.title, r.source_group, tuple(sorted(r.metadata.items()))) for r in got.collect()} == {
        ("7", "one", "T", "s", (("corpus_profile", "p"), ("tag", "a"), ("year", "1999"))), ("k", "zwei", None, "s", (("corpus_profile", "p"), ("year", "2001"))), ("0", "", None, None, (("corpus_profile", "p"),)),
    }
    again = importing.import_corpus(raw(spark, rows[::-1]).repartition(3), PROFILE)[1].collect()
    assert receipt.collect() == again and again[0].n == 3 and again[0].n_groups == 1


@pytest.mark.parametrize("rows, message", [([{"id": 1, "body": "x"}, {"meta": {"key": "1"}, "text": "y"}], "duplicate"), ([{"id": 1}], "lack"), (["not json", {"id": 1, "text": "x"}], "lack"), ([], "empty")])
def test_bad_corpora_are_refused(spark, rows, message):
    with pytest.raises(ValueError, match=message):
        importing.import_corpus(raw(spark, rows), PROFILE)
    with pytest.raises(ValueError, match="not 5"):
        importing.import_corpus(raw(spark, [{"id": 1, "text": "x"}]), PROFILE, expected=5)


ADAPTED = {
    "hotpotqa": [
        ({"_id": "h", "question": " Q? ", "answer": "A", "supporting_facts": [["T1", 0], ["T9", 1]], "context": [["T1", ["a.", " b."]], ["T2", "c"], ["short"]]}, ("h", "Q?", ["A"], ["T1"], ["T1\na. b.", "T2\nc"])),
        ({"id": 3, "query": "Q", "answer": ["x", " ", "y"]}, ("3", "Q", ["x", "y"], [], [])),
    ],
    "musique": [
        ({"id": "m", "question": "Q", "answer": {"text": ["u", "v"]}, "paragraphs": [{"title": "T", "paragraph_text": "p", "is_supporting": True}, {"idx": 4, "text": "q", "is_supporting": False}, {"text": "r", "is_supporting": True}, "plain"]},
         ("m", "Q", ["u", "v"], ["T", "2"], ["T\np", "4\nq", "2\nr", "plain"])),
        ({"_id": "n", "query": "Q", "answers": "one"}, ("n", "Q", ["one"], [], [])),
    ],
    "qasper": [
        ({"id": "r", "question": {"question": "Q", "question_id": "q1", "answers": [" a "]}, "full_text": {"Intro": ["p1", "p2"], "End": "p3"}}, ("q1", "Q", ["a"], [], ["Intro\np1", "Intro\np2", "End\np3"])),
        ({"id": "s", "question": "Q", "answers": {"answer": "z"}, "contexts": ["c", "", "d"]}, ("s", "Q", ["z"], [], ["c", "d"])),
    ],
    "scifact": [
        ({"id": 5, "claim": "C", "label": "SUPPORT", "evidence": {"11": [1], "12": []}}, ("5", "C", ["SUPPORT"], ["11", "12"], [])),
        ({"claim_id": 6, "query": "C", "answer": None, "evidence": [{"doc_id": 3}, {"document_id": "d"}, "e", {}]}, ("6", "C", [], ["3", "d", "e"], [])),
    ],
    "miracl": [
        ({"query_id": "q", "query": "Q", "answers": ["a"], "positive_passages": [{"docid": "1", "text": "t"}, {"id": 2, "passage": ""}, "skip"], "lang": "de"}, ("q", "Q", ["a"], ["1", "2"], ["t"])),
        ({"id": "w", "question": "Q"}, ("w", "Q", [], [], [])),
    ],
}


@pytest.mark.parametrize("dataset", sorted(ADAPTED))
def test_adapters(spark, dataset):
    rows, expected = zip(*ADAPTED[dataset])
    got = importing.adapted(raw(spark, rows).coalesce(1), dataset).collect()
    assert [(r.id, r.query, r.answers, r.relevant_ids, r.contexts) for r in got] == list(expected)
    assert all(r.metadata["dataset"] == dataset for r in got)
    with pytest.raises(Exception, match="must have a query"):
        importing.adapted(raw(spark, [{"id": "x"}]), dataset).collect()
    with pytest.raises(ValueError, match="unsupported"):
        importing.adapted(raw(spark, rows), "other")


def test_named_entities_and_times(spark):
    q = spark.createDataFrame([(1, "In 2024-02-30 and 2024-05-06 the C++ Group met New  York, 1999; new york!"), (2, "NEW YORK (2100) 12024 2024-05-061"), (3, None), (4, "")], "query_id int, text string")
    aliases = spark.createDataFrame([("new york", "e1", "NY"), ("York", "e2", "Y"), ("C++ group", "e3", "C"), ("ork", "e4", "-"), ("group met", "e5", "g"), (None, "e6", "-")], "alias string, entity string, name string")
    got = {(r.query_id, r.entity, r.surface) for r in contexts.named_entities(q, aliases).collect()}
    assert got == {(1, "e1", "new york"), (1, "e2", "York"), (1, "e3", "C++ Group"), (1, "e5", "Group met"), (2, "e1", "NEW YORK"), (2, "e2", "YORK")}
    utc = lambda y, m=1, d=1: datetime.datetime(y, m, d, tzinfo=datetime.UTC).timestamp()
    times = {(r.query_id, r.start_utc, round(r.end_utc), r.precision, r.surface) for r in contexts.named_times(q).collect()}
    assert times == {
        (1, utc(2024, 5, 6), utc(2024, 5, 7), "day", "2024-05-06"), (1, utc(2024), utc(2025), "year", "2024"), (1, utc(1999), utc(2000), "year", "1999"),
        (2, utc(2100), utc(2101), "year", "2100"), (2, utc(2024), utc(2025), "year", "2024"),
    }
    with pytest.raises(Exception, match="without a word"):
        contexts.named_entities(q, spark.createDataFrame([("++", "e", "n")], aliases.schema)).collect()


def test_named_contexts_of_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    aliases = {(r.alias, r.entity) for r in mechanisms.item_aliases(spark, SF).collect()}
    expected = set()
    for doc, text in texts.items():
        for alias, entity in aliases:
            m = re.search(rf"(?<!\w){re.escape(alias)}(?!\w)", text.strip(), re.I)
            if m:
                expected.add((doc, alias, m[0], entity))
    assert {tuple(r) for r in catalog.queries()["b16_named_entities"](spark, SF).select("doc_id", "alias", "surface", "entity").collect()} == expected and expected
    n = 0
    for text in texts.values():
        taken = []
        for m in re.finditer(r"(?<!\d)(\d{4})-(\d{2})-(\d{2})(?!\d)", text):
            try:
                datetime.datetime(*map(int, m.groups()))
            except ValueError:
                continue
            taken.append(m.span())
        n += len(taken) + sum(not any(a <= m.start() and m.end() <= b for a, b in taken) for m in re.finditer(r"(?<!\d)(1\d{3}|20\d{2}|2100)(?!\d)", text))
    assert sum(r.n for r in catalog.queries()["b16_named_times"](spark, SF).collect()) == n
