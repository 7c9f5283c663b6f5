"""Small hand-made cases of the core operators."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpuslens.functions import text as X
from corpuslens.functions.dates import temporal_interval
from corpuslens.functions.numbers import convert, parse_cell
from corpuslens.operators import assess, evaluation, governance, graph, prepare, ranking, retrieval, series, statistics
from corpuslens.operators.lineage import cut
from corpuslens.sources import readers
from corpuslens.streaming import events as streams


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_tokens_keep_inner_marks_and_drop_stop_words(spark):
    assert one(spark, X.index_tokens(F.col("t")), t="The state-of-the-art of X, 3 a GPT-4/5 b") == ["state-of-the-art", "x", "3", "gpt-4/5"]
    assert one(spark, X.field_tokens(F.col("t")), t="A b-c d_e:1") == ["a", "b-c", "d_e:1"]


def test_urls(spark):
    url = lambda u: one(spark, X.normalized_url(F.col("u")), u=u)
    assert url("HTTP://Example.COM:80//a//b/?utm_source=x&b=2&a=1#f") == "http://example.com/a/b?a=1&b=2"
    assert url("ftp://example.com/") is None and url("http://u@example.com/") is None
    assert url("https://example.com") == "https://example.com/"


def test_dates_numbers_units(spark):
    got = lambda e: one(spark, temporal_interval(F.col("e"), F.to_date(F.lit("2024-05-10"))), e=e)
    assert str(got("2024-02").end_date) == "2024-03-01" and got("2019 to 2021").precision == "range"
    assert str(got("last 3 days").start_date) == "2024-05-07" and str(got("tomorrow").start_date) == "2024-05-11"
    assert got("soon").start_date is None
    assert one(spark, parse_cell(F.col("c")), c="(1,234.5)") == -1234.5 and one(spark, parse_cell(F.col("c")), c="12%") == 0.12
    rows = spark.createDataFrame([(1.0, "km"), (1.0, "h"), (0.0, "?")], "v double, u string")
    assert [r.y for r in convert(rows, "v", "u", F.lit("m"), "y").collect()] == [1000.0, None, None]


def test_chunks_overlap_and_cover(spark):
    text = "".join(chr(97 + i % 26) for i in range(2500))
    docs = spark.createDataFrame([(1, text), (2, "short"), (3, "")], "doc_id long, text string")
    got = prepare.fixed_chunks(docs, 1000, 120).where("doc_id = 1").orderBy("chunk_no").collect()
    assert [len(r.chunk) for r in got] == [1000, 1000, 740] and got[1].chunk == text[880:1880]
    packed = prepare.semantic_chunks(docs, 100).where("doc_id = 1").collect()
    assert max(len(r.chunk) for r in packed) <= 100 and "".join(r.chunk for r in packed) == text


def test_rarer_terms_rank_first(spark):
    docs = spark.createDataFrame([(1, "quantum quantum words"), (2, "other words"), (3, "quantum field")], "doc_id long, text string")
    q = spark.createDataFrame([(9, "quantum field")], "query_id long, text string")
    hits = retrieval.search(retrieval.query_terms(q), docs).orderBy("position").collect()
    assert [r.doc_id for r in hits] == [3, 1] and abs(hits[0].cosine - 1) < 1e-9
    best = retrieval.top_k(retrieval.bm25(retrieval.query_terms(q, tokens=X.field_tokens), docs), 1).first()
    assert best.doc_id == 3 and best.score == 1.0


def test_rank_sums_to_one_and_favours_sinks(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c")], "src string, dst string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    got = {r.node: r["rank"] for r in retrieval.pagerank(edges, nodes, 30).collect()}
    assert abs(sum(got.values()) - 1) < 1e-9 and got["c"] > got["b"] > got["a"]


def test_fusion_and_diversity(spark):
    lists = spark.createDataFrame([("x", 1, 10, 1), ("x", 1, 10, 2), ("x", 1, 11, 3), ("y", 1, 11, 1), ("y", 1, 10, 2)], "list string, query_id long, doc_id long, position int")
    got = {r.doc_id: r.score for r in ranking.rank_fusion(lists, {"x": 0.75, "y": 0.25}, 0).collect()}
    assert got[10] == 1.0 and abs(got[11] - 0.5 / 0.875) < 1e-9
    pool = spark.createDataFrame([(1, 1, "s", 1.0, ["a", "b"]), (1, 2, "t", 0.9, ["a", "b"]), (1, 3, "u", 0.6, ["c"])], "query_id long, doc_id long, source string, score double, tokens array<string>")
    assert [r.doc_id for r in ranking.diverse(pool, 2).orderBy("position").collect()] == [1, 3]
    points = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 1.0), ("c", 3.0, 5.0), ("d", 2.0, 6.0)], "k string, q double, c double")
    assert {r.k for r in ranking.frontier(points, "k", ["q"], ["c"]).collect()} == {"b", "c"}


def test_metrics_by_hand(spark):
    ranked = spark.createDataFrame([(1, 1, 1), (1, 3, 2), (1, 2, 3)], "query_id long, doc_id long, position int")
    gains = spark.createDataFrame([(1, 1, 2), (1, 2, 1)], "query_id long, doc_id long, gain int")
    r = evaluation.retrieval_metrics(ranked, gains, (1, 3)).first()
    assert r.precision_1 == 1 and r.recall_3 == 1 and abs(r.map_3 - (1 + 2 / 3) / 2) < 1e-9
    assert abs(r.ndcg_3 - (3 + 1 / 2) / (3 + 0.6309297535714575)) < 1e-9


def test_isotonic_is_monotone_and_pools(spark):
    rows = spark.createDataFrame([("a", 0.1, 0), ("a", 0.2, 1), ("a", 0.3, 0), ("a", 0.9, 1)], "g string, conf double, y int")
    got = [(r.lo, r.hi, r.value) for r in statistics.isotonic(rows, "g").orderBy("lo").collect()]
    assert got == [(0.1, 0.1, 0.0), (0.2, 0.3, 0.5), (0.9, 0.9, 1.0)]


def test_resampling_repeats_and_brackets(spark):
    pairs = spark.range(300).select(F.col("id"), (F.col("id") % 5 - 1.5).alias("difference"))
    a, b = statistics.paired_resamples(pairs, 50).toPandas(), statistics.paired_resamples(pairs.repartition(3), 50).toPandas()
    pd.testing.assert_frame_equal(a.sort_values("sample").reset_index(drop=True), b.sort_values("sample").reset_index(drop=True))
    assert a.mean_difference.min() < 0.5 < a.mean_difference.max()
    assert statistics.sign_flips(pairs, 99).first().p_value < 0.05
    fit = statistics.softmax_fit(spark.range(200).select((F.col("id") / 100 - 1).alias("x"), (F.col("id") > 100).cast("int").alias("y")), ["x"], "y", 20)
    assert fit[1] > 0.5


def test_walks(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 4)], "src long, dst long")
    got = {r.node: r.depth for r in graph.hops(edges, spark.createDataFrame([(1,)], "node long"), 5).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 2}
    paths = graph.simple_paths(edges, spark.createDataFrame([(1,)], "node long"), spark.createDataFrame([(4,), (1,)], "node long"), 3).collect()
    assert [r.path for r in paths] == [[1, 2, 4]]


@pytest.mark.parametrize(("paths", "ends"), [(1 << 21, 1_024), (3, 2)])
@pytest.mark.parametrize("far", [0, 10**17])
def test_paths_of_two(spark, monkeypatch, paths, ends, far):
    monkeypatch.setattr(graph, "PATHS", paths)
    monkeypatch.setattr(graph, "ENDS", ends)
    draw = random.Random(5)
    nodes = [0, 1, 9, 10, 12, 99, 100, 120, 121, 129, 1200, 12999, 129999, 999, 9999, 10**14, 2 * 10**14 - 1, 7 + far]
    edges = [(draw.choice(nodes), draw.choice(nodes)) for _ in range(140)]
    df = spark.createDataFrame(edges, "src long, dst long")
    found = {}
    for a, m in set(edges):
        for c, z in set(edges):
            if m == c and len({a, m, z}) == 3 and a < 1000 and z > 5:
                found.setdefault((a, z), []).append(f"{a}>{m}>{z}")
    got = graph.paths_of_two(df.where("src < 1000"), df.where("dst > 5"))
    assert {(r.src, r.dst): (r.n_paths, r.first_path) for r in got.collect()} == {k: (len(v), min(v)) for k, v in found.items()}


def test_chrf_counts_runs_of_characters_in_the_row(spark, tmp_path):
    from corpuslens.plans import catalog

    texts = {1: ["the cat  sat", "a cat sat", "", "", "x", "xx yy \U0001f600z"], 2: ["only"], 3: ["ab", None, "ab"]}
    rows = [(c, t, "user", x) for c, xs in texts.items() for t, x in enumerate(xs)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = catalog.queries()["g13_chrf"](spark, str(tmp_path))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2  # texts are shuffled, runs are not
    grams = lambda t, n: [t[i : i + n] for i in range(len(t) - n + 1)]
    want = {}
    for c, xs in texts.items():
        for t, (a, b) in enumerate(zip(xs, xs[1:])):
            a, b = (a or "").replace(" ", ""), None if b is None else b.replace(" ", "")
            n = [n for n in range(1, 7) if b is not None and (grams(a, n) or grams(b, n))]
            if n:
                shared = [sum(min(grams(a, k).count(g), grams(b, k).count(g)) for g in set(grams(a, k))) for k in n]
                p, r = (sum(s / max(len(grams(x, k)), 1) for s, k in zip(shared, n)) / len(n) for x in (a, b))
                want[c, t] = 5 * p * r / (4 * p + r) if p + r else 0.0
    assert {(r.conv_id, r.turn): r.chrf for r in got.collect()} == pytest.approx(want, abs=1e-6) and len(want) == 5


def test_series(spark):
    pts = spark.createDataFrame([("a", 0.0, 1.0), ("a", 10.0, 3.0), ("a", 20.0, 3.0)], "k string, t double, v double")
    assert series.integral(pts, "k", "t", "v").first().volume == 50.0
    assert series.peaks(pts, "k", "t", "v").first().peak_time == 10.0


def test_readers(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text("\n".join(json.dumps(x) for x in ({"_id": "d1", "title": "Alpha", "text": "one"}, {"_id": "d2", "text": "two"})))
    (tmp_path / "queries.jsonl").write_text(json.dumps({"_id": "q1", "text": "alpha"}))
    (tmp_path / "qrels/test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t2\nq1\td2\t0\n")
    s = readers.retrieval_set(spark, str(tmp_path))
    assert {r.text for r in s["corpus"].collect()} == {"Alpha\n\none", "two"} and s["qrels"].count() == 1
    (tmp_path / "trec.txt").write_text("q1 0 d1 2\nq1 d2 1\nbad\nq1 0 d3 0\n")
    assert {r.doc_id for r in readers.judgements(spark, str(tmp_path / "trec.txt")).collect()} == {"d1", "d2"}
    files = readers.file_manifest(spark, str(tmp_path / "qrels"))
    assert readers.manifest_problems(files, files).count() == 0
    assert readers.manifest_problems(files, files.withColumn("sha256", F.lit("x"))).first().problem == "differs"
    readers.write_generation(s["corpus"], str(tmp_path / "gen"), 1)
    readers.write_generation(s["corpus"].limit(1), str(tmp_path / "gen"), 2)
    assert readers.read_current(spark, str(tmp_path / "gen")).count() == 1
    (tmp_path / "rows.json").write_text('{"a": 1}\nnot json\n')
    good, bad = readers.quarantined(spark, str(tmp_path / "rows.json"), "a long")
    assert good.count() == 1 and bad.count() == 1


def test_streams_match_their_batch_twins(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    events = spark.read.parquet(src)
    inbox = tmp_path / "in"
    events.coalesce(1).write.parquet(str(inbox))
    out = str(tmp_path / "out")
    streams.streamed(
        spark, str(inbox), events.schema, lambda e: streams.tumbling_quota(e, "user_id", "1 day", 50.0), "1 hour", out, str(tmp_path / "c1"),
    )
    got = spark.read.parquet(out)
    batch = streams.tumbling_quota(events.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "1 day", 50.0)
    assert 0 < got.count() <= batch.count()  # windows that the watermark has not closed stay in the state
    joined = got.join(batch.withColumnsRenamed({"requests": "r", "units": "u", "remaining": "m"}), ["user_id", "start"])
    assert joined.where("requests = r").count() == got.count()
    out = str(tmp_path / "dedup")
    streams.streamed(spark, str(inbox), events.schema, lambda e: streams.deduplicated_stream(e, ["event_id"]), "1 hour", out, str(tmp_path / "c2"))
    assert spark.read.parquet(out).count() == events.count()


# redaction, walks, orders and gates


def test_redaction_checks_cards_and_addresses(spark):
    texts = {
        "pay 4539 1488 0343 6467 now": "pay [REDACTED_PAYMENT_CARD] now",
        "order 1234 5678 9012 3456 now": "order [REDACTED_PHONE] now",
        "card 1111111111111111": "card [REDACTED_PHONE]",
        "login from 10.0.0.1. Then call (555) 123-4567.": "login from [REDACTED_IP]. Then call ([REDACTED_PHONE].",
        "tel 020 7946 0958, room 1234567": "tel [REDACTED_PHONE], room 1234567",
        "at 12 Long Hill Road, call +1 (555) 010-9999 or a.b@c.org": "at [REDACTED_ADDRESS], call [REDACTED_PHONE] or [REDACTED_EMAIL]",
        "from 10.0.0.255 and 10.0.0.256": "from [REDACTED_IP] and 10.0.0.256",
        "": "",
    }
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", X.redacted(F.col("t")).alias("r")).collect()
    assert {r.t: r.r for r in rows} == texts | {None: ""}


def test_rouge_l_matches_dynamic_programming(spark):
    import random

    def lcs(a, b):
        m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                m[i + 1][j + 1] = m[i][j] + 1 if x == y else max(m[i][j + 1], m[i + 1][j])
        return m[-1][-1]

    draw = random.Random(3)
    pairs = [([draw.choice("abcd") for _ in range(draw.randint(0, 12))], [draw.choice("abcd") for _ in range(draw.randint(0, 12))]) for _ in range(60)]
    got = [r.s for r in spark.createDataFrame(pairs, "a array<string>, b array<string>").select(assess.rouge_l("a", "b").alias("s")).collect()]
    assert all(abs(s - (2 * lcs(a, b) / (len(a) + len(b)) if a and b else 0)) < 1e-9 for s, (a, b) in zip(got, pairs, strict=True))


def test_seeded_order_is_a_repeatable_permutation(spark):
    from corpuslens.operators.prepare import seeded_order

    rows = spark.range(500)
    one = {r.nth: r.id for r in seeded_order(rows, "id", 7, 1).collect()}
    again = {r.nth: r.id for r in seeded_order(rows.repartition(7), "id", 7, 1).collect()}
    other = {r.nth: r.id for r in seeded_order(rows, "id", 7, 2).collect()}
    assert sorted(one) == list(range(1, 501)) and sorted(one.values()) == list(range(500)) and one == again and one != other


def test_levels_leave_cycles_out(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (4, 5), (5, 4), (3, 4)], "src long, dst long")
    assert {r.node: r.level for r in graph.topological_levels(e).collect()} == {1: 0, 2: 1, 3: 2}
    paths = graph.weighted_paths(e.withColumn("w", F.lit(2.0)), spark.createDataFrame([(1,)], "node long"), "w", 3).collect()
    assert sorted((r.dst, r.hops, r.length) for r in paths if r.dst == 3) == [(3, 1, 2.0), (3, 2, 4.0)]


def test_entities_resolve_by_alias_tokens_and_margin(spark):
    al = spark.createDataFrame([("A", "big blue river"), ("B", "small lake"), ("C", "small lake north"), ("D", "small lake")], "entity string, alias string")
    m = spark.createDataFrame([("big blue river",), ("river blue big",), ("small lake",), ("lake small",), ("desert",), (None,)], "mention string")
    got = {r.mention: (r.entity, r.how) for r in governance.resolve_entities(m, al).collect()}
    assert got == {"big blue river": ("A", "exact"), "river blue big": ("A", "similar"), "small lake": ("B", "exact"), "lake small": (None, "ambiguous"), "desert": (None, "unknown")}


def test_pagerank_stops_at_a_tolerance(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 2)], "src long, dst long")
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "node long")
    calls = []
    keep = lambda df: (calls.append(1), cut(df))[1]
    far = {r.node: r.rank for r in retrieval.pagerank(e, nodes, 25).collect()}
    near = {r.node: r.rank for r in retrieval.pagerank(e, nodes, 60, keep=keep, tolerance=1e-3).collect()}
    assert len(calls) < 45 and all(abs(far[k] - near[k]) < 5e-3 for k in far)


def test_term_counts_match_plain_counts(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["c"])], "k long, t array<string>")
    got = {(r.k, r.term): r.tf for r in retrieval.term_counts(rows, "k", F.col("t")).collect()}
    assert got == {(1, "a"): 1, (1, "b"): 2, (4, "c"): 1}


def test_evidence_cover_is_whole_and_greedy(spark):
    from corpuslens.operators import selection

    rows = [(1, 10, "a", 0.5, [1, 2, 3]), (1, 11, "a", 0.9, [3, 4]), (1, 12, "b", 0.1, [4, 5]), (1, 13, "b", 0.8, [5]), (2, 20, "a", 0.3, [])]
    e = spark.createDataFrame(rows, "question long, evidence long, root string, score double, claims array<long>")
    cover = selection.evidence_cover(e)
    assert sorted(tuple(r) for r in cover.collect()) == [(1, 10, 1, 3), (1, 12, 2, 2)]
    required = spark.createDataFrame([(1, [1, 2, 3, 4, 5, 6]), (2, []), (3, [1])], "question long, claims array<long>")
    e = e.withColumn("contradicts", F.when(F.col("evidence") == 13, F.array(F.lit(6).cast("long"))).otherwise(F.array().cast("array<long>")))
    got = {r.question: r for r in selection.cover_report(e, cover, required).collect()}
    assert abs(got[1].claim_coverage - 5 / 6) < 1e-9 and got[1].independent_ratio == 1 and got[1].redundancy == 0
    assert abs(got[1].contradiction_rate - 1 / 6) < 1e-9 and abs(got[1].weighted_support - (0.5 * 3 + 0.1 * 2) / 5) < 1e-9
    assert got[2].claim_coverage == 1 and got[3].claim_coverage == 0 and got[3].weighted_support == 0


def test_packed_evidence_prefers_new_sources_and_keeps_the_budget(spark):
    from corpuslens.operators import selection

    rows = [(1, 1, "a", 1.0, 10, 0.0, "k"), (1, 2, "a", 0.95, 10, None, "k"), (1, 3, "b", 0.9, 10, 0.1, None), (1, 4, "b", 5.0, 10, 0.9, None), (1, 5, "c", 0.5, 100, 0.0, None)]
    c = spark.createDataFrame(rows, "query_id long, doc_id long, source string, score double, n_tokens long, risk double, kin string")
    got = [(r.doc_id, r.position, r.spent) for r in selection.packed_evidence(c, 30).orderBy("position").collect()]
    assert got == [(1, 1, 10), (3, 2, 20), (2, 3, 30)]
    assert selection.packed_evidence(c.limit(0), 30).count() == 0


def test_team_draft_is_fair_and_without_repeats(spark):
    from corpuslens.operators import selection

    rows = [(q, "a", q * 100 + i, i) for q in range(8) for i in range(1, 6)] + [(q, "b", q * 100 + 6 - i, i) for q in range(8) for i in range(1, 4)]
    lists = spark.createDataFrame(rows, "query_id long, team string, doc_id long, rank int")
    got = selection.team_draft(lists, 4, "x").collect()
    again = selection.team_draft(lists.repartition(5), 4, "x").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    for q in range(8):
        mine = sorted((r.position, r.doc_id, r.team) for r in got if r.query_id == q)
        assert [p for p, _, _ in mine] == [1, 2, 3, 4] and len({x for _, x, _ in mine}) == 4
        assert [t for _, _, t in mine].count("a") == 2
    assert len({r.team for r in got if r.position == 1}) == 2


def test_labelling_batch_keeps_its_caps(spark):
    from corpuslens.operators import selection

    rows = [(1, i, f"t{i % 2}", i % 3, 1.0 - i / 100, 0.5, 1.0 + i % 2) for i in range(30)]
    pool = spark.createDataFrame(rows, "owner long, item long, task string, label_group int, score double, uncertainty double, cost double")
    got = selection.labelling_batch(pool, 5, 7.0, 2, 3).orderBy("position").collect()
    assert [(r.item, r.spent) for r in got] == [(0, 1.0), (1, 3.0), (2, 4.0), (3, 6.0), (4, 7.0)]
    assert [r.item for r in selection.labelling_batch(pool, 9, 4.0, 1, 9).orderBy("position").collect()] == [0, 1, 2]


def test_refined_citations_add_remove_and_judge(spark):
    from corpuslens.operators import selection

    rows = [
        (1, 1, 7, 0.6, 0.0, 1.0, True), (1, 2, 7, 0.9, 0.0, 1.0, False), (1, 3, 8, 0.5, 0.0, 1.0, False), (1, 4, 9, 0.1, 0.0, 1.0, True),
        (2, 5, 1, 0.1, 0.0, 1.0, True), (3, 6, 1, 0.9, 0.8, 1.0, True), (4, 7, 1, 0.5, 0.1, 1.0, True),
    ]
    r = spark.createDataFrame(rows, "claim long, evidence long, source long, p_support double, p_against double, quality double, cited boolean")
    got = {x.claim: (x.chosen, x.added, x.removed, round(x.combined, 6), x.status) for x in selection.refined_citations(r, 3, 0.7, 2).collect()}
    assert got == {1: ([1, 3], [3], [4], 0.8, "supported"), 2: ([], [], [5], 0.0, "unresolved"), 3: ([], [], [6], 0.0, "contradicted"), 4: ([7], [], [], 0.5, "partial")}


def test_staged_match_and_near_points(spark):
    from corpuslens.operators import linking

    left = spark.createDataFrame([(1, 5, "x"), (2, None, "y"), (3, 9, "x"), (4, None, None)], "id long, own long, name string")
    right = spark.createDataFrame([(5, "q"), (6, "x"), (7, "y"), (8, "y")], "target long, name string")
    got = {r.id: (r.target, r.how) for r in linking.staged_match(left, right, [("id", [("own", "target")]), ("name", [("name", "name")])]).collect()}
    assert got == {1: (5, "id"), 2: (None, "ambiguous"), 3: (6, "name"), 4: (None, "unmatched")}
    a = spark.createDataFrame([(1, 0, 0.0, 0.0), (2, 0, -9.9, 0.0), (3, 1, 0.0, 0.0)], "id long, crs int, x double, y double")
    b = spark.createDataFrame([(1, 0, 6.0, 8.0), (2, 0, 10.1, 0.0), (3, 0, -19.0, 0.0)], "node long, crs int, x double, y double")
    assert sorted((r.id, r.node, r.distance) for r in linking.near_points(a, b, 10.0).collect()) == [(1, 1, 10.0), (2, 3, 9.1)]


def test_staged_match_sums_a_keys_targets_before_the_shuffle(spark):
    from corpuslens.operators import linking

    right = spark.createDataFrame([(k, t) for k in (1, 2) for t in (7, 8, 9)] * 50 + [(3, 4), (3, 4), (4, None), (5, 6), (5, None), (None, 9)], "at long, target long")
    left = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,), (6,), (None,), (3,)], "id long")
    got = linking.staged_match(left, right, [("near", [("id", "at")])])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "count(distinct" not in plan and "first(" not in plan  # a distinct count would shuffle each pair
    want = [(None, None, "unmatched"), (1, None, "ambiguous"), (2, None, "ambiguous"), (3, 4, "near"), (3, 4, "near"), (4, None, "ambiguous"), (5, 6, "near"), (6, None, "unmatched")]
    assert sorted(map(tuple, got.collect()), key=lambda r: (r[0] or 0, str(r))) == want
    a = spark.createDataFrame([(1, 0, 0.0, 0.0)], "id long, crs int, x double, y double")
    b = spark.createDataFrame([(1, 0, 10.0000004, 0.0), (2, 0, 10.0000006, 0.0), (3, 0, 0.0, float("nan")), (4, 0, None, 1.0), (5, 1, 0.0, 0.0)], "node long, crs int, x double, y double")
    assert [(r.node, r.distance) for r in linking.near_points(a, b, 10.0).collect()] == [(1, 10.0)]


def test_masked_metadata_hides_credentials_and_paths(spark):
    texts = {
        "http://me:pw@host/x": "http://[REDACTED_CREDENTIALS]@host/x",
        "https://h/a?token=abc&x=1": "https://h/a?token=[REDACTED_SECRET]]&x=1",  # the assignment rule sees the mask again
        "password = hunter2, ok": "password = [REDACTED_SECRET], ok",
        "see /home/me/file.txt now": "see [REDACTED_PATH] now",
        "see ~/notes and C:\\x\\y.txt": "see [REDACTED_PATH] and [REDACTED_PATH]",
        "file:///etc/hosts": "[REDACTED_PATH]",
        "https://example.com/a/b": "https://example.com/a/b",
        "mail a@b.org": "mail [REDACTED_EMAIL]",
        "ftp://me@host/x": "ftp://[REDACTED_CREDENTIALS]@host/x",
        "auth_token: 'two words' access-token=a1;b": "auth_token: [REDACTED_SECRET] access-token=[REDACTED_SECRET];b",
        "on 2024-05-06, not 555 123 4567": "on 2024-05-06, not [REDACTED_PHONE]",
        "/" + "a/" * 50000 + "b": "[REDACTED_PATH]",
        "": "",
    }
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.masked_metadata(F.col("t")).alias("r")).collect()
    assert {r.t: r.r for r in rows} == texts
