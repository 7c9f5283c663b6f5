"""Claim matches, graph evidence, adjustment sets, travel times and network effects against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.operators import evidence, networks
from corpuslens.plans import catalog, mechanisms

SF = "/root/testdata/sf0.001"
CLAIM = "section int, start int, end int, evidence string, claim string, type string, modality string"


def token_f1(a, b):
    a, b = a.split(), b.split()
    shared = sum(min(a.count(t), b.count(t)) for t in set(a))
    return 2 * shared / (len(a) + len(b)) if a or b else 1.0


def greedy(gold, proposals, least_iou=0.5, least_f1=0.5):
    scored = []
    for g, p in itertools.product(gold, proposals):
        if g[0] != p[0]:
            continue
        (_, gi, gs, ga, gb, ge, gc, gt, gm), (_, pi, ps, pa, pb, pe, pc, pt, pm) = g, p
        iou = max(0, min(gb, pb) - max(ga, pa)) / (max(gb, pb) - min(ga, pa)) if gs == ps else 0.0
        f1 = token_f1(gc, pc)
        if ge == pe or (iou >= least_iou and f1 >= least_f1):
            scored.append((-(ge == pe), -iou, -f1, -(gt == pt), -(gm == pm), gi, pi))
    out, seen = set(), set()
    for *_, g, p in sorted(scored):
        if ("g", g) not in seen and ("p", p) not in seen:
            seen |= {("g", g), ("p", p)}
            out.add((g, p))
    return out


def test_claims_match_as_a_greedy_walk(spark):
    draw = random.Random(4)

    def claims(name, n):
        rows = []
        for i in range(n):
            a = draw.randint(0, 900)
            words = " ".join(draw.choice("ab cd ef gh".split()) for _ in range(draw.randint(1, 4)))
            rows.append((draw.randint(0, 2), f"{name}{i}", draw.randint(0, 1), a, a + draw.choice([20, 300, 600]), draw.choice(["e1", "e2"] + [f"{name}{i}"] * 20), words, draw.choice("xy"), draw.choice("st")))
        return rows

    gold, proposals = claims("g", 60), claims("p", 70)
    make = lambda rows, name: spark.createDataFrame(rows, f"doc int, {name} string, {CLAIM}")
    g, p = make(gold, "gold_id"), make(proposals, "proposal_id")
    got = evidence.match_claims(g, p, 0.3, 0.4)
    assert {(r.gold_id, r.proposal_id) for r in got.collect()} == greedy(gold, proposals, 0.3, 0.4)
    report = {r.doc: r for r in evidence.claim_report(g, p, got).collect()}
    assert sum(r.n_matched for r in report.values()) == got.count() and all(abs(r.recall - r.n_matched / r.n_gold) < 1e-12 for r in report.values())
    assert evidence.match_claims(g.limit(0), p).count() == 0
    with pytest.raises(ValueError, match="overlap"):
        evidence.match_claims(g, p, 0.0)


def test_equal_claims_are_not_expanded_into_pairs(spark, monkeypatch):
    most, cut = [], evidence.cut
    monkeypatch.setattr(evidence, "cut", lambda df: most.append((out := cut(df)).count()) or out)
    rows = lambda name, n, at: [(1, f"{name}{i:04d}", 0, at + 30 * i, at + 30 * i + 20, "e", "ab cd ef", "x", "s") for i in range(n)]
    make = lambda r, name: spark.createDataFrame(r, f"doc int, {name} string, {CLAIM}")
    g, p = make(rows("g", 300, 0), "gold_id"), make(rows("p", 200, 100_000) + [(1, "p9999", 0, 30, 50, "e", "ab cd ef", "x", "s")], "proposal_id")
    got = {(r.gold_id, r.proposal_id, r.iou, r.f1) for r in evidence.match_claims(g, p).collect()}
    left = [f"g{i:04d}" for i in range(300) if i != 1]
    assert got == {("g0001", "p9999", 1.0, 1.0)} | {(a, f"p{i:04d}", 0.0, 1.0) for i, a in enumerate(left[:200])}
    assert max(most) <= 500


def test_graph_evidence_by_walks(spark):
    draw = random.Random(9)
    doc = {n: n % 5 for n in range(50)}
    within = [(a, b, f"w{a}-{b}", draw.choice([0.2, 0.5, 0.9])) for a, b in {(draw.randrange(50), draw.randrange(50)) for _ in range(150)} if doc[a] == doc[b] and a != b]
    across = [(a, b, f"x{a}-{b}", draw.choice([0.3, 0.6, 0.95])) for a, b in {(draw.randrange(50), draw.randrange(50)) for _ in range(160)} if doc[a] != doc[b]]
    seeds = [(q, doc[n], n, draw.choice([0.2, 0.4, 0.8])) for q in (1, 2) for n in draw.sample(range(50), 12)]
    limits = {"per_document": 2, "most_seeds": 6, "within_per_seed": 2, "depth": 2, "across_per_seed": 5, "top": 20}
    expected = {}
    for q in (1, 2):
        mine = sorted((s for s in seeds if s[0] == q), key=lambda s: (-s[3], s[2]))
        mine = [s for s in mine if [t for t in mine if t[1] == s[1]].index(s) < 2]
        mine = sorted(mine, key=lambda s: (-s[3], s[1], s[2]))[:6]
        rows = []
        for _, _, n, score in mine:
            rows.append((n, score, 0, n, ()))
            for _, b, e, w in sorted((x for x in within if x[0] == n), key=lambda x: (-x[3], x[2]))[:2]:
                rows.append((b, score * w * 0.7, 2, n, (e,)))
            depth, front, far = {n: 0}, {n: (score, ())}, []
            for level in (1, 2):
                new = {}
                for a, (s, line) in front.items():
                    for _, b, e, w in (x for x in across if x[0] == a):
                        if b not in depth:
                            new.setdefault(b, []).append((-(s * w * 0.8), e, line))
                front = {b: (-min(v)[0], (*min(v)[2], min(v)[1])) for b, v in new.items()}
                for b, (s, line) in front.items():
                    depth[b] = level
                    far.append((level, -s, b, line))
            rows += [(b, -s, 1, n, line) for _, s, b, line in sorted(far)[:5]]
        best = {}
        for r in rows:
            key = (-r[1], r[2], r[3], r[4])
            if r[0] not in best or key < best[r[0]]:
                best[r[0]] = key
        ranked = sorted(best.items(), key=lambda x: (x[1][0], x[1][1], doc[x[0]], x[0]))[:20]
        expected |= {(q, i + 1): (n, round(-k[0], 9), evidence.ORIGINS[k[1]], k[2], k[3]) for i, (n, k) in enumerate(ranked)}
    table = lambda rows: spark.createDataFrame([(*r, doc[r[1]]) for r in rows], "src int, dst int, edge string, weight double, dst_doc int")
    got = evidence.graph_set_evidence(spark.createDataFrame(seeds, "query int, doc int, node int, score double"), table(within), table(across), **limits).collect()
    assert {(r.query, r.position): (r.node, round(r.score, 9), r.origin, r.seed, tuple(r.lineage)) for r in got} == expected


@pytest.mark.parametrize("pairs", [1 << 21, 3])
def test_line_hits_are_counted_in_the_row(spark, monkeypatch, pairs):
    monkeypatch.setattr(mechanisms, "PAIRS", pairs)
    draw = random.Random(3)
    words = [f"w{i}" for i in range(30)] + ["é", "42"]
    text = lambda most: " ".join(draw.choice(words) for _ in range(draw.randint(0, most)))
    lines = [(draw.choice([1, 2, 3, None]), f"{draw.randint(0, 9)}", text(9)) for _ in range(60)] + [(1, None, "w1 w2"), (2, "x", None)]
    queries = [(draw.choice([1, 2, None]), text(25)) for _ in range(7)] + [(5, "w1 W1, w2"), (5, "w1 W1, w2"), (6, None), (7, "other")]
    count = {}
    for (q, a), (d, n, b) in itertools.product(queries, lines):
        a, b = (set((x or "").lower().replace(",", "").split()) for x in (a, b))
        if a & b:
            count[q, len(a), d, n] = count.get((q, len(a), d, n), 0) + len(a & b)
    want = sorted((str((q, d, n)), round(k / m, 9)) for (q, m, d, n), k in count.items() if k / m >= 0.1)
    got = mechanisms.line_hits(spark.createDataFrame(lines, "doc long, node string, text string"), spark.createDataFrame(queries, "query long, text string"))
    assert sorted((str((r.query, r.doc, r.node)), round(r.score, 9)) for r in got.collect()) == want and want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [query" not in plan  # pairs of a line and a query would be shuffled


@pytest.mark.parametrize("held", [1 << 18, 40, 1])
def test_seeds_are_dropped_before_the_shuffle(spark, monkeypatch, held):
    monkeypatch.setattr(evidence, "SEEDS", held)
    draw = random.Random(11)
    rows = [(draw.randint(1, 5), draw.randint(1, 12), f"n{draw.randint(1, 40)}", draw.choice([0.1, 0.2, 0.3, 0.5])) for _ in range(2000)]
    odd = [(1, None, "n1", 0.9), (None, 1, "n2", 0.9), (2, 3, None, 0.9), (2, 3, "n4", None), (2, 3, "n5", float("nan"))]
    df = spark.createDataFrame(rows + odd, "query int, doc int, node string, score double").repartition(3)
    left = [tuple(r) for r in evidence._first_seeds(df, 2, 7).collect()]
    kept = lambda rows: [r for q in range(1, 6) for r in sorted((x for d in range(1, 13) for x in sorted((r for r in rows if r[0] == q and r[1] == d and None not in r and r[3] == r[3]), key=lambda r: (-r[3], r[2]))[:2]), key=lambda r: (-r[3], r[1], r[2]))[:7]]
    assert kept(left) == kept(rows) and len(left) < len(rows) and sum(None in r or r[3] != r[3] for r in left) == 5


def backdoor(nodes, edges, x, y, z):
    """By all trails of the graph without the exposure's edges."""
    if {x, y, *z} - set(nodes):
        return False
    back = {e for e in edges if e[0] != x}

    def below(n):
        out, todo = {n}, [n]
        while todo:
            m = todo.pop()
            for a, b in back:
                if a == m and b not in out:
                    out.add(b)
                    todo.append(b)
        return out

    def trails(path):
        if path[-1] == y:
            yield path
            return
        for a, b in back:
            for here, there in ((a, b), (b, a)):
                if here == path[-1] and there not in path:
                    yield from trails([*path, there])

    if x in z or y in z:
        return True
    for t in trails([x]):
        if all((below(m) & set(z)) if (a, m) in back and (b, m) in back else m not in z for a, m, b in zip(t, t[1:], t[2:])):
            return False
    return True


def test_adjustment_sets_by_all_trails(spark):
    draw = random.Random(2)
    names, all_edges, asked, graphs = [f"n{i}" for i in range(6)], [], [], []
    for g in range(40):
        edges = [(a, b) for a, b in itertools.combinations(draw.sample(names, 6), 2) if draw.random() < 0.45]
        graphs.append(edges)
        all_edges += [(g, a, b) for a, b in edges]
        x, y = draw.sample(names, 2)
        asked.append((g, g, x, y, draw.sample([n for n in names if n not in (x, y)], draw.randint(0, 3)) + (["missing"] if g == 7 else [])))
    nodes = spark.createDataFrame([(g, n) for g in range(40) for n in names], "dag int, node string")
    got = evidence.adjustment_sets(nodes, spark.createDataFrame(all_edges, "dag int, src string, dst string"), spark.createDataFrame(asked, "question int, dag int, exposure string, outcome string, adjustment array<string>"))
    rows = {r.question: r for r in got.collect()}
    for q, _, x, y, z in asked:
        assert rows[q].blocked == backdoor(names, graphs[q], x, y, z), (q, graphs[q], x, y, z)
    assert rows[7].unknown == ["missing"] and not rows[7].valid
    assert {r.valid for r in rows.values()} == {True, False} and any(r.descendants for r in rows.values())


def test_collider_and_chain(spark):
    edges = spark.createDataFrame([(1, "u", "x"), (1, "u", "y"), (1, "x", "y"), (2, "a", "x"), (2, "a", "m"), (2, "b", "m"), (2, "b", "y"), (2, "m", "k")], "dag int, src string, dst string")
    nodes = edges.select("dag", F.explode(F.array("src", "dst")).alias("node")).distinct()
    ask = [("open", 1, []), ("closed", 1, ["u"]), ("apart", 2, []), ("opened", 2, ["m"]), ("by child", 2, ["k"]), ("again", 2, ["m", "a"])]
    q = spark.createDataFrame([(n, d, "x", "y", z) for n, d, z in ask], "question string, dag int, exposure string, outcome string, adjustment array<string>")
    assert {r.question: r.blocked for r in evidence.adjustment_sets(nodes, edges, q).collect()} == {"open": False, "closed": True, "apart": True, "opened": False, "by child": False, "again": True}


def test_travel_times_and_shifted_windows(spark):
    edges = spark.createDataFrame([("a", "b", 5.0), ("b", "t", 5.0), ("a", "t", 30.0), ("c", "a", 1.0), ("t", "c", 1.0), ("z", "t", None)], "src string, dst string, seconds double")
    targets = spark.createDataFrame([("t",)], "target string")
    travel = evidence.travel_seconds(edges, targets)
    assert {(r.node, r.seconds) for r in travel.collect()} == {("t", 0.0), ("b", 5.0), ("a", 10.0), ("c", 11.0)}
    records = spark.createDataFrame([(1, "a", 90.0), (2, "a", 89.0), (3, "t", 110.0), (4, "t", 110.5), (5, "z", 100.0), (6, None, 100.0), (7, "b", 105.0)], "record int, node string, at double")
    windows = spark.createDataFrame([("t", 100.0, 110.0)], "target string, start double, end double")
    for width in (1.0, 7.0, 1000.0):
        assert {r.record for r in evidence.shifted_records(travel, windows, records, width).collect()} == {1, 3, 7}
    assert {(r.record, r.reason) for r in evidence.unresolved_records(records, travel).collect()} == {(5, "unknown_node"), (6, "no_node")}


def test_network_effects_match_least_squares(spark):
    draw = np.random.default_rng(1)
    rows = [("n", "ABCDE"[i], "ABCDE"[j], float(draw.normal()), float(draw.uniform(0.1, 2))) for i, j in [(0, 1), (1, 2), (3, 2), (4, 0), (4, 3), (1, 3), (0, 1)]]
    apart = [("m", "A", "B", 1.0, 1.0), ("m", "C", "D", 1.0, 1.0)]
    df = spark.createDataFrame(rows + apart, "network string, a string, b string, effect double, se double")
    got = {(r.network, r.treatment): r for r in networks.network_effects(df, "B").collect()}
    x = np.array([[(r[2] == t) - (r[1] == t) for t in "ACDE"] for r in rows], float)
    s = np.array([r[4] for r in rows])
    y = np.array([r[3] for r in rows])
    beta = np.linalg.lstsq(x / s[:, None], y / s, rcond=None)[0]
    cov = np.linalg.inv((x / s[:, None]).T @ (x / s[:, None]))
    for k, t in enumerate("ACDE"):
        assert abs(got["n", t].estimate - beta[k]) < 1e-8 and abs(got["n", t].se - cov[k, k] ** 0.5) < 1e-8
    assert got["n", "B"].estimate == 0 and abs(got["n", "A"].residual_q - (((y - x @ beta) / s) ** 2).sum()) < 1e-8 and got["n", "A"].residual_df == 3
    assert all(not got["m", t].connected and got["m", t].estimate is None for t in "ABCD")


def test_registered_queries_run_whole(spark):
    """Rows for every document, order and query of the tables, with results that a look at single rows confirms."""
    n = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey").distinct().count()
    assert catalog.queries()["f23_adjustment_sets"](spark, SF).count() == n
    nodes, edges, asked = (df.collect() for df in mechanisms.order_graphs(spark, SF))
    got = {r.question: r for r in catalog.queries()["f23_adjustment_sets"](spark, SF).collect()}
    for q in asked[:150]:
        mine = [r.node for r in nodes if r.dag == q.dag]
        assert got[q.question].blocked == backdoor(mine, [(e.src, e.dst) for e in edges if e.dag == q.dag], "v2", "v4", q.adjustment)
    gold, proposals = (mechanisms.pieces(spark, SF, s, n).where("doc < 12").collect() for s, n in (("\n", "gold_id"), ("\\. ", "proposal_id")))
    lower = lambda rows: [(*r[:6], " ".join(__import__("re").findall(r"[^\W_]+", r.claim.lower())), *r[7:]) for r in rows]
    pairs = greedy(lower(gold), lower(proposals))
    report = {r.doc: r.n_matched for r in catalog.queries()["g35_claim_matches"](spark, SF).collect()}
    assert sum(report[d] for d in {r.doc for r in gold} | {r.doc for r in proposals}) == len(pairs) > 5
