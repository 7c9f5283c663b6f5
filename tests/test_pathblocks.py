"""Ends of paths that arise in blocks, against brute force."""

import itertools
import random

import pytest

from corpuslens.operators import graph, pathblocks
from corpuslens.plans import catalog


def paths(first, last):
    """``(src, dst): [(v, w), ...]`` over different edges, each with its least value."""
    least = lambda edges: {(a, b): min([v for x, y, v in edges if (x, y) == (a, b) and v is not None], default=None) for a, b, _ in edges if None not in (a, b)}
    found = {}
    for ((a, m), v), ((c, z), w) in itertools.product(least(first).items(), least(last).items()):
        if m == c and a != z:
            found.setdefault((a, z), []).append((v, w))
    return found


@pytest.mark.parametrize(("edges", "most", "wide"), [(1 << 21, 1 << 18, 1 << 25), (40, 3, 0), (8, 7, 1 << 25)])
def test_ends_of_two_edges(spark, monkeypatch, edges, most, wide):
    for name, value in (("EDGES", edges), ("FEWEST", max(1, edges // 4)), ("PATHS", most), ("RANGE", wide)):
        monkeypatch.setattr(pathblocks, name, value)
    draw = random.Random(edges)
    nodes = [None, -5, *range(20), 10**12]
    rows = [[(draw.choice(nodes), draw.choice(nodes), draw.choice([None, 0.1, 2.0, 3.5])) for _ in range(220)] + [(1, draw.choice(nodes), 1.0) for _ in range(60)] for _ in range(2)]
    first, last = spark.createDataFrame(rows[0], "src long, mid long, v double"), spark.createDataFrame(rows[1], "mid long, dst long, v double")
    want = paths(*rows)
    length = lambda v, w: None if v is None or w is None else v + w
    sums = {k: [x for x in (length(*p) for p in ps) if x is not None] for k, ps in want.items()}
    got = pathblocks.ends_of_two(first, last, "both").collect()
    assert {(r.src, r.dst): (r.n, r.least, r.most) for r in got} == {k: (len(want[k]), min(s, default=None), max(s, default=None)) for k, s in sums.items()} and len(got) == len(want)
    seen = [(a, z) for a, z in want if draw.random() < 0.4] + [(None, 1), (2, None), (77, 78)]
    got = pathblocks.ends_of_two(first, last, seen=spark.createDataFrame(seen, "src long, dst long")).collect()
    assert sorted((r.src, r.dst) for r in got) == sorted(set(want) - set(seen))
    ordered = first.selectExpr("src", "mid", "coalesce(mid, 0) * 7 as v")
    got = pathblocks.ends_of_two(ordered, last.drop("v"), "first").collect()
    mids = {}
    for (a, m, _), (c, z, _) in itertools.product(*rows):
        if None not in (a, m, z) and m == c and a != z:
            mids.setdefault((a, z), set()).add(m * 7)
    assert {(r.src, r.dst): (r.n, r.least, r.most) for r in got} == {k: (len(v), min(v), max(v)) for k, v in mids.items()}


def test_no_edges_have_no_ends(spark):
    none = spark.createDataFrame([], "src long, mid long")
    some = spark.createDataFrame([(1, 2)], "mid long, dst long")
    assert pathblocks.ends_of_two(none, some).count() == 0 and pathblocks.ends_of_two(some.toDF("src", "mid"), some.limit(0)).count() == 0


@pytest.fixture(scope="module")
def sold(spark, tmp_path_factory):
    """A folder of small tables, and their edges."""
    draw, d = random.Random(8), str(tmp_path_factory.mktemp("sold"))
    some = lambda n: draw.choice([None, *range(n), *range(n)])
    lines = [(some(30), some(9), some(6)) for _ in range(120)]
    orders = [(k, some(12)) for k in range(30)] + [(3, 4), (None, 5)]
    tables = {"lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long"), "orders": (orders, "o_orderkey long, o_custkey long"), "supplier": ([(k,) for k in (0, 1, 2, 4, 4, None)], "s_suppkey long")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    up = {(s, p + 1000000) for _, p, s in lines if None not in (p, s)}
    down = {(p + 1000000, c + 9000000) for (o, p, _), (k, c) in itertools.product(lines, orders) if o is not None and o == k and None not in (p, c)}
    return d, up, down


def exchanges(df):
    return [x.strip() for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x]


def test_f18_path_lengths_shuffles_no_path(spark, sold):
    d, up, down = sold
    found = {}
    for (s, p), (q, c) in itertools.product(up, down):
        if p == q and s in (0, 1, 2, 4):
            found.setdefault((s, c), []).append((s + p) % 7 + (p + c) % 7 + 2)
    got = catalog.queries()["f18_path_lengths"](spark, d)
    assert {(r.src, r.dst): (r.n_paths, r.shortest, r.longest) for r in got.collect()} == {k: (len(v) * (2 if k[0] == 4 else 1), min(v), max(v)) for k, v in found.items()}
    assert not [x for x in exchanges(got) if "src" in x]


def test_f3_paths_shuffles_no_path(spark, sold):
    d, up, down = sold
    found = {}
    for (s, p), (q, c) in itertools.product(up, down):
        if p == q and s in (0, 1, 2, 4):
            found.setdefault((s, c), []).append(f"{s}>{p}>{c}")
    got = catalog.queries()["f3_paths"](spark, d)
    assert {(r.src, r.dst): (r.n_paths, r.first_path) for r in got.collect()} == {k: (len(v), min(v)) for k, v in found.items()}
    assert not exchanges(got)


def test_f10_impact_shuffles_no_reached_node(spark, sold):
    d, up, down = sold
    lines, orders = (spark.read.parquet(f"{d}/{name}.parquet").collect() for name in ("lineitem", "orders"))
    first = {(s, p) for s, p in up if s in (0, 1, 2, 4)}
    second = {(s, c) for (s, p), (q, c) in itertools.product(first, down) if p == q} - first
    nowhere = {r.o_orderkey for r in orders if r.o_custkey is None} - {None}  # a null end counts as a node
    second |= {(s, None) for s, p in first if any(r.l_partkey is not None and r.l_partkey + 1000000 == p and r.l_orderkey in nowhere for r in lines)}
    first |= {(r.l_suppkey, None) for r in lines if r.l_partkey is None and r.l_suppkey in (0, 1, 2, 4)}
    got = catalog.queries()["f10_impact"](spark, d)
    count = lambda pairs, s: sum(x == s for x, _ in pairs)
    assert {r.root: (r.direct, r.indirect) for r in got.collect()} == {s: (count(first, s), count(second, s)) for s, _ in first}
    assert "CartesianProduct" in got._jdf.queryExecution().executedPlan().toString()  # nodes of the last round are neither stored nor shuffled


@pytest.mark.parametrize("most", [1, 2, 3])
def test_hops_once_and_paths_by_ends_agree_with_the_rows(spark, most):
    draw = random.Random(most)
    edges = spark.createDataFrame([(draw.choice([None, *range(12)]), draw.choice([None, *range(12)]), draw.choice([None, 1.0, 2.5])) for _ in range(40)], "src long, dst long, w double")
    roots = spark.createDataFrame([(1,), (2,), (2,), (7,), (None,), (40,)], "node long")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(graph.hops(edges, roots, most, origins=True, once=True)) == rows(graph.hops(edges, roots, most, origins=True))
    by_ends = graph.weighted_paths(edges, roots, "w", most).groupBy("src", "dst", "hops").agg({"path": "count", "length": "min"}).selectExpr("src", "dst", "hops", "`count(path)` as n", "`min(length)` as s")
    assert rows(graph.weighted_paths(edges, roots, "w", most, by_ends=True).selectExpr("src", "dst", "hops", "n_paths as n", "shortest as s")) == rows(by_ends)
