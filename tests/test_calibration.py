"""Isotonic steps over partitions, calibrated fusion, freeboard and beliefs on hand-made and random cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import assess, calibration, evidence, graph

EXAMPLE = "profile string, score double, higher_is_better boolean, relevant boolean, weight double"


def steps(rows):
    """Plain pool-adjacent-violators over one profile."""
    sums = {}
    for _, score, up, hit, w in rows:
        n, s = sums.get(score if up else -score, (0.0, 0.0))
        sums[score if up else -score] = (n + w, s + w * hit)
    blocks = []
    for x in sorted(sums):
        blocks.append([x, x, *sums[x]])
        while len(blocks) > 1 and blocks[-2][3] / blocks[-2][2] > blocks[-1][3] / blocks[-1][2] + 1e-15:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0], b[1], blocks[-1][2] + b[2], blocks[-1][3] + b[3]]
    return [(None if i + 1 == len(blocks) else round((b[1] + blocks[i + 1][0]) / 2, 9), round(b[3] / b[2], 9)) for i, b in enumerate(blocks)]


def test_isotonic_steps_over_partitions(spark):
    draw = random.Random(6)
    rows = [(p, draw.choice([draw.random(), round(draw.random(), 1)]), p != "down", draw.random() < 0.5, draw.choice([1.0, 2.5])) for p in ("up", "down", "one") for _ in range(150)]
    rows = [r for r in rows if r[0] != "one"] + [("one", 0.5, True, True, 1.0)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges, whatever their size
    try:
        got = calibration.isotonic_bins(spark.createDataFrame(rows, EXAMPLE)).orderBy("profile", "bin").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for p in ("up", "down", "one"):
        assert [(None if r.upper is None else round(r.upper, 9), round(r.probability, 9)) for r in got if r.profile == p] == steps([r for r in rows if r[0] == p])
    assert calibration.isotonic_bins(spark.createDataFrame([], EXAMPLE)).count() == 0


def test_fusion_of_profiles(spark):
    bins = spark.createDataFrame([("a", 0, 0.5, 0.2), ("a", 1, None, 0.8), ("b", 0, -1.0, 0.1), ("b", 1, None, 0.5)], "profile string, bin int, upper double, probability double")
    lists = [("q", "a", "x", 0.5, True, 2), ("q", "a", "y", 0.9, True, 1), ("q", "b", "x", 0.5, False, 1), ("q", "b", "z", 1.5, False, 2), ("q", "a", "x", 0.4, True, 3)]
    df = spark.createDataFrame(lists, "query string, profile string, item string, score double, higher_is_better boolean, position int")
    weights = spark.createDataFrame([("a", 3.0)], "profile string, weight double")
    got = {r.item: (round(r.score, 9), r.n_profiles) for r in calibration.fused_profiles(df, bins, weights).collect()}
    odds = lambda p: math.log(p / (1 - p))
    both = 1 / (1 + math.exp(-(3 * odds(0.2) + odds(0.5)) / 4))
    assert got == {"x": (round(both, 9), 2), "y": (0.8, 1), "z": (0.1, 1)}
    ranks = {r.item: round(r.score, 9) for r in calibration.fused_profiles(df, None, weights).collect()}
    assert ranks == {"x": round(3 / 62 + 1 / 61, 9), "y": round(3 / 61, 9), "z": round(1 / 62, 9)}
    with pytest.raises(Exception, match="without calibration"):
        calibration.fused_profiles(df, bins.where("profile = 'a'")).collect()


def test_freeboard(spark):
    s = spark.createDataFrame([(1, "Big", "Up", 10.0, 5.0, "m", "d"), (2, "big", "up", 21.0, 30.0, "ft", "d"), (3, "big", "up", 99.0, 1.0, "m", "d")], "structure int, river string, reach string, station double, crest double, unit string, datum string")
    p = spark.createDataFrame([("BIG", "UP", 10.0, 6.0, "m", "d"), ("big", "up", 20.0, 6.0, "m", "d"), ("big", "up", 23.0, 9.0, "m", "d"), ("big", "up", 21.0, None, "m", "d")], "river string, reach string, station double, water double, unit string, datum string")
    got = {r.structure: r for r in assess.freeboard(s, p, {"m": 1.0, "ft": 0.3048}, 5.0).collect()}
    assert got[1].freeboard == -1.0 and got[1].overtopping and abs(got[2].freeboard - (30 - 6 / 0.3048)) < 1e-9 and got[3].freeboard is None
    for bad, message in ((p.unionByName(p.limit(1)), "several"), (p.withColumn("datum", F.lit("other")), "datum")):
        with pytest.raises(Exception, match=message):
            assess.freeboard(s, bad, {"m": 1.0, "ft": 0.3048}).collect()


def test_revised_beliefs(spark):
    e = [("c", "e1", "s1", "support", None, 0.8, 0.0), ("c", "e2", "s1", "support", None, 0.5, 100.0), ("c", "e3", "s2", "contradict", None, 1.0, 100.0), ("c", "r", "s2", "retract", "e3", 0.0, 150.0), ("c", "late", "s3", "contradict", None, 1.0, 999.0), ("d", "e4", "s1", "support", None, 0.9, 0.0), ("d", "r2", "s1", "retract", "e4", 0.0, 50.0)]
    df = spark.createDataFrame(e, "claim string, evidence string, source string, stance string, retracts string, confidence double, at double")
    got = {r.claim: r for r in graph.revised_beliefs(df, F.lit(200.0), 100.0).collect()}
    assert (got["c"].status, round(got["c"].support, 9), got["c"].contradiction, got["c"].n_active) == ("supported", 0.25, 0.0, 2)
    assert (got["d"].status, got["d"].support, got["d"].n_active) == ("unknown", 0.0, 0)
    before = {r.claim: r for r in graph.revised_beliefs(df, F.lit(120.0)).collect()}
    assert before["c"].status == "contradicted" and before["c"].contradiction == 1.0 and before["d"].status == "unknown"


def test_counter_evidence_ways(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 1), (3, 9), (5, 4)], "src int, dst int")
    ev = spark.createDataFrame([("x", "r1", 0.5, [1]), ("y", "r2", 0.9, [1, 2]), ("z", "r1", 0.9, [1])], "item string, root string, score double, contradicts array<int>")
    got = evidence.counter_evidence(spark.createDataFrame([(1,)], "claim int"), edges, ev).collect()
    assert [(r.item, r.position) for r in sorted(got, key=lambda r: (r.kind, r.position))] == [("z", 1), ("y", 2), ("x", 3), ("2", 1), ("3", 2), ("4", 3), ("5", 4)]
