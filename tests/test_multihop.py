"""Multi-hop metrics, federated lists and promotion on hand-made cases."""

import pytest

from corpuslens.operators import multihop, ranking


def test_multihop_example(spark):
    examples = spark.createDataFrame([("x", ["Paris, France", "paris"], 2), ("y", ["a"], 1), ("z", [], 3)], "example string, answers array<string>, required_hops int")
    facts = spark.createDataFrame([("x", 1, "d1", "s1"), ("x", 2, "d2", None), ("x", 3, "d3", "s9")], "example string, fact int, doc string, locator string")
    said = spark.createDataFrame([("x", "PARIS!", False), ("z", "", False)], "example string, answer string, abstained boolean")
    given = [("x", 1, "d1", ["s1", "s2"], 1, "src"), ("x", 2, "d2", [], None, None), ("x", 3, "d4", ["s1"], 1, "src"), ("x", 4, "d1", ["s2", "s1"], 2, None)]
    evidence = spark.createDataFrame(given, "example string, evidence int, doc string, locators array<string>, hop int, source string")
    got = {r.example: r for r in multihop.multihop_metrics(examples, facts, said, evidence).collect()}
    x, y, z = got["x"], got["y"], got["z"]
    assert (x.answer_exact, x.answer_f1, x.hop_coverage, x.path_complete, x.n_evidence, x.abstained) == (1.0, 1.0, 1.0, 0.0, 4.0, 0.0)
    assert (round(x.document_precision, 6), round(x.document_recall, 6), round(x.support_precision, 6), round(x.support_recall, 6), x.lineage_validity) == (0.666667, 0.666667, 0.666667, 0.666667, 0.5)
    assert (y.answer_exact, y.document_precision, y.support_recall, y.path_complete, y.abstained, y.lineage_validity) == (0.0, 1.0, 1.0, 1.0, 1.0, 1.0)
    assert z.answer_f1 == 0.0 and z.abstained == 1.0
    means = multihop.mean_multihop(multihop.multihop_metrics(examples, facts, said, evidence)).first()
    assert means.n_examples == 3 and abs(means.path_complete - 2 / 3) < 1e-12


def test_federated_lists_refuse_strangers(spark):
    hits = spark.createDataFrame([(1, "p", "c", "i1", "text", 1), (1, "p", "c", "i2", "image", 2), (1, "q", "c", "i1", "text", 1), (1, "q", "c", "i3", "text", 2)], "request int, provider string, collection string, item string, modality string, rank int")
    expected = spark.createDataFrame([(1, "p", "c"), (1, "q", "c"), (1, "q", "d")], "request int, provider string, collection string")
    weights = spark.createDataFrame([("q", 2.0)], "provider string, weight double")
    merged, missing = ranking.federated_merge(hits, expected, weights, ("text",))
    assert [(r.item, r.provider, r.position) for r in sorted(merged.collect(), key=lambda r: r.position)] == [("i1", "q", 1), ("i3", "q", 2)]
    assert [tuple(r) for r in missing.collect()] == [(1, "q", "d")]
    with pytest.raises(Exception, match="not asked"):
        ranking.federated_merge(hits, expected.where("provider = 'p'"), weights)[0].collect()


def test_promotion_needs_every_metric(spark):
    import math

    pairs = [(m, i, 0.5, 0.5 + d) for m, d in (("better", 0.1), ("equal", 0.0), ("worse", -0.2)) for i in range(60)]
    pairs += [("mixed", i, 0.0, math.sin(i * 2.4)) for i in range(200)]
    df = spark.createDataFrame(pairs, "metric string, id int, baseline double, candidate double")
    rules = lambda *rows: spark.createDataFrame(rows, "metric string, higher_is_better boolean, margin double, require_significance boolean")
    got = {r.metric: r for r in multihop.promotion(df, rules(("better", True, 0.0, True), ("equal", True, 0.01, False), ("worse", False, 0.0, True))).collect()}
    assert all(r.passed and r.promoted for r in got.values()) and abs(got["better"].low - 0.1) < 1e-9 and got["worse"].mean_difference > 0
    assert got["equal"].p_value == 1.0 and got["better"].adjusted_p >= got["better"].p_value
    got = {r.metric: r for r in multihop.promotion(df, rules(("better", True, 0.0, True), ("worse", True, 0.05, False), ("mixed", True, 1.0, True))).collect()}
    assert not got["worse"].noninferior and got["mixed"].noninferior and not got["mixed"].significant and not any(r.promoted for r in got.values())
    spread = math.sqrt(0.5 / 200)
    assert -3 * spread < got["mixed"].low < got["mixed"].high < 3 * spread
    again = {r.metric: r for r in multihop.promotion(df.repartition(5), rules(("mixed", True, 1.0, True))).collect()}
    assert abs(again["mixed"].low - got["mixed"].low) < 1e-9 and again["mixed"].p_value == got["mixed"].p_value
    with pytest.raises(Exception, match="missing"):
        multihop.promotion(df, rules(("none", True, 0.0, False))).collect()


def test_comparison_turns_metrics_round(spark):
    pairs = [(m, i, 1.0 + i % 3, 1.0 + i % 3 + (0.5 if i % 2 else 0.3)) for m in ("score", "latency") for i in range(40)]
    df = spark.createDataFrame(pairs, "metric string, id int, baseline double, candidate double")
    got = {r.metric: r for r in multihop.compare_metrics(df, spark.createDataFrame([("score", True), ("latency", False)], "metric string, higher_is_better boolean")).collect()}
    a, b = got["score"], got["latency"]
    assert abs(a.raw_delta - 0.4) < 1e-9 and abs(a.improvement - 0.4) < 1e-9 and abs(b.raw_delta - 0.4) < 1e-9 and abs(b.improvement + 0.4) < 1e-9
    assert abs(a.effect + b.effect) < 1e-9 and abs(a.effect - 0.4 / (0.1 * (40 / 39) ** 0.5)) < 1e-9
    assert 0.3 < a.low <= 0.4 <= a.high < 0.5 and -0.5 < b.low < b.high < -0.3 and a.n == 40


def test_gates_name_what_fails(spark):
    from corpuslens.operators import gates

    rows = spark.createDataFrame([(0.9, 0.5, True), (0.1, 0.5, False)] * 60, "a double, b double, y boolean")
    good = gates.qualify_fusion(rows, {"a": 0.9, "b": 0.1}, "y").first()
    assert good.eligible and good.learned_loss < good.uniform_loss
    assert gates.qualify_fusion(rows, {"a": 0.0, "b": 1.0}, "y").first().reasons == ["insufficient_brier_improvement", "insufficient_log_loss_improvement", "profile_weight_collapse"]
    assert not gates.qualify_fusion(rows.withColumn("b", rows.b + __import__("pyspark").sql.functions.lit(None).cast("double")), {"a": 0.9, "b": 0.1}, "y").first().eligible
    assert "insufficient_evaluation_examples" in gates.qualify_fusion(rows.limit(0), {"a": 0.9, "b": 0.1}, "y").first().reasons
    runs = spark.createDataFrame([(s, side, 0.5 + (0.1 if side == "shadow" else 0) + s / 100) for s in range(4) for side in ("current", "shadow")] + [(9, "shadow", 9.0)], "seed int, side string, m double")
    bench = gates.paired_benchmark(runs, ["m"])
    one = bench.first()
    assert one.n_seeds == 4 and abs(one.delta - 0.1) < 1e-12 and abs(one.high - one.low) < 1e-9
    assert gates.statistical_gate(bench, {"m": 0.0}, {"m": 0.05}).first().decision == "passed"
    blocked = gates.statistical_gate(bench, {"m": 0.0}, {"m": 0.2}, 5).first()
    assert blocked.reasons == ["paired_m_practical_gain_failed", "paired_seed_count_below_minimum"]


def test_draws_are_those_of_hashes_and_pairs_are_read_once(spark):
    import math

    from pyspark.sql import functions as F

    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(len(b))
            yield b

    pairs = spark.createDataFrame([("m", i, 0.0, (i % 7) / 7 - 0.4) for i in range(90)], "metric string, id long, baseline double, candidate double")
    got = multihop.promotion(pairs.mapInPandas(seen, pairs.schema), spark.createDataFrame([("m", True, 0.0, False)], "metric string, higher_is_better boolean, margin double, require_significance boolean"), 30, 20, seed=3).first()
    assert read.value == 90
    h = lambda kind: F.pmod(F.xxhash64(F.lit(3), F.lit(kind), "metric", "id", "k"), F.lit(1 << 30)) / float(1 << 30)
    drawn = lambda n, kind: pairs.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("h", h(kind)).collect()
    steps = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(8)]
    weights = [[(sum(r.h >= t for t in steps), r.candidate) for r in drawn(30, "bootstrap") if r.k == k] for k in range(30)]
    means = sorted(sum(w * x for w, x in ws) / sum(w for w, _ in ws) for ws in weights)
    assert got.low == pytest.approx(means[0] + 0.725 * (means[1] - means[0])) and got.high == pytest.approx(means[28] + 0.275 * (means[29] - means[28]))
    flips = [abs(sum(r.candidate if r.h < 0.5 else -r.candidate for r in drawn(20, "flip") if r.k == k)) / 90 for k in range(20)]
    assert got.p_value == pytest.approx((1 + sum(f >= abs(got.mean_difference) - 1e-12 for f in flips)) / 21)
