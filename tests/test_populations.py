"""Population plans, episode reports, routes, formula symbols and figure panels on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import evaluation, graphsets, linking, populations
from corpuslens.sources import importing

PHYSICAL = "kind string, name string, physical_id string, state string, generation int, profile string, schema string, source string, n int, population string, created_at double, protected boolean, in_flight boolean"
DESIRED = "kind string, name string, generation int, profile string, schema string, source string, n int, population string"
ALIASES = "kind string, name string, physical_id string, revision int"


def have(name, pid, state="ready", generation=2, profile="p", schema="c", source="o", n=5, population="k", at=0.0, protected=False, flying=False):
    return ("sparse", name, pid, state, generation, profile, schema, source, n, population, at, protected, flying)


def plan(spark, names, physical, aliases, now=1_000_000.0):
    desired = spark.createDataFrame([("sparse", n, 2, "p", "c", "o", 5, "k") for n in names], DESIRED)
    got = populations.population_plan(desired, spark.createDataFrame(physical, PHYSICAL), spark.createDataFrame(aliases, ALIASES), F.lit(now)).collect()
    return sorted((r.name, r.status, r.physical_id, r.action, r.expected_id, r.expected_revision) for r in got)


def test_targets_are_bound_built_or_populated(spark):
    physical = [
        have("healthy", "h1"), have("healthy", "h2"), have("stale", "s1", generation=1), have("stale", "s2"), have("unbound", "u2"), have("unbound", "u1"),
        have("building", "b1", "building"), have("flying", "b2", "building", population="other", flying=True), have("failed", "x1", "failed"),
        have("profile", "q1", profile="z", schema="z"), have("schema", "q2", schema="z"), have("source", "q3", source=None), have("count", "q4", n=4),
    ]
    aliases = [("sparse", "healthy", "h2", 4), ("sparse", "stale", "s1", 7)]
    names = ["healthy", "stale", "unbound", "building", "flying", "failed", "profile", "schema", "source", "count", "missing"]
    got = plan(spark, names, physical, aliases)
    by_name = {r[0]: r[1:] for r in got if "orphan" not in r[1]}
    assert by_name["healthy"] == ("healthy", "h2", None, None, None)
    assert by_name["stale"] == ("alias_stale", "s2", "bind_alias", "s1", 7)
    assert by_name["unbound"] == ("alias_missing", "u1", "bind_alias", None, 0)
    assert by_name["building"][:3] == ("population_in_flight", "b1", None) and by_name["flying"][:3] == ("population_in_flight", "b2", None)
    assert by_name["failed"][:3] == ("failed_population", None, "populate") and by_name["missing"][:3] == ("missing", None, "populate")
    assert [by_name[c][0] for c in ("profile", "schema", "source", "count")] == ["profile_drift", "schema_drift", "source_drift", "count_drift"]
    orphans = {r[2]: r[1] for r in got if "orphan" in r[1]}
    # what agrees but isn't chosen has no finding; an aliased old one is live
    assert orphans == {"s1": "live_orphan", "x1": "orphan_candidate", "q1": "orphan_candidate", "q2": "orphan_candidate", "q3": "orphan_candidate", "q4": "orphan_candidate"}


def test_orphans_are_kept_while_protected(spark):
    physical = [have("gone", "a"), have("gone", "b", protected=True), have("gone", "c", flying=True), have("gone", "d", at=999_000.0)]
    got = plan(spark, ["other"], physical, [])
    kept = {p: "protected_orphan" for p in "bcd"}
    assert {r[2]: r[1] for r in got if r[0] == "gone"} == {"a": "orphan_candidate", **kept}
    assert [r[2] for r in got if r[3] == "record_orphan_candidate"] == ["a"]
    assert plan(spark, [], [], []) == []


STEPS = "episode string, step int, action string, oracle_action string, probability double, gain double, cost double, latency double, tokens int"
ENDS = "episode string, supported boolean, contradicted boolean, abstained boolean, utility double, oracle_utility double"


def test_episode_report(spark):
    steps = [
        ("a", 0, "retrieve", "retrieve", 0.9, 0.4, 2.0, 10.0, 0), ("a", 1, "answer", "retrieve", 0.6, 0.0, 0.0, 20.0, 30),
        ("b", 0, "retrieve", "answer", 0.5, 0.0, 4.0, 30.0, 0), ("b", 1, "retrieve", None, 0.7, 0.2, 6.0, 40.0, 10),
    ]
    ends = [("a", True, False, False, 0.5, 0.9), ("b", False, True, False, 0.8, 0.6), ("c", False, False, True, 0.2, None)]
    r = populations.episode_report(spark.createDataFrame(steps, STEPS), spark.createDataFrame(ends, ENDS)).collect()[0].asDict()
    expected = {
        "episodes": 3, "steps": 4, "action_accuracy": 1 / 3, "retrieve_precision": 1 / 2, "retrieve_recall": 1 / 2, "mean_retrievals": 1.0, "useful_rate": 2 / 3,
        "unnecessary_rate": 1 / 3, "mean_gain": 0.2, "mean_cost": 4.0, "mean_latency": 25.0, "mean_tokens": 10.0, "supported_rate": 1 / 3, "contradiction_rate": 1 / 3,
        "abstention_rate": 1 / 3, "mean_utility": 0.5, "mean_regret": 0.2, "brier": (0.01 + 0.36 + 0.25) / 3,
    }
    assert r == pytest.approx(expected)
    bare = populations.episode_report(spark.createDataFrame([], STEPS), spark.createDataFrame(ends, ENDS)).first()
    assert bare.action_accuracy is None and bare.useful_rate is None and bare.mean_gain == 0.0 and bare.mean_retrievals == 0.0


@pytest.mark.parametrize("odd", ["repeated step", "repeated outcome", "no outcome"])
def test_odd_episodes_are_refused(spark, odd):
    step, end = ("a", 0, "retrieve", None, 0.9, 0.4, 2.0, 10.0, 0), ("a", True, False, False, 0.5, 0.9)
    steps = [step, step] if odd == "repeated step" else [step, ("z", *step[1:])] if odd == "no outcome" else [step]
    with pytest.raises(Exception, match="must be unique"):
        populations.episode_report(spark.createDataFrame(steps, STEPS), spark.createDataFrame([end, end] if odd == "repeated outcome" else [end], ENDS)).collect()


def test_routes(spark):
    t, f = F.lit(True), F.lit(False)
    route = lambda scope, domain, *flags: populations.preferred_route(F.lit(scope), F.lit(domain), *flags, F.lit("dense"))
    cases = [
        route("uploaded", "general", t, t, t, t), route("public", "scholarly", t, f, f, f), route("public", "general", t, t, f, f), route("mixed", "scholarly", t, t, t, t),
        route("mixed", "scholarly", f, t, t, t), route("mixed", "scholarly", f, f, t, t), route("mixed", "general", f, f, f, t), route("mixed", "general", f, f, f, f),
    ]
    got = spark.range(1).select(F.array(*cases).alias("r")).first().r
    assert got == ["dense", "scholarly", "web", "corpus-sparse", "web", "corpus-hybrid", "scholarly", "corpus-hybrid"]
    runs = [
        ("x", "web", "corpus-sparse", 0.5, False, 1, 4, 100.0, 1000.0, False), ("x", "dense", "corpus-sparse", 0.9, True, 0, 4, 100.0, 1000.0, False),
        ("y", "web", "web", 0.4, False, 0, 0, 5000.0, 50000.0, True), ("y", "dense", "web", 0.4, True, 0, 0, 0.0, 0.0, False),
    ]
    schema = "case string, route string, preferred string, sufficiency double, enough boolean, hits int, relevant int, cost double, latency double, failed boolean"
    got = {r.case: r for r in populations.route_cases(spark.createDataFrame(runs, schema)).collect()}
    # the preferred route of x didn't run, dense comes before web in the fall-back
    x, y = got["x"], got["y"]
    assert (x.selected_route, x.best_route, x.success, x.correct, x.regret) == ("dense", "dense", False, True, 0.0)
    assert (y.selected_route, y.best_route, y.success, y.best_success, y.correct) == ("web", "dense", False, True, False) and y.regret == pytest.approx(0.1)
    report = populations.route_report(populations.route_cases(spark.createDataFrame(runs, schema))).first()
    assert (report.cases, report.selected_success, report.oracle_success, report.accuracy) == (2, 0.0, 0.5, 0.5) and report.mean_regret == pytest.approx(0.05)


def test_symbols_of_formulas(spark):
    prose = [("d", 1, "p1", "where x is the depth of water; and  y   denotes the\twidth. x = nothing"), ("d", 9, "p9", "Q means flow over there."), ("d", 2, "p2", None), ("e", 4, "p4", "x is elsewhere")]
    formulas = [("d", 5, "f5", "Q = X * y", {"g": "gravity"}), ("d", 6, "f6", "q/z", None)]
    got = linking.formula_symbols(
        spark.createDataFrame(prose, "doc string, position int, block string, text string"), spark.createDataFrame(formulas, "doc string, position int, block string, text string, symbols map<string,string>")
    )
    assert {(r.formula, r.symbol, r.definition, r.source, r.confidence) for r in got.collect()} == {
        ("f5", "g", "gravity", "f5", 1.0), ("f5", "x", "the depth of water", "p1", 0.82), ("f5", "y", "the width", "p1", 0.82), ("f5", "Q", "flow over there", "p9", 0.82), ("f6", "Q", "flow over there", "p9", 0.82),
    }
    assert got.count() == 5


def test_panels_of_figures(spark):
    panels = [("d", 1, "f", i, label, "Plots: (a) rain  at noon; b) snow") for i, label in enumerate(["(A)", "b", "C", "(d)", "()"])] + [("d", 2, "g", 0, "a", None), ("d", 3, "h", 0, "a", "(a) held")]
    captions = [("d", 1, 1, "c1", "(a) other, (c) first of all"), ("d", 1, 2, "c2", "(C) later; (d) wind"), ("d", 3, 1, "c3", "(a) held")]
    got = linking.figure_panels(
        spark.createDataFrame(panels, "doc string, page int, figure string, panel int, label string, caption string"), spark.createDataFrame(captions, "doc string, page int, position int, block string, text string")
    )
    rows = {(r.figure, r.panel): (r.label, r.description, r.evidence, r.confidence) for r in got.collect()}
    assert rows[("f", 0)] == ("(A)", "rain at noon", "f", 0.92) and rows[("f", 1)] == ("b", "snow", "f", 0.92)
    # up to the next semicolon all is the description of a panel, other letters in it included
    assert rows[("f", 2)] == ("C", "later", "c2", 0.92) and rows[("f", 3)] == ("(d)", "wind", "c2", 0.92)
    assert rows[("g", 0)] == ("a", "", "g", 0.70) and rows[("h", 0)] == ("a", "held", "c3", 0.92) and len(rows) == 6


MEMBERS = [("a", 1, "ca", "p", "ga", True), ("b", 3, "cb", "p", "gb", True), ("c", 1, "cc", None, "gc", True)]
NODES = [("a", "1", "CLAIM", "x"), ("b", "1", "LINE", "y"), ("b", "2", "LINE", None), ("z", "1", "LINE", "no member")]
RELATIONS = [("r1", "a", "1", "b", "2", "SUPPORTS", 1.0), ("r2", "b", "1", "a", "1", "CITES", 0.5)]


def edges_of(spark, members=MEMBERS, nodes=NODES, relations=RELATIONS, key="k"):
    got = graphsets.graph_set_edges(
        spark.createDataFrame(members, "doc string, generation int, content string, profile string, graph string, current boolean"), spark.createDataFrame(nodes, "doc string, node string, type string, provenance string"),
        spark.createDataFrame(relations, "relation string, source_doc string, source string, target_doc string, target string, type string, weight double"), key,
    )
    return {r.relation: r for r in got.collect()}


def test_ids_of_graph_sets_follow_contents(spark):
    one, again = edges_of(spark), edges_of(spark, MEMBERS[::-1], NODES[::-1], RELATIONS[::-1])
    assert one == again and len(one) == 2 and one["r1"].edge_id != one["r2"].edge_id and one["r1"].set_id == one["r2"].set_id
    other = edges_of(spark, [*MEMBERS[:2], ("c", 2, "cc", None, "gc", True)])
    assert other["r1"].set_id != one["r1"].set_id and edges_of(spark, key="l")["r1"].set_id != one["r1"].set_id
    assert edges_of(spark, relations=[]) == {}


@pytest.mark.parametrize(
    ("odd", "what"),
    [
        ({"members": [*MEMBERS, MEMBERS[0]]}, "documents must be unique"), ({"members": [*MEMBERS[:2], (*MEMBERS[2][:5], False)]}, "current"), ({"members": MEMBERS[:1], "relations": RELATIONS[:1]}, "two members|no member"),
        ({"nodes": [*NODES, NODES[0]]}, "nodes must be unique"), ({"relations": [RELATIONS[0], RELATIONS[0]]}, "relations must be unique"), ({"relations": [("r", "a", "9", "b", "1", "t", 1.0)]}, "no member holds"),
        ({"relations": [("r", "a", "1", "z", "1", "t", 1.0)]}, "no member holds"), ({"relations": [("r", "b", "1", "b", "2", "t", 1.0)]}, "inside one document"),
    ],
)
def test_odd_graph_sets_are_refused(spark, odd, what):
    with pytest.raises(Exception, match=what):
        edges_of(spark, **odd)


def test_visual_support(spark):
    scores = [("s", 0.6, 0.1, False), ("s", 0.2, 0.65, False), ("c", 0.6, 0.8, False), ("c", 0.9, 0.9, True), ("t", 0.8, 0.8, False), ("u", 0.4, 0.3, False), ("o", 0.9, 0.0, True)]
    schema = "claim_id string, entail double, contra double, abstained boolean"
    r = evaluation.visual_support(spark.createDataFrame(scores, schema)).first()
    assert (r.claims, r.evidence) == (5, 7) and (r.coverage, r.supported, r.contradicted, r.unsupported) == (0.8, 0.5, 0.25, 0.25)
    assert r.mean_entailment == pytest.approx(0.6) and r.abstained == pytest.approx(2 / 7)
    none = evaluation.visual_support(spark.createDataFrame([], schema)).first()
    assert (none.claims, none.coverage, none.supported, none.abstained) == (0, 0.0, None, 0.0)


def test_gold_labels_are_written_in_order(spark, tmp_path):
    schema = "item string, case string, round int, task string, state string, label string, schema string, evidence string"
    rows = [("b", "c1", 1, "t", "resolved", "yes", "s", "e"), ("b", "c2", 2, "t", "resolved", "no", "s", "e"), ("a", "c3", 1, "t", "resolved", "yes", "s", None), ("c", "c4", 1, "t", "resolved", "yes", "s", "e"),
            ("c", "c5", 2, "t", "open", None, "s", "e"), ("d", "c6", 1, "other", "resolved", "yes", "s", "e")]
    labels = importing.gold_labels(spark.createDataFrame(rows, schema), "t")
    assert {(r.item, r.case, r.label, r.round) for r in labels.collect()} == {("b", "c2", "no", 2), ("a", "c3", "yes", 1)}
    path = str(tmp_path / "gold")
    receipt = importing.write_gold(labels, path).first()
    text = [line for f in sorted(tmp_path.joinpath("gold").glob("part-*")) for line in f.read_text().splitlines()]
    assert receipt.n == 2 and ['"a"' in text[0], '"b"' in text[1]] == [True, True]
    assert importing.gold_receipt(spark.createDataFrame(labels.collect()[::-1], labels.schema)).first() == receipt
    changed = importing.gold_receipt(labels.withColumn("label", F.lit("yes"))).first()
    assert changed.n == 2 and changed.digest != receipt.digest
    with pytest.raises(Exception, match="no gold labels"):
        importing.gold_receipt(labels.limit(0)).collect()
    with pytest.raises(Exception, match="no label"):
        importing.gold_labels(spark.createDataFrame([("a", "c", 1, "t", "resolved", None, "s", "e")], schema), "t").collect()
