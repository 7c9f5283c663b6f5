"""Leased quotas and the interleaving journal: batch twins, streams and hand-made cases."""

import collections

import pytest
from pyspark.sql import functions as F

from corpuslens.plans import catalog, mechanisms
from corpuslens.streaming import journal, quota

SF = "/root/testdata/sf0.001"
LOG = "owner string, reservation string, op string, units double, token long, at double"


def decided(spark, rows, limits):
    got = quota.admissions(spark.createDataFrame(rows, LOG), limits).collect()
    return [(r.reservation, r.op, r.status, r.token) for r in sorted(got, key=lambda r: (r.at, r.op == "expire", r.op))]


def test_reserve_commit_release(spark):
    rows = [("alice", "req-1", "reserve", 2.0, None, 1.0), ("alice", "req-2", "reserve", 2.0, None, 2.0), ("alice", "req-1", "commit", 1.0, 1, 4.0), ("alice", "req-2", "release", None, 1, 5.0)]
    assert decided(spark, rows, quota.Limits()) == [("req-1", "reserve", "reserved", 1), ("req-2", "reserve", "reserved", 1), ("req-1", "commit", "committed", 1), ("req-2", "release", "released", 1)]
    log = spark.createDataFrame(rows, LOG)
    moments = spark.createDataFrame([("alice", 3.0), ("alice", 6.0), ("alice", 61.0), ("bob", 3.0)], "owner string, now double")
    got = {(r.owner, r.now): r for r in quota.lease_snapshot(log, moments, quota.Limits()).collect()}
    three, six = got["alice", 3.0], got["alice", 6.0]
    assert (three.reserved_requests, three.reserved_units, three.remaining_requests, three.inflight) == (2, 4.0, 0, 2)
    assert (six.committed_requests, six.committed_units, six.reserved_requests, six.remaining_requests, six.remaining_units) == (1, 1.0, 0, 1, 4.0)
    assert got["alice", 61.0].committed_requests == 0 and got["bob", 3.0].remaining_requests == 2


@pytest.mark.parametrize("limits, third, reason", [((2, 10.0, 2), 1.0, "request"), ((3, 4.0, 3), 0.5, "unit"), ((10, 100.0, 2), 1.0, "inflight")])
def test_limits_refuse(spark, limits, third, reason):
    rows = [("a", "r1", "reserve", 2.0, None, 1.0), ("a", "r2", "reserve", 2.0, None, 1.0), ("a", "r3", "reserve", third, None, 1.5)]
    assert decided(spark, rows, quota.Limits(*limits))[-1][2] == f"refused: {reason}"


def test_renewal_fences_and_expired_leases_free_room(spark):
    rows = [("a", "x", "reserve", 2.0, None, 1.0), ("a", "x", "renew", None, 1, 5.0), ("a", "x", "commit", None, 1, 6.0), ("a", "x", "commit", None, 2, 6.5), (None, "x", "reserve", -1.0, None, 1.0)]
    assert [r[2] for r in decided(spark, rows[:4], quota.Limits())] == ["reserved", "renewed", "refused: stale", "committed"]
    assert decided(spark, rows[4:], quota.Limits()) == [("x", "reserve", "refused: units", 0)]
    rows = [("a", "old", "reserve", 2.0, None, 1.0), ("a", "new", "reserve", 2.0, None, 6.0), ("a", "old", "commit", None, 1, 6.1), ("a", "new", "reserve", 2.0, None, 6.2), ("a", "new", "reserve", 3.0, None, 6.3)]
    found = {(r[0], r[1], r[2]) for r in decided(spark, rows, quota.Limits(10, 10.0, 1, 60, 5))}
    assert {("old", "expire", "expired"), ("new", "reserve", "reserved"), ("old", "commit", "refused: stale"), ("new", "reserve", "refused: collision")} <= found
    with pytest.raises(ValueError, match="lease"):
        quota.Limits(1, 1.0, 1, 10, 11)


def simple_admissions(rows, limits):
    """The rules as a list of reservations that is searched for each operation."""
    out, all_ = collections.Counter(), collections.defaultdict(list)
    for owner, name, op, units, token, at in sorted(rows, key=lambda r: (r[5], r[2], r[1])):
        held = all_[owner]
        for h in held:
            if h["state"] == "reserved" and h["end"] <= at:
                h["state"] = "expired"
                out[owner, h["name"], "expire", "expired"] += 1
        mine = next((h for h in held if h["name"] == name), None)
        window = at // limits.window
        if op == "reserve":
            live = [h for h in held if h["state"] == "reserved"]
            here = [h for h in held if h["window"] == window and h["state"] in ("reserved", "committed")]
            if len(here) + 1 > limits.requests:
                status = "refused: request"
            elif sum(h["units"] for h in here) + units > limits.units:
                status = "refused: unit"
            elif len(live) + 1 > limits.inflight:
                status = "refused: inflight"
            else:
                status = "reserved"
                held.append({"name": name, "window": window, "units": units, "end": at + limits.lease, "state": "reserved", "token": 1})
        elif mine is None or mine["state"] != "reserved" or mine["token"] != token:
            status = "refused: stale"
        elif op == "renew":
            mine["token"], mine["end"], status = mine["token"] + 1, at + limits.lease, "renewed"
        elif op == "commit":
            mine["state"], mine["units"], status = "committed", units, "committed"
        else:
            mine["state"] = status = "released"
        out[owner, name, op, status] += 1
    return out


def test_admissions_match_plain_rules(spark):
    rows = [tuple(r) for r in mechanisms.leases(spark, SF).select("owner", "reservation", "op", "units", "token", "at").collect()]
    got = collections.Counter((r.owner, r.reservation, r.op, r.status) for r in catalog.queries()["j2_quota_admissions"](spark, SF).collect())
    assert got == simple_admissions(rows, mechanisms.LIMITS)
    assert {s for *_, s in got} >= {"reserved", "committed", "released", "expired", "refused: inflight"}


def test_quota_stream_equals_batch(spark, tmp_path):
    log = mechanisms.leases(spark, SF).where("owner < 8").withColumn("ts", F.timestamp_seconds("at"))
    end = spark.createDataFrame([(0, "end", "release", None, 1, 1.8e9)], "owner long, reservation string, op string, units double, token long, at double").withColumn("ts", F.timestamp_seconds("at"))
    # three files in the order of time, then a late one that ends all leases
    for i, part in enumerate([log.where("at < 1705000000"), log.where("at >= 1705000000 and at < 1706000000"), log.where("at >= 1706000000"), end.select(log.columns)]):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{i}"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        q = quota.admission_stream(stream, mechanisms.LIMITS, "0 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check"))
        q = q.outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    rows = lambda df: {(r.owner, r.reservation, r.op, r.status, r.token) for r in df.where("reservation <> 'end' and op <> 'expire'").collect()}
    batch = quota.admissions(log.drop("ts"), mechanisms.LIMITS)
    streamed = spark.read.parquet(str(tmp_path / "out"))
    assert rows(streamed) == rows(batch)
    ends = lambda df: {(r.owner, r.reservation) for r in df.where("op = 'expire'").collect()}
    assert ends(batch) <= ends(streamed)  # the stream's timers also report what ends after an owner's last operation


IMPRESSIONS = "experiment string, impression string, query string, sides array<string>, ts timestamp"
OUTCOMES = "experiment string, impression string, engaged array<int>, ts timestamp"


def journal_rows(spark):
    import datetime

    t = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    i = [("e", "i1", "q", ["a", "b", "a"], t(0)), ("e", "i1", "q", ["a", "b", "a"], t(1)), ("e", "i2", "q", ["b", "a"], t(2)), ("e", "i3", "q", ["a", "b"], t(3)), ("f", "i4", "q", ["a"], t(4)), ("e", "i5", "q", ["a", "b"], t(5))]
    o = [("e", "i1", [0, 2], t(6)), ("e", "i1", [0, 2], t(7)), ("e", "i2", [0], t(8)), ("e", "i3", [0, 1], t(9)), ("e", "i4", [0], t(10)), ("e", "i5", [0], t(50)), ("e", "i9", [0], t(11))]
    return spark.createDataFrame(i, IMPRESSIONS), spark.createDataFrame(o, OUTCOMES)


def test_journal_rules(spark):
    i, o = journal_rows(spark)
    done = journal.complete_impressions(i, o, "30 minutes")
    assert {(r.impression, r.preference) for r in journal.export(done.where("impression <> 'i1'")).collect()} == {("i2", -1), ("i3", 0)}
    result = journal.experiment_results(journal.export(done)).collect()
    assert [(r.experiment, r.impressions, r.wins_a, r.wins_b, r.ties, r.rate) for r in result] == [("e", 3, 1, 1, 1, 0.5)]
    twice = o.unionByName(o.where("impression = 'i2'").withColumn("engaged", F.array(F.lit(1))))
    with pytest.raises(Exception, match="collision"):
        journal.export(journal.complete_impressions(i, twice, "30 minutes")).collect()
    outside = o.withColumn("engaged", F.array(F.lit(7)))
    with pytest.raises(Exception, match="not shown"):
        journal.complete_impressions(i, outside, "30 minutes").collect()


def test_journal_stream_equals_batch(spark, tmp_path):
    i, o = mechanisms.shown(spark, SF)
    for name, df in (("i", i), ("o", o)):
        df.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / name))
    read = lambda name, df: spark.readStream.schema(df.schema).parquet(str(tmp_path / name))
    joined = journal.complete_impressions(read("i", i), read("o", o), "1 day", "40 days")
    q = joined.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    results = lambda df: {tuple(r) for r in journal.experiment_results(journal.export(df)).collect()}
    streamed, batch = spark.read.parquet(str(tmp_path / "out")), journal.complete_impressions(i, o, "1 day")
    assert batch.count() > 20 and results(streamed) == results(batch)
