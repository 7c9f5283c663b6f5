"""Quotas with leases: reservations are admitted under limits, then committed, released, renewed or left to expire.

``admissions`` decides a log of operations in order, ``admission_stream`` the same as a stream with keyed state and
timers, and ``lease_snapshot`` says what a log of admitted operations amounts to at given times.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

DECISIONS = "owner {owner}, reservation string, op string, at double, status string, token long, units double"


@dataclass(frozen=True)
class Limits:
    """Most requests and units of a fixed window, most reservations in flight, seconds of a window and of a lease."""

    requests: int = 2
    units: float = 5.0
    inflight: int = 2
    window: int = 60
    lease: int = 10

    def __post_init__(self):
        if not 0 < self.lease <= self.window:
            raise ValueError("lease seconds must be positive and within the window")


@dataclass
class Ledger:
    """One owner's reservations (window, units, token, expiry, state) and use by window, in plain values.

    What has ended is remembered for a window and a lease, so that a repeated id is known for that time.
    """

    limits: Limits
    held: dict[str, tuple[float, float, int, float, str]] = field(default_factory=dict)
    used: dict[float, tuple[int, float]] = field(default_factory=dict)

    def expire(self, now: float) -> Iterator[tuple]:
        """Leases that have ended by ``now``, in the order of their ends; forgets what is past remembering."""
        for key, (window, units, token, end, state) in sorted(self.held.items(), key=lambda x: (x[1][3], x[0])):
            if state == "reserved" and end <= now:
                self.held[key] = (window, units, token, end, "expired")
                yield key, "expire", end, "expired", token, 0.0
            elif state != "reserved" and end + self.limits.window + self.limits.lease <= now:
                del self.held[key]
        for window in [w for w in self.used if w + 2 * self.limits.window <= now]:
            del self.used[window]

    def decide(self, reservation: str, op: str, units: float | None, token: int | None, now: float) -> tuple:
        """(reservation, op, at, status, token, units) of one operation at ``now``."""
        limits, known = self.limits, self.held.get(reservation)
        if op == "reserve":
            if units is None or not units > 0:
                return reservation, op, now, "refused: units", 0, 0.0
            if known is not None:
                return reservation, op, now, known[4] if known[1] == units else "refused: collision", known[2], units
            window = now // limits.window * limits.window
            live = [v for v in self.held.values() if v[4] == "reserved"]
            same = [v[1] for v in live if v[0] == window]
            requests, spent = self.used.get(window, (0, 0.0))
            for full, reason in (
                (requests + len(same) + 1 > limits.requests, "request"),
                (spent + sum(same) + units > limits.units, "unit"),
                (len(live) + 1 > limits.inflight, "inflight"),
            ):
                if full:
                    return reservation, op, now, f"refused: {reason}", 0, units
            self.held[reservation] = (window, units, 1, now + limits.lease, "reserved")
            return reservation, op, now, "reserved", 1, units
        if known is None or known[4] != "reserved" or known[2] != token:
            return reservation, op, now, "refused: stale", token or 0, 0.0
        window, reserved, token, end, _ = known
        if op == "renew":
            self.held[reservation] = (window, reserved, token + 1, now + limits.lease, "reserved")
            return reservation, op, now, "renewed", token + 1, reserved
        if op == "release":
            self.held[reservation] = (window, reserved, token, end, "released")
            return reservation, op, now, "released", token, 0.0
        spent = reserved if units is None or units != units else units
        if not 0 < spent <= reserved:
            return reservation, op, now, "refused: units", token, spent
        n, total = self.used.get(window, (0, 0.0))
        self.used[window] = (n + 1, total + spent)
        self.held[reservation] = (window, reserved, token, end, "committed")
        return reservation, op, now, "committed", token, spent

    def take(self, rows: pd.DataFrame) -> Iterator[tuple]:
        for r in rows.itertuples(index=False):
            yield from self.expire(r.at)
            yield self.decide(r.reservation, r.op, r.units, None if pd.isna(r.token) else int(r.token), r.at)


_OUT = ["owner", "reservation", "op", "at", "status", "token", "units"]
_ORDER = ["at", "op", "reservation", "token"]


def admissions(log: DataFrame, limits: Limits) -> DataFrame:
    """What becomes of each operation of ``log(owner, reservation, op, units, token, at)``, and of each lease that ends.

    ``op`` is reserve, commit, release or renew; ``at`` is in seconds.  An owner's operations are decided in the order of
    time (ties by op, reservation and token), for each depends on those before: they pass one task as a sorted stream of
    which only the live reservations are held.  Leases that end after an owner's last operation aren't reported.
    """

    def run(batches):
        ledger, owner, first = None, None, True
        for batch in batches:
            out = []
            for key, rows in batch.groupby("owner", sort=False, dropna=False):
                if first or not (key == owner or (pd.isna(key) and pd.isna(owner))):
                    ledger, owner, first = Ledger(limits), key, False
                out += [(None if pd.isna(key) else key, *row) for row in ledger.take(rows)]
            yield pd.DataFrame(out, columns=_OUT)

    kind = log.schema["owner"].dataType.simpleString()
    ordered = log.select("owner", "reservation", "op", "units", "token", "at").repartition("owner").sortWithinPartitions("owner", *_ORDER)
    return ordered.mapInPandas(run, DECISIONS.format(owner=kind))


class _Processor(StatefulProcessor):
    """Keeps a ledger's values in keyed state; a timer at the end of each lease reports it and forgets old ones."""

    def __init__(self, limits: Limits):
        self.limits = limits

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "reservation string", "window double, units double, token long, ends double, state string")
        self.used = handle.getMapState("used", "window double", "requests long, units double")

    def _ledger(self) -> Ledger:
        return Ledger(self.limits, {k[0]: tuple(v) for k, v in self.held.iterator()}, {k[0]: tuple(v) for k, v in self.used.iterator()})

    def _store(self, ledger: Ledger) -> None:
        for state, now in ((self.held, ledger.held), (self.used, ledger.used)):
            for key in [k for k in state.keys() if k[0] not in now]:
                state.removeKey(key)
            for key, value in now.items():
                state.updateValue((key,), value)

    def _rows(self, key, ledger: Ledger, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        self._store(ledger)
        if rows:
            yield pd.DataFrame([(key[0], *r) for r in rows], columns=_OUT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ledger = self._ledger()
        done = list(ledger.take(pd.concat(list(rows)).sort_values(_ORDER)))
        for *_, end, _state in ledger.held.values():
            self.handle.registerTimer(int(end * 1000))
            self.handle.registerTimer(int((end + self.limits.window + self.limits.lease) * 1000))
        yield from self._rows(key, ledger, done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ledger = self._ledger()
        yield from self._rows(key, ledger, list(ledger.expire(expiredTimerInfo.getExpiryTimeInMs() / 1000)))

    def close(self) -> None:
        pass


def admission_stream(log: DataFrame, limits: Limits, lateness: str) -> DataFrame:
    """``admissions`` as a stream over ``log`` with an event time ``ts``: rows come out in append mode.

    Operations of one micro-batch are decided in the order of time; one that arrives in a later batch is decided after
    those before it.  Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    kind = log.schema["owner"].dataType.simpleString()
    keyed = log.withWatermark("ts", lateness).groupBy("owner")
    return keyed.transformWithStateInPandas(_Processor(limits), outputStructType=DECISIONS.format(owner=kind), outputMode="Append", timeMode="EventTime")


def lease_snapshot(log: DataFrame, moments: DataFrame, limits: Limits) -> DataFrame:
    """``owner, now, window_start, committed_requests, committed_units, reserved_requests, reserved_units, inflight, remaining_requests, remaining_units``.

    ``log(owner, reservation, op, units, at)`` holds operations that took effect; ``moments(owner, now)`` names the times.
    A reservation counts as reserved while its last reserve or renew is younger than a lease and nothing ended it; a
    commit counts in the window of its reservation.  Operations at or before ``now`` count, and none older than a window
    and a lease changes the answer, so moments and operations meet by owner and by spans of that length.
    """
    span = limits.window + limits.lease
    place = F.floor(F.col("now") / span)
    asked = moments.select("owner", "now").distinct().withColumn("_span", F.explode(F.array(place, place - 1)))
    told = log.select("owner", "reservation", "op", "units", "at", F.floor(F.col("at") / span).alias("_span"))
    seen = asked.join(told, ["owner", "_span"]).where("at <= now")

    def at(op: str, value: Column) -> Column:
        return F.max(F.when(F.col("op") == op, value))

    each = seen.groupBy("owner", "now", "reservation").agg(
        F.min(F.when(F.col("op") == "reserve", F.col("at"))).alias("began"), at("reserve", F.col("units")).alias("units"), at("commit", F.col("units")).alias("spent"),
        F.max(F.when(F.col("op").isin("reserve", "renew"), F.col("at"))).alias("held"), F.max(F.col("op").isin("commit", "release").cast("int")).alias("ended"),
    )
    start = lambda t: F.floor(t / limits.window) * limits.window
    live = (F.col("ended") == 0) & (F.col("held") + limits.lease > F.col("now"))
    here = start(F.col("began")) == start(F.col("now"))
    count, total = lambda c: F.count(F.when(c, 1)), lambda c, v: F.coalesce(F.sum(F.when(c, F.col(v))), F.lit(0.0))
    spent = here & F.col("spent").isNotNull()
    sums = each.groupBy("owner", "now").agg(
        count(spent).alias("committed_requests"), total(spent, "spent").alias("committed_units"), count(here & live).alias("reserved_requests"),
        total(here & live, "units").alias("reserved_units"), count(live).alias("inflight"),
    )
    all_ = moments.select("owner", "now").join(sums, ["owner", "now"], "left").na.fill(0)
    left = lambda most, a, b: F.greatest(F.lit(most) - F.col(a) - F.col(b), F.lit(most) * 0)
    return all_.select(
        "owner", "now", start(F.col("now")).alias("window_start"), "committed_requests", "committed_units", "reserved_requests", "reserved_units", "inflight",
        left(limits.requests, "committed_requests", "reserved_requests").alias("remaining_requests"), left(limits.units, "committed_units", "reserved_units").alias("remaining_units"),
    )
