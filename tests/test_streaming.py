"""Batch result = stream result (availableNow) for the stateful operators."""

import pytest
from pyspark.sql import functions as F

from vigil.operators import features as X
from vigil.operators import folds as FD
from vigil.plans.q_stream import LATE, event_stream
from vigil.sources.tables import EVENTS_TL, events
from vigil.streaming import detector as D

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module", params=["one file", "four shuffled files"])
def sf(spark, request, tmp_path_factory):
    """The driver's folder, or one whose events lie in four files of mixed order,
    which the stream reads one a batch."""
    if request.param == "one file":
        return SF
    folder = str(tmp_path_factory.mktemp("sf"))
    ev = spark.read.parquet(f"{SF}/events.parquet")
    ev.repartition(4, F.xxhash64("event_id")).write.parquet(f"{folder}/events.parquet")
    return folder


def test_window_counts(spark, sf):
    from vigil.plans.q_stream import q_stream_window_counts
    got = q_stream_window_counts(spark, sf)
    want = events(spark, SF).groupBy("label").count()
    assert {r.label: r.n for r in got.groupBy("label").agg(F.sum("n").alias("n")).collect()} == {
        r.label: r["count"] for r in want.collect()}


def test_online_features_match_batch(spark, sf):
    keep = ["event_id", "user_id", "ts", "t", "label"]
    ev = event_stream(spark, sf)
    online = D.run_to_table(D.online_features(ev, "user_id", ["event_id"], "t", ["value"], keep=keep, late=LATE),
                            "t-online")
    batch = X.family_b(events(spark, SF).select(*keep, "value"), EVENTS_TL, ["value"], keep=["event_id", "user_id"])
    n = events(spark, SF).groupBy("user_id").agg(F.count("*").alias("n"))
    cols = [c for c in batch.columns if c.startswith(("d_", "value_"))]
    j = online.select("event_id", *[F.col(c).alias("o_" + c) for c in cols]).join(batch, "event_id").join(
        batch.select("event_id", "user_id").join(n, "user_id").select("event_id", "n"), "event_id")
    rows = j.collect()
    assert len(rows) == online.count() > 0
    for r in rows:
        for c in cols:
            if c.endswith("roc50") and r.n <= 50:
                continue  # batch zeroes roc50 of runs that end before row 51 (needs the future)
            assert r["o_" + c] == pytest.approx(r[c], rel=1e-9, abs=1e-9), (c, r.event_id)


def test_stream_dedup_matches_batch(spark, sf):
    ev = event_stream(spark, sf)
    s = D.run_to_table(D.dedup_alerts(ev.filter(F.col("label") != 0), ["user_id", "label"], ["event_id"], "t", 3600.0,
                                      keep=["event_id", "user_id", "label"], late=LATE), "t-dedup")
    b = FD.alert_dedup(events(spark, SF).filter(F.col("label") != 0), ["user_id", "label"], ["ts", "event_id"],
                       "t", 3600.0).filter("fired")
    assert sorted(r.event_id for r in s.collect()) == sorted(r.event_id for r in b.collect())


def test_carry_forward_matches_batch(spark, sf):
    ev = event_stream(spark, sf)
    ev = ev.withColumn("v", F.when(F.col("label") == 3, None).otherwise(F.col("value")))
    s = D.run_to_table(D.carry_forward(ev, "user_id", ["event_id"], ["v"], {"v": -1.0},
                                       keep=["event_id", "user_id"], late=LATE), "t-carry")
    b = events(spark, SF).withColumn("v", F.when(F.col("label") == 3, None).otherwise(F.col("value")))
    b = b.select("event_id", F.coalesce(EVENTS_TL.prev_non_null("v"), F.lit(-1.0)).alias("v"))
    got = {r.event_id: r.v for r in s.collect()}
    exp = {r.event_id: r.v for r in b.collect()}
    assert got == exp


def test_counters(spark):
    c = {}
    ev = event_stream(spark, "/root/testdata/sf0.001")
    D.run_to_table(ev.select("event_id"), "t-count", counters=c)
    assert c["input_rows"] == 1001 and c["batches"] >= 3


def test_polls_are_tried_again_and_gaps_are_null():
    import sys
    import types

    from vigil.sources.poll import Poll, PollReader
    calls = []

    def endpoint(n, argument):
        calls.append(n)
        if n == 1 or n == 2 and calls.count(2) < 3:
            raise ConnectionError
        return [(n, argument), (n + 10, argument)]

    sys.modules["_endpoint"] = types.SimpleNamespace(poll=endpoint)
    r = PollReader({"reader": "_endpoint:poll", "argument": "x", "polls": "5", "batch": "2", "wait": "0"}, 2)
    assert [r.initialOffset(), r.latestOffset(), r.latestOffset(), r.latestOffset(), r.latestOffset()] == [
        {"poll": n} for n in (0, 2, 4, 5, 5)]
    parts = r.partitions({"poll": 0}, {"poll": 3})
    assert [p.number for p in parts] == [0, 1, 2]
    rows = [list(r.read(p)) for p in parts]
    assert rows == [[(0, 0, "x"), (0, 10, "x")], [(1, None, None)], [(2, 2, "x"), (2, 12, "x")]]
    assert calls == [0, 1, 1, 1, 2, 2, 2]
    again = PollReader({"reader": "_endpoint:poll", "polls": "9", "batch": "2"}, 2)      # a restart from the checkpoint
    again.partitions({"poll": 4}, {"poll": 6})
    assert again.latestOffset() == {"poll": 8} and list(r.read(Poll(0)))


def test_state_stays_small(spark):
    """The rows that wait are those of the late limit, not of the table."""
    c = {}
    seen = []
    import vigil.streaming.detector as DT
    real = DT.progress_counters

    def watched(q):
        seen.extend(s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"])
        return real(q)
    DT.progress_counters = watched
    try:
        ev = event_stream(spark, "/root/testdata/sf0.001")
        out = D.run_to_table(D.carry_forward(ev, "user_id", ["event_id"], ["value"], {}, keep=["event_id", "user_id"], late=LATE),
                             "t-small", counters=c)
    finally:
        DT.progress_counters = real
    groups = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert out.count() == 1000 and c["late_rows"] == 0
    assert max(seen) <= 4 * groups                     # a memory, a chunk or two and no more for each group
    assert seen[-1] == 0


def test_run_for_a_time(spark):
    rate = spark.readStream.format("rate").option("rowsPerSecond", 5).load()
    assert D.run_to_table(rate, "t-rate", duration_s=6).count() >= 0
    assert not spark.streams.active
