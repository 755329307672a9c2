"""Streams that keep state: tables by key, entries with a time to live, sketches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def test_a_batch_that_runs_twice_changes_nothing(spark, tmp_path):
    from quern.plans.common import names_in
    from quern.streaming import kept
    from quern.streaming.events import USAGE, _usage_sum, read_usage, usage_of

    rng, root = random.Random(1), f"file://{tmp_path}/usage"
    schema = "event_type string, user_id bigint, ts timestamp, value double"
    batches = [spark.createDataFrame([(rng.choice("ab"), rng.choice([1, 2, 3, None]), at(rng.randint(0, 4_000)), float(rng.randint(0, 9))) for _ in range(50)], schema) for _ in range(6)]
    rows = lambda df: sorted((r.event_type, str(r.user_id), r.day, r.all_users, r.calls, r.total) for r in df.collect())
    for n, b in enumerate(batches):
        assert kept.merge_batch(b, n, root, USAGE, usage_of, _usage_sum)
        before = kept.manifest(spark, root)
        assert not kept.merge_batch(b, n, root, USAGE, usage_of, _usage_sum)
        assert not kept.merge_batch(batches[0], 0, root, USAGE, usage_of, _usage_sum)
        assert kept.manifest(spark, root) == before
    whole = batches[0]
    for b in batches[1:]:
        whole = whole.union(b)
    assert rows(read_usage(spark, root)) == rows(usage_of(whole))
    assert len(names_in(spark, f"{root}/versions")) == kept.VERSIONS
    assert len(read_usage(spark, root).inputFiles()) <= kept.BUCKETS  # one folder for each bucket, whatever the number of batches
    assert kept.merge_batch(batches[0].limit(0), 6, root, USAGE, usage_of, _usage_sum) and rows(read_usage(spark, root)) == rows(usage_of(whole))


def test_a_batch_that_fails_before_its_manifest_is_merged_again(spark, tmp_path, monkeypatch):
    from quern.streaming import kept

    root, merge = f"file://{tmp_path}/t", lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n"))
    one = spark.createDataFrame([(1, 1), (2, 5), (None, 7)], "k bigint, n bigint")
    kept.merge_batch(one, 0, root, ["k"], lambda b: b, merge)
    put = kept.put_text
    monkeypatch.setattr(kept, "put_text", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        kept.merge_batch(one, 1, root, ["k"], lambda b: b, merge)
    monkeypatch.setattr(kept, "put_text", put)
    assert {r.k: r.n for r in kept.read_kept(spark, root).collect()} == {1: 1, 2: 5, None: 7}
    kept.merge_batch(one, 1, root, ["k"], lambda b: b, merge)
    assert {r.k: r.n for r in kept.read_kept(spark, root).collect()} == {1: 2, 2: 10, None: 14}


def test_entries_expire_between_batches_and_over_a_restart(spark, tmp_path):
    from quern.streaming.events import unexpired
    from quern.streaming.state import live_now, live_stream

    rng = random.Random(2)
    parts = [[(u, rng.choice("xy"), at(t + rng.randint(0, 200)), 100 * n + k) for k, u in enumerate([rng.randint(0, 6) for _ in range(25)])] for n, t in enumerate((0, 300, 900, 1_500))]
    parts[1].append((99, "x", at(310), 9_999))  # never seen again
    schema = "user_id bigint, kind string, ts timestamp, event_id bigint"
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    changes = []

    def run(some):
        for n in some:
            spark.createDataFrame(parts[n], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
            out = live_stream(stream, ["user_id", "kind"], "ts", "event_id", dt.timedelta(hours=4))
            out.writeStream.outputMode("update").foreachBatch(lambda df, _: changes.extend(df.collect()) and None).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(180)

    try:
        run([0, 1])
        assert any(not r.live for r in changes)  # the restart below knows of timers that are still to come
        waiting = {(r.user_id, r.kind) for r in changes if r.user_id == 99}
        run([2, 3])
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    assert waiting and [r.live for r in changes if r.user_id == 99] == [True, False]
    every = spark.createDataFrame([x for p in parts for x in p], schema)
    end = every.agg(F.max("ts")).first()[0]
    want = unexpired(every, ["user_id", "kind"], "ts", F.expr("interval 4 hours"), F.lit(end)).select("user_id", "kind", "event_id")
    got = live_now(spark.createDataFrame(changes), ["user_id", "kind"]).select("user_id", "kind", "id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_no_call_is_accepted_with_a_limit_of_nothing(spark):
    from quern.streaming.events import accepted_calls

    e = spark.createDataFrame([("a", "e1", at(0)), (None, "e2", at(1))], "user_id string, event_id string, ts timestamp_ntz")
    assert sorted((r.event_id, r.accepted, r.reset_at) for r in accepted_calls(e, 0, 10).collect()) == [("e1", False, None), ("e2", False, None)]


def test_sketches_merge_over_days_within_their_error(spark):
    from quern.streaming import events

    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randint(0, 3_000), dt.datetime(2024, 1, rng.randint(1, 20)), rng.gauss(0, 1)) for _ in range(20_000)]
    daily = events.daily_sketches(spark.createDataFrame(rows, "event_type string, user_id bigint, ts timestamp, value double"))
    for r in events.merged_sketches(daily, ["event_type"], (0.1, 0.5, 0.9)).collect():
        mine = [x for x in rows if x[0] == r.event_type]
        users, values = len({x[1] for x in mine}), sorted(x[3] for x in mine)
        assert abs(r.users - users) <= 4 * events.HLL_ERROR * users and r["values"] == len(values)
        for q, v in zip((0.1, 0.5, 0.9), r.quantiles, strict=True):
            assert abs(sum(x <= v for x in values) / len(values) - q) <= 2 * events.KLL_ERROR
