"""Event-time operators: the same functions take a stream or a table; the queries are their batch twins."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.plans.common import materialise, r6, read, scratch_path, sized
from quern.streaming.kept import keep, keep_latest, read_kept, read_latest

#: Arrivals in one range of late_data.
RANGE = 20_000


def event_time(df: DataFrame, ts: str = "ts", late: str | None = None) -> DataFrame:
    """ts as a timestamp of the session's zone, with a watermark where lateness is given."""
    out = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return out.withWatermark(ts, late) if late else out


def windowed_counts(df: DataFrame, size: str, slide: str | None = None, keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Tumbling (no slide) or sliding windows: start, keys, n, total."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return df.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def session_counts(df: DataFrame, gap: str, key: str = "user_id") -> DataFrame:
    """Sessions of a key that end after a gap: start, end, key, n."""
    s = df.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return s.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def first_of_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """A stream without repeats of a key within its watermark; a table without any."""
    return df.dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def _accept(held: deque, at: int, limit: int, window: int) -> bool:
    """Whether a call is taken after those held; it is held then, and what is out of the window isn't any more."""
    while held and held[0] <= at - window:
        held.popleft()
    if len(held) < limit:
        held.append(at)
        return True
    return False


def accepted_calls(df: DataFrame, limit: int, seconds: int) -> DataFrame:
    """(user_id, event_id, accepted, reset_at): a call is accepted if fewer than limit accepted ones lie in the seconds before it.

    Only accepted calls count, so the state is sequential. Rows are sorted within partitions and
    pass as a stream; what is held of a key is its last accepted times, limit at most. Calls without
    a user are one user's, and a user's calls pass through one task, in order. reset_at: when the oldest call
    that counts leaves the window, in microseconds; null if none counts, as with a limit of 0.
    """
    window = seconds * 1_000_000
    kinds = [df.schema[c].dataType.simpleString() for c in ("user_id", "event_id")]

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: object = rows  # no user's
        held: deque = deque()
        for b in batches:
            ok, reset = [], []
            for user, at in zip(b.column("user_id").to_pylist(), b.column("at").to_pylist(), strict=True):
                if user != key:
                    key, held = user, deque()
                ok.append(_accept(held, at, limit, window))
                reset.append(held[0] + window if held else None)
            yield pa.RecordBatch.from_arrays([b.column("user_id"), b.column("event_id"), pa.array(ok, pa.bool_()), pa.array(reset, pa.int64())], ["user_id", "event_id", "accepted", "reset_at"])

    timed = df.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return timed.repartition("user_id").sortWithinPartitions("user_id", "at", "event_id").mapInArrow(rows, f"user_id {kinds[0]}, event_id {kinds[1]}, accepted boolean, reset_at bigint")


def accepted_stream(stream: DataFrame, limit: int, seconds: int, late: str = "1 hour") -> DataFrame:
    """The same for a stream (user_id, event_id, ts): the held times of a user are state, dropped once the watermark has passed them."""
    window = seconds * 1_000_000

    def of(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = deque(state.get[0]) if state.exists else deque()
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
        ok = [_accept(held, int(at), limit, window) for at in rows["at"]]
        state.update((list(held),))
        if held and held[-1] + window > state.getCurrentWatermarkMs() * 1000:
            state.setTimeoutTimestamp((held[-1] + window) // 1000)
        yield pd.DataFrame({"user_id": rows["user_id"], "event_id": rows["event_id"], "accepted": ok})

    timed = event_time(stream, late=late).select("user_id", "event_id", "ts", F.unix_micros("ts").alias("at"))
    kinds = ", ".join(f"{c} {stream.schema[c].dataType.simpleString()}" for c in ("user_id", "event_id"))
    return timed.groupBy("user_id").applyInPandasWithState(of, f"{kinds}, accepted boolean", "held array<bigint>", "append", "EventTimeTimeout")


def unexpired(df: DataFrame, keys: list[str], ts: str, ttl: Column, as_of: Column) -> DataFrame:
    """The latest row of each key, unless its time to live has passed; entries for a key replace those before."""
    rest = [c for c in df.columns if c not in keys]
    last = df.where(F.col(ts) <= as_of).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*([ts] + [c for c in rest if c != ts]))).alias("row")).select(*keys, "row.*")
    return last.where(F.col(ts) + ttl > as_of)


def followed(first: DataFrame, second: DataFrame, key: str, within: str, late: str | None = None) -> DataFrame:
    """Rows of first (key, ts, id) with those of second that follow them within a time: key, first_id, second_id. Streams join the same way, with watermarks."""
    a = event_time(first, late=late).select(F.col(key), F.col("ts").alias("first_ts"), F.col("id").alias("first_id"))
    b = event_time(second, late=late).select(F.col(key).alias("key_"), F.col("ts").alias("second_ts"), F.col("id").alias("second_id"))
    near = (F.col("second_ts") >= F.col("first_ts")) & (F.col("second_ts") <= F.col("first_ts") + F.expr(f"interval {within}"))
    return a.join(b, (F.col(key) == F.col("key_")) & near).select(key, "first_id", "second_id")


def usage_of(df: DataFrame) -> DataFrame:
    """Calls at two grains, (tool, user, day) and (tool, day); the user is null in the second."""
    e = df.withColumn("day", F.to_date("ts"))
    return e.groupingSets([[F.col("event_type"), F.col("user_id"), F.col("day")], [F.col("event_type"), F.col("day")]], "event_type", "user_id", "day").agg(F.grouping("user_id").alias("all_users"), F.count("*").alias("calls"), F.sum("value").alias("total"))


USAGE = ["event_type", "user_id", "day", "all_users"]


def _usage_sum(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*USAGE).agg(F.sum("calls").alias("calls"), F.sum("total").alias("total"))


def start_usage_rollup(stream: DataFrame, path: str, checkpoint: str):
    """Keeps usage at both grains up to date; a batch that is run again doesn't count twice."""
    return keep(stream, path, checkpoint, USAGE, usage_of, _usage_sum)


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """The present usage."""
    return read_kept(spark, path)


#: The relative standard error of the sketches of users: 1.04 / sqrt(2 ** 12); and the largest error of a rank in those of values, with k = 200.
HLL_BITS, HLL_ERROR, KLL_K, KLL_ERROR = 12, 0.0163, 200, 0.0133


def daily_sketches(events: DataFrame) -> DataFrame:
    """(day, event_type, users, values): sketches of a day's distinct users and of its values, which add up over any days."""
    e = events.withColumn("day", F.to_date("ts"))
    return e.groupBy("day", "event_type").agg(F.hll_sketch_agg("user_id", F.lit(HLL_BITS)).alias("users"), F.kll_sketch_agg_double("value", F.lit(KLL_K)).alias("values"))


def merged_sketches(daily: DataFrame, by: list[str], ranks: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """by, users (about), values (how many), and the values at some ranks (about): from sketches alone, without the events."""
    kll = F.reduce(F.slice(F.collect_list("values"), 2, F.count("*").cast("int")), F.get(F.collect_list("values"), F.lit(0)), lambda a, b: F.kll_sketch_merge_double(a, b))
    some = daily.where("values is not null").groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("users")).alias("users"), kll.alias("sketch"))
    found = F.kll_sketch_get_quantile_double("sketch", F.array(*map(F.lit, ranks)))
    return some.select(*by, "users", F.kll_sketch_get_n_double("sketch").alias("values"), found.alias("quantiles"))


def latest_state(df: DataFrame, key: str, order: str, created: str) -> DataFrame:
    """An upsert of all rows: the latest of each key, with the time of creation of the first."""
    rest = [c for c in df.columns if c not in (key, created)]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("row"), F.min_by(created, order).alias(created)).select(key, "row.*", created)


def start_daily_rollup(stream: DataFrame, path: str, checkpoint: str):
    """Keeps the daily counts of a stream as Parquet: closed days are appended once the watermark has passed them."""
    daily = windowed_counts(event_time(stream, late="1 hour"), "1 day")
    return daily.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_time(read(spark, sf_dir, "events"))


def _text(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed_counts(_events(spark, sf_dir), "1 hour").select(_text("start"), "event_type", "n", F.round("total", 4).alias("total"))


def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed_counts(_events(spark, sf_dir), "1 day", "6 hours").select(_text("start"), "event_type", "n", F.round("total", 4).alias("total"))


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_counts(_events(spark, sf_dir), "2 hours").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), "user_id", "n")


def latest_before(e: DataFrame, width: int = RANGE) -> DataFrame:
    """e with seen: the latest ts of its kind that arrived before.

    Arrivals are cut into ranges; the latest time before a range comes from the maxima of the ranges
    before it, so that only a range of a kind is sorted in one task. e: event_id, event_type, ts, arrival.
    """
    ranged = e.withColumn("range", F.floor(F.col("arrival") / width))
    tops = ranged.groupBy(F.col("event_type").alias("kind"), F.col("range").alias("of")).agg(F.max("ts").alias("top"))
    carried = tops.select("kind", "of", F.max("top").over(Window.partitionBy("kind").orderBy("of").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    joined = ranged.join(sized(carried), F.col("event_type").eqNullSafe(F.col("kind")) & F.col("range").eqNullSafe(F.col("of")), "left")
    own = F.max("ts").over(Window.partitionBy("event_type", "range").orderBy("arrival", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    return joined.withColumn("seen", F.greatest(own, F.col("carried"))).drop("range", "kind", "of", "carried")


def late_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that arrive (by id) more than an hour behind the latest time seen, for each kind."""
    e = _events(spark, sf_dir).withColumn("arrival", (F.col("event_id") * 7919) % 1000 + F.col("event_id") * 10)
    behind = latest_before(e).withColumn("late", F.coalesce(F.col("ts") < F.col("seen") - F.expr("interval 1 hour"), F.lit(False)))
    return behind.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("late").alias("late"))


def rate_limit_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of a user in the day before each event, itself included; rejected from the fourth on."""
    e = _events(spark, sf_dir).withColumn("s", F.unix_seconds("ts"))
    w = Window.partitionBy("user_id").orderBy("s").rangeBetween(-86_399, 0)
    return e.withColumn("attempts", F.count("*").over(w)).select("user_id", "event_id", "attempts", (F.col("attempts") > 3).alias("rejected"))


def rate_limit_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accepted_calls(read(spark, sf_dir, "events"), limit=3, seconds=86_400)


def live_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as writes to a cache of one day: what is still in it at a time."""
    e = read(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    day = F.expr("interval 1 day")
    return unexpired(e, ["user_id", "event_type"], "ts", day, F.expr("timestamp_ntz'2024-01-15 00:00:00'")).select("user_id", "event_type", "event_id")


def followed_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks that a purchase of the same user follows within two hours."""
    e = read(spark, sf_dir, "events").withColumnRenamed("event_id", "id")
    return followed(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), "user_id", "2 hours")


def usage_two_grains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_of(read(spark, sf_dir, "events")).select("event_type", "user_id", F.col("day").cast("string").alias("day"), F.col("all_users").cast("int").alias("all_users"), "calls", F.round("total", 4).alias("total"))


def task_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as checkpoints of each user's task: the latest state, since when, and created when."""
    e = read(spark, sf_dir, "events").withColumn("version", F.struct("ts", "event_id")).withColumn("created_at", F.col("ts"))
    return latest_state(e.select("user_id", "event_type", "event_id", "ts", "version", "created_at"), "user_id", "version", "created_at").select("user_id", "event_type", "event_id", "ts", "created_at")


def _streamed(df: DataFrame, name: str) -> DataFrame:
    """A table as a stream of four batches."""
    path = scratch_path(df.sparkSession, name)
    df.repartition(4).write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def task_states_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as task_states, kept by a stream."""
    e = read(spark, sf_dir, "events").withColumn("version", F.struct("ts", "event_id")).withColumn("created_at", F.col("ts"))
    stream, root = _streamed(e.select("user_id", "event_type", "event_id", "ts", "version", "created_at"), "events"), scratch_path(spark, "states")
    keep_latest(stream, root, scratch_path(spark, "states-checkpoint"), "user_id", "version", "created_at").awaitTermination()
    return read_latest(spark, root).select("user_id", "event_type", "event_id", "ts", "created_at")


def usage_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as usage_two_grains, kept by a stream."""
    stream, root = _streamed(read(spark, sf_dir, "events"), "events"), scratch_path(spark, "usage")
    start_usage_rollup(stream, root, scratch_path(spark, "usage-checkpoint")).awaitTermination()
    return read_usage(spark, root).select("event_type", "user_id", F.col("day").cast("string").alias("day"), F.col("all_users").cast("int").alias("all_users"), "calls", F.round("total", 4).alias("total"))


def usage_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and median values of each week and kind from daily sketches, next to the exact answers' bounds."""
    daily = materialise(daily_sketches(read(spark, sf_dir, "events")), "sketches")
    week = F.date_trunc("week", F.col("day")).cast("date")
    found = merged_sketches(daily.withColumn("week", week), ["week", "event_type"])
    exact = read(spark, sf_dir, "events").withColumn("week", F.date_trunc("week", F.col("ts")).cast("date")).groupBy("week", "event_type").agg(F.countDistinct("user_id").alias("exact_users"), F.count("value").alias("n"))
    within = F.abs(F.col("users") - F.col("exact_users")) <= F.greatest(F.lit(1.0), 4 * HLL_ERROR * F.col("exact_users"))
    return found.join(exact, ["week", "event_type"]).select(F.col("week").cast("string").alias("week"), "event_type", "exact_users", "n", within.alias("users_within"), (F.col("values") == F.col("n")).alias("counted"))


def running_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's share of its conversation that is done, in percent."""
    t = read(spark, sf_dir, "conversations")
    by = Window.partitionBy("conv_id")
    return t.select("conv_id", "turn", r6(F.count("*").over(by.orderBy("turn")) * 100.0 / F.count("*").over(by)).alias("percent"))


QUERIES = {f.__name__: f for f in (tumbling_counts, sliding_counts, session_windows, late_data, rate_limit_attempts, rate_limit_accepted, running_progress, live_entries, followed_purchases, usage_two_grains, task_states, task_states_kept, usage_kept, usage_sketches)}
ORACLE = {
    "rate_limit_accepted": """with recursive e as materialized (select user_id, event_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as n from events),
        r as (select user_id, n, event_id, true as accepted, [us] as held from e where n = 1 union all
            select user_id, n, event_id, len(held) < 3, case when len(held) < 3 then list_append(held, us) else held end from
            (select e.user_id, e.n, e.event_id, e.us, list_filter(r.held, lambda x: x > e.us - 86400000000) as held from r join e on e.user_id is not distinct from r.user_id and e.n = r.n + 1))
        select user_id, event_id, accepted, held[1] + 86400000000 as reset_at from r""",
    "live_entries": "select user_id, event_type, event_id from (select * from events where ts <= timestamp '2024-01-15' qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1) where ts + interval 1 day > timestamp '2024-01-15'",
    "followed_purchases": "select a.user_id, a.event_id as first_id, b.event_id as second_id from events a join events b on a.user_id = b.user_id and a.event_type = 'click' and b.event_type = 'purchase' and b.ts >= a.ts and b.ts <= a.ts + interval 2 hour",
    "usage_two_grains": "select event_type, user_id, ts::date::varchar as day, grouping(user_id)::int as all_users, count(*) as calls, round(sum(value), 4) as total from events group by grouping sets ((event_type, user_id, ts::date), (event_type, ts::date))",
    "task_states": "select user_id, event_type, event_id, ts, first_ts as created_at from (select *, min(ts) over (partition by user_id) as first_ts from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1)",
    "tumbling_counts": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "sliding_counts": "select strftime(time_bucket(interval 6 hour, ts) - i * interval 6 hour, '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(sum(value), 4) as total from events, range(4) t(i) group by 1, 2",
    "session_windows": "with a as (select *, case when ts - lag(ts) over w < interval 2 hour then 0 else 1 end as fresh from events window w as (partition by user_id order by ts, event_id)), b as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from a) select strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') as start, user_id, count(*) as n from b group by user_id, s",
    "late_data": "with e as (select *, (event_id * 7919) % 1000 + event_id * 10 as arrival from events), s as (select *, max(ts) over (partition by event_type order by arrival, event_id rows between unbounded preceding and 1 preceding) as seen from e) select event_type, count(*) as n, count(*) filter (ts < seen - interval 1 hour) as late from s group by 1",
    "rate_limit_attempts": "with e as (select *, floor(epoch(ts))::bigint as s from events), a as (select user_id, event_id, count(*) over (partition by user_id order by s range between 86399 preceding and current row) as attempts from e) select *, attempts > 3 as rejected from a",
    "running_progress": "select conv_id, turn, round(count(*) over (partition by conv_id order by turn) * 100.0::double / count(*) over (partition by conv_id), 6) as percent from conversations",
}

ORACLE |= {
    "task_states_kept": ORACLE["task_states"],
    "usage_kept": ORACLE["usage_two_grains"],
    "usage_sketches": "select date_trunc('week', ts)::date::varchar as week, event_type, count(distinct user_id) as exact_users, count(value) as n, true as users_within, true as counted from events group by 1, 2",
}
