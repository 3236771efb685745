"""Streaming operators: transformations of streams, and runs that need state."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import LongType, StructField, StructType

from fleetlens.functions.columns import fleet_keys, from_instant, micros, ratio
from fleetlens.streaming.ordered import AT, in_order
from fleetlens.streaming.runs import closable, close, drain, timed, with_day

# executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHANGE = "_change"


def collect(snapshots: DataFrame, folder: str, time: str = "collected_at"):
    """Append snapshots to a table partitioned by day, each landed file once."""
    return drain(with_day(snapshots, time), folder, partition_by=["collected_date"])


def _ended(stream: DataFrame, folder: str, time: str, lateness: str, until: str | None, build, state_partitions: int | None):
    """Drain what `build` makes of the timed stream; with `until`, once more after the end has been said."""
    plan = build(timed(closable(stream, folder, time), time, lateness))
    query = drain(plan, folder, state_partitions=state_partitions)
    if until is not None:
        close(stream, folder, time, until)
        query = drain(plan, folder, state_partitions=state_partitions)
    return query


def stream_counter_delta(snapshots: DataFrame, folder: str, keys: Sequence[str], order: Sequence[str], values: Sequence[str], keep: str | None = None,
                         lateness: str = "0 seconds", until: str | None = None, state_partitions: int | None = None):
    """Growth of counters since the sample before, across micro-batches: NULL for the first sample of a key and after
    a reset (a null or smaller value).

    `order` starts with the time of a sample. Samples may land out of order by as much as `lateness`: one waits until the
    watermark has passed it, so its delta is that of the sequence as a whole; samples later than that are dropped and
    counted (`late_rows`). `until` says that the stream is over, which lets the last samples go. `keep` (such as
    `7 days`) forgets what a key showed when it is silent for longer. Each key keeps its last values and the samples of
    one delay; a batch touches the keys that it has samples or ripe samples of.
    """
    keys, order, values = list(keys), list(order), list(values)
    time, columns = order[0], snapshots.columns
    rest = [x for x in columns if x not in keys and x != time]
    kinds = {f.name: f for f in snapshots.schema.fields}
    counters = [StructField(v, kinds[v].dataType) for v in values]
    output = StructType([StructField(AT, LongType()), *[StructField(x, kinds[x].dataType) for x in rest], *[StructField(f"{v}_delta", kinds[v].dataType) for v in values]])
    places = [1 + rest.index(v) for v in values]
    by = [1 + rest.index(x) for x in order[1:]]
    keep_ms = None if keep is None else _milliseconds(snapshots, keep)

    def sort_key(row):
        return (row[0], *((row[i] is not None, row[i]) for i in by))

    def step(carry, row):
        now = tuple(row[i] for i in places)
        grown = tuple(b - a if a is not None and b is not None and b >= a else None for a, b in zip(carry or (None,) * len(now), now))
        return now, (*row, *grown)

    def build(rows: DataFrame) -> DataFrame:
        out = in_order(rows, keys, time, rest, StructType(counters), output, sort_key, step, keep_ms)
        return out.withColumn(time, from_instant(F.timestamp_micros(AT))).select(*columns, *[f"{v}_delta" for v in values])

    return _ended(snapshots, folder, time, lateness, until, build, state_partitions)


def _milliseconds(frame: DataFrame, interval: str) -> int:
    moment = F.expr(f"TIMESTAMP_NTZ '1970-01-01 00:00:00' + INTERVAL {interval}")
    return frame.sparkSession.range(1).select(F.floor(micros(moment) / 1000)).first()[0]


def _window(df: DataFrame, aggs: Sequence[Column], window: Column, keys: Sequence[str]) -> DataFrame:
    per = df.groupBy(*keys, window.alias("w")).agg(*aggs)
    names = [x for x in per.columns if x not in (*keys, "w")]
    return per.select(*keys, from_instant("w.start").alias("window_start"), from_instant("w.end").alias("window_end"), *names)


def utilisation_tumbling(samples: DataFrame, time: str, value: str, keys: Sequence[str], width: str = "1 minute") -> DataFrame:
    """Average and maximum per fixed slice. `samples` has a watermark on `time`."""
    return _window(samples, [F.count(F.lit(1)).alias("samples"), ratio(F.sum(value), F.count(value), 2).alias("avg_value"), F.max(value).alias("max_value")], F.window(time, width), keys)


def utilisation_sliding(samples: DataFrame, time: str, value: str, keys: Sequence[str], width: str = "30 minutes", slide: str = "5 minutes") -> DataFrame:
    """Moving averages of the last minutes."""
    return _window(samples, [F.count(F.lit(1)).alias("samples"), ratio(F.sum(value), F.count(value), 2).alias("avg_value")], F.window(time, width, slide), keys)


def episodes(samples: DataFrame, time: str, keys: Sequence[str], gap: str, aggs: Sequence[Column]) -> DataFrame:
    """Samples of a key less than `gap` after one another as one episode, from `window_start` to a gap after the last sample.

    A sample a whole gap after the last one starts the next episode. Spark's session windows still take it in, so they
    are a microsecond shorter here.
    """
    per = samples.groupBy(*keys, F.session_window(time, f"{gap} -1 microseconds").alias("w")).agg(*aggs)
    names = [x for x in per.columns if x not in (*keys, "w")]
    end = F.timestamp_add("MICROSECOND", F.lit(1), F.col("w.end"))
    return per.select(*keys, from_instant("w.start").alias("window_start"), from_instant(end).alias("window_end"), *names)


def blocking_episodes(pairs: DataFrame, time: str, keys: Sequence[str], wait: str = "wait_ms", gap: str = "5 minutes") -> DataFrame:
    """Consecutive samples of the same waiter and blocker as one episode with its longest wait."""
    return episodes(pairs, time, keys, gap, [F.count(F.lit(1)).alias("samples"), F.max(wait).alias("max_wait_ms")])


def login_failure_alerts(errorlog: DataFrame, time: str = "log_date", width: str = "360 minutes", n: int = 10) -> DataFrame:
    """Windows with at least `n` failed logins."""
    failed = errorlog.where(F.contains("log_text", F.lit("Login failed")))
    return _window(failed, [F.count(F.lit(1)).alias("failures")], F.window(time, width), fleet_keys(errorlog)).where(F.col("failures") >= n)


def without_duplicates(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each record once, however often a ring buffer repeats it within the watermark.

    Rows later than the watermark are dropped and counted by the run
    (`late_rows`).
    """
    return events.dropDuplicatesWithinWatermark(list(keys))


def late_rows(query) -> int:
    """How many rows a run dropped because they came later than the watermark."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def enrich(events: DataFrame, dimension: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Events with the catalog row they concern; Spark broadcasts the catalog only if it is small."""
    return events.join(dimension, list(keys), "left")


def stream_state_as_of(rows: DataFrame, folder: str, keys: Sequence[str], time: str, state_columns: Sequence[str], is_change: Column,
                       lateness: str = "0 seconds", until: str | None = None, state_partitions: int | None = None):
    """Samples with the state valid at their time, across micro-batches. `rows` mixes samples and changes; a change
    counts for samples from its time on, of changes at one moment the one with the smallest state.

    Changes and samples may land out of order by as much as `lateness`; `until` says that the stream is over (see
    `stream_counter_delta`). A key keeps the last change that the watermark has passed, and what came after it.
    """
    keys, state_columns = list(keys), list(state_columns)
    kinds = {f.name: f for f in rows.schema.fields}
    rest = [x for x in rows.columns if x not in keys and x != time and x not in state_columns]
    states = [StructField(x, kinds[x].dataType) for x in state_columns]
    output = StructType([StructField(AT, LongType()), *[StructField(x, kinds[x].dataType) for x in rest], *states])
    n = len(state_columns)

    def sort_key(row):
        # changes first, the smallest state last among them
        return (row[0], not row[1], _Down(tuple((v is not None, v) for v in row[2:2 + n])))

    def step(carry, row):
        if row[1]:
            return tuple(row[2:2 + n]), None
        return carry, (row[0], *row[2 + n:], *(carry or (None,) * n))

    def build(timed_rows: DataFrame) -> DataFrame:
        marked = timed_rows.withColumn(CHANGE, F.coalesce(is_change, F.lit(False)))
        out = in_order(marked, keys, time, [CHANGE, *state_columns, *rest], StructType(states), output, sort_key, step)
        return out.withColumn(time, from_instant(F.timestamp_micros(AT))).select(*keys, time, *rest, *state_columns)

    return _ended(rows, folder, time, lateness, until, build, state_partitions)


class _Down:
    """Sorts downwards."""

    def __init__(self, value):
        self.value = value

    def __lt__(self, other):
        return other.value < self.value

    def __eq__(self, other):
        return other.value == self.value
