"""Streaming jobs: many micro-batches, restarts and duplicates give what one batch gives."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fleetlens.plans.sequences import counter_delta
from fleetlens.streaming import operators as st
from fleetlens.plans.sequences import state_as_of
from fleetlens.streaming.runs import closable, close, drain, fresh_folder, landed, result, timed

SCHEMA = "instance_id STRING, collected_at TIMESTAMP_NTZ, value BIGINT"


def samples(day, hours=24):
    base = dt.datetime(2024, 1, day)
    return [(k, base + dt.timedelta(hours=h), (day * 100 + h * 3) % 130 if k == "hot" else h) for k in ("hot", "a", "b") for h in range(hours)]


@pytest.fixture()
def folder(spark, tmp_path):
    def land(*days):
        for d in days:
            spark.createDataFrame(samples(d), SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return str(tmp_path / "in")
    return land


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_delta_over_batches_equals_one_batch_and_survives_a_restart(spark, folder):
    out = fresh_folder(spark, "t")
    for days in ((1,), (2, 3)):
        src = folder(*days)
        st.stream_counter_delta(landed(spark, src, SCHEMA, files_per_batch=1), out, ["instance_id"], ["collected_at"], ["value"])
    batch = counter_delta(spark.read.schema(SCHEMA).parquet(src), ["instance_id"], ["collected_at"], ["value"], F.to_date("collected_at")).drop("prev_value")
    got = result(spark, out)
    assert rows(got.select(*batch.columns)) == rows(batch)


def test_forgotten_keys_start_again(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    for i, (key, day) in enumerate([("a", 0), ("b", 30), ("a", 31)]):
        spark.createDataFrame([(key, base + dt.timedelta(days=day), 10 + i)], SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
        st.stream_counter_delta(landed(spark, str(tmp_path / "in"), SCHEMA, files_per_batch=1), str(tmp_path / "out"), ["instance_id"], ["collected_at"], ["value"], keep="7 days")
    got = {(r.instance_id, r.value): r.value_delta for r in result(spark, str(tmp_path / "out")).collect()}
    assert got == {("a", 10): None, ("b", 11): None, ("a", 12): None}


def test_collect_takes_each_file_once(spark, folder):
    out = fresh_folder(spark, "t")
    st.collect(landed(spark, folder(1), SCHEMA), out)
    st.collect(landed(spark, folder(2), SCHEMA), out)
    assert result(spark, out).count() == 2 * 72
    assert result(spark, out).select("collected_date").distinct().count() == 2


def test_tumbling_windows_equal_the_batch_twin(spark, folder):
    src = folder(1, 2)
    out = fresh_folder(spark, "t")
    stream = timed(landed(spark, src, SCHEMA, files_per_batch=1), "collected_at", "1 hour")
    drain(st.utilisation_tumbling(stream, "collected_at", "value", ["instance_id"], "6 hours"), out)
    twin = st.utilisation_tumbling(spark.read.schema(SCHEMA).parquet(src).withColumn("collected_at", F.col("collected_at").cast("timestamp")), "collected_at", "value", ["instance_id"], "6 hours")
    closed = twin.where(F.col("window_end") <= F.lit("2024-01-02 22:00:00").cast("timestamp_ntz"))
    assert rows(result(spark, out)) == rows(closed)


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    base = dt.datetime(2024, 1, 10)
    schema = "instance_id STRING, record_id BIGINT, collected_at TIMESTAMP_NTZ"
    out, n = str(tmp_path / "out"), 0
    for batch in ([("a", 1, base), ("a", 1, base), ("a", 2, base + dt.timedelta(hours=5))], [("a", 3, base - dt.timedelta(days=3)), ("a", 2, base + dt.timedelta(hours=5)), ("a", 4, base + dt.timedelta(hours=6))]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = timed(landed(spark, str(tmp_path / "in"), schema), "collected_at", "1 hour")
        n += st.late_rows(drain(st.without_duplicates(stream, ["instance_id", "record_id"]), out))
    assert sorted(r.record_id for r in result(spark, out).collect()) == [1, 2, 4]
    assert n >= 1


def test_state_as_of_over_batches(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    schema = "k STRING, t TIMESTAMP_NTZ, id BIGINT, state STRING"
    data = [[("a", 0, None, "up"), ("a", 1, 1, None)], [("a", 2, 2, None), ("b", 2, 9, None), ("a", 3, None, "down")], [("a", 4, 3, None)]]
    for batch in data:
        spark.createDataFrame([(k, base + dt.timedelta(days=d), i, s) for k, d, i, s in batch], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        st.stream_state_as_of(landed(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), ["k"], "t", ["state"], F.col("state").isNotNull())
    assert {r.id: r.state for r in result(spark, str(tmp_path / "out")).collect()} == {1: "up", 2: "up", 9: None, 3: "down"}


def shuffled(spark, folder, rows, schema, files=6, reach=40):
    """Lands rows in files, each row at most `reach` places from its own; rows of one file are in no order."""
    dice = random.Random(4)
    moved = [r for _, _, r in sorted((i + dice.uniform(0, reach), i, r) for i, r in enumerate(rows))]
    size = -(-len(moved) // files)
    for k in range(files):
        spark.createDataFrame(moved[k * size:(k + 1) * size], schema).coalesce(1).write.mode("append").parquet(folder)


def test_deltas_of_shuffled_files_equal_the_batch_twin(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    data = [(k, base + dt.timedelta(minutes=10 * i, microseconds=i), (i * 7) % 90 if i % 11 else None) for i in range(200) for k in ("a", None, "b")]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    shuffled(spark, src, data, SCHEMA, reach=60)
    stream = landed(spark, src, SCHEMA, files_per_batch=1)
    st.stream_counter_delta(stream, out, ["instance_id"], ["collected_at"], ["value"], lateness="4 hours", until="2024-02-01 00:00:00", state_partitions=3)
    batch = counter_delta(spark.read.schema(SCHEMA).parquet(src), ["instance_id"], ["collected_at"], ["value"], F.to_date("collected_at")).drop("prev_value")
    assert rows(result(spark, out).select(*batch.columns)) == rows(batch)


def test_late_changes_correct_the_samples_within_the_delay(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    schema = "k STRING, t TIMESTAMP_NTZ, id BIGINT, state STRING, grade BIGINT"
    dice = random.Random(8)
    data = []
    for i in range(300):
        at = base + dt.timedelta(minutes=10 * i)
        key = dice.choice(("a", "b", None))
        data.append((key, at, None, dice.choice(("up", "down", "slow")), i) if i % 4 == 0 else (key, at, i, None, None))
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    shuffled(spark, src, data, schema, reach=30)
    st.stream_state_as_of(landed(spark, src, schema, files_per_batch=1), out, ["k"], "t", ["state", "grade"], F.col("state").isNotNull(), lateness="6 hours", until="2024-02-01 00:00:00")
    frame = spark.createDataFrame(data, schema)
    twin = state_as_of(frame.where("state IS NULL").select("k", "t", "id"), frame.where("state IS NOT NULL").drop("id"), ["k"], "t", ["state", "grade"], F.to_date("t"))
    assert rows(result(spark, out).select(*twin.columns)) == rows(twin)


def test_rows_later_than_the_delay_are_dropped_and_counted(spark, tmp_path):
    base, n = dt.datetime(2024, 1, 10), 0
    for batch in ([("a", 0, 5), ("a", 48, 9)], [("a", 1, 6), ("a", 50, 11)]):
        spark.createDataFrame([(k, base + dt.timedelta(hours=h), v) for k, h, v in batch], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        n += st.late_rows(st.stream_counter_delta(landed(spark, str(tmp_path / "in"), SCHEMA), str(tmp_path / "out"), ["instance_id"], ["collected_at"], ["value"], lateness="1 hour"))
    assert n == 1
    st.stream_counter_delta(landed(spark, str(tmp_path / "in"), SCHEMA), str(tmp_path / "out"), ["instance_id"], ["collected_at"], ["value"], lateness="1 hour", until="2024-01-13 00:00:00")
    assert sorted((r.value, r.value_delta) for r in result(spark, str(tmp_path / "out")).collect()) == [(5, None), (9, 4), (11, 2)]


def test_windows_that_are_open_at_the_end_are_written_when_the_stream_is_closed(spark, folder):
    src, out = folder(1, 2), fresh_folder(spark, "t")
    stream = landed(spark, src, SCHEMA, files_per_batch=1)
    # a filter on anything but the time must not keep the end from the watermark
    kept = timed(closable(stream, out, "collected_at"), "collected_at", "1 hour").where("instance_id <> 'b'")
    plan = st.utilisation_tumbling(kept, "collected_at", "value", ["instance_id"], "6 hours")
    drain(plan, out)
    before = result(spark, out).count()
    close(stream, out, "collected_at", "2024-01-03 06:00:00")
    drain(plan, out)
    twin = st.utilisation_tumbling(spark.read.schema(SCHEMA).parquet(src).where("instance_id <> 'b'").withColumn("collected_at", F.col("collected_at").cast("timestamp")), "collected_at", "value", ["instance_id"], "6 hours")
    assert before < result(spark, out).count() and rows(result(spark, out)) == rows(twin)


def test_many_keys_wait_in_groups(spark, tmp_path):
    """Calls to the state, such as timers, do not grow with the keys; keys of a group do not mix."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "instance_id BIGINT, part ARRAY<STRING>, collected_at TIMESTAMP_NTZ, value BIGINT"
    at = F.timestamp_add("MINUTE", (F.col("id") % 4).cast("int") * 7, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    key = F.floor(F.col("id") / 4)
    frame = spark.range(16_000).select(F.when(key % 1000 != 0, key).alias("instance_id"), F.array(F.when(key % 3 > 0, (key % 7).cast("string"))).alias("part"), at.alias("collected_at"), (F.col("id") * 7 % 11).alias("value"))
    frame = frame.groupBy("instance_id", "part", "collected_at").agg(F.max("value").alias("value"))
    frame.coalesce(1).write.parquet(src)
    for until in (None, "2024-02-01 00:00:00"):
        run = st.stream_counter_delta(landed(spark, src, schema), out, ["instance_id", "part"], ["collected_at"], ["value"], keep="20 minutes", lateness="5 minutes", until=until, state_partitions=3)
        query = run if until is None else query
    timers = [op.customMetrics["numRegisteredTimers"] for p in query.recentProgress for op in p.stateOperators if "numRegisteredTimers" in op.customMetrics]
    assert timers and max(timers) <= 2 * 1024
    twin = counter_delta(spark.read.schema(schema).parquet(src), ["instance_id", "part"], ["collected_at"], ["value"], F.to_date("collected_at")).drop("prev_value")
    assert rows(result(spark, out).select(*twin.columns)) == rows(twin)
