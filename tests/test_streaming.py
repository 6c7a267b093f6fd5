"""Streams on file sources: batch and stream agree, restarts change nothing."""

import os
import random
import sys
import tempfile
import time

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from driftgate.operators import cdc, fencing
from driftgate.plans import stream_checks
from driftgate.plans.cdc_inputs import MOVED, fencing_log, raw_log, stale_target
from driftgate.sources.cdc import RAW_SCHEMA, good_events, parse_cdc, read_cdc_files
from driftgate.sources.tables import BucketedTable, list_folder, read_ledger, remove_path, write_ledger
from driftgate.sources import segments
from driftgate.streaming import apply, carry, drain, live, metrics, stateful, watch

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))
import verify  # noqa: E402


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-")


def finish(query):
    query.awaitTermination(240)
    assert query.exception() is None


COLUMNS = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string"}


def test_stream_apply_equals_batch_apply(spark, sf, folder):
    """One file per batch, in key order per partition; a rerun of the last batch changes nothing."""
    log = raw_log(spark, sf)
    # every key's changes stay in one file, so the order between batches is theirs
    log.withColumn("f", F.floor(F.col("offset") / 8) % 3).repartition(3, "f").drop("f").write.json(f"{folder}/raw")
    table = BucketedTable(spark, f"{folder}/table", "o_orderkey", stale_target(spark, sf).schema, buckets=8)
    table.create(stale_target(spark, sf))
    applier = apply.CdcApplier(spark, table, f"{folder}/sink", COLUMNS)
    raw = read_cdc_files(spark, f"{folder}/raw", streaming=True, files_per_trigger=1)
    finish(apply.run_apply(raw, applier, f"{folder}/checkpoint"))
    events = cdc.first_deliveries(cdc.with_event_id(good_events(parse_cdc(log)), ["o_orderkey"]))
    want = sorted(map(tuple, cdc.apply_changes(stale_target(spark, sf), events, "o_orderkey").collect()))
    assert sorted(map(tuple, table.read().select(*COLUMNS).collect())) == want
    # restart with the same checkpoint: nothing new
    finish(apply.run_apply(raw, applier, f"{folder}/checkpoint"))
    assert table.read().count() == len(want)
    # replay of a finished batch
    batch = spark.read.json(f"{folder}/raw", schema="topic string, partition int, offset bigint, value string")
    applier(batch, 99)
    assert sorted(map(tuple, table.read().select(*COLUMNS).collect())) == want
    broken = spark.read.parquet(f"{folder}/sink/dead_letters").where("batch_id < 99").count()
    assert broken == parse_cdc(log).where("status = 'corrupt'").count()
    ledger = spark.read.parquet(f"{folder}/sink/ledger")
    assert ledger.where("batch_id < 99").count() == events.count()
    assert ledger.where("batch_id = 99").count() == 0


def test_partial_images_late_rows_and_purge(spark, folder):
    """An update of one column leaves the others; rows behind the horizon are set aside; old days of the ledger go."""
    import datetime
    import json

    day = 86_400_000

    def record(offset, key, after, at, op="u"):
        body = {"op": op, "before": {"id": key}, "after": {"id": key, **after}, "source": {"gtid": f"g{offset}", "db": "d", "table": "t", "ts_ms": at}}
        return ("x.d.t", 0, offset, json.dumps(body))

    raw = "topic string, partition int, offset bigint, value string"
    table = BucketedTable(spark, f"{folder}/t", "id", "id bigint, x string, y string", buckets=2)
    table.create(spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "id bigint, x string, y string"))
    applier = apply.CdcApplier(spark, table, f"{folder}/sink", {"id": "bigint", "x": "string", "y": "string"}, horizon_days=3)
    first = spark.createDataFrame([record(0, 1, {"x": "A"}, 10 * day), record(1, 2, {"y": "late"}, 5 * day)], raw)
    for _ in range(2):
        applier(first, 0)
        assert sorted(map(tuple, table.read().collect())) == [(1, "A", "b"), (2, "c", "d")]
    assert spark.read.parquet(f"{folder}/sink/late").select("gtid").collect()[0][0] == "g1"
    applier(spark.createDataFrame([record(0, 1, {"x": "A"}, 10 * day), record(2, 2, {"y": "D"}, 12 * day)], raw), 1)
    assert sorted(map(tuple, table.read().collect())) == [(1, "A", "b"), (2, "c", "D")]
    assert spark.read.parquet(f"{folder}/sink/ledger").count() == 2
    assert applier.purge(datetime.date(1970, 1, 15)) == 1
    assert spark.read.parquet(f"{folder}/sink/ledger").count() == 1


def test_duplicates_within_watermark(spark, folder):
    rows = [(f"e{i % 20}", 1_700_000_000 + i) for i in range(60)]
    spark.createDataFrame(rows, "event_id string, s long").select("event_id", F.timestamp_seconds("s").alias("ts")).repartition(
        4
    ).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("event_id string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = apply.deduplicated(stream, "ts")
    finish(
        out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c")
        .trigger(availableNow=True).start()
    )
    assert sorted(r[0] for r in spark.read.parquet(f"{folder}/out").select("event_id").collect()) == sorted({r[0] for r in rows})


def test_late_rows_are_split_not_lost(spark):
    rows = spark.createDataFrame([(1, 10), (2, 100), (3, None)], "id int, s long").select("id", F.timestamp_seconds("s").alias("ts"))
    kept, late = apply.split_late(rows, "ts", F.timestamp_seconds(F.lit(50)))
    assert sorted(r["id"] for r in kept.collect()) == [2, 3]
    assert [r["id"] for r in late.collect()] == [1]


def _fence_files(spark, sf, folder):
    log = fencing_log(spark, sf).withColumn("written_at", F.col("written_at").cast("timestamp"))
    bounds = [(0, 400), (400, 900), (900, 10**9)]
    for i, (low, high) in enumerate(bounds):
        log.where((F.col("seq") >= low) & (F.col("seq") < high)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return log


def test_fence_applier_equals_batch(spark, sf, folder):
    log = _fence_files(spark, sf, folder)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    body = apply.FenceApplier(spark, f"{folder}/fence", "table_name")
    finish(apply.run_batches(stream, body, f"{folder}/c"))
    want = {r["seq"]: r["accepted"] for r in fencing.fence(log, keys=["table_name"]).collect()}
    accepted = {r["write_id"] for r in spark.read.parquet(f"{folder}/fence/audit").collect()}
    rejected = {r["write_id"] for r in spark.read.parquet(f"{folder}/fence/violations").collect()}
    assert accepted == {k for k, ok in want.items() if ok}
    assert rejected == {k for k, ok in want.items() if not ok}


def brute_alerts(rows):
    """Alerts of (run, ts, band) rows, one run after another."""
    out, last = [], {}
    for run, ts, band in sorted(rows, key=lambda r: r[1]):
        before = last.get(run, "PROCEED")
        if band is not None:
            last[run] = band
            if band == "BLOCK" != before or (band == "CAUTION" and before == "PROCEED") or (band == "PROCEED" != before):
                out.append((run, ts, before, band))
    return sorted(out, key=lambda r: r[1])


def test_band_alerts_with_a_hot_run_over_many_batches(spark, folder):
    """One run has nine rows in ten; some rows have no band; a batch that runs again changes nothing; a lost carry stops."""
    rnd = random.Random(6)
    rows = [("hot" if rnd.random() < 0.9 else f"r{rnd.randrange(5)}", t, rnd.choice(["PROCEED", "CAUTION", "BLOCK", "BLOCK", None])) for t in range(4000)]
    schema = "run_id string, ts_ms bigint, band string"
    body = carry.band_alerts(spark, f"{folder}/a")
    finish(apply.run_batches(stream_checks._in_files(spark.createDataFrame(rows, schema), "ts_ms", least=8), body, f"{folder}/c"))
    found = sorted(map(tuple, body.results().select("run_id", "ts_ms", "previous", "band").collect()), key=lambda r: r[1])
    assert found == brute_alerts(rows)
    batches = spark.read.parquet(f"{folder}/a/carried").select("batch_id").distinct().count()
    assert batches >= 8
    more = [("hot", 5000, "PROCEED"), ("new", 5001, "CAUTION"), ("hot", 5002, "BLOCK")]
    for _ in range(2):
        body(spark.createDataFrame(more, schema), batches)
    again = sorted(map(tuple, body.results().select("run_id", "ts_ms", "previous", "band").collect()), key=lambda r: r[1])
    assert again == brute_alerts(rows + more)
    remove_path(spark, f"{folder}/a/carried/batch_id={batches}")
    with pytest.raises(AnalysisException):
        body(spark.createDataFrame(more, schema), batches + 1)


@pytest.mark.parametrize("name", ["str7_tumbling_stream", "str8_dead_man_stream"])
def test_a_lost_window_fails_its_entry(spark, sf, name, monkeypatch):
    con = verify.connect(sf)
    assert verify.compare(spark, con, name, sf)[0]
    landed = stream_checks._landed
    monkeypatch.setattr(stream_checks, "_landed", lambda stream: landed(stream).where("event_type <> 'error'"))
    assert not verify.compare(spark, con, name, sf)[0]


def test_clean_clock_restarts_and_completes(spark, folder):
    base = 1_700_000_000
    hours = [(0, "NONE"), (1, "A"), (5, "B"), (30, "NONE"), (80, "NONE"), (200, "NONE"), (300, "NONE")]
    for h, kind in hours:
        spark.createDataFrame([("s", kind, base + h * 3600)], "stream_id string, divergence_class string, s long").select(
            "stream_id", "divergence_class", F.timestamp_seconds("s").alias("ts")
        ).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema("stream_id string, divergence_class string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(
        f"{folder}/in"
    )
    out = stateful.clean_clock_stream(stream, "ts", base * 1000)
    finish(
        out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c")
        .trigger(availableNow=True).start()
    )
    rows = spark.read.parquet(f"{folder}/out").collect()
    events = [r["event"] for r in rows]
    assert sorted(events) == ["restarted", "started", "window_complete"]
    done = next(r for r in rows if r["event"] == "window_complete")
    assert done["class_a"] == 1 and done["last_a_ms"] == (base + 3600) * 1000


BUFFER = "entry_id string, s long, table_name string, bytes bigint, price double"


def buffer_rows(spark, rows):
    base = 1_700_000_000
    listed = [(e, base + s, None if e is None else "page_views", None if e is None else 1000, p) for e, s, p in rows]
    return spark.createDataFrame(listed, BUFFER).withColumn("ts", F.timestamp_seconds("s")).drop("s")


def test_price_buffer_releases_by_price_and_age(spark, folder):
    """Entries wait across batches; a batch that runs again, and all batches in one, give the same."""
    steps = [
        [(None, 0, 0.09), ("early", 60, None)],
        [(None, 600, 0.18), ("old", 700, None), ("young", 6000, None)],
        [(None, 10000, 0.09), ("late", 10100, None)],
        [(None, 40000, 0.18), ("open", 40100, None)],
    ]
    body = drain.DrainApplier(spark, f"{folder}/a")
    for i, step in enumerate(steps):
        for _ in range(2):
            body(buffer_rows(spark, step), i)

    def listed(rows):
        return sorted((r["entry_id"], r["flush_reason"], int(r["flush_at"].timestamp()) - 1_700_000_000, r["flush_price"]) for r in rows.collect())

    want = [("old", "max_age", 7900, 0.18), ("young", "price_normal", 10000, 0.09)]
    assert listed(body.released()) == want
    assert listed(body.planned()) == [("open", "max_age", 47300, 0.18)]
    # the old prices are gone, but for the one in force
    assert spark.read.parquet(f"{folder}/a/prices/batch_id=3").count() == 2
    once = drain.DrainApplier(spark, f"{folder}/b")
    once(buffer_rows(spark, [r for step in steps for r in step]), 0)
    assert listed(once.released()) == want and listed(once.planned()) == listed(body.planned())
    remove_path(spark, f"{folder}/a/waiting/batch_id=3")
    with pytest.raises(AnalysisException):
        body(buffer_rows(spark, steps[0]), 4)


def test_late_rows_by_arrival(spark, folder):
    """What is late does not depend on where batches end."""
    rnd = random.Random(2)
    rows = [(i, rnd.choice("ab"), None if rnd.random() < 0.05 else i * 10 - rnd.choice([0, 0, 5, 900])) for i in range(300)]
    want, newest = [], {}
    for i, k, at in rows:
        if at is not None and k in newest and at < newest[k] - 300:
            want.append(i)
        newest[k] = max(newest.get(k, at), at) if at is not None and k in newest else newest.get(k, at) if k in newest else at
        if newest[k] is None:
            del newest[k]
    for name, cuts in (("x", [0, 300]), ("y", [0, 7, 100, 101, 300])):
        body = carry.late_split(spark, f"{folder}/{name}", "k", ["i"], "at", 300)
        for n, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
            body(spark.createDataFrame(rows[low:high], "i int, k string, at bigint").repartition(3), n)
        assert sorted(r["i"] for r in body.results("late").collect()) == want
        assert body.results("late").count() + body.results().count() == len(rows)


def test_live_comparison_reports_the_missing_side(spark, folder):
    """A pair in time, one that differs, a write only one side has, and a target that comes after its time."""
    schema = "k int, v string, ts timestamp, operation string, latency_ms double"
    base = 1_700_000_000

    def stream(name, batches):
        for i, rows in enumerate(batches):
            listed = [(k, v, base + s, op, ms) for k, v, s, op, ms in rows]
            frame = spark.createDataFrame(listed, "k int, v string, s long, operation string, latency_ms double")
            frame.select("k", "v", F.timestamp_seconds("s").alias("ts"), "operation", "latency_ms").coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}")

    edge = stream("e", [[(1, "a", 0, "UPDATE", 10.0), (2, "b", 5, "UPDATE", 10.0)], [(3, "c", 20, "DELETE", 10.0), (4, "d", 30, "UPDATE", 10.0)], [(9, None, 90_000, "UPDATE", 1.0)]])
    target = stream("t", [[(1, "a", 60, "UPDATE", 50.0), (2, "x", 65, "UPDATE", 10.0)], [(5, "e", 100, "DELETE", 10.0), (4, "d", 4000, "UPDATE", 10.0)], [(9, None, 90_000, "UPDATE", 1.0)]])
    out = live.live_compare(edge, target, "k", ["v"])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    finish(out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start())
    found = sorted((r["k"], r["missing"] or "", r["divergence_class"]) for r in spark.read.parquet(f"{folder}/out").collect() if r["k"] != 9)
    assert found == [(1, "", "C"), (2, "", "A"), (3, "target", "B"), (4, "edge", "B"), (4, "target", "A"), (5, "edge", "A")]


def test_tumbling_and_dead_man_streams(spark, folder):
    base = 1_700_006_400
    rows = [(i, base + i * 600, 10 + i) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, s long, v long").select("id", F.timestamp_seconds("s").alias("ts"), "v")
    df.coalesce(1).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{folder}/in")
    out = metrics.tumbling(stream, "ts", "1 hour", {"worst": F.max("v"), "n": F.count(F.lit(1))})
    finish(
        out.writeStream.format("parquet").option("path", f"{folder}/a").option("checkpointLocation", f"{folder}/ca")
        .trigger(availableNow=True).start()
    )
    got = spark.read.parquet(f"{folder}/a")
    assert got.where("n = 6").count() >= 8
    moved = metrics.dead_man_stream(stream, "ts", "v", min_bytes=500)
    finish(
        moved.writeStream.format("parquet").option("path", f"{folder}/b").option("checkpointLocation", f"{folder}/cb")
        .trigger(availableNow=True).start()
    )
    windows = spark.read.parquet(f"{folder}/b").toPandas()
    for row in windows.itertuples():
        inside = [v for _, s, v in rows if row.window_start.timestamp() <= s < row.window_end.timestamp()]
        assert row.gained_bytes == sum(inside)
        assert row.alert == (len(inside) >= 2 and sum(inside) < 500)
    assert isinstance(windows, pd.DataFrame) and len(windows) > 5


def test_files_of_a_stream_hold_every_row_once_and_in_order(spark, folder):
    """More rows in one partition than Spark samples for the bounds of its ranges."""
    rows = spark.range(0, 100_000, 1, 1).select((F.col("id") * 7919 % 100_003).alias("at"))
    want = rows.agg(F.count("at"), F.sum("at"), F.sum(F.xxhash64("at").cast("decimal(38,0)"))).first()

    def body(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch_id={batch_id}")

    finish(apply.run_batches(stream_checks._in_files(rows, "at"), body, f"{folder}/c"))
    found = spark.read.parquet(f"{folder}/out")
    assert found.agg(F.count("at"), F.sum("at"), F.sum(F.xxhash64("at").cast("decimal(38,0)"))).first() == want
    bounds = sorted(map(tuple, found.groupBy("batch_id").agg(F.min("at"), F.max("at")).collect()))
    assert len(bounds) == 4 and all(a[2] < b[1] for a, b in zip(bounds, bounds[1:]))


def broken_publish(table):
    """A table whose driver dies when the buckets of a batch are removed and before their new files are in place."""

    def die(batch):
        for name in list_folder(table.spark, f"{table.stages}/batch={batch}/rows"):
            if name.startswith("_bucket="):
                remove_path(table.spark, f"{table.path}/{name}")
        raise RuntimeError("driver lost")

    table._publish = die


def test_upsert_survives_a_crash_inside_its_commit(spark, folder):
    """Buckets that are gone between stage and publish come back from the stage, whoever writes next."""
    schema = "id bigint, v string"

    def opened():
        return BucketedTable(spark, f"{folder}/t", "id", schema, buckets=4)

    def rows(table):
        return sorted(map(tuple, table.read().collect()))

    opened().create(spark.createDataFrame([(i, "old") for i in range(20)], schema))
    batch = spark.createDataFrame([(i, "new") for i in range(10)] + [(50, "more")], schema)
    gone = spark.createDataFrame([(i,) for i in range(15, 20)], "id bigint")
    want = sorted([(i, "new") for i in range(10)] + [(i, "old") for i in range(10, 15)] + [(50, "more")])
    table = opened()
    broken_publish(table)
    with pytest.raises(RuntimeError, match="driver lost"):
        table.write_batch(batch, gone, 7)
    assert opened().read().count() < len(want)
    # the same batch again: its stage is published, and the rows it brings are not read
    opened().write_batch(spark.createDataFrame([(1, "other")], schema), None, 7)
    assert rows(opened()) == want and not list_folder(spark, f"{folder}/t_staged")
    # another batch after a crash: first what was staged, then its own
    table = opened()
    broken_publish(table)
    with pytest.raises(RuntimeError, match="driver lost"):
        table.write_batch(spark.createDataFrame([(1, "eighth")], schema), None, 8)
    opened().write_batch(spark.createDataFrame([(2, "ninth")], schema), None, 9)
    assert rows(opened()) == sorted([(1, "eighth"), (2, "ninth")] + [r for r in want if r[0] not in (1, 2)])
    # a stage that was never completed is thrown away
    spark.range(1).write.parquet(f"{folder}/t_staged/batch=10/rows")
    assert opened().recover() == [] and not list_folder(spark, f"{folder}/t_staged")


def test_apply_goes_on_after_a_crash_inside_the_commit(spark, sf, folder):
    """A stream whose driver dies while a batch's buckets are replaced ends as if nothing had happened."""
    log = raw_log(spark, sf)
    log.withColumn("f", F.floor(F.col("offset") / 8) % 3).repartition(3, "f").drop("f").write.json(f"{folder}/raw")
    target = stale_target(spark, sf)
    table = BucketedTable(spark, f"{folder}/table", "o_orderkey", target.schema, buckets=8)
    table.create(target)
    raw = read_cdc_files(spark, f"{folder}/raw", streaming=True, files_per_trigger=1)
    publish, calls = table._publish, []

    def die_once(batch):
        calls.append(batch)
        if len(calls) == 2:
            for name in list_folder(spark, table.path)[:4]:
                remove_path(spark, f"{table.path}/{name}")
            raise RuntimeError("driver lost")
        publish(batch)

    table._publish = die_once
    with pytest.raises(Exception, match="driver lost"):
        apply.run_apply(raw, apply.CdcApplier(spark, table, f"{folder}/sink", COLUMNS), f"{folder}/checkpoint").awaitTermination(240)
    again = BucketedTable(spark, f"{folder}/table", "o_orderkey", target.schema, buckets=8)
    finish(apply.run_apply(raw, apply.CdcApplier(spark, again, f"{folder}/sink", COLUMNS), f"{folder}/checkpoint"))
    events = cdc.first_deliveries(cdc.with_event_id(good_events(parse_cdc(log)), ["o_orderkey"]))
    want = sorted(map(tuple, cdc.apply_changes(target, events, "o_orderkey").collect()))
    assert sorted(map(tuple, again.read().select(*COLUMNS).collect())) == want


def test_lost_epochs_stop_the_fence(spark, folder):
    """Without the epochs of the batch before, a batch fails; it doesn't start again from nought."""
    body = apply.FenceApplier(spark, f"{folder}/fence", "table_name")
    schema = "seq bigint, epoch bigint, table_name string, operation string, written_at timestamp"
    body(spark.createDataFrame([(1, 5, "t", "u", None)], schema), 0)
    stale = spark.createDataFrame([(2, 4, "t", "u", None)], schema)
    body(stale, 1)
    assert spark.read.parquet(f"{folder}/fence/violations").count() == 1
    remove_path(spark, f"{folder}/fence/epochs/batch_id=1")
    with pytest.raises(AnalysisException):
        body(stale, 2)


def test_progress_of_a_stream_becomes_a_table(spark, sf, folder):
    """The listener writes what each batch observed; the sums are those of the whole log."""
    log = raw_log(spark, sf)
    log.repartitionByRange(3, "offset").write.json(f"{folder}/raw")
    target = stale_target(spark, sf)
    table = BucketedTable(spark, f"{folder}/table", "o_orderkey", target.schema, buckets=4)
    table.create(target)
    raw = read_cdc_files(spark, f"{folder}/raw", streaming=True, files_per_trigger=1)
    listener = watch.ProgressLog(spark, f"{folder}/progress")
    assert watch.progress_table(spark, f"{folder}/progress").count() == 0
    spark.streams.addListener(listener)
    try:
        finish(apply.run_apply(raw, apply.CdcApplier(spark, table, f"{folder}/sink", COLUMNS), f"{folder}/checkpoint"))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        for _ in range(50):
            found = watch.progress_table(spark, f"{folder}/progress")
            if found.count() >= 3:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    rows = found.select("batch_id", "input_rows", F.col("metrics.source.rows").cast("bigint").alias("rows"), F.col("metrics.source.tombstones").cast("bigint").alias("t")).collect()
    assert sorted(r["batch_id"] for r in rows) == [0, 1, 2]
    assert sum(r["rows"] for r in rows) == log.count() and sum(r["t"] for r in rows) == log.where("value is null").count()
    totals, want = watch.sink_totals(spark, f"{folder}/sink").first(), cdc.sink_counters(parse_cdc(log), ["o_orderkey"]).first()
    assert {k: totals[k] for k in want.asDict()} == want.asDict()


def test_segments_are_read_by_offsets(spark, folder):
    """Batches of 30 records over segments of 25: each ends inside a file; growth is seen; an empty partition is nothing."""
    rows = [("t", i % 2, 10 * i, None if i % 9 == 0 else f'line "{i}"\n\u2028é') for i in range(200)]
    raw = spark.createDataFrame(rows, "topic string, partition int, offset bigint, value string")
    segments.write_segments(raw, f"{folder}/log", rows=25)
    reader = segments.SegmentReader(f"{folder}/log", f"{folder}/own", 30)
    assert reader.initialOffset() == {"0": 0, "1": 0} and reader.latestOffset() == {"0": 30, "1": 30}
    slices = reader.partitions({"0": 10, "1": 0}, {"0": 30, "1": 0})
    assert [(s.partition, s.skip, s.take) for s in slices] == [(0, 10, 15), (0, 0, 5)]
    got = [r for s in slices for r in reader.read(s)]
    assert [(r[1], r[2], r[3], r[4]) for r in got] == [(0, n, 20 * n, rows[2 * n][3]) for n in range(10, 30)]
    # planned offsets are remembered by a new reader
    assert segments.SegmentReader(f"{folder}/log", f"{folder}/own", 30).latestOffset() == {"0": 60, "1": 30}
    assert segments.SegmentReader(f"{folder}/log", None, 0).latestOffset() == {"0": 100, "1": 100}


def test_long_segments_are_read_in_pieces(spark, folder, monkeypatch):
    """A task of a batch reads one piece, however long the segments and the batch are; every record comes once, in its order."""
    monkeypatch.setattr(segments, "_PIECE_ROWS", 10)
    rows = [("t", i % 2, 10 * i, f"v{i}") for i in range(200)]
    raw = spark.createDataFrame(rows, "topic string, partition int, offset bigint, value string")
    segments.write_segments(raw, f"{folder}/log", rows=25)
    reader = segments.SegmentReader(f"{folder}/log", None, 0)
    slices = reader.partitions({"0": 3, "1": 0}, {"0": 100, "1": 60})
    assert all(s.skip + s.take <= 10 for s in slices)
    got = [r[1:] for s in slices for r in reader.read(s)]
    assert [r for r in got if r[0] == 0] == [(0, n, 20 * n, f"v{2 * n}") for n in range(3, 100)]
    assert [r for r in got if r[0] == 1] == [(1, n, 20 * n + 10, f"v{2 * n + 1}") for n in range(60)]
    live = segments.read_segments(spark, f"{folder}/log", f"{folder}/own", per_batch=30)
    seen = []
    query = live.writeStream.foreachBatch(lambda batch, _: seen.extend(r["offset"] for r in batch.collect())).option("checkpointLocation", f"{folder}/c").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(seen) == [10 * i for i in range(200)]


def test_batches_do_not_grow_with_the_table(spark, monkeypatch):
    """A long table has more files a batch; all rows come, batch after batch in their order."""
    monkeypatch.setattr(stream_checks, "_FILE_ROWS", 10)
    seen = []

    def body(batch, batch_id):
        seen.append([r["at"] for r in batch.collect()])

    rows = spark.range(300).select(F.col("id").alias("at"))
    folder = tempfile.mkdtemp()
    finish(apply.run_batches(stream_checks._in_files(rows, "at"), body, f"{folder}/c"))
    assert 4 <= len(seen) < 8
    assert sorted(x for batch in seen for x in batch) == list(range(300))
    assert all(max(a) < min(b) for a, b in zip(seen, seen[1:], strict=False))


def test_ledger_has_few_files_a_day(spark, tmp_path):
    """Not one for each task and day."""
    at = F.timestamp_seconds(1_700_000_000 + F.col("id") % 10 * 86_400)
    rows = spark.range(0, 400, 1, 8).select(F.col("id").cast("string").alias("event_id"), at.alias("applied_at"), F.to_date(at).alias("applied_on"))
    write_ledger(rows, f"{tmp_path}/ledger", 0)
    assert read_ledger(spark, f"{tmp_path}/ledger").count() == 400
    assert len(list(tmp_path.rglob("*.parquet"))) <= 20


def test_batch_of_changes_keeps_no_rows_in_memory(spark, sf, folder, monkeypatch):
    """What a batch reads several times lies in files, which go when it ends, since executors cannot hold a whole log."""
    raw_log(spark, sf).write.json(f"{folder}/raw")
    target = stale_target(spark, sf)
    table = BucketedTable(spark, f"{folder}/table", "o_orderkey", target.schema, buckets=4)
    table.create(target)
    seen, write, before = [], table.write_batch, spark.sparkContext._jsc.getPersistentRDDs().size()

    def watched(*args):
        write(*args)
        seen.append(spark.sparkContext._jsc.getPersistentRDDs().size() - before)

    monkeypatch.setattr(table, "write_batch", watched)
    apply.CdcApplier(spark, table, f"{folder}/sink", COLUMNS)(spark.read.schema(RAW_SCHEMA).json(f"{folder}/raw"), 0)
    assert seen == [0]
    assert list_folder(spark, f"{folder}/sink/work") == []


def test_moved_key_meets_its_own_changes_in_one_batch(spark, folder):
    """Keys so large that a moved one is another row's: its changes must not come in a later or an earlier batch."""
    keys = [base + 35 * n for base in (0, MOVED) for n in range(1, 60)]
    rows = spark.createDataFrame([(k, k % 100, "F") for k in keys], "o_orderkey bigint, o_custkey bigint, o_orderstatus string")
    rows.write.parquet(f"{folder}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{folder}/orders.parquet/*.parquet'")
    assert verify.compare(spark, con, "str1_apply_stream", folder)[0]
