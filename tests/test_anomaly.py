"""The isolation forest on a synthetic baseline."""

import math
import os
import random
import sys
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgate import fixed_values as V
from driftgate.operators import anomaly
from driftgate.plans.anomaly_checks import heartbeats

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))
import verify  # noqa: E402


@pytest.fixture(scope="module")
def baseline(spark):
    rng = random.Random(5)
    rows = []
    for i in range(2500):
        load = 0.4 + 0.6 * max(0.0, math.sin((i / 100.0 - 6) * math.pi / 12))
        rows.append(
            (
                i, 20 + 10 * load + rng.gauss(0, 1), 12 + 6 * load + rng.gauss(0, 1), abs(rng.gauss(0.5, 0.1)), 4e7 * load + rng.gauss(0, 1e6),
                99 + rng.gauss(0, 0.2), 20 + 10 * load + rng.gauss(0, 1), 50 - 10 * load + rng.gauss(0, 1), abs(rng.gauss(0, 0.3)),
                abs(rng.gauss(0.05, 0.02)), abs(rng.gauss(1, 0.3)),
            )
        )
    schema = "timestamp bigint, " + ", ".join(f"{f} double" for f in V.HEARTBEAT_FEATURES)
    return spark.createDataFrame(rows, schema).repartition(4).cache()


@pytest.fixture(scope="module")
def model(baseline):
    return anomaly.fit_forest(baseline)


def test_scores_are_in_range_and_failures_stand_out(spark, baseline, model):
    scored = anomaly.score_rows(baseline, model)
    low, high, mean = scored.agg(F.min("score"), F.max("score"), F.avg("score")).first()
    assert low == 0.0 and high == 1.0 and mean < 0.5
    bad = {f: v for f, v in zip(V.HEARTBEAT_FEATURES, [2000, 1500, 120, 5e8, 60, 140, 5, 80, 15, 50], strict=True)}
    row = spark.createDataFrame([tuple(float(v) for v in bad.values())], ", ".join(f"{f} double" for f in bad))
    worst = anomaly.score_rows(row, model).first()
    assert worst["is_anomaly"] and worst["recommendation"] == "AUTONOMOUS_PAUSE"
    shapes = anomaly.score_rows(anomaly.failure_rows(spark, model), model).collect()
    assert all(r["score"] > mean for r in shapes)


def test_fit_does_not_depend_on_layout(baseline, model):
    again = anomaly.fit_forest(baseline.repartition(9))
    whole = ["tree", "node", "feature", "left", "right", "size", "depth"]
    assert again.nodes[whole].equals(model.nodes[whole])
    # means are sums in another order, so splits agree to the last digits only
    assert np.allclose(again.nodes["split"], model.nodes["split"])


def test_trees_are_bounded_and_complete(model):
    per_tree = model.nodes.groupby("tree")
    assert len(per_tree) == 100
    assert per_tree.size().max() < 2 * 256
    leaves = model.nodes[model.nodes["feature"] < 0]
    assert (leaves.groupby("tree")["size"].sum() == 256).all()
    assert model.nodes["depth"].max() <= 8


def test_long_tables_use_one_draw_per_row(spark):
    df = spark.range(400_000).select(F.col("id").alias("timestamp"), F.rand(1).alias("a"), F.rand(2).alias("b"))
    model = anomaly.fit_forest(df, ["a", "b"], trees=20, subsample=64)
    leaves = model.nodes[model.nodes["feature"] < 0]
    assert leaves["tree"].nunique() == 20 and (leaves.groupby("tree")["size"].sum() == 64).all()


def test_save_load_scores_the_same(spark, baseline, model):
    folder = tempfile.mkdtemp(prefix="spark-")
    anomaly.save_model(spark, model, folder)
    loaded = anomaly.load_model(spark, folder)
    a = anomaly.score_rows(baseline, model).orderBy("timestamp").select("score").toPandas()["score"]
    b = anomaly.score_rows(baseline, loaded).orderBy("timestamp").select("score").toPandas()["score"]
    assert np.abs(a - b).max() < 0.001


def test_short_baseline_is_noted(spark, baseline):
    small = anomaly.fit_forest(baseline.where("timestamp < 100"), trees=5)
    assert small.notes and small.subsample == 100


def test_calibration_counts(spark):
    scored = spark.createDataFrame([(0.9,)] * 5 + [(0.1,)] * 95, "score double")
    assert tuple(anomaly.calibrate(scored).first()) == (100, 5, 5, 0.0, True)


def test_stream_scoring_equals_batch(spark, baseline, model):
    folder = tempfile.mkdtemp(prefix="spark-")
    baseline.where("timestamp < 200").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(baseline.schema).parquet(f"{folder}/in")
    query = (
        anomaly.score_rows(stream, model).writeStream.format("parquet").option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    want = {r["timestamp"]: r["score"] for r in anomaly.score_rows(baseline.where("timestamp < 200"), model).collect()}
    assert {r["timestamp"]: r["score"] for r in spark.read.parquet(f"{folder}/out").collect()} == want


@pytest.mark.parametrize("name", ["ml2_score_properties", "ml4_threshold_table", "ml4_threshold_search", "ml5_threshold_change"])
def test_entries_beyond_the_smallest_data(spark, name):
    folder = "/root/testdata/sf0.01"
    same, note = verify.compare(spark, verify.connect(folder), name, folder)
    assert same, note


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_injected_failures_reach_their_scores(spark, size):
    """Failures in deviations of the training rows score what they should, at any scale of the figures."""
    beats = heartbeats(spark, f"/root/testdata/{size}")
    model = anomaly.fit_forest(beats, key="us")
    found = anomaly.score_rows(anomaly.failure_rows(spark, model), model).collect()
    assert len(found) == 3 and all(r["score"] >= r["expected"] for r in found)
    tuned, row = anomaly.calibrate_threshold(beats, model, allowed=0.02)
    result = row.first()
    assert result["found"] and tuned.threshold == result["threshold"] <= min(r["score"] for r in found)
    alarms = anomaly.score_rows(beats, tuned).where("is_anomaly").count()
    assert alarms == result["false_alarms"] <= 0.02 * result["rows"]


def brute_threshold(baseline, failures, allowed):
    most = math.floor(len(baseline) * allowed)
    fits = [u for u in range(10_002) if all(round(f * 10_000) >= u for f in failures) and sum(round(b * 10_000) >= u for b in baseline) <= most]
    return (min(fits) / 10_000, True) if fits else (min(failures), False)


def test_threshold_search_against_all_thresholds(spark):
    rng = random.Random(8)
    for case in range(6):
        baseline = [round(rng.random() ** 2 * (0.5 if case % 2 else 1), 4) for _ in range(200)]
        failures = [round(rng.uniform(0.4, 1), 4) for _ in range(3)]
        for allowed in (0.0, 0.05):
            frames = [spark.createDataFrame([(x,) for x in xs], "score double") for xs in (baseline, failures)]
            row = anomaly.find_threshold(*frames, allowed=allowed).first()
            want, found = brute_threshold(baseline, failures, allowed)
            assert (row["threshold"], row["found"]) == (want, found)
            assert row["false_alarms"] == sum(b >= want for b in baseline) and row["rows"] == 200


def test_threshold_search_cases(spark):
    some, none = spark.createDataFrame([(0.3,), (None,), (0.3,)], "score double"), spark.createDataFrame([], "score double")
    assert anomaly.find_threshold(some, none).count() == 0
    alone = anomaly.find_threshold(none, some).first()
    assert (alone["threshold"], alone["found"], alone["failures"], alone["false_alarms"]) == (0.0, True, 2, 0)
    tied = anomaly.find_threshold(some, some).first()
    assert (tied["threshold"], tied["found"], tied["false_alarms"]) == (0.3, False, 2)


def test_absolute_failures_stay_an_option(spark, model):
    rows = {r["shape"]: r for r in anomaly.failure_rows(spark, model, absolute=anomaly.FAILURE_SHAPES).collect()}
    assert rows["replication_lag_spike"]["replication_lag_seconds"] == 30.0 and rows["slow_inserts"]["p99_write_latency_ms"] == 200.0
