"""Heartbeats from the event log, scaled, modelled and scored."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgate import fixed_values as V
from driftgate.operators import anomaly
from driftgate.plans.registry import check, table
from driftgate.session import shared_folder

_SLOT = 600_000_000

BEATS_SQL = """beats AS (
    SELECT (epoch_us(ts) // 600000000) * 600000000 AS us, max(value) AS p99_select_latency_ms, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS p99_write_latency_ms,
           min(value) AS replication_lag_seconds, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS wal_write_rate_bytes_per_sec,
           CAST(100 - count(*) FILTER (event_type = 'error') AS DOUBLE) AS buffer_pool_hit_rate_pct,
           CAST(count(*) FILTER (event_type = 'purchase') AS DOUBLE) AS conn_active, CAST(count(*) FILTER (event_type = 'view') AS DOUBLE) AS conn_idle,
           CAST(count(*) FILTER (event_type = 'signup') AS DOUBLE) AS conn_waiting, CAST(count(*) FILTER (value > 150) AS DOUBLE) AS deadlock_count_per_min,
           CAST(count(*) FILTER (value > 100) AS DOUBLE) AS long_query_count
    FROM events GROUP BY 1)"""


def heartbeats(spark, folder) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    value, kind = F.col("value"), F.col("event_type")

    def number(which):
        return F.count_if(which).cast("double")

    return table(spark, folder, "events").groupBy((at - F.pmod(at, F.lit(_SLOT))).alias("us")).agg(
        F.max(value).alias("p99_select_latency_ms"), (F.sum(value.cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("p99_write_latency_ms"),
        F.min(value).alias("replication_lag_seconds"),
        F.sum(value.cast("decimal(18,2)")).cast("double").alias("wal_write_rate_bytes_per_sec"),
        (F.lit(100.0) - number(kind == "error")).alias("buffer_pool_hit_rate_pct"), number(kind == "purchase").alias("conn_active"),
        number(kind == "view").alias("conn_idle"), number(kind == "signup").alias("conn_waiting"),
        number(value > 150).alias("deadlock_count_per_min"), number(value > 100).alias("long_query_count"),
    )


@check("str7_heartbeat_grid", f"WITH {BEATS_SQL} SELECT * REPLACE (round(p99_write_latency_ms, 9) AS p99_write_latency_ms) FROM beats")
def heartbeat_grid(spark, folder) -> DataFrame:
    """The batch form of the tumbling metrics the stream computes."""
    return heartbeats(spark, folder).withColumn("p99_write_latency_ms", F.round("p99_write_latency_ms", 9))


@check(
    "agg25_scaler",
    f"WITH {BEATS_SQL} SELECT count(*) AS rows, "
    + ", ".join(f"round(avg({f}), 6) AS mean_{f}, round(stddev_pop({f}), 6) AS std_{f}" for f in V.HEARTBEAT_FEATURES)
    + " FROM beats",
)
def scaler(spark, folder) -> DataFrame:
    found = anomaly.scaler(heartbeats(spark, folder), V.HEARTBEAT_FEATURES)
    return found.select("rows", *[F.round(c, 6).alias(c) for c in found.columns if c != "rows"])


def _model(spark, folder, **options) -> anomaly.AnomalyModel:
    return anomaly.fit_forest(heartbeats(spark, folder), key="us", **options)


@check("ml1_fit_forest")
def fit_forest(spark, folder) -> DataFrame:
    """Nodes per tree of a trained forest."""
    model = _model(spark, folder)
    nodes = spark.createDataFrame(model.nodes)
    return nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("depth"))


@check("ml2_score")
def score(spark, folder) -> DataFrame:
    scored = anomaly.score_rows(heartbeats(spark, folder), _model(spark, folder))
    return scored.select("us", "score", "is_anomaly", "recommendation")


@check("ml3_saved_model", f"WITH {BEATS_SQL} SELECT count(*) AS n_rows, count(*) AS same_score, count(*) AS same_label FROM beats")
def saved_model(spark, folder) -> DataFrame:
    """A model written and read back scores every row as before."""
    beats, model = heartbeats(spark, folder), _model(spark, folder)
    place = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    anomaly.save_model(spark, model, place)
    again = anomaly.score_rows(beats, anomaly.load_model(spark, place)).select("us", F.col("score").alias("s"), F.col("recommendation").alias("r"))
    both = anomaly.score_rows(beats, model).join(again, "us")
    return both.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("score") == F.col("s")).alias("same_score"),
        F.count_if(F.col("recommendation") == F.col("r")).alias("same_label"),
    )


@check("ml4_calibrate")
def calibrate(spark, folder) -> DataFrame:
    return anomaly.calibrate(anomaly.score_rows(heartbeats(spark, folder), _model(spark, folder)))


@check(
    "ml1_forest_shape",
    f"""WITH {BEATS_SQL} SELECT 100 AS trees, least(256, count(*)) AS root_rows, TRUE AS depth_kept, TRUE AS leaves_add_up FROM beats""",
)
def forest_shape(spark, folder) -> DataFrame:
    """Every tree's root holds the subsample, no tree is deeper than its logarithm, and leaves hold each row once."""
    model = _model(spark, folder)
    per_tree = spark.createDataFrame(model.nodes).groupBy("tree").agg(
        F.max("depth").alias("depth"), F.sum(F.when(F.col("feature") < 0, F.col("size"))).alias("leaf_rows")
    )
    return per_tree.agg(
        F.count(F.lit(1)).cast("int").alias("trees"), F.max("leaf_rows").alias("root_rows"),
        (F.max("depth") <= 8).alias("depth_kept"), (F.min("leaf_rows") == F.max("leaf_rows")).alias("leaves_add_up"),
    )


@check(
    "ml2_score_properties",
    f"""WITH {BEATS_SQL} SELECT count(*) AS n_rows, count(*) AS in_range, TRUE AS labels_follow_scores, TRUE AS failures_stand_out FROM beats""",
)
def score_properties(spark, folder) -> DataFrame:
    """Scores are between 0 and 1, labels follow them, and each injected failure scores above the median heartbeat."""
    model = _model(spark, folder)
    scored = anomaly.score_rows(heartbeats(spark, folder), model)
    injected = anomaly.score_rows(anomaly.failure_rows(spark, model), model).agg(F.min("score").alias("lowest_failure"))
    label = F.when(F.col("score") >= model.threshold, "AUTONOMOUS_PAUSE").when(F.col("score") >= model.threshold * 0.8, "MONITOR_CLOSELY").otherwise("NORMAL")
    found = scored.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("score").between(0, 1)).alias("in_range"),
        F.bool_and((F.col("recommendation") == label) & (F.col("is_anomaly") == (F.col("score") >= model.threshold))).alias("labels_follow_scores"),
        F.percentile("score", 0.5).alias("_median"),
    )
    return found.join(injected).select("n_rows", "in_range", "labels_follow_scores", (F.col("lowest_failure") > F.col("_median")).alias("failures_stand_out"))


@check("ml5_retrain")
def retrain(spark, folder) -> DataFrame:
    """A second model on a baseline with lower latencies, against the first one."""
    beats = heartbeats(spark, folder)
    first = anomaly.fit_forest(beats, key="us")
    cloud = beats.withColumn("p99_select_latency_ms", F.col("p99_select_latency_ms") * 0.4)
    _, result = anomaly.retrain(cloud, first, key="us", threshold=0.75)
    return result


@check(
    "agg24_calibration",
    f"""WITH {BEATS_SQL}, s AS (SELECT round((p99_select_latency_ms - (SELECT min(p99_select_latency_ms) FROM beats))
            / ((SELECT max(p99_select_latency_ms) FROM beats) - (SELECT min(p99_select_latency_ms) FROM beats)), 4) AS score FROM beats),
        c AS (SELECT count(*) AS rows, count(*) FILTER (score >= 0.3) AS f, CAST(floor(count(*) * 0.05::DOUBLE) AS BIGINT) AS e FROM s)
        SELECT rows, e AS expected_anomalous, f AS actual_flagged, round(abs(f - e) / greatest(e, 1) * 100, 2) AS pct_difference,
               abs(f - e) / greatest(e, 1) < 0.20 AS passed FROM c""",
)
def calibration(spark, folder) -> DataFrame:
    """Calibration of a score that SQL can compute as well: one feature, min-max scaled."""
    return anomaly.calibrate(_unit_scores(spark, folder), threshold=0.3)


def _unit_scores(spark, folder) -> DataFrame:
    beats = heartbeats(spark, folder)
    column = F.col("p99_select_latency_ms")
    low, high = beats.agg(F.min(column)).scalar(), beats.agg(F.max(column)).scalar()
    return beats.select("us", F.round((column - low) / (high - low), 4).alias("score"))


@check(
    "agg26_min_max_scores",
    f"""WITH {BEATS_SQL} SELECT us, round((p99_select_latency_ms - (SELECT min(p99_select_latency_ms) FROM beats))
            / ((SELECT max(p99_select_latency_ms) FROM beats) - (SELECT min(p99_select_latency_ms) FROM beats)), 4) AS score FROM beats""",
)
def min_max_scores(spark, folder) -> DataFrame:
    return _unit_scores(spark, folder)


@check(
    "agg33_threshold_change",
    """SELECT user_id, CASE WHEN min(value) = 0 THEN 0.0::DOUBLE ELSE round(abs(max(value) - min(value)) / min(value) * 100, 2) END AS threshold_change_pct FROM events GROUP BY 1""",
)
def threshold_change(spark, folder) -> DataFrame:
    return table(spark, folder, "events").groupBy("user_id").agg(F.min("value").alias("b"), F.max("value").alias("a")).select(
        "user_id", anomaly.threshold_change_pct(F.col("b"), F.col("a")).alias("threshold_change_pct")
    )


_SPREAD = (3, 4, 5)  # deviations of the given failures above the mean


def _given_scores(spark, folder, feature: str, rate: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Scores that SQL can give as well: one feature, min-max scaled, and failures some deviations above its mean."""
    beats = heartbeats(spark, folder).select((F.col(feature) * rate).alias("x"))
    low, high, mean, std = beats.agg(F.min("x"), F.max("x"), F.avg("x"), F.stddev_pop("x")).first()
    failures = spark.createDataFrame([(float(mean + k * std),) for k in _SPREAD], "x double")

    def scored(rows: DataFrame) -> DataFrame:
        unit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("x") - low) / (high - low)))
        return rows.select(F.round(unit, 4).alias("score"))

    return scored(beats), scored(failures)


def _given_sql(feature: str, name: str, rate: str = "1.0::DOUBLE") -> str:
    return f"""{name}_x AS (SELECT {feature} * {rate} AS x FROM beats), {name}_f AS (SELECT min(x) AS lo, max(x) AS hi, avg(x) AS m, stddev_pop(x) AS s FROM {name}_x),
        {name}_b AS (SELECT round((x - lo) / (hi - lo), 4) AS score FROM {name}_x, {name}_f),
        {name}_i AS (SELECT round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (m + k * s - lo) / (hi - lo))), 4) AS score FROM {name}_f, (SELECT unnest([3, 4, 5]) AS k)),
        {name}_t AS (SELECT cut, (SELECT count(*) FROM {name}_b WHERE score >= cut) AS false_alarms, (SELECT count(*) FROM {name}_i WHERE score >= cut) AS caught
                     FROM (SELECT round(u / 10000.0::DOUBLE, 4) AS cut FROM range(10002) AS r(u))),
        {name}_r AS (SELECT (SELECT count(*) FROM {name}_b) AS n, (SELECT min(cut) FROM {name}_t WHERE caught = 3 AND false_alarms <= floor((SELECT count(*) FROM {name}_b) * 0.01::DOUBLE)) AS quiet,
                            (SELECT max(cut) FROM {name}_t WHERE caught = 3) AS last),
        {name}_c AS (SELECT coalesce(quiet, last) AS threshold, quiet IS NOT NULL AS found, n FROM {name}_r)"""


@check(
    "ml4_threshold_table",
    f"""WITH {BEATS_SQL}, {_given_sql('p99_select_latency_ms', 'g')}
        SELECT t.* FROM g_t t JOIN (SELECT score FROM g_b UNION SELECT score FROM g_i) s ON t.cut = s.score""",
)
def threshold_table(spark, folder) -> DataFrame:
    """False alarms and caught failures at every score that occurs."""
    return anomaly.threshold_table(*_given_scores(spark, folder, "p99_select_latency_ms"))


@check(
    "ml4_threshold_search",
    f"""WITH {BEATS_SQL}, {_given_sql('p99_select_latency_ms', 'g')}, {_given_sql('conn_idle', 'h')}
        SELECT 'latency' AS case_name, threshold, found, 3::BIGINT AS failures, n AS rows, (SELECT count(*) FROM g_b WHERE score >= threshold) AS false_alarms FROM g_c
        UNION ALL SELECT 'idle', threshold, found, 3, n, (SELECT count(*) FROM h_b WHERE score >= threshold) FROM h_c""",
)
def threshold_search(spark, folder) -> DataFrame:
    """The threshold that catches given failures with at most one false alarm in a hundred rows."""
    cases = {"latency": "p99_select_latency_ms", "idle": "conn_idle"}
    found = [anomaly.find_threshold(*_given_scores(spark, folder, f), allowed=0.01).withColumn("case_name", F.lit(n)) for n, f in cases.items()]
    return found[0].unionByName(found[1])


@check(
    "ml5_threshold_change",
    f"""WITH {BEATS_SQL}, {_given_sql('p99_select_latency_ms', 'old')}, {_given_sql('p99_write_latency_ms', 'new', '0.4::DOUBLE')}
        SELECT o.threshold AS previous_threshold, w.threshold AS new_threshold, round(abs(w.threshold - o.threshold) / o.threshold * 100, 2) AS threshold_change_pct
        FROM old_c o, new_c w""",
)
def threshold_of_a_new_baseline(spark, folder) -> DataFrame:
    """Thresholds found on two baselines, and by how much the second departs from the first."""
    old = anomaly.find_threshold(*_given_scores(spark, folder, "p99_select_latency_ms"), allowed=0.01).select(F.col("threshold").alias("previous_threshold"))
    new = anomaly.find_threshold(*_given_scores(spark, folder, "p99_write_latency_ms", 0.4), allowed=0.01).select(F.col("threshold").alias("new_threshold"))
    change = anomaly.threshold_change_pct(F.col("previous_threshold"), F.col("new_threshold"))
    return old.join(new).withColumn("threshold_change_pct", change)
