"""Isolation forest (Liu, Ting and Zhou, 2008): trees grown in parallel, scores in Arrow batches.

Only bounded things leave the cluster: two numbers per feature, and the trees
themselves (at most ``trees * 2 * subsample`` nodes), which scoring needs on
every executor.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftgate import fixed_values as V
from driftgate.functions.hashing import uniform_draw
from driftgate.session import cut_lineage

_NODES = "tree int, node int, feature int, split double, left int, right int, size int, depth int"
_EULER = 0.5772156649015329


def expected_path(size):
    """Mean path length of an unsuccessful search among ``size`` points."""
    n = np.asarray(size, dtype=float)
    safe = np.maximum(n, 2.0)
    long = 2.0 * (np.log(np.maximum(safe - 1.0, 1.0)) + _EULER) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


@dataclass
class AnomalyModel:
    """Trees, scaling and the range of training scores."""

    features: list[str]
    mean: list[float]
    std: list[float]
    nodes: pd.DataFrame
    subsample: int
    low: float = 0.0
    high: float = 1.0
    threshold: float = V.ANOMALY_THRESHOLD
    contamination: float = V.CONTAMINATION
    rows: int = 0
    peak: list[float] = field(default_factory=list)  # highest training value by feature
    notes: list[str] = field(default_factory=list)


def scaler(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean and population deviation per feature, all in one aggregate."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.avg(f).alias(f"mean_{f}") for f in features], *[F.stddev_pop(f).alias(f"std_{f}") for f in features],
    )


def _subsamples(df: DataFrame, features: Sequence[str], key: str, rows: int, trees: int, size: int, seed: int) -> DataFrame:
    """Up to ``size`` rows per tree, chosen by hashes of key and seed so that they repeat.

    Every row draws once for each tree and goes only into the trees it is drawn for, about twice the subsample a tree;
    of these the lowest draws stay. So trees overlap in the same way at any number of rows.
    """
    identity = F.col(key).cast("string")
    narrow = df.select(identity.alias("_key"), *[F.col(f).cast("double").alias(f) for f in features])
    chance = min(1.0, 2.0 * size / max(rows, 1))

    def draw(tree: Column) -> Column:
        return uniform_draw(F.concat_ws(":", F.col("_key"), tree.cast("string"), F.lit(str(seed))), "xxhash64")

    drawn_for = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < chance)
    drawn = narrow.withColumn("tree", F.explode(drawn_for)).withColumn("_rank", draw(F.col("tree")))
    nearest = Window.partitionBy("tree").orderBy("_rank", "_key")  # about twice the subsample per tree
    return drawn.withColumn("_n", F.row_number().over(nearest)).where(F.col("_n") <= size)


def _grow(features: list[str], size: int, seed: int):
    limit = max(1, math.ceil(math.log2(max(size, 2))))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(rows["tree"].iloc[0])
        data = rows.sort_values("_n")[features].to_numpy(dtype=float)
        rng = np.random.default_rng([seed, tree])
        out: list[list] = []
        waiting = [(np.arange(len(data)), 0, -1, "")]
        while waiting:
            members, depth, parent, side = waiting.pop()
            node = len(out)
            if parent >= 0:
                out[parent][4 if side == "left" else 5] = node
            part = data[members]
            spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(members) > 1 else []
            if depth >= limit or len(spread) == 0:
                out.append([tree, node, -1, 0.0, -1, -1, len(members), depth])
                continue
            feature = int(rng.choice(spread))
            low, high = part[:, feature].min(), part[:, feature].max()
            split = float(rng.uniform(low, high))
            goes_left = part[:, feature] <= split
            if goes_left.all():
                split = float(np.nextafter(high, low))
                goes_left = part[:, feature] <= split
            out.append([tree, node, feature, split, -1, -1, len(members), depth])
            waiting.append((members[~goes_left], depth + 1, node, "right"))
            waiting.append((members[goes_left], depth + 1, node, "left"))
        names = ["tree", "node", "feature", "split", "left", "right", "size", "depth"]
        return pd.DataFrame(out, columns=names)

    return build


def fit_forest(
    df: DataFrame, features: Sequence[str] = tuple(V.HEARTBEAT_FEATURES), key: str = "timestamp",
    trees: int = V.FOREST_TREES, subsample: int = V.FOREST_SUBSAMPLE, contamination: float = V.CONTAMINATION,
    threshold: float = V.ANOMALY_THRESHOLD, seed: int = 42,
) -> AnomalyModel:
    """Train on healthy rows. ``key`` identifies a row and drives the sampling."""
    names = list(features)
    df = cut_lineage(df.select(key, *names))  # read once for scaling, sampling and the range of the scores
    found = scaler(df, names).first()
    rows = found["rows"]
    mean = [float(found[f"mean_{f}"] or 0.0) for f in names]
    std = [float(found[f"std_{f}"] or 0.0) or 1.0 for f in names]
    peaks = df.agg(*[F.max(F.col(f).cast("double")).alias(f) for f in names]).first()
    scaled = df.select(key, *_scaled(names, mean, std))
    chosen = _subsamples(scaled, names, key, rows, trees, subsample, seed)
    grown = chosen.groupBy("tree").applyInPandas(_grow(names, subsample, seed), _NODES)
    model = AnomalyModel(
        names, mean, std, grown.orderBy("tree", "node").toPandas(), min(subsample, max(rows, 1)),
        threshold=threshold, contamination=contamination, rows=rows, peak=[float(peaks[f] or 0.0) for f in names],
    )
    if rows < V.MIN_TRAINING_ROWS:
        model.notes.append(f"only {rows} training rows, {V.MIN_TRAINING_ROWS} are recommended")
    span = df.select(_raw_score(df.sparkSession, model).alias("s")).agg(F.min("s").alias("lo"), F.max("s").alias("hi")).first()
    model.low, model.high = float(span["lo"] or 0.0), float(span["hi"] or 0.0)
    return model


def _scaled(features: Sequence[str], mean: Sequence[float], std: Sequence[float]) -> list[Column]:
    return [((F.col(f).cast("double") - F.lit(m)) / F.lit(s)).alias(f) for f, m, s in zip(features, mean, std, strict=True)]


class _Forest:
    """Node arrays of all trees behind one another, walked for a whole batch at once."""

    def __init__(self, nodes: pd.DataFrame, subsample: int):
        ordered = nodes.sort_values(["tree", "node"])
        starts = ordered.groupby("tree").size().cumsum().shift(fill_value=0)
        offset = ordered["tree"].map(starts).to_numpy()
        self.roots = starts.to_numpy()
        self.feature = ordered["feature"].to_numpy()
        self.split = ordered["split"].to_numpy()
        self.left = ordered["left"].to_numpy() + offset
        self.right = ordered["right"].to_numpy() + offset
        self.path = ordered["depth"].to_numpy() + expected_path(ordered["size"].to_numpy())
        self.norm = max(float(expected_path(subsample)), 1e-9)

    def score(self, data: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data))
        lines = np.arange(len(data))
        for root in self.roots:
            at = np.full(len(data), root)
            while True:
                feature = self.feature[at]
                inner = feature >= 0
                if not inner.any():
                    break
                value = data[lines, np.maximum(feature, 0)]
                step = np.where(value <= self.split[at], self.left[at], self.right[at])
                at = np.where(inner, step, at)
            total += self.path[at]
        return np.power(2.0, -total / len(self.roots) / self.norm)


def _raw_score(spark: SparkSession, model: AnomalyModel) -> Column:
    shared = spark.sparkContext.broadcast((model.nodes, model.subsample))
    built: dict = {}

    @F.pandas_udf("double")
    def path_score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        if "forest" not in built:
            built["forest"] = _Forest(*shared.value)
        for batch in batches:
            yield pd.Series(built["forest"].score(batch.to_numpy(dtype=float)))

    return path_score(F.struct(*_scaled(model.features, model.mean, model.std)))


def score_rows(df: DataFrame, model: AnomalyModel) -> DataFrame:
    """Add score 0..1 (training range), is_anomaly and recommendation; works on streams too.

    The range is that of the training scores, so a single row can be judged.
    """
    raw = _raw_score(df.sparkSession, model)
    width = model.high - model.low
    unit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("_raw") - model.low) / F.lit(width))) if width > 0 else F.lit(0.0)
    scored = df.withColumn("_raw", raw).withColumn("score", F.round(unit, 4)).drop("_raw")
    score, limit = F.col("score"), model.threshold
    label = F.when(score >= limit, "AUTONOMOUS_PAUSE").when(score >= limit * 0.8, "MONITOR_CLOSELY").otherwise("NORMAL")
    return scored.withColumn("is_anomaly", score >= limit).withColumn("recommendation", label)


def calibrate(scored: DataFrame, contamination: float = V.CONTAMINATION, threshold: float = V.ANOMALY_THRESHOLD) -> DataFrame:
    """Flagged rows against the number contamination predicts."""
    counted = scored.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("score") >= threshold).alias("actual_flagged"))
    expected = F.floor(F.col("rows") * F.lit(contamination))
    off = F.abs(F.col("actual_flagged") - expected) / F.greatest(expected, F.lit(1))
    return counted.select(
        "rows", expected.alias("expected_anomalous"), "actual_flagged", F.round(off * 100, 2).alias("pct_difference"),
        (off < V.CALIBRATION_TOLERANCE).alias("passed"),
    )


# --- fixed values: injected failures in absolute figures (name, features set, lowest score expected) ---
FAILURE_SHAPES = [
    ("replication_lag_spike", {"replication_lag_seconds": 30.0}, 0.6),
    ("connection_pool_exhaustion", {"conn_idle": 120.0, "conn_active": 5.0, "conn_waiting": 40.0}, 0.65),
    ("slow_inserts", {"p99_write_latency_ms": 200.0}, 0.7),
]
# --- end of fixed values ---

#: The same failures in deviations of the training rows, with the figures each drags along.
FAILURE_DEVIATIONS = [
    ("replication_lag_spike", {"replication_lag_seconds": 8, "wal_write_rate_bytes_per_sec": 8, "long_query_count": 6}, 0.6),
    (
        "connection_pool_exhaustion",
        {"conn_idle": 8, "conn_waiting": 8, "conn_active": -3, "p99_select_latency_ms": 6, "long_query_count": 6},
        0.65,
    ),
    ("slow_inserts", {"p99_write_latency_ms": 8, "long_query_count": 8, "deadlock_count_per_min": 6, "conn_active": 6}, 0.7),
]


def failure_rows(spark: SparkSession, model: AnomalyModel, deviations: Sequence[tuple] = FAILURE_DEVIATIONS, absolute: Sequence[tuple] | None = None) -> DataFrame:
    """The mean row with each injected failure, and the score it should reach.

    A figure k deviations up is mean + k deviations, and at least one deviation beyond all training rows; one k deviations
    down is mean - k deviations. What is a failure thus follows the scale of the system. ``absolute`` sets figures instead.
    """
    rows = []
    for name, changes, expected in absolute or deviations:
        values = dict(zip(model.features, model.mean, strict=True))
        for feature, by in changes.items():
            if absolute:
                values[feature] = by
                continue
            at = model.features.index(feature)
            values[feature] = model.mean[at] + by * model.std[at]
            if by > 0:
                values[feature] = max(values[feature], model.peak[at] + model.std[at])
        rows.append((name, float(expected), *[float(values[f]) for f in model.features]))
    schema = "shape string, expected double, " + ", ".join(f"`{f}` double" for f in model.features)
    return spark.createDataFrame(rows, schema)


_UNITS = 10_000  # scores have four digits


def threshold_table(baseline: DataFrame, failures: DataFrame, score: str = "score") -> DataFrame:
    """(cut, false_alarms, caught): baseline rows and failures that score at least ``cut``, for each score that occurs.

    Scores are 0 to 1 with four digits, so however many rows there are, they are counted by at most 10 001 values, with a
    combine before the shuffle, and only these counts are summed from the top. Rows without a score count nowhere.
    """
    unit = F.round(F.col(score) * _UNITS).cast("bigint").alias("unit")
    none, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    both = baseline.select(unit, one.alias("a"), none.alias("b")).unionByName(failures.select(unit, none.alias("a"), one.alias("b")))
    counts = both.where("unit is not null").groupBy("unit").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc("unit"))  # a row a score that occurs
    return counts.select(
        F.round(F.col("unit") / _UNITS, 4).alias("cut"), F.sum("a").over(down).alias("false_alarms"), F.sum("b").over(down).alias("caught")
    )


def find_threshold(baseline: DataFrame, failures: DataFrame, score: str = "score", allowed: float = 0.0) -> DataFrame:
    """One row: the lowest threshold that catches every failure with at most the share ``allowed`` of the baseline as false alarms.

    Where no threshold does, it is the highest that catches every failure, and ``found`` is false. Between two scores that
    occur all thresholds do the same, so the lowest is one unit above the last score that would raise too many alarms. All
    is null without failures.
    """
    table = threshold_table(baseline, failures, score)
    totals = table.agg(F.max("false_alarms").alias("rows"), F.max("caught").alias("failures"))
    rated = table.join(totals).withColumn("most", F.floor(F.col("rows") * F.lit(float(allowed))))
    rated = rated.agg(
        F.first("rows").alias("rows"), F.first("failures").alias("failures"), F.first("most").alias("most"),
        F.max(F.when(F.col("false_alarms") > F.col("most"), F.col("cut"))).alias("_noisy"),
        F.max(F.when(F.col("caught") == F.col("failures"), F.col("cut"))).alias("_last"),
    )
    quiet = F.coalesce(F.round(F.col("_noisy") + 1 / _UNITS, 4), F.lit(0.0))
    found = quiet <= F.col("_last")
    chosen = rated.select("rows", "failures", F.when(found, quiet).otherwise(F.col("_last")).alias("threshold"), found.alias("found")).where("failures > 0")
    alarms = table.join(chosen.select("threshold"), F.col("cut") >= F.col("threshold")).agg(F.coalesce(F.max("false_alarms"), F.lit(0)).alias("false_alarms"))
    return chosen.join(alarms).select("threshold", "found", "failures", "rows", "false_alarms")


def calibrate_threshold(df: DataFrame, model: AnomalyModel, allowed: float = 0.01, deviations: Sequence[tuple] = FAILURE_DEVIATIONS) -> tuple[AnomalyModel, DataFrame]:
    """The model with the threshold that the injected failures and the baseline ``df`` give, and the row that says so.

    The training rows fill the scale from 0 to 1, so a small share of them is allowed above the threshold.
    """
    result = cut_lineage(find_threshold(score_rows(df, model), score_rows(failure_rows(df.sparkSession, model, deviations), model), allowed=allowed))
    return replace(model, threshold=float(result.first()["threshold"])), result


def threshold_change_pct(before: Column, after: Column) -> Column:
    """Change of the alert threshold in percent; 0 without an earlier one."""
    return F.coalesce(F.round(F.try_divide(F.abs(after - before), F.nullif(before, F.lit(0.0))) * 100, 2), F.lit(0.0))


def retrain(df: DataFrame, previous: AnomalyModel | None, **options) -> tuple[AnomalyModel, DataFrame]:
    """A new model on another baseline, and one row on how it compares with the last one."""
    model = fit_forest(df, **options)
    result = calibrate(score_rows(df, model), model.contamination, model.threshold)
    old = F.lit(None if previous is None else previous.threshold).cast("double")
    return model, result.select(
        F.lit(model.rows).alias("training_rows"), old.alias("previous_threshold"), F.lit(model.threshold).alias("new_threshold"),
        threshold_change_pct(old, F.lit(model.threshold)).alias("threshold_change_pct"), F.col("passed").alias("calibration_passed"),
    )


def save_model(spark: SparkSession, model: AnomalyModel, folder: str) -> None:
    """Trees and metadata as two tables."""
    spark.createDataFrame(model.nodes, _NODES).coalesce(1).write.mode("overwrite").parquet(f"{folder}/nodes")
    meta = [(model.features, model.mean, model.std, model.subsample, model.low, model.high, model.threshold, model.contamination, model.rows, model.peak)]
    schema = (
        "features array<string>, mean array<double>, std array<double>, subsample int, low double, high double, "
        "threshold double, contamination double, rows bigint, peak array<double>"
    )
    spark.createDataFrame(meta, schema).coalesce(1).write.mode("overwrite").json(f"{folder}/meta")


def load_model(spark: SparkSession, folder: str, threshold: float | None = None) -> AnomalyModel:
    meta = spark.read.json(f"{folder}/meta").first()
    nodes = spark.read.parquet(f"{folder}/nodes").orderBy("tree", "node").toPandas()
    return AnomalyModel(
        list(meta["features"]), list(meta["mean"]), list(meta["std"]), nodes, meta["subsample"], meta["low"], meta["high"],
        meta["threshold"] if threshold is None else threshold, meta["contamination"], meta["rows"], list(meta["peak"]),
    )
