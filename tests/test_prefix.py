"""Range-split running aggregates and as-of joins against plain loops."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from driftgate.operators.asof import asof_join
from driftgate.operators.prefix import add_order_ranges, running_scan


def _rows(shape: str, n: int = 2000):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        if shape == "unique":
            at = i
        elif shape == "hot":
            at = 500 if rng.random() < 0.4 else rng.randrange(1000)
        else:
            at = 1
        key = "a" if rng.random() < 0.6 else rng.choice(["b", "c", None])
        value = None if rng.random() < 0.3 else rng.randrange(100)
        rows.append((key, at, i, value))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shape", ["unique", "hot", "constant"])
@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("keyed", [True, False])
def test_running_scan_equals_loop(spark, shape, inclusive, keyed):
    rows = _rows(shape)
    df = spark.createDataFrame(rows, "k string, at long, seq long, v long").repartition(5)
    measures = {
        "s": ("sum", F.col("v")), "m": ("max", F.col("v")), "n": ("min", F.col("v")),
        "c": ("count", F.col("v")), "l": ("last", F.col("v")),
    }
    out = running_scan(df, ["at", "seq"], measures, keys=["k"] if keyed else [], inclusive=inclusive, ranges=7)
    got = {r["seq"]: (r["s"], r["m"], r["n"], r["c"] or 0, r["l"]) for r in out.collect()}
    seen: dict = {}
    for k, at, seq, v in sorted(rows, key=lambda r: (r[1], r[2])):
        past = seen.setdefault(k if keyed else None, [])
        if inclusive and v is not None:
            past.append(v)
        want = (sum(past), max(past), min(past), len(past), past[-1]) if past else (None, None, None, 0, None)
        assert got[seq] == want, (seq, got[seq], want)
        if not inclusive and v is not None:
            past.append(v)
    assert len(got) == len(rows)


def test_running_scan_takes_a_text_tie_breaker_on_skewed_data(spark):
    rows = [(1 if i % 3 else i, f"t{i:05d}", i % 7) for i in range(900)]
    df = spark.createDataFrame(rows, "at long, tie string, v long").repartition(4)
    out = running_scan(df, ["at", "tie"], {"s": ("sum", F.col("v"))}, ranges=6)
    total, want = 0, {}
    for at, tie, v in sorted(rows):
        total += v
        want[tie] = total
    assert {r["tie"]: r["s"] for r in out.collect()} == want


def test_ranges_split_a_hot_order_value(spark):
    df = spark.createDataFrame(_rows("constant"), "k string, at long, seq long, v long")
    sizes = add_order_ranges(df, ["at", "seq"], 8).groupBy("_range").count().collect()
    assert len(sizes) >= 7
    assert max(r["count"] for r in sizes) < 2000 * 0.3


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("limit", [0, 10_000])
def test_asof_equals_bisect(spark, direction, limit):
    rng = random.Random(3)
    series = sorted({rng.randrange(0, 400_000) for _ in range(60)})
    left = [(i, rng.choice(series) if rng.random() < 0.2 else rng.randrange(-5000, 405_000)) for i in range(800)]
    ldf = spark.createDataFrame(left, "id long, s long").select("id", F.timestamp_seconds("s").alias("ts"))
    sdf = spark.createDataFrame([(t, t * 2) for t in series], "s long, p long").select(
        F.timestamp_seconds("s").alias("pts"), "p"
    )
    got = {r["id"]: r["p"] for r in asof_join(ldf, sdf, "ts", "pts", ["p"], direction, limit, ranges=6).collect()}
    for i, s in left:
        if direction == "backward":
            j = bisect.bisect_right(series, s) - 1
            want = series[j] * 2 if j >= 0 else None
        else:
            j = bisect.bisect_left(series, s)
            want = series[j] * 2 if j < len(series) else None
        assert got[i] == want
    assert len(got) == len(left)
