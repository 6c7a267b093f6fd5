"""Exact percentiles, chunks over any key and cyclic references, against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgate.operators import keys
from driftgate.operators.selection import exact_percentiles
from driftgate.sources import snapshot_reads


def test_percentiles_of_a_hot_group(spark):
    """A group of nine rows in ten, one value of a third of all rows, groups of one and two rows, null keys and values."""
    rng = random.Random(3)
    rows = [("hot", rng.choice([5.0, rng.uniform(0, 100), rng.uniform(0, 100)])) for _ in range(3000)] + [("one", 7.0), ("two", 1.0), ("two", 2.0)]
    rows += [(None, float(i)) for i in range(11)] + [("hot", None), ("void", None)] + [("small", rng.uniform(-5, 5)) for _ in range(40)]
    points = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    found = {r["k"]: r for r in exact_percentiles(spark.createDataFrame(rows, "k string, v double").repartition(6), ["k"], "v", points).collect()}
    assert set(found) == {"hot", "one", "two", None, "small"}
    for k, row in found.items():
        values = [v for g, v in rows if g == k and v is not None]
        for name, p in points.items():
            assert row[name] == pytest.approx(np.quantile(values, p), abs=1e-9), (k, name)
    assert exact_percentiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", points).count() == 0


def test_percentiles_of_everything_but_keys(spark):
    rows = spark.range(1001).select(F.lit("x").alias("a"), F.lit(None).cast("int").alias("b"), (F.col("id") % 7).alias("v"))
    row = exact_percentiles(rows, ["a", "b"], "v", {"mid": 0.5}).first()
    assert (row["a"], row["b"], row["mid"]) == ("x", None, np.median([i % 7 for i in range(1001)]))


@pytest.mark.parametrize("size", [1, 40, 10_000])
def test_every_row_is_in_one_chunk(spark, size):
    """Composite keys with text, a key value that a third of the rows share, nulls: predicates and assignment agree."""
    rng = random.Random(size)
    rows = [(rng.choice(["a", "b", "bb", "ü"]), rng.randrange(30) if i % 3 else 7, i) for i in range(400)] + [("c", None, 1000), (None, 1, 1001)]
    df = spark.createDataFrame(rows, "t string, n int, id int")
    chunks = snapshot_reads.key_chunks(df, ["t", "n"], size)
    listed = sorted(chunks.collect(), key=lambda r: r["chunk_index"])
    most = max(sum(1 for r in rows if r[:2] == key) for key in {r[:2] for r in rows})
    seen = []
    for c in listed:
        inside = [r["id"] for r in df.where(snapshot_reads.key_range(["t", "n"], c["start_key"], c["end_key"])).collect()]
        assert len(inside) == c["rows"]
        assert c["chunk_index"] == -1 or c["rows"] < size + most
        seen += [(i, c["chunk_index"]) for i in inside]
        if len(listed) > 40 and c["chunk_index"] > 8:
            break
    if len(listed) <= 40:
        assert sorted(seen) == sorted(map(tuple, snapshot_reads.in_key_chunks(df, ["t", "n"], chunks).select("id", "chunk_index").collect()))
        assert len(seen) == len(rows)
    assert listed[0]["chunk_index"] == -1 and listed[0]["rows"] == 2
    assert [c["chunk_index"] for c in listed] == list(range(-1, len(listed) - 1))


def test_chunks_of_nothing(spark):
    df = spark.createDataFrame([], "t string, n int")
    chunks = snapshot_reads.key_chunks(df, ["t", "n"], 5)
    assert chunks.count() == 0 and snapshot_reads.in_key_chunks(df, ["t", "n"], chunks).count() == 0


def brute_order(edges, nodes):
    """Components by mutual reach, and levels by the longest way between them."""
    pairs = {(a, b) for a, b in edges if a != b and a is not None and b is not None}
    reach = {n: {b for a, b in pairs if a == n} for n in nodes}
    for k in nodes:
        for n in nodes:
            if k in reach[n]:
                reach[n] |= reach[k]
    component = {n: min({n} | {m for m in reach[n] if n in reach[m]}) for n in nodes}
    up = {(component[a], component[b]) for a, b in pairs if component[a] != component[b]}

    def level(c):
        return max((level(b) + 1 for a, b in up if a == c), default=0)

    return sorted((n, level(component[n]), component[n], n in reach[n]) for n in nodes)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_order_of_random_references(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i:02d}" for i in range(14)]
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(10 + 5 * seed)] + [("n00", "n00")]
    found = keys.fk_order(spark.createDataFrame(edges, "from_table string, to_table string"), spark.createDataFrame([("alone",)], "table_name string"))
    nodes = sorted({n for e in edges for n in e} | {"alone"})
    assert sorted(map(tuple, found.select("table_name", "level", "component", "cyclic").collect())) == brute_order(edges, nodes)


def test_two_rings_behind_each_other(spark):
    """The smaller name is below, so its label reaches nothing above; the larger ring needs a round of its own."""
    edges = [("a", "b"), ("b", "a"), ("x", "y"), ("y", "x"), ("a", "x"), ("top", "a"), ("y", "root")]
    found = keys.fk_order(spark.createDataFrame(edges, "from_table string, to_table string"))
    assert sorted(map(tuple, found.select("table_name", "level", "component", "cyclic").collect())) == brute_order(edges, ["a", "b", "x", "y", "top", "root"])
    none = spark.createDataFrame([], "from_table string, to_table string")
    assert keys.fk_order(none).count() == 0 and keys.cycles(none).count() == 0


def test_chunk_tasks_grow_with_the_table(spark, monkeypatch):
    """Small ranges are not merged into one task, neither in the plan of chunks nor where rows are placed in them."""
    monkeypatch.setattr(snapshot_reads, "_RANGE_ROWS", 50)
    df = spark.range(2_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("t"), F.col("id").alias("n"), F.lit("x").alias("other"))
    chunks = snapshot_reads.key_chunks(df, ["t", "n"], 100)
    placed = snapshot_reads.in_key_chunks(df, ["t", "n"], chunks)
    assert placed.columns == ["t", "n", "other", "chunk_index"]
    sizes = [r["count"] for r in placed.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 2_000 and max(sizes) < 600
    assert sum(r["rows"] for r in chunks.collect()) == 2_000
