"""Source against target: by key, by result set, by aggregate, by schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgate import fixed_values as V
from driftgate.functions.clock import HOUR_US, epoch_us
from driftgate.functions.hashing import keep_sample
from driftgate.functions.rows import row_diff, rows_differ
from driftgate.operators.prefix import running_scan


def _prefixed(df: DataFrame, prefix: str, pk: Sequence[str]) -> DataFrame:
    return df.select(
        *[F.col(k).alias(f"{prefix}{k}") for k in pk],
        *[F.col(c).alias(f"{prefix}{c}") for c in df.columns if c not in pk],
        F.lit(True).alias(f"{prefix}_present"),
    )


def shadow_compare(
    edge: DataFrame,
    target: DataFrame,
    pk: str | Sequence[str],
    touched: DataFrame | None = None,
    op: str = "operation",
    edge_ms: str = "edge_ms",
    target_ms: str = "target_ms",
    soft_null: bool = True,
    sample_rate: float = 1.0,
    table: str | None = None,
    critical: Sequence[str] = (),
    detail_chars: int | None = None,
) -> DataFrame:
    """Compare rows by key and classify each difference A (hard), B (soft), C (timing) or NONE.

    ``touched`` holds one row per write to check (key, operation and latencies);
    without it every key of either side is compared as an update. Equi joins on
    the key only: the sides are joined to each other through it, so bucketed or
    range-partitioned tables need no extra exchange.
    """
    keys = [pk] if isinstance(pk, str) else list(pk)
    a, b = _prefixed(edge, "_e_", keys), _prefixed(target, "_t_", keys)
    if touched is None:
        on = [F.col(f"_e_{k}") == F.col(f"_t_{k}") for k in keys]
        joined = a.join(b, on, "full_outer").select(
            *[F.coalesce(f"_e_{k}", f"_t_{k}").alias(k) for k in keys],
            F.lit("UPDATE").alias(op), F.lit(0.0).alias(edge_ms), F.lit(0.0).alias(target_ms), "*",
        )
    else:
        joined = touched.join(a, [touched[k] == F.col(f"_e_{k}") for k in keys], "left").join(
            b, [touched[k] == F.col(f"_t_{k}") for k in keys], "left"
        )
    left = {c: (F.col(f"_e_{c}"), edge.schema[c].dataType) for c in edge.columns if c not in keys}
    right = {c: (F.col(f"_t_{c}"), target.schema[c].dataType) for c in target.columns if c not in keys}
    has_edge, has_target = F.col("_e__present").isNotNull(), F.col("_t__present").isNotNull()
    both = has_edge & has_target
    differs = both & rows_differ(left, right, blank_is_null=True)
    soft_differs = both & rows_differ(left, right, blank_is_null=False) if soft_null else F.lit(False)
    staged = joined.select(
        *[c for c in (touched.columns if touched is not None else [*keys, op, edge_ms, target_ms])],
        has_edge.alias("_has_edge"), has_target.alias("_has_target"),
        differs.alias("_hard"), soft_differs.alias("_soft"),
        F.when(differs, row_diff(left, right, blank_is_null=True)).alias("diff"),
    )
    kept = keep_sample(F.concat_ws(":", *[F.col(k).cast("string") for k in keys]), sample_rate)
    verdict = classify_divergence(
        F.col(op), F.col("_has_edge"), F.col("_has_target"), F.col("diff"), F.col(edge_ms), F.col(target_ms),
        hard=F.col("_hard"), soft=F.col("_soft"),
        sampled=None if sample_rate >= 1.0 else kept, detail_chars=detail_chars,
    )
    named = F.lit(table) if table is not None else F.lit(None).cast("string")
    return staged.select(
        *[c for c in staged.columns if c not in ("_has_edge", "_has_target", "_hard", "_soft", "diff")],
        "diff", verdict["class"].alias("divergence_class"), verdict["details"].alias("divergence_details"),
        is_critical_path(named, critical).alias("critical_path"),
    )


def is_critical_path(table: Column, critical: Sequence[str]) -> Column:
    listed = [t.lower() for t in critical]
    return F.coalesce(F.lower(table).isin(listed), F.lit(False)) if listed else F.lit(False)


def classify_divergence(
    op: Column,
    has_edge: Column,
    has_target: Column,
    diff: Column,
    edge_ms: Column,
    target_ms: Column,
    hard: Column | None = None,
    soft: Column | None = None,
    sampled: Column | None = None,
    detail_chars: int | None = None,
) -> Column:
    """Class and explanation of one comparison as a struct with ``class`` and ``details``.

    ``hard`` says whether values differ; without it a non-empty ``diff`` does. The differing values stand in the details
    as JSON; ``detail_chars`` cuts that text, which then is no JSON any more.
    """
    if hard is None:
        hard = F.coalesce(F.size(diff) > 0, F.lit(False))

    deleted = F.upper(op) == "DELETE"
    neither = ~has_edge & ~has_target
    slow = (edge_ms > 0) & (target_ms > edge_ms * V.TIMING_FACTOR)
    listed = F.to_json(diff, {"ignoreNullFields": "false"})
    values = F.concat(F.lit(V.MSG_VALUES_PREFIX), listed if detail_chars is None else F.left(listed, F.lit(detail_chars)))
    cases = [
        (deleted & neither, "NONE", F.lit(V.MSG_BOTH_DELETED)),
        (deleted & ~has_edge & has_target, "A", F.lit(V.MSG_DELETE_LEFT_ON_TARGET)),
        (deleted & has_edge & ~has_target, "B", F.lit(V.MSG_DELETE_EDGE_ONLY)),
        (~deleted & neither, "B", F.lit(V.MSG_BOTH_MISSING)),
        (~deleted & has_edge & ~has_target, "A", F.lit(V.MSG_MISSING_ON_TARGET)),
        (~deleted & ~has_edge & has_target, "B", F.lit(V.MSG_MISSING_ON_EDGE)),
        (~deleted & hard, "A", values),
    ]
    if soft is not None:
        cases.append((~deleted & soft, "B", F.lit(V.MSG_SOFT_NULL)))
    cases.append((slow, "C", F.format_string(V.MSG_TIMING_FORMAT, target_ms, edge_ms)))
    if sampled is not None:
        cases.insert(0, (~sampled, "NONE", F.lit(V.MSG_SAMPLED_OUT)))
    # two chains, not one of structs: whoever reads the class alone makes no text
    kind, details = F.lit("NONE"), F.lit(V.MSG_NO_DIVERGENCE)
    for when, letter, words in reversed(cases):
        kind, details = F.when(when, F.lit(letter)).otherwise(kind), F.when(when, words).otherwise(details)
    return F.struct(kind.alias("class"), details.alias("details"))


def audit_tallies(comparisons: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts per class and the error rate (A + B) / all."""
    kind = F.col("divergence_class")
    total = F.count(F.lit(1))
    errors = F.count_if(kind.isin("A", "B"))
    return comparisons.groupBy(*by).agg(
        total.alias("total_comparisons"),
        F.count_if(kind == "A").alias("class_a"),
        F.count_if(kind == "B").alias("class_b"),
        F.count_if(kind == "C").alias("class_c"),
        F.round(F.coalesce(F.try_divide(errors, total), F.lit(0.0)), 6).alias("error_rate"),
    )


def side_counts(edge: DataFrame, target: DataFrame) -> DataFrame:
    """Every distinct row with how often each side has it.

    One grouping of the union, combined before the shuffle, so a row that fills
    a third of a side costs no more than any other.
    """
    names = edge.columns
    both = edge.select(*names, F.lit(1).alias("_e"), F.lit(0).alias("_t")).unionByName(
        target.select(*names, F.lit(0).alias("_e"), F.lit(1).alias("_t"))
    )
    return both.groupBy(*names).agg(F.sum("_e").alias("edge_copies"), F.sum("_t").alias("target_copies"))


def compare_results(
    edge: DataFrame,
    target: DataFrame,
    edge_ms: float = 0.0,
    target_ms: float = 0.0,
    multiset: bool = False,
    strict_identity: bool = False,
) -> DataFrame:
    """Compare two query results; one row with sizes, class and explanation.

    Sets by default: equal NONE, sizes differ A, same size but other rows B (A
    with ``strict_identity``), else C when the target took over twice as long.
    ``multiset`` counts copies as well.
    """
    counted = side_counts(edge, target)
    here, there = F.col("edge_copies"), F.col("target_copies")
    if multiset:
        left, right, off = F.sum(here), F.sum(there), F.sum(F.abs(here - there))
    else:
        left, right = F.count_if(here > 0), F.count_if(there > 0)
        off = F.count_if((here > 0) != (there > 0))
    sizes = counted.agg(
        F.coalesce(F.sum(here), F.lit(0)).alias("edge_rows"),
        F.coalesce(F.sum(there), F.lit(0)).alias("target_rows"),
        F.coalesce(left, F.lit(0)).alias("edge_set"), F.coalesce(right, F.lit(0)).alias("target_set"),
        F.coalesce(off, F.lit(0)).alias("rows_off"),
    )
    slow = F.lit(target_ms > edge_ms * V.TIMING_FACTOR)
    kind = (
        F.when(F.col("edge_set") != F.col("target_set"), "A")
        .when(F.col("rows_off") > 0, "A" if strict_identity else "B")
        .when(slow, "C")
        .otherwise("NONE")
    )
    details = (
        F.when(
            F.col("edge_set") != F.col("target_set"),
            F.format_string(V.MSG_SET_COUNT_FORMAT, F.col("edge_set"), F.col("target_set")),
        )
        .when(F.col("rows_off") > 0, V.MSG_SET_VALUES)
        .when(slow, F.format_string(V.MSG_SET_TIMING_FORMAT, F.lit(float(edge_ms)), F.lit(float(target_ms))))
        .otherwise(V.MSG_SETS_MATCH)
    )
    figures = ["edge_rows", "target_rows", "edge_set", "target_set", "rows_off"]
    return sizes.select(
        *[F.col(f).cast("bigint").alias(f) for f in figures],
        kind.alias("divergence_class"), details.alias("divergence_details"),
    )


def one_sided_rows(edge: DataFrame, target: DataFrame, multiset: bool = True) -> DataFrame:
    """Rows only one side has (or has more copies of), with the side and the surplus."""
    counted = side_counts(edge, target)
    here, there = F.col("edge_copies"), F.col("target_copies")
    if multiset:
        surplus = here - there
    else:
        surplus = F.when((here > 0) & (there == 0), here).when((here == 0) & (there > 0), -there).otherwise(0)
    return counted.select(
        *edge.columns, F.when(surplus > 0, "edge").otherwise("target").alias("side"),
        F.abs(surplus).cast("bigint").alias("copies"),
    ).where("copies > 0")


def aggregate_compare(
    edge: DataFrame, target: DataFrame, key: str | Sequence[str], aggregates: dict[str, Column]
) -> DataFrame:
    """The same aggregates on both sides per key, joined, with a verdict per key."""
    keys = [key] if isinstance(key, str) else list(key)
    named = [column.alias(name) for name, column in aggregates.items()]
    a = edge.groupBy(*keys).agg(*named)
    b = target.groupBy(*keys).agg(*named)
    a = a.select(*keys, *[F.col(n).alias(f"edge_{n}") for n in aggregates], F.lit(True).alias("_e"))
    b = b.select(*keys, *[F.col(n).alias(f"target_{n}") for n in aggregates], F.lit(True).alias("_t"))
    same = F.lit(True)
    for name in aggregates:
        same = same & F.col(f"edge_{name}").eqNullSafe(F.col(f"target_{name}"))
    missing = F.col("_e").isNull() | F.col("_t").isNull()
    return (
        a.join(b, keys, "full_outer")
        .withColumn("divergence_class", F.when(missing, "A").when(~same, "B").otherwise("NONE"))
        .drop("_e", "_t")
    )


def path_report(comparisons: DataFrame, paths: Sequence[tuple[str, str]] = tuple(V.BUSINESS_PATHS)) -> DataFrame:
    """Per business path: checks, errors by class and whether it is free of class A.

    Paths nobody checked appear with zeros and count as clean.
    """
    spark = comparisons.sparkSession
    named = spark.createDataFrame(list(paths), "path_id string, path_name string")
    tallied = comparisons.groupBy("path_id").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col("divergence_class") == c).alias(f"_{c}") for c in ("A", "B", "C")],
    )
    joined = tallied.join(F.broadcast(named), "path_id", "right")  # a handful of paths

    def whole(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast("bigint")

    return joined.select(
        "path_id", "path_name", whole("_n").alias("checks_run"), whole("_A").alias("class_a_errors"),
        whole("_B").alias("class_b_errors"), whole("_C").alias("class_c_errors"),
        (whole("_A") == 0).alias("zero_class_a"),
    )


def audit_exit(comparisons: DataFrame, report: DataFrame, ts: str, start_us: int, now_us: int, hours: int = V.CLEAN_WINDOW_HOURS) -> DataFrame:
    """Audit verdict: every path clean and no class A for the whole window."""
    hit = F.when(F.col("divergence_class") == "A", epoch_us(ts))
    clock = comparisons.agg(F.max(hit).alias("_last_a")).select(
        ((F.lit(now_us) - F.greatest(F.lit(start_us), F.coalesce("_last_a", F.lit(start_us)))) / HOUR_US).alias("clean_hours")
    )
    paths = report.agg(
        F.bool_and("zero_class_a").alias("all_paths_clean"),
        F.array_join(F.sort_array(F.collect_list(F.when(~F.col("zero_class_a"), F.col("path_name")))), ",").alias("blocking_paths"),
        F.sum("checks_run").alias("total_checks"),
    )
    one = paths.withColumn("_k", F.lit(1)).join(clock.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return one.select(
        "total_checks", "all_paths_clean", "blocking_paths",
        F.round("clean_hours", 4).alias("clean_hours"),
        (F.col("all_paths_clean") & (F.col("clean_hours") >= hours)).alias("exit_criteria_met"),
    )


def clean_clock(
    comparisons: DataFrame, ts: str, tie: str, start_us: int, hours: int = V.CLEAN_WINDOW_HOURS, ranges: int | None = None
) -> DataFrame:
    """Hours since the later of start and last class A, at every comparison in time order."""
    at = epoch_us(ts)
    hit = F.when(F.col("divergence_class") == "A", at)
    scanned = running_scan(comparisons, [ts, tie], {"_last_a": ("max", hit)}, ranges=ranges)
    clean = (at - F.greatest(F.lit(start_us), F.coalesce(F.col("_last_a"), F.lit(start_us)))) / HOUR_US
    return scanned.select(
        *comparisons.columns, F.round(clean, 6).alias("clean_hours"), (clean >= hours).alias("window_complete")
    )


def schema_rows(df: DataFrame) -> DataFrame:
    """Columns of a table as rows: ordinal, name, type."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "ordinal int, name string, type string")


def schema_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Positions at which two ordered column lists (ordinal, name, type) differ."""
    left = a.select("ordinal", F.col("name").alias("left_name"), F.col("type").alias("left_type"))
    right = b.select("ordinal", F.col("name").alias("right_name"), F.col("type").alias("right_type"))
    same = F.col("left_name").eqNullSafe(F.col("right_name")) & F.col("left_type").eqNullSafe(F.col("right_type"))
    return left.join(right, "ordinal", "full_outer").where(~same)


def missing_names(expected: DataFrame, landed: DataFrame, name: str) -> DataFrame:
    """Expected names with no landed counterpart."""
    return expected.join(landed.select(name).distinct(), name, "left_anti")


def recent(df: DataFrame, n: int, *order: str, keys: Sequence[str] = ()) -> DataFrame:
    """The latest ``n`` rows, overall (a bounded top-n) or per key."""
    latest = [F.desc(o) for o in order]
    if not keys:
        return df.orderBy(*latest).limit(n)
    ranked = Window.partitionBy(*keys).orderBy(*latest)
    return df.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") <= n).drop("_rank")
