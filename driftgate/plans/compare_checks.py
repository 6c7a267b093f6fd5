"""Source against target on two copies of orders and their aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgate import fixed_values as V
from driftgate.functions.clock import instant_us
from driftgate.functions.rows import row_diff
from driftgate.operators import compare
from driftgate.plans.inputs import (
    EDGE_SQL, TARGET_SQL, TOUCHED_SQL, edge_orders, target_orders, touched_orders, uniform_sql,
)
from driftgate.plans.registry import check, table

_COLUMNS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_HARD = " OR ".join(
    f"(nullif(CAST(e.{c} AS VARCHAR), '') IS DISTINCT FROM nullif(CAST(t.{c} AS VARCHAR), ''))" for c in _COLUMNS
)
_SOFT = "e.o_orderpriority IS DISTINCT FROM t.o_orderpriority"


def compared_sql(soft: bool = True, sample: str = "TRUE") -> str:
    soft_line = f"WHEN w.operation <> 'DELETE' AND {_SOFT} THEN 'B'" if soft else ""
    return f"""{EDGE_SQL}, {TARGET_SQL}, {TOUCHED_SQL}, compared AS (
      SELECT w.o_orderkey, w.operation, w.edge_ms, w.target_ms,
        CASE WHEN NOT ({sample}) THEN 'NONE'
             WHEN w.operation = 'DELETE' AND e.o_orderkey IS NULL AND t.o_orderkey IS NULL THEN 'NONE'
             WHEN w.operation = 'DELETE' AND e.o_orderkey IS NULL THEN 'A'
             WHEN w.operation = 'DELETE' AND t.o_orderkey IS NULL THEN 'B'
             WHEN w.operation <> 'DELETE' AND e.o_orderkey IS NULL AND t.o_orderkey IS NULL THEN 'B'
             WHEN w.operation <> 'DELETE' AND t.o_orderkey IS NULL THEN 'A'
             WHEN w.operation <> 'DELETE' AND e.o_orderkey IS NULL THEN 'B'
             WHEN w.operation <> 'DELETE' AND ({_HARD}) THEN 'A'
             {soft_line}
             WHEN w.edge_ms > 0 AND w.target_ms > 2 * w.edge_ms THEN 'C'
             ELSE 'NONE' END AS divergence_class,
        e.o_orderstatus AS edge_status, t.o_orderstatus AS target_status
      FROM touched w LEFT JOIN edge e ON w.o_orderkey = e.o_orderkey LEFT JOIN target t ON w.o_orderkey = t.o_orderkey)"""


TALLY_SQL = """count(*) AS total_comparisons, count(*) FILTER (divergence_class = 'A') AS class_a,
       count(*) FILTER (divergence_class = 'B') AS class_b, count(*) FILTER (divergence_class = 'C') AS class_c,
       round(CAST(count(*) FILTER (divergence_class IN ('A', 'B')) AS DOUBLE) / count(*), 6) AS error_rate"""


def compared(spark, folder, **options) -> DataFrame:
    return compare.shadow_compare(
        edge_orders(spark, folder), target_orders(spark, folder), "o_orderkey",
        touched_orders(spark, folder), table="orders", critical=["Orders"], **options,
    )


@check("agg9_shadow_tallies", f"WITH {compared_sql()} SELECT operation, {TALLY_SQL} FROM compared GROUP BY operation")
def shadow_tallies(spark, folder) -> DataFrame:
    """The flagship: compare every touched row on both sides and tally the classes."""
    return compare.audit_tallies(compared(spark, folder), ["operation"])


@check(
    "joi1_shadow_compare",
    f"WITH {compared_sql()} SELECT o_orderkey, operation, edge_ms, target_ms, divergence_class FROM compared",
)
def shadow_compare(spark, folder) -> DataFrame:
    return compared(spark, folder).select("o_orderkey", "operation", "edge_ms", "target_ms", "divergence_class")


@check(
    "joi1_shadow_compare_full",
    f"""WITH {EDGE_SQL}, {TARGET_SQL}
        SELECT CASE WHEN t.o_orderkey IS NULL THEN 'A' WHEN e.o_orderkey IS NULL THEN 'B' WHEN {_HARD} THEN 'A'
                    ELSE 'NONE' END AS divergence_class, count(*) AS n_rows
        FROM edge e FULL OUTER JOIN target t ON e.o_orderkey = t.o_orderkey GROUP BY 1""",
)
def shadow_compare_full(spark, folder) -> DataFrame:
    """Whole-table mode: no list of touched keys, null and empty text equal."""
    all_rows = compare.shadow_compare(
        edge_orders(spark, folder), target_orders(spark, folder), "o_orderkey", soft_null=False
    )
    return all_rows.groupBy("divergence_class").agg(F.count(F.lit(1)).alias("n_rows"))


@check(
    "prj9_row_diff",
    f"""WITH {EDGE_SQL}, {TARGET_SQL}
        SELECT e.o_orderkey, concat_ws(',',
            CASE WHEN e.o_orderpriority IS DISTINCT FROM t.o_orderpriority THEN 'o_orderpriority' END,
            CASE WHEN e.o_orderstatus IS DISTINCT FROM t.o_orderstatus THEN 'o_orderstatus' END) AS strict_columns,
            concat_ws(',', CASE WHEN e.o_orderstatus IS DISTINCT FROM t.o_orderstatus THEN 'o_orderstatus' END) AS columns,
            CASE WHEN e.o_orderstatus IS DISTINCT FROM t.o_orderstatus THEN e.o_orderstatus END AS edge_status,
            CASE WHEN e.o_orderstatus IS DISTINCT FROM t.o_orderstatus THEN t.o_orderstatus END AS target_status
        FROM edge e JOIN target t ON e.o_orderkey = t.o_orderkey""",
)
def diff_columns(spark, folder) -> DataFrame:
    edge, target = edge_orders(spark, folder).alias("e"), target_orders(spark, folder).alias("t")
    left = {c: (F.col(f"e.{c}"), edge.schema[c].dataType) for c in _COLUMNS}
    right = {c: (F.col(f"t.{c}"), target.schema[c].dataType) for c in _COLUMNS}
    both = edge.join(target, F.col("e.o_orderkey") == F.col("t.o_orderkey"))
    loose, strict = row_diff(left, right), row_diff(left, right, blank_is_null=False)
    return both.select(F.col("e.o_orderkey").alias("o_orderkey"), loose.alias("l"), strict.alias("s")).select(
        "o_orderkey", F.array_join(F.map_keys("s"), ",").alias("strict_columns"),
        F.array_join(F.map_keys("l"), ",").alias("columns"),
        F.try_element_at("l", F.lit("o_orderstatus"))["edge"].alias("edge_status"),
        F.try_element_at("l", F.lit("o_orderstatus"))["target"].alias("target_status"),
    )


@check(
    "prj10_divergence_details",
    f"""WITH {compared_sql()}
        SELECT o_orderkey, divergence_class, CASE
            WHEN divergence_class = 'C' THEN format('target P99 latency {{:.1f}}ms > 2× edge {{:.1f}}ms', target_ms, edge_ms)
            WHEN operation = 'DELETE' AND divergence_class = 'A' THEN '{V.MSG_DELETE_LEFT_ON_TARGET}'
            WHEN operation = 'DELETE' AND divergence_class = 'B' THEN '{V.MSG_DELETE_EDGE_ONLY}'
            WHEN operation = 'DELETE' AND edge_status IS NULL THEN '{V.MSG_BOTH_DELETED}'
            WHEN divergence_class = 'NONE' THEN '{V.MSG_NO_DIVERGENCE}'
            WHEN divergence_class = 'A' AND target_status IS NULL THEN '{V.MSG_MISSING_ON_TARGET}'
            WHEN divergence_class = 'B' AND edge_status IS NULL AND target_status IS NULL THEN '{V.MSG_BOTH_MISSING}'
            WHEN divergence_class = 'B' AND edge_status IS NULL THEN '{V.MSG_MISSING_ON_EDGE}'
            WHEN divergence_class = 'B' THEN '{V.MSG_SOFT_NULL}'
            ELSE '{V.MSG_VALUES_PREFIX}{{"o_orderstatus":{{"edge":"' || edge_status || '","target":"' || target_status || '"}}}}'
            END AS divergence_details
        FROM compared""",
)
def divergence_details(spark, folder) -> DataFrame:
    return compared(spark, folder).select("o_orderkey", "divergence_class", "divergence_details")


@check(
    "prj11_timing_divergence",
    f"""WITH {compared_sql(soft=False)} SELECT CAST(target_ms / edge_ms AS BIGINT) AS slowdown, divergence_class, count(*) AS n_rows
        FROM compared GROUP BY 1, 2""",
)
def timing_divergence(spark, folder) -> DataFrame:
    rows = compared(spark, folder, soft_null=False)
    return rows.groupBy((F.col("target_ms") / F.col("edge_ms")).cast("bigint").alias("slowdown"), "divergence_class").agg(
        F.count(F.lit(1)).alias("n_rows")
    )


@check(
    "prj12_critical_path",
    f"""WITH named AS (SELECT event_id, CASE event_type WHEN 'purchase' THEN 'Payments' WHEN 'signup' THEN 'Users'
                       ELSE event_type END AS t FROM events)
        SELECT t AS table_name, lower(t) IN ('payments', 'users') AS critical_path, count(*) AS n_rows FROM named GROUP BY 1, 2""",
)
def critical_path(spark, folder) -> DataFrame:
    kind = F.col("event_type")
    name = F.when(kind == "purchase", "Payments").when(kind == "signup", "Users").otherwise(kind)
    return (
        table(spark, folder, "events")
        .select(name.alias("table_name"), compare.is_critical_path(name, ["payments", "users"]).alias("critical_path"))
        .groupBy("table_name", "critical_path").agg(F.count(F.lit(1)).alias("n_rows"))
    )


_RATE = 0.25


@check(
    "prj14_sampled_compare",
    f"""WITH {compared_sql(sample=f"{uniform_sql('CAST(w.o_orderkey AS VARCHAR)')} < {_RATE}")}
        SELECT operation, {TALLY_SQL} FROM compared GROUP BY operation""",
)
def sampled_compare(spark, folder) -> DataFrame:
    """The feature is sampling: a quarter of the writes is compared, the rest counts as NONE."""
    return compare.audit_tallies(compared(spark, folder, sample_rate=_RATE), ["operation"])


_RESULTS_SQL = """e AS (SELECT o_custkey, o_orderstatus, o_orderpriority FROM edge),
                  t AS (SELECT o_custkey, o_orderstatus, o_orderpriority FROM target)"""


@check(
    "set1_compare_results",
    f"""WITH {EDGE_SQL}, {TARGET_SQL}, {_RESULTS_SQL},
        es AS (SELECT DISTINCT * FROM e), ts AS (SELECT DISTINCT * FROM t),
        off AS (SELECT (SELECT count(*) FROM (SELECT * FROM es EXCEPT SELECT * FROM ts))
                     + (SELECT count(*) FROM (SELECT * FROM ts EXCEPT SELECT * FROM es)) AS n),
        sizes AS (SELECT (SELECT count(*) FROM e) AS edge_rows, (SELECT count(*) FROM t) AS target_rows,
                         (SELECT count(*) FROM es) AS edge_set, (SELECT count(*) FROM ts) AS target_set, n AS rows_off FROM off)
        SELECT edge_rows, target_rows, edge_set, target_set, CAST(rows_off AS BIGINT) AS rows_off,
               CASE WHEN edge_set <> target_set THEN 'A' WHEN rows_off > 0 THEN 'B' ELSE 'NONE' END AS divergence_class,
               CASE WHEN edge_set <> target_set THEN format('row count mismatch: edge={{}} target={{}}', edge_set, target_set)
                    WHEN rows_off > 0 THEN '{V.MSG_SET_VALUES}' ELSE '{V.MSG_SETS_MATCH}' END AS divergence_details
        FROM sizes""",
)
def compare_results(spark, folder) -> DataFrame:
    names = ["o_custkey", "o_orderstatus", "o_orderpriority"]
    return compare.compare_results(edge_orders(spark, folder).select(*names), target_orders(spark, folder).select(*names))


@check(
    "set1_compare_results_multiset",
    f"""WITH {EDGE_SQL}, {TARGET_SQL}, {_RESULTS_SQL},
        off AS (SELECT (SELECT count(*) FROM (SELECT * FROM e EXCEPT ALL SELECT * FROM t))
                     + (SELECT count(*) FROM (SELECT * FROM t EXCEPT ALL SELECT * FROM e)) AS n)
        SELECT (SELECT count(*) FROM e) AS edge_rows, (SELECT count(*) FROM t) AS target_rows, CAST(n AS BIGINT) AS rows_off FROM off""",
)
def compare_multisets(spark, folder) -> DataFrame:
    names = ["o_custkey", "o_orderstatus", "o_orderpriority"]
    return compare.compare_results(
        edge_orders(spark, folder).select(*names), target_orders(spark, folder).select(*names), multiset=True
    ).select("edge_rows", "target_rows", "rows_off")


@check(
    "set2_one_sided_rows",
    f"""WITH {EDGE_SQL}, {TARGET_SQL}, {_RESULTS_SQL}
        SELECT o_custkey, o_orderstatus, o_orderpriority, 'edge' AS side, count(*) AS copies
        FROM (SELECT * FROM e EXCEPT ALL SELECT * FROM t) GROUP BY ALL
        UNION ALL
        SELECT o_custkey, o_orderstatus, o_orderpriority, 'target', count(*)
        FROM (SELECT * FROM t EXCEPT ALL SELECT * FROM e) GROUP BY ALL""",
)
def one_sided_rows(spark, folder) -> DataFrame:
    names = ["o_custkey", "o_orderstatus", "o_orderpriority"]
    return compare.one_sided_rows(edge_orders(spark, folder).select(*names), target_orders(spark, folder).select(*names))


_LINE_TARGET_SQL = """lt AS (SELECT l_partkey, CASE WHEN l_orderkey % 401 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity
                     FROM lineitem WHERE l_partkey % 211 <> 0)"""


def _review_aggs(column: str = "l_quantity"):
    return {
        "review_count": F.count(F.lit(1)),
        "avg_rating": F.round(F.avg(column), 4),
        "max_rating": F.max(column),
        "min_rating": F.min(column),
    }


def line_target(spark, folder) -> DataFrame:
    rows = table(spark, folder, "lineitem").where(F.col("l_partkey") % 211 != 0)
    bumped = F.when(F.col("l_orderkey") % 401 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    return rows.select("l_partkey", bumped.alias("l_quantity"))


_AGG = """count(*) AS n, round(avg(l_quantity), 4) AS a, max(l_quantity) AS x, min(l_quantity) AS m"""


@check(
    "agg8_review_aggregates",
    f"""WITH {_LINE_TARGET_SQL},
        e AS (SELECT l_partkey, {_AGG} FROM lineitem GROUP BY 1), t AS (SELECT l_partkey, {_AGG} FROM lt GROUP BY 1)
        SELECT coalesce(e.l_partkey, t.l_partkey) AS l_partkey, e.n AS edge_review_count, e.a AS edge_avg_rating,
               e.x AS edge_max_rating, e.m AS edge_min_rating, t.n AS target_review_count, t.a AS target_avg_rating,
               t.x AS target_max_rating, t.m AS target_min_rating,
               CASE WHEN e.n IS NULL OR t.n IS NULL THEN 'A' WHEN (e.n, e.a, e.x, e.m) IS DISTINCT FROM (t.n, t.a, t.x, t.m)
                    THEN 'B' ELSE 'NONE' END AS divergence_class
        FROM e FULL OUTER JOIN t ON e.l_partkey = t.l_partkey""",
)
def review_aggregates(spark, folder) -> DataFrame:
    return compare.aggregate_compare(
        table(spark, folder, "lineitem"), line_target(spark, folder), "l_partkey", _review_aggs()
    )


_AVAILABLE = "o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'"


@check(
    "prj32_availability_compare",
    f"""WITH {EDGE_SQL}, {TARGET_SQL},
        e AS (SELECT DISTINCT o_orderkey, o_custkey FROM edge WHERE {_AVAILABLE}),
        t AS (SELECT DISTINCT o_orderkey, o_custkey FROM target WHERE {_AVAILABLE})
        SELECT (SELECT count(*) FROM e) AS edge_rows, (SELECT count(*) FROM t) AS target_rows,
               CASE WHEN (SELECT count(*) FROM e) <> (SELECT count(*) FROM t) THEN 'A'
                    WHEN EXISTS (SELECT * FROM e EXCEPT SELECT * FROM t) THEN 'B' ELSE 'NONE' END AS divergence_class""",
)
def availability_compare(spark, folder) -> DataFrame:
    def available(df: DataFrame) -> DataFrame:
        day = F.col("o_orderdate")
        inside = (F.col("o_orderstatus") == "O") & (day >= F.to_timestamp_ntz(F.lit("1996-01-01 00:00:00"))) & (
            day < F.to_timestamp_ntz(F.lit("1997-01-01 00:00:00"))
        )
        return df.where(inside).select("o_orderkey", "o_custkey")

    return compare.compare_results(
        available(edge_orders(spark, folder)), available(target_orders(spark, folder))
    ).select("edge_rows", "target_rows", "divergence_class")


_SEARCH = "p_brand = 'Brand#7' AND p_size >= 10"
_PART_TARGET = "(SELECT * FROM part WHERE p_partkey % 13 <> 0)"


@check(
    "srt3_search_ranking",
    f"""SELECT 'edge' AS side, p_partkey FROM (SELECT p_partkey FROM part WHERE {_SEARCH} ORDER BY p_partkey LIMIT 20)
        UNION ALL
        SELECT 'target', p_partkey FROM (SELECT p_partkey FROM {_PART_TARGET} WHERE {_SEARCH} ORDER BY p_partkey LIMIT 20)""",
)
def search_ranking(spark, folder) -> DataFrame:
    """A top-k report: the first matches by key on each side."""
    part = table(spark, folder, "part")
    wanted = (F.col("p_brand") == "Brand#7") & (F.col("p_size") >= 10)

    def first_page(df: DataFrame, side: str) -> DataFrame:
        return df.where(wanted).select("p_partkey").orderBy("p_partkey").limit(20).select(F.lit(side).alias("side"), "p_partkey")

    return first_page(part, "edge").unionByName(first_page(part.where(F.col("p_partkey") % 13 != 0), "target"))


_PATH_SQL = "CASE w.o_orderkey % 4 WHEN 0 THEN 'PATH-001' WHEN 1 THEN 'PATH-002' WHEN 2 THEN 'PATH-003' ELSE 'PATH-005' END"


def _with_path(rows: DataFrame) -> DataFrame:
    slot = F.col("o_orderkey") % 4
    path = F.when(slot == 0, "PATH-001").when(slot == 1, "PATH-002").when(slot == 2, "PATH-003").otherwise("PATH-005")
    return rows.withColumn("path_id", path)


_REPORT_SQL = f"""{compared_sql()}, names AS (SELECT * FROM (VALUES {', '.join(f"('{i}', '{n}')" for i, n in V.BUSINESS_PATHS)}) v(path_id, path_name)),
    tagged AS (SELECT *, {_PATH_SQL.replace('w.', '')} AS path_id FROM compared),
    report AS (SELECT n.path_id, n.path_name, count(c.o_orderkey) AS checks_run,
        count(*) FILTER (c.divergence_class = 'A') AS class_a_errors, count(*) FILTER (c.divergence_class = 'B') AS class_b_errors,
        count(*) FILTER (c.divergence_class = 'C') AS class_c_errors, count(*) FILTER (c.divergence_class = 'A') = 0 AS zero_class_a
        FROM names n LEFT JOIN tagged c ON n.path_id = c.path_id GROUP BY 1, 2)"""


@check("agg10_path_report", f"WITH {_REPORT_SQL} SELECT * FROM report")
def path_report(spark, folder) -> DataFrame:
    return compare.path_report(_with_path(compared(spark, folder)))


_NOW = "2002-06-01T00:00:00"
_START = "1995-01-01T00:00:00"


@check(
    "gat5_audit_exit",
    f"""WITH {_REPORT_SQL},
        clock AS (SELECT max(o.o_orderdate) AS last_a FROM tagged c JOIN orders o ON o.o_orderkey = c.o_orderkey WHERE divergence_class = 'A')
        SELECT CAST(sum(checks_run) AS BIGINT) AS total_checks, bool_and(zero_class_a) AS all_paths_clean,
               coalesce(string_agg(path_name, ',' ORDER BY path_name) FILTER (NOT zero_class_a), '') AS blocking_paths,
               round(CAST(epoch_us(TIMESTAMP '{_NOW.replace('T', ' ')}') - greatest(epoch_us(TIMESTAMP '{_START.replace('T', ' ')}'),
                     (SELECT epoch_us(last_a) FROM clock)) AS DOUBLE) / 3600000000, 4) AS clean_hours,
               bool_and(zero_class_a) AND FALSE AS exit_criteria_met
        FROM report""",
)
def audit_exit(spark, folder) -> DataFrame:
    dates = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    rows = _with_path(compared(spark, folder)).join(dates, "o_orderkey", "left")
    return compare.audit_exit(
        rows, compare.path_report(rows), "o_orderdate", instant_us(_START), instant_us(_NOW)
    )


CLOCK_START = instant_us(_START)


@check(
    "win7_clean_clock",
    f"""WITH {compared_sql()}, timed AS (SELECT c.*, o.o_orderdate FROM compared c JOIN orders o ON o.o_orderkey = c.o_orderkey),
        run AS (SELECT o_orderkey, epoch_us(o_orderdate) AS moment,
                       max(CASE WHEN divergence_class = 'A' THEN epoch_us(o_orderdate) END)
                         OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS last_a FROM timed)
        SELECT o_orderkey, round(CAST(moment - greatest(epoch_us(TIMESTAMP '{_START.replace('T', ' ')}'),
                   coalesce(last_a, 0)) AS DOUBLE) / 3600000000, 6) AS clean_hours,
               moment - greatest(epoch_us(TIMESTAMP '{_START.replace('T', ' ')}'), coalesce(last_a, 0)) >= 72 * 3600000000 AS window_complete
        FROM run""",
)
def clean_clock(spark, folder) -> DataFrame:
    dates = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    rows = compared(spark, folder).join(dates, "o_orderkey").select("o_orderkey", "o_orderdate", "divergence_class")
    return compare.clean_clock(rows, "o_orderdate", "o_orderkey", instant_us(_START)).select(
        "o_orderkey", "clean_hours", "window_complete"
    )


@check(
    "win15_recent_history",
    f"""WITH {compared_sql()} SELECT divergence_class, o_orderkey
        FROM (SELECT divergence_class, o_orderkey, row_number() OVER (PARTITION BY divergence_class ORDER BY o_orderkey DESC) AS r FROM compared)
        WHERE r <= 100""",
)
def recent_history(spark, folder) -> DataFrame:
    """A top-k report: the hundred latest comparisons of each class."""
    return compare.recent(
        compared(spark, folder).select("divergence_class", "o_orderkey"), 100, "o_orderkey", keys=["divergence_class"]
    )
