"""Exactly-once application of a change stream to a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgate import fixed_values as V


def with_event_id(events: DataFrame, pk: Sequence[str] = (), id_mode: str = "row") -> DataFrame:
    """Add ``event_id``.

    ``row`` identifies one row change inside a transaction (transaction, table,
    key, op); ``gtid`` takes the transaction alone, so later rows of the same
    transaction count as repeats.
    """
    if id_mode == "gtid":
        return events.withColumn("event_id", F.col("gtid"))
    if id_mode != "row":
        raise ValueError(id_mode)
    image = F.coalesce(F.col("after"), F.col("before"))
    if pk:
        key = F.concat_ws(",", *[F.coalesce(F.try_element_at(image, F.lit(k)), F.lit("\\N")) for k in pk])
    else:
        key = F.coalesce(F.to_json(image), F.lit(""))
    return events.withColumn("event_id", F.concat_ws("|", "gtid", "table_name", key, "op"))


def first_deliveries(events: DataFrame) -> DataFrame:
    """The first delivery of every event id, by partition and offset.

    The limit of one row per id is applied before the shuffle as well, so an id
    delivered a million times is reduced where it is read.
    """
    delivered = Window.partitionBy("event_id").orderBy("partition", "offset")
    return events.withColumn("_delivery", F.row_number().over(delivered)).where("_delivery = 1").drop("_delivery")


def dedup_batch(events: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Events neither repeated in the batch nor applied before."""
    fresh = first_deliveries(events)
    return fresh if ledger is None else fresh.join(_sorted_by_id(ledger.select("event_id")), "event_id", "left_anti")


def _sorted_by_id(rows: DataFrame) -> DataFrame:
    """``rows`` for a join on event_id that merges: Spark takes a log for as small as the file it is derived from, and would broadcast it."""
    return rows.hint("merge")


def ledger_rows(applied: DataFrame, applied_at: Column) -> DataFrame:
    return applied.select(
        "event_id", applied_at.alias("applied_at"), "table_name", "op", F.to_date(applied_at).alias("applied_on")
    )


def purge_ledger(ledger: DataFrame, now: Column, days: int = V.LEDGER_DAYS) -> DataFrame:
    """Entries young enough to keep; on a date-partitioned ledger this prunes folders."""
    return ledger.where(F.col("applied_at") >= now - F.make_interval(days=F.lit(days)))


def _typed(value: Column, kind) -> Column:
    return value.cast(kind)


def net_changes(events: DataFrame, pk: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Net effect per key: last op, and per column the last value written since the last delete.

    An update that changes the key becomes a delete of the old key and a write of
    the new one. Images may be partial. Everything is a maximum over the commit
    order (ts_ms, partition, offset), so a key with millions of changes is
    combined on the map side. Key parts are compared null-safe by their text.
    """
    def key_of(image: Column) -> list[Column]:
        return [F.try_element_at(image, F.lit(k)) for k in pk]

    before, after = F.col("before"), F.col("after")
    deletes = F.col("op") == "d"
    moved = F.lit(False)
    for old, new in zip(key_of(before), key_of(after), strict=True):
        moved = moved | ~old.eqNullSafe(new)
    moved = (F.col("op") == "u") & before.isNotNull() & after.isNotNull() & moved

    def step(image: Column, removes: bool) -> Column:
        return F.struct(image.alias("image"), F.lit(removes).alias("removes"))

    steps = (
        F.when(deletes, F.array(step(before, True)))
        .when(moved, F.array(step(before, True), step(after, False)))
        .otherwise(F.array(step(after, False)))
    )
    order = F.struct("ts_ms", "partition", "offset")
    flat = events.select(order.alias("_order"), F.posexplode(steps).alias("_step", "_change")).where(
        "_change.image is not null"
    )
    image = F.col("_change.image")
    staged = flat.select(
        *[part.alias(f"_pk_{k}") for k, part in zip(pk, key_of(image), strict=True)],
        F.struct("_order", "_step").alias("_order"), F.col("_change.removes").alias("_removes"), image.alias("_image"),
    )
    written = []
    for name in columns:
        has = ~F.col("_removes") & F.map_contains_key("_image", F.lit(name))
        last = F.max(F.when(has, F.struct(F.col("_order").alias("at"), F.try_element_at("_image", F.lit(name)).alias("v"))))
        written.append(last.alias(f"_w_{name}"))
    grouped = staged.groupBy(*[f"_pk_{k}" for k in pk]).agg(
        F.max(F.when(F.col("_removes"), F.col("_order"))).alias("_deleted_at"),
        F.max(F.when(~F.col("_removes"), F.col("_order"))).alias("_written_at"),
        *written,
    )
    gone = F.col("_deleted_at").isNotNull()
    alive = F.col("_written_at").isNotNull() & (~gone | (F.col("_written_at") > F.col("_deleted_at")))
    results = []
    for name in columns:
        at = F.col(f"_w_{name}")["at"]
        fresh = at.isNotNull() & (~gone | (at > F.col("_deleted_at")))
        results.append(F.when(fresh, F.struct(F.col(f"_w_{name}")["v"].alias("v"))).alias(f"_set_{name}"))
    return grouped.select(*[f"_pk_{k}" for k in pk], alive.alias("_alive"), gone.alias("_reset"), *results)


def apply_changes(target: DataFrame, events: DataFrame, pk: str | Sequence[str]) -> DataFrame:
    """The target after all events: upserts by key, deletes by the key of the before image.

    Columns an event does not mention keep their value. One full outer join on
    the key; both sides have each key once, so nothing can skew.
    """
    keys = [pk] if isinstance(pk, str) else list(pk)
    columns = [c for c in target.columns if c not in keys]
    kinds = {f.name: f.dataType for f in target.schema.fields}
    changes = net_changes(events, keys, columns).select(
        *[F.col(f"_pk_{k}").cast(kinds[k]).alias(f"_pk_{k}") for k in keys],
        "_alive", "_reset", *[f"_set_{c}" for c in columns],
    )
    held = target.withColumn("_held", F.lit(True))
    on = F.lit(True)
    for key in keys:
        on = on & (F.col(key) == F.col(f"_pk_{key}") if len(keys) == 1 else F.col(key).eqNullSafe(F.col(f"_pk_{key}")))
    joined = held.join(changes, on, "full_outer").where("_alive is null or _alive")
    keep = F.col("_held").isNotNull() & ~F.coalesce("_reset", F.lit(False))
    return joined.select(
        *[
            (
                F.coalesce(F.col(c), F.col(f"_pk_{c}"))
                if c in keys
                else F.when(F.col(f"_set_{c}").isNotNull(), _typed(F.col(f"_set_{c}")["v"], kinds[c])).when(keep, F.col(c))
            ).alias(c)
            for c in target.columns
        ]
    )


def apply_outcomes(events: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Every delivery with its outcome: applied or deduplicated."""
    firsts = events.groupBy("event_id").agg(F.min(F.struct("partition", "offset")).alias("_first"))
    if ledger is not None:
        firsts = firsts.join(_sorted_by_id(ledger.select("event_id", F.lit(True).alias("_seen"))), "event_id", "left")
    else:
        firsts = firsts.withColumn("_seen", F.lit(None).cast("boolean"))
    tagged = events.join(_sorted_by_id(firsts), "event_id")
    fresh = F.col("_seen").isNull() & (F.struct("partition", "offset") == F.col("_first"))
    return tagged.withColumn("outcome", F.when(fresh, "applied").otherwise("deduplicated")).drop("_first", "_seen")


def sink_counters(parsed: DataFrame, pk: Sequence[str] = (), id_mode: str = "row", ledger: DataFrame | None = None) -> DataFrame:
    """One row of counts: processed, deduplicated, dead letters, dropped, last position.

    Counts come from one grouping by event id, so no delivery is joined back.
    """
    shapes = parsed.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    per_shape = shapes.agg(
        F.coalesce(F.sum(F.when(F.col("status") == "corrupt", F.col("n"))), F.lit(0)).alias("events_dlq"),
        F.coalesce(F.sum(F.when(F.col("status") == "tombstone", F.col("n"))), F.lit(0)).alias("tombstones"),
    )
    ids = with_event_id(parsed.where("status = 'event'"), pk, id_mode).groupBy("event_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("ts_ms", "offset", "gtid")).alias("latest")
    )
    if ledger is not None:
        ids = ids.join(_sorted_by_id(ledger.select("event_id", F.lit(1).alias("_seen"))), "event_id", "left")
    else:
        ids = ids.withColumn("_seen", F.lit(None).cast("int"))
    fresh = F.col("_seen").isNull()
    per_id = ids.agg(
        F.coalesce(F.count_if(fresh), F.lit(0)).alias("events_processed"),
        F.coalesce(F.sum(F.when(fresh, F.col("n") - 1).otherwise(F.col("n"))), F.lit(0)).alias("events_deduplicated"),
        F.max(F.when(fresh, F.col("latest"))).alias("_latest"),
    )
    one = per_id.withColumn("_k", F.lit(1)).join(per_shape.withColumn("_k", F.lit(1)), "_k")
    return one.select(
        "events_processed", "events_deduplicated", "events_dlq", "tombstones",
        F.col("_latest.gtid").alias("last_gtid"), F.col("_latest.ts_ms").alias("last_event_ts_ms"),
    )


def idempotency_audit(target: DataFrame, events: DataFrame, pk: str | Sequence[str]) -> DataFrame:
    """Deliver a batch twice: rows per key and ledger entries per id must stay one."""
    keys = [pk] if isinstance(pk, str) else list(pk)
    twice = events.unionByName(events)
    landed = apply_changes(target, dedup_batch(twice), keys).groupBy(*keys).count()
    claimed = dedup_batch(twice).groupBy("event_id").count()
    rows = landed.agg(F.coalesce(F.max("count"), F.lit(0)).alias("most_rows_per_key"), F.count(F.lit(1)).alias("keys"))
    ids = claimed.agg(F.coalesce(F.max("count"), F.lit(0)).alias("most_entries_per_id"), F.count(F.lit(1)).alias("ids"))
    one = rows.withColumn("_k", F.lit(1)).join(ids.withColumn("_k", F.lit(1)), "_k").drop("_k")
    passed = (F.col("most_rows_per_key") <= 1) & (F.col("most_entries_per_id") <= 1)
    return one.withColumn("passed", passed)
