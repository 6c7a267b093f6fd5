"""Routing writes by price: who flows, who waits, what it costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgate import fixed_values as V
from driftgate.functions.clock import DAY_US, HOUR_US, epoch_us
from driftgate.operators.asof import asof_join
from driftgate.operators.prefix import running_scan
from driftgate.operators.timeline import trailing_window


def write_class(table: Column) -> Column:
    """critical or non_critical; an unknown table is critical."""
    return F.when(F.lower(table).isin(V.NON_CRITICAL_TABLES), "non_critical").otherwise("critical")


def is_spike(price: Column, baseline: Column, multiplier: float = V.SPIKE_MULTIPLIER) -> Column:
    return price / F.greatest(baseline, F.lit(0.001)) >= F.lit(multiplier)


def price_baselines(prices: DataFrame, ts: str = "ts", price: str = "price", days: int = 30, multiplier: float = V.SPIKE_MULTIPLIER) -> DataFrame:
    """Each price against the mean of the days before it, itself included."""
    averaged = trailing_window(prices, ts, days * DAY_US, {"_mean": lambda w: F.avg(price).over(w)})
    return averaged.select(
        *prices.columns, F.round("_mean", 9).alias("baseline"), is_spike(F.col(price), F.col("_mean"), multiplier).alias("spike")
    )


def route_writes(
    writes: DataFrame,
    prices: DataFrame,
    ts: str = "ts",
    price_ts: str = "price_ts",
    baseline: float = V.BASELINE_PRICE_PER_GB,
    multiplier: float = V.SPIKE_MULTIPLIER,
    deadline_us: int | None = None,
    buffer_hours: float = V.DEADLINE_BUFFER_HOURS,
) -> DataFrame:
    """Decision per write at the price in force at its time.

    Near the deadline everything flows; critical writes always flow; the others
    wait while the price is at or over the spike multiple. ``writes`` needs
    table_name and bytes, ``prices`` needs price.
    """
    priced = asof_join(writes, prices, ts, price_ts, ["price"]).withColumn(
        "price", F.coalesce("price", F.lit(baseline))
    )
    kind = write_class(F.col("table_name"))
    late = F.lit(False)
    if deadline_us is not None:
        late = epoch_us(ts) >= F.lit(deadline_us - int(buffer_hours * HOUR_US))
    decision = (
        F.when(late, "deadline_override")
        .when(kind == "critical", "flow_immediately")
        .when(is_spike(F.col("price"), F.lit(baseline), multiplier), "buffer_to_wal")
        .otherwise("flow_immediately")
    )
    return priced.withColumn("write_class", kind).withColumn("decision", decision)


def cost_units(size: Column, price: Column) -> Column:
    """Bytes times price as an exact decimal; divide the sum by 1e9 for dollars."""
    return (size.cast("decimal(18,0)") * price.cast("decimal(12,6)")).cast("decimal(30,6)")


def dollars(units: Column) -> Column:
    return units.cast("double") / F.lit(V.BYTES_PER_GB)


def drain_schedule(
    buffered: DataFrame,
    prices: DataFrame,
    ts: str = "buffered_at",
    price_ts: str = "price_ts",
    baseline: float = V.BASELINE_PRICE_PER_GB,
    multiplier: float = V.SPIKE_MULTIPLIER,
    max_age_hours: float = V.BUFFER_MAX_AGE_HOURS,
) -> DataFrame:
    """When each waiting write is flushed and at what price.

    From half the maximum age on it leaves at the first normal price, at the
    maximum age in any case.
    """
    half, full = int(max_age_hours * HOUR_US / 2), int(max_age_hours * HOUR_US)
    start = epoch_us(ts)
    eligible = buffered.withColumn("_eligible", F.timestamp_micros(start + half))
    at_half = asof_join(eligible, prices.select(price_ts, F.col("price").alias("_half_price")), "_eligible", price_ts, ["_half_price"])
    normal = prices.where(~is_spike(F.col("price"), F.lit(baseline), multiplier)).select(
        price_ts, epoch_us(price_ts).alias("_normal_us")
    )
    with_next = asof_join(at_half, normal, "_eligible", price_ts, ["_normal_us"], direction="forward")
    normal_now = ~is_spike(F.coalesce("_half_price", F.lit(baseline)), F.lit(baseline), multiplier)
    flush = F.when(normal_now, start + half).otherwise(F.least(start + full, F.coalesce("_normal_us", start + full)))
    timed = with_next.withColumn("flush_at", F.timestamp_micros(flush)).withColumn(
        "flush_reason", F.when(flush >= start + full, "max_age").otherwise("price_normal")
    )
    out = asof_join(timed, prices.select(price_ts, F.col("price").alias("flush_price")), "flush_at", price_ts, ["flush_price"])
    return out.drop("_eligible", "_half_price", "_normal_us").withColumn(
        "flush_price", F.coalesce("flush_price", F.lit(baseline))
    )


def running_cost(
    priced: DataFrame, order: list[str], estimate_usd: float = V.P50_ESTIMATE_USD, factor: float = V.OVERRUN_FACTOR
) -> DataFrame:
    """Cost so far at every write in time order, and whether it is over the allowance."""
    scanned = running_scan(priced, order, {"_units": ("sum", cost_units(F.col("bytes"), F.col("price")))})
    cost = dollars(F.col("_units"))
    return scanned.select(
        *priced.columns, F.round(cost, 9).alias("cost_so_far_usd"), (cost > estimate_usd * factor).alias("over_budget")
    )


def first_overrun(costed: DataFrame, ts: str) -> DataFrame:
    return costed.where("over_budget").agg(F.min(ts).alias("first_overrun_at"), F.count(F.lit(1)).alias("writes_over_budget"))


def egress_meter(
    routed: DataFrame,
    elapsed_hours: float,
    current_price: float,
    deadline_hours: float = V.MIGRATION_DEADLINE_HOURS,
    baseline: float = V.BASELINE_PRICE_PER_GB,
    multiplier: float = V.SPIKE_MULTIPLIER,
) -> DataFrame:
    """Bytes and cost of the writes that flowed, projected to the deadline."""
    flowed = routed.where("decision <> 'buffer_to_wal'").agg(
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes_transferred"),
        F.coalesce(F.sum(cost_units(F.col("bytes"), F.col("price"))), F.lit(0)).alias("_units"),
    )
    projected = F.col("bytes_transferred") / F.lit(float(elapsed_hours)) * F.lit(float(deadline_hours))
    return flowed.select(
        F.col("bytes_transferred").cast("bigint"), F.round(dollars(F.col("_units")), 9).alias("cost_usd"),
        F.round(projected / F.lit(V.BYTES_PER_GB) * F.lit(current_price), 6).alias("projected_total_usd"),
        F.round(F.lit(current_price / max(baseline, 0.001)), 6).alias("spike_multiplier"),
        F.lit(current_price >= baseline * multiplier).alias("is_spike"),
    )


def buffer_status(
    routed: DataFrame, now_us: int, ts: str = "ts", flushed: DataFrame | None = None, key: str | None = None,
    baseline: float = V.BASELINE_PRICE_PER_GB,
) -> DataFrame:
    """Size and oldest age of the buffer, and the savings of everything ever buffered.

    ``flushed`` (matched on ``key``) lists entries that have left it.
    """
    waiting = routed.where("decision = 'buffer_to_wal'")
    if flushed is not None:
        waiting = waiting.join(flushed.select(key, F.lit(True).alias("_gone")), key, "left")
    else:
        waiting = waiting.withColumn("_gone", F.lit(None).cast("boolean"))
    inside = F.col("_gone").isNull()
    saved = cost_units(F.col("bytes"), F.col("price")) - cost_units(F.col("bytes"), F.lit(baseline))
    oldest = F.min(F.when(inside, epoch_us(ts)))
    return waiting.agg(
        F.coalesce(F.count_if(inside), F.lit(0)).alias("buffer_size"),
        F.round(F.coalesce((F.lit(now_us) - oldest) / F.lit(float(HOUR_US)), F.lit(0.0)), 3).alias("oldest_age_hours"),
        F.round(F.coalesce(dollars(F.sum(saved)), F.lit(0.0)), 9).alias("savings_usd"),
    )


def cost_status(meter: DataFrame, buffer: DataFrame, now_us: int, deadline_us: int, buffer_hours: float = V.DEADLINE_BUFFER_HOURS) -> DataFrame:
    """Meter and buffer side by side, with the deadline flag."""
    near = now_us >= deadline_us - int(buffer_hours * HOUR_US)
    one = meter.withColumn("_k", F.lit(1)).join(buffer.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return one.withColumn("cost_optimization_active", F.lit(not near)).withColumn("deadline_override_active", F.lit(near))
