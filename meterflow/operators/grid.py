"""Irregular readings onto a regular grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import period
from .dedup import measurements

SLOT_S = 900
DAY_SLOTS = 96


def regular_grid(events: DataFrame, slot_s: int = SLOT_S, max_gap_slots: int = 8) -> DataFrame:
    """One row per meter and slot between its first and last usable reading.

    Usable: ``energy_kwh_total`` not null and ``opc_status`` not ``Bad`` (a null status is usable). Readings are first
    aggregated per (meter, slot) with map-side combine: number, and the counter of the last one (ties: the larger
    counter). What is left per meter is bounded by the calendar, however many readings it has; the slots of a meter
    are generated as a sequence, left-joined to the aggregates on (meter, slot), which is evenly spread, and the last
    observation is carried forward over at most ``max_gap_slots`` slots.

    Columns: ``meter``, ``slot_epoch``, ``readings``, ``energy_kwh_total``, ``status`` (observed, filled, missing).
    Meters without a usable reading have no grid; a meter with one usable slot has one row. NaN counters count as
    readings and are carried as they are.
    """
    usable = measurements(events, "energy_kwh_total", "opc_status").where(
        F.col("energy_kwh_total").isNotNull() & (F.coalesce("opc_status", F.lit("")) != "Bad")
    )
    us, width = F.unix_micros("ts_source"), slot_s * 1_000_000
    slots = usable.select(
        "meter", period(us, width).alias("slot"), us.alias("us"), "energy_kwh_total"
    ).groupBy("meter", "slot").agg(
        F.count(F.lit(1)).alias("readings"), F.max(F.struct("us", "energy_kwh_total")).alias("last")
    ).select("meter", "slot", "readings", F.col("last.energy_kwh_total").alias("observed"))
    spans = usable.groupBy("meter").agg(F.min(us).alias("a"), F.max(us).alias("b"))
    # days first, then the slots of each: a wrong clock may stretch a span over a century, but no row over millions of slots
    a, b, day = period("a", width), period("b", width), DAY_SLOTS
    days = spans.select("meter", a.alias("a"), b.alias("b"), F.explode(F.sequence(period(a, day), period(b, day))).alias("d"))
    low, high = F.greatest("a", F.col("d") * day), F.least("b", F.col("d") * day + day - 1)
    grid = days.select("meter", F.explode(F.sequence(low, high)).alias("slot"))
    joined = grid.join(slots, ["meter", "slot"], "left")
    by = Window.partitionBy("meter").orderBy("slot").rowsBetween(-max_gap_slots, 0)
    value = F.last("observed", ignorenulls=True).over(by)
    return joined.withColumn("value", value).select(
        "meter",
        (F.col("slot") * slot_s).alias("slot_epoch"),
        F.coalesce("readings", F.lit(0)).alias("readings"),
        F.col("value").alias("energy_kwh_total"),
        F.when(F.col("readings").isNotNull(), "observed").when(F.col("value").isNotNull(), "filled").otherwise("missing").alias("status"),
    )
