"""Data quality per meter and local day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Rules
from ..functions.calendar import day_key, local, period
from .intervals import counter_deltas
from .quality import REASONS, deduplicated, split


def _day(rules: Rules) -> Column:
    return day_key(local("ts_source", rules)).alias("date_key")


def rejected_by_reason(quarantine: DataFrame, *by: Column | str) -> DataFrame:
    """Quarantined rows per ``by``, one column per reason."""
    pivoted = quarantine.groupBy(*by).pivot("dq_reason", list(REASONS)).agg(F.count(F.lit(1)))
    return pivoted.withColumnsRenamed({r: f"rejected_{r}" for r in REASONS}).fillna(0)


def daily_quality(rows: DataFrame, flagged: DataFrame, rules: Rules) -> DataFrame:
    """Per meter and local day: arrived, removed and why, gaps, counter events and minutes covered.

    ``rows`` are all deliveries, ``flagged`` the same after the checks. Rows without meter or time have no day and are
    left out.
    """
    keyed = "meter is not null and ts_source is not null"
    rows, flagged = rows.where(keyed), flagged.where(keyed)
    arrived = rows.groupBy("meter", _day(rules)).agg(F.count(F.lit(1)).alias("events_received"))
    unique = deduplicated(rows.select("meter", "ts_source", "ts_edge", "ingest_id")).groupBy("meter", _day(rules)).agg(F.count(F.lit(1)).alias("measurements"))
    valid, quarantine = split(flagged)
    d = counter_deltas(valid, rules)
    good = d.groupBy("meter", _day(rules)).agg(
        F.count(F.lit(1)).alias("valid_readings"),
        F.count_if("is_uncertain").alias("uncertain_readings"),
        F.count_if("is_late").alias("late_events"),
        F.count_if("is_gap").alias("gaps"),
        (F.sum(F.when(F.col("is_gap"), F.col("interval_s"))) / 60).alias("gap_minutes"),
        F.count_if("counter_reset").alias("counter_resets"),
        F.count_if("counter_discontinuity").alias("counter_discontinuities"),
        F.count_distinct(period("us", 60_000_000)).alias("minutes_covered"),
    )
    out = arrived
    for part in (unique, good, rejected_by_reason(quarantine, "meter", _day(rules))):
        out = out.join(part, ["meter", "date_key"], "left")
    return out.fillna(0).withColumn("duplicates_removed", F.col("events_received") - F.col("measurements"))
