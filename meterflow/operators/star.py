"""The star schema from raw deliveries: every dimension and fact of the reporting model in one call."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Rules
from ..functions import calendar
from ..session import written
from ..store import TableStore
from . import daily, dimensions, intervals, quality


def star_tables(events: DataFrame, master: DataFrame, rules: Rules) -> dict[str, DataFrame]:
    """Dimensions (machine versions, dates, bands, states, slots) and facts, each fact with the ``machine_sk`` valid at its time.

    What several tables read, the checked deliveries and the runs, is written once. Facts of a day take the version valid
    at noon UTC, other facts that of their start, so energy before a move stays with the old hall. Without any valid
    reading the calendar is empty, as are the facts.
    """
    spark = events.sparkSession
    rows = quality.deliveries(events)
    checked = written(quality.checked(rows, rules), "checked")
    readings = quality.split(checked)[0]
    runs = written(intervals.state_runs(readings, rules), "runs")
    machines = written(dimensions.versions_of(master), "machines")
    span = readings.agg(F.min("ts_source").alias("a"), F.max("ts_source").alias("b")).first()
    first, last = ("1970-01-02", "1970-01-01") if span["a"] is None else ((span["a"] - timedelta(days=1)).date().isoformat(), (span["b"] + timedelta(days=1)).date().isoformat())
    quality_days = daily.daily_quality(rows, checked, rules)
    in_data = calendar.local("ts_source", rules)
    days = readings.select(F.to_date(in_data).alias("date"))
    noon = calendar.noon_utc("date_key")
    start = F.timestamp_micros("start_us")
    keyed = lambda fact, at: dimensions.with_version(fact, machines, at)
    return {
        "dim_machine": machines,
        "dim_date": calendar.dates(spark, first, last) if span["a"] is not None else calendar.dates(spark, "1970-01-01", "1970-01-01").limit(0),
        "dim_band": calendar.bands(spark),
        "dim_state": calendar.states(spark),
        "dim_time_slot": calendar.time_slots(spark, rules),
        "fact_quarter_hours": keyed(intervals.bucket_facts(readings, rules), F.timestamp_seconds("bucket_epoch")),
        "fact_state_days": keyed(intervals.state_days(readings, rules), noon),
        "fact_heat_ups": keyed(intervals.warm_ups(runs, rules), start),
        "fact_jobs": keyed(intervals.jobs(runs), start),
        "fact_quality_days": dimensions.coverage(quality_days, machines, days),
    }


def publish_star(tables: dict[str, DataFrame], store: TableStore, frame: str = "star") -> dict[str, int]:
    """Replace all tables, then make the new versions visible together: readers of the frame see the old set or the new one."""
    for name, rows in tables.items():
        store.overwrite(name, rows)
    return store.publish(frame, list(tables))
