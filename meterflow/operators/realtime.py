"""Real-time views as pure functions of a relation and an explicit ``as_of`` time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import period
from .dedup import keep_first
from .sequences import SLICE_US, numbered, runs


def _since(as_of: datetime, seconds: float) -> Column:
    """Readings of the last ``seconds`` up to ``as_of``; plain comparisons, so they reach the scan."""
    us = F.timestamp_micros(F.unix_micros(F.lit(as_of)) - int(seconds * 1e6))
    return (F.col("ts_source") > us) & (F.col("ts_source") <= F.lit(as_of))


def latest(readings: DataFrame, as_of: datetime) -> DataFrame:
    """The latest reading per machine with its age in whole seconds (ties: the largest ingest_id)."""
    newest = F.max_by(F.struct("state", "power_kw", "job_id", "opc_status", "ts_source"), F.struct("ts_source", "ingest_id")).alias("r")
    rows = readings.where((F.col("ts_source") <= F.lit(as_of)) & F.col("machine_id").isNotNull()).groupBy("machine_id").agg(newest)
    last = F.unix_micros("r.ts_source")
    return rows.select(
        "machine_id", "r.state", "r.power_kw", "r.job_id", "r.opc_status", last.alias("last_us"),
        F.floor((F.unix_micros(F.lit(as_of)) - last) / 1_000_000).alias("age_s"),
    )


def recent_runs(readings: DataFrame, as_of: datetime, lookback_s: float, scale: float = 1.0) -> DataFrame:
    """Runs of equal state per machine in the lookback, from their first to their last reading.

    ``scale`` divides durations (replays that run faster than time). A null state is a state of its own.
    """
    rows = readings.where(_since(as_of, lookback_s)).select("machine_id", "ingest_id", "state", F.unix_micros("ts_source").alias("us"))
    us = F.col("us")
    out = runs(rows, "machine_id", ["us", "ingest_id"], "state", {"start_us": ("min", us), "last_us": ("max", us), "readings": ("sum", F.lit(1))})
    return out.withColumn("duration_h", F.round((F.col("last_us") - F.col("start_us")) / 3.6e9 / scale + 1e-9, 2))


def recent_runs_of(runs: DataFrame, state: str, threshold_h: float) -> DataFrame:
    """Runs of one state, whether each is too long and whether it is the machine's current run."""
    current = F.max("run_id").over(Window.partitionBy("machine_id"))
    return runs.withColumn("is_running", F.col("run_id") == current).where(F.col("state") == state).select(
        "machine_id", "start_us", "last_us", "duration_h", (F.col("duration_h") > threshold_h).alias("too_long"), "is_running"
    )


def run_status(readings: DataFrame, as_of: datetime, lookback_s: float, state: str, threshold_h: float, grace_s: float, scale: float = 1.0) -> DataFrame:
    """Every machine with its latest run of ``state`` if that is running or ended within the grace period."""
    runs = recent_runs_of(recent_runs(readings, as_of, lookback_s, scale), state, threshold_h)
    newest = keep_first(runs, ["machine_id"], [F.col("start_us").desc()])
    alive = newest.where(F.col("is_running") | (F.col("last_us") > F.unix_micros(F.lit(as_of)) - int(grace_s * 1e6)))
    joined = latest(readings, as_of).join(alive.select("machine_id", "start_us", "duration_h", "is_running"), "machine_id", "left")
    hours = F.coalesce("duration_h", F.lit(0.0))
    return joined.select(
        "machine_id", "state", "start_us", hours.alias("duration_h"), F.coalesce("is_running", F.lit(False)).alias("is_running"),
        (hours > threshold_h).alias("alert"), "job_id", "power_kw", "last_us",
    )


def transitions(polls: DataFrame) -> DataFrame:
    """Alerts that fire once: rows of (``machine_id``, ``poll``, ``alert``) where alert turns from false to true.

    ``poll`` is a whole number that orders the polls of a machine. A null alert counts as false; ties of ``poll`` are
    taken with false first.
    """
    rows = polls.select("machine_id", F.col("poll").cast("bigint").alias("poll"), F.coalesce("alert", F.lit(False)).alias("alert"))
    by = Window.partitionBy("machine_id", "slice_").orderBy("poll", "alert")
    rows = rows.where("machine_id is not null and poll is not null").withColumn("slice_", period("poll", SLICE_US))
    rows = rows.withColumns({"was": F.lag("alert").over(by), "last_": F.lead(F.lit(1)).over(by).isNull()})
    # the ends of slices and what may be a change: few enough to be ordered once more per machine
    few = rows.where("last_ or (alert and not coalesce(was, false))")
    across = Window.partitionBy("machine_id").orderBy("poll", "alert", F.col("was").desc_nulls_last())
    few = few.withColumn("was", F.coalesce("was", F.lag("alert").over(across), F.lit(False)))
    return few.where("alert and not was").select("machine_id", "poll", "alert")


def arrival_numbers(rows: DataFrame) -> DataFrame:
    """0-based number of each delivery in the order its meter's deliveries reached the edge (ties: ``ingest_id``).

    Deliveries without meter or arrival time have no number and are left out.
    """
    arrived = rows.select("meter", "ingest_id", F.unix_micros("ts_edge").alias("us"))
    return numbered(arrived, "meter", "us", "ingest_id")[0].select("meter", "ingest_id", F.col("pos").alias("arrival_no"))


def newest_first_out(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest deliveries, oldest of them first: a live feed that leaves its backlog behind."""
    newest = rows.where("ts_edge is not null").orderBy(F.col("ts_edge").desc(), F.col("ingest_id").desc()).limit(n)
    return newest.orderBy("ts_edge", "ingest_id")


def park_power(readings: DataFrame, window_s: int = 60, as_of: datetime | None = None) -> DataFrame:
    """Mean power per machine and tumbling window, summed over the machines; with ``as_of`` only windows that end by then."""
    width = window_s * 1_000_000
    start = period(F.unix_micros("ts_source"), width) * window_s
    each = readings.where("machine_id is not null and ts_source is not null and power_kw is not null and not isnan(power_kw)").groupBy("machine_id", start.alias("window_epoch")).agg(F.avg("power_kw").alias("kw"))
    if as_of is not None:
        each = each.where((F.col("window_epoch") + window_s) * 1_000_000 <= F.unix_micros(F.lit(as_of)))
    return each.groupBy("window_epoch").agg(
        F.sum("kw").alias("park_kw"), F.count(F.lit(1)).alias("machines"), F.approx_count_distinct("machine_id").alias("machines_approx")
    )


def freshness(rows: DataFrame, as_of: datetime, lookback_s: float) -> DataFrame:
    """Deliveries, measurements (exact distinct), duplicates and exact latency percentiles in the lookback.

    Deliveries are counted per (meter, measurement) and per latency. The latencies are gathered in some thousand bins,
    which tell where a percentile lies, and only the latencies of that bin are ranked: no task holds all of them.
    """
    latency = F.unix_micros("ts_edge") - F.unix_micros("ts_source")
    recent = rows.where(_since(as_of, lookback_s) & F.col("meter").isNotNull())
    totals = recent.groupBy("meter", "ts_source").agg(F.count(F.lit(1)).alias("n")).agg(
        F.sum("n").alias("events"), F.count(F.lit(1)).alias("measurements"), F.max("ts_source").alias("last")
    )
    counts = recent.select(latency.alias("us")).where("us is not null").groupBy("us").agg(F.count(F.lit(1)).alias("n"))
    # a bin is a second up to an hour of latency, an hour beyond
    width = F.when(F.abs("us") < 3_600_000_000, 1_000_000).otherwise(3_600_000_000)
    counts = counts.withColumn("bin", F.floor(F.col("us") / width) * width)
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bins = counts.groupBy("bin").agg(F.sum("n").alias("n")).withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(every)})
    shares = F.explode(F.array(F.lit(0.5), F.lit(0.95))).alias("p")
    held = bins.select("bin", shares, (F.col("upto") - F.col("n")).alias("below"), "upto", F.col("total")).withColumn("rank", F.ceil(F.col("p") * F.col("total")))
    held = held.where((F.col("rank") > F.col("below")) & (F.col("rank") <= F.col("upto"))).drop("upto", "total")
    inside = Window.partitionBy("p").orderBy("us").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.join(held, "bin").withColumn("at", F.col("below") + F.sum("n").over(inside))
    found = ranked.where(F.col("at") >= F.col("rank")).agg(
        *[F.min(F.when(F.col("p") == p, F.col("us") / 1e6)).alias(f"p{int(p * 100)}_latency_s") for p in (0.5, 0.95)]
    )
    both = totals.unionByName(found, allowMissingColumns=True)  # two rows become one
    return both.agg(*[F.max(c).alias(c) for c in both.columns]).select(
        "events", "measurements", (F.col("events") - F.col("measurements")).alias("duplicates"),
        F.unix_micros("last").alias("last_us"), F.floor((F.unix_micros(F.lit(as_of)) - F.unix_micros("last")) / 1_000_000).alias("age_s"),
        "p50_latency_s", "p95_latency_s",
    )


def assembled(points: DataFrame, fields: list[str]) -> DataFrame:
    """Readings from single points (``meter, us, field, value, status``): complete ones only, status the worst of the points.

    A point delivered twice counts once (the larger value).
    """
    from ..functions.electrics import severity

    worst = F.max_by("status", severity(F.col("status"))).alias("status")
    one = points.where(F.col("field").isin(*fields)).groupBy("meter", "us", "field").agg(F.max("value").alias("value"), worst)
    return one.groupBy("meter", "us").agg(
        F.count(F.lit(1)).alias("points"), worst, *[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields]
    ).where(F.col("points") == len(fields)).drop("points")
