"""Deterministic synthetic events: the same seed gives the same rows on any number of executors."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, label: str, *by: Column) -> Column:
    """A number in [0, 1) from a hash of seed, label and columns."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(label), *by), F.lit(1 << 40)) / float(1 << 40)


def exponential(mean: float, draw: Column) -> Column:
    return -mean * F.log(1 - draw)


def history(
    spark: SparkSession, meters: int, start: datetime, hours: int, interval_s: int = 60, seed: int = 7,
    duplicate_share: float = 0.002, late_share: float = 0.0007, outage_share: float = 0.0, version_2_from: datetime | None = None,
) -> DataFrame:
    """Events of ``meters`` machines that cycle through their states, with repeated and late deliveries.

    Rows are made from a range, one per meter and tick; the counter is the integral of the power profile in closed
    form, so no row depends on another. ``outage_share`` of a meter's hours have no readings at all. The other faults injected can be told from ``is_repeat`` and ``is_late``.
    """
    ticks = hours * 3600 // interval_s
    base = spark.range(meters * ticks).select(
        F.expr(f"id div {ticks}").alias("m"), (F.col("id") % ticks).alias("k")
    )
    base = base.where(uniform(seed, "outage", F.col("m"), F.expr(f"k * {interval_s} div 3600")) >= outage_share)
    phase_s, cycle_s = F.floor(uniform(seed, "phase", F.col("m")) * 86400), 12 * 3600
    # fixed profile of a cycle: state, end in seconds, power in kW, energy in kWh up to its begin
    profile = [("idle", 3600, 1.5), ("heat_up", 10800, 7.0), ("building", 32400, 4.0), ("cool_down", 36000, 1.2), ("unpacking", 37800, 0.4), ("off", 43200, 0.0)]
    second = F.col("k") * interval_s + phase_s
    into = second % cycle_s
    state, kw, energy = F.lit(None).cast("string"), F.lit(0.0), F.lit(0.0)
    begin = whole = 0.0
    for name, end, power in profile:
        inside = (into >= begin) & (into < end)
        state = F.when(inside, name).otherwise(state)
        kw = F.when(inside, F.lit(power)).otherwise(kw)
        energy = F.when(inside, whole + (into - begin) / 3600 * power).otherwise(energy)
        whole += (end - begin) / 3600 * power
        begin = end
    key = (F.col("m"), F.col("k"))
    noisy = F.round(kw * (0.95 + 0.1 * uniform(seed, "noise", *key)), 3)
    epoch_us = int(start.timestamp()) * 1_000_000
    jitter = F.floor(uniform(seed, "jitter", *key) * 400_000)
    source = F.lit(epoch_us) + F.col("k") * interval_s * 1_000_000 + jitter
    late = uniform(seed, "late", *key) < late_share
    delay = F.when(late, 600 + exponential(1800, uniform(seed, "wait", *key))).otherwise(0.5 + exponential(1.0, uniform(seed, "hop", *key)))
    copies = F.when(uniform(seed, "again", *key) < duplicate_share, 2).otherwise(1)
    version = F.lit(1) if version_2_from is None else F.when(source >= int(version_2_from.timestamp()) * 1_000_000, 2).otherwise(1)
    rows = base.select(
        version.alias("schema_version"), F.format_string("LS%05d", F.col("m") + 1).alias("machine_id"), F.format_string("EM%05d", F.col("m") + 1).alias("meter_id"),
        F.col("k").alias("seq"), F.timestamp_micros(source).alias("ts_source"), (source + F.floor(delay * 1e6)).alias("edge_us"), state.alias("state"),
        F.when(state == "building", F.concat_ws("-", F.format_string("LS%05d", F.col("m") + 1), F.floor(second / cycle_s).cast("string"))).alias("job_id"),
        *[F.round(noisy * 1000 / (F.sqrt(F.lit(3.0)) * 400 * 0.9), 3).alias(c) for c in ("l1_a", "l2_a", "l3_a")], F.lit(400.0).alias("voltage_v"),
        noisy.alias("power_kw"), F.round(1000.0 + F.floor(second / cycle_s) * whole + energy, 4).alias("energy_kwh_total"), F.lit("Good").alias("opc_status"),
        F.when(version == 2, 0.9).alias("power_factor"), late.alias("is_late"), F.explode(F.sequence(F.lit(1), copies)).alias("copy"),
    )
    return rows.withColumns(
        {"ts_edge": F.timestamp_micros(F.col("edge_us") + (F.col("copy") - 1) * 10_000_000), "is_repeat": F.col("copy") > 1}
    ).drop("edge_us", "copy")


def snapshots(spark: SparkSession, machines: int, months: list[str], moves: dict[int, tuple[int, str]]) -> DataFrame:
    """Monthly master data; ``moves`` maps a machine number to (index of the month, new hall)."""
    rows = spark.range(1, machines + 1).select(F.col("id").alias("m"), F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(months)])).alias("s"))
    hall = F.concat(F.lit("H"), (F.col("m") % 4 + 1).cast("string"))
    for machine, (index, name) in moves.items():
        hall = F.when((F.col("m") == machine) & (F.col("s.i") >= index), name).otherwise(hall)
    return rows.select(
        F.col("s.d").alias("snapshot_date"), F.format_string("LS%05d", "m").alias("machine_id"), hall.alias("hall_id"), F.format_string("EM%05d", "m").alias("meter_id"),
        F.format_string("EM%05d-SN-A", "m").alias("meter_serial"), F.to_timestamp("s.d").alias("exported_at"),
    )
