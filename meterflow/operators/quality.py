"""Readings checked by rule: deduplicated, flagged, split into valid rows and quarantine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Rules
from .dedup import ARRIVAL, keep_first, meter_key
from .sequences import neighbours

# fixed values: names of the rules, and the columns a reading cannot do without
REASONS = ("missing_value", "bad_status", "negative_value", "implausible_power", "spike")
REQUIRED = ("machine_id", "meter", "ts_source", "state", "power_kw", "energy_kwh_total", "opc_status")
COLUMNS = ("ingest_id", "machine_id", "seq", "ts_source", "ts_edge", "state", "job_id", "power_kw", "energy_kwh_total", "opc_status")


def deliveries(events: DataFrame) -> DataFrame:
    """The columns the checks need; ``meter`` is the normalised id."""
    return events.select(meter_key().alias("meter"), *COLUMNS)


def deduplicated(rows: DataFrame) -> DataFrame:
    """First arrival per (meter, measurement time). Rows with a null in the key form groups like any value."""
    return keep_first(rows, ["meter", "ts_source"], [F.col(c).asc_nulls_last() for c in ARRIVAL])


def _absent(column: str) -> Column:
    gone = F.col(column).isNull()
    return gone | F.isnan(column) if column == "energy_kwh_total" else gone


def checked(rows: DataFrame, rules: Rules) -> DataFrame:
    """Deduplicated rows with ``dq_reason`` (null: valid), ``is_uncertain`` and ``is_late``.

    The first rule that applies wins: missing_value, bad_status, negative_value, implausible_power, spike. A spike
    exceeds both neighbours of its meter; a Bad or missing neighbour disables the rule. Rows without meter or time are
    nobody's neighbour. NaN power is implausible (it sorts above every number), a NaN counter is a missing value.
    Late rows are flagged, never dropped.
    """
    kept = deduplicated(rows).withColumn("us", F.unix_micros("ts_source"))
    keyed = F.col("meter").isNotNull() & F.col("us").isNotNull()
    beside = F.when(F.col("opc_status") != "Bad", F.col("power_kw"))
    placed = neighbours(kept, "meter", ["us"], {"before": beside}, {"after": beside})
    everything = placed.unionByName(kept.where(~keyed), allowMissingColumns=True)
    kw = F.col("power_kw")
    spike = (kw > rules.spike_min_kw) & F.col("before").isNotNull() & F.col("after").isNotNull() & (kw > F.greatest("before", "after") * rules.spike_ratio)
    reason = (
        F.when(reduce(Column.__or__, map(_absent, REQUIRED)), "missing_value")
        .when(F.col("opc_status") == "Bad", "bad_status")
        .when((kw < 0) | (F.col("energy_kwh_total") < 0), "negative_value")
        .when(kw > rules.max_power_kw, "implausible_power")
        .when(spike, "spike")
    )
    late = F.unix_micros("ts_edge") - F.col("us") > rules.late_s * 1_000_000
    return everything.withColumns(
        {"dq_reason": reason, "is_uncertain": F.col("opc_status") == "Uncertain", "is_late": late}
    ).drop("before", "after", "us")


def split(flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid readings, quarantine) of one checked relation."""
    return flagged.where("dq_reason is null").drop("dq_reason"), flagged.where("dq_reason is not null")


def valid_readings(events: DataFrame, rules: Rules) -> DataFrame:
    return split(checked(deliveries(events), rules))[0]


def checked_increment(batch: DataFrame, context: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine) of the measurements of one batch, judged with neighbours from earlier batches.

    ``batch`` and ``context`` are relations of ``deliveries``. Context rows of the batch's meters within
    ``context_minutes`` of its time span take part but are not returned. The span comes to the driver as two numbers,
    so it is pushed into the scan of the context. Keys with nulls are matched null-safely: such rows of the batch
    reach the quarantine as in a full run. An empty batch gives empty results.
    """
    span = batch.agg(F.min("ts_source").alias("a"), F.max("ts_source").alias("b")).first()
    if span["a"] is None:
        return split(checked(batch, rules))
    margin = F.expr(f"INTERVAL {rules.context_minutes} MINUTES")
    meters = batch.select("meter").where("meter is not null").distinct()
    near = context.where(
        (F.col("ts_source") >= F.lit(span["a"]) - margin) & (F.col("ts_source") <= F.lit(span["b"]) + margin)
    ).join(meters, "meter", "left_semi")
    keys = batch.select(F.col("meter").alias("m_"), F.col("ts_source").alias("t_")).distinct()
    flagged = checked(batch.unionByName(near), rules)
    own = flagged.join(keys, F.col("meter").eqNullSafe(F.col("m_")) & F.col("ts_source").eqNullSafe(F.col("t_")), "left_semi")
    return split(own)
