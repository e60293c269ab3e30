"""Aggregates by event time that are corrected as late records arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.calendar import period
from ..session import scratch_path
from ..store import TableStore
from .dedup import ARRIVAL, keep_first, kept_measurements, measurements

HOUR_US = 3600 * 1_000_000
COUNTS = ("in_time", "late", "dropped")


def _state(kept: DataFrame, allowed_s: int, cutoff_s: int, sign: Column | None = None) -> DataFrame:
    hour = period(F.unix_micros("ts_source"), HOUR_US)
    after = F.unix_micros("ts_edge") - (F.col("hour") + 1) * HOUR_US
    lateness = (
        F.when(F.col("after").isNull() | (F.col("after") > cutoff_s * 1_000_000), "dropped")
        .when(F.col("after") > allowed_s * 1_000_000, "late")
        .otherwise("in_time")
    )
    rows = kept.withColumn("hour", hour).withColumn("after", after).withColumn("kind", lateness)
    weight = F.lit(1) if sign is None else sign
    count = lambda kind: F.sum(F.when(F.col("kind") == kind, weight).otherwise(0)).alias(kind)
    return rows.groupBy("meter", "hour", F.col("power_kw").alias("value")).agg(*map(count, COUNTS))


def late_state(events: DataFrame, allowed_s: int = 300, cutoff_s: int = 24 * 3600) -> DataFrame:
    """Multiset of values per meter and hour: for each value, how often it arrived in time and how often late.

    In time: ``ts_edge`` at most ``allowed_s`` after the end of the hour. Late: after that and at most ``cutoff_s``
    after the end. Later records and records without ``ts_edge`` are beyond the cut-off: they are counted in
    ``dropped`` and change no aggregate. A null or NaN power is a value of its own, counted but not aggregated. Of
    repeated deliveries in ``events`` the first arrival counts; deliveries that come in several batches go through ``LateStore``.
    """
    return _state(kept_measurements(events, "power_kw"), allowed_s, cutoff_s)


def merge_states(*states: DataFrame) -> DataFrame:
    """Sum of multisets of *disjoint* measurements, or of a state and its changes; values that nobody holds any more go."""
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    merged = out.groupBy("meter", "hour", "value").agg(*[F.sum(c).alias(c) for c in COUNTS])
    return merged.where(" or ".join(f"{c} <> 0" for c in COUNTS))


class LateStore:
    """The multiset of ``late_state``, kept up to date batch by batch.

    It holds the kept deliveries, each with the sign it counts with. A batch is reduced to the first arrival of each of its
    measurements and compared with what is held: a measurement not seen before adds its value, an earlier arrival
    retracts the held value and adds its own, any other copy changes nothing. So the state after any sequence of batches, in any
    order, equals that of all their rows at once.

    Additions and retractions lie in one table, so a batch is there as a whole or not at all and a batch id that is there
    changes nothing. A batch reads the held deliveries between its first and last measurement time only (pushed to the scan).
    """

    def __init__(self, spark: SparkSession, base: str | None = None, allowed_s: int = 300, cutoff_s: int = 24 * 3600):
        self.tables = TableStore(spark, base or scratch_path(spark, "late"))
        self.allowed_s, self.cutoff_s = allowed_s, cutoff_s

    def add(self, batch: DataFrame, batch_id: str) -> None:
        columns = ["meter", "ts_source", *ARRIVAL, "power_kw"]
        first = [F.col(c).asc_nulls_last() for c in ARRIVAL]
        new = keep_first(measurements(batch, "power_kw"), ["meter", "ts_source"], first).select(*columns)
        if not self.tables.exists("kept"):
            self.tables.append("kept", new.withColumn("sign", F.lit(1)), batch_id)
        elif batch_id not in self.tables.manifest("kept")["batches"]:
            span = new.agg(F.min("ts_source").alias("a"), F.max("ts_source").alias("b")).first()
            held = self._held().where(F.col("ts_source").between(F.lit(span["a"]), F.lit(span["b"]))) if span["a"] else self._held().limit(0)
            key = ["meter", "ts_source"]
            old = held.select(*key, F.struct(*[c for c in columns if c not in key]).alias("old"))
            both = new.join(old, key, "left")
            earlier = F.struct(*[F.struct(F.col(c).isNull(), F.col(c)) for c in ARRIVAL]) < F.struct(*[F.struct(F.col(f"old.{c}").isNull(), F.col(f"old.{c}")) for c in ARRIVAL])
            both = both.where(F.col("old").isNull() | earlier)
            added = F.struct(F.lit(1).alias("sign"), *[F.col(c) for c in columns if c not in key])
            taken = F.when(F.col("old").isNotNull(), F.struct(F.lit(-1).alias("sign"), "old.*"))
            changes = both.select(*key, F.explode(F.array_compact(F.array(added, taken))).alias("x")).select(*key, "x.*")
            self.tables.append("kept", changes.select(*columns, "sign"), batch_id)

    def _held(self) -> DataFrame:
        """The kept delivery per measurement: additions whose retraction is not there."""
        rows = self.tables.read("kept")
        return keep_first(rows.where("sign > 0"), ["meter", "ts_source"], [F.col(c).asc_nulls_last() for c in ARRIVAL]).drop("sign")

    def state(self) -> DataFrame:
        rows = self.tables.read("kept")
        counts = _state(rows, self.allowed_s, self.cutoff_s, F.col("sign"))
        return counts.where(" or ".join(f"{c} <> 0" for c in COUNTS))


def corrected_hours(state: DataFrame) -> DataFrame:
    """Per meter and hour the first and the corrected count, median, distinct count, minimum and maximum.

    The median is the lower one: the first value whose cumulative count reaches half of the total. A period whose
    records are all beyond the cut-off has counts of 0 and null aggregates.
    """
    value = F.when(~F.isnan("value"), F.col("value"))
    rows = state.withColumn("value", value).withColumn("final", F.col("in_time") + F.col("late"))
    by, whole = Window.partitionBy("meter", "hour").orderBy(F.col("value").asc_nulls_last()), Window.partitionBy("meter", "hour")
    counted = {c: F.when(F.col("value").isNotNull(), F.col(c)).otherwise(0) for c in ("in_time", "final")}
    rows = rows.withColumns({f"c_{c}": counted[c] for c in counted})
    rows = rows.withColumns(
        {f"cum_{c}": F.sum(f"c_{c}").over(by) for c in counted} | {f"all_{c}": F.sum(f"c_{c}").over(whole) for c in counted}
    )
    out = []
    for c, name in (("in_time", "first"), ("final", "final")):
        there = F.col(f"c_{c}") > 0
        out += [
            F.sum(c).alias(f"n_{name}"),
            F.min(F.when(there & (2 * F.col(f"cum_{c}") >= F.col(f"all_{c}")), F.col("value"))).alias(f"median_{name}"),
            F.count_if(there).alias(f"distinct_{name}"),
            F.min(F.when(there, F.col("value"))).alias(f"min_{name}"),
            F.max(F.when(there, F.col("value"))).alias(f"max_{name}"),
        ]
    return rows.groupBy("meter", "hour").agg(
        F.sum("late").alias("late"), F.sum("dropped").alias("dropped"), *out
    ).withColumn("hour_epoch", F.col("hour") * 3600).drop("hour")
