"""Attributes as known at event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import period

SLICE_US = 30 * 86400 * 1_000_000


def salted_left_join(left: DataFrame, right: DataFrame, key: str, spread_by: str, salts: int = 16) -> DataFrame:
    """Left join on ``key`` where one key of ``left`` may have a large share of its rows and ``right`` is far smaller.

    Rows of ``left`` are spread over ``salts`` partitions per key by a hash of ``spread_by``; ``right``, unique in
    ``key``, is repeated ``salts`` times.
    """
    salt = F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")
    spread = right.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("salt_", salt).join(spread, [key, "salt_"], "left").drop("salt_")


def as_known(events: DataFrame, versions: DataFrame) -> DataFrame:
    """Each event with the version of its entity that was valid and known at its time.

    ``events``: ``event``, ``entity``, ``us`` (event time in microseconds) and any further columns; ``versions``:
    ``entity``, ``version``, ``valid_us``, ``known_us``. A version is available from the later of its two times; among
    the available ones the latest ``valid_us``, then the latest ``known_us``, then the largest ``version`` is right,
    so a version that is recorded late never replaces a newer one. Adds ``right_version`` (null if there is none).

    Versions and events are united and sorted by entity and availability time; at equal times versions come first.
    The right version is carried forward as a running maximum. So that an entity with a large share of all events does
    not end in one task, time is cut into slices and each (entity, slice) starts with the version carried into it,
    computed from the versions and the list of slices only.

    Events without entity or time have no right version. Versions without entity, name or either time are never
    available.
    Repeated events stay repeated.
    """
    slice_ = period("us", SLICE_US)
    usable = F.col("entity").isNotNull() & F.col("us").isNotNull()
    placed = events.where(usable).withColumn("slice_", slice_)
    changes = versions.where(
        F.col("entity").isNotNull() & F.col("version").isNotNull() & F.col("valid_us").isNotNull() & F.col("known_us").isNotNull()
    ).select(
        "entity", F.greatest("valid_us", "known_us").alias("us"), F.struct("valid_us", "known_us", "version").alias("state_")
    )
    slices = placed.select("entity", "slice_").distinct()
    starts = slices.select("entity", (F.col("slice_") * SLICE_US).alias("us"), F.col("slice_").alias("start_"))
    # at a slice's start only earlier versions are carried in: those of the same instant follow inside the slice
    carried = (
        changes.unionByName(starts, allowMissingColumns=True)
        .withColumn("state_", F.max("state_").over(_running(["entity"], F.col("us"), F.col("start_").isNull())))
        .where(F.col("start_").isNotNull())
        .select("entity", F.col("start_").alias("slice_"), "us", "state_", F.lit(0).alias("prio_"))
    )
    inside = changes.withColumn("slice_", slice_).join(slices, ["entity", "slice_"], "left_semi").withColumn("prio_", F.lit(1))
    timeline = placed.withColumn("prio_", F.lit(2)).unionByName(carried, allowMissingColumns=True).unionByName(inside, allowMissingColumns=True)
    state = F.max("state_").over(_running(["entity", "slice_"], F.col("us"), F.col("prio_")))
    right = timeline.withColumn("state_", state).where(F.col("prio_") == 2).withColumn("right_version", F.col("state_.version"))
    rest = events.where(~usable).withColumn("right_version", F.lit(None).cast("string"))
    return right.drop("slice_", "prio_", "state_").unionByName(rest)


def _running(keys: list[str], *order: Column) -> Window:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def stamped_versions(costs: DataFrame, versions: DataFrame) -> DataFrame:
    """Hourly cost rows with the machine version they carry and the right one.

    The machine of a row is that of the version it is stamped with; a stamp that no version has leaves the machine,
    and with it the right version, unknown. Columns: ``cost_id``, ``machine_sk``, ``right_sk``, ``is_right``.
    """
    owner = versions.select(
        "machine_sk", F.upper(F.trim("machine_id")).alias("entity")
    ).where(F.col("machine_sk").isNotNull()).groupBy("machine_sk").agg(F.max("entity").alias("entity"))
    rows = costs.select("cost_id", "machine_sk", F.unix_micros("hour_start_utc").alias("us"))
    events = salted_left_join(rows, owner, "machine_sk", "cost_id").withColumn("event", F.col("cost_id"))
    log = versions.select(
        F.upper(F.trim("machine_id")).alias("entity"),
        F.col("machine_sk").alias("version"),
        F.unix_micros("valid_from").alias("valid_us"),
        F.unix_micros("recorded_at").alias("known_us"),
    )
    return as_known(events, log).select(
        "cost_id", "machine_sk", F.col("right_version").alias("right_sk"),
        F.coalesce(F.col("right_version") == F.col("machine_sk"), F.lit(False)).alias("is_right"),
    )
