"""Slowly changing attributes: full history from periodic snapshots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import partitions, shipped
from .dedup import keep_first

DATE_PATTERNS = ("yyyy-MM-dd", "yyyyMMdd", "dd.MM.yyyy")
MISSING = ("", "N/A")
END = "9999-12-31"


def snapshot_day(column: str) -> Column:
    """A date in any of the notations; null if it is in none."""
    text = F.trim(F.col(column))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(p)).cast("date") for p in DATE_PATTERNS])


def plain(column: str) -> Column:
    """An attribute without regard to case and outer blanks; every notation of a missing value becomes null."""
    text = F.upper(F.trim(F.col(column)))
    return F.when(~text.isin(*MISSING), text)


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by entity and day in, versions out. Holds one batch and one open version."""
    carried = None  # the open version: a one-row table of the input's columns
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if rows.num_rows == 0:
            continue
        if carried is not None:
            rows = pa.concat_tables([carried, rows])
        entity = np.asarray(rows["entity"].to_pandas(), dtype=object)
        payload = np.asarray(rows["payload"].to_pandas(), dtype=object)
        begins = np.ones(len(entity), bool)
        begins[1:] = (entity[1:] != entity[:-1]) | (payload[1:] != payload[:-1])
        at = np.flatnonzero(begins)
        carried = rows.take(pa.array(at[-1:]))
        if len(at) > 1:
            yield from _emit(rows.take(pa.array(at[:-1])), rows.take(pa.array(at[1:])))
    if carried is not None:
        yield from _emit(carried, None)


def _emit(versions: pa.Table, following: pa.Table | None) -> list[pa.RecordBatch]:
    if following is None:
        to = [END] * versions.num_rows
    else:
        pairs = zip(versions["entity"].to_pylist(), following["entity"].to_pylist(), following["valid_from"].to_pylist(), strict=True)
        to = [day if a == b else END for a, b, day in pairs]
    out = versions.drop_columns(["payload"]).append_column("valid_to", pa.array(to, pa.string()))
    return out.combine_chunks().to_batches()


def attribute_history(snapshots: DataFrame, entity: str, day: str, exported: str, attributes: list[str]) -> DataFrame:
    """Every version of every entity with the half-open period ``valid_from`` <= day < ``valid_to``.

    Of several exports of an entity for one day the latest ``exported`` counts (ties: the larger attributes, so the
    result does not depend on order; null counts as earliest). Snapshots are then co-partitioned by entity and sorted
    by (entity, day) - Spark's sorter merges the sorted runs of all snapshots - and one pass over the merged
    stream emits a version whenever the attributes change. The pass holds a single open version.

    Absence from a snapshot changes nothing. Rows without entity or with an unreadable day are left out. A missing
    attribute is a value of its own. The last version ends at 9999-12-31. Other columns of the input are ignored.
    """
    shipped(snapshots.sparkSession)
    rows = snapshots.select(
        F.upper(F.trim(F.col(entity))).alias("entity"),
        snapshot_day(day).alias("day"),
        F.col(exported).alias("exported"),
        *[plain(a).alias(f"a{i}") for i, a in enumerate(attributes)],
    ).where(F.col("entity").isNotNull() & F.col("day").isNotNull())
    cols = [f"a{i}" for i in range(len(attributes))]
    latest = keep_first(rows, ["entity", "day"], [F.col(c).desc_nulls_last() for c in ("exported", *cols)])
    merged = (
        latest.select("entity", F.date_format("day", "yyyy-MM-dd").alias("valid_from"), *cols, F.to_json(F.struct(*cols)).alias("payload"))
        .repartition(partitions(snapshots.sparkSession, rows), "entity")
        .sortWithinPartitions("entity", "valid_from")
    )
    schema = "entity string, valid_from string, " + "".join(f"{c} string, " for c in cols) + "valid_to string"
    versions = merged.mapInArrow(_close, schema)
    return versions.select(
        F.col("entity").alias(entity), "valid_from", "valid_to", *[F.col(c).alias(a) for c, a in zip(cols, attributes, strict=True)]
    )
