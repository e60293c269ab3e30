"""At-least-once delivery: one copy per identifier, through a hash-bucketed, sorted store."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import fresh, partitions, read_text, scratch_names, scratch_path, write_text


def meter_key(column: Column | str = "meter_id") -> Column:
    """Identity of a meter: letter case and outer blanks do not count."""
    return F.upper(F.trim(F.col(column) if isinstance(column, str) else column))


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every ``keys`` group by ``order``; all columns are kept.

    ``row_number() = 1`` plans a group limit *below* the exchange, so of a hot identifier only one row per map task
    is shuffled. Null keys form a group of their own (null equals null). ``order`` should be total.
    """
    (rn,) = fresh(df, "rn")
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rn, F.row_number().over(window)).where(F.col(rn) == 1).drop(rn)


class BucketStore:
    """Rows hash-bucketed by identifier and sorted inside the bucket; one sorted run per upserted batch.

    * ``upsert`` combines a batch (one copy per identifier and map task before the shuffle), then appends it as one
      sorted run per bucket. A batch id that is already there is skipped; should a batch be appended again because its
      job died before the id was noted, its rows collapse like any other copies.
    * ``merged`` reads all runs. The scan is bucketed, hence equal identifiers of different runs already lie in the
      same task and collapse without another exchange.
    * ``compact`` writes the merged rows as the only run of a new generation.

    Files and the note of generation and batches lie in ``base``, a fresh path of the shared folder if none is given;
    an existing ``base`` is opened again, with the number of buckets it has.
    """

    def __init__(self, spark: SparkSession, keys: list[str], order: list[str], buckets: int | None = None, name: str = "store", base: str | None = None):
        self.spark, self.keys, self.order = spark, keys, order
        self.base, self.name = base or scratch_path(spark, name), f"{name}_{uuid.uuid4().hex[:12]}"
        self._named: set[str] = set()
        self.buckets, self.generation, self.batches = buckets or partitions(spark), 0, set()
        note = read_text(spark, f"{self.base}/_note.json") if base else None
        if note is not None:
            known = json.loads(note)
            self.buckets, self.generation, self.batches = known["buckets"], known["generation"], set(known["batches"])
            self._register()

    @property
    def table(self) -> str:
        name = f"{self.name}_{self.generation}"
        if name not in self._named:
            self._named.add(name)
            scratch_names(self.spark).append(name)  # the files of a given base outlive the name
        return name

    @property
    def _path(self) -> str:
        return f"{self.base}/{self.generation}"

    def _order(self) -> list[Column]:
        return [F.col(c).asc_nulls_last() for c in self.order]

    def _register(self) -> None:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(self._path).schema)
        keys, order = (", ".join(f"`{c}`" for c in names) for names in (self.keys, [*self.keys, *self.order]))
        self.spark.sql(
            f"CREATE TABLE {self.table} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({order}) "
            f"INTO {self.buckets} BUCKETS LOCATION '{self._path}'"
        )

    def _note(self) -> None:
        text = json.dumps({"buckets": self.buckets, "generation": self.generation, "batches": sorted(self.batches)})
        write_text(self.spark, f"{self.base}/_note.json", text)

    def _append(self, df: DataFrame) -> None:
        (
            df.repartition(self.buckets, *self.keys)
            .write.bucketBy(self.buckets, *self.keys)
            .sortBy(*self.keys, *self.order)
            .mode("append")
            .option("path", self._path)
            .saveAsTable(self.table)
        )

    def upsert(self, batch: DataFrame, batch_id: str) -> bool:
        if batch_id in self.batches:
            return False
        self._append(keep_first(batch, self.keys, self._order()))
        self.batches.add(batch_id)
        self._note()
        return True

    def merged(self) -> DataFrame:
        return keep_first(self.spark.table(self.table), self.keys, self._order())

    def compact(self) -> DataFrame:
        rows, old = self.merged(), self.table
        self.generation += 1
        self._append(rows)
        self._note()
        self.spark.sql(f"DROP TABLE {old}")
        return self.spark.table(self.table)


def measurements(events: DataFrame, *columns: str) -> DataFrame:
    """Rows that belong to a measurement: ``meter`` (normalised), ``ts_source``, ``ts_edge``, ``ingest_id`` and ``columns``.

    Rows without meter or measurement time are left out. Only these columns are read.
    """
    extra = [F.col(c) for c in columns]
    return events.select(meter_key().alias("meter"), "ts_source", "ts_edge", "ingest_id", *extra).where(
        F.col("meter").isNotNull() & F.col("ts_source").isNotNull()
    )


ARRIVAL = ("ts_edge", "ingest_id")


def kept_measurements(events: DataFrame, *columns: str) -> DataFrame:
    """One row per measurement: smallest ``ts_edge`` (null last), then smallest ``ingest_id``."""
    return keep_first(measurements(events, *columns), ["meter", "ts_source"], [F.col(c).asc_nulls_last() for c in ARRIVAL])


def surplus_copies(events: DataFrame, batch_column: str = "_source") -> DataFrame:
    """``ingest_id`` of every delivery that is not the kept copy of its measurement.

    The deliveries are upserted batch by batch (one batch per value of ``batch_column`` here: backfill and live
    feed) and the runs are merged; what the merged store does not hold is surplus. The comparison runs on the unique
    ``ingest_id``, which is evenly spread even if one identifier has a third of all copies.

    Null meter or ``ts_source``: no measurement, never surplus. Equal arrival: smallest ``ingest_id`` is kept.
    Null ``ts_edge`` sorts last. An empty table gives an empty result.
    """
    spark = events.sparkSession
    rows = measurements(events, batch_column)
    store = BucketStore(spark, ["meter", "ts_source"], list(ARRIVAL), partitions(spark, rows), name="deliveries")
    live = F.coalesce(F.col(batch_column) == "stream", F.lit(False))
    store.upsert(rows.where(~live).drop(batch_column), "history")
    store.upsert(rows.where(live).drop(batch_column), "stream")
    return rows.select("ingest_id").join(store.merged().select("ingest_id"), "ingest_id", "left_anti")
