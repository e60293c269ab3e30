"""Sources: history files, message streams, master data, price documents."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import BRONZE, EVENT, STATE_NAMES, STATUS_NAMES


EVENT_FILE = EVENT


def history(spark: SparkSession, *paths: str, newer_than: datetime | None = None, recursive: bool = False, schema: T.StructType | None = None) -> DataFrame:
    """Parquet files of any schema version as one relation; with ``newer_than`` only files modified after that time.

    With a ``schema`` nothing is inferred, so that no file at all is no error.
    """
    reader = spark.read.option("mergeSchema", "true").option("recursiveFileLookup", str(recursive).lower())
    if newer_than is not None:
        reader = reader.option("modifiedAfter", newer_than.strftime("%Y-%m-%dT%H:%M:%S"))
    return (reader if schema is None else reader.schema(schema)).parquet(*paths)


def _typed(df: DataFrame, name: str, kind: T.DataType) -> Column:
    if name not in df.columns:
        return F.lit(None).cast(kind).alias(name)
    have = df.schema[name].dataType
    if isinstance(have, T.StringType) and isinstance(kind, T.TimestampType):
        return F.try_to_timestamp(F.col(name)).alias(name)
    return F.col(name).try_cast(kind).alias(name)


def to_bronze(df: DataFrame, source: str, ingested_at: Column | None = None) -> DataFrame:
    """Any event relation on the fixed schema plus metadata: missing columns become typed nulls, bad values null.

    Values that cannot be cast do not fail the job: the null makes the row a ``missing_value`` of the quality checks.
    For ``history`` the file path and modification time are kept, so ``df`` must come straight from the files.
    """
    file = source == "history"
    columns = [_typed(df, f.name, f.dataType) for f in EVENT.fields]
    enqueued = F.col("EventEnqueuedUtcTime").try_cast("timestamp") if "EventEnqueuedUtcTime" in df.columns else F.lit(None).cast("timestamp")
    return df.select(
        *columns,
        F.lit(source).alias("_source"),
        (F.col("_metadata.file_path") if file else F.lit(None).cast("string")).alias("_source_file"),
        (F.col("_metadata.file_modification_time") if file else F.lit(None).cast("timestamp")).alias("_source_file_modified"),
        enqueued.alias("_enqueued_at"),
        (F.current_timestamp() if ingested_at is None else ingested_at).alias("_ingested_at"),
    )


def loaded_until(bronze: DataFrame) -> datetime | None:
    """Watermark of an incremental file load: the latest modification time already loaded."""
    return bronze.agg(F.max("_source_file_modified")).first()[0]


def accepted(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) events by the wire contract: required fields, known states and status, power factor from version 2 on."""
    required = [f.name for f in EVENT.fields if f.name not in ("job_id", "power_factor")]
    ok = F.col("schema_version").isin(1, 2) & F.col("state").isin(*STATE_NAMES) & F.col("opc_status").isin(*STATUS_NAMES)
    for name in required:
        ok = ok & F.col(name).isNotNull()
    ok = ok & ((F.col("schema_version") == 1) == F.col("power_factor").isNull())
    ok = ok & (F.col("job_id").isNull() | (F.col("state") == "building"))
    ok = F.coalesce(ok, F.lit(False))
    return events.where(ok), events.where(~ok)


def message_stream(spark: SparkSession, path: str, files_per_batch: int | None = None, latest_first: bool = False) -> DataFrame:
    """JSON messages that land as files, as a stream of events."""
    reader = spark.readStream.format("text").option("latestFirst", str(latest_first).lower())
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in EVENT.fields])
    return reader.load(path).select(F.from_json("value", schema).alias("e")).select("e.*")


def kafka_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """The same messages from a broker; needs the Kafka connector on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.from_json(F.col("value").cast("string"), EVENT).alias("e")).select("e.*")


def event_stream(spark: SparkSession, path: str, schema: T.StructType = BRONZE, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a table as a stream: exactly the new files of each run."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def snapshots(spark: SparkSession, *paths: str) -> DataFrame:
    """Master data as CSV files with header; all columns are text."""
    return spark.read.option("header", "true").csv(list(paths))


def price_documents(spark: SparkSession, path: str) -> DataFrame:
    """Price documents, one whole JSON file per row (``body``)."""
    return spark.read.option("wholetext", "true").text(path).withColumnRenamed("value", "body")


# --- sinks ---


def write_days(events: DataFrame, path: str) -> None:
    """JSON lines per UTC day of measurement, appended."""
    events.withColumn("day", F.to_date("ts_source")).write.partitionBy("day").mode("append").json(path)


def write_months(events: DataFrame, path: str) -> None:
    """Parquet files per month (``month=yyyy-MM``), appended; months of version 1 only have no ``power_factor`` column.

    A month's rows are spread by adaptive execution where they are many.
    """
    month = F.date_format("ts_source", "yyyy-MM")
    rows = events.where("ts_source is not null").withColumn("month", month)
    newer = rows.groupBy("month").agg((F.max("schema_version") >= 2).alias("v2"))
    rows = rows.join(newer, "month").withColumn("v2", F.coalesce("v2", F.lit(False)))
    for with_factor in (False, True):  # one pass per layout, however many months
        part = rows.where("v2" if with_factor else "not v2").drop("v2", *([] if with_factor else ["power_factor"]))
        part.repartition("month").write.partitionBy("month").mode("append").parquet(path)


def keyed_messages(events: DataFrame) -> DataFrame:
    """(``key``, ``value``) messages for a partitioned log: one key per meter keeps a meter's order."""
    return events.select(F.col("meter_id").alias("key"), F.to_json(F.struct(*[f.name for f in EVENT.fields if f.name in events.columns])).alias("value"))
