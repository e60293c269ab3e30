"""Structured Streaming: idempotent upserts, checked increments, windows and stateful alerts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import Rules
from ..operators.dedup import BucketStore, meter_key
from ..operators.quality import checked_increment, deliveries
from ..session import shipped
from ..store import TableStore


def run_once(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Process what is new and stop; a failed batch is repeated with the same id."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def upsert_stream(stream: DataFrame, store: BucketStore, checkpoint: str) -> StreamingQuery:
    """Deliveries into the bucketed store; repeated batches and repeated identifiers change nothing."""
    return run_once(stream, checkpoint, lambda batch, i: store.upsert(batch, str(i)) and None)


def silver_stream(stream: DataFrame, context: Callable[[], DataFrame], tables: TableStore, checkpoint: str, rules: Rules) -> StreamingQuery:
    """New deliveries into ``readings`` and ``quarantine``, judged with neighbours from ``context``.

    Per batch both tables are merged insert-only on (meter, ts_source) under the batch id, valid rows first. A replay
    after a failure between the two skips what was committed, so every measurement ends up in one of them once.
    """

    def each(batch: DataFrame, i: int) -> None:
        valid, quarantine = checked_increment(deliveries(batch), deliveries(context()), rules)
        for name, rows in (("readings", valid), ("quarantine", quarantine)):
            tables.merge_insert_only(name, rows, ["meter", "ts_source"], str(i), within="ts_source")

    return run_once(stream, checkpoint, each)


def fan_out(stream: DataFrame, sinks: dict[str, Callable[[DataFrame, int], None]], checkpoint: str) -> StreamingQuery:
    """One source into several sinks; every sink must be idempotent by batch id."""

    def each(batch: DataFrame, i: int) -> None:
        batch.persist()
        try:
            for write in sinks.values():
                write(batch, i)
        finally:
            batch.unpersist()

    return run_once(stream, checkpoint, each)


def distinct_stream(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First copy per (meter, measurement time) with state bounded by the watermark; spellings of a meter are one."""
    keyed = events.withWatermark("ts_source", delay).withColumn("meter_key_", meter_key())
    return keyed.dropDuplicatesWithinWatermark(["meter_key_", "ts_source"]).drop("meter_key_")


def power_windows(events: DataFrame, width: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Mean power per machine and window, then summed over machines: two chained aggregations in append mode."""
    w = events.withWatermark("ts_source", delay)
    each = w.groupBy(F.window("ts_source", width).alias("w"), "machine_id").agg(F.avg("power_kw").alias("kw"))
    return each.groupBy(F.window(F.window_time("w"), width).alias("w")).agg(F.sum("kw").alias("park_kw"), F.count(F.lit(1)).alias("machines")).select(
        F.unix_seconds("w.start").alias("window_epoch"), "park_kw", "machines"
    )


ALERT = "machine_id string, start_us bigint, fired_us bigint, duration_h double"


def long_run_alerts(events: DataFrame, state: str, threshold_h: float) -> DataFrame:
    """One row when a machine's run of ``state`` first exceeds the threshold; again only in its next run.

    Keeps three values per machine: the start of the run, the last time seen and whether it fired. They do not expire: a
    processing-time limit would keep a run over available data from ending, an event-time limit would drop machines that
    are replayed behind others. Late rows (before the last time seen) are ignored, of equal times the first counts.
    """

    def update(key, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        start, last, fired = held.get if held.exists else (-1, -1, False)
        rows = pd.concat(list(batches)).sort_values("us", kind="stable").drop_duplicates("us")
        rows = rows[rows["us"] > last]
        out = pd.DataFrame(columns=["machine_id", "start_us", "fired_us", "duration_h"])
        if len(rows):
            inside = (rows["state"] == state).to_numpy()
            run = np.cumsum(~inside)  # 0 goes on with the run that was open
            on = pd.DataFrame({"run": run[inside], "us": rows["us"].to_numpy()[inside]})
            on["start"] = on.groupby("run")["us"].transform("min")
            if start >= 0:
                on.loc[on["run"] == 0, "start"] = start
            on["hours"] = (on["us"] - on["start"]) / 3.6e9
            new = on[(on["hours"] > threshold_h) & ~((on["run"] == 0) & fired)].groupby("run", as_index=False).first()
            out = pd.DataFrame({"machine_id": key[0], "start_us": new["start"], "fired_us": new["us"], "duration_h": new["hours"]})
            fired = bool(inside[-1]) and (run[-1] in set(new["run"]) or (run[-1] == 0 and fired))
            start = int(on["start"].iloc[-1]) if inside[-1] else -1
            last = int(rows["us"].iloc[-1])
        held.update((start, last, fired))
        yield out

    shipped(events.sparkSession)
    keyed = events.where("machine_id is not null and ts_source is not null").select("machine_id", F.unix_micros("ts_source").alias("us"), "state")
    return keyed.groupBy("machine_id").applyInPandasWithState(
        update, ALERT, "start bigint, last bigint, fired boolean", "append", GroupStateTimeout.NoTimeout
    )


def assemble_stream(points: DataFrame, fields: list[str]) -> DataFrame:
    """Readings from a stream of single points (``meter, us, field, value``).

    A reading is emitted when all its fields are there. A newer time drops what is incomplete, older points are stale.
    """

    def update(key, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        at, got = (held.get[0], dict(zip(held.get[1], held.get[2], strict=True))) if held.exists else (-1, {})
        out = []
        for rows in batches:
            for us, name, value in zip(rows["us"].tolist(), rows["field"].tolist(), rows["value"].tolist(), strict=True):
                if us < at:
                    continue
                if us > at:
                    at, got = us, {}
                if name in fields:
                    got[name] = float(value)
                if len(got) == len(fields):
                    out.append((key[0], at, *[got[f] for f in fields]))
                    at, got = at + 1, {}
        held.update((at, list(got), list(got.values())))
        yield pd.DataFrame(out, columns=["meter", "us", *fields])

    shipped(points.sparkSession)
    schema = "meter string, us bigint, " + ", ".join(f"{f} double" for f in fields)
    return points.groupBy("meter").applyInPandasWithState(
        update, schema, "at bigint, names array<string>, amounts array<double>", "append", GroupStateTimeout.NoTimeout
    )
