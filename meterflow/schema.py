"""Fixed schemas of events and of the first typed table."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"int": T.IntegerType(), "bigint": T.LongType(), "string": T.StringType(), "double": T.DoubleType(), "timestamp": T.TimestampType()}


def struct(text: str) -> T.StructType:
    """A schema from ``name kind, name kind``; needs no session."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (x.split() for x in text.split(","))])


# fixed values: the fields of an event; the last one exists from schema version 2
EVENT = struct(
    "schema_version int, machine_id string, meter_id string, seq bigint, ts_source timestamp, ts_edge timestamp, "
    "state string, job_id string, l1_a double, l2_a double, l3_a double, voltage_v double, power_kw double, "
    "energy_kwh_total double, opc_status string, power_factor double"
)
METADATA = struct("_source string, _source_file string, _source_file_modified timestamp, _enqueued_at timestamp, _ingested_at timestamp")
BRONZE = T.StructType(EVENT.fields + METADATA.fields)
STATE_NAMES = ("off", "idle", "heat_up", "building", "cool_down", "unpacking")
STATUS_NAMES = ("Good", "Uncertain", "Bad")
