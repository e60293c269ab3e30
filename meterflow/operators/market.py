"""Hourly mart, price series and monthly prices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def price_series(raw: DataFrame, column: str = "body", zone: str = "CH") -> DataFrame:
    """Rows of a price document that holds two parallel arrays; prices may be null, surplus entries of one array get nulls."""
    doc = F.from_json(column, "unix_seconds array<bigint>, price array<double>")
    return raw.select(doc.alias("d")).select(F.inline(F.arrays_zip("d.unix_seconds", "d.price"))).select(
        F.col("unix_seconds").alias("hour_epoch"), F.lit(zone).alias("zone"), F.col("price").alias("eur_mwh")
    )


def hourly(facts: DataFrame, prices: DataFrame, zone: str = "CH") -> DataFrame:
    """Energy per machine version and UTC hour with the hour's price, if there is one. Facts without a version are left out."""
    hours = facts.where("machine_sk is not null").groupBy("machine_sk", F.expr("bucket_epoch div 3600 * 3600").alias("hour_epoch")).agg(
        F.min("date_key").alias("date_key"), F.min(F.expr("slot_of_day div 4")).alias("hour_local"), F.sum("kwh").alias("kwh")
    )
    known = prices.where(F.col("zone") == zone).select("hour_epoch", "eur_mwh")
    return hours.join(known, "hour_epoch", "left").withColumn("cost_spot", F.col("kwh") * F.col("eur_mwh") / 1000)


def monthly_prices(mart: DataFrame) -> DataFrame:
    """Load-weighted against time-weighted price per month. Hours without price count in the load but in neither price."""
    hours = mart.groupBy("hour_start_utc", F.expr("date_key div 100").alias("yyyymm")).agg(
        F.sum("kwh").alias("kwh"), F.sum("cost_spot_eur").alias("cost"), F.max("spot_eur_mwh").alias("price")
    )
    return hours.groupBy("yyyymm").agg(
        F.sum("kwh").alias("kwh"),
        F.sum("cost").alias("cost_spot_eur"),
        F.try_divide(F.sum("cost") * 1000, F.sum("kwh")).alias("load_weighted"),
        F.avg("price").alias("time_weighted"),
    )
