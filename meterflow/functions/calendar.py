"""Local time, day keys, time-of-use bands and calendar relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Rules


def period(micros: Column | str, width: int) -> Column:
    """Number of the period of ``width`` microseconds that holds an instant; whole numbers, also before 1970."""
    us = F.col(micros) if isinstance(micros, str) else micros
    return F.call_function("div", us - F.pmod(us, F.lit(width)), F.lit(width))


def local(ts: Column | str, rules: Rules) -> Column:
    return F.from_utc_timestamp(ts, rules.timezone)


def day_key(local_ts: Column | str) -> Column:
    return F.date_format(local_ts, "yyyyMMdd").cast("int")


def iso_weekday(ts: Column | str) -> Column:
    return F.weekday(ts) + 1


def time_band(local_ts: Column, rules: Rules) -> Column:
    """``peak`` on the configured local weekdays and hours, else ``off_peak``; decided by the start of the bucket."""
    hour = F.hour(local_ts)
    peak = iso_weekday(local_ts).isin(*rules.peak_weekdays) & (hour >= rules.peak_from_hour) & (hour < rules.peak_to_hour)
    return F.when(peak, "peak").otherwise("off_peak")


def slot_of_day(local_ts: Column) -> Column:
    return (F.hour(local_ts) * 4 + F.floor(F.minute(local_ts) / 15)).cast("int")


def noon_utc(key: Column | str) -> Column:
    """12:00 UTC of a yyyyMMdd key: day-level facts take the dimension version valid then."""
    return F.to_timestamp(F.concat(F.col(key).cast("string") if isinstance(key, str) else key.cast("string"), F.lit(" 12")), "yyyyMMdd HH")


def compact_id(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmm")


_DATES = """
SELECT int(date_format(date, 'yyyyMMdd')) AS date_key, date,
       extract(YEAR FROM date) AS year, extract(QUARTER FROM date) AS quarter, extract(MONTH FROM date) AS month,
       date_format(date, 'MMMM') AS month_name, date_format(date, 'yyyy-MM') AS year_month, extract(WEEK FROM date) AS iso_week,
       extract(DOW_ISO FROM date) AS iso_weekday, date_format(date, 'EEEE') AS weekday_name, extract(DOW_ISO FROM date) > 5 AS is_weekend
FROM (SELECT explode(sequence(to_date(:first), to_date(:last))) AS date)
"""


def dates(spark: SparkSession, first: str, last: str) -> DataFrame:
    """The calendar from ``first`` to ``last`` (yyyy-MM-dd), one row per day."""
    return spark.sql(_DATES, args={"first": first, "last": last})


def time_slots(spark: SparkSession, rules: Rules) -> DataFrame:
    """The 96 quarter hours of a local day."""
    s = F.col("slot_of_day")
    hour = F.floor(s / 4).cast("int")
    return spark.range(96).select(F.col("id").cast("int").alias("slot_of_day")).select(
        s,
        F.format_string("%02d:%02d", hour, (s % 4) * 15).alias("slot_label"),
        hour.alias("hour"),
        ((hour >= rules.peak_from_hour) & (hour < rules.peak_to_hour)).alias("is_peak_hours"),
    )


# fixed values: the states of a machine with their display names, in display order
STATES = ("off", "Off"), ("idle", "Idle"), ("heat_up", "Heat-up"), ("building", "Building"), ("cool_down", "Cool-down"), ("unpacking", "Unpacking"), ("unknown", "Unknown (gap)")


def states(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, n, i) for i, (s, n) in enumerate(STATES, 1)], "state string, state_name string, sort_order int")


# fixed values: the bands of the day
BANDS = ("peak", "Peak"), ("off_peak", "Off-peak")


def bands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(b, n, i) for i, (b, n) in enumerate(BANDS, 1)], "time_band string, band_name string, sort_order int")
