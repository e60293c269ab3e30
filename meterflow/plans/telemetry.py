"""Queries of the telemetry pipeline over whole test tables, with their SQL counterparts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Rules
from ..functions import calendar, electrics
from ..operators import daily, dimensions, intervals, market, measures, quality, realtime
from ..operators.asof import salted_left_join
from ..operators.dedup import BucketStore, measurements
from ..operators.history import plain
from ..session import scratch_path, table
from ..sources import readers
from ..store import TableStore

RULES = Rules()
LOOKBACK_S = 12 * 86400

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _nudged(text: str) -> str:
    """SQL whose every ``round(x, n)`` is ``round(x + 1e-9, n)``.

    Sums of decimals often lie exactly between two rounded values, where the last bit of a double decides. Both sides
    round a value that is moved off that point.
    """
    out, stack = [], []
    for i, c in enumerate(text):
        if c == "(":
            stack.append(text[max(0, i - 5) : i] == "round")
        elif c == ")":
            stack.pop()
        elif c == "," and stack and stack[-1]:
            out.append(" + 1e-9")
        out.append(c)
    return "".join(out)


def _round(value, digits: int):
    return F.round((F.col(value) if isinstance(value, str) else value) + 1e-9, digits)


# null for NaN: the values agree, but a comparison of results cannot tell one NaN from another
_REAL = "CASE WHEN NOT isnan({0}) THEN {0} END"


def _real(column: str):
    return F.when(~F.isnan(column), F.col(column)).alias(column)


def registry(queries: dict, counterparts: dict[str, str]):
    """A decorator that enters a query and its SQL under the function's name."""

    def query(sql: str | None = None):
        def register(f):
            queries[f.__name__] = f
            if sql is not None:
                counterparts[f.__name__] = _nudged(sql)
            return f

        return register

    return query


query = registry(QUERIES, SQL)


# --- shared relations ----------------------------------------------------------------------------------------------


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "meter_events")


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    return quality.checked(quality.deliveries(_events(spark, d)), RULES)


def _valid(spark: SparkSession, d: str) -> DataFrame:
    return quality.valid_readings(_events(spark, d), RULES)


def _deltas(spark: SparkSession, d: str) -> DataFrame:
    return intervals.counter_deltas(_valid(spark, d), RULES)


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return intervals.state_runs(_valid(spark, d), RULES)


def _master(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "machine_master")


def _mart(spark: SparkSession, d: str) -> DataFrame:
    """Hourly costs with the hall of their version: the star join of the mart."""
    halls = table(spark, d, "machine_versions").where("machine_sk is not null").groupBy("machine_sk").agg(F.max(plain("hall_id")).alias("hall"), F.max("machine_id").alias("machine_id"))
    costs = table(spark, d, "energy_cost_hourly").withColumn("yyyymm", F.expr("date_key div 100"))
    return salted_left_join(costs, halls, "machine_sk", "cost_id")


def _as_of(rows: DataFrame) -> datetime:
    """The newest measurement time: one value."""
    return rows.agg(F.max("ts_source")).first()[0] or datetime(1970, 1, 1)


_D = """
  d AS (SELECT ingest_id, machine_id, upper(trim(meter_id)) AS meter, seq, ts_source, ts_edge, state, job_id, power_kw,
               energy_kwh_total, opc_status, epoch_us(ts_source) AS us FROM meter_events),
  k AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY meter, us ORDER BY ts_edge NULLS LAST, ingest_id) AS rn FROM d)
        WHERE rn = 1)"""
_C = _D + """,
  n AS (SELECT ingest_id, lag(CASE WHEN opc_status <> 'Bad' THEN power_kw END) OVER w AS b,
               lead(CASE WHEN opc_status <> 'Bad' THEN power_kw END) OVER w AS a
        FROM k WHERE meter IS NOT NULL AND us IS NOT NULL WINDOW w AS (PARTITION BY meter ORDER BY us)),
  c AS (SELECT k.*, CASE
          WHEN machine_id IS NULL OR meter IS NULL OR us IS NULL OR state IS NULL OR power_kw IS NULL
            OR energy_kwh_total IS NULL OR isnan(energy_kwh_total) OR opc_status IS NULL THEN 'missing_value'
          WHEN opc_status = 'Bad' THEN 'bad_status'
          WHEN power_kw < 0 OR energy_kwh_total < 0 THEN 'negative_value'
          WHEN power_kw > 20 THEN 'implausible_power'
          WHEN power_kw > 2 AND b IS NOT NULL AND a IS NOT NULL AND power_kw > greatest(b, a) * 3 THEN 'spike' END AS dq_reason,
        opc_status = 'Uncertain' AS is_uncertain, epoch_us(ts_edge) - us > 300000000 AS is_late
        FROM k LEFT JOIN n USING (ingest_id))"""
_S = _C + """,
  s AS (SELECT * FROM c WHERE dq_reason IS NULL)"""
_L = _S + """,
  l0 AS (SELECT *, lag(us) OVER w AS prev_us, lag(energy_kwh_total) OVER w AS prev_kwh, lag(state) OVER w AS prev_state
         FROM s WINDOW w AS (PARTITION BY meter ORDER BY us)),
  l1 AS (SELECT *, (us - prev_us) / 1e6 AS interval_s, energy_kwh_total - prev_kwh AS step, (us - prev_us) / 1e6 * 20 / 3600 AS most FROM l0),
  l2 AS (SELECT *, coalesce(step < 0, false) AND energy_kwh_total <= most + 5 AS counter_reset,
                coalesce(interval_s > 300, false) AS is_gap FROM l1),
  l3 AS (SELECT *, (coalesce(step < 0, false) AND NOT counter_reset) OR coalesce(step > most, false) AS counter_discontinuity FROM l2),
  l AS (SELECT *, CASE WHEN NOT counter_discontinuity THEN CASE WHEN counter_reset THEN energy_kwh_total ELSE step END END AS delta_kwh,
               CASE WHEN is_gap THEN 'unknown' ELSE prev_state END AS interval_state FROM l3)"""
_B = _L + """,
  b0 AS (SELECT *, unnest(generate_series(prev_us // 900000000, (us - 1) // 900000000)) AS bucket FROM l
         WHERE delta_kwh IS NOT NULL AND us > prev_us),
  b AS (SELECT machine_id, meter, bucket * 900 AS bucket_epoch, interval_state AS state,
               delta_kwh * (least(us, (bucket + 1) * 900000000) - greatest(prev_us, bucket * 900000000)) / (us - prev_us) AS kwh,
               (least(us, (bucket + 1) * 900000000) - greatest(prev_us, bucket * 900000000)) / 1e6 AS seconds FROM b0)"""
_HERE = "timezone('Europe/Berlin', to_timestamp({0}))"
_KEY = "CAST(strftime(" + _HERE + ", '%Y%m%d') AS INTEGER)"
_BAND = f"""CASE WHEN isodow({_HERE.format('bucket_epoch')}) <= 5 AND hour({_HERE.format('bucket_epoch')}) >= 7
              AND hour({_HERE.format('bucket_epoch')}) < 20 THEN 'peak' ELSE 'off_peak' END"""
_SLOT = f"CAST(hour({_HERE.format('bucket_epoch')}) * 4 + minute({_HERE.format('bucket_epoch')}) // 15 AS INTEGER)"
_F = _B + f""",
  fe AS (SELECT machine_id, bucket_epoch, sum(kwh) AS kwh FROM b GROUP BY 1, 2),
  fp AS (SELECT machine_id, us // 900000000 * 900 AS bucket_epoch, avg(power_kw) AS avg_power_kw, max(power_kw) AS max_power_kw,
                count(*) AS readings, count(DISTINCT us // 60000000) AS minutes_covered FROM s GROUP BY 1, 2),
  f AS (SELECT machine_id, CAST(bucket_epoch AS BIGINT) AS bucket_epoch, {_KEY.format('bucket_epoch')} AS date_key, {_SLOT} AS slot_of_day,
               coalesce(kwh, 0.0::DOUBLE) AS kwh, avg_power_kw, max_power_kw, coalesce(readings, 0) AS readings,
               coalesce(minutes_covered, 0) AS minutes_covered, coalesce(minutes_covered, 0) / 15.0::DOUBLE AS completeness, {_BAND} AS time_band
        FROM fe FULL JOIN fp USING (machine_id, bucket_epoch))"""
_R = _L + """,
  r0 AS (SELECT *, CAST(coalesce(state <> lag(state) OVER w, true) AS INTEGER) AS changed, row_number() OVER w AS pos
         FROM l WINDOW w AS (PARTITION BY machine_id ORDER BY us, meter, ingest_id)),
  r1 AS (SELECT *, CAST(sum(changed) OVER (PARTITION BY machine_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_id FROM r0),
  r2 AS (SELECT machine_id, run_id, min(state) AS state, min(us) AS start_us, max(us) AS last_us, max(job_id) AS job_id, count(*) AS readings
         FROM r1 GROUP BY 1, 2),
  r3 AS (SELECT machine_id, run_id - changed AS run_id, sum(delta_kwh) AS kwh0, bool_or(is_gap) AS has_gap0 FROM r1 WHERE pos > 1 GROUP BY 1, 2),
  r4 AS (SELECT r2.*, kwh0, has_gap0, coalesce(lead(start_us) OVER w, last_us) AS end_us, lead(start_us) OVER w IS NULL AS is_open,
                lag(r2.run_id) OVER w IS NULL AS is_first, lag(state) OVER w AS prev_state, lead(state) OVER w AS next_state,
                lag(kwh0) OVER w AS prev_kwh, lead(kwh0) OVER w AS next_kwh, lead(job_id) OVER w AS next_job_id
         FROM r2 LEFT JOIN r3 ON r2.machine_id = r3.machine_id AND r2.run_id = r3.run_id
         WINDOW w AS (PARTITION BY r2.machine_id ORDER BY r2.run_id)),
  r AS (SELECT *, (end_us - start_us) / 3.6e9 AS duration_h, coalesce(kwh0, 0.0::DOUBLE) AS kwh, coalesce(has_gap0, false) AS has_gap FROM r4)"""


# --- readings ------------------------------------------------------------------------------------------------------


@query(f"WITH {_D} SELECT ingest_id, meter, coalesce(us, -1) AS us, {_REAL.format('power_kw')} AS power_kw, opc_status FROM k")
def dedup_first_arrival(spark, d):
    rows = quality.deduplicated(quality.deliveries(_events(spark, d)))
    return rows.select("ingest_id", "meter", F.coalesce(F.unix_micros("ts_source"), F.lit(-1)).alias("us"), _real("power_kw"), "opc_status")


@query(f"WITH {_C} SELECT ingest_id, dq_reason, is_uncertain, is_late FROM c")
def quality_flags(spark, d):
    return _flagged(spark, d).select("ingest_id", "dq_reason", "is_uncertain", "is_late")


@query(f"WITH {_C} SELECT dq_reason, count(*) AS readings FROM c WHERE dq_reason IS NOT NULL GROUP BY 1")
def quarantine_by_reason(spark, d):
    return quality.split(_flagged(spark, d))[1].groupBy("dq_reason").agg(F.count(F.lit(1)).alias("readings"))


@query(f"""WITH {_C} SELECT meter, count(*) FILTER (is_late) AS late, count(*) FILTER (is_uncertain) AS uncertain, count(*) AS readings
           FROM c WHERE dq_reason IS NULL GROUP BY 1""")
def late_and_uncertain(spark, d):
    return _valid(spark, d).groupBy("meter").agg(F.count_if("is_late").alias("late"), F.count_if("is_uncertain").alias("uncertain"), F.count(F.lit(1)).alias("readings"))


_LAST = "TIMESTAMPTZ '2016-03-25 00:00:00+00'"


@query(f"""WITH dd AS (SELECT * FROM (SELECT *, upper(trim(meter_id)) AS meter FROM meter_events)),
           bt AS (SELECT * FROM dd WHERE _ingested_at >= {_LAST}),
           sp AS (SELECT min(epoch_us(ts_source)) - 1800000000 AS lo, max(epoch_us(ts_source)) + 1800000000 AS hi FROM bt),
           un AS (SELECT * FROM bt UNION ALL SELECT dd.* FROM dd, sp WHERE (_ingested_at < {_LAST} OR _ingested_at IS NULL)
                  AND meter IN (SELECT meter FROM bt WHERE meter IS NOT NULL) AND epoch_us(ts_source) BETWEEN lo AND hi),
           {_C.replace('FROM meter_events)', 'FROM un)')}
           SELECT c.ingest_id, c.dq_reason FROM c WHERE EXISTS (SELECT 1 FROM bt WHERE bt.meter IS NOT DISTINCT FROM c.meter
             AND epoch_us(bt.ts_source) IS NOT DISTINCT FROM c.us)""")
def checked_batch(spark, d):
    """The rows ingested from a given time on as one increment, judged with earlier rows as context."""
    events = _events(spark, d)
    new = F.coalesce(F.unix_micros("_ingested_at") >= 1458864000000000, F.lit(False))
    good, bad = quality.checked_increment(quality.deliveries(events.where(new)), quality.deliveries(events.where(~new)), RULES)
    return good.select("ingest_id", F.lit(None).cast("string").alias("dq_reason")).unionByName(bad.select("ingest_id", "dq_reason"))


@query(f"""WITH {_L} SELECT ingest_id, interval_s, round(delta_kwh, 4) AS delta_kwh, counter_reset, counter_discontinuity, is_gap, interval_state FROM l""")
def energy_deltas(spark, d):
    return _deltas(spark, d).select("ingest_id", "interval_s", _round("delta_kwh", 4).alias("delta_kwh"), "counter_reset", "counter_discontinuity", "is_gap", "interval_state")


@query(f"""WITH {_L} SELECT meter, count(*) FILTER (counter_reset) AS resets, count(*) FILTER (counter_discontinuity) AS discontinuities,
           count(*) FILTER (is_gap) AS gaps, round(sum(delta_kwh), 3) AS kwh FROM l GROUP BY 1""")
def counter_events(spark, d):
    return _deltas(spark, d).groupBy("meter").agg(
        F.count_if("counter_reset").alias("resets"), F.count_if("counter_discontinuity").alias("discontinuities"),
        F.count_if("is_gap").alias("gaps"), _round(F.sum("delta_kwh"), 3).alias("kwh"),
    )


@query(f"WITH {_B} SELECT machine_id, CAST(bucket_epoch AS BIGINT) AS bucket_epoch, state, round(sum(kwh), 4) AS kwh, round(sum(seconds), 4) AS seconds FROM b GROUP BY 1, 2, 3")
def bucket_energy(spark, d):
    parts = intervals.in_buckets(_deltas(spark, d), RULES)
    return parts.groupBy("machine_id", "bucket_epoch", "state").agg(_round(F.sum("kwh"), 4).alias("kwh"), _round(F.sum("seconds"), 4).alias("seconds"))


_FACT = "machine_id, bucket_epoch, date_key, slot_of_day, round(kwh, 4) AS kwh, round(avg_power_kw, 4) AS avg_power_kw, max_power_kw, readings, minutes_covered, round(completeness, 6) AS completeness, time_band"


@query(f"WITH {_F} SELECT {_FACT} FROM f")
def fact_energy_15min(spark, d):
    return intervals.bucket_facts(_valid(spark, d), RULES).selectExpr(*_columns(_nudged(_FACT)))


@query(f"""WITH {_B} SELECT machine_id, {_KEY.format('bucket_epoch')} AS date_key, state, round(sum(seconds) / 3600, 4) AS hours, round(sum(kwh), 4) AS kwh
           FROM b GROUP BY 1, 2, 3""")
def state_energy_daily(spark, d):
    return intervals.state_days(_valid(spark, d), RULES).select("machine_id", "date_key", "state", _round("hours", 4).alias("hours"), _round("kwh", 4).alias("kwh"))


@query(f"""WITH {_B}, h AS (SELECT machine_id, state, sum(seconds) AS s FROM b GROUP BY 1, 2)
           SELECT machine_id, state, round(s / 3600, 3) AS hours, round(s / sum(s) OVER (PARTITION BY machine_id), 5) AS share FROM h""")
def state_share(spark, d):
    hours = intervals.state_days(_valid(spark, d), RULES).groupBy("machine_id", "state").agg(F.sum("hours").alias("hours"))
    return measures.share(hours, "hours", ["machine_id"], "share").select("machine_id", "state", _round("hours", 3).alias("hours"), _round("share", 5).alias("share"))


_RUN = "machine_id, run_id, state, start_us, end_us, last_us, job_id, readings, is_open, is_first, round(duration_h, 6) AS duration_h, round(kwh, 4) AS kwh, has_gap, prev_state, next_state, round(prev_kwh, 4) AS prev_kwh, round(next_kwh, 4) AS next_kwh, next_job_id"


def _columns(text: str) -> list[str]:
    """Split a select list at the commas outside parentheses."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


@query(f"WITH {_R} SELECT {_RUN} FROM r")
def state_runs(spark, d):
    return _runs(spark, d).selectExpr(*_columns(_nudged(_RUN)))


_WARM = "machine_id, job_id, start_us, end_us, round(duration_h, 6) AS duration_h, is_long, round(kwh, 4) AS kwh, has_gap"


@query(f"""WITH {_R} SELECT machine_id, CASE WHEN next_state = 'building' THEN next_job_id END AS job_id, start_us, end_us, round(duration_h, 6) AS duration_h,
           duration_h > 2.6 AND NOT has_gap AS is_long, round(kwh, 4) AS kwh, has_gap FROM r WHERE state = 'heat_up' AND NOT is_open AND NOT is_first""")
def heat_ups(spark, d):
    return intervals.warm_ups(_runs(spark, d), RULES).selectExpr(*_columns(_nudged(_WARM)))


_JOB = "job_id, machine_id, start_us, end_us, round(build_h, 6) AS build_h, round(build_kwh, 4) AS build_kwh, round(heatup_kwh, 4) AS heatup_kwh, round(cooldown_kwh, 4) AS cooldown_kwh, round(job_kwh, 4) AS job_kwh, round(kwh_per_build_hour, 4) AS kwh_per_build_hour, has_gap"
_J = _R + """,
  j AS (SELECT machine_id, job_id, start_us, end_us, duration_h AS build_h, kwh AS build_kwh,
               CASE WHEN prev_state = 'heat_up' THEN prev_kwh ELSE 0.0::DOUBLE END AS heatup_kwh,
               CASE WHEN next_state = 'cool_down' THEN next_kwh ELSE 0.0::DOUBLE END AS cooldown_kwh, has_gap,
               kwh / nullif(duration_h, 0) AS kwh_per_build_hour
        FROM r WHERE state = 'building' AND NOT is_open AND NOT is_first)"""


@query(f"WITH {_J} SELECT job_id, machine_id, start_us, end_us, round(build_h, 6) AS build_h, round(build_kwh, 4) AS build_kwh, round(heatup_kwh, 4) AS heatup_kwh, round(cooldown_kwh, 4) AS cooldown_kwh, round(build_kwh + heatup_kwh + cooldown_kwh, 4) AS job_kwh, round(kwh_per_build_hour, 4) AS kwh_per_build_hour, has_gap FROM j")
def build_jobs(spark, d):
    return intervals.jobs(_runs(spark, d)).selectExpr(*_columns(_nudged(_JOB)))


@query(f"""WITH {_J} SELECT machine_id, count(*) AS jobs, round(sum(build_h), 4) AS build_h, round(sum(build_kwh) / nullif(sum(build_h), 0), 4) AS kwh_per_build_h
           FROM j GROUP BY 1""")
def job_kpis(spark, d):
    j = intervals.jobs(_runs(spark, d)).groupBy("machine_id")
    return j.agg(F.count(F.lit(1)).alias("jobs"), _round(F.sum("build_h"), 4).alias("build_h"), _round(F.try_divide(F.sum("build_kwh"), F.sum("build_h")), 4).alias("kwh_per_build_h"))


# --- daily quality and coverage ------------------------------------------------------------------------------------

_DAY = _KEY.format("us / 1e6")
_Q = _L + f""",
  qa AS (SELECT meter, {_DAY} AS date_key, count(*) AS events_received FROM d WHERE meter IS NOT NULL AND us IS NOT NULL GROUP BY 1, 2),
  qm AS (SELECT meter, {_DAY} AS date_key, count(*) AS measurements,
           count(*) FILTER (dq_reason = 'missing_value') AS rejected_missing_value, count(*) FILTER (dq_reason = 'bad_status') AS rejected_bad_status,
           count(*) FILTER (dq_reason = 'negative_value') AS rejected_negative_value, count(*) FILTER (dq_reason = 'implausible_power') AS rejected_implausible_power,
           count(*) FILTER (dq_reason = 'spike') AS rejected_spike FROM c WHERE meter IS NOT NULL AND us IS NOT NULL GROUP BY 1, 2),
  qv AS (SELECT meter, {_DAY} AS date_key, count(*) AS valid_readings, count(*) FILTER (is_uncertain) AS uncertain_readings,
           count(*) FILTER (is_late) AS late_events, count(*) FILTER (is_gap) AS gaps, sum(interval_s) FILTER (is_gap) / 60 AS gap_minutes,
           count(*) FILTER (counter_reset) AS counter_resets, count(*) FILTER (counter_discontinuity) AS counter_discontinuities,
           count(DISTINCT us // 60000000) AS minutes_covered FROM l GROUP BY 1, 2),
  q AS (SELECT qa.meter, qa.date_key, events_received, measurements, coalesce(valid_readings, 0) AS valid_readings,
          coalesce(uncertain_readings, 0) AS uncertain_readings, coalesce(late_events, 0) AS late_events, coalesce(gaps, 0) AS gaps,
          coalesce(gap_minutes, 0.0::DOUBLE) AS gap_minutes, coalesce(counter_resets, 0) AS counter_resets,
          coalesce(counter_discontinuities, 0) AS counter_discontinuities, coalesce(minutes_covered, 0) AS minutes_covered,
          rejected_missing_value, rejected_bad_status, rejected_negative_value, rejected_implausible_power, rejected_spike,
          events_received - measurements AS duplicates_removed
        FROM qa JOIN qm USING (meter, date_key) LEFT JOIN qv USING (meter, date_key))"""


def _daily(spark, d):
    rows = quality.deliveries(_events(spark, d))
    return daily.daily_quality(rows, quality.checked(rows, RULES), RULES)


@query(f"WITH {_Q} SELECT * REPLACE (round(gap_minutes, 4) AS gap_minutes), round(minutes_covered / 1440, 6) AS completeness FROM q")
def dq_daily(spark, d):
    return _daily(spark, d).withColumns({"gap_minutes": _round("gap_minutes", 4), "completeness": _round(F.col("minutes_covered") / 1440, 6)})


@query(f"""WITH {_C} SELECT meter, count(*) FILTER (dq_reason = 'missing_value') AS rejected_missing_value, count(*) FILTER (dq_reason = 'bad_status') AS rejected_bad_status,
           count(*) FILTER (dq_reason = 'negative_value') AS rejected_negative_value, count(*) FILTER (dq_reason = 'implausible_power') AS rejected_implausible_power,
           count(*) FILTER (dq_reason = 'spike') AS rejected_spike FROM c WHERE dq_reason IS NOT NULL GROUP BY 1""")
def dq_pivot(spark, d):
    return daily.rejected_by_reason(quality.split(_flagged(spark, d))[1], "meter")


_P = "CASE WHEN upper(trim({0})) NOT IN ('', 'N/A') THEN upper(trim({0})) END"
_V = f"""
  v0 AS (SELECT upper(trim(machine_id)) AS machine_id, exported_at,
           coalesce(try_strptime(trim(snapshot_date), '%Y-%m-%d'), try_strptime(trim(snapshot_date), '%Y%m%d'), try_strptime(trim(snapshot_date), '%d.%m.%Y')) AS day,
           {_P.format('hall_id')} AS hall_id, {_P.format('meter_id')} AS meter_id, {_P.format('meter_serial')} AS meter_serial FROM machine_master WHERE machine_id IS NOT NULL),
  v1 AS (SELECT *, row_number() OVER (PARTITION BY machine_id, day ORDER BY exported_at DESC NULLS LAST, hall_id DESC NULLS LAST,
           meter_id DESC NULLS LAST, meter_serial DESC NULLS LAST) AS rn FROM v0 WHERE day IS NOT NULL),
  v2 AS (SELECT *, lag(day) OVER w IS NULL OR lag(hall_id) OVER w IS DISTINCT FROM hall_id OR lag(meter_id) OVER w IS DISTINCT FROM meter_id
           OR lag(meter_serial) OVER w IS DISTINCT FROM meter_serial AS begins FROM v1 WHERE rn = 1 WINDOW w AS (PARTITION BY machine_id ORDER BY day)),
  v3 AS (SELECT *, lead(day) OVER (PARTITION BY machine_id ORDER BY day) AS nx FROM v2 WHERE begins),
  v AS (SELECT machine_id || '_' || strftime(day, '%Y%m%d') AS machine_sk, machine_id, hall_id, meter_id, meter_serial,
               epoch_us(day) AS from_us, epoch_us(nx) AS to_us, nx IS NULL AS is_current FROM v3)"""


@query(f"""WITH {_Q}, {_V},
  days AS (SELECT CAST(unnest(generate_series(min(strptime(date_key::VARCHAR, '%Y%m%d')), max(strptime(date_key::VARCHAR, '%Y%m%d')), INTERVAL 1 DAY)) AS DATE) AS dt FROM q),
  g AS (SELECT machine_sk, machine_id, meter_id AS meter, CAST(strftime(dt, '%Y%m%d') AS INTEGER) AS date_key FROM v, days
        WHERE epoch_us(dt::TIMESTAMP) + 43200000000 >= from_us AND (to_us IS NULL OR epoch_us(dt::TIMESTAMP) + 43200000000 < to_us))
  SELECT machine_sk, machine_id, meter, date_key, CAST(1440 AS INTEGER) AS expected_minutes, coalesce(events_received, 0) AS events_received,
         coalesce(valid_readings, 0) AS valid_readings, coalesce(minutes_covered, 0) AS minutes_covered, round(coalesce(minutes_covered, 0) / 1440, 6) AS completeness
  FROM g LEFT JOIN q USING (meter, date_key)""")
def coverage_grid(spark, d):
    daily_rows = _daily(spark, d)
    day = F.to_date(F.col("date_key").cast("string"), "yyyyMMdd")
    days = daily_rows.select(day.alias("date"))
    grid = dimensions.coverage(daily_rows, dimensions.versions_of(_master(spark, d)), days)
    return grid.select("machine_sk", "machine_id", "meter", "date_key", "expected_minutes", "events_received", "valid_readings", "minutes_covered", _round("completeness", 6).alias("completeness"))


@query(f"""WITH {_Q} SELECT meter, CAST(date_key // 100 AS BIGINT) AS month, round(sum(minutes_covered) / 1440, 4) AS days_covered FROM q GROUP BY 1, 2""")
def coverage_by_month(spark, d):
    """Days' worth of covered minutes per meter and month."""
    months = _daily(spark, d).groupBy("meter", F.expr("date_key div 100").alias("month"))
    return months.agg(_round(F.sum("minutes_covered") / 1440, 4).alias("days_covered"))


# --- dimensions ----------------------------------------------------------------------------------------------------


@query("""SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, strftime(d, '%Y-%m-%d') AS date, CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter,
          CAST(month(d) AS INTEGER) AS month, monthname(d) AS month_name, strftime(d, '%Y-%m') AS year_month, CAST(week(d) AS INTEGER) AS iso_week,
          CAST(isodow(d) AS INTEGER) AS iso_weekday, dayname(d) AS weekday_name, isodow(d) >= 6 AS is_weekend
          FROM (SELECT unnest(generate_series(TIMESTAMP '2016-01-01', TIMESTAMP '2017-12-31', INTERVAL 1 DAY)) AS d)""")
def dim_date(spark, d):
    return calendar.dates(spark, "2016-01-01", "2017-12-31").withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query("""SELECT CAST(s AS INTEGER) AS slot_of_day, lpad((s // 4)::VARCHAR, 2, '0') || ':' || lpad((s % 4 * 15)::VARCHAR, 2, '0') AS slot_label,
          CAST(s // 4 AS INTEGER) AS hour, s // 4 >= 7 AND s // 4 < 20 AS is_peak_hours FROM (SELECT unnest(generate_series(0, 95)) AS s)""")
def dim_time_slot(spark, d):
    return calendar.time_slots(spark, RULES)


@query("""SELECT * FROM (VALUES ('off', 'Off', 1), ('idle', 'Idle', 2), ('heat_up', 'Heat-up', 3), ('building', 'Building', 4), ('cool_down', 'Cool-down', 5),
          ('unpacking', 'Unpacking', 6), ('unknown', 'Unknown (gap)', 7)) t(state, state_name, sort_order)""")
def dim_state(spark, d):
    return calendar.states(spark)


@query(f"WITH {_V} SELECT machine_sk, machine_id, hall_id, meter_id, meter_serial, from_us, to_us, is_current FROM v")
def scd2_versions(spark, d):
    return dimensions.versions_of(_master(spark, d)).select(
        "machine_sk", "machine_id", *dimensions.TRACKED, F.unix_micros("valid_from").alias("from_us"), F.unix_micros("valid_to").alias("to_us"), "is_current"
    )


_OLD = _V.replace("FROM machine_master WHERE machine_id IS NOT NULL)", "FROM machine_master WHERE machine_id IS NOT NULL AND exported_at < TIMESTAMPTZ '2016-10-01 00:00:00+00')")


@query(f"""WITH {_OLD}, s AS ({'SELECT machine_id, hall_id, meter_id, meter_serial FROM (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY day DESC) AS r FROM (WITH ' + _V + ' SELECT * FROM v1 WHERE rn = 1)) WHERE r = 1'}),
  x AS (SELECT v.*, s.machine_id IS NOT NULL AND is_current AND (s.hall_id IS DISTINCT FROM v.hall_id OR s.meter_id IS DISTINCT FROM v.meter_id
          OR s.meter_serial IS DISTINCT FROM v.meter_serial) AS differs FROM v LEFT JOIN s USING (machine_id))
  SELECT machine_sk, machine_id, hall_id, meter_id, meter_serial, from_us, CASE WHEN differs THEN 1493596800000000 ELSE to_us END AS to_us, is_current AND NOT differs AS is_current FROM x
  UNION ALL
  SELECT s.machine_id || '_20170501', s.machine_id, s.hall_id, s.meter_id, s.meter_serial, 1493596800000000, NULL, true
  FROM s LEFT JOIN (SELECT * FROM v WHERE is_current) c ON s.machine_id = c.machine_id
  WHERE c.machine_id IS NULL OR s.hall_id IS DISTINCT FROM c.hall_id OR s.meter_id IS DISTINCT FROM c.meter_id OR s.meter_serial IS DISTINCT FROM c.meter_serial""")
def scd2_apply(spark, d):
    """History of the exports before October 2016, merged with the newest state of every machine as one more snapshot."""
    old = dimensions.versions_of(_master(spark, d).where(F.unix_micros("exported_at") < 1475280000000000))
    newest = dimensions.current_only(dimensions.versions_of(_master(spark, d)))
    out = dimensions.merged_versions(old, newest.select("machine_id", *dimensions.TRACKED), datetime(2017, 5, 1))
    return out.select("machine_sk", "machine_id", *dimensions.TRACKED, F.unix_micros("valid_from").alias("from_us"), F.unix_micros("valid_to").alias("to_us"), "is_current")


@query(f"""WITH {_F}, {_V} SELECT f.machine_id, f.bucket_epoch, round(f.kwh, 4) AS kwh, v.machine_sk FROM f LEFT JOIN v ON v.machine_id = f.machine_id
           AND f.bucket_epoch * 1000000 >= from_us AND (to_us IS NULL OR f.bucket_epoch * 1000000 < to_us)""")
def version_asof(spark, d):
    facts = intervals.bucket_facts(_valid(spark, d), RULES)
    keyed = dimensions.with_version(facts, dimensions.versions_of(_master(spark, d)), F.timestamp_seconds("bucket_epoch"))
    return keyed.select("machine_id", "bucket_epoch", _round("kwh", 4).alias("kwh"), "machine_sk")


@query(f"""WITH {_V} SELECT hall_id, count(*) AS versions, count(*) FILTER (is_current) AS current_versions, count(DISTINCT machine_id) AS machines FROM v GROUP BY 1""")
def versions_by_hall(spark, d):
    return dimensions.versions_of(_master(spark, d)).groupBy("hall_id").agg(
        F.count(F.lit(1)).alias("versions"), F.count_if("is_current").alias("current_versions"), F.count_distinct("machine_id").alias("machines")
    )


# --- real time -----------------------------------------------------------------------------------------------------

_T = _D + """,
  t AS (SELECT * FROM k WHERE meter IS NOT NULL AND us IS NOT NULL), mx AS (SELECT max(us) AS m FROM t)"""


def _kept(spark, d):
    return quality.deduplicated(quality.deliveries(_events(spark, d))).where("meter is not null and ts_source is not null")


@query(f"""WITH {_T} SELECT machine_id, (arg_max({{'s': state, 'p': power_kw, 'j': job_id, 'o': opc_status}}, (us, ingest_id)))['s'] AS state,
           (arg_max({{'s': state, 'p': power_kw}}, (us, ingest_id)))['p'] AS power_kw, (arg_max({{'s': state, 'j': job_id}}, (us, ingest_id)))['j'] AS job_id,
           (arg_max({{'s': state, 'o': opc_status}}, (us, ingest_id)))['o'] AS opc_status, max(us) AS last_us,
           (max(m) - max(us)) // 1000000 AS age_s FROM t, mx WHERE machine_id IS NOT NULL GROUP BY machine_id""")
def current_state(spark, d):
    return realtime.latest(_kept(spark, d), _as_of(_events(spark, d)))


_RR = _T + f""",
  w0 AS (SELECT machine_id, ingest_id, state, us FROM t, mx WHERE us > m - {LOOKBACK_S}000000 AND machine_id IS NOT NULL),
  w1 AS (SELECT *, CAST(lag(us) OVER w IS NULL OR state IS DISTINCT FROM lag(state) OVER w AS INTEGER) AS nw FROM w0
         WINDOW w AS (PARTITION BY machine_id ORDER BY us, ingest_id)),
  w2 AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY machine_id ORDER BY us, ingest_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_id FROM w1),
  rr AS (SELECT machine_id, run_id, min(us) AS start_us, max(us) AS last_us, min(state) AS state, count(*) AS readings,
                round((max(us) - min(us)) / 3.6e9 / 1.0, 2) AS duration_h FROM w2 GROUP BY 1, 2)"""


@query(f"WITH {_RR} SELECT * FROM rr")
def recent_runs(spark, d):
    return realtime.recent_runs(_kept(spark, d), _as_of(_events(spark, d)), LOOKBACK_S)


_RS = _RR + f""",
  ho AS (SELECT *, run_id = max(run_id) OVER (PARTITION BY machine_id) AS is_running FROM rr),
  hp AS (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY start_us DESC) AS rn FROM ho WHERE state = 'building'),
  hq AS (SELECT hp.* FROM hp, mx WHERE rn = 1 AND (is_running OR last_us > m - 86400000000)),
  cs AS (SELECT machine_id, arg_max(state, (us, ingest_id)) FILTER (true) AS st, max(us) AS lu FROM t WHERE machine_id IS NOT NULL GROUP BY 1)"""


@query(f"""WITH {_RS} SELECT cs.machine_id, hq.start_us, coalesce(hq.duration_h, 0.0::DOUBLE) AS duration_h, coalesce(is_running, false) AS is_running,
           coalesce(hq.duration_h, 0.0::DOUBLE) > 2.6 AS alert, cs.lu AS last_us FROM cs LEFT JOIN hq USING (machine_id)""")
def run_status(spark, d):
    out = realtime.run_status(_kept(spark, d), _as_of(_events(spark, d)), LOOKBACK_S, "building", RULES.long_run_h, 86400)
    return out.select("machine_id", "start_us", "duration_h", "is_running", "alert", "last_us")


@query(f"""WITH {_C}, p AS (SELECT machine_id, us AS poll, ingest_id, coalesce(power_kw > 10, false) AS alert FROM c WHERE machine_id IS NOT NULL AND us IS NOT NULL AND meter IS NOT NULL),
           x AS (SELECT *, lag(alert, 1, false) OVER (PARTITION BY machine_id ORDER BY poll) AS was FROM p) SELECT machine_id, poll FROM x WHERE alert AND NOT was""")
def alert_transitions(spark, d):
    """Readings at which the power of a machine begins to exceed 10 kW."""
    polls = _kept(spark, d).where("machine_id is not null").select("machine_id", F.unix_micros("ts_source").alias("poll"), F.coalesce(F.col("power_kw") > 10, F.lit(False)).alias("alert"))
    return realtime.transitions(polls).select("machine_id", "poll")


@query(f"""WITH {_D} SELECT meter, ingest_id, row_number() OVER (PARTITION BY meter ORDER BY epoch_us(ts_edge), ingest_id) - 1 AS arrival_no
           FROM d WHERE meter IS NOT NULL AND ts_edge IS NOT NULL""")
def arrival_numbers(spark, d):
    return realtime.arrival_numbers(quality.deliveries(_events(spark, d)))


@query(f"WITH {_D} SELECT ingest_id, epoch_us(ts_edge) AS edge_us FROM d WHERE ts_edge IS NOT NULL ORDER BY ts_edge DESC, ingest_id DESC LIMIT 50")
def newest_deliveries(spark, d):
    """Top-k report: the fifty newest deliveries."""
    return realtime.newest_first_out(quality.deliveries(_events(spark, d)), 50).select("ingest_id", F.unix_micros("ts_edge").alias("edge_us"))


@query(f"""WITH {_T}, a AS (SELECT machine_id, us // 900000000 * 900 AS window_epoch, avg(power_kw) AS kw FROM t
             WHERE machine_id IS NOT NULL AND power_kw IS NOT NULL AND NOT isnan(power_kw) GROUP BY 1, 2)
           SELECT CAST(window_epoch AS BIGINT) AS window_epoch, round(sum(kw), 3) AS park_kw, count(*) AS machines FROM a GROUP BY 1""")
def park_power(spark, d):
    return realtime.park_power(_kept(spark, d), 900).select("window_epoch", _round("park_kw", 3).alias("park_kw"), "machines")


@query(f"""WITH {_D}, mx AS (SELECT max(us) AS m FROM d), x AS (SELECT *, (epoch_us(ts_edge) - us) / 1e6 AS lat FROM d, mx WHERE us > m - {LOOKBACK_S}000000 AND meter IS NOT NULL)
           SELECT count(*) AS events, count(DISTINCT (meter, us)) AS measurements, count(*) - count(DISTINCT (meter, us)) AS duplicates, max(us) AS last_us,
           (max(m) - max(us)) // 1000000 AS age_s, round(quantile_disc(lat, 0.5), 1) AS p50_latency_s, round(quantile_disc(lat, 0.95), 1) AS p95_latency_s FROM x""")
def freshness(spark, d):
    out = realtime.freshness(quality.deliveries(_events(spark, d)), _as_of(_events(spark, d)), LOOKBACK_S)
    return out.withColumns({c: _round(c, 1) for c in ("p50_latency_s", "p95_latency_s")})


_FIELDS = ["l1_a", "l2_a", "l3_a", "voltage_v", "power_kw"]


@query(f"""SELECT upper(trim(meter_id)) AS meter, epoch_us(ts_source) AS us, max(l1_a) AS l1_a, max(l2_a) AS l2_a, max(l3_a) AS l3_a, max(voltage_v) AS voltage_v,
           {_REAL.format('max(power_kw)')} AS power_kw, CASE max(CASE opc_status WHEN 'Good' THEN 0 WHEN 'Uncertain' THEN 1 ELSE 2 END) WHEN 0 THEN 'Good' WHEN 1 THEN 'Uncertain' ELSE 'Bad' END AS status
           FROM meter_events WHERE meter_id IS NOT NULL AND ts_source IS NOT NULL AND opc_status IS NOT NULL GROUP BY 1, 2
           HAVING {' AND '.join(f'count({f}) > 0' for f in _FIELDS)}""")
def assembled_readings(spark, d):
    """Readings unfolded into single points and assembled again; those without all points are left out."""
    rows = measurements(_events(spark, d), *_FIELDS, "opc_status").where("opc_status is not null")
    points = rows.select("meter", F.unix_micros("ts_source").alias("us"), F.col("opc_status").alias("status"),
                         F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in _FIELDS])).alias("p")).select("meter", "us", "status", "p.*").where("value is not null")
    return realtime.assembled(points, _FIELDS).withColumn("power_kw", _real("power_kw"))


# --- market and measures -------------------------------------------------------------------------------------------

_PRICES = """
  p AS (SELECT 1456790400 + h * 3600 AS hour_epoch, CASE WHEN h % 50 <> 0 THEN (h * 37) % 200 - 20 END::DOUBLE AS eur_mwh
        FROM (SELECT unnest(generate_series({0}, {1})) AS h))"""
_SPAN = [f"(SELECT ({f}(epoch_us(ts_source)) // 3600000000 - 404664) // 1500 * 1500 + {n} FROM meter_events)" for f, n in (("min", 0), ("max", 1499))]


_FIRST_HOUR, _DOC_HOURS = 1456790400 // 3600, 1500


def _prices(spark, first: int = 0, last: int = 0):
    """Price documents as a service would return them: two parallel arrays of 1,500 hours, some prices null.

    Document 0 begins on 2016-03-01; ``first`` to ``last`` are the numbers of the documents asked for.
    """
    h = F.sequence(F.col("id") * _DOC_HOURS, F.col("id") * _DOC_HOURS + _DOC_HOURS - 1)
    body = F.to_json(
        F.struct(
            F.transform(h, lambda x: (x + _FIRST_HOUR) * 3600).alias("unix_seconds"),
            F.transform(h, lambda x: F.when(x % 50 != 0, (F.pmod(x * 37, F.lit(200)) - 20).cast("double"))).alias("price"),
        )
    )
    return market.price_series(spark.range(first, last + 1).select(body.alias("body")))


def _prices_of(spark, d):
    """Prices of all hours from the first to the last measurement: two values."""
    span = _events(spark, d).agg(*[F.unix_micros(f("ts_source")).alias(n) for n, f in (("first", F.min), ("last", F.max))]).first()
    number = lambda us: 0 if us is None else (us // 3_600_000_000 - _FIRST_HOUR) // _DOC_HOURS
    return _prices(spark, number(span["first"]), number(span["last"]))


@query(f"WITH {_PRICES.format(0, 1499)} SELECT CAST(hour_epoch AS BIGINT) AS hour_epoch, 'CH' AS zone, eur_mwh FROM p")
def prices_from_json(spark, d):
    return _prices(spark)


@query(f"""WITH {_F}, {_V}, {_PRICES.format(*_SPAN)}, fk AS (SELECT f.*, v.machine_sk FROM f JOIN v ON v.machine_id = f.machine_id AND f.bucket_epoch * 1000000 >= from_us
             AND (to_us IS NULL OR f.bucket_epoch * 1000000 < to_us)),
           hh AS (SELECT machine_sk, CAST(bucket_epoch // 3600 * 3600 AS BIGINT) AS hour_epoch, min(date_key) AS date_key, CAST(min(slot_of_day // 4) AS INTEGER) AS hour_local, sum(kwh) AS kwh FROM fk GROUP BY 1, 2)
           SELECT machine_sk, hour_epoch, date_key, hour_local, round(kwh, 4) AS kwh, eur_mwh, round(kwh * eur_mwh / 1000, 5) + 0.0 AS cost_spot FROM hh LEFT JOIN p USING (hour_epoch)""")
def hourly_mart(spark, d):
    facts = intervals.bucket_facts(_valid(spark, d), RULES)
    keyed = dimensions.with_version(facts, dimensions.versions_of(_master(spark, d)), F.timestamp_seconds("bucket_epoch"))
    out = market.hourly(keyed, _prices_of(spark, d))
    return out.select("machine_sk", "hour_epoch", "date_key", F.col("hour_local").cast("int").alias("hour_local"), _round("kwh", 4).alias("kwh"), "eur_mwh", (_round("cost_spot", 5) + 0.0).alias("cost_spot"))


@query("""WITH h AS (SELECT hour_start_utc, CAST(date_key // 100 AS INTEGER) AS yyyymm, sum(kwh) AS kwh, sum(cost_spot_eur) AS cost, max(spot_eur_mwh) AS price
                     FROM energy_cost_hourly GROUP BY 1, 2)
          SELECT CAST(yyyymm AS BIGINT) AS yyyymm, round(sum(kwh), 3) AS kwh, round(sum(cost), 3) AS cost_spot_eur, round(sum(cost) * 1000 / nullif(sum(kwh), 0), 3) AS load_weighted,
                 round(avg(price), 3) AS time_weighted FROM h GROUP BY 1""")
def price_by_month(spark, d):
    out = market.monthly_prices(table(spark, d, "energy_cost_hourly"))
    return out.select("yyyymm", *[_round(c, 3).alias(c) for c in ("kwh", "cost_spot_eur", "load_weighted", "time_weighted")])


_M = """
  hl AS (SELECT machine_sk, max(CASE WHEN upper(trim(hall_id)) NOT IN ('', 'N/A') THEN upper(trim(hall_id)) END) AS hall, max(machine_id) AS machine_id
         FROM machine_versions WHERE machine_sk IS NOT NULL GROUP BY 1),
  m AS (SELECT e.*, hall, machine_id, CAST(date_key // 100 AS BIGINT) AS yyyymm FROM energy_cost_hourly e LEFT JOIN hl USING (machine_sk))"""
_ROUND = {"energy_kwh": 3, "energy_cost": 3, "market_cost": 3, "price_per_kwh": 5, "load_price": 4, "mean_power_kw": 4, "kwh_negative": 3, "night_kwh": 3}


def _model(spark, d) -> measures.Model:
    return measures.Model({"hourly": _mart(spark, d)}, measures.HOURLY)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[_round(c, _ROUND[c]).alias(c) if c in _ROUND else F.col(c) for c in df.columns])


_ALL = """round(sum(kwh), 3) AS energy_kwh, round(sum(cost_tou_eur), 3) AS energy_cost, round(sum(cost_spot_eur), 3) AS market_cost,
  round(sum(cost_tou_eur) / nullif(sum(kwh), 0), 5) AS price_per_kwh, round(sum(cost_spot_eur) * 1000 / nullif(sum(kwh), 0), 4) AS load_price,
  count(DISTINCT hour_start_utc) FILTER (spot_eur_mwh < 0) AS negative_hours, round(sum(kwh) FILTER (spot_eur_mwh < 0), 3) AS kwh_negative,
  round(sum(kwh) / nullif(count(DISTINCT hour_start_utc), 0), 4) AS mean_power_kw, round(sum(kwh) FILTER (hour_local < 6 OR hour_local >= 22), 3) AS night_kwh"""


@query(f"WITH {_M} SELECT {_ALL} FROM m")
def measures_kpis(spark, d):
    return _rounded(_model(spark, d).evaluate([m.name for m in measures.HOURLY]))


@query(f"WITH {_M} SELECT yyyymm, hall, {_ALL} FROM m GROUP BY 1, 2")
def measures_by_month_hall(spark, d):
    return _rounded(_model(spark, d).evaluate([m.name for m in measures.HOURLY], ["yyyymm", "hall"]))


@query(f"""WITH {_M} SELECT machine_id, round(sum(kwh) FILTER (hour_local BETWEEN 8 AND 17), 3) AS energy_kwh, round(sum(kwh) FILTER (hour_local < 6 OR hour_local >= 22), 3) AS night_kwh
           FROM m WHERE hall = 'H1' GROUP BY 1""")
def measures_filtered(spark, d):
    """A filter on the hour applies to the plain measure; the night measure replaces it with its own."""
    filters = {"hour_local": lambda c: c.between(8, 17), "hall": lambda c: c == "H1"}
    return _rounded(_model(spark, d).evaluate(["energy_kwh", "night_kwh"], ["machine_id"], filters))


@query(f"""WITH {_M}, a AS (SELECT hall, yyyymm, sum(kwh) AS kwh FROM m GROUP BY 1, 2), b AS (SELECT *, yyyymm // 100 * 12 + yyyymm % 100 AS n FROM a)
           SELECT x.hall, x.yyyymm, round(x.kwh, 3) AS kwh, round(y.kwh, 3) AS kwh_pm, round((x.kwh - y.kwh) / nullif(y.kwh, 0), 5) AS kwh_vs_pm
           FROM b x LEFT JOIN b y ON x.hall IS NOT DISTINCT FROM y.hall AND y.n = x.n - 1""")
def energy_vs_previous_month(spark, d):
    months = _mart(spark, d).groupBy("hall", "yyyymm").agg(F.sum("kwh").alias("kwh"))
    out = measures.against_previous(months, "yyyymm", "kwh", ["hall"])
    return out.select("hall", "yyyymm", _round("kwh", 3).alias("kwh"), _round("kwh_pm", 3).alias("kwh_pm"), _round("kwh_vs_pm", 5).alias("kwh_vs_pm"))


@query(f"""WITH {_M}, h AS (SELECT hour_local, hour_start_utc, max(spot_eur_mwh) AS p, sum(kwh) AS kwh FROM m GROUP BY 1, 2)
           SELECT hour_local, round(avg(p), 4) AS market_price, round(sum(kwh) / count(*), 4) AS mean_power_kw FROM h GROUP BY 1""")
def hourly_profile(spark, d):
    mart = _mart(spark, d)
    power = _model(spark, d).evaluate(["mean_power_kw"], ["hour_local"])
    return power.join(measures.time_weighted_price(mart, "hour_local"), "hour_local").select("hour_local", _round("market_price", 4).alias("market_price"), _round("mean_power_kw", 4).alias("mean_power_kw"))


@query(f"""WITH {_M}, l AS (SELECT machine_id, sum(cost_spot_eur) * 1000 / nullif(sum(kwh), 0) AS lp FROM m GROUP BY 1),
           t AS (SELECT machine_id, avg(p) AS tp FROM (SELECT machine_id, hour_start_utc, max(spot_eur_mwh) AS p FROM m GROUP BY 1, 2) GROUP BY 1)
           SELECT machine_id, round(lp / nullif(tp, 0) - 1, 5) AS premium FROM l JOIN t USING (machine_id)""")
def premium_by_machine(spark, d):
    mart = _mart(spark, d)
    load = _model(spark, d).evaluate(["load_price"], ["machine_id"])
    both = load.join(measures.time_weighted_price(mart, "machine_id"), "machine_id")
    return both.select("machine_id", _round(F.try_divide("load_price", "market_price") - 1, 5).alias("premium"))


@query(f"""WITH {_M} SELECT machine_sk, round(sum(kwh), 3) AS kwh FROM m WHERE hall = 'H1' GROUP BY 1""")
def hall_visible(spark, d):
    """What a reader restricted to one hall sees of the mart."""
    dim = table(spark, d, "machine_versions").where("machine_sk is not null").groupBy("machine_sk").agg(F.max(plain("hall_id")).alias("hall"))
    seen = dimensions.visible_to(table(spark, d, "energy_cost_hourly"), dim, F.col("hall") == "H1")
    return seen.groupBy("machine_sk").agg(_round(F.sum("kwh"), 3).alias("kwh"))


@query(f"""WITH {_M}, s AS (SELECT machine_id, sum(kwh) AS kwh FROM m GROUP BY 1) SELECT machine_id, round(kwh, 3) AS kwh FROM s ORDER BY s.kwh DESC NULLS LAST, machine_id NULLS LAST LIMIT 10""")
def top_machines(spark, d):
    """Top-k report: the ten machines with the most energy."""
    sums = _mart(spark, d).groupBy("machine_id").agg(F.sum("kwh").alias("kwh"))
    return sums.orderBy(F.col("kwh").desc_nulls_last(), F.col("machine_id").asc_nulls_last()).limit(10).select("machine_id", _round("kwh", 3).alias("kwh"))


# --- functions -----------------------------------------------------------------------------------------------------


@query("""WITH h AS (SELECT ts, timezone('Europe/Berlin', to_timestamp(ts)) AS l FROM (SELECT unnest(generate_series(1458950400, 1459209600, 1800)) AS ts
          UNION ALL SELECT unnest(generate_series(1477699200, 1477958400, 1800))))
          SELECT CAST(ts AS BIGINT) AS epoch, CAST(strftime(l, '%Y%m%d') AS INTEGER) AS date_key, CAST(hour(l) * 4 + minute(l) // 15 AS INTEGER) AS slot_of_day,
                 CASE WHEN isodow(l) <= 5 AND hour(l) >= 7 AND hour(l) < 20 THEN 'peak' ELSE 'off_peak' END AS time_band, strftime(to_timestamp(ts)::TIMESTAMPTZ AT TIME ZONE 'UTC', '%Y%m%dT%H%M') AS compact FROM h""")
def local_time_dst(spark, d):
    """Half hours around both changes of the clock."""
    hours = spark.range(1458950400, 1459209601, 1800).union(spark.range(1477699200, 1477958401, 1800))
    ts = F.timestamp_seconds("id")
    here = calendar.local(ts, RULES)
    return hours.select(F.col("id").alias("epoch"), calendar.day_key(here).alias("date_key"), calendar.slot_of_day(here).alias("slot_of_day"), calendar.time_band(here, RULES).alias("time_band"), calendar.compact_id(ts).alias("compact"))


@query(f"""SELECT ingest_id, round(sqrt(3.0::DOUBLE) * voltage_v * (l1_a + l2_a + l3_a) / 3 * power_factor / 1000, 4) AS computed_kw, {_REAL.format('power_kw')} AS power_kw
          FROM meter_events WHERE power_factor IS NOT NULL AND voltage_v IS NOT NULL AND l1_a IS NOT NULL AND l2_a IS NOT NULL AND l3_a IS NOT NULL""")
def electrics_check(spark, d):
    rows = _events(spark, d).where(" and ".join(f"{c} is not null" for c in ("power_factor", "voltage_v", "l1_a", "l2_a", "l3_a")))
    kw = electrics.three_phase_kw(F.col("voltage_v"), [F.col(c) for c in ("l1_a", "l2_a", "l3_a")], F.col("power_factor"))
    return rows.select("ingest_id", _round(kw, 4).alias("computed_kw"), _real("power_kw"))


@query(f"""WITH {_L}, g AS (SELECT machine_id, prev_us AS a, us AS b, power_kw AS kw FROM l WHERE prev_us IS NOT NULL AND us > prev_us AND NOT is_gap),
           w AS (SELECT machine_id, us // 21600000000 * 21600000000 AS fr FROM s GROUP BY 1, 2)
           SELECT w.machine_id, CAST(fr AS BIGINT) AS from_us, round(sum(greatest(least(b, fr + 21600000000) - greatest(a, fr), 0) * kw / 3.6e9), 3) AS kwh
           FROM g JOIN w ON g.machine_id = w.machine_id AND g.a < fr + 21600000000 AND g.b > fr GROUP BY 1, 2""")
def overlap_energy(spark, d):
    """Integrated power of the readings over six-hour windows, for comparison with the counter."""
    deltas = _deltas(spark, d)
    segments = deltas.where("prev_us is not null and not is_gap").select("machine_id", F.col("prev_us").alias("a_us"), F.col("us").alias("b_us"), F.col("power_kw").alias("kw"))
    windows = deltas.select("machine_id", F.expr("us div 21600000000 * 21600000000").alias("from_us")).distinct().withColumn("to_us", F.col("from_us") + 21600000000)
    out = intervals.overlap_energy(segments, windows)
    return out.select("machine_id", "from_us", _round("kwh", 3).alias("kwh"))


# --- sources, sinks, streams ---------------------------------------------------------------------------------------


@query("SELECT schema_version, count(*) AS events, count(power_factor) AS with_power_factor, count(DISTINCT ingest_id) AS ids FROM meter_events WHERE schema_version IS NOT NULL GROUP BY 1")
def merged_schemas(spark, d):
    """Two schema versions written as separate files and read as one relation."""
    events, base = _events(spark, d), scratch_path(spark, "versions")
    events.where("schema_version = 1").drop("power_factor").write.parquet(f"{base}/v1")
    events.where("schema_version <> 1").write.parquet(f"{base}/v2")
    rows = readers.history(spark, f"{base}/v1", f"{base}/v2")
    return rows.groupBy("schema_version").agg(F.count(F.lit(1)).alias("events"), F.count("power_factor").alias("with_power_factor"), F.count_distinct("ingest_id").alias("ids"))


@query("""SELECT CAST(count(*) AS BIGINT) AS events, count(power_factor) AS with_power_factor, count(DISTINCT meter_id) AS meters, true AS has_file, sum(seq)::BIGINT AS seqs FROM meter_events""")
def bronze_from_files(spark, d):
    """The event files on the fixed schema, with file metadata."""
    bronze = readers.to_bronze(readers.history(spark, f"{d}/meter_events.parquet", recursive=False), "history", F.lit(datetime(2020, 1, 1)))
    return bronze.agg(
        F.count(F.lit(1)).alias("events"), F.count("power_factor").alias("with_power_factor"), F.count_distinct("meter_id").alias("meters"),
        F.bool_and(F.col("_source_file").isNotNull() & F.col("_source_file_modified").isNotNull()).alias("has_file"), F.sum("seq").alias("seqs"),
    )


@query(f"WITH {_V} SELECT machine_id, count(*) AS versions FROM v GROUP BY 1")
def csv_snapshots(spark, d):
    """Snapshots written to CSV and read back as text give the same history."""
    path = scratch_path(spark, "snapshots")
    _master(spark, d).withColumn("exported_at", F.date_format("exported_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")).write.option("header", "true").csv(path)
    return dimensions.versions_of(readers.snapshots(spark, path)).groupBy("machine_id").agg(F.count(F.lit(1)).alias("versions"))


@query("""SELECT meter_id AS key, count(*) AS messages, count(power_factor) AS with_power_factor FROM meter_events WHERE meter_id IS NOT NULL GROUP BY 1""")
def message_roundtrip(spark, d):
    """Events to keyed JSON messages and back."""
    from ..schema import EVENT

    messages = readers.keyed_messages(_events(spark, d).where("meter_id is not null"))
    back = messages.select("key", F.from_json("value", EVENT).alias("e"))
    return back.groupBy("key").agg(F.count("e.meter_id").alias("messages"), F.count("e.power_factor").alias("with_power_factor"))


@query(f"WITH {_D} SELECT ingest_id FROM k WHERE meter IS NOT NULL AND us IS NOT NULL")
def stream_upsert(spark, d):
    """Deliveries as a file stream, upserted batch by batch into the bucketed store, then compacted."""
    from ..streaming.pipeline import upsert_stream

    base = scratch_path(spark, "landing")
    measurements(_events(spark, d)).repartition(4, "ingest_id").write.parquet(base)
    schema = spark.read.parquet(base).schema
    store = BucketStore(spark, ["meter", "ts_source"], ["ts_edge", "ingest_id"], name="streamed")
    upsert_stream(readers.event_stream(spark, base, schema, files_per_batch=2), store, scratch_path(spark, "offsets"))
    return store.compact().select("ingest_id")


@query(f"""WITH {_C}, x AS (SELECT ingest_id, meter, us, 1 AS part FROM c WHERE dq_reason IS NULL) SELECT meter, count(*) AS readings, min(us) AS first_us, max(us) AS last_us FROM x GROUP BY 1""")
def store_merge(spark, d):
    """Valid readings merged insert-only in two batches that overlap by a week, one of them twice, then compacted and read back."""
    valid = _valid(spark, d).select("ingest_id", "meter", "ts_source")
    tables = TableStore(spark, scratch_path(spark, "tables"))
    before = valid.where(F.col("ts_source") < F.lit(datetime(2016, 3, 20)))
    after = valid.where(F.col("ts_source") >= F.lit(datetime(2016, 3, 13)))
    for name, part in (("a", before), ("b", after), ("b", after)):
        tables.merge_insert_only("readings", part, ["meter", "ts_source"], name)
    tables.compact("readings", 2, ["meter", "ts_source"])
    us = F.unix_micros("ts_source")
    return tables.read("readings").groupBy("meter").agg(F.count(F.lit(1)).alias("readings"), F.min(us).alias("first_us"), F.max(us).alias("last_us"))
