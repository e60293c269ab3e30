"""Queries p1 to p7: the general training-data operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.asof import stamped_versions
from ..operators.dedup import surplus_copies
from ..operators.drift import schema_changes, unified_readings
from ..operators.grid import regular_grid
from ..operators.history import attribute_history
from ..operators.late import LateStore, corrected_hours, late_state
from ..operators.spikes import implausible_readings
from ..session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = schema_changes(table(spark, sf_dir, "raw_records"), table(spark, sf_dir, "raw_files"))
    return changes.select("file_id", "field_name", "change_kind")


def p1_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unified_readings(table(spark, sf_dir, "raw_records"), table(spark, sf_dir, "raw_files")).withColumn(
        "extras", F.to_json("extras")
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return implausible_readings(table(spark, sf_dir, "meter_events")).select("ingest_id")


def p2_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = implausible_readings(table(spark, sf_dir, "meter_events"))
    return found.select("ingest_id", "meter", F.unix_micros("ts_source").alias("us"), "power_case", "counter_case")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surplus_copies(table(spark, sf_dir, "meter_events"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = regular_grid(table(spark, sf_dir, "meter_events"))
    return grid.where(F.col("readings") == 0).select(F.col("meter").alias("meter_id"), "slot_epoch")


def p4_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regular_grid(table(spark, sf_dir, "meter_events")).withColumnRenamed("meter", "meter_id")


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    master = table(spark, sf_dir, "machine_master")
    return attribute_history(master, "machine_id", "snapshot_date", "exported_at", ["hall_id", "meter_id", "meter_serial"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).select("machine_id", "valid_from", "valid_to")


def p5_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir)


def _stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stamped_versions(table(spark, sf_dir, "energy_cost_hourly"), table(spark, sf_dir, "machine_versions"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stamped(spark, sf_dir).where(~F.col("is_right")).select("cost_id")


def p7_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stamped(spark, sf_dir)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = late_state(table(spark, sf_dir, "meter_events"))
    late = state.groupBy("meter", "hour").agg(F.sum("late").alias("late")).where("late > 0")
    return late.select(F.col("meter").alias("meter_id"), (F.col("hour") * 3600).alias("hour_epoch"))


def p6_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrected_hours(late_state(table(spark, sf_dir, "meter_events"))).withColumnRenamed("meter", "meter_id")


def p6_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hours of p6_hours from a store fed batch by batch: the live feed first, then the backfill, whose arrivals
    may precede what is held, then the live feed again."""
    events = table(spark, sf_dir, "meter_events")
    live = F.coalesce(F.col("_source") == "stream", F.lit(False))
    store = LateStore(spark)
    for name, part in (("live", live), ("backfill", ~live), ("again", live)):
        store.add(events.where(part), name)
    return corrected_hours(store.state()).withColumnRenamed("meter", "meter_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_readings, p2_found, p2_cases, p3_found, p4_found, p4_grid, p5_found, p5_versions, p6_found, p6_hours, p6_batches, p7_found, p7_versions)}

_KEPT = """
  SELECT * EXCLUDE (rn) FROM (
    SELECT ingest_id, upper(trim(meter_id)) AS meter, ts_source, ts_edge, power_kw, energy_kwh_total, opc_status,
           row_number() OVER (PARTITION BY upper(trim(meter_id)), ts_source ORDER BY ts_edge NULLS LAST, ingest_id) AS rn
    FROM meter_events WHERE meter_id IS NOT NULL AND ts_source IS NOT NULL) WHERE rn = 1
"""

_SLOTS = """
  SELECT upper(trim(meter_id)) AS meter, epoch_us(ts_source) // 900000000 AS slot, count(*) AS n,
         arg_max(energy_kwh_total, (epoch_us(ts_source), energy_kwh_total)) AS observed
  FROM meter_events WHERE meter_id IS NOT NULL AND ts_source IS NOT NULL AND energy_kwh_total IS NOT NULL
    AND coalesce(opc_status, '') <> 'Bad' GROUP BY ALL
"""

_PLAIN = "CASE WHEN upper(trim({0})) NOT IN ('', 'N/A') THEN upper(trim({0})) END"

_HISTORY = f"""
  WITH n AS (
    SELECT upper(trim(machine_id)) AS machine_id, exported_at,
           coalesce(try_strptime(trim(snapshot_date), '%Y-%m-%d'), try_strptime(trim(snapshot_date), '%Y%m%d'),
                    try_strptime(trim(snapshot_date), '%d.%m.%Y')) AS day,
           {_PLAIN.format("hall_id")} AS hall_id, {_PLAIN.format("meter_id")} AS meter_id,
           {_PLAIN.format("meter_serial")} AS meter_serial
    FROM machine_master WHERE machine_id IS NOT NULL),
  l AS (SELECT *, row_number() OVER (PARTITION BY machine_id, day ORDER BY exported_at DESC NULLS LAST, hall_id DESC NULLS LAST,
                                     meter_id DESC NULLS LAST, meter_serial DESC NULLS LAST) AS rn FROM n WHERE day IS NOT NULL),
  c AS (SELECT *, lag(machine_id) OVER w IS NULL OR lag(hall_id) OVER w IS DISTINCT FROM hall_id
                  OR lag(meter_id) OVER w IS DISTINCT FROM meter_id OR lag(meter_serial) OVER w IS DISTINCT FROM meter_serial AS b
        FROM l WHERE rn = 1 WINDOW w AS (PARTITION BY machine_id ORDER BY day))
  SELECT machine_id, strftime(day, '%Y-%m-%d') AS valid_from,
         coalesce(strftime(lead(day) OVER (PARTITION BY machine_id ORDER BY day), '%Y-%m-%d'), '9999-12-31') AS valid_to,
         hall_id, meter_id, meter_serial FROM c WHERE b
"""

_RIGHT = """
  WITH o AS (SELECT machine_sk, max(upper(trim(machine_id))) AS m FROM machine_versions WHERE machine_sk IS NOT NULL GROUP BY 1),
  r AS (SELECT c.cost_id, arg_max(v.machine_sk, (v.valid_from, v.recorded_at, v.machine_sk)) AS right_sk
        FROM energy_cost_hourly c JOIN o USING (machine_sk) JOIN machine_versions v ON upper(trim(v.machine_id)) = o.m
         AND v.valid_from <= c.hour_start_utc AND v.recorded_at <= c.hour_start_utc GROUP BY 1)
  SELECT c.cost_id, c.machine_sk, r.right_sk, coalesce(c.machine_sk = r.right_sk, false) AS is_right
  FROM energy_cost_hourly c LEFT JOIN r USING (cost_id)
"""

_SIDES = ", ".join(f"{f}(fp, {k}) OVER w AS {f}{k}" for f in ("lag", "lead") for k in range(1, 6))
_MID = "list_sort(list_filter([{0}1, {0}2, {0}3, {0}4, {0}5], lambda x: x IS NOT NULL))"
_LOW = "{0}[greatest(1, (len({0}) + 1) // 2)]"
_FIT = "({1} - {0} >= -1e-6 AND {1} - {0} <= coalesce(peak, 0) * 4 * ({3} - {2}) / 3.6e9 + 0.5)"


def _stuck(column: str, name: str) -> str:
    """Runs of ten or more equal values of consecutive readings while the machine is not off."""
    return f"""
  {name}0 AS (SELECT *, CASE WHEN is_on AND lag(is_on) OVER w AND {column} = lag({column}) OVER w AND NOT isnan({column}) THEN 0 ELSE 1 END AS begins
              FROM b WINDOW w AS (PARTITION BY meter ORDER BY us)),
  {name}1 AS (SELECT ingest_id, meter, sum(begins) OVER (PARTITION BY meter ORDER BY us) AS run FROM {name}0),
  {name} AS (SELECT ingest_id FROM {name}1 WHERE (meter, run) IN (SELECT (meter, run) FROM {name}1 GROUP BY meter, run HAVING count(*) >= 10))"""


# the definition of the cases by plain rules: far above the medians of both sides, or out of line with the counter
_CASES = f"""
  WITH k AS (SELECT ingest_id, upper(trim(meter_id)) AS meter, epoch_us(ts_source) AS us, state, power_kw AS p, energy_kwh_total AS e,
               row_number() OVER (PARTITION BY upper(trim(meter_id)), ts_source ORDER BY ts_edge NULLS LAST, ingest_id) AS rn
             FROM meter_events WHERE meter_id IS NOT NULL AND ts_source IS NOT NULL),
  b AS (SELECT *, CASE WHEN p >= 0 AND p < 1000 THEN p END AS fp, CASE WHEN e >= 0 AND e < 'inf'::DOUBLE THEN e END AS fe,
               coalesce(state <> 'off', true) AS is_on FROM k WHERE rn = 1),
  s0 AS (SELECT *, {_SIDES} FROM b WINDOW w AS (PARTITION BY meter ORDER BY us)),
  s1 AS (SELECT *, {_MID.format('lag')} AS lo, {_MID.format('lead')} AS hi FROM s0),
  spike AS (SELECT ingest_id FROM s1 WHERE len(lo) + len(hi) > 0
            AND fp > 3 * greatest(coalesce({_LOW.format('lo')}, 0), coalesce({_LOW.format('hi')}, 0), 0.05)),
  pk AS (SELECT meter, max(m) AS peak FROM (SELECT meter, state, quantile_disc(fp, 0.5) AS m FROM b GROUP BY 1, 2) GROUP BY 1),
  e0 AS (SELECT b.*, peak, lag(fe) OVER w AS e1, lag(us) OVER w AS u1, lead(fe) OVER w AS e3, lead(us) OVER w AS u3
         FROM b LEFT JOIN pk USING (meter) WHERE fe IS NOT NULL WINDOW w AS (PARTITION BY meter ORDER BY us)),
  departure AS (SELECT ingest_id FROM e0 WHERE {_FIT.format('e1', 'e3', 'u1', 'u3')} AND (fe < e1 OR fe > e3)),
  {_stuck('p', 'sp')}, {_stuck('e', 'se')}
  SELECT ingest_id FROM spike UNION SELECT ingest_id FROM departure UNION SELECT ingest_id FROM sp UNION SELECT ingest_id FROM se
  UNION SELECT ingest_id FROM b WHERE p < 0 OR isnan(p) OR p >= 1000 OR e < 0 OR isnan(e) OR e = 'inf'::DOUBLE
"""

def _middles(column: str) -> tuple[str, str]:
    """SQL of the ten neighbours of a column, and of the higher of the lower medians of both sides."""
    sides = ", ".join(f"{f}({column}, {k}) OVER w AS {column}_{f}{k}" for f in ("lag", "lead") for k in range(1, 6))
    lists = [_MID.format(f"{column}_{f}") for f in ("lag", "lead")]
    return sides, f"greatest({', '.join(_LOW.format(x) for x in lists)})"


_PLAIN_SIDES, _PLAIN_TREND = _middles("plain")
_ADJ_SIDES, _ADJ_TREND = _middles("adj")
_Z = "(u - (2.515517 + 0.802853 * u + 0.010328 * u * u) / (1 + 1.432788 * u + 0.189269 * u * u + 0.001308 * u * u * u))"
_T = "(z + (z ** 3 + z) / (4 * v) + (5 * z ** 5 + 16 * z ** 3 + 3 * z) / (96 * v * v))"
_SIGMA = "greatest(sqrt(greatest(sq - tot * tot / le, 0) / greatest(le - 1, 1)), 0.16)"
# the method itself: decomposition, sequential test per source, and the separate checks
_METHOD = _CASES[: _CASES.index("SELECT ingest_id FROM spike UNION")].replace("departure AS", "single AS") + f""",
  lv AS (SELECT meter, state, quantile_disc(fp, 0.5) AS lvl, count(fp) AS n FROM b GROUP BY 1, 2),
  ph AS (SELECT meter, count(*) FILTER (state IS NOT NULL AND n >= 5) AS phases FROM lv WHERE lvl IS NOT NULL GROUP BY 1),
  g0 AS (SELECT b.*, phases, CASE WHEN fp IS NOT NULL THEN ln(greatest(fp, 0.05)) END AS plain, CASE WHEN fp IS NOT NULL AND lvl IS NOT NULL THEN ln(greatest(fp, 0.05)) - ln(greatest(lvl, 0.05)) END AS adj
         FROM b LEFT JOIN lv ON lv.meter = b.meter AND lv.state = b.state AND lv.n >= 5 LEFT JOIN ph ON ph.meter = b.meter),
  g1 AS (SELECT *, {_PLAIN_SIDES}, {_ADJ_SIDES} FROM g0 WINDOW w AS (PARTITION BY meter ORDER BY us)),
  g2 AS (SELECT ingest_id, meter, phases, adj - {_ADJ_TREND} AS explained, plain - {_PLAIN_TREND} AS raw FROM g1),
  g AS (SELECT *, coalesce(explained, raw) AS residual, coalesce(explained, CASE WHEN phases = 0 THEN raw END) AS sample FROM g2),
  su AS (SELECT meter, count(sample) AS n, coalesce(sum(sample), 0) AS t1, coalesce(sum(sample * sample), 0) AS t2 FROM g WHERE phases IS NOT NULL GROUP BY 1),
  bi AS (SELECT meter, floor(abs(sample) / 0.001) AS bin, count(*) AS c, sum(sample) AS s1, sum(sample * sample) AS s2, avg(sample) FILTER (sample > 0) AS value
         FROM g WHERE abs(sample) >= 0.3 GROUP BY 1, 2),
  ra AS (SELECT *, sum(c) OVER w AS i, sum(s1) OVER w AS r1, sum(s2) OVER w AS r2 FROM bi WINDOW w AS (PARTITION BY meter ORDER BY bin DESC ROWS UNBOUNDED PRECEDING)),
  rb AS (SELECT ra.*, n, n - i + 1 AS le, t1 - r1 + value AS tot, t2 - r2 + value * value AS sq, greatest(n - i, 3) AS lf FROM ra JOIN su USING (meter)),
  rc AS (SELECT *, lf - 1 AS v, sqrt(-2 * ln(0.01 / (lf + 1))) AS u FROM rb), rd AS (SELECT *, {_Z} AS z FROM rc), re AS (SELECT *, {_T} AS t FROM rd),
  la AS (SELECT meter, min((bin, i, r1, r2)) FILTER (i < n AND i <= greatest(3, ceil(n * 0.1))
           AND value - tot / le > lf * t / sqrt((lf - 1 + t * t) * (lf + 1)) * {_SIGMA}) AS last FROM re GROUP BY 1),
  ea AS (SELECT su.meter, last[1] * 0.001 AS lim, n - coalesce(last[2], 0) AS le, t1 - coalesce(last[3], 0) AS tot, t2 - coalesce(last[4], 0) AS sq FROM su LEFT JOIN la USING (meter)),
  eb AS (SELECT *, greatest(le - 1, 1) AS v, sqrt(-2 * ln(0.01 / (le + 1))) AS u FROM ea), ec AS (SELECT *, {_Z} AS z FROM eb),
  ed AS (SELECT meter, lim, coalesce(tot / nullif(le, 0), 0) + {_T} * CASE WHEN le = 0 THEN 0.16 ELSE {_SIGMA} END * sqrt(1 + 1 / greatest(le, 1)) AS outside FROM ec),
  f0 AS (SELECT b.*, peak, {', '.join(f"{f}({c}, {k}) OVER w AS {c}_{f}{k}" for c in ('fe', 'us') for f in ('lag', 'lead') for k in (1, 2))}
         FROM b LEFT JOIN pk USING (meter) WHERE fe IS NOT NULL WINDOW w AS (PARTITION BY meter ORDER BY us)),
  away AS (SELECT ingest_id FROM f0 WHERE NOT {_FIT.format('fe_lag1', 'fe', 'us_lag1', 'us')} AND NOT coalesce({_FIT.format('fe_lag2', 'fe', 'us_lag2', 'us')}, false)
           AND NOT {_FIT.format('fe', 'fe_lead1', 'us', 'us_lead1')} AND NOT coalesce({_FIT.format('fe', 'fe_lead2', 'us', 'us_lead2')}, false)),
  al AS (SELECT ingest_id, b.meter, us,
           CASE WHEN p < 0 OR isnan(p) OR p >= 1000 THEN 'range'
                WHEN CASE WHEN sample IS NOT NULL THEN sample >= lim ELSE residual > outside END THEN 'spike'
                WHEN ingest_id IN (FROM sp) THEN 'stuck' END AS power_case,
           CASE WHEN e < 0 OR isnan(e) OR e = 'inf'::DOUBLE THEN 'range' WHEN ingest_id IN (FROM single) OR ingest_id IN (FROM away) THEN 'departure'
                WHEN ingest_id IN (FROM se) THEN 'stuck' END AS counter_case
         FROM b LEFT JOIN g USING (ingest_id) LEFT JOIN ed ON ed.meter = b.meter)
  SELECT * FROM al WHERE power_case IS NOT NULL OR counter_case IS NOT NULL
"""

SQL = {
    "p2_found": _CASES,
    "p2_cases": _METHOD,
    "p5_found": f"SELECT machine_id, valid_from, valid_to FROM ({_HISTORY})",
    "p5_versions": _HISTORY,
    "p7_found": f"SELECT cost_id FROM ({_RIGHT}) WHERE NOT is_right",
    "p7_versions": _RIGHT,
    "p3_found": """
      SELECT ingest_id FROM (
        SELECT ingest_id, row_number() OVER (PARTITION BY upper(trim(meter_id)), ts_source
                                             ORDER BY ts_edge NULLS LAST, ingest_id) AS rn
        FROM meter_events WHERE meter_id IS NOT NULL AND ts_source IS NOT NULL) WHERE rn > 1
    """,
    "p4_found": f"""
      WITH s AS ({_SLOTS}), n AS (SELECT meter, slot, lead(slot) OVER (PARTITION BY meter ORDER BY slot) AS nx FROM s)
      SELECT meter AS meter_id, CAST(unnest(generate_series(slot + 1, nx - 1)) * 900 AS BIGINT) AS slot_epoch
      FROM n WHERE nx > slot + 1
    """,
    "p4_grid": f"""
      WITH s AS ({_SLOTS}), g AS (SELECT meter, unnest(generate_series(min(slot), max(slot))) AS slot FROM s GROUP BY meter),
      j AS (SELECT g.meter, g.slot, n, last_value(observed IGNORE NULLS) OVER (
              PARTITION BY g.meter ORDER BY g.slot ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS v
            FROM g LEFT JOIN s ON g.meter = s.meter AND g.slot = s.slot)
      SELECT meter AS meter_id, CAST(slot * 900 AS BIGINT) AS slot_epoch, CAST(coalesce(n, 0) AS BIGINT) AS readings,
             v AS energy_kwh_total,
             CASE WHEN n IS NOT NULL THEN 'observed' WHEN v IS NOT NULL THEN 'filled' ELSE 'missing' END AS status FROM j
    """,
    "p6_found": f"""
      SELECT DISTINCT meter AS meter_id, CAST(epoch_us(ts_source) // 3600000000 * 3600 AS BIGINT) AS hour_epoch
      FROM ({_KEPT})
      WHERE epoch_us(ts_edge) - (epoch_us(ts_source) // 3600000000 + 1) * 3600000000 > 300000000
        AND epoch_us(ts_edge) - (epoch_us(ts_source) // 3600000000 + 1) * 3600000000 <= 86400000000
    """,
    "p6_hours": f"""
      WITH k AS (SELECT meter, epoch_us(ts_source) // 3600000000 AS h, CASE WHEN NOT isnan(power_kw) THEN power_kw END AS v,
                        epoch_us(ts_edge) - (epoch_us(ts_source) // 3600000000 + 1) * 3600000000 AS a FROM ({_KEPT}))
      SELECT meter AS meter_id, CAST(h * 3600 AS BIGINT) AS hour_epoch,
        count(*) FILTER (a > 300000000 AND a <= 86400000000) AS late,
        count(*) FILTER (a IS NULL OR a > 86400000000) AS dropped,
        count(*) FILTER (a <= 300000000) AS n_first, quantile_disc(v, 0.5) FILTER (a <= 300000000) AS median_first,
        count(DISTINCT v) FILTER (a <= 300000000) AS distinct_first, min(v) FILTER (a <= 300000000) AS min_first,
        max(v) FILTER (a <= 300000000) AS max_first,
        count(*) FILTER (a <= 86400000000) AS n_final, quantile_disc(v, 0.5) FILTER (a <= 86400000000) AS median_final,
        count(DISTINCT v) FILTER (a <= 86400000000) AS distinct_final, min(v) FILTER (a <= 86400000000) AS min_final,
        max(v) FILTER (a <= 86400000000) AS max_final
      FROM k GROUP BY meter, h
    """,
}
SQL["p6_batches"] = SQL["p6_hours"]
