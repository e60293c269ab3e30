"""Queries of stores, sinks, streams, the star schema and its measures, with their SQL counterparts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import calendar
from ..operators import intervals, measures, quality, realtime, star
from ..operators.dedup import BucketStore, measurements, meter_key
from ..pipeline import Step, run_daily
from ..session import scratch_path, table
from ..sources import generator, readers
from ..store import TableStore
from ..streaming import pipeline
from . import telemetry as t
from .telemetry import RULES

_events, _round = t._events, t._round
_C, _D, _F, _J, _L, _Q, _R, _S, _V = t._C, t._D, t._F, t._J, t._L, t._Q, t._R, t._S, t._V


QUERIES: dict = {}
SQL: dict[str, str] = {}
query = t.registry(QUERIES, SQL)


def _memory(stream, spark, name: str, mode: str = "append"):
    """A stream run over all that is there, as a table; the files of the sink stand for a memory sink on a cluster."""
    path = scratch_path(spark, name)
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", scratch_path(spark, "offsets")).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _landed(spark, rows, files: int = 4) -> tuple[str, T.StructType]:
    path = scratch_path(spark, "landing")
    rows.repartition(files).write.parquet(path)
    return path, rows.schema


# --- star schema and its measures ----------------------------------------------------------------------------------

_HALF = "AND {at} >= from_us AND (to_us IS NULL OR {at} < to_us)"


def _tables(spark, d):
    return star.star_tables(_events(spark, d), t._master(spark, d), RULES)


_NOON = "epoch_us(strptime(date_key::VARCHAR, '%Y%m%d')) + 43200000000"
_FULL = _F + "," + _R.removeprefix(_L + ",") + "," + _J.removeprefix(_R + ",") + "," + _Q.removeprefix(_L + ",") + f""", {_V.lstrip()},
  sd AS (SELECT machine_id, {t._KEY.format('bucket_epoch')} AS date_key, state, sum(seconds) / 3600 AS hours, sum(kwh) AS kwh FROM b GROUP BY 1, 2, 3),
  wu AS (SELECT machine_id, start_us, duration_h, duration_h > 2.6 AND NOT has_gap AS is_long, kwh, has_gap FROM r WHERE state = 'heat_up' AND NOT is_open AND NOT is_first),
  days AS (SELECT CAST(unnest(generate_series(min(strptime(dk::VARCHAR, '%Y%m%d')), max(strptime(dk::VARCHAR, '%Y%m%d')), INTERVAL 1 DAY)) AS DATE) AS dt
           FROM (SELECT {t._DAY} AS dk FROM s)),
  qg AS (SELECT machine_sk, machine_id, meter_id AS meter, CAST(strftime(dt, '%Y%m%d') AS INTEGER) AS date_key FROM v, days
         WHERE epoch_us(dt::TIMESTAMP) + 43200000000 >= from_us AND (to_us IS NULL OR epoch_us(dt::TIMESTAMP) + 43200000000 < to_us)),
  qd AS (SELECT qg.*, q.* EXCLUDE (meter, date_key) FROM qg LEFT JOIN q USING (meter, date_key))"""


@query(f"""WITH {_FULL},
  span AS (SELECT date_diff('day', CAST(to_timestamp(min(us) // 1000000) AT TIME ZONE 'UTC' AS DATE), CAST(to_timestamp(max(us) // 1000000) AT TIME ZONE 'UTC' AS DATE)) + 3 AS n FROM s)
  SELECT 'dim_machine' AS name, count(*) AS row_count, count(machine_sk) AS keyed FROM v
  UNION ALL SELECT 'dim_date', n, 0 FROM span UNION ALL SELECT 'dim_band', 2, 0 UNION ALL SELECT 'dim_state', 7, 0 UNION ALL SELECT 'dim_time_slot', 96, 0
  UNION ALL SELECT 'fact_quarter_hours', count(*), count(machine_sk) FROM f LEFT JOIN v ON v.machine_id = f.machine_id {_HALF.format(at='f.bucket_epoch * 1000000')}
  UNION ALL SELECT 'fact_state_days', count(*), count(machine_sk) FROM sd LEFT JOIN v ON v.machine_id = sd.machine_id {_HALF.format(at=_NOON)}
  UNION ALL SELECT 'fact_heat_ups', count(*), count(machine_sk) FROM wu LEFT JOIN v ON v.machine_id = wu.machine_id {_HALF.format(at='wu.start_us')}
  UNION ALL SELECT 'fact_jobs', count(*), count(machine_sk) FROM j LEFT JOIN v ON v.machine_id = j.machine_id {_HALF.format(at='j.start_us')}
  UNION ALL SELECT 'fact_quality_days', count(*), count(machine_sk) FROM qd""")
def star_published(spark, d):
    """All tables of the star schema written and published as one frame; rows and rows with a machine version of each, read back from it."""
    store = TableStore(spark, scratch_path(spark, "star"))
    star.publish_star(_tables(spark, d), store)
    out = None
    for name, rows in store.frame("star").items():
        keyed = F.count("machine_sk") if "machine_sk" in rows.columns else F.lit(0).cast("bigint")
        one = rows.agg(F.count(F.lit(1)).alias("row_count"), keyed.alias("keyed")).select(F.lit(name).alias("name"), "row_count", "keyed")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {_FULL}, fk AS (SELECT f.*, hall_id FROM f LEFT JOIN v ON v.machine_id = f.machine_id {_HALF.format(at='f.bucket_epoch * 1000000')}),
  sk AS (SELECT sd.*, hall_id FROM sd LEFT JOIN v ON v.machine_id = sd.machine_id {_HALF.format(at=_NOON)}),
  hk AS (SELECT wu.*, hall_id FROM wu LEFT JOIN v ON v.machine_id = wu.machine_id {_HALF.format(at='wu.start_us')}),
  jk AS (SELECT j.*, build_kwh + heatup_kwh + cooldown_kwh AS job_kwh, hall_id FROM j LEFT JOIN v ON v.machine_id = j.machine_id {_HALF.format(at='j.start_us')}),
  qk AS (SELECT qd.*, v.hall_id FROM qd LEFT JOIN v USING (machine_sk)),
  m1 AS (SELECT hall_id, sum(kwh) FILTER (time_band = 'peak') / nullif(sum(kwh), 0) AS peak_share FROM fk GROUP BY 1),
  m2 AS (SELECT hall_id, sum(hours) AS state_hours, sum(hours) FILTER (state = 'idle') / nullif(sum(hours) FILTER (state <> 'unknown'), 0) AS idle_share,
           sum(kwh) FILTER (state = 'idle') AS idle_energy_kwh FROM sk GROUP BY 1),
  m3 AS (SELECT hall_id, count(*) AS heat_ups, count(*) FILTER (is_long) AS heat_up_overruns, count(*) FILTER (is_long) / count(*) AS heat_up_overrun_rate,
           avg(duration_h) AS avg_heat_up_h, sum(kwh) AS heat_up_energy_kwh FROM hk GROUP BY 1),
  m4 AS (SELECT hall_id, count(*) AS build_jobs, sum(build_h) AS build_hours, sum(job_kwh) AS job_energy_kwh, sum(job_kwh) / count(*) AS kwh_per_job,
           sum(build_kwh) / nullif(sum(build_h), 0) AS kwh_per_build_h FROM jk GROUP BY 1),
  m5 AS (SELECT hall_id, coalesce(sum(events_received), 0) AS events_received, coalesce(sum(duplicates_removed), 0) AS duplicates_removed, coalesce(sum(late_events), 0) AS late_events,
           coalesce(sum(counter_resets), 0) AS counter_resets, coalesce(sum(counter_discontinuities), 0) AS counter_discontinuities, coalesce(sum(gaps), 0) AS gaps,
           coalesce(sum(rejected_missing_value + rejected_bad_status + rejected_negative_value + rejected_implausible_power + rejected_spike), 0) AS rejected_readings,
           coalesce(sum(minutes_covered), 0) / (count(*) * 1440) AS dq_completeness FROM qk GROUP BY 1),
  lg AS (SELECT hall_id, unnest(['peak_share']) AS measure, unnest([peak_share]) AS value FROM m1
    UNION ALL SELECT hall_id, unnest(['state_hours', 'idle_share', 'idle_energy_kwh']), unnest([state_hours, idle_share, idle_energy_kwh]) FROM m2
    UNION ALL SELECT hall_id, unnest(['heat_ups', 'heat_up_overruns', 'heat_up_overrun_rate', 'avg_heat_up_h', 'heat_up_energy_kwh']),
      unnest([heat_ups::DOUBLE, heat_up_overruns::DOUBLE, heat_up_overrun_rate, avg_heat_up_h, heat_up_energy_kwh]) FROM m3
    UNION ALL SELECT hall_id, unnest(['build_jobs', 'build_hours', 'job_energy_kwh', 'kwh_per_job', 'kwh_per_build_h']),
      unnest([build_jobs::DOUBLE, build_hours, job_energy_kwh, kwh_per_job, kwh_per_build_h]) FROM m4
    UNION ALL SELECT hall_id, unnest(['events_received', 'duplicates_removed', 'late_events', 'counter_resets', 'counter_discontinuities', 'gaps', 'rejected_readings', 'dq_completeness']),
      unnest([events_received::DOUBLE, duplicates_removed::DOUBLE, late_events::DOUBLE, counter_resets::DOUBLE, counter_discontinuities::DOUBLE, gaps::DOUBLE, rejected_readings::DOUBLE, dq_completeness]) FROM m5)
  SELECT hall_id, measure, round(value, 4) AS value FROM lg""")
def star_measures(spark, d):
    """The measures on quarter hours, states, heat-ups, jobs and quality, per hall: every fact joined to the machine dimension."""
    frames = _tables(spark, d)
    halls = frames["dim_machine"].select("machine_sk", "hall_id")
    joined = {n: frames[f].join(halls, "machine_sk", "left") for n, f in (("quarters", "fact_quarter_hours"), ("states", "fact_state_days"), ("heat_ups", "fact_heat_ups"), ("jobs", "fact_jobs"), ("quality", "fact_quality_days"))}
    lists = [measures.QUARTERS, measures.STATES, measures.HEAT_UPS, measures.JOBS, measures.QUALITY]
    model = measures.Model(joined, sum(lists, []))
    out = None
    for chosen in lists:
        names = [m.name for m in chosen]
        wide = model.evaluate(names, ["hall_id"])
        pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).cast("double").alias("value")) for n in names])).alias("x")
        long = wide.select("hall_id", pairs).select("hall_id", "x.measure", _round("x.value", 4).alias("value"))
        out = long if out is None else out.unionByName(long)
    return out


@query(f"""WITH {_R} SELECT machine_id, start_us, round(duration_h, 6) AS duration_h FROM r
           WHERE state = 'heat_up' AND NOT is_open AND NOT is_first AND NOT has_gap AND duration_h > 2.6""")
def long_heat_ups(spark, d):
    """Heat-ups that ran too long, without those in which a gap may hide the end."""
    found = intervals.warm_ups(t._runs(spark, d), RULES).where("is_long and not has_gap")
    return found.select("machine_id", "start_us", _round("duration_h", 6).alias("duration_h"))


@query(f"""WITH {_R}, wanted AS (SELECT DISTINCT machine_id, min(epoch_us(ts_source)) OVER (PARTITION BY machine_id, job_id) AS us FROM meter_events
             WHERE state = 'building' AND job_id IS NOT NULL AND machine_id IS NOT NULL AND ts_source IS NOT NULL),
           near AS (SELECT wanted.machine_id, wanted.us, start_us, abs(start_us - wanted.us) AS off FROM wanted LEFT JOIN r ON r.machine_id = wanted.machine_id AND r.state = 'building'
                   AND abs(start_us - wanted.us) <= 1800000000)
           SELECT machine_id, us, arg_min(start_us, (off, start_us)) AS found_us FROM near GROUP BY 1, 2""")
def job_starts_matched(spark, d):
    """The first message of each job against the beginnings of builds found in checked readings, within half an hour."""
    raw = _events(spark, d).where("state = 'building' and job_id is not null and machine_id is not null and ts_source is not null")
    wanted = raw.groupBy("machine_id", "job_id").agg(F.min(F.unix_micros("ts_source")).alias("us")).select("machine_id", "us").distinct()
    found = t._runs(spark, d).where("state = 'building'").select("machine_id", F.col("start_us").alias("us"))
    return intervals.matched_within(found, wanted, "machine_id", "us", 1_800_000_000)


@query(f"""WITH {t._T}, a AS (SELECT machine_id, us // 900000000 * 900 AS window_epoch, avg(power_kw) AS kw FROM t
             WHERE machine_id IS NOT NULL AND power_kw IS NOT NULL AND NOT isnan(power_kw) GROUP BY 1, 2)
           SELECT CAST(window_epoch AS BIGINT) AS window_epoch, round(sum(kw), 3) AS park_kw, count(*) AS machines FROM a, mx
           WHERE (window_epoch + 900) * 1000000 <= m GROUP BY 1""")
def park_power_finished(spark, d):
    """Park power without the window that is still open at the newest reading."""
    out = realtime.park_power(t._kept(spark, d), 900, t._as_of(_events(spark, d)))
    return out.select("window_epoch", _round("park_kw", 3).alias("park_kw"), "machines")


@query(f"""WITH {t._RR.replace('/ 3.6e9 / 1.0, 2)', '/ 3.6e9 / 8.0, 2)')} SELECT * FROM rr""")
def recent_runs_scaled(spark, d):
    """Recent runs of a replay that runs eight times as fast as time."""
    return realtime.recent_runs(t._kept(spark, d), t._as_of(_events(spark, d)), t.LOOKBACK_S, 8.0)


@query("SELECT ingest_id, epoch_ms(ts_source) AS source_ms, epoch_ms(ts_edge) AS edge_ms FROM meter_events")
def event_millis(spark, d):
    """Both times of every delivery as epoch milliseconds."""
    return _events(spark, d).select("ingest_id", F.unix_millis("ts_source").alias("source_ms"), F.unix_millis("ts_edge").alias("edge_ms"))


@query("""WITH m AS (SELECT strftime(d, '%B') AS month_name, CAST(month(d) AS INTEGER) AS month, count(*) AS days FROM (SELECT unnest(generate_series(TIMESTAMP '2016-01-01', TIMESTAMP '2017-12-31', INTERVAL 1 DAY)) AS d) GROUP BY 1, 2)
          SELECT month_name, CAST(row_number() OVER (ORDER BY month) AS INTEGER) AS place, days FROM m""")
def months_in_order(spark, d):
    """Month names placed by the number of the month, as a report sorts them."""
    from pyspark.sql import Window

    names = calendar.dates(spark, "2016-01-01", "2017-12-31").groupBy("month_name", "month").agg(F.count(F.lit(1)).alias("days"))
    return names.select("month_name", F.row_number().over(Window.orderBy("month")).alias("place"), "days")  # twelve rows


# --- sources and sinks -----------------------------------------------------------------------------------------------


@query("SELECT count(*) AS first_load, CAST(0 AS BIGINT) AS second_load, count(*) AS known FROM meter_events WHERE ts_source IS NOT NULL")
def incremental_files(spark, d):
    """Month files loaded by file time: everything first, nothing a second time."""
    base = scratch_path(spark, "history")
    readers.write_months(_events(spark, d), base)
    bronze = readers.to_bronze(readers.history(spark, base, recursive=True), "history")
    tables = TableStore(spark, scratch_path(spark, "bronze"))
    tables.append("bronze", bronze, "first")
    until = readers.loaded_until(tables.read("bronze"))
    newer = readers.to_bronze(readers.history(spark, base, newer_than=until, recursive=True, schema=readers.EVENT_FILE), "history").where(F.col("_source_file_modified") > F.lit(until))
    tables.append("bronze", newer, "second")
    sizes = bronze.agg(F.count(F.lit(1)).alias("first_load")), newer.agg(F.count(F.lit(1)).alias("second_load")), tables.read("bronze").agg(F.count(F.lit(1)).alias("known"))
    united = sizes[0].unionByName(sizes[1], allowMissingColumns=True).unionByName(sizes[2], allowMissingColumns=True)
    return united.agg(*[F.max(c).alias(c) for c in united.columns])


@query("""SELECT strftime(ts_source, '%Y-%m-%d') AS day, count(*) AS events, count(power_factor) AS with_power_factor FROM (SELECT ts_source::TIMESTAMPTZ AT TIME ZONE 'UTC' AS ts_source, power_factor FROM meter_events)
          WHERE ts_source IS NOT NULL GROUP BY 1""")
def day_files(spark, d):
    """Events as JSON lines per UTC day, read back."""
    base = scratch_path(spark, "days")
    readers.write_days(_events(spark, d).where("ts_source is not null"), base)
    back = spark.read.schema("power_factor double, ts_source timestamp, day date").json(base)
    return back.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("events"), F.count("power_factor").alias("with_power_factor"))


@query("""SELECT strftime(t, '%Y-%m') AS month, count(*) AS events, count(power_factor) AS with_power_factor FROM (SELECT ts_source::TIMESTAMPTZ AT TIME ZONE 'UTC' AS t, power_factor FROM meter_events)
          WHERE t IS NOT NULL GROUP BY 1""")
def month_files(spark, d):
    """One folder of Parquet files per month, of either schema version, read back as one relation."""
    base = scratch_path(spark, "months")
    readers.write_months(_events(spark, d), base)
    back = readers.history(spark, base, recursive=True)
    return back.groupBy(F.date_format("ts_source", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("events"), F.count("power_factor").alias("with_power_factor"))


@query("""SELECT meter_id, count(*) AS messages, sum(seq)::BIGINT AS seqs FROM meter_events WHERE meter_id IS NOT NULL GROUP BY 1""")
def message_feed(spark, d):
    """Keyed JSON messages that land as files, read as a stream into two sinks; one of them is reported."""
    landing = scratch_path(spark, "messages")
    readers.keyed_messages(_events(spark, d).where("meter_id is not null")).select("value").repartition(4).write.text(landing)
    tables = TableStore(spark, scratch_path(spark, "sinks"))
    sinks = {name: (lambda rows, i, name=name: tables.append(name, rows, str(i))) for name in ("archive", "live")}
    pipeline.fan_out(readers.message_stream(spark, landing, files_per_batch=2), sinks, scratch_path(spark, "offsets"))
    both = tables.read("archive").select("meter_id", "seq").exceptAll(tables.read("live").select("meter_id", "seq"))  # empty
    rows = tables.read("live").select("meter_id", "seq").unionByName(both)
    return rows.groupBy("meter_id").agg(F.count(F.lit(1)).alias("messages"), F.sum("seq").alias("seqs"))


@query("""SELECT meter_id, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS refused FROM (SELECT meter_id, coalesce(schema_version IN (1, 2)
            AND state IN ('off', 'idle', 'heat_up', 'building', 'cool_down', 'unpacking') AND opc_status IN ('Good', 'Uncertain', 'Bad') AND machine_id IS NOT NULL AND meter_id IS NOT NULL
            AND seq IS NOT NULL AND ts_source IS NOT NULL AND ts_edge IS NOT NULL AND l1_a IS NOT NULL AND l2_a IS NOT NULL AND l3_a IS NOT NULL AND voltage_v IS NOT NULL
            AND power_kw IS NOT NULL AND energy_kwh_total IS NOT NULL AND ((schema_version = 1) = (power_factor IS NULL)) AND (job_id IS NULL OR state = 'building'), false) AS ok FROM meter_events) GROUP BY 1""")
def wire_contract(spark, d):
    """Events that meet the contract of the wire, and those refused, per spelling of a meter."""
    good, bad = readers.accepted(_events(spark, d))
    both = good.select("meter_id", F.lit(1).alias("a"), F.lit(0).alias("r")).unionByName(bad.select("meter_id", F.lit(0).alias("a"), F.lit(1).alias("r")))
    return both.groupBy("meter_id").agg(F.sum("a").alias("accepted"), F.sum("r").alias("refused"))


@query("""SELECT CAST(6 AS BIGINT) AS meters, CAST(6 * 2880 AS BIGINT) AS measurements, true AS twice_the_same, true AS all_valid""")
def generated_history(spark, d):
    """Synthetic events: the same seed gives the same rows, and without faults all of them pass the checks."""
    make = lambda: generator.history(spark, 6, datetime(2026, 3, 1), 48, 60, duplicate_share=0.01, late_share=0.0)
    made = make()
    keyed = made.withColumn("ingest_id", F.xxhash64("meter_id", "seq", "ts_edge"))
    flagged = quality.checked(quality.deliveries(keyed), RULES)
    digest = lambda df: df.agg(F.sum(F.xxhash64("meter_id", "seq", "ts_source", "ts_edge", "power_kw").cast("decimal(38,0)"))).first()[0]
    same = digest(made) == digest(make())
    return flagged.agg(
        F.count_distinct("meter").alias("meters"), F.count(F.lit(1)).alias("measurements"), F.lit(same).alias("twice_the_same"), F.bool_and(F.col("dq_reason").isNull()).alias("all_valid")
    )


@query("""SELECT machine_id, count(*) AS versions, count(DISTINCT hall_id) AS halls FROM (
            SELECT 'LS0000' || m AS machine_id, unnest(CASE WHEN m = 2 THEN ['H3', 'H9'] ELSE ['H' || (m % 4 + 1)] END) AS hall_id FROM (SELECT unnest(generate_series(1, 5)) AS m)) GROUP BY 1""")
def generated_snapshots(spark, d):
    """Synthetic master data of five machines, one of which moves, as versions."""
    from ..operators import dimensions

    made = generator.snapshots(spark, 5, ["2026-01-01", "2026-02-01", "2026-03-01"], {2: (2, "H9")})
    return dimensions.versions_of(made).groupBy("machine_id").agg(F.count(F.lit(1)).alias("versions"), F.count_distinct("hall_id").alias("halls"))


# --- store -----------------------------------------------------------------------------------------------------------


@query(f"""WITH {_S}, x AS (SELECT count(*) AS n, count(*) FILTER (us >= 1458432000000000) AS recent FROM s)
  SELECT 'appended' AS step, 2 AS parts, n AS row_count FROM x UNION ALL SELECT 'compacted', 1, n FROM x UNION ALL SELECT 'retained', 1, recent FROM x
  UNION ALL SELECT 'pinned', 2, n FROM x UNION ALL SELECT 'replaced', 1, 1 FROM x""")
def store_maintenance(spark, d):
    """Append, compaction, retention and replacement of a table, each version with its parts and rows; a frame outlives the vacuum."""
    valid = t._valid(spark, d).select("ingest_id", "meter", "ts_source")
    store = TableStore(spark, scratch_path(spark, "maintained"))
    out = []

    def note(step: str, version: int | None = None) -> None:
        out.append((step, len(store.manifest("r", version)["parts"]), store.read("r", version).count()))

    store.append("r", valid.where("ingest_id % 2 = 0"), "even")
    store.append("r", valid.where("ingest_id % 2 <> 0"), "odd")
    note("appended")
    pinned = store.publish("before", ["r"])["r"]
    store.compact("r", 2, ["meter", "ts_source"])
    note("compacted")
    store.retain("r", F.col("ts_source") >= F.lit(datetime(2016, 3, 20)))
    note("retained")
    store.overwrite("r", spark.range(1).select(F.lit("x").alias("other")))
    note("replaced")
    store.vacuum("r", 0)
    note("pinned", pinned)
    return spark.createDataFrame(out, "step string, parts int, row_count bigint")


@query(t.SQL["price_by_month"])
def monthly_view(spark, d):
    """The monthly prices as a view over a stored mart that was replaced as a whole, queried by name."""
    from ..operators import market

    store = TableStore(spark, scratch_path(spark, "mart"))
    costs = table(spark, d, "energy_cost_hourly")
    store.overwrite("mart", costs.limit(0))
    version = store.overwrite("mart", costs)
    name = f"prices_{version}_{store.root.rsplit('-', 1)[-1]}"
    store.view(f"mart_{name}", "mart")
    market.monthly_prices(spark.table(f"mart_{name}")).createOrReplaceTempView(name)
    rounded = ", ".join(f"round({c} + 1e-9, 3) AS {c}" for c in ("kwh", "cost_spot_eur", "load_weighted", "time_weighted"))
    return spark.sql(f"SELECT yyyymm, {rounded} FROM {name}")


@query("""SELECT * FROM (VALUES ('readings', 'done'), ('facts', 'done'), ('prices', 'done'), ('mart', 'done'), ('broken', 'failed'), ('report', 'skipped')) x(step, status)""")
def daily_run(spark, d):
    """Steps in order of dependency; one fails for good, what needs it is skipped, the rest is done."""
    store, tries = TableStore(spark, scratch_path(spark, "daily")), []

    def prices() -> None:
        tries.append(1)
        if len(tries) == 1:
            raise RuntimeError("the first try fails")
        store.overwrite("prices", t._prices(spark))

    def broken() -> None:
        raise RuntimeError("never works")

    facts = lambda: store.overwrite("facts", store.read("readings").groupBy("machine_id").agg(F.sum("power_kw").alias("kw")))
    steps = [
        Step("mart", lambda: store.publish("mart", ["facts", "prices"]), ("facts", "prices")), Step("report", prices, ("broken",)), Step("broken", broken, wait_s=0),
        Step("facts", facts, ("readings",)), Step("prices", prices, wait_s=0), Step("readings", lambda: store.overwrite("readings", t._valid(spark, d))),
    ]
    return spark.createDataFrame(sorted(run_daily(steps, lambda s: None).items()), "step string, status string")


# --- streams ---------------------------------------------------------------------------------------------------------


@query(f"WITH {_D} SELECT ingest_id FROM k WHERE meter IS NOT NULL AND us IS NOT NULL")
def united_stream(spark, d):
    """Backfill and live feed as one stream into the bucketed store; then store and checkpoint are dropped and all is replayed."""
    rows = measurements(_events(spark, d), "_source")
    live = F.coalesce(F.col("_source") == "stream", F.lit(False))
    folders = [_landed(spark, rows.where(part).drop("_source"), 2) for part in (~live, live)]
    for _ in range(2):
        feeds = [readers.event_stream(spark, path, schema, files_per_batch=1) for path, schema in folders]
        store = BucketStore(spark, ["meter", "ts_source"], ["ts_edge", "ingest_id"], name="united")
        pipeline.upsert_stream(feeds[0].unionByName(feeds[1]), store, scratch_path(spark, "offsets"))
    return store.merged().select("ingest_id")


@query(f"WITH {_C} SELECT ingest_id, dq_reason FROM c")
def checked_stream(spark, d):
    """New deliveries checked batch by batch and merged into readings and quarantine; here all arrive in one batch."""
    path, schema = _landed(spark, _events(spark, d))
    tables = TableStore(spark, scratch_path(spark, "silver"))
    context = lambda: spark.read.schema(schema).parquet(path).limit(0)
    pipeline.silver_stream(readers.event_stream(spark, path, schema), context, tables, scratch_path(spark, "offsets"), RULES)
    good = tables.read("readings").select("ingest_id", F.lit(None).cast("string").alias("dq_reason"))
    return good.unionByName(tables.read("quarantine").select("ingest_id", "dq_reason"))


@query("SELECT DISTINCT upper(trim(meter_id)) AS meter, epoch_us(ts_source) AS us FROM meter_events WHERE ts_source IS NOT NULL")
def distinct_streamed(spark, d):
    """One copy of every measurement from a stream that remembers a year."""
    path, schema = _landed(spark, _events(spark, d).where("ts_source is not null").select("ingest_id", "meter_id", "ts_source"))
    stream = pipeline.distinct_stream(readers.event_stream(spark, path, schema, files_per_batch=2), "400 days")
    out = _memory(stream, spark, "distinct")
    return out.select(meter_key().alias("meter"), F.unix_micros("ts_source").alias("us"))


@query("""WITH a AS (SELECT machine_id, epoch_us(ts_source) // 3600000000 * 3600 AS window_epoch, avg(power_kw) AS kw FROM meter_events
            WHERE ts_source IS NOT NULL AND machine_id IS NOT NULL AND power_kw IS NOT NULL AND NOT isnan(power_kw) GROUP BY 1, 2),
          mx AS (SELECT max(epoch_us(ts_source)) AS m FROM meter_events WHERE machine_id IS NOT NULL AND power_kw IS NOT NULL AND NOT isnan(power_kw))
          SELECT CAST(window_epoch AS BIGINT) AS window_epoch, round(sum(kw), 3) AS park_kw, count(*) AS machines FROM a, mx WHERE (window_epoch + 3600) * 1000000 <= m GROUP BY 1""")
def windows_streamed(spark, d):
    """Mean power per machine and hour, summed over machines, in two chained streaming aggregations; a closing event ends the last finished window."""
    fine = _events(spark, d).where("ts_source is not null and machine_id is not null and power_kw is not null and not isnan(power_kw)").select("machine_id", "ts_source", "power_kw")
    path, schema = _landed(spark, fine, 1)
    newest = t._as_of(fine)
    spark.createDataFrame([("closing", datetime(2099, 1, 1), 0.0)], schema).coalesce(1).write.mode("append").parquet(path)
    stream = pipeline.power_windows(readers.event_stream(spark, path, schema), "1 hour", "400 days")
    out = _memory(stream, spark, "windows").where((F.col("window_epoch") + 3600) * 1_000_000 <= F.unix_micros(F.lit(newest)))
    return out.select("window_epoch", _round("park_kw", 3).alias("park_kw"), "machines")
