"""Scenarios of the telemetry pipeline with hand-computed values, invariants, store and streams."""

from __future__ import annotations

import json
import math
import os
import random
import shutil
import time
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from conftest import DATA, START, later, reading
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meterflow.config import Rules
from meterflow.functions import calendar, electrics
from meterflow import session
from meterflow.operators import daily, dimensions, intervals, market, measures, quality, realtime, sequences, star
from meterflow.pipeline import Step, run_daily
from meterflow.plans import services, telemetry
from meterflow.schema import BRONZE
from meterflow.sources import generator, readers
from meterflow.store import TableStore
from meterflow.streaming import pipeline

R = Rules()


# --- the pipeline against a model in plain Python --------------------------------------------------------------------


def dirty(seed: int, n: int = 90) -> list[dict]:
    """Readings of two machines over two days with everything that goes wrong: copies, faults, gaps, exchanged meters."""
    rng, rows, minute = random.Random(seed), [], 0.0
    counter = {"W-031": 7000.0, "W-032": 40.0}
    for i in range(n):
        minute += rng.choice([0.5, 3, 4.9, 5.1, 20, 200 if i % 30 == 0 else 12])
        meter = rng.choice(list(counter))
        counter[meter] += rng.choice([0, 0.01, 0.4, 2, 900 if i % 25 == 7 else 1])
        if i % 31 == 11:
            counter[meter] = rng.choice([0.02, 300.0])
        swapped = minute > 1400
        row = reading(
            i, minute, meter_id=meter, machine_id="PRINT-A" if (meter == "W-031") != swapped else "PRINT-B", energy_kwh_total=counter[meter],
            state=rng.choice(["idle", "heat_up", "building", "building", "cool_down"]), power_kw=rng.choice([1.0, 2.5, 3.0, 6.5, 19.5]),
            opc_status=rng.choice(["Good"] * 8 + ["Uncertain", "Bad"]),
        )
        row["job_id"] = f"job {i // 20}" if row["state"] == "building" else None
        fault = rng.randrange(25)
        if fault == 0:
            row[rng.choice(["machine_id", "meter_id", "state", "power_kw", "energy_kwh_total", "ts_source", "opc_status"])] = None
        row |= {1: {"power_kw": -0.5}, 2: {"power_kw": 33.0}, 3: {"energy_kwh_total": -2.0}, 4: {"ts_edge": later(minute + 7)}, 5: {"energy_kwh_total": float("nan")}, 6: {"ts_edge": None}}.get(fault, {})
        rows.append(row)
        if fault in (7, 8):
            rows.append(row | {"ingest_id": 1000 + i, "ts_edge": later(minute + rng.choice([-1, 9])), "meter_id": f" {(row['meter_id'] or 'w-031').lower()}", "power_kw": 4.0})
    rng.shuffle(rows)
    return rows


def key_of(row) -> str | None:
    return row["meter_id"] and row["meter_id"].strip().upper()


def model_checked(rows) -> dict[int, tuple[dict, str | None]]:
    first = {}
    for row in sorted(rows, key=lambda x: (x["ts_edge"] is None, x["ts_edge"] or START, x["ingest_id"])):
        first.setdefault((key_of(row), row["ts_source"]), row)
    series = {}
    for (meter, taken), row in first.items():
        if meter and taken:
            series.setdefault(meter, []).append(row)
    out = {}
    for rows_of in series.values():
        rows_of.sort(key=lambda x: x["ts_source"])
        usable = [x["power_kw"] if x["opc_status"] in ("Good", "Uncertain") else None for x in rows_of]
        for i, row in enumerate(rows_of):
            sides = [usable[k] if 0 <= k < len(usable) else None for k in (i - 1, i + 1)]
            out[row["ingest_id"]] = (row, sides)
    verdicts = {}
    for row in first.values():
        kw, kwh, sides = row["power_kw"], row["energy_kwh_total"], out.get(row["ingest_id"], (row, [None, None]))[1]
        needed = (row["machine_id"], key_of(row), row["ts_source"], row["state"], kw, kwh, row["opc_status"])
        if None in needed or math.isnan(kwh):
            verdict = "missing_value"
        elif row["opc_status"] == "Bad":
            verdict = "bad_status"
        elif kw < 0 or kwh < 0:
            verdict = "negative_value"
        elif kw > R.max_power_kw:
            verdict = "implausible_power"
        else:
            verdict = "spike" if kw > R.spike_min_kw and None not in sides and kw > R.spike_ratio * max(sides) else None
        verdicts[row["ingest_id"]] = (row, verdict)
    return verdicts


def model_steps(rows) -> list[dict]:
    last, out = {}, []
    good = [row for row, verdict in model_checked(rows).values() if verdict is None]
    for row in sorted(good, key=lambda x: x["ts_source"]):
        before = last.get(key_of(row))
        step = {"row": row, "before": before, "kwh": None, "restart": False, "broken": False, "gap": False, "state": None}
        if before is not None:
            seconds = (row["ts_source"] - before["ts_source"]).total_seconds()
            rise, possible = row["energy_kwh_total"] - before["energy_kwh_total"], seconds * R.max_power_kw / 3600
            step["gap"] = seconds > R.gap_s
            step["state"] = "unknown" if step["gap"] else before["state"]
            step["restart"] = rise < 0 and row["energy_kwh_total"] <= possible + R.new_meter_kwh
            step["broken"] = not step["restart"] and not 0 <= rise <= possible
            step["kwh"] = None if step["broken"] else row["energy_kwh_total"] if step["restart"] else rise
        last[key_of(row)] = row
        out.append(step)
    return out


def model_runs(rows) -> list[dict]:
    machines = {}
    for step in sorted(model_steps(rows), key=lambda s: (s["row"]["ts_source"], key_of(s["row"]), s["row"]["ingest_id"])):
        machines.setdefault(step["row"]["machine_id"], []).append(step)
    out = []
    for machine, steps in machines.items():
        runs = []
        for step in steps:
            if runs:
                runs[-1]["kwh"].append(step["kwh"])
                runs[-1]["gap"] |= step["gap"]
            if not runs or runs[-1]["state"] != step["row"]["state"]:
                runs.append({"machine": machine, "state": step["row"]["state"], "steps": [], "kwh": [], "gap": False})
            runs[-1]["steps"].append(step["row"])
        for i, run in enumerate(runs):
            run["start"], run["open"], run["first"] = run["steps"][0]["ts_source"], i + 1 == len(runs), i == 0
            run["end"] = run["steps"][-1]["ts_source"] if run["open"] else runs[i + 1]["steps"][0]["ts_source"]
            run["energy"] = sum(x for x in run["kwh"] if x is not None)
        for i, run in enumerate(runs):
            run["prev"], run["next"] = runs[i - 1] if i else None, runs[i + 1] if i + 1 < len(runs) else None
        out += runs
    return out


def micros(t: datetime) -> int:
    return (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def valid(frame, rows):
    return quality.valid_readings(frame(rows), R)


SEEDS = given(st.integers(0, 10**6))


@settings(max_examples=5, deadline=None)
@SEEDS
def test_checks_equal_the_model(frame, seed):
    rows = dirty(seed)
    got = {r.ingest_id: r for r in quality.checked(quality.deliveries(frame(rows)), R).collect()}
    want = model_checked(rows)
    assert {i: r.dq_reason for i, r in got.items()} == {i: verdict for i, (_, verdict) in want.items()}
    for i, (row, _) in want.items():
        late = None if row["ts_edge"] is None or row["ts_source"] is None else (row["ts_edge"] - row["ts_source"]).total_seconds() > R.late_s
        assert got[i].is_late is late and got[i].is_uncertain is (row["opc_status"] and row["opc_status"] == "Uncertain")


@settings(max_examples=4, deadline=None)
@SEEDS
def test_intervals_and_buckets_equal_the_model(frame, seed):
    rows = dirty(seed)
    want = {s["row"]["ingest_id"]: s for s in model_steps(rows)}
    steps = intervals.counter_deltas(valid(frame, rows), R)
    got = {r.ingest_id: r for r in steps.collect()}
    assert set(got) == set(want)
    for i, s in want.items():
        assert (got[i].counter_reset, got[i].counter_discontinuity, got[i].is_gap, got[i].interval_state) == (s["restart"], s["broken"], s["gap"], s["state"])
        assert got[i].delta_kwh == (None if s["kwh"] is None else pytest.approx(s["kwh"]))
    spread: dict = {}
    for s in want.values():
        if s["kwh"] is None or s["before"] is None:
            continue
        a, b = micros(s["before"]["ts_source"]), micros(s["row"]["ts_source"])
        for bucket in range(a // 900_000_000, (b - 1) // 900_000_000 + 1):
            share = (min(b, (bucket + 1) * 900_000_000) - max(a, bucket * 900_000_000)) / (b - a)
            k = (s["row"]["machine_id"], bucket * 900, s["state"])
            spread[k] = spread.get(k, 0.0) + s["kwh"] * share
    parts = intervals.in_buckets(steps, R).groupBy("machine_id", "bucket_epoch", "state").agg(F.sum("kwh").alias("kwh")).collect()
    assert {(p.machine_id, p.bucket_epoch, p.state): p.kwh for p in parts} == pytest.approx(spread)


@settings(max_examples=4, deadline=None)
@SEEDS
def test_runs_and_jobs_equal_the_model(frame, seed):
    rows = dirty(seed)
    want = model_runs(rows)
    runs = intervals.state_runs(valid(frame, rows), R)
    got = {(r.machine_id, r.start_us): r for r in runs.collect()}
    assert set(got) == {(w["machine"], micros(w["start"])) for w in want}
    for w in want:
        r = got[w["machine"], micros(w["start"])]
        assert (r.state, r.end_us, r.is_open, r.is_first, r.has_gap, r.readings) == (w["state"], micros(w["end"]), w["open"], w["first"], w["gap"], len(w["steps"]))
        assert r.kwh == pytest.approx(w["energy"])
        assert (r.prev_state, r.next_state) == tuple(x and x["state"] for x in (w["prev"], w["next"]))
    whole = [w for w in want if not w["open"] and not w["first"]]
    hours = lambda w: (w["end"] - w["start"]).total_seconds() / 3600
    heats = {(r.machine_id, r.start_us): (r.is_long, r.job_id) for r in intervals.warm_ups(runs, R).collect()}
    job = lambda w: max((x["job_id"] for x in w["steps"] if x["job_id"]), default=None)
    assert heats == {
        (w["machine"], micros(w["start"])): (hours(w) > R.long_run_h and not w["gap"], job(w["next"]) if w["next"]["state"] == "building" else None)
        for w in whole if w["state"] == "heat_up"
    }
    made = {(r.machine_id, r.start_us): (r.heatup_kwh, r.cooldown_kwh, r.build_kwh) for r in intervals.jobs(runs).collect()}
    for w in whole:
        if w["state"] == "building":
            known = lambda x: None if all(k is None for k in x["kwh"]) else x["energy"]
            sides = tuple(known(x) if x["state"] == s else 0.0 for x, s in ((w["prev"], "heat_up"), (w["next"], "cool_down")))
            assert made.pop((w["machine"], micros(w["start"]))) == pytest.approx((*sides, w["energy"]))
    assert not made


def test_an_increment_is_judged_with_what_came_before(frame):
    rows = [reading(i, 4 * i) for i in range(8)]
    rows[5]["power_kw"] = 17.0
    late, early = [rows[5], rows[6], rows[4], reading(70, None)], [*rows[:5], reading(71, -300), reading(72, 12, meter_id="W-900")]
    good, bad = quality.checked_increment(quality.deliveries(frame(late)), quality.deliveries(frame(early)), R)
    assert {r.ingest_id for r in good.collect()} == {4, 6}
    assert {r.ingest_id: r.dq_reason for r in bad.collect()} == {5: "spike", 70: "missing_value"}
    nothing = quality.deliveries(frame([]))
    assert quality.checked_increment(nothing, quality.deliveries(frame(early)), R)[0].count() == 0


def test_not_a_number_has_a_verdict(frame):
    rows = [reading(i, i) for i in range(4)]
    rows[2]["power_kw"] = float("nan")
    out = quality.checked(quality.deliveries(frame(rows)), R)
    assert {r.ingest_id: r.dq_reason for r in out.collect()} == {0: None, 1: None, 2: "implausible_power", 3: None}
    good, bad = quality.split(out)
    assert (good.count(), bad.count()) == (3, 1) and "dq_reason" not in good.columns


def test_a_bucket_ends_before_its_last_microsecond(frame):
    edge = datetime(2027, 9, 23, 3, 45)
    taken = [edge + timedelta(microseconds=x) for x in (17, 650)] + [edge + timedelta(minutes=15)]
    rows = [reading(i, 0, ts_source=t, energy_kwh_total=e) for i, (t, e) in enumerate(zip(taken, (50.0, 50.0, 50.75), strict=True))]
    parts = intervals.in_buckets(intervals.counter_deltas(valid(frame, rows), R), R).collect()
    assert {p.bucket_epoch for p in parts} == {micros(edge) // 1_000_000} and sum(p.kwh for p in parts) == pytest.approx(0.75)


def test_a_fact_has_local_time_and_completeness(frame):
    morning = (datetime(2027, 9, 23, 5, 15) - START) / timedelta(minutes=1)  # 07:15 in summer time, a Thursday
    rows = [reading(i, morning + m, energy_kwh_total=10 + 0.2 * m, power_kw=p) for i, (m, p) in enumerate([(0, 4.0), (0.4, 8.0), (6, 6.0), (30, 2.0)])]
    facts = {r.slot_of_day: r for r in intervals.bucket_facts(valid(frame, rows), R).collect()}
    assert set(facts) == {29, 30, 31} and {r.date_key for r in facts.values()} == {20270923} and facts[29].time_band == "peak"
    assert (facts[29].readings, facts[29].minutes_covered, facts[29].max_power_kw, facts[29].avg_power_kw) == (3, 2, 8.0, 6.0)
    assert facts[29].completeness == pytest.approx(2 / 15) and facts[30].readings == 0
    assert (facts[29].kwh, facts[30].kwh, facts[31].kwh) == pytest.approx((3.0, 3.0, 0.0))


@settings(max_examples=3, deadline=None)
@SEEDS
def test_no_energy_is_lost_or_made(frame, seed):
    rows = valid(frame, dirty(seed))
    total = lambda df: df.agg(F.coalesce(F.sum("kwh"), F.lit(0.0))).first()[0]
    steps = intervals.counter_deltas(rows, R).select(F.col("delta_kwh").alias("kwh"))
    assert total(intervals.state_days(rows, R)) == pytest.approx(total(steps))
    assert total(intervals.bucket_facts(rows, R)) == pytest.approx(total(steps))


@settings(max_examples=4, deadline=None)
@SEEDS
def test_neighbours_and_runs_of_slices_equal_the_whole(spark, seed):
    rng = random.Random(seed)
    rows = [(s, t, i, rng.choice(["x", "y", None]), rng.random()) for s in "ab" for i, t in enumerate(sorted(rng.choices(range(400), k=40)))]
    df = spark.createDataFrame([*rows, (None, 3, 0, "x", 0.0), ("a", None, 0, "x", 0.0)], "s string, us bigint, n int, v string, e double")
    got = {(r.s, r.n): (r.lo, r.hi) for r in sequences.neighbours(df, "s", ["us", "n"], {"lo": F.col("n")}, {"hi": F.col("n")}, slice_us=50).collect()}
    assert got == {(s, n): (n - 1 if n else None, n + 1 if n < 39 else None) for s in "ab" for n in range(40)}
    found = sequences.runs(df, "s", ["us", "n"], "v", {"size": ("sum", F.lit(1)), "from": ("min", F.col("n"))}, {"e": ("sum", F.col("e"))}, slice_us=50)
    want = {}
    for s in "ab":
        mine, start = [r for r in rows if r[0] == s], 0
        for i in range(1, 41):
            if i == 40 or mine[i][3] != mine[start][3]:
                steps = [r[4] for r in mine[start + 1 : i + 1]]
                want[s, start] = (mine[start][3], i - start, sum(steps) if steps else None)
                start = i
    assert {(r.s, r["from"]): (r.v, r["size"], r.e) for r in found.collect()} == {k: (v, n, None if e is None else pytest.approx(e)) for k, (v, n, e) in want.items()}


@pytest.fixture(scope="module")
def build(frame):
    """A print: waiting, a heat-up of given length, building, cooling; a reading every four minutes."""

    def make(heat: int):
        rows, minute, kwh = [], 0, 880.0
        for state, minutes, kw in (("idle", 20, 0.8), ("heat_up", heat, 9.0), ("building", 400, 5.0), ("cool_down", 80, 2.0)):
            for _ in range(minutes // 4):
                rows.append(reading(len(rows), minute, state=state, power_kw=kw, energy_kwh_total=kwh, job_id="vase 12" if state == "building" else None))
                minute, kwh = minute + 4, kwh + kw / 15
        return valid(frame, rows)

    return make


def test_overlap_energy(spark):
    s = spark.createDataFrame([("M", 0, 5_400_000_000, 2.0), ("M", 5_400_000_000, 9_000_000_000, 4.0)], "machine_id string, a_us bigint, b_us bigint, kw double")
    w = spark.createDataFrame([("M", 3_600_000_000, 7_200_000_000)], "machine_id string, from_us bigint, to_us bigint")
    assert intervals.overlap_energy(s, w).first().kwh == pytest.approx(0.5 * 2 + 0.5 * 4)


# --- calendar ------------------------------------------------------------------------------------------------------


def test_bands_follow_local_time(spark):
    times = [datetime(2026, 3, 27, 5, 30), datetime(2026, 3, 27, 6, 30), datetime(2026, 3, 30, 5, 30), datetime(2026, 3, 28, 9)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp")
    got = [r.b for r in df.select(calendar.time_band(calendar.local("t", R), R).alias("b")).collect()]
    assert got == ["off_peak", "peak", "peak", "off_peak"]


@pytest.mark.parametrize("day, hours", [("2026-03-29", 23), ("2026-10-25", 25), ("2026-06-01", 24)])
def test_days_of_the_clock_change(spark, day, hours):
    start = int(datetime.fromisoformat(day).timestamp()) - 7200
    utc = spark.range(start, start + 30 * 3600, 900).select(F.timestamp_seconds("id").alias("t"))
    key = calendar.day_key(calendar.local("t", R))
    assert utc.where(key == int(day.replace("-", ""))).count() == hours * 4


def test_dates(spark):
    rows = calendar.dates(spark, "2026-03-01", "2026-03-31").collect()
    assert len(rows) == 31 and rows[0].iso_weekday == 7 and rows[0].is_weekend and rows[0].date == date(2026, 3, 1)
    assert calendar.time_slots(spark, R).where("slot_label = '07:15' and hour = 7 and is_peak_hours").count() == 1
    assert calendar.states(spark).count() == 7


def test_electrics(spark):
    r = spark.range(1).select(
        electrics.three_phase_kw(F.lit(400.0), [F.lit(10.0), F.lit(11.0), F.lit(12.0)], F.lit(0.9)).alias("p"),
        electrics.phase_current(F.lit(6.0), F.lit(400.0), F.lit(1.0)).alias("i"), electrics.phase_current(F.lit(6.0), F.lit(0.0), F.lit(1.0)).alias("none"),
    ).first()
    assert r.p == pytest.approx(math.sqrt(3) * 400 * 11 * 0.9 / 1000) and r.i == pytest.approx(8.660254) and r.none is None


def test_rules_are_checked():
    assert Rules.of({"gap_s": 60}).gap_s == 60
    for bad in ({"gap_s": 0}, {"peak_from_hour": 22}, {"peak_weekdays": (0,)}):
        with pytest.raises(ValueError):
            Rules.of(bad)
    with pytest.raises(TypeError):
        Rules.of({"unknown": 1})


# --- dimensions ----------------------------------------------------------------------------------------------------

SNAP = "snapshot_date string, machine_id string, hall_id string, meter_id string, meter_serial string, exported_at timestamp"


@pytest.fixture(scope="module")
def dimension(spark):
    rows = [(f"2027-0{m}-01", "PRINT-A", "east" if m < 9 else "west", "W-031", "serial 5", datetime(2027, m, 3)) for m in (6, 7, 9)]
    return dimensions.versions_of(spark.createDataFrame(rows, SNAP))


def test_versions_and_lookup(spark, dimension):
    assert [(r.machine_sk, r.is_current) for r in dimension.orderBy("valid_from").collect()] == [("PRINT-A_20270601", False), ("PRINT-A_20270901", True)]
    times = [datetime(2027, 5, 31, 23), datetime(2027, 8, 31, 23, 59), datetime(2027, 9, 1)]
    facts = spark.createDataFrame([("PRINT-A", t) for t in times] + [("PRINT-Z", times[2])], "machine_id string, t timestamp")
    keyed = dimensions.with_version(facts, dimension, F.col("t"))
    assert [r.machine_sk for r in keyed.orderBy("machine_id", "t").collect()] == [None, "PRINT-A_20270601", "PRINT-A_20270901", None]
    assert dimensions.visible_to(keyed, dimension, F.col("hall_id") == "WEST").count() == 1


def test_merging_a_snapshot(spark, dimension):
    state = lambda *rows: spark.createDataFrame(rows, "machine_id string, hall_id string, meter_id string, meter_serial string")
    once = dimensions.merged_versions(dimension, state(("PRINT-A", "WEST", "W-031", None), ("PRINT-B", None, "W-032", None)), datetime(2027, 10, 5))
    rows = {r.machine_sk: r for r in once.collect()}
    assert set(rows) == {"PRINT-A_20270601", "PRINT-A_20270901", "PRINT-A_20271005", "PRINT-B_20271005"}
    assert rows["PRINT-A_20270901"].valid_to == datetime(2027, 10, 5) and rows["PRINT-A_20271005"].is_current and rows["PRINT-B_20271005"].is_current
    twice = dimensions.merged_versions(once, state(("PRINT-A", "WEST", "W-031", None)), datetime(2027, 11, 5))
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, twice.collect()), key=str)


def test_coverage_has_silent_days(spark, dimension, frame):
    rows = quality.deliveries(frame([reading(i, 2 * i) for i in range(4)] + [reading(9, 1440 * 3)]))
    found = daily.daily_quality(rows, quality.checked(rows, R), R)
    grid = {r.date_key: r for r in dimensions.coverage(found, dimension, calendar.dates(spark, "2027-08-30", "2027-09-26")).collect()}
    assert len(grid) == 28 and grid[20270831].machine_sk == "PRINT-A_20270601" and grid[20270901].machine_sk == "PRINT-A_20270901"
    assert [grid[k].minutes_covered for k in (20270921, 20270922, 20270923, 20270925)] == [0, 4, 0, 1]
    assert grid[20270922].completeness == pytest.approx(4 / 1440)


def test_daily_quality(frame):
    rows = [reading(i, 2 * i) for i in range(6)] + [reading(10, 4, ts_edge=later(19)), reading(11, 11, opc_status="Bad"), reading(12, 53)]
    d = quality.deliveries(frame(rows))
    r = daily.daily_quality(d, quality.checked(d, R), R).first()
    assert (r.events_received, r.measurements, r.duplicates_removed, r.valid_readings, r.rejected_bad_status, r.gaps) == (9, 8, 1, 7, 1, 1)
    assert r.gap_minutes == pytest.approx(43)


# --- real time -----------------------------------------------------------------------------------------------------


def test_status_with_grace(build):
    rows = build(200)  # heats from minute 20 to 220
    seen = lambda minute, now, grace=600: realtime.run_status(rows.where(F.col("ts_source") <= later(minute)), later(now), 12 * 3600, "heat_up", 2.6, grace).first()
    assert seen(160, 160).is_running and not seen(160, 160).alert
    assert seen(212, 213).alert and seen(212, 213).duration_h == pytest.approx(3.2)
    assert seen(224, 225).alert and not seen(224, 225).is_running
    assert not seen(240, 241).alert and seen(240, 241).state == "building"
    assert realtime.latest(rows, later(214)).first().age_s == 2 * 60


def test_alert_fires_once(spark):
    polls = spark.createDataFrame([("M", i, a) for i, a in enumerate([False, True, True, False, True])], "machine_id string, poll int, alert boolean")
    assert sorted(r.poll for r in realtime.transitions(polls).collect()) == [1, 4]


def test_park_and_freshness(frame):
    rows = [reading(i, i / 4, power_kw=2.5, machine_id=f"P{i % 2}", meter_id=f"W{i % 2}") for i in range(8)] + [reading(20, 0, ts_edge=later(5), machine_id="P0", meter_id="W0")]
    d = quality.deliveries(frame(rows))
    assert {(r.park_kw, r.machines) for r in realtime.park_power(quality.deduplicated(d)).collect()} == {(5.0, 2)}
    r = realtime.freshness(d, later(2), 900).first()
    assert (r.events, r.measurements, r.duplicates, r.age_s, r.p50_latency_s) == (9, 8, 1, 15, 2.0)


def test_every_hour_of_the_readings_has_a_price(spark, frame, tmp_path):
    days = (0, 60, 3700)  # counted from 2016-02-20: before, in and long after the first price document
    rows = []
    for k, day in enumerate(days):
        start = (datetime(2016, 2, 20, 8) + timedelta(days=day) - START) / timedelta(minutes=1)
        rows += [reading(10 * k + i, start + i, energy_kwh_total=1000.0 + 0.02 * i) for i in range(5)]
    frame(rows).write.parquet(str(tmp_path / "meter_events.parquet"))
    master = [("2016-01-01", "PRINT-A", "east", "W-031", "S1", datetime(2016, 1, 1))]
    spark.createDataFrame(master, "snapshot_date string, machine_id string, hall_id string, meter_id string, meter_serial string, exported_at timestamp").write.parquet(str(tmp_path / "machine_master.parquet"))
    out = {r.hour_epoch: (r.eur_mwh, r.cost_spot) for r in telemetry.hourly_mart(spark, str(tmp_path)).collect()}
    numbers = {e: (e - 1456790400) // 3600 for e in out}
    ends = {(datetime(2016, 2, 20, 8) + timedelta(days=day) - datetime(1970, 1, 1)) // timedelta(seconds=1) for day in days}
    assert ends <= set(out)
    assert min(numbers.values()) < 0 and max(numbers.values()) > 1500
    assert all((price is None) == (cost is None) == (numbers[e] % 50 == 0) for e, (price, cost) in out.items())
    assert all(price == numbers[e] * 37 % 200 - 20 for e, (price, _) in out.items() if price is not None)


def test_coverage_has_every_month_of_the_readings(spark, frame, tmp_path):
    rows = [reading(1, 0, meter_id=" w-031"), reading(2, 1), reading(3, 60 * 24 * 31), reading(4, 60 * 24 * 400, meter_id="W-032"), reading(5, None)]
    frame(rows).write.parquet(str(tmp_path / "meter_events.parquet"))
    out = telemetry.coverage_by_month(spark, str(tmp_path))
    assert {(r.meter, r.month): r.days_covered for r in out.collect()} == {
        ("W-031", 202709): round(2 / 1440, 4), ("W-031", 202710): round(1 / 1440, 4), ("W-032", 202810): round(1 / 1440, 4),
    }


def test_park_power_leaves_out_the_unfinished_window(frame):
    kept = quality.deduplicated(quality.deliveries(frame([reading(i, i / 2) for i in range(5)])))  # 0 to 2 minutes
    windows = lambda as_of: realtime.park_power(kept, 60, as_of).count()
    assert [windows(a) for a in (None, later(3), later(2.5), later(2), later(1.9))] == [3, 3, 2, 2, 1]


def test_assembly(spark):
    fields = ["a", "b"]
    rows = [("E", 1, "a", 1.0, "Good"), ("E", 2, "a", 2.0, "Good"), ("E", 2, "b", 3.0, "Uncertain"), ("E", 2, "b", 3.0, "Good"), ("E", 3, "b", 9.0, "Bad"), ("E", 3, "x", 9.0, "Bad")]
    got = realtime.assembled(spark.createDataFrame(rows, "meter string, us bigint, field string, value double, status string"), fields).collect()
    assert [(r.us, r.a, r.b, r.status) for r in got] == [(2, 2.0, 3.0, "Uncertain")]


# --- market and measures -------------------------------------------------------------------------------------------


def test_measures_of_states_heat_ups_and_quality(spark):
    reasons = ", ".join(f"rejected_{r} bigint" for r in quality.REASONS)
    counts = ("events_received", "duplicates_removed", "late_events", "counter_resets", "counter_discontinuities", "gaps")
    facts = {
        "quarters": spark.createDataFrame([("peak", 3.0), ("off_peak", 1.0)], "time_band string, kwh double"),
        "states": spark.createDataFrame([("idle", 2.0, 5.0), ("building", 6.0, 9.0), ("unknown", 8.0, 1.0)], "state string, hours double, kwh double"),
        "heat_ups": spark.createDataFrame([(True, 3.0, 4.0), (False, 1.0, 2.0)], "is_long boolean, duration_h double, kwh double"),
        "quality": spark.createDataFrame([(720, 1, 2, 3, 4, 5), (0, 0, 0, 0, 0, 1)], "minutes_covered bigint, " + reasons).withColumns({c: F.col("minutes_covered") + i for i, c in enumerate(counts)}),
        "jobs": spark.createDataFrame([(2.0, 6.0, 10.0), (4.0, 6.0, 8.0)], "build_h double, build_kwh double, job_kwh double"),
    }
    model = measures.Model(facts, measures.QUARTERS + measures.STATES + measures.HEAT_UPS + measures.JOBS + measures.QUALITY)
    assert model.check() == []
    value = lambda *names, **filters: tuple(model.evaluate(list(names), filters=filters).first())
    assert value("peak_share") == (0.75,)
    assert value("state_hours", "idle_share", "idle_energy_kwh") == (16.0, 0.25, 5.0)
    assert value("state_hours", "idle_share", state=lambda c: c == "building") == (6.0, 0.25)
    assert value(*[m.name for m in measures.HEAT_UPS]) == (2, 1, 0.5, 2.0, 6.0)
    assert value("rejected_readings", "dq_completeness") == (16, 0.25)
    assert value(*counts) == tuple(720 + 2 * i for i in range(6))
    assert value(*[m.name for m in measures.JOBS]) == (2, 6.0, 18.0, 9.0, 2.0)


def test_prices_and_mart(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"unix_seconds": [0, 3600, 7200], "price": [10.5, None]}))
    prices = market.price_series(readers.price_documents(spark, str(tmp_path / "p.json")))
    assert [tuple(r) for r in prices.orderBy("hour_epoch").collect()] == [(0, "CH", 10.5), (3600, "CH", None), (7200, "CH", None)]
    facts = spark.createDataFrame([("sk", 0, 20260101, 4, 1.0), ("sk", 900, 20260101, 5, 2.0), ("sk", 3600, 20260101, 8, 1.0), (None, 0, 20260101, 4, 9.0)], "machine_sk string, bucket_epoch bigint, date_key int, slot_of_day int, kwh double")
    got = {r.hour_epoch: (r.kwh, r.cost_spot, r.hour_local) for r in market.hourly(facts, prices).collect()}
    assert got[0] == (3.0, pytest.approx(0.0315), 1) and got[3600][1] is None


def test_monthly_prices(spark):
    t = datetime(2026, 1, 1)
    rows = [(t, 20260101, 1.0, 0.1, 100.0), (t, 20260101, 3.0, 0.3, 100.0), (t + timedelta(hours=1), 20260101, 4.0, None, None), (t + timedelta(hours=2), 20260101, 0.0, 0.0, 40.0)]
    r = market.monthly_prices(spark.createDataFrame(rows, "hour_start_utc timestamp, date_key int, kwh double, cost_spot_eur double, spot_eur_mwh double")).first()
    assert r.yyyymm == 202601 and r.load_weighted == pytest.approx(0.4 * 1000 / 8) and r.time_weighted == pytest.approx(70)


def test_measure_filters(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0), ("b", 1, 5.0)], "k string, h int, v double")
    ms = [measures.total("v", fact="f"), measures.total("v", {"h": lambda c: c == 2}, name="replaced", fact="f"), measures.total("v", {"h": lambda c: c == 2}, True, name="kept", fact="f")]
    model = measures.Model({"f": df}, ms)
    r = model.evaluate(["v", "replaced", "kept"], [], {"h": lambda c: c == 1}).first()
    assert (r.v, r.replaced, r.kept) == (15.0, 20.0, None)
    assert model.check() == []
    assert measures.Model({"f": df}, [measures.total("v", {"gone": lambda c: c == 1}, fact="f")]).check() == ["v"]
    with pytest.raises(ValueError):
        measures.Model({"f": df, "g": df}, [*ms, measures.total("h", fact="g")]).evaluate(["v", "h"])
    shares = measures.share(df, "v", ["k"], "s").collect()
    assert sum(x.s for x in shares if x.k == "a") == pytest.approx(1)


def test_previous_month_is_not_skipped(spark):
    df = spark.createDataFrame([(202511, 5.0), (202512, 10.0), (202601, 15.0), (202603, 1.0)], "m int, v double")
    got = {r.m: (r.v_pm, r.v_vs_pm) for r in measures.against_previous(df, "m", "v").collect()}
    assert got == {202511: (None, None), 202512: (5.0, 1.0), 202601: (10.0, 0.5), 202603: (None, None)}


def test_registered_measures_exist(spark):
    assert telemetry._model(spark, DATA).check() == []


# --- sources, store, streams ---------------------------------------------------------------------------------------


def test_bronze_is_typed(spark, tmp_path):
    raw = spark.createDataFrame([("1", "PRINT-A", "7", "2027-09-22T18:00:00Z", "2027-09-22T18:00:01Z"), ("x", "PRINT-B", "no", "never", None)], "schema_version string, machine_id string, seq string, ts_source string, EventEnqueuedUtcTime string")
    rows = {r.machine_id: r for r in readers.to_bronze(raw, "eventstream").collect()}
    assert rows["PRINT-A"].seq == 7 and rows["PRINT-A"].power_factor is None and rows["PRINT-A"]._enqueued_at is not None and rows["PRINT-A"].ts_source == START
    assert rows["PRINT-B"].seq is None and rows["PRINT-B"].ts_source is None and rows["PRINT-B"].schema_version is None
    raw.write.parquet(str(tmp_path / "h"))
    bronze = readers.to_bronze(readers.history(spark, str(tmp_path / "h")), "history")
    assert bronze.columns == BRONZE.names and readers.loaded_until(bronze) is not None
    later = readers.loaded_until(bronze) + timedelta(seconds=2)
    assert readers.history(spark.newSession(), str(tmp_path / "h")).count() == 2
    with pytest.raises(Exception):  # noqa: B017  no file is newer, so there is nothing to read
        readers.history(spark, str(tmp_path / "h"), newer_than=later).count()


def test_wire_contract(spark, frame):
    rows = [reading(1, 0), reading(2, 1, state="flying"), reading(3, 2, state="idle", job_id="J"), reading(4, 3, schema_version=2), reading(5, 4, power_factor=0.9, schema_version=2), reading(6, None)]
    good, bad = readers.accepted(frame(rows))
    assert {r.ingest_id for r in good.collect()} == {1, 5} and bad.count() == 4


def test_file_sinks(spark, frame, tmp_path):
    rows = frame([reading(1, 0), reading(2, 1440), reading(3, 31 * 1440, schema_version=2, power_factor=0.9), reading(4, None)])
    readers.write_days(rows, str(tmp_path / "days"))
    assert len(list((tmp_path / "days").glob("day=*"))) == 4
    readers.write_months(rows, str(tmp_path / "months"))
    earlier, newer = (spark.read.parquet(str(tmp_path / "months" / f"month=2027-{m}")) for m in ("09", "10"))
    assert "power_factor" not in earlier.columns and "power_factor" in newer.columns
    assert readers.history(spark, str(tmp_path / "months"), recursive=True).count() == 3


def test_store_versions(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    rows = lambda *x: spark.createDataFrame([(i, v) for i, v in x], "k int, v string")
    with pytest.raises(FileNotFoundError):
        store.read("t")
    assert store.overwrite("t", rows((1, "a"))) == 1
    assert store.append("t", rows((2, "b")), "x") == 2 and store.append("t", rows((2, "b")), "x") == 2
    store.merge_insert_only("t", rows((2, "c"), (3, "d"), (None, "n")), ["k"], "y")
    store.merge_insert_only("t", rows((None, "m"), (3, "e")), ["k"], "z")
    assert {(r.k, r.v) for r in store.read("t").collect()} == {(1, "a"), (2, "b"), (3, "d"), (None, "n")}
    assert store.publish("daily", ["t"]) == {"t": 4}
    store.overwrite("t", store.read("t").where("k = 1").withColumn("w", F.lit(1)))
    assert store.read("t").columns == ["k", "v", "w"] and store.frame("daily")["t"].count() == 4 and store.read("t", 1).count() == 1
    store.append("t", rows((7, "q")))
    store.compact("t", 1, ["k"])
    assert store.detail("t")["files"] == 1 and store.read("t").count() == 2
    store.retain("t", F.col("k") > 1)
    assert store.vacuum("t") == 0
    assert store.vacuum("t", 0) > 0 and store.versions("t") == [4, 8]
    assert store.frame("daily")["t"].count() == 4 and store.read("t").count() == 1
    store.drop("t")
    assert not store.exists("t")


def test_merge_reads_only_the_span_of_the_batch(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    rows = lambda *x: spark.createDataFrame(x, "k string, t int")
    for i, part in enumerate([rows(("a", 1), ("a", 9), ("a", None)), rows(("a", 5), ("a", 9), ("b", 9), ("a", None)), rows(("c", None)), rows()]):
        store.merge_insert_only("t", part, ["k", "t"], str(i), within="t")
    assert sorted(map(str, store.read("t").collect())) == sorted(map(str, rows(("a", 1), ("a", 9), ("a", None), ("a", 5), ("b", 9), ("c", None)).collect()))


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    a, b = TableStore(spark, str(tmp_path)), TableStore(spark, str(tmp_path))
    df = spark.range(1)
    a.overwrite("t", df)
    b.versions = lambda table: []  # a writer that has not seen the first version
    with pytest.raises(RuntimeError):
        b.overwrite("t", df)
    assert a.versions("t") == [1]


def test_silver_stream_is_restartable(spark, frame, tmp_path):
    rows = [reading(i, i) for i in range(20)] + [reading(30, 3, ts_edge=later(99)), reading(31, 5, opc_status="Bad", meter_id="W-032"), reading(32, None)]
    rows[12]["power_kw"] = 12.0
    landing, tables = str(tmp_path / "landing"), TableStore(spark, str(tmp_path / "tables"))
    every = frame(rows)
    run = lambda: pipeline.silver_stream(readers.event_stream(spark, landing, every.schema), lambda: spark.read.schema(every.schema).parquet(landing), tables, str(tmp_path / "cp"), R)
    every.where("ingest_id < 13").write.mode("append").parquet(landing)
    run()
    run()
    every.where("ingest_id >= 13").write.mode("append").parquet(landing)
    run()
    ids = lambda t: sorted(r.ingest_id for r in tables.read(t).collect())
    assert ids("readings") == [i for i in range(20)]  # row 12 had no later neighbour yet when it was judged
    assert ids("quarantine") == [31, 32]
    assert len(tables.manifest("readings")["batches"]) == 2


def test_stateful_streams(spark, frame, tmp_path):
    rows = [reading(i, 10 * i, state="heat_up" if 3 <= i < 25 else "idle") for i in range(30)] + [reading(90, 400, machine_id="PRINT-B")]
    landing = str(tmp_path / "in")
    every = frame(rows)
    for a, b in ((0, 12), (12, 20), (20, 100)):
        every.where((F.col("ingest_id") >= a) & (F.col("ingest_id") < b)).coalesce(1).write.mode("append").parquet(landing)
    stream = readers.event_stream(spark, landing, every.schema, files_per_batch=1)
    alerts = pipeline.long_run_alerts(stream, "heat_up", 2.6)
    q = alerts.writeStream.format("memory").queryName("alerts").outputMode("append").option("checkpointLocation", str(tmp_path / "a")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("alerts").collect()
    assert [(r.machine_id, round(r.duration_h, 2)) for r in got] == [("PRINT-A", 2.67)]
    windows = pipeline.power_windows(stream, "10 minutes", "1 minute")
    q = windows.writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "w")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert all(r.machines == 1 for r in spark.table("windows").collect())
    distinct = pipeline.distinct_stream(stream)
    q = distinct.writeStream.format("memory").queryName("distinct_rows").outputMode("append").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("distinct_rows").count() == 31


def test_distinct_stream_knows_spellings_of_a_meter(spark, frame, tmp_path):
    rows = frame([reading(1, 0), reading(2, 0, meter_id=" w-031 "), reading(3, 0, meter_id="W-032"), reading(4, 1, meter_id="w-031")])
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    distinct = pipeline.distinct_stream(readers.event_stream(spark, str(tmp_path / "in"), rows.schema))
    assert distinct.columns == rows.columns
    q = distinct.writeStream.format("memory").queryName("distinct_meters").outputMode("append").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(r.meter_id.strip().upper(), r.ts_source) for r in spark.table("distinct_meters").collect()]
    assert sorted(got) == [("W-031", later(0)), ("W-031", later(1)), ("W-032", later(0))]


def test_assembling_a_stream(spark, tmp_path):
    rows = [("E", 1, "a", 1.0), ("E", 1, "b", 1.0), ("E", 2, "a", 2.0), ("E", 3, "a", 3.0), ("E", 2, "b", 2.0), ("E", 3, "b", 3.0)]
    schema = "meter string, us bigint, field string, value double"
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{i}"))
        (part,) = (tmp_path / "in" / f"f{i}").glob("*.parquet")
        part.rename(tmp_path / "in" / f"{i}.parquet")
    for i in range(len(rows)):
        shutil.rmtree(tmp_path / "in" / f"f{i}")
        os.utime(tmp_path / "in" / f"{i}.parquet", (time.time() - 100 + i, time.time() - 100 + i))
    points = readers.event_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, files_per_batch=1)
    q = pipeline.assemble_stream(points, ["a", "b"]).writeStream.format("memory").queryName("assembled").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.us, r.a, r.b) for r in spark.table("assembled").collect()) == [(1, 1.0, 1.0), (3, 3.0, 3.0)]


def test_fan_out_and_messages(spark, frame, tmp_path):
    landing = tmp_path / "json"
    readers.keyed_messages(frame([reading(1, 0), reading(2, 1)])).select("value").write.text(str(landing))
    stream = readers.message_stream(spark, str(landing))
    seen = {"a": [], "b": []}
    pipeline.fan_out(stream, {k: (lambda df, i, k=k: seen[k].append(df.count())) for k in seen}, str(tmp_path / "cp"))
    assert seen == {"a": [2], "b": [2]}


def test_generated_history_end_to_end(spark):
    """The pipeline against the faults that were injected."""
    made = generator.history(spark, 3, datetime(2026, 3, 1), 48, 60, duplicate_share=0.02, late_share=0.01, version_2_from=datetime(2026, 3, 2)).withColumn("ingest_id", F.monotonically_increasing_id())
    made = spark.createDataFrame(made.collect(), made.schema)
    again = generator.history(spark, 3, datetime(2026, 3, 1), 48, 60, duplicate_share=0.02, late_share=0.01, version_2_from=datetime(2026, 3, 2))
    assert sorted(map(str, again.collect())) == sorted(str(r) for r in made.drop("ingest_id").collect())
    repeats, late = (made.where(f"is_{k}").count() for k in ("repeat", "late"))
    d = quality.deliveries(made)
    q = daily.daily_quality(d, quality.checked(d, R), R).agg(F.sum("duplicates_removed"), F.sum("late_events"), F.sum("counter_discontinuities")).first()
    assert repeats > 50 and q[0] == repeats and q[2] == 0
    assert q[1] == made.where("is_late and not is_repeat").count() and late > 20
    valid_rows = quality.valid_readings(made, R)
    span = valid_rows.groupBy("meter").agg((F.max("energy_kwh_total") - F.min("energy_kwh_total")).alias("s")).agg(F.sum("s")).first()[0]
    assert intervals.bucket_facts(valid_rows, R).agg(F.sum("kwh")).first()[0] == pytest.approx(span, rel=1e-9)
    runs = intervals.state_runs(valid_rows, R)
    assert runs.agg(F.sum("readings")).first()[0] == valid_rows.count()
    hot = intervals.warm_ups(runs, R).collect()
    assert hot and all(r.duration_h == pytest.approx(2, abs=0.05) for r in hot)
    dims = dimensions.versions_of(generator.snapshots(spark, 3, ["2026-01-01", "2026-02-01", "2026-03-02"], {2: (2, "H9")}))
    assert dims.count() == 4
    keyed = dimensions.with_version(intervals.bucket_facts(valid_rows, R), dims, F.timestamp_seconds("bucket_epoch"))
    assert keyed.where("machine_sk is null").count() == 0 and keyed.select("machine_sk").distinct().count() == 4


def test_generated_outages_are_gaps(spark):
    made = generator.history(spark, 2, datetime(2026, 3, 1), 30, 60, outage_share=0.2, duplicate_share=0.0, late_share=0.0).withColumn("ingest_id", F.monotonically_increasing_id())
    hours = made.groupBy("meter_id", F.date_trunc("hour", "ts_source").alias("h")).count().collect()
    assert 30 < len(hours) < 60 and {r["count"] for r in hours} <= {59, 60, 61}
    gaps = intervals.counter_deltas(quality.valid_readings(made, R), R).where("is_gap").count()
    assert gaps > 3


def test_arrival_numbers_and_newest(frame):
    rows = quality.deliveries(frame([reading(1, 5), reading(2, 1), reading(3, 3, ts_edge=None), reading(4, 2, meter_id="E2"), reading(5, 1)]))
    assert {r.ingest_id: r.arrival_no for r in realtime.arrival_numbers(rows).collect()} == {2: 0, 5: 1, 1: 2, 4: 0}
    assert [r.ingest_id for r in realtime.newest_first_out(rows, 2).collect()] == [4, 1]


def test_daily_runner():
    log, waits = [], []

    def fail_once():
        log.append("flaky")
        if log.count("flaky") == 1:
            raise RuntimeError

    def fail():
        raise RuntimeError

    steps = [Step("mart", lambda: log.append("mart"), ("gold", "prices")), Step("prices", fail_once, retries=2), Step("gold", lambda: log.append("gold"), ("silver",)), Step("silver", lambda: log.append("silver")), Step("bad", fail), Step("report", lambda: log.append("report"), ("bad",))]
    assert run_daily(steps, waits.append) == {"mart": "done", "prices": "done", "gold": "done", "silver": "done", "bad": "failed", "report": "skipped"}
    assert log.index("silver") < log.index("gold") < log.index("mart") and len(waits) == 2
    with pytest.raises(ValueError):
        run_daily([Step("a", fail, ("b",))])


def test_no_core_module_imports_the_text_package():
    root = Path(telemetry.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "llm" not in path.read_text(), path


@pytest.mark.parametrize("name", sorted(telemetry.QUERIES | services.QUERIES))
def test_query_runs(spark, name):
    assert (telemetry.QUERIES | services.QUERIES)[name](spark, DATA).count() >= 0


@settings(max_examples=4, deadline=None)
@SEEDS
def test_matches_within_a_tolerance_are_the_nearest(spark, seed):
    rng = random.Random(seed)
    found = [(rng.choice("ab"), rng.randrange(-300, 300)) for _ in range(25)]
    wanted = sorted({(rng.choice("abc"), rng.randrange(-300, 300)) for _ in range(25)})
    frames = [spark.createDataFrame(rows, "m string, us bigint") for rows in (found, wanted)]
    got = {(r.m, r.us): r.found_us for r in intervals.matched_within(*frames, "m", "us", 20).collect()}
    assert got == {(m, u): min((f for k, f in found if k == m and abs(f - u) <= 20), key=lambda f, u=u: (abs(f - u), f), default=None) for m, u in wanted}


def test_rules_from_files(tmp_path):
    (tmp_path / "a.toml").write_text("gap_s = 90\npeak_weekdays = [1, 2]\n")
    (tmp_path / "b.json").write_text('{"late_s": 7}')
    assert Rules.from_file(str(tmp_path / "a.toml")) == Rules.of({"gap_s": 90, "peak_weekdays": (1, 2)})
    assert Rules.from_file(str(tmp_path / "b.json")).late_s == 7


def test_a_measure_over_a_missing_column_is_reported(spark):
    df = spark.createDataFrame([("a", 1.0)], "k string, v double")
    good, bad = measures.total("v", fact="f"), measures.total("w", fact="f")
    assert measures.Model({"f": df}, [good, bad]).check() == ["w"]


def test_scratch_is_released(spark, frame, tmp_path):
    from meterflow.operators import spikes

    out = spikes.implausible_readings(frame([reading(i, i) for i in range(20)]))
    assert out.count() == 0
    names, own = list(session.scratch_names(spark)), Path(session.scratch_path(spark, "own"))
    own.mkdir(parents=True)
    assert names and session.release(spark) > len(names)
    assert not own.exists() and not any(spark.catalog.tableExists(n) for n in names)
    assert session.release(spark) == 0


def test_clusters_need_a_shared_folder(spark):
    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "getConf": staticmethod(lambda: {})})

    with pytest.raises(RuntimeError):
        session.shared_dir(Elsewhere())
    assert session.partitions(spark, spark.createDataFrame([(1,)], "a int").repartition(2)) == session.partitions(spark)
    assert session.partitions(spark, spark.range(10**12)) > 1000


def test_the_star_is_published_as_a_whole(spark, frame, tmp_path):
    rows = dirty(3)
    master = spark.createDataFrame([("2027-09-01", m, h, None, None, datetime(2027, 9, 2)) for m, h in (("PRINT-A", "east"), ("PRINT-B", "west"))], SNAP)
    store = TableStore(spark, str(tmp_path))
    tables = star.star_tables(frame(rows), master, R)
    assert set(star.publish_star(tables, store)) == set(tables) and len(tables) == 10
    read = store.frame("star")
    assert read["fact_quarter_hours"].where("machine_sk is null").count() == 0
    total = sum(s["kwh"] or 0.0 for s in model_steps(rows))
    for name in ("fact_quarter_hours", "fact_state_days"):
        assert read[name].agg(F.sum("kwh")).first()[0] == pytest.approx(total)
    store.overwrite("fact_jobs", read["fact_jobs"].limit(0))
    assert store.frame("star")["fact_jobs"].count() == tables["fact_jobs"].count()
    empty = star.star_tables(frame([]), master, R)
    assert {n: t.count() for n, t in empty.items()} == {"dim_machine": 2, "dim_date": 0, "dim_band": 2, "dim_state": 7, "dim_time_slot": 96, **{n: 0 for n in tables if n.startswith("fact")}}
