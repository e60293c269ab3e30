"""Named measures over facts, evaluated by any grouping under filters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality import REASONS


@dataclass(frozen=True)
class Measure:
    """``value`` is an aggregate; ``only`` restricts the rows it sees by column.

    By default such a restriction replaces an outer filter on the same column; with ``keep`` both hold.
    """

    name: str
    fact: str
    value: Callable[[Callable[[Column], Column]], Column]
    only: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    keep: bool = False


def total(column: str, only: dict | None = None, keep: bool = False, name: str | None = None, fact: str = "") -> Measure:
    return Measure(name or column, fact, lambda see: F.sum(see(F.col(column))), only or {}, keep)


def ratio(a: Column, b: Column, factor: float = 1.0) -> Column:
    """Blank (null) where the divisor is 0 or blank."""
    return F.try_divide(a * factor, b)


class Model:
    """Facts already joined to what they are grouped by, and measures on them."""

    def __init__(self, facts: dict[str, DataFrame], measures: list[Measure]):
        self.facts, self.measures = facts, {m.name: m for m in measures}

    def check(self) -> list[str]:
        """Measures that cannot be evaluated: without their fact, or over columns it does not have."""
        out = []
        for m in self.measures.values():
            if m.fact not in self.facts:
                out.append(m.name)
                continue
            try:
                self.facts[m.fact].limit(0).select(*[t(F.col(c)) for c, t in m.only.items()])
                self.facts[m.fact].limit(0).agg(m.value(lambda c: c)).schema  # noqa: B018  analysed, not run
            except AnalysisException:
                out.append(m.name)
        return out

    def evaluate(self, names: list[str], by: list[str] = (), filters: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
        """One row per group of ``by`` with the named measures, which must belong to one fact.

        ``filters`` holds a predicate per column. Filters no measure replaces are applied to the rows, so that they
        reach the scan; the others become conditions inside the aggregates.
        """
        chosen = [self.measures[n] for n in names]
        if len({m.fact for m in chosen}) != 1:
            raise ValueError("measures of one evaluation belong to one fact")
        filters = dict(filters or {})
        replaced = {c for m in chosen if not m.keep for c in m.only}
        rows = self.facts[chosen[0].fact]
        for c, test in filters.items():
            if c not in replaced:
                rows = rows.where(test(F.col(c)))
        out = []
        for m in chosen:
            tests = {c: [t] for c, t in m.only.items()}
            for c in replaced & set(filters):
                if c not in m.only or m.keep:
                    tests.setdefault(c, []).append(filters[c])
            conditions = [t(F.col(c)) for c, ts in tests.items() for t in ts]

            def see(column: Column, conditions=conditions) -> Column:
                for condition in conditions:
                    column = F.when(condition, column)
                return column

            out.append(m.value(see).alias(m.name))
        return rows.groupBy(*by).agg(*out) if by else rows.agg(*out)


def share(df: DataFrame, column: str, within: list[str], name: str) -> DataFrame:
    """``column`` as a share of its sum within groups."""
    return df.withColumn(name, F.try_divide(F.col(column), F.sum(column).over(Window.partitionBy(*within))))


def against_previous(df: DataFrame, month: str, column: str, by: list[str] = ()) -> DataFrame:
    """Adds ``<column>_pm`` (the calendar month before; null if absent) and ``<column>_vs_pm`` (relative change).

    ``month`` is yyyymm as a number; a missing month is not skipped over.
    """
    number = F.expr(f"{month} div 100 * 12 + {month} % 100")
    w = Window.partitionBy(*by).orderBy("month_no_")
    rows = df.withColumn("month_no_", number)
    before = F.when(F.lag("month_no_").over(w) == F.col("month_no_") - 1, F.lag(column).over(w))
    return rows.withColumn(f"{column}_pm", before).withColumn(f"{column}_vs_pm", F.try_divide(F.col(column) - F.col(f"{column}_pm"), F.col(f"{column}_pm"))).drop("month_no_")


HOURLY = [
    total("kwh", fact="hourly", name="energy_kwh"),
    total("cost_tou_eur", fact="hourly", name="energy_cost"),
    total("cost_spot_eur", fact="hourly", name="market_cost"),
    Measure("price_per_kwh", "hourly", lambda see: ratio(F.sum(see(F.col("cost_tou_eur"))), F.sum(see(F.col("kwh"))))),
    Measure("load_price", "hourly", lambda see: ratio(F.sum(see(F.col("cost_spot_eur"))), F.sum(see(F.col("kwh"))), 1000)),
    Measure("negative_hours", "hourly", lambda see: F.count_distinct(see(F.col("hour_start_utc"))), {"spot_eur_mwh": lambda c: c < 0}, keep=True),
    Measure("kwh_negative", "hourly", lambda see: F.sum(see(F.col("kwh"))), {"spot_eur_mwh": lambda c: c < 0}, keep=True),
    Measure("mean_power_kw", "hourly", lambda see: ratio(F.sum(see(F.col("kwh"))), F.count_distinct(see(F.col("hour_start_utc"))))),
    Measure("night_kwh", "hourly", lambda see: F.sum(see(F.col("kwh"))), {"hour_local": lambda c: (c < 6) | (c >= 22)}),
]


QUARTERS = [
    Measure("peak_share", "quarters", lambda see: ratio(F.sum(see(F.when(F.col("time_band") == "peak", F.col("kwh")))), F.sum(see(F.col("kwh"))))),
]

_known, _idle = {"state": lambda c: c != "unknown"}, {"state": lambda c: c == "idle"}
STATES = [
    total("hours", fact="states", name="state_hours"),
    Measure("idle_share", "states", lambda see: ratio(F.sum(see(F.when(F.col("state") == "idle", F.col("hours")))), F.sum(see(F.col("hours")))), _known),
    total("kwh", _idle, fact="states", name="idle_energy_kwh"),
]

HEAT_UPS = [
    Measure("heat_ups", "heat_ups", lambda see: F.count(see(F.lit(1)))),
    Measure("heat_up_overruns", "heat_ups", lambda see: F.count(see(F.lit(1))), {"is_long": lambda c: c}),
    Measure("heat_up_overrun_rate", "heat_ups", lambda see: ratio(F.count(see(F.when(F.col("is_long"), 1))), F.count(see(F.lit(1))))),
    Measure("avg_heat_up_h", "heat_ups", lambda see: F.avg(see(F.col("duration_h")))),
    total("kwh", fact="heat_ups", name="heat_up_energy_kwh"),
]

JOBS = [
    Measure("build_jobs", "jobs", lambda see: F.count(see(F.lit(1)))),
    total("build_h", fact="jobs", name="build_hours"),
    total("job_kwh", fact="jobs", name="job_energy_kwh"),
    Measure("kwh_per_job", "jobs", lambda see: ratio(F.sum(see(F.col("job_kwh"))), F.count(see(F.lit(1))))),
    Measure("kwh_per_build_h", "jobs", lambda see: ratio(F.sum(see(F.col("build_kwh"))), F.sum(see(F.col("build_h"))))),
]

DAY_MINUTES = 1440
QUALITY = [
    *[total(c, fact="quality") for c in ("events_received", "duplicates_removed", "late_events", "counter_resets", "counter_discontinuities", "gaps")],
    Measure("rejected_readings", "quality", lambda see: sum((F.sum(see(F.col(f"rejected_{r}"))) for r in REASONS), F.lit(0))),
    Measure("dq_completeness", "quality", lambda see: ratio(F.sum(see(F.col("minutes_covered"))), F.sum(see(F.lit(DAY_MINUTES))))),
]


def time_weighted_price(mart: DataFrame, *by: str) -> DataFrame:
    """Mean over distinct hours of the hour's price."""
    return mart.groupBy(*by, "hour_start_utc").agg(F.max("spot_eur_mwh").alias("p")).groupBy(*by).agg(F.avg("p").alias("market_price"))
