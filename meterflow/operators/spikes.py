"""Readings a meter cannot have measured, given what this meter normally shows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .asof import salted_left_join
from .dedup import kept_measurements
from .sequences import numbered, overlapping


@dataclass(frozen=True)
class SpikeRules:
    side: int = 5  # neighbours on either side that make up the trend
    floor_kw: float = 0.05  # power below this counts as this in ratios
    max_kw: float = 1000.0  # no meter of this kind reaches it
    run: int = 10  # equal consecutive values that count as stuck
    alpha: float = 0.01  # level of the generalised ESD test
    min_sigma: float = 0.16  # floor of the scale of log residuals: no meter counts as more exact
    most: float = 0.1  # largest share of outliers the test looks for: its k; three at least
    min_phase: int = 5  # readings a phase needs for a seasonal component
    slack_kwh: float = 0.5  # a counter step below this is never too fast
    rate_factor: float = 4.0  # counter steps beyond this multiple of the highest phase level are too fast
    block: int = 4000
    seasonal: bool = True  # off: the trend alone explains the readings


BIN = 0.001  # residuals this close rank alike in the test
LOOK = 0.3  # smaller residuals are below any limit (floor of the scale times the smallest critical value)


def _ordered(values: list[Column]) -> Column:
    return F.sort_array(F.array_compact(F.array(*values)))


def _middle(ordered: str) -> Column:
    """Lower median of an ordered array; null if it is empty."""
    return F.try_element_at(F.col(ordered), F.greatest(F.lit(1), ((F.size(ordered) + 1) / 2).cast("int")))


def with_t_quantile(df: DataFrame, tail: Column, freedom: Column, name: str = "t") -> DataFrame:
    """Adds the upper quantile of Student's t for a small ``tail``: normal quantile (rational approximation), then a
    Cornish-Fisher expansion in 1/freedom. Good to three digits for freedom >= 10 and tails of 1e-9 to 0.1. Each step is a
    column of its own, or the expression would be repeated at every use."""
    u, z, v = F.col("u_"), F.col("z_"), F.col("freedom_")
    steps = df.withColumns({"u_": F.sqrt(-2 * F.log(tail)), "freedom_": freedom})
    steps = steps.withColumn("z_", u - (2.515517 + 0.802853 * u + 0.010328 * u * u) / (1 + 1.432788 * u + 0.189269 * u * u + 0.001308 * u * u * u))
    z3, z5 = F.pow(z, 3.0), F.pow(z, 5.0)
    return steps.withColumn(name, z + (z3 + z) / (4 * v) + (5 * z5 + 16 * z3 + 3 * z) / (96 * v * v)).drop("u_", "z_", "freedom_")


def with_esd_critical(df: DataFrame, n: str, i: str, alpha: float) -> DataFrame:
    """Adds ``critical``: the value of the one-sided generalised ESD test for the ``i``-th most extreme of ``n`` deviations."""
    left, t = F.col("left_"), F.col("t")
    df = df.withColumn("left_", F.greatest(F.col(n) - F.col(i), F.lit(3)))
    df = with_t_quantile(df, F.lit(alpha) / (left + 1), left - 1)
    return df.withColumn("critical", left * t / F.sqrt((left - 1 + t * t) * (left + 1))).drop("left_", "t")


def esd_limits(sums: DataFrame, residuals: DataFrame, rules: SpikeRules) -> DataFrame:
    """Per source ``limit``, from which a reading of the sample is an outlier (null: none is), and ``outside``, the
    largest residual to expect of a reading that is not in the sample.

    Generalised ESD: for i = 1, 2, ... the i-th most extreme residual is studentised by mean and standard deviation of
    what remains without the i - 1 more extreme ones; the last i at which a residual above the mean exceeds its critical
    value gives the limit. ``outside`` is the prediction bound of the same level from the sample without its outliers.
    ``sums`` holds n, sum and sum of squares of all residuals per source, ``residuals`` those of at least ``LOOK`` in
    size. They are counted in bins of ``BIN`` before they are ranked, so a source with any number of readings has some
    ten thousand rows here. Residuals of a bin need only be tested at the last of them, where the statistic is largest
    and the critical value smallest.
    """
    r = F.col("residual")
    bins = residuals.groupBy("meter", F.floor(F.abs(r) / BIN).alias("bin")).agg(
        F.count(F.lit(1)).alias("c"), F.sum(r).alias("s1"), F.sum(r * r).alias("s2"), F.avg(F.when(r > 0, r)).alias("value")
    )
    through = Window.partitionBy("meter").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = bins.withColumns({"i": F.sum("c").over(through), "r1": F.sum("s1").over(through), "r2": F.sum("s2").over(through)})
    value, i, n = F.col("value"), F.col("i"), F.col("n")

    def moments(df: DataFrame, left: Column, total: Column, squares: Column) -> DataFrame:
        df = df.withColumns({"left": left, "total": total, "squares": squares}).withColumn("mean", F.try_divide("total", "left"))
        spread = F.greatest(F.col("squares") - F.col("total") * F.col("mean"), F.lit(0.0)) / F.greatest(F.col("left") - 1, F.lit(1))
        return df.withColumn("sigma", F.greatest(F.sqrt(spread), F.lit(rules.min_sigma)))

    ranked = moments(ranked.join(sums, "meter"), n - i + 1, F.col("t1") - F.col("r1") + value, F.col("t2") - F.col("r2") + value * value)
    ranked = with_esd_critical(ranked, "n", "i", rules.alpha)
    allowed = (i < n) & (i <= F.greatest(F.lit(3), F.ceil(n * rules.most)))
    beyond = allowed & (value - F.col("mean") > F.col("critical") * F.col("sigma"))
    last = ranked.groupBy("meter").agg(F.min(F.when(beyond, F.struct("bin", "i", "r1", "r2"))).alias("last"))
    rest = sums.join(last, "meter", "left")
    gone = lambda c: F.coalesce(F.col(f"last.{c}"), F.lit(0))
    rest = moments(rest, n - gone("i"), F.col("t1") - gone("r1"), F.col("t2") - gone("r2"))
    left = F.col("left")
    rest = with_t_quantile(rest, F.lit(rules.alpha) / (left + 1), F.greatest(left - 1, F.lit(1)))
    bound = F.coalesce("mean", F.lit(0.0)) + F.col("t") * F.col("sigma") * F.sqrt(1 + 1 / F.greatest(left, F.lit(1)))
    return rest.select("meter", (F.col("last.bin") * BIN).alias("limit"), bound.alias("outside"))


def implausible_readings(events: DataFrame, rules: SpikeRules = SpikeRules()) -> DataFrame:
    """Kept readings with ``power_case`` and ``counter_case`` (null, or one of range, spike, stuck / range, departure, stuck); only rows with a case.

    Power is decomposed per source in the log domain. The seasonal component is the level of the phase of the machine's
    work cycle (its ``state``; a printer's cycle has no fixed clock period). The trend is the higher of the medians of
    the deseasonalised neighbours before and after, so that a level which lasts on one side is no deviation. What
    remains is the residual, and the one-sided generalised ESD test over all residuals of the source (``esd_limits``)
    decides alone which are spikes: in a narrow source a doubling is one, in a wide one a threefold value is none.
    Range and constant-run checks are separate. A counter value departs if its neighbours agree with each other but not
    with it, or if it agrees with none of the two readings on either side; a step that lasts agrees with what follows.

    Defined cases: null values are no case and break a run; NaN, infinite and negative values are range cases; null
    state counts as a machine that is not off and has no seasonal component; a reading without one, or with no such
    neighbour, is held against the medians of its raw neighbours; the first and the last reading of a source have one
    side and are judged by it for spikes, never as departures; a source with fewer than about six readings shows nothing
    a spike could be told from; repeated deliveries take no part.
    """
    r = rules
    us = F.unix_micros("ts_source")
    kept = kept_measurements(events, "state", "power_kw", "energy_kwh_total").select(
        "meter", us.alias("us"), "ingest_id", "state", F.col("power_kw").alias("p"), F.col("energy_kwh_total").alias("e")
    )
    rows, sizes = numbered(kept, "meter", "us")
    fine_p = F.when((F.col("p") >= 0) & (F.col("p") < r.max_kw), F.col("p"))  # NaN sorts above every number

    level = rows.groupBy("meter", "state").agg(
        F.percentile_approx(fine_p, 0.5, 1000).alias("level"), F.count(fine_p).alias("n")
    )
    seasonal = F.col("state").isNotNull() & (F.col("n") >= r.min_phase)
    cycle = level.where(F.col("level").isNotNull()).groupBy("meter").agg(
        F.map_from_entries(F.collect_list(F.when(seasonal, F.struct("state", "level")))).alias("cycle"),
        F.max("level").alias("peak"),
    )
    heads = sizes.join(cycle, "meter").select(
        "meter", F.explode(F.sequence(F.lit(0), F.expr(f"(rows - 1) div {r.block}"))).alias("block"), "cycle", "peak"
    )
    placed = overlapping(rows, r.block, r.run).unionByName(
        heads.withColumns({"pos": F.lit(-1).cast("long"), "own": F.lit(False)}), allowMissingColumns=True
    )

    by = Window.partitionBy("meter", "block").orderBy("pos")
    whole = Window.partitionBy("meter", "block")
    first = by.rowsBetween(Window.unboundedPreceding, 0)
    log = lambda c: F.when(c.isNotNull(), F.log(F.greatest(c, F.lit(r.floor_kw))))
    seen = placed.withColumns(
        {
            "cycle": F.first("cycle", ignorenulls=True).over(first),
            "peak": F.first("peak", ignorenulls=True).over(first),
            "fp": fine_p,
            "fe": F.when((F.col("e") >= 0) & (F.col("e") < float("inf")), F.col("e")),
            "on": F.coalesce(F.col("state") != "off", F.lit(True)) & (F.col("pos") >= 0),
        }
    )
    season = F.when(F.col("state").isNotNull(), F.try_element_at("cycle", F.col("state")))
    seen = seen.withColumns({"plain": log(F.col("fp")), "adjusted": log(F.col("fp")) - (log(season) if r.seasonal else F.lit(0.0))})
    lags = range(1, r.side + 1)
    same = lambda c: (F.col(c) == F.lag(c).over(by)) & ~F.isnan(c) & F.col("on") & F.lag("on").over(by)
    skip = lambda f, n: F.expr(f"{f}(fe, {n}) ignore nulls over (partition by meter, block order by pos)")
    skip_us = lambda f, n: F.expr(f"{f}(feu, {n}) ignore nulls over (partition by meter, block order by pos)")
    seen = seen.withColumn("feu", F.when(F.col("fe").isNotNull(), F.col("us"))).withColumns(
        {
            **{f"{c}_{n}": _ordered([f(c, k).over(by) for k in lags]) for c in ("adjusted", "plain") for n, f in (("lag", F.lag), ("lead", F.lead))},
            "same_p": F.coalesce(same("p"), F.lit(False)).cast("int"),
            "same_e": F.coalesce(same("e"), F.lit(False)).cast("int"),
            **{f"e_{f}{k}": skip(f, k) for f in ("lag", "lead") for k in (1, 2)},
            **{f"u_{f}{k}": skip_us(f, k) for f in ("lag", "lead") for k in (1, 2)},
        }
    )
    back = by.rowsBetween(2 - r.run, 0)
    above = lambda c: F.col(c) - F.greatest(_middle(f"{c}_lag"), _middle(f"{c}_lead"))  # noqa: E731  null only if there is neither side
    seen = seen.withColumns({f"full_{c}": (F.sum(f"same_{c}").over(back) == r.run - 1).cast("int") for c in ("p", "e")})
    seen = seen.withColumns({"explained": above("adjusted"), "raw": above("plain")})
    # what has no season is judged by the limit, but is no sample of the source's noise unless there is nothing else
    sample = F.coalesce("explained", F.when(F.size("cycle") == 0, F.col("raw")))
    seen = seen.withColumns({"residual": F.coalesce("explained", "raw"), "sample": F.when(F.col("own"), sample)})
    ahead = by.rowsBetween(0, r.run - 1)
    mine = F.col("sample")
    seen = seen.withColumns(
        {f"stuck_{c}": F.max(f"full_{c}").over(ahead) == 1 for c in ("p", "e")}
        | {"b0": F.count(mine).over(whole), "b1": F.sum(mine).over(whole), "b2": F.sum(mine * mine).over(whole)}
    )

    def fits(e0: str, u0: str, e1: str, u1: str) -> Column:
        hours = (F.col(u1) - F.col(u0)) / 3.6e9
        step = F.col(e1) - F.col(e0)
        return (step >= -1e-6) & (step <= F.coalesce("peak", F.lit(0.0)) * r.rate_factor * hours + r.slack_kwh)

    x = F.col("fe")
    fit = {f"{f}{k}": fits(f"e_{f}{k}", f"u_{f}{k}", "fe", "feu") if f == "lag" else fits("fe", "feu", f"e_{f}{k}", f"u_{f}{k}") for f in ("lag", "lead") for k in (1, 2)}
    between = fits("e_lag1", "u_lag1", "e_lead1", "u_lead1") & ((x < F.col("e_lag1")) | (x > F.col("e_lead1")))
    alone = ~fit["lag1"] & ~F.coalesce(fit["lag2"], F.lit(False)) & ~fit["lead1"] & ~F.coalesce(fit["lead2"], F.lit(False))
    flag = lambda c: F.coalesce(F.col("own") & c, F.lit(False))
    judged = seen.select(
        "meter", "ingest_id", "us", "pos", "b0", "b1", "b2", F.when(F.col("own"), F.col("residual")).alias("residual"), "sample",
        flag((F.col("p") < 0) | F.isnan("p") | (F.col("p") >= r.max_kw)).alias("p_range"),
        flag((F.col("e") < 0) | F.isnan("e") | (F.col("e") == float("inf"))).alias("e_range"),
        flag(between | alone).alias("departs"), flag(F.col("stuck_p")).alias("stuck_p"), flag(F.col("stuck_e")).alias("stuck_e"),
    )
    # the head of a block carries its sums; of the readings only those that may be a case go on
    some = (F.abs("residual") >= LOOK) | F.col("p_range") | F.col("e_range") | F.col("departs") | F.col("stuck_p") | F.col("stuck_e")
    judged = written(judged.where((F.col("pos") < 0) | some), "candidates")
    sums = judged.where("pos < 0").groupBy("meter").agg(F.sum("b0").alias("n"), F.sum("b1").alias("t1"), F.sum("b2").alias("t2"))
    candidates = judged.where("pos >= 0").drop("b0", "b1", "b2")
    limits = esd_limits(sums, candidates.where(F.abs("sample") >= LOOK).select("meter", F.col("sample").alias("residual")), r)
    ranked = salted_left_join(candidates, limits, "meter", "ingest_id")
    power = (
        F.when(F.col("p_range"), "range")
        .when(F.when(F.col("sample").isNotNull(), F.col("sample") >= F.col("limit")).otherwise(F.col("residual") > F.col("outside")), "spike")
        .when(F.col("stuck_p"), "stuck")
    )
    counter = F.when(F.col("e_range"), "range").when(F.col("departs"), "departure").when(F.col("stuck_e"), "stuck")
    return (
        ranked.withColumns({"power_case": power, "counter_case": counter})
        .where(F.col("power_case").isNotNull() | F.col("counter_case").isNotNull())
        .select("ingest_id", "meter", F.timestamp_micros("us").alias("ts_source"), "power_case", "counter_case")
    )
