"""Functions of neighbours in long per-source sequences, in bounded tasks: time slices joined at their ends, or overlapping blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.calendar import period
from ..session import partitions, scratch_path, scratch_table

SLICE_US = 6 * 3600 * 1_000_000


def numbered(df: DataFrame, source: str, micros: str, *ties: str, slice_us: int = SLICE_US) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``pos``, the 0-based position of a row in the time order of its source, and the sizes per source.

    No task ever orders a whole source: rows are ordered inside (source, time slice), and slice sizes, of which a
    source has no more than calendar slices, are accumulated. The ordered slices are written to the shared folder
    bucketed by (source, slice), so adding the offsets needs no further exchange of the rows.

    Rows without source or time are left out. ``ties`` order rows of the same time and should make the order total.
    Columns named time_slice, in_slice, offset, pos or rows are taken; callers project theirs first.
    """
    spark = df.sparkSession
    n, name = partitions(spark, df), scratch_table(spark, "slices")
    window = Window.partitionBy(source, "time_slice").orderBy(micros, *ties)
    (
        df.where(F.col(source).isNotNull() & F.col(micros).isNotNull())
        .withColumn("time_slice", period(micros, slice_us))
        .repartition(n, source, "time_slice")
        .withColumn("in_slice", F.row_number().over(window))
        .write.bucketBy(n, source, "time_slice")
        .option("path", scratch_path(spark, "slices"))
        .saveAsTable(name)
    )
    rows = spark.table(name)
    sizes = rows.groupBy(source, "time_slice").agg(F.max("in_slice").alias("rows"))
    before = Window.partitionBy(source).orderBy("time_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    out = rows.join(offsets.drop("rows"), [source, "time_slice"]).withColumn("pos", F.col("offset") + F.col("in_slice") - 1)
    return out.drop("time_slice", "in_slice", "offset"), sizes.groupBy(source).agg(F.sum("rows").alias("rows"))


def overlapping(df: DataFrame, block: int, halo: int) -> DataFrame:
    """Rows with ``pos`` assigned to blocks of ``block`` positions; the ``halo`` rows beside a block are copied into it.

    Adds ``block`` and ``own`` (false for a copy). A function of at most ``halo`` neighbours on either side that is
    computed inside a block and read off its own rows equals the same function over the whole sequence.
    """
    if halo > block:
        raise ValueError("a halo must not exceed the block")
    home, at = F.expr(f"pos div {block}"), F.col("pos") % block
    targets = F.array_compact(
        F.array(home, F.when((at < halo) & (home > 0), home - 1), F.when(at >= block - halo, home + 1))
    )
    return df.withColumn("block", F.explode(targets)).withColumn("own", F.col("block") == home)


# --- neighbours and runs without numbering -------------------------------------------------------------------------


def _sliced(df: DataFrame, source: str, order: list[str], width: int) -> tuple[DataFrame, WindowSpec]:
    rows = df.where(F.col(source).isNotNull() & F.col(order[0]).isNotNull()).withColumn("slice_", period(order[0], width))
    return rows, Window.partitionBy(source, "slice_").orderBy(*order)


def neighbours(
    df: DataFrame, source: str, order: list[str], before: dict[str, Column], after: dict[str, Column] | None = None, slice_us: int = SLICE_US
) -> DataFrame:
    """``df`` with values of the row before (``before``) and after (``after``) in the order of the source; null where there is none.

    Rows are ordered inside (source, time slice). Only the first and the last row of a slice have a neighbour in
    another slice: those few are ordered once more per source, of which the calendar bounds the number. So a source
    with a third of all rows is spread over its slices, nothing is written, and rows are shuffled once (both
    branches read the same exchange).

    ``order`` begins with the column of microseconds and should be total. Rows without source or time are left out.
    Columns named slice_, first_ and last_ are taken.
    """
    after = after or {}
    rows, by = _sliced(df, source, order, slice_us)
    seen = {n: F.lag(c).over(by) for n, c in before.items()} | {n: F.lead(c).over(by) for n, c in after.items()}
    rows = rows.withColumns(seen | {"first_": F.lag(F.lit(1)).over(by).isNull(), "last_": F.lead(F.lit(1)).over(by).isNull()})
    across = Window.partitionBy(source).orderBy(*order)
    joined = {n: F.when(F.col("first_"), F.lag(c).over(across)).otherwise(F.col(n)) for n, c in before.items()}
    joined |= {n: F.when(F.col("last_"), F.lead(c).over(across)).otherwise(F.col(n)) for n, c in after.items()}
    inside, border = rows.where("not (first_ or last_)"), rows.where("first_ or last_").withColumns(joined)
    return inside.unionByName(border).drop("slice_", "first_", "last_")


def runs(
    df: DataFrame, source: str, order: list[str], state: str, values: dict[str, tuple[str, Column]],
    following: dict[str, tuple[str, Column]] | None = None, slice_us: int = SLICE_US,
) -> DataFrame:
    """Maximal runs of equal ``state`` (null is a state) per source: ``run_id`` from 1, ``state`` and the aggregates asked for.

    ``values`` maps a name to (min, max, sum or bool_or, column of a row). ``following`` holds columns that describe
    the step from the row before; they count for the run of that row. Runs are first found inside (source, time
    slice) and aggregated there; the pieces, no more than runs plus slices, are then joined up in the order of the source.
    """
    following = following or {}
    rows, by = _sliced(df, source, order, slice_us)
    differs = lambda w: F.lag(F.lit(1)).over(w).isNull() | ~F.col(state).eqNullSafe(F.lag(state).over(w))
    steps = {f"out_{n}": F.lead(c).over(by) for n, (_, c) in following.items()}
    rows = rows.withColumns({"begins_": differs(by).cast("int"), "first_": F.lag(F.lit(1)).over(by).isNull()} | steps)
    rows = rows.withColumn("piece_", F.sum("begins_").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    how = {n: getattr(F, f) for n, (f, _) in (values | following).items()}
    pieces = rows.groupBy(source, "slice_", "piece_").agg(
        F.min(state).alias(state),
        *[how[n](c).alias(n) for n, (_, c) in values.items()],
        *[how[n](f"out_{n}").alias(f"out_{n}") for n in following],
        *[how[n](F.when(F.col("first_"), c)).alias(f"in_{n}") for n, (_, c) in following.items()],
    )
    along = Window.partitionBy(source).orderBy("slice_", "piece_")
    pieces = pieces.withColumns({"begins_": differs(along).cast("int")} | {f"next_{n}": F.lead(f"in_{n}").over(along) for n in following})
    pieces = pieces.withColumn("run_id", F.sum("begins_").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    out = pieces.groupBy(source, "run_id").agg(
        F.min(state).alias(state),
        *[how[n](n).alias(n) for n in values],
        *[how[n](f"{side}_{n}").alias(f"{side}_{n}") for n in following for side in ("out", "next")],
    )
    both = {"sum": lambda a, b: F.coalesce(a + b, a, b), "bool_or": lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)), "max": F.greatest, "min": F.least}
    out = out.withColumns({n: both[f](F.col(f"out_{n}"), F.col(f"next_{n}")) for n, (f, _) in following.items()})
    return out.drop(*[f"{side}_{n}" for n in following for side in ("out", "next")])
