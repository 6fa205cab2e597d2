"""Long series in blocks: windows, sums and carried values of a series that no single task could hold.

Rows are numbered in the order of all series, over ranges, and every so many numbers are a block, so a
series of any length is many groups (series, block) of a bounded size. What a block needs of others comes
as rows of its own: a halo of neighbouring rows for a window, or one row with what all blocks before (or
after) it leave, which a window over one row for each block and series gives.

The plain windows of :mod:`terrashift.operators.series` sort a series in one task. The operators here use
them too if a count says that no series has more rows than a block; results are the same either way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrashift.operators.picks import number_rows

#: Rows of a block: as many as a task sorts with ease.
BLOCK_ROWS = 200_000


def fits_a_block(df: DataFrame, by: list[str], rows: int) -> bool:
    """Whether no series has more than ``rows`` rows; one number comes to the driver."""
    most = df.groupBy(*by).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0]
    return (most or 0) <= rows


def in_blocks(df: DataFrame, by: list[str], order: list[Column], rows: int) -> DataFrame:
    """``df`` with ``_i``, the number of a row in the order of all series, and ``_block``, its block of ``rows`` numbers."""
    numbered = number_rows(df, [*[F.col(b) for b in by], *order], "_i")
    return numbered.withColumn("_block", F.floor((F.col("_i") - 1) / rows).cast("long"))


def with_halo(placed: DataFrame, reach: int, rows: int) -> DataFrame:
    """Rows of blocks with those up to ``reach`` rows away, which ``_own`` tells apart."""
    block = lambda i: F.floor((i - 1) / rows).cast("long")
    near = F.sequence(block(F.greatest(F.col("_i") - reach, F.lit(1))), block(F.col("_i") + reach))
    spread = placed.withColumnRenamed("_block", "_home").withColumn("_block", F.explode(near))
    return spread.withColumn("_own", F.col("_home") == F.col("_block")).drop("_home")


def in_window(df: DataFrame, by: list[str], order: list[Column], reach: int, out: str, of: Callable[[object], Column], rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with ``out``: ``of`` a window of the rows at most ``reach`` before and after."""
    if fits_a_block(df, by, rows):
        return df.withColumn(out, of(Window.partitionBy(*by).orderBy(*order).rowsBetween(-reach, reach)))
    w = Window.partitionBy(*by, "_block").orderBy("_i").rowsBetween(-reach, reach)
    held = with_halo(in_blocks(df, by, order, rows), reach, rows).withColumn(out, of(w))
    return held.filter("_own").drop("_own", "_i", "_block")


def carried(placed: DataFrame, by: list[str], part: Column, upto: Callable[[Column, object], Column], forward: bool = True) -> DataFrame:
    """``placed`` with one more row in each (series, block): ``_seed`` of all blocks before, or after it, first or last in it.

    ``part``: what a block leaves, an aggregate; ``upto``: of those of several blocks, over a window.
    """
    blocks = placed.groupBy(*by, "_block").agg(part.alias("_part"))
    others = (Window.unboundedPreceding, -1) if forward else (1, Window.unboundedFollowing)
    seeds = blocks.select(*by, "_block", upto(F.col("_part"), Window.partitionBy(*by).orderBy("_block").rowsBetween(*others)).alias("_seed"))
    edge = F.lit(0 if forward else 2**62).cast("long")
    return placed.unionByName(seeds.withColumn("_i", edge), allowMissingColumns=True)


def last_known(df: DataFrame, by: list[str], order: list[Column], known: Column, out: str, forward: bool = True, rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with ``out``: the last value of ``known`` that isn't null at or before each row, or the first from it on."""
    span = (Window.unboundedPreceding, 0) if forward else (0, Window.unboundedFollowing)
    pick = F.last if forward else F.first
    if fits_a_block(df, by, rows):
        return df.withColumn(out, pick(known, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(*span)))
    return _last_placed(in_blocks(df, by, order, rows), by, known, out, forward).drop("_i", "_block")


def _last_placed(placed: DataFrame, by: list[str], known: Column, out: str, forward: bool) -> DataFrame:
    span = (Window.unboundedPreceding, 0) if forward else (0, Window.unboundedFollowing)
    pick, best = (F.last, F.max_by) if forward else (F.first, F.min_by)
    held = placed.withColumn("_known", known)
    part = best("_known", F.when(F.col("_known").isNotNull(), F.col("_i")))
    seeded = carried(held, by, part, lambda p, w: pick(p, ignorenulls=True).over(w), forward)
    w = Window.partitionBy(*by, "_block").orderBy("_i").rowsBetween(*span)
    own = (F.col("_i") > 0) & (F.col("_i") < F.lit(2**62))
    return seeded.withColumn(out, pick(F.coalesce("_known", "_seed"), ignorenulls=True).over(w)).filter(own).drop("_known", "_seed")


def total(df: DataFrame, by: list[str], order: list[Column], value: str, out: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` up to and with each row of its series."""
    span = (Window.unboundedPreceding, 0)
    if fits_a_block(df, by, rows):
        return df.withColumn(out, F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(*span)))
    placed = in_blocks(df, by, order, rows)
    seeded = carried(placed, by, F.sum(value), lambda p, w: F.sum(p).over(w))
    w = Window.partitionBy(*by, "_block").orderBy("_i").rowsBetween(*span)
    return seeded.withColumn(out, F.sum(F.coalesce("_seed", value)).over(w)).filter("_i > 0").drop("_seed", "_i", "_block")


def between_known(df: DataFrame, by: list[str], order: list[Column], value: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with nulls of ``value`` on the line between their neighbours by position; at the end the last value stays."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("_i"), F.col(value).alias("v")))
    if fits_a_block(df, by, rows):
        w = Window.partitionBy(*by).orderBy(*order)
        both = df.withColumn("_i", F.row_number().over(w).cast("long")).withColumns({
            "_a": F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "_b": F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)),
        })
    else:
        placed = in_blocks(df, by, order, rows)
        both = _last_placed(_last_placed(placed, by, known, "_a", True), by, known, "_b", False).drop("_block")
    share = F.try_divide(F.col("_i") - F.col("_a._i"), F.col("_b._i") - F.col("_a._i"))
    line = F.coalesce(F.col("_a.v") + share * (F.col("_b.v") - F.col("_a.v")), F.col("_a.v"))
    return both.withColumn(value, line).drop("_i", "_a", "_b")
