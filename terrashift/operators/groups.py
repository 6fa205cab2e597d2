"""Ways to group the sites of a study: strategies, subsets, supersets, sides, flags and shares by category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_strategies(df: DataFrame, ways: dict[str, Column], keep: list[str], group: str = "grp") -> DataFrame:
    """(strategy, group, keep...): each row under the group that every strategy gives it, in one pass.

    A strategy whose group is null doesn't hold for a row.
    """
    pairs = F.array(*[F.struct(F.lit(name).alias("strategy"), way.alias(group)) for name, way in ways.items()])
    return df.select(F.explode(pairs).alias("_w"), *keep).select("_w.strategy", f"_w.{group}", *keep).filter(F.col(group).isNotNull())


def in_subsets(df: DataFrame, subsets: dict[str, Column], name: str = "subset") -> DataFrame:
    """Each row once for every named condition that holds for it; subsets may overlap."""
    named = F.filter(F.array(*[F.when(cond, F.lit(label)) for label, cond in subsets.items()]), lambda x: x.isNotNull())
    return df.withColumn(name, F.explode(named))


def with_superset(df: DataFrame, group: str, label: str, member: Column) -> DataFrame:
    """Rows of all groups, and those with ``member`` once more under ``label``."""
    labels = F.filter(F.array(F.col(group), F.when(member, F.lit(label))), lambda x: x.isNotNull())
    return df.withColumn(group, F.explode(labels))


def side_of(distance: Column, limit: float, near: str = "coast", far: str = "inland") -> Column:
    """Whether a place lies within ``limit``; null where the distance is unknown."""
    return F.when(distance < limit, near).when(distance.isNotNull(), far)


def is_near(distance: Column, limit: float) -> Column:
    """Whether a place lies at most ``limit`` away; an unknown distance does not."""
    return F.coalesce(distance <= limit, F.lit(False))


def proximity(df: DataFrame, limits: dict[str, tuple[Column, float]], both: str = "both") -> DataFrame:
    """A flag for each named (distance, limit), and ``both``: whether all hold."""
    flagged = df.withColumns({name: is_near(distance, limit) for name, (distance, limit) in limits.items()})
    every = F.lit(True)
    for name in limits:
        every = every & F.col(name)
    return flagged.withColumn(both, every)


def velocities_by_category(df: DataFrame, category: str, windows: list[str], least: float | None = None) -> DataFrame:
    """(window, category, n, percent, median) of the velocities of each window, with ``least`` of those at least that fast.

    ``percent`` is the category's share of all that count in the window.
    """
    long = df.select(category, *windows).unpivot([category], windows, "window", "_v").filter(F.col("_v").isNotNull())
    if least is not None:
        long = long.filter(F.col("_v") >= least)
    got = long.groupBy("window", category).agg(F.count("*").alias("n"), F.median("_v").alias("median"))
    total = got.groupBy("window").agg(F.sum("n").alias("_all"))
    return got.join(total, "window").select("window", category, "n", (100 * F.col("n") / F.col("_all")).alias("percent"), "median")
