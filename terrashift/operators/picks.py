"""One row of several: best, last, within a tolerance, by priority."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def best_row(df: DataFrame, by: list[str], order: list[Column], mode: str = "row") -> DataFrame:
    """The first row of each group; with mode ``columnwise`` the first non-null of each column instead."""
    if mode == "row":
        ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
        return ranked.filter("_n = 1").drop("_n")
    whole = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    others = [c for c in df.columns if c not in by]
    firsts = df.select(*by, *[F.first(c, ignorenulls=True).over(whole).alias(c) for c in others], F.row_number().over(Window.partitionBy(*by).orderBy(*order)).alias("_n"))
    return firsts.filter("_n = 1").drop("_n")


def within_tolerance(df: DataFrame, by: list[str], first: str, tolerance: float, order: list[Column]) -> DataFrame:
    """Of the rows within ``tolerance`` of the group's least ``first`` the one that comes first."""
    least = F.min(first).over(Window.partitionBy(*by))
    near = df.withColumn("_least", least).filter(F.col(first) <= F.col("_least") + tolerance).drop("_least")
    return best_row(near, by, order)


def priority_pick(df: DataFrame, by: list[str], preferred: Column, named: Column, score: str, tie: list[Column]) -> DataFrame:
    """Preferred rows first: a named one, else the least score; then any named one, least score, first row.

    A preferred row without name and score doesn't outrank the others.
    """
    scored = F.col(score).isNotNull()
    level = F.when(preferred & named, 1).when(preferred & scored, 2).when(named, 3).when(scored, 4).otherwise(5)
    ranked = df.withColumn("_level", level).withColumn("_score", F.when(F.col("_level").isin(2, 4), F.col(score)))
    return best_row(ranked, by, [F.col("_level"), F.col("_score").asc_nulls_last(), *tie]).drop("_level", "_score")


def extreme_row(df: DataFrame, by: list[str], value: str, tie: str, largest: bool = True) -> DataFrame:
    """Row with the largest or smallest value; at ties the smallest ``tie``. A reduction without a sort of groups."""
    rest = [c for c in df.columns if c not in by]
    sign = F.col(value) if not largest else -F.col(value)
    row = F.min_by(F.struct(*rest), F.struct(sign, F.col(tie)))
    return df.filter(F.col(value).isNotNull()).groupBy(*by).agg(row.alias("_r")).select(*by, "_r.*")


def number_rows(df: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """Rows numbered from 1 in a global order, without bringing them into one task.

    Rows are range-partitioned and sorted, written so that the ranges stay what they are, and
    numbered by their place plus the count of all partitions before. Only one row for each partition
    is summed up in order. Rows that tie in ``order`` are told apart by a hash of all their columns,
    so a value that a third of all rows have fills a third of all ranges. Give an order without ties
    for stable numbers.
    """
    order = [*order, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])]
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = kept(placed.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "numbered")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    return placed.join(offsets, "_part").withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before")


def total_before(df: DataFrame, order: list[Column], weight: str, name: str) -> DataFrame:
    """The sum of ``weight`` over all rows before each in a global order without ties, by ranges as in :func:`number_rows`."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = kept(placed.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}), "summed")
    sizes = placed.groupBy("_part").agg(F.sum(weight).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.coalesce(F.sum(weight).over(Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = placed.withColumn("_own", own).join(sizes.select("_part", before.alias("_start")), "_part")
    return within.withColumn(name, F.col("_start") + F.col("_own")).drop("_part", "_place", "_start", "_own")


def once_each(df: DataFrame, on: list[str], **results: Column) -> DataFrame:
    """``df`` with columns that follow from those named ``on`` alone, computed once for equal values.

    For functions that are much work for few bytes: the different values are dealt to a fixed number of
    tasks, whatever files ``df`` comes from, and their results are joined back, nulls too. ``df`` is
    read twice.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    different = kept(df.select(*on).distinct(), "different")
    done = kept(different.repartition(parts).select(*[F.col(c).alias(f"_on{i}") for i, c in enumerate(on)], *[v.alias(k) for k, v in results.items()]), "results")
    same = [F.col(f"_df.{c}").eqNullSafe(F.col(f"_on{i}")) for i, c in enumerate(on)]
    held = [F.col(f"_df.`{c}`") for c in df.columns if c not in results]
    return df.alias("_df").join(done.withColumnsRenamed({k: f"_to_{k}" for k in results}), same).select(*held, *[F.col(f"_to_{k}").alias(k) for k in results])


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; local runs without one get a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="terrashift-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/terrashift/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: its lineage ends there and lost executors cost a rerun of their tasks.

    A checkpoint would do the work twice, once to count and once to write.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
