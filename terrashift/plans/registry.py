"""Where plans register: a name, a function of (spark, sf_dir), and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrashift.functions.time import water_year
from terrashift.operators.picks import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is taken")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    return new_path(spark, "plan")


def r(col: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, digits)


# Stand-ins for the study's data, in both languages.

EPOCH = 1_704_067_200_000_000  # 2024-01-01 in microseconds


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as series: id, d (days since 2024-01-01), value; ``level`` is the running sum."""
    e = table(spark, sf_dir, "events")
    days = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(EPOCH)) / F.lit(86_400_000_000)
    return e.select(F.col("user_id").alias("id"), "event_id", F.col("ts").alias("t"), days.alias("d"), "value", "event_type", "props")


SERIES_SQL = f"ev AS (SELECT user_id AS id, event_id, ts AS t, (epoch_us(ts) - {EPOCH}) / 86400000000.0 AS d, value, event_type, props FROM events)"


def two_years(spark: SparkSession, sf_dir: str, a: int = 1997, b: int = 1998) -> DataFrame:
    """Suppliers' revenue in two water years, in millions, as two velocities with covariates."""
    li = table(spark, sf_dir, "lineitem").withColumn("wy", water_year(F.col("l_shipdate")))
    rev = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    total = lambda y: F.round(F.coalesce(F.sum(F.when(F.col("wy") == y, rev)), F.lit(0.0)) / 1e6, 6)
    sums = li.groupBy(F.col("l_suppkey").alias("id")).agg(total(a).alias("v1"), total(b).alias("v2"), F.round(F.avg("l_quantity"), 6).alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return sums.join(s, "id")


TWO_SQL = """li AS (SELECT *, year(l_shipdate) + CASE WHEN month(l_shipdate) >= 10 THEN 1 ELSE 0 END AS wy, l_extendedprice * (1 - l_discount) AS rev FROM lineitem),
    two AS (SELECT l_suppkey AS id, round(coalesce(sum(rev) FILTER (WHERE wy = 1997), 0) / 1e6, 6) AS v1, round(coalesce(sum(rev) FILTER (WHERE wy = 1998), 0) / 1e6, 6) AS v2,
                   round(avg(l_quantity), 6) AS quantity, round(avg(l_discount), 6) AS discount, any_value(s_acctbal) AS balance
            FROM li JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_suppkey)"""


def sites(spark: SparkSession, sf_dir: str, name: str = "supplier", key: str = "s_suppkey") -> DataFrame:
    """Places with deterministic coordinates."""
    k = F.col(key)
    return table(spark, sf_dir, name).select(k.alias("id"), (F.lit(-124.5) + ((k * 37) % 200) / F.lit(100)).alias("lon"), (F.lit(39.0) + ((k * 53) % 330) / F.lit(100)).alias("lat"))


def sites_sql(view: str, name: str, key: str) -> str:
    return f"{view} AS (SELECT {key} AS id, -124.5 + (({key} * 37) % 200) / 100.0::DOUBLE AS lon, 39.0 + (({key} * 53) % 330) / 100.0::DOUBLE AS lat FROM {name})"


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select((F.col("p_partkey") % 50).alias("x"), F.floor(F.col("p_partkey") / 50).cast("long").alias("y"), F.col("p_retailprice").alias("v"), F.col("p_size").alias("s"))


RASTER_SQL = "ras AS (SELECT p_partkey % 50 AS x, p_partkey // 50 AS y, p_retailprice AS v, p_size AS s FROM part)"
