"""Helpers that the corpus operators share: loading, shared work folders, materialized intermediates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrashift.operators.joins import dealt_join
from terrashift.operators.picks import new_path

__all__ = ["as_struct", "dealt_join", "discard", "load", "materialize", "quoted", "text_or_empty", "workspace", "written"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; read through Spark so that any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workspace(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``)."""
    return new_path(spark, name)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    return written(df, workspace(df.sparkSession, name))


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written at ``path`` and read back."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table in the shared folder that nothing will read again."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def quoted(name: str) -> str:
    """A column's name that stands for itself, whatever dots or backticks it has."""
    return "`" + name.replace("`", "``") + "`"


def as_struct(df: DataFrame) -> Column:
    """All columns as one, where no name of theirs can clash with others."""
    return F.struct(*[F.col(quoted(c)) for c in df.columns])


def text_or_empty(col: str | Column) -> Column:
    """A null text counts as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
