"""Writers, and text forms of small results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, single: bool = False) -> None:
    out = df.select(*columns) if columns else df
    (out.coalesce(1) if single else out).write.mode("overwrite").csv(path, header=True)


def write_both(df: DataFrame, path: str) -> None:
    """The same rows as CSV and as JSON lines."""
    write_csv(df, f"{path}/csv")
    df.write.mode("overwrite").json(f"{path}/json")


def write_by_key(df: DataFrame, path: str, key: str) -> None:
    """A folder for each key; rows of a key are brought together first, so that it gets one file and not one from each task."""
    df.repartition(key).write.mode("overwrite").partitionBy(key).parquet(path)


def replace_keys(df: DataFrame, path: str, key: str) -> None:
    """Only the folders of the keys that occur are written anew."""
    df.repartition(key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def copy_selected(series: DataFrame, winners: DataFrame, path: str, key: str) -> DataFrame:
    """Write the series of the winners by key; returns the manifest (key, status)."""
    write_by_key(series.join(winners.select(key).distinct(), key, "left_semi"), path, key)
    have = series.select(key).distinct().withColumn("_have", F.lit(True))
    return winners.select(key).distinct().join(have, key, "left").select(key, F.when(F.col("_have"), "copied").otherwise("skipped").alias("status"))


def write_geojson_lines(df: DataFrame, path: str, region: str = "region") -> None:
    """A feature on each line: ``region`` as its multi-polygon, all other columns as its properties; rings are closed."""
    closed = lambda ring: F.concat(ring, F.slice(ring, 1, 1))
    corners = F.transform(region, lambda p: F.transform(p, lambda ring: F.transform(closed(ring), lambda c: F.array(c["x"], c["y"]))))
    geometry = F.when(F.col(region).isNotNull(), F.struct(F.lit("MultiPolygon").alias("type"), corners.alias("coordinates")))
    others = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != region])
    feature = F.struct(F.lit("Feature").alias("type"), others.alias("properties"), geometry.alias("geometry"))
    df.select(F.to_json(feature).alias("value")).write.mode("overwrite").text(path)


def as_document(df: DataFrame, key: str) -> DataFrame:
    """(key, document): all other columns as one JSON text; read it back with ``from_document``."""
    return df.select(key, F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("document"))


def from_document(df: DataFrame, key: str, schema: str) -> DataFrame:
    return df.select(key, F.from_json("document", schema).alias("d")).select(key, "d.*")


def _cell(value: object, digits: int) -> str:
    return "—" if value is None else f"{value:.{digits}f}" if isinstance(value, float) else str(value)


def markdown(df: DataFrame, digits: int = 2, most: int = 1000) -> str:
    """A small result as a Markdown table; more than ``most`` rows are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for a table in text")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *["| " + " | ".join(_cell(v, digits) for v in r) + " |" for r in rows]])


def latex(df: DataFrame, digits: int = 2, most: int = 1000) -> str:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for a table in text")
    body = [" & ".join(_cell(v, digits).replace("_", r"\_") for v in r) + r" \\" for r in [df.columns, *rows]]
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", *body, r"\end{tabular}"])


def p_text(p: float | None) -> str:
    return "p=n/a" if p is None else "p<0.001" if p < 0.001 else f"p={p:.3f}"
