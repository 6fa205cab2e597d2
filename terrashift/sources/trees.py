"""Nested documents of any shape as rows with type tags, and back, without a schema.

A document is a VARIANT. Written out it is a row for each leaf: its path of names, a tag of its kind and
its text. Reading the rows gives the same document again, dates, times, nulls, empty lists and whole or
broken numbers as they were. Both go level by level, over all documents at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrashift.operators.picks import kept

# Fixed names of the kinds of leaves.
GROUP, JSON, NULL, TEXT, TEXTS, TIME, TIMES = "dict", "json", "null", "utf-8", "utf-8[]", "datetime-iso", "datetime-iso[]"
FLOAT, FLOATS, WHOLE, WHOLES, BOOL, DECIMAL = "float64", "float64[]", "int64", "int64[]", "bool", "decimal"

_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def tag_of(v: Column) -> Column:
    """The kind of a VARIANT. Lists of mixed or nested values, and empty ones, are JSON."""
    kind = F.schema_of_variant(v)
    lists = F.regexp_extract(kind, r"^ARRAY<([A-Z_]+)>$", 1)
    of = {FLOATS: ("DOUBLE", "FLOAT"), WHOLES: ("BIGINT",), TEXTS: ("STRING",), TIMES: ("DATE", "TIMESTAMP", "TIMESTAMP_NTZ")}
    tag = F.when(kind.startswith("OBJECT"), GROUP)
    for name, kinds in of.items():
        tag = tag.when(lists.isin(*kinds), name)
    single = {FLOAT: ("DOUBLE", "FLOAT"), WHOLE: ("BIGINT",), TEXT: ("STRING",), TIME: ("DATE", "TIMESTAMP", "TIMESTAMP_NTZ"), BOOL: ("BOOLEAN",), NULL: ("VOID",)}
    for name, kinds in single.items():
        tag = tag.when(kind.isin(*kinds), name)
    return tag.when(kind.startswith("DECIMAL"), DECIMAL).otherwise(JSON)


def _iso(v: Column) -> Column:
    """A date, or a time with or without a zone, as text that tells which it is."""
    kind = F.schema_of_variant(v)
    at = lambda name: F.try_variant_get(v, "$", name)
    with_zone = F.concat(F.date_format(F.to_utc_timestamp(at("timestamp"), F.current_timezone()), _ISO), F.lit("Z"))
    return F.when(kind == "DATE", at("date").cast("string")).when(kind == "TIMESTAMP", with_zone).otherwise(F.date_format(at("timestamp_ntz"), _ISO))


def _from_iso(text: Column, kind: str) -> Column:
    if kind == "date":
        return text.cast("date")
    plain = F.to_timestamp_ntz(F.rtrim(text, F.lit("Z")), F.lit(_ISO))
    return plain if kind == "timestamp_ntz" else F.to_timestamp(F.regexp_replace(text, "Z$", "+00:00"), f"{_ISO}xxx")


def _time_kind(text: Column) -> Column:
    return F.when(F.length(text) == 10, "date").when(text.endswith("Z"), "timestamp").otherwise("timestamp_ntz")


def _text(tag: Column, v: Column) -> Column:
    times = F.to_json(F.transform(F.try_variant_get(v, "$", "array<variant>"), _iso))
    return (
        F.when(tag.isin(TEXT, FLOAT), F.try_variant_get(v, "$", "string")).when(tag == TIME, _iso(v)).when(tag == TIMES, times)
        .when(~tag.isin(GROUP, NULL), F.to_json(v))
    )


def tree_rows(df: DataFrame, key: str, document: str) -> DataFrame:
    """(key, path, tag, value) of the leaves of VARIANT documents; an empty group is a leaf, a null document gives no row.

    ``path`` is an array of names. Deeper levels are looked at as long as there are groups.
    """
    spark = df.sparkSession
    level = df.select(F.col(key).alias("_key"), F.array().cast("array<string>").alias("path"), F.col(document).alias("v")).filter("v IS NOT NULL")
    found = None
    while True:
        tagged = level.withColumn("tag", tag_of(F.col("v")))
        full = (F.col("tag") == GROUP) & (F.schema_of_variant("v") != "OBJECT<>")
        leaves = tagged.filter(~full).select("_key", "path", "tag", _text(F.col("tag"), F.col("v")).alias("value"))
        found = leaves if found is None else found.unionByName(leaves)
        groups = kept(tagged.filter(full).select("_key", "path", "v"), "groups")
        if groups.isEmpty():
            return found.select(F.col("_key").alias(key), "path", "tag", "value")
        parts = groups.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        level = parts.select("_key", F.concat("path", F.array("key")).alias("path"), F.col("value").alias("v"))


def _value(tag: Column, text: Column) -> Column:
    read = lambda kind: F.to_variant_object(F.from_json(text, f"array<{kind}>"))
    texts = F.from_json(text, "array<string>")
    times = lambda kind: F.to_variant_object(F.transform(texts, lambda x: _from_iso(x, kind)))
    one = lambda kind: _from_iso(text, kind).cast("variant")
    first = _time_kind(F.get(texts, F.lit(0)))
    out = F.when(tag == NULL, F.parse_json(F.lit("null"))).when(tag == GROUP, F.parse_json(F.lit("{}"))).when(tag == TEXT, text.cast("variant"))
    out = out.when(tag == FLOAT, text.cast("double").cast("variant")).when(tag == FLOATS, read("double")).when(tag == WHOLES, read("bigint")).when(tag == TEXTS, read("string"))
    for kind in ("date", "timestamp", "timestamp_ntz"):
        out = out.when((tag == TIME) & (_time_kind(text) == kind), one(kind)).when((tag == TIMES) & (first == kind), times(kind))
    return out.otherwise(F.parse_json(text))


def tree_documents(rows: DataFrame, key: str) -> DataFrame:
    """(key, document): what :func:`tree_rows` was given. The depth of the deepest leaf comes to the driver."""
    nodes = rows.select(F.col(key).alias("_key"), "path", _value(F.col("tag"), F.col("value")).alias("v"))
    depth = rows.agg(F.max(F.size("path"))).first()[0] or 0
    for d in range(depth, 0, -1):
        entry = F.struct(F.element_at("path", -1).alias("name"), "v")
        whole = nodes.filter(F.size("path") == d).groupBy("_key", F.slice("path", 1, d - 1).alias("path")).agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
        nodes = nodes.filter(F.size("path") < d).unionByName(whole.select("_key", "path", F.to_variant_object("m").alias("v")))
    return nodes.select(F.col("_key").alias(key), F.col("v").alias("document"))
