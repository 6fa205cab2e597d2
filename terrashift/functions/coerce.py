"""Cleaning of loosely typed values: text to numbers and booleans, lists in text, column names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that stand for true and false.
TRUE_WORDS = ("true", "t", "1", "yes", "y", "on")
FALSE_WORDS = ("false", "f", "0", "no", "n", "off")
# Words that stand for a missing number.
MISSING_WORDS = ("", "none", "nan", "null")


def nan_to_null(col: Column) -> Column:
    return F.when(~F.isnan(col), col)


def to_number(col: Column) -> Column:
    """Number in a text, null where it isn't one."""
    return nan_to_null(F.trim(col).try_cast("double"))


def to_bool(col: Column) -> Column:
    """Three-valued: true and false words, the numbers 1 and 0, otherwise null."""
    word = F.lower(F.trim(col.cast("string")))
    number = word.try_cast("double")
    return (
        F.when(word.isin(*TRUE_WORDS) | (number == 1), F.lit(True))
        .when(word.isin(*FALSE_WORDS) | (number == 0), F.lit(False))
    )


def first_float(col: Column) -> Column:
    """First number of a text such as ``(0.02,)`` or ``[0.5, 1]``; null if there is none."""
    text = F.trim(col.cast("string"))
    inner = F.regexp_replace(F.regexp_replace(text, r"^\((.*)\)$", "$1"), r"^\[(.*)\]$", "$1")
    head = F.trim(F.substring_index(inner, ",", 1))
    return F.when(~F.lower(text).isin(*MISSING_WORDS), nan_to_null(head.try_cast("double")))


def split_list(col: Column) -> Column:
    """Names in a text, parted by any of ``; , & / |``; no empty names."""
    parts = F.transform(F.split(F.coalesce(col, F.lit("")), r"[;,&/|]+"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def first_token(col: Column, sep: str = ";") -> Column:
    return F.trim(F.substring_index(col, sep, 1))


def base_name(path: Column) -> Column:
    """Last part of a path, without its extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def is_finite(col: Column) -> Column:
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) < F.lit(float("inf")))


def filled(col: Column) -> Column:
    """Null for a blank text."""
    return F.nullif(F.trim(col), F.lit(""))


def resolve_column(df: DataFrame, candidates: Iterable[str], part: str | None = None) -> str:
    """The first candidate that the frame has, else the first column whose name holds ``part``."""
    for name in candidates:
        if name in df.columns:
            return name
    if part:
        for name in df.columns:
            if part.lower() in name.lower():
                return name
    raise KeyError(f"none of {list(candidates)} is a column")
