"""URL filters: a sort-merge range join of urls with nested host rules.

A host becomes a canonical key, its labels in reverse order with a dot after each
(``blog.example.net`` -> ``net.example.blog.``). A rule's host and all its subdomains are then the
keys that start with the rule's key: an interval. Urls and rules are range-partitioned and sorted by
key together, and one sweep over each sorted range keeps the stack of rules whose intervals are open;
they nest, so the stack holds exactly the ancestors of the current key. Rules that were opened before
a range begins are found by the prefixes of its first key, and come first in it. Rules are a table of
any size; those of one host are held while its interval is open.

Defined results: a null url, or one without ``://``, has empty host and path and fits no rule; a url
that fits no rule gets the default verdict; repeated rows each get their own result; repeated rules
count once, and rules without a host or path are ignored; an empty table gives an empty table. Other
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrashift.llm.common import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return reversed_host(self.host)

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the production query.
BASE_RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)


def reversed_host(host: str) -> str:
    return "".join(label + "." for label in reversed(host.split(".")))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def canonical_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


class Node:
    """The rules of one host: verdicts by path, and the lengths of paths, longest first."""

    def __init__(self, key: str, host: str):
        self.key, self.host, self.verdicts, self.lengths = key, host, {}, []

    def add(self, path: str, verdict: str) -> None:
        self.verdicts[path] = max(verdict, self.verdicts.get(path, verdict))
        if len(path) not in self.lengths:
            self.lengths = sorted([*self.lengths, len(path)], reverse=True)

    def longest(self, path: str) -> str | None:
        """The longest rule path that starts ``path``."""
        return next((path[:n] for n in self.lengths if path[:n] in self.verdicts), None)


class Sweep:
    """Walks keys in ascending order; ``open`` holds the nodes whose keys are prefixes of the last key."""

    def __init__(self):
        self.open: list[Node] = []

    def close(self, key: str) -> None:
        while self.open and not key.startswith(self.open[-1].key):
            self.open.pop()

    def add(self, key: str, host: str, path: str, verdict: str) -> None:
        self.close(key)
        if not self.open or self.open[-1].key != key:
            self.open.append(Node(key, host))
        self.open[-1].add(path, verdict)

    def best(self, key: str, path: str) -> tuple[str, str] | None:
        """Name and verdict of the longest rule that fits; at equal length of the more special host."""
        self.close(key)
        fits = [(len(n.host) + len(p), len(n.host), n.verdicts[p], n.host + p) for n in self.open if (p := n.longest(path)) is not None]
        return (lambda m: (m[3], m[2]))(max(fits)) if fits else None


_RESULT = "page_id long, host string, path string, rule string, verdict string"


def _sweep(batches: Iterator[pa.RecordBatch], default: str) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by part, rules opened before it, key, rules before urls."""
    sweep, part = Sweep(), None
    for batch in batches:
        rows = []
        for own, url, key, page_id, host, path, verdict in zip(*(batch.column(n).to_pylist() for n in ("part", "url", "key", "page_id", "host", "path", "verdict")), strict=True):
            if own != part:
                part, sweep = own, Sweep()
            if url:
                rows.append((page_id, host, path, *(sweep.best(key, path) or (None, default))))
            else:
                sweep.add(key, host, path, verdict)
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = (pa.int64(), *[pa.string()] * 4)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["page_id", "host", "path", "rule", "verdict"])


def rule_table(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "host string, path string, verdict string")


def judge_urls(
    pages: DataFrame,
    rules: DataFrame | Iterable[Rule] = BASE_RULES,
    default: str = "allow",
    url: str = "url",
    page_id: str = "page_id",
) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages``, by the sorted sweep.

    ``rules``: (host, path, verdict). The range key ends with page_id, so a host with a third of all
    urls spreads over many ranges.
    """
    spark = pages.sparkSession
    table = rules if isinstance(rules, DataFrame) else rule_table(spark, rules)
    named = table.filter("host IS NOT NULL AND path IS NOT NULL").select("host", "path", "verdict").distinct()
    none = lambda kind: F.lit(None).cast(kind)
    ruled = named.select(canonical_key(F.col("host")).alias("key"), F.lit(False).alias("url"), none("long").alias("page_id"), "host", "path", "verdict")
    urls = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("u")).select("page_id", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
    urls = urls.select(canonical_key(F.col("host")).alias("key"), F.lit(True).alias("url"), "page_id", "host", "path", none("string").alias("verdict"))
    # written with the number of its range, which stays what it is when a task is run again
    placed = materialize(ruled.unionByName(urls).repartitionByRange("key", "url", "page_id").withColumn("part", F.spark_partition_id()), "urls-placed")
    first = placed.groupBy("part").agg(F.min("key").alias("first"))
    labels = F.split(F.expr("left(first, length(first) - 1)"), r"\.", -1)
    above = first.select("part", "first", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.array_join(F.slice(labels, 1, i), "."), F.lit(".")))).alias("key"))
    opened = above.filter("key <= first").select("part", "key").join(ruled, "key").withColumn("early", F.lit(0))
    rows = placed.withColumn("early", F.lit(1)).unionByName(opened).repartition("part").sortWithinPartitions("part", "early", "key", "url", "page_id")
    return rows.mapInArrow(lambda b: _sweep(b, default), _RESULT)
