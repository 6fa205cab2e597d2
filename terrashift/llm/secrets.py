"""Secret scans over an incremental, content-addressed ledger.

Every version of every path is addressed by the SHA-256 of its text. The ledger is two Parquet tables
under one path: ``scanned`` has the (blob, rule@version) pairs that were scanned, ``findings`` their
spans. A scan reads only the pairs that the ledger lacks, each distinct blob once, appends to both,
and joins the findings of all blobs back to all paths. All of it is DataFrame functions.

Spans are code points, end exclusive, of matches that are leftmost and don't overlap within a rule.
Defined results: a null text is the empty text, which holds nothing; repeated rows each get the
findings of their blob; an empty table gives an empty report; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrashift.llm.common import as_struct, quoted, text_or_empty


@dataclass(frozen=True)
class Rule:
    """``pattern``: a regular expression; matches whose group ``group`` has under ``least`` characters are dropped."""

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


#: The first three are the base kinds; their order is that of spans with equal starts.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    # [0-9a-f]+ takes whole runs of hex digits, so the runs of 24 or more are the same matches
    Rule("hex", 1, r"[0-9a-f]{24,}"),
    # the block to its END line if no other line of dashes comes first, or the lines of base64 that follow, however many;
    # what is looked at from one BEGIN ends at the next, so a text is read twice at most
    Rule("pem", 3, r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=:,\x20\x09-\x0D]*+(?:-{1,4}[A-Za-z0-9+/=:,\x20\x09-\x0D]++)*+-----END [A-Z ]*PRIVATE KEY-----|(?:\r?\n[A-Za-z0-9+/=]{16,}+)*+)"),
    # the first part is taken whole where no others follow it, and then dropped: no part is looked at again
    Rule("jwt", 2, r"eyJ[A-Za-z0-9_-]{8,}+(\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)?", 1),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
BASE_KINDS = ("assign", "access", "hex")


def address(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _raw_matches(text: Column, rule: Rule) -> Column:
    """Structs (kind, k, gap, len, ok): the k-th match, the length of the text between it and the one before."""
    pattern = F.lit(rule.pattern)
    lengths = lambda a: F.transform(a, F.length)
    zipped = F.arrays_zip(
        lengths(F.split(text, rule.pattern, -1)).alias("gap"),
        lengths(F.regexp_extract_all(text, pattern, F.lit(0))).alias("len"),
        lengths(F.regexp_extract_all(text, pattern, F.lit(rule.group))).alias("value"),
    )
    made = F.transform(
        zipped,
        lambda m, k: F.struct(
            F.lit(rule.name).alias("kind"), k.alias("k"), m["gap"].alias("gap"), F.coalesce(m["len"], F.lit(0)).alias("len"),
            F.coalesce(m["value"] >= rule.least, F.lit(False)).alias("ok"),
        ),
    )
    return F.when(F.regexp_like(text, pattern), made).otherwise(F.array().cast(_RAW))


_RAW = "array<struct<kind:string,k:int,gap:int,len:int,ok:boolean>>"


def find(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(digest, kind, start, end) in blobs (digest, text, todo); ``todo``: the keys of the rules to scan for.

    Gap and match lengths of a rule, summed in order, are the positions; only those small rows are
    shuffled, by digest and kind.
    """
    parts = [F.when(F.array_contains("todo", r.key), _raw_matches(F.col("text"), r)).otherwise(F.array().cast(_RAW)) for r in rules]
    rows = blobs.select("digest", F.explode(F.concat(*parts)).alias("m")).select("digest", "m.*")
    upto = Window.partitionBy("digest", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto)).filter("ok")
    return placed.select("digest", "kind", (F.col("end") - F.col("len")).cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def _table(spark, path: str) -> DataFrame | None:
    """A table of the ledger, None before the first scan."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> None:
    """Scan what the ledger at ``ledger`` lacks for the texts of ``versions`` and append it there.

    Texts are combined by digest before the shuffle, so a text with a third of all rows moves once
    per map task. Both appends are of whole results: pairs are listed only after their findings.
    """
    spark = versions.sparkSession
    rows = versions.select(text_or_empty(text).alias("text")).select(address(F.col("text")).alias("digest"), "text")
    keys = F.array(*[F.lit(r.key) for r in rules])
    seen = _table(spark, f"{ledger}/scanned")
    if seen is not None:
        done = seen.groupBy("digest").agg(F.collect_set("pair").alias("done"))
        rows = rows.join(done, "digest", "left").withColumn("todo", F.array_except(keys, F.coalesce("done", F.array().cast("array<string>"))))
        rows = rows.filter(F.size("todo") > 0).select("digest", "text", "todo")
    else:
        rows = rows.withColumn("todo", keys)
    blobs = rows.groupBy("digest").agg(F.first("text").alias("text"), F.first("todo").alias("todo"))
    versions_of = F.create_map(*[x for r in rules for x in (F.lit(r.name), F.lit(r.key))])
    find(blobs, rules).withColumn("pair", versions_of[F.col("kind")]).write.mode("append").parquet(f"{ledger}/findings")
    digests = rows.select("digest", "todo").distinct()
    digests.select("digest", F.explode("todo").alias("pair")).write.mode("append").option("compression", "zstd").parquet(f"{ledger}/scanned")


def spans_by_blob(ledger_findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(digest, found): the findings of the current rule versions, in order of start, then kind as listed."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i))])
    current = ledger_findings.withColumn("rank", order[F.col("pair")]).filter("rank IS NOT NULL")
    return current.groupBy("digest").agg(F.sort_array(F.collect_set(F.struct("start", "rank", "end", "kind"))).alias("found"))


def _found_in(rows: DataFrame, ledger: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(digest, found) of the blobs of ``rows``, not of all that the ledger ever saw."""
    findings = rows.sparkSession.read.parquet(f"{ledger}/findings")
    return spans_by_blob(findings.join(rows.select("digest").distinct(), "digest", "left_semi"), rules)


def report(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, found) for every row of ``versions``; ``found`` is an array, empty where nothing was found."""
    rows = versions.select(F.col(doc_id).cast("long").alias("doc_id"), address(text_or_empty(text)).alias("digest"))
    empty = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    return rows.join(_found_in(rows, ledger, rules), "digest", "left").select("doc_id", F.coalesce("found", empty).alias("found"))


def redact(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by ``[kind]``; overlapping spans become one."""
    whole = F.col(f"row.{quoted(text)}")

    def step(acc: Column, m: Column) -> Column:
        fresh = m["start"] >= acc["at"]
        gap = F.substring(whole, (acc["at"] + 1).cast("int"), (m["start"] - acc["at"]).cast("int"))
        return F.struct(
            F.greatest(acc["at"], m["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], F.array(gap, F.concat(F.lit("["), m["kind"], F.lit("]"))))).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(whole, (acc["at"] + 1).cast("int"), F.length(whole)))
    clean = F.when(F.col("found").isNull(), whole).otherwise(F.aggregate("found", start, step, rest))
    # the user's columns ride in a struct, where no name of theirs can clash
    rows = docs.select(as_struct(docs).alias("row"), address(text_or_empty(F.col(quoted(text)))).alias("digest"))
    joined = rows.join(_found_in(rows, ledger, rules), "digest", "left")
    return joined.select(*[(clean if c == text else F.col(f"row.{quoted(c)}")).alias(c) for c in docs.columns])


def _joined(found: Column) -> Column:
    one = lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))
    return F.array_join(F.transform(found, one), ",")


def digest_columns(reported: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as text."""
    found = F.col("found")
    count = lambda kind: F.size(F.filter(found, lambda m: m["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(found, lambda m: m["kind"].isin(*BASE_KINDS))
    return reported.select(
        "doc_id", *[count(k) for k in BASE_KINDS], F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(found).alias("spans")
    )
