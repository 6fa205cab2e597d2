"""From raw documents to packed training sequences: five stages, each written before the next reads it.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``, others that the table has pass through, whatever their names. Each works on all
that its predecessor kept.

Defined results: a null or empty text has no words, so the quality rules reject it; given to a later
stage alone, it is linked with nothing, has nothing to cut or replace, and is packed as its end id.
Repeated rows are near-duplicates of each other, one of them stays; rows with a null id are rows like
all others. An empty table gives an empty table at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrashift.llm import minhash, packing, quality, secrets, suffix_dedup
from terrashift.llm.common import as_struct, load, materialize, quoted, workspace


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the production policy rejects go, by the failure bits of one ledger beside the rows."""
    return quality.keep(quality.annotate(docs), quality.PRODUCTION)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate rows one stays, of those with the smallest id; null ids come last.

    Rows are compared by a number of their own, so repeated and null ids are rows like all others; the
    columns of a row ride beside it in a struct, where no name of theirs can clash.
    """
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("number"), as_struct(docs).alias("row")), "near-rows")
    compared = rows.select("number", F.col("row.text").alias("text"))
    groups = minhash.near_duplicates(compared, words=5, threshold=80, doc_id="number").select(F.col("doc_id").alias("number"), "component_id")
    names = rows.select("number", F.col("row.doc_id").alias("named"))
    first = names.join(groups, "number").groupBy("component_id").agg(F.min(F.struct(F.col("named").isNull().alias("unnamed"), "named", "number")).alias("f"))
    kept = rows.join(first.select(F.col("f.number").alias("number")), "number", "left_semi")
    return kept.select(*[F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns])


def suffix_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by a 200-byte string that starts elsewhere too are cut out.

    A cut may part the bytes of a character; what is left of one is dropped when the rest becomes text.
    """
    return suffix_dedup.cleaned(docs, length=200)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are replaced by the name of their kind."""
    ledger = workspace(spark, "secrets")
    secrets.scan(docs, ledger)
    return _with_length(secrets.redact(docs, ledger))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 ids: the pieces with their ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, size=1024, end_id=0)


def _with_length(docs: DataFrame) -> DataFrame:
    """``n_chars`` as the text now has it, where documents have that column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_dedup),
    ("suffix-array dedup", suffix_repeats),
    ("secret scans", secret_scans),
    ("packing", packed_sequences),
]

#: Near-duplicates by MinHash, suffix arrays and tokenizers have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn on ``documents``."""
    docs = load(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{i}")
    return docs
