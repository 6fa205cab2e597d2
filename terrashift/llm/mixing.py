"""Mixing sources to target weights, in DataFrame functions only.

Every source has a weight and a size, the words of its documents. The budget, by default the words of
all documents, is shared by weight; no source takes more than ``most`` times what it has, and what is
over goes to the others by weight until none is above. Each document gets a hash-random key; documents
are range-sorted by source and key, and distributed prefix sums of their sizes tell how many words of
their source come before. A source takes its documents in that order, in as many whole epochs as its
target holds, and then once more up to the word at which its budget is exactly spent: the last document
is taken in part.

Nothing is brought into one task: a large source fills many ranges, sources are numbered by ranges too,
and a source with very many rows is dealt to several tasks where its budget meets its rows. Only two
numbers a round come to the driver while the budget is shared, and there are as many rounds as it takes
sources to reach their limit.

Keys depend on the seed, the id and the size alone, so reruns agree whatever the partitions are.

Defined results: a null or empty text has no words, size 0 and takes 0; a null source is a source of its
own that comes last; rows with a null id are rows like all others; of rows that agree in source, id and
size it doesn't matter which is taken first; a source without words has the target 0; an empty table
gives an empty table; other columns are ignored by :func:`plan` and pass through :func:`epochs`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrashift.llm.common import dealt_join, materialize, text_or_empty
from terrashift.operators.picks import number_rows, total_before

#: What a word is: no white space of ASCII in it.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in their order, repeated.
WEIGHTS = (5, 2, 1)


def n_words(text: str | Column) -> Column:
    """Words of a text, none for null."""
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def random_key(seed: int, ident: Column, size: Column) -> Column:
    """16 hexadecimal digits of a hash of the seed, the id and the size."""
    parts = F.concat_ws(":", F.lit(str(seed)), F.coalesce(ident.cast("string"), F.lit("null")), size.cast("string"))
    return F.substring(F.md5(parts.cast("binary")), 1, 16)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, budget: int | None = None) -> DataFrame:
    """(name, source_size, n, target) of sources (name, source_size, n): shares of the budget by weight.

    ``name`` may be null and is in order of code points, null last; the weights go round in that order.
    """
    order = [F.col("name").isNull(), F.col("name")]
    numbered = materialize(number_rows(sources, order, "_rank").withColumn("_w", F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("_rank") - 1, F.lit(len(weights))).cast("int") + 1).cast("long")), "mix-sources")
    whole = F.lit(most).cast("decimal(38,0)")
    limit = whole * F.col("source_size")
    number = lambda n: F.lit(str(n)).cast("decimal(38,0)")
    total = numbered.agg(F.coalesce(F.sum(F.col("source_size").cast("decimal(38,0)")), number(0)).alias("s"), F.count("*").alias("n")).first()
    wanted = min(int(total.s) if budget is None else budget, most * int(total.s))
    rest, shares, known = wanted, None, -1
    full = F.col("source_size") == 0  # sources that stop at their limit
    while True:
        row = numbered.agg(
            F.count_if(full).alias("n"), F.coalesce(F.sum(F.when(full, limit)), number(0)).alias("taken"), F.coalesce(F.sum(F.when(~full, F.col("_w"))), F.lit(0)).alias("w")
        ).first()
        if row.n == known:
            break
        known, rest, shares = row.n, wanted - int(row.taken), int(row.w)
        if shares:
            full = full | (number(rest) * F.col("_w") > limit * F.lit(shares))
    own = F.lit(float(rest)) * F.col("_w") / F.lit(float(shares)) if shares else limit.cast("double")
    target = F.when(full, limit.cast("double")).otherwise(own)
    return numbered.select("name", "source_size", "n", target.cast("double").alias("target"))


def plan(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, budget: int | None = None, seed: int = 13,
    doc_id: str = "doc_id", source: str = "source", text: str = "text",
) -> DataFrame:
    """(doc_id, source, key, size, source_size, target, whole, part, taken) of each row.

    The mix takes a document ``whole`` times and once more its first ``part`` words; ``taken`` is the
    number of words that makes.
    """
    # a source is told from null by a letter, so that it can be joined and dealt
    name = F.when(F.col(f"`{source}`").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(f"`{source}`").cast("string")))
    sized = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), name.alias("origin"), n_words(F.col(f"`{text}`")).alias("size"))
    # rows that agree in all else are told apart by a number that is written with them
    rows = materialize(sized.withColumns({"key": random_key(seed, F.col("doc_id"), F.col("size")), "row": F.monotonically_increasing_id()}), "mix-sizes")
    counted = rows.groupBy("origin").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    named = counted.select(F.when(F.col("origin") != "n", F.expr("substring(origin, 2)")).alias("name"), "source_size", "n")
    shares = targets(named, weights, most, budget).withColumn("origin", F.coalesce(F.concat(F.lit("s"), F.col("name")), F.lit("n")))

    summed = total_before(rows, [F.col("origin"), F.col("key"), F.col("doc_id"), F.col("row")], "size", "before")
    placed = materialize(summed, "mix-placed")
    first = placed.groupBy("origin").agg(F.min("before").alias("first"))
    table = materialize(shares.join(first, "origin"), "mix-targets")
    met = dealt_join(placed, table, "origin", "n", "row")

    epochs_ = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    spent = (F.floor("target") - F.col("whole") * F.col("source_size")).cast("long")  # of the last, partial epoch
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), spent - (F.col("before") - F.col("first"))))
    taken = F.col("whole") * F.col("size") + F.col("part")
    return met.withColumn("whole", epochs_).withColumn("part", part).select("doc_id", F.col("name").alias("source"), "key", "size", "source_size", "target", "whole", "part", taken.alias("taken"))


def epochs(planned: DataFrame) -> DataFrame:
    """One row for each time that the mix takes a document: the columns of ``planned``, ``epoch`` and ``words``.

    ``words`` is how many of its first words are taken. In order of ``place`` the sources are mixed
    and all documents of an epoch come before those of the next.
    """
    times = F.transform(F.sequence(F.lit(0).cast("long"), F.col("whole")), lambda e: F.struct(e.alias("epoch"), F.when(e < F.col("whole"), F.col("size")).otherwise(F.col("part")).alias("words")))
    out = planned.withColumn("_t", F.explode(F.filter(times, lambda t: t["words"] > 0))).select(*[f"`{c}`" for c in planned.columns], "_t.epoch", "_t.words")
    return out.withColumn("place", F.concat(F.lpad(F.col("epoch").cast("string"), 6, "0"), F.lit(":"), F.col("key")))


def digest_columns(planned: DataFrame) -> DataFrame:
    return planned.select("doc_id", "size", "source_size", "target", "taken")
