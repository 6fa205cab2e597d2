"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document; the ledger keeps the measurements and one failure bit
per rule. A policy is a named, versioned set of rules: a mask. Verdicts of any policy, and the
ablations that say what each rule alone costs, are bitwise operations on the ledger; texts are not
read again. All of it is DataFrame functions; no row leaves the JVM and no text is shuffled.

Defined results: a null or empty text has no words and measures 0 everywhere; words are maximal runs
of characters other than space and U+0009..U+000D; lines are split at ``\\n`` alone; repeated rows
are judged one by one; an empty table gives an empty ledger; other columns pass through ``annotate``
and ``keep`` untouched, whatever their names, and are dropped by ``ledger``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrashift.llm.common import as_struct, quoted, text_or_empty

_SPACE = r"[\x20\x09-\x0D]+"
_NOT_SPACE = r"[^\x20\x09-\x0D]"
_SYMBOLS = r"[#*$%&|<>]+"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_upper_words", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``bit``: its place in the mask, never reused; ``fails``: from a struct of measures to a boolean."""

    name: str
    bit: int
    fails: Callable[[Column], Column]


#: Measures are whole numbers, so that no rule depends on rounding.
RULES = (
    Rule("few_words", 0, lambda m: m["n_words"] < 50),
    Rule("repeated_words", 1, lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    Rule("many_symbols", 2, lambda m: 10 * m["n_symbols"] > 2 * m["n_words"]),
    Rule("repeated_lines", 3, lambda m: 100 * m["n_dup_lines"] > 50 * m["n_lines"]),
    Rule("odd_word_length", 4, lambda m: (m["word_chars"] > 15 * m["n_words"]) | (m["word_chars"] < 2 * m["n_words"])),
    Rule("shouting", 5, lambda m: 100 * m["n_upper_words"] > 60 * m["n_words"]),
)


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << r.bit for r in RULES if r.name in self.rules)


#: A version is never changed once used; a new one is added.
POLICIES = {
    ("base", 1): Policy("base", 1, ("few_words", "repeated_words")),
    ("production", 1): Policy("production", 1, tuple(r.name for r in RULES)),
}
BASE, PRODUCTION = POLICIES["base", 1], POLICIES["production", 1]


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once: a lambda's variable is never inlined."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Positions in three-word windows that occur twice or more: sort the windows, compare neighbours."""
    window = lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(window(i).alias("w"), i.alias("i")))

    def covered(s: Column) -> Column:
        same = lambda k: (F.get(s, k)["w"] == F.get(s, k - 1)["w"]) | (F.get(s, k)["w"] == F.get(s, k + 1)["w"])
        hits = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.coalesce(same(k), F.lit(False)))
        spots = F.transform(hits, lambda k: F.array(F.get(s, k)["i"], F.get(s, k)["i"] + 1, F.get(s, k)["i"] + 2))
        return F.size(F.array_distinct(F.flatten(spots)))

    return F.when(F.size(words) >= 4, _bound(F.sort_array(windows), covered)).otherwise(0)


def _of_words(words: Column) -> list[Column]:
    chars = F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.length(w))
    upper = F.size(F.filter(words, lambda w: (F.upper(w) == w) & (F.lower(w) != w)))
    return [
        F.size(words).cast("long").alias("n_words"),
        chars.alias("word_chars"),
        upper.cast("long").alias("n_upper_words"),
        _repeat_words(words).cast("long").alias("n_repeat_words"),
    ]


def measures(text: Column) -> Column:
    """A struct of all ``MEASURES`` of one text."""
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(_NOT_SPACE)))
    of_words = _bound(words, lambda w: F.struct(*_of_words(w)))
    of_lines = _bound(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    symbols = (F.length(text) - F.length(F.regexp_replace(text, _SYMBOLS, ""))).cast("long")
    both = lambda s: F.struct(
        s["w"]["n_words"].alias("n_words"), s["w"]["word_chars"].alias("word_chars"), symbols.alias("n_symbols"),
        s["x"]["n"].alias("n_lines"), s["x"]["dup"].alias("n_dup_lines"),
        s["w"]["n_upper_words"].alias("n_upper_words"), s["w"]["n_repeat_words"].alias("n_repeat_words"),
    )
    return _bound(F.struct(of_words.alias("w"), of_lines.alias("x")), both)


def fail_bits(measured: Column) -> Column:
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(rule.fails(measured), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return bits


def judged(text: Column) -> Column:
    """A struct (m, bits): the measures and the failure bits of one text, each computed once."""
    return _bound(measures(text), lambda m: F.struct(m.alias("m"), fail_bits(m).alias("bits")))


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, measures..., fail_bits) of each row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), judged(text_or_empty(text)).alias("j"))
    return rows.select("doc_id", *[F.col(f"j.m.{m}").alias(m) for m in MEASURES], F.col("j.bits").alias("fail_bits"))


def failed(policy: Policy, bits: str | Column = "fail_bits") -> Column:
    return (F.col(bits) if isinstance(bits, str) else bits).bitwiseAND(F.lit(policy.mask)) != 0


def apply_policy(ledger_df: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with ``kept`` and the policy's name and version."""
    return ledger_df.withColumn("kept", ~failed(policy)).withColumn("policy", F.lit(f"{policy.name}/{policy.version}"))


def annotate(docs: DataFrame, text: str = "text") -> DataFrame:
    """The ledger beside the rows themselves: (row, measures..., fail_bits), ``row`` a struct of all columns."""
    rows = docs.select(as_struct(docs).alias("row"), judged(text_or_empty(F.col(quoted(text)))).alias("j"))
    return rows.select("row", *[F.col(f"j.m.{m}").alias(m) for m in MEASURES], F.col("j.bits").alias("fail_bits"))


def keep(annotated: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """The rows of :func:`annotate` that the policy keeps, all columns as they were."""
    return annotated.filter(~failed(policy)).select("row.*")


def ablations(ledger_df: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: (rule, n_failed, n_only, n_kept_without).

    ``n_failed`` documents fail it, ``n_only`` fail nothing else of the policy, ``n_kept_without``
    would be kept without it. Documents are first counted by their masked bits, at most 2^rules
    groups, so the shuffle doesn't grow with the corpus.
    """
    patterns = ledger_df.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    members = [r for r in RULES if r.name in policy.rules]
    rules = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in members])
    rows = patterns.select("bits", "n", F.explode(rules).alias("r"))
    has, rest = F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit")))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return rows.groupBy(F.col("r.rule").alias("rule")).agg(
        total(has).alias("n_failed"), total(has & (rest == 0)).alias("n_only"), total(rest == 0).alias("n_kept_without")
    )
