"""Periodic runs of words by the runs theorem, and texts without the repetitions.

A run is a maximal stretch of words with a smallest period q that is at least ``least_exponent`` times
as long as q. By the runs theorem every run holds, at one place at least, a Lyndon word of length q that
is the longest one that starts there, under the order of the words or under the reversed one. So:

1. Words become numbers, exactly, and the texts of a batch one sequence, with a separator after each that
   occurs once and is less than all words: nothing is equal across texts.
2. The suffix array comes by prefix doubling; only suffixes that still agree are sorted again. Its
   inverse gives the longest Lyndon word at i, which ends before the next smaller value of the inverse;
   under the reversed order before the next larger one. (A suffix that is a prefix of another is then
   taken as the larger; words that this lets through aren't Lyndon words but powers, and fall out as the
   smallest period of each stretch is kept.)
3. Each of these words is a candidate root, extended to the right by the longest common prefix of the
   suffixes at its start and behind its end, to the left by that of the reversed sequence: minima of the
   array of common prefixes, from a sparse table.

All of it is numpy over a batch, but for the stack that finds next smaller values. A document is worked
on where it lies; nothing is shuffled.

Defined results: a null or empty text has no words and no runs; repeated rows have their own results; a
null id is an id like others; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrashift.llm.common import text_or_empty

#: Words of a batch; longer texts are batches of their own.
BATCH_WORDS = 100_000
#: Common prefixes of a block of the sparse table.
BLOCK = 16

_RESULT = "doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


# --- suffix arrays --------------------------------------------------------------------------------


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, inverse, common) of a sequence whose least number occurs once and last in every part.

    ``common[i]``: what the suffixes at i - 1 and i in the order have in common. Ranks by the first
    2^k numbers are kept while suffixes agree so far; adjacent suffixes that part in round k have
    between 2^(k-1) and 2^k in common, found by halving.
    """
    n = len(text)
    order = np.argsort(text, kind="stable")
    parted = np.zeros(n, np.int8)  # the round in which a suffix was told from the one before it; 0: at once
    fresh = np.concatenate(([True], text[order][1:] != text[order][:-1]))
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    levels, step, k = [rank], 1, 1
    alone = fresh & np.append(fresh[1:], True)
    live = np.flatnonzero(~alone)  # places of suffixes in groups of several
    while len(live):
        members = order[live]
        key = rank[members].astype(np.int64) * n + rank[members + step]
        by = np.argsort(key)
        order[live] = members[by]
        key = key[by]
        same = np.concatenate(([False], key[1:] == key[:-1]))
        head = np.concatenate(([True], key[1:] // n != key[:-1] // n))
        parted[live[~same & ~head]] = k
        rank = rank.copy()
        rank[order[live]] = np.maximum.accumulate(np.where(same, 0, live))
        levels.append(rank)
        live = live[same | np.append(same[1:], False)]
        step, k = 2 * step, k + 1
    a, b, common = order[:-1].astype(np.int64), order[1:].astype(np.int64), np.zeros(n, np.int32)
    for k in range(len(levels) - 2, -1, -1):
        at = np.flatnonzero(parted[1:] > k)
        x, y = a[at] + common[at + 1], b[at] + common[at + 1]
        common[at + 1] += (levels[k][x] == levels[k][y]).astype(np.int32) << k
    return order, rank, common


class Extensions:
    """Longest common prefixes of any two suffixes: minima over ranges of a sparse table over blocks."""

    def __init__(self, text: np.ndarray):
        self.order, self.inverse, common = suffix_array(text)
        blocks = -(-len(common) // BLOCK)
        self.common = np.full(blocks * BLOCK, np.iinfo(np.int32).max, np.int32)
        self.common[: len(common)] = common
        rows = self.common.reshape(blocks, BLOCK)
        self.ahead = np.minimum.accumulate(rows, axis=1).ravel()  # from the start of a block
        self.back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()  # to its end
        self.table = [rows.min(axis=1)]
        while 2 ** len(self.table) <= blocks:
            half = 2 ** (len(self.table) - 1)
            last = self.table[-1]
            self.table.append(np.minimum(last[: len(last) - half], last[half:]))

    def common_prefix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the suffixes at ``a`` and ``b``, no two the same."""
        x, y = self.inverse[a], self.inverse[b]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y)
        first, last = low // BLOCK, high // BLOCK
        out = np.minimum(self.back[low], self.ahead[high])
        inner = last - first - 1
        within = np.flatnonzero(first == last)
        out[within] = self.common[low[within]]
        for step in range(1, BLOCK):
            within = within[low[within] + step <= high[within]]
            out[within] = np.minimum(out[within], self.common[low[within] + step])
        wide = np.flatnonzero(inner > 0)
        if len(wide):
            level = np.frexp(inner[wide].astype(float))[1] - 1
            for k in np.unique(level):
                at = wide[level == k]
                out[at] = np.minimum(out[at], np.minimum(self.table[k][first[at] + 1], self.table[k][last[at] - 2**k]))
        return out


def next_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller value; the length where there is none. Values are 0 or more.

    From the end, each place follows what the places behind it found.
    """
    n = len(values)
    v, found = [*values.tolist(), -1], [n] * n
    for i in range(n - 1, -1, -1):
        own, j = v[i], i + 1
        while v[j] > own:
            j = found[j]
        found[i] = j
    return np.array(found, np.int64)


def find_runs(text: np.ndarray, least_length: int, least_exponent: int) -> np.ndarray:
    """Rows (start, length, period) of all runs of a sequence with separators, by start, then period."""
    n = len(text)
    forward = Extensions(text)
    # under the reversed order of words the next smaller suffix is the next larger one
    ends = np.concatenate((next_smaller(forward.inverse), next_smaller(n - 1 - forward.inverse)))
    start = np.tile(np.arange(n), 2)
    inside = ends < n
    start, ends = start[inside], ends[inside]
    # a run of two roots and more goes on to the right or to the left
    goes_on = (text[start] == text[ends]) | ((start > 0) & (text[start - 1] == text[ends - 1]))
    start, ends = start[goes_on], ends[goes_on]
    period = ends - start
    if not len(start):
        return np.zeros((0, 3), np.int64)
    right = forward.common_prefix(start, ends).astype(np.int64)
    # to the left: only where the stretch may still be long enough
    left = np.zeros(len(start), np.int64)
    some = np.flatnonzero((start > 0) & (text[start - 1] == text[ends - 1]))
    if len(some):
        back = Extensions(np.append(text[::-1], text.min() - 1))
        left[some] = back.common_prefix(n - start[some], n - ends[some])
    length = left + period + right
    long_ = length >= np.maximum(least_length, least_exponent * period)
    found = np.stack([start - left, length, period], axis=1)[long_]
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    # of one stretch the smallest period
    again = np.zeros(len(found), bool)
    again[1:] = (found[1:, :2] == found[:-1, :2]).all(axis=1)
    found = found[~again]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


# --- texts ----------------------------------------------------------------------------------------


def _joined(texts: list[list[bytes]]) -> np.ndarray:
    """Numbers of the words of all texts, each text closed with a separator of its own, below all words."""
    known: defaultdict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    parts = []
    for i, words in enumerate(texts):
        parts += [np.fromiter(map(known.__getitem__, words), np.int64, len(words)), np.array([-1 - i])]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that are in no run, or in the first period of every run that holds them, joined by a space."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()])


def _of_batch(ids: list, texts: list[list[bytes]], least_length: int, least_exponent: int) -> pa.RecordBatch:
    runs = find_runs(_joined(texts), least_length, least_exponent)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(sizes + 1) - sizes - 1
    cuts = np.searchsorted(runs[:, 0], np.append(first, np.iinfo(np.int64).max))
    own = [runs[a:b] - [s, 0, 0] for a, b, s in zip(cuts[:-1], cuts[1:], first, strict=True)]
    lists = pa.ListArray.from_arrays(pa.array(cuts - cuts[0], pa.int32()), pa.StructArray.from_arrays([pa.array(np.concatenate(own)[:, i]) for i in range(3)], fields=list(_RUN)))
    collapsed = pa.array([_collapse(w, r) for w, r in zip(texts, own, strict=True)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), lists, collapsed], names=["doc_id", "n_words", "runs", "collapsed"])


def _batches(batches: Iterator[pa.RecordBatch], least_length: int, least_exponent: int) -> Iterator[pa.RecordBatch]:
    ids, texts, total = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            ids.append(doc_id)
            texts.append(text.as_py().split())
            total += len(texts[-1])
            if total >= BATCH_WORDS:
                yield _of_batch(ids, texts, least_length, least_exponent)
                ids, texts, total = [], [], 0
    if ids:
        yield _of_batch(ids, texts, least_length, least_exponent)


def periodic_runs(docs: DataFrame, least_length: int = 24, least_exponent: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each row.

    ``runs``: structs (start, length, period) in words, by start, then period. ``collapsed``: UTF-8 of
    the words joined by a space, without those that a run holds after its first period. ``least_exponent``
    is 2 at least.
    """
    plain = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_or_empty(F.col(f"`{text}`")).cast("binary").alias("text"))
    return plain.mapInArrow(lambda b: _batches(b, least_length, least_exponent), _RESULT)


def stretched(doc_id: Column, text: Column) -> Column:
    """The text of one document in ten with its words from some place on repeated at some period, told by its id alone.

    With n words and h the CRC-32 of the decimal id, g = h div 10: if h ends in 0, the words from
    a = g mod n on repeat those p = 1 + (n - a) div (3 + g mod 8) that follow a.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all(text_or_empty(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.greatest(F.size(words), F.lit(1))
    a = F.pmod(g, n.cast("long")).cast("int")
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("int")
    cycle = F.slice(words, a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(cycle, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    made = F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")
    return F.when(F.coalesce(F.pmod(h, F.lit(10)) == 0, F.lit(False)) & F.regexp_like(text_or_empty(text), F.lit(r"[^\x20\x09-\x0D]")), made).otherwise(text)


def digest_columns(found: DataFrame) -> DataFrame:
    """The number of runs, the one with the greatest exponent, and hashes of all runs and of the collapsed text."""
    # of exact quotients that are equal the first in order stays; products of lengths and periods fit a long
    best = F.aggregate(
        "runs", F.get("runs", F.lit(0)),
        lambda held, x: F.when(x["length"] * held["period"] > held["length"] * x["period"], x).otherwise(held),
    )
    line = lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","), x["period"].cast("string"), F.lit("\n"))
    rows = found.withColumn("_b", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_b.start").alias("start"), F.col("_b.length").alias("length"), F.col("_b.period").alias("period"),
        F.expr("_b.length * 1000 div _b.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
