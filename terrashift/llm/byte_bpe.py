"""Byte-level BPE encoding and decoding with padded numpy matrices.

The rank file is read from ``rank_file``. Each match of the pattern is encoded on its own. The matches of a batch
that are new to the worker are bucketed by length and laid out as the rows of a padded matrix of ids;
in each round every row merges its leftmost pair of least rank, pairs being looked up in a hash table
for all rows at once, and rows are compacted as they empty, until no row has a pair to merge.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows are encoded
one by one; an empty table gives an empty table; other columns are ignored. Texts of any length are
whole: a long match is a row of a wide matrix with few rows, treated as all others are.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrashift.llm.common import text_or_empty

#: Bounds of what a worker remembers, and of the cells of one matrix; rows below this width are one block.
MAX_KNOWN, MAX_KNOWN_BYTES, MAX_CELLS, NARROW = 300_000, 64, 1 << 20, 64

_NONE = np.int32(2**31 - 1)


class PairTable:
    """Open-addressing hash table from id pairs to the id of their merge, probed for whole arrays."""

    def __init__(self, pairs: np.ndarray, merged: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(np.ceil(np.log2(4 * len(pairs) + 4)))))
        size = 1 << (64 - int(self.shift))
        self.mask = size - 1
        self.keys = np.full(size, -1, np.int64)
        self.values = np.full(size, _NONE, np.int32)
        slots, todo, self.probes = self._slot(pairs), np.arange(len(pairs)), 0
        while len(todo):
            free = self.keys[slots[todo]] == -1
            at, who = np.unique(slots[todo[free]], return_index=True)
            placed = todo[free][who]
            self.keys[at], self.values[at] = pairs[placed], merged[placed]
            todo = np.setdiff1d(todo, placed)
            slots[todo] = (slots[todo] + 1) & self.mask
            self.probes += 1

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, pairs: np.ndarray) -> np.ndarray:
        slots = self._slot(pairs)
        out = np.where(self.keys[slots] == pairs, self.values[slots], _NONE)
        open_ = np.flatnonzero((out == _NONE) & (self.keys[slots] != -1))
        for _ in range(self.probes):
            if not len(open_):
                break
            at = (slots.ravel()[open_] + 1) & self.mask
            slots.ravel()[open_] = at
            out.ravel()[open_] = np.where(self.keys[at] == pairs.ravel()[open_], self.values[at], _NONE)
            open_ = open_[(out.ravel()[open_] == _NONE) & (self.keys[at] != -1)]
        return out


class ByteBpe:
    """Encoder and decoder for one rank file (lines of base64 bytes and rank)."""

    def __init__(self, rank_file: str, pattern: str):
        import regex

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.matches = regex.compile(pattern).findall
        self.by_id = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.by_id[i] = token
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        # a merge is by rank of the concatenation: every cut of a token into two tokens is such a pair
        cuts = [(ranks[t[:k]], ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        table = np.array(cuts, np.int64).reshape(-1, 3)
        self.pairs = PairTable(table[:, 0] << 32 | table[:, 1], table[:, 2].astype(np.int32))
        self.whole = ranks
        self.known: dict[str, bytes] = {}

    def _merge(self, ids: np.ndarray) -> list[np.ndarray]:
        """The merged ids of each row of ``ids``; -1 pads.

        A merge marks a cell dead and looks up again only the pairs beside it; the least rank of a row
        comes from the least ranks of its blocks, so a round costs the root of the width. Rows are
        compacted to the left when half of their width is dead.
        """
        out: list[np.ndarray] = [ids[:0, 0]] * len(ids)
        owner = np.arange(len(ids))
        while True:
            count, used = ids.shape
            block = used + 1 if used < NARROW else int(np.sqrt(used)) + 1
            blocks = -(-(used + 1) // block)
            width = blocks * block
            last = width - 1  # always padding: what a row's end has for a neighbour
            cells = np.full((count, width), -1, np.int64)
            cells[:, :used] = ids
            following, before = np.tile(np.minimum(np.arange(width) + 1, last), (count, 1)), np.tile(np.arange(width) - 1, (count, 1))
            before[:, 0] = last
            ranks = np.full((count, width), _NONE, np.int32)
            live = (ids[:, :-1] >= 0) & (ids[:, 1:] >= 0)
            ranks[:, : used - 1][live] = self.pairs.get((ids[:, :-1][live].astype(np.int64) << 32) | ids[:, 1:][live])
            going = self._rounds(cells.reshape(-1), following.reshape(-1), before.reshape(-1), ranks, blocks, max(8, used // 2))
            done = np.ones(count, bool)
            done[going] = False
            sizes = (cells >= 0).sum(axis=1)
            for row, merged in zip(owner[done].tolist(), np.split(cells[done][cells[done] >= 0], np.cumsum(sizes[done]))[:-1], strict=True):
                out[row] = merged
            if not len(going):
                return out
            # compaction: what is left of the rows that go on moves to the left
            packed = cells[going]
            ids = np.full((len(going), int(sizes[going].max())), -1, np.int32)
            ids[np.arange(ids.shape[1]) < sizes[going][:, None]] = packed[packed >= 0]
            owner = owner[going]

    def _rounds(self, cells: np.ndarray, following: np.ndarray, before: np.ndarray, ranks: np.ndarray, blocks: int, most: int) -> np.ndarray:
        """Up to ``most`` rounds in place, a merge of every row in each; the rows that have pairs left."""
        count, width = ranks.shape
        by_block = ranks.reshape(count * blocks, -1)
        block, flat = by_block.shape[1], ranks.reshape(-1)
        least = by_block.min(axis=1).reshape(count, blocks)
        rows = np.arange(count)
        for _ in range(most):
            first = rows * blocks
            first += (least if len(rows) == count else least[rows]).argmin(axis=1)
            best = least.reshape(-1)[first]
            if best.max() == _NONE:
                going = best != _NONE
                rows, first, best = rows[going], first[going], best[going]
                if not len(rows):
                    return rows
            base = rows * width
            at = first * block + by_block[first].argmin(axis=1)
            gone = base + following[at]
            right, left = base + following[gone], base + before[at]
            cells[at], cells[gone] = best, -1
            following[at] = right - base
            before[right] = at - base
            made = best.astype(np.int64)
            flat[gone] = _NONE
            new = self.pairs.get(np.concatenate((cells[left] << 32 | made, made << 32 | cells[right])))
            flat[left], flat[at] = new[: len(rows)], new[len(rows) :]
            touched = np.concatenate((gone, at, left)) // block
            least.reshape(-1)[touched] = by_block[touched].min(axis=1)
        return rows

    def encode_matches(self, matches: list[bytes]) -> list[bytes]:
        """Ids of each match as little-endian unsigned 32-bit integers."""
        out = [b""] * len(matches)
        sizes = np.fromiter(map(len, matches), np.int64, len(matches))
        todo = []
        for i in np.argsort(sizes, kind="stable"):
            token = self.whole.get(matches[i])
            if token is not None:
                out[i] = token.to_bytes(4, "little")
            elif matches[i]:
                todo.append(i)
        start = 0
        while start < len(todo):  # buckets of near lengths, of a bounded number of cells
            first = int(sizes[todo[start]])
            widest = first + max(2, first // 8)
            end = start + 1
            while end < len(todo) and sizes[todo[end]] <= widest and (end - start + 1) * sizes[todo[end]] <= MAX_CELLS:
                end += 1
            rows = todo[start:end]
            width = int(sizes[rows[-1]])
            block = np.frombuffer(b"".join(matches[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(len(rows), width)
            ids = np.where(np.arange(width) < sizes[rows][:, None], self.of_byte[block], np.int32(-1)).astype(np.int32)
            for i, row in zip(rows, self._merge(ids), strict=True):
                out[i] = row.astype("<u4").tobytes()
            start = end
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        matched = [self.matches(t) for t in texts]
        known = self.known
        fresh = list({m for ms in matched for m in ms if m not in known})
        # what a batch needs beyond the bound is held for the batch alone
        found = dict(zip(fresh, self.encode_matches([m.encode() for m in fresh]), strict=True))
        if len(known) + len(found) > MAX_KNOWN:
            known.clear()
            found |= self._missing(matched, found)
        known.update({m: v for m, v in found.items() if len(v) <= 4 * MAX_KNOWN_BYTES})
        get = lambda m: known[m] if m in known else found[m]
        out = []
        for ms in matched:
            try:
                out.append(b"".join(map(known.__getitem__, ms)))
            except KeyError:
                out.append(b"".join(map(get, ms)))
        return out

    def _missing(self, matched: list[list[str]], found: dict[str, bytes]) -> dict[str, bytes]:
        rest = list({m for ms in matched for m in ms if m not in found})
        return dict(zip(rest, self.encode_matches([m.encode() for m in rest]), strict=True))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.by_id.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(rank_file: str, pattern: str) -> ByteBpe:
    """One codec for each worker process and file."""
    return ByteBpe(rank_file, pattern)


#: Bytes of text encoded together: bounds a worker's memory.
CHUNK_BYTES = 2_000_000


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, list]]:
    """Ranges of a text or binary column of about ``most`` bytes, one value at least, and their values."""
    start = total = 0
    for i, n in enumerate(pc.binary_length(column).to_pylist()):
        if total and total + n > most:
            yield start, i, column.slice(start, i - start).to_pylist()
            start, total = i, 0
        total += n
    if start < len(column):
        yield start, len(column), column.slice(start).to_pylist()


def _encode(batches: Iterator[pa.RecordBatch], rank_file: str, pattern: str) -> Iterator[pa.RecordBatch]:
    bpe = codec(rank_file, pattern)
    for batch in batches:
        for i, j, texts in chunks(batch.column("text")):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(bpe.encode_batch(texts), pa.binary())], names=["doc_id", "ids"])


def _round_trip(batches: Iterator[pa.RecordBatch], rank_file: str, pattern: str) -> Iterator[pa.RecordBatch]:
    decode = codec(rank_file, pattern).decode
    for part in _encode(batches, rank_file, pattern):
        decoded = pa.array(map(decode, part.column("ids").to_pylist()), pa.binary(), size=part.num_rows)
        yield pa.RecordBatch.from_arrays([*part.columns, decoded], names=["doc_id", "ids", "decoded"])


def _decode(batches: Iterator[pa.RecordBatch], rank_file: str, pattern: str) -> Iterator[pa.RecordBatch]:
    bpe = codec(rank_file, pattern)
    for batch in batches:
        for row in range(0, batch.num_rows, 512):
            part = batch.slice(row, 512)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([bpe.decode(i) for i in part.column("ids").to_pylist()], pa.binary())], names=["doc_id", "ids", "decoded"])


def encode(docs: DataFrame, rank_file: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 32-bit integers."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(lambda b: _encode(b, rank_file, pattern), "doc_id long, ids binary")


def decode(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded) of the rows that :func:`encode` gives."""
    return encoded.select("doc_id", "ids").mapInArrow(lambda b: _decode(b, rank_file, pattern), "doc_id long, ids binary, decoded binary")


def encode_and_decode(docs: DataFrame, rank_file: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) in one step, so that one worker for each core holds the vocabulary."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(lambda b: _round_trip(b, rank_file, pattern), "doc_id long, ids binary, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
