"""Packing by concatenate and cut.

All documents, each followed by an end id, form one long run of ids that is cut every ``size`` ids.
Pass one tokenizes every task's rows, numbers its ids from 0 and writes them to the shared folder;
one running sum over the totals of those tasks gives each its global offset; pass two cuts every
document at the window bounds that fall inside it. No ids are shuffled: only one row for each task
of pass one is. Only the last sequence is short.

Defined results: a null or empty text is its end id alone; repeated rows are packed one by one; an
empty table gives no pieces; other columns are ignored; documents of any length are cut into as many
pieces as needed.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrashift.llm.byte_bpe import chunks
from terrashift.llm.common import materialize, text_or_empty

#: Bound of the offsets that are broadcast, one row for each task of pass one.
MAX_BROADCAST_ROWS = 200_000
#: Bytes of text encoded together.
CHUNK_BYTES = 2_000_000


def byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts as a byte-level tokenizer file gives them, without added special tokens.

    Where the file's merges are in the order of their ids, its vocabulary is a rank file too, and
    texts of Latin letters, where all pattern engines agree, are encoded from those ranks: the ids
    are the same and take a third of the time. All other texts, and those that hold a special
    string, are encoded by the tokenizers library itself.
    """

    def __init__(self, tokenizer_file: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.other = re.compile("|".join(["[^\\t-\\r\\x20-\\x7e\\xa0-\\u024f]", *special])).search
        with open(tokenizer_file, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        self.ranked = None
        if merged == sorted(merged):
            letters = byte_letters()
            ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if all(c in letters for c in token) and i not in self.tokenizer.get_added_tokens_decoder()}
            self.ranked = tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        slow = [self.ranked is None or self.other(t) is not None for t in texts]
        rest = iter(self.tokenizer.encode_batch_fast([t for t, s in zip(texts, slow, strict=True) if s], add_special_tokens=False))
        return [array("I", next(rest).ids if s else self.ranked.encode_ordinary(t)).tobytes() for t, s in zip(texts, slow, strict=True)]


_TOKENS = "part int, local_start long, doc_id long, doc_tokens long, ids binary"
_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _tokenize(batches: Iterator[pa.RecordBatch], tokenizer_file: str, pattern: str, end_id: int) -> Iterator[pa.RecordBatch]:
    encode = Encoder(tokenizer_file, pattern).encode_batch  # for this task alone: an idle worker shall not hold the vocabulary
    end, part, total = end_id.to_bytes(4, "little"), TaskContext.get().partitionId(), 0
    for batch in batches:
        for i, j, texts in chunks(batch.column("text"), CHUNK_BYTES):
            ids = [x + end for x in encode(texts)]
            sizes = np.fromiter(map(len, ids), np.int64, j - i) // 4
            starts = total + np.cumsum(sizes) - sizes
            total += int(sizes.sum())
            columns = [pa.array(np.full(j - i, part, np.int32)), pa.array(starts), batch.column("doc_id").slice(i, j - i), pa.array(sizes), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "local_start", "doc_id", "doc_tokens", "ids"])


def _cut(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(0, batch.num_rows, 1024):
            part = batch.slice(row, 1024)
            starts, sizes = part.column("global_start").to_numpy(), part.column("doc_tokens").to_numpy()
            first, last = starts // size, (starts + sizes - 1) // size
            pieces = last - first + 1
            doc = np.repeat(np.arange(len(starts)), pieces)
            sequence = np.repeat(first - (np.cumsum(pieces) - pieces), pieces) + np.arange(len(doc))
            begin = np.maximum(sequence * size, starts[doc])
            end = np.minimum((sequence + 1) * size, (starts + sizes)[doc])
            local, length = begin - starts[doc], end - begin
            held = part.column("ids").to_pylist()
            cut = [held[d][4 * a : 4 * (a + n)] for d, a, n in zip(doc.tolist(), local.tolist(), length.tolist(), strict=True)]
            columns = [part.column("doc_id").take(pa.array(doc)), pa.array(local), pa.array(length), pa.array(cut, pa.binary()), pa.array(sizes[doc]), pa.array(sequence), pa.array(begin % size)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def tokenize(docs: DataFrame, tokenizer_file: str, pattern: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pass one, written: (part, local_start, doc_id, doc_tokens, ids), ids with the end id."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return materialize(rows.mapInArrow(lambda b: _tokenize(b, tokenizer_file, pattern, end_id), _TOKENS), "packing-tokens")


def cut(tokens: DataFrame, size: int = 1024) -> DataFrame:
    """Pass two: the pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset)."""
    totals = materialize(tokens.groupBy("part").agg(F.sum("doc_tokens").alias("total")), "packing-totals")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))
    if totals.count() <= MAX_BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    placed = tokens.join(offsets, "part").select("doc_id", "doc_tokens", "ids", (F.col("before") + F.col("local_start")).alias("global_start"))
    return placed.mapInArrow(lambda b: _cut(b, size), _PIECES)


def pack(docs: DataFrame, tokenizer_file: str, pattern: str, size: int = 1024, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return cut(tokenize(docs, tokenizer_file, pattern, end_id, doc_id, text), size)


def boundary_records(pieces: DataFrame) -> DataFrame:
    """(sequence_id, doc_id, start) of each sequence that starts inside a document."""
    return pieces.filter("offset = 0 AND start > 0").select("sequence_id", "doc_id", "start")


def digest_columns(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
