"""Token counts by byte-pair merging with a heap over a linked list of symbols.

The vocabulary is a sentencepiece BPE model read from ``model_file``; only its pieces and scores are
used. A text's symbols start as its characters. The adjacent pair whose concatenation is the
best-scored piece, leftmost among equals, is popped from a heap and merged until no pair is a piece.
The count is the number of initial symbols minus the number of merges, where a character that is no
piece stands for its UTF-8 bytes; no identifier is made.

Two exact shortcuts keep this cheap. No merge crosses a boundary whose two characters never stand
side by side inside a piece, so a text is counted part by part between its spaces; and a part's count
depends on nothing else, so each worker remembers the parts that it has counted, up to a bound.

Defined results: a null or empty text has 0 tokens; repeated rows are counted one by one; an empty
table gives an empty table; other columns are ignored; parts too long to be worth remembering are
counted each time.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrashift.llm.common import text_or_empty

_SPACE = "▁"  # stands for a space in pieces

#: Bounds of what a worker remembers: parts, and characters of a part.
MAX_PARTS, MAX_PART_CHARS = 400_000, 64


class PieceCounter:
    """Counts the tokens of texts by one vocabulary."""

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces:
            raise ValueError("only BPE models without normalization and with a leading space are supported")
        if not model.trainer_spec.byte_fallback:
            raise ValueError("a model without byte fallback counts unknown characters in another way")
        if any(p.type in (4, 5) for p in model.pieces):
            raise ValueError("user-defined and unused pieces take part in merges in a way of their own")
        normal = [p for p in model.pieces if p.type == 1]  # control, unknown and byte pieces never come out of merges
        # rank: 0 for the best score; equal scores share a rank, so that position decides
        scores = sorted({p.score for p in normal}, reverse=True)
        rank = {s: i for i, s in enumerate(scores)}
        self.ranks = {p.piece: rank[p.score] for p in normal}
        if any(_SPACE in p.lstrip(_SPACE) for p in self.ranks):
            raise ValueError("a piece has a space after other characters: texts can't be parted at spaces")
        self.known: dict[str, int] = {}

    def _initial(self, symbol: str) -> int:
        return 1 if symbol in self.ranks else len(symbol.encode())

    def merge_count(self, part: str) -> int:
        """Initial symbols minus merges of one part, by heap and linked list."""
        ranks, n = self.ranks, len(part)
        count = sum(map(self._initial, part))
        if n < 2:
            return count
        text, left, right = list(part), list(range(-1, n - 1)), list(range(1, n + 1))
        right[-1] = -1
        heap = [(ranks[pair], i, pair) for i in range(n - 1) if (pair := part[i : i + 2]) in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = right[i] if text[i] else -1
            if j < 0 or len(text[i]) + len(text[j]) != len(pair) or text[i] + text[j] != pair:
                continue  # one of the two was merged meanwhile
            text[i], text[j] = pair, ""
            count -= 1
            after = right[i] = right[j]
            if after >= 0:
                left[after] = i
                if (new := pair + text[after]) in ranks:
                    heapq.heappush(heap, (ranks[new], i, new))
            before = left[i]
            if before >= 0 and (new := text[before] + pair) in ranks:
                heapq.heappush(heap, (ranks[new], before, new))
        return count

    def count(self, text: str) -> int:
        if not text:
            return 0
        known, parts = self.known, _parts(_SPACE + text.replace(" ", _SPACE))
        try:
            return sum(map(known.__getitem__, parts))
        except KeyError:
            pass
        total = 0
        for part in parts:
            n = known.get(part)
            if n is None:
                n = self.merge_count(part)
                if len(part) <= MAX_PART_CHARS:
                    if len(known) >= MAX_PARTS:
                        known.clear()
                    known[part] = n
            total += n
        return total


#: A part: spaces and what follows them up to the next space.
_parts = re.compile(f"{_SPACE}*[^{_SPACE}]+|{_SPACE}+").findall


@lru_cache(maxsize=2)
def counter(model_file: str) -> PieceCounter:
    """One counter for each worker process and model."""
    return PieceCounter(model_file)


def _count(batches: Iterator[pa.RecordBatch], model_file: str) -> Iterator[pa.RecordBatch]:
    count = counter(model_file).count
    for batch in batches:
        counts = [count(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row. No shuffle: every task counts its own rows."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    rows = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    counted = rows.mapInArrow(lambda b: _count(b, model_file), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
