"""Removal of repeated passages by sparse suffix arrays, sorted deep-shallow.

A byte goes if a string of ``length`` bytes (200) that covers it starts anywhere else too. Suffixes
are sorted only at anchors: the leftmost k-gram of least hash among those of each window of
``length`` bytes. Equal windows have equal anchors at equal offsets, so every repeat is seen.

1. Every task finds the anchors of its documents, each with a hash of its k-gram and one of its
   whole context (all windows that hold the k-gram lie in it). Contexts that repeat inside a batch
   are settled there and sent on once.
2. Anchors meet by k-gram. A context that occurs twice is settled: all of it repeats. A k-gram with
   one context only is settled too. Other contexts are open.
3. For open contexts, texts give the bytes. By k-gram, the suffixes to the right of the anchors and
   the reversed prefixes to the left are sorted: multikey quicksort by words to a shallow depth, then
   a blind trie for each group that still agrees. The two arrays of common prefixes tell for each
   offset which windows are equal.
4. The intervals found go to their documents, are merged and cut out.

The suffixes of a k-gram with more than ``MAX_GROUP`` open contexts don't come together in one task:
they are split by all that a window holds, so that a group is the equal windows of one 128-bit hash,
combined in each task before they move. A k-gram with more anchors than that and than twice a
bucket's mean load is hot: its anchors don't even meet in step 2, but are combined in each task and
dealt by context. Such k-grams are fewer than half the buckets, whatever the input is. Nothing is
capped in any way. The number of buckets follows from the bytes of text, so that a bucket's anchors
fit a task whatever ``spark.sql.shuffle.partitions`` is.

What moves between tasks is packed by numpy into few rows, each for a bucket of keys.

Defined results: a null or empty text, or one shorter than ``length``, keeps all it has; matches don't
cross documents; repeated rows are repeats of each other; a text whose rest is no longer UTF-8 is
kept as bytes (``kept``); an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrashift.llm.common import materialize, quoted, text_or_empty

#: Length of the k-grams; open contexts of one k-gram that are sorted in one task; bytes that agree before a trie is made.
GRAM, MAX_GROUP, SHALLOW = 64, 100_000, 32
#: Bytes of text for one numpy batch; buckets for each shuffle partition at least, and bytes of text for a bucket at most.
BATCH_BYTES, BUCKETS, BUCKET_BYTES = 1_000_000, 4, 128_000_000
#: Tasks of a shuffle that follow from the bytes of text.
MAX_PARTS = 100_000
#: Anchors of hot k-grams that a task combines before it sends them on.
HOT_RECORDS = 500_000

_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_ANCHOR = np.dtype([("gram", "<u8"), ("context", "<u8"), ("rid", "<i8"), ("pos", "<i4"), ("left", "<i2"), ("right", "<i2"), ("count", "i1")])
_SPAN = np.dtype([("rid", "<i8"), ("start", "<i4"), ("end", "<i4")])
_ASK = np.dtype([("rid", "<i8"), ("gram", "<u8"), ("pos", "<i4"), ("left", "<i2"), ("right", "<i2"), ("count", "i1"), ("wide", "i1")])
_WINDOW = np.dtype([("high", "<u8"), ("low", "<u8"), ("rid", "<i8"), ("start", "<i4"), ("count", "<i4")])

#: ``doc_id`` is that of a text; rows of packed records have their number there.
_ROW = "bucket int, kind int, rid long, doc_id long, data binary"
_NAMES = ["bucket", "kind", "rid", "doc_id", "data"]
# kinds of rows, in the order in which a bucket is read
_ANCHORS, _HOT, _SPANS, _ASKS, _CONTEXTS, _WINDOWS, _TEXT = range(7)


# --- anchors --------------------------------------------------------------------------------------


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all substrings of ``size`` bytes (a power of two), each from two of half the size."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _C1
    step = 1
    while step < size:
        h = h[:-step] * _C2 + h[step:] * _C3
        h ^= h >> np.uint64(29)
        step *= 2
    return h * _C1


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours: running minima from both ends of blocks of that width."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    block = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def find_anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, place in ``data`` and k-gram hash of every anchor; documents are data[start:end], in order."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none.astype(np.uint64)
    hashes = gram_hashes(data, gram)
    key = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)
    least = sliding_min(key, length - gram + 1)
    # the windows that lie in one document
    inside = np.zeros(len(data) + 1, np.int32)
    long_ = ends - starts >= length
    np.add.at(inside, starts[long_], 1)
    np.add.at(inside, ends[long_] - length + 1, -1)
    valid = np.cumsum(inside)[: len(least)] > 0
    places = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)[valid]
    places = np.unique(places[np.concatenate(([True], places[1:] != places[:-1]))]) if len(places) else none
    return np.searchsorted(starts, places, side="right") - 1, places, hashes[places]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Unpacked texts in groups of about BATCH_BYTES."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    rids, texts, total = [], [], 0
    for batch in batches:
        for rid, packed in zip(batch.column("rid").to_pylist(), batch.column("packed"), strict=True):
            text = unpack(packed.as_buffer().to_pybytes())
            rids.append(rid)
            texts.append(text)
            total += len(text)
            if total >= BATCH_BYTES:
                yield rids, texts
                rids, texts, total = [], [], 0
    if rids:
        yield rids, texts


def _packed(records: np.ndarray) -> bytes:
    """Records as compressed bytes, small ones plane by plane: most planes but those of hashes are nearly constant."""
    import zstandard

    flat = np.ascontiguousarray(records).view(np.uint8).reshape(len(records), records.dtype.itemsize)
    return zstandard.compress((flat if records.dtype.itemsize > 64 else flat.T).tobytes(), 1)


def _unpacked(blobs: list[bytes], dtype: np.dtype) -> np.ndarray:
    import zstandard

    parts = []
    for blob in blobs:
        flat = np.frombuffer(zstandard.decompress(blob), np.uint8)
        if dtype.itemsize <= 64:
            flat = np.ascontiguousarray(flat.reshape(dtype.itemsize, -1).T)
        parts.append(flat.reshape(-1).view(dtype))
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def _scatter(records: np.ndarray, keys: np.ndarray, kind: int, buckets: int) -> Iterator[tuple]:
    """Rows (bucket, kind, None, number, packed records) by a hash of the keys."""
    if len(records):
        bucket = ((keys.astype(np.uint64) * _C1) >> np.uint64(40)).astype(np.int64) % buckets
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        for part in np.split(order, cuts):
            yield int(bucket[part[0]]), kind, None, len(part), _packed(records[part])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=_NAMES)


def _spans(rid: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(rid), _SPAN)
    out["rid"], out["start"], out["end"] = rid, start, end
    return out


def _context_spans(a: np.ndarray, gram: int, length: int) -> np.ndarray:
    """What whole contexts cover; those shorter than a window cover nothing."""
    a = a[a["left"].astype(np.int64) + gram + a["right"] >= length]
    return _spans(a["rid"], a["pos"] - a["left"], a["pos"] + gram + a["right"])


def _runs(sorted_keys: list[np.ndarray]) -> np.ndarray:
    """Starts of the runs of equal keys."""
    new = np.zeros(len(sorted_keys[0]), bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _classes(a: np.ndarray, gram: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """One anchor for each (k-gram, context), its count at most 2, and the spans of those that occur twice."""
    a = a[np.lexsort((a["context"], a["gram"]))]
    first = _runs([a["gram"], a["context"]])
    total = np.add.reduceat(a["count"], first) if len(first) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(a)))
    spans = _context_spans(a[np.repeat(total > 1, sizes)], gram, length)
    kept = a[first].copy()
    kept["count"] = np.minimum(total, 2)
    return kept, spans


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int, gram: int, buckets: int) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_64_intdigest

    reach = length - gram
    for rids, texts in _batches(batches):
        joined = b"".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        starts = ends - sizes
        doc, place, hashes = find_anchors(np.frombuffer(joined, np.uint8), starts, ends, length, gram)
        a = np.zeros(len(doc), _ANCHOR)
        low, high = np.maximum(starts[doc], place - reach), np.minimum(ends[doc], place + gram + reach)
        a["gram"], a["rid"], a["pos"] = hashes, np.array(rids, np.int64)[doc], place - starts[doc]
        a["left"], a["right"], a["count"] = place - low, high - place - gram, 1
        view = memoryview(joined)
        a["context"] = np.fromiter((xxh3_64_intdigest(view[i:j], n) for i, j, n in zip(low.tolist(), high.tolist(), a["left"].tolist(), strict=True)), np.uint64, len(a))
        kept, spans = _classes(a, gram, length)
        yield _rows([*_scatter(kept, kept["gram"], _ANCHORS, buckets), *_scatter(spans, spans["rid"], _SPANS, buckets)])


# --- hot k-grams ----------------------------------------------------------------------------------


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams, n = np.unique(_unpacked([d.as_py() for d in batch.column("data")], _ANCHOR)["gram"], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n)], names=["gram", "n"])


def hot_grams(anchors: DataFrame, buckets: int, max_group: int) -> tuple[list[int], np.ndarray]:
    """The buckets that hold hot k-grams, and these k-grams, sorted.

    Loads of buckets come first, from the numbers of records alone; k-grams are counted only in those
    that are over the limit, as no other can hold a hot one. At more than twice the mean load each,
    there are fewer than ``buckets / 2`` k-grams: 8 bytes for each go to every task.
    """
    rows = anchors.filter(F.col("kind") == _ANCHORS)
    loads = rows.groupBy("bucket").agg(F.sum("doc_id").alias("n")).collect()  # one row for each bucket
    limit = max(max_group, 2 * sum(r.n for r in loads) // buckets)
    crowded = [r.bucket for r in loads if r.n > limit]
    if not crowded:
        return [], np.zeros(0, np.uint64)
    counts = rows.filter(F.col("bucket").isin(crowded)).select("data").mapInArrow(_gram_counts, "gram long, n long")
    found = counts.groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") > limit).select("gram").collect()
    return crowded, np.sort(np.array([r.gram for r in found], np.int64).view(np.uint64))


def _is_hot(grams: np.ndarray, hot: np.ndarray) -> np.ndarray:
    return hot[np.minimum(np.searchsorted(hot, grams), len(hot) - 1)] == grams


def _part_hot(batches: Iterator[pa.RecordBatch], hot: np.ndarray, length: int, gram: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Anchors of crowded buckets: those of hot k-grams, combined over the task, are dealt by context too."""

    def combined(parts: list[np.ndarray]) -> Iterator[tuple]:
        kept, spans = _classes(np.concatenate(parts), gram, length)
        yield from _scatter(kept, kept["gram"] ^ kept["context"], _HOT, buckets)
        yield from _scatter(spans, spans["rid"], _SPANS, buckets)

    held, total = [], 0
    for batch in batches:
        out = []
        for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("data"), strict=True):
            a = _unpacked([data.as_py()], _ANCHOR)
            is_hot = _is_hot(a["gram"], hot)
            if not is_hot.all():
                out.append((bucket, _ANCHORS, None, int((~is_hot).sum()), _packed(a[~is_hot])))
            if is_hot.any():
                held.append(a[is_hot])
                total += len(held[-1])
            if total >= HOT_RECORDS:
                out += combined(held)
                held, total = [], 0
        yield _rows(out)
    if held:
        yield _rows(list(combined(held)))


def _spread(anchors: DataFrame, length: int, gram: int, buckets: int, max_group: int) -> DataFrame:
    """Anchors and spans with hot k-grams dealt by context."""
    crowded, hot = hot_grams(anchors, buckets, max_group)
    if not len(hot):
        return anchors
    mixed = (F.col("kind") == _ANCHORS) & F.col("bucket").isin(crowded)
    return anchors.filter(~mixed).union(anchors.filter(mixed).mapInArrow(lambda b: _part_hot(b, hot, length, gram, buckets), _ROW))


# --- buckets --------------------------------------------------------------------------------------


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """Rows come sorted by bucket and kind: each bucket with its (kind, rid, doc_id, data)."""
    bucket, rows = None, []
    for batch in batches:
        columns = [batch.column(n) for n in _NAMES]
        for i, b in enumerate(columns[0].to_pylist()):
            if b != bucket and rows:
                yield bucket, rows
                rows = []
            bucket = b
            rows.append((columns[1][i].as_py(), columns[2][i].as_py(), columns[3][i].as_py(), columns[4][i].as_py()))
    if rows:
        yield bucket, rows


def _of_kind(rows: list, kind: int, dtype: np.dtype) -> np.ndarray:
    return _unpacked([r[3] for r in rows if r[0] == kind], dtype)


def _settle(batches: Iterator[pa.RecordBatch], length: int, gram: int, buckets: int, max_group: int) -> Iterator[pa.RecordBatch]:
    """From anchors by k-gram: spans of contexts that repeat, and questions for the open ones.

    All contexts of hot k-grams that are left are open and wide.
    """
    for bucket, rows in _by_bucket(batches):
        passed = [(bucket, *r) for r in rows if r[0] == _SPANS]
        kept, spans = _classes(_of_kind(rows, _ANCHORS, _ANCHOR), gram, length)
        first = _runs([kept["gram"]]) if len(kept) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(first, len(kept)))
        size = np.repeat(sizes, sizes)
        open_ = (size > 1) & (kept["left"].astype(np.int64) + gram + kept["right"] >= length)
        hot, hot_spans = _classes(_of_kind(rows, _HOT, _ANCHOR), gram, length)
        hot = hot[hot["left"].astype(np.int64) + gram + hot["right"] >= length]
        spans = np.concatenate((spans, hot_spans))
        asks = np.concatenate((_questions(kept[open_], size[open_] > max_group), _questions(hot, True)))
        yield _rows([*passed, *_scatter(spans, spans["rid"], _SPANS, buckets), *_scatter(asks, asks["rid"], _ASKS, buckets)])


def _questions(a: np.ndarray, wide: np.ndarray | bool) -> np.ndarray:
    asks = np.zeros(len(a), _ASK)
    for name in ("rid", "gram", "pos", "left", "right", "count"):
        asks[name] = a[name]
    asks["wide"] = wide
    return asks


def _answer(batches: Iterator[pa.RecordBatch], length: int, gram: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """From questions and texts by document: the bytes of open contexts by k-gram, or window hashes of wide ones."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    asks, bucket = np.zeros(0, _ASK), None
    width = 2 * (length - gram) + gram
    record = np.dtype([*_ASK.descr, ("bytes", f"V{width}")])
    for batch in batches:
        asked, contexts, windows = [], [], []
        for b, kind, rid, data in zip(*(batch.column(n).to_pylist() for n in ("bucket", "kind", "rid", "data")), strict=True):
            if b != bucket:
                bucket, asks, parts = b, np.zeros(0, _ASK), []
            if kind == _ASKS:
                parts.append(data)
                continue
            if parts:
                asks, parts = _unpacked(parts, _ASK), []
                asks = asks[np.argsort(asks["rid"], kind="stable")]
            own = asks[np.searchsorted(asks["rid"], rid) : np.searchsorted(asks["rid"], rid, side="right")]
            if not len(own):
                continue
            text = unpack(data)
            wide = own["wide"] > 0
            if wide.any():
                windows.append(_window_hashes(text, own[wide], length, gram))
            own = own[~wide]
            asked.append(own)
            contexts += [text[p - a : p + gram + r].ljust(width, b"\0") for p, a, r in zip(own["pos"].tolist(), own["left"].tolist(), own["right"].tolist(), strict=True)]
        out = []
        if contexts:
            found = np.zeros(len(contexts), record)
            whole = np.concatenate(asked)
            for name in _ASK.names:
                found[name] = whole[name]
            found["bytes"] = np.frombuffer(b"".join(contexts), f"V{width}")
            out += _scatter(found, found["gram"], _CONTEXTS, buckets)
        if windows:
            w = np.concatenate(windows)
            kept, spans = _count_windows(w, length)
            out += [*_scatter(kept, kept["high"], _WINDOWS, buckets), *_scatter(spans, spans["rid"], _SPANS, buckets)]
        if out:
            yield _rows(out)


def _window_hashes(text: bytes, asks: np.ndarray, length: int, gram: int) -> np.ndarray:
    """128-bit hashes of all windows that hold the anchors of ``asks``."""
    from xxhash import xxh3_128_digest

    out = []
    for a in asks:
        low, high = int(a["pos"]) - int(a["left"]), int(a["pos"]) + gram + int(a["right"])
        starts = range(max(low, int(a["pos"]) + gram - length), min(int(a["pos"]), high - length) + 1)
        w = np.zeros(len(starts), _WINDOW)
        both = np.frombuffer(b"".join(xxh3_128_digest(text[s : s + length]) for s in starts), ">u8").reshape(-1, 2)
        w["high"], w["low"] = both[:, 0], both[:, 1]
        w["rid"], w["start"], w["count"] = a["rid"], np.fromiter(starts, np.int32, len(starts)), a["count"]
        out.append(w)
    return np.concatenate(out)


def _count_windows(w: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """One record for each hash, its count at most 2, and the spans of windows that occur twice.

    One window is asked for by every anchor that it holds; it counts once.
    """
    w = w[np.lexsort((w["count"], w["start"], w["rid"], w["low"], w["high"]))]
    again = np.zeros(len(w), bool)
    again[:-1] = (w["rid"][1:] == w["rid"][:-1]) & (w["start"][1:] == w["start"][:-1])
    w = w[~again]  # of the same window the record with the highest count stays
    first = _runs([w["high"], w["low"]]) if len(w) else np.zeros(0, np.int64)
    total = np.add.reduceat(w["count"], first) if len(first) else np.zeros(0, np.int64)
    twice = w[np.repeat(total > 1, np.diff(np.append(first, len(w))))]
    kept = w[first].copy()
    kept["count"] = np.minimum(total, 2)
    return kept, _spans(twice["rid"], twice["start"], twice["start"] + length)


# --- deep-shallow suffix sorting ------------------------------------------------------------------


class BlindTrie:
    """Orders strings that agree to some depth; a branch keeps only its depth and its next bytes."""

    def __init__(self, strings: list[bytes], depth: int):
        self.strings = strings
        self.root = None
        self.equal: dict[int, list[int]] = {}
        for i in range(len(strings)):
            self._insert(i, depth)

    def _insert(self, i: int, depth: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = i
            return
        path, node = [], self.root
        while not isinstance(node, int):  # blindly: bytes between branches are not looked at
            path.append(node)
            branches = node[1]
            c = s[node[0]] if node[0] < len(s) else -1
            node = branches.get(c)
            if node is None:
                node = next(iter(branches.values()))
        leaf = self.strings[node]
        same = common_prefix(s, leaf, depth)
        if same == len(s) == len(leaf):
            self.equal.setdefault(node, []).append(i)
            return
        mine, other = (s[same] if same < len(s) else -1), (leaf[same] if same < len(leaf) else -1)
        parent = None
        for branch in path:
            if branch[0] >= same:
                break
            parent = branch
        else:
            branch = None
        if branch is not None and branch[0] == same:
            branch[1][mine] = i
            return
        below = branch if branch is not None else node
        made = (same, {other: below, mine: i})
        if parent is None:
            self.root = made
        else:
            parent[1][s[parent[0]] if parent[0] < len(s) else -1] = made

    def walk(self) -> tuple[list[int], list[int]]:
        """The strings in order, and what each has in common with the one before it."""
        order, common, stack = [], [], [(self.root, 0)]
        while stack:
            node, shared = stack.pop()
            if isinstance(node, int):
                order.append(node)
                common.append(shared)
                for i in self.equal.get(node, ()):
                    order.append(i)
                    common.append(len(self.strings[i]))
                continue
            depth, branches = node
            keys = sorted(branches)
            stack += [(branches[k], depth if k != keys[0] else shared) for k in reversed(keys)]
        return order, common


def common_prefix(a: bytes, b: bytes, low: int) -> int:
    """Length of the common prefix of two strings that agree in ``low`` bytes: halving the doubtful part."""
    high = min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def deep_shallow_sort(rows: np.ndarray, lengths: np.ndarray, group: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings by (group, bytes, length), and the common prefix of each with the one before it.

    ``rows``: zero-padded bytes, a multiple of 8 wide; the first string of a group has -1.
    Multikey quicksort splits all segments at once in three, by a pivot word of each: smaller and
    larger words stay at their depth, equal ones go on to the next word. What is left at the shallow
    depth goes to blind tries.
    """
    n = len(rows)
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    common = np.full(n, -1, np.int64)
    shallow = min(shallow, rows.shape[1]) // 8
    # open segments: where they start, how long they are, and their depth in words
    start = np.flatnonzero(np.concatenate(([True], group[order][1:] != group[order][:-1]))) if n else np.zeros(0, np.int64)
    size, depth = np.diff(np.append(start, n)), np.zeros(len(start), np.int64)
    deep = []
    while True:
        deep += list(zip(start[(size > 1) & (depth == shallow)].tolist(), size[(size > 1) & (depth == shallow)].tolist(), strict=True))
        live = (size > 1) & (depth < shallow)
        start, size, depth = start[live], size[live], depth[live]
        if not len(start):
            break
        inner = np.repeat(np.arange(len(start)), size)
        first = np.cumsum(size) - size
        place = np.arange(len(inner)) + (start - first)[inner]
        members = order[place]
        own = words[members, depth[inner]]
        sample = np.sort(np.stack([own[first], own[first + size // 2], own[first + size - 1]]), axis=0)
        pivot = sample[1][inner]
        # ranks inside the three parts of each segment put every member in its place
        less, equal = own < pivot, own == pivot
        n_less, n_equal = np.add.reduceat(less, first, dtype=np.int64), np.add.reduceat(equal, first, dtype=np.int64)
        upto = lambda mask: np.cumsum(mask) - mask - (np.cumsum(mask)[first] - mask[first])[inner]
        more = ~(less | equal)
        target = np.where(less, upto(less), np.where(equal, n_less[inner] + upto(equal), (n_less + n_equal)[inner] + upto(more)))
        order[start[inner] + target] = members
        # borders between the parts: the first bytes that differ are in this word
        parts = np.stack([n_less, n_equal, size - n_less - n_equal], axis=1)
        begin = start[:, None] + np.cumsum(parts, axis=1) - parts
        start, depth = begin.ravel(), (depth[:, None] + [0, 1, 0]).ravel()
        size = parts.ravel()
        start, size, depth = start[size > 0], size[size > 0], depth[size > 0]
    fresh = np.flatnonzero(group[order][1:] == group[order][:-1]) + 1
    if len(fresh) and shallow:
        head = words[:, :shallow]
        different = head[order[fresh]] ^ head[order[fresh - 1]]
        at = (different != 0).argmax(axis=1)
        common[fresh] = 8 * at + _equal_bytes(different[np.arange(len(fresh)), at])
    for begin, count in deep:
        members = order[begin : begin + count]
        strings = [rows[m, : lengths[m]].tobytes() for m in members]
        inner, shared = BlindTrie(strings, min(8 * shallow, min(map(len, strings)))).walk()
        order[begin : begin + count] = members[inner]
        common[begin + 1 : begin + count] = shared[1:]
    short = np.minimum(lengths[order][1:], lengths[order][:-1])
    common[1:] = np.minimum(common[1:], short)
    return order, common


def _equal_bytes(different: np.ndarray) -> np.ndarray:
    """Leading equal bytes of big-endian words, from their exclusive or."""
    bits = np.frexp(different.astype(np.float64))[1]
    # a float may round up to the next power of two: then the bit below is the right one
    over = (bits > 0) & ((different >> np.minimum(bits - 1, 63).astype(np.uint64)) == 0)
    return (64 - (bits - over)) // 8


def _repeats(asks: np.ndarray, data: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Spans of the windows of open contexts that equal one of another context of the same k-gram."""
    reach = length - gram
    wide = -(-reach // 8) * 8
    left, right = asks["left"].astype(np.int64), asks["right"].astype(np.int64)
    columns = np.arange(wide)
    after = np.where(columns < right[:, None], np.take_along_axis(data, np.minimum(left[:, None] + gram + columns, data.shape[1] - 1), axis=1), 0).astype(np.uint8)
    before = np.where(columns < left[:, None], np.take_along_axis(data, np.maximum(left[:, None] - 1 - columns, 0), axis=1), 0).astype(np.uint8)
    n = len(asks)
    classes = []
    for rows, lengths in ((before, left), (after, right)):
        order, common = deep_shallow_sort(rows, lengths, asks["gram"])
        classes.append((order, common))
    (left_order, left_common), (right_order, right_common) = classes
    single, count = asks["count"] == 1, asks["count"]
    start, end, rid = [], [], []
    previous = np.zeros(n, bool)
    opened = np.zeros(n, np.int64)
    for d in range(reach + 2):  # windows that start d bytes before the anchor
        now = np.zeros(n, bool)
        if d <= reach:
            of_left, of_right = np.empty(n, np.int64), np.empty(n, np.int64)
            of_left[left_order] = np.cumsum(left_common < d)
            of_right[right_order] = np.cumsum(right_common < reach - d)
            fits = np.flatnonzero((left >= d) & (right >= reach - d))
            if len(fits):
                _, which = np.unique(of_left[fits] * (n + 1) + of_right[fits], return_inverse=True)
                total = np.bincount(which, count[fits])
                now[fits] = (total[which] > 1) & single[fits]
        opened[now & ~previous] = d
        closed = np.flatnonzero(previous & ~now)
        if len(closed):
            rid.append(asks["rid"][closed])
            start.append(asks["pos"][closed] - (d - 1))
            end.append(asks["pos"][closed] - opened[closed] + length)
        previous = now
    if not rid:
        return np.zeros(0, _SPAN)
    return _spans(np.concatenate(rid), np.concatenate(start), np.concatenate(end))


def _sort_contexts(batches: Iterator[pa.RecordBatch], length: int, gram: int, buckets: int) -> Iterator[pa.RecordBatch]:
    width = 2 * (length - gram) + gram
    record = np.dtype([*_ASK.descr, ("bytes", f"V{width}")])
    for bucket, rows in _by_bucket(batches):
        out = [(bucket, *r) for r in rows if r[0] == _SPANS]
        found = _of_kind(rows, _CONTEXTS, record)
        if len(found):
            found = found[np.argsort(found["gram"], kind="stable")]
            cuts = np.append(_runs([found["gram"]]), len(found))
            begin = 0
            while begin < len(found):  # whole k-grams, some thousands of contexts at a time
                end = int(cuts[np.searchsorted(cuts, begin + 20_000, side="right") - 1])
                if end <= begin:
                    end = int(cuts[np.searchsorted(cuts, begin, side="right")])
                part = found[begin:end]
                data = np.frombuffer(part["bytes"].tobytes(), np.uint8).reshape(len(part), width)
                spans = _repeats(part, data, length, gram)
                out += _scatter(spans, spans["rid"], _SPANS, buckets)
                begin = end
        windows = _of_kind(rows, _WINDOWS, _WINDOW)
        if len(windows):
            spans = _count_windows(windows, length)[1]
            out += _scatter(spans, spans["rid"], _SPANS, buckets)
        if out:
            yield _rows(out)


# --- documents ------------------------------------------------------------------------------------


def merged(spans: np.ndarray) -> np.ndarray:
    """Disjoint spans, those that touch joined: the maximal runs."""
    if not len(spans):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(spans["start"], kind="stable")
    start, end = spans["start"][order].astype(np.int64), np.maximum.accumulate(spans["end"][order].astype(np.int64))
    first = np.concatenate(([True], start[1:] > end[:-1]))
    last = np.concatenate((first[1:], [True]))
    return np.stack([start[first], end[last]], axis=1)


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
_RESULT_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())


def _cut(batches: Iterator[pa.RecordBatch], as_text: bool = False) -> Iterator[pa.RecordBatch]:
    """Documents without their spans; ``as_text`` drops what is left of a parted character and gives text alone."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    spans, parts, bucket = np.zeros(0, _SPAN), [], None
    for batch in batches:
        rows, at_row = [], []
        for i, (b, kind, rid, doc_id, data) in enumerate(zip(*(batch.column(n).to_pylist() for n in _NAMES), strict=True)):
            if b != bucket:
                bucket, spans, parts = b, np.zeros(0, _SPAN), []
            if kind == _SPANS:
                parts.append(data)
                continue
            if parts:
                spans, parts = _unpacked(parts, _SPAN), []
                spans = spans[np.argsort(spans["rid"], kind="stable")]
            text = unpack(data)
            gone = merged(spans[np.searchsorted(spans["rid"], rid) : np.searchsorted(spans["rid"], rid, side="right")]).tolist()
            pieces, at = [], 0
            for start, end in gone:
                pieces.append(text[at:start])
                at = end
            at_row.append(i)
            kept = b"".join([*pieces, text[at:]])
            rows.append((kept.decode("utf-8", "ignore"),) if as_text else (doc_id, len(text), sum(e - s for s, e in gone), len(gone), kept))
        if rows and as_text:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), batch.column("rest").take(pa.array(at_row))], names=["new_text", "rest"])
        elif rows:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _RESULT_TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    press = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        packed = [press(t.as_buffer().to_pybytes()) for t in batch.column("text")]
        columns = {"rid": batch.column("rid"), "doc_id": batch.column("doc_id"), "n_bytes": pc.binary_length(batch.column("text")).cast(pa.int64()), "packed": pa.array(packed, pa.binary()), "rest": batch.column("rest")}
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _removed(docs: DataFrame, length: int, gram: int, max_group: int, doc_id: str, text: str, as_text: bool) -> DataFrame:
    """What ``_cut`` gives for each row; with ``as_text`` all columns but the text come along as ``rest``."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    others = [F.col(quoted(c)) for c in docs.columns if c != text and as_text] or [F.lit(None).cast("boolean").alias("none")]
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).cast("binary").alias("text"),
        F.struct(*others).alias("rest"),
    )
    rest = T.StructField("rest", rows.schema["rest"].dataType)
    typed = lambda kinds: T.StructType([*T._parse_datatype_string(kinds).fields, rest])
    # written once, so that row ids stay what they are when a task is run again
    packed = materialize(rows.mapInArrow(_pack, typed("rid long, doc_id long, n_bytes long, packed binary")), "repeats-texts")
    size = packed.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(BUCKETS * parts, -(-size // BUCKET_BYTES))
    parts = max(parts, min(buckets // BUCKETS, MAX_PARTS))

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind", "rid")

    texts = packed.drop("n_bytes").mapInArrow(lambda b: _text_rows(b, buckets), typed(_ROW))
    anchors = materialize(packed.select("rid", "packed").mapInArrow(lambda b: _anchor_rows(b, length, gram, buckets), _ROW), "repeats-anchors")
    # spans ride along with what else a step sends, so each step runs once
    settled = materialize(dealt(_spread(anchors, length, gram, buckets, max_group)).mapInArrow(lambda b: _settle(b, length, gram, buckets, max_group), _ROW), "repeats-settled")
    asked = dealt(settled.filter(F.col("kind") == _ASKS).union(texts.drop("rest")))
    contexts = asked.mapInArrow(lambda b: _answer(b, length, gram, buckets), _ROW)
    sorted_ = dealt(contexts).mapInArrow(lambda b: _sort_contexts(b, length, gram, buckets), _ROW)
    spans = settled.filter(F.col("kind") == _SPANS).union(sorted_).withColumn("rest", F.lit(None).cast(rest.dataType))
    return dealt(spans.union(texts)).mapInArrow(lambda b: _cut(b, as_text), typed("new_text string") if as_text else _RESULT)


def remove_repeats(
    docs: DataFrame, length: int = 200, gram: int = GRAM, max_group: int = MAX_GROUP, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of each row; ``kept``: the bytes that are left.

    ``gram`` is a power of two below ``length``.
    """
    return _removed(docs, length, gram, max_group, doc_id, text, False)


def cleaned(docs: DataFrame, length: int = 200, gram: int = GRAM, max_group: int = MAX_GROUP, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with what is left of each text, ``n_chars`` renewed if there is one.

    A cut may part the bytes of a character; its remains are dropped. A null text becomes empty.
    """
    whole = _removed(docs, length, gram, max_group, doc_id, text, True)
    fresh = {text: F.col("new_text"), "n_chars": F.length("new_text")}
    return whole.select(*[fresh[c].cast(docs.schema[c].dataType).alias(c) if c in fresh else F.col(f"rest.{quoted(c)}").alias(c) for c in docs.columns])


def _text_rows(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rid = batch.column("rid").to_numpy()
        bucket = ((rid.astype(np.uint64) * _C1) >> np.uint64(40)).astype(np.int64) % buckets
        kind = np.full(len(rid), _TEXT, np.int32)
        columns = [pa.array(bucket.astype(np.int32)), pa.array(kind), batch.column("rid"), batch.column("doc_id"), batch.column("packed"), batch.column("rest")]
        yield pa.RecordBatch.from_arrays(columns, names=[*_NAMES, "rest"])


def digest_columns(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

