"""Periodic runs, centroid clustering and source mixing against brute force, with their edge cases."""

import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from terrashift.llm import clusters, mixing, runs  # noqa: E402



def clash():
    """Extra columns with names that the operators use themselves."""
    named = {"runs": "x", "collapsed": 1, "size": "s", "key": 2.0, "ints": 3, "cluster": "c", "row": "r", "origin": 4, "a.b": 1}
    return {n: F.lit(v) for n, v in named.items()}



# 11: runs


def brute_runs(w, least, exponent):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = max(i + 1, j)
    return sorted((s, n, q) for (s, n), q in found.items())


def words(rng):
    w = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.choice([0, 1, 3, 20, 60]))]
    if w and rng.random() < 0.6:
        p = rng.randint(1, len(w))
        w = w[:p] * rng.randint(1, 5) + w[: rng.randint(0, 3)]
    return w


def expected(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = brute_runs(w, 24, 3)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    gone = {i for s, n_, q in found for i in range(s + q, s + n_)}
    lines = "".join(f"{s},{n_},{q}\n" for s, n_, q in sorted(found, key=lambda r: (r[0], r[2])))
    return (
        len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(lines.encode()).hexdigest(),
        hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest(),
    )


def test_runs_are_those_of_brute_force(monkeypatch):
    monkeypatch.setattr(runs, "BLOCK", 4)
    rng = random.Random(5)
    for _ in range(150):
        texts = [[x.encode() for x in words(rng)] for _ in range(rng.randint(1, 5))]
        for least, exponent in ((1, 2), (6, 3)):
            got = runs._of_batch(list(range(len(texts))), texts, least, exponent).column("runs").to_pylist()
            assert [[tuple(x.values()) for x in y] for y in got] == [sorted(brute_runs(t, least, exponent), key=lambda r: (r[0], r[2])) for t in texts], texts


def test_suffix_arrays_and_common_prefixes():
    rng = np.random.default_rng(3)
    text = np.append(rng.integers(0, 2, 300), -1)
    order, inverse, common = runs.suffix_array(text)
    lists = [text[i:].tolist() for i in range(len(text))]
    assert [lists[i] for i in order] == sorted(lists) and (order[inverse] == np.arange(len(text))).all()
    same = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert common[1:].tolist() == [same(lists[a], lists[b]) for a, b in zip(order, order[1:], strict=False)]
    a, b = rng.integers(0, 301, (2, 2000))
    a, b = a[a != b], b[a != b]
    assert runs.Extensions(text).common_prefix(a, b).tolist() == [same(lists[x], lists[y]) for x, y in zip(a, b, strict=True)]


def test_collapsed_documents(spark, monkeypatch):
    monkeypatch.setattr(runs, "BATCH_WORDS", 500)
    rng = random.Random(6)
    texts = [None, "", " \n", "a", "é漢 " * 40, "\x1c\x85 " * 30, "a b " * 3000 + "c", "x" * 5000] + [rng.choice([" ", "\n\t "]).join(words(rng)) for _ in range(200)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(7, "a b " * 20), (7, "a b " * 20), (None, "b " * 30)], "doc_id long, text string").withColumns(clash()).repartition(3)
    stretched = table.withColumn("text", runs.stretched(table["doc_id"], table["text"]))
    got = sorted((tuple(r) for r in runs.digest_columns(runs.periodic_runs(stretched)).collect()), key=lambda r: (r[0] is None, r))
    rows = [(i, *expected(i, _split(t or ""))) for i, t in enumerate(texts)]
    rows += [(7, *expected(7, ["a", "b"] * 20))] * 2
    want = sorted(rows, key=lambda r: (r[0] is None, r))
    assert got[:-1] == want and got[-1][:2] == (None, 1) and got[-1][2:5] == (0, 30, 1)
    nothing = runs.digest_columns(runs.periodic_runs(table.limit(0)))
    assert nothing.count() == 0 and nothing.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def _split(text):
    out = [""]
    for c in text:
        if c in " \t\n\x0b\x0c\r":
            out.append("")
        else:
            out[-1] += c
    return [w for w in out if w]


def test_a_long_text_of_one_word_is_fast():
    batch = runs._of_batch([1], [[b"a"] * 300_000], 24, 3)
    assert batch.column("runs").to_pylist() == [[{"start": 0, "length": 300_000, "period": 1}]] and batch.column("collapsed").to_pylist() == [b"a"]


# 12: clusters


def lloyd(rows, k, turns, seed):
    """Plain rounds over exact integers."""
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "z"), v) for i, v in kept)[:k]
    c = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(turns):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        c = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else m for j, m in enumerate(c)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], c


def vectors(n, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(9, 64))
    return [(i, (middles[rng.integers(9)] + spread * rng.normal(size=64)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize(("n", "k", "spread"), [(300, 40, 0.3), (200, 7, 0.0), (5, 40, 1.0), (150, 1, 1.0)])
def test_clusters_are_those_of_plain_rounds(spark, n, k, spread):
    odd = [(1000, None), (1001, [1.0] * 63), (1002, [None] + [0.0] * 63), (1003, [math.nan] * 64), (1004, [math.inf] * 64), (None, [0.5] * 64), (2, [0.25] * 64), (3, [-0.1] * 64), (3, [-0.1] * 64)]
    rows = vectors(n, n, spread) + odd
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns(clash()).repartition(3)
    got = clusters.with_inertia(*clusters.assign(table, k=k, rounds=5)).collect()
    want, c = lloyd([(i, None if v is None else [None if x is None else np.float32(x) for x in v]) for i, v in rows], k, 5, 2)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=key) == sorted(want, key=key)
    own = {j: sum(d for _, i, d in want if i == j) for j in range(len(c))}
    for r in got:
        assert (r.cluster_inertia, r.inertia) == (own[r.cluster], sum(own.values()))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[r.cluster])).encode()).hexdigest()
    assert clusters.with_inertia(*clusters.assign(table.limit(0))).count() == 0


def test_bounds_settle_most_vectors_and_never_differ_from_a_scan():
    rng = np.random.default_rng(1)
    x = rng.integers(-60, 60, (4000, 64)) + 400 * rng.integers(-1, 2, (4000, 1))
    c = x[:40].astype(np.int64)
    cluster, upper, lower = np.full(4000, -1, np.int32), np.full(4000, np.inf), np.zeros(4000)
    scanned = [clusters.reassign(x, cluster, upper, lower, c, clusters.half_gaps(c))]
    for _ in range(6):
        new = np.stack([x[cluster == j].sum(axis=0) // max(1, (cluster == j).sum()) if (cluster == j).any() else c[j] for j in range(40)])
        moved, other = clusters.drifts(c, new)
        c, upper, lower = new, upper + moved[cluster], np.maximum(lower - other[cluster], 0)
        scanned.append(clusters.reassign(x, cluster, upper, lower, c, clusters.half_gaps(c)))
        assert (cluster == clusters.squared_distances(x, c).argmin(axis=1)).all()
    assert scanned[0] == 4000 and scanned[-1] < 4000


def test_large_components_stay_exact(spark):
    big = 500_000.0
    rows = [(i, [big * (1 if (i >> j) & 1 else -1) for j in range(64)]) for i in range(16)] + [(99, [1e30] * 64)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = clusters.assign(table, k=3, rounds=2)[0].collect()
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == sorted(lloyd(rows[:-1], 3, 2, 2)[0])


# 13: mixing


def brute_targets(sizes):
    """Shares by weight, what is over the limit goes round again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full, total = {s for s in sizes if not sizes[s]}, sum(sizes.values())
    while True:
        rest, w = total - sum(3 * sizes[s] for s in full), sum(weight[s] for s in sizes if s not in full)
        over = {s for s in sizes if s not in full and Fraction(rest * weight[s], w) > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else rest * weight[s] / w for s in sizes}
        full |= over


def mixed_rows(seed, n=400):
    rng = random.Random(seed)
    sources = ["b", "a", "ü", "zz", "", None, "n", "s"]
    return [(i if rng.random() < 0.9 else rng.choice([7, None]), rng.choice(sources[: rng.randint(1, 8)]), rng.choice([None, "", " a\x1c b\n", "w " * rng.randint(0, 200)])) for i in range(n)]


def test_mixes_meet_their_targets(spark):
    for seed, n in ((1, 400), (2, 60), (3, 1)):
        rows = mixed_rows(seed, n)
        table = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns(clash())
        got = mixing.plan(table.repartition(5)).collect()
        again = mixing.plan(table.repartition(2)).collect()
        key = lambda r: tuple("" if x is None else str(x) for x in r)
        assert sorted(map(key, got)) == sorted(map(key, again))
        count = lambda t: len(_split(t or ""))
        assert sorted(map(key, [(r.doc_id, r.source, r.size) for r in got])) == sorted(map(key, [(i, s, count(t)) for i, s, t in rows]))
        sizes = {}
        for _, s, t in rows:
            sizes[s] = sizes.get(s, 0) + count(t)
        wanted = brute_targets(sizes)
        for s in sizes:
            own = [r for r in got if r.source == s]
            assert {(r.source_size, r.target) for r in own} == {(sizes[s], wanted[s])}
            assert sum(r.taken for r in own) == math.floor(wanted[s])
            assert all(r.taken == r.whole * r.size + r.part and 0 <= r.part <= r.size and r.taken <= 3 * r.size for r in own)
            # the partial epoch is a prefix in order of the keys, with one document cut at most
            last = sorted((r for r in own if r.size), key=lambda r: r.key)
            assert sum(0 < r.part < r.size for r in own) <= 1
            if len({r.key for r in last}) == len(last):
                assert [r.part > 0 for r in last] == sorted((r.part > 0 for r in last), reverse=True)
        shown = mixing.epochs(mixing.plan(table)).collect()
        assert sum(r.words for r in shown) == sum(r.taken for r in got)
    assert mixing.digest_columns(mixing.plan(table.limit(0))).count() == 0


def test_budgets_above_and_below_the_corpus(spark):
    table = spark.createDataFrame([(i, "abc"[i % 3], "w " * 10) for i in range(30)], "doc_id long, source string, text string")
    whole = {r.source: r.target for r in mixing.plan(table, budget=10_000).collect()}
    assert whole == {"a": 300.0, "b": 300.0, "c": 300.0}
    some = {r.source: r.target for r in mixing.plan(table, budget=80).collect()}
    assert some == {"a": 50.0, "b": 20.0, "c": 10.0}
