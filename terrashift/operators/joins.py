"""Joins that plain equality doesn't give: nearest, as-of, interval, raster sample, and merges with a story.

Each becomes an equi-join on a cell or bucket with an exact residual condition, so no plan holds a
nested-loop join and AQE can split skewed cells.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrashift.functions.coerce import filled
from terrashift.functions.geo import cell_index, chord_to_metres
from terrashift.operators.blocks import BLOCK_ROWS, last_known
from terrashift.operators.picks import kept, number_rows

#: A key with more rows than this, and than 1 / MAX_HOT of all rows, is dealt to several tasks.
HOT_ROWS, MAX_HOT = 1_000, 10_000


def dealt_join(many: DataFrame, few: DataFrame, key: str, rows: str, row: str, written: bool = False) -> DataFrame:
    """Inner equi-join of ``many`` rows with the one row of ``few`` for their key, hot keys dealt to several tasks.

    ``rows``: a column of ``few``, how many rows of ``many`` have its key; ``row``: a column that tells
    those apart. Fewer than ``MAX_HOT`` keys can be hot, so their list is broadcast; their rows in
    ``few`` are repeated once for each part. ``few`` is read three times, so it is written first, unless
    it is ``written`` already.
    """
    if not written:
        few = kept(few, "few")
    total = few.agg(F.sum(rows)).first()[0] or 0
    most = max(HOT_ROWS, total // MAX_HOT)
    parts = lambda: F.ceil(F.col(rows) / most).cast("int")
    hot = few.filter(F.col(rows) > most).select(key, parts().alias("_parts"))
    left = many.join(F.broadcast(hot), key, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(row), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    right = few.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(parts(), F.lit(1)) - 1)))
    return left.join(right, [key, "_part"]).drop("_part")


#: Items of a leaf, children of a node, and items of a node that one task splits further.
LEAF, FAN_BITS, NODE_ROWS = 16, 4, 50_000


def _depth(n: int, leaf: int) -> int:
    """How often ``n`` items are split until no node has more than ``leaf``."""
    depth = 0
    while n > leaf:
        n, depth = -(-n >> FAN_BITS), depth + 1
    return depth


def _split_further(table: pa.Table, axes: int, depth: int) -> pa.Table:
    """``_node`` of the items of one node, ``depth`` levels deeper: each node is split along its widest axis into equal parts."""
    n = table.num_rows
    middle = np.stack([table.column(f"_m{i}").to_numpy() for i in range(axes)])
    node = table.column("_node").to_numpy().astype(np.int64)
    for _ in range(depth):
        order = np.argsort(node, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(node[order]) > 0)))
        size = np.diff(np.append(first, n))
        spread = np.stack([np.maximum.reduceat(m[order], first) - np.minimum.reduceat(m[order], first) for m in middle])
        axis = np.empty(n, np.int64)
        axis[order] = np.repeat(spread.argmax(axis=0), size)
        order = np.lexsort((*middle[::-1], middle[axis, np.arange(n)], node))
        rank = np.arange(n) - np.repeat(first, size)
        part = np.repeat(-(-size >> FAN_BITS), size)
        node[order] = (node[order] << FAN_BITS) + rank // part
    return table.set_column(table.column_names.index("_node"), "_node", pa.array(node))


def spatial_tree(items: DataFrame, low: list[str], high: list[str], by: list[str]) -> tuple[DataFrame, int]:
    """``items`` with ``_node``, the number of their leaf, and the depth of the tree; 16 digits of 4 bits at most.

    A node is split along its widest axis into 16 parts of equal numbers of items, until a leaf holds
    ``LEAF`` at most, wherever they lie and however close. Nodes of many items are split by ranks over
    ranges of all items, the others in one task each.
    """
    names = [f"_m{i}" for i in range(len(low))]
    held = items.withColumns({m: ((F.col(a) + F.col(b)) / 2).cast("double") for m, a, b in zip(names, low, high, strict=True)}).withColumn("_node", F.lit(0).cast("long"))
    key, depth = F.xxhash64(F.lit(1), *by, "_node"), 0
    limits = [pick(m).alias(f"_{name}{m}") for m in names for name, pick in (("a", F.min), ("z", F.max))]
    while True:
        largest = held.groupBy(*by, "_node").agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0
        if largest <= NODE_ROWS:
            break
        nodes = held.withColumn("_key", key).groupBy("_key").agg(F.count("*").alias("_n"), *limits)
        widest = F.greatest(*[F.struct((F.col(f"_z{m}") - F.col(f"_a{m}")).alias("s"), F.lit(-i).alias("i")) for i, m in enumerate(names)])["i"]
        met = dealt_join(held.withColumn("_key", key), nodes.withColumn("_axis", -widest).select("_key", "_n", "_axis"), "_key", "_n", "_m0")
        along = F.get(F.array(*names), F.col("_axis"))
        ranked = number_rows(met.withColumn("_along", along), [F.col("_key"), F.col("_along"), *map(F.col, names)], "_rank")
        first = ranked.groupBy("_key").agg(F.min("_rank").alias("_first"), F.count("*").alias("_rows"))
        placed = dealt_join(ranked, first, "_key", "_rows", "_rank")
        part = F.floor((F.col("_rank") - F.col("_first")) / F.ceil(F.col("_n") / (1 << FAN_BITS))).cast("long")
        held = placed.withColumn("_node", F.shiftleft("_node", FAN_BITS) + part).select(*held.columns)
        held, depth = kept(held, "tree"), depth + 1
    further = _depth(largest, LEAF)
    if further:
        axes = len(names)
        held = held.groupBy(*by, "_node").applyInArrow(lambda t: _split_further(t, axes, further), held.schema)
    return kept(held.drop(*names), "tree"), depth + further


def nearest_leaves(targets: DataFrame, items: DataFrame, at: list[str], low: list[str], high: list[str], by: list[str] | None = None, other: bool = False, label: str | None = None) -> DataFrame:
    """Targets and items (columns ``low``, ``high``: the corners of a box in the space of ``at``) that may be nearest to each other.

    Items are held in a tree, see :func:`spatial_tree`, each node with the box of what it covers. From
    the top each target keeps the nodes whose box starts no farther away than where the nearest box
    ends. So a target meets a few nodes of each level, a row each with all children in an array, and at
    last the items of a few leaves, wherever the items are. No two items may have the same box: bring
    those together first. With ``by`` only items of the same group meet; with ``other`` a target may be
    among the items itself, and the nearest other item is kept too. With ``label``, a column of targets,
    the nearest item with another one is kept too; an item has the least and greatest of its labels as
    ``_la`` and ``_lz``. Ties are kept.
    """
    by = by or []
    tree, depth = spatial_tree(items, low, high, by)
    box = [F.min(c).alias(f"l{i}") for i, c in enumerate(low)] + [F.max(c).alias(f"h{i}") for i, c in enumerate(high)]
    ends = lambda: [F.min("_la").alias("_la"), F.max("_lz").alias("_lz")] if label else []
    boxed = tree.groupBy(*by, "_node").agg(F.count("*").alias("n"), *box, *ends())
    levels = []  # from the leaves up: the children of each node
    for _ in range(depth):
        sides = [f"{side}{i}" for side in "lh" for i in range(len(at))]
        child = F.struct("_node", "n", *sides, *(["_la", "_lz"] if label else []))
        levels.append(boxed.groupBy(*by, F.shiftright("_node", FAN_BITS).alias("_at")).agg(F.collect_list(child).alias("_children")))
        boxed = boxed.groupBy(*by, F.shiftright("_node", FAN_BITS).alias("_node")).agg(F.sum("n").alias("n"), *[(F.min if s[0] == "l" else F.max)(s).alias(s) for s in sides], *ends())
    length = lambda parts: F.sqrt(reduce(lambda a, b: a + b, [p * p for p in parts]))

    def seen(c: Column) -> Column:
        gaps = [F.greatest(c[f"l{i}"] - F.col(a), F.lit(0.0), F.col(a) - c[f"h{i}"]) for i, a in enumerate(at)]
        reach = [F.greatest(F.abs(F.col(a) - c[f"l{i}"]), F.abs(F.col(a) - c[f"h{i}"])) for i, a in enumerate(at)]
        near, far = length(gaps), length(reach)
        # a node that holds the target alone says nothing about others
        sure = F.when((c["n"] > 1) | (near > 0), far).otherwise(F.lit(float("inf"))) if other else far
        if label:  # so does one whose items all have the target's label
            sure = F.when((c["_la"] != F.col(label)) | (c["_lz"] != F.col(label)), far).otherwise(F.lit(float("inf")))
        return F.struct(c["_node"].alias("node"), near.alias("near"), sure.alias("sure"))

    least = lambda bound: bound * (1 + 1e-9) + 1e-12
    held = targets.withColumn("_at", F.lit(0).cast("long"))
    for children in reversed(levels):
        met = held.join(children, [*by, "_at"]).withColumn("_seen", F.transform("_children", seen)).withColumn("_bound", F.array_min(F.transform("_seen", lambda c: c["sure"])))
        own = met.select(*targets.columns, "_bound", F.filter("_seen", lambda c: c["near"] <= least(F.col("_bound"))).alias("_seen"))
        one = own.groupBy(*targets.columns).agg(F.min("_bound").alias("_bound"), F.flatten(F.collect_list("_seen")).alias("_seen"))
        held = one.select(*targets.columns, F.explode(F.filter("_seen", lambda c: c["near"] <= least(F.col("_bound")))).alias("_c")).select(*targets.columns, F.col("_c.node").alias("_at"))
    return held.join(tree.withColumnRenamed("_node", "_at"), [*by, "_at"]).drop("_at")


def _on_sphere(df: DataFrame, lon: str, lat: str) -> DataFrame:
    lo, la = F.radians(lon), F.radians(lat)
    return df.withColumns({"_x": F.cos(la) * F.cos(lo), "_y": F.cos(la) * F.sin(lo), "_z": F.sin(la)})


def nearest_join(targets: DataFrame, support: DataFrame, target_id: str, support_id: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(target_id, support_id, distance_m): the nearest support of each target, the smallest id at equal distance.

    Points are placed on the unit sphere and found by :func:`nearest_leaves`, far or near; of supports
    in the same place only the smallest id is held, and targets in the same place are one search.
    """
    known = lambda df: df.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull())
    t = _on_sphere(known(targets).select(target_id, lon, lat).distinct(), lon, lat).select(target_id, "_x", "_y", "_z")
    place = ["_sx", "_sy", "_sz"]
    s = _on_sphere(known(support), lon, lat).select(F.col(support_id), *[F.col(c).alias(f"_s{c[1:]}") for c in ("_x", "_y", "_z")])
    s = s.groupBy(*place).agg(F.min(support_id).alias(support_id))
    at = ["_x", "_y", "_z"]
    pairs = nearest_leaves(t.select(*at).distinct(), s, at, place, place)
    gap = lambda c: (F.col(f"_{c}") - F.col(f"_s{c}")) * (F.col(f"_{c}") - F.col(f"_s{c}"))
    found = pairs.groupBy(*at).agg(F.min(F.struct(F.sqrt(gap("x") + gap("y") + gap("z")).alias("_d"), support_id)).alias("_b"))
    best = t.join(found, at).groupBy(target_id).agg(F.min("_b").alias("_b"))
    return best.select(target_id, F.col(f"_b.{support_id}").alias(support_id), chord_to_metres(F.col("_b._d")).alias("distance_m"))


def raster_sample(points: DataFrame, grid: DataFrame, xmin: float, ymax: float, dx: float, dy: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Each point with the cell of ``grid`` (row, col, ...) nearest to it; points outside drop out."""
    placed = points.withColumns({"col": cell_index(F.col(lon), F.lit(xmin), F.lit(dx)), "row": cell_index(F.lit(ymax), F.col(lat), F.lit(dy))})
    return placed.join(grid, ["row", "col"])


def from_log(value: Column, unit: Column) -> Column:
    """Linear value of one that may be stored as a natural logarithm."""
    return F.when(F.lower(unit).contains("ln"), F.exp(value)).otherwise(value)


def indicator_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join with ``_merge``: both, left_only or right_only."""
    marked = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), key, "full")
    which = F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "left_only").otherwise("right_only")
    return marked.withColumn("_merge", which).drop("_l", "_r")


def backfill_join(base: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """``base`` with the new columns of ``extra``; shared ones are filled where null or blank."""
    shared = [c for c in extra.columns if c in base.columns and c != key]
    renamed = extra.select(key, *[F.col(c).alias(f"_x_{c}") if c in shared else F.col(c) for c in extra.columns if c != key])
    joined = base.join(renamed, key, "left")
    kinds = dict(base.dtypes)
    own = lambda c: filled(F.col(c)) if kinds[c] == "string" else F.col(c)
    for c in shared:
        joined = joined.withColumn(c, F.coalesce(own(c), F.col(f"_x_{c}")))
    return joined.drop(*[f"_x_{c}" for c in shared])


def asof_join(targets: DataFrame, values: DataFrame, by: str, time: str, value: str, default: float | None = 0.0, rows: int = BLOCK_ROWS) -> DataFrame:
    """``targets`` with the last ``value`` at or before their time.

    Targets and values are one table in order of time. Where a key has more than ``rows`` of them it is
    many blocks, each of which begins with the last value of those before.
    """
    tagged = targets.withColumns({"_v": F.lit(None).cast("double"), "_target": F.lit(1)})
    source = values.select(by, time, F.col(value).cast("double").alias("_v")).withColumn("_target", F.lit(0))
    merged = last_known(tagged.unionByName(source, allowMissingColumns=True), [by], [F.col(time), F.col("_target")], F.col("_v"), "_last", rows=rows)
    last = F.coalesce("_last", F.lit(default)) if default is not None else F.col("_last")
    return merged.filter("_target = 1").withColumn(value, last).drop("_v", "_target", "_last")


def interval_join(grid: DataFrame, events: DataFrame, by: list[str], at: str, time: str, days: float, forward: bool = False) -> DataFrame:
    """Grid rows and the events in (t - days, t], or in [t, t + days) with ``forward``.

    Both sides are bucketed by the length of the interval; a grid row meets two buckets.
    """
    length = int(days * 86_400_000_000)
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / length).cast("long")
    other = 1 if forward else -1
    left = grid.withColumn("_b", F.explode(F.array(bucket(at), bucket(at) + other)))
    right = events.withColumn("_b", bucket(time))
    gap = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))
    inside = (gap >= 0) & (gap < length) if forward else (gap > -length) & (gap <= 0)
    return left.join(right, [*by, "_b"]).filter(inside).drop("_b")


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default: str = "") -> DataFrame:
    """``df`` with the value of a unique key in ``table``; ``default`` where there is none."""
    return df.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def first_of(df: DataFrame, key: str, tables: list[DataFrame], value: str) -> DataFrame:
    """Value of the first table that has the key."""
    for i, t in enumerate(tables):
        df = df.join(t.select(key, F.col(value).alias(f"_v{i}")), key, "left")
    names = [f"_v{i}" for i in range(len(tables))]
    return df.withColumn(value, F.coalesce(*names)).drop(*names)


def parameter_grid(df: DataFrame, **values: list[float]) -> DataFrame:
    """Every row with every combination of the given values."""
    for name, items in values.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in items])))
    return df
