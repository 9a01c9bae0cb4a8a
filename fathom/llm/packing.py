"""Items of varying length packed into containers of fixed capacity.

Harmonic packing groups lengths by how many fit into a container: class k holds the lengths in (capacity/(k+1), capacity/k], and k
of them fill a container, so containers can be numbered from ranks alone, without looking at any other item. Alone it leaves a good
part of each container empty (``harmonic``). ``plan`` therefore works on the same classes, but fills up what a class leaves open: from the
histogram of lengths - at most ``capacity`` numbers, whatever the corpus - it takes the longest length left, completes it with the
lengths that fill the container best, and repeats that pattern as often as the histogram allows. Every pattern uses up a length
but for a few items, so there are a few patterns a length at most. Documents then find their container from the rank among those of their length.

Ranks are counted within (length, hash of the key). A length has as many hashes as keep its groups at about ``per_group`` items, so one that a
third of all documents have, or the full containers of texts that are cut, are spread; the driver gets a count a group, a small
fraction of the items whatever their number.

Defined results: an item longer than the capacity is cut into full containers and a rest, which is packed like any item; items
of no length and null lengths take no space and are put into container 0; equal keys are told apart by nothing but their rank,
which any of them may get. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.session import cut_lineage


def harmonic_class(size: Column, capacity: int, classes: int) -> Column:
    """How many items of a size fit into a container; ``classes`` for all smaller ones."""
    return F.least(F.floor(F.lit(capacity) / size), F.lit(classes)).cast("int")


def _piece_sizes(size: str, capacity: int) -> Column:
    """Lengths of the pieces of an item: full containers and the rest; one piece of 0 if it has no length."""
    n = F.coalesce(F.col(size).cast("long"), F.lit(0))
    full = F.when(n > capacity, F.floor(n / capacity)).otherwise(0).cast("int")
    rest = n - full * capacity
    return F.concat(F.array_repeat(F.lit(capacity).cast("long"), full), F.when((rest > 0) | (n == 0), F.array(rest)).otherwise(F.array().cast("array<bigint>")))


def _salted(it: DataFrame, by: str, key: str, per_group: int) -> DataFrame:
    """``it`` with a salt: each value of ``by``, of which there are at most as many as the capacity, has one for every ``per_group`` items."""
    salts = {int(r[by]): -(-r["n"] // per_group) for r in it.groupBy(by).agg(F.count("*").alias("n")).collect()}
    table = F.lit([salts.get(v, 1) for v in range(max(salts, default=0) + 1)])
    return it.withColumn("salt", F.pmod(F.xxhash64(key, "piece"), F.get(table, F.col(by).cast("int"))).cast("int"))


def harmonic(items: DataFrame, key: str, size: str, capacity: int, classes: int = 32, per_group: int = 100_000) -> DataFrame:
    """(key, piece, size, class_no, container): plain harmonic packing of every item, or piece of an oversized one; the items below
    capacity/classes are packed by their class's largest size. Every worker fills its own containers. Items of no length (0 or null) take
    no space: class 0, all in container ``0``."""
    it = items.select(F.col(key), F.posexplode(_piece_sizes(size, capacity)).alias("piece", size))
    it = it.withColumn("class_no", F.when(F.col(size) == 0, 0).otherwise(harmonic_class(F.nullif(F.col(size), F.lit(0)), capacity, classes)))
    it = cut_lineage(it)
    none = it.where("class_no = 0").select(key, "piece", size, "class_no", F.lit("0").alias("container"))
    w = Window.partitionBy("class_no", "salt").orderBy(F.desc(size), key, "piece")
    at = F.floor((F.row_number().over(w) - 1) / F.col("class_no"))
    some = _salted(it.where("class_no > 0"), "class_no", key, per_group)
    return some.select(key, "piece", size, "class_no", F.concat_ws("-", "class_no", "salt", at.cast("long")).alias("container")).unionByName(none)


def _pair(some: np.ndarray, have: np.ndarray, r: int) -> int:
    """The larger of two available lengths that add up to r, the largest such; 0 if there are none."""
    half = (r + 1) // 2
    hits = np.flatnonzero(some[half:r] & some[r - half : 0 : -1]) if r > 1 else np.zeros(0, dtype=np.int64)
    for i in hits[::-1][:2].tolist():  # only two equal halves may need more than there are
        if 2 * (half + i) != r or have[half + i] > 1:
            return half + i
    return 0


def _complete(have: np.ndarray, rest: int) -> list[int]:
    """Lengths (of those with a count in ``have``) that fill ``rest`` best, few and long ones first."""
    out: list[int] = []
    left = have.copy()
    some = left > 0
    while rest > 0:
        if some[rest]:
            return [*out, rest]
        if b := _pair(some, left, rest):
            return [*out, b, rest - b]
        fits = np.flatnonzero(some[1:rest]) + 1
        if not len(fits):
            return out
        for a in fits[::-1].tolist():  # three that fill it exactly, the longest first
            if 3 * a < rest:
                break  # the longest of three is a third at least
            left[a] -= 1
            some[a] = left[a] > 0
            b = _pair(some, left, rest - a)
            left[a] += 1
            some[a] = True
            if b:
                return [*out, a, b, rest - a - b]
        a = int(fits[-1])
        left[a] -= 1
        some[a] = left[a] > 0
        out.append(a)
        rest -= a
    return out


def plan(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> how often in a container) and their numbers of containers, for ``counts[length]``."""
    have = counts.astype(np.int64).copy()
    out = []
    top = capacity
    while True:
        while top > 0 and not have[top]:
            top -= 1
        if top == 0:
            return out
        have[top] -= 1
        need: dict[int, int] = {top: 1}
        for s in _complete(have, capacity - top):
            need[s] = need.get(s, 0) + 1
        have[top] += 1
        times = int(min(have[s] // k for s, k in need.items()))
        for s, k in need.items():
            have[s] -= k * times
        out.append((need, times))


def pack(items: DataFrame, key: str, size: str, capacity: int = 2048, per_group: int = 1_000_000) -> DataFrame:
    """(key, piece, n_tokens, container_id): every item, or piece of an oversized one, in its container."""
    it = cut_lineage(items.select(F.col(key), F.posexplode(_piece_sizes(size, capacity)).alias("piece", "n_tokens")))
    none = it.where("n_tokens = 0").select(key, "piece", "n_tokens", F.lit(0).cast("long").alias("container_id"))
    it = _salted(it.where("n_tokens > 0"), "n_tokens", key, per_group)
    groups = it.groupBy("n_tokens", "salt").agg(F.count("*").alias("n")).toPandas()  # a row a length and a row for every per_group items
    counts = np.zeros(capacity + 1, dtype=np.int64)
    np.add.at(counts, groups["n_tokens"].to_numpy(dtype=np.int64), groups["n"].to_numpy(dtype=np.int64))
    offset: dict[int, np.ndarray] = {}
    for s, g in groups.groupby("n_tokens"):
        by = np.zeros(int(g["salt"].max()) + 1, dtype=np.int64)
        by[g["salt"].to_numpy()] = g["n"].to_numpy()
        offset[int(s)] = np.cumsum(by) - by
    # For each length the ranks at which its next pattern begins, that pattern's count of it and first container.
    segments: dict[int, list[tuple[int, int, int]]] = {}
    used = np.zeros(capacity + 1, dtype=np.int64)
    container = 0
    for need, times in plan(counts, capacity):
        for s, k in need.items():
            segments.setdefault(s, []).append((int(used[s]), k, container))
            used[s] += k * times
        container += times
    shared = items.sparkSession.sparkContext.broadcast((offset, {s: np.array(v, dtype=np.int64) for s, v in segments.items()}))

    def place(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offset, table = shared.value
        for r in rows:
            s, salt, rank = (r.column(i).to_numpy() for i in (2, 3, 4))
            out = np.zeros(len(s), dtype=np.int64)
            for v in np.unique(s):
                at = np.flatnonzero(s == v)
                t, mine = table[int(v)], rank[at] - 1 + offset[int(v)][salt[at]]
                g = np.searchsorted(t[:, 0], mine, side="right") - 1
                out[at] = t[g, 2] + (mine - t[g, 0]) // t[g, 1]
            yield pa.RecordBatch.from_arrays([r.column(0), r.column(1), r.column(2), pa.array(out)], names=[key, "piece", "n_tokens", "container_id"])

    w = Window.partitionBy("n_tokens", "salt").orderBy(key, "piece")
    kind = items.schema[key].dataType.simpleString()
    ranked = it.select(key, "piece", "n_tokens", "salt", F.row_number().over(w).alias("rank"))
    return ranked.mapInArrow(place, f"`{key}` {kind}, piece int, n_tokens long, container_id long").unionByName(none)
