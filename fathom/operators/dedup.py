"""Exact duplicates by normalised hash, near duplicates by character n-grams, fingerprints, and duplicates of slides and pages by words.

Near duplicates come by two ways: ``near_texts`` finds all pairs of a similarity, exactly; ``lsh_pairs`` finds most of them from bands of
MinHash signatures, as a search engine's filter would. Both compare sets of n-grams once, however many texts have them, and give membership
beside the pairs. Defined results: a null text has the n-grams of an empty one; texts of equal sets are near each other at every limit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.text import UNEVEN, char_shingles, content_hash, content_words, hash_normal, jaccard, once
from fathom.session import cut_lineage


def hashed(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("content_hash", content_hash(F.col(text)))


def exact_duplicates(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, content_hash, canonical, is_duplicate): the smallest key of a hash is canonical.

    The canonical keys are aggregated map-side and joined back, so a hash that a third of all rows share needs no window over them.
    """
    h = cut_lineage(df.select(F.col(key).alias("k"), content_hash(F.col(text)).alias("h")))  # texts are read once
    least = h.groupBy("h").agg(F.min("k").alias("canonical")).withColumnRenamed("h", "lh")
    return h.join(least.hint("merge"), h["h"] == least["lh"]).select(F.col("k").alias(key), F.col("h").alias("content_hash"), "canonical", (F.col("k") != F.col("canonical")).alias("is_duplicate"))


def unseen(new: DataFrame, text: str, existing: DataFrame) -> DataFrame:
    """Rows of ``new`` whose hash isn't among those of ``existing`` (content_hash)."""
    return hashed(new, text).join(existing.select("content_hash").where("content_hash is not null").distinct(), "content_hash", "left_anti")


def dedup_stats(marked: DataFrame) -> DataFrame:
    n, d = F.count("*"), F.count_if("is_duplicate")
    return marked.agg(n.alias("total"), (n - d).alias("unique"), d.alias("removed"), F.round(F.coalesce(F.try_divide(100.0 * d, n), F.lit(0.0)), 4).alias("removal_pct"))


PERMS = 128
WORDS = 16  # of a fingerprint, of eight hexadecimal digits each


@cache
def _permutations(perms: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of ``perms`` hash functions, the same on every machine."""
    r = np.random.default_rng(20_011)
    return r.integers(1, 1 << 63, perms, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, perms, dtype=np.uint64)


def minhash_arrays(hashes: np.ndarray, counts: np.ndarray, perms: int = PERMS) -> np.ndarray:
    """Signatures (sets x perms, 32 bits) of sets of 64-bit hashes given in a row; those of empty sets are all ones."""
    out = np.full((len(counts), perms), 0xFFFFFFFF, dtype=np.uint32)
    full = np.flatnonzero(counts)
    if len(full):
        first = (np.cumsum(counts) - counts)[full]
        factor, offset = _permutations(perms)
        for i in range(perms):
            out[full, i] = np.minimum.reduceat(((hashes * factor[i] + offset[i]) >> np.uint64(32)).astype(np.uint32), first)
    return out


def gram_sets(df: DataFrame, key: str, text: str, n: int = 3) -> DataFrame:
    """(k, s): the sorted distinct hashes of each text's character n-grams."""
    hashes = lambda g: F.array_sort(F.array_distinct(F.transform(g, lambda x: F.xxhash64(x))))
    return df.select(F.col(key).alias("k"), once(char_shingles(F.col(text), n), hashes).alias("s"))


def minhash(df: DataFrame, key: str, text: str, n: int = 3, perms: int = PERMS) -> DataFrame:
    """(key, signature array<bigint>, fingerprint): the least hash under each permutation, and the first ``WORDS`` of them in hexadecimal."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows:
            sets = r.column(1)
            sig = minhash_arrays(sets.flatten().to_numpy().view(np.uint64), sets.value_lengths().to_numpy().astype(np.int64), perms)
            at = pa.array(np.arange(len(sig) + 1, dtype=np.int32) * perms)
            prints = ["".join(f"{x:08x}" for x in row) for row in sig[:, :WORDS].tolist()]
            yield pa.RecordBatch.from_arrays([r.column(0), pa.ListArray.from_arrays(at, pa.array(sig.ravel().astype(np.int64))), pa.array(prints, pa.string())], names=[key, "signature", "fingerprint"])

    return gram_sets(df, key, text, n).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, signature array<bigint>, fingerprint string")


def signature_similarity(a: Column, b: Column) -> Column:
    """Share of equal places of two signatures: an estimate of the sets' Jaccard similarity."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def lsh_bands(limit: float, perms: int = PERMS) -> tuple[int, int]:
    """(bands, rows) with the least sum of false positives and false negatives, weighted alike, at a similarity limit."""
    x = (np.arange(1000) + 0.5) / 1000

    def wrong(b: int, r: int) -> float:
        hit = 1 - (1 - x**r) ** b
        return float(hit[x < limit].sum() + (1 - hit)[x >= limit].sum())

    return min(((b, r) for b in range(1, perms + 1) for r in range(1, perms // b + 1)), key=lambda br: (wrong(*br), br))


U = np.uint64
LOW52 = U((1 << 52) - 1)
DOCS, CHARS = 4000, 1_000_000  # of one pass in numpy; a text's number takes the upper 12 bits of a key
PAD = 0x1FFFFF  # no code point: fills texts shorter than a gram
BITS = 512  # of a set's parities
FILTER = 1 << 23  # bits of the filter of keys whose sets are compared, 1 MB
PROJECT_FROM = 0.9  # the limit from which sets meet by projections instead of prefixes


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


class Grams:
    """The sets of n-grams of a group of texts: sorted 52-bit hashes ``h`` with their text ``doc``, sizes ``n``, ``first`` of each, keys ``f`` of the sets
    (from values ``v`` of their grams)."""

    def __init__(self, texts: list[str], n: int) -> None:
        raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
        raw = [r if len(r) >= n else np.concatenate((r, np.full(n - len(r), PAD, dtype=np.uint32))) for r in raw]
        cp, doc = np.concatenate(raw).astype(U), np.repeat(np.arange(len(raw), dtype=U), [len(r) for r in raw])
        m = len(cp) - n + 1
        h = np.zeros(m, dtype=U)
        for i in range(0, n, 3):
            h = h * U(31)
            for j in range(i, min(n, i + 3)):
                h = h ^ (cp[j : j + m] << U(21 * (j - i)))
            h = _mix(h)
        key = np.sort(((doc[:m] << U(52)) | (h >> U(12)))[doc[:m] == doc[n - 1 :]])  # np.unique hashes, which takes many times as long
        key = key[np.r_[True, key[1:] != key[:-1]]]
        self.doc, self.h = (key >> U(52)).astype(np.int64), key & LOW52
        self.n = np.bincount(self.doc, minlength=len(texts)).astype(np.int64)
        self.first = np.cumsum(self.n) - self.n

    @cached_property
    def v(self) -> np.ndarray:
        return _mix(self.h + U(7))

    @cached_property
    def f(self) -> np.ndarray:
        x, y = np.add.reduceat(self.v, self.first), np.add.reduceat(_mix(self.h ^ U(0x5555)), self.first)
        return _mix(x * U(3) + _mix(y) + self.n.astype(U))

    def parities(self) -> np.ndarray:
        """``BITS`` parities of each set: no more of them differ than grams do."""
        bits = np.bincount(self.doc * BITS + (self.h % U(BITS)).astype(np.int64), minlength=len(self.n) * BITS) & 1
        return np.packbits(bits.astype(np.uint8).reshape(-1, BITS), axis=1)


def _groups(ids: pa.Array, texts: pa.Array, n: int) -> Iterator[tuple[pa.Array, Grams]]:
    ts, at, size = texts.to_pylist(), 0, 0
    for i, t in enumerate(ts):
        if i > at and (size + len(t) > CHARS or i - at == DOCS):
            yield ids.slice(at, i - at), Grams(ts[at:i], n)
            at, size = i, 0
        size += len(t)
    if at < len(ts):
        yield ids.slice(at), Grams(ts[at:], n)


def _normal(df: DataFrame, key: str, text: str) -> DataFrame:
    """(k, t), the text as ``char_shingles`` takes it."""
    return df.select(F.col(key).alias("k"), F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), UNEVEN, " ")).alias("t"))


def _merge(a: DataFrame, b: DataFrame, on: str | list[str]) -> DataFrame:
    """A join that sorts: the sizes that the planner assumes of arrays and of what comes from Python are far too small to broadcast by."""
    return a.join(b.hint("merge"), on)


def _sets(docs: DataFrame, n: int, among: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(k, rep) of every text, ``rep`` the smallest key of its set, (f, rep) and (f, n, sig) of the sets. No set of grams is kept: they take several
    times the room of their texts. ``among`` (k) has the keys of the texts that count, if not all do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            for ids, g in _groups(r.column(0), r.column(1), n):
                yield pa.RecordBatch.from_arrays([ids, pa.array(g.f.view(np.int64)), pa.array(g.n), pa.array([x.tobytes() for x in g.parities()], pa.binary())], names=["k", "f", "n", "sig"])

    marks = cut_lineage(docs.mapInArrow(run, f"k {docs.schema['k'].dataType.simpleString()}, f bigint, n bigint, sig binary"))
    own = marks.select("k", "f")
    own = own if among is None else own.join(among.hint("merge"), "k", "left_semi")
    reps = cut_lineage(own.groupBy("f").agg(F.min("k").alias("rep")))
    return cut_lineage(_merge(own, reps, "f").select("k", "rep")), reps, marks.groupBy("f").agg(F.first("n").alias("n"), F.first("sig").alias("sig"))


def _entries(docs: DataFrame, n: int, parts: int, keys: Callable[[Grams], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(part, h, f) with arrays of equal length in the last two: the ``keys`` (text, key) of every set, once a task. Of a key its part and 32 further
    bits travel: where those of two keys are equal, sets are compared that need not be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for r in batches:
            for _, g in _groups(r.column(0), r.column(1), n):
                fresh = np.zeros(len(g.f), dtype=bool)
                for i, f in enumerate(g.f.tolist()):
                    if f not in seen:
                        seen.add(f)
                        fresh[i] = True
                doc, h = keys(g)
                doc, h = doc[fresh[doc]], h[fresh[doc]]
                part = (h % U(parts)).astype(np.int64)
                o = np.argsort(part, kind="stable")
                doc, h, part = doc[o], (h[o] // U(parts)).astype(np.uint32), part[o]
                at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(part)])
                ends = np.append(at[1:], len(part))
                f = g.f[doc]
                rows = list(zip(at.tolist(), ends.tolist()))
                yield pa.RecordBatch.from_arrays([pa.array(part[at], pa.int32()), pa.array([h[i:j].tobytes() for i, j in rows], pa.binary()), pa.array([f[i:j].tobytes() for i, j in rows], pa.binary())], names=["part", "h", "f"])

    return docs.mapInArrow(run, "part int, h binary, f binary")


def _buckets(entries: DataFrame, parts: int) -> DataFrame:
    """(f, part, hs): of every set the keys that another set has, too. Most keys are of one set only and go no further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, hs, fs = 0, [], []
        for r in batches:
            part = r.column(0)[0].as_py() if r.num_rows else part
            hs += [np.frombuffer(x, dtype=np.uint32) for x in r.column(1).to_pylist()]
            fs += [np.frombuffer(x, dtype=U) for x in r.column(2).to_pylist()]
        if not hs:
            return
        h, f = np.concatenate(hs), np.concatenate(fs)
        o = np.lexsort((f, h))
        h, f = h[o], f[o]
        once_ = np.r_[True, (h[1:] != h[:-1]) | (f[1:] != f[:-1])]
        h, f = h[once_], f[once_]
        same = h[1:] == h[:-1]
        shared = np.r_[False, same] | np.r_[same, False]
        h, f = h[shared], f[shared]
        o = np.argsort(f, kind="stable")
        h, f = h[o], f[o]
        at = np.flatnonzero(np.r_[True, f[1:] != f[:-1]][: len(f)])
        ends = np.append(at[1:], len(f))
        yield pa.RecordBatch.from_arrays([pa.array(f[at].view(np.int64)), pa.array(np.full(len(at), part, dtype=np.int32)), pa.array([h[i:j].tobytes() for i, j in zip(at.tolist(), ends.tolist())], pa.binary())], names=["f", "part", "hs"])

    return entries.repartitionById(parts, "part").mapInArrow(run, "f bigint, part int, hs binary")


def compare(f: np.ndarray, n: np.ndarray, sig: np.ndarray, who: np.ndarray, key: np.ndarray, limit: float, most: int = 1 << 19) -> np.ndarray:
    """Pairs of sets that share a key and whose sizes and parities allow the similarity; ``who`` has the set of each key."""
    o = np.lexsort((n[who], key))
    who, key = who[o], key[o]
    bucket, size, wide = np.cumsum(np.r_[0, key[1:] != key[:-1]])[: len(key)], n[who], np.int64(1) << 32
    last = np.searchsorted(bucket * wide + size, bucket * wide + np.minimum(np.floor(size / limit + 1e-9).astype(np.int64), wide - 1), side="right")
    partners = last - np.arange(len(who)) - 1
    ends = np.cumsum(partners)
    found, at = [np.zeros((0, 2), dtype=np.int64)], 0
    while at < len(who):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        k = partners[at:to]
        i = np.repeat(np.arange(at, to), k)
        a, b = who[i], who[i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)]
        apart = np.zeros(len(a), dtype=np.int64)
        for w in range(sig.shape[1]):
            apart += np.bitwise_count(sig[a, w] ^ sig[b, w])
        near = apart <= (n[a] + n[b]) * (1 - limit) / (1 + limit) + 1e-9
        found.append(np.unique(np.sort(np.stack((f[a[near]], f[b[near]]), 1), axis=1), axis=0))
        if sum(map(len, found[1:])) > 2 * len(found[0]) + (1 << 20):
            found[:] = [np.unique(np.concatenate(found), axis=0)]
        at = to
    return np.unique(np.concatenate(found), axis=0)


def _pairs(docs: DataFrame, n: int, limit: float, reps: DataFrame, sizes: DataFrame, parts: int, keys: Callable[[Grams], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(a, b, similarity) of the sets that share one of their ``keys`` and are as similar as ``limit``."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, size, sig, hs = [], [], [], []
        for r in batches:
            f.append(r.column(1).to_numpy()), size.append(r.column(3).to_numpy())
            sig += r.column(4).to_pylist()
            hs += r.column(2).to_pylist()
        if hs:
            who = np.repeat(np.arange(len(hs)), [len(x) // 4 for x in hs])
            got = compare(np.concatenate(f), np.concatenate(size), np.frombuffer(b"".join(sig), dtype=U).reshape(len(sig), -1), who, np.frombuffer(b"".join(hs), dtype=np.uint32), limit)
            yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["fa", "fb"])

    met = _merge(_buckets(_entries(docs, n, parts, keys), parts), sizes, "f").select("part", "f", "hs", "n", "sig").repartitionById(parts, "part")
    cand = met.select("part", "f", "hs", "n", "sig").mapInArrow(meet, "fa bigint, fb bigint").distinct()
    cand = cut_lineage(_merge(_merge(cand, reps.toDF("fa", "a"), "fa"), reps.toDF("fb", "b"), "fb"))
    # The sets of these are made again. A filter of fixed size tells the texts to look at.
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER))
    wanted = cand.select(F.col("a").alias("k")).union(cand.select(F.col("b").alias("k"))).select(at("k").alias("x"))
    words = wanted.groupBy(F.shiftright("x", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("x").bitwiseAND(63).cast("int"))).alias("bits")).toArrow()
    table_ = np.zeros(FILTER // 64, dtype=np.int64)
    table_[words["w"].to_numpy()] = words["bits"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(table_.view(U))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            x = r.column(2).to_numpy()
            r = r.take(pa.array(np.flatnonzero((shared.value[x >> 6] >> (x & 63).astype(U)) & U(1))))
            done = 0
            for _, g in _groups(r.column(0), r.column(1), n):
                yield pa.RecordBatch.from_arrays([pa.array(g.f.view(np.int64)), r.column(1).slice(done, len(g.f))], names=["f", "t"])
                done += len(g.f)

    # Texts travel instead of their sets, which are several times as large.
    sets = docs.select("k", "t", at("k").alias("x")).mapInArrow(again, "f bigint, t string").groupBy("f").agg(F.first("t").alias("t"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(x: np.ndarray, y: np.ndarray) -> float:
            both = len(np.intersect1d(x, y, assume_unique=True))
            return both / (len(x) + len(y) - both)

        for r in batches:
            ends, at = np.cumsum(sum(pc.binary_length(c).to_numpy().astype(np.int64) for c in r.columns[2:])), 0
            while at < r.num_rows:
                most = (ends[at - 1] if at else 0) + 2 * CHARS
                to = max(at + 1, min(at + 256, int(np.searchsorted(ends, most, side="right"))))
                x, y = (c.slice(at, to - at).to_pylist() for c in r.columns[2:])
                ts = pa.array(list(dict.fromkeys([*x, *y])), pa.string())
                own = {t: s for ids, g in _groups(ts, ts, n) for t, s in zip(ids.to_pylist(), np.split(g.h, g.first[1:]))}
                like = np.array([one(own[p], own[q]) for p, q in zip(x, y)])
                keep = pa.array(np.flatnonzero(like >= limit - 1e-12) + at)
                yield pa.RecordBatch.from_arrays([r.column(0).take(keep), r.column(1).take(keep), pa.array(like[keep.to_numpy() - at])], names=["a", "b", "similarity"])
                at = to

    both = _merge(_merge(cand, sets.toDF("fa", "ta"), "fa"), sets.toDF("fb", "tb"), "fb").where("a <> b")
    key = docs.schema["k"].dataType.simpleString()
    # Not a function in a column: the planner would call that for the limit, in workers of its own, and again for what is left.
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "ta", "tb").mapInArrow(verify, f"a {key}, b {key}, similarity double")


def _parts(sizes: DataFrame, per_gram: float, per_set: float) -> int:
    """Partitions of about two million keys, and two a core at least. A set goes once to each part that has a key of it, so more would only be more disk."""
    got = sizes.agg(F.sum("n").alias("n"), F.count("*").alias("c")).first()
    return max(2 * sizes.sparkSession.sparkContext.defaultParallelism, int(((got["n"] or 0) * per_gram + got["c"] * per_set) / 2e6))


def lsh_pairs(df: DataFrame, key: str, text: str, limit: float = 0.92, n: int = 3) -> tuple[DataFrame, DataFrame]:
    """``members`` (k, rep) and ``pairs`` (a, b, similarity) of sets that share a band of their signatures and are as similar as ``limit``. Equal sets
    are one in a band's bucket."""
    docs = _normal(df, key, text)
    members, reps, sizes = _sets(docs, n)
    bands, rows = lsh_bands(limit)

    def keys(g: Grams) -> tuple[np.ndarray, np.ndarray]:
        sig = minhash_arrays(_mix(g.h), g.n, bands * rows).astype(U)
        h = np.zeros((len(sig), bands), dtype=U) + np.arange(1, bands + 1, dtype=U)
        for i in range(rows):
            h = (h ^ sig[:, i::rows]) * U(0x9E3779B97F4A7C15)
            h ^= h >> U(29)
        return np.repeat(np.arange(len(sig)), bands), _mix(h.ravel())

    return members, _pairs(docs, n, limit, reps, sizes, _parts(sizes, 0, bands), keys)


def fingerprint_similarity(a: Column, b: Column) -> Column:
    """Equal characters at equal places over the shorter length; null for blank ones."""
    n = F.least(F.length(a), F.length(b))
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda s, i: s + (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))).cast("int"))
    return F.when(n > 0, same / n)


def word_duplicates(pages: DataFrame, slides: DataFrame, on: list[str], text: str, limit: float = 0.85) -> DataFrame:
    """Pages with the word similarity to their slide; a page without a slide has similarity 0 and is unique. Only hashes of the distinct words
    meet in the join, with the columns of ``pages`` other than the text."""
    words = lambda: F.transform(content_words(F.coalesce(F.col(text), F.lit(""))), lambda w: F.xxhash64(w))
    s = slides.select(*on, words().alias("_slide"))
    p = pages.withColumn("_page", words()).drop(text)
    sim = F.when(F.col("_slide").isNull(), 0.0).otherwise(jaccard(F.col("_page"), F.col("_slide")))
    return p.join(s, on, "left").withColumn("similarity", sim).withColumn("is_duplicate", F.col("similarity") >= limit).drop("_slide", "_page")


@cache
def _classes() -> np.ndarray:
    """The least sizes of the classes of sets, each about 1.3 times that before."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * 1.3)))
    return np.array(out)


def projections(g: Grams, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) such that two sets of similarity ``limit`` share a key. Their difference has at most d = (1 - t) / (1 + t) of the sum of their sizes, so
    of more than d parts of all grams one has the same grams of both. The number of parts goes by the class of the smaller set; a set is in its
    own class and in those below that hold one it may be the larger partner of."""
    least = _classes()
    own = np.searchsorted(least, g.n, side="right") - 1
    docs, keys = [], []
    for back in range(len(least)):
        c = own - back
        most = least[np.maximum(c, 0) + 1] - 1  # grams of the smaller set
        m = np.where((c >= 0) & (most >= limit * g.n - 1e-9), np.floor(most * (1 - limit) / limit + 1e-9).astype(np.int64) + 1, 0)
        if not m.any():
            break
        base = np.cumsum(m) - m
        mine = m[g.doc] > 0
        doc, h = g.doc[mine], g.h[mine]
        x = np.zeros(m.sum(), dtype=U)
        np.add.at(x, base[doc] + (h % m[doc].astype(U)).astype(np.int64), g.v[mine])
        doc = np.repeat(np.arange(len(m)), m)
        docs.append(doc)
        keys.append(_mix(x + _mix((c[doc].astype(U) << U(40)) + (np.arange(len(x)) - base[doc]).astype(U) + U(1))))
    return np.concatenate(docs), np.concatenate(keys)


def near_texts(df: DataFrame, key: str, text: str, limit: float = 0.92, n: int = 3, most_sent: int = 4_000_000, among: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``members`` (k, rep) of every text, ``rep`` being the smallest key of those with the same n-grams, and ``pairs`` (a, b, similarity): all
    pairs of such sets of at least Jaccard similarity ``limit``. ``among`` (k) has the keys of the texts that count, if not all do.

    High limits go by ``projections``. For low ones, sets of similarity t share one of their first s - ceil(t s) + 1 hashes in any common order -
    here the rarest in the corpus first, broadcast while there are at most ``most_sent`` different n-grams; beyond, the hashes themselves are the
    order, which is as exact. Keys that one set alone has are dropped, then sizes and parities rule pairs out, and the sets decide.
    """
    docs = _normal(df, key, text)
    members, reps, sizes = _sets(docs, n, among)
    if limit >= PROJECT_FROM:
        return members, _pairs(docs, n, limit, reps, sizes, _parts(sizes, 1.5 * (1 - limit) / limit, 2), lambda g: projections(g, limit))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            for _, g in _groups(r.column(0), r.column(1), n):
                h, c = np.unique(g.h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["h", "c"])

    often = cut_lineage(docs.mapInArrow(count, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("df")))
    known = np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
    if often.count() <= most_sent:
        got = often.toArrow().sort_by("h")
        known = got["h"].to_numpy().view(U), got["df"].to_numpy()
    shared = df.sparkSession.sparkContext.broadcast(known)

    def prefixes(g: Grams) -> tuple[np.ndarray, np.ndarray]:
        hs, dfs = shared.value
        rank = dfs[np.searchsorted(hs, g.h)] if len(hs) else np.zeros(len(g.h), dtype=np.int64)
        o = np.lexsort((g.h, rank, g.doc))
        take = g.n - np.ceil(limit * g.n - 1e-9).astype(np.int64) + 1
        keep = np.arange(len(o)) - g.first[g.doc] < take[g.doc]  # doc is sorted
        return g.doc[keep], _mix(g.h[o][keep])

    return members, _pairs(docs, n, limit, reps, sizes, _parts(sizes, 1 - limit, 1), prefixes)


def two_stages(df: DataFrame, key: str, text: str, exact: bool = True, near: bool = True, limit: float = 0.92) -> DataFrame:
    """(key, stage, canonical): every text as 'unique', 'exact' duplicate or 'near' duplicate of what is left after that, with the smallest
    key it repeats. Either stage may be off; of repeated keys the first counts for all."""
    k = F.col(key).alias("k")
    marked = exact_duplicates(df, key, text).select(k, "canonical", "is_duplicate") if exact else df.select(k, F.col(key).alias("canonical"), F.lit(False).alias("is_duplicate"))
    if not near:
        return marked.select(F.col("k").alias(key), F.when(F.col("is_duplicate"), "exact").otherwise("unique").alias("stage"), "canonical")
    marked = cut_lineage(marked)
    members, pairs = near_texts(df, key, text, limit, among=marked.where("not is_duplicate").select("k").distinct())
    rep = members.where("k <> rep").select("k", F.col("rep").alias("c"))
    others = _merge(members, pairs.select(F.col("b").alias("rep"), F.col("a").alias("c")), "rep").select("k", "c")
    first = rep.union(others).groupBy("k").agg(F.min("c").alias("first"))
    stage = F.when(F.col("is_duplicate"), "exact").when(F.col("first").isNotNull(), "near").otherwise("unique")
    return marked.join(first.hint("merge"), "k", "left").select(F.col("k").alias(key), stage.alias("stage"), F.when(F.col("is_duplicate"), F.col("canonical")).otherwise(F.coalesce("first", "canonical")).alias("canonical"))


def stage_stats(stages: DataFrame) -> DataFrame:
    """(total, exact_removed, near_removed, kept, removal_pct) of ``two_stages``."""
    n, e, m = F.count("*"), F.count_if(F.col("stage") == "exact"), F.count_if(F.col("stage") == "near")
    return stages.agg(n.alias("total"), e.alias("exact_removed"), m.alias("near_removed"), (n - e - m).alias("kept"), F.round(F.coalesce(F.try_divide(100.0 * (e + m), n), F.lit(0.0)), 4).alias("removal_pct"))


__all__ = ["content_hash", "dedup_stats", "exact_duplicates", "fingerprint_similarity", "hash_normal", "hashed", "lsh_bands", "lsh_pairs", "minhash", "near_texts", "signature_similarity", "stage_stats", "two_stages", "unseen", "word_duplicates"]
