"""SimHash fingerprints, linked within a Hamming radius by vantage-point trees.

Two fingerprints that differ in at most r bits differ in at most r // 2 bits in one of their two halves. Each half therefore
gets a tree whose radius is r // 2, which prunes far better than one tree over all bits. The top of a tree is built from a
bounded sample and deals the distinct fingerprints to shards: every fingerprint is stored in its home shard and asks each
shard that its radius overlaps (triangle bound). Inside a shard the tree goes on in numpy until small blocks are compared
exactly over the whole fingerprint. A shard answers with a spanning forest of its links, never with all pairs, so a dense
group of n fingerprints gives at most n - 1 rows for each shard that sees it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from souklens.llm.common import batch_of, slices
from souklens.llm.components import components
from souklens.session import checkpointed

SAMPLE = 64  # fingerprints for each shard from which the top of a tree is built
DEPTH = 12  # levels of the top, at most; beyond them shards grow and the trees inside them go deeper
SHARD = 1 << 15  # distinct fingerprints for which a shard is meant
TASK_PAIRS = 1 << 34  # home x asking fingerprints of one task; shards beyond it are dealt to several tasks
LEAF = 256


def text_fingerprint(text: str | None, words: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of all word shingles; 0 without words."""
    tokens = (text or "").encode().lower().split()  # of bytes: A-Z only, and the six ASCII white-space characters
    if not tokens:
        return 0
    shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)))) if len(tokens) > words else [b" ".join(tokens)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), dtype="<u8")
    ones = np.zeros(64, np.int64)
    for part in np.array_split(hashes, len(hashes) // 65536 + 1):
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp): one row per input row. NULL, empty and blank texts have fingerprint 0."""
    out = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([text_fingerprint(t, words) for t in batch["text"].to_pylist()], dtype=np.uint64)
            yield batch_of(out, doc_id=batch["doc_id"], fp=pa.array(fps.view(np.int64)))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        work, "doc_id long, fp long")


# A tree is nested tuples (vantage point, threshold, near, far); a leaf of the top tree is its shard number.

def _half(fps: np.ndarray, half: int) -> np.ndarray:
    return (fps >> np.uint64(32 * half)).astype(np.uint32)


def _vantage(points: np.ndarray, rng: np.random.Generator) -> tuple[np.uint32, int, np.ndarray] | None:
    """Of a few candidate points the one with the widest spread of distances, its median distance, and all distances;
    None if no distance separates the points."""
    best = None
    for v in rng.choice(points, size=min(4, len(points)), replace=False):
        d = np.bitwise_count(points ^ v)
        m = int(np.median(d))
        m -= int(m == d.max())  # the far side must not be empty
        if m >= d.min() and (best is None or d.std() > best[2].std()):
            best = (v, m, d)
    return best


def top_tree(points: np.ndarray, depth: int, seed: int = 0):
    """A tree of at most ``depth`` levels over sampled half fingerprints, and its number of shards."""
    rng, shards = np.random.default_rng(seed), iter(range(1 << 30))

    def build(some: np.ndarray, level: int):
        cut = _vantage(some, rng) if level < depth and len(some) >= 8 else None
        if cut is None:
            return next(shards)
        v, m, d = cut
        return v, m, build(some[d <= m], level + 1), build(some[d > m], level + 1)

    return build(np.unique(points), 0), next(shards)


def route(tree, halves: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shard) of every shard that the ball around a row overlaps; radius 0 gives the home shard."""
    rows, found = np.arange(len(halves)), []
    stack = [(tree, rows)]
    while stack:
        node, some = stack.pop()
        if not len(some):
            continue
        if not isinstance(node, tuple):
            found.append((some, np.full(len(some), node)))
            continue
        v, m, near, far = node
        d = np.bitwise_count(halves[some] ^ v).astype(np.int64)
        stack += [(near, some[d - radius <= m]), (far, some[d + radius > m])]
    return (np.concatenate([r for r, _ in found]), np.concatenate([s for _, s in found])) if found else (rows, rows)


class Forest:
    """Union-find over the fingerprints of one task; ``label`` is each one's current root."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        pairs = np.unique(np.stack([self.label[i], self.label[j]], axis=1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        for a, b in pairs.tolist():
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if parent:
            old = np.fromiter(parent, np.int64, len(parent))
            to = np.array([root(x) for x in old.tolist()])
            order = np.argsort(old)
            at = np.minimum(np.searchsorted(old[order], self.label), len(old) - 1)
            hit = old[order][at] == self.label
            self.label[hit] = to[order][at[hit]]


def shard_links(stored: np.ndarray, asking: np.ndarray, half: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links between stored and asking fingerprints within ``bits`` differing bits."""
    every, back = np.unique(np.concatenate([stored, asking]), return_inverse=True)
    stored, asking = np.unique(back[: len(stored)]), np.unique(back[len(stored):])
    short, radius, rng, forest = _half(every, half), bits // 2, np.random.default_rng(1), Forest(len(every))

    def compare(s: np.ndarray, a: np.ndarray) -> None:
        for x in range(0, len(s), 2 * LEAF):
            for y in range(0, len(a), 2 * LEAF):
                p, q = s[x: x + 2 * LEAF], a[y: y + 2 * LEAF]
                label = forest.label[p[0]]
                if (forest.label[p] == label).all() and (forest.label[q] == label).all():
                    continue
                i, j = np.nonzero(np.bitwise_count(every[p][:, None] ^ every[q][None, :]) <= bits)
                fresh = forest.label[p[i]] != forest.label[q[j]]
                if fresh.any():
                    forest.link(p[i[fresh]], q[j[fresh]])

    stack = [(stored, asking)]
    while stack:
        s, a = stack.pop()
        if not len(s) or not len(a):
            continue
        cut = _vantage(short[s], rng) if len(s) > LEAF else None
        if cut is not None:
            v, m, d = cut
            e = np.bitwise_count(short[a] ^ v).astype(np.int64)
            near, far = a[e - radius <= m], a[e + radius > m]
            if len(near) + len(far) < 1.9 * len(a):  # else the bound prunes nothing any more
                stack += [(s[d <= m], near), (s[d > m], far)]
                continue
        compare(s, a)
    child = np.flatnonzero(forest.label != np.arange(len(every)))
    return every[child], every[forest.label[child]]


def links(fps: DataFrame, bits: int = 3, fp_col: str = "fp") -> DataFrame:
    """(a, b) long: a spanning forest of all pairs of distinct fingerprints within ``bits`` differing bits.

    NULL fingerprints take no part; an empty table gives no rows. The shards' number follows the count of distinct
    fingerprints; a shard whose rows were too many for one task (a dense group that no distance separates) is dealt to
    several, each of which gets all its stored fingerprints and a part of those asking.
    """
    spark = fps.sparkSession
    distinct = checkpointed(fps.select(F.col(fp_col).cast("long").alias("fp")).where("fp is not null").distinct())
    n = distinct.count()
    depth = min(DEPTH, int(np.ceil(np.log2(max(1, n / SHARD)))))
    sample = [r.fp for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE << depth).collect()] if depth else [0]
    points = np.array(sample, dtype=np.int64).view(np.uint64)
    trees = [top_tree(_half(points, h), depth, seed=h)[0] for h in (0, 1)]
    known = spark.sparkContext.broadcast(trees)  # at most 2 ** (DEPTH + 1) nodes each
    out = pa.schema([("half", pa.int32()), ("shard", pa.int64()), ("fp", pa.int64()), ("stored", pa.bool_())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch["fp"].to_numpy().view(np.uint64)
            for h, tree in enumerate(known.value):
                for stored, radius in ((True, 0), (False, bits // 2)):
                    row, shard = route(tree, _half(some, h), radius)
                    yield batch_of(out, half=np.full(len(row), h, np.int32), shard=shard.astype(np.int64),
                                   fp=some[row].view(np.int64), stored=np.full(len(row), stored))

    dealt = checkpointed(distinct.mapInArrow(deal, "half int, shard long, fp long, stored boolean"))
    load = dealt.groupBy("half", "shard").agg(F.count_if("stored").alias("s"), F.count_if(~F.col("stored")).alias("q"))
    parts = load.select("half", "shard", F.ceil(F.col("s") * F.col("q") / F.lit(float(TASK_PAIRS))).cast("int").alias("parts"))
    placed = dealt.join(F.broadcast(parts), ["half", "shard"])  # one row per shard, of which there are at most 2 ** (DEPTH + 1)
    own = F.array((F.pmod(F.xxhash64("fp"), F.greatest("parts", F.lit(1)))).cast("int"))
    placed = placed.select("half", "shard", "fp", "stored", F.explode(
        F.when(F.col("stored"), F.sequence(F.lit(0), F.greatest("parts", F.lit(1)) - 1)).otherwise(own)).alias("part"))

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        values = rows["fp"].to_numpy().view(np.uint64)
        is_stored = rows["stored"].to_numpy()
        a, b = shard_links(values[is_stored], values[~is_stored], int(key[0]), bits)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return placed.groupBy("half", "shard", "part").applyInPandas(solve, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): one row per input row; component_id is the smallest id reachable over links.

    Equal fingerprints are linked, also those of texts without words. Repeated rows get the same answer. A NULL id has a
    fingerprint and takes its component's id, and that is NULL only if no member has one. Columns other than the two named are not read.
    """
    fps = checkpointed(fingerprints(docs, id_col, text_col, words))
    smallest = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = checkpointed(components(links(fps, bits)).withColumnRenamed("node", "fp"))
    low = smallest.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    of_root = low.groupBy("root").agg(F.min("low").alias("component_id"))
    of_fp = low.join(of_root, "root").select("fp", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", "fp", "component_id")
