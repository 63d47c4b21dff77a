"""Approximate nearest neighbours: an NN-descent graph built by Spark joins, and greedy search on it.

Equal vectors are one node. The graph starts from buckets of random hyperplanes and of hashes, dealt into small groups. A round
of NN-descent brings to every node its neighbours and a bounded number of nodes that have it as a neighbour (one join for the lists, one for the
vectors), compares those that are new to each other, and tells each what it found; the K nearest stay. Rounds are written
tables and end when few lists change. Building uses vectors less their median, in single precision and scaled by their median distance from it,
so neither an outlier nor a common offset takes the differences of the others; answers use the original ones.

Search is a join per round for all queries at once: each query expands its best open candidates through the graph, measures their
neighbours, and keeps its best ``beam``. It ends when no query has an open candidate. No vector table is broadcast or collected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from souklens.llm.common import batch_of
from souklens.session import checkpointed

NEIGHBOURS = 24
REVERSE = 24  # nodes that name a node, taken into its round, at most; a sample by hash
TOLD = 6  # new candidates that one round at one node tells to each member, at most
GROUP = 96  # nodes of a starting group, about
ROUNDS = 8
BEAM, EXPAND = 400, 64
SAMPLE = 256  # vectors of each width from which the middle and the scale are taken
FARTHEST = 1e15  # in that scale; what lies beyond is put there while the graph is built


def _good(vector: str) -> Column:
    return F.expr(f"size({vector}) > 0 and forall({vector}, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists({vector}, x -> x <> 0)")


def distance(a: str, b: str) -> Column:
    """Euclidean distance in double precision of two arrays of doubles."""
    return F.expr(f"sqrt(aggregate(zip_with({a}, {b}, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))")


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vec, node) of the rows that take part; node is a hash of the vector, which names equal vectors alike."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec"))
    rows = rows.where(F.col("vec_id").isNotNull() & _good("vec")).select("vec_id", F.transform("vec", lambda x: x + F.lit(0.0)).alias("vec"))  # one zero
    return rows.withColumn("node", F.xxhash64("vec"))


def nodes_of(rows: DataFrame, most_ids: int) -> tuple[DataFrame, DataFrame]:
    """(node, vec) of the distinct vectors of ``usable`` rows, and (node, vec_id) of their ``most_ids`` smallest ids."""
    ids = rows.select("node", "vec_id").distinct().withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(F.col("r") <= most_ids)
    return checkpointed(rows.groupBy("node").agg(F.first("vec").alias("vec"))), checkpointed(ids.select("node", "vec_id"))


_LISTS = pa.schema([("node", pa.int64()), ("id", pa.int64()), ("dist", pa.float32())])


def _told(members: pa.ListArray, each: int) -> Iterator[pa.RecordBatch]:
    """For every list of members (id, fresh, worst, vec), which are of one width: the ``each`` nearest others of each member that are nearer
    than its worst neighbour and of which one side is fresh."""
    flat = members.flatten()
    vec = flat.field("vec").to_pylist()
    ids, fresh = flat.field("id").to_numpy(), flat.field("fresh").to_numpy(zero_copy_only=False)
    worst = flat.field("worst").to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.asarray(members.value_lengths()))
    out: list[tuple] = []
    for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()):
        if b - a < 2:
            continue
        x, own = np.frombuffer(b"".join(vec[a:b]), np.float32).reshape(b - a, -1).astype(np.float64), ids[a:b]
        sq = (x * x).sum(axis=1)
        d = np.maximum(sq[:, None] + sq[None, :] - 2 * (x @ x.T), 0)
        d[own[:, None] == own[None, :]] = np.inf
        d[~(fresh[a:b][:, None] | fresh[a:b][None, :])] = np.inf
        k = min(each, b - a - 1)
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        got = np.take_along_axis(d, near, axis=1)
        i, j = np.nonzero(got < worst[a:b][:, None])
        out.append((own[i], own[near[i, j]], got[i, j]))
    if out:
        yield batch_of(_LISTS, node=np.concatenate([o[0] for o in out]), id=np.concatenate([o[1] for o in out]), dist=np.concatenate([o[2] for o in out]).astype(np.float32))


def _compare(grouped: DataFrame, each: int) -> DataFrame:
    """grouped has ``members``; rows (node, id, dist)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                yield from _told(batch["members"].slice(at, 256), each)

    return grouped.select("members").mapInArrow(work, "node long, id long, dist float")


def _nearest(links: DataFrame, k: int) -> DataFrame:
    """(node, id, dist, fresh): each node's k nearest distinct ids; a link is fresh unless it was there before."""
    once = links.groupBy("node", "id").agg(F.min("dist").alias("dist"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("dist", "id"))
    return once.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def _middles(sized: DataFrame) -> dict[int, tuple[np.ndarray, float]]:
    """For each width the median of every component over a bounded sample, and the median distance from it: neither follows an outlier."""
    first = F.row_number().over(Window.partitionBy("w").orderBy(F.xxhash64("node"), "node"))
    sample: dict[int, list] = {}
    for r in sized.withColumn("r", first).where(F.col("r") <= SAMPLE).collect():
        sample.setdefault(r["w"], []).append(r["vec"])
    out = {}
    for w, some in sample.items():
        x = np.array(some)
        middle = np.median(x, axis=0)
        away = np.abs(x - middle)
        spread = float(np.median(away[away > 0])) if (away > 0).any() else 1.0
        out[w] = middle, spread if spread > 0 else 1.0
    return out


def build_graph(nodes: DataFrame, k: int = NEIGHBOURS, rounds: int = ROUNDS, seed: int = 7) -> DataFrame:
    """(node, id, dist) links of an NN-descent graph over (node, vec); an empty table or a single node gives none."""
    sized = nodes.select("node", "vec", F.size("vec").alias("w"))
    counts = {r["w"]: r["n"] for r in sized.groupBy("w").agg(F.count("*").alias("n")).collect()}
    n = sum(counts.values())
    known = nodes.sparkSession.sparkContext.broadcast(_middles(sized))
    bits = {w: max(0, math.ceil(math.log2(max(1, c / GROUP)))) for w, c in counts.items()}
    planes = {w: np.random.default_rng(seed).normal(size=(w, b)).astype(np.float32) for w, b in bits.items()}

    out = pa.schema([("node", pa.int64()), ("w", pa.int32()), ("vec", pa.binary()), ("bucket", pa.int64())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch["w"].to_numpy()
            for w in np.unique(widths).tolist():
                some = batch.filter(pa.array(widths == w))
                middle, spread = known.value[w]
                x = np.clip((np.asarray(some["vec"].flatten()).reshape(-1, w) - middle) / spread, -FARTHEST, FARTHEST).astype(np.float32)
                side = ((x @ planes[w] > 0).astype(np.int64) @ (1 << np.arange(bits[w], dtype=np.int64))) if bits[w] else np.zeros(len(x), np.int64)
                yield batch_of(out, node=some["node"], w=some["w"], vec=[v.tobytes() for v in x], bucket=side)

    packed = checkpointed(sized.mapInArrow(pack, "node long, w int, vec binary, bucket long"))
    member = F.struct(F.col("node").alias("id"), F.lit(True).alias("fresh"), F.lit(float("inf")).cast("float").alias("worst"), "vec").alias("m")
    # Every node is in a group of its bucket and in one drawn by hash, among nodes of its width.
    drawn = -1 - F.pmod(F.xxhash64("node", F.lit(seed + 1)), F.lit(max(1, n // (16 * GROUP))))  # many small buckets and no common one
    homes = packed.unionByName(packed.withColumn("bucket", drawn))
    full = homes.groupBy("w", "bucket").agg(F.ceil(F.count("*") / GROUP).alias("chunks"))
    dealt = homes.join(full, ["w", "bucket"]).select("w", "bucket", F.pmod(F.xxhash64("node", "bucket", F.lit(seed)), "chunks").alias("chunk"), member)
    groups = dealt.groupBy("w", "bucket", "chunk").agg(F.collect_list("m").alias("members"))
    graph = checkpointed(_nearest(_compare(groups, k).withColumn("fresh", F.lit(True)), k))
    for _ in range(rounds):
        turned = graph.select(F.col("id").alias("node"), F.col("node").alias("id"), "fresh")
        few = turned.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("fresh"), F.xxhash64("node", "id")))).where(F.col("r") <= REVERSE).drop("r")
        worst = graph.groupBy("node").agg(F.when(F.count("*") >= k, F.max("dist")).otherwise(F.lit(float("inf"))).cast("float").alias("worst"))
        known = packed.select("node", "vec").join(worst, "node", "left").select(F.col("node").alias("id"), F.coalesce("worst", F.lit(float("inf")).cast("float")).alias("worst"), "vec")
        lists = graph.select("node", "id", "fresh").unionByName(few).groupBy("node", "id").agg(F.max("fresh").alias("fresh"))
        members = lists.join(known, "id").groupBy("node").agg(F.collect_list(F.struct("id", "fresh", "worst", "vec")).alias("members"))
        found = _compare(members, TOLD).withColumn("fresh", F.lit(True))
        graph = checkpointed(_nearest(graph.withColumn("fresh", F.lit(False)).unionByName(found), k))
        if graph.where("fresh").count() < 0.02 * n * k:
            break
    return graph.select("node", "id", "dist")


def search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, beam: int = BEAM, expand: int = EXPAND) -> DataFrame:
    """(query, node, dist): each query's best ``beam`` nodes by greedy search; queries are (query, entry, vec), where entry is
    any node to start from (its own, for a query that is indexed)."""
    both = graph.select("node", "id").unionByName(graph.select(F.col("id").alias("node"), F.col("node").alias("id")))
    near = checkpointed(both.distinct().withColumnRenamed("id", "other"))
    asked = queries.select("query", F.col("vec").alias("q"))
    target = nodes.select(F.col("node").alias("id"), F.col("vec").alias("v"))

    def measured(pairs: DataFrame) -> DataFrame:
        return pairs.join(target, "id").join(asked, "query").select("query", "id", distance("q", "v").alias("dist"), F.lit(False).alias("done"))

    best = Window.partitionBy("query").orderBy("dist", "id")
    state = checkpointed(measured(queries.select("query", F.col("entry").alias("id")).distinct()))
    while True:
        open_ = state.where("not done").withColumn("r", F.row_number().over(best)).where(F.col("r") <= expand).select("query", "id")
        open_ = checkpointed(open_)
        if open_.isEmpty():
            return state.select("query", F.col("id").alias("node"), "dist")
        fresh = open_.join(near, F.col("id") == near["node"]).select("query", F.col("other").alias("id")).distinct()
        fresh = fresh.join(state.select("query", "id"), ["query", "id"], "left_anti")
        told = state.join(open_.withColumn("now", F.lit(True)), ["query", "id"], "left").select("query", "id", "dist", (F.col("done") | F.coalesce("now", F.lit(False))).alias("done"))
        state = checkpointed(told.unionByName(measured(fresh)).withColumn("r", F.row_number().over(best)).where(F.col("r") <= beam).drop("r"))


def nearest(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows of each row for which ``queries`` (over column vec_id) is true.

    Distances are Euclidean, in double precision on the original vectors; ties go to the smaller id. Vectors that are NULL, zero, or hold NULL or
    non-finite components take no part, nor do rows without an id. Vectors of different widths never meet. Rows that repeat an id and its vector count
    once; an id with several vectors asks with each of them and counts with its nearest. With fewer than k other rows all are
    returned; an empty table gives no rows. Other columns are not read.
    """
    rows = usable(vectors, id_col, vector_col)
    nodes, ids = nodes_of(rows, k + 1)
    graph = build_graph(nodes)
    asked = checkpointed(rows.where(queries).select(F.col("vec_id").alias("query_id"), F.col("node").alias("query")).distinct())
    found = search(nodes.join(asked.select(F.col("query").alias("node")).distinct(), "node").select(F.col("node").alias("query"), F.col("node").alias("entry"), "vec"), nodes, graph)
    pairs = found.join(ids, "node").join(asked, "query").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("dist").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
