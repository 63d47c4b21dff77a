"""Leader clustering on the similarity graph, and naming of clusters."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window as W, functions as F

from souklens.operators.similarity import TILE_ROWS, TILES_PER_SLOT, meet, packed_tiles, tile_counts, unit_rows, with_slots
from souklens.session import checkpointed

PREFIX = 1000  # undecided rows of a block that are scanned in one task; Spark keeps so many of a window in each task before the shuffle

# Words a suggested cluster name leaves out (fixed values).
NAME_STOPWORDS = [
    "de", "para", "com", "em", "o", "a", "os", "as", "um", "uma",
    "the", "and", "for", "with", "in", "is", "it", "to", "of",
]


def similar(left: np.ndarray, right: np.ndarray, threshold: float, digits: int = 6) -> np.ndarray:
    """Which left rows reach the threshold with which right rows; the cosine is rounded first, as in the join."""
    if not len(left) or not len(right):
        return np.zeros((len(left), len(right)), bool)
    return np.round(unit_rows(left) @ unit_rows(right).T, digits) >= threshold


def _places(ids: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Where ``some`` of the distinct ``ids`` stand."""
    order = np.argsort(ids, kind="stable")
    return order[np.searchsorted(ids, some, sorter=order)]


def _only_live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles cut down to the ids and vectors of their live rows, which are all that a round has to send."""
    for batch in batches:
        ids, mats = [], []
        for i in range(batch.num_rows):
            own = batch["ids"][i].values
            at = _places(own.to_numpy(zero_copy_only=False), batch["live"][i].values.field("id").to_numpy(zero_copy_only=False))
            ids.append(own.take(pa.array(at)))
            mats.append(np.frombuffer(batch["mat"][i].as_py(), dtype="<f4").reshape(len(own), -1)[at].tobytes())
        kept = {"ids": pa.array([x.to_pylist() for x in ids], batch.schema.field("ids").type), "mat": pa.array(mats, pa.binary())}
        yield pa.RecordBatch.from_arrays([kept.get(c, batch[c]) for c in batch.schema.names], names=batch.schema.names)


def _blockers(threshold: float):
    """Task function: for every undecided left row of a tile pair, whether it lies near a new leader, and its smallest undecided smaller neighbour."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sides = {}
                for s in ("l", "r"):
                    ids = batch[f"{s}_ids"][i].values.to_numpy(zero_copy_only=False)
                    live = batch[f"{s}_live"][i].values
                    at = _places(ids, live.field("id").to_numpy(zero_copy_only=False))
                    mat = np.frombuffer(batch[f"{s}_mat"][i].as_py(), dtype="<f4").reshape(len(ids), -1)
                    leads = live.field("leads").to_numpy(zero_copy_only=False).astype(bool)
                    sides[s] = ids, mat, at[~leads], at[leads]
                (lid, left, rows, _), (rid, right, open_, leaders) = sides["l"], sides["r"]
                if not len(rows):
                    continue
                near = similar(left[rows], right[leaders], threshold).any(axis=1)
                open_ = open_[np.argsort(rid[open_], kind="stable")]
                smaller = similar(left[rows], right[open_], threshold) & (rid[open_][None, :] < lid[rows][:, None])
                hit = smaller.any(axis=1)
                low = rid[open_][smaller.argmax(axis=1)] if len(open_) else lid[rows]
                said = near | hit
                yield pa.RecordBatch.from_arrays([pa.array(lid[rows][said]), pa.array(near[said]), pa.array(low[said], mask=~hit[said])], names=["id", "near", "low"])

    return run


def first_leaders(mat: np.ndarray, threshold: float) -> np.ndarray:
    """Places of the leaders among rows in the order of the scan."""
    leads = np.zeros(0, np.int64)
    for a in range(0, len(mat), 256):
        own = a + np.flatnonzero(~similar(mat[a: a + 256], mat[leads], threshold).any(axis=1))
        near = similar(mat[own], mat[own], threshold)
        taken = np.zeros(len(own), bool)
        for i in range(len(own)):
            if not taken[i]:
                taken[i + 1:] |= near[i, i + 1:]
        leads = np.concatenate([leads, own[~taken]])
    return leads


def _near_any(threshold: float):
    """Task function: the rows of a tile that lie near one of the leaders beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, mat, leads = batch["ids"][i].values, batch["mat"][i].as_py(), batch["leads_mat"][i].as_py()
                left = np.frombuffer(mat, dtype="<f4").reshape(len(ids), -1)
                near = similar(left, np.frombuffer(leads, dtype="<f4").reshape(-1, left.shape[1]), threshold).any(axis=1)
                yield pa.RecordBatch.from_arrays([ids.filter(pa.array(near))], names=["id"])

    return run


def _scanned(rows: DataFrame, tiles: DataFrame, undecided: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(block, tile, id) of the leaders among the PREFIX smallest undecided rows of every block, and of what is undecided after them."""
    at = undecided.schema
    rank = F.row_number().over(W.partitionBy("block").orderBy("id"))
    first = undecided.withColumn("rank", rank).where(F.col("rank") <= PREFIX)

    def scan(some: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values("rank")
        mat = np.stack(some["vec"].to_numpy()).astype("<f4")
        leads = first_leaders(mat, threshold)
        return some.iloc[leads][["block", "tile", "id"]].assign(vec=[mat[i].tobytes() for i in leads])

    led = checkpointed(first.join(rows.select("id", F.col("vec").cast("array<float>").alias("vec")), "id").groupBy("block").applyInPandas(
        scan, f"block string, tile int, id {at['id'].dataType.simpleString()}, vec binary"))
    # The leaders of a block are one buffer, which goes to each group of its tiles.
    groups = tile_counts(tiles).select("block", F.ceil(F.col("parts") / TILES_PER_SLOT).cast("int").alias("groups"))
    packs = led.groupBy("block").agg(F.array_join(F.transform(F.collect_list("vec"), F.hex), "").alias("m")).select("block", F.unhex("m").alias("leads_mat"))
    packs = packs.join(groups, "block").select("block", "leads_mat", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("_group"))
    live = undecided.groupBy("block", "tile").agg(F.collect_list(F.struct("id")).alias("live"))
    alive = tiles.select("block", "tile", "ids", "mat").join(live, ["block", "tile"])
    alive = alive.mapInArrow(_only_live, alive.schema).join(groups, "block").withColumn("_group", F.pmod("tile", "groups").cast("int"))
    near = alive.join(packs, ["block", "_group"]).select("ids", "mat", "leads_mat").mapInArrow(_near_any(threshold), f"id {at['id'].dataType.simpleString()}")
    settled = near.unionByName(led.select("id"))
    return led.drop("vec"), checkpointed(undecided.join(settled, "id", "left_anti").select("block", "tile", "id"))


def _single_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids, mat = batch["ids"][i].values, batch["mat"][i].as_py()
            width = len(mat) // max(1, len(ids))
            yield pa.RecordBatch.from_arrays([pa.array([batch["block"][i].as_py()] * len(ids), pa.string()), ids, pa.array([mat[a: a + width] for a in range(0, len(mat), width)], pa.binary())], names=["block", "id", "vec"])


def _full_tiles(tiles: DataFrame) -> DataFrame:
    """Tiles of few rows as tiles of TILE_ROWS, all of whose rows are live."""
    rows = checkpointed(tiles.select("block", "ids", "mat").mapInArrow(_single_rows, f"block string, id {tiles.schema['ids'].dataType.elementType.simpleString()}, vec binary"))
    counts = rows.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / TILE_ROWS).cast("int").alias("parts"))
    packed = rows.join(counts, "block").groupBy("block", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("tile")).agg(F.collect_list(F.struct("id", "vec")).alias("m"))
    mat = F.unhex(F.array_join(F.transform("m.vec", F.hex), ""))
    return packed.select("block", "tile", F.col("m.id").alias("ids"), mat.alias("mat"), F.transform("m.id", lambda x: F.struct(x.alias("id"))).alias("live"))


def _smallest_leader(threshold: float):
    """Task function: the smallest live right row near every left row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lid, rid = (batch[f"{s}_ids"][i].values.to_numpy(zero_copy_only=False) for s in ("l", "r"))
                left, right = (np.frombuffer(batch[f"{s}_mat"][i].as_py(), dtype="<f4").reshape(n, -1) for s, n in (("l", len(lid)), ("r", len(rid))))
                leaders = _places(rid, np.sort(batch["r_live"][i].values.field("id").to_numpy(zero_copy_only=False)))
                near = similar(left, right[leaders], threshold)
                hit = near.any(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(lid[hit]), pa.array(rid[leaders][near[hit].argmax(axis=1)])], names=["id", "leader_id"])

    return run


def leader_clusters(df: DataFrame, threshold: float = 0.70, *, ident: str = "id", vec: str = "embedding",
                    block: str | None = None) -> DataFrame:
    """(id, leader_id, size) for clusters of two or more.

    Scanning by id, an unassigned row leads a cluster and takes every later unassigned row at or above
    the threshold. The leaders are the lexicographically first maximal independent set of the
    similarity graph. At first the smallest undecided rows of each block are scanned as they stand, and what lies near their leaders is settled;
    where rows have many neighbours few leaders settle nearly all, and rows meet leaders only. When that leaves more than half undecided, all
    the others are judged in rounds: a row with no smaller undecided neighbour leads, and whatever lies near a leader is settled. Equal vectors are collapsed to their first row and packed into tiles, which are written once; beside them each
    round carries the ids that are still undecided or have just become leaders, and only those rows are sent and meet. One pass of a round
    asks both questions, a row's smallest undecided neighbour being enough for the first, so the pairs inside a dense group are
    never written out. Rounds go on until no row is undecided; each settles at least the smallest undecided row of every connected group.
    """
    key = [block] if block else []
    usable = df.where(F.col(vec).isNotNull()).select(F.col(ident).alias("id"), F.col(vec).alias("vec"), *key)
    rows = checkpointed(usable.groupBy("vec", *key).agg(F.min("id").alias("id")))
    kind = rows.schema["id"].dataType.simpleString()
    tiles = checkpointed(with_slots(packed_tiles(rows, vec="vec", block=block).drop("grps")))
    undecided = checkpointed(tiles.select("block", "tile", F.explode("ids").alias("id")))
    found: list[DataFrame] = []
    left = undecided.count()
    scanning = left > 0 and rows.groupBy("id").agg(F.count("*").alias("n")).where("id is null or n > 1").isEmpty()  # a scan needs an order of its rows
    while scanning and left:
        before = left
        led, undecided = _scanned(rows, tiles, undecided, threshold)
        found.append(led.withColumns({"leads": F.lit(True), "low": F.lit(None).cast(kind)}))
        left = undecided.count()
        scanning = left <= before / 2
    now = undecided.withColumns({"leads": F.lit(False), "low": F.lit(None).cast(kind)})
    if not found and not left:
        found.append(now)
    while left:
        # A row whose smallest undecided neighbour has become a leader lies near it.
        new = now.where("leads")
        live = now.join(new.select(F.col("id").alias("low")), "low", "left_anti").groupBy("block", "tile").agg(F.collect_list(F.struct("id", "leads")).alias("live"))
        alive = tiles.join(live, ["block", "tile"])
        alive = alive.mapInArrow(_only_live, alive.schema)
        said = meet(alive, alive).drop("block", "tile").mapInArrow(_blockers(threshold), f"id {kind}, near boolean, low {kind}")
        told = said.groupBy("id").agg(F.max("near").alias("near"), F.min("low").alias("low"))
        undecided = live.select("block", "tile", F.explode("live").alias("r")).where("not r.leads").select("block", "tile", "r.id")
        open_ = Observation()
        judged = undecided.join(told, "id", "left").where(~F.coalesce("near", F.lit(False))).select("block", "tile", "id", F.col("low").isNull().alias("leads"), "low")
        now = checkpointed(judged.observe(open_, F.count_if(~F.col("leads")).alias("n")))
        left = open_.get["n"]
        found.append(now.where("leads"))
    leads = reduce(DataFrame.unionByName, found).groupBy("block", "tile").agg(F.collect_list(F.struct("id", "leads")).alias("live"))
    led = tiles.join(leads, ["block", "tile"])
    led = checkpointed(_full_tiles(led.mapInArrow(_only_live, led.schema)))
    near = meet(tiles.drop("slots"), led, tile_counts(tiles), tile_counts(led)).drop("block", "tile").mapInArrow(
        _smallest_leader(threshold), f"id {kind}, leader_id {kind}")
    heads = near.groupBy("id").agg(F.min("leader_id").alias("leader_id"))
    reps = rows.withColumnRenamed("id", "rep").join(heads.withColumnRenamed("id", "rep"), "rep").drop("rep")
    members = usable.join(reps, ["vec", *key]).select("id", "leader_id")
    sizes = members.groupBy("leader_id").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= 2)
    return members.join(sizes, "leader_id").select("id", "leader_id", "size")


def name_clusters(clusters: DataFrame, products: DataFrame) -> DataFrame:
    """Suggested name (three most frequent words, earliest first on ties), categories and size per cluster.

    Word order follows member id and position. Counts per (cluster, word) combine map-side; only a cluster's
    three best words are gathered.
    """
    m = clusters.join(products.select("id", "title", "category_l1", "category_l2", "category_l3"), "id")
    path = F.concat_ws("/", *[F.coalesce(F.col(f"category_l{i}"), F.lit("None")) for i in (1, 2, 3)])
    cats = m.select("leader_id", path.alias("path")).distinct().groupBy("leader_id").agg(
        F.array_join(F.array_sort(F.collect_list("path")), ", ").alias("categories"))
    words = m.select("leader_id", "id", F.posexplode(F.split(F.lower("title"), r"\s+")).alias("pos", "word"))
    words = words.where((F.length("word") > 2) & ~F.col("word").isin(NAME_STOPWORDS))
    freq = words.groupBy("leader_id", "word").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "pos")).alias("first"))
    rank = F.row_number().over(W.partitionBy("leader_id").orderBy(F.desc("n"), F.asc("first")))
    top = freq.withColumn("rn", rank).where(F.col("rn") <= 3)
    names = top.groupBy("leader_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "word"))), lambda x: x["word"]), " ").alias("suggested_name"))
    sizes = clusters.select("leader_id", "size").distinct()
    return sizes.join(names, "leader_id", "left").join(cats, "leader_id").select(
        "leader_id", "size", F.coalesce("suggested_name", F.lit("")).alias("suggested_name"), "categories")
