"""Exact vector joins as tile-by-tile matrix products.

Rows of a block are dealt by the hash of their id into tiles of bounded size (one Spark row holds the ids and
the vectors of a tile). Only tiles meet in a join; inside a task one matrix product scores a tile pair and only
pairs that satisfy the threshold, or a row's best k, leave it. Nothing is sampled. A block that holds a large share
of all rows is cut into as many tiles as its size asks for, and the tiles of both sides are spread over slots: a bounded number
of each meets under one key, and no more slots are made than the work needs, as every tile is sent to each slot of the other side. Vectors
of different widths never meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from souklens.functions.numbers import round_half_up
from souklens.operators.hashes import close_hashes, useful
from souklens.session import dealt

TILE_ROWS = 512
TILES_PER_SLOT = 16  # at least, and MOST_TILES or SLOT_BYTES at most: every tile is sent to each slot of the other side
MOST_TILES, SLOT_BYTES = 256, 1 << 25
SLOTS = 8  # of a side, before its slots get more than TILES_PER_SLOT tiles; they leave work for its square of tasks


def _vector_rows(df: DataFrame, ident: str, vec: str, block: str | None, differ: str | None) -> DataFrame:
    """Block, id, group and vector of every row that has a usable vector: not zero, no NULL or non-finite element. The width is
    part of the block, so vectors of different widths never meet."""
    key = F.concat_ws("|", F.size(vec).cast("string"), F.col(block).cast("string")) if block else F.size(vec).cast("string")
    key = F.when(F.col(block).isNotNull(), key) if block else key
    group = F.col(differ).cast("string") if differ else F.lit("")
    rows = df.select(
        key.alias("block"), F.col(ident).alias("id"), F.coalesce(group, F.lit("")).alias("grp"), F.col(vec).cast("array<float>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("block").isNotNull() & finite & F.exists("vec", lambda x: x != 0))


def _tile_counts(rows: DataFrame) -> DataFrame:
    """Number of tiles per block; one small row per block, counted map-side."""
    return rows.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / TILE_ROWS).cast("int").alias("parts"))


def _tiles(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Tiles with their ids, groups and one float32 buffer."""
    salted = rows.join(counts, "block").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    packed = salted.groupBy("block", "tile").agg(F.collect_list(F.struct("id", "grp", "vec")).alias("m"))
    schema = T.StructType([
        T.StructField("block", T.StringType()), T.StructField("tile", T.IntegerType()),
        T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)), T.StructField("grps", T.ArrayType(T.StringType())),
        T.StructField("mat", T.BinaryType()),
    ])
    return packed.select("block", "tile", "m.id", "m.grp", "m.vec").mapInArrow(_seal, schema)


def packed_tiles(df: DataFrame, *, ident: str = "id", vec: str = "embedding", block: str | None = None, group: str | None = None) -> DataFrame:
    """(block, tile, ids, grps, mat): the usable rows of ``df`` as tiles, to be written once and joined many times."""
    rows = _vector_rows(df, ident, vec, block, group)
    return _tiles(rows, _tile_counts(rows))


def tile_counts(tiles: DataFrame) -> DataFrame:
    """Tiles per block of a table of tiles."""
    return tiles.groupBy("block").agg(F.count(F.lit(1)).cast("int").alias("parts"))


def slot_count() -> Column:
    """Slots for ``parts`` tiles of a block, whose name begins with the width of its vectors."""
    width = F.greatest(F.split_part("block", F.lit("|"), F.lit(1)).cast("long"), F.lit(1))
    most = F.greatest(F.lit(TILES_PER_SLOT), F.least(F.lit(MOST_TILES), F.floor(SLOT_BYTES / (4 * TILE_ROWS * width))))
    return F.greatest(F.least(F.ceil(F.col("parts") / TILES_PER_SLOT), F.lit(SLOTS)), F.ceil(F.col("parts") / most)).cast("int")


def with_slots(tiles: DataFrame) -> DataFrame:
    """Tiles that know the number of slots of their block, for joins of a table of tiles with itself."""
    return tiles.join(tile_counts(tiles).select("block", slot_count().alias("slots")), "block")


def _sides(ltiles: DataFrame, rtiles: DataFrame, lcounts: DataFrame | None, rcounts: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Tiles of each side at a slot of their own and at every slot of the other side, their columns named l_ and r_; block and the left
    tile stay. Without counts both sides come from one table ``with_slots``."""
    if lcounts is None:
        ltiles, rtiles = (t.withColumns({"_ln": F.col("slots"), "_rn": F.col("slots")}).drop("slots") for t in (ltiles, rtiles))
    else:
        slots = lambda counts, name: counts.select("block", slot_count().alias(name))
        grid = slots(lcounts, "_ln").join(slots(rcounts, "_rn"), "block")
        ltiles, rtiles = ltiles.join(grid, "block"), rtiles.join(grid, "block")

    def side(tiles: DataFrame, s: str, o: str) -> DataFrame:
        own = F.pmod("tile", f"_{s}n").cast("int").alias(f"_{s}slot")
        every = F.explode(F.sequence(F.lit(0), F.col(f"_{o}n") - 1)).alias(f"_{o}slot")
        kept = ["tile"] if s == "l" else []
        return tiles.select("block", *kept, own, every, *[F.col(c).alias(f"{s}_{c}") for c in tiles.columns if c not in ("block", "tile", "_ln", "_rn")])

    return side(ltiles, "l", "r"), side(rtiles, "r", "l")


def meet(ltiles: DataFrame, rtiles: DataFrame, lcounts: DataFrame | None = None, rcounts: DataFrame | None = None) -> DataFrame:
    """Every left tile beside every right tile of its block, as ``_sides`` names them."""
    left, right = _sides(ltiles, rtiles, lcounts, rcounts)
    return left.join(right, ["block", "_lslot", "_rslot"]).drop("_lslot", "_rslot")


def _gathered(ltiles: DataFrame, rtiles: DataFrame, lcounts: DataFrame, rcounts: DataFrame) -> DataFrame:
    """The tiles that meet in a slot follow each other, the left ones first: a tile reaches the task once and not for every pair that it is in."""
    left, right = _sides(ltiles, rtiles, lcounts, rcounts)
    both = left.drop("tile").withColumn("_right", F.lit(False)).unionByName(right.withColumn("_right", F.lit(True)), allowMissingColumns=True)
    at = ["block", "_lslot", "_rslot"]
    return dealt(both, *at).sortWithinPartitions(*at, "_right")


def join_tiles(ltiles: DataFrame, rtiles: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """(left_id, right_id, similarity, rank): the ``k`` best right rows of every left row, of tables of tiles."""
    out = T.StructType([T.StructField("left_id", ltiles.schema["ids"].dataType.elementType), T.StructField("right_id", rtiles.schema["ids"].dataType.elementType),
                        T.StructField("similarity", T.DoubleType())])
    met = _gathered(ltiles, rtiles, tile_counts(ltiles), tile_counts(rtiles))
    pairs = met.mapInArrow(_score(threshold, k, False, False, False, True, False, 6), out)
    best = W.partitionBy("left_id").orderBy(F.desc("similarity"), F.asc("right_id"))
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _seal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the nested vectors of a tile by one buffer, which later joins move as it is."""
    for batch in batches:
        mats = [np.asarray(v.values.flatten().to_numpy(zero_copy_only=False), dtype="<f4").tobytes() for v in batch.column("vec")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("block"), batch.column("tile"), batch.column("id"), batch.column("grp"), pa.array(mats, pa.binary())],
            names=["block", "tile", "ids", "grps", "mat"],
        )


def unit_rows(mat: np.ndarray) -> np.ndarray:
    wide = mat.astype("f8")
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


class _Tile:
    """One side of a tile pair: ids, groups, float32 rows and their lengths, and of a left tile the k best similarities so far."""

    def __init__(self, batch: pa.RecordBatch, at: int, side: str, k: int | None = None):
        ids = batch.column(f"{side}_ids")[at].values
        self.ids = ids.to_numpy(zero_copy_only=False)
        self.grps = batch.column(f"{side}_grps")[at].values if f"{side}_grps" in batch.schema.names else None
        self.mat = np.frombuffer(batch.column(f"{side}_mat")[at].as_py(), dtype="<f4").reshape(len(ids), -1)
        self.length = np.linalg.norm(self.mat.astype("f8"), axis=1, keepdims=True)
        self.short = self.unit().astype("f4")
        self.top = None if k is None else np.full((len(ids), k), -np.inf)

    def unit(self, at=slice(None)) -> np.ndarray:
        return self.mat[at].astype("f8") / self.length[at]

    def groups(self) -> np.ndarray:
        return self.grps.to_numpy(zero_copy_only=False)


def _score(threshold, k, smallest, smaller_right, differ, skip_equal, ordered, digits, tiers=0):
    """Task function: one matrix product per tile pair, best pairs out. Rows are tiles as ``_gathered``, or pairs of tiles as ``meet`` gives them.

    Of a left tile the ``k`` best of each row so far are known, and only what reaches the worst of
    them is looked at: single precision says where, within its error, and the products of those pairs are made again in double.
    """
    least = -np.inf if threshold is None else threshold
    kept = None if smallest or tiers else k

    def pair(left: _Tile, right: _Tile) -> Iterator[pa.RecordBatch]:
        lid, rid, top = left.ids, right.ids, left.top
        if tiers or smallest or least == -np.inf and (top is None or (top[:, -1] == -np.inf).any()):
            sims = np.round(left.unit() @ right.unit().T, digits) + 0.0
            keep = sims >= least
        else:
            low = np.full(len(lid), least) if top is None else np.maximum(least, top[:, -1])
            slack = 10.0 ** -digits + 1e-6 + 2e-7 * left.mat.shape[1]
            sims, keep = None, left.short @ right.short.T >= (low - slack).astype("f4")[:, None]
        if sims is None:
            live = np.flatnonzero(keep.any(axis=1))
            li, ri = np.nonzero(keep[live])
            li = live[li]
            found = np.concatenate([np.round((left.unit(li[a: a + 65536]) * right.unit(ri[a: a + 65536])).sum(axis=1), digits) + 0.0 for a in range(0, len(li), 65536)] or [np.zeros(0)])
            fits = found >= low[li]
            if differ:
                fits &= (left.groups()[li] != right.groups()[ri]).astype(bool)
            if smaller_right:
                fits &= lid[li] > rid[ri]
            elif ordered:
                fits &= lid[li] < rid[ri]
            elif skip_equal:
                fits &= lid[li] != rid[ri]
            li, ri, found = li[fits], ri[fits], found[fits]
        else:
            if differ:
                keep &= left.groups()[:, None] != right.groups()[None, :]
            if smaller_right:
                keep &= lid[:, None] > rid[None, :]
            elif ordered:
                keep &= lid[:, None] < rid[None, :]
            elif skip_equal:
                keep &= lid[:, None] != rid[None, :]
            if tiers:
                yield from _tiered(lid, rid, sims, keep, left.grps.to_pylist(), right.grps.to_pylist(), tiers)
                return
            if smallest:
                by_id = np.argsort(rid, kind="stable")
                first = by_id[np.argmax(keep[:, by_id], axis=1)]
                hit = keep.any(axis=1)
                keep = np.zeros_like(keep)
                keep[np.nonzero(hit)[0], first[hit]] = True
            elif k is not None and k < len(rid):
                worst = np.partition(np.where(keep, sims, -np.inf), len(rid) - k, axis=1)[:, len(rid) - k]
                keep &= sims >= worst[:, None]
            li, ri = np.nonzero(keep)
            found = sims[li, ri]
        if top is not None and len(li):
            # Exactly k per row, the smaller id first among equals, so copies do not multiply.
            by_id = np.argsort(rid, kind="stable")
            place = np.empty(len(rid), np.int64)
            place[by_id] = np.arange(len(rid))
            order = np.lexsort((place[ri], -found, li))
            li, ri, found = li[order], ri[order], found[order]
            rank = np.arange(len(li)) - np.searchsorted(li, li)
            li, ri, found, rank = (x[rank < k] for x in (li, ri, found, rank))
            rows, which = np.unique(li, return_inverse=True)
            more = np.full((len(rows), top.shape[1]), -np.inf)
            more[which, rank] = found
            top[rows] = -np.sort(-np.hstack([top[rows], more]), axis=1)[:, :k]
        if len(li):
            yield pa.RecordBatch.from_arrays([pa.array(lid[li]), pa.array(rid[ri]), pa.array(found)], names=["left_id", "right_id", "similarity"])

    def gathered(batch: pa.RecordBatch, now, held: list[_Tile]) -> Iterator[pa.RecordBatch]:
        slots = list(zip(*[batch.column(c).to_pylist() for c in ("block", "_lslot", "_rslot")]))
        for i, (slot, is_right) in enumerate(zip(slots, batch.column("_right").to_pylist())):
            if slot != now[0]:
                now[0] = slot
                held.clear()
            if not is_right:
                held.append(_Tile(batch, i, "l", kept))
            elif held:
                right = _Tile(batch, i, "r")
                for left in held:
                    yield from pair(left, right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = [None], []
        for batch in batches:
            if "_right" in batch.schema.names:
                yield from gathered(batch, now, held)
                continue
            for i in range(batch.num_rows):
                if (this := (batch.column("l_ids")[i].as_py(), batch.column("l_mat")[i].as_py())) != now[0]:
                    now[0], held = this, [_Tile(batch, i, "l", kept)]
                yield from pair(held[0], _Tile(batch, i, "r"))

    return run


NO_KEY, NEXT_KEY = "\x02", "\x01"


def tier_keys(*keys: Column) -> Column:
    """Keys of a row, one per tier, as one text; a NULL key keeps the row out of that tier."""
    return F.concat_ws(NEXT_KEY, *[F.coalesce(k.cast("string"), F.lit(NO_KEY)) for k in keys])


def _tiered(lid, rid, sims, keep, lkeys, rkeys, tiers) -> Iterator[pa.RecordBatch]:
    """For every tier the best pair of each left row whose keys of that tier are equal."""
    by_id = np.argsort(rid, kind="stable")
    for tier in range(tiers):
        codes: dict[str, int] = {}
        lcode, rcode = (np.array([-1 if (t := g.split(NEXT_KEY)[tier]) == NO_KEY else codes.setdefault(t, len(codes)) for g in side]) for side in (lkeys, rkeys))
        masked = np.where(keep & (lcode[:, None] == rcode[None, :]) & (lcode >= 0)[:, None], sims, -np.inf)[:, by_id]
        best = masked.argmax(axis=1)
        value = masked[np.arange(len(lid)), best]
        hit = np.nonzero(value > -np.inf)[0]
        if len(hit):
            yield pa.RecordBatch.from_arrays(
                [pa.array(lid[hit]), pa.array(rid[by_id[best[hit]]]), pa.array(value[hit]), pa.array(np.full(len(hit), tier, np.int32))],
                names=["left_id", "right_id", "similarity", "tier_rank"])


def similarity_join(
    left: DataFrame, right: DataFrame, *, ident: str = "id", vec: str = "embedding",
    block: str | None = None, threshold: float | None = None, k: int | None = None,
    smallest: bool = False, smaller_right: bool = False, differ: str | None = None, skip_equal: bool = True, ordered: bool = False,
    digits: int = 6, tiers: tuple[str, int] | None = None,
) -> DataFrame:
    """(left_id, right_id, similarity) of pairs within a block.

    ``threshold`` keeps pairs at or above it; ``k`` keeps the k best right rows per left row, equal
    similarities going to the smaller right id; ``smallest`` keeps the smallest right id that reaches
    the threshold, so no task emits more than one row per left row. ``ordered`` asks for left id < right
    id, ``smaller_right`` for the reverse, ``differ`` that the two rows differ in a column. ``tiers`` names a column of
    ``tier_keys`` and their number, and asks for the best right row per left row and tier (tier_rank), all in one pass. The cosine is
    rounded to ``digits`` first, so ties are decided by id and not by noise.
    """
    if threshold is None and k is None:
        raise ValueError("give a threshold, k, or both")
    group = tiers[0] if tiers else differ
    lrows = _vector_rows(left, ident, vec, block, group)
    rrows = _vector_rows(right, ident, vec, block, group)
    lcounts, rcounts = _tile_counts(lrows), _tile_counts(rrows)

    meetings = _gathered(_tiles(lrows, lcounts), _tiles(rrows, rcounts), lcounts, rcounts)
    out = T.StructType([
        T.StructField("left_id", lrows.schema["id"].dataType),
        T.StructField("right_id", rrows.schema["id"].dataType),
        T.StructField("similarity", T.DoubleType()),
    ])
    if tiers:
        out = out.add("tier_rank", T.IntegerType())
        found = meetings.mapInArrow(_score(threshold, k, smallest, smaller_right, False, skip_equal, ordered, digits, tiers[1]), out)
        first = W.partitionBy("left_id", "tier_rank").orderBy(F.desc("similarity"), F.asc("right_id"))
        return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") == 1).drop("rank")
    pairs = meetings.mapInArrow(_score(threshold, k, smallest, smaller_right, differ is not None, skip_equal, ordered, digits), out)
    if smallest:
        return pairs.groupBy("left_id").agg(F.min("right_id").alias("right_id"))
    if k is None:
        return pairs
    best = W.partitionBy("left_id").orderBy(F.desc("similarity"), F.asc("right_id"))
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def knn(queries: DataFrame, base: DataFrame, k: int, *, other_platform: bool = False, block: str | None = None,
        threshold: float | None = None) -> DataFrame:
    """The k nearest rows of ``base`` for each query row, itself left out."""
    return similarity_join(
        queries, base, k=k, block=block, threshold=threshold, differ="platform" if other_platform else None
    )


def knn_with_fallback(df: DataFrame, k: int, *, category: str, minimum: int = 5, bonus: float = 0.05) -> DataFrame:
    """Nearest neighbours inside the row's category where that offers ``minimum`` candidates, else among all rows.

    Ranked by (similarity + bonus for the same category) * 0.7, as a percentage with one decimal.
    The bonus can lift a same-category row over a nearer one, so both kinds are fetched before ranking.
    """
    sizes = df.where(F.col(category).isNotNull()).groupBy(category).agg(F.count(F.lit(1)).alias("members"))
    sized = df.join(sizes, category, "left")
    enough = F.coalesce(F.col("members") - 1 >= minimum, F.lit(False))
    near = similarity_join(df, df, k=k, block=category)
    wide = similarity_join(sized.where(~enough), df, k=k)
    pairs = near.unionByName(wide).select("left_id", "right_id", "similarity").distinct()
    cats = df.select(F.col("id").alias("right_id"), F.col(category).alias("right_cat"))
    own = df.select(F.col("id").alias("left_id"), F.col(category).alias("left_cat"))
    joined = pairs.join(own, "left_id").join(cats, "right_id")
    same = F.coalesce(F.col("left_cat") == F.col("right_cat"), F.lit(False))
    score = (F.col("similarity") + F.when(same, bonus).otherwise(0.0)) * 0.7 * 100
    scored = joined.select(
        "left_id", "right_id", F.col("right_cat").alias("category"), round_half_up("similarity", 4).alias("similarity"),
        F.round(score.cast("decimal(30,10)"), 1).cast("double").alias("score"),
        F.col("similarity").alias("_sim"),
    )
    best = W.partitionBy("left_id").orderBy(F.desc("score"), F.desc("_sim"), F.asc("right_id"))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("_sim")


def hamming_join(a: DataFrame, b: DataFrame, max_distance: int, *, ident: str = "id", bits: str = "bits",
                 width: int = 64, ordered: bool = False, least_band: int = 12) -> DataFrame:
    """Pairs whose bit arrays differ in at most ``max_distance`` of ``width`` places.

    Of max_distance + 1 bands one must be equal. Where such a band has ``least_band`` bits, rows meet on equal bands and the
    packed codes are compared. Wider hashes, such as the 256 bits of an image, go through the multi-index of ``hashes``. Where chunks are so
    short that nearly all pairs would meet, bits become +1/-1, for which distance = width * (1 - cosine) / 2, and the exact tiled join serves.
    """
    if width <= 64 and width // (max_distance + 1) >= least_band:
        size = width // (max_distance + 1)

        def banded(df, side):
            code = F.aggregate(F.col(bits).cast("array<long>"), F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(x))
            rows = df.select(F.col(ident).alias(f"{side}_id"), code.alias(f"{side}_code")).where(F.size(bits) == width)
            bands = F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(f"{side}_code", i * size).bitwiseAND((1 << size) - 1).alias("value")) for i in range(max_distance + 1)])
            return rows.select("*", F.explode(bands).alias("at")).select(f"{side}_id", f"{side}_code", "at.band", "at.value")

        # Spark takes exploded rows for as small as the table they came from; a broadcast of them would pass through the driver.
        met = banded(a, "left").hint("merge").join(banded(b, "right").hint("merge"), ["band", "value"])
        distance = F.bit_count(F.col("left_code").bitwiseXOR(F.col("right_code"))).cast("int")
        order = F.col("left_id") < F.col("right_id") if ordered else F.col("left_id") != F.col("right_id")
        pairs = met.where(order & (distance <= max_distance)).select("left_id", "right_id", distance.alias("distance")).distinct()
        distance = F.col("distance")
    elif width > 64 and useful(width, max_distance):
        pairs = close_hashes(a, b, max_distance, ident=ident, bits=bits, width=width, ordered=ordered)
        distance = F.col("distance")
    else:
        def signed(df):
            return df.select(F.col(ident).alias("id"), F.transform(bits, lambda x: (2 * x - 1).cast("float")).alias("v"))

        limit = 1.0 - 2.0 * (max_distance + 0.5) / width
        pairs = similarity_join(signed(a), signed(b), vec="v", threshold=limit, ordered=ordered)
        distance = F.round((1 - F.col("similarity")) * width / 2).cast("int")
    percent = F.round(((1 - distance / F.lit(float(width))) * 100).cast("decimal(30,10)"), 1).cast("double")
    return pairs.select("left_id", "right_id", distance.alias("distance"), percent.alias("similarity_percent"))


def prototypes(df: DataFrame, *, category: str = "category_l1", vec: str = "embedding", minimum: int = 3) -> DataFrame:
    """Unit-length mean vector of every category with at least ``minimum`` members.

    One row per vector: the mean is an aggregate over whole vectors, kept apart by width.
    """
    v = df.where(F.col(vec).isNotNull() & F.col(category).isNotNull())
    rows = v.select(F.col(category).alias("id"), F.size(vec).alias("w"), array_to_vector(F.col(vec).cast("array<double>")).alias("x"))
    means = rows.groupBy("id", "w").agg(Summarizer.mean(F.col("x")).alias("m"), F.count(F.lit(1)).alias("members")).where(F.col("members") >= minimum)
    mean = vector_to_array("m")
    size = F.sqrt(F.aggregate(mean, F.lit(0.0), lambda s, x: s + x * x))
    return means.where(size > 0).select("id", "members", F.transform(mean, lambda x: x / size).alias("embedding"))


def prototype_audit(df: DataFrame, *, category: str = "category_l1", vec: str = "embedding", minimum: int = 3) -> DataFrame:
    """Every row of a category with a prototype: similarity to its own and to the nearest prototype."""
    protos = prototypes(df, category=category, vec=vec, minimum=minimum)
    rows = df.where(F.col(vec).isNotNull()).join(protos.select(F.col("id").alias(category)), category, "left_semi")
    named = rows.select(F.col("id").cast("string").alias("id"), F.col(vec).alias("embedding"), F.col(category).alias("_cat"))
    best = similarity_join(named, protos, k=1, skip_equal=False).select(
        F.col("left_id").alias("id"), F.col("right_id").alias("predicted"), F.col("similarity").alias("sim_predicted"))
    own = similarity_join(
        named, protos.withColumn("_cat", F.col("id")), block="_cat", k=1, skip_equal=False
    ).select(F.col("left_id").alias("id"), F.col("similarity").alias("sim_actual"))
    return named.select("id", F.col("_cat").alias("actual")).join(best, "id").join(own, "id").withColumn(
        "correct", F.col("actual") == F.col("predicted"))


def zero_shot(df: DataFrame, labels: DataFrame, threshold: float = 0.20, *, max_labels: int | None = None,
              block: str | None = None) -> DataFrame:
    """Label whose vector is nearest, if at or above the threshold; ``block`` limits a row to the labels of its parent.

    With ``max_labels`` a scope with more candidate labels than that is left unclassified.
    """
    scope = labels
    if max_labels is not None:
        key = [block] if block else []
        few = labels.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= max_labels)
        scope = labels.join(few, key, "left_semi") if key else labels.join(F.broadcast(few)).drop("_n")  # without a block: one row or none
    rows = df.withColumn("id", F.col("id").cast("string"))
    best = similarity_join(rows, scope.withColumn("id", F.col("id").cast("string")), k=1, threshold=threshold,
                           block=block, skip_equal=False)
    return rows.drop("embedding").join(
        best.select(F.col("left_id").alias("id"), F.col("right_id").alias("label"), F.col("similarity").alias("confidence")),
        "id", "left")
