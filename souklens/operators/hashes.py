"""Similarity joins of perceptual hashes of any width by multi-index hashing.

A hash is packed into longs and cut into chunks. If two hashes differ in at most r bits, then in one chunk they differ in few: with m
chunks and r = a * m + b, in at most a bits of one of the first b + 1 chunks or in fewer than a bits of another. So stored hashes
meet by equal chunk values, and a probing hash asks for every value within its chunk's radius. Bits of an image hash that are
neighbours or a row or period apart depend on each other, so a chunk takes bits from places drawn once for all. A bucket of many hashes is split by a second chunk, for which the
same argument holds on the chunks that are left. Every pair is kept by its first chunk only, which needs no distinct afterwards.

Equal hashes are one class: links are between classes, each named by its smallest id, and no group of copies is expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from random import Random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from souklens.session import checkpointed

HEAVY = 1 << 12  # stored hashes of a bucket from which a second chunk splits it
SIZES = (8, 16, 32)  # bits of a chunk; all divide a long


def masks(bits: int, radius: int) -> list[int]:
    """All values of ``bits`` bits with at most ``radius`` ones."""
    return [sum(1 << p for p in some) for n in range(min(radius, bits) + 1) for some in combinations(range(bits), n)]


def radii(chunks: int, distance: int) -> list[int]:
    """Search radius of each chunk; -1 where a chunk needs no search."""
    a, b = divmod(distance, chunks)
    return [a if i <= b else a - 1 for i in range(chunks)]


def probe_count(width: int, size: int, distance: int) -> int:
    total = 0
    for radius in radii(width // size, distance):
        ways = 1
        for n in range(radius + 1):
            total += ways
            ways = ways * (size - n) // (n + 1)
    return total


def chunk_size(width: int, distance: int, stored: int) -> int:
    """The chunk size with the least work for a probing hash: values asked for, and stored hashes met by chance."""
    return min(SIZES, key=lambda s: probe_count(width, s, distance) * (1 + stored / 2.0 ** s))


def useful(width: int, distance: int) -> bool:
    """Whether some chunk size leaves unrelated hashes apart: under a hundredth of all pairs meet by chance."""
    return any(probe_count(-(-width // 64) * 64, s, distance) <= min(4096, 2 ** s // 100) for s in SIZES)


def places(width: int) -> list[int]:
    """The bit that goes to each place of a packed hash, the same for every table."""
    whole = -(-width // 64) * 64
    return Random(whole).sample(range(whole), whole)


def packed(df: DataFrame, ident: str, bits: str, width: int, size: int | None = None) -> DataFrame:
    """(id, c0, c1, ...): hashes of ``width`` bits as longs, their bits in the order of ``places``; chunks of any ``size`` are neighbouring places.
    Other rows are left out in the tasks: a filter would be pushed below the making of the bits, which would then be made once for each use in it."""
    whole = -(-width // 64) * 64
    order, names = np.array(places(width)), [f"c{w}" for w in range(whole // 64)]
    rows = df.select(F.col(ident).alias("id"), F.col(bits).cast("array<int>").alias("_bits"))
    kind = rows.schema["id"].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch["_bits"]), width), False))
            own = batch["_bits"].flatten()
            full = np.zeros((len(batch), whole), np.uint8)
            full[:, :width] = own.fill_null(0).to_numpy().reshape(len(batch), width) & 1
            known = ~own.is_null().to_numpy(zero_copy_only=False).reshape(len(batch), width).any(axis=1)
            batch, full = batch.filter(pa.array(known)), full[known]
            longs = np.ascontiguousarray(np.packbits(full[:, order], axis=1)).view(">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch["id"], *map(pa.array, longs.T)], names=["id", *names])

    return rows.mapInArrow(work, T.StructType([T.StructField("id", kind), *[T.StructField(c, T.LongType()) for c in names]]))


def _chunk(i: int, size: int, column) -> Column:
    """Chunk i of the longs that ``column`` names by number."""
    per = 64 // size
    return F.shiftrightunsigned(column(i // per), 64 - size * (i % per + 1)).bitwiseAND((1 << size) - 1)


def classes(codes: DataFrame) -> DataFrame:
    """One row per distinct hash: smallest id, its longs, and the number of copies."""
    longs = [c for c in codes.columns if c != "id"]
    return codes.groupBy(*longs).agg(F.min("id").alias("id"), F.count("*").alias("copies")).select("id", *longs, "copies")


def _places(values: Column, chunk: int, kind: str = "") -> Column:
    """Structs of the chunk's number and each of ``values``."""
    return F.transform(values, lambda v: F.struct(F.lit(chunk).cast("int").alias(f"chunk{kind}"), v.alias(f"value{kind}")))


def close_pairs(stored: DataFrame, probing: DataFrame, width: int, size: int, distance: int) -> DataFrame:
    """(left_id, right_id, distance) of all probing (left) and stored (right) hashes that differ in at most ``distance`` bits; both
    sides are distinct hashes as ``classes`` gives them."""
    n = -(-width // 64)
    chunks = 64 * n // size
    first, second = radii(chunks, distance), radii(chunks - 1, distance) if chunks > 1 else []
    longs = [f"c{w}" for w in range(n)]
    own = lambda i: _chunk(i, size, lambda w: F.col(f"c{w}"))
    asked = lambda i, radius: F.transform(F.lit(masks(size, radius)), lambda m: own(i).bitwiseXOR(m.cast("long")))

    def spread(rows: DataFrame, probes: bool) -> DataFrame:
        """One row for each chunk value that a hash is stored under, or asks for."""
        at = [_places(asked(i, r) if probes else F.array(own(i)), i) for i, r in enumerate(first) if r >= 0]
        return rows.select("id", *longs, F.explode(F.concat(*at)).alias("at")).select("id", *longs, "at.chunk", "at.value")

    def again(rows: DataFrame, probes: bool) -> DataFrame:
        """Rows of heavy buckets, once more for each value of another chunk."""
        def others(i: int) -> Column:
            rest = [j for j in range(chunks) if j != i]
            return F.concat(*[_places(asked(j, r) if probes else F.array(own(j)), j, "2") for j, r in zip(rest, second) if r >= 0])

        at = F.lit(None)
        for i, r in enumerate(first):
            if r >= 0:
                at = F.when(F.col("chunk") == i, others(i)).otherwise(at)
        return rows.select("*", F.explode(at).alias("at2")).select(*rows.columns, "at2.chunk2", "at2.value2")

    differs = lambda i: F.bit_count(_chunk(i, size, lambda w: F.col(f"l{w}").bitwiseXOR(F.col(f"r{w}"))))
    hits = [i for i, r in enumerate(first) if r >= 0]
    is_first = F.coalesce(*[F.when(differs(i) <= first[i], F.lit(i)) for i in hits]) == F.col("chunk")
    total = sum((F.bit_count(F.col(f"l{w}").bitwiseXOR(F.col(f"r{w}"))) for w in range(1, n)), F.bit_count(F.col("l0").bitwiseXOR(F.col("r0")))).cast("int")

    def met(probes: DataFrame, kept: DataFrame, on: list[str]) -> DataFrame:
        left = probes.select(F.col("id").alias("left_id"), *[F.col(f"c{w}").alias(f"l{w}") for w in range(n)], *on)
        right = kept.select(F.col("id").alias("right_id"), *[F.col(f"c{w}").alias(f"r{w}") for w in range(n)], *on)
        # Spark takes exploded rows for as small as the table they came from; a broadcast of them would pass through the driver.
        return left.hint("merge").join(right.hint("merge"), on).where(total <= distance).where(is_first)

    kept, probes = spread(stored, False), spread(probing, True)
    out = ("left_id", "right_id", total.alias("distance"))
    if chunks < 3:
        return met(probes, kept, ["chunk", "value"]).select(*out)
    heavy = checkpointed(kept.groupBy("chunk", "value").agg(F.count("*").alias("_n")).where(F.col("_n") > HEAVY).drop("_n"))
    if heavy.isEmpty():
        return met(probes, kept, ["chunk", "value"]).select(*out)
    key = ["chunk", "value"]
    light = met(probes.join(heavy, key, "left_anti"), kept.join(heavy, key, "left_anti"), key)
    dense = met(again(probes.join(heavy, key, "left_semi"), True), again(kept.join(heavy, key, "left_semi"), False), [*key, "chunk2", "value2"])
    apart = F.array(*[differs(i).cast("int") for i in range(chunks)])
    limits = F.lit(second)
    place = lambda j: j - F.when(j > F.col("chunk"), 1).otherwise(0)  # among the chunks other than the first
    fits = F.filter(F.sequence(F.lit(0), F.lit(chunks - 1)), lambda j: (j != F.col("chunk")) & (F.get(apart, j) <= F.get(limits, place(j))))
    return light.select(*out).unionByName(dense.where(F.get(fits, F.lit(0)) == F.col("chunk2")).select(*out))


def _percent(distance: Column, width: int) -> Column:
    return F.round(((1 - distance / F.lit(float(width))) * 100).cast("decimal(30,10)"), 1).cast("double")


def _prepared(df: DataFrame, ident: str, bits: str, width: int, distance: int) -> tuple[DataFrame, int]:
    """Classes of one side as a written table, and the chunk size that suits their number."""
    codes = checkpointed(packed(df, ident, bits, width))
    return codes, chunk_size(-(-width // 64) * 64, distance, codes.count())


def hash_classes(df: DataFrame, *, ident: str = "id", bits: str = "bits", width: int = 256) -> DataFrame:
    """(id, class_id): the smallest id with the same hash. Rows without a hash of ``width`` bits have no class."""
    codes = packed(df, ident, bits, width)
    of = classes(codes).withColumnRenamed("id", "class_id").drop("copies")
    return codes.join(of, [c for c in codes.columns if c != "id"]).select("id", "class_id")


def hash_links(df: DataFrame, max_distance: int, *, ident: str = "id", bits: str = "bits", width: int = 256) -> DataFrame:
    """(left_id, right_id, distance, similarity_percent, left_copies, right_copies) of different hashes that differ in at most
    ``max_distance`` bits, each hash named by the smallest id that has it; ``hash_classes`` gives the members."""
    codes, size = _prepared(df, ident, bits, width, max_distance)
    of = checkpointed(classes(codes))
    pairs = close_pairs(of.drop("copies"), of.drop("copies"), width, size, max_distance).where(F.col("left_id") < F.col("right_id"))
    copies = lambda s: of.select(F.col("id").alias(f"{s}_id"), F.col("copies").alias(f"{s}_copies"))
    return pairs.join(copies("left"), "left_id").join(copies("right"), "right_id").select(
        "left_id", "right_id", "distance", _percent(F.col("distance"), width).alias("similarity_percent"), "left_copies", "right_copies")


def close_hashes(a: DataFrame, b: DataFrame, max_distance: int, *, ident: str = "id", bits: str = "bits", width: int = 256, ordered: bool = False) -> DataFrame:
    """(left_id, right_id, distance) of rows of ``a`` and ``b`` that differ in at most ``max_distance`` bits. Every copy of a hash has a row
    here; ``hash_links`` has one for each two classes."""
    stored, size = _prepared(b, ident, bits, width, max_distance)
    probing = stored if a is b else checkpointed(packed(a, ident, bits, width))
    longs = [c for c in stored.columns if c != "id"]
    right = checkpointed(classes(stored).drop("copies"))
    left = right if a is b else checkpointed(classes(probing).drop("copies"))
    pairs = close_pairs(right, left, width, size, max_distance).withColumnsRenamed({"left_id": "_l", "right_id": "_r"})
    members = lambda rows, of, s: rows.join(of.withColumnRenamed("id", f"_{s[0]}"), longs).select(F.col("id").alias(f"{s}_id"), f"_{s[0]}")
    found = pairs.join(members(probing, left, "left"), "_l").join(members(stored, right, "right"), "_r")
    order = F.col("left_id") < F.col("right_id") if ordered else F.col("left_id") != F.col("right_id")
    return found.where(order).select("left_id", "right_id", "distance")
