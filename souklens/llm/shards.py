"""Best-fit-decreasing bin packing of documents into shards.

Rows of equal text are one indivisible group. Groups enter by falling size; each goes to the bin with the least remaining capacity that
still holds it, found in a balanced search tree of the remaining capacities. Packing only needs to know how many groups there are of each
size: equal sizes follow each other, and the bin that was tightest for one stays the tightest for the next until it is full for that
size, so a run of equal groups is placed in one step for each bin that it fills. The list of sizes grows with the square root of the
bytes at most, since n different sizes need n * (n + 1) / 2 bytes; 100 TB have under 15 million. The groups themselves, and the
rows, stay in Spark: a group gets its place among those of its size, and the packing says which places go to which shard.

For a given number of shards the capacity is the least for which the packing needs no more, found by bisection. A group larger than a fair
share of what is left has a shard of its own.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from souklens.session import checkpointed

Runs = Sequence[tuple[int, int]]  # (size, number of groups), sizes falling


def best_fit(runs: Runs, capacity: int, most: int | None = None) -> list[dict[int, int]] | None:
    """Bins as {size: number of groups}, by best fit decreasing; None if more than ``most`` are needed. A group above the capacity
    has a bin of its own."""
    bins: list[dict[int, int]] = []
    tree: list[tuple[int, int]] = []  # (remaining capacity, bin), kept in order
    for size, count in runs:
        while count:
            at = bisect_left(tree, (size, -1))
            if at == len(tree):
                if most is not None and len(bins) == most:
                    return None
                left, b = max(capacity, size), len(bins)
                bins.append({})
            else:
                left, b = tree.pop(at)
            n = min(count, left // size) if size else count
            bins[b][size] = bins[b].get(size, 0) + n
            count -= n
            if left - n * size:
                insort(tree, (left - n * size, b))
    return bins


def _fill(bins: list[dict[int, int]]) -> list[int]:
    return [sum(s * n for s, n in b.items()) for b in bins]


def level(bins: list[dict[int, int]]) -> list[dict[int, int]]:
    """Move single groups from the fullest bins to the emptiest while that brings the two closer; what few large groups leave uneven."""
    for _ in range(8 * len(bins)):
        fill = _fill(bins)
        low = min(range(len(bins)), key=fill.__getitem__)
        moved = False
        for high in sorted(range(len(bins)), key=fill.__getitem__, reverse=True):
            gap = fill[high] - fill[low]
            fits = [s for s in bins[high] if 0 < s < gap]
            if fits:
                s = min(fits, key=lambda x: abs(gap - 2 * x))
                bins[high][s] -= 1
                if not bins[high][s]:
                    del bins[high][s]
                bins[low][s] = bins[low].get(s, 0) + 1
                moved = True
                break
        if not moved:
            break
    return bins


def pack_into(runs: Runs, shards: int) -> list[dict[int, int]]:
    """Exactly ``shards`` bins of near equal size: the least capacity for which best fit decreasing needs no more than there are."""
    runs = [list(r) for r in runs]
    alone: list[dict[int, int]] = []
    total = sum(s * n for s, n in runs)
    while runs and shards - len(alone) > 1 and runs[0][0] * (shards - len(alone)) > total:
        size = runs[0][0]  # larger than a fair share: alone, and the others share what is left
        alone.append({size: 1})
        total -= size
        runs[0][1] -= 1
        if not runs[0][1]:
            runs.pop(0)
    rest, found = shards - len(alone), None
    low = max(-(-total // rest), runs[0][0] if runs else 0)
    high = low + (runs[0][0] if runs else 0)
    while found is None:
        found, high = best_fit(runs, high, rest), 2 * high
    high = max([*_fill(found), low])
    while low < high:
        middle = (low + high) // 2
        tried = best_fit(runs, middle, rest)
        if tried is None:
            low = middle + 1
        else:
            found, high = tried, middle
    return alone + level(found + [{} for _ in range(rest - len(found))])


def numbered(rows: DataFrame, keys: list[str], order: list[Column], name: str, parts: int) -> DataFrame:
    """``rows`` with a gapless number from 0 for each key in ``order``, which has to tell all rows apart. Rows are dealt by ranges of that
    order, each range counts its own, and the counts of the ranges before it are added: a key that holds most rows is spread
    over the ranges."""
    dealt = checkpointed(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = dealt.withColumn("_own", F.row_number().over(W.partitionBy(*keys, "_range").orderBy(*order)) - 1)
    return own.join(starts, [*keys, "_range"]).withColumn(name, (F.col("_own") + F.col("_start")).cast("long")).drop("_own", "_start", "_range")


def _parts(rows: int) -> int:
    return max(1, min(20_000, rows // 200_000 + 8))


def shard_documents(docs: DataFrame, shards: int | None = None, capacity: int | None = None, overhead: int = 16, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): one row per input row. A row's size is the UTF-8 bytes of its text and ``overhead``.

    With ``capacity`` as few shards as best fit decreasing gives, none larger unless one group alone is; with ``shards`` just that many
    and as equal as whole groups allow. Rows of equal text are one group and share a shard; a NULL text counts as an
    empty one. slot numbers a shard's rows from 0 by doc_id, NULL ids last.
    Repeated rows each have a slot. An empty table gives no rows, and with few groups some shards stay empty. Texts are told apart by 128
    bits of hash and their length. Columns other than the two named are not read.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give the number of shards or their capacity")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = F.octet_length(text).cast("long") + overhead
    rows = checkpointed(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit(1), text).alias("_k2"), F.monotonically_increasing_id().alias("_row")))
    groups = checkpointed(rows.groupBy("_k1", "_k2", "size").agg(F.count("*").alias("_copies")).withColumn("_bytes", F.col("size") * F.col("_copies")))
    runs = [(r["_bytes"], r["n"]) for r in groups.groupBy("_bytes").agg(F.count("*").alias("n")).orderBy(F.desc("_bytes")).collect()]
    bins = best_fit(runs, capacity) if shards is None else pack_into(runs, shards)
    upto: dict[int, int] = {}
    pieces = []
    for shard, b in enumerate(bins):
        for bytes_, n in b.items():
            pieces.append((bytes_, upto.get(bytes_, 0), upto.get(bytes_, 0) + n, shard))
            upto[bytes_] = upto.get(bytes_, 0) + n
    placed = spark.createDataFrame(pieces, "_bytes long, _from long, _to long, shard int")
    n = sum(c for _, c in runs)
    ranked = numbered(groups, ["_bytes"], [F.desc("_bytes"), F.asc("_k1"), F.asc("_k2"), F.asc("size")], "_place", _parts(n))
    homes = ranked.join(placed, "_bytes").where((F.col("_place") >= F.col("_from")) & (F.col("_place") < F.col("_to"))).select("_k1", "_k2", "size", "shard")
    homed = rows.join(homes, ["_k1", "_k2", "size"])
    order = [F.asc_nulls_last("doc_id"), F.asc("_k1"), F.asc("_k2"), F.asc("size"), F.asc("_row")]
    return numbered(homed, ["shard"], order, "slot", _parts(groups.agg(F.sum("_copies")).first()[0] or 0)).select("doc_id", "size", "text_crc32", "shard", "slot")
