"""Exact order statistics by index, without sorting everything in one place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

BUCKETS_PER_OCTAVE = 64
PARTS_PER_BUCKET = 4096


def _holding(hist: DataFrame, group: list[str], part: str, targets: DataFrame) -> DataFrame:
    """For every target (group, q, n, _at) the part that holds index _at of its group, and the index inside it."""
    run = hist.withColumn("_hi", F.sum("_c").over(W.partitionBy(*group).orderBy(part)))
    joined = run.join(targets, group) if group else run.withColumn("_one", F.lit(1)).join(targets.withColumn("_one", F.lit(1)), "_one").drop("_one")
    lo = F.col("_hi") - F.col("_c")
    hit = joined.where((F.col("_at") >= lo) & (F.col("_at") < F.col("_hi")))
    return hit.select(*group, part, "q", "n", (F.col("_at") - lo).alias("_at"))


def values_at(df: DataFrame, value: str, fractions: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """The 0-based floor(n * q)-th smallest positive value per key and fraction: keys..., q, n, value.

    Values fall into about one-percent-wide logarithmic buckets, which are counted map-side. The counts (a few
    thousand rows per key) tell which bucket holds each index; the rows of those buckets alone are counted again by
    4096 equal parts, and only the distinct values of the parts that hold an index are put in order. Equal values
    are one row with a count, so a value that fills the table costs nothing extra.
    """
    keys = list(keys)
    v = df.where(F.col(value) > 0).select(*keys, F.col(value).alias("_v"))
    v = v.withColumn("_b", F.floor(F.log2(F.col("_v").cast("double")) * BUCKETS_PER_OCTAVE))
    count = F.count(F.lit(1)).alias("_c")
    hist = v.groupBy(*keys, "_b").agg(count)
    totals = hist.groupBy(*keys).agg(F.sum("_c").alias("n"))
    targets = totals.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in fractions]))).withColumn("_at", F.floor(F.col("n") * F.col("q")))
    in_bucket = _holding(hist, keys, "_b", targets)
    bucket, part = [*keys, "_b"], [*keys, "_b", "_p"]
    low = F.pow(F.lit(2.0), F.col("_b") / BUCKETS_PER_OCTAVE)
    place = (F.col("_v").cast("double") / low - 1) / (2 ** (1 / BUCKETS_PER_OCTAVE) - 1) * PARTS_PER_BUCKET
    inside = v.join(in_bucket.select(*bucket).distinct(), bucket, "left_semi").withColumn("_p", F.floor(place))
    in_part = _holding(inside.groupBy(*part).agg(count), bucket, "_p", in_bucket)
    few = inside.join(in_part.select(*part).distinct(), part, "left_semi").groupBy(*part, "_v").agg(count)
    return _holding(few, part, "_v", in_part).select(*keys, "q", "n", F.col("_v").alias("value"))


def one_row_values(df: DataFrame, value: str, fractions: dict[str, float]) -> DataFrame:
    """The same for a whole table as one row, one column per name; NULLs where there is no positive value."""
    stats = values_at(df, value, list(fractions.values()))
    return stats.agg(*[F.max(F.when(F.col("q") == q, F.col("value"))).alias(name) for name, q in fractions.items()])
