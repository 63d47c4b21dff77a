"""Vector columns: cosine, decoding of stored embeddings, perceptual-hash bits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from souklens.functions.numbers import col


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str, digits: int = 6) -> Column:
    """1 - cosine distance of two array columns; NULL where a vector is missing or zero."""
    return F.round(F.try_divide(dot(a, b), norm(a) * norm(b)), digits)


def embedding_from_text(c: Column | str) -> Column:
    """``[0.1,0.2,...]`` to array<float>; anything else becomes NULL."""
    text = F.trim(col(c))
    return F.when(text.startswith("[") & text.endswith("]"), F.from_json(text, "array<float>"))


def embedding_to_text(c: Column | str) -> Column:
    return F.to_json(col(c))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def embedding_from_blob(blobs: pd.Series) -> pd.Series:
    """Little-endian float32 blob to array<float>."""
    return blobs.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f4"))


@F.pandas_udf(T.BinaryType())
def embedding_to_blob(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())


def phash_bits(pixels: Column | str) -> Column:
    """1 where a pixel exceeds the upper median (sorted[n/2]) of its grid."""
    p = col(pixels)
    median = F.element_at(F.array_sort(p), (F.floor(F.size(p) / 2) + 1).cast("int"))
    # The one-element array has the median worked out once and not for every pixel.
    return F.transform(F.array(median), lambda m: F.transform(p, lambda x: F.when(x > m, 1).otherwise(0)))[0]


def dhash_bits(pixels: Column | str, width: int) -> Column:
    """1 where a pixel is larger than its right neighbour in a row-major grid ``width`` wide."""
    p = col(pixels)
    rows = F.sequence(F.lit(0), (F.size(p) / width).cast("int") - 1)
    cols = F.sequence(F.lit(0), F.lit(width - 2))

    def bit(r, c):
        left = F.get(p, r * width + c)
        return F.when(left > F.get(p, r * width + c + 1), 1).otherwise(0)

    return F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: bit(r, c))))


def grid_regions(pixels: Column | str, width: int, grid: int = 2) -> Column:
    """Cut a row-major square grid into grid x grid regions (row by row), each again row-major."""
    p, side = col(pixels), width // grid
    regions = [
        F.flatten(F.array(*[F.slice(p, (gr * side + r) * width + gc * side + 1, side) for r in range(side)]))
        for gr in range(grid) for gc in range(grid)
    ]
    return F.array(*regions)


def phash_regions(pixels: Column | str, width: int, grid: int = 2) -> Column:
    return F.transform(grid_regions(pixels, width, grid), phash_bits)


def bits_to_text(bits: Column | str) -> Column:
    return F.array_join(F.transform(col(bits), lambda b: b.cast("string")), "")


def hamming(a: Column | str, b: Column | str) -> Column:
    differs = F.zip_with(col(a), col(b), lambda x, y: F.when(x != y, 1).otherwise(0))
    return F.aggregate(differs, F.lit(0), lambda acc, x: acc + x)


def regions_similarity(a: Column | str, b: Column | str, bits: int = 256) -> Column:
    """Mean over regions of 1 - distance / bits. The divisor is a fixed 256 whatever the region's size."""
    pairs = F.arrays_zip(col(a).alias("x"), col(b).alias("y"))
    n = F.least(F.size(col(a)), F.size(col(b)))
    terms = F.transform(F.slice(pairs, 1, n), lambda z: 1 - hamming(z["x"], z["y"]) / F.lit(float(bits)))
    return F.when(n > 0, F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x) / n).otherwise(F.lit(0.0))
