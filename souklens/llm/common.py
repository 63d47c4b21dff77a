"""What the operators share: folds, Arrow slices of bounded size, and byte buffers of string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

SLICE_BYTES = 1 << 20  # of text worked on at a time; the arrays of words take about 50 times as much
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; NULL for a NULL id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % n


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``limit`` bytes in each; one longer text is a slice of its own."""
    for batch in batches:
        sizes = np.cumsum(np.nan_to_num(np.asarray(pc.binary_length(batch[column]).to_numpy(zero_copy_only=False), dtype=float)))
        start, base = 0, 0.0
        while start < len(sizes):
            end = max(int(np.searchsorted(sizes, base + limit, side="right")), start + 1)
            yield batch.slice(start, end - start)
            start, base = end, sizes[end - 1]


def small_batches(spark: SparkSession) -> None:
    """Have whole texts sent to Python workers by BATCH_ROWS rows, unless the session asks for fewer. At Spark's 10,000 a batch of texts has tens
    of MB, and the JVM and the worker of every task each hold one beside what they work on."""
    now = int(spark.conf.get(BATCH))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(BATCH, BATCH_ROWS)


def utf8_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a string column; NULL is the empty text."""
    column = column.cast(pa.string()).fill_null("")
    column = pa.concat_arrays([column])  # offsets from zero
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int32, count=len(column) + 1 + column.offset)[column.offset:].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0]: ends[-1]], ends - ends[0]


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=schema.field(n).type) for n, c in ((f.name, columns[f.name]) for f in schema)], schema=schema)


def drawn(classes: DataFrame, documents: int) -> tuple[DataFrame, dict]:
    """A sample of (_id, _class) rows drawn by hash of the id, alike for each class and ``documents`` rows at most (one of each class
    at least), and the number of rows of each class. A class is thinned by its own share first, so that ranking it stays small at any size."""
    classes = classes.where("_id is not null and _class is not null")
    counts = {r["_class"]: r["n"] for r in classes.groupBy("_class").agg(F.count("*").alias("n")).collect()}
    each = max(1, documents // max(1, len(counts)))
    share = F.lit(0.0)
    for c, n in counts.items():
        share = F.when(F.col("_class") == F.lit(c), F.lit(4.0 * each / n)).otherwise(share)
    place = F.shiftrightunsigned(F.xxhash64("_id"), 11) / F.lit(float(1 << 53))
    order = Window.partitionBy("_class").orderBy(F.xxhash64("_id"), "_id")
    few = classes.where(place <= F.greatest(share, F.lit(64.0) * share / F.lit(float(each)))).withColumn("_r", F.row_number().over(order))
    return few.where(F.col("_r") <= each).select("_id", "_class").distinct(), counts


def bit_table(tokens: DataFrame, column: str, log2_bits: int) -> np.ndarray:
    """A packed table of 2 ** log2_bits bits with those of the leading digits of 64-bit hashes set. Pieces of the table are made by the
    executors, so the driver gets no more than the table itself, however many hashes there are."""
    low = min(15, log2_bits)
    out = pa.schema([("piece", pa.int64()), ("bits", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = []
            for places in batch["places"]:
                bits = np.zeros(1 << low, bool)
                bits[places.values.to_numpy()] = True
                pieces.append(np.packbits(bits, bitorder="little").tobytes())
            yield batch_of(out, piece=batch["piece"], bits=pieces)

    at = tokens.select(F.shiftrightunsigned(column, 64 - log2_bits).alias("at")).distinct()
    pieces = at.groupBy(F.shiftrightunsigned("at", low).alias("piece")).agg(F.collect_list(F.col("at").bitwiseAND((1 << low) - 1)).alias("places"))
    table = np.zeros((1 << log2_bits) // 8, np.uint8)
    size = (1 << low) // 8
    for row in pieces.mapInArrow(work, "piece long, bits binary").collect():
        table[row["piece"] * size: (row["piece"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return table


def in_bit_table(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - int(np.log2(len(table) * 8)))
    return (table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
