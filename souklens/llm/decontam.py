"""Benchmark decontamination: a prefix-filtered set join between item windows and whole documents.

An item is cut into windows of consecutive words; a window is a set of word shingles at fixed places. All its shingles
must stand in a document for the window to occur, so its necessary prefix is one shingle: the rarest, by counts over all
documents. Documents give a row only where they hold such a shingle, with the words around it. The join on the prefix shingle then
applies the positional bound (enough words on both sides), and compares the words themselves. The shingles that
matter reach the scan of the documents as a bit table of 2 ** LOG2_BITS bits, whatever the benchmark's size; false bits
only cost work. The join itself is left to Spark, which broadcasts the windows only if they are small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from souklens.llm.common import batch_of, bit_table, in_bit_table, slices, utf8_buffer
from souklens.llm.words import words_of
from souklens.session import checkpointed

LOG2_BITS = 26
SHINGLE = 3

_WINDOWS = pa.schema([("item_id", pa.string()), ("words", pa.list_(pa.string())), ("tokens", pa.list_(pa.int64()))])
_FOUND = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("near", pa.list_(pa.struct([
    ("token", pa.int64()), ("pos", pa.int32()), ("left", pa.int32()), ("words", pa.list_(pa.string()))])))])


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item_id, words, tokens): all windows of consecutive words; an item of fewer words, but not none, is one window."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w = words_of(*utf8_buffer(batch["text"]))
            h = w.hashes()
            by_size = {n: w.shingles(h, n).view(np.int64) for n in range(1, SHINGLE + 1)}
            ids, words, tokens = [], [], []
            for row, item in enumerate(batch["item_id"].to_pylist()):
                a, b = int(w.first[row]), int(w.first[row + 1])
                own = [w.text(i) for i in range(a, b)]
                size = min(window, b - a)
                n = min(SHINGLE, size)
                for i in range(b - a - size + 1 if size else 0):
                    ids.append(item)
                    words.append(own[i: i + size])
                    tokens.append(by_size[n][a + i: a + i + size - n + 1].tolist())
            yield batch_of(_WINDOWS, item_id=ids, words=words, tokens=tokens)

    return items.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        work, "item_id string, words array<string>, tokens array<long>")


def _sizes(windows: DataFrame) -> list[int]:
    """Shingle sizes in use, 1 to SHINGLE."""
    return [r.n for r in windows.select(F.least(F.size("words"), F.lit(SHINGLE)).alias("n")).distinct().collect()]


def token_counts(docs: DataFrame, text: Column, windows: DataFrame) -> DataFrame:
    """(token, n): how often the windows' shingles stand in all documents, counted in each batch before the shuffle."""
    spark = docs.sparkSession
    wanted = windows.select(F.explode("tokens").alias("token")).distinct()
    bits, sizes = spark.sparkContext.broadcast(bit_table(wanted, "token", LOG2_BITS)), _sizes(windows)
    out = pa.schema([("token", pa.int64()), ("n", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w = words_of(*utf8_buffer(batch["text"]))
            h = w.hashes()
            for n in sizes:
                s = w.shingles(h, n)
                token, count = np.unique(s[in_bit_table(bits.value, s) & (s != 0)], return_counts=True)
                yield batch_of(out, token=token.view(np.int64), n=count.astype(np.int64))

    counted = docs.select(text.cast("string").alias("text")).mapInArrow(work, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return wanted.join(counted, "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", window: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, item_ids): one row per input row of ``docs``.

    A word is hit if it lies in any occurrence of a window. item_ids are the items with occurring windows, as sorted strings.
    NULL and empty texts have no words and no hits; without items nothing is hit. Rows that repeat, in either table, are
    answered one by one; items of equal text are all reported. Columns other than those named are not read.
    """
    spark = docs.sparkSession
    windows = checkpointed(item_windows(items, item_col, item_text_col, window))
    distinct = windows.groupBy("words").agg(F.first("tokens").alias("tokens"))
    counts = token_counts(docs, F.col(text_col), windows)
    rare = distinct.select("words", F.posexplode("tokens").alias("at", "token")).join(counts, "token").groupBy("words").agg(
        F.min(F.struct("n", "token", "at")).alias("least")).select("words", F.col("least.token").alias("token"), F.col("least.at").alias("at"))
    rare = checkpointed(rare)
    bits, sizes = spark.sparkContext.broadcast(bit_table(rare, "token", LOG2_BITS)), _sizes(windows)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w = words_of(*utf8_buffer(batch["text"]))
            h = w.hashes()
            near: list[list[dict]] = [[] for _ in range(len(batch))]
            for n in sizes:
                s = w.shingles(h, n)
                for i in np.flatnonzero(in_bit_table(bits.value, s) & (s != 0)).tolist():
                    row = int(w.doc[i])
                    a, b = int(w.first[row]), int(w.first[row + 1])
                    left = min(i - a, window - n)
                    near[row].append({"token": int(s[i].astype(np.int64)), "pos": i - a, "left": left,
                                      "words": [w.text(k) for k in range(i - left, min(b, i + window))]})
            yield batch_of(_FOUND, row=batch["row"], doc_id=batch["doc_id"], n_words=np.diff(w.first), near=near)

    found = checkpointed(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                                     F.col(text_col).cast("string").alias("text")).mapInArrow(
        scan, "row long, doc_id long, n_words long, near array<struct<token:long,pos:int,left:int,words:array<string>>>"))
    near = found.where(F.size("near") > 0).select("row", F.explode("near").alias("c")).select("row", "c.*")
    hits = near.join(rare.withColumnRenamed("words", "window"), "token").where(
        (F.col("left") >= F.col("at"))
        & (F.col("left") - F.col("at") + F.size("window") <= F.size("words"))
        & F.expr("slice(words, left - at + 1, size(window)) = window"))
    hits = hits.select("row", "window", (F.col("pos") - F.col("at")).alias("start"), (F.col("pos") - F.col("at") + F.size("window")).alias("end"))
    hits = checkpointed(hits)
    covered = hits.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans")).select("row", F.expr("""
        aggregate(spans, named_struct('n', 0L, 'reach', 0L), (a, s) -> named_struct(
            'n', a.n + greatest(0L, s.end - greatest(a.reach, cast(s.start as long))), 'reach', greatest(a.reach, cast(s.end as long))),
            a -> a.n)""").alias("n_hit"))
    of_row = hits.select("row", "window").distinct().join(
        windows.select(F.col("words").alias("window"), "item_id").distinct(), "window").groupBy("row").agg(
        F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    return found.select("row", "doc_id", "n_words").join(covered.join(of_row, "row"), "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
