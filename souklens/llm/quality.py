"""Quality classifier: the byte network of ``byteconv`` over overlapping chunks of the whole document.

Filters are max-pooled over a chunk; the chunks' log odds are averaged by their bytes into one probability. Both
labels are drawn alike for training, and the scores are shifted back to the labels' true shares.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from souklens.llm.byteconv import PAD, Net
from souklens.llm.common import batch_of, slices, utf8_buffer
from souklens.llm.langid import training_windows

LENGTH, STRIDE = 512, 448


def train_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Net:
    """Fit on a bounded sample of ``labels``, with the texts of ``docs``; the caller leaves out of ``labels`` what is held out. An id with several labels
    counts as good only if all say so."""
    classes = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_class")).where("_class is not null").groupBy("_id").agg(
        (F.min("_class") > 0).cast("int").alias("_class"))
    classes, x, y, counts = training_windows(docs, classes, id_col, text_col, LENGTH)
    drawn = np.bincount(y, minlength=2)
    short = x.copy()  # each window again, cut to a random length: short texts are mostly padding
    short[np.arange(LENGTH) >= np.random.default_rng(2).integers(8, 128, len(x))[:, None]] = PAD
    x, y = np.concatenate([x, short]), np.concatenate([y, y])
    net = Net.new([0, 1], filters=12, seed=1)
    if not drawn.all():
        net.dense[:] = 0
        net.bias[:] = np.log([0.999, 0.001] if drawn[0] else [0.001, 0.999])
        return net
    net.fit(x, y, epochs=8, least_steps=3000)
    net.bias += np.log([counts[c] / max(1, n) for c, n in zip(classes, drawn)]).astype(np.float32)
    return net


_OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): one row per input row, the probability of label 1. NULL and empty texts get that of an empty chunk.
    Columns other than the two named are not read. Repeated rows and rows with a NULL id are answered one by one; an empty table gives
    no rows."""
    known = docs.sparkSession.sparkContext.broadcast(net)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            p = known.value.document_scores(*utf8_buffer(batch["text"]), LENGTH, STRIDE)
            yield batch_of(_OUT, doc_id=batch["doc_id"], score=p[:, 1])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, "doc_id long, score double")
