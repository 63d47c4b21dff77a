"""Language identification by the byte network of ``byteconv``, over fixed-length windows that cover the whole text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from souklens.llm.byteconv import Net, cut, windows_of
from souklens.llm.common import batch_of, drawn, slices, utf8_buffer

LENGTH, STRIDE = 256, 252
DOCUMENTS = 6000  # training documents over all classes, at most
PER_DOCUMENT = 2  # training windows of a document, at most, spread over the whole text
UNDETERMINED = "und"


def training_windows(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, length: int, documents: int = DOCUMENTS,
                     per_document: int = PER_DOCUMENT) -> tuple[list, np.ndarray, np.ndarray, dict]:
    """(classes, windows, class numbers, rows per class) of a bounded sample of ``classes`` (_id, _class), drawn by hash of the id.

    Only ids and classes are ranked; the drawn ids, ``documents`` at most, are broadcast to the texts, which are never shuffled."""
    some, counts = drawn(classes, documents)
    classes = sorted(counts)
    if not classes:
        return [], np.zeros((0, length), np.uint8), np.zeros(0, np.int64), {}
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).where("length(text) > 0").join(F.broadcast(some), "_id")
    out = pa.schema([("label", pa.string()), ("window", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = utf8_buffer(batch["text"])
            row, start, end = windows_of(offsets, length, length)
            k = start - offsets[:-1][row]
            size = np.diff(offsets)[row]
            wanted = np.zeros(len(row), bool)
            for i in range(per_document):  # the windows around the middle of each part of the text
                place = (2 * i + 1) * size // (2 * per_document)
                wanted |= (k <= place) & (place < k + length)
            picked = cut(data, start[wanted], end[wanted], length)
            yield batch_of(out, label=batch["_class"].take(pa.array(row[wanted])), window=[w.tobytes() for w in picked])

    found = rows.select(F.col("_class").cast("string").alias("_class"), "text").mapInArrow(work, "label string, window binary").collect()
    number = {str(c): i for i, c in enumerate(classes)}
    found = sorted((number[r["label"]], bytes(r["window"])) for r in found)
    x = np.frombuffer(b"".join(w for _, w in found), np.uint8).reshape(-1, length)
    return classes, x, np.array([c for c, _ in found]), counts


def train_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Net:
    """Fit on the rows of ``docs`` with a language; the caller leaves out what is held out. Without any the network has no class."""
    classes = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_class"))
    classes, x, y, _ = training_windows(docs, classes, id_col, text_col, LENGTH)
    net = Net.new(classes)
    return net.fit(x, y) if len(x) else net


_OUT = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("score", pa.float64())])


def predict(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang, score): one row per input row; the likeliest class of the whole text and its probability.

    NULL, empty texts and texts without a letter are ``und`` with score 0, and so is everything if the network has no class.
    Columns other than the two named are not read, so the language column is no input.
    Repeated rows and rows with a NULL id are answered one by one; an empty table gives no rows.
    """
    known = docs.sparkSession.sparkContext.broadcast(net)
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = known.value
        for batch in slices(batches):
            data, offsets = utf8_buffer(batch["text"])
            letters = np.concatenate([[0], np.cumsum(ascii_letter[data])])
            some = letters[offsets[1:]] > letters[offsets[:-1]]
            for i in np.flatnonzero(~some & (np.diff(offsets) > 0)).tolist():
                some[i] = any(c.isalpha() for c in batch["text"][i].as_py())
            if net.classes:
                p = net.document_scores(data, offsets, LENGTH, STRIDE)
                best = p.argmax(axis=1)
                lang = [str(net.classes[b]) if s else UNDETERMINED for b, s in zip(best.tolist(), some.tolist())]
                score = np.where(some, p[np.arange(len(best)), best], 0.0)
            else:
                lang, score = [UNDETERMINED] * len(batch), np.zeros(len(batch))
            yield batch_of(_OUT, doc_id=batch["doc_id"], lang=lang, score=score)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        work, "doc_id long, lang string, score double")
