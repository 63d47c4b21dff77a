"""Toxicity by multiple-instance learning: sentences are the instances, a document is their bag.

A sentence scores the logistic of a bias plus the weights of its words; a document's score is the noisy-or of its sentences. Only
documents carry labels. Training takes a bounded sample of labelled documents, drawn by hash of the id, whose ids are broadcast
to the texts. Words are hashed to buckets; those whose document frequency differs most between the labels are the vocabulary,
and gradient descent on the noisy-or likelihood of the bags gives their weights. Scoring is one pass over whole texts with a weight table of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from souklens.llm.common import batch_of, drawn, slices, utf8_buffer
from souklens.llm.words import Words, words_of

BUCKET_BITS = 20
VOCABULARY = 2048  # buckets with weights, at most
BAGS = 16_000  # training documents over both labels, at most
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".!?\n"]] = True


@dataclass
class Model:
    bias: float
    weights: np.ndarray  # by bucket


def _sentences(w: Words, offsets: np.ndarray) -> np.ndarray:
    """For each word the index of its sentence over the whole slice; sentences end at . ! ? or a line break and at a row's end."""
    breaks = np.concatenate([[0], np.cumsum(_BREAK[w.data])])
    number = breaks[w.start] + w.doc
    return np.unique(number, return_inverse=True)[1] if len(number) else number


def _buckets(w: Words) -> np.ndarray:
    return (w.hashes() >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, documents: int = BAGS) -> tuple[DataFrame, dict]:
    """(text, y) of the sample, and the number of rows of each label; an id with several labels counts as toxic if one of them says so."""
    classes = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_class")).where("_class is not null").groupBy("_id").agg(
        (F.max("_class") > 0).cast("int").alias("_class"))
    some, counts = drawn(classes, documents)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(some), "_id")
    return rows.select("text", F.col("_class").alias("y")), counts


def vocabulary(train: DataFrame, size: int = VOCABULARY) -> np.ndarray:
    """The buckets whose document frequencies differ most between the labels, by a two-proportion z."""
    out = pa.schema([("bucket", pa.int64()), ("y", pa.int32()), ("n", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w = words_of(*utf8_buffer(batch["text"]))
            y = batch["y"].to_numpy(zero_copy_only=False)
            seen = np.unique(np.stack([w.doc, _buckets(w)], axis=1), axis=0)
            key, n = np.unique(seen[:, 1] * 2 + (y[seen[:, 0]] > 0), return_counts=True)
            yield batch_of(out, bucket=key // 2, y=(key % 2).astype(np.int32), n=n)

    total = {r["y"]: r["n"] for r in train.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    n0, n1 = float(total.get(0, 0)) + 1, float(total.get(1, 0)) + 1
    counts = train.select("text", "y").mapInArrow(work, "bucket long, y int, n long").groupBy("bucket").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("c1"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("c0"))
    p = (F.col("c1") + F.col("c0")) / (n0 + n1)
    z = (F.col("c1") / n1 - F.col("c0") / n0) / F.sqrt((p * (1 - p) + 1e-9) * (1 / n0 + 1 / n1))
    best = counts.select("bucket", z.alias("z")).where(F.abs("z") > 2).orderBy(F.abs("z").desc(), "bucket").limit(size)
    return np.array(sorted(r["bucket"] for r in best.collect()), dtype=np.int64)


def bags(train: DataFrame, vocab: np.ndarray) -> list:
    """(y, sentences, sentence of each feature, feature) of every training document."""
    out = pa.schema([("y", pa.int32()), ("sentences", pa.int64()), ("sentence", pa.list_(pa.int32())), ("feature", pa.list_(pa.int32()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w = words_of(*utf8_buffer(batch["text"]))
            s, b = _sentences(w, w.first), _buckets(w)
            at = np.minimum(np.searchsorted(vocab, b), max(0, len(vocab) - 1))
            known = vocab[at] == b if len(vocab) else np.zeros(len(b), bool)
            n, sent, feat = [], [], []
            for row in range(len(batch)):
                i, j = w.first[row], w.first[row + 1]
                own = known[i:j]
                n.append(int(s[j - 1] - s[i] + 1) if j > i else 0)
                sent.append((s[i:j] - s[i])[own].astype(np.int32) if j > i else [])
                feat.append(at[i:j][own].astype(np.int32))
            yield batch_of(out, y=batch["y"], sentences=n, sentence=sent, feature=feat)

    return train.mapInArrow(work, "y int, sentences long, sentence array<int>, feature array<int>").collect()


def fit(rows: list, vocab: np.ndarray, counts: dict, steps: int = 400, rate: float = 0.1, decay: float = 2e-3) -> Model:
    """Adam on the noisy-or loss, with weights kept small; deterministic. The labels were drawn alike and are weighted back to
    their true shares. Without both labels the score is the base rate."""
    weights = np.zeros(1 << BUCKET_BITS, np.float32)
    y = np.array([r["y"] for r in rows], dtype=float)
    if not len(y) or y.min() == y.max() or not len(vocab):
        base = float(y.mean()) if len(y) else 0.0
        return Model(float(np.log((base + 1e-3) / (1 - base + 1e-3))), weights)
    share = np.array([counts[int(k)] / max(1, (y == k).sum()) for k in y])
    share /= share.sum()
    n = np.array([r["sentences"] for r in rows])
    base = np.concatenate([[0], np.cumsum(n)])
    feature = np.concatenate([np.asarray(r["feature"], dtype=np.int64) for r in rows])
    sentence = np.concatenate([np.asarray(r["sentence"], dtype=np.int64) + b for r, b in zip(rows, base)])
    doc = np.repeat(np.arange(len(y)), n)
    theta, m, v = np.zeros(len(vocab) + 1), np.zeros(len(vocab) + 1), np.zeros(len(vocab) + 1)
    theta[-1] = -6.0
    for t in range(1, steps + 1):
        logit = np.bincount(sentence, theta[feature], minlength=base[-1]) + theta[-1]
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        none = np.exp(np.bincount(doc, np.log1p(-p * (1 - 1e-9)), minlength=len(y)))  # no sentence is toxic
        # d loss / d log(none): 1 for a clean bag, -none / (1 - none) for a toxic one; d log(1 - p) / d logit = -p.
        outer = np.where(y > 0, none / np.maximum(1 - none, 1e-6), -1.0) * share
        g = -outer[doc] * p
        grad = np.append(np.bincount(feature, g[sentence], minlength=len(vocab)), g.sum())
        grad[:-1] += decay / len(vocab) * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    weights[vocab] = theta[:-1]
    return Model(float(theta[-1]), weights)


def train_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on a bounded sample of ``labels``, with the texts of ``docs``; the caller leaves out of ``labels`` what is held out."""
    train, counts = training_rows(docs, labels, id_col, text_col, label_col)
    vocab = vocabulary(train)
    return fit(bags(train, vocab), vocab, counts)


_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("sentences", pa.list_(pa.struct([
    ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))])


def _judged(texts: pa.Array, model: Model, at_least: float) -> tuple[np.ndarray, list[list[dict]]]:
    """Scores of texts, and their sentences that score ``at_least``."""
    data, offsets = utf8_buffer(texts)
    w = words_of(data, offsets)
    spans: list[list[dict]] = [[] for _ in range(len(texts))]
    if not len(w.start):
        return np.zeros(len(texts)), spans
    s = _sentences(w, offsets)
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    last = np.append(first[1:], len(s)) - 1
    p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(model.weights[_buckets(w)].astype(float), first) + model.bias, -30, 30)))
    total = np.bincount(w.doc[first], np.log1p(-p * (1 - 1e-12)), minlength=len(texts))
    for i in np.flatnonzero(p >= at_least).tolist():
        a, b, row = int(w.start[first[i]]), int(w.end[last[i]]), int(w.doc[first[i]])
        before = len(data[offsets[row]: a].tobytes().decode())
        spans[row].append({"start": before, "end": before + len(data[a:b].tobytes().decode()), "score": float(p[i])})
    return -np.expm1(total), spans


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under ``limit``, whole, in one pass without a join; texts without words stay."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            yield batch.filter(pa.array(_judged(batch[text_col], known.value, 2.0)[0] < limit))

    return docs.mapInArrow(work, docs.schema)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", at_least: float = 0.5) -> DataFrame:
    """(doc_id, score, sentences): one row per input row.

    sentences are those that score ``at_least`` by themselves: code points from the first word to the end of the last.
    A text without words has the score 0 and no sentences, NULL included. Columns other than the two named are not read.
    Repeated rows and rows with a NULL id are answered one by one; an empty table gives no rows.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)  # the weight table has a fixed size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores, spans = _judged(batch["text"], known.value, at_least)
            yield batch_of(_SCORED, doc_id=batch["doc_id"], score=scores, sentences=spans)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        work, "doc_id long, score double, sentences array<struct<start:long,end:long,score:double>>")
