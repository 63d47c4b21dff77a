"""Ranked lexical search by the Best Position Algorithm over impact lists.

Documents are scanned once for the terms of a block of items; what is kept is a table of (document, length, terms, frequencies). From it
come the counts of the whole corpus, and then every task turns its documents into shards of impact lists, one list for each term,
highest impact first. For an item a shard is read from the first position of each list that has not been seen; every document met
there is looked up in all lists of the item, which gives its whole score and marks its position in each of them. The best position
of a list is the end of its unbroken run of seen positions. A document not yet met stands behind the best position of every list,
so the sum of the impacts just behind them bounds its score. A shard is left when that bound is strictly below the k-th best score that
the task knows for the item (an equal one could still win by its smaller id). Every task keeps k documents for each item.

Items are worked off in blocks of about ENTRIES (item, term) pairs; a block's terms and weights are all that is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from souklens.llm.common import batch_of, slices, utf8_buffer
from souklens.llm.words import words_of
from souklens.session import checkpointed

ENTRIES = 1 << 20  # (item, term) pairs of a block of items
CELLS = 1 << 23  # documents x terms of the direct-access table of a shard
GROUP = 2048  # distinct terms of the items that share such a table; one item of more terms has a table of its own
SHARD_POSTINGS = 1 << 21
STEP = 8  # positions read from each list at first; doubled with every turn
_BITS = 22  # of the table that lets only few foreign words through to the search in the block's terms

_ITEMS = pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("terms", pa.list_(pa.int64()))])
_POSTINGS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])
_FOUND = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
_NO_ID = np.iinfo(np.int64).max


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_id, terms): one numbered row per item with the distinct terms of its text, as 64-bit hashes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w = words_of(*utf8_buffer(batch["text"]))
            h = w.hashes().view(np.int64)
            yield batch_of(_ITEMS, item=batch["item"], item_id=batch["item_id"], terms=[np.unique(h[a:b]) for a, b in zip(w.first, w.first[1:])])

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, "item long, item_id long, terms array<long>")


def postings(docs: DataFrame, vocabulary: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs): one row per document with its number of words and, for those in the sorted ``vocabulary`` of word hashes, their
    places there and frequencies."""
    near = np.zeros(1 << _BITS, bool)
    near[vocabulary >> np.uint64(64 - _BITS)] = True
    known = docs.sparkSession.sparkContext.broadcast((vocabulary, near))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, near = known.value
        for batch in slices(batches):
            w = words_of(*utf8_buffer(batch["text"]))
            h = w.hashes()
            at = np.flatnonzero(near[h >> np.uint64(64 - _BITS)])
            place = np.searchsorted(terms, h[at])
            hit = terms[np.minimum(place, len(terms) - 1)] == h[at]
            keys, tfs = np.unique(w.doc[at[hit]].astype(np.int64) * len(terms) + place[hit], return_counts=True)
            ends = np.searchsorted(keys, np.arange(len(batch) + 1, dtype=np.int64) * len(terms)).astype(np.int32)
            yield batch_of(_POSTINGS, doc_id=batch["doc_id"], n=np.diff(w.first), terms=pa.ListArray.from_arrays(ends, (keys % len(terms)).astype(np.int32)),
                           tfs=pa.ListArray.from_arrays(ends, tfs.astype(np.int32)))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        work, "doc_id long, n long, terms array<int>, tfs array<int>")


def document_counts(found: DataFrame, terms: int) -> DataFrame:
    """(term, df) of a table of postings; a task adds up its rows first."""
    out = pa.schema([("term", pa.int32()), ("df", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            total += np.bincount(batch["terms"].flatten().to_numpy(), minlength=terms)
        some = np.flatnonzero(total)
        yield batch_of(out, term=some.astype(np.int32), df=total[some])

    return found.select("terms").mapInArrow(work, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


class Best:
    """The k best (score, doc_id) so far: highest score first, then the smaller id; a missing id is the largest."""

    def __init__(self, k: int):
        self.k, self.score, self.doc = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def bar(self) -> int:
        """The k-th best score; 0 while there are fewer."""
        return int(self.score[-1]) if len(self.score) == self.k else 0

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        some = score >= max(1, self.bar())
        if some.any():
            score, doc = np.concatenate([self.score, score[some]]), np.concatenate([self.doc, doc[some]])
            first = np.lexsort((doc, -score))[: self.k]
            self.score, self.doc = score[first], doc[first]


class Lists:
    """Impact lists of some documents over the terms of a group of items, and direct access to a document's place in each."""

    def __init__(self, docs: np.ndarray, doc: np.ndarray, term: np.ndarray, factor: np.ndarray, terms: int):
        """``docs`` are the ids; a posting is (``doc``, ``term``, ``factor``), doc counted from 0."""
        order = np.lexsort((doc, -factor, term))
        self.docs, self.at, self.factor = docs, doc[order], factor[order]
        self.start = np.searchsorted(term[order], np.arange(terms + 1))
        self.of = np.zeros((terms, len(docs)), np.int32)
        self.place = np.zeros((terms, len(docs)), np.int32)
        self.of[term[order], self.at] = self.factor
        self.place[term[order], self.at] = np.arange(len(order)) - self.start[term[order]]

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> int:
        """Put the documents that belong to the best for an item into ``best``; gives the number of documents scored."""
        size = self.start[terms + 1] - self.start[terms]
        terms, weights, size = terms[size > 0], weights[size > 0], size[size > 0]
        start, first = self.start[terms], np.cumsum(np.append(0, size + 1))  # one more place, never seen, ends each list
        seen, met = np.zeros(first[-1], bool), np.zeros(len(self.docs), bool)
        behind = np.zeros(len(terms), np.int64)  # the first position not seen
        step, scored = STEP, 0
        while True:
            left = behind < size
            bound = int((weights[left] * self.factor[(start + behind)[left]]).sum())
            if bound < max(1, best.bar()):
                return scored
            read = behind[:, None] + np.arange(step)
            docs = self.at[(start[:, None] + read)[read < size[:, None]]]
            docs = np.unique(docs[~met[docs]])
            met[docs] = True
            scored += len(docs)
            factors = self.of[terms[:, None], docs].astype(np.int64)
            best.add((weights[:, None] * factors).sum(axis=0), self.docs[docs])
            t, d = np.nonzero(factors)
            seen[first[t] + self.place[terms[t], docs[d]]] = True
            for i in np.flatnonzero(left):
                behind[i] += int(seen[first[i] + behind[i]: first[i + 1]].argmin())
            step *= 2


def _groups(terms: list[np.ndarray]) -> list[list[int]]:
    """Items in runs that have at most GROUP distinct terms together; an item of more stands alone."""
    runs, now, known = [], [], set()
    for i, own in enumerate(terms):
        if now and len(known | set(own.tolist())) > GROUP:
            runs.append(now)
            now, known = [], set()
        now.append(i)
        known |= set(own.tolist())
    return runs + [now] if now else runs


def _search_block(found: DataFrame, items: list, vocabulary: int, weights: np.ndarray, n: int, words: int, k: int) -> DataFrame:
    """(item, doc_id, score): for every item the best rows of each task. ``items`` are (item, places of its terms)."""
    terms = [t for _, t in items]
    known = found.sparkSession.sparkContext.broadcast(([i for i, _ in items], terms, _groups(terms), weights))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, terms, groups, weights = known.value
        best = [Best(k) for _ in names]

        def shard(docs, length, ends, term, tf):
            m = 10 + (90 * length * n) // words
            doc = np.repeat(np.arange(len(docs)), np.diff(ends))
            factor = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
            for group in groups:
                own = np.unique(np.concatenate([terms[i] for i in group]))
                place = np.full(vocabulary, -1, np.int64)
                place[own] = np.arange(len(own))
                size = max(64, CELLS // max(1, len(own)))
                for a in range(0, len(docs), size):
                    b = min(a + size, len(docs))
                    t = place[term[ends[a]: ends[b]]]
                    inside = t >= 0
                    lists = Lists(docs[a:b], doc[ends[a]: ends[b]][inside] - a, t[inside], factor[ends[a]: ends[b]][inside], len(own))
                    for i in group:
                        lists.search(place[terms[i]], weights[terms[i]], best[i])

        def emptied(kept: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(kept).combine_chunks()
            column = lambda name: pa.concat_arrays(rows[name].chunks)
            lists = column("terms")
            shard(column("doc_id").fill_null(int(_NO_ID)).to_numpy(), column("n").to_numpy(), lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py(),
                  lists.flatten().to_numpy().astype(np.int64), column("tfs").flatten().to_numpy().astype(np.int64))

        kept, load = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append(batch)
            load += len(batch["terms"].flatten()) + batch.num_rows
            if load >= SHARD_POSTINGS:
                emptied(kept)
                kept, load = [], 0
        if kept:
            emptied(kept)
        for name, b in zip(names, best):
            if len(b.score):
                yield batch_of(_FOUND, item=np.full(len(b.score), name), doc_id=pa.array(b.doc, mask=b.doc == _NO_ID), score=b.score)

    return found.where(F.size("terms") > 0).mapInArrow(work, "item long, doc_id long, score long")


def term_weight(n: int, df: Column) -> Column:
    """floor(1000 * ln((2n + 2) / (2 df + 1))), in doubles."""
    return F.floor(1000 * F.log(F.lit(float(2 * n + 2)) / (2 * df + 1).cast("double"))).cast("long")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                   item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents of every item with a score above 0, fewer if there are
    fewer; equal scores by ascending doc_id.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z in lower case; they are told apart by 64-bit hashes. NULL
    and empty texts have none: such documents count nowhere, such items have no rows, and neither has any item if no document has
    a term. Rows that repeat are answered and ranked one by one, in both tables. A NULL doc_id is ranked behind all others of its score; a NULL
    item_id is answered under NULL. Columns other than those named are not read.
    """
    spark = docs.sparkSession
    queries = checkpointed(item_terms(items, item_col, item_text_col).where(F.size("terms") > 0))
    blocks = -(-int(queries.agg(F.sum(F.size("terms"))).first()[0] or 0) // ENTRIES)
    answers = []
    for block in range(blocks):
        own = [(r["item"], np.array(r["terms"], np.int64).view(np.uint64)) for r in queries.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()]
        if not own:
            continue
        vocabulary = np.unique(np.concatenate([t for _, t in own]))
        found = checkpointed(postings(docs, vocabulary, id_col, text_col))
        total = found.where("n > 0").agg(F.count("*").alias("n"), F.sum("n").alias("words")).first()
        if not total["n"]:
            continue
        weights = np.zeros(len(vocabulary), np.int64)
        for r in document_counts(found, len(vocabulary)).select("term", term_weight(total["n"], F.col("df")).alias("w")).collect():
            weights[r["term"]] = r["w"]
        places = [(i, np.searchsorted(vocabulary, t)) for i, t in own]
        answers.append(_search_block(found, places, len(vocabulary), weights, total["n"], total["words"], k))
    best = reduce(DataFrame.unionByName, answers) if answers else spark.createDataFrame([], "item long, doc_id long, score long")
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(queries.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
