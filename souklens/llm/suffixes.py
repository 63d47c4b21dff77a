"""Exact removal of repeated byte strings by a distributed merge sort of suffixes that knows their common prefixes.

Which suffixes. Every string of ``length`` bytes holds one anchor: the place of its least hashed GRAM bytes. Equal strings hold
their anchors at equal offsets, so it is enough to sort the suffixes that start at anchors, one in about 37 bytes. An anchor stands for the
run of string starts that chose it; its suffix ends with the last of these strings, and the bytes before it back to the first start are
its left context. Anchors whose gram stands nowhere else (counted over all documents) are left out.

The sort. A task sorts the suffixes of a run of its input, merges equal ones at once (all but the first are repeats), deals them by the
hash of their gram, and sends each part front-coded: the length of the prefix shared with the suffix before, and the rest. The
receiving task merges its runs by a loser tree: the common prefix with the last winner is known for every player,
longer ones win unseen, and equal ones are compared from there on, so no byte of a known prefix is read again.

Repeats. In the merged order the suffixes of one gram are neighbours, and the common prefixes give their classes at every depth; the left
contexts get theirs in the same way. A string that reaches ``d`` bytes left of the anchor repeats another exactly if both classes agree, at d and
length - d. The first of each pair of classes stays.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from souklens.llm.common import batch_of, bit_table, in_bit_table, slices, utf8_buffer
from souklens.session import checkpointed

GRAM = 28
LOG2_BITS = 27  # of the table of repeated grams
RUN_BYTES = 14 << 20  # text of a sorted run, about
SLICE = 1 << 19  # text hashed at a time; the work arrays take about 100 times as much
PART_BYTES = 24 << 20  # text for which a part of the merge is meant
BLOCK = 50_000  # merged suffixes judged at a time; a gram is never split
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACE = np.uint64(24)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A mixed 64-bit hash of the ``gram`` bytes from each byte on."""
    if len(data) < gram:
        return np.zeros(0, np.uint64)
    power, back = np.full((2, len(data) + 1), _BASE)
    back[:] = _INVERSE
    power[0] = back[0] = 1
    np.cumprod(power, out=power)
    np.cumprod(back, out=back)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
    h = (total[gram:] - total[:-gram]) * back[: len(data) - gram + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, hash, first start, last start, anchor) of every run of string starts with the same anchor; places in ``data``."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none.astype(np.uint64), none, none, none
    h, width = gram_hashes(data, gram), length - gram + 1
    place_bits = max(_PLACE, np.uint64(int(len(data)).bit_length()))
    value = (h >> place_bits << place_bits) | np.arange(len(h), dtype=np.uint64)
    tiles = np.concatenate([value, np.full(-len(value) % width, np.iinfo(np.uint64).max)]).reshape(-1, width)
    ahead = np.minimum.accumulate(tiles, axis=1).ravel()
    behind = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(value) - width + 1
    least = np.minimum(behind[:n], ahead[width - 1: width - 1 + n])
    anchor = (least & ((np.uint64(1) << place_bits) - np.uint64(1))).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start = np.flatnonzero(row[:n] == row[length - 1: length - 1 + n])
    if not len(start):
        return none, none.astype(np.uint64), none, none, none
    anchor = anchor[start]
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (row[start[1:]] != row[start[:-1]]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return row[start[first]], h[anchor[first]], start[first], start[last], anchor[first]


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are given."""
    n = min(len(a), len(b))
    while known < n and a[known: known + 16] == b[known: known + 16]:
        known += 16
    while known < n and a[known] == b[known]:
        known += 1
    return min(known, n)


# An entry is (suffix, left context reversed, doc, row, place of the anchor in its document).

def pack(entries: list[tuple]) -> bytes:
    """Sorted entries, front-coded and compressed."""
    shared, before = [], b""
    for e in entries:
        shared.append(common_prefix(before, e[0]))
        before = e[0]
    head = np.array([len(entries)], np.int64)
    sizes = np.array([[s, len(e[0]), len(e[1])] for s, e in zip(shared, entries)], np.int32)
    place = np.array([e[2:] for e in entries], np.int64)
    return zlib.compress(b"".join([head.tobytes(), sizes.tobytes(), place.tobytes(), b"".join([e[0][s:] for s, e in zip(shared, entries)]), b"".join([e[1] for e in entries])]), 1)


def unpack(blob: bytes) -> Iterator[tuple[int, tuple]]:
    """(prefix shared with the entry before, entry)."""
    blob = zlib.decompress(blob)
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    sizes = np.frombuffer(blob, np.int32, 3 * n, 8).reshape(n, 3).tolist()
    place = np.frombuffer(blob, np.int64, 3 * n, 8 + 12 * n).reshape(n, 3).tolist()
    at = 8 + 36 * n
    left = at + sum(size - shared for shared, size, _ in sizes)
    suffix = b""
    for (shared, size, back), (doc, row, anchor) in zip(sizes, place):
        suffix = suffix[:shared] + blob[at: at + size - shared]
        at += size - shared
        yield shared, (suffix, blob[left: left + back], doc, row, anchor)
        left += back


def merge(runs: list[Iterator[tuple[int, tuple]]]) -> Iterator[tuple[int, tuple]]:
    """Loser tree over front-coded runs: (prefix shared with the entry put out before, entry), by suffix."""
    k = 1 << max(0, (len(runs) - 1).bit_length())
    players = [iter(r) for r in runs] + [iter(()) for _ in range(k - len(runs))]
    entry: list[tuple | None] = [None] * k
    known = [0] * k  # prefix shared with the last winner
    for i, p in enumerate(players):
        _, entry[i] = next(p, (0, None))

    def game(i: int, j: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix becomes the one that it shares with the winner."""
        a, b = entry[i], entry[j]
        if a is None:
            return j, i
        if b is None or known[i] > known[j]:
            return i, j
        if known[i] < known[j]:
            return j, i
        x, y = a[0], b[0]
        n = common_prefix(x, y, known[i])
        if n == len(x) or n < len(y) and x[n] < y[n]:
            known[j] = n
            return i, j
        known[i] = n
        return j, i

    losers = [0] * k
    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = game(winners[2 * node], winners[2 * node + 1])
    top = winners[1] if k > 1 else 0
    while entry[top] is not None:
        yield known[top], entry[top]
        known[top], entry[top] = next(players[top], (0, None))
        node = (top + k) >> 1
        while node:
            top, losers[node] = game(top, losers[node])
            node >>= 1


def _span(entry: tuple, length: int) -> tuple:
    """All strings of an entry: (doc, row, start, end)."""
    suffix, left, doc, row, anchor = entry
    return doc, row, anchor - len(left), anchor + len(suffix)


def judge(shared: list[int], entries: list[tuple], length: int, gram: int = GRAM) -> Iterator[tuple]:
    """Spans (doc, row, start, end) of all strings in the merged entries that also start earlier; whole grams only."""
    kept: list[int] = []
    first: dict[tuple[int, bytes], int] = {}
    number, before = 0, None
    entries = list(entries)
    for i, e in enumerate(entries):
        if e[0] != before:
            number, before = number + 1, e[0]
        slot = first.setdefault((number, e[1]), i)
        if slot == i:
            kept.append(i)
            continue
        if e[2:] < entries[slot][2:]:
            entries[slot], e = e, entries[slot]
        yield _span(e, length)
    lcp = np.array([shared[i] for i in kept])
    group = np.cumsum(lcp < gram)
    several = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
    lcp, group = lcp[several], group[several]
    some = [entries[i] for i, s in zip(kept, several.tolist()) if s]
    if not some:
        return
    n, most = len(some), length - gram
    size, back = np.array([len(e[0]) for e in some]), np.array([len(e[1]) for e in some])
    context = np.zeros((n, -(-max(1, most) // 8) * 8), np.uint8)
    flat = np.frombuffer(b"".join([e[1] for e in some]), np.uint8)
    context[np.arange(context.shape[1]) < back[:, None]] = flat
    order = np.lexsort((back, *context.view(">u8").T[::-1], group))
    x, y = context[order[1:]], context[order[:-1]]
    differ = np.concatenate([x != y, np.ones((n - 1, 1), bool)], axis=1).argmax(axis=1)
    left_lcp = np.append(-1, np.where(group[order[1:]] == group[order[:-1]], np.minimum(differ, np.minimum(back[order[1:]], back[order[:-1]])), -1))
    age = np.lexsort(tuple(np.array([e[c] for e in some]) for c in (4, 3, 2)))
    repeated = np.zeros((n, most + 1), bool)
    left_class = np.empty(n, np.int64)
    for d in range(most + 1):
        fit = (back >= d) & (size >= length - d)
        if not fit.any():
            continue
        left_class[order] = np.cumsum(left_lcp < d)
        key = np.cumsum(lcp < length - d) * (n + 1) + left_class
        oldest = age[fit[age]]
        _, at = np.unique(key[oldest], return_index=True)
        repeated[oldest, d] = True
        repeated[oldest[at], d] = False
    for i in np.flatnonzero(repeated.any(axis=1)).tolist():
        _, _, doc, row, anchor = some[i]
        d = np.flatnonzero(repeated[i])
        for part in np.split(d, np.flatnonzero(np.diff(d) > 1) + 1):
            yield doc, row, anchor - int(part[-1]), anchor - int(part[0]) + length


# Rows of a task: a span of repeats without a run, or a run of a part, with zeros for the span.
_SPANS = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("part", pa.int32()), ("run", pa.binary())])
_SPAN_SQL = "doc long, row long, start long, end long, part int, run binary"


def _joined(spans: list[tuple]) -> list[tuple]:
    """Spans of a document that touch or overlap become one."""
    out: list[tuple] = []
    for s in sorted(spans):
        if out and out[-1][:2] == s[:2] and s[2] <= out[-1][3]:
            out[-1] = (*out[-1][:3], max(out[-1][3], s[3]))
        else:
            out.append(s)
    return out


def repeated_spans(rows: DataFrame, length: int = 100) -> DataFrame:
    """(doc, row, start, end) in bytes, overlapping: all strings of ``length`` bytes in rows (doc, row, text) that also start earlier,
    by doc, row and start."""
    spark = rows.sparkSession
    grams = pa.schema([("gram", pa.int32()), ("n", pa.int32())])  # counted by the leading 32 bits of the hash, which is less to send

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            gram, n = np.unique((anchors(*utf8_buffer(batch["text"]), length)[1] >> np.uint64(32)).astype(np.uint32), return_counts=True)
            yield batch_of(grams, gram=gram.view(np.int32), n=n.astype(np.int32))

    repeated = rows.select("text").mapInArrow(count, "gram int, n int").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1")
    repeated = repeated.select(F.shiftleft(F.col("gram").cast("long"), 32).alias("gram"))
    wanted = spark.sparkContext.broadcast(bit_table(repeated, "gram", LOG2_BITS))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(6, -(-total // PART_BYTES))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[bytes, int], tuple] = {}
        spans: list[tuple] = []
        taken = 0

        def flush() -> Iterator[pa.RecordBatch]:
            dealt: dict[int, list[tuple]] = {}
            while found:  # the table shrinks as the parts grow
                (text, back), (doc, row, anchor, gram) = found.popitem()
                dealt.setdefault(gram % parts, []).append((text[back:], text[:back][::-1], doc, row, anchor))
            for part in sorted(dealt):
                yield batch_of(_SPANS, doc=[0], row=[0], start=[0], end=[0], part=[part], run=[pack(sorted(dealt.pop(part), key=lambda e: e[0]))])
            for at in range(0, len(joined := _joined(spans)), 50_000):
                doc, row, start, end = zip(*joined[at: at + 50_000])
                yield batch_of(_SPANS, doc=doc, row=row, start=start, end=end, part=[d % parts for d in doc], run=[None] * len(doc))

        for batch in slices(batches, limit=SLICE):
            data, offsets = utf8_buffer(batch["text"])
            at, gram, low, high, anchor = anchors(data, offsets, length)
            some = in_bit_table(wanted.value, gram)
            text, doc, row = data.tobytes(), batch["doc"].to_numpy(), batch["row"].to_numpy()
            at = at[some]
            for i, j, k, g, d, r, o in zip(low[some].tolist(), anchor[some].tolist(), (high[some] + length).tolist(), gram[some].tolist(),
                                           doc[at].tolist(), row[at].tolist(), offsets[at].tolist()):
                key = (text[i:k], j - i)
                new = (d, r, j - o, g)
                old = found.get(key)
                if old is None or new < old:
                    found[key] = new
                    new = old
                if new is not None:
                    start = new[2] - (j - i)
                    spans.append((new[0], new[1], start, start + k - i))
            taken += len(data)
            if taken >= RUN_BYTES:
                yield from flush()
                found, spans, taken = {}, [], 0
        yield from flush()

    dealt = rows.select("doc", "row", "text").mapInArrow(runs, _SPAN_SQL)

    def combine(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf["run"].isna()
        spans = list(pdf.loc[known, ["doc", "row", "start", "end"]].itertuples(index=False, name=None))
        shared, entries = [], []
        for lcp, entry in merge([unpack(b) for b in pdf.loc[~known, "run"]]):
            if lcp < GRAM and len(entries) >= BLOCK:
                spans += judge(shared, entries, length)
                shared, entries = [], []
            shared.append(lcp)
            entries.append(entry)
        spans += judge(shared, entries, length)
        return pd.DataFrame(_joined(spans), columns=["doc", "row", "start", "end"], dtype="int64")

    return dealt.groupBy("part").applyInPandas(combine, "doc long, row long, start long, end long")


_CUT = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _cut(rows: DataFrame, spans: DataFrame, keep_bytes: bool) -> DataFrame:
    """(doc, row, n_removed, n_spans, kept_sha256, kept) of the rows that have spans. A bit table of their keys keeps the other
    texts out of the join."""
    key = F.xxhash64("doc", "row").alias("key")
    touched = rows.sparkSession.sparkContext.broadcast(bit_table(spans.select(key), "key", LOG2_BITS))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bit_table(touched.value, batch["key"].to_numpy().view(np.uint64)))).select(["doc", "row", "text"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = utf8_buffer(batch["text"])
            removed, pieces, digests, kept = [], [], [], []
            for i, own_spans in enumerate(batch["spans"].to_pylist()):
                own = data[offsets[i]: offsets[i + 1]]
                gone = np.zeros(len(own) + 1, np.int32)
                for s in own_spans:
                    gone[s["start"]] += 1
                    gone[s["end"]] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                removed.append(int(gone.sum()))
                pieces.append(int((gone & ~np.append(False, gone[:-1])).sum()))
                rest = own[~gone].tobytes()
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest if keep_bytes else None)
            yield batch_of(_CUT, doc=batch["doc"], row=batch["row"], n_removed=removed, n_spans=pieces, kept_sha256=digests, kept=kept)

    texts = rows.select("doc", "row", "text", key).mapInArrow(some, "doc long, row long, text string")
    return texts.join(spans, ["doc", "row"]).select("doc", "row", "text", "spans").mapInArrow(
        work, "doc long, row long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, keep_bytes: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): one row per input row, over the UTF-8 bytes of the texts.

    Every byte goes that is covered by ``length`` bytes which also start earlier: in a smaller id, or in the same document before. kept holds the
    bytes that stay (NULL without ``keep_bytes``). NULL is the empty text. Rows that share an id come one after the other, in an
    order that is fixed by writing the table first; NULL ids come last. Columns other than the two named are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("doc"),
                       F.lit(0).cast("long").alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    if not rows.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        rows = checkpointed(rows.withColumn("row", F.monotonically_increasing_id()))
    spans = checkpointed(repeated_spans(rows, length).groupBy("doc", "row").agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    raw = F.col("text").cast("binary")
    whole = rows.select("id", "doc", "row", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("whole"),
                        (raw if keep_bytes else F.lit(None).cast("binary")).alias("bytes"))
    cut = _cut(rows, spans, keep_bytes)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return whole.join(cut, ["doc", "row"], "left").select(
        F.col("id").alias("doc_id"), "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"), F.coalesce("kept", "bytes").alias("kept"))
