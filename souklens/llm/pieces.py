"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Four machines are compiled from the model, with weights in the tropical semiring (sums along a path, the least over paths):

* the normaliser, of one state: a space becomes the mark, other characters stay, and an arc without input adds the leading mark;
* the pieces, a trie: from its root a path spells a piece, and the arc back to the root gives its id and weight. In a unigram model that
  is its negative score; in a BPE model, whose scores are ranks, the negative logarithm of Zipf's law, log(rank + 2);
* byte fallback: a character without a piece goes from the root to itself, gives its bytes and weighs more than any piece;
* for BPE, where merges make the segmentation depend on more than a sum, an acceptor whose state is the last piece: its arc from piece a
  to piece b weighs 0 if merging the characters of a and b gives just (a, b), and infinity otherwise. A sequence is the
  model's segmentation exactly if its first piece merges from its characters and all adjacent pairs are accepted.

An input is composed with the first three to a lattice; its distances to the end, in the (min, +) semiring, are the potential by which the
composition with the acceptor is expanded, the most promising state first (A*), so that few of its arcs are ever asked for.

The input is cut where no piece of the model can cross, which is found from the pieces when the model is compiled; each part has
its own shortest path, and parts that come again are remembered in a table of bounded size.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from souklens.llm.common import batch_of, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
WORDS, PARTS, PAIRS = 100_000, 250_000, 250_000  # kept in two generations
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values: piece types
UNIGRAM, BPE = 1, 2  # fixed values: model types
UNKNOWN_WEIGHT = 10.0  # fixed value: what an unknown character weighs beyond the heaviest piece


class Recent(dict):
    """A dictionary of at most about twice ``limit`` entries: a full generation replaces the older one."""

    def __init__(self, compute, limit: int):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Transducer:
    """The compiled model. Unigram and BPE models with byte fallback and the identity normaliser are taken; others raise."""

    def __init__(self, model: bytes, remembered: int = PARTS):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto.FromString(model)
        norm, kind = proto.normalizer_spec, proto.trainer_spec.model_type
        if kind not in (UNIGRAM, BPE) or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("a unigram or BPE model with the identity normaliser is needed")
        self.prefix, self.spaces = MARK if norm.add_dummy_prefix else "", {" ": MARK}  # the normaliser's arcs that change something
        self.id = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.score = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        if len(self.byte) != 256 or any(p.type in (USER, UNUSED) for p in proto.pieces):
            raise ValueError("all 256 byte pieces are needed, and neither user-defined nor unused pieces")
        weight = {p: -s if kind == UNIGRAM else math.log(2 + max(0.0, -s)) for p, s in self.score.items()}
        self.fallback = max(weight.values(), default=0.0) + UNKNOWN_WEIGHT
        # The trie: a state is (states by next character, weight and name of the piece that ends there, or none).
        self.trie: dict[str, tuple[dict, float, str]] = {}
        for piece, w in weight.items():
            state = self.trie
            for c in piece[:-1]:
                state = state.setdefault(c, ({}, 0.0, ""))[0]
            state[piece[-1]] = (state.get(piece[-1], ({},))[0], w, piece)
        # A byte piece decodes to its character or, above ASCII, to the stand-in that "surrogateescape" turns into the byte.
        self.text = [p.piece.replace(MARK, " ") if p.type == NORMAL else "" for p in proto.pieces]
        for b, i in self.byte.items():
            self.text[i] = chr(b if b < 128 else 0xDC00 + b)
        self.within, self.parts = self._cuts()
        self.adjacent = Recent(self._adjacent_weight, min(PAIRS, remembered)) if kind == BPE else None
        self.paths = Recent(self._shortest_path, remembered)
        self.words = Recent(self._word_path, min(WORDS, remembered))

    def _cuts(self):
        """Functions that cut a marked word, and a marked text, into parts that no piece crosses: before a run of marks, and
        after letters that no piece continues by anything but a letter. None if pieces hold marks inside words."""
        letter = re.compile(r"[^\W\d_]")
        follow = {(a, b) for p in self.id for a, b in zip(p, p[1:])}
        if any(a != MARK and b == MARK for a, b in follow):
            return None, lambda text: [text]
        crossed = re.escape("".join(sorted({a for a, b in follow if letter.match(a) and not letter.match(b)})))
        word = re.compile(rf"[\W\d_{crossed}]*[^\W\d_{crossed}]+|[\W\d_{crossed}]+").findall
        marked = re.compile(rf"{MARK}+[^{MARK}]*|[^{MARK}]+").findall
        return word, lambda text: [p for m in marked(text) for p in word(m)]

    def _merged(self, text: str) -> list[str]:
        """The model's merges on a short text: the best-scored adjacent pair first, the leftmost of equals."""
        now = list(text)
        while len(now) > 1:
            best, at = None, -1
            for i in range(len(now) - 1):
                s = self.score.get(now[i] + now[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            now[at: at + 2] = [now[at] + now[at + 1]]
        return now

    def _adjacent_weight(self, pair: tuple[str, str]) -> float:
        """The acceptor's arc from its state ``a`` (empty: its start) by piece ``b``."""
        a, b = pair
        return 0.0 if a + b not in self.id and self._merged(a + b) == [a, b] or not a and self._merged(b) == [b] else math.inf

    def lattice(self, part: str) -> tuple[list[list[tuple[float, int, str, float]]], list[float]]:
        """The normalised input composed with pieces and byte fallback: for each position its arcs (weight from there to the end over
        the arc, end of the arc, piece, weight), and the least weight from each position to the end."""
        root, n = self.trie, len(part)
        arcs, rest = [[]] * n, [0.0] * (n + 1)
        for at in range(n - 1, -1, -1):
            here, states, end = [], root, at
            while end < n and (state := states.get(part[end])):
                end += 1
                states, weight, piece = state
                if piece:
                    here.append((weight + rest[end], end, piece, weight))
            if not here or here[0][1] > at + 1:
                here.append((self.fallback + rest[at + 1], at + 1, part[at], self.fallback))
            arcs[at], rest[at] = here, min(here)[0]
        return arcs, rest

    def _shortest_path(self, part: str) -> tuple[int, ...]:
        """Ids on the path of least weight through the lattice and, in a BPE model, the acceptor."""
        arcs, rest = self.lattice(part)
        path = self._least_sum(arcs) if self.adjacent is None else self._least_accepted(arcs, rest)
        known = self.id
        try:
            return tuple([known[p] for p in path])
        except KeyError:  # bytes for what is no piece
            return tuple([i for p in path for i in ((known[p],) if p in known else [self.byte[b] for b in p.encode()])])

    def _least_sum(self, arcs: list) -> list[str]:
        """Relaxation from left to right; of equal sums the path stays whose last piece is the longest, as in the model's own library."""
        n = len(arcs)
        least, last = [0.0] + [math.inf] * n, [""] * (n + 1)
        for at in range(n):
            for _, end, piece, weight in arcs[at]:
                if least[at] + weight < least[end]:
                    least[end], last[end] = least[at] + weight, piece
        path = []
        while n:
            path.append(last[n])
            n -= len(last[n])
        return path[::-1]

    def _least_accepted(self, arcs: list, rest: list[float]) -> list[str]:
        """A* over (position, last piece) with the lattice's distances to the end as potential; arcs of the acceptor are asked for when
        a state comes up."""
        adjacent, n = self.adjacent, len(arcs)
        before: dict[tuple[int, str], str] = {}  # the piece before a state that is settled
        queue = [(far, -end, piece, "") for far, end, piece, _ in arcs[0]]
        queue.sort()
        while queue:
            total, end, piece, last = heappop(queue)
            if adjacent[last, piece]:  # infinite; the finite arcs weigh 0
                continue
            end = -end
            state = end, piece
            if state in before:
                continue
            before[state] = last
            if end == n:
                break
            done = total - rest[end]
            for far, to, other, _ in arcs[end]:
                heappush(queue, (done + far, -to, other, piece))
        else:
            raise ValueError("no path; the model's pieces can't be merged from characters")
        path = []
        while end:
            path.append(piece)
            piece, end = before[end, piece], end - len(piece)
        return path[::-1]

    def normalised(self, text: str) -> str:
        """The output of the normaliser: one state, so its composition with a text replaces characters one by one."""
        for space, mark in self.spaces.items():
            text = text.replace(space, mark)
        return self.prefix + text

    def _word_path(self, word: str) -> tuple[int, ...]:
        paths = self.paths
        return tuple([i for part in self.within(MARK + word) for i in paths[part]])

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        if self.within and self.prefix and "  " not in text and MARK not in text and text[0] != " " and text[-1] != " ":
            words = self.words  # one mark before each word: words are the unit that is remembered
            for word in text.split(" "):
                out += words[word]
            return out
        paths = self.paths
        for part in self.parts(self.normalised(text)):
            out += paths[part]
        return out

    def decode(self, ids: list[int]) -> str:
        out = "".join(map(self.text.__getitem__, ids))
        try:
            out.encode()
        except UnicodeEncodeError:
            out = out.encode(errors="surrogateescape").decode(errors="replace")
        return out[1:] if self.prefix and out.startswith(" ") else out


@lru_cache(maxsize=2)
def _compiled(model: bytes, remembered: int = PARTS) -> Transducer:
    return Transducer(model, remembered)


_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, remembered: int = PARTS) -> DataFrame:
    """(doc_id, ids, round_trip): one row per input row; ids equal those of the model's own library.

    ``remembered`` bounds the entries of a generation of each table that a worker keeps; fewer take less memory and more time.
    round_trip tells that decoding gives the text back (the mark U+2581 itself decodes as a space, as the model defines).
    NULL gives NULL ids and a true round trip, the empty text no ids. The model is read on the driver and sent as it is (its
    size is fixed); columns other than the two named are not read.
    """
    with open(model, "rb") as f:
        known = docs.sparkSession.sparkContext.broadcast(f.read())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wfst = _compiled(known.value, remembered)
        for batch in slices(batches):
            texts = batch["text"].to_pylist()
            ids = [None if t is None else wfst.encode(t) for t in texts]
            same = [t is None or wfst.decode(i) == t.replace(MARK, " ") for t, i in zip(texts, ids)]
            yield batch_of(_ENCODED, doc_id=batch["doc_id"], ids=ids, round_trip=same)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        work, "doc_id long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """(doc_id, text): the texts of id lists; NULL ids give NULL, control and unknown ids nothing."""
    with open(model, "rb") as f:
        known = encoded.sparkSession.sparkContext.broadcast(f.read())
    out = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wfst = _compiled(known.value)
        for batch in batches:
            yield batch_of(out, doc_id=batch["doc_id"], text=[None if i is None else wfst.decode(i) for i in batch["ids"].to_pylist()])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(work, "doc_id long, text string")
