"""Hard negatives by spanning-tree bounds over anchors.

Vectors are dealt into tiles of bounded bytes, and so are the anchors among them; tiles meet on a grid of slots, so a hot label becomes more
tiles and never a larger group. The anchors of a tile are joined into a minimum spanning tree. For a candidate x the score at a child anchor
lies within (length of the tree edge) * |x| of its score at the parent, and within |child| * |x| of 0. Walking down the tree, a
candidate is scored at an anchor only if that interval overlaps the window that still matters there; all others pass
their interval on. First the positives: the window is everything from the k-th best same-label score on. Then the negatives: one window for
each positive, from its lower limit (or the last score that still counts) to its upper one. Scores are integers: products of doubles below
2**53, and Python integers for the rows whose components are larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from souklens.llm.common import batch_of
from souklens.session import checkpointed

TILE_BYTES = 1 << 20  # of candidates, as doubles
ANCHOR_BYTES = 1 << 18
SLOT = 16  # tiles of one side that meet the tiles of a slot of the other under one key
HELD = 64  # anchor tiles whose results a task holds before it gives them out
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
_TILE = pa.schema([("width", pa.int32()), ("bucket", pa.int64()), ("part", pa.int64()), ("ids", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64())),
                   ("labels", pa.list_(pa.int64())), ("mat", pa.binary()), ("pos", pa.list_(pa.list_(pa.struct([("id", pa.int64()), ("score", pa.int64())]))))])
_TILE_DDL = "width int, bucket long, part long, ids array<long>, rows array<long>, labels array<long>, mat binary, pos array<array<struct<id:long,score:long>>>"


def usable(vectors: DataFrame, anchor: Column, id_col: str, vec_col: str, label_col: str, scale: float) -> DataFrame:
    """(id, label, vec, width, row, anchor) of the rows that take part, equal rows once; row tells rows of one id apart."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & fine).distinct()
    return rows.select("id", "label", "vec", "anchor", F.size("vec").alias("width"), F.xxhash64("id", "label", "vec").alias("row"))


def tiles(rows: DataFrame, tile_bytes: int, scale: float) -> DataFrame:
    """Rows of a bucket packed into tiles of about ``tile_bytes`` of doubles; vectors become floor(scale * x)."""
    parts = rows.groupBy("width", "bucket").agg(F.ceil(F.count("*") * F.greatest("width", F.lit(1)) * 8 / F.lit(float(tile_bytes))).cast("long").alias("parts"))
    if "pos" not in rows.columns:
        rows = rows.withColumn("pos", F.lit(None).cast("array<struct<id:long,score:long>>"))
    packed = rows.join(parts, ["width", "bucket"]).groupBy("width", "bucket", F.pmod(F.xxhash64("row", "id"), F.col("parts")).alias("part")).agg(
        F.collect_list(F.struct("id", "row", "label", "vec", "pos")).alias("m"))

    def seal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mats = [np.floor(np.asarray(v.values.flatten().to_numpy(zero_copy_only=False), "<f8") * scale).tobytes() for v in batch["vec"]]
            yield batch_of(_TILE, width=batch["width"], bucket=batch["bucket"], part=batch["part"], ids=batch["id"], rows=batch["row"], labels=batch["label"],
                           mat=pa.array(mats, pa.binary()), pos=batch["pos"].cast(_TILE.field("pos").type))

    return packed.select("width", "bucket", "part", "m.id", "m.row", "m.label", "m.vec", "m.pos").mapInArrow(seal, _TILE_DDL)


def meetings(anchors: DataFrame, candidates: DataFrame, key: list[str]) -> DataFrame:
    """Every anchor tile beside every candidate tile of its ``key``, dealt over a grid of slots."""
    na = anchors.groupBy(*key).agg(F.ceil(F.count("*") / SLOT).cast("long").alias("_na"))
    nc = candidates.groupBy(*key).agg(F.ceil(F.count("*") / SLOT).cast("long").alias("_nc"))
    grid = na.join(nc, key)

    def side(tiles: DataFrame, s: str, mine: str, theirs: str) -> DataFrame:
        own, other = F.pmod(F.xxhash64("bucket", "part"), F.col(f"_n{mine}")), F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"_n{theirs}") - 1))
        placed = tiles.join(grid, key).select(*key, own.alias(f"_{mine}"), other.alias(f"_{theirs}"), F.struct(*tiles.columns).alias(s))
        return placed

    return side(anchors, "a", "a", "c").join(side(candidates, "x", "c", "a"), [*key, "_a", "_c"]).select(
        *[F.col(f"a.{c}").alias(f"a_{c}") for c in _TILE.names if c != "width"], *[F.col(f"x.{c}").alias(f"x_{c}") for c in ("ids", "rows", "labels", "mat")], F.col("a.width").alias("width"))


def spanning_tree(points: np.ndarray) -> list[tuple[int, int, float]]:
    """(anchor, parent, edge length) of a minimum spanning tree, parents first; the root has parent -1. Equal points lie at 0."""
    n = len(points)
    left, best, parent, out = np.ones(n, bool), np.full(n, np.inf), np.full(n, -1), []
    at = 0
    for _ in range(n):
        out.append((at, int(parent[at]), float(best[at])))
        left[at] = False
        with np.errstate(over="ignore"):
            far = np.sqrt(((points - points[at]) ** 2).sum(axis=1))
        nearer = left & (far < best)
        best[nearer], parent[nearer] = far[nearer], at
        at = int(np.where(left, best, np.inf).argmin()) if np.isfinite(best[left]).any() else int(left.argmax())
    return out


def _large(mat: np.ndarray) -> np.ndarray:
    """Rows whose products may leave the integers that doubles hold."""
    return (np.abs(mat) > 2.0 ** 26 / max(1.0, mat.shape[1] ** 0.5)).any(axis=1)


def exact_scores(anchor: np.ndarray, large: bool, mat: np.ndarray, larges: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers; what does not fit stops at the ends of the range."""
    with np.errstate(over="ignore", invalid="ignore"):
        plain = mat @ anchor
    odd = np.ones(len(mat), bool) if large else larges
    out = np.where(odd, 0, plain).astype(np.int64)
    for i in np.flatnonzero(odd):
        out[i] = min(max(sum(int(p) * int(q) for p, q in zip(anchor.tolist(), mat[i].tolist())), _LOW), _HIGH)
    return out


class AnchorTile:
    """The anchors of a tile, their tree, and for each of their windows the first rows found so far."""

    def __init__(self, cell: dict, keep: int, low: int | None, high: int | None):
        self.ids, self.rows, self.labels = (np.asarray(cell[f"a_{c}"]) for c in ("ids", "rows", "labels"))
        self.mat = np.frombuffer(cell["a_mat"], "<f8").reshape(len(self.ids), -1)
        self.large, self.norm = _large(self.mat), np.linalg.norm(self.mat, axis=1)
        self.tree, self.keep = spanning_tree(self.mat), keep
        self.pos = cell["a_pos"]
        if low is None:  # one open window for each anchor
            self.windows = [[(_LOW, _HIGH)] for _ in self.ids]
        else:
            self.windows = [[(max(_LOW, -(-p["score"] * low // 100)), min(_HIGH, p["score"] * high // 100)) for p in own] for own in self.pos]
        none = np.zeros(0, np.int64)
        self.found = [[(none, none, none) for _ in own] for own in self.windows]
        self.scored = 0

    def meet(self, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, mat: np.ndarray, same: bool) -> None:
        """Take the rows of a candidate tile into the windows; ``same``: rows of the anchor's label, else all others."""
        larges, norm = _large(mat), np.linalg.norm(mat, axis=1)
        least, most = np.empty((len(self.ids), len(ids))), np.empty((len(self.ids), len(ids)))
        for i, parent, edge in self.tree:
            reach = self.norm[i] * norm
            lo, hi = -reach, reach
            if parent >= 0 and not self.large[parent]:
                lo, hi = np.maximum(lo, least[parent] - edge * norm), np.minimum(hi, most[parent] + edge * norm)
            slack = 1e-9 * (self.norm[i] + (edge if parent >= 0 else 0.0)) * norm + 1.0
            lo, hi = np.where(larges, -np.inf, lo - slack), np.where(larges, np.inf, hi + slack)
            wanted = ((labels == self.labels[i]) == same) & (ids != self.ids[i])
            need = np.zeros(len(ids), bool)
            limits = []
            for (a, b), (score, _, _) in zip(self.windows[i], self.found[i]):
                a = max(a, int(score[-1])) if len(score) == self.keep else a
                sure = lo[wanted & (lo >= a) & (hi <= b)]  # in the window whatever their scores are
                if len(sure) >= self.keep:
                    a = max(a, int(np.partition(sure, -self.keep)[-self.keep]))
                limits.append((a, b))
                if a <= b:
                    need |= (hi >= a) & (lo <= b)
            at = np.flatnonzero(wanted & need)
            if len(at):
                score = exact_scores(self.mat[i], bool(self.large[i]), mat[at], larges[at])
                self.scored += len(at)
                lo[at] = hi[at] = score
                for j, (a, b) in enumerate(limits):
                    inside = (score >= a) & (score <= b)
                    if inside.any():
                        s, k, r = (np.concatenate([old, new[inside]]) for old, new in zip(self.found[i][j], (score, ids[at], rows[at])))
                        first = np.lexsort((r, k, -s))[: self.keep]
                        self.found[i][j] = (s[first], k[first], r[first])
            least[i], most[i] = lo, hi

    def rows_found(self, schema: pa.Schema) -> pa.RecordBatch:
        out: dict[str, list] = {n: [] for n in schema.names}
        for i, own in enumerate(self.found):
            for j, (score, ids, rows) in enumerate(own):
                of = self.pos[i][j] if self.pos[i] else None
                for s, k, r in zip(score.tolist(), ids.tolist(), rows.tolist()):
                    for name, v in (("anchor_id", int(self.ids[i])), ("anchor_row", int(self.rows[i])), ("place", j), ("positive_id", of and of["id"]), ("positive_score", of and of["score"]),
                                    ("id", k), ("row", r), ("score", s)):
                        out[name].append(v)
        return batch_of(schema, **out)


_OUT = pa.schema([("anchor_id", pa.int64()), ("anchor_row", pa.int64()), ("place", pa.int32()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("id", pa.int64()), ("row", pa.int64()), ("score", pa.int64())])
_OUT_DDL = "anchor_id long, anchor_row long, place int, positive_id long, positive_score long, id long, row long, score long"


def _first_in_windows(met: DataFrame, keep: int, same: bool, low: int | None = None, high: int | None = None) -> DataFrame:
    """The first ``keep`` rows of every window: highest score first, then the smaller id."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, AnchorTile] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                cell = {n: batch[n][at] for n in batch.schema.names}
                key = (cell["width"].as_py(), cell["a_bucket"].as_py(), cell["a_part"].as_py())
                if key not in held:
                    if len(held) == HELD:
                        for tile in held.values():
                            yield tile.rows_found(_OUT)
                        held = {}
                    held[key] = AnchorTile({n: cell[n].as_py() for n in ("a_ids", "a_rows", "a_labels", "a_mat", "a_pos")}, keep, low, high)
                ids, rows, labels = (cell[f"x_{c}"].values.to_numpy() for c in ("ids", "rows", "labels"))
                held[key].meet(ids, rows, labels, np.frombuffer(cell["x_mat"].as_py(), "<f8").reshape(len(ids), -1), same)
        for tile in held.values():
            yield tile.rows_found(_OUT)

    order = W.partitionBy("anchor_id", "anchor_row", "place").orderBy(F.desc("score"), F.asc("id"), F.asc("row"))
    return met.mapInArrow(work, _OUT_DDL).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0,
                   id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for every row where ``anchor`` holds and each of
    its ``positives`` best rows of the same label, the ``negatives`` best rows of other labels whose score lies between ``low`` and
    ``high`` percent of the positive's. A score is the inner product of the vectors after floor(scale * x); equal scores by smaller id.

    Rows with a NULL id, label or vector, or with a component that is NULL or not finite (also after scaling), take no part. Equal rows
    count once; of an id that comes with several vectors or labels each row counts, but none against an anchor of its own id. Vectors of different
    widths never meet; empty vectors score 0 with each other. A positive without negatives, or of negative score, gives no row, nor does an
    empty table. Scores beyond 64 bits stop at the ends of that range. Columns other than those named (and those in ``anchor``) are not read.
    """
    rows = checkpointed(usable(vectors, anchor, id_col, vec_col, label_col, scale))
    load = rows.agg(F.sum(F.greatest("width", F.lit(1)) * F.lit(8.0))).first()[0] or 0.0
    buckets = max(1, int(load // (4 * TILE_BYTES)))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(buckets)))
    candidates = checkpointed(tiles(rows, TILE_BYTES, scale).drop("pos"))
    asking = rows.where("anchor")
    best = _first_in_windows(meetings(tiles(asking, ANCHOR_BYTES, scale), candidates, ["width", "bucket"]), positives, same=True)
    best = best.where(F.col("score") >= 0).groupBy(F.col("anchor_id").alias("id"), F.col("anchor_row").alias("row")).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("last"), "id", "score"))).alias("own"))
    own = F.transform(F.reverse("own"), lambda p: F.struct(p["id"].alias("id"), p["score"].alias("score")))
    asking = asking.join(best, ["id", "row"]).withColumn("pos", own).drop("own")
    found = _first_in_windows(meetings(checkpointed(tiles(asking, ANCHOR_BYTES, scale)), candidates, ["width"]), negatives, same=False, low=low, high=high)
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
