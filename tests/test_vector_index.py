"""The approximate vector index against exact neighbours."""

import numpy as np
import pytest

from souklens.operators import vector_index
from souklens.operators.similarity import knn
from souklens.operators.vector_index import VectorIndex
from souklens.session import scratch_path

ROWS = "id long, embedding array<float>, cell string, width string"


def frame(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, None if v is None else [float(x) for x in v], "c", "w") for i, v in enumerate(vectors)], ROWS)


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 24))
    mat = centres[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 24)) * 0.35
    mat[0] = 1e20  # an outlier moves no centre but its own
    return mat, frame(spark, mat)


def exact(mat, queries, k):
    unit = mat / np.linalg.norm(mat, axis=1, keepdims=True)
    sims = unit[queries] @ unit.T
    sims[np.arange(len(queries)), queries] = -2
    return {q: set(np.argsort(-s, kind="stable")[:k].tolist()) for q, s in zip(queries, sims)}


def test_few_probes_find_nine_in_ten(spark, clustered):
    mat, df = clustered
    index = VectorIndex.build(df, scratch_path(spark, "index"), cells=64)
    queries = list(range(5, 6000, 40))
    found = {}
    for r in index.search(df.where(df.id.isin(queries)), 10, probes=6).collect():
        found.setdefault(r.left_id, []).append((r.rank, r.right_id))
    want = exact(mat, queries, 10)
    recall = sum(len(want[q] & {i for _, i in found[q]}) for q in queries) / (10 * len(queries))
    assert recall >= 0.9
    assert all([n for n, _ in sorted(own)] == list(range(1, 11)) and q not in {i for _, i in own} for q, own in found.items())
    assert index.lists().count() == 6000 and len(index.centres[24]) > 40
    plan = index.lists().where("width = 24 and cell = 3")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "DataFilters: []" in plan


def test_all_probes_are_exact_and_rows_can_be_added(spark, clustered):
    mat, df = clustered
    some = df.where("id < 900")
    path = scratch_path(spark, "index")
    VectorIndex.build(some.where("id < 500"), path)
    index = VectorIndex.open(spark, path)
    index.add(some.where("id >= 500"))
    got = sorted((r.left_id, r.right_id, r.similarity, r.rank) for r in index.search(some, 4, probes=None).collect())
    assert got == sorted((r.left_id, r.right_id, r.similarity, r.rank) for r in knn(some, some, 4).collect())


def test_widths_stay_apart_and_unusable_rows_stay_out(spark):
    rng = np.random.default_rng(1)
    vectors = [*rng.normal(size=(70, 6)), *rng.normal(size=(50, 3)), None, np.zeros(6), [np.nan] * 6, [np.inf, 1.0, 1.0], []]
    df = frame(spark, vectors)
    index = VectorIndex.build(df.union(df.where("id = 4")), scratch_path(spark, "index"), cells=5)
    assert sorted(index.centres) == [3, 6] and index.lists().count() == 121
    found = index.search(df, 3, probes=None).collect()
    assert {r.left_id for r in found} == set(range(120))
    assert all((r.left_id < 70) == (r.right_id < 70) and r.left_id != r.right_id for r in found)
    assert index.search(frame(spark, [[1.0, 2.0]]), 3).count() == 0


def test_an_empty_index(spark):
    index = VectorIndex.build(frame(spark, []), scratch_path(spark, "index"))
    assert index.search(frame(spark, [[1.0, 2.0]]), 3).count() == 0 and index.lists().count() == 0
    one = VectorIndex.build(frame(spark, [[1.0, 2.0]]), scratch_path(spark, "index"))
    assert one.search(frame(spark, [[1.0, 2.0]], 7), 3).first().right_id == 0


def test_centres_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "MOST_CELLS", 3)
    index = VectorIndex.build(frame(spark, np.random.default_rng(3).normal(size=(80, 4))), scratch_path(spark, "index"))
    assert len(index.centres[4]) <= 3


def test_a_search_of_all_cells_sends_each_query_once(spark, monkeypatch):
    rng = np.random.default_rng(4)
    df = frame(spark, rng.normal(size=(90, 5)))
    index = VectorIndex.build(df, scratch_path(spark, "index"), cells=9)
    sent = []
    real = vector_index.similarity_join
    monkeypatch.setattr(vector_index, "similarity_join", lambda asked, *a, **kw: (sent.append(asked.count()), real(asked, *a, **kw))[1])
    assert index.search(df, 3, probes=None).count() == 270 and index.search(df, 3, probes=100).count() == 270
    assert sent == [90, 90]
