"""Nightly replacement of edges by category."""

import pytest

from souklens.session import scratch_path
from souklens.sources.edge_store import EdgeStore

ROW = "category_l1 string, match_id string, product_a_id long, product_b_id long, confidence double, match_method string"


def edges(spark, *rows):
    return spark.createDataFrame([(c, f"{a}-{b}", a, b, 0.5, "m") for c, a, b in rows], ROW)


def cats(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "category_l1 string")


def held(store):
    return sorted(((r.category_l1, r.product_a_id, r.product_b_id) for r in store.read().collect()), key=str)


def test_a_night_twice_and_another_category_once(spark):
    path = scratch_path(spark, "store")
    store = EdgeStore(spark, path)
    assert held(store) == []
    store.replace(edges(spark, ("x", 1, 2), ("x", 3, 4), ("y", 5, 6), (None, 7, 8)), cats(spark, "x", "y", None), 1)
    for _ in range(2):
        store.replace(edges(spark, ("x", 1, 9)), cats(spark, "x"), 2)
        assert held(store) == [("x", 1, 9), ("y", 5, 6), (None, 7, 8)]
    store.replace(edges(spark), cats(spark, "y"), 3)  # matched, and nothing found
    assert held(EdgeStore(spark, path)) == [("x", 1, 9), (None, 7, 8)]
    with pytest.raises(ValueError):
        store.replace(edges(spark, ("z", 1, 1)), cats(spark, "x"), 4)
    with pytest.raises(ValueError):
        store.replace(edges(spark), cats(spark, "x"), 1)
    assert held(store) == [("x", 1, 9), (None, 7, 8)]


def test_a_failed_run_changes_nothing_and_many_runs_leave_few_folders(spark):
    store = EdgeStore(spark, scratch_path(spark, "store"))
    store.folders.fan = 3
    store.replace(edges(spark, ("x", 1, 2), ("y", 3, 4)), cats(spark, "x", "y"), 1)
    reduced = store.folders.read()
    reduced.write.parquet(f"{store.folders.path}/rows/2-0-abandoned")  # written, never named
    assert held(store) == [("x", 1, 2), ("y", 3, 4)]
    for run in range(2, 14):
        store.replace(edges(spark, ("x", run, run)), cats(spark, "x"), run)
    assert held(store) == [("x", 13, 13), ("y", 3, 4)]
    assert len(store.folders.folders()) <= 6 and "2-0-abandoned" not in store.folders._names("rows")
