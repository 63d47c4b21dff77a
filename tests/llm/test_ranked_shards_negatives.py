"""Ranked search, sharding and hard negatives against brute-force versions, and on awkward inputs."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from souklens.llm import negatives, ranked, shards
from tests.llm.test_ops import AWKWARD, ascii_lower, docs_of, invented

ITEMS = "item_id long, text string, terms string, score int"


def items_of(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in zip(range(len(texts)) if ids is None else ids, texts)], ITEMS)


# -- 11 ----------------------------------------------------------------------------------------------------------------

def terms_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", ascii_lower(t))


def best_by_brute_force(docs, items, k=10):
    """docs and items are (id, text); a row for each item row, in its order."""
    words = [terms_of(t) for _, t in docs]
    n, total = sum(map(bool, words)), sum(map(len, words))
    df = Counter(t for w in words for t in set(w))
    tfs = [Counter(w) for w in words]
    out = []
    for _, text in items:
        found = []
        for (doc, _), w, tf in zip(docs, words, tfs):
            m = 10 + (90 * len(w) * n) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in set(terms_of(text)) if tf[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out.append([(r, d, -s) for r, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)])
    return out


def answers(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.item_id, []).append((r["rank"], r.doc_id, r.score))
    return {i: sorted(v) for i, v in out.items()}


@pytest.mark.parametrize("cells,step", [(ranked.CELLS, ranked.STEP), (1 << 12, 1)])
def test_ranked_search_equals_brute_force(spark, monkeypatch, cells, step):
    rng = random.Random(3)
    syl = ["the", "ing", "wh", "ou", "er", "an", "ti", "Q"]
    docs = [(i, invented(rng, syl, rng.randint(1, 40))) for i in range(700)]
    docs += [(1000 + i, docs[5][1]) for i in range(40)]  # ties
    items = [(i, invented(rng, syl, rng.randint(1, 30))) for i in range(25)] + [(50, docs[5][1]), (51, "nowhere-to-be found"), (52, "")]
    monkeypatch.setattr(ranked, "CELLS", cells)
    monkeypatch.setattr(ranked, "STEP", step)
    frame = docs_of(spark, [t for _, t in docs], [i for i, _ in docs]).repartition(3)
    got = answers(ranked.rank_documents(frame, items_of(spark, [t for _, t in items], [i for i, _ in items])))
    want = {i: r for (i, _), r in zip(items, best_by_brute_force(docs, items)) if r}
    assert got == want


def test_ranked_search_on_awkward_rows(spark):
    docs = [(i, t) for i, t in enumerate(AWKWARD)] + [(3, "one"), (None, "one two"), (None, "two words"), (None, None)]
    items = [(0, "ONE two"), (1, None), (2, "wort same"), (3, "é ß"), (4, "a b")]
    frame = docs_of(spark, [t for _, t in docs], [i for i, _ in docs])
    got = answers(ranked.rank_documents(frame, items_of(spark, [t for _, t in items])))
    assert got == {i: r for (i, _), r in zip(items, best_by_brute_force(docs, items)) if r}
    assert ranked.rank_documents(frame, items_of(spark, [])).count() == 0
    assert ranked.rank_documents(frame.where("false"), items_of(spark, ["one"])).count() == 0
    twice = ranked.rank_documents(frame, items_of(spark, ["one", "one", "one"], [7, 7, None])).groupBy("item_id", "rank").count().collect()
    assert {r.item_id for r in twice} == {7, None} and all(r["count"] == (2 if r.item_id == 7 else 1) for r in twice)


def test_blocks_of_items_do_not_change_the_answer(spark, monkeypatch):
    rng = random.Random(4)
    docs = docs_of(spark, [invented(rng, ["ab", "cd", "e"], 9) for _ in range(80)])
    items = items_of(spark, [invented(rng, ["ab", "cd", "e"], 5) for _ in range(12)])
    one = answers(ranked.rank_documents(docs, items))
    monkeypatch.setattr(ranked, "ENTRIES", 9)
    monkeypatch.setattr(ranked, "GROUP", 4)
    assert answers(ranked.rank_documents(docs, items)) == one


def test_the_bound_stops_before_the_lists_end():
    """Two lists led by the same documents: what stands behind them is never looked at."""
    n = 4000
    doc, term = np.tile(np.arange(n), 2), np.repeat([0, 1], n)
    factor = np.tile(np.where(np.arange(n) < 10, 10_000 - np.arange(n), 10), 2)
    best = ranked.Best(10)
    scored = ranked.Lists(np.arange(n), doc, term, factor, 2).search(np.array([0, 1]), np.array([1, 1]), best)
    assert best.doc.tolist() == list(range(10)) and scored < 30


# -- 12 ----------------------------------------------------------------------------------------------------------------

def plain_best_fit(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        open_ = [b for b in bins if capacity - sum(b) >= s]
        if open_:
            min(open_, key=lambda b: capacity - sum(b)).append(s)
        else:
            bins.append([s])
    return sorted(sorted(b) for b in bins)


@pytest.mark.parametrize("seed", range(8))
def test_packing_by_runs_equals_one_by_one(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([3, 5, 8, rng.randint(1, 40), 90]) for _ in range(rng.randint(0, 120))]
    runs = sorted(Counter(sizes).items(), reverse=True)
    got = [sorted(itertools.chain(*([s] * n for s, n in b.items()))) for b in shards.best_fit(runs, 60)]
    assert sorted(got) == plain_best_fit(sizes, 60)


@pytest.mark.parametrize("sizes", [[7] * 45, [1] * 3, [], [1000] + [1] * 400, [500, 400, 300] + [2] * 50, list(range(1, 300))])
def test_a_number_of_shards_is_filled_evenly(sizes):
    bins = shards.pack_into(sorted(Counter(sizes).items(), reverse=True), 10)
    assert len(bins) == 10 and sorted(itertools.chain(*([s] * n for b in bins for s, n in b.items()))) == sorted(sizes)
    large = sum(sizes) / 10  # a group above a fair share stands alone
    shared = [b for b in bins if not any(s > large for s in b)]
    fill = [sum(s * n for s, n in b.items()) for b in shared]
    assert not fill or max(fill) - min(fill) <= max((s for b in shared for s in b), default=0)
    assert all(sum(b.values()) == 1 for b in bins if b not in shared)


def check_shards(rows, texts_by_row, n_shards):
    """Rows as (doc_id, size, crc, shard, slot)."""
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts_by_row)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    for s in range(n_shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    homes = {}
    for r in rows:
        homes.setdefault((r["size"], r.text_crc32), set()).add(r.shard)
    assert all(len(h) == 1 for h in homes.values())  # the small texts of these tests have no crc twice


def test_documents_are_dealt_by_whole_groups(spark):
    rng = random.Random(9)
    texts = [invented(rng, ["ab", "cd", "e"], rng.randint(1, 60)) for _ in range(900)]
    texts += [texts[3]] * 500 + [None, "", None] + AWKWARD
    ids = [*range(900), *[5] * 100, *[None] * 300, *range(5000, 5000 + len(texts) - 1300)]
    rows = shards.shard_documents(docs_of(spark, texts, ids).repartition(5), shards=12).collect()
    check_shards(rows, list(zip(ids, texts)), 12)
    fill = Counter()
    for r in rows:
        fill[r.shard] += r["size"]
    largest = fill.most_common()[:2]  # one very long text and the group of copies stand alone
    rest = [f for s, f in fill.items() if s not in {s for s, _ in largest}]
    assert len(fill) == 12 and max(rest) - min(rest) < 0.02 * max(rest)
    order = sorted((r for r in rows if r.shard == 3), key=lambda r: r.slot)
    assert [r.doc_id is None for r in order] == sorted(r.doc_id is None for r in order)


def test_fixed_capacity_and_empty_tables(spark):
    texts = ["x" * (i % 50) for i in range(300)]
    rows = shards.shard_documents(docs_of(spark, texts), capacity=2000).collect()
    groups = Counter(texts)
    want = plain_best_fit([(len(t) + 16) * n for t, n in groups.items()], 2000)
    assert len({r.shard for r in rows}) == len(want)
    assert shards.shard_documents(docs_of(spark, []), shards=40).count() == 0
    assert shards.shard_documents(docs_of(spark, []), capacity=10).count() == 0
    with pytest.raises(ValueError):
        shards.shard_documents(docs_of(spark, []))


# -- 13 ----------------------------------------------------------------------------------------------------------------

def negatives_by_brute_force(rows, anchor):
    rows = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows
            if None not in (i, lab, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, lab, v in rows:
        if not anchor(i):
            continue
        scored = [(-sum(p * q for p, q in zip(v, w)), j, other) for j, other, w in rows if j != i and len(w) == len(v)]
        for ps, p, _ in sorted(s for s in scored if s[2] == lab)[:5]:
            fit = sorted((s, j) for s, j, other in scored if other != lab and 50 * -ps <= 100 * -s <= 95 * -ps)[:3]
            out += [(i, p, r, j, -ps, -s) for r, (s, j) in enumerate(fit, 1)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<double>, label int, row int, pos string, parts int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, "p", 2) for i, lab, v in rows], VECTORS)


@pytest.mark.parametrize("tile", [negatives.TILE_BYTES, 1 << 10])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(negatives, "TILE_BYTES", tile)
    monkeypatch.setattr(negatives, "ANCHOR_BYTES", tile // 2)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    near = lambda i: (centres[i % 6] * (1 if i % 3 else 0.7) + rng.normal(size=8) * 0.2).round(2).tolist()
    rows = [(i, int(rng.integers(0, 4)), near(i)) for i in range(500)]
    rows += [(500 + i, 1 + i % 2, rows[0][2]) for i in range(120)]  # one common vector
    rows += [(700 + i, i % 3, rng.normal(size=3).tolist()) for i in range(60)]  # another width
    rows += [(800, 1, None), (801, None, rows[1][2]), (802, 1, [1.0, None] + [0.0] * 6), (803, 2, [math.nan] + [0.0] * 7), (None, 1, rows[1][2]), (805, 2, [0.0] * 8), (806, 1, []), (807, 2, [])]
    got = sorted(tuple(r) for r in negatives.hard_negatives(vectors_of(spark, rows), F.col("vec_id") % 10 == 0).collect())
    want = negatives_by_brute_force(rows, lambda i: i % 10 == 0)
    assert got == want and len(got) > 300


def test_hard_negatives_with_outliers_repeats_and_empty_tables(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 2, rng.random(4).tolist()) for i in range(60)]
    rows += [(100, 0, [1e12, 0.0, 0.0, -1.0]), (101, 1, [1e12, 0.5, 0.0, 0.0]), (102, 1, [1e9, 1.0, 1.0, 1.0])]
    frame = vectors_of(spark, rows)
    got = sorted(tuple(r) for r in negatives.hard_negatives(frame.union(frame), F.col("vec_id") % 10 == 0).collect())
    limit = lambda v: max(-(1 << 63), min((1 << 63) - 1, v))
    # scores beyond 64 bits stop at the end of the range, before the windows are set
    assert [r for r in got if r[0] != 100] == [r for r in negatives_by_brute_force(rows, lambda i: i % 10 == 0) if r[0] != 100]
    assert all(r[4] == limit(r[4]) for r in got)
    assert negatives.hard_negatives(vectors_of(spark, []), F.col("vec_id") % 10 == 0).count() == 0


def test_tree_bounds_leave_most_candidates_unscored():
    rng = np.random.default_rng(6)
    anchors = np.floor(256 * (np.array([[1.0] * 16]) + rng.normal(size=(40, 16)) * 0.005))
    cell = {"a_ids": list(range(40)), "a_rows": list(range(40)), "a_labels": [0] * 40, "a_mat": anchors.tobytes(), "a_pos": [None] * 40}
    tile = negatives.AnchorTile(cell, 5, None, None)
    many = np.floor(256 * rng.normal(size=(3000, 16)))
    tile.meet(np.arange(100, 3100), np.arange(3000), np.zeros(3000, np.int64), many, True)
    assert tile.scored < 0.3 * 40 * 3000
    for i in range(40):
        s = many @ anchors[i]
        assert tile.found[i][0][0].tolist() == sorted(s.astype(int).tolist(), reverse=True)[:5]
