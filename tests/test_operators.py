"""Joins, windows and merges on small hand-made tables, with hot groups, ties and many tiles."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from souklens.operators import classify, clusters, edges, extract, hashes, listing, merge, similarity
from souklens.operators.history import newest, price_drops, product_velocity
from souklens.operators.listing import unmatched_bestsellers
from souklens.operators.merge import dedupe_by
from souklens.operators.quantiles import values_at
from souklens.session import checkpointed as shared_table, shared_dir
from souklens.operators.upsert import append_new, update_max_sales, upsert


def vectors(spark, n=300, dim=8, groups=6, seed=3):
    """Clustered vectors; a third of all rows sits in one block and some rows are exact copies."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    rows = []
    for i in range(n):
        v = centres[i % groups] + rng.normal(scale=0.4, size=dim)
        if i % 10 == 9:
            v = np.array(rows[-1][2])
        rows.append((i, "hot" if i % 3 == 0 else f"b{i % 7}", [float(np.float32(x)) for x in v], ["a", "b", "c"][i % 3]))
    return rows, spark.createDataFrame(rows, "id long, cat string, embedding array<float>, platform string")


def cosines(rows):
    m = np.array([r[2] for r in rows], dtype="f4").astype("f8")
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    return np.round(m @ m.T, 6)


@pytest.fixture(params=[(512, 16), (16, 2)], ids=["one tile", "many tiles"])
def tiling(request, monkeypatch):
    monkeypatch.setattr(similarity, "TILE_ROWS", request.param[0])
    monkeypatch.setattr(similarity, "TILES_PER_SLOT", request.param[1])


def test_threshold_join(spark, tiling):
    rows, df = vectors(spark)
    c = cosines(rows)
    got = {(r.left_id, r.right_id): r.similarity for r in similarity.similarity_join(df, df, block="cat", threshold=0.9, ordered=True).collect()}
    want = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if rows[i][1] == rows[j][1] and c[i, j] >= 0.9}
    assert set(got) == want and len(want) > 50
    assert all(abs(s - c[i, j]) < 2e-6 for (i, j), s in got.items())


def test_k_nearest(spark, tiling):
    rows, df = vectors(spark)
    c = cosines(rows)
    got = {(r.left_id, r["rank"]): r.right_id for r in similarity.knn(df, df, 3, other_platform=True).collect()}
    for i in range(len(rows)):
        others = sorted((j for j in range(len(rows)) if rows[j][3] != rows[i][3]), key=lambda j: (-c[i, j], j))
        assert [got[i, k] for k in (1, 2, 3)] == others[:3]


def test_copies_do_not_multiply_pairs(spark, tiling):
    df = spark.range(200).selectExpr("id", "array(float(1), float(2)) as embedding")
    got = similarity.similarity_join(df, df, k=2)
    assert {(r.left_id, r.right_id) for r in got.where("left_id < 3").collect()} == {(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)}
    assert got.count() == 400


def test_smallest_partner(spark, tiling):
    rows, df = vectors(spark)
    c = cosines(rows)
    got = {r.left_id: r.right_id for r in similarity.similarity_join(df, df, threshold=0.85, smallest=True, smaller_right=True).collect()}
    want = {}
    for i in range(len(rows)):
        hits = [j for j in range(i) if c[i, j] >= 0.85]
        if hits:
            want[i] = hits[0]
    assert got == want


@pytest.mark.parametrize("n", [150, 40])
def test_leader_clusters(spark, n):
    rows, df = vectors(spark, n=n)
    c = cosines(rows)
    leader, taken = {}, set()
    for i in range(len(rows)):
        if i in taken:
            continue
        for j in range(i, len(rows)):
            if j not in taken and (j == i or c[i, j] >= 0.8):
                leader[j] = i
                taken.add(j)
    sizes = {h: list(leader.values()).count(h) for h in set(leader.values())}
    want = {i: (h, sizes[h]) for i, h in leader.items() if sizes[h] >= 2}
    got = {r.id: (r.leader_id, r["size"]) for r in clusters.leader_clusters(df, 0.8).collect()}
    assert got == want
    heads = sorted({h for h, _ in got.values()})
    assert all(c[a, b] < 0.8 for a in heads for b in heads if a < b)


@pytest.mark.parametrize("least, prefix, both", [(0.3, 8, False), (0.95, 8, True), (0.8, 40, False)])
def test_leaders_of_a_scan_and_of_rounds_are_the_same(spark, tiling, monkeypatch, least, prefix, both):
    """Rows of many neighbours are settled by scans of few rows, which meet leaders only; others by rounds."""
    rows, df = vectors(spark, n=150)
    c = np.round(cosines(rows), 6)
    leader = {}
    for i in range(len(rows)):
        heads = [h for h in sorted(set(leader.values())) if c[i, h] >= least]
        leader[i] = heads[0] if heads else i
    sizes = {h: list(leader.values()).count(h) for h in set(leader.values())}
    want = {i: (h, sizes[h]) for i, h in leader.items() if sizes[h] >= 2}
    rounds, scans = [], []
    monkeypatch.setattr(clusters, "PREFIX", prefix)
    real, scanned = clusters._blockers, clusters._scanned
    monkeypatch.setattr(clusters, "_blockers", lambda t: (rounds.append(t), real(t))[1])
    monkeypatch.setattr(clusters, "_scanned", lambda *a: (scans.append(1), scanned(*a))[1])
    assert {r.id: (r.leader_id, r["size"]) for r in clusters.leader_clusters(df, least).collect()} == want
    assert scans and bool(rounds) == both
    scans.clear()
    clusters.leader_clusters(df.withColumn("id", F.greatest("id", F.lit(1))), least).count()  # an id that comes twice gives no order
    assert not scans
    assert clusters.leader_clusters(df.where("false"), least).count() == 0


def test_tiers_and_one_to_one(spark):
    rows, df = vectors(spark)
    df = df.withColumns({"category_l1": F.col("cat"), "category_l2": (F.col("id") % 2).cast("string"),
                         "category_l3": F.when(F.col("id") % 5 == 0, "Geral").otherwise((F.col("id") % 4).cast("string"))})
    left, right = df.where("platform = 'a'"), df.where("platform <> 'a'").withColumn("category_l1", F.lit("hot"))
    found = edges.match_candidates(left, right, 0.5)
    best = edges.best_by_tier(found)
    final = edges.one_to_one(best).collect()
    assert len({r.left_id for r in final}) == len(final) == len({r.right_id for r in final}) > 0
    by_tier = {t: {r.left_id: r.similarity for r in found.where(F.col("tier") == t).collect()} for t in edges.TIERS}
    # A narrower tier is a subset of the wider one, so the wider best is never worse.
    assert all(by_tier["medium"][i] >= s for i, s in by_tier["strict"].items())
    assert all(by_tier["broad"][i] >= s for i, s in by_tier["medium"].items())


def test_edges_are_symmetric(spark):
    e = spark.createDataFrame([("1-2", 1, 2, 0.9), ("3-1", 3, 1, 0.8)], "match_id string, product_a_id long, product_b_id long, confidence double")
    both = {(r.from_id, r.to_id) for r in edges.both_ways(e).collect()}
    assert both == {(1, 2), (2, 1), (3, 1), (1, 3)}


def test_velocity_skips_unknown_sales(spark):
    rows = [(1, "2024-01-01 00:00:00", 10), (1, "2024-01-03 02:00:00", None), (1, "2024-01-04 01:00:00", 16), (2, "2024-01-01 00:00:00", 5)]
    df = spark.createDataFrame(rows, "offer_id long, at string, sales_volume_estimate long").withColumn("scraped_at", F.col("at").cast("timestamp"))
    got = {r.offer_id: r for r in product_velocity(df).collect()}
    assert (got[1].current_sales, got[1].previous_sales, got[1].days_between, got[1].daily_velocity) == (16, 10, 3, 2.0)
    assert (got[2].sales_delta, got[2].previous_sales, got[2].daily_velocity) == (5, None, None)


def test_newest_limits_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 as k", "id as t")
    plan = newest(df, ["k"], [F.desc("t")], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_price_drops_need_two_points(spark):
    p = spark.createDataFrame([(1, "amazon_br", "a", "x"), (2, "ml", "b", "x"), (3, "ml", "c", "x")], "id long, platform string, title string, category_l1 string")
    m = spark.createDataFrame([("1-2", 1, 2, 0.9), ("1-3", 1, 3, 0.9)], "match_id string, product_a_id long, product_b_id long, confidence double")
    h = [(1, 10.0, 1), (1, 20.0, 2), (1, 30.0, 3), (1, 40.0, 4), (1, 50.0, 5), (2, 5.0, 1), (2, 7.0, 2), (3, 1.0, 1)]
    got = price_drops(m, p, spark.createDataFrame(h, "product_id long, price double, recorded_at int"), None).collect()
    assert [(r.match_id, r.latest_diff, r.prev_avg_diff, r.diff_change) for r in got] == [("1-2", 43.0, 25.0, 18.0)]


@pytest.mark.parametrize("n", [1, 2, 4, 7, 500])
def test_order_statistics_with_ties(spark, n):
    rng = random.Random(n)
    values = [rng.choice([0.01, 1.0, 1.0, 2.5, 99.99, 1e9, round(rng.uniform(1, 1.02), 4)]) for _ in range(n)]
    df = spark.createDataFrame([("k", v) for v in values] + [("k", 0.0), ("k", -3.0)], "key string, v double")
    got = {r.q: (r.n, r.value) for r in values_at(df, "v", [0.25, 0.5, 0.75], ["key"]).collect()}
    assert got == {q: (n, sorted(values)[int(n * q)]) for q in (0.25, 0.5, 0.75)}


def test_upsert_takes_the_last_row_of_a_batch(spark):
    t = spark.createDataFrame([(1, "a", 5), (2, "b", None)], "k long, title string, sales int")
    u = spark.createDataFrame([(1, "x", 3, 1), (1, None, 9, 2), (3, "n", None, 1)], "k long, title string, sales int, n int")
    got = {r.k: (r.title, r.sales) for r in upsert(t, u, ["k"], {"title": "coalesce", "sales": "greatest0"}, F.col("n")).collect()}
    assert got == {1: ("a", 9), 2: ("b", None), 3: ("n", None)}
    assert {r.k: (r.title, r.sales) for r in upsert(t, u, ["k"], {}, F.col("n")).collect()} == {1: (None, 9), 2: ("b", None), 3: ("n", None)}


def test_append_new_ignores_known_keys(spark):
    t = spark.createDataFrame([(1, 1)], "k int, t int")
    n = spark.createDataFrame([(1, 1, "old"), (2, 1, "b"), (2, 1, "a")], "k int, t int, v string")
    assert [tuple(r) for r in append_new(t, n, ["k", "t"], F.col("v")).collect()] == [(2, 1, "a")]


def test_update_max_matches_both_key_forms(spark):
    t = spark.createDataFrame([("ml:1", "ml", 5), ("2", "ml", None), ("ml:3", "ml", 50), ("1", "br", 1)], "source_id string, marketplace string, sales_30d long")
    u = spark.createDataFrame([("ml", "1", 9), ("ml", "ml:2", 4), ("ml", "3", 7), ("ml", "1", 0)], "marketplace string, key string, sales long")
    got = {(r.marketplace, r.source_id): r.sales_30d for r in update_max_sales(t, u).collect()}
    assert got == {("ml", "ml:1"): 9, ("ml", "2"): 4, ("ml", "ml:3"): 50, ("br", "1"): 1}


def test_dedupe_keeps_the_first_row_whole(spark):
    df = spark.createDataFrame([("k", 2, None), ("k", 1, "a"), ("j", 5, None)], "key string, o int, v string")
    assert {tuple(r) for r in dedupe_by(df, ["key"], F.col("o")).collect()} == {("k", 1, "a"), ("j", 5, None)}


def test_containment_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("ab%_ ") for _ in range(rng.randint(0, 24)))
    mb = [(i, word() if i % 11 else None, float(i)) for i in range(80)]
    lp, fp = [(word(),) for _ in range(30) if True], [("b" * 22,), (None,)]
    lp = [t for t in lp if t[0]]
    got = {r.id for r in unmatched_bestsellers(spark.createDataFrame(mb, "id int, title string, sales_velocity double"),
                                               [spark.createDataFrame(lp, "title string"), spark.createDataFrame(fp, "title string")], 1000).collect()}
    others = [t for (t,) in lp + fp if t is not None]
    hit = lambda a: a is not None and any(a[:20] in b or b[:20] in a for b in others)
    assert got == {i for i, title, _ in mb if not hit(title)}


def test_vectors_of_different_widths_never_meet(spark):
    nan = float("nan")
    data = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0, 0.0, 0.0]), (3, [0.0, 0.0, 1.0, 2.0]), (4, [nan, 1.0]), (5, [None, 1.0]), (6, None), (7, [0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x" if i % 2 else None) for i, v in data], "id long, embedding array<float>, cat string")
    got = {(r.left_id, r.right_id): r.similarity for r in similarity.similarity_join(df, df, threshold=-1.0, ordered=True).collect()}
    assert got == {(0, 1): 1.0, (2, 3): 0.0}
    assert similarity.similarity_join(df, df, threshold=-1.0, ordered=True, block="cat").count() == 0


@pytest.mark.parametrize("least", [12, 99])
def test_hamming_join_by_bands_and_by_tiles(spark, least):
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 2, (60, 64))
    codes[30:] = codes[:30]
    for i in range(30, 60):
        codes[i, rng.choice(64, i % 6, replace=False)] ^= 1
    df = spark.createDataFrame([(i, [int(b) for b in c]) for i, c in enumerate(codes)], "id long, bits array<int>")
    got = {(r.left_id, r.right_id, r.distance) for r in similarity.hamming_join(df, df, 4, ordered=True, least_band=least).collect()}
    want = {(i, j, int((codes[i] != codes[j]).sum())) for i in range(60) for j in range(i + 1, 60) if (codes[i] != codes[j]).sum() <= 4}
    assert got == want and len(want) >= 20


def _hashes(rng, n, width, most, structured):
    """Random hashes, then near copies of them; ``structured`` fixes half of all bits, as blank borders do."""
    codes = rng.integers(0, 2, (n, width))
    if structured:
        codes[:, : width // 2] = 1
    codes[n // 2:] = codes[: n - n // 2]
    for i in range(n // 2, n):
        codes[i, rng.choice(width, i % (most + 4), replace=False)] ^= 1
    return codes


@pytest.mark.parametrize("width,most,structured,heavy", [(256, 20, False, 1 << 12), (256, 20, True, 3), (256, 3, False, 3), (100, 9, True, 5), (256, 35, False, 40)])
def test_hash_links_of_any_width(spark, monkeypatch, width, most, structured, heavy):
    monkeypatch.setattr(hashes, "HEAVY", heavy)
    codes = _hashes(np.random.default_rng(width + most), 160, width, most, structured)
    codes[::9] = codes[3]  # one common hash
    bits = [[int(b) for b in c] for c in codes] + [None, [1, 0], bits_with_null(width)]
    df = spark.createDataFrame(list(enumerate(bits)), "id long, bits array<int>")
    apart = (codes[:, None] != codes[None, :]).sum(axis=2)
    first = {c.tobytes(): i for i, c in reversed(list(enumerate(codes)))}
    reps = sorted(first.values())
    got = {(r.left_id, r.right_id): r.distance for r in hashes.hash_links(df.where("id < 160 or id = 161"), most, width=width).collect()}
    assert got == {(i, j): int(apart[i, j]) for i in reps for j in reps if i < j and apart[i, j] <= most}
    members = {r.id: r.class_id for r in hashes.hash_classes(df.where("id < 162"), width=width).collect()}
    assert members == {i: first[c.tobytes()] for i, c in enumerate(codes)}
    pairs = [(r.left_id, r.right_id, r.distance) for r in hashes.close_hashes(df.where("id < 100"), df.where("id between 40 and 159"), most, width=width).collect()]
    assert sorted(pairs) == sorted((i, j, int(apart[i, j])) for i in range(100) for j in range(40, 160) if i != j and apart[i, j] <= most)
    assert hashes.hash_links(df.where("false"), most, width=width).count() == 0


def bits_with_null(width):
    return [None] * (width + 1)


def test_chunks_of_a_hash_follow_the_number_of_hashes():
    assert hashes.radii(16, 20) == [1] * 5 + [0] * 11 and hashes.radii(16, 3) == [0] * 4 + [-1] * 12
    assert hashes.probe_count(256, 16, 20) == sum(len(hashes.masks(16, r)) for r in hashes.radii(16, 20)) == 96
    assert hashes.chunk_size(256, 20, 10_000) < hashes.chunk_size(256, 20, 10**9) == 32
    assert hashes.useful(256, 20) and not hashes.useful(64, 20)


def test_chunks_tell_hashes_apart_that_repeat_after_a_period(spark):
    """Where bits repeat every 64 places, a chunk of every 16th bit held four different ones, and unrelated hashes shared its few values."""
    rng = np.random.default_rng(5)
    codes = np.tile(rng.integers(0, 2, (3000, 64)), (1, 4))
    df = spark.createDataFrame([(i, [int(b) for b in c]) for i, c in enumerate(codes)], "id long, bits array<int>")
    row = hashes.packed(df, "id", "bits", 256).collect()
    longs = np.array([[r[f"c{w}"] for w in range(4)] for r in row], np.int64).view(np.uint64)
    of = {r.id: int(np.bitwise_count(x).sum()) for r, x in zip(row, longs)}
    assert of == {i: int(c.sum()) for i, c in enumerate(codes)}
    for i in range(16):
        chunk = (longs[:, i // 4] >> np.uint64(48 - 16 * (i % 4))) & np.uint64(0xFFFF)
        assert np.bincount(np.unique(chunk, return_inverse=True)[1]).max() < 60  # 3000 / 16 at best with four bits


def test_rows_without_a_hash_of_the_width_are_left_out(spark):
    df = spark.createDataFrame([(1, [1] * 70), (2, [0] * 69 + [None]), (3, None), (4, [1] * 71), (None, [0] * 70), (6, [])], "id long, bits array<int>")
    got = {r.id: [r.c0, r.c1] for r in hashes.packed(df, "id", "bits", 70).collect()}
    assert set(got) == {1, None} and got[None] == [0, 0] and sum((x & (1 << 64) - 1).bit_count() for x in got[1]) == 70
    assert hashes.packed(df.where("id = 3"), "id", "bits", 70).count() == 0


def test_a_hash_join_of_a_table_with_itself_makes_its_bits_once(spark, monkeypatch):
    made = []
    real = hashes.packed
    monkeypatch.setattr(hashes, "packed", lambda *a: (made.append(1), real(*a))[1])
    df = spark.createDataFrame([(i, [int(x) for x in f"{i:0256b}"]) for i in (0, 1, 3, 255)], "id long, bits array<int>")
    assert {(r.left_id, r.right_id, r.distance) for r in similarity.hamming_join(df, df, 1, width=256, ordered=True).collect()} == {(0, 1, 1), (1, 3, 1)}
    assert len(made) == 1


def test_wide_hashes_never_meet_all_pairs(spark):
    df = spark.createDataFrame([(i, [i >> k & 1 for k in range(8)] * 32) for i in range(50)], "id long, bits array<int>")
    plan = similarity.hamming_join(df, df, 20, width=256, ordered=True)._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan and "MapInArrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("heavy", [1 << 12, 3])
def test_exploded_hashes_are_never_broadcast(spark, monkeypatch, heavy):
    monkeypatch.setattr(hashes, "HEAVY", heavy)
    df = spark.createDataFrame([(i, [i >> k & 1 for k in range(8)] * 32) for i in range(50)], "id long, bits array<int>")
    of = shared_table(hashes.classes(hashes.packed(df, "id", "bits", 256, 16)).drop("copies"))
    narrow = similarity.hamming_join(*[shared_table(df.select("id", F.slice("bits", 1, 64).alias("bits")))] * 2, 4, ordered=True)
    for pairs in (hashes.close_pairs(of, of, 256, 16, 20), narrow):
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"BroadcastHashJoin.* Inner", plan) and "SortMergeJoin" in plan


def test_slots_grow_slower_than_tiles(spark):
    counts = spark.createDataFrame([("64", 1), ("64", 40), ("64|a", 2270), ("64", 24000), ("4096", 2270)], "block string, parts int")
    assert [r.slots for r in counts.select(similarity.slot_count().alias("slots")).collect()] == [1, 3, 9, 94, 142]


def test_a_round_of_leaders_sends_live_rows_only():
    import pyarrow as pa
    mat = np.arange(12, dtype="<f4").reshape(4, 3)
    batch = pa.RecordBatch.from_pylist([{"ids": [7, 3, 9, 5], "mat": mat.tobytes(), "live": [{"id": 5, "leads": False}, {"id": 7, "leads": True}]}])
    cut = next(clusters._only_live(iter([batch])))
    assert cut["ids"].to_pylist() == [[5, 7]] and cut["mat"].to_pylist() == [mat[[3, 0]].tobytes()] and cut["live"] == batch["live"]


def test_later_tiles_send_only_what_can_be_among_the_best():
    import pyarrow as pa
    rng, k = np.random.default_rng(8), 5
    left, right = rng.normal(size=(40, 8)).astype("<f4"), rng.normal(size=(1600, 8)).astype("<f4")
    right[1500:] = right[:100]  # equal vectors: the smaller id wins
    batch = pa.RecordBatch.from_pylist([{"l_ids": list(range(40)), "l_mat": left.tobytes(), "r_ids": list(range(at, at + 80)), "r_mat": right[at: at + 80].tobytes()} for at in range(0, 1600, 80)])
    sent = [r for b in similarity._score(None, k, False, False, False, True, False, 6)([batch]) for r in zip(*[c.to_pylist() for c in b.columns])]
    sims = np.round(similarity.unit_rows(left) @ similarity.unit_rows(right).T, 6)
    for i in range(40):
        want = sorted((-sims[i, j], j) for j in range(1600) if i != j)[:k]
        assert sorted((-s, j) for x, j, s in sent if x == i)[:k] == want
    assert len(sent) < 40 * k * 20 / 3


def test_a_tile_is_sent_once_for_each_slot_and_not_for_each_pair(spark, monkeypatch):
    monkeypatch.setattr(similarity, "TILE_ROWS", 8)
    rng = np.random.default_rng(3)
    mat = rng.normal(size=(400, 6)).astype("f4")
    df = spark.createDataFrame([(i, v.tolist(), "xy"[i % 2]) for i, v in enumerate(mat)], "id long, embedding array<float>, platform string")
    tiles = similarity.packed_tiles(df).cache()
    counts = similarity.tile_counts(tiles)
    (n, slots), = counts.select("parts", similarity.slot_count()).collect()
    assert n > 40 and slots > 1 and similarity._gathered(tiles, tiles, counts, counts).count() == 2 * n * slots < similarity.meet(tiles, tiles, counts, counts).count() / 5
    sims = np.round(similarity.unit_rows(mat) @ similarity.unit_rows(mat).T, 6)
    want = {(i, j) for i in range(400) for _, j in sorted((-sims[i, j], j) for j in range(400) if i != j)[:3]}
    for got in (similarity.similarity_join(df, df, k=3), similarity.join_tiles(tiles, tiles, 3)):
        assert {(r.left_id, r.right_id) for r in got.collect()} == want
    apart = similarity.similarity_join(df, df, threshold=0.8, differ="platform", ordered=True)
    assert {(r.left_id, r.right_id) for r in apart.collect()} == {(i, j) for i in range(400) for j in range(i + 1, 400) if sims[i, j] >= 0.8 and (j - i) % 2}


def test_repeated_rules_are_dropped_before_they_are_sorted(spark):
    rules = spark.range(1000).selectExpr("concat('L', id % 2) as l1", "1L as position", "concat('s', id % 5) as substring", "'a' as l2", "'b' as l3").distinct()
    df = spark.createDataFrame([("x s3 y", "L1", "o", "o"), ("none", "L0", "o", "o")], "title string, category_l1 string, category_l2 string, category_l3 string")
    found = classify.classify_by_table(df, rules)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert any("count(1)" in line and "substring" in line for line in plan.splitlines() if "Aggregate" in line)
    assert sorted(tuple(r) for r in found.collect()) == [("none", "L0", "o", "o"), ("x s3 y", "L1", "a", "b")]


def test_ranked_products_are_dealt_to_many_tasks(spark):
    s = spark.createDataFrame([(1, "n", "r", "L", 1, "c1", '[{"title": "t", "price": "2", "source_url": "u"}]')], "supplier_key long, supplier_name string, region string, category_label string, rank_position int, category_id string, top_products_json string")
    found = merge.ranked_products(s)
    assert "RebalancePartitions" in found._jdf.queryExecution().optimizedPlan().toString() and [r.title for r in found.collect()] == ["t"]


def test_neighbours_of_a_report_are_dealt_to_many_tasks(spark):
    from souklens.operators.reports import product_report
    products = spark.range(4).selectExpr("id", "if(id % 2 = 0, 'amazon_br', 'ml') as platform", "concat('P', id) as platform_id", "'t' as title", "100.0D + id as price",
                                         "'BRL' as currency", "1L as sales_30d", "10L as sales_total", "cast(null as bigint) as bsr_rank", "true as is_active")
    found = product_report(products, spark.createDataFrame([("0-1", 0, 1, 0.5), ("0-3", 0, 3, 0.4)], "match_id string, product_a_id long, product_b_id long, confidence double"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(from_id#\d+L?, 8\), REPARTITION_BY_NUM", plan) and re.search(r"hashpartitioning\(to_id#\d+L?, 8\), REPARTITION_BY_NUM", plan)
    assert {r.id: (r.seller_count, r.match_count) for r in found.collect()} == {0: (3, 2), 1: (2, 1), 2: (1, 0), 3: (2, 1)}


def test_factors_move_no_rows(spark):
    from souklens.functions.market import join_factors
    rows = spark.range(1000).selectExpr("id", "if(id % 3 = 0, 'BR', 'XX') as country", "cast(id as int) as quantity")
    found = join_factors(rows, spark.createDataFrame([("BR", 1, 3.0), ("BR", 500, 2.0)], "country string, quantity_min int, factor double"))
    assert "ShuffledHashJoin" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "SortMergeJoin" not in plan
    assert {r.id: r.factor for r in found.where("id in (0, 499, 500, 999)").collect()} == {0: 3.5, 499: 3.0, 500: 2.0, 999: 2.0}


def test_containment_meets_on_rare_grams(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abC é") for _ in range(rng.randint(0, 9)))
    texts = ["common start " + word() + word() for _ in range(150)] + [word() for _ in range(80)] + ["", "a"]
    needles = sorted({("common start " + word())[:20] for _ in range(40)} | {word()[:20] for _ in range(60)} | {"", "a", "zzzzzz", "common"})
    t, n = (spark.createDataFrame([(x,) for x in sorted(set(v))], f"{c} string") for c, v in (("t", texts), ("p", needles)))
    got = sorted(tuple(r) for r in listing.contained(t, "t", n, "p").collect())
    assert got == sorted((x, y) for x in set(texts) for y in needles if y in x)
    assert listing._grams(t, "t").count() <= sum(map(len, set(texts)))


def test_a_word_in_most_titles_makes_no_pairs_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(listing, "HOT", 50)
    title = lambda side, i, n: " ".join(["promo"] * n) + f" {side}{i}"
    rows = lambda side: [(i, title(side, i, 12 if i < 30 else 7 if i < 2700 else 1) if i < 2700 else f"{side}own{i} {side}words", 10.0) for i in range(3000)]
    ml, china = (spark.createDataFrame(rows(s), "id long, title string, price double") for s in "mc")
    met = []
    real = listing._meetings
    monkeypatch.setattr(listing, "_meetings", lambda a, b, t: (met.append(real(a, b, t, pairs=False).count()), real(a, b, t))[1])
    found = listing.title_match(ml, china, threshold=0.6, k=3).collect()
    results = 30 * 30  # titles of twelve are alike; of seven they are not, though nine in ten titles hold the word
    assert {r.ml_id for r in found} == set(range(30)) and {r["rank"] for r in found} == {1, 2, 3}
    assert results <= met[0] < 200 * results  # 7.3 million share the word


def test_a_supplier_with_a_third_of_all_rows_is_never_one_row(spark):
    rows = [(f"r{i:05d}", i % 400 if i % 3 else i, f"t{i}", " Big Co " if i % 3 == 0 else f"s{i % 7}", "L") for i in range(3000)]
    lp = spark.createDataFrame(rows, "row_id string, offer_id long, title string, supplier_name string, category_label string")
    ranked = spark.createDataFrame([(1, "BIG CO", "r", 1, "L"), (2, "nobody", "r", 2, "M")], "supplier_key long, supplier_name string, region string, rank_position int, category_label string")
    products = merge.supplier_products(lp)
    assert not any(isinstance(f.dataType, T.ArrayType) for f in products.schema)
    got = {(r.key, r.offer_id): r.title for r in products.collect()}
    want = {}
    for row, offer, t, name, _ in rows:
        want.setdefault((name.strip().lower(), offer), t)
    assert got == want
    sizes = {r.key: r.product_count for r in merge.supplier_profiles(ranked, lp).collect()}
    assert sizes == {"nobody": 0, **{k: sum(1 for x, _ in want if x == k) for k in {x for x, _ in want}}}


def test_supplier_profiles_list_their_products(spark):
    lp = spark.createDataFrame([("r1", 30, "Ann "), ("r2", 4, "ann"), ("r3", 30, "ANN"), ("r4", None, "Bob")], "row_id string, offer_id long, supplier_name string")
    ranked = spark.createDataFrame([(1, "Zoe", "r", 1)], "supplier_key long, supplier_name string, region string, rank_position int").withColumn("category_label", F.lit("L"))
    got = {r.key: (r.products, r.product_count) for r in merge.supplier_profiles(ranked, lp.withColumn("category_label", F.lit("L"))).collect()}
    assert got == {"ann": ([4, 30], 2), "bob": ([], 0), "zoe": ([], 0)}


def test_taxonomy_of_any_depth(spark):
    chain = [(f"s{i}", i, f"s{i - 1}" if i > 1 else None) for i in range(1, 8)] + [("lost", 2, "nowhere")]
    got = {r.slug: (r.path, r.root, r.depth) for r in classify.taxonomy_paths(spark.createDataFrame(chain, "slug string, level int, parent_slug string")).collect()}
    assert got["s7"] == ("s1/s2/s3/s4/s5/s6/s7", "s1", 7) and got["s2"] == ("s1/s2", "s1", 2) and got["lost"] == ("lost", "lost", 1)
    with pytest.raises(ValueError):
        classify.taxonomy_paths(spark.createDataFrame([("a", 1, "b"), ("b", 1, "a")], "slug string, level int, parent_slug string"))


def test_rules_as_tables(spark):
    rng = random.Random(41)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 7)))
    rules = [(f"L{rng.randrange(3)}", rng.randrange(50), word(), f"p{i}", f"q{i}") for i in range(400)] + [("L0", 0, None, "x", "x")]
    table = spark.createDataFrame(rules, "l1 string, position int, substring string, l2 string, l3 string")
    titles = [(i, " ".join(word() for _ in range(3)).upper(), f"L{i % 4}" if i % 7 else None, "old", None) for i in range(300)] + [(999, None, "L0", "old", "o3")]
    df = spark.createDataFrame(titles, "id int, title string, category_l1 string, category_l2 string, category_l3 string")
    got = {r.id: (r.category_l2, r.category_l3) for r in classify.classify_by_table(df, table).collect()}
    for i, t, l1, l2, l3 in titles:
        hits = sorted((p, a, b) for s, p, k, a, b in rules if s == l1 and k is not None and k in (t or "").lower())
        assert got[i] == (hits[0][1:] if hits else (l2, l3))
    ordered = classify.rule_list(table, "l2", pattern="substring")
    assert [k for k, _ in ordered] == [k for _, k in sorted((p, k) for _, p, k, _, _ in rules if k is not None)]
    with pytest.raises(ValueError):
        classify.rule_list(table, "l2", pattern="substring", most=10)


def test_keywords_from_a_large_taxonomy_table(spark):
    nodes = [(f"n{i}", 1, None, [f"word{i}x"], i) for i in range(6000)] + [("n7.a", 2, "n7", ["red"], 0), ("n7.b", 2, "n7", ["red", "big"], 1)]
    table = spark.createDataFrame(nodes, "slug string, level int, parent_slug string, keywords array<string>, position int")
    df = spark.createDataFrame([(1, "a word7x big red"), (2, "nothing"), (3, None)], "id long, title string")
    got = {r.id: (r.n1, r.n2, r.n3) for r in classify.classify_keywords(df, table).collect()}
    assert got == {1: ("n7", "n7.b", None), 2: ("uncategorized", None, None), 3: ("uncategorized", None, None)}


def test_keyword_children_are_joined_and_never_gathered(spark, monkeypatch):
    monkeypatch.setattr(classify, "CELL", 7, raising=False)
    nodes = [("a", 1, None, ["red"], 0), ("b", 1, None, ["blue"], 1), ("hot", 2, "a", ["big"], 5), ("hot2", 2, "a", ["big"], 4)]
    nodes += [(f"h{i}", 3, "hot2", [f"k{i}k", "big"], i) for i in range(100)] + [("none", 3, "hot2", None, -1)]
    table = spark.createDataFrame(nodes, "slug string, level int, parent_slug string, keywords array<string>, position int")
    titles = [f"Red BIG k{i}k" for i in range(100)] * 2 + ["blue big", None, "", "red"]
    out = classify.classify_keywords(spark.createDataFrame(list(enumerate(titles)), "id long, title string"), table)
    got = {r.id: (r.n1, r.n2, r.n3, round(r.confidence_n3, 3)) for r in out.collect()}
    want = {i: ("a", "hot2", f"h{i % 100}", 0.667) for i in range(200)}
    assert got == want | {200: ("b", None, None, 0.0), 201: ("uncategorized", None, None, 0.0), 202: ("uncategorized", None, None, 0.0), 203: ("a", None, None, 0.0)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "map_from_entries" not in plan and "mapfromentries" not in plan


def test_pages_with_equal_metadata_stay_apart(spark):
    sold = '{"permalink":"https://x/MLB11111111","sold_quantity":%d}'
    pages = spark.createDataFrame([("m", sold % 5), ("m", sold % 9 + sold % 7)], "source string, html string")
    assert sorted(r.sales for r in extract.extract_sold_quantity(pages).collect()) == [5, 7]
    block = "[Image 1] ![a](y) Nome %d ¥ 3.5 [Image 2] ![a](y) Outro ¥ 4"
    pages = spark.createDataFrame([("m", block % 1), ("m", block % 2)], "source string, markdown string")
    assert sorted(r.title for r in extract.extract_1688_blocks(pages, 1).collect()) == ["Nome 1", "Nome 2"]


def test_repeated_mappings_give_one_row(spark):
    m = spark.createDataFrame([("p", "1", None, None, 9, 0.5), ("p", "1", None, None, 8, 0.9), ("p", "1", None, None, 7, 0.9), ("p", "1", "2", None, 6, None)],
                              "platform string, platform_l1_id string, platform_l2_id string, platform_l3_id string, silver_category_id int, confidence double")
    df = spark.createDataFrame([(1, "p", "1", "5", None), (2, "p", "1", "2", None)], "id int, platform string, platform_l1_id string, platform_l2_id string, platform_l3_id string")
    assert sorted((r.id, r.silver_category_id) for r in classify.resolve_category(df, m).collect()) == [(1, 7), (2, 6)]


def test_no_machine_local_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError):
        shared_dir(Session())
