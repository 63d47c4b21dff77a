"""Streams over several micro-batches against their batch twins, and file formats."""

import json
import random

import pytest
from pyspark.sql import functions as F, types as T

from souklens.operators.history import product_velocity
from souklens.session import scratch_path, shared_dir
from souklens.sources import files
from souklens.streaming import streams as st
from souklens.streaming.folders import MergedFolders, reduced_stream
from souklens.streaming.gaps import SLOTS

LINEITEM = "/root/testdata/sf0.001/lineitem.parquet"


@pytest.fixture(scope="module")
def parts(spark):
    """The line items in eight shuffled files."""
    path = scratch_path(spark, "parts")
    spark.read.parquet(LINEITEM).selectExpr(
        "l_partkey as offer_id", "cast(l_shipdate as timestamp) as scraped_at", "cast(l_quantity as bigint) as sales_volume_estimate",
        "l_extendedprice / l_quantity as price_brl", "l_returnflag as platform").repartition(8, F.rand(3)).write.parquet(path)
    return path


@pytest.fixture(params=[1, 64])
def arriving(request, spark, parts):
    return st.read_files(spark, parts, spark.read.parquet(parts).schema, request.param)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_velocity_stream_equals_batch(spark, parts, arriving):
    batch = spark.read.parquet(parts).groupBy("offer_id", "scraped_at").agg(F.max("sales_volume_estimate").alias("sales_volume_estimate"))
    cols = ["offer_id", "current_sales", "previous_sales", "sales_delta", "days_between", "daily_velocity"]
    assert rows(st.velocity_stream(arriving, scratch_path(spark, "v")).select(cols)) == rows(product_velocity(batch).select(cols))


def test_velocity_counts_a_redelivered_snapshot_once(spark):
    path = scratch_path(spark, "again")
    for day, sales in ((1, 100), (2, 130), (2, 130)):
        spark.createDataFrame([(7, f"2024-01-0{day}", sales)], "offer_id long, d string, sales_volume_estimate long").selectExpr(
            "offer_id", "cast(d as timestamp) as scraped_at", "sales_volume_estimate").coalesce(1).write.mode("append").parquet(path)
    stream = st.read_files(spark, path, spark.read.parquet(path).schema, 1)
    found = st.velocity_stream(stream, scratch_path(spark, "v")).first()
    assert (found.current_sales, found.previous_sales, found.daily_velocity) == (130, 100, 30.0)


def test_snapshot_stream_keeps_every_snapshot_once(spark, parts, arriving):
    assert rows(st.snapshot_stream(arriving, scratch_path(spark, "s"))) == rows(spark.read.parquet(parts).select("offer_id", "scraped_at").distinct())


def test_trend_stream_has_all_days(spark, parts, arriving):
    found = st.trend_stream(arriving, scratch_path(spark, "t")).select("date", "platform", "min_price", "max_price", "product_count", F.round("avg_price", 6))
    want = spark.read.parquet(parts).groupBy(F.date_format("scraped_at", "yyyy-MM-dd").alias("date"), "platform").agg(
        F.min("price_brl"), F.max("price_brl"), F.count("*"), F.round(F.avg("price_brl"), 6))
    assert rows(found) == rows(want)


@pytest.mark.parametrize("files", [1, 64])
def test_exact_dedup_measures_from_the_last_accepted_request(spark, files):
    path = scratch_path(spark, "requests")
    minutes = [0, 30, 59, 60, 100, 119, 120, 121]
    spark.createDataFrame([(i, "q", m) for i, m in enumerate(minutes)], "event_id long, q string, m int").selectExpr(
        "event_id", "q", "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, m) as ts").repartition(8, F.rand(5)).write.parquet(path)
    stream = st.read_files(spark, path, "event_id long, q string, ts timestamp", files)
    found = st.dedup_requests_exact(stream, ["q"], scratch_path(spark, "r"), late="3 hours")
    assert sorted(r.event_id for r in found.collect()) == [0, 3, 6]


def _by_hand(requests, seconds):
    """Accepted (key, id) of (id, key, time) rows."""
    last, out = {}, []
    for t, i, q in sorted((t, i, q) for i, q, t in requests if t is not None):
        if q not in last or t - last[q] >= seconds:
            last[q] = t
            out.append((q, i))
    return sorted(out, key=str)


def test_exact_dedup_goes_on_after_a_restart_and_forgets_quiet_keys(spark):
    rng = random.Random(11)
    requests = [(i, rng.choice(["a", "b", None, f"k{i // 40}"]), 20 * i + rng.randint(0, 900)) for i in range(900)]
    requests += [(900 + i, "hot", 20 * i) for i in range(900)] + [(5000, "a", None)]
    path, out = scratch_path(spark, "requests"), scratch_path(spark, "r")
    order = sorted(requests, key=lambda r: (r[2] or 0, r[0]))
    order = [r for i in range(0, len(order), 150) for r in rng.sample(order[i:i + 150], len(order[i:i + 150]))]

    def arrive(rows):
        spark.createDataFrame(rows, "event_id long, q string, s int").selectExpr(
            "event_id", "q", "timestamp_seconds(1700000000 + s) as ts").coalesce(1).write.mode("append").parquet(path)

    found = []
    for a in range(0, len(order), 300):  # each a run of its own, which ends and starts again
        for b in range(a, min(a + 300, len(order)), 100):
            arrive(order[b:b + 100])
        stream = st.read_files(spark, path, "event_id long, q string, ts timestamp", 1)
        found = sorted(((r.q, r.event_id) for r in st.dedup_requests_exact(stream, ["q"], out, seconds=1800, late="1 hour").collect()), key=str)
        assert found == _by_hand(order[:a + 300], 1800)
    state = {n: spark.read.format("statestore").option("path", f"{out}/progress").option("stateVarName", n).load() for n in ("last", "waiting")}
    assert state["last"].count() < 15 and state["waiting"].count() < 500  # of 26 keys and 1800 requests
    newest = max(t for _, _, t in requests if t is not None)
    assert state["waiting"].agg(F.min("list_element.us")).first()[0] > (1_700_000_000 + newest - 3700 - 3000) * 1_000_000


def test_late_requests_are_dropped_and_empty_streams_give_none(spark):
    path, out = scratch_path(spark, "requests"), scratch_path(spark, "r")
    schema = "event_id long, q string, ts timestamp"
    spark.createDataFrame([], schema).write.parquet(path)
    assert st.dedup_requests_exact(st.read_files(spark, path, schema), ["q"], out).count() == 0
    for i, s in enumerate([0, 50_000, 10, 50_010]):
        spark.createDataFrame([(i, "q", s)], "event_id long, q string, s int").selectExpr("event_id", "q", "timestamp_seconds(1700000000 + s) as ts").coalesce(1).write.mode("append").parquet(path)
        got = st.dedup_requests_exact(st.read_files(spark, path, schema, 1), ["q"], out, late="1 hour")
    assert sorted(r.event_id for r in got.collect()) == [0, 1]


def test_exact_dedup_keeps_state_by_slots_of_keys(spark):
    """The state of every key by itself took several calls a key and more than half the run."""
    path, out = scratch_path(spark, "requests"), scratch_path(spark, "r")
    requests = [(i, float("nan") if i % 3000 == 1 else None if i % 3000 == 2 else float(i % 3000), b"b" if i % 2 else None, i % 1700) for i in range(6000)]
    spark.createDataFrame(requests, "event_id long, q double, r binary, s int").selectExpr(
        "event_id", "q", "r", "timestamp_seconds(1700000000 + s) as ts").repartition(2).write.parquet(path)
    got = st.dedup_requests_exact(st.read_files(spark, path, "event_id long, q double, r binary, ts timestamp", 1), ["q", "r"], out, seconds=300, late="10 minutes")
    want = _by_hand([(i, (str(q), r), s) for i, q, r, s in requests], 300)
    assert sorted((((str(x.q), x.r and bytes(x.r)), x.event_id) for x in got.collect()), key=str) == want
    timers = spark.read.format("statestore").option("path", f"{out}/progress").option("stateVarName", "timer").load()
    assert 0 < timers.count() <= SLOTS


def _counted(spark, n):
    path = scratch_path(spark, "many")
    for i in range(n):
        spark.createDataFrame([(k, 1) for k in (i % 7, 3, 100 + i % 2)], "k long, n long").coalesce(1).write.mode("append").parquet(path)
    return path


def test_fifty_batches_leave_few_folders(spark):
    path, out = _counted(spark, 50), scratch_path(spark, "merged")
    total = lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n"))
    got = dict(reduced_stream(st.read_files(spark, path, "k long, n long", 1), total, total, out, fan=4).collect())
    want = dict(spark.read.parquet(path).groupBy("k").count().collect())
    assert got == want
    kept = MergedFolders(spark, out, None, None)
    assert len(kept.folders()) <= 3 * 3 and len(kept._names("rows")) <= 3 * len(kept.folders()) + 8 and len(kept._names("current")) <= 4


def test_a_repeated_batch_counts_once(spark):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("n", T.LongType())])
    total = lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n"))
    merged = MergedFolders(spark, scratch_path(spark, "again"), schema, total, fan=2)
    rows = lambda n: spark.createDataFrame([(1, n)], schema)
    assert merged.read().count() == 0
    for batch, n in ((0, 1), (1, 10), (1, 10), (2, 100), (3, 1000), (3, 1000), (3, 1000), (4, 10_000)):
        merged.put(rows(n), batch)
    assert merged.read().first()["n"] == 11_111


@pytest.mark.parametrize("files", [1, 64])
def test_first_request_of_every_hour(spark, files):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    path = scratch_path(spark, "events")
    events.repartition(8, F.rand(1)).write.parquet(path)
    found = st.dedup_requests(st.read_files(spark, path, events.schema, files), ["user_id", "event_type"], scratch_path(spark, "r"))
    want = events.groupBy("user_id", "event_type", F.date_trunc("hour", "ts")).agg(F.min("ts"))
    assert rows(found) == rows(want)


def test_match_stream_does_not_depend_on_batches(spark):
    base = spark.createDataFrame([(i, [1.0, float(i), 0.5]) for i in range(12)], "id long, embedding array<float>")
    new = spark.createDataFrame([(100 + i, [1.0, i + 0.25, 0.4]) for i in range(9)], base.schema)
    path = scratch_path(spark, "arriving")
    new.repartition(3).write.parquet(path)
    one, many = (st.match_stream(st.read_files(spark, path, base.schema, n), base, scratch_path(spark, "found"), threshold=0.5, k=3)() for n in (64, 1))
    assert rows(one) == rows(many)
    assert one.where("product_b_id >= 100").count() > 0 and one.groupBy("product_a_id").count().where("count > 3").count() == 0


def test_match_stream_packs_only_what_arrives(spark):
    base = spark.createDataFrame([(i, [1.0, float(i), 0.5]) for i in range(40)], "id long, embedding array<float>")
    path, out = scratch_path(spark, "arriving"), scratch_path(spark, "found")
    written = {}
    for n, first in enumerate((100, 200, 35)):  # the last batch brings products that are there already
        spark.createDataFrame([(first + i, [1.0, i + 0.25, 0.4]) for i in range(5)], base.schema).coalesce(1).write.mode("append").parquet(path)
        found = st.match_stream(st.read_files(spark, path, base.schema, 1), base, out, threshold=0.5, k=3)()
        assert found.select("product_a_id").distinct().count() == 5 * (n + 1)
        tiles = spark.read.option("basePath", f"{out}/tiles").parquet(f"{out}/tiles").withColumn("file", F.input_file_name())
        now = {(r.file, r.batch): r.n for r in tiles.groupBy("file", "batch").agg(F.sum(F.size("ids")).alias("n")).collect()}
        assert {k: v for k, v in now.items() if k in written} == written  # earlier tiles are left as they are
        written = now
    assert {b: sum(v for (_, x), v in written.items() if x == b) for _, b in written} == {-1: 40, 0: 5, 1: 5}


def test_match_stream_leaves_out_fresh_edges(spark):
    base = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)], "id long, embedding array<float>")
    path = scratch_path(spark, "arriving")
    base.write.parquet(path)
    edges = spark.createDataFrame([(1, "2024-05-30"), (2, "2024-01-01")], "product_a_id long, d string").selectExpr("product_a_id", "cast(d as date) as created_at")
    run = st.match_stream(st.read_files(spark, path, base.schema), base, scratch_path(spark, "found"), threshold=0.1, edges=edges, now=F.lit("2024-06-01").cast("date"))
    assert {r.product_a_id for r in run().collect()} == {0, 2, 3}


def test_product_files_are_json_arrays(spark):
    path = scratch_path(spark, "json")
    df = spark.createDataFrame([("ml", str(i), f'título "{i}"') for i in range(10)], "source_platform string, source_product_id string, product_name string")
    files.write_products(df.repartition(3), path)
    texts = [r[0] for r in spark.read.text(path, wholetext=True).collect()]
    records = [x for t in texts for x in json.loads(t)]
    assert len(records) == 10 and files.read_products(spark, path).select("product_name").distinct().count() == 10


def test_csv_export_quotes_everything(spark):
    path = scratch_path(spark, "csv")
    df = spark.createDataFrame([(1, 'say "hi", you', None)], "id int, note string, empty string")
    files.export_csv(df.coalesce(1), ["id", "note", "empty"], path)
    lines = spark.read.text(path).collect()
    assert [r[0] for r in lines] == ['"﻿id","note","empty"', '"1","say ""hi"", you",""']


def test_shared_dir_is_kept(spark):
    assert shared_dir(spark) == shared_dir(spark)
