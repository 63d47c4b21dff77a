"""Streaming forms of the time-bounded behaviours, on Structured Streaming.

Files arrive in any order, so the reductions here wait for no watermark. Every micro-batch is reduced by an associative rule into
merged folders (``folders``), and the answer combines those by the same rule. It is therefore the batch answer over all rows, whatever
the number of micro-batches, a restart neither loses nor doubles a row, and what is stored follows the distinct keys. Only
the one-hour gap between accepted requests depends on the order of all before; it keeps state with timers (``gaps``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from souklens.operators.history import newest, product_velocity
from souklens.operators.similarity import join_tiles, packed_tiles
from souklens.session import checkpointed, scratch_path
from souklens.streaming.folders import is_written, reduced_stream
from souklens.streaming.gaps import accepted_stream


def read_files(spark: SparkSession, path: str, schema, files_per_batch: int = 64) -> DataFrame:
    """Parquet files as a stream, a bounded number of files per micro-batch.

    The source wants a folder or a pattern, so the last character is written as a pattern: a table that is a
    single file is then read as well.
    """
    pattern = path if any(ch in path for ch in "*?[{") else f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)


def drain(stream: DataFrame, name: str = "stream") -> DataFrame:
    """Process what is available, exactly once, into parquet under the shared folder, and read the result."""
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    query = (stream.writeStream.outputMode("append").format("parquet").option("path", out)
             .option("checkpointLocation", scratch_path(spark, f"{name}-progress")).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def dedup_requests(stream: DataFrame, keys: list[str], path: str, at: str = "ts", slot: str = "1 hour") -> DataFrame:
    """At most one request per key and clock slot, the earliest: (keys, slot, first)."""
    def reduce(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys, F.window(at, slot)["start"].alias("slot")).agg(F.min(at).alias("first"))

    return reduced_stream(stream, reduce, lambda rows: rows.groupBy(*keys, "slot").agg(F.min("first").alias("first")), path)


def accepted_requests(requests: DataFrame, keys: list[str], at: str = "ts", ident: str = "event_id", seconds: int = 3600, more: tuple[str, ...] = ()) -> DataFrame:
    """Requests whose key had no accepted request in the ``seconds`` before them: (keys, ident, at) and the columns of ``more``, in time
    order per key, equal times by ident.

    A key's rows are sorted inside its partition and scanned as they stream by, so a task holds one Arrow batch and one time, however
    large the key. Instants travel as microseconds, so the session's time zone has no say in the gap.
    """
    rows = requests.select(F.to_json(F.struct(*keys)).alias("_key"), F.unix_micros(at).alias("_us"), *keys, ident, at, *more)
    ordered = rows.repartition("_key").sortWithinPartitions("_key", "_us", ident)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for batch in batches:
            kept = []
            for k, t in zip(batch["_key"].to_pylist(), batch["_us"].to_pylist()):
                if k != key:
                    key, last = k, None
                kept.append(t is not None and (last is None or t - last >= seconds * 1_000_000))
                if kept[-1]:
                    last = t
            yield batch.filter(pa.array(kept, pa.bool_()))

    return ordered.mapInArrow(scan, ordered.schema).drop("_key", "_us")


def dedup_requests_exact(stream: DataFrame, keys: list[str], path: str, at: str = "ts", ident: str = "event_id", seconds: int = 3600, late: str = "1 hour") -> DataFrame:
    """``accepted_requests`` of all that has arrived, by state that is kept per key between runs; requests may come in any order within
    ``late``, and those behind it are dropped."""
    return accepted_stream(stream, keys, path, accepted_requests, at, ident, seconds, late)


def snapshot_stream(stream: DataFrame, path: str, keys: tuple[str, ...] = ("offer_id", "scraped_at")) -> DataFrame:
    """Snapshot keys, each once, however often and in whatever order they are delivered."""
    once = lambda rows: rows.select(*keys).distinct()
    return reduced_stream(stream, once, once, path)


def velocity_stream(stream: DataFrame, path: str) -> DataFrame:
    """Velocity of every offer from its two newest snapshots. An instant counts once, with its highest sales; the two newest
    of a batch are all that it can add."""
    def two(rows: DataFrame) -> DataFrame:
        known = rows.where(F.col("sales_volume_estimate").isNotNull()).groupBy("offer_id", "scraped_at").agg(F.max(F.col("sales_volume_estimate").cast("long")).alias("sales_volume_estimate"))
        return newest(known, ["offer_id"], [F.desc_nulls_last("scraped_at")], 2).drop("rn")

    return product_velocity(reduced_stream(stream, two, two, path))


def trend_stream(stream: DataFrame, path: str) -> DataFrame:
    """Average, lowest and highest price and row count per day and platform, over all days seen so far."""
    def reduce(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.date_format("scraped_at", "yyyy-MM-dd").alias("date"), "platform").agg(
            F.sum("price_brl").alias("total"), F.count("price_brl").alias("priced"), F.min("price_brl").alias("low"), F.max("price_brl").alias("high"), F.count(F.lit(1)).alias("n"))

    def combine(rows: DataFrame) -> DataFrame:
        return rows.groupBy("date", "platform").agg(*[F.sum(c).alias(c) for c in ("total", "priced")], F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))

    return reduced_stream(stream, reduce, combine, path).select(
        "date", "platform", F.try_divide("total", "priced").alias("avg_price"), F.col("low").alias("min_price"), F.col("high").alias("max_price"), F.col("n").alias("product_count"))


def alert_stream(prices: DataFrame, alerts: DataFrame) -> DataFrame:
    """Price points at or under the target of an active alert for the product (stream-static join)."""
    active = alerts.where("is_active").select("alert_id", "product_id", "target_price")
    return prices.join(active, "product_id").where(F.col("price") <= F.col("target_price"))


def match_stream(new_products: DataFrame, base: DataFrame, path: str, *, threshold: float = 0.7, k: int = 5, edges: DataFrame | None = None,
                 now=None, days: int = 7) -> Callable[[], DataFrame]:
    """Edges (product_a_id, product_b_id, confidence) of products as they arrive; returns a function that runs it.

    A micro-batch is matched to the catalogue, to all arrivals before it and to itself, and the earlier arrivals to it, so two
    arrivals meet whatever batch they come in; of all that was found an arrival's ``k`` best edges count, each pair once. A product with an
    edge in ``edges`` (product_a_id, created_at) of the last ``days`` before ``now`` needs no refresh and is not matched again.
    The catalogue is packed into tiles once, on the first run, and a micro-batch packs only its own arrivals beside them. An id that
    is already there keeps the vector it came with; one that comes twice in a batch has the smaller of its vectors.
    """
    spark, CATALOGUE = base.sparkSession, -1
    schema = "left_id long, right_id long, similarity double"
    numbered = lambda tiles, batch_id: tiles.withColumn("tile", F.col("tile") + F.shiftleft(F.lit(batch_id + 1).cast("long"), 24))
    tile_schema = numbered(packed_tiles(base.select("id", "embedding")), CATALOGUE).schema
    stored = lambda name: spark.read.schema(T.StructType([*tile_schema, T.StructField("batch", T.LongType())])).option(
        "basePath", f"{path}/{name}").parquet(f"{path}/{name}")

    def keep(rows: DataFrame, name: str, batch_id: int) -> DataFrame:
        """Pack rows into tiles of their own number range, written beside those of other batches."""
        numbered(packed_tiles(rows), batch_id).write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
        return spark.read.schema(tile_schema).parquet(f"{path}/{name}/batch={batch_id}")

    def take(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.select("id", "embedding")
        if edges is not None:
            recent = edges.where(F.col("created_at") > F.date_sub(now, days)).select(F.col("product_a_id").alias("id")).distinct()
            fresh = fresh.join(recent, "id", "left_anti")
        fresh = checkpointed(fresh.where(F.col("embedding").isNotNull()).groupBy("id").agg(F.min("embedding").alias("embedding")))
        before = stored("tiles").where(F.col("batch") < batch_id)
        known = before.select(F.explode("ids").alias("id"))
        new = keep(fresh.join(known, "id", "left_anti"), "tiles", batch_id)
        arrivals = keep(fresh, "arrived", batch_id)
        earlier = stored("arrived").where(F.col("batch") < batch_id).drop("batch")
        found = join_tiles(arrivals, before.drop("batch").unionByName(new), k).unionByName(join_tiles(earlier, new, k)).where(F.col("similarity") > threshold)
        found.select("left_id", "right_id", "similarity").write.mode("overwrite").parquet(f"{path}/edges/batch={batch_id}")

    def run() -> DataFrame:
        keep(base.limit(0), "arrived", CATALOGUE)
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/edges/batch={CATALOGUE}")
        if not is_written(spark, f"{path}/tiles/batch={CATALOGUE}"):
            keep(base.select("id", "embedding"), "tiles", CATALOGUE)
        query = new_products.writeStream.foreachBatch(take).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
        found = spark.read.schema(f"{schema}, batch long").option("basePath", f"{path}/edges").parquet(f"{path}/edges")
        latest = found.groupBy("left_id", "right_id").agg(F.max_by("similarity", "batch").alias("similarity"))
        best = newest(latest, ["left_id"], [F.desc("similarity"), F.asc("right_id")], k)
        return best.select(F.col("left_id").alias("product_a_id"), F.col("right_id").alias("product_b_id"), F.col("similarity").alias("confidence"))

    return run

