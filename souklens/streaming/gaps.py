"""At most one accepted request per key and gap, with state that is kept between runs.

Requests wait until the watermark has passed them, are then taken in time order, and each is accepted if the last accepted one of its
key is a gap or more before it. The state of a key is that last time and what waits. A request that cannot be accepted any
more is not kept, and a key that has been quiet for a gap has no state. So the state holds the keys of the last gap and the requests
of the allowed lateness (and of one micro-batch), however long the stream runs.

Every access to the state is a call from the Python worker to its executor, which costs more than a request's own work. Keys are therefore
dealt by hash to SLOTS slots, and the calls are those of a slot and not of each key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from souklens.streaming.folders import MergedFolders

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SLOTS = 1024  # a progress folder keeps to the number that it began with


def _same(key: tuple) -> str:
    """Equal for equal keys: NaN and what cannot be hashed as well."""
    return repr([bytes(v) if isinstance(v, bytearray) else v for v in key])


class Gap(StatefulProcessor):
    def __init__(self, keys: list[T.StructField], ident: T.StructField, micros: int):
        self.keys, self.ident, self.micros = keys, ident, micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        own = [T.StructField(f"key{i}", f.dataType) for i, f in enumerate(self.keys)]
        self.last = handle.getListState("last", T.StructType([*own, T.StructField("us", T.LongType())]))
        self.waiting = handle.getListState("waiting", T.StructType([*own, T.StructField("us", T.LongType()), T.StructField("ident", self.ident.dataType)]))
        self.timer = handle.getValueState("timer", T.StructType([T.StructField("ms", T.LongType())]))

    def _wake(self, us: int) -> None:
        """A timer for the moment after ``us``, unless an earlier one is set."""
        ms, now = us // 1000 + 1, self.timer.get()[0] if self.timer.exists() else None
        if now is None or ms < now:
            if now is not None:
                self.handle.deleteTimer(now)
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def _accepted(self) -> dict[str, tuple]:
        """(key columns, time of the last accepted request) of the slot's keys."""
        return {_same(x[:-1]): tuple(x) for x in self.last.get()} if self.last.exists() else {}

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = self._accepted()
        names = [f.name for f in self.keys]
        some, first = [], None
        for r in rows:
            own, us = tuple(r[n] for n in names), r["_us"]
            if not last or (x := last.get(_same(own))) is None or us >= x[-1] + self.micros:
                some.append((*own, us, r[self.ident.name]))
                first = us if first is None else min(first, us)
            if len(some) == 10_000:
                self.waiting.appendList(some)
                some = []
        if some:
            self.waiting.appendList(some)
        if first is not None:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.timer.clear()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        before = self._accepted()
        last, out, ahead = dict(before), [], []
        for x in sorted((x for x in waiting if x[-2] <= passed), key=lambda x: (x[-2], x[-1] is None, x[-1] or 0)):
            at = last.get(same := _same(x[:-2]))
            if at is None or x[-2] - at[-1] >= self.micros:
                last[same] = x[:-1]
                out.append(Row(**{f.name: v for f, v in zip(self.keys, x)}, **{self.ident.name: x[-1]}, _us=x[-2]))
        for x in waiting:
            if x[-2] > passed and ((at := last.get(_same(x[:-2]))) is None or x[-2] - at[-1] >= self.micros):
                ahead.append(x)
        held = {_same(x[:-2]) for x in ahead}
        last = {same: x for same, x in last.items() if x[-1] + self.micros > passed or same in held}  # nothing else can follow within the gap
        if last:
            self.last.put(list(last.values()))
        elif before:
            self.last.clear()
        if ahead:
            self.waiting.put(ahead)
        elif waiting:
            self.waiting.clear()
        if wake := [x[-2] for x in ahead] + [x[-1] + self.micros for x in last.values()]:
            self._wake(min(wake))
        return iter(out)

    def close(self) -> None:
        pass


@contextmanager
def _rocksdb(spark: SparkSession):
    """State with timers needs this store; the session's own choice is put back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def _state(spark: SparkSession, path: str, name: str, fields: list[T.StructField]) -> DataFrame:
    """The values of a state variable, none before the first batch."""
    schema = T.StructType(fields)
    try:
        rows = spark.read.format("statestore").option("path", path).option("stateVarName", name).load()
    except PySparkException as e:
        if "STDS" in (e.getCondition() or "") or "STATE" in (e.getCondition() or ""):
            return spark.createDataFrame([], schema)
        raise
    names = [f.name for f in fields]
    return rows.select("list_element.*").toDF(*names)


def accepted_stream(requests: DataFrame, keys: list[str], path: str, batch_rule: Callable[..., DataFrame], at: str = "ts", ident: str = "event_id",
                    seconds: int = 3600, late: str = "1 hour") -> DataFrame:
    """Drain ``requests`` and give all accepted so far: (keys, ident, at).

    Equal times go by ident. A request that comes more than ``late`` behind the newest one of an earlier micro-batch is dropped; without
    such, the answer is that of the batch rule over all rows, however they were batched. What the watermark has not passed yet is judged by
    ``batch_rule`` when the answer is made, and again by the next run. Requests without a time are never accepted.
    ``path`` keeps state, progress and accepted requests, and a later call goes on from there.
    """
    spark = requests.sparkSession
    fields = {f.name: f for f in requests.schema}
    out = T.StructType([*[fields[k] for k in keys], fields[ident], T.StructField("_us", T.LongType())])
    timed = requests.select(*keys, ident, F.col(at).cast("timestamp").alias("_at")).where(F.col("_at").isNotNull()).withColumn("_us", F.unix_micros("_at"))
    timed = timed.withColumn("_slot", F.pmod(F.xxhash64(*keys), F.lit(SLOTS)))
    judged = timed.withWatermark("_at", late).groupBy("_slot").transformWithState(Gap([fields[k] for k in keys], fields[ident], seconds * 1_000_000), out, "Append", "EventTime")
    accepted = MergedFolders(spark, f"{path}/accepted", out, lambda rows: rows)
    key_fields, us = [fields[k] for k in keys], T.StructField("_us", T.LongType())
    with _rocksdb(spark):
        query = judged.writeStream.foreachBatch(accepted.put).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
        last = _state(spark, f"{path}/progress", "last", [*key_fields, us])
        waiting = _state(spark, f"{path}/progress", "waiting", [*key_fields, us, fields[ident]])
    when = F.timestamp_micros("_us").alias(at)
    open_now = waiting.select(*keys, ident, when, F.lit(False).alias("_known")).unionByName(
        last.select(*keys, F.lit(None).cast(fields[ident].dataType).alias(ident), when, F.lit(True).alias("_known")))
    tail = batch_rule(open_now, keys, at, ident, seconds, more=("_known",)).where(~F.col("_known")).drop("_known")
    return accepted.read().select(*keys, ident, when).unionByName(tail)
