"""Reduced rows of a stream in a bounded number of folders.

A micro-batch is reduced and written to a folder of its own. As soon as ``fan`` folders of a level are there they are merged by
the same associative rule into one of the next level, so there are under ``fan`` of each level and the levels grow like the logarithm of
the batches: what is stored, and what an answer reads, follows the distinct keys and not the number of batches. Which folders count is
said by one small file per batch, put in place by a rename. A batch that is repeated after a failure starts from the file before it
and replaces its own file. Folders that neither of the last two files names are deleted.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, types as T

Reduce = Callable[[DataFrame], DataFrame]


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a Spark write to ``path`` has been completed."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


class MergedFolders:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, combine: Reduce, fan: int = 8):
        """``combine`` takes reduced rows and gives reduced rows of the same ``schema``; it has to be associative and to leave its own
        result as it is."""
        self.spark, self.path, self.schema, self.combine, self.fan = spark, path, schema, combine, fan

    # -- files, on whatever file system the path is in

    def _fs(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(folder)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _delete(self, name: str) -> None:
        fs, p = self._fs(name)
        fs.delete(p, True)

    def _batches(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("current") if n.endswith(".json"))

    def _named(self, batch: int) -> list[tuple[str, int]]:
        fs, p = self._fs(f"current/{batch}.json")
        stream = fs.open(p)
        try:
            return [tuple(x) for x in json.loads(bytes(stream.readAllBytes()).decode())]
        finally:
            stream.close()

    def _name(self, batch: int, folders: list[tuple[str, int]]) -> None:
        fs, draft = self._fs(f"current/{batch}.draft")
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps(folders).encode()))
        stream.close()
        hadoop, gateway = self.spark._jvm.org.apache.hadoop.fs, self.spark.sparkContext._gateway
        rename = getattr(hadoop, "Options$Rename")
        over = gateway.new_array(rename, 1)
        over[0] = rename.OVERWRITE  # in one step, also where the batch is repeated
        hadoop.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, self._fs(f"current/{batch}.json")[1], over)

    # -- rows

    def folders(self) -> list[tuple[str, int]]:
        """(folder, level) of the folders that count now."""
        batches = self._batches()
        return self._named(batches[-1]) if batches else []

    def read(self, folders: list[tuple[str, int]] | None = None) -> DataFrame:
        """The rows of the folders that count, combined."""
        folders = self.folders() if folders is None else folders
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.combine(self.spark.read.schema(self.schema).parquet(*[f"{self.path}/rows/{f}" for f, _ in folders]))

    def put(self, reduced: DataFrame, batch: int) -> None:
        """Take the reduced rows of a micro-batch."""
        batches = self._batches()
        if batches and batch < batches[-1]:
            raise ValueError(f"batch {batches[-1]} has been taken already")
        before = [b for b in batches if b < batch]
        folders = self._named(before[-1]) if before else []
        in_use = {f for b in batches[-2:] + before[-1:] for f, _ in self._named(b)}
        for name in self._names("rows"):
            if name not in in_use:
                self._delete(f"rows/{name}")
        for b in before[:-2]:
            self._delete(f"current/{b}.json")
        new = lambda level: (f"{batch}-{level}-{uuid.uuid4().hex[:8]}", level)  # a repeated batch leaves the folders of the first alone
        fresh, level = new(0), 0
        reduced.write.parquet(f"{self.path}/rows/{fresh[0]}")
        folders = [*folders, fresh]
        while len(same := [x for x in folders if x[1] == level]) >= self.fan:
            merged = new(level + 1)
            self.read(same).write.parquet(f"{self.path}/rows/{merged[0]}")
            folders = [x for x in folders if x[1] != level] + [merged]
            level += 1
        self._name(batch, folders)


def reduced_stream(stream: DataFrame, reduce: Reduce, combine: Reduce, path: str, fan: int = 8) -> DataFrame:
    """Drain a stream into merged folders under ``path`` and read them combined. ``path`` also keeps the progress, so a later call goes
    on where the last one ended; a stream without rows gives none."""
    spark = stream.sparkSession
    merged = MergedFolders(spark, path, reduce(spark.createDataFrame([], stream.schema)).schema, combine, fan)
    query = stream.writeStream.foreachBatch(lambda batch, batch_id: merged.put(reduce(batch), batch_id)).option(
        "checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return merged.read()
