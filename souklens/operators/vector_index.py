"""An approximate vector index: k-means cells with inverted lists, kept as a partitioned table.

The coarse quantiser is Spark ML's k-means by cosine over a bounded sample; every row goes to the cell of its nearest centre. The lists are
a Parquet table partitioned by vector width and cell, so a search reads only the cells that its queries ask for. A query probes the
cells of its nearest centres, and the rows of those cells are scored exactly by the tiled join, block by cell: a large cell
becomes more tiles. With all cells probed the answer is the exact one. Rows may be added later; they join the cells that are there.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from souklens.operators.similarity import similarity_join, unit_rows
from souklens.session import checkpointed

MOST_CELLS = 4096  # of one width: what is broadcast is at most so many centres
SAMPLE_PER_CELL = 64  # rows from which k-means learns a cell
ROUNDS = 10


def _usable(df: DataFrame, ident: str, vec: str) -> DataFrame:
    """(id, embedding, width) of rows with an id and a vector that is not zero and has no NULL or non-finite element."""
    rows = df.select(F.col(ident).alias("id"), F.col(vec).cast("array<float>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)).withColumn("width", F.size("embedding"))


def _centres(rows: DataFrame, n: int, cells: int | None, seed: int) -> np.ndarray:
    """Unit centres of the rows of one width."""
    k = cells or max(1, min(MOST_CELLS, round(math.sqrt(n))))
    share = min(1.0, SAMPLE_PER_CELL * k / n)
    place = F.shiftrightunsigned(F.xxhash64("id"), 11) / F.lit(float(1 << 53))
    unit = rows if share == 1.0 else rows.where(place < share)
    points = unit.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    if k == 1:
        return unit_rows(np.array([points.first()[0].toArray()])) if points.head(1) else np.ones((1, 1))
    model = KMeans(k=k, seed=seed, maxIter=ROUNDS, distanceMeasure="cosine", initMode="random").fit(checkpointed(points))
    found = np.array(model.clusterCenters())
    return unit_rows(found[np.linalg.norm(found, axis=1) > 0])


class VectorIndex:
    """Centres of each width and the path of the lists."""

    def __init__(self, spark: SparkSession, path: str, centres: dict[int, np.ndarray], id_type: T.DataType):
        self.spark, self.path, self.centres, self.id_type = spark, path, centres, id_type

    # -- building

    @classmethod
    def build(cls, df: DataFrame, path: str, *, ident: str = "id", vec: str = "embedding", cells: int | None = None, seed: int = 1) -> VectorIndex:
        """Learn the cells of every vector width (about the square root of its rows, MOST_CELLS at most, unless ``cells`` is given) and write
        all usable rows to their lists under ``path``. An empty table makes an index without cells."""
        spark = df.sparkSession
        rows = checkpointed(_usable(df, ident, vec))
        counts = {r["width"]: r["n"] for r in rows.groupBy("width").agg(F.count("*").alias("n")).collect()}
        centres = {w: _centres(rows.where(F.col("width") == w), n, cells, seed) for w, n in sorted(counts.items())}
        index = cls(spark, path, centres, rows.schema["id"].dataType)
        flat = [(w, i, c.tolist()) for w, m in centres.items() for i, c in enumerate(m)]
        spark.createDataFrame(flat, "width int, cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
        spark.createDataFrame([(json.dumps(index.id_type.jsonValue()),)], "id_type string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
        index._write(rows, "overwrite")
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex:
        """The index written under ``path``."""
        centres: dict[int, list] = {}
        for r in spark.read.parquet(f"{path}/centres").orderBy("width", "cell").collect():
            centres.setdefault(r["width"], []).append(r["centre"])
        kind = json.loads(spark.read.parquet(f"{path}/about").first()["id_type"])
        return cls(spark, path, {w: np.array(c) for w, c in centres.items()}, T.StructType.fromJson(
            {"type": "struct", "fields": [{"name": "id", "type": kind, "nullable": True, "metadata": {}}]})["id"].dataType)

    def add(self, df: DataFrame, *, ident: str = "id", vec: str = "embedding") -> None:
        """Put more rows into the lists. Rows of a width that the index does not know are left out."""
        self._write(_usable(df, ident, vec), "append")

    def _write(self, rows: DataFrame, mode: str) -> None:
        placed = self._nearest(rows.where(F.col("width").isin(list(self.centres))), 1).select("id", "embedding", "width", F.get("cells", F.lit(0)).alias("cell"))
        # A cell is written by a few tasks, in files of bounded size, and a hot one by as many as hold it.
        placed.repartition("width", "cell").write.mode(mode).option("maxRecordsPerFile", 1 << 18).option("partitionOverwriteMode", "static").partitionBy("width", "cell").parquet(f"{self.path}/lists")

    def lists(self) -> DataFrame:
        """(id, embedding, width, cell): all rows of the index."""
        schema = T.StructType([T.StructField("id", self.id_type), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("width", T.IntegerType()), T.StructField("cell", T.IntegerType())])
        if not self.centres:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/lists")

    # -- searching

    def _nearest(self, rows: DataFrame, n: int) -> DataFrame:
        """``rows`` (id, embedding, width) with the cells of their ``n`` nearest centres, nearest first."""
        known = self.spark.sparkContext.broadcast(self.centres)
        schema = T.StructType([*rows.select("id", "embedding", "width").schema, T.StructField("cells", T.ArrayType(T.IntegerType()))])

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                widths, vectors = batch["width"].to_numpy(), batch["embedding"]
                cells: list = [None] * batch.num_rows
                for w in np.unique(widths):
                    at = np.flatnonzero(widths == w)
                    mat = unit_rows(np.asarray(vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)).reshape(len(at), w))
                    first = np.argsort(-(mat @ known.value[int(w)].T), axis=1, kind="stable")[:, :n].astype(np.int32)
                    for i, own in zip(at.tolist(), first):
                        cells[i] = own
                yield pa.RecordBatch.from_arrays([batch["id"], vectors, batch["width"], pa.array(cells, pa.list_(pa.int32()))], names=schema.names)

        return rows.select("id", "embedding", "width").mapInArrow(work, schema)

    def search(self, queries: DataFrame, k: int, *, probes: int | None = 8, threshold: float | None = None, ident: str = "id", vec: str = "embedding") -> DataFrame:
        """(left_id, right_id, similarity, rank): the ``k`` most similar rows of the probed cells for every usable query row, itself (its
        id) left out; equal similarities by the smaller id. ``probes`` None looks into all cells, which is exact. Queries of a
        width that the index does not know have no answer; a query id that comes with several vectors has one list for all."""
        asking = _usable(queries, ident, vec).where(F.col("width").isin(list(self.centres)))
        most = max((len(c) for c in self.centres.values()), default=1)
        if (probes or most) >= most:  # all lists, which a query then meets as one block and not once for each cell
            return similarity_join(asking, self.lists(), k=k, threshold=threshold)
        asked = checkpointed(self._nearest(asking, min(probes or most, most)).select("id", "embedding", "width", F.explode("cells").alias("cell")))
        wanted = asked.select("width", "cell").distinct()  # the lists are read by partition pruning on these
        found = self.lists().join(F.broadcast(wanted), ["width", "cell"], "left_semi")  # at most MOST_CELLS rows a width
        return similarity_join(asked, found, block="cell", k=k, threshold=threshold)


def knn_by_index(queries: DataFrame, index: VectorIndex, k: int, *, probes: int | None = 8) -> DataFrame:
    """``knn`` by an index instead of all rows."""
    return index.search(queries, k, probes=probes)
