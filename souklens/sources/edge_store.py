"""Match edges by category, where a nightly run replaces the categories that it has matched and leaves the others alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from souklens.streaming.folders import MergedFolders

EDGES = "match_id string, product_a_id long, product_b_id long, confidence double, match_method string"


class EdgeStore:
    """Edges under ``path``. A run writes its edges and the list of categories it has matched, and counts from one rename on: until
    then readers see the edges before it, afterwards for each category those of the last run that matched it, which may be none.
    Earlier rows of a replaced category go when folders are merged."""

    def __init__(self, spark: SparkSession, path: str, edges: str = EDGES, category: str = "category_l1"):
        self.spark, self.category = spark, category
        self.columns = spark.createDataFrame([], edges).schema
        marks = [T.StructField(category, T.StringType()), T.StructField("_run", T.LongType()), T.StructField("_edge", T.BooleanType())]
        self.folders = MergedFolders(spark, path, T.StructType([*marks, *self.columns]), self._latest)

    def _latest(self, rows: DataFrame) -> DataFrame:
        """Rows of the last run of every category; a category without edges keeps its mark."""
        key = F.struct(self.category)  # a missing category is one as well
        last = rows.groupBy(key.alias("_key")).agg(F.max("_run").alias("_last"))
        kept = rows.withColumn("_key", key).join(last, "_key").where(F.col("_run") == F.col("_last"))
        return kept.select(*self.folders.schema.names)

    def replace(self, edges: DataFrame, categories: DataFrame, run: int) -> None:
        """Put ``edges`` (the store's columns and the category) in the place of all earlier ones of ``categories``, a table with the
        category column. Edges of other categories are refused. ``run`` grows from run to run; the last one may be repeated."""
        names = [self.category, *self.columns.names]
        key = F.struct(self.category).alias("_key")
        done = categories.select(self.category).distinct()
        rows = edges.select(*names)
        if not rows.select(key).join(done.select(key), "_key", "left_anti").isEmpty():
            raise ValueError("edges of a category that is not replaced")
        marks = done.select(self.category, *[F.lit(None).cast(f.dataType).alias(f.name) for f in self.columns])
        both = rows.withColumn("_edge", F.lit(True)).unionByName(marks.withColumn("_edge", F.lit(False))).withColumn("_run", F.lit(run).cast("long"))
        self.folders.put(both.select(*self.folders.schema.names), run)

    def read(self) -> DataFrame:
        """(category, edge columns) of all categories."""
        return self.folders.read().where("_edge").select(self.category, *self.columns.names)
