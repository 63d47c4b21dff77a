"""Reading and writing products, tables and exports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

# The unified record that every scraper emits.
PRODUCT_SCHEMA = """
    source_platform string, source_product_id string, source_url string, product_name string, product_name_en string,
    price_low double, price_high double, price_currency string, price_cny double, seller_name string, seller_id string,
    seller_rating double, seller_url string, moq int, image_url string, monthly_sales bigint, review_count int,
    rating double, category string, description string, scraped_at string, raw_data string
"""


def read_products(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Product records from JSON, one array per file, or one record per line; raw_data stays JSON text."""
    return spark.read.schema(PRODUCT_SCHEMA).option("multiLine", not lines).json(path)


def _as_array(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    first = True
    for batch in batches:
        if len(batch):
            text = batch["value"].copy()
            text.iloc[0] = ("[" if first else ",") + text.iloc[0]
            text.iloc[1:] = "," + text.iloc[1:]
            first = False
            yield pd.DataFrame({"value": text})
    yield pd.DataFrame({"value": ["[]" if first else "]"]})


def write_products(df: DataFrame, path: str, lines: bool = False) -> None:
    """Write product records: every output file is one JSON array, or with ``lines`` one record per line."""
    if lines:
        df.write.mode("overwrite").json(path)
        return
    records = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    records.mapInPandas(_as_array, "value string").write.mode("overwrite").text(path)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def read_jdbc(spark: SparkSession, url: str, table: str, *, properties: dict[str, str], partition_column: str | None = None,
              lower: int | None = None, upper: int | None = None, partitions: int = 1) -> DataFrame:
    """A database table, read in ``partitions`` ranges of a numeric column; credentials come from the caller."""
    if partition_column is None:
        return spark.read.jdbc(url, table, properties=properties)
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower, upperBound=upper,
                           numPartitions=partitions, properties=properties)


def sql(spark: SparkSession, text: str, args: dict | None = None, **tables: DataFrame) -> DataFrame:
    """SQL with bound parameters (:name) over tables given as {name}."""
    return spark.sql(text, args=args or {}, **tables)


def export_csv(df: DataFrame, columns: list[str], path: str) -> None:
    """CSV of the chosen columns: every value quoted, quotes doubled, NULL empty, and a byte-order mark in the header.

    One header per output file, as Spark writes one file per partition.
    """
    text = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])
    marked = text.withColumnRenamed(columns[0], "﻿" + columns[0])
    marked.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"', quote='"', emptyValue="", encoding="UTF-8")


def read_export(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', multiLine=True, enforceSchema=True)


def decode_embedding(df: DataFrame, text: str | None = None, blob: str | None = None, out: str = "embedding") -> DataFrame:
    """Embeddings from their text or float32 form, whichever a row has."""
    from souklens.functions.vectors import embedding_from_blob, embedding_from_text

    forms = ([embedding_from_text(text)] if text else []) + ([embedding_from_blob(F.col(blob))] if blob else [])
    return df.withColumn(out, F.coalesce(*forms))
