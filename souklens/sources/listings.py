"""Scraped listings to typed rows, and typed rows to the bronze table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from souklens.functions import fixed
from souklens.functions.numbers import col


def listing_id(url: Column | str, name: Column | str, strip_query: bool = True) -> Column:
    """Last URL segment, up to '?' unless told otherwise; without one the first 50 characters of the name."""
    last = F.element_at(F.split(F.coalesce(col(url), F.lit("")), "/"), -1)
    key = F.substring_index(last, "?", 1) if strip_query else last
    return F.coalesce(F.nullif(key, F.lit("")), F.substring(F.coalesce(col(name), F.lit("")), 1, 50))


def _raw_first(df: DataFrame, field: str) -> Column:
    """A field of raw_data if it is filled there, else the record's own column of that name."""
    inner = F.nullif(F.get_json_object("raw_data", f"$.{field}"), F.lit(""))
    return F.coalesce(inner, F.col(field).cast("string")) if field in df.columns else inner


def normalize_listing(records: DataFrame, category: Column | str | None = None, strip_query: bool = True) -> DataFrame:
    """Scraped records (platform, product_url, product_name, price_brl, ..., raw_data as JSON text) as product rows."""
    cat = F.lit(category) if category is None or isinstance(category, str) else category
    image = F.nullif(F.coalesce("image_url", F.lit("")), F.lit(""))
    identities = F.from_json(F.get_json_object("raw_data", "$.seller_identities"), "array<string>")
    return records.select(
        F.coalesce("platform", F.lit("")).alias("platform"),
        listing_id("product_url", "product_name", strip_query).alias("platform_id"),
        F.substring(F.coalesce("product_name", F.lit("")), 1, 500).alias("title"),
        F.col("price_brl").alias("price"), F.lit("BRL").alias("currency"), F.coalesce("product_url", F.lit("")).alias("url"),
        F.array_compact(F.array(image)).alias("image_urls"), F.coalesce("seller_name", F.lit("")).alias("supplier_name"),
        "moq", F.col("monthly_sales").alias("sales_30d"), "review_count", F.col("rating").alias("review_avg"),
        cat.cast("string").alias("category"), F.lit(True).alias("is_active"),
        F.coalesce(_raw_first(records, "title_cn"), F.lit("")).alias("title_cn"),
        _raw_first(records, "trade_score").try_cast("double").alias("trade_score"),
        F.coalesce(_raw_first(records, "shop_address"), F.lit("")).alias("shop_address"),
        F.coalesce(identities, F.array().cast("array<string>")).alias("seller_identities"),
        _raw_first(records, "top_category_id").alias("top_category_id"),
        _raw_first(records, "second_category_id").alias("second_category_id"),
        _raw_first(records, "third_category_id").alias("third_category_id"),
        _raw_first(records, "create_date").alias("product_create_date"),
        _raw_first(records, "modify_date").alias("product_modify_date"),
    )


def filled(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def to_bronze(products: DataFrame, source: str, names: Mapping[str, str] = fixed.MARKETPLACE_NAMES) -> DataFrame:
    """Active products as bronze rows; products need image_urls and may carry url, review and embedding columns."""
    p = products.where("is_active")
    for c, kind in {"url": "string", "image_urls": "array<string>", "review_count": "int", "review_avg": "double",
                    "image_hash": "string", "embedding": "array<float>"}.items():
        if c not in p.columns:
            p = p.withColumn(c, F.lit(None).cast(kind))
    images = F.coalesce("image_urls", F.array().cast("array<string>"))
    levels = [filled(f"category_l{i}") for i in (1, 2, 3)]
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    raw = F.to_json(F.struct(
        "title", F.nullif(F.col("price").cast("double"), F.lit(0.0)).alias("price"), "currency", "url", images.alias("image_urls"),
        "image_hash", "category_l1", "category_l2", "category_l3", "sales_30d", "review_count", "review_avg", "platform", "platform_id",
        F.col("id").alias("source_row_id"), F.col("embedding").alias("image_embedding")))
    path = F.nullif(F.concat_ws(" > ", *levels), F.lit(""))
    return p.select(
        F.lit(source).alias("source"), F.concat_ws(":", "platform", "platform_id").alias("source_id"),
        F.coalesce(F.try_element_at(table, F.col("platform")), F.col("platform")).alias("marketplace"), "title",
        F.get(images, F.lit(0)).alias("image_url"), images.alias("image_urls"), F.size(images).alias("image_count"), "price", "currency",
        F.when(F.col("platform") != "amazon_us", F.col("price")).alias("price_brl"), "url", F.col("url").alias("product_url"),
        path.alias("category_raw"), F.size(F.array_compact(F.array(*levels))).alias("category_level"),
        "category_l1", "category_l2", "category_l3", F.coalesce("sales_30d", F.lit(0)).alias("sales_30d"),
        F.coalesce("review_count", F.lit(0)).alias("review_count"), "review_avg", raw.alias("raw_data"),
    )


def latest_run(df: DataFrame, kind: str, *, run: str = "run_id", run_kind: str = "run_kind", runs: DataFrame | None = None) -> DataFrame:
    """Rows of the newest run of a kind. The run is found by one aggregate, so a single value is joined back."""
    registry = runs if runs is not None else df
    newest = registry.where(F.col(run_kind) == kind).agg(F.max(run).alias(run))
    return df.where(F.col(run_kind) == kind).join(F.broadcast(newest), run, "left_semi")  # one row


def import_mappings(documents: DataFrame, known: Mapping[str, Sequence[str]] = fixed.MAPPED_CATEGORIES, *, json: str = "json",
                    platforms: Sequence[str] = ("amazon_br", "amazon_us"), confidence: float = 0.8) -> DataFrame:
    """Category mappings from platform -> key -> info JSON; only keys with an internal (l1, l2, l3) are kept."""
    info = "struct<id: string, name_pt: string, name_en: string, bestsellers_url: string>"
    tree = F.from_json(col(json), f"map<string, map<string, {info}>>")
    by_platform = documents.select(F.explode(tree).alias("platform", "keys")).where(F.col("platform").isin(*platforms))
    rows = by_platform.select("platform", F.explode("keys").alias("key", "info")).where(F.col("key").isin(*known))
    table = F.create_map(*[x for k, v in known.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    ours = table[F.col("key")]
    return rows.select(
        *[ours[i].alias(f"our_l{i + 1}") for i in range(3)], "platform",
        F.coalesce("info.id", F.lit("")).alias("platform_category_id"),
        F.coalesce(F.nullif(F.col("info.name_pt"), F.lit("")), F.col("info.name_en"), F.lit("")).alias("platform_category_name"),
        F.coalesce("info.bestsellers_url", F.lit("")).alias("bestsellers_url"), F.lit(confidence).alias("confidence"),
    )


def populate_hierarchy(products: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Fill L1-L3 from (category, l1, l2, l3), leaving rows alone whose L2 and L3 are both set; status says what happened."""
    done = filled("category_l2").isNotNull() & filled("category_l3").isNotNull()
    empty = filled("category_l1").isNull()
    h = hierarchy.select(F.col("category").alias("category_l1"), *[F.col(f"l{i}").alias(f"_l{i}") for i in (1, 2, 3)], F.lit(True).alias("_hit"))
    joined = products.join(h, "category_l1", "left")
    hit = F.col("_hit").isNotNull()
    status = F.when(empty, "missing").when(done, "skipped").when(hit, "updated").otherwise("missing")
    update = status == "updated"
    levels = {f"category_l{i}": F.when(update, F.col(f"_l{i}")).otherwise(F.col(f"category_l{i}")) for i in (1, 2, 3)}
    kept = [c for c in products.columns if c not in levels]
    return joined.select(*kept, *[v.alias(k) for k, v in levels.items()], status.alias("status"))
