"""Keep-first dedup and merges of several catalogues."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from souklens.functions.numbers import col
from souklens.functions.sales_text import format_sales, parse_sales_cn
from souklens.functions.text import title_key


def dedupe_by(df: DataFrame, key: Sequence[Column | str], order: Column) -> DataFrame:
    """First row per key. min_by is combined before the shuffle, so a key that fills the table sends one row per task."""
    names = [f"_k{i}" for i in range(len(key))]
    keyed = df.select("*", *[col(k).alias(n) for k, n in zip(key, names)], order.alias("_o"))
    first = keyed.groupBy(*names).agg(F.min_by(F.struct(*df.columns), "_o").alias("_w"))
    return first.select(*[F.col("_w")[c].alias(c) for c in df.columns])


def bestsellers(listings: DataFrame, order: Column) -> DataFrame:
    """Listings once per offer id, or per title, supplier and keyword where there is none."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("title", "supplier_name", "keyword")]
    return dedupe_by(listings, [F.coalesce(F.col("offer_id").cast("string"), F.concat_ws("|", *parts))], order)


def stacked(sources: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Union with the source's name and its place in the list."""
    tagged = [df.withColumns({"source": F.lit(name), "priority": F.lit(i)}) for i, (name, df) in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def merge_catalogues(ranked: DataFrame, bestseller: DataFrame, factory: DataFrame, order: str = "position") -> DataFrame:
    """One row per title and supplier; ranked before bestseller before factory, then input order."""
    rows = stacked([("ranked", ranked), ("bestseller", bestseller), ("factory", factory)])
    key = [F.coalesce("title", F.lit("")), F.coalesce("supplier_name", F.lit("Unknown"))]
    return dedupe_by(rows, key, F.struct("priority", order))


def category_products(labels: Sequence[str], ranked: DataFrame, bestseller: DataFrame, factory: DataFrame, order: str = "position") -> DataFrame:
    """Products of the labels (any case) from three sources, once per supplier, title and price, by sales then price."""
    wanted = [label.lower() for label in labels]
    rows = stacked([("ranked", ranked), ("bestseller", bestseller), ("factory", factory)]).where(F.lower("category_label").isin(wanted))
    once = dedupe_by(rows, ["supplier_name", "title", "price"], F.struct("priority", order))
    return once.orderBy(F.desc(parse_sales_cn(F.col("sales"))), F.desc(F.coalesce("price", F.lit(0.0))), F.asc("priority"), F.asc(order))


TOP_PRODUCTS = """array<struct<image_url: string, price: string, sales: string, title: string, title_pt: string, source_url: string,
    category_label: string, category_id: string>>"""


def ranked_products(suppliers: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """One row per top product of a ranked supplier, by rank; price digits, link key and repeats removed.

    ``titles`` (title, title_pt) adds translations where the product has none of its own.
    """
    # Rows of a compact file come in one task; the first-row aggregate sorts what a task has, so they are dealt to many first.
    rows = suppliers.hint("rebalance").withColumn("_p", F.from_json("top_products_json", TOP_PRODUCTS)).select(
        *[c for c in suppliers.columns if c != "top_products_json"], F.posexplode("_p").alias("_pos", "p"))
    link = F.coalesce("p.source_url", "p.image_url", "supplier_name")
    once = dedupe_by(rows, [link, "p.price"], F.struct("rank_position", "supplier_key", "_pos"))
    slug = F.when(F.col("category_id").isNotNull() & F.col("rank_position").isNotNull(), F.concat_ws("_", "category_id", "rank_position")).otherwise(
        F.url_encode(F.replace(F.coalesce(F.col("supplier_key").cast("string"), F.col("supplier_name")), F.lit("/"), F.lit("-"))))
    out = once.select(
        F.col("p.title").alias("title"), F.col("p.title_pt").alias("title_pt"), F.col("p.image_url").alias("image_url"),
        F.regexp_replace("p.price", "[^0-9.]", "").try_cast("double").alias("price"), format_sales(F.col("p.sales")).alias("sales"),
        F.coalesce("p.category_label", "category_label").alias("category_label"), F.coalesce("p.category_id", "category_id").alias("category_id"),
        F.col("p.source_url").alias("source_url"), "supplier_name", F.concat(F.lit("/suppliers/"), slug).alias("supplier_href"), "region",
        F.col("rank_position").alias("rank"), F.col("_pos").alias("position"),
    )
    return out if titles is None else enrich_titles(out, titles)


def enrich_titles(df: DataFrame, titles: DataFrame) -> DataFrame:
    """title_pt from a translation table where one is known for the title."""
    known = titles.where(F.col("title_pt").isNotNull() & (F.col("title_pt") != ""))
    t = known.groupBy("title").agg(F.max("title_pt").alias("_pt"))
    return df.join(t, "title", "left").withColumn("title_pt", F.coalesce("_pt", "title_pt")).drop("_pt").select(*df.columns)


def bestseller_matches(titles: DataFrame, ml_bestsellers: DataFrame) -> DataFrame:
    """Bestseller facts for the wanted titles, compared trimmed and in lower case. Of several rows of a title the one
    ordered last by position (missing ones after all) is taken."""
    wanted = titles.select(title_key("title").alias("_t")).distinct()
    rows = ml_bestsellers.withColumn("_t", F.lower("title")).join(wanted, "_t", "left_semi")
    last = F.struct(F.col("position").isNull().alias("n"), "position", "total_sales", "category_name")
    facts = F.struct("position", "total_sales", "sales_velocity", "category_name")
    return rows.groupBy(title_key("title").alias("title")).agg(F.max_by(facts, last).alias("f")).select("title", "f.*")


def _ordered_set(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Distinct non-blank values per key in first-seen order; only distinct values are gathered."""
    firsts = rows.where(F.col(value).isNotNull() & (F.trim(value) != "")).groupBy(key, value).agg(F.min(order).alias("_o"))
    ordered = F.array_sort(F.collect_list(F.struct("_o", F.col(value).alias("v"))))
    return firsts.groupBy(key).agg(F.transform(ordered, lambda x: x["v"]).alias(f"{value}s"))


def _supplier_key() -> Column:
    return F.lower(F.trim("supplier_name"))


def supplier_profiles(suppliers: DataFrame, listings: DataFrame, order: str = "row_id", product: str = "offer_id") -> DataFrame:
    """Ranking row and product facts per supplier, joined on the trimmed lower-case name (key), ranked or not.

    Labels, category ids and source URLs are distinct values in first-seen order, the ranking's own first. Products are the sorted distinct
    ``product`` keys; their rows are a table of their own, ``supplier_products``, with the same key. Columns that a table lacks (category_id,
    category_ids, category_name, source_url, supplier_url) give nothing.
    """
    name = _supplier_key()
    text = lambda df, c: (F.col(c) if c in df.columns else F.lit(None)).cast("string")
    r = suppliers.select(name.alias("key"), "supplier_key", F.col("supplier_name").alias("ranked_name"), "region", "rank_position",
                         F.col("category_label").alias("ranked_label"), text(suppliers, "category_id").alias("ranked_id"), text(suppliers, "source_url").alias("ranked_url"))
    l = listings.where(F.col("supplier_name").isNotNull()).withColumn("key", name)
    facts = l.groupBy("key").agg(F.min_by("supplier_name", order).alias("listed_name"))
    products = l.where(F.col(product).isNotNull()).select("key", product).distinct().groupBy("key").agg(F.array_sort(F.collect_list(product)).alias("products"))

    def seen(what: str, ranked: str, *listed: str) -> DataFrame:
        both = r.select("key", F.col(ranked).alias(what), F.lit("").alias(order))
        for c in listed:
            both = both.unionByName(l.select("key", text(listings, c).alias(what), order))
        return _ordered_set(both, "key", what, order)

    out = r.join(facts, "key", "full_outer").join(products, "key", "left")
    for part in (seen("category_label", "ranked_label", "category_label", "category_name"), seen("category_id", "ranked_id", "category_ids"), seen("source_url", "ranked_url", "supplier_url")):
        out = out.join(part, "key", "left")
    return out.select(
        "key", F.coalesce(F.col("supplier_key").cast("string"), "listed_name").alias("id"), F.coalesce("ranked_name", "listed_name").alias("name"),
        "region", "rank_position", "category_labels", "category_ids", "source_urls", F.coalesce(F.size("products"), F.lit(0)).cast("long").alias("product_count"),
        F.coalesce("products", F.array().cast(products.schema["products"].dataType)).alias("products"))


def supplier_products(listings: DataFrame, order: str = "row_id", product: str = "offer_id") -> DataFrame:
    """(key, product, its columns): the first row of every product of every supplier, one row each, for ``supplier_profiles`` of the same key.
    A supplier of many products is many rows and never one."""
    l = listings.where(F.col("supplier_name").isNotNull()).withColumn("key", _supplier_key())
    first = l.groupBy("key", product).agg(F.min_by(F.struct(*[c for c in listings.columns if c != product]), order).alias("row"))
    return first.select("key", product, "row.*")


def supplier_profile(profiles: DataFrame, key: str) -> DataFrame:
    """The profile whose id or name equals ``key`` (trimmed, any case); an id wins over a name."""
    wanted = key.strip().lower()
    by_id, by_name = (F.lower(F.trim(c)) == wanted for c in ("id", "name"))
    return profiles.where(by_id | by_name).orderBy(F.when(by_id, 0).otherwise(1), "id").limit(1)


def product_profile(key: str, sources: Sequence[tuple[str, DataFrame, Sequence[str]]], order: str = "position") -> DataFrame:
    """First product one of whose key columns equals ``key`` (trimmed, any case), sources tried in order."""
    wanted = key.strip().lower()
    hits = []
    for name, df, keys in sources:
        same = reduce(lambda a, b: a | b, [F.lower(F.col(k).cast("string")) == wanted for k in keys])
        hits.append((name, df.where(same)))
    return stacked(hits).orderBy("priority", order).limit(1)


def borrow_supplier_url(products: DataFrame, fan_out: bool = False) -> DataFrame:
    """Products with an offer id; a missing supplier URL comes from the supplier's rows without one.

    Those rows can be several; ``fan_out`` keeps one result row for each, otherwise the greatest URL is used.
    """
    offer = F.coalesce(F.col("offer_id").cast("string"), F.lit(""))
    bare = products.where(offer == "").select("supplier_name", F.col("supplier_url").alias("_url"))
    if not fan_out:
        bare = bare.groupBy("supplier_name").agg(F.max("_url").alias("_url"))
    joined = products.where(offer != "").join(bare, "supplier_name", "left")
    return joined.withColumn("supplier_url", F.coalesce("supplier_url", "_url")).drop("_url")


def merge_category_results(results: DataFrame, exclude: Sequence[str], order: Column) -> tuple[DataFrame, DataFrame]:
    """Results of several searches as one list (excluded words out, one row per URL, cheapest first), and the
    platform counts over all of them."""
    name = F.lower(F.coalesce("product_name", F.lit("")))
    bad = reduce(lambda a, b: a | b, [F.contains(name, F.lit(w)) for w in exclude], F.lit(False))
    kept = results.where(~bad & (F.coalesce("product_url", F.lit("")) != ""))
    merged = dedupe_by(kept, ["product_url"], order).orderBy(F.coalesce("price_brl", F.lit(0.0)), "product_url")
    counts = results.groupBy("platform").agg(F.count(F.lit(1)).alias("products"))
    return merged, counts
