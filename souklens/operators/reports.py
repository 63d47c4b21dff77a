"""Aggregate reports over listings, products, edges and mappings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from souklens.functions import fixed
from souklens.functions.market import compute_margins, market_pulse, opportunity_reasoning, verdict
from souklens.functions.numbers import js_round, round_half_up
from souklens.functions.sales_text import parse_sales_cn
from souklens.operators.edges import both_ways, joined_matches, neighbours
from souklens.operators.history import newest, one_row
from souklens.operators.quantiles import one_row_values
from souklens.session import checkpointed, dealt

def row_count() -> Column:
    return F.count(F.lit(1))


def present(c: str) -> Column:
    return F.col(c).isNotNull() & (F.trim(c) != "")


def list_categories(listings: DataFrame, factory: DataFrame, label: str = "category_label", factory_label: str = "product_category") -> DataFrame:
    """Label counts of both catalogues added up."""
    a = listings.where(present(label)).groupBy(F.col(label).alias("label")).agg(row_count().alias("n"))
    b = factory.where(present(factory_label)).groupBy(F.col(factory_label).alias("label")).agg(row_count().alias("n"))
    return a.unionByName(b).groupBy("label").agg(F.sum("n").alias("count"))


def category_stats(listings: DataFrame, label: str | None = None) -> DataFrame:
    """Products, suppliers and rounded means per category; NaN and missing prices are left out."""
    rows = listings.where(present("category_label") & F.col("price_min").isNotNull() & ~F.isnan("price_min"))
    if label is not None:
        rows = rows.where(F.col("category_label") == label)
    return rows.groupBy("category_label").agg(
        row_count().alias("product_count"), F.countDistinct("supplier_name").alias("supplier_count"),
        round_half_up(F.avg("price_min"), 2).alias("avg_price_min"), round_half_up(F.avg("sales_volume_estimate"), 2).alias("avg_sales_volume"),
        round_half_up(F.avg("repurchase_rate"), 1).alias("avg_repurchase_rate"))


def region_counts(suppliers: DataFrame) -> DataFrame:
    return suppliers.where(present("region")).groupBy("region").agg(row_count().alias("count"))


def meta(runs: DataFrame, listings: DataFrame, factory: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Number of runs, newest run and its size for rankings and bestsellers, and how many categories and regions there are."""
    frames = []
    for kind in ("rankings", "bestsellers"):
        r = runs.where(F.col("kind") == kind)
        frames.append(r.agg(row_count().alias(f"{kind}_runs"), F.max("id").alias(f"{kind}_latest_run"), F.coalesce(F.max_by("count", "id"), F.lit(0)).alias(f"{kind}_latest_count")))
    frames.append(list_categories(listings, factory).agg(row_count().alias("categories")))
    frames.append(region_counts(suppliers).agg(row_count().alias("regions")))
    return one_row(*frames)


def factories(factory_products: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per named supplier with the greatest value of each column."""
    return factory_products.where(F.col("supplier_name") != "").groupBy("supplier_name").agg(*[F.max(c).alias(c) for c in columns])


def demand_by_category(silver: DataFrame, n: int = 15) -> DataFrame:
    rows = silver.where(F.col("ml_category").isNotNull() & (F.col("ml_sales_volume") > 0))
    return rows.groupBy("ml_category").agg(
        row_count().alias("product_count"), F.sum("ml_sales_volume").alias("total_ml_sales"), round_half_up(F.avg("ml_sales_volume"), 0).alias("avg_ml_sales"),
        round_half_up(F.avg("price_cny"), 2).alias("avg_price_cny")).orderBy(F.desc("total_ml_sales"), F.asc("ml_category")).limit(n)


def scout_categories(listings: DataFrame, q: str | None = None, *, high: Sequence[str] = fixed.HIGH_VALUE_CATEGORIES,
                     commodity: Sequence[str] = fixed.COMMODITY_CATEGORIES, n: int = 10, texts: Sequence[str] = ("category_label", "category_label_pt", "title", "title_pt")) -> DataFrame:
    """Categories without the commodity ones. With a text: those that mention it in one of ``texts`` (as far as the table has them), high-value
    first, by repurchase and sales, ``n`` of them; without: all."""
    rows = listings.where(F.col("repurchase_rate").isNotNull() & ~F.col("category_label").isin(*commodity))
    if q is not None:
        rows = rows.where(reduce(lambda a, b: a | b, [F.contains(F.lower(t), F.lit(q.lower())) for t in texts if t in listings.columns]))
    stats = rows.groupBy("category_label").agg(
        row_count().alias("product_count"), round_half_up(F.avg("repurchase_rate"), 0).cast("int").alias("avg_repurchase"),
        round_half_up(F.avg("price_min"), 2).alias("avg_price"), F.sum("sales_volume_estimate").alias("total_sales"))
    first = F.when(F.col("category_label").isin(*high), 0).otherwise(1).alias("tier")
    ranked = stats.withColumn("tier", first)
    if q is None:
        return ranked
    return ranked.orderBy(F.asc("tier"), F.desc_nulls_first("avg_repurchase"), F.desc_nulls_first("total_sales"), F.asc("category_label")).limit(n)


def _with_medians(df: DataFrame, **columns: str) -> DataFrame:
    """Lower-middle medians of positive values, as columns on every row (0 without any)."""
    rows = df.withColumn("_one", F.lit(1))
    narrow = checkpointed(df.select(*columns.values()))
    for name, c in columns.items():
        m = one_row_values(narrow, c, {name: 0.5}).select(F.coalesce(name, F.lit(0)).alias(name), F.lit(1).alias("_one"))
        rows = rows.join(F.broadcast(m), "_one")  # one row
    return rows.drop("_one")


def badge_categories(categories: DataFrame) -> DataFrame:
    """Golden Find, Trending Category, Proven, Above-Average Repurchase for category rows (avg_repurchase, total_sales)."""
    rows = _with_medians(categories, _sales="total_sales", _rep="avg_repurchase")
    rep, sales = F.coalesce("avg_repurchase", F.lit(0)), F.coalesce("total_sales", F.lit(0))
    proven, trending = rep >= 70, (sales > F.col("_sales")) & (F.col("_sales") > 0)
    above = (rep > F.col("_rep")) & (F.col("_rep") > 0)
    badges = F.array_compact(F.array(
        F.when(proven & trending, "Golden Find").when(trending, "Trending Category"), F.when(proven & ~trending, "Proven"),
        F.when(~proven & above, "Above-Average Repurchase")))
    return rows.withColumns({"badges": badges, "market_active": trending}).drop("_sales", "_rep")


def badge_products(products: DataFrame, velocity: DataFrame | None = None) -> DataFrame:
    """Golden, proven or trending for product rows (offer_id, repurchase_rate, sales_volume_estimate), a caution for trending
    products that few buy again, and the place in the list: golden, trending with velocity, trending, proven, rest."""
    rows = products
    if velocity is not None:
        up = velocity.where(F.col("daily_velocity") > 0).select("offer_id", F.lit(True).alias("_up"))
        rows = rows.join(up, "offer_id", "left")
    else:
        rows = rows.withColumn("_up", F.lit(None).cast("boolean"))
    rows = _with_medians(rows, _sales="sales_volume_estimate")
    up = F.coalesce("_up", F.lit(False))
    rep, sales = F.coalesce("repurchase_rate", F.lit(0)), F.coalesce("sales_volume_estimate", F.lit(0))
    proven = rep >= 70
    trending = ((sales > F.col("_sales")) & (F.col("_sales") > 0)) | up
    return rows.withColumns({
        "badge": F.when(proven & trending, "Golden Find").when(proven, "Proven").when(trending, "Trending").otherwise(""),
        "trending_caution": trending & ~proven & (rep < 50),
        "badge_order": F.when(proven & trending, 0).when(trending & up, 1).when(trending, 2).when(proven, 3).otherwise(4),
    }).drop("_up", "_sales")


def global_stats(products: DataFrame, edges: DataFrame, taxonomy: DataFrame, category: str = "category_l1") -> DataFrame:
    active = F.col("is_active")
    p = products.where(active).agg(row_count().alias("total_products"), F.count("embedding").alias("embedded_products"), F.countDistinct(category).alias("total_categories"))
    return one_row(p, edges.agg(row_count().alias("total_matches")), taxonomy.agg(row_count().alias("taxonomy_entries")))


def category_histogram(products: DataFrame, category: str = "category_l1") -> DataFrame:
    return products.where(F.col("is_active") & F.col(category).isNotNull()).groupBy(F.col(category).alias("category")).agg(row_count().alias("count"))


def platform_stats(products: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts by platform, by category, and matches per category as rows (kind, name, count)."""
    p = products.where("is_active").select("id", "platform", "category_l1")
    sided = both_ways(edges).join(p, F.col("from_id") == F.col("id"))
    matches = sided.where(F.col("category_l1").isNotNull()).groupBy("category_l1").agg(F.countDistinct("match_id").alias("count"))
    named = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), F.col(c).alias("name"), "count")
    by_category = p.where(F.col("category_l1").isNotNull()).groupBy("category_l1").agg(row_count().alias("count"))
    return named(p.groupBy("platform").agg(row_count().alias("count")), "platform", "platform").unionByName(
        named(by_category, "category", "category_l1")).unionByName(named(matches, "matches", "category_l1"))


PLATFORMS = ("amazon_br", "amazon_us", "ml")


def category_pivot(products: DataFrame, platforms: Sequence[str] = PLATFORMS) -> DataFrame:
    """Products per category path, in all and per platform."""
    return products.where(F.col("is_active") & F.col("category_l1").isNotNull()).groupBy("category_l1", "category_l2", "category_l3").agg(
        row_count().alias("product_count"), *[F.count_if(F.col("platform") == p).alias(f"{p}_count") for p in platforms])


def category_detail(products: DataFrame, edges: DataFrame, l1: str) -> DataFrame:
    """One category by platform and by subcategory, and its matches, as rows (kind, name, count, average, total)."""
    p = products.where(F.col("category_l1") == l1)
    active = p.where("is_active")
    none = F.lit(None)
    by_platform = active.groupBy(F.col("platform").alias("name")).agg(
        row_count().alias("count"), round_half_up(F.avg("price"), 4).alias("average"), F.sum(F.coalesce("sales_30d", F.lit(0))).alias("total")).withColumn("kind", F.lit("platform"))
    sub = active.groupBy(F.concat_ws("/", F.coalesce("category_l2", F.lit("")), F.coalesce("category_l3", F.lit(""))).alias("name")).agg(row_count().alias("count")).select(
        "name", "count", none.cast("double").alias("average"), none.cast("bigint").alias("total"), F.lit("subcategory").alias("kind"))
    m = edges.join(p.select(F.col("id").alias("product_a_id")), "product_a_id", "left_semi").agg(
        row_count().alias("count"), round_half_up(F.avg("confidence"), 6).alias("average")).select(
        F.lit("matches").alias("name"), "count", "average", none.cast("bigint").alias("total"), F.lit("matches").alias("kind"))
    return by_platform.unionByName(sub).unionByName(m)


def category_summary(products: DataFrame, edges: DataFrame, dedup: bool = False, platforms: Sequence[str] = PLATFORMS) -> DataFrame:
    """Products, products per platform and matches per category, with mean price and sales.

    Mean and sum run over product-edge rows, so a product with many edges weighs more; ``dedup`` weighs each product once.
    The edges are first counted per product, so the expansion is arithmetic and not rows.
    """
    sides = both_ways(edges)
    p = products.where(F.col("is_active") & F.col("category_l1").isNotNull())
    degree = sides.groupBy(F.col("from_id").alias("id")).agg(row_count().alias("edges"))
    weighted = p.join(degree, "id", "left").withColumn("w", F.lit(1) if dedup else F.greatest(F.coalesce("edges", F.lit(1)), F.lit(1)))
    sales = F.coalesce("sales_30d", F.lit(0))
    priced = F.when(F.col("price").isNotNull(), F.col("w"))
    stats = weighted.groupBy("category_l1").agg(
        row_count().alias("total_products"), *[F.count_if(F.col("platform") == x).alias(x) for x in platforms],  # one row per product
        round_half_up(F.try_divide(F.sum(F.col("price") * F.col("w")), F.sum(priced)), 2).alias("avg_price"), F.sum(sales * F.col("w")).alias("total_sales"))
    matches = sides.join(p.select(F.col("id").alias("from_id"), "category_l1"), "from_id").groupBy("category_l1").agg(F.countDistinct("match_id").alias("matches"))
    return stats.join(matches, "category_l1", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))


def margin_analysis(edges: DataFrame, products: DataFrame) -> DataFrame:
    m = joined_matches(edges, products, ["price", "category_l1"]).where(F.col("a_price").isNotNull() & F.col("b_price").isNotNull())
    pct = F.when(F.col("b_price") > 0, F.try_divide(F.col("a_price") - F.col("b_price"), F.col("b_price")) * 100).otherwise(0.0)
    return m.groupBy(F.col("a_category_l1").alias("category_l1")).agg(
        row_count().alias("match_count"), round_half_up(F.avg("a_price"), 2).alias("avg_amazon_price"), round_half_up(F.avg("b_price"), 2).alias("avg_ml_price"),
        round_half_up(F.avg(F.col("a_price") - F.col("b_price")), 2).alias("avg_price_diff"), round_half_up(F.avg(pct), 1).alias("avg_margin_pct"),
        round_half_up(F.min(pct), 1).alias("min_margin_pct"), round_half_up(F.max(pct), 1).alias("max_margin_pct"))


def mapping_stats(mappings: DataFrame) -> DataFrame:
    """Mappings per platform and, in the row without one, the number of mappings and of distinct paths."""
    by_platform = mappings.groupBy("platform").agg(
        row_count().alias("total"), F.count_if("verified").alias("verified"), F.count("bestsellers_url").alias("with_url"),
        F.sum(F.coalesce("product_count", F.lit(0))).alias("total_products"), F.lit(None).cast("bigint").alias("internal_categories"))
    path = F.when(F.col("our_l1").isNotNull() & F.col("our_l2").isNotNull() & F.col("our_l3").isNotNull(), F.concat_ws("/", "our_l1", "our_l2", "our_l3"))
    none = F.lit(None).cast("bigint")
    overall = mappings.agg(row_count().alias("total"), F.countDistinct(path).alias("internal_categories")).select(
        F.lit(None).cast("string").alias("platform"), "total", none.alias("verified"), none.alias("with_url"), none.alias("total_products"), "internal_categories")
    return by_platform.unionByName(overall)


def scraper_health(runs: DataFrame) -> DataFrame:
    status = lambda s: F.count_if(F.col("status") == s).alias(f"{s}_count")
    return runs.agg(status("success"), status("error"), status("partial"), row_count().alias("total_runs"), F.max("started_at").alias("last_run"),
                    F.sum("products_inserted").alias("total_products_inserted"))


def validate_mappings(mappings: DataFrame, products: DataFrame, edges: DataFrame) -> DataFrame:
    """Platforms, product counts, match rate against the smaller side and a status for every mapped path."""
    path = ["l1", "l2", "l3"]
    m = mappings.select(*[F.col(f"our_{p}").alias(p) for p in path], "platform").groupBy(*path).agg(
        F.array_join(F.array_sort(F.collect_set("platform")), ",").alias("platforms"), F.countDistinct("platform").alias("platform_count"))
    p = products.select("id", "platform", *[F.col(f"category_{x}").alias(x) for x in path])
    counts = p.groupBy(*path).agg(row_count().alias("products"), F.count_if(F.col("platform").isin("amazon_br", "amazon_us")).alias("amazon"),
                                  F.count_if(F.col("platform").startswith("amazon")).alias("_side"), F.count_if(F.col("platform") == "ml").alias("ml"))
    hits = edges.join(p.withColumnRenamed("id", "product_a_id"), "product_a_id").groupBy(*path).agg(row_count().alias("matches"))
    rows = m.join(counts, path, "left").join(hits, path, "left").fillna(0, ["products", "amazon", "_side", "ml", "matches"])
    amazon, ml = F.col("amazon") > 0, F.col("ml") > 0
    rate = F.when(amazon & ml, F.try_divide(F.col("matches") * 100, F.least("_side", "ml")))
    status = (F.when((F.col("products") == 0) | (~amazon & ~ml), "NO_DATA").when(amazon & ~ml, "AMAZON_ONLY").when(~amazon & ml, "ML_ONLY")
              .when(rate < 20, "LOW_MATCHES").when(rate >= 50, "GOOD").when(F.col("platform_count") < 3, "INCOMPLETE").otherwise("OK"))
    return rows.select(*path, "platforms", "platform_count", "products", "amazon", "ml", "matches", round_half_up(rate, 4).alias("match_rate"), status.alias("status"))


def _image_ok(served: bool = True) -> Column:
    first = F.get("image_urls", F.lit(0))
    ok = first.startswith("http")
    return F.coalesce(ok | first.startswith("/images") if served else ok, F.lit(False))


def quality_audit(products: DataFrame, l1: str | None = None) -> DataFrame:
    """Passed and failed rows per criterion, and the smallest share as overall score."""
    p = products.where("is_active")
    if l1 is not None:
        p = p.where(F.col("category_l1") == l1)
    checks = {"image": _image_ok(), "embedding": F.col("embedding").isNotNull(), "sales": F.col("sales_30d") > 0, "price": F.col("price") > 0}
    one = p.agg(row_count().alias("total"), *[F.count_if(c).alias(k) for k, c in checks.items()]).where(F.col("total") > 0)
    entries = F.array(*[F.struct(F.lit(k).alias("criterion"), F.col(k).alias("passed")) for k in checks])
    share = lambda c: round_half_up(c / F.col("total") * 100, 2)
    return one.withColumn("e", F.explode(entries)).select(
        "e.criterion", "e.passed", (F.col("total") - F.col("e.passed")).alias("failed"), share(F.col("e.passed")).alias("percent"),
        share(F.least(*checks)).alias("overall"))


def quality_fix(products: DataFrame) -> DataFrame:
    """Deactivate active rows without a web image or a positive price."""
    failing = ~_image_ok(served=False) | ~F.coalesce(F.col("price") > 0, F.lit(False))
    return products.withColumn("is_active", F.when(F.col("is_active") & failing, False).otherwise(F.col("is_active")))


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How many rows fill each column."""
    return df.agg(row_count().alias("total"), *[F.count(c).alias(f"has_{c}") for c in columns])


def classification_coverage(products: DataFrame, levels: Sequence[str] = ("category_l1", "category_l2", "category_l3")) -> DataFrame:
    one = products.where("is_active").agg(row_count().alias("total"), *[F.count(c).alias(c) for c in levels])
    entries = F.array(*[F.struct(F.lit(c).alias("level"), F.col(c).alias("classified")) for c in levels])
    return one.withColumn("e", F.explode(entries)).select("e.level", "e.classified", "total", round_half_up(F.col("e.classified") / F.col("total") * 100, 1).alias("percent"))


def top_categories(products: DataFrame, column: str, n: int = 10) -> DataFrame:
    rows = products.where(F.col("is_active") & F.col(column).isNotNull())
    return rows.groupBy(F.col(column).alias("category")).agg(row_count().alias("count")).orderBy(F.desc("count"), F.asc("category")).limit(n)


def audit_sample(products: DataFrame, n: int, seed: int, ident: str = "id") -> DataFrame:
    """A random sample of ``n`` active rows, the same for the same seed whatever the partitioning."""
    key = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(ident).cast("string")))
    return products.where("is_active").orderBy(key, F.col(ident)).limit(n)


def detect_opportunities(products: DataFrame, *, category: str | None = None, min_score: float = 0.0, n: int = 50, home: str = "ml",
                         category_column: str = "category_l1") -> DataFrame:
    """Products that sell abroad, scored against their home-market peers.

    Peers are the five home products of the category with the lowest ids (of all categories for a product without one).
    """
    cat = F.col(category_column)
    p = products.where(F.col("embedding").isNotNull()).withColumn("_cat", cat)
    sales, reviews, rating = [F.coalesce(c, F.lit(0)) for c in ("sales_30d", "review_count", "review_avg")]
    velocity = F.when(F.contains("platform", F.lit("1688")), sales * 0.4 + reviews * 0.3 + rating * 20 * 0.3).otherwise(sales * 0.5 + reviews * 0.5)
    abroad = p.where(F.col("is_active") & (F.col("platform") != home))
    if category is not None:
        abroad = abroad.where(cat == category)
    top = abroad.withColumn("velocity", velocity).orderBy(F.desc("velocity"), F.asc("id")).limit(n)
    home_rows = p.where(F.col("platform") == home).select("id", "_cat", "price")
    five = newest(home_rows.where(F.col("_cat").isNotNull()), ["_cat"], [F.asc("id")], 5, "_rn")
    overall = home_rows.orderBy("id").limit(5).select("id", F.lit(None).cast("string").alias("_cat"), "price")
    peers = five.drop("_rn").unionByName(overall).groupBy("_cat").agg(row_count().alias("_n"), F.avg("price").alias("_avg")).withColumnRenamed("_cat", "_pc")
    rows = top.join(peers, F.col("_cat").eqNullSafe(F.col("_pc")), "left").withColumns({
        "peers": F.coalesce("_n", F.lit(0)), "price_home_avg": F.coalesce("_avg", F.lit(0.0)), "price_abroad": F.coalesce("price", F.lit(0.0))})
    n_peers, avg, price, v = F.col("peers"), F.col("price_home_avg"), F.col("price_abroad"), F.col("velocity")
    gap = v / F.greatest(n_peers * 10, F.lit(1))
    margin = F.when((price > 0) & (avg > 0), F.try_divide(avg - price * 1.5, avg) * 100).otherwise(0.0)
    demand = F.least(v / 100, F.lit(1.0)) + F.when(reviews > 0, F.least(reviews / 50, F.lit(0.5))).otherwise(0.0)
    competition = F.when(n_peers == 0, "none").when(n_peers < 3, "low").when(n_peers < 10, "medium").otherwise("high")
    scored = rows.withColumns({"_gap": gap, "_margin": margin, "_demand": demand, "competition": competition})
    total = F.least(F.lit(100.0), F.col("_gap") * 30 + F.col("_margin") * 0.4 * 30 + F.col("_demand") * 40)
    kept = scored.withColumn("_score", total).where(F.col("_score") >= min_score)
    return kept.select(
        "id", "platform", "title", "price_abroad", round_half_up("price_home_avg", 4).alias("price_home_avg"), cat.alias("category"), sales.alias("sales_30d"),
        reviews.alias("review_count"), round_half_up("_gap", 2).alias("velocity_gap"), round_half_up("_margin", 1).alias("margin_pct"),
        round_half_up("_demand", 2).alias("demand_signal"), "competition", round_half_up("_score", 1).alias("composite_score"),
        opportunity_reasoning(sales, reviews, n_peers, round_half_up("_margin", 0), F.col("competition")).alias("reasoning"))


def opportunity_scores(df: DataFrame) -> DataFrame:
    """Score 0-100 from min-max normalised velocity gap, margin and demand (ml_sales_velocity, china_sales_velocity,
    margin_pct, demand_signal), and the kind of opportunity."""
    ml, cn = F.coalesce("ml_sales_velocity", F.lit(0.0)), F.coalesce("china_sales_velocity", F.lit(0.0))
    rows = df.withColumns({
        "velocity_gap": ml / F.greatest(cn, F.lit(1.0)),
        "opportunity_type": F.when(ml <= 0, "china_bestseller_no_ml").when(cn <= 0, "ml_bestseller_no_china").otherwise("high_velocity_gap")})
    parts = ("velocity_gap", "margin_pct", "demand_signal")
    bounds = rows.agg(*[f(c).alias(f"_{n}_{c}") for c in parts for n, f in (("lo", F.min), ("hi", F.max))]).withColumn("_one", F.lit(1))
    joined = rows.withColumn("_one", F.lit(1)).join(F.broadcast(bounds), "_one")  # one row
    norm = lambda c: F.coalesce(F.try_divide(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")), F.lit(0.0))
    score = reduce(lambda a, b: a * b, [norm(c) for c in parts]) * 100
    return joined.withColumn("score", round_half_up(score, 4)).withColumn("velocity_gap", round_half_up("velocity_gap", 6)).select(
        *df.columns, "velocity_gap", "opportunity_type", "score")


def product_stats(rows: DataFrame) -> DataFrame:
    """Mean positive price, translated titles, mean sales, distinct categories, source and enrichment counts of merged products."""
    price, sales = F.when(F.col("price") > 0, F.col("price")), parse_sales_cn("sales")
    count = lambda c, v: F.count_if(F.col(c) == v)
    return rows.agg(
        row_count().alias("total"), round_half_up(F.avg(price), 4).alias("avg_price"), F.count_if(F.trim("title_pt") != "").alias("with_pt"),
        round_half_up(F.avg(F.when(sales > 0, sales)), 4).alias("avg_sales"), F.countDistinct(F.nullif("category_label", F.lit(""))).alias("distinct_categories"),
        *[count("source", s).alias(f"source_{s}") for s in ("ranked", "bestseller", "factory")],
        *[count("enrichment_status", s).alias(f"enrichment_{s}") for s in ("complete", "partial", "none")])


def top_values(rows: DataFrame, columns: Sequence[str], n: int = 8) -> DataFrame:
    """The ``n`` most frequent values of each column: (field, value, count, rank)."""
    entries = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]))
    counts = rows.select(entries.alias("e")).select("e.*").where(F.col("value").isNotNull() & (F.col("value") != "")).groupBy("field", "value").agg(row_count().alias("count"))
    return newest(counts, ["field"], [F.desc("count"), F.asc("value")], n, "rank")


def price_quartiles(rows: DataFrame, price: str = "price") -> DataFrame:
    values = one_row_values(rows, price, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return one_row(values, rows.where(F.col(price) > 0).agg(F.max(price).alias("max")))


def price_bands(rows: DataFrame, price: str = "price") -> DataFrame:
    """Five bands cut at the quartiles and the maximum, with labels and counts."""
    rows = checkpointed(rows.select(price).where(F.col(price) > 0))  # read three times, made once
    q = price_quartiles(rows, price).withColumn("_one", F.lit(1)).where(F.col("max").isNotNull())
    p = F.col(price)
    tagged = rows.where(p > 0).withColumn("_one", F.lit(1)).join(F.broadcast(q), "_one")  # one row
    counts = tagged.groupBy("q1", "median", "q3", "max").agg(
        F.count_if(p < F.col("q1")).alias("b1"), F.count_if((p >= F.col("q1")) & (p < F.col("median"))).alias("b2"),
        F.count_if((p >= F.col("median")) & (p < F.col("q3"))).alias("b3"), F.count_if((p >= F.col("q3")) & (p < F.col("max"))).alias("b4"),
        F.count_if(p >= F.col("max")).alias("b5"))

    def fmt(c):
        v = F.col(c)
        return F.when(v >= 1000, F.concat(F.format_string("%.1f", F.round((v / 1000).cast("decimal(30,10)"), 1).cast("double")), F.lit("k"))).otherwise(js_round(v).cast("string"))

    yen = lambda c: F.concat(F.lit("¥"), fmt(c))
    span = lambda a, b: F.concat(yen(a), F.lit(" – "), yen(b))
    bands = [(F.concat(F.lit("< "), yen("q1")), "b1"), (span("q1", "median"), "b2"), (span("median", "q3"), "b3"), (span("q3", "max"), "b4"), (F.concat(F.lit("> "), yen("max")), "b5")]
    entries = F.array(*[F.struct(F.lit(i).alias("band"), label.alias("label"), F.col(c).alias("count")) for i, (label, c) in enumerate(bands, 1)])
    return counts.select(F.explode(entries).alias("e")).select("e.*")


def sales_gaps(products: DataFrame, market: str = "platform") -> DataFrame:
    """Products without sales per market and category."""
    gap = products.where(F.col("sales_30d").isNull() | (F.col("sales_30d") == 0))
    return gap.groupBy(market, "category_l1").agg(row_count().alias("no_sales"))


def distinct_values(df: DataFrame, columns: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Distinct non-blank values of the columns together with a given list."""
    values = df.select(F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("value"))
    if extra:
        values = values.unionByName(df.sparkSession.createDataFrame([(x,) for x in extra], "value string"))
    return values.where(F.col("value").isNotNull() & (F.trim("value") != "")).distinct()


def refresh_mapping_counts(mappings: DataFrame, products: DataFrame, now: Column) -> DataFrame:
    """Product count of each mapped path, and when it was taken."""
    counts = products.groupBy(*[F.col(f"category_{x}").alias(f"our_{x}") for x in ("l1", "l2", "l3")]).agg(row_count().alias("_n"))
    joined = mappings.drop("product_count", "last_scraped").join(counts, ["our_l1", "our_l2", "our_l3"], "left")
    return joined.withColumns({"product_count": F.coalesce("_n", F.lit(0)), "last_scraped": now}).drop("_n")


def cluster_price_range(rows: DataFrame, cluster: str = "leader_id", price: str = "price_brl", order: str = "id") -> DataFrame:
    """Lowest and highest positive price of a cluster and its platforms in first-seen order."""
    positive = F.when(F.col(price) > 0, F.col(price))
    per = rows.groupBy(cluster, "platform").agg(F.min(positive).alias("lo"), F.max(positive).alias("hi"), F.min(order).alias("first"))
    seen = F.transform(F.array_sort(F.collect_list(F.struct("first", "platform"))), lambda x: x["platform"])
    return per.groupBy(cluster).agg(F.min("lo").alias("min_price"), F.max("hi").alias("max_price"), F.array_join(seen, ",").alias("platforms"))


def product_report(products: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    """Margins, pulse and verdict of every product from its active neighbours.

    Products carry sales_total and bsr_rank, either of which may be NULL.
    """
    near = dealt(neighbours(edges, products), "from_id")  # they are sorted by product, and grow faster than the products
    # The n best of a product's neighbours are counted, not fetched: their number is at most n, and the best confidence is the greatest.
    facts = near.groupBy(F.col("from_id").alias("id")).agg(
        F.countDistinct("platform_id").alias("_others"), F.least(row_count(), F.lit(n)).cast("long").alias("match_count"), F.max("confidence").alias("best_confidence"))
    own = products.select("id", F.col("platform").alias("_own"), F.col("price").alias("source_price"), F.coalesce("currency", F.lit("CNY")).alias("source_currency"))
    offers = near.where(F.col("price") > 0).select(
        F.col("from_id").alias("id"), F.col("platform").alias("sell_platform"), F.col("price").alias("sell_price"),
        F.coalesce("currency", F.lit("USD")).alias("sell_currency"), "confidence", "to_id")
    offers = own.join(offers, "id").where((F.col("sell_platform") != F.col("_own")) & (F.col("source_price") > 0))
    margins = compute_margins(offers)
    order = F.struct("margin_pct", (-F.col("quantity")).alias("q"), "confidence", (-F.col("to_id")).alias("t"))
    best = margins.groupBy("id").agg(F.max_by(F.struct("margin_pct", "sell_platform", "quantity"), order).alias("b"), row_count().alias("margin_count"))
    joined = products.join(facts, "id", "left").join(best, "id", "left").withColumns({
        "seller_count": F.coalesce("_others", F.lit(0)) + 1, "match_count": F.coalesce("match_count", F.lit(0)),
        "best_margin": F.coalesce("b.margin_pct", F.lit(0.0)), "best_platform": F.coalesce("b.sell_platform", F.lit("")),
        "best_quantity": F.coalesce("b.quantity", F.lit(0)), "margin_count": F.coalesce("margin_count", F.lit(0)),
    })
    return verdict(market_pulse(joined)).drop("_others", "b")
