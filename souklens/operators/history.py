"""Snapshots and price history: velocity, trends, series, drops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from souklens.functions.numbers import js_round, round_half_up, whole_days


def one_row(*frames: DataFrame) -> DataFrame:
    """Lay one-row frames side by side by a union and one aggregate (no cross join)."""
    total = frames[0]
    for f in frames[1:]:
        total = total.unionByName(f, allowMissingColumns=True)
    return total.agg(*[F.max(c).alias(c) for c in total.columns])


def newest(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rn") -> DataFrame:
    """The first ``n`` rows per key. A plain row_number filter, which Spark also applies before the
    shuffle, so a hot key sends at most n rows per map task."""
    ranked = df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(rank) <= n)


def product_velocity(snapshots: DataFrame) -> DataFrame:
    """Latest against previous snapshot of every offer; snapshots without sales are skipped first."""
    known = snapshots.where(F.col("sales_volume_estimate").isNotNull())
    two = newest(known, ["offer_id"], [F.desc_nulls_last("scraped_at"), F.desc("sales_volume_estimate")], 2)

    def at(rank: int, c: str) -> Column:
        return F.max(F.when(F.col("rn") == rank, F.col(c)))

    wide = two.groupBy("offer_id").agg(
        at(1, "sales_volume_estimate").alias("current_sales"), at(2, "sales_volume_estimate").alias("previous_sales"),
        at(1, "scraped_at").alias("latest_scrape"), at(2, "scraped_at").alias("previous_scrape"),
    )
    days = whole_days("latest_scrape", "previous_scrape")
    delta = F.col("current_sales") - F.col("previous_sales")
    daily = F.when(F.col("previous_sales").isNotNull() & (days > 0), round_half_up(F.try_divide(delta, days), 1))
    return wide.select(
        "*", (F.col("current_sales") - F.coalesce("previous_sales", F.lit(0))).alias("sales_delta"),
        days.alias("days_between"), daily.alias("daily_velocity"),
    )


def weekly(c: Column | str = "daily_velocity") -> Column:
    return round_half_up((F.col(c) if isinstance(c, str) else c) * 7, 1)


def trending(velocity: DataFrame, listings: DataFrame, direction: str = "any", n: int = 10) -> DataFrame:
    """Listings of the fastest moving offers, up, down or any."""
    v = velocity.where(F.col("daily_velocity").isNotNull())
    if direction == "up":
        v = v.where(F.col("daily_velocity") > 0)
    elif direction == "down":
        v = v.where(F.col("daily_velocity") < 0)
    joined = v.join(listings, "offer_id").select(
        "offer_id", "row_id", "title", "category_label", "current_sales", "previous_sales", "sales_delta",
        "daily_velocity", weekly().alias("weekly_velocity"), "days_between", "price_min", "repurchase_rate",
        "supplier_name",
    )
    return joined.orderBy(F.desc(F.abs("daily_velocity")), F.asc("offer_id"), F.asc("row_id")).limit(n)


def attach_velocity(products: DataFrame, velocity: DataFrame, key: str = "id") -> DataFrame:
    """Left join of velocity onto products; the weekly figure is rounded to a whole number."""
    v = velocity.select(
        F.col("offer_id").alias(key), "daily_velocity",
        js_round(F.col("daily_velocity") * 7).alias("weekly_velocity"), "sales_delta",
    )
    return products.join(v, key, "left")


def snapshot_dates(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy(F.date_format("scraped_at", "yyyy-MM-dd").alias("snap_date")).agg(
        F.countDistinct("offer_id").alias("product_count")
    )


def velocity_summary(velocity: DataFrame, snapshots: DataFrame) -> DataFrame:
    d = F.col("daily_velocity")
    moves = velocity.where(d.isNotNull()).agg(
        F.count(F.lit(1)).alias("unique_products_with_velocity"),
        F.count_if(d > 0).alias("products_trending_up"), F.count_if(d < 0).alias("products_trending_down"),
        round_half_up(F.avg(d), 1).alias("avg_daily_velocity"), F.sum("sales_delta").alias("total_sales_delta"),
    )
    days = snapshots.agg(
        F.count(F.lit(1)).alias("total_snapshots"),
        F.date_format(F.max("scraped_at"), "yyyy-MM-dd HH:mm:ss").alias("latest_scrape_date"),
        F.countDistinct(F.to_date("scraped_at")).alias("unique_snapshot_dates"),
    )
    return one_row(moves, days).withColumn("has_velocity_data", F.col("unique_products_with_velocity") > 0)


def velocity_time_stats(velocity: DataFrame, snapshots: DataFrame) -> DataFrame:
    d = F.col("daily_velocity")
    moves = velocity.where(d.isNotNull()).agg(
        F.count(F.lit(1)).alias("products_with_velocity"), F.count_if(d > 0).alias("products_gaining"),
        F.count_if(d == 0).alias("products_stable"), F.count_if(d < 0).alias("products_declining"),
        round_half_up(F.avg(d * 7), 0).alias("avg_weekly_velocity"),
        round_half_up(F.sum(d * 7), 1).alias("estimated_weekly_sales"),
    )
    days = snapshots.select(F.to_date("scraped_at").alias("d")).distinct().orderBy(F.desc("d")).limit(2)
    # At most two dates are left here.
    span = days.agg(F.max("d").alias("hi"), F.min("d").alias("lo"), F.count(F.lit(1)).alias("n"))
    two = F.col("n") == 2
    dates = span.select(
        F.date_format("hi", "yyyy-MM-dd").alias("latest_snapshot_date"),
        F.when(two, F.date_format("lo", "yyyy-MM-dd")).alias("previous_snapshot_date"),
        F.when(two, F.date_diff("hi", "lo")).alias("snapshot_span_days"),
    )
    return one_row(moves, dates)


def velocity_context(velocity: DataFrame, snapshots: DataFrame) -> DataFrame:
    totals = snapshots.agg(
        F.count(F.lit(1)).alias("total_snapshots"), F.countDistinct("offer_id").alias("unique_products"),
        F.date_format(F.max("scraped_at"), "yyyy-MM-dd HH:mm:ss").alias("latest_scrape_date"),
    )
    moving = velocity.where(F.col("daily_velocity").isNotNull()).agg(F.count(F.lit(1)).alias("products_with_velocity"))
    return one_row(totals, moving).withColumn("has_velocity_data", F.col("products_with_velocity") > 0)


def top_risers(velocity: DataFrame, listings: DataFrame, n: int = 5) -> DataFrame:
    """Trending by positive sales change, highest velocity first."""
    v = velocity.where(F.col("daily_velocity").isNotNull() & (F.col("sales_delta") > 0))
    return v.join(listings, "offer_id").select(
        "offer_id", "row_id", "title", "daily_velocity", "sales_delta"
    ).orderBy(F.desc("daily_velocity"), F.asc("offer_id"), F.asc("row_id")).limit(n)


def daily_snapshot(products: DataFrame, at: Column) -> DataFrame:
    """Price and sales of the active products at one instant, to be appended to the history."""
    return products.where("is_active").select(F.col("id").alias("product_id"), "price", "sales_30d", at.alias("recorded_at"))


def record_search(results: DataFrame, query: Column | str, at: Column) -> DataFrame:
    """Search results as price snapshots; names are cut at 200 characters, the URL serves as product id."""
    q = F.lit(query) if isinstance(query, str) else query
    return results.select(
        q.alias("query"), F.coalesce("platform", F.lit("")).alias("platform"),
        F.coalesce("product_url", F.lit("")).alias("product_id"),
        F.substring(F.coalesce("product_name", F.lit("")), 1, 200).alias("product_name"),
        "price_brl", F.col("price_low").alias("price_original"),
        F.coalesce("price_currency", F.lit("")).alias("price_currency"), "monthly_sales",
        F.coalesce("image_url", F.lit("")).alias("image_url"),
        F.coalesce("product_url", F.lit("")).alias("product_url"), at.alias("scraped_at"),
    )


def _cents(c: Column) -> Column:
    """Two decimals; zero counts as missing."""
    return F.when(c != 0, round_half_up(c, 2))


def price_trends(snapshots: DataFrame, now: Column, days: int, query: str | None = None) -> DataFrame:
    """Average, lowest and highest price and row count per day and platform over the last ``days`` days."""
    s = snapshots.where(F.col("scraped_at") >= now - F.expr(f"interval {int(days)} days"))
    if query is not None:
        s = s.where(F.col("query") == query)
    return s.groupBy(F.date_format("scraped_at", "yyyy-MM-dd").alias("date"), "platform").agg(
        _cents(F.avg("price_brl")).alias("avg_price"), _cents(F.min("price_brl")).alias("min_price"),
        _cents(F.max("price_brl")).alias("max_price"), F.count(F.lit(1)).alias("product_count"),
    )


def recent_queries(snapshots: DataFrame, n: int = 20) -> DataFrame:
    return snapshots.groupBy("query").agg(
        F.countDistinct("platform").alias("platforms"), F.count(F.lit(1)).alias("total_snapshots"),
        F.max("scraped_at").alias("last_searched"),
    ).orderBy(F.desc("last_searched"), F.asc("query")).limit(n)


def price_series(history: DataFrame, keys: list[str], order: list[Column], n: int = 90) -> DataFrame:
    """The newest ``n`` points of every product's series."""
    return newest(history, keys, order, n)


def price_span(history: DataFrame, key: str, order: Column) -> DataFrame:
    """First and last price of every product and the number of points; max_by/min_by combine map-side."""
    return history.groupBy(key).agg(
        F.min_by("price", order).alias("first_price"), F.max_by("price", order).alias("last_price"),
        F.count(F.lit(1)).alias("points"),
    )


def price_drops(matches: DataFrame, products: DataFrame, history: DataFrame, n: int | None = 5,
                ties: tuple[str, ...] = ()) -> DataFrame:
    """Change of the price gap of a match: the latest point against the mean of the three before it.

    Both sides need two points or more; ``ties`` order points of the same instant. Only the four newest points per product are shuffled.
    """
    order = [F.desc(c) for c in ("recorded_at", *ties, "price")]
    four = newest(history.select("product_id", "price", "recorded_at", *ties), ["product_id"], order, 4)
    recent = four.groupBy("product_id").agg(
        F.max(F.when(F.col("rn") == 1, F.col("price"))).alias("latest"),
        F.avg(F.when(F.col("rn") > 1, F.col("price"))).alias("before"), F.count(F.lit(1)).alias("points"),
    ).where(F.col("points") >= 2).drop("points")
    p = products.select("id", "platform", "title", "category_l1").join(recent, F.col("product_id") == F.col("id")).drop("product_id")
    a = p.select(*[F.col(c).alias(f"a_{c}") for c in p.columns])
    b = p.select(*[F.col(c).alias(f"b_{c}") for c in p.columns])
    joined = matches.join(a, F.col("product_a_id") == F.col("a_id")).join(b, F.col("product_b_id") == F.col("b_id"))
    joined = joined.where((F.col("a_platform") == "amazon_br") & F.col("b_platform").isin("ml", "amazon_us"))
    gap, before = F.col("a_latest") - F.col("b_latest"), F.col("a_before") - F.col("b_before")
    result = joined.select(
        "match_id", F.substring("a_title", 1, 60).alias("amazon_title"), F.substring("b_title", 1, 60).alias("other_title"),
        F.col("b_platform").alias("other_platform"), round_half_up(gap, 4).alias("latest_diff"),
        round_half_up(before, 2).alias("prev_avg_diff"), round_half_up(gap - before, 2).alias("diff_change"),
        F.when(before != 0, round_half_up((gap - before) / before * 100, 2)).otherwise(F.lit(0.0)).alias("pct_change"),
        F.col("a_category_l1").alias("category"), "confidence",
    )
    if n is None:
        return result
    return result.orderBy(F.asc("diff_change"), F.asc("match_id")).limit(n)
