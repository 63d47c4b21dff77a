"""Velocity, relevance and ranking scores on Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from souklens.functions.numbers import col, round_half_up, whole_days


def sales_velocity(total: Column | str, published: Column | str, now: Column) -> Column:
    """Sales per full day since publication, one day at least; NULL where either input is."""
    return col(total).cast("double") / F.greatest(whole_days(now, published), F.lit(1))


def refresh_velocity(df: DataFrame, now: Column, *, total: str = "total_sales", published: str = "publish_date") -> DataFrame:
    return df.withColumn("sales_velocity", sales_velocity(total, published, now))


def text_score(query: Column | str, title: Column | str, title_cn: Column | None = None) -> Column:
    """100 for the whole phrase, 90 for every word, 60 + 30 * share for some, 0 for none."""
    q = F.lower(F.lit(query) if isinstance(query, str) else query)
    t = F.lower(F.coalesce(col(title), F.lit("")))
    cn = F.lower(F.coalesce(title_cn, F.lit(""))) if title_cn is not None else F.lit("")
    words = F.filter(F.split(q, r"\s+"), lambda w: w != "")
    hits = F.size(F.filter(words, lambda w: F.contains(t, w) | F.contains(cn, w)))
    share = hits / F.size(words)
    return (
        F.when(F.contains(t, q) | F.contains(cn, q), 100.0)
        .when(hits == F.size(words), 90.0).when(hits > 0, 60 + share * 30).otherwise(0.0)
    )


def price_score(price: Column | str, low: Column, high: Column) -> Column:
    """Cheaper is better: 100 at the lowest price, 0 at the highest; 50 without a price or a range."""
    p = col(price)
    share = F.when(high > low, 1 - F.try_divide(p - low, high - low)).otherwise(0.5)
    return F.when(p.isNull() | (p == 0), 50.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), share * 100)))


def sales_score(sales: Column | str) -> Column:
    s = col(sales)
    return F.when(s > 0, F.least(F.lit(100.0), F.log10(s + 1) * 25)).otherwise(0.0)


def composite_score(text: Column, visual: Column, price: Column, sales: Column) -> Column:
    return text * 0.30 + visual * 0.40 + price * 0.20 + sales * 0.10


def rank_results(results: DataFrame, query: str, *, title: str = "product_name", price: str = "price_brl",
                 sales: str = "monthly_sales", visual: str | None = None) -> DataFrame:
    """Score every result against the query; price bounds come from a one-row aggregate joined back by a constant key."""
    priced = results.where(F.col(price).isNotNull() & (F.col(price) != 0))
    bounds = priced.agg(
        F.coalesce(F.min(price), F.lit(0.0)).alias("_low"), F.coalesce(F.max(price), F.lit(1000.0)).alias("_high")
    ).withColumn("_one", F.lit(1))
    scored = results.withColumn("_one", F.lit(1)).join(F.broadcast(bounds), "_one")  # one row
    v = F.coalesce(F.col(visual), F.lit(0.0)) if visual else F.lit(0.0)
    scored = scored.withColumns({
        "text_score": round_half_up(text_score(query, title), 4), "visual_score": round_half_up(v, 4),
        "price_score": round_half_up(price_score(price, F.col("_low"), F.col("_high")), 4),
        "sales_score": round_half_up(sales_score(sales), 4),
    })
    total = composite_score(F.col("text_score"), F.col("visual_score"), F.col("price_score"), F.col("sales_score"))
    return scored.withColumn("composite_score", round_half_up(total, 4)).drop("_one", "_low", "_high")
