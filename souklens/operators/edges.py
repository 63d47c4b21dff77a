"""Match edges: building them, keeping them one-to-one, walking them in both directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from souklens.functions.numbers import round_half_up
from souklens.operators.similarity import join_tiles, packed_tiles, similarity_join, tier_keys
from souklens.session import dealt


def both_ways(edges: DataFrame, a: str = "product_a_id", b: str = "product_b_id", keep=("match_id", "confidence")) -> DataFrame:
    """Each undirected edge once per endpoint, so an OR condition becomes an equi join."""
    cols = [c for c in keep if c in edges.columns]
    forth = edges.select(F.col(a).alias("from_id"), F.col(b).alias("to_id"), *cols)
    back = edges.select(F.col(b).alias("from_id"), F.col(a).alias("to_id"), *cols)
    return forth.unionByName(back)


def endpoints(edges: DataFrame, a: str = "product_a_id", b: str = "product_b_id") -> DataFrame:
    """Distinct products that take part in any edge."""
    return edges.select(F.col(a).alias("id")).union(edges.select(F.col(b))).distinct()


def match_blocked(left: DataFrame, right: DataFrame, *, block: list[str], threshold: float = 0.70) -> DataFrame:
    """Best right row per left row inside a block, then one-to-one."""
    def keyed(df):
        return df.withColumn("_block", F.to_json(F.struct(*block)))

    best = similarity_join(keyed(left), keyed(right), block="_block", threshold=threshold, k=1)
    return one_to_one(best.drop("rank"))


def one_to_one(best: DataFrame) -> DataFrame:
    """Greedy best-first assignment. Every left row brings one candidate, so keeping the most
    similar left row per right row is the same thing; max_by does it with partial aggregation."""
    rest = [c for c in best.columns if c not in ("left_id", "right_id")]
    order = F.struct("similarity", (-F.col("left_id")).alias("tie"))
    kept = best.groupBy("right_id").agg(F.max_by(F.struct("left_id", *rest), order).alias("w"))
    return kept.select("w.left_id", "right_id", *[f"w.{c}" for c in rest])


TIERS = ("strict", "medium", "broad")


def match_candidates(left: DataFrame, right: DataFrame, threshold: float = 0.70) -> DataFrame:
    """Best candidate per left row and tier: same L1+L2+L3 (L3 not 'Geral'), same L1+L2, same L1."""
    filled = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    strict = F.when(filled("category_l2") & filled("category_l3") & (F.col("category_l3") != "Geral"), F.to_json(F.struct("category_l2", "category_l3")))
    keys = tier_keys(strict, F.when(filled("category_l2"), F.col("category_l2")), F.lit(""))
    sides = [df.withColumn("_keys", keys) for df in (left, right)]
    best = similarity_join(*sides, block="category_l1", threshold=threshold, tiers=("_keys", len(TIERS)))
    names = F.array(*[F.lit(t) for t in TIERS])
    return best.select("left_id", "right_id", "similarity", F.get(names, F.col("tier_rank")).alias("tier"), "tier_rank")


def best_by_tier(candidates: DataFrame) -> DataFrame:
    """One candidate per left row: lowest tier first, then highest similarity, then smaller right id."""
    order = F.struct("tier_rank", -F.col("similarity"), "right_id")
    kept = candidates.groupBy("left_id").agg(F.min_by(F.struct("right_id", "similarity", "tier"), order).alias("w"))
    return kept.select("left_id", "w.right_id", "w.similarity", "w.tier")


def match_tiered(left: DataFrame, right: DataFrame, threshold: float = 0.70, penalty: float = 0.03) -> DataFrame:
    """Three-tier matching, then one-to-one by raw similarity; medium matches lose ``penalty`` confidence."""
    final = one_to_one(best_by_tier(match_candidates(left, right, threshold)))
    lowered = F.greatest(F.lit(0.0), F.round(F.col("similarity") - penalty, 6))
    return final.withColumn("confidence", F.when(F.col("tier") == "medium", lowered).otherwise(F.col("similarity")))


def needs_refresh(products: DataFrame, edges: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Active products with a vector and no outgoing edge younger than ``days`` days."""
    fresh = edges.where(F.col("created_at") > now - F.expr(f"interval {int(days)} days"))
    ready = products.where(F.col("is_active") & F.col("embedding").isNotNull())
    return ready.join(fresh.select(F.col("product_a_id").alias("id")), "id", "left_anti")


def refreshed_edges(products: DataFrame, edges: DataFrame, now: Column, *, threshold: float = 0.7, k: int = 5,
                    days: int = 7, kept: DataFrame | None = None) -> DataFrame:
    """New edges of the products due: their k nearest neighbours above the threshold (exclusive).

    ``kept`` is a stored table of tiles (``packed_tiles``) of all active products with a vector. With it only the products due are packed,
    else all are packed anew.
    """
    ready = products.where(F.col("is_active") & F.col("embedding").isNotNull())
    due = needs_refresh(products, edges, now, days)
    near = (similarity_join(due, ready, k=k) if kept is None else join_tiles(packed_tiles(due), kept, k)).where(F.col("similarity") > threshold)
    return near.select(
        F.col("left_id").alias("product_a_id"), F.col("right_id").alias("product_b_id"),
        F.col("similarity").alias("confidence"), F.lit("clip_v1").alias("match_method"), now.alias("created_at"),
    )


def refresh_matches(products: DataFrame, edges: DataFrame, now: Column, **options) -> DataFrame:
    """Edge table after the refresh: new edges replace confidence and time of those they meet."""
    from souklens.operators.upsert import upsert

    new = refreshed_edges(products, edges, now, **options)
    return upsert(edges, new, ["product_a_id", "product_b_id"], {"match_method": "old"})


def _sided(products: DataFrame, prefix: str, cols: list[str]) -> DataFrame:
    return products.select(*[F.col(c).alias(f"{prefix}_{c}") for c in cols])


def joined_matches(edges: DataFrame, products: DataFrame, cols: list[str]) -> DataFrame:
    """Edges with the wanted columns of both products, prefixed a_ and b_."""
    a, b = _sided(products, "a", ["id", *cols]), _sided(products, "b", ["id", *cols])
    return edges.join(a, F.col("product_a_id") == F.col("a_id")).join(b, F.col("product_b_id") == F.col("b_id"))


def margin_percent(digits: int = 2) -> Column:
    """(a - b) / b * 100, and 0 where b is not positive."""
    a, b = F.coalesce("a_price", F.lit(0.0)), F.coalesce("b_price", F.lit(0.0))
    return F.when(b > 0, round_half_up(F.try_divide(a - b, b) * 100, digits)).otherwise(F.lit(0.0))


def price_diff() -> Column:
    return round_half_up(F.coalesce("a_price", F.lit(0.0)) - F.coalesce("b_price", F.lit(0.0)), 4)


def list_matches(edges: DataFrame, products: DataFrame, *, sort_by: str = "confidence", min_confidence: float = 0.0,
                 category_l1: str | None = None, min_sales: int = 0, include_br_us: bool = False, n: int = 50) -> DataFrame:
    """Matches with both products, filtered, by confidence or by price gap."""
    cols = ["platform", "platform_id", "title", "price", "sales_30d", "category_l1"]
    others = ["ml", "amazon_us"] if include_br_us else ["ml"]
    m = joined_matches(edges.where(F.col("confidence") >= min_confidence), products, cols)
    m = m.where((F.col("a_platform") == "amazon_br") & F.col("b_platform").isin(*others))
    if category_l1 is not None:
        m = m.where(F.col("a_category_l1") == category_l1)
    if min_sales > 0:
        m = m.where((F.coalesce("a_sales_30d", F.lit(0)) >= min_sales) | (F.coalesce("b_sales_30d", F.lit(0)) >= min_sales))
    m = m.withColumns({
        "price_diff": price_diff(), "margin_percent": margin_percent(),
        "b_currency": F.when(F.col("b_platform") == "ml", "BRL").otherwise("USD"),
    })
    order = {"confidence": F.desc("confidence"), "margin": F.desc("price_diff"), "-margin": F.asc("price_diff")}[sort_by]
    return m.orderBy(order, F.asc("match_id")).limit(n)


def neighbours(edges: DataFrame, products: DataFrame, n: int | None = None) -> DataFrame:
    """Active neighbours of every product over undirected edges, by confidence."""
    active = products.where("is_active").select(
        F.col("id").alias("to_id"), "platform", "platform_id", "title", "price", "currency", "sales_30d")
    joined = dealt(both_ways(edges), "to_id").join(active, "to_id")
    if n is None:
        return joined
    best = W.partitionBy("from_id").orderBy(F.desc("confidence"), F.asc("to_id"))
    return joined.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def match_history(edges: DataFrame, history: DataFrame, products: DataFrame) -> DataFrame:
    """Price history of both sides of every match."""
    sides = both_ways(edges).select("match_id", F.col("from_id").alias("product_id"))
    p = products.select(F.col("id").alias("product_id"), "platform")
    return history.join(sides, "product_id").join(p, "product_id").select(
        "match_id", "product_id", "platform", "price", "sales_30d", "recorded_at")


def gap_alerts(edges: DataFrame, products: DataFrame, *, min_confidence: float | None = None, n: int = 10) -> DataFrame:
    """Matches with the widest price gap; with ``min_confidence`` the most certain ones first."""
    e = edges if min_confidence is None else edges.where(F.col("confidence") >= min_confidence)
    m = joined_matches(e, products, ["title", "price", "platform_id", "sales_30d", "category_l1"])
    m = m.where(F.col("a_price").isNotNull() & F.col("b_price").isNotNull()).select(
        "match_id", "confidence", F.col("a_platform_id").alias("a_pid"), F.col("b_platform_id").alias("b_pid"),
        "a_title", "b_title", F.col("a_category_l1").alias("category_l1"), price_diff().alias("price_diff"),
        margin_percent(1).alias("margin_pct"),
    )
    order = [F.desc("price_diff"), F.asc("match_id")]
    return m.orderBy(*([F.desc("confidence")] if min_confidence is not None else []), *order).limit(n)


def top_edges(edges: DataFrame, products: DataFrame, *, threshold: float = 0.7, n: int = 20) -> DataFrame:
    m = joined_matches(edges.where(F.col("confidence") > threshold), products, ["title", "platform"])
    return m.select("match_id", "a_title", "a_platform", "b_title", "b_platform", "confidence").orderBy(
        F.desc("confidence"), F.asc("match_id")).limit(n)


def edge_hubs(edges: DataFrame, products: DataFrame, *, threshold: float = 0.7, n: int = 20) -> DataFrame:
    """Products on any edge above the threshold, with the number of all their edges, most connected first."""
    strong = endpoints(edges.where(F.col("confidence") > threshold))
    degree = both_ways(edges).groupBy(F.col("from_id").alias("id")).agg(F.countDistinct("match_id").alias("match_count"))
    hubs = products.select("id", "platform", "title", "price").join(strong, "id", "left_semi").join(degree, "id")
    return hubs.orderBy(F.desc("match_count"), F.asc("id")).limit(n)
