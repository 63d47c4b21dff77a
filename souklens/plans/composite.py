"""Nightly jobs composed from the operators. Each gives the tables to store and a one-row summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from souklens.operators.classify import taxonomy_counts
from souklens.operators.edges import match_tiered, refresh_matches
from souklens.operators.history import daily_snapshot, one_row
from souklens.operators.reports import detect_opportunities, validate_mappings
from souklens.sources.edge_store import EdgeStore

def row_count() -> Column:
    return F.count(F.lit(1))


def match_night(products: DataFrame, store: EdgeStore, run: int, *, threshold: float = 0.70, left: str = "amazon_br", right: str = "ml",
                only: Sequence[str] | None = None) -> DataFrame:
    """Match the two platforms and put the result in the place of the stored edges of every category that both have, or of ``only`` those
    named; gives the whole store. Categories that one platform lacks keep what they had."""
    ready = products.where(F.col("is_active") & F.col("embedding").isNotNull() & F.col("category_l1").isNotNull())
    if only is not None:
        ready = ready.where(F.col("category_l1").isin(list(only)))
    sides = [ready.where(F.col("platform") == p) for p in (left, right)]
    done = sides[0].select("category_l1").distinct().join(sides[1].select("category_l1").distinct(), "category_l1", "left_semi")
    found = match_tiered(*sides, threshold)
    of = sides[0].select(F.col("id").alias("left_id"), "category_l1")
    store.replace(found.join(of, "left_id").select(
        "category_l1", F.concat_ws("-", "left_id", "right_id").alias("match_id"), F.col("left_id").alias("product_a_id"), F.col("right_id").alias("product_b_id"),
        "confidence", F.col("tier").alias("match_method")), done, run)
    return store.read()


def nightly_catalogue(products: DataFrame, mappings: DataFrame, now: Column, *, threshold: float = 0.70,
                      left: str = "amazon_br", right: str = "ml", store: EdgeStore | None = None, run: int = 0) -> dict[str, DataFrame]:
    """Match the two platforms, validate the mappings against the matches, snapshot prices, and count it all. With a ``store`` the
    matches are written there and those of all categories are used."""
    ready = products.where(F.col("is_active") & F.col("embedding").isNotNull())
    edges = match_night(products, store, run, threshold=threshold, left=left, right=right).drop("category_l1") if store else match_tiered(ready.where(F.col("platform") == left), ready.where(F.col("platform") == right), threshold).select(
        F.concat_ws("-", "left_id", "right_id").alias("match_id"), F.col("left_id").alias("product_a_id"), F.col("right_id").alias("product_b_id"),
        "confidence", F.col("tier").alias("match_method"))
    validation = validate_mappings(mappings, products, edges)
    snapshot = daily_snapshot(products, now)
    summary = one_row(
        products.agg(F.count_if("is_active").alias("products"), F.count("embedding").alias("embedded")), edges.agg(row_count().alias("matches")),
        mappings.agg(row_count().alias("categories")), validation.agg(F.count_if(F.col("status").isin("OK", "GOOD")).alias("healthy_mappings")),
        snapshot.agg(row_count().alias("snapshots")))
    return {"matches": edges, "validation": validation, "snapshot": snapshot, "summary": summary}


def nightly_edges(products: DataFrame, edges: DataFrame, taxonomy: DataFrame, carried: DataFrame, now: Column, *, threshold: float = 0.7,
                  min_score: float = 50.0, n: int = 50) -> dict[str, DataFrame]:
    """Refresh stale edges, detect opportunities and recount the taxonomy."""
    refreshed = refresh_matches(products, edges, now, threshold=threshold)
    opportunities = detect_opportunities(products, min_score=min_score, n=n)
    counts = taxonomy_counts(taxonomy, carried)
    summary = one_row(
        refreshed.agg(row_count().alias("edges"), F.count_if(F.col("created_at") == now).alias("refreshed")),
        opportunities.agg(row_count().alias("opportunities")), counts.agg(row_count().alias("slugs"), F.sum("product_count").alias("placements")))
    return {"edges": refreshed, "opportunities": opportunities, "taxonomy": counts, "summary": summary}
