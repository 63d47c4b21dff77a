"""Named queries over the test tables, each with the SQL its result must equal."""

from __future__ import annotations

import importlib
import pkgutil
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from souklens.operators.similarity import similarity_join
from souklens.sources.views import VIEWS, Catalogue, view_sql

# Highest cosine between platforms inside one category of the test tables is about 0.4, so a
# threshold fit for real embeddings (0.70) would leave nothing to check.
TEST_THRESHOLD = 0.20

ORACLE_VIEWS = {name: view_sql(name) for name in VIEWS}
ORACLE_VIEWS["matches"] = f"""
    select concat(a.id, '-', b.id) as match_id, a.id as product_a_id, b.id as product_b_id,
           round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as confidence,
           'embedding' as match_method
    from products a join products b on a.category_l1 = b.category_l1
    where a.platform = 'amazon_br' and b.platform in ('ml', 'amazon_us') and a.is_active and b.is_active
      and a.embedding is not null and b.embedding is not null
      and round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) >= {TEST_THRESHOLD}
"""
NEEDS = {"matches": ["products"]}


def matches(c: Catalogue) -> DataFrame:
    """Edges of the test catalogue: every Brazilian listing with its look-alikes on two other platforms."""
    p = c.view("products").where(F.col("is_active") & F.col("embedding").isNotNull())
    pairs = similarity_join(
        p.where(F.col("platform") == "amazon_br"), p.where(F.col("platform").isin("ml", "amazon_us")),
        block="category_l1", threshold=TEST_THRESHOLD,
    )
    return pairs.select(
        F.concat_ws("-", "left_id", "right_id").alias("match_id"), F.col("left_id").alias("product_a_id"),
        F.col("right_id").alias("product_b_id"), F.col("similarity").alias("confidence"),
        F.lit("embedding").alias("match_method"),
    )


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Catalogue], DataFrame]
    oracle: str | None


_QUERIES: dict[str, Query] = {}


def with_views(sql: str) -> str:
    """Put the catalogue views a query mentions in front of it as common table expressions."""
    body = sql.strip()
    used = [v for v in ORACLE_VIEWS if re.search(rf"\b{v}\b", body)]
    used += [n for v in used for n in NEEDS.get(v, []) if n not in used]
    views = [f"{v} as ({ORACLE_VIEWS[v].strip()})" for v in ORACLE_VIEWS if v in used]
    if not views:
        return body
    head = "with recursive " if body.lower().startswith("with recursive ") else "with "
    if body.lower().startswith(head):
        return f"{head}{', '.join(views)}, {body[len(head):]}"
    return f"with {', '.join(views)} {body}"


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[[Catalogue], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"duplicate query name: {name}")
        _QUERIES[name] = Query(name, fn, with_views(oracle) if oracle else None)
        return fn

    return register


def sql_round(expr: str, digits: int) -> str:
    """Decimal half-up rounding as SQL text; the twin of ``numbers.round_half_up``."""
    return f"cast(round(cast({expr} as decimal(30,10)), {digits}) as double)"


def all_queries() -> dict[str, Query]:
    from souklens.plans import queries as package

    for module in pkgutil.iter_modules(package.__path__):
        importlib.import_module(f"{package.__name__}.{module.name}")
    return dict(sorted(_QUERIES.items()))


def runner(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: q.run(Catalogue(spark, sf_dir))
