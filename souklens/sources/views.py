"""Catalogue views over the star-schema test tables.

The text is shared with the SQL the results are checked against: only the string type and the
table references are filled in per engine, so both sides start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    "products": """
        select p_partkey as id,
               case p_partkey % 4 when 0 then 'amazon_br' when 1 then 'ml'
                                  when 2 then 'amazon_us' else 'rakumart-1688' end as platform,
               concat('P', p_partkey) as platform_id,
               concat(p_name, ' ', p_type, ' ', p_brand) as title,
               p_retailprice as price,
               case when p_partkey % 4 = 2 then 'USD' else 'BRL' end as currency,
               case when e.label is null then 'uncategorized' else concat('L', e.label) end as category_l1,
               p_type as category_l2,
               case when p_size % 5 = 0 then 'Geral' else concat('S', p_size % 5) end as category_l3,
               coalesce(s.q, 0) as sales_30d,
               e.embedding as embedding,
               p_partkey % 10 <> 9 as is_active
        from {part} as part
        left join {embeddings} as e on e.vec_id = p_partkey
        left join (select l_partkey, cast(sum(l_quantity) as bigint) as q
                   from {lineitem} as l group by l_partkey) as s on s.l_partkey = p_partkey
    """,
    # One row per offer and ship day; the day's quantity plays the scraped sales estimate, so
    # that offers rise as well as fall between two snapshots.
    "product_snapshots": """
        select l_partkey as offer_id, l_shipdate as scraped_at,
               cast(sum(l_quantity) as bigint) as sales_volume_estimate,
               min(l_extendedprice / l_quantity) as price_min
        from {lineitem} as l group by l_partkey, l_shipdate
    """,
    "price_history": """
        select l_partkey as product_id, l_extendedprice / l_quantity as price,
               cast(l_quantity as bigint) as sales_30d, l_shipdate as recorded_at,
               l_orderkey, l_linenumber
        from {lineitem} as l
    """,
    "listing_products": """
        select concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) as row_id, l_partkey as offer_id,
               p_name as title, l_extendedprice / l_quantity as price_min,
               cast(l_quantity * 100 as bigint) as sales_volume_estimate,
               s_name as supplier_name, p_type as category_label,
               cast(round(l_discount * 1000) as int) as repurchase_rate, l_returnflag as run_kind
        from {lineitem} as l
        join {part} as part on p_partkey = l_partkey
        join {supplier} as supplier on s_suppkey = l_suppkey
    """,
    # The rank of a supplier is data in the source table, so it is read, not computed.
    "ranked_suppliers": """
        select s_suppkey as supplier_key, s_name as supplier_name, n_name as region,
               r_name as category_label, s_suppkey + 1 as rank_position
        from {supplier} as supplier
        join {nation} as nation on n_nationkey = s_nationkey
        join {region} as region on r_regionkey = n_regionkey
    """,
    "market_pages": """
        select p_partkey as page_id,
               concat('<div data-asin="', lpad(cast(p_partkey as {string}), 10, '0'),
                      '"><a title="', p_name, '"></a><span>R$ ',
                      cast(floor(p_retailprice) as bigint), ',',
                      lpad(cast(cast(round((p_retailprice - floor(p_retailprice)) * 100) as bigint)
                           as {string}), 2, '0'),
                      '</span><i>', p_size, '+ bought in past month</i> ',
                      p_partkey % 50, ' ratings</div>') as html
        from {part} as part
    """,
}


class _Names(dict):
    def __missing__(self, key: str) -> str:
        return "varchar" if key == "string" else key


def view_sql(name: str) -> str:
    """The view as text for another engine, table names in place."""
    return VIEWS[name].format_map(_Names())


class Catalogue:
    """Test tables and the views over them, all lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def view(self, name: str) -> DataFrame:
        text = VIEWS[name].replace("{string}", "string")
        used = set(re.findall(r"\{(\w+)\}", text))
        return self.spark.sql(text, **{t: self.table(t) for t in used})
