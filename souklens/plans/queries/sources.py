"""Scans, sinks and upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from souklens.functions.vectors import embedding_to_blob, embedding_to_text
from souklens.operators import upsert as u
from souklens.plans.registry import query
from souklens.session import scratch_path
from souklens.sources import files, listings


def unified(c):
    """Products as unified scrape records."""
    return c.view("products").selectExpr(
        "platform as source_platform", "platform_id as source_product_id", "concat('https://shop.example/', platform_id) as source_url",
        "title as product_name", "price as price_low", "currency as price_currency", "sales_30d as monthly_sales",
        "category_l1 as category", "to_json(struct(category_l2, category_l3)) as raw_data")


UNIFIED = """select platform as source_platform, platform_id as source_product_id, concat('https://shop.example/', platform_id) as source_url,
    title as product_name, price as price_low, currency as price_currency, sales_30d as monthly_sales, category_l1 as category,
    concat('{"category_l2":"', category_l2, '","category_l3":"', category_l3, '"}') as raw_data from products"""
COLS = ["source_platform", "source_product_id", "source_url", "product_name", "price_low", "price_currency", "monthly_sales", "category", "raw_data"]


@query("s01_json_products", UNIFIED)
def _(c):
    path = scratch_path(c.spark, "products-json")
    files.write_products(unified(c), path)
    return files.read_products(c.spark, path).select(*COLS)


@query("s01_json_lines_products", UNIFIED)
def _(c):
    path = scratch_path(c.spark, "products-lines")
    files.write_products(unified(c), path, lines=True)
    return files.read_products(c.spark, path, lines=True).select(*COLS)


@query("s02_sql_with_parameters", "select p_partkey, p_name, p_size from part where p_size >= 10 and p_name like 'red %'")
def _(c):
    return files.sql(c.spark, "select p_partkey, p_name, p_size from {part} where p_size >= :low and p_name like :name",
                     {"low": 10, "name": "red %"}, part=c.table("part"))


@query("s03_latest_run", """select l_orderkey, l_linenumber, year(l_shipdate)::int as run_id, l_returnflag as run_kind from lineitem
    where l_returnflag = 'R' and year(l_shipdate) = (select max(year(l_shipdate)) from lineitem where l_returnflag = 'R')""")
def _(c):
    runs = c.table("lineitem").select("l_orderkey", "l_linenumber", F.year("l_shipdate").alias("run_id"), F.col("l_returnflag").alias("run_kind"))
    return listings.latest_run(runs, "R")


RAW = """case when p_partkey % 2 = 0 then concat('{"title_cn":"商品', p_partkey, '","trade_score":', p_size, ',"seller_identities":["a","b"],"top_category_id":', p_partkey % 9, '}') end"""


@query("s04_normalize_listing", """select 'rakumart' as platform, case when p_partkey % 3 = 0 then concat('x-', p_partkey) else substr(repeat(concat(p_name, ' '), 60), 1, 50) end as platform_id,
    substr(repeat(concat(p_name, ' '), 60), 1, 500) as title, p_retailprice as price, case when p_partkey % 3 = 0 then concat('https://s.example/a/x-', p_partkey, '?ref=1') else '' end as url,
    case when p_partkey % 2 = 0 then 'http://img' else '' end as image, p_size::int as moq, case when p_partkey % 2 = 0 then concat('商品', p_partkey) else p_brand end as title_cn,
    case when p_partkey % 2 = 0 then cast(p_size as double) end as trade_score, case when p_partkey % 2 = 0 then 'a,b' else '' end as identities,
    case when p_partkey % 2 = 0 then cast(p_partkey % 9 as varchar) end as top_category_id from part""")
def _(c):
    records = c.table("part").selectExpr(
        "'rakumart' as platform", "case when p_partkey % 3 = 0 then concat('https://s.example/a/x-', p_partkey, '?ref=1') end as product_url",
        "repeat(concat(p_name, ' '), 60) as product_name", "p_retailprice as price_brl",
        "case when p_partkey % 2 = 0 then 'http://img' else '' end as image_url", "p_brand as seller_name", "p_size as moq", "1L as monthly_sales",
        "2 as review_count", "4.5D as rating", f"{RAW} as raw_data", "p_brand as title_cn", "p_name")
    d = listings.normalize_listing(records, "audio")
    return d.select("platform", "platform_id", "title", "price", "url",
                    F.array_join("image_urls", ",").alias("image"), "moq", "title_cn", "trade_score",
                    F.array_join("seller_identities", ",").alias("identities"), "top_category_id")


# Target: parts not divisible by three; updates: even parts, twice each, the copy with n = 2 being the later one.
TARGET = """target as (select p_partkey as k, p_name as title, p_retailprice as price, case when p_partkey % 4 = 1 then null else p_size end::bigint as sales, p_brand as brand from part where p_partkey % 3 <> 0)"""
UPDATES = """updates as (select p_partkey as k, concat(p_name, ' v2') as title, case when p_partkey % 8 = 0 then null else p_retailprice * 2 end as price, (p_size + 2 * 10 - 25)::bigint as sales from part where p_partkey % 2 = 0)"""


def target(c):
    return c.table("part").where("p_partkey % 3 <> 0").selectExpr(
        "p_partkey as k", "p_name as title", "p_retailprice as price", "cast(case when p_partkey % 4 = 1 then null else p_size end as bigint) as sales", "p_brand as brand")


def updates(c):
    twice = c.table("part").where("p_partkey % 2 = 0").withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    return twice.selectExpr(
        "p_partkey as k", "concat(p_name, ' v', n) as title", "case when p_partkey % 8 = 0 then null else p_retailprice * n end as price",
        "cast(p_size + n * 10 - 25 as bigint) as sales", "n")


def upserted(c, policy):
    rows = updates(c)
    return u.upsert(target(c), rows, ["k"], policy, order=F.col("n"))


MERGE = f"with {TARGET}, {UPDATES} select coalesce(u.k, t.k) as k, COLUMNS, brand from target t full join updates u on u.k = t.k"


@query("s05_upsert_overwrite", MERGE.replace("COLUMNS", """case when u.k is not null then u.title else t.title end as title,
    case when u.k is not null then u.price else t.price end as price, case when u.k is not null then u.sales else t.sales end as sales"""))
def _(c):
    return upserted(c, {})


@query("s06_upsert_coalesce", MERGE.replace("COLUMNS", """coalesce(u.title, t.title) as title, coalesce(u.price, t.price) as price,
    case when u.k is not null and t.k is not null then greatest(coalesce(u.sales, 0), coalesce(t.sales, 0)) else coalesce(u.sales, t.sales) end as sales"""))
def _(c):
    return upserted(c, {"title": "coalesce", "price": "coalesce", "sales": "greatest0"})


@query("s07_upsert_mapping", """with m as (select l_partkey % 50 as l1, l_returnflag as platform, max(cast(l_suppkey as varchar)) as url, max(l_discount) as confidence from lineitem where l_linenumber % 2 = 0 group by 1, 2),
    n as (select l_partkey % 60 as l1, l_returnflag as platform, max(case when l_linenumber > 6 then cast(l_suppkey as varchar) end) as url, min(l_discount) as confidence from lineitem where l_linenumber % 2 = 1 group by 1, 2)
select coalesce(n.l1, m.l1) as our_l1, coalesce(n.platform, m.platform) as platform, coalesce(n.url, m.url) as bestsellers_url, greatest(n.confidence, m.confidence) as confidence,
    case when n.l1 is null then 1 else 2 end as updated_at from m full join n on n.l1 = m.l1 and n.platform = m.platform""")
def _(c):
    l = c.table("lineitem")
    url = F.col("l_suppkey").cast("string")
    m = l.where("l_linenumber % 2 = 0").groupBy((F.col("l_partkey") % 50).alias("our_l1"), F.col("l_returnflag").alias("platform")).agg(
        F.max(url).alias("bestsellers_url"), F.max("l_discount").alias("confidence"), F.lit(1).alias("updated_at"))
    n = l.where("l_linenumber % 2 = 1").groupBy((F.col("l_partkey") % 60).alias("our_l1"), F.col("l_returnflag").alias("platform")).agg(
        F.max(F.when(F.col("l_linenumber") > 6, url)).alias("bestsellers_url"), F.min("l_discount").alias("confidence"), F.lit(2).alias("updated_at"))
    return u.upsert(m, n, ["our_l1", "platform"], {"bestsellers_url": "coalesce", "confidence": "greatest"})


@query("s08_append_snapshots", """with n as (select l_partkey as offer_id, l_shipdate as scraped_at, min(l_extendedprice) as price from lineitem where l_linenumber >= 3 group by 1, 2)
select offer_id, strftime(scraped_at, '%Y-%m-%d') as scraped_at, price from n where not exists (select 1 from lineitem o where o.l_linenumber < 3 and o.l_partkey = n.offer_id and o.l_shipdate = n.scraped_at)""")
def _(c):
    l = c.table("lineitem").selectExpr("l_partkey as offer_id", "l_shipdate as scraped_at", "l_extendedprice as price", "l_linenumber")
    new = u.append_new(l.where("l_linenumber < 3"), l.where("l_linenumber >= 3").drop("l_linenumber"), ["offer_id", "scraped_at"], F.col("price"))
    return new.withColumn("scraped_at", F.date_format("scraped_at", "yyyy-MM-dd"))


@query("s09_update_max_sales", """with up as (select l_partkey as k, l_returnflag as m, max(cast(l_quantity as bigint) - 10) as s from lineitem where l_quantity > 10 group by 1, 2)
select case when p_partkey % 2 = 0 then concat(mk, ':', p_partkey) else cast(p_partkey as varchar) end as source_id, mk as marketplace,
    case when s is not null then greatest(coalesce(old, 0), s) else old end as sales_30d
from (select *, ['A', 'N', 'R'][p_partkey % 3 + 1] as mk, case when p_partkey % 5 = 0 then null else p_size end::bigint as old from part) left join up on k = p_partkey and m = mk""")
def _(c):
    t = c.table("part").selectExpr("p_partkey as pk", "element_at(array('A', 'N', 'R'), cast(p_partkey % 3 + 1 as int)) as marketplace",
                                   "cast(case when p_partkey % 5 = 0 then null else p_size end as bigint) as sales_30d")
    t = t.selectExpr("case when pk % 2 = 0 then concat(marketplace, ':', pk) else cast(pk as string) end as source_id", "marketplace", "sales_30d")
    up = c.table("lineitem").selectExpr("l_returnflag as marketplace", "case when l_linenumber % 2 = 0 then concat(l_returnflag, ':', l_partkey) else cast(l_partkey as string) end as key",
                                        "cast(l_quantity as bigint) - 10 as sales")
    return u.update_max_sales(t, up)


@query("s10_to_bronze", """select 'catalogue' as source, concat(platform, ':', platform_id) as source_id,
    case platform when 'amazon_us' then 'amazon_usa' when 'ml' then 'mercadolivre' else platform end as marketplace, title,
    concat('http://i/', id) as image_url, 2::int as image_count, price, case when platform <> 'amazon_us' then price end as price_brl,
    concat(category_l1, ' > ', category_l2, ' > ', category_l3) as category_raw, 3::int as category_level, sales_30d, 0::int as review_count,
    cast(id as varchar) as raw_id, case when embedding is null then 0 else 64 end::int as raw_dim from products where is_active""")
def _(c):
    p = c.view("products").withColumn("image_urls", F.array(F.concat(F.lit("http://i/"), "id"), F.lit("http://i/b")))
    b = listings.to_bronze(p, "catalogue")
    dim = F.coalesce(F.size(F.from_json(F.get_json_object("raw_data", "$.image_embedding"), "array<float>")), F.lit(0))
    return b.select("source", "source_id", "marketplace", "title", "image_url", "image_count", "price", "price_brl", "category_raw", "category_level",
                    "sales_30d", "review_count", F.get_json_object("raw_data", "$.source_row_id").alias("raw_id"), F.greatest(dim, F.lit(0)).alias("raw_dim"))


@query("s13_export_csv", """select cast(event_id as varchar) as event_id, event_type, concat('say "', props, '", ok') as note,
    case when event_id % 3 = 0 then '' else cast(user_id as varchar) end as user_id from events""")
def _(c):
    path = scratch_path(c.spark, "export")
    rows = c.table("events").selectExpr("event_id", "event_type", "concat('say \"', props, '\", ok') as note", "case when event_id % 3 = 0 then null else user_id end as user_id")
    columns = ["event_id", "event_type", "note", "user_id"]
    files.export_csv(rows, columns, path)
    return files.read_export(c.spark, path, columns).fillna("")


@query("s14_import_mappings", """select case when p_size % 2 = 0 then 'Audio' else 'Tech' end as our_l1, case when p_size % 2 = 0 then 'Headphones' else 'Wearables' end as our_l2,
    'Geral' as our_l3, 'amazon_br' as platform, cast(p_partkey as varchar) as platform_category_id, case when p_partkey % 3 = 0 then 'en' else p_name end as platform_category_name,
    concat('http://b/', p_partkey) as bestsellers_url, 0.8::double as confidence from part
    union all select 'Tech', 'Wearables', 'Geral', 'amazon_us', '', p_brand, '', 0.8 from part""")
def _(c):
    docs = c.table("part").selectExpr("""concat('{"amazon_br":{"', case when p_size % 2 = 0 then 'headphones' else 'smartwatch' end, '":{"id":"', p_partkey, '","name_pt":"',
        case when p_partkey % 3 = 0 then '' else p_name end, '","name_en":"en","bestsellers_url":"http://b/', p_partkey, '"},"other":{"id":"1"}},"amazon_us":{"smartwatch":{"name_en":"', p_brand, '"}},"ml":{"headphones":{}}}') as json""")
    known = {"headphones": ("Audio", "Headphones", "Geral"), "smartwatch": ("Tech", "Wearables", "Geral")}
    return listings.import_mappings(docs, known)


@query("s15_populate_hierarchy", """select id, case when keep then category_l1 when hit then concat('N', category_l1) else category_l1 end as category_l1,
    case when keep or not hit then category_l2 else 'two' end as category_l2, case when keep or not hit then category_l3 else concat('t', category_l1) end as category_l3,
    case when keep then 'skipped' when hit then 'updated' else 'missing' end as status
from (select id, category_l1, case when id % 3 = 0 then '' else category_l2 end as category_l2, category_l3, id % 3 <> 0 as keep, category_l1 <> 'uncategorized' as hit from products)""")
def _(c):
    p = c.view("products").selectExpr("id", "category_l1", "case when id % 3 = 0 then '' else category_l2 end as category_l2", "category_l3")
    h = c.table("embeddings").selectExpr("concat('L', label) as category").distinct().selectExpr(
        "category", "concat('N', category) as l1", "'two' as l2", "concat('t', category) as l3")
    return listings.populate_hierarchy(p, h)


@query("s16_decode_embedding", """select vec_id, len(embedding)::int as dim, round(list_sum(embedding::double[]), 5) as total, embedding[1]::double as first, embedding[64]::double as last from embeddings""")
def _(c):
    stored = c.table("embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 2 == 0, embedding_to_text("embedding")).alias("t"),
        F.when(F.col("vec_id") % 2 == 1, embedding_to_blob("embedding")).alias("b"))
    d = files.decode_embedding(stored, "t", "b")
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return d.select("vec_id", F.size("embedding").alias("dim"), F.round(total, 5).alias("total"),
                    F.get("embedding", F.lit(0)).cast("double").alias("first"), F.get("embedding", F.lit(63)).cast("double").alias("last"))
