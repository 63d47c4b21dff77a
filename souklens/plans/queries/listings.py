"""Filtered lists, merges of catalogues and cross-market comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from souklens.functions.scores import rank_results
from souklens.operators import listing as l, merge as g
from souklens.plans.registry import matches, query, sql_round as R

FIELDS = "id, platform, title, price, sales_30d, category_l1, category_l2, category_l3"


def fields(df, *more):
    return df.select(*FIELDS.split(", "), *more)


@query("p19_enrichment_status", """select p_partkey, case when p_partkey % 2 = 0 and (p_size > 10 or p_partkey % 3 = 0) and p_partkey % 5 = 0 then 'complete'
    when p_partkey % 2 = 0 or p_size > 10 or p_partkey % 3 = 0 or p_partkey % 5 = 0 or p_partkey % 7 = 0 then 'partial' else 'none' end as status from part""")
def _(c):
    d = c.table("part").selectExpr(
        "p_partkey", "case when p_partkey % 2 = 0 then 'v' end as video_url", "case when p_size > 10 then 'm' else '' end as main_spec",
        "case when p_partkey % 3 = 0 then array('a') end as specifications", "case when p_partkey % 5 = 0 then array('a') else array() end as models",
        "case when p_partkey % 7 = 0 then array('a') end as variant_prices")
    return d.select("p_partkey", l.enrichment_status().alias("status"))


@query("p20_gate_columns", """select p_partkey, p_name, true as _premium_locked, 'trend_score,opportunity_score' as gated, null::double as trend_score, false as paid from part
    union all select p_partkey, p_name, false, '', p_retailprice, true from part""")
def _(c):
    d = c.table("part").selectExpr("p_partkey", "p_name", "p_retailprice as trend_score", "p_size as opportunity_score")
    free, paid = l.gate_columns(d, False), l.gate_columns(d, True)
    both = free.withColumn("paid", F.lit(False)).unionByName(paid.drop("opportunity_score").withColumn("paid", F.lit(True)), allowMissingColumns=True)
    return both.withColumn("gated", F.array_join("_gated_fields", ",")).drop("_gated_fields")


@query("p21_list_products", f"""select {FIELDS} from products where is_active and platform = 'amazon_br' and category_l2 = 'PROMO' and sales_30d > 0 and price between 920 and 1050
    order by sales_30d desc, id limit 25 offset 5""")
def _(c):
    return fields(l.list_products(c.view("products"), platform="amazon_br", category_l2="PROMO", has_sales=True, min_price=920, max_price=1050, limit=25, offset=5))


def merged(c, full=False):
    """Ranked, bestseller and factory catalogues out of the listings of three return flags."""
    rows = c.view("listing_products").selectExpr(
        "title", "supplier_name", "price_min as price", "cast(sales_volume_estimate as string) as sales", "category_label", "row_id as position", "run_kind", "offer_id",
        "case when repurchase_rate > 50 then concat(title, ' pt') end as title_pt", "case when repurchase_rate % 20 = 0 then category_label end as region",
        "case when repurchase_rate > 80 then 'complete' when repurchase_rate > 20 then 'partial' else 'none' end as enrichment_status")
    return [rows.where(F.col("run_kind") == k).drop("run_kind") for k in ("R", "A", "N")]


MERGED = """stacked as (select title, supplier_name, price_min as price, cast(sales_volume_estimate as varchar) as sales, category_label, row_id as position, offer_id,
    case when repurchase_rate > 50 then concat(title, ' pt') end as title_pt, case when repurchase_rate % 20 = 0 then category_label end as region,
    case when repurchase_rate > 80 then 'complete' when repurchase_rate > 20 then 'partial' else 'none' end as enrichment_status,
    case run_kind when 'R' then 'ranked' when 'A' then 'bestseller' else 'factory' end as source, case run_kind when 'R' then 0 when 'A' then 1 else 2 end as priority from listing_products),
merged as (select * from (select *, row_number() over (partition by title, supplier_name order by priority, position) as rn from stacked) where rn = 1)"""


@query("u03_merge_catalogues", f"with {MERGED} select title, supplier_name, price, sales, category_label, position, source from merged")
def _(c):
    return g.merge_catalogues(*merged(c)).select("title", "supplier_name", "price", "sales", "category_label", "position", "source")


@query("u02_union_catalogues", f"with {MERGED} select source, count(*) as n, count(title_pt) as translated from stacked group by source")
def _(c):
    return g.stacked(list(zip(("ranked", "bestseller", "factory"), merged(c)))).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count("title_pt").alias("translated"))


@query("p22_filter_products", f"""with {MERGED} select title, supplier_name, price, source, region from merged
    where (contains(title, 'ring') or contains(lower(coalesce(title_pt, '')), 'ring') or contains(lower(supplier_name), 'ring'))
    and (contains(category_label, 'PROMO') or contains(category_label, 'SMALL')) and (region is null or contains(region, 'PROMO')) and price >= 300 and price <= 4000
    and source in ('ranked', 'factory') and enrichment_status in ('partial', 'none')""")
def _(c):
    return l.filter_products(g.merge_catalogues(*merged(c)), search="Ring", categories=["promo", "small"], regions=["Promo"], price_min=300, price_max=4000,
                             sources=["ranked", "factory"], enrichment=["partial", "none"]).select("title", "supplier_name", "price", "source", "region")


@query("p23_search_text", f"select {FIELDS} from products where is_active and title ilike '%red w%' order by sales_30d desc, id limit 20")
def _(c):
    return fields(l.search_text(c.view("products"), "Red W"))


@query("p23_search_two_titles", f"""select {FIELDS} from products where is_active and (title ilike '%red w%' or (case when id % 5 = 0 then concat(title, ' Azul red w') end) ilike '%red w%') order by sales_30d desc, id limit 20""")
def _(c):
    return fields(l.search_text(c.view("products").withColumn("title_pt", F.expr("case when id % 5 = 0 then concat(title, ' Azul red w') end")), "Red W"))


@query("p24_enrichment_queue", "select row_id, offer_id from listing_products where run_kind = 'R' and (repurchase_rate < 10 or repurchase_rate = 50)")
def _(c):
    junk = "case when repurchase_rate < 10 then null when repurchase_rate = 50 then '全球领先的采购批发平台,批发网' else title end as title"
    return l.enrichment_queue(c.view("listing_products").where("run_kind = 'R'").selectExpr("row_id", "offer_id", junk)).select("row_id", "offer_id")


@query("p25_spec_backfill_queue", """select p_partkey as id, p_partkey as offer_id, p_name as title, p_size as sales_count, p_type as product_category from part
    where (p_partkey % 2 = 0 or p_size < 5) and p_type in ('PROMO', 'LARGE') order by p_size desc, p_partkey limit 100""")
def _(c):
    d = c.table("part").selectExpr("p_partkey as id", "p_partkey as offer_id", "p_name as title", "p_size as sales_count", "p_type as product_category",
                                   "case when p_partkey % 2 = 1 then 'x' end as main_spec", "'a' as specifications", "'b' as models", "'c' as variant_prices",
                                   "case when p_size >= 5 then 'v' end as video_url")
    return l.spec_backfill_queue(d, 100, ["PROMO", "LARGE"])


@query("w02_dedupe_by", """select title, arg_min(row_id, row_id) as row_id, arg_min(supplier_name, row_id) as supplier_name from listing_products group by title""")
def _(c):
    return g.dedupe_by(c.view("listing_products").select("title", "row_id", "supplier_name"), ["title"], F.col("row_id"))


@query("w02_bestsellers_once", """select row_id, title, supplier_name from (select *, row_number() over (partition by case when repurchase_rate > 10 then cast(offer_id as varchar)
    else concat(title, '|', supplier_name, '|', run_kind) end order by row_id) as rn from listing_products) where rn = 1""")
def _(c):
    d = c.view("listing_products").selectExpr("row_id", "title", "supplier_name", "run_kind as keyword", "case when repurchase_rate > 10 then offer_id end as offer_id")
    return g.bestsellers(d, F.col("row_id")).select("row_id", "title", "supplier_name")


RELEVANCE = """repurchase_rate * coalesce(sales_volume_estimate, 0) * case when category_label = 'PROMO' then 2.0::double when category_label in ('SMALL', 'LARGE') then 0.2::double else 1.0 end"""


def score():
    return l.relevance(["PROMO"], ["SMALL", "LARGE"])


@query("w07_top_products", f"""select row_id, offer_id, title, category_label, {R(RELEVANCE, 4)} as relevance from listing_products
    where category_label in ('PROMO', 'SMALL', 'MEDIUM') and price_min > 0 order by relevance desc, row_id limit 30""")
def _(c):
    return l.top_products(c.view("listing_products"), ["PROMO", "SMALL", "MEDIUM"], 30, score()).select("row_id", "offer_id", "title", "category_label", "relevance")


@query("w07_search_products", f"""select row_id, offer_id, title, category_label, {R(RELEVANCE, 4)} as relevance from listing_products
    where contains(title, 'gizmo') order by relevance desc, row_id limit 20""")
def _(c):
    return l.search_products(c.view("listing_products"), "Gizmo", 20, score()).select("row_id", "offer_id", "title", "category_label", "relevance")


@query("w07_search_two_titles", f"""select row_id, offer_id, title, category_label, {R(RELEVANCE, 4)} as relevance from listing_products
    where contains(title, 'gizmo') or (offer_id % 7 = 0) order by relevance desc, row_id limit 20""")
def _(c):
    rows = c.view("listing_products").withColumn("title_pt", F.expr("case when offer_id % 7 = 0 then 'Um GIZMO novo' end"))
    return l.search_products(rows, "Gizmo", 20, score()).select("row_id", "offer_id", "title", "category_label", "relevance")


PATHED = """pathed as (select id, platform, title, price, sales_30d, is_active, category_l1 as category, category_l2 as category_n2, case when id % 2 = 0 then category_l3 end as category_n3,
    null::varchar as category_n4, concat(category_l1, '.', category_l2, '.', category_l3, '.x') as category_path,
    case when id % 11 <> 0 then timestamp '2024-01-01' + to_days(cast(id % 90 as int)) end as last_updated from products)"""


def pathed(c):
    at = F.when(F.col("id") % 11 != 0, F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval((F.col("id") % 90).cast("int")))
    return c.view("products").selectExpr(
        "id", "platform", "title", "price", "sales_30d", "is_active", "category_l1 as category", "category_l2 as category_n2", "case when id % 2 = 0 then category_l3 end as category_n3",
        "cast(null as string) as category_n4", "concat(category_l1, '.', category_l2, '.', category_l3, '.x') as category_path").withColumn("last_updated", at)


@query("w08_by_category", f"""with {PATHED} select id, title, price, category_path from pathed where is_active and (category = 'uncategorized' or starts_with(category_path, 'uncategorized.'))
    and (category_n3 = 'S2' or contains(category_path, '.S2.')) and platform = 'ml' order by price, id limit 20 offset 10""")
def _(c):
    return l.category_page(l.by_category(pathed(c), n1="uncategorized", n3="S2", platform="ml"), limit=20, offset=10).select("id", "title", "price", "category_path")


@query("w08_by_category_newest", f"""with {PATHED} select id, title, strftime(last_updated, '%Y-%m-%d') as last_updated from pathed where is_active and (category_n2 = 'PROMO' or contains(category_path, '.PROMO.'))
    order by last_updated desc nulls first, id limit 50""")
def _(c):
    page = l.category_page(l.by_category(pathed(c), n2="PROMO"), "newest", 50)
    return page.select("id", "title", F.date_format("last_updated", "yyyy-MM-dd").alias("last_updated"))


@query("w08_category_totals", f"with {PATHED} select count(*) as total from pathed where is_active and (category_n2 = 'PROMO' or contains(category_path, '.PROMO.'))")
def _(c):
    return l.by_category(pathed(c), n2="PROMO").agg(F.count(F.lit(1)).alias("total"))


@query("w08_breadcrumbs", "select distinct p_type as slug, case p_type when 'PROMO' then 1 else 2 end::int as position from part where p_type in ('PROMO', 'SMALL')")
def _(c):
    return l.breadcrumbs(c.table("part").select(F.col("p_type").alias("slug")).distinct(), ["PROMO", "SMALL"])


@query("w09_cheapest_by_platform", """select id, platform, price_brl, position from (select *, cast(row_number() over (partition by platform order by price_brl nulls last, id) as int) as position
    from (select id, platform, case when id % 13 > 0 then price end as price_brl from products)) where position <= 25""")
def _(c):
    return l.cheapest_by_platform(c.view("products").selectExpr("id", "platform", "case when id % 13 > 0 then price end as price_brl"), 25)


@query("w09_sort_by_price", "select id, price_brl from (select id, case when id % 13 > 0 then price end as price_brl from products) order by price_brl nulls last, id")
def _(c):
    return l.sort_by_price(c.view("products").selectExpr("id", "case when id % 13 > 0 then price end as price_brl"), "price_brl", "id")


@query("w10_new_products", f"""with {PATHED} select id, title from pathed where is_active and last_updated >= timestamp '2024-03-31' - interval 20 days order by last_updated desc, id limit 20""")
def _(c):
    return l.new_products(pathed(c).withColumnRenamed("last_updated", "created_at"), F.lit("2024-03-31").cast("timestamp_ntz"), 20).select("id", "title")


@query("w11_rank_results", f"""with b as (select min(price) as lo, max(price) as hi from products),
s as (select id, case when contains(lower(title), 'red ring') then 100.0::double when contains(lower(title), 'red') and contains(lower(title), 'ring') then 90
      when contains(lower(title), 'red') or contains(lower(title), 'ring') then 75 else 0 end as text_score, (1 - (price - lo) / (hi - lo)) * 100 as p,
      case when sales_30d > 0 then least(100.0::double, log10(sales_30d + 1) * 25) else 0 end as sl from products, b),
r as (select id, text_score, {R('p', 4)} as price_score, {R('sl', 4)} as sales_score from s)
select id, text_score, price_score, sales_score, {R('text_score * 0.30::double + price_score * 0.20::double + sales_score * 0.10::double', 4)} as composite_score from r""")
def _(c):
    return rank_results(c.view("products"), "Red Ring", title="title", price="price", sales="sales_30d").select(
        "id", "text_score", "price_score", "sales_score", "composite_score")


EXPLORE = """from products p left join matches m on m.product_a_id = p.id where p.is_active and p.platform in ('amazon_br', 'ml') and price >= 900 and price <= 1090 and sales_30d >= 300"""


def explored(c, **more):
    p = c.view("products").withColumn("category", F.concat("category_l1", F.lit("."), "category_l2"))
    return l.explore_rows(p, matches(c), platforms=["amazon_br", "ml"], min_price=900, max_price=1090, min_sales=300, **more)


@query("j02_explore", f"select p.id, platform, title, price, sales_30d, confidence {EXPLORE} order by price desc nulls last, id, confidence desc nulls last limit 40 offset 20")
def _(c):
    return l.explore(explored(c), "price_desc", 40, 20).select("id", "platform", "title", "price", "sales_30d", "confidence")


@query("j02_explore_matched", f"""select p.id, platform, title, price, sales_30d, confidence {EXPLORE} and confidence >= 0.21
    and (starts_with(category_l1 || '.' || category_l2, 'L1.') or category_l1 || '.' || category_l2 = 'L1') order by confidence desc nulls last, id, confidence desc limit 40""")
def _(c):
    return l.explore(explored(c, min_match=0.21, category="L1"), "match_desc", 40).select("id", "platform", "title", "price", "sales_30d", "confidence")


@query("a14_explore_facets", f"select count(*) as total, {R('avg(price)', 4)} as avg_price, count(distinct case when confidence is not null then p.id end) as matched_count {EXPLORE}")
def _(c):
    return l.explore_facets(explored(c))


@query("a14_platform_counts", f"select platform, count(distinct p.id) as count {EXPLORE} group by platform")
def _(c):
    return l.platform_counts(explored(c))


@query("j03_borrow_supplier_url", """with f as (select p_partkey, concat('s', p_partkey // 40) as supplier_name, case when p_partkey % 10 > 0 then p_partkey end as offer_id, case when p_partkey % 3 = 0 then concat('http://s/', p_partkey) end as supplier_url from part)
select p.p_partkey, p.offer_id, p.supplier_name, coalesce(p.supplier_url, (select max(s.supplier_url) from f s where s.supplier_name = p.supplier_name and s.offer_id is null)) as supplier_url
from f p where p.offer_id is not null""")
def _(c):
    return g.borrow_supplier_url(factory(c)).select("p_partkey", "offer_id", "supplier_name", "supplier_url")


def factory(c):
    return c.table("part").selectExpr("p_partkey", "concat('s', p_partkey div 40) as supplier_name", "case when p_partkey % 10 > 0 then p_partkey end as offer_id",
                                      "case when p_partkey % 3 = 0 then concat('http://s/', p_partkey) end as supplier_url")


@query("j03_borrow_supplier_url_fan_out", """with f as (select p_partkey, concat('s', p_partkey // 40) as supplier_name, case when p_partkey % 10 > 0 then p_partkey end as offer_id, case when p_partkey % 3 = 0 then concat('http://s/', p_partkey) end as supplier_url from part)
select p.p_partkey, coalesce(p.supplier_url, s.supplier_url) as supplier_url from f p left join f s on s.supplier_name = p.supplier_name and s.offer_id is null where p.offer_id is not null""")
def _(c):
    return g.borrow_supplier_url(factory(c), fan_out=True).select("p_partkey", "supplier_url")


@query("j05_unmatched_bestsellers", """with mb as (select id, case when id % 3 = 0 then upper(title) when id % 40 = 1 then substr(title, 1, 8) else title end as title, sales_30d * 1.0::double as sales_velocity from products where platform = 'ml'),
lp as (select distinct case when id % 64 = 3 then title else reverse(title) end as title from products where platform = 'rakumart-1688'), fp as (select distinct case when id % 64 = 2 then substr(title, 1, 19) else concat('x ', reverse(title)) end as title from products where platform = 'amazon_us')
select id, title, sales_velocity from mb where not exists (select 1 from lp where contains(lower(lp.title), lower(left(mb.title, 20))) or contains(lower(mb.title), lower(left(lp.title, 20))))
and not exists (select 1 from fp where contains(lower(fp.title), lower(left(mb.title, 20))) or contains(lower(mb.title), lower(left(fp.title, 20)))) order by sales_velocity desc, id limit 50""")
def _(c):
    p = c.view("products")
    mb = p.where("platform = 'ml'").selectExpr("id", "case when id % 3 = 0 then upper(title) when id % 40 = 1 then substr(title, 1, 8) else title end as title", "cast(sales_30d as double) as sales_velocity")
    lp = p.where("platform = 'rakumart-1688'").selectExpr("case when id % 64 = 3 then title else reverse(title) end as title")
    fp = p.where("platform = 'amazon_us'").selectExpr("case when id % 64 = 2 then substr(title, 1, 19) else concat('x ', reverse(title)) end as title")
    return l.unmatched_bestsellers(mb, [lp, fp])


# Most names are changed, so that only some listings find their product.
SILVER_TITLE = "case when p_type <> 'PROMO' and p_size > 48 then p_name else concat(p_name, ' *') end"
SILVER = f"""silver as (select min(p_partkey) as id, {SILVER_TITLE} as title, case when min(p_partkey) % 3 > 0 then sum(p_size) end::bigint as ml_sales_volume, 'listing' as bronze_source from part group by {SILVER_TITLE})"""


def silver(c):
    s = c.table("part").groupBy(F.expr(SILVER_TITLE).alias("title")).agg(F.min("p_partkey").alias("id"), F.sum("p_size").alias("v"))
    return s.selectExpr("id", "title", "case when id % 3 > 0 then v end as ml_sales_volume", "'listing' as bronze_source")


GAP = f"with {SILVER}, gap as (select lp.* from listing_products lp left join silver s on s.title = lp.title and s.bronze_source = 'listing' where s.ml_sales_volume is null or s.id is null)"


@query("j06_china_not_in_brazil", GAP + """ select row_id, title, price_min, sales_volume_estimate, floor(sales_volume_estimate / price_min * 10 + 0.5) / 10 as opportunity_score
    from gap order by sales_volume_estimate desc, price_min, row_id limit 50""")
def _(c):
    return l.china_not_in_brazil(c.view("listing_products"), silver(c)).select("row_id", "title", "price_min", "sales_volume_estimate", "opportunity_score")


@query("a07_opportunity_stats", GAP + f""" select count(*) as total_products, {R('avg(price_min)', 2)} as avg_price, {R('avg(sales_volume_estimate)', 0)} as avg_sales,
    (select category_label from gap group by 1 order by count(*) desc, 1 limit 1) as top_category, (select count(*) from gap group by category_label order by 1 desc limit 1) as top_category_count from gap""")
def _(c):
    return l.opportunity_stats(c.view("listing_products"), silver(c))


@query("j12_title_match", rf"""with ml as (select id, title, price from products where platform = 'ml'), cn as (select id, title, price from products where platform = 'rakumart-1688'),
titles as (select title from ml union select title from cn), tok as (select title, unnest(list_filter(string_split_regex(lower(title), '[^\pL\pN]+'), lambda x: x <> '')) as token from titles),
tf as (select title, token, count(*) as tf from tok group by 1, 2), df as (select token, count(*) as df from tf group by 1),
w as (select title, token, tf * (ln((1 + (select count(*) from titles)) / (1 + df)::double) + 1) as w from tf join df using (token)),
u as (select title, token, w / sqrt(sum(w * w) over (partition by title)) as w from w),
sem as (select a.title as a, b.title as b, round(sum(a.w * b.w), 6) as semantic_score from u a join u b using (token) where a.title in (select title from ml) and b.title in (select title from cn) group by 1, 2),
sc as (select *, round(levenshtein(a, b) / greatest(length(a), length(b)), 6) as nd, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) as fuzzy_score from sem where semantic_score >= 0.6),
m as (select ml.id as ml_id, cn.id as china_id, ml.title as ml_title, cn.title as china_title, semantic_score, fuzzy_score, nd as normalized_edit_distance,
      {R('0.5::double * fuzzy_score + 0.5::double * semantic_score', 6)} as match_score, ml.price as bp, cn.price as cp from sc join ml on ml.title = a join cn on cn.title = b),
r as (select *, cast(row_number() over (partition by ml_id order by match_score desc, china_id) as int) as rank from m)
select ml_id, china_id, ml_title, china_title, semantic_score, fuzzy_score, normalized_edit_distance, match_score, 'title_combined' as match_method,
       {R('(bp - cp * 0.8::double) / bp', 4)} as margin_estimate, rank from r where rank <= 3""")
def _(c):
    p = c.view("products").select("id", "title", "price", "platform")
    return l.title_match(p.where("platform = 'ml'"), p.where("platform = 'rakumart-1688'"), threshold=0.6, k=3)


@query("j14_enrich_titles", """with t as (select title, max(pt) as pt from (select case when p_size > 40 then p_name else concat(p_name, ' *') end as title, case when p_partkey % 5 > 0 then concat(p_name, ' pt', p_partkey % 3) end as pt from part) where pt is not null group by 1)
select id, p.title, coalesce(t.pt, case when id % 2 = 0 then 'own' end) as title_pt from (select p_partkey as id, p_name as title from part) p left join t on t.title = p.title""")
def _(c):
    d = c.table("part").selectExpr("p_partkey as id", "p_name as title", "case when p_partkey % 2 = 0 then 'own' end as title_pt")
    t = c.table("part").selectExpr("case when p_size > 40 then p_name else concat(p_name, ' *') end as title", "case when p_partkey % 5 > 0 then concat(p_name, ' pt', p_partkey % 3) else '' end as title_pt")
    return g.enrich_titles(d, t)


@query("j14_bestseller_matches", """select title, position, total_sales, total_sales / 30.0::double as sales_velocity, category_name from (
    select *, row_number() over (partition by title order by position is null desc, position desc, total_sales desc, category_name desc) as rn from (
      select lower(p_name) as title, case when p_size % 9 > 0 then p_partkey end as position, p_size as total_sales, p_type as category_name from part
      where lower(p_name) in (select lower(case when p_size = 7 then p_name else concat('* ', p_name) end) from part))) where rn = 1""")
def _(c):
    wanted = c.table("part").selectExpr("concat(' ', upper(case when p_size = 7 then p_name else concat('* ', p_name) end), ' ') as title")
    ml = c.table("part").selectExpr("p_name as title", "case when p_size % 9 > 0 then p_partkey end as position", "p_size as total_sales", "p_size / 30D as sales_velocity", "p_type as category_name")
    return g.bestseller_matches(wanted, ml)


HYBRID = f"""with act as (select * from products where is_active), hits as (select *, row_number() over (order by case when platform = 'ml' then 1 else 0 end, price, id) as rn from act where contains(lower(title), 'red ring promo')),
f as (select * from hits where rn = 1 and embedding is not null),
v as (select a.id, round(list_cosine_similarity(f.embedding::double[], a.embedding::double[]), 6) * 100 as vis from act a, f where a.embedding is not null order by vis desc, a.id limit 10),
both_hits as (select coalesce(t.id, v.id) as id, t.id is not null as txt, vis from (select id from hits where rn <= 10) t full join v on v.id = t.id),
j as (select b.*, platform, title, price, category_l1, {R('vis', 1)} as visual_score from both_hits b join act using (id)), bounds as (select min(price) as lo, max(price) as hi from j),
s as (select *, case when contains(lower(title), 'red ring promo') then 100.0::double else case when contains(lower(title), 'red') and contains(lower(title), 'ring') and contains(lower(title), 'promo') then 90
      else case contains(lower(title), 'red')::int + contains(lower(title), 'ring')::int + contains(lower(title), 'promo')::int when 0 then 0 when 1 then 70 else 80 end end end as ts from j, bounds)
select id, platform, title, price, category_l1 as category, case when txt and vis is not null then 'hybrid' when txt then 'text' else 'visual' end as match_type, visual_score,
    {R('ts', 1)} as text_score, {R('ts * 0.30::double + coalesce(visual_score, 0) * 0.40::double + case when hi > lo then (1 - (price - lo) / (hi - lo)) * 100 else 50 end * 0.20::double', 1)} as composite_score
from s order by composite_score desc, id limit 10"""


@query("j18_compare_hybrid", HYBRID)
def _(c):
    return l.compare_hybrid(c.view("products"), "Red Ring Promo")


@query("j19_compare_by_id", f"""with n as (select a.id, round(list_cosine_similarity(s.embedding::double[], a.embedding::double[]), 6) as sim, a.* exclude (id, embedding) from products a, products s
    where s.id = 12 and a.id <> 12 and a.is_active and a.embedding is not null),
r as (select *, cast(row_number() over (order by sim desc, id) as int) as rank from n)
select id, {R('sim * 100', 1)} as visual_score, rank, platform, title, price, category_l1 as category, {R('sim * 100', 1)} as composite_score, 'visual' as match_type from r where rank <= 10""")
def _(c):
    return l.compare_by_id(c.view("products"), 12)


@query("u04_category_products", f"""with {MERGED}, once as (select * from (select *, row_number() over (partition by supplier_name, title, price order by priority, position) as rn from stacked where category_label in ('PROMO', 'SMALL')) where rn = 1)
select title, supplier_name, price, sales, category_label, source, position from once""")
def _(c):
    return g.category_products(["promo", "Small"], *merged(c)).select("title", "supplier_name", "price", "sales", "category_label", "source", "position")


def ranked_with_products(c):
    """Ranked suppliers, each with the parts of its number as top products."""
    s = c.view("ranked_suppliers")
    product = """to_json(array(named_struct('title', p_name, 'price', concat('¥', p_size, '.50'), 'sales', concat('热销', p_partkey, '+'), 'source_url', case when p_partkey % 2 = 0 then concat('http://p/', p_partkey % 700) end,
        'image_url', concat('http://i/', p_partkey % 300)), named_struct('title', 'x', 'price', null, 'sales', '1.5万', 'source_url', concat('http://p/', p_partkey % 50), 'image_url', null))) as top_products_json"""
    part = c.table("part").selectExpr("p_partkey", "p_partkey % 90 as k", product)
    joined = part.join(s, part.k == s.supplier_key)
    return joined.selectExpr("supplier_key + 1000 * p_partkey as supplier_key", "supplier_name", "region", "category_label", "p_partkey as rank_position",
                             "case when p_partkey % 3 = 0 then 'c1' end as category_id", "top_products_json")


RANKED = """tops as (select s.supplier_name, s.region, s.category_label, p_partkey as rank, s.supplier_key + 1000 * p_partkey as skey, i as position, case when p_partkey % 3 = 0 then 'c1' end as category_id,
    case i when 0 then p_name else 'x' end as title, case i when 0 then p_size + 0.5 end::double as price, case i when 0 then concat(p_partkey, '+') else '15,000' end as sales,
    case when i = 1 then concat('http://p/', p_partkey % 50) when p_partkey % 2 = 0 then concat('http://p/', p_partkey % 700) end as source_url, case i when 0 then concat('http://i/', p_partkey % 300) end as image_url
    from (select *, unnest([0, 1]) as i from part) join ranked_suppliers s on s.supplier_key = p_partkey % 90),
exploded as (select * from (select *, row_number() over (partition by coalesce(source_url, image_url, supplier_name), price order by rank, skey, position) as rn from tops) where rn = 1)"""


@query("u05_ranked_products", f"""with {RANKED} select title, image_url, price, sales, category_label, source_url, supplier_name, concat('/suppliers/', case when category_id is not null then concat('c1_', rank) else cast(skey as varchar) end) as supplier_href,
    region, rank, position::int as position from exploded""")
def _(c):
    return g.ranked_products(ranked_with_products(c)).select("title", "image_url", "price", "sales", "category_label", "source_url", "supplier_name", "supplier_href", "region", "rank", "position")


U06_RANKED = "case when supplier_key % 4 = 0 then concat('Old ', supplier_name) else concat(' ', upper(supplier_name)) end"
U06_LISTED = """select *, concat('c', offer_id % 5) as category_ids, case when offer_id % 3 > 0 then concat('http://p/', offer_id % 4) end as supplier_url from listing_products"""


@query("u06_supplier_profiles", f"""with r as (select lower(trim(supplier_name)) as key, *, concat('k', supplier_key % 3) as category_id, concat('http://r/', supplier_key) as source_url
    from (select * replace ({U06_RANKED} as supplier_name) from ranked_suppliers)),
lp as (select lower(trim(supplier_name)) as key, * from ({U06_LISTED})),
f as (select key, count(distinct offer_id) as product_count, arg_min(supplier_name, row_id) as listed, string_agg(distinct cast(offer_id as varchar), ',' order by cast(offer_id as varchar)) as products from lp group by 1),
e as (select key, 'label' as kind, category_label as v, '' as o from r union all select key, 'label', category_label, row_id from lp
    union all select key, 'id', category_id, '' from r union all select key, 'id', category_ids, row_id from lp union all select key, 'url', source_url, '' from r union all select key, 'url', supplier_url, row_id from lp where supplier_url is not null),
d as (select key, kind, v, min(o) as o from e group by 1, 2, 3),
g as (select key, string_agg(v, ',' order by o, v) filter (where kind = 'label') as category_labels, string_agg(v, ',' order by o, v) filter (where kind = 'id') as category_ids, string_agg(v, ',' order by o, v) filter (where kind = 'url') as source_urls from d group by 1)
select coalesce(cast(supplier_key as varchar), listed) as id, coalesce(supplier_name, listed) as name, region, rank_position, category_labels, category_ids, source_urls, coalesce(product_count, 0) as product_count, coalesce(products, '') as products
from r full join f on f.key = r.key left join g on g.key = coalesce(r.key, f.key)""")
def _(c):
    return profiles(c)


def profiles(c):
    s = c.view("ranked_suppliers").withColumns({"supplier_name": F.expr(U06_RANKED), "category_id": F.expr("concat('k', supplier_key % 3)"), "source_url": F.expr("concat('http://r/', supplier_key)")})
    l_ = c.view("listing_products").selectExpr("*", "concat('c', offer_id % 5) as category_ids", "case when offer_id % 3 > 0 then concat('http://p/', offer_id % 4) end as supplier_url")
    joined = lambda name: F.array_join(name, ",").alias(name)
    products = F.array_join(F.array_sort(F.transform("products", lambda p: p.cast("string"))), ",").alias("products")
    return g.supplier_profiles(s, l_).select("id", "name", "region", "rank_position", joined("category_labels"), joined("category_ids"), joined("source_urls"), "product_count", products)


@query("u06_supplier_products", f"""with lp as (select lower(trim(supplier_name)) as key, * from ({U06_LISTED}))
select key, offer_id, arg_min(title, row_id) as title, arg_min(category_ids, row_id) as category_ids, min(row_id) as row_id from lp group by 1, 2""")
def _(c):
    l_ = c.view("listing_products").selectExpr("*", "concat('c', offer_id % 5) as category_ids")
    return g.supplier_products(l_).select("key", "offer_id", "title", "category_ids", "row_id")


@query("u06_supplier_profile", f"""select cast(supplier_key as varchar) as id, region from ranked_suppliers where supplier_key = 7""")
def _(c):
    s = c.view("ranked_suppliers")
    return g.supplier_profile(g.supplier_profiles(s, c.view("listing_products")), "7").select("id", "region")


@query("u07_product_profile", """select title, 'factory' as source, p_partkey as position from (select p_name as title, p_partkey from part where p_partkey = 77)""")
def _(c):
    ranked = c.view("listing_products").selectExpr("title", "offer_id", "row_id as position")
    part = c.table("part").selectExpr("p_name as title", "concat('F', p_partkey) as offer_id", "p_partkey as position")
    found = g.product_profile(" f77 ", [
        ("bestseller", ranked.withColumn("offer_id", F.col("offer_id").cast("string")).withColumn("position", F.lit(0).cast("bigint")), ["offer_id", "title"]),
        ("ranked", part.withColumn("offer_id", F.lit("none")), ["offer_id"]), ("factory", part, ["offer_id", "title"])])
    return found.select("title", "source", "position")


SEARCHED = """s as (select l_returnflag as q, platform, concat('u', id % 900) as product_url, title as product_name, l_extendedprice / l_quantity as price_brl, l_orderkey, l_linenumber from products join lineitem on l_partkey = id)"""


def searched(c):
    rows = c.view("products").select("id", "platform", "title").join(c.table("lineitem"), F.col("l_partkey") == F.col("id")).selectExpr(
        "l_returnflag as q", "platform", "concat('u', id % 900) as product_url", "title as product_name", "l_extendedprice / l_quantity as price_brl", "l_orderkey", "l_linenumber")
    return g.merge_category_results(rows, ["ring", "promo"], F.struct("l_orderkey", "l_linenumber", "price_brl", "platform"))


@query("a39_merge_category_results", f"""with {SEARCHED} select product_url, product_name, price_brl, platform from (select *, row_number() over (partition by product_url order by l_orderkey, l_linenumber, price_brl, platform) as rn
    from s where not contains(lower(product_name), 'ring') and not contains(lower(product_name), 'promo')) where rn = 1""")
def _(c):
    return searched(c)[0].select("product_url", "product_name", "price_brl", "platform")


@query("a39_platform_counts", f"with {SEARCHED} select platform, count(*) as products from s group by platform")
def _(c):
    return searched(c)[1]
