"""Aggregate reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from souklens.operators import reports as r
from souklens.operators.merge import merge_catalogues
from souklens.plans.queries import history as hist, listings as lst, similarity as sim
from souklens.plans.registry import matches, query, sql_round as R


@query("a01_list_categories", """select label, sum(n)::bigint as count from (select category_label as label, count(*) as n from listing_products where trim(category_label) <> '' group by 1
    union all select p_type, count(*) from part where trim(p_type) <> '' group by 1) group by label""")
def _(c):
    return r.list_categories(c.view("listing_products"), c.table("part").selectExpr("p_type as product_category"))


STATS = f"""select category_label, count(*) as product_count, count(distinct supplier_name) as supplier_count, {R('avg(price_min)', 2)} as avg_price_min,
    {R('avg(sales_volume_estimate)', 2)} as avg_sales_volume, {R('avg(repurchase_rate)', 1)} as avg_repurchase_rate
    from (select * replace (case when repurchase_rate = 30 then 'NaN'::double when repurchase_rate = 40 then null else price_min end as price_min) from listing_products)
    where price_min is not null and not isnan(price_min) %s group by 1"""


def odd_prices(c):
    return c.view("listing_products").withColumn("price_min", F.expr("case when repurchase_rate = 30 then double('NaN') when repurchase_rate = 40 then null else price_min end"))


@query("a02_category_stats", STATS % "")
def _(c):
    return r.category_stats(odd_prices(c))


@query("a02_one_category_stats", STATS % "and category_label = 'PROMO'")
def _(c):
    return r.category_stats(odd_prices(c), "PROMO")


@query("a03_region_counts", "select region, count(*) as count from ranked_suppliers group by region")
def _(c):
    return r.region_counts(c.view("ranked_suppliers"))


@query("a04_meta", """with runs as (select cast(year(l_shipdate) as int) as id, case when l_returnflag = 'R' then 'rankings' else 'bestsellers' end as kind, count(*) as n from lineitem group by 1, 2)
select count(*) filter (where kind = 'rankings') as rankings_runs, max(id) filter (where kind = 'rankings') as rankings_latest_run, arg_max(n, id) filter (where kind = 'rankings') as rankings_latest_count,
    count(*) filter (where kind = 'bestsellers') as bestsellers_runs, max(id) filter (where kind = 'bestsellers') as bestsellers_latest_run, arg_max(n, id) filter (where kind = 'bestsellers') as bestsellers_latest_count,
    (select count(distinct p_type) from part) as categories, (select count(distinct region) from ranked_suppliers) as regions from runs""")
def _(c):
    runs = c.table("lineitem").groupBy(
        F.year("l_shipdate").alias("id"), F.when(F.col("l_returnflag") == "R", "rankings").otherwise("bestsellers").alias("kind")).agg(F.count(F.lit(1)).alias("count"))
    return r.meta(runs, c.view("listing_products"), c.table("part").selectExpr("p_type as product_category"), c.view("ranked_suppliers"))


@query("a05_factories", """select p_brand as supplier_name, max(case when p_partkey % 3 = 0 then p_name end) as supplier_url, max(p_size) as factory_employees, max(coalesce(nullif(p_type, 'PROMO'), p_name)) as supplier_category
    from part where p_brand <> 'Brand#3' group by 1""")
def _(c):
    d = c.table("part").selectExpr("case when p_brand = 'Brand#3' then '' else p_brand end as supplier_name", "case when p_partkey % 3 = 0 then p_name end as supplier_url",
                                   "p_size as factory_employees", "coalesce(nullif(p_type, 'PROMO'), p_name) as supplier_category")
    return r.factories(d, ["supplier_url", "factory_employees", "supplier_category"])


@query("a06_demand_by_category", f"""select category_l2 as ml_category, count(*) as product_count, sum(sales_30d)::bigint as total_ml_sales, {R('avg(sales_30d)', 0)} as avg_ml_sales, {R('avg(price)', 2)} as avg_price_cny
    from products where sales_30d > 0 group by 1 order by total_ml_sales desc, 1 limit 15""")
def _(c):
    return r.demand_by_category(c.view("products").selectExpr("category_l2 as ml_category", "sales_30d as ml_sales_volume", "price as price_cny"))


SCOUT = f"""select category_label, count(*) as product_count, {R('avg(repurchase_rate)', 0)}::int as avg_repurchase, {R('avg(price_min)', 2)} as avg_price, sum(sales_volume_estimate)::bigint as total_sales,
    case when category_label = 'PROMO' then 0 else 1 end as tier from listing_products where category_label <> 'SMALL' %s group by 1"""


@query("a10_search_categories", SCOUT % "and (contains(lower(category_label), 'red') or contains(lower(title), 'red'))" + " order by tier, avg_repurchase desc, total_sales desc, category_label limit 10")
def _(c):
    return r.scout_categories(c.view("listing_products"), "Red", high=["PROMO"], commodity=["SMALL"])


@query("a10_search_four_texts", SCOUT % "and (contains(lower(category_label), 'red') or contains(lower(title), 'red') or category_label = 'MEDIUM' or offer_id % 9 = 0)" + " order by tier, avg_repurchase desc, total_sales desc, category_label limit 10")
def _(c):
    rows = c.view("listing_products").withColumns({"category_label_pt": F.expr("case when category_label = 'MEDIUM' then 'Médio (RED)' end"), "title_pt": F.expr("case when offer_id % 9 = 0 then 'Coisa Red' end")})
    return r.scout_categories(rows, "Red", high=["PROMO"], commodity=["SMALL"])


@query("a11_scout_categories", SCOUT % "")
def _(c):
    return r.scout_categories(c.view("listing_products"), high=["PROMO"], commodity=["SMALL"])


@query("a13_badge_categories", """with cat as (select p_brand as category, avg(p_size)::double as avg_repurchase, sum(p_partkey)::bigint as total_sales from part group by 1),
m as (select (select list_sort(list(total_sales))[len(list(total_sales)) // 2 + 1] from cat where total_sales > 0) as ms, (select list_sort(list(avg_repurchase * 3))[len(list(avg_repurchase)) // 2 + 1] from cat where avg_repurchase > 0) as mr)
select category, concat_ws(',', case when avg_repurchase * 3 >= 70 and total_sales > ms then 'Golden Find' when total_sales > ms then 'Trending Category' end,
    case when avg_repurchase * 3 >= 70 and total_sales <= ms then 'Proven' end, case when avg_repurchase * 3 < 70 and avg_repurchase * 3 > mr then 'Above-Average Repurchase' end) as badges,
    total_sales > ms as market_active from cat, m""")
def _(c):
    cat = c.table("part").groupBy(F.col("p_brand").alias("category")).agg((F.avg("p_size") * 3).alias("avg_repurchase"), F.sum("p_partkey").alias("total_sales"))
    return r.badge_categories(cat).select("category", F.array_join("badges", ",").alias("badges"), "market_active")


@query("a13_badge_products", f"""with {hist.VELOCITY}, m as (select list_sort(list(sales_volume_estimate))[len(list(sales_volume_estimate)) // 2 + 1] as ms from listing_products where sales_volume_estimate > 0),
b as (select row_id, lp.repurchase_rate as rep, sales_volume_estimate > ms or coalesce(v.daily_velocity > 0, false) as trending, coalesce(v.daily_velocity > 0, false) as up, lp.repurchase_rate >= 70 as proven
      from listing_products lp left join velocity v on v.offer_id = lp.offer_id, m)
select row_id, case when proven and trending then 'Golden Find' when proven then 'Proven' when trending then 'Trending' else '' end as badge, trending and not proven and rep < 50 as trending_caution,
    case when proven and trending then 0 when trending and up then 1 when trending then 2 when proven then 3 else 4 end as badge_order from b""")
def _(c):
    return r.badge_products(c.view("listing_products"), hist.velocity(c)).select("row_id", "badge", "trending_caution", "badge_order")


@query("a15_global_stats", """select count(*) filter (where is_active) as total_products, count(embedding) filter (where is_active) as embedded_products, count(distinct case when is_active then category_l1 end) as total_categories,
    (select count(*) from matches) as total_matches, (select count(distinct p_type) from part) as taxonomy_entries from products""")
def _(c):
    return r.global_stats(c.view("products"), matches(c), c.table("part").select("p_type").distinct())


@query("a15_category_histogram", "select category_l1 as category, count(*) as count from products where is_active group by 1")
def _(c):
    return r.category_histogram(c.view("products"))


@query("a16_platform_stats", """select 'platform' as kind, platform as name, count(*) as count from products where is_active group by 2 union all select 'category', category_l1, count(*) from products where is_active group by 2
    union all select 'matches', category_l1, count(distinct match_id) from products p join matches m on m.product_a_id = p.id or m.product_b_id = p.id where is_active group by 2""")
def _(c):
    return r.platform_stats(c.view("products"), matches(c))


@query("a17_category_pivot", """select category_l1, category_l2, category_l3, count(*) as product_count, count(*) filter (where platform = 'amazon_br') as amazon_br_count, count(*) filter (where platform = 'amazon_us') as amazon_us_count,
    count(*) filter (where platform = 'ml') as ml_count from products where is_active group by 1, 2, 3""")
def _(c):
    return r.category_pivot(c.view("products"))


@query("a18_category_detail", f"""select 'platform' as kind, platform as name, count(*) as count, {R('avg(price)', 4)} as average, sum(sales_30d)::bigint as total from products where is_active and category_l1 = 'L3' group by 2
    union all select 'subcategory', concat(category_l2, '/', category_l3), count(*), null, null from products where is_active and category_l1 = 'L3' group by 2
    union all select 'matches', 'matches', count(*), {R('avg(confidence)', 6)}, null from matches m join products p on p.id = m.product_a_id where category_l1 = 'L3'""")
def _(c):
    return r.category_detail(c.view("products"), matches(c), "L3")


SUMMARY = f"""select category_l1, count(distinct p.id) as total_products, count(distinct case when platform = 'amazon_br' then p.id end) as amazon_br, count(distinct case when platform = 'amazon_us' then p.id end) as amazon_us,
    count(distinct case when platform = 'ml' then p.id end) as ml, count(distinct match_id) as matches, {R('avg(price)', 2)} as avg_price, sum(sales_30d)::bigint as total_sales
    from products p left join matches m on m.product_a_id = p.id or m.product_b_id = p.id where is_active group by 1"""


@query("a19_category_summary", SUMMARY)
def _(c):
    return r.category_summary(c.view("products"), matches(c))


@query("a19_category_summary_dedup", f"""select s.* exclude (avg_price, total_sales), d.avg_price, d.total_sales from ({SUMMARY}) s join
    (select category_l1, {R('avg(price)', 2)} as avg_price, sum(sales_30d)::bigint as total_sales from products where is_active group by 1) d using (category_l1)""")
def _(c):
    return r.category_summary(c.view("products"), matches(c), dedup=True)


@query("a20_margin_analysis", f"""with m as (select a.category_l1, a.price as ap, b.price as bp, case when b.price > 0 then (a.price - b.price) / b.price * 100 else 0 end as pct from matches join products a on a.id = product_a_id join products b on b.id = product_b_id)
select category_l1, count(*) as match_count, {R('avg(ap)', 2)} as avg_amazon_price, {R('avg(bp)', 2)} as avg_ml_price, {R('avg(ap - bp)', 2)} as avg_price_diff, {R('avg(pct)', 1)} as avg_margin_pct,
    {R('min(pct)', 1)} as min_margin_pct, {R('max(pct)', 1)} as max_margin_pct from m group by 1""")
def _(c):
    return r.margin_analysis(matches(c), c.view("products"))


MAPPINGS = """mappings as (select category_l1 as our_l1, category_l2 as our_l2, category_l3 as our_l3, platform, count(*) as product_count, min(id) % 2 = 0 as verified, case when min(id) % 3 > 0 then 'u' end as bestsellers_url
    from products group by 1, 2, 3, 4)"""


def mappings(c):
    return c.view("products").groupBy(F.col("category_l1").alias("our_l1"), F.col("category_l2").alias("our_l2"), F.col("category_l3").alias("our_l3"), "platform").agg(
        F.count(F.lit(1)).alias("product_count"), (F.min("id") % 2 == 0).alias("verified"), F.when(F.min("id") % 3 > 0, "u").alias("bestsellers_url"))


@query("a21_mapping_stats", f"""with {MAPPINGS} select platform, count(*) as total, count(*) filter (where verified) as verified, count(bestsellers_url) as with_url, sum(product_count)::bigint as total_products, null::bigint as internal_categories
    from mappings group by platform union all select null, count(*), null, null, null, count(distinct our_l1 || '/' || our_l2 || '/' || our_l3) from mappings""")
def _(c):
    return r.mapping_stats(mappings(c))


@query("a22_scraper_health", """select count(*) filter (where o_orderstatus = 'F') as success_count, count(*) filter (where o_orderstatus = 'O') as error_count, count(*) filter (where o_orderstatus = 'P') as partial_count, count(*) as total_runs,
    strftime(max(o_orderdate), '%Y-%m-%d') as last_run, sum(o_custkey)::bigint as total_products_inserted from orders""")
def _(c):
    runs = c.table("orders").selectExpr("case o_orderstatus when 'F' then 'success' when 'O' then 'error' else 'partial' end as status", "o_orderdate as started_at", "o_custkey as products_inserted")
    return r.scraper_health(runs).withColumn("last_run", F.date_format("last_run", "yyyy-MM-dd"))


@query("a23_validate_mappings", f"""with {MAPPINGS}, p as (select our_l1 as l1, our_l2 as l2, our_l3 as l3, string_agg(distinct platform, ',' order by platform) as platforms, count(distinct platform) as platform_count from mappings group by 1, 2, 3),
n as (select category_l1 as l1, category_l2 as l2, category_l3 as l3, count(*) as products, count(*) filter (where platform in ('amazon_br', 'amazon_us')) as amazon, count(*) filter (where platform = 'ml') as ml from products group by 1, 2, 3),
h as (select category_l1 as l1, category_l2 as l2, category_l3 as l3, count(*) as matches from matches join products on id = product_a_id group by 1, 2, 3),
a as (select p.*, coalesce(products, 0) as products, coalesce(amazon, 0) as amazon, coalesce(ml, 0) as ml, coalesce(matches, 0) as matches from p left join n using (l1, l2, l3) left join h using (l1, l2, l3)),
x as (select *, case when amazon > 0 and ml > 0 then matches * 100 / least(amazon, ml)::double end as rate from a)
select l1, l2, l3, platforms, platform_count, products, amazon, ml, matches, {R('rate', 4)} as match_rate, case when amazon = 0 and ml = 0 then 'NO_DATA' when ml = 0 then 'AMAZON_ONLY' when amazon = 0 then 'ML_ONLY'
    when rate < 20 then 'LOW_MATCHES' when rate >= 50 then 'GOOD' when platform_count < 3 then 'INCOMPLETE' else 'OK' end as status from x""")
def _(c):
    return r.validate_mappings(mappings(c), c.view("products"), matches(c))


def imaged(c):
    return c.view("products").withColumn("image_urls", F.expr("case when id % 7 = 0 then null when id % 5 = 0 then array('/images/x') when id % 11 = 0 then array() when id % 13 = 0 then array('ftp://x') else array('http://x') end")).withColumn(
        "price", F.expr("case when id % 17 = 0 then 0 when id % 19 = 0 then null else price end"))


IMAGED = """imaged as (select * replace (case when id % 17 = 0 then 0 when id % 19 = 0 then null else price end as price), case when id % 7 = 0 then null when id % 5 = 0 then '/images/x' when id % 11 = 0 then null when id % 13 = 0 then 'ftp://x' else 'http://x' end as image from products)"""


@query("a24_quality_audit", f"""with {IMAGED}, n as (select count(*) as total, count(*) filter (where starts_with(image, 'http') or starts_with(image, '/images')) as i, count(embedding) as e, count(*) filter (where sales_30d > 0) as s, count(*) filter (where price > 0) as p from imaged where is_active)
select criterion, passed, total - passed as failed, {R('passed / total::double * 100', 2)} as percent, {R('least(i, e, s, p) / total::double * 100', 2)} as overall
from (select *, unnest(['image', 'embedding', 'sales', 'price']) as criterion, unnest([i, e, s, p]) as passed from n)""")
def _(c):
    return r.quality_audit(imaged(c))


@query("a25_quality_fix", f"with {IMAGED} select id, is_active and coalesce(starts_with(image, 'http'), false) and coalesce(price > 0, false) as is_active from imaged")
def _(c):
    return r.quality_fix(imaged(c)).select("id", "is_active")


@query("a26_coverage", "select count(*) as total, count(embedding) as has_embedding, count(nullif(category_l3, 'Geral')) as has_category_l3, count(title) as has_title from products")
def _(c):
    return r.coverage(c.view("products").withColumn("category_l3", F.expr("nullif(category_l3, 'Geral')")), ["embedding", "category_l3", "title"])


@query("a27_classification_coverage", f"""with n as (select count(*) as total, count(nullif(category_l1, 'uncategorized')) as a, count(category_l2) as b, count(nullif(category_l3, 'Geral')) as c from products where is_active)
select level, classified, total, {R('classified / total::double * 100', 1)} as percent from (select total, unnest(['category_l1', 'category_l2', 'category_l3']) as level, unnest([a, b, c]) as classified from n)""")
def _(c):
    p = c.view("products").withColumns({"category_l1": F.expr("nullif(category_l1, 'uncategorized')"), "category_l3": F.expr("nullif(category_l3, 'Geral')")})
    return r.classification_coverage(p)


@query("a27_top_categories", "select category_l2 as category, count(*) as count from products where is_active group by 1 order by count desc, 1 limit 10")
def _(c):
    return r.top_categories(c.view("products"), "category_l2")


@query("a27_audit_sample", "select id, platform, title, category_l1, is_active from products where is_active order by md5(concat('7-', id)), id limit 200")
def _(c):
    return r.audit_sample(c.view("products").select("id", "platform", "title", "category_l1", "is_active"), 200, seed=7)


def reviewed(c):
    return c.view("products").withColumns({"review_count": F.expr("case when id % 4 = 0 then null else id % 60 end"), "review_avg": F.expr("3 + (id % 20) / 10D")})


OPPORTUNITY = """op as (select *, coalesce(case when id % 4 = 0 then null else id % 60 end, 0) as rv, 3 + (id % 20) / 10.0::double as ra from products where embedding is not null),
peers as (select category_l1, count(*) as n, avg(price) as avg_price from (select *, row_number() over (partition by category_l1 order by id) as rn from op where platform = 'ml') where rn <= 5 group by 1),
t as (select *, case when contains(platform, '1688') then sales_30d * 0.4::double + rv * 0.3::double + ra * 20 * 0.3::double else sales_30d * 0.5::double + rv * 0.5::double end as v from op where is_active and platform <> 'ml' order by v desc, id limit 150),
j as (select t.*, coalesce(n, 0) as n, coalesce(avg_price, 0) as ap from t left join peers using (category_l1)),
m as (select *, v / greatest(n * 10, 1) as gap, case when price > 0 and ap > 0 then (ap - price * 1.5::double) / ap * 100 else 0 end as mg, least(v / 100, 1) + case when rv > 0 then least(rv / 50.0::double, 0.5::double) else 0 end as dm from j),
opportunity as (select *, least(100, gap * 30 + mg * 0.4::double * 30 + dm * 40) as sc, case when n = 0 then 'none' when n < 3 then 'low' when n < 10 then 'medium' else 'high' end as comp from m)"""


@query("a30_detect_opportunities", f"""with {OPPORTUNITY} select id, platform, title, price as price_abroad, {R('ap', 4)} as price_home_avg, category_l1 as category, sales_30d, rv as review_count, {R('gap', 2)} as velocity_gap, {R('mg', 1)} as margin_pct, {R('dm', 2)} as demand_signal,
    comp as competition, {R('sc', 1)} as composite_score, coalesce(nullif(concat_ws(' | ', case when sales_30d > 50 then concat('Alta demanda (', sales_30d, ' vendas/mês)') when sales_30d > 10 then concat('Demanda moderada (', sales_30d, ' vendas/mês)') end,
      case when rv > 20 then concat('Boa reputação (', rv, ' avaliações)') end, case when n = 0 then 'Sem concorrentes no ML' when comp = 'low' then 'Pouca concorrência no ML' end,
      case when round(mg) > 50 then concat('Alta margem estimada (', round(mg)::int, '%)') when round(mg) > 20 then concat('Margem moderada (', round(mg)::int, '%)') end), ''), 'Oportunidade identificada') as reasoning
from opportunity where sc >= -300""")
def _(c):
    return r.detect_opportunities(reviewed(c), min_score=-300, n=150)


@query("a31_opportunity_scores", f"""with d as (select id, case when id % 5 = 0 then null else sales_30d * 1.0::double end as ml, case when id % 7 = 0 then null else (id % 90) * 1.0::double end as cn, (id % 83) * 1.0::double as mg, (id % 13) / 10.0::double as dm from products),
g as (select *, coalesce(ml, 0) / greatest(coalesce(cn, 0), 1) as gap from d), b as (select min(gap) as g0, max(gap) as g1, min(mg) as m0, max(mg) as m1, min(dm) as d0, max(dm) as d1 from g)
select id, {R('gap', 6)} as velocity_gap, case when coalesce(ml, 0) <= 0 then 'china_bestseller_no_ml' when coalesce(cn, 0) <= 0 then 'ml_bestseller_no_china' else 'high_velocity_gap' end as opportunity_type,
    {R('(gap - g0) / (g1 - g0) * ((mg - m0) / (m1 - m0)) * ((dm - d0) / (d1 - d0)) * 100', 4)} as score from g, b""")
def _(c):
    d = c.view("products").selectExpr("id", "case when id % 5 = 0 then null else double(sales_30d) end as ml_sales_velocity", "case when id % 7 = 0 then null else double(id % 90) end as china_sales_velocity",
                                      "double(id % 83) as margin_pct", "(id % 13) / 10D as demand_signal")
    return r.opportunity_scores(d).select("id", "velocity_gap", "opportunity_type", "score")


def merged(c):
    return merge_catalogues(*lst.merged(c))


@query("a33_product_stats", f"""with {lst.MERGED} select count(*) as total, {R('avg(price)', 4)} as avg_price, count(title_pt) as with_pt, {R('avg(cast(sales as double)) filter (where cast(sales as double) > 0)', 4)} as avg_sales,
    count(distinct category_label) as distinct_categories, count(*) filter (where source = 'ranked') as source_ranked, count(*) filter (where source = 'bestseller') as source_bestseller, count(*) filter (where source = 'factory') as source_factory,
    count(*) filter (where enrichment_status = 'complete') as enrichment_complete, count(*) filter (where enrichment_status = 'partial') as enrichment_partial, count(*) filter (where enrichment_status = 'none') as enrichment_none from merged""")
def _(c):
    return r.product_stats(merged(c))


@query("a33_top_values", f"""with {lst.MERGED}, n as (select 'category_label' as field, category_label as value, count(*) as count from merged group by 2 union all select 'title', title, count(*) from merged group by 2)
select field, value, count, rank from (select *, cast(row_number() over (partition by field order by count desc, value) as int) as rank from n) where rank <= 8""")
def _(c):
    return r.top_values(merged(c), ["category_label", "title"])


QUART = """q as (select p[len(p) // 4 + 1] as q1, p[len(p) // 2 + 1] as median, p[len(p) * 3 // 4 + 1] as q3, p[len(p)] as max from (select list_sort(list(price_min)) as p from listing_products where price_min > 0))"""


@query("a34_price_quartiles", f"with {QUART} select q1, median, q3, max from q")
def _(c):
    return r.price_quartiles(c.view("listing_products"), "price_min")


FMT = "case when {0} >= 1000 then concat(format('{{:.1f}}', round({0} / 1000::double, 1)), 'k') else cast(cast(floor({0} + 0.5) as bigint) as varchar) end"


@query("a34_price_bands", f"""with {QUART}, f as (select *, {FMT.format('q1')} as f1, {FMT.format('median')} as f2, {FMT.format('q3')} as f3, {FMT.format('max')} as f4 from q)
select band::int as band, case band when 1 then concat('< ¥', f1) when 2 then concat('¥', f1, ' – ¥', f2) when 3 then concat('¥', f2, ' – ¥', f3) when 4 then concat('¥', f3, ' – ¥', f4) else concat('> ¥', f4) end as label,
    (select count(*) from listing_products where price_min > 0 and case band when 1 then price_min < q1 when 2 then price_min >= q1 and price_min < median when 3 then price_min >= median and price_min < q3 when 4 then price_min >= q3 and price_min < max else price_min >= max end) as count
from (select *, unnest([1, 2, 3, 4, 5]) as band from f)""")
def _(c):
    return r.price_bands(c.view("listing_products"), "price_min")


@query("a37_sales_gaps", "select platform, category_l1, count(*) as no_sales from products where id % 3 = 0 or sales_30d = 0 group by 1, 2")
def _(c):
    return r.sales_gaps(c.view("products").withColumn("sales_30d", F.expr("case when id % 6 = 0 then null when id % 3 = 0 then 0 else sales_30d end")))


@query("a40_distinct_values", "select distinct category_label as value from listing_products where run_kind = 'R' union select distinct title from listing_products where run_kind = 'R' union select 'static one' union select 'PROMO'")
def _(c):
    run = c.view("listing_products").where("run_kind = 'R'").withColumn("blank", F.lit(" "))
    return r.distinct_values(run, ["category_label", "title", "blank"], ["static one", "PROMO", ""])


@query("a41_refresh_mapping_counts", f"""with {MAPPINGS} select our_l1, our_l2, our_l3, platform, (select count(*) from products p where p.category_l1 = our_l1 and p.category_l2 = our_l2 and p.category_l3 = our_l3) as product_count, '2024-05-01' as last_scraped from mappings""")
def _(c):
    return r.refresh_mapping_counts(mappings(c), c.view("products"), F.lit("2024-05-01")).select("our_l1", "our_l2", "our_l3", "platform", "product_count", "last_scraped")


@query("a42_cluster_price_range", """with f as (select category_l2 as leader_id, platform, min(case when price > 950 then price end) as lo, max(case when price > 950 then price end) as hi, min(id) as first from products group by 1, 2)
select leader_id, min(lo) as min_price, max(hi) as max_price, string_agg(platform, ',' order by first) as platforms from f group by 1""")
def _(c):
    return r.cluster_price_range(c.view("products").selectExpr("id", "category_l2 as leader_id", "platform", "case when price > 950 then price else 0 end as price_brl"))


def reported(c):
    p = c.view("products").withColumns({"sales_total": F.expr("case when id % 2 = 0 then sales_30d * (id % 30 + 1) end"), "bsr_rank": F.expr("case when id % 3 > 0 then id * 11 end")})
    return r.product_report(p, matches(c))


@query("c09_product_report", f"""with {sim.BOTH}, near as (select b.from_id as id, p.* exclude (id), p.id as to_id, b.confidence from both_ways b join products p on p.id = b.to_id and p.is_active),
facts as (select id, count(distinct platform_id) as others, least(count(*), 10) as match_count, max(confidence) as best_confidence from near group by 1),
o as (select s.id, s.price as sp, case when s.currency = 'CNY' then s.price * 0.14::double else s.price end as usd, n.platform as plat, n.price as np, n.currency as cur, n.confidence, n.to_id, t.q, t.f
      from products s join near n on n.id = s.id and n.platform <> s.platform and n.price > 0 cross join (values (50, 3.5::double), (200, 3.0::double)) t(q, f) where s.price > 0),
mg as (select *, np * (1 - case plat when 'ml' then 0.16::double when 'amazon_br' then 0.15::double when 'amazon_us' then 0.15::double else 0.12::double end) as net, usd * f * case when cur = 'BRL' then 5.6::double else 1 end as landed from o),
mp as (select *, {R('(net - landed) / net * 100', 1)} as pct from mg),
best as (select id, arg_max(struct_pack(pct, plat, q), (pct, -q, confidence, -to_id)) as b, count(*) as margin_count from mp group by 1),
j as (select p.id, coalesce(others, 0) + 1 as seller_count, coalesce(match_count, 0) as match_count, best_confidence, coalesce(b.pct, 0) as best_margin, coalesce(b.plat, '') as best_platform, coalesce(b.q, 0) as best_quantity, coalesce(margin_count, 0) as margin_count,
      sales_30d, case when p.id % 2 = 0 then sales_30d * (p.id % 30 + 1) end as st, case when p.id % 3 > 0 then p.id * 11 end as bsr from products p left join facts f on f.id = p.id left join best on best.id = p.id),
v as (select *, case when sales_30d > 0 and st > 0 then case when sales_30d / st::double > 0.3 then 'hot' when sales_30d / st::double > 0.15 then 'warm' when sales_30d / st::double > 0.05 then 'cool' else 'dead' end
      when coalesce(bsr, 0) <> 0 then case when bsr < 1000 then 'hot' when bsr < 10000 then 'warm' else 'cool' end else 'warm' end as velocity,
      case when seller_count <= 3 then 'low' when seller_count <= 10 then 'medium' when seller_count <= 25 then 'high' else 'saturated' end as competition from j),
s as (select *, case when best_margin > 60 then 3 when best_margin > 50 then 2 when best_margin > 30 then 1 when best_margin > 0 then -1 else -3 end
      + case when match_count > 0 and best_confidence > 0.9 then 2 when match_count > 0 and best_confidence > 0.7 then 1 else 0 end + case velocity when 'hot' then 2 when 'warm' then 1 when 'cool' then -1 else -3 end
      + case competition when 'low' then 2 when 'medium' then 1 when 'high' then -1 else -2 end as score from v)
select id, seller_count, match_count, best_confidence, best_margin, best_platform, best_quantity, margin_count, velocity, competition, score, case when score >= 6 then 'strong' when score >= 3 then 'moderate' when score >= 0 then 'weak' else 'avoid' end as rating from s""")
def _(c):
    return reported(c).select("id", "seller_count", "match_count", "best_confidence", "best_margin", "best_platform", "best_quantity", "margin_count", "velocity", "competition", "score", "rating")
