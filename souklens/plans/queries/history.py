"""Velocity, trends and price history over the snapshot views."""

from __future__ import annotations

from pyspark.sql import functions as F

from souklens.functions.numbers import round_half_up
from souklens.operators import history as h
from souklens.operators.edges import match_history
from souklens.plans.registry import matches, query, sql_round as R

VELOCITY = f"""
ranked as (
    select offer_id, sales_volume_estimate as current_sales, scraped_at as latest_scrape, row_number() over newest as rn,
           lead(sales_volume_estimate) over newest as previous_sales, lead(scraped_at) over newest as previous_scrape
    from product_snapshots where sales_volume_estimate is not null window newest as (partition by offer_id order by scraped_at desc)),
velocity as (
    select offer_id, current_sales, previous_sales, latest_scrape, previous_scrape, current_sales - coalesce(previous_sales, 0) as sales_delta,
           cast(date_sub('day', previous_scrape, latest_scrape) as int) as days_between,
           case when previous_sales is not null and date_sub('day', previous_scrape, latest_scrape) > 0
                then {R("(current_sales - previous_sales) * 1.0::double / date_sub('day', previous_scrape, latest_scrape)", 1)}
           end as daily_velocity
    from ranked where rn = 1)
"""


def velocity(c):
    return h.product_velocity(c.view("product_snapshots"))


@query("w01_product_velocity", f"""with {VELOCITY}
select offer_id, current_sales, previous_sales, strftime(latest_scrape, '%Y-%m-%d') as latest_scrape,
       strftime(previous_scrape, '%Y-%m-%d') as previous_scrape, sales_delta, days_between, daily_velocity
from velocity""")
def _(c):
    return velocity(c).withColumns({
        k: F.date_format(k, "yyyy-MM-dd") for k in ("latest_scrape", "previous_scrape")})


TREND = f"""with {VELOCITY}
select v.offer_id, row_id, title, category_label, current_sales, previous_sales, sales_delta, daily_velocity,
       {R("daily_velocity * 7", 1)} as weekly_velocity, days_between, price_min, repurchase_rate, supplier_name
from velocity v join listing_products lp on lp.offer_id = v.offer_id
where daily_velocity is not null %s order by abs(daily_velocity) desc, v.offer_id, row_id limit %d"""


@query("j16_trending", TREND % ("", 50))
def _(c):
    return h.trending(velocity(c), c.view("listing_products"), n=50)


@query("j16_trending_up", TREND % ("and daily_velocity > 0", 20))
def _(c):
    return h.trending(velocity(c), c.view("listing_products"), "up", 20)


@query("j16_trending_down", TREND % ("and daily_velocity < 0", 20))
def _(c):
    return h.trending(velocity(c), c.view("listing_products"), "down", 20)


@query("j15_attach_velocity", f"""with {VELOCITY}
select p.id, title, daily_velocity, cast(floor(daily_velocity * 7 + 0.5) as bigint) as weekly_velocity, sales_delta
from products p left join velocity v on v.offer_id = p.id""")
def _(c):
    return h.attach_velocity(c.view("products").select("id", "title"), velocity(c))


@query("a08_velocity_summary", f"""with {VELOCITY}
select count(*) > 0 as has_velocity_data, count(*) as unique_products_with_velocity,
       count(*) filter (where daily_velocity > 0) as products_trending_up,
       count(*) filter (where daily_velocity < 0) as products_trending_down,
       {R("avg(daily_velocity)", 1)} as avg_daily_velocity, cast(sum(sales_delta) as bigint) as total_sales_delta,
       (select count(*) from product_snapshots) as total_snapshots,
       (select strftime(max(scraped_at), '%Y-%m-%d %H:%M:%S') from product_snapshots) as latest_scrape_date,
       (select count(distinct scraped_at::date) from product_snapshots) as unique_snapshot_dates
from velocity where daily_velocity is not null""")
def _(c):
    return h.velocity_summary(velocity(c), c.view("product_snapshots"))


@query("a08_snapshot_dates", """
select strftime(scraped_at, '%Y-%m-%d') as snap_date, count(distinct offer_id) as product_count
from product_snapshots group by 1""")
def _(c):
    return h.snapshot_dates(c.view("product_snapshots"))


@query("a09_velocity_time_stats", f"""with {VELOCITY},
dates as (select distinct scraped_at::date as d from product_snapshots order by d desc limit 2)
select count(*) as products_with_velocity, count(*) filter (where daily_velocity > 0) as products_gaining,
       count(*) filter (where daily_velocity = 0) as products_stable,
       count(*) filter (where daily_velocity < 0) as products_declining,
       {R("avg(daily_velocity * 7)", 0)} as avg_weekly_velocity,
       {R("sum(daily_velocity * 7)", 1)} as estimated_weekly_sales,
       (select strftime(max(d), '%Y-%m-%d') from dates) as latest_snapshot_date,
       (select strftime(min(d), '%Y-%m-%d') from dates) as previous_snapshot_date,
       (select cast(date_diff('day', min(d), max(d)) as int) from dates) as snapshot_span_days
from velocity where daily_velocity is not null""")
def _(c):
    return h.velocity_time_stats(velocity(c), c.view("product_snapshots"))


@query("a12_velocity_context", f"""with {VELOCITY}
select (select count(*) from product_snapshots) as total_snapshots,
       (select count(distinct offer_id) from product_snapshots) as unique_products,
       (select strftime(max(scraped_at), '%Y-%m-%d %H:%M:%S') from product_snapshots) as latest_scrape_date,
       count(*) as products_with_velocity, count(*) > 0 as has_velocity_data
from velocity where daily_velocity is not null""")
def _(c):
    return h.velocity_context(velocity(c), c.view("product_snapshots"))


@query("a12_top_risers", f"""with {VELOCITY}
select v.offer_id, row_id, title, daily_velocity, sales_delta
from velocity v join listing_products lp on lp.offer_id = v.offer_id
where daily_velocity is not null and sales_delta > 0 order by daily_velocity desc, v.offer_id, row_id limit 5""")
def _(c):
    return h.top_risers(velocity(c), c.view("listing_products"))


@query("s11_daily_snapshot", """
select id as product_id, price, sales_30d, '2024-06-01' as recorded_at from products where is_active""")
def _(c):
    return h.daily_snapshot(c.view("products"), F.lit("2024-06-01"))


def searches(c):
    """Each listing as a hit of the search for its category on the day it shipped."""
    lines = c.table("lineitem").select("l_partkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_linenumber")
    hits = c.view("products").select("id", "platform", "title", "currency", "category_l2").join(
        lines, F.col("l_partkey") == F.col("id"))
    price = F.col("l_extendedprice") / F.col("l_quantity")
    hits = hits.select(
        "platform", F.concat(F.lit("https://shop.example/p/"), "id").alias("product_url"),
        F.col("title").alias("product_name"), price.alias("price_brl"), price.alias("price_low"),
        F.col("currency").alias("price_currency"), F.col("l_quantity").cast("bigint").alias("monthly_sales"),
        F.lit(None).cast("string").alias("image_url"), "category_l2", "l_shipdate",
    )
    return h.record_search(hits, F.col("category_l2"), F.col("l_shipdate"))


SEARCHES = """
searches as (
    select category_l2 as query, platform, concat('https://shop.example/p/', id) as product_id,
           substr(title, 1, 200) as product_name, l_extendedprice / l_quantity as price_brl,
           l_extendedprice / l_quantity as price_original, currency as price_currency,
           cast(l_quantity as bigint) as monthly_sales, '' as image_url,
           concat('https://shop.example/p/', id) as product_url, l_shipdate as scraped_at
    from products join lineitem on l_partkey = id)"""


@query("s12_record_search", f"with {SEARCHES} select * replace (strftime(scraped_at, '%Y-%m-%d') as scraped_at) from searches")
def _(c):
    return searches(c).withColumn("scraped_at", F.date_format("scraped_at", "yyyy-MM-dd"))


@query("a29_price_trends", f"""with {SEARCHES}
select strftime(scraped_at, '%Y-%m-%d') as date, platform, {R("avg(price_brl)", 2)} as avg_price,
       {R("min(price_brl)", 2)} as min_price, {R("max(price_brl)", 2)} as max_price, count(*) as product_count
from searches where scraped_at >= timestamp '2001-06-01' - interval 365 days group by 1, 2""")
def _(c):
    return h.price_trends(searches(c), F.lit("2001-06-01").cast("timestamp_ntz"), 365)


@query("a32_recent_queries", f"""with {SEARCHES}
select query, count(distinct platform) as platforms, count(*) as total_snapshots,
       strftime(max(scraped_at), '%Y-%m-%d') as last_searched
from searches group by query order by max(scraped_at) desc, query limit 20""")
def _(c):
    return h.recent_queries(searches(c)).withColumn("last_searched", F.date_format("last_searched", "yyyy-MM-dd"))


@query("w05_price_drops", f"""with four as (
    select * from (select *, row_number() over (partition by product_id
        order by recorded_at desc, l_orderkey desc, l_linenumber desc, price desc) as rn from price_history) where rn <= 4),
recent as (select product_id, max(price) filter (where rn = 1) as latest, avg(price) filter (where rn > 1) as before
           from four group by product_id having count(*) >= 2)
select match_id, substr(a.title, 1, 60) as amazon_title, substr(b.title, 1, 60) as other_title,
       b.platform as other_platform, {R("ra.latest - rb.latest", 4)} as latest_diff,
       {R("ra.before - rb.before", 2)} as prev_avg_diff,
       {R("ra.latest - rb.latest - (ra.before - rb.before)", 2)} as diff_change,
       case when ra.before - rb.before <> 0 then
            {R("(ra.latest - rb.latest - (ra.before - rb.before)) / (ra.before - rb.before) * 100", 2)}
            else 0.0::double end as pct_change, a.category_l1 as category, confidence
from matches m join products a on a.id = product_a_id join products b on b.id = product_b_id
join recent ra on ra.product_id = a.id join recent rb on rb.product_id = b.id
order by diff_change, match_id limit 20""")
def _(c):
    return h.price_drops(matches(c), c.view("products"), c.view("price_history"), 20, ("l_orderkey", "l_linenumber"))


@query("w06_price_series", """
select product_id, price, sales_30d, strftime(recorded_at, '%Y-%m-%d') as recorded_at, rn
from (select *, cast(row_number() over (partition by product_id
      order by recorded_at desc, l_orderkey desc, l_linenumber desc, price desc) as int) as rn from price_history) where rn <= 90""")
def _(c):
    order = [F.desc(k) for k in ("recorded_at", "l_orderkey", "l_linenumber", "price")]
    return h.price_series(c.view("price_history"), ["product_id"], order).select(
        "product_id", "price", "sales_30d", F.date_format("recorded_at", "yyyy-MM-dd").alias("recorded_at"), "rn")


@query("w06_price_span", """
select product_id, arg_min(price, (recorded_at, l_orderkey, l_linenumber, price)) as first_price,
       arg_max(price, (recorded_at, l_orderkey, l_linenumber, price)) as last_price, count(*) as points
from price_history group by product_id""")
def _(c):
    return h.price_span(c.view("price_history"), "product_id", F.struct("recorded_at", "l_orderkey", "l_linenumber", "price"))


@query("j17_match_history", """
select match_id, product_id, platform, ph.price, ph.sales_30d, strftime(recorded_at, '%Y-%m-%d') as recorded_at
from matches m join price_history ph on ph.product_id = m.product_a_id or ph.product_id = m.product_b_id
join products p on p.id = ph.product_id""")
def _(c):
    return match_history(matches(c), c.view("price_history"), c.view("products")).withColumn(
        "recorded_at", F.date_format("recorded_at", "yyyy-MM-dd"))


@query("p26_sales_velocity", """
select l_orderkey, l_linenumber,
       cast(l_quantity as double) / greatest(date_sub('day', l_shipdate, timestamp '2002-01-01'), 1) as sales_velocity
from lineitem""")
def _(c):
    from souklens.functions.scores import sales_velocity
    now = F.lit("2002-01-01").cast("timestamp_ntz")
    return c.table("lineitem").select("l_orderkey", "l_linenumber", sales_velocity("l_quantity", "l_shipdate", now).alias("sales_velocity"))


@query("p27_refresh_velocity", f"""
select p.id, {R("p.sales_30d * 1.0::double / greatest(date_sub('day', f.first_seen, timestamp '2002-01-01'), 1)", 6)} as sales_velocity
from products p left join (select offer_id, min(scraped_at) as first_seen from product_snapshots group by 1) f on f.offer_id = p.id""")
def _(c):
    from souklens.functions.scores import refresh_velocity
    seen = c.view("product_snapshots").groupBy("offer_id").agg(F.min("scraped_at").alias("first_seen"))
    p = c.view("products").select("id", "sales_30d").join(seen, F.col("offer_id") == F.col("id"), "left")
    fresh = refresh_velocity(p, F.lit("2002-01-01").cast("timestamp_ntz"), total="sales_30d", published="first_seen")
    return fresh.select("id", round_half_up("sales_velocity", 6).alias("sales_velocity"))
