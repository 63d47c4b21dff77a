"""Streams over the test tables, drained to the end, and the nightly jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from souklens.functions.numbers import round_half_up
from souklens.plans import composite
from souklens.plans.queries import categories as cat, reports as rep, similarity as sim
from souklens.plans.registry import TEST_THRESHOLD as T, query, sql_round as R
from souklens.session import scratch_path
from souklens.sources.edge_store import EdgeStore
from souklens.streaming import streams as st


def stream(c, table):
    return st.read_files(c.spark, c.path(table), c.table(table).schema)


def moment(name):
    return F.col(name).cast("timestamp")


@query("t01_dedup_requests_exact", """with recursive e as (select user_id, event_type, event_id, ts from events),
chain as (select user_id, event_type, min(ts) as ts from e group by 1, 2
    union all select c.user_id, c.event_type, (select min(e.ts) from e where e.user_id = c.user_id and e.event_type = c.event_type and e.ts >= c.ts + interval 1 hour) as ts from chain c where c.ts is not null)
select e.user_id, e.event_type, min(e.event_id) as event_id from e join chain c on c.user_id = e.user_id and c.event_type = e.event_type and c.ts = e.ts group by e.user_id, e.event_type, e.ts""")
def _(c):
    requests = stream(c, "events").select("user_id", "event_type", "event_id", moment("ts").alias("ts"))
    return st.dedup_requests_exact(requests, ["user_id", "event_type"], scratch_path(c.spark, "requests")).select("user_id", "event_type", "event_id")


@query("t01_dedup_requests", """select user_id, event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as slot, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first
    from events group by user_id, event_type, date_trunc('hour', ts)""")
def _(c):
    requests = stream(c, "events").select("user_id", "event_type", moment("ts").alias("ts"))
    first = st.dedup_requests(requests, ["user_id", "event_type"], scratch_path(c.spark, "first-requests"))
    return first.withColumn("slot", F.date_format("slot", "yyyy-MM-dd HH")).withColumn("first", F.date_format("first", "yyyy-MM-dd HH:mm:ss"))


def snapshots(c):
    return stream(c, "lineitem").select(F.col("l_partkey").alias("offer_id"), moment("l_shipdate").alias("scraped_at"),
                                        F.col("l_quantity").cast("long").alias("sales_volume_estimate"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price_brl"), "l_returnflag")


@query("t02_snapshot_stream", "select distinct l_partkey as offer_id, strftime(l_shipdate, '%Y-%m-%d') as scraped_at from lineitem")
def _(c):
    return st.snapshot_stream(snapshots(c), scratch_path(c.spark, "snapshots")).withColumn("scraped_at", F.date_format("scraped_at", "yyyy-MM-dd"))


@query("t03_velocity_stream", f"""with s as (select offer_id, t, q, row_number() over newest as rn, lead(t) over newest as pt, lead(q) over newest as pq
    from (select l_partkey as offer_id, l_shipdate as t, max(cast(l_quantity as bigint)) as q from lineitem group by 1, 2) window newest as (partition by offer_id order by t desc)),
v as (select offer_id, q as current_sales, pq as previous_sales, q - coalesce(pq, 0) as sales_delta, cast(date_diff('day', pt, t) as int) as days_between from s where rn = 1)
select *, case when days_between > 0 then {R("(current_sales - previous_sales) / days_between::double", 1)} end as daily_velocity from v""")
def _(c):
    return st.velocity_stream(snapshots(c), scratch_path(c.spark, "velocity")).drop("latest_scrape", "previous_scrape")


@query("t04_trend_stream", f"""select strftime(l_shipdate, '%Y-%m-%d') as date, l_returnflag as platform, {R('avg(l_extendedprice / l_quantity)', 4)} as avg_price, min(l_extendedprice / l_quantity) as min_price,
    max(l_extendedprice / l_quantity) as max_price, count(*) as product_count from lineitem group by 1, 2""")
def _(c):
    days = st.trend_stream(snapshots(c).withColumnRenamed("l_returnflag", "platform"), scratch_path(c.spark, "trend"))
    return days.withColumn("avg_price", round_half_up("avg_price", 4))


@query("t05_alert_stream", """select event_id, alert_id, user_id as product_id, value as price, target_price from events join (select c_custkey as alert_id, c_custkey as product_id, abs(c_acctbal) / 100 as target_price
    from customer where c_custkey % 3 > 0) on product_id = user_id where value <= target_price""")
def _(c):
    prices = stream(c, "events").selectExpr("event_id", "user_id as product_id", "value as price")
    alerts = c.table("customer").selectExpr("c_custkey as alert_id", "c_custkey as product_id", "abs(c_acctbal) / 100 as target_price", "c_custkey % 3 > 0 as is_active")
    return st.drain(st.alert_stream(prices, alerts), "alerts")


@query("t06_match_stream", f"""with p as (select a.vec_id as product_a_id, b.vec_id as product_b_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as confidence from embeddings a join embeddings b on a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by product_a_id order by confidence desc, product_b_id) as rn from p) select product_a_id, product_b_id, confidence from r where rn <= 5 and confidence > {T}""")
def _(c):
    base = c.table("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    arriving = stream(c, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return st.match_stream(arriving, base, scratch_path(c.spark, "edges"), threshold=T)()


@query("c07_nightly_catalogue", f"""{sim.TIERED_PICKED}, final as (select * from picked where pick = 1), {rep.MAPPINGS},
h as (select category_l1 as l1, category_l2 as l2, category_l3 as l3, count(*) as matches from final join products on id = left_id group by 1, 2, 3),
n as (select category_l1 as l1, category_l2 as l2, category_l3 as l3, count(*) filter (where platform in ('amazon_br', 'amazon_us')) as amazon, count(*) filter (where platform = 'ml') as ml from products group by 1, 2, 3),
m as (select our_l1 as l1, our_l2 as l2, our_l3 as l3, count(distinct platform) as pc from mappings group by 1, 2, 3),
s as (select case when amazon > 0 and ml > 0 then coalesce(matches, 0) * 100 / least(amazon, ml)::double end as rate, pc from m join n using (l1, l2, l3) left join h using (l1, l2, l3))
select count(*) filter (where is_active) as products, count(embedding) as embedded, (select count(*) from final) as matches, (select count(*) from mappings) as categories,
    (select count(*) from s where rate >= 20 and (rate >= 50 or pc >= 3)) as healthy_mappings, count(*) filter (where is_active) as snapshots from products""")
def _(c):
    return composite.nightly_catalogue(c.view("products"), rep.mappings(c), F.lit("2024-06-01"), threshold=T)["summary"]


@query("c07_match_nights", f"""{sim.TIERED_PICKED}, final as (select * from picked where pick = 1)
select category_l1, product_a_id, product_b_id, confidence from (select p.category_l1, left_id as product_a_id, right_id as product_b_id,
    case when tier = 'medium' then greatest(0, round(similarity - 0.03, 6)) else similarity end as confidence, similarity from final join products p on p.id = left_id)
where category_l1 in (select category_l1 from products where is_active and embedding is not null and platform = 'ml') and category_l1 <> 'L3'""")
def _(c):
    store = EdgeStore(c.spark, scratch_path(c.spark, "edges"))
    p = c.view("products")
    composite.match_night(p, store, 1, threshold=0.9)  # all are replaced by the second night, and that one is repeated
    for _ in range(2):
        composite.match_night(p, store, 2, threshold=T)
    composite.match_night(p, store, 3, threshold=2.0, only=["L3"])  # no edge is left in this one
    return store.read().select("category_l1", "product_a_id", "product_b_id", "confidence")


@query("c08_nightly_edges", f"""with {sim.REFRESHED}, {rep.OPPORTUNITY}, {cat.TAX}, {cat.CARRIED}, {cat.COUNTED}
select (select count(*) from refreshed) as edges, (select count(*) from refreshed where created_at = '2024-03-10') as refreshed, (select count(*) from opportunity where sc >= -300) as opportunities,
    count(*) as slugs, sum(product_count)::bigint as placements from counted""")
def _(c):
    now = F.lit("2024-03-10").cast("timestamp_ntz")
    return composite.nightly_edges(rep.reviewed(c), sim.aged(c), cat.tax(c), cat.carried(c), now, threshold=T, min_score=-300, n=150)["summary"]
