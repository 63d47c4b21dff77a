"""Vector search, matching, hashing and clustering over the products view."""

from __future__ import annotations

from pyspark.sql import functions as F

from souklens.functions import vectors as v
from souklens.operators import clusters as cl, edges as e, hashes as h, similarity as s
from souklens.operators.vector_index import VectorIndex
from souklens.plans.registry import TEST_THRESHOLD as T, matches, query, sql_round as R
from souklens.session import checkpointed, dealt, scratch_path

COS = "round(list_cosine_similarity({a}.embedding::double[], {b}.embedding::double[]), 6)"
SIM = COS.format(a="a", b="b")
READY = "ready as (select * from products where is_active and embedding is not null)"


def ready(c):
    return c.view("products").where(F.col("is_active") & F.col("embedding").isNotNull())


def sides(c):
    p = ready(c)
    return p.where(F.col("platform") == "amazon_br"), p.where(F.col("platform") == "ml")


@query("p40_cosine", """
select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as similarity
from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def _(c):
    e1 = c.table("embeddings").select("vec_id", F.col("embedding").alias("x"))
    e2 = c.table("embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    return e1.join(e2, "vec_id").select("vec_id", v.cosine("x", "y").alias("similarity"))


KNN = """with {ready}, pairs as (
    select a.id as left_id, b.id as right_id, {sim} as similarity from ready a join ready b on {cond}),
ranked as (select *, cast(row_number() over (partition by left_id order by similarity desc, right_id) as int) as rank from pairs)
select left_id, right_id, similarity, rank from ranked where rank <= {k}"""


@query("j08_knn", KNN.format(ready=READY, sim=SIM, cond="a.id <> b.id", k=10))
def _(c):
    return s.knn(ready(c), ready(c), 10)


@query("j08_knn_other_platform", KNN.format(ready=READY, sim=SIM, cond="a.platform <> b.platform", k=10))
def _(c):
    return s.knn(ready(c), ready(c), 10, other_platform=True)


@query("j08_knn_same_category", KNN.format(ready=READY, sim=SIM, cond="a.id <> b.id and a.category_l1 = b.category_l1", k=8))
def _(c):
    return s.knn(ready(c), ready(c), 8, block="category_l1")


@query("j08_knn_index", KNN.format(ready=READY, sim=SIM, cond="a.id <> b.id", k=10))
def _(c):
    index = VectorIndex.build(ready(c), scratch_path(c.spark, "index"))
    return index.search(ready(c), 10, probes=None)


BLOCKED = """with {ready}, best as (
    select a.id as left_id, b.id as right_id, {sim} as similarity,
           row_number() over (partition by a.id order by {sim} desc, b.id) as rn
    from ready a join ready b on a.category_l1 = b.category_l1 {more}
    where a.platform = 'amazon_br' and b.platform = '{other}' and {sim} >= {t}),
ranked as (select *, row_number() over (partition by right_id order by similarity desc, left_id) as pick from best where rn = 1)
select left_id, right_id, similarity from ranked where pick = 1"""


@query("j09_match_blocked", BLOCKED.format(ready=READY, sim=SIM, t=T, more="", other="ml"))
def _(c):
    return e.match_blocked(*sides(c), block=["category_l1"], threshold=T)


@query("j09_match_blocked_l3", BLOCKED.format(ready=READY, sim=SIM, t=0.05, more="and a.category_l3 = b.category_l3", other="amazon_us"))
def _(c):
    p = ready(c)
    return e.match_blocked(p.where(F.col("platform") == "amazon_br"), p.where(F.col("platform") == "amazon_us"),
                           block=["category_l1", "category_l3"], threshold=0.05)


TIERED = f"""with {READY}, pairs as (
    select a.id as left_id, b.id as right_id, {SIM} as similarity,
           case when a.category_l2 = b.category_l2 and a.category_l3 = b.category_l3 and a.category_l3 <> 'Geral' then 0
                when a.category_l2 = b.category_l2 then 1 else 2 end as tier_rank
    from ready a join ready b on a.category_l1 = b.category_l1
    where a.platform = 'amazon_br' and b.platform = 'ml' and {SIM} >= {T}),
best as (select * from (select *, row_number() over (partition by left_id order by tier_rank, similarity desc, right_id) as rn
         from pairs) where rn = 1),
named as (select left_id, right_id, similarity, ['strict', 'medium', 'broad'][tier_rank + 1] as tier from best)"""


@query("w03_best_by_tier", TIERED + " select * from named")
def _(c):
    return e.best_by_tier(e.match_candidates(*sides(c), threshold=T))


TIERED_PICKED = TIERED + """, picked as (
    select *, row_number() over (partition by right_id order by similarity desc, left_id) as pick from named)"""
TIERED_FINAL = TIERED_PICKED + """
select left_id, right_id, similarity, tier,
       case when tier = 'medium' then greatest(0.0::double, round(similarity - 0.03::double, 6)) else similarity end as confidence
from picked where pick = 1"""


@query("j10_match_tiered", TIERED_FINAL)
def _(c):
    return e.match_tiered(*sides(c), threshold=T)


@query("w04_one_to_one", TIERED_PICKED + " select left_id, right_id, similarity, tier from picked where pick = 1")
def _(c):
    return e.one_to_one(e.best_by_tier(e.match_candidates(*sides(c), threshold=T)))


AGED = "aged as (select *, timestamp '2024-03-01' + to_days(cast(product_a_id % 14 as int)) as created_at from matches)"


def aged(c):
    at = F.lit("2024-03-01").cast("timestamp_ntz") + F.make_dt_interval((F.col("product_a_id") % 14).cast("int"))
    return matches(c).drop("match_id").withColumn("created_at", at)


REFRESHED = f"""{READY}, {AGED},
due as (select * from ready r where not exists (select 1 from aged m where m.product_a_id = r.id
        and m.created_at > timestamp '2024-03-10' - interval 7 days)),
near as (select a.id as product_a_id, b.id as product_b_id, {SIM} as confidence,
                row_number() over (partition by a.id order by {SIM} desc, b.id) as rn
         from due a join ready b on a.id <> b.id),
fresh as (select * from near where rn <= 5 and confidence > {T}),
refreshed as (select coalesce(f.product_a_id, m.product_a_id) as product_a_id, coalesce(f.product_b_id, m.product_b_id) as product_b_id,
       coalesce(f.confidence, m.confidence) as confidence,
       case when m.product_a_id is not null then m.match_method else 'clip_v1' end as match_method,
       strftime(case when f.product_a_id is not null then timestamp '2024-03-10' else m.created_at end, '%Y-%m-%d') as created_at
from aged m full join fresh f on f.product_a_id = m.product_a_id and f.product_b_id = m.product_b_id)"""


@query("j11_refresh_matches", f"with {REFRESHED} select * from refreshed")
def _(c):
    now = F.lit("2024-03-10").cast("timestamp_ntz")
    return e.refresh_matches(c.view("products"), aged(c), now, threshold=T).withColumn(
        "created_at", F.date_format("created_at", "yyyy-MM-dd"))


@query("j11_refresh_from_tiles", f"with {REFRESHED} select * from refreshed")
def _(c):
    now = F.lit("2024-03-10").cast("timestamp_ntz")
    tiles = checkpointed(s.packed_tiles(ready(c)))  # kept from night to night
    return e.refresh_matches(c.view("products"), aged(c), now, threshold=T, kept=tiles).withColumn(
        "created_at", F.date_format("created_at", "yyyy-MM-dd"))


@query("j20_similar_with_fallback", f"""with emb as (select * from products where embedding is not null),
counted as (select category_l1, count(*) as members from products group by 1),
pairs as (select a.id as left_id, b.id as right_id, b.category_l1 as category, {SIM} as sim,
                 a.category_l1 = b.category_l1 as same
          from emb a join counted using (category_l1) join emb b on a.id <> b.id
          where members - 1 < 5 or a.category_l1 = b.category_l1),
scored as (select *, {R("(sim + case when same then 0.05::double else 0 end) * 0.7::double * 100", 1)} as score from pairs),
ranked as (select *, cast(row_number() over (partition by left_id order by score desc, sim desc, right_id) as int) as rank from scored)
select left_id, right_id, category, {R("sim", 4)} as similarity, score, rank from ranked where rank <= 5""")
def _(c):
    return s.knn_with_fallback(c.view("products"), 5, category="category_l1")


PROTO = """cells as (
    select category_l1 as id, pos, avg(embedding[pos]::double) as m, count(*) as n
    from (select category_l1, embedding, unnest(generate_series(1, len(embedding))) as pos
          from products where embedding is not null) group by 1, 2),
lengths as (select id, sqrt(sum(m * m)) as size, max(n) as members from cells group by id having max(n) >= 3),
proto as (select id, members, list(m / size order by pos) as embedding from cells join lengths using (id) group by id, members)"""


@query("a28_prototypes", f"""with {PROTO}
select id as category, members, pos, round(embedding[pos], 6) as value
from (select id, members, embedding, unnest(generate_series(1, len(embedding))) as pos from proto)""")
def _(c):
    p = s.prototypes(c.view("products"))
    return p.select(F.col("id").alias("category"), "members", F.posexplode("embedding").alias("p", "x")).select(
        "category", "members", (F.col("p") + 1).cast("bigint").alias("pos"), F.round("x", 6).alias("value"))


@query("j22_prototype_audit", f"""with {PROTO},
emb as (select * from products where embedding is not null and category_l1 in (select id from proto)),
sims as (select cast(a.id as varchar) as id, a.category_l1 as actual, b.id as predicted,
                round(list_cosine_similarity(a.embedding::double[], b.embedding::float[]::double[]), 6) as sim
         from emb a cross join proto b)
select id, actual, arg_min(predicted, (-sim, predicted)) as predicted, max(sim) as sim_predicted,
       max(sim) filter (where actual = predicted) as sim_actual,
       arg_min(predicted, (-sim, predicted)) = actual as correct
from sims group by id, actual""")
def _(c):
    return s.prototype_audit(c.view("products"))


@query("j23_zero_shot", """with labels as (select cast(label as varchar) as id, arg_min(embedding, vec_id) as embedding from embeddings group by label),
sims as (select cast(a.id as varchar) as id, b.id as label,
                round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as sim
         from (select * from products where embedding is not null) a cross join labels b),
best as (select id, arg_min(label, (-sim, label)) as label, max(sim) as confidence from sims where sim >= 0.2 group by id)
select cast(p.id as varchar) as id, title, label, confidence from products p left join best on best.id = cast(p.id as varchar)""")
def _(c):
    labels = c.table("embeddings").groupBy(F.col("label").alias("id")).agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return s.zero_shot(c.view("products").select("id", "title", "embedding"), labels, 0.20, max_labels=20)


BITS = """grid as (select vec_id as id, embedding, list_sort(embedding)[len(embedding) // 2 + 1] as median from embeddings),
hashed as (select id, list_transform(embedding, lambda x: case when x > median then 1 else 0 end) as bits from grid)"""


def hashed(c):
    return c.table("embeddings").select(F.col("vec_id").alias("id"), v.phash_bits("embedding").alias("bits"))


@query("p37_phash_bits", f"with {BITS} select id, array_to_string(bits, '') as bits from hashed")
def _(c):
    return hashed(c).select("id", v.bits_to_text("bits").alias("bits"))


@query("p37_dhash_bits", """
select vec_id as id, string_agg(case when embedding[pos] > embedding[pos + 1] then '1' else '0' end, '' order by pos) as bits
from (select *, unnest(generate_series(1, 64)) as pos from embeddings) where pos % 8 <> 0 group by vec_id""")
def _(c):
    return c.table("embeddings").select(F.col("vec_id").alias("id"), v.bits_to_text(v.dhash_bits("embedding", 8)).alias("bits"))


REGIONS = """px as (select vec_id as id, pos - 1 as i, embedding[pos] as x from (select *, unnest(generate_series(1, 64)) as pos from embeddings)),
cellpx as (select id, ((i // 8) // 4) * 2 + (i % 8) // 4 as region, i, x from px),
med as (select id, region, list(x order by x)[9] as median from cellpx group by 1, 2),
regions as (select id, region, string_agg(case when x > median then '1' else '0' end, '' order by i) as bits
            from cellpx join med using (id, region) group by 1, 2)"""


@query("p38_phash_regions", f"with {REGIONS} select id, string_agg(bits, ',' order by region) as regions from regions group by id")
def _(c):
    r = v.phash_regions("embedding", 8)
    return c.table("embeddings").select(
        F.col("vec_id").alias("id"), F.array_join(F.transform(r, v.bits_to_text), ",").alias("regions"))


@query("j21_hamming_join", f"""with {BITS}
select a.id as left_id, b.id as right_id, cast(list_sum(list_transform(list_zip(a.bits, b.bits), lambda z: case when z[1] <> z[2] then 1 else 0 end)) as int) as distance,
       {R("(1 - list_sum(list_transform(list_zip(a.bits, b.bits), lambda z: case when z[1] <> z[2] then 1 else 0 end)) / 64.0::double) * 100", 1)} as similarity_percent
from hashed a join hashed b on a.id < b.id
where list_sum(list_transform(list_zip(a.bits, b.bits), lambda z: case when z[1] <> z[2] then 1 else 0 end)) <= 20""")
def _(c):
    return s.hamming_join(hashed(c), hashed(c), 20, ordered=True)


# Images of 16 x 16 pixels: rows come in families of five that share the first one's vector, laid out four times with alternating sign, and
# every row has a few pixels of its own turned over. In every third family the last two rows are equal copies.
IMAGES = """base as (select e.vec_id as id, b.embedding as px, case when e.vec_id % 15 = 4 then e.vec_id - 1 else e.vec_id end as own
    from embeddings e join embeddings b on b.vec_id = e.vec_id - e.vec_id % 5),
grid256 as (select id, [px[k % 64 + 1] * (case when (k // 64) % 2 = 1 then -1 else 1 end) * (case when (k * 7 + own * 13) % 41 = 0 then -1 else 1 end) for k in range(256)] as pixels from base),
med256 as (select id, pixels, list_sort(pixels)[129] as median from grid256),
images as (select id, [case when x > median then 1 else 0 end for x in pixels] as bits from med256),
apart as (select a.id as left_id, b.id as right_id, length(replace(array_to_string([a.bits[k] <> b.bits[k] for k in range(1, 257)], ''), 'false', '')) // 4 as distance
    from images a join images b on a.id < b.id)"""


def images(c):
    e = c.table("embeddings")
    own = F.when(F.col("vec_id") % 15 == 4, F.col("vec_id") - 1).otherwise(F.col("vec_id"))
    rows = e.select(F.col("vec_id").alias("id"), own.alias("own"), (F.col("vec_id") - F.col("vec_id") % 5).alias("base"))
    # The pixels are most of the work, and a join of tables that are small in bytes leaves them to few tasks.
    with_base = dealt(rows.join(e.select(F.col("vec_id").alias("base"), F.col("embedding").alias("px")), "base"), "id")

    def pixel(k):
        turned = lambda odd: F.when(odd, -1).otherwise(1)
        return F.get("px", k % 64) * turned(F.floor(k / 64) % 2 == 1) * turned((k * 7 + F.col("own") * 13) % 41 == 0)

    pixels = with_base.select("id", F.transform(F.sequence(F.lit(0), F.lit(255)), pixel).alias("pixels"))
    return pixels.select("id", v.phash_bits("pixels").alias("bits"))


@query("j21_hamming_join_256", f"""with {IMAGES}
select left_id, right_id, cast(distance as int) as distance, {R("(1 - distance / 256.0::double) * 100", 1)} as similarity_percent from apart where distance <= 20""")
def _(c):
    rows = images(c)
    return s.hamming_join(rows, rows, 20, width=256, ordered=True)


@query("j21_hash_links", f"""with {IMAGES},
named as (select id, min(id) over (partition by bits) as class, count(*) over (partition by bits) as copies from images)
select left_id, right_id, cast(distance as int) as distance, {R("(1 - distance / 256.0::double) * 100", 1)} as similarity_percent, l.copies as left_copies, r.copies as right_copies
from apart join named l on l.id = left_id and l.class = l.id join named r on r.id = right_id and r.class = r.id where distance between 1 and 20""")
def _(c):
    return h.hash_links(images(c), 20)


@query("j21_region_similarity", f"""with {REGIONS}
select a.id, {R("avg(1 - hamming(a.bits, b.bits) / 256.0::double)", 6)} as similarity
from regions a join regions b on b.id = a.id + 1 and a.region = b.region group by a.id""")
def _(c):
    r = c.table("embeddings").select(F.col("vec_id").alias("id"), v.phash_regions("embedding", 8).alias("x"))
    after = r.select((F.col("id") - 1).alias("id"), F.col("x").alias("y"))
    from souklens.functions.numbers import round_half_up
    return r.join(after, "id").select("id", round_half_up(v.regions_similarity("x", "y"), 6).alias("similarity"))


CLUSTERS = f"""with recursive {READY},
numbered as (select row_number() over (order by id) as i, id, embedding from ready),
nb as (select b.i, b.id, coalesce(list(a.id order by a.id) filter (where a.id is not null and {SIM} >= 0.25), []) as smaller
       from numbered b left join numbered a on a.i < b.i group by b.i, b.id),
scan(i, leaders) as (
    select 0::bigint, []::bigint[]
    union all
    select nb.i, case when len(list_intersect(scan.leaders, nb.smaller)) > 0 then scan.leaders else list_append(scan.leaders, nb.id) end
    from scan join nb on nb.i = scan.i + 1),
final as (select leaders from scan order by i desc limit 1),
assigned as (select id, coalesce(list_min(list_intersect(leaders, smaller)), id) as leader_id from nb cross join final),
sizes as (select leader_id, count(*) as size from assigned group by 1 having count(*) >= 2),
clusters as (select id, leader_id, size from assigned join sizes using (leader_id))"""


def clusters(c):
    return cl.leader_clusters(ready(c), 0.25)


@query("c05_leader_clusters", CLUSTERS + " select id, leader_id, size from clusters")
def _(c):
    return clusters(c)


@query("c06_name_clusters", CLUSTERS + """, words as (
    select leader_id, id, pos, string_split_regex(lower(title), '\\s+')[pos] as word
    from (select *, unnest(generate_series(1, len(string_split_regex(lower(title), '\\s+')))) as pos from clusters join products using (id))),
freq as (select leader_id, word, count(*) as n, min((id, pos)) as first from words
         where length(word) > 2 and word not in ('de','para','com','em','o','a','os','as','um','uma','the','and','for','with','in','is','it','to','of') group by 1, 2),
top as (select *, row_number() over (partition by leader_id order by n desc, first) as rn from freq)
select leader_id, any_value(size) as size,
       (select string_agg(word, ' ' order by rn) from top t where t.leader_id = clusters.leader_id and rn <= 3) as suggested_name,
       string_agg(distinct concat_ws('/', category_l1, category_l2, category_l3), ', '
                  order by concat_ws('/', category_l1, category_l2, category_l3)) as categories
from clusters join products using (id) group by leader_id""")
def _(c):
    return cl.name_clusters(clusters(c), c.view("products"))


PAIR = """from matches m join products a on a.id = m.product_a_id join products b on b.id = m.product_b_id"""
MARGIN = lambda d: f"case when b.price > 0 then {R('(a.price - b.price) / b.price * 100', d)} else 0.0::double end"
LIST = f"""select match_id, confidence, match_method, product_a_id, product_b_id,
       a.id as a_id, a.platform as a_platform, a.platform_id as a_platform_id, a.title as a_title, a.price as a_price,
       a.sales_30d as a_sales_30d, a.category_l1 as a_category_l1,
       b.id as b_id, b.platform as b_platform, b.platform_id as b_platform_id, b.title as b_title, b.price as b_price,
       b.sales_30d as b_sales_30d, b.category_l1 as b_category_l1,
       {R("a.price - b.price", 4)} as price_diff, {MARGIN(2)} as margin_percent,
       case when b.platform = 'ml' then 'BRL' else 'USD' end as b_currency {PAIR}"""


@query("j01_list_matches", LIST + " where b.platform = 'ml' and confidence >= 0.21 order by confidence desc, match_id limit 50")
def _(c):
    return e.list_matches(matches(c), c.view("products"), min_confidence=0.21)


@query("j01_list_matches_by_margin", LIST + """ where a.category_l1 in ('L1') and (a.sales_30d >= 700 or b.sales_30d >= 700)
order by price_diff desc, match_id limit 50""")
def _(c):
    return e.list_matches(matches(c), c.view("products"), sort_by="margin", category_l1="L1", min_sales=700, include_br_us=True)


BOTH = """both_ways as (select match_id, confidence, product_a_id as from_id, product_b_id as to_id from matches
    union all select match_id, confidence, product_b_id, product_a_id from matches)"""


@query("j04_neighbours", f"""with {BOTH}
select from_id, to_id, match_id, confidence, platform, platform_id, title, price, currency, sales_30d, rank from (
    select b.*, platform, platform_id, title, price, currency, sales_30d,
           cast(row_number() over (partition by from_id order by confidence desc, to_id) as int) as rank
    from both_ways b join products p on p.id = to_id and is_active) where rank <= 10""")
def _(c):
    return e.neighbours(matches(c), c.view("products"), 10)


@query("p36_match_margin", f"select match_id, {R('a.price - b.price', 4)} as price_diff, {MARGIN(2)} as margin_percent {PAIR}")
def _(c):
    return e.joined_matches(matches(c), c.view("products"), ["price"]).select(
        "match_id", e.price_diff().alias("price_diff"), e.margin_percent().alias("margin_percent"))


ALERT = f"""select match_id, confidence, a.platform_id as a_pid, b.platform_id as b_pid, a.title as a_title, b.title as b_title,
       a.category_l1, {R("a.price - b.price", 4)} as price_diff, {MARGIN(1)} as margin_pct {PAIR}"""


@query("w10_gap_alerts", ALERT + " order by price_diff desc, match_id limit 10")
def _(c):
    return e.gap_alerts(matches(c), c.view("products"))


@query("w10_top_matches", ALERT + " where confidence >= 0.25 order by confidence desc, price_diff desc, match_id limit 10")
def _(c):
    return e.gap_alerts(matches(c), c.view("products"), min_confidence=0.25)


@query("w12_top_edges", f"""select match_id, a.title as a_title, a.platform as a_platform, b.title as b_title,
       b.platform as b_platform, confidence {PAIR} where confidence > 0.25 order by confidence desc, match_id limit 20""")
def _(c):
    return e.top_edges(matches(c), c.view("products"), threshold=0.25)


@query("w12_edge_hubs", f"""with {BOTH}
select id, platform, title, price, (select count(*) from matches where product_a_id = p.id or product_b_id = p.id) as match_count
from products p where id in (select from_id from both_ways where confidence > 0.22) order by match_count desc, id limit 20""")
def _(c):
    return e.edge_hubs(matches(c), c.view("products"), threshold=0.22)


@query("u01_endpoints", "select product_a_id as id from matches union select product_b_id from matches")
def _(c):
    return e.endpoints(matches(c))
