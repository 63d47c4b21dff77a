"""Scalar functions over texts that are derived row by row from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from souklens.functions import market as m, prices as p, sales_text as s, scores as sc, text as t
from souklens.functions.fixed import IMPORT_FACTORS, KEYWORD_STOPWORDS
from souklens.functions.numbers import round_half_up
from souklens.plans.registry import query, sql_round as R

AMOUNT = "cast(p_partkey * 100 + p_size as double) / 100"


def part(c, **columns):
    """Part keys with derived columns given as SQL text."""
    return c.table("part").selectExpr("p_partkey", *[f"{sql} as {name}" for name, sql in columns.items()])


def out(df, **columns):
    return df.select("p_partkey", *[col.alias(name) for name, col in columns.items()])


@query("p01_parse_price_br", f"""select p_partkey, case when p_partkey % 5 = 0 and {AMOUNT} > 0 then {AMOUNT}
    when p_partkey % 5 = 1 then cast(1000000 + p_partkey % 1000 * 100 + p_size as double) / 100
    when p_partkey % 5 = 2 and {AMOUNT} > 0 then {AMOUNT} end as price from part""")
def _(c):
    cents = "lpad(cast(p_size as string), 2, '0')"
    text = f"""case p_partkey % 5 when 0 then concat('R$ ', p_partkey, ',', {cents})
        when 1 then concat(' R$ 10.', lpad(cast(p_partkey % 1000 as string), 3, '0'), ',', {cents})
        when 2 then concat(p_partkey, '.', {cents}) when 3 then 'Grátis' else '0,00' end"""
    return out(part(c, x=text), price=p.parse_price_br("x").cast("double"))


@query("p02_parse_price_us", f"""select p_partkey, case when p_partkey % 5 = 0 then cast(1000000 + p_partkey % 1000 * 100 + p_size as double) / 100
    when p_partkey % 5 = 1 and {AMOUNT} > 0 then {AMOUNT} when p_partkey % 5 = 2 then 1000.0 + p_partkey % 1000 end as price from part""")
def _(c):
    cents, low = "lpad(cast(p_size as string), 2, '0')", "lpad(cast(p_partkey % 1000 as string), 3, '0')"
    text = f"""case p_partkey % 5 when 0 then concat('$10,', {low}, '.', {cents}) when 1 then concat('$', p_partkey, ',', {cents})
        when 2 then concat('$1,', {low}) when 3 then 'free' else '' end"""
    return out(part(c, x=text), price=p.parse_price_us("x").cast("double"))


@query("p03_parse_sales_pt", """select p_partkey, case p_partkey % 4 when 0 then p_partkey when 1 then p_size * 1000
    when 2 then p_size * 1000000 + 500000 end::bigint as sales from part""")
def _(c):
    text = """case p_partkey % 4 when 0 then concat('Novo | ', p_partkey, ' vendidos') when 1 then concat(p_size, ' mil compras')
        when 2 then concat(p_size, ',5 milhão vendas') else 'sem vendas' end"""
    return out(part(c, x=text), sales=s.parse_sales_pt("x"))


@query("p04_parse_sales_30d", """select p_partkey, case p_partkey % 4 when 0 then p_size * 1000 when 1 then p_partkey
    when 2 then p_partkey end::bigint as sales from part""")
def _(c):
    text = """case p_partkey % 4 when 0 then concat('<span>Mais de ', p_size, '&nbsp;mil compras</span><span> no mês passado</span>')
        when 1 then concat('mais de ', p_partkey, ' compras no mes passado') when 2 then concat(p_partkey, '+ bought in past month')
        else '<b>novo</b>' end"""
    return out(part(c, x=text), sales=s.parse_sales_30d("x"))


@query("p05_parse_sales_cn", """select p_partkey, case p_partkey % 3 when 0 then p_size * 10000.0 + 5000 when 1 then p_partkey * 1.0 else 0 end::double as sales from part""")
def _(c):
    text = "case p_partkey % 3 when 0 then concat('热销', p_size, '.5万+') when 1 then concat(p_partkey, '+件') else '无' end"
    return out(part(c, x=text), sales=s.parse_sales_cn("x"))


@query("p06_parse_sales_volume", """select p_partkey, case p_partkey % 5 when 0 then p_size * 10000 + 2000 when 1 then p_size * 1000
    when 2 then p_size * 100 when 3 then p_size + 1 end::bigint as sales from part""")
def _(c):
    text = """case p_partkey % 5 when 0 then concat(p_size, '.2万件') when 1 then concat(p_size, '千+件') when 2 then concat(p_size, '百件')
        when 3 then concat(p_size, '.5件') else '件' end"""
    return out(part(c, x=text), sales=s.parse_sales_volume("x"))


@query("p07_format_sales", """select p_partkey, case p_partkey % 4 when 0 then concat(p_size + 10, ',500+') when 1 then concat(p_partkey, '+')
    when 2 then concat('约', p_partkey) end as label from part""")
def _(c):
    text = """case p_partkey % 4 when 0 then concat('热销', (p_size + 10) div 10, '.', (p_size + 10) % 10, '5万+') when 1 then concat('热销', p_partkey, '+')
        when 2 then concat('约', p_partkey) else ' ' end"""
    return out(part(c, x=text), label=s.format_sales("x"))


@query("p08_sales_badge", """select p_partkey, case when p_partkey >= 100 then concat('热销', r // 10, '.', r % 10, '万+')
    else concat('热销', p_partkey * 100, '+') end as badge from (select p_partkey, (p_partkey + 5) // 10 as r from part)""")
def _(c):
    return out(part(c, n="p_partkey * 100"), badge=s.sales_badge("n"))


@query("p09_clean_text", r"""select doc_id, trim(regexp_replace(text, '[\s\v\x1C-\x1F\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'), ' ') as text from documents""")
def _(c):
    return c.table("documents").select("doc_id", t.clean_text("text").alias("text"))


RATES = {"USD": 5.10, "EUR": 6.0}


@query("p10_to_brl", f"""select id, {R("price * case when currency = 'USD' then 5.1::double else 1.0::double end", 2)} as brl,
    {R("price * case currency when 'USD' then 5.69::double else 1.0::double end", 2)} as brl_fallback from products""")
def _(c):
    v = c.view("products")
    return v.select("id", p.to_brl("price", "currency", RATES).alias("brl"), p.to_brl("price", "currency").alias("brl_fallback"))


@query("p11_invert_rates", f"select p_brand as currency, {R('1.0::double / max(p_size)', 8)} as rate from part where p_size > 0 group by p_brand")
def _(c):
    rates = c.table("part").groupBy(F.col("p_brand").alias("currency")).agg(F.max("p_size").cast("double").alias("rate"))
    return p.invert_rates(rates).withColumn("rate", round_half_up("rate", 8))


STOP = ", ".join(f"'{w}'" for w in KEYWORD_STOPWORDS)


@query("p12_extract_keywords", rf"""with words as (
    select doc_id, word, pos from (select doc_id, unnest(w) as word, unnest(generate_series(1, len(w))) as pos from (
      select doc_id, string_split_regex(regexp_replace(lower(text), '[^a-z0-9áéíóúãõçâêîôûàèìòùäëïöüñ\s-]', ' ', 'g'), '[\s,-]+') as w from documents))
    where length(word) >= 2 and word not in ({STOP})),
firsts as (select doc_id, word, min(pos) as pos from words group by 1, 2),
ranked as (select *, row_number() over (partition by doc_id order by pos) as rn from firsts)
select d.doc_id, coalesce(string_agg(word, ' ' order by rn) filter (where rn <= 6), '') as keywords
from documents d left join ranked using (doc_id) group by d.doc_id""")
def _(c):
    return c.table("documents").select("doc_id", F.array_join(t.extract_keywords("text"), " ").alias("keywords"))


@query("p12_search_terms", rf"""with words as (
    select doc_id, word, pos from (select doc_id, unnest(w) as word, unnest(generate_series(1, len(w))) as pos from (
      select doc_id, string_split_regex(regexp_replace(lower(text), '[^a-z0-9áéíóúãõçâêîôûàèìòùäëïöüñ\s-]', ' ', 'g'), '[\s,-]+') as w from documents))
    where length(word) >= 2 and word not in ({STOP})),
firsts as (select doc_id, word, min(pos) as pos from words group by 1, 2),
ranked as (select *, row_number() over (partition by doc_id order by pos) as rn from firsts)
select d.doc_id, coalesce(string_agg(word, ' ' order by rn) filter (where rn <= 6), array_to_string(list_filter(string_split_regex(any_value(d.text), '\s+'), lambda x: x <> '')[1:4], ' ')) as terms
from documents d left join ranked using (doc_id) group by d.doc_id""")
def _(c):
    return c.table("documents").select("doc_id", t.search_terms("text").alias("terms"))


CN = {"蓝牙耳机": "fone bluetooth", "耳机": "fone", "蓝牙": "bluetooth", "红色": "vermelho"}


@query("p13_has_chinese", "select p_partkey, p_partkey % 3 = 0 as cn from part")
def _(c):
    return out(part(c, x="case when p_partkey % 3 = 0 then concat(p_name, ' 红色') else p_name end"), cn=t.has_chinese("x"))


@query("p14_translate_cn_pt", """select p_partkey, case p_partkey % 3 when 0 then concat(p_name, ' vermelhofone bluetooth')
    when 1 then concat('bluetooth', p_name, 'fone') else p_name end as title from part""")
def _(c):
    text = "case p_partkey % 3 when 0 then concat(p_name, ' 红色蓝牙耳机') when 1 then concat('蓝牙', p_name, '耳机') else p_name end"
    return out(part(c, x=text), title=t.translate_cn_pt("x", CN))


PT = {"widget": "小部件", "small": "小", "red widget": "红色小部件", "ring": "戒指"}


@query("p15_pt_to_cn", """select p_partkey, case when lower(p_name) = 'red widget' then '红色小部件' when contains(lower(p_name), 'widget') then '小部件'
    when contains(lower(p_name), 'small') then '小' when contains(lower(p_name), 'ring') then '戒指' end as cn from part""")
def _(c):
    return out(part(c, x="upper(p_name)"), cn=t.pt_to_cn("x", PT))


@query("p15_build_queries", """select p_partkey, concat_ws('|', p_name, case when lower(p_name) = 'red widget' then '红色小部件' when contains(lower(p_name), 'widget') then '小部件'
    when contains(lower(p_name), 'small') then '小' when contains(lower(p_name), 'ring') then '戒指' end) as queries from part""")
def _(c):
    return out(part(c, x="p_name"), queries=F.array_join(t.build_queries("x", PT), "|"))


@query("p16_extract_province", """select s_suppkey, case s_suppkey % 5 when 0 then 'Zhejiang' when 1 then 'Guangdong' when 2 then 'Shanghai' end as province from supplier""")
def _(c):
    name = """case s_suppkey % 5 when 0 then concat('义乌市', s_name) when 1 then concat('深圳', s_name) when 2 then concat('上海', s_name)
        when 3 then 'Unknown' else s_name end as x"""
    return c.table("supplier").selectExpr("s_suppkey", name).select("s_suppkey", t.extract_province("x").alias("province"))


@query("p17_badges", """select s_suppkey, case s_suppkey % 3 when 0 then '金牌,热度榜,新晋榜' when 1 then 'x' else '' end as badges,
    case s_suppkey % 3 when 0 then 'hot' else 'plain' end as rank_type from supplier""")
def _(c):
    badges = """case s_suppkey % 3 when 0 then array('金牌', '热度榜](http://x)', '](none)', '新晋榜') when 1 then array('x') else array() end as b"""
    d = c.table("supplier").selectExpr("s_suppkey", badges).withColumn("b", t.clean_badges("b"))
    return d.select("s_suppkey", F.array_join("b", ",").alias("badges"), t.rank_type("b", F.lit("plain")).alias("rank_type"))


@query("p18_json_strings", """select event_id, case event_id % 4 when 0 then concat(event_type, '|b') when 1 then '' when 2 then '' else event_type end as items from events""")
def _(c):
    json = """case event_id % 4 when 0 then concat('["', event_type, '", 7, null, "b"]') when 1 then '{"a": 1}' when 2 then 'not json'
        else concat('["', event_type, '", {"a": "c"}, true]') end as j"""
    return c.table("events").selectExpr("event_id", json).select("event_id", F.array_join(t.json_strings("j"), "|").alias("items"))


@query("p28_text_score", f"""select id, {R('''case when contains(lower(title), 'red widget') then 100.0::double
    when contains(lower(title), 'red') and contains(lower(title), 'widget') then 90
    when contains(lower(title), 'red') or contains(lower(title), 'widget') then 75 else 0 end''', 4)} as score from products""")
def _(c):
    return c.view("products").select("id", round_half_up(sc.text_score("Red Widget", "title", F.col("category_l1")), 4).alias("score"))


@query("p29_price_score", f"""select id, {R('greatest(0.0::double, least(100.0::double, (1 - (price - 900) / (1500.0::double - 900)) * 100))', 4)} as score from products""")
def _(c):
    return c.view("products").select("id", round_half_up(sc.price_score("price", F.lit(900.0), F.lit(1500.0)), 4).alias("score"))


@query("p30_sales_score", f"select id, case when sales_30d > 0 then {R('least(100.0::double, log10(sales_30d + 1) * 25)', 4)} else 0.0::double end as score from products")
def _(c):
    return c.view("products").select("id", round_half_up(sc.sales_score("sales_30d"), 4).alias("score"))


@query("p31_composite_score", f"""select p_partkey, {R('p_size * 0.30::double + (p_partkey % 100) * 0.40::double + p_size * 2 * 0.20::double + (p_partkey % 7) * 0.10::double', 4)} as score from part""")
def _(c):
    d = c.table("part")
    score = sc.composite_score(F.col("p_size"), F.col("p_partkey") % 100, F.col("p_size") * 2, F.col("p_partkey") % 7)
    return d.select("p_partkey", round_half_up(score, 4).alias("score"))


@query("p41_parse_bought", """select p_partkey, case p_partkey % 5 when 0 then p_size * 1000 when 1 then trunc(p_size * 4.3::double) when 2 then p_size * 30
    when 3 then p_size * 1000000 + 500000 end::bigint as sales from part""")
def _(c):
    head = "concat('<p class=\"x\" id=\"pqv-bought-in-last-month\"> '"
    text = f"""case p_partkey % 5 when 0 then {head}, p_size, 'K+ bought in past month</p>') when 1 then {head}, p_size, '+ bought in past week</p>')
        when 2 then {head}, p_size, ' bought in past day</p>') when 3 then {head}, p_size, '.5M bought in past month</p>')
        else concat('<p>', p_size, '+ bought in past month</p>') end"""
    return out(part(c, x=text), sales=s.parse_bought("x"))


@query("p42_parse_sales_page", """select p_partkey, case p_partkey % 4 when 0 then p_partkey when 1 then p_partkey when 2 then p_size end::bigint as amazon,
    case p_partkey % 4 when 0 then null when 1 then p_partkey when 3 then p_size * 1000 end::bigint as ml from part""")
def _(c):
    text = """case p_partkey % 4 when 0 then concat(p_partkey, '+ comprados no último mês') when 1 then concat('Mais de ', p_partkey, ' vendidos')
        when 2 then concat('#', p_size, ' mais vendido') else concat(p_size, ' mil produtos vendidos') end"""
    return out(part(c, x=text), amazon=s.parse_sales_page("x", "amazon"), ml=s.parse_sales_page("x", "ml"))


@query("p43_url_key", r"""select page_id, sha256(url) as key, regexp_matches(url, '^[a-z]+://[^/?#]*example\.org([/?#:]|$)') as allowed from pages""")
def _(c):
    return c.table("pages").select("page_id", t.url_key("url").alias("key"), t.allowed_host("url", ["example.org"]).alias("allowed"))


@query("p44_parse_sold", """select p_partkey, case p_partkey % 5 when 0 then p_size * 1000 + 400 when 1 then p_size * 1000000 when 2 then 1000 + p_partkey % 1000
    when 3 then null end::bigint as sales from part""")
def _(c):
    text = """case p_partkey % 5 when 0 then concat(p_size, '.4K+') when 1 then concat(p_size, 'm')
        when 2 then concat('1,', lpad(cast(p_partkey % 1000 as string), 3, '0')) when 3 then concat(p_size, '+') else 'sold' end"""
    return out(part(c, x=text), sales=s.parse_sold("x"))


URLS = """case p_partkey % 7 when 0 then concat('https://detail.1688.com/offer/', p_partkey, '.html')
    when 1 then concat('https://www.amazon.com.br/dp/B', lpad(cast(p_partkey as {s}), 9, '0'), '?th=1')
    when 2 then concat('https://www.amazon.com/dp/B', lpad(cast(p_partkey as {s}), 9, '0'))
    when 3 then concat('https://produto.mercadolivre.com.br/MLB-', p_partkey) when 4 then concat('https://shopee.com.br/product/', p_size, '/', p_partkey)
    when 5 then concat('https://pt.aliexpress.com/item/', p_partkey, '.html') else concat('https://example.com/', p_name) end"""


@query("x10_parse_product_url", """with hits as (
    select concat('part-', p_partkey) as source, ['1688', 'amazon_br', 'amazon_us', 'ml', 'shopee', 'aliexpress'][p_partkey % 7 + 1] as platform,
           case p_partkey % 7 when 0 then cast(p_partkey as varchar) when 1 then concat('B', lpad(cast(p_partkey as varchar), 9, '0'))
           when 2 then concat('B', lpad(cast(p_partkey as varchar), 9, '0')) when 3 then concat('MLB-', p_partkey)
           when 4 then concat(p_size, '/', p_partkey) when 5 then cast(p_partkey as varchar) end as platform_id from part)
select * from hits union all select concat('page-', page_id), null, null from pages""")
def _(c):
    own = c.table("part").selectExpr("concat('part-', p_partkey) as source", URLS.format(s="string") + " as url")
    urls = own.unionByName(c.table("pages").selectExpr("concat('page-', page_id) as source", "url"))
    return urls.select("source", t.parse_product_url("url").alias("u")).select("source", "u.platform", "u.platform_id")


def offers(c):
    """Every product as a source in yuan or dollars and as an offer on its own platform."""
    return c.view("products").selectExpr(
        "id", "price / 40 as source_price", "case when id % 3 = 0 then 'CNY' else 'USD' end as source_currency",
        "platform as sell_platform", "price as sell_price", "currency as sell_currency")


@query("p32_compute_margins", f"""with o as (select *, price / 40 * case when id % 3 = 0 then 0.14::double else 1 end as usd from products),
q as (select o.*, t.quantity, t.factor from o cross join (values (50, 3.5::double), (200, 3.0::double)) t(quantity, factor)),
l as (select *, usd * factor * case when currency = 'BRL' then 5.6::double else 1 end as landed,
      price * (1 - case platform when 'ml' then 0.16::double when 'amazon_br' then 0.15::double when 'amazon_us' then 0.15::double else 0.12::double end) as net from q)
select id, price / 40 as source_price, case when id % 3 = 0 then 'CNY' else 'USD' end as source_currency, platform as sell_platform,
       price as sell_price, currency as sell_currency, quantity, factor as factor_used, {R('landed', 2)} as landed_cost_per_unit,
       {R('(net - landed) / net * 100', 1)} as margin_pct from l""")
def _(c):
    return m.compute_margins(offers(c))


@query("p33_margin_range", f"""with q as (select o.*, t.quantity, t.factor from products o cross join (values (50, 3.5::double), (200, 3.0::double), (500, 2.6::double)) t(quantity, factor)),
l as (select *, price / 40 * case when id % 3 = 0 then 0.8::double else 5.1::double end * factor as landed, price * (1 - 0.11::double) as net from q)
select id, quantity, factor as import_factor, {R('landed', 2)} as landed_cost, {R('(net - landed) / net * 100', 1)} as margin_pct from l""")
def _(c):
    o = offers(c).withColumnsRenamed({"sell_platform": "platform", "sell_price": "retail_price"})
    return m.margin_range(o, fees={"ml": 0.11}, default_fee=0.11, to_brl={"CNY": 0.80, "USD": 5.10}).select(
        "id", "quantity", "import_factor", "landed_cost", "margin_pct")


@query("j07_factor_for", """select l_orderkey, l_linenumber, case when l_suppkey % 3 = 1 then
    case when q >= 501 then 1.8 when q >= 201 then 2.0 when q >= 51 then 2.3 when q >= 1 then 2.8 else 3.5 end
    else case when q >= 501 then 2.3 when q >= 201 then 2.6 when q >= 51 then 3.0 else 3.5 end end::double as factor
from (select *, cast(l_quantity * 20 as int) as q from lineitem)""")
def _(c):
    rows = c.table("lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "case l_suppkey % 3 when 0 then 'BR' when 1 then 'US' else 'XX' end as country",
        "cast(l_quantity * 20 as int) as quantity")
    table = c.spark.createDataFrame(IMPORT_FACTORS, "country string, quantity_min int, factor double")
    return m.join_factors(rows, table).select("l_orderkey", "l_linenumber", "factor")


@query("p34_market_pulse", """with v as (select *, case when l_quantity > 0 and l_linenumber < 4 then case when l_quantity / (l_linenumber * 40) > 0.3 then 'hot'
      when l_quantity / (l_linenumber * 40) > 0.15 then 'warm' when l_quantity / (l_linenumber * 40) > 0.05 then 'cool' else 'dead' end
      when l_partkey = 0 then 'warm' when l_partkey < 1000 then 'hot' when l_partkey < 10000 then 'warm' else 'cool' end as velocity,
      case when l_quantity <= 3 then 'low' when l_quantity <= 10 then 'medium' when l_quantity <= 25 then 'high' else 'saturated' end as competition from lineitem)
select l_orderkey, l_linenumber, velocity, competition, case when velocity = 'hot' and competition in ('low', 'medium') then '~3-6 months before saturation'
       when velocity = 'hot' then '~1-2 months — act fast' when velocity = 'warm' then '~6-12 months steady' else 'Window may have closed' end as window from v""")
def _(c):
    rows = c.table("lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "cast(l_quantity as bigint) as sales_30d",
        "case when l_linenumber < 4 then l_linenumber * 40 end as sales_total", "l_partkey as bsr_rank",
        "cast(l_quantity as bigint) as seller_count")
    return m.market_pulse(rows).select("l_orderkey", "l_linenumber", "velocity", "competition", "window")


@query("p35_verdict", """with i as (select l_orderkey, l_linenumber, cast(l_discount * 1000 - 10 as double) as m, cast(l_tax * 10 + 0.2 as double) as conf, l_linenumber - 1 as n,
      ['hot', 'warm', 'cool', 'dead'][l_partkey % 4 + 1] as v, ['low', 'medium', 'high', 'saturated'][l_suppkey % 4 + 1] as c from lineitem),
r as (select *, round(m, 1) as mm, round(conf, 2) as cc from i),
s as (select *, case when mm > 60 then 3 when mm > 50 then 2 when mm > 30 then 1 when mm > 0 then -1 else -3 end
      + case when n > 0 and cc > 0.9 then 2 when n > 0 and cc > 0.7 then 1 else 0 end
      + case v when 'hot' then 2 when 'warm' then 1 when 'cool' then -1 else -3 end
      + case c when 'low' then 2 when 'medium' then 1 when 'high' then -1 else -2 end as score from r)
select l_orderkey, l_linenumber, cast(score as int) as score, case when score >= 6 then 'strong' when score >= 3 then 'moderate' when score >= 0 then 'weak' else 'avoid' end as rating,
       array_to_string(list_filter([
         case when mm > 60 then concat(mm, '% margin on ml with 50-unit order — excellent') when mm > 50 then concat(mm, '% margin on ml — strong') when mm > 30 then concat(mm, '% margin on ml — decent') end,
         case when n > 0 and cc > 0.9 then concat(round(cc * 100)::int, '% source match found — easy to source') when n > 0 and cc > 0.7 then concat(round(cc * 100)::int, '% source match — likely same product') end,
         case when n >= 5 then concat(n, ' source options — good supplier diversity') end, case v when 'hot' then 'Product is trending hot right now' when 'warm' then 'Product demand is steady' end,
         case c when 'low' then 'Low competition — room for entry' when 'medium' then 'Moderate competition — manageable' end], lambda x: x is not null)[1:5], '|') as pros,
       array_to_string(list_filter([
         case when mm <= 0 then concat('Negative margin (', mm, '%) — losing money') when mm <= 30 then concat('Best margin is only ', mm, '% — thin margins') end,
         case when n > 0 and cc <= 0.7 then concat('Best source match is only ', round(cc * 100)::int, '% — uncertain sourcing') end, case when n < 2 then 'Few source options — limited supplier diversity' end,
         case v when 'cool' then 'Product demand is cooling' when 'dead' then 'Product trend has died — avoid' end,
         case c when 'high' then 'High competition — margins may compress' when 'saturated' then 'Market is saturated — very hard to compete' end], lambda x: x is not null)[1:5], '|') as cons,
       case when score >= 6 then concat_ws(' ', 'Strong opportunity.', case when mm > 50 then 'Start with 50 units on ml.' end, case when v = 'hot' then 'Act fast — trend may peak soon.' end)
            when score >= 3 then concat_ws(' ', 'Decent opportunity with caveats. Test with a small batch first (50 units).', case when c in ('high', 'saturated') then 'Differentiate on listing quality or bundles.' end)
            when score >= 0 then 'Proceed with caution. Margins are thin or competition is stiff. Only worth it at scale (500+ units).'
            else concat_ws(' ', 'Not recommended right now.', case when mm <= 0 then 'You would lose money at current prices.' end, case when v in ('cool', 'dead') then 'The trend has passed.' end) end as summary
from s""")
def _(c):
    rows = c.table("lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "round(l_discount * 1000 - 10, 1) as best_margin", "'ml' as best_platform", "50 as best_quantity",
        "round(l_tax * 10 + 0.2, 2) as best_confidence", "l_linenumber - 1 as match_count",
        "element_at(array('hot', 'warm', 'cool', 'dead'), cast(l_partkey % 4 + 1 as int)) as velocity",
        "element_at(array('low', 'medium', 'high', 'saturated'), cast(l_suppkey % 4 + 1 as int)) as competition")
    joined = lambda c: F.array_join(c, "|").alias(c)
    return m.verdict(rows).select("l_orderkey", "l_linenumber", "score", "rating", joined("pros"), joined("cons"), "summary")


@query("p39_opportunity_reasoning", """select l_orderkey, l_linenumber, coalesce(nullif(concat_ws(' | ',
    case when q > 50 then concat('Alta demanda (', q, ' vendas/mês)') when q > 10 then concat('Demanda moderada (', q, ' vendas/mês)') end,
    case when l_linenumber * 8 > 20 then concat('Boa reputação (', l_linenumber * 8, ' avaliações)') end,
    case when l_partkey % 5 = 0 then 'Sem concorrentes no ML' when l_partkey % 5 < 3 then 'Pouca concorrência no ML' end,
    case when d > 50 then concat('Alta margem estimada (', d, '%)') when d > 20 then concat('Margem moderada (', d, '%)') end), ''), 'Oportunidade identificada') as reasoning
from (select *, cast(round(l_quantity * 2) as bigint) as q, cast(round(l_discount * 1000) as bigint) as d from lineitem)""")
def _(c):
    rows = c.table("lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "cast(round(l_quantity * 2) as bigint) as q", "l_linenumber * 8 as r", "l_partkey % 5 as peers",
        "round(l_discount * 1000) as d", "case when l_partkey % 5 = 0 then 'none' when l_partkey % 5 < 3 then 'low' else 'medium' end as comp")
    text = m.opportunity_reasoning(F.col("q"), F.col("r"), F.col("peers"), F.col("d"), F.col("comp"))
    return rows.select("l_orderkey", "l_linenumber", text.alias("reasoning"))
