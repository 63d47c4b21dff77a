"""Extraction from pages. The markup is written around the columns of ``part``; the check reads the columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from souklens.operators import extract as x
from souklens.plans.registry import query
from souklens.session import dealt


def pages(c, markup: str, name: str = "html"):
    return dealt(c.table("part"), "p_partkey").selectExpr("p_partkey as page_id", f"{markup} as {name}")


ASIN = "concat('B', lpad(cast(p_partkey as {s}), 9, '0'))"
ASIN_S, ASIN_D = ASIN.format(s="string"), ASIN.format(s="varchar")
MLB_S, MLB_D = [f"concat('MLB', lpad(cast(p_partkey as {s}), 8, '0'))" for s in ("string", "varchar")]


@query("x01_extract_amazon_cards", """select p_partkey as page_id, lpad(cast(p_partkey as varchar), 10, '0') as asin,
    nullif(p_size, -1)::bigint as sales, cast(p_partkey % 50 as bigint) as reviews from part where p_size <> 0 or p_partkey % 50 <> 0""")
def _(c):
    return x.extract_amazon_cards(dealt(c.view("market_pages"), "page_id"))


@query("x02_extract_ml_cards", f"""select p_partkey as page_id, {MLB_D} as platform_id,
    case p_partkey % 3 when 0 then p_size * 1000 when 1 then p_size * 1000000 + 500000 else p_partkey end::bigint as sales,
    p_retailprice as price from part where p_partkey % 3 < 2 or p_partkey > 0""")
def _(c):
    return x.extract_ml_cards(pages(c, f"""concat('{{"product_id":"', {MLB_S}, '","current_price":{{"value":', p_retailprice, '}},"t":"',
        case p_partkey % 3 when 0 then concat(p_size, ' mil vendidos') when 1 then concat(p_size, ',5 milhão produtos vendidos')
        else concat('+', p_partkey, ' vendidos') end, '"}}')"""))


@query("x03_extract_ml_products", f"""select p_partkey as page_id, {MLB_D} as platform_id, concat(p_name, ' & co') as title,
    p_retailprice as price, 'BRL' as currency, case when p_partkey % 2 = 0 then concat('https://www.mercadolivre.com.br/x/', p_partkey)
    else concat('https://www.mercadolivre.com.br/p/', {MLB_D}) end as url,
    case when p_partkey % 3 = 0 then concat('https://http2.mlstatic.com/D_Q_NP_2X_', p_partkey, '-MLA-AB.webp') end as image_url from part""")
def _(c):
    return x.extract_ml_products(pages(c, f"""concat('{{"product_id":"', {MLB_S}, '","title":{{"text":"', p_name, ' &amp; co"}},',
        case when p_partkey % 2 = 0 then concat('"url":"www.mercadolivre.com.br\\\\u002Fx\\\\u002F', p_partkey, '","current_price":{{"value":')
        else '"price":{{"currency":"BRL","value":' end, p_retailprice, '}}',
        case when p_partkey % 3 = 0 then concat(',"pictures":{{"scale":"1","pictures":[{{"id":"', p_partkey, '-MLA"}}]}}') else '' end, '}}')"""))


GRID = f"""concat('<div id="grid"><div class="zg" data-asin="', {ASIN_S}, '"><a class="a-link-normal" href="/dp/x"><span>', p_name, '</span></a>',
    '<span class="p13n-sc-price">R$ ', p_partkey + 1, ',', lpad(cast(p_size as string), 2, '0'), '</span>',
    '<img alt="" src="https://images-amazon.com/', p_partkey, '.jpg" srcset="https://images-amazon.com/s.jpg 1x, https://images-amazon.com/',
    p_partkey, '_large.jpg 2x" /><i class="a-icon-alt">', p_partkey % 5, ',', p_partkey % 10, ' de 5 estrelas</i>',
    '<a class="a-size-small" href="/product-reviews/x">1.', lpad(cast(p_size as string), 3, '0'), '</a><span class="up">+', p_size, '%</span>',
    '<span class="zg-bdg-text">#', p_partkey + 1, '</span></div><div data-asin="Z', {ASIN_S}, '"><a href="/dp/z" title="', p_brand, '"><span></span></a></div>',
    '<div data-asin="short"><h2>no</h2></div></div>')"""
PRICE_D = "cast((p_partkey + 1) * 100 + p_size as double) / 100"
GRID_ROWS = f"""select p_partkey as page_id, {ASIN_D} as platform_id, p_name as title, {PRICE_D} as price,
    concat('https://images-amazon.com/', p_partkey, '_large.jpg') as image_url, cast(p_partkey % 5 * 10 + p_partkey % 10 as double) / 10 as review_avg,
    1000 + p_size::bigint as review_count, p_partkey + 1 as bsr_rank, p_size as bsr_change from part
    union all select p_partkey, concat('Z', {ASIN_D}), p_brand, null, null, null, 0, null, null from part"""
CARD = ["page_id", "platform_id", "title", "price", "image_url", "review_avg", "review_count", "bsr_rank"]


@query("x04_extract_amazon_grid", f"select {', '.join(CARD)}, concat('https://www.amazon.com.br/dp/', platform_id) as url from ({GRID_ROWS})")
def _(c):
    return x.extract_amazon_grid(pages(c, GRID)).select(*CARD, "url")


@query("x04_extract_amazon_grid_us", f"""select p_partkey as page_id, {ASIN_D} as platform_id, p_name as title, {PRICE_D} as price,
    concat('https://www.amazon.com/dp/', {ASIN_D}) as url from part""")
def _(c):
    return x.extract_amazon_grid(pages(c, f"""concat('<div data-asin="', {ASIN_S}, '"><div class="p13n-sc-truncate-desktop-type2">', p_name,
        '</div><span class="a-offscreen">$', p_partkey + 1, '.', lpad(cast(p_size as string), 2, '0'), '</span></div>')"""), "amazon_us").select(
        "page_id", "platform_id", "title", "price", "url")


@query("x11_extract_movers", f"select {', '.join(CARD)}, bsr_change from ({GRID_ROWS})")
def _(c):
    return x.extract_movers(pages(c, GRID)).select(*CARD, "bsr_change")


@query("x05_extract_product_page", """select p_partkey as page_id, cast((p_partkey + 1) * 100 + p_size as double) / 100 as price,
    case when p_partkey % 2 = 0 then 1000 + p_size end::bigint as sales_30d, p_partkey::bigint as review_count,
    cast(p_partkey % 5 * 10 + p_partkey % 10 as double) / 10 as review_avg, concat('https://images-amazon.com/', p_partkey) as image_url from part""")
def _(c):
    return x.extract_product_page(pages(c, """concat('<span id="priceblock_ourprice">R$ ', p_partkey + 1, ',', lpad(cast(p_size as string), 2, '0'), '</span>',
        case when p_partkey % 2 = 0 then concat('<div class="social-proofing-faceout-title-tk_bought"><span>mais de 1.', lpad(cast(p_size as string), 3, '0'), ' compraram no último mês</span></div>') else '' end,
        '<span id="acrCustomerReviewText">', p_partkey, ' avaliações</span><span id="acrPopover" title="x"><i><span class="a-icon-alt">', p_partkey % 5, ',', p_partkey % 10,
        ' de 5</span></i></span><img id="landingImage" data-old-hires="https://images-amazon.com/', p_partkey, '" src="x"/>')"""))


@query("x06_extract_1688_blocks", """with b as (select p_partkey, p_name, p_size, unnest([1, 2, 3]) as block from part)
select p_partkey as page_id, block::int as block, case when block <> 2 then concat('60000000', 10 + p_partkey % 90) else '' end as offer_id,
    concat(p_name, ' 批发 ', block) as title, cast(p_size * 10 + block as double) / 10 as price_cny,
    case when block = 1 then '义乌工厂' else '' end as supplier_name,
    case when block = 1 then concat('https://cbu01.alicdn.com/img/ibank/', p_partkey, '.jpg') else '' end as image_url,
    case when block = 1 then concat(p_size, ' pieces') else 'N/A' end as moq, case when block = 1 then p_size * 10000 + 2000 end::bigint as sales_volume_estimate
from b where block <= 2""")
def _(c):
    return x.extract_1688_blocks(pages(c, """concat('Head\\n[Image 0] no price offerId=9999999999\\n',
        '[Image 1] ![a](https://cbu01.alicdn.com/img/ibank/', p_partkey, '.jpg) offerId=60000000', 10 + p_partkey % 90, ' 物流时效 4.5 ', p_name, ' 批发 1\\n¥', p_size, '.1 ',
        p_size, '.2万件 [义乌工厂](https://shop1x.1688.com/) ', p_size, ' 件起批\\n[Image 2] ![b](y) ', p_name, ' 批发 2 ¥ ', p_size, '.2\\n',
        '[Image 3] offerIds60000000', 10 + p_partkey % 90, ' 物流时效 1 ', p_name, ' 批发 3\\n¥', p_size, '.3')""", "markdown"), 2).withColumn(
        "block", (F.col("block") - 1).cast("int"))


@query("x07_extract_json_island", """select p_partkey as page_id, i::int as position, concat(p_partkey, '-', i) as source_product_id,
    concat('https://www.dhgate.com/p/', i) as source_url, p_name as product_name, cast(p_size * 10 + 5 as double) / 10 as price_low,
    case when i % 2 = 0 then p_size + 1.0 end::double as price_high, p_brand as seller_name, cast(90 + i as double) as seller_rating,
    nullif(i, 0)::int as moq, p_size * 1000 + 400::bigint as monthly_sales from (select *, unnest([0, 1, 2, 3]) as i from part)""")
def _(c):
    item = """concat('{{"itemcode":"', p_partkey, '-{i}","productname":"', p_name, '","productDetailUrl":"/p/{i}","pricebeforerate":"US $', p_size, '.5{hi}',
        '","domainname":"', p_brand, '","feedBackPercent":"9{i}%","minOrderNum":{i},"recentlysold":"', p_size, '.4K+"}}')"""
    items = ", ',', ".join(item.format(i=i, hi=" - ', p_size + 1, '" if i % 2 == 0 else "") for i in range(4))
    wrap = """concat('<html><script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":',
        case p_partkey % 3 when 0 then '{"productList":[' when 1 then '{"data":{"productList":[' else '{"a":[1],"b":{"n":5,"found":[' end, """
    close = """, case p_partkey % 3 when 0 then ']}' else ']}}' end, '}}</script></html>')"""
    return x.extract_json_island(pages(c, wrap + items + close)).select(
        "page_id", "position", "source_product_id", "source_url", "product_name", "price_low", "price_high", "seller_name",
        "seller_rating", "moq", "monthly_sales")


@query("x08_flatten_search_items", """select p_partkey as page_id, i::int as position, concat(p_partkey, '.', i) as source_product_id,
    case when i = 0 then concat('https://www.rakumart.com.br/product/', p_partkey, '.0') else 'https://x.example/1' end as source_url,
    case when i = 0 then concat(p_name, ' fone') else p_name end as product_name, p_retailprice as price_low,
    case when i = 0 then 'https://img/x.jpg' else 'http://img/y.jpg' end as image_url, case when i = 1 then p_size end::bigint as monthly_sales,
    case when i = 1 then concat(p_size + 1, '%') else '' end as repurchase_rate, case when i = 0 then '11' end as top_category_id
from (select *, unnest([0, 1]) as i from part)""")
def _(c):
    json = """concat('{"data":{"content":[{"iid":"', p_partkey, '.0","title":"', p_name, ' 耳机","price":', p_retailprice,
        ',"picurl":"//img/x.jpg","repurchaseRate":0,"topCategoryId":[11,12]},{"iid":"', p_partkey, '.1","title":"', p_name, '","price":"R$ ', p_retailprice,
        ' - 9","picurl":"http://img/y.jpg","goods_link":"https://x.example/1","monthSold":', p_size, ',"repurchaseRate":"', p_size + 1, '"}]}}')"""
    return x.flatten_search_items(pages(c, json, "json"), "taobao", dictionary={"耳机": "fone"}).select(
        "page_id", "position", "source_product_id", "source_url", "product_name", "price_low", "image_url", "monthly_sales",
        "repurchase_rate", "top_category_id")


@query("x09_flatten_sku_model", """select p_partkey as page_id, case when p_partkey % 2 = 0 then concat('Cor: ', p_name, ', azul; Tam: ', p_size) else concat(p_brand, '>', p_size) end as main_spec,
    case when p_partkey % 2 = 0 then 2 end::int as n_props, concat(p_brand, '>', p_size, '|', p_brand, '>x') as models,
    concat(p_retailprice, '') as first_price, case when p_partkey % 3 = 0 then concat('https://v/', p_partkey) end as video_url from part""")
def _(c):
    json = """concat('{"result":{"data":{"Root":{"fields":{"dataJson":{"skuModel":{"skuProps":',
        case when p_partkey % 2 = 0 then concat('[{"prop":"Cor","value":[{"name":"', p_name, '"},{"name":"azul","imageUrl":"u"}]},{"prop":"Tam","value":[{"name":"', p_size, '"}]}]') else '[]' end,
        ',"skuInfoMap":{"', p_brand, '>', p_size, '":{"price":"', p_retailprice, '","skuId":1},"', p_brand, '>x":{"price":"1"}}}}}},"gallery":{"fields":{"video":{',
        case when p_partkey % 3 = 0 then concat('"videoUrl":"https://v/', p_partkey, '"') else '' end, '}}}}}}')"""
    d = x.flatten_sku_model(pages(c, json, "json"))
    first = F.get(F.map_values("variant_prices"), F.lit(0))["price"]
    return d.select("page_id", "main_spec", F.when(F.col("specifications").isNotNull(), F.size("specifications")).alias("n_props"),
                    F.array_join("models", "|").alias("models"), first.alias("first_price"), "video_url")


@query("x12_extract_zip_lists", """select p_partkey as page_id, i::int as position, case when i = 0 then concat('a_', p_partkey) else '1' end as source_product_id,
    case when i = 0 then concat('https://www.alibaba.com/product-detail/a_', p_partkey, '.html') else '' end as source_url,
    concat('Produto ', p_name, ' ', i) as product_name, case when i = 0 then 1000 + p_size + 0.5 end::double as price_low,
    case i when 0 then 'https://img/1.jpg' else 'https://www.alibaba.com/2.jpg' end as image_url from (select *, unnest([0, 1]) as i from part)""")
def _(c):
    return x.extract_zip_lists(pages(c, """concat('<span class="elements-title-x">Produto ', p_name, ' 0</span><b>R$ 1.', lpad(cast(p_size as string), 3, '0'), ',50</b><img a="b" src="//img/1.jpg"/>',
        '<a href="/product-detail/a_', p_partkey, '.html">x</a><span class="elements-title-normal" z>Produto ', p_name, ' 1</span><img src="/2.jpg"/><span class="elements-title">curto</span>')"""))


@query("x13_extract_sold_quantity", f"""select p_partkey as page_id, case when p_partkey % 2 = 0 then {MLB_D} else concat({MLB_D}, '7') end as platform_id,
    case when p_partkey % 2 = 0 then p_size + 1 else 1000 + p_size end::bigint as sales from part""")
def _(c):
    return x.extract_sold_quantity(pages(c, f"""case when p_partkey % 2 = 0 then concat('{{"permalink":"https://x/', {MLB_S}, '","q":1,"sold_quantity":3}},{{"permalink":"', {MLB_S}, '","sold_quantity":', p_size + 1, '}}')
        else concat('<a>', {MLB_S}, '7</a>\\n <b>1.', lpad(cast(p_size as string), 3, '0'), '+ vendidos</b>') end"""))


@query("x13_asin_list", f"""select p_partkey as page_id, i::int as position, case when i = 0 then {ASIN_D} else 'AAAAAAAAAA' end as asin from (select *, unnest([0, 1]) as i from part)""")
def _(c):
    return x.asin_list(pages(c, f"""concat('<i data-asin="', {ASIN_S}, '"><i data-asin="AAAAAAAAAA"><i data-asin="', {ASIN_S}, '"><i data-asin="x">')"""))


@query("x14_extract_ml_grid", f"""select p_partkey as page_id, {MLB_D} as platform_id, p_name as title, cast((p_partkey + 1) * 100 + 90 as double) / 100 as price,
    concat('https://http2/', p_partkey, '.jpg') as image_url, p_size * 1000::bigint as sales_30d,
    concat('https://www.mercadolivre.com.br/produto/', {MLB_D}) as url from part""")
def _(c):
    return x.extract_ml_grid(pages(c, f"""concat('<ol><li class="ui-search-layout__item"><a href="https://x/p/MLB-', lpad(cast(p_partkey as string), 8, '0'), '#p"><h2 class="t">', p_name,
        '</h2></a><span class="andes-money-amount__fraction">', p_partkey + 1, ',90</span><img alt="i" src="https://http2/', p_partkey, '.jpg"/><i>', p_size, ' mil vendidos</i></li>',
        '<li class="ui-search-layout__item"><a href="/p/MLB12345678"><h2>sem preço</h2></a></li></ol>')""")).select(
        "page_id", "platform_id", "title", "price", "image_url", "sales_30d", "url")


@query("x15_extract_1688_cards", """select p_partkey as page_id, cast(600000 + p_partkey as varchar) as source_product_id, concat('https://detail.1688.com/offer/', 600000 + p_partkey, '.html') as source_url,
    concat('批发商品 ', p_name) as product_name, cast(p_size * 10 + 5 as double) / 10 as price_low, 'https://cbu01/x.jpg' as image_url from part""")
def _(c):
    return x.extract_1688_cards(pages(c, """concat('<div class="sm-offer-item x"><a href="//detail.1688.com/offer/', 600000 + p_partkey, '.html" title="批发商品 ', p_name, '"></a><span class="sm-offer-priceNum">¥', p_size,
        '.5起</span><img src="//cbu01/x.jpg"/></div><div class="offer-list-row"><div class="title">短</div></div>')""")).select(
        "page_id", "source_product_id", "source_url", "product_name", "price_low", "image_url")


@query("x16_extract_category_trail", """select p_partkey as page_id, case when p_size % 4 = 0 then '' else concat(p_brand, ' > ', p_type) end as categories,
    case when p_size % 3 = 0 then '' when p_size % 3 = 1 then concat('https://www.amazon.com.br/gp/bestsellers/home/', p_partkey) else concat('https://x.y/bestsellers/', p_partkey, '/z') end as bestsellers_url,
    case when p_size % 3 = 0 then '' else cast(p_partkey as varchar) end as node_id from part""")
def _(c):
    found = x.extract_category_trail(pages(c, """concat('<h1>t</h1>', case when p_size % 4 = 0 then '' when p_size % 4 = 1 then concat('<div id="wayfinding-breadcrumbs_container"><ul><li><a href="/a"> ', p_brand,
        ' </a></li> › <li><a class="q"><b>', p_type, '</b></a></li><li><a> </a></li></ul></div><a>no crumb</a>') else concat('<ol class="x andes-breadcrumb"><li><a>', p_brand, '</a></li><li><a>\n', p_type, '</a></li></ol>') end,
        case p_size % 3 when 1 then concat('<a class="l" href="/gp/bestsellers/home/', p_partkey, '">mais</a>') when 2 then concat('<a href="https://x.y/bestsellers/', p_partkey, '/z">mais</a>') else '' end)"""))
    return found.withColumn("categories", F.array_join("categories", " > "))
