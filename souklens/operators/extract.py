"""Rows out of stored listing pages: HTML cards, markdown blocks and embedded JSON.

Each extractor takes a DataFrame of pages and gives one row per card with the page's own columns. All of
it is regular expressions and JSON functions inside Spark; a page is read whole.
"""

from __future__ import annotations

import html as html_entities

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from souklens.functions.numbers import col
from souklens.functions.prices import number_list, parse_price_br, parse_price_us
from souklens.functions.sales_text import counted, grouped_number, parse_sales_pt, parse_sold, whole
from souklens.functions.text import clean_text, extract, extract_all, pattern, translate_cn_pt


@F.pandas_udf(T.StringType())
def unescape_html(texts: pd.Series) -> pd.Series:
    """Character references to text; only titles pass through here."""
    return texts.map(lambda t: None if t is None else html_entities.unescape(t))


def around(html: Column | str, marker: Column, before: int, after: int) -> Column:
    """The page from ``before`` characters ahead of the marker's first occurrence to ``after`` past its start."""
    at = F.locate(marker, col(html)) if isinstance(marker, str) else F.call_function("locate", marker, col(html))
    start = F.greatest(at - before, F.lit(1))
    return F.substring(col(html), start, at + after - start)


def _windows(pages: DataFrame, html: str, ids: Column, name: str, before: int, after: int, head: str = "", tail: str = "") -> DataFrame:
    """One row per distinct id with the window round its first mention in column _b. The windows are cut while the page
    is at hand, so the rows carry them and not the page."""
    marker = lambda i: F.concat(F.lit(head), i, F.lit(tail))
    cut = F.transform(F.array_distinct(ids), lambda i: F.struct(i.alias("id"), around(html, marker(i), before, after).alias("b")))
    rest = [c for c in pages.columns if c not in (html, name)]
    return pages.select(*rest, F.explode(cut).alias("_w")).select(*rest, F.col("_w.id").alias(name), F.col("_w.b").alias("_b"))


def _absolute(url: Column, host: str) -> Column:
    return F.when(url.startswith("http"), url).when(url.startswith("//"), F.concat(F.lit("https:"), url)).when(
        url.isNotNull(), F.concat(F.lit(host), url))


def last_segment(url: Column) -> Column:
    """Last path segment up to '.html'."""
    return F.substring_index(F.element_at(F.split(url, "/"), -1), ".html", 1)


def extract_amazon_cards(pages: DataFrame, html: str = "html") -> DataFrame:
    """Sales and review counts near every product id of a bestseller page; cards with neither are dropped."""
    cards = _windows(pages, html, extract_all(html, r'data-asin="([A-Z0-9]{10})"'), "asin", 500, 2000, 'data-asin="', '"')
    sales = counted("_b", r"([\d,.]+)\s*\+?\s*(?:comprad|bought|adquirid).*?(?:mês|month)")
    reviews = counted("_b", r"([\d,.]+)\s*(?:avaliaç|ratings|reviews)")
    found = cards.withColumns({"sales": sales, "reviews": reviews}).drop("_b")
    return found.where((F.coalesce("sales", F.lit(0)) != 0) | (F.coalesce("reviews", F.lit(0)) != 0))


def asin_list(pages: DataFrame, html: str = "html") -> DataFrame:
    """Distinct product ids of a page in page order."""
    ids = F.array_distinct(extract_all(html, r'data-asin="([A-Z0-9]{10})"'))
    return pages.select("*", F.posexplode(ids).alias("position", "asin")).drop(html)


def extract_ml_cards(pages: DataFrame, html: str = "html") -> DataFrame:
    """Lifetime sales and price near every Mercado Livre id; cards without sales are dropped."""
    named = extract_all(html, r'"product_id":"(MLB\d+)"')
    bare = F.transform(extract_all(html, r"MLB(\d{8,})"), lambda x: F.concat(F.lit("MLB"), x))
    cards = _windows(pages, html, F.when(F.size(named) > 0, named).otherwise(bare), "platform_id", 500, 3000)
    sales = counted("_b", r"([\d,.]+)\s*(mil|milhão|mi|k)?\s*(?:produtos?\s+)?vendidos", 2)
    price = extract("_b", r'"current_price":\{"value":([\d.]+)').try_cast("double")
    return cards.withColumns({"sales": sales, "price": price}).drop("_b").where(F.col("sales") != 0)


def extract_ml_products(pages: DataFrame, n: int = 30, html: str = "html") -> DataFrame:
    """Title, price, URL and image of the first ``n`` products of a page; rows without a title are dropped."""
    ids = F.slice(F.array_distinct(extract_all(html, r'"product_id":"(MLB\d+)"')), 1, n)
    b = _windows(pages, html, ids, "platform_id", 200, 3000, '"product_id":"', '"')
    price = F.coalesce(
        extract("_b", r'"current_price":\{"value":([\d.]+)'), extract("_b", r'"price":\{[^}]*?"value":([\d.]+)')
    ).try_cast("double")
    raw = F.replace(extract("_b", r'"url":"((?:https?://)?www\.mercadolivre\.com\.br[^"]+)"'), F.lit("\\u002F"), F.lit("/"))
    url = F.when(raw.startswith("http"), raw).otherwise(F.concat(F.lit("https://"), raw))
    picture = extract("_b", r'"pictures":\{"scale":"[^"]+","pictures":\[\{"id":"([^"]+)"')
    title = extract("_b", r'"title":\{"text":"([^"]+)"')
    rows = b.withColumn("_t", title).where(F.col("_t").isNotNull())
    return rows.withColumns({
        "title": unescape_html("_t"), "price": F.coalesce(price, F.lit(0.0)), "currency": F.lit("BRL"),
        "url": F.coalesce(url, F.concat(F.lit("https://www.mercadolivre.com.br/p/"), F.col("platform_id"))),
        "image_url": F.concat(F.lit("https://http2.mlstatic.com/D_Q_NP_2X_"), picture, F.lit("-AB.webp")),
    }).drop("_b", "_t")


def _blocks(pages: DataFrame, html: str, start: str, name: str = "_b") -> DataFrame:
    """One row per part of a page that begins where ``start`` matches."""
    parts = F.split(col(html), pattern(rf"(?={start})"))
    cards = F.filter(parts, lambda p: p.rlike(pattern(rf"^{start}")))
    return pages.select("*", F.posexplode(cards).alias("position", name)).drop(html)


def _text_of(block: str, tag: str) -> Column:
    """Cleaned text right after an opening tag."""
    found = F.regexp_extract(col(block), pattern(tag + r"[^>]*>\s*([^<]+?)\s*<"), 1)
    return F.nullif(clean_text(found), F.lit(""))


def _classed(*names: str) -> str:
    return r'class="[^"]*(?:' + "|".join(names) + r')[^"]*"'


def _with_card_fields(cards: DataFrame, market: str) -> DataFrame:
    """Title, price, image, rating, reviews and rank of the card in ``_b``.

    Raw texts become columns first: what is parsed out of them refers to them several times.
    """
    br = market == "amazon_br"
    b = "_b"
    hosts = r"(?:images-amazon|media-amazon)"
    title = F.coalesce(
        _text_of(b, _classed("p13n-sc-truncate-desktop-type2", "_cDEzb_p13n-sc-css-line-clamp-3_g3dy1")),
        _text_of(b, r'<a[^>]*class="[^"]*a-link-normal[^"]*"[^>]*>\s*<span(?:[^>]*>\s*<div)?'),
        _text_of(b, "<h2"),
        F.nullif(clean_text(extract(b, r'<a[^>]*href="[^"]*/dp/[^"]*"[^>]*\stitle="([^"]+)"')), F.lit("")),
        F.nullif(clean_text(extract(b, r'<a[^>]*\stitle="([^"]+)"[^>]*href="[^"]*/dp/')), F.lit("")),
    )
    raw = cards.withColumns({
        "title": title, "_price": _text_of(b, _classed("p13n-sc-price", "a-offscreen")),
        "_src": extract(b, rf'<img[^>]*\ssrc="([^"]*{hosts}[^"]*)"'), "_set": extract(b, r'<img[^>]*\ssrcset="([^"]*)"'),
        "_stars": F.coalesce(_text_of(b, _classed("a-icon-alt")), extract(b, r'aria-label="([^"]*estrela[^"]*)"')),
        "_reviews": _text_of(b, r'<a[^>]*href="[^"]*(?:customerReviews|product-reviews)[^"]*"'),
        "_rank": _text_of(b, _classed("zg-bdg-text")),
    }).where(F.col("title").isNotNull())
    sources = F.transform(F.split("_set", ","), lambda s: F.split(F.trim(s), r"\s+")[0])
    largest = F.try_element_at(F.filter(sources, lambda s: s.rlike(hosts)), F.lit(-1))
    digits = lambda c: extract(F.regexp_replace(c, "[.,#]", ""), r"(\d+)").try_cast("bigint")
    return raw.withColumns({
        "price": (parse_price_br("_price", dot_groups=True) if br else parse_price_us("_price")).cast("double"),
        "image_url": F.when(F.col("_src").isNotNull(), F.coalesce(largest, F.col("_src"))),
        "review_avg": F.replace(extract("_stars", r"(\d[.,]\d)"), F.lit(","), F.lit(".")).try_cast("double"),
        "review_count": F.coalesce(digits("_reviews"), F.lit(0)), "bsr_rank": digits("_rank"),
    }).drop("_price", "_src", "_set", "_stars", "_reviews", "_rank")


ASIN_TAG = r'<[a-z]+[^>]*\sdata-asin="'


def extract_amazon_grid(pages: DataFrame, market: str = "amazon_br", html: str = "html") -> DataFrame:
    """Cards of a bestseller grid: title, price, largest image, rating, reviews, rank. Cards without a title are dropped."""
    cards = _blocks(pages, html, ASIN_TAG).withColumn("platform_id", extract("_b", r'data-asin="\s*([^"\s]{10,})\s*"'))
    cards = _with_card_fields(cards.where(F.col("platform_id").isNotNull()), market)
    site = "https://www.amazon.com.br/dp/" if market == "amazon_br" else "https://www.amazon.com/dp/"
    return cards.withColumns({
        "platform": F.lit(market), "currency": F.lit("BRL" if market == "amazon_br" else "USD"),
        "url": F.concat(F.lit(site), F.col("platform_id")),
    }).drop("_b")


def bsr_change(text: Column | str) -> Column:
    """Signed percentage of at most four digits; a longer or grouped number gives NULL."""
    return extract(text, r"(?<![\d,.])([+-]?\d{1,4})\s*%").try_cast("int")


def extract_movers(pages: DataFrame, market: str = "amazon_br", category: str = "movers_and_shakers", html: str = "html") -> DataFrame:
    """Grid cards of a movers page with the change of rank."""
    cards = _blocks(pages, html, ASIN_TAG).withColumn("platform_id", extract("_b", r'data-asin="\s*([^"\s]{10,})\s*"'))
    cards = _with_card_fields(cards.where(F.col("platform_id").isNotNull()), market)
    return cards.withColumns({
        "bsr_change": bsr_change(F.regexp_replace("_b", "<[^>]*>", " ")),
        "platform": F.lit(market), "category": F.lit(category),
    }).drop("_b")


def extract_product_page(pages: DataFrame, market: str = "amazon_br", html: str = "html") -> DataFrame:
    """Price, last month's sales, reviews, rating and image of a product page; NULL where the page does not say."""
    br = market == "amazon_br"
    price = _text_of(html, r'(?:id="(?:priceblock_ourprice|priceblock_dealprice|price_inside_buybox)"|' + _classed("a-offscreen") + ")")
    proof = extract(html, r'(?:social-proofing-faceout-title-tk_bought|data-feature-name="socialProofing")[^>]*>(?:\s*<span[^>]*>)*\s*([^<]+)<')
    sales = extract(proof, r"([\d.,]+)\+?\s*(?:compraram|bought|vendidos)", 1, True)
    reviews = F.regexp_replace(_text_of(html, r'id="acrCustomerReviewText"'), "[.,]", "")
    rating = extract(F.coalesce(
        _text_of(html, r'id="acrPopover"[\s\S]*?' + _classed("a-icon-alt")), _text_of(html, r'data-hook="rating-out-of-text"')), r"(\d[.,]\d)")
    image = F.coalesce(extract(html, r'<img[^>]*id="(?:landingImage|imgBlkFront|main-image)"[^>]*data-old-hires="([^"]+)"'),
                       extract(html, r'<img[^>]*id="(?:landingImage|imgBlkFront|main-image)"[^>]*\ssrc="([^"]+)"'))
    return pages.withColumns({"_price": price, "_image": image}).withColumns({
        "price": (parse_price_br("_price") if br else parse_price_us("_price")).cast("double"),
        "sales_30d": F.regexp_replace(sales, "[.,]", "").try_cast("bigint"),
        "review_count": extract(reviews, r"(\d+)").try_cast("bigint"),
        "review_avg": F.replace(rating, F.lit(","), F.lit(".")).try_cast("double"),
        "image_url": F.when(F.contains(F.col("_image"), F.lit("images-amazon")), F.col("_image")),
    }).drop(html, "_price", "_image")


def extract_1688_blocks(pages: DataFrame, n: int, text: str = "markdown") -> DataFrame:
    """Products of a search page in markdown: a block starts at '[Image k]', needs a price and a title or an id,
    and the first ``n`` of a page are kept."""
    from souklens.functions.sales_text import parse_sales_volume

    def product(b: Column, i: Column) -> Column:
        title = F.coalesce(extract(b, r"物流时效\s*[\d.]+\s+([^\n]{4,150})"), extract(b, r"!\[.*?\]\(.*?\)\s+(.+?)\s*¥"))
        return F.struct(
            i.alias("block"), F.coalesce(extract(b, r"offerId[s=](\d{10,19})"), F.lit("")).alias("offer_id"),
            F.coalesce(F.trim(F.regexp_replace(F.trim(title), r"\s*¥[^\n]*$", "")), F.lit("")).alias("title"),
            extract(b, r"¥\s*([\d.]+)").try_cast("double").alias("price_cny"),
            F.coalesce(F.trim(extract(b, r"\[([^\[\]]{2,60})\]\(https?://shop[\w.-]+\.1688\.com/", 1, True)), F.lit("")).alias("supplier_name"),
            F.coalesce(extract(b, r"(https://cbu01\.alicdn\.com/img/ibank/[^\s\"')]+\.(?:jpg|jpeg|png|webp))", 1, True), F.lit("")).alias("image_url"),
            F.coalesce(F.concat(extract(b, r"(\d+)\s*件起批"), F.lit(" pieces")), F.lit("N/A")).alias("moq"),
            parse_sales_volume(extract(b, r"([\d.]+[万千百]?\+?件)")).alias("sales_volume_estimate"))

    blocks = F.transform(F.split(col(text), r"(?=\[Image \d+\])"), product)
    kept = F.slice(F.filter(blocks, lambda p: p["price_cny"].isNotNull() & ((p["title"] != "") | (p["offer_id"] != ""))), 1, n)
    rest = [c for c in pages.columns if c != text]
    return pages.select(*rest, F.explode(kept).alias("_p")).select(*rest, "_p.*")


def _product_list(props: Column) -> Column:
    """JSON text of the page's product list: productList, data.productList, else the first list of more than
    three product-like items at the top or one level below."""
    direct = F.coalesce(F.get_json_object(props, "$.productList"), F.get_json_object(props, "$.data.productList"))
    texts = "map<string,string>"
    values = F.map_values(F.from_json(props, texts))
    nested = F.transform(values, lambda v: F.concat(
        F.array(v), F.coalesce(F.map_values(F.from_json(v, texts)), F.array().cast("array<string>"))))
    likely = F.filter(F.flatten(nested), lambda v: v.startswith("[") & (F.size(F.from_json(v, "array<string>")) > 3) & (
        F.get_json_object(v, "$[0].productname").isNotNull() | F.get_json_object(v, "$[0].itemcode").isNotNull()))
    return F.coalesce(direct, F.get(likely, F.lit(0)))


def extract_json_island(pages: DataFrame, html: str = "html") -> DataFrame:
    """Products of a page's embedded JSON state in the unified record shape."""
    state = extract(html, r'<script id="__NEXT_DATA__" type="application/json">([\s\S]*?)</script>')
    items = F.from_json(_product_list(F.get_json_object(state, "$.props.pageProps")), "array<map<string,string>>")
    rows = pages.select(*[c for c in pages.columns if c != html], F.posexplode(items).alias("position", "_i"))
    g = lambda k: F.col("_i")[k]
    nums = number_list(F.coalesce(g("pricebeforerate"), g("simHighPrice")))
    url = g("productDetailUrl")
    return rows.withColumns({
        "source_platform": F.lit("dhgate"), "source_product_id": F.coalesce(g("itemcode"), F.lit("")),
        "source_url": F.coalesce(F.when(url.startswith("/"), F.concat(F.lit("https://www.dhgate.com"), url)).otherwise(url), F.lit("")),
        "product_name": F.coalesce(g("productname"), F.lit("")), "price_low": F.get(nums, F.lit(0)), "price_high": F.get(nums, F.lit(1)),
        "price_currency": F.lit("USD"), "seller_name": F.coalesce(g("domainname"), F.lit("")),
        "seller_id": F.coalesce(g("supplierid"), F.lit("")),
        "seller_rating": F.replace(g("feedBackPercent"), F.lit("%"), F.lit("")).try_cast("double"),
        "moq": F.nullif(g("minOrderNum").try_cast("int"), F.lit(0)),
        "image_url": F.coalesce(g("seo300ImagePath"), g("bigimagepath"), F.lit("")),
        "monthly_sales": parse_sold(g("recentlysold")), "review_count": F.nullif(g("reviewCount").try_cast("int"), F.lit(0)),
    }).drop("_i")


SEARCH_ITEMS = """struct<data: struct<content: array<struct<
    iid: string, title: string, titleC: string, price: string, picurl: string, goods_link: string, shopname: string,
    monthSold: string, repurchaseRate: string, tradeScore: string, topCategoryId: array<string>,
    secondCategoryId: array<string>, thirdCategoryId: array<string>, sellerIdentities: array<string>,
    shopInfo: struct<address: string>, createDate: string, modifyDate: string>>>>"""


def flatten_search_items(responses: DataFrame, source: str, json: str = "json", dictionary: dict[str, str] | None = None) -> DataFrame:
    """Items of a search response in the unified shape; ``dictionary`` translates Chinese titles."""
    content = F.from_json(col(json), SEARCH_ITEMS)["data"]["content"]
    rows = responses.select(*[c for c in responses.columns if c != json], F.posexplode(content).alias("position", "i"))
    i = lambda k: F.col(f"i.{k}")
    title = F.coalesce(i("title"), F.lit(""))
    rate, image = i("repurchaseRate"), F.coalesce(i("picurl"), F.lit(""))
    return rows.withColumns({
        "source_platform": F.lit(f"rakumart-{source}"), "source_product_id": F.coalesce(i("iid"), F.lit("")),
        "source_url": F.coalesce(F.nullif(i("goods_link"), F.lit("")), F.concat(F.lit("https://www.rakumart.com.br/product/"), F.coalesce(i("iid"), F.lit("")))),
        "product_name": translate_cn_pt(title, dictionary) if dictionary else title,
        "price_low": F.get(number_list(i("price")), F.lit(0)), "price_currency": F.lit("BRL"),
        "seller_name": F.coalesce(i("shopname"), F.lit("")),
        "image_url": F.when((image != "") & ~image.startswith("http"), F.concat(F.lit("https:"), image)).otherwise(image),
        "monthly_sales": whole(i("monthSold").try_cast("double")),
        "repurchase_rate": F.when(rate.isNotNull() & ~rate.isin("", "0"), F.concat(rate, F.lit("%"))).otherwise(""),
        "title_cn": F.coalesce(i("titleC"), F.lit("")), "top_category_id": F.get(i("topCategoryId"), F.lit(0)),
        "second_category_id": F.get(i("secondCategoryId"), F.lit(0)), "third_category_id": F.get(i("thirdCategoryId"), F.lit(0)),
        "trade_score": F.nullif(i("tradeScore").try_cast("double"), F.lit(0.0)),
        "shop_address": F.coalesce(i("shopInfo.address"), F.lit("")),
        "seller_identities": F.coalesce(i("sellerIdentities"), F.array().cast("array<string>")),
        "create_date": i("createDate"), "modify_date": i("modifyDate"),
    }).drop("i")


SKU_MODEL = """struct<skuProps: array<struct<prop: string, value: array<struct<name: string, imageUrl: string>>>>,
    skuInfoMap: map<string, struct<price: string, discountPrice: string, skuId: string, specId: string, canBookCount: string>>>"""


def flatten_sku_model(pages: DataFrame, json: str = "json") -> DataFrame:
    """Main specification, property lists, model names, variant prices and video of a product's state."""
    text = col(json)
    sku = F.from_json(F.get_json_object(text, "$.result.data.Root.fields.dataJson.skuModel"), SKU_MODEL)
    rows = pages.withColumn("_s", sku)
    props, info = F.col("_s.skuProps"), F.col("_s.skuInfoMap")
    lines = F.transform(props, lambda p: F.concat(p["prop"], F.lit(": "), F.array_join(p["value"]["name"], ", ")))
    names = F.map_keys(info)
    return rows.withColumns({
        "main_spec": F.when(F.size(props) > 0, F.array_join(lines, "; ")).otherwise(F.get(names, F.lit(0))),
        "specifications": F.when(F.size(props) > 0, F.transform(props, lambda p: F.struct(p["prop"].alias("property"), p["value"].alias("values")))),
        "models": F.when(F.size(names) > 0, names), "variant_prices": F.when(F.size(names) > 0, info),
        "video_url": F.nullif(F.get_json_object(text, "$.result.data.gallery.fields.video.videoUrl"), F.lit("")),
    }).drop("_s", json)


def extract_zip_lists(pages: DataFrame, n: int = 20, html: str = "html") -> DataFrame:
    """Titles, prices, images and links of a page paired by position; short titles are dropped, a missing partner is NULL."""
    lists = F.arrays_zip(
        F.slice(extract_all(html, r'class="elements-title[^"]*"[^>]*>([^<]+)</span>', 1, True), 1, n).alias("title"),
        extract_all(html, r"R\$\s*([\d.,]+)", 1, True).alias("price"),
        extract_all(html, r'<img[^>]+src="([^"]+\.jpg[^"]*)"', 1, True).alias("image"),
        extract_all(html, r'href="([^"]*product-detail[^"]*)"', 1, True).alias("link"),
    )
    rows = pages.select(*[c for c in pages.columns if c != html], F.posexplode(lists).alias("position", "z"))
    title, link = F.trim(F.col("z.title")), F.col("z.link")
    site = "https://www.alibaba.com"
    return rows.where(F.length(title) >= 10).select(
        *[c for c in pages.columns if c != html], "position",
        F.coalesce(last_segment(link), F.col("position").cast("string")).alias("source_product_id"),
        F.coalesce(F.when(link.startswith("http"), link).otherwise(F.concat(F.lit(site), link)), F.lit("")).alias("source_url"),
        title.alias("product_name"), grouped_number(F.col("z.price")).alias("price_low"),
        F.coalesce(_absolute(F.col("z.image"), site), F.lit("")).alias("image_url"),
    )


def extract_sold_quantity(pages: DataFrame, html: str = "html") -> DataFrame:
    """Sold quantity per Mercado Livre id: structured cards, else an id followed by 'N vendidos'; the last mention wins."""
    card = r'"permalink":"[^"]*?(MLB\d+)"[^}]*?"sold_quantity":(\d+)'
    text = r"(MLB\d+)[\s\S]*?(\d[\d.,]*)\+?\s*vendidos?"
    pairs = lambda regex, ic: F.arrays_zip(extract_all(html, regex, 1, ic).alias("id"), extract_all(html, regex, 2, ic).alias("n"))
    structured = pairs(card, False)
    found = F.when(F.size(structured) > 0, structured).otherwise(pairs(text, True))
    keys = [c for c in pages.columns if c != html]
    # The last mention of an id: the list is turned round, and an id is kept at its first place there.
    turned = F.reverse(found)
    last = F.filter(turned, lambda z, i: F.array_position(turned["id"], z["id"]) == i + 1)
    n = F.regexp_replace(F.col("z.n"), "[.,]", "").try_cast("bigint")
    return pages.select(*keys, F.explode(last).alias("z")).select(*keys, F.col("z.id").alias("platform_id"), n.alias("sales"))


def extract_ml_grid(pages: DataFrame, html: str = "html") -> DataFrame:
    """Cards of a Mercado Livre listing grid; title and price are required."""
    cards = _blocks(pages, html, r'<li[^>]*class="[^"]*ui-search-layout')
    number = extract("_b", r'<a[^>]*href="[^"]*/p/MLB-?(\d{8,})')
    title = F.coalesce(_text_of("_b", "<h2"), _text_of("_b", _classed("title")))
    price = F.coalesce(_text_of("_b", _classed("andes-money-amount__fraction")), _text_of("_b", _classed("price") + r"[^>]*>\s*<span"))
    raw = cards.withColumns({
        "platform_id": F.concat(F.lit("MLB"), number), "title": title, "_price": price,
        "image_url": F.coalesce(extract("_b", r'<img[^>]*\ssrc="([^"]*)"'), F.lit("")),
        "_plain": F.regexp_replace("_b", "<[^>]*>", "|"),
    })
    whole_cards = raw.where(F.col("platform_id").isNotNull() & F.col("title").isNotNull())
    rows = whole_cards.withColumns({
        "price": parse_price_br("_price", dot_groups=True).cast("double"), "sales_30d": parse_sales_pt("_plain"),
    }).drop("_b", "_price", "_plain")
    return rows.where(F.col("price").isNotNull()).withColumns({
        "platform": F.lit("ml"), "currency": F.lit("BRL"),
        "url": F.concat(F.lit("https://www.mercadolivre.com.br/produto/"), F.col("platform_id")),
    })


def extract_1688_cards(pages: DataFrame, n: int = 20, html: str = "html") -> DataFrame:
    """Result cards of a stored 1688 page: title of more than five characters, first number as price, image, detail link."""
    cards = _blocks(pages, html, r'<[a-z]+[^>]*class="[^"]*(?:sm-offer-item|offer-list-row)[^"]*"').where(F.col("position") < n)
    title = F.coalesce(F.nullif(extract("_b", r'<a[^>]*\stitle="([^"]+)"'), F.lit("")), _text_of("_b", _classed("offer-title", "title")))
    link = _absolute(extract("_b", r'<a[^>]*href="([^"]*detail\.1688\.com[^"]*)"'), "https:")
    rows = cards.withColumns({"_t": title, "_link": link}).withColumns({
        "source_url": F.coalesce("_link", F.lit("")),
        "source_product_id": F.coalesce(last_segment(F.col("_link")), F.col("position").cast("string")),
        "price_low": extract(_text_of("_b", _classed("sm-offer-priceNum", "price")), r"([\d.]+)").try_cast("double"),
        "image_url": F.coalesce(_absolute(extract("_b", r'<img[^>]*\ssrc="([^"]*)"'), "https:"), F.lit("")),
        "source_platform": F.lit("1688-direct"), "price_currency": F.lit("CNY"),
    }).drop("_b", "_link")
    return rows.where(F.length("_t") > 5).withColumn("product_name", F.substring("_t", 1, 200)).drop("_t")


def extract_category_trail(pages: DataFrame, market: str = "amazon_br", html: str = "html") -> DataFrame:
    """Category names of a product page's breadcrumb in page order, its bestseller link and the node number in that link.

    A page without a breadcrumb has an empty trail; without a bestseller link both other columns are empty.
    """
    crumb = r'(?s)<(?:div|ul|nav|ol)[^>]*(?:id="wayfinding-breadcrumbs_container"|class="[^"]*(?:a-breadcrumb|andes-breadcrumb)[^"]*")[^>]*>(.*?)</(?:div|ul|nav|ol)>'
    names = F.transform(extract_all(extract(html, crumb), r"(?s)<a[^>]*>(.*?)</a>"), lambda a: F.trim(F.regexp_replace(F.regexp_replace(a, "<[^>]*>", " "), r"\s+", " ")))
    link = extract(html, r'<a[^>]*href="([^"]*bestsellers[^"]*)"')
    host = "https://www.amazon.com.br" if market == "amazon_br" else "https://www.amazon.com"
    url = F.when(link.startswith("/"), F.concat(F.lit(host), link)).otherwise(F.coalesce(link, F.lit("")))
    return pages.withColumns({
        "categories": F.coalesce(F.filter(names, lambda n: n != ""), F.array().cast("array<string>")),
        "bestsellers_url": url, "node_id": F.coalesce(extract(link, r"/(\d+)"), F.lit(""))}).drop(html)
