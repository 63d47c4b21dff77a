"""Values that the source application's own tests pin down, and the odd corners of its parsers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from souklens.functions import market as m, prices as p, sales_text as s, scores as sc, text as t, vectors as v
from souklens.functions.numbers import js_round, round_half_up, whole_days
from souklens.operators import extract as x
from souklens.operators.classify import detect_l1
from souklens.operators.listing import gate_columns


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x"))).head()[0]


@pytest.mark.parametrize("text,want", [
    ("R$ 1.234,56", 1234.56), ("R$ 99,90", 99.90), ("R$ 1.000", 1000.0), ("Grátis", None), ("", None), ("R$ 0,00", None), (None, None)])
def test_price_br_with_dot_groups(spark, text, want):
    got = one(spark, text, lambda c: p.parse_price_br(c, dot_groups=True).cast("double"))
    assert got == want


def test_price_br_plain_dot_is_decimal(spark):
    assert one(spark, "R$ 1.000", lambda c: p.parse_price_br(c).cast("double")) == 1.0


@pytest.mark.parametrize("text,want", [("$1,234.56", 1234.56), ("1,23", 1.23), ("1,234", 1234.0), ("1,234,567", 1234567.0), ("abc", None)])
def test_price_us(spark, text, want):
    assert one(spark, text, lambda c: p.parse_price_us(c).cast("double")) == want


@pytest.mark.parametrize("text,want", [
    ("agora em +9%", 9), ("300 %", 300), ("▲ 18% hoje", 18), ("-64%", -64), ("+2,050%", None), ("sem mudança", None), (" ", None), (None, None)])
def test_bsr_change(spark, text, want):
    assert one(spark, text, x.bsr_change) == want


def mover(asin, title, *rest):
    return f'<div class="zg-item" data-asin="{asin}"><a href="/dp/{asin}">{title}</a>{"".join(rest)}</div>'


# A grouped percentage is no number, the picture set wins over the plain source, and a card with nothing but a title stays.
MOVERS = mover(
    "B0CAFETEIR", "<h2>Cafeteira Italiana</h2>", '<span class="p13n-sc-price">R$ 1.208,00</span>', '<i class="a-icon-alt">4,1 de 5 estrelas</i>',
    '<a class="a-size-small" href="/product-reviews/B0CAFETEIR">20.417</a>', '<img src="https://images-amazon.com/a/cafe.jpg"/>', '<span class="a-color-success">+1,310%</span>',
) + mover(
    "B0GUARDACH", '<span class="_cDEzb_p13n-sc-css-line-clamp-3_g3dy1">Guarda-chuva</span>', '<span class="_cDEzb_p13n-sc-price_y2">R$ 37,05</span>',
    '<img src="https://images-amazon.com/a/small.jpg" srcset="https://images-amazon.com/a/wide.jpg 2x"/>', '<span class="a-color-price">+6%</span><span class="zg-bdg-text">#204</span>',
) + '<div class="zg-item" data-asin="B0VASODEBA"><a href="/dp/B0VASODEBA" title="Vaso de barro esmaltado"><span></span></a></div>'


def test_movers_page(spark):
    pages = spark.createDataFrame([(1, f'<div id="zg">{MOVERS}</div>')], "page int, html string")
    rows = {r.platform_id: r for r in x.extract_movers(pages).collect()}
    assert sorted(rows) == ["B0CAFETEIR", "B0GUARDACH", "B0VASODEBA"]
    a, b, c = (rows[k] for k in sorted(rows))
    assert (a.title, a.price, a.bsr_change, a.review_avg, a.review_count) == ("Cafeteira Italiana", 1208.0, None, 4.1, 20417)
    assert (b.title, b.bsr_change, b.bsr_rank) == ("Guarda-chuva", 6, 204) and b.image_url.endswith("wide.jpg")
    assert (c.title, c.price, c.bsr_change) == ("Vaso de barro esmaltado", None, None)


def test_text_score(spark):
    score = lambda title: one(spark, title, lambda c: sc.text_score("fone bluetooth", c))
    assert score("Fone Bluetooth TWS") == 100 and score("bluetooth fone") == 90 and score("fone de ouvido") == 75 and score("mesa") == 0


def test_composite_between(spark):
    got = spark.range(1).select(sc.composite_score(F.lit(80), F.lit(70), F.lit(60), F.lit(50))).head()[0]
    assert 60 < got < 80


def test_margin_range_pinned(spark):
    row = spark.createDataFrame([(15.0, "CNY", 149.9, "ml")], "source_price double, source_currency string, retail_price double, platform string")
    got = {r.quantity: r for r in m.margin_range(row, fees={"ml": 0.11}, to_brl={"CNY": 0.80, "USD": 5.10}).collect()}
    assert sorted(got) == [50, 200, 500]
    assert got[200].margin_pct == 73.0 and got[200].import_factor == 3.0 and got[200].platform_fee_rate == 0.11


@pytest.mark.parametrize("country,quantity,want", [("BR", 50, 3.5), ("BR", 201, 2.6), ("US", 100, 2.3), ("XX", 60, 3.0), ("BR", 0, 3.5)])
def test_import_factor(spark, country, quantity, want):
    assert spark.range(1).select(m.factor_for(F.lit(country), F.lit(quantity))).head()[0] == want


def test_currency(spark):
    got = spark.range(1).select(p.to_brl(F.lit(100.0), F.lit("CNY"), {"CNY": 0.8, "USD": 5.1}), p.to_brl(F.lit(100.0), F.lit("USD"), {"USD": 5.1}),
                                p.to_brl(F.lit(0.0), F.lit("USD")), p.to_brl(F.lit(7.0), F.lit("JPY"))).head()
    assert tuple(got) == (80.0, 510.0, None, 7.0)


def test_sales_texts(spark):
    assert one(spark, "1,5 milhão vendidos", s.parse_sales_pt) == 1_500_000
    assert one(spark, "5 mil vendidos", s.parse_sales_pt) == 5000
    assert one(spark, "1.4K+", s.parse_sold) == 1400
    assert one(spark, "热销1.2万+", s.format_sales) == "12,000+"
    assert one(spark, 12345, s.sales_badge, "long") == "热销1.2万+"
    assert one(spark, '<p id="pqv-bought-in-last-month">300+ bought in past week</p>', s.parse_bought) == 1290


def test_sequential_replacement_is_longest_first(spark):
    table = {"蓝牙": "bluetooth", "耳机": "fone", "牙耳": "X", "蓝牙耳机": "fone bluetooth"}
    assert one(spark, "蓝牙耳机", lambda c: t.translate_cn_pt(c, table)) == "fone bluetooth"
    assert one(spark, "蓝牙耳", lambda c: t.translate_cn_pt(c, table)) == "bluetooth耳"
    assert one(spark, "plain", lambda c: t.translate_cn_pt(c, table)) == "plain"


def test_json_strings(spark):
    assert one(spark, '["a", 1, null, {"b": 2}, "c"]', t.json_strings) == ["a", "c"]
    assert one(spark, "not json", t.json_strings) == [] and one(spark, '{"a": "b"}', t.json_strings) == []


def test_urls(spark):
    got = one(spark, "https://www.amazon.com.br/dp/B0ABC?x=1", t.parse_product_url)
    assert tuple(got) == ("amazon_br", "B0ABC")
    assert one(spark, "https://cbu01.alicdn.com/x.jpg", t.allowed_host) and not one(spark, "https://evil.example/alicdn.com", t.allowed_host)


def test_rounding(spark):
    assert one(spark, 2.675, lambda c: round_half_up(c, 2), "double") == 2.68
    assert one(spark, -2.5, js_round, "double") == -2


def test_whole_days_are_24_hours(spark):
    a, b = dt.datetime(2024, 1, 1, 1), dt.datetime(2024, 1, 2, 3)
    df = spark.createDataFrame([(a, b), (b, a)], "a timestamp, b timestamp")
    assert [r[0] for r in df.select(whole_days("b", "a")).collect()] == [1, -1]


def test_hash_bits(spark):
    assert one(spark, [4.0, 1.0, 3.0, 2.0], v.phash_bits, "array<double>") == [1, 0, 0, 0]
    assert one(spark, [3.0, 1.0, 2.0, 5.0, 5.0, 4.0], lambda c: v.dhash_bits(c, 3), "array<double>") == [1, 0, 0, 1]


def test_regions_similarity_divides_by_256(spark):
    df = spark.createDataFrame([([[1, 0], [1, 1]], [[1, 1], [1, 1]])], "a array<array<int>>, b array<array<int>>")
    assert df.select(v.regions_similarity("a", "b")).head()[0] == pytest.approx(1 - 1 / 512)


def test_gate_columns(spark):
    df = spark.createDataFrame([(1, 2.0)], "id int, trend_score double")
    free = gate_columns(df, False)
    assert free.columns == ["id", "_premium_locked", "_gated_fields"] and free.head()._gated_fields == ["trend_score"]
    assert gate_columns(df, True).head()._premium_locked is False


@pytest.mark.parametrize("title,want", [
    ("Fone de Ouvido Bluetooth", "Audio"), ("Suporte Celular Carro", "Acessórios Mobile"), ("Mochila Escolar Infantil", "Bolsas"),
    ("Panela de Pressão 5L", "Cozinha"), ("MEIAS CANO ALTO", "Meias"), ("Suporte Câmera DSLR", "Fotografia"), ("xyz", None), (None, None)])
def test_l1_rules(spark, title, want):
    df = spark.createDataFrame([(title,)], "title string")
    assert detect_l1(df).head().detected_l1 == want
