"""Pages with many cards, cards whose windows overlap, and pages without any."""

import pytest
from pyspark.sql import functions as F

from souklens.operators import extract as x
from souklens.plans.registry import all_queries, runner


def page(spark, *htmls):
    return spark.createDataFrame(list(enumerate(htmls)), "page_id int, html string")


def ml_card(i):
    return f'{{"product_id":"MLB{10_000_000 + i}","title":{{"text":"Produto {i}"}},"price":{{"currency":"BRL","value":{i}.5}}}}' + " " * 250


def test_first_thirty_products_of_a_page(spark):
    many = "".join(ml_card(i) for i in range(36)) + ml_card(3)
    rows = x.extract_ml_products(page(spark, many, "".join(ml_card(i) for i in range(2)))).orderBy("page_id", "platform_id").collect()
    assert [(r.page_id, r.title) for r in rows] == [(0, f"Produto {i}") for i in range(30)] + [(1, "Produto 0"), (1, "Produto 1")]
    # A window reaches over later cards; the first price after the id counts.
    assert all(r.price == float(r.title.split()[1]) + 0.5 for r in rows if r.page_id == 0 and r.title != "Produto 0")


def test_windows_take_the_first_mention_and_overlap(spark):
    near = '<div data-asin="B000000001">' + "x" * 40 + '1.200+ comprados no último mês</div><div data-asin="B000000002">31 avaliações</div>'
    rows = {r.asin: (r.sales, r.reviews) for r in x.extract_amazon_cards(page(spark, near + '<i data-asin="B000000001"></i>')).collect()}
    assert rows == {"B000000001": (1200, 31), "B000000002": (1200, 31)}
    far = '<div data-asin="B000000001">5 comprados no mês</div>' + " " * 3000 + '<div data-asin="B000000002">7 ratings</div>'
    rows = {r.asin: (r.sales, r.reviews) for r in x.extract_amazon_cards(page(spark, far)).collect()}
    assert rows == {"B000000001": (5, None), "B000000002": (None, 7)}


def test_zip_lists_stop_after_twenty_and_pair_by_place(spark):
    title = "".join(f'<span class="elements-title-normal">Um produto {i:02d}</span>' for i in range(24))
    rows = x.extract_zip_lists(page(spark, title + "R$ 10,50 R$ 11,00")).orderBy("position").collect()
    assert [r.product_name for r in rows] == [f"Um produto {i:02d}" for i in range(20)]
    assert [r.price_low for r in rows[:3]] == [10.5, 11.0, None]


def test_result_cards_stop_after_twenty(spark):
    card = "".join(f'<div class="sm-offer-item"><a title="Produto numero {i}" href="//detail.1688.com/offer/{i}.html">a</a></div>' for i in range(23))
    rows = x.extract_1688_cards(page(spark, card)).collect()
    assert sorted(r.source_product_id for r in rows) == sorted(str(i) for i in range(20))


def test_sold_quantity_takes_the_last_mention(spark):
    text = "MLB12345678 <b>1.200 vendidos</b> MLB87654321 <i>3 vendidos</i> MLB12345678 <b>1.300 vendidos</b>"
    assert {r.platform_id: r.sales for r in x.extract_sold_quantity(page(spark, text)).collect()} == {"MLB12345678": 1300, "MLB87654321": 3}


@pytest.mark.parametrize("extractor", [
    x.extract_amazon_cards, x.extract_ml_cards, x.extract_ml_products, x.extract_amazon_grid, x.extract_movers, x.extract_product_page, x.extract_json_island,
    x.extract_zip_lists, x.extract_sold_quantity, x.extract_ml_grid, x.extract_1688_cards, x.extract_category_trail, x.asin_list])
def test_raw_pages_without_marketplace_markup(spark, extractor):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").unionByName(spark.createDataFrame([(-1, None, None), (-2, "", "")], "page_id long, url string, html string"))
    found = extractor(pages)
    per_page = found.groupBy("page_id").count().agg(F.max("count")).first()[0]
    assert "html" not in found.columns and (per_page is None or per_page >= 1)


def test_category_trail(spark):
    html = '<ul class="a-unordered-list a-breadcrumb"><li><a href="#">Casa</a></li><li><a> Cozinha  e\n mesa </a></li></ul><a href="/gp/bestsellers/kitchen/16957125">mais</a>'
    one, none = x.extract_category_trail(page(spark, html, "<p>")).orderBy("page_id").collect()
    assert (one.categories, one.bestsellers_url, one.node_id) == (["Casa", "Cozinha e mesa"], "https://www.amazon.com.br/gp/bestsellers/kitchen/16957125", "16957125")
    assert (none.categories, none.bestsellers_url, none.node_id) == ([], "", "")


@pytest.mark.parametrize("name", ["x01_extract_amazon_cards", "x04_extract_amazon_grid", "x06_extract_1688_blocks", "x07_extract_json_island", "x11_extract_movers", "x14_extract_ml_grid"])
def test_pages_of_one_compact_file_are_extracted_by_many_tasks(spark, name):
    """The table is one file of a few row groups; its rows must not stay in the one task that reads it."""
    out = runner(all_queries()[name])(spark, "/root/testdata/sf0.01")
    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert many > 1 and len(counts) > many // 2 and max(counts) < 0.7 * sum(counts)
