"""Sales counts out of Portuguese, English and Chinese texts, and back into badges."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from souklens.functions.numbers import col, js_round
from souklens.functions.text import extract, pattern

UNIT = r"(mil|milhão|mi|k)?"


def grouped_number(text: Column) -> Column:
    """'1.234,5' to 1234.5: dots group, the comma is the decimal sign; NULL if it is no number."""
    return F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def unit_factor(unit: Column) -> Column:
    u = F.lower(unit)
    return F.when(u.isin("mil", "k"), 1e3).when(u.isin("milhão", "mi"), 1e6).otherwise(1.0)


def whole(c: Column) -> Column:
    return c.cast("bigint")


def counted(text: Column | str, regex: str, unit: int | None = None) -> Column:
    """Number in group 1 of the first match, times the unit word in group ``unit``."""
    n = grouped_number(extract(text, regex, 1, True))
    if unit is not None:
        n = n * unit_factor(F.regexp_extract(col(text), pattern(regex, True), unit))
    return whole(n)


def parse_sales_pt(c: Column | str) -> Column:
    """'5 mil vendidos', '1,2 milhão vendas', '300 compras'."""
    return counted(c, r"([\d,.]+)\s*(mil|milhão|mi)?\s*(?:vendidos|vendas|compras|compraram)", 2)


def parse_sales_30d(html: Column | str) -> Column:
    """Last month's sales in a product page; spaces written as entities or across two spans are joined first."""
    h = col(html)
    joined = F.regexp_replace(F.replace(h, F.lit("&nbsp;"), F.lit(" ")), pattern(r"</span>\s*<span[^>]*>\s*"), " ")
    month = r"compras?\s+no\s+m[êe]s\s+passado"
    thousands = grouped_number(extract(joined, rf"mais de\s+([\d.,]+)\s+mil\s+{month}", 1, True)) * 1000
    plain = grouped_number(extract(joined, rf"mais de\s+([\d.,]+)\s+{month}", 1, True))
    english = F.replace(extract(h, r"([\d,]+)\+?\s+bought\s+in\s+past\s+month", 1, True), F.lit(","), F.lit("")).try_cast("double")
    return whole(F.coalesce(thousands, plain, english))


def parse_sales_cn(c: Column | str) -> Column:
    """'1.2万' to 12000; otherwise the digits; 0 without any."""
    wan = extract(c, r"([\d.]+)\s*万").try_cast("double") * 10000
    digits = F.nullif(F.regexp_replace(col(c), "[^0-9]", ""), F.lit("")).try_cast("double")
    return F.coalesce(wan, digits, F.lit(0.0))


def parse_sales_volume(c: Column | str) -> Column:
    """First number with an optional 万, 千 or 百, rounded."""
    regex = r"([\d.]+)([万千百])?"
    unit = F.regexp_extract(col(c), regex, 2)
    factor = F.when(unit == "万", 1e4).when(unit == "千", 1e3).when(unit == "百", 1e2).otherwise(1.0)
    return js_round(extract(c, regex).try_cast("double") * factor)


def format_sales(c: Column | str) -> Column:
    """'热销1.2万+' to '12,000+'; plain counts lose the prefix only; other texts stay."""
    text = col(c)
    bare = F.regexp_replace(text, "^热销", "")
    wan = r"^(\d+(?:\.\d+)?)万(\+?)$"
    amount = F.format_number(js_round(F.regexp_extract(bare, wan, 1).try_cast("double") * 10000), 0)
    return (
        F.when(text.isNull() | (F.trim(text) == ""), F.lit(None).cast("string"))
        .when(bare.rlike(wan), F.concat(amount, F.regexp_extract(bare, wan, 2)))
        .when(bare.rlike(r"^\d+\+?$"), bare).otherwise(text)
    )


def sales_badge(n: Column | str) -> Column:
    """'热销1.2万+' from ten thousand on, '热销{n}+' below."""
    v = col(n)
    tens = F.format_string("%.1f", F.round((v / 10000).cast("decimal(30,10)"), 1).cast("double"))
    return F.when(v >= 10000, F.concat(F.lit("热销"), tens, F.lit("万+"))).when(
        v.isNotNull(), F.concat(F.lit("热销"), v.cast("string"), F.lit("+")))


def parse_bought(html: Column | str) -> Column:
    """'5K+ bought in past month' of the social-proof paragraph, brought to a month (week x 4.3, day x 30)."""
    text = F.trim(extract(html, r"<p[^>]*id=[\"']pqv-bought-in-last-month[\"'][^>]*>([^<]+)</p>", 1, True))
    regex = r"^([\d.]+)\s*([KMB]?)\s*\+?\s+bought\s+in\s+past\s+(month|week|day)"
    unit = F.upper(F.regexp_extract(text, pattern(regex, True), 2))
    period = F.lower(F.regexp_extract(text, pattern(regex, True), 3))
    factor = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)
    value = whole(extract(text, regex, 1, True).try_cast("double") * factor)
    return F.when(period == "week", whole(value * 4.3)).when(period == "day", value * 30).otherwise(value)


def parse_sales_page(html: Column | str, market: str) -> Column:
    """First pattern that yields a number, for 'amazon' or 'ml' product pages."""
    number = r"([\d,.]+)"
    if market == "amazon":
        tries = [
            rf"{number}\s*\+?\s*(?:comprad|bought|adquirid).*?(?:mês|month)", rf"[Mm]ais de\s+{number}\s+vendid",
            rf"{number}\s*\+?\s*vendid.*?(?:mês|month|último|last)", rf"#{number}\s+.*?mais\s+vendid",
        ]
        return F.coalesce(*[counted(html, t) for t in tries])
    tail = rf"{number}\s*{UNIT}\s*(?:produtos?\s+)?vendidos"
    return F.coalesce(counted(html, tail, 2), counted(html, r"[Mm]ais de\s+" + tail, 2))


def parse_sold(c: Column | str) -> Column:
    """'1.4K+' to 1400, '2M' to 2000000, '500' to 500; NULL if it is no number."""
    text = F.trim(F.replace(col(c), F.lit(","), F.lit("")))
    regex = r"^(.*?)([KkMm])?\+?$"
    unit = F.upper(F.regexp_extract(text, regex, 2))
    # A plus sign is only understood after a unit letter.
    body = F.when(unit == "", text).otherwise(F.regexp_extract(text, regex, 1))
    factor = F.when(unit == "K", 1e3).when(unit == "M", 1e6).otherwise(1.0)
    return whole(F.round(body.try_cast("double") * factor, 6))
