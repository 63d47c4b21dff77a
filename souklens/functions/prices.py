"""Prices out of text and into one currency."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from souklens.functions import fixed
from souklens.functions.numbers import col, ratio, round_half_up
from souklens.functions.text import pattern

PRICE = "decimal(18,4)"


def _positive(text: Column) -> Column:
    value = text.try_cast(PRICE)
    return F.when(value > 0, value)


def parse_price_br(c: Column | str, dot_groups: bool = False) -> Column:
    """'R$ 1.234,56' to 1234.56; NULL if not a positive number.

    A lone dot is a decimal point, unless ``dot_groups`` and exactly three digits follow it.
    """
    raw = F.regexp_replace(col(c), pattern(r"[R$\s]"), "")
    comma, dot = F.contains(raw, F.lit(",")), F.contains(raw, F.lit("."))
    no_dots = F.replace(raw, F.lit("."), F.lit(""))
    lone = F.when(raw.rlike(r"^\d{1,3}(\.\d{3})+$"), no_dots).otherwise(raw) if dot_groups else raw
    point = lambda x: F.replace(x, F.lit(","), F.lit("."))
    return _positive(F.when(comma & dot, point(no_dots)).when(comma, point(raw)).otherwise(lone))


def parse_price_us(c: Column | str) -> Column:
    """'$1,234.56' to 1234.56; one comma before two final digits is a decimal comma."""
    raw = F.regexp_replace(col(c), pattern(r"[$\s]"), "")
    decimal_comma = raw.rlike(r"^[^,.]*,[^,.]{2}$")
    return _positive(
        F.when(decimal_comma, F.replace(raw, F.lit(","), F.lit("."))).otherwise(F.replace(raw, F.lit(","), F.lit("")))
    )


def to_brl(price: Column | str, currency: Column | str, rates: Mapping[str, float] | None = None,
           fallback: Mapping[str, float] = fixed.FALLBACK_TO_BRL) -> Column:
    """Price in reais, two decimals. Rates given win over the fallback; an unknown currency passes unchanged."""
    p, c = col(price), col(currency)
    table = {**fallback, **(rates or {}), "BRL": 1.0}
    rate = F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)
    return F.when(p.isNotNull() & (p != 0), round_half_up(p * F.coalesce(rate, F.lit(1.0)), 2))


def invert_rates(rates: DataFrame, rate: str = "rate") -> DataFrame:
    """Units per real to reais per unit; zero rates are left out."""
    return rates.where(F.col(rate) != 0).withColumn(rate, ratio(F.lit(1.0), F.col(rate)))


def number_list(c: Column | str) -> Column:
    """All numbers of a text, as array<double>."""
    found = F.regexp_extract_all(col(c), F.lit(r"([\d.]+)"), F.lit(1))
    return F.transform(found, lambda x: x.try_cast("double"))
