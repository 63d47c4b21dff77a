"""Landed cost, margins, market pulse, verdict and opportunity wording."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from souklens.functions import fixed
from souklens.functions.numbers import col, round_half_up


def lookup(table: Mapping[str, float], key: Column, default: float) -> Column:
    if not table:
        return F.lit(default)
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def factor_for(country: Column | str, quantity: Column | str, factors: Sequence[tuple[str, int, float]] = fixed.IMPORT_FACTORS,
               default: float = fixed.DEFAULT_FACTOR) -> Column:
    """Factor of the highest tier at or below the quantity; an unknown country counts as BR."""
    q = col(quantity)
    tiers: dict[str, list[tuple[int, float]]] = {}
    for name, low, factor in factors:
        tiers.setdefault(name, []).append((low, factor))

    def pick(rows):
        steps = sorted(rows, reverse=True)
        return reduce(lambda w, s: w.when(q >= s[0], F.lit(float(s[1]))), steps, F).otherwise(float(default))

    home = pick(tiers["BR"]) if "BR" in tiers else F.lit(float(default))
    return reduce(lambda w, n: w.when(col(country) == n, pick(tiers[n])), tiers, F).otherwise(home)


def join_factors(df: DataFrame, factors: DataFrame, *, country: str = "country", quantity: str = "quantity",
                 default: float = fixed.DEFAULT_FACTOR) -> DataFrame:
    """The same lookup against a factor table: tiers are packed per country, so one equi join replaces a range join.
    The tiers are one row per country and are broadcast: by country the rows would gather in as many tasks as there are countries."""
    tiers = factors.groupBy("country").agg(F.array_sort(F.collect_list(F.struct("quantity_min", "factor"))).alias("_tiers"))
    known = tiers.select(F.col("country").alias("_key"), "_tiers")
    home = tiers.where(F.col("country") == "BR").select(F.lit("BR").alias("_home"), F.col("_tiers").alias("_home_tiers"))
    joined = df.join(F.broadcast(known), F.col(country) == F.col("_key"), "left").withColumn("_home", F.lit("BR")).join(F.broadcast(home), "_home", "left")
    reached = F.filter(F.coalesce("_tiers", "_home_tiers"), lambda t: t["quantity_min"] <= F.col(quantity))
    best = F.try_element_at(reached, F.lit(-1))["factor"].cast("double")
    return joined.withColumn("factor", F.coalesce(best, F.lit(default))).drop("_key", "_tiers", "_home", "_home_tiers")


def with_quantities(df: DataFrame, quantities: Sequence[int]) -> DataFrame:
    return df.withColumn("quantity", F.explode(F.array(*[F.lit(q) for q in quantities])))


def compute_margins(offers: DataFrame, *, quantities: Sequence[int] = (50, 200), country: str = "BR",
                    factors: Sequence[tuple[str, int, float]] = fixed.IMPORT_FACTORS,
                    fees: Mapping[str, float] = fixed.PLATFORM_FEES, default_fee: float = fixed.DEFAULT_FEE,
                    rates: Mapping[str, float] = fixed.MARGIN_RATES) -> DataFrame:
    """Landed cost and margin of every (source_price, source_currency, sell_platform, sell_price, sell_currency)
    row at each quantity."""
    rows = with_quantities(offers, quantities)
    usd = F.when(F.col("source_currency") == "CNY", F.col("source_price") * rates["CNY_USD"]).otherwise(F.col("source_price"))
    factor = factor_for(F.lit(country), "quantity", factors)
    landed = usd * factor * F.when(F.col("sell_currency") == "BRL", rates["USD_BRL"]).otherwise(1.0)
    net = F.col("sell_price") * (1 - lookup(fees, F.col("sell_platform"), default_fee))
    margin = F.when(net > 0, F.try_divide(net - landed, net)).otherwise(0.0)
    return rows.withColumns({
        "factor_used": factor, "landed_cost_per_unit": round_half_up(landed, 2),
        "margin_pct": round_half_up(margin * 100, 1),
    })


def margin_range(offers: DataFrame, *, quantities: Sequence[int] = (50, 200, 500), country: str = "BR",
                 factors: Sequence[tuple[str, int, float]] = fixed.IMPORT_FACTORS,
                 fees: Mapping[str, float], default_fee: float = fixed.DEFAULT_FEE,
                 to_brl: Mapping[str, float]) -> DataFrame:
    """Margin tiers of (source_price, source_currency, platform, retail_price): one rate into reais, fee on retail."""
    rows = with_quantities(offers, quantities)
    factor = factor_for(F.lit(country), "quantity", factors)
    fee = lookup(fees, F.col("platform"), default_fee)
    landed = F.col("source_price") * lookup(to_brl, F.col("source_currency"), 1.0) * factor
    net = F.col("retail_price") * (1 - fee)
    return rows.withColumns({
        "import_factor": factor, "platform_fee_rate": fee, "landed_cost": round_half_up(landed, 2),
        "margin_pct": round_half_up(F.when(net > 0, F.try_divide(net - landed, net)).otherwise(0.0) * 100, 1),
    })


def market_pulse(df: DataFrame, *, sales_30d: str = "sales_30d", sales_total: str = "sales_total",
                 bsr_rank: str = "bsr_rank", sellers: str = "seller_count") -> DataFrame:
    """Velocity from the share of recent sales, else from the bestseller rank; competition from sellers; window text."""
    recent, total, rank, n = F.col(sales_30d), F.col(sales_total), F.col(bsr_rank), F.col(sellers)
    share = F.try_divide(recent, F.greatest(total, F.lit(1)))
    by_sales = (recent > 0) & (total > 0)
    by_rank = F.coalesce(rank, F.lit(0)) != 0
    velocity = (
        F.when(by_sales & (share > 0.3), "hot").when(by_sales & (share > 0.15), "warm")
        .when(by_sales & (share > 0.05), "cool").when(by_sales, "dead")
        .when(by_rank & (rank < 1000), "hot").when(by_rank & (rank < 10000), "warm").when(by_rank, "cool").otherwise("warm")
    )
    competition = F.when(n <= 3, "low").when(n <= 10, "medium").when(n <= 25, "high").otherwise("saturated")
    with_both = df.withColumns({"velocity": velocity, "competition": competition})
    hot, quiet = F.col("velocity") == "hot", F.col("competition").isin("low", "medium")
    window = (
        F.when(hot & quiet, "~3-6 months before saturation").when(hot, "~1-2 months — act fast")
        .when(F.col("velocity") == "warm", "~6-12 months steady").otherwise("Window may have closed")
    )
    return with_both.withColumn("window", window)


def _points(*rules: tuple[Column, int]) -> Column:
    return reduce(lambda w, r: w.when(r[0], F.lit(r[1])), rules, F).otherwise(0)


def _texts(*lines: tuple[Column, Column]) -> Column:
    """The texts whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(cond, text) for cond, text in lines]))


def _sentences(texts: Mapping[str, str], **values: Column):
    """A function from a text's name to the text with its braces filled in."""
    def say(name: str) -> Column:
        parts = re.split(r"\{(\w+)\}", texts[name])
        return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])

    return say


def verdict(df: DataFrame) -> DataFrame:
    """Additive score and rating from best_margin, best_platform, best_quantity, match_count, best_confidence,
    velocity and competition; up to five pros and cons and a summary."""
    m = F.coalesce("best_margin", F.lit(0.0))
    conf, n = F.col("best_confidence"), F.coalesce("match_count", F.lit(0))
    v, c = F.col("velocity"), F.col("competition")
    has = n > 0
    pct, conf_pct = m.cast("string"), F.format_string("%.0f", conf * 100)
    score = (
        _points((m > 60, 3), (m > 50, 2), (m > 30, 1), (m > 0, -1), (F.lit(True), -3))
        + _points((has & (conf > 0.90), 2), (has & (conf > 0.70), 1))
        + _points((v == "hot", 2), (v == "warm", 1), (v == "cool", -1), (v == "dead", -3))
        + _points((c == "low", 2), (c == "medium", 1), (c == "high", -1), (c == "saturated", -2))
    )
    say = _sentences(fixed.VERDICT_TEXTS, pct=pct, conf=conf_pct, n=n.cast("string"), platform=F.col("best_platform"), quantity=F.col("best_quantity").cast("string"))
    pros = _texts(
        (m > 60, say("margin_excellent")), ((m > 50) & (m <= 60), say("margin_strong")), ((m > 30) & (m <= 50), say("margin_decent")),
        (has & (conf > 0.90), say("match_found")), (has & (conf > 0.70) & (conf <= 0.90), say("match_likely")), (n >= 5, say("many_sources")),
        (v == "hot", say("hot")), (v == "warm", say("warm")), (c == "low", say("low")), (c == "medium", say("medium")))
    cons = _texts(
        ((m > 0) & (m <= 30), say("margin_thin")), (m <= 0, say("margin_negative")), (has & (conf <= 0.70), say("match_uncertain")), (n < 2, say("few_sources")),
        (v == "cool", say("cool")), (v == "dead", say("dead")), (c == "high", say("high")), (c == "saturated", say("saturated")))
    scored = df.withColumns({"score": score, "pros": F.slice(pros, 1, 5), "cons": F.slice(cons, 1, 5)})
    s = F.col("score")
    rated = scored.withColumn("rating", F.when(s >= 6, "strong").when(s >= 3, "moderate").when(s >= 0, "weak").otherwise("avoid"))
    r, yes = F.col("rating"), F.lit(True)

    def advice(rating: str, *lines: tuple[Column, Column]) -> list[tuple[Column, Column]]:
        return [((r == rating) & cond, text) for cond, text in lines]

    summary = _texts(
        *advice("strong", (yes, say("strong")), (m > 50, say("strong_start")), (v == "hot", say("strong_hot"))),
        *advice("moderate", (yes, say("moderate")), (yes, say("moderate_test")), (c.isin("high", "saturated"), say("moderate_crowded"))),
        *advice("weak", (yes, say("weak")), (yes, say("weak_why")), (yes, say("weak_scale"))),
        *advice("avoid", (yes, say("avoid")), (m <= 0, say("avoid_loss")), (v.isin("cool", "dead"), say("avoid_passed"))))
    return rated.withColumn("summary", F.concat_ws(" ", summary))


def opportunity_reasoning(sales: Column, reviews: Column, peers: Column, margin: Column, competition: Column) -> Column:
    """Why a product is an opportunity, parts joined by ' | '."""
    say = _sentences(fixed.OPPORTUNITY_TEXTS, sales=sales.cast("string"), reviews=reviews.cast("string"), pct=F.format_string("%.0f", margin))
    parts = [
        F.when(sales > 50, say("demand_high")).when(sales > 10, say("demand_moderate")), F.when(reviews > 20, say("reputation")),
        F.when(peers == 0, say("alone")).when(competition == "low", say("few_peers")),
        F.when(margin > 50, say("margin_high")).when(margin > 20, say("margin_moderate")),
    ]
    return F.coalesce(F.nullif(F.concat_ws(" | ", *parts), F.lit("")), say("default"))
