"""Filtered lists, searches and cross-market comparisons."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from souklens.functions import fixed
from souklens.functions.numbers import round_half_up
from souklens.functions.scores import composite_score, price_score, text_score
from souklens.operators.history import newest
from souklens.operators.similarity import similarity_join
from souklens.session import checkpointed


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def enrichment_status(video: str = "video_url", main: str = "main_spec", specs: str = "specifications", models: str = "models",
                      prices: str = "variant_prices") -> Column:
    """complete: video, specification and models; partial: anything at all; else none."""
    text = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    has_specs = text(main) | some(specs)
    return (F.when(text(video) & has_specs & some(models), "complete")
            .when(text(video) | has_specs | some(models) | some(prices), "partial").otherwise("none"))


def gate_columns(df: DataFrame, premium: bool, columns: Sequence[str] = fixed.PREMIUM_COLUMNS) -> DataFrame:
    """Without the paid tier the premium columns go; a flag and their names tell."""
    gated = [] if premium else [c for c in columns if c in df.columns]
    names = F.array(*[F.lit(c) for c in gated]).cast("array<string>")
    return df.drop(*gated).withColumns({"_premium_locked": F.lit(not premium), "_gated_fields": names})


def list_products(df: DataFrame, *, platform: str | None = None, category_l1: str | None = None, category_l2: str | None = None,
                  category_l3: str | None = None, has_sales: bool = False, min_price: float | None = None, max_price: float | None = None,
                  limit: int = 100, offset: int = 0) -> DataFrame:
    """Active products by any of the filters, best sellers first."""
    equal = {"platform": platform, "category_l1": category_l1, "category_l2": category_l2, "category_l3": category_l3}
    conditions = [F.col("is_active")] + [F.col(c) == v for c, v in equal.items() if v is not None]
    if has_sales:
        conditions.append(F.col("sales_30d") > 0)
    if min_price is not None:
        conditions.append(F.col("price") >= min_price)
    if max_price is not None:
        conditions.append(F.col("price") <= max_price)
    return df.where(all_of(conditions)).orderBy(F.desc_nulls_last("sales_30d"), F.asc("id")).offset(offset).limit(limit)


def filter_products(df: DataFrame, *, search: str = "", categories: Sequence[str] = (), regions: Sequence[str] = (),
                    price_min: float | None = None, price_max: float | None = None, sources: Sequence[str] = (),
                    enrichment: Sequence[str] = ()) -> DataFrame:
    """Substring filters over merged products. A missing region passes, a missing price does not."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    within = lambda c, words: any_of(F.contains(c, F.lit(w.lower())) for w in words)
    conditions = []
    if search:
        conditions.append(any_of(F.contains(low(c), F.lit(search.lower())) for c in ("title", "title_pt", "supplier_name") if c in df.columns))
    if categories:
        label = F.coalesce(F.nullif(F.col("category_label_pt"), F.lit("")), "category_label") if "category_label_pt" in df.columns else F.col("category_label")
        conditions.append(within(F.lower(F.coalesce(label, F.lit(""))), categories))
    if regions:
        conditions.append(F.col("region").isNull() | (F.col("region") == "") | within(low("region"), regions))
    if price_min is not None:
        conditions.append(F.col("price") >= price_min)
    if price_max is not None:
        conditions.append(F.col("price") <= price_max)
    if sources:
        conditions.append(F.col("source").isin(*sources))
    if enrichment:
        conditions.append(F.coalesce("enrichment_status", F.lit("none")).isin(*enrichment))
    return df.where(all_of(conditions))


def search_text(df: DataFrame, q: str, n: int = 20, titles: Sequence[str] = ("title", "title_pt"), sales: str = "sales_30d") -> DataFrame:
    """Active products with the text in a title (as far as the table has them), any case, best sellers first."""
    hit = any_of(F.coalesce(F.contains(F.lower(t), F.lit(q.lower())), F.lit(False)) for t in titles if t in df.columns)
    return df.where(F.col("is_active") & hit).orderBy(F.desc_nulls_last(sales), F.asc("id")).limit(n)


def enrichment_queue(run: DataFrame, junk: str = fixed.JUNK_TITLE) -> DataFrame:
    """Listings of a run whose title is missing or known junk."""
    return run.where(F.col("title").isNull() | (F.col("title") == junk))


SPEC_COLUMNS = ("main_spec", "specifications", "models", "variant_prices", "video_url")


def spec_backfill_queue(df: DataFrame, n: int = 500, categories: Sequence[str] = ()) -> DataFrame:
    """Products that lack any specification column, best sellers first."""
    rows = df.where(any_of(F.col(c).isNull() for c in SPEC_COLUMNS))
    if categories:
        rows = rows.where(F.col("product_category").isin(*categories))
    return rows.select("id", "offer_id", "title", "sales_count", "product_category").orderBy(F.desc_nulls_last("sales_count"), F.asc("id")).limit(n)


EXPLORE_ORDER = {
    "price_asc": F.asc_nulls_last, "price_desc": F.desc_nulls_last, "sales_desc": F.desc_nulls_last, "match_desc": F.desc_nulls_last,
}
EXPLORE_COLUMN = {"price_asc": "price", "price_desc": "price", "sales_desc": "sales_30d", "match_desc": "confidence"}


def explore_rows(products: DataFrame, edges: DataFrame, *, category: str | None = None, platforms: Sequence[str] = (), min_price: float | None = None,
                 max_price: float | None = None, min_sales: int | None = None, min_match: float | None = None) -> DataFrame:
    """Active products with the edges they start; a least confidence drops products without one."""
    p = products.where("is_active")
    conditions = []
    if category is not None:
        conditions.append((F.col("category") == category) | F.col("category").startswith(category + "."))
    if platforms:
        conditions.append(F.col("platform").isin(*platforms))
    if min_price is not None:
        conditions.append(F.col("price") >= min_price)
    if max_price is not None:
        conditions.append(F.col("price") <= max_price)
    if min_sales is not None:
        conditions.append(F.col("sales_30d") >= min_sales)
    p = p.where(all_of(conditions))
    e = edges.select(F.col("product_a_id").alias("id"), "confidence")
    if min_match is not None:
        return p.join(e.where(F.col("confidence") >= min_match), "id")
    return p.join(e, "id", "left")


def explore(rows: DataFrame, sort: str = "price_asc", limit: int = 20, offset: int = 0) -> DataFrame:
    key = EXPLORE_ORDER[sort](EXPLORE_COLUMN[sort])
    return rows.orderBy(key, F.asc("id"), F.desc_nulls_last("confidence")).offset(offset).limit(limit)


def explore_facets(rows: DataFrame) -> DataFrame:
    """Row count, mean price and number of matched products over the whole selection."""
    matched = F.when(F.col("confidence").isNotNull(), F.col("id"))
    return rows.agg(F.count(F.lit(1)).alias("total"), round_half_up(F.coalesce(F.avg("price"), F.lit(0.0)), 4).alias("avg_price"),
                    F.countDistinct(matched).alias("matched_count"))


def platform_counts(rows: DataFrame) -> DataFrame:
    """Products per platform; a product counts once however many edges it starts."""
    return rows.groupBy("platform").agg(F.countDistinct("id").alias("count"))


def relevance(high: Sequence[str] = fixed.HIGH_VALUE_CATEGORIES, low: Sequence[str] = fixed.COMMODITY_CATEGORIES,
              bonus: float = fixed.HIGH_VALUE_BONUS, penalty: float = fixed.COMMODITY_PENALTY) -> Column:
    """repurchase rate x sales x a factor for the category."""
    label = F.col("category_label")
    factor = F.when(label.isin(*high), bonus).when(label.isin(*low), penalty).otherwise(1.0)
    return F.col("repurchase_rate") * F.coalesce("sales_volume_estimate", F.lit(0)) * factor


def top_products(listings: DataFrame, labels: Sequence[str], n: int = 30, score: Column | None = None) -> DataFrame:
    rows = listings.where(F.col("category_label").isin(*labels) & F.col("repurchase_rate").isNotNull() & (F.col("price_min") > 0))
    return _by_relevance(rows, n, score)


def search_products(listings: DataFrame, q: str, n: int = 20, score: Column | None = None, titles: Sequence[str] = ("title", "title_pt")) -> DataFrame:
    hit = any_of(F.coalesce(F.contains(F.lower(t), F.lit(q.lower())), F.lit(False)) for t in titles if t in listings.columns)
    return _by_relevance(listings.where(hit & F.col("repurchase_rate").isNotNull()), n, score)


def _by_relevance(rows: DataFrame, n: int, score: Column | None) -> DataFrame:
    scored = rows.withColumn("relevance", round_half_up(score if score is not None else relevance(), 4))
    return scored.orderBy(F.desc_nulls_last("relevance"), F.asc("row_id")).limit(n)


def by_category(products: DataFrame, *, n1: str | None = None, n2: str | None = None, n3: str | None = None, n4: str | None = None,
                platform: str | None = None) -> DataFrame:
    """Active products of a category at any level, by its own column or by the dotted path."""
    conditions = [F.col("is_active")]
    path = F.coalesce("category_path", F.lit(""))
    if n1:
        conditions.append((F.col("category") == n1) | path.startswith(f"{n1}."))
    for level, slug in (("category_n2", n2), ("category_n3", n3)):
        if slug:
            conditions.append((F.col(level) == slug) | F.contains(path, F.lit(f".{slug}.")))
    if n4:
        conditions.append(F.col("category_n4") == n4)
    if platform:
        conditions.append(F.col("platform") == platform)
    return products.where(all_of(conditions))


def category_page(rows: DataFrame, sort: str = "price", limit: int = 20, offset: int = 0) -> DataFrame:
    """Page of a category. Newest puts rows without a date first, as an unqualified descending order does there."""
    key = {"price": F.asc_nulls_last("price"), "sales": F.desc(F.coalesce("sales_30d", F.lit(0)))}.get(sort)
    return rows.orderBy(key if key is not None else F.desc_nulls_first("last_updated"), F.asc("id")).offset(offset).limit(limit)


def breadcrumbs(taxonomy: DataFrame, slugs: Sequence[str]) -> DataFrame:
    """Taxonomy rows of the chosen slugs, from the top level down."""
    place = F.array_position(F.array(*[F.lit(s) for s in slugs]), F.col("slug"))
    return taxonomy.where(F.col("slug").isin(*slugs)).withColumn("position", place.cast("int"))


def sort_by_price(df: DataFrame, price: str = "price_brl", *ties: str) -> DataFrame:
    return df.orderBy(F.asc_nulls_last(price), *[F.asc(t) for t in ties])


def cheapest_by_platform(df: DataFrame, n: int, *, price: str = "price_brl", ident: str = "id") -> DataFrame:
    """Each platform's list by price, a missing price last, with the place in it."""
    return newest(df, ["platform"], [F.asc_nulls_last(price), F.asc(ident)], n, "position")


def new_products(products: DataFrame, now: Column, days: int = 7, n: int = 20) -> DataFrame:
    fresh = products.where(F.col("is_active") & (F.col("created_at") >= now - F.expr(f"interval {int(days)} days")))
    return fresh.orderBy(F.desc("created_at"), F.asc("id")).limit(n)


def _prefix(c: Column) -> Column:
    return F.substring(F.lower(c), 1, 20)


GRAM = 5  # characters by which needles and texts meet


def _grams(texts: DataFrame, text: str) -> DataFrame:
    """(text, gram): the GRAM characters from every place of a text on, fewer at its end; one row per character at most."""
    starts = F.sequence(F.lit(1), F.length(text))
    return texts.where(F.length(text) > 0).select(text, F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(F.col(text), i, GRAM)))).alias("gram"))


def contained(texts: DataFrame, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """Distinct (text, needle) hits where a needle occurs in a text.

    They meet on one gram: of a needle's the one that the fewest texts hold, so a common beginning joins nothing; the whole needle is
    then looked for. A needle shorter than a gram meets all grams that begin with it, which are found among the distinct
    grams and not in the texts. The empty needle occurs in every text. Both sides are distinct.
    """
    grams = checkpointed(_grams(texts, text))
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    whole = F.transform(F.sequence(F.lit(1), F.greatest(F.length(needle) - GRAM + 1, F.lit(1))), lambda i: F.substring(F.col(needle), i, GRAM))
    # A gram that no text holds rules its needle out, so it counts as the rarest.
    long = needles.where(F.length(needle) >= GRAM).select(needle, F.explode(F.array_distinct(whole)).alias("gram")).join(counts, "gram", "left").groupBy(needle).agg(
        F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("gram"))).alias("gram"))
    short = needles.where(F.length(needle).between(1, GRAM - 1))
    heads = counts.select("gram", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(GRAM - 1)), lambda n: F.substring(F.col("gram"), F.lit(1), n)))).alias(needle))
    keys = long.select(needle, "gram").unionByName(heads.join(short, needle).select(needle, "gram"))
    hits = grams.join(keys, "gram").where(F.contains(text, needle)).select(text, needle)
    empty = needles.where(F.length(needle) == 0)
    return hits.unionByName(texts.withColumn(needle, F.lit("")).join(empty, needle, "left_semi").select(text, needle)).distinct()


def unmatched_bestsellers(bestsellers: DataFrame, catalogues: Sequence[DataFrame], n: int = 50) -> DataFrame:
    """Bestsellers no catalogue title matches: neither title holds the other's first 20 characters, any case.

    Titles are taken literally. Containment becomes an equi join on the rarest gram in both directions.
    """
    all_titles = reduce(lambda a, b: a.union(b), [c.select("title") for c in catalogues]).where(F.col("title").isNotNull())
    theirs = all_titles.select(F.lower("title").alias("t"), _prefix(F.col("title")).alias("p")).distinct()
    ours = bestsellers.where(F.col("title").isNotNull()).select(F.lower("title").alias("t"), _prefix(F.col("title")).alias("p")).distinct()
    needles = ours.select("p").distinct()
    found_p = contained(theirs.select("t").distinct(), "t", needles, "p").select("p").join(needles, "p", "left_semi").distinct()
    by_prefix = ours.join(found_p, "p", "left_semi").select("t")
    their_needles = theirs.select("p").distinct()
    by_text = contained(ours.select("t").distinct(), "t", their_needles, "p").join(their_needles, "p", "left_semi").select("t")
    matched = by_prefix.union(by_text).distinct()
    left = bestsellers.where(F.col("sales_velocity").isNotNull()).withColumn("t", F.lower("title")).join(matched, "t", "left_anti").drop("t")
    return left.orderBy(F.desc("sales_velocity"), F.asc("id")).limit(n)


def _missing_in_brazil(listings: DataFrame, silver: DataFrame) -> DataFrame:
    s = silver.where(F.col("bronze_source") == "listing").select("title", "ml_sales_volume", F.col("id").alias("_sid"))
    joined = listings.join(s, "title", "left")
    return joined.where(F.col("ml_sales_volume").isNull() | F.col("_sid").isNull())


def china_not_in_brazil(listings: DataFrame, silver: DataFrame, n: int = 50) -> DataFrame:
    """Listings without Mercado Livre sales, best sellers first, with sales per price as opportunity score."""
    rows = _missing_in_brazil(listings, silver)
    sales, price = F.coalesce("sales_volume_estimate", F.lit(0)), F.coalesce("price_min", F.lit(0.0))
    score = F.when(price > 0, F.floor(F.try_divide(sales, price) * 10 + 0.5) / 10).otherwise(sales.cast("double"))
    top = rows.orderBy(F.desc(sales), F.asc_nulls_last("price_min"), F.asc("row_id")).limit(n)
    return top.select(*listings.columns, score.alias("opportunity_score"))


def opportunity_stats(listings: DataFrame, silver: DataFrame) -> DataFrame:
    """Totals over those listings and their largest category."""
    from souklens.operators.history import one_row

    rows = _missing_in_brazil(listings, silver)
    totals = rows.agg(F.count(F.lit(1)).alias("total_products"), round_half_up(F.avg("price_min"), 2).alias("avg_price"),
                      round_half_up(F.avg("sales_volume_estimate"), 0).alias("avg_sales"))
    labels = rows.where(F.col("category_label").isNotNull() & (F.trim("category_label") != "")).groupBy("category_label").agg(F.count(F.lit(1)).alias("c"))
    top = labels.orderBy(F.desc("c"), F.asc("category_label")).limit(1)
    return one_row(totals, top.select(F.col("category_label").alias("top_category"), F.col("c").alias("top_category_count")))


def _title_vectors(titles: DataFrame, weights: DataFrame, threshold: float) -> DataFrame:
    """(tid, token, w, rest, in_prefix): the unit TF-IDF vector of every numbered title, one row per token.

    Tokens are ordered rare first. What follows the prefix is shorter than the threshold, so a pair that reaches the
    threshold shares a token of both prefixes; ``rest`` is the length of what follows the row's own token.
    """
    tokens = titles.select("tid", F.explode(F.filter(F.split(F.lower("title"), r"[^\p{L}\p{N}]+"), lambda w: w != "")).alias("token"))
    tf = tokens.groupBy("tid", "token").agg(F.count(F.lit(1)).alias("tf")).join(weights, "token")
    title = W.partitionBy("tid")  # the tokens of one title
    onward = title.orderBy("df", "token").rowsBetween(W.currentRow, W.unboundedFollowing)
    raw = tf.withColumn("w", F.col("tf") * F.col("idf"))
    unit = raw.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(title)))
    tailed = unit.withColumn("square", F.sum(F.col("w") * F.col("w")).over(onward))
    rest = F.sqrt(F.greatest(F.col("square") - F.col("w") * F.col("w"), F.lit(0.0)))
    return tailed.select("tid", "token", "w", rest.alias("rest"), (F.sqrt("square") >= threshold - 1e-9).alias("in_prefix"))


HOT = 1 << 10  # titles of a side that have a token in their prefix, from which on it is split
W_CELLS, REST_CELLS = 32, 8


def _meetings(a: DataFrame, b: DataFrame, threshold: float, pairs: bool = True) -> DataFrame:
    """(a_tid, b_tid) that share a prefix token at which they may still reach the threshold; the sides are (token, tid, w, rest).

    At the first token that two titles share, all else they have in common lies in what follows it, so a pair that reaches the
    threshold has a_w * b_w + a_rest * b_rest at or above it there; at later tokens it may or not. A hot token is split over a grid
    of its weight and the rest: a title of the right side is in one cell, one of the left side asks only for the cells in which that sum
    can be reached. So titles that merely share a common word do not meet, and the word is many keys.
    """
    hot = checkpointed(b.groupBy("token").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT).select("token", F.lit(True).alias("_hot")))
    least = threshold - 1e-6
    cell = lambda x, n: F.least(F.floor(F.col(x) * n), F.lit(n - 1)).cast("int")
    high_w, high_rest = (lambda c: (F.floor(c / REST_CELLS) + 1) / W_CELLS), (lambda c: (c % REST_CELLS + 1) / REST_CELLS)
    asked = F.filter(F.sequence(F.lit(0), F.lit(W_CELLS * REST_CELLS - 1)), lambda c: F.col("w") * high_w(c) + F.col("rest") * high_rest(c) >= least)
    one = F.array(F.lit(-1))
    left = a.join(hot, "token", "left").select("token", F.explode(F.when(F.col("_hot"), asked).otherwise(one)).alias("cell"),
                                               F.col("tid").alias("a_tid"), F.col("w").alias("a_w"), F.col("rest").alias("a_rest"))
    right = b.join(hot, "token", "left").select("token", F.when(F.col("_hot"), cell("w", W_CELLS) * REST_CELLS + cell("rest", REST_CELLS)).otherwise(F.lit(-1)).alias("cell"),
                                                F.col("tid").alias("b_tid"), F.col("w").alias("b_w"), F.col("rest").alias("b_rest"))
    met = left.join(right, ["token", "cell"])
    bound = F.col("a_w") * F.col("b_w") + F.col("a_rest") * F.col("b_rest")
    return met.where(bound >= least) if pairs else met


def title_match(ml: DataFrame, china: DataFrame, *, threshold: float = 0.6, weights: tuple[float, float] = (0.5, 0.5), rate: float = 0.80,
                k: int = 1) -> DataFrame:
    """The ``k`` best Chinese products by title for each Mercado Livre item (id, title, price on both sides).

    semantic: TF-IDF cosine, at least ``threshold``; fuzzy: 1 - normalised edit distance; score: their weighted mean.
    Equal titles are compared once and known by a number. Titles that share a rare-first prefix token meet on it with two
    numbers each; pairs that pass the bound there are fetched their vectors afterwards.
    """
    side = lambda df, s: df.where(F.col("title").isNotNull()).select("title", F.lit(s).alias("side"))
    both = side(ml, 1).unionByName(side(china, 2)).groupBy("title").agg(F.bit_or("side").alias("sides"))
    both = checkpointed(both.withColumn("tid", F.monotonically_increasing_id()))
    split = F.array_distinct(F.filter(F.split(F.lower("title"), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    df_counts = both.select(F.explode(split).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df")).withColumn("_one", F.lit(1))
    total = both.agg(F.count(F.lit(1)).alias("n")).withColumn("_one", F.lit(1))
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    table = df_counts.join(F.broadcast(total), "_one").select("token", "df", idf.alias("idf"))  # one row
    rows = checkpointed(_title_vectors(both, table, threshold))
    has = lambda s: both.where(F.col("sides").bitwiseAND(s) > 0)

    met_by = lambda s: rows.where("in_prefix").join(has(s).select("tid"), "tid", "left_semi").select("token", "tid", "w", "rest")
    near = _meetings(met_by(1), met_by(2), threshold).select("a_tid", "b_tid").distinct()
    vectors = rows.groupBy("tid").agg(F.collect_list(F.struct("token", "w")).alias("v")).join(both.select("tid", "title"), "tid")
    fetched = lambda name: vectors.select(F.col("tid").alias(f"{name}_tid"), F.col("title").alias(f"{name}_title"), F.map_from_entries("v").alias(f"{name}_m"))
    dot = F.aggregate(F.map_entries("a_m"), F.lit(0.0), lambda s, x: s + x["value"] * F.coalesce(F.try_element_at("b_m", x["key"]), F.lit(0.0)))
    pairs = near.join(fetched("a"), "a_tid").join(fetched("b"), "b_tid").select("a_title", "b_title", F.round(dot, 6).alias("semantic_score")).where(F.col("semantic_score") >= threshold)
    distance = F.levenshtein("a_title", "b_title") / F.greatest(F.length("a_title"), F.length("b_title"))
    scored = pairs.withColumns({"normalized_edit_distance": F.round(distance, 6), "fuzzy_score": F.round(1 - distance, 6)})
    scored = scored.withColumn("match_score", F.round((weights[0] * F.col("fuzzy_score") + weights[1] * F.col("semantic_score")).cast("decimal(30,10)"), 6).cast("double"))
    few = newest(china.select(F.col("id").alias("china_id"), F.col("title").alias("b_title"), F.col("price").alias("price_cny")),
                 ["b_title"], [F.asc("china_id")], k, "_r").drop("_r")
    best = newest(scored.join(few, "b_title"), ["a_title"], [F.desc("match_score"), F.asc("china_id")], k, "rank")
    items = ml.select(F.col("id").alias("ml_id"), F.col("title").alias("a_title"), F.col("price").alias("price_brl"))
    margin = F.when(F.col("price_brl") != 0, round_half_up((F.col("price_brl") - F.col("price_cny") * rate) / F.col("price_brl"), 4))
    return items.join(best, "a_title").select(
        "ml_id", "china_id", F.col("a_title").alias("ml_title"), F.col("b_title").alias("china_title"), "semantic_score", "fuzzy_score",
        "normalized_edit_distance", "match_score", F.lit("title_combined").alias("match_method"), margin.alias("margin_estimate"), "rank")


def compare_hybrid(products: DataFrame, title: str, n: int = 10, home: str = "ml") -> DataFrame:
    """Text hits and look-alikes of the first hit as one list, scored by text, looks and price.

    Text hits: title contains the text; foreign platforms first, then by price, ``n`` of them. Look-alikes: the ``n``
    nearest to the first hit, if it has a vector.
    """
    active = products.where("is_active")
    hits = active.where(F.contains(F.lower("title"), F.lit(title.lower())))
    order = [F.when(F.col("platform") == home, 1).otherwise(0), F.asc_nulls_last("price"), F.asc("id")]
    text = hits.orderBy(*order).limit(n).select("id", F.lit(True).alias("by_text"))
    first = hits.orderBy(*order).limit(1).where(F.col("embedding").isNotNull())
    looks = similarity_join(first, active, k=n, skip_equal=False).select(F.col("right_id").alias("id"), (F.col("similarity") * 100).alias("_visual"))
    both = text.join(looks, "id", "full_outer").join(active.select("id", "platform", "title", "price", "category_l1"), "id")
    kind = F.when(F.col("by_text") & F.col("_visual").isNotNull(), "hybrid").when(F.col("by_text"), "text").otherwise("visual")
    visual = round_half_up("_visual", 1)
    bounds = both.where(F.col("price") != 0).agg(F.coalesce(F.min("price"), F.lit(0.0)).alias("_low"), F.coalesce(F.max("price"), F.lit(1000.0)).alias("_high")).withColumn("_one", F.lit(1))
    rows = both.withColumns({"match_type": kind, "visual_score": visual, "_one": F.lit(1)}).join(F.broadcast(bounds), "_one")  # one row
    t, v = text_score(title, "title"), F.coalesce("visual_score", F.lit(0.0))
    total = composite_score(t, v, price_score("price", F.col("_low"), F.col("_high")), F.lit(0.0))
    scored = rows.select("id", "platform", "title", "price", F.col("category_l1").alias("category"), "match_type", "visual_score",
                         round_half_up(t, 1).alias("text_score"), round_half_up(total, 1).alias("composite_score"))
    return scored.orderBy(F.desc("composite_score"), F.asc("id")).limit(n)


def compare_by_id(products: DataFrame, ident, n: int = 10) -> DataFrame:
    """The ``n`` look-alikes of one product among the active ones."""
    source = products.where(F.col("id") == ident)
    near = similarity_join(source, products.where("is_active"), k=n)
    score = round_half_up(F.col("similarity") * 100, 1)
    return near.select(F.col("right_id").alias("id"), score.alias("visual_score"), "rank").join(
        products.select("id", "platform", "title", "price", F.col("category_l1").alias("category")), "id").withColumns(
        {"composite_score": F.col("visual_score"), "match_type": F.lit("visual")})
