"""Categories by keyword, rule table, mapping and hierarchy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from souklens.functions import fixed
from souklens.functions.numbers import col
from souklens.functions.text import pattern
from souklens.operators.listing import contained
from souklens.session import checkpointed


def classify_keywords(df: DataFrame, taxonomy: DataFrame, title: str = "title", fallback: str = "uncategorized") -> DataFrame:
    """Keyword cascade N1 -> N2 -> N3: each level looks only among the children of the level above.

    ``taxonomy`` is a table (slug, level, parent_slug, keywords, position): lower-case keywords, and the order that decides ties; it may
    be of any size. The keywords that occur in the distinct titles are found by one join on the rarest part of each; a level is then a
    join of those with the nodes of the parent that was chosen, and the best node of a title is kept by partial aggregation.
    """
    nodes = taxonomy.select("slug", "level", F.col("parent_slug").alias("parent"), "position", F.explode("keywords").alias("keyword")).where(F.col("keyword").isNotNull())
    # A keyword that a node has twice counts twice.
    nodes = nodes.groupBy("slug", "level", "parent", "position", "keyword").agg(F.count("*").alias("times"))
    text = F.lower(F.coalesce(col(title), F.lit("")))
    texts = df.select(text.alias("text")).distinct()
    occur = checkpointed(contained(texts, "text", nodes.select("keyword").distinct(), "keyword"))
    found = texts
    kept: list[str] = []
    for level in (1, 2, 3):
        own = nodes.where(F.col("level") == level).select("keyword", "slug", "position", "times", *([F.col("parent").alias(f"n{level - 1}")] if level > 1 else []))
        met = found.join(occur, "text", "left").join(own, ["keyword", *([f"n{level - 1}"] if level > 1 else [])], "left")
        hits = met.groupBy("text", *kept, "slug", "position").agg(F.sum("times").alias("hits"))
        best = F.max(F.when(F.col("hits") > 0, F.struct("hits", (-F.col("position")).alias("ord"), "slug"))).alias("best")
        found = hits.groupBy("text", *kept).agg(best)
        kept += [f"n{level}", f"confidence_n{level}"]
        name = F.coalesce("best.slug", F.lit(fallback)) if level == 1 else F.col("best.slug")
        found = found.withColumns({f"n{level}": name, f"confidence_n{level}": F.least(F.lit(1.0), F.coalesce("best.hits", F.lit(0)) / 3)}).drop("best")
    return df.withColumn("_text", text).join(found.withColumnRenamed("text", "_text"), "_text").drop("_text")


def first_rule(title: Column | str, rules: Sequence[tuple], regex: bool = True) -> Column:
    """Values of the first rule whose pattern (or substring) occurs in the lower-cased title.

    A rule is (pattern, value) or (pattern, value, value, ...); several values give a struct v1, v2, ...
    """
    t = F.lower(F.coalesce(col(title), F.lit("")))

    def value(rule):
        if len(rule) == 2:
            return F.lit(rule[1])
        return F.struct(*[F.lit(v).alias(f"v{i}") for i, v in enumerate(rule[1:], 1)])

    def hit(rule):
        return t.rlike(pattern(rule[0], True)) if regex else F.contains(t, F.lit(rule[0]))

    return reduce(lambda w, r: w.when(hit(r), value(r)), rules, F)


def detect_l1(df: DataFrame, rules: Sequence[tuple[str, str]] = fixed.L1_RULES, title: str = "title", out: str = "detected_l1") -> DataFrame:
    """First matching L1 rule (pattern, l1)."""
    return df.withColumn(out, first_rule(title, rules))


def classify_l3(df: DataFrame, rules: Mapping[str, Sequence[tuple[str, str, str]]], *, l1: str = "category_l1", title: str = "title") -> DataFrame:
    """rule_l2 and rule_l3 by the ordered (pattern, l2, l3) rules of the row's L1."""
    best = reduce(lambda w, k: w.when(F.col(l1) == k, first_rule(title, rules[k])), rules, F)
    return df.withColumn("_r", best).withColumns({"rule_l2": F.col("_r.v1"), "rule_l3": F.col("_r.v2")}).drop("_r")


def classify_by_dict(df: DataFrame, rules: Mapping[str, Sequence[tuple[str, str, str]]], *, l1: str = "category_l1", title: str = "title") -> DataFrame:
    """Overwrite L2 and L3 of the given L1s where a (substring, l2, l3) rule hits the title."""
    best = reduce(lambda w, k: w.when(F.col(l1) == k, first_rule(title, rules[k], regex=False)), rules, F)
    return df.withColumn("_r", best).withColumns({
        "category_l2": F.coalesce("_r.v1", "category_l2"), "category_l3": F.coalesce("_r.v2", "category_l3")}).drop("_r")


MOST_RULES = 10_000


def rule_list(rules: DataFrame, *values: str, pattern: str = "pattern", order: str = "position", most: int = MOST_RULES) -> list[tuple]:
    """The (pattern, values) of a table of rules in their order, for the functions above, which try them one by one; more than ``most`` are refused."""
    found = rules.where(F.col(pattern).isNotNull()).orderBy(order, pattern).select(pattern, *values).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rules; substrings can be given to classify_by_table")
    return [tuple(r) for r in found]


def classify_by_table(df: DataFrame, rules: DataFrame, *, l1: str = "category_l1", title: str = "title") -> DataFrame:
    """Like ``classify_by_dict`` with the rules as a table (l1, position, substring, l2, l3) of any size: the substrings that occur in the
    distinct titles come from one gram join, and of the rules of a row's L1 the first by position counts."""
    text = F.lower(F.coalesce(col(title), F.lit("")))
    # Repeats are dropped by hash first, and counted, as Spark leaves a plain distinct out below a minimum, which sorts all rows of a task.
    once = rules.where(F.col("substring").isNotNull()).groupBy("l1", "substring", "position", "l2", "l3").agg(F.count(F.lit(1)).alias("_n")).where("_n > 0")
    known = once.groupBy(F.col("l1").alias("_l1"), "substring").agg(F.min(F.struct("position", "l2", "l3")).alias("rule"))
    wanted = df.select(text.alias("_text"), F.col(l1).alias("_l1")).distinct()
    occur = contained(wanted.select("_text").distinct(), "_text", known.select("substring").distinct(), "substring")
    first = wanted.join(occur, "_text").join(known, ["_l1", "substring"]).groupBy("_text", "_l1").agg(F.min("rule").alias("_r"))
    rows = df.withColumns({"_text": text, "_l1": F.col(l1)}).join(first, ["_text", "_l1"], "left")
    return rows.withColumns({"category_l2": F.coalesce("_r.l2", "category_l2"), "category_l3": F.coalesce("_r.l3", "category_l3")}).select(*df.columns)


def categorize(df: DataFrame, taxonomy: DataFrame, l1_rules: Sequence[tuple[str, str]],
               l3_rules: Mapping[str, Sequence[tuple[str, str, str]]], *, changed_only: bool = False) -> DataFrame:
    """Reclassify by a ladder: a valid L3 gives its L2; an empty or general L3 goes to the rules; an unknown L3 stays
    unless the rules find a better place. Rows whose L1 is unknown and undetectable are left out.

    ``taxonomy`` holds (l1, l2, l3, position): L2 lists in order, so the first L2 that lists an L3 wins.
    """
    l1s = taxonomy.select(F.col("l1").alias("_k1")).distinct()
    homes = taxonomy.groupBy(F.col("l1").alias("_h1"), F.col("l3").alias("_h3")).agg(F.min_by("l2", "position").alias("_home"))
    known = detect_l1(df, l1_rules, out="_det").join(l1s, F.col("category_l1") == F.col("_k1"), "left")
    rows = known.withColumn("new_l1", F.when(F.col("_k1").isNotNull(), F.col("category_l1")).otherwise(F.col("_det")))
    rows = rows.where(F.col("new_l1").isNotNull())
    rows = rows.join(homes, (F.col("new_l1") == F.col("_h1")) & (F.col("category_l3") == F.col("_h3")), "left")
    rows = classify_l3(rows, l3_rules, l1="new_l1")
    valid, old3 = F.col("_home").isNotNull(), F.col("category_l3")
    general = old3.isNull() | (old3 == "") | (old3 == "Geral") | (old3 == F.col("new_l1"))
    reason = (F.when(valid, "l3 in taxonomy").when(general, "keyword classify")
              .when(F.col("rule_l2").isNotNull(), "keyword override").otherwise("unknown l3 (keep as-is)"))
    out = rows.withColumns({
        "reason": reason, "final_l2": F.coalesce(F.when(valid, F.col("_home")).otherwise(F.col("rule_l2")), F.col("category_l2")),
        "final_l3": F.coalesce(F.when(valid, old3).otherwise(F.col("rule_l3")), old3),
    }).withColumn("changed", ~(F.col("final_l2").eqNullSafe(F.col("category_l2")) & F.col("final_l3").eqNullSafe(old3)))
    out = out.select(*df.columns, "new_l1", "final_l2", "final_l3", "reason", "changed")
    return out.where("changed") if changed_only else out


def change_breakdown(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many rows took each old -> new step."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def apply_cleanup(df: DataFrame, recipes: DataFrame) -> DataFrame:
    """Rewrite (l2, l3) by (l1, old_l2, old_l3, new_l2, new_l3); NULL matches NULL."""
    r = recipes.withColumn("_hit", F.lit(True))
    on = (F.col("category_l1") == F.col("l1")) & F.col("category_l2").eqNullSafe(F.col("old_l2")) & F.col("category_l3").eqNullSafe(F.col("old_l3"))
    joined = df.where("is_active").join(r, on)
    return joined.select(*[c for c in df.columns if c not in ("category_l2", "category_l3")],
                         F.col("category_l2").alias("old_l2"), F.col("category_l3").alias("old_l3"),
                         F.col("new_l2").alias("category_l2"), F.col("new_l3").alias("category_l3"))


def resolve_category(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Silver category by platform ids: all three levels, else two, else one.

    ``mapping`` holds (platform, platform_l1_id, platform_l2_id, platform_l3_id, silver_category_id, confidence) with
    NULL for the levels a row leaves open. Each level is an equi join; the most specific hit wins. Of several mappings for
    the same ids the surest counts, then the smallest category, so a product stays one row.
    """
    ids = [f"platform_l{i}_id" for i in (1, 2, 3)]
    out = df
    for depth in (3, 2, 1):
        open_ids = reduce(lambda a, b: a & b, [F.col(i).isNull() for i in ids[depth:]], F.lit(True))
        given = reduce(lambda a, b: a & b, [F.col(i).isNotNull() for i in ids[:depth]])
        hit = F.struct("silver_category_id", "confidence", F.lit(f"L{depth}").alias("match_level"))
        level = mapping.where(open_ids & given).groupBy("platform", *ids[:depth]).agg(
            F.min_by(hit, F.struct(-F.coalesce("confidence", F.lit(float("-inf"))), "silver_category_id")).alias(f"_m{depth}"))
        out = out.join(level, ["platform", *ids[:depth]], "left")
    best = F.coalesce("_m3", "_m2", "_m1")
    return out.select(*df.columns, best["silver_category_id"].alias("silver_category_id"),
                      best["confidence"].alias("confidence"), best["match_level"].alias("match_level"))


def resolved_stats(resolved: DataFrame, categories: DataFrame) -> DataFrame:
    """Products per resolved silver category."""
    return resolved.join(categories, "silver_category_id").groupBy("l1", "l2", "l3").agg(F.count(F.lit(1)).alias("product_count"))


def ensure_categories(paths: DataFrame, existing: DataFrame) -> DataFrame:
    """(l1, l2, l3) prefixes that the category table lacks, each once, from L1 down."""
    p = paths.where(F.col("l1").isNotNull()).distinct()
    none = F.lit(None).cast("string")
    prefixes = p.select("l1", none.alias("l2"), none.alias("l3")).unionByName(
        p.where(F.col("l2").isNotNull()).select("l1", "l2", none.alias("l3"))
    ).unionByName(p.where(F.col("l2").isNotNull() & F.col("l3").isNotNull()).select("l1", "l2", "l3")).distinct()
    e = existing.select(*[F.col(c).alias(f"_{c}") for c in ("l1", "l2", "l3")])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("l1", "l2", "l3")])
    return prefixes.join(e, same, "left_anti")


def taxonomy_paths(taxonomy: DataFrame) -> DataFrame:
    """Path from the root for every slug; a missing parent makes a root. Any depth: a round hangs the path of the topmost
    known ancestor before each slug's own, so the known part doubles. Parents that form a circle raise."""
    t = taxonomy.select("slug", "level", "parent_slug")
    parents = t.select(F.col("slug").alias("_up"))
    up = t.join(parents, F.col("parent_slug") == F.col("_up"), "left")
    out = checkpointed(up.withColumns({"path": F.col("slug"), "root": F.col("slug"), "depth": F.lit(1)}))
    known = 1
    while not (open_ := out.where(F.col("_up").isNotNull())).isEmpty():
        if known > 2 * out.count():
            raise ValueError("the parents of a taxonomy form a circle")
        above = out.select(F.col("slug").alias("_s"), F.col("path").alias("_path"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), F.col("_up").alias("_next"))
        longer = open_.join(above, F.col("_up") == F.col("_s")).select(
            "slug", "level", "parent_slug", F.col("_next").alias("_up"), F.concat_ws("/", "_path", "path").alias("path"), F.col("_root").alias("root"),
            (F.col("_depth") + F.col("depth")).alias("depth"))
        out = checkpointed(out.where(F.col("_up").isNull()).unionByName(longer))
        known *= 2
    return out.drop("_up")


def path_prefixes(path: Column) -> Column:
    """'a.b.c' -> ['a', 'a.b']: the slugs a path lies strictly below."""
    parts = F.split(path, r"\.")
    return F.when(F.size(parts) > 1, F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    ).otherwise(F.array().cast("array<string>"))


def taxonomy_counts(taxonomy: DataFrame, products: DataFrame, *, subtree: bool = True, active_only: bool = False) -> DataFrame:
    """Products per slug and children per slug. A product counts once at every slug it carries and, with ``subtree``,
    at every slug its dotted path lies below; its slugs are exploded once, so the OR of five conditions is one equi join."""
    p = products.where("is_active") if active_only else products
    own = F.array_compact(F.array("category", "category_n2", "category_n3", "category_n4"))
    above = F.coalesce(path_prefixes(F.col("category_path")), F.array().cast("array<string>"))
    slugs = F.array_distinct(F.concat(own, above)) if subtree else F.array_distinct(own)
    counts = p.select(F.explode(slugs).alias("slug")).groupBy("slug").agg(F.count(F.lit(1)).alias("product_count"))
    kids = taxonomy.groupBy(F.col("parent_slug").alias("slug")).agg(F.count(F.lit(1)).alias("children_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return taxonomy.join(counts, "slug", "left").join(kids, "slug", "left").select(
        "slug", "level", "parent_slug", zero("product_count"), zero("children_count"))


def taxonomy_backfill(products: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """N2-N4 and dotted path from the taxonomy entries at or below the product's category.

    Per category the last slug of a level (in slug order) wins; the table of winners is built from the taxonomy alone.
    """
    t = taxonomy.select("slug", "level", F.explode(F.array_append(path_prefixes(F.col("slug")), F.col("slug"))).alias("category"))
    last = F.element_at(F.split("slug", r"\."), -1)
    at = lambda level: F.max_by(F.when(F.col("level") == level, last), F.when(F.col("level") == level, F.col("slug")))
    best = t.groupBy("category").agg(*[at(i).alias(f"category_n{i}") for i in (2, 3, 4)])
    rows = products.where(F.col("category").isNotNull() & (F.col("category") != ""))
    joined = rows.join(best, "category", "left")
    return joined.withColumn("category_path", F.concat_ws(".", "category", "category_n2", "category_n3", "category_n4"))


def expand_keywords(taxonomy: DataFrame, extra: DataFrame) -> DataFrame:
    """Union of each slug's keywords with the extra (slug, keywords), sorted; ``added`` counts the new ones."""
    more = extra.groupBy("slug").agg(F.array_distinct(F.flatten(F.collect_list("keywords"))).alias("_more"))
    empty = F.array().cast("array<string>")
    own = F.coalesce("keywords", empty)
    merged = F.array_sort(F.array_union(own, F.coalesce("_more", empty)))
    return taxonomy.join(more, "slug", "left").withColumn("added", F.size(merged) - F.size(own)).withColumn("keywords", merged).drop("_more")
