"""Classification, taxonomy and category mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from souklens.functions import fixed
from souklens.operators import classify as k
from souklens.plans.registry import query


def has(*words):
    return " + ".join(f"contains(t, '{w}')::int" for w in words)


# A taxonomy out of the catalogue: a first level per group of brands, a second per brand and size class, a third per product, so
# that it has more nodes than there are products. Keywords are words of the products' names, types and brands.
KEYWORD_TAX = """
    select concat('b', p_size % 10) as slug, 1 as level, cast(null as {string}) as parent_slug, p_size % 10 as position, lower(max(p_brand)) as k1, lower(max(p_type)) as k2 from {part} group by p_size % 10
    union all select concat('b', p_size % 10, '.', p_size), 2, concat('b', p_size % 10), p_size, lower(min(p_brand)), lower(min(p_name)) from {part} group by p_size % 10, p_size
    union all select concat('b', p_size % 10, '.', p_size, '.', p_partkey), 3, concat('b', p_size % 10, '.', p_size), p_partkey, lower(p_name), lower(p_brand) from {part}"""


@query("c01_classify_keywords", f"""with s as (select id, lower(title) as t from products), x as ({KEYWORD_TAX.format(string='varchar', part='part')}),
h as (select slug, level, parent_slug, position, k1, k2 from x),
a as (select id, t, slug, contains(t, k1)::int + contains(t, k2)::int as hits, row_number() over (partition by id order by contains(t, k1)::int + contains(t, k2)::int desc, position) as rn from s, h where level = 1),
n1 as (select id, t, case when hits > 0 then slug else 'uncategorized' end as n1, case when hits > 0 then hits else 0 end as hits from a where rn = 1),
b as (select id, slug, row_number() over (partition by id order by contains(t, k1)::int + contains(t, k2)::int desc, position) as rn from n1 join h on level = 2 and parent_slug = n1 where contains(t, k1) or contains(t, k2)),
n2 as (select n1.*, b.slug as n2 from n1 left join b on b.id = n1.id and rn = 1),
c as (select id, slug, row_number() over (partition by id order by contains(t, k1)::int + contains(t, k2)::int desc, position) as rn from n2 join h on level = 3 and parent_slug = n2 where contains(t, k1) or contains(t, k2))
select n2.id, n1, n2, c.slug as n3, round(least(1.0, hits / 3.0), 6)::double as confidence_n1 from n2 left join c on c.id = n2.id and c.rn = 1""")
def _(c):
    nodes = c.spark.sql(KEYWORD_TAX.replace("{string}", "string"), part=c.table("part")).selectExpr("slug", "level", "parent_slug", "array(k1, k2) as keywords", "position")
    return k.classify_keywords(c.view("products").select("id", "title"), nodes).select("id", "n1", "n2", "n3", F.round("confidence_n1", 6).alias("confidence_n1"))


L1_RULES = [(r"\bring\b", "Joias"), (r"bolt|gear\b", "Ferragens"), (r"^(?:new|old)\s+anvil", "Pesados"), (r"promo", "Promo")]
L3_RULES = {
    "L1": [(r"\bring\b|gear", "Peças", "Anel"), (r"red", "Cor", "Vermelho")], "L2": [(r"widget", "Peças", "Widget")],
    "Ferragens": [(r"bolt", "Fixação", "Parafuso"), (r"gear", "Fixação", "Engrenagem")], "Joias": [(r"small", "Mini", "Anelzinho")],
}
L1_SQL = """case when regexp_matches(t, '\\bring\\b') then 'Joias' when regexp_matches(t, 'bolt|gear\\b') then 'Ferragens'
    when regexp_matches(t, '^(?:new|old)\\s+anvil') then 'Pesados' when regexp_matches(t, 'promo') then 'Promo' end"""


@query("c02_detect_l1", f"select id, {L1_SQL} as detected_l1 from (select id, lower(title) as t from products)")
def _(c):
    return k.detect_l1(c.view("products").select("id", "title"), L1_RULES).select("id", "detected_l1")


RULE = """case when {l1} = 'L1' then case when regexp_matches(t, '\\bring\\b|gear') then '{a}' when contains(t, 'red') then '{b}' end
    when {l1} = 'L2' then case when contains(t, 'widget') then '{c}' end
    when {l1} = 'Ferragens' then case when contains(t, 'bolt') then '{d}' when contains(t, 'gear') then '{e}' end
    when {l1} = 'Joias' then case when contains(t, 'small') then '{f}' end end"""
RULE_L2 = dict(a="Peças", b="Cor", c="Peças", d="Fixação", e="Fixação", f="Mini")
RULE_L3 = dict(a="Anel", b="Vermelho", c="Widget", d="Parafuso", e="Engrenagem", f="Anelzinho")


@query("c02_classify_l3", f"""select id, {RULE.format(l1='category_l1', **RULE_L2)} as rule_l2, {RULE.format(l1='category_l1', **RULE_L3)} as rule_l3
    from (select *, lower(title) as t from products)""")
def _(c):
    return k.classify_l3(c.view("products").select("id", "title", "category_l1"), L3_RULES).select("id", "rule_l2", "rule_l3")


# A rule for every name and type of a part, some hundreds in all: the name's words in order, with the type somewhere behind.
RULE_TABLE = """select distinct concat('\\b', split_part(p_name, ' ', 1), '\\b.*', split_part(p_name, ' ', 2), '.*\\b', lower(p_type)) as pattern,
    concat(lower(p_type), ' ', split_part(p_name, ' ', 1)) as v, concat(p_type, p_name) as position from {part}"""


@query("c02_rules_table", f"""with rules as ({RULE_TABLE.format(part='part')}),
hit as (select id, arg_min(v, (position, pattern)) as v from products join rules on regexp_matches(lower(title), pattern) group by 1)
select id, v as rule from products left join hit using (id)""")
def _(c):
    rules = c.spark.sql(RULE_TABLE.replace("\\", "\\\\"), part=c.table("part"))
    return c.view("products").select("id", k.first_rule("title", k.rule_list(rules, "v")).alias("rule"))


# A substring for every name and type, under each of ten L1s with its own order.
DICT_TABLE = """select distinct concat('L', label) as l1, (length(p_name) * 7 + label) % 5 as position, concat(p_name, ' ', lower(substr(p_type, 1, 3 + label % 3))) as substring, concat('Z', label) as l2, p_name as l3
    from {part} as part join (select distinct label from {embeddings}) as e on true"""


@query("c04_dict_table", f"""with rules as ({DICT_TABLE.format(part='part', embeddings='embeddings')}),
hit as (select id, arg_min(l2, (position, l2, l3)) as l2, arg_min(l3, (position, l2, l3)) as l3 from products join rules on l1 = category_l1 and contains(lower(title), substring) group by 1)
select id, coalesce(l2, category_l2) as category_l2, coalesce(l3, category_l3) as category_l3 from products left join hit using (id)""")
def _(c):
    rules = c.spark.sql(DICT_TABLE, part=c.table("part"), embeddings=c.table("embeddings"))
    return k.classify_by_table(c.view("products").select("id", "title", "category_l1", "category_l2", "category_l3"), rules).select("id", "category_l2", "category_l3")


LADDER = f"""with tax as (select 'L' || label as l1, 'Dois' || (label % 3) as l2, 'S' || (label % 4 + 1) as l3 from (select distinct label from embeddings) union all select 'Ferragens', 'Casa', 'S2'),
p as (select *, lower(title) as t, case when category_l1 in (select l1 from tax) then category_l1 else {L1_SQL.replace('t,', 'lower(title),')} end as new_l1 from products),
r as (select *, {RULE.format(l1='new_l1', **RULE_L2)} as r2, {RULE.format(l1='new_l1', **RULE_L3)} as r3,
      (select min(l2) from tax where tax.l1 = new_l1 and tax.l3 = category_l3) as home from p where new_l1 is not null),
f as (select id, new_l1, category_l2, category_l3, case when home is not null then home else coalesce(r2, category_l2) end as final_l2,
      case when home is not null then category_l3 else coalesce(r3, category_l3) end as final_l3,
      case when home is not null then 'l3 in taxonomy' when category_l3 in ('Geral', new_l1) then 'keyword classify' when r2 is not null then 'keyword override' else 'unknown l3 (keep as-is)' end as reason from r)"""


def ladder(c, changed_only=False):
    tax = c.table("embeddings").select("label").distinct().selectExpr(
        "concat('L', label) as l1", "concat('Dois', label % 3) as l2", "concat('S', label % 4 + 1) as l3", "label as position").union(
        c.spark.sql("select 'Ferragens', 'Casa', 'S2', 0"))
    p = c.view("products").select("id", "title", "category_l1", "category_l2", "category_l3")
    return k.categorize(p, tax, L1_RULES, L3_RULES, changed_only=changed_only)


@query("c03_categorize", LADDER + """ select id, new_l1, final_l2, final_l3, reason,
    final_l2 is distinct from category_l2 or final_l3 is distinct from category_l3 as changed from f""")
def _(c):
    return ladder(c).select("id", "new_l1", "final_l2", "final_l3", "reason", "changed")


@query("a38_change_breakdown", LADDER + """ select new_l1, category_l2, category_l3, final_l2, final_l3, count(*) as n from f
    where final_l2 is distinct from category_l2 or final_l3 is distinct from category_l3 group by all""")
def _(c):
    return k.change_breakdown(ladder(c, True), ["new_l1", "category_l2", "category_l3", "final_l2", "final_l3"])


@query("c04_classify_by_dict", """select id, case when l1 = 'Bolsas' and contains(t, 'mala') then 'Mala' when l1 = 'Bolsas' and contains(t, 'kit bolsa') then 'Bolsa'
    when l1 = 'Moda' and contains(t, 'camisa') then 'Vestuário' when l1 = 'Moda' and contains(t, 'tênis') then 'Calçado' else category_l2 end as category_l2,
    case when l1 = 'Bolsas' and contains(t, 'mala') then 'Viagem' when l1 = 'Bolsas' and contains(t, 'kit bolsa') then 'Kit'
    when l1 = 'Moda' and contains(t, 'camisa') then 'Camisa' when l1 = 'Moda' and contains(t, 'tênis') then 'Tênis' else category_l3 end as category_l3
from (select *, case when id % 3 = 0 then 'Bolsas' when id % 3 = 1 then 'Moda' else 'Casa' end as l1,
      lower(concat(title, ' ', ['Mala', 'Kit Bolsa', 'Camisa', 'TÊNIS', ''][id % 5 + 1])) as t from products)""")
def _(c):
    p = c.view("products").selectExpr(
        "id", "concat(title, ' ', element_at(array('Mala', 'Kit Bolsa', 'Camisa', 'TÊNIS', ''), cast(id % 5 + 1 as int))) as title",
        "case when id % 3 = 0 then 'Bolsas' when id % 3 = 1 then 'Moda' else 'Casa' end as category_l1", "category_l2", "category_l3")
    return k.classify_by_dict(p, {"Bolsas": fixed.BAG_RULES, "Moda": fixed.FASHION_RULES}).select("id", "category_l2", "category_l3")


MAPPING = """mapping as (select ['A', 'N', 'R'][label % 3 + 1] as platform, cast(label as varchar) as l1, case when label % 2 = 0 then cast(label % 5 as varchar) end as l2,
    case when label % 4 = 0 then 'F' end as l3, label * 10 as cat, label / 10.0::double as confidence from (select distinct label from embeddings))"""


def resolved(c):
    m = c.table("embeddings").select("label").distinct().selectExpr(
        "element_at(array('A', 'N', 'R'), label % 3 + 1) as platform", "cast(label as string) as platform_l1_id",
        "case when label % 2 = 0 then cast(label % 5 as string) end as platform_l2_id", "case when label % 4 = 0 then 'F' end as platform_l3_id",
        "label * 10 as silver_category_id", "label / 10D as confidence")
    rows = c.table("lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_returnflag as platform", "cast(l_partkey % 10 as string) as platform_l1_id",
        "cast(l_suppkey % 5 as string) as platform_l2_id", "case when l_linenumber < 5 then l_linestatus end as platform_l3_id")
    return k.resolve_category(rows, m)


RESOLVED = f"""{MAPPING}, rows as (select l_orderkey, l_linenumber, l_returnflag as platform, cast(l_partkey % 10 as varchar) as l1, cast(l_suppkey % 5 as varchar) as l2,
    case when l_linenumber < 5 then l_linestatus end as l3 from lineitem),
hits as (select r.*, coalesce(a.cat, b.cat, d.cat) as cat, coalesce(a.confidence, b.confidence, d.confidence) as confidence,
    case when a.cat is not null then 'L3' when b.cat is not null then 'L2' when d.cat is not null then 'L1' end as match_level from rows r
    left join mapping a on a.platform = r.platform and a.l1 = r.l1 and a.l2 = r.l2 and a.l3 = r.l3
    left join mapping b on b.platform = r.platform and b.l1 = r.l1 and b.l2 = r.l2 and b.l3 is null
    left join mapping d on d.platform = r.platform and d.l1 = r.l1 and d.l2 is null and d.l3 is null)"""


@query("j13_resolve_category", f"with {RESOLVED} select l_orderkey, l_linenumber, cat as silver_category_id, confidence, match_level from hits")
def _(c):
    return resolved(c).select("l_orderkey", "l_linenumber", "silver_category_id", "confidence", "match_level")


@query("a36_resolved_stats", f"with {RESOLVED} select concat('c', cat % 40) as l1, concat('d', cat) as l2, null::varchar as l3, count(*) as product_count from hits where cat is not null group by all")
def _(c):
    cats = c.table("embeddings").select("label").distinct().selectExpr(
        "label * 10 as silver_category_id", "concat('c', label * 10 % 40) as l1", "concat('d', label * 10) as l2", "cast(null as string) as l3")
    return k.resolved_stats(resolved(c), cats)


# Taxonomy out of the catalogue: L1 > brand group > type, one level each, some parents missing.
TAX = """tax as (select distinct 'L' || label as slug, 1 as level, null as parent_slug from embeddings
    union select distinct concat('L', p_size % 12, '.', p_type), 2, concat('L', p_size % 12) from part
    union select distinct concat('L', p_size % 12, '.', p_type, '.', split_part(p_name, ' ', 1)), 3, concat('L', p_size % 12, '.', p_type) from part)"""
CARRIED = """carried as (select p_partkey as id, concat('L', p_size % 12) as category, case when p_partkey % 3 > 0 then concat('L', p_size % 12, '.', p_type) end as category_n2,
    case when p_partkey % 3 = 2 then split_part(p_name, ' ', 1) end as category_n3, null::varchar as category_n4,
    concat_ws('.', concat('L', p_size % 12), p_type, split_part(p_name, ' ', 1)) as category_path from part)"""


def tax(c):
    part = c.table("part")
    top = c.table("embeddings").selectExpr("concat('L', label) as slug", "1 as level", "cast(null as string) as parent_slug")
    two = part.selectExpr("concat('L', p_size % 12, '.', p_type)", "2", "concat('L', p_size % 12)")
    three = part.selectExpr("concat('L', p_size % 12, '.', p_type, '.', split_part(p_name, ' ', 1))", "3", "concat('L', p_size % 12, '.', p_type)")
    return top.union(two).union(three).distinct()


def carried(c):
    return c.table("part").selectExpr(
        "p_partkey as id", "concat('L', p_size % 12) as category", "case when p_partkey % 3 > 0 then concat('L', p_size % 12, '.', p_type) end as category_n2",
        "case when p_partkey % 3 = 2 then split_part(p_name, ' ', 1) end as category_n3", "cast(null as string) as category_n4",
        "concat_ws('.', concat('L', p_size % 12), p_type, split_part(p_name, ' ', 1)) as category_path")


COUNTS = """select slug, level::int as level, parent_slug, (select count(*) from carried p where p.category = t.slug or p.category_n2 = t.slug or p.category_n3 = t.slug or p.category_n4 = t.slug %s) as product_count,
    (select count(*) from tax x where x.parent_slug = t.slug) as children_count from tax t"""


COUNTED = "counted as (" + COUNTS % "or starts_with(p.category_path, t.slug || '.')" + ")"


@query("a35_taxonomy_counts", f"with {TAX}, {CARRIED} " + COUNTS % "or starts_with(p.category_path, t.slug || '.')")
def _(c):
    return k.taxonomy_counts(tax(c), carried(c))


@query("a35_taxonomy_counts_own", f"with {TAX}, {CARRIED} " + COUNTS % "")
def _(c):
    return k.taxonomy_counts(tax(c), carried(c), subtree=False)


@query("u08_taxonomy_paths", f"""with recursive {TAX}, walk as (
    select slug, level, parent_slug, slug as path, slug as root, 1 as depth from tax where parent_slug is null or parent_slug not in (select slug from tax)
    union all select t.slug, t.level, t.parent_slug, concat(w.path, '/', t.slug), w.root, w.depth + 1 from tax t join walk w on t.parent_slug = w.slug)
select slug, level::int as level, parent_slug, path, root, depth::int as depth from walk""")
def _(c):
    return k.taxonomy_paths(tax(c))


@query("u09_taxonomy_backfill", f"""with {TAX}, best as (select c.category, max(slug) filter (where level = 2) as s2, max(slug) filter (where level = 3) as s3
    from (select distinct concat('L', p_size % 12) as category from part) c left join tax on slug = c.category or starts_with(slug, c.category || '.') group by 1)
select p_partkey as id, concat('L', p_size % 12) as category, string_split(s2, '.')[-1] as category_n2, string_split(s3, '.')[-1] as category_n3, null::varchar as category_n4,
    concat_ws('.', concat('L', p_size % 12), string_split(s2, '.')[-1], string_split(s3, '.')[-1]) as category_path from part join best on category = concat('L', p_size % 12)""")
def _(c):
    return k.taxonomy_backfill(carried(c).select("id", "category"), tax(c)).select(
        "id", "category", "category_n2", "category_n3", "category_n4", "category_path")


@query("u10_expand_keywords", """with own as (select p_brand as slug, list(distinct split_part(p_name, ' ', 1)) as w from part group by 1),
extra as (select case when p_size > 40 then p_brand else concat(p_brand, ' *') end as slug, list(distinct split_part(p_name, ' ', 2)) as w from part group by 1),
u as (select o.slug, o.w, list_distinct(list_concat(o.w, coalesce(e.w, []))) as m from own o left join extra e using (slug))
select slug, array_to_string(list_sort(m), ',') as keywords, (len(m) - len(w))::int as added from u""")
def _(c):
    part = c.table("part")
    word = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    own = part.groupBy(F.col("p_brand").alias("slug")).agg(F.collect_set(word(1)).alias("keywords"))
    extra = part.groupBy(F.expr("case when p_size > 40 then p_brand else concat(p_brand, ' *') end").alias("slug")).agg(F.collect_set(word(2)).alias("keywords"))
    return k.expand_keywords(own, extra).select("slug", F.array_join("keywords", ",").alias("keywords"), "added")


@query("u11_ensure_categories", """with p as (select category_l1 as l1, case when id % 5 <> 0 then category_l2 end as l2, category_l3 as l3 from products),
x as (select distinct l1, null as l2, null as l3 from p union select l1, l2, null from p where l2 is not null union select l1, l2, l3 from p where l2 is not null and l3 is not null)
select * from x where (l1 = 'L1' and l2 is null) is not true and (l1 = 'L2' and l2 = 'PROMO') is not true""")
def _(c):
    paths = c.view("products").selectExpr("category_l1 as l1", "case when id % 5 <> 0 then category_l2 end as l2", "category_l3 as l3")
    have = paths.where("l1 = 'L2' and l2 = 'PROMO'").union(paths.where("l1 = 'L2' and l2 = 'PROMO'").selectExpr("l1", "l2", "cast(null as string)")).union(
        paths.where("l1 = 'L1'").selectExpr("l1", "cast(null as string)", "cast(null as string)"))
    return k.ensure_categories(paths, have.distinct())


@query("u12_apply_cleanup", """with r as (select distinct category_l1 as l1, case when category_l2 = 'PROMO' then null else category_l2 end as old2, category_l3 as old3 from products where category_l3 in ('Geral', 'S1'))
select id, category_l1, old_l2, category_l3 as old_l3, 'new ' || old_l2 as category_l2, case when category_l3 = 'S1' then null else 'Outros' end as category_l3
from (select *, case when category_l2 = 'PROMO' then null else category_l2 end as old_l2 from products where is_active) where category_l3 in ('Geral', 'S1')""")
def _(c):
    p = c.view("products").selectExpr("id", "category_l1", "case when category_l2 = 'PROMO' then null else category_l2 end as category_l2", "category_l3", "is_active")
    r = p.where("category_l3 in ('Geral', 'S1')").selectExpr("category_l1 as l1", "category_l2 as old_l2", "category_l3 as old_l3").distinct()
    r = r.selectExpr("*", "concat('new ', old_l2) as new_l2", "case when old_l3 = 'S1' then null else 'Outros' end as new_l3")
    return k.apply_cleanup(p, r).drop("is_active")
