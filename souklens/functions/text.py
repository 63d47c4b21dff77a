"""Text columns: cleaning, keywords, translation by dictionary, supplier and badge fields, URLs."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, functions as F

from souklens.functions import fixed
from souklens.functions.numbers import col


def pattern(regex: str, ignore_case: bool = False) -> str:
    """Regex flags for Unicode classes and newline-only line ends, as in the scraped pages' tools."""
    return f"(?{'iu' if ignore_case else ''}Ud){regex}"


def extract(c: Column | str, regex: str, group: int = 1, ignore_case: bool = False) -> Column:
    """First match of a group, NULL (not '') where nothing or an empty group matches."""
    return F.nullif(F.regexp_extract(col(c), pattern(regex, ignore_case), group), F.lit(""))


def extract_all(c: Column | str, regex: str, group: int = 1, ignore_case: bool = False) -> Column:
    return F.regexp_extract_all(col(c), F.lit(pattern(regex, ignore_case)), F.lit(group))


def clean_text(c: Column | str) -> Column:
    """Collapse runs of whitespace and trim."""
    return F.trim(F.regexp_replace(col(c), pattern(r"\s+"), " "))


def extract_keywords(title: Column | str, k: int = 6, stopwords: Iterable[str] = fixed.KEYWORD_STOPWORDS) -> Column:
    """First ``k`` distinct meaningful words, in order; [] for a missing title."""
    stop = F.array(*[F.lit(w) for w in stopwords])
    plain = F.regexp_replace(F.lower(col(title)), pattern(r"[^a-z0-9áéíóúãõçâêîôûàèìòùäëïöüñ\s-]"), " ")
    # array_except keeps first-seen order and drops repeats, with one hash lookup per word.
    words = F.filter(F.array_except(F.split(plain, pattern(r"[\s,-]+")), stop), lambda w: F.length(w) >= 2)
    return F.coalesce(F.slice(words, 1, k), F.array().cast("array<string>"))


def search_terms(title: Column | str, k: int = 6) -> Column:
    """Keywords as one query; a title without any gives its first four words."""
    found = extract_keywords(title, k)
    words = F.filter(F.split(col(title), pattern(r"\s+")), lambda w: w != "")
    return F.array_join(F.when(F.size(found) > 0, found).otherwise(F.slice(words, 1, 4)), " ")


def has_chinese(c: Column | str) -> Column:
    return col(c).rlike("[一-鿿]")


def translate_cn_pt(c: Column | str, dictionary: Mapping[str, str]) -> Column:
    """Replace dictionary terms one after the other, longest first; texts without Chinese stay as they are."""
    terms = sorted(dictionary, key=len, reverse=True)
    done = reduce(lambda text, t: F.replace(text, F.lit(t), F.lit(dictionary[t])), terms, col(c))
    return F.when(has_chinese(c), done).otherwise(col(c))


def pt_to_cn(query: Column | str, dictionary: Mapping[str, str]) -> Column:
    """Term for the whole query, else for the first dictionary key it contains, else NULL."""
    q = F.trim(F.lower(col(query)))
    exact = reduce(lambda w, kv: w.when(q == kv[0], F.lit(kv[1])), dictionary.items(), F)
    part = reduce(lambda w, kv: w.when(F.contains(q, F.lit(kv[0])), F.lit(kv[1])), dictionary.items(), F)
    return F.coalesce(exact, part)


def build_queries(query: Column | str, dictionary: Mapping[str, str]) -> Column:
    return F.array_compact(F.array(col(query), pt_to_cn(query, dictionary)))


def extract_province(supplier: Column | str, cities: Mapping[str, str] = fixed.CITY_PROVINCE,
                     english: Mapping[str, str] = fixed.PROVINCE_EN) -> Column:
    """English province by the place name a supplier's name starts with."""
    s = col(supplier)
    return reduce(lambda w, kv: w.when(s.startswith(kv[0]), F.lit(english.get(kv[1], kv[1]))), cities.items(),
                  F.when(s.isNull() | (s == "Unknown"), F.lit(None).cast("string")))


def clean_badges(badges: Column | str) -> Column:
    """Cut each badge at '](' and drop the empty ones."""
    return F.filter(F.transform(col(badges), lambda b: F.substring_index(b, "](", 1)), lambda b: b != "")


def rank_type(badges: Column | str, fallback: Column | None = None, ranks: Mapping[str, str] = fixed.BADGE_RANK) -> Column:
    """Rank type of the first known badge, else the fallback column."""
    table = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    known = F.filter(col(badges), lambda b: F.map_contains_key(table, b))
    hit = F.try_element_at(table, F.get(known, F.lit(0)))
    return F.coalesce(hit, fallback) if fallback is not None else hit


def json_strings(c: Column | str) -> Column:
    """The strings of a JSON array; other members are dropped, anything else is []."""
    items = F.try_variant_get(F.try_parse_json(col(c)), "$", "array<variant>")
    strings = F.filter(items, lambda v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(F.transform(strings, lambda v: F.try_variant_get(v, "$", "string")), F.array().cast("array<string>"))


def parse_product_url(url: Column | str) -> Column:
    """struct(platform, platform_id) by the first matching pattern, NULL fields where none matches."""
    u = col(url)
    hits = [(extract(u, p), name) for p, name in fixed.URL_PATTERNS]
    platform = reduce(lambda w, h: w.when(h[0].isNotNull(), F.lit(h[1])), hits, F)
    return F.struct(platform.alias("platform"), F.coalesce(*[h for h, _ in hits]).alias("platform_id"))


def url_key(url: Column | str) -> Column:
    return F.sha2(col(url), 256)


def allowed_host(url: Column | str, hosts: Iterable[str] = fixed.IMAGE_HOSTS) -> Column:
    """Host ends with one of the allowed names; a URL without a host is refused."""
    host = F.try_parse_url(col(url), F.lit("HOST"))
    hit = reduce(lambda a, b: a | b, [host.endswith(h) for h in hosts])
    return F.coalesce(hit, F.lit(False))


def title_key(c: Column | str) -> Column:
    return F.lower(F.trim(col(c)))
