"""The registered queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from souklens.llm import ann, decontam, langid, licenses, negatives, pieces, quality, ranked, secrets, shards, simhash, suffixes, toxicity
from souklens.llm.common import fold, table


def held_out(doc_id: str, n: int, remainder: int) -> Column:
    """Not to be learned from; a NULL id counts as held out."""
    return F.coalesce(fold(doc_id, n) == remainder, F.lit(True))


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents")).select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids", "round_trip")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = langid.train_model(docs.where(~held_out("doc_id", 5, 0)))
    found = langid.predict(docs, net)
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), F.col("lang").alias("lang_pred"), "score")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train_model(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0)))
    found = toxicity.score(docs, model)
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                        F.size("sentences").alias("n_sentences"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(kind):
        return F.filter("spans", lambda s: s["kind"] == kind)

    found = secrets.secret_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex", "random")],
                        F.sha2(digest(F.filter("spans", lambda s: s["kind"] != "random")).cast("binary"), 256).alias("base_sha256"),
                        digest(F.col("spans")).alias("spans"))


# Each document and item as its words; a window is joined with every document word that starts like it.
OP7_SQL = """
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from documents),
     b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from benchmark),
     bw as (select distinct item_id, least(len(w), 10) k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') win
            from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) i from b where len(w) > 0)),
     dw as (select doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') win
            from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) i from d, (select distinct k from bw))),
     hits as (select doc_id, item_id, i, k from dw join bw using (k, win)),
     words as (select doc_id, count(distinct p) n from (select doc_id, unnest(range(i, i + k)) p from hits) group by 1),
     its as (select doc_id, count(distinct item_id) n, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) ids from hits group by 1)
select d.doc_id, cast(len(d.w) as bigint) n_words, cast(coalesce(words.n, 0) as bigint) n_hit, cast(coalesce(its.n, 0) as bigint) n_items,
       sha256(coalesce(its.ids, '')) items_sha256, coalesce(words.n, 0) > 0 contaminated
from d left join words using (doc_id) left join its using (doc_id)
"""


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), keep_bytes=False).drop("kept")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_labels(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = quality.train_model(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id", 4, 2)))
    found = quality.score(docs, net)
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


# Items and documents as their terms; a weight comes from the document counts of a term.
OP11_SQL = """
with d as (select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from documents),
     i as (select distinct item, item_id, unnest(w) t from (select row_number() over () item, item_id, regexp_extract_all(
              translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from benchmark)),
     s as (select count(*) n, sum(len(w))::bigint l from d where len(w) > 0),
     p as (select r, doc_id, t, count(*) tf, any_value(n) n from (select r, doc_id, len(w) n, unnest(w) t from d) where t in (select t from i) group by all),
     wt as (select t, cast(floor(1000 * ln((2 * any_value(s.n) + 2)::double / (2 * count(*) + 1)::double)) as bigint) w from p, s group by t),
     sc as (select item, item_id, r, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * p.n * s.n) // s.l)))) as bigint) score
            from p join i using (t) join wt using (t), s group by all)
select item_id, cast(rank as int) rank, doc_id, score
from (select *, row_number() over (partition by item order by score desc, doc_id nulls last) rank from sc where score > 0) where rank <= 10
"""


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shards.shard_documents(table(spark, sf_dir, "documents"), shards=40)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP13_SQL = """
with v as (select vec_id id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label::bigint end lab,
                  [floor(256 * x::double) for x in embedding] q
           from embeddings where label is not null and embedding is not null and vec_id is not null
             and len([1 for x in embedding if x is null or not isfinite(x)]) = 0),
     s as (select a.id a, b.id b, a.lab = b.lab same, cast(list_dot_product(a.q, b.q) as bigint) sc
           from v a join v b on a.id <> b.id and len(a.q) = len(b.q) where a.id % 50 = 0),
     p as (select a, b, sc from (select *, row_number() over (partition by a order by sc desc, b) r from s where same) where r <= 5),
     n as (select p.a, p.b, s.b x, p.sc ps, s.sc ns, row_number() over (partition by p.a, p.b order by s.sc desc, s.b) r
           from p join s on p.a = s.a and not s.same and 50 * p.sc <= 100 * s.sc and 100 * s.sc <= 95 * p.sc)
select a anchor_id, b positive_id, cast(r as int) rank, x negative_id, ps positive_score, ns negative_score from n where r <= 3
"""


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return negatives.hard_negatives(rows, F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann": op1_ann,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_langid": op3_langid,
    "op4_toxicity": op4_toxicity,
    "op5_simhash": op5_simhash,
    "op6_secrets": op6_secrets,
    "op7_decontam": op7_decontam,
    "op8_suffixes": op8_suffixes,
    "op9_licenses": op9_licenses,
    "op10_quality": op10_quality,
    "op11_ranked": op11_ranked,
    "op12_shards": op12_shards,
    "op13_negatives": op13_negatives,
}
ORACLES: dict[str, str] = {
    "op7_decontam": OP7_SQL,
    "op11_ranked": OP11_SQL,
    "op13_negatives": OP13_SQL,
}
