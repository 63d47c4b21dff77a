"""License scan: ordered signature rules on DataFrame functions only.

One pass over the texts counts words and, where the text holds a gate word at all, takes the words around each one. From there
on only these contexts move. A context meets the rules of its gate word (a table of fixed size), and a match becomes a detection
with word positions. A detection inside a longer one, or in the same place as a stronger one, is suppressed; of two that overlap in part, the weaker is.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window, functions as F

from souklens.llm.license_rules import BASE, rules
from souklens.session import checkpointed

AROUND = 24  # words on each side of a gate word; no rule reaches farther
NOT_WORD = r"[^0-9a-z\x{80}-\x{10FFFF}]+"
WORD_ANY_CASE = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def _lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _contexts(text: Column, gates: list[str]) -> Column:
    """(at, gate, context) of every gate word; the context marks it by @, and at is the place of the context's first word."""
    words = F.split(F.trim(F.regexp_replace(_lower(text), NOT_WORD, " ")), " ")

    def around(w: Column) -> Column:
        hits = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("gate"), i.alias("i"))), lambda s: s["gate"].isin(gates))
        return F.transform(hits, lambda s: F.struct(
            F.greatest(s["i"] - AROUND, F.lit(0)).alias("at"), s["gate"].alias("gate"),
            F.concat_ws(" ", F.slice(w, F.greatest(s["i"] - AROUND, F.lit(0)) + 1, F.least(s["i"], F.lit(AROUND))),
                        F.concat(F.lit("@"), s["gate"]), F.slice(w, s["i"] + 2, F.lit(AROUND))).alias("context")))

    return F.transform(F.array(words), around)[0]  # the array binds the words once


def detections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, found): rows is (row, doc_id, n_words) for every input row; found is (row, label, base, priority, confidence,
    start, end) before suppression, in words from 0, the end exclusive."""
    spark = docs.sparkSession
    table = [(label, False, p, c, gate, regex) for label, p, c, gate, regex in rules()]
    table += [(label, True, 9, 0.0, phrase.split()[-1], rf"(?:^| )({' '.join(phrase.split()[:-1])} @{phrase.split()[-1]})(?= |$)") for label, phrase in BASE]
    gates = sorted({r[4] for r in table})
    known = spark.createDataFrame(table, "label string, base boolean, priority int, confidence double, gate string, regex string")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    held = text.rlike("(?i)" + "|".join(gates))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
        F.regexp_count(text, F.lit(WORD_ANY_CASE)).cast("long").alias("n_words"),
        F.when(held, _contexts(text, gates)).alias("contexts"))
    rows = checkpointed(rows)
    places = rows.where(F.size("contexts") > 0).select("row", F.explode("contexts").alias("c")).select("row", "c.*")
    # Equal contexts are judged once, however many rows hold them.
    once = places.select("gate", "context").distinct().join(F.broadcast(known), "gate").where(F.expr("regexp_instr(context, regex) > 0"))
    judged = once.select("gate", "context", "label", "base", "priority", "confidence",
                         F.expr("length(substr(context, 1, locate(regexp_extract(context, regex, 1), context) - 1)) - length(replace(substr(context, 1, locate(regexp_extract(context, regex, 1), context) - 1), ' ', ''))").alias("skip"),
                         F.expr("size(split(regexp_extract(context, regex, 1), ' '))").alias("length"))
    found = places.join(judged, ["gate", "context"]).select(
        "row", "label", "base", "priority", "confidence", (F.col("at") + F.col("skip")).alias("start"), (F.col("at") + F.col("skip") + F.col("length")).alias("end"))
    return rows.select("row", "doc_id", "n_words"), checkpointed(found.distinct())


def unsuppressed(found: DataFrame) -> DataFrame:
    """Of each row's detections those that neither lie in another nor overlap a stronger one, whether that one stays or not."""
    order = [F.col("start"), F.col("end").desc(), F.col("priority"), F.col("label")]
    before = Window.partitionBy("row").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = found.withColumn("reach", F.max("end").over(before)).where(F.col("reach").isNull() | (F.col("reach") < F.col("end")))
    # Two detections overlap where they share a word, so the strongest at any of its words is the strongest that one overlaps.
    words = outer.drop("reach").withColumn("word", F.explode(F.sequence(F.col("start"), F.col("end") - 1)))
    strongest = words.withColumn("strongest", F.min("priority").over(Window.partitionBy("row", "word")))
    return strongest.groupBy(*found.columns).agg(F.min("strongest").alias("strongest")).where(F.col("strongest") >= F.col("priority")).drop("strongest")


def license_labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score): one row per input row.

    Base counts all places of the base phrases and takes no part in suppression; labels joins base labels and those of the detections that
    stay. score is the confidence of the surest detection, 0 without one. NULL and empty texts have no words; repeated rows get equal answers.
    Columns other than the two named are not read.
    """
    rows, found = detections(docs, id_col, text_col)
    base = found.where("base").groupBy("row").agg(
        F.count("*").alias("n_base"), F.min("start").cast("long").alias("first_word"), F.max("start").cast("long").alias("last_word"),
        F.sort_array(F.collect_set("label")).alias("base_labels"))
    kept = unsuppressed(found.where("not base")).groupBy("row").agg(F.collect_set("label").alias("own"), F.max("confidence").alias("score"))
    none = F.array().cast("array<string>")
    every = base.join(kept, "row", "full")
    return rows.join(every, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.array_join(F.coalesce("base_labels", none), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(F.coalesce("base_labels", none), F.coalesce("own", none))), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
