"""The pipeline against its decisions made by brute force, and the contract queries on the small tables."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from souklens.llm import pieces, toxicity
from souklens.llm.common import BATCH, BATCH_ROWS, small_batches
from souklens.llm.queries import ORACLES, QUERIES
from tests.compare import connect, difference
from tests.llm.test_near_copies import near_roots
from tests.llm.test_ops import base_secrets, contaminated, invented

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    syl = ["the", "ing", "wh", "ou", "er", "an", "ti"]
    texts = []
    for i in range(120):
        t = " ".join(invented(rng, syl, rng.randint(6, 14)) for _ in range(6))
        if i % 5 == 0:
            t += " You grumf of it."
        if i % 17 == 1:
            t += ' token = "abcdef0123456789"'
        texts.append(t)
    items = [(k, invented(rng, syl, 12)) for k in range(3)]
    texts[7] += " " + items[1][1]
    texts[33] = texts[32]
    texts += [None, "", texts[41] + " end"]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, texts, items


def test_pipeline_equals_its_stages_by_brute_force(spark, corpus):
    d, texts, items = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train_model(docs, spark.read.parquet(f"{d}/labels.parquet"))).collect()}
    kept = [i for i in range(len(texts)) if scores[i] < 0.5]
    assert all((scores[i] >= 0.5) == (i % 5 == 0) for i in range(120))
    kept = [i for i, r in zip(kept, near_roots([texts[i] for i in kept])) if kept[r] == i]
    kept = [i for i, c in zip(kept, contaminated([texts[i] for i in kept], items)) if not c[1]]
    want = {}
    for i in kept:
        t, at, out = texts[i], 0, ""
        for _, s, e in sorted(base_secrets(t), key=lambda x: x[1:]):
            if s >= at:
                out += t[at:s] + "[SECRET]"
            at = max(at, e)
        want[i] = None if t is None else out + t[at:]
    got = corpus_pipeline.run(spark, d)
    assert got.columns == ["doc_id", "n_tokens", "ids", "round_trip"]
    from souklens.llm import pieces

    back = {r.doc_id: r.text for r in pieces.decode(got).collect()}
    assert back == want


def test_stages_keep_the_columns_and_take_empty_tables(spark, corpus):
    d, _, _ = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        assert out.count() == 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, name):
    found, _ = difference(QUERIES[name](spark, SMALL), connect(SMALL), ORACLES[name])
    assert found is None, found


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_answer_every_row(spark, name):
    out = QUERIES[name](spark, SMALL)
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    many = {"op1_ann": 50, "op11_ranked": 400, "op13_negatives": None}  # searches and pairs
    assert out.count() == many.get(name, n) or many.get(name, n) is None


def test_every_stage_has_texts_sent_in_small_batches(spark, corpus):
    """A batch of 10,000 texts took an executor over its memory in the check."""
    import pyarrow as pa

    d, _, _ = corpus
    before = spark.conf.get(BATCH)
    rows = spark.range(0, 2 * BATCH_ROWS + 5, 1, 1)
    largest = lambda: max(r.n for r in rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect())
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.unset(BATCH)
            stage(spark, spark.read.parquet(f"{d}/documents.parquet").limit(20), d)
            assert largest() <= BATCH_ROWS
        spark.conf.set(BATCH, 300)  # a smaller choice of the session stays
        small_batches(spark)
        assert spark.conf.get(BATCH) == "300" and largest() <= 300
    finally:
        spark.conf.set(BATCH, before)


def test_encoder_with_few_remembered_parts_gives_the_same_pieces(spark, corpus):
    """Its tables of 250,000 parts and pairs took an executor over its memory in the check of the pipeline."""
    d, texts, _ = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = lambda df: sorted((r.doc_id, r.ids, r.round_trip) for r in df.collect())
    assert rows(pieces.encode(docs, remembered=5)) == rows(pieces.encode(docs))
    with open(pieces.MODEL, "rb") as f:
        small = pieces.Transducer(f.read(), 5)
    for t in texts:
        small.encode(t or "")
    assert all(len(t) <= 5 and len(t.old) <= 5 for t in (small.adjacent, small.paths, small.words))
