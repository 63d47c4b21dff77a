"""Each operator against a brute-force version, and on the awkward inputs that its docstring gives a result for."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from souklens.llm import ann, decontam, langid, licenses, pieces, quality, secrets, simhash, suffixes, toxicity
from souklens.llm.components import components
from souklens.llm.license_rules import rules

DOCS = "doc_id long, text string, fp string, row int, label string, spans string"
LONG = "wort " * 30_000 + "token = 'abcdef123456'"


def docs_of(spark, texts, ids=None):
    """Documents with extra columns whose names clash with those that operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in zip(ids, texts)], DOCS)


AWKWARD = [None, "", "   \n\t ", "one", "two words", LONG, "same text here", "same text here", "🙂 é ß 日本", "a\x00b"]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# -- 5 -----------------------------------------------------------------------------------------------------------------

def fingerprint(text, words=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in ([w[i:i + words] for i in range(len(w) - words + 1)] or [w])]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def linked(ids, fps, bits=3):
    root = {i: i for i in ids}
    for _ in ids:
        for a, f in zip(ids, fps):
            for b, g in zip(ids, fps):
                if (f ^ g).bit_count() <= bits:
                    root[a] = root[b] = min(root[a], root[b])
    return root


def test_simhash_fingerprints_and_components(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away into the deep dark woods " * 6
    texts = [*AWKWARD, base, base + "tail", base.upper(), base.replace("lazy", "idle", 1), "", "ÀÉ Ç x"]
    found = {r.doc_id: r for r in simhash.near_duplicates(docs_of(spark, texts)).collect()}
    want = [fingerprint(t) for t in texts]
    assert [found[i].fp % (1 << 64) for i in range(len(texts))] == want
    assert {i: r.component_id for i, r in found.items()} == linked(range(len(texts)), want)
    assert found[0].component_id == found[1].component_id == found[2].component_id == 0


def test_simhash_repeated_and_null_ids_and_empty_table(spark):
    got = rows(simhash.near_duplicates(docs_of(spark, ["a b c d", "a b c d", "q", None], [7, 7, None, None])).select("doc_id", "component_id").fillna(-1))
    assert got == [(-1, -1), (-1, -1), (7, 7), (7, 7)]
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_vantage_point_trees_lose_no_link(seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    points = [rng.integers(0, 1 << 63, 400, dtype=np.uint64)]
    for _ in range(900):
        p = rng.choice(centres)
        for b in rng.integers(0, 64, rng.integers(0, 6)):
            p ^= np.uint64(1) << np.uint64(b)
        points.append(np.array([p]))
    points = np.unique(np.concatenate(points))
    near = np.argwhere(np.bitwise_count(points[:, None] ^ points[None, :]) <= 3)
    label = np.arange(len(points))
    parts = []
    for half in (0, 1):
        short = simhash._half(points, half)
        tree, n = simhash.top_tree(short, 3, seed)
        at, home = simhash.route(tree, short, 0)
        assert sorted(at.tolist()) == list(range(len(points)))
        asks, shard = simhash.route(tree, short, 1)
        for s in range(n):
            parts.append(simhash.shard_links(points[at[home == s]], points[asks[shard == s]], half, 3))
    index = {p: i for i, p in enumerate(points.tolist())}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    edges = 0
    for a, b in parts:
        assert (np.bitwise_count(a) >= 0).all()
        for x, y in zip(a.tolist(), b.tolist()):
            edges += 1
            p, q = root(index[x]), root(index[y])
            label[max(p, q)] = min(p, q)
    assert all(root(i) == root(j) for i, j in near.tolist())
    alone = set(range(len(points))) - {i for i, j in near.tolist() if i != j}
    assert all(root(i) == i for i in alone)
    assert edges < 8 * len(points)


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(200, 260)] + [(5, 5), (None, 3)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[i] == 1 for i in range(200, 260)) and 5 not in got


# -- 7 -----------------------------------------------------------------------------------------------------------------

def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))


def contaminated(texts, items, window=10):
    out = []
    for t in texts:
        w, hit, ids = words(t), set(), set()
        for item, text in items:
            v = words(text)
            k = min(window, len(v))
            for j in range(len(v) - k + 1 if k else 0):
                for i in range(len(w) - k + 1):
                    if w[i:i + k] == v[j:j + k]:
                        hit |= set(range(i, i + k))
                        ids.add(str(item))
        out.append((len(w), len(hit), sorted(ids)))
    return out


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(3)
    vocab = ["a", "b", "c", "dé", "e1"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 2, 3, 9, 10, 14])))) for i in range(12)] + [(3, "A B! c"), (77, None), (78, "a b c")]
    texts = [*AWKWARD, *[" ".join(rng.choices(vocab, k=rng.randint(0, 60))) + rng.choice(["", ". " + (rng.choice(items)[1] or "")]) for _ in range(30)]]
    got = decontam.contamination(docs_of(spark, texts), spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, n int")).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, list(r.item_ids)) for r in got}
    assert [got[i] for i in range(len(texts))] == contaminated(texts, items)


def test_decontamination_without_items_and_with_repeated_rows(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert rows(decontam.contamination(docs_of(spark, ["x y", None]), none)) == [(0, 2, 0, []), (1, 0, 0, [])]
    one = spark.createDataFrame([(1, "x y")], "item_id long, text string")
    assert rows(decontam.contamination(docs_of(spark, ["x y", "x y z", "q"], [5, 5, None]), one).fillna(-1)) == [(-1, 1, 0, []), (5, 2, 2, ["1"]), (5, 3, 2, ["1"])]
    assert decontam.contamination(docs_of(spark, []), one).count() == 0


# -- 6 -----------------------------------------------------------------------------------------------------------------

def base_secrets(text):
    text = text or ""
    out = [("assign", *m.span()) for m in re.finditer(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_secret_base_spans_equal_brute_force(spark):
    texts = [*AWKWARD, 'PassWord: "hunter22"; ſecret=abcdefgh token=abc', "api_key='k-1.2/3+4' apikey = zzzzzz", "xAKIA" + "A1" * 9, "é" * 5 + "0f" * 13 + "G",
             "token=" + "a0" * 15 + " secret: secret: abcdef", "password=short passwd=12345 Kelvin toKen=123456"]
    got = {r.doc_id: [tuple(s) for s in r.spans if s["kind"] != "random"] for r in secrets.secret_spans(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [base_secrets(t) for t in texts]


def test_randomness_battery_keeps_keys_and_drops_structure(spark):
    rng = random.Random(1)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(rng.choices(alphabet, k=40)) for _ in range(40)]
    plain = ["/usr/local/share/documents/archive/2024/january" + "a" * (i % 3) for i in range(20)] + ["internationalisierungskommissionsvorsitz" * 2, "0123456789" * 5, "x" * 60]
    found = secrets.secret_spans(docs_of(spark, [f"see {t} now" for t in keys + plain])).collect()
    flagged = [bool([s for s in r.spans if s["kind"] == "random"]) for r in sorted(found, key=lambda r: r.doc_id)]
    assert sum(flagged[:40]) >= 36 and sum(flagged[40:]) == 0


@pytest.mark.parametrize("length", [20, 21, 22, 24])
def test_short_keys_are_told_from_words_of_their_length(spark, length):
    """Keys of any length from 20 on take part; of what is reported, words and paths are few."""
    rng = random.Random(length)
    words = "server window report archive member library account button history public network january session value index".split()
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choices(alphabet, k=length)) for _ in range(60)]
    camel = ["".join(w.capitalize() + (str(rng.randint(0, 99)) if rng.random() < 0.7 else "") for w in rng.choices(words, k=8))[:length] for _ in range(120)]
    joined = ["".join(rng.choices(words, k=8))[:length] for _ in range(120)]
    texts = [" ".join([*rng.choices(words, k=20), t, *rng.choices(words, k=20)]) for t in keys + camel + joined]
    found = secrets.secret_spans(docs_of(spark, texts)).collect()
    flagged = [bool([s for s in r.spans if s["kind"] == "random"]) for r in sorted(found, key=lambda r: r.doc_id)]
    assert sum(flagged[:60]) >= 36 and sum(flagged[60:]) <= 6


def test_secret_bounds_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(f"s{rng.randint(0, 4)}", rng.choice([0, 1, 2, 3, 5, 9, 14, 30, 400]), [rng.choice([0, 3, 8, 20, 60, 400]) for _ in range(rng.choice([1, 8, 32]))]) for _ in range(200)]
    rows += [("powerless", b, [0, 1, 2, 3]) for b in range(4)] + [("alone", 0, [50] * 32), ("bare", 0, [50])]
    want = {}
    for name in {r[0] for r in rows}:
        own, made = [r[1] for r in rows if r[0] == name], [d for r in rows if r[0] == name for d in r[2]]
        good = [b for b in {*own, *made} if len(own) * (sum(d <= b for d in made) + 1) / (len(made) + 1) <= 0.05 * sum(o <= b for o in own)]
        bad = [b for b in {*own, *made} if 0 < sum(o >= b for o in own) and 10 ** (-b / 10) <= 0.05 * sum(o >= b for o in own) / len(own)]
        if good:
            want[name] = min([max(good), *[b - 1 for b in bad]])
    tokens = spark.createDataFrame(rows, "stratum string, bin int, decoys array<int>")
    assert {r.stratum: r.bound for r in secrets.bounds_from(tokens).collect()} == want and "alone" in want and not {"powerless", "bare"} & set(want)


def test_secrets_with_null_ids_repeated_rows_and_other_columns(spark):
    key = "see tR4kPq9ZxW2mVb7LsYc1HdJf8GnQ0aTe3UiOr5Ew now"
    docs = docs_of(spark, [key, key, key, None, "", "plain words " * 5000], [None, 7, 7, 8, None, 9]).withColumn("spans", F.lit("mine")).withColumn("row", F.lit(1))
    got = sorted(((r.doc_id, [tuple(s) for s in r.spans]) for r in secrets.secret_spans(docs).collect()), key=str)
    at = [("random", 4, 4 + 40)]
    assert got == sorted([(None, at), (7, at), (7, at), (8, []), (None, []), (9, [])], key=str)


def test_redaction_keeps_rows_and_other_columns(spark):
    docs = docs_of(spark, ["a token=abcdef99, b", None, "", "clean"], [1, 1, None, 4])
    got = secrets.redact(docs)
    assert got.columns == docs.columns and sorted(r.text or "" for r in got.collect()) == ["", "", "a [SECRET], b", "clean"]
    assert secrets.redact(docs_of(spark, [])).count() == 0 and secrets.secret_spans(docs_of(spark, [])).count() == 0


def test_every_token_of_a_text_has_all_decoys():
    """A text of many tokens was given fewer decoys for each; results don't depend on what is tested in one pass."""
    rng = random.Random(4)
    text = " ".join("".join(rng.choices("ABCDEFGHabcdefgh0123456789+/", k=rng.choice([20, 40, 76]))) + " some words" for _ in range(300))
    whole = secrets.tested_spans(text)
    assert len(whole) == 300 and all(len(s["decoys"]) == secrets.DECOYS for s in whole)
    for s in whole[:40]:
        token, around = text[s["start"]: s["end"]], (text[max(0, s["start"] - secrets.AROUND): s["start"]], text[s["end"]: s["end"] + secrets.AROUND])
        name, alphabet = secrets.encoding_of(token)
        made = secrets.decoys([w for part in around for w in secrets.WORD.findall(part)], name, len(token))
        assert s["bin"] == secrets.p_bin(secrets.randomness(token)[1])
        assert s["decoys"] == [secrets.p_bin(secrets.battery(d[None, :], alphabet)[0]) for d in made]


def test_tokens_that_a_pattern_matches_in_part_are_tested_and_redacted_whole(spark):
    rng = random.Random(6)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    random_of = lambda k: "".join(rng.choices(alphabet, k=k))
    keys = [random_of(100) + "AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=16)) + random_of(100) for _ in range(40)]
    keys += [random_of(400) + "".join(rng.choices("0123456789abcdef", k=24)) + random_of(400) for _ in range(40)]
    docs = docs_of(spark, [f"the value {k} stands here" for k in keys])
    found = {r.doc_id: {(s["start"], s["end"]) for s in r.spans if s["kind"] == "random"} for r in secrets.secret_spans(docs).collect()}
    assert sum(found[i] == {(10, 10 + len(k))} for i, k in enumerate(keys)) >= 60
    assert all(any(s["kind"] in ("access", "hex") for s in secrets.tested_spans(f"the value {k} stands here")) for k in keys)
    left = [r.text for r in secrets.redact(docs).collect()]
    assert sum(t == "the value [SECRET] stands here" for t in left) >= 60


# -- 2 -----------------------------------------------------------------------------------------------------------------

def test_pieces_equal_the_library(spark):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(5)
    texts = [*AWKWARD, "  lead and  double ", "E=mc².x 1234 http://a.b/?q=1...", "▁x", "<s>", "ಕನ್ನಡ \U0010ffff"] + [
        "".join(rng.choices("ab Eé.,!1\n²日🙂-_", k=rng.randint(1, 80))) for _ in range(200)]
    got = pieces.encode(docs_of(spark, texts)).collect()
    assert [r.ids for r in sorted(got, key=lambda r: r.doc_id)] == [None if t is None else sp.encode(t) for t in texts]
    assert all(r.round_trip for r in got)
    back = {r.doc_id: r.text for r in pieces.decode(spark.createDataFrame(got)).collect()}
    assert [back[i] for i in range(len(texts))] == [t if t is None else t.replace("▁", " ") for t in texts]


def piece_model(pieces_and_scores, kind):
    """A model of given pieces and scores, with byte fallback and the identity normaliser."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback = kind, True
    model.normalizer_spec.name, model.normalizer_spec.add_dummy_prefix = "identity", True
    model.normalizer_spec.remove_extra_whitespaces, model.normalizer_spec.escape_whitespaces = False, True
    listed = [("<unk>", 0, pieces.UNKNOWN), ("<s>", 0, pieces.CONTROL), ("</s>", 0, pieces.CONTROL), *[(f"<0x{b:02X}>", 0, pieces.BYTE) for b in range(256)]]
    for piece, score, type_ in [*listed, *[(p, s, pieces.NORMAL) for p, s in pieces_and_scores]]:
        model.pieces.add(piece=piece, score=score, type=type_)
    return model.SerializeToString()


def all_paths(wfst, text, at=0):
    if at == len(text):
        yield 0.0, ()
        return
    for _, end, piece, w in wfst.lattice(text)[0][at]:
        for weight, rest in all_paths(wfst, text, end):
            yield w + weight, (piece, *rest)


def test_unigram_path_is_the_least_sum_and_equals_the_library():
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor
    rng = random.Random(11)
    known = sorted({"".join(rng.choices("abc▁", k=rng.randint(1, 5))) for _ in range(120)} - {"c"})
    known = [p for p in known if "▁" not in p[1:]]
    model = piece_model([(p, -rng.randint(1, 1 << 15) / 4096) for p in known], pieces.UNIGRAM)
    wfst, sp = pieces.Transducer(model), library(model_proto=model)
    texts = ["", "a", "abc", "  ab  c ", "é🙂x", "c" * 50] + ["".join(rng.choices("abc é", k=rng.randint(1, 60))) for _ in range(300)]
    for text in texts:
        assert wfst.encode(text) == sp.encode(text) and wfst.decode(wfst.encode(text)) == text
    for text in ["".join(rng.choices("abc", k=9)) for _ in range(20)]:
        least = min(w for w, _ in all_paths(wfst, text))
        assert sum(next(w for _, end, p, w in wfst.lattice(piece)[0][0] if p == piece) for piece in wfst._least_sum(wfst.lattice(text)[0])) == least


def test_bpe_acceptor_leaves_one_finite_path():
    with open(pieces.MODEL, "rb") as f:
        wfst = pieces.Transducer(f.read())
    rng = random.Random(12)
    for text in ["international", "▁unbelievably"[:11], "▁▁▁x", *["".join(rng.choices("▁ainstero", k=8)) for _ in range(20)]]:
        finite = [p for _, p in all_paths(wfst, text) if sum(wfst.adjacent[pair] for pair in zip(("", *p), p)) == 0]
        assert finite == [tuple(wfst._merged(text))] and [wfst.id[p] for p in finite[0]] == list(wfst._shortest_path(text))


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        pieces.Transducer(piece_model([("a", -1.0)], 3))


def test_pieces_of_repeated_rows_null_ids_and_long_words(spark):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.MODEL)
    texts = ["same words", "same words", "same words", None, "abcdefghij" * 5000, "日本" * 3000]
    docs = docs_of(spark, texts, [None, 3, 3, None, 4, 5]).withColumn("ids", F.lit(1)).withColumn("round_trip", F.lit("no"))
    got = sorted(((r.doc_id, r.ids, r.round_trip) for r in pieces.encode(docs).collect()), key=str)
    assert got == sorted([(i, None if t is None else sp.encode(t), True) for i, t in zip([None, 3, 3, None, 4, 5], texts)], key=str)
    assert pieces.encode(docs_of(spark, [])).count() == 0 and pieces.decode(pieces.encode(docs_of(spark, []))).count() == 0


# -- 8 -----------------------------------------------------------------------------------------------------------------

def without_repeats(docs, length):
    seen, out = set(), {}
    for key, text in sorted(docs):
        t = (text or "").encode()
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if t[p:p + length] in seen:
                gone[p:p + length] = True
            seen.add(t[p:p + length])
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out[key] = (len(t), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_equal_brute_force(spark):
    rng = random.Random(9)
    parts = ["".join(rng.choices("abcé \x00", k=rng.randint(20, 200))) for _ in range(8)]
    texts = [*[t for t in AWKWARD if t != LONG], "ab" * 300, "z" * 500] + ["".join(p[rng.randint(0, 5):] + rng.choice("xyz") * rng.randint(0, 3) for p in rng.choices(parts, k=rng.randint(0, 6))) for _ in range(40)]
    for length in (100, 60):
        got = {r.doc_id: tuple(r)[1:5] for r in suffixes.remove_repeats(docs_of(spark, texts).repartition(5), length=length).collect()}
        want = without_repeats(list(enumerate(texts)), length)
        assert got == want


def test_repeats_with_equal_and_null_ids(spark):
    t = "".join(random.Random(2).choices("abcdef", k=300))
    big = (1 << 62) + 1
    got = rows(suffixes.remove_repeats(docs_of(spark, [t, t, t, None, t], [4, 4, None, 1, big]).coalesce(1)).select("doc_id", "n_removed").fillna(-1))
    assert got == [(-1, 300), (1, 0), (4, 0), (4, 300), (big, 300)]
    assert suffixes.remove_repeats(docs_of(spark, [])).count() == 0


# -- 9 -----------------------------------------------------------------------------------------------------------------

def test_license_base_and_labels(spark):
    texts = [*AWKWARD, "MIT License. mit LICENSE; mit-license", "Apache license, GNU General Public License version 3", "the general public license", "Licensed under CC BY-NC 4.0",
             "SPDX-License-Identifier: BSD-3-Clause", "license", "Redistribution and use in source and binary forms, with or without modification, are permitted."]
    got = {r.doc_id: r for r in licenses.license_labels(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        hits = [(k, label) for label, p in (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")) for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(hits), ",".join(sorted({h[1] for h in hits})))
        assert (r.first_word, r.last_word) == (min((h[0] for h in hits), default=None), max((h[0] for h in hits), default=None))
        assert 0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
    at = len(AWKWARD)
    assert got[at + 1].labels == "apache,gpl,gpl-3.0" and got[at + 3].labels == "cc-by-nc-4.0" and got[at + 4].labels == "bsd-3-clause" and got[at + 6].labels == "bsd"
    assert licenses.license_labels(docs_of(spark, [])).count() == 0


def test_license_rules_fit_the_context():
    assert len(rules()) > 300 and all(len(r[4].split()) <= licenses.AROUND for r in rules())
    for _, _, _, gate, regex in rules():
        re.compile(regex)
        assert f"@{gate}" in regex


# -- 3, 4, 10 ----------------------------------------------------------------------------------------------------------

def invented(rng, syllables, n):
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n)) + "."


def test_language_id(spark):
    rng = random.Random(4)
    kinds = {"aa": ["the", "ing", "wh", "ou"], "bb": ["sch", "ung", "ü", "keit"], "cc": ["ción", "que", "ñ", "os"]}
    data = [(i, invented(rng, kinds[k], rng.randint(5, 80)), k) for i, k in enumerate(rng.choices(sorted(kinds), k=240))]
    train = spark.createDataFrame(data, "doc_id long, text string, lang string")
    net = langid.train_model(train)
    got = {r.doc_id: r for r in langid.predict(docs_of(spark, [t for _, t, _ in data] + AWKWARD + ["123 !"]), net).collect()}
    assert np.mean([got[i].lang == k for i, _, k in data]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [got[len(data) + i].lang for i in (0, 1, 2)] == ["und"] * 3 and got[len(got) - 1].lang == "und"
    untrained = langid.train_model(train.where("lang is null"))
    assert {r.lang for r in langid.predict(docs_of(spark, AWKWARD), untrained).collect()} == {"und"}


def test_toxicity_learns_from_documents_and_finds_sentences(spark):
    rng = random.Random(6)
    bad, syl = ["grumf", "bleh"], ["the", "ing", "wh", "ou", "er"]
    texts, labels = [], []
    for i in range(300):
        s = [invented(rng, syl, rng.randint(4, 9)) for _ in range(rng.randint(1, 9))]
        toxic = i % 4 == 0
        if toxic:
            s.insert(rng.randint(0, len(s)), f"You {rng.choice(bad)} of it.")
        texts.append("é " + " ".join(s))
        labels.append((i, int(toxic)))
    docs = docs_of(spark, texts)
    known = spark.createDataFrame(labels[:200] + [(0, None)], "doc_id long, toxic int")
    model = toxicity.train_model(docs, known)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert np.mean([(got[i].score >= 0.5) == bool(y) for i, y in labels[200:]]) > 0.95
    one = next(r for r in got.values() if r.score >= 0.5)
    assert any(w in texts[one.doc_id][s["start"]: s["end"]] for s in one.sentences for w in bad)
    awkward = toxicity.score(docs_of(spark, AWKWARD), model).collect()
    assert len(awkward) == len(AWKWARD) and all(0 <= r.score < 0.5 for r in awkward)
    nothing = toxicity.train_model(docs, known.where("false"))
    assert all(0 <= r.score < 0.5 for r in toxicity.score(docs_of(spark, AWKWARD), nothing).collect())


def test_quality(spark):
    rng = random.Random(8)
    syl = ["the", "ing", "wh", "ou", "er"]
    texts = [invented(rng, syl, rng.randint(5, 120)) if i % 3 else "!! ".join(invented(rng, syl, rng.randint(5, 120)).upper().split()) for i in range(240)]
    docs = docs_of(spark, texts)
    net = quality.train_model(docs, spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(160)], "doc_id long, quality int"))
    got = {r.doc_id: r.score for r in quality.score(docs, net).collect()}
    assert np.mean([(got[i] >= 0.7) == (i % 3 > 0) for i in range(160, 240)]) > 0.95
    assert all(0 <= r.score <= 1 for r in quality.score(docs_of(spark, AWKWARD), net).collect())
    flat = quality.train_model(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert all(0 <= r.score <= 1 for r in quality.score(docs_of(spark, AWKWARD), flat).collect())


def test_classifiers_on_repeated_rows_null_ids_and_empty_tables(spark):
    """A text has one score, whatever its id and however often it comes; empty tables train a model that answers, and are answered."""
    rng = random.Random(9)
    texts = [invented(rng, ["the", "ing"] if i % 2 else ["sch", "ung"], 30) for i in range(40)]
    docs, labels = docs_of(spark, texts), [(i, i % 2) for i in range(40)]
    again = docs_of(spark, [texts[0], texts[0], texts[0], None, "", None], [None, 5, 5, None, None, 6])
    none = docs_of(spark, [])
    few, empty = spark.createDataFrame([*labels, labels[0], (None, 1), (7, None)], "doc_id long, mark int"), spark.createDataFrame([], "doc_id long, mark int")
    langs = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").otherwise("bb"))
    langs = langs.unionByName(langs.where("doc_id = 3")).unionByName(langs.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    models = [(langid.predict, langid.train_model(langs), langid.train_model(langs.where("false")))]
    models.append((toxicity.score, toxicity.train_model(docs, few.toDF("doc_id", "toxic")), toxicity.train_model(none, empty.toDF("doc_id", "toxic"))))
    models.append((quality.score, quality.train_model(docs, few.toDF("doc_id", "quality")), quality.train_model(none, empty.toDF("doc_id", "quality"))))
    for apply, learned, blank in models:
        for model in (learned, blank):
            got = apply(again, model).collect()
            assert sorted([r.doc_id for r in got], key=str) == sorted([None, 5, 5, None, None, 6], key=str)
            assert all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id == 5}) == 1
            alone = apply(docs_of(spark, [texts[0], None]), model).collect()
            of = {r.doc_id: r.score for r in alone}
            assert [r.score for r in got if r.doc_id == 5] == [of[0]] * 2 and [r.score for r in got if r.doc_id == 6] == [of[1]]
            assert apply(none, model).collect() == []


# -- 1 -----------------------------------------------------------------------------------------------------------------

def test_nearest_neighbours_recall_and_bad_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16))
    x[200:260] = x[100]  # equal vectors: ties go to the smaller id
    data = [(i, [float(c) for c in v], "n") for i, v in enumerate(x)]
    data += [(2000, None, "n"), (2100, [0.0] * 16, "n"), (2200, [float("nan")] * 16, "n"), (2300, [1.0], "n"), (2400, [None] + [1.0] * 15, "n"), (None, [1.0] * 16, "n")]
    got: dict[int, list] = {}
    for r in ann.nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>, node string"), F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    assert sorted(got) == list(range(0, 1500, 100))
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(len(x)), d))[:10].tolist()
        found = sorted(found)
        assert [f[0] for f in found] == list(range(1, 11)) and np.allclose([f[2] for f in found], d[[f[1] for f in found]])
        hits += len(set(want) & {f[1] for f in found})
    assert hits / (10 * len(got)) >= 0.9
    assert [f[1] for f in sorted(got[200])] == [100, 201, 202, 203, 204, 205, 206, 207, 208, 209]


def test_nearest_neighbours_of_few(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [1.0, 0.5])], "vec_id long, embedding array<double>")
    assert rows(ann.nearest(few, F.lit(True)).select("query_id", "rank", "vec_id")) == [(0, 1, 2), (0, 2, 1), (1, 1, 2), (1, 2, 0), (2, 1, 0), (2, 2, 1)]
    assert ann.nearest(few.where("false"), F.lit(True)).count() == 0


def test_nearest_neighbours_with_an_outlier_an_offset_and_two_widths(spark):
    rng = np.random.default_rng(9)
    a, b = 1000 + rng.normal(size=(2500, 12)) * 0.01, rng.normal(size=(900, 5))
    a[7] = 1e30
    vectors = [*a.tolist(), *b.tolist()]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    nodes, _ = ann.nodes_of(ann.usable(df, "vec_id", "embedding"), 11)
    of = {r.node: r.vec_id for r in ann.usable(df, "vec_id", "embedding").select("node", "vec_id").collect()}
    linked = {}
    for r in ann.build_graph(nodes).collect():
        linked.setdefault(of[r.node], set()).add(of[r.id])
    for own, first in ((a, 0), (b, len(a))):
        some = rng.choice(len(own), 150, replace=False)
        d = np.sqrt(((own[some][:, None, :] - own[None, :, :]) ** 2).sum(axis=2))
        d[np.arange(150), some] = np.inf
        want = np.argsort(d, axis=1)[:, :10] + first
        hits = sum(len(set(w.tolist()) & linked[int(i) + first]) for i, w in zip(some, want) if i != 7)
        assert hits / (10 * 150) >= 0.9  # the links themselves, before any search
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert sorted(got) == list(range(0, 3400, 100)) and all(len(g) == 10 for g in got.values())
    assert all((q < 2500) == (i < 2500) for q, g in got.items() for _, i in g)


def test_an_id_with_two_vectors_is_listed_once(spark):
    data = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [9.0, 0.0]), (2, [3.0, 0.0]), (2, [3.0, 0.0]), (0, [9.5, 0.0]), (3, [-0.0, 1.0]), (4, [0.0, 1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    assert rows(ann.nearest(df, F.col("vec_id") == 0).select("rank", "vec_id", F.round("score", 3))) == [(1, 1, 0.5), (2, 3, 1.414), (3, 4, 1.414), (4, 2, 2.0)]
    assert rows(ann.nearest(df, F.col("vec_id") == 4).select("rank", "vec_id", F.round("score", 3)))[0] == (1, 3, 0.0)


def test_a_detection_yields_to_every_stronger_one_that_it_overlaps(spark):
    rng = random.Random(31)
    found = [(1, "A", 1, 0, 10), (1, "B", 9, 2, 11), (1, "C", 5, 4, 12), (2, "A", 5, 0, 4), (2, "B", 1, 4, 8), (2, "C", 5, 7, 9), (None, "A", 5, 0, 4)]
    for row in range(10, 60):
        for k in range(rng.randint(1, 9)):
            start = rng.randint(0, 30)
            found.append((row, f"L{k}", rng.randint(1, 4), start, start + rng.randint(1, 12)))
    df = spark.createDataFrame(found + found[3:4], "row long, label string, priority int, start int, end int")
    got = sorted({tuple(r) for r in licenses.unsuppressed(df).collect()}, key=str)
    inside = lambda x, y: (y[3] <= x[3] and x[4] <= y[4]) and (y[3], -y[4], y[2], y[1]) < (x[3], -x[4], x[2], x[1])
    want = []
    for row in {f[0] for f in found}:
        own = [f for f in found if f[0] == row]
        outer = [x for x in own if not any(inside(x, y) for y in own)]
        want += [x for x in outer if not any(y[2] < x[2] and y[3] < x[4] and x[3] < y[4] for y in outer)]
    assert got == sorted(want, key=str)
    assert [g[1] for g in got if g[0] == 1] == ["A"] and [g[1] for g in got if g[0] == 2] == ["A", "B"]
