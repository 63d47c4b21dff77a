"""Secret scan: fixed patterns, and a battery of randomness tests with length-aware false-discovery control.

Every unbroken token of 20 characters or more, also one that a pattern matches in part or whole, is tested against "drawn at random from the alphabet of its encoding": chi-squared
uniformity of the characters and of their classes (digits, vowels, consonants, case, signs), Wald-Wolfowitz runs about the middle of
the alphabet, and lag-one serial correlation, joined by Fisher's rule into one p-value. Two rules decide, both in strata of encoding and length (quarters of powers of two), over all
tokens of the corpus:

* what is reported is controlled. The null is "structured": beside each token, decoys of its length and encoding are made of the
  words around it and put through the same battery. A bound on p is taken only if the structured tokens expected beyond it, by the
  share of decoys there, are at most ``alpha`` of the tokens reported by it. Short tokens on which the tests have no power share
  their p-values with the decoys, and so are not reported;
* a token that Benjamini-Hochberg rejects as random at the same level is not reported either, whatever the decoys say.

Both run on counts by p-value bin, so nothing but a bounded histogram leaves the tasks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from souklens.llm.common import batch_of, slices
from souklens.session import checkpointed

# Kinds in their order, patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ["assign", "access", "hex", "random"]

TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")  # every long enough run of HEX lies inside such a run
KEYWORDS = ("passw", "secret", "token", "api")
ALPHA = 0.05
DECOYS = 32  # for each token
CELLS = 1 << 17  # characters that the battery works on at a time
AROUND = 400  # characters on each side of a token whose words make its decoys
BINS = 400  # p-value bins, ten for each power of ten; what lies below 1e-40 shares the last

ALPHABETS = [  # smallest first
    ("decimal", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("lower26", "abcdefghijklmnopqrstuvwxyz"),
    ("upper26", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("lower36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("upper36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("alpha52", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("alnum62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("any66", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_+/"),
]
_SETS = [(name, frozenset(a), a) for name, a in ALPHABETS]
_CLASSES = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "+/-_"]
_CLASS = {a: np.array([next(i for i, chars in enumerate(_CLASSES) if c in chars) for c in a]) for _, a in ALPHABETS}
_PLACE = {name: np.array([max(0, a.find(chr(b))) for b in range(128)], np.uint8) for name, a in ALPHABETS}  # places of ASCII characters

WORD = re.compile(r"[A-Za-z]{2,}")
# Ordinary words that fill up where few stand around a token.
FILLERS = """the user account system data file name value index table record update request response server client session
number address message content image folder archive january december document version release service manager control
network address window button default option error warning process thread memory storage public private language country
region customer order product price supplier market history report summary local share home library source target build
test example config setting parameter function method class object string integer boolean array field column group member""".split()


def encoding_of(token: str) -> tuple[str, str]:
    """Name and alphabet of the smallest encoding that holds the token; base64 padding is not part of it."""
    own = set(token.rstrip("="))
    return next((name, a) for name, s, a in _SETS if own <= s)


_erfc = np.vectorize(math.erfc, otypes=[float])


def _class_uniformity(x: np.ndarray, alphabet: str) -> np.ndarray:
    """p of chi-squared over the classes of characters that the alphabet has, by Wilson and Hilferty's cube root; 1 for one class."""
    k, n = x.shape
    cells = _CLASS[alphabet]
    share = np.bincount(cells, minlength=len(_CLASSES)) / len(alphabet)
    free = int((share > 0).sum()) - 1
    if free == 0:
        return np.ones(k)
    counts = np.bincount((cells[x] + len(_CLASSES) * np.arange(k)[:, None]).ravel(), minlength=k * len(_CLASSES)).reshape(k, -1)[:, share > 0]
    chi = ((counts - n * share[share > 0]) ** 2 / (n * share[share > 0])).sum(axis=1)
    return 0.5 * _erfc((np.cbrt(chi / free) - 1 + 2 / (9 * free)) / math.sqrt(2 / (9 * free)) / math.sqrt(2))


def battery(x: np.ndarray, alphabet: str) -> np.ndarray:
    """p of each row of ``x``, a token as places in its alphabet: Fisher's combination of the four tests; 1 for tokens under two
    characters."""
    k, n = x.shape
    a = len(alphabet)
    if n < 2:
        return np.ones(k)
    # Chi-squared, standardised by its exact multinomial mean and variance since cells are sparse; one-sided.
    counts = np.bincount((x + a * np.arange(k)[:, None]).ravel(), minlength=k * a).reshape(k, a)
    chi = (counts ** 2).sum(axis=1) * a / n - n
    uniform = 0.5 * _erfc((chi - (a - 1)) / math.sqrt(2 * (a - 1) * (n - 1) / n) / math.sqrt(2))
    high = x >= a / 2
    n1 = high.sum(axis=1)
    n0 = n - n1
    runs = 1 + (high[:, 1:] != high[:, :-1]).sum(axis=1)
    mean = 1 + 2 * n0 * n1 / n
    var = (mean - 1) * (mean - 2) / max(1, n - 1)
    turns = np.where(var > 0, _erfc(np.abs(runs - mean) / np.sqrt(np.where(var > 0, var, 1)) / math.sqrt(2)), 1.0)
    turns = np.where((n0 == 0) | (n1 == 0), 2.0 ** (1 - n), turns)  # one side of the alphabet only
    d = x - x.mean(axis=1, keepdims=True)
    power = (d * d).sum(axis=1)
    lag = (d[:, 1:] * d[:, :-1]).sum(axis=1) / np.where(power > 0, power, 1) + 1 / n
    serial = np.where(power > 0, _erfc(np.abs(lag) * math.sqrt(n / 2)), 0.0)
    half = -sum(np.log(np.maximum(q, 1e-300)) for q in (uniform, _class_uniformity(x, alphabet), turns, serial))
    return np.minimum(1.0, np.exp(-half) * (1 + half + half ** 2 / 2 + half ** 3 / 6))


def _places(string: str, name: str) -> np.ndarray:
    return _PLACE[name][np.frombuffer(string.encode("ascii"), np.uint8)]


def randomness(token: str) -> tuple[str, float]:
    """(encoding, p) of one token."""
    name, alphabet = encoding_of(token)
    return name, float(battery(_places(token.rstrip("="), name)[None, :], alphabet)[0])


def _styled(word: str, at: int, name: str) -> str:
    """A word as structured tokens of an encoding have it: joined words, with a number after each, as a path, or as byte codes."""
    low = word.lower()
    if name == "decimal":
        return "".join(f"{b:03d}" for b in low.encode())
    if name in ("hex", "HEX"):
        return low.encode().hex() if name == "hex" else low.encode().hex().upper()
    if name in ("lower26", "lower36"):
        return low + (str(at % 10) if name == "lower36" else "")
    if name in ("upper26", "upper36"):
        return low.upper() + (str(at % 10) if name == "upper36" else "")
    cased = low.capitalize() + ("" if name == "alpha52" else str(at % 10))
    return cased + {"base64": "/", "base64url": "-_"[at % 2], "any66": "/-"[at % 2]}.get(name, "")


def decoys(words: list[str], name: str, length: int, number: int = DECOYS) -> np.ndarray:
    """``number`` structured strings of an encoding and length as rows of places, each from another word on; words that are too few are
    filled up."""
    words = [*words, *FILLERS]
    parts = [_styled(w, i, name) for i, w in enumerate(words)]
    starts = np.cumsum([0, *map(len, parts)])[:-1][np.linspace(0, len(words) - 1, number).astype(int)]
    ring = _places("".join(parts), name)
    return ring[(starts[:, None] + np.arange(length)) % len(ring)]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, leftmost and non-overlapping within a kind, without matches that are too short."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    return found + [("hex", *m.span()) for t in TOKEN.finditer(text) for m in HEX.finditer(text, *t.span()) if len(m[0]) >= LEAST["hex"]]


def p_bin(p: float) -> int:
    """Bin of a p-value; bin b holds p up to 10 ** (-b / 10)."""
    return min(BINS, int(-10 * math.log10(p))) if p > 0 else BINS


_OUT = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([
    ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("stratum", pa.string()), ("bin", pa.int32()), ("decoys", pa.list_(pa.int32()))])))])


def _bins(rows: list[np.ndarray], alphabet: str) -> list[int]:
    """p-value bins of all rows of the arrays, whose tokens are of one length."""
    x = np.vstack(rows)
    most = max(1, CELLS // x.shape[1])
    return [p_bin(p) for a in range(0, len(x), most) for p in battery(x[a: a + most], alphabet)]


def tested_spans(text: str | None, number: int = DECOYS) -> list[dict]:
    """The base spans, and every token, also one that they overlap, with its stratum and the p-value bins of itself and of ``number`` decoys."""
    text = text or ""
    spans = [{"kind": k, "start": s, "end": e, "stratum": None, "bin": None, "decoys": None} for k, s, e in base_spans(text)]
    alike: dict[tuple[str, str, int], list[tuple[int, int, str]]] = {}
    for m in TOKEN.finditer(text):
        token = m[0].rstrip("=")
        alike.setdefault((*encoding_of(token), len(token)), []).append((*m.span(), token))
    for (name, alphabet, length), tokens in alike.items():
        each = max(1, CELLS // (length * (1 + number)))  # tokens tested in one pass
        for some in (tokens[a: a + each] for a in range(0, len(tokens), each)):
            rows = []
            for start, end, token in some:
                rows.append(_places(token, name)[None, :])
                if number:
                    words = WORD.findall(text[max(0, start - AROUND): start]) + WORD.findall(text[end: end + AROUND])
                    rows.append(decoys(words, name, length, number))
            bins = _bins(rows, alphabet)
            for at, (start, end, _) in zip(range(0, len(bins), 1 + number), some):
                spans.append({"kind": "random", "start": start, "end": end, "stratum": f"{name}:{int(4 * math.log2(length))}", "bin": bins[at], "decoys": bins[at + 1: at + 1 + number]})
    return spans


def _candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch_of(_OUT, row=batch["row"], doc_id=batch["doc_id"], spans=[tested_spans(t) for t in batch["text"].to_pylist()])

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        work, "row long, doc_id long, spans array<struct<kind:string,start:long,end:long,stratum:string,bin:int,decoys:array<int>>>")


def bounds_from(tokens: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(stratum, bound): tokens in bin ``bound`` or below are reported; a stratum without a row reports nothing.

    tokens has (stratum, bin, decoys). A bound has to meet both rules of the module. For the decoys it is the largest bin at which
    all tokens of the stratum, times the share of decoys at or below it (one more than counted), make at most alpha of the tokens
    there. For Benjamini-Hochberg it lies below the smallest rejected bin, a bin being judged by its largest p-value."""
    own = tokens.groupBy("stratum", "bin").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("d"))
    made = tokens.select("stratum", F.explode("decoys").alias("bin")).groupBy("stratum", "bin").agg(F.lit(0).cast("long").alias("n"), F.count("*").alias("d"))
    counted = own.unionByName(made).groupBy("stratum", "bin").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    at, upto = F.col("o.bin") <= F.col("c.bin"), F.col("o.bin") >= F.col("c.bin")
    summed = counted.alias("c").join(counted.alias("o"), F.col("c.stratum") == F.col("o.stratum")).groupBy("c.stratum", "c.bin").agg(
        F.sum(F.when(at, F.col("o.n")).otherwise(0)).alias("reported"), F.sum(F.when(at, F.col("o.d")).otherwise(0)).alias("false"),
        F.sum(F.when(upto, F.col("o.n")).otherwise(0)).alias("rank"), F.sum("o.n").alias("m"), F.sum("o.d").alias("all"))
    controlled = F.col("m") * (F.col("false") + 1) / (F.col("all") + 1) <= alpha * F.col("reported")
    rejected = (F.col("rank") > 0) & (F.pow(F.lit(10.0), -F.col("bin") / 10) <= alpha * F.col("rank") / F.col("m"))
    return summed.groupBy("stratum").agg(F.least(
        F.max(F.when(controlled, F.col("bin"))), F.coalesce(F.min(F.when(rejected, F.col("bin"))) - 1, F.lit(BINS))).alias("bound"),
        F.count_if(controlled).alias("some")).where("some > 0").select("stratum", "bound")


def _tokens(found: DataFrame) -> DataFrame:
    return found.select(F.explode("spans").alias("s")).where("s.kind = 'random'").select("s.stratum", "s.bin", "s.decoys")


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA) -> DataFrame:
    """(doc_id, spans): one row per input row; spans has (kind, start, end), by start and then in the order of KINDS.

    Positions are code points, the end is exclusive. NULL and empty texts have no spans; repeated rows are answered one by
    one and count one by one in the control of false discoveries. Columns other than the two named are not read.
    """
    found = checkpointed(_candidates(docs, id_col, text_col))
    bounds = bounds_from(_tokens(found), alpha).agg(F.map_from_entries(F.collect_list(F.struct("stratum", "bound"))).alias("bounds"))
    order = F.array(*[F.lit(k) for k in KINDS])
    kept = F.filter("spans", lambda s: (s["kind"] != "random") | (s["bin"] <= F.coalesce(F.try_element_at("bounds", s["stratum"]), F.lit(-1))))
    by_place = F.array_sort(F.transform(kept, lambda s: F.struct(
        s["start"].alias("start"), F.array_position(order, s["kind"]).alias("k"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return found.join(F.broadcast(bounds)).select(  # one row: the strata are bounded by encodings and bit lengths
        "doc_id", F.transform(by_place, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def redacted(text: str | None, bounds: dict[str, int], mark: str) -> str | None:
    """``text`` with a mark for what the bounds report; decoys have made the bounds and are not needed again."""
    spans = sorted((s["start"], s["end"]) for s in tested_spans(text, 0) if s["kind"] != "random" or s["bin"] <= bounds.get(s["stratum"], -1))
    if not spans:
        return text
    out, at = [], 0
    for start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", alpha: float = ALPHA) -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; all its columns and rows, in place.

    Two narrow passes: the first gives the bounds of the strata, which are limited by encodings and bit lengths, the second rewrites texts.
    Overlapping spans become one mark; texts without spans, NULL among them, stay as they are.
    """
    bounds = {r["stratum"]: r["bound"] for r in bounds_from(_tokens(_candidates(docs.select(F.lit(0).alias("id"), text_col), "id", text_col)), alpha).collect()}
    place, name = docs.columns.index(text_col), text_col

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, name):
            yield batch.set_column(place, batch.schema.field(place), pa.array([redacted(t, bounds, mark) for t in batch[name].to_pylist()], type=batch.schema.field(place).type))

    return docs.mapInArrow(work, docs.schema)
