"""Secret scan: fixed patterns plus a randomness test battery under false-discovery control (operator 8).

Base spans come from three patterns. The battery looks at every other run of key characters: it infers the run's encoding, then
tests its symbols by chi-squared uniformity (over groups of neighbouring and of alike common symbols), a runs test, lag-1 serial
correlation and a serial test of pairs (neighbours that come again). The battery's score of a run is
compared with the scores of ordinary, structured strings of the same encoding and length (words, made-up words, identifiers, counters, dates),
which gives the p-value of "ordinary"; over the highest scores a fitted tail gives it, so that it can be as small as documents with
many runs ask. Within a document a weighted Benjamini-Hochberg step, with weights that grow with the
run's length in bits, decides which runs are reported as kind `random`.

Defined results: null text is empty and has no spans; texts of any length are scanned whole; repeated rows give the same result
each; an empty table gives no rows; spans that start together come in the order of their kinds; further columns, whatever their names, are ignored (and
kept by redact_secrets); positions are code points with exclusive ends; a run that overlaps a base span adds nothing. A run with symbols of both base64
and base64url (+ or / and - or _) is tested in its parts by the one and by the other; found parts can overlap.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import overlap_test, portions, table

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
FDR = 0.01
#: Ordinary strings of each encoding and length, and how many of the highest scores the tail is fitted to.
NULL_SIZE, TAIL_SIZE = 10_000, 100
MIN_BITS = 80
#: Symbols that hold MIN_BITS in the largest alphabets. Every access key, hexadecimal run and battery candidate lies in such a run.
SHORTEST = math.ceil(MIN_BITS / 6)
RUN = re.compile(rf"[A-Za-z0-9+/_-]{{{SHORTEST},}}={{0,2}}")
#: Parts of a run that has symbols of both base64 and base64url.
PART = (re.compile(rf"[A-Za-z0-9+/]{{{SHORTEST},}}={{0,2}}"), re.compile(rf"[A-Za-z0-9_-]{{{SHORTEST},}}={{0,2}}"))

ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
_SETS = [(name, frozenset(chars), {c: i for i, c in enumerate(chars)}) for name, chars in ALPHABETS]
#: Letters as common in words of Western languages; uniformity is tested over groups of symbols that are alike common.
COMMON = "eaionrtslducmhpgbfvyqkwxjz"


def _ranked(chars: str) -> dict[str, int]:
    return {c: i for i, c in enumerate(sorted(chars, key=lambda c: (COMMON.find(c.lower()) if c.isalpha() else 26 + c.isdigit(), c)))}


_VALUES = {name: value for name, _, value in _SETS}
#: Places of an encoding's symbols, the most common letters first.
_RANKS = {name: _ranked(chars) for name, chars in ALPHABETS}
LENGTHS = (14, 16, 20, 24, 32, 40, 48, 64, 96, 128)


def infer_encoding(run: str) -> tuple[str, dict[str, int]] | None:
    """The smallest alphabet that holds all symbols; None for plain letters, plain digits and too few symbols."""
    body = run.rstrip("=")
    seen = set(body)
    if not any(c.isdigit() for c in seen) or not any(c.isalpha() for c in seen):
        return None
    for name, chars, value in _SETS:
        if seen <= chars:
            return name, value
    return None


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_tail(x: float, k: int) -> float:
    """Upper tail of chi-squared with k degrees of freedom (Wilson and Hilferty)."""
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def _uniform_p(places: list[int], size: int) -> float:
    """p-value of chi-squared uniformity over groups of neighbouring places."""
    n = len(places)
    groups = min(size, max(4, n // 5))
    counts, expected = [0] * groups, [0] * groups
    for x in places:
        counts[x * groups // size] += 1
    for x in range(size):
        expected[x * groups // size] += 1
    return _chi_tail(sum((c - n * e / size) ** 2 / (n * e / size) for c, e in zip(counts, expected, strict=True)), groups - 1)


def _pairs_p(body: str, size: int) -> float:
    """p-value of as many equal pairs among all pairs of neighbours (Poisson): words and counters come again, random symbols seldom do."""
    n = len(body) - 1
    equal = sum(c * (c - 1) // 2 for c in Counter(zip(body, body[1:], strict=False)).values())
    rate = n * (n - 1) / 2 / size**2
    term, below = math.exp(-rate), 0.0
    for k in range(equal):
        below += term
        term *= rate / (k + 1)
    return 1 - below if 1 - below > 1e-12 else max(1e-300, term)


def battery(run: str, name: str) -> tuple[float, float, float, float, float]:
    """p-values of uniformity over an encoding: chi-squared over groups of neighbouring and of alike common symbols, runs about the
    alphabet's middle, lag-1 serial correlation, equal pairs of neighbours."""
    value, rank = _VALUES[name], _RANKS[name]
    body = run.rstrip("=")
    v = [value[c] for c in body]
    n, size = len(v), len(value)
    p_value, p_rank = _uniform_p(v, size), _uniform_p([rank[c] for c in body], size)
    high = [x * 2 >= size for x in v]
    ones = sum(high)
    zeros = n - ones
    if ones and zeros:
        mean = 1 + 2 * ones * zeros / n
        spread = math.sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1)))
        p_runs = _normal_tail((1 + sum(a != b for a, b in zip(high, high[1:], strict=False)) - mean) / spread)
    else:
        p_runs = 2.0 ** (1 - n)
    m = sum(v) / n
    var = sum((x - m) ** 2 for x in v)
    r = sum((a - m) * (b - m) for a, b in zip(v, v[1:], strict=False)) / var if var else 1.0
    p_serial = _normal_tail((r + 1 / n) * math.sqrt(n))
    return p_value, p_rank, p_runs, p_serial, _pairs_p(body, size)


def _changes(run: str) -> float:
    """Share of neighbours that differ in class (lower, upper, digit, other): random runs mix classes."""
    kinds = ["l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "o" for c in run]
    return sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, len(kinds) - 1)


def randomness(run: str, name: str) -> float:
    """Larger is more random: the Bonferroni p-value of the battery, scaled by how often neighbours change class. The factor stands beside the
    battery: words, counters and dates keep to one class, which tests on a few symbols don't always see. As the same score is
    taken of ordinary strings, it changes which runs rank high, not how often an ordinary one is reported."""
    found = battery(run, name)
    return min(1.0, len(found) * min(found)) * _changes(run.rstrip("="))


_SYLLABLES = "the and ing er ion con pro ent ter com re in st ate al ver per ist der us est out man ness able ment form data user name path file get set list item node page view base main test code type text line id key app src lib bin tmp log img css org net www v".split()


_ONSETS = "b c d f g h j k l m n p qu r s t v w x y z br cl dr fl gr kr pl ph sh st th tr wh".split()
_VOWELS = "a e i o u y ai ea ee io oo ou".split()
_CODAS = ["", "", "", "", *"n r s t l ck ng x rt st m zz".split()]


def _made_up(chooser: random.Random) -> str:
    """A word of one to three syllables that can be said; rare letters are as common in it as others."""
    return "".join(chooser.choice(_ONSETS) + chooser.choice(_VOWELS) + chooser.choice(_CODAS) for _ in range(chooser.randrange(1, 4)))


def _ordinary(chooser: random.Random, length: int, chars: frozenset, name: str) -> str:
    """A structured string that no generator of secrets wrote: words, identifiers, counters, dates and repeats."""
    upper, kind, out = name in ("HEX", "BASE36", "base32"), chooser.randrange(8), ""
    common, title = chooser.random() < 0.5, chooser.random() < 0.3
    capital = kind == 1 and chooser.random() < 0.5
    while len(out) < length:
        word = chooser.choice(_SYLLABLES) if common else _made_up(chooser)
        if capital:
            out += word.title()
            if len(out) >= length:
                tail = str(chooser.randrange(10 ** chooser.randrange(1, 4)))
                out = out[: length - len(tail)] + tail
        elif kind == 0:
            out += word + chooser.choice(_SYLLABLES) + (str(chooser.randrange(100)) if chooser.random() < 0.3 else "")
        elif kind == 1:
            out += (word + chooser.choice(_SYLLABLES)).title() + (str(chooser.randrange(10)) if chooser.random() < 0.4 else chooser.choice(["", "_", "-"]))
        elif kind == 2:
            out += f"{chooser.randrange(1990, 2030)}{chooser.randrange(1, 13):02d}{chooser.randrange(1, 29):02d}" + word
        elif kind == 3:
            out += f"{chooser.randrange(1000):08d}" + word * chooser.randrange(2)
        elif kind == 4:
            out += (word * 2 + str(chooser.randrange(1000)))[: chooser.randrange(3, 9)] * 2
        elif kind == 5:
            word += _made_up(chooser)
            out += (word.title() if title else word) + str(chooser.randrange(10 ** chooser.randrange(1, 3)))
        elif kind == 6:
            out += word + _made_up(chooser) + str(chooser.randrange(10 ** chooser.randrange(2, 7)))
        else:
            out += word.upper()[: chooser.randrange(1, 4)] + str(chooser.randrange(10 ** chooser.randrange(4, 21)))
    out = out.upper() if upper else out.lower() if name in ("hex", "base36") else out
    out = "".join(c for c in out if c in chars)
    return (out * (length // max(1, len(out)) + 1))[:length] if out else min(chars) * length


@lru_cache(maxsize=None)
def _null_scores(name: str, length: int, size: int = NULL_SIZE) -> tuple[float, ...]:
    """Sorted battery scores of ordinary strings: the reference distribution of one encoding and length, from a fixed seed."""
    chars = next(x[1] for x in _SETS if x[0] == name)
    chooser = random.Random(f"{name}:{length}")
    return tuple(sorted(randomness(_ordinary(chooser, length, chars, name), name) for _ in range(size)))


@lru_cache(maxsize=None)
def _null_tail(name: str, length: int) -> tuple[bool, float, float, float]:
    """Whether the null's tail is fitted to logarithms of scores; its threshold, scale and shape.

    A generalized Pareto tail by probability-weighted moments. A shape under 0, which would end the scores at some value, counts as 0:
    p-values get larger by it and never 0. Tails far too heavy for moments (some long runs) get a power law (Hill)."""
    top = _null_scores(name, length)[-TAIL_SIZE - 1 :]
    over = [x - top[0] for x in top[1:]]
    mean = sum(over) / TAIL_SIZE
    weighted = sum(x * (TAIL_SIZE - 1 - i) for i, x in enumerate(over)) / (TAIL_SIZE * (TAIL_SIZE - 1))
    shape = max(0.0, 2 - mean / (mean - 2 * weighted)) if mean > 2 * weighted else 0.0
    if shape <= 0.85:
        return False, top[0], max(mean * (1 - shape), 1e-9), shape
    logs = [math.log(max(x, 1e-300)) for x in top]
    return True, logs[0], sum(x - logs[0] for x in logs) / TAIL_SIZE, 0.0


def _tail_p(name: str, length: int, score: float) -> float:
    """p-value of a score over the threshold of the tail."""
    logs, start, scale, shape = _null_tail(name, length)
    x = ((math.log(score) if logs else score) - start) / scale
    return TAIL_SIZE / (1 + NULL_SIZE) * ((1 + shape * x) ** (-1 / shape) if shape > 1e-6 else math.exp(-x))


def ordinary_p(run: str) -> tuple[float, float] | None:
    """(p-value that an ordinary string of this encoding and length scores as random, bits of the run); None: not a candidate."""
    found = infer_encoding(run)
    if not found:
        return None
    name, value = found
    body = run.rstrip("=")
    bits = len(body) * math.log2(len(value))
    if bits < MIN_BITS:
        return None
    length = max(x for x in LENGTHS if x <= max(LENGTHS[0], len(body)))
    null, score = _null_scores(name, length), randomness(run, name)
    if score > null[-TAIL_SIZE - 1]:
        return _tail_p(name, length, score), bits
    low, high = 0, len(null)
    while low < high:
        mid = (low + high) // 2
        low, high = (mid + 1, high) if null[mid] < score else (low, mid)
    return (1 + len(null) - low) / (1 + len(null)), bits


def discoveries(tests: list[tuple[float, float]], level: float = FDR) -> list[bool]:
    """Weighted Benjamini-Hochberg over (p, bits): weights in proportion to bits, 1 on average."""
    if not tests:
        return []
    mean = sum(b for _, b in tests) / len(tests)
    q = [p * mean / b for p, b in tests]
    order = sorted(range(len(q)), key=q.__getitem__)
    last = max((i + 1 for i, k in enumerate(order) if q[k] <= level * (i + 1) / len(q)), default=0)
    kept = set(order[:last])
    return [i in kept for i in range(len(q))]


def candidates(at: int, run: str) -> list[tuple[int, str]]:
    """(start, run) of what the battery looks at: the run, or if no single alphabet can hold it its parts by base64 and by base64url."""
    if not (set(run) & set("+/") and set(run) & set("-_")):
        return [(at, run)]
    return sorted({(at + m.start(), m[0]) for part in PART for m in part.finditer(run)})


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a whole text as (kind, start, end), by start, then kind."""
    text = text or ""
    spans: list[tuple[str, int, int]] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    runs = [(m.start(), m[0]) for m in RUN.finditer(text)]
    for at, run in runs:
        spans += [("access", at + m.start(), at + m.end()) for m in ACCESS.finditer(run)]
        spans += [("hex", at + m.start(), at + m.end()) for m in HEX.finditer(run)]
    taken = overlap_test((s, e) for _, s, e in spans)
    free = [(at, x) for start, run in runs for at, x in candidates(start, run) if not taken(at, at + len(x))]
    tested = [(at, run, t) for at, run in free if (t := ordinary_p(run))]
    kept = [(at, at + len(run)) for (at, run, _), found in zip(tested, discoveries([t for _, _, t in tested]), strict=True) if found]
    end = -1
    for start, stop in sorted(kept, key=lambda x: (x[0], -x[1])):  # a part inside another adds nothing
        if stop > end:
            spans.append(("random", start, stop))
            end = stop
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (array of kind, start, end) of every whole text."""

    def scanned(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in portions(batches, 1):
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scanned, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redacted(text: str | None, spans: list[tuple[str, int, int]], mark: str = "<secret>") -> str | None:
    """The text with each span, overlapping ones as one, replaced by mark."""
    if not spans:
        return text
    out, at = [], 0
    for _, s, e in sorted(spans, key=lambda x: (x[1], x[2])):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, mark: str = "<secret>", text_col: str = "text") -> DataFrame:
    """The same rows and columns; secrets in the text replaced by mark."""
    place = docs.columns.index(text_col)

    def cleaned(batches):
        for b in portions(batches, place):
            texts = [redacted(t, scan(t), mark) for t in b.column(place).to_pylist()]
            yield b.set_column(place, text_col, pa.array(texts, pa.string()))

    rows = docs.withColumn(text_col, F.col(text_col).cast("string"))
    return rows.mapInArrow(cleaned, rows.schema)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all documents and the digests that the contract names."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"] != "random")
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), of("random"))
