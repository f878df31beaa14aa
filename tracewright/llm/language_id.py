"""Language identification by character language models with interpolated Kneser-Ney smoothing (operator 6).

One model per language over the characters of words: every word is a sequence that starts at a boundary mark and ends with one,
so that a word's score does not depend on its neighbours and is computed once per worker. Each order's n-grams of all languages
lie in one sorted array of 64-bit hashes with a column of discounted shares per language; contexts lie in another one with their
back-off weights. A text gets the language of the lowest cross-entropy per character. Rejection and the score are calibrated on
labelled rows that the models have not seen.

Training reads labelled rows outside the test fold, at most `rows_per_language` of each language (default 400, chosen by a hash of
the id) with texts of up to SAMPLE_TEXT_BYTES; all texts are then scored whole.

Defined results: null text or text without a letter is `und`, score 0, rejected; equal cross-entropies go to the smaller language
code; a language needs 2 labelled rows to be learnt; without any learnt language all rows are `und`; texts of any length are scored whole,
in portions; repeated rows get equal results; an empty table gives no rows; further columns are kept, but for those named like the operator's
own, which are replaced.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import held, held_out, portions, table

ROWS_PER_LANGUAGE = 400
ORDER = 5
#: Longer labelled texts stay out of the sample (not out of the predictions), so that the driver holds at most languages times rows times this.
SAMPLE_TEXT_BYTES = 1 << 16
#: Bytes of the remembered scores of words, a column per language, and most words.
MEMO_BYTES, MEMO_WORDS = 32 << 20, 300_000
#: Most bytes of models that go to workers. They hold a column per language, so some tens of languages fit; more end in an error.
MODEL_BYTES = 1 << 30
LONG_WORD = 32
MARK = 0x1FFFFF
#: Odd multipliers, one per place of an n-gram, counted from its last character.
_MULT = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1) ^ (0xBF58476D1CE4E5B9 << k)) % (1 << 64) | 1 for k in range(8)], dtype=np.uint64)


PLAIN_LETTERS = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=1)
def letters() -> re.Pattern:
    """Runs of letters, with the marks that combine with them (vowel signs of Indic and Thai scripts, accents of their own)."""
    runs: list[list[int]] = []
    for c in range(0x300, 0x20000):
        if unicodedata.category(chr(c)) in ("Mn", "Mc"):
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    marks = "".join(f"{chr(a)}-{chr(b)}" for a, b in runs)
    return re.compile(rf"[^\W\d_]+(?:[{marks}]+[^\W\d_]*)*")


def words_of(text: str | None) -> list[str]:
    text = (text or "").lower()
    return (PLAIN_LETTERS if text.isascii() else letters()).findall(text)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each between marks, and the word of every place; the first mark of a word only gives context."""
    sizes = np.fromiter((len(w) for w in words), dtype=np.int64, count=len(words)) + 2
    codes = np.full(int(sizes.sum()), MARK, dtype=np.uint64)
    begins = np.cumsum(sizes) - sizes
    inside = np.ones(len(codes), dtype=bool)
    inside[begins] = False
    inside[begins + sizes - 1] = False
    codes[inside] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return codes, np.repeat(np.arange(len(words)), sizes)


def _place_in_word(owner: np.ndarray) -> np.ndarray:
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, dtype=np.int64)
    return np.arange(len(owner)) - np.repeat(first, np.diff(np.concatenate([first, [len(owner)]])))


def _hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """Hash of the n-gram that ends at each place; only meaningful where the word has so many places up to there."""
    h = np.zeros(len(codes), dtype=np.uint64)
    for k in range(order):
        h[k:] += (codes[: len(codes) - k] + np.uint64(1)) * _MULT[k]
    return _mixed(h + np.uint64(order))


@dataclass
class Models:
    """languages; per order 1 to n: sorted n-gram hashes with shares (row, language), sorted context hashes with back-off weights."""

    languages: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    floor: float
    mean: np.ndarray | None = None
    deviation: np.ndarray | None = None
    reject_at: float = 8.0
    sharpness: float = 1.0

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """Natural log probability of each word, its end included, under every language."""
        codes, owner = _codes(words)
        place = _place_in_word(owner)
        p = np.full((len(codes), len(self.languages)), self.floor)
        for n, ((keys, shares), (contexts, weights)) in enumerate(zip(self.grams, self.contexts, strict=True), 1):
            there = np.flatnonzero(place >= max(1, n - 1))
            if not len(there):
                break
            if n == 1:
                p[there] *= weights[0]
            else:
                h = _hashes(codes, n - 1)[there - 1]
                at = np.minimum(np.searchsorted(contexts, h), len(contexts) - 1)
                known = contexts[at] == h
                there, at = there[known], at[known]
                p[there] *= weights[at]
            h = _hashes(codes, n)[there]
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            known = keys[at] == h
            p[there[known]] += shares[at[known]]
        logs = np.log(p)
        logs[place == 0] = 0
        firsts = np.flatnonzero(place == 0)
        return np.add.reduceat(logs, firsts, axis=0) if len(firsts) else np.zeros((0, len(self.languages)))


def train(words: dict[str, Counter], order: int = ORDER) -> Models:
    """Models from word counts of each language."""
    languages = sorted(words)
    per_order: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []  # per language and order: gram, context, raw count
    alphabet: set[int] = set()
    for lang in languages:
        items = sorted(words[lang].items())
        codes, owner = _codes([w for w, _ in items])
        times = np.array([c for _, c in items], dtype=np.int64)[owner] if items else np.zeros(0, dtype=np.int64)
        place = _place_in_word(owner)
        alphabet |= set(np.unique(codes).tolist())
        found = []
        for n in range(1, order + 1):
            there = np.flatnonzero(place >= max(1, n - 1))
            gram = _hashes(codes, n)[there]
            context = _hashes(codes, n - 1)[there - 1] if n > 1 else np.zeros(len(there), dtype=np.uint64)
            lower = _hashes(codes, n - 1)[there] if n > 1 else np.zeros(len(there), dtype=np.uint64)
            keys, first, inverse = np.unique(gram, return_index=True, return_inverse=True)
            found.append((keys, context[first], lower[first], np.bincount(inverse, weights=times[there], minlength=len(keys))))
        per_order.append(found)
    grams, contexts = [], []
    for n in range(1, order + 1):
        all_keys = np.unique(np.concatenate([f[n - 1][0] for f in per_order]))
        all_contexts = np.unique(np.concatenate([f[n - 1][1] for f in per_order]))
        shares = np.zeros((len(all_keys), len(languages)))
        weights = np.ones((len(all_contexts), len(languages)))
        for k, found in enumerate(per_order):
            keys, context, _, raw = found[n - 1]
            if n == order:
                count = raw
            else:  # continuation count: different characters before this n-gram; at the start of a word there is none, it counts as seen once
                above, lower_keys = found[n][0], found[n][2]
                count = np.bincount(np.searchsorted(keys, lower_keys), minlength=len(keys)).astype(float) if len(above) else np.zeros(len(keys))
                count = np.where(count == 0, raw, count)
            n1, n2 = (count == 1).sum(), (count == 2).sum()
            discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            groups, inverse = np.unique(context, return_inverse=True)
            total = np.bincount(inverse, weights=count, minlength=len(groups))
            kinds = np.bincount(inverse, minlength=len(groups))
            shares[np.searchsorted(all_keys, keys), k] = np.maximum(count - discount, 0) / total[inverse]
            weights[np.searchsorted(all_contexts, groups), k] = np.minimum(1.0, discount * kinds / total)
        grams.append((all_keys, shares))
        contexts.append((all_contexts, weights))
    size = sum(a.nbytes for pair in [*grams, *contexts] for a in pair)
    if size > MODEL_BYTES:
        raise ValueError(f"models of {len(languages)} languages take {size} bytes: learn from fewer rows per language")
    return Models(languages, grams, contexts, 1.0 / (len(alphabet) + 1))


class Scorer:
    """Scores texts; remembers the scores of short words."""

    def __init__(self, models: Models):
        self.models, self.memo = models, {}
        self.words = max(1, min(MEMO_WORDS, MEMO_BYTES // (8 * len(models.languages))))
        self.table = np.zeros((self.words, len(models.languages)))

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each text under every language, and its characters with one end mark a word."""
        split = [words_of(t) for t in texts]
        memo = self.memo
        new = list(dict.fromkeys(w for ws in split for w in ws if w not in memo))
        extra: dict[str, np.ndarray] = {}
        begin = 0
        while begin < len(new):
            end, size = begin, 0
            while end < len(new) and (size < 200_000 or end == begin):
                size += len(new[end]) + 2
                end += 1
            some = new[begin:end]
            for w, s in zip(some, self.models.log_probabilities(some), strict=True):
                if len(memo) < self.words and len(w) <= LONG_WORD:
                    self.table[len(memo)] = s
                    memo[w] = len(memo)
                else:
                    extra[w] = s
            begin = end
        out = np.zeros((len(texts), len(self.models.languages)))
        for i, ws in enumerate(split):
            known = [memo[w] for w in ws if w in memo] if extra else list(map(memo.__getitem__, ws))
            if known:
                out[i] = self.table[known].sum(axis=0)
            if len(known) < len(ws):
                out[i] += np.sum([extra[w] for w in ws if w not in memo], axis=0)
        return out, np.array([sum(map(len, ws)) + len(ws) for ws in split], dtype=float)

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score from 0 to 1, cross-entropy in nats a character and rejection of each text."""
        m = self.models
        sums, n = self.sums(texts)
        none = (n == 0) | np.array([not any(map(str.isalpha, t or "")) for t in texts], dtype=bool)
        entropy = -sums / np.maximum(n, 1)[:, None]
        best = entropy.argmin(axis=1)
        least = entropy[np.arange(len(texts)), best]
        odd = (least - m.mean[best]) / (m.deviation[best] / np.sqrt(np.maximum(n, 1)) + 0.05 * m.mean[best])
        margin = entropy - least[:, None]
        share = 1 / np.exp(-m.sharpness * margin * np.sqrt(np.maximum(n, 1))[:, None]).sum(axis=1)
        score = share / (1 + np.exp(np.clip(odd - m.reject_at, -50, 50)))
        score[none] = 0.0
        languages = ["und" if x else m.languages[b] for x, b in zip(none, best, strict=True)]
        return languages, np.clip(score, 0, 1), least, none | (odd > m.reject_at)


def calibrate(models: Models, rows: list[tuple[str, str]]) -> Models:
    """Mean and deviation of the cross-entropy of each language, the rejection bound and the sharpness of scores, from unseen rows.

    The bound is the largest standardised cross-entropy of a correctly named row, plus half, at least 8: what reads like no language
    seen is rejected, and what reads like the labelled rows is kept. The sharpness is the one of the lowest log loss.
    """
    scorer = Scorer(models)
    size = len(models.languages)
    models.mean, models.deviation = np.full(size, 3.0), np.full(size, 1.0)
    sums, n = scorer.sums([t for _, t in rows])
    keep = n > 0
    truth = np.array([models.languages.index(lang) for lang, _ in rows], dtype=int)
    entropy = -sums / np.maximum(n, 1)[:, None]
    for k in range(size):
        own = keep & (truth == k)
        if own.any():
            e, w = entropy[own, k], n[own]
            models.mean[k] = float((e * w).sum() / w.sum())
            models.deviation[k] = float(max(0.5, np.sqrt((w * (e - models.mean[k]) ** 2).mean())))
    if keep.any():
        best = entropy.argmin(axis=1)
        least = entropy[np.arange(len(rows)), best]
        odd = (least - models.mean[best]) / (models.deviation[best] / np.sqrt(np.maximum(n, 1)) + 0.05 * models.mean[best])
        right = keep & (best == truth)
        models.reject_at = max(8.0, 1.5 * float(odd[right].max())) if right.any() else 8.0
        margin = entropy[keep] - least[keep, None]
        scale = np.sqrt(n[keep])[:, None]
        losses = {}
        for s in (0.25, 0.5, 1.0, 2.0, 4.0):
            z = -s * margin * scale
            losses[s] = float(-(z[np.arange(len(z)), truth[keep]] - np.log(np.exp(z).sum(axis=1))).mean())
        models.sharpness = min(losses, key=lambda s: (losses[s], s))
    return models


def fit(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Models | None:
    """Train and calibrate on at most rows_per_language labelled rows of each language, none of the test fold."""
    usable = (F.octet_length(F.col(text_col).cast("string")) <= SAMPLE_TEXT_BYTES) & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)
    rows = docs.where(usable).select(F.col(id_col).cast("string").alias("i"), F.col(lang_col).cast("string").alias("l"), F.col(text_col).cast("string").alias("t"))
    lot = F.pmod(F.xxhash64(F.lit("language sample"), "i"), F.lit(1 << 30))
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}  # a row per language
    shares = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, (1.5 * rows_per_language + 50) / n) * (1 << 30)))]) if counts else None
    drawn = lot < shares[F.col("l")] if counts else F.lit(False)
    first = F.row_number().over(Window.partitionBy("l").orderBy("lot", "i"))
    sample = rows.withColumn("lot", lot).where(drawn).withColumn("place", first).where(F.col("place") <= rows_per_language)
    got = sample.select("l", "t", "place").collect()
    learnt = {lang for lang, n in Counter(r["l"] for r in got).items() if n >= 2}
    got = sorted((r for r in got if r["l"] in learnt), key=lambda r: (r["l"], r["place"]))
    words: dict[str, Counter] = {lang: Counter() for lang in learnt}
    unseen = []
    for r in got:
        if r["place"] % 5 == 2:
            unseen.append((r["l"], r["t"]))
        else:
            words[r["l"]].update(words_of(r["t"]))
    words = {lang: w for lang, w in words.items() if w}
    return calibrate(train(words), [x for x in unseen if x[0] in words]) if words else None


def scorer_of(models: Models) -> Scorer:
    """The worker's scorer of these models."""
    return held("language", lambda s: s.models is models, lambda: Scorer(models))


def identify(docs: DataFrame, models: Models | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score, cross_entropy and rejected, in place of columns of these names; the model arrays are bounded by the training sample and broadcast."""
    docs = docs.drop("lang_pred", "score", "cross_entropy", "rejected")
    spark = docs.sparkSession
    place, names = docs.columns.index(text_col), docs.columns
    if models is None:
        return docs.select("*", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    shared = spark.sparkContext.broadcast(models)

    def named(batches):
        scorer = scorer_of(shared.value)
        for b in portions(batches, place):
            lang, score, entropy, rejected = scorer.decide(b.column(place).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()), pa.array(rejected.astype(bool))], names=[*names, "lang_pred", "score", "cross_entropy", "rejected"])

    extra = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return docs.mapInArrow(named, T.StructType([*docs.schema.fields, *extra]))


def accepted(docs: DataFrame, models: Models | None, text_col: str = "text") -> DataFrame:
    """The rows of docs, all their columns, whose language is not rejected."""
    if models is None:
        return docs.limit(0)
    shared = docs.sparkSession.sparkContext.broadcast(models)
    rows = docs.withColumn(text_col, F.col(text_col).cast("string"))
    place = rows.columns.index(text_col)

    def kept(batches):
        scorer = scorer_of(shared.value)
        for b in portions(batches, place):
            yield b.filter(pa.array(~scorer.decide(b.column(place).to_pylist())[3].astype(bool)))

    return rows.mapInArrow(kept, rows.schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return identify(rows, fit(docs)).drop("text")
