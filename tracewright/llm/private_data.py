"""Personal data by fixed patterns and a skip-chain conditional random field (operator 4).

Base spans come from four patterns. The field looks at the tokens that could belong to such data at all: those with a digit or an
at sign; every other token is fixed as outside, which splits a document's chain into short stretches. Neighbouring tokens
share transition potentials; distant tokens that repeat or resemble one another (equal letters and digits, equal last seven
digits) share skip potentials, which pull their labels together. Loopy message passing gives each token's marginals; runs
of one confident label that overlap no base span, and could be an address or number of that kind, are added.

Weights are trained on at most `sample_docs` documents (default 1,500, by a hash of the id, of up to SAMPLE_TEXT_BYTES), labelled by the base patterns; in copies
of them, made from the same documents, some occurrences lose the sign that the pattern needs (a phone's plus) but keep their label.

Defined results: null text is empty; whole texts of any length are scanned in linear time (spans are looked up by binary search); repeated rows give equal results; positions
are code points with exclusive ends; spans are ordered by kind as listed (email, ip, card, phone), then start, then end; an empty table gives
no rows; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import overlap_test, portions, table

KINDS = ("email", "ip", "card", "phone")
#: Documents among which one of the sample is sought at first.
SOUGHT = 16
SAMPLE_DOCS = 1500
#: Longer texts stay out of the sample (not out of the scan), so that the driver holds at most SAMPLE_DOCS times this.
SAMPLE_TEXT_BYTES = 1 << 16
PASSES = 15
#: Messages computed at once; bounds the memory beside a text's own edges.
EDGES_AT_ONCE = 1 << 16
SURE = 0.9
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and (not part or int(part) <= 255)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four patterns, by kind, then start. Each pattern is matched as its leftmost non-overlapping matches."""
    out: list[tuple[str, int, int]] = []
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        found = DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            out.append(("email", begin, found.end()))
            done = found.end()
        else:
            done = max(done, at + 1) if begin == at else done
        at = text.find("@", max(at + 1, done))
    if not DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


LABELS = ("outside", *KINDS)
HINTS = {
    "email": frozenset("mail email e-mail correo courriel mailto contact kontakt".split()),
    "ip": frozenset("ip host server addr address client adresse".split()),
    "card": frozenset("card visa mastercard credit karte carte tarjeta cc pan".split()),
    "phone": frozenset("phone tel telephone call mobile fax cell whatsapp telefon telefono tél".split()),
}
SHAPES = (
    ("at", re.compile(r"[^@\s]+@[^@\s]+")),
    ("at_domain", re.compile(r"[\w.%+-]+@[\w-]+\.[\w.-]+")),
    ("at_only", re.compile(r"@[^@]*|[^@]*@")),
    ("quad", re.compile(r"\d{1,3}(\.\d{1,3}){3}")),
    ("plus", re.compile(r"\+\d.*")),
    ("plus_code", re.compile(r"\+\d{1,3}")),
    ("paren_3", re.compile(r"\(\d{2,5}\)")),
    ("3_4", re.compile(r"\d{3}[-.]\d{4}")),
    ("3_3_4", re.compile(r"\(?\d{3}\)?[-.]\d{3}[-.]\d{4}")),
    ("digits", re.compile(r"\d+")),
    ("groups_4", re.compile(r"\d{4}([-.]\d{4}){3}")),
    ("group_4", re.compile(r"\d{4}")),
    ("date", re.compile(r"\d{4}-\d\d?-\d\d?|\d\d?[./]\d\d?[./]\d{2,4}")),
    ("number", re.compile(r"\d+[.,]\d+%?")),
    ("hex", re.compile(r"[0-9a-f]{12,}", re.I)),
)
WRAP = "\"'<>[]{}*#%$&!?;:,."
NAMES = ["bias", *[f"shape_{n}" for n, _ in SHAPES], *[f"next_{n}" for n, _ in SHAPES], *[f"previous_{n}" for n, _ in SHAPES], *[f"digits_{n}" for n in ("0", "1_2", "3", "4", "5_6", "7_9", "10_12", "13_15", "16_19", "20_")], "letters", "luhn", *[f"hint_{k}" for k in KINDS]]


@dataclass
class Graph:
    """Candidate tokens of a text: spans of their cores, features, chain and skip edges."""

    spans: list[tuple[int, int]]
    x: list[list[int]]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


def _core(text: str, begin: int, end: int) -> tuple[int, int]:
    while begin < end and text[begin] in WRAP:
        begin += 1
    while end > begin and text[end - 1] in WRAP:
        end -= 1
    return begin, end


def _digits_name(n: int) -> int:
    return 0 if n == 0 else 1 if n < 3 else 2 if n == 3 else 3 if n == 4 else 4 if n < 7 else 5 if n < 10 else 6 if n < 13 else 7 if n < 16 else 8 if n < 20 else 9


def graph(text: str) -> Graph:
    spans, words = [], []
    ends = []
    for m in TOKEN.finditer(text):
        begin, end = _core(text, m.start(), m.end())
        if begin < end:
            spans.append((begin, end))
            words.append(text[begin:end])
            ends.append((m.start(), m.end()))
    shapes = [[k for k, (_, p) in enumerate(SHAPES) if len(w) <= 64 and p.fullmatch(w)] for w in words]
    first, rows, chain, skip = {n: i for i, n in enumerate(NAMES)}, [], [], []
    last: dict[str, int] = {}
    n_shapes = len(SHAPES)
    for i, w in enumerate(words):
        near_left = i > 0 and text[ends[i - 1][1] : ends[i][0]] in (" ", "  ", "\t") and ends[i - 1][1] < ends[i][0]
        near_right = i + 1 < len(words) and text[ends[i][1] : ends[i + 1][0]] in (" ", "  ", "\t")
        digits = "".join(c for c in w if "0" <= c <= "9")
        row = [0, *[1 + k for k in shapes[i]]]
        if near_right:
            row += [1 + n_shapes + k for k in shapes[i + 1]]
        if near_left:
            row += [1 + 2 * n_shapes + k for k in shapes[i - 1]]
            chain.append((i - 1, i))
        row.append(first["digits_0"] + _digits_name(len(digits)))
        if any(c.isalpha() for c in w[:64]):
            row.append(first["letters"])
        if 12 < len(digits) < 20 and luhn(digits):
            row.append(first["luhn"])
        before = text[max(0, ends[i][0] - 24) : ends[i][0]].lower().replace(":", " ").split()[-2:]
        for k in KINDS:
            if any(b.strip("().,") in HINTS[k] for b in before):
                row.append(first[f"hint_{k}"])
        rows.append(row)
        keys = {w.lower()[:128]}
        if len(digits) >= 7:
            keys.add(f"#{digits[-7:]}")
        linked = set()
        for key in keys:
            if key in last and last[key] not in linked and (last[key], i) not in chain[-1:]:
                linked.add(last[key])
                skip.append((last[key], i))
            last[key] = i
    return Graph(spans, rows, chain, skip)


@dataclass
class Field:
    """Weights: feature by label, transition by left and right label, and symmetric skip potentials."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def _joined(graphs: list[Graph]):
    n, x_rows, x_cols, edges, kinds = 0, [], [], [], []
    for g in graphs:
        for i, row in enumerate(g.x):
            x_rows += [n + i] * len(row)
            x_cols += row
        edges += [(n + a, n + b) for a, b in g.chain] + [(n + a, n + b) for a, b in g.skip]
        kinds += [0] * len(g.chain) + [1] * len(g.skip)
        n += len(g.x)
    return n, np.array(x_rows, dtype=np.int64), np.array(x_cols, dtype=np.int64), np.array(edges, dtype=np.int64).reshape(-1, 2), np.array(kinds, dtype=np.int64)


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def pass_messages(unary: np.ndarray, edges: np.ndarray, tables: np.ndarray, kinds: np.ndarray, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loopy belief propagation with damping, a fixed number of passes, all graphs at once: log marginals of nodes, and the beliefs and
    messages they come from. tables: the potentials of each kind of edge. A pass goes over EDGES_AT_ONCE messages at a time, so that a
    long text costs a few numbers per edge and label, not per pair of labels."""
    e, size = len(edges), unary.shape[1]
    source, sink = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    both, kind = np.concatenate([tables, tables.transpose(0, 2, 1)]), np.concatenate([kinds, kinds + len(tables)])
    messages, belief = np.zeros((2 * e, size)), unary
    for _ in range(passes if e else 0):
        sent = np.empty_like(messages)
        for a in range(0, 2 * e, EDGES_AT_ONCE):
            at = np.arange(a, min(a + EDGES_AT_ONCE, 2 * e))
            cavity = belief[source[at]] - messages[(at + e) % (2 * e)]
            new = _log_sum(cavity[:, :, None] + both[kind[at]], 1)
            sent[at] = 0.5 * messages[at] + 0.5 * (new - _log_sum(new, 1)[:, None])
        messages, belief = sent, unary.copy()
        np.add.at(belief, sink, messages)
    return belief - _log_sum(belief, 1)[:, None], belief, messages


def edge_marginals(belief: np.ndarray, messages: np.ndarray, edges: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Log marginals of edges by their two labels. pairs: each edge's potentials."""
    e = len(edges)
    joint = (belief[edges[:, 0]] - messages[e:])[:, :, None] + (belief[edges[:, 1]] - messages[:e])[:, None, :] + pairs
    flat = joint.reshape(e, pairs.shape[1] * pairs.shape[2])
    return (flat - _log_sum(flat, 1)[:, None]).reshape(joint.shape) if e else joint


def marginals(graphs: list[Graph], field: Field) -> list[np.ndarray]:
    """Per graph, tokens by labels."""
    n, rows, cols, edges, kinds = _joined(graphs)
    unary = np.zeros((n, len(LABELS)))
    np.add.at(unary, rows, field.unary[cols])
    nodes = pass_messages(unary, edges, np.stack([field.chain, field.skip]), kinds)[0]
    ends = np.cumsum([len(g.x) for g in graphs])
    return [np.exp(nodes[b - len(g.x) : b]) for g, b in zip(graphs, ends, strict=True)]


def labels_of(g: Graph, spans: list[tuple[str, int, int]]) -> list[int]:
    """Per token, the label of the first of spans that overlaps it."""
    labels, ends = [0] * len(g.spans), [end for _, end in g.spans]
    for k, s, e in spans:
        i = bisect_right(ends, s)
        while i < len(ends) and g.spans[i][0] < e:
            labels[i] = labels[i] or LABELS.index(k)
            i += 1
    return labels


def weakened(text: str, spans: list[tuple[str, int, int]], chooser: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A copy in which some phones lose their plus or country code and cards get other separators; the local part of some phones is
    said once more, and numbers of that form that no phone backs are put beside them, outside. Spans follow."""
    out, kept, at = [], [], 0
    size = 0
    for kind, s, e in sorted(spans, key=lambda x: x[1]):
        if s < at:
            continue
        out.append(text[at:s])
        size += s - at
        body = text[s:e]
        if kind == "phone" and chooser.random() < 0.6:
            body = chooser.choice([body[1:], body.partition(" ")[2] or body[1:], re.sub(r"[ ()-]+", ".", body[1:]).strip("."), re.sub(r"[ ()]+", "-", body.partition(" ")[2]).strip("-") or body[1:]])
        elif kind == "card" and chooser.random() < 0.4:
            d = re.sub(r"\D", "", body)
            body = ".".join(d[k : k + 4] for k in range(0, len(d), 4))
        out.append(body)
        kept.append((kind, size, size + len(body)))
        size += len(body)
        at = e
    whole = "".join(out) + text[at:]
    for kind, s, e in spans:
        local = text[s:e].split()[-1]
        if kind == "phone" and re.fullmatch(r"[0-9]{3}-[0-9]{4}", local) and chooser.random() < 0.5:
            kept.append((kind, len(whole) + 6, len(whole) + 6 + len(local)))
            whole += f" word {local} word"
    for _ in range(chooser.randrange(3)):
        whole += f" word {chooser.randrange(100, 1000)}-{chooser.randrange(1000, 10000)} word"
    return whole, kept


_PLAIN = "On 2021-03-14 order 48213377 shipped, version 3.0.12, room 214, pages 12-19, total 1,299.50 for 24 units; 10.5% of 3,000 in 1987. See 2.0 or 4.0. Part 9000426309966101 and lot 100-2000 at 12:45, ratio 3/4, @home and C3PO. ref 555-1 and 12.04.2019"
_MADE = [
    ("Call +1 (974) 555-3436 today or mail ab.12@host7.example.com from 10.20.30.40 with card 4539 1488 0343 6467 now",),
    ("tel: +44 20 7946 0958, e-mail x.y@mail.example.org and again x.y@mail.example.org, ip 192.168.1.254, 6011000990139424",),
]


def train(texts: list[str], seed: int = 7, steps: int = 80) -> Field:
    """Weights by gradient ascent on the likelihood, its expectations from message passing (fixed steps, seeded copies)."""
    chooser = random.Random(seed)
    rows: list[tuple[Graph, list[int]]] = []
    for text in [*texts, *[m[0] for m in _MADE] * 10, *[_PLAIN] * 10]:
        spans = base_spans(text)
        variants = [(text, spans)] + ([weakened(text, spans, chooser)] if spans else [])
        for t, s in variants:
            g = graph(t)
            if g.x:
                rows.append((g, labels_of(g, s)))
    graphs = [g for g, _ in rows]
    truth = np.array([y for _, ys in rows for y in ys])
    n, at, cols, edges, kinds = _joined(graphs)
    size = len(LABELS)
    weights = [np.zeros((len(NAMES), size)), np.zeros((size, size)), np.zeros((size, size))]
    wanted = np.eye(size)[truth]
    seen = np.zeros_like(weights[0])
    np.add.at(seen, cols, wanted[at])
    pair_seen = [np.zeros((size, size)), np.zeros((size, size))]
    for k in (0, 1):
        e = edges[kinds == k]
        np.add.at(pair_seen[k], (truth[e[:, 0]], truth[e[:, 1]]), 1)
    pair_seen[1] = (pair_seen[1] + pair_seen[1].T) / 2
    momentum, scale = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        unary = np.zeros((n, size))
        np.add.at(unary, at, weights[0][cols])
        tables = np.stack(weights[1:])
        nodes, belief, messages = pass_messages(unary, edges, tables, kinds, 8)
        joint = edge_marginals(belief, messages, edges, tables[kinds])
        p = np.exp(nodes)
        expected = np.zeros_like(weights[0])
        np.add.at(expected, cols, p[at])
        gradients = [seen - expected]
        for k in (0, 1):
            q = np.exp(joint[kinds == k]).sum(axis=0) if (kinds == k).any() else np.zeros((size, size))
            q = (q + q.T) / 2 if k else q
            gradients.append(pair_seen[k] - q)
        for w, g, m, v in zip(weights, gradients, momentum, scale, strict=True):
            g = g / max(1, n) - 1e-4 * w
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            w += 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(*weights)


def _could_be(kind: str, body: str) -> bool:
    digits = "".join(c for c in body if "0" <= c <= "9")
    if kind == "email":
        return re.fullmatch(r"[\w.%+-]+(?:@| ?[\[(]at[\])] ?)[\w-]+(?:\.[\w-]+)+", body) is not None
    if kind == "ip":
        return re.fullmatch(r"\d+(\.\d+){3}", body) is not None and all(map(_small, body.split(".")))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and re.fullmatch(r"[0-9 .-]+", body) is not None
    return 7 <= len(digits) <= 15 and re.fullmatch(r"[0-9 ().+/-]+", body) is not None and re.search(r"[ ().-]", body) is not None


def added_spans(g: Graph, p: np.ndarray, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Runs of tokens with one sure label next to each other that overlap no base span."""
    label = np.where(p.max(axis=1) >= SURE, p.argmax(axis=1), 0)
    linked, taken, out, i = set(g.chain), overlap_test((s, e) for _, s, e in base), [], 0
    while i < len(label):
        j = i
        while label[i] and j + 1 < len(label) and label[j + 1] == label[i] and (j, j + 1) in linked:
            j += 1
        if label[i]:
            kind, begin, end = LABELS[label[i]], g.spans[i][0], g.spans[j][1]
            if not taken(begin, end) and _could_be(kind, text[begin:end]):
                out.append((kind, begin, end))
        i = j + 1
    return out


def scan_all(texts: list[str | None], field: Field) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """Base and added spans of each whole text."""
    texts = [t or "" for t in texts]
    base = [base_spans(t) if DIGIT.search(t) or "@" in t else [] for t in texts]
    graphs = [(i, graph(t)) for i, t in enumerate(texts) if DIGIT.search(t) or "@" in t]
    graphs = [(i, g) for i, g in graphs if g.x]
    added: dict[int, list] = {}
    if graphs:
        for (i, g), p in zip(graphs, marginals([g for _, g in graphs], field), strict=True):
            added[i] = added_spans(g, p, texts[i], base[i])
    return [(b, added.get(i, [])) for i, b in enumerate(base)]


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Train on at most sample_docs documents with a digit or an at sign, the first by a hash of the id. That hash is looked at before any text:
    the sample is sought among SOUGHT times as many documents, and among more only where too few of these have such a sign."""
    lot = F.pmod(F.xxhash64(F.lit("private sample"), F.col(id_col)), F.lit(1 << 30)).alias("lot")
    rows = docs.select(lot, F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    share = SOUGHT * (sample_docs + 100) / max(1, docs.count())
    while True:
        near = rows.where(F.col("lot") < int(min(1.0, share) * (1 << 30))).where((F.octet_length("t") <= SAMPLE_TEXT_BYTES) & F.col("t").rlike("[0-9@]"))
        got = near.orderBy("lot", "i").limit(sample_docs).collect()
        if len(got) == sample_docs or share >= 1:
            return train([r["t"] for r in got])
        share *= SOUGHT


def find_private(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (array of kind, start, end, base), by kind, then start. The field's weights, some kilobytes, are broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def scanned(batches):
        for b in portions(batches, 1):
            out = []
            for base, added in scan_all(b.column(1).to_pylist(), shared.value):
                spans = [(*s, True) for s in base] + [(*s, False) for s in added]
                spans.sort(key=lambda x: (KINDS.index(x[0]), x[1], x[2]))
                out.append([{"kind": a, "start": s, "end": e, "base": f} for a, s, e, f in spans])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], names=["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scanned, "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def op4_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all documents and the digests that the contract names; n_... count base spans, n_added the others."""
    docs = table(spark, sf_dir, "documents")
    found = find_private(docs, fit(docs))
    of = lambda kind: F.size(F.filter("spans", lambda x: (x["kind"] == kind) & x["base"])).cast("long").alias(f"n_{kind}")
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["base"])
    added = F.size(F.filter("spans", lambda x: ~x["base"])).cast("long").alias("n_added")
    return found.select("doc_id", *map(of, KINDS), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), added)
