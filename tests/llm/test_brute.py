"""Operators and their queries against brute-force versions, exact round trips and held-out accuracy."""

import hashlib
import itertools
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tracewright.llm import catalog, collision, html_text, language_id, mixing, multi_index, pieces, private_data, secrets, simhash, token_files

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    return catalog.QUERIES[name](spark, SF).collect()


def test_registered():
    assert set(catalog.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in catalog.QUERIES) == list(range(1, 14))


# 1 and 2: vectors ------------------------------------------------------------------------------------------------------------------


def test_op1(spark):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = sorted(map(tuple, run(spark, "op1_exact_hamming_top_k")))
    assert got == sorted(c.sql(catalog.ORACLE_SQL["op1_exact_hamming_top_k"]).fetchall())


@pytest.mark.parametrize("n", [40, 900, 9000])
def test_multi_index(n):
    chooser = np.random.default_rng(n)
    centres = chooser.integers(0, 1 << 63, 30, dtype=np.uint64)
    codes = centres[chooser.integers(0, 30, n)] ^ (np.uint64(1) << chooser.integers(0, 64, n).astype(np.uint64))
    codes[: n // 3] = centres[0]
    ids = np.arange(n, dtype=np.int64)
    index = multi_index.MultiIndex(ids, codes)
    for q in chooser.integers(0, n, 25):
        d = np.bitwise_count(codes ^ codes[q]).astype(int)
        want = [i for i in np.lexsort((ids, d)) if i != q][:10]
        got, distance = index.search(codes[q], int(q), 10)
        assert got.tolist() == want and distance.tolist() == d[want].tolist()


def test_op2_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    norms = np.sqrt((v * v).sum(axis=1))
    got = defaultdict(list)
    for r in sorted(run(spark, "op2_collision_counting"), key=lambda r: r["rank"]):
        got[r.query_id].append((r.vec_id, r.score))
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = (v * v[q]).sum(axis=1) / (norms * norms[q])
        want = [i for i in np.lexsort((ids, -s)) if i != q][:5]
        assert len(got[ids[q]]) == 5
        hits += len({x for x, _ in got[ids[q]]} & set(ids[want].tolist()))
        total += 5
        assert all(abs(x - s[np.flatnonzero(ids == i)[0]]) < 1e-12 for i, x in got[ids[q]])
    assert hits / total >= 0.95


def test_collision_recall_and_ties():
    chooser = np.random.default_rng(1)
    v = chooser.standard_normal((3000, 32))
    v[1000:2000] = v[0]
    ids = np.arange(3000, dtype=np.int64)
    index = collision.CollisionIndex(ids, v)
    hits = 0
    queries = np.concatenate([[0, 1500], chooser.integers(2000, 3000, 40)])
    for q, (got, score) in zip(queries, index.search_all(v[queries], ids[queries], 5), strict=True):
        s = (v * v[q]).sum(axis=1) / (index.norms * index.norms[q])
        want = [i for i in np.lexsort((ids, -s)) if i != q][:5]
        hits += len(set(got.tolist()) & set(want))
        if q < 2000:
            assert got.tolist() == want
    assert hits / (5 * len(queries)) >= 0.95


# 3: near-duplicates ----------------------------------------------------------------------------------------------------------------


def classes(ids, fps, bits=4):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, a), (j, b) in itertools.combinations(zip(ids, fps, strict=True), 2):
        if (a ^ b).bit_count() <= bits and root(i) != root(j):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i in ids}


def plain_fingerprint(text):
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_op3(spark, documents):
    fps = {i: plain_fingerprint(r.text) for i, r in documents.items()}
    want = classes(sorted(fps), [fps[i] for i in sorted(fps)])
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in run(spark, "op3_simhash_near_dedup")} == {(i, f"{fps[i]:016x}", want[i]) for i in fps}


@pytest.mark.parametrize("block_rows", [4096, 8])
def test_links_in_hot_blocks(spark, block_rows):
    chooser = random.Random(6)
    centre = chooser.getrandbits(64)
    fps = {centre}
    for _ in range(120):
        fps.add(centre ^ sum(1 << b for b in chooser.sample(range(64), chooser.randrange(1, 12))))
    fps |= {chooser.getrandbits(64) for _ in range(100)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    edges = simhash.links(df, block_rows=block_rows)
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    want = classes(signed, fps)
    assert {f: roots.get(f, f) for f in signed} == {f: min(g for g in signed if want[g] == want[f]) for f in signed}


def test_long_chain_of_links(spark):
    edges = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    assert {r.root for r in simhash.components(edges).collect()} == {0}


def test_segments_grow():
    assert simhash.segments_for(10, 4) == 5 and simhash.segments_for(10**8, 4) == 6 and simhash.segments_for(10**11, 4) >= 7
    fps = np.array([5, 5 ^ 0b1111], dtype=np.uint64)
    for m in (5, 6, 7):
        k = simhash.block_keys(fps, m, 4)
        assert (k[0] == k[1]).any()


# 4 and 8: spans --------------------------------------------------------------------------------------------------------------------


def plain_private(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]


def test_private_patterns():
    chooser = random.Random(1)
    for _ in range(4000):
        t = "".join(chooser.choice("a.b@@-1234 +()4539 é\n%") for _ in range(chooser.randint(0, 40)))
        assert private_data.base_spans(t) == plain_private(t)


def spans_text(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def test_op4(spark, documents):
    for r in run(spark, "op4_private_data"):
        base = plain_private(documents[r.doc_id].text or "")
        counts = Counter(k for k, _, _ in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in private_data.KINDS)
        assert r.base_sha256 == hashlib.sha256(spans_text(base).encode()).hexdigest()
        assert set(spans_text(base).split(",")) <= set(r.spans.split(","))


def test_skip_chain(documents):
    field = private_data.train([r.text for r in documents.values() if r.text and re.search("[0-9@]", r.text)])
    say = lambda t: [(k, t[s:e]) for k, s, e in private_data.scan_all([t], field)[0][1]]
    far = " word" * 300
    assert say(f"call +1 (974) 555-3436 now{far} or 555-3436 again") == [("phone", "555-3436")]
    assert say(f"pages 100-2000 now{far} or 555-3436 again") == []
    assert say("order 48213377 on 2021-03-14, version 3.0.12, lot 9000426309966101") == []


def test_secret_patterns_and_battery():
    chooser = random.Random(2)
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for _ in range(3000):
        t = "".join(chooser.choice(["token", "Secret", "=", ":", " ", '"', "AKIA", "a1b2c3d4e5f6" * 2, "ABCDEFGHIJKLMNOP", "x", "-", "é", "\n", "0f"]) for _ in range(chooser.randint(0, 12)))
        want = [("assign", m.start(), m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        want += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        got = [s for s in secrets.scan(t) if s[0] != "random"]
        assert got == sorted(want, key=lambda s: (s[1], secrets.KINDS.index(s[0])))
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    found = sum(any(s[0] == "random" for s in secrets.scan(f"key is {''.join(chooser.choice(chars) for _ in range(40))} ok")) for _ in range(100))
    assert found >= 90
    for t in ("getUserNameFromDatabaseConnection2", "com/example/path/to/some/file2", "version-1-2-3-4-5-beta-release", "THE_QUICK_BROWN_FOX_JUMPS_2", "order-000012345678901234"):
        assert secrets.scan(t) == []
    assert secrets.redacted("a token=abcdefgh b", secrets.scan("a token=abcdefgh b")) == "a <secret> b"


def test_false_discoveries_weigh_length():
    assert secrets.discoveries([]) == []
    assert secrets.discoveries([(0.004, 100.0), (0.9, 100.0)], 0.01) == [True, False]
    assert secrets.discoveries([(0.008, 50.0), (0.9, 150.0)], 0.01) == [False, False]


def plain_secrets(t):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [("assign", m.start(), m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_op8(spark, documents):
    for r in run(spark, "op8_secret_scan"):
        spans = plain_secrets(documents[r.doc_id].text or "")
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in spans) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(spans_text(spans).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("random:")] == [f"{k}:{a}:{b}" for k, a, b in spans]


# 5: pages --------------------------------------------------------------------------------------------------------------------------


def test_op5(spark):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in run(spark, "op5_html_main_text"):
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>|<br>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_unseen_layouts():
    trees = html_text.train([], layouts=400)
    chooser, right, wrong, missed = random.Random(99), 0, 0, 0
    for _ in range(150):
        page = html_text.made_up_page(chooser, html_text._STOCK)
        want = [v.text.replace(html_text.MARK, "") for v in html_text.nodes_of(html_text.parse(page)) if v.text and html_text.MARK in v.text]
        got = html_text.main_text(page.replace(html_text.MARK, ""), trees).split("\n")
        both = sum((Counter(want) & Counter(got)).values())
        right, wrong, missed = right + both, wrong + len(got) - both, missed + len(want) - both
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.95


# 6: language -----------------------------------------------------------------------------------------------------------------------


def test_op6(spark, documents):
    got = run(spark, "op6_language_id")
    assert len(got) == len(documents)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    test = [r for r in got if r.held_out and documents[r.doc_id].lang and len(documents[r.doc_id].text) > 20]
    assert sum(r.lang_pred == documents[r.doc_id].lang for r in test) / len(test) >= 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_kneser_ney_sums_to_one():
    words = {"a": Counter("the thing then there other author this that".split() * 3 + ["them"]), "b": Counter("der die das dann doch durch".split())}
    m = language_id.train(words, 4)
    alphabet = sorted({c for w in words.values() for x in w for c in x})
    for head in ("", "t", "th", "the", "zz"):
        logs = m.log_probabilities([head, *[head + c for c in alphabet]])
        plain = np.exp(logs[0])  # the head and its end
        assert (plain > 0).all() and (plain <= 1).all()
    # probabilities of the next character after a head: the end, and each letter of the alphabet, by differences of prefixes
    def prefix(w):
        codes, owner = language_id._codes([w])
        return codes, owner

    assert prefix("ab")[0].shape == (4,)
    assert language_id.Scorer(m).sums(["the then"])[1][0] == 9
    language_id.calibrate(m, [("a", "the thing then"), ("b", "der die das")])
    assert language_id.Scorer(m).decide(["then the other", "das doch", "123"])[0] == ["a", "b", "und"]


# 7: pieces -------------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))


def every(model, unit):
    out = []

    def go(i, score, lengths, ids):
        if i == len(unit):
            out.append((-score, tuple(-x for x in lengths[::-1]), np.array(ids, dtype="<u4").tobytes()))
            return
        for length, edge, s in model._edges(unit, i):
            go(i + length, score + s, [*lengths, length], [*ids, *edge])

    go(0, 0.0, [], [])
    return sorted(out)


def test_n_best_of_units(model):
    chooser = random.Random(2)
    for _ in range(150):
        u = "".join(chooser.choice("▁ththehandonxéñ文") for _ in range(chooser.randint(1, 9)))
        all_of = every(model, u)
        scores = {ids: -s for s, _, ids in all_of}
        got = model.n_best(u, 5)
        assert [s for s, _ in got] == [-x[0] for x in all_of[:5]] and all(scores[i] == s for s, i in got) and len({i for _, i in got}) == len(got)
        ids, score, gap = model._solve([u])[u]
        assert (ids, score) == (all_of[0][2], -all_of[0][0]) == (got[0][1], got[0][0])
        assert gap == (all_of[1][0] - all_of[0][0] if len(all_of) > 1 else float("inf"))


@pytest.mark.parametrize("text", ["the cat, is. a\nb", "ab cd", "a  b", "x é", "th th th", "tab\there", " lead"])
def test_n_best_of_texts(model, text):
    got = model.encode([text], 4)[0]
    whole = model.n_best(pieces.SPACE + text.replace(" ", pieces.SPACE), 4)
    assert [s for s, _ in got] == [s for s, _ in whole] and got[0] == whole[0]
    assert all(model.decode(ids) == text for _, ids in got) and len({i for _, i in got}) == len(got)


def test_op7(spark, documents, model):
    for r in run(spark, "op7_n_best_pieces"):
        found = model.encode([documents[r.doc_id].text], pieces.N_BEST)[0]
        assert r.round_trip and r.ids_crc32 == zlib.crc32(found[0][1]) and r.n_pieces == len(found[0][1]) // 4
        assert r.n_best_crc32 == ",".join(str(zlib.crc32(i)) for _, i in found)


def plain_n_best(text, n=4):
    """Scores of the n best segmentations of a whole text, best first, by the n best ways up to each place of the uncut lattice."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
    unknown, longest = min(x for x in plain.values() if x > -1e8) - 10, max(map(len, plain))

    def scores(t):
        body = "\u2581" + t.replace(" ", "\u2581") if t else ""
        best = [[0.0]] + [[] for _ in body]
        for end in range(1, len(body) + 1):
            ways = []
            for begin in range(max(0, end - longest), end):
                piece = body[begin:end]
                score = plain.get(piece, unknown if len(piece) == 1 else None)
                if score is not None:
                    ways += [b + score for b in best[begin]]
            best[end] = sorted(ways, reverse=True)[:n]
        return best[-1]

    return [scores(t or "") for t in text]


def test_op7_against_the_uncut_lattice(spark, tmp_path):
    """The query's scores, and its best segmentations' round trip, on a table of texts with ties, unknown characters and none."""
    chooser = random.Random(8)
    texts = [None, "", " ", "  a", "the cat, is. a\nb", "\u6587\u5b57 \u00e9t\u00e9", "x" * 60, "th th th", "\U0001f600 ok"]
    texts += ["".join(chooser.choice(["the ", "and", " on", "x", "\u00f1", ", ", "\n", "12", "ing", "\u6587"]) for _ in range(chooser.randrange(30))) for _ in range(120)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in catalog.QUERIES["op7_n_best_pieces"](spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(plain_n_best(texts)):
        assert got[i].n_best == ",".join(f"{s:.0f}" for s in want) and got[i].score == want[0] and got[i].round_trip
        assert len(set(got[i].n_best_crc32.split(","))) == len(want)


# 9: token files --------------------------------------------------------------------------------------------------------------------


def test_op9(spark, documents):
    from tokenizers import Tokenizer

    tokenizer, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    got = {r.doc_id: r for r in run(spark, "op9_token_files")}
    for i in sorted(documents):
        ids = [*tokenizer.encode(documents[i].text or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens) == (start, len(ids))
        assert got[i].ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)


def test_word_encoder_is_exact():
    e = token_files.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    chooser = random.Random(3)
    texts = ["It's they'VE, don't. É.É, ΣΑΣ. İI.ı <|endoftext|>.x <|ENDOFTEXT|>, A.<|x", "a≠b x's. 'rest.'s don't!!'t", "a" * 5000 + ".", None, ""]
    texts += ["".join(chooser.choice("abÉé.,'sS\"$%!?  \n-_’…·÷ßÿ12<|>t́≠l") for _ in range(chooser.randint(0, 24))) for _ in range(3000)]
    for k in range(0, len(texts), 50):
        ids, sizes = e.encode(texts[k : k + 50])
        at = np.concatenate([[0], np.cumsum(sizes)])
        for i, t in enumerate(texts[k : k + 50]):
            assert ids[at[i] : at[i + 1]].tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids


# 10: mixing ------------------------------------------------------------------------------------------------------------------------


def test_fit_against_all_subsets():
    chooser = random.Random(5)
    for _ in range(60):
        lengths = np.array(sorted(chooser.sample(range(1, 30), 4)))
        counts = np.array([chooser.randrange(1, 4) for _ in lengths])
        budget = chooser.randrange(0, int((lengths * counts).sum()) + 1)
        take = mixing.fit(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        sums = {sum(int(a) * k for a, k in zip(lengths, ks, strict=True)) for ks in itertools.product(*[range(c + 1) for c in counts])}
        got = int((take * lengths).sum())
        assert got in sums and abs(got - budget) <= min(abs(s - budget) for s in sums) + int(lengths.min())
    big = mixing.fit(np.arange(1, 3000), np.full(2999, 50), 1_234_567, 1 << 12)
    assert int((big * np.arange(1, 3000)).sum()) == 1_234_567


def plain_targets(sizes):
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / total > 3 * sizes[s]}
        if not over:
            return target | {s: rest * weight[s] / total for s in free}
        for s in over:
            target[s] = 3 * sizes[s]
        rest -= sum(3 * sizes[s] for s in over)
        free -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, "d": 70, None: 200}, {"a": 100}, {"x": 0, "y": 0}, {"b": 1, "a": 10**12, "c": 3, "B": 40}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_op10(spark, documents):
    rows = run(spark, "op10_mix_sources")
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.size == len(WORD.findall(documents[r.doc_id].text or "")) and r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    want = plain_targets(dict(sizes))
    assert all(abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source] for r in rows)
    for s in sizes:  # as near as any choice of single documents on top of whole rounds gets, or nearer than a hundredth
        own = [r.size for r in rows if r.source == s and r.size]
        sums = {0}
        for k in own:
            sums |= {x + k for x in sums}
        rest = round(want[s]) % sizes[s]
        assert abs(taken[s] - want[s]) <= max(1 + min(abs(x - rest) for x in sums), 0.01 * want[s])


# the pipeline ----------------------------------------------------------------------------------------------------------------------


def test_pipeline(spark, documents, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    models = language_id.fit(docs)
    scorer = language_id.Scorer(models)
    kept = [i for i in sorted(documents) if not scorer.decide([documents[i].text])[3][0]]
    fps = [plain_fingerprint(documents[i].text) for i in kept]
    first = classes(kept, fps)
    kept = [i for i in kept if first[i] == i]
    clean = {i: secrets.redacted(documents[i].text, secrets.scan(documents[i].text)) for i in kept}
    got = defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r.doc_id].append(r)
    assert set(got) <= set(kept) and len(got) > 0.5 * len(kept)
    words = {i: len(WORD.findall(clean[i])) for i in kept}
    sizes, taken = defaultdict(int), defaultdict(int)
    for i in kept:
        sizes[documents[i].source] += words[i]
        taken[documents[i].source] += words[i] * len(got.get(i, []))
    want = plain_targets(dict(sizes))
    assert all(abs(taken[s] - want[s]) <= max(1, 0.01 * want[s]) for s in sizes)
    for i, rows in got.items():
        ids = np.frombuffer(model.encode([clean[i]], 1)[0][0][1], dtype="<u4").tolist()
        assert len(rows) <= 3 and all(list(r.pieces) == ids and r.n_chars == len(clean[i]) for r in rows)
