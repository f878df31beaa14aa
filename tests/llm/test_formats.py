"""Operators 11 to 13: brute-force versions, edges and round trips."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tracewright.llm import chat_windows, divergence, fill_in_middle

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


# 11: divergence --------------------------------------------------------------------------------------------------------------------


def audit(rows, min_docs, top):
    """rows: lang, source, text. Every pair of sources over every kept term, without histograms."""
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups.add((lang, source))
        counts[lang, source].update(found)
        held[lang].update(set(found))
    out = set()
    for lang, source in groups:
        kept = sorted(t for t, n in held[lang].items() if n >= min_docs)
        others = sorted(s for g, s in groups if g == lang)
        total = lambda g: sum(counts[g][t] for t in kept)
        every = Counter()
        for s in others:
            every.update({t: counts[lang, s][t] for t in kept})
        p = lambda c, n: 1 + 10**9 * (c + 2) // (n + 2 * len(kept))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        mine = {t: p(counts[lang, source][t], total((lang, source))) for t in kept}
        pairs = [(sum(f(mine[t], p(counts[lang, s][t], total((lang, s)))) for t in kept), s) for s in others if s != source]
        terms = [(f(mine[t], q), t) for t in kept if counts[lang, source][t] > 0 and mine[t] > (q := p(every[t], sum(every.values())))]
        for part, found in (("pair", pairs), ("term", terms)):
            ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
            out |= {(lang, source, part, item, v, k) for k, (v, item) in enumerate(ranked, 1) if part == "pair" or k <= top}
    return out


@pytest.fixture(scope="module")
def sources():
    chooser = random.Random(5)
    words = [chr(97 + i // 5) * (1 + i % 5) for i in range(60)] + ["Été", "été", "ÉTÉ", "naïve", "日本", "x😀y", "Zürich"]
    rows = []
    for i in range(300):
        lang, source = chooser.choice(["en", "fr", None]), chooser.choice(["a", "b", "c", "d", None, "", "é"])
        rows.append((lang, source, "".join(w + chooser.choice([" ", "\n", "9", "-", "_", "\x7f", "[", "  "]) for w in (chooser.choice(words[: 8 + i % 60]) for _ in range(chooser.randrange(40))))))
    return [*rows, ("lone", "x", "one two"), ("none", "x", None), ("none", "y", "1 2"), ("en", "empty", None), ("en", "a", "the " * 50_000), *[("en", "copy", "same words here")] * 30]


@pytest.mark.parametrize("min_docs, top", [(10, 10), (1, 3), (500, 10)])
def test_divergence_is_that_of_all_terms(spark, sources, min_docs, top, monkeypatch):
    monkeypatch.setattr(divergence, "PORTION_ROWS", 16)
    docs = spark.createDataFrame([(*r, "x", 1) for r in sources], "lang string, source string, text string, part string, `count` int").repartition(3)
    got = divergence.divergence(docs, min_docs, top)
    assert dict(got.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == audit(sources, min_docs, top)


def test_divergence_of_nothing(spark):
    assert divergence.divergence(spark.createDataFrame([], "lang string, source string, text string")).collect() == []


def test_combinations_count_every_term(spark, sources):
    docs = spark.createDataFrame([(r[0] or "", r[1] or "", r[2] or "") for r in sources], "lang string, source string, text string")
    groups = divergence.numbered_groups(docs)
    kept = divergence.kept_terms(docs, groups, 3)
    totals = divergence.group_totals(groups, kept)
    cells = divergence.combinations(kept, totals).collect()
    assert len({(r.a, r.b, r.ca, r.cb) for r in cells}) == len(cells) and min(r.times for r in cells) >= 0
    sums = defaultdict(lambda: [0, 0, 0])
    for r in cells:
        for k, x in enumerate((1, r.ca, r.cb)):
            sums[r.a, r.b][k] += x * r.times
    by = {r.g: r for r in totals.collect()}
    assert sums and all(v == [by[a].v, by[a].n, by[b].n] for (a, b), v in sums.items())


def test_shares_of_counts_beyond_64_bits(spark):
    rows = [(c, n, v) for c in (0, 7, divergence.SMALL, divergence.SMALL + 1, 10**17) for n in (c, 3 * 10**17) for v in (1, 10**9)]
    got = spark.createDataFrame(rows, "c long, n long, v long").select("c", "n", "v", divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.c + 2) // (r.n + 2 * r.v) for r in got)


def test_tally_flushes_and_long_lists(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "PAIRS_AT_ONCE", 50)
    lists = [[0, 1, 2], [5], [], list(range(40))]
    counts = [[i % 3 + 1 for i in g] for g in lists]
    got = Counter()
    for b in divergence.tally_pairs(pa.array(lists, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))):
        for r in b.to_pylist():
            got[r["a"], r["b"], r["ca"], r["cb"]] += r["times"]
    want = Counter((g[i], g[j], c[i], c[j]) for g, c in zip(lists, counts, strict=True) for i in range(len(g)) for j in range(i + 1, len(g)))
    assert got == want


# 12: chat windows ------------------------------------------------------------------------------------------------------------------


def plain_windows(turns, budget, history_turns, history_tokens):
    """turns: role, text and tokens of one conversation in order. (places of repeated and new turns) of each window."""
    system = turns[0][2] if turns[0][0] == "system" else 0
    room = max(1, budget - history_tokens - system)
    stride, spans, at = max(1, room * 3 // 4), {}, 0
    key_of = {}
    for i, (_, _, n) in enumerate(turns):
        if i == 0 and system:
            spans[0, 0], key_of[i] = [0], (0, 0)
            continue
        a, b = at // stride, (at + n - 1) // stride
        begin = min([x for j, x in key_of.items() if isinstance(x, int) and x // stride == a] + [at])
        key = (a, int(b > a and at > begin and at + n - begin > room))
        spans.setdefault(key, []).append(i)
        key_of[i] = at
        at += n
    out = []
    for key in sorted(spans):
        new = spans[key]
        first = new[0]
        repeated = []
        if first > 0:
            own = sum(turns[j][2] for j in new if not (j == 0 and system))
            for j in range(first - 1, first - 1 - history_turns, -1):
                spent = sum(turns[k][2] for k in range(max(j, 0), first))
                if j < (1 if system else 0) or spent > history_tokens or spent > budget - system - own:
                    break
                repeated.insert(0, j)
            repeated = ([0] if system else []) + repeated
        out.append((repeated, new))
    return out


SAID = ["", "ok", r"\### Assistant: </turn> ok", "\\", "\\\\", r"\e \h \c ::", "####", "</turn></turn>\n", "a: b\n### user: c", "line\n\nline ", "ünï 😀 " * 9, "w " * 200, "###\\", "\\###"]


@pytest.fixture(scope="module")
def talks(spark):
    chooser = random.Random(11)
    talks = {i: [(chooser.choice(["user", "assistant"]) if k or i % 3 else "system", chooser.choice(SAID)) for k in range(1 + i % 9)] for i in range(40)}
    talks[100] = [("system", "be kind")] + [("user" if k % 2 else "assistant", chooser.choice(SAID)) for k in range(700)]
    talks[None] = [("user", "q"), ("assistant", "w " * 5000), ("system", "late"), (None, None), ("a: b###", "x")]
    talks[101] = [("system", "s " * 900), ("assistant", "y")]
    rows = [(c, k, role, text, "x", 3) for c, ts in talks.items() for k, (role, text) in enumerate(ts)]
    chooser.shuffle(rows)
    return talks, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string, tokens int").repartition(5)


@pytest.mark.parametrize("budget, history_turns, history_tokens", [(2048, 2, 512), (60, 3, 20), (10, 0, 0), (300, 2, 290)])
def test_windows(talks, budget, history_turns, history_tokens):
    told, df = talks
    made = chat_windows.windows(df, budget, history_turns, history_tokens)
    rows = made.select("conv_id", "window", "tokens", "turns", "repeated", "text", chat_windows.read_turns(F.col("text")).alias("all"), chat_windows.read_targets(F.col("text"), F.col("loss")).alias("targets")).collect()
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.window):
        by[r.conv_id].append(r)
    assert by.keys() == told.keys()
    for c, ts in told.items():
        count = [max(1, len(re.findall(r"[^\W\d_]+|\d|[^\w\s]|_", text or "")) + 4) for _, text in ts]
        turns = [(role or "", text or "", n) for (role, text), n in zip(ts, count, strict=True)]
        want = plain_windows(turns, budget, history_turns, history_tokens)
        assert [(r.repeated, [(x.role, x.text) for x in r["all"]]) for r in by[c]] == [(len(old), [turns[j][:2] for j in old + new]) for old, new in want]
        assert [t for r in by[c] for t in r.targets] == [text for role, text, _ in turns if role == "assistant"]
        for r, (old, new) in zip(by[c], want, strict=True):
            assert r.tokens == sum(turns[j][2] for j in old + new) and (r.tokens <= budget or len([j for j in new if j or turns[0][0] != "system"]) <= 1)


def test_digests(talks):
    told, df = talks
    made = chat_windows.windows(df, 100, 2, 30)
    chars = {r.conv_id: r.n for r in made.groupBy("conv_id").agg(F.sum(F.char_length("text")).alias("n")).collect()}
    got = {r.conv_id: tuple(r)[1:] for r in chat_windows.digests(made).collect()}
    for c, ts in told.items():
        target = "".join(t or "" for role, t in ts if role == "assistant")
        assert got.pop(c) == (len(ts), sha("".join(f"{r or ''}\n{t or ''}\n" for r, t in ts)), len(target), sha(target), chars[c])
    assert got == {}


def test_marks_in_texts(spark):
    chooser = random.Random(2)
    said = [*SAID, *["".join(chooser.choice(["\\", "#", "##", "</turn>", "e", "h", "c", ":", "\n", "<", "/turn>"]) for _ in range(chooser.randrange(1, 12))) for _ in range(500)]]
    df = spark.createDataFrame([(t,) for t in said], "t string")
    for role in (False, True):
        rows = df.select("t", chat_windows.escaped(F.col("t"), role).alias("e")).select("t", "e", chat_windows.unescaped(F.col("e")).alias("back")).collect()
        assert all(r.back == r.t and "</turn>" not in r.e and "###" not in r.e and not (role and ":" in r.e) for r in rows)


def test_repeated_turns_and_nothing(spark):
    rows = [(1, 0, "user", "a")] * 3 + [(1, 0, "user", "b"), (1, None, "assistant", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    r = chat_windows.digests(chat_windows.windows(df)).first()
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (5, 1, sha("c"))
    assert chat_windows.digests(chat_windows.windows(df.limit(0))).collect() == []


def test_a_long_conversation_is_many_tasks(spark):
    df = spark.range(20_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("some words here").alias("text"))
    parts = chat_windows.spans(df, 200, 50).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(parts) > 1


# 13: fill in the middle ------------------------------------------------------------------------------------------------------------


def fim(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = [int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    x, y, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(t in text for t in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}"
    return len(units), "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}"


TEXTS = [None, "", "\n", "a", "a\n", "a\n\nb", "\n\n\n", "one\r\ntwo\r\n", "has <P> in it\n", "x<S>", "<M>", "<P", "ends with <\n<", "P>\nS>", "😀\nünï\n" * 30, "line\n" * 20_000, "y" * 100_000, " a\u0085b\n"]


@pytest.mark.parametrize("rate, spm", [(100, 50), (30, 0), (0, 100)])
def test_fill_in_middle(spark, rate, spm):
    rows = [(i, t, "f", 1) for i, t in enumerate(TEXTS * 6)] + [(None, "a\nb\nc", "f", 1), (3, "a", "f", 1), (3, "a", "f", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Form string, `n` int").repartition(3)
    made = fill_in_middle.transformed(df, rate=rate, spm=spm)
    assert made.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = made.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == fim(r.doc_id, r.text, rate, spm)
        assert r.back == (r.text or "")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and not re.search("Python|Arrow", plan)  # that of the test's own repartition
    assert fill_in_middle.transformed(df.limit(0)).collect() == []


def test_sentinels_that_are_no_marks(spark):
    df = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    for bad in (("<P>", "<P>", "<M>"), ("", "a", "b"), ("ab", "ba", "c"), ("aa", "b", "c")):
        with pytest.raises(ValueError, match="sentinels"):
            fill_in_middle.transformed(df, sentinels=bad)
    made = fill_in_middle.transformed(df, sentinels=("[p]", "{s}", "(m)"))
    assert made.select(fill_in_middle.restored(F.col("output"), F.col("form"), ("[p]", "{s}", "(m)"))).first()[0] == "a\nb"
