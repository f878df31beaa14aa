"""Empty tables, nulls, long and repeated texts, ties and clashing columns: defined results of every operator and stage."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracewright.llm import collision, html_text, language_id, mixing, multi_index, pieces, private_data, secrets, simhash, token_files, vector_units
from tracewright.llm.common import fresh_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, size int, `row` string, rejected string, place int, spans string"
EN, FR = "the house on the hill was old and the road to it was long", "la maison sur la colline est vieille et la route est longue pour nous"
WORD_BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def doc(i, text, lang="en", source="a"):
    return (i, text, lang, source, None if text is None else len(text), 1.0, 5, 3, "r", "x", 1, "s")


ROWS = [
    *[doc(i, f"{EN} {i} " * (i % 4 + 1)) for i in range(40)],
    *[doc(100 + i, f"{FR} {i} " * (i % 4 + 1), "fr", "b") for i in range(40)],
    doc(200, None, None, None), doc(201, ""), doc(202, "   \n\t "), doc(203, "12 34 !!"), doc(None, EN), doc(None, None), doc(204, "word " * 60_000, "en", None),
    doc(205, "x" * 200_000), doc(206, EN), doc(207, EN), doc(207, EN), doc(208, "\u0000 ▁ \U0001f600 ΣΑΣ ﬁ"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_simhash(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[200].fingerprint == by[201].fingerprint == by[202].fingerprint == "0" * 16
    assert by[202].component_id == 200 and by[207].component_id == by[206].component_id
    assert len([r for r in got if r.doc_id is None]) == 2
    assert simhash.near_duplicates(empty).collect() == []


def test_keep_first(docs, empty):
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    classes = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert sorted(ids, key=str) == sorted({c for _, c in classes}, key=str)
    assert 200 in ids and 201 not in ids and 207 not in ids
    assert simhash.keep_first(empty).collect() == []


def test_keep_first_of_many_rows_of_one_id(spark, monkeypatch):
    """Of a thousand rows of one id and text, some alike in all columns, one stays, the same one however they are dealt; texts are hashed once."""
    rows = spark.createDataFrame([(7, EN, i % 300) for i in range(1000)] + [(8, EN, 0), (9, FR, 0), (9, FR, 0)], "doc_id long, text string, place int")
    made, hashed = [], simhash.fingerprints
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: made.append(a) or hashed(*a))
    kept = [sorted(map(tuple, simhash.keep_first(rows.repartition(n)).collect())) for n in (1, 5)]
    assert kept[0] == kept[1] and len(made) == 2
    assert [r[:2] for r in kept[0]] == [(7, EN), (9, FR)]


@pytest.mark.parametrize("hubs", [1000, 1])
def test_fingerprints_of_a_hot_class(spark, monkeypatch, hubs):
    """A third of all rows in one class, and hot keys by broadcast or by shuffle, all the same."""
    monkeypatch.setattr(simhash, "HUBS", hubs)
    rows = [(i, EN if i % 3 == 0 else f"{EN} {i} {i + 7}" if i % 3 == 1 else f"{i} {FR} {i * i}") for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(df).collect()}
    want = {}
    for i in sorted(got):  # the smallest id reachable over links of at most 4 bits
        if i not in want:
            queue, want[i] = [i], i
            while queue:
                x = queue.pop()
                near = [j for j in got if j not in want and (got[x][0] ^ got[j][0]).bit_count() <= 4]
                want.update(dict.fromkeys(near, i))
                queue += near
    assert {i: c for i, (_, c) in got.items()} == want


def test_fingerprints_replace_fp(docs):
    rows = simhash.fingerprints(docs)
    assert [c for c in rows.columns if c == "fp"] == ["fp"] and rows.select("fp").distinct().count() > 3


def test_null_ids_alone(spark):
    rows = spark.createDataFrame([doc(None, "only this text is here"), doc(None, "only this text is here")], DOCS)
    assert [r.component_id for r in simhash.near_duplicates(rows).collect()] == [None, None]
    assert simhash.keep_first(rows).count() == 1


def test_language(docs, empty):
    models = language_id.fit(docs)
    got = {r.doc_id: r for r in language_id.identify(docs, models).collect()}
    assert [got[i].lang_pred for i in (200, 201, 202, 203)] == ["und"] * 4 and got[203].score == 0.0 and got[203].rejected
    assert language_id.Scorer(models).decide(["½ ²", "a ½"])[0] != ["und", "und"] and language_id.Scorer(models).decide(["½ ²"])[0] == ["und"]
    assert got[3].lang_pred == "en" and got[104].lang_pred == "fr" and not got[3].rejected
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = language_id.accepted(docs, models)
    assert kept.columns == docs.columns and {200, 201, 202, 203}.isdisjoint(r.doc_id for r in kept.collect())
    assert language_id.fit(empty) is None
    assert language_id.identify(empty, None).collect() == [] and language_id.accepted(empty, None).collect() == []
    assert [r.lang_pred for r in language_id.identify(docs.limit(1), None).collect()] == ["und"]


def test_secrets(docs, empty):
    got = {r.doc_id: r.spans for r in secrets.find_secrets(docs).collect()}
    assert all(not s for s in got.values())
    assert secrets.redact_secrets(docs).columns == docs.columns
    assert secrets.redact_secrets(docs).where("doc_id = 200").first().text is None
    assert secrets.find_secrets(empty).collect() == [] and secrets.redact_secrets(empty).collect() == []


def test_private(docs, empty):
    field = private_data.fit(docs)
    got = private_data.find_private(docs, field).collect()
    assert len(got) == len(ROWS) and all(not r.spans for r in got)
    assert private_data.find_private(empty, private_data.fit(empty)).collect() == []


def test_pieces(docs, empty):
    docs = docs.withColumn("decoded", F.lit(1)).withColumn("Segmentations", F.lit("x")).withColumn("n_best", F.lit(2))
    found = pieces.encode_digest(docs, PIECES)
    assert [c for c in found.columns if c in ("score", "n_best")] == ["score", "n_best"] and "row" in found.columns
    assert pieces.encode(docs, PIECES).columns.count("decoded") == 1
    got = found.select("doc_id", "n_pieces", "n_best", "round_trip", "score").collect()
    assert len(got) == len(ROWS) and all(r.round_trip for r in got)
    by = {r.doc_id: r for r in got}
    assert by[200].n_pieces == by[201].n_pieces == 0 and by[201].n_best == "0"
    assert pieces.encode(empty, PIECES).collect() == []
    full = pieces.encode(docs, PIECES).where("doc_id = 201").first()
    assert full.decoded == "" and len(full.segmentations) == 1 and list(full.segmentations[0].pieces) == []


def test_tokens(spark, docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD_BPE)
    path = fresh_path(spark, "tokens")
    token_files.write_tokens(docs, path, WORD_BPE)
    got = sorted(token_files.digest(token_files.read_tokens(spark, path)).collect(), key=lambda r: r.start)
    want = sorted(((r[0], r[1]) for r in ROWS), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    ids = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for _, t in want]
    assert [r.doc_id for r in got] == [i for i, _ in want]
    assert [r.n_tokens for r in got] == [len(x) for x in ids]
    assert [r.start for r in got] == np.cumsum([0, *[len(x) for x in ids]])[:-1].tolist()
    assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array(x, dtype="<u4").tobytes()) for x in ids]
    path = fresh_path(spark, "tokens")
    token_files.write_tokens(empty, path, WORD_BPE)
    assert token_files.digest(token_files.read_tokens(spark, path)).collect() == []


def test_mix(docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and all(0 <= r.times <= 3 and r.taken == r.times * r.size for r in got)
    assert {r.source for r in got} == {"a", "b", None}
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(docs).collect()), key=repr)
    rows = mixing.mixed(docs)
    assert rows.columns == docs.columns and rows.count() == sum(r.times for r in got)
    assert mixing.mix(empty).collect() == [] and mixing.mixed(empty).collect() == []


def test_mix_of_different_rows_of_one_id(spark):
    """Which of an id's rows of one size are taken follows from the rows alone; maps do no harm."""
    rows = spark.createDataFrame([(1, f"w{i} x", "a", {"i": i}) for i in range(40)] + [(i, "y " * 30, "b", None) for i in range(3)], "doc_id long, text string, source string, m map<string,int>")
    taken = [sorted(r.text for r in mixing.mixed(rows.repartition(n, "text"), weights=(1, 5)).collect()) for n in (1, 4)]
    assert taken[0] == taken[1] and 0 < sum(t.startswith("w") for t in taken[0]) < 40


def test_vectors(spark):
    rows = [(i, [float(i % 5), 1.0, -2.0]) for i in range(120)] + [(200, None), (300, [0.0, 0.0, 0.0]), (400, [float("nan"), 1.0, 1.0]), (500, [None, 1.0, 1.0]), (600, [float("inf"), 1.0, 1.0]), (700, []), (None, [1.0, 1.0, 1.0]), (800, [1.0, 2.0]), (0, [0.0, 1.0, -2.0]), (50, [-3.0, 3.0, 3.0]), (900, [1e-200, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x")).withColumn("score", F.lit(1)).withColumn("dim", F.lit(7)).withColumn("data", F.lit(7)).withColumn("shard", F.lit("s")).withColumn("asks", F.lit(1))
    none = df.limit(0)
    near = sorted(collision.nearest_by_cosine(df, F.col("vec_id") % 50 == 0).collect(), key=lambda r: (r.query_id, r["rank"]))
    assert [(r.query_id, r["rank"]) for r in near] == [(q, k) for q in (0, 50, 100) for k in range(1, 6)]
    by = {q: [r.vec_id for r in near if r.query_id == q] for q in (0, 50, 100)}
    assert by[0] == [5, 10, 15, 20, 25] and by[100] == [0, 0, 5, 10, 15]
    assert by[50] == [0, 0, 5, 10, 15]  # the first row of id 50 in byte order is the query
    assert all(r.score <= 1.0 + 1e-12 and r.vec_id != r.query_id for r in near)
    exact = sorted(multi_index.top_k(df, F.col("vec_id") % 50 == 0, 3).collect(), key=lambda r: (r.query_id, r["rank"]))
    assert [(r.query_id, r["rank"]) for r in exact] == [(q, k) for q in (0, 50, 100, 300, 900) for k in range(1, 4)]
    assert [r.vec_id for r in exact if r.query_id == 100] == [0, 0, 5] and [r.vec_id for r in exact if r.query_id == 0] == [5, 10, 15]
    assert collision.nearest_by_cosine(none, F.col("vec_id") % 50 == 0).collect() == [] and multi_index.top_k(none, F.col("vec_id") % 50 == 0).collect() == []


def test_repeated_ids_against_sql(spark, tmp_path):
    """The oracle's answer where ids repeat with other vectors and other sizes, and some vectors take no part."""
    duckdb = pytest.importorskip("duckdb")
    chooser = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in chooser.standard_normal(6 if i % 3 else 9)]) for i in chooser.integers(0, 900, 700)]
    rows += [(100 * k, [float(x) for x in chooser.standard_normal(6)]) for k in range(9)] * 2 + [(0, None), (100, []), (200, [float("nan")] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = multi_index.top_k(df, F.col("vec_id") % 100 == 0).collect()
    assert sorted(map(tuple, got)) == sorted(c.sql(multi_index.OP1_SQL).fetchall())


def test_many_shards_and_lanes(spark, monkeypatch):
    """Units that span Arrow batches, several to a task, give what one unit gives."""
    chooser = np.random.default_rng(5)
    rows = [(i, [float(x) for x in chooser.standard_normal(8 if i % 4 else 5)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    is_query = F.col("vec_id") % 10 == 0
    whole = [sorted(map(tuple, f(df, is_query, 4).collect())) for f in (multi_index.top_k, collision.nearest_by_cosine)]
    for module in (multi_index, collision):
        monkeypatch.setattr(module, "shards_for", lambda *a: 7)
        monkeypatch.setattr(module, "lanes_for", lambda *a: 3)
    monkeypatch.setattr(vector_units, "UNITS", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "6")
    try:
        parts = [f(df, is_query, 4) for f in (multi_index.top_k, collision.nearest_by_cosine)]
        assert all("Join" not in p._jdf.queryExecution().executedPlan().toString() for p in parts)
        parts = [sorted(map(tuple, p.collect())) for p in parts]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert parts[0] == whole[0]
    same = len({r[::2] for r in parts[1]} & {r[::2] for r in whole[1]}) / len(whole[1])
    assert len(parts[1]) == len(whole[1]) and same >= 0.9


def test_units_share_no_key(spark):
    rows = spark.range(300).select(F.col("id").alias("vec_id"), F.lit(2).alias("dim"), F.lit(b"x").alias("data"))
    found = vector_units.units(rows, rows.where("vec_id % 3 = 0"), 5, 4).groupBy("shard", "lane").agg(F.count_if(F.expr("asks = 0")).alias("rows"), F.count_if(F.expr("asks = 1")).alias("queries")).collect()
    assert len(found) == 20 and sum(r["rows"] for r in found) == 300 * 4 and sum(r["queries"] for r in found) == 100 * 5
    assert max(r["rows"] for r in found) < 100 and max(r["queries"] for r in found) < 50


def test_pages(spark):
    body = "<html><body><nav><a href='/a'>Home</a></nav><article><h1>Old &amp; new</h1><p>The road, it was said, was long.\n And old.</p></article><footer>&copy; us</footer></body></html>"
    rows = [(1, "u", body, 1), (1, "u", body, 1), (2, None, None, 2), (3, "u", "", 3), (None, "u", "<p>" + "long text, truly. " * 20_000, 4), (4, "u", "<div" * 500 + "<p>" * 500, 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int").withColumn("main_text", F.lit(7)).withColumn("N_MAIN_TEXT_CHARS", F.lit("x"))
    trees = html_text.fit(df)
    found = html_text.extract(df, trees)
    assert found.columns == ["page_id", "url", "text", "main_text", "n_main_text_chars"]
    got = found.collect()
    assert [r.main_text for r in got if r.page_id == 1] == ["Old & new\nThe road, it was said, was long. And old."] * 2
    assert [r.main_text for r in got if r.page_id in (2, 3)] == ["", ""] and all(r.n_main_text_chars == len(r.main_text) for r in got)
    assert len([r for r in got if r.page_id is None][0].main_text) > 100_000
    assert html_text.extract(df.limit(0), html_text.fit(df.limit(0))).collect() == []


def test_stages(spark, docs, empty):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language identification", "near-duplicates", "secrets", "mixing", "pieces"]
    for start in (docs, empty):
        rows = start
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, "")
            if name != "pieces":
                assert rows.columns == docs.columns
                path = fresh_path(spark, "stage")
                rows.write.parquet(path)
                rows = spark.read.parquet(path)
        assert (rows.count() > 0) == (start is docs)


def test_private_sample_is_the_first_by_hash(spark, monkeypatch):
    """Whatever the share of texts with a digit, and however few documents are looked at first."""
    taken = []
    monkeypatch.setattr(private_data, "train", lambda texts: taken.append(texts))
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 50 == 0, F.concat(F.lit("no "), "id")).otherwise(F.lit("none")).alias("text"))
    lot = F.pmod(F.xxhash64(F.lit("private sample"), F.col("doc_id")), F.lit(1 << 30))
    want = [r.text for r in df.where("doc_id % 50 = 0").orderBy(lot, F.col("doc_id").cast("string")).collect()]
    for sought in (1.5, 4, 16):
        monkeypatch.setattr(private_data, "SOUGHT", sought)
        private_data.fit(df, 20)
        private_data.fit(df, 100)
    assert taken == [want[:20], want] * 3
    private_data.fit(df.limit(0), 20)
    assert taken[-1] == []
