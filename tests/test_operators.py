import random
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright.functions import arrays, models, text
from tracewright.operators import paths, relational, similarity


def choose_three(depths):
    """depths: (depth, seq) of a key, in input order. Restated plainly."""
    ordered = sorted(depths, key=lambda x: x[0])
    picked = []
    for d in sorted({d for d, _ in ordered}, reverse=True)[:3]:
        picked.append(next(x for x in ordered if x[0] == d))
    for x in ordered:
        if len(picked) < 3 and x not in picked:
            picked.append(x)
    return picked[:3]


def test_three_paths(spark):
    chooser = random.Random(4)
    rows = [(k, chooser.randrange(4), i, "t", f"c{i}") for k in range(60) for i in range(chooser.randrange(1, 7))]
    df = spark.createDataFrame(rows, "k long, depth int, seq long, trace string, java_code string")
    want = {k: [s for _, s in choose_three([(d, s) for kk, d, s, _, _ in rows if kk == k])] for k in range(60)}
    got = {}
    for r in paths.three_paths(df, ("k",)).orderBy("k", "place").collect():
        got.setdefault(r.k, []).append(r.seq)
    assert got == want
    nested = paths.collect_paths(df, ("k",)).select("k", paths.three_paths_nested(F.col("depths")).alias("p"))
    assert {r.k: [int(p.java_code[1:]) for p in r.p] for r in nested.collect()} == want


def test_three_paths_of_a_hot_key(spark):
    """One key of very many rows, ties and rows that are equal in all columns; null keys and depths."""
    chooser = random.Random(6)
    rows = [("hot" if i % 3 else None if i % 5 == 0 else f"k{i % 40}", None if i % 97 == 0 else chooser.randrange(1 + i % 6), i // 2, "t", f"c{i // 2}") for i in range(20_000)]
    df = spark.createDataFrame(rows, "k string, depth int, seq long, trace string, java_code string").repartition(8)
    w = Window.partitionBy("k")
    nth, by_depth = F.row_number().over(Window.partitionBy("k", "depth").orderBy("seq")), F.dense_rank().over(w.orderBy(F.col("depth").desc()))
    ranked = df.withColumn("nth", nth).withColumn("dr", by_depth)
    chosen = (F.col("nth") == 1) & (F.col("dr") <= 3)
    order = w.orderBy(F.when(chosen, 0).otherwise(1), F.when(chosen, F.col("dr")).otherwise(F.col("depth")), "seq")
    want = ranked.withColumn("place", F.row_number().over(order).cast("long")).where("place <= 3").drop("nth", "dr")
    found = paths.three_paths(df, ("k",))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    few = paths._deepest_and_shallowest(df, ("k",), "depth", "seq", 3)
    assert few.groupBy("k").count().agg(F.max("count")).first()[0] <= 6
    nested = lambda f: sorted((tuple(r) for r in f(df.where("depth is not null"), ("k",)).select("k", paths.three_paths_nested(F.col("depths")).alias("p"), F.col("depths")[0]["java_code"]).collect()), key=repr)
    assert nested(paths.bounded_paths) == nested(paths.collect_paths)


def greedy(entries, n):
    taken, codes, ids = [], set(), []
    for e in entries:
        if e[2] in codes:
            continue
        if e[1] not in ids:
            if len(ids) >= n:
                break
            ids.append(e[1])
        codes.add(e[2])
        taken.append(e)
    return taken


@pytest.mark.parametrize("n", [1, 2, 4])
def test_diversified(spark, n):
    chooser = random.Random(n)
    rows = [(f"e{k}", f"o{chooser.randrange(7)}", f"c{chooser.randrange(9)}", i, chooser.randrange(5) / 4) for k in range(30) for i in range(chooser.randrange(0, 25))]
    df = spark.createDataFrame(rows, "ep1 string, ep2_id string, ep2_code string, ep1_sink_idx long, similarity double").withColumn("ep2_sink_idx", F.lit(0))
    got = {}
    for r in similarity.diversified(df, n).orderBy("ep1", "place").collect():
        got.setdefault(r.ep1, []).append(r.ep1_sink_idx)
    want = {}
    for k in {r[0] for r in rows}:
        entries = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[4], r[3]))
        want[k] = [r[3] for r in greedy(entries, n)]
    assert got == want


def test_cosine_pairs_in_blocks(spark):
    chooser = random.Random(1)
    rows = [(f"m{i % 7}", i, [chooser.gauss(0, 1) for _ in range(6)]) for i in range(90)] + [("zero", 99, [0.0] * 6), (None, 100, [1.0] * 6), ("none", 101, None)]
    df = spark.createDataFrame(rows, "method string, sink_idx long, embedding array<double>")
    key = lambda r: (r.ep1, r.ep1_sink_idx, r.ep2_id, r.ep2_sink_idx)
    want = sorted(map(key, similarity.cosine_pairs_native(df, 0.5).collect()))
    assert want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # units span batches, and batches units
    try:
        for block_bytes in (16 * 6 * 8, 1 << 20):
            found = similarity.cosine_pairs(df, 0.5, block_bytes=block_bytes)
            assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
            assert sorted(map(key, found.collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    own = similarity.cosine_pairs(df, 0.5, same_row_only=True).collect()
    assert {key(r) for r in own} >= set(want) and any(r.ep1 == r.ep2_id for r in own)
    assert similarity.cosine_pairs(df.limit(0), 0.5).collect() == []


def test_stratified_split_is_that_of_one_sort_per_label(spark):
    rows = [(i, "a" if i % 10 < 7 else "b" if i % 10 < 9 else None, i % 3) for i in range(500)] + [(7, "a", 9), (7, "a", 9), (1000, "lone", 0)]
    df = spark.createDataFrame(rows, "k long, label string, x int")
    w = Window.partitionBy("label")
    place = F.row_number().over(w.orderBy(F.xxhash64(F.lit(42), "k"), "k"))
    want = df.withColumn("split", F.when(place <= F.floor(F.count("*").over(w) * 0.8), "train").otherwise("test"))
    got = relational.stratified_split(df, "label", "k")
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert relational.stratified_split(df.limit(0), "label", "k").collect() == []


def test_text_functions(spark):
    df = spark.range(1)
    one = lambda c: df.select(c).first()[0]
    lit = F.lit
    assert one(text.check_level(lit("[[AC]: check(2), [x]: a.b(), [AC]: check(3)]"))) == 3
    assert one(text.check_level(lit("[[x]: a.b()]"))) == -1
    assert one(text.without_checks(lit("[[AC]: check(2), [x]: a.b(), [y]: c.d()]"))) == "[x]: a.b()<|>[y]: c.d()"
    assert one(text.pseudo_java(lit("m"), lit("S_1"), lit("[x]: a.b()<|>  <|>[y]: c;"))) == "// API: m\n// Service: S_1\n\npublic void m() {\n    a.b();\n    c;\n}"
    assert one(text.without_extension(lit("a.b.csv"))) == "a.b"
    values = ["it's", 'a "b"', "both ' and \"", "line\nend", "back\\slash", ""]
    assert one(text.python_repr(F.array(*map(lit, values)))) == repr(values)
    assert one(text.python_repr(F.array().cast("array<string>"))) == "[]"
    assert one(arrays.level_rank(lit("DANGEROUS"))) == 2 and one(arrays.level_rank(lit("other"))) is None
    with pytest.raises(Exception, match="no label"):
        df.select(paths.dynamic_label(lit(4))).collect()


def test_split_numbers_and_parts(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    for n, sizes in ((7, [2, 2, 2, 1, 1, 1, 1]), (3, [4, 3, 3]), (20, [1] * 10)):
        parts = relational.contiguous_parts(df, "k", n).orderBy("k").collect()
        assert [sum(r.part == p for r in parts) for p in sorted({r.part for r in parts})] == sizes
        assert [r.part for r in parts] == sorted(r.part for r in parts)
    assert [r.batch for r in relational.batches(df, "k", 4).orderBy("k").collect()] == [0] * 4 + [1] * 4 + [2] * 2


def test_restore_and_accuracy(spark):
    df = spark.createDataFrame([("a", "s", None), ("b", "s", "old")], "method string, service string, answer string")
    done = spark.createDataFrame([("a", "s", "one", 1), ("a", "s", "two", 2), ("a", "s", None, 3), ("b", "s", None, 1)], "method string, service string, answer string, seq int")
    assert {r.method: r.answer for r in relational.restore_processed(df, done, ["method", "service"], ["answer"], "seq", "answer").collect()} == {"a": "two", "b": "old"}
    none = spark.createDataFrame([("NONE", "invalid")], "actual string, predicted string")
    assert relational.accuracy(none, "actual", "predicted").first().accuracy is None


class Hanging:
    """A client that never answers and knows no limit."""

    def chat(self, system, user, timeout=None):
        while user == "hang":
            time.sleep(1)
        return f"said {user}"


def test_chat_keeps_its_own_limit(spark):
    df = spark.createDataFrame([("hang",), ("a",), ("b",), (None,)], "prompt string").coalesce(1)
    began = time.time()
    got = {r.prompt: r.res for r in models.chat(df, Hanging, "s", "prompt", "res", threads=2, timeout=0.5).collect()}
    assert got == {"hang": "invalid", "a": "said a", "b": "said b", None: None} and time.time() - began < 30
    with pytest.raises(ValueError, match="own"):
        models.within(5, lambda: (_ for _ in ()).throw(ValueError("own")))


class OnDevice:
    def __init__(self, device):
        self.device = device

    def generate(self, system, prompts):
        if "bad" in prompts:
            raise RuntimeError
        return [f"{self.device} {len(prompts)} {p}" for p in prompts]


def test_local_batches(spark):
    rows = [(f"p{i}",) for i in range(20)] + [(None,)]
    got = models.generate(spark.createDataFrame(rows, "prompt string"), OnDevice, ["d0", "d1"], "s", "prompt", "res", batch=4).collect()
    assert len(got) == 21 and {r.res for r in got if r.prompt is None} == {None}
    said = [r.res.split() for r in got if r.prompt]
    assert {d for d, _, _ in said} == {"d0", "d1"} and max(int(n) for _, n, _ in said) == 4 and all(p == r.prompt for (_, _, p), r in zip(said, [r for r in got if r.prompt], strict=True))
    failed = models.generate(spark.createDataFrame([("bad",)], "prompt string"), OnDevice, ["d0"], "s", "prompt", "res").collect()
    assert [r.res for r in failed] == ["invalid"]


def test_encode_ids(spark):
    df = spark.createDataFrame([("a" * 600,), ("",), (None,), ("xax",)], "t string")
    got = df.select(models.encode_ids(df.t, lambda: lambda s: [ord(c) for c in s], 512, frozenset([ord("x")])).alias("ids")).collect()
    assert [list(r.ids) for r in got] == [[97] * 512, [], [], [97]]


def test_chat_failures(spark):
    df = spark.createDataFrame([("p",), (None,)], "prompt string")
    slow = models.chat(df, lambda: models.CannedClient(delay=9.0), "s", "prompt", "res", timeout=0.01)
    assert sorted((r.prompt, r.res) for r in slow.collect() if r.prompt) == [("p", "invalid")]
    assert [r.res for r in slow.collect() if r.prompt is None] == [None]
    states = iter(["running", "running", "ended"])
    assert models.wait_for(lambda: next(states), sleep=lambda s: None) == "ended"


def test_roc_points(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.7), (0, 0.5), (1, 0.5), (0, 0.1), (None, 0.3), (1, None), (0, 0.05)]
    points = relational.roc_points(spark.createDataFrame(rows, "y int, s double"), "y", "s")
    got = [(r.score, r.tp, r.fp) for r in points.orderBy(F.desc("score")).collect()]
    assert got == [(0.9, 1, 1), (0.7, 2, 1), (0.5, 3, 2), (0.1, 3, 3), (0.05, 3, 4)]
    pairs = [(a, b) for y, a in rows if y == 1 and a is not None for z, b in rows if z == 0]
    auc = sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs)
    assert abs(points.agg(F.sum("area")).first()[0] - auc) < 1e-12
    grid = {(r.px, r.py) for r in relational.on_grid(points, "fpr", "tpr", 4, 3).collect()}
    assert grid == {(1, 1), (1, 2), (2, 3), (3, 3), (4, 3)}


@pytest.mark.parametrize("rows", [[], [(1, 0.5), (1, 0.2)], [(0, 0.5)]])
def test_roc_of_one_label_or_none(spark, rows):
    points = relational.roc_points(spark.createDataFrame(rows, "y int, s double"), "y", "s")
    assert points.count() == len(rows)
    assert points.agg(F.sum("area")).first()[0] is None
    assert relational.on_grid(points, "fpr", "tpr", 4, 3).count() == 0
