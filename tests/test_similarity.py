"""The pruned cosine join and the diversified choice against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.functions.models import CannedClient, HashedEmbedder
from tracewright.operators import similarity
from tracewright.plans import pipelines

SHAPE = "method string, sink_idx long, code string, embedding array<double>"


def clustered(n, clusters, dim, noise, seed=1):
    chooser = np.random.default_rng(seed)
    centres = chooser.normal(size=(clusters, dim))
    v = centres[chooser.integers(0, clusters, n)] + noise * chooser.normal(size=(n, dim))
    return [(f"m{int(chooser.integers(0, n // 3))}", i, f"c{int(chooser.integers(0, 9))}", x.tolist()) for i, x in enumerate(v)]


def pairs_of(rows, threshold, same_row_only=False):
    good = [r for r in rows if r[0] is not None and r[3] and all(map(math.isfinite, r[3]))]
    v = np.array([r[3] for r in good])
    v = v / np.maximum(np.sqrt((v * v).sum(axis=1)), 1e-12)[:, None]
    s = np.round(v @ v.T, 12)
    out = {}
    for x, y in zip(*np.nonzero(s > threshold), strict=True):
        a, b = good[x], good[y]
        if (a[0] != b[0] and not same_row_only) or (same_row_only and a[:2] != b[:2]):
            out[a[0], a[1], b[0], b[1]] = s[x, y]
    return out


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(similarity, "CELL_ROWS", 10)
    monkeypatch.setattr(similarity, "BIN_ROWS", 40)
    monkeypatch.setattr(similarity, "PRUNED_FROM", 100)
    monkeypatch.setattr(similarity, "PRODUCTS", 3000)


@pytest.mark.parametrize("threshold", [0.9, 0.5, 0.0, -0.2])
@pytest.mark.parametrize("block_rows", [7, 1000])
def test_pruned_join_finds_every_pair(spark, small_cells, threshold, block_rows):
    rows = clustered(400, 12, 6, 0.3) + [("zero", 900, "z", [0.0] * 6), ("same", 901, "z", [1.0] * 6), ("too", 902, "z", [2.0] * 6), (None, 903, "z", [1.0] * 6), ("none", 904, "z", None), ("nan", 905, "z", [math.nan] * 6), ("inf", 906, "z", [math.inf] + [1.0] * 5)]
    df = spark.createDataFrame(rows, SHAPE).repartition(3)
    for same_row_only in (False, True):
        got = [((r.ep1, r.ep1_sink_idx, r.ep2_id, r.ep2_sink_idx), r.similarity) for r in similarity.cosine_pairs(df, threshold, same_row_only=same_row_only, block_bytes=block_rows * 48).collect()]
        want = pairs_of(rows, threshold, same_row_only)
        assert len(got) == len(want) and dict(got).keys() == want.keys()
        assert all(abs(s - want[k]) < 1e-9 for k, s in got)


def test_units_that_hold_no_pair_are_left_out(spark, monkeypatch):
    for clusters, noise in ((40, 0.15), (20, 0.3)):  # fewer than cells; more clusters than cells can not be told apart
        near = spark.createDataFrame(clustered(20_000, clusters, 32, noise), SHAPE)
        made, every = similarity.join_work(near, 0.8)
        assert 0 < made < 0.3 * every
    alike = spark.createDataFrame(clustered(9000, 1, 32, 0.05), SHAPE)
    made, every = similarity.join_work(alike, 0.8)
    assert made >= every // 2  # all pairs are over the threshold


def greedy(entries, n):
    taken, codes, ids = [], set(), []
    for e in entries:
        if e["ep2_code"] in codes:
            continue
        if e["ep2_id"] not in ids:
            if len(ids) >= n:
                break
            ids.append(e["ep2_id"])
        codes.add(e["ep2_code"])
        taken.append(e)
    return taken


@pytest.mark.parametrize("cells, entries", [(40, 1 << 20), (10_000, 50)])
def test_best_pairs_give_the_same_choice(spark, monkeypatch, cells, entries):
    monkeypatch.setattr(similarity, "CELL_ROWS", cells)
    monkeypatch.setattr(similarity, "PRUNED_FROM", 100)
    monkeypatch.setattr(similarity, "BIN_ROWS", 90)
    monkeypatch.setattr(similarity, "PRODUCTS", 500)
    monkeypatch.setattr(similarity, "BEST_ENTRIES", entries)
    chooser = random.Random(8)
    kinds = [[chooser.gauss(0, 1) for _ in range(5)] for _ in range(25)]  # many equal vectors, so many ties
    rows = [(f"m{chooser.randrange(60)}", i, None if i % 17 == 0 else f"c{chooser.randrange(6)}", chooser.choice(kinds)) for i in range(500)]
    df = spark.createDataFrame(rows, SHAPE)
    code = {r[1]: r[2] for r in rows}
    every = [{"ep1": a, "i": i, "ep2_id": b, "j": j, "ep2_code": code[j], "s": s} for (a, i, b, j), s in pairs_of(rows, 0.3).items()]
    best = similarity.best_pairs(df, 0.3, block_bytes=60 * 40)
    firsts = {}
    for e in sorted(every, key=lambda e: (-e["s"], e["i"], e["ep2_id"], e["j"])):
        firsts.setdefault((e["ep1"], e["ep2_code"]), (e["i"], e["ep2_id"], e["j"]))
    got = {(r.ep1, r.ep2_code): (r.ep1_sink_idx, r.ep2_id, r.ep2_sink_idx) for r in similarity.first_per_code(best).collect()}
    assert got == firsts
    assert best.count() < len(every)
    for n in (1, 3):
        rows_of = {}
        for r in similarity.diversified(best, n).orderBy("ep1", "place").collect():
            rows_of.setdefault(r.ep1, []).append((r.place, r.ep1_sink_idx, r.ep2_id, r.ep2_sink_idx))
        want = {}
        for ep, es in itertools.groupby(sorted(every, key=lambda e: (e["ep1"], -e["s"], e["i"], e["ep2_id"], e["j"])), key=lambda e: e["ep1"]):
            want[ep] = [(k, e["i"], e["ep2_id"], e["j"]) for k, e in enumerate(greedy(es, n), 1)]
        assert rows_of == want


def test_nothing_to_choose_from(spark):
    df = spark.createDataFrame([], SHAPE)
    assert similarity.best_pairs(df, 0.5).collect() == [] and similarity.diversified(similarity.best_pairs(df, 0.5), 3).collect() == []


def test_a_unit_is_a_partition(spark, monkeypatch):
    monkeypatch.setattr(similarity, "PRUNED_FROM", 100)
    monkeypatch.setattr(similarity, "BIN_ROWS", 100)
    df = spark.createDataFrame(clustered(2000, 10, 8, 0.2), SHAPE)
    units = similarity._laid_out(df, 0.5, "method", "sink_idx", "embedding", None, 1 << 20, 100)
    by = units.groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("unit").alias("n")).collect()
    assert len(by) > 10 and {r.n for r in by} == {1}


def test_second_stage_without_a_table_of_pairs(spark, tmp_path):
    rows = [(f"s{i % 4}", "C", f"m{i}()", "NORMAL", [(0, "t", f"void m{i}() {{\n x;\n}}")], '{"Sinks": [["%s"]]}' % ("read " * (i % 5 + 1) + f"file{i % 3}")) for i in range(40)]
    api = spark.createDataFrame(rows, "service_name string, class string, method string, `access control level` string, depths array<struct<depth int, trace string, java_code string>>, json_answer string")
    out = [pipelines.levels_stage(spark, api, HashedEmbedder, lambda: CannedClient("level"), "s", str(tmp_path / str(keep)), threshold=0.6, keep_pairs=keep) for keep in (True, False)]
    columns = ["ep1", "ep1_sink_idx", "ep2_id", "ep2_sink_idx", "ep1_code", "ep2_code", "place"]
    first, second = (sorted(map(tuple, o["chosen"].select(columns).collect())) for o in out)
    assert first == second and first
    assert out[1]["pairs"] is None and sorted(r.p2 for r in out[0]["result"].collect()) == sorted(r.p2 for r in out[1]["result"].collect())


@pytest.mark.parametrize("groups, cells", [(150, 10_000), (150, 40), (4, 10_000), (900, 40)])
def test_copies_are_met_once(spark, monkeypatch, groups, cells):
    monkeypatch.setattr(similarity, "CELL_ROWS", cells)
    monkeypatch.setattr(similarity, "PRUNED_FROM", 100)
    chooser = random.Random(5)
    kinds = [[float(chooser.randrange(-3, 4)) for _ in range(4)] for _ in range(12)] + [[0.0] * 4]
    rows = [(f"m{chooser.randrange(groups)}", i, None if i % 11 == 0 else f"c{chooser.randrange(4)}", chooser.choice(kinds)) for i in range(900)]
    df = spark.createDataFrame(rows, SHAPE)
    met, in_units = [], similarity._in_units
    monkeypatch.setattr(similarity, "_in_units", lambda r, *a: met.append(r.count()) or in_units(r, *a))
    code = {r[1]: r[2] for r in rows}
    firsts = {}
    for (a, i, b, j), s in sorted(pairs_of(rows, 0.3).items(), key=lambda e: (-e[1], e[0][1], e[0][2], e[0][3])):
        firsts.setdefault((a, code[j]), (i, b, j, s))
    got = {(r.ep1, r.ep2_code): (r.ep1_sink_idx, r.ep2_id, r.ep2_sink_idx, r.similarity) for r in similarity.first_per_code(similarity.best_pairs(df, 0.3, digits=12)).collect()}
    assert got == firsts
    assert met and met[0] < 700 if groups > 4 else met  # 900 rows before


@pytest.mark.parametrize("k", [1, 2, 5])
def test_first_pairs_hold_the_first_of_each_entry_point(spark, monkeypatch, k):
    monkeypatch.setattr(similarity, "PRODUCTS", 500)
    monkeypatch.setattr(similarity, "PENDING", 20)
    chooser = random.Random(8)
    kinds = [[float(chooser.randrange(-3, 4)) for _ in range(5)] for _ in range(25)]
    rows = [(f"m{chooser.randrange(40)}", i, "c", chooser.choice(kinds)) for i in range(400)]
    every = pairs_of(rows, 0.3)
    firsts = {}
    for (a, i, b, j), _ in sorted(every.items(), key=lambda e: (-e[1], e[0][1], e[0][2], e[0][3])):
        if len(here := firsts.setdefault(a, [])) < k:
            here.append((i, b, j))
    few = similarity.first_pairs(spark.createDataFrame(rows, SHAPE), 0.3, k, block_bytes=60 * 40)
    assert few.count() < len(every) / 4
    got = {}
    for r in similarity.top_pairs(few, k).orderBy("ep1", "place").collect():
        got.setdefault(r.ep1, []).append((r.ep1_sink_idx, r.ep2_id, r.ep2_sink_idx))
    assert got == firsts


def test_similarities_that_are_nearly_the_same_are_told_apart(spark):
    rows = [("a", 0, "x", [1.0, 0.0]), ("b", 1, "y", [1.0, 0.5 + 2e-13]), ("c", 2, "z", [1.0, 0.5])]  # cosines 1e-13 apart, the second is larger
    df = spark.createDataFrame(rows, SHAPE)
    pairs = similarity.cosine_pairs(df, 0.3)
    for few in (pairs, similarity.first_pairs(df, 0.3, 2)):
        assert [r.ep2_id for r in similarity.top_pairs(few.where("ep1 = 'a'"), 2).orderBy("place").collect()] == ["c", "b"]
    assert similarity.best_neighbour(df.select("method"), pairs).where("ep = 'a'").first().ep2_id == "c"


def test_native_join_is_dealt_and_broadcasts_nothing(spark):
    rows = clustered(120, 6, 70, 0.5) + [("zero", 900, "z", [0.0] * 70), (None, 903, "z", [1.0] * 70), ("none", 904, "z", None), ("nan", 905, "z", [math.nan] * 70)]
    found = similarity.cosine_pairs_native(spark.createDataFrame(rows, SHAPE), 0.3)
    want = pairs_of(rows, 0.3)
    got = {(r.ep1, r.ep1_sink_idx, r.ep2_id, r.ep2_sink_idx): r.similarity for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(s - want[k]) < 1e-9 for k, s in got.items())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Broadcast" not in plan


def test_reports_put_no_entry_point_in_one_task(spark):
    from tracewright.sources import outputs

    eps = spark.createDataFrame([("a",), ("b",), ("none",), ("a",)], "method string")
    pair = "ep1 string, ep1_sink_idx long, ep2_id string, ep2_sink_idx long, similarity double, ep1_code string, ep2_code string"
    pairs = spark.createDataFrame([("a", 1, "b", 2, 0.5, "x\ny", None), ("b", 2, "a", 1, 0.5, "p", "q"), ("a", 3, "b", 2, 0.9, "r", "s"), ("other", 4, "a", 1, 0.6, "t", "u")], pair)
    report = outputs.all_pairs_report(eps, pairs)
    assert sorted(map(tuple, report.collect()), key=repr) == [("a", "b", "r", "s", 0.9), ("a", "b", "x y", "", 0.5), ("b", "a", "p", "q", 0.5), ("none", outputs.NONE_ALL, "", "", None)]
    places = sorted((r.EP1_ID, r.EP2_ID, r.EP2_Code, r.place) for r in outputs.top_report(eps, pairs).where("place IS NOT NULL").collect())
    assert places == [("a", "b", "", 2), ("a", "b", "s", 1), ("b", "a", "q", 1)]
    for df in (report, outputs.top_report(eps, pairs)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftOuter" not in plan and "Window" not in plan


PAIRS = "ep1 string, ep1_sink_idx long, ep2_id string, ep2_sink_idx long, similarity double, ep1_code string, ep2_code string"


def report_of(spark, path, more):
    shape = f"EP1_ID string, EP2_ID string, EP1_Code string, EP2_Code string, Similarity double{more}"
    return spark.read.options(header=True, quote='"', escape='"').schema(shape).csv(path).fillna("", ["EP1_Code", "EP2_Code"])


def test_all_pairs_are_written_once(spark, tmp_path, monkeypatch):
    from tracewright.sources import outputs

    eps = spark.createDataFrame([("a",), ("b",), ("none",), ("a",), (None,)], "method string")
    pairs = spark.createDataFrame([("a", 1, "b", 2, 0.5, 'x\ny, "z"', None), ("b", 2, "a", 1, 0.5, "p", "q"), ("a", 3, "b", 2, 0.9, "r", "s")], PAIRS)
    tables = []
    monkeypatch.setattr(outputs, "written", lambda df, name: tables.append(name))
    outputs.write_all_pairs_report(eps, pairs, str(tmp_path / "out"))
    got = sorted(map(tuple, report_of(spark, str(tmp_path / "out"), "").collect()), key=repr)
    none = outputs.NONE_ALL
    assert got == sorted([("a", "b", "r", "s", 0.9), ("a", "b", 'x y, "z"', "", 0.5), ("b", "a", "p", "q", 0.5), ("none", none, "", "", None), (None, none, "", "", None)], key=repr)
    assert not tables and all(f.name.endswith(".csv.gz") for f in (tmp_path / "out").glob("part-*"))


@pytest.mark.parametrize("portion", [1 << 24, 100])
def test_places_go_through_portions(spark, tmp_path, monkeypatch, portion):
    from tracewright import shared
    from tracewright.sources import outputs

    monkeypatch.setattr(outputs, "PORTION_ROWS", portion)
    monkeypatch.setattr(shared, "fresh_path", lambda _, name: str(tmp_path / "tables" / f"{name}-{random.getrandbits(128):032x}"))
    chooser = random.Random(3)
    name = lambda: chooser.choice("aaaaaabc")
    rows = [(e, i, o, j, chooser.randrange(5) / 7) for e, i, o, j in {(name(), chooser.randrange(30), name(), chooser.randrange(30)) for _ in range(900)}]
    eps = spark.createDataFrame([("a",), ("b",), ("c",), ("none",)], "method string")
    pairs = spark.createDataFrame(rows, "ep1 string, ep1_sink_idx long, ep2_id string, ep2_sink_idx long, similarity double").repartition(3)
    coded = lambda p: p.withColumn("ep1_code", F.lit("x")).withColumn("ep2_code", F.col("ep2_sink_idx").cast("string"))
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    assert (len(outputs._portions(pairs)) > 3) == (portion == 100)
    outputs.write_top_report(eps, pairs, str(tmp_path / "out"), coded)
    want = [("none", outputs.NONE_TOP, "", None)]
    for _, of in itertools.groupby(sorted(rows, key=lambda r: (r[0], -r[4], *r[1:4])), key=lambda r: r[0]):
        want += [(r[0], r[2], str(r[3]), k) for k, r in enumerate(of, 1)]
    got = [(r.EP1_ID, r.EP2_ID, r.EP2_Code, r.place) for r in report_of(spark, str(tmp_path / "out"), ", place long").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert not list((tmp_path / "tables").iterdir())  # neither pairs nor their order stay
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == before


@pytest.mark.parametrize("threshold", [0.9, 0.3, -0.2])
def test_native_join_bounds_by_compiled_products(spark, monkeypatch, threshold):
    monkeypatch.setattr(similarity, "COLUMNS", 7)  # what lies beyond is bounded by its length
    rows = clustered(90, 5, 9, 0.4) + [("tiny", 900, "z", [1e-13] * 9), ("same", 901, "z", [2.0] * 9), ("one", 902, "z", [0.0] * 8 + [5.0]), ("other", 903, "z", [1.0] * 8 + [9.0]), ("same", 904, "z", [-3.0] * 9)]
    found = similarity.cosine_pairs_native(spark.createDataFrame([*rows, ("short", 905, "z", [1.0] * 4)], SHAPE), threshold)
    want = {k: s for k, s in pairs_of([r for r in rows if r[0] != "tiny"], threshold).items()}
    got = {(r.ep1, r.ep1_sink_idx, r.ep2_id, r.ep2_sink_idx): r.similarity for r in found.collect() if "tiny" not in (r.ep1, r.ep2_id)}
    assert got.keys() == want.keys() and all(abs(s - want[k]) < 1e-9 for k, s in got.items())
    joins = [line for line in found._jdf.queryExecution().executedPlan().toString().split("\n") if "SortMergeJoin" in line]
    assert joins and not any("lambda" in line for line in joins)
