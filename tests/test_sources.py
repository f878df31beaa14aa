import random

import pytest
from pyspark.sql import functions as F

from tracewright.functions.models import CannedClient, HashedEmbedder
from tracewright.operators import paths
from tracewright.plans import pipelines
from tracewright.sources import files
from tracewright.streaming import resume

HEAD = 'Class,Method,Depth,Trace Instruction(s) ...,Java Code Representation,Code Merged,Access Control Level\n'


def write(folder, name, body):
    (folder / name).write_text(body, encoding="utf-8")


@pytest.fixture
def folder(tmp_path):
    write(tmp_path, "Lcom.a.B$C.csv", HEAD + '"""LB""",f(I)V,0,"t\n1",old,"void f(int i) {\n    a.b(""x"");\n}",NONE\nLB,f(I)V,2,t2,old2,"void f(int i) {\n    deep();\n}",NONE\n')
    write(tmp_path, "other svc.csv", HEAD + "LD,g(),1,t,o,\"void g() {\n    z();\n}\",SYS_OR_SIG\n")
    write(tmp_path, "broken.csv", "Class,Method\nLX,m\n")
    write(tmp_path, "empty.csv", HEAD)
    write(tmp_path, "notes.txt", "no table")
    return tmp_path


def test_csv_dir(spark, folder):
    rows = files.csv_dir(spark, str(folder)).orderBy("service_name", "depth").collect()
    assert [(r.service_name, r["class"], r.method, r.depth) for r in rows] == [("Lcom.a.B$C", "LB", "f(I)V", 0), ("Lcom.a.B$C", "LB", "f(I)V", 2), ("other svc", "LD", "g()", 1)]
    assert rows[0].trace == "t\n1" and rows[0].java_code == 'void f(int i) {\n    a.b("x");\n}'
    assert files.csv_dir(spark, str(folder), "Java Code Representation").where("java_code = 'old2'").count() == 1


def test_wide_and_unnamed_headers(spark, tmp_path):
    """A header of any number of cells, a row index without a name, names that repeat, a byte order mark."""
    wide = ",".join(f"x{i}" for i in range(60))
    write(tmp_path, "wide.csv", f"{wide}," + HEAD + ",".join("v" * 60) + ",LW,w(),1,t,o,c,NONE\n")
    write(tmp_path, "index.csv", "," + HEAD + "0,LI,i(),2,t,o,c,NORMAL\n1,LI,j(),3,t,o,c,NONE\n")
    write(tmp_path, "twice.csv", "\ufeff\"Class\",Note," + HEAD.replace("Class", "Note") + "LT,n,m,k(),4,t,o,\"c, d\",NONE\n")
    rows = files.csv_dir(spark, str(tmp_path)).collect()
    got = sorted((r.service_name, r["class"], r.method, r.depth, r.java_code, r["access control level"]) for r in rows)
    assert got == [("index", "LI", "i()", 2, "c", "NORMAL"), ("index", "LI", "j()", 3, "c", "NONE"), ("twice", "LT", "k()", 4, "c, d", "NONE"), ("wide", "LW", "w()", 1, "c", "NONE")]


def test_many_files_are_one_scan(spark, tmp_path, monkeypatch):
    """600 files of 40 headers, small ones in groups, each read once; blank lines and short rows."""
    columns = HEAD.strip().split(",")
    for i in range(600):
        names = columns[i % 7 :] + [f"extra{i % 40}"] + columns[: i % 7]
        cells = {"Class": f"L{i}", "Method": "m()", "Depth": str(i), "Code Merged": f'"c\n{i}"', "Access Control Level": "NONE"}
        write(tmp_path, f"svc {i}%.x.csv", ",".join(names) + "\n\n" + ",".join(cells.get(c, "") for c in names) + "\n" + ",".join(cells.get(c, "") for c in names).replace(f"L{i}", "second") + "\n")
    found = files.csv_dir(spark, str(tmp_path))
    assert found._jdf.queryExecution().executedPlan().toString().count("Scan") == 1 and found.rdd.getNumPartitions() < 10
    rows = found.collect()
    assert len(rows) == 1200 and {(r.service_name, r["class"], r.depth, r.java_code) for r in rows if r.seq == 0} == {(f"svc {i}%.x", f"L{i}", i, f"c\n{i}") for i in range(600)}
    assert files.csv_dir(spark, f"file:{tmp_path}").count() == 1200


def test_bad_depth_fails(spark, tmp_path):
    write(tmp_path, "a.csv", HEAD + "A,b,x,t,o,c,NONE\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cast"):
        files.csv_dir(spark, str(tmp_path)).collect()


def test_sectioned_text(spark, tmp_path):
    write(tmp_path, "a.txt", "EP: abc_Some_3\nControlFlow: [[AC]: check(2), [x]: a.b()]\nnoise\nControlFlow: [[x]: e.f()]\nEP: other_Some_1\nControlFlow: [[x]: g.h()]\n")
    got = files.sectioned_text(spark, str(tmp_path / "a.txt")).orderBy("seq").collect()
    assert [(r.EP, r.code) for r in got] == [("abc_Some_3", "[[AC]: check(2), [x]: a.b()]"), ("abc_Some_3", "[[x]: e.f()]"), ("other_Some_1", "[[x]: g.h()]")]
    java = {r.EP: (r.label, r.java_code) for r in pipelines.text_stage(spark, str(tmp_path / "a.txt")).collect()}
    assert java["other_Some_1"] == (0, "// API: other\n// Service: Some_1\n\npublic void other() {\n    g.h();\n}")
    assert java["abc_Some_3"][0] == 1


@pytest.mark.parametrize("split", [300, 1 << 20])
def test_sections_over_splits(spark, tmp_path, split):
    """Keys that many splits hold no line of, keys of the file before that must not come over, rows before any key, empty tags."""
    chooser, want = random.Random(split), []
    for name in ("a.txt", "b.txt", "c.txt"):
        key, lines = None, []
        for i in range(chooser.randrange(200, 400)):
            kind = chooser.random()
            if kind < 0.02 and i > 20:
                key = f"k{name[0]}{i}"
                lines.append(f"EP: {key}")
            elif kind < 0.03:
                lines.append(chooser.choice(["EP:", "ControlFlow", "  EP: no", ""]))
            elif kind < 0.6:
                lines.append(f"ControlFlow: r{name[0]}{i} ControlFlow: more")
                want.append((name, i, key, f"r{name[0]}{i}"))
            else:
                lines.append("noise " * chooser.randrange(3))
        write(tmp_path, name, chooser.choice(["\n", "\r\n"]).join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = files.sectioned_text(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    by = sorted((r.file.rsplit("/", 1)[1], r.seq, r.EP, r.code.strip()) for r in got)
    assert [(f, ep, code) for f, _, ep, code in by] == [(f, ep, code) for f, _, ep, code in sorted(want)]
    assert len({(f, seq) for f, seq, _, _ in by}) == len(by)


def test_merge_blocks(spark):
    rows = [("e", f"c{i}", 1, i) for i in range(6)] + [("e", "z", 0, 6)]
    df = spark.createDataFrame(rows, "EP string, code string, label int, seq long")
    got = sorted((r.code, r.label) for r in paths.merge_blocks(df).collect())
    assert got == [("c0<PATH_SEP>c1<PATH_SEP>c2<PATH_SEP>c3", 1), ("c4<PATH_SEP>c5", 1), ("z", 1)]


def test_resume_is_incremental(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.range(4).write.parquet(src)
    step = lambda b: b.withColumn("twice", F.col("id") * 2)
    resume.run_available(spark, src, spark.range(1).schema, step, out, state)
    spark.range(4, 6).write.mode("append").parquet(src)
    resume.run_available(spark, src, spark.range(1).schema, step, out, state)
    assert sorted(r.twice for r in spark.read.parquet(out).collect()) == [0, 2, 4, 6, 8, 10]


def test_both_stages(spark, folder, tmp_path):
    stage1 = pipelines.sinks_stage(spark, str(folder), CannedClient, "find sinks", str(tmp_path / "one"))
    assert stage1.count() == 2 and stage1.where("json_answer is not null").count() == 2
    out = pipelines.levels_stage(spark, stage1, HashedEmbedder, lambda: CannedClient("level"), "say level", str(tmp_path / "two"), threshold=0.1)
    assert out["result"].count() == 2
    assert out["result"].where("p2 is not null").count() == 2
    assert out["accuracy"].first()["rows"] == 2
