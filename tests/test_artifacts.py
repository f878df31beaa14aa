"""The tree of artifact files: places, overloads, commit and abort."""

import pytest
from pyspark.sql import functions as F

from tracewright.sources import files, outputs


def tree(root):
    return {str(p.relative_to(root)): p.read_text() for p in sorted(root.rglob("*")) if p.is_file() and not p.name.startswith(".")}


def test_files_and_overloads(spark, tmp_path):
    rows = [("svc", "f(I)V", 1, "first", "a"), ("svc", "f(J)V", 2, "second", None), ("svc", "g()", 3, "é\nü", "c"), ("o ther$", "../f(", 4, "x", "d")]
    df = spark.createDataFrame(rows, "service_name string, method string, seq long, u string, r string").repartition(3)
    made = outputs.row_artifacts(df, {"user_message.txt": "u", "response.txt": "r"})
    outputs.write_artifacts(made, f"file:{tmp_path}/out")
    want = {
        "svc/f/user_message.txt": "second", "svc/f/response.txt": "", "svc/g/user_message.txt": "é\nü", "svc/g/response.txt": "c",
        "o ther$/-/f/user_message.txt": "x", "o ther$/-/f/response.txt": "d",
    }
    assert tree(tmp_path / "out") == want
    assert files.text_tree(spark, str(tmp_path / "out"), "response.txt").count() == 2  # Spark gives no row for an empty file
    more = spark.createDataFrame([("svc/g/response.txt", "new"), ("svc/h/response.txt", "h")], "path string, text string")
    outputs.write_artifacts(more, str(tmp_path / "out"))
    assert tree(tmp_path / "out") == want | {"svc/g/response.txt": "new", "svc/h/response.txt": "h"}
    outputs.write_artifacts(more, str(tmp_path / "out"), overwrite=True)
    assert tree(tmp_path / "out") == {"svc/g/response.txt": "new", "svc/h/response.txt": "h"}
    outputs.write_artifacts(more.limit(0), str(tmp_path / "none"))
    assert tree(tmp_path) == {"out/svc/g/response.txt": "new", "out/svc/h/response.txt": "h"}


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    bad = F.when(F.col("id") == 70, F.raise_error(F.lit("broken")).cast("string")).otherwise("t")
    df = spark.range(0, 100, 1, 4).select(F.concat(F.lit("s/m"), F.col("id").cast("string"), F.lit("/r.txt")).alias("path"), bad.alias("text"))
    outputs.write_artifacts(df.where("id < 10"), str(tmp_path))
    with pytest.raises(Exception, match="broken"):
        outputs.write_artifacts(df.where("id >= 10"), str(tmp_path))
    assert len(tree(tmp_path)) == 10 and not (tmp_path / "_attempts").exists()
    outputs.write_artifacts(df.where("id <> 70"), str(tmp_path))
    assert len(tree(tmp_path)) == 99
