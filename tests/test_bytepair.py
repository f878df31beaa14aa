"""Byte-pair merges against a public vocabulary's own encoder, and counters of a writing pass."""

import glob
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tracewright.functions import bytepair
from tracewright.plans import catalog
from tracewright.shared import write_counted

tiktoken = pytest.importorskip("tiktoken")
vocabulary = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.01"
FILES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]


def encoder(name):
    m = bytepair.merges(vocabulary.path(name))
    return m, tiktoken.Encoding("own", pat_str=vocabulary.PATTERN, mergeable_ranks=m.ranks, special_tokens={})


@pytest.mark.parametrize("name", FILES)
def test_ids_of_random_texts(name):
    m, known = encoder(name)
    chooser = random.Random(3)
    signs = "aabbc eE'st  \n\t.,!?-_0123456789äßéñ中文字\U0001f600́ıİ\x00<|endoftext|>"
    texts = ["", " ", "\n\n", "it's they'll I'D", "a" * 5000, "ab" * 3000, "aabb " * 500, "中" * 700, "😀" * 300]
    texts += ["".join(chooser.choice(signs) for _ in range(chooser.randint(1, 200))) for _ in range(2000)]
    for text in texts:
        want = known.encode_ordinary(text)
        assert m.ids(text) == want, text
        assert m.count(text) == len(want)
    for code in [*range(0x300), 0x1680, 0x180E, 0x2000, 0x200B, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]:  # what counts as white space
        text = f"a{chr(code) * 2} b{chr(code)}c {chr(code)}"
        assert m.ids(text) == known.encode_ordinary(text), hex(code)


def test_all_documents(spark):
    _, known = encoder(FILES[0])
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r.tokens for r in catalog.QUERIES["str_token_count_merges"](spark, SF).collect()}
    assert got == {i: len(known.encode_ordinary(t or "")) for i, t in texts.items()}


def test_bounded_memory_gives_the_same_counts():
    m, known = encoder(FILES[0])
    small = bytepair.Merges(m.ranks, known=3)
    text = " ".join(f"unusual{k}words{k % 7}" for k in range(200)) * 2
    assert small.count(text) == len(known.encode_ordinary(text))
    assert len(small.counts) <= 3 and len(small.older) <= 3


def test_table_without_a_byte_is_an_error():
    with pytest.raises(ValueError):
        bytepair.Merges({b"a": 0})


def test_ids_column(spark):
    path = vocabulary.path(FILES[0])
    df = spark.createDataFrame([(1, "the old road"), (2, None), (3, "")], "i int, t string")
    rows = {r.i: (r.ids, r.n) for r in df.select("i", bytepair.token_ids(F.col("t"), path, most=2).alias("ids"), bytepair.token_count(F.col("t"), path).alias("n")).collect()}
    m, known = encoder(FILES[0])
    assert rows == {1: (known.encode_ordinary("the old road")[:2], 3), 2: ([], 0), 3: ([], 0)}


def test_counters_of_the_writing_pass(spark):
    path = os.path.join(tempfile.mkdtemp(), "t")
    tracker = spark.sparkContext.statusTracker()
    df = spark.range(0, 1000, 1, 7).select("id", F.when(F.col("id") % 3 == 0, F.col("id")).alias("third"))
    spark.sparkContext.setJobGroup("counted", "one pass")
    try:
        table, seen = write_counted(df, path, {"rows": F.lit(True), "third": F.col("third").isNotNull(), "over": F.col("third") > 500})
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup("counted")) == 1
    assert seen == {"rows": 1000, "third": 334, "over": table.where("third > 500").count()}
    assert table.count() == 1000


def test_counters_after_a_shuffle_and_of_no_rows(spark):
    base = os.path.join(tempfile.mkdtemp(), "t")
    grouped = spark.range(100).groupBy((F.col("id") % 10).alias("k")).agg(F.sum("id").alias("s"))
    assert write_counted(grouped, base + "1", {"rows": F.lit(True), "large": F.col("s") > 460})[1] == {"rows": 10, "large": 8}
    table, seen = write_counted(spark.range(0).select("id"), base + "2", {"rows": F.lit(True)})
    assert seen == {"rows": 0} and table.count() == 0


class Twice:
    """Fails each task's first attempt after it has made rows."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self, frames):
        from pyspark import TaskContext

        for f in frames:
            yield f
        mark = os.path.join(self.folder, f"p{TaskContext.get().partitionId()}")
        if not glob.glob(mark):
            open(mark, "w").close()
            os._exit(1)


@pytest.mark.skipif(os.environ.get("SKIP_CLUSTER") == "1", reason="needs a cluster of local workers")
def test_tasks_tried_again_count_once():
    import subprocess
    import sys
    import textwrap

    folder = tempfile.mkdtemp()
    code = f"""
        from pyspark.sql import SparkSession, functions as F
        from tests.test_bytepair import Twice
        from tracewright.shared import write_counted
        spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
        df = spark.range(0, 1000, 1, 2).mapInPandas(Twice({folder!r}), "id long")
        print("SEEN", write_counted(df, {folder + "/t"!r}, {{"rows": F.lit(True)}})[1])
    """
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=here, env=os.environ | {"PYTHONPATH": here}, capture_output=True, text=True, timeout=300)
    assert "SEEN {'rows': 1000}" in out.stdout, out.stderr[-2000:]
    assert len(glob.glob(folder + "/p*")) == 2
