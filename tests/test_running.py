"""Running values over range partitions against windows, on tables large enough that range bounds are sampled."""

import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright.operators import relational
from tracewright.operators.running import in_order, numbered, running

N = 200_000


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """Several files, three columns, the keys spread over all of them."""
    path = str(tmp_path_factory.mktemp("large") / "t")
    k = (F.col("id") * 7919) % N
    spark.range(N).select(k.alias("k"), F.concat(F.lit("text of "), k.cast("string")).alias("text"), F.when(k % 10 < 7, "a").when(k % 10 < 9, "b").alias("label")).repartition(7).write.parquet(path)
    return spark.read.parquet(path)


def test_numbers_are_consecutive(spark, large):
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        got = numbered(large, "k", total="rows")
        assert got.columns == ["k", "text", "label", "__n", "rows"]
        assert got.where("__n <> k OR rows <> 200000").count() == 0 and got.count() == N
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_batches_and_parts_are_exact(large):
    sizes = Counter(r["count"] for r in relational.batches(large, "k", 150).groupBy("batch").count().collect())
    assert sizes == {150: N // 150, N % 150: 1}
    parts = relational.contiguous_parts(large, "k", 7).groupBy("part").agg(F.count("*").alias("n"), F.min("k").alias("a"), F.max("k").alias("b")).orderBy("part").collect()
    assert [r.n for r in parts] == [N // 7 + (i < N % 7) for i in range(7)]
    assert all(x.b + 1 == y.a for x, y in zip(parts, parts[1:], strict=False))


def test_split_shares_are_exact(large):
    got = {(r.label, r.split): r["count"] for r in relational.stratified_split(large, "label", "k").groupBy("label", "split").count().collect()}
    assert got == {("a", "train"): 112_000, ("a", "test"): 28_000, ("b", "train"): 32_000, ("b", "test"): 8_000, (None, "train"): 16_000, (None, "test"): 4_000}


def test_oversampling_numbers_the_minority_once(large):
    made = relational.oversample_merged(large.withColumn("y", (F.col("label").eqNullSafe("a")).cast("int")), "y", "text", "k")
    counts = {r.y: r["count"] for r in made.groupBy("y").count().collect()}
    assert counts == {0: 140_000, 1: 140_000}
    firsts = made.where(F.contains("text", F.lit("; "))).groupBy(F.substring_index("text", "; ", 1).alias("t")).count()
    # row i takes minority row i modulo their number: each is first once or twice
    assert {(r["count"], r["n"]) for r in firsts.groupBy("count").agg(F.count("*").alias("n")).collect()} == {(2, 20_000), (1, 40_000)}


@pytest.mark.parametrize("hot", [0.0, 0.6])
def test_running_equals_windows(spark, hot):
    chooser = random.Random(3)
    rows = [(None if chooser.random() < 0.1 else 0 if chooser.random() < hot else chooser.randrange(40), i, chooser.randrange(-5, 6), chooser.choice(["x", "y", None, None])) for i in range(5000)]
    chooser.shuffle(rows)
    df = spark.createDataFrame(rows, "g int, o long, v int, s string").repartition(5)
    w = Window.partitionBy("g").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.sum("v").over(w).alias("total"), F.count("*").over(w).alias("place"), F.last("s", ignorenulls=True).over(w).alias("held"), F.first("s").over(w).alias("opening"))
    got = running(df, ["g"], ["o"], {"total": F.col("v"), "place": F.lit(1)}, {"held": F.col("s")}, {"opening": F.col("s")})
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_a_hot_group_is_many_tasks(spark):
    df = spark.range(40_000).select(F.lit("one").alias("g"), F.col("id").alias("o"))
    parts = in_order(df, "g", "o").groupBy("__part").count().collect()
    assert len(parts) == 4 and max(r["count"] for r in parts) < 20_000
    last = running(df, ["g"], ["o"], {"n": F.lit(1)}).agg(F.max("n"), F.sum((F.col("n") != F.col("o") + 1).cast("int"))).first()
    assert tuple(last) == (40_000, 0)


def test_empty_and_single(spark):
    df = spark.createDataFrame([], "g string, o long, v long")
    assert numbered(df, "o").collect() == [] and running(df, ["g"], ["o"], {"x": F.col("v")}).collect() == []
    one = spark.createDataFrame([(None, None, None)], df.schema)
    assert [tuple(r) for r in running(one, ["g"], ["o"], {"x": F.col("v")}, {"y": F.col("v")}).collect()] == [(None, None, None, 0, None)]
