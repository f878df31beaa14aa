"""Joins, filters, aggregates, sampling and splits of the analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.arrays import level_rank
from tracewright.operators.running import numbered, running
from tracewright.schemas import INVALID, LEVELS
from tracewright.shared import written


# filters ---------------------------------------------------------------------------------------------------------------------------


def not_equal_or_null(c: Column, value: str) -> Column:
    """True unless c is the value; null counts as different."""
    return ~c.eqNullSafe(F.lit(value))


def matches(c: Column, pattern: str) -> Column:
    """Whether a pattern occurs; null does not match."""
    return F.coalesce(c.rlike(pattern), F.lit(False))


def stricter(predicted: Column, actual: Column) -> Column:
    """Whether the predicted level is stricter; unknown levels are not."""
    return F.coalesce(level_rank(predicted) > level_rank(actual), F.lit(False))


# joins -----------------------------------------------------------------------------------------------------------------------------


def first_match(df: DataFrame, keys: DataFrame, key: str, order: str, value: str, out: str, default: str = "Unknown") -> DataFrame:
    """df with the value of the first row (by order) of keys that has the key; default where there is none."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    first = keys.withColumn("__p", place).where("__p = 1").select(F.col(key).alias("__k"), F.col(value).alias(out))
    return df.join(first, df[key] == first["__k"], "left").drop("__k").withColumn(out, F.coalesce(out, F.lit(default)))


def with_checkpoint(df: DataFrame, done: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """df's values where it has them, else those of the checkpoint row of the same key."""
    c = done.select(F.col(key).alias("__k"), *[F.col(x).alias(f"__{x}") for x in columns])
    joined = df.join(c, df[key] == c["__k"], "left")
    return joined.select(*[F.coalesce(df[x], F.col(f"__{x}")).alias(x) if x in columns else df[x] for x in df.columns])


def restore_processed(df: DataFrame, done: DataFrame, keys: list[str], columns: list[str], seq: str, answer: str) -> DataFrame:
    """df with the checkpoint's values: of several rows of a key the last by seq, and only rows with an answer."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(seq).desc()))
    last = done.where(F.col(answer).isNotNull()).withColumn("__p", place).where("__p = 1").select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = df.join(last, keys, "left")
    return joined.select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def in_both(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Key columns of matching rows; repeated keys multiply."""
    return a.select(*keys).join(b.select(*keys), keys, "inner")


def not_in(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b.select(*keys).distinct(), keys, "left_anti")


def only_in(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b.select(*keys).distinct(), keys, "left_semi")


def to_run(df: DataFrame, baseline: DataFrame, key: str, level: str) -> DataFrame:
    """df with to_run: not in the baseline, and not of the strictest level. A null key is in no list."""
    b = baseline.select(F.col(key).alias("__k")).distinct()
    joined = df.join(b, df[key] == b["__k"], "left")
    return joined.withColumn("to_run", F.when(F.col(level).eqNullSafe(F.lit(LEVELS[-1])), False).otherwise(F.col("__k").isNull())).drop("__k")


# aggregates ------------------------------------------------------------------------------------------------------------------------


def value_counts(df: DataFrame, column: str, out: str = "Count") -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias(out))


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """actual, predicted, Count and Percentage of the rows of that actual level."""
    counts = df.where(F.col(predicted).isNotNull()).groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("Count"))
    return counts.withColumn("Percentage", F.col("Count") / F.sum("Count").over(Window.partitionBy("actual")) * 100)


def accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """accuracy in percent over rows with a usable prediction (null if there is none) and their number."""
    valid = df.where(not_equal_or_null(F.col(predicted), INVALID))
    right = F.coalesce((F.col(actual) == F.col(predicted)).cast("int"), F.lit(0))
    return valid.agg((F.avg(right) * 100).alias("accuracy"), F.count("*").alias("rows"))


def classifier_metrics(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Measures of a 0/1 classifier in one pass: counts, accuracy, precision, recall, f1, and the area under the ROC curve of hard labels."""
    y, p = F.col(label), F.col(predicted)
    counted = df.agg(F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"), F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return counted.select("tp", "fp", "fn", "tn", div(tp + tn, tp + tn + fp + fn).alias("accuracy"), div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"), div(2 * tp, 2 * tp + fp + fn).alias("f1"), ((div(tp, tp + fn) + div(tn, tn + fp)) / 2).alias("roc_auc"))


def roc_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """The ROC curve of a score for 0/1 labels, a row per different score: tp and fp, the rows of either label with this score or a higher one, the
    rates tpr and fpr (null if there are no such labels), and area, what the curve's stretch up to this point adds to the area under it. Rows
    without a label or score count for nothing."""
    y, zero = F.col(label), F.lit(0.0)
    counts = written(df.where(y.isin(0, 1) & F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")), "scores")
    total = counts.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("pos"), F.coalesce(F.sum("neg"), F.lit(0)).alias("neg")).first()
    p, n = (F.lit(float(total[c])) for c in ("pos", "neg"))
    points = running(counts, [], [F.col("score").desc()], sums={"tp": F.col("pos"), "fp": F.col("neg")})
    area = F.when((p > zero) & (n > zero), F.col("neg").cast("double") / n * ((2 * F.col("tp") - F.col("pos")).cast("double") / (2 * p)))
    return points.select("score", "tp", "fp", F.try_divide(F.col("tp").cast("double"), p).alias("tpr"), F.try_divide(F.col("fp").cast("double"), n).alias("fpr"), area.alias("area"))


def on_grid(points: DataFrame, x: str, y: str, width: int, height: int) -> DataFrame:
    """Different places (px, py) of points between 0 and 1 on a grid; of a rising curve at most width + height + 1, however many points it has."""
    return points.select(F.floor(F.col(x) * width).alias("px"), F.floor(F.col(y) * height).alias("py")).where("px IS NOT NULL AND py IS NOT NULL").distinct()


def token_totals(df: DataFrame, *columns: str) -> DataFrame:
    """Sum and mean of token columns; rows that were not sent count as 0."""
    out = []
    for c in columns:
        v = F.coalesce(F.col(c), F.lit(0))
        out += [F.sum(v).cast("long").alias(f"{c}_total"), F.avg(v).alias(f"{c}_mean")]
    return df.agg(*out)


def funnel(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """How many rows pass each condition."""
    return df.agg(F.count("*").alias("rows"), *[F.count_if(c).alias(name) for name, c in steps.items()])


def speedup(runs: DataFrame, size: str = "size", seconds: str = "seconds", baseline: int = 1) -> DataFrame:
    """Per run: items a second, and how much faster an item was than in the run of the baseline size."""
    base = F.max(F.when(F.col(size) == baseline, F.col(seconds) / F.col(size))).over(Window.partitionBy(F.lit(0)))
    return runs.withColumn("throughput", F.col(size) / F.col(seconds)).withColumn("speedup", base / (F.col(seconds) / F.col(size)))


# sampling and splitting ------------------------------------------------------------------------------------------------------------


#: Labels up to which their sizes are broadcast; beyond, labels are many and their rows are joined by label.
LABELS_BROADCAST = 10_000


def stratified_split(df: DataFrame, label: str, key: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """df with split: per label the first share of rows in a seeded order are 'train', the others 'test'.

    Rows get their place in their label as a running count over range partitions, so that a label's rows are not one task's.
    """
    lot = F.xxhash64(F.lit(seed), F.col(key))
    ordered = running(df.withColumn("__lot", lot), [label], ["__lot", key], {"__n": F.lit(1)}).drop("__lot")
    sizes = df.groupBy(F.col(label).alias("__label")).agg(F.count("*").alias("__size"))
    sizes = F.broadcast(sizes) if sizes.count() <= LABELS_BROADCAST else sizes
    joined = ordered.join(sizes, ordered[label].eqNullSafe(sizes["__label"]))
    return joined.withColumn("split", F.when(F.col("__n") <= F.floor(F.col("__size") * share), "train").otherwise("test")).drop("__n", "__label", "__size")


def seeded_order(df: DataFrame, group: str, key: str, seed: int = 42) -> DataFrame:
    """df with place: a seeded order within each group."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)).cast("long"))


def oversample_merged(df: DataFrame, label: str, text: str, key: str, minority: int = 0, seed: int = 42) -> DataFrame:
    """df with rows added until the minority has as many as the rest: each joins two seeded minority rows' texts by a semicolon.

    Minority rows are numbered in a seeded order; new row i takes rows i and a hash of i, modulo their number, by two equi-joins.
    """
    spark = df.sparkSession
    sizes = df.agg(F.count_if(F.col(label) == minority).alias("few"), F.count_if(F.col(label) != minority).alias("many")).first()
    few, lack = sizes["few"], max(0, sizes["many"] - sizes["few"])
    if not few or not lack:
        return df.select(text, label)
    lot = F.struct(F.xxhash64(F.lit(seed), F.col(key)).alias("h"), F.col(key).alias("k"))
    ordered = numbered(df.where(F.col(label) == minority).select(F.col(text).alias("t"), lot.alias("lot")), "lot", out="n").select("t", "n")
    made = spark.range(lack).select((F.col("id") % few).alias("a"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(few)).alias("b"))
    one, two = ordered.toDF("ta", "a"), ordered.toDF("tb", "b")
    merged = made.join(one, "a").join(two, "b").select(F.concat("ta", F.lit("; "), "tb").alias(text), F.lit(minority).cast(df.schema[label].dataType).alias(label))
    return df.select(text, label).unionByName(merged)


def contiguous_parts(df: DataFrame, key: str, n: int) -> DataFrame:
    """df with part from 1: n contiguous parts by key, the first ones a row longer if the rows do not divide evenly; empty parts vanish."""
    i, total = F.col("__n"), F.col("__rows")
    small, longer = F.floor(total / n), total % n
    cut = longer * (small + 1)
    part = F.when(i < cut, F.floor(i / (small + 1))).otherwise(longer + F.floor((i - cut) / F.greatest(small, F.lit(1))))
    return numbered(df, key, total="__rows").withColumn("part", (part + 1).cast("long")).drop("__n", "__rows")


def batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """df with batch from 0: consecutive rows by key, size to a batch."""
    return numbered(df, key).withColumn("batch", F.floor(F.col("__n") / size).cast("long")).drop("__n")
