"""Execution paths of an API: collecting, choosing and showing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.schemas import API_KEY


def collect_paths(rows: DataFrame, key: tuple[str, ...] = API_KEY) -> DataFrame:
    """One row per API with depths: its paths by depth, then by their order in the input (seq)."""
    ordered = F.array_sort(F.collect_list(F.struct("depth", "seq", "trace", "java_code")))
    paths = F.transform(ordered, lambda p: F.struct(p["depth"].alias("depth"), p["trace"].alias("trace"), p["java_code"].alias("java_code")))
    return rows.groupBy(*key).agg(paths.alias("depths"))


def _deepest_and_shallowest(rows: DataFrame, key: tuple[str, ...], depth: str, seq: str, n: int) -> DataFrame:
    """Of each key the rows that its n paths are chosen from, at most 2 n: __dr 1 to n are the first paths of the n deepest different depths,
    null are the n shallowest paths that are none of those.

    Each is a limit within the key, or an aggregate, that tasks apply before their rows are shuffled; so a key of very many rows is a few rows a task.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    firsts = rows.groupBy(*key, depth).agg(F.min(F.struct(F.col(seq).alias("s"), row.alias("row"))).alias("m")).select("m.row.*")
    firsts = firsts.withColumn("__dr", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(depth).desc()))).where(F.col("__dr") <= n)
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(depth, seq, row))
    shallow = rows.withColumn("__nth", nth).where(F.col("__nth") <= n).drop("__nth")
    shallow = shallow.withColumn("__first", F.row_number().over(Window.partitionBy(*key, depth).orderBy(seq, row)) == 1)
    both = firsts.withColumn("__first", F.lit(True)).unionByName(shallow.withColumn("__dr", F.lit(None).cast("int")))
    met = F.max(F.col("__dr").isNotNull()).over(Window.partitionBy(*key, depth))
    return both.withColumn("__met", met).where(F.col("__dr").isNotNull() | ~(F.col("__first") & F.col("__met"))).drop("__first", "__met")


def three_paths(rows: DataFrame, key: tuple[str, ...], depth: str = "depth", seq: str = "seq", n: int = 3) -> DataFrame:
    """At most n rows per key with place: the first path of each of the n deepest different depths; what is missing is filled with the
    shallowest paths left."""
    order = Window.partitionBy(*key).orderBy(F.col("__dr").asc_nulls_last(), depth, seq)
    few = _deepest_and_shallowest(rows, key, depth, seq, n)
    return few.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= n).drop("__dr")


def bounded_paths(rows: DataFrame, key: tuple[str, ...] = API_KEY, n: int = 3) -> DataFrame:
    """collect_paths with at most 2 n paths per API: those that three_paths_nested chooses from, and the first one. It chooses the same from them
    as from all, and no API's paths become one array."""
    return collect_paths(_deepest_and_shallowest(rows, key, "depth", "seq", n).drop("__dr"), key)


def three_paths_nested(depths: Column, n: int = 3) -> Column:
    """The same on the nested array of an API, whose paths lie by depth and input order; needs no shuffle."""
    levels = F.slice(F.reverse(F.array_sort(F.array_distinct(F.transform(depths, lambda p: p["depth"])))), 1, n)
    firsts = F.transform(levels, lambda d: F.array_position(F.transform(depths, lambda p: p["depth"]), d).cast("int"))
    others = F.filter(F.sequence(F.lit(1), F.size(depths)), lambda i: ~F.array_contains(firsts, i))
    return F.when(F.size(depths) > 0, F.transform(F.slice(F.concat(firsts, others), 1, n), lambda i: F.element_at(depths, i))).otherwise(depths)


def deepest_paths(depths: Column) -> Column:
    """All paths at the greatest depth."""
    top = F.array_max(F.transform(depths, lambda p: p["depth"]))
    return F.filter(depths, lambda p: p["depth"] == top)


def deepest_text(depths: Column, separator: str = "\n") -> Column:
    """The deepest paths, numbered, as one text."""
    return F.array_join(F.transform(deepest_paths(depths), lambda p, i: F.concat(F.lit("Path "), (i + 1).cast("string"), F.lit(":\n"), p["java_code"])), separator)


def merge_blocks(blocks: DataFrame, width: int = 4, separator: str = "<PATH_SEP>", key: str = "EP") -> DataFrame:
    """Blocks (EP, code, label, seq) merged: label 0 blocks stay alone, others are joined per key, label and bucket of width
    consecutive places in the key; then each row's label is the key's largest."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy("seq"))
    bucket = F.when(F.col("label") == 0, F.col("seq")).otherwise(F.floor((nth - 1) / width))
    merged = blocks.withColumn("group", bucket.cast("long")).groupBy(key, "label", "group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "code"))), lambda x: x["code"]), separator).alias("code"), F.min("seq").alias("seq"))
    return merged.withColumn("label", F.max("label").over(Window.partitionBy(key)))


def longest_per_key(df: DataFrame, key: str, text: str) -> DataFrame:
    """The row of the longest text per key; ties go to the smaller text."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.char_length(text).desc(), text))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")


def dynamic_label(level: Column) -> Column:
    """Check levels -1, 0 and 1 as 0, 2 and 3 as 1; others fail."""
    return F.when(level.isin(-1, 0, 1), 0).when(level.isin(2, 3), 1).otherwise(F.raise_error(F.concat(F.lit("no label for level "), level.cast("string"))).cast("int"))
