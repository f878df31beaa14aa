"""The second prompt: an entry point, its sinks and its similar neighbours as one text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.text import python_repr

#: Fixed texts of the prompt.
NOTHING = "No similar APIs found"
SINKS_LINE = "With these sensitive sinks (ordered by sensitivity, 0 = most sensitive):\n"
FOUND_LINE = "Similar APIs found (with sensitivity matching details):\n\n"


def sensitivity(i: Column, j: Column) -> Column:
    """How the places of two matched sinks relate."""
    one = lambda c: (c + 1).cast("string")
    return (
        F.when((i == 0) & (j == 0), F.lit("(Top-sensitive sinks matched)"))
        .when(i == 0, F.concat(F.lit("(Top-sensitive sink in source matched to position "), one(j), F.lit(" in target)")))
        .when(j == 0, F.concat(F.lit("(Position "), one(i), F.lit(" in source matched to top-sensitive sink in target)")))
        .otherwise(F.concat(F.lit("(Position "), one(i), F.lit(" in source matched to position "), one(j), F.lit(" in target)")))
    )


def neighbours_text(chosen: DataFrame, meta: DataFrame, custom: DataFrame | None = None) -> DataFrame:
    """ep1 and text: neighbours in the order they were chosen in, each with its class, level and matched sinks.

    chosen: rows of similarity.diversified with codes and place; meta: method, service_name, access control level, seq (the first row of
    a method counts); custom: methods that are marked as custom, all others as AOSP.
    """
    place = F.row_number().over(Window.partitionBy("method").orderBy("seq"))
    first = meta.withColumn("p", place).where("p = 1").select(F.col("method").alias("m"), F.col("service_name").alias("cls"), F.coalesce("access control level", F.lit("Unknown")).alias("acl"))
    rows = chosen.join(first, F.col("ep2_id") == F.col("m"), "left")
    mark = F.lit("")
    if custom is not None:
        listed = custom.select(F.col("method").alias("c")).distinct()
        rows = rows.join(listed, F.col("ep2_id") == F.col("c"), "left")
        mark = F.when(F.col("c").isNotNull(), " (custom API)").otherwise(" (AOSP API)")
    number = F.format_string("%.3f", F.col("similarity"))
    entry = F.concat(
        F.lit("  • Similarity: "), number, F.lit(" "), sensitivity(F.col("ep1_sink_idx"), F.col("ep2_sink_idx")),
        F.lit("\n  • Source sink (position "), F.col("ep1_sink_idx").cast("string"), F.lit("):\n"), F.col("ep1_code"),
        F.lit("\n  • Target sink (position "), F.col("ep2_sink_idx").cast("string"), F.lit("):\n"), F.col("ep2_code"), F.lit("\n\n"),
    )
    head = F.concat(F.lit("- "), F.col("ep2_id"), mark, F.lit(" (Class: "), F.coalesce("cls", F.lit("Unknown")), F.lit(", Access: "), F.coalesce("acl", F.lit("Unknown")), F.lit(")\n"))
    per_neighbour = rows.withColumn("entry", entry).withColumn("head", head).groupBy("ep1", "ep2_id").agg(F.min("place").alias("first"), F.first("head").alias("head"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "entry"))), lambda x: x["entry"]), "").alias("body"))
    return per_neighbour.groupBy("ep1").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", F.concat("head", "body").alias("t")))), lambda x: x["t"]), "").alias("text"))


def second_prompt(api: DataFrame, neighbours: DataFrame) -> DataFrame:
    """api (method, service_name, code, sink_code) with p2; entry points without neighbours say so."""
    joined = api.join(neighbours.select(F.col("ep1").alias("e"), F.col("text").alias("t")), F.col("method") == F.col("e"), "left").drop("e")
    head = F.concat(F.lit("The method "), "method", F.lit(" in class "), "service_name", F.lit(" has this code:\n\n"), "code", F.lit("\n" + SINKS_LINE), python_repr(F.col("sink_code")), F.lit("\n\n" + FOUND_LINE), "t")
    return joined.withColumn("p2", F.coalesce(head, F.lit(NOTHING))).drop("t")


def flat_prompt(chosen: DataFrame) -> DataFrame:
    """The older form: ep1 and text, one paragraph per neighbour."""
    line = F.concat(F.lit("Similar API: "), "ep2_id", F.lit("\nSimilarity: "), F.format_string("%.2f", F.col("similarity")), F.lit("\n"), "ep2_code")
    return chosen.groupBy("ep1").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))
