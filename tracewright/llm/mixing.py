"""Mixing sources to target weights by subset-sum budget fitting (operator 10).

Documents are counted by (source, exact length). A source whose target is r times its size and a rest takes each document r
times and fits the rest as a subset sum: every length gives the same share of its documents, then a bounded-knapsack dynamic
program over the remaining lengths closes what is left. Within a length, documents are picked in the order of a seeded hash.

Defined results: null or blank text has size 0 and is never taken; a null source is a source of its own, last in order;
repeated rows are separate documents; rows of one length are taken in the order of a seeded hash of all their columns, then id, so that different rows of one id have an order, too; texts of any length count whole; an empty table
gives no rows; targets beyond 3 times a source's size are reshared; further columns, whatever their names, are carried by mixed.
Sizes at work: one row per (source, length) goes to the task that fits the source, one row per source to the one task that
computes targets. Copies in a hot (source, length) are dealt over buckets of about ROWS_PER_BUCKET rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.llm.common import cut, row_hash, table, word_count

ROWS_PER_BUCKET = 1024
#: Words that the dynamic program closes, beyond the longest document: memory and time of a fit grow with it.
DP_WORDS = 1 << 16


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """sizes: source, source_size. Adds weight and target: the shares of 100 % by weight, none above most times its source."""
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    w = sizes.withColumn("place", F.row_number().over(everything) - 1).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % n + 1).cast("int")).cast("long"))
    w = w.withColumn("ceiling", F.col("source_size") * most)
    fill = Window.orderBy(F.col("ceiling") / F.col("weight"), "place")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumn("rest", F.sum("source_size").over(whole) - F.coalesce(F.sum("ceiling").over(before), F.lit(0)))
    w = w.withColumn("rest_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    w = w.withColumn("level", F.col("rest") / F.col("rest_weight"))
    free = F.when(F.col("ceiling") >= F.col("level") * F.col("weight"), F.col("level"))
    w = w.withColumn("level", F.first(free, ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("ceiling").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("ceiling").cast("double")))
    return w.select("source", "source_size", "weight", target.alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, dp_words: int = DP_WORDS) -> np.ndarray:
    """How many documents of each length to take, at most counts, so that the words come as near to budget as found; below it if both sides are equally near."""
    lengths, counts = np.asarray(lengths, dtype=np.int64), np.asarray(counts, dtype=np.int64)
    take = np.zeros(len(lengths), dtype=np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return take
    if budget >= total:
        return np.where(lengths > 0, counts, 0)
    take = np.where(lengths > 0, (counts.astype(object) * budget // total).astype(np.int64), 0)
    rest = budget - int((take * lengths).sum())
    for k in np.argsort(-lengths, kind="stable"):
        if rest <= dp_words:
            break
        if lengths[k] > 0:
            more = min(int(counts[k] - take[k]), (rest - dp_words) // int(lengths[k]))
            take[k] += more
            rest -= more * int(lengths[k])
    limit = rest + min(int(lengths.max()), dp_words)
    items = []
    for k in np.argsort(lengths, kind="stable"):
        size, left, step = int(lengths[k]), int(counts[k] - take[k]), 1
        if size <= 0 or size > limit:
            continue
        left = min(left, limit // size)
        while left > 0:
            items.append((int(k), min(step, left)))
            left -= step
            step *= 2
    reached = np.zeros(limit + 1, dtype=bool)
    reached[0] = True
    by = np.full(limit + 1, -1, dtype=np.int32)
    for i, (k, m) in enumerate(items):
        jump = int(lengths[k]) * m
        if jump > limit:
            continue
        new = np.flatnonzero(reached[:-jump] & ~reached[jump:]) + jump
        reached[new] = True
        by[new] = i
        if reached[rest]:
            break
    found = np.flatnonzero(reached)
    at = int(found[np.argmin(np.abs(found - rest))])
    longer = [int(lengths[k]) for k in np.flatnonzero((lengths > limit) & (counts > take))]
    one = min(longer, default=None)
    if one is not None and abs(one - rest) < abs(at - rest):  # one document over the program's limit, the shortest, comes nearer than all under it
        take[int(np.flatnonzero(lengths == one)[0])] += 1
        return take
    while at > 0:
        k, m = items[by[at]]
        take[k] += m
        at -= int(lengths[k]) * m
    return take


def _fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
    size, goal = int(pdf["source_size"].iloc[0]), int(round(float(pdf["target"].iloc[0])))
    whole = goal // size if size else 0
    extra = fit(pdf["size"].to_numpy(), pdf["n"].to_numpy(), goal - whole * size)
    return pd.DataFrame({"source": pdf["source"], "size": pdf["size"], "whole": np.int64(whole), "extra": extra})


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", with_rows: bool = False) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target of its source, times it is taken (0 to most) and taken words; and, with_rows,
    row: a struct of all columns of docs, which then go through the one shuffle by (source, size)."""
    carried = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if with_rows else []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"), row_hash(docs, seed).alias("lot"), *carried)
    narrow = rows if with_rows else cut(rows)
    counts = cut(narrow.groupBy("source", "size").agg(F.count("*").alias("n")))
    largest = counts.agg(F.max("n")).first()[0] or 0
    buckets = 1 << max(0, (int(largest) // ROWS_PER_BUCKET).bit_length())
    aimed = targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most)
    aimed = cut(aimed.select("source", "source_size", "target"))
    per_length = counts.join(aimed.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    fits = per_length.groupBy("source").applyInPandas(_fit_source, "source string, size long, whole long, extra long")
    narrow = narrow.withColumn("bucket", F.pmod(F.col("lot"), F.lit(buckets)))
    if buckets == 1:
        shares = fits.withColumn("bucket", F.lit(0).cast("long"))
    else:
        dealt = narrow.groupBy("source", "size", "bucket").agg(F.count("*").alias("n_bucket"))
        f = fits.select(F.col("source").alias("f_source"), F.col("size").alias("f_size"), "whole", "extra")
        dealt = dealt.join(f, dealt["source"].eqNullSafe(f["f_source"]) & (dealt["size"] == f["f_size"]))
        before = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        ahead = F.coalesce(F.sum("n_bucket").over(before), F.lit(0))
        shares = dealt.select("source", "size", "bucket", "whole", F.least(F.greatest(F.col("extra") - ahead, F.lit(0)), F.col("n_bucket")).alias("extra"))
    shares = shares.join(aimed.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    shares = shares.select(F.col("source").alias("f_source"), F.col("size").alias("f_size"), F.col("bucket").alias("f_bucket"), "whole", "extra", "source_size", "target")
    joined = narrow.join(shares, narrow["source"].eqNullSafe(shares["f_source"]) & (narrow["size"] == shares["f_size"]) & (narrow["bucket"] == shares["f_bucket"]))
    place = F.row_number().over(Window.partitionBy("f_source", "f_size", "f_bucket").orderBy("lot", "doc_id"))
    times = F.when(F.col("size") > 0, F.col("whole") + (place <= F.col("extra")).cast("long")).otherwise(F.lit(0).cast("long"))
    out = joined.withColumn("times", times)
    return out.select("doc_id", "source", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"), *(["row"] if with_rows else []))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 17) -> DataFrame:
    """The mix itself: the rows of docs, all their columns, each as many times as it is taken."""
    times = mix(docs, weights, most, seed, with_rows=True).where("times > 0")
    return times.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select("row.*")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "times")
