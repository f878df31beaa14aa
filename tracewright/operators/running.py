"""Running values over an order: numbers, sums and last values, with no task that holds a whole table or group.

Rows are dealt to range partitions of the order, sorted there and written once, each with its partition's number and its place in it. All else
is derived from that one table: what a partition holds by itself, and what it takes over from those before it. (Deriving it from a plan with a range
exchange in two branches gives wrong results: each branch may sample bounds of its own.) Only the first group of a partition can have rows in an
earlier one, so at most one row a partition is carried over, whatever the number and size of groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.shared import written

PART, PLACE, START, TOTAL = "__part", "__place", "__start", "__total"
#: The bits of a monotonically increasing id that count rows within a partition.
ROWS = (1 << 33) - 1


def in_order(df: DataFrame, *order: str | Column) -> DataFrame:
    """df with __part and __place, numbers from 0: rows of a partition come before those of the next one, and by place within it. Rows that are
    equal in the order stay in one partition, in any order."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(ROWS))
    laid = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return written(laid.select("*", F.spark_partition_id().alias(PART), place.alias(PLACE)), "in-order")


def numbered(df: DataFrame, *order: str | Column, out: str = "__n", total: str | None = None) -> DataFrame:
    """df with consecutive numbers from 0 in this order, and if asked the number of all rows as a column."""
    rows = in_order(df, *order)
    everything = Window.orderBy(PART)  # a row a partition
    sizes = rows.groupBy(PART).agg(F.count("*").alias("__size"))
    before = F.coalesce(F.sum("__size").over(everything.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("__size").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    starts = sizes.select(PART, before.alias(START), whole.alias(TOTAL))
    number = (F.col(START) + F.col(PLACE)).cast("long").alias(out)
    return rows.join(F.broadcast(starts), PART).select(*[F.col(f"`{c}`") for c in df.columns], number, *([F.col(TOTAL).alias(total)] if total else []))


def places(df: DataFrame, key: str, *order: str | Column, out: str = "place") -> DataFrame:
    """df with each row's place, from 1, in this order among the rows of its key, which is not null. What is added to a row's place in its partition is known
    of a partition and key, so that the rows themselves are dealt out once."""
    rows = in_order(df, key, *order)
    held = rows.groupBy(PART, key).agg(F.min(PLACE).alias("__first"), F.count("*").alias("__rows"))
    before = Window.partitionBy(key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("__earlier", F.coalesce(F.sum("__rows").over(before), F.lit(0)))
    number = (F.col(PLACE) - F.col("__first") + F.col("__earlier") + 1).cast("long").alias(out)
    return rows.join(held, [PART, key]).select(*[F.col(f"`{c}`") for c in df.columns], number)


def running(df: DataFrame, keys: list[str], order: list[str | Column], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, firsts: dict[str, Column] | None = None) -> DataFrame:
    """df with running values of each row's group, a null key being a key: sums (long) over its rows up to and with this one in this order, the
    last values up to there that are not null, and the values, null or not, of the group's first row. Rows of a group that are equal in the order
    come in any order."""
    sums, lasts, firsts = sums or {}, lasts or {}, firsts or {}
    value = lambda name: f"__v_{name}"
    rows = in_order(df.select("*", *[c.cast("long").alias(value(n)) for n, c in sums.items()], *[c.alias(value(n)) for n, c in (lasts | firsts).items()]), *keys, *order)
    here = Window.partitionBy(PART, *keys).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    held = rows.groupBy(PART, *keys).agg(
        F.count("*").alias("__rows"),
        *[F.sum(value(n)).alias(value(n)) for n in sums],
        *[F.max_by(value(n), F.when(F.col(value(n)).isNotNull(), F.col(PLACE))).alias(value(n)) for n in lasts],
        *[F.min_by(value(n), PLACE).alias(value(n)) for n in firsts],
    )
    renamed = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    carried = held.select(F.col(PART).alias("__at"), *renamed, F.sum("__rows").over(before).alias("__earlier"), *[F.sum(value(n)).over(before).alias(f"__c_{n}") for n in sums], *[F.last(value(n), ignorenulls=True).over(before).alias(f"__c_{n}") for n in lasts], *[F.first(value(n)).over(before).alias(f"__c_{n}") for n in firsts])
    carried = carried.where(F.col("__earlier") > 0)
    met = F.col(PART) == F.col("__at")
    for i, k in enumerate(keys):
        met = met & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    local = [F.first(value(n)).over(here).alias(f"__l_{n}") for n in firsts] + [F.sum(value(n)).over(here).alias(f"__l_{n}") for n in sums] + [F.last(value(n), ignorenulls=True).over(here).alias(f"__l_{n}") for n in lasts]
    joined = rows.select("*", *local).join(F.broadcast(carried), met, "left")
    zero = F.lit(0).cast("long")
    made = [(F.coalesce(f"__l_{n}", zero) + F.coalesce(f"__c_{n}", zero)).alias(n) for n in sums] + [F.coalesce(f"__l_{n}", f"__c_{n}").alias(n) for n in lasts]
    made += [F.when(F.col("__earlier").isNull(), F.col(f"__l_{n}")).otherwise(F.col(f"__c_{n}")).alias(n) for n in firsts]
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *made)
