"""Shards and lanes for searches of a stated query set against all rows.

Rows are dealt by a hash of their id to shards of bounded bytes. A lane is a share of the queries, so that a few shards
still make many tasks: each shard goes once to every lane, each query once to every shard, and a unit of work is a shard and a lane, a
key of its own in the one shuffle. Within its task a unit's rows come first, then its queries, so that an index is built once a unit and
queries stream past it, however many there are. No pair of single rows is ever made.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of rows and of their index in a shard, and queries that make another lane worth a copy of the shard and of its index.
SHARD_BYTES = 64 << 20
QUERIES_PER_LANE = 128
#: More queries than this make another lane in any case, so that a unit's work is bounded, and what a lost executor costs.
MOST_PER_LANE = 1 << 14
UNITS = 10_000
QUERIES_AT_ONCE = 1024


def shards_for(n: int, row_bytes: int) -> int:
    """As few shards as SHARD_BYTES allows: a search of a large one ends sooner than those of its parts, for its kth best is nearer."""
    return max(1, math.ceil(n * row_bytes / SHARD_BYTES))


def lanes_for(queries: int, shards: int, tasks: int) -> int:
    """Lanes that bring the units up to the number of tasks wanted, as far as there are queries for them, and bound each lane."""
    wanted = min(math.ceil(tasks / shards), math.ceil(queries / QUERIES_PER_LANE))
    return max(1, wanted, math.ceil(queries / MOST_PER_LANE))


def one_per_id(rows: DataFrame) -> DataFrame:
    """rows: vec_id, dim, data. Of several rows of one id the least by dim, then data."""
    least = rows.groupBy("vec_id").agg(F.min(F.struct("dim", "data")).alias("r"))
    return least.select("vec_id", "r.dim", "r.data")


def units(rows: DataFrame, queries: DataFrame, shards: int, lanes: int) -> DataFrame:
    """rows, queries: vec_id, dim, data (binary, one length per dim). Returns dim, shard, lane, asks (0: a row, 1: a query), vec_id and data, all
    of a unit in one partition, in this order."""
    part = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    s = rows.withColumn("shard", part(11, shards)).withColumn("lane", every(lanes)).withColumn("asks", F.lit(0))
    q = queries.withColumn("lane", part(12, lanes)).withColumn("shard", every(shards)).withColumn("asks", F.lit(1))
    order = ["dim", "shard", "lane", "asks", "vec_id"]
    both = s.unionByName(q).select("dim", "shard", "lane", "asks", "vec_id", "data")
    return both.repartition(max(1, min(shards * lanes, UNITS)), "dim", "shard", "lane").sortWithinPartitions(*order, "data")


def searched(batches, dtype: str, build, search):
    """Run a task's units. build(ids, data): the index of a shard, data a matrix of dtype with a row a vector; search(index, ids, data):
    the answers to some queries, as an iterable of what the caller yields."""
    unit, ids, data, index, width = None, [], [], None, np.dtype(dtype).itemsize
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        dim, shard, lane, asks, vec_id = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        new = (dim[1:] != dim[:-1]) | (shard[1:] != shard[:-1]) | (lane[1:] != lane[:-1]) | (asks[1:] != asks[:-1])
        cuts = np.concatenate([[0], np.flatnonzero(new) + 1, [n]]).tolist()
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            own = (int(dim[begin]), int(shard[begin]), int(lane[begin]))
            if own != unit:
                unit, ids, data, index = own, [], [], None
            some = _matrix(b.column(5).slice(begin, end - begin), dtype, width)
            if not asks[begin]:
                ids.append(vec_id[begin:end].astype(np.int64))
                data.append(some)
                continue
            if not ids:
                continue
            if index is None:
                index = build(np.concatenate(ids), np.concatenate(data))
                ids, data = [ids[0][:0]], []
            for at in range(0, end - begin, QUERIES_AT_ONCE):
                yield from search(index, vec_id[begin + at : min(end, begin + at + QUERIES_AT_ONCE)].astype(np.int64), some[at : at + QUERIES_AT_ONCE])


def _matrix(cells: pa.Array, dtype: str, width: int) -> np.ndarray:
    raw = b"".join(cells.to_pylist())
    return np.frombuffer(raw, dtype=dtype).reshape(len(cells), len(raw) // len(cells) // width)


def nearest(found: DataFrame, k: int, order: list) -> DataFrame:
    """found: query_id and columns of a candidate, each shard's best ones. The k first by order, with rank from 1."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return found.withColumn("rank", place).where(F.col("rank") <= k)
