"""Exact top-k search over binary codes by incremental multi-index hashing (operator 1).

A code of 64 bits is cut into m segments, each indexed by its value. A query looks up segment values within radius 0, then 1, and so
on, one segment after the other. After segment j (from 0) at radius a, every code within m * a + j bits has been met, for else
each of the first j + 1 segments would differ in a + 1 bits at least and each other one in a. The search ends as soon as k
verified distances lie within that bound, so the kth one is proven.

Codes of vectors are their components' signs (1 above zero); vectors of over 64 components are first projected on 64 fixed random
directions. The index is built per shard (vector_units), each shard answers exactly, and the shards' answers are merged.

Defined results: null vectors, and those with null or non-finite components or none at all, take no part; ties go to the smaller
id; of several rows of one query id the one with the fewest components, then the least code, is the query, and each row is a candidate of the other
ids' queries; a query is never its own candidate, other rows with its id neither; fewer than k candidates give fewer rows; vectors are only
compared with those of the same number of components; an empty table gives no rows; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import cut, table
from tracewright.llm.vector_units import lanes_for, nearest, one_per_id, searched, shards_for, units

#: Code, id, mark and places in up to 8 segments of a row in a shard.
ROW_BYTES = 96


def valid(vector) -> object:
    """Whether an array column holds components, all of them finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~odd


def binary_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, dim and data: the 64-bit code as 8 bytes."""

    def coded(batches):
        directions: dict[int, np.ndarray] = {}
        for b in batches:
            ids, out, dims = b.column(0), [], []
            lists = b.column(1)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(lengths)])
            for i, d in enumerate(lengths.tolist()):
                v = flat[at[i] : at[i + 1]]
                if d > 64:
                    if d not in directions:
                        directions[d] = np.random.default_rng(d).standard_normal((d, 64))
                    v = (v[:, None] * directions[d]).sum(axis=0)
                bits = np.zeros(64, dtype=np.uint8)
                bits[: len(v)] = v > 0
                out.append(np.packbits(bits).tobytes())
                dims.append(d)
            yield pa.RecordBatch.from_arrays([ids, pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=["vec_id", "dim", "data"])

    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(valid(F.col("v")) & F.col("vec_id").isNotNull())
    return rows.mapInArrow(coded, "vec_id long, dim int, data binary")


class MultiIndex:
    """Codes of one shard, indexed by the values of their segments."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray):
        self.ids, self.codes = ids, codes
        self.m = 4 if len(codes) >= 1 << 13 else 8
        self.bits = 64 // self.m
        values = np.arange(1 << self.bits, dtype=np.int64)
        weight = np.bitwise_count(values)
        self.masks = [values[weight == a] for a in range(self.bits + 1)]
        self.segments = []
        for j in range(self.m):
            part = self.part(codes, j)
            order = np.argsort(part, kind="stable")
            self.segments.append((order, np.searchsorted(part[order], np.arange((1 << self.bits) + 1))))

    def part(self, codes, j: int):
        return ((codes >> np.uint64(j * self.bits)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def search(self, code: np.uint64, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest codes of other ids, nearest first."""
        met = self.ids == own
        left = len(met) - int(met.sum())
        wanted, near, found, distances = min(k, left), np.zeros(65, dtype=np.int64), [], []
        at = [int(self.part(code, j)) for j in range(self.m)]
        for a in range(self.bits + 1):
            for j, (order, offsets) in enumerate(self.segments):
                probes = at[j] ^ self.masks[a]
                begin, size = offsets[probes], offsets[probes + 1] - offsets[probes]
                total = int(size.sum())
                if total:
                    rows = order[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(total)]
                    rows = rows[~met[rows]]
                    met[rows] = True
                    d = np.bitwise_count(self.codes[rows] ^ code)
                    found.append(rows)
                    distances.append(d)
                    near += np.bincount(d, minlength=65)
                if near[: self.m * a + j + 1].sum() >= wanted:
                    if not wanted:
                        return self.ids[:0], np.zeros(0, dtype=np.int64)
                    rows, d = np.concatenate(found), np.concatenate(distances)
                    kept = np.lexsort((self.ids[rows], d))[:k]
                    return self.ids[rows[kept]], d[kept].astype(np.int64)
        raise AssertionError("all radii searched without an answer")


def top_k(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, distance: the k rows of least Hamming distance to each id for which is_query (a column over vec_id) holds."""
    codes = cut(binary_codes(vectors, id_col, vector_col))
    queries = cut(one_per_id(codes.where(is_query)))
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = shards_for(codes.count(), ROW_BYTES)
    kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("distance", pa.int64())])

    def answers(index, owners, data):
        found = [index.search(code, own, k) for own, code in zip(owners.tolist(), data[:, 0].astype(np.uint64), strict=True)]
        columns = np.repeat(owners, [len(ids) for ids, _ in found]), np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=kind)

    build = lambda ids, data: MultiIndex(ids, data[:, 0].astype(np.uint64))
    found = units(codes, queries, shards, lanes_for(queries.count(), shards, tasks)).mapInArrow(lambda batches: searched(batches, ">u8", build, answers), "query_id long, vec_id long, distance long")
    return nearest(found, k, [F.col("distance"), F.col("vec_id")]).select("query_id", "rank", "vec_id", "distance")


def op1_exact_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest sign codes of every 100th vector."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS bits FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), queries AS (
  SELECT vec_id, bits FROM v WHERE vec_id % 100 = 0
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY len(bits), bits) = 1
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(len(list_filter(list_zip(q.bits, c.bits), lambda z: z[1] <> z[2])) AS BIGINT) AS distance
  FROM queries q JOIN v c ON q.vec_id <> c.vec_id AND len(q.bits) = len(c.bits)
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank, vec_id, distance FROM pairs
)
SELECT * FROM ranked WHERE rank <= 10
"""
