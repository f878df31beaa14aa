"""Approximate nearest neighbours by collision-counting hashing (operator 2).

Vectors are scaled to length 1 and projected on PROJECTIONS random directions; each direction's values form a sorted array. A query
opens a narrow window around its own value in every array and widens all windows together (virtual rehashing). A vector that lies in the
windows of at least SHARE of the directions is verified by its cosine in double precision. A vector at distance D lies in a
window of half-width w with probability erf(w / (D sqrt 2)); the search ends when a vector at the distance of the kth verified one
would be over the threshold with SURETY standard deviations to spare, or when the windows hold everything.

Arrays are built per shard (vector_units), so that all rows are indexed and no task grows with the data; each shard's k best are
merged by cosine. The directions follow from the number of components alone, so reruns agree.

Defined results: vectors that are null, zero (or so small that their squares are), or hold null or non-finite components take no part; of
several rows of one query id, the least by components in their byte order is the query, and each row is a candidate of the other ids' queries; a query is
never its own candidate, other rows with its id neither; ties go to the smaller id; fewer than k candidates give fewer rows; vectors are
only compared with those of the same number of components; an empty table gives no rows; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import cut, table
from tracewright.llm.multi_index import valid
from tracewright.llm.vector_units import lanes_for, nearest, one_per_id, searched, shards_for, units

PROJECTIONS = 128
SHARE = 0.75
SURETY = 1.3
#: Distance whose windows a search opens first, and the factor by which they widen.
FIRST, WIDEN = 0.2, 1.08
#: Steps of that size taken at once before k vectors are verified; from then on the search goes half the way to the width that would end it.
UNPROVEN = 3
WINDOWS_AT_ONCE = 256


def directions(dim: int, projections: int) -> np.ndarray:
    return np.random.default_rng(1000 + dim).standard_normal((dim, projections))


class CollisionIndex:
    """Sorted projections of one shard's vectors. verified: how many vectors all searches so far have verified."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int = PROJECTIONS, share: float = SHARE, surety: float = SURETY):
        self.ids, self.vectors, self.verified = ids, vectors, 0
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.m, self.threshold = projections, math.ceil(share * projections)
        self.directions = directions(vectors.shape[1], projections)
        self.factor = self._factor(surety)
        steps = math.ceil(math.log(2 / FIRST) / math.log(WIDEN))
        #: Half-widths of the windows, narrow to wide; the last ones hold everything.
        self.widths = [*(self.factor * FIRST * WIDEN**i for i in range(steps + 1)), math.inf]
        at = vectors @ self.directions
        at /= self.norms[:, None]
        self.order = np.empty((projections, len(ids)), dtype=np.int32)
        self.values = np.empty((projections, len(ids)))
        for i in range(projections):
            self.order[i] = np.argsort(at[:, i], kind="stable")
            self.values[i] = at[self.order[i], i]

    def _factor(self, surety: float) -> float:
        """Half-width of windows, as a multiple of a distance, that a vector at this distance passes the threshold of with the wanted surety."""
        low, high = 0.0, 8.0
        for _ in range(40):
            x = (low + high) / 2
            p = math.erf(x / math.sqrt(2))
            if self.m * p - surety * math.sqrt(self.m * p * (1 - p)) >= self.threshold:
                high = x
            else:
                low = x
        return high

    def search_all(self, vectors: np.ndarray, own: np.ndarray, k: int):
        """Ids and cosines of up to k nearest verified vectors of each query, nearest first; the windows of some queries are looked up together."""
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        at = (vectors @ self.directions) / norms[:, None]
        for begin in range(0, len(vectors), WINDOWS_AT_ONCE):
            some = at[begin : begin + WINDOWS_AT_ONCE]
            edges = np.empty((len(self.widths), 2, self.m, len(some)), dtype=np.int32)
            for j, width in enumerate(self.widths):
                for i in range(self.m):
                    edges[j, 0, i] = np.searchsorted(self.values[i], some[:, i] - width)
                    edges[j, 1, i] = np.searchsorted(self.values[i], some[:, i] + width, side="right")
            for q in range(len(some)):
                yield self._search(vectors[begin + q], norms[begin + q], int(own[begin + q]), k, edges[:, :, :, q])

    def _search(self, vector: np.ndarray, norm: float, own: int, k: int, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        done = self.ids == own
        rows, scores = np.zeros(0, dtype=np.int64), np.zeros(0)
        counts = np.zeros(len(self.ids), dtype=np.int64)
        left, right, j, last = [], [], 0, len(self.widths) - 1
        while True:
            low, high = edges[j, 0].tolist(), edges[j, 1].tolist()
            if left:
                new = [o[x:y] for o, x, y in zip(self.order, low, left, strict=True)] + [o[x:y] for o, x, y in zip(self.order, right, high, strict=True)]
            else:
                new = [o[x:y] for o, x, y in zip(self.order, low, high, strict=True)]
            left, right = low, high
            counts += np.bincount(np.concatenate(new), minlength=len(counts))
            fresh = np.flatnonzero((counts >= self.threshold) & ~done)
            if len(fresh):
                done[fresh] = True
                self.verified += len(fresh)
                cosine = (self.vectors[fresh] * vector).sum(axis=1) / (self.norms[fresh] * norm)
                rows, scores = np.concatenate([rows, fresh]), np.concatenate([scores, cosine])
                kept = np.lexsort((self.ids[rows], -scores))[:k]
                rows, scores = rows[kept], scores[kept]
            if len(rows) < k:
                if j == last:
                    break
                j = min(j + UNPROVEN, last)
                continue
            enough = bisect.bisect_left(self.widths, self.factor * math.sqrt(max(0.0, 2 - 2 * scores[-1])))
            if j >= enough:
                break
            j += max(1, (enough - j) // 2)
        return self.ids[rows], scores


def vector_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, dim and data: the components as little-endian doubles, of the vectors that take part."""

    def raw(batches):
        for b in batches:
            lists = b.column(1)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), dtype="<f8")
            ends = (np.concatenate([[0], np.cumsum(lengths)]) * 8).tolist()
            view = flat.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lengths, pa.int32()), pa.array([view[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], names=["vec_id", "dim", "data"])

    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(valid(F.col("v")) & F.exists("v", lambda x: x * x > 0) & F.col("vec_id").isNotNull())
    return rows.mapInArrow(raw, "vec_id long, dim int, data binary")


def nearest_by_cosine(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: up to k near rows of each id for which is_query (a column over vec_id) holds, by cosine."""
    rows = cut(vector_rows(vectors, id_col, vector_col))
    queries = cut(one_per_id(rows.where(is_query)))
    size = rows.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = shards_for(size["n"], 8 * (size["dim"] or 1) + 12 * PROJECTIONS)
    kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def answers(index, owners, data):
        found = list(zip(owners.tolist(), index.search_all(data, owners, k), strict=True))
        columns = np.repeat(owners, [len(ids) for _, (ids, _) in found]), np.concatenate([f[0] for _, f in found]), np.concatenate([f[1] for _, f in found])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=kind)

    found = units(rows, queries, shards, lanes_for(queries.count(), shards, tasks)).mapInArrow(lambda batches: searched(batches, "<f8", CollisionIndex, answers), "query_id long, vec_id long, score double")
    return nearest(found, k, [F.col("score").desc(), F.col("vec_id")]).select("query_id", "rank", "vec_id", "score")


def op2_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors found of every 50th vector."""
    return nearest_by_cosine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
