"""SimHash near-duplicates with pivot distance tables (operator 3).

Every distinct fingerprint gets a row of a pivot table: its Hamming distances to PIVOTS reference fingerprints. By the triangle
inequality two fingerprints within `bits` have no coordinate that differs by more than `bits`; pairs beyond that are discarded by
the table's maximum coordinate difference, and the survivors are verified on the fingerprints. A pivot table alone compares all
pairs, so it works inside blocks that hold every pair within `bits`: with m segments, two such fingerprints agree in at least
m - bits of them, and each choice of m - bits segments blocks by their value. m grows with the number of fingerprints, so that a
block stays small. Blocks of more than BLOCK_ROWS fingerprints are cut into chunks, and each pair of chunks is a task's unit.

Only spanning links leave a task. Components are found by alternating large-star and small-star steps on the links, with
a checkpoint a step; nothing is collected.

Defined results: null text is empty; a text without words has fingerprint 0, which links like any other; a bit that is set in just half of
the shingles is 0; texts of any length are read whole, in portions of 65,536 shingles; a null id is kept but is
never a component's id (null if the component has no other); repeated rows and ids share a component; of rows with equal ids and
fingerprints, keep_first keeps one by a hash of all its columns; an empty table gives no rows; further columns, whatever their names, are
kept by keep_first and fingerprints (fp is replaced) and ignored by near_duplicates.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import cut, portions, row_hash, table, without, written

PIVOTS = 32
BLOCK_ROWS = 4096
PAIRS_AT_ONCE = 1 << 21
EXPECTED_BLOCK = 1024
#: Most nodes whose links are looked up by a broadcast: those with over this part of all links.
HUBS = 1000


def fingerprint(text: str | None, words_per_shingle: int = 4) -> int:
    """64 bits: bit set if it is set in over half the XXH64 values (seed 42) of all word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, k = b" ".join(words), words_per_shingle
    if len(words) <= k:
        return xxhash.xxh64_intdigest(joined, 42)
    begins = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1, out=begins[1:])
    one, ones, shingles = xxhash.xxh64_digest, np.zeros(64, dtype=np.int64), len(words) - k + 1
    for at in range(0, shingles, 1 << 16):
        a, b = begins[at : min(at + (1 << 16), shingles)].tolist(), (begins[at + k : min(at + (1 << 16), shingles) + k] - 1).tolist()
        bits = np.unpackbits(np.frombuffer(b"".join([one(joined[x:y], 42) for x, y in zip(a, b, strict=True)]), dtype=np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > shingles).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str = "text", words_per_shingle: int = 4) -> DataFrame:
    """docs without text_col, with fp, in place of a column of that name: the fingerprint as a signed long."""
    docs = without(docs, "fp", keep=text_col)
    place, names = docs.columns.index(text_col), [c for c in docs.columns if c != text_col]

    def hashed(batches):
        for b in portions(batches, place):
            fps = np.array([fingerprint(t, words_per_shingle) for t in b.column(place).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != place), pa.array(fps)], names=[*names, "fp"])

    fields = [f for f in docs.schema.fields if f.name != text_col]
    return docs.mapInArrow(hashed, T.StructType([*fields, T.StructField("fp", T.LongType())]))


def references(n: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints: hashes of 0, 1, 2, ..."""
    return np.array([xxhash.xxh64_intdigest(str(i).encode(), 42) for i in range(n)], dtype=np.uint64)


def pivot_table(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distance of every fingerprint to every reference, one byte each."""
    return np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.uint8)


def segments_for(n: int, bits: int) -> int:
    """Segments that make the expected block of n fingerprints small."""
    m = bits + 1
    while m < bits + 8 and n / 2 ** (64 * (m - bits) / m) > EXPECTED_BLOCK:
        m += 1
    return m


def block_keys(fps: np.ndarray, segments: int, bits: int) -> np.ndarray:
    """One key per choice of segments - bits segments (columns): choice and the values of its segments."""
    edges = np.linspace(0, 64, segments + 1).round().astype(int)
    parts = [(fps >> np.uint64(a)) & np.uint64((1 << int(b - a)) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    out = []
    for i, chosen in enumerate(combinations(range(segments), segments - bits)):
        key = np.full(len(fps), i, dtype=np.uint64)
        for s in chosen:
            key = (key << np.uint64(edges[s + 1] - edges[s])) | parts[s]
        out.append(key)
    return np.stack(out, axis=1)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of the same components as the pairs a, b: every node to the smallest of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = label != np.arange(len(nodes))
    return nodes[out], nodes[label[out]]


def near_pairs(block: np.ndarray, chunk: np.ndarray, same_chunk: np.ndarray, fps: np.ndarray, tables: np.ndarray, bits: int):
    """Pairs within bits among rows of one block, in portions. Rows are ordered by block, then by the first coordinate; chunk: pairs of one
    chunk only count where same_chunk is set."""
    key = block.astype(np.int64) * 256 + tables[:, 0]
    order = np.argsort(key, kind="stable")
    key, chunk, same_chunk, fps, tables = key[order], chunk[order], same_chunk[order], fps[order], tables[order]
    block = block[order].astype(np.int64)
    ends = np.searchsorted(key, block * 256 + np.minimum(tables[:, 0].astype(np.int64) + bits, 255), side="right")
    after = ends - np.arange(len(key)) - 1
    total = np.concatenate([[0], np.cumsum(after)])
    begin = 0
    while begin < len(key):
        end = max(begin + 1, int(np.searchsorted(total, total[begin] + PAIRS_AT_ONCE, side="right")) - 1)
        i = np.repeat(np.arange(begin, end), after[begin:end])
        j = i + 1 + np.arange(len(i)) - (total[i] - total[begin])
        keep = (chunk[i] != chunk[j]) | same_chunk[i]
        i, j = i[keep], j[keep]
        for p in range(1, tables.shape[1]):
            keep = np.abs(tables[i, p].astype(np.int16) - tables[j, p]) <= bits
            i, j = i[keep], j[keep]
        keep = np.bitwise_count(fps[i] ^ fps[j]) <= bits
        if keep.any():
            yield fps[i[keep]], fps[j[keep]]
        begin = end


def links(distinct: DataFrame, bits: int = 4, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """distinct: fp, every one once. Returns a, b (a > b): links whose components are those of all pairs within bits."""
    m = segments_for(distinct.count(), bits)
    refs = references(pivots)

    def blocked(batches):
        for b in batches:
            fps = b.column(0).to_numpy().view(np.uint64)
            rows = pivot_table(fps, refs)
            keys = block_keys(fps, m, bits)
            raw = pa.py_buffer(np.repeat(rows, keys.shape[1], axis=0).tobytes())
            n = keys.size
            coordinates = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * pivots).tobytes()), raw])
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(fps.view(np.int64), keys.shape[1])), coordinates], names=["key", "fp", "coordinates"])

    spread = cut(distinct.mapInArrow(blocked, "key long, fp long, coordinates binary"))
    large = cut(spread.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block_rows).withColumn("chunks", F.ceil(F.col("n") / (block_rows // 2)).cast("int")))
    rows = looked_up(spread, large, "key", max(block_rows, spread.count() / HUBS))
    chunk = F.coalesce(F.pmod(F.xxhash64("fp", F.lit(3)), F.col("chunks")).cast("int"), F.lit(0))
    rows = rows.withColumn("chunk", chunk)
    alone = F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))
    paired = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct(F.least(k, F.col("chunk")).alias("x"), F.greatest(k, F.col("chunk")).alias("y")))
    rows = rows.withColumn("unit", F.explode(F.when(F.col("chunks").isNull(), alone).otherwise(paired))).select("key", F.col("unit.x").alias("x"), F.col("unit.y").alias("y"), "chunk", "fp", "coordinates")
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "key", "x", "y").sortWithinPartitions("key", "x", "y")

    def searched(batches):
        held = None
        for b in _with_end(batches):
            if b is not None:
                t = pa.Table.from_batches([b])
                held = t if held is None else pa.concat_tables([held, t])
            if held is None or (b is not None and held.num_rows < 1 << 15):
                continue
            held = held.combine_chunks()
            key, x, y = (held.column(i).to_numpy() for i in range(3))
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(key) else np.zeros(0, dtype=bool)
            begins = np.flatnonzero(new)
            done = len(key) if b is None else int(begins[-1]) if len(begins) else 0
            if done:
                part = held.slice(0, done)
                fps = part.column(4).to_numpy().view(np.uint64)
                tables = np.frombuffer(b"".join(part.column(5).to_pylist()), dtype=np.uint8).reshape(done, pivots)
                found = list(near_pairs(np.cumsum(new[:done]) - 1, part.column(3).to_numpy(), x[:done] == y[:done], fps, tables, bits))
                if found:
                    low, high = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
                    a, c = _forest(low, high)
                    a, c = a.view(np.int64), c.view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, c)), pa.array(np.minimum(a, c))], names=["a", "b"])
            held = held.slice(done)

    return dealt.mapInArrow(searched, "a long, b long").distinct()


def _with_end(batches):
    yield from batches
    yield None


def looked_up(rows: DataFrame, table: DataFrame, key: str, most: float) -> DataFrame:
    """rows with the values of table's row of their key, null where it has none. table: key, n (how many rows have it), values. The rows of a
    hot key, one of more than most rows, would all go to one task; so such keys, of which there are fewer than the rows by most, are
    broadcast, and their rows stay where they are."""
    values = [c for c in table.columns if c not in (key, "n")]
    hot = F.broadcast(table.where(F.col("n") > most).select(F.col(key).alias("hot"), *[F.col(c).alias(f"hot_{c}") for c in values]))
    marked = rows.join(hot, F.col(key) == F.col("hot"), "left")
    of_hot = marked.where(F.col("hot").isNotNull()).select(*rows.columns, *[F.col(f"hot_{c}").alias(c) for c in values])
    others = marked.where(F.col("hot").isNull()).select(*rows.columns)
    return others.join(table.where(F.col("n") <= most).drop("n"), key, "left").select(*rows.columns, *values).unionByName(of_hot)


def components(edges: DataFrame, hubs: int = HUBS) -> DataFrame:
    """edges: a, b (a > b). Returns node, root: every node on a link, with the smallest node of its component. Steps go on until nothing
    changes: their number grows with the logarithm of the links, not with the longest chain."""
    edges = cut(edges)
    size, seen = edges.count(), None
    while True:
        most = 2 * size / hubs
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n")).select("a", F.least("a", "low").alias("low"), "n")
        large = looked_up(both.where(F.col("b") > F.col("a")), least, "a", most).select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        large = cut(large)
        least = large.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n"))
        small = looked_up(large, least, "a", most).where(F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = cut(small.union(least.select("a", F.col("low").alias("b"))).where("a <> b").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        size, seen = state[0], state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def near_classes(ids: DataFrame, bits: int = 4) -> DataFrame:
    """ids: doc_id, fp. Returns one row per fingerprint: fp, root, component_id, kept_fp (the fingerprint of the class's first row) and n, its rows.

    A fingerprint without links is its own class. Of the others, those of a large class are dealt over salts, to which the class's one
    row is copied, so that no salt holds more than an even share of them."""
    distinct = cut(ids.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    roots = components(links(distinct.select("fp"), bits))
    joined = cut(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first_id", "root", F.col("n").alias("rows")))
    alone = joined.where(F.col("root").isNull()).select("fp", F.col("fp").alias("root"), F.col("first_id").alias("component_id"), F.col("fp").alias("kept_fp"), F.col("rows").alias("n"))
    linked = joined.where(F.col("root").isNotNull())
    order = F.struct(F.col("first_id").isNull().alias("none"), "first_id", "fp")
    first = cut(linked.groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("n")))
    size = first.agg(F.sum("n").alias("total"), F.max("n").alias("largest")).first()
    share = (size["total"] or 0) / int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = max(1, math.ceil((size["largest"] or 0) / max(1.0, share)))
    copied = first.select("root", F.col("first.first_id").alias("component_id"), F.col("first.fp").alias("kept_fp"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    dealt = linked.withColumn("salt", F.pmod(F.xxhash64(F.lit(7), "fp"), F.lit(salts)).cast("int"))
    return alone.unionByName(dealt.join(copied, ["root", "salt"]).select("fp", "root", "component_id", "kept_fp", F.col("rows").alias("n")))


def near_duplicates(docs: DataFrame, bits: int = 4, words_per_shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest id reachable over links)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ids = cut(fingerprints(rows, "text", words_per_shingle))
    classes = cut(near_classes(ids, bits).select("fp", "component_id", "n"))
    most = (classes.agg(F.sum("n")).first()[0] or 0) / HUBS
    return looked_up(ids, classes, "fp", most).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, bits: int = 4, words_per_shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all their columns, without those that a near-duplicate with a smaller id, or another row of the same id and
    fingerprint, stands for.

    The rows are written once with their fingerprints and a place; what stays is found on the narrow columns, with at most one place per task of
    an id and fingerprint, and the texts go through one exchange, by place, so that no group of copies meets in a task."""
    key = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), row_hash(docs, 17).alias("hash")]
    hashed = fingerprints(docs.select(*key, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), "text", words_per_shingle)
    rows = written(hashed.withColumn("place", F.monotonically_increasing_id()), "fingerprints")
    ids = rows.select("doc_id", "fp")
    c = near_classes(ids, bits).where(F.col("fp") == F.col("kept_fp")).select(F.col("fp").alias("class_fp"), "component_id")
    first = rows.groupBy("fp", "doc_id").agg(F.min(F.struct("hash", "place")).alias("first"))
    kept = first.join(c, (F.col("fp") == F.col("class_fp")) & F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("first.place").alias("place"))
    return rows.join(kept, "place", "left_semi").select("row.*")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
