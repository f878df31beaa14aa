"""Similar snippets across entry points: thresholded cosine join, best neighbour and diversified top-N.

The join prunes by angles. Vectors are dealt to cells, each to its nearest centre; a cell's radius is the largest angle to its centre. By the triangle
inequality a vector whose angle to a cell's centre exceeds that cell's radius by more than the threshold's angle has no partner there. Neighbouring
cells make up a bin, and a vector is sent to the bins with a cell in which it may have a partner. Bins are small where that leaves most of them out,
and large where it does not. Of two bins one holds the vectors that the other's are sent to, so that no two vectors meet twice.

A bin is cut into blocks of bounded bytes, and what is sent to it into lanes; a unit of work is a block and a lane, with a number and a
partition of its own in the one shuffle. In its task the block's vectors come first, the lane's stream past them as Arrow batches and meet them in
matrix products. Only pairs above the threshold leave a unit, or of these the first of each entry point, for the diversified choice of each entry
point and code. No side is broadcast; what goes to tasks by value are the centres, at most CELLS.

Products find pairs only to NEAR; a pair's similarity is then the plain sum over its vectors' places in their order, in double precision, over the root
of the product of both sums of squares. It depends on nothing but the two vectors, so that copies tie, and others tie only where it is the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.arrays import dot
from tracewright.shared import written

BLOCK_BYTES = 32 << 20
#: Rows of a block that keeps the first pairs, and entries of its tables of what they have to reach.
BLOCK_ROWS, BEST_ENTRIES = 1 << 14, 2 << 20
#: Pairs that are held until those that are not among the first are dropped.
PENDING = 1 << 16
#: Rows of a code and vector, on average, from which copies are put together.
COPIES = 3
UNITS = 10_000
#: Cells: one for so many vectors, at most so many, found on a sample of so many vectors a cell; below so many vectors in all there is one.
CELL_ROWS, CELLS, SAMPLE_A_CELL, PRUNED_FROM = 256, 512, 8, 8192
#: Vectors of a bin where cells can be told apart: where fewer than half of all pairs lie in cells that may hold a partner.
BIN_ROWS = 2048
LANE_ROWS = 1 << 15
#: Vectors that meet a block at once.
MET_ROWS = 2048
#: Products at once.
PRODUCTS = 1 << 20
LIMIT = 1e-12
#: Components, at most, that whole numbers stand for where products are expressions. Two are digits of a number, each its steps and HALF. Products' digits
#: hold the sums of TOGETHER numbers' products, and a double holds three digits exactly; products of longs would ask about their range each time.
COLUMNS, HALF, TOGETHER, DIGIT_BITS = 512, 22, 32, 17
DIGIT = 1 << DIGIT_BITS
#: Angles are trusted to this many radians, products to NEAR. Vectors of models are alike to so many digits.
SLACK, NEAR, DIGITS = 1e-6, 1e-9, 12


def explode_sinks(api: DataFrame) -> DataFrame:
    """method, sink_idx, code and embedding: one row per sink that has a vector; lists of unequal length are cut to the shorter."""
    side = F.zip_with("sink_code", "embeddings", lambda c, e: F.struct(c.alias("code"), e.alias("embedding")))
    both = F.slice(side, F.lit(1), F.least(F.size("sink_code"), F.size("embeddings")))
    return api.where(F.size("embeddings") > 0).select("method", F.posexplode(both).alias("sink_idx", "z")).select("method", "sink_idx", F.col("z.code").alias("code"), F.col("z.embedding").alias("embedding"))


def _matrix(lists: pa.Array) -> np.ndarray:
    return np.asarray(lists.flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(len(lists), -1)


def _scaled(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.sqrt((v * v).sum(axis=1)), LIMIT)[:, None]


def _in_turn(products: np.ndarray) -> np.ndarray:
    """Sums of rows, added from left to right."""
    return np.cumsum(products, axis=1)[:, -1] if products.shape[1] else np.zeros(len(products))


def _centres(rows: DataFrame, n: int, cells: int) -> np.ndarray:
    """Centres of at most so many cells, on a sample that the driver can hold: seeded picks, each the likelier the farther it is from those
    before it, then a few rounds of means."""
    most = SAMPLE_A_CELL * cells
    sample = rows.where(F.pmod(F.xxhash64(F.lit(3), "g", "i"), F.lit(max(1, n // most))) == 0).limit(2 * most).select("v").toArrow().column(0).combine_chunks()
    if not len(sample):
        return np.zeros((0, 0))
    v, chooser = _matrix(sample), np.random.default_rng(3)
    norms = np.sqrt((v * v).sum(axis=1))
    v = v[np.isfinite(norms) & (norms > LIMIT)]
    v /= np.sqrt((v * v).sum(axis=1))[:, None]
    if not len(v):
        return np.zeros((0, 0))
    picked = [0]
    far = 1 - v @ v[0]
    while len(picked) < cells and far.max() > SLACK:
        weight = np.maximum(far, 0) ** 2
        picked.append(int(chooser.choice(len(v), p=weight / weight.sum())))
        far = np.minimum(far, 1 - v @ v[picked[-1]])
    centres = v[picked]
    for _ in range(3):
        nearest = (v @ centres.T).argmax(axis=1)
        means = np.array([v[nearest == k].sum(axis=0) if (nearest == k).any() else centres[k] for k in range(len(centres))])
        length = np.sqrt((means * means).sum(axis=1))
        centres = np.where(length[:, None] > LIMIT, means / np.maximum(length, LIMIT)[:, None], centres)
    return centres


def _angles(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(v @ centres.T, -1, 1))


def _placed(rows: DataFrame, centres: np.ndarray, keep_zero: bool) -> DataFrame:
    """rows with the nearest cell and the angle to its centre. Vectors that aren't finite are left out, and those of length 0
    unless a similarity of 0 counts."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column("v"))
            norms = np.sqrt((v * v).sum(axis=1))
            good = np.flatnonzero(np.isfinite(norms) & (keep_zero | (norms > LIMIT)))
            b, v = b.take(pa.array(good)), v[good] / np.maximum(norms[good], LIMIT)[:, None]
            if not len(v):
                continue
            dots = v @ centres.T if len(centres) else np.zeros((len(v), 1))
            cell = dots.argmax(axis=1)
            angle = np.arccos(np.clip(dots[np.arange(len(v)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([b.column("g"), b.column("i"), b.column("c"), b.column("v"), pa.array(cell, pa.int32()), pa.array(angle)], names=["g", "i", "c", "v", "cell", "angle"])

    return rows.select("g", "i", "c", "v").mapInArrow(place, "g string, i long, c string, v array<double>, cell int, angle double")


def _chain(centres: np.ndarray) -> np.ndarray:
    """The cells in an order in which neighbours follow each other: from each to the nearest that is left."""
    left, order = np.ones(len(centres), bool), [0]
    left[0] = False
    for _ in range(len(centres) - 1):
        order.append(int(np.where(left, centres @ centres[order[-1]], -np.inf).argmax()))
        left[order[-1]] = False
    return np.array(order)


class _Layout:
    """Which cells make up a bin, which bins' vectors are sent where, and the numbers of units."""

    def __init__(self, centres: np.ndarray, radius: np.ndarray, count: np.ndarray, threshold: float, block_rows: int, tasks: int):
        cells = len(count)
        self.centres = centres
        # a cell without vectors is reached by none, and a single one by all
        self.reach = np.where(count > 0, radius + (math.acos(min(1.0, max(-1.0, threshold))) + SLACK), -1.0) if cells > 1 else np.full(cells, np.inf)
        near = np.ones((cells, cells), bool) if cells == 1 else _angles(centres, centres) - radius[None, :] <= self.reach[:, None] + SLACK
        apart = count @ near @ count < 0.5 * count.sum() ** 2
        rows = min(block_rows, BIN_ROWS if apart else max(BIN_ROWS, math.ceil(count.sum() / 4)))
        self.order = _chain(centres) if cells > 1 else np.zeros(1, np.int64)
        starts, size = [], math.inf
        for at, k in enumerate(self.order):
            if size + count[k] > rows:
                starts.append(at)
                size = 0
            size += count[k]
        self.starts, n = np.array(starts), len(starts)
        self.bin = np.empty(cells, np.int64)
        self.bin[self.order] = np.repeat(np.arange(n), np.diff(np.append(self.starts, cells)))
        self.count = np.add.reduceat(count[self.order], self.starts)
        k = np.arange(n)
        even = (k[:, None] + k[None, :]) % 2 == 0
        self.owns = (k[:, None] == k[None, :]) | np.where(even, k[:, None] < k[None, :], k[:, None] > k[None, :])
        reached = np.maximum.reduceat(near[self.order], self.starts, axis=0)  # bins by the cells whose vectors may be sent there
        sent = (reached & self.owns[:, self.bin]) @ count
        self.blocks = np.maximum(1, np.ceil(self.count / block_rows)).astype(np.int64)
        self.lanes = np.maximum(1, np.ceil(sent / LANE_ROWS)).astype(np.int64)
        if (units := int((self.blocks * self.lanes).sum())) < tasks:
            self.lanes = np.maximum(1, np.minimum(self.lanes * math.ceil(tasks / units), sent // 256)).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.blocks * self.lanes)])
        self.units = int(self.first[-1])

    def sent(self, v: np.ndarray, cell: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of vectors with two hashes each: place, unit and role (0: of the block, 1: meets it, 2: meets it as one of its own)."""
        home, out = self.bin[cell], []
        block = one % self.blocks[home]
        for a in np.unique(home):
            x = np.flatnonzero(home == a)
            units = self.first[a] + block[x][:, None] * self.lanes[a] + np.arange(self.lanes[a])[None, :]
            out.append((np.repeat(x, self.lanes[a]), units.ravel(), np.zeros(units.size, np.int64)))
        angles = _angles(v, self.centres) if len(self.bin) > 1 else np.zeros((len(v), 1))
        reached = np.maximum.reduceat((angles <= self.reach[None, :])[:, self.order], self.starts, axis=1)
        for a in np.flatnonzero(self.count > 0):
            x = np.flatnonzero(self.owns[a, home] & reached[:, a])
            x, q = np.repeat(x, self.blocks[a]), np.tile(np.arange(self.blocks[a]), len(x))
            p, inside = block[x], home[x] == a
            meets = ~inside | (p == q) | np.where((p + q) % 2 == 0, q < p, q > p)
            x, q, role = x[meets], q[meets], np.where(inside & (p == q), 2, 1)[meets]
            out.append((x, self.first[a] + q * self.lanes[a] + two[x] % self.lanes[a], role))
        return tuple(map(np.concatenate, zip(*out, strict=True)))


def _units(placed: DataFrame, layout: _Layout) -> DataFrame:
    """unit, role, g, i, c and v: what meets in a unit, its block first, a unit to a partition."""
    hashed = lambda salt: F.xxhash64(F.lit(salt), "g", "i").bitwiseAND(F.lit((1 << 62) - 1))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin in range(0, b.num_rows, 1024):  # a matrix of angles to all centres is held for so many vectors
                few = b.slice(begin, 1024)
                place, unit, role = layout.sent(_scaled(_matrix(few.column("v"))), *(few.column(c).to_numpy() for c in ("cell", "one", "two")))
                for at in range(0, len(place), 4096):
                    part = few.take(pa.array(place[at : at + 4096]))
                    yield pa.RecordBatch.from_arrays([pa.array(unit[at : at + 4096]), pa.array(role[at : at + 4096], pa.int32()), *(part.column(c) for c in ("g", "i", "c", "v"))], names=["unit", "role", "g", "i", "c", "v"])

    rows = placed.select("g", "i", "c", "v", "cell", hashed(1).alias("one"), hashed(2).alias("two"))
    sent = rows.mapInArrow(send, "unit long, role int, g string, i long, c string, v array<double>")
    parts = max(1, min(layout.units, UNITS))
    return sent.repartitionById(parts, (F.col("unit") % parts).cast("int")).sortWithinPartitions("unit", "role")


class _Side:
    """Vectors with their entry points, places and codes."""

    def __init__(self, parts: list[pa.RecordBatch]):
        columns = pa.Table.from_batches(parts).combine_chunks()
        self.raw = np.concatenate([_matrix(p.column("v")) for p in parts])
        self.v, self.squares = _scaled(self.raw), _in_turn(self.raw * self.raw)
        self.group, self.code = (columns.column(c).combine_chunks() for c in ("g", "c"))
        self.place = columns.column("i").to_numpy()

    def __len__(self) -> int:
        return len(self.v)


PAIR = "ep1 string, ep1_sink_idx long, ep2_id string, ep2_sink_idx long, similarity double"


def _pairs(a: _Side, x: np.ndarray, b: _Side, y: np.ndarray, s: np.ndarray) -> dict[str, pa.Array]:
    return {"ep1": a.group.take(pa.array(x)), "ep1_sink_idx": pa.array(a.place[x]), "ep2_id": b.group.take(pa.array(y)), "ep2_sink_idx": pa.array(b.place[y]), "similarity": pa.array(s)}


class _Over:
    """Which pairs of a block and of what meets it are over the threshold, and their similarities."""

    def __init__(self, own: _Side, threshold: float, same_row_only: bool = False, digits: int | None = None):
        self.own, self.threshold, self.same_row_only, self.digits = own, threshold, same_row_only, digits
        self.groups = own.group.unique()
        self.mine = self._numbers(own)

    def _numbers(self, side: _Side) -> np.ndarray:
        return pc.fill_null(pc.index_in(side.group, value_set=self.groups), -1).to_numpy()

    def similarities(self, x: np.ndarray, other: _Side, y: np.ndarray) -> np.ndarray:
        own, out = self.own, np.empty(len(x))
        for at in range(0, len(x), 8192):
            i, j = x[at : at + 8192], y[at : at + 8192]
            one, two = own.squares[i], other.squares[j]
            squares = one * two
            plain = (squares > 1e-280) & (squares < np.inf) & (np.minimum(one, two) > LIMIT * LIMIT)
            length = np.where(plain, np.sqrt(np.where(plain, squares, 1.0)), np.maximum(np.sqrt(one), LIMIT) * np.maximum(np.sqrt(two), LIMIT))
            out[at : at + 8192] = np.clip(_in_turn(own.raw[i] * other.raw[j]) / length, -1, 1)
        return out if self.digits is None else np.round(out, self.digits)

    def found(self, other: _Side, floor: Callable[[slice], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places in the block and in the other side and similarities of all pairs, a few of the others at a time; floor says for these what a
        pair has to reach besides."""
        theirs, step = self._numbers(other), max(1, PRODUCTS // max(1, len(self.own)))
        for at in range(0, len(other), step):
            part = slice(at, at + step)
            s = self.own.v @ other.v[part].T
            x, y = np.nonzero(s > (self.threshold if floor is None else floor(part)) - NEAR)
            y += at
            same = self.mine[x] == theirs[y]
            if self.same_row_only:
                same &= self.own.place[x] == other.place[y]
            x, y = x[~same], y[~same]
            s = self.similarities(x, other, y)
            over = s > self.threshold
            if over.any():
                yield x[over], y[over], s[over]


class _Every:
    """A block that hands on every pair."""

    def __init__(self, own: _Side, threshold: float, same_row_only: bool, digits: int | None):
        self.own, self.over = own, _Over(own, threshold, same_row_only, digits)

    def meet(self, other: _Side, inside: bool) -> Iterator[pa.RecordBatch]:
        for x, y, s in self.over.found(other):
            yield pa.RecordBatch.from_pydict(_pairs(self.own, x, other, y, s))
            if not inside:  # of a block's own rows each comes as either side
                yield pa.RecordBatch.from_pydict(_pairs(other, y, self.own, x, s))

    def rest(self) -> Iterator[pa.RecordBatch]:
        return iter(())


class _Kept:
    """The first k pairs of each key, which is the number of an entry point and of a code; floor: what a further pair of the key has to reach."""

    ORDER = [("g", "ascending"), ("c", "ascending"), ("similarity", "descending"), ("ep1_sink_idx", "ascending"), ("ep2_id", "ascending"), ("ep2_sink_idx", "ascending")]

    def __init__(self, k: int, threshold: float):
        self.k, self.threshold, self.rows, self.held, self.pending, self.floor = k, threshold, [], 0, 0, np.full((0, 0), threshold)

    def grow(self, groups: int, codes: int) -> None:
        if (more := (max(0, groups - self.floor.shape[0]), max(0, codes - self.floor.shape[1]))) != (0, 0):
            self.floor = np.pad(self.floor, ((0, more[0]), (0, more[1])), constant_values=self.threshold)

    def add(self, g: np.ndarray, c: np.ndarray, s: np.ndarray, pairs: Callable[[np.ndarray], dict[str, pa.Array]]) -> None:
        reach = np.flatnonzero(s >= self.floor[g, c])
        if not len(reach):
            return
        self.rows.append(pa.table({"g": pa.array(g[reach]), "c": pa.array(c[reach]), **pairs(reach)}))
        self.pending += len(reach)
        if self.k == 1:
            np.maximum.at(self.floor, (g[reach], c[reach]), s[reach])
        if self.pending > max(PENDING, self.held):
            self.reduce()

    def reduce(self) -> None:
        rows = pa.concat_tables(self.rows).combine_chunks()
        rows = rows.take(pc.sort_indices(rows, sort_keys=self.ORDER))
        g, c = rows["g"].to_numpy(), rows["c"].to_numpy()
        starts = np.concatenate([[0], np.flatnonzero((g[1:] != g[:-1]) | (c[1:] != c[:-1])) + 1])
        place = np.arange(len(g)) - np.repeat(starts, np.diff(np.append(starts, len(g))))
        last = np.flatnonzero(place == self.k - 1)
        self.floor[g[last], c[last]] = rows["similarity"].to_numpy()[last]
        self.rows, self.pending = [rows.take(pa.array(np.flatnonzero(place < self.k)))], 0
        self.held = len(self.rows[0])

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            self.reduce()
            yield from self.rows[0].drop_columns(["g", "c"]).combine_chunks().to_batches(max_chunksize=1 << 14)


class _First:
    """A block that hands on, for the entry points of its rows and of those it meets, the first k pairs, or the first k with each code: the others
    cannot be among the first of their entry point. First is the largest similarity, then the smallest place, and of the other side the smallest
    entry point and place."""

    def __init__(self, own: _Side, threshold: float, k: int, by_code: bool, digits: int | None):
        self.own, self.over, self.k, self.threshold, self.by_code = own, _Over(own, threshold, False, digits), k, threshold, by_code
        self.own_code = self._code_numbers(own, {})
        self._clear()

    def _clear(self) -> None:
        self.groups, self.codes = {}, {}
        self.forth, self.back = _Kept(self.k, self.threshold), _Kept(self.k, self.threshold)

    def _code_numbers(self, side: _Side, seen: dict) -> np.ndarray:
        return self._seen(side.code, seen) if self.by_code else np.zeros(len(side), np.int64)

    @staticmethod
    def _seen(values: pa.Array, seen: dict) -> np.ndarray:
        told = values.dictionary_encode(null_encoding="encode")
        return np.array([seen.setdefault(x, len(seen)) for x in told.dictionary.to_pylist()], np.int64)[told.indices.to_numpy()]

    def _named(self, pairs: dict[str, pa.Array], side: _Side, rows: np.ndarray) -> dict[str, pa.Array]:
        return pairs | {"ep2_code": side.code.take(pa.array(rows))} if self.by_code else pairs

    def meet(self, other: _Side, inside: bool) -> Iterator[pa.RecordBatch]:
        groups, codes = len(self.over.groups), int(self.own_code.max(initial=0)) + 1
        seen = groups * len(self.codes) + codes * len(self.groups)
        if seen and seen + (groups * self.by_code + codes) * len(other) > BEST_ENTRIES:
            yield from self.rest()
        g, c = self._seen(other.group, self.groups), self._code_numbers(other, self.codes)
        self.forth.grow(groups, max(1, len(self.codes)))
        self.back.grow(len(self.groups), codes)

        def floor(part: slice) -> np.ndarray:
            forth = self.forth.floor[:, c[part]][self.over.mine]
            return forth if inside else np.minimum(forth, np.ascontiguousarray(self.back.floor[g[part]].T)[self.own_code])

        for x, y, s in self.over.found(other, floor):
            self.forth.add(self.over.mine[x], c[y], s, lambda r: self._named(_pairs(self.own, x[r], other, y[r], s[r]), other, y[r]))  # noqa: B023
            if not inside:
                self.back.add(g[y], self.own_code[x], s, lambda r: self._named(_pairs(other, y[r], self.own, x[r], s[r]), self.own, x[r]))  # noqa: B023

    def rest(self) -> Iterator[pa.RecordBatch]:
        yield from self.forth.rest()
        yield from self.back.rest()
        self._clear()


def _products(units: DataFrame, block: Callable[[_Side], _Every | _First], shape: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, own, made = None, [], None
        for b in batches:
            keys = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("unit", "role")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                if begin == end:
                    continue
                if keys[begin, 0] != unit:
                    if made:
                        yield from made.rest()
                    unit, own, made = keys[begin, 0], [], None
                part = b.slice(begin, end - begin)
                if not keys[begin, 1]:
                    own.append(part)
                elif own or made:
                    made, own = made or block(_Side(own)), []
                    for at in range(0, part.num_rows, MET_ROWS):
                        yield from made.meet(_Side([part.slice(at, MET_ROWS)]), keys[begin, 1] == 2)
        if made:
            yield from made.rest()

    return units.mapInArrow(run, shape)


def _laid_out(sinks: DataFrame, threshold: float, group: str, index: str, vector: str, code: str | None, block_bytes: int, block_rows: int) -> DataFrame:
    rows = _rows(sinks, group, index, vector, code)
    return _in_units(rows, threshold, block_bytes, block_rows)


def _rows(sinks: DataFrame, group: str, index: str, vector: str, code: str | None) -> DataFrame:
    rows = sinks.where(F.col(group).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0))
    return rows.select(F.col(group).cast("string").alias("g"), F.col(index).cast("long").alias("i"), (F.col(code).cast("string") if code else F.lit(None).cast("string")).alias("c"), F.col(vector).cast("array<double>").alias("v"))


def _in_units(rows: DataFrame, threshold: float, block_bytes: int, block_rows: int) -> DataFrame:
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    n, row_bytes, tasks = size["n"], 8 * (size["dim"] or 1), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = min(CELLS, n // CELL_ROWS) if threshold > 0 and n >= PRUNED_FROM else 1
    centres = _centres(rows, n, cells) if cells > 1 else np.zeros((0, 0))
    placed = _placed(rows, centres, threshold < 0)
    block_rows = max(1, min(block_rows, block_bytes // row_bytes))
    if len(centres) < 2:
        block_rows = min(block_rows, n if n < BIN_ROWS else math.ceil(n / 4))  # a few blocks, if there is work for them
        return _units(placed, _Layout(centres, np.zeros(1), np.array([n]), threshold, max(1, block_rows), tasks))
    placed = written(placed, "cells")  # a vector's cell is chosen once
    radius, count = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect():  # a row a cell
        radius[r["cell"]], count[r["cell"]] = r["radius"], r["n"]
    return _units(placed, _Layout(centres, radius, count, threshold, block_rows, tasks))


def cosine_pairs(sinks: DataFrame, threshold: float, group: str = "method", index: str = "sink_idx", vector: str = "embedding", same_row_only: bool = False, block_bytes: int = BLOCK_BYTES, digits: int | None = None) -> DataFrame:
    """ep1, ep1_sink_idx, ep2_id, ep2_sink_idx, similarity of all ordered pairs above threshold whose groups differ.

    same_row_only: only the very same row is excluded, pairs within a group count. Vectors must have one length; null groups take no part.
    digits: similarities are rounded to so many before they are compared.
    """
    units = _laid_out(sinks, threshold, group, index, vector, None, block_bytes, 1 << 30)
    return _products(units, lambda own: _Every(own, threshold, same_row_only, digits), PAIR)


def first_pairs(sinks: DataFrame, threshold: float, k: int, group: str = "method", index: str = "sink_idx", vector: str = "embedding", block_bytes: int = BLOCK_BYTES, digits: int | None = None) -> DataFrame:
    """Those of cosine_pairs that can be among the first k of their entry point: top_pairs finds the same in them. A unit hands on k pairs of an
    entry point that it holds."""
    units = _laid_out(sinks, threshold, group, index, vector, None, block_bytes, BLOCK_ROWS)
    return _products(units, lambda own: _First(own, threshold, k, False, digits), PAIR)


def best_pairs(sinks: DataFrame, threshold: float, code: str = "code", group: str = "method", index: str = "sink_idx", vector: str = "embedding", block_bytes: int = BLOCK_BYTES, digits: int | None = None) -> DataFrame:
    """ep1, ep1_sink_idx, ep2_id, ep2_sink_idx, similarity, ep2_code of those of cosine_pairs that can be the first of their entry point and code:
    first_per_code finds the same in them, and so does diversified. A unit hands on a pair for an entry point and code that meet in it.

    Where most rows are copies in code and vector, the work is that of what is different (_of_copies)."""
    rows, shape = _rows(sinks, group, index, vector, code), f"{PAIR}, ep2_code string"
    best = lambda r: _products(_in_units(r, threshold, block_bytes, BLOCK_ROWS), lambda own: _First(own, threshold, 1, True, digits), shape)
    size = rows.select(F.xxhash64("c", "v").alias("h")).agg(F.count("*").alias("n"), F.count_distinct("h").alias("kinds")).first()
    return _of_copies(rows, best) if size["kinds"] * COPIES <= size["n"] else best(rows)


def _of_copies(rows: DataFrame, best: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """best of rows, most of which are copies in code and vector.

    As a partner, of all rows of a code and vector only the first of the first entry point can be best, or for that entry point itself the first of the
    next one: these two are the partners. Their entry points ("inner") take part by themselves, with all their vectors. Every other entry point is
    excluded from no partner, so what is best for it follows from its vectors alone: each different one takes part once, as an entry point of its own, and
    its pairs are then said of all its holders. Such names begin with v and real ones with r; those that are no partners have the code m."""
    by_group = written(rows.groupBy("g", "c", "v").agg(F.min("i").alias("i")), "kinds")
    place = F.row_number().over(Window.partitionBy("c", "v").orderBy("g"))
    partners = written(by_group.withColumn("place", place).where("place <= 2").drop("place"), "partners")
    inner = partners.select("g").distinct()
    held = by_group.groupBy("g", "v").agg(F.min("i").alias("i"))
    outer = written(held.join(inner, "g", "left_anti"), "outer")
    alone = written(outer.select("v").distinct().withColumn("id", F.monotonically_increasing_id()), "vectors")
    real, none = F.concat(F.lit("r"), "g").alias("g"), F.lit("m").alias("c")
    met = partners.select(real, "i", F.concat(F.lit("r"), "c").alias("c"), "v")
    met = met.unionByName(held.join(inner, "g", "left_semi").select(real, "i", none, "v"))
    met = met.unionByName(alone.select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("g"), F.lit(0).cast("long").alias("i"), none, "v"))
    found = best(written(met, "met")).where("NOT (ep2_code <=> 'm')")
    plain = lambda c: F.substring(c, 2, 1 << 30)
    found = written(first_per_code(found).withColumn("ep2_id", plain("ep2_id")).withColumn("ep2_code", plain("ep2_code")), "kinds-best")
    holders = outer.join(alone, "v").select(F.col("g").alias("__g"), F.col("i").alias("__i"), F.col("id").alias("__id"))
    theirs = found.where(F.col("ep1").startswith("v")).withColumn("__id", plain("ep1").cast("long"))
    theirs = theirs.join(holders, "__id").withColumn("ep1", F.col("__g")).withColumn("ep1_sink_idx", F.col("__i"))
    return found.where(F.col("ep1").startswith("r")).withColumn("ep1", plain("ep1")).unionByName(theirs.select(*found.columns))


def join_work(sinks: DataFrame, threshold: float, group: str = "method", index: str = "sink_idx", vector: str = "embedding", block_bytes: int = BLOCK_BYTES) -> tuple[int, int]:
    """How many products the join makes, and how many two-way pairs of vectors there are."""
    units = _laid_out(sinks, threshold, group, index, vector, None, block_bytes, 1 << 30)
    own, met = F.count_if(F.col("role") == 0), F.count_if(F.col("role") > 0)
    made = units.groupBy("unit").agg((own * met).alias("n")).agg(F.sum("n")).first()[0] or 0
    n = sinks.where(F.col(group).isNotNull() & F.col(vector).isNotNull()).count()
    return made, n * (n + 1) // 2


def _whole_numbers(rows: DataFrame, dim: int) -> DataFrame:
    """rows (g, i, v) with what is needed to say by whole numbers that a pair is under the threshold: of the vector at length 1, components in steps
    of its largest one's 22nd part (those to dim; two make up a number, x or with the places changed y), the step, twice their sum's share, how far they are from the
    vector, and the length of what lies beyond dim. A vector that is too short or too long for that is infinitely far."""
    double = F.transform(F.col("v"), lambda x: x.cast("double"))
    made = rows.withColumn("squares", dot(double, double)).withColumn("size", F.size("v")).withColumn("most", F.array_max(F.transform(double, F.abs)))
    made = made.withColumn("plain", (F.col("squares") >= LIMIT * LIMIT) & (F.col("squares") < 1e100)).withColumn("step", F.when(F.col("plain"), F.col("most") / (HALF * F.sqrt("squares"))).otherwise(0.0))
    made = written(made, "lengths")  # else lengths are found anew for every component
    made = made.withColumn("q", F.transform(F.slice(F.col("v"), 1, max(1, dim)), lambda x: F.when(F.col("plain"), F.rint(x.cast("double") * HALF / F.col("most"))).otherwise(0.0).cast("long") + HALF))
    off = F.zip_with(F.slice(F.col("v"), 1, max(1, dim)), F.col("q"), lambda x, q: x.cast("double") / F.sqrt("squares") - (q - HALF) * F.col("step"))
    beyond = F.transform(F.slice(F.col("v"), dim + 1, 1 << 30), lambda x: x.cast("double") / F.sqrt("squares"))
    made = made.withColumn("far", F.when(F.col("plain"), F.sqrt(dot(off, off))).otherwise(math.inf)).withColumn("beyond", F.when(F.col("plain"), F.sqrt(dot(beyond, beyond))).otherwise(0.0))
    at = lambda k: F.coalesce(F.get("q", F.lit(k)), F.lit(HALF)) if k < dim else F.lit(HALF)
    count = dim + dim % 2
    total = F.aggregate("q", F.lit(0).cast("long"), lambda t, q: t + q - HALF)
    numbers = [F.struct((at(k) + at(k + 1) * DIGIT).cast("double").alias("x"), (at(k + 1) + at(k) * DIGIT).cast("double").alias("y")).alias(f"n{k // 2}") for k in range(0, count, 2)]
    return made.select("g", "i", "v", "squares", "size", "step", "far", "beyond", (HALF * total + HALF * HALF * count // 2).cast("double").alias("share_of_sum"), *numbers)


def cosine_pairs_native(sinks: DataFrame, threshold: float, group: str = "method", index: str = "sink_idx", vector: str = "embedding") -> DataFrame:
    """The same by expressions alone, every pair of rows: a check on the blocks; no pipeline uses it.

    A pair's similarity is found by lambdas, which are slow, so the join's compiled condition leaves out the pairs that cannot reach the threshold: a sum of products
    of whole numbers, two components in each, and how far these are from the vectors bound the similarity from above. Rows are cut into shares, and each
    two shares, or one with itself, are a key: pairs are dealt evenly, met once for both directions, and none of the sides is broadcast."""
    whole = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(math.inf)))
    rows = sinks.where(F.col(group).isNotNull() & (F.size(vector) > 0) & whole)
    size = rows.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("dim")).first()
    tasks, dim = int(sinks.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(COLUMNS, size["dim"] or 0)
    shares, pairs = max(math.ceil(math.sqrt(2 * tasks)), math.ceil(size["n"] / LANE_ROWS)), math.ceil(dim / 2)
    rows = rows.select(F.col(group).cast("string").alias("g"), F.col(index).cast("long").alias("i"), F.col(vector).alias("v"))
    made = written(_whole_numbers(rows, dim), "whole-numbers").withColumn("share", F.pmod(F.xxhash64("g", "i"), F.lit(shares)).cast("int"))

    def side(name: str, number: str, others: Column, cell: Column) -> DataFrame:
        known = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("step", "far", "beyond", "share_of_sum")]  # tables' columns may be null, and asking so is most of the code
        numbers = [F.coalesce(F.col(f"n{k}.{number}"), F.lit(0.0)).alias(f"n{k}") for k in range(pairs)]
        dealt = made.withColumn("k", F.explode(others)).select(cell.alias("cell"), "g", "i", "v", "squares", "size", *known, *numbers)
        return dealt.toDF(*[f"{name}_{c}" for c in dealt.columns]).repartition(shares * (shares + 1) // 2, f"{name}_cell")

    share, k = F.col("share"), F.col("k")
    a, b = side("a", "x", F.sequence(share, F.lit(shares - 1)), share * shares + k), side("b", "y", F.sequence(F.lit(0), share), k * shares + share)
    added = lambda columns: sum(columns[1:], columns[0])
    each = [added([F.col(f"a_n{k}") * F.col(f"b_n{k}") for k in range(at, min(at + TOGETHER, pairs))]) for at in range(0, pairs, TOGETHER)]
    sums = added([F.shiftright(c.cast("long"), DIGIT_BITS).bitwiseAND(F.lit(DIGIT - 1)) for c in each]) if each else F.lit(0)
    near = (sums.cast("double") - F.col("a_share_of_sum") - F.col("b_share_of_sum")) * F.col("a_step") * F.col("b_step")
    most = near + F.col("a_far") + F.col("b_far") + F.col("a_far") * F.col("b_far") + F.col("a_beyond") * F.col("b_beyond")
    met = a.join(b.hint("merge"), (F.col("a_cell") == F.col("b_cell")) & (most > threshold - NEAR))

    length = F.greatest(F.sqrt(F.col("a_squares") * F.col("b_squares")), F.lit(LIMIT * LIMIT))
    product = F.aggregate(F.zip_with("a_v", "b_v", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)
    one_way = F.when(F.col("a_cell") % (shares + 1) == 0, F.col("a_g") < F.col("b_g")).otherwise(F.col("a_g") != F.col("b_g"))  # a share's own pairs meet both ways

    def said(x: str, y: str, s: Column) -> Column:
        return F.struct(F.col(f"{x}_g").alias("ep1"), F.col(f"{x}_i").alias("ep1_sink_idx"), F.col(f"{y}_g").alias("ep2_id"), F.col(f"{y}_i").alias("ep2_sink_idx"), s.alias("similarity"))

    # the lambdas are arguments of a generator, since conditions would be moved into the join, which then is not compiled
    similarity = F.when(one_way & (F.col("a_size") == F.col("b_size")), product / length)
    over = F.filter(F.array(similarity), lambda s: s > threshold)
    both = F.flatten(F.transform(over, lambda s: F.array(said("a", "b", s), said("b", "a", s))))
    return met.select(F.inline_outer(both)).where("ep1 IS NOT NULL")


def best_neighbour(eps: DataFrame, pairs: DataFrame, ep: str = "method") -> DataFrame:
    """Every entry point with its most similar pair, the first in order of ep1_sink_idx, ep2_id, ep2_sink_idx; -1 and nulls if it has none."""
    order = Window.partitionBy("ep1").orderBy(F.col("similarity").desc(), "ep1_sink_idx", "ep2_id", "ep2_sink_idx")
    best = pairs.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")
    return eps.select(F.col(ep).alias("ep")).distinct().join(best, F.col("ep") == F.col("ep1"), "left").drop("ep1").withColumn("similarity", F.coalesce("similarity", F.lit(-1.0)))


def top_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """The k most similar pairs of each entry point."""
    order = Window.partitionBy("ep1").orderBy(F.col("similarity").desc(), "ep1_sink_idx", "ep2_id", "ep2_sink_idx")
    return pairs.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= k)


def _order(order: tuple) -> Column:
    """Descending similarity, then these columns, as one value to compare."""
    return F.struct((-F.col("similarity")).alias("_0"), *[(F.col(c) if isinstance(c, str) else c).alias(f"_{i}") for i, c in enumerate(order, 1)])


def first_per_code(pairs: DataFrame, ep: str = "ep1", code: str = "ep2_code", order: tuple = ("ep1_sink_idx", "ep2_id", "ep2_sink_idx")) -> DataFrame:
    """Of the pairs of an entry point and code the first in the order, as an aggregate with map-side combine."""
    row = F.struct(*[F.col(f"`{c}`") for c in pairs.columns])
    return pairs.groupBy(F.col(ep).alias("__ep"), F.col(code).alias("__code")).agg(F.min(F.struct(_order(order).alias("o"), row.alias("row"))).alias("m")).select("m.row.*")


def diversified(pairs: DataFrame, n: int, ep: str = "ep1", other: str = "ep2_id", code: str = "ep2_code", order: tuple = ()) -> DataFrame:
    """Greedy choice per entry point in descending order of similarity: an entry whose code was seen is skipped, entries of an accepted
    neighbour are taken, a new neighbour is taken while there are fewer than n, and the n + 1st ends the choice.

    As aggregates: the first row of each code; of each neighbour its first row among them; the n + 1st neighbour's first row is the end, and
    what lies before it is the choice. The first rows are written, since two steps read them. Pairs need not be complete: those that
    best_pairs leaves out change nothing.
    """
    order = order or ("ep1_sink_idx", other, "ep2_sink_idx")
    fresh = written(first_per_code(pairs, ep, code, order), "first-pairs")
    place = Window.partitionBy("__e").orderBy("__o")
    ids = fresh.groupBy(F.col(ep).alias("__e"), F.col(other).alias("__i")).agg(F.min(_order(order)).alias("__o"))
    ids = ids.withColumn("__r", F.row_number().over(place)).where(F.col("__r") <= n + 1)
    ids = ids.withColumn("__end", F.max(F.when(F.col("__r") == n + 1, F.col("__o"))).over(Window.partitionBy("__e"))).where(F.col("__r") <= n)
    kept = fresh.join(ids.select("__e", "__i", "__end"), F.col(ep).eqNullSafe(F.col("__e")) & F.col(other).eqNullSafe(F.col("__i"))).withColumn("__o", _order(order))
    kept = kept.where(F.col("__end").isNull() | (F.col("__o") < F.col("__end")))
    return kept.withColumn("place", F.row_number().over(place).cast("long")).select(*[F.col(f"`{c}`") for c in pairs.columns], "place")
