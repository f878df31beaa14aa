"""N-best segmentation into the pieces of a SentencePiece model, and decoding (operator 7).

The lattice of a text has an edge for every vocabulary piece at every place; its score is the model's piece score, and that of a
character without a piece is the least score less 10 (it is written as its UTF-8 byte pieces). Forward Viterbi gives the exact best
score up to each place; a backward A* search from the end uses it as its heuristic, so complete segmentations leave the
queue in order. No piece reaches over a place whose two neighbours stand together in no piece, so the lattice falls apart into
units there. Best scores, best ids and the gap to a unit's second best come from one vectorised forward and backward pass for
many units and are remembered; the n best of a text only differ from the best at the n - 1 units with the smallest gaps, where
the A* search lists alternatives, and a queue over their sums yields the n best of the text.

Order among equal scores: the best segmentation of a unit has the longer piece first, read from the end; its other ones come in the
order in which the search finds them, which is fixed; in a text, by the ranks of the units' alternatives, first unit first.

Defined results: null and empty text have no pieces (one empty segmentation, score 0); white space other than U+0020 is kept as
characters; U+2581 in a text decodes as a space, as the model's own decoder does; texts of any length are segmented whole; repeated
rows give equal results; an empty table gives no rows; further columns are kept, but for those named like the operator's own, which are replaced.
"""

from __future__ import annotations

import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import held, portions, table, without

SPACE = "▁"
MEMO_UNITS = 250_000
SHORT_UNIT = 24
N_BEST = 4
#: Marks of the pieces' hashes, per length: what has none is no piece and need not be looked up.
MARKS = 1 << 18
#: A unit is remembered from its second batch on; this many marks tell (a false one does no harm).
MET_MASK = (1 << 23) - 1
_MULT = np.array([(0xD6E8FEB86659FD93 * (2 * k + 3) ^ (0xA0761D6478BD642F >> (k % 7))) % (1 << 64) | 1 for k in range(64)], dtype=np.uint64)


def _finish(h: np.ndarray, length: int) -> np.ndarray:
    h = h + np.uint64(length)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xE9846AF9B1A615D3)
    return h ^ (h >> np.uint64(28))


class Pieces:
    """A SentencePiece vocabulary and the segmentation of texts into it."""

    def __init__(self, path: str):
        import sentencepiece

        self.path = path
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.vocabulary: dict[str, tuple[int, float]] = {}
        self.byte_ids, self.raw = [0] * 256, []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(b"")
            else:
                self.vocabulary[piece] = (i, float(sp.get_score(i)))
                self.raw.append(piece.replace(SPACE, " ").encode("utf-8"))
        self.unknown = min(s for _, s in self.vocabulary.values() if s > -1e8) - 10
        self.longest = max(map(len, self.vocabulary))
        self._index()
        self._units()
        self.memo: dict[str, int] = {}
        self.ids: list[bytes] = []
        self.score, self.gap = np.zeros(MEMO_UNITS), np.zeros(MEMO_UNITS)
        self.met = bytearray(MET_MASK + 1)
        self.alternatives: dict[str, list[tuple[float, bytes]]] = {}

    def _index(self) -> None:
        by: dict[int, list[str]] = {}
        for p in self.vocabulary:
            by.setdefault(len(p), []).append(p)
        self.by_length = []
        for length in range(1, self.longest + 1):
            some = by.get(length, [])
            codes = np.frombuffer("".join(some).encode("utf-32-le"), dtype="<u4").reshape(-1, length).astype(np.uint64)
            h = _finish((codes * _MULT[:length]).sum(axis=1, dtype=np.uint64), length)
            order = np.argsort(h)
            at = np.array([self.vocabulary[p] for p in some]).reshape(-1, 2)[order]
            marks = np.zeros(MARKS, dtype=bool)
            marks[h & np.uint64(MARKS - 1)] = True
            self.by_length.append((h[order], at[:, 0].astype(np.int64), at[:, 1], marks))

    def _units(self) -> None:
        """Groups of characters such that no piece holds neighbours of two groups; a space mark before a group stays with it."""
        group: dict[str, str] = {}

        def root(c: str) -> str:
            while group.setdefault(c, c) != c:
                group[c] = group[group[c]]
                c = group[c]
            return c

        for p in self.vocabulary:
            for a, b in zip(p, p[1:], strict=False):
                if a != SPACE and b != SPACE:
                    group[root(a)] = root(b)
                elif a != SPACE:
                    raise ValueError(f"piece {p!r} has a space mark after another character")
        members: dict[str, list[str]] = {}
        for c in list(group):
            members.setdefault(root(c), []).append(c)
        classes = ["[" + "".join(map(re.escape, sorted(m))) + "]" for m in members.values() if len(m) > 1]
        single = "(?s:.)"
        body = "|".join(f"{c}+" for c in sorted(classes, key=len, reverse=True))
        self.unit = re.compile(f"{SPACE}+(?:{body}|[^{SPACE}])?|{body}|{single}")

    def units(self, text: str) -> list[str]:
        return self.unit.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def _edges(self, unit: str, i: int):
        """(length, ids, score) of the edges that start at i."""
        single = False
        for length in range(1, min(self.longest, len(unit) - i) + 1):
            found = self.vocabulary.get(unit[i : i + length])
            if found:
                single = single or length == 1
                yield length, (found[0],), found[1]
        if not single:
            yield 1, tuple(self.byte_ids[b] for b in unit[i].encode("utf-8", "surrogatepass")), self.unknown

    def forward(self, unit: str) -> tuple[list[float], list[list[tuple[int, tuple[int, ...], float]]]]:
        """Best score up to every place, and the edges that end there."""
        alpha, ending = [0.0] + [float("-inf")] * len(unit), [[] for _ in range(len(unit) + 1)]
        for i in range(len(unit)):
            for length, ids, score in self._edges(unit, i):
                ending[i + length].append((length, ids, score))
                alpha[i + length] = max(alpha[i + length], alpha[i] + score)
        return alpha, ending

    def n_best(self, unit: str, n: int) -> list[tuple[float, bytes]]:
        """The n best segmentations of a unit as (score, little-endian ids), best first: backward A* with forward Viterbi scores.

        A path is a chain of (ids of an edge, the path after it), so that long units cost no more than their edges.
        """
        alpha, ending = self.forward(unit)
        queue: list[tuple] = [(-alpha[-1], 0, len(unit), 0.0, None)]
        pushed, out = 0, []
        while queue and len(out) < n:
            _, _, at, score, path = heapq.heappop(queue)
            if at == 0:
                ids: list[int] = []
                while path is not None:
                    ids += path[0]
                    path = path[1]
                out.append((score, np.array(ids, dtype="<u4").tobytes()))
                continue
            for length, edge, s in reversed(ending[at]):  # the longest last, which leaves the queue first among equals
                total = score + s
                pushed += 1
                heapq.heappush(queue, (-(total + alpha[at - length]), -pushed, at - length, total, (edge, path)))
        return out

    def _best_of(self, units: list[str]) -> list[tuple[bytes, float, float]]:
        """(ids, score, gap to the second best) of units of one length, all at once."""
        w, n = len(units), len(units[0])
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(w, n).astype(np.uint64)
        edge, piece, plain = {}, {}, np.zeros((w, n), dtype=np.uint64)
        for length in range(1, min(n, self.longest) + 1):
            keys, ids, scores, marks = self.by_length[length - 1]
            plain = plain[:, : n - length + 1] + codes[:, length - 1 :] * _MULT[length - 1]
            if not len(keys):
                continue
            h = _finish(plain, length).reshape(-1)
            maybe = np.flatnonzero(marks[h & np.uint64(MARKS - 1)])
            at = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
            known = keys[at] == h[maybe]
            if length > 1 and not known.any():
                continue
            edge[length] = np.full((w, n - length + 1), self.unknown if length == 1 else -np.inf)
            piece[length] = np.full((w, n - length + 1), -1, dtype=np.int64)
            edge[length].reshape(-1)[maybe[known]] = scores[at[known]]
            piece[length].reshape(-1)[maybe[known]] = ids[at[known]]
        alpha, beta, back = np.full((w, n + 1), -np.inf), np.full((w, n + 1), -np.inf), np.zeros((w, n + 1), dtype=np.int64)
        alpha[:, 0] = beta[:, n] = 0
        for j in range(1, n + 1):
            for length in sorted(edge):
                if length <= j:
                    s = alpha[:, j - length] + edge[length][:, j - length]
                    better = s >= alpha[:, j]  # lengths ascend: the longest of the best
                    better &= s > -np.inf
                    alpha[better, j] = s[better]
                    back[better, j] = length
        for i in range(n - 1, -1, -1):
            for length in edge:
                if i + length <= n:
                    beta[:, i] = np.maximum(beta[:, i], edge[length][:, i] + beta[:, i + length])
        chosen = np.zeros((w, n), dtype=np.int64)
        at, every = np.full(w, n), np.arange(w)
        while (at > 0).any():
            live = at > 0
            length = np.where(live, back[every, at], 0)
            chosen[every[live], (at - length)[live]] = length[live]
            at = at - length
        second = np.full(w, -np.inf)
        for length, e in edge.items():
            for i in range(n - length + 1):
                s = alpha[:, i] + e[:, i] + beta[:, i + length]
                second = np.where(chosen[:, i] != length, np.maximum(second, s), second)
        ids = np.full((w, n), -1, dtype=np.int64)
        odd = np.zeros(w, dtype=bool)
        for length in edge:
            mask = chosen[:, : n - length + 1] == length
            ids[:, : n - length + 1][mask] = piece[length][mask]
            odd |= (mask & (piece[length] < 0)).any(axis=1)
        used = chosen > 0
        flat, ends = ids[used].astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(used.sum(axis=1))]) * 4
        best, gap = alpha[:, n], alpha[:, n] - second
        out = []
        for k, (a, b, score, g, strange) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), best.tolist(), gap.tolist(), odd.tolist(), strict=True)):
            out.append((self.n_best(units[k], 1)[0][1] if strange else flat[a:b], score, g))
        return out

    def _solve(self, units: list[str]) -> dict[str, tuple[bytes, float, float]]:
        by, out = {}, {}
        for u in units:
            if len(u) <= SHORT_UNIT:
                by.setdefault(len(u), []).append(u)
            else:
                two = self.n_best(u, 2)
                out[u] = (two[0][1], two[0][0], two[0][0] - two[1][0] if len(two) > 1 else float("inf"))
        for same in by.values():
            for k in range(0, len(same), 4096):
                out.update(zip(same[k : k + 4096], self._best_of(same[k : k + 4096]), strict=True))
        return out

    def encode(self, texts: list[str | None], n: int = N_BEST) -> list[list[tuple[float, bytes]]]:
        """The n best segmentations of each text as (score, ids as little-endian 32-bit integers), best first."""
        split = [self.units(t or "") for t in texts]
        new = list(dict.fromkeys(u for us in split for u in us if u not in self.memo))
        fresh = self._solve(new)
        for u in new if len(self.ids) < MEMO_UNITS else ():
            at = hash(u) & MET_MASK
            if self.met[at] and len(self.ids) < MEMO_UNITS and len(u) <= SHORT_UNIT:
                ids, self.score[len(self.ids)], self.gap[len(self.ids)] = fresh[u]
                self.memo[u] = len(self.ids)
                self.ids.append(ids)
            self.met[at] = 1
        out = []
        for us in split:
            at = list(map(self.memo.get, us))
            if None in at:
                lacking = [i for i, k in enumerate(at) if k is None]
                where = np.array([0 if k is None else k for k in at])
                ids, scores, gap = [b"" if k is None else self.ids[k] for k in at], self.score[where], self.gap[where]
                for i in lacking:
                    ids[i], scores[i], gap[i] = fresh[us[i]]
                score = float(scores.sum())
            else:
                ids, score, gap = [self.ids[k] for k in at], float(self.score[at].sum()) if at else 0.0, self.gap[at]
            out.append(self._n_best_of_text(us, ids, score, gap, n))
        return out

    def _alternatives(self, unit: str, n: int) -> list[tuple[float, bytes]]:
        found = self.alternatives.get(unit)
        if found is None or (len(found) < n and found[0][2] < n):
            got = self.n_best(unit, n)
            found = [(s, ids, n) for s, ids in got]
            if len(self.alternatives) < MEMO_UNITS and len(unit) <= SHORT_UNIT:
                self.alternatives[unit] = found
        return [(s, ids) for s, ids, _ in found[:n]]

    def _n_best_of_text(self, us: list[str], ids: list[bytes], score: float, gap: np.ndarray, n: int) -> list[tuple[float, bytes]]:
        out = [(score, b"".join(ids))]
        if n == 1 or not us:
            return out
        if len(us) > n - 1:
            last = np.partition(gap, n - 2)[n - 2]
            less, equal = np.flatnonzero(gap < last), np.flatnonzero(gap == last)
            places = sorted([*less.tolist(), *equal[len(equal) - (n - 1 - len(less)) :].tolist()])
        else:
            places = list(range(len(us)))
        lists = [self._alternatives(us[p], n) for p in places]
        queue = [(0.0, (0,) * len(places), 0)]
        first = True
        while queue and len(out) < n:
            cost, ranks, least = heapq.heappop(queue)
            if not first:
                own = list(ids)
                for p, r, some in zip(places, ranks, lists, strict=True):
                    own[p] = some[r][1]
                out.append((score - cost, b"".join(own)))
            first = False
            for k in range(least, len(places)):
                r = ranks[k] + 1
                if r < len(lists[k]):
                    heapq.heappush(queue, (cost + lists[k][r - 1][0] - lists[k][r][0], (*ranks[:k], r, *ranks[k + 1 :]), k))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces put together, space marks as spaces, without the first one."""
        text = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def pieces(path: str) -> Pieces:
    """The worker's model of this file."""
    return held("pieces", lambda m: m.path == path, lambda: Pieces(path))


def encode(docs: DataFrame, path: str, n: int = N_BEST, text_col: str = "text") -> DataFrame:
    """docs without the text, with segmentations: array of (score, pieces), best first, and decoded: the text of the best one; columns of
    these names are replaced."""
    docs = without(docs, "segmentations", "decoded", keep=text_col)
    place, names = docs.columns.index(text_col), [c for c in docs.columns if c != text_col]
    kind = pa.list_(pa.struct([("score", pa.float64()), ("pieces", pa.list_(pa.int32()))]))

    def encoded(batches):
        model = pieces(path)
        for some in portions(batches, place):
            found = model.encode(some.column(place).to_pylist(), n)
            best = [model.decode(f[0][1]) for f in found]
            flat = [x for f in found for x in f]
            ends = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            sizes = np.concatenate([[0], np.cumsum([len(ids) // 4 for _, ids in flat])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.frombuffer(b"".join(ids for _, ids in flat), dtype="<i4")))
            structs = pa.StructArray.from_arrays([pa.array([s for s, _ in flat], pa.float64()), lists], fields=list(kind.value_type))
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(some.columns) if i != place), pa.ListArray.from_arrays(pa.array(ends), structs), pa.array(best, pa.string())], names=[*names, "segmentations", "decoded"])

    fields = [f for f in docs.schema.fields if f.name != text_col]
    made = [T.StructField("segmentations", T.ArrayType(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("pieces", T.ArrayType(T.IntegerType()))]))), T.StructField("decoded", T.StringType())]
    return docs.mapInArrow(encoded, T.StructType([*fields, *made]))


def encode_digest(docs: DataFrame, path: str, n: int = N_BEST, text_col: str = "text") -> DataFrame:
    """docs without the text, with n_pieces, score, ids_crc32 of the best segmentation, n_best (scores) and n_best_crc32 (comma-joined),
    and round_trip: whether the best one decodes to the text; columns of these names are replaced. The same as digests of encode(), without
    moving the id lists."""
    docs = without(docs, "n_pieces", "score", "ids_crc32", "n_best", "n_best_crc32", "round_trip", keep=text_col)
    place, names = docs.columns.index(text_col), [c for c in docs.columns if c != text_col]

    def digested(batches):
        model = pieces(path)
        for b in portions(batches, place):
            rows, texts = [], b.column(place).to_pylist()
            for t, found in zip(texts, model.encode(texts, n), strict=True):
                score, ids = found[0]
                same = model.decode(ids) == (t or "").replace(SPACE, " ")
                rows.append((len(ids) // 4, score, zlib.crc32(ids), ",".join(f"{s:.0f}" for s, _ in found), ",".join(str(zlib.crc32(x)) for _, x in found), same))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.float64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != place), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[*names, "n_pieces", "score", "ids_crc32", "n_best", "n_best_crc32", "round_trip"])

    fields = [f for f in docs.schema.fields if f.name != text_col]
    made = [("n_pieces", T.LongType()), ("score", T.DoubleType()), ("ids_crc32", T.LongType()), ("n_best", T.StringType()), ("n_best_crc32", T.StringType()), ("round_trip", T.BooleanType())]
    return docs.mapInArrow(digested, T.StructType([*fields, *(T.StructField(a, k) for a, k in made)]))


def op7_n_best_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n best segmentations of every document, as digests."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    return encode_digest(docs, public_tokenizers.path("piece_bpe_32k.model"))
