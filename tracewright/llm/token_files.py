"""Token ids as Parquet list columns (operator 9).

A token file set is a folder of Parquet files, one per range of document ids, in ascending order of doc_id:
doc_id, part (number of the file's range), local_start (ids of the documents before it in this range), n_tokens and
tokens (list of 32-bit ids). Ids and counts are delta encoded (DELTA_BINARY_PACKED), row groups
and pages are small and carry page indexes, so that a reader can fetch the id lists of a few documents or the counts alone.

Defined results: null text is an empty text (only the end id); a null doc_id sorts first; repeated ids and rows are each
written, those of one id in order of their texts; texts of any length are written whole, and encoded in portions; an empty table gives an empty
set; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.llm.common import fresh_path, held, table

ROW_GROUP_BYTES = 8 << 20
PAGE_BYTES = 64 << 10
#: A worker's known words: so many slots of so many ids each, 33 bytes a slot (35 MB; 51 MB if ids reach 65,536). It keeps
#: nothing else that grows.
KNOWN_SLOTS = 1 << 20
KNOWN_IDS = 8
WORDS_AT_ONCE = 10_000
MAX_BYTES = 64
LONG_BYTES = 2 << 20
GAP = re.compile(rb"[ \t-\r]")
SPACE, LETTER, MARK = 1, 2, 3
BYTE_KINDS = np.zeros(256, dtype=np.uint8)
BYTE_KINDS[[32, *range(9, 14)]] = SPACE
BYTE_KINDS[97:123] = LETTER
BYTE_KINDS[[c for c in range(33, 127) if not chr(c).isalnum()]] = MARK


class WordEncoder:
    """Ids of texts, put together from those of their words.

    Words are cut at ASCII white space and between a lower-case ASCII letter and an ASCII mark. That is exact for tokenizers whose
    pre-tokenizer drops white space and never joins a letter and a mark that follows it, and whose normalizer folds case and treats
    words alone as in a text. ASCII case is folded beforehand. A text that holds the opening of a special token's string is neither
    folded nor cut at marks. The words' ids come from the tokenizers library.

    Words of up to MAX_BYTES bytes are told apart by two 64-bit tabulation hashes. The ids of a word lie in the slot that its hash names until
    another word takes the slot, so memory is fixed and a word that is not there costs time only. Longer words, and those of more than
    KNOWN_IDS ids, are encoded anew in each slice of texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path, self.tokenizer = path, Tokenizer.from_file(path)
        chooser = np.random.default_rng(9)
        self.tables = [chooser.integers(0, 1 << 64, MAX_BYTES * 256, dtype=np.uint64) for _ in range(2)]
        self.keys, self.checks = np.zeros(KNOWN_SLOTS, dtype=np.uint64), np.zeros(KNOWN_SLOTS, dtype=np.uint64)
        self.sizes, self.ids = np.zeros(KNOWN_SLOTS, dtype=np.uint8), np.zeros((KNOWN_SLOTS, KNOWN_IDS), dtype=np.min_scalar_type(max(self.tokenizer.get_vocab().values())))

    def _known(self, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Slot of each word, whether it lies there, how many ids it then has, and the ids of all such words in a row."""
        slot = (key & np.uint64(KNOWN_SLOTS - 1)).astype(np.int64)
        there = (self.sizes[slot] > 0) & (self.keys[slot] == key) & (self.checks[slot] == check)
        sizes = np.where(there, self.sizes[slot], 0).astype(np.int64)
        rows = self.ids[slot[there]]
        return slot, there, sizes, rows[np.arange(KNOWN_IDS) < sizes[there][:, None]].astype(np.uint32)

    def _learn(self, slot: np.ndarray, key: np.ndarray, check: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Put words with their ids, given in a row, into their slots; of several words of one slot the first."""
        begins = np.cumsum(sizes) - sizes
        short = np.flatnonzero((sizes > 0) & (sizes <= KNOWN_IDS))
        slot, first = np.unique(slot[short], return_index=True)
        some = short[first]
        self.keys[slot], self.checks[slot], self.sizes[slot] = key[some], check[some], sizes[some]
        if len(some):
            self.ids[slot] = ids[np.minimum(begins[some][:, None] + np.arange(KNOWN_IDS), len(ids) - 1)]

    def _ids_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has."""
        text = b" ".join(words).decode("utf-8")
        encoding = self.tokenizer.encode(text, add_special_tokens=False)
        ids = np.array(encoding.ids, dtype=np.uint32)
        begins = np.zeros(len(words) + 1, dtype=np.int64)
        np.cumsum(np.fromiter((len(w) + 1 for w in text.split(" ")), dtype=np.int64, count=len(words)), out=begins[1:])
        at = np.fromiter((o[0] for o in encoding.offsets), dtype=np.int64, count=len(ids))
        return ids, np.diff(np.searchsorted(at, begins, side="left"))

    def _fresh(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        parts = [self._ids_of(words[k : k + WORDS_AT_ONCE]) for k in range(0, len(words), WORDS_AT_ONCE)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        raw = [(t or "").encode("utf-8") for t in texts]
        odd = [b"<|" in r for r in raw]
        if any(odd) or any(len(r) > LONG_BYTES for r in raw):
            parts = [self._encode_long(r, o) for r, o in zip(raw, odd, strict=True)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        return self._encode_raw(raw, False)

    def _encode_long(self, raw: bytes, as_is: bool) -> tuple[np.ndarray, np.ndarray]:
        """One text in portions that end at white space, so that memory is bounded by its longest word."""
        parts, begin = [], 0
        while begin < len(raw):
            gap = GAP.search(raw, min(begin + LONG_BYTES, len(raw)))
            end = gap.end() if gap else len(raw)
            parts.append(self._encode_raw([raw[begin:end]], as_is)[0])
            begin = end
        ids = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)
        return ids, np.array([len(ids)])

    def _encode_raw(self, raw: list[bytes], as_is: bool) -> tuple[np.ndarray, np.ndarray]:
        joined = b" ".join(raw)
        ends_of_texts = np.cumsum([len(r) + 1 for r in raw])
        joined = joined if as_is else joined.lower()
        kinds = BYTE_KINDS[np.frombuffer(joined, dtype=np.uint8)]
        body = kinds != SPACE
        first = body.copy()
        first[1:] &= ~body[:-1] if as_is else ~body[:-1] | (kinds[:-1] == LETTER) & (kinds[1:] == MARK)
        starts = np.flatnonzero(first)
        n = len(starts)
        if not n:
            return np.zeros(0, dtype=np.uint32), np.zeros(len(raw), dtype=np.int64)
        inside = np.flatnonzero(body)
        lead = np.searchsorted(inside, starts).astype(np.int64)
        lengths = np.diff(np.append(lead, len(inside)))
        place = np.arange(len(inside), dtype=np.int64) - np.repeat(lead, lengths)
        cell = np.minimum(place, MAX_BYTES - 1) * 256 + np.frombuffer(joined, dtype=np.uint8)[inside]
        key, check = (np.add.reduceat(t[cell], lead) for t in self.tables)
        del cell, place, inside
        different, sample, of = np.unique(key, return_index=True, return_inverse=True)
        slot, known, sizes, ids = self._known(different, check[sample])
        begins, store, total = np.cumsum(sizes) - sizes, [ids], len(ids)
        clash = check != check[sample][of]
        single = (lengths > MAX_BYTES) | clash  # encoded one by one, never kept
        kept = np.zeros(len(different), dtype=bool)
        kept[of[~single]] = True
        new = np.flatnonzero(~known & kept)
        word = lambda i: joined[starts[i] : starts[i] + lengths[i]]
        if len(new):
            spans = zip(starts[sample[new]].tolist(), lengths[sample[new]].tolist(), strict=True)
            ids, counts = self._fresh([joined[s : s + k] for s, k in spans])
            begins[new], sizes[new] = total + np.cumsum(counts) - counts, counts
            store.append(ids)
            total += len(ids)
            self._learn(slot[new], different[new], check[sample[new]], ids, counts)
        word_begin, word_size = begins[of], sizes[of]
        for i in np.flatnonzero(single).tolist():
            ids, counts = self._ids_of([word(i)])
            word_begin[i], word_size[i] = total, counts[0]
            store.append(ids)
            total += len(ids)
        everything = np.concatenate(store)
        out = everything[np.repeat(word_begin - (np.cumsum(word_size) - word_size), word_size) + np.arange(int(word_size.sum()))]
        before = np.concatenate([[0], np.cumsum(word_size)])
        return out, np.diff(before[np.searchsorted(starts, np.concatenate([[0], ends_of_texts]))])


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of this tokenizer."""
    return held("tokens", lambda e: e.path == path, lambda: WordEncoder(path))


def _chunks(texts: pa.Array, most_bytes: int = 3 << 19):
    """Consecutive slices of at most so many bytes, at least a row each."""
    total = np.concatenate([[0], np.cumsum(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False)))])
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(total, total[begin] + most_bytes, side="right")) - 1)
        yield begin, texts.slice(begin, end - begin).to_pylist()
        begin = end


TOKEN_FILE_SCHEMA = "doc_id long, part int, local_start long, n_tokens long, tokens array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> None:
    """Encode every whole text, append end_id and write the ids as a token file set in ascending order of id_col."""
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("tokens", pa.list_(pa.int32()))])

    def encode(batches):
        words, part, start = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for begin, texts in _chunks(batch.column(1)):
                ids, sizes = words.encode(texts)
                ids = np.insert(ids, np.cumsum(sizes), end_id)
                sizes = sizes + 1
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                tokens = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(texts)), pa.array([part] * len(texts), pa.int32()), pa.array(start + offsets[:-1]), pa.array(sizes), tokens], schema=schema)
                start += int(offsets[-1])

    spark = docs.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    writer = ordered.mapInArrow(encode, TOKEN_FILE_SCHEMA).write
    for key, value in (("parquet.block.size", ROW_GROUP_BYTES), ("parquet.page.size", PAGE_BYTES), ("parquet.enable.dictionary", "false"), ("parquet.writer.version", "v2"), ("compression", "snappy")):
        writer = writer.option(key, str(value))
    writer.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a token file set: one per document, with its id list."""
    return spark.read.schema(TOKEN_FILE_SCHEMA).parquet(path)


def read_ids(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of a few documents. The ids go down to the scan, which reads only row groups and pages whose ranges can hold them."""
    return read_tokens(spark, path).where(F.col("doc_id").isin(*doc_ids))


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and n_tokens of every document; the pages of the id lists stay unread."""
    return read_tokens(spark, path).select("doc_id", "n_tokens")


def part_starts(files: DataFrame) -> DataFrame:
    """part, base: ids in all ranges before it. Reads the count columns only; one row per file."""
    totals = files.groupBy("part").agg(F.min("doc_id").alias("first_id"), F.sum("n_tokens").alias("total"))
    before = Window.orderBy(F.col("first_id").asc_nulls_first(), "part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).cast("long").alias("base"))


def digest(files: DataFrame) -> DataFrame:
    """Per document of a token file set: doc_id, start, n_tokens and the unsigned crc32 of its ids, all from the id lists read."""

    def crc(batches):
        for b in batches:
            lists = b.column("tokens")
            raw = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), dtype="<i4").tobytes()
            ends = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64))]) * 4
            view = memoryview(raw)
            sums = [zlib.crc32(view[x:y]) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), b.column("local_start"), pa.array((ends[1:] - ends[:-1]) // 4), pa.array(sums, pa.int64())], names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])

    rows = files.mapInArrow(crc, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    return rows.join(part_starts(files), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, encoded, written as a token file set in the shared folder and read back."""
    import public_tokenizers

    path = fresh_path(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return digest(read_tokens(spark, path))
