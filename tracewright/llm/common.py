"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one does only if everything runs on
    one machine; a cluster would lose what its machines write there."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and drop its lineage; a lost executor then costs nothing that was done before."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path that fresh_path gave, once what was written there is read for the last time."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of its own in the shared folder: computed once, however often it is read, and of a size that Spark knows."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def held_out(doc_id: str = "doc_id"):
    """The test fold: crc32 of the id's decimal text leaves 2 on division by 4. A null id is in neither fold."""
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def word_count(text: str = "text"):
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(df: DataFrame, seed: int):
    """A seeded hash of a row's columns; maps and variants, which Spark does not hash, by their text."""
    unhashed = ("map<", "variant")
    columns = [F.col(f"`{f.name}`") for f in df.schema.fields]
    texts = [c.cast("string") if any(u in f.dataType.simpleString() for u in unhashed) else c for c, f in zip(columns, df.schema.fields, strict=True)]
    return F.xxhash64(F.lit(seed), *texts)


def without(df: DataFrame, *names: str, keep: str = "") -> DataFrame:
    """df without the columns, in any case of letters, whose names an operator gives to its own; keep stays."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low and c != keep])


def portions(batches, place: int, most_bytes: int = 2 << 20, most_rows: int = 512):
    """Arrow batches in slices of at most so many rows and bytes of text (a row at least), so that the Python objects of a task are those of
    a few texts, however long the texts of a batch are."""
    for b in batches:
        lengths = pc.fill_null(pc.binary_length(b.column(place)), 0).to_numpy(zero_copy_only=False)
        total = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        begin = 0
        while begin < b.num_rows:
            end = int(np.searchsorted(total, total[begin] + most_bytes, side="right")) - 1
            end = min(max(begin + 1, end), begin + most_rows)
            yield b.slice(begin, end - begin)
            begin = end


#: What this Python worker keeps between tasks: one model with its remembered words, that of the operator that ran last.
_HELD: dict[str, object] = {}


def held(name: str, fits, make):
    """The worker's object of this name, if fits(object) holds, else a new one in place of whatever is kept. Stages of a pipeline share
    workers, and so one stage's memory is given up for the next one's. (Tasks must call this by import: what their own functions refer to
    is copied for each.)"""
    found = _HELD.get(name)
    if found is None or not fits(found):
        _HELD.clear()
        found = _HELD[name] = make()
    return found


def overlap_test(spans: Iterable[tuple[int, int]]) -> Callable[[int, int], bool]:
    """Whether an interval (start, exclusive end) overlaps any of spans, in any order, by binary search."""
    starts: list[int] = []
    reach: list[int] = []
    for s, e in sorted(spans):
        starts.append(s)
        reach.append(max(e, reach[-1]) if reach else e)

    def overlaps(begin: int, end: int) -> bool:
        before = bisect_left(starts, end)
        return before > 0 and reach[before - 1] > begin

    return overlaps
