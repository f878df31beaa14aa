"""Tables in the folder that driver and executors share: what several steps read is computed once, and a lost executor costs none of it."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in spark.checkpoint.dir. Where none is named, one machine's temporary folder does only if everything runs on it; a
    cluster would lose what its machines write there."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not sc.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(root or tempfile.gettempdir()).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of its own in the shared folder: later readers see the same rows and values, read only the columns they need, and Spark
    knows its size."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes the tables of written() that df reads, which nobody reads any more."""
    spark = df.sparkSession
    for folder in sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()}):
        if re.search("-[0-9a-f]{32}$", folder):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query in here are deleted as it ends, not once the driver's garbage is collected."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_counted(df: DataFrame, path: str, counters: dict[str, Column]) -> tuple[DataFrame, dict[str, int]]:
    """df as a table at path, and how many of its rows pass each condition (a null does not), counted by the pass that writes them: neither a
    second read nor a second job. The counters belong to the writing stage, of which Spark takes one attempt a task, so a task that is tried again
    or a lost executor does not count twice."""
    seen = Observation()
    df.observe(seen, *[F.count_if(c).alias(name) for name, c in counters.items()]).write.parquet(path)
    found = seen.get if counters else {}
    return df.sparkSession.read.schema(df.schema).parquet(path), {name: int(found.get(name) or 0) for name in counters}
