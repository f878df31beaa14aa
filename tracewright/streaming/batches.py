"""Asynchronous batch jobs in steps that can be ended and taken up again at any point: plan, submit, poll, fetch, join.

A folder holds all that is known of a job: planned rows, each with its batch's key; an append-only ledger of what became of each batch; and fetched
results. Requests are planned once, so every later step works on the same batches. A task that submits a batch hands its key to the service,
which must give the same batch for the same key; so a batch is not sent twice, though the task may be ended between sending and noting it.
Prompts and results go between tasks and the service; the driver sees a row a batch.
"""

from __future__ import annotations

import time
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import journal
from tracewright.operators.running import numbered

#: States of a batch in the order in which it passes through them; the furthest noted one holds.
SUBMITTED, IN_PROGRESS, ENDED, FAILED, FETCHED = "submitted", "in_progress", "ended", "failed", "fetched"
STATES = (SUBMITTED, IN_PROGRESS, ENDED, FAILED, FETCHED)


class BatchService(Protocol):
    def submit(self, key: str, requests: list[dict]) -> str:
        """The batch of this key, made of requests (custom_id, prompt) if there is none yet."""

    def state(self, batch: str) -> str:
        """in_progress, ended or failed."""

    def results(self, batch: str) -> Iterable[dict]:
        """custom_id, type (succeeded, errored, expired, canceled) and text of each request of an ended batch."""


class CannedBatchService:
    """A service in a folder: a batch ends at its second poll; a request's type follows from its id's last digits, its text from its id."""

    TYPES = ("succeeded", "errored", "expired", "canceled")

    def __init__(self, folder: str):
        self.folder = folder

    def _noted(self, batch: str, what: str) -> list[dict]:
        return list(journal.records(f"{self.folder}/{batch}/{what}"))

    def submit(self, key: str, requests: list[dict]) -> str:
        if not self._noted(key, "requests"):
            with journal.Journal(f"{self.folder}/{key}/requests", 1 << 30) as own:
                for r in requests:
                    own.append(**r)
        return key

    def state(self, batch: str) -> str:
        with journal.Journal(f"{self.folder}/{batch}/polls") as own:
            own.append(poll=1)
        return ENDED if len(self._noted(batch, "polls")) > 1 else IN_PROGRESS

    def results(self, batch: str) -> Iterator[dict]:
        for r in self._noted(batch, "requests"):
            kind = self.TYPES[int(r["custom_id"]) % 4 if r["custom_id"].isdigit() else zlib.crc32(r["custom_id"].encode()) % 4]
            yield {"custom_id": r["custom_id"], "type": kind, "text": f"answer {r['custom_id']}" if kind == "succeeded" else None}


class BatchJob:
    """A job in a folder. Making another object for the same folder takes the job up where it was."""

    def __init__(self, spark: SparkSession, service: Callable[[], BatchService], folder: str, size: int = 10_000):
        self.spark, self.service, self.folder, self.size = spark, service, folder, size

    def _table(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(path)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def planned(self) -> DataFrame:
        return self._table("planned", "key string, custom_id string, prompt string")

    def batches(self) -> DataFrame:
        """key, batch and state of every batch that was submitted."""
        rank = F.array_position(F.array(*map(F.lit, STATES)), F.col("state"))
        noted = journal.table(self.spark, f"{self.folder}/ledger", "key string, batch string, state string")
        return noted.groupBy("key").agg(F.max("batch").alias("batch"), F.max_by("state", rank).alias("state"))

    def plan(self, requests: DataFrame) -> None:
        """Deal requests (custom_id, prompt) that are not planned yet, or whose batch failed, to batches of bounded size."""
        lost = self.batches().where(F.col("state") == FAILED).select("key")
        known = self.planned().join(lost, "key", "left_anti").select("custom_id", "prompt")
        new = numbered(requests.select("custom_id", "prompt").join(known, ["custom_id", "prompt"], "left_anti"), "custom_id")
        key = F.concat(F.lit(f"{uuid.uuid4().hex}-"), F.floor(F.col("__n") / self.size).cast("long").cast("string"))
        new.select(key.alias("key"), "custom_id", "prompt").write.mode("append").parquet(f"{self.folder}/planned")

    def submit(self) -> None:
        """Hand every planned batch that the ledger does not have to the service, a batch a group of its own."""
        service, ledger = self.service, f"{self.folder}/ledger"

        def send(batch: pd.DataFrame) -> pd.DataFrame:
            key, rows = batch["key"].iloc[0], batch.sort_values("custom_id")
            made = service().submit(key, rows[["custom_id", "prompt"]].to_dict("records"))
            with journal.Journal(ledger) as own:
                own.append(key=key, batch=made, state=SUBMITTED)
            return pd.DataFrame({"key": [key]})

        left = self.planned().join(self.batches().select("key"), "key", "left_anti")
        left.groupBy("key").applyInPandas(send, "key string").write.format("noop").mode("overwrite").save()

    def poll(self, rounds: int | None = None, interval: float = 5.0, sleep: Callable[[float], None] = time.sleep) -> int:
        """Ask after batches that have not ended, at most so many times each, and note what changed. How many are still open."""
        service = self.service()
        with journal.Journal(f"{self.folder}/ledger") as own:
            left = {r["key"]: r for r in self.batches().where(F.col("state").isin(SUBMITTED, IN_PROGRESS)).collect()}  # a row a batch
            while left and rounds != 0:
                for key, r in list(left.items()):
                    now = service.state(r["batch"])
                    if now != IN_PROGRESS:
                        own.append(key=key, batch=r["batch"], state=now)
                        del left[key]
                rounds = None if rounds is None else rounds - 1
                if left and rounds != 0:
                    sleep(interval)
        return len(left)

    def fetch(self) -> None:
        """Write the results of ended batches that were not fetched yet."""
        service = self.service
        ended = [(r["key"], r["batch"]) for r in self.batches().where(F.col("state") == ENDED).collect()]
        if not ended:
            return

        def read(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                for key, batch in zip(pdf["key"], pdf["batch"], strict=True):
                    rows = [(key, r["custom_id"], r["type"], r["text"]) for r in service().results(batch)]  # at most size
                    yield pd.DataFrame(rows, columns=["key", "custom_id", "type", "text"])

        todo = self.spark.createDataFrame(ended, "key string, batch string").repartition(min(len(ended), 1000), "key")
        todo.mapInPandas(read, "key string, custom_id string, type string, text string").write.mode("append").parquet(f"{self.folder}/results")
        with journal.Journal(f"{self.folder}/ledger") as own:
            for key, batch in ended:
                own.append(key=key, batch=batch, state=FETCHED)

    def results(self) -> DataFrame:
        """custom_id, prompt, type and text of every request with a result; a batch that was fetched twice counts once."""
        found = self._table("results", "key string, custom_id string, type string, text string").dropDuplicates(["key", "custom_id"])
        return self.planned().join(found, ["key", "custom_id"]).select("custom_id", "prompt", "type", "text")
