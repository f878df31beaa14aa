"""Language models and embedders as injected clients, called in batches inside partitions.

Clients are made by a factory once per Python worker. The stand-ins here are deterministic and need no network. Calls have side effects in
use: chat_logged keeps a log, so that a retried task or run repeats none; of the other forms write the output right away and key it by row, as a
retried task repeats calls, but not rows.
"""

from __future__ import annotations

import functools
import hashlib
import json
import math
import re
import string
import threading
import time
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol, TypeVar

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions import journal
from tracewright.schemas import INVALID, LEVELS
from tracewright.shared import written


Result = TypeVar("Result")


class ModelClient(Protocol):
    def chat(self, system: str, user: str, timeout: float | None = None) -> str: ...


class BatchModel(Protocol):
    """A model in the worker's own process, on one device."""

    def generate(self, system: str, prompts: list[str]) -> list[str]: ...


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class CannedClient:
    """Answers that follow from a hash of the prompt: sinks from its lines, or a level."""

    def __init__(self, kind: str = "sinks", delay: float = 0.0):
        self.kind, self.delay = kind, delay

    def chat(self, system: str, user: str, timeout: float | None = None) -> str:
        if timeout is not None and self.delay > timeout:
            raise TimeoutError
        if self.delay:
            time.sleep(self.delay)
        lot = int.from_bytes(hashlib.blake2b(f"{system}\0{user}".encode(), digest_size=4).digest(), "big")
        if self.kind == "sinks":
            lines = [x.strip() for x in user.split("\n") if re.search(r"\w\(.*\);?$", x.strip())]
            answer = {"Sinks": [[x] for x in lines[-2:][::-1]]}
        else:
            answer = {"access_control_level": LEVELS[lot % len(LEVELS)]}
        return f"Here is the answer.\n```json\n{json.dumps(answer)}\n```"


class CannedBatchModel:
    """CannedClient's answers, a batch at a time, as a model on a device."""

    def __init__(self, device: str, kind: str = "sinks"):
        self.device, self.client = device, CannedClient(kind)

    def generate(self, system: str, prompts: list[str]) -> list[str]:
        return [self.client.chat(system, p) for p in prompts]


class HashedEmbedder:
    """Counts of hashed character 3-grams, scaled to length 1; texts are cut at max_tokens words."""

    def __init__(self, size: int = 64, max_tokens: int = 512):
        self.size, self.max_tokens = size, max_tokens

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            body, v = " ".join((t or "").split()[: self.max_tokens]), [0.0] * self.size
            for i in range(max(1, len(body) - 2)):
                v[zlib.crc32(body[i : i + 3].encode()) % self.size] += 1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out


class LetterEmbedder:
    """Counts of the letters a to z, whatever their case: vectors that SQL can make too."""

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[float(low.count(c)) for c in string.ascii_lowercase] for low in (t.lower() for t in texts)]


#: Calls of one worker that may hang on, after their time, before further calls have to wait for one of them to end.
HANGING = 16


class _LeftBehind:
    """Counts this worker's calls that took longer than they may and still run."""

    def __init__(self):
        self.n, self.changed = 0, threading.Condition()


_left = _LeftBehind()


def within(seconds: float | None, call: Callable[[], Result], hanging: int = HANGING) -> Result:
    """call's result; TimeoutError if it takes longer, whether or not the call itself keeps a limit. A call that hangs is left behind in a thread
    that ends with it or with the worker. While `hanging` of them are there, as where a server is dead, a new call is not begun before one ends, and
    fails if none does in its time: a worker never has more than these and the calls that it makes at a time."""
    if seconds is None:
        return call()
    until = time.monotonic() + seconds
    with _left.changed:
        if not _left.changed.wait_for(lambda: _left.n < hanging, seconds):
            raise TimeoutError
    box: list = []
    given_up = False

    def run() -> None:
        try:
            found = (True, call())
        except BaseException as e:
            found = (False, e)
        with _left.changed:
            box.append(found)
            if given_up:
                _left.n -= 1
                _left.changed.notify_all()

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(max(0.0, until - time.monotonic()))
    with _left.changed:
        if not box:
            given_up = True
            _left.n += 1
            raise TimeoutError
    done, value = box[0]
    if not done:
        raise value
    return value


def chat(df: DataFrame, client: Callable[[], ModelClient], system: str, prompt_col: str, out_col: str, threads: int = 1, timeout: float | None = None, on_failure: str | None = INVALID) -> DataFrame:
    """df with the model's answer to every prompt. Each partition runs `threads` calls at a time (partitions at work times threads is the
    load on the server). A null prompt is not sent and has a null answer; a call that takes longer than the timeout, which the client is told and
    the engine keeps, or one that fails, gives on_failure."""

    def answered(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = client()

        def one(prompt):
            if prompt is None:
                return None
            try:
                return within(timeout, lambda: model.chat(system, prompt, timeout))
            except Exception:  # any failure of a call becomes the row's sentinel
                return on_failure

        with ThreadPoolExecutor(max_workers=max(1, threads)) as pool:
            for pdf in frames:
                yield pdf.assign(**{out_col: list(pool.map(one, pdf[prompt_col].where(pdf[prompt_col].notna(), None)))})

    return df.mapInPandas(answered, T.StructType([*df.schema.fields, T.StructField(out_col, T.StringType())]))


def chat_logged(df: DataFrame, keys: list[str], client: Callable[[], ModelClient], system: str, prompt_col: str, out_col: str, log: str, threads: int = 1, timeout: float | None = None, on_failure: str | None = INVALID) -> DataFrame:
    """chat with a log of answers: an answer is appended to log by the task that got it before the next call of its thread, and no call whose answer
    is there is made again, be it that a task is tried again, that the job failed or was ended, or that a later run meets the same rows. A call is told by
    the row's keys, the system text and the prompt. Failed calls are not logged: they have on_failure in this run and are made again in the next.

    Rows are written before the first call, so that a task which is tried again has the same ones; it reads the log of its own share. What other
    runs have logged is joined by the call's digest. The result is a written table.
    """
    called = F.sha2(F.concat_ws("\x1f", F.to_json(F.struct(*keys)), F.lit(system), F.col(prompt_col)), 256)
    rows = df.withColumn("__call", F.when(F.col(prompt_col).isNotNull(), called))
    known = journal.table(df.sparkSession, log, "call string, answer string").groupBy(F.col("call").alias("__known_call")).agg(F.min("answer").alias("__known"))
    rows = written(rows.join(known, F.col("__call") == F.col("__known_call"), "left").drop("__known_call"), "asked")
    run = f"{log}/run-{uuid.uuid4().hex}"

    def answered(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, share = client(), f"{run}/part-{TaskContext.get().partitionId()}"
        before = {r["call"]: r["answer"] for r in journal.records(share)}
        with journal.Journal(share) as own, ThreadPoolExecutor(max_workers=max(1, threads)) as pool:

            def one(row):
                prompt, call, answer = row
                if call is None or answer is not None:
                    return answer
                if call in before:
                    return before[call]
                try:
                    said = within(timeout, lambda: model.chat(system, prompt, timeout))
                except Exception:  # as in chat
                    return on_failure
                own.append(call=call, answer=said)
                return said

            for pdf in frames:
                asked = pdf[[prompt_col, "__call", "__known"]].astype(object).where(lambda x: x.notna(), None)
                yield pdf.drop(columns=["__call", "__known"]).assign(**{out_col: list(pool.map(one, asked.itertuples(index=False, name=None)))})

    return written(rows.mapInPandas(answered, T.StructType([*df.schema.fields, T.StructField(out_col, T.StringType())])), "answered")


def generate(df: DataFrame, model: Callable[[str], BatchModel], devices: list[str], system: str, prompt_col: str, out_col: str, batch: int = 32, on_failure: str | None = INVALID, timeout: float | None = None) -> DataFrame:
    """df with the answers of models in the workers' own processes: one partition and one model a device, prompts in batches. Null
    prompts are not sent; the rows of a batch that fails, or takes longer than the timeout, get on_failure."""

    def answered(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = None
        for pdf in frames:
            own = own or model(devices[TaskContext.get().partitionId() % len(devices)])
            prompts = [None if pd.isna(p) else p for p in pdf[prompt_col]]
            sent, said = [p for p in prompts if p is not None], []
            for at in range(0, len(sent), batch):
                some = sent[at : at + batch]
                try:
                    got = within(timeout, functools.partial(lambda model, sent: list(model.generate(system, sent)), own, some))
                except Exception:  # any failure of a batch becomes its rows' sentinel
                    got = []
                said += got if len(got) == len(some) else [on_failure] * len(some)
            answers = iter(said)
            yield pdf.assign(**{out_col: [None if p is None else next(answers) for p in prompts]})

    dealt = df.repartition(len(devices))
    return dealt.mapInPandas(answered, T.StructType([*df.schema.fields, T.StructField(out_col, T.StringType())]))


def embed(df: DataFrame, embedder: Callable[[], Embedder], text_col: str, out_col: str = "embedding") -> DataFrame:
    """df with a vector per text; null texts have null vectors."""

    def embedded(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = embedder()
        for pdf in frames:
            texts = [None if pd.isna(t) else t for t in pdf[text_col]]
            found = iter(model.embed([t for t in texts if t is not None]))
            yield pdf.assign(**{out_col: [None if t is None else next(found) for t in texts]})

    return df.mapInPandas(embedded, T.StructType([*df.schema.fields, T.StructField(out_col, T.ArrayType(T.DoubleType()))]))


def token_counts(c: Column, counter: Callable[[], Callable[[str], int]]) -> Column:
    """Number of tokens by an injected counter; the offline default is functions.text.token_count."""

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        count = counter()
        return texts.map(lambda t: 0 if t is None else count(t))

    return counted(c)


def encode_ids(c: Column, encoder: Callable[[], Callable[[str], list[int]]], most: int = 512, special: frozenset[int] = frozenset()) -> Column:
    """Token ids of a text by an injected encoder: without special ones, the first `most`; null text has none."""

    @F.pandas_udf("array<int>")
    def encoded(texts: pd.Series) -> pd.Series:
        encode = encoder()
        return texts.map(lambda t: [] if t is None else [i for i in encode(t) if i not in special][:most])

    return encoded(c)


#: What a batch service says of a request, and the text that stands for it.
BATCH_STATES = {"errored": "Error: request errored", "expired": "Error: request expired"}


def batch_requests(df: DataFrame, prompt_col: str, id_col: str) -> DataFrame:
    """First phase of an asynchronous batch: custom_id and prompt of each row to be sent."""
    return df.where(F.col(prompt_col).isNotNull()).select(F.col(id_col).cast("string").alias("custom_id"), F.col(prompt_col).alias("prompt"))


def batch_results(df: DataFrame, results: DataFrame, id_col: str, out_col: str, failed_text: bool = True) -> DataFrame:
    """Last phase: join results (custom_id, type, text) to rows by id. Unknown ids are skipped; failed_text puts a text for the failure
    in place of the answer, else it is null."""
    other = F.lit("Error: unknown result type")
    failed = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in BATCH_STATES.items() for x in kv]), F.col("type")), other)
    text = F.when(F.col("type") == "succeeded", F.col("text")).when(F.col("type").isNotNull(), failed if failed_text else F.lit(None))
    found = results.select("custom_id", text.alias(out_col))
    return df.join(found, df[id_col].cast("string") == found["custom_id"], "left").drop("custom_id")


def wait_for(state: Callable[[], str], interval: float = 5.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """Poll a batch from the driver until it has ended."""
    while (now := state()) not in ("ended", "failed", "canceled"):
        sleep(interval)
    return now
