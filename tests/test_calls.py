"""Calls that cost money: none is repeated when tasks, jobs or drivers end halfway."""

import os
import subprocess
import sys
import textwrap
import threading
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tracewright.functions import journal, models
from tracewright.streaming.batches import BatchJob, CannedBatchService

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


class Counted:
    """Notes every call; ends its process at a prompt that was not asked before, once."""

    def __init__(self, folder, deadly=()):
        self.folder, self.deadly = folder, deadly

    def chat(self, system, user, timeout=None):
        mark = os.path.join(self.folder, "died-" + user)
        if user in self.deadly and not os.path.exists(mark):
            open(mark, "w").close()
            os._exit(1)
        if user == "bad":
            raise RuntimeError
        with journal.Journal(os.path.join(self.folder, "calls")) as own:
            own.append(user=user)
        return f"said {user}"


def calls(folder):
    return Counter(r["user"] for r in journal.records(os.path.join(folder, "calls")))


def test_journal(tmp_path, spark):
    folder = f"file:{tmp_path}/log"
    assert list(journal.records(folder)) == [] and journal.table(spark, folder, "a string").collect() == []
    with journal.Journal(folder, rows_a_file=2) as own:
        for a in ("x", "line\nfeed", "é", 'quo"te', "\\"):
            own.append(a=a)
    (tmp_path / "log" / "torn.jsonl").write_text('{"a": "y"}\n{"a": "tor')
    want = sorted(["x", "line\nfeed", "é", 'quo"te', "\\", "y"])
    assert sorted(r["a"] for r in journal.records(folder)) == want == sorted(r.a for r in journal.table(spark, folder, "a string").collect())
    assert len(list((tmp_path / "log").iterdir())) == 4


def test_a_job_that_died_repeats_no_call(spark, tmp_path):
    """local[4] tries no task again: the first run fails with the worker, the second makes only the calls that are missing."""
    folder, log = str(tmp_path), str(tmp_path / "log")
    df = spark.createDataFrame([(i, f"p{i}") for i in range(60)] + [(60, None), (61, "bad"), (62, "p0")], "k long, prompt string").repartition(3, "k")
    run = lambda: models.chat_logged(df, ["k"], lambda: Counted(folder, ("p40",)), "s", "prompt", "res", log)
    with pytest.raises(Exception, match="crashed|exited|Python worker"):
        run()
    before = calls(folder)
    assert before and max(before.values()) == 1
    got = {r.k: r.res for r in run().collect()}
    assert got == {**{i: f"said p{i}" for i in range(60)}, 60: None, 61: "invalid", 62: "said p0"}
    assert calls(folder) == Counter({f"p{i}": 1 for i in range(60)}) + Counter(["p0"])
    assert run().where("res = 'invalid'").count() == 1 and sum(calls(folder).values()) == 61


def test_a_task_that_is_tried_again_repeats_no_call(tmp_path):
    script = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {HERE!r})
        from pyspark.sql import SparkSession
        from tests.test_calls import Counted
        from tracewright.functions import models
        spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).getOrCreate()
        df = spark.createDataFrame([(i, f"p{{i}}") for i in range(40)], "k long, prompt string").repartition(2, "k")
        out = models.chat_logged(df, ["k"], lambda: Counted({str(tmp_path)!r}, ("p9", "p30")), "s", "prompt", "res", {str(tmp_path / "log")!r})
        assert sorted(r.res for r in out.collect()) == sorted(f"said p{{i}}" for i in range(40))
    """)
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": HERE}, cwd=tmp_path)
    assert done.returncode == 0, done.stderr[-2000:]
    assert os.path.exists(tmp_path / "died-p9") and os.path.exists(tmp_path / "died-p30")
    assert calls(str(tmp_path)) == Counter({f"p{i}": 1 for i in range(40)})


class Unsteady(CannedBatchService):
    """Ends the submitting process after the service has the batch, once; one batch fails."""

    def submit(self, key, requests):
        made = super().submit(key, requests)
        mark = os.path.join(self.folder, "died")
        if not os.path.exists(mark):
            open(mark, "w").close()
            os._exit(1)
        return made

    def state(self, batch):
        first = os.path.join(self.folder, "failed")
        if not os.path.exists(first):
            open(first, "w").write(batch)
        return "failed" if open(first).read() == batch else super().state(batch)


def test_batches_survive_restarts(spark, tmp_path):
    os.makedirs(tmp_path / "service")
    df = spark.createDataFrame([(i, f"p{i}") for i in range(95)] + [(95, None)], "k long, prompt string")
    requests = models.batch_requests(df, "prompt", "k")
    job = lambda: BatchJob(spark, lambda: Unsteady(str(tmp_path / "service")), str(tmp_path / "job"), 10)
    job().plan(requests.where("custom_id < 50"))
    with pytest.raises(Exception, match="crashed|exited|Python worker"):
        job().submit()
    job().submit()
    job().plan(requests)
    job().submit()
    assert job().batches().count() == 10  # 5 of the first plan, 5 of the second
    assert job().poll(rounds=1) == 9
    job().fetch()
    assert job().results().count() == 0
    assert job().poll(sleep=lambda s: None) == 0
    job().fetch()
    assert 80 <= job().results().count() < 95  # late results are still to come: the batch that failed is planned anew
    job().plan(requests)
    job().submit()
    job().poll(sleep=lambda s: None)
    job().fetch()
    job().fetch()
    sent = [list(journal.records(str(p / "requests"))) for p in (tmp_path / "service").iterdir() if p.is_dir()]
    assert len(sent) == 11 and all(len({r["custom_id"] for r in s}) == len(s) <= 10 for s in sent)
    got = {r.k: r.res for r in models.batch_results(df, job().results(), "k", "res").collect()}
    said = {0: "answer {}", 1: "Error: request errored", 2: "Error: request expired", 3: "Error: unknown result type"}
    assert got == {**{i: said[i % 4].format(i) for i in range(95)}, 95: None}
    assert job().results().groupBy("custom_id").count().where(F.col("count") > 1).count() == 0


class Hanging:
    """Never answers, but for prompts that begin with a capital."""

    def chat(self, system, user, timeout=None):
        if not user[:1].isupper():
            HOLD.wait(60)
        return f"said {user}"

    def generate(self, system, prompts):
        return [self.chat(system, p) for p in prompts]


HOLD = threading.Event()


def test_hanging_calls_are_bounded():
    HOLD.clear()
    before, threads = threading.active_count(), 4
    with ThreadPoolExecutor(threads) as pool:

        def one(k):
            try:
                return models.within(0.02, lambda: Hanging().chat("", f"x{k}"))
            except TimeoutError:
                return None

        assert list(pool.map(one, range(200))) == [None] * 200
        assert threading.active_count() - before <= models.HANGING + 2 * threads
    with pytest.raises(TimeoutError):
        models.within(0.02, lambda: "not begun")
    HOLD.set()
    assert models.within(5, lambda: "begun again") == "begun again"
    assert models._left.n == 0


def test_a_few_hanging_calls_hinder_no_others(spark):
    df = spark.createDataFrame([(k, f"x{k}" if k % 10 == 0 else f"X{k}") for k in range(60)], "k int, prompt string").coalesce(1)
    rows = models.chat(df, Hanging, "", "prompt", "answer", threads=4, timeout=2.0, on_failure="none").collect()
    assert {r.k: r.answer for r in rows} == {k: "none" if k % 10 == 0 else f"said X{k}" for k in range(60)}


def test_generate_has_a_limit(spark):
    df = spark.createDataFrame([(k, f"x{k}" if k == 3 else f"X{k}") for k in range(8)], "k int, prompt string")
    rows = models.generate(df, lambda device: Hanging(), ["one"], "", "prompt", "answer", batch=1, on_failure="none", timeout=2.0).collect()
    assert {r.k: r.answer for r in rows} == {k: "none" if k == 3 else f"said X{k}" for k in range(8)}
