import json
import random
import re
import time

import pytest

from tracewright.functions import answers as a
from tracewright.schemas import INVALID

F = "```"
URL = f'{F}json\n{{"u": "http://x"}}\n{F}'
CASES = [
    ("clean", f'{F}json\n{{"a": 1}}\n{F}', {"a": 1}, {"a": 1}),
    ("url", URL, None, {"u": "http://x"}),
    ("comment", f'{F}json\n{{"a": 1}} // one\n{F}', {"a": 1}, {"a": 1}),
    ("comment and url", f'{F}json\n{{"u": "http://x" // one\n}}\n{F}', None, None),
    ("plain fence", f'{F}\n{{"a": 1}}\n{F}', {"a": 1}, {"a": 1}),
    ("no object", f'{F}json\n"Sinks": [["a"]]\n{F}', None, None),
    ("bare", '{"a": 1}', {"a": 1}, {"a": 1}),
    ("two blocks", f'{F}json\n{{"a": 1}}\n{F}\n{F}json\n{{"a": 2}}\n{F}', {"a": 2}, {"a": 2}),
    ("last is broken", f'{F}json\n{{"a": 1}}\n{F}\n{F}json\n{{a}}\n{F}', {"a": 1}, {"a": 1}),
    ("boxed", "so $\\boxed{ {\"a\": 1} }$", {"a": 1}, {"a": 1}),
    ("prose", 'it is {"a": 1} I think', {"a": 1}, {"a": 1}),
    ("two objects", '{"a": 1} and {"a": 2}', None, None),
    ("repeated key", '{"a": 1, "a": 2}', {"a": 2}, {"a": 2}),
    ("single quotes", "{'a': 1}", None, None),
    ("windows lines", f'{F}json\r\n{{"a": 1}}\r\n{F}', {"a": 1}, {"a": 1}),
    ("sentinel", "no top_similar found", None, None),
]


def value(text, mode):
    v = a.extract(text, mode)
    return None if v is a.MISSING else v


@pytest.mark.parametrize("name,text,post,pre", CASES, ids=[c[0] for c in CASES])
def test_extract(name, text, post, pre):
    assert value(text, "post") == post
    assert value(text, "pre") == pre


def test_relaxed_and_first():
    assert value('x {"a": [1, 2,],} y', "relaxed") == {"a": [1, 2]}
    assert value('x {"a": [1, 2,],} y', "post") is None
    assert value(f'{F}json {{"a": 1}}{F}', "relaxed") == {"a": 1}
    assert value(f'{F}\n{{"a": 1}}\n{F}\n{F}\n{{"a": 2}}\n{F}', "first") == {"a": 1}


@pytest.mark.parametrize(
    "text,sinks",
    [('{"Sinks": []}', []), ('{"Sinks": [[]]}', [""]), ('{"Sinks": [["a", 1]]}', []), ('{"Sinks": ["abc"]}', ["a\nb\nc"]), ("None", []), ("null", []), ("[1]", []), (None, []), ('{"Sinks": [["a", "b"], ["c"]]}', ["a\nb", "c"]), ('{"x": 1}', [])],
)
def test_sinks(text, sinks):
    assert a.sinks_of(text) == sinks


def test_level_and_dumps():
    assert a.level_of({"access_control_level": 3}) == "3"
    assert a.level_of([1]) == a.level_of(None) == a.level_of({}) == INVALID
    assert a.dumps(None) == "None" and a.dumps({"a": [1]}) == '{"a": [1]}'


def test_columns(spark):
    rows = [(c[1],) for c in CASES] + [(None,)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select(a.extract_json(df.t, "post").alias("j")).collect()
    assert [None if r.j is None else json.loads(r.j) for r in got] == [c[2] for c in CASES] + [None]
    levels = spark.createDataFrame([('{"access_control_level": "NONE"}',), (None,), ("x",)], "t string")
    assert [r[0] for r in levels.select(a.access_level(levels.t)).collect()] == ["NONE", INVALID, INVALID]
    s = spark.createDataFrame([('{"Sinks": [["a"], ["b", "c"]]}',), ("bad",)], "t string")
    assert [r[0] for r in s.select(a.parse_sinks(s.t)).collect()] == [r[0] for r in s.select(a.parse_sinks_native(s.t)).collect()] == [["a", "b\nc"], []]


def test_answers_that_break_the_parser(spark):
    """One bad answer costs one row: numbers of too many digits, brackets that are too deep."""
    bad = ["1" * 5000, '{"a": ' + "9" * 5000 + "}", "[" * 100_000, '{"Sinks": ' + "[" * 100_000, "{" * 50_000]
    for t in bad:
        assert all(value(t, m) is None for m in ("post", "pre", "relaxed", "first")) and a.sinks_of(t) == []
    df = spark.createDataFrame([(t,) for t in [*bad, '{"Sinks": [["x"]]}']], "t string")
    got = df.select(a.extract_json(df.t, "relaxed").alias("j"), a.parse_sinks(df.t).alias("s"), a.access_level(df.t).alias("l")).collect()
    assert [r.j for r in got] == [None] * len(bad) + ['{"Sinks": [["x"]]}'] and [r.s for r in got][-1] == ["x"] and {r.l for r in got} == {INVALID}


@pytest.mark.parametrize("text", ["$\\boxed{" * 16_000, f"{F}json\nx" * 15_000, f"{F}json x" * 15_000, "{" * 140_000, "}$" * 70_000, f"{F}\n" * 30_000, "$ " * 70_000], ids=range(7))
def test_hostile_answers_take_linear_time(text):
    began = time.process_time()
    for mode in ("post", "pre", "relaxed", "first"):
        a.extract(text, mode)
    assert time.process_time() - began < 2.0


def test_blocks_match_the_lazy_patterns():
    pairs = [(a.JSON_FENCE, re.compile(r"```json\s*\n(.*?)```", re.S)), (a.ANY_FENCE, re.compile(r"```\s*\n(.*?)```", re.S)), (a.JSON_FENCE_LOOSE, re.compile(r"```json\s*(.*?)```", re.S)), (a.EITHER_FENCE, re.compile(r"```(?:json)?\n(.*?)\n```", re.S)), (a.BOXED, re.compile(r"\$\s*\\boxed\s*\{(.*?)\}\s*\$", re.S))]
    chooser = random.Random(1)
    for _ in range(4000):
        t = "".join(chooser.choice([F, "json", "\n", " ", "$", "\\boxed", "{", "}", "x"]) for _ in range(chooser.randrange(25)))
        for place, lazy in pairs:
            assert a.blocks(t, place) == lazy.findall(t)
        found = re.search(r"\{.*\}", t, re.S)
        assert a.braces(t) == ([found[0]] if found else [])


def test_native_sinks_agree_with_the_exact_parser(spark):
    texts = ['{"Sinks": []}', '{"Sinks": [[]]}', '{"Sinks": [["a", 1]]}', '{"Sinks": ["abc"]}', "None", "null", None, '{"Sinks": [["a","b"], ["c"]]}', '{"Sinks": [["a\\n"]]}', "{'Sinks': [['a']]}", '{"Sinks": [["a"]], "Sinks": [["b"]]}', '{"Sinks": [["a"],]}', '{"Sinks": [["a"]]} x', '{"Sinks": [["' + "y" * 9000 + '"]]}', '{"Sinks": [["a"' + ', "b"' * 700 + "]]}"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(a.parse_sinks_native(df.t).alias("n"), a.parse_sinks(df.t).alias("e")).collect()
    assert [r.n for r in got] == [r.e for r in got] == [a.sinks_of(t) for t in texts]
