"""JSON in free model text: finding it, parsing it strictly, and reading sinks and levels from it.

Parsing follows Python's json module, whose strictness no built-in of Spark shares (single quotes, trailing text, repeated keys, NaN);
so these are Arrow-batched pandas functions. An answer is looked for in stages; a mode says which stages there are, which cleaning each
candidate gets, and in which order the blocks of a stage are tried.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.schemas import INVALID

#: Fixed patterns of places where an answer may stand: what opens a block and what closes it.
JSON_FENCE = re.compile(r"```json\s*\n"), re.compile(r"```")
JSON_FENCE_LOOSE = re.compile(r"```json\s*"), re.compile(r"```")
ANY_FENCE = re.compile(r"```\s*\n"), re.compile(r"```")
EITHER_FENCE = re.compile(r"```(?:json)?\n"), re.compile(r"\n```")
BOXED = re.compile(r"\$\s*\\boxed\s*\{"), re.compile(r"\}\s*\$")
COMMENT = re.compile(r"//.*")
TRAILING_COMMA = re.compile(r",\s*([\]}])")
#: What Python's parser and writer raise on a text that is no JSON, has a number of too many digits, or brackets that are too deep.
NOT_JSON = (ValueError, RecursionError)


def blocks(text: str, place: tuple[re.Pattern, re.Pattern]) -> list[str]:
    """What stands between an opening and the next closing, one block after the other, in one pass over the text."""
    opening, closing = place
    out, at, end = [], 0, None
    while found := opening.search(text, at):
        if end is None or end.start() < found.end():
            end = closing.search(text, found.end())
        if end is None:
            break
        out.append(text[found.end() : end.start()])
        at = end.end()
    return out


def braces(text: str) -> list[str]:
    """From the first opening brace to the last closing one."""
    begin, end = text.find("{"), text.rfind("}")
    return [text[begin : end + 1]] if 0 <= begin < end else []


class MISSING:
    """Stands for no answer; a class, since one stays itself when functions are sent to workers."""


def strip_comments(text: str) -> str:
    return COMMENT.sub("", text)


def strip_trailing_commas(text: str) -> str:
    return TRAILING_COMMA.sub(r"\1", text)


def _unescape(text: str) -> str:
    return text.replace("\\{", "{").replace("\\}", "}")


@dataclass(frozen=True)
class Mode:
    """passes: cleanings of a candidate, one stage run each; first_fence: the pattern of tagged blocks."""

    passes: tuple
    first_fence: tuple
    boxed: tuple = ()
    braces: tuple = ()


MODES = {
    "post": Mode((strip_comments,), JSON_FENCE, boxed=(_unescape,)),
    "pre": Mode((str, strip_comments), JSON_FENCE),
    "relaxed": Mode((strip_comments,), JSON_FENCE_LOOSE, boxed=(_unescape,), braces=(strip_trailing_commas,)),
}


def _parsed(candidates: Iterator[str], steps: tuple):
    for text in candidates:
        for step in steps:
            text = step(text).strip()
        try:
            return json.loads(text)
        except NOT_JSON:
            continue
    return MISSING


def extract(text: str, mode: str = "post"):
    """The value of the first stage that yields one; MISSING if none does. A JSON null inside a block counts as none, as whole text it ends the search."""
    if mode == "first":
        return _parsed(iter(blocks(text, EITHER_FENCE)[:1]), (str,))
    m = MODES[mode]
    tagged, fenced = blocks(text, m.first_fence)[::-1], blocks(text, ANY_FENCE)[::-1]
    stages = [(tagged, ()), (fenced, ()), ([text], None), (blocks(text, BOXED), m.boxed), (braces(text), m.braces)]
    for candidates, after in stages:
        for clean in m.passes:
            value = _parsed(iter(candidates), (clean, *(after or ())))
            if value is not MISSING and (value is not None or after is None):
                return value
    return MISSING


def dumps(value) -> str:
    """Objects and lists as JSON, other values as Python prints them."""
    return json.dumps(value) if isinstance(value, (dict, list)) else str(value)


def sinks_of(text: str | None, limit: int | None = None) -> list[str]:
    """Sinks of an answer in order, each one its lines joined; none for anything but an object whose sinks all consist of texts."""
    try:
        value = json.loads(text) if text is not None else None
        sinks = value.get("Sinks") if isinstance(value, dict) else None
        return ["\n".join(s) for s in sinks[:limit]] if isinstance(sinks, list) else []
    except (*NOT_JSON, TypeError):
        return []


def level_of(value) -> str:
    return str(value.get("access_control_level", INVALID)) if isinstance(value, dict) else INVALID


def extract_json(c: Column, mode: str = "post") -> Column:
    """JSON text of the answer found; null if there is none."""

    @F.pandas_udf("string")
    def found(texts: pd.Series) -> pd.Series:
        def one(t):
            value = MISSING if t is None else extract(t, mode)
            try:
                return None if value is MISSING else json.dumps(value)
            except NOT_JSON:
                return None

        return texts.map(one, na_action=None)

    return found(c)


def parse_sinks(c: Column, limit: int | None = None) -> Column:
    """Array of sinks of an answer's JSON text."""

    @F.pandas_udf("array<string>")
    def parsed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sinks_of(t, limit))

    return parsed(c)


#: An object of the key Sinks alone with a list of lists of plain texts, which both parsers read alike; longer ones go to the exact parser.
WELL_FORMED = r'^\{"Sinks": ?\[(?:\[(?:"[^"\\\x00-\x1f]*"(?:, ?"[^"\\\x00-\x1f]*")*)?\](?:, ?\[(?:"[^"\\\x00-\x1f]*"(?:, ?"[^"\\\x00-\x1f]*")*)?\])*)?\]\}$'
NATIVE_LENGTH = 4096


def parse_sinks_native(c: Column) -> Column:
    """The same by the JVM's parser for well-formed answers, which then need no Python; all others go to the exact parser."""
    good = F.coalesce((F.length(c) <= NATIVE_LENGTH) & c.rlike(WELL_FORMED), F.lit(False))
    parsed = F.from_json(F.when(good, c), "Sinks array<array<string>>", {"allowSingleQuotes": "false"})
    native = F.transform(parsed["Sinks"], lambda s: F.array_join(s, "\n"))
    return F.when(good, native).otherwise(parse_sinks(F.when(~good, c)))


def access_level(c: Column, mode: str = "post") -> Column:
    """Access level of a model's answer; 'invalid' where it holds none."""

    @F.pandas_udf("string")
    def level(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: INVALID if t is None else level_of(extract(t, mode)))

    return level(c)


def without_comments(c: Column) -> Column:
    return F.regexp_replace(c, r"//[^\n]*", "")


def without_trailing_commas(c: Column) -> Column:
    return F.regexp_replace(c, r",\s*([\]}])", "$1")


def boxed_blocks(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?s)\$\s*\\boxed\s*\{(.*?)\}\s*\$"), 1)
