"""String functions as column expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATH_SEPARATOR = "<PATH_SEP>"
ITEM_SEPARATOR = "<|>"


def method_name(c: Column) -> Column:
    """Text before the first opening parenthesis."""
    return F.substring_index(c, "(", 1)


def last_segment(c: Column) -> Column:
    """Text after the last full stop."""
    return F.substring_index(c, ".", -1)


def short_method(c: Column) -> Column:
    """Last dotted segment without its parameter list."""
    return method_name(last_segment(c))


def service_of(ep: Column) -> Column:
    """Second part of an entry point's id at underscores."""
    return F.try_element_at(F.split(ep, "_"), F.lit(2))


def split_once(c: Column, sep: str = "_") -> tuple[Column, Column]:
    """Text before the first separator, and all after it (null if there is none)."""
    return F.substring_index(c, sep, 1), F.when(F.instr(c, sep) > 0, F.expr(f"substring({_name(c)}, instr({_name(c)}, '{sep}') + {len(sep)})"))


def _name(c: Column) -> str:
    return c._jc.toString()


def bracket_items(c: Column) -> Column:
    """Items of a text like [a, b, c]: without its first and last character, cut at comma and space."""
    return F.split(F.substring(c, 2, F.greatest(F.length(c) - 2, F.lit(0))), ", ")


def without_checks(c: Column) -> Column:
    """Items that hold no [AC] mark, joined by the item separator."""
    return F.array_join(F.filter(bracket_items(c), lambda x: ~F.contains(x, F.lit("[AC]"))), ITEM_SEPARATOR)


def check_level(c: Column) -> Column:
    """Largest number in parentheses among [AC] items; -1 if there is none."""
    marked = F.filter(bracket_items(c), lambda x: F.contains(x, F.lit("[AC]")))
    found = F.transform(marked, lambda x: F.regexp_extract(x, r"\((\d+)\)", 1))
    numbers = F.transform(F.filter(found, lambda x: x != ""), lambda x: x.cast("int"))
    return F.coalesce(F.array_max(numbers), F.lit(-1))


def key_values(c: Column) -> Column:
    """A text like {k=v, k=v} as a map."""
    pairs = F.split(F.substring(c, 2, F.greatest(F.length(c) - 2, F.lit(0))), ",")
    kept = F.filter(pairs, lambda x: F.contains(x, F.lit("=")))
    return F.map_from_entries(F.transform(kept, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)), F.trim(F.regexp_replace(x, "^[^=]*=", "")))))


def pseudo_java(method: Column, service: Column, code: Column, item_separator: str = ITEM_SEPARATOR) -> Column:
    """Statements of a joined path as the body of a method: labels in brackets go, each one ends in a semicolon.

    Fixed layout: "// API: <method>", "// Service: <service>", an empty line, the header, statements indented by 4, a brace.
    """
    bare = F.transform(F.split(code, F.concat(F.lit("\\Q"), F.lit(item_separator), F.lit("\\E"))), lambda x: F.trim(F.regexp_replace(x, r"\[.*?\]: ", "")))
    lines = F.transform(F.filter(bare, lambda x: x != ""), lambda x: F.concat(F.lit("    "), F.when(x.endswith(";"), x).otherwise(F.concat(x, F.lit(";")))))
    head = F.concat(F.lit("// API: "), method, F.lit("\n// Service: "), service, F.lit("\n\npublic void "), method, F.lit("() {"))
    return F.concat_ws("\n", head, F.when(F.size(lines) > 0, F.array_join(lines, "\n")), F.lit("}"))


def first_line(c: Column) -> Column:
    return F.substring_index(c, "\n", 1)


def snippet(signature: Column, sink: Column) -> Column:
    """A sink inside its method's signature, indented by 12 spaces; line feeds and indents are part of the embedded text."""
    pad = " " * 12
    return F.concat(F.lit(f"\n{pad}"), signature, F.lit(f"\n{pad}"), sink, F.lit(f"\n{pad}}}\n{pad}"))


def one_line(c: Column) -> Column:
    return F.translate(c, "\n", " ")


def numbered_paths(paths: Column, code: str = "java_code") -> Column:
    """First prompt: every path with its number and depth."""
    said = F.transform(paths, lambda p, i: F.concat(F.lit("This is path "), (i + 1).cast("string"), F.lit(" for the API with depth "), p["depth"].cast("string"), F.lit(":\n"), p[code]))
    return F.array_join(said, "\n\n")


def camel_words(c: Column) -> Column:
    """Words of an identifier, lower-cased."""
    return F.transform(F.regexp_extract_all(c, F.lit("([A-Za-z][a-z]+)"), 1), F.lower)


def without_extension(c: Column) -> Column:
    """Name without its last extension; a leading full stop is no extension."""
    return F.regexp_replace(c, r"(?<=[^/.])\.[^./]*$", "")


def token_count(c: Column) -> Column:
    """Offline stand-in for a model's token count: words, numbers and single marks. Not equal to any model's tokenizer."""
    return F.coalesce(F.regexp_count(c, F.lit(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]")), F.lit(0))


def padded_ids(ids: Column, size: int = 256, first: int = 0, last: int = 2, pad: int = 1) -> Column:
    """At most size - 2 ids between two marks, filled up to size."""
    body = F.slice(ids, 1, size - 2)
    return F.concat(F.array(F.lit(first)), body, F.array(F.lit(last)), F.array_repeat(F.lit(pad), F.lit(size - 2) - F.size(body)))


def is_empty_answer(c: Column) -> Column:
    """The three texts of an answer without sinks."""
    return F.coalesce(c.isin("None", '{"Sinks": []}', '{"Sinks": [[]]}'), F.lit(False))


def python_repr(c: Column) -> Column:
    """A list of strings as Python prints it, for texts in which no character but quotes, backslashes, tabs and line ends needs an escape."""
    def one(x: Column) -> Column:
        esc = F.replace(F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
        double = F.contains(x, F.lit("'")) & ~F.contains(x, F.lit('"'))
        return F.when(double, F.concat(F.lit('"'), esc, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(esc, F.lit("'"), F.lit("\\'")), F.lit("'")))

    return F.concat(F.lit("["), F.array_join(F.transform(c, one), ", "), F.lit("]"))
