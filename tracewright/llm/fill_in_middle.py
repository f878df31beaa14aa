"""Fill-in-middle transformation (operator 13), in Spark's own functions throughout.

A text is cut into units, by default lines with their line feed. Two seeded draws from the document's id give the units after which prefix and
middle end; a third decides whether the text stays plain, a fourth the arrangement: prefix, suffix, middle (psm) or suffix, prefix, middle
(spm), each part after a sentinel of its own. The text can be rebuilt from output and form alone.

Defined results: a null text is an empty one; an empty text, or one that holds a sentinel, stays plain, and its prefix_chars and middle_chars
are null; a null id draws as the empty text would; repeated rows are transformed alike, each for itself; parts may be empty; texts of any length
are cut whole; an empty table gives no rows. Further columns are kept, except those that share a name, in any case of letters, with one of
RESULTS. No shuffle: every row is transformed where it lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import table, without

LINES = r"[^\n]*\n|[^\n]+"
SENTINELS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")


def _checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """The sentinels, if neither they nor what stands beside them can be mistaken for another: none holds the first character of one but at
    its own start, and so none begins inside another or across its edge."""
    starts = {s[:1] for s in sentinels}
    if len(set(sentinels)) != 3 or "" in starts or any(c in starts for s in sentinels for c in s[1:]) or any(a != b and a.startswith(b) for a in sentinels for b in sentinels):
        raise ValueError(f"sentinels that can be mistaken for each other: {sentinels}")
    return sentinels


def draw(seed: int, key: Column, place: int) -> Column:
    """One of eight 32-bit draws for a key: a group of eight digits of the digest of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 1 + 8 * place, 8), 16, 10).cast("long")


def transformed(docs: DataFrame, text: str = "text", key: str = "doc_id", unit: str = LINES, seed: int = 7, rate: int = 100, spm: int = 50, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """docs with n (units), form, prefix_chars, middle_chars and output. Of 100 texts that can be cut, rate are, and of 100 of those spm begin
    with their suffix."""
    p, s, m = map(F.lit, _checked(sentinels))
    rows = without(docs, *RESULTS, "__text", "__units", "__a", "__b", "__prefix", "__middle", "__suffix").withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    rows = rows.withColumn("__units", F.regexp_extract_all("__text", F.lit(unit), F.lit(0)))
    rows = rows.withColumn("n", F.size("__units").cast("long"))
    places = F.col("n") + 1
    first, second = draw(seed, F.col(key), 0) % places, draw(seed, F.col(key), 1) % places
    stays = (F.col("__text") == "") | (draw(seed, F.col(key), 2) % 100 >= rate)
    for tag in (p, s, m):
        stays = stays | F.contains(F.col("__text"), tag)
    form = F.when(stays, PLAIN).when(draw(seed, F.col(key), 3) % 100 < spm, SPM).otherwise(PSM)
    rows = rows.withColumns({"form": form, "__a": F.least(first, second).cast("int"), "__b": F.greatest(first, second).cast("int")})
    part = lambda begin, length: F.array_join(F.slice("__units", begin, length), "")
    a, b, n = F.col("__a"), F.col("__b"), F.col("n").cast("int")
    rows = rows.withColumns({"__prefix": part(F.lit(1), a), "__middle": part(a + 1, b - a), "__suffix": part(b + 1, n - b)})
    psm = F.concat(p, "__prefix", s, "__suffix", m, "__middle")
    other = F.concat(s, "__suffix", p, "__prefix", m, "__middle")
    rows = rows.withColumns({
        "output": F.when(F.col("form") == PLAIN, F.col("__text")).when(F.col("form") == PSM, psm).otherwise(other),
        "prefix_chars": F.when(F.col("form") != PLAIN, F.char_length("__prefix").cast("long")),
        "middle_chars": F.when(F.col("form") != PLAIN, F.char_length("__middle").cast("long")),
    })
    kept = [c for c in docs.columns if c.lower() not in RESULTS]
    return rows.select(*[F.col(f"`{c}`") for c in kept], *RESULTS)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that transformed made output of: each part is what follows its sentinel, up to another one or the end."""
    p, s, m = _checked(sentinels)

    def after(tag: str, *others: str) -> Column:
        part = F.split_part(output, F.lit(tag), F.lit(2))
        for other in others:
            part = F.split_part(part, F.lit(other), F.lit(1))
        return part

    return F.when(form == PLAIN, output).otherwise(F.concat(after(p, s, m), after(m, p, s), after(s, p, m)))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transformed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


OP13_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS units, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT doc_id, t, units, CAST(len(units) AS BIGINT) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, array_to_string(list_slice(units, 1, a), '') AS x, array_to_string(list_slice(units, a + 1, b), '') AS y, array_to_string(list_slice(units, b + 1, n), '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(x) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(y) AS BIGINT) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
