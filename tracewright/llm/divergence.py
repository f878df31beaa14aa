"""Source divergence audit (operator 11): how far the sources of a language lie apart in their words, in exact integers.

A language keeps the terms that at least so many of its documents hold. A group (language, source) and the language itself give each kept term a
smoothed share p of a billion, which depends on nothing but the term's count there and the sums N and V. For a pair of sources all kept terms
would have to be compared, most of them with a count of zero on one side or both. Instead the distinct (count, count) combinations of a pair are
tallied with their multiplicities: combinations of two positive counts by one join of the kept counts, those with a zero by taking the tallied
ones from each source's own histogram of counts, that of two zeros from V. f is evaluated once a combination.

Defined results: null text, language and source are the empty text; a language without kept terms has the value 0 for all its pairs and no
terms; a group without terms has count 0 throughout; equal values rank by the item's UTF-8 bytes; repeated rows are separate documents; texts of
any length count whole; an empty table gives no rows; further columns have no influence.

At scale: a task counts the terms of a portion of texts at a time, as Arrow arrays, and hands on a row per term and group of the portion, so that a
frequent term is few rows; the one shuffle of counts is by language and term. A kept term is then one row with its count in each source that has
it, written to the shared folder once, since three steps read it. Pairs of sources meet within a term's row and are tallied in the same task, a
bounded number at a time, so that the shuffle holds a row a combination, not a row a term. The groups' sums are a written table too, whose size
decides whether Spark broadcasts it. The top terms of a group are limited in each task before they are ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.llm.common import portions, table, written

#: What lies between terms: all but ASCII letters and characters beyond ASCII.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
BILLION = 1_000_000_000
#: Counts whose share fits in 64 bits on the way.
SMALL = 9_000_000_000
#: Bytes of text that are counted at once, and pairs that are tallied at once.
PORTION_BYTES, PORTION_ROWS, PAIRS_AT_ONCE = 8 << 20, 1 << 16, 1 << 20


def term_lists(text: pa.Array) -> pa.Array:
    """All terms of each text, repeats included, and perhaps empty strings; only A-Z are lower-cased."""
    return pc.split_pattern_regex(pc.ascii_lower(text), pattern=BETWEEN)


def count_portion(lang: np.ndarray, group: np.ndarray, text: pa.Array) -> pa.RecordBatch:
    """l, term, g, count and docs of some documents."""
    lists = term_lists(text)
    coded = lists.flatten().dictionary_encode()
    doc, term, width = pc.list_parent_indices(lists).to_numpy(), coded.indices.to_numpy(), np.int64(max(1, len(coded.dictionary)))
    each, times = np.unique(doc * width + term, return_counts=True)
    cells, at = np.unique(group[each // width] * width + each % width, return_inverse=True)
    count, docs = np.zeros(len(cells), np.int64), np.bincount(at, minlength=len(cells))
    np.add.at(count, at, times)
    group_of, term = cells // width, cells % width
    known, first = np.unique(group, return_index=True)
    lang_of = lang[first[np.searchsorted(known, group_of)]]
    columns = [pa.array(lang_of, pa.int64()), coded.dictionary.take(pa.array(term)), pa.array(group_of, pa.int64()), pa.array(count), pa.array(docs, pa.int64())]
    found = pa.RecordBatch.from_arrays(columns, names=["l", "term", "g", "count", "docs"])
    return found.filter(pc.not_equal(found.column(1), ""))


def term_counts(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """l, term, g, count (occurrences) and docs (documents that hold it). A task hands on a row per term and group of a portion, and so a term's
    rows are a small share of what its task gets, however frequent it is."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, 2, PORTION_BYTES, PORTION_ROWS):
            yield count_portion(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2))

    rows = docs.join(groups, ["lang", "source"]).select("l", "g", "text").mapInArrow(counted, "l long, term string, g long, count long, docs long")
    return rows.repartition("l", "term").groupBy("l", "term", "g").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (N + 2 V)), exactly; decimals where the product would not fit in 64 bits."""
    small = F.call_function("div", (count + 2) * F.lit(BILLION), total + kept * 2)
    top = (count.cast("decimal(20,0)") + F.lit(2).cast("decimal(1,0)")) * F.lit(BILLION).cast("decimal(10,0)")
    large = F.call_function("div", top, (total + kept * 2).cast("decimal(20,0)"))
    return F.when(count <= SMALL, small).otherwise(large) + 1


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most 10^9 + 1, so that all fits in 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def numbered_groups(docs: DataFrame) -> DataFrame:
    """Every occurring lang and source with numbers: l of the language, g of the group. A row per group."""
    rows = docs.select("lang", "source").distinct()
    return rows.select("lang", "source", F.dense_rank().over(Window.orderBy("lang")).cast("long").alias("l"), F.row_number().over(Window.orderBy("lang", "source")).cast("long").alias("g"))


def kept_terms(docs: DataFrame, groups: DataFrame, min_docs: int) -> DataFrame:
    """l, term, lang_count and counts: the groups that have the term, in order, with its count there; as long as there are sources."""
    counts = F.sort_array(F.collect_list(F.struct("g", "count"))).alias("counts")
    rows = term_counts(docs, groups).groupBy("l", "term").agg(F.sum("count").alias("lang_count"), F.sum("docs").alias("lang_docs"), counts)
    return rows.where(F.col("lang_docs") >= min_docs).select("l", "term", "lang_count", "counts")


def group_totals(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """groups with n (kept occurrences there), own (kept terms there), lang_n and v (kept terms) of the language."""
    sums = kept.select(F.inline("counts")).groupBy("g").agg(F.sum("count").alias("n"), F.count("*").alias("own"))
    langs = kept.groupBy("l").agg(F.sum("lang_count").alias("lang_n"), F.count("*").alias("v"))
    rows = groups.join(sums, "g", "left").join(langs, "l", "left")
    return rows.select("lang", "source", "l", "g", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "own", "lang_n", "v")])


def tally(a: np.ndarray, b: np.ndarray, ca: np.ndarray, cb: np.ndarray) -> pa.RecordBatch:
    """a, b, ca, cb and times: the different combinations."""
    levels, at = np.unique(np.concatenate([ca, cb]), return_inverse=True)
    side, wide, n = np.int64(max(a.max(), b.max()) + 1), np.int64(len(levels)), len(a)
    first, nth = np.unique((a * side + b) * wide + at[:n], return_inverse=True)
    cells, times = np.unique(nth * wide + at[n:], return_counts=True)
    first, cb = first[cells // wide], levels[cells % wide]
    pair = first // wide
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (pair // side, pair % side, levels[first % wide], cb, times)], names=["a", "b", "ca", "cb", "times"])


def tally_pairs(g: pa.Array, count: pa.Array) -> Iterator[pa.RecordBatch]:
    """Tallies of all pairs of places within each of the lists: numbers of groups, and counts."""
    term, g, count = pc.list_parent_indices(g).to_numpy(), g.flatten().to_numpy().astype(np.int64), count.flatten().to_numpy()
    parts, n = [], 0
    for step in range(1, len(g)):  # both places of a pair lie so far apart
        i = np.flatnonzero(term[step:] == term[:-step])
        if not len(i):
            break
        parts.append((g[i], g[i + step], count[i], count[i + step]))
        if (n := n + len(i)) >= PAIRS_AT_ONCE:
            yield tally(*map(np.concatenate, zip(*parts, strict=True)))
            parts, n = [], 0
    if parts:
        yield tally(*map(np.concatenate, zip(*parts, strict=True)))


def paired(totals: DataFrame) -> DataFrame:
    """Every two groups of a language once, a before b, with their sums; as many as the audit has pairs to report."""
    side = lambda x: totals.select("lang", "l", "v", F.col("g").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("source", "n", "own")])
    return side("a").join(side("b").drop("v", "lang"), "l").where("a < b")


def combinations(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """a, b (numbers of two groups of a language, a before b), ca, cb and times: how many kept terms have count ca in a and cb in b, zeros
    included."""

    def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from tally_pairs(b.column(0), b.column(1))

    lists = kept.where(F.size("counts") > 1).select(F.transform("counts", lambda x: x["g"]).alias("g"), F.transform("counts", lambda x: x["count"]).alias("count"))
    both = lists.mapInArrow(tallied, "a long, b long, ca long, cb long, times long").groupBy("a", "b", "ca", "cb").agg(F.sum("times").alias("times"))
    both = written(both, "joint-counts")
    own = kept.select(F.inline("counts")).groupBy("g", "count").agg(F.count("*").alias("times"))
    pairs = paired(totals)
    zero, cell = F.lit(0).cast("long"), lambda ca, cb, times: F.struct(ca.alias("ca"), cb.alias("cb"), times.alias("times"))
    ca, cb, times = F.col("ca"), F.col("cb"), F.col("times")
    # a term counted in both is no longer one of those that the other lacks, and was taken off twice from those that both lack
    cells = [
        both.groupBy("a", "b", "ca").agg(F.sum(-times).alias("times")).withColumn("cell", cell(ca, zero, times)),
        both.groupBy("a", "b", "cb").agg(F.sum(-times).alias("times")).withColumn("cell", cell(zero, cb, times)),
        both.groupBy("a", "b").agg(F.sum("times").alias("times")).withColumn("cell", cell(zero, zero, times)),
        pairs.join(own.select(F.col("g").alias("a"), F.col("count").alias("ca"), "times"), "a").withColumn("cell", cell(ca, zero, times)),
        pairs.join(own.select(F.col("g").alias("b"), F.col("count").alias("cb"), "times"), "b").withColumn("cell", cell(zero, cb, times)),
        pairs.withColumn("cell", cell(zero, zero, F.col("v") - F.col("own_a") - F.col("own_b"))),
    ]
    implied = cells[0].select("a", "b", "cell.*")
    for more in cells[1:]:
        implied = implied.unionByName(more.select("a", "b", "cell.*"))
    return both.unionByName(implied.groupBy("a", "b", "ca", "cb").agg(F.sum("times").alias("times")))


def pair_values(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language) and value, both ways."""
    v = F.col("v")
    f = apart(share(F.col("ca"), F.col("n_a"), v), share(F.col("cb"), F.col("n_b"), v))
    pairs = paired(totals)
    each = combinations(kept, totals).join(pairs.select("a", "b", "n_a", "n_b", "v"), ["a", "b"]).withColumn("f", F.when(F.col("times") > 0, f * F.col("times")).otherwise(0))
    sums = each.groupBy("a", "b").agg(F.sum("f").alias("value")).join(pairs, ["a", "b"])
    way = lambda x, y: F.struct(F.col(f"source_{x}").alias("source"), F.col(f"source_{y}").alias("item"))
    return sums.select("lang", F.explode(F.array(way("a", "b"), way("b", "a"))).alias("w"), "value").select("lang", "w.*", "value")


def term_values(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, source, item (a term more frequent there than in the language) and value."""
    rows = kept.select(F.col("term").alias("item"), "lang_count", F.inline("counts")).join(totals, "g")
    p, q = share(F.col("count"), F.col("n"), F.col("v")), share(F.col("lang_count"), F.col("lang_n"), F.col("v"))
    rows = rows.select("lang", "source", "item", p.alias("p"), q.alias("q")).where("p > q")
    return rows.select("lang", "source", "item", apart(F.col("p"), F.col("q")).alias("value"))


def divergence(docs: DataFrame, min_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: part pair holds all other sources of the language, part term the first top terms."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    docs = docs.select(empty("text"), empty("lang"), empty("source"))
    groups = written(numbered_groups(docs), "groups")
    kept = written(kept_terms(docs, groups, min_docs), "kept-terms")
    totals = written(group_totals(groups, kept), "group-totals")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    pairs = pair_values(kept, totals).withColumn("rank", rank).withColumn("part", F.lit("pair"))
    words = term_values(kept, totals).withColumn("rank", rank).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return pairs.unionByName(words).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP11_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
e AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term FROM e GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
c AS (SELECT e.lang, e.source, e.term, count(*) AS n FROM e JOIN k ON e.lang = k.lang AND e.term = k.term GROUP BY e.lang, e.source, e.term),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
gn AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
ln AS (SELECT lang, sum(n) AS total FROM c GROUP BY lang),
lc AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(gn.total, 0) + 2 * v.v) AS p, 1 + (1000000000::HUGEINT * (lc.n + 2)) // (ln.total + 2 * v.v) AS q
  FROM g JOIN k ON g.lang = k.lang JOIN v ON v.lang = g.lang JOIN ln ON ln.lang = g.lang JOIN lc ON lc.lang = k.lang AND lc.term = k.term
  LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pr AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
tr AS (SELECT lang, source, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM f WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pr
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM tr)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10"""
