"""Sinks: stage tables, reports, examples and per-row artifacts."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tracewright.functions.text import method_name, one_line
from tracewright.operators.running import places, running
from tracewright.shared import drop_written, shuffles_dropped, written

#: Fixed texts of the reports' rows for entry points without neighbours.
NONE_ALL, NONE_SCORE, NONE_TOP = "No similar EPs with similarity > 0.8", "No similar EPs", "No similar EPs with similarity > 0.5"
#: Pairs of a portion of the places report, on average, and how many portions there are at most; pairs, about, by which portions are cut.
PORTION_ROWS, PORTIONS, SAMPLED = 1 << 24, 8, 4096


def write_stage(df: DataFrame, path: str, drop: tuple[str, ...] = ("embeddings",), mode: str = "errorifexists") -> None:
    """A stage's table without its vectors."""
    df.drop(*drop).write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, drop: tuple[str, ...] = (), **options) -> None:
    df.drop(*drop).write.options(header=True, quote='"', escape='"', **options).csv(path)


def _rest(eps: DataFrame, having: DataFrame, none: str) -> DataFrame:
    """A row for each entry point in eps that is not in having (EP1_ID)."""
    wanted = eps.select(F.col("method").alias("EP1_ID")).where("EP1_ID IS NOT NULL").distinct()
    rest = wanted.join(having, "EP1_ID", "left_anti").unionByName(eps.where("method IS NULL").select(F.col("method").alias("EP1_ID")).distinct())
    return rest.select("EP1_ID", F.lit(none).alias("EP2_ID"), F.lit("").alias("EP1_Code"), F.lit("").alias("EP2_Code"))


def _with_rest(eps: DataFrame, found: DataFrame, none: str) -> DataFrame:
    """found (EP1_ID and further columns), which is a table of its own, of the entry points in eps, and a row for each of them that it lacks. The rows
    found stay in the tasks that read them: a join would put all of an entry point's rows in one."""
    wanted = eps.select(F.col("method").alias("EP1_ID")).where("EP1_ID IS NOT NULL").distinct()
    having = found.select("EP1_ID").distinct()
    ours = found.join(F.broadcast(having.join(wanted, "EP1_ID", "left_anti")), "EP1_ID", "left_anti")
    return ours.fillna("", ["EP1_Code", "EP2_Code"]).unionByName(_rest(eps, having, none), allowMissingColumns=True)


def _said(pairs: DataFrame, *more: str) -> DataFrame:
    return pairs.select(F.col("ep1").alias("EP1_ID"), F.col("ep2_id").alias("EP2_ID"), one_line(F.col("ep1_code")).alias("EP1_Code"), one_line(F.col("ep2_code")).alias("EP2_Code"), F.col("similarity").alias("Similarity"), *more)


def all_pairs_report(eps: DataFrame, pairs: DataFrame) -> DataFrame:
    """EP1_ID, EP2_ID, EP1_Code, EP2_Code, Similarity of every pair; an entry point without pairs has one row that says so."""
    return _with_rest(eps, written(_said(pairs), "all-pairs"), NONE_ALL)


def score_report(eps: DataFrame, pairs: DataFrame) -> DataFrame:
    """EP, EP2_ID, Max_Similarity with four decimals: per pair of entry points, best first."""
    best = pairs.groupBy("ep1", "ep2_id").agg(F.max("similarity").alias("m"))
    joined = eps.select(F.col("method").alias("EP")).distinct().join(best, F.col("EP") == F.col("ep1"), "left")
    place = F.row_number().over(Window.partitionBy("EP").orderBy(F.col("m").desc_nulls_last(), "ep2_id"))
    return joined.select("EP", F.coalesce("ep2_id", F.lit(NONE_SCORE)).alias("EP2_ID"), F.when(F.col("m").isNull(), "").otherwise(F.format_string("%.4f", F.col("m"))).alias("Max_Similarity"), place.cast("long").alias("place"))


def top_report(eps: DataFrame, pairs: DataFrame, n: int | None = None) -> DataFrame:
    """The pairs report in descending order of similarity per entry point, all or the first n."""
    order = Window.partitionBy("ep1").orderBy(F.col("similarity").desc(), "ep1_sink_idx", "ep2_id", "ep2_sink_idx")
    if n:
        ranked = pairs.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= n)
    else:  # places over ranges of the order, since a window would sort all of an entry point's pairs in one task
        ranked = running(written(pairs, "pairs"), ["ep1"], [F.col("similarity").desc(), "ep1_sink_idx", "ep2_id", "ep2_sink_idx"], {"place": F.lit(1)})
    return _with_rest(eps, written(_said(ranked, "place"), "top-pairs"), NONE_TOP)


def _append_csv(df: DataFrame, path: str) -> None:
    """df as further files of a folder of compressed CSV files."""
    df.write.mode("append").options(header=True, quote='"', escape='"', compression="gzip", **{"zlib.compress.level": "BEST_SPEED"}).csv(path)


def write_all_pairs_report(eps: DataFrame, pairs: DataFrame, path: str) -> None:
    """all_pairs_report as compressed CSV; pairs are of entry points in eps. They go to their files as they are found and nowhere else: who has pairs is read
    from there."""
    said = _said(pairs).fillna("", ["EP1_Code", "EP2_Code"])
    with shuffles_dropped(eps.sparkSession):
        _append_csv(said, path)
        having = eps.sparkSession.read.options(header=True, quote='"', escape='"').schema(said.schema).csv(path).select("EP1_ID").distinct()
        _append_csv(_rest(eps, having, NONE_ALL).withColumn("Similarity", F.lit(None).cast("double")), path)


def _from(end: Row) -> Column:
    return (F.col("ep1") > end["ep1"]) | ((F.col("ep1") == end["ep1"]) & (F.col("similarity") <= end["similarity"]))


def _portions(pairs: DataFrame) -> list[Row]:
    """Where portions of the order by ep1 and descending similarity begin but for the first, from a sample of pairs. Pairs of one entry point that are equally
    similar are in one portion."""
    n = pairs.count()
    if (portions := min(PORTIONS, math.ceil(n / PORTION_ROWS))) < 2:
        return []
    sample = sorted(pairs.select("ep1", "similarity").sample(min(1.0, SAMPLED / n), 1).collect(), key=lambda r: (r["ep1"], -r["similarity"]))
    return sorted({sample[len(sample) * k // portions] for k in range(1, portions) if sample}, key=lambda r: (r["ep1"], -r["similarity"]))


def write_top_report(eps: DataFrame, pairs: DataFrame, path: str, coded: Callable[[DataFrame], DataFrame] = lambda p: p) -> None:
    """top_report of all pairs as compressed CSV; pairs are of entry points in eps, and coded adds their ep1_code and ep2_code where they lack these.

    Pairs are written once, without what coded adds, and go through the order in a few portions, each a range of it: disk holds the order of one portion at a
    time. Only a portion's first entry point can have pairs in earlier ones."""
    with shuffles_dropped(eps.sparkSession):
        rows = written(pairs, "pairs")
        starts = _portions(rows)
        for low, high in zip([None, *starts], [*starts, None], strict=True):
            portion = rows if low is None else rows.where(_from(low))
            ranked = places(portion if high is None else portion.where(~_from(high)), "ep1", F.col("similarity").desc(), "ep1_sink_idx", "ep2_id", "ep2_sink_idx")
            placed = ranked
            if low is not None:
                earlier = rows.where((F.col("ep1") == low["ep1"]) & (F.col("similarity") > low["similarity"])).count()
                placed = ranked.withColumn("place", F.col("place") + F.when(F.col("ep1") == low["ep1"], F.lit(earlier)).otherwise(0))
            _append_csv(_said(coded(placed), "place").fillna("", ["EP1_Code", "EP2_Code"]), path)
            drop_written(ranked)
        rest = _rest(eps, rows.select(F.col("ep1").alias("EP1_ID")).distinct(), NONE_TOP)
        _append_csv(rest.withColumn("Similarity", F.lit(None).cast("double")).withColumn("place", F.lit(None).cast("long")), path)
        drop_written(rows)


def sinks_report(api: DataFrame) -> DataFrame:
    """One row per entry point and sink."""
    return api.select(F.col("method").alias("EP"), F.explode("sink_code").alias("Sink"))


def example_lines(df: DataFrame, label: str = "label", group: str = "EP", seed: int = 42) -> DataFrame:
    """code ("name = value" of all other columns) and label, each group in a seeded order."""
    said = F.concat_ws(" ", *[F.concat(F.lit(f"{c} = "), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("None"))) for c in df.columns if c != label])
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.xxhash64(F.lit(seed), said), said))
    return df.select(said.alias("code"), F.col(label).cast("int").alias("label"), F.col(group).alias("group"), place.cast("long").alias("place"))


def write_examples(df: DataFrame, path: str) -> None:
    df.repartitionByRange("group").sortWithinPartitions("group", "place").select("code", "label").write.json(path)


def row_artifacts(df: DataFrame, texts: dict[str, str], service: str = "service_name", method: str = "method") -> DataFrame:
    """path (service/method/name.txt) and text per row and column; of overloads, which share a folder, the last one by seq stays."""
    folder = F.concat_ws("/", F.col(service), method_name(F.col(method)))
    made = df.select(folder.alias("folder"), F.col("seq"), F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.col(c).alias("text")) for name, c in texts.items()])).alias("f"))
    last = F.row_number().over(Window.partitionBy("folder", "f.name").orderBy(F.col("seq").desc()))
    return made.withColumn("place", last).where("place = 1").select(F.concat_ws("/", "folder", "f.name").alias("path"), F.col("f.text").alias("text"))


def write_artifacts(artifacts: DataFrame, folder: str, overwrite: bool = False) -> None:
    """The files of artifacts (path, text) below folder, all or none; files of a path that is there already are replaced."""
    from tracewright.sources.artifacts import ArtifactSource

    artifacts.sparkSession.dataSource.register(ArtifactSource)
    artifacts.select("path", "text").write.format(ArtifactSource.name()).option("folder", folder).mode("overwrite" if overwrite else "append").save()


def stats_text(accuracy: float | None, rows: int, confusion: DataFrame, title: dict[str, str]) -> str:
    """The run's statistics as text; confusion holds at most one row per pair of levels."""
    lines = [f"{k}: {v}" for k, v in title.items()] + [f"Overall Accuracy: {accuracy if accuracy is not None else float('nan'):.2f}% total rows = {rows}"]
    for r in confusion.orderBy("actual", F.col("Count").desc(), "predicted").collect():
        lines.append(f"{r['actual']}\t{r['predicted']}\t{r['Count']}\t{r['Percentage']:.6f}")
    return "\n".join(lines) + "\n"


def bar_chart(rows: list[tuple[str, float]], title: str, height: int = 200, width: int = 60) -> str:
    """A bar chart as SVG text; rows are few, a bar each, in order."""
    from html import escape

    top = max((v for _, v in rows), default=0) or 1
    bars = "".join(f'<rect x="{10 + k * width}" y="{20 + height - v / top * height:.2f}" width="{width - 10}" height="{v / top * height:.2f}"/><text x="{10 + k * width}" y="{height + 35}">{escape(n)}</text>' for k, (n, v) in enumerate(rows))
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{20 + width * len(rows)}" height="{height + 45}"><text x="10" y="15">{escape(title)}</text>{bars}</svg>'


def write_text(spark, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def write_list(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.text(path)


def unique_names(df: DataFrame, ep: str = "EP") -> DataFrame:
    """Name before the first underscore of every different entry point; names may repeat."""
    return df.select(ep).distinct().select(F.substring_index(F.col(ep), "_", 1).alias("name"))


def curve_chart(places: list[tuple[int, int]], title: str, width: int = 400, height: int = 300) -> str:
    """A rising curve and the diagonal as SVG text, from places on a grid of this size (relational.on_grid), in order."""
    from html import escape

    line = " ".join(f"{30 + x},{20 + height - y}" for x, y in places)
    frame = f'<path d="M30 20V{20 + height}H{30 + width}" fill="none" stroke="black"/><path d="M30 {20 + height}L{30 + width} 20" stroke="navy" stroke-dasharray="4"/>'
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width + 50}" height="{height + 45}"><text x="30" y="15">{escape(title)}</text>{frame}<polyline points="{line}" fill="none" stroke="darkorange"/></svg>'
