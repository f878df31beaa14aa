"""The two stages from execution paths to a report, and the older text pipeline, as plans over the operators.

compat keeps the known oddities of the analyses this engine stands in for: answers that are missing are the text 'None', and the last row of
a method name stands for all. The default keeps nulls and every row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions import answers, models, text
from tracewright.operators import paths, relational, similarity
from tracewright.plans import prompts
from tracewright.schemas import BAD_JSON, INVALID, NO_ANSWER, NO_NEIGHBOUR
from tracewright.sources import files


def sinks_stage(spark: SparkSession, csv_folder: str, client: Callable, system: str, out: str, threads: int = 4, timeout: float | None = 90.0, code_col: str = "Code Merged", compat: bool = False, all_paths: bool = True) -> DataFrame:
    """Execution paths to answers: group by API, choose three paths, ask the model, find the JSON; written to out and read back, so that no
    call is repeated by later steps. Without all_paths the column depths holds only the paths that prompts are made from, both stages', and
    an API may have any number of paths."""
    rows = files.csv_dir(spark, csv_folder, code_col)
    api = paths.collect_paths(rows) if all_paths else paths.bounded_paths(rows)
    asked = api.withColumn("prompt1", text.numbered_paths(paths.three_paths_nested(F.col("depths"))))
    said = models.chat(asked, client, system, "prompt1", "res1", threads, timeout, None)
    said.write.parquet(f"{out}/answers")
    found = spark.read.parquet(f"{out}/answers").withColumn("json_answer", answers.extract_json(F.col("res1"), "pre"))
    if compat:
        found = found.withColumn("json_answer", F.coalesce("json_answer", F.lit(NO_ANSWER)))
    found.write.parquet(f"{out}/stage1")
    return spark.read.parquet(f"{out}/stage1")


def levels_stage(spark: SparkSession, stage1: DataFrame, embedder: Callable, client: Callable, system: str, out: str, threshold: float = 0.8, n_sinks: int | None = None, n_neighbours: int = 4, threads: int = 4, timeout: float | None = 90.0, compat: bool = False, keep_pairs: bool = True) -> dict[str, DataFrame]:
    """Answers to levels: sinks, vectors, similar pairs, chosen neighbours, prompts, answers; returns all tables and the reports. Without keep_pairs
    no table of all pairs is made, and the join hands on only those that the choice can take; chosen and what follows are the same."""
    order = Window.partitionBy("method").orderBy(F.col("service_name").desc(), F.col("class").desc(), F.col("access control level").desc())
    api = stage1.withColumn("sink_code", answers.parse_sinks(F.col("json_answer"), n_sinks)).withColumn("seq", F.row_number().over(order))
    api = api.where("seq = 1").drop("seq") if compat else api.drop("seq")
    api = api.withColumn("ep", F.col("method") if compat else F.concat_ws("#", "service_name", "class", "method", "access control level"))
    sinks = api.select(F.col("ep").alias("method"), F.col("depths")[0]["java_code"].alias("java"), F.posexplode("sink_code").alias("sink_idx", "code"))
    told = sinks.withColumn("told", text.snippet(text.first_line(F.coalesce("java", F.lit(""))), F.col("code"))).drop("java")
    models.embed(told, embedder, "told").drop("told").write.parquet(f"{out}/vectors")
    vectors = spark.read.parquet(f"{out}/vectors")
    codes = vectors.select("method", F.col("sink_idx").cast("long").alias("sink_idx"), "code")
    own_code = lambda p: p.join(codes.toDF("ep1", "ep1_sink_idx", "ep1_code"), ["ep1", "ep1_sink_idx"])
    pairs = None
    if keep_pairs:
        found = similarity.cosine_pairs(vectors, threshold, digits=similarity.DIGITS)
        own_code(found).join(codes.toDF("ep2_id", "ep2_sink_idx", "ep2_code"), ["ep2_id", "ep2_sink_idx"]).write.parquet(f"{out}/pairs")
        pairs = spark.read.parquet(f"{out}/pairs")
        chosen = similarity.diversified(pairs, n_neighbours)
    else:
        chosen = own_code(similarity.diversified(similarity.best_pairs(vectors, threshold, digits=similarity.DIGITS), n_neighbours))
    chosen.write.parquet(f"{out}/chosen")
    chosen = spark.read.parquet(f"{out}/chosen")
    meta = api.select(F.col("ep").alias("method"), "service_name", "access control level", F.lit(0).alias("seq"))
    eps = api.select(F.col("ep").alias("method"), "service_name", F.coalesce(text.numbered_paths(paths.three_paths_nested(F.col("depths"))), F.lit("")).alias("code"), "sink_code")
    asked = prompts.second_prompt(eps, prompts.neighbours_text(chosen, meta))
    asked = asked.withColumn("p2", F.when(F.col("p2") != prompts.NOTHING, F.col("p2")))
    models.chat(asked, client, system, "p2", "res2", threads, timeout).write.parquet(f"{out}/answers2")
    said = spark.read.parquet(f"{out}/answers2").select(F.col("method").alias("ep"), "p2", F.coalesce("res2", F.lit(NO_NEIGHBOUR)).alias("res2"))
    level = answers.access_level(F.col("res2"))
    result = api.join(said, "ep").withColumn("access control level predicted", level).withColumn("json_answer2", F.coalesce(answers.extract_json(F.col("res2")), F.lit(BAD_JSON)))
    result.drop("ep").write.parquet(f"{out}/stage2")
    result = spark.read.parquet(f"{out}/stage2")
    valid = result.where(relational.not_equal_or_null(F.col("access control level predicted"), INVALID))
    return {
        "result": result,
        "pairs": pairs,
        "chosen": chosen,
        "accuracy": relational.accuracy(result, "access control level", "access control level predicted"),
        "confusion": relational.confusion(valid, "access control level", "access control level predicted"),
    }


def text_stage(spark: SparkSession, path: str) -> DataFrame:
    """Sectioned text to one pseudo-Java method per entry point: labels from the marks, blocks merged, the longest of each entry point."""
    rows = files.sectioned_text(spark, path)
    labelled = rows.withColumn("label", paths.dynamic_label(text.check_level(F.col("code")))).withColumn("code", text.without_checks(F.col("code")))
    merged = paths.merge_blocks(labelled)
    method, service = F.substring_index("EP", "_", 1), F.regexp_replace("EP", "^[^_]*_", "")
    java = merged.withColumn("java_code", text.pseudo_java(method, service, F.col("code")))
    return paths.longest_per_key(java, "EP", "java_code")
