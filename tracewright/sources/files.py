"""File sources: per-service CSV folders, sectioned text, text trees, lists, prompts and stage tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.schemas import CSV_COLUMNS, EXAMPLE
from tracewright.shared import written
from tracewright.sources.csv_folder import CsvFolderSource


def file_stem(path=None):
    """Name of the file a row comes from, without its last extension."""
    return F.regexp_replace(plain_path(path if path is not None else F.col("_metadata.file_name")), r"\.[^.]*$", "")


def plain_path(path):
    """A path without the percent signs that stand for special characters in file metadata."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def csv_dir(spark: SparkSession, folder: str, code_col: str = "Code Merged") -> DataFrame:
    """Execution paths of a folder with one CSV file per service: service_name, class, method, access control level, depth, trace,
    java_code and seq, the row's place in its file.

    Cells may span lines; outer double quotes are stripped; a depth that is no integer fails the job. Files whose header lacks a
    needed column have no rows.
    """
    spark.dataSource.register(CsvFolderSource)
    needed = ["Class", "Method", "Depth", CSV_COLUMNS[3], code_col, "Access Control Level"]
    rows = spark.read.format(CsvFolderSource.name()).option("folder", folder).option("columns", json.dumps(needed)).load()
    cell = lambda i: F.btrim(f"c{i}", F.lit('"'))
    return rows.select("service_name", cell(0).alias("class"), cell(1).alias("method"), cell(5).alias("access control level"), cell(2).cast("int").alias("depth"), cell(3).alias("trace"), cell(4).alias("java_code"), "seq")


def sectioned_text(spark: SparkSession, path: str, key_tag: str = "EP:", row_tag: str = "ControlFlow:") -> DataFrame:
    """EP, code, seq (a number that grows within a file) and file: every row line with the key line above it. Only text up to a second occurrence of
    the tag counts.

    A file is read in splits of bounded bytes. Within a split the last key line is held by a window; what a split begins with is the last key of
    the splits before it in its file, a row a split. Key and row lines are written once, with the place of their split, so that both see the same.
    """
    after = lambda tag: F.try_element_at(F.split(F.trim("line"), F.concat(F.lit("\\Q"), F.lit(f"{tag} "), F.lit("\\E"))), F.lit(2))
    is_key, is_row = F.col("line").startswith(key_tag), F.col("line").startswith(row_tag)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    # a key line without text after its tag is a null key: it changes nothing, as the one above it is held on
    marked = written(lines.where(is_key | is_row).select("file", "at", "id", F.when(is_key, after(key_tag)).alias("key"), F.when(is_row, F.coalesce(after(row_tag), F.lit(""))).alias("row"), F.when(is_row, after(row_tag)).alias("code")), "sections")
    held = Window.partitionBy("file", "at").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    last = marked.groupBy("file", "at").agg(F.max_by("key", F.when(F.col("key").isNotNull(), F.col("id"))).alias("key"))
    carried = last.select("file", "at", F.last("key", ignorenulls=True).over(before).alias("carried")).where(F.col("carried").isNotNull())
    keyed = marked.withColumn("own", F.last("key", ignorenulls=True).over(held)).where(F.col("row").isNotNull())
    found = keyed.join(carried, ["file", "at"], "left")
    rows = Window.partitionBy("file", "at").orderBy("id")
    place = F.col("at") + F.row_number().over(rows)  # a line has a byte at least, so the numbers of a split end before those of the next
    return found.select(F.coalesce("own", "carried").alias("EP"), "code", place.cast("long").alias("seq"), "file")


def text_tree(spark: SparkSession, root: str, name: str = "response.txt") -> DataFrame:
    """path and text of every file of this name below root, each as one text."""
    return spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=name).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def list_file(spark: SparkSession, path: str) -> DataFrame:
    """Stripped lines of a list of ids."""
    return spark.read.text(path).select(F.trim("value").alias("id"))


def prompt_file(spark: SparkSession, path: str) -> str:
    """A prompt's whole text, stripped; prompts are small and go to every call."""
    return spark.read.text(path, wholetext=True).first()["value"].strip()


def baseline_csv(spark: SparkSession, path: str, column: str = "Entrypoint") -> DataFrame:
    """Baseline entry points with method: the text after the last full stop."""
    return spark.read.csv(path, header=True).withColumn("method", F.substring_index(F.col(column), ".", -1))


def examples_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Training examples, one JSON object a line."""
    return spark.read.schema(EXAMPLE).json(path)


def stage_table(spark: SparkSession, path: str) -> DataFrame:
    """A stage's Parquet output."""
    return spark.read.parquet(path)
