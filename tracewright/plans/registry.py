"""Registration of queries with their oracle SQL, and the stand-in views that many of them share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the folder that all executors share, spark.checkpoint.dir. Where none is named, one machine's temporary folder
    does only if everything runs on it; a cluster would lose what its machines write there."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if not root and not sc.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(root or tempfile.gettempdir()).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# stand-ins: execution paths from events, levels from orders, sinks from embeddings -------------------------------------------------


def path_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events")
    return e.select("user_id", (F.col("event_id") % 5).cast("int").alias("depth"), F.col("event_id").alias("seq"), F.col("event_type").alias("trace"), F.concat_ws(" ", "event_type", "props").alias("java_code"))


PATHS = "paths AS (SELECT user_id, CAST(event_id % 5 AS INTEGER) AS depth, event_id AS seq, event_type AS trace, event_type || ' ' || props AS java_code FROM events)"


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t(spark, sf_dir, "orders")
    p = F.substring("o_orderpriority", 1, 1)
    actual = F.when(p == "1", "SYS_OR_SIG").when(p == "2", "DANGEROUS").when(p == "3", "NORMAL").otherwise("NONE")
    k = F.col("o_orderkey") % 6
    predicted = F.when(k == 0, "NONE").when(k == 1, "NORMAL").when(k == 2, "DANGEROUS").when(k == 3, "SYS_OR_SIG").when(k == 4, "invalid")
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("m"), F.col("o_custkey").cast("string")).alias("method"), F.concat(F.lit("svc"), (F.col("o_custkey") % 20).cast("string")).alias("service"), actual.alias("actual"), predicted.alias("predicted"), F.col("o_totalprice").alias("price"))


LEVELS_SQL = """lv AS (SELECT o_orderkey AS id, 'm' || o_custkey AS method, 'svc' || (o_custkey % 20) AS service,
  CASE left(o_orderpriority, 1) WHEN '1' THEN 'SYS_OR_SIG' WHEN '2' THEN 'DANGEROUS' WHEN '3' THEN 'NORMAL' ELSE 'NONE' END AS actual,
  CASE o_orderkey % 6 WHEN 0 THEN 'NONE' WHEN 1 THEN 'NORMAL' WHEN 2 THEN 'DANGEROUS' WHEN 3 THEN 'SYS_OR_SIG' WHEN 4 THEN 'invalid' END AS predicted,
  o_totalprice AS price FROM orders)"""
RANK = "CASE {c} WHEN 'NONE' THEN 0 WHEN 'NORMAL' THEN 1 WHEN 'DANGEROUS' THEN 2 WHEN 'SYS_OR_SIG' THEN 3 END"

THRESHOLD = 0.3


def sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "embeddings")
    return e.select(F.concat(F.lit("api"), F.col("label").cast("string")).alias("method"), F.col("vec_id").alias("sink_idx"), F.concat(F.lit("code "), (F.col("vec_id") % 97).cast("string")).alias("code"), "embedding")


def coded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs above the threshold with both codes; the code follows from the sink, so no join brings it in."""
    from tracewright.operators.similarity import cosine_pairs

    return coded(cosine_pairs(sinks(spark, sf_dir), THRESHOLD))


def first_coded_pairs(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Those of coded_pairs that can be among the first k of their entry point."""
    from tracewright.operators.similarity import first_pairs

    return coded(first_pairs(sinks(spark, sf_dir), THRESHOLD, k))


def coded(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("ep1_code", _code("ep1_sink_idx")).withColumn("ep2_code", _code("ep2_sink_idx"))


def _code(c: str):
    return F.concat(F.lit("code "), (F.col(c) % 97).cast("string"))


def best_coded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those of coded_pairs that can be the first of their entry point and code."""
    from tracewright.operators.similarity import best_pairs

    return best_pairs(sinks(spark, sf_dir), THRESHOLD).withColumn("ep1_code", _code("ep1_sink_idx"))


SINKS_SQL = "sk AS (SELECT 'api' || label AS method, vec_id AS sink_idx, 'code ' || (vec_id % 97) AS code, embedding::DOUBLE[] AS v FROM embeddings)"
PAIRS_SQL = (
    SINKS_SQL
    + f""", pr AS (SELECT a.method AS ep1, a.sink_idx AS ep1_sink_idx, a.code AS ep1_code, b.method AS ep2_id, b.sink_idx AS ep2_sink_idx, b.code AS ep2_code,
  list_cosine_similarity(a.v, b.v) AS similarity FROM sk a JOIN sk b ON a.method <> b.method WHERE list_cosine_similarity(a.v, b.v) > {THRESHOLD})"""
)
PAIR_ORDER = "ORDER BY similarity DESC, ep1_sink_idx, ep2_id, ep2_sink_idx"
