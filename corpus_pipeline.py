"""From raw documents to token ids: five stages, each written and reread as Parquet.

1. language identification: documents of no known language, or without a letter, go;
2. SimHash near-duplicates: one document of each class stays, that of the smallest id;
3. secrets: each span found is replaced by a mark, n_chars follows;
4. mixing: sources are brought to their target weights, a document taken n times is n rows;
5. SentencePiece: the n best segmentations of each text, best first.

All stages but the last return the columns of documents. A null text is rejected by the first stage; repeated rows are one document to the
second; texts of any length go through whole; an empty table gives an empty result; further columns are kept by all stages but the last, which
returns its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import language_id, mixing, pieces, secrets, simhash
from tracewright.llm.common import fresh_path, remove, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted(docs, language_id.fit(docs))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact_secrets(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in clean.columns else clean


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def segmented(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = docs.select("doc_id", "lang", "source", "n_chars", "text")
    found = pieces.encode(rows, public_tokenizers.path("piece_bpe_32k.model"))
    best = F.col("segmentations")[0]
    scores = F.transform("segmentations", lambda s: s["score"])
    return found.select("doc_id", "lang", "source", "n_chars", best["pieces"].alias("pieces"), F.size(best["pieces"]).cast("long").alias("n_pieces"), scores.alias("n_best_scores"))


STAGES: list[tuple[str, Stage]] = [
    ("language identification", known_language),
    ("near-duplicates", without_near_duplicates),
    ("secrets", without_secrets),
    ("mixing", mixed_sources),
    ("pieces", segmented),
]

#: Neither character models nor segmentations can be expressed in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them is written to the shared folder, reread, and deleted once the next stage is
    written. The last one's input stays for the reader of the result."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
