"""Declared schemas and the ordered access levels."""

from __future__ import annotations

from pyspark.sql import types as T

#: Access levels in ascending order of strictness.
LEVELS = ("NONE", "NORMAL", "DANGEROUS", "SYS_OR_SIG")
#: Texts that stand for a missing or unusable answer.
NO_ANSWER, INVALID, NO_NEIGHBOUR, BAD_JSON = "None", "invalid", "no top_similar found", "error extracting json"
API_KEY = ("service_name", "class", "method", "access control level")

#: Header of an execution-path file; columns of either code form.
CSV_COLUMNS = ("Class", "Method", "Depth", "Trace Instruction(s) ...", "Java Code Representation", "Code Merged", "Access Control Level")
PATH_ROW = T.StructType(
    [
        T.StructField("service_name", T.StringType()),
        T.StructField("class", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("access control level", T.StringType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("trace", T.StringType()),
        T.StructField("java_code", T.StringType()),
        T.StructField("seq", T.LongType()),
    ]
)
PATH = T.StructType([T.StructField("depth", T.IntegerType()), T.StructField("trace", T.StringType()), T.StructField("java_code", T.StringType())])
API = T.StructType([*[T.StructField(c, T.StringType()) for c in API_KEY], T.StructField("depths", T.ArrayType(PATH))])
PAIR = T.StructType(
    [
        T.StructField("ep1", T.StringType()),
        T.StructField("ep1_code", T.StringType()),
        T.StructField("ep1_sink_idx", T.IntegerType()),
        T.StructField("ep2_id", T.StringType()),
        T.StructField("ep2_code", T.StringType()),
        T.StructField("ep2_sink_idx", T.IntegerType()),
        T.StructField("similarity", T.DoubleType()),
    ]
)
EXAMPLE = T.StructType([T.StructField("code", T.StringType()), T.StructField("label", T.IntegerType())])
BATCH_RESULT = T.StructType([T.StructField("custom_id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("text", T.StringType())])
