"""Queries: paths, similarity and the windows over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import text
from tracewright.operators import paths, similarity
from tracewright.plans.registry import PAIR_ORDER, PAIRS_SQL, PATHS, SINKS_SQL, THRESHOLD, best_coded_pairs, path_rows, query, sinks, t

KEY = ("user_id",)
SAY = lambda c: F.array_join(F.transform(c, lambda p: F.concat(p["depth"].cast("string"), F.lit(":"), p["java_code"])), "|")
THREE = f"""WITH {PATHS}, a AS (SELECT *, row_number() OVER (PARTITION BY user_id, depth ORDER BY seq) AS rn, dense_rank() OVER (PARTITION BY user_id ORDER BY depth DESC) AS dr FROM paths),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN rn = 1 AND dr <= 3 THEN 0 ELSE 1 END, CASE WHEN rn = 1 AND dr <= 3 THEN dr ELSE depth END, CASE WHEN rn = 1 AND dr <= 3 THEN 0 ELSE seq END) AS place FROM a)"""


def api(spark, sf_dir):
    return paths.collect_paths(path_rows(spark, sf_dir), KEY)


@query("agg_collect_paths", f"WITH {PATHS} SELECT user_id, CAST(count(*) AS BIGINT) AS n, string_agg(depth || ':' || java_code, '|' ORDER BY depth, seq) AS paths FROM paths GROUP BY user_id")
def agg_collect_paths(spark, sf_dir):
    return api(spark, sf_dir).select("user_id", F.size("depths").cast("long").alias("n"), SAY("depths").alias("paths"))


@query("win_three_paths", THREE + " SELECT user_id, depth, seq, java_code, place FROM b WHERE place <= 3")
def win_three_paths(spark, sf_dir):
    return paths.three_paths(path_rows(spark, sf_dir), KEY).select("user_id", "depth", "seq", "java_code", "place")


@query("win_three_paths_nested", THREE + " SELECT user_id, string_agg(depth || ':' || java_code, '|' ORDER BY place) AS paths FROM b WHERE place <= 3 GROUP BY user_id")
def win_three_paths_nested(spark, sf_dir):
    return api(spark, sf_dir).select("user_id", SAY(paths.three_paths_nested(F.col("depths"))).alias("paths"))


@query("str_prompt1", THREE + " SELECT user_id, string_agg('This is path ' || place || ' for the API with depth ' || depth || ':' || chr(10) || java_code, chr(10) || chr(10) ORDER BY place) AS prompt1 FROM b WHERE place <= 3 GROUP BY user_id")
def str_prompt1(spark, sf_dir):
    return api(spark, sf_dir).select("user_id", text.numbered_paths(paths.three_paths_nested(F.col("depths"))).alias("prompt1"))


@query("win_max_depth_paths", f"WITH {PATHS}, a AS (SELECT *, max(depth) OVER (PARTITION BY user_id) AS top FROM paths), b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS i FROM a WHERE depth = top) SELECT user_id, string_agg('Path ' || i || ':' || chr(10) || java_code, chr(10) ORDER BY i) AS text FROM b GROUP BY user_id")
def win_max_depth_paths(spark, sf_dir):
    return api(spark, sf_dir).select("user_id", paths.deepest_text(F.col("depths")).alias("text"))


@query("arr_max", f"WITH {PATHS} SELECT user_id, CAST(max(depth) AS BIGINT) AS top FROM paths GROUP BY user_id")
def arr_max(spark, sf_dir):
    return api(spark, sf_dir).select("user_id", F.array_max(F.transform("depths", lambda p: p["depth"])).cast("long").alias("top"))


@query("sort_depth", f"WITH {PATHS} SELECT user_id, seq, depth, row_number() OVER (PARTITION BY user_id ORDER BY depth, seq) AS place FROM paths")
def sort_depth(spark, sf_dir):
    placed = paths.collect_paths(path_rows(spark, sf_dir).withColumn("java_code", F.col("seq").cast("string")), KEY).select("user_id", F.posexplode("depths").alias("i", "p"))
    return placed.select("user_id", F.col("p.java_code").cast("long").alias("seq"), "p.depth", (F.col("i") + 1).cast("long").alias("place"))


@query("win_enumerate", f"WITH {PATHS} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY depth, seq) AS number, java_code FROM paths")
def win_enumerate(spark, sf_dir):
    return api(spark, sf_dir).select("user_id", F.posexplode("depths").alias("i", "p")).select("user_id", (F.col("i") + 1).cast("long").alias("number"), "p.java_code")


@query("str_first_line", f"WITH {PATHS} SELECT user_id, split_part(arg_min(java_code, CAST(depth AS BIGINT) * 1000000000 + seq), chr(10), 1) AS signature FROM paths GROUP BY user_id")
def str_first_line(spark, sf_dir):
    return api(spark, sf_dir).select("user_id", text.first_line(F.col("depths")[0]["java_code"]).alias("signature"))


@query("join_cosine_theta", f"WITH {PAIRS_SQL} SELECT ep1, ep1_sink_idx, ep2_id, ep2_sink_idx, round(similarity, 6) AS similarity FROM pr")
def join_cosine_theta(spark, sf_dir):
    return similarity.cosine_pairs(sinks(spark, sf_dir), THRESHOLD).withColumn("similarity", F.round("similarity", 6))


@query("join_cosine_native", f"WITH {PAIRS_SQL} SELECT ep1, ep1_sink_idx, ep2_id, ep2_sink_idx, round(similarity, 6) AS similarity FROM pr")
def join_cosine_native(spark, sf_dir):
    return similarity.cosine_pairs_native(sinks(spark, sf_dir), THRESHOLD).withColumn("similarity", F.round("similarity", 6))


@query("join_cosine_loop", f"WITH {SINKS_SQL} SELECT a.method AS ep1, a.sink_idx AS ep1_sink_idx, b.method AS ep2_id, b.sink_idx AS ep2_sink_idx, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM sk a JOIN sk b ON a.sink_idx <> b.sink_idx WHERE list_cosine_similarity(a.v, b.v) > {THRESHOLD}")
def join_cosine_loop(spark, sf_dir):
    return similarity.cosine_pairs(sinks(spark, sf_dir), THRESHOLD, same_row_only=True).withColumn("similarity", F.round("similarity", 6))


@query("flt_sim_gt", f"WITH {PAIRS_SQL} SELECT ep1, ep1_sink_idx, ep2_id, ep2_sink_idx FROM pr WHERE similarity > 0.35")
def flt_sim_gt(spark, sf_dir):
    return similarity.cosine_pairs(sinks(spark, sf_dir), THRESHOLD).where("similarity > 0.35").drop("similarity")


@query("join_argmax_neighbor", f"WITH {PAIRS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY ep1 {PAIR_ORDER}) AS p FROM pr), e AS (SELECT DISTINCT method FROM sk UNION ALL SELECT 'api-none') SELECT e.method AS ep, ep1_sink_idx, ep2_id, ep2_sink_idx, round(coalesce(similarity, -1.0), 6) AS similarity FROM e LEFT JOIN (SELECT * FROM r WHERE p = 1) b ON e.method = b.ep1")
def join_argmax_neighbor(spark, sf_dir):
    s = sinks(spark, sf_dir)
    eps = s.select("method").distinct().union(spark.range(1).select(F.lit("api-none")))
    return similarity.best_neighbour(eps, similarity.first_pairs(s, THRESHOLD, 1)).select("ep", "ep1_sink_idx", "ep2_id", "ep2_sink_idx", F.round("similarity", 6).alias("similarity"))


@query("win_top_k", f"WITH {PAIRS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY ep1 {PAIR_ORDER}) AS place FROM pr) SELECT ep1, ep1_sink_idx, ep2_id, ep2_sink_idx, place FROM r WHERE place <= 2")
def win_top_k(spark, sf_dir):
    return similarity.top_pairs(similarity.first_pairs(sinks(spark, sf_dir), THRESHOLD, 2), 2).select("ep1", "ep1_sink_idx", "ep2_id", "ep2_sink_idx", "place")


def _diversified_sql(n: int) -> str:
    return f"""WITH {PAIRS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY ep1 {PAIR_ORDER}) AS r FROM pr),
c AS (SELECT *, row_number() OVER (PARTITION BY ep1, ep2_code ORDER BY r) AS c FROM r),
f AS (SELECT *, CAST(row_number() OVER (PARTITION BY ep1, ep2_id ORDER BY r) = 1 AS INTEGER) AS f FROM c WHERE c = 1),
n AS (SELECT *, sum(f) OVER (PARTITION BY ep1 ORDER BY r) AS n FROM f)
SELECT ep1, ep1_sink_idx, ep2_id, ep2_sink_idx, ep2_code, row_number() OVER (PARTITION BY ep1 ORDER BY r) AS place, round(similarity, 6) AS similarity FROM n WHERE n <= {n}"""


@query("win_top_diversified", _diversified_sql(4))
def win_top_diversified(spark, sf_dir):
    d = similarity.diversified(best_coded_pairs(spark, sf_dir), 4)
    return d.select("ep1", "ep1_sink_idx", "ep2_id", "ep2_sink_idx", "ep2_code", "place", F.round("similarity", 6).alias("similarity"))


@query("win_top_diversified_5", _diversified_sql(5))
def win_top_diversified_5(spark, sf_dir):
    d = similarity.diversified(best_coded_pairs(spark, sf_dir), 5)
    return d.select("ep1", "ep1_sink_idx", "ep2_id", "ep2_sink_idx", "ep2_code", "place", F.round("similarity", 6).alias("similarity"))


@query("map_group", f"WITH d AS ({_diversified_sql(4)}) SELECT ep1, ep2_id, CAST(count(*) AS BIGINT) AS entries, CAST(min(place) AS BIGINT) AS first FROM d GROUP BY ep1, ep2_id")
def map_group(spark, sf_dir):
    d = similarity.diversified(best_coded_pairs(spark, sf_dir), 4)
    return d.groupBy("ep1", "ep2_id").agg(F.count("*").alias("entries"), F.min("place").alias("first"))


@query("agg_max_per_pair", f"WITH {PAIRS_SQL} SELECT ep1, ep2_id, round(max(similarity), 6) AS best FROM pr GROUP BY ep1, ep2_id")
def agg_max_per_pair(spark, sf_dir):
    return similarity.cosine_pairs(sinks(spark, sf_dir), THRESHOLD).groupBy("ep1", "ep2_id").agg(F.round(F.max("similarity"), 6).alias("best"))


@query("agg_count_no_match", f"WITH {PAIRS_SQL} SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT sink_idx FROM sk WHERE sink_idx NOT IN (SELECT ep1_sink_idx FROM pr WHERE similarity > 0.4))")
def agg_count_no_match(spark, sf_dir):
    s = sinks(spark, sf_dir)
    p = similarity.cosine_pairs(s, 0.4).select(F.col("ep1_sink_idx").alias("sink_idx")).distinct()
    return s.join(p, "sink_idx", "left_anti").agg(F.count("*").alias("n"))


@query("q_valid_methods", f"WITH {PAIRS_SQL} SELECT DISTINCT ep1 AS method FROM pr WHERE similarity > 0.4")
def q_valid_methods(spark, sf_dir):
    return similarity.cosine_pairs(sinks(spark, sf_dir), 0.4).select(F.col("ep1").alias("method")).distinct()


SWEEP = " UNION ALL ".join(f"SELECT CAST({x} AS DOUBLE) AS threshold, CAST(count(*) AS BIGINT) AS pairs, CAST(count(DISTINCT ep1) AS BIGINT) AS methods FROM pr WHERE similarity > {x}" for x in (0.3, 0.35, 0.4))


@query("q_sweep", f"WITH {PAIRS_SQL} {SWEEP}")
def q_sweep(spark, sf_dir):
    p = similarity.cosine_pairs(sinks(spark, sf_dir), THRESHOLD)
    grid = p.select("ep1", F.explode(F.filter(F.array(*map(F.lit, (0.3, 0.35, 0.4))), lambda x: F.col("similarity") > x)).alias("threshold"))
    return grid.groupBy("threshold").agg(F.count("*").alias("pairs"), F.count_distinct("ep1").alias("methods"))


@query("arr_l2_normalize", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE / list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS length, round(embedding[1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first FROM embeddings")
def arr_l2_normalize(spark, sf_dir):
    from tracewright.functions.arrays import dot, normalised

    n = t(spark, sf_dir, "embeddings").select("vec_id", normalised(F.col("embedding")).alias("v"))
    return n.select("vec_id", F.round(dot(F.col("v"), F.col("v")), 6).alias("length"), F.round(F.col("v")[0], 6).alias("first"))


@query("arr_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def arr_cosine(spark, sf_dir):
    from tracewright.functions.arrays import cosine

    a = t(spark, sf_dir, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query("arr_explode_pos", f"WITH {SINKS_SQL}, g AS (SELECT method, row_number() OVER (PARTITION BY method ORDER BY sink_idx) - 1 AS sink_idx, code, round(v[1], 6) AS first FROM sk) SELECT * FROM g")
def arr_explode_pos(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct("sink_idx", "code", "embedding")))
    api_rows = sinks(spark, sf_dir).groupBy("method").agg(rows.alias("r")).select("method", F.transform("r", lambda x: x["code"]).alias("sink_code"), F.transform("r", lambda x: x["embedding"]).alias("embeddings"))
    out = similarity.explode_sinks(api_rows)
    return out.select("method", F.col("sink_idx").cast("long").alias("sink_idx"), "code", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query("prj_case_sensitivity", f"""WITH {PAIRS_SQL}, x AS (SELECT ep1_sink_idx % 3 AS i, ep2_sink_idx % 3 AS j FROM pr) SELECT CASE WHEN i = 0 AND j = 0 THEN '(Top-sensitive sinks matched)' WHEN i = 0 THEN '(Top-sensitive sink in source matched to position ' || (j + 1) || ' in target)'
WHEN j = 0 THEN '(Position ' || (i + 1) || ' in source matched to top-sensitive sink in target)' ELSE '(Position ' || (i + 1) || ' in source matched to position ' || (j + 1) || ' in target)' END AS said, CAST(count(*) AS BIGINT) AS n FROM x GROUP BY 1""")
def prj_case_sensitivity(spark, sf_dir):
    from tracewright.plans.prompts import sensitivity

    p = similarity.cosine_pairs(sinks(spark, sf_dir), THRESHOLD)
    return p.select(sensitivity(F.col("ep1_sink_idx") % 3, F.col("ep2_sink_idx") % 3).alias("said")).groupBy("said").agg(F.count("*").alias("n"))
