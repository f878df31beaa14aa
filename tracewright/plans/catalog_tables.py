"""Queries: filters, projections, joins, aggregates, sorts, set operations and sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright.functions import arrays
from tracewright.operators import paths, relational
from tracewright.operators.running import running
from tracewright.plans.registry import LEVELS_SQL, PATHS, RANK, levels, path_rows, query, t
from tracewright.schemas import INVALID

LV = f"WITH {LEVELS_SQL} "

# filters and predicates ------------------------------------------------------------------------------------------------------------


@query("flt_eq_service", LV + "SELECT id, method, actual FROM lv WHERE service = 'svc7'")
def flt_eq_service(spark, sf_dir):
    return levels(spark, sf_dir).where(F.col("service") == "svc7").select("id", "method", "actual")


@query("flt_not_invalid", LV + "SELECT id, predicted FROM lv WHERE predicted IS DISTINCT FROM 'invalid'")
def flt_not_invalid(spark, sf_dir):
    return levels(spark, sf_dir).where(relational.not_equal_or_null(F.col("predicted"), INVALID)).select("id", "predicted")


@query("flt_not_contains", LV + "SELECT id, predicted FROM lv WHERE predicted NOT LIKE '%inval%'")
def flt_not_contains(spark, sf_dir):
    return levels(spark, sf_dir).where(~F.contains("predicted", F.lit("inval"))).select("id", "predicted")


@query("flt_str_contains", LV + "SELECT id FROM lv WHERE coalesce(regexp_matches(predicted, 'N.N|SYS_.R'), false)")
def flt_str_contains(spark, sf_dir):
    return levels(spark, sf_dir).where(relational.matches(F.col("predicted"), "N.N|SYS_.R")).select("id")


@query("flt_isin", LV + "SELECT id FROM lv WHERE predicted IN ('NONE', 'invalid')")
def flt_isin(spark, sf_dir):
    return levels(spark, sf_dir).where(F.col("predicted").isin("NONE", "invalid")).select("id")


@query("flt_not_isin", LV + "SELECT id FROM lv WHERE predicted IS NULL OR predicted NOT IN ('NONE', 'invalid')")
def flt_not_isin(spark, sf_dir):
    return levels(spark, sf_dir).where(~F.coalesce(F.col("predicted").isin("NONE", "invalid"), F.lit(False))).select("id")


@query("flt_and_mismatch", LV + "SELECT id FROM lv WHERE actual = 'NONE' AND predicted = 'SYS_OR_SIG'")
def flt_and_mismatch(spark, sf_dir):
    return levels(spark, sf_dir).where((F.col("actual") == "NONE") & (F.col("predicted") == "SYS_OR_SIG")).select("id")


@query("flt_rank_gt", LV + f"SELECT id, actual, predicted FROM lv WHERE {RANK.format(c='predicted')} > {RANK.format(c='actual')}")
def flt_rank_gt(spark, sf_dir):
    return levels(spark, sf_dir).where(relational.stricter(F.col("predicted"), F.col("actual"))).select("id", "actual", "predicted")


@query("flt_null", LV + "SELECT id FROM lv WHERE predicted IS NULL")
def flt_null(spark, sf_dir):
    return levels(spark, sf_dir).where(F.col("predicted").isNull()).select("id")


@query("flt_dropna", LV + "SELECT id, predicted FROM lv WHERE predicted IS NOT NULL")
def flt_dropna(spark, sf_dir):
    return levels(spark, sf_dir).na.drop(subset=["predicted"]).select("id", "predicted")


@query("flt_nonempty_array", "SELECT doc_id FROM documents WHERE len(list_filter(string_split(text, ' '), lambda x: x = 'the')) > 0")
def flt_nonempty_array(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", F.filter(F.split("text", " "), lambda x: x == "the").alias("embeddings"))
    return d.where(F.size("embeddings") > 0).select("doc_id")


@query("flt_head", "SELECT id FROM (SELECT o_orderkey AS id FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10)")
def flt_head(spark, sf_dir):
    return levels(spark, sf_dir).orderBy(F.col("price").desc(), "id").limit(10).select("id")


@query("flt_skip_not_to_run", LV + ", b AS (SELECT DISTINCT 'm' || c_custkey AS method FROM customer WHERE c_custkey % 3 = 0) SELECT id FROM lv WHERE method NOT IN (SELECT method FROM b) AND actual <> 'SYS_OR_SIG'")
def flt_skip_not_to_run(spark, sf_dir):
    return relational.to_run(levels(spark, sf_dir), _baseline(spark, sf_dir), "method", "actual").where("to_run").select("id")


@query("flt_debug_truth", LV + "SELECT id, predicted FROM lv WHERE actual = 'NONE'")
def flt_debug_truth(spark, sf_dir):
    return levels(spark, sf_dir).where(F.col("actual") == "NONE").select("id", "predicted")


@query("prj_drop", LV + "SELECT id, method, actual, predicted FROM lv")
def prj_drop(spark, sf_dir):
    return levels(spark, sf_dir).drop("service", "price")


@query("prj_conditional_update", LV + "SELECT id, CASE WHEN service = 'svc3' THEN 'NORMAL' ELSE actual END AS actual FROM lv")
def prj_conditional_update(spark, sf_dir):
    return levels(spark, sf_dir).select("id", F.when(F.col("service") == "svc3", "NORMAL").otherwise(F.col("actual")).alias("actual"))


@query("prj_const_default", LV + "SELECT id, 'invalid' AS json_answer2, CAST(NULL AS VARCHAR) AS res2, CAST(0 AS BIGINT) AS input_tokens FROM lv")
def prj_const_default(spark, sf_dir):
    return levels(spark, sf_dir).select("id", F.lit(INVALID).alias("json_answer2"), F.lit(None).cast("string").alias("res2"), F.lit(0).cast("long").alias("input_tokens"))


@query("prj_enum_rank", LV + f"SELECT id, {RANK.format(c='predicted')} AS rank FROM lv")
def prj_enum_rank(spark, sf_dir):
    return levels(spark, sf_dir).select("id", arrays.level_rank(F.col("predicted")).alias("rank"))


@query("map_enum", LV + f"SELECT actual, CAST(max({RANK.format(c='actual')}) AS BIGINT) AS rank FROM lv GROUP BY actual")
def map_enum(spark, sf_dir):
    return levels(spark, sf_dir).groupBy("actual").agg(F.max(arrays.level_rank(F.col("actual"))).cast("long").alias("rank"))


@query("prj_ac_map", "SELECT event_id, CASE WHEN event_id % 5 - 1 IN (-1, 0, 1) THEN 0 ELSE 1 END AS label FROM events")
def prj_ac_map(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", paths.dynamic_label((F.col("event_id") % 5 - 1).cast("int")).alias("label"))


# joins -----------------------------------------------------------------------------------------------------------------------------


def _baseline(spark, sf_dir):
    return t(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("method"))


BASE = ", b AS (SELECT DISTINCT 'm' || c_custkey AS method FROM customer WHERE c_custkey % 3 = 0) "


@query("join_lookup_first", LV + ", f AS (SELECT method, arg_min(service, id) AS service, arg_min(actual, id) AS level FROM lv GROUP BY method) SELECT c_custkey, coalesce(f.level, 'Unknown') AS level FROM customer LEFT JOIN f ON f.method = 'm' || c_custkey")
def join_lookup_first(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("ep2_id"))
    found = relational.first_match(c.withColumnRenamed("ep2_id", "method"), levels(spark, sf_dir), "method", "id", "actual", "level")
    return found.select("c_custkey", "level")


@query("join_left_checkpoint", "SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 2 = 0 THEN CAST(d.n_chars AS BIGINT) END, CAST(l.quality AS BIGINT)) AS answer FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def join_left_checkpoint(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")).cast("long").alias("answer"))
    done = t(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("answer"))
    return relational.with_checkpoint(d, done, "doc_id", ["answer"])


@query("join_restore_kv", LV + ", d AS (SELECT method, service, arg_max(predicted, id) AS predicted FROM lv WHERE predicted IS NOT NULL GROUP BY method, service), c AS (SELECT 'm' || c_custkey AS method, 'svc' || (c_custkey % 20) AS service FROM customer) SELECT c.method, c.service, coalesce(d.predicted, 'new') AS answer FROM c LEFT JOIN d ON c.method = d.method AND c.service = d.service")
def join_restore_kv(spark, sf_dir):
    k = F.col("c_custkey")
    c = t(spark, sf_dir, "customer").select(F.concat(F.lit("m"), k.cast("string")).alias("method"), F.concat(F.lit("svc"), (k % 20).cast("string")).alias("service"), F.lit("new").alias("answer"))
    done = levels(spark, sf_dir).withColumn("answer", F.col("predicted"))
    return relational.restore_processed(c, done, ["method", "service"], ["answer"], "id", "predicted")


@query("join_inner_multi", LV + "SELECT a.method, a.service, CAST(count(*) AS BIGINT) AS n FROM lv a JOIN lv b ON a.method = b.method AND a.service = b.service WHERE a.predicted = 'NONE' AND b.predicted = 'NORMAL' GROUP BY 1, 2")
def join_inner_multi(spark, sf_dir):
    lv = levels(spark, sf_dir)
    both = relational.in_both(lv.where("predicted = 'NONE'"), lv.where("predicted = 'NORMAL'"), ["method", "service"])
    return both.groupBy("method", "service").agg(F.count("*").alias("n"))


@query("join_anti_multi", LV + "SELECT a.id FROM lv a WHERE a.predicted = 'NONE' AND NOT EXISTS (SELECT 1 FROM lv b WHERE b.predicted = 'NORMAL' AND a.method = b.method AND a.service = b.service)")
def join_anti_multi(spark, sf_dir):
    lv = levels(spark, sf_dir)
    return relational.not_in(lv.where("predicted = 'NONE'"), lv.where("predicted = 'NORMAL'"), ["method", "service"]).select("id")


@query("join_anti_single", LV + BASE + "SELECT id FROM lv WHERE method NOT IN (SELECT method FROM b)")
def join_anti_single(spark, sf_dir):
    return relational.not_in(levels(spark, sf_dir), _baseline(spark, sf_dir), ["method"]).select("id")


@query("join_semi", LV + BASE + "SELECT id FROM lv WHERE method IN (SELECT method FROM b)")
def join_semi(spark, sf_dir):
    return relational.only_in(levels(spark, sf_dir), _baseline(spark, sf_dir), ["method"]).select("id")


@query("join_membership_flag", LV + BASE + "SELECT id, actual <> 'SYS_OR_SIG' AND method NOT IN (SELECT method FROM b) AS to_run FROM lv")
def join_membership_flag(spark, sf_dir):
    return relational.to_run(levels(spark, sf_dir), _baseline(spark, sf_dir), "method", "actual").select("id", "to_run")


BATCH = "CASE o_orderkey % 4 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'errored' WHEN 2 THEN 'expired' ELSE 'strange' END"


@query("join_batch_results", f"SELECT d.doc_id, CASE {BATCH} WHEN 'succeeded' THEN o_orderpriority WHEN 'errored' THEN 'Error: request errored' WHEN 'expired' THEN 'Error: request expired' WHEN 'strange' THEN 'Error: unknown result type' END AS res2 FROM documents d LEFT JOIN orders o ON o.o_orderkey = d.doc_id")
def join_batch_results(spark, sf_dir):
    from tracewright.functions.models import batch_results

    k = F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "succeeded").when(k % 4 == 1, "errored").when(k % 4 == 2, "expired").otherwise("strange")
    results = t(spark, sf_dir, "orders").select(k.cast("string").alias("custom_id"), kind.alias("type"), F.col("o_orderpriority").alias("text"))
    return batch_results(t(spark, sf_dir, "documents").select("doc_id"), results, "doc_id", "res2")


# aggregates ------------------------------------------------------------------------------------------------------------------------


@query("agg_value_counts", LV + 'SELECT predicted, CAST(count(*) AS BIGINT) AS "Count" FROM lv WHERE predicted IS NOT NULL GROUP BY predicted')
def agg_value_counts(spark, sf_dir):
    return relational.value_counts(levels(spark, sf_dir), "predicted")


CONFUSION = "c AS (SELECT actual, predicted, CAST(count(*) AS BIGINT) AS n FROM lv WHERE predicted IS NOT NULL AND predicted <> 'invalid' GROUP BY 1, 2)"


@query("agg_pct_of_total", LV + f', {CONFUSION} SELECT actual, predicted, round(n * 100.0 / sum(n) OVER (PARTITION BY actual), 6)::DOUBLE AS "Percentage" FROM c')
def agg_pct_of_total(spark, sf_dir):
    return _confusion(spark, sf_dir).select("actual", "predicted", F.round("Percentage", 6).alias("Percentage"))


def _confusion(spark, sf_dir):
    valid = levels(spark, sf_dir).where(relational.not_equal_or_null(F.col("predicted"), INVALID))
    return relational.confusion(valid, "actual", "predicted")


@query("agg_confusion", LV + f', {CONFUSION} SELECT actual, predicted, n AS "Count" FROM c')
def agg_confusion(spark, sf_dir):
    return _confusion(spark, sf_dir).select("actual", "predicted", "Count")


@query("agg_accuracy", LV + "SELECT round(avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END) * 100, 6)::DOUBLE AS accuracy, CAST(count(*) AS BIGINT) AS rows FROM lv WHERE predicted IS DISTINCT FROM 'invalid'")
def agg_accuracy(spark, sf_dir):
    return relational.accuracy(levels(spark, sf_dir), "actual", "predicted").select(F.round("accuracy", 6).alias("accuracy"), "rows")


BUCKETS = "b AS (SELECT *, CASE WHEN label = 0 THEN seq ELSE (row_number() OVER (PARTITION BY EP ORDER BY seq) - 1) // 4 END AS grp FROM x)"
BLOCKS = "x AS (SELECT l_orderkey AS EP, CAST(l_linenumber AS BIGINT) * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS seq, CAST(l_suppkey AS VARCHAR) AS code, CAST(l_linenumber % 3 > 0 AS INTEGER) AS label FROM lineitem)"


def _blocks(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("EP"), (F.col("l_linenumber").cast("long") * 100000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000).alias("seq"), F.col("l_suppkey").cast("string").alias("code"), (F.col("l_linenumber") % 3 > 0).cast("int").alias("label"))


@query("agg_string_join", f'WITH {BLOCKS}, {BUCKETS} SELECT EP AS "EP", grp AS "group", string_agg(code, \'<PATH_SEP>\' ORDER BY seq) AS code FROM b GROUP BY EP, label, grp')
def agg_string_join(spark, sf_dir):
    return paths.merge_blocks(_blocks(spark, sf_dir)).select("EP", "group", "code")


@query("win_cumcount_bucket", f'WITH {BLOCKS}, {BUCKETS} SELECT EP AS "EP", grp AS "group", CAST(count(*) AS BIGINT) AS n FROM b GROUP BY EP, label, grp')
def win_cumcount_bucket(spark, sf_dir):
    m = paths.merge_blocks(_blocks(spark, sf_dir))
    return m.select("EP", "group", F.size(F.split("code", "<PATH_SEP>")).cast("long").alias("n"))


@query("agg_transform_max", f'WITH {BLOCKS}, {BUCKETS}, g AS (SELECT EP, label, grp, min(seq) AS seq FROM b GROUP BY EP, label, grp) SELECT EP AS "EP", seq, max(label) OVER (PARTITION BY EP) AS label FROM g')
def agg_transform_max(spark, sf_dir):
    return paths.merge_blocks(_blocks(spark, sf_dir)).select("EP", "seq", "label")


@query("agg_dedupe_longest", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, text, doc_id) AS r FROM documents) WHERE r = 1")
def agg_dedupe_longest(spark, sf_dir):
    d = t(spark, sf_dir, "documents").groupBy("source", "text").agg(F.min("doc_id").alias("doc_id"))
    return paths.longest_per_key(d, "source", "text").select("source", "doc_id")


@query("agg_token_sum_avg", "WITH x AS (SELECT CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(n_chars AS BIGINT) END AS input_tokens FROM documents) SELECT CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS input_tokens_total, round(avg(coalesce(input_tokens, 0)), 6) AS input_tokens_mean FROM x")
def agg_token_sum_avg(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 3 != 0, F.col("n_chars")).alias("input_tokens"))
    return relational.token_totals(d, "input_tokens").withColumn("input_tokens_mean", F.round("input_tokens_mean", 6))


@query("agg_valid_counter", """SELECT CAST(count(*) FILTER (CAST(props::JSON->>'k' AS INTEGER) % 2 = 0) AS BIGINT) AS valid, CAST(count(*) FILTER (CAST(props::JSON->>'k' AS INTEGER) % 2 = 1) AS BIGINT) AS invalid FROM events""")
def agg_valid_counter(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return t(spark, sf_dir, "events").agg(F.count_if(k % 2 == 0).alias("valid"), F.count_if(k % 2 == 1).alias("invalid"))


@query("agg_funnel", "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (html LIKE '%</html>%') AS BIGINT) AS closed, CAST(count(*) FILTER (html LIKE '%</article>%') AS BIGINT) AS with_article FROM pages")
def agg_funnel(spark, sf_dir):
    return relational.funnel(t(spark, sf_dir, "pages"), {"closed": F.contains("html", F.lit("</html>")), "with_article": F.contains("html", F.lit("</article>"))})


@query("agg_unique", LV + "SELECT DISTINCT method, service FROM lv")
def agg_unique(spark, sf_dir):
    return levels(spark, sf_dir).select("method", "service").distinct()


@query("agg_shape", LV + "SELECT CAST(count(*) AS BIGINT) AS rows FROM lv WHERE predicted IS NOT NULL")
def agg_shape(spark, sf_dir):
    return levels(spark, sf_dir).where(F.col("predicted").isNotNull()).agg(F.count("*").alias("rows"))


RUNS = "runs AS (SELECT CAST(o_custkey % 7 + 1 AS BIGINT) AS size, round(sum(o_totalprice), 2) AS seconds FROM orders GROUP BY 1)"


def _runs(spark, sf_dir):
    return t(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 7 + 1).alias("size")).agg(F.round(F.sum("o_totalprice"), 2).alias("seconds"))


@query("agg_speedup_throughput", f"WITH {RUNS} SELECT size, round(size / seconds, 12) AS throughput, round((SELECT seconds / size FROM runs WHERE size = 1) / (seconds / size), 4) AS speedup FROM runs")
def agg_speedup_throughput(spark, sf_dir):
    r = relational.speedup(_runs(spark, sf_dir))
    return r.select("size", F.round("throughput", 12).alias("throughput"), F.round("speedup", 4).alias("speedup"))


@query("topk_argmax", f"WITH {RUNS} SELECT arg_max(size, size / seconds) AS best FROM runs")
def topk_argmax(spark, sf_dir):
    return relational.speedup(_runs(spark, sf_dir)).agg(F.max_by("size", "throughput").alias("best"))


@query("agg_cls_metrics", """WITH c AS (SELECT CAST(count(*) FILTER (quality = 1 AND toxic = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (quality = 0 AND toxic = 1) AS DOUBLE) AS fp, CAST(count(*) FILTER (quality = 1 AND toxic = 0) AS DOUBLE) AS fn, CAST(count(*) FILTER (quality = 0 AND toxic = 0) AS DOUBLE) AS tn FROM labels)
SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS roc_auc FROM c""")
def agg_cls_metrics(spark, sf_dir):
    m = relational.classifier_metrics(t(spark, sf_dir, "labels"), "quality", "toxic")
    return m.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1", "roc_auc")])


ROC = f"""{LEVELS_SQL}, c AS (SELECT CAST(floor(price / 10) AS BIGINT) AS score, CAST(count(*) FILTER (actual = 'DANGEROUS') AS BIGINT) AS pos, CAST(count(*) FILTER (actual <> 'DANGEROUS') AS BIGINT) AS neg FROM lv GROUP BY 1),
r AS (SELECT score, pos, neg, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp, CAST(sum(pos) OVER () AS DOUBLE) AS p, CAST(sum(neg) OVER () AS DOUBLE) AS n FROM c WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


def roc_curve(spark, sf_dir):
    scored = levels(spark, sf_dir).select((F.col("actual") == "DANGEROUS").cast("int").alias("label"), F.floor(F.col("price") / 10).alias("score"))
    return relational.roc_points(scored, "label", "score")


@query("agg_roc_points", f"WITH {ROC} SELECT score, tp, fp, tp / p AS tpr, fp / n AS fpr FROM r")
def agg_roc_points(spark, sf_dir):
    return roc_curve(spark, sf_dir).select("score", "tp", "fp", "tpr", "fpr")


@query("agg_roc_auc", f"WITH {ROC} SELECT round(sum(neg / n * ((2 * tp - pos) / (2 * p))), 9) AS auc FROM r")
def agg_roc_auc(spark, sf_dir):
    return roc_curve(spark, sf_dir).agg(F.round(F.sum("area"), 9).alias("auc"))


# windows, sorts, sets --------------------------------------------------------------------------------------------------------------


@query("win_state_fill", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS held FROM conversations")
def win_state_fill(spark, sf_dir):
    turns = t(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return running(turns, ["conv_id"], ["turn"], lasts={"held": F.when(F.col("role") == "user", F.col("turn"))}).select("conv_id", "turn", "held")


@query("win_prefixes", "WITH w AS (SELECT p_partkey, string_split(p_type, ' ') AS a FROM part) SELECT p_partkey, array_to_string(list_transform(range(1, len(a) + 1), lambda i: array_to_string(a[1:i], ' ')), '|') AS prefixes FROM w")
def win_prefixes(spark, sf_dir):
    p = t(spark, sf_dir, "part").select("p_partkey", arrays.prefixes(F.split("p_type", " ")).alias("a"))
    return p.select("p_partkey", F.array_join(F.transform("a", lambda x: F.array_join(x, " ")), "|").alias("prefixes"))


@query("sort_sim_desc", "SELECT id, place FROM (SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders)")
def sort_sim_desc(spark, sf_dir):
    w = Window.partitionBy("method").orderBy(F.col("price").desc(), "id")
    return levels(spark, sf_dir).select("id", F.row_number().over(w).cast("long").alias("place"))


@query("sort_len_desc", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS place FROM documents")
def sort_len_desc(spark, sf_dir):
    w = Window.partitionBy("source").orderBy(F.char_length("text").desc(), "doc_id")
    return t(spark, sf_dir, "documents").select("doc_id", F.row_number().over(w).cast("long").alias("place"))


@query("limit_n", "SELECT p_partkey, array_to_string(string_split(p_type, ' ')[1:2], '|') AS sinks FROM part")
def limit_n(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", F.array_join(F.slice(F.split("p_type", " "), 1, 2), "|").alias("sinks"))


@query("set_union_all", LV + "SELECT id, predicted FROM lv WHERE predicted = 'NONE' UNION ALL SELECT id, predicted FROM lv WHERE predicted IN ('NONE', 'NORMAL')")
def set_union_all(spark, sf_dir):
    lv = levels(spark, sf_dir).select("id", "predicted")
    return lv.where("predicted = 'NONE'").unionByName(lv.where("predicted IN ('NONE', 'NORMAL')"))


@query("set_intersect", LV + "SELECT method, service FROM lv WHERE predicted = 'NONE' INTERSECT SELECT method, service FROM lv WHERE predicted = 'NORMAL'")
def set_intersect(spark, sf_dir):
    lv = levels(spark, sf_dir)
    return lv.where("predicted = 'NONE'").select("method", "service").intersect(lv.where("predicted = 'NORMAL'").select("method", "service"))


@query("set_except", LV + "SELECT method, service FROM lv WHERE predicted = 'NONE' EXCEPT SELECT method, service FROM lv WHERE predicted = 'NORMAL'")
def set_except(spark, sf_dir):
    lv = levels(spark, sf_dir)
    return lv.where("predicted = 'NONE'").select("method", "service").distinct().exceptAll(lv.where("predicted = 'NORMAL'").select("method", "service").distinct())


@query("set_concat_lists", f"WITH {PATHS} SELECT user_id % 10 AS g, string_agg(java_code, '|' ORDER BY user_id, depth, seq) AS codes FROM paths GROUP BY 1")
def set_concat_lists(spark, sf_dir):
    nested = paths.collect_paths(path_rows(spark, sf_dir), ("user_id",))
    lists = nested.groupBy((F.col("user_id") % 10).alias("g")).agg(F.array_sort(F.collect_list(F.struct("user_id", F.transform("depths", lambda p: p["java_code"]).alias("c")))).alias("l"))
    return lists.select("g", F.array_join(F.flatten(F.transform("l", lambda x: x["c"])), "|").alias("codes"))


# sampling and splits ---------------------------------------------------------------------------------------------------------------


@query("smp_stratified_split", "SELECT quality, split, n FROM (SELECT quality, 'train' AS split, CAST(floor(count(*) * 0.8) AS BIGINT) AS n FROM labels GROUP BY quality UNION ALL SELECT quality, 'test', CAST(count(*) - floor(count(*) * 0.8) AS BIGINT) FROM labels GROUP BY quality)")
def smp_stratified_split(spark, sf_dir):
    return relational.stratified_split(t(spark, sf_dir, "labels"), "quality", "doc_id").groupBy("quality", "split").agg(F.count("*").alias("n"))


@query("smp_shuffle_group", "SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(sum(place) AS BIGINT) AS places, CAST(sum(doc_id) AS BIGINT) AS ids FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents) GROUP BY source")
def smp_shuffle_group(spark, sf_dir):
    d = relational.seeded_order(t(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.sum("place").alias("places"), F.sum("doc_id").alias("ids"))


@query("smp_oversample_merge", "WITH c AS (SELECT count(*) FILTER (quality = 0) AS few, count(*) FILTER (quality <> 0) AS many FROM labels) SELECT quality, n, merged FROM (SELECT 0 AS quality, CAST(greatest(few, many) AS BIGINT) AS n, CAST(greatest(many - few, 0) AS BIGINT) AS merged FROM c UNION ALL SELECT 1, CAST(many AS BIGINT), CAST(0 AS BIGINT) FROM c)")
def smp_oversample_merge(spark, sf_dir):
    lab = t(spark, sf_dir, "labels").select("doc_id", "quality", F.concat(F.lit("code "), F.col("doc_id").cast("string")).alias("code"))
    made = relational.oversample_merged(lab, "quality", "code", "doc_id")
    return made.groupBy("quality").agg(F.count("*").alias("n"), F.count_if(F.contains("code", F.lit("; "))).alias("merged"))


@query("part_split_n", "SELECT doc_id, source, ntile(7) OVER (ORDER BY doc_id) AS part FROM documents")
def part_split_n(spark, sf_dir):
    return relational.contiguous_parts(t(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 7)


@query("part_batches", "SELECT doc_id, source, (row_number() OVER (ORDER BY doc_id) - 1) // 150 AS batch FROM documents")
def part_batches(spark, sf_dir):
    return relational.batches(t(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 150)


# numbers ---------------------------------------------------------------------------------------------------------------------------


@query("math_pct", LV + "SELECT service, round(count(*) FILTER (predicted = 'NONE') * 100.0 / count(*), 6)::DOUBLE AS share FROM lv GROUP BY service")
def math_pct(spark, sf_dir):
    return levels(spark, sf_dir).groupBy("service").agg(F.round(arrays.percentage(F.count_if(F.col("predicted") == "NONE"), F.count("*")), 6).alias("share"))


@query("math_ceil_div", "SELECT doc_id, CAST((n_chars + 99) // 100 AS BIGINT) AS blocks FROM documents")
def math_ceil_div(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", arrays.ceil_div(F.col("n_chars"), 100).alias("blocks"))


@query("math_floor_div", "SELECT doc_id, CAST(n_chars // 4 AS BIGINT) AS q FROM documents")
def math_floor_div(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("n_chars") / 4).cast("long").alias("q"))


# composite analyses ----------------------------------------------------------------------------------------------------------------


@query("q_inconsistencies", LV + f"SELECT actual, CAST(count(*) AS BIGINT) AS \"Count\" FROM lv WHERE predicted NOT LIKE '%invalid%' AND {RANK.format(c='predicted')} > {RANK.format(c='actual')} GROUP BY actual")
def q_inconsistencies(spark, sf_dir):
    valid = levels(spark, sf_dir).where(~F.contains("predicted", F.lit("invalid")))
    return relational.value_counts(valid.where(relational.stricter(F.col("predicted"), F.col("actual"))), "actual")


@query("q_custom_apis", LV + BASE + "SELECT to_run, CAST(count(*) AS BIGINT) AS n FROM (SELECT actual <> 'SYS_OR_SIG' AND method NOT IN (SELECT method FROM b) AS to_run FROM lv) GROUP BY to_run")
def q_custom_apis(spark, sf_dir):
    return relational.to_run(levels(spark, sf_dir), _baseline(spark, sf_dir), "method", "actual").groupBy("to_run").agg(F.count("*").alias("n"))


@query("q_run_diff", LV + """, wrong AS (SELECT DISTINCT method, service FROM lv WHERE id % 2 = 0 AND predicted IS DISTINCT FROM actual), rightb AS (SELECT DISTINCT method, service FROM lv WHERE id % 2 = 1 AND predicted = actual)
SELECT method, service, (method, service) IN (SELECT (method, service) FROM rightb) AS was_right FROM wrong""")
def q_run_diff(spark, sf_dir):
    lv, keys = levels(spark, sf_dir), ["method", "service"]
    now = lv.where((F.col("id") % 2 == 0) & ~F.col("predicted").eqNullSafe(F.col("actual"))).select(*keys).distinct()
    before = lv.where((F.col("id") % 2 == 1) & (F.col("predicted") == F.col("actual"))).select(*keys).distinct()
    lost = relational.in_both(now, before, keys)
    return lost.withColumn("was_right", F.lit(True)).unionByName(relational.not_in(now, lost, keys).withColumn("was_right", F.lit(False)))


@query("q_model_diff", LV + "SELECT DISTINCT method FROM lv WHERE actual = 'DANGEROUS' AND predicted IS DISTINCT FROM actual AND id % 2 = 0 AND method NOT IN (SELECT method FROM lv WHERE actual = 'DANGEROUS' AND predicted IS DISTINCT FROM actual AND id % 2 = 1)")
def q_model_diff(spark, sf_dir):
    missed = levels(spark, sf_dir).where((F.col("actual") == "DANGEROUS") & ~F.col("predicted").eqNullSafe(F.col("actual")))
    return relational.not_in(missed.where("id % 2 = 0"), missed.where("id % 2 = 1"), ["method"]).select("method").distinct()


@query("q_relabel", LV + "SELECT service, actual, CAST(count(*) AS BIGINT) AS n FROM (SELECT service, CASE WHEN regexp_matches(service, 'svc1.') THEN 'SYS_OR_SIG' ELSE actual END AS actual FROM lv) GROUP BY 1, 2")
def q_relabel(spark, sf_dir):
    lv = levels(spark, sf_dir)
    changed = lv.withColumn("actual", F.when(relational.matches(F.col("service"), "svc1."), "SYS_OR_SIG").otherwise(F.col("actual")))
    return changed.groupBy("service", "actual").agg(F.count("*").alias("n"))


@query("q_false_strict", LV + "SELECT service, CAST(count(*) AS BIGINT) AS n FROM lv WHERE actual = 'NONE' AND predicted = 'SYS_OR_SIG' GROUP BY service")
def q_false_strict(spark, sf_dir):
    wrong = levels(spark, sf_dir).where((F.col("actual") == "NONE") & (F.col("predicted") == "SYS_OR_SIG"))
    return relational.value_counts(wrong, "service", "n")


@query("q_invalid_export", LV + "SELECT id, method, service FROM lv WHERE predicted = 'invalid'")
def q_invalid_export(spark, sf_dir):
    return levels(spark, sf_dir).where(F.col("predicted") == INVALID).select("id", "method", "service")


@query("q_method_search", LV + "SELECT id, method FROM lv WHERE method LIKE '%77%'")
def q_method_search(spark, sf_dir):
    return levels(spark, sf_dir).where(relational.matches(F.col("method"), "77")).select("id", "method")


@query("q_response_freq", 'SELECT event_type, props, CAST(count(*) AS BIGINT) AS "Count" FROM events WHERE props IS NOT NULL GROUP BY event_type, props')
def q_response_freq(spark, sf_dir):
    return t(spark, sf_dir, "events").where(F.col("props").isNotNull()).groupBy("event_type", "props").agg(F.count("*").alias("Count"))


@query("q_service_profile", LV + "SELECT service, actual, CAST(count(*) AS BIGINT) AS n, CAST(sum(count(*)) OVER (PARTITION BY service) AS BIGINT) AS rows FROM lv GROUP BY service, actual")
def q_service_profile(spark, sf_dir):
    per = levels(spark, sf_dir).groupBy("service", "actual").agg(F.count("*").alias("n"))
    return per.withColumn("rows", F.sum("n").over(Window.partitionBy("service")))


@query("q_patch_run", LV + "SELECT id, predicted FROM lv WHERE predicted IS NOT NULL UNION ALL SELECT id, actual FROM lv WHERE predicted IS NULL")
def q_patch_run(spark, sf_dir):
    lv = levels(spark, sf_dir)
    second = lv.where(F.col("predicted").isNull()).select("id", F.col("actual").alias("predicted"))
    return lv.na.drop(subset=["predicted"]).select("id", "predicted").unionByName(second)


@query("q_debug_accuracy", LV + "SELECT round(avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END) * 100, 6)::DOUBLE AS accuracy, CAST(count(*) AS BIGINT) AS rows FROM lv WHERE actual = 'NONE' AND predicted IS DISTINCT FROM 'invalid'")
def q_debug_accuracy(spark, sf_dir):
    return relational.accuracy(levels(spark, sf_dir).where("actual = 'NONE'"), "actual", "predicted").withColumn("accuracy", F.round("accuracy", 6))
