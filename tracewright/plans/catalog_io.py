"""Queries: sources and sinks, written to the shared folder and read back; prompts, resume and the whole pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions.models import CannedClient, LetterEmbedder, chat_logged
from tracewright.operators import paths, relational, similarity
from tracewright.plans import pipelines, prompts
from tracewright.plans.catalog_tables import ROC, roc_curve
from tracewright.plans.registry import LEVELS_SQL, PAIR_ORDER, PAIRS_SQL, PATHS, THRESHOLD, best_coded_pairs, coded, coded_pairs, first_coded_pairs, levels, path_rows, query, scratch, sinks, t
from tracewright.schemas import INVALID
from tracewright.shared import written
from tracewright.sources import files, outputs
from tracewright.streaming import resume

# execution-path files: a service per region, a class per nation --------------------------------------------------------------------

BROKEN = "MIDDLE EAST"


def _write_services(spark, sf_dir) -> str:
    """One CSV file per region, named after it; the file of BROKEN lacks a column. Regions are few by definition."""
    root = scratch(spark, "paths")
    n = t(spark, sf_dir, "nation").join(t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = lambda name, value: value.alias(name)
    rows = n.select(
        "r_name", c("Class", F.concat(F.lit('L"'), F.col("n_name"))), c("Method", F.concat(F.lower("n_name"), F.lit("(I)V"))), c("Depth", (F.col("n_nationkey") % 3).cast("string")),
        c("Trace Instruction(s) ...", F.concat(F.lit("a\nb "), "n_name")), c("Java Code Representation", F.concat(F.lit("old "), "n_name")), c("Code Merged", F.concat(F.lit('say "'), "n_name", F.lit('",\nend'))), c("Access Control Level", F.lit("NONE")),
    )
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    for r in sorted(x["r_name"] for x in t(spark, sf_dir, "region").select("r_name").collect()):
        part = rows.where(F.col("r_name") == r).drop("r_name", *(["Code Merged"] if r == BROKEN else [])).coalesce(1)
        part.write.options(header=True, quote='"', escape='"', quoteAll=True).csv(f"{root}/tmp/{r}")
        fs = fs_path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(fs_path(f"{root}/csv"))
        for status in fs.globStatus(fs_path(f"{root}/tmp/{r}/part-*.csv")):
            fs.rename(status.getPath(), fs_path(f"{root}/csv/{r}.csv"))
    return f"{root}/csv"


SERVICES = f"s AS (SELECT r_name AS service_name, 'L\"' || n_name AS class, lower(n_name) || '(I)V' AS method, CAST(n_nationkey % 3 AS INTEGER) AS depth, 'a' || chr(10) || 'b ' || n_name AS trace, 'say \"' || n_name || '\",' || chr(10) || 'end' AS java_code, 'old ' || n_name AS old FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query("scan_csv_dir", f"WITH {SERVICES} SELECT service_name, method, depth, trace, java_code FROM s WHERE service_name <> '{BROKEN}'")
def scan_csv_dir(spark, sf_dir):
    return files.csv_dir(spark, _write_services(spark, sf_dir)).select("service_name", "method", "depth", "trace", "java_code")


@query("scan_csv_clean", f"WITH {SERVICES} SELECT class, depth FROM s WHERE service_name <> '{BROKEN}'")
def scan_csv_clean(spark, sf_dir):
    return files.csv_dir(spark, _write_services(spark, sf_dir)).select("class", "depth")


@query("scan_csv_missing_col", f"WITH {SERVICES} SELECT service_name, CAST(count(*) AS BIGINT) AS rows FROM s WHERE service_name <> '{BROKEN}' GROUP BY 1")
def scan_csv_missing_col(spark, sf_dir):
    return files.csv_dir(spark, _write_services(spark, sf_dir)).groupBy("service_name").agg(F.count("*").alias("rows"))


@query("scan_csv_altcol", f"WITH {SERVICES} SELECT service_name, old AS java_code FROM s")
def scan_csv_altcol(spark, sf_dir):
    return files.csv_dir(spark, _write_services(spark, sf_dir), "Java Code Representation").select("service_name", "java_code")


# other sources ---------------------------------------------------------------------------------------------------------------------


@query("scan_parquet", "SELECT l_orderkey, l_quantity FROM lineitem")
def scan_parquet(spark, sf_dir):
    return files.stage_table(spark, f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_quantity")


@query("scan_baseline_csv", "SELECT c_name AS method, 'android.' || c_name AS \"Entrypoint\" FROM customer")
def scan_baseline_csv(spark, sf_dir):
    path = scratch(spark, "baseline")
    t(spark, sf_dir, "customer").select(F.concat(F.lit("android."), "c_name").alias("Entrypoint")).write.option("header", True).csv(path)
    return files.baseline_csv(spark, path)


SECTIONED = "e AS (SELECT event_id, user_id, '[[AC]: check(' || (event_id % 4) || '), [x]: a.f' || event_id || '()]' AS code FROM events)"


def _write_sections(spark, sf_dir) -> str:
    """Sectioned text: a key line per user, then a line per event. Users are dealt to files; each file is in order."""
    path = scratch(spark, "sections")
    i = F.col("event_id").cast("string")
    e = t(spark, sf_dir, "events")
    line = F.concat(F.lit("ControlFlow: [[AC]: check("), (F.col("event_id") % 4).cast("string"), F.lit("), [x]: a.f"), i, F.lit("()]"))
    lines = e.select("user_id", "event_id", line.alias("value"))
    heads = e.select("user_id").distinct().select("user_id", F.lit(-1).cast("long").alias("event_id"), F.concat(F.lit("EP: m"), F.col("user_id").cast("string"), F.lit("_Svc_1")).alias("value"))
    both = lines.unionByName(heads).repartition(8, "user_id").sortWithinPartitions("user_id", "event_id")
    both.select("value").write.text(path)
    return path


@query("scan_sectioned_text", f"WITH {SECTIONED} SELECT 'm' || user_id || '_Svc_1' AS \"EP\", code FROM e")
def scan_sectioned_text(spark, sf_dir):
    return files.sectioned_text(spark, _write_sections(spark, sf_dir)).select("EP", "code")


@query("q_text_pipeline", f"""WITH {SECTIONED}, l AS (SELECT 'm' || user_id || '_Svc_1' AS EP, event_id, '[x]: a.f' || event_id || '()' AS code, CASE WHEN event_id % 4 >= 2 THEN 1 ELSE 0 END AS label FROM e)
SELECT EP AS "EP", CAST(max(label) AS INTEGER) AS label FROM l GROUP BY EP""")
def q_text_pipeline(spark, sf_dir):
    return pipelines.text_stage(spark, _write_sections(spark, sf_dir)).select("EP", "label")


@query("scan_text_tree", "SELECT doc_id, CAST(length('doc ' || doc_id || ' of ' || coalesce(source, 'none')) AS BIGINT) AS n FROM documents")
def scan_text_tree(spark, sf_dir):
    """All documents as lines of the files of a tree, a folder per source and share of the ids; each file is read as one text."""
    root = scratch(spark, "tree")
    said = F.concat(F.lit("doc "), F.col("doc_id").cast("string"), F.lit(" of "), F.coalesce("source", F.lit("none")))
    d = t(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("source"), (F.col("doc_id") % 4).alias("share"), said.alias("value"))
    d.repartition("source", "share").write.partitionBy("source", "share").text(root)
    tree = files.text_tree(spark, root, "part-*")
    lines = tree.select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    return lines.select(F.regexp_extract("line", r"^doc (\d+) of ", 1).cast("long").alias("doc_id"), F.char_length("line").cast("long").alias("n"))


@query("scan_jsonl", "SELECT 'doc ' || doc_id AS code, CAST(quality AS INTEGER) AS label FROM labels")
def scan_jsonl(spark, sf_dir):
    path = scratch(spark, "examples")
    t(spark, sf_dir, "labels").select(F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("code"), F.col("quality").alias("label")).write.json(path)
    return files.examples_jsonl(spark, path)


@query("scan_pickle", f"WITH {PATHS} SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM paths GROUP BY user_id")
def scan_pickle(spark, sf_dir):
    path = scratch(spark, "nested")
    outputs.write_stage(paths.collect_paths(path_rows(spark, sf_dir), ("user_id",)), path)
    return files.stage_table(spark, path).select("user_id", F.size("depths").cast("long").alias("n"))


@query("scan_list_file", "SELECT c_name AS id FROM customer")
def scan_list_file(spark, sf_dir):
    path = scratch(spark, "list")
    outputs.write_list(t(spark, sf_dir, "customer").select(F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("c")), "c", path)
    return files.list_file(spark, path)


@query("scan_prompt_file", "SELECT CAST(count(*) AS BIGINT) AS n, 'You are a reviewer.' || chr(10) || 'Answer in JSON.' AS prompt FROM region")
def scan_prompt_file(spark, sf_dir):
    path = scratch(spark, "prompt")
    outputs.write_text(spark, "\n You are a reviewer.\nAnswer in JSON.\n\n", path)
    prompt = files.prompt_file(spark, path)
    return t(spark, sf_dir, "region").agg(F.count("*").alias("n"), F.max(F.lit(prompt)).alias("prompt"))


# sinks -----------------------------------------------------------------------------------------------------------------------------


@query("sink_parquet", "SELECT vec_id, label FROM embeddings")
def sink_parquet(spark, sf_dir):
    path = scratch(spark, "stage")
    outputs.write_stage(t(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "embeddings"), path)
    return files.stage_table(spark, path)


@query("sink_row_artifacts", """WITH x AS (SELECT 'svc' || (p_size % 5) AS s, split_part('m' || p_size || '(I)', '(', 1) AS m, p_partkey AS seq, p_name, p_type FROM part), l AS (SELECT s, m, arg_max(p_name, seq) AS u, arg_max(p_type, seq) AS r FROM x GROUP BY 1, 2)
SELECT s || '/' || m || '/user_message.txt' AS path, u AS text FROM l UNION ALL SELECT s || '/' || m || '/response.txt', r FROM l""")
def sink_row_artifacts(spark, sf_dir):
    p, path = t(spark, sf_dir, "part"), scratch(spark, "artifacts")
    size = F.col("p_size").cast("string")
    rows = p.select(F.concat(F.lit("svc"), (F.col("p_size") % 5).cast("string")).alias("service_name"), F.concat(F.lit("m"), size, F.lit("(I)")).alias("method"), F.col("p_partkey").alias("seq"), "p_name", "p_type")
    outputs.write_artifacts(outputs.row_artifacts(rows, {"user_message.txt": "p_name", "response.txt": "p_type"}), path)
    return files.text_tree(spark, path, "*.txt").select(F.regexp_extract(files.plain_path(F.col("path")), "([^/]+/[^/]+/[^/]+)$", 1).alias("path"), "text")


EPS = "eps AS (SELECT DISTINCT method FROM sk UNION SELECT 'api-none')"


def _eps(spark, sf_dir):
    return sinks(spark, sf_dir).select("method").distinct().union(spark.range(1).select(F.lit("api-none")))


def _through_csv(spark, df, name):
    path = scratch(spark, name)
    outputs.write_csv(df, path)
    return _csv(spark, path, df.schema)


def _csv(spark, path, schema):
    return spark.read.options(header=True, quote='"', escape='"').schema(schema).csv(path)


REPORT = "EP1_ID string, EP2_ID string, EP1_Code string, EP2_Code string"


@query("sink_csv_allpairs", f"WITH {PAIRS_SQL}, {EPS} SELECT method AS \"EP1_ID\", coalesce(ep2_id, 'No similar EPs with similarity > 0.8') AS \"EP2_ID\", coalesce(ep1_code, '') AS \"EP1_Code\", coalesce(ep2_code, '') AS \"EP2_Code\", round(similarity, 6) AS \"Similarity\" FROM eps LEFT JOIN pr ON pr.ep1 = eps.method")
def sink_csv_allpairs(spark, sf_dir):
    path = scratch(spark, "allcode")
    outputs.write_all_pairs_report(_eps(spark, sf_dir), coded_pairs(spark, sf_dir), path)
    return _csv(spark, path, f"{REPORT}, Similarity double").fillna("", ["EP1_Code", "EP2_Code"]).withColumn("Similarity", F.round("Similarity", 6))


@query("sink_csv_score", f"WITH {PAIRS_SQL}, {EPS}, b AS (SELECT ep1, ep2_id, max(similarity) AS m FROM pr GROUP BY 1, 2) SELECT method AS \"EP\", coalesce(ep2_id, 'No similar EPs') AS \"EP2_ID\", coalesce(printf('%.4f', m), '') AS \"Max_Similarity\", row_number() OVER (PARTITION BY method ORDER BY m DESC NULLS LAST, ep2_id) AS place FROM eps LEFT JOIN b ON b.ep1 = eps.method")
def sink_csv_score(spark, sf_dir):
    return _through_csv(spark, outputs.score_report(_eps(spark, sf_dir), coded_pairs(spark, sf_dir)), "score").fillna("", ["Max_Similarity"])


@query("sink_csv_topn", f"WITH {PAIRS_SQL}, {EPS}, r AS (SELECT *, row_number() OVER (PARTITION BY ep1 {PAIR_ORDER}) AS place FROM pr) SELECT method AS \"EP1_ID\", coalesce(ep2_id, 'No similar EPs with similarity > 0.5') AS \"EP2_ID\", coalesce(ep2_code, '') AS \"EP2_Code\", place FROM eps LEFT JOIN r ON r.ep1 = eps.method")
def sink_csv_topn(spark, sf_dir):
    path = scratch(spark, "topncode")
    outputs.write_top_report(_eps(spark, sf_dir), similarity.cosine_pairs(sinks(spark, sf_dir), THRESHOLD), path, coded)
    return _csv(spark, path, f"{REPORT}, Similarity double, place long").fillna("", ["EP2_Code"]).select("EP1_ID", "EP2_ID", "EP2_Code", "place")


@query("sink_csv_top2", f"WITH {PAIRS_SQL}, {EPS}, r AS (SELECT *, row_number() OVER (PARTITION BY ep1 {PAIR_ORDER}) AS place FROM pr) SELECT method AS \"EP1_ID\", coalesce(ep2_id, 'No similar EPs with similarity > 0.5') AS \"EP2_ID\", place FROM eps LEFT JOIN (SELECT * FROM r WHERE place <= 2) r ON r.ep1 = eps.method")
def sink_csv_top2(spark, sf_dir):
    return _through_csv(spark, outputs.top_report(_eps(spark, sf_dir), first_coded_pairs(spark, sf_dir, 2), 2), "top2code").select("EP1_ID", "EP2_ID", "place")


@query("sink_csv_sinks", "SELECT p_name AS \"EP\", unnest(string_split(p_type, ' ')) AS \"Sink\" FROM part")
def sink_csv_sinks(spark, sf_dir):
    api = t(spark, sf_dir, "part").select(F.col("p_name").alias("method"), F.split("p_type", " ").alias("sink_code"))
    return _through_csv(spark, outputs.sinks_report(api), "sinks")


@query("sink_jsonl", "SELECT 'EP = ' || source || ' code = doc ' || doc_id AS code, CAST(doc_id % 2 AS INTEGER) AS label FROM documents")
def sink_jsonl(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select(F.col("source").alias("EP"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("code"), (F.col("doc_id") % 2).alias("label"))
    path = scratch(spark, "jsonl")
    outputs.write_examples(outputs.example_lines(d), path)
    return files.examples_jsonl(spark, path)


@query("sink_csv_projection", f"WITH {LEVELS_SQL} SELECT id, method, predicted FROM lv WHERE predicted <> 'invalid'")
def sink_csv_projection(spark, sf_dir):
    lv = levels(spark, sf_dir).where("predicted <> 'invalid'").drop("service", "actual", "price")
    return _through_csv(spark, lv, "projection")


@query("sink_stats_text", f"WITH {LEVELS_SQL}, v AS (SELECT * FROM lv WHERE predicted IS DISTINCT FROM 'invalid') SELECT CAST(2 + count(DISTINCT actual || predicted) AS BIGINT) AS lines, printf('%.2f', avg(CASE WHEN actual = predicted THEN 100.0 ELSE 0.0 END)) AS accuracy FROM v")
def sink_stats_text(spark, sf_dir):
    lv = levels(spark, sf_dir)
    valid = lv.where(relational.not_equal_or_null(F.col("predicted"), INVALID))
    a = relational.accuracy(lv, "actual", "predicted").first()
    said, path = outputs.stats_text(a["accuracy"], a["rows"], relational.confusion(valid, "actual", "predicted"), {"Similarity Threshold": "0.8"}), scratch(spark, "stats")
    outputs.write_text(spark, said.rstrip("\n"), path)
    lines = spark.read.text(path)
    return lines.agg(F.count("*").alias("lines"), F.max(F.nullif(F.regexp_extract("value", r"Accuracy: ([0-9.]+)%", 1), F.lit(""))).alias("accuracy"))


@query("sink_list_file", "SELECT DISTINCT source AS id FROM documents")
def sink_list_file(spark, sf_dir):
    path = scratch(spark, "ids")
    outputs.write_list(t(spark, sf_dir, "documents").select("source").distinct(), "source", path)
    return files.list_file(spark, path)


@query("sink_unique_names", "SELECT split_part(ep, '_', 1) AS name FROM (SELECT DISTINCT 'api' || p_size || '_' || p_brand AS ep FROM part)")
def sink_unique_names(spark, sf_dir):
    eps = t(spark, sf_dir, "part").select(F.concat(F.lit("api"), F.col("p_size").cast("string"), F.lit("_"), "p_brand").alias("EP"))
    return _through_csv(spark, outputs.unique_names(eps), "names")


@query("sink_plot", f"WITH {LEVELS_SQL}, c AS (SELECT actual, count(*) AS n FROM lv GROUP BY actual) SELECT CAST(count(*) AS BIGINT) AS bars, CAST(max(n) AS BIGINT) AS top FROM c")
def sink_plot(spark, sf_dir):
    counts = relational.value_counts(levels(spark, sf_dir), "actual").orderBy("actual").collect()  # one row per level
    path = scratch(spark, "plot")
    outputs.write_text(spark, outputs.bar_chart([(r["actual"], r["Count"]) for r in counts], f"largest {max(r['Count'] for r in counts)}"), path)
    svg = spark.read.text(path)
    return svg.select(F.regexp_count("value", F.lit("<rect ")).cast("long").alias("bars"), F.regexp_extract("value", r">largest (\d+)<", 1).cast("long").alias("top"))


@query("sink_plot_roc", f"""WITH {ROC}, s AS (SELECT round(sum(neg / n * ((2 * tp - pos) / (2 * p))), 4) AS auc FROM r), d AS (SELECT DISTINCT floor(fp / n * 400) AS px, floor(tp / p * 300) AS py FROM r)
SELECT (SELECT CAST(count(*) AS BIGINT) FROM d) AS places, auc FROM s""")
def sink_plot_roc(spark, sf_dir):
    points = written(roc_curve(spark, sf_dir), "roc")
    auc = points.agg(F.round(F.sum("area"), 4).alias("auc")).first()["auc"]
    places = [(r["px"], r["py"]) for r in relational.on_grid(points, "fpr", "tpr", 400, 300).orderBy("px", "py").collect()]  # at most 701
    path = scratch(spark, "roc")
    outputs.write_text(spark, outputs.curve_chart(places, f"ROC curve, area {auc}"), path)
    svg = spark.read.text(path)
    drawn = F.regexp_extract("value", r'<polyline points="([^"]*)"', 1)
    return svg.select(F.size(F.split(drawn, " ")).cast("long").alias("places"), F.regexp_extract("value", r"area ([0-9.]+)<", 1).cast("double").alias("auc"))


# prompts ---------------------------------------------------------------------------------------------------------------------------

D4 = f"""WITH {PAIRS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY ep1 {PAIR_ORDER}) AS r FROM pr), c AS (SELECT *, row_number() OVER (PARTITION BY ep1, ep2_code ORDER BY r) AS c FROM r),
f AS (SELECT *, CAST(row_number() OVER (PARTITION BY ep1, ep2_id ORDER BY r) = 1 AS INTEGER) AS f FROM c WHERE c = 1), n AS (SELECT *, sum(f) OVER (PARTITION BY ep1 ORDER BY r) AS n FROM f),
d AS (SELECT *, row_number() OVER (PARTITION BY ep1 ORDER BY r) AS place FROM n WHERE n <= 4),
e AS (SELECT ep1, ep2_id, min(place) AS first, string_agg('  • Source sink (position ' || ep1_sink_idx || '): ' || ep1_code || ' | ' || ep2_code, ';' ORDER BY place) AS body FROM d GROUP BY 1, 2)"""


def _prompts(spark, sf_dir, custom=None):
    chosen = similarity.diversified(best_coded_pairs(spark, sf_dir), 4)
    meta = sinks(spark, sf_dir).groupBy("method").agg(F.min("sink_idx").alias("seq")).select("method", F.concat(F.lit("Svc"), "method").alias("service_name"), F.lit("NORMAL").alias("access control level"), "seq")
    return prompts.neighbours_text(chosen, meta, custom)


def _flattened(c):
    """The prompt's lines without the similarity, whose last decimal may round differently, in one line a neighbour."""
    plain = F.regexp_replace(c, r"  • Similarity: [^\n]*\n", "")
    plain = F.regexp_replace(plain, r"\):\n([^\n]*)\n  • Target sink \(position \d+\):\n([^\n]*)\n\n", "): $1 | $2;")
    return F.regexp_replace(F.regexp_replace(plain, r"\)\n  •", ")  •"), ";(?=- |$)", "|")


@query("str_prompt2", D4 + " SELECT ep1, string_agg('- ' || ep2_id || ' (Class: Svc' || ep2_id || ', Access: NORMAL)' || body, '|' ORDER BY first) || '|' AS text FROM e GROUP BY ep1")
def str_prompt2(spark, sf_dir):
    return _prompts(spark, sf_dir).select("ep1", _flattened(F.col("text")).alias("text"))


@query("str_prompt2_custom", D4 + " SELECT ep1, string_agg('- ' || ep2_id || CASE WHEN ep2_id = 'api1' THEN ' (custom API)' ELSE ' (AOSP API)' END || ' (Class: Svc' || ep2_id || ', Access: NORMAL)' || body, '|' ORDER BY first) || '|' AS text FROM e GROUP BY ep1")
def str_prompt2_custom(spark, sf_dir):
    custom = spark.range(1).select(F.lit("api1").alias("method"))
    return _prompts(spark, sf_dir, custom).select("ep1", _flattened(F.col("text")).alias("text"))


@query("str_prompt2_v1", D4 + " SELECT ep1, CAST(count(*) AS BIGINT) AS neighbours, string_agg(ep2_id || '/' || ep2_code, ',' ORDER BY place) AS said FROM d GROUP BY ep1")
def str_prompt2_v1(spark, sf_dir):
    flat = prompts.flat_prompt(similarity.diversified(best_coded_pairs(spark, sf_dir), 4))
    parts = F.split("text", "\n\n")
    said = F.transform(parts, lambda x: F.concat(F.regexp_extract(x, r"Similar API: ([^\n]*)", 1), F.lit("/"), F.regexp_extract(x, r"\n([^\n]*)$", 1)))
    return flat.select("ep1", F.size(parts).cast("long").alias("neighbours"), F.array_join(said, ",").alias("said"))


# resume and whole pipelines --------------------------------------------------------------------------------------------------------


class _Done:
    def chat(self, system, user, timeout=None):
        return f"done {user}"


@query("q_resume", "SELECT doc_id, 'done ' || source AS answer FROM documents")
def q_resume(spark, sf_dir):
    root = scratch(spark, "resume")
    d = t(spark, sf_dir, "documents").select("doc_id", "source")
    d.repartition(4, "doc_id").write.parquet(f"{root}/in")
    ask = lambda b: chat_logged(b, ["doc_id"], _Done, "system", "source", "answer", f"{root}/log")
    for _ in range(2):  # the second run finds nothing to do
        resume.run_available(spark, f"{root}/in", d.schema, ask, f"{root}/out", f"{root}/state", 2)
    return spark.read.parquet(f"{root}/out").select("doc_id", "answer")


@query("q_pending", f"WITH {LEVELS_SQL} SELECT id FROM lv WHERE predicted IS NULL AND id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 7)")
def q_pending(spark, sf_dir):
    done = t(spark, sf_dir, "lineitem").where("l_linenumber = 7").select(F.col("l_orderkey").alias("id"), F.lit("x").alias("predicted"))
    return resume.pending(levels(spark, sf_dir), done, ["id"], "predicted").select("id")


@query("q_sinks_stage", f"WITH {SERVICES} SELECT service_name, method, 'This is path 1 for the API with depth ' || depth || ':' || chr(10) || java_code AS prompt1 FROM s WHERE service_name <> '{BROKEN}'")
def q_sinks_stage(spark, sf_dir):
    stage = pipelines.sinks_stage(spark, _write_services(spark, sf_dir), CannedClient, "system", scratch(spark, "stage1"), all_paths=False)
    return stage.select("service_name", "method", "prompt1")


def _levels_stage(spark, sf_dir):
    e = t(spark, sf_dir, "part")
    code = F.concat(F.lit("void m() {\n    "), F.replace(F.col("p_type"), F.lit(" "), F.lit(".")), F.lit("();\n}"))
    rows = e.select(F.col("p_brand").alias("service_name"), F.lit("C").alias("class"), F.concat(F.lit("m"), F.col("p_partkey").cast("string"), F.lit("()")).alias("method"), F.lit("NORMAL").alias("access control level"), F.lit(0).alias("depth"), F.col("p_partkey").alias("seq"), F.lit("t").alias("trace"), code.alias("java_code"), F.concat(F.lit('{"Sinks": [["'), "p_type", F.lit('"]]}')).alias("json_answer"))
    api = paths.collect_paths(rows.drop("json_answer")).join(rows.select("method", "json_answer"), "method")
    return pipelines.levels_stage(spark, api, LetterEmbedder, lambda: CannedClient("level"), "system", scratch(spark, "stage2"), threshold=0.95, keep_pairs=False)


_LETTERS = ", ".join(f"length(w) - length(replace(w, '{c}', ''))" for c in "abcdefghijklmnopqrstuvwxyz")


@query("q_levels_stage", f"""WITH p AS (SELECT p_type, p_brand || '#C#m' || p_partkey || '()#NORMAL' AS ep FROM part),
w AS (SELECT DISTINCT p_type, lower('void m() ' || p_type) AS w FROM p), v AS (SELECT p_type, [{_LETTERS}]::DOUBLE[] AS v FROM w),
s AS (SELECT a.p_type AS one, b.p_type AS two, round(list_cosine_similarity(a.v, b.v), 12) AS s FROM v a, v b), t AS (SELECT * FROM s WHERE s > 0.95),
c AS (SELECT a.ep AS ep1, t.two, t.s, min(b.ep) AS ep2 FROM p a JOIN t ON a.p_type = t.one JOIN p b ON b.p_type = t.two AND b.ep <> a.ep GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY ep1 ORDER BY s DESC, ep2) AS place FROM c),
n AS (SELECT ep1, string_agg(ep2 || ' ' || printf('%.6f', s), ',' ORDER BY place) AS neighbours FROM r WHERE place <= 4 GROUP BY ep1)
SELECT p.ep, coalesce(n.neighbours, '') AS neighbours, true AS known FROM p LEFT JOIN n ON p.ep = n.ep1""")
def q_levels_stage(spark, sf_dir):
    """Every part's entry point with the neighbours that its prompt names, each a similarity, and whether its answer is a level."""
    out = _levels_stage(spark, sf_dir)
    said = F.concat("ep2_id", F.lit(" "), F.format_string("%.6f", "similarity"))
    chosen = out["chosen"].groupBy("ep1").agg(F.array_sort(F.collect_list(F.struct("place", said.alias("said")))).alias("c"))
    ep = F.concat_ws("#", "service_name", "class", "method", "access control level")
    known = F.col("access control level predicted").isin("NONE", "NORMAL", "DANGEROUS", "SYS_OR_SIG", "invalid")
    result = out["result"].select(ep.alias("ep"), known.alias("known")).join(chosen, F.col("ep") == F.col("ep1"), "left")
    return result.select("ep", F.coalesce(F.array_join(F.transform("c", lambda x: x["said"]), ","), F.lit("")).alias("neighbours"), "known")
