"""Queries: strings, JSON in answers, arrays and model surfaces."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from tracewright.functions import answers, arrays, bytepair, models, text
from tracewright.plans.registry import query, scratch, t
from tracewright.shared import write_counted
from tracewright.streaming.batches import BatchJob, CannedBatchService

# strings ---------------------------------------------------------------------------------------------------------------------------

NAMES = "n AS (SELECT p_partkey, 'com.example.' || replace(p_type, ' ', '.') || '(I' || p_size || ')V' AS method, 'api' || p_size || '_Service' || p_brand || '_' || p_partkey AS ep FROM part)"


def _names(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    method = F.concat(F.lit("com.example."), F.replace(F.col("p_type"), F.lit(" "), F.lit(".")), F.lit("(I"), F.col("p_size").cast("string"), F.lit(")V"))
    ep = F.concat(F.lit("api"), F.col("p_size").cast("string"), F.lit("_Service"), F.col("p_brand"), F.lit("_"), F.col("p_partkey").cast("string"))
    return p.select("p_partkey", method.alias("method"), ep.alias("ep"))


@query("str_method_name", f"WITH {NAMES} SELECT p_partkey, split_part(method, '(', 1) AS name FROM n")
def str_method_name(spark, sf_dir):
    return _names(spark, sf_dir).select("p_partkey", text.method_name(F.col("method")).alias("name"))


@query("str_last_segment", f"WITH {NAMES} SELECT p_partkey, regexp_replace(method, '^.*[.]', '') AS name FROM n")
def str_last_segment(spark, sf_dir):
    return _names(spark, sf_dir).select("p_partkey", text.last_segment(F.col("method")).alias("name"))


@query("str_split_method", f"WITH {NAMES} SELECT p_partkey, split_part(regexp_replace(method, '^.*[.]', ''), '(', 1) AS name FROM n")
def str_split_method(spark, sf_dir):
    return _names(spark, sf_dir).select("p_partkey", text.short_method(F.col("method")).alias("name"))


@query("str_service_from_ep", f"WITH {NAMES} SELECT p_partkey, split_part(ep, '_', 2) AS service FROM n")
def str_service_from_ep(spark, sf_dir):
    return _names(spark, sf_dir).select("p_partkey", text.service_of(F.col("ep")).alias("service"))


@query("str_split_once", f"WITH {NAMES} SELECT p_partkey, split_part(ep, '_', 1) AS head, substr(ep, instr(ep, '_') + 1) AS tail FROM n")
def str_split_once(spark, sf_dir):
    head, tail = text.split_once(F.col("ep"))
    return _names(spark, sf_dir).select("p_partkey", head.alias("head"), tail.alias("tail"))


ITEMS = "i AS (SELECT event_id, '[[x]: a' || event_id || '.b(), ' || CASE event_id % 3 WHEN 0 THEN '' ELSE '[AC]: check(' || (event_id % 4) || '), ' END || CASE event_id % 5 WHEN 0 THEN '[AC]: check(1), ' ELSE '' END || '[y]: c.d()]' AS code FROM events)"


def _items(spark, sf_dir):
    i = F.col("event_id")
    one = F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("[AC]: check("), (i % 4).cast("string"), F.lit("), ")))
    two = F.when(i % 5 == 0, "[AC]: check(1), ").otherwise("")
    return t(spark, sf_dir, "events").select("event_id", F.concat(F.lit("[[x]: a"), i.cast("string"), F.lit(".b(), "), one, two, F.lit("[y]: c.d()]")).alias("code"))


@query("str_strip_ac", f"WITH {ITEMS} SELECT event_id, array_to_string(list_filter(string_split(substr(code, 2, length(code) - 2), ', '), lambda x: NOT contains(x, '[AC]')), '<|>') AS code FROM i")
def str_strip_ac(spark, sf_dir):
    return _items(spark, sf_dir).select("event_id", text.without_checks(F.col("code")).alias("code"))


@query("str_extract_ac", "SELECT event_id, greatest(CASE event_id % 3 WHEN 0 THEN -1 ELSE CAST(event_id % 4 AS INTEGER) END, CASE event_id % 5 WHEN 0 THEN 1 ELSE -1 END) AS level FROM events")
def str_extract_ac(spark, sf_dir):
    return _items(spark, sf_dir).select("event_id", text.check_level(F.col("code")).alias("level"))


@query("str_parse_kv", "SELECT event_id, event_type AS kind, CAST(user_id AS VARCHAR) AS who FROM events")
def str_parse_kv(spark, sf_dir):
    kv = F.concat(F.lit("{kind="), "event_type", F.lit(", who = "), F.col("user_id").cast("string"), F.lit("}"))
    m = t(spark, sf_dir, "events").select("event_id", text.key_values(kv).alias("m"))
    return m.select("event_id", F.col("m")["kind"].alias("kind"), F.col("m")["who"].alias("who"))


@query("str_gen_java", f"WITH {ITEMS} SELECT event_id, '// API: m' || event_id || chr(10) || '// Service: S' || chr(10) || chr(10) || 'public void m' || event_id || '() {{' || chr(10) || '    a' || event_id || '.b();' || chr(10) || '    c.d();' || chr(10) || '}}' AS java FROM i")
def str_gen_java(spark, sf_dir):
    m = F.concat(F.lit("m"), F.col("event_id").cast("string"))
    return _items(spark, sf_dir).select("event_id", text.pseudo_java(m, F.lit("S"), text.without_checks(F.col("code"))).alias("java"))


@query("str_wrap_snippet", "SELECT p_partkey, chr(10) || '            ' || p_name || chr(10) || '            ' || p_type || chr(10) || '            }' || chr(10) || '            ' AS code FROM part")
def str_wrap_snippet(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", text.snippet(F.col("p_name"), F.col("p_type")).alias("code"))


@query("str_nl_to_space", "SELECT doc_id, md5(replace(text, chr(10), ' ')) AS digest FROM documents")
def str_nl_to_space(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.md5(text.one_line(F.col("text")).cast("binary")).alias("digest"))


@query("str_fmt_float", "SELECT o_orderkey, printf('%.4f', CAST(o_orderkey % 1000 AS DOUBLE) / 8) AS four, printf('%.2f', CAST(o_orderkey % 1000 AS DOUBLE) / 4) AS two FROM orders")
def str_fmt_float(spark, sf_dir):
    k = (F.col("o_orderkey") % 1000).cast("double")
    return t(spark, sf_dir, "orders").select("o_orderkey", F.format_string("%.4f", k / 8).alias("four"), F.format_string("%.2f", k / 4).alias("two"))


@query("str_camel_split", "SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(p_name || p_brand, '([A-Za-z][a-z]+)', 1), lambda x: lower(x)), ' ') AS words FROM part")
def str_camel_split(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", F.array_join(text.camel_words(F.concat("p_name", "p_brand")), " ").alias("words"))


@query("str_len", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents")
def str_len(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.char_length("text").cast("long").alias("n"))


@query("str_path_ext", f"WITH {NAMES} SELECT p_partkey, method AS stem FROM n")
def str_path_ext(spark, sf_dir):
    return _names(spark, sf_dir).select("p_partkey", text.without_extension(F.concat("method", F.lit(".csv"))).alias("stem"))


@query("str_token_count", "SELECT p_partkey, CAST(len(regexp_extract_all(p_name || ', ' || p_type || '.', '\\p{L}+|\\p{N}+|[^\\s\\p{L}\\p{N}]')) AS BIGINT) AS tokens FROM part")
def str_token_count(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", text.token_count(F.concat("p_name", F.lit(", "), "p_type", F.lit("."))).cast("long").alias("tokens"))


@query("str_token_count_merges")
def str_token_count_merges(spark, sf_dir):
    """Tokens of every whole text by a public byte-level vocabulary; SQL has no merges, so tests hold it to that vocabulary's own encoder."""
    import public_tokenizers

    return t(spark, sf_dir, "documents").select("doc_id", bytepair.token_count(F.col("text"), public_tokenizers.path("byte_bpe_50k.tiktoken")).alias("tokens"))


@query("str_pad_ids", "SELECT p_partkey, array_to_string([0] || list_transform(range(1, least(p_size, 6) + 1), lambda x: x::INTEGER) || [2] || list_transform(range(least(p_size, 6), 6), lambda x: 1), ',') AS ids FROM part")
def str_pad_ids(spark, sf_dir):
    ids = F.sequence(F.lit(1), F.col("p_size"))
    return t(spark, sf_dir, "part").select("p_partkey", F.array_join(text.padded_ids(ids, 8).cast("array<string>"), ",").alias("ids"))


# JSON in answers -------------------------------------------------------------------------------------------------------------------

FORMS = 8


def _answers(spark, sf_dir):
    """Answers in eight forms around the events' JSON: fenced, plain fence, bare, boxed, in prose, two blocks, none, comment."""
    k = F.col("event_id") % FORMS
    p, fence = F.col("props"), "```"
    form = (
        F.when(k == 0, F.concat(F.lit(f"Sure.\n{fence}json\n"), p, F.lit(f"\n{fence}\nDone")))
        .when(k == 1, F.concat(F.lit(f"{fence}\n"), p, F.lit(f"\n{fence}")))
        .when(k == 2, F.concat(F.lit("  "), p, F.lit("\n")))
        .when(k == 3, F.concat(F.lit("So $\\boxed{ "), p, F.lit(" }$")))
        .when(k == 4, F.concat(F.lit("The answer is "), p, F.lit(" I think")))
        .when(k == 5, F.concat(F.lit(f'{fence}json\n{{"k": -1}}\n{fence}\nthen\n{fence}json\n'), p, F.lit(f"\n{fence}")))
        .when(k == 6, F.lit("no answer"))
        .otherwise(F.concat(F.lit(f"{fence}json\n"), p, F.lit(f" // note\n{fence}")))
    )
    return t(spark, sf_dir, "events").select("event_id", "props", form.alias("res"))


EXPECT = f"SELECT event_id, CASE WHEN event_id % {FORMS} <> 6 THEN CAST(props::JSON->>'k' AS BIGINT) END AS k FROM events"


def _k(c):
    return F.get_json_object(c, "$.k").cast("long").alias("k")


@query("json_extract_post", EXPECT)
def json_extract_post(spark, sf_dir):
    return _answers(spark, sf_dir).select("event_id", _k(answers.extract_json(F.col("res"), "post")))


@query("json_extract_pre", EXPECT)
def json_extract_pre(spark, sf_dir):
    return _answers(spark, sf_dir).select("event_id", _k(answers.extract_json(F.col("res"), "pre")))


@query("json_extract_relaxed", EXPECT)
def json_extract_relaxed(spark, sf_dir):
    return _answers(spark, sf_dir).select("event_id", _k(answers.extract_json(F.replace("res", F.lit("json\n"), F.lit("json ")), "relaxed")))


@query("json_extract_v1", f"SELECT event_id, CASE event_id % {FORMS} WHEN 0 THEN CAST(props::JSON->>'k' AS BIGINT) WHEN 1 THEN CAST(props::JSON->>'k' AS BIGINT) WHEN 5 THEN -1 END AS k FROM events")
def json_extract_v1(spark, sf_dir):
    return _answers(spark, sf_dir).select("event_id", _k(answers.extract_json(F.col("res"), "first")))


@query("json_strip_comments", "SELECT event_id, props || ' ' AS clean FROM events")
def json_strip_comments(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", answers.without_comments(F.concat("props", F.lit(" // said "), "event_type")).alias("clean"))


@query("json_strip_trailing_commas", "SELECT event_id, replace(props, '}', '}') AS clean FROM events")
def json_strip_trailing_commas(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", answers.without_trailing_commas(F.replace("props", F.lit("}"), F.lit(", }"))).alias("clean"))


@query("json_boxed", "SELECT event_id, ' ' || event_type || ' ' AS block FROM events")
def json_boxed(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", answers.boxed_blocks(F.concat(F.lit("x $\\boxed{ "), "event_type", F.lit(" }$ y")))[0].alias("block"))


def _sinks_json(spark, sf_dir):
    k = F.col("event_id") % 4
    one = F.concat(F.lit('{"Sinks": [["'), "event_type", F.lit('", "b"], ["'), F.col("user_id").cast("string"), F.lit('"]]}'))
    return t(spark, sf_dir, "events").select("event_id", F.when(k == 0, one).when(k == 1, '{"Sinks": []}').when(k == 2, '{"Sinks": [["a", 1]]}').otherwise("None").alias("json_answer"))


SINKS = "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_type || chr(10) || 'b|' || user_id ELSE '' END AS sinks FROM events"


@query("json_parse_sinks", SINKS)
def json_parse_sinks(spark, sf_dir):
    return _sinks_json(spark, sf_dir).select("event_id", F.array_join(answers.parse_sinks(F.col("json_answer")), "|").alias("sinks"))


@query("json_parse_sinks_native", SINKS)
def json_parse_sinks_native(spark, sf_dir):
    return _sinks_json(spark, sf_dir).select("event_id", F.array_join(answers.parse_sinks_native(F.col("json_answer")), "|").alias("sinks"))


@query("json_get_level", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN 'invalid' ELSE CAST(event_id AS VARCHAR) END AS level FROM events")
def json_get_level(spark, sf_dir):
    i = F.col("event_id")
    body = F.when(i % 3 == 0, F.concat(F.lit('{"access_control_level": "'), "event_type", F.lit('"}'))).when(i % 3 == 1, "no top_similar found").otherwise(F.concat(F.lit('{"access_control_level": '), i.cast("string"), F.lit("}")))
    return t(spark, sf_dir, "events").select("event_id", answers.access_level(body).alias("level"))


@query("json_dumps", "SELECT event_id, '{\"k\": ' || (props::JSON->>'k') || '}' AS dumped FROM events")
def json_dumps(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", answers.extract_json(F.col("props"), "post").alias("dumped"))


@query("json_classify_empty", "SELECT event_id % 4 <> 0 AND event_id % 4 <> 2 AS empty, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def json_classify_empty(spark, sf_dir):
    return _sinks_json(spark, sf_dir).groupBy(text.is_empty_answer(F.col("json_answer")).alias("empty")).agg(F.count("*").alias("n"))


@query("q_empty_sinks", "SELECT CASE event_id % 4 WHEN 1 THEN '{\"Sinks\": []}' WHEN 3 THEN 'None' ELSE 'other' END AS answer, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def q_empty_sinks(spark, sf_dir):
    a = F.col("json_answer")
    return _sinks_json(spark, sf_dir).groupBy(F.when(text.is_empty_answer(a), a).otherwise("other").alias("answer")).agg(F.count("*").alias("n"))


@query("q_unparsable", f"SELECT event_id FROM events WHERE event_id % {FORMS} = 6")
def q_unparsable(spark, sf_dir):
    return _answers(spark, sf_dir).where(answers.extract_json(F.col("res"), "pre").isNull()).select("event_id")


@query("q_funnel_files", f"SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (event_id % {FORMS} <> 6) AS BIGINT) AS parsed, CAST(count(*) FILTER (event_id % {FORMS} <> 6 AND CAST(props::JSON->>'k' AS BIGINT) > 50) AS BIGINT) AS large FROM events")
def q_funnel_files(spark, sf_dir):
    from tracewright.operators.relational import funnel

    a = _answers(spark, sf_dir).select(_k(answers.extract_json(F.col("res"), "relaxed")))
    return funnel(a, {"parsed": F.col("k").isNotNull(), "large": F.col("k") > 50})


@query("q_counted_stage", f"""WITH x AS (SELECT CASE WHEN event_id % {FORMS} <> 6 THEN CAST(props::JSON->>'k' AS BIGINT) END AS k FROM events),
c AS (SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(k) AS BIGINT) AS parsed, CAST(count(*) FILTER (k > 50) AS BIGINT) AS large FROM x)
SELECT 'rows' AS counter, rows AS observed, rows AS stored FROM c UNION ALL SELECT 'parsed', parsed, parsed FROM c UNION ALL SELECT 'large', large, large FROM c""")
def q_counted_stage(spark, sf_dir):
    """A stage's table and the counters of the pass that wrote it, beside the counts of what is stored."""
    from tracewright.operators.relational import funnel

    steps = {"parsed": F.col("k").isNotNull(), "large": F.col("k") > 50}
    stage = _answers(spark, sf_dir).select("event_id", _k(answers.extract_json(F.col("res"), "relaxed")))
    table, seen = write_counted(stage, scratch(spark, "counted"), {"rows": F.lit(True)} | steps)
    stored = funnel(table, steps).unpivot([], ["rows", "parsed", "large"], "counter", "stored")
    observed = F.create_map(*[F.lit(x) for kv in seen.items() for x in kv])
    return stored.select("counter", F.element_at(observed, F.col("counter")).cast("long").alias("observed"), "stored")


# arrays ----------------------------------------------------------------------------------------------------------------------------


@query("arr_filter", "SELECT p_partkey, array_to_string(list_filter(string_split(p_type, ' '), lambda x: length(x) > 5), '|') AS words FROM part")
def arr_filter(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", F.array_join(F.filter(F.split("p_type", " "), lambda x: F.length(x) > 5), "|").alias("words"))


@query("arr_join", "SELECT p_partkey, replace(p_type, ' ', '<PATH_SEP>') AS words FROM part")
def arr_join(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", F.array_join(F.split("p_type", " "), text.PATH_SEPARATOR).alias("words"))


@query("arr_slice", "SELECT p_partkey, array_to_string(string_split(p_type, ' ')[2:3], '|') AS words FROM part")
def arr_slice(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", F.array_join(F.slice(F.split("p_type", " "), 2, 2), "|").alias("words"))


@query("arr_flatten", "SELECT p_partkey, replace(p_type, ' ', '|') || '|' || replace(p_name, ' ', '|') AS words FROM part")
def arr_flatten(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", F.array_join(F.flatten(F.array(F.split("p_type", " "), F.split("p_name", " "))), "|").alias("words"))


@query("arr_paired", "SELECT p_partkey, CAST(least(len(string_split(p_type, ' ')), p_size % 5) AS BIGINT) AS n FROM part")
def arr_paired(spark, sf_dir):
    other = F.when(F.col("p_size") % 5 > 0, F.sequence(F.lit(1), (F.col("p_size") % 5).cast("int"))).otherwise(F.array().cast("array<int>"))
    return t(spark, sf_dir, "part").select("p_partkey", F.size(arrays.paired(F.split("p_type", " "), other)).cast("long").alias("n"))


# model surfaces --------------------------------------------------------------------------------------------------------------------


def _said(spark, sf_dir, client, **options):
    n = t(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("void m() {\n    call"), "n_name", F.lit("();\n}")).alias("prompt"))
    return models.chat(n, client, "system", "prompt", "res", **options)


@query("udf_llm_chat", "SELECT n_nationkey, 'call' || n_name || '();' AS sink FROM nation")
def udf_llm_chat(spark, sf_dir):
    found = answers.extract_json(F.col("res"), "pre")
    return _said(spark, sf_dir, models.CannedClient).select("n_nationkey", answers.parse_sinks(found)[0].alias("sink"))


@query("udf_llm_threads", "SELECT n_nationkey, 'call' || n_name || '();' AS sink FROM nation")
def udf_llm_threads(spark, sf_dir):
    found = answers.extract_json(F.col("res"), "pre")
    return _said(spark, sf_dir, models.CannedClient, threads=4).select("n_nationkey", answers.parse_sinks(found)[0].alias("sink"))


class _Hangs(models.CannedClient):
    """A client that ignores its limit: every third prompt takes a minute."""

    def chat(self, system, user, timeout=None):
        time.sleep(60 if len(user) % 3 == 0 else 0)
        return "said"


@query("udf_llm_timeout", "SELECT n_nationkey, CASE WHEN length('void m() {' || chr(10) || '    call' || n_name || '();' || chr(10) || '}') % 3 = 0 THEN 'invalid' ELSE 'said' END AS res FROM nation")
def udf_llm_timeout(spark, sf_dir):
    return _said(spark, sf_dir, _Hangs, threads=8, timeout=0.5).select("n_nationkey", "res")


@query("udf_llm_local_batch", "SELECT n_nationkey, 'call' || n_name || '();' AS sink FROM nation")
def udf_llm_local_batch(spark, sf_dir):
    n = t(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("void m() {\n    call"), "n_name", F.lit("();\n}")).alias("prompt"))
    said = models.generate(n, models.CannedBatchModel, ["device:0", "device:1"], "system", "prompt", "res", batch=4)
    return said.select("n_nationkey", answers.parse_sinks(answers.extract_json(F.col("res"), "pre"))[0].alias("sink"))


@query("udf_llm_async_batch", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'answer ' || p_partkey WHEN 1 THEN 'Error: request errored' WHEN 2 THEN 'Error: request expired' ELSE 'Error: unknown result type' END AS res FROM part")
def udf_llm_async_batch(spark, sf_dir):
    """A job that is given up after its first poll and taken up by another driver's object, which sends nothing twice."""
    n, folder, service = t(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("prompt")), scratch(spark, "batches"), scratch(spark, "service")
    requests = models.batch_requests(n, "prompt", "p_partkey")
    job = lambda: BatchJob(spark, lambda: CannedBatchService(service), folder, 500)
    first = job()
    first.plan(requests)
    first.submit()
    first.poll(rounds=1)
    second = job()
    second.plan(requests)
    second.submit()
    second.poll(sleep=lambda s: None)
    second.fetch()
    return models.batch_results(n, second.results(), "p_partkey", "res").select("p_partkey", "res")


@query("udf_embed", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS unit FROM part")
def udf_embed(spark, sf_dir):
    v = models.embed(t(spark, sf_dir, "part").select("p_name"), models.HashedEmbedder, "p_name")
    return v.agg(F.count("*").alias("n"), F.count_if(F.abs(arrays.norm(F.col("embedding")) - 1) < 1e-9).alias("unit"))


@query("udf_json_extract", EXPECT)
def udf_json_extract(spark, sf_dir):
    return json_extract_pre(spark, sf_dir)


@query("udf_canned", "SELECT n_nationkey, true AS known FROM nation")
def udf_canned(spark, sf_dir):
    said = _said(spark, sf_dir, lambda: models.CannedClient("level"))
    return said.select("n_nationkey", (answers.access_level(F.col("res")) != "invalid").alias("known"))


CODE_SQL = "repeat('<s>' || p_name || ' ' || p_type, 15)"


@query("udf_encode_code", f"SELECT p_partkey, CAST(len(ids) AS BIGINT) AS n, CAST(list_sum(ids) AS BIGINT) AS total FROM (SELECT p_partkey, list_transform(string_split({CODE_SQL.replace('<s>', '')}, ''), lambda c: ord(c))[1:512] AS ids FROM part)")
def udf_encode_code(spark, sf_dir):
    def characters():
        return lambda s: [1 if c == "\x01" else ord(c) for c in s]  # 1: a special id

    code = F.repeat(F.concat(F.lit("\x01"), "p_name", F.lit(" "), "p_type"), 15)
    ids = models.encode_ids(code, characters, 512, frozenset([1]))
    return t(spark, sf_dir, "part").select("p_partkey", ids.alias("ids")).select("p_partkey", F.size("ids").cast("long").alias("n"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))
