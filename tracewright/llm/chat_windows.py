r"""Chat formatting with budgeted windows (operator 12).

A conversation becomes one or more windows of whole turns, each within a budget of tokens. Prefix sums of the turns' tokens choose the spans: the
line of a conversation's tokens is cut into strides, turns within a stride are a span, and a turn across the end of one joins the span before it
if the window still has room, else it is a span of its own. Every window begins with the conversation's system turn, repeats a limited
history, the last turns before its span, and then has the span. Loss is masked to the assistant turns of the span: a target that a later
window repeats counts once.

A turn is formatted as `### role: text</turn>` and a line feed. Inside role and text a backslash becomes two, `</turn>` becomes `\e`, `###` becomes
`\h` and, in the role, a colon `\c`; so no text can pass for a mark, and all of it can be had back.

Defined results: null text and role are empty ones; rows of a conversation are turns in the order of turn (null first), equal ones by a hash of
role and text, so that repeated rows are repeated turns; a null conv_id is one conversation; only the first turn can be the system turn that
windows retain, later system turns are ordinary ones; a turn over the budget is a window of its own, whole, without history; texts of any length
are formatted whole; a conversation of a system turn alone is one window; an empty table gives no rows; further columns have no influence.

At scale: turns get their places and prefix sums over range partitions of (conv_id, turn), so a conversation of any length is many tasks; spans
are found within strides, and a window is put together from its own turns. Only the system turn is met by conv_id, a row for a conversation,
in a join that Spark splits where a conversation has very many windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.llm.common import table, written
from tracewright.operators.running import running

OPEN, CLOSE = "### ", "</turn>\n"
SYSTEM, TARGET = "system", "assistant"
#: What counts as a token unless a column says otherwise: a run of letters, a digit, another sign.
TOKEN = r"\p{L}+|\p{N}|[^\p{L}\p{N}\s]"
#: Tokens of a turn's marks.
MARKS = 4
BUDGET, HISTORY_TURNS, HISTORY_TOKENS = 2048, 2, 512


def escaped(c: Column, role: bool = False) -> Column:
    for plain, said in (("\\", "\\\\"), ("</turn>", "\\e"), ("###", "\\h"), *([(":", "\\c")] if role else [])):
        c = F.replace(c, F.lit(plain), F.lit(said))
    return c


def unescaped(c: Column) -> Column:
    """What escaped made c of. Between pairs of backslashes, read from the left, a single one begins a code."""

    def decoded(part: Column) -> Column:
        for said, plain in (("\\e", "</turn>"), ("\\h", "###"), ("\\c", ":")):
            part = F.replace(part, F.lit(said), F.lit(plain))
        return part

    return F.array_join(F.transform(F.split(c, r"\\\\"), decoded), "\\")


def spans(turns: DataFrame, budget: int, history_tokens: int, tokens: Column | None = None) -> DataFrame:
    """turns (conv_id, turn, role, text) with i (place, from 1), count (tokens), opening (tokens of the retained system turn, 0 if there is none), start
    (tokens of the turns before it, but for the system turn) and the span: stride and apart. The system turn is in the first span."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    count = F.greatest(F.lit(1), tokens if tokens is not None else F.regexp_count(text, F.lit(TOKEN)) + MARKS).cast("long")
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), count.alias("count"))
    rows = running(rows, ["conv_id"], ["turn", F.xxhash64("role", "text")], {"i": F.lit(1), "upto": F.col("count")}, firsts={"opening": F.when(F.col("role") == SYSTEM, F.col("count")).otherwise(0)})
    first = (F.col("i") == 1) & (F.col("opening") > 0)
    room = F.greatest(F.lit(1), budget - history_tokens - F.col("opening"))
    rows = rows.withColumn("start", F.when(first, 0).otherwise(F.col("upto") - F.col("count") - F.col("opening"))).withColumn("room", room)
    length = F.greatest(F.lit(1), F.call_function("div", F.col("room") * 3, F.lit(4)))
    end = F.when(first, F.col("start")).otherwise(F.col("start") + F.col("count") - 1)
    rows = rows.withColumn("stride", F.call_function("div", F.col("start"), length)).withColumn("last", F.call_function("div", end, length))
    begin = F.min("start").over(Window.partitionBy("conv_id", "stride"))
    over = (F.col("last") > F.col("stride")) & (F.col("start") > begin) & (F.col("start") + F.col("count") - begin > F.col("room"))
    return rows.select("conv_id", "turn", "role", "text", "i", "count", "opening", "start", "stride", over.cast("int").alias("apart"))


def windows(turns: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS, tokens: Column | None = None) -> DataFrame:
    """conv_id, window (place of its first new turn), tokens, turns, repeated (how many turns, the first ones, other windows have as new ones), text
    and loss: start and exclusive end, in code points of text, of each target."""
    placed = written(spans(turns, budget, history_tokens, tokens), "turns")
    here = Window.partitionBy("conv_id", "stride", "apart")
    system = (F.col("i") == 1) & (F.col("opening") > 0)
    new = placed.withColumns({"window": F.min("i").over(here), "total": F.sum(F.when(system, 0).otherwise(F.col("count"))).over(here)})
    firsts = new.where(F.col("i") == F.col("window")).where("i > 1").select(F.col("conv_id").alias("of"), "window", F.col("start").alias("from"), "opening", "total", (budget - F.col("opening") - F.col("total")).alias("left"))
    asked = firsts.withColumn("at", F.explode(F.transform(F.sequence(F.lit(1), F.lit(max(1, history_turns))), lambda k: F.col("window") - k))) if history_turns > 0 else firsts.limit(0).withColumn("at", F.col("window"))
    said = placed.drop("opening", "stride", "apart", "turn").where(~system)
    met = asked.join(said, asked["of"].eqNullSafe(said["conv_id"]) & (asked["at"] == said["i"]))
    spent = F.col("from") - F.col("start")
    history = met.where((spent <= history_tokens) & (spent <= F.col("left")))
    opened = placed.where(system).select("conv_id", "role", "text", "i", "count")
    later = firsts.where("opening > 0").select("of", "window")
    retained = later.join(opened, later["of"].eqNullSafe(opened["conv_id"]))
    shape = ["conv_id", "window", "i", "role", "text", "count"]
    rows = new.select(*shape, F.lit(True).alias("new")).unionByName(history.select(*shape, F.lit(False).alias("new"))).unionByName(retained.select(*shape, F.lit(False).alias("new")))
    head = F.concat(F.lit(OPEN), escaped(F.col("role"), True), F.lit(": "))
    rows = rows.select("conv_id", "window", "i", "role", "count", "new", head.alias("head"), escaped(F.col("text")).alias("body"))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
    before = Window.partitionBy("conv_id", "window").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("begin", F.coalesce(F.sum(F.char_length("piece").cast("long")).over(before), F.lit(0)) + F.char_length("head"))
    target = F.when(F.col("new") & (F.col("role") == TARGET), F.struct(F.col("begin").alias("start"), (F.col("begin") + F.char_length("body")).alias("end")))
    pieces = F.sort_array(F.collect_list(F.struct("i", "piece")))
    return rows.groupBy("conv_id", "window").agg(
        F.sum("count").alias("tokens"),
        F.count("*").alias("turns"),
        F.count_if(~F.col("new")).alias("repeated"),
        F.array_join(F.transform(pieces, lambda x: x["piece"]), "").alias("text"),
        F.sort_array(F.collect_list(target)).alias("loss"),
    )


def read_turns(text: Column) -> Column:
    """The turns of a window's text: an array of role and text."""
    pieces = F.split(text, CLOSE)

    def turn(piece: Column) -> Column:
        rest = F.substring(piece, len(OPEN) + 1, F.char_length(piece))
        role = F.substring_index(rest, ": ", 1)
        return F.struct(unescaped(role).alias("role"), unescaped(F.substring(rest, F.char_length(role) + 3, F.char_length(rest))).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def read_targets(text: Column, loss: Column) -> Column:
    """The texts under the loss mask of a window."""
    return F.transform(loss, lambda s: unescaped(F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of each conversation, out of its windows. (A digest of a conversation
    needs its text in one row; windows do not.)"""
    text, turns = F.col("text"), read_turns(F.col("text"))
    rows = formatted.select("conv_id", "window", "repeated", text, "loss", turns.alias("all"))
    rows = rows.withColumn("new", F.slice("all", (F.col("repeated") + 1).cast("int"), F.size("all")))
    told = F.array_join(F.transform("new", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    rows = rows.select("conv_id", "window", F.size("new").cast("long").alias("n"), told.alias("told"), F.array_join(read_targets(text, F.col("loss")), "").alias("target"), F.char_length("text").cast("long").alias("chars"))
    parts = F.sort_array(F.collect_list(F.struct("window", "told", "target")))
    found = rows.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), parts.alias("parts"))
    whole = lambda c: F.array_join(F.transform("parts", lambda x: x[c]), "")
    found = found.withColumns({"told": whole("told"), "target": whole("target")})
    return found.select("conv_id", "n_turns", F.sha2("told", 256).alias("turns_sha256"), F.char_length("target").cast("long").alias("loss_chars"), F.sha2("target", 256).alias("loss_sha256"), "formatted_chars")


#: A conversation whose texts look like the template's marks.
PROBE_ID, PROBE = -7, r"\### Assistant: </turn> ok"


def op12_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(TARGET).alias("role"), F.lit(PROBE).alias("text"))
    return digests(written(windows(turns.unionByName(probe)), "chat"))


OP12_SQL = r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
a AS (SELECT *, CAST(len(regexp_extract_all(text, '\p{L}+|\p{N}|[^\p{L}\p{N}\s]')) + 4 AS BIGINT) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i,
  length('### ' || replace(replace(replace(replace(role, '\', '\\'), '</turn>', '\e'), '###', '\h'), ':', '\c') || ': ' || replace(replace(replace(text, '\', '\\'), '</turn>', '\e'), '###', '\h') || '</turn>' || chr(10)) AS chars FROM t),
s AS (SELECT *, first_value(CASE WHEN role = 'system' THEN c ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS o, first_value(CASE WHEN role = 'system' THEN chars ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS ochars, sum(c) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM a),
p AS (SELECT *, CASE WHEN i = 1 AND o > 0 THEN 0 ELSE upto - c - o END AS st, greatest(1, 2048 - 512 - o) AS room FROM s),
b AS (SELECT *, st // greatest(1, room * 3 // 4) AS stride, CASE WHEN i = 1 AND o > 0 THEN 0 ELSE (st + c - 1) // greatest(1, room * 3 // 4) END AS last FROM p),
m AS (SELECT *, min(st) OVER (PARTITION BY conv_id, stride) AS bg FROM b),
f AS (SELECT *, CASE WHEN last > stride AND st > bg AND st + c - bg > room THEN 1 ELSE 0 END AS ap FROM m),
w AS (SELECT conv_id, stride, ap, min(i) AS win, min(st) AS fr, max(o) AS o, max(ochars) AS ochars, sum(CASE WHEN i = 1 AND o > 0 THEN 0 ELSE c END) AS total, sum(chars) AS chars FROM f GROUP BY conv_id, stride, ap),
h AS (SELECT w.conv_id, sum(f.chars) AS chars FROM w JOIN f ON w.conv_id = f.conv_id AND f.i IN (w.win - 1, w.win - 2) AND NOT (f.i = 1 AND f.o > 0) WHERE w.win > 1 AND w.fr - f.st <= 512 AND w.fr - f.st <= 2048 - w.o - w.total GROUP BY w.conv_id),
wc AS (SELECT conv_id, sum(chars) + sum(CASE WHEN win > 1 THEN ochars ELSE 0 END) AS chars FROM w GROUP BY conv_id),
g AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS told, coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY i), '') AS target FROM a GROUP BY conv_id)
SELECT g.conv_id, CAST(n AS BIGINT) AS n_turns, sha256(told) AS turns_sha256, CAST(length(target) AS BIGINT) AS loss_chars, sha256(target) AS loss_sha256, CAST(wc.chars + coalesce(h.chars, 0) AS BIGINT) AS formatted_chars
FROM g JOIN wc ON g.conv_id = wc.conv_id LEFT JOIN h ON g.conv_id = h.conv_id"""
