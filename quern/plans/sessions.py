"""Ordered session streams: turns, islands, pairing, as-of and range joins, budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import ordered, tables
from quern.registry import query
from quern.session import table

ONE = "c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY transcript, line_no ORDER BY row_id) AS n FROM calls) WHERE n = 1)"


def _calls(spark, d):
    x = table(spark, d, "calls")
    keep = [c for c in x.columns if c not in ("transcript", "line_no")]
    return x.groupBy("transcript", "line_no").agg(F.min_by(F.struct(*keep), "row_id").alias("r")).select("transcript", "line_no", "r.*")


@query("win09_turns", f"WITH {ONE}, t AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY transcript ORDER BY line_no) AS turn FROM c) SELECT transcript, turn::BIGINT AS turn, count(*) AS rows, count(*) FILTER (tool IS NOT NULL) AS calls FROM t GROUP BY ALL")
def turns(spark, d):
    """Rows grouped between the user rows of a transcript."""
    t = ordered.scan(_calls(spark, d).select("transcript", "line_no", "role", "tool"), ["transcript"], ["line_no"], sums={"turn": (F.col("role") == "user").cast("int")})
    return t.groupBy("transcript", "turn").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("tool").isNotNull()).alias("calls"))


@query("win10_message_islands", f"WITH {ONE}, x AS (SELECT *, coalesce(message_id, 'r' || row_id) AS m, lag(coalesce(message_id, 'r' || row_id)) OVER (PARTITION BY transcript ORDER BY line_no) AS before FROM c), i AS (SELECT *, sum((before IS DISTINCT FROM m)::INT) OVER (PARTITION BY transcript ORDER BY line_no) AS island FROM x) SELECT transcript, island::BIGINT AS island, min(line_no) AS first_line, count(*) AS parts, arg_max(text, (coalesce(length(text), 0), line_no)) AS text FROM i GROUP BY transcript, island")
def message_islands(spark, d):
    """Consecutive lines with one message id are one message; its longest text stands."""
    x = _calls(spark, d).select("transcript", "line_no", "text", F.coalesce("message_id", F.concat(F.lit("r"), "row_id")).alias("m"))
    x = ordered.scan(x, ["transcript"], ["line_no"], before={"b": F.col("m")})
    x = ordered.scan(x, ["transcript"], ["line_no"], sums={"island": (~F.col("m").eqNullSafe(F.col("b"))).cast("int")})
    return x.groupBy("transcript", "island").agg(F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("parts"), F.max_by("text", F.when(F.col("text").isNotNull(), F.struct(F.length("text"), "line_no"))).alias("text"))


@query("joi15_call_pairing", f"WITH {ONE} SELECT a.tool, count(*) AS calls, count(b.row_id) AS answered, count(*) FILTER (b.is_error) AS errors FROM c a LEFT JOIN (SELECT transcript, tool_use_id, min(row_id) AS row_id, bool_or(is_error) AS is_error FROM c WHERE tool IS NULL AND tool_use_id IS NOT NULL GROUP BY ALL) b ON a.transcript = b.transcript AND a.tool_use_id = b.tool_use_id WHERE a.tool IS NOT NULL GROUP BY a.tool")
def call_pairing(spark, d):
    c = _calls(spark, d)
    res = c.where("tool is null and tool_use_id is not null").groupBy("transcript", "tool_use_id").agg(F.min("row_id").alias("res"), F.max("is_error").alias("err"))
    return c.where("tool is not null").join(res, ["transcript", "tool_use_id"], "left").groupBy("tool").agg(F.count(F.lit(1)).alias("calls"), F.count("res").alias("answered"), F.count_if("err").alias("errors"))


@query("joi16_asof_exposure", "WITH s AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'view'), u AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') SELECT u.event_id, (SELECT max(s.ts) FROM s WHERE s.user_id = u.user_id AND s.ts <= u.ts) AS shown_at FROM u")
def asof_exposure(spark, d):
    """The last view at or before each purchase of a user: one union and one window, no pairs."""
    x = table(spark, d, "events").where(F.col("event_type").isin("view", "purchase")).select("event_id", "user_id", "ts", F.when(F.col("event_type") == "view", F.col("ts")).alias("shown"))
    x = ordered.scan(x.withColumn("asks", F.col("shown").isNull()), ["user_id"], ["ts", "asks", "event_id"], lasts={"shown_at": F.col("shown")})
    return x.where("asks").select("event_id", "shown_at")


JOB = 20


@query("joi07_range_join", f"WITH {ONE}, e AS (SELECT transcript, min(line_no) AS low, max(line_no) AS high FROM c GROUP BY transcript), j AS (SELECT transcript, unnest(generate_series(low, high, {JOB})) AS first_line FROM e) SELECT j.transcript, j.first_line, count(*) AS covered, sum(coalesce(length(text), 0))::BIGINT AS chars FROM j JOIN c ON c.transcript = j.transcript AND c.line_no BETWEEN j.first_line AND j.first_line + {JOB - 1} GROUP BY ALL")
def range_join(spark, d):
    """Every transcript in consecutive jobs of ``JOB`` lines."""
    c = _calls(spark, d)
    j = c.groupBy("transcript").agg(F.min("line_no").alias("low"), F.max("line_no").alias("high")).select("transcript", F.expr(f"explode(sequence(low, high, {JOB}L))").alias("first_line"))
    return in_ranges(c.select("transcript", "line_no", "text"), j.withColumn("last_line", F.col("first_line") + JOB - 1)).groupBy("transcript", "first_line").agg(F.count(F.lit(1)).alias("covered"), F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("bigint").alias("chars"))


def in_ranges(lines, ranges):
    """Each line beside every range of its transcript that holds it; joined by cells of ``JOB`` lines, so a long transcript is not paired with itself."""
    cell = lambda c: F.floor(F.col(c) / JOB)
    touched = ranges.withColumn("cell", F.explode(F.sequence(cell("first_line"), cell("last_line"))))
    return lines.withColumn("cell", cell("line_no")).join(touched, ["transcript", "cell"]).where("line_no between first_line and last_line").drop("cell")


@query("agg16_busy_share", "WITH t AS (SELECT user_id, ts AS a, ts + to_seconds((10 + value)::BIGINT) AS b FROM events WHERE value >= 0), n AS (SELECT max(ts) AS hi, max(ts) - INTERVAL 1 DAY AS lo FROM events) SELECT user_id, sum(greatest(0, epoch(least(b, hi))::BIGINT - epoch(greatest(a, lo))::BIGINT))::BIGINT AS busy FROM t, n WHERE b > lo GROUP BY user_id".replace("epoch(least(b, hi))::BIGINT", "floor(epoch(least(b, hi)))::BIGINT").replace("epoch(greatest(a, lo))::BIGINT", "floor(epoch(greatest(a, lo)))::BIGINT").replace("(10 + value)::BIGINT", "floor(10 + value)::BIGINT"))
def busy_share(spark, d):
    """Seconds of work of the last day, clipped at its borders."""
    x = table(spark, d, "events").where("value >= 0")
    n = F.broadcast(table(spark, d, "events").agg(F.max("ts").alias("hi")).withColumn("lo", F.col("hi") - F.expr("INTERVAL 1 DAY")))
    t = x.crossJoin(n).withColumn("b", F.expr("ts + make_dt_interval(0, 0, 0, floor(10 + value))")).where("b > lo")
    at = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / 1000000)
    return t.groupBy("user_id").agg(F.sum(F.greatest(F.lit(0), at(F.least("b", "hi")) - at(F.greatest("ts", "lo")))).cast("bigint").alias("busy"))


@query("agg15_budget_hours", "SELECT date_trunc('hour', ts) AS hour, count(*) AS calls, round(sum(value), 4) AS cost FROM events GROUP BY 1")
def budget_hours(spark, d):
    return table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 4).alias("cost"))


@query("win06_next_sequence", "SELECT lower(trim(session, ' ' || chr(10) || chr(9))) AS session, max(line_no) + 1 AS next_seq, count(DISTINCT transcript) AS transcripts FROM calls GROUP BY 1")
def next_sequence(spark, d):
    return table(spark, d, "calls").groupBy(F.lower(F.trim("session", F.lit(" \n\t"))).alias("session")).agg((F.max("line_no") + 1).alias("next_seq"), F.countDistinct("transcript").alias("transcripts"))


@query("win07_growth_bound", f"WITH {ONE}, r AS (SELECT transcript, line_no, sum(coalesce(length(text), 0) + coalesce(length(prompt), 0)) OVER (PARTITION BY transcript ORDER BY line_no DESC) AS run FROM c) SELECT transcript, min(line_no) AS from_line, max(run)::BIGINT AS chars FROM r WHERE run <= 2000 GROUP BY transcript")
def growth_bound(spark, d):
    """The longest contiguous end of a transcript within 2,000 characters."""
    size = F.coalesce(F.length("text"), F.lit(0)) + F.coalesce(F.length("prompt"), F.lit(0))
    x = _calls(spark, d).select("transcript", "line_no", (-F.col("line_no")).alias("back"), size.alias("size"))
    return ordered.scan(x, ["transcript"], ["back"], sums={"run": F.col("size")}).where("run <= 2000").groupBy("transcript").agg(F.min("line_no").alias("from_line"), F.max("run").alias("chars"))


@query("sup11_recent_verdict", f"WITH {ONE}, t AS (SELECT transcript, line_no, tool, bool_or(tool = 'Recall') OVER (PARTITION BY transcript ORDER BY line_no ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS recent FROM c WHERE tool IS NOT NULL) SELECT tool, count(*) AS calls, count(*) FILTER (recent) AS after_recall FROM t GROUP BY tool")
def recent_verdict(spark, d):
    """Calls with a recall among the ten calls before them: by the distance to the last one, no frame of rows."""
    t = ordered.scan(_calls(spark, d).where("tool is not null").select("transcript", "line_no", "tool"), ["transcript"], ["line_no"], sums={"i": F.lit(1)})
    t = ordered.scan(t, ["transcript"], ["line_no"], before={"last": F.when(F.col("tool") == "Recall", F.col("i"))})
    t = t.withColumn("recent", F.coalesce(F.col("i") - F.col("last") <= 10, F.lit(False)))
    return t.groupBy("tool").agg(F.count(F.lit(1)).alias("calls"), F.count_if("recent").alias("after_recall"))


@query("win08_last_prompts", f"WITH {ONE}, p AS (SELECT transcript, line_no, lag(line_no, 2) OVER (PARTITION BY transcript ORDER BY line_no) AS from_line FROM c WHERE role = 'user' AND prompt IS NOT NULL) SELECT transcript, line_no, from_line FROM p")
def last_prompts(spark, d):
    """The line of the second prompt before each prompt, where a window of the last prompts begins."""
    x = _calls(spark, d).where("role = 'user' and prompt is not null").select("transcript", "line_no")
    x = ordered.scan(x, ["transcript"], ["line_no"], before={"one": F.col("line_no")})
    return ordered.scan(x, ["transcript"], ["line_no"], before={"from_line": F.col("one")}).select("transcript", "line_no", "from_line")


@query("jsn01_tool_inputs", f"WITH {ONE} SELECT tool, count(*) AS calls, count(json_extract_string(tool_input, '$.command')) AS commands, count(json_extract_string(tool_input, '$.file_path')) AS files FROM c WHERE tool IS NOT NULL AND (tool_input IS NULL OR json_valid(tool_input)) GROUP BY tool")
def tool_inputs(spark, d):
    c = _calls(spark, d).where("tool is not null").where(F.col("tool_input").isNull() | F.try_parse_json("tool_input").isNotNull())
    return c.groupBy("tool").agg(F.count(F.lit(1)).alias("calls"), F.count(F.get_json_object("tool_input", "$.command")).alias("commands"), F.count(F.get_json_object("tool_input", "$.file_path")).alias("files"))


@query("agg11_guard_tally", """WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE lower(trim(source)) IN ('guard_logs', 'guard-logs') AND created_at > (SELECT max(created_at) FROM documents) - INTERVAL 14 DAY), j AS (SELECT json_extract_string(line, '$.decision') AS decision, unnest(from_json(json_extract_string(line, '$.ids'), '["BIGINT"]')) AS rule FROM (SELECT * FROM l WHERE json_valid(line) AND line LIKE '{"tool"%')), t AS (SELECT rule, count(*) FILTER (decision = 'deny') AS denies, count(*) FILTER (decision = 'override') AS overrides FROM j WHERE decision IN ('deny', 'override') GROUP BY rule) SELECT rule, denies, overrides, overrides >= 3 AND overrides::DOUBLE / greatest(denies, overrides) >= 0.5 AS quarantined FROM t""")
def guard_tally(spark, d):
    """Denies and overrides by rule in the guard logs of the last fourteen days; three overrides at half the rate quarantine a rule."""
    src = F.lower(F.trim("source"))
    docs = table(spark, d, "documents")
    end = F.broadcast(docs.agg((F.max("created_at") - F.expr("INTERVAL 14 DAYS")).alias("start")))
    recent = docs.where(src.isin("guard_logs", "guard-logs")).select("text", "created_at").crossJoin(end).where("created_at > start")
    lines = recent.select(F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").startswith('{"tool"') & F.try_parse_json("line").isNotNull())
    j = lines.select(F.get_json_object("line", "$.decision").alias("decision"), F.explode(F.from_json(F.get_json_object("line", "$.ids"), "array<bigint>")).alias("rule"))
    t = j.where(F.col("decision").isin("deny", "override")).groupBy("rule").agg(F.count_if(F.col("decision") == "deny").alias("denies"), F.count_if(F.col("decision") == "override").alias("overrides"))
    return t.withColumn("quarantined", (F.col("overrides") >= 3) & (F.col("overrides") / F.greatest("denies", "overrides", F.lit(1)) >= 0.5))
