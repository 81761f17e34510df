"""Joins, set operations and aggregations over notes, calls, verdicts and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions.scores import wilson
from quern.functions.text import label_list, tokens
from quern.operators import labelsets, tables
from quern.plans.evaluation import W as WILSON
from quern.plans.notes import CURRENT, current
from quern.plans.recall import STOPS, TOK
from quern.operators.recall import STOP_WORDS
from quern.plans.sessions import ONE, _calls
from quern.plans.trust import EV, events
from quern.registry import query
from quern.session import stored, table

COUNTS = "k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY folded_event_id DESC) AS n FROM counts) WHERE n = 1)"
LABELS = "list_distinct(list_filter(list_transform(from_json(labels, '[\"VARCHAR\"]'), lambda x: lower(trim(x))), lambda x: x <> ''))"


def counts(spark, d):
    return tables.newest(table(spark, d, "counts"), ["memory_id"], ["folded_event_id"])


@query("joi03_counts_and_events", f"WITH {CURRENT}, {COUNTS}, {EV}, f AS (SELECT note, count(*) FILTER (kind = 'use') AS uses, count(*) FILTER (kind = 'contradiction') AS against, max(ts) AS last_ts FROM e GROUP BY note) SELECT m.memory_id, coalesce(k.trials, 0) AS trials, coalesce(k.trials, 0) + coalesce(f.uses, 0) + coalesce(f.against, 0) AS seen, f.last_ts FROM m LEFT JOIN k USING (memory_id) LEFT JOIN f ON f.note = m.memory_id")
def counts_and_events(spark, d):
    """Every note with its folded counts and what newer events add; events are summed before the joins."""
    e = events(spark, d).groupBy(F.col("note").alias("memory_id")).agg(F.count_if(F.col("kind") == "use").alias("uses"), F.count_if(F.col("kind") == "contradiction").alias("against"), F.max("ts").alias("last_ts"))
    x = current(spark, d).select("memory_id").join(counts(spark, d).select("memory_id", "trials"), "memory_id", "left").join(e, "memory_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    return x.select("memory_id", n("trials").alias("trials"), (n("trials") + n("uses") + n("against")).alias("seen"), "last_ts")


@query("joi08_exists_chain", f"WITH {CURRENT} SELECT memory_id FROM m WHERE EXISTS (SELECT 1 FROM memory_chunks c WHERE c.parent_id = m.memory_id) AND NOT EXISTS (SELECT 1 FROM counts k WHERE k.memory_id = m.memory_id) AND NOT EXISTS (SELECT 1 FROM verdicts v WHERE v.memory_a = m.memory_id OR v.memory_b = m.memory_id)")
def exists_chain(spark, d):
    """Notes with chunks that were never counted nor judged: one semi join and two anti joins."""
    judged = table(spark, d, "verdicts").select(F.explode(F.array("memory_a", "memory_b")).alias("memory_id"))
    chunks = table(spark, d, "memory_chunks").select(F.col("parent_id").alias("memory_id"))
    return current(spark, d).select("memory_id").join(chunks, "memory_id", "left_semi").join(table(spark, d, "counts").select("memory_id"), "memory_id", "left_anti").join(judged, "memory_id", "left_anti")


@query("joi09_unreferenced_labels", "WITH used AS (SELECT DISTINCT lower(trim(unnest(from_json(labels, '[\"VARCHAR\"]')))) AS label FROM entries WHERE labels IS NOT NULL), have AS (SELECT DISTINCT lower(trim(unnest(from_json(labels, '[\"VARCHAR\"]')))) AS label FROM memories WHERE labels IS NOT NULL) SELECT label FROM have WHERE label <> '' AND NOT EXISTS (SELECT 1 FROM used WHERE used.label = have.label)")
def unreferenced_labels(spark, d):
    """Labels of notes that no import names; an anti join, so nulls exclude nothing."""
    of = lambda name: table(spark, d, name).select(F.explode(label_list(F.col("labels"))).alias("label")).distinct()
    return of("memories").join(of("entries"), "label", "left_anti")


@query("joi10_resolve_paths", f"WITH {CURRENT}, p AS (SELECT DISTINCT path FROM memories), c AS (SELECT path, count(*) AS n, min(memory_id) AS memory_id FROM m WHERE deleted_at IS NULL GROUP BY path) SELECT p.path, CASE WHEN n = 1 THEN memory_id END AS memory_id, coalesce(n, 0) AS candidates FROM p LEFT JOIN c USING (path)")
def resolve_paths(spark, d):
    """A path without a root names a note only where one live note has it."""
    c = current(spark, d).where("deleted_at is null").groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("memory_id").alias("m"))
    p = table(spark, d, "memories").select("path").distinct().join(c, "path", "left")
    return p.select("path", F.when(F.col("n") == 1, F.col("m")).alias("memory_id"), F.coalesce("n", F.lit(0)).alias("candidates"))


@query("joi11_row_to_file", f"WITH {CURRENT}, e AS (SELECT DISTINCT entry_id, lower(trim(import_file)) AS f FROM entries), byp AS (SELECT lower(path) AS f, min(memory_id) AS a FROM m GROUP BY 1), byn AS (SELECT lower(trim(name)) AS f, min(memory_id) AS b FROM m WHERE trim(name) <> '' GROUP BY 1) SELECT m.memory_id, coalesce(byp.a, byn.b) AS file_id FROM m LEFT JOIN byp ON byp.f = lower(m.path) LEFT JOIN byn ON byn.f = lower(trim(m.name))")
def row_to_file(spark, d):
    """The file of a row by path, else by name; the smallest id of equals."""
    m = current(spark, d)
    by_path = m.groupBy(F.lower("path").alias("p")).agg(F.min("memory_id").alias("a"))
    by_name = m.where("trim(name) <> ''").groupBy(F.lower(F.trim("name")).alias("n")).agg(F.min("memory_id").alias("b"))
    x = m.select("memory_id", F.lower("path").alias("p"), F.lower(F.trim("name")).alias("n"))
    return x.join(by_path, "p", "left").join(by_name, "n", "left").select("memory_id", F.coalesce("a", "b").alias("file_id"))


TARGET = "json_extract_string(tool_input, '$.target')"
FILES = "[a-z]+/[a-z_]+\\.(?:rs|py|sql|md|toml|yaml|json|sh|go|ts)"


@query("joi13_path_suffix", f"WITH t AS (SELECT DISTINCT {TARGET} AS target FROM calls WHERE json_valid(tool_input) AND {TARGET} IS NOT NULL), f AS (SELECT DISTINCT memory_id, unnest(regexp_extract_all(coalesce(body, ''), '{FILES}')) AS file FROM memories), l AS (SELECT DISTINCT memory_id, regexp_extract(file, '([^/]+)$', 1) AS leaf FROM f) SELECT target, count(*) AS notes FROM t JOIN l ON t.target = l.leaf OR ends_with(t.target, '/' || l.leaf) GROUP BY target")
def path_suffix(spark, d):
    """Targets that end in a file a note names: the suffixes of a target are spread and joined by equality."""
    t = table(spark, d, "calls").where(F.try_parse_json("tool_input").isNotNull()).select(F.get_json_object("tool_input", "$.target").alias("target")).where("target is not null").distinct()
    parts = F.split("target", "/")
    ends = t.select("target", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, 1000), "/"))).alias("leaf"))
    f = table(spark, d, "memories").select("memory_id", F.explode(F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(FILES), F.lit(0))).alias("file"))
    leaves = f.select("memory_id", F.regexp_extract("file", "([^/]+)$", 1).alias("leaf")).distinct()
    return ends.join(leaves, "leaf").groupBy("target").agg(F.countDistinct("memory_id", "leaf").alias("notes"))


@query("joi14_rule_matches", f"WITH r AS (SELECT DISTINCT label, '\\b' || label || '[_.]' AS pattern FROM (SELECT unnest({LABELS}) AS label FROM memories) WHERE regexp_matches(label, '^[a-z]+$')), c AS (SELECT row_id, tool, {TARGET} AS command FROM calls WHERE tool IS NOT NULL AND json_valid(tool_input)) SELECT r.label AS rule, count(*) AS calls, count(DISTINCT tool) AS tools FROM c JOIN r ON regexp_matches(c.command, r.pattern) GROUP BY r.label")
def rule_matches(spark, d):
    """Commands against rules with a pattern each: the literal of a rule is joined with the words of a command, then the pattern decides."""
    r = table(spark, d, "memories").select(F.explode(label_list(F.col("labels"))).alias("rule")).where(F.col("rule").rlike("^[a-z]+$")).distinct().withColumn("pattern", F.concat(F.lit(r"\b"), "rule", F.lit("[_.]")))
    c = table(spark, d, "calls").where(F.col("tool").isNotNull() & F.try_parse_json("tool_input").isNotNull()).select("row_id", "tool", F.get_json_object("tool_input", "$.target").alias("command"))
    words = c.select("*", F.explode(F.array_distinct(F.regexp_extract_all("command", F.lit("[a-z]+"), F.lit(0)))).alias("rule"))
    hit = words.join(r, "rule").where(F.expr("command rlike pattern"))
    return hit.groupBy("rule").agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("tool").alias("tools"))


@query("joi19_conflicts", f"WITH {CURRENT}, v AS (SELECT DISTINCT * FROM verdicts WHERE upper(trim(verdict)) = 'CONTRADICT') SELECT v.verdict_id, a.path AS path_of_a, b.path AS path_of_b, a.archived_at IS NOT NULL OR b.archived_at IS NOT NULL AS settled, coalesce(ka.trials, 0) + coalesce(kb.trials, 0) AS trials FROM v LEFT JOIN m a ON a.memory_id = v.memory_a LEFT JOIN m b ON b.memory_id = v.memory_b LEFT JOIN (SELECT memory_id, max(trials) AS trials FROM counts GROUP BY memory_id) ka ON ka.memory_id = v.memory_a LEFT JOIN (SELECT memory_id, max(trials) AS trials FROM counts GROUP BY memory_id) kb ON kb.memory_id = v.memory_b")
def conflicts(spark, d):
    """Contradicting decisions beside both notes and their counts."""
    v = table(spark, d, "verdicts").where(F.upper(F.trim("verdict")) == "CONTRADICT").distinct().select("verdict_id", "memory_a", "memory_b")
    k = table(spark, d, "counts").groupBy("memory_id").agg(F.max("trials").alias("trials"))
    side = current(spark, d).select("memory_id", "path", "archived_at").join(k, "memory_id", "left")
    a, b = (side.toDF(f"memory_{s}", f"path_of_{s}", f"archived_{s}", f"trials_{s}") for s in "ab")
    x = v.join(a, "memory_a", "left").join(b, "memory_b", "left")
    return x.select("verdict_id", "path_of_a", "path_of_b", (F.col("archived_a").isNotNull() | F.col("archived_b").isNotNull()).alias("settled"), (F.coalesce("trials_a", F.lit(0)) + F.coalesce("trials_b", F.lit(0))).alias("trials"))


@query("joi20_supersede_edges", f"WITH {CURRENT}, v AS (SELECT CASE upper(trim(survivor)) WHEN 'A' THEN memory_a WHEN 'B' THEN memory_b END AS kept, CASE upper(trim(survivor)) WHEN 'A' THEN memory_b WHEN 'B' THEN memory_a END AS old, judged_at, verdict_id FROM verdicts WHERE upper(trim(verdict)) IN ('SUPERSEDE', 'MERGE')) SELECT old AS memory_id, arg_max(kept, (judged_at, verdict_id)) AS successor, bool_or(m.archived_at IS NOT NULL) AS archived, count(DISTINCT kept) AS successors FROM v JOIN m ON m.memory_id = v.old WHERE kept IS NOT NULL GROUP BY old")
def supersede_edges(spark, d):
    """Notes that a judge replaced, with the latest successor and whether they are archived."""
    s = F.upper(F.trim("survivor"))
    v = table(spark, d, "verdicts").where(F.upper(F.trim("verdict")).isin("SUPERSEDE", "MERGE")).select(F.when(s == "A", F.col("memory_a")).when(s == "B", F.col("memory_b")).alias("kept"), F.when(s == "A", F.col("memory_b")).when(s == "B", F.col("memory_a")).alias("memory_id"), "judged_at", "verdict_id").where("kept is not null")
    x = v.join(current(spark, d).select("memory_id", "archived_at"), "memory_id")
    return x.groupBy("memory_id").agg(F.max_by("kept", F.struct("judged_at", "verdict_id")).alias("successor"), F.max(F.col("archived_at").isNotNull()).alias("archived"), F.countDistinct("kept").alias("successors"))


@query("agg08_feedback_merge", "SELECT user_id, json_extract_string(props, '$.k')::BIGINT AS note, event_type AS kind, min(ts) AS ts, count(*) AS events, list_sort(list_distinct(list(strftime(ts, '%Y-%m-%d')))) AS days FROM events GROUP BY ALL")
def feedback_merge(spark, d):
    """One row a user, note and kind: the earliest time and the sorted days it came from."""
    x = table(spark, d, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("note"), F.col("event_type").alias("kind"), "ts", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    per = x.groupBy("user_id", "note", "kind", "day").agg(F.min("ts").alias("ts"), F.count(F.lit(1)).alias("n"))
    return per.groupBy("user_id", "note", "kind").agg(F.min("ts").alias("ts"), F.sum("n").alias("events"), F.array_sort(F.collect_list("day")).alias("days"))


@query("agg12_stop_report", "WITH x AS (SELECT event_type AS check_name, CASE WHEN value >= 100 THEN 'blocking' WHEN value >= 50 THEN 'reminding' ELSE 'shadow' END AS mode, ts FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 14 DAY) SELECT check_name, count(*) AS seen, count(*) FILTER (mode = 'blocking') AS blocking, count(*) FILTER (mode = 'reminding') AS reminding, count(*) FILTER (mode = 'shadow') AS shadow, max(ts) AS last_ts FROM x GROUP BY check_name")
def stop_report(spark, d):
    """Counts of each check by mode over the last fourteen days."""
    x = table(spark, d, "events")
    end = x.agg(F.max("ts").alias("end"))
    mode = F.when(F.col("value") >= 100, "blocking").when(F.col("value") >= 50, "reminding").otherwise("shadow")
    x = x.crossJoin(F.broadcast(end)).where(F.col("ts") > F.col("end") - F.expr("INTERVAL 14 DAYS")).select(F.col("event_type").alias("check_name"), mode.alias("mode"), "ts")
    return x.groupBy("check_name").agg(F.count(F.lit(1)).alias("seen"), *[F.count_if(F.col("mode") == m).alias(m) for m in ("blocking", "reminding", "shadow")], F.max("ts").alias("last_ts"))


@query("agg13_trigger_share", f"WITH {CURRENT}, l AS (SELECT DISTINCT memory_id, unnest({LABELS}) AS label FROM m), n AS (SELECT count(DISTINCT memory_id)::DOUBLE AS n FROM m) SELECT label, count(*) AS df, round(count(*) / max(n), 6) AS share, round(ln(max(n) / (1 + count(*))), 6) AS rarity FROM l, n GROUP BY label")
def trigger_share(spark, d):
    """Share of the notes that have a label, and its rarity ln(n / (1 + df))."""
    m = current(spark, d).select("memory_id", label_list(F.col("labels")).alias("l"))
    n = F.broadcast(m.agg(F.count(F.lit(1)).cast("double").alias("n")))
    df = m.select(F.explode("l").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("df")).crossJoin(n)
    return df.select("label", "df", F.round(F.col("df") / F.col("n"), 6).alias("share"), F.round(F.log(F.col("n") / (1 + F.col("df"))), 6).alias("rarity"))


@query("mth11_evidence", f"WITH {CURRENT}, l AS (SELECT DISTINCT memory_id, unnest({LABELS}) AS label FROM m), n AS (SELECT count(*)::DOUBLE AS n FROM m), f AS (SELECT label, count(*) AS df FROM l GROUP BY label) SELECT memory_id, count(*) AS labels, round(sum(ln(n / (1 + df))), 6) AS evidence, round(sum(ln(n / df)), 6) AS label_score FROM l JOIN f USING (label), n GROUP BY memory_id")
def evidence(spark, d):
    """Rarity of the labels of a note, summed."""
    m = current(spark, d).select("memory_id", label_list(F.col("labels")).alias("l"))
    n = F.broadcast(m.agg(F.count(F.lit(1)).cast("double").alias("n")))
    each = m.select("memory_id", F.explode("l").alias("label"))
    f = each.groupBy("label").agg(F.count(F.lit(1)).alias("df"))
    x = each.join(f, "label").crossJoin(n)
    return x.groupBy("memory_id").agg(F.count(F.lit(1)).alias("labels"), F.round(F.sum(F.log(F.col("n") / (1 + F.col("df")))), 6).alias("evidence"), F.round(F.sum(F.log(F.col("n") / F.col("df"))), 6).alias("label_score"))


@query("agg14_label_index", f"WITH {CURRENT}, l AS (SELECT DISTINCT memory_id, root, unnest({LABELS}) AS label FROM m), f AS (SELECT label, count(*) AS df, count(DISTINCT root) AS root_df FROM l GROUP BY label), n AS (SELECT count(*) AS n FROM m) SELECT l.label, f.df, f.root_df, l.memory_id FROM l JOIN f USING (label), n WHERE f.df <= greatest(3, n / 20)")
def label_index(spark, d):
    """The postings (label, note) with the frequencies of each label, of labels in at most a twentieth of the notes."""
    m = current(spark, d)
    each = m.select("memory_id", "root", F.explode(label_list(F.col("labels"))).alias("label"))
    n = F.broadcast(m.agg(F.count(F.lit(1)).alias("n")))
    f = each.groupBy("label", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("label").agg(F.sum("k").alias("df"), F.count(F.lit(1)).alias("root_df")).crossJoin(n).where(F.col("df") <= F.greatest(F.lit(3), F.col("n") / 20))
    return each.join(f, "label").select("label", "df", "root_df", "memory_id")


def call_words(spark, d, *keys):
    """(keys, words): the words of the target of every call."""
    c = table(spark, d, "calls").where(F.col("tool").isNotNull() & F.try_parse_json("tool_input").isNotNull())
    return c.select(*keys, F.split(F.lower(F.get_json_object("tool_input", "$.target")), "[^a-z0-9]+").alias("words"))


@query("ret10_label_match", f"WITH {CURRENT}, l AS (SELECT DISTINCT memory_id, unnest({LABELS}) AS label FROM m), n AS (SELECT count(*)::DOUBLE AS n FROM m), f AS (SELECT label, count(*) AS df FROM l GROUP BY label), q AS (SELECT DISTINCT row_id, unnest(list_filter(regexp_split_to_array(lower({TARGET}), '[^a-z0-9]+'), lambda x: x <> '')) AS label FROM calls WHERE tool IS NOT NULL AND json_valid(tool_input)), p AS (SELECT q.row_id, l.memory_id, count(*) AS shared, round(sum(ln(n / df)), 6) AS score, min(df) AS rarest FROM q JOIN l USING (label) JOIN f USING (label), n GROUP BY ALL) SELECT row_id, memory_id, shared, score, CASE WHEN shared >= 2 THEN 'pair' ELSE 'specific' END AS kind, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, memory_id) AS rank FROM p, n WHERE shared >= 2 OR rarest <= n / 50 QUALIFY rank <= 3")
def label_match(spark, d):
    """For every call the three notes whose labels its target names best: two shared labels, or one that is rare."""
    m = stored(current(spark, d).select("memory_id", label_list(F.col("labels")).alias("own")))
    n = F.broadcast(m.agg(F.count(F.lit(1)).cast("double").alias("n")))
    f = stored(m.select(F.explode("own").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("df")))
    own = labelsets.sets(m, 3)
    q = labelsets.known(call_words(spark, d, "row_id"), ["row_id"], f.select("label"))
    p = labelsets.shared(q, own).join(f, "label").crossJoin(n).groupBy("asked", "own").agg(F.count(F.lit(1)).alias("shared"), F.round(F.sum(F.log(F.col("n") / F.col("df"))), 6).alias("score"), F.min("df").alias("rarest"), F.max("n").alias("n"))
    p = p.where((F.col("shared") >= 2) | (F.col("rarest") <= F.col("n") / 50)).join(own, "own").select("asked", "shared", "score", F.inline("notes"))
    r = p.withColumn("rank", F.row_number().over(Window.partitionBy("asked").orderBy(F.col("score").desc(), "memory_id"))).where("rank <= 3")
    return q.join(r, "asked").select("row_id", "memory_id", "shared", "score", F.when(F.col("shared") >= 2, "pair").otherwise("specific").alias("kind"), "rank")


@query("agg17_status_metrics", "SELECT lower(trim(verdict)) AS status, count(*) AS jobs, count(cost) AS priced, round(sum(coalesce(cost, 0)), 6) AS cost, sum(prompt_tokens)::BIGINT AS prompt_tokens, count(*) FILTER (survivor IS NULL) AS no_survivor, max(judged_at) AS last_at FROM (SELECT DISTINCT * FROM verdicts) GROUP BY 1")
def status_metrics(spark, d):
    v = table(spark, d, "verdicts").distinct()
    return v.groupBy(F.lower(F.trim("verdict")).alias("status")).agg(F.count(F.lit(1)).alias("jobs"), F.count("cost").alias("priced"), F.round(F.sum(F.coalesce("cost", F.lit(0.0))), 6).alias("cost"), F.sum("prompt_tokens").alias("prompt_tokens"), F.count_if(F.col("survivor").isNull()).alias("no_survivor"), F.max("judged_at").alias("last_at"))


@query("agg18_outages", "WITH x AS (SELECT user_id, ts, event_type = 'error' AS bad, lag(event_type = 'error') OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS before FROM events) SELECT user_id, count(*) FILTER (bad AND coalesce(NOT before, true)) AS outages, min(ts) FILTER (bad) AS first_at, max(ts) FILTER (bad) AS last_at FROM x GROUP BY user_id HAVING count(*) FILTER (bad) > 0")
def outages(spark, d):
    """Runs of errors of a provider, counted within a day, with the first and last error."""
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    bad = F.col("event_type") == "error"
    x = table(spark, d, "events").select("user_id", "ts", bad.alias("bad"), F.lag(bad).over(w).alias("before"))
    g = x.groupBy("user_id").agg(F.count_if(F.col("bad") & ~F.coalesce("before", F.lit(False))).alias("outages"), F.min(F.when(F.col("bad"), F.col("ts"))).alias("first_at"), F.max(F.when(F.col("bad"), F.col("ts"))).alias("last_at"))
    return g.where("last_at is not null")


@query("agg19_batch_report", f"WITH {ONE}, j AS (SELECT transcript, line_no, coalesce(length(text), 0) + coalesce(length(prompt), 0) AS chars, unnest([line_no // 20, (line_no + 5) // 20]) AS job, unnest([0, 1]) AS late FROM c), u AS (SELECT transcript, job, line_no, max(chars) AS chars, count(*) AS times FROM j GROUP BY ALL) SELECT transcript, count(DISTINCT job) AS jobs, sum(chars)::BIGINT AS chars, sum(chars) FILTER (times > 1)::BIGINT AS overlap_chars, count(DISTINCT line_no) AS lines FROM u GROUP BY transcript")
def batch_report(spark, d):
    """Characters of the jobs of a transcript and how much of them two ranges share."""
    size = F.coalesce(F.length("text"), F.lit(0)) + F.coalesce(F.length("prompt"), F.lit(0))
    cell = lambda x: F.floor(x / 20)
    j = _calls(spark, d).select("transcript", "line_no", size.alias("chars"), F.explode(F.array(cell(F.col("line_no")), cell(F.col("line_no") + 5))).alias("job"))
    u = j.groupBy("transcript", "job", "line_no").agg(F.max("chars").alias("chars"), F.count(F.lit(1)).alias("times"))
    return u.groupBy("transcript").agg(F.countDistinct("job").alias("jobs"), F.sum("chars").cast("bigint").alias("chars"), F.sum(F.when(F.col("times") > 1, F.col("chars"))).cast("bigint").alias("overlap_chars"), F.countDistinct("line_no").alias("lines"))


@query("agg20_coverage", f"WITH {CURRENT}, c AS (SELECT parent_id, count(DISTINCT chunk_index) AS parts, min(chunk_index) AS low, max(chunk_index) AS high FROM memory_chunks GROUP BY parent_id) SELECT CASE WHEN parts IS NULL THEN 'whole' WHEN low = 0 AND parts = high + 1 THEN 'complete' ELSE 'partial' END AS status, count(*) AS notes, sum(coalesce(parts, 1))::BIGINT AS parts FROM m LEFT JOIN c ON c.parent_id = m.memory_id GROUP BY 1")
def coverage(spark, d):
    """Notes whose chunks are complete, partial, or that have none."""
    c = table(spark, d, "memory_chunks").groupBy(F.col("parent_id").alias("memory_id")).agg(F.countDistinct("chunk_index").alias("parts"), F.min("chunk_index").alias("low"), F.max("chunk_index").alias("high"))
    x = current(spark, d).select("memory_id").join(c, "memory_id", "left")
    status = F.when(F.col("parts").isNull(), "whole").when((F.col("low") == 0) & (F.col("parts") == F.col("high") + 1), "complete").otherwise("partial")
    return x.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("notes"), F.sum(F.coalesce("parts", F.lit(1))).alias("parts"))


@query("agg21_char_ratio", "WITH v AS (SELECT memory_id, rev, max(length(coalesce(body, ''))) AS n FROM memories GROUP BY ALL), f AS (SELECT memory_id, arg_min(n, rev) AS a, arg_max(n, rev) AS b, count(*) AS k FROM v GROUP BY memory_id) SELECT k AS revisions, count(*) AS notes, sum(a)::BIGINT AS first_chars, sum(b)::BIGINT AS last_chars, round(sum(b)::DOUBLE / nullif(sum(a), 0), 6) AS ratio FROM f GROUP BY k")
def char_ratio(spark, d):
    """Growth of notes from the first to the last revision, as a ratio of sums."""
    v = table(spark, d, "memories").groupBy("memory_id", "rev").agg(F.max(F.length(F.coalesce("body", F.lit("")))).alias("n"))
    f = v.groupBy("memory_id").agg(F.min_by("n", "rev").alias("a"), F.max_by("n", "rev").alias("b"), F.count(F.lit(1)).alias("revisions"))
    return f.groupBy("revisions").agg(F.count(F.lit(1)).alias("notes"), F.sum("a").alias("first_chars"), F.sum("b").alias("last_chars"), F.round(F.try_divide(F.sum("b"), F.sum("a")), 6).alias("ratio"))


@query("agg23_arm_delivery", f"WITH {EV}, g AS (SELECT session, note, bool_or(kind = 'recall') AS shown, bool_or(kind = 'use') AS good, bool_or(kind = 'contradiction') AS bad, CASE WHEN note % 2 = 0 THEN 'even' ELSE 'odd' END AS arm FROM e GROUP BY session, note), s AS (SELECT arm, session, bool_or(shown AND good) AS delivered, bool_or(good) AS wanted, count(*) FILTER (shown) AS rows, count(*) FILTER (shown AND good) AS right_rows, bool_or(shown AND bad) AS false_one FROM g GROUP BY ALL) SELECT arm, count(*) AS sessions, round(count(*) FILTER (delivered)::DOUBLE / nullif(count(*) FILTER (wanted), 0), 6) AS delivery, round(sum(right_rows)::DOUBLE / nullif(sum(rows), 0), 6) AS precision, round(count(*) FILTER (false_one)::DOUBLE / count(*), 6) AS false_delivery FROM s GROUP BY arm")
def arm_delivery(spark, d):
    """Delivery, precision and false delivery of two arms (notes with an even and an odd number), by session."""
    kind = lambda k: F.max(F.col("kind") == k)
    g = events(spark, d).groupBy("session", "note").agg(kind("recall").alias("shown"), kind("use").alias("good"), kind("contradiction").alias("bad")).withColumn("arm", F.when(F.col("note") % 2 == 0, "even").otherwise("odd"))
    both = F.col("shown") & F.col("good")
    s = g.groupBy("arm", "session").agg(F.max(both).alias("delivered"), F.max("good").alias("wanted"), F.count_if("shown").alias("rows"), F.count_if(both).alias("right"), F.max(F.col("shown") & F.col("bad")).alias("false_one"))
    n = F.count(F.lit(1))
    return s.groupBy("arm").agg(n.alias("sessions"), F.round(F.try_divide(F.count_if("delivered"), F.count_if("wanted")), 6).alias("delivery"), F.round(F.try_divide(F.sum("right"), F.sum("rows")), 6).alias("precision"), F.round(F.count_if("false_one") / n, 6).alias("false_delivery"))


@query("agg26_label_concentration", f"WITH {CURRENT}, v AS (SELECT DISTINCT memory_a AS memory_id, memory_b FROM verdicts WHERE upper(trim(verdict)) IN ('MERGE', 'RELATED')), l AS (SELECT DISTINCT v.memory_id, memory_b, label FROM v JOIN (SELECT memory_id, unnest({LABELS}) AS label FROM m) USING (memory_id)) SELECT label, count(*) AS pairs, count(DISTINCT memory_id) AS notes, round(count(*)::DOUBLE / (SELECT count(*) FROM v), 6) AS share FROM l GROUP BY label")
def label_concentration(spark, d):
    """How the relevant pairs spread over the labels of their first note."""
    v = table(spark, d, "verdicts").where(F.upper(F.trim("verdict")).isin("MERGE", "RELATED")).select(F.col("memory_a").alias("memory_id"), "memory_b").distinct()
    total = F.broadcast(v.agg(F.count(F.lit(1)).alias("total")))
    l = v.join(current(spark, d).select("memory_id", F.explode(label_list(F.col("labels"))).alias("label")), "memory_id").distinct()
    return l.groupBy("label").agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("memory_id").alias("notes")).crossJoin(total).select("label", "pairs", "notes", F.round(F.col("pairs") / F.col("total"), 6).alias("share"))


@query("set01_unions", "WITH a AS (SELECT memory_id AS id FROM memories UNION SELECT parent_id FROM memory_chunks UNION SELECT memory_id FROM counts), b AS (SELECT memory_id AS id FROM memories UNION ALL SELECT parent_id FROM memory_chunks UNION ALL SELECT memory_id FROM counts) SELECT (SELECT count(*) FROM a) AS distinct_ids, (SELECT count(*) FROM b) AS all_ids")
def unions(spark, d):
    """Ids of three tables, distinct and with repetitions."""
    b = table(spark, d, "memories").select(F.col("memory_id").alias("id")).unionAll(table(spark, d, "memory_chunks").select("parent_id")).unionAll(table(spark, d, "counts").select("memory_id"))
    n = b.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("distinct_ids"), F.sum("n").alias("all_ids"))


@query("set03_shared_labels", f"WITH {CURRENT}, l AS (SELECT memory_id, {LABELS} AS l FROM m), v AS (SELECT DISTINCT least(memory_a, memory_b) AS a, greatest(memory_a, memory_b) AS b FROM verdicts) SELECT v.a, v.b, list_sort(list_intersect(x.l, y.l)) AS shared FROM v JOIN l x ON x.memory_id = v.a JOIN l y ON y.memory_id = v.b WHERE len(list_intersect(x.l, y.l)) BETWEEN 1 AND 3")
def shared_labels(spark, d):
    """Judged pairs that share one to three labels."""
    l = current(spark, d).select("memory_id", label_list(F.col("labels")).alias("l"))
    v = table(spark, d, "verdicts").select(F.least("memory_a", "memory_b").alias("a"), F.greatest("memory_a", "memory_b").alias("b")).distinct()
    x = v.join(l.toDF("a", "la"), "a").join(l.toDF("b", "lb"), "b").select("a", "b", F.array_sort(F.array_intersect("la", "lb")).alias("shared"))
    return x.where(F.size("shared").between(1, 3))


@query("set04_missing_roots", "SELECT root, max(i) AS in_memories, max(o) AS in_documents FROM (SELECT DISTINCT root, true AS i, false AS o FROM memories UNION ALL SELECT DISTINCT root, false, true FROM documents) GROUP BY root HAVING NOT (bool_or(i) AND bool_or(o))")
def missing_roots(spark, d):
    """Roots that only one of two collections has."""
    a, b = (table(spark, d, n).select("root").distinct().withColumns({"i": F.lit(n == "memories"), "o": F.lit(n == "documents")}) for n in ("memories", "documents"))
    return a.unionByName(b).groupBy("root").agg(F.max("i").alias("in_memories"), F.max("o").alias("in_documents")).where("not (in_memories and in_documents)")


@query("set05_pool_additions", f"WITH {CURRENT}, a AS (SELECT DISTINCT memory_a AS memory_id FROM verdicts UNION SELECT DISTINCT memory_b FROM verdicts) SELECT memory_id FROM k JOIN m USING (memory_id) WHERE k.use_pos > 0 AND memory_id NOT IN (SELECT memory_id FROM a)".replace("WITH ", f"WITH {COUNTS}, "))
def pool_additions(spark, d):
    """Notes in use that no judge has seen yet."""
    seen = table(spark, d, "verdicts").select(F.explode(F.array("memory_a", "memory_b")).alias("memory_id"))
    return counts(spark, d).where("use_pos > 0").select("memory_id").join(current(spark, d).select("memory_id"), "memory_id", "left_semi").join(seen, "memory_id", "left_anti")


@query("dat02_trailing_days", "WITH x AS (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1), e AS (SELECT max(day) AS last_day FROM x) SELECT day, n, sum(n) OVER (ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)::BIGINT AS week, (last_day - day)::BIGINT AS age_days FROM x, e")
def trailing_days(spark, d):
    """Daily counts with the inclusive trailing week and the age in whole days; the window runs over days, not rows."""
    x = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    n = F.datediff("day", F.lit("1970-01-01").cast("date"))
    return x.select("day", "n", F.sum("n").over(Window.orderBy(n).rangeBetween(-6, 0)).alias("week"), F.datediff(F.max("day").over(Window.partitionBy()), "day").cast("bigint").alias("age_days"))


@query("dat03_night_window", "SELECT event_type, count(*) FILTER (h >= 1320 OR h < 360) AS open, count(*) FILTER (NOT (h >= 1320 OR h < 360)) AS closed, max(CASE WHEN h >= 1320 OR h < 360 THEN 0 ELSE 1320 - h END)::BIGINT AS longest_wait FROM (SELECT event_type, (hour(ts) * 60 + minute(ts)) AS h FROM events) GROUP BY event_type")
def night_window(spark, d):
    """Whether a window from 22:00 to 06:00, over midnight, is open, and the longest wait for it in minutes."""
    h = F.hour("ts") * 60 + F.minute("ts")
    x = table(spark, d, "events").select("event_type", h.alias("h"), ((h >= 1320) | (h < 360)).alias("open"))
    return x.groupBy("event_type").agg(F.count_if("open").alias("open"), F.count_if(~F.col("open")).alias("closed"), F.max(F.when(F.col("open"), 0).otherwise(1320 - F.col("h"))).cast("bigint").alias("longest_wait"))


@query("mth12_token_cost", "SELECT run_id, count(*) AS pairs, sum(ceil(length(coalesce(reason, '')) / 4.0))::BIGINT AS reason_tokens, round(sum(prompt_tokens) * 3.0 / 1000000 + sum(completion_tokens) * 15.0 / 1000000, 6) AS price FROM (SELECT DISTINCT * FROM verdicts) GROUP BY run_id")
def token_cost(spark, d):
    """Tokens as a quarter of the characters, and a price a million tokens."""
    v = table(spark, d, "verdicts").distinct()
    return v.groupBy("run_id").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.ceil(F.length(F.coalesce("reason", F.lit(""))) / 4.0)).alias("reason_tokens"), F.round(F.sum("prompt_tokens") * 3.0 / 1000000 + F.sum("completion_tokens") * 15.0 / 1000000, 6).alias("price"))


@query("mth05_vector_check", "SELECT label, count(*) AS vectors, count(*) FILTER (abs(n - 1) > 1e-3) AS off_unit, count(*) FILTER (n = 0 OR isnan(n)) AS rejected, round(min(n), 4) AS least, round(max(n), 4) AS most FROM (SELECT label, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings) GROUP BY label")
def vector_check(spark, d):
    """Norms of vectors; a zero or a NaN is rejected."""
    n = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    x = table(spark, d, "embeddings").select("label", n.alias("n"))
    return x.groupBy("label").agg(F.count(F.lit(1)).alias("vectors"), F.count_if(F.abs(F.col("n") - 1) > 1e-3).alias("off_unit"), F.count_if((F.col("n") == 0) | F.isnan("n")).alias("rejected"), F.round(F.min("n"), 4).alias("least"), F.round(F.max("n"), 4).alias("most"))


@query("top02_pair_order", "WITH v AS (SELECT least(memory_a, memory_b) AS a, greatest(memory_a, memory_b) AS b, root, max(round(cosine, 4)) AS cosine FROM verdicts WHERE cosine IS NOT NULL GROUP BY ALL) SELECT a, b, root, cosine, row_number() OVER (PARTITION BY root ORDER BY cosine DESC, a, b) AS place FROM v QUALIFY place <= 50")
def pair_order(spark, d):
    """The first fifty pairs of each root in their one order (a report)."""
    v = table(spark, d, "verdicts").where("cosine is not null").groupBy(F.least("memory_a", "memory_b").alias("a"), F.greatest("memory_a", "memory_b").alias("b"), "root").agg(F.max(F.round("cosine", 4)).alias("cosine"))
    return v.withColumn("place", F.row_number().over(Window.partitionBy("root").orderBy(F.col("cosine").desc(), "a", "b"))).where("place <= 50")


@query("top08_best_chunk", f"WITH c AS (SELECT parent_id, chunk_index, {TOK.format('search_text')} AS w FROM (SELECT *, row_number() OVER (PARTITION BY parent_id, chunk_index ORDER BY rev DESC, chunk_id DESC) AS n FROM memory_chunks) WHERE n = 1), {CURRENT}, q AS (SELECT memory_id AS parent_id, list_filter(list_distinct({TOK.format('description')}), lambda t: t NOT IN ({STOPS})) AS t FROM m) SELECT parent_id, arg_max(chunk_index, (len(list_intersect(w, t)), -chunk_index)) AS best, max(len(list_intersect(w, t))) AS hits FROM c JOIN q USING (parent_id) GROUP BY parent_id")
def best_chunk(spark, d):
    """The chunk of each note that holds most words of its description, the first of equals."""
    chunks = tables.newest(table(spark, d, "memory_chunks").select("parent_id", "chunk_index", "chunk_id", "search_text", "rev"), ["parent_id", "chunk_index"], ["rev", "chunk_id"]).select("parent_id", "chunk_index", tokens("search_text").alias("w"))
    q = current(spark, d).select(F.col("memory_id").alias("parent_id"), F.filter(F.array_distinct(tokens("description")), lambda t: ~t.isin(*STOP_WORDS)).alias("t"))
    x = chunks.join(q, "parent_id").select("parent_id", "chunk_index", F.size(F.array_intersect("w", "t")).cast("bigint").alias("hits"))
    return x.groupBy("parent_id").agg(F.max_by("chunk_index", F.struct("hits", -F.col("chunk_index"))).alias("best"), F.max("hits").alias("hits"))


@query("top10_section_quota", f"WITH {CURRENT}, s AS (SELECT root, memory_id, CASE WHEN pinned THEN 'pinned' WHEN lower(trim(category)) = 'feedback' THEN 'feedback' ELSE 'other' END AS section, updated_at FROM m WHERE archived_at IS NULL AND deleted_at IS NULL) SELECT root, section, memory_id, row_number() OVER (PARTITION BY root, section ORDER BY updated_at DESC, memory_id) AS place FROM s QUALIFY place <= CASE section WHEN 'pinned' THEN 5 WHEN 'feedback' THEN 3 ELSE 2 END")
def section_quota(spark, d):
    """The newest notes of each section of a root up to its quota."""
    m = current(spark, d).where(tables.live())
    section = F.when(F.col("pinned"), "pinned").when(F.lower(F.trim("category")) == "feedback", "feedback").otherwise("other")
    s = m.select("root", section.alias("section"), "memory_id", "updated_at")
    s = s.withColumn("place", F.row_number().over(Window.partitionBy("root", "section").orderBy(F.col("updated_at").desc(), "memory_id"))).where("place <= 5")
    return s.where(F.col("place") <= F.when(F.col("section") == "pinned", 5).when(F.col("section") == "feedback", 3).otherwise(2)).select("root", "section", "memory_id", "place")


@query("top06_balanced_seats", f"WITH {CURRENT}, q AS (SELECT memory_id AS query, unnest(list_filter(list_distinct({TOK.format('description')}), lambda t: t NOT IN ({STOPS}))) AS t FROM m WHERE memory_id % 100 = 0), w AS (SELECT memory_id AS id, unnest(list_distinct({TOK.format('description')})) AS t FROM m), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS r FROM (SELECT query, id, count(*)::DOUBLE AS s FROM q JOIN w USING (t) GROUP BY ALL) QUALIFY r <= 8), c AS (SELECT p.vec_id AS query, e.vec_id AS id, row_number() OVER (PARTITION BY p.vec_id ORDER BY round(list_sum(list_transform(list_zip(e.embedding, p.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 4) DESC, e.vec_id) AS r FROM embeddings p, embeddings e WHERE p.vec_id % 100 = 0 QUALIFY r <= 8), s AS (SELECT query, id, CASE WHEN r <= 2 THEN 0 ELSE 2 END AS seat, r FROM k UNION ALL SELECT query, id, 1, r FROM c), b AS (SELECT query, id, min(seat * 100 + r) AS p FROM s GROUP BY ALL) SELECT * FROM (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY p, id) AS seat FROM b) WHERE seat <= 8")
def balanced_seats(spark, d):
    """Eight seats a query: two by shared words, the rest by cosine, left ones by words again."""
    from quern.operators import ranking

    m = current(spark, d)
    q = m.where("memory_id % 100 = 0").select(F.col("memory_id").alias("query"), F.explode(F.filter(F.array_distinct(tokens("description")), lambda t: ~t.isin(*STOP_WORDS))).alias("t"))
    w = m.select(F.col("memory_id").alias("id"), F.explode(F.array_distinct(tokens("description"))).alias("t"))
    words = ranking.top_each(q.join(w, "t").groupBy("query", "id").agg(F.count(F.lit(1)).cast("double").alias("score")), 8)
    v = table(spark, d, "embeddings")
    near = ranking.top_each(ranking.cosine_each(v, "vec_id", "embedding", v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q")), 8), 8)
    s = words.select("query", "id", (F.when(F.col("rank") <= 2, 0).otherwise(200) + F.col("rank")).alias("p")).unionByName(near.select("query", "id", (100 + F.col("rank")).alias("p")))
    b = s.groupBy("query", "id").agg(F.min("p").alias("p"))
    return b.withColumn("seat", F.row_number().over(Window.partitionBy("query").orderBy("p", "id"))).where("seat <= 8").select("query", "id", "seat")


@query("top07_due_jobs", "WITH x AS (SELECT user_id, event_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id) AS blocked FROM events WHERE event_type IN ('view', 'purchase') AND ts <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)) SELECT user_id, event_id, ts FROM x WHERE place = 1 AND blocked < 100000")
def due_jobs(spark, d):
    """The oldest due job of each owner; an aggregate, no sort."""
    x = table(spark, d, "events")
    end = F.broadcast(x.agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("end")))
    x = x.where(F.col("event_type").isin("view", "purchase")).crossJoin(end).where("ts <= end")
    r = x.groupBy("user_id").agg(F.min_by(F.struct("event_id", "ts"), F.struct("ts", "event_id")).alias("r"), F.count_if(F.col("event_type") == "purchase").alias("blocked"))
    return r.where("blocked < 100000").select("user_id", "r.*")


@query("sup20_calibrated_rate", f"WITH x AS (SELECT event_type, count(*)::DOUBLE AS n, count(*) FILTER (value > 80) / count(*)::DOUBLE AS p FROM events GROUP BY event_type) SELECT event_type, round(0.1 + 0.6 * p, 6) AS rate, round(0.1 + 0.6 * greatest(0, {WILSON.format('-')}), 6) AS low, round(0.1 + 0.6 * least(1, {WILSON.format('+')}), 6) AS high FROM x")
def calibrated_rate(spark, d):
    """A rate mapped between two known ends, with its interval scaled in the same way."""
    x = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 80).alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    to = lambda c: F.round(0.1 + 0.6 * c, 6)
    return x.select("event_type", to(F.col("k") / F.col("n")).alias("rate"), to(low).alias("low"), to(high).alias("high"))
