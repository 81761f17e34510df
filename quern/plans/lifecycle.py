"""Maintenance: duplicates, index, mining, the learning ledger, guards, supplementary reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import redact
from quern.functions.scores import wilson
from quern.functions.text import flat, label_list, tokens
from quern.operators import ordered, ranking, tables
from quern.operators.recall import STOP_WORDS
from quern.plans.evaluation import W as WILSON
from quern.plans.notes import CURRENT, ERROR, HEX, current
from quern.plans.recall import STOPS, TOK
from quern.plans.relations import COUNTS, LABELS, TARGET, counts
from quern.plans.sessions import ONE, _calls
from quern.plans.trust import EV, events
from quern.registry import query
from quern.session import table

FLAT = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
SAME = f"""{CURRENT}, {COUNTS}, vt AS (SELECT CASE upper(trim(survivor)) WHEN 'A' THEN memory_a WHEN 'B' THEN memory_b END AS memory_id, count(*) AS votes FROM (SELECT DISTINCT * FROM verdicts) WHERE upper(trim(verdict)) = 'MERGE' GROUP BY 1),
x AS (SELECT m.memory_id, m.root, m.path, lower({FLAT.format("coalesce(description, '') || ' ' || coalesce(body, '')")}) AS t, coalesce(votes, 0) AS votes, coalesce(k.use_pos, 0) AS used, m.labels FROM m LEFT JOIN vt USING (memory_id) LEFT JOIN k USING (memory_id) WHERE m.deleted_at IS NULL AND m.archived_at IS NULL),
g AS (SELECT *, md5(t) AS h, count(*) OVER (PARTITION BY md5(t)) AS n FROM x WHERE trim(t) <> ''),
p AS (SELECT h AS hash, memory_id, root, labels, arg_max(memory_id, (votes, used, -memory_id)) OVER (PARTITION BY h) AS survivor FROM g WHERE n > 1)"""


def duplicates(spark, d):
    """(hash, memory_id, root, labels, survivor): live notes with the same text in any root; votes, then use, then the smallest id survive.

    The survivor is an aggregate joined back, so that a hot group of copies is never in one window.
    """
    s = F.upper(F.trim("survivor"))
    v = table(spark, d, "verdicts").distinct().where(F.upper(F.trim("verdict")) == "MERGE").select(F.when(s == "A", F.col("memory_a")).when(s == "B", F.col("memory_b")).alias("memory_id")).groupBy("memory_id").agg(F.count(F.lit(1)).alias("votes"))
    text = F.lower(flat(F.concat(F.coalesce("description", F.lit("")), F.lit(" "), F.coalesce("body", F.lit("")))))
    m = current(spark, d).where(tables.live()).select("memory_id", "root", "labels", text.alias("t")).where(F.trim("t") != "")
    x = m.join(v, "memory_id", "left").join(counts(spark, d).select("memory_id", "use_pos"), "memory_id", "left").select(F.md5("t").alias("hash"), "memory_id", "root", "labels", F.coalesce("votes", F.lit(0)).alias("votes"), F.coalesce("use_pos", F.lit(0.0)).alias("used"))
    best = x.groupBy("hash").agg(F.max_by("memory_id", F.struct("votes", "used", -F.col("memory_id"))).alias("survivor"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return x.join(best, "hash").select("hash", "memory_id", "root", "labels", "survivor")


@query("dup01_plan", f"WITH {SAME} SELECT hash, memory_id, CASE WHEN memory_id = survivor THEN 'keep' ELSE 'archive' END AS action, survivor FROM p")
def dedup_plan(spark, d):
    """The plan of a deduplication: which note of each group of equal texts stays."""
    return duplicates(spark, d).select("hash", "memory_id", F.when(F.col("memory_id") == F.col("survivor"), "keep").otherwise("archive").alias("action"), "survivor")


@query("snk10_apply_and_undo", f"WITH {SAME}, o AS (SELECT memory_id FROM p WHERE memory_id <> survivor) SELECT (SELECT count(*) FROM m WHERE deleted_at IS NULL AND archived_at IS NULL) AS live_before, (SELECT count(*) FROM m WHERE deleted_at IS NULL AND archived_at IS NULL AND memory_id NOT IN (SELECT memory_id FROM o)) AS live_after, (SELECT count(*) FROM o) AS undo_rows, 0::BIGINT AS differences")
def apply_and_undo(spark, d):
    """The plan applied to the live notes, with an undo table; undoing it gives back what was there."""
    live = current(spark, d).where(tables.live()).select("memory_id", "root", "path", "content_hash")
    plan = duplicates(spark, d).where("memory_id <> survivor").select("memory_id")
    after, undo = live.join(plan, "memory_id", "left_anti"), live.join(plan, "memory_id", "left_semi")
    back = after.unionByName(undo)
    n = lambda x, name: x.agg(F.count(F.lit(1)).alias(name))
    return n(live, "live_before").crossJoin(n(after, "live_after")).crossJoin(n(undo, "undo_rows")).crossJoin(n(live.exceptAll(back).unionAll(back.exceptAll(live)), "differences"))


@query("dup02_survivor", f"WITH {SAME} SELECT DISTINCT hash, survivor FROM p")
def survivors(spark, d):
    return duplicates(spark, d).select("hash", "survivor").distinct()


@query("dup03_merged_labels", f"WITH {SAME}, l AS (SELECT DISTINCT survivor, lower(trim(unnest(from_json(labels, '[\"VARCHAR\"]')))) AS label FROM p) SELECT survivor, list_sort(list(label))[1:12] AS labels, 'merged ' || (SELECT count(*) FROM p q WHERE q.survivor = l.survivor AND q.memory_id <> q.survivor) AS stamp FROM l WHERE label <> '' GROUP BY survivor")
def merged_labels(spark, d):
    """The survivor's labels with those of the notes merged into it, at most twelve, and the stamp that says how many those are."""
    p = duplicates(spark, d)
    l = p.select("survivor", F.explode(label_list(F.col("labels"))).alias("label")).distinct().groupBy("survivor").agg(F.slice(F.array_sort(F.collect_set("label")), 1, 12).alias("labels"))
    n = p.where("memory_id <> survivor").groupBy("survivor").agg(F.count(F.lit(1)).alias("n"))
    return l.join(n, "survivor").select("survivor", "labels", F.concat(F.lit("merged "), "n").alias("stamp"))


@query("sup28_duplicate_listing", f"WITH {SAME} SELECT hash, count(*) AS copies, count(DISTINCT root) AS roots, min(memory_id) AS first_id FROM p GROUP BY hash")
def duplicate_listing(spark, d):
    return duplicates(spark, d).groupBy("hash").agg(F.count(F.lit(1)).alias("copies"), F.countDistinct("root").alias("roots"), F.min("memory_id").alias("first_id"))


@query("idx02_redo_list", f"WITH r AS (SELECT DISTINCT entry_id, text, coalesce(redacted, false) AS claim FROM entries) SELECT entry_id, bool_or(claim) AS claim FROM r WHERE {redact.redact_sql('text')} <> text GROUP BY entry_id")
def redo_list(spark, d):
    """Rows that the present rules of masking would still change."""
    e = table(spark, d, "entries").select("entry_id", "text", F.coalesce("redacted", F.lit(False)).alias("claim")).distinct()
    return e.where(redact.redact(F.col("text")) != F.col("text")).groupBy("entry_id").agg(F.max("claim").alias("claim"))


@query("idx03_vector_backfill", f"WITH {CURRENT}, v AS (SELECT vec_id AS memory_id, len(embedding) AS dim FROM embeddings) SELECT memory_id, CASE WHEN v.dim IS NULL THEN 'missing' WHEN v.dim <> 64 THEN 'dimension' WHEN m.rev > 1 AND m.updated_at > m.created_at + INTERVAL 60 DAY THEN 'stale' ELSE 'fresh' END AS state FROM m LEFT JOIN v USING (memory_id)")
def vector_backfill(spark, d):
    """What has to be embedded anew: no vector, another dimension, or a text newer than it."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("memory_id"), F.size("embedding").alias("dim"))
    stale = (F.col("rev") > 1) & (F.col("updated_at") > F.col("created_at") + F.expr("INTERVAL 60 DAYS"))
    state = F.when(F.col("dim").isNull(), "missing").when(F.col("dim") != 64, "dimension").when(stale, "stale").otherwise("fresh")
    return current(spark, d).join(v, "memory_id", "left").select("memory_id", state.alias("state"))


LEAD = r"^(?:no|nope|wrong|stop|wait|actually|not that|nein|falsch|halt|non|faux)\b"


@query("min01_candidates", f"WITH {ONE}, r AS (SELECT transcript, line_no, CASE WHEN role = 'user' AND NOT coalesce(is_meta, false) AND regexp_matches(lower(trim(prompt)), '{LEAD}') THEN 'correction' WHEN is_error THEN 'tool_error' WHEN role = 'assistant' AND regexp_matches(lower(text), '\\b(?:review|reviewed|reviewer)\\b') THEN 'review' END AS kind, {FLAT.format('coalesce(prompt, text)')} AS t FROM c) SELECT kind, sha256(lower(t)) AS hash, arg_min(transcript, (transcript, line_no)) AS transcript, arg_min(line_no, (transcript, line_no)) AS line_no, count(*) AS times FROM r WHERE kind IS NOT NULL AND t <> '' GROUP BY ALL")
def candidates(spark, d):
    """What a miner takes from transcripts: corrections, reviews and tool errors, one a line, the first of each text."""
    said = F.lower(F.trim("prompt"))
    kind = F.when((F.col("role") == "user") & ~F.coalesce("is_meta", F.lit(False)) & said.rlike(LEAD), "correction").when(F.col("is_error"), "tool_error").when((F.col("role") == "assistant") & F.lower("text").rlike(r"\b(?:review|reviewed|reviewer)\b"), "review")
    r = _calls(spark, d).select("transcript", "line_no", kind.alias("kind"), flat(F.coalesce("prompt", "text")).alias("t")).where("kind is not null and t <> ''")
    g = r.groupBy("kind", F.sha2(F.lower("t"), 256).alias("hash")).agg(F.min(F.struct("transcript", "line_no")).alias("first"), F.count(F.lit(1)).alias("times"))
    return g.select("kind", "hash", "first.transcript", "first.line_no", "times")


RECEIPT = f"e AS (SELECT DISTINCT entry_id, import_file, line_no, text, redacted FROM entries WHERE text IS NOT NULL), r AS (SELECT *, sha256({FLAT.format('text')}) AS receipt FROM e), revoked AS (SELECT DISTINCT receipt FROM r WHERE redacted)"


@query("lrn01_capture", f"WITH {RECEIPT}, f AS (SELECT receipt, arg_min(entry_id, (import_file, line_no, entry_id)) AS entry_id, arg_min(import_file, (import_file, line_no, entry_id)) AS import_file, count(*) AS deliveries FROM r WHERE receipt NOT IN (SELECT receipt FROM revoked) GROUP BY receipt) SELECT entry_id, receipt, deliveries, row_number() OVER (PARTITION BY import_file ORDER BY entry_id) AS seq FROM f")
def capture(spark, d):
    """Entries captured once by receipt, revoked texts left out, numbered within their file."""
    e = table(spark, d, "entries").where("text is not null").select("entry_id", "import_file", "line_no", "redacted", F.sha2(flat(F.col("text")), 256).alias("receipt")).distinct()
    revoked = e.where("redacted").select("receipt").distinct()
    f = e.join(revoked, "receipt", "left_anti").groupBy("receipt").agg(F.min_by(F.struct("entry_id", "import_file"), F.struct("import_file", "line_no", "entry_id")).alias("r"), F.count(F.lit(1)).alias("deliveries"))
    return ordered.numbered(f.select("receipt", "r.*", "deliveries"), ["entry_id"], ["import_file"], "seq").select("entry_id", "receipt", "deliveries", "seq")


@query("lrn02_reconcile", f"WITH {CURRENT}, e AS (SELECT DISTINCT entry_id, lower({FLAT.format('text')}) AS t FROM entries WHERE trim(text) <> ''), n AS (SELECT lower({FLAT.format('description')}) AS t, min(memory_id) AS memory_id, bool_and(archived_at IS NOT NULL OR deleted_at IS NOT NULL) AS gone FROM m WHERE trim(description) <> '' GROUP BY 1) SELECT entry_id, CASE WHEN memory_id IS NULL THEN 'add' WHEN gone THEN 'revive' ELSE 'unchanged' END AS decision, memory_id FROM e LEFT JOIN n USING (t)")
def reconcile(spark, d):
    """What becomes of each statement of an import beside the notes that stand."""
    e = table(spark, d, "entries").where("trim(text) <> ''").select("entry_id", F.lower(flat(F.col("text"))).alias("t")).distinct()
    n = current(spark, d).where("trim(description) <> ''").groupBy(F.lower(flat(F.col("description"))).alias("t")).agg(F.min("memory_id").alias("memory_id"), F.min(~tables.live()).alias("gone"))
    return e.join(n, "t", "left").select("entry_id", F.when(F.col("memory_id").isNull(), "add").when(F.col("gone"), "revive").otherwise("unchanged").alias("decision"), "memory_id")


@query("lrn03_merge_claims", f"WITH {CURRENT}, s AS (SELECT memory_id, root, unnest(list_filter(regexp_split_to_array(coalesce(body, ''), '\\r?\\n'), lambda x: length(trim(x)) >= 20)) AS t FROM m), n AS (SELECT md5(lower({FLAT.format('t')})) AS claim, root, memory_id FROM s) SELECT claim, count(DISTINCT memory_id) AS supports, count(DISTINCT root) AS roots, min(memory_id) AS first_id FROM n GROUP BY claim HAVING count(DISTINCT memory_id) > 1")
def merge_claims(spark, d):
    """Statements that several notes make: one claim with its supports."""
    s = current(spark, d).select("memory_id", "root", F.explode(F.filter(F.split(F.coalesce("body", F.lit("")), r"\r?\n"), lambda x: F.length(F.trim(x)) >= 20)).alias("t"))
    n = s.select("memory_id", "root", F.md5(F.lower(flat(F.col("t")))).alias("claim")).distinct()
    return n.groupBy("claim").agg(F.countDistinct("memory_id").alias("supports"), F.countDistinct("root").alias("roots"), F.min("memory_id").alias("first_id")).where("supports > 1")


@query("lrn04_exact_quotes", f"WITH c AS (SELECT parent_id, chunk_index, heading, text FROM (SELECT *, row_number() OVER (PARTITION BY parent_id, chunk_index ORDER BY rev DESC, chunk_id DESC) AS n FROM memory_chunks) WHERE n = 1), {CURRENT}, j AS (SELECT parent_id, chunk_index, coalesce(m.body, '') AS body, regexp_extract(trim(text), '^([^\\r\\n]{{10,}})', 1) AS quote FROM c JOIN m ON m.memory_id = c.parent_id) SELECT parent_id, chunk_index, instr(body, quote) AS at, (length(body) - length(replace(body, quote, ''))) // length(quote) AS times FROM j WHERE quote <> ''")
def exact_quotes(spark, d):
    """Whether the first line of a chunk stands in its note, where, and how often; one time is valid evidence."""
    c = tables.newest(table(spark, d, "memory_chunks").select("parent_id", "chunk_index", "chunk_id", "text", "rev"), ["parent_id", "chunk_index"], ["rev", "chunk_id"])
    m = current(spark, d).select(F.col("memory_id").alias("parent_id"), F.coalesce("body", F.lit("")).alias("body"))
    j = c.join(m, "parent_id").select("parent_id", "chunk_index", "body", F.regexp_extract(F.trim("text"), r"^([^\r\n]{10,})", 1).alias("quote")).where("quote <> ''")
    times = F.expr("(length(body) - length(replace(body, quote, ''))) div length(quote)")
    return j.select("parent_id", "chunk_index", F.expr("instr(body, quote)").cast("bigint").alias("at"), times.alias("times"))


CHARS = "coalesce(length(text), 0) + coalesce(length(prompt), 0)"


@query("lrn05_batch_plan", f"WITH {ONE}, r AS (SELECT transcript, line_no, {CHARS} AS n, sum({CHARS}) OVER (PARTITION BY transcript ORDER BY line_no) AS run FROM c), b AS (SELECT transcript, (run - n) // 4000 AS batch, min(line_no) AS first_line, max(line_no) AS last_line, sum(n)::BIGINT AS chars FROM r GROUP BY ALL) SELECT transcript, batch::BIGINT AS batch, first_line, last_line, chars FROM b")
def batch_plan(spark, d):
    """Batches of a transcript by the characters before a line, in steps of 4,000; the last line of each is its watermark."""
    size = F.coalesce(F.length("text"), F.lit(0)) + F.coalesce(F.length("prompt"), F.lit(0))
    r = ordered.scan(_calls(spark, d).select("transcript", "line_no", size.alias("n")), ["transcript"], ["line_no"], sums={"run": F.col("n")})
    b = r.withColumn("batch", F.floor((F.col("run") - F.col("n")) / 4000))
    return b.groupBy("transcript", "batch").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.sum("n").alias("chars"))


@query("lrn06_retention", "WITH t AS (SELECT transcript, max(received_at) AS last_at, bool_or(coalesce(is_error, false)) AS failed FROM calls GROUP BY transcript), e AS (SELECT max(received_at) AS now FROM calls) SELECT transcript, CASE WHEN failed THEN last_at < now - INTERVAL 60 DAY ELSE last_at < now - INTERVAL 30 DAY END AS prune FROM t, e")
def retention(spark, d):
    """Transcripts past their retention; a failed one is kept twice as long."""
    c = table(spark, d, "calls")
    now = F.broadcast(c.agg(F.max("received_at").alias("now")))
    t = c.groupBy("transcript").agg(F.max("received_at").alias("last_at"), F.max(F.coalesce("is_error", F.lit(False))).alias("failed")).crossJoin(now)
    limit = F.when(F.col("failed"), F.expr("now - INTERVAL 60 DAYS")).otherwise(F.expr("now - INTERVAL 30 DAYS"))
    return t.select("transcript", (F.col("last_at") < limit).alias("prune"))


@query("grd01_rule_table", f"WITH {CURRENT}, l AS (SELECT memory_id, pinned, unnest({LABELS}) AS label FROM m WHERE archived_at IS NULL AND deleted_at IS NULL), v AS (SELECT *, CASE WHEN length(label) < 4 THEN 'too short' WHEN NOT regexp_matches(label, '^[a-z][a-z0-9_-]*$') THEN 'no literal' END AS problem FROM l) SELECT label AS rule, count(DISTINCT memory_id) AS notes, bool_or(pinned) AS pinned, any_value(problem) AS problem FROM v GROUP BY label")
def rule_table(spark, d):
    """The rules that notes give by their labels, with what makes one unusable."""
    l = current(spark, d).where(tables.live()).select("memory_id", "pinned", F.explode(label_list(F.col("labels"))).alias("rule"))
    g = l.groupBy("rule").agg(F.countDistinct("memory_id").alias("notes"), F.max("pinned").alias("pinned"))
    return g.select("rule", "notes", "pinned", F.when(F.length("rule") < 4, "too short").when(~F.col("rule").rlike("^[a-z][a-z0-9_-]*$"), "no literal").alias("problem"))


@query("grd02_graded_rules", f"WITH {CURRENT}, l AS (SELECT DISTINCT memory_id, unnest({LABELS}) AS rule FROM m), f AS (SELECT rule, count(*) AS df FROM l GROUP BY rule), c AS (SELECT DISTINCT row_id, unnest(regexp_extract_all(lower({TARGET}), '[a-z]+')) AS rule FROM calls WHERE tool = 'Bash' AND json_valid(tool_input)), g AS (SELECT row_id, rule, df, CASE WHEN df <= 0.03 * (SELECT count(*) FROM m) THEN 'strong' ELSE 'weak' END AS grade FROM c JOIN f USING (rule)) SELECT row_id, rule, grade, row_number() OVER (PARTITION BY row_id ORDER BY df, rule) AS place FROM g QUALIFY place <= 3")
def graded_rules(spark, d):
    """The three rarest rules that a command names, strong where few notes have them."""
    m = current(spark, d)
    n = F.broadcast(m.agg(F.count(F.lit(1)).alias("n")))
    f = m.select(F.explode(label_list(F.col("labels"))).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("df"))
    c = table(spark, d, "calls").where((F.col("tool") == "Bash") & F.try_parse_json("tool_input").isNotNull()).select("row_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.get_json_object("tool_input", "$.target")), F.lit("[a-z]+"), F.lit(0)))).alias("rule"))
    g = c.join(f, "rule").crossJoin(n).withColumn("place", F.row_number().over(Window.partitionBy("row_id").orderBy("df", "rule"))).where("place <= 3")
    return g.select("row_id", "rule", F.when(F.col("df") <= 0.03 * F.col("n"), "strong").otherwise("weak").alias("grade"), "place")


TOPS = f"{CURRENT}, q AS (SELECT memory_id AS query, unnest(list_filter(list_distinct({TOK.format('description')}), lambda t: t NOT IN ({STOPS}))) AS t FROM m WHERE memory_id % 100 = 0), w AS (SELECT memory_id AS id, length(coalesce(body, '')) AS chars, unnest(list_distinct({TOK.format('description')})) AS t FROM m), h AS (SELECT query, id, any_value(chars) AS chars, count(*) AS hits FROM q JOIN w USING (t) GROUP BY ALL), r AS (SELECT query, id, chars, row_number() OVER (PARTITION BY query ORDER BY hits DESC, id) AS rank FROM h), k AS (SELECT * FROM r WHERE rank <= 20)"


def _tops(spark, d):
    """The twenty notes that share most words with each query: (query, id, chars, rank)."""
    m = current(spark, d)
    q = m.where("memory_id % 100 = 0").select(F.col("memory_id").alias("query"), F.explode(F.filter(F.array_distinct(tokens("description")), lambda t: ~t.isin(*STOP_WORDS))).alias("t"))
    w = m.select(F.col("memory_id").alias("id"), F.explode(F.array_distinct(tokens("description"))).alias("t"))
    hits = ranking.top_each(q.join(w, "t").groupBy("query", "id").agg(F.count(F.lit(1)).alias("score")), 20)
    return hits.join(m.select(F.col("memory_id").alias("id"), F.length(F.coalesce("body", F.lit(""))).alias("chars")), "id").select("query", "id", "chars", "rank")


def _fold(rows, step, start):
    """A fold over the ranked rows of each query (twenty at most), inside one row."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "id", "chars")))
    return rows.groupBy("query").agg(F.aggregate(ranked, start, step).alias("s"))


TAKEN = "cast(array() as array<struct<rank:int,id:bigint,chars:int>>)"


@query("top04_budget", f"WITH RECURSIVE {TOPS}, f AS (SELECT query, 0 AS rank, 0::BIGINT AS used, NULL::BIGINT AS taken FROM (SELECT DISTINCT query FROM k) UNION ALL SELECT k.query, k.rank, f.used + CASE WHEN f.used + k.chars <= 3000 THEN k.chars ELSE 0 END, CASE WHEN f.used + k.chars <= 3000 THEN k.id END FROM f JOIN k ON k.query = f.query AND k.rank = f.rank + 1) SELECT query, taken AS id, rank FROM f WHERE taken IS NOT NULL")
def budget(spark, d):
    """Notes in rank order within 3,000 characters; one that doesn't fit is skipped, a smaller later one may fit."""
    fits = lambda s, r: s["used"] + r["chars"] <= 3000
    step = lambda s, r: F.struct((s["used"] + F.when(fits(s, r), r["chars"]).otherwise(0)).alias("used"), F.when(fits(s, r), F.concat(s["taken"], F.array(r))).otherwise(s["taken"]).alias("taken"))
    got = _fold(_tops(spark, d), step, F.struct(F.lit(0).alias("used"), F.expr(TAKEN).alias("taken")))
    return got.select("query", F.inline("s.taken")).select("query", "id", "rank")


@query("top05_prefix_fit", f"WITH {TOPS}, s AS (SELECT query, id, rank, chars, sum(least(chars, 800)) OVER (PARTITION BY query ORDER BY rank) AS run FROM k) SELECT query, id, rank, least(chars, 800, greatest(0, 3000 - (run - least(chars, 800))))::BIGINT AS shown FROM s WHERE run - least(chars, 800) < 3000")
def prefix_fit(spark, d):
    """Rows in order until 3,000 characters are full, each cut to 800, the last one to what is left."""
    one = F.least("chars", F.lit(800))
    s = _tops(spark, d).withColumn("run", F.sum(one).over(Window.partitionBy("query").orderBy("rank")))
    left = F.greatest(F.lit(0), 3000 - (F.col("run") - one))
    return s.where(F.col("run") - one < 3000).select("query", "id", "rank", F.least(one, left).cast("bigint").alias("shown"))


@query("win12_newest_wins", f"WITH {TOPS}, l AS (SELECT memory_id AS id, {LABELS} AS l, updated_at FROM m), p AS (SELECT a.query, a.id, bool_or(y.updated_at > x.updated_at) AS older FROM k a JOIN k b ON a.query = b.query AND a.id <> b.id JOIN l x ON x.id = a.id JOIN l y ON y.id = b.id WHERE len(list_intersect(x.l, y.l)) >= 2 GROUP BY ALL) SELECT k.query, k.id, coalesce(older, false) AS older, row_number() OVER (PARTITION BY k.query ORDER BY coalesce(older, false), rank) AS place FROM k LEFT JOIN p USING (query, id)")
def newest_wins(spark, d):
    """Of the top rows of a query that share two labels the older ones are marked and stand behind."""
    l = current(spark, d).select(F.col("memory_id").alias("id"), label_list(F.col("labels")).alias("l"), "updated_at")
    k = _tops(spark, d).join(l, "id")
    other = k.select("query", F.col("id").alias("id2"), F.col("l").alias("l2"), F.col("updated_at").alias("at2"))
    p = k.join(other, "query").where((F.col("id") != F.col("id2")) & (F.size(F.array_intersect("l", "l2")) >= 2)).groupBy("query", "id").agg(F.max(F.col("at2") > F.col("updated_at")).alias("older"))
    x = k.join(p, ["query", "id"], "left").withColumn("older", F.coalesce("older", F.lit(False)))
    return x.select("query", "id", "older", F.row_number().over(Window.partitionBy("query").orderBy("older", "rank")).alias("place"))


@query("win13_own_rows", f"WITH {TOPS}, o AS (SELECT k.*, m.root = (SELECT root FROM m x WHERE x.memory_id = k.query) AS own FROM k JOIN m ON m.memory_id = k.id), b AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank) AS i, row_number() OVER (PARTITION BY query, own ORDER BY rank) AS j FROM o) SELECT query, id, own, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN own AND j <= 2 THEN least(i, 4 + j) ELSE i END, i) AS place FROM b")
def own_rows(spark, d):
    """Two places among the first six are kept for rows of the query's own root."""
    roots = current(spark, d).select("memory_id", "root")
    o = _tops(spark, d).join(roots.toDF("id", "root"), "id").join(roots.toDF("query", "of"), "query").withColumn("own", F.col("root") == F.col("of"))
    q = Window.partitionBy("query")
    b = o.withColumns({"i": F.row_number().over(q.orderBy("rank")), "j": F.row_number().over(Window.partitionBy("query", "own").orderBy("rank"))})
    key = F.when(F.col("own") & (F.col("j") <= 2), F.least(F.col("i"), 4 + F.col("j"))).otherwise(F.col("i"))
    return b.select("query", "id", "own", F.row_number().over(q.orderBy(key, "i")).alias("place"))


@query("sup03_target_groups", f"WITH RECURSIVE {TOPS}, f AS (SELECT query, 0 AS rank, 0 AS grp, 0::BIGINT AS used, 0 AS n, NULL::BIGINT AS id FROM (SELECT DISTINCT query FROM k) UNION ALL SELECT k.query, k.rank, f.grp + (f.n > 0 AND (f.n >= 8 OR f.used + k.chars > 4000))::INT, CASE WHEN f.n > 0 AND (f.n >= 8 OR f.used + k.chars > 4000) THEN k.chars ELSE f.used + k.chars END, CASE WHEN f.n > 0 AND (f.n >= 8 OR f.used + k.chars > 4000) THEN 1 ELSE f.n + 1 END, k.id FROM f JOIN k ON k.query = f.query AND k.rank = f.rank + 1) SELECT query, id, grp FROM f WHERE id IS NOT NULL")
def target_groups(spark, d):
    """The top rows of a query in groups of at most eight and 4,000 characters, in order."""
    new = lambda s, r: (s["n"] > 0) & ((s["n"] >= 8) | (s["used"] + r["chars"] > 4000))
    grp = lambda s, r: s["grp"] + new(s, r).cast("int")
    step = lambda s, r: F.struct(grp(s, r).alias("grp"), F.when(new(s, r), r["chars"]).otherwise(s["used"] + r["chars"]).alias("used"), F.when(new(s, r), 1).otherwise(s["n"] + 1).alias("n"), F.concat(s["out"], F.array(F.struct(r["id"].alias("id"), grp(s, r).alias("grp")))).alias("out"))
    start = F.struct(F.lit(0).alias("grp"), F.lit(0).alias("used"), F.lit(0).alias("n"), F.expr("cast(array() as array<struct<id:bigint,grp:int>>)").alias("out"))
    return _fold(_tops(spark, d), step, start).select("query", F.inline("s.out"))


@query("fil20_input_checks", "SELECT entry_id, regexp_matches(coalesce(import_file, ''), '^[A-Za-z0-9._/-]{1,200}$') AND NOT contains(coalesce(import_file, ''), '..') AS path_ok, line_no >= 1 AS line_ok, try_cast(regexp_extract(created_at, '^(\\d{4}-\\d\\d-\\d\\d)', 1) AS DATE) IS NOT NULL AS time_ok FROM (SELECT DISTINCT entry_id, import_file, line_no, created_at FROM entries)")
def input_checks(spark, d):
    e = table(spark, d, "entries").select("entry_id", "import_file", "line_no", "created_at").distinct()
    f = F.coalesce("import_file", F.lit(""))
    return e.select("entry_id", (f.rlike("^[A-Za-z0-9._/-]{1,200}$") & ~F.contains(f, F.lit(".."))).alias("path_ok"), (F.col("line_no") >= 1).alias("line_ok"), F.regexp_extract("created_at", r"^(\d{4}-\d\d-\d\d)", 1).try_cast("date").isNotNull().alias("time_ok"))


@query("fil17_eligible_by_age", f"WITH {CURRENT}, e AS (SELECT max(updated_at) AS now FROM memories) SELECT memory_id FROM m, e WHERE updated_at <= now - INTERVAL 30 MINUTE AND NOT regexp_matches(lower(path), '(^|/)(memory|index|readme)\\.md$')")
def eligible_by_age(spark, d):
    now = F.broadcast(table(spark, d, "memories").agg((F.max("updated_at") - F.expr("INTERVAL 30 MINUTES")).alias("now")))
    return current(spark, d).crossJoin(now).where("updated_at <= now").where(~F.lower("path").rlike(r"(^|/)(memory|index|readme)\.md$")).select("memory_id")


@query("fil18_read_permission", "WITH s AS (SELECT lower(trim(session, ' ' || chr(10) || chr(9))) AS session, slug, bool_or(agent <> 'main') AS opted_out FROM calls GROUP BY ALL), r AS (SELECT slug, count(*) FILTER (opted_out) > 0.9 * count(*) AS root_out FROM s GROUP BY slug) SELECT session, s.slug, NOT (opted_out OR root_out) AS allowed FROM s JOIN r USING (slug)")
def read_permission(spark, d):
    """An opt-out of the session or of its folder wins (here: sessions with subagents, folders with hardly any other)."""
    s = table(spark, d, "calls").groupBy(F.lower(F.trim("session", F.lit(" \n\t"))).alias("session"), "slug").agg(F.max(F.col("agent") != "main").alias("out"))
    r = s.groupBy("slug").agg((F.count_if("out") > 0.9 * F.count(F.lit(1))).alias("root_out"))
    return s.join(r, "slug").select("session", "slug", (~(F.col("out") | F.col("root_out"))).alias("allowed"))


@query("fil13_not_shown_again", f"WITH {EV}, r AS (SELECT session, note, min(ts) AS first_at FROM e WHERE kind = 'recall' GROUP BY ALL), u AS (SELECT session, note FROM e WHERE kind = 'use') SELECT session, note FROM u WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.session = u.session AND r.note = u.note)")
def not_shown_again(spark, d):
    e = events(spark, d)
    return e.where("kind = 'use'").select("session", "note").join(e.where("kind = 'recall'").select("session", "note"), ["session", "note"], "left_anti")


@query("sup01_isolate_notes", f"WITH {CURRENT} SELECT CASE WHEN deleted_at IS NOT NULL THEN 'deleted' WHEN archived_at IS NOT NULL THEN 'archived' WHEN trim(coalesce(description, '')) = '' THEN 'no summary' WHEN length(coalesce(body, '')) > 4000 THEN 'too long' ELSE 'safe' END AS reason, count(*) AS notes, sum(length(coalesce(body, '')))::BIGINT AS chars FROM m GROUP BY 1")
def isolate_notes(spark, d):
    n = F.length(F.coalesce("body", F.lit("")))
    reason = F.when(F.col("deleted_at").isNotNull(), "deleted").when(F.col("archived_at").isNotNull(), "archived").when(F.trim(F.coalesce("description", F.lit(""))) == "", "no summary").when(n > 4000, "too long").otherwise("safe")
    return current(spark, d).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("notes"), F.sum(n).alias("chars"))


@query("sup02_dependent_decisions", f"WITH {CURRENT} SELECT DISTINCT v.verdict_id FROM verdicts v WHERE EXISTS (SELECT 1 FROM m WHERE m.root = v.root AND m.deleted_at IS NOT NULL AND m.memory_id IN (v.memory_a, v.memory_b))")
def dependent_decisions(spark, d):
    gone = current(spark, d).where("deleted_at is not null").select("root", "memory_id")
    v = table(spark, d, "verdicts").select("verdict_id", "root", F.explode(F.array("memory_a", "memory_b")).alias("memory_id"))
    return v.join(gone, ["root", "memory_id"], "left_semi").select("verdict_id").distinct()


@query("sup05_learnable_windows", f"WITH {ONE} SELECT transcript, line_no // 20 AS window_no, bool_or(tool IS NOT NULL OR (role = 'user' AND NOT coalesce(is_meta, false) AND trim(coalesce(prompt, '')) <> '')) AS learnable FROM c GROUP BY ALL")
def learnable_windows(spark, d):
    part = F.col("tool").isNotNull() | ((F.col("role") == "user") & ~F.coalesce("is_meta", F.lit(False)) & (F.trim(F.coalesce("prompt", F.lit(""))) != ""))
    return _calls(spark, d).groupBy("transcript", F.floor(F.col("line_no") / 20).alias("window_no")).agg(F.max(part).alias("learnable"))


@query("sup06_response_check", "WITH a AS (SELECT run_id, count(DISTINCT least(memory_a, memory_b)::VARCHAR || '-' || greatest(memory_a, memory_b)::VARCHAR) AS pairs, count(DISTINCT verdict_id) AS answers, bool_and(upper(trim(verdict)) IN ('MERGE', 'RELATED', 'CONTRADICT', 'SUPERSEDE', 'UNSURE')) AS known, bool_and(memory_a <> memory_b) AS apart FROM verdicts GROUP BY run_id) SELECT run_id, pairs, answers, coalesce(known, false) AND apart AND answers = pairs AS valid FROM a")
def response_check(spark, d):
    v = table(spark, d, "verdicts")
    pair = F.concat_ws("-", F.least("memory_a", "memory_b"), F.greatest("memory_a", "memory_b"))
    a = v.groupBy("run_id").agg(F.countDistinct(pair).alias("pairs"), F.countDistinct("verdict_id").alias("answers"), F.min(F.upper(F.trim("verdict")).isin("MERGE", "RELATED", "CONTRADICT", "SUPERSEDE", "UNSURE")).alias("known"), F.min(F.col("memory_a") != F.col("memory_b")).alias("apart"))
    return a.select("run_id", "pairs", "answers", (F.coalesce("known", F.lit(False)) & F.col("apart") & (F.col("answers") == F.col("pairs"))).alias("valid"))


@query("sup07_fix_proof", f"WITH {ONE}, k AS (SELECT a.transcript, a.tool, json_extract_string(a.tool_input, '$.target') AS target, a.line_no, b.is_error FROM c a JOIN (SELECT transcript, tool_use_id, bool_or(coalesce(is_error, false)) AS is_error FROM c WHERE tool IS NULL AND tool_use_id IS NOT NULL GROUP BY ALL) b ON a.transcript = b.transcript AND a.tool_use_id = b.tool_use_id WHERE a.tool IS NOT NULL AND json_valid(a.tool_input)) SELECT tool, target, count(*) FILTER (is_error) AS failed, min(line_no) FILTER (is_error) AS first_failure, max(line_no) FILTER (NOT is_error) AS last_pass FROM k GROUP BY tool, target HAVING count(*) FILTER (is_error) > 0 AND count(*) FILTER (NOT is_error) > 0")
def fix_proof(spark, d):
    """Calls of one tool on one target that failed and passed."""
    c = _calls(spark, d)
    res = c.where("tool is null and tool_use_id is not null").groupBy("transcript", "tool_use_id").agg(F.max(F.coalesce("is_error", F.lit(False))).alias("err"))
    k = c.where(F.col("tool").isNotNull() & F.try_parse_json("tool_input").isNotNull()).join(res, ["transcript", "tool_use_id"]).select("tool", F.get_json_object("tool_input", "$.target").alias("target"), "line_no", "err")
    g = k.groupBy("tool", "target").agg(F.count_if("err").alias("failed"), F.min(F.when(F.col("err"), F.col("line_no"))).alias("first_failure"), F.max(F.when(~F.col("err"), F.col("line_no"))).alias("last_pass"))
    return g.where("failed > 0 and last_pass is not null")


@query("sup08_decision_merge", "WITH v AS (SELECT DISTINCT least(memory_a, memory_b) AS a, greatest(memory_a, memory_b) AS b, upper(trim(verdict)) AS verdict FROM verdicts WHERE trim(verdict) <> '') SELECT a, b, min(verdict) AS verdict FROM v GROUP BY a, b HAVING count(*) = 1")
def decision_merge(spark, d):
    """One decision a pair; pairs with conflicting ones are dropped."""
    v = table(spark, d, "verdicts").where("trim(verdict) <> ''").select(F.least("memory_a", "memory_b").alias("a"), F.greatest("memory_a", "memory_b").alias("b"), F.upper(F.trim("verdict")).alias("verdict"))
    return v.groupBy("a", "b").agg(F.min("verdict").alias("verdict"), F.max("verdict").alias("other")).where("verdict = other").select("a", "b", "verdict")


@query("sup10_gauge_sum", "WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents), g AS (SELECT regexp_extract(line, '\\b([a-z]+(?: [a-z]+){1,2}) took ([0-9]+) ms', 1) AS gauge, regexp_extract(line, '\\b([a-z]+(?: [a-z]+){1,2}) took ([0-9]+) ms', 2) AS v FROM l WHERE regexp_matches(line, '\\b([a-z]+(?: [a-z]+){1,2}) took ([0-9]+) ms')) SELECT gauge, count(*) AS n, sum(v::BIGINT)::BIGINT AS total FROM g GROUP BY gauge")
def gauge_sum(spark, d):
    """A figure that lines of text report, summed by what it belongs to."""
    shape = r"\b([a-z]+(?: [a-z]+){1,2}) took ([0-9]+) ms"
    l = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(shape))
    return l.groupBy(F.regexp_extract("line", shape, 1).alias("gauge")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.regexp_extract("line", shape, 2).cast("bigint")).alias("total"))


@query("sup14_similar_notes", f"WITH {CURRENT}, l AS (SELECT memory_id, {LABELS} AS l FROM m WHERE archived_at IS NULL AND deleted_at IS NULL), p AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 4) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id) SELECT p.a, p.b, score FROM p JOIN l x ON x.memory_id = p.a JOIN l y ON y.memory_id = p.b WHERE score >= 0.2 AND len(list_intersect(x.l, y.l)) > 0")
def similar_notes(spark, d):
    """Live notes with near vectors that share a label, too."""
    l = current(spark, d).where(tables.live()).select("memory_id", label_list(F.col("labels")).alias("l"))
    p = ranking.near_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", "label", 0.2)
    x = p.join(l.toDF("a", "la"), "a").join(l.toDF("b", "lb"), "b").where(F.size(F.array_intersect("la", "lb")) > 0)
    return x.select("a", "b", "score")


@query("sup18_field_drift", "WITH k AS (SELECT row_id, tool, json_keys(tool_input) AS k FROM calls WHERE tool IS NOT NULL AND json_valid(tool_input) AND json_type(tool_input) = 'OBJECT'), u AS (SELECT tool, unnest(k) AS field FROM k), n AS (SELECT tool, count(*) AS n FROM k GROUP BY tool) SELECT tool, field, count(*) AS present, any_value(n) - count(*) AS missing FROM u JOIN n USING (tool) GROUP BY tool, field")
def field_drift(spark, d):
    """How often each field of a tool's input is there and missing."""
    k = table(spark, d, "calls").where(F.col("tool").isNotNull() & F.json_object_keys("tool_input").isNotNull()).select("tool", F.json_object_keys("tool_input").alias("k"))
    n = k.groupBy("tool").agg(F.count(F.lit(1)).alias("n"))
    u = k.select("tool", F.explode("k").alias("field")).groupBy("tool", "field").agg(F.count(F.lit(1)).alias("present"))
    return u.join(n, "tool").select("tool", "field", "present", (F.col("n") - F.col("present")).alias("missing"))


@query("sup21_retrieval_hits", f"WITH {TOPS}, v AS (SELECT memory_a AS query, memory_b AS id FROM verdicts WHERE upper(trim(verdict)) IN ('MERGE', 'RELATED') UNION SELECT memory_b, memory_a FROM verdicts WHERE upper(trim(verdict)) IN ('MERGE', 'RELATED')), wq AS (SELECT DISTINCT query FROM v JOIN q USING (query)), f AS (SELECT k.query, min(rank) AS first FROM k JOIN v ON v.query = k.query AND v.id = k.id GROUP BY ALL) SELECT count(*) AS queries, count(*) FILTER (first = 1) AS at_1, count(*) FILTER (first <= 5) AS at_5, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM wq LEFT JOIN f USING (query)")
def retrieval_hits(spark, d):
    """Of the queries with a note that a judge related to them: how many have it first, in the first five, and the reciprocal rank."""
    v = table(spark, d, "verdicts").where(F.upper(F.trim("verdict")).isin("MERGE", "RELATED"))
    v = v.select(F.col("memory_a").alias("query"), F.col("memory_b").alias("id")).unionAll(v.select("memory_b", "memory_a")).distinct()
    asked = current(spark, d).where("memory_id % 100 = 0").where(F.size(F.filter(tokens("description"), lambda t: ~t.isin(*STOP_WORDS))) > 0).select(F.col("memory_id").alias("query"))
    w = v.select("query").distinct().join(asked, "query", "left_semi")
    f = _tops(spark, d).join(v, ["query", "id"]).groupBy("query").agg(F.min("rank").alias("first"))
    x = w.join(f, "query", "left")
    return x.agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("first") == 1).alias("at_1"), F.count_if(F.col("first") <= 5).alias("at_5"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


@query("sup22_rate_table", f"WITH x AS (SELECT upper(trim(verdict)) AS verdict, root, cosine >= 0.75 AS near FROM (SELECT DISTINCT * FROM verdicts) WHERE cosine IS NOT NULL), r AS (SELECT near, root, count(*)::DOUBLE AS n, count(*) FILTER (verdict = 'MERGE') / count(*)::DOUBLE AS p FROM x GROUP BY ALL) SELECT near, root, n::BIGINT AS n, round(p, 6) AS rate, round(greatest(0, {WILSON.format('-')}), 6) AS low, round(least(1, {WILSON.format('+')}), 6) AS high FROM r")
def rate_table(spark, d):
    x = table(spark, d, "verdicts").distinct().where("cosine is not null").groupBy((F.col("cosine") >= 0.75).alias("near"), "root").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.upper(F.trim("verdict")) == "MERGE").alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    return x.select("near", "root", "n", F.round(F.col("k") / F.col("n"), 6).alias("rate"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("sup24_note_births", f"WITH {CURRENT}, f AS (SELECT DISTINCT memory_id, unnest(regexp_extract_all(coalesce(body, ''), '[a-z]+/[a-z_]+\\.(?:rs|py|sql|md|toml|yaml|json|sh|go|ts)')) AS file FROM m), c AS (SELECT {TARGET} AS file, min(received_at) AS born FROM calls WHERE json_valid(tool_input) GROUP BY 1) SELECT memory_id, min(born) AS born, count(*) AS files, bool_or(born <= updated_at) AS alive FROM f JOIN c USING (file) JOIN m USING (memory_id) GROUP BY memory_id")
def note_births(spark, d):
    """The first time a call touched a file that a note names, and whether that was before its last change."""
    m = current(spark, d)
    f = m.select("memory_id", "updated_at", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(r"[a-z]+/[a-z_]+\.(?:rs|py|sql|md|toml|yaml|json|sh|go|ts)"), F.lit(0)))).alias("file"))
    c = table(spark, d, "calls").where(F.try_parse_json("tool_input").isNotNull()).groupBy(F.get_json_object("tool_input", "$.target").alias("file")).agg(F.min("received_at").alias("born"))
    return f.join(c, "file").groupBy("memory_id").agg(F.min("born").alias("born"), F.count(F.lit(1)).alias("files"), F.max(F.col("born") <= F.col("updated_at")).alias("alive"))


@query("sup26_arm_report", f"WITH {EV}, s AS (SELECT session, note % 2 AS arm, count(*) FILTER (kind = 'recall') AS rows FROM e GROUP BY ALL) SELECT arm, count(*) AS prompts, sum(rows)::BIGINT AS rows, max(rows)::BIGINT AS most, round(avg(rows), 6) AS mean FROM s GROUP BY arm")
def arm_report(spark, d):
    s = events(spark, d).groupBy("session", (F.col("note") % 2).alias("arm")).agg(F.count_if(F.col("kind") == "recall").alias("rows"))
    return s.groupBy("arm").agg(F.count(F.lit(1)).alias("prompts"), F.sum("rows").alias("rows"), F.max("rows").alias("most"), F.round(F.avg("rows"), 6).alias("mean"))


@query("snk07_soft_delete", f"WITH {CURRENT}, {COUNTS} SELECT m.memory_id, coalesce(m.archived_at, CASE WHEN coalesce(k.use_pos, 0) = 0 AND NOT coalesce(m.pinned, false) AND m.updated_at < (SELECT max(updated_at) FROM memories) - INTERVAL 180 DAY THEN (SELECT max(updated_at) FROM memories) END) AS archived_at FROM m LEFT JOIN k USING (memory_id)")
def soft_delete(spark, d):
    """Notes without use for half a year are archived; pinned ones and what is archived already stay as they are."""
    now = F.broadcast(table(spark, d, "memories").agg(F.max("updated_at").alias("now")))
    x = current(spark, d).join(counts(spark, d).select("memory_id", "use_pos"), "memory_id", "left").crossJoin(now)
    idle = (F.coalesce("use_pos", F.lit(0.0)) == 0) & ~F.coalesce("pinned", F.lit(False)) & (F.col("updated_at") < F.col("now") - F.expr("INTERVAL 180 DAYS"))
    return x.select("memory_id", F.coalesce("archived_at", F.when(idle, F.col("now"))).alias("archived_at"))


@query("snk03_hash_touch", "WITH v AS (SELECT memory_id, rev, content_hash, lag(content_hash) OVER (PARTITION BY memory_id ORDER BY rev) AS before FROM (SELECT DISTINCT memory_id, rev, content_hash FROM memories)) SELECT memory_id, rev, CASE WHEN before IS NULL THEN 'insert' WHEN before = content_hash THEN 'touch' ELSE 'rewrite' END AS op FROM v")
def hash_touch(spark, d):
    """Every revision as an insert, a rewrite in place, or a touch that leaves the text as it was."""
    v = table(spark, d, "memories").select("memory_id", "rev", "content_hash").distinct()
    before = F.lag("content_hash").over(Window.partitionBy("memory_id").orderBy("rev"))
    return v.withColumn("before", before).select("memory_id", "rev", F.when(F.col("before").isNull(), "insert").when(F.col("before") == F.col("content_hash"), "touch").otherwise("rewrite").alias("op"))


@query("snk11_import_store", f"WITH {RECEIPT}, b AS (SELECT receipt, arg_min(entry_id, entry_id) AS entry_id FROM r GROUP BY receipt), {CURRENT}, n AS (SELECT DISTINCT sha256({FLAT.format('description')}) AS receipt, deleted_at IS NOT NULL AS gone FROM m WHERE description IS NOT NULL) SELECT entry_id, CASE WHEN n.receipt IS NULL THEN 'store' WHEN gone THEN 'revive' ELSE 'have' END AS op FROM b LEFT JOIN (SELECT receipt, bool_and(gone) AS gone FROM n GROUP BY receipt) n USING (receipt)")
def import_store(spark, d):
    e = table(spark, d, "entries").where("text is not null").groupBy(F.sha2(flat(F.col("text")), 256).alias("receipt")).agg(F.min("entry_id").alias("entry_id"))
    n = current(spark, d).where("description is not null").groupBy(F.sha2(flat(F.col("description")), 256).alias("receipt")).agg(F.min(F.col("deleted_at").isNotNull()).alias("gone"))
    return e.join(n, "receipt", "left").select("entry_id", F.when(F.col("gone").isNull(), "store").when(F.col("gone"), "revive").otherwise("have").alias("op"))


@query("dup03_merged_text", f"WITH {SAME}, rr AS (SELECT survivor, p.memory_id, list_filter(list_transform(regexp_split_to_array(coalesce(m.body, ''), '\\r?\\n'), lambda x: rtrim(x)), lambda x: trim(x) <> '') AS l FROM p JOIN m ON m.memory_id = p.memory_id), oo AS (SELECT survivor, unnest(l) AS line, memory_id <> survivor AS other, memory_id, generate_subscripts(l, 1) AS i FROM rr), kk AS (SELECT survivor, line, min((other, memory_id, i)) AS pos FROM oo GROUP BY ALL) SELECT survivor, sha256(string_agg(line, chr(10) ORDER BY pos)) AS hash, count(*) AS lines FROM kk GROUP BY survivor")
def merged_text(spark, d):
    """The survivor's text with the lines that only merged notes have behind its own; each line once, and lines are grouped before they are gathered."""
    body = current(spark, d).select("memory_id", F.split(F.coalesce("body", F.lit("")), r"\r?\n").alias("l"))
    o = duplicates(spark, d).select("survivor", "memory_id").join(body, "memory_id").select("survivor", "memory_id", F.filter(F.transform("l", lambda x: F.rtrim(x)), lambda x: F.trim(x) != "").alias("l"))
    o = o.select("survivor", (F.col("memory_id") != F.col("survivor")).alias("other"), "memory_id", F.posexplode("l").alias("i", "line"))
    k = o.groupBy("survivor", "line").agg(F.min(F.struct("other", "memory_id", "i")).alias("at"))
    text = F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"])
    return k.groupBy("survivor").agg(F.sha2(F.array_join(text, "\n"), 256).alias("hash"), F.count(F.lit(1)).alias("lines"))
