"""Import validation, first-of-hash, scan plans, upserts, retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.text import label_list
from quern.operators import tables
from quern.registry import query
from quern.session import table


@query("src06_first_of_hash", "SELECT entry_id, hash FROM (SELECT entry_id, sha256(text) AS hash, row_number() OVER (PARTITION BY sha256(text) ORDER BY import_file, line_no, entry_id) AS n FROM entries WHERE text IS NOT NULL) WHERE n = 1")
def first_of_hash(spark, d):
    """The first line of each content hash in file order: a partial aggregation, no sort."""
    e = table(spark, d, "entries").where("text is not null").select("entry_id", "import_file", "line_no", F.sha2("text", 256).alias("hash"))
    return e.groupBy("hash").agg(F.min_by("entry_id", F.struct("import_file", "line_no", "entry_id")).alias("entry_id")).select("entry_id", "hash")


@query("src05_import_report", "SELECT import_file, count(*) AS lines, count(*) FILTER (text IS NULL OR trim(text) = '') AS blank, count(*) FILTER (category IS NULL) AS no_category, count(*) FILTER (redacted IS NULL) AS no_claim FROM entries GROUP BY import_file")
def import_report(spark, d):
    return table(spark, d, "entries").groupBy("import_file").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("text").isNull() | (F.trim("text") == "")).alias("blank"), F.count_if(F.col("category").isNull()).alias("no_category"), F.count_if(F.col("redacted").isNull()).alias("no_claim"))


CUT = "cut AS (SELECT (epoch_us(min(updated_at)) + epoch_us(max(updated_at))) // 2 AS mid FROM memories), r AS (SELECT root, path, rev, content_hash, deleted_at IS NOT NULL AS gone, row_number() OVER (PARTITION BY root, path ORDER BY rev DESC, content_hash DESC) AS down, epoch_us(updated_at) <= mid AS early FROM memories, cut), o AS (SELECT *, row_number() OVER (PARTITION BY root, path ORDER BY rev DESC, content_hash DESC) AS up FROM r WHERE early), "


@query("idx01_scan_plan", f"WITH {CUT} b AS (SELECT * FROM o WHERE up = 1), a AS (SELECT * FROM r WHERE down = 1 AND NOT gone), j AS (SELECT coalesce(a.root, b.root) AS root, coalesce(a.path, b.path) AS path, b.content_hash AS oh, b.gone AS wg, a.content_hash AS nh FROM b FULL JOIN a ON a.root = b.root AND a.path = b.path), lost AS (SELECT oh, row_number() OVER (PARTITION BY oh ORDER BY root, path) AS i FROM j WHERE nh IS NULL AND NOT wg), fresh AS (SELECT *, row_number() OVER (PARTITION BY nh ORDER BY root, path) AS i FROM j WHERE oh IS NULL) SELECT root, path, CASE WHEN lost.i IS NULL THEN 'insert' ELSE 'move' END AS op FROM fresh LEFT JOIN lost ON lost.oh = fresh.nh AND lost.i = fresh.i UNION ALL SELECT root, path, CASE WHEN nh IS NULL THEN CASE WHEN wg THEN 'same' ELSE 'delete' END WHEN wg THEN 'revive' WHEN oh <> nh THEN 'update' ELSE 'same' END FROM j WHERE oh IS NOT NULL")
def scan_plan(spark, d):
    """The state at the middle of ``updated_at`` against the last one, of all notes."""
    old, new = snapshots(table(spark, d, "memories"))
    return tables.scan_plan(old, new, ["root", "path"])


def snapshots(memories):
    """(before, after): the newest version of every path up to the middle of ``updated_at``, and that of all that live at the end."""
    m = memories.select("root", "path", "rev", "content_hash", F.col("deleted_at").isNotNull().alias("gone"), F.unix_micros(F.col("updated_at").cast("timestamp")).alias("us"))
    cut = F.broadcast(m.agg(F.expr("(min(us) + max(us)) div 2").alias("cut")))
    early = m.crossJoin(cut).where("us <= cut").drop("us", "cut")
    newest = lambda x: x.groupBy("root", "path").agg(F.max_by(F.struct("rev", "content_hash", "gone"), F.struct("rev", "content_hash")).alias("r")).select("root", "path", "r.*")
    return newest(early), newest(m.drop("us")).where("not gone")


@query("fil21_shrink_guard", "WITH m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY rev DESC) AS n FROM memories) WHERE n = 1), x AS (SELECT root, count(*) FILTER (archived_at IS NULL) AS live, count(*) FILTER (archived_at IS NULL AND deleted_at IS NOT NULL) AS deletes FROM m GROUP BY root), a AS (SELECT * FROM x UNION ALL SELECT '*', sum(live), sum(deletes) FROM x) SELECT root, live::BIGINT AS live, deletes::BIGINT AS deletes, CASE WHEN live < 10 THEN deletes > 1 ELSE deletes > 0.1 * live END AS blocked FROM a")
def shrink_guard(spark, d):
    """Whether a run would delete too much: more than a tenth (or more than one of fewer than ten), by root and over all (``*``)."""
    m = tables.newest(table(spark, d, "memories").select("memory_id", "root", "archived_at", "deleted_at", "rev"), ["memory_id"], ["rev"])
    shown = F.col("archived_at").isNull()
    x = m.groupBy("root").agg(F.count_if(shown).alias("live"), F.count_if(shown & F.col("deleted_at").isNotNull()).alias("deletes"))
    x = x.unionByName(x.agg(F.lit("*").alias("root"), F.sum("live").alias("live"), F.sum("deletes").alias("deletes")))
    return x.withColumn("blocked", F.when(F.col("live") < 10, F.col("deletes") > 1).otherwise(F.col("deletes") > 0.1 * F.col("live")))


@query("snk05_insert_ignore", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, ts::DATE AS day FROM events WHERE event_id % 2 = 0) a WHERE NOT EXISTS (SELECT 1 FROM events b WHERE b.event_id % 2 = 1 AND b.user_id = a.user_id AND b.event_type = a.event_type AND b.ts::DATE = a.day) GROUP BY ALL")
def insert_ignore(spark, d):
    """A new batch of events loses what an older batch has under the same natural key."""
    x = table(spark, d, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"))
    keys = ["user_id", "event_type", "day"]
    return tables.insert_ignore(x.where("event_id % 2 = 0"), x.where("event_id % 2 = 1"), keys).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("snk04_rollup_upsert", "WITH o AS (SELECT memory_id, max(trials) AS trials FROM counts WHERE folded_event_id % 2 = 0 GROUP BY memory_id), n AS (SELECT memory_id, max(trials) + 1 AS trials FROM counts WHERE folded_event_id % 2 = 1 GROUP BY memory_id) SELECT memory_id, coalesce(n.trials, o.trials) AS trials FROM o FULL JOIN n USING (memory_id)")
def rollup_upsert(spark, d):
    c = table(spark, d, "counts")
    o = c.where("folded_event_id % 2 = 0").groupBy("memory_id").agg(F.max("trials").alias("trials"))
    n = c.where("folded_event_id % 2 = 1").groupBy("memory_id").agg((F.max("trials") + 1).alias("trials"))
    return tables.upsert(o, n, ["memory_id"])


@query("snk06_cursor_max", "SELECT transcript, max(line_no) AS line_no FROM calls GROUP BY transcript")
def cursor_max(spark, d):
    return table(spark, d, "calls").groupBy("transcript").agg(F.max("line_no").alias("line_no"))


@query("snk08_purge", "SELECT memory_id, rev FROM (SELECT DISTINCT memory_id, rev, deleted_at, archived_at FROM memories) WHERE (deleted_at IS NULL OR deleted_at >= (SELECT max(updated_at) FROM memories) - INTERVAL 30 DAY) AND (archived_at IS NULL OR archived_at >= (SELECT max(updated_at) FROM memories) - INTERVAL 60 DAY)")
def purge(spark, d):
    """What stays after soft-deleted rows pass their grace and archived ones their retention."""
    m = table(spark, d, "memories")
    now = F.broadcast(m.agg(F.max("updated_at").alias("now")))
    keep = (F.col("deleted_at").isNull() | (F.col("deleted_at") >= F.col("now") - F.expr("INTERVAL 30 DAYS"))) & (F.col("archived_at").isNull() | (F.col("archived_at") >= F.col("now") - F.expr("INTERVAL 60 DAYS")))
    return m.select("memory_id", "rev", "deleted_at", "archived_at").distinct().crossJoin(now).where(keep).select("memory_id", "rev")


@query("tru02_orphans", "SELECT DISTINCT memory_id FROM counts WHERE memory_id NOT IN (SELECT memory_id FROM memories WHERE memory_id IS NOT NULL) UNION SELECT DISTINCT parent_id FROM memory_chunks WHERE parent_id NOT IN (SELECT memory_id FROM memories WHERE memory_id IS NOT NULL)")
def orphans(spark, d):
    keys = table(spark, d, "counts").select("memory_id").unionAll(table(spark, d, "memory_chunks").select(F.col("parent_id").alias("memory_id"))).distinct()
    return keys.join(table(spark, d, "memories").select("memory_id"), "memory_id", "left_anti").where("memory_id is not null")


@query("arr02_label_lists", "SELECT entry_id, list_sort(list_distinct(list_filter(list_transform(from_json(labels, '[\"VARCHAR\"]'), lambda x: lower(trim(x))), lambda x: x <> ''))) AS labels FROM (SELECT DISTINCT entry_id, labels FROM entries) WHERE labels IS NOT NULL")
def label_lists(spark, d):
    return table(spark, d, "entries").where("labels is not null").select("entry_id", "labels").distinct().select("entry_id", label_list(F.col("labels")).alias("labels"))


@query("str05_category", "SELECT memory_id, rev, CASE WHEN regexp_matches(path, '^(user|feedback|project|reference)_') THEN regexp_extract(path, '^([a-z]+)_', 1) WHEN lower(trim(coalesce(category, ''))) <> '' THEN lower(trim(category)) ELSE 'note' END AS kind FROM (SELECT DISTINCT memory_id, rev, path, category FROM memories)")
def category(spark, d):
    m = table(spark, d, "memories").select("memory_id", "rev", "path", "category").distinct()
    own = F.lower(F.trim(F.coalesce("category", F.lit(""))))
    return m.select("memory_id", "rev", F.when(F.col("path").rlike("^(user|feedback|project|reference)_"), F.regexp_extract("path", "^([a-z]+)_", 1)).when(own != "", own).otherwise("note").alias("kind"))


@query("agg28_tree_digest", "WITH b AS (SELECT root, substr(sha256(path), 1, 3) AS bucket, sha256(string_agg(path || ':' || content_hash, chr(10) ORDER BY path, content_hash)) AS h FROM (SELECT DISTINCT root, path, content_hash FROM memories) GROUP BY ALL) SELECT root, sha256(string_agg(bucket || h, chr(10) ORDER BY bucket)) AS digest FROM b GROUP BY root")
def tree_digest(spark, d):
    """One digest a root over the digests of its 4,096 buckets of paths, each over its sorted paths and hashes: no root is collected whole."""
    m = table(spark, d, "memories").select("root", "path", "content_hash").distinct()
    line = F.transform(F.array_sort(F.collect_list(F.struct("path", "content_hash"))), lambda r: F.concat_ws(":", r["path"], r["content_hash"]))
    buckets = m.groupBy("root", F.substring(F.sha2("path", 256), 1, 3).alias("bucket")).agg(F.sha2(F.concat_ws("\n", line), 256).alias("h"))
    joined = F.transform(F.array_sort(F.collect_list(F.struct("bucket", "h"))), lambda r: F.concat(r["bucket"], r["h"]))
    return buckets.groupBy("root").agg(F.sha2(F.concat_ws("\n", joined), 256).alias("digest"))


@query("dat01_parse_times", "SELECT entry_id, created_at, CASE WHEN regexp_matches(created_at, '^\\d{4}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\d') THEN strptime(created_at[1:19], '%Y-%m-%dT%H:%M:%S') - CASE WHEN regexp_matches(created_at, '[+-]\\d\\d:?\\d\\d$') THEN to_minutes((CASE WHEN regexp_extract(created_at, '([+-])\\d\\d:?\\d\\d$', 1) = '-' THEN -1 ELSE 1 END * (regexp_extract(created_at, '[+-](\\d\\d):?\\d\\d$', 1)::BIGINT * 60 + regexp_extract(created_at, '[+-]\\d\\d:?(\\d\\d)$', 1)::BIGINT))) ELSE to_minutes(0) END END AS at FROM (SELECT DISTINCT entry_id, created_at FROM entries)".replace(" AS at", " AS parsed"))
def parse_times(spark, d):
    """ISO times with zones as UTC without a zone, whole seconds; other forms are null."""
    e = table(spark, d, "entries").select("entry_id", "created_at").distinct()
    text = F.col("created_at")
    sign = F.when(F.regexp_extract(text, r"([+-])\d\d:?\d\d$", 1) == "-", -1).otherwise(1)
    minutes = F.when(text.rlike(r"[+-]\d\d:?\d\d$"), sign * (F.regexp_extract(text, r"[+-](\d\d):?\d\d$", 1).try_cast("int") * 60 + F.regexp_extract(text, r"[+-]\d\d:?(\d\d)$", 1).try_cast("int"))).otherwise(0)
    parsed = F.when(text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d"), F.timestamp_seconds(F.unix_seconds(F.to_timestamp(F.substring(text, 1, 19), "yyyy-MM-dd'T'HH:mm:ss")) - minutes * 60).cast("timestamp_ntz"))
    return e.select("entry_id", "created_at", parsed.alias("parsed"))
