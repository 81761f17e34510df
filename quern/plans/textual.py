"""Text queries: masks, labels, windows, normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.registry import query
from quern.session import table

FLAT = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


@query("str15_mask_secrets", r"""WITH m AS (SELECT entry_id, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(://[^:@/?#\s]+):[^@\s]+@', '\1:***@', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+', '<email>', 'g'), '(?i)\b(api[_-]?key|token|password|secret)(\s*[=:]\s*)[^\s,;]+', '\1\2***', 'g'), '\b([0-9]{1,3}\.){3}[0-9]{1,3}\b', '<ip>', 'g') AS masked FROM (SELECT DISTINCT entry_id, text FROM entries)) SELECT entry_id, sha256(masked) AS hash FROM m WHERE masked <> text""")
def mask_secrets(spark, d):
    """Entries that masking changes, with the hash of the masked text."""
    e = table(spark, d, "entries").select("entry_id", "text").distinct()
    return e.withColumn("masked", tx.mask_secrets(F.col("text"))).where("masked <> text").select("entry_id", F.sha2("masked", 256).alias("hash"))


@query("str11_flat_clip", f"WITH f AS (SELECT doc_id, {FLAT.format('text')} AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 80 THEN rtrim(t[1:79], ' ') || '…' ELSE t END AS clipped FROM f")
def flat_clip(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.clip(tx.flat(F.col("text")), 80).alias("clipped"))


@query("str28_windows", "WITH n AS (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 400)) AS start FROM documents WHERE length(text) > 0) SELECT doc_id, start, length(substr(text, start + 1, 500)) AS chars FROM n")
def windows(spark, d):
    """Overlapping windows of 500 characters every 400 over whole texts."""
    n = table(spark, d, "documents").where(F.length("text") > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(400))).alias("start"))
    return n.select("doc_id", F.col("start").cast("bigint").alias("start"), F.length(F.substring("text", F.col("start") + 1, F.lit(500))).cast("bigint").alias("chars"))


@query("str29_statement_groups", f"SELECT lower({FLAT.format('description')}) AS statement, count(DISTINCT memory_id) AS notes FROM memories WHERE description IS NOT NULL GROUP BY 1 HAVING count(DISTINCT memory_id) > 1")
def statement_groups(spark, d):
    m = table(spark, d, "memories").where("description is not null")
    return m.groupBy(F.lower(tx.flat(F.col("description"))).alias("statement")).agg(F.countDistinct("memory_id").alias("notes")).where("notes > 1")


@query("str21_file_labels", r"SELECT label, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z]+/[a-z_]+\.(?:rs|py|sql|md|toml|yaml|json|sh|go|ts)')) AS label FROM documents) GROUP BY label")
def file_labels(spark, d):
    """Files that a text names, with the documents that name them."""
    each = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[a-z]+/[a-z_]+\.(?:rs|py|sql|md|toml|yaml|json|sh|go|ts)"), F.lit(0))).alias("label")).distinct()
    return each.groupBy("label").agg(F.count(F.lit(1)).alias("docs"))


@query("str10_titles", "SELECT chunk_id, rev, regexp_replace(trim(string_split(replace(text, chr(13), ''), chr(10))[1]), '^#+ *', '') AS title FROM (SELECT DISTINCT chunk_id, rev, text FROM memory_chunks)")
def titles(spark, d):
    c = table(spark, d, "memory_chunks").select("chunk_id", "rev", "text").distinct()
    return c.select("chunk_id", "rev", F.regexp_replace(F.trim(F.get(F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n"), F.lit(0))), "^#+ *", "").alias("title"))


@query("fil16_harness_prefix", "SELECT lower(regexp_extract(text, '^([A-Za-z]+):', 1)) AS prefix, count(*) AS docs FROM documents WHERE regexp_matches(text, '^[A-Za-z]+:') GROUP BY 1")
def harness_prefix(spark, d):
    x = table(spark, d, "documents").where(F.col("text").rlike("^[A-Za-z]+:"))
    return x.groupBy(F.lower(F.regexp_extract("text", "^([A-Za-z]+):", 1)).alias("prefix")).agg(F.count(F.lit(1)).alias("docs"))


@query("str23_correction_cues", r"SELECT regexp_matches(lower(prompt), '^(no|wrong|stop)\b') AS lead, count(*) AS prompts FROM calls WHERE prompt IS NOT NULL GROUP BY 1")
def correction_cues(spark, d):
    x = table(spark, d, "calls").where("prompt is not null")
    return x.groupBy(F.lower("prompt").rlike(r"^(no|wrong|stop)\b").alias("lead")).agg(F.count(F.lit(1)).alias("prompts"))


@query("hsh01_content_hash", "SELECT memory_id, rev, sha256(coalesce(description, '') || chr(10) || coalesce(body, '')) AS hash, substr(sha256(path), 1, 24) AS support_id FROM (SELECT DISTINCT memory_id, rev, path, description, body FROM memories)")
def content_hash(spark, d):
    m = table(spark, d, "memories").select("memory_id", "rev", "path", "description", "body").distinct()
    empty = F.lit("")
    return m.select("memory_id", "rev", F.sha2(F.concat(F.coalesce("description", empty), F.lit("\n"), F.coalesce("body", empty)), 256).alias("hash"), F.substring(F.sha2("path", 256), 1, 24).alias("support_id"))
