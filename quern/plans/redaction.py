"""Masking queries: credentials, manifests, outbound text, hidden orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import redact
from quern.registry import query
from quern.session import table

SQL_TEXT = redact.redact_sql("text")
HAS = " OR ".join("regexp_matches(text, '{}')".format(p.replace("'", "''")) for k, p, _ in redact.RULES if k != "email")


def _scrub_sql(text: str) -> str:
    for pattern, to in redact.SCRUB:
        text = f"regexp_replace({text}, '{pattern}', '{to}', 'g')"
    return text


@query("str14_redact", f"WITH r AS (SELECT doc_id, text, {SQL_TEXT} AS clean FROM documents) SELECT doc_id, sha256(clean) AS hash, clean <> text AS changed FROM r WHERE text IS NOT NULL")
def redacted(spark, d):
    """Every document with its credentials masked by the ordered rules, as a hash, and whether anything changed."""
    x = table(spark, d, "documents").where("text is not null").select("doc_id", "text", redact.redact(F.col("text")).alias("clean"))
    return x.select("doc_id", F.sha2("clean", 256).alias("hash"), (F.col("clean") != F.col("text")).alias("changed"))


@query("str14_kinds", f"WITH r AS (SELECT entry_id, unnest(regexp_extract_all({SQL_TEXT}, '\\[redacted:([a-z-]+)\\]', 1)) AS kind FROM (SELECT DISTINCT entry_id, text FROM entries)) SELECT kind, count(*) AS marks, count(DISTINCT entry_id) AS entries FROM r GROUP BY kind")
def redaction_kinds(spark, d):
    e = table(spark, d, "entries").select("entry_id", "text").distinct()
    each = e.select("entry_id", F.explode(F.regexp_extract_all(redact.redact(F.col("text")), F.lit(r"\[redacted:([a-z-]+)\]"), F.lit(1))).alias("kind"))
    return each.groupBy("kind").agg(F.count(F.lit(1)).alias("marks"), F.countDistinct("entry_id").alias("entries"))


@query("fil14_secret_rows", f"SELECT lower(trim(source)) AS source, count(*) AS docs, count(*) FILTER ({HAS}) AS secret FROM documents GROUP BY 1")
def secret_rows(spark, d):
    x = table(spark, d, "documents")
    return x.groupBy(F.lower(F.trim("source")).alias("source")).agg(F.count(F.lit(1)).alias("docs"), F.count_if(redact.holds_secret(F.col("text"))).alias("secret"))


@query("str17_mask_manifest", f"SELECT doc_id, sha256(regexp_replace(text, '{redact.MANIFEST_VALUE}', '\\1[redacted:manifest]', 'g')) AS hash FROM documents WHERE regexp_matches(text, '{redact.SECRET_MANIFEST}')")
def mask_manifest(spark, d):
    x = table(spark, d, "documents").where(F.col("text").rlike(redact.SECRET_MANIFEST))
    return x.select("doc_id", F.sha2(redact.mask_manifest(F.col("text")), 256).alias("hash"))


HEAD = redact.redact_sql("substr(text, 1, 200)")


@query("str18_agreed_start", f"WITH r AS (SELECT doc_id, {HEAD} AS a, {SQL_TEXT} AS b FROM documents WHERE text <> ''), n AS (SELECT *, coalesce(list_max(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: substr(a, 1, i) = substr(b, 1, i))), 0) AS k FROM r) SELECT doc_id, regexp_replace(substr(a, 1, k), '\\[[^\\]]*$', '') AS head FROM n")
def agreed_start(spark, d):
    """What a masked cut and the masked whole agree on, for the first 200 characters (the cut is the feature)."""
    t = F.col("text")
    x = table(spark, d, "documents").where("text <> ''").select("doc_id", redact.redact(F.substring(t, 1, 200)).alias("a"), redact.redact(t).alias("b"))
    return x.select("doc_id", redact.agreed_start(F.col("a"), F.col("b")).alias("head"))


@query("str20_scrub_outbound", f"SELECT doc_id, sha256({_scrub_sql('text')}) AS hash FROM documents WHERE {_scrub_sql('text')} <> text")
def scrub_outbound(spark, d):
    x = table(spark, d, "documents").select("doc_id", "text", redact.scrub(F.col("text")).alias("clean"))
    return x.where("clean <> text").select("doc_id", F.sha2("clean", 256).alias("hash"))


@query("str19_mask_orders")
def mask_orders(spark, d):
    """Documents with orders to the reader, folded before matching; no SQL twin, as SQL has no compatibility form."""
    x = table(spark, d, "documents").select("doc_id", redact.mask_orders(F.col("text")).alias("m")).where("m.hits > 0")
    return x.select("doc_id", F.col("m.hits").alias("hits"), F.sha2("m.text", 256).alias("hash"))


@query("str30_inert_text")
def inert_text(spark, d):
    x = table(spark, d, "entries").where("text is not null").select("entry_id", "text").distinct()
    return x.select("entry_id", F.sha2(redact.inert(F.col("text")), 256).alias("hash"))
