"""Exact and vector duplicates, vetoes, verdict reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import ranking, tables
from quern.registry import query
from quern.session import table


@query("dup01_exact_duplicates", "SELECT sha256(text) AS hash, min(doc_id) AS survivor, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def exact_duplicates(spark, d):
    """Groups of equal texts by content hash; one row a group."""
    return table(spark, d, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("survivor"), F.count(F.lit(1)).alias("copies")).where("copies > 1")


PAIRS = "pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 4) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id)"


def _pairs(spark, d, least):
    """Pairs inside a block (label) at or above a cosine; blocks are the operator's own partition key."""
    return ranking.near_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", "label", least)


@query("joi05_near_pairs", f"WITH {PAIRS} SELECT a, b, score FROM pairs WHERE score >= 0.35")
def near_pairs(spark, d):
    return _pairs(spark, d, 0.35).select("a", "b", "score")


@query("joi06_veto_antijoin", f"WITH {PAIRS}, veto AS (SELECT DISTINCT least(memory_a, memory_b) AS a, greatest(memory_a, memory_b) AS b FROM verdicts WHERE upper(trim(verdict)) = 'CONTRADICT') SELECT a, b, score FROM pairs WHERE score >= 0.3 AND NOT EXISTS (SELECT 1 FROM veto WHERE veto.a = pairs.a AND veto.b = pairs.b)")
def veto_pairs(spark, d):
    """The pairs that no veto names, by both ends and whole ids."""
    return without_vetoes(_pairs(spark, d, 0.3), table(spark, d, "verdicts")).select("a", "b", "score")


def without_vetoes(pairs, verdicts):
    """Drops the ordered pairs (a, b) that were judged CONTRADICT, in either order."""
    v = verdicts.where(F.upper(F.trim("verdict")) == "CONTRADICT").select(F.least("memory_a", "memory_b").alias("a"), F.greatest("memory_a", "memory_b").alias("b"))
    return pairs.join(v.distinct(), ["a", "b"], "left_anti")


@query("agg27_verdict_tally", "SELECT upper(trim(verdict)) AS verdict, judged_at::DATE AS day, count(*) AS n, round(sum(coalesce(cost, 0)), 6) AS cost, sum(prompt_tokens + completion_tokens)::BIGINT AS tokens FROM (SELECT DISTINCT * FROM verdicts) GROUP BY ALL")
def verdict_tally(spark, d):
    x = table(spark, d, "verdicts").distinct()
    return x.groupBy(F.upper(F.trim("verdict")).alias("verdict"), F.to_date("judged_at").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.coalesce("cost", F.lit(0.0))), 6).alias("cost"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"))


@query("joi01_docs_vectors", "SELECT label, count(*) AS n, round(avg(n_chars), 6) AS mean_chars FROM documents JOIN embeddings ON doc_id = vec_id GROUP BY label")
def docs_vectors(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return table(spark, d, "documents").select("doc_id", "n_chars").join(e, "doc_id").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


@query("joi02_missing_vectors", "SELECT d.doc_id FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id WHERE e.vec_id IS NULL")
def missing_vectors(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return table(spark, d, "documents").select("doc_id").join(e, "doc_id", "left_anti")


@query("dup03_merge_labels", "WITH l AS (SELECT DISTINCT root, lower(trim(unnest(from_json(labels, '[\"VARCHAR\"]')))) AS label FROM memories) SELECT root, list(label ORDER BY label)[1:12] AS labels FROM l WHERE label <> '' GROUP BY root")
def merge_labels(spark, d):
    """The first twelve labels of each root in order (twelve is the feature: a stamp on the survivor)."""
    from quern.functions.text import label_list

    each = table(spark, d, "memories").select("root", F.explode(label_list(F.col("labels"))).alias("label")).distinct()
    return each.groupBy("root").agg(F.slice(F.array_sort(F.collect_set("label")), 1, 12).alias("labels"))


@query("dup02_survivor_votes", "WITH v AS (SELECT CASE upper(trim(survivor)) WHEN 'A' THEN memory_a WHEN 'B' THEN memory_b END AS memory_id FROM (SELECT DISTINCT * FROM verdicts) WHERE upper(trim(verdict)) = 'MERGE') SELECT memory_id, count(*) AS votes FROM v WHERE memory_id IS NOT NULL GROUP BY memory_id")
def survivor_votes(spark, d):
    s = F.upper(F.trim("survivor"))
    v = table(spark, d, "verdicts").distinct().where(F.upper(F.trim("verdict")) == "MERGE").select(F.when(s == "A", F.col("memory_a")).when(s == "B", F.col("memory_b")).alias("memory_id"))
    return v.where("memory_id is not null").groupBy("memory_id").agg(F.count(F.lit(1)).alias("votes"))
