"""Ranked recall over the notes for a table of queries (every hundredth note asks by its description)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.text import label_list
from quern.operators import ranking, recall, tables
from quern.registry import query
from quern.session import stored, table

EVERY, TOP = 100, 20
STOPS = ", ".join(f"'{w}'" for w in recall.STOP_WORDS)
TOK = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^a-z0-9_.\\-/]+'), lambda t: length(t) >= 2)"
UNITS = f"""m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY rev DESC) AS n FROM memories) WHERE n = 1),
live AS (SELECT * FROM m WHERE archived_at IS NULL AND deleted_at IS NULL AND source_type <> 'transcript_mined'),
ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parent_id, chunk_index ORDER BY rev DESC, chunk_id DESC) AS n FROM memory_chunks) WHERE n = 1),
u AS MATERIALIZED (SELECT l.project AS pool, l.memory_id AS note, coalesce(c.chunk_index, 0) AS part, l.weight, list_filter(list_distinct(list_transform(from_json(l.labels, '["VARCHAR"]'), lambda x: lower(trim(x)))), lambda x: x <> '') AS labels,
  {TOK.format("coalesce(c.search_text, concat_ws(chr(10), l.name, l.description, l.body))")} AS w FROM live l LEFT JOIN ch c ON c.parent_id = l.memory_id),
q0 AS (SELECT memory_id AS query, project AS pool, description AS text FROM m WHERE memory_id % {EVERY} = 0),
q AS (SELECT query, pool, unnest({TOK.format("text")}) AS term FROM q0),
size AS (SELECT pool, count(*) AS n, avg(len(w)) AS avgdl FROM u GROUP BY pool),
post AS MATERIALIZED (SELECT pool, note, part, len, term, count(*) AS tf FROM (SELECT pool, note, part, len(w) AS len, unnest(w) AS term FROM u) GROUP BY ALL),
terms AS MATERIALIZED (SELECT pool, term, df, uses, n, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS idf0 FROM (SELECT pool, term, count(*) AS df, sum(tf)::BIGINT AS uses FROM post GROUP BY ALL) JOIN size USING (pool)),
flo AS (SELECT pool, 0.25 * avg(idf0) AS floor FROM terms GROUP BY pool),
hist AS (SELECT pool, df, sum(uses) AS uses FROM terms GROUP BY ALL),
cuts AS (SELECT pool, min(df) FILTER (run >= 0.5 * total) AS informative, min(df) FILTER (run >= 0.1 * total) AS rare FROM (SELECT pool, df, sum(uses) OVER (PARTITION BY pool ORDER BY df) AS run, sum(uses) OVER (PARTITION BY pool) AS total FROM hist) GROUP BY pool),
qt AS MATERIALIZED (SELECT a.query, a.pool, a.term, a.times, t.df, s.n, s.avgdl, c.informative, c.rare, CASE WHEN t.idf0 < 0 THEN f.floor ELSE t.idf0 END AS idf, a.term IN ({STOPS}) AS stop, t.df IS NOT NULL AND (a.term NOT IN ({STOPS}) OR t.df * 20 <= s.n) AS real
  FROM (SELECT query, pool, term, count(*) AS times FROM q GROUP BY ALL) a LEFT JOIN terms t USING (pool, term) JOIN size s USING (pool) JOIN flo f USING (pool) JOIN cuts c USING (pool)),
named AS (SELECT DISTINCT query, pool, label FROM (SELECT query, pool, term AS label FROM q UNION ALL SELECT query, pool, unnest(list_transform(range(2, len(string_split(term, '/')) + 1), lambda i: array_to_string(string_split(term, '/')[i:], '/'))) FROM q WHERE term LIKE '%/%')),
boost AS MATERIALIZED (SELECT query, note, 0.4 * least(count(DISTINCT label), 2) AS boost FROM (SELECT DISTINCT pool, note, unnest(labels) AS label FROM u) JOIN named USING (pool, label) GROUP BY ALL),
mt AS MATERIALIZED (SELECT query, note, part, round(score + coalesce(boost, 0), 6) AS bm25 FROM (SELECT qt.query, p.note, p.part, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))) AS score, bool_or(real) AS real FROM post p JOIN qt USING (pool, term) WHERE df IS NOT NULL GROUP BY ALL) LEFT JOIN boost USING (query, note) WHERE real)"""
RECALL = f"""{UNITS},
cs AS (SELECT q0.query, u.note, u.part, round(list_sum(list_transform(list_zip(e.embedding, g.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) * u.weight, 4) AS sem
  FROM q0 JOIN embeddings g ON g.vec_id = q0.query JOIN (SELECT pool, note, weight, min(part) AS part FROM u GROUP BY ALL) u USING (pool) JOIN embeddings e ON e.vec_id = u.note),
bt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY bm25 DESC, note, part) AS wr FROM mt) FULL JOIN (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sem DESC, note, part) AS sr FROM cs) USING (query, note, part)),
b2 AS (SELECT *, max(sem) OVER (PARTITION BY query) IS NOT NULL AS hybrid, max(CASE WHEN wr = 1 THEN bm25 END) OVER (PARTITION BY query) AS best, row_number() OVER (PARTITION BY query, sem IS NULL AND wr IS NOT NULL ORDER BY wr) AS lone FROM bt),
b3 AS (SELECT *, CASE WHEN best >= 0 THEN wr WHEN sem IS NULL AND wr IS NOT NULL THEN CASE WHEN hybrid THEN lone ELSE wr END END AS r FROM b2),
b4 AS (SELECT *, round(coalesce(1.0::DOUBLE / (60 + r), 0) + coalesce(1.0::DOUBLE / (60 + sr), 0), 6) AS fusion FROM b3 WHERE r IS NOT NULL OR sr IS NOT NULL),
b5 AS (SELECT *, max(sem) OVER (PARTITION BY query, note) AS score FROM b4 QUALIFY row_number() OVER (PARTITION BY query, note ORDER BY CASE WHEN NOT hybrid THEN wr END, fusion DESC, part) = 1),
hits AS MATERIALIZED (SELECT query, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN NOT hybrid THEN wr END, fusion DESC, note, part) AS rank, note, part, CASE WHEN hybrid THEN 'hybrid' ELSE 'keyword' END AS mode, score, fusion, coalesce(bm25, 0) AS bm25 FROM b5 QUALIFY rank <= {TOP}),
tp AS (SELECT query, note, part FROM hits WHERE rank = 1 AND mode = 'keyword'),
ow AS (SELECT *, real AND (NOT stop OR NOT bool_or(real AND NOT stop) OVER (PARTITION BY query)) AS asked FROM qt),
g AS (SELECT query, max(n) AS n, count(*) FILTER (asked AND tf IS NOT NULL AND df <= least(informative, n // 2)) AS inf, count(*) FILTER (asked) AS k, count(*) FILTER (asked AND tf IS NOT NULL AND df <= least(rare, n // 2)) AS ra,
  coalesce(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))) FILTER (asked), 0) AS got, 2.5 * (coalesce(sum(idf) FILTER (asked), 0) + greatest(0, ln(max(n) - 0.5) - ln(1.5)) * count(*) FILTER (df IS NULL AND NOT stop)) AS most
  FROM ow LEFT JOIN (SELECT tp.query, term, tf, len FROM post JOIN tp USING (note, part)) USING (query, term) GROUP BY query),
v AS (SELECT query, CASE WHEN most > 0 THEN got / most ELSE 0 END AS share, n < 20 OR inf >= 2 OR (inf >= 1 AND share >= 0.25) OR (k > 0 AND ra = k AND share >= 0.12) OR query IN (SELECT query FROM tp JOIN boost USING (query, note)) AS passes FROM g)"""


def notes(spark, d):
    """Live notes that were not mined, by project."""
    current = tables.newest(table(spark, d, "memories"), ["memory_id"], ["rev"])
    return current.where(tables.live() & (F.col("source_type") != "transcript_mined")).select(F.col("project").alias("pool"), F.col("memory_id").alias("note"), "name", "description", "body", "weight", label_list(F.col("labels")).alias("labels"))


def pools(spark, d):
    chunks = tables.newest(table(spark, d, "memory_chunks").select("parent_id", "chunk_index", "chunk_id", "search_text", "rev"), ["parent_id", "chunk_index"], ["rev", "chunk_id"])
    return recall.units_of(notes(spark, d), chunks.select(F.col("parent_id").alias("note"), F.col("chunk_index").alias("part"), "search_text"))


def asked(spark, d):
    current = tables.newest(table(spark, d, "memories"), ["memory_id"], ["rev"])
    return current.where(F.col("memory_id") % EVERY == 0).select(F.col("memory_id").alias("query"), F.col("project").alias("pool"), F.col("description").alias("text"))


def cosines(spark, d, units, queries):
    """The vector of a note stands for its first unit; all vectors against those of the queries, in blocks."""
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    probes = queries.select("query").join(vectors.withColumnRenamed("vec_id", "query"), "query").select("query", F.col("embedding").alias("q"))
    first = units.groupBy("pool", "note").agg(F.min("part").alias("part"))
    scores = ranking.cosine_each(vectors, "vec_id", "embedding", probes, rounded=False).select("query", F.col("id").alias("note"), F.col("score").alias("cosine"))
    return scores.join(first, "note").join(queries.select("query", "pool"), ["query", "pool"]).select("query", "note", "part", "cosine")


@query("ret01_hybrid_recall", f"WITH {RECALL} SELECT query, rank, note, part, mode, score, fusion, bm25, round(share, 6) AS score_share FROM hits LEFT JOIN v USING (query) WHERE mode = 'hybrid' OR passes")
def hybrid_recall(spark, d):
    """Pool, keyword match, boost, fusion, collapse to notes and gate for every query at once."""
    units, queries = pools(spark, d), asked(spark, d)
    r = recall.Recall(units)
    return r.answer(queries, cosines(spark, d, r.units, queries), TOP)


@query("ret02_keyword_recall", f"WITH {RECALL.replace('JOIN embeddings g ON g.vec_id = q0.query', 'JOIN (SELECT * FROM embeddings WHERE vec_id < 0) g ON g.vec_id = q0.query')} SELECT query, rank, note, part, mode, score, fusion, bm25, round(share, 6) AS score_share FROM hits LEFT JOIN v USING (query) WHERE mode = 'hybrid' OR passes")
def keyword_recall(spark, d):
    """The same without vectors: keyword order, and every query has to pass the gate."""
    units, queries = pools(spark, d), asked(spark, d)
    return recall.Recall(units).answer(queries, None, TOP)


@query("mth04_score_share", f"WITH {UNITS}, x AS (SELECT query, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))) AS got, note, part FROM post JOIN qt USING (pool, term) WHERE real GROUP BY ALL), y AS (SELECT query, max(got) AS got FROM x GROUP BY query), z AS (SELECT query, 2.5 * sum(times * idf) AS most FROM qt WHERE real GROUP BY query) SELECT query, round(got / most, 6) AS share FROM y JOIN z USING (query) WHERE most > 0")
def score_share(spark, d):
    """What the best unit reaches of the most that the real terms of a query can score."""
    queries = asked(spark, d)
    r = recall.Recall(pools(spark, d))
    terms = stored(r.query_terms(queries).where("real"))
    got = r.best(terms, 1).groupBy("query").agg(F.max("score").alias("got"))
    most = terms.groupBy("query").agg((2.5 * F.sum(F.col("times") * F.col("idf"))).alias("most")).where("most > 0")
    return got.join(most, "query").select("query", F.round(F.col("got") / F.col("most"), 6).alias("share"))
