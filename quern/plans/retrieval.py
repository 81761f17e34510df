"""Ranking queries over documents, memories, chunks and embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions.scores import dot
from quern.functions.text import label_list, tokens, tokens_with_parts
from quern.operators import ranking, tables
from quern.operators.recall import STOP_WORDS
from quern.plans.trust import HUB, hub_notes
from quern.registry import query
from quern.session import table

ASK = "stale lease table and lockfile after a schema migration when the sandbox has no network"
TOK = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^a-z0-9_.\\-/]+'), lambda t: length(t) >= 2)"
WORDS = "words AS (SELECT doc_id AS id, " + TOK.format("text") + " AS w FROM documents), size AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS avgdl FROM words), "
STATS = WORDS + "each AS (SELECT term, id, count(*) AS tf FROM (SELECT unnest(w) AS term, id FROM words) GROUP BY ALL), freq AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS uses FROM each GROUP BY term), idfs AS (SELECT term, df, uses, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM freq, size), "
BM25 = STATS + f"""q AS (SELECT term, count(*) AS times FROM (SELECT unnest({TOK.format("'" + ASK + "'")}) AS term) GROUP BY term),
terms AS (SELECT i.term, q.times, CASE WHEN i.idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idfs) ELSE i.idf END AS idf FROM idfs i JOIN q USING (term)),
scores AS (SELECT e.id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w.w) / avgdl))), 6) AS score FROM each e JOIN terms USING (term) JOIN words w ON w.id = e.id, size GROUP BY e.id)"""


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


@query("mth02_bm25_scores", f"WITH {BM25} SELECT id, score FROM scores")
def bm25_scores(spark, d):
    return ranking.bm25(_docs(spark, d), "doc_id", "text", ASK)


@query("agg01_corpus_stats", f"WITH {STATS} x AS (SELECT 1) SELECT n, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM freq) AS terms, (SELECT sum(df)::BIGINT FROM freq) AS postings FROM size")
def corpus_stats(spark, d):
    words = ranking.lengths(_docs(spark, d), "doc_id", "text")
    freq = ranking.document_frequency(words).agg(F.count(F.lit(1)).alias("terms"), F.sum("df").alias("postings"))
    return ranking.pool_size(words).select("n", F.round("avgdl", 6).alias("avgdl")).crossJoin(freq)


@query("agg02_df_cut", f"WITH {STATS} h AS (SELECT df, sum(uses)::BIGINT AS uses FROM freq GROUP BY df), r AS (SELECT df, sum(uses) OVER (ORDER BY df) AS run, sum(uses) OVER () AS total FROM h) SELECT m AS mass, min(df) AS cut FROM r, (VALUES (0.25), (0.5), (0.75)) t(m) WHERE run >= m * total GROUP BY m")
def df_cut(spark, d):
    """Smallest document frequency at which the terms up to it hold a share of all uses."""
    freq = ranking.document_frequency(ranking.lengths(_docs(spark, d), "doc_id", "text")).groupBy("df").agg(F.sum("uses").alias("uses"))
    run = freq.select("df", F.sum("uses").over(Window.orderBy("df")).alias("run"), F.sum("uses").over(Window.partitionBy()).alias("total"))
    return run.select("df", "run", "total", F.explode(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("mass")).where("run >= mass * total").groupBy("mass").agg(F.min("df").alias("cut"))


@query("agg03_mean_idf", f"WITH {STATS} x AS (SELECT 1) SELECT round(avg(idf), 6) AS mean_idf, count(*) FILTER (idf < 0) AS negative FROM idfs")
def mean_idf(spark, d):
    words = ranking.lengths(_docs(spark, d), "doc_id", "text")
    freq = ranking.document_frequency(words).crossJoin(F.broadcast(ranking.pool_size(words))).withColumn("idf", ranking.idf(F.col("df"), F.col("n")))
    return freq.agg(F.round(F.avg("idf"), 6).alias("mean_idf"), F.count_if(F.col("idf") < 0).alias("negative"))


STOP = STOP_WORDS


@query("fil05_real_terms", f"WITH {BM25}, t AS (SELECT term, df FROM freq JOIN q USING (term) WHERE term NOT IN {STOP} OR df <= (SELECT n / 20 FROM size)) SELECT e.id, count(*) AS real_terms FROM each e JOIN t USING (term) GROUP BY e.id")
def real_terms(spark, d):
    """Documents that hold a query term which is no stop word, or a stop word that is rare here."""
    words = ranking.lengths(_docs(spark, d), "doc_id", "text")
    asked = spark.createDataFrame([(ASK,)], "q string").select(F.explode(tokens("q")).alias("term")).distinct()
    freq = ranking.document_frequency(words).join(F.broadcast(asked), "term").crossJoin(F.broadcast(ranking.pool_size(words)))
    real = freq.where(~F.col("term").isin(*STOP) | (F.col("df") <= F.col("n") / 20)).select("term")
    return ranking.postings(words).select("id", "term").join(F.broadcast(real), "term").groupBy("id").agg(F.count(F.lit(1)).alias("real_terms"))


@query("mth03_coverage", f"WITH {WORDS} q AS (SELECT DISTINCT unnest({TOK.format(chr(39) + ASK + chr(39))}) AS term), h AS (SELECT DISTINCT id, term FROM (SELECT id, unnest(w) AS term FROM words) JOIN q USING (term)), f AS (SELECT term, count(*) AS df FROM h GROUP BY term), c AS (SELECT q.term, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS v FROM q LEFT JOIN f USING (term), size) SELECT h.id, round(sum(v) / (SELECT sum(v) FROM c), 4) AS coverage FROM h JOIN c USING (term) GROUP BY h.id")
def coverage(spark, d):
    """Share of the query's idf mass that a document holds; unseen terms are charged the highest idf."""
    words = ranking.lengths(_docs(spark, d), "doc_id", "text")
    asked = spark.createDataFrame([(ASK,)], "q string").select(F.explode(tokens("q")).alias("term")).distinct()
    own = F.filter("counts", lambda c: c["term"].isin(*ranking.asked_words(ASK)))
    hits = words.select("id", "len", F.inline(own)).select("id", "term")
    df = F.coalesce("df", F.lit(0))
    worth = asked.join(hits.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term", "left").crossJoin(F.broadcast(ranking.pool_size(words))).select("term", F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5)).alias("v"))
    total = F.broadcast(worth.agg(F.sum("v").alias("total")))
    return hits.join(F.broadcast(worth), "term").crossJoin(total).groupBy("id").agg(F.round(F.sum("v") / F.max("total"), 4).alias("coverage"))


DOT = "list_sum(list_transform(list_zip(e.embedding, p.q), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


CHUNKS = "c AS (SELECT chunk_id AS id, parent_id, list_distinct(" + TOK.format("search_text") + ") AS w FROM (SELECT *, row_number() OVER (PARTITION BY parent_id, chunk_index ORDER BY rev DESC, chunk_id DESC) AS n FROM memory_chunks) WHERE n = 1)"


@query("win03_chunk_collapse", f"WITH {CHUNKS}, s AS (SELECT id, parent_id, len(list_filter(w, lambda t: list_contains(['stale', 'lockfile', 'lease', 'table', 'migration'], t))) AS score FROM c) SELECT parent_id AS parent, arg_max(id, (score, -id)) AS unit, max(score) AS score, count(*) AS units FROM s WHERE score > 0 GROUP BY parent_id")
def chunk_collapse(spark, d):
    """Chunks scored by the query terms they hold, the best one standing for its memory."""
    chunks = tables.newest(table(spark, d, "memory_chunks").select("parent_id", "chunk_index", "chunk_id", "search_text", "rev"), ["parent_id", "chunk_index"], ["rev", "chunk_id"])
    terms = F.array(*[F.lit(x) for x in ("stale", "lockfile", "lease", "table", "migration")])
    units = chunks.select(F.col("chunk_id").alias("id"), "parent_id", F.size(F.array_intersect(tokens("search_text"), terms)).alias("score")).where("score > 0")
    return ranking.collapse(units, "parent_id")


@query("str02_sub_tokens", "WITH w AS (SELECT doc_id, unnest(" + TOK.format("text") + ") AS t FROM documents), p AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[_/.\\-]+'), lambda x: length(x) >= 2) AS parts FROM w) SELECT doc_id, sum(1 + CASE WHEN len(parts) >= 2 THEN len(parts) ELSE 0 END)::BIGINT AS tokens FROM p GROUP BY doc_id")
def sub_tokens(spark, d):
    return _docs(spark, d).select("doc_id", F.size(tokens_with_parts("text")).cast("long").alias("tokens")).where("tokens > 0")


LIVE = "m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY rev DESC) AS n FROM memories) WHERE n = 1), live AS (SELECT * FROM m WHERE archived_at IS NULL AND deleted_at IS NULL)"


def _live(spark, d):
    return tables.newest(table(spark, d, "memories"), ["memory_id"], ["rev"]).where(tables.live())


@query("fil02_pool_filter", f"WITH {LIVE} SELECT root, count(*) AS notes FROM live WHERE root IN ('inlet-lab', 'kelp-ui') OR source_type = 'import' GROUP BY root")
def pool_filter(spark, d):
    """A pool: the live notes of some roots, and imported ones of any."""
    return _live(spark, d).where(F.col("root").isin("inlet-lab", "kelp-ui") | (F.col("source_type") == "import")).groupBy("root").agg(F.count(F.lit(1)).alias("notes"))


@query("fil03_shadowing", f"WITH {LIVE}, k AS (SELECT memory_id, root, regexp_extract(path, '^([a-z]+)_', 1) AS kind FROM live) SELECT kind, arg_min(memory_id, (CASE WHEN root = 'inlet-lab' THEN 0 ELSE 1 END, root, memory_id)) AS memory_id FROM k GROUP BY kind")
def shadowing(spark, d):
    """Of the notes under one key that of the own root hides the others."""
    keyed = _live(spark, d).select("memory_id", "root", F.regexp_extract("path", "^([a-z]+)_", 1).alias("kind"))
    return keyed.groupBy("kind").agg(F.min_by("memory_id", F.struct(F.when(F.col("root") == "inlet-lab", 0).otherwise(1), "root", "memory_id")).alias("memory_id"))


@query("mth07_label_boost", f"WITH {LIVE}, b AS (SELECT memory_id, len(list_filter(list_distinct(list_transform(from_json(labels, '[\"VARCHAR\"]'), lambda x: lower(trim(x)))), lambda x: list_contains(['parser', 'linter', 'router', 'ledger'], x))) AS hits FROM live) SELECT memory_id, round(0.4 * least(hits, 2), 6) AS boost FROM b WHERE hits > 0")
def label_boost(spark, d):
    asked = F.array(*[F.lit(x) for x in ("parser", "linter", "router", "ledger")])
    return _live(spark, d).select("memory_id", F.size(F.array_intersect(label_list(F.col("labels")), asked)).alias("hits")).where("hits > 0").select("memory_id", F.round(0.4 * F.least("hits", F.lit(2)), 6).alias("boost"))


@query("joi12_label_postings", f"WITH {LIVE}, l AS (SELECT DISTINCT memory_id, root, lower(trim(unnest(from_json(labels, '[\"VARCHAR\"]')))) AS label FROM live) SELECT label, count(*) AS df, count(DISTINCT root) AS roots, min(memory_id) AS first_id FROM l WHERE label <> '' GROUP BY label")
def label_postings(spark, d):
    """The label index: notes and roots that carry each label."""
    each = _live(spark, d).select("memory_id", "root", F.explode(label_list(F.col("labels"))).alias("label"))
    return each.groupBy("label").agg(F.count(F.lit(1)).alias("df"), F.countDistinct("root").alias("roots"), F.min("memory_id").alias("first_id"))


# Searches for every row whose id is a multiple of EVERY, against all rows, the row itself too.
EVERY = 100
BM25_EACH = STATS + f"""q AS (SELECT id AS query, term, tf AS times FROM each WHERE id % {EVERY} = 0),
terms AS (SELECT query, i.term, q.times, CASE WHEN i.idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idfs) ELSE i.idf END AS idf FROM idfs i JOIN q USING (term)),
scores AS (SELECT t.query, e.id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w.w) / avgdl))), 6) AS score FROM each e JOIN terms t USING (term) JOIN words w ON w.id = e.id, size GROUP BY t.query, e.id)"""
COS_EACH = f"cos AS (SELECT p.query, e.vec_id AS id, round({DOT}, 4) AS score FROM embeddings e, (SELECT vec_id AS query, embedding AS q FROM embeddings WHERE vec_id % {EVERY} = 0) p)"
IN_EACH = "row_number() OVER (PARTITION BY query ORDER BY score DESC, id)"


def _bm25_each(spark, d, k):
    docs = _docs(spark, d)
    return ranking.bm25_each(docs, "doc_id", "text", docs.where(F.col("doc_id") % EVERY == 0).select(F.col("doc_id").alias("query"), "text"), k)


def _cosines_each(spark, d, k=None, floor=float("-inf")):
    vectors = table(spark, d, "embeddings")
    probes = vectors.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    return ranking.cosine_each(vectors, "vec_id", "embedding", probes, k, floor)


@query("ret01_bm25_topk", f"WITH {BM25_EACH} SELECT query, id, score, {IN_EACH} AS rank FROM scores QUALIFY rank <= 20")
def bm25_topk_each(spark, d):
    return ranking.top_each(_bm25_each(spark, d, 20), 20)


@query("mth05_cosine_topk", f"WITH {COS_EACH} SELECT query, id, score, {IN_EACH} AS rank FROM cos QUALIFY rank <= 20")
def cosine_topk_each(spark, d):
    return ranking.top_each(_cosines_each(spark, d, 20), 20)


@query("win02_hybrid_rrf", f"WITH {BM25_EACH}, {COS_EACH}, a AS (SELECT query, id, {IN_EACH} AS rank FROM scores QUALIFY rank <= 200), b AS (SELECT query, id, {IN_EACH} AS rank FROM cos QUALIFY rank <= 200), f AS (SELECT query, id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY query, id) SELECT query, id, score, {IN_EACH} AS rank FROM f QUALIFY rank <= 50")
def hybrid_rrf_each(spark, d):
    """Both lists of every query at candidate depth 200, fused, top 50; a query with a text or a vector only has one list."""
    a, b = ranking.top_each(_bm25_each(spark, d, 200), 200), ranking.top_each(_cosines_each(spark, d, 200), 200)
    return ranking.top_each(ranking.fuse(a, b, by=("query", "id")), 50)


SELECTED_EACH = f"WITH {COS_EACH}, t AS (SELECT *, max(score) OVER (PARTITION BY query) AS top, {IN_EACH} AS place FROM cos), k AS (SELECT query, id, score, {IN_EACH} AS rank FROM t WHERE (score >= 0.2 OR (place = 1 AND score >= 0.18)) AND score >= top - 0.5)"


def _selected_each(spark, d):
    return ranking.select_rows(_cosines_each(spark, d, floor=0.18), 0.2, 0.5)


@query("fil07_floor_window_rescue", f"{SELECTED_EACH} SELECT * FROM k")
def floor_window_rescue_each(spark, d):
    return _selected_each(spark, d)


@query("win14_hub_demotion", f"{SELECTED_EACH}, {HUB}, hn AS (SELECT note FROM h GROUP BY note HAVING count(*)::DOUBLE / (SELECT count(DISTINCT session) FROM h) > 0.4), f AS (SELECT *, id IN (SELECT note FROM hn) AS hub FROM k), n AS (SELECT *, row_number() OVER (PARTITION BY query, hub ORDER BY rank) AS i FROM f) SELECT query, id, score, hub, row_number() OVER (PARTITION BY query ORDER BY hub, rank) AS rank FROM n WHERE NOT hub OR i <= 2")
def hub_demotion_each(spark, d):
    """Notes that most sessions are shown anyway come last, at most two of them."""
    hubs = hub_notes(spark, d).select(F.col("note").alias("id"), F.lit(True).alias("hub"))
    return ranking.demote(_selected_each(spark, d).join(hubs, "id", "left").withColumn("hub", F.coalesce("hub", F.lit(False))), "hub", 2).select("query", "id", "score", "hub", "rank")


@query("top09_leading_hit", f"WITH {COS_EACH}, t AS (SELECT *, {IN_EACH} AS place, lead(score) OVER (PARTITION BY query ORDER BY score DESC, id) AS next FROM cos) SELECT query, id, score, round(score - next, 4) AS margin FROM t WHERE place = 1 AND score >= 0.2 AND score - next >= 0.05")
def leading_hit_each(spark, d):
    rows = ranking.top_each(_cosines_each(spark, d, 2), 2)
    both = rows.groupBy("query").agg(*[F.max(F.when(F.col("rank") == n, F.col(c))).alias(to) for n, c, to in ((1, "id", "id"), (1, "score", "score"), (2, "score", "next"))])
    return both.where("score >= 0.2 and score - next >= 0.05").select("query", "id", "score", F.round(F.col("score") - F.col("next"), 4).alias("margin"))


@query("str12_excerpt", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents), s AS (SELECT doc_id, pos, line, len(list_filter(list_distinct(" + TOK.format("line") + "), lambda t: list_contains(['stale', 'lockfile', 'lease', 'table'], t))) AS hits FROM l) SELECT doc_id, max(hits) AS hits, arg_max(line, (hits, -pos)) AS line FROM s GROUP BY doc_id HAVING max(hits) > 0")
def excerpt(spark, d):
    """The line of each document with the most query terms, the first of equals."""
    terms = F.array(*[F.lit(x) for x in ("stale", "lockfile", "lease", "table")])
    lines = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("hits", F.size(F.array_intersect(tokens("line"), terms)))
    return lines.where("hits > 0").groupBy("doc_id").agg(F.max("hits").alias("hits"), F.max_by("line", F.struct("hits", -F.col("pos"))).alias("line"))
