"""Queries over rows that match each other in masses: the twin's result, and few rows through shuffles on the way."""

import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern import catalogue
from quern.functions.text import term_counts, tokens
from quern.operators import ranking

LABELS = ("parser", "linter", "router", "ledger")
N = 1200


@pytest.fixture(scope="module")
def crowd(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("crowd"))
    i = F.col("id")
    some = F.udf(lambda k: json.dumps([x for j, x in enumerate(LABELS) if k % 16 >> j & 1]))
    note = F.concat(F.lit("the stale lease of a table in round "), (i % 7).cast("string"), F.lit(" and of part w"), (i % 50).cast("string"))
    none = F.lit(None).cast("timestamp")
    tables = {
        "memories": spark.range(1, N + 1).select(i.alias("memory_id"), F.lit(1).cast("long").alias("rev"), F.lit("p").alias("project"), F.lit("import").alias("source_type"), F.lit("n").alias("name"), note.alias("description"), F.concat(note, F.lit(" body b"), (i % 11).cast("string")).alias("body"), some(i).alias("labels"), F.lit(1.0).alias("weight"), none.alias("archived_at"), none.alias("deleted_at")),
        "memory_chunks": spark.range(0, N).select((i + 1).alias("chunk_id"), (i % 300 + 1).alias("parent_id"), (i % 4).alias("chunk_index"), F.concat(F.lit("chunk of lease table w"), (i % 50).cast("string")).alias("search_text"), F.lit(1).cast("long").alias("rev")).where("parent_id % 4 = 1"),
        "calls": spark.range(1, N + 1).select(i.alias("row_id"), F.concat(F.lit("S"), (i % 60).cast("string")).alias("session"), F.lit("Edit").alias("tool"), F.concat(F.lit('{"target": "src/'), F.element_at(F.array(*map(F.lit, LABELS)), (i % 4 + 1).cast("int")), F.lit("_"), F.element_at(F.array(*map(F.lit, LABELS)), ((i / 4).cast("int") % 4 + 1).cast("int")), F.lit('.py"}')).alias("tool_input"), F.concat(F.lit("stale lease table w"), (i % 50).cast("string"), F.lit(" failed in round "), (i % 9).cast("string")).alias("text"), (i % 3 == 0).alias("is_error")),
        "entries": spark.range(1, N + 1).select(i.alias("entry_id"), F.concat_ws(" ", F.lit("an entry on"), F.when(i % 2 == 0, "parser"), F.when(i % 3 > 0, "linter"), F.when(i % 5 > 0, "ledger")).alias("text")),
        "documents": spark.range(0, N).select(i.alias("doc_id"), note.alias("text")),
        "embeddings": spark.range(0, 150).select(i.alias("vec_id"), F.array(*[F.sin(i * (j + 1)).cast("float") for j in range(4)]).alias("embedding")),
    }
    for name, rows in tables.items():
        rows.repartition(3).write.parquet(f"{d}/{name}.parquet")
    return d


def _moved(spark):
    """Rows written to shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


#: Rows that may move: a few a note and call, never one for each pair of them.
MOST = {'ret07_error_recall': 20000, 'sup13_row_pick': 20000, 'ret10_label_match': 20000, 'ret12_reconcile_candidates': 20000, 'ret01_hybrid_recall': 40000, 'ret02_keyword_recall': 40000, 'mth04_score_share': 3000}


@pytest.mark.parametrize("name", sorted(MOST))
def test_masses_of_matches(spark, crowd, monkeypatch, name):
    monkeypatch.setattr(ranking, "BLOCK", 50)
    ranking.packed.__defaults__ = (50,)
    con = duckdb.connect()
    for table in ("memories", "memory_chunks", "calls", "entries", "documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{crowd}/{table}.parquet/*.parquet'")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # it would join small tables in one task, where nothing moves
    try:
        before = _moved(spark)
        df = catalogue.queries()[name](spark, crowd)
        columns = sorted(df.columns)
        plain = lambda v: round(v, 5) if isinstance(v, float) else v
        got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
        moved = _moved(spark) - before
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        ranking.packed.__defaults__ = (1000,)
    want = con.execute(catalogue.oracle_sql()[name])
    at = [x[0] for x in want.description]
    assert got == sorted((tuple(plain(r[at.index(c)]) for c in columns) for r in want.fetchall()), key=repr)
    assert got and moved < MOST[name], moved


def test_keyword_search_keeps_few_rows_a_task(spark, monkeypatch):
    """What leaves a task is about k rows a query, however many blocks it scored; the best of all are among them."""
    monkeypatch.setattr(ranking.packed, "__defaults__", (20,))
    words = ["lease", "table", "stale", "rare", "lock"]
    docs = spark.createDataFrame([(i, " ".join(words[: i % 5 + 1] + [f"w{i % 13}"] * (i % 7 + 1))) for i in range(600)], "id long, t string").repartition(2)
    asked = spark.createDataFrame([(1, "lease rare w3"), (2, "stale lock w5 w6"), (3, "table")], "query long, text string").coalesce(1)
    some = ranking.bm25_each(docs, "id", "t", asked, 5)
    best = lambda x: sorted(tuple(r) for r in ranking.top_each(x, 5).select("query", "rank", "id", "score").collect())
    assert best(some) == best(ranking.bm25_each(docs, "id", "t", asked))
    assert some.count() < 3 * 2 * 40


def test_deep_lists_leave_a_task_once(spark, monkeypatch):
    """At the depth of a fused search a block is smaller than its list; a task still sends each list once, not each block's."""
    monkeypatch.setattr(ranking.packed, "__defaults__", (20,))
    docs = spark.createDataFrame([(i, " ".join(["lease", "table", "stale"][: i % 3 + 1] + [f"w{i % 17}"] * (i % 11 + 1))) for i in range(600)], "id long, t string").repartition(2)
    asked = spark.createDataFrame([(1, "lease w3"), (2, "stale lease w5 w6")], "query long, text string").coalesce(1)
    some = ranking.bm25_each(docs, "id", "t", asked, 60)
    best = lambda x: sorted(tuple(r) for r in ranking.top_each(x, 60).select("query", "rank", "id", "score").collect())
    assert best(some) == best(ranking.bm25_each(docs, "id", "t", asked))
    assert some.count() < 2 * 2 * 120


def test_search_reads_its_rows_once(spark):
    """However many partitions the queries come in, the rows are read and made into blocks for one of them; counts are those of the column functions."""
    texts = [None, "", "a é", "Ünder_way/x.py İx Kelvin v1.2-b b-", "lease lease\ttable\x00stale"]
    docs = spark.createDataFrame([(i, f"{texts[i % 5]} n{i}" if i % 5 > 1 else texts[i % 5]) for i in range(500)], "id long, t string").repartition(3)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = ranking.bm25_each(docs, "id", "t", docs.select(F.col("id").alias("query"), F.col("t").alias("text")), 5)
        words = ranking.lengths(docs, "id", "t")
        assert got.rdd.getNumPartitions() <= words.rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    same = docs.select("id", F.size(tokens("t")).alias("len"), term_counts(tokens("t")).alias("counts"))
    assert sorted(words.collect()) == sorted(same.collect()) and words.dtypes == same.dtypes


def test_first_block_leaves_few_rows():
    """The first block of a task has no bound yet: its k-th best is one before any row is kept."""
    scores = np.random.default_rng(3).random((900, 40))
    best = ranking.Best(7, single=True)
    best.add(scores, np.arange(40), np.arange(900))
    (pack,) = best.packs.values()
    assert pack["new"] < 2 * 7 * 40
    best.add(scores[::-1] + 1, np.arange(40), np.arange(900, 1800))
    queries, ids, _, got = next(best.rows())
    want = {(q, 1799 - i) for q in range(40) for i in np.argsort(-scores[:, q])[:7]}
    assert set(zip(queries.tolist(), ids.tolist())) == want and got.min() > 1


def test_queries_of_the_same_words_are_scored_once(spark, monkeypatch):
    """Forty queries, two sets of words: two are scored, and all forty get their lists."""
    docs = spark.createDataFrame([(i, " ".join(["lease", "table", "stale"][: i % 3 + 1] + [f"w{i % 7}"] * (i % 5 + 1))) for i in range(600)], "id long, t string").repartition(6)
    texts = ["lease w3 w3", "w3 Lease, w3", "stale table w5"]
    asked = spark.createDataFrame([(q, texts[q % 3]) for q in range(40)], "query long, text string")
    scored, sealed = {}, ranking.sealed
    monkeypatch.setattr(ranking, "sealed", lambda df, name: scored.setdefault(name, df.count()) and sealed(df, name))
    got = sorted(tuple(r) for r in ranking.top_each(ranking.bm25_each(docs, "id", "t", asked, 20), 20).select("query", "rank", "id", "score").collect())
    want = {q: [tuple(r)[1:] for r in sorted(ranking.ranked(ranking.bm25(docs, "id", "t", texts[q]), 20).select("rank", "id", "score").collect())] for q in range(3)}
    assert [(q, r, i, s) for q, r, i, s in got if r == 1] and all([(i, s) for a, _, i, s in got if a == q] == want[q % 3] for q in range(40))
    assert scored == {"asks": 2, "block": 600}
