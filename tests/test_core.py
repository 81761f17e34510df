import math
import os
import pathlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quern import catalogue
from quern.functions import scores, text
from quern.operators import ranking, tables
from quern.sources import readers

DATA = "/root/testdata/sf0.001"


def test_tokens_and_parts(spark):
    df = spark.createDataFrame([("Run a.b-c/d_ef NOW, x", ), (None,), ("",)], "t string")
    rows = df.select(text.tokens("t").alias("a"), text.tokens_with_parts("t").alias("b")).collect()
    assert rows[0].a == ["run", "a.b-c/d_ef", "now"]
    assert rows[0].b == ["run", "a.b-c/d_ef", "now"]  # only one part has two characters
    assert rows[1].a == rows[2].a == []


def test_bm25_hand_values(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha gamma gamma"), (3, "alpha")], "id long, t string")
    got = {r.id: r.score for r in ranking.bm25(docs, "id", "t", "beta").collect()}
    idf = math.log(3 - 1 + 0.5) - math.log(1.5)
    assert set(got) == {1}
    assert got[1] == pytest.approx(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / 2)), abs=1e-6)
    assert ranking.bm25(docs, "id", "t", "nothing").count() == 0
    assert ranking.bm25(docs.limit(0), "id", "t", "beta").count() == 0


def test_pool_scores_ignore_other_pools(spark):
    a = spark.createDataFrame([(1, "x one"), (2, "x two"), (3, "three four")], "id long, t string")
    more = a.unionByName(spark.createDataFrame([(9, "one one one")], "id long, t string"))
    assert ranking.bm25(a, "id", "t", "one").collect() == ranking.bm25(more.where("id < 9"), "id", "t", "one").collect()


def test_fusion_and_ties(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id long, rank int")
    b = spark.createDataFrame([(2, 1), (1, 2)], "id long, rank int")
    rows = ranking.ranked(ranking.fuse(a, b)).orderBy("rank").collect()
    assert [r.id for r in rows] == [1, 2] and rows[0].score == rows[1].score


def test_every_query_is_searched(spark, monkeypatch):
    import random

    monkeypatch.setattr(ranking, "BLOCK", 7)
    r = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(r.choice(["the", "lease", "table", "stale", f"w{i % 9}"]) for _ in range(r.randint(0, 12)))) for i in range(40)] + [(40, None)], "id long, t string")
    asked = {0: "stale lease lease", 20: "w3 the", 30: "unseen"}
    got = ranking.top_each(ranking.bm25_each(docs, "id", "t", spark.createDataFrame(list(asked.items()), "query long, text string"), 5), 5)
    rows = {}
    for x in got.collect():
        rows.setdefault(x.query, []).append((x.rank, x.id, x.score))
    for q, t in asked.items():
        want = [(x.rank, x.id, x.score) for x in ranking.ranked(ranking.bm25(docs, "id", "t", t), 5).collect()]
        assert sorted(rows.get(q, [])) == [(a, b, pytest.approx(c, abs=2e-6)) for a, b, c in sorted(want)]
    vectors = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(3)]) for i in range(30)] + [(30, None)], "id long, v array<float>")
    probes = vectors.where("id % 10 = 0").selectExpr("id as query", "v as q")
    near = ranking.top_each(ranking.cosine_each(vectors, "id", "v", probes, 4), 4)
    for q in (0, 10, 20):
        want = ranking.ranked(ranking.cosine(vectors.where("v is not null"), "id", "v", probes.where(F.col("query") == q).select("q")), 4)
        assert near.where(F.col("query") == q).select("id", "score", "rank").orderBy("rank").collect() == want.orderBy("rank").collect()
    assert near.where("query = 30").count() == 0


def test_a_veto_names_a_pair(spark):
    from quern.plans import dedup

    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (501, 502), (600, 700)], "a long, b long")
    verdicts = spark.createDataFrame([(2, 1, "contradict "), (700, 600, "CONTRADICT"), (1, 3, "MERGE"), (1, 9, "CONTRADICT")], "memory_a long, memory_b long, verdict string")
    assert sorted(tuple(r) for r in dedup.without_vetoes(pairs, verdicts).collect()) == [(1, 3), (2, 3), (501, 502)]


def test_ranges_reach_every_line(spark):
    from quern.plans import sessions

    lines = spark.range(3, 1003).selectExpr("'t' as transcript", "id as line_no")
    ranges = spark.createDataFrame([("t", 3, 22), ("t", 23, 42), ("t", 40, 990), ("u", 3, 22)], "transcript string, first_line long, last_line long")
    got = {r.first_line: r["count"] for r in sessions.in_ranges(lines, ranges).groupBy("first_line").count().collect()}
    assert got == {3: 20, 23: 20, 40: 951}
    if os.path.isdir(DATA):
        covered = catalogue.queries()["joi07_range_join"](spark, DATA).agg(F.sum("covered")).first()[0]
        assert covered == sessions._calls(spark, DATA).count()


def test_snapshots_hold_every_path(spark):
    from quern.plans import ingest

    data = [("r", f"p{i}", i, f"h{i}", None, f"2026-01-0{1 + i % 3}") for i in range(15)] + [("r", "p0", 99, "new", None, "2026-01-03"), ("r", "p3", 99, "h3", "2026-01-03", "2026-01-03")]
    m = spark.createDataFrame(data, "root string, path string, rev long, content_hash string, deleted_at string, updated_at string").withColumn("updated_at", F.expr("to_timestamp_ntz(updated_at)"))
    old, new = ingest.snapshots(m)
    assert {r.path for r in old.collect()} == {f"p{i}" for i in range(15) if i % 3 < 2}
    assert {r.path for r in new.collect()} == {f"p{i}" for i in range(15) if i != 3}
    got = {r.path: r.op for r in tables.scan_plan(old, new, ["root", "path"]).collect()}
    assert got["p0"] == "update" and got["p3"] == "delete" and got["p2"] == "insert" and got["p6"] == "same"


def test_trust_and_wilson(spark):
    row = spark.range(1).select(scores.trust(F.lit(0.5), F.lit(10), F.lit(8.0), F.lit(1)).alias("t"), *[c.alias(n) for c, n in zip(scores.wilson(F.lit(0), F.lit(0)), "ab")]).first()
    assert row.t == pytest.approx((5 + 6) / 20) and row.a is None and row.b is None


def test_newest_and_scan_plan(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 2, "b"), (2, 1, None)], "k long, rev long, v string")
    assert {(r.k, r.v) for r in tables.newest(df, ["k"], ["rev"]).collect()} == {(1, "b"), (2, None)}
    before = spark.createDataFrame([("a", "h1", False), ("b", "h2", False), ("c", "h3", True), ("d", "h4", False)], "p string, content_hash string, gone boolean")
    after = spark.createDataFrame([("a", "h9"), ("c", "h3"), ("e", "h4"), ("f", "h5")], "p string, content_hash string")
    got = {r.p: r.op for r in tables.scan_plan(before, after, ["p"]).collect()}
    assert got == {"a": "update", "b": "delete", "c": "revive", "d": "delete", "e": "move", "f": "insert"}


def test_upsert_and_insert_ignore(spark):
    old = spark.createDataFrame([(1, "x")], "k long, v string")
    new = spark.createDataFrame([(1, "y"), (2, "z"), (2, "z")], "k long, v string")
    assert {tuple(r) for r in tables.insert_ignore(new, old, ["k"]).collect()} == {(2, "z")}
    assert sorted(tuple(r) for r in tables.upsert(old, new.distinct(), ["k"]).collect()) == [(1, "y"), (2, "z")]


def test_readers(spark, tmp_path: pathlib.Path):
    root = tmp_path / "lab"
    root.mkdir()
    (root / "a.md").write_text("# A\nbody")
    (root / "b.md").write_bytes("# Bé".encode("utf-16"))
    (root / "c.md").write_bytes("# Ç".encode("utf-32"))
    (root / ".hidden.md").write_text("x")
    (root / "blank.md").write_text(" \n")
    notes = {r.path: r.content for r in readers.read_notes(spark, str(root)).collect()}
    assert notes == {"a.md": "# A\nbody", "b.md": "# Bé", "c.md": "# Ç"}
    (tmp_path / "e.jsonl").write_text('{"text": "one", "labels": ["a"]}\nnot json\n{"text": " "}\n')
    assert [r.problem for r in readers.read_entries(spark, str(tmp_path / "e.jsonl")).collect()] == [None, "not JSON", "no text"]


def test_masks(spark):
    df = spark.createDataFrame([("mail a.b@c.example token=abc http://u:pw@h 10.0.0.1",)], "t string")
    assert df.select(text.mask_secrets(F.col("t"))).first()[0] == "mail <email> token=*** http://u:***@h <ip>"


def _plain(value):
    if isinstance(value, (float, Decimal)):
        return "nan" if math.isnan(value) else round(float(value), 5) + 0.0
    return str(value) if isinstance(value, (list, dict)) else value


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in pathlib.Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_its_twin(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    assert len(set(columns)) == len(columns)
    got = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in catalogue.oracle_sql():
        want = duck.execute(catalogue.oracle_sql()[name])
        at = [d[0] for d in want.description]
        assert sorted(at) == columns
        assert got == sorted((tuple(_plain(r[at.index(c)]) for c in columns) for r in want.fetchall()), key=repr)


def test_core_does_not_import_llm():
    root = pathlib.Path(__file__).parent.parent / "quern"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "quern.llm" not in path.read_text()
