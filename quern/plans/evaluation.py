"""Evaluation statistics: sweeps, intervals, paired tests, agreement, trends, sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import scores
from quern.operators import ordered
from quern.registry import query
from quern.session import table

LAB = "l AS (SELECT doc_id, max(label = 'abusive') AS bad FROM doc_labels GROUP BY doc_id), x AS (SELECT doc_id, bad, n_chars FROM l JOIN documents USING (doc_id)), "


def _labelled(spark, d):
    l = table(spark, d, "doc_labels").groupBy("doc_id").agg(F.max(F.col("label") == "abusive").alias("bad"))
    return table(spark, d, "documents").select("doc_id", "n_chars", "source").join(l, "doc_id")


GRID = (0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9)
PAIRS = "v AS (SELECT least(memory_a, memory_b) AS a, greatest(memory_a, memory_b) AS b, arg_max(upper(trim(verdict)), (judged_at, verdict_id)) = 'MERGE' AS same, max(cosine) AS cosine FROM verdicts WHERE upper(trim(verdict)) <> 'UNSURE' GROUP BY ALL)"


@query("agg22_threshold_sweep", f"WITH {PAIRS}, g AS (SELECT unnest({list(GRID)}) AS threshold), c AS (SELECT threshold, count(*) FILTER (cosine >= threshold AND same) AS tp, count(*) FILTER (cosine >= threshold AND NOT same) AS fp, count(*) FILTER (cosine < threshold AND same) AS fn FROM v, g WHERE cosine IS NOT NULL GROUP BY threshold) SELECT threshold::DOUBLE AS threshold, tp, fp, fn, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6)::DOUBLE AS f1 FROM c")
def threshold_sweep(spark, d):
    """Confusion counts of the cosine of judged pairs at each threshold of a grid."""
    v = table(spark, d, "verdicts").where(F.upper(F.trim("verdict")) != "UNSURE").groupBy(F.least("memory_a", "memory_b").alias("a"), F.greatest("memory_a", "memory_b").alias("b")).agg((F.max_by(F.upper(F.trim("verdict")), F.struct("judged_at", "verdict_id")) == "MERGE").alias("same"), F.max("cosine").alias("cosine")).where("cosine is not null")
    x = v.select("same", "cosine", F.explode(F.array(*[F.lit(t) for t in GRID])).alias("threshold"))
    over = F.col("cosine") >= F.col("threshold")
    c = x.groupBy("threshold").agg(F.count_if(over & F.col("same")).alias("tp"), F.count_if(over & ~F.col("same")).alias("fp"), F.count_if(~over & F.col("same")).alias("fn"))
    return c.withColumn("f1", F.round(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6))


W = "(p + 3.8416 / (2 * n) {0} 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)"


@query("sta01_wilson_by_root", f"WITH {LAB} r AS (SELECT root, count(*)::DOUBLE AS n, count(*) FILTER (bad) / count(*)::DOUBLE AS p FROM l JOIN documents USING (doc_id) GROUP BY root) SELECT root, n::BIGINT AS n, round(p, 6) AS rate, round(greatest(0, {W.format('-')}), 6) AS low, round(least(1, {W.format('+')}), 6) AS high FROM r")
def wilson_by_root(spark, d):
    l = table(spark, d, "doc_labels").groupBy("doc_id").agg(F.max(F.col("label") == "abusive").alias("bad"))
    r = table(spark, d, "documents").select("doc_id", "root").join(l, "doc_id").groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("k"))
    low, high = scores.wilson(F.col("k"), F.col("n"))
    return r.select("root", "n", F.round(F.col("k") / F.col("n"), 6).alias("rate"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


RATER = "r AS (SELECT a.label AS a, b.label AS b FROM doc_labels a JOIN doc_labels b ON a.doc_id = b.doc_id AND a.label_id < b.label_id), "


def _twice(spark, d):
    """Pairs of labels of one document; the key is the document, whose labels are few by design."""
    x = table(spark, d, "doc_labels")
    a, b = x.select("doc_id", F.col("label_id").alias("ia"), F.col("label").alias("a")), x.select("doc_id", F.col("label_id").alias("ib"), F.col("label").alias("b"))
    return a.join(b, "doc_id").where("ia < ib")


@query("sta02_mcnemar", f"WITH {RATER} c AS (SELECT count(*) FILTER (a = b) AS same, count(*) FILTER (a = 'abusive' AND b = 'clean') AS first_only, count(*) FILTER (a = 'clean' AND b = 'abusive') AS second_only FROM r), t AS (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) AS tail FROM (SELECT first_only + second_only AS n, unnest(range(0, least(first_only, second_only) + 1)) AS i FROM c)) SELECT same, first_only, second_only, round(least(1.0, 2 * tail), 6) AS p FROM c, t")
def mcnemar(spark, d):
    """Paired counts and the exact two-sided binomial tail of the pairs that differ."""
    r = _twice(spark, d)
    c = r.agg(F.count_if(F.col("a") == F.col("b")).alias("same"), F.count_if((F.col("a") == "abusive") & (F.col("b") == "clean")).alias("first_only"), F.count_if((F.col("a") == "clean") & (F.col("b") == "abusive")).alias("second_only"))
    n = (F.col("first_only") + F.col("second_only")).cast("double")
    # the logarithm of each term from the one before it
    start = F.struct((-n * F.log(F.lit(2.0))).alias("log"), F.lit(0.0).alias("sum"))
    tail = F.aggregate(F.sequence(F.lit(0), F.least("first_only", "second_only").cast("int")), start, lambda s, i: F.struct((s["log"] + F.when(n > i, F.log(n - i) - F.log(i + F.lit(1.0))).otherwise(0.0)).alias("log"), (s["sum"] + F.exp(s["log"])).alias("sum")), lambda s: s["sum"])
    return c.select("same", "first_only", "second_only", F.round(F.least(F.lit(1.0), 2 * tail), 6).alias("p"))


@query("sta06_kappa", f"WITH {RATER} s AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (a = b) AS o, count(*) FILTER (a = 'abusive') AS a1, count(*) FILTER (b = 'abusive') AS b1 FROM r), e AS (SELECT n, o / n AS po, (a1 / n) * (b1 / n) + (1 - a1 / n) * (1 - b1 / n) AS pe FROM s) SELECT n::BIGINT AS n, round((po - pe) / (1 - pe), 6) AS kappa FROM e")
def kappa(spark, d):
    s = _twice(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == F.col("b")).alias("o"), F.count_if(F.col("a") == "abusive").alias("a1"), F.count_if(F.col("b") == "abusive").alias("b1"))
    pa, pb, po = F.try_divide("a1", "n"), F.try_divide("b1", "n"), F.try_divide("o", "n")
    pe = pa * pb + (1 - pa) * (1 - pb)
    return s.select("n", F.round(F.try_divide(po - pe, 1 - pe), 6).alias("kappa"))


@query("sta04_holm", "WITH p AS (SELECT event_type, round(least(1.0, 2 * exp(-2.0 * count(*) * pow(count(*) FILTER (value > 50)::DOUBLE / count(*) - (SELECT count(*) FILTER (value > 50)::DOUBLE / count(*) FROM events), 2))), 6) AS p FROM events GROUP BY event_type), k AS (SELECT *, row_number() OVER (ORDER BY p, event_type) AS i, count(*) OVER () AS m FROM p) SELECT event_type, p, round(least(1.0, max((m - i + 1) * p) OVER (ORDER BY i)), 6) AS adjusted FROM k")
def holm(spark, d):
    """Holm's step-down adjustment of Hoeffding bounds on the chance that a type differs from all; one row a type."""
    x = table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("k"), F.count(F.lit(1)).alias("n"))
    every = F.broadcast(x.agg((F.sum("k") / F.sum("n")).alias("base")))
    p = x.crossJoin(every).select("event_type", F.round(F.least(F.lit(1.0), 2 * F.exp(-2.0 * F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("base"), 2))), 6).alias("p"))
    k = p.withColumn("i", F.row_number().over(Window.orderBy("p", "event_type"))).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy()))
    return k.select("event_type", "p", F.round(F.least(F.lit(1.0), F.max((F.col("m") - F.col("i") + 1) * F.col("p")).over(Window.orderBy("i"))), 6).alias("adjusted"))


@query("sta05_theil_sen", "WITH s AS (SELECT (ts::DATE - DATE '2024-01-01')::BIGINT AS x, count(*)::DOUBLE AS y FROM events GROUP BY 1), p AS (SELECT (b.y - a.y) / (b.x - a.x) AS slope FROM s a JOIN s b ON a.x < b.x) SELECT count(*) AS pairs, round(median(slope), 6) AS slope FROM p")
def theil_sen(spark, d):
    """Median of the pairwise slopes of daily counts; the days of a report are few."""
    s = table(spark, d, "events").groupBy(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("x")).agg(F.count(F.lit(1)).cast("double").alias("y"))
    points = s.agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("p"))
    a = points.select("p", F.explode("p").alias("a"))
    pairs = a.select("a", F.explode("p").alias("b")).where("a.x < b.x")
    return pairs.select(((F.col("b.y") - F.col("a.y")) / (F.col("b.x") - F.col("a.x"))).alias("slope")).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.percentile("slope", F.lit(0.5)), 6).alias("slope"))


@query("agg24_percentiles", "SELECT event_type, max(CASE WHEN i = floor(0.5 * n) + 1 THEN value END) AS p50, max(CASE WHEN i = floor(0.95 * n) + 1 THEN value END) AS p95 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY event_type")
def percentiles(spark, d):
    """The value at index floor(p n) of the sorted values."""
    x = table(spark, d, "events").select("event_type", "value", "event_id")
    n = x.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    x = ordered.numbered(x, ["value", "event_id"], ["event_type"]).join(n, "event_type")
    at = lambda p: F.max(F.when(F.col("i") == F.floor(p * F.col("n")) + 1, F.col("value")))
    return x.groupBy("event_type").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))


@query("sup27_stratified_sample", "SELECT source, doc_id FROM (SELECT lower(trim(source)) AS source, doc_id, row_number() OVER (PARTITION BY lower(trim(source)) ORDER BY sha256(doc_id::VARCHAR || '-17'), doc_id) AS n FROM documents) WHERE n <= 5")
def stratified_sample(spark, d):
    """Five documents a source in the order of a seeded hash (the sampling operator: its limit is the feature)."""
    w = Window.partitionBy("source").orderBy("h", "doc_id")
    x = table(spark, d, "documents").select(F.lower(F.trim("source")).alias("source"), "doc_id", F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit("-17")), 256).alias("h"))
    return x.withColumn("n", F.row_number().over(w)).where("n <= 5").select("source", "doc_id")


@query("set06_split_leak", "WITH a AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 0), b AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 1) SELECT h FROM a INTERSECT SELECT h FROM b")
def split_leak(spark, d):
    """Texts on both sides of a split into even and odd ids."""
    x = table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    return x.where("doc_id % 2 = 0").select("h").intersect(x.where("doc_id % 2 = 1").select("h"))


@query("set02_relevant_notes", "SELECT DISTINCT memory_a AS memory_id FROM verdicts WHERE upper(trim(verdict)) = 'MERGE' EXCEPT SELECT memory_a FROM verdicts WHERE upper(trim(verdict)) = 'CONTRADICT'")
def relevant_notes(spark, d):
    v = table(spark, d, "verdicts").select(F.upper(F.trim("verdict")).alias("v"), F.col("memory_a").alias("memory_id"))
    return v.where("v = 'MERGE'").select("memory_id").subtract(v.where("v = 'CONTRADICT'").select("memory_id"))


@query("sup23_daily_errors", "WITH x AS (SELECT ts::DATE AS day, count(*)::DOUBLE AS n, count(*) FILTER (event_type = 'error') AS k FROM events GROUP BY 1), y AS (SELECT *, k / n AS p FROM x) SELECT day, n::BIGINT AS n, k AS errors, round(least(1, " + W.format("+") + "), 6) AS upper FROM y")
def daily_errors(spark, d):
    x = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return x.withColumn("upper", F.round(scores.wilson(F.col("errors"), F.col("n"))[1], 6))
