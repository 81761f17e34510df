"""Usage events to trust: rollups, report, factors, time split, hubs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import scores
from quern.operators import ordered
from quern.registry import query
from quern.session import table

#: One row a (session, note, kind): session is user and day, note the ``k`` of the properties.
EV = """e AS (SELECT DISTINCT ON (session, note, kind) * FROM (SELECT event_id, ts, user_id::VARCHAR || '-' || strftime(ts, '%Y-%m-%d') AS session, json_extract_string(props, '$.k')::BIGINT AS note,
 CASE WHEN event_type = 'view' THEN 'recall' WHEN event_type IN ('click', 'purchase') THEN 'use' WHEN event_type = 'error' AND value >= 113 THEN 'contradiction' END AS kind FROM events) WHERE kind IS NOT NULL AND note IS NOT NULL ORDER BY session, note, kind, ts, event_id)"""
ROLL = EV + """, roll AS (SELECT note, count(DISTINCT CASE WHEN kind IN ('use', 'contradiction') THEN session END) AS trials, count(DISTINCT CASE WHEN kind = 'use' THEN session END) AS used,
 count(DISTINCT CASE WHEN kind = 'contradiction' THEN session END) AS contradicted, count(DISTINCT CASE WHEN kind = 'recall' THEN session END) AS shown, max(CASE WHEN kind = 'use' THEN ts END) AS last_used FROM e GROUP BY note)"""
SCORED = ROLL + ", t AS (SELECT *, greatest(0.0, least(1.0, (10.0 * 0.6 + greatest(0.0, used - 2.0 * contradicted)) / (10.0 + trials)))::DOUBLE AS trust FROM roll)"


def events(spark, d):
    """Normalised feedback: the earliest event of each (session, note, kind)."""
    x = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "view", "recall").when(F.col("event_type").isin("click", "purchase"), "use").when((F.col("event_type") == "error") & (F.col("value") >= 113), "contradiction")
    x = x.select("event_id", "ts", F.concat_ws("-", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("session"), F.get_json_object("props", "$.k").cast("long").alias("note"), kind.alias("kind"))
    return x.where("kind is not null and note is not null").groupBy("session", "note", "kind").agg(F.min_by(F.struct("ts", "event_id"), F.struct("ts", "event_id")).alias("r")).select("session", "note", "kind", "r.*")


def rollup(spark, d):
    """Distinct sessions by note; a trial is a session with a use or a contradiction."""
    each = events(spark, d).groupBy("note", "session").agg(F.max(F.col("kind") == "use").alias("u"), F.max(F.col("kind") == "contradiction").alias("c"), F.max(F.col("kind") == "recall").alias("r"), F.max(F.when(F.col("kind") == "use", F.col("ts"))).alias("last"))
    return each.groupBy("note").agg(F.count_if(F.col("u") | F.col("c")).alias("trials"), F.count_if("u").alias("used"), F.count_if("c").alias("contradicted"), F.count_if("r").alias("shown"), F.max("last").alias("last_used"))


def scored(spark, d):
    return rollup(spark, d).withColumn("trust", scores.trust(F.lit(0.6), F.col("trials"), F.col("used"), F.col("contradicted")))


@query("agg05_trust_rollup", f"WITH {ROLL} SELECT * FROM roll")
def trust_rollup(spark, d):
    return rollup(spark, d)


@query("mth08_trust_score", f"WITH {SCORED} SELECT note, round(trust, 6) AS trust, round(CASE WHEN trials < 5 THEN 1.0 ELSE greatest(0.8, least(1.25, trust / 0.6)) END, 6)::DOUBLE AS factor FROM t")
def trust_score(spark, d):
    s = scored(spark, d)
    return s.select("note", F.round("trust", 6).alias("trust"), F.round(scores.trust_factor(F.col("trust"), F.col("trials"), F.lit(0.6)), 6).alias("factor"))


@query("mth10_trust_reorder", f"WITH {SCORED}, f AS (SELECT note, round((1.0 / (60 + note)) * CASE WHEN trials < 5 THEN 1.0 ELSE greatest(0.8, least(1.25, trust / 0.6)) END, 6)::DOUBLE AS score FROM t) SELECT note, score, row_number() OVER (ORDER BY score DESC, note) AS rank FROM f")
def trust_reorder(spark, d):
    s = scored(spark, d)
    f = s.select("note", F.round((1.0 / (60 + F.col("note"))) * scores.trust_factor(F.col("trust"), F.col("trials"), F.lit(0.6)), 6).alias("score"))
    return ordered.numbered(f.withColumn("low", -F.col("score")), ["low", "note"], name="rank").drop("low")


@query("tru01_trust_report", f"WITH {SCORED}, k AS (SELECT note, trust, CASE WHEN shown >= 10 AND used = 0 THEN 'retire' WHEN trust >= 0.75 AND trials >= 10 THEN 'promote' WHEN trust < 0.58 THEN 'demote' END AS list FROM t UNION ALL SELECT note, trust, 'fix' FROM t WHERE contradicted >= 2), r AS (SELECT list, note, round(trust, 6) AS trust, row_number() OVER (PARTITION BY list ORDER BY CASE WHEN list = 'promote' THEN -trust ELSE trust END, note) AS place, count(*) OVER (PARTITION BY list) > 500 AS truncated FROM k WHERE list IS NOT NULL) SELECT * FROM r WHERE place <= 500")
def trust_report(spark, d):
    """Retire, promote, demote and fix lists, each capped at 500 places with a flag (the report is a top list)."""
    s = scored(spark, d)
    main = F.when((F.col("shown") >= 10) & (F.col("used") == 0), "retire").when((F.col("trust") >= 0.75) & (F.col("trials") >= 10), "promote").when(F.col("trust") < 0.58, "demote")
    both = s.select("note", "trust", F.explode(F.array_compact(F.array(main, F.when(F.col("contradicted") >= 2, "fix")))).alias("list"))
    size = both.groupBy("list").agg((F.count(F.lit(1)) > 500).alias("truncated"))
    place = F.row_number().over(Window.partitionBy("list").orderBy(F.when(F.col("list") == "promote", -F.col("trust")).otherwise(F.col("trust")), "note"))
    top = both.withColumn("place", place).where("place <= 500")  # cut before the sort, in every task
    return top.join(F.broadcast(size), "list").select("list", "note", F.round("trust", 6).alias("trust"), "place", "truncated")


@query("agg06_session_bounds", f"WITH {EV} SELECT session, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS events FROM e GROUP BY session")
def session_bounds(spark, d):
    return events(spark, d).groupBy("session").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("events"))


@query("win11_sessions_since_use", f"WITH {EV}, s AS (SELECT session, max(ts) AS last_ts FROM e GROUP BY session), n AS (SELECT note, min(ts) AS first_use FROM e WHERE kind = 'use' GROUP BY note) SELECT note, (SELECT count(*) FROM s WHERE last_ts >= first_use) AS sessions FROM n")
def sessions_since_use(spark, d):
    """Sessions that ended at or after a note's first use: a merged running count, no pair is formed."""
    e = events(spark, d)
    ends = e.groupBy("session").agg(F.max("ts").alias("at")).select("at", F.lit(None).cast("long").alias("note"))
    uses = e.where("kind = 'use'").groupBy("note").agg(F.min("ts").alias("at")).select("at", "note")
    line = ends.unionByName(uses).withColumn("day", F.to_date("at"))
    per_day = line.groupBy("day").agg(F.count_if(F.col("note").isNull()).alias("n"))
    later = per_day.select("day", F.coalesce(F.sum("n").over(Window.orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("later"))
    within = F.count_if(F.col("note").isNull()).over(Window.partitionBy("day").orderBy(F.col("at").desc()))
    return line.withColumn("same_day", within).join(later, "day").where("note is not null").select("note", (F.col("same_day") + F.col("later")).alias("sessions"))


HUB = "h AS (SELECT DISTINCT user_id AS session, json_extract_string(props, '$.k')::BIGINT % 40 AS note FROM events WHERE event_type IN ('view', 'click') AND ts > (SELECT max(ts) FROM events) - INTERVAL 14 DAY)"


@query("agg10_hub_notes", f"WITH {HUB} SELECT note, count(*) AS sessions, round(count(*)::DOUBLE / (SELECT count(DISTINCT session) FROM h), 6) AS share FROM h GROUP BY note HAVING count(*)::DOUBLE / (SELECT count(DISTINCT session) FROM h) > 0.4 AND (SELECT count(DISTINCT session) FROM h) >= 10")
def hub_notes(spark, d):
    """Notes shown in more than a share of the sessions of the last 14 days."""
    x = table(spark, d, "events")
    end = F.broadcast(x.agg(F.max("ts").alias("end")))
    h = x.where(F.col("event_type").isin("view", "click")).crossJoin(end).where(F.col("ts") > F.col("end") - F.expr("INTERVAL 14 DAYS")).select(F.col("user_id").alias("session"), (F.get_json_object("props", "$.k").cast("long") % 40).alias("note")).distinct()
    total = F.broadcast(h.agg(F.countDistinct("session").alias("total")))
    return h.groupBy("note").agg(F.count(F.lit(1)).alias("sessions")).crossJoin(total).where("sessions / total > 0.4 and total >= 10").select("note", "sessions", F.round(F.col("sessions") / F.col("total"), 6).alias("share"))


SPLIT = EV + ", st AS (SELECT session, min(ts) AS start FROM e GROUP BY session), cut AS (SELECT start AS cut FROM (SELECT start, row_number() OVER (ORDER BY start, session) AS i, count(*) OVER () AS n FROM st) WHERE i = ceil(0.7 * n))"


@query("tru03_timesplit_cut", f"WITH {SPLIT} SELECT cut, (SELECT count(*) FROM e WHERE ts < cut) AS train_events, (SELECT count(*) FROM st WHERE start >= cut) AS test_sessions FROM cut")
def timesplit_cut(spark, d):
    e = events(spark, d)
    starts = e.groupBy("session").agg(F.min("ts").alias("start"))
    n = F.broadcast(starts.agg(F.count(F.lit(1)).alias("n")))
    cut = ordered.numbered(starts, ["start", "session"]).crossJoin(n).where(F.col("i") == F.ceil(0.7 * F.col("n"))).select(F.col("start").alias("cut"))
    cut = F.broadcast(cut)
    train = e.crossJoin(cut).where("ts < cut").agg(F.count(F.lit(1)).alias("train_events"))
    test = starts.crossJoin(cut).where("start >= cut").agg(F.count(F.lit(1)).alias("test_sessions"))
    return cut.crossJoin(train).crossJoin(test)


@query("agg25_timesplit_mrr", f"""WITH {SPLIT}, fit AS (SELECT note, greatest(0.0, least(1.0, (6.0 + greatest(0.0, count(DISTINCT CASE WHEN kind = 'use' THEN session END) - 2.0 * count(DISTINCT CASE WHEN kind = 'contradiction' THEN session END))) / (10.0 + count(DISTINCT CASE WHEN kind IN ('use', 'contradiction') THEN session END)))) AS trust FROM e, cut WHERE ts < cut GROUP BY note),
rel AS (SELECT e.session, e.note FROM e JOIN st USING (session), cut WHERE start >= cut AND kind = 'use'), shown AS (SELECT DISTINCT e.session, e.note FROM e JOIN st USING (session), cut WHERE start >= cut AND kind IN ('recall', 'use')),
o AS (SELECT s.session, s.note, row_number() OVER (PARTITION BY s.session ORDER BY coalesce(round(trust, 6), 0.6) DESC, s.note) AS rank FROM shown s LEFT JOIN fit USING (note)),
f AS (SELECT session, min(rank) AS first FROM o JOIN rel USING (session, note) GROUP BY session) SELECT count(*) AS sessions, round(avg(1.0 / first), 6) AS mrr, round(avg(CASE WHEN first <= 3 THEN 1.0 ELSE 0.0 END), 6) AS hit3 FROM f""")
def timesplit_mrr(spark, d):
    """Trust learnt before the cut orders the notes of the sessions that start after it."""
    e = events(spark, d)
    cut = F.broadcast(timesplit_cut(spark, d).select("cut"))
    before = e.crossJoin(cut).where("ts < cut").groupBy("note", "session").agg(F.max(F.col("kind") == "use").alias("u"), F.max(F.col("kind") == "contradiction").alias("c"))
    fit = before.groupBy("note").agg(F.count_if("u").alias("used"), F.count_if("c").alias("contra"), F.count_if(F.col("u") | F.col("c")).alias("trials")).select("note", F.round(scores.trust(F.lit(0.6), F.col("trials"), F.col("used"), F.col("contra")), 6).alias("trust"))
    test = e.groupBy("session").agg(F.min("ts").alias("start")).crossJoin(cut).where("start >= cut").select("session")
    units = e.join(test, "session").where("kind <> 'contradiction'").groupBy("session", "note").agg(F.max(F.col("kind") == "use").alias("relevant")).join(fit, "note", "left")
    w = Window.partitionBy("session").orderBy(F.coalesce("trust", F.lit(0.6)).desc(), "note")
    first = units.withColumn("rank", F.row_number().over(w)).where("relevant").groupBy("session").agg(F.min("rank").alias("first"))
    return first.agg(F.count(F.lit(1)).alias("sessions"), F.round(F.avg(1.0 / F.col("first")), 6).alias("mrr"), F.round(F.avg((F.col("first") <= 3).cast("double")), 6).alias("hit3"))


@query("agg09_pool_rate", f"WITH {ROLL} SELECT sum(used)::BIGINT AS used, sum(shown)::BIGINT AS shown, round(sum(used)::DOUBLE / sum(shown), 6) AS rate FROM roll")
def pool_rate(spark, d):
    return rollup(spark, d).agg(F.sum("used").alias("used"), F.sum("shown").alias("shown")).select("*", F.round(F.try_divide("used", "shown"), 6).alias("rate"))


@query("agg07_stale_rollups", f"WITH {EV}, n AS (SELECT note AS memory_id, max(event_id) AS newest FROM e GROUP BY note), c AS (SELECT memory_id, max(folded_event_id) AS folded FROM counts GROUP BY memory_id) SELECT memory_id, newest, folded FROM n LEFT JOIN c USING (memory_id) WHERE newest > coalesce(folded, 0)")
def stale_rollups(spark, d):
    """Notes with an event that is newer than the last one folded into their counts."""
    n = events(spark, d).groupBy(F.col("note").alias("memory_id")).agg(F.max("event_id").alias("newest"))
    c = table(spark, d, "counts").groupBy("memory_id").agg(F.max("folded_event_id").alias("folded"))
    return n.join(c, "memory_id", "left").where("newest > coalesce(folded, 0)").select("memory_id", "newest", "folded")


@query("stm03_late_events", "SELECT event_type, count(*) AS kept, min(ts) AS first_ts FROM events WHERE ts <= (SELECT max(ts) FROM events) AND ts >= (SELECT max(ts) FROM events) - INTERVAL 20 DAY GROUP BY event_type")
def late_events(spark, d):
    """Events within the lateness bound of the newest one."""
    x = table(spark, d, "events")
    end = F.broadcast(x.agg(F.max("ts").alias("end")))
    return x.crossJoin(end).where(F.col("ts") >= F.col("end") - F.expr("INTERVAL 20 DAYS")).groupBy("event_type").agg(F.count(F.lit(1)).alias("kept"), F.min("ts").alias("first_ts"))
