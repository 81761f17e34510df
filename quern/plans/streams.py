"""Streaming jobs, drained, against batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.text import tokens
from quern.plans.notes import CURRENT
from quern.plans.recall import TOK
from quern.registry import query
from quern.session import table
from quern.streaming import jobs

NOTE = "json_extract_string(props, '$.k')::BIGINT"


@query("stm02_unique_events", f"SELECT event_type, count(*) AS n FROM (SELECT DISTINCT user_id, {NOTE} AS note, event_type FROM events) GROUP BY event_type")
def unique_events(spark, d):
    """One event for each user, note and kind."""
    return jobs.unique_events(spark, d, key=("user_id", "note", "event_type")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("stm03_late_data", "WITH x AS (SELECT *, (SELECT max(ts) - INTERVAL 12 HOUR FROM events) AS now FROM events), y AS (SELECT event_type, least(ts, now) AS ts, ts > now AS clamped FROM x WHERE ts <= now + INTERVAL 1 DAY AND ts >= now - INTERVAL 80 DAY) SELECT event_type, count(*) AS kept, count(*) FILTER (clamped) AS clamped, max(ts) AS last_ts FROM y GROUP BY event_type")
def late_data(spark, d):
    now = table(spark, d, "events").agg((F.max("ts") - F.expr("INTERVAL 12 HOURS")).cast("string")).first()[0]
    return jobs.late_events(spark, d, now).groupBy("event_type").agg(F.count(F.lit(1)).alias("kept"), F.count_if("clamped").alias("clamped"), F.max("ts").cast("timestamp_ntz").alias("last_ts"))


@query("stm04_fold_totals", "SELECT user_id, count(*) AS events, max(event_id) AS folded FROM events GROUP BY user_id")
def fold_totals(spark, d):
    return jobs.fold_totals(spark, d)


@query("stm05_citations", f"WITH x AS (SELECT user_id, event_id, event_type, ts, {NOTE} AS note FROM events WHERE event_type IN ('view', 'click')), v AS (SELECT user_id, note, min((ts, event_id)) AS first FROM x WHERE event_type = 'view' GROUP BY ALL) SELECT x.user_id, count(*) AS citations, count(DISTINCT x.note) AS notes FROM x JOIN v USING (user_id, note) WHERE event_type = 'click' AND (x.ts, x.event_id) > v.first GROUP BY x.user_id")
def citations(spark, d):
    return jobs.after_shown(spark, d, "click").groupBy("user_id").agg(F.count(F.lit(1)).alias("citations"), F.countDistinct("note").alias("notes"))


@query("stm06_behavioural_use", f"WITH x AS (SELECT user_id, event_id, event_type, ts, {NOTE} AS note FROM events WHERE event_type IN ('view', 'purchase')), v AS (SELECT user_id, note, min((ts, event_id)) AS first FROM x WHERE event_type = 'view' GROUP BY ALL) SELECT x.user_id, count(*) AS uses, count(DISTINCT x.note) AS notes FROM x JOIN v USING (user_id, note) WHERE event_type = 'purchase' AND (x.ts, x.event_id) > v.first GROUP BY x.user_id")
def behavioural_use(spark, d):
    return jobs.after_shown(spark, d, "purchase").groupBy("user_id").agg(F.count(F.lit(1)).alias("uses"), F.countDistinct("note").alias("notes"))


@query("stm07_sliding_counts", "WITH s AS (SELECT unnest(generate_series((SELECT min(ts)::DATE - 13 FROM events)::TIMESTAMP, (SELECT max(ts)::DATE FROM events)::TIMESTAMP, INTERVAL 1 DAY)) AS start) SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM s JOIN events ON ts >= start AND ts < start + INTERVAL 14 DAY WHERE start + INTERVAL 14 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY ALL")
def sliding_counts(spark, d):
    return jobs.sliding_counts(spark, d).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


@query("stm08_hourly_costs", "SELECT event_type, sum(n)::BIGINT AS n, round(sum(cost), 4) AS cost FROM (SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, sum(value) AS cost FROM events GROUP BY ALL) WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY event_type")
def hourly_costs(spark, d):
    x = jobs.hourly_costs(spark, d)
    return x.groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("cost"), 4).alias("cost"))


@query("stm09_sessions", "WITH x AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS cut FROM events), i AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x), s AS (SELECT user_id, k, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS stop, count(*) AS events FROM i GROUP BY ALL) SELECT user_id, count(*) AS sessions, sum(events)::BIGINT AS events, max(events)::BIGINT AS longest FROM s WHERE stop <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY user_id")
def sessions(spark, d):
    x = jobs.sessions(spark, d)
    return x.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("events").alias("events"), F.max("events").alias("longest"))


@query("stm10_high_water_marks", "SELECT user_id, max(ts) AS mark FROM events GROUP BY user_id")
def high_water_marks(spark, d):
    return jobs.high_water_marks(spark, d).select("user_id", F.col("mark").cast("timestamp_ntz").alias("mark"))


@query("stm12_replayed_events", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def replayed_events(spark, d):
    return jobs.replayed_events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("stm13_maintained_index", f"WITH {CURRENT} SELECT term, count(*) AS df FROM (SELECT memory_id, unnest(list_distinct({TOK.format('description')})) AS term FROM m) GROUP BY term")
def maintained_index(spark, d):
    """Document frequencies after every revision of every note has passed through the stream."""
    m = table(spark, d, "memories").select(F.col("memory_id").alias("note"), "rev", F.array_distinct(tokens("description")).alias("terms"))
    path = jobs.new_folder(spark, "revisions")
    m.write.parquet(path)
    kept = jobs.maintained_index(spark, spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(path))
    return kept.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query("stm11_leases", "WITH x AS (SELECT user_id, ts, event_type, lead(ts) OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS next_ts FROM events) SELECT user_id, count(*) FILTER (event_type = 'error') AS failures, count(*) FILTER (event_type = 'error' AND next_ts IS NOT NULL AND next_ts <= ts + INTERVAL 30 MINUTE) AS retried_early, count(*) FILTER (event_type = 'error' AND (next_ts IS NULL OR next_ts > ts + INTERVAL 6 HOUR)) AS expired FROM x GROUP BY user_id")
def leases(spark, d):
    """Failed work by what came next within its day: a retry before the back-off was over, or a lease that expired."""
    from pyspark.sql import Window

    x = table(spark, d, "events").withColumn("next_ts", F.lead("ts").over(Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")))
    bad = F.col("event_type") == "error"
    early = F.coalesce(F.col("next_ts") <= F.col("ts") + F.expr("INTERVAL 30 MINUTES"), F.lit(False))
    late = F.col("next_ts").isNull() | (F.col("next_ts") > F.col("ts") + F.expr("INTERVAL 6 HOURS"))
    return x.groupBy("user_id").agg(F.count_if(bad).alias("failures"), F.count_if(bad & early).alias("retried_early"), F.count_if(bad & late).alias("expired"))
