"""Search variants, statistics, generators and the pluggable surfaces."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import pluggable
from quern.functions.text import flat, label_list, tokens, tokens_with_parts
from quern.operators import labelsets, ordered, ranking, tables
from quern.operators.recall import STOP_WORDS
from quern.plans.lifecycle import FLAT, TOPS, _tops
from quern.plans.notes import CURRENT, chunk_text, current
from quern.plans.recall import STOPS, TOK
from quern.plans.relations import LABELS, TARGET, call_words
from quern.plans.sessions import ONE, _calls
from quern.plans.trust import EV, events, rollup
from quern.registry import query
from quern.session import stored, table

SHARED = "shared-platform-notes"


@query("fil03_path_shadowing", f"WITH {CURRENT}, live AS (SELECT * FROM m WHERE archived_at IS NULL AND deleted_at IS NULL AND source_type <> 'transcript_mined'), k AS (SELECT root, regexp_extract(path, '^([a-z]+_[a-z]+)', 1) AS p, memory_id FROM live) SELECT DISTINCT o.root AS own_root, s.memory_id AS hidden FROM k s JOIN k o ON o.p = s.p AND o.root <> s.root WHERE s.root = '{SHARED}' AND s.p <> ''")
def path_shadowing(spark, d):
    """For each root the notes of the shared root that a note of its own hides by its path (the head of the file name)."""
    k = current(spark, d).where(tables.live() & (F.col("source_type") != "transcript_mined")).select("root", F.regexp_extract("path", "^([a-z]+_[a-z]+)", 1).alias("p"), "memory_id").where("p <> ''")
    own = k.where(F.col("root") != SHARED).select(F.col("root").alias("own_root"), "p").distinct()
    return k.where(F.col("root") == SHARED).select("p", F.col("memory_id").alias("hidden")).join(own, "p").select("own_root", "hidden").distinct()


@query("fil04_general_notes", f"WITH {CURRENT}, n AS (SELECT memory_id, root, lower({FLAT.format('description')}) AS t FROM m WHERE trim(description) <> '' AND deleted_at IS NULL) SELECT m.memory_id, EXISTS (SELECT 1 FROM n a JOIN n b ON a.t = b.t AND a.root <> b.root WHERE a.memory_id = m.memory_id) AS is_general FROM m")
def general_notes(spark, d):
    """Notes whose statement also stands in another root count as general; a count of roots by statement, no pairs."""
    m = current(spark, d)
    n = m.where("trim(description) <> '' and deleted_at is null").select("memory_id", "root", F.lower(flat(F.col("description"))).alias("t"))
    wide = n.select("t", "root").distinct().groupBy("t").agg(F.count(F.lit(1)).alias("roots")).where("roots > 1")
    general = n.join(wide, "t", "left_semi").select("memory_id").withColumn("g", F.lit(True))
    return m.select("memory_id").join(general, "memory_id", "left").select("memory_id", F.coalesce("g", F.lit(False)).alias("is_general"))


LANDING = ("gateway", "notifier", "exporter", "builder", "runner")


@query("fil12_landing_rules", f"WITH {CURRENT}, l AS (SELECT memory_id, {LABELS} AS l FROM m) SELECT memory_id, len(l) AS triggers, len(list_filter(l, lambda x: x IN {LANDING})) AS landing FROM l WHERE len(l) > 0 AND 2 * len(list_filter(l, lambda x: x IN {LANDING})) >= len(l)")
def landing_rules(spark, d):
    """Notes at least half of whose triggers are about landing a change."""
    l = label_list(F.col("labels"))
    hit = F.size(F.filter(l, lambda x: x.isin(*LANDING)))
    x = current(spark, d).select("memory_id", F.size(l).cast("bigint").alias("triggers"), hit.cast("bigint").alias("landing"))
    return x.where("triggers > 0 and 2 * landing >= triggers")


GLOBS = ("src/**", "*.sql", "tests/*_[a-m]*.py", "**/runner_*", "docs/?????*.md")


def glob_regex(glob: str) -> str:
    """A glob as a pattern for both engines: ``**`` crosses folders, ``*`` and ``?`` don't; one without a slash is about the file name."""
    out, i = "", 0
    while i < len(glob):
        if glob[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        elif glob[i] == "[" and "]" in glob[i:]:
            end = glob.index("]", i)
            out, i = out + glob[i : end + 1], end + 1
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]", ".": "[.]"}.get(glob[i], glob[i]), i + 1
    return ("^" if "/" in glob else "(?:^|/)") + out + "$"


@query("fil19_scope_match", "WITH g AS (SELECT unnest([" + ", ".join(f"'{g}'" for g in GLOBS) + "]) AS scope, unnest([" + ", ".join(f"'{glob_regex(g)}'" for g in GLOBS) + f"]) AS pattern), t AS (SELECT {TARGET} AS target, count(*) AS calls FROM calls WHERE json_valid(tool_input) GROUP BY 1) SELECT scope, count(*) AS targets, sum(calls)::BIGINT AS calls FROM t, g WHERE regexp_matches(target, pattern) GROUP BY scope")
def scope_match(spark, d):
    """Targets in the scope of rules; the patterns are part of the plan, a target is looked at once."""
    t = table(spark, d, "calls").where(F.try_parse_json("tool_input").isNotNull()).groupBy(F.get_json_object("tool_input", "$.target").alias("target")).agg(F.count(F.lit(1)).alias("calls"))
    hit = F.array_compact(F.array(*[F.when(F.col("target").rlike(glob_regex(g)), F.lit(g)) for g in GLOBS]))
    return t.select("target", "calls", F.explode(hit).alias("scope")).groupBy("scope").agg(F.count(F.lit(1)).alias("targets"), F.sum("calls").alias("calls"))


@query("agg15_budget_window", "WITH n AS (SELECT max(ts) AS hi FROM events), x AS (SELECT user_id, count(*) AS calls, sum(ceil(value * 4))::BIGINT AS tokens, sum(least(value, 60)) AS seconds, round(sum(value) / 100, 6) AS cost FROM events, n WHERE ts > hi - INTERVAL 1 DAY AND value > 0 GROUP BY user_id) SELECT user_id, calls, tokens, round(seconds, 4) AS seconds, cost, calls > 20 OR tokens > 3000 OR cost > 8 AS over FROM x")
def budget_window(spark, d):
    """Calls, tokens, seconds and cost of the last day by owner, against limits."""
    x = table(spark, d, "events")
    n = F.broadcast(x.agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("lo")))
    g = x.where("value > 0").crossJoin(n).where("ts > lo").groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.ceil(F.col("value") * 4)).alias("tokens"), F.round(F.sum(F.least("value", F.lit(60.0))), 4).alias("seconds"), F.round(F.sum("value") / 100, 6).alias("cost"))
    return g.withColumn("over", (F.col("calls") > 20) | (F.col("tokens") > 3000) | (F.col("cost") > 8))


@query("win06_running_numbers", f"WITH {ONE} SELECT lower(trim(session, ' ' || chr(10) || chr(9))) AS session, transcript, line_no, row_number() OVER (PARTITION BY lower(trim(session, ' ' || chr(10) || chr(9))) ORDER BY transcript, line_no) AS seq FROM c")
def running_numbers(spark, d):
    """Lines numbered through a session over all its transcripts."""
    x = _calls(spark, d).select(F.lower(F.trim("session", F.lit(" \n\t"))).alias("session"), "transcript", "line_no")
    return ordered.numbered(x, ["transcript", "line_no"], ["session"], "seq")


@query("win08_previous_turn", f"WITH {ONE}, x AS (SELECT transcript, line_no, role, prompt, last_value(CASE WHEN role = 'assistant' AND trim(text) <> '' THEN text END IGNORE NULLS) OVER (PARTITION BY transcript ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c) SELECT transcript, line_no, sha256(before) AS before FROM x WHERE role = 'user' AND prompt IS NOT NULL AND before IS NOT NULL")
def previous_turn(spark, d):
    """What the assistant said last before each prompt."""
    said = F.when((F.col("role") == "assistant") & (F.trim("text") != ""), F.sha2("text", 256))
    x = ordered.scan(_calls(spark, d).select("transcript", "line_no", "role", "prompt", said.alias("said")), ["transcript"], ["line_no"], before={"before": F.col("said")})
    return x.where("role = 'user' and prompt is not null and before is not null").select("transcript", "line_no", "before")


SUB = "list_distinct(flatten(list_transform({0}, lambda t: CASE WHEN len(list_filter(regexp_split_to_array(t, '[_/.\\-]+'), lambda p: length(p) >= 2)) >= 2 THEN list_concat([t], list_filter(regexp_split_to_array(t, '[_/.\\-]+'), lambda p: length(p) >= 2)) ELSE [t] END)))"
WORDS = f"{CURRENT}, w AS (SELECT memory_id AS id, list_distinct({TOK.format('description')}) AS w FROM m), n AS (SELECT count(*)::DOUBLE AS n FROM w), f AS (SELECT t, ln(1 + (n - df + 0.5) / (df + 0.5)) AS v FROM (SELECT t, count(*) AS df FROM (SELECT unnest(w) AS t FROM w) GROUP BY t), n), qq AS (SELECT id AS query, unnest(list_filter(w, lambda t: t NOT IN ({STOPS}))) AS t FROM w WHERE id % 100 = 0)"


def _terms(spark, d, words=None):
    """(notes (id, w), weights (t, v), query terms (query, t))."""
    m = current(spark, d)
    w = m.select(F.col("memory_id").alias("id"), F.array_distinct((words or tokens)("description")).alias("w"))
    n = F.broadcast(w.agg(F.count(F.lit(1)).cast("double").alias("n")))
    f = w.select(F.explode("w").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).crossJoin(n).select("t", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("v"))
    q = w.where("id % 100 = 0").select(F.col("id").alias("query"), F.explode(F.filter("w", lambda t: ~t.isin(*STOP_WORDS))).alias("t"))
    return w, f, q


@query("ret03_rerank", f"WITH {CURRENT}, c AS (SELECT p.vec_id AS query, e.vec_id AS id, row_number() OVER (PARTITION BY p.vec_id ORDER BY round(list_sum(list_transform(list_zip(e.embedding, p.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 4) DESC, e.vec_id) AS rank FROM embeddings p, embeddings e WHERE p.vec_id % 100 = 0 QUALIFY rank <= 20), s AS (SELECT memory_id AS id, {SUB.format(TOK.format('description'))} AS s FROM m), h AS (SELECT c.query, c.id, c.rank, len(list_intersect(a.s, b.s)) AS hits FROM c JOIN s a ON a.id = c.query JOIN s b ON b.id = c.id), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY hits DESC, id) AS word_rank FROM h) SELECT query, id, round(1.0::DOUBLE / (60 + rank) + CASE WHEN hits > 0 THEN 1.0::DOUBLE / (60 + word_rank) ELSE 0 END, 6) AS fusion, row_number() OVER (PARTITION BY query ORDER BY round(1.0::DOUBLE / (60 + rank) + CASE WHEN hits > 0 THEN 1.0::DOUBLE / (60 + word_rank) ELSE 0 END, 6) DESC, id) AS place FROM k")
def rerank(spark, d):
    """The twenty nearest notes of a query, fused with their order by shared words and parts of words."""
    v = table(spark, d, "embeddings")
    near = ranking.top_each(ranking.cosine_each(v, "vec_id", "embedding", v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q")), 20), 20)
    s = current(spark, d).select(F.col("memory_id").alias("id"), F.array_distinct(tokens_with_parts("description")).alias("s"))
    h = near.join(s, "id").join(s.toDF("query", "qs"), "query").select("query", "id", "rank", F.size(F.array_intersect("s", "qs")).alias("hits"))
    w = Window.partitionBy("query")
    k = h.withColumn("word_rank", F.row_number().over(w.orderBy(F.col("hits").desc(), "id")))
    k = k.withColumn("fusion", F.round(1.0 / (60 + F.col("rank")) + F.when(F.col("hits") > 0, 1.0 / (60 + F.col("word_rank"))).otherwise(0.0), 6))
    return k.select("query", "id", "fusion", F.row_number().over(w.orderBy(F.col("fusion").desc(), "id")).alias("place"))


@query("ret05_fallback_search", f"WITH {WORDS}, g AS (SELECT qq.query, sum(coalesce(v, (SELECT max(v) FROM f))) AS most FROM qq LEFT JOIN f USING (t) GROUP BY ALL), s AS (SELECT qq.query, w2.id, sum(v) AS got FROM qq JOIN (SELECT id, unnest(w) AS t FROM w) w2 USING (t) JOIN f USING (t) GROUP BY ALL) SELECT query, id, round(got / most, 6) AS share, row_number() OVER (PARTITION BY query ORDER BY round(got / most, 6) DESC, id) AS place FROM s JOIN g USING (query) QUALIFY place <= 10")
def fallback_search(spark, d):
    """Share of a query's weight that a note holds; unknown words are charged the highest weight."""
    w, f, q = _terms(spark, d)
    top = F.broadcast(f.agg(F.max("v").alias("top")))
    most = q.join(f, "t", "left").crossJoin(top).groupBy("query").agg(F.sum(F.coalesce("v", "top")).alias("most"))
    got = q.join(f, "t").join(w.select("id", F.explode("w").alias("t")), "t").groupBy("query", "id").agg(F.sum("v").alias("got"))
    s = got.join(most, "query").select("query", "id", F.round(F.col("got") / F.col("most"), 6).alias("score"))
    return ranking.top_each(s, 10).select("query", "id", F.col("score").alias("share"), F.col("rank").alias("place"))


@query("ret06_fresh_rows", f"WITH {TOPS}, e AS (SELECT max(updated_at) AS now FROM memories) SELECT h.query, h.id FROM h JOIN m ON m.memory_id = h.id, e WHERE hits >= 2 AND m.updated_at > now - INTERVAL 30 DAY AND NOT EXISTS (SELECT 1 FROM k WHERE k.query = h.query AND k.id = h.id)")
def fresh_rows(spark, d):
    """Notes of the last month that share two words with a query and aren't among its top rows yet."""
    m = current(spark, d)
    now = F.broadcast(table(spark, d, "memories").agg((F.max("updated_at") - F.expr("INTERVAL 30 DAYS")).alias("start")))
    fresh = m.crossJoin(now).where("updated_at > start").select(F.col("memory_id").alias("id"), F.explode(F.array_distinct(tokens("description"))).alias("t"))
    q = m.where("memory_id % 100 = 0").select(F.col("memory_id").alias("query"), F.explode(F.filter(F.array_distinct(tokens("description")), lambda t: ~t.isin(*STOP_WORDS))).alias("t"))
    hits = q.join(fresh, "t").groupBy("query", "id").agg(F.count(F.lit(1)).alias("hits")).where("hits >= 2")
    return hits.join(_tops(spark, d).select("query", "id"), ["query", "id"], "left_anti").select("query", "id")


@query("ret07_error_recall", f"WITH {CURRENT}, w AS (SELECT memory_id AS id, list_distinct({TOK.format(chr(39) + chr(39)).replace(chr(39) * 2, 'body', 1)}) AS w FROM m), n AS (SELECT count(*)::DOUBLE AS n FROM w), p AS (SELECT id, unnest(w) AS t FROM w), f AS (SELECT t, ln(1 + (n - df + 0.5) / (df + 0.5)) AS v FROM (SELECT t, count(*) AS df FROM p GROUP BY t), n), q0 AS (SELECT DISTINCT {FLAT.format('text')} AS line FROM calls WHERE is_error AND trim(text) <> ''), q AS (SELECT line, unnest(list_filter(list_distinct({TOK.format('line')}), lambda t: t NOT IN ({STOPS}))) AS t FROM q0), g AS (SELECT line, sum(coalesce(v, (SELECT max(v) FROM f))) AS most FROM q LEFT JOIN f USING (t) GROUP BY ALL), s AS (SELECT line, id, round(sum(v) / max(most), 6) AS share FROM q JOIN p USING (t) JOIN f USING (t) JOIN g USING (line) GROUP BY ALL) SELECT sha256(line) AS error, id, share FROM s WHERE share >= 0.39 QUALIFY row_number() OVER (PARTITION BY line ORDER BY share DESC, id) <= 2".replace("coalesce(body, body)", "coalesce(body, '')"))
def error_recall(spark, d):
    """The two notes that hold most of an error's weight, from a share of 0.39 up."""
    m = stored(current(spark, d).select(F.col("memory_id").alias("id"), F.array_distinct(tokens("body")).alias("words")))
    n = F.broadcast(m.agg(F.count(F.lit(1)).cast("double").alias("n")))
    f = stored(m.select(F.explode("words").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).crossJoin(n).select("t", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("v")))
    top = F.broadcast(f.agg(F.max("v").alias("top")))
    q = table(spark, d, "calls").where("is_error and trim(text) <> ''").select(flat(F.col("text")).alias("line")).distinct()
    q = stored(q.select(F.monotonically_increasing_id().alias("query"), F.sha2("line", 256).alias("error"), F.filter(F.array_distinct(tokens("line")), lambda t: ~t.isin(*STOP_WORDS)).alias("terms")))
    terms = q.select("query", F.explode("terms").alias("t")).join(f, "t", "left").crossJoin(top)
    asked = terms.groupBy("query").agg(F.sum(F.coalesce("v", "top")).alias("most"), F.collect_list(F.when(F.col("v").isNotNull(), F.col("t"))).alias("terms"), F.collect_list("v").alias("weights"))
    s = ranking.share_each(m, asked, 2, 0.39).withColumn("score", F.round("score", 6)).where("score >= 0.39")
    return ranking.top_each(s, 2).join(q, "query").select("error", "id", F.col("score").alias("share"))


@query("ret08_history", "WITH r AS (SELECT DISTINCT memory_id, rev, content_hash, updated_at FROM memories), c AS (SELECT parent_id AS memory_id, count(DISTINCT chunk_index) AS parts, max(rev) AS newest_part FROM memory_chunks GROUP BY 1) SELECT memory_id, count(*) AS revisions, count(DISTINCT content_hash) AS texts, max(rev) AS rev, min(updated_at) AS first_at, max(updated_at) AS last_at, coalesce(any_value(parts), 0) AS parts FROM r LEFT JOIN c USING (memory_id) GROUP BY memory_id")
def history(spark, d):
    """A note with its history and its parts."""
    r = table(spark, d, "memories").select("memory_id", "rev", "content_hash", "updated_at").distinct().groupBy("memory_id").agg(F.count(F.lit(1)).alias("revisions"), F.countDistinct("content_hash").alias("texts"), F.max("rev").alias("rev"), F.min("updated_at").alias("first_at"), F.max("updated_at").alias("last_at"))
    c = table(spark, d, "memory_chunks").groupBy(F.col("parent_id").alias("memory_id")).agg(F.countDistinct("chunk_index").alias("parts"))
    return r.join(c, "memory_id", "left").withColumn("parts", F.coalesce("parts", F.lit(0)))


@query("ret09_stage_trace", f"WITH {TOPS} SELECT query, 'pool' AS stage, (SELECT count(*) FROM m) AS rows FROM (SELECT DISTINCT query FROM q) UNION ALL SELECT query, 'matched', count(*) FROM h GROUP BY query UNION ALL SELECT query, 'top', count(*) FROM k GROUP BY query UNION ALL SELECT query, 'short', count(*) FROM k WHERE chars <= 1200 GROUP BY query")
def stage_trace(spark, d):
    """How many rows a query has after each stage."""
    m = current(spark, d)
    q = m.where("memory_id % 100 = 0").select(F.col("memory_id").alias("query"), F.explode(F.filter(F.array_distinct(tokens("description")), lambda t: ~t.isin(*STOP_WORDS))).alias("t"))
    w = m.select(F.col("memory_id").alias("id"), F.explode(F.array_distinct(tokens("description"))).alias("t"))
    n = F.broadcast(m.agg(F.count(F.lit(1)).alias("rows")))
    count = lambda x, stage: x.groupBy("query").agg(F.count(F.lit(1)).alias("rows")).select("query", F.lit(stage).alias("stage"), "rows")
    tops = _tops(spark, d)
    pool = q.select("query").distinct().crossJoin(n).select("query", F.lit("pool").alias("stage"), "rows")
    return pool.unionByName(count(q.join(w, "t").select("query", "id").distinct(), "matched")).unionByName(count(tops, "top")).unionByName(count(tops.where("chars <= 1200"), "short"))


@query("ret11_context", f"WITH {TOPS}, xx AS (SELECT k.*, lower({FLAT.format('m.description')}) AS t FROM k JOIN m ON m.memory_id = k.id), gg AS (SELECT query, t, min(rank) AS rank, arg_min(id, rank) AS id, count(*) AS merged, arg_min(chars, rank) AS chars FROM xx GROUP BY ALL), rr AS (SELECT *, sum(least(chars, 1000)) OVER (PARTITION BY query ORDER BY rank) AS run FROM gg) SELECT query, id, merged, row_number() OVER (PARTITION BY query ORDER BY rank) AS place FROM rr WHERE run <= 6000")
def context(spark, d):
    """The top rows of a query, equal statements merged into the best one, as far as the budget of characters goes."""
    t = current(spark, d).select(F.col("memory_id").alias("id"), F.lower(flat(F.col("description"))).alias("t"))
    g = _tops(spark, d).join(t, "id").groupBy("query", "t").agg(F.min(F.struct("rank", "id", "chars")).alias("r"), F.count(F.lit(1)).alias("merged")).select("query", "r.*", "merged")
    w = Window.partitionBy("query").orderBy("rank")
    r = g.withColumn("run", F.sum(F.least("chars", F.lit(1000))).over(w)).where("run <= 6000")
    return r.select("query", "id", "merged", F.row_number().over(w).alias("place"))


@query("ret12_reconcile_candidates", f"WITH {CURRENT}, l AS (SELECT DISTINCT memory_id, unnest({LABELS}) AS label FROM m WHERE archived_at IS NULL AND deleted_at IS NULL), e AS (SELECT DISTINCT entry_id, unnest(list_distinct(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'))) AS label FROM (SELECT DISTINCT entry_id, text FROM entries)) SELECT entry_id, memory_id, count(*) AS hits, row_number() OVER (PARTITION BY entry_id ORDER BY count(*) DESC, memory_id) AS place FROM e JOIN l USING (label) GROUP BY entry_id, memory_id QUALIFY place <= 5")
def reconcile_candidates(spark, d):
    """The five live notes with most labels among the words of an entry."""
    own = labelsets.sets(current(spark, d).where(tables.live()).select("memory_id", label_list(F.col("labels")).alias("own")), 5)
    labels = own.select(F.explode("own").alias("label")).distinct()
    e = table(spark, d, "entries").select("entry_id", "text").distinct().select("entry_id", F.explode(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+"))).alias("label"))
    e = stored(e.join(labels, "label").groupBy("entry_id").agg(F.array_sort(F.collect_set("label")).alias("asked")))
    asked = stored(e.select("asked").distinct().withColumn("query", F.monotonically_increasing_id()))
    g = labelsets.top_shared(asked, own, 5).join(own.select("id", "notes"), "id").select("query", "hits", F.inline("notes"))
    g = g.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.col("hits").desc(), "memory_id"))).where("place <= 5")
    return e.join(asked, "asked").join(g, "query").select("entry_id", "memory_id", "hits", "place")


@query("mth03_local_score", f"WITH {WORDS}, a AS (SELECT avg(len(w)) AS avgdl FROM w), s AS (SELECT qq.query, p.id, sum(v * 2.2 / (1 + 1.2 * (0.25 + 0.75 * n / avgdl))) AS score FROM qq JOIN (SELECT id, len(w) AS n, unnest(w) AS t FROM w) p USING (t) JOIN f USING (t), a GROUP BY ALL) SELECT query, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, id) AS rank FROM s QUALIFY rank <= 10")
def local_score(spark, d):
    """The small index's score: weights that are never negative, k1 of 1.2, every word once."""
    w, f, q = _terms(spark, d)
    a = F.broadcast(w.agg(F.avg(F.size("w")).alias("avgdl")))
    p = w.select("id", F.size("w").alias("n"), F.explode("w").alias("t"))
    part = F.col("v") * 2.2 / (1 + 1.2 * (0.25 + 0.75 * F.col("n") / F.col("avgdl")))
    s = q.join(f, "t").join(p, "t").crossJoin(a).groupBy("query", "id").agg(F.round(F.sum(part), 6).alias("score"))
    return ranking.top_each(s, 10)


@query("mth09_rate_factor", f"WITH {EV}, r AS (SELECT note, count(DISTINCT CASE WHEN kind = 'recall' THEN session END) AS shown, count(DISTINCT CASE WHEN kind = 'use' THEN session END) AS used FROM e GROUP BY note), p AS (SELECT sum(used)::DOUBLE / sum(shown) AS rate FROM r) SELECT note, round(CASE WHEN shown < 5 THEN 1.0 ELSE greatest(0.8, least(1.25, ((used + 10 * rate) / (shown + 10)) / rate)) END, 6)::DOUBLE AS factor FROM r, p")
def rate_factor(spark, d):
    """The factor of a note from its own use rate, smoothed by ten showings at the pool's rate."""
    r = rollup(spark, d)
    p = F.broadcast(r.agg((F.sum("used") / F.sum("shown")).alias("rate")))
    own = (F.col("used") + 10 * F.col("rate")) / (F.col("shown") + 10) / F.col("rate")
    return r.crossJoin(p).select("note", F.round(F.when(F.col("shown") < 5, 1.0).otherwise(F.greatest(F.lit(0.8), F.least(F.lit(1.25), own))), 6).alias("factor"))


DRAWS = 200
POISSON_SQL = " + ".join(f"(u >= {p})::INT" for p in pluggable.POISSON)


@query("sta03_cluster_bootstrap", f"WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'error')::DOUBLE / count(*) AS v FROM events GROUP BY user_id), d AS (SELECT user_id, v, unnest(range(1, {DRAWS} + 1)) AS draw FROM c), u AS (SELECT *, ('0x' || substr(sha256('17-' || draw || '-' || user_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM d), w AS (SELECT draw, v, {POISSON_SQL} AS w FROM u), s AS (SELECT draw, sum(v * w) / sum(w) AS stat FROM w GROUP BY draw), o AS (SELECT stat, row_number() OVER (ORDER BY stat, draw) AS i FROM s) SELECT round(max(CASE WHEN i = 5 THEN stat END), 6) AS low, round(max(CASE WHEN i = 196 THEN stat END), 6) AS high, round((SELECT avg(v) FROM c), 6) AS mean FROM o")
def cluster_bootstrap(spark, d):
    """A 95 % interval of the mean error rate of users by 200 seeded draws; only the draws are sorted."""
    c = table(spark, d, "events").groupBy("user_id").agg((F.count_if(F.col("event_type") == "error") / F.count(F.lit(1))).alias("v"))
    s = pluggable.bootstrap(c, "user_id", F.col("v"), DRAWS, 17)
    o = s.withColumn("i", F.row_number().over(Window.orderBy("stat", "draw")))
    ends = o.agg(F.round(F.max(F.when(F.col("i") == 5, F.col("stat"))), 6).alias("low"), F.round(F.max(F.when(F.col("i") == 196, F.col("stat"))), 6).alias("high"))
    return ends.crossJoin(c.agg(F.round(F.avg("v"), 6).alias("mean")))


def logistic(rows, x: str, y: str, cluster: str, rounds: int = 8):
    """Intercept and slope of a logistic regression on one column with cluster-robust errors.

    Each round of the weighted least squares is one aggregation that returns five sums; the errors need one more by cluster.
    """
    import math

    a = b = 0.0
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col(x))))
        w, r = p * (1 - p), F.col(y) - p
        s = rows.agg(F.sum(w), F.sum(w * F.col(x)), F.sum(w * F.col(x) * F.col(x)), F.sum(r), F.sum(r * F.col(x))).first()
        if s[0] is None:
            return None
        det = s[0] * s[2] - s[1] * s[1]
        if det <= 1e-12:
            return None
        a, b = a + (s[2] * s[3] - s[1] * s[4]) / det, b + (s[0] * s[4] - s[1] * s[3]) / det
    p = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col(x))))
    r = F.col(y) - p
    g = rows.groupBy(cluster).agg(F.sum(r).alias("g0"), F.sum(r * F.col(x)).alias("g1"))
    m = g.agg(F.sum(F.col("g0") * F.col("g0")), F.sum(F.col("g0") * F.col("g1")), F.sum(F.col("g1") * F.col("g1"))).first()
    inverse = [[s[2] / det, -s[1] / det], [-s[1] / det, s[0] / det]]
    meat = [[m[0], m[1]], [m[1], m[2]]]
    product = lambda u, v: [[sum(u[i][k] * v[k][j] for k in (0, 1)) for j in (0, 1)] for i in (0, 1)]
    cov = product(product(inverse, meat), inverse)
    return a, b, math.sqrt(max(0.0, cov[0][0])), math.sqrt(max(0.0, cov[1][1]))


@query("sta07_logistic")
def logistic_trend(spark, d):
    """Whether errors grow with the time of day; no SQL twin, as the fit is iterated (tested against plain Python)."""
    x = table(spark, d, "events").select("user_id", (F.hour("ts") / 24.0).alias("x"), (F.col("event_type") == "error").cast("double").alias("y"))
    got = logistic(x, "x", "y", "user_id")
    return spark.createDataFrame([tuple(round(v, 6) for v in got)] if got else [], "intercept double, slope double, intercept_error double, slope_error double")


@query("jsn04_json_objects", "WITH o AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\{[^{}]*\\}')) AS o, generate_subscripts(regexp_extract_all(text, '\\{[^{}]*\\}'), 1) AS i FROM documents), v AS (SELECT * FROM o WHERE json_valid(o)) SELECT doc_id, count(*) AS objects, arg_max(json_extract_string(o, '$.decision'), i) FILTER (json_extract_string(o, '$.decision') IS NOT NULL) AS last_decision FROM v GROUP BY doc_id")
def json_objects(spark, d):
    """The flat JSON objects in free text; of those with a decision the last one counts."""
    o = table(spark, d, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"\{[^{}]*\}"), F.lit(0))).alias("i", "o")).where(F.try_parse_json("o").isNotNull())
    decision = F.get_json_object("o", "$.decision")
    return o.groupBy("doc_id").agg(F.count(F.lit(1)).alias("objects"), F.max_by(decision, F.when(decision.isNotNull(), F.col("i"))).alias("last_decision"))


TICKED, JOINER = "`([^`\\n]+)`", r"\s*(?:&&|\|\||;|\|)\s*"


@query("str27_shell_segments", f"WITH c AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{TICKED}', 1)) AS command FROM documents), s AS (SELECT command, unnest(regexp_split_to_array(regexp_replace(command, '''[^'']*''|\"[^\"]*\"', '_', 'g'), '{JOINER}')) AS segment FROM c) SELECT command, trim(segment) AS segment, regexp_extract(regexp_replace(trim(segment), '^(?:sudo|env|time|nohup|[A-Z_]+=\\S*)\\s+', ''), '^([^\\s]+)', 1) AS head, list_sort(list_distinct(regexp_extract_all(segment, '(?:^|\\s)(-[-a-zA-Z]+)', 1))) AS flags FROM s WHERE trim(segment) <> ''")
def shell_segments(spark, d):
    """Commands in back ticks as segments, quoted text masked, wrappers taken off; head and flags of each."""
    c = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(TICKED), F.lit(1))).alias("command")).distinct()
    masked = F.regexp_replace("command", "'[^']*'|\"[^\"]*\"", "_")
    s = c.select("command", F.explode(F.split(masked, JOINER)).alias("segment")).where("trim(segment) <> ''")
    head = F.regexp_extract(F.regexp_replace(F.trim("segment"), r"^(?:sudo|env|time|nohup|[A-Z_]+=\S*)\s+", ""), r"^([^\s]+)", 1)
    return s.select("command", F.trim("segment").alias("segment"), head.alias("head"), F.array_sort(F.array_distinct(F.regexp_extract_all("segment", F.lit(r"(?:^|\s)(-[-a-zA-Z]+)"), F.lit(1)))).alias("flags"))


@query("sup16_flag_insertion", f"WITH c AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{TICKED}', 1)) AS command FROM documents) SELECT command, regexp_replace(command, '^(nobl|relay|packr|sweep|stagectl)\\b', '\\1 --dry-run') AS rewritten FROM c WHERE regexp_matches(command, '^(nobl|relay|packr|sweep|stagectl)\\b') AND NOT contains(command, '--dry-run')")
def flag_insertion(spark, d):
    """Commands of a closed set get a flag that they lack."""
    tool = r"^(nobl|relay|packr|sweep|stagectl)\b"
    c = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(TICKED), F.lit(1))).alias("command")).distinct()
    return c.where(F.col("command").rlike(tool) & ~F.contains("command", F.lit("--dry-run"))).select("command", F.regexp_replace("command", tool, "$1 --dry-run").alias("rewritten"))


@query("str12_excerpt_lines", "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM l), h AS (SELECT doc_id, i, len(list_filter(list_distinct(" + TOK.format("l[i]") + "), lambda t: list_contains(['stale', 'lockfile', 'lease', 'table'], t))) AS hits, array_to_string(l[i:i + 2], chr(10)) AS lines FROM s) SELECT doc_id, max(hits) AS hits, arg_max(lines, (hits, -i)) AS lines FROM h WHERE hits > 0 GROUP BY doc_id")
def excerpt_lines(spark, d):
    """The line of a document with most words of a query and the two lines behind it."""
    terms = F.array(*[F.lit(x) for x in ("stale", "lockfile", "lease", "table")])
    l = table(spark, d, "documents").where("text is not null").select("doc_id", F.split("text", "\n").alias("l"))
    s = l.select("doc_id", "l", F.posexplode("l").alias("i", "line")).select("doc_id", "i", F.size(F.array_intersect(F.array_distinct(tokens("line")), terms)).cast("bigint").alias("hits"), F.array_join(F.slice("l", F.col("i") + 1, F.lit(3)), "\n").alias("lines"))
    return s.where("hits > 0").groupBy("doc_id").agg(F.max("hits").alias("hits"), F.max_by("lines", F.struct("hits", -F.col("i"))).alias("lines"))


@query("str28_packed_windows", "WITH p AS (SELECT doc_id, length(text) AS n, unnest(range(0, length(text), 400)) AS start FROM documents WHERE length(text) > 0) SELECT doc_id, start // 1600 AS window_no, count(*) AS parts, min(start) AS from_char, least(max(start) + 500, any_value(n)) AS to_char FROM p GROUP BY doc_id, start // 1600")
def packed_windows(spark, d):
    """Parts of 500 characters every 400, four to a window; the windows cover the whole text."""
    p = table(spark, d, "documents").where(F.length("text") > 0).select("doc_id", F.length("text").alias("n"), F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(400))).alias("start"))
    g = p.groupBy("doc_id", F.floor(F.col("start") / 1600).alias("window_no")).agg(F.count(F.lit(1)).alias("parts"), F.min("start").cast("bigint").alias("from_char"), F.least(F.max("start") + 500, F.max("n")).cast("bigint").alias("to_char"))
    return g


@query("sup09_binary_split", "WITH n AS (SELECT doc_id, length(text) AS n, greatest(0, ceil(log2(length(text) / 2000.0)))::INT AS depth FROM documents WHERE length(text) > 0), l AS (SELECT *, unnest(range(0, (1 << depth))) AS leaf FROM n) SELECT doc_id, leaf, (leaf * n) // (1 << depth) AS from_char, ((leaf + 1) * n) // (1 << depth) AS to_char FROM l")
def binary_split(spark, d):
    """Texts halved until a part has at most 2,000 characters; the leaves cover every character once."""
    n = table(spark, d, "documents").where(F.length("text") > 0).select("doc_id", F.length("text").cast("bigint").alias("n"))
    n = n.withColumn("leaves", F.expr("shiftleft(1, greatest(0, cast(ceil(log2(n / 2000.0)) as int)))"))
    at = lambda k: F.floor(k * F.col("n") / F.col("leaves"))
    l = n.select("*", F.explode(F.sequence(F.lit(0), F.col("leaves") - 1)).alias("leaf"))
    return l.select("doc_id", F.col("leaf").cast("bigint").alias("leaf"), at(F.col("leaf")).alias("from_char"), at(F.col("leaf") + 1).alias("to_char"))


@query("sup17_field_lint", f"WITH {CURRENT} SELECT memory_id, list_filter([CASE WHEN trim(coalesce(name, '')) = '' THEN 'no name' END, CASE WHEN trim(coalesce(description, '')) = '' THEN 'no description' END, CASE WHEN length(description) > 120 THEN 'long description' END, CASE WHEN NOT regexp_matches(path, '^[a-z0-9_]+\\.md$') THEN 'odd path' END, CASE WHEN lower(trim(coalesce(category, ''))) NOT IN ('user', 'feedback', 'project', 'reference') THEN 'unknown category' END, CASE WHEN NOT json_valid(coalesce(labels, '[]')) THEN 'bad labels' END, CASE WHEN weight <= 0 OR weight > 2 THEN 'odd weight' END], lambda x: x IS NOT NULL) AS problems FROM m")
def field_lint(spark, d):
    """What is wrong with the fields of a note."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    checks = [
        (blank("name"), "no name"), (blank("description"), "no description"), (F.length("description") > 120, "long description"), (~F.col("path").rlike(r"^[a-z0-9_]+\.md$"), "odd path"),
        (~F.lower(F.trim(F.coalesce("category", F.lit("")))).isin("user", "feedback", "project", "reference"), "unknown category"), (F.try_parse_json(F.coalesce("labels", F.lit("[]"))).isNull(), "bad labels"), ((F.col("weight") <= 0) | (F.col("weight") > 2), "odd weight"),
    ]
    return current(spark, d).select("memory_id", F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in checks])).alias("problems"))


@query("sup19_stock_baseline", f"WITH {TOPS}, a AS (SELECT query, id FROM k WHERE rank <= 5), b AS (SELECT query, id FROM (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY chars DESC, id) AS n FROM k) WHERE n <= 3), c AS (SELECT query, query AS id FROM (SELECT DISTINCT query FROM q)) SELECT * FROM a UNION SELECT * FROM b UNION SELECT * FROM c")
def stock_baseline(spark, d):
    """Three plain lists of a query (shared words, longest of those, itself) as one set."""
    k = _tops(spark, d)
    a = k.where("rank <= 5").select("query", "id")
    b = k.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.col("chars").desc(), "id"))).where("n <= 3").select("query", "id")
    asked = current(spark, d).where("memory_id % 100 = 0").where(F.size(F.filter(tokens("description"), lambda t: ~t.isin(*STOP_WORDS))) > 0).select(F.col("memory_id").alias("query"), F.col("memory_id").alias("id"))
    return a.unionAll(b).unionAll(asked).distinct()


@query("sup27_sealed_split", "SELECT lower(trim(source)) AS source, CASE WHEN ('0x' || substr(sha256('5-' || doc_id), 1, 8))::BIGINT % 10 < 3 THEN 'sealed' ELSE 'dev' END AS side, count(*) AS docs, min(doc_id) AS first_id FROM documents GROUP BY ALL")
def sealed_split(spark, d):
    """A seeded split by a hash of the id, counted by source."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit("5-"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("bigint")
    x = table(spark, d, "documents").select(F.lower(F.trim("source")).alias("source"), F.when(h % 10 < 3, "sealed").otherwise("dev").alias("side"), "doc_id")
    return x.groupBy("source", "side").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first_id"))


@query("gen01_fixture", "WITH k AS (SELECT unnest(range(1, 13)) AS kind), w AS (SELECT kind, 1000.0::DOUBLE / kind / (SELECT sum(1.0::DOUBLE / kind) FROM k) AS x FROM k), b AS (SELECT kind, floor(x) AS n, row_number() OVER (ORDER BY x - floor(x) DESC, kind) AS i FROM w), s AS (SELECT kind, (n + (i <= 1000 - (SELECT sum(n) FROM b))::INT)::BIGINT AS n FROM b), r AS (SELECT kind, unnest(range(1, n + 1)) AS item FROM s) SELECT kind, item, 495 + ('0x' || substr(sha256('9-' || kind || '-' || item), 1, 8))::BIGINT % 11660 AS chars FROM r")
def fixture(spark, d):
    """A seeded fixture: a thousand items over twelve kinds by Zipf weights and largest remainders, each with a hashed size."""
    k = spark.range(1, 13).select(F.col("id").alias("kind"))
    total = sum(1 / i for i in range(1, 13))
    x = 1000.0 / F.col("kind") / F.lit(total)
    b = k.select("kind", F.floor(x).alias("n"), (x - F.floor(x)).alias("part"))
    left = F.broadcast(b.agg((1000 - F.sum("n")).alias("left")))
    s = b.withColumn("i", F.row_number().over(Window.orderBy(F.col("part").desc(), "kind"))).crossJoin(left).select("kind", (F.col("n") + (F.col("i") <= F.col("left")).cast("int")).alias("n"))
    r = s.select("kind", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("item"))
    h = F.conv(F.substring(F.sha2(F.concat_ws("-", F.lit("9"), "kind", "item"), 256), 1, 8), 16, 10).cast("bigint")
    return r.select("kind", "item", (495 + h % 11660).alias("chars"))


@query("snk09_projection", f"WITH {CURRENT}, p AS (SELECT memory_id, content_hash, sha256('---' || chr(10) || 'name: ' || coalesce(trim(name), '') || chr(10) || 'category: ' || coalesce(lower(trim(category)), 'note') || chr(10) || '---' || chr(10) || coalesce(replace(body, chr(13), ''), '') || chr(10)) AS file_hash FROM m WHERE deleted_at IS NULL) SELECT memory_id, file_hash, file_hash IS DISTINCT FROM content_hash AS in_outbox FROM p")
def projection(spark, d):
    """The file a note is written to, as a hash, and whether it has to be written."""
    e = F.lit("")
    text = F.concat(F.lit("---\nname: "), F.coalesce(F.trim("name"), e), F.lit("\ncategory: "), F.coalesce(F.lower(F.trim("category")), F.lit("note")), F.lit("\n---\n"), F.coalesce(F.replace("body", F.lit("\r"), e), e), F.lit("\n"))
    x = current(spark, d).where("deleted_at is null").select("memory_id", "content_hash", F.sha2(text, 256).alias("file_hash"))
    return x.select("memory_id", "file_hash", (~F.col("file_hash").eqNullSafe(F.col("content_hash"))).alias("in_outbox"))


@query("snk01_chunk_sync")
def chunk_sync(spark, d):
    """The chunks a note should have against those stored: insert, keep or delete by their text; no SQL twin, as the chunker keeps state."""
    import pandas as pd

    cut = F.pandas_udf(lambda texts: pd.Series([[t for _, t in chunk_text(x)] if x else [] for x in texts]), "array<string>").asNondeterministic()
    want = current(spark, d).where("deleted_at is null").select(F.col("memory_id").alias("parent_id"), F.explode(cut("body")).alias("t")).select("parent_id", F.sha2(flat(F.col("t")), 256).alias("hash")).distinct().withColumn("new", F.lit(True))
    have = tables.newest(table(spark, d, "memory_chunks").select("parent_id", "chunk_index", "chunk_id", "text", "rev"), ["parent_id", "chunk_index"], ["rev", "chunk_id"]).select("parent_id", F.sha2(flat(F.coalesce("text", F.lit(""))), 256).alias("hash")).distinct().withColumn("old", F.lit(True))
    return want.join(have, ["parent_id", "hash"], "full_outer").select("parent_id", "hash", F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").otherwise("keep").alias("op"))


@query("src10_incremental_reload", "WITH k AS (SELECT (epoch_us(min(updated_at)) + epoch_us(max(updated_at))) // 2 AS mid FROM memories), a AS (SELECT memory_id, max(rev) AS rev FROM memories, k WHERE epoch_us(updated_at) <= mid GROUP BY 1), b AS (SELECT memory_id, max(rev) AS rev, arg_max(deleted_at IS NULL, rev) AS alive FROM memories GROUP BY 1) SELECT b.memory_id, CASE WHEN NOT alive THEN 'drop' WHEN a.rev IS NULL THEN 'load' WHEN b.rev > a.rev THEN 'reload' ELSE 'keep' END AS op FROM b LEFT JOIN a USING (memory_id)")
def incremental_reload(spark, d):
    """What a reader that stopped half way has to load, load again, drop or keep."""
    m = table(spark, d, "memories").select("memory_id", "rev", "deleted_at", F.unix_micros(F.col("updated_at").cast("timestamp")).alias("us"))
    k = F.broadcast(m.agg(F.expr("(min(us) + max(us)) div 2").alias("mid")))
    a = m.crossJoin(k).where("us <= mid").groupBy("memory_id").agg(F.max("rev").alias("old"))
    b = m.groupBy("memory_id").agg(F.max("rev").alias("rev"), F.max_by(F.col("deleted_at").isNull(), "rev").alias("alive"))
    return b.join(a, "memory_id", "left").select("memory_id", F.when(~F.col("alive"), "drop").when(F.col("old").isNull(), "load").when(F.col("rev") > F.col("old"), "reload").otherwise("keep").alias("op"))


@query("udf01_hash_bag", f"WITH {CURRENT}, s AS (SELECT memory_id, list_transform({TOK.format('description')}, lambda t: ('0x' || substr(sha256(t), 1, 8))::BIGINT % 16) AS s FROM m), v AS (SELECT memory_id, list_transform(range(0, 16), lambda k: len(list_filter(s, lambda x: x = k))::DOUBLE) AS v FROM s WHERE len(s) > 0) SELECT memory_id, list_transform(v, lambda x: round(x / sqrt(list_sum(list_transform(v, lambda y: y * y))), 6)) AS vector FROM v")
def hash_bag(spark, d):
    """The default vectoriser over the notes."""
    v = current(spark, d).select("memory_id", pluggable.hash_bag(F.col("description")).alias("v")).where("v is not null")
    return v.select("memory_id", F.transform("v", lambda x: F.round(x, 6)).alias("vector"))


@query("udf02_judge", "SELECT a, b, score, CASE WHEN score >= 0.45 THEN 'MERGE' WHEN score >= 0.35 THEN 'RELATED' ELSE 'UNSURE' END AS verdict FROM (SELECT a.vec_id AS a, b.vec_id AS b, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 4) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id) WHERE score >= 0.3")
def judged(spark, d):
    """Near pairs through a judge that is passed in."""
    pairs = ranking.near_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", "label", 0.3).select("a", "b", "score")
    return pluggable.by_threshold(0.45, 0.35)(pairs)


@query("udf03_chunk_table_function")
def chunk_table_function(spark, d):
    """The chunker as a table function, called beside each row."""
    from pyspark.sql.functions import udtf

    class Chunks:
        def eval(self, text: str):
            for i, (heading, part) in enumerate(chunk_text(text) if text else []):
                yield i, heading, len(part)

    spark.udtf.register("quern_chunks", udtf(Chunks, returnType="chunk_index int, heading string, chars int"))
    table(spark, d, "documents").select("doc_id", "text").createOrReplaceTempView("quern_documents")
    return spark.sql("SELECT d.doc_id, c.* FROM quern_documents d, LATERAL quern_chunks(d.text) c")


@query("snk02_rewrites", "WITH v AS (SELECT DISTINCT memory_id, rev, path, root, content_hash FROM memories) SELECT memory_id, count(*) AS revisions, count(DISTINCT path) AS paths, count(DISTINCT root) AS roots, arg_max(path, (rev, path)) AS path, arg_max(content_hash, (rev, path)) AS content_hash FROM v GROUP BY memory_id HAVING count(*) > 1")
def rewrites(spark, d):
    """Notes rewritten in place: the id stays, the newest path and text stand."""
    v = table(spark, d, "memories").select("memory_id", "rev", "path", "root", "content_hash").distinct()
    last = F.struct("rev", "path")
    return v.groupBy("memory_id").agg(F.count(F.lit(1)).alias("revisions"), F.countDistinct("path").alias("paths"), F.countDistinct("root").alias("roots"), F.max_by("path", last).alias("path"), F.max_by("content_hash", last).alias("content_hash")).where("revisions > 1")


COS_ALL = "cos AS (SELECT p.vec_id AS query, e.vec_id AS id, round(list_sum(list_transform(list_zip(e.embedding, p.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 4) AS score FROM embeddings p, embeddings e WHERE p.vec_id % 100 = 0)"


@query("ret04_row_pipeline", f"WITH {CURRENT}, {COS_ALL}, t AS (SELECT *, max(score) OVER (PARTITION BY query) AS top, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS place FROM cos), s AS (SELECT query, id, score FROM t WHERE (score >= 0.15 OR (place = 1 AND score >= 0.13)) AND score >= top - 0.9), j AS (SELECT s.*, m.root = q.root AS own, lower({FLAT.format('m.description')}) AS t FROM s JOIN m ON m.memory_id = s.id JOIN m q ON q.memory_id = s.query WHERE m.archived_at IS NULL AND m.deleted_at IS NULL AND trim(coalesce(m.description, '')) <> ''), u AS (SELECT *, row_number() OVER (PARTITION BY query, t ORDER BY score DESC, id) AS copy FROM j), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS i, row_number() OVER (PARTITION BY query, own ORDER BY score DESC, id) AS k FROM u WHERE copy = 1) SELECT query, id, score, own, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN own AND k = 1 THEN least(i, 3) ELSE i END, i) AS place FROM r QUALIFY place <= 5")
def row_pipeline(spark, d):
    """Rows for every query in one plan: floor, rescue and window of the cosine, hygiene, one of equal statements, a place for an own row, five rows."""
    v = table(spark, d, "embeddings")
    near = ranking.cosine_each(v, "vec_id", "embedding", v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q")), floor=0.13)
    s = ranking.select_rows(near, 0.15, 0.9).select("query", "id", "score")
    m = current(spark, d)
    rows = m.where(tables.live()).where(F.trim(F.coalesce("description", F.lit(""))) != "").select(F.col("memory_id").alias("id"), "root", F.lower(flat(F.col("description"))).alias("t"))
    j = s.join(rows, "id").join(m.select(F.col("memory_id").alias("query"), F.col("root").alias("of")), "query").withColumn("own", F.col("root") == F.col("of"))
    best = (F.col("score").desc(), F.col("id"))
    u = j.withColumn("copy", F.row_number().over(Window.partitionBy("query", "t").orderBy(*best))).where("copy = 1")
    q = Window.partitionBy("query")
    r = u.withColumns({"i": F.row_number().over(q.orderBy(*best)), "k": F.row_number().over(Window.partitionBy("query", "own").orderBy(*best))})
    key = F.when(F.col("own") & (F.col("k") == 1), F.least(F.col("i"), F.lit(3))).otherwise(F.col("i"))
    return r.withColumn("place", F.row_number().over(q.orderBy(key, "i"))).where("place <= 5").select("query", "id", "score", "own", "place")


@query("tru03_arms", f"WITH {EV}, st AS (SELECT session, min(ts) AS start FROM e GROUP BY session), cut AS (SELECT start AS cut FROM (SELECT start, row_number() OVER (ORDER BY start, session) AS i, count(*) OVER () AS n FROM st) WHERE i = ceil(0.7 * n)), fit AS (SELECT note, count(DISTINCT CASE WHEN kind = 'use' THEN session END) AS used FROM e, cut WHERE ts < cut GROUP BY note), un AS (SELECT e.session, e.note, bool_or(kind = 'use') AS relevant FROM e JOIN st USING (session), cut WHERE start >= cut AND kind IN ('recall', 'use') GROUP BY ALL), o AS (SELECT un.session, relevant, row_number() OVER (PARTITION BY un.session ORDER BY coalesce(used, 0) DESC, un.note) AS a, row_number() OVER (PARTITION BY un.session ORDER BY sha256('3-' || un.session || '-' || un.note), un.note) AS b FROM un LEFT JOIN fit USING (note)), f AS (SELECT session, min(a) AS a, min(b) AS b FROM o WHERE relevant GROUP BY session) SELECT count(*) AS sessions, round(avg(1.0 / a), 6) AS fitted, round(avg(1.0 / b), 6) AS shuffled, round(avg(1.0 / a - 1.0 / b), 6) AS gain FROM f")
def timesplit_arms(spark, d):
    """The time split with the order by use before the cut beside a seeded shuffle of the same rows."""
    from quern.plans.trust import timesplit_cut

    e = events(spark, d)
    cut = F.broadcast(timesplit_cut(spark, d).select("cut"))
    fit = e.crossJoin(cut).where("ts < cut and kind = 'use'").groupBy("note").agg(F.countDistinct("session").alias("used"))
    test = e.groupBy("session").agg(F.min("ts").alias("start")).crossJoin(cut).where("start >= cut").select("session")
    un = e.join(test, "session").where("kind <> 'contradiction'").groupBy("session", "note").agg(F.max(F.col("kind") == "use").alias("relevant")).join(fit, "note", "left")
    w = Window.partitionBy("session")
    shuffle = F.sha2(F.concat_ws("-", F.lit("3"), "session", "note"), 256)
    o = un.withColumns({"a": F.row_number().over(w.orderBy(F.coalesce("used", F.lit(0)).desc(), "note")), "b": F.row_number().over(w.orderBy(shuffle, "note"))})
    f = o.where("relevant").groupBy("session").agg(F.min("a").alias("a"), F.min("b").alias("b"))
    a, b = 1.0 / F.col("a"), 1.0 / F.col("b")
    return f.agg(F.count(F.lit(1)).alias("sessions"), F.round(F.avg(a), 6).alias("fitted"), F.round(F.avg(b), 6).alias("shuffled"), F.round(F.avg(a - b), 6).alias("gain"))


@query("sup13_row_pick", f"WITH {CURRENT}, l AS (SELECT DISTINCT memory_id, length(coalesce(body, '')) AS chars, unnest({LABELS}) AS label FROM m), c AS (SELECT DISTINCT lower(trim(session, ' ' || chr(10) || chr(9))) AS session, row_id, unnest(list_filter(regexp_split_to_array(lower({TARGET}), '[^a-z0-9]+'), lambda x: x <> '')) AS label FROM calls WHERE tool IS NOT NULL AND json_valid(tool_input)), p AS (SELECT session, row_id, memory_id, any_value(chars) AS chars, count(*) AS shared FROM c JOIN l USING (label) GROUP BY ALL HAVING count(*) >= 2), f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY session, memory_id ORDER BY row_id) = 1), t AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY shared DESC, memory_id) <= 3), b AS (SELECT *, sum(least(chars, 800)) OVER (PARTITION BY session ORDER BY row_id, memory_id) AS run FROM t) SELECT session, row_id, memory_id, shared FROM b WHERE run <= 20000")
def row_pick(spark, d):
    """Notes shown beside a call: not yet delivered in the session, three at most, within the session's budget of characters."""
    own = labelsets.sets(current(spark, d).select("memory_id", F.length(F.coalesce("body", F.lit(""))).alias("chars"), label_list(F.col("labels")).alias("own")), 3, "chars")
    c = call_words(spark, d, F.lower(F.trim("session", F.lit(" \n\t"))).alias("session"), "row_id")
    c = labelsets.known(c, ["session", "row_id"], own.select(F.explode("own").alias("label")).distinct()).where(F.size("asked") >= 2)
    # notes with the same labels are delivered together, and of calls with the same labels only the first of a session delivers
    first = stored(c.groupBy("session", "asked").agg(F.min("row_id").alias("row_id")))
    both = stored(labelsets.shared(first, own).groupBy("asked", "own").agg(F.count(F.lit(1)).alias("shared")).where("shared >= 2"))
    notes = own.select("own", F.inline("notes"))
    t = stored(_undelivered(first, both, notes))
    b = ordered.scan(t, ["session"], ["row_id", "memory_id"], sums={"run": F.least("chars", F.lit(800))})
    return b.where("run <= 20000").select("session", "row_id", "memory_id", "shared")


#: Notes of a set of labels that are looked at first; a call with fewer than three undelivered ones among them looks at all.
PICK_DEPTH = 12


def _undelivered(first, both, notes):
    """(session, row_id, memory_id, chars, shared): the three best notes of a call that no earlier call of its session matches."""
    place = Window.partitionBy("asked").orderBy(F.col("shared").desc(), "memory_id")
    near = both.join(notes, "own").withColumn("place", F.row_number().over(place)).where(F.col("place") <= PICK_DEPTH + 1)
    near = stored(near)
    before = first.select(F.col("session").alias("s"), F.col("asked").alias("earlier"), F.col("row_id").alias("r"))
    seen = (F.col("session") == F.col("s")) & (F.col("r") < F.col("row_id")) & (F.size(F.array_intersect("own", "earlier")) >= 2)
    found = stored(first.join(near.where(F.col("place") <= PICK_DEPTH), "asked").join(before, seen, "left_anti").select("session", "row_id", "memory_id", "chars", "shared"))
    done = found.groupBy("session", "row_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    more = near.where(F.col("place") > PICK_DEPTH).select("asked")
    rest = stored(first.join(more, "asked", "left_semi").join(done, ["session", "row_id"], "left_anti").select("session", "row_id"))
    deep = first.join(rest.select("session").distinct(), "session", "left_semi").join(both, "asked").groupBy("session", "own").agg(F.min(F.struct("row_id", "shared")).alias("r"))
    deep = deep.select("session", "own", "r.*").join(rest, ["session", "row_id"], "left_semi").join(notes, "own").select("session", "row_id", "memory_id", "chars", "shared")
    every = found.join(rest, ["session", "row_id"], "left_anti").unionByName(deep)
    return every.withColumn("n", F.row_number().over(Window.partitionBy("row_id").orderBy(F.col("shared").desc(), "memory_id"))).where("n <= 3").drop("n")
