"""Parsing notes: front matter, fields, layout, chunks, labels, paths, errors, phrases."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.functions.text import label_list, tokens
from quern.operators import tables
from quern.operators.recall import STOP_WORDS
from quern.plans.recall import STOPS, TOK
from quern.registry import query
from quern.session import table

BLOCK = r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)"
TOP_KEY, INNER_KEY = r"^([A-Za-z_][A-Za-z0-9_-]*):[ \t]*(.*?)[ \t\r]*$", r"^[ \t]+([A-Za-z_][A-Za-z0-9_-]*):[ \t]*(.*?)[ \t\r]*$"
QUOTED = r"^[\"'](.*)[\"']$"
LINES = f"b AS (SELECT doc_id, regexp_extract(text, '{BLOCK}', 1) AS block FROM documents WHERE regexp_matches(text, '{BLOCK}')), l AS (SELECT doc_id, unnest(string_split(block, chr(10))) AS line, generate_subscripts(string_split(block, chr(10)), 1) - 1 AS pos FROM b)"


def front_lines(spark, d):
    block = F.regexp_extract("text", BLOCK, 1)
    x = table(spark, d, "documents").where(F.col("text").rlike(BLOCK)).select("doc_id", block.alias("block"))
    return x.select("doc_id", F.posexplode(F.split("block", "\n")).alias("pos", "line"))


@query("str04_front_matter", f"""WITH {LINES}, k AS (SELECT *, regexp_extract(line, '{TOP_KEY}', 1) AS top, regexp_extract(line, '{INNER_KEY}', 1) AS inner_key, CASE WHEN regexp_matches(line, '{TOP_KEY}') THEN regexp_extract(line, '{TOP_KEY}', 2) ELSE regexp_extract(line, '{INNER_KEY}', 2) END AS raw FROM l),
p AS (SELECT *, last_value(CASE WHEN top <> '' THEN top END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS parent FROM k)
SELECT doc_id, CASE WHEN top <> '' THEN top ELSE parent || '.' || inner_key END AS key, arg_min(regexp_replace(raw, '{QUOTED.replace(chr(39), chr(39) * 2)}', '\\1'), pos) AS value FROM p WHERE top <> '' OR (inner_key <> '' AND parent IS NOT NULL) GROUP BY ALL""")
def front_matter(spark, d):
    """(doc_id, key, value) of the block at the head of a text: one nested level as parent.key, quotes stripped, the first of a key."""
    line = F.col("line")
    top, inner = F.regexp_extract(line, TOP_KEY, 1), F.regexp_extract(line, INNER_KEY, 1)
    raw = F.when(line.rlike(TOP_KEY), F.regexp_extract(line, TOP_KEY, 2)).otherwise(F.regexp_extract(line, INNER_KEY, 2))
    k = front_lines(spark, d).select("doc_id", "pos", top.alias("top"), inner.alias("inner"), F.regexp_replace(raw, QUOTED, "$1").alias("value"))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    p = k.withColumn("parent", F.last(F.when(F.col("top") != "", F.col("top")), ignorenulls=True).over(w)).where("top <> '' or (inner <> '' and parent is not null)")
    key = F.when(F.col("top") != "", F.col("top")).otherwise(F.concat_ws(".", "parent", "inner"))
    return p.groupBy("doc_id", key.alias("key")).agg(F.min_by("value", "pos").alias("value"))


@query("str06_triggers", f"""WITH {LINES}, k AS (SELECT *, regexp_extract(line, '{TOP_KEY}', 1) AS top, regexp_extract(line, '{TOP_KEY}', 2) AS raw FROM l), p AS (SELECT *, last_value(CASE WHEN top <> '' THEN top END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS parent FROM k),
i AS (SELECT doc_id, unnest(string_split(regexp_extract(raw, '^\\[(.*)\\]$', 1), ',')) AS item FROM p WHERE top IN ('triggers', 'tags', 'labels') AND regexp_matches(raw, '^\\[.*\\]$') UNION ALL SELECT doc_id, regexp_extract(line, '^[ \\t]*-[ \\t]+(.*?)[ \\t\\r]*$', 1) FROM p WHERE parent IN ('triggers', 'tags', 'labels') AND regexp_matches(line, '^[ \\t]*-[ \\t]+')),
c AS (SELECT doc_id, regexp_replace(trim(regexp_replace(trim(item), '^["'']|["'']$', '', 'g')), '^[a-z]+:[ ]*', '') AS item FROM i) SELECT DISTINCT doc_id, item FROM c WHERE item <> ''""")
def triggers(spark, d):
    """(doc_id, item) of the lists in a head block, inline or a line an item, without quotes and without a kind prefix."""
    line = F.col("line")
    k = front_lines(spark, d).withColumns({"top": F.regexp_extract(line, TOP_KEY, 1), "raw": F.regexp_extract(line, TOP_KEY, 2)})
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    p = k.withColumn("parent", F.last(F.when(F.col("top") != "", F.col("top")), ignorenulls=True).over(w)).where(F.col("parent").isin("triggers", "tags", "labels"))
    inline = F.when((F.col("top") != "") & F.col("raw").rlike(r"^\[.*\]$"), F.split(F.regexp_extract("raw", r"^\[(.*)\]$", 1), ","))
    item = F.when(line.rlike(r"^[ \t]*-[ \t]+"), F.array(F.regexp_extract(line, r"^[ \t]*-[ \t]+(.*?)[ \t\r]*$", 1)))
    each = p.select("doc_id", F.explode(F.coalesce(inline, item)).alias("item"))
    clean = F.regexp_replace(F.trim(F.regexp_replace(F.trim("item"), r"^[\"']|[\"']$", "")), r"^[a-z]+:[ ]*", "")
    return each.select("doc_id", clean.alias("item")).where("item <> ''").distinct()


STEM = r"\[\[([a-z0-9][a-z0-9_-]{2,80})\]\]|\b(?:user|feedback|project|reference)_[a-z0-9_]+\.md"


@query("str07_stems", r"""WITH e AS (SELECT memory_id, rev, path, list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(body, ''), '\b(?:user|feedback|project|reference)_[a-z0-9_-]+\.md'), lambda x: regexp_replace(x, '\.md$', '')), lambda x: x <> regexp_replace(path, '\.md$', ''))) AS s FROM (SELECT DISTINCT memory_id, rev, path, body FROM memories)) SELECT memory_id, rev, list_sort(s)[1:8] AS stems FROM e WHERE len(s) > 0""")
def stems(spark, d):
    """Other notes that a note names by file, distinct, without itself, at most eight (the stamp's size)."""
    m = table(spark, d, "memories").select("memory_id", "rev", "path", "body").distinct()
    named = F.transform(F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(r"\b(?:user|feedback|project|reference)_[a-z0-9_-]+\.md"), F.lit(0)), lambda x: F.regexp_replace(x, r"\.md$", ""))
    own = F.regexp_replace("path", r"\.md$", "")
    return m.select("memory_id", "rev", F.slice(F.array_sort(F.array_distinct(F.filter(named, lambda x: x != own))), 1, 8).alias("stems")).where(F.size("stems") > 0)


@query("str08_layout", "SELECT memory_id, rev, sha256(concat_ws(chr(10) || chr(10), CASE WHEN trim(name) <> '' THEN '# ' || trim(name) END, nullif(trim(description), ''), '[' || source_type || ': ' || path || ']', nullif(replace(body, chr(13) || chr(10), chr(10)), ''))) AS hash FROM (SELECT DISTINCT memory_id, rev, name, description, source_type, path, body FROM memories)")
def layout(spark, d):
    """The stored text of a note: title, description, marker, body; blank parts leave no gap."""
    m = table(spark, d, "memories").select("memory_id", "rev", "name", "description", "source_type", "path", "body").distinct()
    title = F.when(F.trim("name") != "", F.concat(F.lit("# "), F.trim("name")))
    text = F.concat_ws("\n\n", title, F.nullif(F.trim("description"), F.lit("")), F.concat(F.lit("["), "source_type", F.lit(": "), "path", F.lit("]")), F.nullif(F.replace("body", F.lit("\r\n"), F.lit("\n")), F.lit("")))
    return m.select("memory_id", "rev", F.sha2(text, 256).alias("hash"))


CAP, JOIN_UNDER, OVERLAP, MOST = 1200, 300, 240, 400
_fence = re.compile(r"^\s{0,3}(```|~~~)")
_title = re.compile(r"^(#{1,6})\s+(.*?)(?:\s+#+)?\s*$")


def chunk_text(text: str) -> list[tuple[str, str]]:
    """(heading path, chunk) of a text: sections, packed by paragraphs to ``CAP``; short neighbours of a section are joined.

    A paragraph above the cap is cut at sentences, each further part led by the sentence before it if that is at most
    ``OVERLAP`` long. A fence is one paragraph. More than ``MOST`` chunks go into the last one's place: nothing is lost.
    """
    paragraphs: list[tuple[str, str]] = []
    path: dict[int, str] = {}
    held: list[str] = []
    fence = ""

    def close() -> None:
        body = "\n".join(held).strip("\n")
        if body.strip():
            paragraphs.append((" > ".join(path[k] for k in sorted(path)), body))
        held.clear()

    for line in text.replace("\r\n", "\n").split("\n"):
        mark = _fence.match(line)
        if fence:
            held.append(line)
            fence = "" if mark and mark[1] == fence else fence
            continue
        title = _title.match(line)
        if title:
            close()
            path = {k: v for k, v in path.items() if k < len(title[1])} | {len(title[1]): title[2]}
            continue
        if mark:
            close()
            fence = mark[1]
        elif not line.strip():
            close()
            continue
        held.append(line)
    close()
    out: list[tuple[str, str]] = []
    for heading, body in paragraphs:
        parts = [body]
        if len(body) > CAP:
            parts, run, last = [], "", ""
            for sentence in re.split(r"(?<=[.!?])\s+|\n", body):
                for piece in [sentence[i : i + CAP - OVERLAP - 1] for i in range(0, len(sentence), CAP - OVERLAP - 1)] or [""]:
                    if run and len(run) + 1 + len(piece) > CAP:
                        parts.append(run)
                        run = last if 0 < len(last) <= OVERLAP else ""
                    run = f"{run} {piece}" if run else piece
                    last = piece
            parts.append(run)
        for part in parts:
            if out and out[-1][0] == heading and len(out[-1][1]) + 2 + len(part) <= CAP and (len(parts) == 1 or len(out[-1][1]) < JOIN_UNDER):
                out[-1] = (heading, f"{out[-1][1]}\n\n{part}")
            else:
                out.append((heading, part))
    if len(out) > MOST:
        out = [*out[: MOST - 1], (out[MOST - 1][0], "\n\n".join(x for _, x in out[MOST - 1 :]))]
    return out


@query("str09_chunks")
def chunks(spark, d):
    """The chunks of every document; no SQL twin, as the section parser keeps state."""

    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"heading": h, "text": x} for h, x in chunk_text(t)] if t else [] for t in texts])

    x = table(spark, d, "documents").select("doc_id", F.posexplode(F.pandas_udf(cut, "array<struct<heading:string,text:string>>").asNondeterministic()("text")).alias("chunk_index", "c"))
    return x.select("doc_id", "chunk_index", "c.heading", "c.text")


@query("str03_display_tokens", f"SELECT memory_id, rev, list_filter({TOK.format('description')}, lambda t: t NOT IN ({STOPS})) AS words FROM (SELECT DISTINCT memory_id, rev, description FROM memories)")
def display_tokens(spark, d):
    m = table(spark, d, "memories").select("memory_id", "rev", "description").distinct()
    return m.select("memory_id", "rev", F.filter(tokens("description"), lambda t: ~t.isin(*STOP_WORDS)).alias("words"))


ABS, UUID, HEX = r"(?:/[A-Za-z0-9._-]+)+/([A-Za-z0-9._-]+/[A-Za-z0-9._-]+)", r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", r"\b[0-9a-f]{7,40}\b"


@query("str13_fold_paths", f"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '{UUID}', '<id>', 'g'), '{HEX}', '<hex>', 'g'), '{ABS}', '…/\\1', 'g')) AS hash FROM documents WHERE text IS NOT NULL")
def fold_paths(spark, d):
    """Absolute paths keep their last two parts; identifiers and hashes are folded."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", UUID, "<id>"), HEX, "<hex>"), ABS, "…/$1")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(t, 256).alias("hash"))


KINDS = {"ticket": r"\b[A-Z][A-Z0-9]{1,9}-[0-9]{1,6}\b", "file": r"\b[A-Za-z0-9_./-]*[A-Za-z0-9_-]+\.(?:rs|py|sql|md|toml|yaml|json|sh|go|ts)\b", "tool": r"`([a-z][a-z0-9_-]{1,30})(?: [^`]*)?`", "flag": r"(?:^|[\s`(])(--[a-z][a-z0-9-]+)", "commit": r"\b[Cc]ommit ([0-9a-f]{7,40})\b"}


@query("str21_labels", "WITH x AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, '{p}', {1 if k in ('tool', 'flag', 'commit') else 0})) AS label FROM documents" for k, p in KINDS.items()) + ") SELECT kind, label, count(*) AS uses, count(DISTINCT doc_id) AS docs FROM x WHERE label <> '' GROUP BY ALL")
def labels(spark, d):
    """Tickets, files, tools, flags and commits that texts name, with their uses and documents."""

    def found(kind, pattern):
        names = F.regexp_extract_all("text", F.lit(pattern), F.lit(1 if kind in ("tool", "flag", "commit") else 0))
        return F.transform(names, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("label")))

    each = [found(k, p) for k, p in KINDS.items()]
    x = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.concat(*each)).alias("l")).select("doc_id", "l.*").where("label <> ''")
    per = x.groupBy("kind", "label", "doc_id").agg(F.count(F.lit(1)).alias("uses"))
    return per.groupBy("kind", "label").agg(F.sum("uses").alias("uses"), F.count(F.lit(1)).alias("docs"))


@query("str22_norm_paths", r"SELECT DISTINCT target, regexp_replace(regexp_replace(regexp_replace(lower(replace(target, chr(92), '/')), '/+', '/', 'g'), '^(\./)+', ''), '/$', '') AS path, regexp_extract(target, '([^/]+)$', 1) AS leaf FROM (SELECT json_extract_string(tool_input, '$.target') AS target FROM calls WHERE json_valid(tool_input)) WHERE target IS NOT NULL")
def norm_paths(spark, d):
    t = F.get_json_object("tool_input", "$.target")
    x = table(spark, d, "calls").where(F.try_parse_json("tool_input").isNotNull()).select(t.alias("target")).where("target is not null").distinct()
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.replace("target", F.lit("\\"), F.lit("/"))), "/+", "/"), r"^(\./)+", ""), "/$", "")
    return x.select("target", path.alias("path"), F.regexp_extract("target", r"([^/]+)$", 1).alias("leaf"))


ERROR = r"(?i)\b(error|failed|failure|exception|traceback|fatal|denied|refused|timed[ -]?out|not found|conflict(?:ed)?|deadlocked|crashed|overflowed)\b"


@query("str25_error_lines", f"WITH l AS (SELECT row_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM calls WHERE text IS NOT NULL AND (role = 'tool' OR is_error)), e AS (SELECT row_id, pos, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS line, lower(regexp_extract(line, '{ERROR}', 1)) AS cue FROM l WHERE regexp_matches(line, '{ERROR}')) SELECT row_id, pos, cue, regexp_replace(regexp_replace(line, '{HEX}', '', 'g'), '[0-9]+', '#', 'g') AS query FROM e")
def error_lines(spark, d):
    """Lines of tool results that tell of an error, as search text without hashes and numbers."""
    x = table(spark, d, "calls").where("text is not null and (role = 'tool' or is_error)").select("row_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    x = x.where(F.col("line").rlike(ERROR)).select("row_id", "pos", F.lower(F.regexp_extract("line", ERROR, 1)).alias("cue"), tx.flat(F.col("line")).alias("line"))
    return x.select("row_id", F.col("pos").cast("bigint").alias("pos"), "cue", F.regexp_replace(F.regexp_replace("line", HEX, ""), "[0-9]+", "#").alias("query"))


@query("str24_mined_fields", r"""WITH c AS (SELECT row_id, tool, json_extract_string(tool_input, '$.target') AS target FROM calls WHERE tool IS NOT NULL AND json_valid(tool_input)) SELECT row_id, lower(tool) AS head, regexp_extract(target, '^([^/]+)/', 1) AS area, regexp_extract(target, '\.([a-z0-9]+)$', 1) AS extension, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(target, '')), '[/_.]'), lambda x: length(x) >= 3))) AS labels FROM c""")
def mined_fields(spark, d):
    """Fields derived from a call: command head, area, extension and labels of its target."""
    c = table(spark, d, "calls").where(F.col("tool").isNotNull() & F.try_parse_json("tool_input").isNotNull()).select("row_id", "tool", F.get_json_object("tool_input", "$.target").alias("target"))
    words = F.filter(F.split(F.lower(F.coalesce("target", F.lit(""))), "[/_.]"), lambda x: F.length(x) >= 3)
    return c.select("row_id", F.lower("tool").alias("head"), F.regexp_extract("target", "^([^/]+)/", 1).alias("area"), F.regexp_extract("target", r"\.([a-z0-9]+)$", 1).alias("extension"), F.array_sort(F.array_distinct(words)).alias("labels"))


RUN = 8
GRAMS = "list_distinct(list_transform(range(1, len(w) - {0} + 2), lambda i: array_to_string(w[i:i + {0} - 1], ' ')))".format(RUN)


@query("str26_phrase_overlap", f"WITH m AS (SELECT memory_id, arg_max(struct_pack(d := description), rev).d AS t FROM memories GROUP BY memory_id), a AS (SELECT memory_id, unnest({GRAMS}) AS g FROM (SELECT memory_id, {TOK.format('t')} AS w FROM m) WHERE len(w) >= {RUN}), b AS (SELECT doc_id, unnest({GRAMS}) AS g FROM (SELECT doc_id, {TOK.format('text')} AS w FROM documents) WHERE len(w) >= {RUN}) SELECT memory_id, count(DISTINCT doc_id) AS docs, count(DISTINCT g) AS phrases FROM a JOIN b USING (g) GROUP BY memory_id")
def phrase_overlap(spark, d):
    """Notes whose description shares a run of eight words with documents: an equi-join on the hashed runs."""

    def runs(df, key, words):
        w = df.select(key, words.alias("w")).where(F.size("w") >= RUN)
        grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - RUN + 1), lambda i: F.xxhash64(F.array_join(F.slice("w", i, RUN), " "))))
        return w.select(key, F.explode(grams).alias("g"))

    m = table(spark, d, "memories").groupBy("memory_id").agg(F.max_by("description", "rev").alias("t"))
    both = runs(m, "memory_id", tokens("t")).join(runs(table(spark, d, "documents"), "doc_id", tokens("text")), "g")
    return both.groupBy("memory_id").agg(F.countDistinct("doc_id").alias("docs"), F.countDistinct("g").alias("phrases"))


@query("str31_neutral_blocks", r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?is)<(script|style)\b.*?</(?:script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '</?[a-zA-Z][^<>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS hash FROM documents WHERE regexp_matches(text, '</?[a-zA-Z][^<>]*>')")
def neutral_blocks(spark, d):
    """Texts with left-over markup, without it."""
    x = table(spark, d, "documents").where(F.col("text").rlike("</?[a-zA-Z][^<>]*>"))
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"(?is)<(script|style)\b.*?</(?:script|style)>", " "), "(?s)<!--.*?-->", " "), "</?[a-zA-Z][^<>]*>", " ")
    return x.select("doc_id", F.sha2(F.trim(F.regexp_replace(t, r"\s+", " ")), 256).alias("hash"))


NOISE = r"^\s*(?:[-*]\s*)?(?:(?:[a-z]+|[A-Z][a-z]+) returned [0-9]+ lines\b.*|[0-9]+ (?:passed|failed|skipped).*|[-=*_#|+ ]{3,}|[A-Za-z0-9_./-]+:[0-9]+(?::.*)?|export [A-Z_]+=.*|\s*)$"


@query("fil15_noise_statements", f"WITH l AS (SELECT memory_id, rev, list_filter(string_split(replace(body, chr(13), ''), chr(10)), lambda x: trim(x) <> '') AS l FROM (SELECT DISTINCT memory_id, rev, body FROM memories) WHERE body IS NOT NULL), n AS (SELECT memory_id, rev, len(l) AS lines, len(list_filter(l, lambda x: regexp_matches(x, '{NOISE}'))) AS noise FROM l) SELECT memory_id, rev, lines, noise, lines = noise AS drop_it FROM n WHERE noise > 0")
def noise_statements(spark, d):
    """Status lines, dumps and listings of a note; a note of nothing else is dropped."""
    m = table(spark, d, "memories").where("body is not null").select("memory_id", "rev", "body").distinct()
    lines = F.filter(F.split(F.replace("body", F.lit("\r"), F.lit("")), "\n"), lambda x: F.trim(x) != "")
    n = m.select("memory_id", "rev", F.size(lines).cast("bigint").alias("lines"), F.size(F.filter(lines, lambda x: x.rlike(NOISE))).cast("bigint").alias("noise"))
    return n.where("noise > 0").select("*", (F.col("lines") == F.col("noise")).alias("drop_it"))


HARNESS = ("<command-", "<local-command", "<system-reminder", "caveat:", "[request interrupted", "this session is being continued")


@query("fil16_harness_turns", "SELECT count(*) AS prompts, count(*) FILTER (" + " OR ".join(f"starts_with(lower(ltrim(prompt)), '{p}')" for p in HARNESS) + ") AS harness FROM calls WHERE role = 'user' AND prompt IS NOT NULL")
def harness_turns(spark, d):
    """User rows that the harness wrote and no person, by their fixed beginnings."""
    x = table(spark, d, "calls").where("role = 'user' and prompt is not null").select(F.lower(F.ltrim("prompt")).alias("p"))
    own = F.lit(False)
    for prefix in HARNESS:
        own = own | F.col("p").startswith(prefix)
    return x.agg(F.count(F.lit(1)).alias("prompts"), F.count_if(own).alias("harness"))


CURRENT = "m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY rev DESC) AS n FROM memories) WHERE n = 1)"


def current(spark, d):
    return tables.newest(table(spark, d, "memories"), ["memory_id"], ["rev"])


@query("fil10_hygiene", f"WITH {CURRENT} SELECT memory_id FROM m WHERE NOT (regexp_matches(lower(path), '(^|/)(index|readme|memory|topics?)[^/]*$') OR lower(trim(coalesce(category, ''))) IN ('closed', 'done', 'obsolete') OR archived_at IS NOT NULL OR deleted_at IS NOT NULL)")
def hygiene(spark, d):
    """Rows that are no index, topic or closed note."""
    bad = F.lower("path").rlike("(^|/)(index|readme|memory|topics?)[^/]*$") | F.lower(F.trim(F.coalesce("category", F.lit("")))).isin("closed", "done", "obsolete") | ~tables.live()
    return current(spark, d).where(~bad).select("memory_id")


RULE = r"(?i)^\s*(?:[-*]\s*)?(?:always|never|do not|don't|ask first|use|run|keep|set|check|drop|nobody should|if)\b"


@query("fil11_unruled", f"WITH {CURRENT} SELECT memory_id, len(list_filter(string_split(coalesce(body, ''), chr(10)), lambda x: regexp_matches(x, '{RULE.replace(chr(39), chr(39) * 2)}'))) AS rules FROM m WHERE trim(coalesce(description, '')) <> '' OR len(list_filter(string_split(coalesce(body, ''), chr(10)), lambda x: regexp_matches(x, '{RULE.replace(chr(39), chr(39) * 2)}'))) > 0")
def unruled(spark, d):
    """Notes with a rule line or a summary, and how many rule lines they have."""
    rules = F.size(F.filter(F.split(F.coalesce("body", F.lit("")), "\n"), lambda x: x.rlike(RULE))).cast("bigint")
    m = current(spark, d).select("memory_id", "description", rules.alias("rules"))
    return m.where((F.trim(F.coalesce("description", F.lit(""))) != "") | (F.col("rules") > 0)).select("memory_id", "rules")


CUES = {"lead": r"^(?:no|nope|wrong|stop|wait|actually|not that|nein|falsch|halt|non|faux)\b", "instead": r"\b(?:instead|rather than|not what i|i said|i meant|undo|revert that)\b", "negation": r"\b(?:don'?t|do not|never|should not|shouldn'?t) "}


@query("str23_cues", "WITH h AS (SELECT row_id, lower(substr(trim(regexp_replace(prompt, '`[^`]*`', ' ', 'g')), 1, 400)) AS h FROM calls WHERE role = 'user' AND prompt IS NOT NULL AND NOT coalesce(is_meta, false)) SELECT row_id, CASE " + " ".join("WHEN regexp_matches(h, '{}') THEN '{}'".format(p.replace("'", "''"), k) for k, p in CUES.items()) + " END AS cue FROM h WHERE " + " OR ".join("regexp_matches(h, '{}')".format(p.replace("'", "''")) for p in CUES.values()))
def cues(spark, d):
    """Prompts that correct what came before: a lead word, a word of exchange, a negation, in the first 400 characters without code."""
    x = table(spark, d, "calls").where("role = 'user' and prompt is not null and not coalesce(is_meta, false)")
    h = x.select("row_id", F.lower(F.substring(F.trim(F.regexp_replace("prompt", "`[^`]*`", " ")), 1, 400)).alias("h"))
    cue = F.coalesce(*[F.when(F.col("h").rlike(p), F.lit(k)) for k, p in CUES.items()])
    return h.select("row_id", cue.alias("cue")).where("cue is not null")


@query("jsn03_canonical_json", "SELECT row_id, sha256('{' || array_to_string(list_transform(list_sort(json_keys(tool_input)), lambda k: to_json(k)::VARCHAR || ':' || json_extract(tool_input, '$.\"' || k || '\"')::VARCHAR), ',') || '}') AS hash FROM calls WHERE json_valid(tool_input) AND json_type(tool_input) = 'OBJECT'")
def canonical_json(spark, d):
    """Flat JSON objects with sorted keys, hashed; equal content has an equal hash whatever the order of its keys."""
    c = table(spark, d, "calls").where(F.try_parse_json("tool_input").isNotNull() & F.json_object_keys("tool_input").isNotNull())
    m = F.from_json("tool_input", "map<string,string>")
    number = F.lit(r"^-?[0-9]+(\.[0-9]+)?$|^(true|false|null)$")
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    pair = lambda k: F.concat(quoted(k), F.lit(":"), F.when(F.element_at(m, k).rlike(r"^-?[0-9]+(\.[0-9]+)?$|^(true|false|null)$"), F.element_at(m, k)).otherwise(quoted(F.element_at(m, k))))
    return c.select("row_id", F.sha2(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.json_object_keys("tool_input")), pair), ","), F.lit("}")), 256).alias("hash"))


@query("arr01_label_stamp", f"WITH {CURRENT}, l AS (SELECT memory_id, list_distinct(list_filter(list_transform(from_json(labels, '[\"VARCHAR\"]'), lambda x: lower(trim(x))), lambda x: x <> '')) AS l, lower(trim(coalesce(category, ''))) AS c FROM m) SELECT memory_id, list_sort(list_distinct(list_concat(coalesce(l, []), CASE WHEN c <> '' THEN [c] ELSE [] END)))[1:12] AS labels FROM l")
def label_stamp(spark, d):
    """Sorted distinct labels with the category among them, at most twelve (the stamp's size)."""
    c = F.lower(F.trim(F.coalesce("category", F.lit(""))))
    both = F.concat(label_list(F.col("labels")), F.when(c != "", F.array(c)).otherwise(F.array().cast("array<string>")))
    return current(spark, d).select("memory_id", F.slice(F.array_sort(F.array_distinct(both)), 1, 12).alias("labels"))
