"""Problem 4: rebuild conversations from message rows.

Rows are sessionised by channel (the ``session`` in lower case without outer white space), ordered by
time, split into episodes at a calibrated inactivity gap, given a role each, and sessions that are
broken, empty or lack a reply are named and left out.

No step sorts a session in one task. Rows are range partitioned by (session, time, line), so a hot
session spreads over many segments; each segment is scanned by itself, and what has to cross a border
(the last known time, the numbers so far, the last prompt or reply) is carried by one small row a
segment and session.

Defined results: rows with the same transcript and line are one row (smallest ``row_id``); a null
``moment`` takes that of the nearest earlier line of its transcript, else stays null and sorts
first; moments above 1e11 are milliseconds; null ``is_meta`` is false; rows with a null or blank
session are dropped; text without a letter or digit is blank; null ids match nothing. Partly sent replies (rows
of one message whose text the full row begins with) don't become messages of their own. Sessions are given by
the data, so the calibrated gap numbers episodes inside them; the faults are those of a whole session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import cut_lineage

MILLIS_FROM = 1e11
#: Bins of the histogram of gaps: eight a factor of two, from 1/64 s to about four years.
GAP_BINS = 8
GAP_RANGE = (0.01, 1.3e8)


def _said(name: str) -> Column:
    return F.coalesce(F.col(name).rlike(r"[\p{L}\p{N}]"), F.lit(False))


def _segments(df: DataFrame, *order: str) -> DataFrame:
    """Range partition by ``order`` and number the partitions; equal orders stay together."""
    return df.repartitionByRange(*order).withColumn("seg", F.spark_partition_id())


def unique_lines(calls: DataFrame) -> DataFrame:
    """One row a (transcript, line_no), with ``at``: its time in seconds, filled from earlier lines."""
    moment = F.when(F.col("moment") > MILLIS_FROM, F.col("moment") / 1000).otherwise(F.col("moment"))
    keep = ["row_id", "session", "agent", "role", "is_meta", "message_id", "tool", "tool_use_id", "tool_input", "prompt", "text", "is_error"]
    rows = calls.select("transcript", "line_no", *keep, moment.alias("own"))
    rows = cut_lineage(_segments(rows, "transcript", "line_no"))
    first = Window.partitionBy("seg", "transcript", "line_no").orderBy("row_id")
    rows = rows.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    w = Window.partitionBy("seg", "transcript").orderBy("line_no")
    rows = rows.withColumn("known", F.last("own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = rows.groupBy("transcript", "seg").agg(F.max_by("own", F.when(F.col("own").isNotNull(), F.col("line_no"))).alias("end"))
    before = Window.partitionBy("transcript").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("transcript", "seg", F.last("end", ignorenulls=True).over(before).alias("carried")).where("carried is not null")
    return rows.join(carry, ["transcript", "seg"], "left").select("transcript", "line_no", *keep, F.coalesce("known", "carried").alias("at"))


def main_rows(calls: DataFrame) -> DataFrame:
    """Rows of the main agent in order: session, seg, seq_in_seg and what each row is."""
    session = F.lower(F.regexp_replace("session", r"^\s+|\s+$", ""))
    rows = unique_lines(calls).withColumn("session", session).where("session <> ''")
    others = rows.where("agent is null or agent <> 'main'").select("session").distinct()
    rows = rows.where("agent = 'main'").withColumns({
        "is_prompt": (F.col("role") == "user") & ~F.coalesce("is_meta", F.lit(False)) & _said("prompt"),
        "is_reply": (F.col("role") == "assistant") & _said("text"),
        "is_call": F.coalesce(F.trim("tool") != "", F.lit(False)),
    })
    rows = rows.withColumns({"is_result": ~F.col("is_call") & ((F.col("role") == "tool") | F.col("tool_use_id").isNotNull())})
    flags = {k: F.coalesce(k, F.lit(False)) for k in ("is_prompt", "is_reply", "is_result")}
    ready = cut_lineage(_segments(rows.withColumns(flags), "session", "at", "line_no", "transcript"))
    return ready, others


def _breaks(rows: DataFrame) -> DataFrame:
    """Per session: whether a prompt goes unanswered, a reply comes first, and how many prompts there are."""
    talk = rows.where("is_prompt or is_reply").select("session", "seg", "at", "line_no", "transcript", "is_prompt")
    w = Window.partitionBy("session", "seg").orderBy("at", "line_no", "transcript")
    talk = talk.withColumn("twice", F.col("is_prompt") & F.coalesce(F.lag("is_prompt").over(w), F.lit(False)))
    place = F.struct("at", "line_no", "transcript")
    parts = talk.groupBy("session", "seg").agg(F.max("twice").alias("twice"), F.min_by("is_prompt", place).alias("head"), F.max_by("is_prompt", place).alias("tail"), F.count_if("is_prompt").alias("prompts"), F.count_if(~F.col("is_prompt")).alias("replies"))
    s = Window.partitionBy("session").orderBy("seg")
    parts = parts.withColumn("twice", F.col("twice") | (F.col("head") & F.coalesce(F.lag("tail").over(s), F.lit(False))))
    return parts.groupBy("session").agg(F.sum("prompts").alias("prompts"), F.sum("replies").alias("replies"), (~F.min_by("head", "seg")).alias("reply_first"), (F.max("twice") | F.max_by("tail", "seg")).alias("unanswered"))


def _pairing(rows: DataFrame) -> DataFrame:
    """Per session: whether a call lacks a result or a result lacks an earlier call."""
    tools = rows.where("is_call or is_result")
    place = F.struct("at", "line_no", "transcript")
    by_id = tools.where("tool_use_id is not null").groupBy("session", "tool_use_id").agg(F.min(F.when(F.col("is_call"), place)).alias("call"), F.min(F.when(F.col("is_result"), place)).alias("result"))
    lost = by_id.select("session", F.col("result").isNull().alias("no_result"), (F.col("result").isNotNull() & F.coalesce(F.col("call") >= F.col("result"), F.lit(True))).alias("no_call"))
    none = tools.where("tool_use_id is null").select("session", F.col("is_call").alias("no_result"), F.col("is_result").alias("no_call"))
    return lost.unionAll(none).groupBy("session").agg(F.max("no_result").alias("no_result"), F.max("no_call").alias("no_call"))


def session_report(calls: DataFrame) -> DataFrame:
    """One row a session: counts, each fault, and ``left_out``."""
    rows, others = main_rows(calls)
    return _report(rows, others)


def _report(rows: DataFrame, others: DataFrame) -> DataFrame:
    sessions = rows.select("session").distinct().unionAll(others).distinct()
    no = F.lit(False)
    out = sessions.join(_breaks(rows), "session", "left").join(_pairing(rows), "session", "left").select(
        "session", F.coalesce("prompts", F.lit(0)).alias("prompts"), F.coalesce("replies", F.lit(0)).alias("replies"),
        (F.coalesce("prompts", F.lit(0)) == 0).alias("no_prompt"), F.coalesce("reply_first", no).alias("reply_first"), F.coalesce("unanswered", no).alias("unanswered"),
        F.coalesce("no_result", no).alias("no_result"), F.coalesce("no_call", no).alias("no_call"),
    )
    return out.withColumn("left_out", F.col("no_prompt") | F.col("reply_first") | F.col("unanswered") | F.col("no_result") | F.col("no_call"))


def calibrated_gap(rows: DataFrame) -> DataFrame:
    """One row: ``gap``, the seconds of silence that best part short gaps from long ones.

    A histogram of the logarithms of all gaps (about 270 bins) is split where the variance between the
    two sides is largest (Otsu). Fewer than two kinds of gaps give null: nothing is split.
    """
    w = Window.partitionBy("session", "seg").orderBy("at", "line_no", "transcript")
    low, high = GAP_RANGE
    gaps = rows.select((F.col("at") - F.lag("at").over(w)).alias("gap")).where("gap is not null")
    bins = gaps.select(F.greatest(F.lit(low), F.least(F.lit(high), F.col("gap"))).alias("gap")).select(F.round(F.log2("gap") * GAP_BINS).cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    up, all_ = Window.orderBy("bin"), Window.partitionBy()
    x = bins.withColumns({"n0": F.sum("n").over(up), "s0": F.sum(F.col("n") * F.col("bin")).over(up), "n1": F.sum("n").over(all_), "s1": F.sum(F.col("n") * F.col("bin")).over(all_)})
    x = x.where("n1 > n0").withColumn("apart", F.col("n0") * (F.col("n1") - F.col("n0")) * F.pow(F.col("s0") / F.col("n0") - (F.col("s1") - F.col("s0")) / (F.col("n1") - F.col("n0")), 2))
    return x.agg(F.pow(F.lit(2.0), (F.max_by("bin", "apart") + 0.5) / GAP_BINS).alias("gap"))


def without_partial(rows: DataFrame) -> DataFrame:
    """``rows`` without replies that are the beginning of a longer reply with the same session and message id."""
    replies = rows.where("is_reply and not is_call and message_id is not null")
    whole = replies.groupBy("session", "message_id").agg(F.max_by(F.struct("row_id", "text"), F.struct(F.char_length("text"), "at", "line_no", "row_id")).alias("whole"), F.count(F.lit(1)).alias("sent")).where("sent > 1")
    both = rows.join(whole.select("session", "message_id", "whole"), ["session", "message_id"], "left")
    partial = F.col("is_reply") & ~F.col("is_call") & (F.col("row_id") != F.col("whole.row_id")) & F.startswith(F.col("whole.text"), F.regexp_replace("text", r"(\s|…|\.\.\.)+$", ""))
    return both.where(~F.coalesce(partial, F.lit(False))).drop("whole")


def rebuild(calls: DataFrame) -> DataFrame:
    """The ordered rows of the sessions that are kept, one row a message.

    session, seq (from 1), turn (prompts so far), episode (from 1), role, kind (prompt, reply, call,
    result, other), text, tool, tool_use_id, result_text and result_error (of a call).
    """
    rows, others = main_rows(calls)
    keep = _report(rows, others).where("not left_out").select("session")
    w = Window.partitionBy("session", "seg").orderBy("at", "line_no", "transcript")
    kind = F.when(F.col("is_prompt"), "prompt").when(F.col("is_call"), "call").when(F.col("is_result"), "result").when(F.col("is_reply"), "reply").otherwise("other")
    role = F.coalesce(F.lower(F.trim("role")), F.when(F.col("is_result"), "tool").when(F.col("prompt").isNotNull(), "user").when(F.col("text").isNotNull(), "assistant").otherwise("system"))
    got = without_partial(rows.join(keep, "session")).withColumns({"kind": kind, "role": role, "_n": F.row_number().over(w), "_p": F.sum(F.col("is_prompt").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_gap": F.col("at") - F.lag("at").over(w)})
    gap = calibrated_gap(rows)
    got = got.crossJoin(F.broadcast(gap)).withColumn("_e", F.sum(F.coalesce((F.col("_gap") > F.col("gap")).cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = got.groupBy("session", "seg").agg(F.max("_n").alias("n"), F.max("_p").alias("p"), F.max("_e").alias("e"), F.min("at").alias("head"), F.max("at").alias("tail"), F.max("gap").alias("gap"))
    s = Window.partitionBy("session").orderBy("seg")
    jump = F.coalesce((F.col("head") - F.lag("tail").over(s) > F.col("gap")).cast("int"), F.lit(0))
    ends = ends.withColumn("jump", jump)
    prior = s.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    base = ends.select("session", "seg", F.coalesce(F.sum("n").over(prior), zero).alias("n0"), F.coalesce(F.sum("p").over(prior), zero).alias("p0"), (F.coalesce(F.sum("e").over(prior), zero) + F.sum("jump").over(s.rowsBetween(Window.unboundedPreceding, 0))).alias("e0"))
    results = rows.where("is_result and tool_use_id is not null").groupBy("session", "tool_use_id").agg(F.min_by(F.struct("text", "is_error"), F.struct("at", "line_no")).alias("res")).withColumn("kind", F.lit("call"))
    out = got.join(base, ["session", "seg"]).join(results, ["session", "tool_use_id", "kind"], "left")
    return out.select("session", (F.col("n0") + F.col("_n")).alias("seq"), (F.col("p0") + F.col("_p")).alias("turn"), (F.col("e0") + F.col("_e") + 1).alias("episode"), "role", "kind", F.coalesce("prompt", "text").alias("text"), "tool", "tool_use_id", F.col("res.text").alias("result_text"), F.col("res.is_error").alias("result_error"))
