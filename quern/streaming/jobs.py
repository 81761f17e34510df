"""Structured Streaming jobs. Each runs over what is there (availableNow) and can run on without a change.

A job keeps its offsets, its state and its rows in one folder with a name. Run again with the same folder it goes on
where it ended: what was read is not read again, and a batch that is repeated after a failure replaces what it wrote.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.session import ensure_checkpoint_dir


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder, for a job that starts from nothing."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, whether the table is one file or a folder of files."""
    path = f"{sf_dir}/events.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    rows = reader.parquet(path) if folder else reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(spark: SparkSession, out: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream to its end into files of ``folder``, and read all that it ever wrote there."""
    out.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").format("parquet").option("path", f"{folder}/rows").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/rows")


def fold(spark: SparkSession, stream: DataFrame, folder: str, add: Callable[[DataFrame, DataFrame | None], DataFrame]) -> DataFrame:
    """An incremental fold: ``add(batch, totals so far)`` gives the new totals.

    Totals are written beside the number of the batch that made them. A batch starts from the highest number below its
    own, so that it gives the same when it is repeated, and a restart finds the totals in the folder, not in the driver.
    """
    import re

    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(f"{folder}/totals")
    files = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def numbers() -> list[int]:
        if not files.exists(base):
            return []
        names = [re.fullmatch(r"batch-(\d+)", s.getPath().getName()) for s in files.listStatus(base)]
        return sorted(int(m[1]) for m in names if m and files.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/totals/{m[0]}/_SUCCESS")))

    def step(batch: DataFrame, number: int) -> None:
        before = [n for n in numbers() if n < number]
        add(batch, spark.read.parquet(f"{folder}/totals/batch-{before[-1]}") if before else None).write.mode("overwrite").parquet(f"{folder}/totals/batch-{number}")

    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/totals/batch-{numbers()[-1]}")


def unique_events(spark: SparkSession, sf_dir: str, folder: str | None = None, key: Iterable[str] = ("event_id",)) -> DataFrame:
    """Idempotent ingest: a natural key counts once within the lateness bound."""
    x = event_stream(spark, sf_dir).select("event_id", "ts", "user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("note"))
    return drain(spark, x.withWatermark("ts", "80 days").dropDuplicatesWithinWatermark(list(key)), folder or new_folder(spark, "unique"))


def replayed_events(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """At-least-once delivery: every event comes twice with the same id, and counts once."""
    x = event_stream(spark, sf_dir).select("event_id", "ts", "event_type")
    twice = x.unionByName(event_stream(spark, sf_dir).select("event_id", "ts", "event_type"))
    return drain(spark, twice.withWatermark("ts", "80 days").dropDuplicatesWithinWatermark(["event_id"]), folder or new_folder(spark, "replayed"))


def late_events(spark: SparkSession, sf_dir: str, now: str, folder: str | None = None) -> DataFrame:
    """Events from more than a day ahead or more than 80 days ago are refused; a time ahead of now is clamped to it."""
    at = F.lit(now).cast("timestamp")
    x = event_stream(spark, sf_dir).where((F.col("ts") <= at + F.expr("INTERVAL 1 DAY")) & (F.col("ts") >= at - F.expr("INTERVAL 80 DAYS")))
    return drain(spark, x.select("event_id", "event_type", F.least("ts", at).alias("ts"), (F.col("ts") > at).alias("clamped")), folder or new_folder(spark, "late"))


def hourly_costs(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """Tumbling hours; an hour is put out once the watermark has passed it."""
    x = event_stream(spark, sf_dir).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("cost"))
    return drain(spark, x.select(F.col("window.start").alias("hour"), "event_type", "n", "cost"), folder or new_folder(spark, "hours"))


def sliding_counts(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """Fourteen-day windows that slide by a day; those that the watermark has passed are put out and leave the state."""
    x = event_stream(spark, sf_dir).withWatermark("ts", "1 day").groupBy(F.window("ts", "14 days", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return drain(spark, x.select(F.col("window.start").alias("start"), "event_type", "n", "value"), folder or new_folder(spark, "sliding"))


def sessions(spark: SparkSession, sf_dir: str, gap: str = "6 hours", folder: str | None = None) -> DataFrame:
    """Sessions of a user: a silence of ``gap`` ends one; those that have ended for sure are put out."""
    x = event_stream(spark, sf_dir).withWatermark("ts", "1 hour").groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("events"))
    return drain(spark, x.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events"), folder or new_folder(spark, "sessions"))


def _totals(batch: DataFrame, before: DataFrame | None) -> DataFrame:
    new = batch.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.max("event_id").alias("folded"))
    if before is None:
        return new
    return new.unionByName(before).groupBy("user_id").agg(F.sum("events").alias("events"), F.max("folded").alias("folded"))


def fold_totals(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """Totals by user with the highest id folded: by id, never by clock."""
    return fold(spark, event_stream(spark, sf_dir).select("user_id", "event_id"), folder or new_folder(spark, "fold"), _totals)


def _marks(batch: DataFrame, before: DataFrame | None) -> DataFrame:
    new = batch.groupBy("user_id").agg(F.max("ts").alias("mark"))
    return new if before is None else new.unionByName(before).groupBy("user_id").agg(F.max("mark").alias("mark"))


def high_water_marks(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The newest time committed for each user."""
    return fold(spark, event_stream(spark, sf_dir).select("user_id", "ts"), folder or new_folder(spark, "marks"), _marks)


def _index(batch: DataFrame, before: DataFrame | None) -> DataFrame:
    """Postings as signed counts: a note that changes leaves with its old terms and enters with the new ones."""
    last = batch.groupBy("note").agg(F.max_by("terms", "rev").alias("terms"), F.max("rev").alias("rev"))
    if before is None:
        return last
    newer = last.unionByName(before)
    return newer.groupBy("note").agg(F.max_by("terms", "rev").alias("terms"), F.max("rev").alias("rev"))


def maintained_index(spark: SparkSession, notes: DataFrame, folder: str | None = None) -> DataFrame:
    """(note, rev, terms) kept up to date from a stream of revisions (note, rev, terms)."""
    return fold(spark, notes, folder or new_folder(spark, "index"), _index)


SEEN = "notes array<bigint>"
FOUND = "user_id long, event_id long, note long, ts timestamp"


def _after_shown(kind: str) -> Callable:
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = set(state.get[0]) if state.exists else set()
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for r in rows.itertuples():
            if r.event_type == "view":
                seen.add(int(r.note))
            elif r.event_type == kind and int(r.note) in seen:
                out.append((int(key[0]), int(r.event_id), int(r.note), r.ts))
        state.update((sorted(seen),))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "note", "ts"]).astype({"user_id": "int64", "event_id": "int64", "note": "int64", "ts": "datetime64[ns]"})

    return step


def after_shown(spark: SparkSession, sf_dir: str, kind: str, folder: str | None = None) -> DataFrame:
    """Events of a kind on a note that was shown to the same user before: a state machine for each user over all batches.

    What was shown is the state, at most one entry a note.
    """
    x = event_stream(spark, sf_dir).where(F.col("event_type").isin("view", kind)).select("user_id", "event_id", "event_type", "ts", F.get_json_object("props", "$.k").cast("long").alias("note")).where("note is not null")
    out = x.groupBy("user_id").applyInPandasWithState(_after_shown(kind), FOUND, SEEN, "append", GroupStateTimeout.NoTimeout)
    return drain(spark, out, folder or new_folder(spark, "shown"))


def follow_lines(spark: SparkSession, source: str, folder: str) -> DataFrame:
    """Lines of the text files of ``source`` that are new since the last run with this ``folder``; all lines so far come back."""
    return drain(spark, spark.readStream.text(source).select("value", F.col("_metadata.file_name").alias("file")), folder)
