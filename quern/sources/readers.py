"""Readers for note folders and line-delimited JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRY = T.StructType([
    T.StructField("source_type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("created_at", T.StringType()), T.StructField("updated_at", T.StringType()),
    T.StructField("pinned", T.BooleanType()), T.StructField("_corrupt", T.StringType()),
])


HEAD_BYTES = 256 * 1024


def decoded(content: Column) -> Column:
    """Bytes as text by their byte-order mark: UTF-32 (four bytes, looked at first), UTF-16, else UTF-8 without a mark."""
    four, two = F.hex(F.substring(content, 1, 4)), F.hex(F.substring(content, 1, 2))
    rest = lambda n: F.substring(content, n + 1, 2**31 - 1)
    text = F.when(four.isin("FFFE0000", "0000FEFF"), F.decode(content, "UTF-32")).when(two == "FFFE", F.decode(rest(2), "UTF-16LE")).when(two == "FEFF", F.decode(rest(2), "UTF-16BE"))
    return text.otherwise(F.regexp_replace(F.decode(content, "UTF-8"), "^\ufeff", ""))


def read_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Top-level, non-hidden Markdown files: root, path, content_hash (of the bytes), content. Blank files are skipped.

    A byte-order mark tells UTF-32 and UTF-16 text; all else is read as UTF-8.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!.]*.md").load(folder)
    parts = F.split("path", "/")
    out = files.select(F.element_at(parts, -2).alias("root"), F.element_at(parts, -1).alias("path"), F.sha2("content", 256).alias("content_hash"), decoded(F.col("content")).alias("content"), F.col("modificationTime").alias("modified_at"))
    return out.where(F.trim(F.regexp_replace("content", r"\s", "")) != "")


def discover(spark: SparkSession, folders: list[str]) -> DataFrame:
    """The notes of several folders; of two folders with one root name the first in the list wins, whole."""
    rows, taken = None, set()
    for folder in folders:
        root = folder.rstrip("/").rpartition("/")[2]
        if root in taken:
            continue
        taken.add(root)
        notes = read_notes(spark, folder)
        rows = notes if rows is None else rows.unionByName(notes)
    return rows


def changed_since(notes: DataFrame, stamps: DataFrame, racy_seconds: float = 2.0) -> DataFrame:
    """Notes whose hash is unknown or whose stamp (root, path, content_hash, modified_at, seen_at) can't be trusted.

    A file that changed within ``racy_seconds`` before it was seen may have changed again in the same tick of the clock.
    """
    known = stamps.select("root", "path", F.col("content_hash").alias("_hash"), F.col("modified_at").alias("_at"), "seen_at")
    both = notes.join(known, ["root", "path"], "left")
    racy = F.unix_micros("seen_at") - F.unix_micros("_at") < racy_seconds * 1_000_000
    return both.where(F.col("_hash").isNull() | (F.col("modified_at") != F.col("_at")) | racy).where(~F.coalesce((F.col("_hash") == F.col("content_hash")) & ~racy, F.lit(False))).drop("_hash", "_at", "seen_at")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, value): lines with their byte offsets in the file, so that order survives any split."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\n")).alias("at", "value"))
    return whole.where("value <> ''")


CALL = "type string, timestamp string, isMeta boolean, isSidechain boolean, sessionId string, message struct<id:string,role:string,content:string>"


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Transcript lines by glob: file, line_no, type, at, session, is_meta, sidechain, message_id, content; a line that is no JSON has a ``problem``."""
    x = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("n"), "value").where("trim(value) <> ''")
    e = F.from_json("value", CALL)
    good = F.try_parse_json("value").isNotNull()
    return x.select("file", "n", e["type"].alias("type"), e["timestamp"].try_cast("timestamp").alias("at"), e["sessionId"].alias("session"), F.coalesce(e["isMeta"], F.lit(False)).alias("is_meta"), F.coalesce(e["isSidechain"], F.lit(False)).alias("sidechain"), e["message"]["id"].alias("message_id"), e["message"]["content"].alias("content"), F.when(~good, "not JSON").alias("problem"))


def newest_lines(spark: SparkSession, path: str, lines: int) -> DataFrame:
    """The last ``lines`` lines of every file, newest first (``back`` from 1); the number is the feature."""
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy(F.col("at").desc())
    return _lines(spark, path).withColumn("back", F.row_number().over(w)).where(F.col("back") <= lines).drop("at")


def read_log(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """A log in JSON lines, rotated files and the current one; malformed lines are left out."""
    x = spark.read.text(paths).where(F.try_parse_json("value").isNotNull())
    return x.select(F.from_json("value", schema).alias("e")).where("e is not null").select("e.*")


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with an explicit schema; ``problem`` names what is wrong with a line, null if nothing is."""
    got = spark.read.text(path).withColumn("e", F.from_json("value", ENTRY, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    text = F.trim(F.coalesce("e.text", F.lit("")))
    problem = F.when(F.col("e._corrupt").isNotNull() | F.col("e").isNull(), "not JSON").when(text == "", "no text").when(F.length(text) > 1_000_000, "too long")
    return got.select("e.source_type", "e.text", "e.category", "e.labels", "e.created_at", "e.updated_at", "e.pinned", problem.alias("problem"), F.sha2(text, 256).alias("hash"))
