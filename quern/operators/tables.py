"""Table maintenance without a transactional store: newest versions, upserts, anti-joins, scan plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is highest in ``order``; one partial aggregation, no sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def live() -> Column:
    return F.col("archived_at").isNull() & F.col("deleted_at").isNull()


def insert_ignore(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not in ``old``, one each."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def scan_plan(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, op): insert, update, revive, move, delete or same, from two snapshots with ``content_hash`` and ``gone``."""
    old = before.select(*keys, F.col("content_hash").alias("old_hash"), F.col("gone").alias("was_gone"))
    new = after.select(*keys, F.col("content_hash").alias("new_hash"))
    both = old.join(new, keys, "full_outer")
    lost = Window.partitionBy("old_hash").orderBy(*keys)
    fresh = Window.partitionBy("new_hash").orderBy(*keys)
    left = both.where("new_hash is null and not was_gone").select(F.col("old_hash").alias("h"), F.row_number().over(lost).alias("i"), F.lit(True).alias("moved"))
    come = both.where("old_hash is null").withColumn("i", F.row_number().over(fresh))
    placed = come.join(left.withColumnRenamed("h", "new_hash"), ["new_hash", "i"], "left").select(*keys, F.when(F.col("moved"), "move").otherwise("insert").alias("op"))
    rest = both.where("old_hash is not null").select(*keys, F.when(F.col("new_hash").isNull(), F.when(F.col("was_gone"), "same").otherwise("delete")).when(F.col("was_gone"), "revive").when(F.col("old_hash") != F.col("new_hash"), "update").otherwise("same").alias("op"))
    return placed.unionByName(rest)
