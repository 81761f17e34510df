"""Rows matched by the labels they share. Rows with the same labels are matched once, as one set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.ranking import _flat, block_product, packed
from quern.session import cut_lineage, stored


def sets(notes: DataFrame, k: int, *more: str) -> DataFrame:
    """(own, id, notes) of ``notes`` (memory_id, own, more): every set of labels with its ``k`` lowest notes and, as id, the lowest."""
    first = Window.partitionBy("own").orderBy("memory_id")
    low = notes.where(F.size("own") > 0).withColumn("n", F.row_number().over(first)).where(F.col("n") <= k)
    return stored(low.groupBy("own").agg(F.min("memory_id").alias("id"), F.array_sort(F.collect_list(F.struct("memory_id", *more))).alias("notes")))


def known(rows: DataFrame, keys: list[str], labels: DataFrame) -> DataFrame:
    """(keys, asked) of ``rows`` (keys, words): the words of a key that are in ``labels`` (label), sorted; keys with none are left out."""
    each = stored(rows.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("words")))).alias("words")))
    found = each.select("words").distinct().select("words", F.explode("words").alias("label")).join(labels, "label").groupBy("words").agg(F.array_sort(F.collect_list("label")).alias("asked"))
    return stored(each.join(found, "words").select(*keys, "asked"))


def shared(asked: DataFrame, own: DataFrame) -> DataFrame:
    """(asked, own, label): the labels that a set of ``asked`` and one of ``own`` have in common."""
    a = asked.select("asked").distinct().select("asked", F.explode("asked").alias("label"))
    return a.join(own.select("own", F.explode("own").alias("label")), "label")


def top_shared(asked: DataFrame, own: DataFrame, k: int) -> DataFrame:
    """(query, id, hits): for sets (query, asked) at least the ``k`` of the sets (id, own) with most labels in common, then the lowest id."""
    rows = packed(own.select(F.col("id").cast("long").alias("id"), F.col("own").alias("words")))
    asks = cut_lineage(packed(asked.select("query", F.col("asked").alias("terms"))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = {name: batch.column(name).slice(i, 1) for name in batch.schema.names}
                ids, queries = (one[x].flatten().to_numpy() for x in ("id", "query"))
                (long, words), (wide, terms) = _flat(one["words"]), _flat(one["terms"])
                n, m = len(queries), len(ids)
                hits = np.rint(block_product(np.repeat(np.arange(n), wide), terms, np.ones(len(terms)), np.repeat(np.arange(m), long), words, np.ones(len(words)), n, m))
                place = np.empty(m)
                place[np.argsort(ids)] = np.arange(m)
                key = hits * m - place  # unique in a row, so that ties don't add up
                got = np.argpartition(-key, k - 1, axis=1)[:, :k] if m > k else np.tile(np.arange(m), (n, 1))
                query, column = np.repeat(np.arange(n), got.shape[1]), got.ravel()
                query, column = query[keep := hits[query, column] > 0], column[keep]
                yield pa.RecordBatch.from_arrays([pa.array(queries[query], pa.int64()), pa.array(ids[column], pa.int64()), pa.array(hits[query, column].astype(np.int64))], names=["query", "id", "hits"])

    return rows.crossJoin(asks).mapInArrow(score, "query long, id long, hits long")
