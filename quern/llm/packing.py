"""Problem 6: fill containers of fixed capacity with whole documents.

Vector bin packing by the dot-product heuristic: a container has room in three directions at once (tokens,
segments, loss-bearing tokens), and takes, of the items that fit, the one whose demand points most in
the direction of the room that is left. Documents above a capacity are cut into full pieces, which
fill a container each, and a rest that is packed like any other.

Items are dealt to lots by a hash of their id, and each lot of about ``LOT`` items is packed by itself, so
work and memory of a task stay the same at any scale; a lot leaves at most a few containers that
could have been shared.

Defined results: null and blank texts are items of no tokens and take a segment only; a capacity that is
null or below one is left out; an empty table gives no rows. ``loss_tokens`` of a piece are in
proportion to its length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.tokens import VOCABULARY, token_counts
from quern.session import cut_lineage

LOT = 25_000
#: A container takes a segment for every so many tokens of its capacity, but at least LEAST_SEGMENTS.
TOKENS_PER_SEGMENT, LEAST_SEGMENTS = 32, 16
LOSS_SHARE = 1.0


def pack(tokens: np.ndarray, loss: np.ndarray, capacity: int, segments: int, loss_capacity: int) -> np.ndarray:
    """The container number of each item. Items above a limit are an error."""
    n = len(tokens)
    if n and (tokens.max() > capacity or loss.max() > loss_capacity):
        raise ValueError("an item is larger than a container")
    order = np.lexsort((-loss, -tokens))
    t, s = tokens[order].astype(np.float64), loss[order].astype(np.float64)
    where = np.empty(n, dtype=np.int64)
    at = np.arange(n)
    alive = np.ones(n, dtype=bool)
    gone = container = 0
    room = np.array([capacity, segments, loss_capacity], dtype=np.float64)
    size = room.copy()
    left = n
    scale = np.array([1 / capacity, 1 / segments, 1 / max(1, loss_capacity)])
    while left:
        pull = room * scale * scale
        low = int(np.searchsorted(-t, -room[0], side="left"))
        fit = alive[low:] & (s[low:] <= room[2]) if room[1] >= 1 else np.zeros(0, dtype=bool)
        if not fit.any():
            container += 1
            room = size.copy()
            continue
        score = np.where(fit, t[low:] * pull[0] + s[low:] * pull[2], -1.0)
        k = low + int(np.argmax(score))
        where[order[at[k]]] = container
        alive[k] = False
        room -= (t[k], 1, s[k])
        left -= 1
        gone += 1
        if gone > 512 and gone * 4 > len(t):
            t, s, at, alive, gone = t[alive], s[alive], at[alive], alive[alive], 0
    return where


def loss_limit(capacity: int, share: float) -> int:
    return max(1, int(capacity * share))


def items(counts: DataFrame, sizes: list[tuple[str, int]], loss_share: float = LOSS_SHARE) -> DataFrame:
    """(pack_name, capacity_tokens, doc_id, piece_no, from_token, tokens, loss_tokens): whole documents, or pieces."""
    capacity = F.col("capacity_tokens")
    kinds = F.array(*[F.struct(F.lit(name).alias("pack_name"), F.lit(size).cast("long").alias("capacity_tokens"), F.lit(loss_limit(size, loss_share)).cast("long").alias("loss_capacity")) for name, size in sizes])
    each = counts.select("*", F.inline(kinds))
    # so long is a full piece that neither its tokens nor its share of the loss are above a limit
    step = F.least(capacity, F.when(F.col("loss_tokens") > F.col("loss_capacity"), F.greatest(F.lit(1), F.floor(F.col("tokens") * F.col("loss_capacity") / F.col("loss_tokens")))).otherwise(capacity))
    each = each.withColumn("step", step)
    pieces = F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("step"))).cast("int")
    cut = each.select("pack_name", "capacity_tokens", "step", "doc_id", F.col("tokens").alias("all"), F.col("loss_tokens").alias("all_loss"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece_no"))
    start = F.col("piece_no") * F.col("step")
    size = F.least(F.col("step"), F.col("all") - start)
    share = lambda upto: F.floor(F.col("all_loss") * upto / F.greatest(F.col("all"), F.lit(1)))
    return cut.select("pack_name", "capacity_tokens", "doc_id", "piece_no", start.alias("from_token"), size.alias("tokens"), (share(start + size) - share(start)).alias("loss_tokens"))


#: Container sizes are a small table by nature; more are an error.
MAX_SIZES = 1000


def pack_documents(documents: DataFrame, sizes: DataFrame, vocabulary: str = VOCABULARY, lot: int = LOT, loss_share: float = LOSS_SHARE, tokens_per_segment: int = TOKENS_PER_SEGMENT) -> DataFrame:
    """One row an item: where it is, and how full its container is."""
    counts = cut_lineage(token_counts(documents, vocabulary=vocabulary))
    rows = sizes.where("capacity_tokens >= 1 and pack_name is not null").groupBy("pack_name").agg(F.max("capacity_tokens").alias("capacity_tokens")).limit(MAX_SIZES + 1).collect()
    if len(rows) > MAX_SIZES:
        raise ValueError(f"more than {MAX_SIZES} container sizes")
    if not rows:
        return documents.sparkSession.createDataFrame([], SCHEMA)
    lots = max(1, -(-counts.count() // lot))

    def fill(batch: pd.DataFrame) -> pd.DataFrame:
        capacity = int(batch["capacity_tokens"].iloc[0])
        batch = batch.sort_values(["doc_id", "piece_no"], ignore_index=True)
        segments, loss_capacity = max(min(LEAST_SEGMENTS, tokens_per_segment), capacity // tokens_per_segment), loss_limit(capacity, loss_share)
        batch["container"] = pack(batch["tokens"].to_numpy(), batch["loss_tokens"].to_numpy(), capacity, segments, loss_capacity)
        of = batch.groupby("container")["tokens"]
        batch["container_tokens"], batch["container_items"] = of.transform("sum"), of.transform("size")
        batch["fill"] = batch["container_tokens"] / capacity
        batch["segment_fill"] = batch["container_items"] / segments
        batch["loss_fill"] = batch.groupby("container")["loss_tokens"].transform("sum") / loss_capacity
        batch["container_id"] = batch["lot"].astype(str) + "-" + batch["container"].astype(str)
        return batch[COLUMNS]

    lotted = items(counts, sorted((r.pack_name, r.capacity_tokens) for r in rows), loss_share).withColumn("lot", F.pmod(F.xxhash64("doc_id"), F.lit(lots)))
    return lotted.groupBy("pack_name", "lot").applyInPandas(fill, SCHEMA)


SCHEMA = "pack_name string, capacity_tokens long, container_id string, doc_id long, piece_no int, from_token long, tokens long, loss_tokens long, container_tokens long, container_items long, fill double, segment_fill double, loss_fill double"
COLUMNS = [part.split()[0] for part in SCHEMA.split(", ")]


def fill_report(packed: DataFrame) -> DataFrame:
    """Per container size: containers, items, tokens, the mean fill in each direction and how many containers reach each of the other limits."""
    each = packed.groupBy("pack_name", "capacity_tokens", "container_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("items"), F.max("segment_fill").alias("segments"), F.max("loss_fill").alias("loss"))
    n = F.count(F.lit(1))
    return each.groupBy("pack_name", "capacity_tokens").agg(
        n.alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), (F.sum("tokens") / (n * F.col("capacity_tokens"))).alias("mean_fill"),
        F.avg("segments").alias("mean_segment_fill"), F.avg("loss").alias("mean_loss_fill"), F.count_if(F.col("segments") >= 1).alias("full_in_segments"), F.count_if(F.col("loss") >= 0.995).alias("full_in_loss"),
    )
