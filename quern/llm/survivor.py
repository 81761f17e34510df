"""Problem 2: one surviving record for each group of duplicates.

Skyline selection. A record beats another when it is nowhere worse and somewhere better in
completeness (filled fields, a small integer), recency and trust. The first dominance layer is the set that
nobody beats, the next one the set that only records of earlier layers beat, and so on. A lexicographic policy
(completeness, recency, trust, votes of the judge, smallest id) picks the survivor from the first layer; a field it
lacks comes from the earliest layer that has it, by the same policy within the layer.

Groups of at most ``LOCAL_ROWS`` members are layered many at a time, each in one sweep by falling recency. A larger
group is never collected: its layers are peeled off one by one, each by running maxima, first within salted parts of
the group and then among what is left, until every field is filled that any member can give.

Null recency and trust are lowest. Members without a row in ``memories`` keep nulls.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.components import components
from quern.session import cut_lineage, stored

SALT_ROWS = 20_000
#: Groups of more members are layered by shuffles.
LOCAL_ROWS = 20_000
_LOWEST = -(2**62)


def filled(name: str) -> Column:
    """Not null, not blank, not an empty JSON list."""
    value = F.trim(F.regexp_replace(F.col(name), r"\s+", " "))
    return F.col(name).isNotNull() & (value != "") & (F.regexp_replace(value, r"\s", "") != "[]")


def latest_rows(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The row of each key that is highest in ``order``; repeated rows fall together."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order, F.xxhash64(*columns))).alias("r")).select(key, "r.*")


def merge_links(verdicts: DataFrame) -> DataFrame:
    """(a, b, votes...) of the pairs whose latest sure verdict is MERGE."""
    said = F.upper(F.trim(F.regexp_replace("verdict", r"\s+", " ")))
    chosen = F.upper(F.trim(F.regexp_replace("survivor", r"\s+", " ")))
    rows = verdicts.select(
        F.least("memory_a", "memory_b").alias("a"), F.greatest("memory_a", "memory_b").alias("b"), said.alias("said"), "judged_at", "verdict_id",
        F.when(chosen == "A", F.col("memory_a")).when(chosen == "B", F.col("memory_b")).alias("voted"), F.col("reason").alias("reason"),
    ).where("memory_a is not null and memory_b is not null and said is not null and said <> 'UNSURE' and said <> ''")
    last = rows.groupBy("a", "b").agg(F.max_by(F.struct("said", "voted", "reason"), F.struct("judged_at", "verdict_id")).alias("r"))
    return last.where("r.said = 'MERGE'").select("a", "b", "r.voted", "r.reason")


def skyline(df: DataFrame, keys: list[str], levels: int) -> DataFrame:
    """Rows that no row of the same ``keys`` dominates in (fullness, recency, trust).

    ``fullness`` is an integer in 0..levels-1, ``recency`` a long, ``trust`` a double, none null.
    Rows equal in all three don't dominate each other.
    """
    w = Window.partitionBy(*keys).orderBy(F.col("recency").desc())
    later = w.rangeBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy(*keys, "recency")
    no = F.lit(False)
    out = df
    for k in range(levels):
        here = F.when(F.col("fullness") >= k, F.col("trust"))
        out = out.withColumn(f"_later{k}", F.max(here).over(later)).withColumn(f"_same{k}", F.max(here).over(same))
    beaten = F.lit(False)
    for k in range(levels):
        above = F.col(f"_same{k + 1}") >= F.col("trust") if k + 1 < levels else no
        here = F.coalesce(F.col(f"_later{k}") >= F.col("trust"), no) | F.coalesce(F.col(f"_same{k}") > F.col("trust"), no) | F.coalesce(above, no)
        beaten = F.when(F.col("fullness") == k, here).otherwise(beaten)
    return out.where(~beaten).drop(*[f"_later{k}" for k in range(levels)], *[f"_same{k}" for k in range(levels)])


def salted_skyline(df: DataFrame, levels: int, group: str = "group_id", id_col: str = "memory_id") -> DataFrame:
    """``skyline`` per group, first in parts of about ``SALT_ROWS`` rows, so that no task holds a hot group."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("group_size") / SALT_ROWS))
    local = skyline(df.withColumn("_salt", F.pmod(F.xxhash64(id_col), parts)), [group, "_salt"], levels).drop("_salt")
    return skyline(local, [group], levels)


def _policy() -> Column:
    return F.struct("fullness", "recency", "trust", "votes", (-F.col("memory_id")).alias("low"))


FIELDS = ("name", "description", "category", "labels")


def members(memories: DataFrame, counts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Every member of every duplicate group with its current fields and the three measures."""
    links = cut_lineage(merge_links(verdicts))
    groups = components(links).select(F.col("node").alias("memory_id"), F.col("component").alias("group_id"))
    votes = links.where("voted is not null").groupBy(F.col("voted").alias("memory_id")).agg(F.count(F.lit(1)).alias("votes"), F.min("reason").alias("vote_reason"))
    rows = latest_rows(memories, "memory_id", ["rev"], list(FIELDS))
    trust = latest_rows(counts, "memory_id", ["folded_event_id"], ["last_used_at", "use_pos"])
    got = groups.join(rows, "memory_id", "left").join(trust, "memory_id", "left").join(votes, "memory_id", "left")
    fullness = sum((F.when(filled(f), 1).otherwise(0) for f in FIELDS), F.lit(0))
    sizes = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size"))
    return got.select(
        "memory_id", "group_id", *[F.when(filled(f), F.col(f)).alias(f) for f in FIELDS], "last_used_at", "vote_reason",
        fullness.alias("fullness"), F.coalesce(F.unix_micros(F.col("last_used_at").cast("timestamp")), F.lit(_LOWEST)).alias("recency"),
        F.coalesce(F.col("use_pos").cast("double"), F.lit(float("-inf"))).alias("trust"), F.coalesce("votes", F.lit(0)).alias("votes"),
    ).join(sizes, "group_id")


def layers_of(fullness: list[int], recency: list[int], trust: list[float], levels: int) -> list[int]:
    """The dominance layer of each member of one group, from 1: one more than the highest of those that beat it.

    By falling recency, then completeness, then trust, whoever beats a member stands before it. For each
    completeness the best trust of every layer is kept; it falls with the layer, so the highest layer with a trust at
    least as good is found by bisection. Equal members share a layer.
    """
    order = sorted(range(len(trust)), key=lambda i: (-recency[i], -fullness[i], -trust[i]))
    out = [0] * len(trust)
    best: list[list[float]] = [[] for _ in range(levels)]  # negative trust by layer, ascending
    last, at = None, 0
    for i in order:
        here = (recency[i], fullness[i], trust[i])
        if here != last:
            last, at = here, bisect_right(best[fullness[i]], -trust[i])
            for side in best[: fullness[i] + 1]:
                if at == len(side):
                    side.append(-trust[i])
                else:
                    side[at] = min(side[at], -trust[i])
        out[i] = at + 1
    return out


def _local_layers(members: DataFrame, levels: int) -> DataFrame:
    """(memory_id, layer) of groups of bounded size, many groups to a task."""
    lots = F.pmod(F.xxhash64("group_id"), F.lit(max(1, -(-members.count() // SALT_ROWS))))

    def layer(lot: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for _, one in lot.groupby("group_id", sort=False):
            got = layers_of(one["fullness"].tolist(), one["recency"].tolist(), one["trust"].tolist(), levels)
            parts.append(pd.DataFrame({"memory_id": one["memory_id"], "layer": got}))
        return pd.concat(parts)

    return members.select("memory_id", "group_id", "fullness", "recency", "trust", lots.alias("lot")).groupBy("lot").applyInPandas(layer, "memory_id long, layer int")


GIVEN = [*FIELDS, "last_used_at"]


def _peeled_layers(members: DataFrame, levels: int) -> DataFrame | None:
    """(memory_id, layer) of large groups, layer by layer until no further member can fill a field."""
    out, rest, k = None, members, 1
    while not rest.isEmpty():
        layer = stored(salted_skyline(rest, levels).select("memory_id", "group_id", *[F.col(f).isNotNull().alias(f"_has_{f}") for f in GIVEN]))
        done = layer.select("memory_id", F.lit(k).alias("layer"))
        out = done if out is None else out.unionByName(done)
        # a field that this layer has is settled in the group; members that can give nothing more only stand above others
        has = layer.groupBy("group_id").agg(*[F.max(f"_has_{f}").alias(f"_has_{f}") for f in GIVEN])
        rest = rest.join(layer.select("memory_id"), "memory_id", "left_anti").join(has, "group_id", "left")
        rest = rest.withColumns({f: F.when(F.coalesce(F.col(f"_has_{f}"), F.lit(False)), F.lit(None)).otherwise(F.col(f)) for f in GIVEN}).select(*members.columns)
        more = rest.groupBy("group_id").agg(F.max(F.greatest(*[F.col(f).isNotNull() for f in GIVEN])).alias("more")).where("more").select("group_id")
        rest = stored(rest.join(more, "group_id", "left_semi"))
        k += 1
    return out


def choose_survivors(memories: DataFrame, counts: DataFrame, verdicts: DataFrame, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """One row a group: group_id, survivor_id, the filled fields, the size of the first layer and the deepest layer used."""
    everyone = stored(members(memories, counts, verdicts))
    levels = len(FIELDS) + 1
    layers = _local_layers(everyone.where(F.col("group_size") <= local_rows), levels)
    peeled = _peeled_layers(everyone.where(F.col("group_size") > local_rows), levels)
    layers = layers if peeled is None else layers.unionByName(peeled)
    ranked = everyone.join(layers, "memory_id")
    order = F.struct((-F.col("layer")).alias("layer"), _policy().alias("policy"))
    row = F.struct("memory_id", *GIVEN, "group_size", "vote_reason")
    first = {f: F.max_by(F.struct(F.col(f).alias("value"), "layer"), F.when(F.col(f).isNotNull(), order)).alias(f"_{f}") for f in GIVEN}
    out = ranked.groupBy("group_id").agg(F.max_by(row, order).alias("r"), F.count_if(F.col("layer") == 1).alias("undominated"), *first.values())
    # the survivor's own value stands, even where another member of its layer comes first for a field alone
    value = {f: F.coalesce(F.col(f"r.{f}"), F.col(f"_{f}.value")).alias(f) for f in GIVEN}
    used = F.greatest(F.lit(1), *[F.when(F.col(f"r.{f}").isNull(), F.col(f"_{f}.layer")) for f in GIVEN])
    return out.select("group_id", F.col("r.memory_id").alias("survivor_id"), *value.values(), "r.group_size", F.col("r.vote_reason").alias("reason"), "undominated", used.alias("layers"))
