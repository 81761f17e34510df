"""Parts that a caller may replace: each operator takes them as functions on columns, with a plain default."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import tokens

Labeller = Callable[[Column], Column]  # text -> array of labels
Vectoriser = Callable[[Column], Column]  # text -> array<double>
Judge = Callable[[DataFrame], DataFrame]  # pairs (a, b, score) -> the same with ``verdict``
Eligible = Callable[[DataFrame], Column]  # a predicate over rows
Statistic = Callable[[Column, Column], Column]  # (value, weight) -> aggregate

DIMENSIONS = 16


def hash_bag(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """A deterministic vector of unit length: the tokens of a text counted by a hash; null where it has none."""
    slots = F.transform(tokens(text), lambda t: F.pmod(F.conv(F.substring(F.sha2(t, 256), 1, 8), 16, 10).cast("bigint"), F.lit(dimensions)))
    one = F.transform(F.array(slots), lambda s: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda k: F.size(F.filter(s, lambda x: x == k)).cast("double")))[0]
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(F.size(slots) > 0, F.transform(F.array(one), lambda v: F.transform(v, lambda x: x / norm(v)))[0])


def by_threshold(same: float, near: float) -> Judge:
    """The plainest judge: two thresholds on the score."""
    return lambda pairs: pairs.withColumn("verdict", F.when(F.col("score") >= same, "MERGE").when(F.col("score") >= near, "RELATED").otherwise("UNSURE"))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(weight))


#: Cumulative probabilities of the Poisson distribution with mean one.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)


def bootstrap(clusters: DataFrame, key: str, value: Column, draws: int, seed: int, statistic: Statistic = weighted_mean) -> DataFrame:
    """(draw, stat): a seeded bootstrap over clusters; each draw weighs a cluster by a Poisson number from a hash of its key.

    Rows of one cluster must have one ``key``; they keep one weight, so the clusters are drawn whole. Nothing is collected:
    a draw is a group of one aggregation.
    """
    draw = F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")
    u = F.conv(F.substring(F.sha2(F.concat_ws("-", F.lit(seed), "draw", key), 256), 1, 8), 16, 10).cast("double") / 4294967296.0
    weight = sum((F.when(F.col("u") >= p, 1).otherwise(0) for p in POISSON), F.lit(0))
    each = clusters.select(key, value.alias("value"), draw).withColumn("u", u).withColumn("weight", weight)
    return each.groupBy("draw").agg(statistic(F.col("value"), F.col("weight")).alias("stat"))
