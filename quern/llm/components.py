"""Connected components by hooking, pointer jumping and contraction; every step is a shuffle join
or a partial aggregation, and each round at least halves the components that still have links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import cut_lineage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its smallest node.

    Null ends and loops are ignored as links (a loop still names its node). Repeated rows and either
    order of a pair make no difference. No edges give an empty result.
    """
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null")
    live = cut_lineage(pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    comp = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("root", F.col("node"))
    while not live.isEmpty():
        both = live.select("u", "v").unionAll(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = cut_lineage(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")))
        while True:
            up = hook.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            hook = cut_lineage(hook.join(up, "p").select("u", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")))
            if hook.where("moved").isEmpty():
                break
            hook = hook.drop("moved")
        hook = hook.select("u", "p")
        comp = cut_lineage(comp.join(hook.withColumnRenamed("u", "root"), "root", "left").select("node", F.coalesce("p", "root").alias("root")))
        moved = live.join(hook.withColumnRenamed("p", "pu"), "u").join(hook.select(F.col("u").alias("v"), F.col("p").alias("pv")), "v")
        live = cut_lineage(moved.where("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())
    return comp.select("node", F.col("root").alias("component"))
