"""Relational breadth over the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.registry import query
from quern.session import table


@query("star_pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, d):
    x = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("date"))
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("star_nation_rollup", "SELECT r_name, n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def nation_rollup(spark, d):
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("customers"))


@query("star_top_orders", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 2")
def top_orders(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return table(spark, d, "orders").withColumn("rn", F.row_number().over(w)).where("rn <= 2").select("o_custkey", "o_orderkey", "o_totalprice")
