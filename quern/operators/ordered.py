"""Ordered scans without a task for a whole group.

Rows are range partitioned by (group, order), so a hot group spreads over many segments. A segment is scanned by
itself; what crosses a border (a running sum, the last known value, the rows so far) is carried by one small row
a segment and group. Segments are written once, as range bounds are sampled anew whenever a plan runs again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import stored

SEGMENT = "_segment"


def segmented(df: DataFrame, *order: str) -> DataFrame:
    return stored(df.repartitionByRange(*order).withColumn(SEGMENT, F.spark_partition_id()))


def scan(df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, before: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with running values by group in ascending ``order``, which is unique in a group.

    ``sums``: up to and with the row; ``lasts``: the last value that isn't null, up to and with the row; ``before``: the same
    without the row. The result keeps its segments, so that another scan in the same order needs no second shuffle by range.
    """
    sums, lasts, before = sums or {}, lasts or {}, before or {}
    rows = df if SEGMENT in df.columns else segmented(df, *by, *order)
    w = Window.partitionBy(SEGMENT, *by).orderBy(*order)
    upto, prior = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*order)
    last = {**lasts, **before}
    ends = rows.groupBy(SEGMENT, *by).agg(*[F.sum(c).alias(f"_end_{n}") for n, c in sums.items()], *[F.max_by(c, F.when(c.isNotNull(), place)).alias(f"_end_{n}") for n, c in last.items()])
    s = Window.partitionBy(*by).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(SEGMENT, *by, *[F.sum(f"_end_{n}").over(s).alias(f"_carry_{n}") for n in sums], *[F.last(f"_end_{n}", ignorenulls=True).over(s).alias(f"_carry_{n}") for n in last])
    zero = F.lit(0)
    own = {**{n: F.sum(c).over(upto) for n, c in sums.items()}, **{n: F.last(c, ignorenulls=True).over(upto) for n, c in lasts.items()}, **{n: F.last(c, ignorenulls=True).over(prior) for n, c in before.items()}}
    out = rows.withColumns({f"_own_{n}": c for n, c in own.items()}).join(carry, [SEGMENT, *by])
    values = {n: F.coalesce(f"_own_{n}", zero) + F.coalesce(f"_carry_{n}", zero) if n in sums else F.coalesce(f"_own_{n}", f"_carry_{n}") for n in own}
    return out.select(*rows.columns, *[v.alias(n) for n, v in values.items()])


def numbered(df: DataFrame, order: list[str], by: list[str] | None = None, name: str = "i") -> DataFrame:
    """``df`` with its place (from 1) in ascending ``order``, of all rows or of a group."""
    by = by or []
    if by:
        return scan(df, by, order, sums={name: F.lit(1)}).drop(SEGMENT)
    rows = segmented(df, *order)
    sizes = rows.groupBy(SEGMENT).agg(F.count(F.lit(1)).alias("_n"))
    # one row a segment
    carry = sizes.select(SEGMENT, F.coalesce(F.sum("_n").over(Window.orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_n"))
    return rows.withColumn("_i", F.row_number().over(Window.partitionBy(SEGMENT).orderBy(*order))).join(carry, SEGMENT).withColumn(name, F.col("_i") + F.col("_n")).drop("_i", "_n", SEGMENT)
