"""Running totals of any length, without one task that sorts a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldkeep.session import materialize


def same(a: DataFrame, b: DataFrame, names: list[str], prefix: str) -> Column:
    """Equal in ``names`` (``prefix`` in front of them in ``b``), nulls too."""
    return reduce(lambda x, y: x & y, [a[n].eqNullSafe(b[prefix + n]) for n in names])


def running(rows: DataFrame, by: list[str], order: list[str], values: dict[str, str], how: str, name: str) -> DataFrame:
    """``rows`` with the sum or maximum (``how``) of each of ``values`` (from column to new column) over the group's rows up to this one.

    Rows are dealt by ranges of group and order and written. A group that lies in
    several ranges carries on what its ranges before come to; such ranges are at
    most two a task, so their table is broadcast.
    """
    agg, top = {"sum": (F.sum, lambda a, b: F.when(a.isNull() | b.isNull(), F.coalesce(a, b)).otherwise(a + b)), "max": (F.max, F.greatest)}[how]
    dealt = materialize(rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), name)
    each = dealt.groupBy(*by, "_part").agg(*[agg(c).alias("_all_" + c) for c in values])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = each.withColumn("_more", F.count("*").over(before)).select("_more", *[F.col(c).alias("_b_" + c) for c in [*by, "_part"]], *[agg("_all_" + c).over(before).alias("_before_" + c) for c in values])
    carried = materialize(carried.where("_more > 0").drop("_more"), name)
    here = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = dealt.select(*rows.columns, "_part", *[agg(c).over(here).alias(out) for c, out in values.items()])
    both = within.join(F.broadcast(carried), same(within, carried, [*by, "_part"], "_b_"), "left")
    return both.select(*rows.columns, *[top(F.col(out), F.col("_before_" + c)).alias(out) for c, out in values.items()])
