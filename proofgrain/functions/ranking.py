"""Numbering rows inside groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofgrain.session import cut_lineage


def number_repeats(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "n") -> DataFrame:
    """The rows of groups with two or more members, numbered from 1 in ``order``.

    Single rows are left out before anything is sorted.  The rest is dealt in ranges of
    (group, order), so a group of any size spreads over as many tasks as it needs.  Each slice
    of a group is numbered by itself and then shifted by the sizes of the slices before it.
    Both the given and the dealt rows are written: the first may be costly to make, and the
    slices of the second must not change if a task runs again.
    """
    group, order = list(group), list(order)
    df = cut_lineage(df)
    several = df.groupBy(*group).agg(F.count("*").alias("_size")).where("_size > 1").drop("_size")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_lineage(df.join(several, group).repartitionByRange(parts, *group, *order).withColumn("_slice", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy(*group, "_slice").orderBy(*order))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shift = dealt.groupBy(*group, "_slice").agg(F.count("*").alias("_n")).select(*group, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    numbered = dealt.withColumn("_in", inside).join(shift, [*group, "_slice"])
    return numbered.withColumn(name, F.col("_in") + F.col("_shift")).drop("_in", "_shift", "_slice")
