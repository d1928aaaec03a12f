"""The engine's operators that Spark has no single call for, as functions of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .recursion import checkpointed


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def collect(value: Column, *order: Column) -> Column:
    """An aggregate of all values, NULLs among them, in ascending order of the given columns."""
    if not order:
        return F.transform(F.collect_list(F.struct(value.alias("v"))), lambda x: x["v"])
    keys = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order)))
    return F.transform(F.array_sort(F.collect_list(F.struct(keys.alias("k"), value.alias("v")))), lambda x: x["v"])


def with_index(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Numbers rows from 1 in an order, without gathering them: counts of range partitions, then numbers within each."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    w = Window.partitionBy("__p").orderBy(*order)
    # read twice: bounds of ranges are sampled anew each time they are worked out
    numbered = checkpointed(parts.withColumn("__i", F.row_number().over(w)))
    counts = numbered.groupBy("__p").agg(F.max("__i").alias("__c"))
    before = counts.withColumn("__b", F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return numbered.join(F.broadcast(before.select("__p", "__b")), "__p").withColumn(name, F.col("__i") + F.col("__b")).drop("__p", "__i", "__b")


def dependent_join(df: DataFrame, mapping: DataFrame, outer: bool = False) -> DataFrame:
    """Each row with the rows that a correlated frame (built with .outer() columns) gives for it."""
    return df.lateralJoin(mapping, how="left" if outer else "inner")
