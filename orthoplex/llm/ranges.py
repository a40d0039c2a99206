"""Places and running sums over a whole table without bringing it to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orthoplex.llm import storage


def running(df: DataFrame, order: list[Column], sums: dict[str, str], few: bool = False) -> DataFrame:
    """Adds ``place`` (from 0) and, for each of ``sums``, the total over earlier rows, without bringing all rows to one task unless they are ``few``."""
    if few:
        own = Window.orderBy(*order)
        earlier = own.rowsBetween(Window.unboundedPreceding, -1)
        return df.select("*", (F.row_number().over(own) - 1).cast("long").alias("place"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(name) for c, name in sums.items()])
    dealt = storage.stored(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("__part").agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__{c}") for c in sums])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ["__n", *[f"__{c}" for c in sums]]])
    inside = Window.partitionBy("__part").orderBy(*order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(offsets), "__part")  # one row for each partition
    out = out.withColumn("place", F.col("__n_before") + F.row_number().over(inside) - 1)
    for c, name in sums.items():
        out = out.withColumn(name, F.col(f"__{c}_before") + F.coalesce(F.sum(c).over(earlier), F.lit(0)))
    return out.select(*df.columns, "place", *sums.values())
