"""Dense positions in a sort order without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_positions(df: DataFrame, key: str, ties: tuple[str, ...] = (), out: str = "position", blocks: int = 64) -> DataFrame:
    """`df` with each row's place from 0 in the order of a numeric key, then `ties`; nulls stand first.

    Cut points from quantiles deal rows into blocks; places within blocks and the running sizes of the at most `blocks` + 1 blocks add up.
    """
    cuts = sorted(set(df.stat.approxQuantile(key, [i / blocks for i in range(1, blocks)], 0.01)))
    number = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: c <= F.col(key))) if cuts else F.lit(0)
    dealt = df.withColumn("_block", F.when(F.col(key).isNull(), -1).otherwise(number))
    sizes = dealt.groupBy("_block").agg(F.count("*").alias("_n"))
    starts = sizes.select("_block", (F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).alias("_start"))
    nth = F.row_number().over(Window.partitionBy("_block").orderBy(key, *ties)) - 1
    return dealt.withColumn("_nth", nth).join(F.broadcast(starts), "_block").withColumn(out, F.col("_start") + F.col("_nth")).drop("_block", "_nth", "_start")
