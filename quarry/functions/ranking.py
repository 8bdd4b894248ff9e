"""A global row number without a single-partition window."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.session import cut


def global_position(df: DataFrame, order: Sequence[str | Column], name: str = "pos") -> DataFrame:
    """Add ``name`` = 0-based position in the total order given by ``order``.

    Rows are range-partitioned and sorted once; the offset of a partition is the number of rows
    in the partitions before it, a list as long as the partition count.
    """
    low33 = (1 << 33) - 1
    ranged = cut(
        df.sort(*order).withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_mid", 33))
        .withColumn("_in", F.col("_mid").bitwiseAND(F.lit(low33)))
        .drop("_mid")
    )
    # One row per partition: its offset is a running sum over the partitions, joined back rather than written into the plan.
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return ranged.join(offsets, "_part").withColumn(name, F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")
