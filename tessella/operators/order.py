"""Dense numbers and running sums in a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Rows up to which one task sorts and numbers everything (some tens of MB).
ONE_TASK = 1_000_000


def numbered(df: DataFrame, *order: Column | str, name: str = "number", one_task: int = ONE_TASK) -> DataFrame:
    """Adds a number from 1 in the order given, which must be total.

    Small tables are numbered by one window. Beyond ``one_task`` rows the table is range-partitioned, sorted and
    written once; the parts' sizes (a row for each part) give every part its first number. Such a table is never
    broadcast: the planner goes by its compressed files, of some three bytes a row, and a hash table of it is built in the driver.
    """
    if df.limit(one_task + 1).count() <= one_task:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
    place = F.monotonically_increasing_id()
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.shiftright(place, 33).alias("_part"), place.bitwiseAND((1 << 33) - 1).alias("_place"))
    parts = written(parts, "numbered")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))
    return parts.join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before").hint("merge")


def running(df: DataFrame, order: Column, sums: dict[str, str], one_task: int = ONE_TASK) -> DataFrame:
    """Adds the sums of columns, named ``{new: column}``, over all rows down to each in the order given, which must be total.

    As in ``numbered``, small tables take one window; larger ones are range-partitioned and written, each part is summed
    on its own, and the parts' totals (a row for each part) are carried over.
    """
    if df.limit(one_task + 1).count() <= one_task:
        down = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({new: F.sum(c).over(down) for new, c in sums.items()})
    parts = written(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "running")
    totals = parts.groupBy("_part").agg(*[F.sum(c).alias(f"_{new}") for new, c in sums.items()])
    above = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("_part", *[F.coalesce(F.sum(f"_{new}").over(above), F.lit(0)).alias(f"_{new}") for new in sums])
    own = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    both = parts.join(F.broadcast(carried), "_part")
    return both.withColumns({new: F.sum(c).over(own) + F.col(f"_{new}") for new, c in sums.items()}).drop("_part", *[f"_{new}" for new in sums])
