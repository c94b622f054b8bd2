"""Places and running totals in an order, without one task that sees all rows."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobfleet.staging import stage

#: How many neighbouring places are added up in one task.
WIDTH = 1 << 16
_ROW_BITS = 33  # of Spark's increasing ids; the rest is the number of the task


def running_total(
    rows: DataFrame, value: Column, order: str, by: Sequence[str] = (), name: str = "total", width: int | None = None
) -> DataFrame:
    """Add the total of ``value`` over the rows up to and with each row's place in its group.

    ``order`` is a dense whole number, such as a page or line number. Totals of ``width`` (``WIDTH``) places each are
    taken first; only these are put in order group by group, and every row then looks at its own places.
    """
    keyed = rows.withColumns({"_slot": F.floor(F.col(order) / (width or WIDTH)), "_value": value})
    before = Window.partitionBy(*by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = keyed.groupBy(*by, "_slot").agg(F.sum("_value").alias("_sum"))
    slots = stage(slots.select(*by, "_slot", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before")), "slots")
    within = Window.partitionBy(*by, "_slot").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    joined = keyed.join(slots, [*by, "_slot"])
    return joined.withColumn(name, F.col("_before") + F.sum("_value").over(within)).drop("_slot", "_value", "_before")


def numbered(rows: DataFrame, order: Sequence[Column], name: str = "number") -> DataFrame:
    """Add each row's place, from 0, in one order of all rows.

    Rows are dealt to tasks in ranges of the order, whatever its values are, and every task
    numbers its own; the sizes of the tasks then give each one its first number.
    """
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranges = stage(ranges.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    task = F.shiftright("_at", _ROW_BITS).alias("_task")
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy(task).agg(F.count(F.lit(1)).alias("_size"))
    firsts = stage(sizes.select("_task", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_first")), "range-firsts")
    placed = ranges.withColumn("_task", F.shiftright("_at", _ROW_BITS)).join(firsts, "_task")
    return placed.withColumn(name, F.col("_first") + F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1)).drop("_task", "_at", "_first")
