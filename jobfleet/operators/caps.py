"""Scan and mutation caps: stop each workspace's run after its n-th row.

A run is a prefix of the workspace's listing, so a cap is one number per
workspace: the ordinal of the row it stops at. That number is found from two
narrow columns, and the wide rows are then only filtered. No workspace is ever
sorted in a single task.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobfleet.schemas import HOST, ORDINAL
from jobfleet.staging import stage

STOP = "stop_ordinal"
BUCKET_ROWS = 1 << 16  # rows of one range that may be ranked in one task
RANGES = 1024  # into how many ranges a workspace's ordinals are cut at a time
RANKED_ROWS = 100  # well below the rank up to which Spark prunes before the shuffle


def stop_ordinals(
    rows: DataFrame, n: int, ordinal: str = ORDINAL, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """``(workspace_host, stop_ordinal)`` of each workspace's n-th row, n >= 1.

    Workspaces with fewer rows are absent. For small n every map task sends at
    most n rows per workspace, in one pass over the rows. For larger n the
    ordinals are staged once. Then each workspace's span, from its least to its
    greatest ordinal, is cut into ``RANGES`` ranges, the rows of each are
    counted, and the one that holds the n-th row is cut again, until it has few
    rows. Dense or sparse, a workspace never has more ranges than that.
    """
    narrow = rows.select(HOST, F.col(ordinal).alias(STOP))
    by_ordinal = Window.partitionBy(HOST).orderBy(STOP)
    if n <= RANKED_ROWS:
        ranked = narrow.withColumn("rank", F.row_number().over(by_ordinal))
        return stage(ranked.filter(F.col("rank") == n).select(HOST, STOP), "stops")

    narrow = stage(narrow, "ordinals")
    spans = narrow.groupBy(HOST).agg(
        F.min(STOP).alias("lo"), F.max(STOP).alias("hi"), F.count("*").alias("size")
    )
    spans = spans.filter(F.col("size") >= n).withColumn("wanted", F.lit(n).cast("long"))
    within = F.col(STOP).between(F.col("lo"), F.col("hi"))
    while True:
        spans = stage(spans, "spans")
        wide = (F.col("size") > bucket_rows) & (F.col("hi") > F.col("lo"))
        if spans.filter(wide).isEmpty():
            break
        cut = spans.filter(wide).withColumn("step", F.expr(f"(hi - lo) div {RANGES} + 1"))
        counts = (
            narrow.join(cut.drop("size"), HOST)
            .filter(within)
            .groupBy(HOST, "lo", "step", "wanted", F.expr(f"({STOP} - lo) div step").alias("range"))
            .agg(F.count("*").alias("size"))
        )
        upto = F.sum("size").over(Window.partitionBy(HOST).orderBy("range"))
        start = F.col("lo") + F.col("range") * F.col("step")
        holding = (
            counts.withColumn("upto", upto)
            .filter((F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("size") < F.col("wanted")))
            .select(
                HOST,
                start.alias("lo"),
                (start + F.col("step") - 1).alias("hi"),
                "size",
                (F.col("wanted") - F.col("upto") + F.col("size")).alias("wanted"),
            )
        )
        spans = spans.filter(~wide).unionByName(holding)
    candidates = narrow.join(spans, HOST).filter(within)
    ranked = candidates.withColumn("rank", F.row_number().over(by_ordinal))
    return stage(ranked.filter(F.col("rank") == F.col("wanted")).select(HOST, STOP), "stops")


def before_stop(stop: Column, ordinal: Column, inclusive: bool) -> Column:
    reached = ordinal <= stop if inclusive else ordinal < stop
    return stop.isNull() | reached


def mutation_cap(
    plan: DataFrame,
    limit: int | None,
    checked: Column,
    changed: Column,
    ordinal: str = ORDINAL,
    keep_all: bool = False,
) -> DataFrame:
    """Take rows after the run's last one out of the plan.

    ``checked`` marks rows after which the run tests the limit, ``changed``
    those that count towards it. The run stops at the first checked row with
    the count at or above the limit, so a limit below one still runs to the
    first checked row. Later rows are left out, or stay without an outcome when
    ``keep_all`` is set.
    """
    if limit is None:
        return plan
    counted = plan.filter(checked & changed) if limit > 0 else plan.filter(checked)
    stops = stop_ordinals(counted, max(limit, 1), ordinal)
    in_run = before_stop(F.col(STOP), F.col(ordinal), inclusive=True)
    joined = plan.join(stops, HOST, "left")
    if not keep_all:
        return joined.filter(in_run).drop(STOP)
    return (
        joined.withColumns(
            {
                "scanned": F.col("scanned") & in_run,
                "matched": F.col("matched") & in_run,
                "outcome": F.when(in_run, F.col("outcome")),
            }
        )
        .drop(STOP)
    )
