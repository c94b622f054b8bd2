"""First cells of CSV files whose quoted cells hold line breaks, read in splits.

Whether a line starts inside quotes depends on all lines before it, which is why such files are usually read by one task. What a line does
is small, though: it maps "inside" or "outside" at its start to one of the two at its end. Most lines keep what
they find, some change it, some end up the same way whatever they find. Such steps can be put together in any grouping: lines to
chunks, chunks to files. With the state at the start of every chunk each line knows its own.
"""

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobfleet.staging import stage

CHUNK = 1 << 13  # lines that one task puts in order
#: Bytes of lines that one task sorts, and what a line takes there besides its text.
TASK_BYTES = 32 << 20
LINE_BYTES = 100
#: Where a line's reader stands: at the start of a cell, within a plain one, within quotes, right behind a closing quote.
_START, _PLAIN, _QUOTED, _CLOSED = range(4)
#: What a step does: keep what it finds, change it, or end outside or inside whatever it finds.
_KEEPS, _FLIPS, _GOES_OUT, _GOES_IN = range(4)


def _ends_inside(line: Column, inside: bool) -> Column:
    """Whether the reader is inside quotes after a line that it began so, or not.

    The line's pieces between quotes are taken in turn. A quote opens a cell only at its start, and a second one right
    behind a closing quote stands for itself.
    """

    def step(state: Column, piece: Column) -> Column:
        # the quote before this piece, then the piece
        after_quote = F.when(state == _START, _QUOTED).when(state == _QUOTED, _CLOSED).when(state == _CLOSED, _QUOTED).otherwise(_PLAIN)
        plain = F.when(piece.endswith(","), _START).otherwise(_PLAIN)
        return F.when((piece == "") | (after_quote == _QUOTED), after_quote).otherwise(plain)

    pieces = F.split(line, '"')
    first = pieces[0]
    if inside:
        began = F.lit(_QUOTED)
    else:
        began = F.when((first == "") | first.endswith(","), _START).otherwise(_PLAIN)
    rest = F.slice(pieces, 2, F.size(pieces))
    return F.aggregate(rest, began, step) == _QUOTED


def _effect(from_out: Column, from_in: Column) -> Column:
    """What a step does that ends inside or not, as the two tell, by how it began."""
    return F.when(from_out == from_in, F.when(from_out, _GOES_IN).otherwise(_GOES_OUT)).when(from_out, _FLIPS).otherwise(_KEEPS)


def _state(begins: Column, flips: Column, fixed: Column) -> Column:
    """Inside or not, where ``flips`` changes came since the last step with a ``fixed`` end, or since the start."""
    since = flips - F.coalesce(F.shiftright(fixed, 1), F.lit(0))
    return F.coalesce(fixed % 2 == 1, begins) != (since % 2 == 1)


def _with_steps(steps: DataFrame, order: Window) -> DataFrame:
    """Running facts of the steps before each row: ``flips`` and the last ``fixed`` one; and with it: ``flips_to``, ``fixed_to``.

    A fixed step is one number, twice the flips up to it and one more where it ends inside.
    """
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("flips_to", F.sum((F.col("effect") == _FLIPS).cast("long")).over(upto))
    end = F.when(F.col("effect") >= _GOES_OUT, F.col("flips_to") * 2 + (F.col("effect") - _GOES_OUT))
    return steps.withColumns(
        {
            "flips": F.col("flips_to") - (F.col("effect") == _FLIPS).cast("long"),
            "fixed": F.last(end, ignorenulls=True).over(before),
            "fixed_to": F.last(end, ignorenulls=True).over(upto),
        }
    )


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, start, line, value, effect)``: ``line`` ascends within a split, which starts at ``start``."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"),
        F.regexp_replace("value", r"^\x{FEFF}", "").alias("value"),
    )
    has_quote = F.contains("value", F.lit('"'))
    from_out = has_quote & F.when(has_quote, _ends_inside(F.col("value"), False)).otherwise(False)
    from_in = ~has_quote | F.when(has_quote, _ends_inside(F.col("value"), True)).otherwise(True)
    lines = lines.withColumns({"from_out": from_out, "from_in": from_in})
    effect = _effect(F.col("from_out"), F.col("from_in")).cast("tinyint")
    return stage(lines.select("file", "start", "line", "value", effect.alias("effect")), "csv-lines")


def records(lines: DataFrame) -> DataFrame:
    """``lines`` with ``inside`` (whether it starts within quotes) and ``record``, its record's number in the file.

    Lines are shuffled once, without their file's name, to as many tasks as their bytes ask for. Both
    numbers of a line are worked out for a chunk that begins outside and for one that begins inside.
    """
    splits = lines.groupBy("file", "start").agg(
        F.min("line").alias("split"), F.sum(F.octet_length("value") + LINE_BYTES).alias("bytes")
    )
    splits = stage(splits, "csv-splits")
    tasks = math.ceil((splits.agg(F.sum("bytes")).first()[0] or 0) / TASK_BYTES)
    chunk = ["split", "chunk"]
    dealt = (
        lines.join(splits.drop("bytes"), ["file", "start"])
        .select("split", F.floor(F.col("line") / CHUNK).alias("chunk"), "line", "value", "effect")
        .repartition(max(1, tasks), *chunk)
    )
    order = Window.partitionBy(*chunk).orderBy("line")
    begun = {"out": F.lit(False), "in": F.lit(True)}
    steps = _with_steps(dealt, order).withColumns(
        {
            **{f"inside_{b}": _state(begins, F.col("flips"), F.col("fixed")) for b, begins in begun.items()},
            **{f"ends_{b}": _state(begins, F.col("flips_to"), F.col("fixed_to")) for b, begins in begun.items()},
        }
    )
    # a blank line outside quotes is no record, and within them it is part of one
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = {f"opened_{b}": F.sum((~F.col(f"inside_{b}") & (F.trim("value") != "")).cast("long")).over(upto) for b in begun}
    placed = stage(steps.withColumns(opened).drop("effect", "flips", "fixed", "flips_to", "fixed_to"), "csv-states")

    # a chunk is a step too, and its last line tells how it ends
    ends = F.col("ends_out").cast("int") * 2 + F.col("ends_in").cast("int")
    chunks = placed.groupBy(*chunk).agg(
        F.max((F.col("line") % CHUNK) * 4 + ends).alias("last"),
        *[F.max(f"opened_{b}").alias(f"opened_{b}") for b in begun],
    )
    from_out, from_in = F.col("last").bitwiseAND(2) != 0, F.col("last").bitwiseAND(1) != 0
    chunks = chunks.join(splits.drop("bytes"), "split").withColumn("effect", _effect(from_out, from_in))
    in_file = Window.partitionBy("file").orderBy("start", "chunk")
    chunks = _with_steps(chunks, in_file).withColumn("begins", _state(F.lit(False), F.col("flips"), F.col("fixed")))
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum(_by_begin("opened")).over(before), F.lit(0))
    begins = stage(chunks.select(*chunk, "begins", first.alias("first")), "csv-chunks")

    placed = placed.join(begins, chunk).join(splits.drop("bytes"), "split")
    record = F.col("first") + _by_begin("opened") - 1
    return placed.select("file", "start", "line", "value", _by_begin("inside").alias("inside"), record.alias("record"))


def _by_begin(name: str) -> Column:
    return F.when(F.col("begins"), F.col(f"{name}_in")).otherwise(F.col(f"{name}_out"))


def first_cells(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, record, cell)``: the first cell of every record.

    Only records whose first cell itself holds line breaks are put together from their lines.
    """
    lines = records(numbered_lines(spark, path)).filter("inside or trim(value) != ''")
    heads = lines.filter("not inside")
    quoted = F.regexp_extract("value", r'^"([^"]*+(?:""[^"]*+)*+)"', 1)
    is_quoted = F.startswith("value", F.lit('"'))
    closed = ~is_quoted | F.rlike(F.col("value"), F.lit(r'^"[^"]*+(?:""[^"]*+)*+"'))
    cell = F.when(is_quoted, F.replace(quoted, F.lit('""'), F.lit('"'))).otherwise(F.substring_index("value", ",", 1))
    simple = heads.filter(closed).select("file", "record", cell.alias("cell"))
    opened = stage(heads.filter(~closed).select("file", "record"), "csv-open-cells")
    parts = lines.join(opened, ["file", "record"]).groupBy("file", "record").agg(
        F.array_sort(F.collect_list(F.struct("start", "line", "value"))).alias("parts")
    )
    whole = parts.select("file", "record", F.array_join("parts.value", "\n").alias("value"))
    unclosed = F.when(closed, cell).otherwise(F.expr("substring(value, 2)"))
    return simple.unionByName(whole.select("file", "record", unclosed.alias("cell")))
