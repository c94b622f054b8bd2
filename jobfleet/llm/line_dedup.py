"""Line dedup by a deletion-neighbourhood join, built from DataFrame functions.

A line is its words in lower case; it is dropped when an equal line, or a line within an
edit of one word (changed, added or left out), occurs earlier: the first occurrence is
by doc_id, then line number. Only lines of at least ``EXACT_WORDS`` words are compared, and only
those of ``NEAR_WORDS`` or more by edits. An earlier line counts whether or not it is itself dropped.

1. Equal lines meet by hash; each distinct line keeps its earliest place.
2. Two lines within one edit share the first or the last half of the shorter one, so each line has
   four half keys; lines that share none with another line are out. This loses no pair.
3. The others emit their variants with one word deleted as hashed keys, in the half that a partner may not share. Lines that
   differ by a change share a variant and its slot; a line with one word more has the other as a variant. Per key the
   earliest line of each role is kept, never the pairs of a group, so a hot key costs one row per task.
4. Each line meets the earliest line of its keys, and the edit distance of that pair is verified on the words.

Lists of lines are broadcast when their measured size allows it and joined by shuffle otherwise.

Defined results: null text stays null and has no lines; lines without words, and short ones, stay;
rows with equal doc_id and text are one document and judged alike; a null doc_id comes last;
very long texts are lines as others; empty tables give empty results; all columns are kept.
"""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobfleet.llm.common import let, small, stage, text_key, words

EXACT_WORDS = 5
NEAR_WORDS = 12
#: Blanks within a line, if they are not one space alone.
LONG_BLANK = r"(?:[\x09\x0B-\x0D]|\x20(?=[\x20\x09\x0B-\x0D]))[\x20\x09\x0B-\x0D]*"
ROW_BYTES = 120  # in memory, for a row of a key and a few numbers


def half_keys(line: Column, n: Column) -> Column:
    """Hashes of the first and last halves of a line of n words between single blanks, as the shorter and as the longer one of a pair."""
    keys = []
    for m in (n, n - 1):
        k = F.floor(m / 2).cast("int")
        keys.append(F.xxhash64(F.lit("first"), m, F.call_function("substring_index", line, F.lit(" "), k)))
        keys.append(F.xxhash64(F.lit("last"), m, F.call_function("substring_index", line, F.lit(" "), -k)))
    return F.array(*keys)


def lines_of(documents: DataFrame) -> DataFrame:
    """(row_key, line_no, place, line, n) of every line that is long enough, as its n words between single blanks;
    place orders documents.
    """
    docs = documents.select(
        text_key("doc_id", "text").alias("row_key"),
        F.struct(F.col("doc_id").isNull().alias("last"), "doc_id").alias("doc"),
        F.lower("text").alias("text"),
    )
    # blanks are made single in whole texts, in those that need it, so that no line is cut into words
    long_blank = reduce(or_, [F.contains("text", F.lit(blank)) for blank in ("  ", "\t", "\x0b", "\x0c", "\r")])
    docs = docs.withColumn("text", F.when(long_blank, F.regexp_replace("text", LONG_BLANK, " ")).otherwise(F.col("text")))
    place = F.struct(F.col("doc.last"), F.col("doc.doc_id"), F.col("row_key"), F.col("line_no"))
    lines = docs.select("row_key", "doc", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.select("row_key", "doc", "line_no", F.trim("line").alias("line"))
    lines = lines.filter(F.octet_length(F.substring_index("line", " ", EXACT_WORDS - 1)) < F.octet_length("line"))
    n = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "))) + 1
    return lines.select("row_key", "line_no", place.alias("place"), "line", n.alias("n"))


def terms_of(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (row_key, line_no, ...) with the lines' terms; only these lines are cut into words."""
    texts = documents.select(text_key("doc_id", "text").alias("row_key"), F.lower("text").alias("text"))
    lines = texts.select("row_key", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.join(wanted, ["row_key", "line_no"]).withColumn("terms", words(F.col("line"))).drop("line")


def variants(lines: DataFrame) -> DataFrame:
    """(line_id, place, key, role) of ``lines`` (line_id, place, terms, shared): whole as the shorter line of a pair, with a
    word deleted as the longer one, and the same with the word's slot as a changed line.

    A list of words has the exclusive-or of its words' hashes with their places as key. Running ones over the words
    before and after a slot give each variant's in one step, so a line of n words costs n steps. Where a pair
    shares the first half, its edit is in the rest, and the other way round; ``shared`` has the line's half keys that
    others have too, and only slots that such a pair may have are deleted.
    """
    words_of = lines.select("line_id", F.posexplode(F.transform("terms", lambda t: F.xxhash64(t))).alias("slot", "word"))
    line = Window.partitionBy("line_id")
    before, upto = (line.orderBy("slot").rowsBetween(Window.unboundedPreceding, end) for end in (-1, 0))
    here, moved = F.xxhash64("slot", "word"), F.xxhash64(F.col("slot") - 1, "word")
    hashes = words_of.select(
        "line_id",
        "slot",
        F.coalesce(F.bit_xor(here).over(before), F.lit(0)).bitwiseXOR(F.bit_xor(moved).over(line)).bitwiseXOR(F.bit_xor(moved).over(upto)).alias("rest"),
        F.bit_xor(here).over(line).alias("whole"),
        F.count(F.lit(1)).over(line).alias("n"),
    )

    def may_differ(first: int, last: int, n: Column) -> Column:
        """Whether a pair that shares the first or the last half of n words may differ in this slot."""
        return F.when(F.col("slot") >= F.floor(n / 2), has(first)).otherwise(has(last))

    def has(which: int) -> Column:
        return F.col("shared").bitwiseAND(1 << which) != 0

    roles = F.array(
        F.when((F.col("slot") == 0) & (has(0) | has(1)), F.struct(F.col("whole").alias("key"), F.lit("short").alias("role"))),
        F.when(may_differ(2, 3, F.col("n") - 1), F.struct(F.col("rest").alias("key"), F.lit("long").alias("role"))),
        F.when(may_differ(0, 1, F.col("n")), F.struct(F.xxhash64(F.lit("slot"), "slot", "rest").alias("key"), F.lit("change").alias("role"))),
    )
    told = hashes.join(lines.select("line_id", "place", "shared"), "line_id")
    return told.select("line_id", "place", F.explode(F.array_compact(roles)).alias("v")).select("line_id", "place", "v.key", "v.role")


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether two word lists differ by at most one changed, added or left-out word."""

    least = F.least(F.size(a), F.size(b))

    def agree(same) -> Column:
        """How many words agree before the first that does not; ``same`` tells of each place."""
        told = F.transform(F.sequence(F.lit(0), least - 1), same)
        return F.when(least == 0, 0).otherwise(
            let(F.array_position(told, False), lambda p: F.when(p > 0, p - 1).otherwise(least.cast("long")))
        )

    ahead = agree(lambda i: a[i] == b[i])
    behind = agree(lambda i: a[F.size(a) - 1 - i] == b[F.size(b) - 1 - i])
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (ahead + behind >= F.greatest(F.size(a), F.size(b)) - 1)


def near_lines(documents: DataFrame, distinct: DataFrame) -> DataFrame:
    """line_id of the distinct lines that have an earlier line within one edit."""
    keys = distinct.filter("keys is not null").select("line_id", F.posexplode("keys").alias("which", "key"))
    shared = (
        keys.groupBy("key")
        .agg(F.min("line_id").alias("lo"), F.max("line_id").alias("hi"))
        .filter("lo <> hi")
        .select("key")
    )
    shared = stage(shared, "shared-halves")
    shared = small(shared, shared.count() * ROW_BYTES)
    flag = F.call_function("shiftleft", F.lit(1), F.col("which"))
    met = keys.join(shared, "key", "left_semi").groupBy("line_id").agg(F.bit_or(flag).alias("shared"))
    wanted = stage(
        distinct.join(met, "line_id").select("line_id", "place.row_key", "place.line_no", "place", "shared"),
        "lines-to-compare",
    )
    wanted = small(wanted, wanted.count() * 2 * ROW_BYTES)
    texts = stage(
        terms_of(documents, wanted)
        .dropDuplicates(["line_id"])
        .select("line_id", "place", "terms", "shared"),
        "compared-lines",
    )
    emitted = stage(variants(texts), "line-variants")
    mine = F.struct("place", "line_id")
    # an equal line of the other role, or another line of the same slot
    first = emitted.groupBy("key").agg(
        *[F.min(F.when(F.col("role") == r, mine)).alias(r) for r in ("short", "long", "change")],
        F.count(F.lit(1)).alias("members"),
    )
    partner = F.when(F.col("role") == "short", F.col("long")).when(F.col("role") == "long", F.col("short")).otherwise(F.col("change"))
    pairs = (
        emitted.join(first.filter("members > 1"), "key")
        .select("line_id", "place", partner.alias("partner"))
        .filter(F.col("partner.place") < F.col("place"))
        .groupBy("line_id")
        .agg(F.min("partner").alias("partner"))
        .select("line_id", F.col("partner.line_id").alias("other_id"))
    )
    left = texts.select("line_id", F.col("terms").alias("a"))
    right = texts.select(F.col("line_id").alias("other_id"), F.col("terms").alias("b"))
    return (
        pairs.join(left, "line_id").join(right, "other_id").filter(within_one_edit(F.col("a"), F.col("b"))).select("line_id")
    )


def dropped_lines(documents: DataFrame) -> DataFrame:
    """(row_key, dropped): the numbers of the lines to drop, from 0, of documents that have some."""
    near = F.col("n") >= NEAR_WORDS
    narrow = stage(
        lines_of(documents).select(
            "place",
            F.unhex(F.md5("line")).alias("line_id"),
            F.when(near, half_keys(F.col("line"), F.col("n"))).alias("keys"),
        ),
        "lines",
    )
    first = F.min(F.struct("place", "keys")).alias("first")
    distinct = stage(
        narrow.groupBy("line_id")
        .agg(first, F.count(F.lit(1)).alias("copies"))
        .select("line_id", "first.place", "first.keys", "copies"),
        "distinct-lines",
    )
    near_ids = near_lines(documents, distinct).withColumn("near", F.lit(True))
    verdicts = stage(
        distinct.join(near_ids, "line_id", "left")
        .filter("copies > 1 or near")
        .select("line_id", F.col("place").alias("first"), F.coalesce("near", F.lit(False)).alias("near")),
        "line-verdicts",
    )
    verdicts = small(verdicts, verdicts.count() * ROW_BYTES)
    gone = narrow.select("place", "line_id").join(verdicts, "line_id").filter("near or place > first")
    return stage(
        gone.select("place.row_key", "place.line_no")
        .groupBy("row_key")
        .agg(F.collect_set("line_no").alias("dropped")),
        "dropped-lines",
    )


def dedup(documents: DataFrame) -> DataFrame:
    """``documents`` with the text's dropped lines taken out, and n_lines and n_dropped; every row stays."""
    kept_columns = [c for c in documents.columns if c not in ("n_lines", "n_dropped")]
    gone = dropped_lines(documents.select("doc_id", "text"))
    size = gone.agg(F.count(F.lit(1)), F.sum(F.size("dropped"))).first()
    gone = small(gone, size[0] * ROW_BYTES + (size[1] or 0) * 8)
    row = F.struct(*[F.col(f"`{c}`") for c in kept_columns]).alias("row")  # out of the way of the names used here
    base = documents.select(row, text_key("doc_id", "text").alias("row_key"), "text")
    lines = F.split("text", "\n")
    kept = let(
        lines,
        lambda x: F.concat_ws(
            "\n",
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("dropped")), lambda i: x[i]),
        ),
    )
    figures = {
        "text": F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept),
        "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"),
        "n_dropped": F.greatest(F.coalesce(F.size("dropped"), F.lit(0)), F.lit(0)).cast("long"),
    }
    columns = [figures["text"].alias("text") if c == "text" else F.col(f"row.`{c}`") for c in kept_columns]
    return base.join(gone, "row_key", "left").select(*columns, *[figures[c].alias(c) for c in ("n_lines", "n_dropped")])
