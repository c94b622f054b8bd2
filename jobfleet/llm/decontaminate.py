"""Benchmark decontamination: a prefix-filtered set join of item windows with document shingles.

A window is ``WINDOW`` consecutive words of a benchmark item (an item of fewer words is one
window). As a set of word shingles, a window must be contained whole in a document, so the
overlap that is required equals its size and one prefix token is necessary: its rarest shingle,
by counts over all documents. Documents meet windows on that shingle only. The length and
position of the shingle give the one place where the window can stand; what does not fit into
the document goes, and the words there are compared exactly.

A document's places are rows of a hash and a number; its words are fetched again for the documents that have candidates, once
for all of them. Windows are broadcast when they measure at most ``BLOCK_BYTES``, and else joined by shuffle. Everything is
built from DataFrame functions.

Defined results: null and empty texts have no words and no hits; items without words match
nothing; repeated documents are judged each by itself; repeated items count once per item id,
and a null item id counts as the id ``null``; very long texts take steps in proportion to their words. Extra columns are kept whatever
their names are, and those with names of the results are replaced.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobfleet.llm.common import columns_of, let, lower_ascii, small, stage, text_key, words

WINDOW = 13
SHINGLE = 3
BLOCK_BYTES = 24 << 20
CANDIDATE_BYTES = 512  # in memory, for a candidate and its words
KEY_BYTES = 96
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    return words(lower_ascii(text), SEPARATORS)


def shingles(terms: Column, size: int) -> Column:
    """Hashes of the runs of ``size`` words; element i starts at word i, counted from 0."""
    return let(
        terms,
        lambda w: F.when(
            F.size(w) >= size,
            F.transform(
                F.sequence(F.lit(0), F.size(w) - size),
                lambda i: F.xxhash64(*[w[i + k] for k in range(size)]),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )


def windows(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (window_id, size, terms) and which items hold them (window_id, item_id)."""
    split = columns_of(items, "item_id", "text").select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"),
        item_words(F.col("text")).alias("all_terms"),
    )
    cut = split.filter(F.size("all_terms") > 0).select(
        "item_id",
        F.explode(
            let(
                F.col("all_terms"),
                lambda w: F.transform(
                    F.sequence(F.lit(1), F.greatest(F.size(w) - window + 1, F.lit(1))),
                    lambda i: F.slice(w, i, window),
                ),
            )
        ).alias("terms"),
    )
    cut = cut.withColumn("window_id", F.unhex(F.md5(F.concat_ws(" ", "terms"))))
    distinct = cut.dropDuplicates(["window_id"]).select(
        "window_id", F.size("terms").alias("size"), "terms"
    )
    return stage(distinct, "windows"), stage(cut.select("window_id", "item_id").distinct(), "window-items")


def held(rows: DataFrame, byte_count: int) -> DataFrame:
    """A broadcast of rows of proven size, else a join by shuffle, in which adaptive execution splits hot tokens."""
    return F.broadcast(rows) if byte_count <= BLOCK_BYTES else rows.hint("merge")


def rarest(docs: DataFrame, tokens: DataFrame, sizes: list[int], byte_count: int) -> DataFrame:
    """Each window with the shingle that fewest places of the documents have.

    A window with a shingle that no document has cannot occur and is left out.
    """
    terms = docs.select(item_words(F.col("text")).alias("terms"))
    counts = []
    for k in sizes:
        found = terms.select(F.explode(shingles(F.col("terms"), k)).alias("token"))
        wanted = held(tokens.filter(F.col("shingle") == k).select("token").distinct(), byte_count)
        counted = found.join(wanted, "token").groupBy("token").agg(F.count(F.lit(1)).alias("places"))
        counts.append(counted.withColumn("shingle", F.lit(k)))
    counted = stage(reduce(DataFrame.unionByName, counts), "shingle-counts")
    rated = tokens.join(counted, ["token", "shingle"], "left")
    best = F.min(F.struct(F.coalesce("places", F.lit(0)).alias("places"), "token", "offset"))
    return (
        rated.groupBy("window_id", "shingle")
        .agg(best.alias("best"))
        .filter("best.places > 0")
        .select("window_id", "shingle", "best.token", "best.offset")
    )


def matches(docs: DataFrame, distinct: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(row_key, window_id, first, last): every place where a window stands, by word from 0.

    ``docs`` has row_key and text.
    """
    tokens = stage(
        distinct.select(
            "window_id",
            F.least("size", F.lit(shingle)).alias("shingle"),
            F.col("terms"),
        ).select(
            "window_id",
            "shingle",
            F.posexplode(
                F.when(F.col("shingle") >= shingle, shingles(F.col("terms"), shingle)).otherwise(
                    reduce(
                        lambda rest, k: F.when(F.col("shingle") == k, shingles(F.col("terms"), k)).otherwise(rest),
                        range(1, shingle),
                        F.array().cast("array<bigint>"),
                    )
                )
            ).alias("offset", "token"),
        ),
        "window-shingles",
    )
    measured = distinct.agg(F.sum(F.octet_length(F.concat_ws(" ", "terms")) + 24 * F.size("terms") + 64)).first()
    byte_count = measured[0] or 0
    sizes = sorted(row[0] for row in tokens.select("shingle").distinct().collect())  # at most ``shingle`` rows
    empty = docs.select("row_key").limit(0).selectExpr(
        "row_key", "cast(null as binary) window_id", "cast(0 as int) first", "cast(0 as int) last"
    )
    if not sizes:
        return empty
    anchors = stage(rarest(docs, tokens, sizes, byte_count).join(distinct, "window_id"), "window-prefixes")
    met = []
    for k in sizes:
        places = docs.select("row_key", F.posexplode(shingles(item_words(F.col("text")), k)).alias("at", "token"))
        wanted = held(anchors.filter(F.col("shingle") == k).select("window_id", "token", "offset"), byte_count)
        first = F.col("at") - F.col("offset")
        met.append(places.join(wanted, "token").filter(first >= 0).select("row_key", "window_id", first.alias("first")))
    met = stage(reduce(DataFrame.unionByName, met).distinct(), "window-candidates")
    candidates = met.join(held(anchors.select("window_id", "size", "terms"), byte_count), "window_id")
    by_document = candidates.groupBy("row_key").agg(F.collect_list(F.struct("window_id", "first", "size", "terms")).alias("candidates"))
    by_document = stage(by_document, "document-candidates")
    rows, size = by_document.agg(F.count(F.lit(1)), F.sum(F.size("candidates"))).first()
    if (size or 0) * CANDIDATE_BYTES > BLOCK_BYTES:  # then only documents with candidates are shuffled
        docs = docs.join(small(by_document.select("row_key"), rows * KEY_BYTES), "row_key", "left_semi")
    words_of = docs.join(held(by_document, (size or 0) * CANDIDATE_BYTES), "row_key")
    last = lambda c: c["first"] + c["size"]
    stands = let(
        item_words(F.col("text")),
        lambda w: F.filter("candidates", lambda c: (last(c) <= F.size(w)) & (F.slice(w, c["first"] + 1, c["size"]) == c["terms"])),
    )
    found = words_of.select("row_key", F.explode(stands).alias("c"))
    return found.select("row_key", "c.window_id", "c.first", (last(F.col("c")) - 1).alias("last"))


def decontaminate(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``documents`` with n_words, n_hit, n_items, items_sha256 and contaminated; every row stays.

    A document is contaminated when words stand inside windows and they are at least a
    twentieth of its words. All columns of ``documents`` are kept; of columns with these names the new ones win.
    """
    added = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    kept = [c for c in documents.columns if c not in added]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")  # out of the way of the names used here
    base = documents.select(row, text_key("doc_id", "text").alias("row_key"), "text")
    narrow = base.select("row_key", "text")
    distinct, holders = windows(items, window)
    found = stage(matches(narrow, distinct), "window-matches").distinct()

    before = Window.partitionBy("row_key").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    covered = (
        found.select("row_key", "first", "last")
        .distinct()
        .withColumn("reach", F.coalesce(F.max("last").over(before), F.lit(-1)))
        .groupBy("row_key")
        .agg(F.sum(F.greatest(F.lit(0), F.col("last") - F.greatest(F.col("reach"), F.col("first") - 1))).alias("n_hit"))
    )
    named = (
        found.select("row_key", "window_id")
        .distinct()
        .join(holders, "window_id")
        .select("row_key", "item_id")
        .distinct()
        .groupBy("row_key")
        .agg(F.count(F.lit(1)).alias("n_items"), F.concat_ws(",", F.sort_array(F.collect_list("item_id"))).alias("names"))
    )
    hit = stage(covered.join(named, "row_key"), "document-hits")
    n_words = F.size(item_words(F.col("text"))).cast("long")
    return (
        base.withColumn("n_words", n_words)
        .join(hit, "row_key", "left")
        .withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long"))
        .withColumn("n_items", F.coalesce("n_items", F.lit(0)).cast("long"))
        .withColumn("items_sha256", F.sha2(F.coalesce("names", F.lit("")), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
        .select("row.*", *added)
    )
