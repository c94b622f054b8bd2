"""Source divergence audit: how the words of a source differ from other sources of its language.

Terms are runs of letters (A-Z in lower case) and characters beyond ASCII. A language keeps the terms in at
least ``LEAST_DOCUMENTS`` of its documents, V of them. A group, or the language as a whole, gives a kept term that occurs in it
``n`` times the price 1 + floor(10^9 (n + 5) / (N + 5 V)), N its occurrences of all kept terms. All
arithmetic is on integers.

1. A task counts the terms of its texts by group with two counters (occurrences, documents); they leave it whenever they are full,
   and are added up by (group, term).
2. Kept terms get ids that ascend in sorted order, in ranges; ids of 2^16 terms are a block.
3. A group's counts of a block are two sorted arrays (term ids, counts). The groups of a language stand in
   tiles of ``TILE``. A task gets two tiles' arrays of one block and merges every unordered pair of groups: a galloping intersection
   finds the terms of both, which are priced against each other; terms of one side are
   priced against the other's price of an absent term; terms of neither all differ by the same.
4. Parts of a pair are added up over blocks and told both ways.

What a task holds is bounded by the block and the tile, whatever the size of a group or of the vocabulary; a group's arrays are
sent to as many tasks as its language has tiles.

Defined results: null text, language and source are empty strings, which are values like others; texts without terms and very
long texts count as documents (a long text is cut between terms while it is counted); equal rows are documents each; ties rank by
the item's bytes; a language without kept terms has pairs of value 0 and no terms; an empty table gives an
empty result; other columns of the caller are not read. N is exact up to some 9 * 10^15 occurrences; beyond that the query fails.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobfleet.llm.common import small, stage, tasks_for

LEAST_DOCUMENTS = 30
TOP_TERMS = 50
ADDED = 5  # to every count
SCALE_STEPS = 3  # prices are in units of 1000^-3
BLOCK_BITS = 16
TILE = 16
#: A task's counters leave it beyond so many entries, or so many bytes of text read.
HELD_TERMS = 400_000
HELD_BYTES = 128 << 20
PIECE = 1 << 20
GALLOP = 512
TERMS_A_TASK = 1 << 20
ROW_BYTES = 128

#: Bytes of terms stay, A-Z in lower case; all others part terms.
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


# --- counts --------------------------------------------------------------------------------

def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, some ``PIECE`` bytes of them at a time."""
    clean, at = text.translate(_CLEAN), 0
    while at < len(clean):
        end = clean.find(b" ", at + PIECE)
        end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end


def count_terms(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): a row per group and term, and one with a null term per group."""

    def rows(group: tuple[str, str], terms: list, n: list[int], docs: list[int]) -> pa.RecordBatch:
        lang, source = (pa.array([x] * len(n), pa.string()) for x in group)
        terms = pa.array(terms, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([lang, source, terms, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names)

    def leave(held: dict) -> Iterator[pa.RecordBatch]:
        for group, (total, docs, texts) in held.items():
            yield rows(group, [None], [0], [texts])
            terms = list(total)
            for at in range(0, len(terms), 1 << 16):
                part = terms[at : at + (1 << 16)]
                yield rows(group, part, [total[t] for t in part], [docs[t] for t in part])
        held.clear()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, entries, read = {}, 0, 0
        for batch in batches:
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for group, text in zip(zip(langs, sources, strict=True), batch.column("text"), strict=True):
                mine = held.setdefault(group, [Counter(), Counter(), 0])
                before, seen = len(mine[0]), set()
                text = text.as_buffer().to_pybytes()
                for terms in terms_of(text):
                    mine[0].update(terms)
                    seen.update(terms)
                mine[1].update(seen)
                mine[2] += 1
                entries += len(mine[0]) - before
                read += len(text)
                if entries > HELD_TERMS or read > HELD_BYTES:
                    yield from leave(held)
                    entries = read = 0
        yield from leave(held)

    names = ["lang", "source", "term", "n", "docs"]
    plain = documents.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")],
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
    )
    counted = plain.mapInArrow(task, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def vocabulary(counts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, term_id, lang_n): the kept terms; ids ascend with (lang, term) and blocks hold 2^16 at most."""
    by_term = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
    kept = stage(by_term.filter(F.col("docs") >= least).select("lang", "term", "lang_n"), "kept-terms")
    ranges = kept.repartitionByRange(tasks_for(kept.count(), TERMS_A_TASK), "lang", "term").sortWithinPartitions("lang", "term")
    return stage(ranges.select("lang", "term", F.monotonically_increasing_id().alias("term_id"), "lang_n"), "vocabulary")


# --- prices --------------------------------------------------------------------------------

def price(n, total: int, kept: int):
    """1 + floor(10^9 (n + 5) / (N + 5 V)) of counts ``n``, by long division that stays in 64 bits."""
    rest, by, whole = np.asarray(n, np.int64) + ADDED, total + ADDED * kept, 0
    for _ in range(SCALE_STEPS):
        rest = rest * 1000
        whole, rest = whole * 1000 + rest // by, rest % by
    return 1 + whole


def price_column(n: Column, total: Column, kept: Column) -> Column:
    """``price`` as an expression; a total beyond 64 bits stops the query."""
    rest, by, whole = n + ADDED, total + ADDED * kept, F.lit(0).cast("long")
    for _ in range(SCALE_STEPS):
        rest = rest * 1000
        whole, rest = whole * 1000 + F.call_function("div", rest, by), rest % by
    return whole + 1


def gallop(few: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Where each id of ``few`` stands, or would stand, in ``many``; both ascend.

    A run of ids at a time: steps double from the last place until they pass the run's end, and
    only that window is searched.
    """
    places, at = np.empty(len(few), np.int64), 0
    for start in range(0, len(few), GALLOP):
        run = few[start : start + GALLOP]
        step = GALLOP
        while at + step < len(many) and many[at + step - 1] < run[-1]:
            step *= 2
        places[start : start + GALLOP] = at + np.searchsorted(many[at : at + step], run)
        at = int(places[start + len(run) - 1])
    return places


class Prices:
    """One group's part of a block: its terms, their prices, and the price of an absent term."""

    def __init__(self, source: str, number: int, ids: np.ndarray, counts: np.ndarray, total: int, kept: int):
        self.source, self.number, self.ids = source, number, ids
        self.of = price(counts, total, kept) if kept else np.zeros(0, np.int64)
        self.absent = int(price(0, total, kept)) if kept else 0


def distance(x: Prices, y: Prices, terms: int) -> int:
    """Sum of price differences over a block of ``terms`` kept terms."""
    if len(x.ids) > len(y.ids):
        x, y = y, x
    places = gallop(x.ids, y.ids)
    both = places < len(y.ids)
    both[both] = y.ids[places[both]] == x.ids[both]
    at = places[both]
    only_x = np.abs(x.of[~both] - y.absent).sum()
    only_y = np.abs(y.of - x.absent).sum() - np.abs(y.of[at] - x.absent).sum()
    neither = (terms - len(x.ids) - len(y.ids) + len(at)) * abs(x.absent - y.absent)
    return int(np.abs(x.of[both] - y.of[at]).sum() + only_x + only_y) + neither


# --- pairs ---------------------------------------------------------------------------------

def pairs(sparse: DataFrame, groups: DataFrame, blocks: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of sources of a language."""
    arrays = sparse.groupBy("lang", "source", "block").agg(F.sort_array(F.collect_list(F.struct("term_id", "n"))).alias("entries"))
    tiles = F.greatest(F.lit(1), F.ceil(F.col("sources") / TILE)).cast("int")
    cell = F.explode(F.transform(F.sequence(F.lit(0), tiles - 1), lambda j: F.struct(F.least("tile", j).alias("low"), F.greatest("tile", j).alias("high"))))
    # a group has a row in every block of its language, also where it has no term of it
    members = (
        groups.withColumn("tile", F.floor(F.col("number") / TILE).cast("int"))
        .join(blocks, "lang", "left")
        .fillna({"block": 0, "terms": 0})
        .join(arrays, ["lang", "source", "block"], "left")
        .select("*", cell.alias("cell"))
        .select(
            "lang", "source", "number", "tile", "total", "kept", "block", "terms", "cell.low", "cell.high",
            *[F.coalesce(F.col(f"entries.{c}"), F.array().cast("array<long>")).alias(a) for c, a in (("term_id", "ids"), ("n", "counts"))],
        )
    )

    def task(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        lists = {}
        for name in ("ids", "counts"):
            column = cell.column(name).combine_chunks()
            values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
            lists[name] = [values[offsets[i] : offsets[i + 1]] for i in range(len(column))]
        facts = cell.drop_columns(["ids", "counts"]).to_pylist()
        sides = {}
        for r, ids, counts in zip(facts, lists["ids"], lists["counts"], strict=True):
            sides.setdefault(r["tile"], []).append(Prices(r["source"], r["number"], ids, counts, r["total"], r["kept"]))
        terms = facts[0]["terms"]
        one, other = sides.get(facts[0]["low"], []), sides.get(facts[0]["high"], [])
        found = [(x.source, y.source, distance(x, y, terms)) for x in one for y in other if x.number < y.number]
        a, b, value = zip(*found, strict=True) if found else ((), (), ())
        lang = [facts[0]["lang"]] * len(found)
        return pa.table({"lang": pa.array(lang, pa.string()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "value": pa.array(value, pa.int64())})

    priced = members.groupBy("lang", "block", "low", "high").applyInArrow(task, "lang string, a string, b string, value long")
    summed = priced.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return summed.select("lang", ways.alias("way"), "value").select("lang", "way.source", "way.item", "value")


def audit(documents: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to other sources, and the terms a source overuses most."""
    counts = stage(count_terms(documents), "term-counts")
    terms = vocabulary(counts, least)
    kept = counts.join(terms, ["lang", "term"]).select("lang", "source", "term", "term_id", "n", "lang_n")
    sparse = stage(kept.withColumn("block", F.shiftright("term_id", BLOCK_BITS)), "group-terms")
    blocks = stage(terms.groupBy("lang", F.shiftright("term_id", BLOCK_BITS).alias("block")).agg(F.count(F.lit(1)).alias("terms")), "blocks")
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    totals = sparse.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    by_lang = Window.partitionBy("lang")
    groups = (
        counts.filter("term is null").select("lang", "source")
        .join(totals, ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .fillna(0)
        .withColumns({"number": F.row_number().over(by_lang.orderBy("source")) - 1, "sources": F.count(F.lit(1)).over(by_lang)})
    )
    groups = stage(groups, "groups")

    p, q = (price_column(F.col(n), F.col(total), F.col("kept")) for n, total in (("n", "total"), ("lang_n", "lang_total")))
    facts = small(groups, groups.count() * ROW_BYTES)
    over = sparse.join(facts, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).filter("value > 0")

    def ranked(found: DataFrame, part: str) -> DataFrame:
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return found.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    return ranked(pairs(sparse, groups, blocks), "pair").union(ranked(over, "term").filter(F.col("rank") <= top))
