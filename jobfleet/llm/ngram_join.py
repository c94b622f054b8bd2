"""N-gram Jaccard join as a T-occurrence search with skipped long lists (DivideSkip).

Two documents link when their sets of word shingles have a Jaccard similarity of at least
a ``Measure`` (0.9 by default). A document of n shingles needs an overlap of T = ceil(0.9 n) or more with
any partner, so a partner must occur in at least T - L of the inverted lists that stay when
the L longest are set aside.

1. Equal sets become one node (a hash of the set); copies are rows of a table.
2. Token frequencies of all documents are counted in a sketch of fixed size, which orders tokens
   rare to frequent. The order decides speed only.
3. Every node posts the n - T + c rarest of its tokens (its short lists), c = ``SHARE`` of n. Linked nodes
   share at least c of these; nodes with fewer tokens in lists of two or more nodes are out.
4. The rest is put into groups: each node follows the node with which it shares most lists. Nodes
   that still share c tokens with other groups merge their groups. Groups are such that
   linked nodes are always in one.
5. Inside a group, blocks of bounded tokens and nodes meet pairwise in a task each: the inverted lists of a
   block are searched for every node of the other. Short lists are merged to count occurrences, long ones probed by binary
   search until the required overlap is reached or out of reach. A task returns a spanning forest of the links it
   found and each node's number of links, never the pairs.
6. Components of the links, over copies too.

A shingle is a 64-bit hash of its words, a node a 64-bit hash of its set; at a billion documents
the odds of any two different sets sharing a node are about one in forty.

Defined results: null and empty texts have no shingles and link with nothing; a text of fewer
words than a shingle is one shingle; rows are nodes by their text, so repeated rows are copies; component_id is the
least doc_id of the component, nulls left aside; an empty table gives an empty result; all columns are
kept, and columns named like the results are replaced.
"""

from collections.abc import Iterator
from dataclasses import dataclass
import hashlib
import heapq
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobfleet.llm.common import let, lower_ascii, small, stage, text_key, words
from jobfleet.llm.components import components

SHARE = 0.05
SKETCH = 1 << 18
BLOCK_TOKENS = 1 << 20
BLOCK_NODES = 1 << 14
PIECE = 512  # tokens of a set that travel in one row
PROBES = 16  # long lists probed before hopeless candidates go
MU = 0.01
HEAP_ENTRIES = 256  # entries of short lists that a heap merges; more are merged by sorting
ROW_BYTES = 64


@dataclass(frozen=True)
class Measure:
    """Words a shingle, and the least similarity as numerator / denominator."""

    shingle: int = 3
    numerator: int = 9
    denominator: int = 10

    def needed(self, n):
        """Least overlap with any partner of a set of n."""
        return -(-self.numerator * n // self.denominator)

    def overlap(self, n, m):
        """Least overlap of linked sets of n and m."""
        return -(-self.numerator * (n + m) // (self.numerator + self.denominator))

    def short_count(self, n: int) -> int:
        """n - T + c: how many lists of a set of n are short ones."""
        return n - self.needed(n) + common(n)


def common(n: int) -> int:
    """c: how many short lists linked nodes share at least, for a set of n."""
    return max(1, int(SHARE * n))


# --- sets ----------------------------------------------------------------------------------

def word_hashes(text: Column) -> Column:
    return let(words(lower_ascii(text)), lambda w: F.transform(w, lambda x: F.xxhash64(x)))


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingles from the hashes of a text's words."""
    w = hashes.view(np.uint64)
    if not len(w):
        return w
    run = min(size, len(w))
    mixed = np.full(len(w) - run + 1, run, np.uint64)
    for k in range(run):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - run + 1 + k]
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def node_of(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def rank(tokens: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Indexes of the tokens from rare to frequent; equal ones by token."""
    return np.argsort(sketch[(tokens & np.uint64(SKETCH - 1)).astype(np.int64)], kind="stable")


def lists_of(column) -> Iterator[np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    for i in range(len(column)):
        yield values[offsets[i] : offsets[i + 1]]


def hashed(documents: DataFrame) -> DataFrame:
    return documents.select(text_key("doc_id", "text").alias("row_key"), "doc_id", word_hashes(F.col("text")).alias("w"))


# --- facts and frequencies -----------------------------------------------------------------

def facts_and_sketch(documents: DataFrame, measure: Measure) -> tuple[DataFrame, np.ndarray]:
    """(row_key, doc_id, n, node) of every row, and token counts by bucket over all rows."""
    schema = "row_key binary, doc_id long, n long, node long, sketch binary"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.int64)
        for batch in batches:
            n, nodes = [], []
            for w in lists_of(batch.column("w")):
                tokens = shingle_set(w, measure.shingle)
                n.append(len(tokens))
                nodes.append(node_of(tokens))
                np.add.at(counts, (tokens & np.uint64(SKETCH - 1)).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_key"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.nulls(len(n), pa.binary())],
                ["row_key", "doc_id", "n", "node", "sketch"],
            )
        if counts.any():
            yield summed_row(counts)

    def summed_row(counts: np.ndarray) -> pa.RecordBatch:
        data = np.minimum(counts, np.iinfo(np.uint32).max).astype("<u4").tobytes()
        one = lambda kind: pa.nulls(1, kind)
        return pa.RecordBatch.from_arrays(
            [one(pa.binary()), one(pa.int64()), one(pa.int64()), one(pa.int64()), pa.array([data], pa.binary())],
            ["row_key", "doc_id", "n", "node", "sketch"],
        )

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for data in batch.column("sketch"):
                total += np.frombuffer(data.as_py(), "<u4")
        if total.any():
            yield summed_row(total)

    both = stage(hashed(documents).mapInArrow(task, schema), "ngram-facts")
    sketches = both.filter("sketch is not null")
    parts = sketches.count()
    while parts > 1:  # each step adds up some 32 sketches a task
        parts = -(-parts // 32)
        sketches = stage(sketches.repartition(parts).mapInArrow(add_up, schema), "ngram-sketch")
    row = sketches.first()
    sketch = np.zeros(SKETCH, np.int64) if row is None else np.frombuffer(bytes(row["sketch"]), "<u4").astype(np.int64)
    return both.filter("row_key is not null").drop("sketch"), sketch


def postings(documents: DataFrame, sketch: np.ndarray, measure: Measure) -> DataFrame:
    """(token, node, n): the short lists' entries of every node; copies within a task post once."""
    held = documents.sparkSession.sparkContext.broadcast(sketch.astype(np.uint32))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = held.value, set()
        for batch in batches:
            tokens_out, nodes_out, n_out = [], [], []
            for w in lists_of(batch.column("w")):
                tokens = shingle_set(w, measure.shingle)
                node = node_of(tokens)
                if not len(tokens) or node in seen:
                    continue
                seen.add(node)
                short = tokens[rank(tokens, counts)[: measure.short_count(len(tokens))]]
                tokens_out.append(short.view(np.int64))
                nodes_out.append(np.full(len(short), node, np.int64))
                n_out.append(np.full(len(short), len(tokens), np.int32))
            if tokens_out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in (tokens_out, nodes_out, n_out)], ["token", "node", "n"]
                )

    return hashed(documents).select("w").mapInArrow(task, "token long, node long, n int")


# --- groups --------------------------------------------------------------------------------

def least_common(n: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(n * F.lit(SHARE)).cast("int"))


def meeting(posted: DataFrame, key: str) -> DataFrame:
    """The rows of ``posted`` whose token's rows differ in ``key``.

    Tokens grow with the corpus, so the join is by shuffle at every size; adaptive execution
    splits the rows of a hot token.
    """
    ends = posted.groupBy("token").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).filter("lo <> hi")
    tokens = stage(ends.select("token"), "met-tokens")
    return posted.join(tokens.hint("merge"), "token", "left_semi")


def enough(posted: DataFrame) -> DataFrame:
    """The rows of ``posted`` of nodes that have as many of them as linked nodes share."""
    counts = posted.groupBy("node").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("n"))
    nodes = stage(counts.filter(F.col("k") >= least_common(F.col("n"))).select("node"), "met-nodes")
    return posted.join(small(nodes, nodes.count() * ROW_BYTES), "node", "left_semi")


def relabel(posted: DataFrame, edges: DataFrame, column: str = "group") -> DataFrame:
    roots = components(edges)
    roots = small(roots, roots.count() * ROW_BYTES).select(F.col("node").alias(column), F.col("root").alias("_root"))
    return posted.join(roots, column, "left").withColumn(column, F.coalesce("_root", column)).drop("_root")


def groups(posted: DataFrame) -> DataFrame:
    """(node, n, group) of the nodes that may have partners; linked nodes share a group."""
    shared = stage(enough(meeting(posted, "node").distinct()), "shared-postings")
    shared = stage(enough(meeting(shared, "node")), "shared-postings")
    leaders = shared.groupBy("token").agg(F.min("node").alias("leader"))
    followed = (
        shared.join(leaders, "token")
        .filter("leader <> node")
        .groupBy("node", "leader")
        .agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("n"))
        .filter(2 * F.col("k") >= least_common(F.col("n")))
        .groupBy("node")
        .agg(F.max(F.struct("k", "leader")).alias("best"))
        .select(F.col("node").alias("a"), F.col("best.leader").alias("b"))
    )
    grouped = stage(relabel(shared.withColumn("group", F.col("node")), followed), "grouped-postings")
    across = enough(meeting(grouped, "group"))
    across = stage(enough(meeting(across, "group")), "postings-across")
    stars = across.join(across.groupBy("token").agg(F.min("group").alias("b")), "token").select(F.col("group").alias("a"), "b")
    merged = relabel(grouped.select("node", "n", "group").distinct(), stars)
    return stage(merged, "groups")


# --- search inside a group -----------------------------------------------------------------

class Index:
    """Inverted lists over a block of sets in ascending order of size; members are numbered by position."""

    def __init__(self, sets: list[np.ndarray], measure: Measure):
        self.measure = measure
        self.size = np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate([np.zeros(0, np.uint64), *sets])
        owner = np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(tokens, kind="stable")  # owners stay ascending within a list
        tokens, self.owner = tokens[order], owner[order]
        self.token, self.start = np.unique(tokens, return_index=True)
        self.end = np.append(self.start[1:], len(tokens))

    def search(self, query: np.ndarray, after: int = -1) -> np.ndarray:
        """Members beyond ``after`` that have the required overlap with ``query``."""
        n, up, down = len(query), self.measure.denominator, self.measure.numerator
        # members from lo to hi - 1 are of a fitting size
        lo = max(after + 1, int(np.searchsorted(self.size, -(-down * n // up))))
        hi = int(np.searchsorted(self.size, up * n // down, side="right"))
        none = np.zeros(0, np.int64)
        if lo >= hi:
            return none
        at = np.searchsorted(self.token, query)
        at = at[(at < len(self.token)) & (self.token[np.minimum(at, len(self.token) - 1)] == query)]
        at = at[(self.owner[self.end[at] - 1] >= lo) & (self.owner[self.start[at]] < hi)]
        least = int(self.measure.overlap(n, int(self.size[lo])))
        if len(at) < least:
            return none
        starts, ends = self.start[at], self.end[at]
        order = np.argsort(ends - starts, kind="stable")
        starts, ends = starts[order], ends[order]
        longest = int(ends[-1] - starts[-1])
        skip = min(least - 1, int(least / (MU * np.log2(max(longest, 2)) + 1)))
        short = len(at) - skip
        found, have = self._merge(starts[:short].tolist(), ends[:short].tolist(), lo, hi, least - skip)
        want = self.measure.overlap(n, self.size[found])
        # probe the long lists, dropping candidates that can no longer reach their overlap
        for i in range(short, len(at), PROBES):
            left = len(at) - i
            live = have + left >= want
            found, have, want = found[live], have[live], want[live]
            if not len(found):
                break
            for s, e in zip(starts[i : i + PROBES], ends[i : i + PROBES], strict=True):
                members = self.owner[s:e]
                place = np.searchsorted(members, found)
                have = have + ((place < len(members)) & (members[np.minimum(place, len(members) - 1)] == found))
        return found[have >= want]

    def _merge(self, starts: list[int], ends: list[int], lo: int, hi: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Members from lo to hi - 1 that occur in ``least`` of the lists or more, and in how many.

        Lists that hold fewer entries than there are members are merged by a heap, the least head first; beyond
        that members are counted in place, which costs less than a comparison for each entry.
        """
        total = sum(ends) - sum(starts)
        if total < min(HEAP_ENTRIES, hi - lo):
            run = heapq.merge(*(self.owner[s:e].tolist() for s, e in zip(starts, ends, strict=True)))
            times = [(member, len(list(same))) for member, same in groupby(run) if lo <= member < hi]
            kept = [x for x in times if x[1] >= least]
            return np.array([m for m, _ in kept], np.int64), np.array([k for _, k in kept], np.int64)
        merged = np.concatenate([self.owner[s:e] for s, e in zip(starts, ends, strict=True)])
        if total < hi - lo:
            members, count = np.unique(merged, return_counts=True)
            fit = (members >= lo) & (members < hi) & (count >= least)
            return members[fit], count[fit]
        count = np.bincount(merged, minlength=hi)[lo:hi]
        found = np.flatnonzero(count >= least)
        return found + lo, count[found]


def search_cell(nodes: list[int], sides: list[int], copies: list[int], sets: list[np.ndarray], within: bool, measure: Measure):
    """Links inside one block, or between two: a spanning forest, and links per node counting copies."""
    by_size = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    queries = by_size if within else [i for i in by_size if sides[i] == 0]
    members = by_size if within else [i for i in by_size if sides[i] == 1]
    index = Index([sets[i] for i in members], measure)
    links, parent = [0] * len(sets), list(range(len(sets)))
    forest = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for place, i in enumerate(queries):
        for j in index.search(sets[i], place if within else -1).tolist():
            j = members[j]
            links[i] += copies[j]
            links[j] += copies[i]
            a, b = root(i), root(j)
            if a != b:
                parent[a] = b
                forest.append((nodes[i], nodes[j]))
    return forest, [(nodes[i], k) for i, k in enumerate(links) if k]


def links(documents: DataFrame, facts: DataFrame, grouped: DataFrame, classes: DataFrame, measure: Measure) -> DataFrame:
    """(a, b, k): edges of a spanning forest (k null), and numbers of links (b null) of node a."""
    sums = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("tokens")).filter("nodes > 1")
    blocks = F.ceil(F.greatest(F.col("tokens") / BLOCK_TOKENS, F.col("nodes") / BLOCK_NODES)).cast("int")
    members = (
        grouped.join(sums.select("group", blocks.alias("blocks")), "group")
        .join(classes.select("node", "copies", "row_key"), "node")
        .withColumn("block", F.pmod(F.xxhash64(F.lit(5), "node"), F.col("blocks")).cast("int"))
    )
    # cell (i, j), i <= j: block i meets block j; a block takes part in one cell with each block
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cells = members.select("group", "node", "copies", "row_key", "block", other).select(
        F.xxhash64("group", F.least("block", "other"), F.greatest("block", "other")).alias("cell"),
        F.col("group"),
        (F.col("block") == F.col("other")).alias("within"),
        (F.col("block") > F.col("other")).cast("int").alias("side"),
        "node",
        "copies",
        "row_key",
    )
    cells = stage(cells, "cells")
    wanted = stage(members.select("row_key").distinct(), "wanted-rows")
    count = wanted.count()
    if not count:
        return facts.sparkSession.createDataFrame([], "a long, b long, k long")
    chosen = hashed(documents).join(small(wanted, count * ROW_BYTES), "row_key", "left_semi")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, numbers, parts = [], [], []
            for w in lists_of(batch.column("w")):
                tokens = shingle_set(w, measure.shingle).view(np.int64)
                node = node_of(tokens)
                for i in range(0, len(tokens), PIECE):
                    nodes.append(node)
                    numbers.append(i // PIECE)
                    parts.append(tokens[i : i + PIECE])
            if nodes:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.int64()), pa.array(numbers, pa.int32()), pa.array(parts, pa.list_(pa.int64()))],
                    ["node", "piece", "tokens"],
                )

    sets = chosen.select("w").mapInArrow(pieces, "node long, piece int, tokens array<long>").dropDuplicates(["node", "piece"])
    dealt = cells.drop("row_key").join(sets, "node")
    total = cells.count()
    dealt = dealt.repartition(max(8, total // 2000), "cell").sortWithinPartitions("cell", "group", "node", "piece")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, within = None, [], True

        def done():
            merged: dict[int, tuple] = {}
            for node, side, copies, tokens in held:
                merged.setdefault(node, (side, copies, []))[2].append(tokens)
            nodes = list(merged)
            forest, counts = search_cell(
                nodes,
                [merged[x][0] for x in nodes],
                [merged[x][1] for x in nodes],
                [np.concatenate(merged[x][2]).view(np.uint64) for x in nodes],
                within,
                measure,
            )
            rows = [(a, b, None) for a, b in forest] + [(a, None, k) for a, k in counts]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["a", "b", "k"]) if rows else None

        for batch in batches:
            columns = [batch.column(x).to_pylist() for x in ("cell", "group", "within", "node", "side", "copies")]
            for (c, g, inside, node, side, copies), tokens in zip(zip(*columns), lists_of(batch.column("tokens"))):
                if (c, g) != cell:
                    if held and (out := done()) is not None:
                        yield out
                    cell, held, within = (c, g), [], inside
                held.append((node, side, copies, tokens.copy()))
        if held and (out := done()) is not None:
            yield out

    return stage(dealt.mapInArrow(task, "a long, b long, k long"), "links")


def classify(documents: DataFrame, measure: Measure = Measure()) -> DataFrame:
    """One row per row: row_key, doc_id, n_shingles, component_id, n_links (rows linked with it, copies
    counted) and stays (whether the row is the first of its component by doc_id, then text)."""
    texts = documents.select("doc_id", "text")
    facts, sketch = facts_and_sketch(texts, measure)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row_key"))
    classes = stage(
        facts.filter("n > 0").groupBy("node").agg(F.count(F.lit(1)).alias("copies"), first.alias("first"))
        .select("node", "copies", "first", "first.row_key"),
        "classes",
    )
    posted = stage(postings(texts, sketch, measure), "postings")
    found = links(texts, facts, groups(posted), classes, measure)
    roots = components(found.filter("b is not null").select("a", "b"))
    linked = found.filter("k is not null").groupBy(F.col("a").alias("node")).agg(F.sum("k").alias("k"))
    told = classes.join(roots, "node", "left").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    told = stage(told.filter((F.col("copies") > 1) | F.col("k").isNotNull()), "linked-classes")
    least = told.groupBy("root").agg(F.min("first").alias("of_all"))
    told = stage(
        told.join(least, "root").select(
            "node",
            F.col("of_all.doc_id").alias("component_id"),
            F.col("of_all.row_key").alias("first_row"),
            (F.col("copies") - 1 + F.coalesce("k", F.lit(0))).alias("n_links"),
        ),
        "components",
    )
    result = facts.join(small(told, told.count() * ROW_BYTES), "node", "left")
    return result.select(
        "row_key",
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("first_row").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.col("row_key") == F.col("first_row"), F.lit(True)).alias("stays"),
    )


def keep_one(documents: DataFrame, measure: Measure = Measure()) -> DataFrame:
    """``documents`` with one row of each component, the first by doc_id; rows without shingles stay."""
    told = stage(classify(documents, measure).select("row_key", "n_shingles", "stays"), "ngram-verdicts")
    gone = told.filter("not stays").select("row_key").distinct()
    repeated = told.filter("n_shingles > 0 and stays").groupBy("row_key").count().filter("count > 1").select("row_key")
    gone, repeated = (small(x, x.count() * ROW_BYTES) for x in (stage(gone, "gone"), stage(repeated, "repeated")))
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")  # out of the way of the names used here
    keyed = documents.select(row, text_key("doc_id", "text").alias("row_key"))
    kept = keyed.join(gone, "row_key", "left_anti")
    single = kept.join(repeated, "row_key", "left_anti")
    again = kept.join(repeated, "row_key", "left_semi").groupBy("row_key").agg(F.first("row").alias("row"))
    return single.select("row.*").unionByName(again.select("row.*"))
