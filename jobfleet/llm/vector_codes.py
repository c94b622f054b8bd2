"""Vector code compression: product codes by Lloyd's algorithm over trees of both parts and entries.

Components become the integers floor(1024 x) and vectors are cut into ``PARTS`` consecutive parts. Each part position has a codebook that
starts as the parts of the ``ENTRIES`` smallest ids; every round assigns each part to its nearest entry (squared
distance, ties to the lower index) and moves each entry to its parts' componentwise floor(sum / count).

1. Vectors are taken in blocks of bounded bytes. A block has a tree for each position: nodes are runs of
   parts with a box, a count and cached sums. The blocks are written once and read in every round.
2. A task walks its trees against a tree over the entries. Box distances drop entry nodes that are further than
   another one is at most. Among the entries left, one that is nearer than all others at the worst corner of the box takes the
   whole node, which adds its cached sums; a leaf that stays uncertain is decided part by part.
3. Sums by entry are added up over tasks; their number is bounded by the codebooks, which go out to the next round.
4. A last walk assigns the codes; errors follow from codes, and are summed by label.

All comparisons and sums are of integers, so no result depends on the order of rows or on how they are dealt.

Defined results: rows without a vector, or with a component that is null or not finite, are dropped. Ids are used in
ascending order, nulls last, rows of one id by their vectors; fewer rows than entries give shorter codebooks, with as many entries as
rows. Equal rows are rows each. The first row's vector tells the length; a vector of another length has null code and
errors. Lengths not divisible by four are cut at the floors of the quarters. Null labels are one label. An empty table gives an
empty result; other columns of the caller are not read. A component beyond +-``LARGEST`` / 1024 (some 130,000, for up to 120 components),
whose errors could pass 64 bits, stops the query.
"""

from collections.abc import Iterator
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobfleet.llm.common import small, stage

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
LEAF = 128  # parts; smaller ones decide more whole nodes, larger ones compare more parts at once
BLOCK_BYTES = 2 << 20  # of integers, in a block of vectors
LARGEST = 1 << 27
#: Integers up to here are exact as doubles, so that products of small ones may use them.
EXACT = 1 << 53
ROW_BYTES = 64


def cuts(length: int) -> list[int]:
    return [length * i // PARTS for i in range(PARTS + 1)]


# --- trees ---------------------------------------------------------------------------------

class Tree:
    """Points in the order of a tree: node i holds the points ``start[i]`` to ``end[i]``, its children are ``child[i]`` and the next.

    ``child`` is 0 in a leaf. Nodes stand parents first.
    """

    def __init__(self, points: np.ndarray, leaf: int):
        self.order = np.arange(len(points))
        starts, ends, child = [0], [len(points)], [0]
        at = 0
        while at < len(starts):
            start, end = starts[at], ends[at]
            if end - start > leaf:
                own = self.order[start:end]
                inside = points[own]
                wide = int(np.argmax(inside.max(0) - inside.min(0))) if points.shape[1] else 0
                middle = (end - start) // 2
                if points.shape[1]:
                    self.order[start:end] = own[np.argpartition(inside[:, wide], middle)]
                child[at] = len(starts)
                starts += [start, start + middle]
                ends += [start + middle, end]
                child += [0, 0]
            at += 1
        self.points = points[self.order]
        self.start, self.end, self.child = (np.array(x, np.int64) for x in (starts, ends, child))
        total = np.vstack([np.zeros((1, points.shape[1]), np.int64), np.cumsum(self.points, axis=0)])
        self.sums = total[self.end] - total[self.start]
        self.low, self.high = (np.array([f(self.points[s:e], axis=0) for s, e in zip(starts, ends, strict=True)]) for f in (np.min, np.max))

    FIELDS = ("order", "points", "start", "end", "child", "sums", "low", "high")

    def packed(self) -> list[bytes]:
        return [np.ascontiguousarray(getattr(self, f), np.int64).tobytes() for f in self.FIELDS]

    @classmethod
    def unpacked(cls, data: list, width: int) -> "Tree":
        tree = cls.__new__(cls)
        for field, piece in zip(cls.FIELDS, data, strict=True):
            values = np.frombuffer(piece, np.int64)
            setattr(tree, field, values if field in ("order", "start", "end", "child") else values.reshape(-1, width) if width else values.reshape(len(tree.order) if field == "points" else len(data[2]) // 8, 0))
        return tree


def squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances between integer points and entries."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * points.shape[1] * most * most < EXACT:
        p, e = points.astype(np.float64), entries.astype(np.float64)
        return ((p * p).sum(1)[:, None] - 2 * (p @ e.T) + (e * e).sum(1)).astype(np.int64)
    return ((points**2).sum(1)[:, None] - 2 * (points @ entries.T)) + (entries**2).sum(1)


class Walk:
    """Assigns the points of trees to the nearest entries of one codebook."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.tree = entries, Tree(entries, 1)
        self.square = (entries**2).sum(1)

    def near(self, low: np.ndarray, high: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Those entry nodes that may hold the nearest entry of a point in the box."""
        a, b = self.tree.low[nodes], self.tree.high[nodes]
        apart = np.maximum(np.maximum(a - high, low - b), 0)
        across = np.maximum(np.abs(high - a), np.abs(b - low))
        return nodes[(apart**2).sum(1) <= (across**2).sum(1).min()]

    def undominated(self, low: np.ndarray, high: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Without the entries to which no point of the box goes, as one entry is nearer at every corner."""
        middle = (low + high) >> 1
        best = found[np.lexsort((found, ((self.entries[found] - middle) ** 2).sum(1)))[0]]
        step = self.entries[found] - self.entries[best]
        # most of (distance to best - distance to the other) in the box, which is linear in the point
        worst = self.square[best] - self.square[found] + 2 * np.maximum(low * step, high * step).sum(1)
        return found[(worst > 0) | ((worst == 0) & (found < best)) | (found == best)]

    def assign(self, tree: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entry of every point (in tree order), and counts and sums by entry."""
        codes = np.zeros(len(tree.points), np.int64)
        counts, sums = np.zeros(len(self.entries), np.int64), np.zeros(self.entries.shape, np.int64)
        todo = [(0, np.zeros(1, np.int64))] if len(tree.points) else []
        while todo:
            node, nodes = todo.pop()
            low, high, child = tree.low[node], tree.high[node], int(tree.child[node])
            nodes = self.near(low, high, nodes)
            width = (high - low).sum()
            while True:  # open the entry nodes that are wider than the box, in a leaf all of them
                inner = (self.tree.child[nodes] > 0) & (((self.tree.high[nodes] - self.tree.low[nodes]).sum(1) >= width) | (child == 0))
                if not inner.any():
                    break
                opened = self.tree.child[nodes[inner]]
                nodes = self.near(low, high, np.concatenate([nodes[~inner], opened, opened + 1]))
            start, end = int(tree.start[node]), int(tree.end[node])
            if not (self.tree.child[nodes] > 0).any():
                found = self.undominated(low, high, self.tree.order[self.tree.start[nodes]])
                if len(found) == 1:
                    codes[start:end] = found[0]
                    counts[found[0]] += end - start
                    sums[found[0]] += tree.sums[node]
                    continue
                if not child:
                    found = np.sort(found)
                    own = found[squares(tree.points[start:end], self.entries[found]).argmin(1)]  # the first of ties
                    codes[start:end] = own
                    np.add.at(counts, own, 1)
                    np.add.at(sums, own, tree.points[start:end])
                    continue
            todo += [(child, nodes), (child + 1, nodes)]
        return codes, counts, sums


# --- tables --------------------------------------------------------------------------------

def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v): rows with a vector of finite components."""
    v = F.col("embedding").cast("array<double>")
    plain = vectors.select("vec_id", "label", v.alias("v"))
    return plain.filter(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def integers(values: np.ndarray) -> np.ndarray:
    scaled = np.floor(values * SCALE)
    largest = min(LARGEST, math.isqrt((1 << 61) // max(1, values.shape[-1])))
    if np.abs(scaled).max(initial=0) > largest:
        raise OverflowError(f"a component is beyond {largest} / {SCALE}: errors could pass 64 bits")
    return scaled.astype(np.int64)


def blocks(rows: DataFrame, length: int) -> DataFrame:
    """A row per block of vectors: ids, labels, and for each position a packed tree."""
    bounds = cuts(length)
    most = max(LEAF, BLOCK_BYTES // (8 * max(1, length)))
    fields = [f"{f}_{p}" for p in range(PARTS) for f in Tree.FIELDS]
    id_type, label_type = rows.schema["vec_id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()
    schema = f"ids array<{id_type}>, labels array<{label_type}>, " + ", ".join(f"{f} binary" for f in fields)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                while n + part.num_rows >= most:
                    yield block(pa.Table.from_batches([*held, part.slice(0, most - n)]))
                    part, held, n = part.slice(most - n), [], 0
                held.append(part)
                n += part.num_rows
        if n:
            yield block(pa.Table.from_batches(held))

    def block(table: pa.Table) -> pa.RecordBatch:
        v = table.column("v").combine_chunks()
        points = integers(v.flatten().to_numpy().reshape(len(v), length))
        trees = [Tree(points[:, a:b], LEAF) for a, b in zip(bounds, bounds[1:])]
        one = lambda name: pa.ListArray.from_arrays([0, len(v)], table.column(name).combine_chunks())
        data = [pa.array([piece], pa.binary()) for tree in trees for piece in tree.packed()]
        return pa.RecordBatch.from_arrays([one("ids"), one("labels"), *data], ["ids", "labels", *fields])

    plain = rows.filter(F.size("v") == length).select(F.col("vec_id").alias("ids"), F.col("label").alias("labels"), "v")
    return stage(plain.mapInArrow(task, schema), "code-blocks")


def trees_of(batch: pa.RecordBatch, i: int, bounds: list[int]) -> list[Tree]:
    def tree(p: int) -> Tree:
        data = [batch.column(f"{f}_{p}")[i].as_buffer() for f in Tree.FIELDS]
        return Tree.unpacked(data, bounds[p + 1] - bounds[p])

    return [tree(p) for p in range(PARTS)]


def moved(held: DataFrame, books: list[np.ndarray], bounds: list[int]) -> list[np.ndarray]:
    """The codebooks after one round."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks = [Walk(book) for book in books]
        counts, sums = [np.zeros(len(b), np.int64) for b in books], [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            for i in range(batch.num_rows):
                for p, tree in enumerate(trees_of(batch, i, bounds)):
                    _, n, s = walks[p].assign(tree)
                    counts[p] += n
                    sums[p] += s
        for p in range(PARTS):
            used = np.nonzero(counts[p])[0]
            # place -1 is the count
            both = np.column_stack([counts[p][used], sums[p][used]])
            entry, place = np.repeat(used, both.shape[1]), np.tile(np.arange(-1, both.shape[1] - 1), len(used))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(both.size, p, np.int32)), pa.array(entry.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(both.ravel())],
                ["part", "entry", "place", "total"],
            )

    parts = held.mapInArrow(task, "part int, entry int, place int, total long")
    # at most PARTS * ENTRIES * (length / PARTS + 1) rows, whatever the number of vectors
    rows = parts.groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).toPandas()
    counts = {(p, e): n for p, e, n in rows[rows.place < 0][["part", "entry", "total"]].itertuples(index=False)}
    books = [book.copy() for book in books]
    for p, e, place, total in rows[rows.place >= 0][["part", "entry", "place", "total"]].itertuples(index=False):
        books[p][e, place] = int(total) // int(counts[p, e])
    return books


def codes(held: DataFrame, books: list[np.ndarray], bounds: list[int], id_type: str, label_type: str) -> DataFrame:
    """(vec_id, label, code, error) of the vectors of the blocks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks = [Walk(book) for book in books]
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = batch.column("ids")[i].values, batch.column("labels")[i].values
                code, error = np.zeros((len(ids), PARTS), np.uint8), np.zeros(len(ids), np.int64)
                for p, tree in enumerate(trees_of(batch, i, bounds)):
                    own, _, _ = walks[p].assign(tree)
                    code[tree.order, p] = own
                    error[tree.order] += ((tree.points - books[p][own]) ** 2).sum(1)
                text = pa.array([c.tobytes().hex() for c in code], pa.string())
                yield pa.RecordBatch.from_arrays([ids, labels, text, pa.array(error)], ["vec_id", "label", "code", "error"])

    return held.mapInArrow(task, f"vec_id {id_type}, label {label_type}, code string, error long")


def compress(vectors: DataFrame) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error, label_error) of every usable vector, and the codebooks by position."""
    rows = usable(vectors)
    by_id = [F.asc_nulls_last("vec_id"), "v"]
    first = rows.orderBy(*by_id).first()
    if first is None:
        empty = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return empty.limit(0), []
    length = len(first["v"])
    bounds = cuts(length)
    least = rows.filter(F.size("v") == length).orderBy(*by_id).limit(ENTRIES).collect()
    start = integers(np.array([r["v"] for r in least], np.float64).reshape(len(least), length))
    books = [start[:, a:b] for a, b in zip(bounds, bounds[1:])]
    held = blocks(rows, length)
    for _ in range(ROUNDS):
        books = moved(held, books, bounds)
    id_type, label_type = rows.schema["vec_id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()
    coded = codes(held, books, bounds, id_type, label_type)
    other = rows.filter(F.size("v") != length).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = stage(coded.union(other), "codes")
    by_label = stage(coded.groupBy("label").agg(F.sum("error").alias("label_sum")).withColumnRenamed("label", "_label"), "label-errors")
    sums = small(by_label, by_label.count() * ROW_BYTES)
    told = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")), "left")
    return told.select("vec_id", "label", "code", "error", F.when(F.col("code").isNotNull(), F.col("label_sum")).alias("label_error")), books


def books_sha256(books: list[np.ndarray]) -> str:
    """Digest of all entries' components in decimal, by position, entry and place."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()
