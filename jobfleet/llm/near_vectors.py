"""Embedding near-dedup: vectors of a cosine of at least ``SIMILARITY`` by an inverted multi-index.

1. Equal vectors become one node; copies are rows of a table.
2. Each half of the unit vectors has a codebook, fitted on a bounded sample (``SAMPLE`` nodes, ``SAMPLE_BYTES``).
   The nearest entries of both halves are a vector's cell in the product grid. Every vector is in the index.
3. From a vector to an entry's region there is a least distance (by the plane between the entry and the vector's own one, and by the
   radius of the entry's members). The sum of both halves' squares bounds the squared distance to any vector of a cell from below.
   A multi-sequence traversal visits a vector's cells in ascending order of that bound. Linked vectors lie within 2 - 2 ``SIMILARITY``, so a
   traversal up to there misses nothing.
4. The traversal may end before: a bounded sample of vectors (``QUERIES``) is compared with all others, and the
   least bound at which ``RECALL`` of their links are found is taken, both as a mean over vectors and over links. With
   few links in the sample the exact bound holds.
5. Of two cells the lower one's vectors visit the higher one's. A cell's members and visitors are dealt in blocks, each pair of blocks
   to a task, which verifies cosines in double precision (those within rounding of the limit by exact sums) and returns a
   spanning forest of the links and the number of links per node, never the pairs.
6. Components of the links, over copies too.

A group of near copies stays in one or a few cells; its blocks of ``BLOCK`` nodes meet pairwise, each in a task of its own, so
the work within it is the square of its blocks while no task or row grows.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component link with nothing, nor do
vectors of different lengths (those of another length than the commonest have one cell per length). Equal rows are copies and link. A repeated id is a vector
each time. component_id is the least id of the component, nulls left aside, and null where all are; a row of a null id is kept when
that holds. An empty table gives an empty result; other columns of the caller are not read.
"""

from collections.abc import Iterator
import hashlib
import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobfleet.llm.common import small, stage
from jobfleet.llm.components import components

SIMILARITY = 0.95
SAMPLE = 1 << 15
SAMPLE_BYTES = 32 << 20
QUERIES = 1024
RECALL = 0.9999
#: Fewer links than this in the sampled comparison don't tell enough.
LEAST_LINKS = 64
CELL_NODES = 16
ENTRIES = 512
STEPS = 8  # of Lloyd's algorithm on the sample
BLOCK = 4096
VISITORS = 512  # compared at once within a block
DOUBT = 1e-9
ROW_BYTES = 96
#: The bounds tried, as shares of the exact one.
SHARES = [2.0**-k for k in range(6, -1, -1)]


# --- nodes ---------------------------------------------------------------------------------

def lists_of(column: pa.ListArray) -> Iterator[np.ndarray]:
    values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    for i in range(len(column)):
        yield values[offsets[i] : offsets[i + 1]]


def unit(data: list, kind: str, size: int) -> np.ndarray:
    """Rows of length one from packed vectors."""
    rows = np.frombuffer(b"".join(data), kind).reshape(-1, size).astype(np.float64)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def packed(vectors: DataFrame) -> tuple[DataFrame, str]:
    """(vec_id, node, size, v) with null node and vector for those that link with nothing; the packed type."""
    is_float = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind, cast = ("<f4", "array<float>") if is_float else ("<f8", "array<double>")
    id_type = vectors.schema["vec_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, data = [], [], []
            for v in lists_of(batch.column("v")):
                v = (v + 0).astype(kind)  # no negative zeros
                usable = v.any()
                nodes.append(hashlib.blake2b(v.tobytes(), digest_size=16).digest() if usable else None)
                data.append(v.tobytes() if usable else None)
                sizes.append(len(v))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(data, pa.binary())],
                ["vec_id", "node", "size", "v"],
            )

    v = F.col("embedding").cast(cast)
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    plain = vectors.select("vec_id", F.when(finite, v).otherwise(F.array().cast(cast)).alias("v"))
    return plain.mapInArrow(task, f"vec_id {id_type}, node binary, size int, v binary"), kind


def sample(nodes: DataFrame, rows: int, total: int) -> list:
    """About ``rows`` of the nodes, chosen by their hashes; all where there are no more."""
    if total > rows:
        nodes = nodes.filter(F.col("node") < F.lit(bytearray(((1 << 128) * rows // total).to_bytes(16, "big"))))
    return nodes.collect()


# --- the grid ------------------------------------------------------------------------------

def distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    return np.maximum((points**2).sum(1)[:, None] - 2 * points @ entries.T + (entries**2).sum(1), 0)


def fitted(points: np.ndarray, entries: int) -> np.ndarray:
    """A codebook of at most ``entries`` entries by Lloyd's algorithm."""
    if not points.shape[1]:
        return np.zeros((1, 0))
    book = points[np.linspace(0, len(points) - 1, entries).astype(int)]
    for _ in range(STEPS):
        own = distances(points, book).argmin(1)
        count = np.bincount(own, minlength=len(book))
        sums = np.zeros_like(book)
        np.add.at(sums, own, points)
        book = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], book)
    return np.unique(book, axis=0)


class Half:
    """The codebook of one half: nearest entries, and least distances to the entries' regions."""

    def __init__(self, book: np.ndarray, radius: np.ndarray | None = None):
        self.book, self.radius = book, radius
        self.between = np.sqrt(distances(book, book))

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        apart = distances(points, self.book)
        own = apart.argmin(1)
        return own, np.sqrt(apart[np.arange(len(points)), own])

    def bounds(self, points: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Least squared distance from each point to each entry's region."""
        apart = distances(points, self.book)
        plane = (apart - apart[np.arange(len(points)), own][:, None]) / (2 * np.maximum(self.between[own], 1e-12))
        edge = np.sqrt(apart) - self.radius
        least = np.maximum(np.maximum(plane, edge), 0)
        least[np.arange(len(points)), own] = 0
        return least**2


class Grid:
    """Two codebooks; cells are numbered by both halves' entries."""

    def __init__(self, size: int, halves: list[Half]):
        self.size, self.halves = size, halves

    def split(self, rows: np.ndarray) -> list[np.ndarray]:
        return [rows[:, : self.size // 2], rows[:, self.size // 2 :]]

    def bounds(self, rows: np.ndarray, cells: np.ndarray) -> list[np.ndarray]:
        return [h.bounds(p, own) for h, p, own in zip(self.halves, self.split(rows), self.entries_of(cells), strict=True)]

    def entries_of(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return cells // len(self.halves[1].book), cells % len(self.halves[1].book)


def visits(first: np.ndarray, second: np.ndarray, bound: float) -> Iterator[tuple[int, int]]:
    """Multi-sequence traversal: cells in ascending order of the sum of both halves' bounds, up to ``bound``."""
    orders = [np.argsort(x, kind="stable")[: np.count_nonzero(x <= bound)].tolist() for x in (first, second)]
    if not orders[0] or not orders[1]:
        return
    heap = [(first[orders[0][0]] + second[orders[1][0]], 0, 0)]
    while heap:
        total, a, b = heapq.heappop(heap)
        if total > bound:
            return
        yield orders[0][a], orders[1][b]
        steps = [(a, b + 1), (a + 1, b)] if b == 0 else [(a, b + 1)]
        for i, j in steps:
            if i < len(orders[0]) and j < len(orders[1]):
                heapq.heappush(heap, (first[orders[0][i]] + second[orders[1][j]], i, j))


def indexed(nodes: DataFrame, kind: str, size: int, total: int) -> tuple[DataFrame, Grid]:
    """The nodes with their cells (null ``cell`` for other lengths), and the grid of vectors of ``size``."""
    wanted = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * size)))
    rows = sample(nodes.filter(F.col("size") == size).select("node", "v"), wanted, total)
    points = unit([r["v"] for r in sorted(rows)], kind, size) if rows else np.zeros((1, size))
    entries = max(1, min(math.isqrt(total // CELL_NODES), ENTRIES, len(points) // 8))
    grid = Grid(size, [])
    grid.halves = [Half(fitted(p, entries)) for p in grid.split(points)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            halves = grid.split(unit(batch.column("v").to_pylist(), kind, size))
            (a, to_a), (b, to_b) = (h.nearest(p) for h, p in zip(grid.halves, halves, strict=True))
            extra = [pa.array(x) for x in (a.astype(np.int64) * len(grid.halves[1].book) + b, to_a, to_b)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "cell", "to_first", "to_second"])

    schema = "node binary, copies long, size int, v binary, cell long, to_first double, to_second double"
    held = stage(nodes.filter(F.col("size") == size).select("node", "copies", "size", "v").mapInArrow(task, schema), "vector-cells")
    n = len(grid.halves[1].book)
    for half, entry, far in ((grid.halves[0], F.floor(F.col("cell") / n), "to_first"), (grid.halves[1], F.col("cell") % n, "to_second")):
        # a row per entry
        radius = held.groupBy(entry.cast("int").alias("entry")).agg(F.max(far).alias("far")).collect()
        half.radius = np.zeros(len(half.book))
        for r in radius:
            half.radius[r["entry"]] = r["far"]
    return held, grid


def stopping_bound(held: DataFrame, grid: Grid, kind: str, total: int, similarity: float, recall: float) -> float:
    """The least bound that finds ``recall`` of the links of a sample of vectors, compared with all others."""
    exact = 2 - 2 * similarity
    rows = sorted(sample(held.select("node", "v", "cell"), QUERIES, total))
    if not rows:
        return exact
    queries, cells = unit([r["v"] for r in rows], kind, grid.size), np.array([r["cell"] for r in rows])
    names, edges = [bytes(r["node"]) for r in rows], np.array(SHARES) * exact

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((len(queries), len(edges) + 1), np.int64)
        far = grid.bounds(queries, cells)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                others, other_cells = unit(part.column("v").to_pylist(), kind, grid.size), part.column("cell").to_numpy()
                place = {node: i for i, node in enumerate(part.column("node").to_pylist())}
                hit = queries @ others.T >= similarity
                for q, name in enumerate(names):
                    if name in place:
                        hit[q, place[name]] = False
                q, o = np.nonzero(hit)
                if not len(q):
                    continue
                back = grid.bounds(others[o], other_cells[o])
                to, of = grid.entries_of(other_cells[o]), grid.entries_of(cells[q])
                there = far[0][q, to[0]] + far[1][q, to[1]]
                here = np.arange(len(q))
                need = np.where(cells[q] < other_cells[o], there, back[0][here, of[0]] + back[1][here, of[1]])
                need[cells[q] == other_cells[o]] = 0
                np.add.at(found, (q, np.searchsorted(edges, need)), 1)
        q, edge = np.nonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(edge), pa.array(found[q, edge])], ["query", "edge", "links"])

    counted = held.select("node", "v", "cell").mapInArrow(task, "query long, edge long, links long")
    links = np.zeros((len(queries), len(edges) + 1))
    for r in counted.groupBy("query", "edge").agg(F.sum("links").alias("links")).collect():  # QUERIES * 8 rows at most
        links[r["query"], r["edge"]] = r["links"]
    if links.sum() < LEAST_LINKS and total > QUERIES:
        return exact
    reached = np.cumsum(links, axis=1)[:, :-1]
    linked = links.sum(1) > 0
    if not linked.any():
        return float(edges[0])
    share = np.minimum(reached[linked].sum(0) / links.sum(), (reached[linked] / links[linked].sum(1, keepdims=True)).mean(0))
    enough = np.nonzero(share >= recall)[0]
    return float(edges[enough[0]]) if len(enough) else exact


# --- search --------------------------------------------------------------------------------

def visitors(held: DataFrame, grid: Grid, kind: str, bound: float) -> DataFrame:
    """(cell, node): the cells that each node visits; its own one, and higher ones."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(grid.halves[1].book)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                own, copies, data = part.column("cell").to_numpy(), part.column("copies"), part.column("v")
                first, second = grid.bounds(unit(data.to_pylist(), kind, grid.size), own)
                rows, cells = [], []
                for i in range(len(own)):
                    for a, b in visits(first[i], second[i], bound + DOUBT):
                        if a * n + b >= own[i]:
                            rows.append(i)
                            cells.append(a * n + b)
                rows, cells = np.array(rows, np.int64), np.array(cells, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells), part.column("node").take(pa.array(rows)), copies.take(pa.array(rows)), pa.array(cells == own[rows]), data.take(pa.array(rows))],
                    ["cell", "node", "copies", "own", "v"],
                )

    return held.select("node", "copies", "v", "cell").mapInArrow(task, "cell long, node binary, copies long, own boolean, v binary")


def exact_cosine(x: np.ndarray, y: np.ndarray) -> float:
    dot, xx, yy = (math.fsum((a * b).tolist()) for a, b in ((x, y), (x, x), (y, y)))
    return dot / math.sqrt(xx * yy)


class Forest:
    """A spanning forest that grows by one vector's links at a time."""

    def __init__(self, n: int):
        self.tree, self.edges = np.arange(n), []

    def link(self, one: int, others: np.ndarray) -> None:
        trees = self.tree[others]
        new = trees != self.tree[one]
        if not new.any():
            return
        joined, first = np.unique(trees[new], return_index=True)
        self.edges += [(one, int(j)) for j in others[new][first]]
        self.tree[np.isin(self.tree, joined)] = self.tree[one]


def search(members: dict, visiting: dict, similarity: float) -> tuple[list[tuple], list[tuple]]:
    """Edges of a spanning forest between visitors and members, and numbers of links by node."""
    names = sorted({*members["node"], *visiting["node"]})
    number = {name: i for i, name in enumerate(names)}
    m, v = (np.array([number[x] for x in side["node"]], np.int64) for side in (members, visiting))
    links, forest = np.zeros(len(names), np.int64), Forest(len(names))
    for at in range(0, len(v), VISITORS):
        part = slice(at, at + VISITORS)
        cosines = visiting["v"][part] @ members["v"].T
        hit = cosines >= similarity
        for i, j in zip(*np.nonzero(np.abs(cosines - similarity) < DOUBT), strict=True):
            hit[i, j] = exact_cosine(visiting["v"][at + i], members["v"][j]) >= similarity
        own = visiting["own"][part][:, None]
        hit &= ~own | (m > v[part][:, None])  # within a cell each pair once
        np.add.at(links, v[part], hit @ members["copies"])
        np.add.at(links, m, visiting["copies"][part] @ hit)
        for i in np.nonzero(hit.any(1))[0]:
            forest.link(int(v[at + i]), m[hit[i]])
    return [(names[a], names[b]) for a, b in forest.edges], [(names[i], int(links[i])) for i in np.nonzero(links)[0]]


def links(members: DataFrame, visiting: DataFrame, kind: str, similarity: float) -> DataFrame:
    """(a, b, k): forest edges with null k, and numbers of links k of node a with null b."""
    key = ["size", "cell"]
    counts = members.groupBy(*key).agg(F.count(F.lit(1)).alias("members"))
    counts = counts.join(visiting.groupBy(*key).agg(F.count(F.lit(1)).alias("visitors")), key)
    counts = stage(counts.filter("members > 1 or visitors > 1"), "cell-counts")  # elsewhere a vector meets itself alone
    counts = small(counts, counts.count() * ROW_BYTES)

    def blocks(n: str):
        return F.ceil(F.col(n) / BLOCK).cast("int")

    def dealt(rows: DataFrame, side: int, mine: str, others: str) -> DataFrame:
        block, other = F.pmod(F.xxhash64("node"), blocks(mine)).cast("int"), F.explode(F.sequence(F.lit(0), blocks(others) - 1))
        joined = rows.join(counts, key).select(*key, "node", "copies", "own", "v", block.alias("mine"), other.alias("other"))
        at = ("mine", "other") if side == 0 else ("other", "mine")
        return joined.select(*key, F.col(at[0]).alias("m"), F.col(at[1]).alias("n"), F.lit(side).alias("side"), "node", "copies", "own", "v")

    def task(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        size, side = cell.column("size")[0].as_py(), cell.column("side").to_numpy()
        sides = []
        for s in (0, 1):
            rows = cell.filter(pa.array(side == s))
            if not rows.num_rows:
                return empty
            sides.append(
                {
                    "node": rows.column("node").to_pylist(),
                    "copies": rows.column("copies").to_numpy(),
                    "own": rows.column("own").to_numpy(),
                    "v": unit(rows.column("v").to_pylist(), kind, size),
                }
            )
        edges, counted = search(*sides, similarity)
        a, b = [x for x, _ in edges] + [x for x, _ in counted], [x for _, x in edges] + [None] * len(counted)
        k = [None] * len(edges) + [x for _, x in counted]
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(k, pa.int64())], names=["a", "b", "k"])

    empty = pa.table([pa.array([], x) for x in (pa.binary(), pa.binary(), pa.int64())], names=["a", "b", "k"])
    both = dealt(members, 0, "members", "visitors").union(dealt(visiting, 1, "visitors", "members"))
    return both.groupBy(*key, "m", "n").applyInArrow(task, "a binary, b binary, k long")


def link_vectors(vectors: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; see the module."""
    rows, kind = packed(vectors)
    rows = stage(rows, "vector-rows")
    nodes = rows.filter("node is not null").groupBy("node", "size").agg(
        F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"), F.first("v").alias("v")
    )
    nodes = stage(nodes, "vector-nodes")
    sizes = nodes.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").first()
    if sizes is None:
        alone = F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
        return rows.select("vec_id", *alone)
    held, grid = indexed(nodes, kind, sizes["size"], sizes["n"])
    bound = stopping_bound(held, grid, kind, sizes["n"], similarity, recall)
    columns = ["size", "cell", "node", "copies", "own", "v"]
    one_cell = nodes.filter(F.col("size") != sizes["size"]).withColumns({"cell": F.lit(0).cast("long"), "own": F.lit(True)}).select(*columns)
    members = held.withColumn("own", F.lit(True)).select(*columns).union(one_cell)
    visiting = stage(visitors(held, grid, kind, bound).withColumn("size", F.lit(sizes["size"])).select(*columns).union(one_cell), "vector-visitors")
    found = stage(links(members, visiting, kind, similarity), "vector-links")

    counted = found.filter("k is not null").groupBy("a").agg(F.sum("k").alias("k"))
    roots = stage(components(found.filter("b is not null").select("a", "b")), "vector-roots")
    classes = nodes.select("node", "copies", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = stage(classes.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")
    told = classes.join(small(ids, ids.count() * ROW_BYTES), "root").join(counted.withColumnRenamed("a", "node"), "node", "left")
    told = stage(told.select("node", (F.col("copies") - 1 + F.coalesce("k", F.lit(0))).alias("n_links"), "component_id"), "node-classes")
    result = rows.select("vec_id", "node").join(small(told, told.count() * ROW_BYTES), "node", "left")
    own = F.col("node").isNull()
    component = F.when(own, F.col("vec_id")).otherwise(F.col("component_id"))
    return result.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
