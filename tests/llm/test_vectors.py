"""Source divergence, vector codes and near vectors against brute force, with odd rows."""

from collections import Counter
import itertools
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F
import pytest

from jobfleet.llm import divergence, near_vectors, vector_codes

TERMS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
VECTORS = "vec_id long, embedding array<float>, label int"
DOCUMENTS = "doc_id long, text string, lang string, source string"


# --- source divergence ---------------------------------------------------------------------

def audited(rows, least, top):
    """The contract, said with dictionaries."""
    rows = [(t or "", g or "", s or "") for _, t, g, s in rows]
    out = []
    for lang in {g for _, g, _ in rows}:
        mine = [(Counter(TERMS.findall(t.translate(LOWER))), s) for t, g, s in rows if g == lang]
        docs = Counter(x for c, _ in mine for x in c)
        kept = {x for x, n in docs.items() if n >= least}

        def prices(counters):
            total = Counter()
            for c in counters:
                total.update({x: n for x, n in c.items() if x in kept})
            by = sum(total.values()) + 5 * len(kept)
            return total, {x: 1 + 10**9 * (total[x] + 5) // by for x in kept}

        whole = prices(c for c, _ in mine)[1]
        sources = {s: prices(c for c, x in mine if x == s) for s in {s for _, s in mine}}
        for s, (n, p) in sources.items():
            pairs = [(o, sum(abs(p[x] - q[x]) for x in kept)) for o, (_, q) in sources.items() if o != s]
            terms = [(x, p[x] - whole[x]) for x in kept if n[x] and p[x] > whole[x]]
            for part, found, last in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda f: (-f[1], f[0].encode()))
                out += [(lang, s, part, item, v, k) for k, (item, v) in enumerate(found[:last], 1)]
    return sorted(out)


def sourced(seed=3, n=160):
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "abcd" for b in "éxyz" for c in "mnop"]
    rows = [
        (i, " ".join(rng.choices(words, k=rng.randrange(40))) + rng.choice([" THE the", " naïve-Ärger", "9x7"]), rng.choice(["en", "de", None]), f"s{rng.choice([0, 0, 0, 1, 2, 3, 20])}")
        for i in range(n)
    ]
    return [*rows, *rows[:9], (1, None, "en", None), (None, "", "fr", "s1"), (None, "Café", "fr", "s9"), (5, "it" * 90_000, "en", "s1"), (6, "so be it " * 30_000, "en", "s2")]


@pytest.mark.parametrize("small_parts", [False, True])
def test_audit_equals_brute_force(spark, monkeypatch, small_parts):
    if small_parts:  # many blocks, tiles, pieces and flushes
        for name, value in (("BLOCK_BITS", 2), ("TILE", 2), ("HELD_TERMS", 50), ("PIECE", 100), ("GALLOP", 2), ("TERMS_A_TASK", 20)):
            monkeypatch.setattr(divergence, name, value)
    rows = sourced()
    docs = spark.createDataFrame(rows, DOCUMENTS).withColumns({c: F.lit("mine") for c in ("term", "n", "rank", "kept", "total", "block")})
    for least in (3, 10_000):
        got = sorted(tuple(r) for r in divergence.audit(docs.repartition(5), least, 7).collect())
        assert got == audited(rows, least, 7)


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], DOCUMENTS)).count() == 0


def test_gallop_is_a_search():
    rng = np.random.default_rng(0)
    for few, many in ((0, 5), (5, 0), (1, 4000), (3000, 4000), (4000, 30)):
        x, y = (np.unique(rng.integers(0, 9000, n)) for n in (few, many))
        assert (divergence.gallop(x, y) == np.searchsorted(y, x)).all()


def test_prices_are_exact_far_up():
    n, total, kept = 10**12 + 7, 9 * 10**14 + 11, 12_345_678
    assert divergence.price(n, total, kept) == 1 + 10**9 * (n + 5) // (total + 5 * kept)


def test_prices_agree_in_sql(spark):
    row = spark.range(1).select(divergence.price_column(F.lit(10**12), F.lit(9 * 10**14), F.lit(77)).alias("p")).first()
    assert row.p == divergence.price(10**12, 9 * 10**14, 77)


# --- vector codes --------------------------------------------------------------------------

def coded(rows):
    """The contract with whole arrays and Python integers."""
    usable = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    rows = [r for r in rows if usable(r[1])]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.floor(np.array([r[1] for r in rows], np.float32).astype(np.float64) * 1024).astype(np.int64)
    codes, error, books = [], np.zeros(len(x), np.int64), []
    for part in np.split(x, 4, axis=1):
        book = part[:256].copy()
        for step in range(5):
            d = ((part[:, None, :] - book[None]) ** 2).sum(2)
            own = d.argmin(1)
            if step < 4:
                for e in set(own.tolist()):
                    mine = part[own == e]
                    book[e] = [int(s) // len(mine) for s in mine.sum(0)]
        codes.append(own)
        error += d.min(1)
        books.append(book)
    sums = Counter()
    for r, e in zip(rows, error.tolist()):
        sums[r[2]] += e
    text = ["".join(f"{c[i]:02x}" for c in codes) for i in range(len(rows))]
    return [(r[0], c, e, sums[r[2]]) for r, c, e in zip(rows, text, error.tolist())], books


def clustered(n, size, seed=0, spread=0.2, centres=9):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, size))
    v = middle[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, size))
    return [(int(i), [float(x) for x in np.float32(row)], int(rng.integers(0, 3)) or None) for i, row in enumerate(v)]


ODD = [(7001, None, 1), (7002, [float("nan")] * 16, 1), (7003, [float("inf")] + [0.0] * 15, 2), (7004, [None] + [1.0] * 15, None)]


@pytest.mark.parametrize("rows", [clustered(900, 16), clustered(400, 16, spread=0)[::-1], clustered(60, 16), [(i % 5, [0.5] * 16, None) for i in range(300)]], ids=["many", "equal", "few", "one point"])
def test_codes_equal_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(vector_codes, "BLOCK_BYTES", 16 * 8 * 200)
    monkeypatch.setattr(vector_codes, "LEAF", 8)
    rows = [*rows, *ODD, *rows[:5], (None, rows[0][1], None)]
    frame = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("mine") for c in ("code", "v", "error", "_label", "label_sum")})
    found, books = vector_codes.compress(frame.repartition(3))
    want, want_books = coded(rows)
    got = [tuple(r) for r in found.select("vec_id", "code", "error", "label_error").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert all((a == b).all() for a, b in zip(books, want_books, strict=True))


def test_codes_of_nothing_and_of_other_lengths(spark):
    found, books = vector_codes.compress(spark.createDataFrame(ODD, VECTORS))
    assert found.count() == 0 and books == [] and vector_codes.books_sha256(books)
    rows = [(1, [1.0] * 6, 1), (2, [2.0] * 6, 1), (3, [1.0], 1), (4, [], 2)]
    got = {r.vec_id: (r.code, r.error, r.label_error) for r in vector_codes.compress(spark.createDataFrame(rows, VECTORS))[0].collect()}
    assert got == {1: ("00000000", 0, 0), 2: ("01010101", 0, 0), 3: (None, None, None), 4: (None, None, None)}


def test_codes_refuse_what_passes_64_bits(spark):
    with pytest.raises(Exception, match="could pass 64 bits"):
        vector_codes.compress(spark.createDataFrame([(1, [1e30] * 4, 1)], VECTORS))


def test_large_components_are_exact():
    rng = np.random.default_rng(5)
    points, entries = rng.integers(-(1 << 27), 1 << 27, (200, 9)), rng.integers(-(1 << 27), 1 << 27, (30, 9))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, e)) for e in entries] for p in points]
    assert vector_codes.squares(points, entries).tolist() == want
    tree = vector_codes.Tree(points, 4)
    codes = vector_codes.Walk(entries).assign(tree)[0]
    assert codes.tolist() == [int(np.argmin(want[i])) for i in tree.order]


# --- near vectors --------------------------------------------------------------------------

def near(rows, similarity=0.95):
    """All pairs."""
    usable = [r[1] is not None and len(r[1]) > 0 and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    root, n = list(range(len(rows))), [0] * len(rows)
    unit = [np.array(r[1], np.float64) / np.linalg.norm(np.array(r[1], np.float64)) if u else None for r, u in zip(rows, usable)]

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations([i for i, u in enumerate(usable) if u], 2):
        if len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= similarity:
            n[i], n[j] = n[i] + 1, n[j] + 1
            root[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)] = min(r[0], least.get(top(i), r[0]))
    return [(r[0], n[i], least.get(top(i)), r[0] == least.get(top(i))) for i, r in enumerate(rows)]


def planted(seed=1, size=24):
    rng = np.random.default_rng(seed)
    vectors = [rng.normal(size=size) for _ in range(250)]
    for family in range(40):
        stem = vectors[family]
        for _ in range([1, 2, 3, 60][family % 4] if family < 8 else 2):
            vectors.append(3 * stem + rng.choice([0, 0.2, 0.5, 0.8]) * rng.normal(size=size))
    rows = [(i, [float(x) for x in np.float32(v)], 1) for i, v in enumerate(vectors)]
    rng.shuffle(rows)
    rows = [(int(i), v, 1) for i, v, _ in rows]
    copies = [(5000 + i, rows[i % 3][1], 2) for i in range(40)]
    odd = [(6000, None, 1), (6001, [0.0] * size, 1), (6002, [float("nan")] * size, 1), (6003, [None] + [1.0] * (size - 1), 1), (6004, [], 1)]
    other = [(6005, [1.0, 0.0], 1), (6006, [2.0, 0.0], 1), (6007, [-0.0, 3.0], 1), (None, rows[7][1], 1), (None, [0.0, 0.0, 9.0], 1), (rows[0][0], rows[9][1], 1)]
    return rows + copies + odd + other + rows[:2]


@pytest.mark.parametrize("block", [4096, 16])
def test_links_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    monkeypatch.setattr(near_vectors, "VISITORS", 8)
    monkeypatch.setattr(near_vectors, "CELL_NODES", 4)
    rows = planted()
    frame = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("mine") for c in ("node", "cell", "kept", "n_links", "v", "size")})
    got = [tuple(r) for r in near_vectors.link_vectors(frame.repartition(3)).collect()]
    assert sorted(got, key=repr) == sorted(near(rows), key=repr)


def test_links_in_doubles_and_of_nothing(spark):
    rows = [(1, [1e200, 1e200], 1), (2, [1e-200, 1e-200], 1), (3, [1.0, 0.0], 1), (4, [0.95, math.sqrt(1 - 0.95**2)], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors.link_vectors(frame).collect()}
    assert got[1] == got[2] == (1, 1) and got[3][1] == 3
    assert near_vectors.link_vectors(frame.limit(0)).count() == 0


def test_traversal_visits_cells_in_order_of_their_bounds():
    rng = np.random.default_rng(2)
    a, b = rng.random(9), rng.random(7)
    a[3] = b[2] = 0
    cells = list(near_vectors.visits(a, b, 0.8))
    sums = [a[i] + b[j] for i, j in cells]
    assert sums == sorted(sums) and set(cells) == {(i, j) for i in range(9) for j in range(7) if a[i] + b[j] <= 0.8}


def test_exact_bound_misses_nothing_and_sampled_bound_little(spark, monkeypatch):
    """Recall against all pairs, with the bound learned from some of the vectors."""
    monkeypatch.setattr(near_vectors, "QUERIES", 60)
    monkeypatch.setattr(near_vectors, "CELL_NODES", 2)
    monkeypatch.setattr(near_vectors, "LEAST_LINKS", 5)
    rows = [r for r in planted(4) if r[0] is not None]
    got = [tuple(r) for r in near_vectors.link_vectors(spark.createDataFrame(rows, VECTORS)).collect()]
    assert sum(r[1] for r in got) >= 0.95 * sum(r[1] for r in near(rows))
    monkeypatch.setattr(near_vectors, "LEAST_LINKS", 1 << 40)  # too few links seen: the exact bound
    got = [tuple(r) for r in near_vectors.link_vectors(spark.createDataFrame(rows, VECTORS)).collect()]
    assert sorted(got, key=repr) == sorted(near(rows), key=repr)
