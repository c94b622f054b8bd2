"""Decontamination, n-gram join and line dedup against brute force."""

import random
import time

from pyspark.sql import functions as F
import pytest

from jobfleet.llm import decontaminate, line_dedup, ngram_join, pii, quality
from jobfleet.llm.components import components
from llm.rows import DOCS, ODD
from llm import models


def edited(rng, words, edits):
    words = words[:]
    for _ in range(edits):
        i, kind = rng.randrange(len(words)), rng.random()
        if kind < 0.5:
            words[i] = f"z{rng.randrange(99)}"
        elif kind < 0.75 and len(words) > 1:
            del words[i]
        else:
            words.insert(i, f"y{rng.randrange(9)}")
    return words


def families(seed, sizes=(1, 2, 3, 5, 9, 12, 40, 90), members=25):
    rng, rows = random.Random(seed), []
    for size in sizes:
        stem = [f"w{rng.randrange(50)}" for _ in range(size)]
        for _ in range(members):
            rows.append((len(rows), " ".join(edited(rng, stem, rng.choice([0, 0, 1, 1, 2, 4])))))
    return rows


def test_contamination_equals_brute_force(spark):
    rng = random.Random(1)
    word = lambda: rng.choice("abcdef") + rng.choice(["", "É", "1"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 2, 3, 12, 13, 14, 30, 30])]
    items += [(8, None), (9, "--- !!"), (None, items[6][1]), (7, items[7][1]), (10, "same " * 20)]
    docs = [(i, " ".join(word() for _ in range(rng.randrange(80)))) for i in range(30)]
    docs += [(30 + k, f"Intro {items[k % 8][1].upper()}; x {items[6][1]} end") for k in range(8)]
    docs += [(50, "same " * 40), (51, "b" * 50_000), *ODD[:4], docs[3], docs[3]]
    frame = spark.createDataFrame(docs, DOCS).withColumns({"n_words": F.lit("clash"), "window_id": F.lit(1)})
    got = decontaminate.decontaminate(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert got.columns[:3] == ["doc_id", "text", "window_id"]
    rows = [tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()]
    assert sorted(rows, key=repr) == sorted(models.contamination(docs, items), key=repr)


def test_contamination_of_and_by_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in decontaminate.decontaminate(docs, items).collect()] == [False]
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.decontaminate(docs.limit(0), some).count() == 0


def test_many_blocks_of_windows_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 600)
    items = [(i, " ".join(f"{'abcdefgh'[i]}{k}" for k in range(15))) for i in range(6)]
    docs = [(i, f"x {items[i][1]} y") for i in range(6)] + [(9, "nothing here")]
    got = decontaminate.decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    rows = [tuple(r) for r in got.drop("text").collect()]
    assert sorted(rows) == sorted(models.contamination(docs, items))


@pytest.mark.parametrize(("measure", "block"), [((3, 9, 10), 1 << 20), ((3, 9, 10), 400), ((5, 4, 5), 900)])
def test_join_equals_all_pairs(spark, monkeypatch, measure, block):
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", block)
    rows = [*families(block), *ODD[:3], (901_000, "A b"), (901_001, "a B"), (None, "a  b"), (3, "w1 other"), (3, "w1 other")]
    frame = spark.createDataFrame(rows, DOCS).withColumn("node", F.lit("clash"))
    got = ngram_join.classify(frame, ngram_join.Measure(*measure)).drop("row_key", "stays").collect()
    want = [(d, n, d if n == 0 else c, k) for d, n, c, k in models.linked(rows, *measure)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_one_of_each_component_stays(spark):
    rows = families(5, sizes=(9, 40)) + ODD[:3] + [(77_000, "q r s t")] * 2
    kept = ngram_join.keep_one(spark.createDataFrame(rows, DOCS).withColumn("_tag", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "_tag"]
    told = models.linked(rows, 3, 9, 10)
    want = sorted({c for _, n, c, _ in told if n} | {d for d, n, _, _ in told if not n})
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_join_of_nothing(spark):
    assert ngram_join.classify(spark.createDataFrame([], DOCS)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.node, r.root) for r in found} == {(i, 0) for i in range(41)} | {(100 + i, 100) for i in range(60)}
    assert len(found) == 101


def test_line_dedup_equals_brute_force(spark):
    rng, rows = random.Random(7), []
    for doc_id in range(40):
        lines = []
        for _ in range(rng.randrange(6)):
            stem = [f"w{i % 5}" for i in range(rng.choice([4, 5, 11, 12, 13, 14]))]
            lines.append(" ".join(edited(rng, stem, rng.randrange(3))))
        rows.append((doc_id, "\n".join(lines)))
    rows += [*ODD[:3], (None, "W0 w1 w2  w3 w4"), (950, "t " * 30_000)]
    frame = spark.createDataFrame(rows, DOCS).withColumns({"line_no": F.lit("clash"), "n_lines": F.lit(0)})
    got = line_dedup.dedup(frame)
    assert set(got.columns) == {"doc_id", "text", "line_no", "n_lines", "n_dropped"}
    want = models.deduplicated(rows, line_dedup.EXACT_WORDS, line_dedup.NEAR_WORDS)
    assert {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in got.collect()} == want


def test_line_dedup_judges_repeated_rows_alike_and_takes_no_rows(spark):
    row = (1, "one two three four five\none two three four five")
    got = line_dedup.dedup(spark.createDataFrame([row, row], DOCS)).collect()
    assert [(r.text, r.n_dropped) for r in got] == [("one two three four five", 1)] * 2
    assert line_dedup.dedup(spark.createDataFrame([], DOCS)).count() == 0


# --- private names and long texts -----------------------------------------------------------

PRIVATE = ("names", "row", "row_key", "token", "at", "m", "votes", "found", "dropped", "place", "line_no", "keys", "repeated", "candidates", "_row_key", "_found", "_m")


def test_no_column_of_the_caller_gets_lost(spark):
    rows = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (2, None), (3, "")]
    frame = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(f"my {c}") for c in PRIVATE})
    items = spark.createDataFrame([(5, rows[0][1])], "item_id long, text string")
    results = [
        decontaminate.decontaminate(frame, items), line_dedup.dedup(frame), ngram_join.keep_one(frame), quality.judge(frame),
        pii.find(frame, pii.train(frame)),
    ]
    for out in results:
        assert out.columns[: len(frame.columns)] == frame.columns
        got = out.collect()
        assert len(got) == 3 and all(r[c] == f"my {c}" for r in got for c in PRIVATE)


def test_long_texts_take_steps_in_proportion(spark):
    """A text of 200,000 words with an item in it, and two near lines of 50,000 words."""
    item = " ".join(f"i{k}" for k in range(20))
    words = [f"w{k % 977}" for k in range(200_000)]
    docs = spark.createDataFrame([(1, " ".join([*words[:150_000], item, *words[150_000:]])), (2, " ".join(words))], DOCS)
    began = time.time()
    hit = {r.doc_id: r.n_hit for r in decontaminate.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert hit == {1: 20, 2: 0} and time.time() - began < 60
    line = [f"x{k * k % 9973}" for k in range(50_000)]
    lines = [" ".join(line), "a b c", " ".join([*line[:30_000], "new", *line[30_001:]]), " ".join(line[:-1]), " ".join([*line[:5], *line[7:]])]
    began = time.time()
    (left,) = line_dedup.dedup(spark.createDataFrame([(1, "\n".join(lines))], DOCS)).collect()
    assert left.text.split("\n") == [lines[0], lines[1], lines[4]] and time.time() - began < 60


def test_lines_are_words_between_single_blanks_and_never_cut_into_arrays(spark):
    text = "\x0bOne  two\tthree \r four\x0c\x0bfive\x20\n a b c d \n\n\t\nA b c d E\x1cf g h\r"
    rows = [(1, text), (2, None), (3, ""), (4, "v w x y z\nv w x y")]
    lines = line_dedup.lines_of(spark.createDataFrame(rows, DOCS))
    got = sorted((r.place.doc_id, r.line_no, r.line, r.n) for r in lines.collect())
    assert got == [(1, 0, "one two three four five", 5), (1, 4, "a b c d e\x1cf g h", 6), (4, 0, "v w x y z", 5)]
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan
