"""The registered queries on the smallest tables: SQL where there is some, brute force or shape elsewhere."""

import pytest
import sentencepiece

import __spark_entry__ as entry_point
from compare import connect, difference
import corpus_pipeline
from jobfleet.llm import line_dedup, ngram_join, oracle, queries, quality
from pyspark.sql import functions as F
from llm import models


def test_every_operator_has_one_query():
    names = [n for n in entry_point.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in sorted(names, key=lambda n: int(n[2:].split("_")[0]))] == list(range(1, 14))
    assert "pipeline" in entry_point.queries() and oracle.oracle_sql().keys() <= queries.queries().keys()


@pytest.mark.parametrize("name", oracle.oracle_sql())
def test_query_equals_sql(spark, sf_dir, name):
    assert difference(queries.queries()[name](spark, sf_dir), connect(sf_dir), oracle.oracle_sql()[name]) is None


def test_ngram_join_query_equals_all_pairs(spark, sf_dir, texts):
    rows = queries.op2_ngram_join(spark, sf_dir).collect()
    want = [(d, n, d if n == 0 else c, k) for d, n, c, k in models.linked(texts, 3, 9, 10)]
    assert sorted(map(tuple, rows)) == sorted(want)


@pytest.mark.parametrize("name", [n for n in queries.queries() if n not in oracle.oracle_sql()])
def test_query_returns_every_row(spark, sf_dir, name):
    rows = queries.queries()[name](spark, sf_dir)
    table = "pages" if name.startswith("op8") else "documents"
    assert rows.count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    assert rows.columns[0] == ("page_id" if table == "pages" else "doc_id")


def clashing(docs):
    return docs.withColumns({"kept": F.lit("mine"), "row_key": F.lit(1), "n_words": F.lit("x"), "_row_key": F.lit(2)})


def test_stages_do_what_brute_force_does(spark, sf_dir, texts):
    docs = clashing(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = texts
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "sentencepiece":
            assert out.columns == docs.columns
        result = out.cache()
        got = result.collect()
        ids = sorted(r.doc_id for r in got)
        if name == "quality_rules":
            kept = {r.doc_id for r in quality.judge(docs).filter("kept").collect()}
            assert ids == sorted(kept) and all(models.quality_base(r.text)[0] >= 10 for r in got)
            assert {r.kept for r in got} == {"mine"}
        elif name == "line_dedup":
            want = models.deduplicated(rows, line_dedup.EXACT_WORDS, line_dedup.NEAR_WORDS)
            want = {d: t for d, (t, _, n) in want.items() if not n or models.WORD.search(t)}
            assert {r.doc_id: r.text for r in got} == want
        elif name == "ngram_join":
            assert ids == sorted({c for _, n, c, _ in models.linked(rows, 5, 4, 5)})
        elif name == "decontamination":
            assert ids == sorted(r[0] for r in models.contamination(rows, items) if not r[5])
        else:
            assert ids == sorted(d for d, _ in rows) and all(len(r.ids) == r.n_ids for r in got)
        if name != "sentencepiece":
            docs, rows = result, [(r.doc_id, r.text) for r in got]
    assert ngram_join.Measure(5, 4, 5).needed(10) == 8


def test_last_stage_equals_the_library(spark, sf_dir, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.MODEL)
    odd = [(-1, None), (-2, ""), (-3, " two  spaces "), (-4, "▁ a mark, é ① \x00 ɵ"), (-5, "two\nlines\n")]
    docs = spark.createDataFrame(texts + odd, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    got = {r.doc_id: r for r in corpus_pipeline.encode(spark, docs, sf_dir).collect()}
    assert got.keys() == {d for d, _ in texts + odd}
    for doc_id, text in texts + odd:
        ids = library.encode(text or "")
        assert got[doc_id].ids == ids and got[doc_id].n_ids == len(ids)
        assert got[doc_id].decoded == library.decode(ids) == (text or "").replace("▁", " ")


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_take_odd_rows_and_none(spark, sf_dir, name, stage):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "a b " * 40_000, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert stage(spark, docs, sf_dir).count() <= 4
    assert stage(spark, docs.limit(0), sf_dir).count() == 0
