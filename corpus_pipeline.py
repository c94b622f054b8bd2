"""A corpus pipeline over ``documents``: five stages, each taking all that the one before kept.

All stages but the last return the columns of their input:

1. quality rules: documents that the weakly supervised rules reject go;
2. line dedup: lines that occur earlier (or within one word of an earlier line) are taken out of
   the text; a document with nothing left of its words goes, as its text stands in others;
3. n-gram Jaccard join: of each group of near copies the first document by doc_id stays. Sets are
   of five words with a similarity of 0.8, as for every near-duplicate stage on word shingles;
4. benchmark decontamination: contaminated documents go;
5. SentencePiece encoding and decoding: every document with its ids and the text that these decode to.
"""

from collections.abc import Callable
from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobfleet.llm import decontaminate, line_dedup, ngram_join, quality, sp_codec
from jobfleet.llm.common import scratch

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def packed(docs: DataFrame) -> DataFrame:
    """The two columns that operators work on, and the whole row out of the way of theirs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.judge(packed(docs)).filter("kept").select("_row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = F.col("text").rlike(r"[^\x20\x09-\x0D]") | (F.col("n_dropped") == 0)
    kept = line_dedup.dedup(packed(docs)).filter(left)
    return kept.select(*[F.col("text") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(packed(docs), ngram_join.Measure(shingle=5, numerator=4, denominator=5)).select("_row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(packed(docs), items).filter("not contaminated").select("_row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = sp_codec.encode(docs.select("doc_id", "lang", "source", "text"), MODEL, decoded="decoded")
    return encoded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_ids"), "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]
#: SQL cannot express the stages; ``tests/llm/test_queries.py`` holds each against brute force or the library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of ``sf_dir``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch(spark, f"pipeline-{uuid4().hex}")
    for number, (name, stage) in enumerate(STAGES, 1):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
