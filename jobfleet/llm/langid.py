"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text becomes lower-case code points in which every run of other characters than letters is one
gap; its n-grams of one to ``ORDERS`` code points are hashed into ``BUCKETS``. Training counts
buckets per language, each task adding up its own documents first; the matrix of log-probabilities
has at most ``BUCKETS`` x languages entries (buckets are halved until it fits ``MATRIX_BYTES``) and is broadcast.
Scoring gathers the matrix's rows of a text's buckets and adds them.

The model is fitted on a bounded sample: per language about ``ROWS_PER_LANGUAGE`` labelled rows,
taken by a hash of doc_id, with their whole texts. A document is held out, and never learnt from,
when crc32(doc_id as text) mod 5 is 0 or doc_id is null.

Defined results: null text and text without a letter give ``und`` with score 0, and so does every
text when nothing could be learnt; ties go to the alphabetically first language; texts are
read whole; repeated rows are scored each; an empty table gives an empty result; all columns are
kept, and columns named like the results are replaced.
"""

from collections.abc import Iterator
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
ORDERS = 3
ROWS_PER_LANGUAGE = 5_000
MATRIX_BYTES = 32 << 20
SMOOTHING = 0.5
UNKNOWN = "und"
BLOCK = 1 << 18  # code points handled at once
_GAPS = re.compile(r"[\W\d_]+")


def buckets(text: str, count: int, orders: int = ORDERS) -> Iterator[np.ndarray]:
    """Hashed n-grams of a text, block by block."""
    letters = f" {_GAPS.sub(' ', text.lower())} "
    for start in range(0, len(letters), BLOCK):
        piece = letters[start : start + BLOCK + orders - 1]
        codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        gram = np.zeros(len(codes), np.uint32)
        for n in range(orders):
            gram = (gram[: len(codes) - n] * np.uint32(0x9E3779B1)) + codes[n:] + np.uint32(n + 1)
            if len(gram):
                mixed = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x85EBCA6B)
                yield ((mixed ^ (mixed >> np.uint32(13))) & np.uint32(count - 1))[:BLOCK].astype(np.int64)


def has_letter(text: str | None) -> bool:
    return text is not None and _GAPS.sub("", text) != ""


def labelled(documents: DataFrame) -> DataFrame:
    """The rows that may be learnt from."""
    remainder = F.crc32(F.col("doc_id").cast("string")) % 5
    return documents.filter("lang is not null and text is not null").filter(remainder != 0)


def fit(documents: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log priors and the matrix of log-probabilities (bucket, language)."""
    usable = labelled(documents.select("doc_id", "text", "lang"))
    totals = dict(sorted((r["lang"], r["count"]) for r in usable.groupBy("lang").count().collect()))  # one row per language
    if not totals:
        return [], np.zeros(0), np.zeros((1, 0), np.float32)
    languages, count = list(totals), BUCKETS
    while count * len(languages) * 4 > MATRIX_BYTES and count > 1024:
        count //= 2
    scale = 1 << 20
    share = F.create_map(*[F.lit(x) for k, n in totals.items() for x in (k, int(scale * min(1.0, rows_per_language / n)))])
    sample = usable.filter(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(scale)) < share[F.col("lang")]).select("lang", "text")
    place = {k: i for i, k in enumerate(languages)}

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(place), count), np.int64)
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                for grams in buckets(text, count):
                    sums[place[lang]] += np.bincount(grams, minlength=count)
        lang_no, bucket = np.nonzero(sums)
        yield pd.DataFrame({"lang_no": lang_no, "bucket": bucket, "n": sums[lang_no, bucket]})

    tasks = 16  # a bounded sample needs no more
    rows = (
        sample.repartition(tasks)
        .mapInPandas(counted, "lang_no long, bucket long, n long")
        .groupBy("lang_no", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()  # at most buckets x languages rows
    )
    matrix = np.full((count, len(languages)), SMOOTHING)
    matrix[rows["bucket"], rows["lang_no"]] += rows["n"]
    sampled = np.array([min(rows_per_language, n) for n in totals.values()], float)
    return languages, np.log(sampled / sampled.sum()), np.log(matrix / matrix.sum(axis=0)).astype(np.float32)


class Scorer:
    def __init__(self, languages: list[str], prior: np.ndarray, matrix: np.ndarray):
        self.languages, self.prior, self.matrix = languages, prior, matrix

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        total = self.prior.astype(float)
        for grams in buckets(text, len(self.matrix)):
            total = total + self.matrix[grams].sum(axis=0, dtype=np.float64)
        chance = np.exp(total - total.max())
        best = int(np.argmax(total))
        return self.languages[best], float(chance[best] / chance.sum())


def predict(documents: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """``documents`` with held_out, lang_pred and score."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(*held.value)
        for batch in batches:
            yield pd.DataFrame([scorer.predict(t) for t in batch], columns=["lang_pred", "score"])

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    out = documents.drop("held_out", "lang_pred", "score").withColumns({"held_out": held_out, "_scored": scored("text")})
    return out.select("*", "_scored.*").drop("_scored")
