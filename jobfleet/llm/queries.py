"""The operators applied to the benchmark tables, each with its production parameters."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobfleet.llm import (
    decontaminate,
    divergence,
    html_text,
    langid,
    line_dedup,
    near_vectors,
    ngram_join,
    pii,
    quality,
    sp_codec,
    token_count,
    token_file,
    vector_codes,
)

#: The tokenizer files' package; any of these paths can be replaced by the user's own.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = decontaminate.decontaminate(documents, table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = ngram_join.classify(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return told.select("doc_id", "n_shingles", "component_id", "n_links")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_count.count_tokens(documents, PIECES).select("doc_id", "n_tokens")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(documents, pii.train(documents)).drop("text")

    def digest(spans: str):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    def count(kind: str):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, pii.KINDS),
        F.sha2(digest("base_spans"), 256).alias("base_sha256"),
        digest("all_spans").alias("spans"),
    )


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.round_trip(table(spark, sf_dir, "documents"), WORD_BPE, end_id=2)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    predicted = langid.predict(documents.select("doc_id", "text"), langid.fit(documents))
    return predicted.select("doc_id", "held_out", "lang_pred", "score")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "html"))
    return rendered.select("page_id", "text")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good"
    )


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sp_codec.round_trip(documents, PIECES).drop("text")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    digest = F.lit(vector_codes.books_sha256(books)).alias("codebooks_sha256")
    return coded.select("vec_id", "code", "error", "label_error", digest)


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.link_vectors(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {name: function for name, function in globals().items() if name.startswith("op")}
