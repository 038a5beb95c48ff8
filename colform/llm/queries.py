"""Thin queries of the text operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline

from . import idfile, langid, mixing, ngram_join, piece_bpe, quality, sketch, suffix_dedup, topk, toxicity
from .shared import Workspace, read_table


def tokenizer_file(name: str) -> str:
    """Path of a public vocabulary file, installed on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op2_ngram_jaccard_join(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.near_duplicates(docs, width=4, percent=85)


def op3_suffix_dedup(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.digest(suffix_dedup.dedup(docs))


def op4_toxicity(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.score_documents(docs, read_table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_spans")


def op9_quality(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality.score_documents(docs, read_table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_exact_top_k(spark, sf_dir):
    return topk.top_k(read_table(spark, sf_dir, "embeddings"))


def op6_document_fingerprints(spark, sf_dir):
    return sketch.fingerprints(read_table(spark, sf_dir, "documents"))


def op8_mix_sources(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count().alias("size"))
    # Sizes are written once, so that the texts are read once.
    return mixing.mix(Workspace(spark, "mix").put(docs, "sizes"))


def op7_id_files(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    work = Workspace(spark, "idfile")
    idfile.write(docs, tokenizer_file("byte_bpe_50k.json"), work.path("file"), work)
    return idfile.digest(idfile.read(spark, work.path("file")))


def op10_sentencepiece(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_bpe.encode_documents(docs, tokenizer_file("piece_bpe_32k.model")).drop("text")


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_toxicity": op4_toxicity,
    "op9_quality": op9_quality,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_document_fingerprints": op6_document_fingerprints,
    "op7_id_files": op7_id_files,
    "op8_mix_sources": op8_mix_sources,
    "op10_sentencepiece": op10_sentencepiece,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op5_exact_top_k": """
        WITH v AS (
            SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.row <> c.row
        ), r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
}
