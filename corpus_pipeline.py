"""Corpus pipeline: language identification, near duplicates, substring deduplication, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next stage's docs. All but
the last return the columns of ``documents``. Each begins by letting go of what the one before still holds on the executors. A stage's decisions take effect: rejected documents go, of near
duplicates the one of the smallest doc_id stays, repeated bytes are cut out, the mix repeats or shortens documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colform.llm import langid, mixing, ngram_join, piece_bpe, suffix_dedup
from colform.llm.shared import Workspace, read_table, release

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Language scores below this are too unsure to keep a document.
UNSURE = 0.3

#: No stage but the mix can be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those of no clear language, go."""
    release(spark)
    found = langid.identify(docs.select(*COLUMNS))
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= UNSURE)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 5-word shingles at a similarity of 0.8 the smallest doc_id stays; texts without words stay.

    Rows that repeat both doc_id and text count once; rows of one doc_id and different texts stay or go together.
    """
    release(spark)
    docs = docs.select(*COLUMNS)
    work = Workspace(spark, "stage2")
    found = work.put(ngram_join.near_duplicates(docs, work=work), "found")
    kept = work.put(found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("doc_id").alias("kept")).count(), "kept")
    staying = docs.join(kept.select("kept"), F.col("doc_id").eqNullSafe(F.col("kept")), "left_semi")
    repeated = kept.where("count > 1").limit(1).count()
    return staying.dropDuplicates(["doc_id", "text"]) if repeated else staying


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 100-byte strings that occur earlier are cut out, split characters with them; a document of which nothing is left goes."""
    release(spark)
    found = suffix_dedup.dedup(docs.select(*COLUMNS), as_text=True)
    left = found.where((F.col("n_removed") == 0) | (F.char_length("kept_text") > 0))
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    n_chars = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.char_length("kept_text").cast("long"))
    return left.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document; the last may be its first words only, joined by spaces."""
    release(spark)
    mixed = mixing.mix(docs.select(*COLUMNS, mixing.word_count().alias("size"))).where("taken > 0")
    times = mixed.withColumn("time", F.explode(F.expr("sequence(1, cast(ceil(taken / size) as int))"))).withColumn("words", F.expr("least(size, taken - (time - 1) * size)"))
    first_words = F.expr(r"array_join(slice(filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> ''), 1, cast(words as int)), ' ')")
    text = F.when(F.col("words") == F.col("size"), F.col("text")).otherwise(first_words)
    cut = times.withColumn("part", text)
    n_chars = F.when(F.col("words") == F.col("size"), F.col("n_chars")).otherwise(F.char_length("part").cast("long"))
    return cut.select("doc_id", F.col("part").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids of every row that the mix made."""
    release(spark)
    import public_tokenizers

    return piece_bpe.encode_documents(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model")).drop("text")


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the whole of ``documents``, each written into the shared folder and reread."""
    work = Workspace(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.put(stage(spark, docs, sf_dir), name)
    return docs
