"""From raw documents to packed sequences: language, near copies, repeated passages, source weights, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import language, minhash, mixing, packing, substring_dedup
from quire.llm._store import settled


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told go on; the others go: null and blank texts, those without a letter, those unlike any learned language.

    Learned from text and lang of the documents. Rows that repeat a doc_id, or have none, are judged each by its own
    text; an empty table gives no rows; columns may have any names.
    """
    return language.identified(docs, language.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies goes on: the row of the smallest doc_id, null last.

    Shingles of five words, similarity of 0.8 or more. Rows that repeat a doc_id are told apart by their texts; of rows
    alike in doc_id and text one goes on. Documents without words are copies of nothing and all go on. An empty table
    gives no rows; columns may have any names.
    """
    return minhash.deduplicated(docs)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words or more that occur earlier are cut out; documents of which nothing is left go.

    Documents that lose nothing keep their text as it is, also a null or blank one. Rows that repeat a doc_id are
    documents of their own; a null doc_id comes before all others. An empty table gives no rows. The columns of
    documents go on, with n_chars counted anew; others end here.
    """
    cut = substring_dedup.remove_repeats(docs, carry=("lang", "source"))
    left = cut.filter("n_removed = 0 or n_removed < n_words")
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for; those of no copies go.

    Null and blank texts have size 0 and share their source's copies like others. Rows that repeat a doc_id have each
    their own copies; a null source is a source, the last. An empty table gives no rows; columns may have any names.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their ids and places in sequences of 2048 tokens.

    Null or empty text is the end id alone. Rows that repeat a doc_id, or have none, are packed each on its own. An
    empty table gives no rows; other columns are not looked at.
    """
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup_stage),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Language scores, signatures and tokenisers are not to be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over documents; what each keeps is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
