"""From raw documents to packed training sequences: five stages, each a method of ``riskloom.llm`` over all its input.

Every stage takes ``(spark, docs, sf_dir)``; its result is written and read back as the next stage's ``docs``. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import language, line_dedup, mixing, ngram_join, packing
from riskloom.llm.common import configure, documents, stored
from riskloom.llm.tokens import tokenizer_path

MIXTURE = mixing.Target(evenness=0.95, repetitions=2.0)
LEAST_SCORE = 0.5  # a document of one language has nearly all its letters in it


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents written in a known language: no letters at all, or no language with half of them, is a rejection."""
    configure(spark)
    model = language.fit(docs.where(~language.held_out()))
    judged = language.predict(docs, model)
    return judged.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand elsewhere before; a document made of such lines only goes."""
    configure(spark)
    return line_dedup.without_repeats(docs, length_column="n_chars" if "n_chars" in docs.columns else None)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of smallest id, of each group linked by five-word shingles at a similarity of 0.8.

    Rows go by a key of id and text, so rows without an id and several texts of one id take part on their own, and of equal
    rows one stays. An id comes before none.
    """
    configure(spark)
    rows = docs.select("doc_id", line_dedup.document_key().alias("row"), "text")
    classes = ngram_join.jaccard_classes(rows.select(F.col("row").alias("doc_id"), "text"), 5, ngram_join.Likeness(80))
    classes = classes.select(F.col("doc_id").alias("row"), "component_id").distinct()
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    least = rows.select("doc_id", "row").distinct().join(classes, "row").groupBy("component_id").agg(F.min(order).alias("least"))
    kept = stored(least.select(F.col("least.row").alias("_row")), "kept")
    # equal rows are merged before they are dealt out
    single = docs.withColumn("_row", line_dedup.document_key()).dropDuplicates(["_row"])
    return single.join(kept, "_row", "left_semi").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources up to twice."""
    configure(spark)
    return mixing.mixed_documents(docs, MIXTURE, seed=5)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most 2048 tokens."""
    configure(spark)
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), end_id=0, capacity=2048)


STAGES = [
    ("language", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
# A tokenizer, a fitted model and keyed hashes: not for SQL. tests/llm/test_filters.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
