"""Queries on corpora of files: scan of a folder, reuse of stored analyses, small text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import text
from riskloom.plans import roles
from riskloom.plans.registry import query
from riskloom.session import shared_dir
from riskloom.sources import files, store
from riskloom.sources.tables import table

PART_ROWS, PART_BYTES = 2_000, 1 << 29  # of a part at most: far below the 2 GB that one value can hold


@query(
    "corpus_scan",
    """WITH written AS (SELECT source, coalesce(lang = 'fr', false) AS latin, count(*) AS docs, sum(len(string_split(text, chr(10)))) AS lines,
        sum(length(text) + 1) AS chars, bool_or(regexp_matches(text, '[^\\x00-\\x7F]')) AS odd
      FROM documents GROUP BY ALL)
    SELECT 'source=' || source AS category, 'other' AS language, count(*) AS files,
      count(*) FILTER (NOT (latin AND odd)) AS valid_files,
      coalesce(sum(lines) FILTER (NOT latin), 0)::BIGINT AS text_lines, coalesce(sum(chars) FILTER (NOT latin), 0)::BIGINT AS text_chars
    FROM written GROUP BY 1""",
)
def corpus_scan(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of files read back: relative paths, labels from the layout, files that are no UTF-8 kept without text.

    The documents are written out first, one file per source; French ones in a second tree with one byte a letter, those without
    a language with the rest. A file is a folder of parts, however large the source is: at most ``PART_ROWS``
    documents each, and so many that the longest ones together keep below ``PART_BYTES``. It is valid when all its parts are.
    """
    root = shared_dir(spark, "corpus")
    docs = table(spark, folder, "documents").select("source", "lang", F.col("text").alias("value"))
    longest = docs.agg(F.max(F.octet_length("value")).alias("n")).first()["n"] or 1
    rows = max(1, min(PART_ROWS, PART_BYTES // longest))
    docs.where("not (lang <=> 'fr')").select("source", "value").write.partitionBy("source").option(
        "maxRecordsPerFile", rows
    ).text(f"{root}/plain")
    french = docs.where("lang = 'fr'").select("source", F.regexp_replace("value", "\n", " ").alias("value"))
    french.write.partitionBy("source").options(encoding="ISO-8859-1", quote="", maxRecordsPerFile=rows).csv(f"{root}/latin")
    # part files of either writer, whatever their suffix
    found = files.read_corpus(spark, root, "part-*")
    labelled = found.select(
        "valid", "text", F.col("path").startswith("plain/").alias("plain"), files.category_of(F.col("path")).alias("category"),
        files.language_of(F.col("path")).alias("language"),
    )
    whole = labelled.groupBy("category", "language", "plain").agg(
        F.bool_and("valid").alias("valid"),
        F.sum(F.when(F.col("plain"), F.size(F.split("text", "\n")) - 1)).alias("lines"),
        F.sum(F.when(F.col("plain"), F.char_length("text"))).alias("chars"),
    )
    return whole.groupBy("category", "language").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if("valid").alias("valid_files"),
        F.coalesce(F.sum("lines"), F.lit(0)).cast("bigint").alias("text_lines"),
        F.coalesce(F.sum("chars"), F.lit(0)).cast("bigint").alias("text_chars"),
    )


@query(
    "analysis_reuse",
    """SELECT doc_id, length(text)::BIGINT AS size, (SELECT count(DISTINCT text) FROM documents) AS stored_first,
      0::BIGINT AS stored_again FROM documents""",
)
def analysis_reuse(spark: SparkSession, folder: str) -> DataFrame:
    """Results of a second run over the same files, with how many contents each run had to analyse."""
    path, schema = shared_dir(spark, "analyses"), "content_key STRING, size BIGINT"
    contents = roles.files(spark, folder).select("doc_id", "text")

    def analyse(fresh: DataFrame) -> DataFrame:
        return fresh.select("content_key", F.char_length("text").cast("bigint").alias("size"))

    store.analysed(contents, "doc_id", "text", path, schema, analyse)
    first = spark.read.schema(schema).parquet(path).count()
    again = store.analysed(contents, "doc_id", "text", path, schema, analyse)
    more = spark.read.schema(schema).parquet(path).count() - first
    return again.select(
        "doc_id", "size", F.lit(first).cast("bigint").alias("stored_first"), F.lit(more).cast("bigint").alias("stored_again")
    )


@query(
    "text_small",
    """SELECT c_custkey, c_name AS trimmed, strftime(make_timestamp(c_custkey * 86400000000), '%Y-%m-%dT%H:%M:%S') AS moment
    FROM customer""",
)
def text_small(spark: SparkSession, folder: str) -> DataFrame:
    """Trimmed strings and UTC moments."""
    padded = F.concat(F.lit("\t\n "), F.col("c_name"), F.lit("  \r\n"))
    moment = text.utc_iso(F.timestamp_seconds(F.col("c_custkey") * 86_400))
    return table(spark, folder, "customer").select(
        "c_custkey", text.stripped(padded).alias("trimmed"), F.substring(moment, 1, 19).alias("moment")
    )
