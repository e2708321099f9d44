"""The corpus scan on tables that the small ones do not show: a hot source, documents without a language."""

from __future__ import annotations

import pytest

from riskloom.plans import ORACLES, QUERIES, corpus
from riskloom.sources import files
from tests.compare import connect, difference

SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture
def read_parts(monkeypatch):
    """The folders of the parts that a scan reads."""
    seen, read = [], files.read_corpus

    def reading(spark, root, pattern="*.py"):
        found = read(spark, root, pattern)
        seen.append((found, root))
        return found

    monkeypatch.setattr(files, "read_corpus", reading)
    return seen


def test_no_part_holds_a_whole_source(spark, tmp_path, monkeypatch, read_parts):
    monkeypatch.setattr(corpus, "PART_ROWS", 10)
    rows = [(i, f"line {i}\nand é {i}", ("en", "fr", "de")[i % 3], "hot" if i % 4 else "small") for i in range(300)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    tables = connect("/nowhere")
    tables.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert difference(QUERIES["corpus_scan"](spark, str(tmp_path)), tables, ORACLES["corpus_scan"]) is None
    parts = read_parts[0][0].where("path like 'plain/%'").collect()
    assert max(r.text.count("\n") for r in parts) <= 20  # two lines a document
    assert sum(r.text.count("\n") for r in parts) == 400


def test_parts_of_long_documents_have_few_rows(spark, tmp_path, monkeypatch, read_parts):
    monkeypatch.setattr(corpus, "PART_BYTES", 2_000)
    rows = [(i, "x" * (900 if i % 10 == 0 else 5), "en", "s") for i in range(40)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    QUERIES["corpus_scan"](spark, str(tmp_path)).collect()
    assert max(len(r.text) for r in read_parts[0][0].collect()) <= 2_000


def test_documents_without_a_language_are_scanned(spark, tmp_path):
    rows = [(1, "a\nb", "en", "x"), (2, "é", "fr", "x"), (3, "no\nlanguage\né", None, "x"), (4, "none", None, "alone")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in QUERIES["corpus_scan"](spark, str(tmp_path)).collect()}
    assert got == {("source=x", "other", 2, 1, 5, 18), ("source=alone", "other", 1, 1, 1, 5)}
    tables = connect("/nowhere")
    tables.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert difference(QUERIES["corpus_scan"](spark, str(tmp_path)), tables, ORACLES["corpus_scan"]) is None
