"""Queries on the labelled corpus: metrics, folds, intervals, duplicates, reuse of stored results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.levels import flagged, risk_tier
from riskloom.operators import evaluation, keyed, rollups
from riskloom.operators.findings import scan, security_summary
from riskloom.operators.ordering import ordinals
from riskloom.plans import roles
from riskloom.plans.registry import query
from riskloom.sources.files import path_order
from riskloom.sources.tables import table


def labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels with the prediction of the second tool (an issue in a file of low quality)."""
    return table(spark, folder, "labels").select(
        "doc_id",
        (F.col("toxic") == 1).alias("truth"),
        F.when(F.col("toxic") == 1, F.lit("VULNERABLE")).otherwise(F.lit("BENIGN")).alias("label"),
        (F.when(F.col("quality") == 0, F.lit(1)).otherwise(F.lit(0)) > 0).alias("second_flag"),
    )


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Tier and flag of every file with findings; a file without findings is LOW and not flagged."""
    summary = security_summary(scan(roles.files(spark, folder), "doc_id", "text"), ["doc_id"])
    tier = risk_tier(F.col("security_score"))
    return summary.select(
        "doc_id", tier.alias("risk_tier"), flagged(tier, F.col("findings")).alias("flagged")
    )


SQL_PREDICTIONS = f"""{roles.sql_rule_findings('documents', 'doc_id', 'text')},
security AS (SELECT doc_id, count(*) AS findings, 1 - exp(-sum({roles.SQL_SEVERITY_WEIGHT} * confidence_score)) AS s
  FROM rule_hits GROUP BY 1),
predictions AS (SELECT doc_id, {roles.SQL_TIER.format('s')} AS risk_tier, true AS flagged FROM security),
truths AS (SELECT doc_id, toxic = 1 AS truth, CASE toxic WHEN 1 THEN 'VULNERABLE' ELSE 'BENIGN' END AS label,
  quality = 0 AS second_flag FROM labels)"""

_CELLS = """count(*) FILTER (truth AND p) AS tp, count(*) FILTER (NOT truth AND p) AS fp,
  count(*) FILTER (truth AND NOT p) AS fn, count(*) FILTER (NOT truth AND NOT p) AS tn"""
_RATIOS = """round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall,
  round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 9) AS accuracy"""
_MEASURES = ("precision", "recall", "f1", "accuracy")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({m: F.round(m, 9) for m in _MEASURES})


@query(
    "eval_metrics",
    f"""WITH {SQL_PREDICTIONS}, rows AS (
      SELECT 'rules' AS tool, truth, coalesce(flagged, false) AS p FROM truths LEFT JOIN predictions USING (doc_id)
      UNION ALL SELECT 'second', truth, second_flag FROM truths),
    cells AS (SELECT tool, {_CELLS} FROM rows GROUP BY 1)
    SELECT tool, tp, fp, fn, tn, {_RATIOS} FROM cells""",
)
def eval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    truth = labels(spark, folder)
    joined = truth.join(predictions(spark, folder), "doc_id", "left")
    tools = F.explode(
        F.array(
            F.struct(F.lit("rules").alias("tool"), F.col("flagged").alias("p")),
            F.struct(F.lit("second").alias("tool"), F.col("second_flag").alias("p")),
        )
    )
    rows = joined.select("truth", tools.alias("t")).select("truth", "t.tool", "t.p")
    return _rounded(evaluation.metrics(rows, ["tool"], "truth", "p"))


@query(
    "eval_by_source",
    f"""WITH {SQL_PREDICTIONS}, rows AS (
      SELECT source, truth, coalesce(flagged, false) OR second_flag AS p FROM truths JOIN documents USING (doc_id)
      LEFT JOIN predictions USING (doc_id)), cells AS (SELECT source, {_CELLS} FROM rows GROUP BY 1)
    SELECT source, tp, fp, fn, tn, {_RATIOS} FROM cells""",
)
def eval_by_source(spark: SparkSession, folder: str) -> DataFrame:
    sources = table(spark, folder, "documents").select("doc_id", "source")
    joined = labels(spark, folder).join(sources, "doc_id").join(predictions(spark, folder), "doc_id", "left")
    either = F.coalesce("flagged", F.lit(False)) | F.col("second_flag")
    return _rounded(evaluation.metrics(joined.withColumn("p", either), ["source"], "truth", "p"))


@query(
    "eval_by_category",
    f"""WITH {SQL_PREDICTIONS}, hits AS (SELECT DISTINCT doc_id, category FROM rule_hits),
    rows AS (SELECT c.category, truth, h.doc_id IS NOT NULL AS p FROM truths t
      CROSS JOIN (SELECT DISTINCT category FROM hits JOIN truths USING (doc_id)) c
      LEFT JOIN hits h ON h.doc_id = t.doc_id AND h.category = c.category),
    cells AS (SELECT category, {_CELLS} FROM rows GROUP BY 1)
    SELECT category, tp, fp, fn, tn, {_RATIOS} FROM cells""",
)
def eval_by_category(spark: SparkSession, folder: str) -> DataFrame:
    hits = scan(roles.files(spark, folder), "doc_id", "text").select("doc_id", "category")
    return _rounded(evaluation.category_metrics(labels(spark, folder), hits, "doc_id", "truth", "category"))


@query(
    "confusion_matrix",
    f"""WITH {SQL_PREDICTIONS}
    SELECT coalesce(risk_tier, 'LOW') AS risk_tier, count(*) FILTER (label = 'VULNERABLE') AS vulnerable,
      count(*) FILTER (label = 'BENIGN') AS benign FROM truths LEFT JOIN predictions USING (doc_id) GROUP BY 1""",
)
def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    joined = labels(spark, folder).join(predictions(spark, folder), "doc_id", "left").na.fill("LOW", ["risk_tier"])
    return evaluation.confusion_matrix(joined, "risk_tier", "label", ["VULNERABLE", "BENIGN"])


@query(
    "stratified_folds",
    f"""WITH truths AS (SELECT doc_id, toxic = 1 AS truth, quality = 0 AS p FROM labels),
    dealt AS (SELECT truth, p,
      (row_number() OVER (PARTITION BY truth ORDER BY md5(doc_id::VARCHAR), doc_id) - 1) % 5 AS fold FROM truths),
    cells AS (SELECT fold::INT AS fold, {_CELLS} FROM dealt GROUP BY 1)
    SELECT fold, tp, fp, fn, tn, {_RATIOS} FROM cells""",
)
def stratified_folds(spark: SparkSession, folder: str) -> DataFrame:
    rows = labels(spark, folder).select("doc_id", "truth", F.col("second_flag").alias("p"))
    dealt = evaluation.stratified_folds(rows, "truth", "doc_id")
    return _rounded(evaluation.metrics(dealt, ["fold"], "truth", "p"))


_STEPS = " + ".join(f"(u >= {s!r}::DOUBLE)::INT" for s in evaluation.POISSON_STEPS)


@query(
    "bootstrap_ci",
    f"""WITH rows AS (SELECT doc_id, toxic = 1 AS truth, quality = 0 AS p FROM labels),
    cells AS (SELECT doc_id, (truth AND p)::INT AS tp, (NOT truth AND p)::INT AS fp, (truth AND NOT p)::INT AS fn,
      (NOT truth AND NOT p)::INT AS tn FROM rows),
    drawn AS (SELECT *, ('0x' || substr(md5(doc_id || ':' || i), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u
      FROM cells, range({evaluation.ITERATIONS}) r(i)),
    sums AS (SELECT i, sum(tp * ({_STEPS})) AS tp, sum(fp * ({_STEPS})) AS fp, sum(fn * ({_STEPS})) AS fn,
      sum(tn * ({_STEPS})) AS tn FROM drawn GROUP BY 1),
    measured AS (SELECT tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall,
      2 * tp / nullif(2 * tp + fp + fn, 0) AS f1, (tp + tn) / nullif(tp + fp + fn + tn, 0) AS accuracy FROM sums),
    named AS (UNPIVOT measured ON precision, recall, f1, accuracy INTO NAME metric VALUE value)
    SELECT metric, count(value) AS iterations, round(avg(value), 6) AS mean,
      round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high FROM named GROUP BY 1""",
)
def bootstrap_ci(spark: SparkSession, folder: str) -> DataFrame:
    intervals = evaluation.bootstrap(labels(spark, folder), "doc_id", "truth", "second_flag")
    return intervals.withColumns({c: F.round(c, 6) for c in ("mean", "low", "high")})


@query(
    "tool_agreement",
    f"""WITH {SQL_PREDICTIONS}, joined AS (SELECT coalesce(flagged, false) AS first, coalesce(second_flag, false) AS second
      FROM predictions FULL JOIN truths USING (doc_id))
    SELECT first, second, count(*) AS files FROM joined GROUP BY ALL""",
)
def tool_agreement(spark: SparkSession, folder: str) -> DataFrame:
    second = labels(spark, folder).select("doc_id", F.col("second_flag").alias("flagged"))
    return evaluation.agreement(predictions(spark, folder), second, "doc_id")


@query(
    "balanced_sample",
    """WITH known AS (SELECT doc_id, CASE toxic WHEN 1 THEN 'VULNERABLE' ELSE 'BENIGN' END AS label
      FROM labels JOIN documents USING (doc_id)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(doc_id::VARCHAR), doc_id) AS rn FROM known)
    SELECT doc_id, label FROM placed
    WHERE rn <= (SELECT least(250, min(n)) FROM (SELECT count(*) AS n FROM known GROUP BY label))""",
)
def balanced_sample(spark: SparkSession, folder: str) -> DataFrame:
    known = table(spark, folder, "documents").select("doc_id")
    rows = labels(spark, folder).select("doc_id", "label").join(known, "doc_id")
    return evaluation.balanced_sample(rows, "label", "doc_id", 250)


@query(
    "exact_dedup",
    """SELECT sha256(text) AS content_hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1""",
)
def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.distinct_contents(roles.files(spark, folder), "doc_id", "text")


@query(
    "unanalysed_files",
    """WITH analysed AS (SELECT DISTINCT sha256(text) AS h FROM documents JOIN labels USING (doc_id))
    SELECT doc_id, '1:' || sha256(text) AS content_key FROM documents WHERE sha256(text) NOT IN (SELECT h FROM analysed)""",
)
def unanalysed_files(spark: SparkSession, folder: str) -> DataFrame:
    files = roles.files(spark, folder).select("doc_id", "text")
    analysed = files.join(table(spark, folder, "labels").select("doc_id"), "doc_id", "left_semi")
    stored = analysed.select(keyed.content_key(F.col("text")).alias("content_key"))
    return keyed.unanalysed(files, stored, "text").select("doc_id", "content_key")


@query(
    "first_files",
    """SELECT row_number() OVER (ORDER BY string_split(path, '/')) AS ordinal, path, doc_id
    FROM (SELECT source || '/' || lang || '/' || lpad(doc_id::VARCHAR, 12, '0') AS path, doc_id FROM documents)
    ORDER BY string_split(path, '/') LIMIT 20""",
)
def first_files(spark: SparkSession, folder: str) -> DataFrame:
    padded = F.lpad(F.col("doc_id").cast("string"), 12, "0")
    paths = table(spark, folder, "documents").select(F.concat_ws("/", "source", "lang", padded).alias("path"), "doc_id")
    first = paths.orderBy(path_order(F.col("path"))).limit(20)
    return ordinals(first, [], [path_order(F.col("path"))], "ordinal").select("ordinal", "path", "doc_id")


@query(
    "corpus_ordinals",
    """SELECT row_number() OVER (ORDER BY string_split(path, '/')) AS ordinal, path
    FROM (SELECT source || '/' || lang || '/' || lpad(doc_id::VARCHAR, 12, '0') AS path FROM documents)""",
)
def corpus_ordinals(spark: SparkSession, folder: str) -> DataFrame:
    padded = F.lpad(F.col("doc_id").cast("string"), 12, "0")
    paths = table(spark, folder, "documents").select(F.concat_ws("/", "source", "lang", padded).alias("path"))
    return ordinals(paths, [], [path_order(F.col("path"))], "ordinal").select("ordinal", "path")
