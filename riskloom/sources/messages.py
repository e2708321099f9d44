"""Message ingress: webhook and analysis events as a stream, from files or from Kafka."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import configure
from riskloom.sources.tables import SCHEMAS

MESSAGE_SCHEMA = SCHEMAS["events"].replace("TIMESTAMP_NTZ", "TIMESTAMP")


def table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A table folder (or file) as a stream of its parquet files."""
    reader = configure(spark).readStream.schema(SCHEMAS[name])
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # as a pattern the path may be a folder of files or one file; as a plain path only a folder
    return reader.parquet(f"{folder}/{name}.parque[t]")


def events_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Messages with a UTC event time, as watermarks need it."""
    return table_stream(spark, folder, "events", files_per_batch).withColumn("ts", F.col("ts").cast("timestamp"))


HEARTBEAT = "heartbeat"


def with_heartbeat(messages: DataFrame, path: str, moment, **values) -> DataFrame:
    """Messages followed by one of type ``heartbeat`` at ``moment``, written below ``path``.

    A window or session closes when the watermark passes it; the heartbeat moves the watermark past the last real message.
    Other columns are null or as ``values`` say; a stream that is joined needs its keys there, for rows with a null key
    are left out before they reach the watermark.
    """
    spark = messages.sparkSession
    others = [f for f in messages.schema if f.name not in ("ts", "event_type")]
    nulls = [F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in others]
    beat = spark.range(1).select(F.lit(moment).cast("timestamp").alias("ts"), F.lit(HEARTBEAT).alias("event_type"), *nulls)
    beat.select(*messages.columns).write.mode("overwrite").parquet(path)
    return messages.unionByName(spark.readStream.schema(messages.schema).parquet(path))


def kafka_stream(spark: SparkSession, servers: str, topics: str, **options: str) -> DataFrame:
    """JSON messages of Kafka topics in the same shape (needs the Kafka connector on the class path)."""
    source = configure(spark).readStream.format("kafka")
    raw = source.option("kafka.bootstrap.servers", servers).option("subscribe", topics).options(**options).load()
    return raw.select(parsed(F.col("value").cast("string")).alias("m")).select("m.*")


def parsed(body):
    """Message fields of a JSON body; a malformed body gives null fields."""
    return F.from_json(body, MESSAGE_SCHEMA)
