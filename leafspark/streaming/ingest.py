"""Incremental ingest: new markdown files become chunks as they arrive.

A file is a complete document, so each micro-batch is processed as a whole and needs no
watermark; the source's checkpoint sees to it that a file is taken once. A batch replaces its
own partition of the target, so that one that is run again after a failure adds nothing twice,
and no batch reads what others wrote. Files of equal text are different documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafspark.operators.oversize import split_documents
from leafspark.operators.preprocess import preprocess


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, limit: int = 1000) -> StreamingQuery:
    """Start a query that appends the chunks of new files to a Parquet table and ends when none are left."""

    def step(batch: DataFrame, batch_id: int) -> None:
        docs = batch.select(F.xxhash64("path").alias("doc_id"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))
        chunks = split_documents(preprocess(docs), limit).withColumn("batch_id", F.lit(batch_id))
        chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(target)

    files = spark.readStream.text(source, wholetext=True)
    return files.withColumn("path", F.col("_metadata.file_path")).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
