"""Markdown, chunk JSON and embeddings: readers and writers."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafspark.functions.text import is_blank
from leafspark.operators.chunking import HEADS
from leafspark.schema import JSON_CHUNK

META = [*HEADS, "original_position", "token_count", "parent_id", "depth_level", "sequence_number", "is_inside_code_block", "element_type"]


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, text) of every file: whole texts with \\n line ends.

    doc_id is a hash of the path, or what write_markdown() put into the path.
    """
    raw = spark.read.text(path, wholetext=True)
    doc_id = F.col("doc_id").cast("long") if "doc_id" in raw.columns else F.xxhash64("path")
    files = raw.select("*", F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))
    return files.select(doc_id.alias("doc_id"), "path", "text")


def write_markdown(docs: DataFrame, path: str) -> None:
    """An export with one folder and file per document, for hand-sized collections; every text ends with a newline.

    A null text gives no file. Large collections belong in one table: save_documents().
    """
    body = F.regexp_replace("text", r"\n\z", "")  # the writer ends each row with a newline
    docs.where("doc_id is not null and text is not null").select("doc_id", body.alias("text")).write.partitionBy("doc_id").mode("overwrite").text(path)


def save_documents(docs: DataFrame, path: str) -> None:
    """(doc_id, text) as Parquet."""
    docs.select("doc_id", "text").write.mode("overwrite").parquet(path)


def read_chunk_json(spark: SparkSession, path: str, strict: bool = False, layout: str | None = None) -> DataFrame:
    """Chunks of JSON files; missing fields take their defaults.

    layout "lines": one chunk a line, with its doc_id; "array": a file per document with one
    array, whose doc_id is in the path or is a hash of it. None looks at the first line of a
    file. Chunks with a blank id or content are dropped, or raise in strict mode.
    """
    if layout is None:
        first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
        layout = "array" if first and first[0]["value"].lstrip().startswith("[") else "lines"
    if layout not in ("lines", "array"):
        raise ValueError("layout is lines or array")
    held = spark.read.schema(f"doc_id BIGINT, {JSON_CHUNK}").json(path, multiLine=layout == "array")
    raw = held.withColumn("doc_id", F.coalesce("doc_id", F.xxhash64("_metadata.file_path")))
    bad = F.coalesce(is_blank(F.col("chunk_id")) | is_blank(F.col("content")), F.lit(True))
    rows = raw.withColumn("chunk_id", F.when(bad, F.raise_error(F.lit("a chunk without id or content"))).otherwise(F.col("chunk_id"))) if strict else raw.where(~bad)
    return rows.select("doc_id", "chunk_id", "content", *(F.col(f"metadata.{m}").alias(m) for m in META), "embedding").fillna({"original_position": 0, "token_count": 0, "depth_level": 0, "is_inside_code_block": False})


def chunk_struct(full: bool = True) -> F.Column:
    """A chunk as the struct of its JSON form; the short form has headers and position only."""
    meta = META if full else [*HEADS, "original_position"]
    parts = [F.col("chunk_id"), F.col("content"), F.struct(*meta).alias("metadata")]
    return F.struct(*parts, *([F.col("embedding")] if full else []))


def write_chunk_json(chunks: DataFrame, path: str, full: bool = True, layout: str = "lines") -> None:
    """Chunks as JSON: one chunk a line with its doc_id, or one array per document, in the order of position and id.

    Arrays gather the chunks of a document in a task and make a folder per document.
    Columns of the full form that the chunks lack are null.
    """
    held = chunks
    for name, kind in (("embedding", "array<float>"), *((m, "string") for m in META)):
        if full and name not in chunks.columns:
            held = held.withColumn(name, F.lit(None).cast(kind))
    if layout == "lines":
        held.select("doc_id", chunk_struct(full).alias("c")).select("doc_id", "c.*").write.mode("overwrite").json(path)
    elif layout == "array":
        one = F.struct("original_position", "chunk_id", chunk_struct(full).alias("c"))
        whole = held.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("x"))
        whole.select("doc_id", F.to_json(F.transform("x", lambda x: x["c"])).alias("json")).write.partitionBy("doc_id").mode("overwrite").text(path)
    else:
        raise ValueError("layout is lines or array")


def to_dict(chunks: DataFrame) -> DataFrame:
    return chunks.select("doc_id", F.to_json(chunk_struct()).alias("json"))


def from_dict(rows: DataFrame) -> DataFrame:
    c = rows.select("doc_id", F.from_json("json", JSON_CHUNK).alias("c"))
    return c.select("doc_id", "c.chunk_id", "c.content", *(F.col(f"c.metadata.{m}").alias(m) for m in META), "c.embedding")


def save_embeddings(chunks: DataFrame, path: str, strict: bool = False) -> None:
    """(doc_id, chunk_id, embedding) of the chunks with one as Parquet; strict raises if there is none."""
    held = chunks.where(F.col("embedding").isNotNull()).select(*(["doc_id"] if "doc_id" in chunks.columns else []), "chunk_id", "embedding")
    if strict and held.isEmpty():
        raise ValueError("no chunk has an embedding")
    held.write.mode("overwrite").parquet(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id where it was saved, chunk_id, embedding) of a folder of save_embeddings(), or of .npz archives."""
    return read_npz(spark, path) if path.endswith(".npz") else spark.read.parquet(path)


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id, embedding) of archives with one array per chunk id, read in the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    yield pd.DataFrame({"chunk_id": list(z.files), "embedding": [z[k].astype(np.float32) for k in z.files]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "chunk_id string, embedding array<float>")
