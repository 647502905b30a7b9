"""Semantic search: top k by cosine, and its text and JSON forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafspark.functions.vectors import cosine, usable
from leafspark.operators.chunking import HEADS


def batch_cosine(chunks: DataFrame, query: list[float], vec: str = "embedding") -> DataFrame:
    """Adds sim, the cosine with one query vector; null for unusable vectors."""
    return chunks.withColumn("sim", cosine(F.col(vec), F.array(*(F.lit(float(x)) for x in query))))


def search(chunks: DataFrame, query: list[float], top_k: int = 5, min_similarity: float = 0.5, vec: str = "embedding", tie: str = "chunk_id") -> DataFrame:
    """The k most similar chunks from a similarity on, with sim and rank; ties to the smaller id. Unusable vectors are skipped.

    The query is a literal of the plan, so nothing is joined, and the k best come from each task.
    """
    if top_k < 1 or not -1 <= min_similarity <= 1:
        raise ValueError("top_k >= 1 and -1 <= min_similarity <= 1")
    best = batch_cosine(chunks, query, vec).where(F.col("sim") >= min_similarity).orderBy(F.desc("sim"), tie).limit(top_k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("sim"), tie)))


def search_by_chunk(chunks: DataFrame, chunk: str, top_k: int = 5, min_similarity: float = 0.5, vec: str = "embedding", key: str = "chunk_id") -> DataFrame:
    """The k chunks most similar to a stored one, without itself; a chunk without a usable vector is an error.

    The one vector comes to the driver, the smallest if the id occurs several times.
    """
    held = chunks.where((F.col(key) == chunk) & usable(F.col(vec))).agg(F.min(vec).alias("v")).first()["v"]
    if held is None:
        raise ValueError(f"no chunk {chunk} with a usable vector")
    return search(chunks.where(F.col(key) != chunk), list(held), top_k, min_similarity, vec, key)


def search_per_group(chunks: DataFrame, query: list[float], group: str, top_k: int = 5, min_similarity: float = 0.5, vec: str = "embedding", tie: str = "chunk_id") -> DataFrame:
    """The k most similar chunks of every group; each task keeps at most k a group before the shuffle."""
    w = Window.partitionBy(group).orderBy(F.desc("sim"), tie)
    found = batch_cosine(chunks, query, vec).where(F.col("sim") >= min_similarity)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def format_json(results: DataFrame, include_context: bool = True) -> DataFrame:
    """One row with the results as JSON: count and results in rank order. At most top_k rows come together."""
    item = [F.col("chunk_id"), F.round("sim", 4).alias("similarity"), F.col("content")]
    if include_context:
        item.append(F.struct(*HEADS, "original_position").alias("metadata"))
    rows = F.sort_array(F.collect_list(F.struct("rank", F.struct(*item).alias("r"))))
    return results.agg(F.count("*").alias("count"), rows.alias("x")).select(F.to_json(F.struct("count", F.expr("transform(x, y -> y.r)").alias("results"))).alias("json"))


def format_text(results: DataFrame) -> DataFrame:
    """One row with the results as text: similarity, headers and the first 100 characters of each."""
    heads = F.array_join(F.filter(F.array(*(F.when(F.col(h) != "", F.concat(F.lit(f"{h}: "), F.col(h))) for h in HEADS)), lambda x: x.isNotNull()), " > ")
    flat = F.regexp_replace("content", "\n", " ")
    preview = F.when(F.length("content") > 100, F.concat(F.substring(flat, 1, 100), F.lit("..."))).otherwise(flat)
    one = F.concat(F.format_string("[%d] Similarity: %.3f\n", F.col("rank"), F.col("sim")), F.when(heads != "", F.concat(heads, F.lit("\n"))).otherwise(""), preview, F.lit("\n"))
    rows = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", one.alias("t")))), lambda x: x["t"]), "\n")
    return results.agg(F.count("*").alias("n"), rows.alias("t")).select(F.when(F.col("n") == 0, F.lit("No results found.\n")).otherwise(F.concat(F.format_string("Found %d result(s):\n\n", F.col("n")), F.col("t"))).alias("text"))
