"""Embedding with a cache table and pluggable embedders.

An embedder is a callable from a list of texts to a list of vectors. It runs inside Arrow
batches, is loaded once a task, and a text it fails on gets a null vector and an error.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafspark.functions.text import text_hash, words
from leafspark.session import cut

Embedder = Callable[[list[str]], list[list[float]]]
_MODELS: dict[str, Callable[[], Embedder]] = {}


def register_model(name: str, load: Callable[[], Embedder]) -> None:
    """Register a function that loads an embedder; it is called in the workers."""
    _MODELS[name] = load


def available_models() -> list[str]:
    return sorted(_MODELS)


def model_exists(name: str) -> bool:
    return name in _MODELS


def load_model(name: str, attempts: int = 3, wait: float = 1.0) -> Embedder:
    """The embedder of a registered model; a failed load is tried again after a wait that doubles."""
    if name not in _MODELS:
        raise ValueError(f"no such model: {name}; there are {available_models()}")
    return _loaded(_MODELS[name], attempts, wait)


def _loaded(load: Callable[[], Embedder], attempts: int, wait: float) -> Embedder:
    if attempts < 1:
        raise ValueError("attempts must be at least 1")
    for k in range(attempts):
        try:
            return load()
        except Exception:
            if k == attempts - 1:
                raise
            time.sleep(wait * 2**k)
    raise AssertionError


def hashing_vector(text: F.Column, dim: int = 64) -> F.Column:
    """A bag of words of signed hash counts at length one, in the JVM; null for a blank text."""
    if dim < 1:
        raise ValueError("dim must be at least 1")
    bind = lambda value, body: F.transform(F.array(value), body)[0]  # noqa: E731  a value bound once: else each use computes it again
    sign = lambda h: F.when(F.pmod(F.shiftright(h, 32), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    cell = lambda hs, i: F.aggregate(F.filter(hs, lambda h: F.pmod(h, F.lit(dim)) == i), F.lit(0.0), lambda s, h: s + sign(h))
    unit = lambda v, n: F.when(n > 0, F.transform(v, lambda x: (x / n).cast("float")))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    hashes = F.transform(words(F.lower(text)), lambda w: F.xxhash64(w))
    cells = bind(hashes, lambda hs: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: cell(hs, i)))
    return bind(cells, lambda v: bind(norm(v), lambda n: unit(v, n)))


def embed(texts: DataFrame, model: str, column: str = "content", batch_size: int = 64, attempts: int = 3, progress: Accumulator | None = None) -> DataFrame:
    """Adds embedding and embed_error by a registered model.

    Texts go to the model in batches; if one fails, or gives another number of vectors, its
    texts are tried one by one, and those that fail have a null embedding and an error. Blank
    and null texts are not asked for. The model is loaded once a task, with retries; if it
    can't be loaded the task fails. progress is added the number of texts of each batch.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    if model not in _MODELS:
        raise ValueError(f"no such model: {model}; there are {available_models()}")
    load = _MODELS[model]

    @F.pandas_udf("struct<embedding: array<float>, embed_error: string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        f = _loaded(load, attempts, 1.0)

        def ask(group: list[str]) -> list[tuple]:
            try:
                vectors = f(group)
                if len(vectors) != len(group):
                    raise ValueError(f"{len(vectors)} vectors for {len(group)} texts")
                return [(np.asarray(v, np.float32), None) for v in vectors]
            except Exception as e:
                return [(None, str(e)[:200])] if len(group) == 1 else [x for t in group for x in ask([t])]

        for batch in batches:
            out = [(None, "blank text")] * len(batch)
            full = [i for i, t in enumerate(batch) if t is not None and t.strip()]
            for at in range(0, len(full), batch_size):
                group = full[at : at + batch_size]
                for i, x in zip(group, ask([batch.iloc[i] for i in group])):
                    out[i] = x
                if progress is not None:
                    progress.add(len(group))
            yield pd.DataFrame(out, columns=["embedding", "embed_error"])

    return texts.withColumn("_e", run(F.col(column))).select(*texts.columns, "_e.embedding", "_e.embed_error")


def cache_misses(chunks: DataFrame, cache: DataFrame, model: str, column: str = "content", force_refresh: bool = False) -> DataFrame:
    """(model, text_hash, text): each text once that the cache lacks for the model."""
    asked = chunks.where(F.col(column).isNotNull()).select(F.lit(model).alias("model"), text_hash(F.col(column), 16).alias("text_hash"), F.col(column).alias("text")).groupBy("model", "text_hash").agg(F.min("text").alias("text"))
    if force_refresh:
        return asked
    held = cache.where(F.col("model") == model).select("model", "text_hash")
    return asked.join(held, ["model", "text_hash"], "left_anti")


def embed_cached(chunks: DataFrame, cache: DataFrame, model: str, column: str = "content", force_refresh: bool = False, **options) -> tuple[DataFrame, DataFrame]:
    """(chunks with embedding, new rows (model, text_hash, vector) for the cache).

    Each distinct text that the cache lacks is embedded once, and written to the shared folder
    so that both results see the same vectors; append the new rows to the cache table. A
    failed text stays without an embedding and is asked for again the next time. Of repeated
    cache rows the largest vector counts.
    """
    done = embed(cache_misses(chunks, cache.where("vector is not null"), model, column, force_refresh), model, "text", **options)
    new = cut(done.where("embedding is not null").select("model", "text_hash", F.col("embedding").alias("vector")))
    old = cache.where((F.col("model") == model) & F.col("vector").isNotNull()).select("model", "text_hash", F.col("vector").cast("array<float>").alias("vector"))
    old = old.join(new.select("text_hash"), "text_hash", "left_anti").select("model", "text_hash", "vector") if force_refresh else old
    held = old.union(new).groupBy("text_hash").agg(F.max("vector").alias("embedding"))
    out = chunks.drop("embedding").withColumn("text_hash", text_hash(F.col(column), 16)).join(held, "text_hash", "left").drop("text_hash")
    return out, new


def cache_statistics(chunks: DataFrame, cache: DataFrame, model: str, column: str = "content") -> DataFrame:
    """(requests, hits, misses, hit_rate): a request hits if its key is cached or was asked for before."""
    asked = chunks.where(F.col(column).isNotNull()).groupBy(text_hash(F.col(column), 16).alias("text_hash")).agg(F.count("*").alias("n"))
    held = cache.where(F.col("model") == model).select("text_hash").distinct().withColumn("cached", F.lit(1))
    j = asked.join(held, "text_hash", "left")
    s = j.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("requests"), F.coalesce(F.sum(F.when(F.col("cached") == 1, 0).otherwise(1)), F.lit(0)).cast("long").alias("misses"))
    return s.select("requests", (F.col("requests") - F.col("misses")).alias("hits"), "misses", F.when(F.col("requests") > 0, (F.col("requests") - F.col("misses")) / F.col("requests")).otherwise(0.0).alias("hit_rate"))


def attach(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks with the embedding of their key; without one it is null. Of repeated keys the largest vector stays.

    The key is doc_id and chunk_id, as a chunk_id alone has 32 bits and occurs in several
    documents; it is chunk_id alone for vectors that were saved without a document.
    """
    key = ["doc_id", "chunk_id"] if "doc_id" in vectors.columns else ["chunk_id"]
    one = vectors.groupBy(*key).agg(F.max("embedding").alias("embedding"))
    return chunks.drop("embedding").join(one, key, "left")
