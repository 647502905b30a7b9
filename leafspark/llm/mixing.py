"""Mixing sources to target weights.

Tokens are summed per source over all documents. The repetition rate of a source in a mix is
what the mix wants of it divided by what the source has, at most max_repeats. Every document
is emitted floor(rate) times, plus once more if its hash, seeded by the mix, falls under the
fraction of the rate: an independent draw that any task repeats alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space as Python's str.split knows it.
SPACES = r"[\s\p{Z}\x1c-\x1f\x85]+"
#: Rows of wanted shares that are broadcast, and the salts that split a source beyond.
TARGET_ROWS, SALTS = 10_000, 64


def clean_source(c: F.Column) -> F.Column:
    return F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def word_estimate(text: F.Column) -> F.Column:
    """floor(1.3 x white-space separated words) in whole numbers; 0 for a null or blank text."""
    words = F.size(F.filter(F.split(text, SPACES), lambda w: w != ""))
    return F.when(text.isNull(), F.lit(0)).otherwise(F.floor(F.lit(13) * words / F.lit(10))).cast("long")


@cache
def _tokenizer(name: str):
    path = SparkFiles.get(name)
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda texts: [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in s.encode(texts, num_threads=1)]


def with_tokens(documents: DataFrame, tokenizer: str | None = None, text: str = "text") -> DataFrame:
    """(doc_id, source, tokens): tokens by the words estimate, or by a public tokenizer's file (.json or .model).

    The file, local or on any file system that Spark reads, is sent to every executor. A null
    text has no tokens.
    """
    base = documents.select("doc_id", clean_source(F.col("source")).alias("source"), F.col(text).cast("string").alias("t"))
    if tokenizer is None:
        return base.select("doc_id", "source", word_estimate(F.col("t")).alias("tokens"))
    documents.sparkSession.sparkContext.addFile(tokenizer)
    name = tokenizer.rstrip("/").rpartition("/")[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                x = b.slice(at, 200)
                yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(_tokenizer(name)([t or "" for t in x.column(2).to_pylist()]), pa.int64())], names=["doc_id", "source", "tokens"])

    return base.mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, source string, tokens bigint")


def rates(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, source, wanted, available, rate, feasible) for every wanted source of every mix.

    A source without documents has nothing available and rate 0. Repeated rows count once;
    null shares, repeats or sources are dropped. sized has (source, tokens).
    """
    per = sized.groupBy("source").agg(F.sum("tokens").alias("available"))
    whole = per.agg(F.coalesce(F.sum("available"), F.lit(0)).alias("total"))
    t = targets.select("mix_id", clean_source(F.col("source")).alias("source"), "target_share", "max_repeats", "size_ratio").dropna().distinct()
    j = t.join(per, "source", "left").crossJoin(F.broadcast(whole))  # whole is one row
    wanted = F.col("target_share") * F.col("size_ratio") * F.col("total")
    have = F.coalesce("available", F.lit(0)).cast("long")
    return j.select("mix_id", "source", "max_repeats", wanted.alias("wanted"), have.alias("available"), F.when(have > 0, F.least(wanted / F.when(have > 0, have), F.col("max_repeats").cast("double"))).otherwise(F.lit(0.0)).alias("rate"), (wanted <= F.col("max_repeats") * have).alias("feasible"))


def draw(sized: DataFrame, rate: DataFrame, seed: str = "mix") -> DataFrame:
    """(mix_id, doc_id, source, copies, tokens): documents with at least one copy in the mix.

    copies = floor(rate) + one more if the document's hash is under the fraction. The rates
    are one row per mix and wanted source, so each document meets only its source's rows. Up
    to TARGET_ROWS of them are broadcast; more are joined with each source split by a salt.
    """
    r = rate.select("mix_id", F.col("source").alias("wanted_source"), "rate")
    if r.limit(TARGET_ROWS + 1).count() <= TARGET_ROWS:
        j = sized.join(F.broadcast(r), F.col("source") == F.col("wanted_source"))
    else:
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
        spread = r.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        j = sized.withColumn("_s", salt).join(spread, (F.col("source") == F.col("wanted_source")) & (F.col("_s") == F.col("_t")))
    part = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("mix_id").cast("string"), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    copies = (F.floor("rate") + F.when(part < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    return j.select("mix_id", "doc_id", "source", copies.alias("copies"), "tokens").where("copies > 0")


def emit(sized: DataFrame, rate: DataFrame, seed: str = "mix") -> DataFrame:
    """(mix_id, doc_id, source, copy, tokens): every document as often as the mix repeats it, copies counted from 1."""
    d = draw(sized, rate, seed)
    return d.select("mix_id", "doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), "tokens")


def reached(sized: DataFrame, rate: DataFrame, seed: str = "mix") -> DataFrame:
    """(mix_id, source, wanted_tokens, drawn_tokens, drawn_share, copies, feasible): the shares that the draw reached."""
    d = draw(sized, rate, seed).groupBy("mix_id", "source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("drawn_tokens"), F.sum("copies").alias("copies"))
    j = rate.join(d, ["mix_id", "source"], "left").select("mix_id", "source", F.col("wanted").alias("wanted_tokens"), F.coalesce("drawn_tokens", F.lit(0)).alias("drawn_tokens"), F.coalesce("copies", F.lit(0)).alias("copies"), "feasible")
    whole = j.groupBy("mix_id").agg(F.sum("drawn_tokens").alias("mix_tokens"))
    return j.join(whole, "mix_id").withColumn("drawn_share", F.when(F.col("mix_tokens") > 0, F.col("drawn_tokens") / F.col("mix_tokens"))).drop("mix_tokens")
