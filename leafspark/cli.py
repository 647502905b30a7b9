"""Command line: preprocess, split, embed, search, reorder and dedup over folders of files."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafspark.operators import dedup, embed, oversize, preprocess, reorder, search
from leafspark.profiling import MONITOR
from leafspark.sources import files

#: The model that needs nothing registered: a bag of hashed words.
HASHING = "hashing"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("leafspark")
    p.add_argument("--profile", action="store_true", help="print the seconds of the command")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, **options) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.add_argument("input")
        c.add_argument("output")
        for k, (kind, default) in options.items():
            c.add_argument("--" + k.replace("_", "-"), type=kind, default=default)
        return c

    def vectors(c: argparse.ArgumentParser) -> None:
        c.add_argument("--embeddings", help="folder that embed wrote, or .npz archives")
        c.add_argument("--model", default=HASHING, help="for chunks without a vector; none: leave them without")
        c.add_argument("--dim", type=int, default=64)

    command("preprocess", max_title_length=(int, 80)).add_argument("--detect-bold-headers", action=argparse.BooleanOptionalAction, default=True)
    command("split", max_tokens=(int, 1000), layout=(str, "lines"))
    c = command("embed", model=(str, HASHING), dim=(int, 64), batch_size=(int, 64))
    c.add_argument("--cache", help="Parquet table (model, text_hash, vector) that is read and appended to")
    c.add_argument("--no-cache", action="store_true")
    vectors(command("search", query=(str, ""), top_k=(int, 5), min_similarity=(float, 0.5), format=(str, "text")))
    vectors(command("reorder", strategy=(str, "sequential")))
    c = command("dedup", threshold=(float, 0.85), strategy=(str, "first"), report=(str, None), layout=(str, "lines"))
    c.add_argument("--dry-run", action="store_true")
    vectors(c)
    return p


def _ordered(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id").orderBy("original_position", "chunk_id")))


def _embedded(spark: SparkSession, a: argparse.Namespace, chunks: DataFrame) -> DataFrame:
    """Chunks with vectors: those of --embeddings, else of the file, else of the model."""
    if a.embeddings:
        held = chunks.withColumnRenamed("embedding", "_own")
        chunks = embed.attach(held, files.read_embeddings(spark, a.embeddings)).withColumn("embedding", F.coalesce("embedding", "_own")).drop("_own")
    if a.model == "none":
        return chunks
    if a.model == HASHING:
        return chunks.withColumn("embedding", F.coalesce("embedding", embed.hashing_vector(F.col("content"), a.dim)))
    made = embed.embed(chunks.where("embedding is null").drop("embedding"), a.model).drop("embed_error")
    return chunks.where("embedding is not null").unionByName(made)


def _query_vector(spark: SparkSession, a: argparse.Namespace) -> list[float]:
    if not a.query.strip():
        raise ValueError("the query is blank")
    if a.model in (HASHING, "none"):
        return spark.range(1).select(embed.hashing_vector(F.lit(a.query), a.dim).alias("v")).first()["v"]
    return [float(x) for x in embed.load_model(a.model)([a.query])[0]]


def _embed(spark: SparkSession, a: argparse.Namespace, chunks: DataFrame) -> None:
    if a.model == HASHING:
        done = chunks.withColumn("embedding", embed.hashing_vector(F.col("content"), a.dim))
    elif a.cache and not a.no_cache:
        try:
            cache = spark.read.parquet(a.cache)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            cache = spark.createDataFrame([], "model string, text_hash string, vector array<float>")
        done, new = embed.embed_cached(chunks, cache, a.model, batch_size=a.batch_size)
        new.write.mode("append").parquet(a.cache)
    else:
        done = embed.embed(chunks.drop("embedding"), a.model, batch_size=a.batch_size)
    files.save_embeddings(done, a.output)


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.command == "preprocess":
        docs = files.read_markdown(spark, a.input)
        files.write_markdown(preprocess.preprocess(docs, preprocess.PreprocessOptions(max_title_length=a.max_title_length)) if a.detect_bold_headers else docs, a.output)
        return
    if a.command == "split":
        files.write_chunk_json(oversize.split_documents(files.read_markdown(spark, a.input), a.max_tokens), a.output, full=False, layout=a.layout)
        return
    chunks = files.read_chunk_json(spark, a.input)
    if a.command == "embed":
        _embed(spark, a, chunks)
        return
    if a.command == "search":
        vector = _query_vector(spark, a)
    held = _embedded(spark, a, chunks)
    if a.command == "search":
        found = search.search(held, vector, a.top_k, a.min_similarity)
        (search.format_json(found) if a.format == "json" else search.format_text(found)).write.mode("overwrite").text(a.output)
    elif a.command == "reorder":
        held = _ordered(held)
        order = reorder.reorder(held, "doc_id", "ordinal", a.strategy, strict=True)
        moved = held.join(order.select(F.col("block").alias("doc_id"), F.col("item").alias("ordinal"), "new_position"), ["doc_id", "ordinal"])
        files.write_markdown(reorder.reconstruct(moved, "new_position"), a.output)
    else:
        held = _ordered(held)
        groups = dedup.duplicate_groups(dedup.duplicate_pairs(held, "doc_id", "ordinal", a.threshold))
        chosen = dedup.representatives(held, groups, "doc_id", "ordinal", a.strategy)
        files.write_chunk_json(dedup.deduplicate(held, chosen, "doc_id", "ordinal", a.dry_run), a.output, full=False, layout=a.layout)
        if a.report:
            dedup.report_text(held, chosen, "doc_id", a.dry_run).orderBy("block").select(F.concat(F.lit("Document "), F.col("block").cast("string"), F.lit("\n"), "report").alias("text")).write.mode("overwrite").text(a.report)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        with MONITOR.measure(a.command):
            run(SparkSession.builder.appName("leafspark").getOrCreate(), a)
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if a.profile:
        print(f"{a.command}: {MONITOR.seconds[a.command][-1]:.2f} s", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
