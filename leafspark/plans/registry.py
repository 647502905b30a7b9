"""All queries of the core, each over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafspark.functions import text as T
from leafspark.functions import vectors as V
from leafspark.operators import chunking, dedup, elements, embed, lines, oversize, preprocess, reorder, search, sections
from leafspark.plans import sql
from leafspark.sources import files

CHUNK_COLUMNS = ["doc_id", "chunk_id", "content", *chunking.HEADS, "original_position", "token_count", "element_type"]
#: A low limit, so that every strategy for oversized chunks occurs.
LIMIT = 60
THRESHOLD = 0.4


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """The given chunks without rows sent twice."""
    return spark.read.parquet(f"{d}/chunks.parquet").select(*CHUNK_COLUMNS).distinct()


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet")


def _query(spark: SparkSession, d: str) -> list[float]:
    """One stored vector as the query: that of the smallest id."""
    return list(_vectors(spark, d).orderBy("vec_id").limit(1).collect()[0]["embedding"])


def _split(spark: SparkSession, d: str) -> DataFrame:
    return chunking.split(_docs(spark, d))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(spark, d)


def document_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.explode_lines(_docs(spark, d)).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max(F.length("line")).alias("longest"))


def header_lines(spark: SparkSession, d: str) -> DataFrame:
    return chunking.header_lines(_docs(spark, d)).where("level is not null").select("doc_id", "line_no", "level", "header")


def header_cascade(spark: SparkSession, d: str) -> DataFrame:
    return chunking.cascade(chunking.header_lines(_docs(spark, d))).where("level is not null").select("doc_id", "line_no", *chunking.HEADS)


def split_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d)


def split_chunks_h1_h3(spark: SparkSession, d: str) -> DataFrame:
    return chunking.split(_docs(spark, d), (1, 2, 3))


def split_stats(spark: SparkSession, d: str) -> DataFrame:
    return chunking.split_statistics(_split(spark, d))


def blank_documents(spark: SparkSession, d: str) -> DataFrame:
    return chunking.blank_documents(_docs(spark, d))


def header_path(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d).select("doc_id", "original_position", T.header_path(*(F.col(h) for h in chunking.HEADS)).alias("path"))


def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.token_count(F.col("text")).alias("tokens"))


def chunk_id_hash(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.chunk_id(F.col("text"), F.lit(0)).alias("chunk_id"))


def text_hash(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.text_hash(F.col("text"), 16).alias("short_hash"), T.text_hash(F.col("text")).alias("full_hash"))


def bold_titles(spark: SparkSession, d: str) -> DataFrame:
    return preprocess.bold_titles(_docs(spark, d)).where("title is not null").select("doc_id", "line_no", "title", "level")


def preprocess_text(spark: SparkSession, d: str) -> DataFrame:
    return preprocess.preprocess(_docs(spark, d))


def preprocess_then_split(spark: SparkSession, d: str) -> DataFrame:
    return chunking.split(preprocess.preprocess(_docs(spark, d)))


def list_items(spark: SparkSession, d: str) -> DataFrame:
    return oversize.list_items(_split(spark, d)).select("doc_id", "original_position", "idx", "item", "depth", "parent_idx", "tokens")


def _pieces(p: DataFrame) -> DataFrame:
    return p.select("doc_id", "original_position", F.posexplode("pieces").alias("piece", "content"))


def pack_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(oversize.pack_paragraphs(_split(spark, d), LIMIT))


def pack_list_items(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(oversize.pack_list_items(_split(spark, d), LIMIT))


def pack_by_depth(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(oversize.pack_by_depth(_split(spark, d), LIMIT))


def split_oversized(spark: SparkSession, d: str) -> DataFrame:
    return oversize.split_documents(_docs(spark, d), LIMIT)


def sequence_numbers(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("doc_id", "chunk_id", T.sequence_number(F.col("content")).alias("sequence_number"))


def element_rules(spark: SparkSession, d: str) -> DataFrame:
    """Levels, code flags and types by rule, of every header line and list item taken as an element."""
    c = _chunks(spark, d)
    category = F.when(F.col("content").startswith("#"), "Title").when(F.col("content").startswith("```"), "CodeSnippet").when(F.col("content").startswith("- "), "ListItem").otherwise("Other")
    number = T.sequence_number(F.col("content"))
    return c.select("doc_id", "chunk_id", elements.header_level(F.length(F.regexp_extract("content", "^(#*)", 1)) - 1).alias("header_level"), elements.is_code_block(F.col("content"), category).alias("is_code"), elements.element_type(category, number).alias("element_type"))


def element_parse(spark: SparkSession, d: str) -> DataFrame:
    return elements.parse(_docs(spark, d))


def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    return dedup.pairwise(_vectors(spark, d), "label", "vec_id").select("block", "i", "j", F.round("sim", 6).alias("sim"))


def batch_cosine(spark: SparkSession, d: str) -> DataFrame:
    return search.batch_cosine(_vectors(spark, d), _query(spark, d)).select("vec_id", F.round("sim", 6).alias("sim"))


def cosine_normalized(spark: SparkSession, d: str) -> DataFrame:
    q = F.array(*(F.lit(float(x)) for x in _query(spark, d)))
    return _vectors(spark, d).select("vec_id", F.round(V.cosine_normalized(F.col("embedding"), q), 6).alias("sim"))


def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    unit = V.normalize(F.col("embedding"))
    return _vectors(spark, d).select("vec_id", F.round(V.norm(F.col("embedding")), 5).alias("norm"), F.round(V.norm(unit), 5).alias("unit_norm"))


def vector_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Vectors packed to bytes and back: the length, the sum and the sum weighted by place of what comes back."""
    v = _vectors(spark, d).withColumn("b", V.to_bytes(F.col("embedding"))).withColumn("w", V.from_bytes(F.col("b")))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda t, x: t + x)
    return v.select("vec_id", F.length("b").alias("n_bytes"), F.round(total(F.transform("w", lambda x: x.cast("double"))), 6).alias("total"), F.round(total(F.transform("w", lambda x, i: x.cast("double") * (i + 1))), 6).alias("weighted"))


def search_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.search(_vectors(spark, d), _query(spark, d), 10, 0.1, tie="vec_id").select("rank", "vec_id", F.round("sim", 6).alias("sim"))


def search_topk_per_label(spark: SparkSession, d: str) -> DataFrame:
    return search.search_per_group(_vectors(spark, d), _query(spark, d), "label", 3, -1.0, tie="vec_id").select("label", "rank", "vec_id", F.round("sim", 6).alias("sim"))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """Stored vectors as chunks of the block of their label."""
    heads = [F.when(F.col("vec_id") % (k + 1) == 0, F.concat(F.lit(f"H{k} "), (F.col("vec_id") % 5).cast("string"))).alias(f"h{k}") for k in range(1, 7)]
    return _vectors(spark, d).select("vec_id", "label", "embedding", F.concat(F.lit("vector "), F.col("vec_id").cast("string"), F.repeat(F.lit("."), (F.col("vec_id") % 17).cast("int"))).alias("content"), *heads, F.col("vec_id").cast("int").alias("original_position"), F.col("vec_id").cast("string").alias("chunk_id"))


def search_json(spark: SparkSession, d: str) -> DataFrame:
    return search.format_json(search.search(_stored(spark, d), _query(spark, d), 5, 0.1))


def search_text(spark: SparkSession, d: str) -> DataFrame:
    return search.format_text(search.search(_stored(spark, d), _query(spark, d), 5, 0.1))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return dedup.duplicate_pairs(_stored(spark, d), "label", "vec_id", THRESHOLD)


def dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("block", "i", "j", F.round("sim", 6).alias("sim"))


def dup_groups(spark: SparkSession, d: str) -> DataFrame:
    return dedup.duplicate_groups(_pairs(spark, d))


def _chosen(spark: SparkSession, d: str, strategy: str) -> DataFrame:
    return dedup.representatives(_stored(spark, d), dup_groups(spark, d), "label", "vec_id", strategy)


def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    return _chosen(spark, d, "first")


def dedup_longest(spark: SparkSession, d: str) -> DataFrame:
    return _chosen(spark, d, "longest")


def dedup_best_metadata(spark: SparkSession, d: str) -> DataFrame:
    return _chosen(spark, d, "best_metadata")


def deduplicated(spark: SparkSession, d: str) -> DataFrame:
    return dedup.deduplicate(_stored(spark, d), _chosen(spark, d, "first"), "label", "vec_id").select("vec_id", "label")


def dedup_report(spark: SparkSession, d: str) -> DataFrame:
    return dedup.report(_stored(spark, d), _chosen(spark, d, "first"), "label")


def dedup_exact_documents(spark: SparkSession, d: str) -> DataFrame:
    return dedup.exact_duplicates(_docs(spark, d))


def similarity_matrix(spark: SparkSession, d: str) -> DataFrame:
    both = reorder.similarity_matrix(dedup.pairwise(_vectors(spark, d), "label", "vec_id"))
    return both.select("block", "i", "j", F.round("sim", 6).alias("sim"))


def sequential_reorder(spark: SparkSession, d: str) -> DataFrame:
    return reorder.reorder(_stored(spark, d), "label", "vec_id", "sequential")


def cluster_reorder(spark: SparkSession, d: str) -> DataFrame:
    return reorder.reorder(_stored(spark, d), "label", "vec_id", "cluster")


def adjacent_similarity(spark: SparkSession, d: str) -> DataFrame:
    return reorder.adjacent_similarity(_vectors(spark, d), "label", "vec_id").select("block", "n", F.round("avg_adjacent", 6).alias("avg_adjacent"))


def reconstruct_markdown(spark: SparkSession, d: str) -> DataFrame:
    return reorder.reconstruct(_split(spark, d), "original_position", include_comments=True)


def section_sizes(spark: SparkSession, d: str) -> DataFrame:
    return sections.section_sizes(_split(spark, d), 200)


def largest_sections(spark: SparkSession, d: str) -> DataFrame:
    return sections.largest_sections(_split(spark, d)).select("doc_id", "s1", "s2", "n_chunks", "tokens")


def section_pack_h3(spark: SparkSession, d: str) -> DataFrame:
    return sections.pack_by_h3(_split(spark, d), 150)


def section_reconstruct(spark: SparkSession, d: str) -> DataFrame:
    return sections.reconstruct_sections(_split(spark, d))


def section_rollup(spark: SparkSession, d: str) -> DataFrame:
    return sections.rollup(_chunks(spark, d))


def type_histogram(spark: SparkSession, d: str) -> DataFrame:
    return sections.type_histogram(_chunks(spark, d))


def distinct_headers(spark: SparkSession, d: str) -> DataFrame:
    return sections.distinct_headers(_chunks(spark, d))


def token_statistics(spark: SparkSession, d: str) -> DataFrame:
    return sections.token_statistics(_chunks(spark, d))


def oversized_chunks(spark: SparkSession, d: str) -> DataFrame:
    return sections.oversized(_chunks(spark, d), 200).select("doc_id", "chunk_id", "token_count")


def chunks_by_h1(spark: SparkSession, d: str) -> DataFrame:
    return sections.by_h1(_chunks(spark, d))


def chunks_by_h2(spark: SparkSession, d: str) -> DataFrame:
    return sections.by_h2(_chunks(spark, d))


def validate_preprocess(spark: SparkSession, d: str) -> DataFrame:
    return sections.validate(_split(spark, d), preprocess_then_split(spark, d))


def embed_cache_misses(spark: SparkSession, d: str) -> DataFrame:
    cache = spark.read.parquet(f"{d}/emb_cache.parquet").select("model", "text_hash")
    return embed.cache_misses(_chunks(spark, d), cache, "mdembed-base").select("model", "text_hash")


def embed_cache_stats(spark: SparkSession, d: str) -> DataFrame:
    cache = spark.read.parquet(f"{d}/emb_cache.parquet").select("model", "text_hash")
    return embed.cache_statistics(_chunks(spark, d), cache, "mdembed-base").select("requests", "hits", "misses", F.round("hit_rate", 6).alias("hit_rate"))


def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", embed.hashing_vector(F.col("text"), 16).alias("embedding"))


def attach_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk with the width of its vector and the sum of its finite values."""
    all_chunks = spark.read.parquet(f"{d}/chunks.parquet")
    vectors = all_chunks.where("embedding is not null").select("doc_id", "chunk_id", "embedding")
    finite = F.filter("embedding", lambda x: x.isNotNull() & ~F.isnan(x))
    total = F.aggregate(finite, F.lit(0.0), lambda t, x: t + x.cast("double"))
    return embed.attach(_chunks(spark, d), vectors).select("doc_id", "chunk_id", F.coalesce(F.size("embedding"), F.lit(-1)).alias("n"), F.round(total, 4).alias("total"))


def chunk_dict_round_trip(spark: SparkSession, d: str) -> DataFrame:
    chunks = spark.read.parquet(f"{d}/chunks.parquet").select("doc_id", "chunk_id", "content", *files.META, F.lit(None).cast("array<float>").alias("embedding")).distinct()
    return files.from_dict(files.to_dict(chunks)).drop("embedding")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and k[0] != "_" and k not in {"flagship", "queries", "oracle_sql"}}


def oracle_sql() -> dict[str, str]:
    return sql.statements(LIMIT, THRESHOLD)
