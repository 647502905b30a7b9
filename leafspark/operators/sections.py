"""Sections of chunks by header: groups, sizes, packing, reconstruction, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafspark.functions.text import strip


def named(h: str) -> F.Column:
    """A null or empty header is named as missing."""
    return F.coalesce(F.nullif(F.col(h), F.lit("")), F.lit(f"(No {h})"))


def section_sizes(chunks: DataFrame, max_tokens: int = 1000) -> DataFrame:
    """(doc_id, s1, s2, n_chunks, tokens, oversized, first_position) of every (h1, h2) section."""
    return chunks.groupBy("doc_id", named("h1").alias("s1"), named("h2").alias("s2")).agg(F.count("*").alias("n_chunks"), F.coalesce(F.sum("token_count"), F.lit(0)).cast("long").alias("tokens"), F.min("original_position").alias("first_position")).withColumn("oversized", F.col("tokens") > max_tokens)


def largest_sections(chunks: DataFrame, top: int = 10) -> DataFrame:
    """The sections with the most tokens, ties by document and header."""
    return section_sizes(chunks).orderBy(F.desc("tokens"), "doc_id", "s1", "s2").limit(top)


def pack_by_h3(chunks: DataFrame, max_tokens: int = 1000) -> DataFrame:
    """(doc_id, s1, s2, h3, subsection, tokens): h3 groups packed in order of appearance.

    A group that does not fit starts a subsection unless that one is still empty; a group over
    the limit is never cut. The fold runs over a section's h3 groups, not its chunks.
    """
    h3 = chunks.groupBy("doc_id", named("h1").alias("s1"), named("h2").alias("s2"), named("h3").alias("s3")).agg(F.coalesce(F.sum("token_count"), F.lit(0)).cast("int").alias("t"), F.min("original_position").alias("p"))
    whole = h3.groupBy("doc_id", "s1", "s2").agg(F.array_sort(F.collect_list(F.struct("p", "s3", "t"))).alias("g"))
    fold = F.expr(f"aggregate(g, named_struct('t', 0, 'k', 0, 'e', true, 'out', cast(array() as array<int>)), (a, x) -> if(not a.e and a.t + x.t > {int(max_tokens)}, named_struct('t', x.t, 'k', a.k + 1, 'e', false, 'out', array_append(a.out, a.k + 1)), named_struct('t', a.t + x.t, 'k', a.k, 'e', false, 'out', array_append(a.out, a.k)))).out")
    return whole.withColumn("o", fold).select("doc_id", "s1", "s2", F.explode(F.arrays_zip("g", "o")).alias("z")).select("doc_id", "s1", "s2", F.col("z.g.s3").alias("h3"), F.col("z.o").alias("subsection"), F.col("z.g.t").alias("tokens"))


def reconstruct_sections(chunks: DataFrame) -> DataFrame:
    """(doc_id, text): sections by h1 then h2, headings written where they change, contents that start with # left out.

    A missing heading sorts first and writes no heading line.
    """
    key = Window.partitionBy("doc_id").orderBy(F.asc_nulls_first("h1"), F.asc_nulls_first("h2"), "original_position", "chunk_id")
    rows = chunks.select("doc_id", "h1", "h2", strip(F.col("content")).alias("body"), "original_position", "chunk_id")
    rows = rows.withColumns({"place": F.row_number().over(key), "p1": F.lag("h1").over(key), "p2": F.lag("h2").over(key)})
    first, new1 = F.col("place") == 1, ~F.col("h1").eqNullSafe(F.col("p1"))
    top = F.when((first | new1) & F.col("h1").isNotNull(), F.concat(F.lit("# "), F.col("h1")))
    sub = F.when((first | new1 | ~F.col("h2").eqNullSafe(F.col("p2"))) & F.col("h2").isNotNull(), F.concat(F.lit("## "), F.col("h2")))
    parts = F.filter(F.array(top, sub, F.when(~F.col("body").startswith("#") & (F.col("body") != ""), F.col("body"))), lambda x: x.isNotNull())
    return rows.groupBy("doc_id").agg(F.concat(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", parts.alias("p")))), lambda x: x["p"])), "\n\n"), F.lit("\n")).alias("text"))


def type_histogram(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(F.coalesce(F.lower("element_type"), F.lit("None")).alias("element_type")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "element_type")


def distinct_headers(chunks: DataFrame) -> DataFrame:
    """(level, header): each header once per level; the levels' rows combine before the shuffle."""
    heads = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.col(f"h{k}").alias("header")) for k in (1, 2, 3)))).alias("x")
    return chunks.select(heads).select("x.*").where("header is not null and header <> ''").distinct()


def token_statistics(chunks: DataFrame) -> DataFrame:
    """(avg_tokens, min_tokens, max_tokens), 0 for no chunks."""
    return chunks.agg(F.round(F.coalesce(F.avg("token_count"), F.lit(0.0)), 6).alias("avg_tokens"), F.coalesce(F.min("token_count"), F.lit(0)).alias("min_tokens"), F.coalesce(F.max("token_count"), F.lit(0)).alias("max_tokens"))


def oversized(chunks: DataFrame, max_tokens: int = 1000) -> DataFrame:
    return chunks.where(F.col("token_count") > max_tokens)


def by_h1(chunks: DataFrame, top: int = 5) -> DataFrame:
    """(s1, n_chunks, tokens, n_h2) of the h1 with the most chunks."""
    return chunks.groupBy(named("h1").alias("s1")).agg(F.count("*").alias("n_chunks"), F.coalesce(F.sum("token_count"), F.lit(0)).cast("long").alias("tokens"), F.count_distinct("h2").alias("n_h2")).orderBy(F.desc("n_chunks"), "s1").limit(top)


def by_h2(chunks: DataFrame, top: int = 10) -> DataFrame:
    return chunks.groupBy(named("h1").alias("s1"), named("h2").alias("s2")).agg(F.count("*").alias("n_chunks"), F.coalesce(F.sum("token_count"), F.lit(0)).cast("long").alias("tokens")).orderBy(F.desc("n_chunks"), "s1", "s2").limit(top)


def rollup(chunks: DataFrame) -> DataFrame:
    """Chunks and tokens by h1, h2 and in total; null marks a total."""
    return chunks.select(named("h1").alias("s1"), named("h2").alias("s2"), "token_count").rollup("s1", "s2").agg(F.count("*").alias("n_chunks"), F.coalesce(F.sum("token_count"), F.lit(0)).cast("long").alias("tokens"))


def validate(before: DataFrame, after: DataFrame) -> DataFrame:
    """(check, lost, added): contents by hash with their numbers that one side has more of than the other."""
    count = lambda d, n: d.groupBy(F.sha2("content", 256).alias("h")).agg(F.count("*").alias(n), F.sum("token_count").alias(f"{n}_tokens"))
    j = count(before, "a").join(count(after, "b"), "h", "full")
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    return j.agg(F.coalesce(F.sum(F.greatest(a - b, F.lit(0))), F.lit(0)).alias("lost"), F.coalesce(F.sum(F.greatest(b - a, F.lit(0))), F.lit(0)).alias("added"), F.coalesce(F.sum("a_tokens"), F.lit(0)).alias("tokens_before"), F.coalesce(F.sum("b_tokens"), F.lit(0)).alias("tokens_after"))
