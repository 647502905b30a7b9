"""Header-aware splitting.

Setting a header level clears all deeper ones, so the deepest open level is the previous
header's: a header starts a chunk if its level is a split level, a header came before, and
its level is not deeper than that one's.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafspark.functions import kernels
from leafspark.functions.text import WS, is_blank, strip
from leafspark.operators.lines import explode_lines, joined, upto

HEADER = rf"(?s)^(#{{1,6}}){WS}+(.+)\z"
LEVELS = (1, 2, 3, 4, 5, 6)
HEADS = [f"h{k}" for k in LEVELS]


def header_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, level, header): level and header are null for other lines; a header may be empty."""
    line = F.col("line")
    is_header = line.rlike(HEADER)
    return explode_lines(docs).select("doc_id", "line_no", "line", F.when(is_header, F.length(F.regexp_extract(line, HEADER, 1))).alias("level"), F.when(is_header, strip(F.regexp_extract(line, HEADER, 2))).alias("header"))


def cascade(lines: DataFrame, keys: tuple[str, ...] = ("doc_id",), order: str = "line_no") -> DataFrame:
    """Adds h1..h6: the open header of each level at each line, from columns level and header."""
    w = upto(*keys, order=order)
    at = {}
    for k in LEVELS:
        at[f"at{k}"] = F.last(F.when(F.col("level") == k, F.struct(F.col(order).alias("n"), F.col("header").alias("t"))), ignorenulls=True).over(w)
        at[f"cut{k}"] = F.last(F.when(F.col("level") < k, F.col(order)), ignorenulls=True).over(w)
    out = lines.withColumns(at)
    heads = {f"h{k}": F.when(F.col(f"at{k}.n") > F.coalesce(F.col(f"cut{k}"), F.lit(-1)), F.col(f"at{k}.t")) for k in LEVELS}
    return out.withColumns(heads).drop(*at)


def raw_chunks(docs: DataFrame, split_levels: Iterable[int] = LEVELS) -> DataFrame:
    """(doc_id, original_position, content, h1..h6): chunks that are not blank, numbered before blank ones go."""
    levels = list(split_levels)
    if not levels or any(k not in LEVELS for k in levels):
        raise ValueError("split levels are within 1 and 6")
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    lines = header_lines(docs).withColumn("previous", F.last("level", ignorenulls=True).over(before))
    starts = F.coalesce(F.col("level").isin(levels) & (F.col("level") <= F.col("previous")), F.lit(False)).cast("int")
    numbered = cascade(lines.withColumn("starts", starts)).withColumn("original_position", F.sum("starts").over(upto("doc_id")).cast("int"))
    whole = numbered.groupBy("doc_id", "original_position").agg(joined("line", "line_no").alias("content"), F.max_by(F.struct(*HEADS), "line_no").alias("h"))
    return whole.where(~is_blank(F.col("content"))).select("doc_id", "original_position", "content", "h.*")


def split(docs: DataFrame, split_levels: Iterable[int] = LEVELS) -> DataFrame:
    """Chunks of every document without oversize handling; blank documents, null ids and null texts give no row.

    Columns: doc_id, chunk_id, content, h1..h6, original_position, token_count. The rules are
    those of raw_chunks(); as a document is one row, they run in the scan's tasks, without a
    shuffle. A document sent twice gives its chunks twice.
    """
    return chunk_rows(docs, split_levels).drop("sub_index", "strategy")


def chunk_rows(docs: DataFrame, split_levels: Iterable[int] = LEVELS, limit: int | None = None) -> DataFrame:
    """The chunks of split() with sub_index and strategy, those over the limit cut by kernels.pieces()."""
    levels = frozenset(split_levels)
    if not levels or not levels <= set(LEVELS):
        raise ValueError("split levels are within 1 and 6")
    key = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part, of, rows = b.slice(at, 500), [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    for position, content, heads in kernels.header_chunks(t, levels):
                        own = cut_rows(kernels.chunk_id(content, position), content, kernels.tokens(content), limit)
                        rows += [(c, text, *heads, position, n, sub, how) for c, text, n, sub, how in own]
                        of += [i] * len(own)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of, pa.int32())), *(pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * len(ROW_KINDS), ROW_KINDS))], names=["doc_id", *ROW_NAMES])

    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {key}, {ROW_SCHEMA}")


ROW_SCHEMA = "chunk_id string, content string, h1 string, h2 string, h3 string, h4 string, h5 string, h6 string, original_position int, token_count int, sub_index int, strategy string"
ROW_NAMES = [x.split()[0] for x in ROW_SCHEMA.split(", ")]
ROW_KINDS = [pa.int32() if x.endswith(" int") else pa.string() for x in ROW_SCHEMA.split(", ")]


def cut_rows(chunk: str | None, content: str, n: int, limit: int | None) -> list[tuple]:
    """(chunk_id, content, token_count, sub_index, strategy) of a chunk, or of its pieces if it is over the limit."""
    how, parts = kernels.pieces(content, limit) if limit is not None and n > limit else ("keep", [])
    mark = "-d" if how == "depth" else "-"
    named = lambda i: None if chunk is None else f"{chunk}{mark}{i}"
    return [(named(i), p, kernels.tokens(p), i, how) for i, p in enumerate(parts)] or [(chunk, content, n, None, how)]


def split_statistics(chunks: DataFrame) -> DataFrame:
    """(doc_id, total_chunks, total_tokens, max_chunk_tokens, headers_used): levels with a header that is not empty."""
    used = F.array_sort(F.flatten(F.collect_set(F.filter(F.array(*(F.when(F.col(h) != "", F.lit(h)) for h in HEADS)), lambda x: x.isNotNull()))))
    return chunks.groupBy("doc_id").agg(F.count("*").alias("total_chunks"), F.sum("token_count").alias("total_tokens"), F.max("token_count").alias("max_chunk_tokens"), F.array_join(F.array_distinct(used), ",").alias("headers_used"))


def blank_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, reason): documents that split to nothing, for quarantine."""
    return docs.where(F.coalesce(is_blank(F.col("text")), F.lit(True))).select("doc_id", F.when(F.col("text").isNull(), "null text").otherwise("blank text").alias("reason"))
