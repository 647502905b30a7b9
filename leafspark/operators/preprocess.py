"""Promoting stand-alone bold lines to headings.

Whole texts are rewritten in the scan's tasks; where the title lines are the result they come
from windows that share one partitioning and order, so that a plan has one exchange and sort.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafspark.functions import kernels
from leafspark.functions.text import WS, is_blank, strip, words
from leafspark.operators.lines import explode_lines, upto

BOLD = rf"(?s)^{WS}*\*\*(.+?)\*\*{WS}*\z"
#: The ordered branch holds a literal caret, as the reproduced behaviour does: ordered items are no list here.
LIST_LINE = rf"^{WS}*[-*+]{WS}+|\^{WS}*\d+\.{WS}+"


@dataclass(frozen=True)
class PreprocessOptions:
    max_title_length: int = 80
    require_empty_lines: bool = True
    min_capitalization_ratio: float = 0.1
    detect_title_case: bool = True
    preserve_code_blocks: bool = True
    preserve_lists: bool = True
    preserve_tables: bool = True

    def __post_init__(self) -> None:
        if self.max_title_length < 1:
            raise ValueError("max_title_length must be at least 1")
        if not 0 <= self.min_capitalization_ratio <= 1:
            raise ValueError("min_capitalization_ratio must be within 0 and 1")


def bold_titles(docs: DataFrame, options: PreprocessOptions = PreprocessOptions()) -> DataFrame:
    """(doc_id, line_no, line, title, level): title and level are null for lines that stay."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    to_here, before = upto("doc_id"), Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    line = F.col("line")
    bare = strip(line)
    flags = explode_lines(docs).withColumns(
        {
            "fence": bare.startswith("```").cast("int"),
            "blank": is_blank(line),
            "hashes": F.when(bare.startswith("#"), F.length(F.regexp_extract(bare, r"^(#+)", 1))),
            "bold": F.when(line.rlike(BOLD), F.regexp_extract(line, BOLD, 1)),
        }
    ).withColumns(
        {
            "in_code": F.sum("fence").over(to_here) % 2 == 1,
            "prev_blank": F.coalesce(F.lag("blank").over(w), F.lit(True)),
            "next_blank": F.coalesce(F.lead("blank").over(w), F.lit(True)),
            "raw_level": F.last("hashes", ignorenulls=True).over(before),
        }
    )
    b = F.col("bold")
    letters = F.regexp_replace(b, r"[^\p{L}]", "")
    upper = F.regexp_replace(letters, r"[^\p{Lu}]", "")
    n_words = F.size(words(b))
    ok = b.isNotNull() & (F.length(b) <= options.max_title_length) & letters.rlike(r"^\p{Lu}")
    if options.preserve_code_blocks:
        ok &= ~F.col("in_code")
    if options.preserve_lists:
        ok &= ~line.rlike(LIST_LINE)
    if options.preserve_tables:
        ok &= ~line.contains("|")
    if options.require_empty_lines:
        ok &= F.col("prev_blank") & F.col("next_blank")
    enough = F.length(upper) / F.length(letters) >= options.min_capitalization_ratio
    if options.detect_title_case:
        capital = F.size(F.filter(words(b), lambda x: x.rlike(r"^\p{Lu}")))
        enough = (n_words == 1) | ((n_words > 1) & (capital / n_words >= 0.5)) | enough
    marked = flags.withColumn("is_title", F.coalesce(ok & enough, F.lit(False))).withColumn("nth", F.coalesce(F.sum(F.col("is_title").cast("int")).over(before), F.lit(0)))
    level = F.when(F.col("raw_level").isNotNull(), F.least(F.col("raw_level") + 1, F.lit(3))).when(F.col("nth") % 2 == 0, F.lit(2)).otherwise(F.lit(3)).cast("int")
    return marked.select("doc_id", "line_no", "line", F.when(F.col("is_title"), b).alias("title"), F.when(F.col("is_title"), level).alias("level"))


def to_heading(text: F.Column, level: F.Column) -> F.Column:
    """A heading line; null for a level outside 1 to 6."""
    return F.when(level.between(1, 6), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text))


def preprocess(docs: DataFrame, options: PreprocessOptions = PreprocessOptions()) -> DataFrame:
    """(doc_id, text) with promoted headings; all other lines stay byte by byte. Null ids and texts give no row.

    One pass without a shuffle: a document is one row. A document sent twice gives two rows.
    """
    o = options
    args = (o.max_title_length, o.require_empty_lines, o.min_capitalization_ratio, o.detect_title_case, o.preserve_code_blocks, o.preserve_lists, o.preserve_tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([kernels.promote(t, *args) for t in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, text string")
