"""Documents as typed elements: a block grammar on lines, with the header cascade and enrichment.

The grammar is our own: fenced code, headers, list items (with the lines that follow them),
table rows and paragraphs between blank lines. Its contract is the element model: one row an
element, the open headers at it, its type, depth, sequence number, code flag and tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafspark.functions import kernels
from leafspark.functions.text import chunk_id, sequence_number, strip, token_count
from leafspark.operators.chunking import HEADS, cascade

#: Element categories and the types they become; any other is narrative_text.
TYPES = {"Title": "title", "Header": "header", "NarrativeText": "narrative_text", "ListItem": "list_item", "CodeSnippet": "code_snippet"}


def element_type(category: F.Column, sequence: F.Column) -> F.Column:
    """A sequence number makes any element a procedure step; unknown categories are narrative text."""
    named = F.lit("narrative_text")
    for k, v in TYPES.items():
        named = F.when(category == k, F.lit(v)).otherwise(named)
    return F.when(sequence.isNotNull(), F.lit("procedure_step")).otherwise(named)


def header_level(depth: F.Column) -> F.Column:
    """category depth + 1 within 1 to 6, else 1."""
    return F.when((depth + 1).between(1, 6), depth + 1).otherwise(F.lit(1)).cast("int")


def is_code_block(text: F.Column, category: F.Column) -> F.Column:
    return F.coalesce(strip(text).startswith("```") | (category == "CodeSnippet"), F.lit(False))


def blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, element_no, category, category_depth, text, h1..h6) of the blocks that are not blank.

    One pass without a shuffle: a document is one row. Null ids and texts give no row.
    """
    names = ["doc_id", "element_no", "category", "category_depth", "text", *HEADS]
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.string(), *[pa.string()] * 6]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part, of, rows = b.slice(at, 500), [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    found = kernels.elements(t)
                    rows += [(k, c, d, x, *h) for k, (c, d, x, h) in enumerate(found)]
                    of += [i] * len(found)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of, pa.int32())), *(pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds))], names=names)

    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, element_no int, category string, category_depth int, text string, " + ", ".join(f"{h} string" for h in HEADS))


def enrich(elements: DataFrame) -> DataFrame:
    """Elements of any source with type, headers (a title carries itself), depth, sequence number, code flag, tokens and id."""
    title = F.col("category") == "Title"
    levelled = elements.select("doc_id", "element_no", "category", "category_depth", "text", F.when(title, header_level(F.coalesce("category_depth", F.lit(-1)))).alias("level"), F.when(title, F.col("text")).alias("header"))
    return _described(cascade(levelled, order="element_no"))


def _described(rows: DataFrame) -> DataFrame:
    number = sequence_number(F.col("text"))
    return rows.select(
        "doc_id", chunk_id(F.col("text"), F.col("element_no")).alias("chunk_id"), F.col("text").alias("content"), *HEADS, F.col("element_no").alias("original_position"), token_count(F.col("text")).alias("token_count"),
        F.coalesce("category_depth", F.lit(0)).alias("depth_level"), number.alias("sequence_number"), is_code_block(F.col("text"), F.col("category")).alias("is_inside_code_block"), element_type(F.col("category"), number).alias("element_type"),
    )


def parse(docs: DataFrame) -> DataFrame:
    """Documents to enriched elements; blank documents give no row."""
    return _described(blocks(docs))
