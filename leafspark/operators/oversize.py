"""Oversized chunks: list items, greedy packing, and the cascade of strategies.

The cascade and the list items run on whole chunks where they are scanned, without a shuffle.
The single steps also stand alone: packing is a fold over the chunk's own array of items, in
the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafspark.functions import kernels
from leafspark.functions.text import WS, is_blank, token_count
from leafspark.operators.chunking import HEADS, ROW_KINDS, ROW_NAMES, ROW_SCHEMA, chunk_rows, cut_rows

LIST_START = rf"^{WS}*(?:[-*]|\d+\.){WS}+"
KEY = ["doc_id", "chunk_id", "original_position"]


def list_items(chunks: DataFrame, keep_preamble: bool = False) -> DataFrame:
    """(doc_id, chunk_id, original_position, idx, item, depth, parent_idx, tokens) of every list item.

    Lines before the first item are dropped, as in the reproduced behaviour; keep_preamble
    makes them an item of depth 0 unless they are blank. Other lines belong to the item above
    them. depth is half the leading width, a tab counting four if there is one; parent_idx is
    the last earlier item one level up, null at depth 0. A null content has no items.
    """
    kinds = dict(chunks.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part, of, rows = b.slice(at, 500), [], []
                for i, t in enumerate(part.column(len(KEY)).to_pylist()):
                    items = kernels.list_items(t, keep_preamble)
                    up = kernels.parents([d for _, d in items])
                    rows += [(k, x, d, up[k], kernels.tokens(x)) for k, (x, d) in enumerate(items)]
                    of += [i] * len(items)
                own = [part.column(k).take(pa.array(of, pa.int32())) for k in range(len(KEY))]
                types = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * 5, types))], names=[*KEY, "idx", "item", "depth", "parent_idx", "tokens"])

    rows = chunks.where(F.col("content").isNotNull()).select(*KEY, F.col("content").cast("string").alias("content"))
    return rows.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in KEY) + ", idx int, item string, depth int, parent_idx int, tokens int")


def fold_groups(items: str, limit: int, by_depth: bool = False) -> F.Column:
    """An array with the group of every item of an ordered array of structs (t tokens, dep depth).

    Plain packing closes a group before an item that does not fit, and an item over the limit
    is a group of its own; by depth, only an item of depth 0 that does not fit starts a group.
    """
    alone = "false" if by_depth else f"x.t > {int(limit)}"
    new = (f"x.dep = 0 AND a.o AND a.t + x.t > {int(limit)}") if by_depth else f"a.t + x.t > {int(limit)}"
    step = f"""CASE WHEN {alone} THEN named_struct('t', 0, 'g', a.g + if(a.o, 2, 1), 'o', false, 'out', array_append(a.out, a.g + if(a.o, 1, 0)))
        WHEN {new} THEN named_struct('t', x.t, 'g', a.g + if(a.o, 1, 0), 'o', true, 'out', array_append(a.out, a.g + if(a.o, 1, 0)))
        ELSE named_struct('t', a.t + x.t, 'g', a.g, 'o', true, 'out', array_append(a.out, a.g)) END"""
    return F.expr(f"aggregate({items}, named_struct('t', 0, 'g', 0, 'o', false, 'out', cast(array() as array<int>)), (a, x) -> {step}).out")


def _packed(items: DataFrame, limit: int, sep: str, by_depth: bool = False) -> DataFrame:
    """(key, n_groups, pieces): the texts of each group, in order."""
    whole = items.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("idx", F.col("tokens").alias("t"), F.col("depth").alias("dep"), "item"))).alias("items"))
    grouped = whole.withColumn("g", fold_groups("items", limit, by_depth))
    texts = F.expr(f"transform(sequence(0, array_max(g)), j -> array_join(transform(filter(arrays_zip(items, g), z -> z.g = j), z -> z.items.item), '{sep}'))")
    return grouped.select(*KEY, (F.array_max("g") + 1).alias("n_groups"), texts.alias("pieces"))


def paragraphs(chunks: DataFrame) -> DataFrame:
    """(key, idx, item, depth, tokens): the paragraphs between empty lines that are not blank."""
    rows = chunks.select(*KEY, F.posexplode(F.split("content", "\n\n", -1)).alias("idx", "item")).where(~is_blank(F.col("item")))
    return rows.select(*KEY, "idx", "item", F.lit(0).alias("depth"), token_count(F.col("item")).alias("tokens"))


def pack_list_items(chunks: DataFrame, limit: int) -> DataFrame:
    return _packed(list_items(chunks), limit, "\\n")


def pack_by_depth(chunks: DataFrame, limit: int) -> DataFrame:
    return _packed(list_items(chunks), limit, "\\n", by_depth=True)


def pack_paragraphs(chunks: DataFrame, limit: int) -> DataFrame:
    return _packed(paragraphs(chunks), limit, "\\n\\n")


def split_oversized(chunks: DataFrame, limit: int = 1000) -> DataFrame:
    """Chunks, with those over the limit cut by the first strategy that applies; adds sub_index and strategy.

    Five or more items of several depths with two or more at depth 0: by depth, if that gives
    more than one group. Else five or more items: by items, even if one group stays. Else
    three or more paragraphs: by paragraphs. Else the chunk stays. Not recursive, so a piece
    may still exceed the limit. Pieces take over headers and position; their tokens are
    counted anew. Every chunk is cut where it is scanned: no join and no shuffle. A null
    token_count or content counts as within the limit.
    """
    kinds = dict(chunks.dtypes)
    names = ["doc_id", *ROW_NAMES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part, of, rows = b.slice(at, 500), [], []
                for i, (c, t, n) in enumerate(zip(*(part.column(k).to_pylist() for k in ("chunk_id", "content", "token_count")))):
                    own = cut_rows(c, t, n, limit if t is not None and n is not None else None)
                    rows += own
                    of += [i] * len(own)
                at_ = pa.array(of, pa.int32())
                new = dict(zip(["chunk_id", "content", "token_count", "sub_index", "strategy"], zip(*rows))) if rows else {}
                made = {k: pa.array(new.get(k, ()), kind) for k, kind in zip(ROW_NAMES, ROW_KINDS) if k in ("chunk_id", "content", "token_count", "sub_index", "strategy")}
                yield pa.RecordBatch.from_arrays([made[k] if k in made else part.column(k).take(at_) for k in names], names=names)

    held = chunks.select(*KEY, "content", *HEADS, F.col("token_count").cast("int").alias("token_count"))
    types = ", ".join(f"{n} {kinds[n]}" if n in kinds and n != "token_count" else x for n, x in zip(names, ["doc_id bigint", *ROW_SCHEMA.split(", ")]))
    return held.mapInArrow(run, types).select(*ORDER)


ORDER = ["doc_id", "chunk_id", "content", *HEADS, "original_position", "sub_index", "token_count", "strategy"]


def split_documents(docs: DataFrame, limit: int = 1000, split_levels=(1, 2, 3, 4, 5, 6)) -> DataFrame:
    """Header split and oversize handling together, in one pass over the texts."""
    return chunk_rows(docs, split_levels, limit).select(*ORDER)
