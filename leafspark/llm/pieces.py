"""Splitting oversized items at natural boundaries.

A text is a sequence of words with token weights; prefix sums give the tokens of any run of
words, and sorted arrays hold the words before which a natural boundary lies (list items,
paragraphs, lines, sentences). From the start of a piece the last word that fits is found by
binary search in the prefix sums, then the last boundary up to there by binary search in the
boundary arrays, the strongest kind first; with no boundary the cut is hard. The next piece
starts the overlap's tokens before the cut, and always after the start of this piece.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\S+")
LIST_ITEM = re.compile(r"(?m)^[ \t]*(?:[-*+]|\d+[.)])[ \t]")
PARAGRAPH = re.compile(r"\n[ \t\r]*\n\s*")
LINE = re.compile(r"\r\n?|\n")
SENTENCE = re.compile(r"(?<=[.!?。…])[\"')\]]*\s+")
#: A stronger boundary is taken over a weaker one only beyond this share of the room.
LEAST_FILL = 0.5


def word_tokens(n_words: int) -> int:
    """floor(1.3 x words), in whole numbers."""
    return 13 * n_words // 10


def cut_points(text: str, limit: int, overlap: int, weigh: Callable[[list[str]], list[int]] | None = None) -> list[tuple[int, int, int]]:
    """(first character, character after the last, tokens) of each piece; [] for a text within the limit.

    Pieces cover the whole text, and without overlap they join to it again. The default
    weight is 1.3 tokens a word, of which a piece's floor counts; weigh gives other whole
    weights. A single word over the limit is a piece of its own.
    """
    starts = [m.start() for m in WORD.finditer(text)]
    n = len(starts)
    if weigh is None:
        tenths, unit = 13 * np.arange(n + 1, dtype=np.int64), 10
    else:
        tenths, unit = np.concatenate([[0], np.cumsum(np.array(weigh(WORD.findall(text)), np.int64))]), 1
    if n == 0 or tenths[-1] // unit <= limit:
        return []
    at = lambda positions: sorted({bisect.bisect_left(starts, p) for p in positions} - {0, n})
    kinds = [at(m.start() for m in LIST_ITEM.finditer(text)), at(m.end() for m in PARAGRAPH.finditer(text)), at(m.end() for m in LINE.finditer(text)), at(m.end() for m in SENTENCE.finditer(text))]
    out, s = [], 0
    while True:
        e = int(np.searchsorted(tenths, tenths[s] + limit * unit + unit - 1, "right")) - 1
        e = max(e, s + 1)
        if e < n:
            least = s + int(LEAST_FILL * (e - s))
            for found in kinds:
                i = bisect.bisect_right(found, e) - 1
                if i >= 0 and found[i] > least:
                    e = found[i]
                    break
        out.append((starts[s] if s else 0, starts[e] if e < n else len(text), int((tenths[e] - tenths[s]) // unit)))
        if e >= n:
            return out
        s = max(s + 1, int(np.searchsorted(tenths, tenths[e] - overlap * unit, "left")))
        s = min(s, e)


def split_oversized(chunks: DataFrame, limit: int = 1000, overlap: int = 50, key: str = "chunk_id", text: str = "content", weigh: Callable[[list[str]], list[int]] | None = None) -> DataFrame:
    """(key, piece, n_pieces, start_char, end_char, tokens, content) of every item over the limit, whatever its stored count says.

    Items within the limit, null, empty and blank texts and null keys give no row. Rows sent
    twice give their pieces once. limit >= 1 and 0 <= overlap < limit.
    """
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("limit >= 1 and 0 <= overlap < limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, rows = b.slice(at, 256), []
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    cuts = cut_points(t, limit, overlap, weigh)
                    rows += [(k, i, len(cuts), a, z, n, t[a:z]) for i, (a, z, n) in enumerate(cuts)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, p) for x, p in zip(zip(*rows), kinds)], names=names)

    names = ["k", "piece", "n_pieces", "start_char", "end_char", "tokens", "content"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
    rows = chunks.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(text).cast("string").alias("t"))
    if weigh is None:  # fewer characters cannot hold enough words, each with a space
        rows = rows.where(F.length("t") >= 2 * ((limit + 1) * 10 // 13) - 1)
    found = rows.mapInArrow(run, "k string, piece int, n_pieces int, start_char int, end_char int, tokens int, content string")
    return found.dropDuplicates(["k", "piece", "start_char", "end_char"]).withColumnRenamed("k", key)
