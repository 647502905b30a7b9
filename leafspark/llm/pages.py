"""Lines that pages of a host share, by differencing pages of like paths.

Each page is paired with its neighbour in the order of paths within its host, that of the two
with the longer common beginning of the path. The lines of both are aligned by their longest
common subsequence; shared lines are navigation, headers and footers of the host, and are
deleted. What is left is the page's own.

The order of paths comes from a range partitioning on (host, path, id), which splits a host
with very many pages; only ids and paths are ordered, texts are joined to the pairs by id.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafspark.session import cut


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Places of the lines of a in the longest common subsequence of both; blank lines don't count.

    By the longest increasing run of matching places, in (matches) x log time.
    """
    at: dict[str, list[int]] = defaultdict(list)
    for j in range(len(b) - 1, -1, -1):
        if b[j].strip():
            at[b[j]].append(j)  # the last place first, so that a line takes one place only
    ends: list[int] = []
    tails: list[tuple | None] = []
    for i, line in enumerate(a):
        for j in at.get(line, ()) if line.strip() else ():
            k = bisect.bisect_left(ends, j)
            link = (i, tails[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                tails.append(link)
            else:
                ends[k], tails[k] = j, link
    out, link = set(), tails[-1] if tails else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def neighbours_by_path(pages: DataFrame, host: str, path: str, key: str = "doc_id") -> DataFrame:
    """(key, other): the neighbour of every page of its host in the order of path and key, that with the longer common beginning of the path, else the one before.

    Null keys, hosts and paths give no row, nor does the only page of a host.
    """
    rows = pages.where(F.col(key).isNotNull() & F.col(host).isNotNull() & F.col(path).isNotNull()).select(F.col(key).alias("k"), F.lower(F.trim(host)).alias("h"), F.col(path).alias("p"))
    ranged = cut(rows.groupBy("k").agg(F.min(F.struct("h", "p")).alias("x")).select("k", "x.h", "x.p").repartitionByRange("h", "p", "k").withColumn("part", F.spark_partition_id()))
    me = F.struct("p", "k")
    w = Window.partitionBy("part", "h").orderBy("p", "k")
    near = ranged.withColumns({"before": F.lag(me).over(w), "after": F.lead(me).over(w)})
    # at the ends of a part the neighbour is the end of another; there are two ends a part and host
    ends = ranged.groupBy("part", "h").agg(F.min(me).alias("low"), F.max(me).alias("high"))
    v = Window.partitionBy("h").orderBy("part")
    ends = ends.select("part", "h", F.lag("high").over(v).alias("last"), F.lead("low").over(v).alias("next")).where("last is not null or next is not null")
    j = near.join(ends, ["part", "h"], "left").select("k", "p", F.coalesce("before", "last").alias("before"), F.coalesce("after", "next").alias("after"))
    common = lambda q: F.coalesce(F.length(F.regexp_extract(F.concat("p", F.lit("\n"), q), r"^([^\n]*)[^\n]*\n\1", 1)), F.lit(-1))
    return j.select(F.col("k").alias(key), F.when(common(F.col("after.p")) > common(F.col("before.p")), F.col("after.k")).otherwise(F.coalesce("before.k", "after.k")).alias("other")).where("other is not null")


def differenced(pages: DataFrame, host: str, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, other, n_lines, n_shared, own_text): each page without the lines that it shares with its neighbour.

    Null texts and pages without a neighbour give no row; an empty text has no lines to share.
    """
    pairs = neighbours_by_path(pages, host, path, key)
    texts = pages.where(F.col(key).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min(text).alias("t"))
    both = pairs.join(texts, F.col(key) == F.col("_k")).select(key, "other", F.col("t").alias("a")).join(texts, F.col("other") == F.col("_k")).select(key, "other", "a", F.col("t").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, own = [], [], []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                lines = a.splitlines()
                shared = shared_lines(lines, b.splitlines())
                n.append(len(lines))
                gone.append(len(shared))
                own.append("\n".join(x for i, x in enumerate(lines) if i not in shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int32()), pa.array(gone, pa.int32()), pa.array(own, pa.string())], names=[key, "other", "n_lines", "n_shared", "own_text"])

    kind = dict(pages.dtypes)[key]
    return both.mapInArrow(run, f"{key} {kind}, other {kind}, n_lines int, n_shared int, own_text string")
