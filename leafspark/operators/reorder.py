"""Reordering the chunks of a document by similarity, and putting documents together again.

The two orders are inherently sequential within a document, so they run as Arrow grouped
maps, one document a task at a time; documents run in parallel. Similarities are computed a
row at a time where they are needed, so that a document of n items takes n x d numbers and
time in proportion to n x n x d. Only for clusters of up to max_items items is there a matrix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafspark.functions.text import strip
from leafspark.functions.vectors import cosine, usable

STRATEGIES = ("sequential", "cluster")


def chain(x: np.ndarray) -> list[int]:
    """Start at 0; go on to the most similar item (of unit vectors) not visited yet, of equal ones the first."""
    n, order = len(x), [0]
    left = np.ones(n, bool)
    left[0] = False
    for _ in range(n - 1):
        # einsum sums every row alike, so that equal items are equally similar
        row = np.where(left, np.einsum("ij,j->i", x, x[order[-1]]), -np.inf)
        order.append(int(row.argmax()))
        left[order[-1]] = False
    return order


def average_linkage(d: np.ndarray, k: int) -> list[int]:
    """Flat clusters, at most k, by average linkage: merges go in order of height, and equal heights merge together.

    Merges are found along chains of nearest neighbours, in time in proportion to n x n.
    """
    n = len(d)
    d = (d + d.T) / 2  # a chain ends only where distances are the same both ways
    np.fill_diagonal(d, np.inf)
    size, merges, path, alive = np.ones(n), [], [], np.ones(n, bool)
    while len(merges) < n - 1:
        path = path or [int(alive.argmax())]
        i = path[-1]
        j = int(d[i].argmin())
        if len(path) < 2 or d[i, path[-2]] > d[i, j]:
            path.append(j)
            continue
        a, b = sorted(path[-2:])
        del path[-2:]
        merges.append((d[a, b], a, b))
        row = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        row[[a, b]] = np.inf
        d[a], d[:, a] = row, row
        d[b], d[:, b] = np.inf, np.inf
        size[a] += size[b]
        alive[b] = False
    return _flat(n, merges, k)


def average_linkage_of_vectors(x: np.ndarray, k: int) -> list[int]:
    """As average_linkage of the clipped 1 - x @ x.T, for unit vectors, in n x d memory.

    The mean similarity of two clusters is the product of their mean vectors. Merges are found
    along chains of nearest neighbours, which for average linkage gives the same tree.
    """
    n = len(x)
    mean, size, alive, merges, path = x.astype(float).copy(), np.ones(n), np.ones(n, bool), [], []
    while len(merges) < n - 1:
        path = path or [int(alive.argmax())]
        i = path[-1]
        d = np.where(alive, np.clip(1 - np.einsum("ij,j->i", mean, mean[i]), 0, 2), np.inf)
        d[i] = np.inf
        j = int(d.argmin())
        if len(path) < 2 or d[path[-2]] > d[j]:
            path.append(j)
            continue
        a, b = sorted(path[-2:])
        del path[-2:]
        merges.append((d[j], a, b))
        mean[a] = (size[a] * mean[a] + size[b] * mean[b]) / (size[a] + size[b])
        size[a] += size[b]
        alive[b] = False
    return _flat(n, merges, k)


def _flat(n: int, merges: list[tuple], k: int) -> list[int]:
    """Clusters, at most k, from the merges (height, item, item)."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    merges.sort(key=lambda m: m[0])
    left, at = n, 0
    while left > k and at < len(merges):
        height = merges[at][0]
        while at < len(merges) and merges[at][0] <= height:
            a, b = find(merges[at][1]), find(merges[at][2])
            if a != b:
                root[max(a, b)] = min(a, b)
                left -= 1
            at += 1
    return [find(x) for x in range(n)]


def cluster_count(n: int) -> int:
    """Fixed rule: min(n, 3) up to 5 items, min(n // 3, 5) up to 20, else min(n // 5, 7)."""
    return min(n, 3) if n <= 5 else min(n // 3, 5) if n <= 20 else min(n // 5, 7)


def cluster_order(s: np.ndarray) -> list[int]:
    """Clusters in the order of their first item, items in their order."""
    n = len(s)
    if n == 1:
        return [0]
    label = average_linkage(np.clip(1 - s, 0, 2), cluster_count(n))
    return sorted(range(n), key=lambda i: (label[i], i))


def cluster_order_of_vectors(x: np.ndarray) -> list[int]:
    """As cluster_order of x @ x.T, without that matrix."""
    label = average_linkage_of_vectors(x, cluster_count(len(x)))
    return sorted(range(len(x)), key=lambda i: (label[i], i))


def reorder(chunks: DataFrame, block: str, item: str, strategy: str = "sequential", vec: str = "embedding", max_items: int = 5_000, strict: bool = False) -> DataFrame:
    """(block, item, new_position): a permutation of each block's usable items; item is the order to start from.

    Blocks without usable vectors give no row; blocks over max_items are clustered without a
    matrix, with the same result. strict raises if there is nothing to reorder.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {STRATEGIES}")
    if strict and chunks.where(usable(F.col(vec))).isEmpty():
        raise ValueError("nothing to reorder")
    kinds = dict(chunks.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item", kind="stable")
        x = np.stack(rows["v"].to_numpy()).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        o = chain(x) if strategy == "sequential" else cluster_order(x @ x.T) if len(x) <= max_items else cluster_order_of_vectors(x)
        return pd.DataFrame({"block": rows["block"].to_numpy()[o], "item": rows["item"].to_numpy()[o], "new_position": np.arange(len(rows), dtype=np.int32)})

    base = chunks.where(usable(F.col(vec))).select(F.col(block).alias("block"), F.col(item).alias("item"), F.col(vec).alias("v"))
    return base.groupBy("block").applyInPandas(run, f"block {kinds[block]}, item {kinds[item]}, new_position int")


def similarity_matrix(pairs: DataFrame) -> DataFrame:
    """Both directions of (block, i, j, sim)."""
    return pairs.select("block", "i", "j", "sim").union(pairs.select("block", F.col("j").alias("i"), F.col("i").alias("j"), "sim"))


def adjacent_similarity(ordered: DataFrame, block: str, order: str, vec: str = "embedding") -> DataFrame:
    """(block, n, avg_adjacent): the mean cosine of neighbours in the order; 1 for fewer than two items."""
    w = Window.partitionBy(block).orderBy(order)
    s = ordered.withColumn("s", cosine(F.lag(vec).over(w), F.col(vec)))
    return s.groupBy(F.col(block).alias("block")).agg(F.count("*").alias("n"), F.coalesce(F.avg("s"), F.lit(1.0)).alias("avg_adjacent"))


def reconstruct(chunks: DataFrame, order: str, include_comments: bool = False) -> DataFrame:
    """(doc_id, text): stripped contents in order with an empty line between, and one newline at the end at least."""
    w = Window.partitionBy("doc_id")
    place = F.row_number().over(w.orderBy(order)) - 1
    rows = chunks.select("doc_id", strip(F.col("content")).alias("body"), "original_position", place.alias("place"), F.count("*").over(w).alias("n"))
    comment = F.concat(F.lit("<!-- Original position: "), F.col("original_position").cast("string"), F.lit(", Reordered position: "), F.col("place").cast("string"), F.lit(" -->\n"))
    parts = F.filter(F.array(comment if include_comments else F.lit(None).cast("string"), F.when(F.col("body") != "", F.col("body")), F.when(F.col("place") < F.col("n") - 1, F.lit(""))), lambda x: x.isNotNull())
    whole = rows.groupBy("doc_id").agg(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", parts.alias("p")))), lambda x: x["p"])), "\n").alias("t"))
    return whole.select("doc_id", F.when(F.col("t").endswith("\n"), F.col("t")).otherwise(F.concat("t", F.lit("\n"))).alias("text"))
