"""Most similar vectors for every vector.

Learned partitions: on a bounded sample of the vectors of each collection the graph of
nearest neighbours is built and cut into balanced parts, and a linear softmax classifier is
trained to tell a vector's part. Every vector of the collection is indexed in its most
probable part; every query is sent to its PROBES most probable parts and compared there with
all indexed vectors, in float64. The k best of the parts are merged to the k best of all.

A collection with more vectors than one classifier's parts hold has a second classifier in
each part, so that parts stay of one size up to MOST_PARTS x MOST_PARTS x PART vectors (33
million) and grow with a 65,536th of the vectors beyond.

Parts that are larger than a block are split: indexed vectors into blocks, queries into
blocks, one task per pair, so that a part with a third of all rows is never gathered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafspark.llm.clusters import hash_id, sample_matrix
from leafspark.llm.vectors import matrix

#: Rows of the fitted sample of a collection, vectors per part aimed at, the most parts of a classifier.
SAMPLE, PART, MOST_PARTS = 10_000, 512, 256
#: Vectors of a part that fit its second classifier, and coarse parts that are asked at least.
INNER, BEAM = 4_000, 8
PROBES = 6
#: For neighbours at any distance, of which few are near copies, this share of the parts is searched.
WIDE_SHARE = 0.2
INDEX_BLOCK, QUERY_BLOCK = 30_000, 30_000


def neighbour_graph(x: np.ndarray, k: int = 10) -> np.ndarray:
    """The k nearest rows of every row."""
    k, low = min(k, len(x) - 1), x.astype(np.float32)
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1000):
        s = low[at : at + 1000] @ low.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -2
        out[at : at + 1000] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, m: int, slack: float = 1.15, rounds: int = 8) -> np.ndarray:
    """A part for every row: seeded by capacity-bound assignment to spread seeds, refined by moving rows to the part of most of their neighbours while it has room."""
    n = len(x)
    room = math.ceil(slack * n / m)
    rng = np.random.default_rng(11)
    seeds = x[rng.choice(n, m, replace=False)]
    for _ in range(4):
        own = (x @ seeds.T).argmax(1)
        sums = np.zeros_like(seeds)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        seeds = np.where(norm > 0, sums / np.maximum(norm, 1e-12), seeds)
    s = x @ seeds.T
    wish = np.argsort(-s, axis=1)[:, : min(m, 16)]
    part, load = np.full(n, -1), np.zeros(m, np.int64)
    for i in np.argsort(-s.max(axis=1)):
        for p in wish[i]:
            if load[p] < room:
                break
        else:
            p = int(load.argmin())
        part[i] = p
        load[p] += 1
    for _ in range(rounds):
        moved = 0
        near = part[graph]
        for i in rng.permutation(n):
            p, count = np.unique(near[i], return_counts=True)
            q = p[count.argmax()]
            if q != part[i] and count.max() > (near[i] == part[i]).sum() and load[q] < room:
                load[part[i]] -= 1
                load[q] += 1
                part[i] = q
                moved += 1
        if moved < n // 100:
            break
    return part


def train_router(x: np.ndarray, part: np.ndarray, m: int, epochs: int = 12, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) of a softmax classifier, trained by Adam from the parts' mean directions."""
    w = np.zeros((m, x.shape[1]))
    np.add.at(w, part, x)
    w = 12 * w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-12)
    b = np.zeros(m)
    rng = np.random.default_rng(13)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    t = 0
    for _ in range(epochs if m > 1 else 0):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 1024):
            i = order[at : at + 1024]
            z = x[i] @ w.T + b
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            z[np.arange(len(i)), part[i]] -= 1
            gw, gb = z.T @ x[i] / len(i), z.mean(0)
            t += 1
            for j, (g, target) in enumerate(((gw, w), (gb, b))):
                state[2 * j] = 0.9 * state[2 * j] + 0.1 * g
                state[2 * j + 1] = 0.999 * state[2 * j + 1] + 0.001 * g * g
                target -= rate * (state[2 * j] / (1 - 0.9**t)) / (np.sqrt(state[2 * j + 1] / (1 - 0.999**t)) + 1e-8)
    return w, b


class Router:
    """Tells the most probable parts of unit vectors: by one classifier, or by a second one within each of its parts.

    With a second level the parts are those of all second classifiers, and a part's
    probability is the product of both; a vector asks the second classifiers of its most
    probable coarse parts only.
    """

    def __init__(self, w: np.ndarray, b: np.ndarray, inner: dict[int, tuple[np.ndarray, np.ndarray]] | None = None) -> None:
        self.w, self.b = w.astype(np.float32), b
        self.inner = {k: (u.astype(np.float32), c) for k, (u, c) in (inner or {}).items()}
        sizes = [len(self.inner[k][1]) if k in self.inner else 1 for k in range(len(w))]
        self.first = np.r_[0, np.cumsum(sizes)]
        self.size = int(self.first[-1])

    def coarse(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.w.T + self.b).argmax(axis=1)

    def near(self, x: np.ndarray, p: int) -> np.ndarray:
        """The p most probable parts of every row, the best first."""
        p = min(p, self.size)
        z = _log_softmax(x @ self.w.T + self.b)
        if self.inner:
            asked = min(z.shape[1], max(BEAM, math.ceil(1.5 * p * z.shape[1] / self.size)))
            top = np.argpartition(-z, asked - 1, axis=1)[:, :asked]
            full = np.full((len(x), self.size), -np.inf, np.float32)
            row, part = np.repeat(np.arange(len(x)), asked), top.ravel()
            order = np.argsort(part, kind="stable")
            for k, at in zip(*_runs(part[order])):
                r = row[order[at]]
                u, c = self.inner.get(k, (np.zeros((1, x.shape[1]), np.float32), np.zeros(1)))
                full[r, self.first[k] : self.first[k + 1]] = z[r, k][:, None] + _log_softmax(x[r] @ u.T + c)
            z = full
        best = np.argpartition(-z, p - 1, axis=1)[:, :p]
        return np.take_along_axis(best, np.argsort(-np.take_along_axis(z, best, axis=1), axis=1, kind="stable"), axis=1)


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _runs(x: np.ndarray) -> tuple[list[int], list[slice]]:
    """(values, where they stand) of a sorted array."""
    at = np.flatnonzero(np.r_[True, x[1:] != x[:-1], True]) if len(x) else np.zeros(1, int)
    return x[at[:-1]].tolist() if len(x) else [], [slice(a, b) for a, b in zip(at[:-1], at[1:])]


def fit_level(x: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) for the parts of a sample of `total` vectors."""
    m = max(1, min(MOST_PARTS, math.ceil(total / PART), len(x) // 24))
    part = balanced_parts(x, neighbour_graph(x), m) if m > 1 else np.zeros(len(x), np.int64)
    return train_router(x, part, m)


def fit_router(rows: DataFrame, x: np.ndarray, total: int, width: int) -> Router:
    """The router of a collection (id, v) of `total` vectors, of which x is a sample.

    Where one level gives parts of more than twice PART vectors, each part gets a second one,
    fitted in a task on about INNER of its own vectors. Their weights, at most MOST_PARTS x
    MOST_PARTS x width numbers, come to the driver and go to the tasks.
    """
    w, b = fit_level(x, total)
    if total <= 2 * PART * len(w) or len(w) < 2:
        return Router(w, b)
    outer, scale = Router(w, b), total / len(w) / INNER

    def sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            use, unit = matrix(batch.column(1), width)
            v = batch.column(1).take(pa.array(use))
            yield pa.RecordBatch.from_arrays([pa.array(outer.coarse(unit) if len(use) else [], pa.int32()), v], names=["part", "v"])

    def fit(table: pa.Table) -> pa.Table:
        u, c = fit_level(matrix(table.column("v"), width)[1][: 4 * INNER], math.ceil(table.num_rows * max(1.0, scale)))
        return pa.table({"part": table.column("part")[:1], "w": pa.array([u.astype(np.float32).tobytes()], pa.binary()), "b": pa.array([c.tolist()], pa.list_(pa.float64()))})

    few = rows.where(F.pmod(F.xxhash64("id", F.lit("inner")), F.lit(1 << 30)) < int(min(1.0, 1 / scale) * (1 << 30))).select("id", "v")
    found = few.mapInArrow(sort_out, "part int, v array<float>").groupBy("part").applyInArrow(fit, "part int, w binary, b array<double>").collect()
    return Router(w, b, {r["part"]: (np.frombuffer(r["w"], np.float32).reshape(-1, width), np.array(r["b"])) for r in found})


def best_of(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, index row, cosine) of the k nearest others of each query, ties to the smaller id; x_ids are sorted."""
    where = np.searchsorted(x_ids, q_ids)
    found = (where < len(x_ids)) & (x_ids[np.minimum(where, len(x_ids) - 1)] == q_ids)
    rows, cols, values = [], [], []
    step = max(1, min(1024, 4_000_000 // max(1, len(x))))
    for at in range(0, len(q), step):
        s = np.round(q[at : at + step] @ x.T, 12)
        mine = np.flatnonzero(found[at : at + step])
        s[mine, where[at + mine]] = -3
        if s.shape[1] > k:
            bound = np.maximum(-np.partition(-s, k - 1, axis=1)[:, k - 1], max(least, -2))
        else:
            bound = np.full(len(s), max(least, -2.0))
        a, b = np.nonzero(s >= bound[:, None])
        v = s[a, b]
        order = np.lexsort((b, -v, a))
        a, b, v = a[order], b[order], v[order]
        place = np.arange(len(a)) - np.repeat(np.flatnonzero(np.r_[True, a[1:] != a[:-1]]), np.diff(np.r_[np.flatnonzero(np.r_[True, a[1:] != a[:-1]]), len(a)])) if len(a) else a
        keep = place < k
        rows.append(at + a[keep])
        cols.append(b[keep])
        values.append(v[keep])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(values)


def nearest(rows: DataFrame, key: str, vec: str, collection: str | None = None, k: int = 5, least: float = -1.0, is_query: F.Column | None = None, probes: int | float = PROBES) -> DataFrame:
    """(collection, id, neighbour, cosine, rank): the k nearest others of every query among all rows of its collection.

    collection names the column of vectors that compare; None: all do. Usable vectors have
    the width most frequent in their collection, are finite and not all zero; others and null
    keys are left out. is_query marks the queries, by default all rows. probes is the number of parts searched for
    a query, or as a float their share of all parts (PROBES at least). Neighbours under the
    cosine `least` are dropped; ties go to the smaller id. A key sent twice counts once. The
    collections are counted and fitted one by one on the driver, each on at most 2 x SAMPLE rows.
    """
    name = F.coalesce(F.col(collection).cast("string"), F.lit("")) if collection else F.lit("")
    base = rows.where(F.col(key).isNotNull() & (F.size(vec) > 0)).select(name.alias("c"), F.col(key).cast("string").alias("id"), F.col(vec).cast("array<float>").alias("v"), (F.lit(True) if is_query is None else F.coalesce(is_query, F.lit(False))).alias("q"))
    most = Window.partitionBy("c").orderBy(F.desc("n"), F.desc("width"))
    widths = base.groupBy("c", F.size("v").alias("width")).agg(F.count("*").alias("n")).withColumn("place", F.row_number().over(most)).where("place = 1").collect()
    routers: dict[str, tuple] = {}
    first = 0
    for r in sorted(widths, key=lambda r: r["c"]):
        own = base.where((F.col("c") == r["c"]) & (F.size("v") == r["width"]))
        x = sample_matrix(own, "id", "v", r["width"], SAMPLE, r["n"])
        if not len(x):
            continue
        router = fit_router(own, x, r["n"], r["width"])
        scale = r["n"] / len(x)
        p = min(router.size, probes if isinstance(probes, int) else max(PROBES, math.ceil(probes * router.size)))
        near = np.concatenate([router.near(x[at : at + 2000], p) for at in range(0, len(x), 2000)])
        ib = np.maximum(1, np.ceil(np.bincount(near[:, 0], minlength=router.size) * scale / INDEX_BLOCK)).astype(int)
        qb = np.maximum(1, np.ceil(np.bincount(near.ravel(), minlength=router.size) * scale / QUERY_BLOCK)).astype(int)
        routers[r["c"]] = (r["width"], router, p, ib, qb, first + np.r_[0, np.cumsum(ib * qb)])
        first += int((ib * qb).sum())
    schema = "c string, id string, neighbour string, cosine double"
    if not routers:
        return rows.sparkSession.createDataFrame([], schema + ", rank int").select(F.col("c").alias("collection"), "id", "neighbour", "cosine", "rank")

    sent = rows.sparkSession.sparkContext.broadcast(routers)
    widths_of = {c: x[0] for c, x in routers.items()}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            for c in set(names.tolist()) & widths_of.keys():
                width, router, p, ib, qb, offset = sent.value[c]
                b = batch.take(pa.array(np.flatnonzero(names == c)))
                use, unit = matrix(b.column(2), width)
                if not len(use):
                    continue
                near = np.concatenate([router.near(unit[at : at + 2000], p) for at in range(0, len(unit), 2000)])
                top = near[:, 0]
                asks = b.column(3).to_numpy(zero_copy_only=False)[use].astype(bool)
                h = np.array([hash_id(i) for i in b.column(1).take(pa.array(use)).to_pylist()], np.int64)
                out_row, out_task, out_role = [], [], []
                # indexed rows meet every block of queries, queries every block of indexed rows
                for role, row, part in ((1, np.arange(len(use)), top), (2, *(lambda r: (np.repeat(r, p), near[r].ravel()))(np.flatnonzero(asks)))):
                    times = qb[part] if role == 1 else ib[part]
                    r = np.repeat(np.arange(len(row)), times)
                    t = np.arange(len(r)) - np.repeat(np.cumsum(times) - times, times)
                    ii = (h[row[r]] % ib[part[r]]) if role == 1 else t
                    qq = t if role == 1 else (h[row[r]] // 7919) % qb[part[r]]
                    out_row.append(row[r])
                    out_task.append(offset[part[r]] + ii * qb[part[r]] + qq)
                    out_role.append(np.full(len(r), role, np.int8))
                row = use[np.concatenate(out_row)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_task), pa.int32()), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), b.column(2).take(pa.array(row)), pa.array(np.concatenate(out_role))], names=["task", "c", "id", "v", "role"])

    def search(table: pa.Table) -> pa.Table:
        c = table.column("c")[0].as_py()
        sides = []
        for role in (1, 2):
            t = table.filter(pa.compute.equal(table.column("role"), role))
            ids, keep = np.unique(np.array(t.column("id").to_pylist(), dtype=str), return_index=True)
            sides.append((ids, matrix(t.column("v").take(pa.array(keep)), widths_of[c])[1]))
        (x_ids, x), (q_ids, q) = sides
        if not len(x_ids) or not len(q_ids):
            a, b, v = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        else:
            a, b, v = best_of(q, q_ids, x, x_ids, k, least)
        return pa.table({"c": pa.array([c] * len(a), pa.string()), "id": pa.array(q_ids[a].tolist(), pa.string()), "neighbour": pa.array(x_ids[b].tolist(), pa.string()), "cosine": pa.array(v, pa.float64())})

    routed = base.where(F.col("c").isin(list(routers))).mapInArrow(route, "task int, c string, id string, v array<float>, role tinyint")
    parts = routed.groupBy("task").applyInArrow(search, schema).where(F.col("cosine") >= least)
    best = Window.partitionBy("c", "id").orderBy(F.desc("cosine"), "neighbour")
    return parts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(F.col("c").alias("collection"), "id", "neighbour", "cosine", "rank")
