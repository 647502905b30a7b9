"""Grouping records into similarity clusters.

Density clustering where two records are similar from a cosine on and a record with at least
one similar other is a core point, so that a cluster is a connected set of similar records:

1. A bounded sample fits principal axes and the cells: balls of the similarity radius around
   vectors with several similar others in the sample.
2. Every vector belongs to the cell of its nearest pivot if it lies in that ball, else it is
   open. By the triangle inequality for angles, a vector similar to a member of a cell lies
   within twice the radius of the cell's pivot; these are the cell's margin. A member visits
   the cells before its own whose margin holds it, an open vector all such cells, so that each
   pair of which one is a member is compared once, and none is left out.
3. Open vectors are compared with each other in blocks. In the reduced space of the leading
   axes and the length of the rest, the product of two vectors bounds their cosine from above,
   so that only pairs that reach the cosine there are compared in full.
4. Each comparison gives its records their similar others and a local cluster; local clusters
   are merged through the core points they share: labels that meet at a record are linked, and
   the distributed grouping of ``groups`` connects the labels.

Nothing is lost, whatever the sample. The work grows with the square of the open vectors,
those without a dense surrounding, at under half a nanosecond a pair; cells stay near a
multiple of their members. Small cells are gathered in tasks by a shuffle. A large cell or the
open set is written once, in blocks; a task has two runs of blocks, its sides, and loads them
two at a time, so that neither memory nor the rows on disk grow with the number of pairs of
blocks. Equal vectors of a batch are one row with a count.

The most typical members are those with the highest mean cosine to all members (medoids),
found by one sum vector per cluster.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafspark.llm.groups import connected_groups
from leafspark.llm.vectors import binary_rows, matrix
from leafspark.session import cut, read_part, release

#: Rows of the fitted sample (at most twice as many reach the driver), sample members that make a pivot, and the most pivots; what no pivot covers is open.
SAMPLE, LEAST_MEMBERS, MOST_PIVOTS = 32_000, 4, 2_048
#: Vectors of a block of a cell, the most of a block of open vectors, and the rows aimed at in a task of small cells.
BLOCK, OPEN_BLOCK, BIN = 16_000, 100_000, 24_000
#: Blocks of a side of a task, of a large cell and of open vectors; a task gives a row for each of its records, so more blocks are fewer rows.
SIDE, OPEN_SIDE = 4, 5
#: The most partitions of the comparison; more tasks share them.
MOST_PARTITIONS = 50_000
#: Vectors of a clustered record that one task of the medoids gets for a cluster.
MEDOID_ROWS = 50_000
#: Rows and columns of a product, so that it stays in the processor's cache.
TILE = (256, 512)
#: A pivot's margin must leave this cosine at least, or cells would hold nearly all vectors.
LEAST_MARGIN = 0.3


def sample_matrix(rows: DataFrame, key: str, vec: str, width: int, size: int, total: int) -> np.ndarray:
    """Unit vectors of about `size` rows, chosen by the hash of their key; at most 2 x size come to the driver."""
    share = min(1.0, size / max(1, total))
    picked = rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30))).select(vec).limit(2 * size)
    table = picked.toArrow()
    return matrix(table.column(0), width)[1]


def fit_pivots(x: np.ndarray, cosine: float, least: int = LEAST_MEMBERS, most: int = MOST_PIVOTS) -> np.ndarray:
    """Vectors of the sample, none within the similarity radius of another, with at least so many of the sample in theirs; most first."""
    if 2 * cosine * cosine - 1 < LEAST_MARGIN:
        return np.zeros((0, x.shape[1]), np.float32)
    x = x.astype(np.float32)
    lead, count = np.zeros((0, x.shape[1]), np.float32), np.zeros(0, np.int64)
    for at in range(0, len(x), 500):
        q = x[at : at + 500]
        if len(lead):
            s = q @ lead.T
            own, near = s.argmax(axis=1), s.max(axis=1) >= cosine
            count += np.bincount(own[near], minlength=len(lead))
            q = q[~near]
        s, left, new, n = q @ q.T >= cosine, np.ones(len(q), bool), [], []
        for i in range(len(q)):
            if left[i]:
                mine = left & s[i]
                mine[i] = True
                new.append(i)
                n.append(int(mine.sum()))
                left &= ~mine
        lead, count = np.vstack([lead, q[new]]), np.r_[count, np.array(n, np.int64)]
    order = np.argsort(-count, kind="stable")
    return lead[order[count[order] >= least][:most]]


def fit_axes(x: np.ndarray, cosine: float) -> np.ndarray:
    """Leading principal axes (width x k), k by what a pair costs: its product in k axes, and in full if it reaches the cosine there."""
    _, _, vt = np.linalg.svd(x.T @ x)
    a, b = (x[:1000], x[-1000:]) if len(x) >= 2000 else (x, x)
    cost = {}
    for k in sorted({*range(8, x.shape[1], 8), x.shape[1]}):
        p = vt[:k].T
        cost[k] = 0.1 + k / 80 + 70 * float((reduced(a, p) @ reduced(b, p).T >= cosine).mean())
    return vt[: min(cost, key=cost.get)].T.astype(np.float32)


def reduced(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Unit vectors on the axes, and the length of what is left; the product of two bounds their cosine from above."""
    y = x @ axes
    rest = np.sqrt(np.maximum(0, 1 - (y * y).sum(axis=1)))
    return np.column_stack([y, rest]).astype(np.float32)


def place(x: np.ndarray, pivots: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell of each row, len(pivots) for an open one; row and cell of each visit)."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(x) if len(pivots) else 0, 2000):
        s = x[at : at + 2000].astype(np.float32) @ pivots.T
        own = s.argmax(axis=1)
        own = np.where(s[np.arange(len(s)), own] >= cosine, own, len(pivots))
        row, cell = np.nonzero(s >= 2 * cosine * cosine - 1 - 1e-4)
        ahead = cell < own[row]
        out.append((own, at + row[ahead], cell[ahead]))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(p) for p in zip(*out)) if out else (np.zeros(len(x), np.int64), none, none)


class Links:
    """Similar others, counted with their copies, and local clusters of the rows x (float32), by products of tiles."""

    def __init__(self, x: np.ndarray, copies: np.ndarray, cosine: float, axes: np.ndarray | None = None) -> None:
        self.raw, self.copies, self.cosine = x, copies.astype(np.float64), cosine
        self.length = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
        self.x = np.empty_like(x, np.float32)
        for at in range(0, len(x), 10_000):  # the quotients are float64
            self.x[at : at + 10_000] = x[at : at + 10_000] / self.length[at : at + 10_000, None]
        self.low = reduced(self.x, axes) if axes is not None and axes.shape[1] < x.shape[1] else None
        self.degree, self.root = np.zeros(len(x)), np.arange(len(x))
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def _exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether pairs near the bound reach it, in float64."""
        a, b = self.raw[i].astype(np.float64), self.raw[j].astype(np.float64)
        return np.einsum("ij,ij->i", a, b) / (self.length[i] * self.length[j]) >= self.cosine - 1e-12

    def compare(self, left: np.ndarray, right: np.ndarray | None = None) -> None:
        """Compare the rows left with the rows right, which have none in common, or with each other; each pair once."""
        rows, cols = TILE
        for at in range(0, len(left), rows):
            q = left[at : at + rows]
            others = right if right is not None else left[at:]
            for to in range(0, len(others), cols):
                m = others[to : to + cols]
                if self.low is not None:
                    hit = np.flatnonzero(self.low[q] @ self.low[m].T >= self.cosine - 1e-5)
                    if 10 * len(hit) < len(q) * len(m):
                        a, b = np.divmod(hit, len(m))
                        if right is None and to < len(q):
                            ahead = b + to > a
                            a, b = a[ahead], b[ahead]
                        s = np.einsum("ij,ij->i", self.x[q[a]], self.x[m[b]])
                        keep, near = s >= self.cosine, np.flatnonzero(np.abs(s - self.cosine) < 1e-5)
                        keep[near] = self._exact(q[a[near]], m[b[near]])
                        self._join(q[a[keep]], m[b[keep]])
                        continue
                s = self.x[q] @ self.x[m].T
                hit, near = s >= self.cosine, np.flatnonzero(np.abs(s - self.cosine) < 1e-5)
                if len(near):
                    a, b = np.divmod(near, len(m))
                    hit[a, b] = self._exact(q[a], m[b])
                if right is None and to < len(q):
                    hit &= np.arange(to, to + len(m)) > np.arange(len(q))[:, None]
                n = np.count_nonzero(hit)
                if 20 * n < hit.size:
                    a, b = np.nonzero(hit)
                    self._join(q[a], m[b])
                elif n:
                    self._many(q, m, hit)
        self._flush()

    def _join(self, i: np.ndarray, j: np.ndarray) -> None:
        if len(i):
            self.waiting.append((i, j))
            self.n_waiting += len(i)
            if self.n_waiting > 500_000:
                self._flush()

    def _flush(self) -> None:
        if self.waiting:
            i, j = (np.concatenate(x) for x in zip(*self.waiting))
            self.waiting, self.n_waiting = [], 0
            self.degree += np.bincount(i, self.copies[j], len(self.x)) + np.bincount(j, self.copies[i], len(self.x))
            self._union(i, j)

    def _union(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := root[root], root):
                root[:] = up

    def add(self, part: Links, at: np.ndarray) -> None:
        """What was found among the rows `at`, which are the rows of `part` in its order."""
        self.degree[at] += part.degree
        linked = np.flatnonzero(part.root != np.arange(len(at)))
        self._union(at[linked], at[part.root[linked]])

    def _many(self, q: np.ndarray, m: np.ndarray, hit: np.ndarray) -> None:
        """A tile with many similar pairs: counts are products, and only pairs with different roots are joined."""
        f = hit.astype(np.float32)
        self.degree[q] += f @ self.copies[m]
        self.degree[m] += self.copies[q] @ f
        apart = hit & (self.root[q][:, None] != self.root[m])
        while apart.any():  # each row with its first similar other, then what that left apart
            a = np.flatnonzero(apart.any(axis=1))
            self._union(q[a], m[apart[a].argmax(axis=1)])
            apart = hit & (self.root[q][:, None] != self.root[m])


class _Tasks:
    """Which tasks compare a cell: small cells share bins, the blocks of a large one meet in pairs of sides.

    The sizes of the cells are estimated from the sample; that only decides which tasks do the
    work. A large cell has blocks of members, then blocks of visitors; a side is a run of blocks.
    """

    def __init__(self, own: np.ndarray, visits: np.ndarray, n_cells: int, scale: float, cores: int) -> None:
        members = np.bincount(own, minlength=n_cells + 1) * scale
        guests = np.r_[np.bincount(visits, minlength=n_cells) * scale, 0]
        blocks = lambda n: np.maximum(1, np.ceil(n / BLOCK)).astype(int)
        self.mb, self.vb = blocks(members), blocks(guests)
        n, least = members[n_cells], math.ceil(math.sqrt(4 * cores))
        self.mb[n_cells] = max(1, math.ceil(n / OPEN_BLOCK), min(math.ceil(n / (BLOCK / 2)), least))
        self.vb[n_cells] = 0
        self.large = (self.mb > 1) | (self.vb > 1)
        load = np.where(self.large, 0, members + guests)
        load[n_cells] = 0 if self.large[n_cells] else BIN
        self.bins = np.floor(np.cumsum(load) / BIN).astype(np.int32)
        self.n_bins = int(self.bins.max()) + 1
        self.first = np.cumsum(np.r_[0, np.where(self.large, self.mb + self.vb, 0)])
        self.n_blocks = int(self.first[-1])
        self.ms, self.vs = -(-self.mb // SIDE), -(-self.vb // SIDE)
        self.ms[n_cells] = max(-(-self.mb[n_cells] // OPEN_SIDE), min(self.mb[n_cells], 2 * least))
        self.first_pair = np.cumsum(np.r_[0, np.where(self.large, self.ms * (self.ms + 1) // 2 + self.ms * self.vs, 0)])
        self.n_pairs = int(self.first_pair[-1])

    def of_members(self, cell: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The task of the shuffle that a member goes to: a bin, or from n_bins on a block."""
        return np.where(self.large[cell], self.n_bins + self.first[cell] + h % self.mb[cell], self.bins[cell])

    def of_guests(self, cell: np.ndarray, h: np.ndarray) -> np.ndarray:
        return np.where(self.large[cell], self.n_bins + self.first[cell] + self.mb[cell] + h % np.maximum(1, self.vb[cell]), self.bins[cell])

    def sides(self, pair: int) -> tuple[int, range, range]:
        """(cell, blocks of the left side, blocks of the right side) of a pair of sides; a side may meet itself."""
        c = int(np.searchsorted(self.first_pair, pair, "right")) - 1
        first, mb, vb, ms, vs = (int(x[c]) for x in (self.first, self.mb, self.vb, self.ms, self.vs))
        run = lambda at, i, n, k: range(at + i * n // k, at + (i + 1) * n // k)
        r, own = pair - int(self.first_pair[c]), ms * (ms + 1) // 2
        if r < own:
            j = (math.isqrt(8 * r + 1) - 1) // 2
            return c, run(first, r - j * (j + 1) // 2, mb, ms), run(first, j, mb, ms)
        i, j = divmod(r - own, vs)
        return c, run(first, i, mb, ms), run(first + mb, j, vb, vs)


def _join_sides(left: range, right: range, load, width: int, cosine: float, axes: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """The records of two sides with a similar other on the other side, or on the same if it is both.

    load gives the columns named of a block. Vectors are in memory for two blocks at a time.
    """
    own = left == right
    parts, at, n = [], {}, 0
    for k in dict.fromkeys([*left, *right]):
        parts.append(load(k, ["id", "n"]))
        at[k] = n
        n += len(parts[-1])
    ids = pa.chunked_array([c for t in parts for c in t.column("id").chunks], pa.string())
    copies = np.concatenate([t.column("n").to_numpy() for t in parts])
    whole = Links(np.zeros((n, 0), np.float32), copies, cosine)
    del parts

    def rows(k: int) -> np.ndarray:
        chunks = load(k, ["v"]).column("v").cast(pa.binary(4 * width)).chunks
        return np.concatenate([np.zeros((0, width), np.float32), *(np.frombuffer(c.buffers()[1], np.float32).reshape(-1, width)[c.offset : c.offset + len(c)] for c in chunks if len(c))])

    for a in left:
        x = rows(a)
        here = np.arange(at[a], at[a] + len(x))
        if own:
            links = Links(x, copies[here], cosine, axes)
            links.degree += copies[here] - 1
            links.compare(np.arange(len(x)))
            whole.add(links, here)
            del links
        for b in right:
            if len(x) and (not own or b > a):
                pair = np.concatenate([x, rows(b)])
                both = np.r_[here, np.arange(at[b], at[b] + len(pair) - len(x))]
                links = Links(pair, copies[both], cosine, axes)
                links.compare(np.arange(len(x)), np.arange(len(x), len(both)))
                whole.add(links, both)
                del links, pair  # before the next pair is loaded
        del x
    some = np.flatnonzero(whole.degree > 0)
    if not len(some):
        return
    order = pc.sort_indices(ids).to_numpy()
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    least = np.full(n, n)
    np.minimum.at(least, whole.root[some], rank[some])
    for lo in range(0, len(some), 100_000):
        r = some[lo : lo + 100_000]
        name = lambda i: ids.take(pa.array(i)).combine_chunks()
        yield pa.RecordBatch.from_arrays([name(r), name(order[least[whole.root[r]]]), pa.array(whole.degree[r].astype(np.int64))], names=["record", "local", "degree"])


def density_clusters(rows: DataFrame, key: str = "chunk_id", vec: str = "embedding", width: int = 64, cosine: float = 0.85) -> DataFrame:
    """(record, cluster, degree) of every record with at least one similar other.

    cluster is the smallest record of the cluster; degree the number of records similar to
    the record. Vectors that are null, of another width, not finite or all zero are left out,
    and so are null keys. A record sent twice counts once, with the smallest of its vectors.
    """
    return _clusters(_usable(rows, key, vec, width), width, cosine, done_with=True)


def _usable(rows: DataFrame, key: str, vec: str, width: int) -> DataFrame:
    """(id, v) once per record, written."""
    v = F.col(vec).cast("array<float>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    base = rows.where(F.col(key).isNotNull() & (F.size(vec) == width)).select(F.col(key).cast("string").alias("id"), v.alias("v")).where(finite)
    return cut(base.groupBy("id").agg(F.min("v").alias("v")))


def _clusters(base: DataFrame, width: int, cosine: float, done_with: bool = False) -> DataFrame:
    """done_with: base is deleted when it is read for the last time."""
    spark = base.sparkSession
    total = base.count()
    x = sample_matrix(base, "id", "v", width, SAMPLE, total) if total else np.zeros((0, width))
    if not len(x):
        return spark.createDataFrame([], "record string, cluster string, degree bigint")
    pivots, axes = fit_pivots(x, cosine), fit_axes(x, cosine)
    own, _, visited = place(x, pivots, cosine)
    tasks = _Tasks(own, visited, len(pivots), total / len(x), spark.sparkContext.defaultParallelism)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            use, unit = matrix(b.column(1), width)
            if not len(use):
                continue
            ids = b.column(0).take(pa.array(use)).to_pylist()
            order = sorted(range(len(ids)), key=ids.__getitem__)
            raw = b.column(1).take(pa.array(use[order])).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, width)
            _, first, at, n = np.unique(raw.view(f"V{4 * width}").ravel(), return_index=True, return_inverse=True, return_counts=True)
            chosen = np.array(order)[first]  # of equal vectors the smallest record
            unit, flat, names = unit[chosen], raw[first], [ids[i] for i in chosen]
            h = np.array([hash_id(i) for i in names], np.int64)
            own, row_v, cell_v = place(unit, pivots, cosine)
            row = np.r_[np.arange(len(own)), row_v]
            cell = np.r_[own, cell_v]
            role = np.r_[np.zeros(len(own), np.int8), np.full(len(row_v), 2, np.int8)]
            task = np.r_[tasks.of_members(own, h), tasks.of_guests(cell_v, h[row_v])]
            for lo in range(0, len(row), 20_000):
                r, to = row[lo : lo + 20_000], slice(lo, lo + 20_000)
                yield _batch(task[to], cell[to], role[to], [names[i] for i in r], [None] * len(r), n[r], flat[r])
            copies = [(ids[order[k]], names[at[k]]) for k in range(len(order)) if n[at[k]] > 1 and ids[order[k]] != names[at[k]]]
            if copies:
                yield _batch(np.array([hash_id(i) % tasks.n_bins for i, _ in copies]), np.full(len(copies), -1), np.full(len(copies), 3), [i for i, _ in copies], [i for _, i in copies], np.zeros(len(copies)), None)

    def compare(table: pa.Table) -> pa.Table:
        """The records of a bin with a similar other (block -1, n the degree) and its copies; a block as it is."""
        if (block := table.column("task")[0].as_py() - tasks.n_bins) >= 0:
            return pa.table({"block": pa.array(np.full(len(table), block), pa.int32()), "id": table.column("id"), "local": pa.nulls(len(table), pa.string()), "n": table.column("n"), "twin": table.column("twin"), "v": table.column("v")})
        cell, role = table.column("cell").to_numpy(), table.column("role").to_numpy()
        ids, n = np.array(table.column("id").to_pylist(), object), table.column("n").to_numpy()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        copy = np.flatnonzero(role == 3)
        twin_of = np.array(table.column("twin").to_pylist(), object)[copy] if len(copy) else np.zeros(0, object)
        order = np.argsort(cell, kind="stable")
        order = order[len(copy) :]
        bounds = np.flatnonzero(np.r_[True, np.diff(cell[order]) != 0, True]) if len(order) else np.zeros(1, int)
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            at = order[lo:hi]
            k, who = int(cell[at[0]]), role[at]
            links = Links(binary_rows(table.column("v").take(pa.array(at)), width), n[at], cosine, axes if k == len(pivots) else None)
            left, guests = np.flatnonzero(who == 0), np.flatnonzero(who == 2)
            links.degree[left] += n[at[left]] - 1
            links.compare(left)
            if len(guests):
                links.compare(left, guests)
            some = np.flatnonzero(links.degree > 0)
            if len(some):
                names, root = ids[at], links.root[some]
                least: dict[int, str] = {}
                for i, r in zip(names[some].tolist(), root.tolist()):
                    if r not in least or i < least[r]:
                        least[r] = i
                out.append((names[some], np.array([least[r] for r in root.tolist()], object), links.degree[some]))
        cat = lambda i, kind: pa.array(np.concatenate([o[i] for o in out]) if out else [], kind)
        n_found = sum(len(o[0]) for o in out)
        return pa.table({
            "block": pa.array(np.full(n_found + len(copy), -1), pa.int32()),
            "id": pa.chunked_array([cat(0, pa.string()), pa.array(ids[copy], pa.string())]),
            "local": pa.chunked_array([cat(1, pa.string()), pa.nulls(len(copy), pa.string())]),
            "n": pa.chunked_array([pa.array(np.concatenate([o[2] for o in out]).astype(np.int64) if out else [], pa.int64()), pa.nulls(len(copy), pa.int64())]),
            "twin": pa.chunked_array([pa.nulls(n_found, pa.string()), pa.array(twin_of, pa.string())]),
            "v": pa.nulls(n_found + len(copy), pa.binary()),
        })

    placed = base.mapInArrow(spread, "task int, cell int, role tinyint, id string, twin string, n bigint, v binary")
    n_tasks = tasks.n_bins + tasks.n_blocks
    # a partition for every task, so that their number grows with the rows and large ones don't meet
    placed = placed.repartitionById(n_tasks, "task") if n_tasks <= MOST_PARTITIONS else placed.repartition(MOST_PARTITIONS, "task")
    parts = cut(placed.groupBy("task").applyInArrow(compare, "block int, id string, local string, n bigint, twin string, v binary"), by="block")
    if done_with:
        release(base)
    copies = cut(parts.where("block = -1 and twin is not null").select(F.col("id").alias("copy"), "twin"))
    own_rows, joined = parts.where("block = -1 and twin is null").select(F.col("id").alias("record"), "local", F.col("n").alias("degree")), None
    if tasks.n_pairs:
        load = read_part(parts, "block", {"id": pa.string(), "n": pa.int64(), "v": pa.binary()})

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for pair in b.column(0).to_pylist():
                    c, left, right = tasks.sides(pair)
                    yield from _join_sides(left, right, load, width, cosine, axes if c == len(pivots) else None)

        joined = cut(spark.range(0, tasks.n_pairs, 1, min(tasks.n_pairs, MOST_PARTITIONS)).mapInArrow(join, "record string, local string, degree bigint"))
        own_rows = own_rows.union(joined)
    found = cut(own_rows.groupBy("record").agg(F.sum("degree").alias("degree"), F.min("local").alias("label"), F.collect_set("local").alias("labels")))
    for df in (parts, joined):
        release(df)
    # as many labels meet at a record as blocks hold records similar to it; the label pairs are far fewer than the records
    met = found.select("label", F.explode("labels").alias("other")).where("label <> other").distinct()
    merged = connected_groups(met.select(F.least("label", "other").alias("u"), F.greatest("label", "other").alias("v")))
    done = found.join(merged, F.col("label") == F.col("x"), "left").select("record", F.coalesce("group", "label").alias("cluster"), "degree")
    same = copies.join(done, F.col("twin") == F.col("record")).select(F.col("copy").alias("record"), "cluster", "degree")
    return done.union(same)


def _binary(flat: np.ndarray) -> pa.Array:
    size = flat.shape[1] * 4
    return pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(np.arange(0, (len(flat) + 1) * size, size, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def _batch(task: np.ndarray, cell: np.ndarray, role: np.ndarray, ids: list, twins: list, n: np.ndarray, flat: np.ndarray | None) -> pa.RecordBatch:
    v = pa.nulls(len(ids), pa.binary()) if flat is None else _binary(flat)
    return pa.RecordBatch.from_arrays([pa.array(task, pa.int32()), pa.array(cell, pa.int32()), pa.array(role, pa.int8()), pa.array(ids, pa.string()), pa.array(twins, pa.string()), pa.array(n, pa.int64()), v], names=["task", "cell", "role", "id", "twin", "n", "v"])


def hash_id(text: str) -> int:
    """A stable hash; Python's own differs between workers."""
    import zlib

    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def described_clusters(rows: DataFrame, key: str = "chunk_id", vec: str = "embedding", width: int = 64, cosine: float = 0.85, typical: int = 3) -> DataFrame:
    """(cluster_id, size, n_links, mutual, typical) of the clusters of density_clusters().

    n_links counts the similar pairs, mutual tells whether all pairs are similar, typical are
    the members with the highest mean cosine to all members (rounded to 9 places, ties to the
    smaller id). The mean is the product with the cluster's sum vector, which tasks add up
    before the shuffle; members of a large cluster meet it in several tasks.
    """
    base = _usable(rows, key, vec, width)
    members = cut(_clusters(base, width, cosine))
    sizes = members.groupBy("cluster").agg(F.count("*").alias("size"), (F.sum("degree") / 2).cast("long").alias("n_links"))
    held = cut(members.join(base, F.col("record") == F.col("id")).select("cluster", "record", "v"))
    unit = held.withColumn("l", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))
    unit = unit.select("cluster", "record", F.transform("v", lambda x: x.cast("double") / F.col("l")).alias("u"))
    sums = unit.groupBy("cluster").agg(*(F.sum(F.col("u")[i]).alias(f"s{i}") for i in range(width)))
    sums = sums.join(sizes, "cluster").select("cluster", "size", F.array(*(F.col(f"s{i}") for i in range(width))).alias("s"), F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / MEDOID_ROWS).cast("int"))).alias("salt"))
    salts = sizes.select("cluster", (F.floor((F.col("size") - 1) / MEDOID_ROWS) + 1).cast("int").alias("salts")).where("salts > 1")
    # a cluster over MEDOID_ROWS is one of at most total / MEDOID_ROWS; the others have one salt
    salted = unit.join(salts, "cluster", "left").withColumn("salt", F.pmod(F.xxhash64("record"), F.coalesce("salts", F.lit(1))).cast("int"))
    near = salted.join(sums, ["cluster", "salt"]).select("cluster", "record", F.round(F.aggregate(F.zip_with("u", "s", lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x) / F.col("size"), 9).alias("mean"))
    best = Window.partitionBy("cluster").orderBy(F.desc("mean"), "record")
    top = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= typical).groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("place", "record"))).alias("t"))
    return sizes.join(top, "cluster").select(F.col("cluster").alias("cluster_id"), "size", "n_links", (F.col("n_links") * 2 == F.col("size") * (F.col("size") - 1)).alias("mutual"), F.col("t.record").alias("typical"))


def mutual_members(clusters: DataFrame) -> DataFrame:
    """(cluster_id, chunk_id) of the clusters in which every pair is similar."""
    whole = clusters.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("degree").alias("d")).where("d = n * (n - 1)").select("cluster")
    return clusters.join(whole, "cluster").select(F.col("cluster").alias("cluster_id"), F.col("record").alias("chunk_id"))
