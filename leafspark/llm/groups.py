"""Consolidating pairwise matches into groups.

The graph of matches is reduced before it is solved: vertices of degree one are stripped and
chains of degree-two vertices compressed by list ranking (pointer doubling over directed
edges), again and again while that pays. What is left, the core, is contracted along minimum
neighbours until it has at most CORE_EDGES edges, which one task solves. Every reduction
records a parent for each vertex that it removes; undone in reverse, they restore the labels.

No step collects edges, vertices or components to the driver; only counts reach it. A vertex
with very many pairs is only ever aggregated (count, min, max: combined before the shuffle):
stripping and compressing use edges as keys, and where rows are joined on a vertex or a
group, a hot one is split by a salt.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafspark.session import cut, release

#: A further round of stripping and compressing is worth its jobs while it removes at least this share of the edges.
STRIP_SHARE = 0.02
#: Edges that one task solves.
CORE_EDGES = 200_000
#: A key with more rows than this, and than this part of all, is split.
HOT_ROWS, HOT = 50_000, 1_000


def clean_id(c: F.Column) -> F.Column:
    """Ids compare trimmed and in lower case; a blank id is a missing id."""
    t = F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(t != "", t)


def links(pairs: DataFrame, min_score: float = 0.85, a: str = "chunk_a", b: str = "chunk_b", score: str = "sim") -> DataFrame:
    """(u, v) with u < v, each link once. Null or blank ids, a record with itself, null or NaN scores are no link."""
    p = pairs.select(clean_id(F.col(a)).alias("a"), clean_id(F.col(b)).alias("b"), F.col(score).cast("double").alias("s"))
    p = p.where("a is not null and b is not null and a <> b and s is not null and not isnan(s)").where(F.col("s") >= min_score)
    return p.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


class _Tables:
    """Tables written on the way, deleted together."""

    def __init__(self) -> None:
        self.held: list[DataFrame] = []

    def cut(self, df: DataFrame) -> DataFrame:
        self.held.append(cut(df))
        return self.held[-1]

    def release(self) -> None:
        for df in self.held:
            release(df)


def look_up(rows: DataFrame, key: str, table: DataFrame, at: str = "x") -> DataFrame:
    """Rows joined on a key with the one row that a table has for it; rows without one are dropped.

    A key with more than the HOT-th part of the rows (and more than HOT_ROWS) is split by a
    salt. There are fewer than HOT such keys, whose list is broadcast.
    """
    total = rows.count()
    if total <= HOT_ROWS:
        return rows.join(table, F.col(key) == F.col(at))
    most = max(HOT_ROWS, total // HOT)
    hot = rows.groupBy(F.col(key).alias("_k")).agg(F.ceil(F.count("*") / most).cast("int").alias("_n")).where("_n > 1")
    salts = F.coalesce("_n", F.lit(1))
    left = rows.join(F.broadcast(hot), F.col(key) == F.col("_k"), "left").withColumn("_s", F.pmod(F.xxhash64(*rows.columns), salts).cast("int")).drop("_k", "_n")
    right = table.join(F.broadcast(hot), F.col(at) == F.col("_k"), "left").withColumn("_t", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_k", "_n")
    return left.join(right, (F.col(key) == F.col(at)) & (F.col("_s") == F.col("_t"))).drop("_s", "_t")


def _degrees(edges: DataFrame) -> DataFrame:
    """(x, n, lo, hi): degree, smallest and largest neighbour of every vertex; combined before the shuffle."""
    both = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))).alias("e"))
    return both.groupBy("e.x").agg(F.count("*").alias("n"), F.min("e.y").alias("lo"), F.max("e.y").alias("hi"))


def _strip(edges: DataFrame, keep: _Tables) -> tuple[DataFrame, DataFrame]:
    """(edges left, (x, parent) of the stripped vertices). Of a lone pair the larger id is stripped.

    The only neighbour of a vertex of degree one is its smallest, and its edge is a key of its
    own, so that no row is ever joined on a vertex.
    """
    leaves = _degrees(edges).where("n = 1").select(F.least("x", "lo").alias("u"), F.greatest("x", "lo").alias("v"), "x", F.col("lo").alias("parent"))
    gone = keep.cut(leaves.groupBy("u", "v").agg(F.max(F.struct("x", "parent")).alias("m")).select("u", "v", "m.x", "m.parent"))
    return keep.cut(edges.join(gone.select("u", "v"), ["u", "v"], "left_anti")), gone.select("x", "parent")


def _compress(edges: DataFrame, keep: _Tables) -> tuple[DataFrame, DataFrame] | None:
    """Replace every chain of degree-two vertices by one edge between its ends; None if there is no such vertex.

    List ranking: the directed edge (s, t) out of a chain vertex s points at the next one,
    (t, other neighbour of t), if t is in the chain too. Doubling the pointers takes every
    directed edge to the last one of its chain in log2(length) rounds, of which each writes
    only the pointers that still move. In each round those of a chain whose end comes near
    arrive, so a round without any leaves only cycles of degree-two vertices, whose edges stay.
    """
    chain = keep.cut(_degrees(edges).where("n = 2"))
    if chain.isEmpty():
        return None
    ways = [("lo", "hi"), ("hi", "lo")]
    out = [chain.select(F.col("x").alias("s"), F.col(a).alias("t"), F.lit(True).alias("out"), F.lit(None).cast("string").alias("o")) for a, _ in ways]
    into = [chain.select(F.col(a).alias("s"), F.col("x").alias("t"), F.lit(False).alias("out"), F.col(b).cast("string").alias("o")) for a, b in ways]
    kind = dict(edges.dtypes)["u"]
    d = out[0].union(out[1]).union(into[0]).union(into[1]).groupBy("s", "t").agg(F.max("out").alias("out"), F.max("o").cast(kind).alias("o")).where("out")
    first = keep.cut(d.select("s", "t", F.when(F.col("o").isNull(), F.col("s")).otherwise(F.col("t")).alias("cs"), F.coalesce("o", "t").alias("ct"), F.col("o").isNull().alias("done")))
    arrived, moving, n = first.where("done"), first.where("not done"), -1
    while (left := moving.count()) and left != n:
        n = left
        q = arrived.union(moving).select(F.col("s").alias("qs"), F.col("t").alias("qt"), F.col("cs").alias("qcs"), F.col("ct").alias("qct"), F.col("done").alias("qdone"))
        new = keep.cut(moving.join(q, (F.col("cs") == F.col("qs")) & (F.col("ct") == F.col("qt"))).select("s", "t", F.col("qcs").alias("cs"), F.col("qct").alias("ct"), F.col("qdone").alias("done")))
        arrived, moving = arrived.union(new.where("done")), new.where("not done")
    ends = keep.cut(arrived.groupBy("s").agg(F.min("ct").alias("a"), F.max("ct").alias("b")))
    short = ends.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    ring = moving.select(F.least("s", "t").alias("u"), F.greatest("s", "t").alias("v"))
    of_chains = first.select(F.least("s", "t").alias("u"), F.greatest("s", "t").alias("v")).distinct()
    rest = edges.join(of_chains, ["u", "v"], "left_anti").union(short).union(ring).distinct()
    return keep.cut(rest), ends.select(F.col("s").alias("x"), F.col("a").alias("parent"))


def _contract(edges: DataFrame, keep: _Tables) -> tuple[DataFrame, DataFrame]:
    """One contraction: every vertex joins its smallest neighbour if that is smaller; trees collapse to their roots."""
    p = keep.cut(_degrees(edges).select("x", F.least("x", "lo").alias("parent")))
    while True:
        up = p.select(F.col("x").alias("at"), F.col("parent").alias("above"))
        j = keep.cut(look_up(p, "parent", up, "at").select("x", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved")))
        p = j.select("x", "parent")
        if j.where("moved").isEmpty():
            break
    root = lambda at, to: p.select(F.col("x").alias(at), F.col("parent").alias(to))
    half = keep.cut(look_up(edges, "u", root("a", "ru"), "a").select("ru", "v"))
    e = look_up(half, "v", root("b", "rv"), "b").where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()
    return keep.cut(e), p.where("x <> parent")


def _solve(edges: DataFrame) -> DataFrame:
    """(x, root) of the vertices of at most CORE_EDGES edges, in one task, by union-find."""

    def run(table: pa.Table) -> pa.Table:
        root: dict = {}
        for a, b in zip(table.column("u").to_pylist(), table.column("v").to_pylist()):
            for x in (a, b):
                root.setdefault(x, x)
            while root[a] != a:
                root[a] = a = root[root[a]]
            while root[b] != b:
                root[b] = b = root[root[b]]
            root[max(a, b)] = min(a, b)
        for x in root:
            y = x
            while root[y] != y:
                y = root[y]
            root[x] = y
        kind = table.column("u").type
        return pa.table({"x": pa.array(list(root), kind), "root": pa.array(list(root.values()), kind)})

    kind = dict(edges.dtypes)["u"]
    return edges.groupBy(F.lit(0).alias("one")).applyInArrow(run, f"x {kind}, root {kind}")


def connected_groups(edges: DataFrame) -> DataFrame:
    """(x, group): every vertex of the edges (u, v), u < v, with the smallest vertex it is linked to, directly or not.

    An empty table gives no rows; repeated edges do no harm.
    """
    keep = _Tables()
    edges = keep.cut(edges.select("u", "v").where("u < v").distinct())
    before, n, removed = -1, edges.count(), []
    if not n:
        return edges.select(F.col("u").alias("x"), F.col("v").alias("group"))
    while n and (before < 0 or (n > CORE_EDGES and before - n >= STRIP_SHARE * before)):
        before = n
        edges, gone = _strip(edges, keep)
        removed.append(gone)
        if not edges.isEmpty() and (less := _compress(edges, keep)):
            edges = less[0]
            removed.append(less[1])
        n = edges.count()
    while n > CORE_EDGES:
        edges, gone = _contract(edges, keep)
        removed.append(gone)
        n = edges.count()
    # vertices that only the removed ones name are roots too
    roots = keep.cut(_solve(edges))
    for gone in reversed(removed):
        gone = keep.cut(gone)
        alone = gone.select(F.col("parent").alias("x")).distinct().join(roots.select("x"), "x", "left_anti")
        base = keep.cut(roots.union(alone.select("x", F.col("x").alias("root"))))
        new = look_up(gone.select(F.col("x").alias("y"), "parent"), "parent", base).select(F.col("y").alias("x"), "root")
        roots = keep.cut(base.union(new))
    smallest = roots.groupBy(F.col("root").alias("r")).agg(F.min("x").alias("group"))
    out = cut(look_up(roots, "root", smallest, "r").select("x", "group"))
    keep.release()
    return out


def match_groups(pairs: DataFrame, min_score: float = 0.85) -> DataFrame:
    """(chunk_id, group_id) of every linked id; see links() for what is a link."""
    return connected_groups(links(pairs, min_score)).select(F.col("x").alias("chunk_id"), F.col("group").alias("group_id"))


def group_sizes(pairs: DataFrame, min_score: float = 0.85) -> DataFrame:
    """(group_id, n_members, n_links) of every group."""
    e = cut(links(pairs, min_score))
    groups = cut(connected_groups(e))
    linked = look_up(e, "u", groups).groupBy("group").agg(F.count("*").alias("n_links"))
    return groups.groupBy("group").agg(F.count("*").alias("n_members")).join(linked, "group").select(F.col("group").alias("group_id"), "n_members", "n_links")
