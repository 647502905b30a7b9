"""Near-duplicate chunks within a document (or any block): pairs, groups, survivors, report."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafspark.functions.vectors import usable
from leafspark.session import cut, release

#: Rows of a block on one side of a task's pairs.
PAIR_ROWS = 8_000
#: Blocks with more rows than that whose list is broadcast, so that a hot block is salted where it is scanned; more are joined.
MOST_BIG = 100_000
STRATEGIES = ("first", "longest", "best_metadata")


def pairwise(chunks: DataFrame, block: str, item: str, vec: str = "embedding", threshold: float | None = None) -> DataFrame:
    """(block, i, j, sim) with i < j for the usable vectors of each block, of equal width; from the threshold on, if there is one.

    The rows of a block are split by a salt of at most about PAIR_ROWS, and every pair of
    salts is one task with one matrix product, from which only the pairs at or over the
    threshold leave. A row is sent as often as its block has salts, once for a small block.
    Without a threshold all pairs of a block come out: for blocks of a document's size.
    """
    kinds = dict(chunks.dtypes)
    base = chunks.where(usable(F.col(vec)) & F.col(item).isNotNull()).select(F.col(block).alias("block"), F.col(item).alias("i"), F.col(vec).cast("array<double>").alias("v"), F.size(vec).alias("width"))
    big = cut(base.groupBy(F.col("block").alias("_b"), F.col("width").alias("_w")).agg(F.ceil(F.count("*") / PAIR_ROWS).cast("int").alias("salts")).where("salts > 1"))
    big = F.broadcast(big) if big.count() <= MOST_BIG else big
    salted = base.join(big, F.col("block").eqNullSafe(F.col("_b")) & (F.col("width") == F.col("_w")), "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    own = salted.withColumn("s", F.pmod(F.xxhash64("i"), F.col("salts")).cast("int")).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    least = -2.0 if threshold is None else float(threshold)

    def compare(table: pa.Table) -> pa.Table:
        s, t = table.column("s").to_numpy(), table.column("t").to_numpy()
        items = table.column("i").combine_chunks()
        place = pa.compute.rank(items, tiebreaker="dense").to_numpy()
        width = table.column("width")[0].as_py()
        x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        left = np.flatnonzero(s <= t)
        right = np.flatnonzero(s >= t)
        out: list[tuple] = []
        for at in range(0, len(left), 512):
            q = left[at : at + 512]
            sim = x[q] @ x[right].T
            a, b = np.nonzero(sim >= least - 1e-12)
            v, a, b = sim[a, b], q[a], right[b]
            once = place[a] < place[b] if left is right or (len(left) and s[left[0]] == t[left[0]]) else place[a] != place[b]
            a, b, v = a[once], b[once], v[once]
            flip = place[a] > place[b]
            out.append((np.where(flip, b, a), np.where(flip, a, b), v))
        i, j, v = (np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table({"block": table.column("block").take(pa.array(np.zeros(len(i), int))), "i": items.take(pa.array(i)), "j": items.take(pa.array(j)), "sim": pa.array(v)})

    keys = [F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")]
    return own.groupBy("block", "width", *keys).applyInArrow(compare, f"block {kinds[block]}, i {kinds[item]}, j {kinds[item]}, sim double")


def duplicate_pairs(chunks: DataFrame, block: str, item: str, threshold: float = 0.85, vec: str = "embedding") -> DataFrame:
    if not 0 <= threshold <= 1:
        raise ValueError("threshold is within 0 and 1")
    return pairwise(chunks, block, item, vec, threshold)


def duplicate_groups(pairs: DataFrame) -> DataFrame:
    """(block, group_id, item): connected items of each block under their smallest item.

    Labels of the smallest neighbour spread, and jump along labels' labels, until none
    changes; every round is written, so that a lost executor costs one round.
    """
    both = pairs.select("block", F.explode(F.array(F.struct(F.col("i").alias("x"), F.col("j").alias("y")), F.struct(F.col("j").alias("x"), F.col("i").alias("y")))).alias("e")).select("block", "e.*").distinct()
    edges = cut(both)
    labels = cut(edges.groupBy("block", "x").agg(F.least(F.min("y"), F.col("x")).alias("l")))
    while True:
        near = edges.join(labels.select("block", F.col("x").alias("y"), F.col("l").alias("ly")), ["block", "y"]).groupBy("block", "x").agg(F.min("ly").alias("near"))
        hop = labels.select("block", F.col("x").alias("l"), F.col("l").alias("far"))
        new = cut(labels.join(near, ["block", "x"]).join(hop, ["block", "l"], "left").select("block", "x", F.least("l", "near", "far").alias("l2"), (F.least("l", "near", "far") < F.col("l")).alias("moved")))
        done = new.where("moved").isEmpty()
        release(labels)
        labels = new.select("block", "x", F.col("l2").alias("l"))
        if done:
            return labels.select("block", F.col("l").alias("group_id"), F.col("x").alias("item"))


def representatives(chunks: DataFrame, groups: DataFrame, block: str, item: str, strategy: str = "first") -> DataFrame:
    """(block, group_id, item, keep): one kept item per group by the strategy, ties to the smaller item.

    first: the smallest original_position; longest: the most characters; best_metadata: the
    most weight of headers that are there, 6 for h1 down to 1 for h6. The kept row is found
    by an aggregate, combined before the shuffle, not by gathering the group.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {STRATEGIES}")
    weight = sum((F.when(F.col(f"h{k}") != "", 7 - k).otherwise(0) for k in range(1, 7)), F.lit(0)) if strategy == "best_metadata" else None
    key = {"first": lambda: F.col("original_position").cast("long"), "longest": lambda: -F.length("content").cast("long"), "best_metadata": lambda: -weight.cast("long")}[strategy]()
    facts = chunks.select(F.col(block).alias("block"), F.col(item).alias("item"), key.alias("k"))
    j = groups.join(facts, ["block", "item"])
    best = j.groupBy("block", "group_id").agg(F.min(F.struct("k", "item"))["item"].alias("kept"))
    return groups.join(best, ["block", "group_id"]).select("block", "group_id", "item", (F.col("item") == F.col("kept")).alias("keep"))


def deduplicate(chunks: DataFrame, chosen: DataFrame, block: str, item: str, dry_run: bool = False) -> DataFrame:
    """Chunks without the removed ones; a dry run returns all."""
    if dry_run:
        return chunks
    gone = chosen.where("not keep").select(F.col("block").alias(block), F.col("item").alias(item))
    return chunks.join(gone, [block, item], "left_anti")


def report(chunks: DataFrame, chosen: DataFrame, block: str, dry_run: bool = False) -> DataFrame:
    """Per block: original_count, deduplicated_count, removed_count, n_groups, reduction_percentage (0 for none)."""
    total = chunks.groupBy(F.col(block).alias("block")).agg(F.count("*").alias("original_count"))
    gone = chosen.groupBy("block").agg(F.sum((~F.col("keep")).cast("long")).alias("removed"), F.sum(F.col("keep").cast("long")).alias("groups"))
    j = total.join(gone, "block", "left")
    removed, groups = F.coalesce("removed", F.lit(0)).cast("long"), F.coalesce("groups", F.lit(0)).cast("long")
    left = F.col("original_count") - (F.lit(0) if dry_run else removed)
    share = F.when(F.col("original_count") > 0, (F.col("original_count") - left) / F.col("original_count") * 100).otherwise(0.0)
    return j.select("block", "original_count", left.cast("long").alias("deduplicated_count"), removed.alias("removed_count"), groups.alias("n_groups"), F.round(share, 6).alias("reduction_percentage"))


def report_text(chunks: DataFrame, chosen: DataFrame, block: str, dry_run: bool = False, most_groups: int = 100) -> DataFrame:
    """(block, report) as text: the counts, the groups with up to 3 of their items, and up to 10 removed items.

    Groups come in the order of their smallest item, at most most_groups of a block with the
    number of the others. Whole lists are the rows of representatives() themselves.
    """
    counts = report(chunks, chosen, block, dry_run)
    text = lambda c: F.col(c).cast("string")
    in_group = Window.partitionBy("block", "group_id").orderBy("item")
    shown = chosen.withColumn("k", F.row_number().over(in_group)).where("k <= 3").groupBy("block", "group_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item"))), lambda x: x["item"].cast("string")), ", ").alias("ids"))
    sizes = chosen.groupBy("block", "group_id").agg(F.count("*").alias("n"))
    line = F.concat(F.lit("  "), text("n"), F.lit(" chunks: "), "ids", F.when(F.col("n") > 3, ", ...").otherwise(""))
    order = Window.partitionBy("block").orderBy("group_id")
    groups = shown.join(sizes, ["block", "group_id"]).withColumn("line", line).withColumn("k", F.row_number().over(order)).where(F.col("k") <= most_groups)
    groups = groups.groupBy("block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    gone = chosen.where("not keep").withColumn("k", F.row_number().over(Window.partitionBy("block").orderBy("item"))).where("k <= 10")
    gone = gone.groupBy("block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item"))), lambda x: x["item"].cast("string")), ", ").alias("removed"))
    j = counts.join(groups, "block", "left").join(gone, "block", "left")
    head = F.format_string("Chunks: %d, after deduplication: %d, removed: %d (%.1f %%)\nGroups of duplicates: %d\n", "original_count", "deduplicated_count", "removed_count", "reduction_percentage", "n_groups")
    more = F.when(F.col("n_groups") > most_groups, F.concat(F.lit("\n  and "), (F.col("n_groups") - most_groups).cast("string"), F.lit(" more groups"))).otherwise("")
    left = F.when(F.col("removed_count") > 10, F.concat(F.lit(", and "), (F.col("removed_count") - 10).cast("string"), F.lit(" more"))).otherwise("")
    body = F.when(F.col("n_groups") > 0, F.concat("lines", more, F.lit("\nRemoved: "), "removed", left, F.lit("\n"))).otherwise("")
    return j.select("block", F.concat(head, body).alias("report"))


def exact_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(text_hash, keep_id, n): texts that occur more than once, with the smallest id."""
    return docs.where(F.col(text).isNotNull()).groupBy(F.sha2(text, 256).alias("text_hash")).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n")).where("n > 1")
