"""Evaluation texts leaking into training text.

Latent semantic retrieval with exact checks:

1. The words of the test items are the vocabulary. Their document frequencies are counted over
   all documents, and item passages of PASSAGE words become TF-IDF vectors.
2. A distributed randomised SVD of the passages' TF-IDF matrix gives the latent space: each
   task sends the product of its rows with a random matrix, of the size vocabulary x RANK.
3. Every window of RUN words of every document that holds enough words of the vocabulary is
   projected (by running sums of its words' latent vectors) and compared by cosine with all
   item passages. Candidates are the items whose passage reaches the bound.
4. Each item has its own bound, calibrated on it: every window of RUN words of the item is
   projected in the same way, and the bound is the least cosine with which any of them finds
   a passage of the item. A verbatim run of RUN words in a document is such a window, word by
   word, so the search cannot miss one.
5. Candidates are checked: equal runs of RUN words, or, for paraphrases, the longest common
   subsequence of the item passage and the document's words around the window, together with
   the item's answer words (numbers and rare words), of which a paraphrase keeps most. The
   latter goes over every window and passage from the cosine NEAR on, whatever the bound is.

The items are the stated query set. They are taken in blocks of ITEM_BLOCK items, PASS_BLOCKS
of which share a pass over the documents, so what the driver holds and each task gets is
bounded; documents are only ever streamed through tasks.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
RUN, PASSAGE, RANK = 12, 24, 64
ITEM_BLOCK, PASS_BLOCKS = 2_000, 4
#: A window's words in the vocabulary from which on it is compared, for paraphrases.
LEAST_KNOWN = 9
#: A paraphrase needs this cosine, share of the passage in the common subsequence, and share of its answer words.
NEAR, COMMON_SHARE, ANSWER_SHARE = 0.6, 0.7, 0.8


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def randomised_svd(rows: DataFrame, n_columns: int, rank: int, seed: int = 5) -> np.ndarray:
    """(n_columns x rank) right singular vectors of the sparse matrix with one row (cols array<int>, vals array<double>) a record.

    Two passes of the range finder; each task sums its rows' products, so a task sends one
    block of n_columns x (rank + 8) numbers, summed by column before it comes to the driver.
    """
    width = min(rank + 8, n_columns)
    basis = np.random.default_rng(seed).standard_normal((n_columns, width))

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_columns, width))
        for b in batches:
            for c, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c, v = np.array(c, np.int64), np.array(v)
                np.add.at(total, c, v[:, None] * (v @ basis[c]))
        for i in np.flatnonzero(total.any(axis=1)):
            yield pa.RecordBatch.from_pydict({"col": pa.array([i], pa.int32()), "row": pa.array([total[i].tolist()])})

    for _ in range(2):
        sums = rows.mapInArrow(product, "col int, row array<double>").groupBy("col").agg(F.array(*(F.sum(F.col("row")[i]) for i in range(width))).alias("row")).collect()
        z = np.zeros((n_columns, width))
        for r in sums:
            z[r["col"]] = r["row"]
        basis, _ = np.linalg.qr(z)
    return basis[:, :rank]


def _grams(ids: np.ndarray) -> list[bytes]:
    return [ids[i : i + RUN].tobytes() for i in range(len(ids) - RUN + 1)]


class _Items:
    """One block of items: vocabulary, latent vectors of its words, passages, runs and the calibrated bound."""

    def __init__(self, items: list[tuple], spark, docs: DataFrame) -> None:
        texts = [words(t) for _, t in items]
        self.keys = [k for k, _ in items]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
        self.ids = [np.array([self.vocabulary[w] for w in t], np.int32) for t in texts]
        n, freq = document_frequencies(docs, self.vocabulary)
        self.idf = np.log((n + 1) / (freq + 1)) + 1
        spans, self.owner = [], []
        for i, t in enumerate(self.ids):
            for at in range(0, max(1, len(t) - PASSAGE + RUN), PASSAGE - RUN):
                spans.append((i, at, t[at : at + PASSAGE]))
        self.owner = np.array([i for i, _, _ in spans], np.int32)
        self.spans = [t for _, _, t in spans]
        rows = []
        for t in self.spans:
            c = Counter(t.tolist())
            rows.append(([int(x) for x in c], [float(k * self.idf[x]) for x, k in c.items()]))
        frame = spark.createDataFrame(rows, "cols array<int>, vals array<double>")
        space = randomised_svd(frame, len(self.vocabulary), RANK)
        self.latent = np.vstack([self.idf[:, None] * space, np.zeros((1, space.shape[1]))]).astype(np.float32)
        p = np.stack([self.latent[t].sum(axis=0) for t in self.spans])
        self.passages = (p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        self.runs: dict[bytes, set[int]] = defaultdict(set)
        low = np.full(len(self.ids), np.inf, np.float32)
        for i, t in enumerate(self.ids):
            for g in _grams(t):
                self.runs[g].add(i)
            if len(t) >= RUN:
                w = windows(self.latent[t])
                low[i] = (w @ self.passages[self.owner == i].T).max(axis=1).min() - 1e-3
        self.bound = low[self.owner]
        self.least = np.minimum(self.bound, NEAR)
        rare = np.quantile(self.idf, 0.5) if len(self.idf) else 0
        names = np.array([w.isdigit() or self.idf[j] > rare for w, j in self.vocabulary.items()] + [False])
        self.answers = [set(t[names[t]].tolist()) for t in self.spans]


def windows(vectors: np.ndarray, size: int = RUN) -> np.ndarray:
    """Unit vectors of the sums of `size` rows in a row."""
    run = np.concatenate([np.zeros((1, vectors.shape[1])), np.cumsum(vectors, axis=0, dtype=np.float64)])
    w = run[size:] - run[:-size]
    return (w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def document_frequencies(docs: DataFrame, vocabulary: dict[str, int]) -> tuple[int, np.ndarray]:
    """(documents, documents that hold each word of the vocabulary), over all documents; a task sends one row per word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, freq, known = 0, Counter(), vocabulary.keys()
        for b in batches:
            for t in b.column(0).to_pylist():
                n += 1
                freq.update(known & set(words(t)))
        yield pa.RecordBatch.from_pydict({"w": pa.array([-1, *(vocabulary[w] for w in freq)], pa.int32()), "n": pa.array([n, *freq.values()], pa.int64())})

    out, n = np.zeros(len(vocabulary)), 0
    for r in docs.select("text").mapInArrow(count, "w int, n bigint").groupBy("w").agg(F.sum("n").alias("n")).collect():
        if r["w"] < 0:
            n = r["n"]
        else:
            out[r["w"]] = r["n"]
    return n, out


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def search(ids: np.ndarray, block: _Items) -> dict[int, tuple[str, int, float]]:
    """item -> (kind, longest equal run, cosine) for the items of which a document, given as vocabulary ids (-1: other words), holds a passage."""
    found: dict[int, tuple[str, int, float]] = {}
    there: set[int] = set()
    known = ids >= 0
    run = np.concatenate([[0], np.cumsum(known)])
    enough = np.flatnonzero(run[RUN:] - run[:-RUN] >= LEAST_KNOWN)
    if not len(enough):
        return found
    # only the stretches around such windows are projected
    splits = np.flatnonzero(np.diff(enough) > RUN)
    for first, last in zip(np.r_[0, splits + 1], np.r_[splits, len(enough) - 1]):
        at, end = enough[first], enough[last] + RUN
        starts = enough[first : last + 1] - at
        part = ids[at:end]
        w = windows(block.latent[part])[starts]
        for lo in range(0, len(w), 2048):
            s = w[lo : lo + 2048] @ block.passages.T
            row, passage = np.divmod(np.flatnonzero(s >= block.least), s.shape[1])
            if not len(row):
                continue
            cosine = s[row, passage]
            near = np.flatnonzero(cosine >= NEAR)
            # only passages whose answers the document holds at all
            there = there or set(ids.tolist())
            asked = np.zeros(s.shape[1], bool)
            asked[passage[near]] = True
            for p in np.flatnonzero(asked).tolist():
                answers = block.answers[p]
                asked[p] = bool(answers) and len(answers & there) >= ANSWER_SHARE * len(answers)
            near = near[asked[passage[near]]]
            near = near[np.argsort(passage[near], kind="stable")]
            at_near, p_near = at + starts[lo + row[near]], passage[near]
            row, passage = (x[cosine >= block.bound[passage]] for x in (row, passage))
            whole = run[at + starts[lo + row] + RUN] - run[at + starts[lo + row]] == RUN
            grams: dict[int, bytes] = {}
            for r, p in zip(row[whole].tolist(), passage[whole].tolist()):
                i = int(block.owner[p])
                if r not in grams:
                    grams[r] = part[starts[lo + r] : starts[lo + r] + RUN].tobytes()
                if i in block.runs.get(grams[r], ()):
                    n = _longest(ids, at + starts[lo + r], block, i)
                    if i not in found or found[i][0] != "verbatim" or found[i][1] < n:
                        found[i] = ("verbatim", n, float(s[r, p]))
            first = np.flatnonzero(np.diff(p_near, prepend=-1))
            for k, end_k in zip(first.tolist(), [*first[1:].tolist(), len(near)]):
                p = int(p_near[k])
                i = int(block.owner[p])
                if i not in found or found[i][0] != "verbatim":
                    c = _paraphrase(ids, at_near[k:end_k], cosine[near[k:end_k]], block, p, found[i][2] if i in found else 0.0)
                    if c:
                        found[i] = ("paraphrase", 0, c)
    return found


def _paraphrase(ids: np.ndarray, at: np.ndarray, cosine: np.ndarray, block: _Items, p: int, least: float) -> float:
    """The highest cosine over `least` of the windows, starting at words `at`, whose surroundings hold the passage; 0 for none.

    Only the passage's own words count, in the common subsequence and as answers: windows with
    the same of these around them are one, and windows with too few of them are none.
    """
    item, answers = block.spans[p], block.answers[p]
    own = np.zeros(len(block.latent), bool)
    own[item] = True
    a = np.maximum(0, at - PASSAGE // 2)
    place = a.min() + np.flatnonzero(own[ids[a.min() : a.max() + 2 * PASSAGE]])
    i, j = np.searchsorted(place, a), np.searchsorted(place, a + 2 * PASSAGE)
    left = np.flatnonzero((j - i >= COMMON_SHARE * len(item)) & (cosine > least))
    tried = set()
    for k in left[np.argsort(-cosine[left], kind="stable")].tolist():
        if (i[k], j[k]) in tried:
            continue
        tried.add((i[k], j[k]))
        around = ids[place[i[k] : j[k]]].tolist()
        if len(answers & set(around)) >= ANSWER_SHARE * len(answers) and common_subsequence(item.tolist(), around) >= COMMON_SHARE * len(item):
            return float(cosine[k])
    return 0.0


def _longest(ids: np.ndarray, at: int, block: _Items, item: int) -> int:
    """Length of the equal run that the window at a document's word starts."""
    n = RUN
    while at + n < len(ids) and item in block.runs.get(ids[at + n - RUN + 1 : at + n + 1].tobytes(), ()):
        n += 1
    return n


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, kind, run_words, cosine): the documents that hold an item, wholly or partly.

    kind verbatim: at least RUN consecutive words of the item, run_words of them in a row at
    most; kind paraphrase: see the module. Null or wordless texts and null ids give no row.
    Items under RUN words can only be found as paraphrases. Repeated items and documents count
    once; an item sent with differing texts is each of them under one id.
    """
    spark = documents.sparkSession
    schema = f"doc_id {dict(documents.dtypes)['doc_id']}, item_id {dict(items.dtypes)['item_id']}, kind string, run_words int, cosine double"
    asked = items.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    n = asked.count()
    blocks = max(1, -(-n // ITEM_BLOCK))
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    out, sent = None, []
    for k in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        rows = [(r["item_id"], r["text"]) for r in rows if words(r["text"])]
        if rows:
            sent.append(spark.sparkContext.broadcast(_Items(rows, spark, docs)))
        if sent and (len(sent) == PASS_BLOCKS or k == blocks - 1):
            one = docs.mapInArrow(_searcher(sent), schema)
            out, sent = one if out is None else out.union(one), []
    if out is None:
        return spark.createDataFrame([], schema)
    best = F.max(F.struct(F.when(F.col("kind") == "verbatim", 1).otherwise(0).alias("k"), "run_words", "cosine", "kind"))
    return out.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.kind", "b.run_words", "b.cosine")


def _searcher(sent: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(k, words(t)) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            for block in (x.value for x in sent):
                get, rows = block.vocabulary.get, []
                for k, t in texts:
                    ids = np.array([get(w, -1) for w in t], np.int32)
                    if len(ids) >= RUN:
                        rows += [(k, block.keys[i], kind, n, c) for i, (kind, n, c) in search(ids, block).items()]
                item = pa.int64() if all(isinstance(x, int) for x in block.keys) else pa.string()
                kinds = [b.column(0).type, item, pa.string(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, p) for x, p in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=["doc_id", "item_id", "kind", "run_words", "cosine"])

    return run
