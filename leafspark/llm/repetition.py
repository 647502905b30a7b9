"""Repetition inside a single document.

Two measures come out of one pass over the whole texts:

* ``repeated_share``: words inside a six-word sequence that also starts at an earlier word,
  as a share of all words. It is counted exactly.
* ``js_words``, ``js_classes``: Jensen-Shannon distances of the text's histogram of common
  words and of its histogram of character classes to the nearest language reference. The
  references are counted over all documents. Texts below a minimum length get null.

A distance to a language cannot tell repeated text from short or technical text (a paragraph
pasted twice has the histogram of the paragraph), so the distances describe the text and the
exact share decides.

A text of n words with d distinct ones holds at most n - d repeated words, since every
repeated word also stands earlier; where that bound is under the sequence length the share
is 0 without further work.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafspark.session import cut, release

WORD = re.compile(r"[^\W\d_]+")
SEQUENCE = 6
COMMON = 100
#: Lower, upper, digit, white space, ASCII punctuation, other letters, other marks.
CLASSES = 7
MIN_WORDS, MIN_CHARS = 20, 80
#: A language is a reference if it holds at least this share of the words; there are at most 1 / share of them.
MIN_LANG_SHARE = 0.01


def _class_table() -> np.ndarray:
    t = np.empty(65536, np.uint8)
    for i in range(65536):
        c = chr(i)
        t[i] = 3 if c.isspace() else 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 5 if c.isalpha() else 4 if i < 128 else 6
    return t


_TABLE: np.ndarray | None = None


def class_counts(texts: list[str]) -> np.ndarray:
    """Characters of each class, a row per text."""
    global _TABLE
    _TABLE = _class_table() if _TABLE is None else _TABLE
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.where(points < 65536, _TABLE[np.minimum(points, 65535)], 5).astype(np.int64)
    rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return np.bincount(rows * CLASSES + kinds, minlength=len(texts) * CLASSES).reshape(-1, CLASSES)


def repeated_words(words: list[str], k: int = SEQUENCE) -> int:
    """Words inside a k-word sequence that also starts at an earlier word."""
    n = len(words)
    if n - len(set(words)) < k:
        return 0
    seen, count, covered = set(), 0, 0
    for i, gram in enumerate(zip(*(words[j:] for j in range(k)))):
        if gram in seen:
            count += i + k - max(covered, i)
            covered = i + k
        else:
            seen.add(gram)
    return count


def language_references(documents: DataFrame, text: str = "text", lang: str = "lang") -> list[tuple[str, list[str], list[float], list[float]]]:
    """(language, common words, their shares and at the end that of all others, shares of the character classes).

    Every document counts. Each task sends its word counts per language, summed before the
    shuffle; what comes to the driver is COMMON words of each of at most 1 / MIN_LANG_SHARE
    languages.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = defaultdict(Counter)
        chars: dict[str, np.ndarray] = {}
        for b in batches:
            by = defaultdict(list)
            for g, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by[g].append(t)
            for g, texts in by.items():
                for t in texts:
                    words[g].update(WORD.findall(t.lower()))
                chars[g] = chars.get(g, 0) + class_counts(texts).sum(axis=0)
            if sum(map(len, words.values())) > 200_000:
                yield from flush(words, chars)
                words.clear()
                chars.clear()
        yield from flush(words, chars)

    def flush(words: dict[str, Counter], chars: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for g, c in words.items():
            keys = [*c, *(f"\0{i}" for i in range(CLASSES))]
            yield pa.RecordBatch.from_pydict({"lang": [g] * len(keys), "word": keys, "n": [*c.values(), *map(int, chars[g])]}, pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]))

    tongue = F.coalesce(F.lower(F.trim(F.col(lang))), F.lit(""))
    n = documents.where(F.col(text).isNotNull()).select(tongue.alias("lang"), F.col(text).alias("text")).mapInArrow(counts, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    n = cut(n)
    letters = ~F.col("word").startswith("\0")
    totals = {r["lang"]: r["n"] for r in n.where(letters).groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(int(1 / MIN_LANG_SHARE)).collect()}
    everything = sum(totals.values())
    languages = sorted(x for x, k in totals.items() if k and k >= MIN_LANG_SHARE * everything)
    # the window keeps COMMON rows of a language, and each task sends no more than that
    most = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top, kinds = defaultdict(list), defaultdict(dict)
    for r in n.where(letters & F.col("lang").isin(languages)).withColumn("place", F.row_number().over(most)).where(F.col("place") <= COMMON).orderBy("lang", "place").collect():
        top[r["lang"]].append((r["word"], r["n"] / totals[r["lang"]]))
    for r in n.where(~letters & F.col("lang").isin(languages)).collect():
        kinds[r["lang"]][r["word"]] = r["n"]
    out = []
    for g in languages:
        c = [kinds[g].get(f"\0{i}", 0) for i in range(CLASSES)]
        shares = [x for _, x in top[g]]
        out.append((g, [w for w, _ in top[g]], [*shares, max(0.0, 1 - sum(shares))], [float(x) / max(1, sum(c)) for x in c]))
    release(n)
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of every row of p to q: 0 the same, 1 disjoint."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def measure(texts: DataFrame, references: list, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """One row per key: n_words, repeated_words, repeated_share, js_words, js_classes, nearest_lang.

    Null keys are dropped; a null or wordless text has share 0 and null distances. A key sent
    twice is one row: of differing rows the one with the most words (then the larger share) stays.
    """
    schema = "id string, n_words int, repeated_words int, repeated_share double, js_words double, js_classes double, nearest_lang string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = {w: i for i, w in enumerate(sorted({w for _, ws, _, _ in references for w in ws}))}
        picks = [np.array([vocabulary[w] for w in ws], np.int64) for _, ws, _, _ in references]
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                contents = [x or "" for x in part.column(1).to_pylist()]
                n, rep, rows, cols = [], [], [], []
                for i, t in enumerate(contents):
                    words = WORD.findall(t.lower())
                    n.append(len(words))
                    rep.append(repeated_words(words))
                    ids = [j for w in words if (j := vocabulary.get(w)) is not None]
                    cols += ids
                    rows += [i] * len(ids)
                total = np.array(n)
                v = max(1, len(vocabulary))
                hist = np.bincount(np.array(rows, np.int64) * v + np.array(cols, np.int64), minlength=len(n) * v).reshape(-1, v)
                chars = class_counts(contents)
                length = chars.sum(axis=1)
                kinds = chars / np.maximum(1, length)[:, None]
                best_w, best_c, best = np.full(len(n), np.inf), np.full(len(n), np.inf), np.full(len(n), -1)
                for g, (_, _, shares, classes) in enumerate(references):
                    own = hist[:, picks[g]]
                    p = np.concatenate([own, (total - own.sum(axis=1))[:, None]], axis=1) / np.maximum(1, total)[:, None]
                    d = js_distance(p, np.array(shares))
                    best_c = np.minimum(best_c, js_distance(kinds, np.array(classes)))
                    best = np.where(d < best_w, g, best)
                    best_w = np.minimum(best_w, d)
                short = (total < MIN_WORDS) | (length < MIN_CHARS) | (best < 0)
                names = [None if s else references[g][0] for s, g in zip(short, best)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int32()), pa.array(rep, pa.int32()), pa.array(np.array(rep) / np.maximum(1, total), pa.float64()), pa.array(best_w, pa.float64(), mask=short), pa.array(best_c, pa.float64(), mask=short), pa.array(names, pa.string())],
                    names=["id", "n_words", "repeated_words", "repeated_share", "js_words", "js_classes", "nearest_lang"],
                )

    found = texts.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("id"), F.col(text).cast("string").alias("content")).mapInArrow(run, schema)
    one = F.max(F.struct("n_words", "repeated_share", "repeated_words", "js_words", "js_classes", "nearest_lang"))
    return found.groupBy("id").agg(one.alias("m")).select(F.col("id").alias(key), "m.n_words", "m.repeated_words", "m.repeated_share", "m.js_words", "m.js_classes", "m.nearest_lang")


def repetitive(texts: DataFrame, references: list, least: float = 0.5, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """Keys of the texts of which at least that share of the words is repeated."""
    return measure(texts, references, key, text).where((F.col("n_words") > 0) & (F.col("repeated_share") >= least)).select(key)
