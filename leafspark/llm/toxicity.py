"""Abusive, hateful or sexual content, by weak supervision.

1. The corpus is read once. Texts become sentences of word ids, written to the shared folder.
   Disguised terms are unmasked: digits for letters, letters set apart, repeated or replaced
   by a sign, invisible characters. Parts in quotation marks are set aside, since a quoted
   word is no insult. What a token holds is worked out once per distinct token.
2. Voters (term lists, the same with and without a second person, patterns, contexts that
   speak for a technical or reporting use, and the judgements of annotators) vote for,
   against or not at all, on every sentence of every document, per category.
3. A generative label model is fitted by expectation maximisation to the counts of vote
   patterns over all sentences: each voter's rates given the hidden class, whose share is
   taken from the annotated documents. Voters that agree beyond what the class explains are
   weighed down by their estimated correlations.
4. A linear classifier on hashed words, word beginnings and word pairs, with listed terms as
   their classes, is trained on the posterior labels of the sentences of a bounded sample of
   documents. It does not see the votes. In documents that annotators named a category for,
   the sentences to blame are found in turns with the training, by classifiers of the other
   half of the documents (multiple-instance learning), so that it learns what no list names.
5. The classifier scores every sentence of every document from the written ids; a document's
   score per category is the highest of its sentences.

What reaches the driver is the table of vote patterns (at most 3 to the number of voters per
category) and the sample: at most 2 x (JUDGED + JUDGED + OTHERS) documents, whatever the
size of the corpus.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafspark.llm.lexicon import BESIDE, CATEGORIES, PATTERNS, SECOND_PERSON, TERMS
from leafspark.session import cut, release

#: Documents of the sample: those that annotators named a category for, those they cleared, and others.
JUDGED, OTHERS = 3_000, 1_500
#: Sizes of the feature hash for words and pairs, and for word beginnings.
WORDS, PAIRS, STARTS = 1 << 17, 1 << 18, 1 << 15
BOUND = 0.5
ANNOTATOR, UNJUDGED, SHRINK = 0.9, 0.1, 20
#: Weight in the training of sentences without votes in documents that nobody judged, and rounds of training and blaming.
LIGHT, ROUNDS, EPOCHS = 0.3, 4, 5
#: Weight that a sentence gains in the training with its label, as few are to blame.
RARE = 3
#: Probability of a sentence at first, in a document that annotators named a category for.
START = 0.05
#: The words of a longer sentence share the weight of so many.
FULL_LENGTH = 24
#: Distinct tokens that a worker keeps.
KEPT_TOKENS = 400_000

INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2028-\u202e\u2060-\u2064\ufeff]")
LINE_BREAK = re.compile(r"\n(?:[^\S\n]*\n|(?=[ \t]*(?:[-*+>#]|\d+[.)])))")
ENDING = re.compile(r"[.!?。…][\"')\]*_]*$")
# starts with a set of characters, so that the scan runs from one to the next
QUOTED = re.compile(r"(['\"«“„‘])(?:(?<=['\"])(?<!\w['\"])(?=\S)[^'\"\n]{2,120}?\1(?!\w)|(?<=«)[^»\n]*»|(?<=“)[^”\n]*”|(?<=„)[^“”\n]*[“”]|(?<=‘)[^’\n]*’)")
TOKEN = re.compile(r"[^\W\d_]+")
LEET = str.maketrans("013457", "oieast")
APART = re.compile(r"(?<![^\W_])[^\W\d_](?:[.\-_*][^\W\d_]){2,}(?![^\W\d_])|(?<![가-힣])[가-힣](?:[.\-_*][가-힣])+")
SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?: [^\W\d_]){2,}(?: [^\W\d_]{2})?(?![^\W_])")
SINGLES = re.compile(r" [^\W\d_] [^\W\d_](?![^\W_])")
SYLLABLE = re.compile("[가-힣]")
HANGUL_PAIR = re.compile(r"(?<![가-힣])([가-힣]+) ([가-힣])(?![가-힣])")
RUN = re.compile(r"([^\W\d_])\1{2,}")
EDGES = ".,;:!?\"'()[]{}<>…|`~"
BREAK_MARK, QUOTE_MARK = "\x01", "\x02"

CLASSES: dict[str, tuple[str, ...]] = {}
for _c in CATEGORIES:
    for _t in TERMS[_c]:
        CLASSES[_t] = (*CLASSES.get(_t, ()), _c)
HANGUL = tuple(t for t in CLASSES if "가" <= t[0] <= "힣")
SQUEEZED = {re.sub(r"(.)\1+", r"\1", t): t for t in CLASSES}
MASKED = {f"{t[:i]}\0{t[i + 1 :]}": t for t in CLASSES if len(t) > 2 for i in range(len(t))}
VOTERS = {c: ["term", "disguised", "alone", *(n for k, n, _, _ in PATTERNS if k == c), "quoted", "annotated"] for c in CATEGORIES}
_PATTERNS = [(c, n, v, re.compile(p)) for c, n, v, p in PATTERNS]
_YOU = re.compile(SECOND_PERSON)


def literals(pattern: str) -> set[str]:
    """Strings of which any match of a pattern holds at least one; the empty string if none can be told."""
    from re import _constants as k
    from re import _parser as parser

    def of(seq) -> set[str]:
        best, run = {""}, ""
        better = lambda x: min(map(len, x)) > min(map(len, best))
        for op, arg in [*seq, (None, None)]:
            if op is k.LITERAL:
                run += chr(arg)
                continue
            if run and better({run}):
                best = {run}
            run = ""
            inner = None
            if op is k.SUBPATTERN:
                inner = of(arg[-1])
            elif op is k.BRANCH:
                inner = set().union(*(of(x) for x in arg[1]))
            elif op in (k.MAX_REPEAT, k.MIN_REPEAT) and arg[0] > 0:
                inner = of(arg[2])
            if inner and better(inner):
                best = inner
        return best

    return of(parser.parse(pattern))


_HINTS = None


def hints():
    """An automaton of what each pattern for a category must hold, without those that only count beside others; a text without a hit matches none of them."""
    global _HINTS
    if _HINTS is None:
        import ahocorasick

        _HINTS = ahocorasick.Automaton()
        for c, n, sign, p in _PATTERNS:
            for x in literals(p.pattern) if sign > 0 and (c, n) not in BESIDE else ():
                _HINTS.add_word(x, x)
        _HINTS.make_automaton()
    return _HINTS


def term(token: str) -> str | None:
    """The listed term that a token is, in singular or plural; Korean terms may carry particles."""
    if token in CLASSES:
        return token
    if token[-1:] == "s" and token[:-1] in CLASSES:
        return token[:-1]
    if "가" <= token[:1] <= "힣":
        return next((t for t in HANGUL if token.startswith(t)), None)
    return None


def _unmasked(token: str) -> str:
    """A disguised token as the listed term it hides, else unchanged."""
    core = token.strip(EDGES)
    if not core:
        return token
    plain = core.translate(LEET)
    if plain != core and term(plain):
        return term(plain)
    for t in (plain, plain.rstrip("s")):
        if RUN.search(t) and (hit := SQUEEZED.get(re.sub(r"(.)\1+", r"\1", t))):
            return hit
    signs = [i for i, c in enumerate(core) if c in "@#*$_!%&+?"]
    if len(signs) == 1:
        for t in (core, core[:-1] if core[-1] == "s" else core):
            if hit := MASKED.get(t[: signs[0]] + "\0" + t[signs[0] + 1 :]):
                return hit
    return token


def _joined(m: re.Match) -> str:
    """Letters set apart as the term they spell, after up to two letters of their own and before a word of two; marked for what it is."""
    t = re.sub(r"[ .\-_*]", "", m[0])
    for tail in (0, 2) if m[0][-3:-2] == " " else (0,):
        body = t[: len(t) - tail]
        for cut_at in (0, 1, 2):
            if hit := term(body[cut_at:]) if len(body) > cut_at + 1 else None:
                return f"{' '.join(body[:cut_at])} {hit}\3 {t[len(body) :]}"
    return m[0] if " " in m[0] else t


def _aside(m: re.Match) -> str:
    """What stays of a quotation: a mark, and one of each class that it names."""
    named = sorted({c for w in TOKEN.findall(m[0]) if (hit := term(w)) for c in CLASSES[hit]})
    return f" {QUOTE_MARK} " + "".join(f" {QUOTE_MARK}{c} " for c in named)


def prepared(text: str) -> list[str]:
    """The tokens of a text, with marks for ends of sentences at lines, and for quotations."""
    t = text if text.isascii() else INVISIBLE.sub("", text)
    t = t.lower()
    if "\r" in t:
        t = t.replace("\r\n", "\n").replace("\r", "\n")
    t = LINE_BREAK.sub(f" {BREAK_MARK} ", t)
    if "|" in t:
        t = t.replace("|", f" {BREAK_MARK} ")
    if "'" in t or '"' in t or not t.isascii():
        t = QUOTED.sub(_aside, t)
    if SINGLES.search(t) or SINGLES.match(f" {t[:4]}"):
        t = SPACED.sub(_joined, re.sub(r"-\s+-", " ", t))
    if not t.isascii() and SYLLABLE.search(t):
        t = HANGUL_PAIR.sub(lambda m: _joined(m) if m[1][-1:] + m[2] in CLASSES or m[1] + m[2] in CLASSES else m[0], t)
    return t.split()


def word_id(word: str) -> int:
    """31 bits: 15 of the word's beginning (5 letters, 2 of Hangul), 16 of the word."""
    start = word[:2] if "가" <= word[:1] <= "힣" else word[:5]
    return (zlib.crc32(start.encode("utf-8", "surrogatepass")) & 0x7FFF) << 16 | zlib.crc32(word.encode("utf-8", "surrogatepass")) >> 16


#: In place of a word at the end of a sentence; no word has this id.
END = -1
#: What a token tells about the sentence it is in.
TERM, QUOTES = 1, 2


class Tokens:
    """Word ids, words and flags of raw tokens, kept for tokens that come again; facts: whether one ends a sentence, has ids, and holds a term."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.of: dict[str, int] = {}
        self.words: list[tuple[str, ...]] = []
        self.facts: list[tuple[bool, bool, bool]] = []
        self.size = np.zeros(1024, np.int32)
        self.flag = np.zeros(1024, np.int8)
        self.first = np.zeros(1024, np.int64)
        self.ids = np.zeros(4096, np.int32)
        self.used = 0

    def add(self, w: str) -> int:
        ids, words, flag = self._read(w)
        k = len(self.words)
        if k == len(self.size):
            self.size, self.flag, self.first = (np.r_[x, np.zeros(k, x.dtype)] for x in (self.size, self.flag, self.first))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros(len(self.ids), np.int32)]
        self.ids[self.used : self.used + len(ids)] = ids
        self.size[k], self.flag[k], self.first[k] = len(ids), flag, self.used
        self.used += len(ids)
        self.words.append(words)
        ends = bool(ids) and ids[-1] == END
        self.facts.append((ends, len(ids) > ends, flag > 0))
        self.of[w] = k
        return k

    def _read(self, w: str) -> tuple[list[int], tuple[str, ...], int]:
        if w == BREAK_MARK:
            return [END], (), 0
        if w[0] == QUOTE_MARK:
            return ([word_id("<quote>")], (), 0) if w == QUOTE_MARK else ([], (w,), QUOTES)
        end = [END] if ENDING.search(w) else []
        if w.isalpha() and not RUN.search(w):
            words, hidden = [w], False
        else:
            u = APART.sub(_joined, w) if any(c in w for c in ".-_*") else w
            hidden = "\3" in u
            u = u if hidden else w
            words = []
            for part in u.split():
                plain = part.rstrip("\3")
                v = plain if plain.isalpha() and not RUN.search(plain) else _unmasked(plain)
                hidden |= v is not plain or plain is not part
                words += TOKEN.findall(v)
        ids, flag, out = [], 0, []
        for x in words:
            hit = term(x)
            if hit:
                flag |= TERM
                ids.append(word_id("<" + "+".join(CLASSES[hit]) + ">"))
            else:
                ids.append(word_id(x))
            out.append(x)
        if hidden:
            out.append("\3")
        return ids + end, tuple(out), flag

    def entries(self, raw: list[str]) -> list[int]:
        found = list(map(self.of.get, raw))
        if None in found:
            found = [k if k is not None else self.of[w] if w in self.of else self.add(w) for w, k in zip(raw, found)]
        return found


_TOKENS = Tokens()


def votes(words: list[str]) -> dict[str, list[int]]:
    """Votes per category, without the annotators', on the words of a sentence; empty if nothing speaks for any."""
    hidden = "\3" in words
    quoted = {w[1:] for w in words if w[0] == QUOTE_MARK}
    words = [w for w in words if w[0] not in "\2\3"]
    s = " ".join(words)
    named = {c for w in words if (hit := term(w)) for c in CLASSES[hit]}
    if not named and not quoted and not any(p.search(s) for c, n, sign, p in _PATTERNS if sign > 0 and (c, n) not in BESIDE):
        return {}
    said = {c: [sign * bool(p.search(s)) for k, _, sign, p in _PATTERNS if k == c] for c in CATEGORIES}
    you = bool(_YOU.search(s))
    out = {}
    for c in CATEGORIES:
        # a term alone, with nobody addressed and no pattern around it, speaks against; an insult to someone is no hate
        aimed = 1 in said[c] or (c == "abuse" and you)
        v = [int(c in named), int(c in named and hidden), int(c in named and you and c == "abuse") if aimed else -int(c in named)]
        out[c] = [*v, *said[c], -int(c in quoted and c not in named)]
    return out


def read(documents: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, ids, votes): word ids with END after each sentence, and the votes on sentences, one string per category.

    The only pass over the texts. A vote has the sentence's place among those with words and a
    hash of its words.
    """
    vote = "struct<at: int, h: bigint, " + ", ".join(f"{c}: string" for c in CATEGORIES) + ">"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, tokens = hints(), _TOKENS
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                if len(tokens.words) > KEPT_TOKENS:
                    tokens.clear()
                found, entries, size = [], [], []
                for t in part.column(1).to_pylist():
                    raw = prepared(t)
                    e = tokens.entries(raw)
                    entries.append(e)
                    size.append(len(e))
                    found.append(next(find.iter(" ".join(raw)), None) is not None)
                flat = np.fromiter(chain.from_iterable(entries), np.int64, sum(size))
                own = np.repeat(np.arange(len(entries)), size)
                flagged = np.bincount(own, tokens.flag[flat] > 0, len(entries)) > 0
                n = tokens.size[flat]
                ids = tokens.ids[np.repeat(tokens.first[flat] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                of = np.repeat(own, n)
                # an END after the last word of every document, and none after another
                last = np.flatnonzero(np.r_[of[1:] != of[:-1], True]) if len(of) else np.zeros(0, int)
                ids, of = np.insert(ids, last + 1, END), np.insert(of, last + 1, of[last])
                keep = (ids != END) | np.r_[False, (ids[:-1] != END) & (of[1:] == of[:-1])]
                ids, of = ids[keep], of[keep]
                cut_at = np.r_[0, np.cumsum(np.bincount(of, minlength=len(entries)))]
                said = [self_votes(tokens, entries[i], find) if found[i] or flagged[i] else [] for i in range(len(entries))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(cut_at, pa.int32()), pa.array(ids, pa.int32())), pa.array(said, pa.list_(pa.struct([("at", pa.int32()), ("h", pa.int64()), *((c, pa.string()) for c in CATEGORIES)])))], names=["doc_id", "ids", "votes"])

    key = dict(documents.dtypes)["doc_id"]
    return documents.where(F.col(text).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(text).cast("string").alias("t")).mapInArrow(run, f"doc_id {key}, ids array<int>, votes array<{vote}>")


def self_votes(tokens: Tokens, entries: list[int], find) -> list[dict]:
    """The votes on the sentences of a document that hold a term or what a pattern needs."""
    out, words, any_term, any_id, at = [], [], False, False, 0
    for k in [*entries, -1]:
        if k < 0:
            ends = True
        else:
            words += tokens.words[k]
            ends, has_ids, has_term = tokens.facts[k]
            any_term |= has_term
            any_id |= has_ids
        if ends:
            if any_id:
                if words and (any_term or next(find.iter(" ".join(words)), None) is not None):
                    v = votes(words)
                    if v:
                        out.append({"at": at, "h": zlib.crc32(" ".join(words).encode("utf-8", "surrogatepass")), **{c: "".join("-0+"[y + 1] for y in v[c]) for c in CATEGORIES}})
                at += 1
            words, any_term, any_id = [], False, False
    return out


def judgements(labels: DataFrame) -> DataFrame:
    """(doc_id, one + or - per category): + if at least half of those who judged the document named the category."""
    judged = labels.where("doc_id is not null and category is not null").select("doc_id", "annotator", F.lower(F.trim("category")).alias("category")).distinct()
    people = judged.groupBy("doc_id").agg(F.count_distinct(F.coalesce("annotator", F.lit(""))).alias("n"), *(F.sum((F.col("category") == c).cast("int")).alias(f"n_{c}") for c in CATEGORIES))
    return people.select("doc_id", *(F.when(2 * F.col(f"n_{c}") >= F.col("n"), "+").otherwise("-").alias(f"said_{c}") for c in CATEGORIES))


class LabelModel:
    """Rates of the votes of each voter given a hidden yes or no, with voters' correlations.

    The annotators' voice, the last of a pattern, has the fixed accuracy ANNOTATOR. Patterns
    with it count fully for the rates of the others, patterns without it UNJUDGED as much, so
    that the many sentences nobody judged refine the rates but do not turn the classes over.
    """

    def __init__(self, patterns: list[str], counts: list[int], rounds: int = 40) -> None:
        self.n = len(patterns[0])
        v = np.array([["-0+".index(c) for c in p] for p in patterns])  # 0 against, 1 none, 2 for
        judged = v[:, -1] != 1
        yes = float(np.dot(counts, v[:, -1] == 2))
        no = float(np.dot(counts, v[:, -1] == 0))
        self.base = math.log((yes + SHRINK) / (no + SHRINK))  # the share of yes among sentences with a voice for it, drawn to a half
        n = np.array(counts, float) * np.where(judged, 1.0, UNJUDGED)
        onehot = np.eye(3)[v]
        score = (v[:, :-1] == 2).sum(axis=1) - 2.0 * (v[:, :-1] == 0).sum(axis=1)
        y = np.where(judged, np.where(v[:, -1] == 2, ANNOTATOR, 1 - ANNOTATOR), 1 / (1 + np.exp(1.5 - score)))
        self.weight = np.ones(self.n)
        prior = 2 * np.stack([np.array([4.0, 4.0, 1.0]), np.array([1.0, 4.0, 4.0])])  # voters are taken to be better than chance
        for i in range(rounds):
            q = np.stack([1 - y, y])
            rate = np.einsum("kp,p,pvx->kvx", q, n, onehot) + prior[:, None, :]
            self.log = np.log(rate / rate.sum(axis=2, keepdims=True))
            self.log[:, -1] = np.log([[ANNOTATOR, 1, 1 - ANNOTATOR], [1 - ANNOTATOR, 1, ANNOTATOR]])
            if i >= 3:
                self.weight = self._independence(v - 1.0, n, y)
                self.weight[-1] = 1
            y = self.posterior_of(v)
        self.accuracy = self.log[1, :, 2] - self.log[0, :, 2]

    def _independence(self, v: np.ndarray, n: np.ndarray, y: np.ndarray) -> np.ndarray:
        """1 / the root of (1 + the sum of positive correlations with other voters, given the class)."""
        total = np.zeros((self.n, self.n))
        for q in (1 - y, y):
            w = q * n
            if w.sum() < 1e-6:
                continue
            d = v - np.average(v, axis=0, weights=w + 1e-12)
            c = (d * w[:, None]).T @ d / w.sum()
            s = np.sqrt(np.maximum(np.diag(c), 1e-9))
            total += c / np.outer(s, s) * w.sum() / n.sum()
        self.correlation = total
        off = np.clip(total - np.eye(self.n) * total, 0, 1)
        return 1 / np.sqrt(1 + off.sum(axis=1))

    def posterior_of(self, v: np.ndarray) -> np.ndarray:
        z = self.base + ((self.log[1][np.arange(self.n), v] - self.log[0][np.arange(self.n), v]) * self.weight).sum(axis=1)
        return 1 / (1 + np.exp(-z))

    def posterior(self, pattern: str) -> float:
        return float(self.posterior_of(np.array([["-0+".index(c) for c in pattern]]))[0])


def features(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, word beginnings, pairs) of the sentences in a row of ids, one of each a place; places of END have feature SIZE, as have pairs over one."""
    end = ids == END
    u = ids.astype(np.int64)
    one = (u * 2654435761 >> 9) & (WORDS - 1)
    start = WORDS + (u >> 16 & STARTS - 1)
    two = np.full(len(u), SIZE)
    pair = ((u[:-1] * 40503 ^ u[1:] * 2246822519) * 2654435761 >> 11) & (PAIRS - 1)
    two[1:] = np.where(end[:-1] | end[1:], SIZE, WORDS + STARTS + pair)
    return np.where(end, SIZE, one), np.where(end, SIZE, start), two


SIZE = WORDS + STARTS + PAIRS


def share(n_words: np.ndarray) -> np.ndarray:
    """The weight of a word of a sentence, so that a phrase said again and again does not add up."""
    return np.minimum(1.0, FULL_LENGTH / np.maximum(1, n_words))


class Sample:
    """Sentences of the sampled documents: their features, first places, documents, and soft labels."""

    def __init__(self, table: pa.Table, models: dict[str, LabelModel]) -> None:
        ids = table.column("ids").combine_chunks()
        lists = ids.offsets.to_numpy()
        flat = ids.values.to_numpy()[lists[0] : lists[-1]]
        self.end = np.flatnonzero(flat == END)
        self.start = np.r_[0, self.end[:-1] + 1] if len(self.end) else self.end
        self.doc = np.searchsorted(lists - lists[0], self.start, "right") - 1
        self.columns = features(flat)
        n = len(self.start)
        first = np.searchsorted(self.doc, np.arange(table.num_rows))
        self.judged = np.array([x is not None for x in table.column(f"said_{CATEGORIES[0]}").to_pylist()], bool)[self.doc] if n else np.zeros(0, bool)
        self.said = np.array([[x == "+" for x in table.column(f"said_{c}").to_pylist()] for c in CATEGORIES], bool).T
        self.y = np.zeros((n, len(CATEGORIES)))
        self.voted = np.zeros(n, bool)
        for i, vs in enumerate(table.column("votes").to_pylist()):
            for v in vs or ():
                k = first[i] + v["at"]
                self.voted[k] = True
                for j, c in enumerate(CATEGORIES):
                    voice = "0" if not self.judged[k] else "+" if self.said[i, j] else "-"
                    p = v[c] + voice
                    self.y[k, j] = models[c].posterior(p) if c in models and "+" in p[:-1] else 0.0
        self.weight = np.where(self.voted | self.judged, 1.0, LIGHT)
        self.posterior = self.y.copy()
        self.posterior = self.y.copy()
        self.size = np.maximum(1, self.end - self.start)
        self.fold = np.array([zlib.crc32(str(k).encode()) % 2 for k in table.column("doc_id").to_pylist()], int)[self.doc]

    def blame(self, p: np.ndarray | None) -> None:
        """New soft labels, from the probabilities of classifiers that did not see the sentence's document.

        In a document that annotators named a category for, each sentence without votes is to
        blame with its probability, given that at least one sentence of the document is or
        the annotators erred: what other documents bear out is blamed, the rest taken for an
        error. Where the label model is unsure of the votes on a sentence that nobody judged,
        its label moves half way to the classifier.
        """
        p = np.full(self.y.shape, START) if p is None else np.clip(p, 1e-6, 1 - 1e-6)
        free = ~self.voted
        for j in range(len(CATEGORIES)):
            y = self.posterior[:, j].copy()
            unsure = self.voted & ~self.judged & (y > 1 - ANNOTATOR) & (y < ANNOTATOR)
            y[unsure] = (y[unsure] + p[unsure, j]) / 2
            own = np.where(self.voted, y, p[:, j])
            named = self.said[self.doc, j]
            none = np.exp(np.bincount(self.doc, np.log1p(-np.minimum(own, 1 - 1e-6)), len(self.said)))[self.doc]  # that no sentence of the document is
            right = ANNOTATOR * (1 - none) / (ANNOTATOR * (1 - none) + (1 - ANNOTATOR) * none)
            y[free] = 0.0
            at = free & named
            y[at] = own[at] * right[at] / np.maximum(1 - none[at], 1e-6)
            self.y[:, j] = np.minimum(y, 1 - 1e-3)


class Classifier:
    """Logistic regression on the sample's features, by Adam; features of the sample only have weights."""

    def __init__(self, sample: Sample) -> None:
        self.s = sample
        self.known, back = np.unique(np.concatenate(sample.columns), return_inverse=True)
        self.cols = back.reshape(3, -1)
        self.free = self.known != SIZE
        k = len(CATEGORIES)
        self.w, self.bias = np.zeros((len(self.known), k), np.float32), np.full(k, -3.0, np.float32)
        self.m, self.v, self.t = np.zeros((len(self.known) + 1, k), np.float32), np.zeros((len(self.known) + 1, k), np.float32), 0

    def logits(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(values, features, sentence of each feature) of the sentences at."""
        n = self.s.size[at]
        place = np.repeat(self.s.start[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        row = np.tile(np.repeat(np.arange(len(at)), n), 3)
        col = self.cols[:, place].ravel()
        z = np.stack([np.bincount(row, self.w[col, k], len(at)) for k in range(self.w.shape[1])], axis=1)
        return z * share(n)[:, None] + self.bias, col, row

    def train(self, epochs: int, rows: np.ndarray | None = None, rate: float = 0.03, decay: float = 2e-5, batch: int = 4096) -> None:
        rng = np.random.default_rng(17 + self.t)
        rows = np.arange(len(self.s.start)) if rows is None else rows
        for _ in range(epochs):
            order = rng.permutation(rows)
            for lo in range(0, len(rows), batch):
                at = order[lo : lo + batch]
                z, col, row = self.logits(at)
                g = (1 / (1 + np.exp(-z)) - self.s.y[at]) * self.s.weight[at, None] * (1 + RARE * self.s.y[at]) / len(at)
                part = g * share(self.s.size[at])[:, None]
                grad = np.stack([np.bincount(col, part[row, k], len(self.known)) for k in range(g.shape[1])], axis=1)
                grad = np.vstack([grad + decay * self.w, g.sum(axis=0)]).astype(np.float32)
                grad[:-1][~self.free] = 0
                self.t += 1
                self.m = 0.9 * self.m + 0.1 * grad
                self.v = 0.999 * self.v + 0.001 * grad * grad
                step = rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)
                self.w -= step[:-1]
                self.bias -= step[-1]

    def probabilities(self) -> np.ndarray:
        out = [1 / (1 + np.exp(-self.logits(np.arange(lo, min(lo + 20_000, len(self.s.start))))[0])) for lo in range(0, len(self.s.start), 20_000)]
        return np.concatenate(out) if out else np.zeros((0, len(CATEGORIES)))

    def weights(self) -> np.ndarray:
        """SIZE + 2 rows: one a feature, that of no feature, the bias."""
        w = np.zeros((SIZE + 2, len(CATEGORIES)), np.float32)
        w[self.known] = self.w
        w[SIZE] = 0
        w[-1] = self.bias
        return w


def fit(table: DataFrame, labels: DataFrame | None) -> tuple[np.ndarray, dict[str, LabelModel]]:
    """(weights of the classifier, the label models), from the table of read()."""
    names = [f"said_{c}" for c in CATEGORIES]
    said = cut(judgements(labels)) if labels is not None else table.limit(0).select("doc_id", *(F.lit("-").alias(x) for x in names))
    voted = table.select("doc_id", F.explode("votes").alias("v")).join(said, "doc_id", "left").select("v", *(F.coalesce(x, F.lit("0")).alias(x) for x in names))
    kinds = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.concat(f"v.{c}", f"said_{c}").alias("p")) for c in CATEGORIES))).alias("x")
    seen = voted.select(F.col("v.h").alias("h"), kinds).where(F.col("x.p").rlike(r"^[-0+]*\+[-0+]*[-0+]$")).distinct().groupBy("x.c", "x.p").agg(F.count("*").alias("n")).orderBy("c", "p").collect()
    models = {c: LabelModel([r["p"] for r in rows], [r["n"] for r in rows]) for c in CATEGORIES if (rows := [r for r in seen if r["c"] == c])}
    if not models:
        w = np.zeros((SIZE + 2, len(CATEGORIES)), np.float32)
        w[-1] = -10  # nothing speaks for any category
        return w, models
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    few = lambda df, n, most: df.where(h < int(min(1.0, most / max(1, n)) * (1 << 30)))
    named = F.expr(" or ".join(f"{x} = '+'" for x in names))
    parts = [few(part, part.count(), JUDGED).limit(2 * JUDGED) for part in (said.where(named), said.where(~named))]
    keys = F.broadcast(parts[0].union(parts[1]))  # at most 4 x JUDGED rows
    judged = table.join(keys, "doc_id").select("doc_id", "ids", "votes", *names)
    others = few(table, table.count(), OTHERS).join(said.select("doc_id"), "doc_id", "left_anti").limit(2 * OTHERS)
    picked = judged.union(others.select("doc_id", "ids", "votes", *(F.lit(None).cast("string") for _ in names)))
    sample = Sample(picked.toArrow(), models)
    return train(sample), models


def train(sample: Sample) -> np.ndarray:
    """The weights of a sample: the mean of a classifier of all documents and of two of one half each.

    The sentences to blame are found with the two, each asked about the other half; the mean
    steadies what few documents teach.
    """
    sample.blame(None)
    halves = [Classifier(sample), Classifier(sample)]
    for i in range(ROUNDS + 1):
        for k, half in enumerate(halves):
            half.train(EPOCHS, np.flatnonzero(sample.fold != k))
        if i < ROUNDS:
            p = [half.probabilities() for half in halves]
            sample.blame(np.where(sample.fold[:, None] == 0, p[0], p[1]))
    whole = Classifier(sample)
    whole.train(3 * EPOCHS)
    return (whole.weights() + (halves[0].weights() + halves[1].weights()) / 2) / 2


def scores(documents: DataFrame, labels: DataFrame | None = None, text: str = "text") -> DataFrame:
    """(doc_id, abuse, hate, sexual): the highest probability of any sentence; 0 for a null, empty or wordless text.

    Null ids are dropped. A document sent twice is one row with the higher scores. Without
    any voted sentence in the corpus all scores are about 0.
    """
    table = cut(read(documents, text))
    weights, _ = fit(table, labels)
    sent = documents.sparkSession.sparkContext.broadcast(weights)
    key = dict(documents.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                lists = part.column(1)
                offsets = lists.offsets.to_numpy()
                ids = lists.values.to_numpy()[offsets[0] : offsets[-1]]
                out = np.zeros((part.num_rows, len(CATEGORIES)))
                if len(ids):
                    one, start, two = features(ids)
                    z = w[one] + w[start] + w[two]
                    end = np.flatnonzero(ids == END)
                    first = np.r_[0, end[:-1] + 1]
                    z = np.add.reduceat(z, first, axis=0) * share(end - first)[:, None] + w[-1]
                    np.maximum.at(out, np.searchsorted(offsets - offsets[0], first, "right") - 1, 1 / (1 + np.exp(-z.astype(np.float64))))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(out[:, k]) for k in range(len(CATEGORIES)))], names=["doc_id", *CATEGORIES])

    scored = table.select("doc_id", "ids").mapInArrow(run, f"doc_id {key}, " + ", ".join(f"{c} double" for c in CATEGORIES))
    wordless = documents.where(F.col("doc_id").isNotNull() & F.col(text).isNull()).select("doc_id", *(F.lit(0.0).alias(c) for c in CATEGORIES))
    return scored.union(wordless).groupBy("doc_id").agg(*(F.max(c).alias(c) for c in CATEGORIES))


def flagged(scored: DataFrame, bound: float = BOUND) -> DataFrame:
    """(doc_id, category): one row per category whose score reaches the bound."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("category"), F.col(c).alias("score")) for c in CATEGORIES))).alias("x")
    return scored.select("doc_id", pairs).where(F.col("x.score") >= bound).select("doc_id", "x.category")


def source_rates(documents: DataFrame, scored: DataFrame, bound: float = BOUND) -> DataFrame:
    """(source, category, n_docs, n_flagged, rate) per source, trimmed and in lower case; a missing source is null."""
    named = documents.where("doc_id is not null").select("doc_id", F.lower(F.trim("source")).alias("source")).groupBy("doc_id").agg(F.min("source").alias("source"))
    j = named.join(scored, "doc_id")
    sums = j.groupBy("source").agg(F.count("*").alias("n_docs"), *(F.sum((F.col(c) >= bound).cast("long")).alias(c) for c in CATEGORIES))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("category"), F.col(c).alias("n_flagged")) for c in CATEGORIES))).alias("x")
    return sums.select("source", "n_docs", pairs).select("source", "x.category", "n_docs", "x.n_flagged", (F.col("x.n_flagged") / F.col("n_docs")).alias("rate"))
