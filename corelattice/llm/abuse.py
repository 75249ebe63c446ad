"""Abusive, hateful or sexual content: multiple-instance learning on sentences.

Only whole documents are labelled.  A sentence's score is logistic in its words
and pairs of neighbouring words; a document's is the noisy-or of its sentences,
1 - prod(1 - p).  The weights are trained from the documents' labels through
that noisy-or, so that the sentences which explain the labels get the scores,
and these then say where the offending passage is.

Text as scanned: words broken at line ends are joined, letters spaced out are
closed up, and a word that is not known is read as the known word that differs
from it in one letter, or in letters hidden by marks, if there is one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corelattice.plans.lineage import written

LABELLED = 12_000  # labelled documents used for fitting, at most
TEXT = 64 << 20  # bytes of their texts, at most
ROUNDS = 60
DECAY = 1e-4
SLIP = 0.04  # share of labels of either kind that readers get wrong, as the likelihood allows for it
COSTLY = 3.0  # a document flagged wrongly weighs as much as so many missed: few of a table's documents are offending, more of the labelled ones
FOLDS = 4
FLAG = 0.5  # the threshold where labels are too few to choose one
ENOUGH = 20  # labelled offending documents for that, at least
HASHED = 64  # letters of a word that is looked up by its holes; longer ones are compared one by one
BATCH = 1 << 22  # letters read at a time
_BROKEN = re.compile(r"(?<=\w)[-=¬~] ?\n ?(?=\w)")
_SPACED = re.compile(r"(?<!\S)(?:\w ){2,}\w(?!\w)")
_ENDS = re.compile(r"[.;!?]+(?=\s|$)")
_STRIP = ".,;:!?\"'()[]«»„“”—_+"
# digits and marks that scans give for letters (fixed values)
_MISREAD = str.maketrans("0156!|9", "olsbllg")
_HIDDEN = re.compile(r"[*.\-#@]")


def sentences(text: str) -> list[list[str]]:
    """Sentences of a text as lists of raw lower-case words; empty ones left out."""
    t = _BROKEN.sub("", text.lower()).replace("\n", " ")
    t = _SPACED.sub(lambda m: m.group().replace(" ", ""), t)
    out = []
    for s in _ENDS.split(t):
        words = s.split()
        if words:
            out.append(words)
    return out


def _plain(word: str) -> str:
    w = word.strip(_STRIP)
    if w.isdigit() or (w[:1].isdigit() and not any(c.isalpha() for c in w)):
        return "#"
    return w.translate(_MISREAD) if any(c in "0156!|9" for c in w) else w


def _holes(w: str) -> Iterable[str]:
    return (w[:i] + "?" + w[i + 1 :] for i in range(len(w)))


class Words:
    """The known words and the reading of unknown ones."""

    def __init__(self, counts: Counter, least: int = 2) -> None:
        self.number: dict[str, int] = {}
        self.pattern: dict[str, int] = {}
        self.by_length: dict[int, list[str]] = {}
        self._memo: dict[str, int] = {}
        for w, n in sorted(counts.items(), key=lambda p: (-p[1], p[0])):
            if n < least:
                break
            if not w:
                continue
            self.number[w] = len(self.number)
            if len(w) >= 4:
                if len(w) <= HASHED:
                    for h in _holes(w):
                        self.pattern.setdefault(h, self.number[w])
                self.by_length.setdefault(len(w), []).append(w)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_memo": {}}

    def read(self, raw: str) -> int:
        """The number of the word, or -1."""
        got = self._memo.get(raw)
        if got is None:
            if len(self._memo) > 500_000:
                self._memo.clear()
            got = self._memo[raw] = self._read(_plain(raw))
        return got

    def _read(self, w: str) -> int:
        if w in self.number:
            return self.number[w]
        same = self.by_length.get(len(w))
        if same is None:  # no known word has as many letters
            return -1
        if len(w) <= HASHED:
            for h in _holes(w):
                if h in self.pattern:
                    return self.pattern[h]
        else:
            for known in same:
                if sum(a != b for a, b in zip(w, known)) == 1:
                    return self.number[known]
        marks = _HIDDEN.findall(w)
        if 2 <= len(marks) < len(w) - 1:  # several letters hidden, each by a mark
            like = re.compile("".join("." if _HIDDEN.match(c) else re.escape(c) for c in w))
            for known in same:
                if like.fullmatch(known):
                    return self.number[known]
        return -1


class _Texts:
    """The words of several texts as numbers: ``code`` of each word, its sentence ``at``, and each sentence's text ``owner``."""

    def __init__(self, texts: Iterable[str]) -> None:
        flat, lengths, owner = [], [], []
        for d, t in enumerate(texts):
            for s in sentences(t):
                flat.extend(s)
                lengths.append(len(s))
                owner.append(d)
        coded = pa.array(flat, pa.string()).dictionary_encode()
        self.code, self.raw = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        self.owner = np.array(owner, np.int64)
        self.at = np.repeat(np.arange(len(lengths)), np.array(lengths, np.int64))

    def read(self, words: Words) -> np.ndarray:
        """The known word of each word, -1 where there is none."""
        return np.array([words.read(w) for w in self.raw], np.int64)[self.code]

    def pairs(self, word: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of neighbouring known words of a sentence, and the sentences."""
        a, b = word[:-1], word[1:]
        both = (a >= 0) & (b >= 0) & (self.at[:-1] == self.at[1:])
        return a[both] * m + b[both], self.at[:-1][both]


def _place(known: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``codes`` are in the sorted ``known``, and which of them are there."""
    if not len(known):
        return np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
    place = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    return place, known[place] == codes


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Model:
    """Known words, weights of words and of pairs of words, the bias, and the threshold of a sentence's probability."""

    def __init__(self, words: Words, word_weight: np.ndarray, pairs: np.ndarray, pair_weight: np.ndarray, bias: float, flag: float = FLAG) -> None:
        self.words, self.weight, self.pairs, self.pair_weight, self.bias, self.flag = words, word_weight, pairs, pair_weight, bias, flag

    def odds(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of each sentence of the texts, and whose it is."""
        t = _Texts(texts)
        n, m = len(t.owner), len(self.weight)
        word = t.read(self.words)
        known = word >= 0
        z = self.bias + np.bincount(t.at[known], self.weight[word[known]], n)
        code, at = t.pairs(word, m)
        place, there = _place(self.pairs, code)
        return z + np.bincount(at[there], self.pair_weight[place[there]], n), t.owner

    def sentence_scores(self, text: str) -> list[float]:
        """Log odds of each sentence."""
        return self.odds([text])[0].tolist()

    def documents(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the noisy-or of its sentences, the number of the worst one from 1 (0: none), and its probability."""
        z, owner = self.odds(texts)
        p = _sigmoid(z)
        score = 1 - np.exp(np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), len(texts)))
        worst, top = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        if len(z):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(z)]))
            best = np.flatnonzero(z == np.maximum.reduceat(z, first)[of])[::-1]
            worst[owner[best]] = best - first[of[best]] + 1  # of equal ones the first
            top[owner[best]] = p[best]
        return score, worst, top


def fit(docs: list[tuple[str, float]], rounds: int = ROUNDS, decay: float = DECAY) -> Model:
    """The model trained on texts and labels in [0, 1]; without positive labels it scores all low.

    The threshold is chosen on held-out documents: ``FOLDS`` models score the
    documents that they were not trained on.
    """
    t = _Texts(d for d, _ in docs)
    counts: Counter = Counter()
    for w, n in zip(t.raw, np.bincount(t.code, minlength=len(t.raw)).tolist()):
        counts[_plain(w)] += n
    words = Words(counts)
    m = max(1, len(words.number))
    word = t.read(words)
    code, pair_at = t.pairs(word, m)
    pairs, seen = np.unique(code, return_counts=True)
    pairs = pairs[seen >= 3]
    place, there = _place(pairs, code)
    feature, at = np.r_[word[word >= 0], m + place[there]], np.r_[t.at[word >= 0], pair_at[there]]
    size = m + len(pairs)
    # rare words and pairs count for more than the words of every page
    docs_with = np.bincount(np.unique(t.owner[at] * size + feature) % size, minlength=size)
    rare = np.log(1 + len(docs) / np.maximum(docs_with, 1)) / np.log(1 + max(len(docs), 1))
    y = np.array([v for _, v in docs], dtype=float)

    def trained(some: np.ndarray | None) -> tuple[np.ndarray, float]:
        if some is None:
            return _trained(feature, at, t.owner, y, rare, rounds, decay)
        own = np.cumsum(some) - 1
        mine = some[t.owner]
        line = np.cumsum(mine) - 1
        kept = mine[at]
        return _trained(feature[kept], line[at[kept]], own[t.owner[mine]], y[some], rare, rounds, decay)

    flag = FLAG
    if y.sum() >= ENOUGH:
        top = np.zeros(len(y))
        for fold in range(FOLDS):
            some = np.arange(len(y)) % FOLDS != fold  # the documents come in the order of a hash
            w, bias = trained(some)
            held = ~some[t.owner]
            p = _sigmoid(bias + np.bincount(at, w[feature], len(t.owner)))
            np.maximum.at(top, t.owner[held], p[held])
        flag = _threshold(top, y)
    w, bias = trained(None)
    return Model(words, w[:m], pairs, w[m:], bias, flag)


def _trained(feature: np.ndarray, at: np.ndarray, owner: np.ndarray, y: np.ndarray, rare: np.ndarray, rounds: int, decay: float) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient steps on the likelihood of the labels through the noisy-or."""
    n = len(owner)
    w, first, second = (np.zeros(len(rare)) for _ in range(3))
    bias, b1, b2 = -5.0, 0.0, 0.0
    for step in range(1, rounds + 1):
        p = _sigmoid(bias + np.bincount(at, (w * rare)[feature], n))
        none = np.exp(np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y)))  # prod(1 - p)
        said = SLIP + (1 - 2 * SLIP) * (1 - none)  # chance that a reader says so
        # d log-likelihood / d z of a sentence
        g = p * ((1 - 2 * SLIP) * none * (y / said - (1 - y) / (1 - said)))[owner]
        gw = np.bincount(feature, g[at], len(w)) * rare - decay * len(y) * w
        gb = g.sum()
        first = 0.9 * first + 0.1 * gw
        second = 0.99 * second + 0.01 * gw * gw
        b1, b2 = 0.9 * b1 + 0.1 * gb, 0.99 * b2 + 0.01 * gb * gb
        rate = 0.1 / np.sqrt(1 + step / 30)
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        w += rate * (first / c1) / (np.sqrt(second / c2) + 1e-8) * (second > 0)
        bias = min(bias + rate * (b1 / c1) / (np.sqrt(b2 / c2) + 1e-8), -2.0)
    return w * rare, float(bias)


def _threshold(top: np.ndarray, y: np.ndarray) -> float:
    """The threshold of the best balance of found and wrongly flagged documents, allowing for readers' slips."""

    def offending(some: np.ndarray) -> float:
        return (y[some].sum() - SLIP * some.sum()) / (1 - 2 * SLIP)

    all_ = offending(np.ones(len(y), bool))
    best, flag = -1.0, FLAG
    for t in np.round(np.arange(0.04, 0.61, 0.02), 2):
        found = min(max(offending(top >= t), 0.0), all_)
        wrong = max((top >= t).sum() - found, 0.0)
        balance = 2 * found / max(found + COSTLY * wrong + all_, 1e-9)
        if balance > best:
            best, flag = balance, float(t)
    return flag


def document_score(z: Iterable[float]) -> float:
    """Noisy-or of sentences' log odds; 0 for a text without sentences."""
    return float(1 - np.exp(np.log1p(-np.minimum(_sigmoid(np.array(list(z), dtype=float)), 1 - 1e-12)).sum()))


def labels(rows: DataFrame, key: str, label: str) -> DataFrame:
    """``key`` and the mean label of each labelled document; NULL labels left out, repeated rows one."""
    clean = rows.where(F.col(label).isNotNull() & F.col(key).isNotNull()).distinct()
    return clean.groupBy(key).agg(F.avg(F.col(label).cast("double")).alias("label"))


def fitted(docs: DataFrame, rows: DataFrame, key: str, text: str, label: str, most: int = LABELLED, text_bytes: int = TEXT) -> Model:
    """The model fitted on at most ``most`` labelled documents, and ``text_bytes`` of text, chosen by a hash of the key.

    A document that goes beyond the bytes is left out as a whole.
    """
    few = labels(rows, key, label).withColumn("__h", F.xxhash64(key)).orderBy("__h", key).limit(most)  # the sample's bound
    got = docs.select(key, text).where(F.col(text).isNotNull()).join(F.broadcast(few), key)
    got = written(got.withColumn("__size", F.octet_length(text)), "labelled")
    upto = F.sum("__size").over(Window.orderBy("__h", key).rowsBetween(Window.unboundedPreceding, 0))  # over the sample's keys
    kept = got.select(key, "__h", "__size").select(key, upto.alias("__upto")).where(F.col("__upto") <= text_bytes).select(key)
    got = got.join(F.broadcast(kept), key).orderBy("__h", key).select(text, "label").toPandas()
    return fit(list(zip(got[text], got["label"])))


def scored(docs: DataFrame, model: Model, key: str, text: str, also: list[str] | None = None) -> DataFrame:
    """``key``, ``also``, ``score`` (noisy-or), ``sentence`` (number of the worst one from 1, 0 if none), ``sentence_score``, ``flagged``.

    ``flagged``: the worst sentence's probability reaches the model's threshold.
    A NULL or empty text has score 0.
    """
    also = also or []
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            texts = t[text]
            length = np.cumsum(np.nan_to_num(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(float)))
            a = 0
            while a < t.num_rows:  # a bounded number of letters, one text at least
                b = max(a + 1, int(np.searchsorted(length, (length[a - 1] if a else 0) + BATCH, "right")))
                part = t.slice(a, b - a)
                score, worst, top = model.documents([s or "" for s in part[text].to_pylist()])
                yield pa.RecordBatch.from_arrays([part[key], *(part[c] for c in also), pa.array(score), pa.array(worst.astype(np.int32)), pa.array(top), pa.array(top >= model.flag)], [key, *also, "score", "sentence", "sentence_score", "flagged"])
                a = b

    fields = ", ".join([f"{key} {kinds[key]}", *(f"{c} {kinds[c]}" for c in also), "score double", "sentence int", "sentence_score double", "flagged boolean"])
    return docs.select(key, text, *also).mapInArrow(run, fields)
