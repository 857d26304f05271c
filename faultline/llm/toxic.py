"""Abusive, hateful or sexual passages, by a classifier chain over sentences.

Sentences are undisguised (look-alike letters, digits for letters, spaced, dotted, stretched and
masked words) with the vocabulary of the reviewed documents and turned into hashed word features.
Nothing but the reviewers' verdicts says what is abusive: there is no word list and no sample sentence.
Verdicts are on whole documents, so the sentences that carry them are found by expectation
maximisation: a document is abusive if any of its sentences is, and reviewers err. The sentences found
are divided into categories by their words; one linear model after the other predicts these, and at
last abuse as a whole, and each gets the probabilities of those before it, taken out of fold in
training. The labels name no categories, so they are numbered; ``Chain.words`` tells what each is about.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.session import spread

#: Labelled documents used for fitting at most; beyond, those with the least hash of their id.
MAX_TRAIN_DOCS = 20_000
DIM = 1 << 17
FOLDS = 3
#: Categories the abusive sentences are divided into.
CATEGORIES = ["category_1", "category_2", "category_3", "category_4"]
#: How often a reviewer passes an abusive document, and calls an innocent one abusive.
MISSED, FALSE_ALARM = 0.1, 0.05
ROUNDS = 8

# Cyrillic and Greek letters that look Latin, and signs that stand for letters.
_LOOKS = str.maketrans("аеорсухіјѕԁһкмтвнпгΑΒΕΖΗΙΚΜΝΟΡΤΥΧαορνικτυ", "aeopcyxijsdhkmtbhnrABEZHIKMNOPTYXaopviktu")
_LEET = str.maketrans("013457@$!", "oleastasi")
_LEET_I = str.maketrans("013457@$!9", "oieastasig")
_SPACED = re.compile(r"(?<![^\W_])[^\W\d_]([ .*_-]{1,2})[^\W\d_](?:\1[^\W\d_])+(?![^\W_])")
_SINGLES = re.compile(r"(?<![^\W_])[^\W\d_][ .*_-]{1,2}[^\W\d_][ .*_-]")
_DOTTED = re.compile(r"(?<![^\W_])[^\W\d_]{1,3}(?:[.*_-][^\W\d_]{1,3}){2,}(?![^\W_])")
_IDENT = re.compile(r"\S*?(?:::|[/\\]|\w_\w|\w\.\w{1,4}\b)\S*")
_TOKEN = re.compile(r"[^\W_](?:[^\W_]|[*@$!#](?=[^\W_*@$!#])|[*#]+(?=[^\W_]))*|[\"\u201c\u201d\u201e]")
_SPLIT = re.compile(r"(?<=[.!?\u2026])\s+|[\r\n]+")
_STRETCH = re.compile(r"(.)\1{2,}")


def plain(sentence: str) -> str:
    """Lower case without marks, invisible characters and look-alike letters."""
    s = sentence
    if not s.isascii():
        s = unicodedata.normalize("NFKD", s.translate(_LOOKS))
        s = "".join(c for c in s if not unicodedata.combining(c) and c not in "\u200b\u200c\u200d\u00ad")
    return s.lower()


class Reader:
    """Cuts sentences into words and undoes disguises as far as they give a word of ``vocabulary`` (word -> weight).

    Of several words a masked one can be, the heaviest is taken; one that fits none becomes the token ``masked``.
    """

    def __init__(self, vocabulary: dict[str, float]):
        self.vocabulary = vocabulary
        self.longest = max(map(len, vocabulary), default=1)
        self.by_length: dict[int, list[str]] = defaultdict(list)
        for w in sorted(vocabulary, key=lambda w: (-vocabulary[w], w)):
            self.by_length[len(w)].append(w)
        self._ready()

    def _ready(self) -> None:
        self.chunk = functools.lru_cache(1 << 17)(self._chunk)
        self.word = functools.lru_cache(1 << 17)(self._word)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("chunk", "word")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._ready()

    def _word(self, w: str) -> str:
        if w in self.vocabulary or (w.isalpha() and not _STRETCH.search(w)):
            return w
        if w.isdigit():
            return "0"
        if "*" in w or "#" in w:
            for k in self.by_length[len(w)]:
                if all(a == b or a in "*#" for a, b in zip(w, k)):
                    return k
            return "masked"
        for x in (w, w.translate(_LEET_I), w.translate(_LEET)):
            for y in (x, _STRETCH.sub(r"\1", x), _STRETCH.sub(r"\1\1", x)):
                if y in self.vocabulary:
                    return y
        return _STRETCH.sub(r"\1", w) if w.isalpha() else "ident"

    def segment(self, s: str) -> list[str]:
        """``s`` cut into words of the vocabulary, the fewest pieces; whole if that can't be done."""
        best: list[tuple[int, int] | None] = [(0, 0)] + [None] * len(s)
        for e in range(1, len(s) + 1):
            for k in range(max(0, e - self.longest), e):
                w = s[k:e]
                if best[k] is not None and (len(w) > 2 or w in ("a", "i")) and w in self.vocabulary and (best[e] is None or best[k][0] + 1 < best[e][0]):
                    best[e] = (best[k][0] + 1, k)
        if best[-1] is None:
            return [s]
        out, e = [], len(s)
        while e:
            out.append(s[best[e][1] : e])
            e = best[e][1]
        return out[::-1]

    def _join(self, m: re.Match) -> str:
        s = re.sub(r"[^\w]|_", "", m[0])
        return s if s in self.vocabulary else " ".join(self.segment(s))

    def _chunk(self, c: str) -> tuple[str, ...]:
        """The tokens of a piece of plain text without white space."""
        if _DOTTED.search(c):
            c = _DOTTED.sub(lambda m: j if set((j := self._join(m)).split()) <= self.vocabulary.keys() else m[0], c)
        if _IDENT.fullmatch(c):
            return ("ident",)
        return tuple(self.word(t) for c in c.split() for t in _TOKEN.findall(c))

    def tokens(self, sentence: str) -> list[str]:
        s = plain(sentence)
        if _SINGLES.search(s):
            s = _SPACED.sub(self._join, s)
        return [t for c in s.split() for t in self.chunk(c)]

    @classmethod
    def of(cls, texts: list[str]) -> Reader:
        """With the undisguised words of ``texts``, all of the same weight."""
        return cls({w: 0.0 for t in texts for s in sentences(t) for c in plain(s).split() if not _IDENT.fullmatch(c) for w in _TOKEN.findall(c) if w.isalpha() and w.isascii() and not _STRETCH.search(w) and (len(w) > 1 or w in "ai")})


def sentences(text: str | None) -> list[str]:
    return [s for s in _SPLIT.split(text) if s.strip()] if text else []


def features(toks: list[str]) -> list[int]:
    """Hashed words, pairs and pairs one apart."""
    f = ["^", *toks, "$"]
    grams = toks + [a + " " + b for a, b in zip(f, f[1:])] + [a + "_" + b for a, b in zip(f, f[2:])]
    return sorted({zlib.crc32(g.encode()) % DIM for g in grams}) or [0]


class Csr:
    """Rows of feature numbers."""

    def __init__(self, rows: list[list[int]]):
        self.n = len(rows)
        self.idx = np.fromiter((i for r in rows for i in r), np.int64, sum(map(len, rows)))
        self.ptr = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        self.row = np.repeat(np.arange(self.n), np.diff(self.ptr))
        self.scale = 1 / np.sqrt(np.maximum(np.diff(self.ptr), 1))

    @functools.cached_property
    def used(self) -> tuple[np.ndarray, np.ndarray]:
        """The feature numbers that occur, and of each entry the place of its number among them."""
        return np.unique(self.idx, return_inverse=True)

    def dot(self, w: np.ndarray) -> np.ndarray:
        """Rows times weights of all features."""
        return np.bincount(self.row, w[self.idx], self.n) * self.scale


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


BIAS = -3.5  # log odds of a sentence that shows nothing known


def fit(x: Csr, extra: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 0.2, steps: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Weighted ridge logistic regression with soft labels and a fixed intercept: weights of hashed and of dense features.

    The loss is a sum, so what one mislabelled document alone shows can't outweigh the ridge.
    """
    cols, place = x.used  # what no row has keeps weight 0
    w, v = np.zeros(len(cols)), np.zeros(extra.shape[1])
    m1, m2, a1, a2 = np.zeros(len(w)), np.zeros(len(w)), np.zeros(len(v)), np.zeros(len(v))
    for k in range(1, steps + 1):
        z = np.bincount(x.row, w[place], x.n) * x.scale
        g = (_sigmoid(z + extra @ v + BIAS) - y) * weight
        gw, gv = np.bincount(place, (g * x.scale)[x.row], len(w)) + l2 * w, extra.T @ g + l2 * v
        m1, m2, a1, a2 = 0.9 * m1 + 0.1 * gw, 0.99 * m2 + 0.01 * gw * gw, 0.9 * a1 + 0.1 * gv, 0.99 * a2 + 0.01 * gv * gv
        rate = 0.3 * (1 - k / (steps + 1))
        w -= rate * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-7)
        v -= rate * (a1 / (1 - 0.9**k)) / (np.sqrt(a2 / (1 - 0.99**k)) + 1e-7)
    full = np.zeros(DIM)
    full[cols] = w
    return full, v


def predict(model: tuple[np.ndarray, np.ndarray], x: Csr, extra: np.ndarray) -> np.ndarray:
    return _sigmoid(x.dot(model[0]) + extra @ model[1] + BIAS)


def _likelihood(n_abusive: np.ndarray, n_ok: np.ndarray) -> np.ndarray:
    """How much likelier the verdicts on a document are if it is abusive than if it isn't."""
    return ((1 - MISSED) / FALSE_ALARM) ** n_abusive * (MISSED / (1 - FALSE_ALARM)) ** n_ok


def _blame(p: np.ndarray, doc: np.ndarray, row: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The expected share of its documents in which a sentence is abusive, and the probability of each document to be abusive.

    ``doc`` and ``row`` say which document holds which sentence, ``ratio`` what the verdicts on the documents say.
    """
    any_ = 1 - np.exp(np.bincount(doc, np.log1p(-np.minimum(p[row], 1 - 1e-9)), len(ratio)))
    after = ratio * any_ / np.maximum(ratio * any_ + 1 - any_, 1e-300)
    share = (after / np.maximum(any_, 1e-12))[doc] * p[row]
    return np.bincount(row, share, len(p)) / np.maximum(np.bincount(row, minlength=len(p)), 1), after


def _settle(x: Csr, doc: np.ndarray, row: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Soft labels of the sentences (0 to 1) and how often each stands, by expectation maximisation.

    At first every sentence of a document bears blame by how seldom it stands in documents found harmless.
    """
    held = np.bincount(row, minlength=x.n).astype(float)
    odds = (np.bincount(row, (ratio > 1)[doc], x.n) + 0.1) / (np.bincount(row, (ratio <= 1)[doc], x.n) + 0.1)
    share = odds[row] / np.bincount(doc, odds[row], len(ratio))[doc]
    y = np.bincount(row, np.where((ratio > 1)[doc], share, 0.0), x.n) / np.maximum(held, 1)
    none = np.zeros((x.n, 0))
    for _ in range(ROUNDS):
        p = predict(fit(x, none, y, held), x, none)
        y, _ = _blame(p, doc, row, ratio)
    return y, held


def _divide(rows: list[tuple], found: np.ndarray, weight: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """A category (0 to k - 1) per row of ``found``: spherical k-means over their words, from rows far from each other."""
    df = Counter(w for r in found for w in set(rows[r]))
    vocab = {w: j for j, w in enumerate(sorted(df))}
    m = np.zeros((len(found), len(vocab)))
    for i, r in enumerate(found):
        for w in set(rows[r]):
            m[i, vocab[w]] = np.log1p(len(found) / df[w])
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    centres = m[[int(np.argmax(weight))]]
    while len(centres) < min(k, len(found)):
        centres = np.vstack([centres, m[int(np.argmin((m @ centres.T).max(1) - 1e-9 * weight))]])
    of = np.zeros(len(found), int)
    for _ in range(rounds):
        of = (m @ centres.T).argmax(1)
        sums = np.vstack([weight[of == c] @ m[of == c] if (of == c).any() else centres[c] for c in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return of


class Chain:
    """One category after the other, then abuse; each model sees the probabilities of those before."""

    def __init__(self, reader: Reader, models: list, threshold: float, words: dict[str, list[str]]):
        self.reader, self.models, self.threshold, self.words = reader, models, threshold, words

    @classmethod
    def train(cls, docs: list[tuple[str, int, int]]) -> Chain:
        """``docs``: text, the number of reviewers who called it abusive, and of those who called it ok.

        The threshold is the one with the best expected F0.5 over out-of-fold scores of the documents.
        """
        docs = [d for d in docs if d[1] + d[2]]
        texts = [sentences(t) for t, _, _ in docs]
        ratio = _likelihood(np.array([a for _, a, _ in docs], float), np.array([o for _, _, o in docs], float))
        reader = Reader.of([t for t, _, _ in docs])
        # masked words are read with the weights learned from the others
        rows, doc, row = _index(reader, texts)
        if not rows:
            return cls(reader, [(np.zeros(DIM), np.zeros(k)) for k in range(len(CATEGORIES) + 1)], 0.5, {})
        x = Csr([features(list(t)) for t in rows])
        y, held = _settle(x, doc, row, ratio)
        w, _ = fit(x, np.zeros((x.n, 0)), y, held)
        reader = Reader({t: float(w[zlib.crc32(t.encode()) % DIM]) for t in reader.vocabulary})
        rows, doc, row = _index(reader, texts)
        x = Csr([features(list(t)) for t in rows])
        y, held = _settle(x, doc, row, ratio)

        found = np.flatnonzero(y > 0.5)
        of = _divide(rows, found, y[found] * held[found], len(CATEGORIES)) if len(found) else found
        targets = []
        for c in range(len(CATEGORIES)):
            t = np.zeros(x.n)
            t[found[of == c]] = y[found[of == c]]
            targets.append(t)
        targets.append(y)
        fold = np.array([zlib.crc32(" ".join(t[:4]).encode()) % FOLDS for t in rows])
        models, probs = [], np.zeros((x.n, 0))
        for t in targets:
            out = np.zeros(x.n)
            for f in range(FOLDS):  # later links must not see probabilities fitted to their own rows
                inside = fold != f
                model = fit(x, probs, t, held * inside, steps=60)
                out = np.where(inside, out, predict(model, x, probs))
            models.append(fit(x, probs, t, held))
            probs = np.hstack([probs, out[:, None]])
        usual = Counter(w for r in rows for w in set(r))
        words = {}
        for c, name in enumerate(CATEGORIES):
            n = Counter(w for r in found[of == c] for w in set(rows[r]))
            words[name] = sorted(n, key=lambda w: (-n[w] * n[w] / usual[w], w))[:12]
        return cls(reader, models, cls._threshold(x, doc, row, ratio), words)

    @staticmethod
    def _threshold(x: Csr, doc: np.ndarray, row: np.ndarray, ratio: np.ndarray) -> float:
        """From document scores by models that saw neither the document nor its verdicts."""
        fold = np.arange(len(ratio)) % FOLDS
        none, score = np.zeros((x.n, 0)), np.zeros(len(ratio))
        for f in range(FOLDS):
            inside = (fold != f)[doc]
            y, held = _settle(x, doc[inside], row[inside], np.where(fold != f, ratio, 1.0))
            p = predict(fit(x, none, y, held), x, none)
            np.maximum.at(score, doc[~inside], p[row[~inside]])
        prior = ratio / (ratio + np.mean(ratio <= 1) / max(np.mean(ratio > 1), 1e-9))
        order = np.argsort(-score, kind="stable")
        hit, got = np.cumsum(prior[order]), np.arange(1, len(order) + 1)
        best = int(np.argmax(1.25 * hit / (got + 0.25 * prior.sum())))  # F0.5

        after = score[order[best + 1]] if best + 1 < len(order) else 0.0
        return float(np.clip((score[order[best]] + after) / 2, 0.05, 0.95))

    def _score(self, x: Csr) -> np.ndarray:
        probs = np.zeros((x.n, 0))
        for m in self.models:
            probs = np.hstack([probs, predict(m, x, probs)[:, None]])
        return probs

    def score(self, texts: list[str | None]) -> np.ndarray:
        """One row a text: the highest probability of each category and of abuse over its sentences (0 for an empty text)."""
        out = np.zeros((len(texts), len(self.models)))
        rows, of, which = _index(self.reader, [sentences(t) for t in texts])  # sentences that differ in numbers and names only are scored once
        if rows:
            np.maximum.at(out, of, self._score(Csr([features(list(t)) for t in rows]))[which])
        return out


def _index(reader: Reader, texts: list[list[str]]) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """Distinct token lists, and for each text (second) the lists it holds (third), each once."""
    index: dict[tuple, int] = {}
    doc, row = [], []
    for k, ss in enumerate(texts):
        own = {index.setdefault(tuple(t), len(index)) for s in ss if (t := reader.tokens(s))}
        doc.extend([k] * len(own))
        row.extend(sorted(own))
    return list(index), np.array(doc, np.int64), np.array(row, np.int64)


def train(docs: DataFrame, labels: DataFrame) -> Chain:
    """A chain fitted to at most MAX_TRAIN_DOCS reviewed documents; verdicts other than abusive and ok don't count."""
    votes = labels.groupBy("doc_id").agg(F.count_if(F.col("verdict") == "abusive").alias("bad"), F.count_if(F.col("verdict") == "ok").alias("ok")).where("bad + ok > 0")
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(votes, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(MAX_TRAIN_DOCS).select("text", "bad", "ok").collect()
    return Chain.train([(r["text"], r["bad"], r["ok"]) for r in rows])


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, source, insult, threat, hate, sexual, abuse, abusive), one row per row of ``docs``.

    Null and empty texts score 0. Other columns are left out.
    """
    held = docs.sparkSession.sparkContext.broadcast(chain)  # fixed size: DIM weights a model

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = held.value.score(list(b["text"]))
            out = pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"]})
            for k, c in enumerate([*CATEGORIES, "abuse"]):
                out[c] = s[:, k]
            out["abusive"] = out["abuse"] >= held.value.threshold
            yield out

    schema = "doc_id long, source string, " + ", ".join(f"{c} double" for c in CATEGORIES) + ", abuse double, abusive boolean"
    return spread(docs.select("doc_id", "source", "text")).mapInPandas(run, schema)


def rates(scored: DataFrame) -> DataFrame:
    """(source, n_docs, n_abusive, rate, mean_score) per source; null sources form a group."""
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("abusive").alias("n_abusive"), F.avg(F.col("abusive").cast("double")).alias("rate"), F.avg("abuse").alias("mean_score"))
