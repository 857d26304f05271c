"""Passages of evaluation items inside corpus documents.

Both sides are canonicalised to templates: numbers, hashes, quantities with units and names become
typed placeholders, words that many items share stay. Five-word template windows are hash-joined, on the
template alone; then the values behind the placeholders are compared. Pairs of document and item that
agree in some window's values are verified word by word. Pairs whose windows fit with other values are
checked for consistent replacement and tell re-parameterised questions.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.session import cut, spread

WINDOW = 5
MIN_RUN = 15
MIN_SHARE = (5, 6)
#: Index windows that may travel to every executor (16 bytes each); a larger index is joined by shuffle.
BROADCAST_WINDOWS = 2_000_000
_MARKUP = re.compile(r"</?[A-Za-z!][^<>]*>|&(?:[A-Za-z]+|#\d+);|[­​-‍﻿]")
_WORD = re.compile(r"[^\W_]+")
_HEX = re.compile(r"(?=[a-f]*\d)(?=\d*[a-f])[0-9a-f]{6,40}")
_UNIT = re.compile(r"\d+(?:[a-z]{1,3})")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case; tags, entities and invisible characters are left out."""
    if not text:
        return []
    if "<" in text or "&" in text or not text.isascii():
        text = _MARKUP.sub(lambda m: "" if m[0][0] not in "<&" else " ", unicodedata.normalize("NFKC", text))
    return _WORD.findall(text.lower())


def slot(word: str, literals: set[str]) -> str:
    """The placeholder of a word, or the word itself if it is a template's own."""
    if word.isdigit():
        return "\x01number"
    if word in literals:
        return word
    if _HEX.fullmatch(word):
        return "\x01hash"
    return "\x01unit" if _UNIT.fullmatch(word) else "\x01name"


def windows(texts: list[list[str]], literals: set[str], width: int = WINDOW) -> pd.DataFrame:
    """All windows of tokenised texts: row, pos, template (hash), slots (hash of the values behind the placeholders; 0 if none)."""
    lens = np.array([len(t) for t in texts], np.int64)
    flat = [w for t in texts for w in t]
    n = len(flat) - width + 1
    empty = pd.DataFrame({"row": np.zeros(0, np.int64), "pos": np.zeros(0, np.int64), "template": np.zeros(0, np.int64), "slots": np.zeros(0, np.int64)})
    if n <= 0:
        return empty
    codes, uniq = pd.factorize(np.array(flat, dtype=object))
    kinds = np.array([slot(w, literals) for w in uniq], dtype=object)
    is_slot = np.array([k[0] == "\x01" for k in kinds])
    word_hash = pd.util.hash_array(np.asarray(uniq, dtype=object), categorize=False)
    kind_hash = pd.util.hash_array(kinds, categorize=False)
    value_hash = np.where(is_slot, word_hash, np.uint64(0))
    k, v, s = kind_hash[codes], value_hash[codes], is_slot[codes]
    mix = np.uint64(0x9E3779B97F4A7C15)
    template, slots, some = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, bool)
    with np.errstate(over="ignore"):
        for j in range(width):
            template = (template ^ (template >> np.uint64(29))) * mix + k[j : j + n]
            slots = (slots ^ (slots >> np.uint64(29))) * mix + v[j : j + n]
            some |= s[j : j + n]
    row = np.repeat(np.arange(len(texts)), lens)
    start = np.cumsum(lens) - lens
    inside = row[:n] == row[width - 1 :]
    row, pos = row[:n][inside], (np.arange(n) - start[row[:n]])[inside]
    return pd.DataFrame({"row": row, "pos": pos, "template": template[inside].view(np.int64), "slots": np.where(some[inside], slots[inside].view(np.int64) | 1, 0)})


def _window_rows(id_col: str, literals: set[str], known: np.ndarray | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            w = windows([words(t) for t in b["text"]], literals)
            if known is not None and len(known):
                at = np.minimum(np.searchsorted(known, w["template"].to_numpy()), len(known) - 1)
                w = w[known[at] == w["template"].to_numpy()]
            w[id_col] = b[id_col].to_numpy()[w["row"].to_numpy()]
            yield w[[id_col, "pos", "template", "slots"]]

    return run


def literals_of(items: DataFrame, text: str, share: float = 0.01) -> set[str]:
    """Words in at least ``share`` of the items (and three): the templates' own. Fewer than words-per-item / share words."""
    n = items.count()

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"word": [w for t in b["text"] for w in set(words(t))]}, dtype=object)

    counts = items.select(F.col(text).alias("text")).mapInPandas(each, "word string").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return {r["word"] for r in counts.where(F.col("n") >= max(3, share * n)).collect()}


def lcs(masks: dict[str, int], n: int, doc: list[str]) -> int:
    """Length of the longest common subsequence of a passage (bit mask per word, n words) and ``doc``."""
    full = (1 << n) - 1
    v = full
    for w in doc:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def contains(doc: list[str], passage: list[str]) -> bool:
    """A run of MIN_RUN words of the passage, or five sixths of its words in order within twice its length."""
    n = len(passage)
    if not n or not doc:
        return False
    need, have = -(-n * MIN_SHARE[0] // MIN_SHARE[1]), set(doc)
    held = [w in have for w in passage]
    run, longest = 0, 0
    for h in held:
        run = run + 1 if h else 0
        longest = max(longest, run)
    if sum(held) < need and longest < MIN_RUN:
        return False  # too few of the words are there, in whatever order
    if longest >= MIN_RUN:
        runs = {tuple(passage[k : k + MIN_RUN]) for k in range(n - MIN_RUN + 1)}
        if any(tuple(doc[k : k + MIN_RUN]) in runs for k in range(len(doc) - MIN_RUN + 1)):
            return True
    masks: dict[str, int] = {}
    for k, w in enumerate(passage):
        masks[w] = masks.get(w, 0) | 1 << k
    span, hop = 2 * n, max(1, n // 4)
    if sum(held) < need or sum(w in masks for w in doc) < need:
        return False
    return any(lcs(masks, n, doc[k : k + span]) >= need for k in range(0, max(1, len(doc) - span + hop), hop))


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    split = functools.lru_cache(4096)(words)  # a text comes with many items and a passage with many texts
    for b in batches:
        ok = [contains(split(t), split(p)) for t, p in zip(b["text"], b["passage"])]
        yield b.loc[ok, ["doc_id", "item_id"]]


def _slotted(text: list[str], literals: set[str]) -> tuple[list[str], list[str], list[tuple[int, tuple, tuple]]]:
    """The words, their kinds, and the windows with a slot: position, template, words."""
    kinds = [slot(w, literals) for w in text]
    spans = ((k, tuple(kinds[k : k + WINDOW]), tuple(text[k : k + WINDOW])) for k in range(len(text) - WINDOW + 1))
    return text, kinds, [x for x in spans if any(w[0] == "\x01" for w in x[1])]


def _places(doc: tuple, items: list[tuple[int, tuple]], min_windows: int | None, share: float) -> list[tuple[int, int, int, int]]:
    """(item_id, pos, n_windows, n_agreeing) of a document's places that fit an item with other values; places don't overlap."""
    own = {w for _, it in items for _, _, w in it[2]}
    found = []
    for item_id, (passage, kinds, spans) in items:
        at: dict[tuple, list[int]] = {}
        for j, t, _ in spans:
            at.setdefault(t, []).append(j)
        hits = [(i, t, w in own) for i, t, w in doc[2] if t in at]
        need = min_windows if min_windows is not None else max(3, int(np.ceil(share * len(spans))))
        start = 0
        for e in range(1, len(hits) + 1):
            if e < len(hits) and hits[e][0] - hits[e - 1][0] <= WINDOW * 2 and hits[e][2] == hits[e - 1][2]:
                continue
            part, start = hits[start:e], e
            fresh = [(i, t) for i, t, agrees in part if not agrees]
            if len(fresh) < need:
                continue
            middle = np.median([i - j for i, t in fresh for j in at[t]])
            to: dict[str, set[str]] = {}
            for i, t in fresh:
                j = min(at[t], key=lambda j: abs(i - j - middle))
                for o in range(WINDOW):
                    if kinds[j + o][0] == "\x01":
                        to.setdefault(passage[j + o], set()).add(doc[0][i + o])
            if all(len(v) == 1 for v in to.values()):
                last = part[-1][0] + WINDOW
                n_agreeing = sum(agrees for i, _, agrees in hits if part[0][0] - WINDOW < i < last)
                found.append((-len(fresh), item_id, part[0][0], last, len(fresh) + n_agreeing, n_agreeing))
    kept: list[tuple] = []
    for f in sorted(found):
        if all(f[3] <= k[2] or f[2] >= k[3] for k in kept):
            kept.append(f)
    return [(k[1], k[2], k[4], k[5]) for k in kept]


class LeakIndex:
    """Template windows of the evaluation items (item_id, passage)."""

    def __init__(self, items: DataFrame):
        self.items = items.select("item_id", F.col("passage").alias("text"))
        self.literals = literals_of(items, "passage")
        self.windows = cut(self.items.mapInPandas(_window_rows("item_id", self.literals, None), "item_id long, pos long, template long, slots long").select("item_id", "template", "slots").distinct())
        self.n = self.windows.count()
        small = self.n <= BROADCAST_WINDOWS
        self.templates = np.sort(np.array([r[0] for r in self.windows.select("template").distinct().collect()], np.int64)) if small else None
        self.small = small

    def _hint(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.small else df

    def doc_windows(self, docs: DataFrame) -> DataFrame:
        """(doc_id, pos, template, slots) of documents, only of known templates while the index is small enough to travel."""
        return spread(docs.select("doc_id", "text")).mapInPandas(_window_rows("doc_id", self.literals, self.templates), "doc_id long, pos long, template long, slots long")

    def matches(self, docs: DataFrame) -> DataFrame:
        """(doc_id, item_id, n_agreeing, n_differing): pairs of windows of one template, by whether the values agree too.

        Windows without a placeholder agree by their template.
        """
        index = self.windows.withColumnRenamed("slots", "values")
        agrees = (F.col("slots") == F.col("values")).cast("int")
        return self.doc_windows(docs).join(self._hint(index), "template").groupBy("doc_id", "item_id").agg(F.sum(agrees).alias("n_agreeing"), F.sum(1 - agrees).alias("n_differing"))

    def leaks(self, docs: DataFrame) -> DataFrame:
        """(doc_id, item_id): documents that hold an item's passage wholly or in part, see ``contains``.

        Null texts and ids and null passages are in no pair; repeated rows give one pair.
        """
        found = cut(self.matches(docs.where("doc_id IS NOT NULL")).where("n_agreeing > 0").select("doc_id", "item_id"))
        few = found.count() <= BROADCAST_WINDOWS
        passages = self.items.withColumnRenamed("text", "passage")
        pairs = found.join(F.broadcast(passages) if self.small else passages, "item_id")
        texts = docs.select("doc_id", "text")
        hit = found.select("doc_id").distinct()
        texts = texts.join(F.broadcast(hit) if few else hit, "doc_id", "left_semi")
        return texts.join(pairs, "doc_id").select("doc_id", "item_id", "text", "passage").mapInPandas(_verified, "doc_id long, item_id long").dropDuplicates()

    def reparameterised(self, docs: DataFrame, min_windows: int | None = None, share: float = 0.15) -> DataFrame:
        """(doc_id, item_id, pos, n_windows, n_agreeing): places of documents that fit an item's template with other values in its slots.

        A place has at least ``min_windows`` slotted windows that agree with no item (by default ``share`` of the
        item's own, three at least) and replaces each value of the item by one value throughout. Of items that fit the same
        place the one with the most windows is given; ``n_agreeing`` windows of the place hold some item's own values.
        """
        # a place needs so many windows that differ, so only pairs with as many are looked at
        need = F.greatest(F.lit(3), F.ceil(F.lit(share) * F.col("n_slotted"))) if min_windows is None else F.lit(min_windows)
        size = self.items.mapInPandas(_window_rows("item_id", self.literals, None), "item_id long, pos long, template long, slots long").where("slots <> 0").groupBy("item_id").agg(F.countDistinct("pos").alias("n_slotted"))
        found = cut(self.matches(docs.where("doc_id IS NOT NULL")).join(self._hint(size), "item_id").select("doc_id", "item_id", "n_agreeing", (F.col("n_differing") >= need).alias("enough")))
        # items the document holds word by word stay beside them: their windows are nobody's variant
        pairs = found.where("enough OR n_agreeing > 0").join(found.where("enough").select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "item_id")
        passages = self.items.withColumnRenamed("text", "passage")
        held = pairs.join(F.broadcast(passages) if self.small else passages, "item_id").groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("item_id", "passage"))).alias("items"))
        literals = self.literals

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cut_up = functools.lru_cache(4096)(lambda t: _slotted(words(t), literals))
            for b in batches:
                rows = [(d, *r) for d, t, its in zip(b["doc_id"], b["text"], b["items"]) for r in _places(cut_up(t), [(x["item_id"], cut_up(x["passage"])) for x in its], min_windows, share)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "pos", "n_windows", "n_agreeing"])

        return docs.select("doc_id", "text").join(held, "doc_id").mapInPandas(run, "doc_id long, item_id long, pos long, n_windows long, n_agreeing long").dropDuplicates()
