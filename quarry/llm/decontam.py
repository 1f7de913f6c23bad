"""Benchmark decontamination: a BM25 index of the test items, queried by every training passage.

The items are the documents of the index. A posting holds an item and the BM25 impact of the term
in it, divided by the item's sum of impacts, so an item scores the share of its own weight that a
passage covers, from 0 to 1. Postings of a term are cut in blocks with the largest impact of each
(block-max). A passage is every window of a text of ``passage`` words, half overlapping and at least twice
as long as the longest item, so each occurrence of an item lies within one. Block-max WAND
retrieves all items of score ``threshold`` or more. A passage is walked only if one item can reach
the threshold by its rare terms, all its common ones taken as present: an item's common terms are
the commonest that hold up to half the threshold. A retrieved item is verified on the whole text: of its question
(all but the last sentence, or the first two thirds) and of its answer (the rest), ``overlap`` of the
word five-grams each must occur (of shorter ones the words as a run).

``edited`` also takes an item that a passage holds with edits: of a run of the passage, of at most 1 / ``overlap``
times the item's words, ``overlap`` of the item's words are in their order there, and ``PART`` of the question's and
of the answer's. The shares reported are then of words.

The index goes to the executors in parts of at most ``ITEMS`` items and ``ITEM_CHARS`` characters. Of several parts
each has a pass of its own over the texts, whose result is written before the next part is sent, so a worker
holds one part at a time and the driver two. Items of over ``LONG_CHARS`` characters are in parts of items of like length, as a
part's passages are as long as its longest item needs.

Defined cases: a null text counts as empty and matches nothing; items that are null or without
words match nothing; equal items are all reported; a null doc_id or item_id is reported as such;
repeated rows are reported each; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, small_batches, text_of, written

WORDS = re.compile(r"\w+")
SENTENCE = re.compile(r"(?<=[.!?])\s+")
#: Bounds of one part of the index.
ITEMS = 20_000
ITEM_CHARS = 8_000_000
LONG_CHARS = 4096
BLOCK = 16
K1, B = 1.2, 0.75
#: Least share of the words of an edited item's question and of its answer.
PART = 0.5
HITS = "array<struct<item_id:long,question:double,answer:double>>"


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def grams(words: list[str], n: int = 5) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of all but the last sentence, and of the last; of one sentence, two thirds and a third."""
    parts = [w for w in map(words_of, SENTENCE.split(text)) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = -(-2 * len(words) // 3)
    return words[:cut], words[cut:]


def common_in_order(part: list[str], run: list[str]) -> list[int]:
    """Length of the longest common subsequence of part and the first 0, 1, ... words of run, by bits."""
    places: dict[str, int] = {}
    for i, w in enumerate(part):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(part)) - 1
    v, out = full, [0]
    for w in run:
        u = v & places.get(w, 0)
        v = ((v + u) | (v - u)) & full
        out.append(len(part) - v.bit_count())
    return out


def edited_shares(question: list[str], answer: list[str], passage: list[str], overlap: float) -> tuple[float, float] | None:
    """Shares of the question's and the answer's words in order, the best of all runs of the passage, or none."""
    least, size = overlap * (len(question) + len(answer)) - 1e-9, int((len(question) + len(answer)) / overlap + 1e-9)
    mine, best, most = {*question, *answer}, None, 0
    here = [w in mine for w in passage]
    for at in range(len(passage)):
        if not here[at] or sum(here[at : at + size]) < max(least, most + 1):
            continue
        run = passage[at : at + size]
        first = common_in_order(question, run)
        rest = common_in_order(answer[::-1], run[::-1])[::-1]
        for q, a in zip(first, rest, strict=True):
            if q + a >= least and q + a > most and q >= PART * len(question) and a >= PART * len(answer):
                best, most = (q / len(question), a / len(answer) if answer else q / len(question)), q + a
    return best


class Index:
    """Postings of one part of the items. items: (item_id, text)."""

    def __init__(self, items: list[tuple[int | None, str]], threshold: float, overlap: float, passage: int, edited: bool = False):
        self.threshold, self.overlap, self.edited = threshold, overlap, edited
        self.ids, self.parts = [], []
        bags: list[Counter] = []
        for item_id, text in items:
            words = words_of(text)
            if words:
                self.ids.append(item_id)
                bags.append(Counter(words))
                self.parts.append([(part, grams(part)) for part in question_answer(text) if part])
        sizes = [sum(b.values()) for b in bags]
        mean, n = (sum(sizes) / len(sizes) if sizes else 1.0), len(bags)
        df = Counter(t for b in bags for t in b)
        self.terms = {t: i for i, t in enumerate(sorted(df))}
        lists: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        rare: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        self.common = np.zeros(n)
        for d, bag in enumerate(bags):
            norm = K1 * (1 - B + B * sizes[d] / mean)
            impact = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + norm) for t, c in bag.items()}
            whole = sum(impact.values())
            for t in sorted(bag, key=lambda t: (-df[t], len(t), t)):  # the commonest first
                share = impact[t] / whole
                lists[self.terms[t]].append((d, share))
                if self.common[d] + share <= threshold / 2:
                    self.common[d] += share
                else:
                    rare[self.terms[t]].append((d, share))
        self.rare_n = np.array([len(x) for x in rare] + [0], np.int64)  # the last is for words of no item
        self.rare_at = np.concatenate([[0], self.rare_n.cumsum()])[:-1]
        self.rare_item = np.array([d for x in rare for d, _ in x], np.int64)
        self.rare_share = np.array([s for x in rare for _, s in x], np.float64)
        self.shares = [[s for _, s in x] for x in lists]
        self.docs = [[d for d, _ in x] for x in lists]
        self.block_max = [[max(s[i : i + BLOCK]) for i in range(0, len(s), BLOCK)] for s in self.shares]
        self.term_max = [max(b) for b in self.block_max]
        self.passage = max([passage, *(2 * s for s in sizes)])

    def search(self, terms: list[int]) -> list[int]:
        """Block-max WAND: all items whose shares over the distinct terms sum to the threshold."""
        limit = self.threshold - 1e-9
        at = {t: 0 for t in terms}
        out: list[int] = []
        order = sorted(at, key=lambda t: self.docs[t][0])
        while order:
            bound, pivot = 0.0, None
            for t in order:
                bound += self.term_max[t]
                if bound >= limit:
                    pivot = self.docs[t][at[t]]
                    break
            if pivot is None:
                break
            here = [t for t in order if self.docs[t][at[t]] <= pivot]
            tight, after = 0.0, None
            for t in here:
                k = bisect_left(self.docs[t], pivot, at[t])
                if k < len(self.docs[t]):
                    tight += self.block_max[t][k // BLOCK]
                    end = min((k // BLOCK + 1) * BLOCK, len(self.docs[t])) - 1
                    after = min(after, self.docs[t][end] + 1) if after is not None else self.docs[t][end] + 1
            target = pivot + 1
            if tight < limit:  # no item up to the end of these blocks, or before the next term's item, gets there
                rest = [self.docs[t][at[t]] for t in order if self.docs[t][at[t]] > pivot]
                target = max(pivot + 1, min([x for x in (after, *rest[:1], len(self.ids)) if x is not None]))
            else:
                score = 0.0
                for t in here:
                    k = bisect_left(self.docs[t], pivot, at[t])
                    if k < len(self.docs[t]) and self.docs[t][k] == pivot:
                        score += self.shares[t][k]
                if score >= limit:
                    out.append(pivot)
            left = []
            for t in order:
                if self.docs[t][at[t]] < target:
                    at[t] = bisect_left(self.docs[t], target, at[t])
                if at[t] < len(self.docs[t]):
                    left.append(t)
            order = sorted(left, key=lambda t: self.docs[t][at[t]])
        return out

    def passages(self, ids: list[np.ndarray]) -> dict[int, list[tuple[int, np.ndarray]]]:
        """By text, the start and the terms of its passages that can reach the threshold. ids: the terms of each text's words."""
        step, v, n = self.passage // 2, len(self.rare_n), len(self.ids)
        halves = np.array([-(-len(x) // step) for x in ids], np.int64)
        base = halves.cumsum() - halves
        key = np.concatenate([(base[k] + np.arange(len(x)) // step) * v + x for k, x in enumerate(ids)])
        key = np.unique(key[self.rare_n[np.concatenate(ids)] > 0])  # a term once in each half passage
        half, term = key // v, key % v
        count = self.rare_n[term]
        at = np.repeat(self.rare_at[term] - (count.cumsum() - count), count) + np.arange(count.sum())
        key, back = np.unique(np.repeat(half, count) * n + self.rare_item[at], return_inverse=True)
        share = np.bincount(back, self.rare_share[at], len(key))
        # A passage is two halves. A term that is in both counts twice: still a bound.
        inner = ~np.isin(key // n, base)
        key, back = np.unique(np.concatenate([key, key[inner] - n]), return_inverse=True)
        share = np.bincount(back, np.concatenate([share, share[inner]]), len(key))
        out: dict[int, list[tuple[int, np.ndarray]]] = {}
        for h in np.unique(key[share + self.common[key % n] >= self.threshold - 1e-9] // n):
            text = int(np.searchsorted(base, h, "right")) - 1
            start = int(h - base[text]) * step
            terms = np.unique(ids[text][start : start + self.passage])
            out.setdefault(text, []).append((start, terms[terms < len(self.terms)]))
        return out

    def found(self, texts: list[str]) -> list[list[tuple[int | None, float, float]]]:
        """(item_id, question overlap, answer overlap) of each item that each text holds."""
        out: list[list] = []
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= 1_000_000:
                out += self._found(group)
                group, size = [], 0
        return out + self._found(group)

    def _found(self, texts: list[str]) -> list[list[tuple[int | None, float, float]]]:
        get, none, more = self.terms.get, len(self.terms), self.passage // 4  # edits may carry an item over a passage's ends
        ids = [np.array([get(w, none) for w in words_of(t)], np.int64) for t in texts]
        out: list[list] = [[] for _ in texts]
        if not sum(map(len, ids)) or not self.ids:
            return out
        for k, passages in self.passages(ids).items():
            retrieved: dict[int, list[int]] = {}
            for start, terms in passages:
                for d in self.search(terms.tolist()):
                    retrieved.setdefault(d, []).append(start)
            words = words_of(texts[k]) if retrieved else []
            have: dict[int, set] = {}
            for d in sorted(retrieved):
                shares = []
                for part, wanted in self.parts[d]:
                    n = min(5, len(part))
                    if n not in have:
                        have[n] = grams(words, n)
                    shares.append(len(wanted & have[n]) / len(wanted))
                if min(shares) >= self.overlap:
                    out[k].append((self.ids[d], shares[0], shares[-1]))
                elif self.edited:
                    parts = [part for part, _ in self.parts[d]]
                    runs = [edited_shares(parts[0], parts[1] if len(parts) > 1 else [], words[max(0, at - more) : at + self.passage + more], self.overlap) for at in retrieved[d]]
                    if any(runs):
                        out[k].append((self.ids[d], *max(r for r in runs if r)))
        return out


def index_parts(benchmark: DataFrame, threshold: float = 0.7, overlap: float = 0.8, passage: int = 128, edited: bool = False) -> Iterator[Index]:
    """The items stream through the driver, one bounded part at a time; equal rows are one item."""
    rows = benchmark.select("item_id", text_of().alias("text")).distinct()
    rows = rows.withColumn("class", F.greatest(F.lit(0), F.ceil(F.log2(F.length("text") / LONG_CHARS) / 3)).cast("int"))
    part, chars, kind = [], 0, None
    for r in rows.orderBy("class", F.col("item_id").asc_nulls_last(), "text").toLocalIterator():
        if part and (len(part) >= ITEMS or chars >= ITEM_CHARS or r["class"] != kind):
            yield Index(part, threshold, overlap, passage, edited)
            part, chars = [], 0
        part.append((r["item_id"], r["text"]))
        chars, kind = chars + len(r["text"]), r["class"]
    if part:
        yield Index(part, threshold, overlap, passage, edited)


def _found_column(shared):
    @F.pandas_udf(HITS)
    def found(texts: pd.Series) -> pd.Series:
        hits = shared.value.found(texts.tolist())
        return pd.Series([[{"item_id": i, "question": q, "answer": a} for i, q, a in x] for x in hits], dtype=object)

    return found


def _passes(docs: DataFrame, benchmark: DataFrame, first, how: dict) -> Iterator[tuple[Column, bool]]:
    """By part, the array<(item_id, question, answer)> of the items that a row's ``text`` holds, and whether it is the only part.
    What one yields must be written before the next is asked for: the part is then taken from the executors."""
    small_batches(docs.sparkSession)
    parts = index_parts(benchmark, **how)
    part, after = next(parts, None), next(parts, None)
    only = after is None
    while part is not None:
        shared = docs.sparkSession.sparkContext.broadcast(part)
        yield first(_found_column(shared)(text_of())), only
        if only:
            return
        shared.destroy()
        part, after = after, next(parts, None)


def leaks(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """doc_id, item_id, question, answer: a row per text and item that it holds."""
    out = None
    for hit, only in _passes(docs, benchmark, F.explode, how):
        rows = docs.select("doc_id", hit.alias("hit")).select("doc_id", "hit.*")
        if only:
            return rows
        rows = written(rows, "leaks")
        out = rows if out is None else out.unionByName(rows)
    return docs.select("doc_id", F.explode(F.array().cast(HITS)).alias("hit")).select("doc_id", "hit.*") if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without the rows that hold an item; columns unchanged."""
    for held, only in _passes(docs, benchmark, F.size, how):
        docs = docs.filter(held == 0)
        if only:
            return docs
        docs = written(docs, "unleaked")
    return docs


ship(__name__)
