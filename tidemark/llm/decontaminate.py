"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman alignment scores them.

One pass over the corpus finds, for each text, the places where a word n-gram of an item stands, and keeps the words
around them as a passage no longer than the item and a margin. The passages give each n-gram's document frequency over
the whole corpus; of an item's n-grams those that are not some times as frequent as its median one are rare, so what
stands in many copies of an item stays rare and a common turn of phrase doesn't. Passages with a rare seed are aligned
with the item, word by word. Rarity discards nothing: of the others, those are aligned too that have words enough of the
item to reach the score. A copy in which no n-gram of the item is left whole is not found.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import input_columns, row_key, staged

#: Words of a seed; share of an item's greatest alignment score from which a passage is a copy of it.
SEED, SCORE = 5, 0.6
#: A seed is rare up to so many times its item's median frequency, and so many more.
RARE = 8
#: Alignment scores: a word that agrees, one that differs, one that is left out or put in.
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
#: n-grams of items that are sent to the executors at once; a benchmark with more is taken in blocks.
BLOCK_GRAMS = 1_000_000
_WORD = re.compile(r"\w+").findall


def words(text: str) -> list[str]:
    return _WORD(text.lower())


def align(item: list[str], passage: list[str]) -> tuple[float, int, int]:
    """Best local alignment: its score, and first and last-plus-one word of the passage in it."""
    ids: dict[str, int] = {}
    a = [ids.setdefault(w, len(ids)) for w in item]
    b = np.array([ids.setdefault(w, len(ids)) for w in passage], np.int64)
    if not a or not len(b):
        return 0.0, 0, 0
    steps = np.arange(len(b) + 1)
    h, start = np.zeros(len(b) + 1), steps.copy()
    best = (0.0, 0, 0)
    for x in a:
        diagonal = h[:-1] + np.where(b == x, MATCH, MISMATCH)
        up = h[1:] + GAP
        t = np.zeros(len(b) + 1)
        np.maximum(diagonal, up, out=t[1:])
        s = steps.copy()
        s[1:] = np.where(diagonal >= up, start[:-1], start[1:])
        s[t <= 0] = steps[t <= 0]
        np.maximum(t, 0, out=t)
        lifted = t - GAP * steps  # a run of words put in: the greatest of what stands before, less its length
        peak = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted >= peak, steps, 0))
        h, start = peak + GAP * steps, s[source]
        j = int(h.argmax())
        if h[j] > best[0]:
            best = (float(h[j]), int(start[j]), j)
    return best


def reachable(item: Counter[str], passage: list[str]) -> float:
    """What no alignment's score passes: the words that both have, as often as both have them."""
    return MATCH * sum(min(n, item[w]) for w, n in Counter(w for w in passage if w in item).items())


class Items:
    """Words, seeds and where each seed stands, of one block of the benchmark."""

    def __init__(self, rows: list[tuple[int, str]], n: int = SEED):
        self.n = n
        self.names = [i for i, _ in rows]
        self.words = [words(t) for _, t in rows]
        self.ids: dict[str, int] = {}
        grams: dict[tuple, int] = {}
        self.places: list[list[tuple[int, int]]] = []
        self.seeds: list[list[int]] = []
        for k, ws in enumerate(self.words):
            v = [self.ids.setdefault(w, len(self.ids)) for w in ws]
            own = []
            for j in range(max(1, len(v) - n + 1) if v else 0):
                g = grams.setdefault(tuple(v[j : j + n]), len(grams))
                if g == len(self.places):
                    self.places.append([])
                self.places[g].append((k, j))
                own.append(g)
            self.seeds.append(own)
        self.short = {g: i for g, i in grams.items() if len(g) < n}
        full = [(self._mix(np.array([g], np.int64))[0], i) for g, i in grams.items() if len(g) == n]
        full.sort()
        self.hashes = np.array([h for h, _ in full], np.uint64)
        self.numbers = np.array([i for _, i in full], np.int64)
        self.grams = len(grams)

    def _mix(self, v: np.ndarray) -> np.ndarray:
        out = np.full(len(v), 0x9E3779B97F4A7C15, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(v.shape[1]):
                out = (out ^ v[:, j].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
                out ^= out >> np.uint64(31)
        return out

    def hits(self, ws: list[str]) -> list[tuple[int, int]]:
        """(word position, seed) wherever a seed stands."""
        v = np.fromiter(map(self.ids.get, ws, repeat(-1)), np.int64, len(ws))
        out: list[tuple[int, int]] = []
        for g, i in self.short.items():
            for p in np.flatnonzero(v[: len(v) - len(g) + 1] == g[0]) if len(v) >= len(g) else ():
                if tuple(v[p : p + len(g)].tolist()) == g:
                    out.append((int(p), i))
        m = len(v) - self.n + 1
        if m > 0 and len(self.hashes):
            ok = v >= 0
            run = np.cumsum(np.concatenate(([0], ok)))
            at = np.flatnonzero(run[self.n :] - run[: -self.n] == self.n)
            if len(at):
                h = self._mix(v[at[:, None] + np.arange(self.n)])
                k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                hit = self.hashes[k] == h
                out += zip(at[hit].tolist(), self.numbers[k[hit]].tolist(), strict=True)
        return out

    def passages(self, ws: list[str]) -> Iterator[tuple[int, list[int], int, list[str]]]:
        """(item, its seeds found, first word, words): hits of an item whose starts lie within a margin form one passage."""
        starts: dict[int, list[tuple[int, int]]] = {}
        for p, g in self.hits(ws):
            for k, j in self.places[g]:
                starts.setdefault(k, []).append((p - j, g))
        for k, found in starts.items():
            found.sort()
            size = len(self.words[k])
            margin = size // 2 + 4
            at = 0
            while at < len(found):
                to = at + 1
                while to < len(found) and found[to][0] - found[at][0] <= margin:
                    to += 1
                low, high = max(0, found[at][0] - margin), found[to - 1][0] + size + margin
                yield k, sorted({g for _, g in found[at:to]}), low, ws[low:high]
                at = to


def _blocks(benchmark: DataFrame, n: int) -> Iterator[Items]:
    """The benchmark's items in blocks of bounded size; a block is what the driver and each worker hold at once."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    mass = items.agg(F.sum(F.regexp_count("text", F.lit(r"(?U)\w+")) + 1)).first()[0] or 0  # an n-gram at most for each word, one for a short item
    blocks = math.ceil(mass / BLOCK_GRAMS)
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).orderBy("item_id", "text")
        yield Items([tuple(r) for r in part.collect()], n)


def leaks(docs: DataFrame, benchmark: DataFrame, n: int = SEED, least: float = SCORE) -> DataFrame:
    """key, doc_id, item_id, score (share of the item's greatest), start, words: a row per row and item that it holds.

    start and words place the best alignment in the row's words. Null and empty texts and items hold nothing; an item of
    fewer than n words is one seed; repeated rows give the same leak once; a null id stays null. Nothing is shuffled but
    the passages' seed counts, summed map-side, and the leaks."""
    found = None
    for items in _blocks(benchmark, n):
        part = _leaks_of(docs, items, least)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "key binary, doc_id long, item_id long, score double, start long, words long")
    best = F.max(F.struct("score", (-F.col("start")).alias("s"), "words")).alias("b")
    return found.groupBy("key", "doc_id", "item_id").agg(best).select("key", "doc_id", "item_id", "b.score", (-F.col("b.s")).alias("start"), "b.words")


def _leaks_of(docs: DataFrame, items: Items, least: float) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.binary(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.int64(), pa.string()]
        for b in batches:
            rows = []
            for key, i, t in zip(b.column("key"), b.column("doc_id"), b.column("text"), strict=True):
                for k, seeds, low, ws in items.passages(words(t.as_py())):
                    rows.append((key.as_py(), i.as_py(), k, seeds, low, " ".join(ws)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "doc_id", "item", "seeds", "low", "passage"])

    rows = input_columns(docs).withColumn("key", row_key(F.col("doc_id"), F.col("text")))
    found = staged(rows.mapInArrow(find, "key binary, doc_id long, item int, seeds array<int>, low long, passage string"), "passages")
    counted = found.select(F.explode("seeds").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    df = np.zeros(items.grams, np.int64)
    for g, c in counted.collect():  # at most a block's n-grams
        df[g] = c
    bags = [Counter(ws) for ws in items.words]
    rare = [frozenset(g for g in own if df[g] <= RARE * (np.median(df[own]) + 1)) for own in items.seeds]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
        known: dict[tuple[int, str], tuple[float, int, int]] = {}
        for b in batches:
            rows = []
            for key, i, k, seeds, low, passage in zip(*(b.column(c).to_pylist() for c in b.schema.names), strict=True):
                best = MATCH * len(items.words[k])
                if (k, passage) not in known:
                    ws = passage.split(" ")
                    if rare[k].isdisjoint(seeds) and reachable(bags[k], ws) / best < least:
                        continue
                    if len(known) > 20_000:
                        known.clear()
                    known[k, passage] = align(items.words[k], ws)
                s, a, z = known[k, passage]
                s /= best
                if s >= least:
                    rows.append((key, i, items.names[k], s, low + a, z - a))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "doc_id", "item_id", "score", "start", "words"])

    return found.mapInArrow(score, "key binary, doc_id long, item_id long, score double, start long, words long")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, all columns as they were."""
    held = staged(leaks(docs, benchmark).select(F.col("key").alias("__key")).distinct(), "leaking-keys")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("__key", row_key(F.col("doc_id").cast("long"), text)).join(held, "__key", "left_anti").select(*docs.columns)
