"""Toxicity by a weighted lexicon: Aho-Corasick over folded text, exception phrases, normalised by length."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, input_columns, staged
from tidemark.llm.folds import TRAIN_ROWS, held_out, once, training_rows

#: Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
LOOKALIKES = dict(zip("аеорсухівкмнтѕјһԁԛԝαοερικνυχτηАВЕКМНОРСТХУІЅЈΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxibkmhtsjhdqwaoepiknuxtnabekmhopctxyisjabezhikmnoptyx", strict=True))
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "l": "i"}
#: Marks that are put between letters to hide a word.
HIDDEN = dict.fromkeys(map(ord, "­​‌‍⁠﻿"))
#: Phrases in which a listed word is harmless.
EXCEPTIONS = ("trash can", "trash bag", "clown fish", "class clown", "sore loser", "pathetic fallacy")

_WIDE = {0xFF01 + i: chr(0x21 + i) for i in range(94)}
_MAP = {ord(k): v for k, v in LOOKALIKES.items()} | _WIDE | HIDDEN
_ODD = re.compile("[" + "".join(map(chr, _MAP)) + "]").search


def fold(text: str) -> str:
    """Lower case; lookalikes, wide forms, digits and signs as the letters they stand for; l as i, as 1 may be either."""
    if not text.isascii() and _ODD(text):
        text = text.translate(_MAP)
    text = text.lower()
    for k, v in SIGNS.items():
        text = text.replace(k, v)
    return text


@dataclass
class Lexicon:
    """Folded terms with weights; a term that ends in * is the beginning of words, others are whole words."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    slope: tuple[float, float, float] = (-3.0, 1.0, 1.0)
    half: float = 0.5
    _found: object = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_found": None}

    def automaton(self) -> ahocorasick.Automaton:
        if self._found is None:
            a = ahocorasick.Automaton()
            by: dict[str, list] = {}
            for term, w in self.weights.items():
                by.setdefault(term.rstrip("*"), [0.0, 0.0, 0])[term.endswith("*")] = w
            for phrase in self.exceptions:
                by.setdefault(fold(phrase), [0.0, 0.0, 0])[2] = 1
            for term, (whole, begins, harmless) in by.items():
                a.add_word(term, (len(term), whole, begins, harmless))
            a.make_automaton()
            self._found = a
        return self._found

    def matches(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) in the folded text. Of a word's matches the heaviest counts; those in an exception don't."""
        return self.found(fold(text))

    def found(self, s: str) -> list[tuple[int, int, float]]:
        found: dict[int, tuple[int, int, float]] = {}
        spared: list[tuple[int, int]] = []
        n = len(s)
        for last, (size, whole, begins, harmless) in self.automaton().iter(s) if len(self.automaton()) else ():
            start, end = last - size + 1, last + 1
            if start and s[start - 1].isalnum():
                continue
            ends = end == n or not s[end].isalnum()
            if harmless and ends:
                spared.append((start, end))
            w = max(begins, whole if ends else 0.0)
            if w > 0 and w > found.get(start, (0, 0, 0.0))[2]:
                found[start] = (start, end, w)
        if not spared:
            return list(found.values())
        spared.sort()  # one sweep: the furthest end of the exceptions that begin no later than the match
        out, k, reach = [], 0, 0
        for m in sorted(found.values()):
            while k < len(spared) and spared[k][0] <= m[0]:
                reach = max(reach, spared[k][1])
                k += 1
            if m[1] > reach:
                out.append(m)
        return out

    def signals(self, folded: str) -> tuple[float, float]:
        """Weight found in a folded text, and the same by the logarithm of its length in words."""
        total = sum(w for *_, w in self.found(folded))
        return math.log1p(total), total / math.log2(4 + folded.count(" ") + folded.count("\n"))

    def score(self, text: str) -> float:
        a, b = self.signals(fold(text))
        z = self.slope[0] + self.slope[1] * a + self.slope[2] * b
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


_WORDS = re.compile(r"\w+").findall
#: Lengths of the beginnings of words that are terms.
BEGINNINGS = (4, 5, 6)


def terms(folded: str) -> set[str]:
    """Words of four letters or more and, with a star, beginnings of longer ones: what a lexicon may list."""
    ws = {w for w in _WORDS(folded) if len(w) >= BEGINNINGS[0]}
    return ws | {w[:k] + "*" for w in ws for k in BEGINNINGS if len(w) > k}


def chosen_terms(counts: dict[str, tuple[int, int]], texts: tuple[int, int], least: int, ratio: float = 8.0) -> dict[str, float]:
    """Weights of terms from the number of other and of toxic texts that hold each (counts) and of all such texts. A term
    is chosen that at least `least` toxic texts hold and that is `ratio` times as frequent there; a beginning must be four
    times as telling and stand in no other text, and takes the words that it begins with it."""
    weights: dict[str, float] = {}
    for star in (True, False):
        for term in sorted((t for t, c in counts.items() if c[1] >= least and t.endswith("*") == star), key=lambda t: (len(t), t)):
            stem = term.rstrip("*")
            if any(stem[:k] + "*" in weights for k in BEGINNINGS):
                continue
            other, toxic = counts[term]
            r = (toxic + 0.5) / (texts[1] + 1) / ((other + 0.5) / (texts[0] + 1))
            if r >= ratio * (4 if star else 1) and not (star and other):
                weights[term] = math.log(r)
    return weights


def slope_of(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton's method with a ridge, which keeps it finite where the classes are separate."""
    beta = np.zeros(3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3), x.T @ (y - p) - 0.05 * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(b) for b in beta)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, least: int = 4) -> Lexicon:
    """From at most rows labelled documents, one for each id; equal folded texts count once, as toxic if any of them is.

    Executors fold the texts and count in how many of each class a term stands. To the driver go the counts of terms that
    at least `least` toxic texts hold (a hundredth of them, if that is more: so at most a hundred times as many terms as a
    text holds), and two numbers for each text, from which the slope of the score is learnt; no text goes there."""

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [fold(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array([hashlib.md5(t.encode()).digest() for t in texts], pa.binary()), pa.array(texts, pa.string())], names=["doc_id", "label", "h", "folded"])

    got = once(training_rows(docs, labels, "toxic", rows).mapInArrow(folded, "doc_id long, label int, h binary, folded string"))
    got = staged(got.groupBy("h").agg(F.max((F.col("label") > 0).cast("int")).alias("toxic"), F.first("folded").alias("folded")), "folded-texts")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for y, t in zip(b.column("toxic").to_pylist(), b.column("folded"), strict=True):
                own = list(terms(t.as_py()))
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([y] * len(own), pa.int32())], names=["term", "toxic"])

    toxic = got.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    n = (toxic["n"] - toxic["t"], toxic["t"])
    least = max(least, math.ceil(n[1] / 100))
    counted = got.mapInArrow(told, "term string, toxic int").groupBy("term").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).where(F.col("t") >= least)
    lexicon = Lexicon(chosen_terms({r["term"]: (r["n"] - r["t"], r["t"]) for r in counted.collect()}, n, least))
    if n[0] and n[1]:

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = [lexicon.signals(t.as_py()) for t in b.column("folded")]
                yield pa.RecordBatch.from_arrays([b.column("h"), pa.array([a for a, _ in x], pa.float64()), pa.array([c for _, c in x], pa.float64()), b.column("toxic")], names=["h", "a", "b", "toxic"])

        x = got.mapInArrow(measure, "h binary, a double, b double, toxic int").orderBy("h").toPandas()
        lexicon.slope = slope_of(np.column_stack([np.ones(len(x)), x["a"], x["b"]]), x["toxic"].to_numpy(float))
    discard(got)
    return lexicon


def score_texts(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row. A null text is empty; repeated rows score alike; no
    labelled row gives an empty lexicon, which scores all alike. One pass without a shuffle."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = [lexicon.score(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p, pa.float64()), pa.array([int(x >= threshold) for x in p], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = input_columns(docs).withColumn("held_out", held_out(F.col("doc_id")))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
