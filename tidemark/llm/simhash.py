"""SimHash near-duplicates by pivot distance tables.

A table holds each fingerprint's Hamming distances to reference fingerprints (pivots). |d(x, p) - d(y, p)| <= d(x, y) for
any pivot, so a pair is discarded when its largest coordinate difference passes the radius, and survivors are verified.
The pivots fall into segments: those of a segment differ from the zero pivot in that segment's bits only, so their
coordinates, less the zero pivot's and the pivot's own weight, depend on those bits alone. With `SEGMENTS` segments and
radius 2 a near pair agrees in all coordinates of at least SEGMENTS - 2 of them: that is what pairs meet on. Blocks of
fingerprints that meet and are large (clusters of near copies) are not paired: there, fingerprints meet on the points
within half the radius of both, at most 65 to a point.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import discard, input_columns, row_key, staged
from tidemark.llm.components import components

SHINGLE, RADIUS, SEGMENTS = 3, 2, 5
#: Fingerprints of a block that are compared pair by pair at most.
PAIRED = 64
_SPACES = bytes.maketrans(b"\t\n\v\f\r", b"     ")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_TABLE = bytes(_LOWER[_SPACES[i]] for i in range(256))


def split_words(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """64 bits; a bit is set if it is in over half the XXH64 (seed 42) of all word shingles, repeats included."""
    words = split_words(text)
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    k = max(1, len(words) - size + 1)
    last = (ends[size - 1 :] if len(words) >= size else ends[-1:]) - 1
    h, a, b = xxhash.xxh64_intdigest, starts[:k].tolist(), last.tolist()
    return majority(np.array([h(line[i:j], 42) for i, j in zip(a[at : at + 4096], b[at : at + 4096], strict=True)], np.uint64) for at in range(0, k, 4096))


def majority(parts: Iterable[np.ndarray]) -> int:
    """64 bits; a bit is set if it is in over half the hashes of all parts. Without hashes: 0."""
    count, k = np.zeros(64, np.int64), 0
    for v in parts:
        count += np.unpackbits(v.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        k += len(v)
    return int(np.packbits(count * 2 > k, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, key (128 bits of id and text) and fp, the fingerprint as a signed long. One pass without a shuffle."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py()) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(fp)], names=["doc_id", "key", "fp"])

    return input_columns(docs).withColumn("key", row_key(F.col("doc_id"), F.col("text"))).mapInArrow(add, "doc_id long, key binary, fp long")


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.astype(np.uint64)).astype(np.int16)


class Pivots:
    """Reference fingerprints by segment, and what their distance table gives."""

    def __init__(self, segments: int = SEGMENTS):
        cuts = [round(i * 64 / segments) for i in range(segments + 1)]
        rng = np.random.default_rng(7)
        self.groups: list[np.ndarray] = []
        for a, b in itertools.pairwise(cuts):  # within a segment: its single bits, then random ones
            own = [1 << i for i in range(a, b)]
            own += [sum(1 << (a + int(i)) for i in np.flatnonzero(rng.integers(0, 2, b - a))) for _ in range(4)]
            self.groups.append(np.array(own, np.uint64))
        self.all = np.concatenate([np.zeros(1, np.uint64), *self.groups])
        self.bounds = np.cumsum([1, *[len(g) for g in self.groups]])

    def table(self, fp: np.ndarray) -> np.ndarray:
        """Distances of each fingerprint to each pivot; column 0 is the zero pivot."""
        return popcount(fp.view(np.uint64)[:, None] ^ self.all[None, :])

    def keys(self, table: np.ndarray, radius: int = RADIUS) -> np.ndarray:
        """For each choice of segments that a near pair must share: a hash of their coordinates."""
        n = len(self.groups)
        weight = popcount(self.all)
        inner = (table - table[:, :1] - weight[None, :]).astype(np.int64).view(np.uint64)
        part = []
        with np.errstate(over="ignore"):
            for g in range(n):
                v = np.full(len(table), 1469598103934665603 + g, np.uint64)
                for j in range(self.bounds[g], self.bounds[g + 1]):
                    v = (v ^ inner[:, j]) * np.uint64(0x9E3779B97F4A7C15)
                    v ^= v >> np.uint64(29)
                part.append(v)
            out = []
            for k, c in enumerate(itertools.combinations(range(n), n - radius)):
                v = np.full(len(table), k + 1, np.uint64)
                for g in c:
                    v = (v ^ part[g]) * np.uint64(0xBF58476D1CE4E5B9)
                    v ^= v >> np.uint64(31)
                out.append(v)
        return np.stack(out, 1).view(np.int64)


def close_pairs(keys: np.ndarray, fp: np.ndarray, pivots: Pivots, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs u > v of fingerprints that stand in one block of the sorted keys and are near: the distance table discards,
    the exact distance verifies."""
    table = pivots.table(fp)
    us, vs = [], []
    for d in range(1, len(keys)):
        i = np.flatnonzero(keys[d:] == keys[:-d])
        if not len(i):
            break
        i = i[np.abs(table[i] - table[i + d]).max(1) <= radius]
        i = i[popcount(fp[i].view(np.uint64) ^ fp[i + d].view(np.uint64)) <= radius]
        us.append(np.maximum(fp[i], fp[i + d]))
        vs.append(np.minimum(fp[i], fp[i + d]))
    if not us:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(us), np.concatenate(vs)


def _met(prints: DataFrame, pivots: Pivots, radius: int) -> DataFrame:
    """key, fp, n (fingerprints of the key): where distinct fingerprints (column fp) meet."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 4096):
                part = fp[at : at + 4096]
                k = pivots.keys(pivots.table(part), radius)
                yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), pa.array(np.repeat(part, k.shape[1]))], names=["key", "fp"])

    keys = staged(prints.select("fp").mapInArrow(key, "key long, fp long"), "pivot-keys")
    blocks = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = staged(keys.join(blocks, "key"), "pivot-blocks")
    discard(keys)
    return met


def _paired(met: DataFrame, pivots: Pivots, radius: int) -> DataFrame:
    """u > v: near fingerprints of blocks that are compared pair by pair."""

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, fp = np.empty(0, np.int64), np.empty(0, np.int64)

        def told(k: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            u, v = close_pairs(k, fp, pivots, radius)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for b in batches:
            k = np.concatenate([k, b.column("key").to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, b.column("fp").to_numpy(zero_copy_only=False)])
            whole = int(np.searchsorted(k, k[-1])) if len(k) else 0  # the last block may go on in the next batch
            if whole:
                yield told(k[:whole], fp[:whole])
                k, fp = k[whole:], fp[whole:]
        if len(k):
            yield told(k, fp)

    return met.where(F.col("n") <= PAIRED).repartition("key").sortWithinPartitions("key").select("key", "fp").mapInArrow(pair, "u long, v long")


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """u > v: links of distinct fingerprints (column fp) that join exactly those within radius bits and what they reach."""
    pivots = Pivots()

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ball = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)]).view(np.int64)
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 1024):
                part = fp[at : at + 1024]
                yield pa.RecordBatch.from_arrays([pa.array((part[:, None] ^ ball[None, :]).ravel()), pa.array(np.repeat(part, 65))], names=["point", "fp"])

    met = _met(prints, pivots, radius)
    crowd = met.where(F.col("n") > PAIRED).select("fp").distinct()
    near = crowd.mapInArrow(points, "point long, fp long").withColumn("v", F.min("fp").over(Window.partitionBy("point"))).where("fp > v").select(F.col("fp").alias("u"), "v")
    return _paired(met, pivots, radius).unionByName(near)


def near_pairs(prints: DataFrame, radius: int, segments: int) -> DataFrame:
    """u > v: pairs of distinct fingerprints (column fp) within radius bits, to be verified by the caller. All of them, but
    where over PAIRED meet, only those with the least of the block; such pairs the caller must find otherwise."""
    pivots = Pivots(segments)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v = (b.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v"))
            ok = np.abs(pivots.table(u) - pivots.table(v)).max(1, initial=0) <= radius
            ok &= popcount(u.view(np.uint64) ^ v.view(np.uint64)) <= radius
            yield b.filter(pa.array(ok))

    met = _met(prints, pivots, radius)
    crowd = met.where(F.col("n") > PAIRED)
    least = staged(crowd.groupBy("key").agg(F.min("fp").alias("v")), "pivot-centres")
    star = crowd.join(least, "key").where("fp > v").select(F.col("fp").alias("u"), "v").distinct().mapInArrow(near, "u long, v long")
    return _paired(met, pivots, radius).unionByName(star).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, key, fp, root, component_id for every row: fingerprints within RADIUS bits are linked, and a component has the smallest
    doc_id of those it reaches. A null or empty text has fingerprint 0, linked like any other; null ids count in no
    minimum; repeated rows give a row each."""
    rows = staged(with_fingerprints(docs), "fingerprints")
    prints = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    roots = components(links(prints))
    named = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = staged(named, "print-roots")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = staged(named.join(least, "root").select("fp", "root", "component_id"), "print-classes")
    return rows.join(classes, "fp").select("doc_id", "key", "fp", "root", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each component the row with its smallest doc_id, all columns as they were; a component without ids and repeated
    rows keep one row too. Texts are dealt once, by row key, against the keys that stay."""
    return keep_least(docs, near_duplicates(docs))


def keep_least(docs: DataFrame, told: DataFrame) -> DataFrame:
    """Of the rows of each root in told (doc_id, key, root) the one that keep_one keeps."""
    best = told.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("best"))
    keep = staged(best.select(F.col("best.key").alias("__key")).distinct(), "kept-keys")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = docs.withColumn("__key", row_key(F.col("doc_id").cast("long"), text))
    return marked.join(keep, "__key", "left_semi").dropDuplicates(["__key"]).select(*docs.columns)
