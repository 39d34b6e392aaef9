"""Near copies by SimHash and pivot distance tables, verified by exact Jaccard similarity of word shingles, for the corpus pipeline.

Texts of equal shingle sets are one node. Each set has a SimHash of 64 bits; fingerprints within `RADIUS` bits meet by pivot
tables (simhash.near_pairs), and what meets is linked if the sets' similarity is `LEAST` or more.

Similar sets lie some 10 bits apart at `LEAST`, farther than pivots can search, so sets that this leaves apart are looked for
by an exact way: sets of similarity `LEAST` or more share a shingle among the first n - ceil(LEAST n) + 1 of each in any common
order; in those prefixes sets of different components meet, so no such pair is missed. The order is that of hashes, with
shingles last that many prefixes would share (a common line; what all of a group of copies have). Pairs that meet are
discarded by bounds that no such pair fails (what is left of the sets from the place where they meet, counts of shingles by
bucket) and the rest is verified on the sets themselves. In blocks of more than `PAIRED` sets, all are first held against
a few members that meet most others; pairs that this leaves in different components are discarded by a pivot table of
Hamming distances between fingerprints of their sets, and survivors are verified.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, input_columns, row_key, staged
from tidemark.llm.components import components
from tidemark.llm.simhash import keep_least, majority, near_pairs, split_words

#: Words of a shingle; least similarity of near copies.
SHINGLE, LEAST = 5, 0.8
#: Bits that fingerprints which meet by pivots differ in at most; segments of the pivots, all but RADIUS of which are shared.
RADIUS, SEGMENTS = 4, 7
#: Sets of a block that are compared pair by pair at most; members of a larger one that all others are held against.
PAIRED, CENTRES = 64, 4
#: Keys of texts that are sent to all executors at most, some 40 bytes each.
SENT_KEYS = 250_000
#: Common shingles that go to the driver and the executors at most.
MOST_COMMON = 100_000
#: Counts of shingles by hash that bound how many two sets share; members of a crowded block that serve as pivots.
BUCKETS, MOST, PIVOTS = 256, 255, 8


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct word shingles, ascending; a shorter text is one shingle, one without words has none."""
    words = split_words(text)
    if not words:
        return np.empty(0, np.uint64)
    known: dict[bytes, int] = {}
    h = xxhash.xxh64_intdigest
    for w in words:
        if w not in known:
            known[w] = h(w, 42)
    v = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(size, len(v))
    out = np.full(len(v) - size + 1, size, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            out = (out ^ v[j : j + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
    return np.unique(out)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Some rows at once, so that a worker holds little besides the Arrow batch."""
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.slice(at, rows)


def needed(total: int | np.ndarray) -> np.ndarray:
    """Least overlap of two sets with so many shingles together that are near copies."""
    return np.ceil(LEAST / (1 + LEAST) * np.asarray(total) - 1e-9)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= LEAST * (len(a) + len(b) - both) - 1e-9


class Order:
    """The order in which sets show their shingles: by hash, but some common ones last, by how common they are."""

    def __init__(self, common: list[tuple[int, int]] = ()):
        """common: (shingle as a signed number, times)."""
        by = sorted((np.array([t for t, _ in common], np.int64).view(np.uint64).tolist()[k], m) for k, (_, m) in enumerate(common))
        self.tokens, self.times = np.array([t for t, _ in by], np.uint64), np.array([m for _, m in by], np.int64)

    def prefix(self, s: np.ndarray) -> np.ndarray:
        """The first n - ceil(LEAST n) + 1 of n ascending shingles."""
        k = len(s) - math.ceil(LEAST * len(s) - 1e-9) + 1
        if len(self.tokens) and len(s):
            at = np.minimum(np.searchsorted(self.tokens, s), len(self.tokens) - 1)
            hit = self.tokens[at] == s
            if hit.any():
                last = np.flatnonzero(hit)
                s = np.concatenate((s[~hit], s[last[np.lexsort((s[last], self.times[at[last]]))]]))
        return s[:k].view(np.int64)


def _order(docs: DataFrame) -> Order:
    """Of the shingles that more than PAIRED rows would show by hash alone, at most MOST_COMMON, the most shown."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            own = [Order().prefix(shingles(t.as_py())) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *own]))], names=["token"])

    shown = input_columns(docs).select("text").mapInArrow(add, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > PAIRED)
    return Order([tuple(r) for r in shown.orderBy(F.desc("m"), "token").limit(MOST_COMMON).collect()])


def _described(docs: DataFrame, order: Order) -> DataFrame:
    """doc_id, key, sid (hash of the set), fp (its SimHash), n, counts by bucket, prefix of every row."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            sid, fp, size, counts, prefix = [], [], [], [], []
            for t in b.column("text"):
                s = shingles(t.as_py())
                sid.append(xxhash.xxh64_intdigest(s.tobytes(), 42) - (1 << 63))
                fp.append(majority(s[at : at + 4096] for at in range(0, len(s), 4096)))
                size.append(len(s))
                counts.append(np.minimum(np.bincount((s % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS), MOST).astype(np.uint8).tobytes())
                prefix.append(order.prefix(s))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(sid, pa.int64()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(size, pa.int32()), pa.array(counts, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))], names=["doc_id", "key", "sid", "fp", "n", "counts", "prefix"])

    rows = input_columns(docs).withColumn("key", row_key(F.col("doc_id"), F.col("text")))
    return rows.mapInArrow(add, "doc_id long, key binary, sid long, fp long, n int, counts binary, prefix array<long>")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """sid and its shingles, for the rows whose key is wanted."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("sid"), pa.array([shingles(t.as_py()).tobytes() for t in b.column("text")], pa.binary())], names=["sid", "set"])

    rows = input_columns(docs).withColumn("key", row_key(F.col("doc_id"), F.col("text"))).join(wanted, "key").select("sid", "text")
    return rows.mapInArrow(add, "sid long, set binary").dropDuplicates(["sid"])


def _bounded(a: np.ndarray, b: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Whether counts by bucket let sets be near copies. Counts that are cut at MOST bound nothing."""
    least = np.minimum(a, b)
    return (least.sum(1, dtype=np.int64) >= needed(total)) | (least == MOST).any(1)


def _verified(docs: DataFrame, pairs: DataFrame, info: DataFrame) -> DataFrame:
    """Of the pairs u > v of sids those that are near copies: first the bound, then the sets,
    which are made again from the texts of those left."""

    def column(b: pa.RecordBatch, name: str) -> np.ndarray:
        return np.frombuffer(b"".join(b.column(name).to_pylist()), np.uint8).reshape(-1, BUCKETS)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = _bounded(column(b, "cu"), column(b, "cv"), b.column("nu").to_numpy() + b.column("nv").to_numpy())
            yield b.select(["u", "v"]).filter(pa.array(ok))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            ok = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(b.column("su"), b.column("sv"), strict=True)]
            yield b.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    side = lambda x: info.select(F.col("sid").alias(x), F.col("n").alias(f"n{x}"), F.col("counts").alias(f"c{x}"))
    left = staged(pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "nu", "nv", "cu", "cv").mapInArrow(bound, "u long, v long"), "copy-candidates")
    if left.isEmpty():
        return left
    wanted = staged(left.select(F.explode(F.array("u", "v")).alias("sid")).distinct().join(info.select("sid", "key"), "sid"), "copy-wanted")
    # few keys go to where the texts lie; beyond that texts and keys meet by key
    sets = staged(_sets(docs, F.broadcast(wanted) if wanted.count() <= SENT_KEYS else wanted), "copy-shingles")
    held = lambda x: sets.select(F.col("sid").alias(x), F.col("set").alias(f"s{x}"))
    found = staged(left.join(held("u"), "u").join(held("v"), "v").select("u", "v", "su", "sv").mapInArrow(check, "u long, v long"), "copy-links")
    discard(left, wanted, sets)
    return found


def _blocks(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole blocks of rows that are sorted by token."""
    rest: list[pa.RecordBatch] = []
    for b in rows:
        if not b.num_rows:
            continue
        token = b.column("token").to_numpy()
        cut = int(np.searchsorted(token, token[-1]))
        if rest and cut:
            yield pa.Table.from_batches([*rest, b.slice(0, cut)])
            rest = []
        elif cut:
            yield pa.Table.from_batches([b.slice(0, cut)])
        rest.append(b.slice(cut))
        if len(rest) > 1 and rest[0].column("token")[0].as_py() != token[-1]:
            yield pa.Table.from_batches(rest[:-1])
            rest = rest[-1:]
    if rest:
        yield pa.Table.from_batches(rest)


def _u_v(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["u", "v"])


def _pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of each block that lie in different components and that sizes and places let be near copies."""
    for t in _blocks(batches):
        token, sid, n, room, root = (t.column(c).to_numpy() for c in ("token", "sid", "n", "room", "root"))
        for d in range(1, len(token)):
            i = np.flatnonzero(token[d:] == token[:-d])
            if not len(i):
                break
            i = i[(root[i] != root[i + d]) & (np.minimum(room[i], room[i + d]) >= needed(n[i].astype(np.int64) + n[i + d]))]
            yield _u_v(sid[i], sid[i + d])


class Parities:
    """Fingerprints of BUCKETS bits, odd counts of shingles by bucket, with a table of their Hamming distances to pivots.

    Two sets differ in at least as many shingles as their fingerprints in bits, and in at least as many as their distances
    to any pivot differ: so near copies are never discarded. Counts that are cut at MOST bound nothing."""

    def __init__(self, counts: np.ndarray, pivots: int = PIVOTS):
        self.bits = np.packbits(counts & 1, axis=1).view(np.uint64)
        self.cut = (counts == MOST).any(1)
        self.table = np.stack([self.distance(self.bits, self.bits[k]) for k in np.linspace(0, len(self.bits) - 1, pivots).astype(int)], 1)

    @staticmethod
    def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(a ^ b).sum(1, dtype=np.int16)

    def near(self, i: int, j: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Of the places j those that may be a near copy of i; total: both sets' sizes together."""
        if self.cut[i]:
            return j
        most = total - 2 * needed(total)
        left = (np.abs(self.table[j] - self.table[i]).max(1) <= most) | self.cut[j]
        j, most = j[left], most[left]
        return j[(self.distance(self.bits[j], self.bits[i]) <= most) | self.cut[j]]


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each block that lie in different components and that the bounds let be near copies. One of such a pair is
    outside the block's largest component, so only those are gone through."""
    for t in _blocks(batches):
        token, sid, size, space, root = (t.column(c).to_numpy() for c in ("token", "sid", "n", "room", "root"))
        counts = np.frombuffer(b"".join(t.column("counts").to_pylist()), np.uint8).reshape(-1, BUCKETS)
        for begin, end in itertools.pairwise(np.concatenate(([0], np.flatnonzero(np.diff(token)) + 1, [len(token)])).tolist()):
            prints, own, names = Parities(counts[begin:end]), counts[begin:end], sid[begin:end]
            r, n, room = root[begin:end], size[begin:end].astype(np.int64), space[begin:end]
            known, times = np.unique(r, return_counts=True)
            main = r == known[times.argmax()]
            place = np.arange(end - begin)
            for i in np.flatnonzero(~main).tolist():
                total = n + n[i]
                j = np.flatnonzero((r != r[i]) & (main | (place > i)) & (np.minimum(room, room[i]) >= needed(total)))
                j = prints.near(i, j, total[j])
                j = j[_bounded(own[j], own[i][None, :], total[j])]
                if len(j):
                    yield _u_v(np.full(len(j), names[i]), names[j])


def _close(docs: DataFrame, info: DataFrame) -> DataFrame:
    """node, root: sets linked by near copies whose fingerprints lie within RADIUS bits. Of sets with one fingerprint one
    stands for it."""
    prints = staged(info.groupBy("fp").agg(F.min("sid").alias("one")), "copy-prints")
    side = lambda x: prints.select(F.col("fp").alias(x), F.col("one").alias(f"s{x}"))
    met = near_pairs(prints, RADIUS, SEGMENTS).join(side("u"), "u").join(side("v"), "v")
    met = met.select(F.greatest("su", "sv").alias("u"), F.least("su", "sv").alias("v"))
    same = info.select("fp", "sid").join(prints, "fp").where("sid > one").select(F.col("sid").alias("u"), F.col("one").alias("v"))
    return staged(components(_verified(docs, met.unionByName(same), info)), "copy-roots")


def _rest(docs: DataFrame, info: DataFrame, close: DataFrame) -> DataFrame:
    """node, root: sets linked by near copies, all of them. close: what is linked already, in the same form."""
    linked = lambda roots, more: staged(components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more)), "copy-roots")
    placed = info.join(close, F.col("sid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "sid"))
    tokens = placed.select(F.posexplode("prefix").alias("pos", "token"), "sid", "n", "root").select("token", "sid", "n", (F.col("n") - F.col("pos")).alias("room"), "root")
    blocks = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("token", "m")
    met = staged(tokens.join(blocks, "token"), "copy-blocks")
    small = met.where(F.col("m") <= PAIRED).repartition("token").sortWithinPartitions("token").select("token", "sid", "n", "room", "root").mapInArrow(_pair, "u long, v long")
    crowd = met.where(F.col("m") > PAIRED)
    reach = crowd.groupBy("sid").agg(F.count(F.lit(1)).alias("reach"))
    crowd = staged(crowd.join(reach, "sid"), "copy-crowds")
    # of each of CENTRES parts of a block the member that meets most others, found map-side; all others are held against them
    best = crowd.groupBy("token", F.pmod("sid", F.lit(CENTRES)).alias("part")).agg(F.max(F.struct("reach", "sid", "n", "room", "root")).alias("c"))
    best = staged(best.select("token", "c.sid", "c.n", "c.room", "c.root"), "copy-centres")
    star = crowd.join(best.select("token", F.col("sid").alias("c"), F.col("n").alias("cn"), F.col("room").alias("croom"), F.col("root").alias("croot")), "token")
    star = star.where("root != croot").where(F.least("room", "croom") >= F.ceil((F.col("n") + F.col("cn")) * (LEAST / (1 + LEAST)) - 1e-9))
    star = star.select(F.greatest("sid", "c").alias("u"), F.least("sid", "c").alias("v"))
    found = _verified(docs, small.unionByName(star).distinct(), info)
    discard(met, best)
    roots = linked(close, found)
    known = crowd.drop("root").join(roots, F.col("sid") == F.col("node"), "left").select("token", "sid", "n", "room", F.coalesce("root", "sid").alias("root"))
    mixed = known.groupBy("token").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("token")
    left = known.join(mixed, "token").join(info.select("sid", "counts"), "sid").repartition("token").sortWithinPartitions("token").select("token", "sid", "n", "room", "root", "counts")
    return linked(roots, _verified(docs, left.mapInArrow(_across, "u long, v long").distinct(), info))


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, key, root for every row: rows with equal root are linked by near copies. Texts without words are copies."""
    rows = staged(_described(docs, _order(docs)), "copy-rows")
    info = staged(rows.groupBy("sid").agg(F.min("key").alias("key"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("counts").alias("counts"), F.first("prefix").alias("prefix")), "copy-sets")
    ids = staged(rows.select("doc_id", "key", "sid"), "copy-ids")
    discard(rows)
    roots = _rest(docs, info, _close(docs, info))
    return ids.join(roots, F.col("sid") == F.col("node"), "left").select("doc_id", "key", F.coalesce("root", "sid").alias("root"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Of the rows that near copies link, the one with the smallest doc_id, as simhash.keep_one keeps it."""
    return keep_least(docs, near_copies(docs))
