"""Removal of repeated passages with run-length compressed BWT indexes.

Every window of WIDTH bytes holds an anchor: its k-gram of least hash, chosen by the bytes alone, so equal windows have
equal anchors at equal places. The windows that have an anchor as their least k-gram are its context. Contexts meet by anchor:

* where all of a context stands twice, it is marked at once (hashes of contexts are enough for that);
* the other contexts of an anchor, with one for each kind that stands twice, are put into blocks; of each block a
  run-length BWT is built, with text positions kept at the run heads alone, and the longest match of every position with
  another is streamed from those (it falls by one from a position to the next until the next run head); matches of at least
  WIDTH mark;
* anchors with more contexts than a block takes are told apart further by larger cores around the anchor (halves of the
  range where a window may begin), until they fit a block, stand alone, or whole windows agree.

All windows are judged on the input; marks of a text are then merged and the marked bytes taken out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, input_columns, row_key, staged

WIDTH, GRAM = 400, 32
#: Contexts of one anchor that go into a block at most, and of a block about.
BLOCK = 3000
#: Bytes of text whose anchors are found together.
GROUP_BYTES = 1 << 20
_rng = np.random.default_rng(20)
_LETTER = _rng.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0..base^(n-1) mod 2^64; a worker keeps the longest."""
    if len(_powers.get(base, ())) < n:
        v = np.full(max(n, 2 * GROUP_BYTES), base, np.uint64)
        v[0] = 1
        with np.errstate(over="ignore"):
            _powers[base] = np.cumprod(v)
    return _powers[base][:n]


def _slide(x: np.ndarray, w: int, best: np.ufunc, pad) -> np.ndarray:
    """best over x[i:i+w] for each i up to len(x) - w."""
    n = len(x)
    v = np.concatenate([x, np.full(-n % w, pad, x.dtype)]).reshape(-1, w)
    left = best.accumulate(v, axis=1).ravel()[:n]
    right = best.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    return best(right[: n - w + 1], left[w - 1 :])


def anchors(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions and hashes of anchors of texts laid end to end (ends: where each stops), and the first and last start of
    the windows that have it as their least gram. No window crosses an end."""
    n, w = len(raw), WIDTH - GRAM + 1
    if n < WIDTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        p = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[raw] * _power(_BASE, n))])
        h = (p[GRAM:] - p[:-GRAM]) * _power(_BACK, n - GRAM + 1)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    least = _slide(h, w, np.minimum, np.uint64(0xFFFFFFFFFFFFFFFF))
    cross = np.ones(n + 1, bool)
    starts = np.concatenate(([0], ends[:-1]))
    step = np.zeros(n + 1, np.int32)
    whole = ends - starts >= WIDTH
    np.add.at(step, starts[whole], 1)
    np.add.at(step, ends[whole] - WIDTH + 1, -1)
    cross = np.cumsum(step)[: len(least)] == 0
    least[cross] = 0
    wide = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    most = _slide(wide, w, np.maximum, np.uint64(0))
    at = np.flatnonzero((most == h) & (h != 0))
    heads = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))  # runs of windows with equal least grams
    tails = np.append(heads[1:], len(least)) - 1
    run = np.searchsorted(heads, np.maximum(at - w + 1, 0), side="right") - 1
    left = np.arange(len(at))
    while len(left):  # to the first run that has the anchor's gram; one is within the reach of every anchor
        left = left[least[heads[run[left]]] != h[at[left]]]
        run[left] += 1
    return at, h[at], np.maximum(heads[run], at - w + 1), np.minimum(tails[run], at)


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(sizes):
        to, mass = at + 1, sizes[at]
        while to < len(sizes) and mass + sizes[to] <= GROUP_BYTES:
            mass += sizes[to]
            to += 1
        yield at, to
        at = to


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    h64 = xxhash.xxh3_64_intdigest
    for b in batches:
        keys, texts = b.column("key"), [t.as_buffer() for t in b.column("text")]
        for at, to in _groups([t.size for t in texts]):
            joined = b"".join(memoryview(t) for t in texts[at:to])
            ends = np.cumsum([t.size for t in texts[at:to]])
            pos, g, low, high = anchors(np.frombuffer(joined, np.uint8), ends)
            doc = np.searchsorted(ends, pos, side="right")
            start = np.concatenate(([0], ends[:-1]))[doc]
            left, right = pos - low, high + WIDTH - pos
            c = np.array([h64(joined[i:j], int(k)) for i, j, k in zip((pos - left).tolist(), (pos + right).tolist(), left.tolist(), strict=True)], np.uint64)
            if len(pos):
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(c.view(np.int64)), keys.take(pa.array(doc + at)), pa.array((pos - start).astype(np.int32)), pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32))], names=["node", "hull", "key", "pos", "left", "right"])


class RunIndex:
    """Run-length BWT of pieces of text with text positions at run heads."""

    def __init__(self, pieces: list[bytes]):
        sizes = np.array([len(p) + 1 for p in pieces])
        n, m = int(sizes.sum()), len(pieces)
        text = np.zeros(n, np.int64)
        stops = np.cumsum(sizes) - 1
        body = np.ones(n, bool)
        body[stops] = False
        text[body] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64) + m
        text[stops] = np.arange(m)  # each stop differs from all, so that no match passes one
        self.text, self.starts = text, np.concatenate(([0], stops[:-1] + 1))
        self.levels: list[tuple[int, np.ndarray]] = []
        base = 257 + m
        width = self.first = 4 if base**4 < 1 << 62 else 2
        padded, key = np.concatenate([text + 1, np.zeros(width, np.int64)]), np.zeros(n, np.int64)
        for j in range(width):
            key = key * base + padded[j : j + n]
        order = np.argsort(key)
        key = key[order]
        new, rank, slots = np.concatenate(([True], key[1:] != key[:-1])), np.empty(n, np.int64), np.arange(n)
        rank[order] = np.maximum.accumulate(np.where(new, slots, 0))
        while True:  # to the full order: two suffixes part at a stop at the latest; a rank is the first place of its group
            self.levels.append((width, rank.astype(np.int32)))
            slots = np.flatnonzero(~(new & np.append(new[1:], True)))
            if not len(slots):
                break
            part = order[slots]
            after = np.zeros(len(part), np.int64)
            inside = part + width < n
            after[inside] = rank[part[inside] + width] + 1
            key = rank[part] * (n + 1) + after
            by = np.argsort(key)
            part, key = part[by], key[by]
            order[slots] = part
            new[slots] = np.concatenate(([True], key[1:] != key[:-1]))
            rank[part] = np.maximum.accumulate(np.where(new[slots], slots, 0))
            width *= 2
        bwt = text[order - 1]
        heads = np.flatnonzero(np.concatenate(([True], (bwt[1:] != bwt[:-1]) | (bwt[1:] < m))))[1:]
        at, before = order[heads], order[heads - 1]
        by = np.argsort(at)
        self.at, self.before = at[by], before[by]
        self.match = self._common(self.at, self.before)
        self.runs = len(heads) + 1

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix of the suffixes at a and b: the kept ranks from wide to narrow, then symbol by symbol."""
        a, b, out, n = a.copy(), b.copy(), np.zeros(len(a), np.int64), len(self.text)
        for width, rank in [*reversed(self.levels)]:
            for _ in range(2 if width == self.levels[-1][0] else 1):
                ok = (a + width <= n) & (b + width <= n)
                ok[ok] = rank[a[ok]] == rank[b[ok]]
                a[ok] += width
                b[ok] += width
                out[ok] += width
        for _ in range(self.first - 1):
            ok = (a < n) & (b < n)
            ok[ok] = self.text[a[ok]] == self.text[b[ok]]
            a[ok] += 1
            b[ok] += 1
            out[ok] += 1
        return out

    def repeated(self, least: int = WIDTH) -> np.ndarray:
        """Which positions of the text are covered by a match of at least `least` with another place."""
        n = len(self.text)
        cover = np.zeros(n + 1, np.int64)
        if len(self.at):
            i = np.arange(n)
            k = np.searchsorted(self.at, i, side="right") - 1
            ok = k >= 0
            length = np.where(ok, self.match[k] - (i - self.at[k]), 0)
            i = i[length >= least]
            j = self.before[k[i]] + i - self.at[k[i]]
            for x in (i, j):
                np.add.at(cover, x, 1)
                np.add.at(cover, x + least, -1)
        return np.cumsum(cover)[:n] > 0


def _union(spans: list[tuple[int, int, bytes]]) -> list[tuple[int, bytes]]:
    """Overlapping pieces (start, end, bytes) of one text as pieces that don't."""
    out: list[list] = []
    for s, e, raw in sorted(spans, key=lambda x: (x[0], -x[1])):
        if out and s <= out[-1][0] + len(out[-1][1]):
            end = out[-1][0] + len(out[-1][1])
            if e > end:
                out[-1][1] += raw[end - s :]
        else:
            out.append([s, bytearray(raw)])
    return [(s, bytes(b)) for s, b in out]


def mark_block(rows: list[tuple[bytes, int, bytes]]) -> list[tuple[bytes, int, int]]:
    """(key, start, bytes) in, (key, start, end) of repeated runs out."""
    by: dict[bytes, list] = {}
    for key, start, raw in rows:
        by.setdefault(key, []).append((start, start + len(raw), raw))
    names, pieces = [], []
    for key, spans in by.items():
        for s, raw in _union(spans):
            names.append((key, s))
            pieces.append(raw)
    index = RunIndex(pieces)
    cover = np.concatenate(([False], index.repeated(), [False])).astype(np.int8)
    edge = np.diff(cover)
    out = []
    for a, z in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        k = int(np.searchsorted(index.starts, a, side="right")) - 1
        key, s = names[k]
        base = int(index.starts[k])
        out.append((key, s + a - base, s + z - base))
    return out


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block; a block is indexed once its last row has come."""
    now, rows = None, []

    def told() -> pa.RecordBatch:
        marks = mark_block(rows)
        cols = list(zip(*marks, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], names=["key", "start", "stop"])

    for b in batches:
        for block, key, start, raw in zip(*(b.column(c).to_pylist() for c in ("block", "key", "start", "raw")), strict=True):
            if block != now and rows:
                yield told()
                rows = []
            now = block
            rows.append((key, start, raw))
    if rows:
        yield told()


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, mass = [], 0

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()], strict=True)], names=["node", "key", "pos", "left", "raw"])  # noqa: B023

        for key, text, wanted in zip(b.column("key"), b.column("text"), b.column("wanted"), strict=True):
            raw = text.as_buffer().to_pybytes()
            for w in wanted.as_py():
                rows.append((w["node"], key.as_py(), w["pos"], w["left"], raw[w["pos"] - w["left"] : w["pos"] + w["right"]]))
                mass += WIDTH * 2
                if mass > 8 << 20:
                    yield told()
                    rows, mass = [], 0
        if rows:
            yield told()


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each context of a crowded node to both halves of the node's range of window starts."""
    h64 = xxhash.xxh3_64_intdigest
    for b in batches:
        rows = []
        for node, low, high, key, pos, left, raw in zip(*(b.column(c).to_pylist() for c in ("node", "low", "high", "key", "pos", "left", "raw")), strict=True):
            mid = (low + high) // 2
            for a, z in ((low, mid), (mid + 1, high)):
                core = (left + z, left + a + WIDTH)
                if core[0] < 0 or core[1] > len(raw):
                    continue
                s, e = max(0, left + a), min(len(raw), left + z + WIDTH)
                child = h64(raw[core[0] : core[1]] + node.to_bytes(8, "little", signed=True), z - low)
                rows.append((child - (1 << 63), h64(raw[s:e], s - left + 1000) - (1 << 63), a, z, key, pos, left - s, s - left, e - left, raw[s:e]))
        if rows:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["node", "hull", "low", "high", "key", "pos", "left", "s", "e", "raw"])


_SPLIT = "node long, hull long, low int, high int, key binary, pos int, left int, s int, e int, raw binary"


def _kinds(rows: DataFrame) -> DataFrame:
    """node, hull, n (rows of this hull), kinds (hulls of the node), one (key and pos of its first row); for nodes of two
    rows or more. The sums per node are written first: a join with a plain table can be split where a node is hot."""
    kinds = staged(rows.groupBy("node", "hull").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "pos")).alias("one")), "hulls")
    nodes = staged(kinds.groupBy("node").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("all")).where("all > 1"), "nodes")
    told = staged(kinds.join(nodes, "node").select("node", "hull", "n", "kinds", "one"), "kinds")
    discard(kinds, nodes)
    return told


def marks(docs: DataFrame) -> DataFrame:
    """key, start, stop: byte ranges that windows of WIDTH bytes cover which start anywhere else too; they may overlap.
    docs: key, text."""
    session = docs.sparkSession
    every = staged(docs.mapInArrow(_find, "node long, hull long, key binary, pos int, left int, right int"), "anchors")
    again = staged(every.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node"), "nodes-again")
    found = staged(every.join(again, "node", "left_semi"), "repeated-anchors")
    discard(every, again)
    kinds = _kinds(found)
    told = staged(found.join(kinds, ["node", "hull"]), "met-anchors")
    discard(found, kinds)
    done = told.where("n > 1").select("key", (F.col("pos") - F.col("left")).alias("start"), (F.col("pos") + F.col("right")).alias("stop"))
    open_ = told.where((F.col("kinds") > 1) & ((F.col("n") == 1) | (F.struct("key", "pos") == F.col("one"))))
    wanted = open_.select("key", "node", "pos", "left", "right").distinct().groupBy("key").agg(F.collect_list(F.struct("node", "pos", "left", "right")).alias("wanted"))
    rows = staged(docs.join(wanted, "key").mapInArrow(_contexts, "node long, key binary, pos int, left int, raw binary"), "contexts")
    rows = rows.withColumn("low", F.lit(GRAM - WIDTH)).withColumn("high", F.lit(0))
    small = None
    while True:
        count = staged(rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "node-sizes")
        crowds = count.where(F.col("size") > BLOCK)
        fit = rows.join(count.where(F.col("size") <= BLOCK), "node").select("node", "key", (F.col("pos") - F.col("left")).alias("start"), "raw")
        small = fit if small is None else small.unionByName(fit)
        if crowds.isEmpty():
            break
        crowd = rows.join(crowds, "node")
        whole = crowd.where("low = high").select("key", (F.col("pos") + F.col("low")).alias("start"), (F.col("pos") + F.col("low") + WIDTH).alias("stop"))
        done = done.unionByName(whole)
        cores = staged(crowd.where("low < high").drop("size").mapInArrow(_split, _SPLIT), "cores")
        kinds = _kinds(cores)
        parts = staged(cores.join(kinds, ["node", "hull"]), "met-cores")
        discard(cores, kinds)
        alike = parts.where((F.col("n") > 1) & (F.col("e") - F.col("s") >= WIDTH))
        done = done.unionByName(alike.select("key", (F.col("pos") + F.col("s")).alias("start"), (F.col("pos") + F.col("e")).alias("stop")))
        rows = parts.where((F.col("kinds") > 1) & ((F.col("n") == 1) | (F.struct("key", "pos") == F.col("one")))).select("node", "key", "pos", "left", "raw", "low", "high")
    small = staged(small, "block-rows")
    blocks = max(1, -(-small.count() // BLOCK))
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), blocks // 8)
    small = small.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks)))
    indexed = small.repartition(tasks, "block").sortWithinPartitions("block").select("block", "key", "start", "raw").mapInArrow(_index, "key binary, start int, stop int")
    return done.unionByName(indexed)


def _with_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text, spans (ranges to remove, in any order; null for none) of every row."""
    rows = input_columns(docs).withColumn("key", row_key(F.col("doc_id"), F.col("text")))
    # repeated rows give the same spans
    found = marks(rows.select("key", "text")).groupBy("key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    return rows.join(staged(found, "spans"), "key", "left").select("doc_id", "text", "spans")


def runs_of(spans: list[dict] | None) -> list[tuple[int, int]]:
    """The maximal runs of bytes that spans cover, in order; spans that touch are one."""
    out: list[list[int]] = []
    for s, e in sorted((s["start"], s["stop"]) for s in spans or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def kept(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    """What is left of a text without the runs."""
    at = [0, *(e for _, e in runs)]
    return b"".join(raw[a:z] for a, z in zip(at, [*(s for s, _ in runs), len(raw)], strict=True))


def _cut(docs: DataFrame, schema: str, row: Callable) -> DataFrame:
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<struct<start:int,stop:int>>": pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))}[k] for k in kinds]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 500):
                part = b.slice(at, 500)
                rows = [row(i.as_py(), t.as_buffer().to_pybytes(), runs_of(s.as_py())) for i, t, s in zip(part.column("doc_id"), part.column("text"), part.column("spans"), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))

    return _with_spans(docs).mapInArrow(cut, schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, spans (the removed runs, start and stop in bytes), kept (what is left, bytes: a cut may fall within a
    character) of every row."""
    return _cut(docs, "doc_id long, spans array<struct<start:int,stop:int>>, kept binary", lambda i, raw, runs: (i, [{"start": s, "stop": e} for s, e in runs], kept(raw, runs)))


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row. Null text: empty, nothing removed. Repeated rows are
    repeats of each other; a null id is a row like any other; texts under WIDTH bytes lose nothing."""

    def digest(i: int | None, raw: bytes, runs: list[tuple[int, int]]) -> tuple:
        return i, len(raw), sum(e - s for s, e in runs), len(runs), hashlib.sha256(kept(raw, runs)).hexdigest()

    return _cut(docs, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", digest)
