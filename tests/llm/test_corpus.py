"""Operators over the whole corpus, against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tidemark.llm import mixing, nearcopies, repeats, sharding, simhash
from tidemark.llm.common import table
from tidemark.llm.components import components


def groups_of(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(max(p)), int(min(p))) for p in rng.integers(0, 300, (200, 2)) if p[0] != p[1]] + [(i + 1001, i + 1000) for i in range(60)]
    want = groups_of(pairs, {n for p in pairs for n in p})
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert all(got.get(n, n) == r for n, r in want.items())


def slow_print(text):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)}).replace("\v", " ").replace("\f", " ")
    ws = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 3]).encode(), 42) for i in range(max(1, len(ws) - 2))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


@pytest.mark.parametrize("paired", [64, 2])
def test_simhash(spark, odd, none, tables, paired, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRED", paired)
    for docs in (odd, table(spark, tables, "documents")):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        prints = [slow_print(t) for _, t in rows]
        near = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
        root = groups_of(near, range(len(rows)))
        least = {}
        for k, (d, _) in enumerate(rows):
            if d is not None:
                least[root[k]] = min(d, least.get(root[k], d))
        want = Counter((d, f"{p:016x}", least.get(root[k])) for k, ((d, _), p) in enumerate(zip(rows, prints, strict=True)))
        assert Counter(tuple(r) for r in simhash.digest(docs).collect()) == want
        assert simhash.keep_one(docs).count() == len(set(root.values()))
    assert simhash.digest(none).count() == 0 and simhash.keep_one(odd).columns == odd.columns


def test_near_fingerprints_meet():
    rng = np.random.default_rng(4)
    p = simhash.Pivots()
    x = rng.integers(0, 1 << 63, 200, np.uint64)
    y = x ^ (np.uint64(1) << rng.integers(0, 64, 200, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200, np.uint64))
    a, b = (p.table(v.view(np.int64)) for v in (x, y))
    assert (np.abs(a - b).max(1) <= 2).all() and (p.keys(a) == p.keys(b)).any(1).all()


def slow_shingles(text):
    ws = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)})) if w]
    return frozenset(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()


def slow_keep(rows):
    """(doc_id, text) of the rows that stay: of each component of 5-word Jaccard >= 0.8 the least id, null ids last."""
    sets = [slow_shingles(t) for _, t in rows]
    near = lambda a, b: a == b or len(a & b) * 10 >= 8 * len(a | b)
    root = groups_of([(i, j) for i in range(len(rows)) for j in range(i) if near(sets[i], sets[j])], range(len(rows)))
    best = {}
    for k, (d, _) in enumerate(rows):
        best.setdefault(root[k], []).append((d is None, d or 0))
    return Counter(min(v) for v in best.values())


@pytest.mark.parametrize("paired", [64, 2])
def test_near_copies(spark, odd, none, tables, paired, monkeypatch):
    monkeypatch.setattr(nearcopies, "PAIRED", paired)
    monkeypatch.setattr(nearcopies, "SENT_KEYS", 250_000 if paired > 2 else 0)
    rng = np.random.default_rng(8)
    base = [f"n{x}" for x in rng.integers(0, 900, 300)]
    rows = [(r["doc_id"], r["text"]) for r in table(spark, tables, "documents").collect()]
    for k in range(30):  # copies with zero to eleven words changed: similar to the base up to about six
        copy = list(base)
        for at in rng.choice(300, k % 12, replace=False):
            copy[at] = f"e{k}x{at}"
        rows.append((9000 + k, " ".join(copy)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for docs in (frame, odd):
        want = slow_keep([(r["doc_id"], r["text"]) for r in docs.collect()])
        out = corpus_pipeline.distinct(spark, docs, tables)
        assert Counter((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect()) == want and out.columns == docs.columns
    assert nearcopies.keep_one(none).count() == 0


@pytest.mark.parametrize("paired", [64, 2])
def test_fingerprints_within_a_radius(spark, paired, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRED", paired)
    rng = np.random.default_rng(5)
    fps = [int(x) for x in rng.integers(0, 1 << 62, 40)]
    fps += [x ^ sum(1 << int(b) for b in rng.choice(62, k % 6, replace=False)) for k, x in enumerate(fps * 3)]
    fps = sorted(set(fps))
    want = {(x, y) for x in fps for y in fps if x > y and (x ^ y).bit_count() <= 4}
    got = [tuple(r) for r in simhash.near_pairs(spark.createDataFrame([(x,) for x in fps], "fp long"), 4, 7).collect()]
    assert got and len(got) == len(set(got)) and (set(got) == want if paired > 2 else set(got) < want)


def test_near_copies_come_from_fingerprints(spark, odd, monkeypatch):
    """What SimHash and pivots link, with the exact way for the rest left out."""
    monkeypatch.setattr(nearcopies, "_rest", lambda docs, info, close: close)
    rng = np.random.default_rng(9)
    rows = []
    for k in range(40):  # ten texts, each with three copies of up to two words changed, and one of half the words
        words = [f"m{x}" for x in rng.integers(0, 900, 300)] if k % 4 == 0 else words
        copy = list(words)
        for at in rng.choice(300, k % 3, replace=False):
            copy[at] = f"e{k}x{at}"
        rows += [(k, " ".join(copy)), (100 + k, " ".join(copy[:150]))]
    bits = [[int(sum(int(h) >> j & 1 for h in s) * 2 > len(s)) for j in range(64)] for s in (nearcopies.shingles(t) for _, t in rows)]
    sets = [slow_shingles(t) for _, t in rows]
    near = lambda i, j: sum(a != b for a, b in zip(bits[i], bits[j], strict=True)) <= 4 and len(sets[i] & sets[j]) * 10 >= 8 * len(sets[i] | sets[j])
    root = groups_of([(i, j) for i in range(len(rows)) for j in range(i) if near(i, j)], range(len(rows)))
    want = {rows[r][0] for r in {min(k for k in root if root[k] == root[i]) for i in root}}
    out = corpus_pipeline.distinct(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r["doc_id"] for r in out.collect()} == want and 20 <= len(want) < 60
    assert corpus_pipeline.distinct(spark, odd, "").count() < odd.count()


def slow_repeats(texts, width):
    count = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        mark = np.zeros(len(t) + 1, int)
        for i in range(len(t) - width + 1):
            if count[t[i : i + width]] > 1:
                mark[i] += 1
                mark[i + width] -= 1
        gone = np.cumsum(mark)[: len(t)] > 0
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("block", [3000, 4])
def test_repeats(spark, odd, none, tables, block, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", block)
    rng = np.random.default_rng(2)
    passage = "".join(rng.choice(list("abcdef "), 700))
    rows = [(r["doc_id"], r["text"]) for r in table(spark, tables, "documents").limit(60).collect()]
    rows += [(5000 + i, "".join(rng.choice(list("ghij"), 300)) + passage[i * 5 :] + str(i)) for i in range(12)]
    rows += [(6000, None), (6001, ""), (6002, "ab" * 500), (6003, "x" * 399), (6004, "y" * 401), (6004, "y" * 401), (None, passage)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter((d, *v) for (d, _), v in zip(rows, slow_repeats([(t or "").encode() for _, t in rows], 400), strict=True))
    assert Counter(tuple(r) for r in repeats.removed(frame).collect()) == want
    if block == 3000:
        texts = {d: (t or "").encode() for d, t in rows}
        for r in repeats.without_repeats(frame).where("doc_id is not null").collect():
            raw, at = texts[r["doc_id"]], 0
            for s in r["spans"]:
                assert at <= s["start"] < s["stop"] <= len(raw)
                at = s["stop"] + 1
            gone = np.zeros(len(raw), bool)
            for s in r["spans"]:
                gone[s["start"] : s["stop"]] = True
            assert bytes(r["kept"]) == bytes(b for b, g in zip(raw, gone, strict=True) if not g)
            assert (r["doc_id"], len(raw), int(gone.sum()), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) in want
        assert repeats.removed(none).count() == 0 and repeats.removed(odd).count() == odd.count()


def test_repeats_of_many_equal_rows(spark):
    """Thousands of rows that agree in id and text, and as many without an id, are repeats of each other."""
    rng = np.random.default_rng(6)
    text = "".join(rng.choice(list("mnop qr"), 900))
    rows = [(1, text)] * 3000 + [(None, text[:700])] * 1000 + [(k, "".join(rng.choice(list("stuv"), 500)) + text[100:550] + str(k)) for k in range(2, 6)] + [(9, "".join(rng.choice(list("wxyz"), 800)))]
    distinct = list(dict.fromkeys(rows))
    slow = dict(zip(distinct, slow_repeats([t.encode() for _, t in distinct + distinct[:2]], 400)[: len(distinct)], strict=True))  # two of each that repeat are enough
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in repeats.removed(frame).collect()) == Counter((r[0], *slow[r]) for r in rows)


def test_mixing(spark, odd, none, tables):
    for docs in (odd, table(spark, tables, "documents")):
        got = [tuple(r) for r in mixing.mix(docs).collect()]
        assert len(got) == docs.count() and sorted(got, key=str) == sorted((tuple(r) for r in mixing.mix(docs).collect()), key=str)
        total = sum(size for _, size, *_ in got)
        by = {}
        for d, size, source_size, target, taken in got:
            assert 0 <= taken <= 2 * size
            by.setdefault((source_size, target), [0, 0])
            by[source_size, target][0] += taken
        assert all(abs(v[0] - int(t)) <= 1 or s == 0 for (s, t), v in by.items())
        assert abs(sum(t for _, t in by) - 1.5 * total) < 2 or len(by) < docs.select("source").distinct().count()
    assert mixing.mix(none).count() == 0
    out = mixing.mixed(odd)
    assert out.columns == odd.columns and sum(len((r["text"] or "").split()) for r in out.collect()) == sum(r["taken"] for r in mixing.mix(odd).collect())


def test_shards(spark, odd, none, tables, monkeypatch):
    docs = table(spark, tables, "documents")
    got = sharding.shards(docs, 20_000).collect()
    sums = Counter()
    for r in got:
        sums[r["shard"]] += r["n_bytes"]
    assert len(got) == docs.count() and all(sums[r["shard"]] == r["shard_bytes"] for r in got)
    assert all(v <= 20_000 or sum(r["shard"] == k for r in got) == 1 for k, v in sums.items())
    names = [k for k in sums if "." not in k]
    assert not any(a != b and b.startswith(a) for a in names for b in names)
    for k in names:  # a bucket was split only where it had to be
        assert len(k) < 1 or k == "*" or sum(v for n, v in sums.items() if n.startswith(k[:-1])) > 20_000
    same = spark.createDataFrame([(1, "z" * 90)] * 7, "doc_id long, text string")
    assert sorted(Counter(r["shard"] for r in sharding.shards(same, 200).collect()).values()) == [1, 2, 2, 2]
    monkeypatch.setattr(sharding, "CROWD_ROWS", 2)  # many salts give the same chunks
    assert sorted(Counter(r["shard"] for r in sharding.shards(same, 200).collect()).values()) == [1, 2, 2, 2]
    copies = spark.range(900).selectExpr("cast(1 as long) as doc_id", "repeat('z', 90) as text").union(docs.select("doc_id", "text"))
    sums = Counter()
    for r in sharding.shards(copies, 20_000).collect():
        sums[r["shard"]] += r["n_bytes"]
    assert sum(sums.values()) == 81_000 + sum(r["n_bytes"] for r in got) and sum("." in k for k in sums) == 4
    assert sharding.shards(none).count() == 0 and sharding.sharded(odd).columns == [*odd.columns, "shard_id", "shard_bytes"]


def test_pipeline(spark, tables):
    docs = table(spark, tables, "documents")
    out = corpus_pipeline.run(spark, tables)
    assert out.columns == [*docs.columns, "shard_id", "shard_bytes"] and out.count() > 0
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, tables).columns == docs.columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near-duplicates", "decontamination", "mixture", "shards"]
