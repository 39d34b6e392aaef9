"""Classifiers, mixing, fingerprints, shards and the whole pipeline against plain Python, hot rows among them."""

import hashlib
import math
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_corpus import slow_keep
from tidemark.llm import cws, decontaminate, folds, mixing, quality, sharding, toxicity
from tidemark.llm.common import table


def slow_margin(model, x):
    z = model.intercept
    for e, t, v in zip(model.edges, model.tables, x, strict=True):
        z += t[sum(b <= v for b in e)]
    for f, g, ef, eg, t in model.pairs:
        z += t[sum(b <= x[f] for b in ef)][sum(b <= x[g] for b in eg)]
    return z


def slow_tree(g, h, depth, ridge):
    """Per bin the leaf of the tree whose cuts gain most, by trying every cut."""
    leaf = sum(g) / (sum(h) + ridge)
    best, at = sum(g) ** 2 / (sum(h) + ridge) + 1e-9, None
    for cut in range(1, len(g) if depth else 0):
        gain = sum(sum(a) ** 2 / (sum(b) + ridge) for a, b in ((g[:cut], h[:cut]), (g[cut:], h[cut:])))
        if gain > best + 1e-12:
            best, at = gain, cut
    return [leaf] * len(g) if at is None else slow_tree(g[:at], h[:at], depth - 1, ridge) + slow_tree(g[at:], h[at:], depth - 1, ridge)


def test_quality_fit_against_a_plain_loop():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(160, 3)).round(2)
    y = ((x[:, 0] > 0.2) ^ (rng.random(160) < 0.1)).astype(float)
    model = quality.train(x, y, bins=6, rounds=4, pairs=0, ridge=2.0)
    share = (y.sum() + 0.5) / 161
    z = [math.log(share / (1 - share))] * 160
    tables = [[0.0] * (len(e) + 1) for e in model.edges]
    for _ in range(4):
        for f, e in enumerate(model.edges):
            at = [sum(b <= v for b in e) for v in x[:, f]]
            g, h = [0.0] * len(tables[f]), [0.0] * len(tables[f])
            for k, (b, m) in enumerate(zip(at, z, strict=True)):
                p = 1 / (1 + math.exp(-m))
                g[b] += y[k] - p
                h[b] += p * (1 - p)
            step = [0.15 * v for v in slow_tree(g, h, 2, 2.0)]
            tables[f] = [a + b for a, b in zip(tables[f], step, strict=True)]
            z = [m + step[b] for m, b in zip(z, at, strict=True)]
    assert all(np.allclose(a, b) for a, b in zip(model.tables, tables, strict=True)) and np.allclose(model.margin(x), z)
    both = quality.train(x, (x[:, 1] * x[:, 2] > 0).astype(float), bins=6, rounds=10, pairs=2)
    assert len(both.pairs) == 2 and np.allclose(both.margin(x), [slow_margin(both, v) for v in x])


def test_quality_scores_against_a_plain_loop(spark, odd, tables):
    docs, labels = table(spark, tables, "documents"), table(spark, tables, "labels")
    model = quality.fit(docs, labels)
    for df in (docs.limit(60), odd):
        want = Counter()
        for r in df.collect():
            p = 1 / (1 + math.exp(-slow_margin(model, quality.features(r["text"] or ""))))
            want[r["doc_id"], round(p, 9), int(p >= 0.3)] += 1
        assert Counter((r["doc_id"], round(r["score"], 9), r["predicted"]) for r in quality.score_texts(df, model).collect()) == want


def slow_score(lexicon, text):
    s, total, spared = toxicity.fold(text), 0.0, []
    begins = [k for k in range(len(s)) if k == 0 or not s[k - 1].isalnum()]
    for phrase in map(toxicity.fold, lexicon.exceptions):
        spared += [(k, k + len(phrase)) for k in begins if s.startswith(phrase, k) and (k + len(phrase) == len(s) or not s[k + len(phrase)].isalnum())]
    for k in begins:
        best = (0.0, 0)
        for term, w in lexicon.weights.items():
            end = k + len(term.rstrip("*"))
            if s.startswith(term.rstrip("*"), k) and (term.endswith("*") or end == len(s) or not s[end].isalnum()):
                best = max(best, (w, -end))
        if best[0] and not any(a <= k and -best[1] <= b for a, b in spared):
            total += best[0]
    z = lexicon.slope[0] + lexicon.slope[1] * math.log1p(total) + lexicon.slope[2] * total / math.log2(4 + s.count(" ") + s.count("\n"))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def test_toxicity_against_plain_counts(spark, odd, tables):
    docs, labels = table(spark, tables, "documents"), table(spark, tables, "labels")
    lexicon = toxicity.fit(docs, labels, least=2)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    seen = {}
    for r in labels.where(~folds.held_out(F.col("doc_id"))).collect():
        if r["toxic"] is not None and r["doc_id"] in texts:
            t = toxicity.fold(texts[r["doc_id"]])
            seen[t] = max(seen.get(t, 0), r["toxic"])
    counts = defaultdict(lambda: [0, 0])
    for t, y in seen.items():
        for w in toxicity.terms(t):
            counts[w][y] += 1
    n = (sum(1 - y for y in seen.values()), sum(seen.values()))
    assert lexicon.weights == toxicity.chosen_terms({k: tuple(v) for k, v in counts.items()}, n, max(2, math.ceil(n[1] / 100))) and lexicon.weights
    assert max(math.ceil(n[1] / 100), 2) <= n[1]
    lexicon.weights |= {toxicity.fold("trash"): 2.0, toxicity.fold("clown"): 1.5}
    more = spark.createDataFrame([(1, "tr4sh trash can. class clown fish! sore  loser"), (2, "trash can't clown"), (3, "trash bag trash")], "doc_id long, text string")
    for df in (docs.limit(60), odd.where("length(text) < 10000 or text is null"), more):
        want = Counter((r["doc_id"], round(slow_score(lexicon, r["text"] or ""), 9)) for r in df.collect())
        assert Counter((r["doc_id"], round(r["score"], 9)) for r in toxicity.score_texts(df, lexicon).collect()) == want


def test_long_texts_of_exceptions():
    lexicon = toxicity.Lexicon({toxicity.fold("trash"): 2.0})
    began = time.perf_counter()
    assert lexicon.matches("trash can " * 100_000) == [] and len(lexicon.matches("trash can trash " * 30_000)) == 30_000
    assert time.perf_counter() - began < 5


def test_training_rows_are_bounded(spark):
    docs = spark.createDataFrame([(k % 9, f"text {k % 50}") for k in range(1000)] + [(None, "x")] * 10, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(9)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = folds.once(folds.training_rows(docs, labels, "quality", 5)).collect()
    assert len(rows) == 5 == len({r["doc_id"] for r in rows})
    least = {}
    for r in docs.withColumn("h", F.xxhash64("text")).collect():
        least[r["doc_id"]] = min(least.get(r["doc_id"], (1 << 63, "")), (r["h"], r["text"]))
    assert all(r["text"] == least[r["doc_id"]][1] and r["label"] == r["doc_id"] % 2 for r in rows)
    quality.fit(docs, labels, 5)
    toxicity.fit(docs, labels, 5)


def mostly_one(spark, docs):
    """docs among rows of which a third are one row of one source, and a third have no id."""
    same = spark.range(400).selectExpr("cast(7 as long) doc_id", "'same old words here' text", "'hot' source")
    none = spark.range(400).selectExpr("cast(null as long) doc_id", "concat('no id ', id % 90) text", "'hot' source")
    return docs.select("doc_id", "text", "source").union(same).union(none)


def test_mixing_of_hot_rows(spark, tables, monkeypatch):
    docs = mostly_one(spark, table(spark, tables, "documents"))
    want = Counter(tuple(r) for r in mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "RANGE_ROWS", 4)
    assert Counter(tuple(r) for r in mixing.mix(docs).collect()) == want  # many ranges give what few do
    monkeypatch.setattr(mixing, "CROWD_ROWS", 30)
    assert Counter(tuple(r) for r in mixing.mix(docs).collect()) == want  # so do crowds that are numbered by salt
    assert mixing.plan(mixing.sized(docs)).where("taken > 2 * size").count() == 0


def test_fingerprints_of_hot_rows(spark, tables, monkeypatch):
    docs = mostly_one(spark, table(spark, tables, "documents").limit(40))
    want = Counter(tuple(r) for r in cws.fingerprints(docs).collect())
    assert sum(want.values()) == docs.count()
    monkeypatch.setattr(cws, "CROWD_ROWS", 3)
    assert Counter(tuple(r) for r in cws.fingerprints(docs).collect()) == want
    ends = cws._ends(cws.input_columns(docs).withColumn("k", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("th", F.xxhash64("text")), 200)
    assert len(ends) > 5 and ends == sorted(set(ends)) and sum(k == -(1 << 63) for k, _ in ends) > 2  # rows without an id lie in many blocks


def slow_shards(rows, limit):
    """(doc_id, text) rows to bucket names, from the whole table down: a bucket that doesn't fit splits on its next bit."""
    bits = lambda r: f"{int(hashlib.md5(f'{"null" if r[0] is None else r[0]} {r[1] or ""}'.encode()).hexdigest()[:15], 16) >> 20:040b}"
    out, left = {}, [("", list(rows))]
    while left:
        name, part = left.pop()
        if sum(len((t or "").encode()) for _, t in part) <= limit or len(name) == sharding.BITS:
            out |= {r: name or "*" for r in part}
        else:
            left += [(name + b, own) for b in "01" if (own := [r for r in part if bits(r)[len(name)] == b])]
    return out


@pytest.mark.parametrize("limit", [3000, 40_000, 1 << 30])
def test_shards_against_plain_splitting(spark, odd, tables, limit):
    for docs in (odd, table(spark, tables, "documents")):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        want = slow_shards(rows, limit)
        got = docs.select("doc_id", "text").transform(sharding.sharded, limit).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r["shard_id"].split(".")[0] == want[r["doc_id"], r["text"]]
    assert sharding.shards(odd, limit).count() == odd.count()


def slow_mix(rows):
    """doc_id, text of rows (doc_id, text, source) as the mix takes them: whole copies, and the words of a part."""
    split = lambda t: [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if w]
    by = defaultdict(list)
    for d, t, s in rows:
        at = int(hashlib.md5(b"mix" + hashlib.md5(f"{'null' if d is None else d} {t or ''}".encode()).hexdigest().encode()).hexdigest()[:15], 16)
        by[s].append((at, d, t, len(split(t))))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    size = {s: sum(r[3] for r in by[s]) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, free = {}, 1.5 * sum(size.values()), set(names)
    while True:  # sources at their limit drop out and the excess is shared again
        full = {s for s in free if left * weight[s] / sum(weight[x] for x in free) >= 2 * size[s]}
        if not full:
            target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            break
        target |= {s: 2 * size[s] for s in full}
        left, free = left - sum(2 * size[s] for s in full), free - full
    out = []
    for s in names:
        epochs = int(target[s] // size[s]) if size[s] else 0
        rest = math.floor(target[s] + 1e-6) - epochs * size[s]
        for _, d, t, n in sorted(by[s], key=lambda r: (r[0], r[1] or 0)):
            out += [(d, " ".join(split(t)))] * (epochs if n else 0)
            part = min(max(rest, 0), n)
            if part:
                out.append((d, " ".join(split(t)[:part])))
            rest -= n
    return out


def test_pipeline_against_a_plain_chain(spark, tables):
    docs = table(spark, tables, "documents")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    model = quality.fit(docs, table(spark, tables, "labels"))
    rows = [r for r in rows if slow_margin(model, quality.features(r[1] or "")) >= math.log(0.3 / 0.7)]
    kept = slow_keep([(d, t) for d, t, _ in rows])
    rows = [r for r in rows if (r[0] is None, r[0] or 0) in kept]
    items = [decontaminate.words(r["text"] or "") for r in table(spark, tables, "benchmark").collect()]
    clean = lambda t: not any(i and decontaminate.align(i, decontaminate.words(t or ""))[0] >= decontaminate.SCORE * len(i) for i in items)
    before, rows = len(rows), [r for r in rows if clean(r[1])]
    assert len(rows) < before < docs.count()
    mixed = slow_mix(rows)
    out = corpus_pipeline.run(spark, tables)
    assert out.columns == [*docs.columns, "shard_id", "shard_bytes"]
    got = out.collect()
    assert Counter((r["doc_id"], " ".join((r["text"] or "").split())) for r in got) == Counter((d, " ".join(t.split())) for d, t in mixed)
    assert {(r["doc_id"], r["text"]): r["shard_id"].split(".")[0] for r in got} == slow_shards([(r["doc_id"], r["text"]) for r in got], sharding.LIMIT)


def test_pipeline_of_odd_and_empty_tables(spark, odd, none, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns; no labels; items without words."""
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, None), (None, ""), (2, "!!"), (3, "some test item that no document of these holds")], "item_id long, text string")
    for name, docs in (("odd", odd.withColumn("shard_id", F.lit("old")).withColumn("__key", F.lit(1)).withColumn("row", F.lit(2))), ("none", none)):
        for t, df in (("documents", docs), ("labels", labels), ("benchmark", items)):
            df.write.parquet(f"{tmp_path}/{name}/{t}.parquet")
        for stage, f in corpus_pipeline.STAGES[:-1]:
            assert f(spark, docs, f"{tmp_path}/{name}").columns == docs.columns, stage
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert out.columns == [*[c for c in docs.columns if c != "shard_id"], "shard_id", "shard_bytes"]
        assert (out.count() > 0) == (name == "odd")
