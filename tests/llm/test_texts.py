"""Operators that work text by text, against plain Python, libraries and held-out rows."""

import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import cws, decontaminate, quality, tokens, toxicity, warc
from tidemark.llm.common import table


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    return path, lambda s: len(Tokenizer.from_file(path).encode(s, add_special_tokens=False).ids)


def test_token_counts_are_the_library_s(spark, odd, none, tables, library):
    path, count = library
    for docs in (odd, table(spark, tables, "documents").limit(40)):
        texts = {r["doc_id"]: r["text"] or "" for r in docs.collect() if r["doc_id"] is not None}
        for r in tokens.token_counts(docs, path, 512).where("doc_id is not null").collect():
            s = texts[r["doc_id"]]
            assert r["n_tokens"] == count(s) and r["n_bytes"] == len(s.encode()) and r["over_limit"] == (r["n_tokens"] > 512)
            assert count(s[: r["fit_chars"]]) <= 512
    assert tokens.token_counts(odd, path, 512).count() == odd.count()
    assert tokens.token_counts(none, path, 512).count() == 0


def test_prefix_counts(spark, odd, none, library):
    path, count = library
    docs = odd.where("length(text) < 2000 or text is null").select("doc_id", "text")
    got = Counter((r["doc_id"], tuple(r["counts"])) for r in tokens.prefix_counts(docs, path).collect())
    assert got == Counter((r["doc_id"], tuple(count((r["text"] or "")[:i]) for i in range(len(r["text"] or "") + 1))) for r in docs.collect())
    assert tokens.prefix_counts(none, path).count() == 0


@pytest.mark.parametrize("text", ["", "a<|endoftext|>b  c", "don't 're x\n\n  y   ", "é" * 20 + "² 12３", "<|endof", "\x85\x1f a's  'll"])
def test_every_prefix(library, text):
    path, count = library
    assert tokens.opened(path).prefixes(text).tolist() == [count(text[:i]) for i in range(len(text) + 1)]


def test_warc_round_trip(spark):
    rows = [(1, "http://a", "same"), (2, "http://b\r\nx", "same"), (3, None, None), (4, "u", ""), (5, "u", "é\r\n\r\nWARC/1.1"), (5, "u", "é\r\n\r\nWARC/1.1"), (None, "u", "only")]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got if r["page_id"] not in (None,)) == [
        (1, 4, "revisit", 2), (2, 4, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None), (5, 14, "response", None), (5, 14, "response", None),
    ]
    assert all(r["payload_digest"] == warc.digest({1: b"same", 2: b"same", 3: b"", 4: b""}.get(r["page_id"], "é\r\n\r\nWARC/1.1".encode())) for r in got if r["page_id"])
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_of_odd_pages(spark):
    """A payload of some MB, empty lines in it, nulls, repeated rows, and columns named as those of the operator."""
    long = "".join(f"<p>{k}</p>\r\n\r\n" for k in range(300_000))
    rows = [(1, None, long), (2, "u", long), (3, "u", long + " "), (4, "", "\r\n\r\n"), (4, "", "\r\n\r\n"), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in ("id", "sha", "first", "body", "path", "record_type", "payload"):
        pages = pages.withColumn(c, warc.F.lit("x"))
    got = sorted(((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()), key=str)
    told = lambda i, t, kind="response", to=None: (i, len(t), warc.digest(t.encode()), kind, to)
    assert got == sorted([told(1, long, "revisit", 2), told(2, long), told(3, long + " "), told(4, "\r\n\r\n"), told(4, "\r\n\r\n"), told(0, "")], key=str)


@pytest.mark.parametrize("chunk", [1, 7, 100, 1 << 20])
def test_warc_reader_takes_any_chunk(chunk, monkeypatch):
    import io

    monkeypatch.setattr(warc, "CHUNK", chunk)
    payloads = [b"", b"\r\n\r\n", b"x" * 5000, bytes(range(256)) * 9, b"HTTP/1.1 200 OK\r\n\r\n"]
    data = b"".join(warc.encode_record(str(k), "u", p, warc.digest(p), None if k % 2 else str(k)) for k, p in enumerate(payloads))
    got = list(warc.read_records(io.BytesIO(data).read))
    assert [r.payload for r in got] == [p if k % 2 else b"" for k, p in enumerate(payloads)]
    assert [r.headers["WARC-Type"] for r in got] == ["revisit", "response"] * 2 + ["revisit"]


def test_warc_reader_refuses_damage():
    import gzip
    import io

    good = warc.encode_record("1", "u", b"payload", warc.digest(b"payload"), None)
    two = io.BytesIO(good + good)
    assert [r.payload for r in warc.read_records(two.read)] == [b"payload"] * 2
    plain = gzip.decompress(good)
    for bad in (good[:-9], gzip.compress(plain.replace(b"payload\r\n", b"payl0ad\r\n")), gzip.compress(plain.replace(b"payload\r\n", b"payloa\r\n"))):
        with pytest.raises((warc.WarcError, OSError)):
            list(warc.read_records(io.BytesIO(bad).read))


def _labelled(spark, sf, label):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return docs, labels, {r["doc_id"]: r[label] for r in labels.collect()}


def test_quality_on_held_out_rows(spark, odd, none):
    docs, labels, truth = _labelled(spark, "/root/testdata/sf0.01", "quality")
    model = quality.fit(docs, labels)
    got = quality.score_texts(docs, model).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([p == t for p, t in held]) > 0.9 and all(p for p, t in held if t)
    assert quality.score_texts(odd, model).count() == odd.count() and quality.score_texts(none, model).count() == 0
    kept = quality.keep_good(odd, model, 0.0)
    assert kept.columns == odd.columns and sorted(map(str, kept.collect())) == sorted(map(str, odd.collect()))
    assert quality.score_texts(odd, quality.fit(none, labels)).select("score").distinct().count() == 1


def test_toxicity_on_held_out_rows(spark, odd, none):
    docs, labels, truth = _labelled(spark, "/root/testdata/sf0.01", "toxic")
    lexicon = toxicity.fit(docs, labels)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in toxicity.score_texts(docs, lexicon).where("held_out").collect() if r["doc_id"] in truth]
    assert np.mean([p == t for p, t in held]) > 0.9
    assert toxicity.score_texts(odd, lexicon).count() == odd.count() and toxicity.score_texts(none, lexicon).count() == 0
    toxicity.score_texts(odd, toxicity.fit(none, labels)).collect()


def test_lexicon_matches():
    lexicon = toxicity.Lexicon({toxicity.fold("trash"): 2.0, toxicity.fold("scum"): 3.0, "moro*": 1.0})
    found = lambda s: [w for *_, w in lexicon.matches(s)]
    assert found("TRASH!") == [2.0] and found("tr4sh and sсum") == [2.0, 3.0] and found("ｓｃｕｍ") == [3.0] and found("morons") == [1.0]
    assert found("trash can") == [] and found("trashed scums untrash") == []


def jaccard(a, b):
    from collections import Counter

    a, b = (Counter(w for w in t.lower().split() if w) for t in (a, b))
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_fingerprints(spark, odd, none, tables):
    import hashlib

    docs = table(spark, tables, "documents")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    ids = sorted(texts, reverse=True)
    after = {a: texts[ids[(i + 1) % len(ids)]] for i, a in enumerate(ids)}
    error, seen = [], {}
    for r in cws.fingerprints(docs).collect():
        t, n = texts[r["doc_id"]], after[r["doc_id"]]
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        error += [r["near_edited"] - jaccard(t, edited), r["near_next"] - (jaccard(t, n) if t.split() or n.split() else 1.0)]
        assert seen.setdefault(t, r["fingerprint"]) == r["fingerprint"]
    assert abs(np.mean(error)) < 0.03 and np.mean(np.abs(error)) < 0.08
    assert cws.fingerprints(odd).count() == odd.count() and cws.fingerprints(none).count() == 0
    one = cws.fingerprints(odd.where("doc_id = 3")).first()
    assert one["near_next"] == 1.0


def test_fingerprints_of_skewed_weights(spark):
    """Words that stand a thousand times weigh as such: the mean over texts is the exact similarity, 0.96."""
    near = []
    for k in range(4):
        pair = [(i, " ".join([f"buy{k}"] * 1000 + [f"w{k}x{i}x{j}" for j in range(20)])) for i in range(2)]
        near += [r["near_next"] for r in cws.fingerprints(spark.createDataFrame(pair, "doc_id long, text string")).collect()]
        assert abs(jaccard(pair[0][1], pair[1][1]) - 1000 / 1040) < 1e-9
    assert abs(np.mean(near) - 1000 / 1040) < 0.1


def test_blocks_of_neighbours(spark, odd):
    rows = spark.range(500).selectExpr("id * 7 as doc_id", "concat('t ', id) as text")
    got = cws.neighbours(rows, 64).where("own").collect()
    assert len(got) == 500 and len({r["block"] for r in got}) > 10
    for r in got:
        k = (r["doc_id"] // 7 - 1) % 500
        assert r["next"] == f"t {k}"


def slow_align(a, b):
    best, h = 0.0, [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0.0, h[i - 1][j - 1] + (1.0 if x == y else -0.5), h[i - 1][j] - 0.5, h[i][j - 1] - 0.5)
            best = max(best, h[i][j])
    return best


def test_alignment_against_the_plain_recurrence():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = ([f"w{x}" for x in rng.integers(0, 5, rng.integers(0, 25))] for _ in range(2))
        assert abs(decontaminate.align(a, b)[0] - slow_align(a, b)) < 1e-9


def test_leaks_against_every_pair(spark, odd, none):
    rng = np.random.default_rng(9)
    word = lambda: f"v{rng.integers(0, 4000)}"
    items = [[word() for _ in range(rng.integers(18, 40))] for _ in range(12)] + [["short", "one"]]
    docs, want = [], set()
    for d in range(120):
        ws = [word() for _ in range(150)]
        if d % 3 == 0:
            k = d % len(items)
            copy = list(items[k])
            if d % 2:
                copy[len(copy) // 3] = "changed"
                del copy[2 * len(copy) // 3]
            ws[70:70] = copy
        docs.append((d, " ".join(ws)))
    for d, t in docs:
        for k, item in enumerate(items):
            if decontaminate.align(item, t.split())[0] / len(item) >= decontaminate.SCORE:
                want.add((d, k))
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(frame, bench).collect()}
    assert got == {(d, k) for d, k in want if k < 12 or "short one" in dict(docs)[d]} and len(got) >= 30
    left = {r["doc_id"] for r in decontaminate.clean(frame, bench).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in got}
    empty = bench.limit(0)
    assert decontaminate.leaks(odd, bench).count() == 0 and decontaminate.leaks(none, bench).count() == 0
    assert decontaminate.clean(odd, empty).columns == odd.columns and decontaminate.clean(odd, empty).count() == odd.count()


def test_many_rows_of_one_edited_copy_leak(spark):
    rng = np.random.default_rng(21)
    item = [f"t{i}" for i in range(37)]
    edited = [f"x{i}" if i % 7 == 6 else w for i, w in enumerate(item)]  # under half of the 5-word n-grams are whole
    assert decontaminate.align(item, edited)[0] / 37 > decontaminate.SCORE
    noise = lambda n: [f"v{x}" for x in rng.integers(0, 4000, n)]
    rows = [(d, " ".join(noise(60) + edited + noise(60))) for d in range(50)]
    rows += [(100 + d, " ".join(noise(60) + item[:5] + noise(60))) for d in range(50)]  # a turn of phrase alone is no copy
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {r["doc_id"] for r in got} == set(range(50))
    assert decontaminate.reachable(Counter(["a", "a", "b"]), ["a", "c", "a", "a"]) == 2
