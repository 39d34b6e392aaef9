"""As-of lookups, range extrema and checks of a series: hand-made cases, hot instruments, and linear scans."""

import bisect
import random

import pytest

from tidemark.operators.asof import BACKWARD, FORWARD, as_of, as_of_both, in_interval
from tidemark.operators.extrema import block_index, by_buckets, by_scan, numbered
from tidemark.operators.rolling import not_increasing

#: Instrument 4 has ticks at 7, 19, 64; instrument 9 one at 23.
TICKS = [(4, 7, 1.25, 3), (4, 19, 2.5, 1), (4, 64, 0.75, 8), (9, 23, 6.5, 2)]
SCHEMA = "instrument_id long, ts_ns long, price float, volume int"


@pytest.fixture
def ticks(spark):
    return spark.createDataFrame(TICKS, SCHEMA)


@pytest.mark.parametrize("bucket", [5, 16, 1000])
@pytest.mark.parametrize("direction", [BACKWARD, FORWARD])
def test_every_instant(spark, ticks, direction, bucket):
    """All instants around the ticks, both ends and ties among them."""
    times = [t for i, t, *_ in TICKS if i == 4]
    probes = spark.createDataFrame([(4, t) for t in range(-3, 70)], "instrument_id long, at long")
    got = {r["at"]: r["ts_ns"] for r in as_of(probes, ticks, "at", direction, bucket_ns=bucket).collect()}
    for t in range(-3, 70):
        k = bisect.bisect_right(times, t) - 1 if direction == BACKWARD else bisect.bisect_left(times, t)
        assert got[t] == (times[k] if 0 <= k < len(times) else None)


def test_probes_that_match_nothing(spark, ticks):
    probes = spark.createDataFrame([(9, 22, "a"), (9, 23, "b"), (5, 30, "c"), (4, None, "d"), (None, 30, "e"), (None, None, "f")], "instrument_id long, at long, __b string")
    back = {r["__b"]: (r["price"], r["instrument_id"]) for r in as_of(probes, ticks.union(spark.createDataFrame([(None, 1, 9.0, 1), (4, None, 9.0, 1)], SCHEMA)), "at").collect()}
    assert back == {"a": (None, 9), "b": (6.5, 9), "c": (None, 5), "d": (None, 4), "e": (None, None), "f": (None, None)}
    assert as_of(probes.limit(0), ticks, "at").count() == 0 and as_of(probes, ticks.limit(0), "at").where("price is null").count() == 6


def test_both_directions_at_once(spark):
    """Nine tenths of all rows belong to one instrument."""
    rng = random.Random(3)
    rows = [(1 if rng.random() < 0.9 else 2, t, float(t % 17), 1) for t in sorted(rng.sample(range(5000), 900))]
    asked = [(k, 1 if rng.random() < 0.9 else 3, rng.randrange(-50, 5100), rng.randrange(-50, 5100)) for k in range(300)] + [(900, 1, None, 5)]
    ticks, probes = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(asked, "k long, instrument_id long, a long, z long")
    got = {r["k"]: r for r in as_of_both(probes, ticks, "k", "a", "z", bucket_ns=64).collect()}
    assert len(got) == 301
    for k, i, a, z in asked:
        own = [t for j, t, *_ in rows if j == i]
        first = next((t for t in own if a is not None and t >= a), None)
        last = next((t for t in reversed(own) if t <= z), None)
        assert (got[k]["entry_ts_ns"], got[k]["exit_ts_ns"]) == (first, last)


def test_intervals(spark):
    cuts = spark.createDataFrame([(1, 10, 20, "x"), (1, 20, 25, "y"), (1, 40, 50, "z")], "instrument_id long, start_ns long, end_ns long, name string")
    probes = spark.createDataFrame([(1, t) for t in (9, 10, 19, 20, 25, 39, 40, 49, 50)] + [(2, 15)], "instrument_id long, at long")
    got = {(r[0], r["at"]): r["name"] for r in in_interval(probes, cuts, "at", ("name",), 16).collect()}
    assert [got[1, t] for t in (9, 10, 19, 20, 25, 39, 40, 49, 50)] == [None, "x", "x", "y", None, None, "z", "z", None] and got[2, 15] is None


def test_places_and_blocks(spark):
    rng = random.Random(11)
    rows = [(i, t, rng.uniform(1, 9), 1) for i in range(3) for t in sorted(rng.sample(range(2000), 230))]
    df = spark.createDataFrame(rows, SCHEMA)
    for bucket in (37, 10_000):
        assert sorted((r["instrument_id"], r["pos"], r["ts_ns"]) for r in numbered(df, 16, bucket).collect()) == [(i, k, t) for i in range(3) for k, t in enumerate(t for j, t, *_ in rows if j == i)]
    got = {(r["instrument_id"], r["block_no"]): (r["first_ts"], r["n"]) for r in block_index(df, 100).collect()}
    assert got == {(i, b): ([t for j, t, *_ in rows if j == i][100 * b], (100, 100, 30)[b]) for i in range(3) for b in range(3)}


@pytest.mark.parametrize("factors", [(), (2,), (3, 4), (24, 32)])
def test_range_extrema_against_a_scan(spark, factors):
    rng = random.Random(7)
    rows = [(i, t, rng.uniform(1, 9)) for i in range(3) for t in sorted(rng.sample(range(-3000, 3000), 200))]
    spans = [(k, rng.randrange(4), a := rng.randrange(-3050, 3000), a + rng.randrange(1 << rng.randrange(12))) for k in range(200)]
    ticks = spark.createDataFrame(rows, "instrument_id long, ts_ns long, price double")
    ranges = spark.createDataFrame(spans, "range_id long, instrument_id long, from_ns long, to_ns long")
    want = {}
    for k, i, a, z in spans:
        inside = [p for j, t, p in rows if j == i and a <= t <= z]
        if inside:
            want[k] = (min(inside), max(inside))
    for got in (by_buckets(ranges, ticks, 8, factors), by_scan(ranges, ticks, 64)):
        assert {r["range_id"]: (r["lo"], r["hi"]) for r in got.collect()} == want


def test_not_increasing(spark):
    rows = [(0, 10, 1), (0, 20, 2), (0, 20, 3), (0, 30, 4), (0, 29, 7), (0, 31, 9), (1, 5, 5)]
    df = spark.createDataFrame(rows, "instrument_id long, ts_ns long, seq long")
    for part in (1, 3, 100):
        assert sorted((r["ts_ns"], r["seq"], r["before_ns"]) for r in not_increasing(df, part).collect()) == [(20, 3, 20), (29, 7, 30)]
