"""Files in and out."""

import datetime as dt
import json

import numpy as np
import pytest

from tidemark.functions.text import shortest
from tidemark.operators import calendar as cal
from tidemark.operators import generate as gen
from tidemark.operators.calendar import calendar
from tidemark.sources import store, text, ticks
from tidemark.sources.config import parse_config, parse_date, parse_time
from tidemark.streaming.latest import streaming_blocks

CONFIG = """
- Region:
  - {
      name: One, id: 0, localTimezone: X, UTC2LocalOffsetHours: -5, UTC2LocalDSTOffsetHours: -4,
      LocalStartTimes: [ 09:30 ], LocalEndTimes: [ 09:35 ], NStocks: 3, TradeDayOfWeek: [1, 2, 3, 4, 5],
      DSTRangeStart: [2025.03.09], Holidays: [2025.01.09],
    }
- DefaultStartDate: 2025-01-02
- TradeSecondDropProbabilityPct: 0.5
- StartPriceUniform: [10, 500]
- AnnualVolatilityUniformPct: [15, 60]
- BaseVolumeUniform: [50, 2000]
- RegionIsRevertorProbabilityPct: 30
- HalfLifeSecsUniform: [300, 1200]
- OULongRunStdUniformPct: [0.05, 0.15]
"""


def config():
    return parse_config(CONFIG.replace("  - {", "    {"))


def put(folder, day, i, times):
    (folder / day).mkdir(parents=True, exist_ok=True)
    (folder / day / f"{i:04d}.bin").write_bytes(np.array([(t, t * 0.5, t % 9) for t in times], ticks.RECORD).tobytes())


DAY = 86_400 * 10**9


def test_raw_files(spark, tmp_path):
    """Written, read back in file order, with empty files, and with files of other names beside them."""
    rows = [(i, d * DAY + k * 10**9, float(k + i), k) for i in (0, 6) for d in (100, 101) for k in range(3 + i)]
    df = spark.createDataFrame(rows, "instrument_id long, ts_ns long, price float, volume int")
    at = f"file://{tmp_path}/raw"
    ids, days = spark.createDataFrame([(0,), (2,), (6,)], "instrument_id long"), spark.createDataFrame([(dt.date(1970, 4, 11),), (dt.date(1970, 4, 13),)], "trade_date date")
    assert ticks.write_raw(df, at, ids, days) == 4 + 4  # four with ticks; two on the day of 2, three on the day without
    assert sorted(p.name for p in (tmp_path / "raw").iterdir()) == ["19700411", "19700412", "19700413"]
    assert (tmp_path / "raw/19700413/0002.bin").stat().st_size == 0
    (tmp_path / "raw/19700411/00001.bin").write_bytes(b"odd")
    (tmp_path / "raw/19700411/notes.txt").write_bytes(b"odd")
    got = ticks.read_raw(spark, at)
    assert sorted(tuple(r)[:4] for r in got.collect()) == sorted(rows)
    assert [r["ts_ns"] for r in got.where("instrument_id = 6").orderBy("seq").collect()] == sorted(t for i, t, *_ in rows if i == 6)
    (tmp_path / "torn/20240506").mkdir(parents=True)
    (tmp_path / "torn/20240506/0003.bin").write_bytes(bytes(37))
    with pytest.raises(ticks.BadInput, match="0003"):
        ticks.read_raw(spark, str(tmp_path / "torn"))


def test_store(spark, tmp_path):
    rows = [(i, d * DAY + k * 10**9, float(np.float32(1 + k % 7 + i)), k) for i in (1, 4) for d in (200, 201) for k in range(40)]
    df = spark.createDataFrame(rows, "instrument_id long, ts_ns long, price float, volume int").withColumn("seq", text.F.col("ts_ns"))
    at = f"{tmp_path}/store"
    with pytest.raises(ticks.BadInput):
        store.open_store(spark, at)
    c = config()
    ids, open_ = cal.instruments(c.frame(spark)), calendar(c.frame(spark), "1970-07-20", "1970-07-21")
    store.ingest(df, at, ids, open_, 16)
    s = store.open_store(spark, at)
    assert s.stride == 16 and store.verify(df, s.ticks).count() == 0 and store.verify_blocks(s.ticks, s.blocks, 16).count() == 0
    assert sorted(r["volume"] for r in s.records(4, 9).collect()) == sorted(r[3] for r in rows if r[0] == 4)
    assert [(r["pos"], r["ts_ns"]) for r in s.between(4, 30, 50).orderBy("pos").collect()] == [(k, r[1]) for k, r in enumerate([r for r in rows if r[0] == 4])][30:50]
    assert s.between(4, 500, 600).count() == 0 == s.between(3, 0, 5).count()
    wanted = spark.createDataFrame([(1,), (2,), (4,), (-1,)], "instrument_id long")
    assert sorted(map(tuple, s.look_up(wanted).collect())) == [(-1, 0, -1, None), (1, 80, 0, "One"), (2, 0, 0, "One"), (4, 80, -1, None)]
    assert s.footprint()["points"] == 160 and s.footprint()["bytes_per_point"] > 0 and s.warm() == 10 + 3

    # a second ingest that fails after its ticks are written leaves the first to be read
    whole = store.block_index
    store.block_index = lambda *_: 1 / 0
    try:
        with pytest.raises(ZeroDivisionError):
            store.ingest(df.limit(1), at, stride=16)
    finally:
        store.block_index = whole
    assert store.open_store(spark, at).ticks.count() == 160 and store.open_store(spark, at).segments is not None
    # one that ends well replaces it, without the old one's segments; readers of the old version go on
    store.ingest(df.where("instrument_id = 1"), at, stride=8)
    new = store.open_store(spark, at)
    assert new.stride == 8 and new.ticks.count() == 80 and new.segments is None and s.ticks.count() == 160
    assert sorted(map(tuple, new.look_up(wanted).collect()))[1] == (1, 80, -1, None)

    with pytest.raises(ticks.BadInput, match="strictly"):
        store.ingest(df.unionByName(df.where("volume = 3").withColumn("seq", text.F.col("seq") + 1)), f"{tmp_path}/none")
    with pytest.raises(ticks.BadInput):
        store.open_store(spark, f"{tmp_path}/none")
    with pytest.raises(ticks.BadInput):
        store.ingest(df, f"{tmp_path}/none", stride=0)
    new.blocks.drop("n").write.parquet(f"{tmp_path}/odd")
    version = new.path
    import shutil

    shutil.rmtree(f"{version}/blocks")
    with pytest.raises(ticks.BadInput, match="isn't whole"):
        store.open_store(spark, at)
    shutil.move(f"{tmp_path}/odd", f"{version}/blocks")
    with pytest.raises(ticks.BadInput, match="columns"):
        store.open_store(spark, at)


def test_days_out_of_order(spark, tmp_path):
    put(tmp_path / "raw", "20240506", 2, [4, 9, 17])
    put(tmp_path / "raw", "20240507", 2, [17, 21])
    with pytest.raises(ticks.BadInput, match="instrument 2: 17"):
        store.ingest(ticks.read_raw(spark, str(tmp_path / "raw")), str(tmp_path / "none"))


def test_text_inputs(spark, tmp_path):
    (tmp_path / "p.csv").write_text("id,i,s,q,a,z\r\nk7,3,1,5,-10,20\r\n\r\n  m,12,-1,6,30,9223372036854775807 \n")
    got = text.read_positions(spark, str(tmp_path / "p.csv")).orderBy("ordinal").collect()
    assert [tuple(r) for r in got] == [(1, "k7", 3, 1, 5, -10, 20), (3, "m", 12, -1, 6, 30, 9223372036854775807)]
    (tmp_path / "n.csv").write_text("7,3,1,5,1,2\n8,3,1,5,1,2\n")  # no header
    assert text.read_positions(spark, str(tmp_path / "n.csv")).count() == 2
    for bad in ("a,3,1,5,1,x", "a,3,99999999999,5,1,2", "a,3,1,5,1,92233720368547758080", "a,3,1,5,1", "a,3,1,5,1,2,3", "a,3, 1,5,1,2"):
        (tmp_path / "bad.csv").write_text(f"h,h,h,h,h,h\n1,3,1,5,1,2\n\n{bad}\n{bad}\n")
        with pytest.raises(ticks.BadInput, match="line 4"):
            text.read_positions(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "t.txt").write_text(" 5\r\n\n-7\n5\n")
    assert [r["t_ns"] for r in text.read_instants(spark, str(tmp_path / "t.txt")).orderBy("ordinal").collect()] == [5, -7, 5]
    (tmp_path / "t2.txt").write_text("5\n99999999999999999999\n")
    with pytest.raises(ticks.BadInput, match="line 2"):
        text.read_instants(spark, str(tmp_path / "t2.txt"))
    flags = spark.createDataFrame([(8, 1), (2, 1), (5, 0), (40, 1)], "instrument_id long, is_reverter int")
    text.write_reverters(flags, f"{tmp_path}/r.txt")
    assert (tmp_path / "r.txt").read_text() == "2\n8\n40\n"
    assert sorted(r[0] for r in text.read_reverters(spark, str(tmp_path / "r.txt"), 10).collect()) == [2, 8]
    (tmp_path / "r2.txt").write_text("4\n-4\n")
    with pytest.raises(ticks.BadInput, match="line 2"):
        text.read_reverters(spark, str(tmp_path / "r2.txt"), 10)


def test_lines_are_numbered_across_parts(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        (tmp_path / "many.txt").write_text("".join(f"{k * 3}\n" for k in range(700)))
        df = text.read_instants(spark, str(tmp_path / "many.txt"))
        assert sorted(map(tuple, df.collect())) == [(k, k * 3) for k in range(700)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b", 1, None, None, None, None, None, None), (0, "a", 0, 11, 25, 250.0, 0.3, 1e5, 2.5)], "ordinal long, trade_id string, status int, entry_ts_ns long, exit_ts_ns long, entry_price float, exit_price float, pnl double, max_adverse_excursion double")
    text.write_priced(rows, str(tmp_path / "o.csv"))
    assert (tmp_path / "o.csv").read_text().splitlines() == [",".join(text.PRICED), "a,0,11,25,250,0.3,1e+05,2.5", "b,1,,,,,,"]
    trades = spark.createDataFrame([(5, -1, 3, 40, 60, 2.0, 1.5, 1.5), (2, 1, 1, 90, 95, 1.0, 1.25, 0.25), (5, 1, 4, 10, 30, 2.0, 2.5, 2.0)], "instrument_id long, side int, quantity long, entry_ts_ns long, exit_ts_ns long, entry_price float, exit_price float, pnl double")
    text.write_trades(trades, f"file://{tmp_path}/t.csv")
    assert [x.split(",")[:4] for x in (tmp_path / "t.csv").read_text().splitlines()[1:]] == [["2", "1", "1", "90"], ["5", "1", "4", "10"], ["5", "-1", "3", "40"]]
    groups = spark.createDataFrame([(1, "R1", 0, 0, 0.0, None), (0, "R0", 1, 4, 12.5, 1.25)], "region_id int, region string, reverter_flag int, trade_count long, total_pnl double, sharpe double")
    text.write_summary(groups, str(tmp_path / "s.csv"), str(tmp_path / "s.json"))
    assert (tmp_path / "s.csv").read_text().splitlines() == [",".join(text.SUMMARY), "R0,1,4,12.5,1.25", "R1,0,0,0,nan"]
    assert json.loads((tmp_path / "s.json").read_text())[1] == {"region": "R1", "reverter_flag": 0, "trade_count": 0, "total_pnl": 0.0, "sharpe": None}
    grid = spark.createDataFrame([(0, 0, 1.5), (0, 1, None), (0, 7, 2.0), (1, 0, 2.5)], "ordinal long, instrument_id long, price float")
    text.write_matrix(grid, str(tmp_path / "m.bin"), 2)
    assert np.array_equal(np.fromfile(tmp_path / "m.bin", "<f4").reshape(2, 2), np.array([[1.5, np.nan], [2.5, np.nan]], "<f4"), equal_nan=True)
    assert sorted(map(tuple, text.read_matrix(spark, str(tmp_path / "m.bin"), 2).collect())) == [(0, 0, 1.5), (1, 0, 2.5)]
    with pytest.raises(ticks.BadInput):
        text.read_matrix(spark, str(tmp_path / "m.bin"), 3)
    with text.RunLog(str(tmp_path / "runs.jsonl"), "trades", {"in": "x", "runlog": "y", "mae": "scan"}) as log:
        log.told["rows"] = 3
    with open(tmp_path / "runs.jsonl", "a") as f:
        f.write("\nnot json\n")
    got = text.read_runs(spark, str(tmp_path / "runs.jsonl")).withColumn("shown", text.shown_params(text.F.col("params"))).collect()
    assert len(got) == 1 and got[0]["params"] == {"in": "x", "mae": "scan"} and got[0]["shown"] == {"mae": "scan"}


def test_numbers_and_dates():
    assert [shortest(x) for x in (100.0, 1e5, 0.1, -2.5, 123456.0, float("nan"))] == ["100", "1e+05", "0.1", "-2.5", "123456", "nan"]
    assert parse_date("2025.01.03") == dt.date(2025, 1, 3) == parse_date("2025-01-03")
    for bad in ("2025-01.03", "2025-02-30", "x"):
        with pytest.raises(ValueError):
            parse_date(bad)
    assert parse_time("09:30") == 34_200 and parse_time("24:00") == 86_400
    with pytest.raises(ValueError):
        parse_time("25:00")


def test_generator(spark):
    c = config()
    regions = c.frame(spark)
    make = lambda seed: sorted(map(tuple, gen.generate(spark, regions, c.model, "2025-01-02", "2025-01-10", seed).collect()))
    a = make(1)
    assert a == make(1) and a != make(2)
    open_ = calendar(regions, "2025-01-02", "2025-01-10").collect()
    assert len(open_) == 6
    seconds = sum((r["end_ns"] - r["start_ns"]) // 10**9 for r in open_) * 3
    assert 0.97 * seconds < len(a) <= seconds
    assert all(any(r["start_ns"] <= t < r["end_ns"] for r in open_) and p > 0 and v >= 1 for _, t, p, v in a[::50])
    assert gen.generate(spark, regions, c.model, "2025-01-02", "2025-01-02", 1, limit=1).select("instrument_id").distinct().count() == 1


def test_generated_inputs(spark):
    regions = config().frame(spark)
    open_, ids = calendar(regions, "2025-01-02", "2025-01-10").cache(), cal.instruments(regions)
    make = lambda seed: sorted(map(tuple, gen.positions(spark, 2000, open_, ids, seed).collect()))
    rows = make(1)
    assert rows == make(1) != make(2) and len({r[0] for r in rows}) == 2000 and {r[1] for r in rows} == {0, 1, 2} and {r[2] for r in rows} == {1, -1}
    spans = [(r["start_ns"], r["end_ns"]) for r in open_.collect()]
    inside = sum(any(a <= r[4] < z for a, z in spans) for r in rows) / 2000
    assert 0.8 < inside < 0.9
    holds = sorted((r[5] - r[4]) / 10**9 for r in rows)
    assert 1 <= holds[0] and holds[-1] <= 5 * 86_400 and 300 < holds[1000] < 1500  # log-uniform: the median is the root of the ends' product
    assert all(1 <= r[3] <= 1000 for r in rows)
    at = [tuple(r) for r in gen.instants(spark, 400, 50, 1000, 3).orderBy("ordinal").collect()]
    assert [k for k, _ in at] == list(range(400)) and all(50 <= t < 1000 for _, t in at) and len({t for _, t in at}) > 250


def test_streaming_form_on_a_batch(spark):
    df = spark.createDataFrame([(0, 10**9, 5.0), (0, 2 * 10**9, 4.0), (0, 61 * 10**9, 7.0)], "instrument_id long, ts_ns long, price float")
    got = sorted((r["n"], r["min_price"], r["last_price"]) for r in streaming_blocks(df).collect())
    assert got == [(1, 7.0, 7.0), (2, 4.0, 4.0)]
