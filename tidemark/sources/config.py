"""Region and model settings from a YAML list of single-key maps."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

REGIONS = (
    "region_id int, region string, n_stocks long, offset_s long, dst_offset_s long, dst_start date, weekdays array<int>, "
    "holidays array<date>, sessions array<struct<start_s: long, end_s: long>>"
)


@dataclass
class Config:
    regions: list[tuple]
    model: dict[str, list[float]]
    start: str | None = None
    end: str | None = None

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.regions, REGIONS)


def parse_date(text: str) -> dt.date:
    """Y-M-D or Y.M.D with one kind of separator; ValueError for anything else and for days that don't exist."""
    m = re.fullmatch(r"(\d{1,4})([-.])(\d{1,2})\2(\d{1,2})", text.strip())
    if not m:
        raise ValueError(f"not a date: {text!r}")
    return dt.date(int(m[1]), int(m[3]), int(m[4]))


def parse_time(text: str) -> int:
    """Seconds of HH:MM; 24:00 ends a day."""
    m = re.fullmatch(r"(\d{1,2}):(\d{2})", text.strip())
    if not m or int(m[1]) > 24 or int(m[2]) > 59 or int(m[1]) * 60 + int(m[2]) > 24 * 60:
        raise ValueError(f"not a time of day: {text!r}")
    return int(m[1]) * 3600 + int(m[2]) * 60


def _region(number: int, spec: dict) -> tuple:
    starts, ends = ([parse_time(t) for t in spec[k]] for k in ("LocalStartTimes", "LocalEndTimes"))
    sessions = list(zip(starts, ends, strict=True))
    flat = [t for s in sessions for t in s]
    if not sessions or flat != sorted(set(flat)):
        raise ValueError(f"{spec['name']}: sessions must be in order and not empty")
    weekdays = [int(d) for d in spec["TradeDayOfWeek"]]
    if any(not 0 <= d <= 6 for d in weekdays):
        raise ValueError(f"{spec['name']}: weekdays are 0 to 6")
    offset = int(float(spec["UTC2LocalOffsetHours"]) * 3600)
    dst = [parse_date(d) for d in spec.get("DSTRangeStart", [])]
    return (number, spec["name"], int(spec["NStocks"]), offset, int(float(spec.get("UTC2LocalDSTOffsetHours", spec["UTC2LocalOffsetHours"])) * 3600), dst[0] if dst else None, weekdays, [parse_date(d) for d in spec.get("Holidays", [])], sessions)


def parse_config(text: str) -> Config:
    """Regions in list order; model settings as number lists."""
    import yaml

    entries = [next(iter(e.items())) for e in yaml.load(text, Loader=yaml.BaseLoader)]
    regions = [_region(i, spec) for i, spec in enumerate(v for k, v in entries if k == "Region")]
    rest = {k: v for k, v in entries if k != "Region"}
    model = {k: [float(x) for x in (v if isinstance(v, list) else [v])] for k, v in rest.items() if not k.startswith("Default")}
    return Config(regions, model, rest.get("DefaultStartDate"), rest.get("DefaultEndDate"))
