"""Numbers as text, shortest first: what exact exports of prices and profits print."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def shortest(x: float, single: bool = False) -> str:
    """The shortest digits that read back as x, in fixed or scientific form, whichever is shorter; fixed if equal."""
    if math.isnan(x):
        return "nan"
    if math.isinf(x):
        return "-inf" if x < 0 else "inf"
    kind = np.float32 if single else np.float64
    fixed = np.format_float_positional(kind(x), trim="-")
    science = np.format_float_scientific(kind(x), trim="-", exp_digits=2)
    return fixed if len(fixed) <= len(science) else science


def number_text(column: Column, single: bool = False) -> Column:
    """Text of a number column for an exact export; null stays null. Exports only: it leaves the JVM."""

    @F.pandas_udf("string")
    def told(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None or pd.isna(x) and not isinstance(x, float) else shortest(float(x), single))

    return F.when(column.isNotNull(), told(column))
