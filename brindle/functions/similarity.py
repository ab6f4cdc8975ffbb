"""String similarity that no built-in function offers."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def ratcliff(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp likeness of two strings, 0 to 1; null if either is null."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype=float)
