"""Code similarity by suffix alignment, for pairs that are candidates already.

The measure folds over two token sequences, which no built-in expresses; it runs
on Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def suffix_alignment(a: str, b: str) -> float:
    """The last cell of a local alignment (match 1, gaps and changes -1, never below 0), over the shorter length."""
    if not a or not b:
        return 0.0
    x, y = np.frombuffer(a.encode("utf-32-le"), np.uint32), np.frombuffer(b.encode("utf-32-le"), np.uint32)
    row = np.zeros(len(y) + 1, np.int64)
    step = np.arange(len(y) + 1)
    for c in x:
        best = np.maximum(row[:-1] + np.where(y == c, 1, -1), row[1:] - 1)
        new = np.concatenate([[0], np.maximum(best, 0)])
        # a gap in the other sequence costs 1 a step: a running maximum of value + position
        row = np.maximum.accumulate(new + step) - step
    return float(row[-1]) / min(len(x), len(y))


@pandas_udf(DoubleType())
def suffix_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([suffix_alignment(x, y) for x, y in zip(a, b, strict=True)])


@pandas_udf(DoubleType())
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio of the texts before the first underscore."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, (x or "").split("_")[0], (y or "").split("_")[0]).ratio() for x, y in zip(a, b, strict=True)])
