"""Fisher's exact test on 2x2 tables, as an Arrow-batched function over one row a file."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: The probability of the table at hand counts as no less than this; ties are taken within this relative width.
FLOOR, TIE = 1e-200, 1e-8
#: Log probabilities below this add nothing to a double.
LOWEST = -745.0


def _log_probability(i: int, row: int, column: int, n: int) -> float:
    g = math.lgamma
    return g(row + 1) - g(i + 1) - g(row - i + 1) + g(n - row + 1) - g(column - i + 1) - g(n - row - column + i + 1) - g(n + 1) + g(column + 1) + g(n - column + 1)


def _walk(start: int, stop: int, row: int, column: int, n: int, log_p: float) -> np.ndarray:
    """Log probabilities from ``start`` (whose own is log_p) towards ``stop``, both included, until they vanish."""
    step = 1 if stop >= start else -1
    out = [np.array([log_p])]
    at = start
    while at != stop and out[-1][-1] > LOWEST:
        size = min(abs(stop - at), 65_536)
        i = at + step * np.arange(size, dtype=float)
        if step > 0:
            ratio = np.log(row - i) + np.log(column - i) - np.log(i + 1) - np.log(n - row - column + i + 1)
        else:
            ratio = np.log(i) + np.log(n - row - column + i) - np.log(row - i + 1) - np.log(column - i + 1)
        out.append(out[-1][-1] + np.cumsum(ratio))
        at += step * size
    return np.concatenate(out)


def fisher(n11: int, n12: int, n21: int, n22: int) -> tuple[float, float, float]:
    """(left, right, two-tailed) probabilities of a table with fixed margins.

    From either end of the support, outcomes are summed while they are no likelier than the table at hand, within the tie width;
    both sums make the two-tailed value. The tail whose sum ended nearer the table is its own; the other is one less that, plus
    the table's own probability. With a single outcome all three are 1.
    """
    row, column, n = n11 + n12, n11 + n21, n11 + n12 + n21 + n22
    low, high = max(0, row + column - n), min(row, column)
    if low == high:
        return 1.0, 1.0, 1.0
    own = max(math.exp(max(LOWEST, _log_probability(n11, row, column, n))), FLOOR)
    mode = min(high, max(low, (row + 1) * (column + 1) // (n + 2)))
    top = _log_probability(mode, row, column, n)
    down = _walk(mode, low, row, column, n, top)
    p = np.exp(np.concatenate([down[:0:-1], _walk(mode, high, row, column, n, top)]))
    first = mode - len(down) + 1  # the outcome of p[0]; beyond it nothing is left

    def tail(q: np.ndarray) -> tuple[float, int]:
        """(sum of what is less likely from the end on, and of what is as likely next to it; how many those are)."""
        reached = q >= own * (1 - TIE)
        k = int(np.argmax(reached)) if reached.any() else len(q)
        k += k < len(q) and q[k] < own * (1 + TIE)
        return float(q[:k].sum()), k

    (left, k), (right, m) = tail(p), tail(p[::-1])
    two = min(1.0, left + right)
    if abs(first + k - 1 - n11) < abs(first + len(p) - m - n11):
        return min(1.0, left), min(1.0, 1 - left + own), two
    return min(1.0, 1 - right + own), min(1.0, right), two


_TAILS = StructType([StructField(x, DoubleType()) for x in ("left", "right", "two")])


@F.pandas_udf(_TAILS)
def _tails(n11: pd.Series, n12: pd.Series, n21: pd.Series, n22: pd.Series) -> pd.DataFrame:
    rows = [fisher(*map(int, x)) for x in zip(n11, n12, n21, n22, strict=True)]
    return pd.DataFrame(rows, columns=["left", "right", "two"], dtype=float)


def fisher_tails(n11: Column, n12: Column, n21: Column, n22: Column) -> Column:
    """struct<left, right, two>. Tables are one a file, so this runs on aggregated rows alone."""
    return _tails(n11, n12, n21, n22)
