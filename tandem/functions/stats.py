"""P-values without SciPy: exact Kendall and Student's t, as Arrow-batched functions over few rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Items up to which the counts of permutations are added up; beyond, their normal approximation is as good.
EXACT = 33


def kendall_exact_p(n: int, discordant: int) -> float:
    """Two-sided p of ``discordant`` inversions among n items without ties: from the counts of permutations, or for many items the normal approximation."""
    if n < 2:
        return float("nan")
    pairs = n * (n - 1) // 2
    low = min(discordant, pairs - discordant)
    if 2 * low == pairs:
        return 1.0
    if low < 2:  # one permutation has no inversion, n - 1 have one
        return min(1.0, 2 * math.exp(math.log(n if low else 1) - math.lgamma(n + 1)))
    if n > EXACT:
        return math.erfc((pairs - 2 * low) / math.sqrt(n * (n - 1) * (2 * n + 5) / 18) / math.sqrt(2))
    counts = [1]
    for size in range(2, n + 1):
        wide = [0] * (len(counts) + size - 1)
        for i, c in enumerate(counts):
            for j in range(size):
                wide[i + j] += c
        counts = wide
    return min(1.0, 2 * sum(counts[: low + 1]) / math.factorial(n))


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    out = d
    for m in range(1, 300):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + numerator * d or 1e-300)
            c = 1 + numerator / c or 1e-300
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def correlation_p(n: int, r: float) -> float:
    """Two-sided p of a correlation of n pairs by Student's t with n - 2 degrees of freedom."""
    if n < 3 or r != r:
        return float("nan")
    if abs(r) >= 1:
        return 0.0
    t2 = r * r * (n - 2) / (1 - r * r)
    return _beta((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


@F.pandas_udf(T.DoubleType())
def kendall_p(n: pd.Series, discordant: pd.Series) -> pd.Series:
    return pd.Series([kendall_exact_p(int(a), int(b)) for a, b in zip(n, discordant, strict=True)])


@F.pandas_udf(T.DoubleType())
def spearman_p(n: pd.Series, r: pd.Series) -> pd.Series:
    return pd.Series([correlation_p(int(a), b) for a, b in zip(n, r, strict=True)])
