"""Tail probabilities of already aggregated test statistics.

The statistics themselves are sums over ranks or cross-products and are built
with Spark aggregates. What is left is a distribution tail of a few scalars per
test, for which Spark has no function; these are vectorised UDFs over the
aggregated rows, never over the data.

Sources: Mann & Whitney 1947; Wilcoxon 1945; Fisher 1935; Lentz continued
fraction for the incomplete beta function.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The published rule of the method "auto" takes the exact distribution
# up to these sizes (of the smaller group; of the pairs), without ties or zeros.
EXACT_RANK_SUM_SMALLER = 8
EXACT_SIGNED_RANK = 50
#: Values of U above which "auto" does not write out the exact distribution.
EXACT_VALUES = 20_000_000
#: Frequencies times items up to which the exact rank-sum tail takes the whole grid.
FULL_GRID = 20_000_000
METHODS = ("auto", "exact", "asymptotic")


def rank_sum_exact(n1: Column, n2: Column, tie_term: Column, method: str) -> Column:
    """Whether a rank-sum test uses the exact distribution."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if method != "auto":
        return F.lit(method == "exact")
    small = F.least(n1, n2) <= EXACT_RANK_SUM_SMALLER
    return F.coalesce(small & (tie_term == 0) & (n1 * n2 <= EXACT_VALUES), F.lit(False))


def signed_rank_exact(n: Column, tie_term: Column, zeros: Column, method: str) -> Column:
    """Whether a signed-rank test uses the exact distribution."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if method != "auto":
        return F.lit(method == "exact")
    return F.coalesce((n <= EXACT_SIGNED_RANK) & (tie_term == 0) & (zeros == 0), F.lit(False))


def normal_upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def rank_sum_counts(m: int, n: int) -> np.ndarray:
    """Number of orderings of m and n items for every value of U, as shares."""
    shares = np.zeros(m * n + 1)
    shares[0] = 1.0
    # Gaussian binomial coefficient: multiply by (1-x^(n+i)), divide by (1-x^i).
    for i in range(1, m + 1):
        up = n + i
        if up < len(shares):
            shares[up:] = shares[up:] - shares[: len(shares) - up].copy()
        rows = -(-len(shares) // i)
        padded = np.concatenate([shares, np.zeros(rows * i - len(shares))])
        shares = padded.reshape(rows, i).cumsum(axis=0).ravel()[: len(shares)]
    return shares / shares.sum()


def rank_sum_upper(m: int, n: int, k: int) -> float:
    """P(U >= k) of m against n items without ties.

    Counts are written out while they are whole numbers that a double holds, or one side is small. Beyond, the
    generating function is inverted on a grid of frequencies, tilted so that U has its mean at k: work grows with m,
    not with the m * n values of U, and the error is about 1e-12 of the result.
    """
    m, n = min(m, n), max(m, n)
    if k <= 0 or k > m * n:
        return float(k <= 0)
    if m <= EXACT_RANK_SUM_SMALLER or math.lgamma(m + n + 1) - math.lgamma(m + 1) - math.lgamma(n + 1) < 53 * math.log(2):
        return float(rank_sum_counts(m, n)[k:].sum())
    if 2 * k <= m * n:
        return 1.0 - rank_sum_upper(m, n, m * n - k + 1)
    i = np.arange(1.0, m + 1)

    def moments(theta: float) -> tuple[float, float]:
        a, b = (n + i) / 2, i / 2
        with np.errstate(over="ignore"):
            mean = m * n / 2 + float((a / np.tanh(a * theta) - b / np.tanh(b * theta)).sum())
            var = float(((b / np.sinh(b * theta)) ** 2 - (a / np.sinh(a * theta)) ** 2).sum())
        return mean, math.sqrt(max(var, 0.0))

    theta = math.sqrt(12.0 / (m * n * (m + n + 1.0)))
    if moments(theta)[0] < k:
        low, high = theta, 40.0
        for _ in range(100):
            theta = (low + high) / 2
            low, high = (theta, high) if moments(theta)[0] < k else (low, theta)
    spread = moments(theta)[1]
    size = 2 * math.ceil((45 / theta + 12 * spread) / 2) + 1
    reach = max(12 / max(spread, 1e-3), (2 / n + 2 * theta) * 10 ** (18 / m))
    # Beyond the reach nothing is left, but for peaks at other roots of unity where both sides are small: then all are taken.
    last = size // 2 if size * m <= FULL_GRID else min(size // 2, math.ceil(reach * size / (2 * math.pi)))
    base = np.log(np.expm1(-(n + i) * theta) / np.expm1(-i * theta))
    total = 0.0
    step = max(1, (1 << 20) // m)
    for start in range(0, last + 1, step):
        at = np.arange(start, min(start + step, last + 1))
        s = theta + 2j * math.pi * at / size
        shares = np.log(np.expm1(-np.outer(s, n + i)) / np.expm1(-np.outer(s, i))) - base
        # Turns by whole multiples of the grid are taken off before the sine, so that a large k costs no digits.
        turn = np.exp(2j * math.pi * ((at * ((m * n - k) % size)) % size) / size)
        terms = (np.exp(shares.sum(axis=1)) * turn / -np.expm1(-s)).real
        total += float(terms.sum() * 2 - (terms[0] if start == 0 else 0.0))
    scale = float((base + np.log(i / (n + i))).sum()) + (m * n - k) * theta
    return min(1.0, max(0.0, math.exp(scale) * total / size))


def signed_rank_counts(n: int) -> np.ndarray:
    """Share of sign patterns for every value of the positive rank sum."""
    shares = np.zeros(n * (n + 1) // 2 + 1)
    shares[0] = 1.0
    for i in range(1, n + 1):
        moved = np.zeros_like(shares)
        moved[i:] = shares[: len(shares) - i]
        shares = (shares + moved) / 2.0
    return shares


def _sided(above: float, below: float, side: str) -> float:
    if side == "greater":
        return min(1.0, above)
    if side == "less":
        return min(1.0, below)
    return min(1.0, 2.0 * min(above, below))


def rank_sum_p(u: float, n1: float, n2: float, tie_term: float, side: str, exact: bool) -> float | None:
    """p-value of U of the first sample; ``tie_term`` is the sum of t^3 - t."""
    if not (n1 > 0 and n2 > 0) or u is None or math.isnan(u):
        return None
    n1, n2 = int(n1), int(n2)
    small, large = min(n1, n2), max(n1, n2)
    if exact:
        k = int(u)
        above = 1.0 if side == "less" else rank_sum_upper(small, large, k)
        below = 1.0 if side == "greater" else rank_sum_upper(small, large, small * large - k)
        return _sided(above, below, side)
    n = n1 + n2
    var = n1 * n2 / 12.0 * ((n + 1) - tie_term / (n * (n - 1.0)))
    if var <= 0:
        return None if side != "two-sided" else 1.0
    mean, sd = n1 * n2 / 2.0, math.sqrt(var)
    above = normal_upper((u - mean - 0.5) / sd)
    below = normal_upper((mean - u - 0.5) / sd)
    return _sided(above, below, side)


def signed_rank_p(w: float, n: float, tie_term: float, side: str, exact: bool) -> float | None:
    """p-value of the positive rank sum of n non-zero differences."""
    if not n or n < 1 or w is None or math.isnan(w):
        return None
    n = int(n)
    if exact:
        shares = signed_rank_counts(n)
        k = int(w)
        return _sided(float(shares[k:].sum()), float(shares[: k + 1].sum()), side)
    var = n * (n + 1) * (2 * n + 1) / 24.0 - tie_term / 48.0
    if var <= 0:
        return None
    z = (w - n * (n + 1) / 4.0) / math.sqrt(var)
    return _sided(normal_upper(z), normal_upper(-z), side)


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1.0 + even * d
        c = 1.0 + even / c
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = c if abs(c) > tiny else tiny
        h *= d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + odd * d
        c = 1.0 + odd / c
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = c if abs(c) > tiny else tiny
        step = d * c
        h *= step
        if abs(step - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def student_p(t: float, dof: float) -> float | None:
    """Two-sided p-value of a t statistic."""
    if t is None or math.isnan(t) or not dof > 0:
        return None
    if math.isinf(t):
        return 0.0
    return incomplete_beta(dof / 2.0, 0.5, dof / (dof + t * t))


def _stirling_error(n: float) -> float:
    """ln n! minus Stirling's formula for it."""
    if n < 16:
        return math.lgamma(n + 1.0) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n > 0 else 0.0
    m = n * n
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * m)) / m) / m) / n


def _deviance(x: float, mean: float) -> float:
    """x ln(x / mean) + mean - x without cancellation near the mean."""
    if abs(x - mean) < 0.1 * (x + mean):
        v = (x - mean) / (x + mean)
        total, term, j = (x - mean) * v, 2 * x * v, 1
        while True:
            term *= v * v
            following = total + term / (2 * j + 1)
            if following == total:
                return total
            total, j = following, j + 1
    return x * math.log(x / mean) + mean - x


def log_binomial(x: float, n: float, p: float) -> float:
    """ln of the binomial probability, by Loader's saddle-point expansion."""
    q = 1.0 - p
    if x == 0:
        return n * math.log1p(-p)
    if x == n:
        return n * math.log(p)
    body = _stirling_error(n) - _stirling_error(x) - _stirling_error(n - x) - _deviance(x, n * p) - _deviance(n - x, n * q)
    return body + 0.5 * math.log(n / (2 * math.pi * x * (n - x)))


def log_hypergeometric(k: float, row: float, column: float, n: float) -> float:
    """ln of the probability of k common items of row and column among n."""
    p = column / n
    return log_binomial(k, row, p) + log_binomial(column - k, n - row, p) - log_binomial(column, n, p)


def _outward(a: float, step: int, end: float, row: float, column: float, n: float) -> float:
    """Sum of the probabilities from a to the end, relative to that of a, until terms no longer count."""
    total, last, k = 1.0, 1.0, a
    while k != end:
        count = min(4096.0, abs(end - k))
        here = k + step * np.arange(count)
        if step > 0:
            ratio = (row - here) * (column - here) / ((here + 1) * (n - row - column + here + 1))
        else:
            ratio = here * (n - row - column + here) / ((row - here + 1) * (column - here + 1))
        terms = last * np.cumprod(ratio)
        total += float(terms.sum())
        last, k = float(terms[-1]), k + step * count
        if last <= total * 1e-18 and (ratio[-1] < 1.0):
            break
    return total


def fisher_p(a: float, b: float, c: float, d: float, side: str) -> float | None:
    """Fisher's exact test of the table [[a, b], [c, d]].

    A tail is summed from the observed cell outwards, away from the mean, so it is
    right however small it is; the other tail is its complement.
    """
    if any(v is None or math.isnan(v) for v in (a, b, c, d)):
        return None
    row, column, n = a + b, a + c, a + b + c + d
    if n == 0 or row == 0 or column == 0 or row == n or column == n:
        return 1.0
    low, high = max(0.0, row + column - n), min(row, column)
    mode = math.floor((row + 1) * (column + 1) / (n + 2))
    own = log_hypergeometric(a, row, column, n)

    def tail(k: float, step: int) -> float:
        if k < low or k > high:
            return 0.0
        return math.exp(log_hypergeometric(k, row, column, n)) * _outward(k, step, high if step > 0 else low, row, column, n)

    if side == "greater":
        return min(1.0, tail(a, 1)) if a >= mode else max(0.0, 1.0 - tail(a - 1, -1))
    if side == "less":
        return min(1.0, tail(a, -1)) if a <= mode else max(0.0, 1.0 - tail(a + 1, 1))
    # The far side starts where the probability has come down to that of the observed cell.
    step = 1 if a < mode else -1
    near, far = (float(mode), high) if step > 0 else (float(mode), low)
    limit = own + 1e-7
    if log_hypergeometric(far, row, column, n) > limit:
        return min(1.0, tail(a, -step))
    while abs(far - near) > 1:
        middle = math.floor((near + far) / 2)
        if log_hypergeometric(middle, row, column, n) > limit:
            near = middle
        else:
            far = middle
    start = near if log_hypergeometric(near, row, column, n) <= limit else far
    if start == a or log_hypergeometric(float(mode), row, column, n) <= limit:
        return 1.0
    return min(1.0, tail(a, -step) + tail(start, step))


def harmonic_between(low: int, high: int) -> float:
    """1/low + ... + 1/high, by sums of a bounded length and the asymptotic series between them."""
    edge = min(high, low + 9_999)
    total = float(np.sum(1.0 / np.arange(low, edge + 1, dtype=float)))
    if edge < high:
        tail = lambda x: -1 / (12 * x * x) + 1 / (120 * x**4)
        total += math.log(high / edge) + 0.5 / high - 0.5 / edge + tail(high) - tail(edge)
    return total


def expected_reciprocal_rank(n: float, p: float) -> float | None:
    """Mean of 1 / (first positive rank) when p of n rows are positive at random.

    The sum of C(n - r, p - 1) / r over r is C(n, p - 1) (H(n) - H(p - 1)).
    """
    if n is None or p is None or math.isnan(n) or math.isnan(p) or n <= 0 or p <= 0 or p > n:
        return None
    n, p = int(n), int(p)
    return p / (n - p + 1) * harmonic_between(p, n)


@F.pandas_udf(T.DoubleType())
def rank_sum_tail(
    u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series, side: pd.Series, exact: pd.Series
) -> pd.Series:
    return pd.Series([rank_sum_p(*row) for row in zip(u, n1, n2, ties, side, exact)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def signed_rank_tail(w: pd.Series, n: pd.Series, ties: pd.Series, side: pd.Series, exact: pd.Series) -> pd.Series:
    return pd.Series([signed_rank_p(*row) for row in zip(w, n, ties, side, exact)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def student_tail(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([student_p(*row) for row in zip(t, dof)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def fisher_tail(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, side: pd.Series) -> pd.Series:
    return pd.Series([fisher_p(*row) for row in zip(a, b, c, d, side)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def random_reciprocal_rank(n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series([expected_reciprocal_rank(*row) for row in zip(n, p)], dtype="float64")


def _log_factorial(x: np.ndarray) -> np.ndarray:
    """ln x! by Stirling's series at x + 9, carried back."""
    y = x + 9.0
    below = np.ones_like(y)
    for k in range(1, 9):
        below *= x + k
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - np.log(below)


def smallest_place(n: np.ndarray, w: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Smallest of ``w`` places drawn without replacement out of 1..``n``, by inversion at ``u`` in [0, 1).

    It is beyond r with probability C(n - r, w) / C(n, w); the answer is the first r for which that is at most 1 - u.
    """
    n, w = n.astype(np.int64), w.astype(np.int64)
    low, high = np.ones_like(n), n - w + 1
    limit = np.log1p(-u) - _log_factorial((n - w).astype(float)) + _log_factorial(n.astype(float))
    while (low < high).any():
        r = (low + high) // 2
        rest = np.maximum(n - r, w).astype(float)
        beyond = np.where(n - r >= w, _log_factorial(rest) - _log_factorial(rest - w), -np.inf)
        enough = beyond <= limit
        high = np.where(enough, r, high)
        low = np.where(enough, low, np.minimum(r + 1, high))
    return low


def smallest_of_draw(n: Column, w: Column, u: Column) -> Column:
    """``smallest_place`` on columns; one row is one draw."""

    @F.pandas_udf(T.LongType())
    def place(n: pd.Series, w: pd.Series, u: pd.Series) -> pd.Series:
        return pd.Series(smallest_place(n.to_numpy(), w.to_numpy(), u.to_numpy()))

    return place(n.cast("bigint"), w.cast("bigint"), u)
