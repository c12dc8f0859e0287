"""Distribution tails against sums over all outcomes."""

import itertools
import math
from fractions import Fraction

import pytest

from sitelens.functions import tails


def hypergeometric(a, b, c, d):
    row, column, n = a + b, a + c, a + b + c + d
    total = math.comb(n, column)
    return {k: Fraction(math.comb(row, k) * math.comb(n - row, column - k), total) for k in range(max(0, row + column - n), min(row, column) + 1)}


@pytest.mark.parametrize("cells", [(3, 5, 7, 2), (0, 4, 9, 9), (12, 1, 2, 30), (50, 50, 50, 50), (40, 160, 10, 900), (1, 0, 0, 1), (5, 5, 5, 6)])
def test_fisher(cells):
    p = hypergeometric(*cells)
    own = p[cells[0]]
    assert tails.fisher_p(*map(float, cells), "greater") == pytest.approx(float(sum(v for k, v in p.items() if k >= cells[0])), rel=1e-9)
    assert tails.fisher_p(*map(float, cells), "less") == pytest.approx(float(sum(v for k, v in p.items() if k <= cells[0])), rel=1e-9)
    assert tails.fisher_p(*map(float, cells), "two-sided") == pytest.approx(float(sum(v for v in p.values() if v <= own * Fraction(10000001, 10000000))), rel=1e-9)


def test_fisher_far_tails():
    """An observed cell hundreds of deviations from a tiny mean keeps its probability."""
    a, b, c, d = 45, 0, 55, 1_000_000
    p = float(sum(v for k, v in hypergeometric(a, b, c, d).items() if k >= a))
    assert 0 < p < 1e-140
    assert tails.fisher_p(a, b, c, d, "greater") == pytest.approx(p, rel=1e-8)
    assert tails.fisher_p(a, b, c, d, "two-sided") == pytest.approx(p, rel=1e-8)
    assert tails.fisher_p(a, b, c, d, "less") == 1.0
    assert tails.fisher_p(5e11, 5e11, 5e11, 5e11 + 1e6, "two-sided") == pytest.approx(math.erfc(math.sqrt((1e6 / 4) ** 2 / (2e12 / 16) / 2)), rel=1e-3)


@pytest.mark.parametrize("n, p", [(1, 1), (5, 1), (9, 4), (12, 12), (30, 2)])
def test_reciprocal_rank(n, p):
    ranks = [min(c) + 1 for c in itertools.combinations(range(n), p)] if n < 13 else [r for r in range(1, n) for _ in range(n - r)]
    assert tails.expected_reciprocal_rank(n, p) == pytest.approx(sum(1 / r for r in ranks) / len(ranks), rel=1e-12)


def test_reciprocal_rank_of_a_large_group():
    n = 3_000_000
    direct = math.fsum(1 / k for k in range(7, n + 1))
    assert tails.expected_reciprocal_rank(n, 7) == pytest.approx(7 / (n - 6) * direct, rel=1e-12)


def test_rank_sum_has_no_size_limit():
    m, n = 2, 5000
    exact = tails.rank_sum_p(10.0, m, n, 0.0, "less", True)
    counts = tails.rank_sum_counts(m, n)
    assert exact == pytest.approx(float(counts[:11].sum()))
    pairs = math.comb(n + 2, 2)
    assert exact == pytest.approx(sum(u // 2 + 1 for u in range(11)) / pairs, rel=1e-6)


@pytest.mark.parametrize("m, n", [(30, 30), (9, 60), (67, 133), (40, 41)])
def test_rank_sum_upper_against_whole_numbers(m, n):
    counts = [1] + [0] * (m * n)
    for i in range(1, m + 1):
        for u in range(m * n, n + i - 1, -1):
            counts[u] -= counts[u - n - i]
        for u in range(i, m * n + 1):
            counts[u] += counts[u - i]
    for k in (0, 1, m * n // 3, m * n // 2, m * n // 2 + 1, 2 * m * n // 3, m * n - 3, m * n, m * n + 1):
        exact = Fraction(sum(counts[k:]), sum(counts))
        assert tails.rank_sum_upper(n, m, k) == pytest.approx(float(exact), rel=1e-9)


def test_exact_rank_sum_of_large_groups():
    """Counts beyond any double: the exact tail stays finite, and near the normal one."""
    for above in (0.1, 2.0):
        u = 4000 * 8000 / 2 + above * math.sqrt(4000 * 8000 * 12001 / 12)
        p = tails.rank_sum_p(u, 4000, 8000, 0.0, "greater", True)
        assert p == pytest.approx(tails.rank_sum_p(u, 4000, 8000, 0.0, "greater", False), rel=2e-3)
