"""Registered queries that SQL cannot express, against plain versions."""

import math
from statistics import NormalDist

import numpy as np
import pytest

from fieldtrace.catalog import all_queries


def test_normal_plot_points(tables):
    got = {r.id: r for r in all_queries()["normal_plot_points"].run(tables).collect()}
    rows = sorted((r.dist_pt_km, r.id) for r in tables.seasonal_orders.select("id", "dist_pt_km").collect())
    n, a = len(rows), 0.5 if len(rows) > 10 else 0.375
    values = [v for v, _ in rows]
    lo, hi = np.quantile(values, [0.25, 0.75])
    z = NormalDist().inv_cdf(0.75)
    for i, (v, key) in enumerate(rows, 1):
        assert got[key].dist_pt_km == v and got[key].theoretical == pytest.approx(NormalDist().inv_cdf((i - a) / (n + 1 - 2 * a)), abs=1e-8)
        assert got[key].slope == pytest.approx((hi - lo) / (2 * z)) and got[key].intercept == pytest.approx((lo + hi) / 2)
    assert len(got) == n


def test_tropism_test(tables):
    """Shapes solve the score equations, interval and p-value are those of the density summed up on a grid."""
    stats = {(r.sp, r.axis): r for r in all_queries()["beta_sufficient_statistics"].run(tables).collect()}
    got = all_queries()["tropism_test"].run(tables).collect()
    assert len(got) == len(stats) == 4

    def digamma(x, h=1e-4):
        return (math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h)

    for r in got:
        s = stats[r.sp, r.axis]
        a, b = r.shape1, r.shape2
        assert digamma(a) - digamma(a + b) == pytest.approx(s.log_p, abs=2e-6)
        assert digamma(b) - digamma(a + b) == pytest.approx(s.log_q, abs=2e-6)
        x = (np.arange(400_000) + 0.5) / 400_000
        mass = np.exp((a - 1) * np.log(x) + (b - 1) * np.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / 400_000
        upto = np.cumsum(mass)
        assert upto[-1] == pytest.approx(1, abs=1e-6)
        assert np.interp(r.conf_int_low, x, upto) == pytest.approx(0.025, abs=1e-5) and np.interp(r.conf_int_high, x, upto) == pytest.approx(0.975, abs=1e-5)
        assert r.realized == pytest.approx(s.realized, abs=1e-6)
        assert r.p_critique == pytest.approx(2 * (1 - np.interp(r.realized, x, upto)), abs=1e-4)
