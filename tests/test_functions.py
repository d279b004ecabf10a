import math

import numpy as np
import pytest

from tessera.functions.distributions import chi2_sf, normal_cdf, normal_ppf
from tessera.operators.normality import shapiro_w


def test_normal_ppf_roundtrip():
    for p in [1e-10, 0.001, 0.025, 0.3, 0.5, 0.8, 0.975, 0.999999]:
        assert math.isclose(normal_cdf(normal_ppf(p)), p, rel_tol=1e-10)
    assert math.isclose(normal_ppf(0.975), 1.959963984540054, rel_tol=1e-12)


def test_chi2_tail_known_values():
    assert math.isclose(chi2_sf(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(chi2_sf(18.307038053275146, 10), 0.05, rel_tol=1e-9)
    assert math.isclose(chi2_sf(2.0, 2), math.exp(-1.0), rel_tol=1e-12)


def test_shapiro_behaviour():
    rng = np.random.default_rng(7)
    w, p = shapiro_w(rng.normal(size=500))
    assert 0.98 < w <= 1.0 and p > 0.01
    w2, p2 = shapiro_w(rng.exponential(size=500))
    assert w2 < 0.95 and p2 < 1e-6
    w3, p3 = shapiro_w(np.array([1.0, 2.0, 4.0]))
    assert 0 < w3 <= 1 and 0 <= p3 <= 1
    assert all(math.isnan(v) for v in shapiro_w(np.array([5.0, 5.0, 5.0])))
