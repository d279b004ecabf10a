"""Scalar distribution functions used on the driver for small results (p-values of
tests whose statistic Spark has already aggregated). Pure Python, no SciPy."""

from __future__ import annotations

import math


def normal_cdf(x: float) -> float:
    if x is None or math.isnan(x):
        return float("nan")
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def normal_sf(x: float) -> float:
    if x is None or math.isnan(x):
        return float("nan")
    return 0.5 * math.erfc(x / math.sqrt(2.0))


def normal_pdf(x: float) -> float:
    return math.exp(-0.5 * x * x) / math.sqrt(2.0 * math.pi)


def normal_ppf(p: float) -> float:
    """Inverse standard normal CDF: a rational starting point refined by Newton steps
    on the exact CDF (erfc), accurate to double precision for 1e-300 < p < 1."""
    if not 0.0 < p < 1.0:
        if p == 0.0:
            return -math.inf
        if p == 1.0:
            return math.inf
        return float("nan")
    q = min(p, 1.0 - p)
    t = math.sqrt(-2.0 * math.log(q))
    # Abramowitz & Stegun 26.2.23 start (|error| < 4.5e-4)
    x = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (
        1.0 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t ** 3)
    x = -x if p < 0.5 else x
    for _ in range(8):
        if p < 0.5:
            err = normal_cdf(x) - p
        else:
            err = -(normal_sf(x) - (1.0 - p))
        d = normal_pdf(x)
        if d == 0.0:
            break
        step = err / d
        x -= step
        if abs(step) < 1e-15 * max(1.0, abs(x)):
            break
    return x


def _gamma_series(a: float, x: float) -> float:
    """Regularised lower incomplete gamma P(a, x) by series (x < a + 1)."""
    term = 1.0 / a
    total = term
    ap = a
    for _ in range(10000):
        ap += 1.0
        term *= x / ap
        total += term
        if abs(term) < abs(total) * 1e-16:
            break
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _gamma_cf(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x) by continued fraction (x >= a + 1)."""
    tiny = 1e-300
    b = x + 1.0 - a
    c = 1.0 / tiny
    d = 1.0 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-16:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def chi2_sf(x: float, df: float) -> float:
    """Upper tail of the chi-square distribution."""
    if x is None or df is None or math.isnan(x) or math.isnan(df) or df <= 0:
        return float("nan")
    if x <= 0:
        return 1.0
    a, z = df / 2.0, x / 2.0
    if z < a + 1.0:
        return 1.0 - _gamma_series(a, z)
    return _gamma_cf(a, z)


def chi2_cdf(x: float, df: float) -> float:
    return 1.0 - chi2_sf(x, df)


# Cody's (1969) rational approximations of erf and erfc, highest order last but for
# the leading coefficients, which stand at the end of A, C and P.
_A = [3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1]
_B = [2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03]
_C = [5.64188496988670089e-1, 8.88314979438837594e00, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02,
      1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8]
_D = [1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03,
      4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03]
_P = [3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4,
      1.63153871373020978e-2]
_Q = [2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3]


def _nested(lead: float | None, coefficients: list[float], x: str) -> str:
    out = x if lead is None else f"{lead!r}D * {x}"
    for c in coefficients[:-1]:
        out = f"({out} + {c!r}D) * {x}"
    return f"({out} + {coefficients[-1]!r}D)"


def erfc_sql(x: str) -> str:
    """erfc of the double column or expression ``x`` as SQL, to double precision (for Spark; other
    engines take it without the suffix D of its numbers)."""
    y = f"abs({x})"
    square = f"({x}) * ({x})"
    small = f"1D - ({x}) * {_nested(_A[-1], _A[:-1], square)} / {_nested(None, _B, square)}"
    middle = f"exp(-{square}) * {_nested(_C[-1], _C[:-1], y)} / {_nested(None, _D, y)}"
    inverse = f"(1D / ({square}))"
    large = (f"exp(-{square}) * ({1 / math.sqrt(math.pi)!r}D - {inverse} * {_nested(_P[-1], _P[:-1], inverse)} / "
             f"{_nested(None, _Q, inverse)}) / {y}")
    positive = f"case when {y} <= 4D then {middle} when {y} < 27D then {large} else 0D end"
    return f"case when {y} <= 0.46875D then {small} when {x} < 0 then 2D - {positive} else {positive} end"


def normal_cdf_sql(z: str) -> str:
    """Standard normal distribution function of a double expression as SQL."""
    return f"0.5D * ({erfc_sql(f'(-({z}) / {math.sqrt(2.0)!r}D)')})"
