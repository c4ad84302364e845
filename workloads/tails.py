"""Tail probabilities as SQL text: a series or a continued fraction evaluated from its far end by list functions."""

import math


def erfc(x: str) -> str:
    """Complementary error function of a nonnegative expression."""
    series = f"list_sum(list_transform(range(0, 70), lambda k: pow(-1, k) * exp((2 * k + 1) * ln(greatest({x}, 1e-300)) - lgamma(k + 1)) / (2 * k + 1)))"
    fraction = f"list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(0, 80), lambda k: (80 - k)::DOUBLE)), lambda a, k: 1.0 + k / (2.0 * ({x}) * ({x})) / a)"
    return (f"(CASE WHEN {x} < 2 THEN 1.0 - {2 / math.sqrt(math.pi)!r} * {series} "
            f"ELSE exp(-({x}) * ({x})) / (({x}) * {math.sqrt(math.pi)!r}) / {fraction} END)")


def normal_upper(z: str) -> str:
    """P(Z > z)."""
    half = f"0.5 * {erfc(f'(abs({z}) / {math.sqrt(2)!r})')}"
    return f"(CASE WHEN {z} >= 0 THEN {half} ELSE 1.0 - {half} END)"


def chi2_upper(x: str) -> str:
    """P(X > x) with one degree of freedom."""
    return erfc(f"sqrt(({x}) / 2.0)")


def _beta_direct(a: str, b: str, x: str) -> str:
    term = (f"CASE WHEN k % 2 = 1 THEN -(({a}) + k // 2) * (({a}) + ({b}) + k // 2) * ({x}) / ((({a}) + 2 * (k // 2)) * (({a}) + 2 * (k // 2) + 1)) "
            f"ELSE (k // 2) * (({b}) - k // 2) * ({x}) / ((({a}) + k - 1) * (({a}) + k)) END")
    fraction = f"list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(0, 300), lambda i: list_transform([300 - i], lambda k: {term})[1])), lambda c, d: 1.0 + d / c)"
    front = f"exp(lgamma(({a}) + ({b})) - lgamma({a}) - lgamma({b}) + ({a}) * ln(greatest({x}, 1e-300)) + ({b}) * ln(greatest(1.0 - ({x}), 1e-300))) / ({a})"
    return f"({front} / {fraction})"


def beta(a: str, b: str, x: str) -> str:
    """Regularized incomplete beta function."""
    return (f"(CASE WHEN {x} <= (({a}) + 1.0) / (({a}) + ({b}) + 2.0) THEN {_beta_direct(a, b, x)} "
            f"ELSE 1.0 - {_beta_direct(b, a, f'(1.0 - ({x}))')} END)")


def f_upper(f: str, d1: str, d2: str) -> str:
    return beta(f"(({d2}) / 2.0)", f"(({d1}) / 2.0)", f"(({d2}) / (({d2}) + ({d1}) * ({f})))")


def t_two_sided(t: str, v: str) -> str:
    return beta(f"(({v}) / 2.0)", "0.5::DOUBLE", f"(({v}) / (({v}) + ({t}) * ({t})))")
