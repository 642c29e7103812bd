"""Tail probabilities of the t and F distributions as Spark expressions.

Spark has no such builtin. The regularised incomplete beta function is evaluated by its
continued fraction, folded over a fixed-length sequence, so a plan that needs p-values
stays in the JVM. Models are few next to the rows behind them: each expression here runs
once per fitted model.

Arguments are SQL text, usually column names. The expressions are written as SQL because
one parsed string builds in a millisecond what takes hundreds of calls on Column objects.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos coefficients (g = 7) of the gamma function.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313,
           -176.61502916214059, 12.507343278686905, -0.13857109526572012,
           9.9843695780195716e-6, 1.5056327351493116e-7)
HALF_LOG_TWO_PI = 0.9189385332046727
# Fixed value: 0.975 quantile of the standard normal distribution.
Z_975 = 1.959963984540054
TERMS = 60
# From here on the fraction would lose digits, since 1 - x is of size t*t/dof; the tail is then that of
# a gamma distribution, whose error is of size 1/dof². Both agree to 1e-9 where they meet.
LARGE_DOF = 1e6
GAMMA_TERMS = 400


def _let(name: str, value: str, body: str) -> str:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _log_gamma(z: str) -> str:
    """Natural log of the gamma function for z > 0."""
    series = " + ".join(f"({c!r}D) / ({z} + {i})" for i, c in enumerate(LANCZOS[1:]))
    return (f"({HALF_LOG_TWO_PI}D + ({z} - 0.5D) * ln({z} + 6.5D) - ({z} + 6.5D)"
            f" + ln({LANCZOS[0]!r}D + {series}))")


def _stirling_tail(z: str) -> str:
    return (f"((1 / 12D - (1 / 360D - (1 / 1260D - (1 / 1680D - 1 / 1188D / ({z} * {z}))"
            f" / ({z} * {z})) / ({z} * {z})) / ({z} * {z})) / {z})")


def _log_beta(a: str, b: str) -> str:
    """Log of the beta function, accurate even when one argument is as large as 1e12.

    Subtracting two log-gammas of size 1e13 would leave no correct digit, so for a large
    argument the difference is taken term by term in Stirling's series.
    """
    big, small, both = "g.big", "g.small", "(g.big + g.small)"
    step = (f"(({big} - 0.5D) * log1p({small} / {big}) + {small} * ln({both}) - {small}"
            f" + {_stirling_tail(both)} - {_stirling_tail(big)})")
    body = (f"{_log_gamma(small)} + CASE WHEN {big} < 12 THEN {_log_gamma(big)} - {_log_gamma(both)}"
            f" ELSE -{step} END")
    return _let("g", f"named_struct('big', greatest({a}, {b}), 'small', least({a}, {b}))", body)


def _beta_fraction(a: str, b: str, x: str) -> str:
    """Continued fraction of the incomplete beta function, folded from its far end."""
    at = f"({a} + 2D * m)"
    even = f"(m * ({b} - m) * {x} / (({at} - 1D) * {at}))"
    odd = f"(-({a} + m) * ({a} + {b} + m) * {x} / ({at} * ({at} + 1D)))"
    near = f"(-({a} + {b}) * {x} / ({a} + 1D))"
    return (f"aggregate(sequence({TERMS}, 1, -1), 0D, (tail, m) -> {even} / (1D + {odd} / (1D + tail)),"
            f" tail -> 1D / (1D + {near} / (1D + tail)))")


def _gamma_tail(b: str, y: str) -> str:
    """Upper tail of the gamma distribution of shape b: a series below its mean, a fraction above."""
    series = ("1D - g.front * aggregate(sequence(1, {n}), named_struct('term', 1D / g.b, 'sum', 1D / g.b),"
              " (t, i) -> named_struct('term', t.term * g.y / (g.b + i), 'sum', t.sum + t.term * g.y / (g.b + i)),"
              " t -> t.sum)").format(n=GAMMA_TERMS)
    fraction = ("g.front / aggregate(sequence({n}, 1, -1), g.y + 2D * {n} + 1D - g.b,"
                " (t, i) -> g.y + 2D * (i - 1) + 1D - g.b - i * (i - g.b) / t)").format(n=GAMMA_TERMS)
    front = f"exp(c.b * ln(c.y) - c.y - {_log_gamma('c.b')})"
    body = _let("g", f"named_struct('b', c.b, 'y', c.y, 'front', {front})",
                f"CASE WHEN g.y < g.b + 1D THEN {series} ELSE {fraction} END")
    return _let("c", f"named_struct('b', {b}, 'y', {y})", body)


def _f_upper(f: str, d1: str, d2: str) -> str:
    front = f"exp(s.b * ln(s.w) - (s.a + s.b) * log1p(s.w) - {_log_beta('s.a', 's.b')})"
    # Left of the mean the fraction converges for x, right of it for 1 - x.
    low = "s.b + 1D < (s.a + 1D) * s.w"
    side = (f"CASE WHEN {low} THEN named_struct('p', s.a, 'q', s.b, 'x', 1D / (1D + s.w), 'low', true)"
            f" ELSE named_struct('p', s.b, 'q', s.a, 'x', s.w / (1D + s.w), 'low', false) END")
    part = f"{front} * {_beta_fraction('e.p', 'e.q', 'e.x')} / e.p"
    tail = _let("e", side, f"CASE WHEN e.low THEN {part} ELSE 1D - {part} END")
    body = (f"CASE WHEN s.w <= 0 THEN 1D WHEN isnan(s.w) OR s.w > 1e290D THEN 0D"
            f" WHEN s.a >= {LARGE_DOF / 2}D AND s.a > 1000 * s.b THEN {_gamma_tail('s.b', '((s.a + (s.b - 1D) / 2) * log1p(s.w))')}"
            f" ELSE {tail} END")
    dof = f"double({d2})"
    state = f"named_struct('a', {dof} / 2, 'b', double({d1}) / 2, 'w', double({d1}) * ({f}) / {dof})"
    return f"CASE WHEN ({f}) IS NOT NULL AND {d1} > 0 AND {d2} > 0 THEN {_let('s', state, body)} END"


def f_upper_p(f: str, d1: str, d2: str) -> Column:
    """P(F > f) with d1 and d2 degrees of freedom; NULL when a degree is not positive.

    An infinite or NaN ``f`` (a perfect fit) gives 0.
    """
    return F.expr(_f_upper(f, d1, d2))


def t_two_sided_p(t: str, dof: str) -> Column:
    """P(|T| > |t|) with ``dof`` degrees of freedom."""
    return F.expr(_f_upper(f"{t} * {t}", "1", dof))


def t_quantile_975(dof: str) -> Column:
    """The 0.975 quantile of the t distribution, for 95 % intervals.

    Starts from the expansion around the normal quantile and refines it by Newton steps on
    the log of the tail probability, which converges from either side.
    """
    n = f"double({dof})"
    z, z3, z5, z7 = Z_975, Z_975 ** 3, Z_975 ** 5, Z_975 ** 7
    guess = (f"{z}D + {(z3 + z) / 4}D / {n} + {(5 * z5 + 16 * z3 + 3 * z) / 96}D / ({n} * {n})"
             f" + {(3 * z7 + 19 * z5 + 17 * z3 - 15 * z) / 384}D / ({n} * {n} * {n})")
    log_density = f"(-({n} + 1) / 2 * log1p(t * t / {n}) - 0.5D * ln({n}) - {_log_beta(f'{n} / 2', '0.5D')})"
    half = f"({_f_upper('t * t', '1', dof)}) / 2"
    newton = _let("p", half, f"t + ln(p / 0.025D) * p / exp({log_density})")
    refined = f"aggregate(sequence(1, 8), {guess}, (t, _i) -> {newton})"
    # One degree of freedom is the Cauchy case, where the expansion starts too far out.
    return F.expr(f"CASE WHEN {dof} = 1 THEN 12.706204736174694D WHEN {dof} > 1 THEN {refined} END")
