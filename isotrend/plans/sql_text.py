"""SQL text of formulas the SQL counterparts share."""

from __future__ import annotations


def t_p_value(t: str, df: str) -> str:
    """Two-sided p of a t statistic by the finite trigonometric series for whole degrees."""
    theta = f"atan(abs({t}) / sqrt({df}))"
    even = (f"sin({theta}) * (SELECT sum(exp(lgamma(2 * k + 1) - 2 * lgamma(k + 1) - k * ln(4.0)"
            f" + 2 * k * ln(cos({theta})))) FROM (SELECT unnest(range(0, CAST({df} AS BIGINT) // 2)) AS k))")
    odd = (f"2 / pi() * ({theta} + sin({theta}) * coalesce((SELECT sum(exp(k * ln(4.0) + 2 * lgamma(k + 1)"
           f" - lgamma(2 * k + 2) + (2 * k + 1) * ln(cos({theta}))))"
           f" FROM (SELECT unnest(range(0, (CAST({df} AS BIGINT) - 1) // 2)) AS k)), 0))")
    return (f"CASE WHEN {df} <= 0 OR {t} IS NULL THEN NULL WHEN CAST({df} AS BIGINT) % 2 = 0 THEN 1 - {even}"
            f" ELSE 1 - {odd} END")


def f3_p_value(f: str, df: str) -> str:
    """Upper p of an F statistic with three and ``df`` degrees: the one-degree tail plus one term."""
    x, y = f"({df} / ({df} + 3 * {f}))", f"(3 * {f} / ({df} + 3 * {f}))"
    term = (f"exp({df} / 2.0 * ln{x} + 0.5 * ln{y} + lgamma({df} / 2.0 + 0.5) - lgamma(1.5) - lgamma({df} / 2.0))")
    return f"({t_p_value(f'sqrt(3 * {f})', df)}) + {term}"


def t_quantile_975(df: str) -> str:
    """0.975 quantile of t by the expansion around the normal one, exact to print for df > 500."""
    z = 1.959963984540054
    return (f"({z} + {(z**3 + z) / 4} / {df} + {(5 * z**5 + 16 * z**3 + 3 * z) / 96} / ({df} * {df})"
            f" + {(3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384} / ({df} * {df} * {df}))")


def inverse3(m: dict[str, str], name: str = "i") -> str:
    """Select list with the inverse of the symmetric 3 × 3 matrix of columns 11, 12, 13, 22, 23, 33."""
    a, b, c, d, e, f = (m[k] for k in ("11", "12", "13", "22", "23", "33"))
    det = f"({a} * ({d} * {f} - {e} * {e}) - {b} * ({b} * {f} - {e} * {c}) + {c} * ({b} * {e} - {d} * {c}))"
    parts = {"11": f"({d} * {f} - {e} * {e})", "12": f"({c} * {e} - {b} * {f})", "13": f"({b} * {e} - {c} * {d})",
             "22": f"({a} * {f} - {c} * {c})", "23": f"({b} * {c} - {a} * {e})", "33": f"({a} * {d} - {b} * {b})"}
    return ", ".join(f"{body} / {det} AS {name}{k}" for k, body in parts.items())
