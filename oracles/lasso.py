"""Models with an L1 penalty solved in SQL: Newton steps, each by coordinate descent.

``fit`` gives the common table expressions of one fit. Its input has one row per (g, r):
group, row, design ``x`` (a list, the constant last) and ``y``. Every group is a fit of
its own. A Newton step is one expression for the Gram sums (in long form, joined row by
row) and one recursive one, in which each iteration moves one coefficient.
"""

from __future__ import annotations

MEAN = {"logistic": "1 / (1 + exp(-eta))", "poisson": "exp(eta)"}
WEIGHT = {"logistic": "mu * (1 - mu)", "poisson": "mu"}
START = {
    "logistic": "[CAST(0 AS DOUBLE) FOR v IN any_value(x)]",
    "poisson": "[CAST(0 AS DOUBLE) FOR v IN any_value(x)[2:]] || [ln(avg(y))]",
}


def fit(name: str, rows: str, family: str, alpha: float, steps: int = 8, updates: int = 6000) -> dict[str, str]:
    """CTEs up to ``{name}`` (g, w), the coefficients of every group."""
    found = {f"{name}_s0": f"SELECT g, {START[family]} AS w FROM {rows} GROUP BY g"}
    for step in range(1, steps + 1):
        before, last = f"{name}_s{step - 1}", step == steps
        found[f"{name}_l{step}"] = f"""
            SELECT g, r, y, mu, {WEIGHT[family]} AS wt, unnest(x) AS v, generate_subscripts(x, 1) AS i
            FROM (SELECT *, {MEAN[family]} AS mu
                  FROM (SELECT d.*, list_dot_product(x, w) AS eta FROM {rows} d JOIN {before} USING (g)))"""
        found[f"{name}_q{step}"] = f"""
            SELECT g, list(h ORDER BY i) AS a, list(slope ORDER BY i) AS b, any_value(w) AS w
            FROM (SELECT g, i, list(s ORDER BY j) AS h, any_value(grad) + sum(s * w[j]) AS slope, any_value(w) AS w
                  FROM (SELECT p.g, p.i, q.i AS j, sum(p.wt * p.v * q.v) AS s
                        FROM {name}_l{step} p JOIN {name}_l{step} q ON p.g = q.g AND p.r = q.r GROUP BY ALL)
                  JOIN (SELECT g, i, sum((y - mu) * v) AS grad FROM {name}_l{step} GROUP BY ALL) USING (g, i)
                  JOIN {before} USING (g) GROUP BY g, i)
            GROUP BY g"""
        found[f"{name}_c{step}"] = f"""
            SELECT 0 AS k, g, w FROM {name}_q{step}
            UNION ALL
            SELECT k + 1, g, w[:j - 1] || [CASE WHEN a[j][j] > 0 THEN sign(u) * greatest(abs(u) - {alpha}, 0) / a[j][j]
                                           ELSE 0 END] || w[j + 1:]
            FROM (SELECT k, c.g, c.w, a, j, b[j] - list_dot_product(a[j], c.w) + a[j][j] * c.w[j] AS u
                  FROM (SELECT *, k % len(w) + 1 AS j FROM {name}_c{step} WHERE k < {updates}) c
                  JOIN {name}_q{step} q ON q.g = c.g)"""
        found[name if last else f"{name}_s{step}"] = f"SELECT g, w FROM {name}_c{step} WHERE k = {updates}"
    return {key: " ".join(sql.split()) for key, sql in found.items()}
