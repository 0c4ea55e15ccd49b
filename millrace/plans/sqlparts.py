"""Pieces of SQL that the oracles of linear and latent-variable models share: small vectors and matrices as lists."""

from __future__ import annotations

from collections.abc import Sequence


def dot(a: str, b: str) -> str:
    return f"list_inner_product({a}, {b})"


def times(m: str, v: str) -> str:
    """A matrix (a list of rows) times a vector."""
    return f"list_transform({m}, lambda row: {dot('row', v)})"


def scaled(v: str, s: str) -> str:
    return f"list_transform({v}, lambda x: x * ({s}))"


def plus(a: str, b: str, s: str) -> str:
    """a + s b."""
    return f"list_transform(list_zip({a}, {b}), lambda z: z[1] + ({s}) * z[2])"


def unit(v: str) -> str:
    """A vector of length one whose largest member is positive."""
    most = f"list_max(list_transform({v}, lambda x: abs(x)))"
    return scaled(v, f"(CASE WHEN list_max({v}) = {most} THEN 1 ELSE -1 END) / sqrt({dot(v, v)})")


def correlations(x: Sequence[str], y: str) -> str:
    """r (of x), c (of x with y), and the means and deviations of all: one row."""
    r = ", ".join("[" + ", ".join(f"corr({a}, {b})" if a != b else "1.0" for b in x) + "]" for a in x)
    return f"[{r}] AS r, [{', '.join(f'corr({a}, {y})' for a in x)}] AS c, [{', '.join(f'avg({a})' for a in x)}] AS m, [{', '.join(f'stddev_samp({a})' for a in x)}] AS s, avg({y}) AS my, stddev_samp({y}) AS sy"


def pls_two(of: str) -> str:
    """CTEs of two PLS components of one y from correlations r and c of the relation `of`: rotations r1, r2, loadings p1, p2, q1, q2 and score variances v1, v2."""
    return f"""
    pls_a AS (SELECT *, {unit("c")} AS r1 FROM {of}), pls_b AS (SELECT *, {dot("r1", times("r", "r1"))} AS v1 FROM pls_a),
    pls_c AS (SELECT *, {scaled(times("r", "r1"), "1 / v1")} AS p1, {dot("c", "r1")} / v1 AS q1 FROM pls_b), pls_d AS (SELECT *, {unit(plus("c", "p1", "-q1 * v1"))} AS w2 FROM pls_c),
    pls_e AS (SELECT *, {plus("w2", "r1", f"-{dot('p1', 'w2')}")} AS r2 FROM pls_d), pls_f AS (SELECT *, {dot("r2", times("r", "r2"))} AS v2 FROM pls_e),
    pls AS (SELECT *, {scaled(times("r", "r2"), "1 / v2")} AS p2, {dot("c", "r2")} / v2 AS q2 FROM pls_f)"""


def sweeps(table: str, terms: Sequence[str], y: str, order: Sequence[int], name: str) -> str:
    """CTEs that take the terms out of centred cross products one after another; s_{{y}}_{{y}} of the last, {name}, is the residual sum of squares."""
    k = len(terms)
    every = [*terms, y]
    centred = ", ".join(f"{e} - avg({e}) OVER () AS d{i}" for i, e in enumerate(every))
    sums = ", ".join(f"sum(d{i} * d{j}) AS s{i}_{j}" for i in range(k + 1) for j in range(i, k + 1))
    out = [f"{name}_d AS (SELECT {centred} FROM {table})", f"{name}_0 AS (SELECT {sums}, count(*) AS n FROM {name}_d)"]
    left = list(range(k + 1))
    at = lambda i, j: f"s{min(i, j)}_{max(i, j)}"
    for step, p in enumerate(order, 1):
        left.remove(p)
        out.append(f"{name}_{step} AS (SELECT n, " + ", ".join(f"{at(i, j)} - {at(i, p)} * {at(p, j)} / {at(p, p)} AS {at(i, j)}" for a, i in enumerate(left) for j in left[a:]) + f" FROM {name}_{step - 1})")
    out.append(f"{name} AS (SELECT n, s{k}_{k} AS rss FROM {name}_{len(order)})")
    return ", ".join(out)
