"""Queries of designed experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import doe
from millrace.plans.catalog import add
from millrace.plans.stats import rounded, table

LEVELS = {"A": (-1, 1), "B": (-1, 0, 1), "C": (10, 20, 30, 40)}


@add("full_factorial", "SELECT cast(i + 1 AS INT) AS RunOrder, [-1.0, 1.0][i % 2 + 1]::DOUBLE AS A, [-1.0, 0.0, 1.0][i // 2 % 3 + 1]::DOUBLE AS B, [10.0, 20.0, 30.0, 40.0][i // 6 % 4 + 1]::DOUBLE AS C FROM range(24) t(i)")
def full_factorial(spark, sf_dir):
    return doe.full_factorial_frame(spark, LEVELS)


@add("fractional_factorial", "SELECT cast(i + 1 AS INT) AS RunOrder, 2.0::DOUBLE * (i & 1) - 1 AS A, 2.0::DOUBLE * (i >> 1 & 1) - 1 AS B, 2.0::DOUBLE * (i >> 2 & 1) - 1 AS C, (2.0::DOUBLE * (i & 1) - 1) * (2 * (i >> 1 & 1) - 1) * (2 * (i >> 2 & 1) - 1) AS D FROM range(8) t(i)")
def fractional(spark, sf_dir):
    return doe.frame(spark, doe.fractional_factorial(3, ["ABC"]), doe.names(4))


SIGNS = "SELECT CASE WHEN l_returnflag = 'A' THEN 1 ELSE -1 END AS A, CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS B, CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END AS C, l_extendedprice AS y FROM lineitem"
TERMS = [("A", "A"), ("B", "B"), ("C", "C"), ("A:B", "A * B"), ("A:C", "A * C"), ("B:C", "B * C")]


@add("factor_effects", f"WITH d AS ({SIGNS}) " + " UNION ALL ".join(f"SELECT '{n}' AS term, round(avg(y) FILTER (WHERE {t} > 0) - avg(y) FILTER (WHERE {t} < 0), 4) AS effect FROM d" for n, t in TERMS))
def factor_effects(spark, sf_dir):
    sign = lambda c, v: F.when(F.col(c) == v, 1).otherwise(-1)
    d = table(spark, sf_dir, "lineitem").select(sign("l_returnflag", "A").alias("A"), sign("l_linestatus", "O").alias("B"), F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(-1).alias("C"), F.col("l_extendedprice").alias("y"))
    return rounded(doe.effects(d, "y", ["A", "B", "C"]), 4)


def _designs(kind, k, **options):
    def query(spark, sf_dir):
        """The settings of a design; the order of its runs is random and left out."""
        out = doe.generate_design(spark, kind, {n: (10.0, 20.0) for n in doe.names(k)}, seed=3, center_points=0 if kind == "mixture" else 2, **options)
        return rounded(out.drop("RunOrder"))

    return query


def _settings(coded: str, k: int, low: float = 10.0, high: float = 20.0) -> str:
    """SQL of the actual settings of a relation's lists x of coded ones, and two centre points."""
    columns = lambda x: ", ".join(f"round({(low + high) / 2} + {(high - low) / 2} * {x.format(i + 1)}, 6)::DOUBLE AS {n}" for i, n in enumerate(doe.names(k)))
    return f"WITH {coded} SELECT {columns('x[{}]')} FROM d UNION ALL SELECT {columns('0.0')} FROM range(2)"


def _paley(q: int) -> str:
    """The runs of Paley's design of q + 1 runs: one all high, and q of the quadratic residues, with lows where j - i is one or nought."""
    residues = sorted({i * i % q for i in range(1, q)})
    return f"d AS (SELECT list_transform(range(1, {q + 1}), lambda j: 1.0) AS x UNION ALL SELECT list_transform(range(1, {q + 1}), lambda j: CASE WHEN (j - i + {q}) % {q} IN (0, {', '.join(map(str, residues))}) THEN -1.0 ELSE 1.0 END) FROM range(1, {q + 1}) t(i))"


def _unit(k: int, i: str, v: str) -> str:
    return f"list_transform(range(1, {k + 1}), lambda j: CASE WHEN j = {i} THEN {v} ELSE 0.0 END)"


DESIGN_SQL = {
    "plackett_burman": _settings(_paley(11), 11),
    "taguchi": _settings(_paley(7), 7),
    "ccd": _settings(f"d AS (SELECT [2.0 * (i & 1) - 1, 2.0 * (i >> 1 & 1) - 1, 2.0 * (i >> 2 & 1) - 1] AS x FROM range(8) t(i) UNION ALL SELECT {_unit(3, 'i', 's * 8 ^ 0.25')} FROM range(1, 4) t(i), (VALUES (-1.0), (1.0)) u(s) UNION ALL SELECT [0.0, 0.0, 0.0] FROM range(4))", 3),
    "box_behnken": _settings("d AS (SELECT list_transform(range(1, 5), lambda j: CASE WHEN j = a THEN s WHEN j = b THEN t ELSE 0.0 END) AS x FROM range(1, 5) p(a), range(1, 5) q(b), (VALUES (-1.0), (1.0)) u(s), (VALUES (-1.0), (1.0)) v(t) WHERE a < b UNION ALL SELECT [0.0, 0.0, 0.0, 0.0] FROM range(3))", 4),
    "dsd": _settings("c AS (SELECT [0.0, 1.0, 1.0, 1.0, 1.0, 1.0] AS x UNION ALL SELECT list_transform(range(0, 6), lambda j: CASE WHEN j = 0 THEN 1.0 WHEN j = i THEN 0.0 WHEN (j - i + 5) % 5 IN (1, 4) THEN 1.0 ELSE -1.0 END) FROM range(1, 6) t(i)), d AS (SELECT x FROM c UNION ALL SELECT list_transform(x, lambda v: -v) FROM c UNION ALL SELECT [0.0, 0.0, 0.0, 0.0, 0.0, 0.0])", 6),
    "mixture": "SELECT round(a / (a + b + c), 6)::DOUBLE AS A, round(b / (a + b + c), 6)::DOUBLE AS B, round(c / (a + b + c), 6)::DOUBLE AS C FROM (SELECT (i & 1)::DOUBLE AS a, (i >> 1 & 1)::DOUBLE AS b, (i >> 2 & 1)::DOUBLE AS c FROM range(1, 8) t(i))",
}

for _kind, _k, _options in (("plackett_burman", 11, {}), ("ccd", 3, {}), ("box_behnken", 4, {}), ("dsd", 6, {}), ("mixture", 3, {}), ("d_optimal", 4, {"runs": 12}), ("a_optimal", 3, {"runs": 10}), ("i_optimal", 3, {"runs": 12, "model": "interactions"}), ("taguchi", 7, {})):
    add(f"design_{_kind}", DESIGN_SQL.get(_kind))(_designs(_kind, _k, **_options))


@add("design_evaluation")
def evaluation(spark, sf_dir):
    out = []
    for kind, x in (("full", doe.full_factorial(3)), ("ccd", doe.central_composite(3)), ("dsd", doe.definitive_screening(6))):
        e = doe.evaluate_design(x, "linear")
        out += [(kind, k, float(e[k])) for k in ("n", "p", "d_efficiency", "a_optimality", "e_optimality", "g_efficiency", "i_efficiency", "condition_number")]
    return spark.createDataFrame(out, "design string, metric string, value double")


@add("design_trade_off")
def trade_off(spark, sf_dir):
    return spark.createDataFrame(doe.trade_off_table(), "runs int, factors int, resolution int, generators string")


LETTERS_SQL = "concat_ws('', CASE WHEN {0} & 1 > 0 THEN 'A' END, CASE WHEN {0} & 2 > 0 THEN 'B' END, CASE WHEN {0} & 4 > 0 THEN 'C' END, CASE WHEN {0} & 8 > 0 THEN 'D' END, CASE WHEN {0} & 16 > 0 THEN 'E' END)"


@add("design_aliases", f"SELECT {LETTERS_SQL.format('i')} AS effect, {LETTERS_SQL.format('xor(i, 23)')} AS aliases FROM range(1, 32) t(i) WHERE bit_count(i) <= 2")
def aliases(spark, sf_dir):
    return spark.createDataFrame([(e, ", ".join(a)) for e, a in doe.alias_chains(4, ["ABCD"[:3]]).items()], "effect string, aliases string")
