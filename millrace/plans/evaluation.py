"""Queries that evaluate the lines of a table as the runs of a design."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.runs import Runs
from millrace.plans.catalog import add
from millrace.plans.orthogonal import RUNS, runs
from millrace.plans.stats import table

SUMS = "m AS (SELECT avg(q) AS mq, avg(d) AS md, count(*) AS n, var_pop(q) * count(*) AS qq, var_pop(d) * count(*) AS dd, covar_pop(q, d) * count(*) AS qd FROM runs), v AS (SELECT *, qq * dd - qd * qd AS det FROM m)"


@add(
    "runs_evaluation",
    f"""WITH {RUNS}, {SUMS}, c AS (SELECT count(*) AS settings FROM (SELECT DISTINCT q, d FROM runs))
    SELECT n, round(100 * (n * det) ^ (1.0 / 3) / n, 6) AS d_efficiency, round((1.0 / n + (mq ^ 2 * dd - 2 * mq * md * qd + md ^ 2 * qq) / det + (qq + dd) / det) * 1e6, 4) AS a_optimality, round(qq * dd / det, 8) AS vif, n - 3 AS residual, n - settings AS pure_error, settings - 3 AS lack_of_fit FROM v, c""",
)
def evaluation(spark, sf_dir):
    """Two factors, main effects; the sum of variances in millionths."""
    e = Runs.of(runs(spark, sf_dir), ["q", "d"]).evaluate()
    f = e["degrees_of_freedom"]
    row = (e["n"], round(e["d_efficiency"], 6), round(e["a_optimality"] * 1e6, 4), round(e["vif"]["q"], 8), f["residual"], f["pure_error"], f["lack_of_fit"])
    return spark.createDataFrame([row], "n long, d_efficiency double, a_optimality double, vif double, residual long, pure_error long, lack_of_fit long")


@add("runs_efficiencies")
def efficiencies(spark, sf_dir):
    """Every measure of three factors by model."""
    df = runs(spark, sf_dir)
    held = Runs.of(df, ["q", "d", "t"])
    rows = []
    for model in ("linear", "interactions", "quadratic"):
        e = held.evaluate(model)
        rows += [(model, k, float(e[k])) for k in ("n", "p", "d_efficiency", "a_optimality", "e_optimality", "condition_number")]
        rows += [(model, f"vif {t}", float(v)) for t, v in e["vif"].items()] + [(model, "g_efficiency", float(held.g_efficiency(df, model)))]
    return spark.createDataFrame(rows, "model string, measure string, value double")


def _partial(x: str, y: str) -> str:
    c = lambda a, b: f"covar_pop({a}, {b})"
    return f"{c(x, y)} - ({c(x, 'q')} * ({c('d', 'd')} * {c(y, 'q')} - {c('q', 'd')} * {c(y, 'd')}) + {c(x, 'd')} * ({c('q', 'q')} * {c(y, 'd')} - {c('q', 'd')} * {c(y, 'q')})) / ({c('q', 'q')} * {c('d', 'd')} - {c('q', 'd')} ^ 2)"


SECOND = {"q:d": "q * d", "q^2": "q * q", "d^2": "d * d"}


@add(
    "runs_correlations",
    " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, (WITH {RUNS} SELECT round(({_partial(x, y)}) / sqrt(({_partial(x, x)}) * ({_partial(y, y)})), 6) FROM runs) AS r" for (a, x), (b, y) in ((p, s) for i, p in enumerate(SECOND.items()) for s in list(SECOND.items())[i + 1 :])),
)
def correlations(spark, sf_dir):
    found = Runs.of(runs(spark, sf_dir), ["q", "d"]).correlations()
    return spark.createDataFrame([(a, b, round(r, 6)) for (a, b), r in found.items()], "a string, b string, r double")


HALF = "WITH s AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END AS A, CASE WHEN l_quantity < 26 THEN -1 ELSE 1 END AS B FROM lineitem), h AS (SELECT A, B, -A * B AS C FROM s), t AS (SELECT A, B, C, A * B AS AB, A * C AS AC, B * C AS BC FROM h)"
PAIRS = {"A": "A", "B": "B", "C": "C", "A:B": "AB", "A:C": "AC", "B:C": "BC"}


@add("runs_confounding", HALF + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS effect, CASE WHEN corr({x}, {y}) < 0 THEN '-' ELSE '+' END || '{b}' AS confounded_with FROM t HAVING abs(corr({x}, {y})) > 0.999999999" for a, x in PAIRS.items() for b, y in PAIRS.items() if a != b) + ")")
def confounding(spark, sf_dir):
    """Lines as a half fraction: the third factor is minus the product of the others."""
    sign = lambda c: F.when(c, 1).otherwise(-1)
    df = table(spark, sf_dir, "lineitem").select(sign(F.col("l_linenumber") % 2 == 0).alias("A"), sign(F.col("l_quantity") >= 26).alias("B")).withColumn("C", -F.col("A") * F.col("B"))
    found = Runs.of(df, ["A", "B", "C"]).confounding()
    return spark.createDataFrame([(a, b) for a, same in found.items() for b in same], "effect string, confounded_with string")


@add(
    "runs_aliases",
    f"WITH {RUNS}, {SUMS}, x AS (SELECT covar_pop(q, q * d) * count(*) AS qx, covar_pop(d, q * d) * count(*) AS dx FROM runs) SELECT 'q' AS term, round((qx * dd - dx * qd) / det, 6) AS bias FROM v, x UNION ALL SELECT 'd', round((dx * qq - qx * qd) / det, 6) FROM v, x",
)
def aliases(spark, sf_dir):
    """What the interaction adds to the main effects if it is left out."""
    found = Runs.of(runs(spark, sf_dir), ["q", "d"]).alias_matrix()
    return spark.createDataFrame([(t, round(found[t, "q:d"], 6)) for t in ("q", "d")], "term string, bias double")
