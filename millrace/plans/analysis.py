"""Queries of the analysis of experiments and of resampled models."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import experiments, latent, linear, resampling
from millrace.plans import sqlparts as S
from millrace.plans.catalog import add
from millrace.plans.models import PLS_X, X, lines


@add(
    "anova_one_term",
    """SELECT 'l_quantity' AS term, round(regr_sxy(l_extendedprice, l_quantity) ^ 2 / regr_sxx(l_extendedprice, l_quantity) / 1e6, 4) AS sum_sq, 1::BIGINT AS df FROM lineitem
    UNION ALL SELECT 'Residual', round((regr_syy(l_extendedprice, l_quantity) - regr_sxy(l_extendedprice, l_quantity) ^ 2 / regr_sxx(l_extendedprice, l_quantity)) / 1e6, 4), count(*) - 2 FROM lineitem""",
)
def anova_one(spark, sf_dir):
    rows = experiments.anova(lines(spark, sf_dir), "l_extendedprice ~ l_quantity")
    return spark.createDataFrame([(r["term"], round(r["sum_sq"] / 1e6, 4), int(r["df"])) for r in rows], "term string, sum_sq double, df long")


FOUR = ["l_quantity", "l_discount", "l_tax", "l_quantity * l_discount"]
#: For each term of l_quantity * l_discount + l_tax: its place, and the places of the terms that do not contain it.
TYPE_TWO = {"l_quantity": (0, [1, 2]), "l_discount": (1, [0, 2]), "l_tax": (2, [0, 1, 3]), "l_discount:l_quantity": (3, [0, 1, 2])}


def _type_two() -> str:
    parts = [S.sweeps("lineitem", FOUR, "l_extendedprice", [0, 1, 2, 3], "whole")]
    rows = []
    for term, (i, others) in TYPE_TWO.items():
        parts += [S.sweeps("lineitem", FOUR, "l_extendedprice", others, f"out{i}"), S.sweeps("lineitem", FOUR, "l_extendedprice", [*others, i], f"in{i}")]
        rows.append(f"SELECT '{term}' AS term, round((out{i}.rss - in{i}.rss) / 1e6, 4) AS sum_sq, 1::BIGINT AS df, round((out{i}.rss - in{i}.rss) / (whole.rss / (whole.n - 5)), 4) AS f FROM whole, out{i}, in{i}")
    rows.append("SELECT 'Residual', round(rss / 1e6, 2), n - 5, NULL FROM whole")
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(rows)


@add("anova_type_two", _type_two())
def anova_two(spark, sf_dir):
    """Sums of squares in millions."""
    rows = experiments.anova(lines(spark, sf_dir), "l_extendedprice ~ l_quantity * l_discount + l_tax")
    rest = lambda r: r["term"] == "Residual"
    return spark.createDataFrame([(r["term"], round(r["sum_sq"] / 1e6, 2 if rest(r) else 4), int(r["df"]), None if rest(r) else round(r["f"], 4)) for r in rows], "term string, sum_sq double, df long, f double")


@add("model_selection")
def selection(spark, sf_dir):
    """The price of a line is made to depend on its quantity; the other terms are noise that BIC drops."""
    df = lines(spark, sf_dir).withColumn("y", F.col("l_extendedprice") + 2000 * F.col("l_quantity"))
    return spark.createDataFrame([(t,) for t in experiments.select_model(df, "y ~ l_quantity * l_discount + l_tax", "bic")], "term string")


@add(
    "box_cox",
    """WITH g AS (SELECT i / 10.0 AS g FROM range(-20, 21) t(i)), v AS (SELECT g, var_pop(CASE WHEN g = 0 THEN ln(l_extendedprice) ELSE (l_extendedprice ^ g - 1) / g END) AS v, sum(ln(l_extendedprice)) AS logs, count(*) AS n FROM lineitem, g WHERE l_extendedprice > 0 GROUP BY 1),
    l AS (SELECT g, n, -n / 2.0 * ln(v) + (g - 1) * logs AS l FROM v) SELECT g::DOUBLE AS lambda, round(l / n, 6) AS mean_log_likelihood, n FROM l ORDER BY l DESC LIMIT 1""",
)
def box_cox(spark, sf_dir):
    out = experiments.box_cox(lines(spark, sf_dir), "l_extendedprice")
    return spark.createDataFrame([(out["lambda"], round(out["log_likelihood"] / out["n"], 6), out["n"])], "lambda double, mean_log_likelihood double, n long")


@add(
    "curvature_test",
    """WITH d AS (SELECT sign(l_linenumber - 4) AS a, l_extendedprice AS y FROM lineitem), s AS (SELECT avg(y) FILTER (WHERE a = 0) AS c, avg(y) FILTER (WHERE a <> 0) AS u, count(*) FILTER (WHERE a = 0) AS nc, count(*) FILTER (WHERE a <> 0) AS nf, var_samp(y) FILTER (WHERE a = 0) AS v FROM d)
    SELECT round(u - c, 4) AS difference, round(nc * nf * (u - c) ^ 2 / (nc + nf) / v, 6) AS f FROM s""",
)
def curvature(spark, sf_dir):
    df = lines(spark, sf_dir).select(F.signum((F.col("l_linenumber") - 4).cast("double")).alias("a"), F.col("l_extendedprice").alias("y"))
    out = experiments.curvature(df, "y", ["a"])
    return spark.createDataFrame([(round(out["difference"], 4), round(out["f"], 6))], "difference double, f double")


@add(
    "pls_jackknife",
    f"""WITH g AS (SELECT g FROM range(-1, 20) t(g)), base AS (SELECT g, {S.correlations(PLS_X, "l_extendedprice")} FROM lineitem, g WHERE l_orderkey % 20 <> g GROUP BY g), {S.pls_two("base")},
    b AS (SELECT g, unnest(range(1, 4)) AS i, {S.plus(S.scaled("r1", "q1"), "r2", "q2")} AS v, s, sy FROM pls), c AS (SELECT g, i, v[i] * sy / s[i] AS b FROM b)
    SELECT {"CASE i " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(PLS_X, 1)) + " END"} AS variable, round(max(b) FILTER (WHERE g = -1), 3) AS beta, round(sqrt(19.0 / 20 * var_pop(b) FILTER (WHERE g >= 0) * 20), 3) AS standard_error FROM c GROUP BY i""",
)
def jackknife(spark, sf_dir):
    pivot, groups = resampling.grouped_moments(lines(spark, sf_dir), [*PLS_X, "l_extendedprice"], 20, F.pmod("l_orderkey", F.lit(20)))
    whole, se = resampling.jackknife(groups, lambda n, s, p: latent.PLS.of_products(n, s, p, PLS_X, ["l_extendedprice"], 2, pivot=pivot).beta[:, 0])
    return spark.createDataFrame([(c, round(float(b), 3), round(float(e), 3)) for c, b, e in zip(PLS_X, whole, se, strict=True)], "variable string, beta double, standard_error double")


@add("grouped_products", "SELECT " + ", ".join(f"round(sum({c}), 3) AS {c}" for c in X) + ", count(*) AS n FROM lineitem")
def grouped(spark, sf_dir):
    groups = resampling.grouped_products(lines(spark, sf_dir), X, 8, "l_orderkey")
    total = sum(g[1] for g in groups)
    return spark.createDataFrame([(*(round(float(v), 3) for v in total), sum(g[0] for g in groups))], ", ".join([*(f"{c} double" for c in X), "n long"]))


@add(
    "durbin_watson",
    """WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem), e AS (SELECT l_orderkey * 10 + l_linenumber AS o, l_extendedprice - a - b * l_quantity AS e FROM lineitem, m),
    d AS (SELECT o, first(e ORDER BY e) AS e FROM e GROUP BY o HAVING count(*) = 1), l AS (SELECT e, e - lag(e) OVER (ORDER BY o) AS d FROM d) SELECT round(sum(d ^ 2) / sum(e ^ 2), 6) AS durbin_watson FROM l""",
)
def durbin_watson(spark, sf_dir):
    """Of lines whose place in the order is theirs alone."""
    df = lines(spark, sf_dir).withColumn("o", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    rows = linear.OLS.fit(df, "l_extendedprice", ["l_quantity"]).residuals(df)
    rows = rows.groupBy("o").agg(F.min("residual").alias("residual"), F.min("y_hat").alias("y_hat"), F.count("*").alias("n")).filter("n = 1")
    return spark.createDataFrame([(round(experiments.residual_tests(rows, "residual", "o", "y_hat")["durbin_watson"], 6),)], "durbin_watson double")
