"""Queries of regression and latent-variable models."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import latent, linear, validation
from millrace.operators.scaling import Scaler
from millrace.plans import sqlparts as S
from millrace.plans.catalog import add
from millrace.plans.stats import rounded, table

X = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *X)


def scaled(spark, sf_dir, columns=X):
    df = lines(spark, sf_dir)
    return Scaler.fit(df, columns).transform(df)


@add("gram_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(sum({a} * {b}) / 1e6, 4) AS x FROM lineitem" for i, a in enumerate(X) for b in X[i:]))
def gram_matrix(spark, sf_dir):
    _, _, products = linear.gram(lines(spark, sf_dir), X)
    return spark.createDataFrame([(a, b, round(float(products[i, i + j]) / 1e6, 4)) for i, a in enumerate(X) for j, b in enumerate(X[i:])], "a string, b string, x double")


@add(
    "ols_one_predictor",
    """SELECT round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2,
    round(sqrt((regr_syy(l_extendedprice, l_quantity) - regr_sxy(l_extendedprice, l_quantity) ^ 2 / regr_sxx(l_extendedprice, l_quantity)) / (count(*) - 2)), 4) AS standard_error, count(*) AS n FROM lineitem""",
)
def ols_one(spark, sf_dir):
    s = linear.OLS.fit(lines(spark, sf_dir), "l_extendedprice", ["l_quantity"]).summary()
    return spark.createDataFrame([(round(s["coefficients"][0], 4), round(s["coefficients"][1], 4), round(s["r2"], 6), round(s["standard_error"], 4), s["n"])], "intercept double, slope double, r2 double, standard_error double, n long")


@add(
    "ols_predictions",
    """WITH m AS (SELECT avg(l_extendedprice) AS y, avg(l_quantity) AS a, avg(l_tax) AS b FROM lineitem), s AS (SELECT sum((l_quantity - a) ^ 2) AS aa, sum((l_tax - b) ^ 2) AS bb, sum((l_quantity - a) * (l_tax - b)) AS ab, sum((l_quantity - a) * (l_extendedprice - y)) AS ay, sum((l_tax - b) * (l_extendedprice - y)) AS by_ FROM lineitem, m),
    c AS (SELECT (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS p, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS q FROM s)
    SELECT l_orderkey, l_linenumber, round(y + p * (l_quantity - a) + q * (l_tax - b), 3) AS y_hat FROM lineitem, m, c""",
)
def ols_predictions(spark, sf_dir):
    df = lines(spark, sf_dir)
    return linear.OLS.fit(df, "l_extendedprice", ["l_quantity", "l_tax"]).predict(df).select("l_orderkey", "l_linenumber", F.round("y_hat", 3).alias("y_hat"))


TWO_MEANS = "m AS (SELECT avg(l_extendedprice) AS y, avg(l_quantity) AS a, avg(l_tax) AS b, count(*) AS n FROM lineitem)"
TWO_SUMS = "s AS (SELECT sum((l_quantity - a) ^ 2) AS aa, sum((l_tax - b) ^ 2) AS bb, sum((l_quantity - a) * (l_tax - b)) AS ab, sum((l_quantity - a) * (l_extendedprice - y)) AS ay, sum((l_tax - b) * (l_extendedprice - y)) AS by_, sum((l_extendedprice - y) ^ 2) AS yy FROM lineitem, m)"


@add(
    "ols_residual_diagnostics",
    f"""WITH {TWO_MEANS}, {TWO_SUMS}, c AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS p, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS q FROM s, m),
    e AS (SELECT l_orderkey, l_linenumber, l_extendedprice - y - p * (l_quantity - a) - q * (l_tax - b) AS r, 1.0 / n + ((l_quantity - a) ^ 2 * bb - 2 * (l_quantity - a) * (l_tax - b) * ab + (l_tax - b) ^ 2 * aa) / (aa * bb - ab * ab) AS h, (yy - p * ay - q * by_) / (n - 3) AS s2 FROM lineitem, c)
    SELECT l_orderkey, l_linenumber, round(r, 3) AS residual, round(h * 1e3, 6) AS leverage, round(r / sqrt(s2 * (1 - h)), 5) AS studentised, round(r ^ 2 / (s2 * (1 - h)) * h / (1 - h) / 3 * 1e3, 5) AS cooks_distance FROM e""",
)
def ols_residuals(spark, sf_dir):
    """Leverage and Cook's distance in thousandths."""
    df = lines(spark, sf_dir)
    out = linear.OLS.fit(df, "l_extendedprice", ["l_quantity", "l_tax"]).residuals(df)
    return out.select("l_orderkey", "l_linenumber", F.round("residual", 3).alias("residual"), F.round(F.col("leverage") * 1e3, 6).alias("leverage"), F.round("studentised", 5).alias("studentised"), F.round(F.col("cooks_distance") * 1e3, 5).alias("cooks_distance"))


@add(
    "ols_prediction_scale",
    f"""WITH {TWO_MEANS}, {TWO_SUMS}, c AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS p, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS q FROM s, m)
    SELECT round(sqrt((yy - p * ay - q * by_) / (n - 3)), 4) AS standard_error, round(1 - (yy - p * ay - q * by_) / yy, 6) AS r2, round(1 - (yy - p * ay - q * by_) / yy * (n - 1) / (n - 3), 6) AS adjusted_r2, round((p * ay + q * by_) / 2 / ((yy - p * ay - q * by_) / (n - 3)), 3) AS f_statistic, n - 3 AS dof FROM c""",
)
def ols_summary(spark, sf_dir):
    s = linear.OLS.fit(lines(spark, sf_dir), "l_extendedprice", ["l_quantity", "l_tax"]).summary()
    return spark.createDataFrame([(round(s["standard_error"], 4), round(s["r2"], 6), round(s["adjusted_r2"], 6), round(s["f_statistic"], 3), s["dof"])], "standard_error double, r2 double, adjusted_r2 double, f_statistic double, dof long")


@add("lm_formula")
def lm_formula(spark, sf_dir):
    fit = linear.lm(lines(spark, sf_dir), "l_extendedprice ~ l_quantity * l_discount + I(l_quantity ** 2)")
    s = fit.summary()
    return spark.createDataFrame([(n, *map(float, v)) for n, *v in zip(s["names"], s["coefficients"], s["standard_errors"], s["t_values"], s["p_values"], strict=True)], "term string, coefficient double, standard_error double, t double, p_value double")


@add(
    "robust_regression",
    """WITH p AS (SELECT p_brand, p_partkey, p_size::DOUBLE AS x, p_retailprice AS y FROM part), d AS (SELECT a.p_brand, a.p_partkey, median((b.y - a.y) / (b.x - a.x)) AS m FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.x <> b.x GROUP BY 1, 2),
    s AS (SELECT p_brand, median(m) AS m FROM d GROUP BY 1), i AS (SELECT p_brand, max(m) AS m, median(y - m * x) AS c, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) * count(*) AS sx FROM p JOIN s USING (p_brand) GROUP BY 1),
    r AS (SELECT p_brand, n, c, m, mx, sx, sum((y - c - m * x) ^ 2) AS rss, sum((c + m * x - my) ^ 2) AS reg FROM p JOIN i USING (p_brand) GROUP BY ALL)
    SELECT p_brand, n, round(c, 4) AS intercept, round(m, 5) AS slope, round(sqrt(rss / (n - 2)) * sqrt(1.0 / n + mx ^ 2 / sx), 4) AS se_intercept, round(sqrt(rss / (n - 2) / sx), 5) AS se_slope, round(reg / (reg + rss), 6) AS r2, round(sqrt(rss / (n - 2)), 4) AS standard_error FROM r""",
)
def robust_regression(spark, sf_dir):
    out = linear.robust_regression(table(spark, sf_dir, "part"), "p_size", "p_retailprice", ["p_brand"])
    return out.select("p_brand", "n", *(F.round(c, d).alias(c) for c, d in (("intercept", 4), ("slope", 5), ("se_intercept", 4), ("se_slope", 5), ("r2", 6), ("standard_error", 4))))


@add(
    "pca_two_variables",
    """WITH m AS (SELECT avg(l_quantity) AS a, stddev_samp(l_quantity) AS s, avg(l_extendedprice) AS b, stddev_samp(l_extendedprice) AS u, count(*) AS n, corr(l_quantity, l_extendedprice) AS r FROM lineitem),
    z AS (SELECT l_orderkey, l_linenumber, (l_quantity - a) / s AS x, (CASE WHEN r < 0 THEN -1 ELSE 1 END) * (l_extendedprice - b) / u AS y, abs(r) AS r FROM lineitem, m)
    SELECT l_orderkey, l_linenumber, round((x + y) / sqrt(2), 3) AS t1, round(((x + y) / sqrt(2)) ^ 2 / (1 + r), 3) AS hotellings_t2, round(abs(x - y) / sqrt(2), 3) AS spe FROM z""",
)
def pca_two(spark, sf_dir):
    columns = ["l_quantity", "l_extendedprice"]
    df = scaled(spark, sf_dir, columns)
    return rounded(latent.PCA.fit(df, columns, 1).diagnose(df).select("l_orderkey", "l_linenumber", "t1", "hotellings_t2", "spe"), 3)


@add("pca_diagnostics")
def pca_diagnostics(spark, sf_dir):
    df = scaled(spark, sf_dir)
    fit = latent.PCA.fit(df, X, 2)
    return fit.diagnose(df).withColumn("out_of_limits", (F.col("hotellings_t2") > fit.t2_limit()) | (F.col("spe") > fit.spe_limit()))


@add("pca_outliers")
def pca_outliers(spark, sf_dir):
    df = scaled(spark, sf_dir)
    return latent.PCA.fit(df, X, 2).detect_outliers(df, 0.99)


@add("pca_contributions")
def pca_contributions(spark, sf_dir):
    df = scaled(spark, sf_dir)
    fit = latent.PCA.fit(df, X, 2)
    return fit.spe_contributions(fit.t2_contributions(df))


@add("pca_embeddings")
def pca_embeddings(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select("vec_id", *(F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)))
    columns = [f"e{i}" for i in range(64)]
    return latent.PCA.fit(df, columns, 5).diagnose(df).select("vec_id", *(f"t{i}" for i in range(1, 6)), "hotellings_t2", "spe")


@add("pca_missing_cells")
def pca_missing(spark, sf_dir):
    df = scaled(spark, sf_dir).withColumn("l_tax", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_tax")))
    fit = latent.fit_missing(df, X, 1)
    return spark.createDataFrame([(c, float(p)) for c, p in zip(X, fit.loadings[:, 0], strict=True)], "variable string, p1 double")


PLS_X = ["l_quantity", "l_discount", "l_tax"]
PLS_Z = "[" + ", ".join(f"({c} - m[{i}]) / s[{i}]" for i, c in enumerate(PLS_X, 1)) + "]"


@add(
    "pls_predictions",
    f"""WITH base AS (SELECT {S.correlations(PLS_X, "l_extendedprice")} FROM lineitem), {S.pls_two("base")},
    z AS (SELECT l_orderkey, l_linenumber, {PLS_Z} AS z, pls.* FROM lineitem, pls), t AS (SELECT *, {S.dot("z", "r1")} AS t1, {S.dot("z", "r2")} AS t2 FROM z),
    e AS (SELECT *, {S.plus(S.plus("z", "p1", "-t1"), "p2", "-t2")} AS e FROM t)
    SELECT l_orderkey, l_linenumber, round(t1, 5) AS t1, round(t2, 5) AS t2, round(t1 ^ 2 / v1 + t2 ^ 2 / v2, 5) AS hotellings_t2, round(sqrt({S.dot("e", "e")}), 5) AS spe, round((t1 * q1 + t2 * q2) * sy + my, 2) AS l_extendedprice_hat FROM e""",
)
def pls_predictions(spark, sf_dir):
    df = lines(spark, sf_dir)
    out = latent.PLS.fit(df, PLS_X, ["l_extendedprice"], 2).diagnose(df)
    return out.select("l_orderkey", "l_linenumber", *(F.round(c, 5).alias(c) for c in ("t1", "t2", "hotellings_t2", "spe")), F.round("l_extendedprice_hat", 2).alias("l_extendedprice_hat"))


@add("pls_select_components")
def pls_select(spark, sf_dir):
    rows = latent.select_components(lines(spark, sf_dir), ["l_quantity", "l_discount", "l_tax"], ["l_extendedprice"], 3)
    return spark.createDataFrame([(r["components"], r["rmsecv"], r["q2"]) for r in rows], "components int, rmsecv double, q2 double")


@add(
    "opls_predictions",
    f"""WITH base AS (SELECT {S.correlations(PLS_X, "l_extendedprice")} FROM lineitem), a AS (SELECT *, {S.scaled("c", f"1 / sqrt({S.dot('c', 'c')})")} AS w FROM base),
    b AS (SELECT *, {S.scaled(S.times("r", "w"), f"1 / {S.dot('w', S.times('r', 'w'))}")} AS p FROM a), d AS (SELECT *, {S.plus("p", "w", f"-{S.dot('w', 'p')}")} AS o0 FROM b), e AS (SELECT *, {S.scaled("o0", f"1 / sqrt({S.dot('o0', 'o0')})")} AS o FROM d),
    f AS (SELECT *, {S.scaled(S.times("r", "o"), f"1 / {S.dot('o', S.times('r', 'o'))}")} AS q FROM e), g AS (SELECT *, {S.plus("w", "o", f"-{S.dot('q', 'w')}")} AS v FROM f), h AS (SELECT *, {S.dot("w", "c")} / {S.dot("v", S.times("r", "v"))} AS qy FROM g),
    z AS (SELECT l_orderkey, l_linenumber, {PLS_Z} AS zs, h.* FROM lineitem, h), t AS (SELECT *, {S.dot(S.plus("zs", "q", f"-{S.dot('zs', 'o')}"), "w")} AS t FROM z)
    SELECT l_orderkey, l_linenumber, round(t, 5) AS t_predictive, round(t * qy * sy + my, 2) AS l_extendedprice_hat FROM t""",
)
def opls(spark, sf_dir):
    df = lines(spark, sf_dir)
    out = latent.OPLS.fit(df, PLS_X, "l_extendedprice", 1).transform(df)
    return out.select("l_orderkey", "l_linenumber", F.round("t_predictive", 5).alias("t_predictive"), F.round("l_extendedprice_hat", 2).alias("l_extendedprice_hat"))


BLOCKS = {"amount": ["l_quantity"], "rates": ["l_discount"]}
#: Two blocks of one column each have unit weights, so super scores are sums and differences of scaled columns.
PAIR = "WITH m AS (SELECT avg(l_quantity) AS a, stddev_samp(l_quantity) AS s, avg(l_discount) AS b, stddev_samp(l_discount) AS u, corr(l_quantity, l_discount) AS r, avg(l_extendedprice) AS my, stddev_samp(l_extendedprice) AS sy, corr(l_quantity, l_extendedprice) AS ca, corr(l_discount, l_extendedprice) AS cb FROM lineitem), z AS (SELECT l_orderkey, l_linenumber, (l_quantity - a) / s AS x, (l_discount - b) / u AS y, m.* FROM lineitem, m)"


@add(
    "multi_block_pca",
    f"""{PAIR}, v AS (SELECT *, CASE WHEN r >= 0 THEN 1 ELSE -1 END AS g FROM z), w AS (SELECT *, (x + g * y) / sqrt(2) AS t FROM v)
    SELECT l_orderkey, l_linenumber, round(abs(t), 4) AS super_t, round(abs(x), 4) AS amount_t, round(abs(y), 4) AS rates_t, round(abs(x - t / sqrt(2)), 4) AS amount_spe, round(abs(y - g * t / sqrt(2)), 4) AS rates_spe, round(sqrt((x - t / sqrt(2)) ^ 2 + (y - g * t / sqrt(2)) ^ 2), 4) AS super_spe, round(t ^ 2 / (1 + abs(r)), 4) AS hotellings_t2 FROM w""",
)
def multi_block(spark, sf_dir):
    """Scores without their signs."""
    df = lines(spark, sf_dir)
    out = latent.MultiBlock.fit(df, BLOCKS, 1).diagnose(df)
    scores = [F.round(F.abs(c), 4).alias(n) for c, n in (("super_t1", "super_t"), ("amount_t1", "amount_t"), ("rates_t1", "rates_t"))]
    return out.select("l_orderkey", "l_linenumber", *scores, *(F.round(c, 4).alias(c) for c in ("amount_spe", "rates_spe", "super_spe", "hotellings_t2")))


@add(
    "multi_block_pls",
    f"""{PAIR}, w AS (SELECT *, ca / sqrt(ca ^ 2 + cb ^ 2) AS wa, cb / sqrt(ca ^ 2 + cb ^ 2) AS wb FROM z), t AS (SELECT *, x * wa + y * wb AS t, 1 + 2 * wa * wb * r AS v FROM w), p AS (SELECT *, (wa + r * wb) / v AS pa, (r * wa + wb) / v AS pb, (ca * wa + cb * wb) / v AS q FROM t)
    SELECT l_orderkey, l_linenumber, round(abs(t), 4) AS super_t, round(sqrt((x - t * pa) ^ 2 + (y - t * pb) ^ 2), 4) AS super_spe, round(t ^ 2 / v, 4) AS hotellings_t2, round(t * q * sy + my, 2) AS l_extendedprice_hat FROM p""",
)
def multi_block_pls(spark, sf_dir):
    df = lines(spark, sf_dir)
    out = latent.MultiBlock.fit(df, BLOCKS, 1, y=["l_extendedprice"]).diagnose(df)
    return out.select("l_orderkey", "l_linenumber", F.round(F.abs("super_t1"), 4).alias("super_t"), F.round("super_spe", 4).alias("super_spe"), F.round("hotellings_t2", 4).alias("hotellings_t2"), F.round("l_extendedprice_hat", 2).alias("l_extendedprice_hat"))


@add("multi_block_diagnostics")
def multi_block_diagnostics(spark, sf_dir):
    """Two components of wider blocks, with limits and contributions."""
    df = lines(spark, sf_dir)
    model = latent.MultiBlock.fit(df, {"amounts": ["l_quantity", "l_extendedprice"], "rates": ["l_discount", "l_tax"]}, 2)
    out = model.spe_contributions(model.score_contributions(model.diagnose(df), 2))
    beyond = (F.col("hotellings_t2") > model.t2_limit()) | (F.col("super_spe") > model.super_spe_limit()) | (F.col("rates_spe") > model.block_spe_limit("rates"))
    return out.withColumn("out_of_limits", beyond)


@add("multi_block_weights", "WITH m AS (SELECT corr(l_quantity, l_extendedprice) AS ca, corr(l_discount, l_extendedprice) AS cb FROM lineitem) SELECT 'amount' AS block, round(abs(ca) / sqrt(ca ^ 2 + cb ^ 2), 5) AS weight FROM m UNION ALL SELECT 'rates', round(abs(cb) / sqrt(ca ^ 2 + cb ^ 2), 5) FROM m")
def multi_block_weights(spark, sf_dir):
    model = latent.MultiBlock.fit(lines(spark, sf_dir), BLOCKS, 1, y=["l_extendedprice"])
    return spark.createDataFrame([(b, round(float(w), 5)) for b, w in zip(BLOCKS, model.super_weights()[:, 0], strict=True)], "block string, weight double")


LINE = ["l_orderkey", "l_linenumber"]


@add("pls_permutation_risk")
def permutation_risk(spark, sf_dir):
    """999 draws of signs, in one pass."""
    df = lines(spark, sf_dir).withColumn("y", F.col("l_extendedprice") + 2000 * F.col("l_quantity"))
    return spark.createDataFrame([(r["component"], r["statistic"], r["risk"]) for r in validation.component_risk(df, PLS_X, "y", 2, key=LINE)], "component int, statistic double, risk double")


@add("pls_compare_components")
def compare_components(spark, sf_dir):
    found = validation.compare_components(lines(spark, sf_dir), PLS_X, ["l_extendedprice"], 3, key=LINE)
    return spark.createDataFrame([(a + 1, *row, a + 1 == found.recommended) for a, row in enumerate(zip(found.rmsecv, found.excess, found.p_values, strict=True))], "components int, rmsecv double, excess double, p_value double, recommended boolean")


@add(
    "pls_out_of_fold_error",
    """WITH p AS (SELECT l_orderkey % 5 AS f, l_quantity AS x, l_extendedprice AS y FROM lineitem), w AS (SELECT f, x, y, CAST(g.range AS BIGINT) AS held FROM p, range(5) g WHERE f <> g.range),
    m AS (SELECT held, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM w GROUP BY 1), s AS (SELECT stddev_samp(y) AS s FROM p)
    SELECT round(sqrt(avg(((y - a - b * x) / s) ^ 2)), 8) AS rmsecv FROM p JOIN m ON held = f, s""",
)
def out_of_fold_error(spark, sf_dir):
    """One x, one component: least squares, fold by fold."""
    found = validation.compare_components(lines(spark, sf_dir), ["l_quantity"], ["l_extendedprice"], 1, key=LINE, fold=F.col("l_orderkey") % 5)
    return spark.createDataFrame([(round(found.rmsecv[0], 8),)], "rmsecv double")


@add("pca_press_by_cells")
def press_by_cells(spark, sf_dir):
    found = validation.press_by_cells(lines(spark, sf_dir), X, 3, key=LINE)
    return spark.createDataFrame([(a + 1, float(v), a + 1 == found.recommended()) for a, v in enumerate(found.press)], "components int, press double, recommended boolean")


@add("fractional_slopes")
def fractional_slopes(spark, sf_dir):
    """PLS coefficients of repeated fractions of four fifths of the lines."""
    def slopes(n, sums, products):
        return latent.PLS.of_products(n, sums, products, PLS_X, ["l_extendedprice"], 2).beta[:, 0]

    found = validation.fractional(lines(spark, sf_dir), [*PLS_X, "l_extendedprice"], slopes, key=LINE)
    return spark.createDataFrame([(c, *map(float, row)) for c, *row in zip(PLS_X, *found, strict=True)], "variable string, slope double, mean double, low double, high double")


@add(
    "rv_coefficient",
    """WITH c AS (SELECT covar_samp(l_quantity, l_discount) AS ad, covar_samp(l_quantity, l_tax) AS at_, covar_samp(l_extendedprice, l_discount) AS bd, covar_samp(l_extendedprice, l_tax) AS bt, var_samp(l_quantity) AS aa, var_samp(l_extendedprice) AS bb, covar_samp(l_quantity, l_extendedprice) AS ab, var_samp(l_discount) AS dd, var_samp(l_tax) AS tt, covar_samp(l_discount, l_tax) AS dt FROM lineitem)
    SELECT round((ad ^ 2 + at_ ^ 2 + bd ^ 2 + bt ^ 2) / sqrt((aa ^ 2 + bb ^ 2 + 2 * ab ^ 2) * (dd ^ 2 + tt ^ 2 + 2 * dt ^ 2)), 6) AS rv FROM c""",
)
def rv(spark, sf_dir):
    return spark.createDataFrame([(round(latent.rv_coefficient(lines(spark, sf_dir), X[:2], X[2:]), 6),)], "rv double")


@add("pca_group_contributions")
def group_contributions(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", *X)
    df = Scaler.fit(df, X).transform(df)
    found = latent.group_contributions(latent.PCA.fit(df, X, 2), df, F.col("l_returnflag") == "A")
    return spark.createDataFrame(list(found.items()), "variable string, contribution double")


@add(
    "pca_project_variables",
    """WITH z AS (SELECT (l_quantity - avg(l_quantity) OVER ()) / stddev_samp(l_quantity) OVER () + (l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_samp(l_extendedprice) OVER () AS t, l_tax, l_discount FROM lineitem)
    SELECT 'l_tax' AS variable, round(corr(l_tax, t), 6) AS t1 FROM z UNION ALL SELECT 'l_discount', round(corr(l_discount, t), 6) FROM z""",
)
def project_variables(spark, sf_dir):
    columns = ["l_quantity", "l_extendedprice"]
    df = scaled(spark, sf_dir, columns)
    found = latent.project_variables(latent.PCA.fit(df, columns, 1), df, ["l_tax", "l_discount"])
    return spark.createDataFrame([(c, round(v[0], 6)) for c, v in found.items()], "variable string, t1 double")


@add("pls_prediction_interval")
def pls_interval(spark, sf_dir):
    df = lines(spark, sf_dir)
    x = ["l_quantity", "l_discount", "l_tax"]
    rmse = latent.select_components(df, x, ["l_extendedprice"], 1)[0]["rmsecv"]
    model = latent.PLS.fit(df, x, ["l_extendedprice"], 1)
    return latent.prediction_interval(model, df, rmse * float(model.scale[-1]))


@add(
    "dataset_effects",
    """WITH d(C, T, S, y) AS (VALUES (-1, -1, -1, 5), (1, -1, -1, 30), (-1, 1, -1, 6), (1, 1, -1, 33), (-1, -1, 1, 4), (1, -1, 1, 3), (-1, 1, 1, 5), (1, 1, 1, 4))
    SELECT t.term, round(avg(t.x * y) * 2, 6) AS effect FROM d, LATERAL (VALUES ('C', C), ('T', T), ('S', S), ('C:T', C * T), ('C:S', C * S), ('T:S', T * S)) t(term, x) GROUP BY 1""",
)
def dataset_effects(spark, sf_dir):
    from millrace.operators import doe
    from millrace.sources.datasets import data

    return rounded(doe.effects(data(spark, "pollutant"), "y", ["C", "T", "S"]))


@add("pca_trimmed_scores")
def pca_trimmed(spark, sf_dir):
    df = scaled(spark, sf_dir).withColumn("l_tax", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_tax")))
    fit, mean = latent.fit_tsr(df, X, 2)
    return spark.createDataFrame([(c, *map(float, p), float(m)) for c, p, m in zip(X, fit.loadings, mean, strict=True)], "variable string, p1 double, p2 double, mean double")


@add("pca_reconstruction", f"{PAIR}, t AS (SELECT l_orderkey, l_linenumber, (x + CASE WHEN r >= 0 THEN 1 ELSE -1 END * y) / 2 AS h, r FROM z) SELECT l_orderkey, l_linenumber, round(h, 4) AS l_quantity_hat, round(CASE WHEN r >= 0 THEN h ELSE -h END, 4) AS l_discount_hat FROM t")
def pca_reconstruction(spark, sf_dir):
    columns = ["l_quantity", "l_discount"]
    df = scaled(spark, sf_dir, columns)
    out = latent.PCA.fit(df, columns, 1).reconstruct(df)
    return rounded(out.select("l_orderkey", "l_linenumber", "l_quantity_hat", "l_discount_hat"), 4)


@add("pca_score", "SELECT round((1 + abs(corr(l_quantity, l_discount))) / 2, 6) AS r2 FROM lineitem")
def pca_score(spark, sf_dir):
    columns = ["l_quantity", "l_discount"]
    df = scaled(spark, sf_dir, columns)
    return spark.createDataFrame([(round(latent.PCA.fit(df, columns, 1).score(df), 6),)], "r2 double")


@add("pls_score", f"WITH base AS (SELECT {S.correlations(PLS_X, 'l_extendedprice')} FROM lineitem), {S.pls_two('base')} SELECT round(q1 ^ 2 * v1 + q2 ^ 2 * v2, 6) AS r2 FROM pls")
def pls_score(spark, sf_dir):
    df = lines(spark, sf_dir)
    return spark.createDataFrame([(round(latent.PLS.fit(df, PLS_X, ["l_extendedprice"], 2).score(df)["l_extendedprice"], 6),)], "r2 double")


@add(
    "pls_target_projection",
    f"""WITH base AS (SELECT {S.correlations(PLS_X, "l_extendedprice")} FROM lineitem), {S.pls_two("base")}, b AS (SELECT *, {S.plus(S.scaled("r1", "q1"), "r2", "q2")} AS b0 FROM pls), u AS (SELECT *, {S.scaled("b0", f"1 / sqrt({S.dot('b0', 'b0')})")} AS b FROM b), z AS (SELECT l_orderkey, l_linenumber, {PLS_Z} AS zs, b FROM lineitem, u)
    SELECT l_orderkey, l_linenumber, round({S.dot("zs", "b")}, 5) AS t_target FROM z""",
)
def target_projection(spark, sf_dir):
    df = lines(spark, sf_dir)
    return rounded(latent.PLS.fit(df, PLS_X, ["l_extendedprice"], 2).target_projection(df).select("l_orderkey", "l_linenumber", "t_target"), 5)


@add("pls_outliers")
def pls_outliers(spark, sf_dir):
    df = lines(spark, sf_dir)
    return latent.PLS.fit(df, PLS_X, ["l_extendedprice"], 2).detect_outliers(df, 0.99)


@add("pls_nested_cv")
def pls_nested(spark, sf_dir):
    rows = latent.nested_cv(lines(spark, sf_dir), PLS_X, ["l_extendedprice"], 3)
    return spark.createDataFrame([(r["fold"], r["components"], r["rmsep"], r["n"]) for r in rows], "fold int, components int, rmsep double, n long")
