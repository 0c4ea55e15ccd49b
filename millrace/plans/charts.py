"""Queries of the data of charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import chartdata, doe, latent, linear
from millrace.plans import sqlparts as S
from millrace.plans.catalog import add
from millrace.plans.designed import BOUNDS, CELLS_SQL, COST, STRENGTH, surfaces
from millrace.plans.experiments import SIGNS
from millrace.plans.models import PAIR, PLS_X, PLS_Z, lines, scaled
from millrace.plans.stats import rounded, table



def signs(spark, sf_dir):
    sign = lambda c, v: F.when(F.col(c) == v, 1).otherwise(-1)
    return table(spark, sf_dir, "lineitem").select(sign("l_returnflag", "A").alias("A"), sign("l_linestatus", "O").alias("B"), F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(-1).alias("C"), F.col("l_extendedprice").alias("y"))


@add("chart_main_effects", f"WITH d AS ({SIGNS}) SELECT factor, level::VARCHAR AS level, round(avg(y), 4) AS mean, count(*) AS n FROM d, LATERAL (VALUES ('A', A), ('B', B), ('C', C)) t(factor, level) GROUP BY 1, 2")
def main_effects(spark, sf_dir):
    return rounded(chartdata.create("main_effects", signs(spark, sf_dir), "y", ["A", "B", "C"]), 4)


@add("chart_interactions", f"WITH d AS ({SIGNS}) SELECT A, B, round(avg(y), 4) AS mean, count(*) AS n FROM d GROUP BY 1, 2")
def interactions(spark, sf_dir):
    return rounded(chartdata.create("interactions", signs(spark, sf_dir), "y", "A", "B"), 4)


@add("chart_cube", f"WITH d AS ({SIGNS}) SELECT A, B, C, round(avg(y), 4) AS mean, count(*) AS n FROM d GROUP BY 1, 2, 3")
def cube(spark, sf_dir):
    return rounded(chartdata.create("corners", signs(spark, sf_dir), "y", ["A", "B", "C"], -1, 1), 4)


@add(
    "chart_pareto",
    f"WITH d AS ({SIGNS}), e AS (SELECT t.term, avg(y) FILTER (WHERE t.x > 0) - avg(y) FILTER (WHERE t.x < 0) AS effect FROM d, LATERAL (VALUES ('A', A), ('B', B), ('C', C), ('A:B', A * B), ('A:C', A * C), ('B:C', B * C)) t(term, x) GROUP BY 1) SELECT (row_number() OVER o)::INT AS position, term, round(effect, 4) AS effect, round(abs(effect), 4) AS size, round(sum(abs(effect)) OVER o / sum(abs(effect)) OVER (), 6) AS cumulative FROM e WINDOW o AS (ORDER BY abs(effect) DESC, term)",
)
def pareto(spark, sf_dir):
    out = chartdata.create("pareto", doe.effects(signs(spark, sf_dir), "y", ["A", "B", "C"]))
    return out.select("position", "term", F.round("effect", 4).alias("effect"), F.round("size", 4).alias("size"), F.round("cumulative", 6).alias("cumulative"))


@add("chart_half_normal")
def half_normal(spark, sf_dir):
    return chartdata.create("half_normal", doe.effects(signs(spark, sf_dir), "y", ["A", "B", "C"]))


@add("chart_box_cox", "WITH g AS (SELECT i / 10.0 AS g FROM range(-20, 21) t(i)) SELECT g::DOUBLE AS lambda, round(-0.5 * ln(var_pop(CASE WHEN g = 0 THEN ln(l_extendedprice) ELSE (l_extendedprice ^ g - 1) / g END)) + (g - 1) * avg(ln(l_extendedprice)), 5) AS log_likelihood FROM lineitem, g WHERE l_extendedprice > 0 GROUP BY g")
def box_cox(spark, sf_dir):
    return chartdata.create("box_cox_curve", lines(spark, sf_dir), "l_extendedprice").select("lambda", F.round("log_likelihood", 5).alias("log_likelihood"))


@add("chart_normal_probability", "WITH r AS (SELECT s_acctbal, row_number() OVER (ORDER BY s_acctbal) AS rank, count(*) OVER () AS n FROM supplier) SELECT s_acctbal, rank, round((rank - 0.375) / (n + 0.25), 6) AS probability FROM r")
def normal_probability(spark, sf_dir):
    return rounded(chartdata.create("normal_probability", table(spark, sf_dir, "supplier"), "s_acctbal").drop("quantile"))


@add("chart_perturbation", f"WITH {CELLS_SQL} SELECT factor, round(x, 6)::DOUBLE AS coded, round(s0 + b * x + q * x * x, 6)::DOUBLE AS response FROM (SELECT -1 + i * 0.1 AS x FROM range(21) t(i)), (SELECT 'A' AS factor, sa AS b, saa AS q, s0 FROM k UNION ALL SELECT 'B', sb, sbb, s0 FROM k)")
def perturbation(spark, sf_dir):
    return rounded(chartdata.create("perturbation", spark, surfaces(spark, sf_dir)[0]["strength"], ["A", "B"]))


@add("chart_contour", f"WITH {CELLS_SQL}, g AS (SELECT -1 + i * 0.1 AS A, -1 + j * 0.1 AS B FROM range(21) t(i), range(21) u(j)) SELECT round(A, 6)::DOUBLE AS A, round(B, 6)::DOUBLE AS B, round({STRENGTH}, 6)::DOUBLE AS response FROM g, k")
def contour(spark, sf_dir):
    return rounded(chartdata.create("contour", spark, surfaces(spark, sf_dir)[0]["strength"], BOUNDS))


@add("chart_overlay", f"WITH {CELLS_SQL}, g AS (SELECT -1 + i * 0.1 AS A, -1 + j * 0.1 AS B FROM range(21) t(i), range(21) u(j)), y AS (SELECT {STRENGTH} AS strength, {COST} AS cost, sm, c0 FROM g, k) SELECT count(*) AS points, count(*) FILTER (WHERE strength >= sm + 0.00123 AND cost <= c0 + 0.00123) AS feasible FROM y")
def overlay(spark, sf_dir):
    """Settings of no less than the mean price and no more than the mean tax of the cells, or hardly so."""
    found = surfaces(spark, sf_dir)[0]
    mean = found["strength"][()] + 2 / 3 * (found["strength"]["A", "A"] + found["strength"]["B", "B"])
    out = chartdata.create("overlay", spark, found, {"strength": (mean + 0.00123, None), "cost": (None, found["cost"][()] + 0.00123)}, BOUNDS)
    return out.agg(F.count("*").alias("points"), F.sum(F.col("feasible").cast("long")).alias("feasible"))


@add(
    "chart_prediction_variance",
    "WITH m AS (SELECT avg(l_quantity) AS a, avg(l_tax) AS b, var_pop(l_quantity) * count(*) AS aa, var_pop(l_tax) * count(*) AS bb, covar_pop(l_quantity, l_tax) * count(*) AS ab, count(*) AS n FROM lineitem), g AS (SELECT 1 + i * 4.9 AS x, j * 0.008 AS y FROM range(11) t(i), range(11) u(j)) SELECT round(x, 6)::DOUBLE AS l_quantity, round(y, 6)::DOUBLE AS l_tax, round(1e3 * (1.0 / n + ((x - a) ^ 2 * bb - 2 * (x - a) * (y - b) * ab + (y - b) ^ 2 * aa) / (aa * bb - ab ^ 2)), 6)::DOUBLE AS variance FROM g, m",
)
def variance(spark, sf_dir):
    """Variance in thousandths."""
    model = linear.OLS.fit(lines(spark, sf_dir), "l_extendedprice", ["l_quantity", "l_tax"])
    out = chartdata.create("prediction_variance", spark, model, {"l_quantity": (1.0, 50.0), "l_tax": (0.0, 0.08)}, 11)
    return rounded(out.withColumn("variance", F.col("variance") * 1e3))


@add("chart_design_space")
def design_space(spark, sf_dir):
    model = linear.OLS.fit(lines(spark, sf_dir), "l_extendedprice", ["l_quantity", "l_tax"])
    return chartdata.create("fraction_of_design_space", spark, model, {"l_quantity": (1.0, 50.0), "l_tax": (0.0, 0.08)}, 41)


@add("chart_ridge_trace")
def ridge(spark, sf_dir):
    return chartdata.create("ridge_trace", spark, surfaces(spark, sf_dir)[0]["strength"], ["A", "B"], [0.25 * k for k in range(1, 7)])


@add("chart_ascent", f"WITH {CELLS_SQL}, p AS (SELECT i, i * 0.5 * sa / sqrt(sa ^ 2 + sb ^ 2) AS A, i * 0.5 * sb / sqrt(sa ^ 2 + sb ^ 2) AS B, k.* FROM range(11) t(i), k) SELECT i::INT AS step, round(A, 6)::DOUBLE AS A, round(B, 6)::DOUBLE AS B, round({STRENGTH}, 6)::DOUBLE AS response FROM p")
def ascent(spark, sf_dir):
    return rounded(chartdata.create("ascent_path", spark, surfaces(spark, sf_dir)[0]["strength"], ["A", "B"]))


@add("chart_correlation_loadings", "WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem) SELECT 'l_quantity' AS variable, round(sqrt((1 + abs(r)) / 2), 6) AS t1 FROM c UNION ALL SELECT 'l_extendedprice', round((CASE WHEN r < 0 THEN -1 ELSE 1 END) * sqrt((1 + abs(r)) / 2), 6) FROM c")
def correlation_loadings(spark, sf_dir):
    columns = ["l_quantity", "l_extendedprice"]
    df = scaled(spark, sf_dir, columns)
    return rounded(chartdata.create("correlation_loadings", latent.PCA.fit(df, columns, 1), df))


@add("chart_explained_variance", "WITH c AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS r FROM lineitem) SELECT 1 AS component, round(1 + r, 6) AS eigenvalue, round(50 * (1 + r), 4) AS percent, round(50 * (1 + r), 4) AS cumulative FROM c UNION ALL SELECT 2, round(1 - r, 6), round(50 * (1 - r), 4), 100.0 FROM c")
def explained(spark, sf_dir):
    columns = ["l_quantity", "l_extendedprice"]
    out = chartdata.create("explained_variance", spark, latent.PCA.fit(scaled(spark, sf_dir, columns), columns, 2))
    return out.select("component", F.round("eigenvalue", 6).alias("eigenvalue"), F.round("percent", 4).alias("percent"), F.round("cumulative", 4).alias("cumulative"))


@add("chart_scores")
def scores(spark, sf_dir):
    df = scaled(spark, sf_dir)
    return chartdata.create("scores", latent.PCA.fit(df, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 2), df)


@add("chart_coefficients", f"{PAIR}, w AS (SELECT DISTINCT a, s, u, sy, ca, cb, (ca ^ 2 + cb ^ 2) / (ca ^ 2 + cb ^ 2 + 2 * ca * cb * r) AS q FROM z) SELECT 'l_quantity' AS variable, round(ca * q * sy / s, 4) AS coefficient FROM w UNION ALL SELECT 'l_discount', round(cb * q * sy / u, 4) FROM w")
def coefficients(spark, sf_dir):
    return rounded(chartdata.create("coefficients", spark, latent.PLS.fit(lines(spark, sf_dir), ["l_quantity", "l_discount"], ["l_extendedprice"], 1)), 4)


@add(
    "chart_predictions",
    f"""WITH base AS (SELECT {S.correlations(PLS_X, "l_extendedprice")} FROM lineitem), {S.pls_two("base")}, z AS (SELECT l_extendedprice, {PLS_Z} AS z, pls.* FROM lineitem, pls)
    SELECT l_extendedprice AS observed, round(({S.dot("z", "r1")} * q1 + {S.dot("z", "r2")} * q2) * sy + my, 2) AS predicted FROM z""",
)
def predictions(spark, sf_dir):
    df = lines(spark, sf_dir)
    out = chartdata.create("predictions_vs_observed", latent.PLS.fit(df, PLS_X, ["l_extendedprice"], 2), df)
    return out.withColumn("predicted", F.round("predicted", 2))


@add("chart_batches", "WITH p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS position, value, event_id::DOUBLE AS place FROM events), l AS (UNPIVOT p ON value, place INTO NAME tag VALUE value) SELECT user_id, position::INT AS position, tag, value FROM l")
def batches(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.col("event_id").alias("place"))
    return chartdata.create("batches_per_tag", df, "user_id", "event_id", ["value", "place"]).filter("value IS NOT NULL")


@add(
    "chart_raincloud",
    """WITH e AS (SELECT l_returnflag, min(l_extendedprice) AS low, max(l_extendedprice) AS high, count(*) AS whole FROM lineitem GROUP BY 1), b AS (SELECT l_returnflag, least(floor((l_extendedprice - low) / ((high - low) / 20)), 19)::INT AS bin, low, high, whole, count(*) AS n FROM lineitem JOIN e USING (l_returnflag) GROUP BY ALL)
    SELECT l_returnflag, bin, round(low + bin * (high - low) / 20, 4) AS start, round(low + (bin + 1) * (high - low) / 20, 4) AS "end", n, round(n / whole, 4) AS share FROM b""",
)
def raincloud(spark, sf_dir):
    return rounded(chartdata.create("raincloud", table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"]), 4)
