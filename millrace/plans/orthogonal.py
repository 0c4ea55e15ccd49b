"""Queries of orthogonal minimally aliased designs: lines are runs, coded low, middle or high by thirds of a column's range."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import omars
from millrace.plans.catalog import add
from millrace.plans.stats import table

#: A factor, its column, and where its middle and high levels begin.
LEVELS = {"q": ("l_quantity", 18.0, 34.0), "d": ("l_discount", 0.035, 0.065), "t": ("l_tax", 0.025, 0.055)}
CODED = ", ".join(f"CASE WHEN {c} < {a} THEN -1 WHEN {c} < {b} THEN 0 ELSE 1 END AS {f}" for f, (c, a, b) in LEVELS.items())
RUNS = f"runs AS (SELECT {CODED}, l_extendedprice AS price FROM lineitem)"


def runs(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(*(F.when(F.col(c) < a, -1).when(F.col(c) < b, 0).otherwise(1).alias(f) for f, (c, a, b) in LEVELS.items()), F.col("l_extendedprice").alias("price"))


@add(
    "omars_properties",
    f"""WITH {RUNS} SELECT count(*) AS n_runs, abs(sum(q)) + abs(sum(d)) + abs(sum(t)) = 0 AS is_balanced, greatest(abs(sum(q * d)), abs(sum(q * t)), abs(sum(d * t)))::DOUBLE AS among,
    greatest(abs(sum(q)), abs(sum(d)), abs(sum(t)), abs(sum(q * q * d)), abs(sum(q * q * t)), abs(sum(d * d * q)), abs(sum(d * d * t)), abs(sum(t * t * q)), abs(sum(t * t * d)), abs(sum(q * d * t)))::DOUBLE AS across,
    round(greatest(abs(corr(q * q, d * d)), abs(corr(q * q, t * t)), abs(corr(d * d, t * t)), abs(corr(q * q, q * d)), abs(corr(q * q, q * t)), abs(corr(q * q, d * t)), abs(corr(d * d, q * d)), abs(corr(d * d, q * t)), abs(corr(d * d, d * t)), abs(corr(t * t, q * d)), abs(corr(t * t, q * t)), abs(corr(t * t, d * t)), abs(corr(q * d, q * t)), abs(corr(q * d, d * t)), abs(corr(q * t, d * t))), 6) AS second_order_correlation FROM runs""",
)
def properties(spark, sf_dir):
    p = omars.properties(runs(spark, sf_dir), list(LEVELS))
    row = (p["n_runs"], p["is_balanced"], round(p["max_main_effect_inner_product"], 3), round(p["max_main_vs_second_order_inner_product"], 3), round(p["max_second_order_correlation"], 6))
    return spark.createDataFrame([row], "n_runs long, is_balanced boolean, among double, across double, second_order_correlation double")


#: The thirteen half-runs of three factors; SQL tries all subsets of six of them.
HALF = "half AS (SELECT row_number() OVER (ORDER BY q, d, t) - 1 AS i, * FROM (SELECT a.range - 1 AS q, b.range - 1 AS d, c.range - 1 AS t FROM range(3) a, range(3) b, range(3) c) WHERE q * 9 + d * 3 + t > 0)"


@add(
    "omars_chosen_runs",
    f"""WITH {RUNS}, {HALF}, each AS (SELECT q, d, t, sum(price) AS s, count(price) AS n FROM runs GROUP BY ALL),
    pool AS (SELECT row_number() OVER (ORDER BY h.i) - 1 AS i, h.q, h.d, h.t, (a.s + b.s) / (a.n + b.n) AS cost FROM half h JOIN each a ON (a.q, a.d, a.t) = (h.q, h.d, h.t) JOIN each b ON (b.q, b.d, b.t) = (-h.q, -h.d, -h.t)),
    subset AS (SELECT s.range AS mask FROM range(8192) s WHERE bit_count(s.range) = 6 AND s.range < (SELECT 1 << count(*) FROM pool)),
    best AS (SELECT mask FROM subset JOIN pool ON (mask >> i) & 1 = 1 GROUP BY mask HAVING sum(q * d) = 0 AND sum(q * t) = 0 AND sum(d * t) = 0 ORDER BY sum(cost) LIMIT 1),
    chosen AS (SELECT q, d, t FROM best JOIN pool ON (mask >> i) & 1 = 1),
    every AS (SELECT * FROM chosen UNION ALL SELECT -q, -d, -t FROM chosen UNION ALL SELECT 0, 0, 0 FROM best)
    SELECT q::INT AS q, d::INT AS d, t::INT AS t, round(s / n, 4) AS mean_cost, n AS runs FROM every JOIN each USING (q, d, t)""",
)
def chosen_runs(spark, sf_dir):
    """The cheapest design of thirteen runs among the settings that lines have."""
    out = omars.choose_runs(runs(spark, sf_dir), list(LEVELS), "price", 6)
    return out.withColumn("mean_cost", F.round("mean_cost", 4))


@add(
    "omars_one_factor",
    f"""WITH {RUNS}, a AS (SELECT avg(price) AS m FROM runs), level AS (SELECT q, count(*) AS n, avg(price) AS y, var_pop(price) * count(*) AS own FROM runs GROUP BY 1),
    e AS (SELECT sum(own) / (sum(n) - 3) AS s2, sum(n) - 3 AS df, sum(n * q * (y - m)) / sum(n * q * q) AS b, sum(n * q * q) AS xx, sum(n * (y - m) ^ 2) AS told FROM level, a)
    SELECT df::BIGINT AS error_df, round(sqrt(s2), 4) AS rmse, round(b, 4) AS effect, round(b / sqrt(s2 / xx), 4) AS t, round((told - b * b * xx) / s2, 3) AS second_order_f FROM e""",
)
def one_factor(spark, sf_dir):
    """One factor of three levels, where the full model is the means of the levels."""
    from millrace.operators.linear import moments

    df = runs(spark, sf_dir)
    found = omars.analyze(df, ["q"], "price", alpha_main=1.0)
    m = moments(df.select(F.col("q").cast("double"), "price"), ["q", "price"])
    b, xx = found.main_effects["q"], m.raw[2][0, 0]
    told = m.centred[1, 1] - found.error_df * found.rmse**2
    row = (found.error_df, *(round(float(v), k) for v, k in ((found.rmse, 4), (b, 4), (b / (found.rmse / xx**0.5), 4), ((told - b * b * xx) / found.rmse**2, 3))))
    return spark.createDataFrame([row], "error_df long, rmse double, effect double, t double, second_order_f double")


@add("omars_analysis")
def analysis(spark, sf_dir):
    """Three factors, all stages: a row for each main effect and for each active second-order term, with the p value of its stage."""
    found = omars.analyze(runs(spark, sf_dir), list(LEVELS), "price")
    rows = [("main", c, c in found.active_main_effects, float(p)) for c, p in found.p_values.items()] + [("second order", t, True, float(found.second_order_p_value)) for t in found.active_second_order]
    return spark.createDataFrame([*rows, ("gate", "all second-order terms", bool(found.active_second_order), float(found.second_order_p_value))], "stage string, term string, active boolean, p_value double")
