"""Queries of comparisons of groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import comparisons
from millrace.plans.catalog import add
from millrace.plans.panels import PANEL, panel
from millrace.plans.stats import rounded, table


@add(
    "dunnett_statistics",
    """WITH g AS (SELECT event_type, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1), p AS (SELECT sum((n - 1) * v) / (sum(n) - count(*)) AS mse FROM g), c AS (SELECT n AS n0, m AS m0 FROM g WHERE event_type = (SELECT min(event_type) FROM events))
    SELECT event_type, n, round(m - m0, 6) AS difference, round((m - m0) / sqrt(mse * (1.0 / n + 1.0 / n0)), 6) AS t FROM g, p, c WHERE event_type <> (SELECT min(event_type) FROM events)""",
)
def dunnett(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    control = df.agg(F.min("event_type")).first()[0]
    return rounded(comparisons.dunnett(df, "value", "event_type", control).select("event_type", "n", "difference", "t"))


@add(
    "panel_relations",
    f"""WITH p AS ({PANEL}), w AS (SELECT product, avg(score) FILTER (WHERE attribute = 'A') AS A, avg(score) FILTER (WHERE attribute = 'N') AS N, avg(score) FILTER (WHERE attribute = 'R') AS R FROM p GROUP BY 1), b AS (SELECT p_brand AS product, avg(p_size) AS size, avg(p_retailprice) AS price FROM part GROUP BY 1), j AS (SELECT * FROM w JOIN b USING (product))
    """ + " UNION ALL ".join(f"SELECT '{a}' AS attribute, '{c}' AS covariate, round(corr({a}, {c}), 6) AS r, count(*) AS n FROM j" for a in "ANR" for c in ("size", "price")),
)
def relations(spark, sf_dir):
    part = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.avg("p_size").alias("size"), F.avg("p_retailprice").alias("price"))
    products = panel(spark, sf_dir).groupBy("product").pivot("attribute", ["A", "N", "R"]).agg(F.avg("score")).join(part, F.col("product") == F.col("p_brand"))
    return rounded(comparisons.relate(products, ["A", "N", "R"], ["size", "price"]).select("attribute", "covariate", "r", "n"))


@add(
    "factorial_anova",
    """WITH c AS (SELECT l_returnflag AS a, l_linenumber AS b, count(*) AS n, avg(l_quantity) AS m, coalesce(var_samp(l_quantity), 0) AS v FROM lineitem GROUP BY 1, 2), d AS (SELECT *, avg(m) OVER () AS g, avg(m) OVER (PARTITION BY a) AS ma, avg(m) OVER (PARTITION BY b) AS mb FROM c),
    s AS (SELECT count(*) / sum(1.0 / n) AS h, count(DISTINCT a) AS i, count(DISTINCT b) AS j, sum((ma - g) ^ 2) AS sa, sum((mb - g) ^ 2) AS sb, sum((m - ma - mb + g) ^ 2) AS sab, sum((n - 1) * v) AS w, sum(n) - count(*) AS dof FROM d), t AS (SELECT *, w / dof AS ms FROM s)
    SELECT 'l_returnflag' AS term, round(h * sa, 4) AS sum_sq, i - 1 AS df, round(h * sa / (i - 1) / ms, 5) AS f FROM t UNION ALL SELECT 'l_linenumber', round(h * sb, 4), j - 1, round(h * sb / (j - 1) / ms, 5) FROM t
    UNION ALL SELECT 'l_returnflag:l_linenumber', round(h * sab, 4), (i - 1) * (j - 1), round(h * sab / ((i - 1) * (j - 1)) / ms, 5) FROM t UNION ALL SELECT 'Residual', round(w, 2), dof::BIGINT, NULL FROM t""",
)
def factorial(spark, sf_dir):
    rows = comparisons.factorial_anova(table(spark, sf_dir, "lineitem"), "l_quantity", "l_returnflag", "l_linenumber")
    rest = lambda r: r["term"] == "Residual"
    return spark.createDataFrame([(r["term"], round(float(r["sum_sq"]), 2 if rest(r) else 4), int(r["df"]), None if rest(r) else round(float(r["f"]), 5)) for r in rows], "term string, sum_sq double, df long, f double")
