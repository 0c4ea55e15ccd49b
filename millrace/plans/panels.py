"""Queries of sensory panels: a supplier is a panelist, a part's brand a product, the return flag an attribute, quantity the score."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import sensory
from millrace.plans.catalog import add
from millrace.plans.stats import rounded, table

PANEL = "SELECT cast(l_suppkey % 12 AS VARCHAR) AS panelist_id, l_linenumber AS session, p_brand AS product, l_returnflag AS attribute, l_linenumber AS replicate, l_quantity AS score FROM lineitem JOIN part ON l_partkey = p_partkey"


def panel(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_quantity")
    return lines.join(part, lines["l_partkey"] == part["p_partkey"]).select((F.col("l_suppkey") % 12).cast("string").alias("panelist_id"), F.col("l_linenumber").alias("session"), F.col("p_brand").alias("product"), F.col("l_returnflag").alias("attribute"), F.col("l_linenumber").alias("replicate"), F.col("l_quantity").alias("score"))


@add("panel_product_means", f"WITH p AS ({PANEL}) SELECT product, attribute, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS sd, count(score) AS n FROM p GROUP BY 1, 2")
def means(spark, sf_dir):
    return rounded(sensory.product_means(panel(spark, sf_dir)).drop("ci_low", "ci_high"))


@add("panel_product_intervals")
def intervals(spark, sf_dir):
    return sensory.product_means(panel(spark, sf_dir))


@add("panel_by_product", f"WITH p AS ({PANEL}) SELECT product, round(avg(score) FILTER (WHERE attribute = 'A'), 6) AS A, round(avg(score) FILTER (WHERE attribute = 'N'), 6) AS N, round(avg(score) FILTER (WHERE attribute = 'R'), 6) AS R FROM p GROUP BY 1")
def by_product(spark, sf_dir):
    return rounded(sensory.aggregate_to_product(panel(spark, sf_dir), ["A", "N", "R"]))


@add(
    "panel_scorecard",
    f"""WITH p AS ({PANEL}), o AS (SELECT panelist_id, attribute, product, avg(score) AS m, count(*) AS n, sum(score) AS t FROM p GROUP BY ALL), a AS (SELECT attribute, product, sum(score) AS t, count(*) AS n FROM p GROUP BY ALL),
    c AS (SELECT o.*, (a.t - o.t) / nullif(a.n - o.n, 0) AS others FROM o JOIN a USING (attribute, product)),
    b AS (SELECT panelist_id, attribute, sum(n * m * m) - sum(t) ^ 2 / sum(n) AS ss, corr(m, others) AS agreement, avg(m) - avg(others) AS shift, stddev_samp(m) / stddev_samp(others) AS spread FROM c GROUP BY ALL),
    w AS (SELECT panelist_id, attribute, var_pop(score) * count(*) AS tss, corr(session, score) AS drift FROM p GROUP BY ALL)
    SELECT panelist_id, attribute, round(ss / tss, 6) AS discrimination, round(agreement, 6) AS agreement, round(shift, 6) AS shift, round(spread, 6) AS spread, round(drift, 6) AS drift FROM b JOIN w USING (panelist_id, attribute)""",
)
def scorecard(spark, sf_dir):
    return rounded(sensory.scorecard(panel(spark, sf_dir)))


@add(
    "panel_mixed_assessor",
    f"""WITH p AS ({PANEL}), c AS (SELECT attribute, panelist_id, product, avg(score) AS m FROM p GROUP BY ALL),
    d AS (SELECT *, avg(m) OVER (PARTITION BY attribute) AS g, avg(m) OVER (PARTITION BY attribute, panelist_id) AS a, avg(m) OVER (PARTITION BY attribute, product) AS b FROM c),
    s AS (SELECT attribute, panelist_id, sum((b - g) * (m - a)) / sum((b - g) ^ 2) AS beta FROM d GROUP BY ALL)
    SELECT attribute, round(sum((b - g) ^ 2), 5) AS ss_product, round(sum((a - g) ^ 2), 5) AS ss_panelist, round(sum((m - a - b + g) ^ 2), 5) AS ss_interaction, round(sum((beta - 1) ^ 2 * (b - g) ^ 2), 5) AS ss_scaling, round(sum((m - a - beta * (b - g)) ^ 2), 5) AS ss_disagreement FROM d JOIN s USING (attribute, panelist_id) GROUP BY 1""",
)
def mixed(spark, sf_dir):
    return rounded(sensory.mixed_assessor(panel(spark, sf_dir)).select("attribute", "ss_product", "ss_panelist", "ss_interaction", "ss_scaling", "ss_disagreement"), 5)


@add("panel_mixed_assessor_tests")
def mixed_tests(spark, sf_dir):
    return sensory.mixed_assessor(panel(spark, sf_dir))


@add(
    "panel_align_scores",
    f"""WITH p AS ({PANEL}), c AS (SELECT attribute, panelist_id, product, avg(score) AS m FROM p GROUP BY ALL), b AS (SELECT attribute, product, avg(m) AS b FROM c GROUP BY ALL), g AS (SELECT attribute, avg(m) AS grand FROM c GROUP BY ALL),
    s AS (SELECT attribute, panelist_id, avg(m) AS own, covar_samp(m, b) / nullif(var_samp(b), 0) AS beta FROM c JOIN b USING (attribute, product) GROUP BY ALL)
    SELECT panelist_id, attribute, product, session, count(*) AS n, round(avg(grand + (score - own) / CASE WHEN beta >= 0.2 THEN beta ELSE 1 END), 5) AS aligned FROM p JOIN s USING (attribute, panelist_id) JOIN g USING (attribute) GROUP BY ALL""",
)
def align(spark, sf_dir):
    out = sensory.align_scores(panel(spark, sf_dir)).groupBy("panelist_id", "attribute", "product", "session").agg(F.count("*").alias("n"), F.avg("aligned").alias("aligned"))
    return rounded(out, 5)


@add(
    "panel_tukey",
    f"""WITH p AS ({PANEL}), g AS (SELECT attribute, product AS g, count(*) AS n, avg(score) AS m, var_samp(score) AS v FROM p GROUP BY ALL), w AS (SELECT attribute, (sum(n) - count(*))::BIGINT AS dof, sum((n - 1) * coalesce(v, 0)) / (sum(n) - count(*)) AS mse FROM g GROUP BY 1)
    SELECT a.attribute, a.g AS group_a, b.g AS group_b, a.n AS n_a, b.n AS n_b, dof, round(b.m - a.m, 5) AS difference, round(abs(b.m - a.m) / sqrt(mse / 2 * (1.0 / a.n + 1.0 / b.n)), 5) AS q FROM g a JOIN g b ON a.attribute = b.attribute AND a.g < b.g JOIN w ON w.attribute = a.attribute""",
)
def tukey(spark, sf_dir):
    out = sensory.tukey_hsd(panel(spark, sf_dir), "score", "product", ["attribute"])
    return rounded(out.select("attribute", "group_a", "group_b", "n_a", "n_b", "dof", "difference", "q"), 5)


@add("panel_tukey_tests")
def tukey_tests(spark, sf_dir):
    return sensory.tukey_hsd(panel(spark, sf_dir), "score", "product", ["attribute"])


@add("panel_validation", f"WITH p AS ({PANEL}) SELECT count(*) FILTER (WHERE score < 0 OR score > 100) = 0 AND 1 - count(DISTINCT (panelist_id, product, attribute)) / (count(DISTINCT panelist_id) * count(DISTINCT product) * count(DISTINCT attribute)) <= 0.2 AS ok, count(*) AS n_rows, round(1 - count(DISTINCT (panelist_id, product, attribute)) / (count(DISTINCT panelist_id) * count(DISTINCT product) * count(DISTINCT attribute)), 6) AS empty_cells FROM p")
def validation(spark, sf_dir):
    out = sensory.validate(panel(spark, sf_dir), low=0, high=100)
    return spark.createDataFrame([(out["ok"], out["rows"], round(float(out["empty_cells"]), 6))], "ok boolean, n_rows long, empty_cells double")


@add("panel_compare_letters")
def compare_letters(spark, sf_dir):
    return sensory.compare_products(panel(spark, sf_dir))["letters"]


@add("panel_descriptive_products", f"WITH p AS ({PANEL}) SELECT product, round(avg(score) FILTER (WHERE attribute = 'A'), 6) AS A, round(avg(score) FILTER (WHERE attribute = 'N'), 6) AS N, round(avg(score) FILTER (WHERE attribute = 'R'), 6) AS R FROM p WHERE panelist_id <> '5' GROUP BY 1")
def descriptive(spark, sf_dir):
    return rounded(sensory.analyze_descriptive(panel(spark, sf_dir), drop=["5"], low=0, high=100)["products"])


@add(
    "panel_panelists",
    f"""WITH p AS ({PANEL}), c AS (SELECT panelist_id, product, attribute, avg(score) AS m, count(*) AS n, sum(score) AS t FROM p GROUP BY ALL), s AS (SELECT product, attribute, avg(m) AS c FROM c GROUP BY ALL), g AS (SELECT panelist_id, corr(m, c) AS agreement FROM c JOIN s USING (product, attribute) GROUP BY 1),
    w AS (SELECT panelist_id, attribute, var_pop(score) * count(*) AS tss FROM p GROUP BY ALL), e AS (SELECT panelist_id, attribute, (sum(n * m * m) - sum(t) ^ 2 / sum(n)) / max(tss) AS eta FROM c JOIN w USING (panelist_id, attribute) GROUP BY ALL), d AS (SELECT panelist_id, avg(eta) AS discrimination FROM e GROUP BY 1),
    u AS (SELECT panelist_id, avg(score) - (SELECT avg(score) FROM p) AS scale_shift, stddev_samp(score) / (SELECT stddev_samp(score) FROM p) AS scale_spread FROM p GROUP BY 1), k AS (SELECT panelist_id, session, avg(score) AS m, row_number() OVER (PARTITION BY panelist_id ORDER BY session) AS k FROM p GROUP BY 1, 2), f AS (SELECT panelist_id, corr(m, k) AS drift FROM k GROUP BY 1)
    SELECT panelist_id, round(discrimination, 6) AS discrimination, round(agreement, 6) AS agreement, round(scale_shift, 6) AS scale_shift, round(scale_spread, 6) AS scale_spread, round(drift, 6) AS drift FROM d JOIN g USING (panelist_id) JOIN u USING (panelist_id) JOIN f USING (panelist_id)""",
)
def panelists(spark, sf_dir):
    return rounded(sensory.panelists(panel(spark, sf_dir)))


@add("panel_flags")
def flags(spark, sf_dir):
    return sensory.flag_panelists(panel(spark, sf_dir))
