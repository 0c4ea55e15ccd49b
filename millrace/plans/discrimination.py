"""Queries of descriptors against attributes: parts are products, their prices and quantities sold attributes."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import discrimination
from millrace.plans.catalog import add
from millrace.plans.orthogonal import RUNS, runs
from millrace.plans.stats import table

DESCRIPTORS = ["size", "list_price", "name_length", "brand"]


def products(spark, sf_dir):
    """Parts with their descriptors, and the mean quantity and price of their lines."""
    sold = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.avg("l_quantity").alias("quantity"), F.avg("l_extendedprice").alias("price"))
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("list_price"), F.length("p_name").cast("double").alias("name_length"), F.regexp_extract("p_brand", "([0-9]+)", 1).cast("double").alias("brand"))
    return part.join(sold, part["p_partkey"] == sold["l_partkey"]).drop("l_partkey")


@add("panel_discriminator")
def discriminator(spark, sf_dir):
    """Every descriptor against every attribute, with the gate of its attribute."""
    gates, told = discrimination.discriminate(products(spark, sf_dir), ["quantity", "price"], DESCRIPTORS, "p_partkey")
    q2 = {g["attribute"]: (g["q2_cv"], g["predictable"]) for g in gates}
    names = ("attribute", "descriptor", "selectivity_ratio", "p_value", "q_value", "jackknife_significant", "discriminator_significant", "cluster_id")
    return spark.createDataFrame([(*(r[n] for n in names), *q2[r["attribute"]]) for r in told], "attribute string, descriptor string, selectivity_ratio double, p_value double, q_value double, jackknife_significant boolean, discriminator_significant boolean, cluster_id int, q2_cv double, predictable boolean")


@add(
    "panel_gate",
    """WITH s AS (SELECT l_partkey, avg(l_extendedprice) AS y FROM lineitem GROUP BY 1), p AS (SELECT p_retailprice AS x, y FROM part JOIN s ON p_partkey = l_partkey), m AS (SELECT count(*) AS n, avg(x) AS mx, regr_sxx(y, x) AS xx, regr_syy(y, x) AS yy, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM p)
    SELECT round(1 - sum(((y - a - b * x) / (1 - 1.0 / n - (x - mx) ^ 2 / xx)) ^ 2) / any_value(yy), 8) AS q2_cv, round(sqrt(sum(((y - a - b * x) / (1 - 1.0 / n - (x - mx) ^ 2 / xx)) ^ 2) / any_value(n)), 4) AS rmsep_cv FROM p, m""",
)
def gate(spark, sf_dir):
    """One descriptor: least squares, each part left out in turn."""
    gates, _ = discrimination.discriminate(products(spark, sf_dir), ["price"], ["list_price"], "p_partkey", permutations=1)
    return spark.createDataFrame([(round(gates[0]["q2_cv"], 8), round(gates[0]["rmsep_cv"], 4))], "q2_cv double, rmsep_cv double")


@add("panel_knock_offs")
def knock_offs(spark, sf_dir):
    found = discrimination.knock_offs(products(spark, sf_dir), ["quantity", "price"], DESCRIPTORS, "p_partkey")
    names = list(found[0])
    return spark.createDataFrame([tuple(r[n] for n in names) for r in found], "descriptor string, vip double, vip_null_threshold double, vip_exceeds_null boolean, cv_beta double, cv_beta_null_threshold double, cv_beta_exceeds_null boolean")


@add(
    "panel_designed_effects",
    f"""WITH {RUNS}, m AS (SELECT avg(q) AS q, avg(d) AS d, avg(price) AS p, count(*) AS n FROM runs), s AS (SELECT n, sum((r.q - m.q) ^ 2) AS qq, sum((r.d - m.d) ^ 2) AS dd, sum((r.q - m.q) * (r.d - m.d)) AS qd, sum((r.q - m.q) * (price - p)) AS qy, sum((r.d - m.d) * (price - p)) AS dy, sum((price - p) ^ 2) AS yy FROM runs r, m GROUP BY n),
    b AS (SELECT *, (qy * dd - dy * qd) / (qq * dd - qd * qd) AS bq, (dy * qq - qy * qd) / (qq * dd - qd * qd) AS bd FROM s), e AS (SELECT *, (yy - bq * qy - bd * dy) / (n - 3) AS s2 FROM b)
    SELECT 'price' AS attribute, 'q' AS term, round(bq, 4) AS effect, round(sqrt(s2 * dd / (qq * dd - qd * qd)), 4) AS standard_error, round(bq / sqrt(s2 * dd / (qq * dd - qd * qd)), 4) AS t FROM e
    UNION ALL SELECT 'price', 'd', round(bd, 4), round(sqrt(s2 * qq / (qq * dd - qd * qd)), 4), round(bd / sqrt(s2 * qq / (qq * dd - qd * qd)), 4) FROM e""",
)
def designed_effects(spark, sf_dir):
    out = discrimination.relate_designed(runs(spark, sf_dir), ["price"], ["q", "d"])
    return out.select("attribute", "term", *(F.round(c, 4).alias(c) for c in ("effect", "standard_error", "t")))


@add("panel_designed_family")
def designed_family(spark, sf_dir):
    """All factors and their interactions against three attributes, adjusted over the family."""
    lines = runs(spark, sf_dir).withColumns({"root": F.sqrt("price"), "large": (F.col("price") > 30000).cast("double")})
    return discrimination.relate_designed(lines, ["price", "root", "large"], ["q", "d", "t"], "interactions")
