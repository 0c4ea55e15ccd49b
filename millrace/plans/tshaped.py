"""Queries of T-shaped models: suppliers are lots, brands and types of parts their materials."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.tpls import TPLS
from millrace.plans.catalog import add
from millrace.plans.stats import table


def supplied(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    return table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))


def properties(spark, sf_dir, groups):
    """Long: each brand's and type's mean size and price, and how much prices spread."""
    part = table(spark, sf_dir, "part")
    kinds = {"size": F.avg("p_size"), "price": F.avg("p_retailprice"), "spread": F.stddev_samp("p_retailprice")}
    wide = [part.groupBy(F.lit(g).alias("group"), F.col(g).alias("material")).agg(*(v.cast("double").alias(k) for k, v in kinds.items())) for g in groups]
    out = wide[0]
    for w in wide[1:]:
        out = out.unionByName(w)
    return out.unpivot(["group", "material"], list(kinds), "property", "value")


def formulas(lines, groups):
    """Long: each supplier's quantity of each brand and type."""
    each = F.explode(F.array(*(F.struct(F.lit(g).alias("group"), F.col(g).alias("material")) for g in groups))).alias("m")
    return lines.select(F.col("l_suppkey").alias("lot"), "l_quantity", each).groupBy("lot", "m.group", "m.material").agg(F.sum("l_quantity").alias("value"))


@add("tpls_suppliers")
def tpls_suppliers(spark, sf_dir):
    """Two groups of materials, conditions and two qualities."""
    lines, groups = supplied(spark, sf_dir), ["p_brand", "p_type"]
    d, f = properties(spark, sf_dir, groups), formulas(lines, groups)
    own = lines.groupBy(F.col("l_suppkey").alias("lot"))
    z = own.agg(F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"))
    y = own.agg(F.avg("l_extendedprice").alias("price"), F.avg((F.col("l_returnflag") == "R").cast("double")).alias("returned"))
    return TPLS.fit(d, f, z, y, 2, absent="zero").diagnose(f, z)


@add(
    "tpls_one_quality",
    """WITH brand AS (SELECT p_brand AS b, avg(p_size) AS p1, avg(p_retailprice) AS p2, stddev_samp(p_retailprice) AS p3 FROM part GROUP BY 1),
    d AS (SELECT b, (p1 - avg(p1) OVER ()) / stddev_samp(p1) OVER () / sqrt(3 * count(*) OVER ()) AS d1, (p2 - avg(p2) OVER ()) / stddev_samp(p2) OVER () / sqrt(3 * count(*) OVER ()) AS d2, (p3 - avg(p3) OVER ()) / stddev_samp(p3) OVER () / sqrt(3 * count(*) OVER ()) AS d3 FROM brand),
    q AS (SELECT l_suppkey AS lot, p_brand AS b, sum(l_quantity) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
    lots AS (SELECT l_suppkey AS lot, avg(l_extendedprice) AS y FROM lineitem GROUP BY 1),
    u AS (SELECT lot, y, (y - avg(y) OVER ()) / stddev_samp(y) OVER () AS u, avg(y) OVER () AS my, stddev_samp(y) OVER () AS sy FROM lots),
    full_ AS (SELECT lots.lot, brand.b, coalesce(v, 0) AS v FROM lots CROSS JOIN brand LEFT JOIN q ON q.lot = lots.lot AND q.b = brand.b),
    f AS (SELECT lot, b, (v - avg(v) OVER (PARTITION BY b)) / stddev_samp(v) OVER (PARTITION BY b) AS f FROM full_),
    h AS (SELECT b, sum(f * u) AS h FROM f JOIN u USING (lot) GROUP BY 1),
    s AS (SELECT sum(d1 * h) AS s1, sum(d2 * h) AS s2, sum(d3 * h) AS s3 FROM d JOIN h USING (b)),
    r AS (SELECT b, (d1 * s1 + d2 * s2 + d3 * s3) / sqrt(s1 ^ 2 + s2 ^ 2 + s3 ^ 2) AS r FROM d, s),
    t AS (SELECT lot, sum(f * r) / sum(r * r) AS t FROM f JOIN r USING (b) GROUP BY 1),
    c AS (SELECT sum(t * u) / sum(t * t) AS q, sum(t * t) / count(*) AS v FROM t JOIN u USING (lot))
    SELECT lot, round(t, 5) AS t1, round(t * t / v, 5) AS hotellings_t2, round(t * q * sy + my, 3) AS price_hat FROM t JOIN u USING (lot), c""",
)
def tpls_one_quality(spark, sf_dir):
    """One group, one quality: the iteration settles at once, so SQL can follow it."""
    lines, groups = supplied(spark, sf_dir), ["p_brand"]
    f = formulas(lines, groups)
    y = lines.groupBy(F.col("l_suppkey").alias("lot")).agg(F.avg("l_extendedprice").alias("price"))
    out = TPLS.fit(properties(spark, sf_dir, groups), f, None, y, 1, absent="zero").diagnose(f)
    return out.select("lot", F.round("t1", 5).alias("t1"), F.round("hotellings_t2", 5).alias("hotellings_t2"), F.round("price_hat", 3).alias("price_hat"))
