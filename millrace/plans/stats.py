"""Queries of univariate statistics, scaling and control charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import monitoring, scaling
from millrace.operators import univariate as U
from millrace.plans.catalog import add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes))


MAD = "quantile_cont(abs(x - m), 0.5)"
EVENT_X = "SELECT event_type, value AS x, quantile_cont(value, 0.5) OVER (PARTITION BY event_type) AS m FROM events WHERE value IS NOT NULL"
R = lambda *cs: ", ".join(f"round({e}, 6) AS {n}" for n, e in cs)


@add(
    "summary_stats",
    f"""WITH e AS ({EVENT_X}) SELECT event_type, {R(("mean", "avg(x)"), ("std_ddof0", "stddev_pop(x)"), ("std_ddof1", "stddev_samp(x)"), ("rsd_classical", "stddev_samp(x) / avg(x)"), ("center", "max(m)"), ("spread", f"{MAD} / 0.6744897501960817"), ("p05", "quantile_cont(x, 0.05)"), ("p25", "quantile_cont(x, 0.25)"), ("p75", "quantile_cont(x, 0.75)"), ("p95", "quantile_cont(x, 0.95)"), ("iqr", "quantile_cont(x, 0.75) - quantile_cont(x, 0.25)"), ("min", "min(x)"), ("max", "max(x)"))}, count(x) AS n FROM e GROUP BY event_type""",
)
def summary_stats(spark, sf_dir):
    return rounded(U.summary_stats(table(spark, sf_dir, "events"), "value", ["event_type"]))


@add("median_absolute_deviation", f"WITH e AS ({EVENT_X}) SELECT event_type, round({MAD} / 0.6744897501960817, 6) AS mad FROM e GROUP BY event_type")
def mad(spark, sf_dir):
    return rounded(U.median_absolute_deviation(table(spark, sf_dir, "events"), "value", ["event_type"]))


@add(
    "box_statistics",
    """WITH b AS (SELECT l_returnflag, min(l_extendedprice) AS low, quantile_cont(l_extendedprice, 0.25) AS q1, median(l_extendedprice) AS q2, quantile_cont(l_extendedprice, 0.75) AS q3, max(l_extendedprice) AS high FROM lineitem GROUP BY 1),
    f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM b)
    SELECT f.l_returnflag, round(low, 6) AS low, round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3, round(high, 6) AS high, round(lower_fence, 6) AS lower_fence, round(upper_fence, 6) AS upper_fence,
    count(*) FILTER (WHERE l_extendedprice < lower_fence OR l_extendedprice > upper_fence) AS n_outliers FROM f JOIN lineitem USING (l_returnflag) GROUP BY ALL""",
)
def box(spark, sf_dir):
    return rounded(U.box_statistics(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"]))


@add(
    "biweight_midvariance",
    f"""WITH e AS ({EVENT_X}), d AS (SELECT *, quantile_cont(abs(x - m), 0.5) OVER (PARTITION BY event_type) AS mad FROM e), u AS (SELECT *, (x - m) / (9 * mad) AS u FROM d)
    SELECT event_type, round(count(x) * sum((x - m) ^ 2 * (1 - u * u) ^ 4) FILTER (WHERE abs(u) <= 1) / (sum((1 - u * u) * (1 - 5 * u * u)) FILTER (WHERE abs(u) <= 1)) ^ 2, 6) AS biweight_midvariance FROM u GROUP BY event_type""",
)
def biweight(spark, sf_dir):
    return rounded(U.biweight_midvariance(table(spark, sf_dir, "events"), "value", ["event_type"]))


@add(
    "ttest_independent",
    """WITH g AS (SELECT l_returnflag AS k, count(*) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY 1),
    p AS (SELECT a.k AS group_a, b.k AS group_b, a.n AS n_a, b.n AS n_b, b.m - a.m AS difference, a.n + b.n - 2 AS dof, sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)) AS standard_error FROM g a JOIN g b ON a.k < b.k)
    SELECT group_a, group_b, n_a, n_b, dof, round(difference, 6) AS difference, round(standard_error, 6) AS standard_error, round(difference / standard_error, 6) AS t FROM p""",
)
def ttest(spark, sf_dir):
    out = U.ttest_independent(table(spark, sf_dir, "lineitem"), "l_quantity", "l_returnflag")
    return rounded(out.select("group_a", "group_b", "n_a", "n_b", "dof", "difference", "standard_error", "t"))


@add(
    "ttest_paired",
    """WITH k AS (SELECT l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_linenumber ORDER BY l_orderkey, l_partkey, l_extendedprice) AS k FROM lineitem),
    d AS (SELECT a.l_extendedprice - b.l_extendedprice AS d FROM k a JOIN k b USING (k) WHERE a.l_linenumber = 1 AND b.l_linenumber = 2)
    SELECT count(*) AS n, count(*) - 1 AS dof, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS sd, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t FROM d""",
)
def paired(spark, sf_dir):
    return rounded(U.ttest_paired(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_linenumber", ["l_orderkey", "l_partkey", "l_extendedprice"], 1, 2).select("n", "dof", "mean", "sd", "t"))


@add("ttest_p_values")
def ttest_p_values(spark, sf_dir):
    return U.benjamini_hochberg(U.holm_bonferroni(U.ttest_independent(table(spark, sf_dir, "events"), "value", "event_type"), "p_value"), "p_value")


@add("confidence_interval_robust")
def interval(spark, sf_dir):
    return U.confidence_interval(table(spark, sf_dir, "events"), "value", ["event_type"])


@add(
    "confidence_interval_parts",
    """WITH m AS (SELECT event_type, median(value) AS m, count(value) AS n FROM events GROUP BY 1), d AS (SELECT e.event_type, any_value(m) AS m, any_value(n) AS n, median(abs(value - m)) AS mad, avg(value) AS mean, stddev_samp(value) AS sd FROM events e JOIN m USING (event_type) GROUP BY 1)
    SELECT event_type, n, round(m, 6) AS center, round(mad / 0.6744897501960817 * sqrt(pi() / 2), 6) AS spread, round(mean, 6) AS mean, round(sd / sqrt(n), 6) AS standard_error FROM d""",
)
def interval_parts(spark, sf_dir):
    """Centres and spreads of the robust and the regular interval; the regular one's standard error is its half-width over its t value."""
    events = table(spark, sf_dir, "events")
    robust = U.confidence_interval(events, "value", ["event_type"]).select("event_type", "n", "center", "spread")
    regular = U.confidence_interval(events, "value", ["event_type"], style="regular").select("event_type", F.col("center").alias("mean"), (F.col("spread") / F.sqrt("n")).alias("standard_error"))
    return rounded(robust.join(regular, "event_type"))


P_TABLE = "SELECT p_brand, p_partkey AS k, ((p_partkey * 37) % 1009) / 10090.0 AS p FROM part"


@add("holm_bonferroni", f"WITH t AS ({P_TABLE}), r AS (SELECT *, (count(*) OVER (PARTITION BY p_brand) - row_number() OVER (PARTITION BY p_brand ORDER BY p) + 1) * p AS raw FROM t) SELECT p_brand, k, round(least(1.0, max(raw) OVER (PARTITION BY p_brand ORDER BY p ROWS UNBOUNDED PRECEDING)), 6) AS p_holm FROM r")
def holm(spark, sf_dir):
    t = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("k"), (F.col("p_partkey") * 37 % 1009 / F.lit(10090.0)).alias("p"))
    return rounded(U.holm_bonferroni(t, "p", ["p_brand"]).drop("p"))


@add("benjamini_hochberg", f"WITH t AS ({P_TABLE}), r AS (SELECT *, count(*) OVER (PARTITION BY p_brand) * p / row_number() OVER (PARTITION BY p_brand ORDER BY p) AS raw FROM t) SELECT p_brand, k, round(least(1.0, min(raw) OVER (PARTITION BY p_brand ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 6) AS p_bh FROM r")
def bh(spark, sf_dir):
    t = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("k"), (F.col("p_partkey") * 37 % 1009 / F.lit(10090.0)).alias("p"))
    return rounded(U.benjamini_hochberg(t, "p", ["p_brand"]).drop("p"))


@add(
    "variance_decomposition",
    """WITH g AS (SELECT l_returnflag, l_suppkey, count(*) AS n, avg(l_quantity) AS m, coalesce(var_samp(l_quantity), 0) AS v FROM lineitem GROUP BY 1, 2),
    s AS (SELECT l_returnflag, count(*) AS groups, sum(n) AS n, sum(n * n) AS squares, sum((n - 1) * v) AS w, sum(n * m * m) - sum(n * m) ^ 2 / sum(n) AS b FROM g GROUP BY 1)
    SELECT l_returnflag, round(w / (n - groups), 6) AS within_ms, round(b / (groups - 1), 6) AS between_ms, (n - groups)::BIGINT AS within_dof, groups - 1 AS between_dof, round(w / (n - groups), 6) AS within_variance,
    round(greatest(0, (b / (groups - 1) - w / (n - groups)) / ((n - squares / n) / (groups - 1))), 6) AS between_variance FROM s""",
)
def variances(spark, sf_dir):
    return rounded(U.variance_decomposition(table(spark, sf_dir, "lineitem"), "l_quantity", "l_suppkey", ["l_returnflag"]))


@add("cpk_classical", "SELECT l_returnflag, round(avg(l_quantity), 6) AS center, round(stddev_samp(l_quantity), 6) AS spread, round(least((60 - avg(l_quantity)) / (3 * stddev_samp(l_quantity)), (avg(l_quantity) + 5) / (3 * stddev_samp(l_quantity))), 6) AS cpk FROM lineitem GROUP BY 1")
def cpk(spark, sf_dir):
    return rounded(U.calculate_cpk(table(spark, sf_dir, "lineitem"), "l_quantity", -5.0, 60.0, ["l_returnflag"], trim_percentile=0))


def sn_sql(keys_values_order: str) -> str:
    """CTEs x, d, m and sn (k, n, sn) of groups k of values x; a group of one has 0."""
    return f"""x AS (SELECT k, x, row_number() OVER (PARTITION BY k ORDER BY o) AS i, count(*) OVER (PARTITION BY k) AS n FROM ({keys_values_order})),
d AS (SELECT a.k, a.n, a.i, abs(a.x - b.x) AS d, row_number() OVER (PARTITION BY a.k, a.i ORDER BY abs(a.x - b.x)) AS r FROM x a JOIN x b ON a.k = b.k),
m AS (SELECT k, n, d, row_number() OVER (PARTITION BY k ORDER BY d) AS r FROM d WHERE r = n // 2 + 1),
sn AS (SELECT k, n, CASE WHEN n = 1 THEN 0 ELSE 1.1926 * d * CASE n WHEN 2 THEN 0.743 WHEN 3 THEN 1.851 WHEN 4 THEN 0.954 WHEN 5 THEN 1.351 WHEN 6 THEN 0.993 WHEN 7 THEN 1.198 WHEN 8 THEN 1.005 WHEN 9 THEN 1.131 ELSE CASE WHEN n % 2 = 1 THEN n / (n - 0.9) ELSE 1 END END END AS sn FROM m WHERE r = (n + 1) // 2)"""


SN_SQL = f"WITH {sn_sql('SELECT c_nationkey AS k, c_acctbal AS x, c_custkey AS o FROM customer')} SELECT k, round(sn, 6) AS sn FROM sn"


@add("sn_scale", SN_SQL)
def sn(spark, sf_dir):
    return rounded(U.sn(table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "k"), "c_acctbal", ["k"]))


@add(
    "cpk_robust",
    f"""WITH q AS (SELECT event_type, quantile_cont(value, 0.025) AS low, quantile_cont(value, 0.975) AS high FROM events WHERE value IS NOT NULL GROUP BY 1), t AS (SELECT event_type, event_id, value, low FROM events JOIN q USING (event_type) WHERE value BETWEEN low AND high),
    {sn_sql("SELECT event_type AS k, value AS x, event_id AS o FROM t")}, c AS (SELECT event_type, median(value) AS center, max(low) AS low FROM t GROUP BY 1)
    SELECT event_type, round(center, 6) AS center, round(sn, 6) AS spread, round((center - low) / (3 * sn), 6) AS cpk FROM c JOIN sn ON k = event_type""",
)
def cpk_robust(spark, sf_dir):
    return rounded(U.calculate_cpk(table(spark, sf_dir, "events"), "value", None, float("nan"), ["event_type"]))


@add("detect_outliers_esd")
def esd(spark, sf_dir):
    return U.detect_outliers_esd(table(spark, sf_dir, "events"), "value", "event_id", ["event_type"], most=5)


@add(
    "esd_first_removal",
    """WITH e AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS position, avg(value) OVER (PARTITION BY event_type) AS m, stddev_samp(value) OVER (PARTITION BY event_type) AS s FROM events WHERE value IS NOT NULL)
    SELECT event_type, position::INT AS position, round(abs(value - m) / s, 6) AS statistic FROM e QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY abs(value - m) DESC, event_id) = 1""",
)
def esd_first(spark, sf_dir):
    return rounded(U.detect_outliers_esd(table(spark, sf_dir, "events"), "value", "event_id", ["event_type"]).select("event_type", "position", "statistic"))


@add("test_normality")
def normality(spark, sf_dir):
    return U.test_normality(table(spark, sf_dir, "supplier"), "s_acctbal")


@add("tietjen_moore")
def tietjen(spark, sf_dir):
    return U.tietjen_moore(table(spark, sf_dir, "supplier"), "s_acctbal", 3)


@add("distribution_fit")
def distribution(spark, sf_dir):
    return U.distribution_fit(table(spark, sf_dir, "events"), "value", ["event_type"])


@add(
    "distribution_fit_exponential",
    """WITH g AS (SELECT event_type, min(value) AS loc, avg(value) - min(value) AS scale, count(value) AS n FROM events GROUP BY 1), r AS (SELECT event_type, loc, scale, n, 1 - exp(-(value - loc) / scale) AS f, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i FROM events JOIN g USING (event_type) WHERE value IS NOT NULL)
    SELECT event_type, round(loc, 6) AS location, round(scale, 6) AS scale, round(max(greatest(i / n - f, f - (i - 1) / n)), 6) AS distance FROM r GROUP BY ALL""",
)
def distribution_exponential(spark, sf_dir):
    return rounded(U.distribution_fit(table(spark, sf_dir, "events"), "value", ["event_type"], "expon").drop("p_value"))


@add("distribution_fit_moments", "SELECT event_type, round(avg(value), 6) AS location, round(stddev_pop(value), 6) AS scale FROM events GROUP BY 1")
def distribution_moments(spark, sf_dir):
    return rounded(U.distribution_fit(table(spark, sf_dir, "events"), "value", ["event_type"]).select("event_type", "location", "scale"))


@add("scale_columns", "SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_samp(l_quantity) OVER (), 6) AS l_quantity, round((l_discount - avg(l_discount) OVER ()) / stddev_samp(l_discount) OVER (), 6) AS l_discount FROM lineitem")
def scaled(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return rounded(scaling.Scaler.fit(df, ["l_quantity", "l_discount"]).transform(df))


@add("center_and_scale", "SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS p_retailprice FROM part")
def centred(spark, sf_dir):
    df = scaling.center(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"])
    return rounded(scaling.scale(df, ["p_retailprice"]))


@add(
    "batch_ranges",
    """WITH t AS (UNPIVOT (SELECT l_suppkey, l_quantity, l_extendedprice FROM lineitem) ON l_quantity, l_extendedprice INTO NAME tag VALUE x),
    b AS (SELECT l_suppkey, tag, quantile_cont(x, 0.98) - quantile_cont(x, 0.02) AS r, min(x) AS m FROM t GROUP BY 1, 2)
    SELECT tag, round(median(CASE WHEN r = 0 THEN 1 ELSE r END), 6) AS range, round(median(m), 6) AS minimum FROM b GROUP BY 1""",
)
def ranges(spark, sf_dir):
    return rounded(scaling.batch_ranges(table(spark, sf_dir, "lineitem"), "l_suppkey", ["l_quantity", "l_extendedprice"]))


SHEWHART = "SELECT event_id, event_type, round(target, 6) AS target, round(s, 6) AS s, round(target - 3 * s, 6) AS lcl, round(target + 3 * s, 6) AS ucl, abs(value - target) > 3 * s AS out_of_control FROM events JOIN l USING (event_type)"


@add("shewhart_regular", f"WITH l AS (SELECT event_type, avg(value) AS target, stddev_samp(value) AS s FROM events GROUP BY 1) {SHEWHART}")
def shewhart(spark, sf_dir):
    return rounded(monitoring.shewhart(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), "value", ["event_type"]).drop("value"))


@add("shewhart_robust", f"WITH e AS ({EVENT_X}), l AS (SELECT event_type, max(m) AS target, 1.4826 * {MAD} AS s FROM e GROUP BY 1) {SHEWHART}")
def shewhart_robust(spark, sf_dir):
    return rounded(monitoring.shewhart(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), "value", ["event_type"], "robust").drop("value"))


@add("holt_winters_chart")
def hw(spark, sf_dir):
    daily = table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("value").alias("value"))
    return monitoring.holt_winters_chart(daily, "value", "hour", ["event_type"])
