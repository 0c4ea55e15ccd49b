"""Queries of batch trajectories: a user's events are a batch, seconds since its first event the age."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import features as B
from millrace.plans.catalog import add
from millrace.plans.stats import rounded, table

AGE = "SELECT user_id, event_id, event_type, value, epoch_us(ts) / 1e6 AS age FROM events"
BY = ["user_id"]


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("age"))


@add(
    "batch_features",
    f"""WITH e AS ({AGE}) SELECT user_id, round(avg(value), 6) AS value_mean, round(median(value), 6) AS value_median, round(stddev_samp(value), 6) AS value_std, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS value_iqr, round(coalesce(sum(value), 0), 6) AS value_sum, round(min(value), 6) AS value_min, round(max(value), 6) AS value_max, count(value) AS value_count,
    round(arg_min(age, (value, age)), 6) AS value_agemin, round(arg_min(age, (-value, age)), 6) AS value_agemax, round(arg_max(value, (age, value)), 6) AS value_last FROM e GROUP BY 1""",
)
def batch_features(spark, sf_dir):
    return rounded(B.features(events(spark, sf_dir), ["value"], BY, "age"))


@add("batch_features_by_phase", "SELECT user_id, event_type, round(avg(value), 6) AS value_mean, round(min(value), 6) AS value_min, round(max(value), 6) AS value_max, count(value) AS value_count FROM events GROUP BY 1, 2")
def by_phase(spark, sf_dir):
    return rounded(B.features(events(spark, sf_dir), ["value"], ["user_id", "event_type"], which=("mean", "min", "max", "count")))


@add("batch_robust_mad", f"WITH e AS (SELECT user_id, value AS x, quantile_cont(value, 0.5) OVER (PARTITION BY user_id) AS m FROM events) SELECT user_id, round(quantile_cont(abs(x - m), 0.5) / 0.6744897501960817, 6) AS value_robust_mad FROM e GROUP BY 1")
def robust_mad(spark, sf_dir):
    return rounded(B.robust_mad(events(spark, sf_dir), "value", BY))


@add("batch_area", f"WITH e AS ({AGE}), s AS (SELECT user_id, (value + lag(value) OVER w) / 2 * (age - lag(age) OVER w) AS a FROM e WINDOW w AS (PARTITION BY user_id ORDER BY age, event_id)) SELECT user_id, round(coalesce(sum(a), 0) / 1e3, 3) AS value_area FROM s GROUP BY 1")
def area(spark, sf_dir):
    return B.area(events(spark, sf_dir), "value", "age", BY, ["event_id"]).select("user_id", F.round(F.col("value_area") / 1e3, 3).alias("value_area"))


CROSS = f"WITH e AS ({AGE}), s AS (SELECT user_id, value AS x, age AS t, lag(value) OVER w AS x0, lag(age) OVER w AS t0 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY age, event_id))"


@add("batch_crossings", CROSS + " SELECT user_id, round(t0 + (50 - x0) / (x - x0) * (t - t0), 3) AS at, CASE WHEN x0 <= 50 AND x > 50 THEN 'rising' ELSE 'falling' END AS direction FROM s WHERE (x0 <= 50 AND x > 50) OR (x0 > 50 AND x <= 50)")
def crossings(spark, sf_dir):
    return rounded(B.crossings(events(spark, sf_dir), "value", "age", BY, 50.0, order=["event_id"]), 3)


@add("batch_first_crossing", CROSS + ", f AS (SELECT user_id, min(t0 + (50 - x0) / (x - x0) * (t - t0)) AS a FROM s WHERE x0 <= 50 AND x > 50 GROUP BY 1) SELECT user_id, round(a, 3) AS value_crossing FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN f USING (user_id)")
def first_crossing(spark, sf_dir):
    return rounded(B.first_crossing(events(spark, sf_dir), "value", "age", BY, 50.0, "rising", ["event_id"]), 3)


@add(
    "batch_slope",
    f"WITH e AS ({AGE}), i AS (SELECT a.user_id, a.event_id, median((b.value - a.value) / (b.age - a.age)) AS s FROM e a JOIN e b ON a.user_id = b.user_id AND a.age <> b.age GROUP BY 1, 2) SELECT u.user_id, round(median(s) * 1e6, 4) AS slope FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN i ON i.user_id = u.user_id GROUP BY 1",
)
def slope(spark, sf_dir):
    return B.slope(events(spark, sf_dir), "value", "age", BY).select("user_id", F.when(~F.isnan("value_slope"), F.round(F.col("value_slope") * 1e6, 4)).alias("slope"))


@add("batch_elbow")
def elbow(spark, sf_dir):
    return B.elbow(events(spark, sf_dir), "value", "age", BY)


@add("batch_melt", "UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem) ON l_quantity, l_tax INTO NAME tag VALUE value")
def melt(spark, sf_dir):
    return B.melt(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax"])


WIDE = ", ".join(f'max({c}) FILTER (WHERE l_linenumber = {k}) AS "{k}_{c}"' for k in range(1, 8) for c in ("l_quantity", "l_tax"))


@add("batch_widen", f"SELECT l_orderkey, {WIDE} FROM lineitem GROUP BY 1")
def widen(spark, sf_dir):
    return B.widen(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", ["l_quantity", "l_tax"], list(range(1, 8)))


@add("batch_widen_all", "SELECT l_orderkey, max(l_quantity) FILTER (WHERE l_linenumber = 1) AS \"1_l_quantity\", max(l_quantity) FILTER (WHERE l_linenumber = 2) AS \"2_l_quantity\", max(l_quantity) FILTER (WHERE l_linenumber = 3) AS \"3_l_quantity\", max(l_quantity) FILTER (WHERE l_linenumber = 4) AS \"4_l_quantity\", max(l_quantity) FILTER (WHERE l_linenumber = 5) AS \"5_l_quantity\", max(l_quantity) FILTER (WHERE l_linenumber = 6) AS \"6_l_quantity\", max(l_quantity) FILTER (WHERE l_linenumber = 7) AS \"7_l_quantity\" FROM lineitem GROUP BY 1")
def widen_all(spark, sf_dir):
    return B.widen(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", ["l_quantity"])


@add("batch_sequence", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS _sequence_ FROM events")
def sequence(spark, sf_dir):
    return B.sequence(events(spark, sf_dir), "user_id", "event_id").select("user_id", "event_id", "_sequence_")
