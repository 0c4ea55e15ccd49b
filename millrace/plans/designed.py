"""Queries of the analysis and optimisation of experiments, and of sets, levels and words of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import analyze, linear, optimize, structures
from millrace.plans.catalog import add
from millrace.plans.panels import PANEL, panel
from millrace.plans.stats import rounded, table
from millrace.sources.tables import written

#: Runs of a two-factor experiment: quantity and discount of a line in coded units, its price and its tax as responses.
RUNS = "SELECT l_orderkey, l_linenumber, (l_quantity - 25.5) / 24.5 AS A, (l_discount - 0.05) / 0.05 AS B, l_extendedprice + 900 * (l_quantity - 25.5) AS y FROM lineitem"
MEANS = f"r AS ({RUNS}), m AS (SELECT avg(y) AS y, avg(A) AS a, avg(B) AS b, count(*) AS n FROM r), s AS (SELECT sum((r.A - m.a) ^ 2) AS aa, sum((r.B - m.b) ^ 2) AS bb, sum((r.A - m.a) * (r.B - m.b)) AS ab, sum((r.A - m.a) * (r.y - m.y)) AS ay, sum((r.B - m.b) * (r.y - m.y)) AS by_, sum((r.y - m.y) ^ 2) AS yy FROM r, m), c AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS p, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS q FROM s, m), k AS (SELECT *, yy - p * ay - q * by_ AS rss FROM c)"


def runs(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", ((F.col("l_quantity") - 25.5) / 24.5).alias("A"), ((F.col("l_discount") - 0.05) / 0.05).alias("B"), (F.col("l_extendedprice") + 900 * (F.col("l_quantity") - 25.5)).alias("y"))


def analysed(spark, sf_dir, *analyses, **options):
    return analyze.analyze_experiment(runs(spark, sf_dir), "y", ["A", "B"], "main_effects", analyses, **options)


@add(
    "experiment_coefficients",
    f"WITH {MEANS} SELECT '(Intercept)' AS term, round(y - p * a - q * b, 3) AS coefficient, round(sqrt(rss / (n - 3) * (1.0 / n + (a ^ 2 * bb - 2 * a * b * ab + b ^ 2 * aa) / (aa * bb - ab ^ 2))), 4) AS standard_error FROM k UNION ALL SELECT 'A', round(p, 3), round(sqrt(rss / (n - 3) * bb / (aa * bb - ab ^ 2)), 4) FROM k UNION ALL SELECT 'B', round(q, 3), round(sqrt(rss / (n - 3) * aa / (aa * bb - ab ^ 2)), 4) FROM k",
)
def coefficients(spark, sf_dir):
    rows = analysed(spark, sf_dir, "coefficients").results["coefficients"]
    return spark.createDataFrame([(r["term"], round(r["coefficient"], 3), round(r["standard_error"], 4)) for r in rows], "term string, coefficient double, standard_error double")


@add(
    "experiment_summary",
    f"""WITH {MEANS}, h AS (SELECT r.y, k.y + p * (r.A - k.a) + q * (r.B - k.b) AS hat, 1.0 / n + ((r.A - k.a) ^ 2 * bb - 2 * (r.A - k.a) * (r.B - k.b) * ab + (r.B - k.b) ^ 2 * aa) / (aa * bb - ab ^ 2) AS h, n, rss, yy FROM r, k)
    SELECT round(1 - max(rss) / max(yy), 6) AS r2, round(1 - sum(((y - hat) / (1 - h)) ^ 2) / max(yy), 6) AS predicted_r2, round((max(hat) - min(hat)) / sqrt(3 * max(rss) / (max(n) - 3) / max(n)), 3) AS adequate_precision, max(n) AS n, max(n) - 3 AS dof FROM h""",
)
def summary(spark, sf_dir):
    s = analysed(spark, sf_dir, "summary").results["summary"]
    return spark.createDataFrame([(round(s["r2"], 6), round(s["predicted_r2"], 6), round(s["adequate_precision"], 3), s["n"], s["dof"])], "r2 double, predicted_r2 double, adequate_precision double, n long, dof long")


@add("experiment_effects", f"WITH {MEANS} SELECT 'A' AS term, round(2 * p, 3) AS effect FROM k UNION ALL SELECT 'B', round(2 * q, 3) FROM k")
def effects(spark, sf_dir):
    found = analysed(spark, sf_dir, "effects").results["effects"]
    return spark.createDataFrame([(t, round(v, 3)) for t, v in found.items()], "term string, effect double")


@add(
    "experiment_predictions",
    f"WITH {MEANS}, x AS (SELECT i / 2.0 - 1 AS A, j / 2.0 - 1 AS B FROM range(5) t(i), range(5) u(j)) SELECT x.A::DOUBLE AS A, x.B::DOUBLE AS B, round(y + p * (x.A - k.a) + q * (x.B - k.b), 2) AS predicted, round(1.0 / n + ((x.A - k.a) ^ 2 * bb - 2 * (x.A - k.a) * (x.B - k.b) * ab + (x.B - k.b) ^ 2 * aa) / (aa * bb - ab ^ 2), 9) AS leverage FROM x, k",
)
def predictions(spark, sf_dir):
    """The half-width of the confidence interval tells the leverage of a setting."""
    from millrace.functions import distributions as D

    points = optimize.grid(spark, {"A": (-1.0, 1.0), "B": (-1.0, 1.0)}, 5)
    result = analysed(spark, sf_dir, "prediction", points=points)
    m = result.model
    c = float(D.t_ppf(0.975, m.dof)) ** 2 * m.rss / m.dof
    out = result.results["prediction"]
    return out.select("A", "B", F.round("predicted", 2).alias("predicted"), F.round(((F.col("ci_high") - F.col("ci_low")) / 2) ** 2 / c, 9).alias("leverage"))


@add("experiment_confirmation")
def confirmation(spark, sf_dir):
    return analysed(spark, sf_dir, "confirmation", points=runs(spark, sf_dir), observed="y").results["confirmation"]


@add("experiment_analyses")
def every_analysis(spark, sf_dir):
    """What each analysis of the published two-level experiment gives, as text."""
    from millrace.sources.datasets import data

    wanted = ("anova", "coefficients", "significance", "confidence_intervals", "lenth", "model_selection", "box_cox", "summary")
    found = analyze.analyze_experiment(data(spark, "pollutant"), "y", ["C", "T", "S"], "main_effects", wanted, transform="log").results
    return spark.createDataFrame([(k, str(v)) for k, v in sorted(found.items())], "analysis string, result string")


#: Cells of quantity and discount by thirds of their ranges: the mean price of their lines in thousands, and the mean tax in percent.
CELLS_SQL = """cells AS (SELECT CASE WHEN l_quantity < 18 THEN -1 WHEN l_quantity < 34 THEN 0 ELSE 1 END AS A, CASE WHEN l_discount < 0.035 THEN -1 WHEN l_discount < 0.065 THEN 0 ELSE 1 END AS B, avg(l_extendedprice) / 1000 AS s, avg(l_tax) * 100 AS c FROM lineitem GROUP BY ALL),
    h AS (SELECT sum(A * s) / 6 AS sa, sum(B * s) / 6 AS sb, sum(A * B * s) / 4 AS sab, sum((A * A - 2.0 / 3) * s) / 2 AS saa, sum((B * B - 2.0 / 3) * s) / 2 AS sbb, avg(s) AS sm, avg(c) AS c0, sum(A * c) / 6 AS ca, sum(B * c) / 6 AS cb, sum(A * B * c) / 4 AS cab, min(s) AS s_low, max(s) AS s_high, min(c) AS c_low, max(c) AS c_high FROM cells),
    k AS (SELECT *, sm - 2.0 / 3 * (saa + sbb) AS s0 FROM h)"""
BOUNDS = {"A": (-1.0, 1.0), "B": (-1.0, 1.0)}
GRID_SQL = "SELECT -1 + i * 0.1 AS A, -1 + j * 0.1 AS B FROM range(21) t(i), range(21) u(j)"
STRENGTH, COST = "s0 + sa * A + sb * B + saa * A * A + sbb * B * B + sab * A * B", "c0 + ca * A + cb * B + cab * A * B"


def scores_sql(grid=GRID_SQL, digits=""):
    strength, cost = (f"round({v}, 9)" if digits else v for v in (STRENGTH, COST))
    return f"{CELLS_SQL}, g AS ({grid}), y AS (SELECT g.*, {strength} AS strength, {cost} AS cost, k.* FROM g, k), d AS (SELECT *, greatest(0, least(1, (strength - s_low) / (s_high - s_low))) AS d_strength, greatest(0, least(1, (c_high - cost) / (c_high - c_low))) AS d_cost FROM y)"


def cells(spark, sf_dir):
    level = lambda c, a, b: F.when(F.col(c) < a, -1.0).when(F.col(c) < b, 0.0).otherwise(1.0)
    lines = table(spark, sf_dir, "lineitem").select(level("l_quantity", 18, 34).alias("A"), level("l_discount", 0.035, 0.065).alias("B"), "l_extendedprice", "l_tax")
    return lines.groupBy("A", "B").agg((F.avg("l_extendedprice") / 1000).alias("strength"), (F.avg("l_tax") * 100).alias("cost"))


def surfaces(spark, sf_dir):
    """A quadratic surface of the price and one with an interaction of the tax, by least squares over the nine cells; and goals between the cells' extremes."""
    nine = written(cells(spark, sf_dir).withColumns({"AA": F.col("A") * F.col("A"), "BB": F.col("B") * F.col("B"), "AB": F.col("A") * F.col("B")}))
    fit = lambda y, terms: dict(zip([(), *terms.values()], map(float, linear.OLS.fit(nine, y, list(terms)).summary()["coefficients"]), strict=True))
    main, bent = {"A": ("A",), "B": ("B",), "AB": ("A", "B")}, {"AA": ("A", "A"), "BB": ("B", "B")}
    ends = nine.agg(F.min("strength"), F.max("strength"), F.min("cost"), F.max("cost")).first()
    goals = {"strength": {"goal": "maximize", "low": ends[0], "high": ends[1]}, "cost": {"goal": "minimize", "low": ends[2], "high": ends[3]}}
    return {"strength": fit("strength", main | bent), "cost": fit("cost", main)}, goals


@add("desirability_grid", f"WITH {scores_sql()} SELECT round(A, 6)::DOUBLE AS A, round(B, 6)::DOUBLE AS B, round(strength, 6)::DOUBLE AS strength, round(cost, 6)::DOUBLE AS cost, round(d_strength, 6)::DOUBLE AS d_strength, round(d_cost, 6)::DOUBLE AS d_cost, round(CASE WHEN d_strength <= 0 OR d_cost <= 0 THEN 0 ELSE sqrt(d_strength * d_cost) END, 6)::DOUBLE AS desirability FROM d")
def desirabilities(spark, sf_dir):
    return rounded(optimize.scored(optimize.grid(spark, BOUNDS, 21), *surfaces(spark, sf_dir)))


@add("desirability_optimum", f"WITH {scores_sql('SELECT -1 + i * 0.005 AS A, -1 + j * 0.005 AS B FROM range(401) t(i), range(401) u(j)')} SELECT round(max(sqrt(d_strength * d_cost)), 2)::DOUBLE AS desirability FROM d")
def optimum(spark, sf_dir):
    found, goals = surfaces(spark, sf_dir)
    best = optimize.optimize_responses(spark, found, BOUNDS, goals=goals)
    return spark.createDataFrame([(round(best["desirability"], 2),)], "desirability double")


@add("pareto_front", f"WITH {scores_sql(digits='9')} SELECT round(A, 6)::DOUBLE AS A, round(B, 6)::DOUBLE AS B, round(strength, 6)::DOUBLE AS strength, round(cost, 6)::DOUBLE AS cost FROM y a WHERE NOT EXISTS (SELECT 1 FROM y b WHERE b.strength >= a.strength AND b.cost <= a.cost AND (b.strength > a.strength OR b.cost < a.cost))")
def front(spark, sf_dir):
    points = optimize.grid(spark, BOUNDS, 21).withColumns({r: F.round(optimize.evaluate(s), 9) for r, s in surfaces(spark, sf_dir)[0].items()})
    return rounded(optimize.pareto_front(points, {"strength": "maximize", "cost": "minimize"}))


@add("pareto_parts", "SELECT p_partkey, p_size, p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size >= a.p_size AND b.p_retailprice <= a.p_retailprice AND (b.p_size > a.p_size OR b.p_retailprice < a.p_retailprice))")
def front_of_parts(spark, sf_dir):
    """Large parts at low prices."""
    return optimize.pareto_front(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), {"p_size": "maximize", "p_retailprice": "minimize"})


@add(
    "canonical_analysis",
    f"""WITH {CELLS_SQL}, e AS (SELECT *, (saa + sbb) / 2 AS mid, sqrt(((saa - sbb) / 2) ^ 2 + (sab / 2) ^ 2) AS half, 4 * saa * sbb - sab * sab AS det FROM k)
    SELECT round((sab * sb - 2 * sbb * sa) / det, 6) AS A, round((sab * sa - 2 * saa * sb) / det, 6) AS B, round(mid - half, 6) AS low, round(mid + half, 6) AS high, CASE WHEN mid + half < 0 THEN 'maximum' WHEN mid - half > 0 THEN 'minimum' ELSE 'saddle' END AS kind FROM e""",
)
def canonical(spark, sf_dir):
    out = optimize.canonical_analysis(surfaces(spark, sf_dir)[0]["strength"], ["A", "B"])
    return spark.createDataFrame([(round(out["x"]["A"], 6), round(out["x"]["B"], 6), round(out["eigenvalues"][0], 6), round(out["eigenvalues"][1], 6), out["kind"])], "A double, B double, low double, high double, kind string")


@add("steepest_ascent", f"WITH {CELLS_SQL} SELECT i AS step, round(i * 0.5 * sa / sqrt(sa ^ 2 + sb ^ 2), 6) AS A, round(i * 0.5 * sb / sqrt(sa ^ 2 + sb ^ 2), 6) AS B FROM range(11) t(i), k")
def ascent(spark, sf_dir):
    rows = optimize.optimize_responses(spark, {"strength": surfaces(spark, sf_dir)[0]["strength"]}, BOUNDS, "steepest_ascent")
    return spark.createDataFrame([(r["step"], round(r["A"], 6), round(r["B"], 6)) for r in rows], "step long, A double, B double")


@add("coded_factors", "SELECT l_orderkey, l_linenumber, round((l_quantity - 25.5) / 24.5, 6) AS l_quantity, round((l_discount - 0.05) / 0.05, 6) AS l_discount FROM lineitem")
def coded(spark, sf_dir):
    factors = [structures.Factor("l_quantity", 1.0, 50.0), structures.Factor("l_discount", 0.0, 0.1)]
    return rounded(structures.Experiment(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"), factors).to_coded())


@add("allowed_runs", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity + 100 * l_discount <= 40 AND l_quantity - 50 * l_tax >= 5 GROUP BY 1")
def allowed(spark, sf_dir):
    rules = [structures.Constraint((("l_quantity", 1.0), ("l_discount", 100.0)), 40.0), structures.Constraint((("l_quantity", 1.0), ("l_tax", -50.0)), 5.0, at_most=False)]
    return structures.Experiment(table(spark, sf_dir, "lineitem")).allowed(rules).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@add("appended_runs", "SELECT r_name AS name, r_regionkey::BIGINT AS k, NULL::INT AS region FROM region UNION ALL SELECT n_name, n_nationkey, n_regionkey FROM nation")
def appended(spark, sf_dir):
    a = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("k"))
    b = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("k"), F.col("n_regionkey").alias("region"))
    return structures.Experiment(a).extend(b).df


@add("matched_orders", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def matched(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return structures.matched(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), lines, ["o_orderkey"])


@add("key_sets", "WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9900), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000) SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'right' WHEN b.k IS NULL THEN 'left' ELSE 'both' END AS found_in FROM a FULL JOIN b ON a.k = b.k")
def key_sets(spark, sf_dir):
    a = table(spark, sf_dir, "customer").filter("c_acctbal > 9900").select(F.col("c_nationkey").alias("k"))
    b = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    return structures.key_sets(a, b, ["k"])


@add("changed_means", "WITH a AS (SELECT l_suppkey, avg(l_quantity) AS b FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-01-01' GROUP BY 1), c AS (SELECT l_suppkey, avg(l_quantity) AS a FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY 1) SELECT coalesce(a.l_suppkey, c.l_suppkey) AS l_suppkey, round(b, 6) AS before, round(a, 6) AS after, round(a - b, 6) AS change FROM a FULL JOIN c ON a.l_suppkey = c.l_suppkey")
def changed(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("old", F.col("l_shipdate") < F.lit("1995-01-01").cast("timestamp_ntz"))
    return rounded(structures.changed_means(lines.filter("old"), lines.filter("NOT old"), ["l_suppkey"], "l_quantity"))


@add("panel_levels", f"WITH p AS ({PANEL}) SELECT product, attribute, round(avg(score), 6) AS mean, count(score) AS n, (CASE WHEN grouping(product) = 1 THEN 2 ELSE 0 END + CASE WHEN grouping(attribute) = 1 THEN 1 ELSE 0 END)::BIGINT AS level FROM p GROUP BY GROUPING SETS ((product, attribute), (product), (attribute), ())")
def levels(spark, sf_dir):
    return rounded(structures.level_means(panel(spark, sf_dir), "score", [["product", "attribute"], ["product"], ["attribute"], []]))


@add("keyword_rank", "WITH w AS (SELECT p_partkey, list_distinct(regexp_extract_all(lower(concat(p_name, ' ', p_type)), '[a-z0-9]+')) AS words FROM part), q AS (SELECT unnest(['blue', 'bolt', 'a', 'gear', 'small']) AS word) SELECT p_partkey, count(*) AS score FROM w, q WHERE list_contains(words, word) GROUP BY 1")
def ranked(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return structures.keyword_rank(parts, "p_partkey", "text", "Blue bolt: a gear, SMALL; blue")


@add("gathered_columns", "SELECT o_orderkey, o_totalprice AS price, o_custkey AS customer FROM orders WHERE o_custkey > 50")
def gathered(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return structures.gather({"price": orders.select("o_orderkey", "o_totalprice"), "customer": orders.select("o_orderkey", F.when(F.col("o_custkey") > 50, F.col("o_custkey")).alias("c"))}, "o_orderkey")


@add("panel_corrected", f"WITH p AS ({PANEL}) SELECT panelist_id, count(*) AS n, round(avg(score), 6) AS mean FROM p WHERE panelist_id NOT IN ('3', '7') GROUP BY 1")
def corrected(spark, sf_dir):
    return rounded(structures.apply_correction(panel(spark, sf_dir), ["3", "7"]).groupBy("panelist_id").agg(F.count("*").alias("n"), F.avg("score").alias("mean")))
