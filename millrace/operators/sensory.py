"""Panels of assessors: a long table of panelist_id, session, product, attribute, replicate, score."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import distributions as D

LABELS = ("panelist_id", "product", "attribute")


def clean(panel: DataFrame) -> DataFrame:
    """Labels trimmed, scores as numbers (others become null)."""
    return panel.withColumns({c: F.trim(F.col(c).cast("string")) for c in LABELS} | {"score": F.col("score").try_cast("double")})


def reshape_to_long(df: DataFrame, layout: str, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Wide by attribute or by product to one score a row; raises if a count or mean does not survive."""
    if layout == "long":
        return clean(df)
    name = {"wide_by_attribute": "attribute", "wide_by_product": "product"}[layout]
    long = clean(df.withColumns({v: F.col(v).try_cast("double") for v in values}).unpivot(list(ids), list(values), name, "score"))
    before = df.agg(*(F.avg(F.col(v).try_cast("double")).alias(v) for v in values)).first().asDict()
    after = {r[name]: r["m"] for r in long.groupBy(name).agg(F.avg("score").alias("m")).collect()}
    bad = [v for v in values if (before[v] is None) != (after[v.strip()] is None) or before[v] is not None and abs(before[v] - after[v.strip()]) > 1e-8 + 1e-6 * abs(before[v])]
    if bad:
        raise ValueError(f"means changed on the way: {bad}")
    return long


def validate(panel: DataFrame, covariates: DataFrame | None = None, low: float | None = None, high: float | None = None, warn: float = 0.05, error: float = 0.2) -> dict:
    """Counts, problems, and a hash of the rows that does not depend on their order; a few aggregates, nothing gathered."""
    p = clean(panel)
    bad = F.lit(False)
    if low is not None:
        bad = bad | (F.col("score") < low)
    if high is not None:
        bad = bad | (F.col("score") > high)
    row = p.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("score").isNull().cast("long")).alias("missing"),
        F.sum(F.coalesce(bad, F.lit(False)).cast("long")).alias("out_of_range"),
        *(F.countDistinct(c).alias(c) for c in LABELS),
        F.sum(F.xxhash64(*LABELS, F.col("session").cast("string"), F.col("replicate").cast("string"), "score").cast("decimal(38,0)")).alias("hash"),
    ).first()
    cells = p.filter("score IS NOT NULL").select(*LABELS).distinct().count()
    whole = row["panelist_id"] * row["product"] * row["attribute"]
    unbalanced = 1 - cells / whole if whole else 1.0
    errors, warnings = [], []
    if row["out_of_range"]:
        errors.append(f"{row['out_of_range']} scores are out of range")
    if unbalanced > error:
        errors.append(f"{unbalanced:.1%} of the cells are empty")
    elif unbalanced > warn:
        warnings.append(f"{unbalanced:.1%} of the cells are empty")
    if row["missing"]:
        warnings.append(f"{row['missing']} scores are missing")
    if covariates is not None:
        alone = p.select("product").distinct().join(covariates.select(F.trim("product").alias("product")), "product", "left_anti").count()
        if alone:
            errors.append(f"{alone} products have no covariates")
    return {"ok": not errors, "errors": errors, "warnings": warnings, "content_hash": str(row["hash"]), "rows": row["rows"], "empty_cells": unbalanced}


def aggregate_to_product(panel: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """One row a product, one column of mean scores for each attribute."""
    return panel.groupBy("product").pivot("attribute", list(attributes)).agg(F.avg("score"))


def product_means(panel: DataFrame, conflevel: float = 0.95) -> DataFrame:
    """Mean, deviation, count and t interval of each product and attribute."""
    out = panel.filter("score IS NOT NULL").groupBy("product", "attribute").agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd"), F.count("score").alias("n"))
    c = F.pandas_udf(lambda n: n.map(lambda k: D.t_ppf(0.5 + conflevel / 2, int(k) - 1) if k > 1 else math.nan).astype(float), "double")
    half = c("n") * F.col("sd") / F.sqrt("n")
    return out.withColumn("ci_low", F.col("mean") - half).withColumn("ci_high", F.col("mean") + half)


def _corr(a, b):
    """Pearson's correlation; null where one does not vary."""
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def scorecard(panel: DataFrame) -> DataFrame:
    """Of each panelist and attribute: discrimination (eta squared of products), agreement (correlation with the others' product means), shift, spread and drift (correlation with session)."""
    p = panel.filter("score IS NOT NULL")
    by = ["panelist_id", "attribute"]
    own = p.groupBy(*by, "product").agg(F.avg("score").alias("mean"), F.count("score").alias("n"), F.sum("score").alias("total"))
    # the others' mean: the whole sum less the panelist's
    all_ = p.groupBy("attribute", "product").agg(F.sum("score").alias("all_total"), F.count("score").alias("all_n"))
    cells = own.join(all_, ["attribute", "product"]).withColumn("others", (F.col("all_total") - F.col("total")) / F.nullif(F.col("all_n") - F.col("n"), F.lit(0)))
    between = cells.groupBy(*by).agg(F.sum(F.col("n") * F.col("mean") ** 2).alias("ss"), F.sum("total").alias("t"), F.sum("n").alias("k"), _corr("mean", "others").alias("agreement"), (F.avg("mean") - F.avg("others")).alias("shift"), F.try_divide(F.stddev_samp("mean"), F.stddev_samp("others")).alias("spread"))
    whole = p.groupBy(*by).agg((F.var_pop("score") * F.count("score")).alias("tss"), _corr(F.col("session").cast("double"), F.col("score")).alias("drift"))
    out = between.join(whole, by)
    eta = F.when(F.col("tss") > 0, (F.col("ss") - F.col("t") ** 2 / F.col("k")) / F.col("tss"))
    return out.select(*by, eta.alias("discrimination"), "agreement", "shift", "spread", "drift")


#: Fixed values of flagging: agreement at or below the floor is a reason by itself, low outliers are one below the suspect values, among so many panelists at least.
AGREEMENT_FLOOR, AGREEMENT_SUSPECT, DISCRIMINATION_SUSPECT, PANELISTS_FOR_ESD = 0.0, 0.5, 0.5, 4


def panelists(panel: DataFrame) -> DataFrame:
    """One row a panelist: discrimination (mean over attributes), agreement with the panel over products and attributes, scale_shift, scale_spread and drift (correlation of session means with their order)."""
    p = panel.filter("score IS NOT NULL")
    cell = p.groupBy("panelist_id", "product", "attribute").agg(F.avg("score").alias("m"))
    consensus = cell.groupBy("product", "attribute").agg(F.avg("m").alias("c"))
    agreement = cell.join(consensus, ["product", "attribute"]).groupBy("panelist_id").agg(_corr("m", "c").alias("agreement"))
    discrimination = scorecard(p).groupBy("panelist_id").agg(F.avg("discrimination").alias("discrimination"))
    whole = p.agg(F.avg("score").alias("_mean"), F.stddev_samp("score").alias("_sd"))
    use = p.groupBy("panelist_id").agg(F.avg("score").alias("_own"), F.stddev_samp("score").alias("_spread")).crossJoin(F.broadcast(whole))
    use = use.select("panelist_id", (F.col("_own") - F.col("_mean")).alias("scale_shift"), F.try_divide(F.col("_spread"), F.col("_sd")).alias("scale_spread"))
    session = p.groupBy("panelist_id", "session").agg(F.avg("score").alias("m")).withColumn("k", F.row_number().over(W.partitionBy("panelist_id").orderBy("session")).cast("double"))
    drift = session.groupBy("panelist_id").agg(_corr("m", "k").alias("drift"))
    return discrimination.join(agreement, "panelist_id").join(use, "panelist_id").join(drift, "panelist_id")


def flag_panelists(panel: DataFrame) -> DataFrame:
    """panelists() and the reasons to look at each: low agreement with the panel, or low discrimination between products; a panel's members are few."""
    from millrace.operators.univariate import esd_of

    table = panelists(panel).orderBy("panelist_id").toPandas()

    def low(name: str) -> set[int]:
        x = table[name].dropna()
        if len(x) < PANELISTS_FOR_ESD:
            return set()
        found = [x.index[at] for at, _, _, outlier in esd_of(x.to_numpy(float), max(1, len(x) // 4), robust=True) if outlier]
        return {i for i in found if x[i] < x.median()}

    few, dull = low("agreement"), low("discrimination")
    reasons = []
    for i, r in table.iterrows():
        own = []
        if r["agreement"] <= AGREEMENT_FLOOR or i in few and r["agreement"] < AGREEMENT_SUSPECT:
            own.append("low agreement with the panel")
        if i in dull and r["discrimination"] < DISCRIMINATION_SUSPECT:
            own.append("low discrimination between products")
        reasons.append(own)
    rows = [(str(r["panelist_id"]), *(None if pd.isna(r[c]) else float(r[c]) for c in table.columns[1:]), bool(own), own) for (_, r), own in zip(table.iterrows(), reasons, strict=True)]
    return panel.sparkSession.createDataFrame(rows, ", ".join(["panelist_id string", *(f"{c} double" for c in table.columns[1:]), "flagged boolean", "reasons array<string>"]))


def mixed_assessor(panel: DataFrame) -> DataFrame:
    """The mixed assessor model of each attribute: F tests of products against interaction without and with scaling differences.

    A balanced panel's sums of squares come from cell, product and panelist means.
    """
    p = panel.filter("score IS NOT NULL")
    cell = p.groupBy("attribute", "panelist_id", "product").agg(F.avg("score").alias("m"))
    by = W.partitionBy("attribute")
    cell = cell.withColumn("g", F.avg("m").over(by)).withColumn("a", F.avg("m").over(W.partitionBy("attribute", "panelist_id"))).withColumn("b", F.avg("m").over(W.partitionBy("attribute", "product")))
    x, y = F.col("b") - F.col("g"), F.col("m") - F.col("a")
    slope = cell.groupBy("attribute", "panelist_id").agg(F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx")).withColumn("beta", F.when(F.col("xx") > 0, F.col("xy") / F.col("xx")).otherwise(F.lit(1.0)))
    cell = cell.join(slope.select("attribute", "panelist_id", "beta"), ["attribute", "panelist_id"])
    rest = y - F.col("beta") * x
    ss = cell.groupBy("attribute").agg(
        F.countDistinct("panelist_id").alias("i"),
        F.countDistinct("product").alias("j"),
        F.sum(x * x).alias("ss_product"),
        F.sum((F.col("a") - F.col("g")) ** 2).alias("ss_panelist"),
        F.sum((y - x) ** 2).alias("ss_interaction"),
        F.sum((F.col("beta") - 1) ** 2 * x * x).alias("ss_scaling"),
        F.sum(rest * rest).alias("ss_disagreement"),
    )

    def tests(i: pd.Series, j: pd.Series, product: pd.Series, interaction: pd.Series, disagreement: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, p_, q, d in zip(i, j, product, interaction, disagreement, strict=True):
            ms, mi, md = p_ / (b - 1) if b > 1 else math.nan, q / ((a - 1) * (b - 1)) if a > 1 and b > 1 else math.nan, d / ((a - 1) * (b - 2)) if a > 1 and b > 2 else math.nan
            classical, mam = ms / mi if mi and mi > 0 else math.nan, ms / md if md and md > 0 else math.nan
            out.append((classical, D.f_tail(classical, b - 1, (a - 1) * (b - 1)) if classical == classical else math.nan, mam, D.f_tail(mam, b - 1, (a - 1) * (b - 2)) if mam == mam else math.nan))
        return pd.DataFrame(out, columns=["f", "p", "f_mam", "p_mam"], dtype=float)

    test = F.pandas_udf(tests, "f double, p double, f_mam double, p_mam double")
    return ss.withColumn("_t", test("i", "j", "ss_product", "ss_interaction", "ss_disagreement")).select("attribute", "ss_product", "ss_panelist", "ss_interaction", "ss_scaling", "ss_disagreement", "_t.*")


def align_scores(panel: DataFrame, method: str = "both") -> DataFrame:
    """Scores with each panelist's level, and range of use, brought to the panel's; a slope below 0.2 counts as 1."""
    p = panel.filter("score IS NOT NULL")
    cell = p.groupBy("attribute", "panelist_id", "product").agg(F.avg("score").alias("m"))
    product = cell.groupBy("attribute", "product").agg(F.avg("m").alias("b"))
    level = cell.groupBy("attribute", "panelist_id").agg(F.avg("m").alias("own"))
    grand = cell.groupBy("attribute").agg(F.avg("m").alias("grand"))
    slope = cell.join(product, ["attribute", "product"]).groupBy("attribute", "panelist_id").agg(F.try_divide(F.covar_samp("m", "b"), F.var_samp("b")).alias("beta"))
    slope = slope.withColumn("beta", F.when((F.col("beta") >= 0.2) & ~F.isnan("beta"), F.col("beta")).otherwise(1.0))
    out = p.join(level, ["attribute", "panelist_id"]).join(grand, "attribute").join(slope, ["attribute", "panelist_id"])
    scale = F.col("beta") if method in ("scale", "both") else F.lit(1.0)
    center = F.col("grand") if method in ("location", "both") else F.col("own")
    return out.withColumn("aligned", center + (F.col("score") - F.col("own")) / scale).drop("own", "grand", "beta")


def tukey_hsd(df: DataFrame, value: str, group: str, by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """All pairs of groups by the studentised range, with Kramer's error for unequal counts; from the groups' moments."""
    x = df.select(*by, F.col(group).alias("g"), F.col(value).alias("x")).dropna()
    g = x.groupBy(*by, "g").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("v"))
    pool = g.groupBy(*by).agg(F.count("*").alias("k"), (F.sum("n") - F.count("*")).alias("dof"), (F.sum((F.col("n") - 1) * F.coalesce("v", F.lit(0.0))) / (F.sum("n") - F.count("*"))).alias("mse"))
    a = g.select(*by, F.col("g").alias("group_a"), F.col("n").alias("n_a"), F.col("mean").alias("mean_a"))
    b = g.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("g").alias("group_b"), F.col("n").alias("n_b"), F.col("mean").alias("mean_b"))
    same = [a[c] == b[f"_{c}"] for c in by]
    pairs = a.join(b, [*same, F.col("group_a") < F.col("group_b")]).drop(*(f"_{c}" for c in by))
    pairs = pairs.join(pool, list(by)) if by else pairs.crossJoin(F.broadcast(pool))
    se = F.sqrt(F.col("mse") / 2 * (1 / F.col("n_a") + 1 / F.col("n_b")))
    out = pairs.withColumn("difference", F.col("mean_b") - F.col("mean_a")).withColumn("q", F.abs("difference") / se)
    p = F.pandas_udf(lambda q, k, v: pd.Series([1 - D.studentized_range_cdf(a, int(b), float(c)) for a, b, c in zip(q, k, v, strict=True)], dtype=float), "double")
    return out.withColumn("p_value", p("q", "k", "dof")).withColumn("significant", F.col("p_value") < alpha).drop("k", "mse")


def letters(groups: Sequence[str], different: Sequence[tuple[str, str]]) -> dict[str, str]:
    """The letters of each group: two groups share one unless they differ (insert and absorb, over few groups)."""
    columns = [set(groups)]
    for a, b in different:
        for own in [c for c in columns if a in c and b in c]:
            columns.remove(own)
            columns += [own - {a}, own - {b}]
        columns = [c for i, c in enumerate(columns) if not any(c < d or c == d and j < i for j, d in enumerate(columns))]
    columns.sort(key=lambda c: [g not in c for g in groups])
    return {g: "".join(chr(97 + i) for i, c in enumerate(columns) if g in c) for g in groups}


def compare_products(panel: DataFrame, control: object | None = None, alpha: float = 0.05) -> dict:
    """Of each attribute: the mixed model's tests, means, all pairs by Tukey, letters, and (with a control) Dunnett's comparisons."""
    from millrace.operators.comparisons import dunnett

    p = panel.filter("score IS NOT NULL")
    pairs = tukey_hsd(p, "score", "product", ["attribute"], alpha)
    means = product_means(p, 1 - alpha)
    # pairs of products, not of scores, reach the driver
    order = means.orderBy("attribute", F.desc("mean"), "product").select("attribute", "product").collect()
    found: dict = {}
    for r in pairs.filter("significant").select("attribute", "group_a", "group_b").collect():
        found.setdefault(r["attribute"], []).append((r["group_a"], r["group_b"]))
    named = [(a, g, x) for a in dict.fromkeys(r["attribute"] for r in order) for g, x in letters([r["product"] for r in order if r["attribute"] == a], found.get(a, [])).items()]
    out = {"tests": mixed_assessor(p), "means": means, "pairs": pairs, "letters": panel.sparkSession.createDataFrame(named, "attribute string, product string, letters string")}
    if control is not None:
        attributes = list(dict.fromkeys(r["attribute"] for r in order))
        out["dunnett"] = {a: dunnett(p.filter(F.col("attribute") == a), "score", "product", control, alpha) for a in attributes}
    return out


def analyze_descriptive(panel: DataFrame, covariates: DataFrame | None = None, drop: Sequence[str] = (), correction: str = "none", low: float | None = None, high: float | None = None) -> dict:
    """A panel from validation to relations: validation, scorecard, tests, corrected scores (none, location, scale or both), product means and their correlations with covariates."""
    from millrace.operators.comparisons import relate
    from millrace.operators.structures import apply_correction

    checked = validate(panel, covariates, low, high)
    p = apply_correction(clean(panel), drop)
    aligned = p if correction == "none" else align_scores(p, correction).drop("score").withColumnRenamed("aligned", "score")
    attributes = sorted(r[0] for r in p.select("attribute").distinct().collect())  # one row an attribute
    products = aggregate_to_product(aligned, attributes)
    out = {"validation": checked, "scorecard": scorecard(p), "tests": mixed_assessor(p), "scores": aligned, "products": products}
    if covariates is not None:
        own = covariates.withColumn("product", F.trim("product"))
        out["relations"] = relate(products.join(own, "product"), attributes, [c for c in own.columns if c != "product"])
    return out
