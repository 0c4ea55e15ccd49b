"""Mixing sources to target weights: iterative proportional fitting.

The tokens of documents (pieces, as `tokens` counts them) are summed by cell
(source, language, topic).  Raking scales the cells until the sums over each
dimension have their target shares: each sweep brings one dimension after
another to its targets.  A cell's weight is its fitted over its actual tokens;
documents are kept with a probability in proportion to it, by a hash of their
id.  The cell of the largest weight sets the scale: it is kept whole, and every
cell has its exact share, however scarce it is.  Only a caller that passes a
slack keeps more: cells with at most that share of all tokens are then kept
whole too, and fall short of their targets.

Cells are few (sources x languages x topics), but not bounded by anything here:
up to CELLS of them are raked in numpy, more of them as DataFrames.  Targets not
given are the actual shares to the power TEMPERATURE.  Documents have no topic
of their own: a caller may pass one as a column, else plain marks in the text
make it.

Defined cases: null text is empty and has no tokens; a null source, language or
topic is the empty one.  Rows that repeat a doc_id are kept or dropped together;
rows without one too.  A very long text counts whole.  A target for a value
without tokens is left out, and the rest keep their proportions; of documents
with one weight, all or none are above a probability of 1.  A cell without
tokens has the weight 1.  An empty table gives an empty result.  Other columns
are passed on or not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common as C
from millrace.llm.tokens import token_counts

DIMENSIONS = ("source", "lang", "topic")
TEMPERATURE = 0.7
SLACK = 0.0
SWEEPS = 100
TOLERANCE = 1e-9
CELLS = 200_000
SEED = 5


def topic(text: Column) -> Column:
    """What kind of text it is, by plain marks."""
    return (
        F.when(F.lower(text).contains("license"), "legal")
        .when(text.contains(" | "), "tabular")
        .when(text.rlike("[0-9]"), "figures")
        .otherwise("prose")
    )


def cell(docs: DataFrame, own: Column | None) -> dict[str, Column]:
    """Source, language and topic of each document."""
    text = F.coalesce("text", F.lit(""))
    return {"source": F.coalesce(docs["source"], F.lit("")), "lang": F.coalesce(docs["lang"], F.lit("")), "topic": topic(text) if own is None else F.coalesce(own.cast("string"), F.lit(""))}


def pieces(docs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """doc_id, the kept columns and n_tokens as op5 counts them."""
    return token_counts(docs, keep=keep).drop("n_bytes", "over_limit")


def measured(docs: DataFrame, own: Column | None, count: Callable[[DataFrame, Sequence[str]], DataFrame] = pieces) -> DataFrame:
    """doc_id, cell and n_tokens of every document, without its text; written, as it is read twice."""
    return C.cut(count(docs.select("doc_id", "text", *(c.alias(d) for d, c in cell(docs, own).items())), DIMENSIONS))


def shares(sums: dict[str, float], targets: dict[str, float] | None, temperature: float) -> dict[str, float]:
    """Target share of each value that has tokens: as given, or tempered; values that are not given share what is left."""
    sums = {k: v for k, v in sums.items() if v > 0}
    total = sum(sums.values())
    if targets is None:
        raw = {k: (v / total) ** temperature for k, v in sums.items()}
    else:
        rest = {k: v for k, v in sums.items() if k not in targets}
        left = max(0.0, 1 - sum(targets.values())) / max(sum(rest.values()), 1)
        raw = {k: targets.get(k, left * v) for k, v in sums.items()}
    whole = sum(raw.values())
    return {k: v / whole for k, v in raw.items()} if whole > 0 else {k: v / total for k, v in sums.items()}


def rake(tokens: np.ndarray, codes: list[np.ndarray], goals: list[np.ndarray], sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Fitted tokens of cells; codes: each dimension's value of each cell, goals: each value's target share."""
    total = max(tokens.sum(), 1)
    fit = tokens.astype(float)
    for _ in range(sweeps):
        off = 0.0
        for code, goal in zip(codes, goals, strict=True):
            sums = np.bincount(code, fit, len(goal))
            off = max(off, np.abs(sums / total - goal).max(initial=0))
            fit = fit * np.divide(goal * total, sums, out=np.zeros_like(goal), where=sums > 0)[code]
        if off < tolerance:
            break
    return fit


def _rake_wide(cells: DataFrame, goals: dict[str, dict[str, float] | None], temperature: float, sweeps: int, tolerance: float) -> DataFrame:
    """The same by DataFrames: a sweep is an aggregate and a join for each dimension."""
    spark = cells.sparkSession
    total = cells.agg(F.sum("tokens")).first()[0]
    aims = {}
    for d in DIMENSIONS:
        sums = cells.groupBy(d).agg(F.sum("tokens").alias("own")).filter("own > 0")
        given = goals.get(d)
        if given is None:
            aim = sums.withColumn("aim", F.pow(F.col("own") / total, temperature))
        else:
            table = spark.createDataFrame(list(given.items()), f"{d} string, given double") if given else spark.createDataFrame([], f"{d} string, given double")
            aim = C.cut(sums.join(table, d, "left"))
            rest = aim.filter("given IS NULL").agg(F.sum("own")).first()[0] or 1
            aim = aim.withColumn("aim", F.coalesce("given", F.lit(max(0.0, 1 - sum(given.values())) / rest) * F.col("own")))
        aim = C.cut(aim)
        whole = aim.agg(F.sum("aim")).first()[0] or 0
        aims[d] = C.cut(aim.select(d, (F.col("aim") / whole if whole > 0 else F.col("own") / total).alias("aim")))
    fit = C.cut(cells.withColumn("fit", F.col("tokens").cast("double")))
    for _ in range(sweeps):
        off = 0.0
        for d in DIMENSIONS:
            sums = C.cut(fit.groupBy(d).agg(F.sum("fit").alias("sum")).join(aims[d], d, "left"))
            off = max(off, sums.agg(F.max(F.abs(F.col("sum") / total - F.coalesce("aim", F.lit(0.0))))).first()[0] or 0)
            factor = F.when(F.col("sum") > 0, F.coalesce("aim", F.lit(0.0)) * total / F.col("sum")).otherwise(0.0)
            fit = fit.join(sums.select(d, factor.alias("factor")), d).withColumn("fit", F.col("fit") * F.col("factor")).drop("factor")
        fit = C.cut(fit)
        if off < tolerance:
            break
    return fit


def weights(rows: DataFrame, targets: dict[str, dict[str, float]] | None = None, temperature: float = TEMPERATURE, slack: float = SLACK, sweeps: int = SWEEPS, tolerance: float = TOLERANCE, most: int = CELLS) -> tuple[DataFrame, bool]:
    """Of each cell of measured rows: source, lang, topic, weight and probability; and whether the cells are few enough to broadcast."""
    spark, targets = rows.sparkSession, targets or {}
    cells = C.cut(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")))
    few = cells.count() <= most
    if few:
        held = sorted(tuple(r) for r in cells.collect())
        tokens = np.array([r[3] for r in held], np.int64)
        codes, goals = [], []
        for k, d in enumerate(DIMENSIONS):
            values, code = np.unique(np.array([r[k] for r in held], object), return_inverse=True) if held else (np.array([]), np.zeros(0, np.int64))
            goal = shares(dict(zip(values, np.bincount(code, tokens, len(values)), strict=True)), targets.get(d), temperature)
            codes.append(code)
            goals.append(np.array([goal.get(v, 0.0) for v in values]))
        fit = rake(tokens, codes, goals, sweeps, tolerance)
        fitted = spark.createDataFrame([(*r, float(f)) for r, f in zip(held, fit, strict=True)], "source string, lang string, topic string, tokens long, fit double")
    else:
        fitted = _rake_wide(cells, targets, temperature, sweeps, tolerance)
    fitted = fitted.withColumn("weight", F.when(F.col("tokens") > 0, F.col("fit") / F.col("tokens")).otherwise(1.0))
    # the scale: weights in steps of a thousandth of their logarithm, so that the driver sees a bounded list
    steps = fitted.filter("tokens > 0 AND weight > 0").groupBy(F.ceil(F.log("weight") * 1000).alias("step")).agg(F.sum("tokens").alias("tokens")).collect()
    total = sum(r["tokens"] for r in steps)
    scale, over = 1.0, 0
    for step, n in sorted(((r["step"], r["tokens"]) for r in steps), reverse=True):
        over += n
        scale = float(np.exp(-step / 1000))
        if over > slack * total:
            break
    return fitted.select(*DIMENSIONS, "weight", F.least(F.lit(1.0), F.col("weight") * scale).alias("probability")), few


def drawn(doc_id: Column, probability: Column, seed: int) -> Column:
    """Is a document sampled?  By a hash of its id."""
    return F.pmod(F.xxhash64(doc_id.cast("long"), F.lit(seed)), F.lit(1 << 52)).cast("double") / float(1 << 52) < probability


def mix(docs: DataFrame, topic: Column | None = None, seed: int = SEED, count: Callable[[DataFrame, Sequence[str]], DataFrame] = pieces, **how) -> DataFrame:
    """Each document's cell, tokens, weight, probability and whether it is sampled."""
    rows = measured(docs, topic, count)
    table, few = weights(rows, **how)
    out = rows.join(F.broadcast(table) if few else table, list(DIMENSIONS))
    return out.select("doc_id", *DIMENSIONS, "n_tokens", "weight", "probability", drawn(F.col("doc_id"), F.col("probability"), seed).alias("sampled"))


def sample(docs: DataFrame, topic: Column | None = None, seed: int = SEED, count: Callable[[DataFrame, Sequence[str]], DataFrame] = pieces, **how) -> DataFrame:
    """The sampled documents; all columns stay.  `count` gives the tokens that the shares are of: those of whatever will read the sample."""
    table, few = weights(measured(docs, topic, count), **how)
    names = {d: C.fresh(docs, f"_{d}") for d in (*DIMENSIONS, "probability")}
    own = table.select(*(F.col(d).alias(n) for d, n in names.items()))
    same = [c == own[names[d]] for d, c in cell(docs, topic).items()]
    return docs.join(F.broadcast(own) if few else own, same[0] & same[1] & same[2]).filter(drawn(docs["doc_id"], own[names["probability"]], seed)).select(*(docs[c] for c in docs.columns))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(C.load(spark, sf_dir, "documents"))
