"""Embedding whitening by matrix-free block subspace iteration.

The covariance is never formed from rows: each pass of Spark computes
X^T (X Q) over the centred rows for a thin block Q, batch by batch in tasks,
and adds the tasks' d x p products by entry.  The driver orthogonalises them
(QR), solves the p x p Rayleigh-Ritz problem and goes on until the residuals of
all k components are small against the largest eigenvalue.  Sums and row
counts are exact integers.  A last pass over the whitened rows gives their
covariance.

Defined cases: rows whose vector is null or holds null or non-finite entries go.
Scaled entries beyond +-2**40 are held there.  Shorter vectors are filled up
with zeros before scaling.  Rows that repeat an id are rows each, a null id
stays null.  Components without variance (an eigenvalue of less than 1e-9 of the
trace) are not returned; so an empty table, or one of equal rows, gives no
rows.  A deviation beyond the range of a long is null.  Other columns are not
read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common as C
from millrace.llm.hard_negatives import matrix, usable

#: Columns of the block for each component that is asked for, and passes at most.
WIDER, PASSES = 2, 500
#: A residual of so much of the largest eigenvalue certifies a component.
TOLERANCE = 1e-11
#: Largest absolute value of a scaled entry.
BOUND = 1 << 40
#: An eigenvalue of less than this share of the trace is none.
NOTHING = 1e-9


class Centre:
    """The exact mean of n vectors of longs, from their sums."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums, self.d = n, sums, len(sums)
        # whole part and remainder of the mean: x less the whole part is exact
        self.whole = np.array([s // n for s in sums] if n else [0] * self.d, np.int64)
        self.rest = np.array([s % n for s in sums] if n else [0] * self.d, np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / max(self.n, 1)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sum over dimensions of (n * x - sum)**2, None beyond a long."""
        most = (int(np.abs(x - self.whole).max(initial=0)) + 1) * self.n
        if most * most * max(1, self.d) < 1 << 63:
            return ((self.n * (x - self.whole) - self.rest) ** 2).sum(1).tolist()
        exact = [sum((self.n * int(v) - int(r)) ** 2 for v, r in zip(row, self.rest, strict=True)) for row in x - self.whole]
        return [v if v < 1 << 63 else None for v in exact]


class Rows:
    """The fit list: vec_id and x, an array of longs, with the exact count and sums."""

    def __init__(self, embeddings: DataFrame, factor: int = 64, shift: int = 1_000_000):
        kept = embeddings.filter(usable("embedding")).select(F.coalesce(F.col("vec_id").cast("long"), F.lit(0)).alias("vec_id"), F.col("vec_id").isNull().alias("no_id"), "embedding")
        self.d = d = kept.agg(F.max(F.size("embedding"))).first()[0] or 0
        filled = F.concat("embedding", F.array_repeat(F.lit(0.0).cast(kept.schema["embedding"].dataType.elementType), F.lit(d) - F.size("embedding")))
        bound = float(BOUND)
        x = F.transform(filled, lambda c: F.floor(F.least(F.greatest(c.cast("double") * factor, F.lit(-bound)), F.lit(bound))).cast("long") + F.lit(shift))
        self.df = kept.select("vec_id", "no_id", x.alias("x"))

        def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n, total = 0, np.zeros(d, np.int64)
            for f in frames:
                n, total = n + len(f), total + matrix(f["x"].tolist(), d).sum(0)
            yield pd.DataFrame({"i": np.arange(d), "n": n, "s": total})

        # d rows; sums of sums may pass a long
        found = self.df.mapInPandas(sums, "i int, n long, s long").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
        self.n = int(found[0]["n"]) if found else 0
        self.centre = Centre(self.n, [int(r["s"]) for r in sorted(found)])

    def added(self, make, shape: tuple[int, int]) -> np.ndarray:
        """The sum over all batches of make(centred rows), an array of the given shape; added in tasks, then by entry."""
        d, centred = self.d, self.centre.centred

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(shape)
            for f in frames:
                total += make(centred(matrix(f["x"].tolist(), d)))
            yield pd.DataFrame({"at": np.arange(total.size), "v": total.ravel()})

        entries = self.df.select("x").mapInPandas(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
        out = np.zeros(shape[0] * shape[1])
        out[entries["at"].to_numpy()] = entries["v"].to_numpy()
        return out.reshape(shape)


def components(rows: Rows, k: int, wider: int = WIDER, tolerance: float = TOLERANCE, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, float, list[float]]:
    """Eigenvalues (falling), eigenvectors as columns, the trace, and the largest residual of each pass.

    Raises ArithmeticError if the residuals don't certify all k components in so many passes.
    """
    d, n = rows.d, max(rows.n, 1)
    p, k = min(d, max(1, wider * k)), min(d, k)
    if not d or not rows.n:
        return np.zeros(0), np.zeros((d, 0)), 0.0, []
    q = np.linalg.qr(np.random.default_rng(11).standard_normal((d, p)))[0]
    trace, seen = None, []
    for _ in range(passes):
        block = q
        # the trace comes with the first pass, as a column more
        make = (lambda y, q=block: y.T @ (y @ q)) if trace is not None else (lambda y, q=block: np.hstack([y.T @ (y @ q), (y * y).sum(0)[:, None]]))
        w = rows.added(make, (d, p + (trace is None))) / n
        if trace is None:
            trace, w = float(w[:, -1].sum()), w[:, :-1]
        h = q.T @ w
        value, turn = np.linalg.eigh((h + h.T) / 2)
        value, turn = value[::-1], turn[:, ::-1]
        vectors = q @ turn
        residual = np.sqrt(((w @ turn - vectors * value) ** 2).sum(0))[:k]
        seen.append(float(residual.max()))
        if seen[-1] <= tolerance * max(value[0], 0.0) or not trace:
            return np.maximum(value[:k], 0), vectors[:, :k], trace, seen
        q = np.linalg.qr(w @ turn)[0]
    raise ArithmeticError(f"{passes} passes leave a residual of {seen[-1]:.3g} against an eigenvalue of {value[0]:.6g}")


def whiten(embeddings: DataFrame, k: int = 32, factor: int = 64, shift: int = 1_000_000, wider: int = WIDER, tolerance: float = TOLERANCE) -> DataFrame:
    """One row for each row and component: its whitened coordinate, with the component's share of the variance."""
    rows = Rows(embeddings, factor, shift)
    value, vectors, trace, _ = components(rows, k, wider, tolerance)
    there = value > NOTHING * trace
    value, vectors = value[there], vectors[:, there]
    m, n, d = len(value), rows.n, rows.d
    project = vectors / np.sqrt(value) if m else vectors
    centred, deviation = rows.centre.centred, rows.centre.deviation

    def moments(y: np.ndarray) -> np.ndarray:
        z = y @ project
        return np.vstack([z.T @ z, z.sum(0)])

    error = 0.0
    if m:
        both = rows.added(moments, (m + 1, m)) / n
        error = float(np.abs(both[:-1] - np.outer(both[-1], both[-1]) - np.eye(m)).max())
    explained = value / trace if m else value

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = matrix(f["x"].tolist(), d)
            repeat = lambda v: pd.Series(v, dtype="Int64").repeat(m).reset_index(drop=True)
            ids = f["vec_id"].astype("Int64").mask(f["no_id"].to_numpy())
            yield pd.DataFrame({"vec_id": repeat(ids), "component": np.tile(np.arange(1, m + 1, dtype=np.int32), len(f)), "n": n, "deviation": repeat(deviation(x)), "whitened": (centred(x) @ project).ravel(), "explained": np.tile(explained, len(f)), "identity_error": error})

    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    found = rows.df if m else rows.df.limit(0)
    return found.mapInPandas(run, schema)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(C.load(spark, sf_dir, "embeddings"))
