"""Alignment of batch trajectories by dynamic time warping.

Batches are gathered once, a row each with an array for each tag.  A task warps
many of them against the reference at once, and gives sums by position; their
average is the next reference.  Only the reference (its length times the tags)
is on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from millrace.operators.latent import PCA
from millrace.operators.scaling import Scaler, apply_ranges, ranges_of_arrays
from millrace.sources.tables import dealt, written

#: Cells of the batches that are warped at once.
CELLS = 1 << 22
#: Bytes of moves that are held for the way back.
MOVES = 1 << 26


def distances(test: np.ndarray, reference: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted squared distances of all rows, then the least cumulative distance to each pair.

    Cells of one anti-diagonal depend on earlier ones only, so each is one vector step.
    """
    local = (((test[:, None, :] - reference[None, :, :]) ** 2) * weights).sum(axis=2)
    n, m = local.shape
    total = np.full((n + 1, m + 1), np.inf)
    total[0, 0] = 0
    for s in range(2, n + m + 1):
        i = np.arange(max(1, s - m), min(n, s - 1) + 1)
        j = s - i
        total[i, j] = local[i - 1, j - 1] + np.minimum(np.minimum(total[i - 1, j - 1], total[i - 1, j]), total[i, j - 1])
    return total[1:, 1:]


def path(total: np.ndarray) -> np.ndarray:
    """The pairs of rows from the last to the first; on ties the diagonal."""
    i, j = total.shape[0] - 1, total.shape[1] - 1
    out = [(i, j)]
    while i or j:
        if i == 0:
            j -= 1
        elif j == 0:
            i -= 1
        else:
            best = min(total[i - 1, j - 1], total[i - 1, j], total[i, j - 1])
            if total[i - 1, j - 1] == best:
                i, j = i - 1, j - 1
            elif total[i - 1, j] == best:
                i -= 1
            else:
                j -= 1
        out.append((i, j))
    return np.array(out[::-1])


def warped(test: np.ndarray, reference: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float]:
    """The test rows averaged onto the reference's rows, and the distance a step."""
    total = distances(test, reference, weights)
    steps = path(total)
    out = np.zeros_like(reference)
    np.add.at(out, steps[:, 1], test[steps[:, 0]])
    return out / np.bincount(steps[:, 1], minlength=len(reference))[:, None], float(total[-1, -1] / len(steps))


def warped_all(test: np.ndarray, lengths: np.ndarray, reference: np.ndarray, weights: np.ndarray, most: int = MOVES) -> tuple[np.ndarray, np.ndarray]:
    """`warped` of many batches at once, as tags x rows x batches; batch b has lengths[b] rows, what follows them does not count.

    Two anti-diagonals of all batches are held, and the moves of as many as
    `most` bytes hold: earlier moves are made again on the way back, from the
    two diagonals before them.
    """
    tags, rows, batches = test.shape
    m, end = len(reference), rows + len(reference) + 1
    width = min(rows, m)
    span = min(max(1, most // (width * batches)), end - 2)
    moves = np.empty((span, width, batches), np.uint8)
    total = np.empty(batches)

    def sweep(older: np.ndarray, old: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        for s in range(first, min(first + span, end)):
            low, high = max(1, s - m), min(rows, s - 1)
            before, here = slice(low - 1, high), slice(low, high + 1)
            local = np.zeros((high - low + 1, batches))
            for t in range(tags):
                gap = test[t, before] - reference[s - high - 1 : s - low, t][::-1, None]
                gap *= gap
                gap *= weights[t]
                local += gap
            least = np.minimum(older[before], old[before])
            np.minimum(least, old[here], out=least)
            # 0: both rows step back, 1: that of the test, 2: that of the reference; on ties the first of these
            aside = older[before] != least
            moves[s - first, : high - low + 1] = aside.view(np.uint8) + (aside & (old[before] != least))
            local += least
            older[here], older[0] = local, np.inf
            older, old = old, older
            if s > m:
                ended = lengths == s - m
                total[ended] = old[s - m, ended]
        return older, old

    def reach(first: int) -> slice:
        """What the diagonals from the first on ask of the two before them; the rest is infinite or done with."""
        return slice(max(0, first - m - 1), min(rows, first) + 1)

    state = np.full((2, rows + 1, batches), np.inf)
    state[0, 0] = 0
    firsts, states = range(2, end, span), []
    for first in firsts:
        if first != firsts[-1]:
            states.append(state[:, reach(first)].copy())
        state = np.stack(sweep(*state, first))
    out, count = np.zeros((tags, m, batches)), np.zeros((m, batches))
    i, j = lengths.astype(np.int64), np.full(batches, m)
    for first in reversed(firsts):
        if first != firsts[-1]:
            state = np.full((2, rows + 1, batches), np.inf)
            state[:, reach(first)] = states.pop()
            sweep(*state, first)
        who = np.flatnonzero(i + j >= first)
        while len(who):
            p, q = i[who], j[who]
            out[:, q - 1, who] += test[:, p - 1, who]
            count[q - 1, who] += 1
            move = moves[p + q - first, p - np.maximum(1, p + q - m), who]
            p -= move != 2
            q -= move != 1
            i[who], j[who] = p, q
            who = who[p + q >= first]
    return out / count, total / count.sum(axis=0)


def gathered(df: DataFrame, batch: str, order: str, tags: Sequence[str]) -> DataFrame:
    """One row a batch: its id, and an array of each tag's values in order.  Rows without one of the tags are left out."""
    rows = dealt(df.select(batch, order, *tags).dropna(), [batch])
    whole = F.struct(F.col(order).alias("order"), *(F.col(t).cast("double").alias(f"c{i}") for i, t in enumerate(tags)))
    packed = rows.groupBy(batch).agg(F.sort_array(F.collect_list(whole)).alias("_rows"))
    return packed.select(batch, *(F.col(f"_rows.c{i}").alias(t) for i, t in enumerate(tags)))


def flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of gathered rows: the length of each batch, where it starts, and the values, tags x rows of all batches."""
    lengths = b.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return lengths, np.cumsum(lengths) - lengths, np.stack([c.flatten().to_numpy(zero_copy_only=False) for c in b.columns[1:]])


def aligned(b: pa.RecordBatch, scales: np.ndarray, reference: np.ndarray, weights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Gathered rows by their places, those of like length together: the scaled batches on the reference's positions, tags x positions x batches, and their distances."""
    lengths, starts, values = flat(b)
    values = (values - scales[:, 1:]) / scales[:, :1]
    left = np.argsort(-lengths, kind="stable")
    while len(left):
        n, m = int(lengths[left[0]]), len(reference)
        size = max(1, CELLS // ((n + m) * min(n, m)))
        who, left = left[:size], left[size:]
        test = values[:, starts[who] + np.minimum(np.arange(n)[:, None], lengths[who] - 1)]
        yield who, *warped_all(test, lengths[who], reference, weights)


def turned(packed: DataFrame, tags: Sequence[str], scales: np.ndarray, reference: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The average of the batches on the reference's positions, and each tag's sum of squares about it; scales: range and minimum of each tag."""
    k, center = len(tags), reference.T[:, :, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros((2 * k, len(reference)))
        for b in batches:
            for who, rows, _ in aligned(b, scales, reference, weights):
                rows -= center
                n += len(who)
                sums[:k] += rows.sum(axis=2)
                sums[k:] += (rows * rows).sum(axis=2)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(reference))), pa.array(np.full(len(reference), n)), *map(pa.array, sums)], names)

    names = ["position", "n", *(f"s{i}" for i in range(2 * k))]
    schema = ", ".join(["position long", "n long", *(f"{c} double" for c in names[2:])])
    found = packed.mapInArrow(run, schema).groupBy("position").agg(*(F.sum(c).alias(c) for c in names[1:])).orderBy("position").toPandas().to_numpy(float)
    n, sums, squares = found[:, 1:2], found[:, 2 : k + 2], found[:, k + 2 :]
    return reference + sums / n, np.maximum(squares - sums**2 / n, 0).sum(axis=0)


def find_average_length(df: DataFrame, batch: str) -> object:
    """The batch whose length is the median of all, the least id on ties (the next longer length where no batch has it)."""
    return of_average_length(df.groupBy(batch).agg(F.count("*").alias("n")), batch)[batch]


def of_average_length(lengths: DataFrame, batch: str) -> Row:
    """Of rows of a batch and its length n, that of the median length."""
    middle = lengths.agg(F.percentile("n", F.lit(0.5)).alias("m"))
    return lengths.crossJoin(F.broadcast(middle)).orderBy(F.abs(F.col("n") - F.col("m")), F.desc("n"), batch).first()


def cubic(y: np.ndarray, length: int) -> np.ndarray:
    """Rows of y at `length` equal steps, by the cubic spline whose third derivative does not jump at the second and last but one row; fewer than four rows by their polynomial."""
    n = len(y)
    at = np.linspace(0, n - 1, length)
    if n < 4:
        return np.vander(at, n) @ np.linalg.solve(np.vander(np.arange(n), n), y)
    bend = np.zeros_like(y)  # second derivatives
    rest = 6 * (y[:-2] - 2 * y[1:-1] + y[2:])
    bend[1], bend[-2] = rest[0] / 6, rest[-1] / 6
    k = n - 4
    if k:
        right = rest[1:-1].copy()
        right[0] -= bend[1]
        right[-1] -= bend[-2]
        pivot = np.full(k, 4.0)
        for i in range(1, k):
            pivot[i] -= 1 / pivot[i - 1]
            right[i] -= right[i - 1] / pivot[i - 1]
        for i in range(k - 1, -1, -1):
            right[i] = (right[i] - (right[i + 1] if i + 1 < k else 0)) / pivot[i]
        bend[2:-2] = right
    bend[0], bend[-1] = 2 * bend[1] - bend[2], 2 * bend[-2] - bend[-3]
    i = np.minimum(at.astype(int), n - 2)
    b = (at - i)[:, None]
    a = 1 - b
    return a * y[i] + b * y[i + 1] + ((a**3 - a) * bend[i] + (b**3 - b) * bend[i + 1]) / 6


def unfolded(packed: DataFrame, batch: str, tags: Sequence[str], length: int) -> tuple[DataFrame, list[str]]:
    """One row a batch of gathered ones: each tag at `length` equal steps; and the names of those columns."""
    names = [f"{t}_{k}" for t in tags for k in range(length)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, starts, values = flat(b)
            for n in np.unique(lengths):
                left = np.flatnonzero(lengths == n)
                while len(left):
                    size = max(1, CELLS // (len(tags) * max(int(n), length)))
                    who, left = left[:size], left[size:]
                    y = values[:, starts[who] + np.arange(n)[:, None]].transpose(1, 0, 2)
                    y = cubic(y.reshape(n, -1), length).reshape(length, len(tags), -1).transpose(1, 0, 2).reshape(len(names), -1)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who)), *map(pa.array, y)], [batch, *names])

    return packed.select(batch, *tags).mapInArrow(run, StructType([packed.schema[batch], *(StructField(c, DoubleType()) for c in names)])), names


def find_reference_batch(df: DataFrame, batch: str, order: str, tags: Sequence[str], components: int = 4) -> object:
    """The batch nearest the centre of a model of whole trajectories.

    All batches are brought to the length of the average one and unfolded; those
    beyond the 90% limit of T2 are left out of a second model; of the rest the
    one of least T2 whose squared prediction error is below its 50% limit (or
    the least higher one, up to 95%, that a batch meets).
    """
    return most_central(written(gathered(df, batch, order, tags)), batch, tags, components)


def most_central(packed: DataFrame, batch: str, tags: Sequence[str], components: int) -> object:
    """`find_reference_batch` of gathered batches."""
    own = of_average_length(packed.select(batch, F.size(tags[0]).alias("n")), batch)
    wide, names = unfolded(packed, batch, tags, own["n"])
    wide = written(wide)
    n = wide.count()
    if n == 1:
        return own[batch]
    components = min(components, n - 1)

    def model(x: DataFrame) -> tuple[PCA, DataFrame]:
        scaled = Scaler.fit(x, names).transform(x)
        fit = PCA.fit(scaled, names, components)
        return fit, fit.diagnose(scaled)

    first, out = model(wide)
    second, out = model(wide.join(out.filter(F.col("hotellings_t2") < first.t2_limit(0.9)).select(batch), batch, "left_semi"))
    for level in np.arange(0.5, 0.951, 0.05):
        best = out.filter(F.col("spe") < second.spe_limit(float(level))).orderBy("hotellings_t2", "spe", batch).first()
        if best is not None:
            return best[batch]
    raise ValueError("no batch is within the 95% limit of the squared prediction error")


def batch_dtw(df: DataFrame, batch: str, order: str, tags: Sequence[str], reference: object | None = None, most: int = 25, tolerance: float = 0.1, robust: bool = True, points: int = 100) -> tuple[DataFrame, np.ndarray]:
    """Align all batches and bring them to `points` equal steps: batch, position, tags in their own units, distance; and the weights of tags.

    Tags are scaled by the median of the batches' ranges and least values.  Each
    turn weighs a tag by the inverse of its squared spread about the average,
    until the weights settle (the norm of their change is at most the tolerance)
    or most + 1 turns are done; after the third, the average takes the
    reference's place.  The aligned batches are then brought back to their units
    and interpolated by cubic splines.  Rows without one of the tags are left out.
    """
    if most < 3:
        raise ValueError("three turns at least are asked for")
    packed = written(gathered(df, batch, order, tags))
    own = most_central(packed, batch, tags, 4) if reference is None else reference
    row = packed.filter(F.col(batch) == F.lit(own)).first()
    if row is None:
        raise ValueError(f"no batch {own!r}")
    ranges = ranges_of_arrays(packed, tags, robust)
    known = {r["tag"]: r for r in ranges.collect()}
    ranges = df.sparkSession.createDataFrame([*known.values()], ranges.schema)
    scales = np.array([[known[t]["range"], known[t]["minimum"]] for t in tags])
    average = (np.array([row[t] for t in tags]).T - scales[:, 1]) / scales[:, 0]
    against, weights, moved, turn = average, np.ones(len(tags)), math.inf, 0
    while moved > tolerance and turn <= most:
        turn += 1
        against, used = average if turn > 3 else against, weights
        average, spread = turned(packed, tags, scales, against, used)
        weights = 1 / np.maximum(spread, max(math.sqrt(np.finfo(float).eps), 1e-6 * spread.max()))
        weights = weights / weights.sum() * len(tags)
        moved = float(np.linalg.norm(weights - used))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for who, rows, distance in aligned(b, scales, against, used):
                y = cubic(rows.transpose(1, 0, 2).reshape(len(against), -1), points).reshape(points, len(tags), -1)
                position = pa.array(np.tile(np.arange(points, dtype=np.int32), len(who)))
                values = (pa.array(y[:, t].T.ravel()) for t in range(len(tags)))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(who, points))), position, *values, pa.array(np.repeat(distance, points))], names)

    names = [batch, "position", *tags, "distance"]
    schema = StructType([packed.schema[batch], StructField("position", IntegerType()), *(StructField(c, DoubleType()) for c in names[2:])])
    return apply_ranges(packed.mapInArrow(run, schema), ranges, tags, back=True), weights


def resample(df: DataFrame, batch: str, order: str, tags: Sequence[str], length: int) -> DataFrame:
    """Each batch at `length` equal steps of its own positions, by linear interpolation in windows: no Python."""
    w = W.partitionBy(batch).orderBy(order)
    rows = df.select(batch, order, *tags).dropna().withColumn("_k", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(W.partitionBy(batch)))
    rows = rows.withColumns({f"_next_{t}": F.lead(t).over(w) for t in tags}).withColumn("_step", (F.col("_n") - 1) / F.lit(length - 1))
    # the new positions that fall between this row and the next
    low = F.when(F.col("_step") > 0, F.ceil(F.col("_k") / F.col("_step") - 1e-9)).otherwise(F.lit(0))
    high = F.when(F.col("_step") > 0, F.ceil((F.col("_k") + 1) / F.col("_step") - 1e-9) - 1).otherwise(F.lit(length - 1))
    high = F.least(F.when(F.col("_k") == F.col("_n") - 1, F.lit(length - 1)).otherwise(high), F.lit(length - 1))
    rows = rows.withColumn("_low", low.cast("int")).withColumn("_high", high.cast("int")).filter("_low <= _high")
    rows = rows.withColumn("position", F.explode(F.sequence("_low", "_high")))
    share = F.col("position") * F.col("_step") - F.col("_k")
    return rows.select(batch, "position", *((F.col(t) + F.when(F.col(f"_next_{t}").isNull(), 0.0).otherwise(share * (F.col(f"_next_{t}") - F.col(t)))).alias(t) for t in tags))
