"""Labelled samples, folds, and scores as a column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import common as C

#: Labelled rows of each class that a fit takes at most, with their whole texts.
SAMPLE = 1300


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, size: int = SAMPLE) -> tuple[list[str], np.ndarray, float]:
    """Whole texts and labels of at most `size` usable labelled rows of each class, and the share of label 1 among all usable rows.

    Rows are chosen by a hash of their ids, whatever the length of their texts,
    so the same tables give the same sample whatever their partitions; labels
    and texts that are null are left out.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & usable).groupBy("doc_id").agg(F.max("label").alias("label"))
    known = C.cut(known)
    share = known.agg(F.avg("label")).first()[0]
    # of each class, the rows of the least hashes: a top-k, so that no class is gathered; the texts are scanned once
    order = F.xxhash64("doc_id", F.lit(17))
    least = lambda value: known.filter(F.col("label") == value).orderBy(order, "doc_id").limit(size)
    chosen = F.broadcast(least(0).unionByName(least(1)))
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = sorted((r["label"], r["key"], r["text"]) for r in texts.withColumn("key", order).collect())
    return [t for _, _, t in rows], np.array([y for y, _, _ in rows], np.float32), 0.5 if share is None else float(share)


def with_scores(docs: DataFrame, scorer: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]], name: str, rows: int = C.CHUNK_ROWS) -> DataFrame:
    """docs and a double column `name` of scores of their texts; a map over the rows, without a shuffle.

    scorer() is called once a task and gives a function from (bytes, offsets) to scores.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer()
        for batch in batches:
            data, offsets = C.buffer_of(batch.column(at))
            parts = [score(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in C.blocks(offsets, rows=rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())], [*batch.schema.names, name])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


class Falling:
    """Does the loss still fall?  Told an epoch's loss, says whether another one is due: at least `least`, at most `most`, and as long as one lowers the best so far by a share."""

    def __init__(self, least: int, most: int, share: float = 0.03):
        self.least, self.most, self.share, self.done, self.best = least, most, share, 0, float("inf")

    def __call__(self, loss: float) -> bool:
        self.done += 1
        falls = loss < self.best * (1 - self.share)
        self.best = min(self.best, loss)
        return self.done < self.least or falls and self.done < self.most


def log_loss(logits: np.ndarray, labels: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, np.where(labels == 1, -logits, logits))


class Adam:
    """Steps of Adam on a dict of arrays."""

    def __init__(self, parameters: dict[str, np.ndarray], rate: float = 0.01):
        self.p, self.rate, self.t = parameters, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in parameters.items()}
        self.v = {k: np.zeros_like(v) for k, v in parameters.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            self.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
