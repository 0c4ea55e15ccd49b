"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common as C

#: Links that one task joins at a time before any are dealt.
AT_ONCE = 1 << 20


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task as stars, so that long chains are short before the first round."""

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        a, b = table.column(0).to_numpy(), table.column(1).to_numpy()
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        a, b = at[: len(a)], at[len(a) :]
        label = np.arange(len(nodes))
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, label[a], low)
            np.minimum.at(new, label[b], low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        other = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(nodes[label[other]])], ["u", "v"])

    waiting, size = [], 0
    for batch in batches:
        waiting.append(batch)
        size += batch.num_rows
        if size >= AT_ONCE:
            yield joined(waiting)
            waiting, size = [], 0
    if size:
        yield joined(waiting)


def components(links: DataFrame) -> DataFrame:
    """node and label (its component's least node) of every node that has a link; links: two long columns.

    Tasks of at most AT_ONCE links join what they hold; if that was one task all
    is done.  Else rounds follow: each is two aggregates and two joins on a node;
    a node of very many links is split by the join and never one task's list.
    """
    a, b = links.columns
    edges = C.cut(links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v"))
    tasks = -(-edges.count() // AT_ONCE)
    edges = edges.coalesce(max(1, tasks)).mapInArrow(_stars, "u long, v long")
    edges = C.cut(edges if tasks <= 1 else edges.distinct())
    before = None
    while tasks > 1:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            break
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = C.cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
