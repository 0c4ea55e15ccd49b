"""Best-fit packing of token pieces into sequences: minimum bin slack.

Documents are tokenised once into pieces of at most `capacity` tokens.  Only
the number of pieces of each length matters to the packing, so the plan is made
from that histogram, whose size is the capacity whatever the input: for each
sequence the longest waiting piece is placed, a bitset subset-sum over the
other available lengths finds the fullest feasible combination with it, and
that combination is removed, as often as the counts allow.  Pieces of a length
are then numbered (in as many salted parts as its share of all pieces asks for,
so that a common length is not one task's work) and take the places that the
plan has for their length.

Defined cases: a null text is an empty one, whose only token is the end id.
Rows that repeat a doc_id are packed each.  A very long text is as many pieces
as it takes.  An empty table gives an empty
result.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from millrace.llm import common as C
from millrace.llm.tokens import tokenizer_path

CAPACITY = 1024
END_ID = 2
#: Parts that pieces are numbered in, for each shuffle partition.
PARTS = 4
#: Text that the tokenizers library takes for one special token.
SPECIAL = {"<|endoftext|>": 50256}


class Encoder:
    """Ids as the tokenizers library gives them for the byte-level vocabulary, from its ranks (several times faster)."""

    def __init__(self, name: str = "byte_bpe_50k"):
        import public_tokenizers
        import tiktoken

        self.name = name
        with open(tokenizer_path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
        self.slow = None

    def encode(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except BaseException as error:  # its regular expressions give up on some very long runs with a panic, which is no Exception
            if not isinstance(error, (ValueError, RuntimeError)) and type(error).__name__ != "PanicException":
                raise
        if self.slow is None:
            import tokenizers

            self.slow = tokenizers.Tokenizer.from_file(tokenizer_path(f"{self.name}.json"))
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece; a map over the rows, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encoder.encode(text.as_py() or ""), end_id).astype("<u4")
                start, end = 0, len(ids) % capacity or capacity
                for piece in range(-(-len(ids) // capacity)):
                    out.append((doc_id, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                    start, end = end, end + capacity
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return C.text_frame(docs).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lengths(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, the kept columns and n_tokens of every document, its end id included; a map over the rows, without a shuffle."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder()
        for batch in batches:
            counts = [len(encoder.encode(t.as_py())) + 1 for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(counts, pa.int64())], [*batch.schema.names[1:], "n_tokens"])

    return texts.mapInArrow(run, StructType([*texts.schema.fields[1:], StructField("n_tokens", LongType())]))


def fullest(space: int, available: list[tuple[int, int]]) -> dict[int, int]:
    """Lengths and how often, whose sum is the largest of at most space; available: (length, count), longest first."""
    mask, reach, steps = (1 << (space + 1)) - 1, 1, []
    for length, count in available:
        if length > space or not count:
            continue
        steps.append((length, count, reach))
        left, step = min(count, space // length), 1
        while left:  # multiples by doubling
            step = min(step, left)
            reach |= (reach << (step * length)) & mask
            left -= step
            step *= 2
        if reach >> space & 1:
            break
    total, out = reach.bit_length() - 1, {}
    for length, count, before in reversed(steps):
        k = next(k for k in range(min(count, total // length) + 1) if before >> (total - k * length) & 1)
        if k:
            out[length] = k
            total -= k * length
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Combinations of lengths, and how many sequences have each."""
    left = {k: v for k, v in sorted(histogram.items(), reverse=True) if v}
    out = []
    while left:
        seed = next(iter(left))
        found = {seed: 1}
        for length, k in fullest(capacity - seed, [(n, c - (n == seed)) for n, c in left.items()]).items():
            found[length] = found.get(length, 0) + k
        times = min(left[n] // k for n, k in found.items())
        for n, k in found.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        out.append((found, times))
    return out


def places(planned: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the first number of each run of its pieces, the run's first sequence and its place there."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for found, times in planned:
        offset = 0
        for length, k in found.items():
            for _ in range(k):
                runs.setdefault(length, []).append((used.get(length, 0), base, offset))
                used[length] = used.get(length, 0) + times
                offset += length
        base += times
    return {n: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for n, r in runs.items()}


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Each piece with its sequence and place."""
    spark = docs.sparkSession
    cut = C.cut(pieces(docs, capacity, end_id))
    # at most `capacity` rows
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = places(plan(histogram, capacity))
    parts, total = PARTS * C.partitions(spark), max(sum(histogram.values()), 1)
    salts = spark.createDataFrame([(n, -(-k * parts // total)) for n, k in histogram.items()], "length long, salts long")
    dealt = cut.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts"))).drop("salts")
    # at most `parts` + `capacity` rows
    sizes = sorted((r["length"], r["salt"], r["n"]) for r in dealt.groupBy("length", "salt").agg(F.count("*").alias("n")).collect())
    before, first = [], {}
    for length, salt, n in sizes:
        before.append((length, salt, first.get(length, 0)))
        first[length] = first.get(length, 0) + n
    before = F.broadcast(spark.createDataFrame(before, "length long, salt long, first long"))
    numbered = dealt.withColumn("rank", F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    numbered = numbered.join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("first"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            length, rank = f["length"].to_numpy(), f["rank"].to_numpy()
            sequence, offset = np.zeros(len(f), np.int64), np.zeros(len(f), np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                first, base, at = where[int(n)]
                k = np.searchsorted(first, rank[own], "right") - 1
                sequence[own], offset[own] = base[k] + rank[own] - first[k], at[k]
            yield f[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=sequence, offset=offset)

    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(C.load(spark, sf_dir, "documents"))
