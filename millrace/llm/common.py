"""Helpers that the training-data operators share.

Word shingles: A-Z are lower-cased, words are runs of bytes other than white
space (0x20, 0x09-0x0D), a document's shingles are its runs of five words; a
document of one to four words has one shingle, its whole sequence; one without
words has none.  A shingle is known by a 64-bit hash.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words in a shingle.
WORDS = 5
#: Bytes of text, and rows, that numpy works on at once.
CHUNK_BYTES = 1 << 20
CHUNK_ROWS = 1 << 10
#: Bytes of a table that may be broadcast.
BROADCAST_BYTES = 32 << 20

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's checkpoint folder, or in local mode a new one where it is unset."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="millrace-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read from there, so that nothing before it runs twice or hangs on an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values: the finaliser of splitmix64."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_SHINGLE = mix(np.arange(11, 11 + WORDS, dtype=U64) * U64(_BASE)) | U64(1)
#: The bytes of a 64-bit number that a rest of 0 to 8 bytes fills.
REST = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def eights(part: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of part on, as numbers; zeros follow its end."""
    held = np.zeros(len(part) + 8, np.uint8)
    held[: len(part)] = part
    return np.ndarray((len(part) + 1,), "<u8", held, strides=(1,))


def _keyed(x: np.ndarray, number: np.ndarray | int) -> np.ndarray:
    """Eight bytes spread, keyed by their number within the span, and spread again."""
    key = mix(np.atleast_1d(np.asarray(number, U64)) + U64(0x5851F42D4C957F2D)) * U64(_BASE)
    return mix(mix(x) + key)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span, A-Z lower-cased first if `fold`.

    A span is cut into eights of bytes; each is spread with the key of its
    number and the results are added.  No eight is a linear term of the sum, so
    regular texts (repetitions, complements) do not collide.
    """
    if not len(starts):
        return np.zeros(0, U64)
    low, high = int(starts.min()), int(ends.max())
    words = eights(LOWER[data[low:high]] if fold else data[low:high])
    a, length = starts - low, ends - starts
    sums = _keyed(words[a] & REST[np.minimum(length, 8)], 0)
    more = np.flatnonzero(length > 8)
    if len(more):
        extra = (length[more] - 1) // 8
        at = np.cumsum(extra) - extra
        number = np.arange(int(extra.sum())) - np.repeat(at, extra) + 1
        place = np.repeat(a[more], extra) + 8 * number
        left = np.minimum(np.repeat(ends[more] - low, extra) - place, 8)
        sums[more] += np.add.reduceat(_keyed(words[place] & REST[left], number), at)
    return mix(sums + length.astype(U64) * U64(_BASE))


class Lookup:
    """The places of known codes among the sorted ones, from 1; 0 for others.

    A table of marked slots, small enough for a cache, turns most other codes away before the search.
    """

    def __init__(self, codes: np.ndarray):
        self.codes = np.unique(codes)
        self.marked = np.zeros(1 << max(16, int(len(self.codes) * 32).bit_length()), bool)
        self.marked[self._slot(self.codes)] = True

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        x = codes.astype(U64) * U64(0x9E3779B97F4A7C15)
        return ((x ^ x >> U64(31)) & U64(len(self.marked) - 1)).astype(np.int64)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes), np.int64)
        near = np.flatnonzero(self.marked[self._slot(codes)])
        if len(near):
            found = np.searchsorted(self.codes, codes[near])
            found[found == len(self.codes)] = 0
            out[near] = np.where(self.codes[found] == codes[near], found + 1, 0)
        return out


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and where each begins (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if n and column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int = CHUNK_BYTES, rows: int = CHUNK_ROWS) -> Iterator[tuple[int, int]]:
    """Runs of rows of about so many bytes, and so many rows at most; a longer text is a run of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), first + rows, n)
        yield first, last
        first = last


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word in data; words end where a document does."""
    inside = ~IS_SPACE[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z folded), and where each document's words begin; works through long texts in pieces."""
    begins, ends = words_of(data, offsets)
    out = np.empty(len(begins), U64)
    first = 0
    while first < len(begins):
        last = max(first + 1, int(np.searchsorted(ends, begins[first] + CHUNK_BYTES, "right")))
        out[first:last] = hash_spans(data, begins[first:last], ends[first:last], fold=True)
        first = last
    return out, np.searchsorted(begins, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, repeated ones too, and where each document's begin."""
    words, at = word_hashes(data, offsets)
    counts = np.diff(at)
    made = np.where(counts >= WORDS, counts - WORDS + 1, np.minimum(counts, 1))
    out_at = np.concatenate([[0], np.cumsum(made)])
    out = np.empty(out_at[-1], U64)
    if len(words) >= WORDS:
        runs = sum((words[k : len(words) - WORDS + 1 + k] * _SHINGLE[k] for k in range(1, WORDS)), words[: len(words) - WORDS + 1] * _SHINGLE[0])
        keep = np.ones(len(runs), bool)
        for k in range(1, WORDS):  # runs that begin in the last words of a document
            tail = at[1:] - k
            keep[tail[(tail >= 0) & (tail < len(keep))]] = False
    else:
        runs, keep = np.zeros(0, U64), np.zeros(0, bool)
    long = np.repeat(counts >= WORDS, made)
    out[long] = mix(runs[keep])
    for d in np.flatnonzero((counts > 0) & (counts < WORDS)):
        part = words[at[d] : at[d + 1]]
        out[out_at[d]] = mix(np.array([(part * _SHINGLE[: len(part)]).sum(dtype=U64) ^ U64(len(part))], U64))[0]
    return out, out_at


def fold_words(text: str | None) -> list[str]:
    """The plain form of the same words, for tests."""
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingle_set(text: str | None) -> set[tuple[str, ...]]:
    """The plain form of a document's shingle set, for tests."""
    words = fold_words(text)
    return {tuple(words[i : i + WORDS]) for i in range(max(len(words) - WORDS + 1, min(len(words), 1)))}


def text_frame(docs: DataFrame, *keep: str) -> DataFrame:
    """Only doc_id, text and the named columns, null texts as empty ones: extra columns cannot clash."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *keep)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A whole table; the session's rows go to Python in batches small enough for long texts, unless it asks for smaller ones."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "0")) <= CHUNK_ROWS:
        spark.conf.set(name, CHUNK_ROWS)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def few(df: DataFrame, bytes_a_row: int, most: int = BROADCAST_BYTES) -> bool:
    """Is a table small enough to broadcast?  It is counted; bytes_a_row is what a row takes in memory at most."""
    return df.count() * bytes_a_row <= most


def foremost(df: DataFrame, count: str, key: str, n: int) -> DataFrame:
    """The rows of the largest counts (positive longs), at most n: those of the upper steps of a sixteenth of a doubling, and of the step that does not fit a share by a hash of the key.

    No row is sorted and no task meets more than it holds: the driver sees the sizes of at most a thousand steps.
    """
    step = F.floor(F.log2(F.col(count).cast("double")) * 16)
    sizes = sorted(((r["step"], r["n"]) for r in df.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    left = n
    for at, size in sizes:
        if size > left:
            share = F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(0.99 * left / size * (1 << 30))
            return df.filter((step > at) | (step == at) & share).limit(n)
        left -= size
    return df


def in_ranges(df: DataFrame, column: str, ends: np.ndarray, name: str) -> DataFrame:
    """df and an int column `name`: how many of the ascending ends lie below the long in `column` (0 for null).

    The ends travel once to each executor; only `column` goes to Python.
    """
    if not len(ends):
        return df.withColumn(name, F.lit(0))
    held = df.sparkSession.sparkContext.broadcast(np.asarray(ends, np.int64))

    @F.pandas_udf("int")
    def below(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in ids:
            yield pd.Series(np.searchsorted(held.value, x.to_numpy(np.int64), "left").astype(np.int32))

    least = -(1 << 63)  # below every end, and no null reaches pandas, which would turn longs into doubles
    return df.withColumn(name, below(F.coalesce(F.col(column).cast("long"), F.lit(least))))
