"""Document fingerprints: one-permutation MinHash.

Each shingle is hashed once.  The top bits of the hash name one of K bins, the
least hash of a bin is its value, an empty bin takes the value of the first
non-empty bin in a fixed pseudo-random sequence of its own (optimal
densification), and only the low B bits of each value are kept, packed.  A value
is spread with its bin's number first, so that a value that fills many bins of a
short text does not agree with another by chance in all of them.  Two
fingerprints that agree in a share p of their bins have an estimated Jaccard
likeness of (p - 2**-B) / (1 - 2**-B), cut to 0..1.

A fingerprint is lower-case hexadecimal; a text without words has the empty
string.  Two empty fingerprints have likeness 1, an empty and another one 0.

Defined cases: a null text is an empty one.  Rows that repeat a doc_id follow
each other in the order of a hash of their texts; rows without a doc_id come
first.  A very long text is hashed whole, on its own.  An empty table gives an
empty result.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common as C

BINS = 512
BITS = 4


def _candidates(attempt: int, bins: np.ndarray, total: int) -> np.ndarray:
    step = np.full(1, attempt + 1, C.U64) * C.U64(0x9E3779B97F4A7C15)
    return (C.mix(bins.astype(C.U64) * C.U64(1_000_003) + step) % C.U64(total)).astype(np.int64)


def signatures(data: np.ndarray, offsets: np.ndarray, bins: int = BINS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The kept bits of each document's bins, one byte each, and which documents have any shingle."""
    hashes, at = C.shingles(data, offsets)
    n = len(offsets) - 1
    counts = np.diff(at)
    shift = C.U64(64 - bins.bit_length() + 1)
    values = np.zeros((n, bins), C.U64)
    full = np.zeros((n, bins), bool)
    for d in range(n):
        hashes[at[d] : at[d + 1]].sort()
    if len(hashes):
        cell = np.repeat(np.arange(n), counts) * bins + (hashes >> shift).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        values.reshape(-1)[cell[first]] = hashes[first]
        full.reshape(-1)[cell[first]] = True
    some = counts > 0
    row, col = np.nonzero(~full & some[:, None])
    attempt = 0
    while len(row):
        source = _candidates(attempt, col, bins)
        found = full[row, source]
        values[row[found], col[found]] = values[row[found], source[found]]
        row, col = row[~found], col[~found]
        attempt += 1
    values += C.mix(np.arange(bins, dtype=C.U64))
    return (C.mix(values) & C.U64((1 << bits) - 1)).astype(np.uint8) * some[:, None], some


def pack(values: np.ndarray, some: np.ndarray, bits: int = BITS) -> list[str]:
    raw = np.packbits(np.unpackbits(values[:, :, None], axis=2)[:, :, 8 - bits :].reshape(len(values), -1), axis=1)
    return [raw[i].tobytes().hex() if some[i] else "" for i in range(len(values))]


def likeness(a: np.ndarray, some_a: np.ndarray, b: np.ndarray, some_b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Bias-corrected likeness of each row of a to the row of b."""
    chance = 2.0**-bits
    out = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)
    return np.where(some_a & some_b, out, (some_a == some_b).astype(float))


def fingerprint(docs: DataFrame, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """doc_id and fingerprint of every document; a map over the rows, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.buffer_of(batch.column(1))
            for a, b in C.blocks(offsets):
                values, some = signatures(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], bins, bits)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(pack(values, some, bits), pa.string())], ["doc_id", "fingerprint"])

    kind = dict(docs.dtypes)["doc_id"]
    return C.text_frame(docs).mapInArrow(run, f"doc_id {kind}, fingerprint string")


def in_order(docs: DataFrame, parts: int) -> DataFrame:
    """docs dealt by doc_id into ascending ranges, each sorted and followed by a copy of the next range's first row.

    The ranges' ends are quantiles of doc_id, at most `parts` numbers; an id (or
    none) that more rows share than two ranges should hold has ranges of its own,
    by a hash of the text.  Columns: doc_id, text, bucket, guest.
    """
    spark, rows = docs.sparkSession, docs.withColumn("h", F.xxhash64("text"))
    ids = docs.select("doc_id")
    total = ids.count()
    # at most parts / 2 rows
    hot = {r["doc_id"]: -(-r["n"] * parts // total) for r in ids.groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") * parts > 2 * total).collect()}
    found = {min(int(x), (1 << 63) - 1) for x in (ids.stat.approxQuantile(["doc_id"], [i / parts for i in range(1, parts)], 0.25 / parts)[0] if parts > 1 else [])}
    if None in hot:
        least = ids.agg(F.min("doc_id")).first()[0]
        found |= {max(least - 1, -(1 << 63))} if least is not None else set()
    found |= {e for i in hot if i is not None for e in (max(i - 1, -(1 << 63)), i)}
    ends = np.array(sorted(found), np.int64)
    split = np.ones(len(ends) + 1, np.int64)
    for i, k in hot.items():
        split[0 if i is None else np.searchsorted(ends, i, "left")] = k
    base = (np.cumsum(split) - split).tolist()
    placed = C.in_ranges(rows, "doc_id", ends, "range")
    if hot:
        table = F.broadcast(spark.createDataFrame([(i, b, k) for i, (b, k) in enumerate(zip(base, split.tolist(), strict=True))], "range int, base int, split int"))
        within = F.least(F.floor((F.col("h") / float(1 << 64) + 0.5) * F.col("split")), F.col("split") - 1)
        placed = placed.join(table, "range").withColumn("home", (F.col("base") + within).cast("int")).drop("base", "split")
    else:
        placed = placed.withColumn("home", F.col("range"))
    placed = placed.drop("range")
    # one row for each range: bounded by the number of ranges
    heads = sorted(placed.groupBy("home").agg(F.min(F.struct("doc_id", "h")).alias("head")).collect())
    before = [(h["head"]["doc_id"], h["head"]["h"], heads[i - 1]["home"]) for i, h in enumerate(heads)]
    also = F.broadcast(spark.createDataFrame(before, "head long, head_h long, also int"))
    rows = placed.join(also, F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("h") == F.col("head_h")), "left").drop("head", "head_h")
    rows = rows.withColumn("bucket", F.explode(F.when(F.col("also").isNull(), F.array("home")).otherwise(F.array("home", F.col("also") + F.lit(1 << 30)))))
    rows = rows.withColumn("guest", (F.col("bucket") >= 1 << 30).cast("int")).withColumn("bucket", F.col("bucket") % F.lit(1 << 30))
    buckets = max(int(split.sum()), 1)
    return rows.select("doc_id", "text", "bucket", "guest", "h").repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "guest", "doc_id", "h", "text").drop("h")


def compare_edited(docs: DataFrame, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Fingerprint each document and its edited text, whose last floor(n / 2) code points are the next document's first.

    The next document is the next doc_id; the last document's is the first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows whose next row is not known yet
        bucket = None
        met: tuple | None = None  # the range's own first guest ends the range

        def measured(rows: list[tuple], after: tuple) -> pa.RecordBatch:
            texts = [r[1] for r in rows] + [after[1]]
            whole = signatures(*C.buffer_of(pa.array(texts, pa.large_string())), bins, bits)
            edited_texts = [t[: len(t) - len(t) // 2] + texts[i + 1][: len(t) // 2] for i, t in enumerate(texts[:-1])]
            edited = signatures(*C.buffer_of(pa.array(edited_texts, pa.large_string())), bins, bits)
            own = whole[0][:-1], whole[1][:-1]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([len(t) for t in texts[:-1]], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited_texts]),
                    pa.array(pack(*own, bits), pa.string()),
                    pa.array(pack(*edited, bits), pa.string()),
                    pa.array(likeness(*own, *edited, bits)),
                    pa.array(likeness(*own, whole[0][1:], whole[1][1:], bits)),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        size = 0
        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if row[2] != bucket:
                    bucket, met = row[2], None
                if met is not None:
                    continue
                if row[3]:  # the guest: what follows the range's last row
                    met = row
                    if held:
                        yield measured(held, row)
                    held, size = [], 0
                    continue
                if size >= C.CHUNK_BYTES or len(held) >= C.CHUNK_ROWS:
                    yield measured(held, row)
                    held, size = [], 0
                held.append(row)
                size += len(row[1])

    rows = in_order(C.text_frame(docs).withColumn("doc_id", F.col("doc_id").cast("bigint")), C.partitions(docs.sparkSession))
    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(C.load(spark, sf_dir, "documents"))
