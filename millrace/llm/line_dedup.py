"""Line dedup: lines that many documents repeat go, but for one document's.

Lines are exploded with their positions, normalised (white space stripped at
both ends, A-Z lower-cased) and hashed to 128 bits.  For each hash of a long
enough line the distinct documents are counted, first by hash and document and
then by hash, so that a line of a third of all documents is summed in every
task before it moves.  Lines over the threshold are dropped except in the
largest doc_id that holds them, and each text is put together again from the
positions that stay.

Defined cases: a null or empty text is one empty line, which stays.  Rows that
repeat a doc_id count as one document and all keep its lines; rows without a
doc_id never count as documents and lose every repeated line.  A very long
text is so many lines more; a very long line is known by its hash.  An empty
table gives an empty result.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common as C

LEAST_LENGTH = 20
LEAST_DOCUMENTS = 3
#: Lines that are broadcast when all repeated ones would be too many.
COMMON = 10_000
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def dropped_lines(docs: DataFrame, least_length: int, least_documents: int) -> DataFrame:
    """For each text that loses lines: doc_id, its hash and the positions that go."""
    rows = C.text_frame(docs).select("doc_id", F.xxhash64("text").alias("copy"), F.posexplode(F.split("text", "\n", -1)).alias("position", "line"))
    key = F.translate(F.btrim("line", F.lit(SPACE)), UPPER, LOWER)
    lines = rows.withColumn("key", key).filter(F.length("key") >= least_length).select("doc_id", "copy", "position", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
    lines = C.cut(lines)  # counted and then joined: the texts are split once
    counted = lines.select("h1", "h2", "doc_id").groupBy("h1", "h2").agg(F.countDistinct("doc_id").alias("documents"), F.max("doc_id").alias("keep"))
    counted = C.cut(counted.filter(F.col("documents") >= least_documents))
    if C.few(counted, 96):
        met = lines.join(F.broadcast(counted), ["h1", "h2"])
    else:  # the lines of more than one document in COMMON lines, COMMON at most, are broadcast; the rest are dealt
        common = F.col("documents") * COMMON > lines.count()
        often = F.broadcast(counted.filter(common))
        met = lines.join(often, ["h1", "h2"]).unionByName(lines.join(often, ["h1", "h2"], "left_anti").join(counted.filter(~common), ["h1", "h2"]))
    gone = met.filter(~F.col("doc_id").eqNullSafe(F.col("keep")))
    return gone.groupBy("doc_id", "copy").agg(F.collect_set("position").alias("gone"))


def drop_lines(docs: DataFrame, least_length: int = LEAST_LENGTH, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text that stays."""

    @F.pandas_udf("string")
    def without(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, gone in parts:
            out = []
            for text, positions in zip(texts, gone, strict=True):
                if positions is not None and len(positions):
                    away = set(positions.tolist())
                    text = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in away)
                out.append(text)
            yield pd.Series(out, dtype=object)

    gone = dropped_lines(docs, least_length, least_documents).select(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy"), "gone")
    rows = C.text_frame(docs).withColumn("copy", F.xxhash64("text"))
    rows = rows.join(gone, rows["doc_id"].eqNullSafe(gone["_id"]) & (rows["copy"] == gone["_copy"]), "left")
    n_lines = F.length("text") - F.length(F.translate("text", "\n", "")) + 1
    return rows.select("doc_id", n_lines.cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"), without("text", "gone").alias("text"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_lines(C.load(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH split AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), line AS (
    SELECT doc_id, unnest(range(1, len(lines) + 1)) AS position, unnest(lines) AS line FROM split
), keyed AS (
    SELECT *, translate(trim(line, concat(chr(32), chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line
), common AS (
    SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
    SELECT k.doc_id, k.position, k.line, c.key IS NOT NULL AND k.doc_id <> c.keep AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY position) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
