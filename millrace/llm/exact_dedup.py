"""Exact dedup with a heavy-hitter split, in DataFrame operations only.

Texts are known by their SHA-256.  Misra-Gries counters (Spark's frequent-item
aggregate, K counters a task, merged) give at most K candidates, among them
every digest of more than one row in K; a count over all rows verifies them.
The verified winners, at most K rows, are broadcast and settle the rows of
frequent digests where they lie; all other rows are dealt by digest.

Defined cases: a null text is an empty one.  Of equal texts the row with the
largest doc_id stays, rows without a doc_id come last, and of rows that repeat
a doc_id and text exactly one stays.  A text of any length
is compared by its SHA-256 digest.  An empty table gives an empty result.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm import common as C

#: Counters, and so the most rows that are broadcast.
COUNTERS = 1000


def heavy(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The digests of more than one row in `counters`: digest, keep (its largest doc_id and row), group_size."""
    candidates = digests.stat.freqItems(["digest"], 1 / counters).select(F.explode("digest_freqItems").alias("digest"))
    total = digests.count()
    found = digests.join(F.broadcast(candidates), "digest", "left_semi").groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size"))
    return found.filter(F.col("group_size") > F.greatest(F.lit(total / counters), F.lit(1)))


def digests_of(docs: DataFrame) -> DataFrame:
    """doc_id, digest and a number of each row; written, as it is read several times."""
    return C.cut(C.text_frame(docs).select("doc_id", F.sha2("text", 256).alias("digest"), F.monotonically_increasing_id().alias("row")))


def settled(rows: DataFrame, winners: DataFrame) -> DataFrame:
    """rows with keep (the doc_id and row that stay) and group_size; winners: those of frequent digests, to be broadcast."""
    common = rows.join(winners, "digest")
    own = W.partitionBy("digest")
    rare = rows.join(winners, "digest", "left_anti").withColumn("keep", F.max(F.struct("doc_id", "row")).over(own)).withColumn("group_size", F.count("*").over(own))
    return common.select(*rare.columns).unionByName(rare)


def decide(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Each row's decision: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = digests_of(docs)
    both = settled(rows, F.broadcast(C.cut(heavy(rows, counters))))
    return both.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """docs without the rows that decide() drops; all columns stay.

    The texts of frequent digests are settled where they lie, against the
    broadcast winners.  Of the others, those that go (and only those) are
    looked up: broadcast if they are few, else by a shuffle.
    """
    rows = digests_of(docs)
    winners = C.cut(heavy(rows, counters))
    digest, keep, id_, key, n = (C.fresh(docs, x) for x in ("_digest", "_keep", "_id", "_key", "_rows"))
    pairs = C.cut(settled(rows, F.broadcast(winners)).groupBy("doc_id", "digest").agg(F.max(F.col("row") == F.col("keep.row")).alias("stays"), F.count("*").alias("n")).filter(~F.col("stays") | (F.col("n") > 1)))
    named = lambda df: df.select(F.col("doc_id").alias(id_), F.col("digest").alias(key))
    held = lambda df: F.broadcast(df) if C.few(df, 160) else df
    out = docs.withColumn(digest, F.sha2(F.coalesce("text", F.lit("")), 256))
    out = out.join(F.broadcast(winners.select(F.col("digest").alias(key), F.struct("keep.doc_id").alias(keep))), F.col(digest) == F.col(key), "left").drop(key)
    out = out.filter(F.col(keep).isNull() | F.col("doc_id").eqNullSafe(F.col(f"{keep}.doc_id")))
    same = lambda df: out["doc_id"].eqNullSafe(df[id_]) & (out[digest] == df[key])
    gone = held(named(pairs.filter(~F.col("stays")).join(F.broadcast(winners), "digest", "left_anti")))
    out = out.join(gone, same(gone), "left_anti")
    again = named(pairs.filter("stays"))
    if not again.isEmpty():  # rows that repeat doc_id and text: one stays
        again = held(again)
        out = out.join(again, same(again), "left_anti").unionByName(out.join(again, same(again), "left_semi").dropDuplicates(["doc_id", digest]))
    return out.select(*docs.columns)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(C.load(spark, sf_dir, "documents"))


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER own AS keep_id, count(*) OVER own AS group_size, doc_id = max(doc_id) OVER own AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW own AS (PARTITION BY coalesce(text, ''))
"""
