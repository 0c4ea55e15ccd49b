"""N-gram Jaccard join: an exact join of shingle sets, and its connected groups.

Texts of equal shingle sets are one class.  Two classes can only link if each
has a shared shingle among the first n - ceil(t n) + 1 of its set in one common
order, so classes meet by those shingles.  The order puts shingles that many
documents share last (counters of all texts find them, at most HOT are known to
the tasks; the order, not the result, depends on them).  Shingles are dealt in
packed arrays, not rows.

Classes that meet are sorted by set size.  A run of at most SMALL compatible
sizes gives its pairs, a longer one its neighbours.  A pair's bitmaps (bit
parities of the hashed shingles, at least twice as many bits as the set has
members) bound the intersection from above; a pair that passes is settled by
intersecting the two sorted arrays.  Each class first has its best candidate
checked; pairs that are in one component by then need no check, as they would
join nothing.  The classes of long runs that are still in several components are
compared in tiles of size bands, once for each cluster of such runs rather than
for each shingle: first a tile gives each class's likeliest partner, then, of
what those links leave in several components, every pair that may link.

Defined cases: a null text is an empty one; texts without words have no
shingles and link with nothing.  Rows that repeat a doc_id are judged each; a
component's id is its least doc_id, null only if none has one.  A very
long text is shingled whole, on its own.  An empty table gives an empty result.
Other columns are not read, whatever their names.

Sets are compared as 64-bit hashes of shingles, classes as 64-bit hashes of sets
together with their sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common as C
from millrace.llm.components import components

PERCENT = 75
#: Shared shingles that the order knows of, and classes that share one at least.
HOT = 1_000_000
SHARED = 4
#: The longest run that gives all its pairs, and rows of a block of a tile.
SMALL = 8
BLOCK = 1024
#: Rows of a dealt array, and bytes of entries that a task holds at once.
PACKED = 500_000
BUCKET_BYTES = 24 << 20
#: Members of a product of incidences, and what a tile is known by.
WIDE = 4096
TILE = ("cluster", "band_a", "block_a", "band_b", "block_b")

ENTRY = np.dtype([("token", "<u8"), ("cls", "<i8"), ("n", "<u4")])


def sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted set of each text, one after another, and where each begins."""
    hashes, at = C.shingles(data, offsets)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[at[:-1][np.diff(at) > 0]] = True
    return hashes[new], np.concatenate([[0], np.cumsum(new)])[at]


def classes_of(members: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    sums = np.concatenate([np.zeros(1, C.U64), np.cumsum(C.mix(members ^ C.U64(0xA5A5A5A5A5A5A5A5)), dtype=C.U64)])
    return C.mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(C.U64)).view(np.int64)


def bitmap(members: np.ndarray) -> bytes:
    """Parities of the members by their low bits; a power of two of bits, at least twice the members."""
    bits = max(64, 2 << int(len(members) - 1).bit_length())
    return np.packbits((np.bincount((members & C.U64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def apart(a: bytes, b: bytes) -> int:
    """Members that two sets do not share, at least."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def may_link(n_a: int, n_b: int, differ: int, percent: int) -> bool:
    """Can an intersection of at most (n_a + n_b - differ) / 2 be enough?"""
    return (100 + percent) * ((n_a + n_b - differ) // 2) >= percent * (n_a + n_b)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a key by which a text is found again."""
    return C.text_frame(docs).select(F.col("doc_id").cast("long"), "text", F.xxhash64("doc_id", "text").alias("key"))


def describe(docs: DataFrame) -> DataFrame:
    """One row a text: doc_id, key, n, cls, bitmap (both null without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.buffer_of(batch.column(1))
            for a, b in C.blocks(offsets):
                members, at = sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                n, cls = np.diff(at), classes_of(members, at)
                maps = [bitmap(members[x:y]) if y > x else None for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(n, pa.int64()), pa.array(cls, mask=n == 0), pa.array(maps, pa.binary())], ["doc_id", "key", "n", "cls", "bitmap"])

    return keyed(docs).mapInArrow(run, "doc_id long, key long, n long, cls long, bitmap binary")


def code_of(members: np.ndarray, parts: int) -> np.ndarray:
    """Short codes of shingles: as many bits as fit 32 within each of the parts they are dealt to."""
    return C.mix(members) >> C.U64(64 - 32 - int(parts).bit_length() + 1)


def buckets(spark: SparkSession, entries: float, size: int) -> int:
    """To how many parts some entries are dealt, so that a part's size does not grow with their number."""
    return max(C.partitions(spark), -(-int(entries * size) // BUCKET_BYTES))


class Fresh:
    """Which sets have not been met before in this task (forgotten when there are too many)."""

    def __init__(self) -> None:
        self.seen: set[int] = set()

    def __call__(self, cls: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = n > 0
        for k, x in enumerate(cls.tolist()):
            out[k] &= x not in self.seen
            self.seen.add(x)
        if len(self.seen) > 1 << 20:
            self.seen = set()
        return out


def shared_shingles(docs: DataFrame, percent: int, total: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Codes of the most shared shingles of low hash, by how many classes of tasks each is shared, and the number of parts that the codes are made for.

    Counted over all texts; total: the sum of the sizes of their sets.
    """
    # the first members in order are the lowest hashes, a share 1 - t of a set; some more, as shared ones make room
    share = min(1.0, 1.4 * (1 - percent / 100))
    parts = buckets(docs.sparkSession, total * share, 4)
    limit = C.U64(min(int((1 << 64) * share), (1 << 64) - 1))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size, fresh = [], 0, Fresh()

        def dealt(codes: np.ndarray) -> pa.RecordBatch:
            bucket = (codes % C.U64(parts)).astype(np.int32)
            by = np.argsort(bucket, kind="stable")
            kinds, begin = np.unique(bucket[by], return_index=True)
            raw = (codes[by] // C.U64(parts)).astype("<u4")
            return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array([raw[x:y].tobytes() for x, y in zip(begin, [*begin[1:], len(raw)], strict=True)], pa.binary())], ["bucket", "codes"])

        for batch in batches:
            data, offsets = C.buffer_of(batch.column(0))
            for a, b in C.blocks(offsets):
                members, at = sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                n = np.diff(at)
                waiting.append(code_of(members[np.repeat(fresh(classes_of(members, at), n), n) & (members < limit)], parts))
                size += len(waiting[-1])
                if size >= 2 * PACKED:
                    yield dealt(np.concatenate(waiting))
                    waiting, size = [], 0
        if size:
            yield dealt(np.concatenate(waiting))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for bucket, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                of.setdefault(bucket, []).append(np.frombuffer(x.as_py(), "<u4"))
        for bucket, x in of.items():
            kinds, counts = np.unique(np.concatenate(x), return_counts=True)
            keep = counts >= SHARED
            yield pa.RecordBatch.from_arrays([pa.array(kinds[keep].astype(np.int64) * parts + bucket), pa.array(counts[keep])], ["code", "count"])

    dealt = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(deal, "bucket int, codes binary").repartitionById(parts, "bucket")
    # at most HOT rows
    top = C.foremost(C.cut(dealt.mapInArrow(run, "code long, count long")), "count", "code", HOT).toPandas()
    return top["code"].to_numpy(np.int64).astype(C.U64), top["count"].to_numpy(np.int64), parts


def heads(members: np.ndarray, at: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    """Which members are among the first of their set: by rank (0: not known to be shared, then the less shared first), then by hash."""
    n = np.diff(at)
    need = n + 1 - -(-percent * n // 100)
    out = np.zeros(len(members), bool)
    hot = np.add.reduceat(rank > 0, at[:-1][n > 0]) > 0 if (n > 0).any() else np.zeros(0, bool)
    for (a, b, k), mixed in zip(np.stack([at[:-1], at[1:], need], 1)[n > 0].tolist(), hot.tolist(), strict=True):
        if mixed:
            out[a + np.argsort(rank[a:b], kind="stable")[:k]] = True
        else:
            out[a : a + k] = True
    return out


def runs(entries: np.ndarray, percent: int, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of classes that meet (the smaller set first), and the entries of longer runs; entries are sorted by token, size and class."""
    m = len(entries)
    gap = np.ones(m, bool)
    gap[1:] = (entries["token"][1:] != entries["token"][:-1]) | (100 * entries["n"][:-1].astype(np.int64) < percent * entries["n"][1:].astype(np.int64))
    begins = np.flatnonzero(gap)
    length = np.diff(np.append(begins, m))
    own = np.repeat(length, length)
    stop = np.repeat(begins + length, length)
    left, right = [], []
    for k in range(1, SMALL):
        i = np.flatnonzero((np.arange(m) + k < stop) & ((own <= SMALL) | (k == 1)))
        i = i[100 * entries["n"][i].astype(np.int64) >= percent * entries["n"][i + k].astype(np.int64)]
        left.append(entries["cls"][i])
        right.append(entries["cls"][i + k])
    return np.concatenate(left), np.concatenate(right), entries[(own > SMALL) if whole else np.zeros(m, bool)]


def meet(docs: DataFrame, percent: int, total: int) -> DataFrame:
    """Pairs (a, b) of classes that meet by a shingle, and the entries (token, cls, n) of long runs; from all texts.

    A shingle that more classes share than a dealt array holds is dealt in parts
    by class; its entries are all kept for the tiles.  total: the sum of the sizes of all sets.
    """
    hot, shared, coded = shared_shingles(docs, percent, total)
    parts = buckets(docs.sparkSession, total * (1 - percent / 100), ENTRY.itemsize)
    known = C.Lookup(hot)
    order = np.argsort(hot)
    level, split = np.zeros(len(hot) + 1, np.int32), np.ones(len(hot) + 1, np.int32)
    level[1:] = 1 + np.argsort(np.argsort(shared, kind="stable"), kind="stable")[order]
    split[1:] = -(-shared[order] // PACKED)
    divided = bool((split > 1).any())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size, fresh = [], 0, Fresh()

        def dealt(entries: np.ndarray) -> pa.RecordBatch:
            salt = entries["cls"].view(C.U64) % split[known(code_of(entries["token"], coded))].astype(C.U64) * C.U64(0x9E3779B97F4A7C15) if divided else C.U64(0)
            bucket = (C.mix(entries["token"] + salt) % C.U64(parts)).astype(np.int32)
            by = np.argsort(bucket, kind="stable")
            kinds, begin = np.unique(bucket[by], return_index=True)
            raw = entries[by]
            return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array([raw[x:y].tobytes() for x, y in zip(begin, [*begin[1:], len(raw)], strict=True)], pa.binary())], ["bucket", "entries"])

        for batch in batches:
            data, offsets = C.buffer_of(batch.column(0))
            for a, b in C.blocks(offsets):
                members, at = sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                n, cls = np.diff(at), classes_of(members, at)
                taken = heads(members, at, level[known(code_of(members, coded))], percent) & np.repeat(fresh(cls, n), n)
                entries = np.empty(taken.sum(), ENTRY)
                entries["token"], entries["cls"], entries["n"] = members[taken], np.repeat(cls, n)[taken], np.repeat(n, n)[taken]
                waiting.append(entries)
                size += len(entries)
                if size >= PACKED:
                    yield dealt(np.concatenate(waiting))
                    waiting, size = [], 0
        if size:
            yield dealt(np.concatenate(waiting))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = [np.frombuffer(x.as_py(), ENTRY) for batch in batches for x in batch.column(1)]
        if not entries:
            return
        entries = np.concatenate(entries)
        entries = entries[np.lexsort((entries["cls"], entries["n"], entries["token"]))]
        new = np.ones(len(entries), bool)
        new[1:] = entries[1:] != entries[:-1]
        entries = entries[new]
        left, right, long = runs(entries, percent, True)
        if divided:
            long = np.unique(np.concatenate([long, entries[split[known(code_of(entries["token"], coded))] > 1]]))
        pairs = np.unique(np.stack([left, right], 1), axis=0)
        none = lambda k, kind=pa.int64(): pa.nulls(k, kind)
        names = ["a", "b", "token", "cls", "n"]
        for k in range(0, len(pairs), 1 << 16):
            p = pairs[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy()), none(len(p)), none(len(p)), none(len(p))], names)
        for k in range(0, len(long), 1 << 16):
            e = long[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([none(len(e)), none(len(e)), pa.array(e["token"].astype(np.uint64).view(np.int64)), pa.array(e["cls"].copy()), pa.array(e["n"].astype(np.int64))], names)

    dealt = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(deal, "bucket int, entries binary").repartitionById(parts, "bucket")
    return dealt.mapInArrow(run, "a long, b long, token long, cls long, n long")


def passing(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose bitmaps let them link: and how many members they differ by at least."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            differ = np.array([apart(x, y) for x, y in zip(f["map_a"], f["map_b"], strict=True)], np.int64)
            fit = np.array([may_link(x, y, d, percent) for x, y, d in zip(f["n_a"], f["n_b"], differ, strict=True)], bool)
            yield f[["a", "b", "key_a", "key_b"]].assign(differ=differ)[fit]

    side = lambda x: known.select(F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("bitmap").alias(f"map_{x}"), F.col("key").alias(f"key_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(run, "a long, b long, key_a long, key_b long, differ long")


def linked(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) that link: the sorted arrays of their representatives are intersected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                (x, x_at), (y, y_at) = (sets(*C.buffer_of(part.column(c))) for c in (2, 3))
                for i in range(part.num_rows):
                    p, q = x[x_at[i] : x_at[i + 1]], y[y_at[i] : y_at[i + 1]]
                    same = len(np.intersect1d(p, q, assume_unique=True))
                    keep.append(len(p) > 0 and len(q) > 0 and 100 * same >= percent * (len(p) + len(q) - same))
            yield pa.RecordBatch.from_arrays(batch.select([0, 1]).columns, ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = C.cut(pairs.select("a", "b", "key_a", "key_b"))
    texts = keyed(docs).select("key", "text")
    # the pairs' keys are broadcast while they are few, so only texts that pairs need are dealt; else all are
    few = C.few(pairs, 64)
    held = F.broadcast(pairs) if few else pairs
    wanted = pairs.select(F.col("key_b").alias("key")).distinct()
    left = texts.join(held.withColumnRenamed("key_a", "key"), "key").select("a", "b", "key_b", F.col("text").alias("text_a"))
    right = texts.join(F.broadcast(wanted) if few else wanted, "key", "left_semi").select(F.col("key").alias("key_b"), F.col("text").alias("text_b"))
    return left.join(right, "key_b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def folded(maps: list[bytes], width: int) -> np.ndarray:
    """Bitmaps of at least `width` bytes, folded to it, as rows of 64-bit words."""
    out = np.empty((len(maps), width // 8), C.U64)
    for i, m in enumerate(maps):
        x = np.frombuffer(m, C.U64)
        while len(x) > width // 8:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out[i] = x
    return out


def survivors(a: pd.DataFrame, b: pd.DataFrame, percent: int) -> list[tuple]:
    """Pairs of a row of a and a row of b whose labels differ and whose sizes and bitmaps let them link; a may be b."""
    n_a, n_b = a["n"].to_numpy(), b["n"].to_numpy()
    fit = (a["label"].to_numpy()[:, None] != b["label"].to_numpy()[None, :]) & (100 * np.minimum(n_a[:, None], n_b[None, :]) >= percent * np.maximum(n_a[:, None], n_b[None, :]))
    if a is b:
        fit &= np.arange(len(a))[:, None] < np.arange(len(b))[None, :]
    width_a, width_b = a["bitmap"].map(len).to_numpy(), b["bitmap"].map(len).to_numpy()
    cls_a, key_a, cls_b, key_b = (x[c].to_numpy() for x in (a, b) for c in ("cls", "key"))
    found = []
    for w_a in np.unique(width_a):
        for w_b in np.unique(width_b):
            i, j = np.flatnonzero(width_a == w_a), np.flatnonzero(width_b == w_b)
            if not fit[np.ix_(i, j)].any():
                continue
            width = min(w_a, w_b)
            x, y = folded(a["bitmap"].iloc[i].tolist(), width), folded(b["bitmap"].iloc[j].tolist(), width)
            for k, row in zip(i, x, strict=True):
                to = np.flatnonzero(fit[k, j])
                if len(to):
                    total = n_a[k] + n_b[j[to]]
                    differ = np.bitwise_count(row ^ y[to]).sum(axis=1, dtype=np.int64)
                    good = np.flatnonzero((100 + percent) * ((total - differ) // 2) >= percent * total)
                    at = j[to[good]]
                    found += zip([cls_a[k]] * len(at), cls_b[at].tolist(), [key_a[k]] * len(at), key_b[at].tolist(), differ[good].tolist(), strict=True)
    return found


def placed(entries: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Classes of runs (entries: token, cls, label) in all tiles they belong to.

    Runs that share a class are one cluster.  Its classes lie in bands of sizes
    that differ by less than the least ratio of linked sets, a band in blocks of
    about BLOCK; a tile has two blocks of a band or of neighbouring bands.
    """
    # tokens are nodes beside the classes, so a common token is nobody's list; should a token and a class be the same number, two clusters are one
    cluster = C.cut(components(entries.select("token", "cls"))).select(F.col("node").alias("cls"), F.col("label").alias("cluster"))
    rows = entries.select("cls", "label").distinct().join(cluster, "cls").join(known.select("cls", "n", "bitmap", "key"), "cls")
    band = F.floor(F.log(F.col("n")) / float(np.log(100 / percent)) + 1e-9).cast("int")
    rows = C.cut(rows.withColumn("band", band))
    counts = rows.groupBy("cluster", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    counts = C.cut(counts)
    near = lambda step, name: counts.select("cluster", (F.col("band") + step).alias("band"), F.col("blocks").alias(name))
    spread = rows.join(near(0, "own"), ["cluster", "band"]).join(near(1, "lower"), ["cluster", "band"], "left").join(near(-1, "upper"), ["cluster", "band"], "left")
    spread = spread.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("own").cast("long")).cast("int"))
    count = lambda x: F.when(F.coalesce(F.col(x), F.lit(0)) > 0, F.sequence(F.lit(0), F.col(x) - 1)).otherwise(F.array().cast("array<int>"))
    at = lambda upper, i, lower, j: F.struct(upper.alias("band_a"), i.alias("block_a"), lower.alias("band_b"), j.alias("block_b"))
    own, mine = F.col("band"), F.col("block")
    where = F.concat(
        F.transform(count("own"), lambda j: at(own, F.greatest(mine, j), own, F.least(mine, j))),
        F.transform(count("lower"), lambda j: at(own, mine, own - 1, j)),
        F.transform(count("upper"), lambda j: at(own + 1, j, own, mine)),
    )
    return spread.withColumn("tile", F.explode(where)).select("cluster", "tile.*", "band", "block", "cls", "key", "label", "n", "bitmap")


def tiles(entries: DataFrame, known: DataFrame, percent: int, likeliest: bool) -> DataFrame:
    """Pairs (a, b) of classes of the same runs whose labels differ and whose bitmaps let them link; or only each class's likeliest of a tile."""

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        _, band_a, block_a, band_b, block_b = key
        f = f.sort_values("cls", ignore_index=True)
        first = (f["band"] == band_a) & (f["block"] == block_a)
        a, b = (f, f) if (band_a, block_a) == (band_b, block_b) else (f[first], f[~first])
        found = pd.DataFrame(survivors(a, b, percent), columns=["a", "b", "key_a", "key_b", "differ"], dtype=np.int64)
        if likeliest:
            found = found.sort_values(["differ", "a", "b"])
            found = pd.concat([found.drop_duplicates("a"), found.drop_duplicates("b")]).drop_duplicates()
        return found

    return placed(entries, known, percent).groupBy(*TILE).applyInPandas(run, "a long, b long, key_a long, key_b long, differ long")


def common(rows: np.ndarray, members: np.ndarray, count: int) -> np.ndarray:
    """How many members any two of `count` sets share: products of their incidence, some members at a time."""
    kinds, at, times = np.unique(members, return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    keep = times[at] > 1
    rows, at = rows[keep], shared[at[keep]]
    order = np.argsort(at, kind="stable")
    rows, at = rows[order], at[order]
    out = np.zeros((count, count), np.float32)
    for k in range(0, int(at[-1]) + 1 if len(at) else 0, WIDE):
        i, j = np.searchsorted(at, [k, k + WIDE])
        x = np.zeros((count, WIDE), np.float32)
        x[rows[i:j], at[i:j] - k] = 1
        out += x @ x.T
    return out


def settled(entries: DataFrame, known: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of classes of the same runs that link: a tile has its classes' texts once and intersects all their sets."""

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        _, band_a, block_a, band_b, block_b = key
        members, at = sets(*C.buffer_of(pa.array(f["text"], pa.string())))
        n = np.diff(at)
        same = common(np.repeat(np.arange(len(f)), n), members, len(f))
        fit = 100 * same.astype(np.int64) >= percent * (n[:, None] + n[None, :] - same.astype(np.int64))
        first = ((f["band"] == band_a) & (f["block"] == block_a)).to_numpy()
        fit &= np.triu(np.ones_like(fit), 1) if (band_a, block_a) == (band_b, block_b) else first[:, None] & ~first[None, :]
        i, j = np.nonzero(fit)
        cls = f["cls"].to_numpy()
        return pd.DataFrame({"a": cls[i], "b": cls[j]})

    texts = keyed(docs).select("key", "text").dropDuplicates(["key"])
    return placed(entries, known, percent).join(texts, "key").groupBy(*TILE).applyInPandas(run, "a long, b long")


def spark_empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "node long, label long")


def labelled(df: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
    """df and the label of a class, itself if it has no link."""
    own = labels.select(F.col("node").alias(column), F.col("label").alias("_label"))
    return df.join(own, column, "left").withColumn(name, F.coalesce("_label", column)).drop("_label")


def groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    return judged(docs, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def judged(docs: DataFrame, percent: int) -> DataFrame:
    """One row a document: doc_id, key, n, component_id, and whether it is the one of its component that comes first (by doc_id, those without one last, then by key)."""
    described = C.cut(describe(docs))
    rows = described.select("doc_id", "key", "n", "cls")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    known = C.cut(described.filter("cls IS NOT NULL").groupBy("cls", "n").agg(F.min(order).alias("least"), F.min("key").alias("key"), F.max("bitmap").alias("bitmap")))
    met = C.cut(meet(docs, percent, described.agg(F.sum("n")).first()[0] or 0))
    candidates = C.cut(passing(met.filter("a IS NOT NULL").select("a", "b").distinct(), known, percent))
    labels = None

    def check(pairs: DataFrame) -> None:
        """Check pairs and join the components of those that link: each class's best pair first, then those that no link connects yet."""
        nonlocal labels
        best = C.cut(pairs.groupBy("b").agg(F.min(F.struct("differ", "a", "key_a", "key_b")).alias("x")).select("x.a", "b", "x.key_a", "x.key_b"))
        rest = pairs.join(best.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", "key_a", "key_b")
        for own in (best, rest):
            if own is rest and labels is not None:
                own = C.cut(labelled(labelled(rest, labels, "a", "label_a"), labels, "b", "label_b").filter("label_a <> label_b").drop("label_a", "label_b"))
            if own.isEmpty():
                continue
            found = linked(own, docs, percent)
            if labels is not None:  # a component is known by its label, so only labels need joining
                found = found.unionByName(labels.filter("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")))
            labels = C.cut(components(found))

    check(candidates)
    if labels is None:
        labels = spark_empty(docs.sparkSession)
    long = met.filter("token IS NOT NULL").select("token", "cls")
    for likeliest in (True, False) if not long.isEmpty() else ():
        own = labelled(long, labels, "cls", "label")
        mixed = C.cut(own.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("token"))
        if mixed.isEmpty():
            break
        chosen = F.broadcast(mixed) if C.few(mixed, 24) else mixed
        check(C.cut(tiles(C.cut(own.join(chosen, "token", "left_semi")), known, percent, likeliest)))
    named = C.cut(labelled(known.select("cls", "n", "least"), labels, "cls", "label"))
    least = C.cut(named.groupBy("label").agg(F.min("least").alias("first")))
    of_class = C.cut(named.join(least, "label").select("cls", "first"))
    out = rows.join(of_class, "cls", "left")
    alone = F.col("first").isNull()
    first = alone | (order == F.col("first"))
    return out.select("doc_id", "key", "n", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"), first.alias("first"))


def links(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b, n_links: every pair of classes that link, by their least doc_ids, and how many links their documents have; a class of several documents with itself.

    Every pair that meets is settled, whatever links are known already.
    """
    described = C.cut(describe(docs).filter("cls IS NOT NULL"))
    known = C.cut(described.groupBy("cls", "n").agg(F.min("doc_id").alias("least"), F.min("key").alias("key"), F.max("bitmap").alias("bitmap"), F.count("*").alias("docs")))
    met = C.cut(meet(docs, percent, described.agg(F.sum("n")).first()[0] or 0))
    found = linked(C.cut(passing(met.filter("a IS NOT NULL").select("a", "b").distinct(), known, percent)), docs, percent)
    long = met.filter("token IS NOT NULL").select("token", "cls", F.col("cls").alias("label"))
    if not long.isEmpty():
        found = found.unionByName(settled(long, known, docs, percent))
    found = found.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    side = lambda c: known.select(F.col("cls").alias(c), F.col("least").alias(f"least_{c}"), F.col("docs").alias(f"docs_{c}"))
    between = found.join(side("x"), "x").join(side("y"), "y").select(F.least("least_x", "least_y").alias("a"), F.greatest("least_x", "least_y").alias("b"), (F.col("docs_x") * F.col("docs_y")).alias("n_links"))
    within = known.filter("docs > 1").select(F.col("least").alias("a"), F.col("least").alias("b"), F.expr("docs * (docs - 1) div 2").alias("n_links"))
    return between.unionByName(within)


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with the first document of each component only, that of the least doc_id; all columns stay.

    Rows that repeat both doc_id and text are one document and stay together.
    """
    id_, key = (C.fresh(docs, x) for x in ("_id", "_key"))
    gone = C.cut(judged(docs, percent).filter(~F.col("first")).select(F.col("doc_id").alias(id_), F.col("key").alias(key)))
    own = F.xxhash64(F.col("doc_id"), F.coalesce("text", F.lit("")))
    gone = F.broadcast(gone) if C.few(gone, 48) else gone
    return docs.join(gone, (own == F.col(key)) & F.col("doc_id").cast("long").eqNullSafe(F.col(id_)), "left_anti")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(C.load(spark, sf_dir, "documents"))


def ngram_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(C.load(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE word AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS words FROM documents
), shingle AS (
    SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS s
    FROM (SELECT doc_id, words, unnest(range(1, CASE WHEN len(words) = 0 THEN 1 ELSE greatest(len(words) - 4, 1) + 1 END)) AS i FROM word)
), size AS (
    SELECT d.doc_id, count(s) AS n FROM documents d LEFT JOIN shingle USING (doc_id) GROUP BY d.doc_id
), pair AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
    SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * same >= 75 * (x.n + y.n - same)
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
)
SELECT a AS doc_id, n AS n_shingles, min(b) AS component_id FROM reach JOIN size ON doc_id = a GROUP BY a, n
"""

#: Pairs of distinct shingle sets that link, by the least doc_id of each, with the links of their documents.
LINKS_SQL = OP6_SQL[: OP6_SQL.index(", reach AS")] + r"""
, class AS (
    SELECT doc_id, sets, count(*) OVER w AS docs, min(doc_id) OVER w AS least
    FROM (SELECT doc_id, array_to_string(list(s ORDER BY s), chr(10)) AS sets FROM shingle GROUP BY doc_id)
    WINDOW w AS (PARTITION BY sets)
)
SELECT DISTINCT a.least AS a, b.least AS b, CASE WHEN a.least = b.least THEN a.docs * (a.docs - 1) // 2 ELSE a.docs * b.docs END AS n_links
FROM link JOIN class a ON a.doc_id = link.a JOIN class b ON b.doc_id = link.b WHERE a.least <= b.least
"""
