"""Hard-negative mining by dual-tree search over integer vectors.

Every usable row is indexed: rows are dealt to cells (centres fitted on a
bounded sample), cells are cut into blocks of a bounded number of rows by a
hash, and each block holds a ball tree.  Queries (anchors; later anchors with
the score of a positive) are taken in chunks of bounded bytes, sorted by cell,
with a ball tree for each cell.  A chunk is broadcast, and every block is walked
against it pair of nodes by pair of nodes: the balls bound all inner products of
the pair from both sides, so whole groups of anchors leave a node of candidates
at once; pairs of leaves are scored exactly.  The blocks of an anchor's own cell
come first; what they find bounds the search of all blocks.  A hot cell is many
blocks, and a task keeps `k` hits a query whatever it reads.

Defined cases: rows with a null id, label or vector, or with a component that is
null or not finite, take no part.  Components beyond +-2**27 after scaling are
held there.  Shorter vectors are filled up with zeros.  Rows that repeat an id
are rows of their own, and copies of an anchor are other rows.  Ties go to the
smaller id.  An empty table, one label only, or positives of negative score give
no rows.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm import common as C

#: Largest absolute value of a scaled component.
BOUND = 1 << 27
#: Rows that the centres of cells are fitted on, and cells at most; neither changes a result.
SAMPLE, CELLS = 8192, 64
#: Rows of a block on average, and of a leaf of candidates and of queries at most.
BLOCK_ROWS, LEAF_ROWS, LEAF_QUERIES = 2048, 256, 64
#: Bytes of a chunk of queries.
QUERY_BYTES = 16 << 20
#: Hits that a task gathers before it keeps the best of each query.
PENDING = 20_000
LEAST, MOST = -(1 << 62), 1 << 62


def usable(vector: str) -> Column:
    """Is the vector there, with finite components only?"""
    odd = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == F.lit(float("inf")))
    return F.col(vector).isNotNull() & ~F.exists(vector, odd)


def scaled(vector: str, factor: int, bound: int = BOUND) -> Column:
    """floor(factor * component), within +-bound."""
    return F.transform(vector, lambda c: F.floor(F.least(F.greatest(c.cast("double") * factor, F.lit(-float(bound))), F.lit(float(bound)))).cast("long"))


def matrix(vectors: list, width: int) -> np.ndarray:
    """Vectors as rows of longs, filled up with zeros."""
    out = np.zeros((len(vectors), width), np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


class Tree:
    """A ball tree: an order of the rows, and for each node its run of them, children (-1: a leaf), centre, radius and least and largest label."""

    def __init__(self, points: np.ndarray, labels: np.ndarray, leaf: int, roots: list[tuple[int, int]] | None = None):
        n, points = len(points), points.astype(np.float64)
        self.order = np.arange(n)
        self.first, self.last, self.left, self.right, centre, self.radius, self.low, self.high = [], [], [], [], [], [], [], []
        waiting = []

        def node(a: int, b: int) -> int:
            own = points[self.order[a:b]]
            mean = own.mean(0)
            self.first.append(a), self.last.append(b), self.left.append(-1), self.right.append(-1)
            centre.append(mean)
            self.radius.append(float(np.sqrt(((own - mean) ** 2).sum(1).max())))
            own = labels[self.order[a:b]]
            self.low.append(own.min()), self.high.append(own.max())
            waiting.append(len(self.first) - 1)
            return len(self.first) - 1

        self.roots = [node(a, b) for a, b in ([(0, n)] if roots is None else roots) if a < b]
        while waiting:
            k = waiting.pop()
            a, b = self.first[k], self.last[k]
            if b - a <= leaf or not self.radius[k]:
                continue
            own = points[self.order[a:b]]
            far = own[((own - centre[k]) ** 2).sum(1).argmax()]
            other = own[((own - far) ** 2).sum(1).argmax()]
            middle = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(own @ (other - far), middle)]
            self.left[k], self.right[k] = node(a, a + middle), node(a + middle, b)
        self.centre = np.array(centre).reshape(len(centre), points.shape[1])
        self.norm = np.sqrt((self.centre**2).sum(1))


class Best:
    """The k best hits of each query: largest score first, then the smaller id."""

    def __init__(self, low: np.ndarray, k: int):
        self.k, self.low = k, low.copy()
        self.held = tuple(np.zeros(0, np.int64) for _ in range(4))
        self.pending: list[tuple] = []
        self.waiting = 0

    def add(self, *hits: np.ndarray) -> None:
        self.pending.append(hits)
        self.waiting += len(hits[0])
        if self.waiting >= PENDING:
            self.settle()

    def settle(self) -> tuple:
        """(query, score, id, row) of all that are kept; raises the least score that still counts."""
        if self.pending:
            query, score, ids, rows = (np.concatenate(x) for x in zip(self.held, *self.pending, strict=True))
            order = np.lexsort((rows, ids, -score, query))
            query = query[order]
            place = np.arange(len(query)) - np.searchsorted(query, query, "left")
            order, query, place = (x[place < self.k] for x in (order, query, place))
            self.held = query, score[order], ids[order], rows[order]
            full = place == self.k - 1
            self.low[query[full]] = np.maximum(self.low[query[full]], self.held[1][full])
            self.pending, self.waiting = [], 0
        return self.held


def walk(queries: dict, best: Best, block: dict, roots: list[int], same: bool) -> None:
    """Walk a block's tree against the queries' trees from `roots` on; same: hits share the query's label, else they don't."""
    q, c = queries["tree"], block["tree"]
    exact = float(queries["most"]) * block["most"] * max(1, queries["vector"].shape[1]) < 2**52
    stack = [(a, r) for a in roots for r in c.roots]
    while stack:
        a, b = stack.pop()
        own = slice(q.first[a], q.last[a])
        middle = q.centre[a] @ c.centre[b]
        span = q.radius[a] * c.norm[b] + c.radius[b] * q.norm[a] + q.radius[a] * c.radius[b]
        span += 1 + 1e-9 * (span + q.norm[a] * c.norm[b])
        if middle + span < best.low[own].min() or middle - span > queries["high"][own].max():
            continue
        if (q.high[a] < c.low[b] or c.high[b] < q.low[a]) if same else q.low[a] == q.high[a] == c.low[b] == c.high[b]:
            continue
        if q.left[a] >= 0 and (c.left[b] < 0 or q.radius[a] > c.radius[b]):
            stack += [(q.left[a], b), (q.right[a], b)]
        elif c.left[b] >= 0:
            stack += [(a, c.left[b]), (a, c.right[b])]
        else:
            run = slice(c.first[b], c.last[b])
            if exact:
                score = queries["float"][own] @ block["float"][run].T
            else:
                score = queries["vector"][own] @ block["vector"][run].T
            hit = (score >= best.low[own, None]) & (score <= queries["high"][own, None])
            hit &= (queries["label"][own, None] == block["label"][None, run]) == same
            hit &= queries["row"][own, None] != block["row"][None, run]
            i, j = np.nonzero(hit)
            if len(i):
                best.add(i + own.start, score[i, j].astype(np.int64), block["id"][run][j], block["row"][run][j])


class Index:
    """All rows of a table as blocks with ball trees, in the shared folder."""

    def __init__(self, rows: DataFrame, sample: int = SAMPLE, cells: int = CELLS, block_rows: int = BLOCK_ROWS):
        """rows: vec_id and label long, vector array of long; none null."""
        self.spark = rows.sparkSession
        self.width = rows.agg(F.max(F.size("vector"))).first()[0] or 0
        near = rows.orderBy(F.xxhash64("vec_id", "vector")).limit(sample).select("vector").collect()
        self.centres = centres = _centres(matrix([r[0] for r in near], self.width).astype(float), cells)
        width = self.width

        @F.pandas_udf("int")
        def cell(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
            half = (centres**2).sum(1) / 2
            for v in vectors:
                yield pd.Series((matrix(v.tolist(), width) @ centres.T - half).argmax(1).astype(np.int32), dtype="int32")

        row = F.monotonically_increasing_id()
        self.rows = C.cut(rows.select("vec_id", "label", "vector", cell("vector").alias("cell"), row.alias("row")))
        # at most `cells` rows
        sizes = self.rows.groupBy("cell").agg(F.count("*").alias("n")).collect()
        salts = self.spark.createDataFrame([(r["cell"], -(-r["n"] // block_rows)) for r in sizes], "cell int, salts long")
        dealt = self.rows.join(F.broadcast(salts), "cell").withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts")))

        def block(f: pd.DataFrame) -> pd.DataFrame:
            x, label = matrix(f["vector"].tolist(), width), f["label"].to_numpy(np.int64)
            tree = Tree(x, label, LEAF_ROWS)
            order = tree.order
            held = {"tree": tree, "vector": x[order].astype(np.int32), "label": label[order], "id": f["vec_id"].to_numpy(np.int64)[order], "row": f["row"].to_numpy(np.int64)[order], "most": int(np.abs(x).max(initial=0))}
            return pd.DataFrame({"cell": [f["cell"].iloc[0]], "block": [pickle.dumps(held)]})

        self.blocks = C.cut(dealt.groupBy("cell", "salt").applyInPandas(block, "cell int, block binary"))

    def chunks(self, queries: DataFrame, bytes_: int = QUERY_BYTES) -> Iterator[pd.DataFrame]:
        """The queries, neighbours together, in chunks of about so many bytes."""
        most = max(1, bytes_ // (16 * self.width + 64))
        runs, size = [[]], 0
        for r in sorted(queries.groupBy("cell").agg(F.count("*").alias("n")).collect()):
            parts = -(-r["n"] // most)
            for salt in range(parts):
                if size and size + r["n"] / parts > most:
                    runs.append([])
                    size = 0
                runs[-1].append((r["cell"], parts, salt))
                size += r["n"] / parts
        for run in runs:
            if run:
                table = self.spark.createDataFrame(run, "cell int, parts long, part long")
                salted = queries.join(F.broadcast(table), "cell").filter(F.pmod(F.xxhash64("row", "place"), F.col("parts")) == F.col("part"))
                yield salted.drop("parts", "part").toPandas().sort_values(["cell", "row", "place"], ignore_index=True)

    def search(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """The k best hits of each query: row, place, score, vec_id, rank.

        queries: row long (which no hit of its own is), place int, label long,
        vector, cell, low and high long (least and largest score that counts).
        """
        folder = f"{C.shared_dir(self.spark)}/hits-{uuid.uuid4().hex}"
        schema = "row long, place int, score long, vec_id long, hit_row long"
        self.spark.createDataFrame([], f"{schema}, rank int").write.parquet(folder)
        for chunk in self.chunks(queries):
            x, label = matrix(chunk["vector"].tolist(), self.width), chunk["label"].to_numpy(np.int64)
            cells, first = np.unique(chunk["cell"].to_numpy(), return_index=True)
            tree = Tree(x, label, LEAF_QUERIES, list(zip(first, [*first[1:], len(x)], strict=True)))
            order = tree.order
            named = {name: chunk[name].to_numpy(np.int64)[order] for name in ("row", "place", "low", "high")}
            held = named | {"tree": tree, "vector": x[order], "float": x[order].astype(float), "label": label[order], "most": int(np.abs(x).max(initial=0)), "roots": dict(zip(cells.tolist(), tree.roots, strict=True))}
            near = self._hits(held, k, same, True).collect()  # at most k rows a query of the chunk
            last = {(r["row"], r["place"]): r["score"] for r in near if r["rank"] == k}
            found = np.array([last.get(key, LEAST) for key in zip(held["row"].tolist(), held["place"].tolist(), strict=True)], np.int64)
            held["low"] = np.maximum(held["low"], found)
            self._hits(held, k, same, False).write.mode("append").parquet(folder)
        return self.spark.read.parquet(folder)

    def _hits(self, queries: dict, k: int, same: bool, own_cell: bool) -> DataFrame:
        sent = self.spark.sparkContext.broadcast(queries)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            q = sent.value
            best = Best(q["low"], k)
            for f in frames:
                for cell, raw in zip(f["cell"], f["block"], strict=True):
                    block = pickle.loads(raw)
                    block["float"], block["vector"] = block["vector"].astype(float), block["vector"].astype(np.int64)
                    roots = [q["roots"][cell]] if own_cell and cell in q["roots"] else [] if own_cell else q["tree"].roots
                    walk(q, best, block, roots, same)
            query, score, ids, rows = best.settle()
            yield pd.DataFrame({"row": q["row"][query], "place": q["place"][query].astype(np.int32), "score": score, "vec_id": ids, "hit_row": rows})

        hits = self.blocks.mapInPandas(run, "row long, place int, score long, vec_id long, hit_row long")
        order = W.partitionBy("row", "place").orderBy(F.desc("score"), "vec_id", "hit_row")
        return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _centres(points: np.ndarray, cells: int) -> np.ndarray:
    """Centres of at most so many cells: a few rounds of k-means over the sample."""
    if not len(points):
        return np.zeros((1, points.shape[1]))
    draw = np.random.default_rng(5)
    at = points[draw.choice(len(points), min(cells, -(-len(points) // 32)), replace=False)]
    for _ in range(6):
        own = (points @ at.T - (at**2).sum(1) / 2).argmax(1)
        count = np.bincount(own, minlength=len(at))
        sums = np.zeros_like(at)
        np.add.at(sums, own, points)
        at = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], at)
    return at


def floor_share(share: int, score: Column) -> Column:
    """floor(share * score / 100) in longs."""
    whole = score * share
    return F.call_function("div", whole - F.pmod(whole, F.lit(100)), F.lit(100))


def mine(embeddings: DataFrame, anchors: Column, factor: int = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, **index: int) -> DataFrame:
    """For each anchor and each of its best positives, the best negatives whose score lies between low and high percent of the positive's.

    embeddings: vec_id, label, embedding.  anchors: a condition on vec_id.
    """
    rows = embeddings.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("embedding"))
    held = Index(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), scaled("embedding", factor).alias("vector")), **index)
    own = held.rows.filter(anchors).select("row", F.col("vec_id").alias("anchor_id"), "label", "vector", "cell")
    first = own.select("row", F.lit(0).alias("place"), "label", "vector", "cell", F.lit(LEAST).alias("low"), F.lit(MOST).alias("high"))
    found = held.search(first, positives, True).select("row", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    ends = own.join(found, "row").withColumn("low", -floor_share(low, -F.col("positive_score"))).withColumn("high", floor_share(high, F.col("positive_score")))
    ends = C.cut(ends.filter(F.col("low") <= F.col("high")))
    hard = held.search(ends.select("row", "place", "label", "vector", "cell", "low", "high"), negatives, False)
    out = hard.select("row", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return ends.select("row", "place", "anchor_id", "positive_id", "positive_score").join(out, ["row", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.load(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), "embedding")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH rows_ AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM rows_ a JOIN rows_ b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM scores WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND s.label <> p.own AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 5
"""
