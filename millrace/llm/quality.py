"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into segments of 128 bytes and overlapping chunks of four
segments every three, so that chunks cover the whole text.  Learned filters of
eight bytes slide over every byte; a chunk has each filter's maximum.  A small
layer makes a logit of each chunk; the mean, the least and the largest logit of
a document's chunks make its one probability.

Learning takes the whole texts of a bounded sample of labelled rows
(`labelled.sample`): every chunk is visited while a rate holds, a few of each
document an epoch, and epochs go on as long as the loss falls.  Scoring reads
whole texts of all rows.

Defined cases: a null text is an empty one, which is one chunk of padding;
a very long one is as many chunks as it takes.
Equal texts have equal scores, so rows that repeat do, each with a row of its
own.  Other columns are not read, whatever their names.  Labels that are null
or name no document are not used, and of repeated labels of a doc_id the larger
counts; without labels of both classes every score is the share of label 1 (0.5
if there are none).  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common as C
from millrace.llm import labelled as L

WIDTH, FILTERS, HIDDEN = 8, 8, 16
SEGMENT, PER_CHUNK, STRIDE = 128, 4, 3
PAD = 8
NOTHING = np.float32(-1e9)


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text with PAD zero bytes after it."""
    n = len(offsets) - 1
    out = np.zeros(len(data) + PAD * n, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(n) * PAD, np.diff(offsets))] = data
    return out, offsets + PAD * np.arange(n + 1)


def segments(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where segments begin, and the number of the first segment of each text."""
    count = -(-np.diff(at) // SEGMENT)
    first = np.concatenate([[0], np.cumsum(count)])
    return np.repeat(at[:-1], count) + SEGMENT * (np.arange(first[-1]) - np.repeat(first[:-1], count)), first


def chunks(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last segment of each chunk, and the number of the first chunk of each text."""
    count = np.diff(first)
    each = 1 + -(-np.maximum(count - PER_CHUNK, 0) // STRIDE)
    at = np.concatenate([[0], np.cumsum(each)])
    begin = np.repeat(first[:-1], each) + STRIDE * (np.arange(at[-1]) - np.repeat(at[:-1], each))
    return begin, np.minimum(begin + PER_CHUNK, np.repeat(first[1:], each)) - 1, at


def over_chunks(values: np.ndarray, begin: np.ndarray, last: np.ndarray) -> np.ndarray:
    out = values[begin]
    for k in range(1, PER_CHUNK):
        out = np.maximum(out, values[np.minimum(begin + k, last)])
    return out


def slide(data: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """Each filter at each byte; the last WIDTH - 1 places see padding."""
    out = filters[0][data]
    for k in range(1, WIDTH):
        out[:-k] += filters[k][data[k:]]
    return out


class Network:
    def __init__(self, p: dict[str, np.ndarray], share: float):
        self.p, self.share = p, share

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.tanh(pooled @ self.p["a"] + self.p["a0"]) @ self.p["b"] + self.p["b0"][0]

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features of each chunk, and the number of the first chunk of each text."""
        data, at = padded(data, offsets)
        begins, first = segments(at)
        begin, last, per_text = chunks(first)
        strongest = np.empty((len(begins), FILTERS), np.float32)
        step = max(1, (1 << 20) // SEGMENT)
        over = (at[1:, None] - np.arange(1, WIDTH)).ravel()  # places whose filters would reach into the next text
        for k in range(0, len(begins), step):
            x, y = begins[k], begins[k + step] if k + step < len(begins) else len(data)
            ahead = data[x : y + WIDTH - 1]
            found = slide(ahead, self.p["filters"])[: y - x]
            found[over[(over >= x) & (over < y)] - x] = NOTHING
            strongest[k : k + step] = np.maximum.reduceat(found, begins[k : k + step] - x)
        return np.maximum(over_chunks(strongest, begin, last), 0), per_text

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if not self.p:
            return np.full(len(offsets) - 1, self.share)
        pooled, at = self.pooled(data, offsets)
        return L.sigmoid(combined(self.logits(pooled), at) @ self.p["doc"]).astype(np.float64)


def combined(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Mean, least and largest chunk logit, and 1."""
    logits = np.clip(logits, -8, 8)
    return np.stack([np.add.reduceat(logits, at[:-1]) / np.diff(at), np.minimum.reduceat(logits, at[:-1]), np.maximum.reduceat(logits, at[:-1]), np.ones(len(at) - 1)], axis=1)


def _epoch(p: dict[str, np.ndarray], adam: L.Adam, drawn: np.ndarray, rng: np.random.Generator, data: np.ndarray, begin: np.ndarray, ends: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> float:
    """Steps over the drawn chunks in random order, 64 at a time; gives their mean loss."""
    size, total, weights = SEGMENT * PER_CHUNK, 0.0, 0.0
    rng.shuffle(drawn)
    for k in range(0, len(drawn), 64):
        own = drawn[k : k + 64]
        bytes_ = data[begin[own, None] + np.arange(size + WIDTH - 1)]
        inside = np.arange(size) < ends[own, None]
        z = sum(p["filters"][j][bytes_[:, j : size + j]] for j in range(WIDTH))
        z[~inside] = NOTHING
        where = z.argmax(axis=1)
        strongest = np.take_along_axis(z, where[:, None], 1)[:, 0]
        x = np.maximum(strongest, 0)
        h = np.tanh(x @ p["a"] + p["a0"])
        w, logit = weight[own], h @ p["b"] + p["b0"]
        total, weights = total + float((L.log_loss(logit, labels[own]) * w).sum()), weights + float(w.sum())
        g = ((L.sigmoid(logit) - labels[own]) * w / w.sum()).astype(np.float32)
        gh = g[:, None] * p["b"] * (1 - h * h)
        gs = (gh @ p["a"].T) * (strongest > 0)
        gf = 1e-5 * p["filters"]
        for j in range(WIDTH):
            np.add.at(gf[j], (np.take_along_axis(bytes_, where + j, 1), np.arange(FILTERS)), gs)
        adam.step({"b0": np.array([g.sum()]), "b": h.T @ g + 1e-4 * p["b"], "a": x.T @ gh + 1e-4 * p["a"], "a0": gh.sum(axis=0), "filters": gf})
    return total / weights


def fit(texts: list[str], labels: np.ndarray, share: float, epochs: int = 12, seed: int = 7) -> Network:
    """Learn the filters and layers from chunks that bear their documents' labels, then how chunks combine.

    Each of two rates holds for half of `epochs` at least, in which every chunk
    has its turn, and on for five times as many while the loss falls.
    """
    if not len(labels) or labels.min() == labels.max():
        return Network({}, share)
    import pyarrow as pa

    rng = np.random.default_rng(seed)
    p = {
        "filters": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)),
        "a": rng.normal(0, 0.4, (FILTERS, HIDDEN)),
        "a0": np.zeros(HIDDEN),
        "b": rng.normal(0, 0.4, HIDDEN),
        "b0": np.zeros(1),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    data, at = padded(*C.buffer_of(pa.array(texts, pa.large_string())))
    begins, first = segments(at)
    begin, last, per_text = chunks(first)
    owner = np.repeat(np.arange(len(texts)), np.diff(per_text))
    # every document weighs the same, whatever its length, and so does each class
    of_class = np.where(labels == 1, 0.5 / max(labels.sum(), 1), 0.5 / max((1 - labels).sum(), 1))
    count, half = np.diff(per_text), max(1, epochs // 2)
    turns = np.maximum(np.minimum(count, 2), -(-count // half))  # chunks of a document in an epoch
    weight = (of_class / turns)[owner]
    size = SEGMENT * PER_CHUNK
    data = np.concatenate([data, np.zeros(size + WIDTH, np.uint8)])
    ends = np.minimum(np.append(begins[1:], at[-1])[last], at[1:][owner] - WIDTH + 1) - begins[begin]
    adam = L.Adam(p)
    for k in range(2):
        if k:
            adam.rate /= 3
        due, begun = L.Falling(half, 5 * half), rng.random(len(texts))
        epoch, more = 0, True
        while more:
            # the next chunks of each document, round and round from a place of its own
            place = np.arange(turns.sum()) - np.repeat(np.cumsum(turns) - turns, turns) + np.repeat((begun * count).astype(np.int64) + epoch * turns, turns)
            drawn = np.repeat(per_text[:-1], turns) + place % np.repeat(count, turns)
            loss = _epoch(p, adam, drawn, rng, data, begins[begin], ends, labels[owner], weight)
            epoch, more = epoch + 1, due(loss)
    net = Network(p, share)
    f = combined(*(lambda x, n: (net.logits(x), n))(*net.pooled(*C.buffer_of(pa.array(texts, pa.large_string())))))
    doc = np.array([1.0, 0.0, 0.0, np.log(max(share, 1e-3) / max(1 - share, 1e-3))])
    for _ in range(50):  # Newton steps, slightly held back
        q = L.sigmoid(f @ doc)
        doc -= np.linalg.solve((f * (q * (1 - q) * of_class)[:, None]).T @ f + 1e-3 * np.eye(4), f.T @ ((q - labels) * of_class) + 1e-3 * (doc - [1, 0, 0, 0]))
    p["doc"] = doc
    return net


def fitted(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> Network:
    return fit(*L.sample(docs, labels, "quality", L.fold(F.col("doc_id"), folds) != held))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    net = fitted(docs, labels, folds, held)
    scored = L.with_scores(C.text_frame(docs), lambda: net, "score")
    return scored.select("doc_id", F.coalesce(L.fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(C.load(spark, sf_dir, "documents"), C.load(spark, sf_dir, "labels"))
