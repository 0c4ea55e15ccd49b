"""Toxicity: a bidirectional gated recurrent network with attention pooling, over words and characters, in numpy.

A word is a run of bytes other than white space, A-Z lower-cased.  Its input is
its own vector, if the word is in the vocabulary learnt from the labelled
sample, beside the tanh of the sum of the vectors of its byte trigrams and of
its first four and five bytes.  Vectors begin as log odds.  Windows of WINDOW
words every STRIDE words, the last one ending with the text, are read by one
gated recurrent unit in each direction; attention weights the states, and a
logistic output scores the window.  A document's score is its largest.

Learning takes the whole texts of a bounded sample of labelled rows
(`labelled.sample`): each round scores all their windows, and then learns from
the highest of each toxic text and the highest two of each other text, as long
as the loss falls.

Defined cases: a null text is an empty one; a text without words has the share
of label 1 as its score.  Equal texts have equal scores, so rows that repeat do,
each with a row of its own.  Other columns are passed on or not read, whatever
their names.  Labels that are null or name no document are not used, and of
repeated labels of a doc_id the larger counts; without labels of both classes
every score is that share (0.5 if there are none).  An empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common as C
from millrace.llm import labelled as L

WINDOW, STRIDE = 40, 30
WORD, CHAR, STATE = 6, 8, 8
VOCABULARY = 8192
#: Windows that the network reads at once.
BATCH = 4096
#: Steps of learning, of 128 windows each, after which the loss is looked at.
STEPS = 32


def features(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the characters' features of each word, and where each word's begin: a trigram around each byte, and the first 4 and 5 bytes."""
    lengths = ends - begins
    at = np.concatenate([[0], np.cumsum(lengths + 2)])
    word = np.repeat(np.arange(len(begins)), lengths)
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    here = begins[word] + place
    low = C.LOWER[data].astype(np.int64)
    before = np.where(place > 0, low[here - 1], 1)
    after = np.where(place + 1 < lengths[word], low[np.minimum(here + 1, len(data) - 1)], 2)
    out = np.empty(at[-1], np.int64)
    out[at[word] + place] = before << 16 | low[here] << 8 | after
    first = np.zeros(len(begins), np.int64)
    for k in range(5):
        first = first << 8 | np.where(lengths > k, low[np.minimum(begins + k, len(data) - 1)], 2)
        if k >= 3:
            out[at[1:] - 5 + k] = first | k << 40
    return out, at


def windows(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and number of words of each window, and the number of the first window of each text; a text without words has none."""
    count = np.diff(at)
    each = np.where(count > 0, 1 + -(-np.maximum(count - WINDOW, 0) // STRIDE), 0)
    first = np.concatenate([[0], np.cumsum(each)])
    begin = np.repeat(at[:-1], each) + STRIDE * (np.arange(first[-1]) - np.repeat(first[:-1], each))
    stop = np.repeat(at[1:], each)
    begin = np.maximum(np.minimum(begin, stop - WINDOW), np.repeat(at[:-1], each))
    return begin, np.minimum(stop - begin, WINDOW), first


def sums(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of runs of rows; every run has a row."""
    return np.add.reduceat(rows, at[:-1], axis=0)


class Network:
    def __init__(self, p: dict[str, np.ndarray], words: C.Lookup | None, chars: C.Lookup | None, share: float):
        self.p, self.words, self.chars, self.share = p, words, chars, share

    def inputs(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """What both units are given for each of some distinct words."""
        codes, at = features(data, begins, ends)
        char = np.tanh(sums(self.p["char"][self.chars(codes)], at))
        return np.hstack([self.p["word"][self.words(hashes)], char]) @ self.p["in"] + self.p["in0"]

    def read(self, given: np.ndarray, inside: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States of both units at each place: (windows, WINDOW, 2 STATE)."""
        n, size = inside.shape
        out = np.zeros((n, size, 2 * STATE), np.float32)
        for way in (0, 1):
            h = np.zeros((n, STATE), np.float32)
            own = given[:, :, way * 3 * STATE : (way + 1) * 3 * STATE]
            for t in range(size) if way == 0 else range(size - 1, -1, -1):
                u = h @ self.p["re"][way]
                gates = 1 / (1 + np.exp(-(own[:, t, : 2 * STATE] + u[:, : 2 * STATE])))
                z, r = gates[:, :STATE], gates[:, STATE:]
                c = np.tanh(own[:, t, 2 * STATE :] + r * u[:, 2 * STATE :])
                m = inside[:, t, None]
                new = np.where(m, h + z * (c - h), h)
                if keep is not None:
                    keep.append((way, t, h, u, z, r, c, m))
                h = new
                out[:, t, way * STATE : (way + 1) * STATE] = h
        return out

    def attend(self, states: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e = np.where(inside, states @ self.p["at"], -1e9)
        a = np.exp(e - e.max(axis=1, keepdims=True))
        a /= a.sum(axis=1, keepdims=True)
        pooled = np.einsum("nt,nts->ns", a, states)
        return a, pooled, pooled @ self.p["out"] + self.p["out0"][0]

    def every_logit(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The logit of each window of many texts, some texts at a time."""
        return np.concatenate([self.logits(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[0] for a, b in C.blocks(offsets)])

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        """The logit of each window, and the number of the first window of each text."""
        hashes, at = C.word_hashes(data, offsets)
        begins, ends = C.words_of(data, offsets)
        begin, length, first = windows(at)
        out = np.empty(len(begin), np.float32)
        for k in range(0, len(begin), BATCH):  # a batch's windows are neighbours, so their words are a run
            b, n = begin[k : k + BATCH], length[k : k + BATCH]
            low, high = int(b[0]), int((b + n).max())
            kinds, one, which = np.unique(hashes[low:high], return_index=True, return_inverse=True)
            given = self.inputs(data, begins[low:high][one], ends[low:high][one], kinds).astype(np.float32)
            inside = np.arange(WINDOW) < n[:, None]
            place = np.minimum(b[:, None] - low + np.arange(WINDOW), high - low - 1)
            for j in range(0, len(b), 512):
                part = slice(j, j + 512)
                out[k + j : k + j + 512] = self.attend(self.read(given[which[place[part]]], inside[part]), inside[part])[2]
        return out, first, (begin, length)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        scores = np.full(n, self.share)
        if self.p:
            logits, first, _ = self.logits(data, offsets)
            some = np.flatnonzero(np.diff(first))
            if len(some):
                scores[some] = L.sigmoid(np.maximum.reduceat(logits, first[:-1][some]).astype(np.float64))
        return scores


def odds(words: np.ndarray, at: np.ndarray, codes: np.ndarray, code_at: np.ndarray, labels: np.ndarray, least: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The most telling codes of words, and their log odds by the texts that hold them.

    words: the number of each word of the texts, which begin at `at`; codes: those of each numbered word, which begin at code_at.
    Texts are counted a few at a time.
    """
    kinds, which = np.unique(codes, return_inverse=True)
    held = np.zeros((2, len(kinds)))
    step = 64
    for k in range(0, len(labels), step):
        n = len(at[k : k + step + 1]) - 1
        own = np.repeat(np.arange(n), np.diff(at[k : k + n + 1]))
        pairs = np.unique(own * (len(code_at) - 1) + words[at[k] : at[k + n]])
        own, word = pairs // (len(code_at) - 1), pairs % (len(code_at) - 1)
        count = np.diff(code_at)[word]
        spread = np.repeat(code_at[word] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        pairs = np.unique(np.repeat(own, count) * len(kinds) + which[spread])
        for y in (0, 1):
            held[y] += np.bincount(pairs[labels[k + pairs // len(kinds)] == y] % len(kinds), minlength=len(kinds))
    with_0, with_1 = held
    ratio = np.log((with_1 + 0.5) / (labels.sum() + 1)) - np.log((with_0 + 0.5) / ((1 - labels).sum() + 1))
    ratio *= (with_1 + with_0) / (with_1 + with_0 + 8)  # what few texts say counts for less
    order = np.argsort(-np.abs(ratio) * np.sqrt(with_1 + with_0) * (with_1 + with_0 >= least), kind="stable")[:VOCABULARY]
    order = np.sort(order[(with_1 + with_0)[order] >= least])
    return kinds[order], ratio[order].astype(np.float32)


def fit(texts: list[str], labels: np.ndarray, share: float, rounds: int = 4, epochs: int = 4, seed: int = 11) -> Network:
    if not len(labels) or labels.min() == labels.max():
        return Network({}, None, None, share)
    import pyarrow as pa

    rng = np.random.default_rng(seed)
    data, offsets = C.buffer_of(pa.array(texts, pa.large_string()))
    hashes, at = C.word_hashes(data, offsets)
    if not len(hashes):
        return Network({}, None, None, share)
    kinds, one, which = np.unique(hashes, return_index=True, return_inverse=True)
    which = which.astype(np.int32)
    del hashes
    begins, ends = (x[one] for x in C.words_of(data, offsets))
    codes, code_at = features(data, begins, ends)
    word_codes, word_odds = odds(which, at, kinds, np.arange(len(kinds) + 1), labels)
    char_codes, char_odds = odds(which, at, codes, code_at, labels)
    words, chars = C.Lookup(word_codes), C.Lookup(char_codes)
    scale = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[-2] if len(shape) > 1 else shape[-1]), shape)
    p = {
        "word": rng.normal(0, 0.05, (len(word_codes) + 1, WORD)),
        "char": rng.normal(0, 0.05, (len(char_codes) + 1, CHAR)),
        "in": scale(WORD + CHAR, 6 * STATE),
        "in0": np.zeros(6 * STATE),
        "re": scale(2, STATE, 3 * STATE),
        "at": scale(2 * STATE),
        "out": scale(2 * STATE),
        "out0": np.zeros(1),
    }
    p["word"][1:, 0] += np.clip(word_odds, -2, 4)
    p["char"][1:, 0] += np.clip(char_odds, -1, 2) / 6
    p["word"][0] = p["char"][0] = 0
    p = {k: v.astype(np.float32) for k, v in p.items()}
    net = Network(p, words, chars, share)
    word_of, char_of = words(kinds), chars(codes)
    adam = L.Adam(p, 0.01)
    tell = np.zeros(len(word_codes) + 1, np.float32)
    tell[1:] = word_odds
    tell_char = np.zeros(len(char_codes) + 1, np.float32)
    tell_char[1:] = np.clip(char_odds, -1, 3)
    guess = np.maximum(tell[word_of], sums(tell_char[char_of], code_at) / np.sqrt(np.diff(code_at)))[which]
    begin, length, first = windows(at)
    window_text = np.repeat(np.arange(len(texts)), np.diff(first))
    place = np.minimum(begin[:, None].astype(np.int32) + np.arange(WINDOW, dtype=np.int32), np.int32(len(which) - 1))
    # before the first round, a window is as toxic as its most toxic word
    score = np.where(np.arange(WINDOW) < length[:, None], guess[place], np.float32(-9)).max(axis=1)
    for turn in range(rounds):
        if turn:
            score = net.every_logit(data, offsets)
        order = np.lexsort((-score, window_text))
        rank = np.arange(len(order)) - first[window_text[order]]
        chosen = order[rank < np.where(labels[window_text[order]] == 1, 1, 2)]
        y = labels[window_text[chosen]]
        each = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
        if turn == rounds - 1:
            adam.rate /= 4
        due, more = L.Falling(epochs, 3 * epochs), True
        while more:
            # the loss is that of STEPS steps or so, whatever the number of windows
            mixed, loss = np.concatenate([rng.permutation(len(chosen)) for _ in range(max(1, round(STEPS * 128 / len(chosen))))]), 0.0
            for k in range(0, len(mixed), 128):
                own = mixed[k : k + 128]
                loss += _step(net, adam, which[place[chosen[own]]], np.arange(WINDOW) < length[chosen[own]][:, None], y[own], each[own], word_of, char_of, code_at, rng)
            more = due(loss / len(mixed))
    p["out0"] += np.float32(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))  # the classes weighed the same until here
    return net


def _step(net: Network, adam: L.Adam, words: np.ndarray, inside: np.ndarray, y: np.ndarray, weight: np.ndarray, word_of: np.ndarray, char_of: np.ndarray, code_at: np.ndarray, rng: np.random.Generator) -> float:
    """One step of learning from some windows, back through both units, the attention and the inputs; gives their loss."""
    p = net.p
    kinds, which = np.unique(words[inside], return_inverse=True)
    count = np.diff(code_at)[kinds]
    at = np.concatenate([[0], np.cumsum(count)])
    code = char_of[np.repeat(code_at[kinds] - at[:-1], count) + np.arange(at[-1])]
    char = np.tanh(sums(p["char"][code], at))
    shown = (rng.random((len(kinds), 2)) < 0.9).astype(np.float32)  # else a word's own vector, or its characters, would be learnt by heart
    x = np.hstack([p["word"][word_of[kinds]] * shown[:, :1], char * shown[:, 1:]])
    given = np.zeros((*inside.shape, 6 * STATE), np.float32)
    given[inside] = (x @ p["in"] + p["in0"])[which]
    kept: list = []
    states = net.read(given, inside, kept)
    a, pooled, logit = net.attend(states, inside)
    g = ((L.sigmoid(logit) - y) * weight / len(y)).astype(np.float32)
    grads = {"out": pooled.T @ g, "out0": np.array([g.sum()], np.float32), "re": np.zeros_like(p["re"])}
    gp = g[:, None] * p["out"]
    ga = np.einsum("ns,nts->nt", gp, states)
    ge = a * (ga - (a * ga).sum(axis=1, keepdims=True))
    grads["at"] = np.einsum("nt,nts->s", ge, states)
    gs = a[:, :, None] * gp[:, None, :] + ge[:, :, None] * p["at"]
    gx = np.zeros_like(given)
    carried = [np.zeros((len(y), STATE), np.float32) for _ in range(2)]
    for way, t, h, u, z, r, c, m in reversed(kept):
        gh = gs[:, t, way * STATE : (way + 1) * STATE] + carried[way]
        gn = np.where(m, gh, 0)
        gc = gn * z * (1 - c * c)
        gz = gn * (c - h) * z * (1 - z)
        gr = gc * u[:, 2 * STATE :] * r * (1 - r)
        gu = np.hstack([gz, gr, gc * r])
        carried[way] = np.where(m, gn * (1 - z), gh) + gu @ p["re"][way].T
        grads["re"][way] += h.T @ gu
        gx[:, t, way * 3 * STATE : (way + 1) * 3 * STATE] = np.hstack([gz, gr, gc])
    of_kind = np.zeros((len(kinds), 6 * STATE), np.float32)
    np.add.at(of_kind, which, gx[inside])
    grads["in"], grads["in0"] = x.T @ of_kind, of_kind.sum(axis=0)
    back = of_kind @ p["in"].T
    grads["word"], grads["char"] = 1e-5 * p["word"], 1e-5 * p["char"]
    np.add.at(grads["word"], word_of[kinds], back[:, :WORD] * shown[:, :1])
    np.add.at(grads["char"], code, np.repeat(back[:, WORD:] * shown[:, 1:] * (1 - char * char), count, axis=0))
    grads["word"][0] = grads["char"][0] = 0
    adam.step(grads)
    return float((L.log_loss(logit, y) * weight).sum())


def fitted(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> Network:
    return fit(*L.sample(docs, labels, "toxic", L.fold(F.col("doc_id"), folds) != held))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    net = fitted(docs, labels, folds, held)
    scored = L.with_scores(C.text_frame(docs), lambda: net, "score")
    return scored.select("doc_id", F.coalesce(L.fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 4, held: int = 2) -> DataFrame:
    """docs without those that score at the threshold or above; all columns stay.  Without labels of both classes nothing is known, and nothing goes."""
    net = fitted(docs, labels, folds, held)
    if not net.p:
        return docs
    name = C.fresh(docs, "_toxicity")
    return L.with_scores(docs, lambda: net, name).filter(F.col(name) < threshold).select(*docs.columns)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(C.load(spark, sf_dir, "documents"), C.load(spark, sf_dir, "labels"))
