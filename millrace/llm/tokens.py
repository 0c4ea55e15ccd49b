"""Token counts: pieces are counted once per distinct pre-token, joined to each document's pre-token frequencies and summed.

A pre-token is a run of spaces and the non-spaces after it, in the text with
one space before it (the model's dummy prefix).  No piece of the vocabulary
crosses from a non-space to a space, so the count of a text is the sum of the
counts of its pre-tokens, and a pre-token counts as the library counts it
without its first space.

A first pass gathers the distinct pre-tokens of all texts and how many runs of
rows hold each.  The FREQUENT (and FREQUENT_LONG) that most runs hold are
counted once each and given to all tasks; a second pass joins them to each
document's frequencies where the document lies and sums.  A pre-token that is
not among them is counted once for each run of rows that holds it, without
being moved: a shuffled join of those, the rarest, would move more than the
texts.  Pre-tokens are compared as bytes, not as hashes.  Ids of documents are
never made.

Defined cases: a null or empty text has 0 bytes and 0 tokens.  Rows that repeat
a doc_id are counted each.  An empty table gives an empty result.  Other
columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from millrace.llm import common as C

#: Pre-tokens whose counts all tasks hold: of at most EIGHTS x 8 bytes each (some 20 MB), and longer ones (10 MB).
FREQUENT, FREQUENT_LONG = 200_000, 10_000
EIGHTS = 4
#: The longest pre-token that may be frequent, in bytes.
LONGEST = 1024
#: Distinct pre-tokens that a task gathers before it sends them on.
GATHERED = 200_000
META = "▁"
LIMIT = 4096


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """The library's number of pieces of pre-tokens."""

    def __init__(self, model: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)

    def __call__(self, pretokens: list[bytes]) -> np.ndarray:
        spans = [x[1:].decode() for x in pretokens]
        return np.array([len(x) if s else 1 for s, x in zip(spans, self.model.encode(spans, num_threads=1), strict=True)], np.int64)


def with_space(texts: pa.Array) -> pa.Array:
    """Texts with one space before them; the library's own mark for a space is a space to it."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if pc.any(pc.match_substring(texts, META)).as_py():
        texts = pc.replace_substring(texts, META, " ")
    return pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string()))


class Spans:
    """The distinct pre-tokens of some texts and how often each text has them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        space = data == 0x20
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[offsets[:-1]] = True
        begins = np.flatnonzero(begins)
        ends = np.append(begins[1:], len(data))
        inside = np.searchsorted(begins, offsets)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(inside))
        some = (np.diff(offsets) > 1)[row]  # else nothing but the prefix
        begins, ends, row = begins[some], ends[some], row[some]
        length = ends - begins
        words = C.eights(data)
        # the first bytes of each, and its length: equal ones are equal pre-tokens up to 8 * EIGHTS bytes
        self.heads = [words[np.minimum(begins + 8 * k, len(data))] & C.REST[np.clip(length - 8 * k, 0, 8)] for k in range(EIGHTS)]
        hashes = C.hash_spans(data, begins, ends)
        kinds, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        odd = np.zeros(len(begins), bool)  # spans whose hash is that of another one
        for x in (length, *self.heads):
            odd |= x != x[first][which]
        long = np.flatnonzero(length > 8 * EIGHTS)
        if len(long):
            raw = data.tobytes()
            of = {w: raw[begins[i] : ends[i]] for w, i in zip(which[long].tolist(), first[which[long]].tolist(), strict=True)}
            for i in long.tolist():
                odd[i] |= raw[begins[i] : ends[i]] != of[which[i]]
        extra = np.flatnonzero(odd)
        which[extra] = len(kinds) + np.arange(len(extra))  # each stands for itself
        first = np.append(first, extra)
        self.data, self.hashes, self.row, self.which = data, np.append(kinds, hashes[extra]), row, which
        self.begins, self.ends = begins[first], ends[first]
        self.heads = [x[first] for x in self.heads]

    def bytes_of(self, chosen: np.ndarray) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.begins[chosen].tolist(), self.ends[chosen].tolist(), strict=True)]

    @property
    def lengths(self) -> np.ndarray:
        return self.ends - self.begins


class Known:
    """Counts of frequent pre-tokens, found by hash and told apart by their bytes."""

    def __init__(self, pretokens: list[bytes], counts: np.ndarray):
        data, offsets = C.buffer_of(pa.array(pretokens, pa.large_binary()).view(pa.large_string())) if pretokens else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
        begins, length = offsets[:-1], np.diff(offsets)
        hashes = C.hash_spans(data, begins, offsets[1:])
        order = np.argsort(hashes, kind="stable")
        words = C.eights(data)
        self.lookup = C.Lookup(hashes)
        self.at = np.searchsorted(hashes[order], self.lookup.codes)
        self.length, self.counts = length[order][self.at], counts[order][self.at]
        self.heads = [(words[np.minimum(begins + 8 * k, len(data))] & C.REST[np.clip(length - 8 * k, 0, 8)])[order][self.at] for k in range(EIGHTS)]
        self.long = {x: n for x, n in zip(pretokens, counts.tolist(), strict=True) if len(x) > 8 * EIGHTS}

    def __call__(self, spans: Spans) -> np.ndarray:
        """Pieces of each distinct span, -1 of those not known."""
        out = np.full(len(spans.hashes), -1, np.int64)
        found = self.lookup(spans.hashes)
        hit = np.flatnonzero(found)
        at = found[hit] - 1
        same = (self.length[at] == spans.lengths[hit]) & (spans.lengths[hit] <= 8 * EIGHTS)
        for own, other in zip(self.heads, spans.heads, strict=True):
            same &= own[at] == other[hit]
        out[hit[same]] = self.counts[at[same]]
        long = np.flatnonzero((spans.lengths > 8 * EIGHTS) & (spans.lengths <= LONGEST))
        if len(long) and self.long:
            out[long] = [self.long.get(x, -1) for x in spans.bytes_of(long)]
        return out


def spans_of(texts: pa.Array, size: int = C.CHUNK_BYTES) -> Iterator[tuple[int, int, Spans]]:
    """Blocks of rows and their spans."""
    data, offsets = C.buffer_of(with_space(texts))
    for a, b in C.blocks(offsets, size, 1 << 14):
        yield a, b, Spans(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def frequent_pretokens(docs: DataFrame, model: str, frequent: int, frequent_long: int) -> DataFrame:
    """pretoken and pieces of the pre-tokens that most runs of rows hold, and two at least; pieces are counted after the shuffle, once each."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        send = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["pretoken", "held"])
        for batch in batches:
            for _, _, spans in spans_of(batch.column(0)):
                for x in spans.bytes_of(np.flatnonzero(spans.lengths <= LONGEST)):
                    held[x] = held.get(x, 0) + 1
                if len(held) >= GATHERED:
                    yield send()
                    held.clear()
        if held:
            yield send()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(tokenizer_path(model))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pieces(batch.column(0).to_pylist()), pa.int64())], ["pretoken", "pieces"])

    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(gather, "pretoken binary, held long")
    table = C.cut(rows.groupBy("pretoken").agg(F.sum("held").alias("held")).filter("held > 1"))
    short = F.length("pretoken") <= 8 * EIGHTS
    top = lambda of, n: C.foremost(table.filter(of), "held", "pretoken", n).select("pretoken")
    return top(short, frequent).unionByName(top(~short, frequent_long)).mapInArrow(count, "pretoken binary, pieces long")


def token_counts(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = LIMIT, frequent: int = FREQUENT, frequent_long: int = FREQUENT_LONG, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, the columns to keep, n_bytes, n_tokens and over_limit of every document."""
    held = frequent_pretokens(docs, model, frequent, frequent_long).toArrow()  # bounded by both limits
    known = docs.sparkSession.sparkContext.broadcast(Known(held.column(0).to_pylist(), held.column(1).to_numpy()))
    rows = C.text_frame(docs, *keep).select("doc_id", *keep, "text")
    own = rows.schema.fields[:-1]
    names = [*(f.name for f in own), "n_bytes", "n_tokens", "over_limit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(tokenizer_path(model))
        for batch in batches:
            texts = batch.column(len(own))
            n_bytes = np.diff(C.buffer_of(texts)[1])
            for a, b, spans in spans_of(texts):
                counts = known.value(spans)
                other = np.flatnonzero(counts < 0)
                counts[other] = pieces(spans.bytes_of(other))
                n = np.bincount(spans.row, counts[spans.which], b - a).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[: len(own)], pa.array(n_bytes[a:b]), pa.array(n), pa.array(n > limit)], names)

    kinds = (*(StructField(f.name, f.dataType) for f in own), StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), StructField("over_limit", BooleanType()))
    return rows.mapInArrow(run, StructType(list(kinds)))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(C.load(spark, sf_dir, "documents"))
