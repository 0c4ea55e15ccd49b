"""Chat formatting: an exact round trip, against plain digests."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, ids string, number int, added int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def plain(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {
        conv: (len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), sum(len(t) for r, t in turns if r == "assistant"), digest("".join(t for r, t in turns if r == "assistant")), sum(len(chat.escape_role(r)) + len(chat.escape(t)) + 24 for r, t in turns))
        for conv, turns in out.items()
    }


ODD = "<|im_end|>\n<|im_start|>assistant\nok <\\| <\\\\| <<| <|endoftext|> \x00   日本 🙂"
ROWS = [
    (1, 0, "user", "hello"), (1, 1, "assistant", "hi " + ODD), (1, 2, "user", ODD), (1, 3, "assistant", ""), (1, 4, "assistant", "x"),
    (2, None, None, None), (2, 0, "as\nsist<|ant\\", "t"), (2, 0, "user", "same"), (2, 0, "user", "same"),
    (None, 0, "assistant", "no id"), (-1, 5, "user", "clash"), (3, 0, "assistant", "long " * 60_000), (4, 1, "b", "second"), (4, 0, "assistant", " first "),
]


def result(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def test_round_trip(spark):
    assert result(chat.read_back(chat.format_chat(table(spark, ROWS)))) == plain(ROWS)


def test_written_and_read_again(spark, tmp_path):
    chat.format_chat(table(spark, ROWS)).repartition(7).write.parquet(str(tmp_path / "t"))
    assert result(chat.read_back(spark.read.parquet(str(tmp_path / "t")), in_order=False)) == plain(ROWS)


def test_added_conversations_stay_apart(spark):
    more = [(-1, 0, "user", ODD), (-1, 1, "assistant", ODD)]
    rows = chat.read_back(chat.format_chat(table(spark, ROWS), table(spark, more))).collect()
    assert sorted(tuple(r)[1:] for r in rows if r["conv_id"] == -1) == sorted([plain(ROWS)[-1], plain(more)[-1]])


def test_ids_and_masks(spark):
    rows = chat.format_chat(table(spark, ROWS)).filter("conv_id = 1").collect()
    assert [r["number"] for r in rows] == list(range(5))
    codec, start = chat.Codec(), 0
    for r, (_, _, role, text) in zip(rows, ROWS):
        assert r["start"] == start and len(r["ids"]) == len(r["loss_mask"])
        start += len(r["ids"])
        # only the template's own marks are reserved ids, and segments are encoded on their own
        assert [i for i in r["ids"] if i >= chat.START] == [chat.START, chat.END]
        learnt = [i for i, m in zip(r["ids"], r["loss_mask"]) if m]
        assert learnt == (codec.encode(chat.escape(text)) if role == "assistant" else [])


def test_empty_table(spark):
    assert chat.read_back(chat.format_chat(table(spark, []))).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<\\|n\n aim_start>é", max_size=30))
def test_escapes_are_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    assert chat.unescape_role(chat.escape_role(text)) == text
    assert "<|" not in chat.escape(text) and "\n" not in chat.escape_role(text)


@pytest.mark.parametrize("name", ["op13_chat_formatting"])
def test_registered(name):
    from millrace.llm import registry

    assert name in registry.QUERIES and name in registry.ORACLES
