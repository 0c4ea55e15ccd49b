import hashlib
import random
from collections import defaultdict

from millrace.llm import exact_dedup, line_dedup


def test_exact_dedup_keeps_the_largest_id_of_each_text(spark, frame):
    r = random.Random(4)
    texts = ["hot copy"] * 400 + [None, "", " "] + [f"text {r.randrange(200)}" for _ in range(600)]
    r.shuffle(texts)
    for counters in (1000, 3):  # with 3, only the hot text is frequent
        rows = {x.doc_id: x for x in exact_dedup.decide(frame(list(enumerate(texts))).repartition(6), counters).collect()}
        groups = defaultdict(list)
        for i, t in enumerate(texts):
            groups[t or ""].append(i)
        assert len(rows) == len(texts)
        for t, ids in groups.items():
            for i in ids:
                assert (rows[i].keep_id, rows[i].group_size, rows[i].kept, rows[i].text_sha256) == (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())


def test_copies_go_whatever_their_number(spark, frame, monkeypatch):
    from millrace.llm import common as C

    r = random.Random(6)
    texts = ["hot copy"] * 300 + ["warm"] * 30 + [None, ""] + [f"text {r.randrange(200)}" for _ in range(400)]
    rows = list(enumerate(texts)) + [(3, "hot copy"), (3, "warm"), (3, "warm"), (299, "hot copy"), (5000, "x"), (5000, "x"), (None, "warm"), (None, "w"), (None, "w")]
    last = {}
    for i, t in rows:
        last[t or ""] = max(last.get(t or "", -1), -1 if i is None else i)
    df = frame(rows).withColumnRenamed("score", "_digest").withColumnRenamed("bucket", "_keep").repartition(5)
    for most in (32 << 20, 0):  # broadcast, and shuffled
        monkeypatch.setattr(C, "few", lambda frame, size, most=most: most > 0)
        for counters in (1000, 3):
            out = exact_dedup.drop_copies(df, counters)
            assert out.columns == df.columns
            assert sorted((x.text or "", -1 if x.doc_id is None else x.doc_id) for x in out.collect()) == sorted(last.items())


def test_misra_gries_finds_every_frequent_digest(spark):
    from pyspark.sql import functions as F

    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.col("id").alias("row"), F.when(F.col("id") % 7 == 0, F.lit("a")).when(F.col("id") % 11 == 0, F.lit("b")).otherwise(F.col("id").cast("string")).alias("digest"))
    assert sorted(x.digest for x in exact_dedup.heavy(df, 20).collect()) == ["a", "b"]


def test_exact_dedup_of_repeated_rows_and_null_ids(spark, frame):
    df = frame([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (2, "c"), (2, "d")])
    rows = exact_dedup.decide(df).collect()
    assert sum(x.kept for x in rows if x.group_size == 3) == 1 and len(rows) == 6
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns
    assert sorted((x.doc_id or 0, x.text) for x in kept.collect()) == [(0, "b"), (1, "a"), (2, "c"), (2, "d")]
    assert exact_dedup.decide(frame([])).collect() == [] and exact_dedup.drop_copies(frame([])).collect() == []


def _plain(rows, least=20, documents=3):
    strip = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            held[strip(x)].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(strip(x)) < least or len(held[strip(x)]) < documents or i == max(held[strip(x)])]
        out[i] = (len(lines), len(lines) - len(stay), "\n".join(stay))
    return out


def test_line_dedup_agrees_with_a_plain_version(spark, frame, monkeypatch):
    r = random.Random(8)
    long = ["  Shared line number %d of many \t" % k for k in range(15)] + ["SHARED LINE NUMBER 3 OF MANY", "short", "", "é" * 19 + "X", "é" * 20]
    rows = [(i, "\n".join(r.choice(long) for _ in range(r.randrange(0, 9))) + r.choice(["", "\n", f"\nonly here {i} and nowhere else"])) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "\n\n"), (1003, (long[0] + "\n") * 3000)]
    got = {x.doc_id: (x.n_lines, x.n_dropped, x.text) for x in line_dedup.drop_lines(frame(rows)).collect()}
    assert got == _plain(rows)
    from millrace.llm import common as C

    monkeypatch.setattr(C, "few", lambda frame, size: False)
    monkeypatch.setattr(line_dedup, "COMMON", 10)  # some lines are broadcast and some are dealt
    assert {x.doc_id: (x.n_lines, x.n_dropped, x.text) for x in line_dedup.drop_lines(frame(rows)).collect()} == got
    assert line_dedup.drop_lines(frame([])).collect() == []


def test_line_dedup_of_repeated_rows(spark, frame):
    line = "a line of more than twenty characters"
    rows = line_dedup.drop_lines(frame([(1, line), (1, line), (2, line + "\nx"), (None, line), (None, line)])).collect()
    assert sorted((x.doc_id or 0, x.n_lines) for x in rows) == [(0, 1), (0, 1), (1, 1), (1, 1), (2, 2)]
    assert all(x.n_dropped == 0 for x in rows)  # two documents only
    rows = line_dedup.drop_lines(frame([(1, line), (1, line), (2, line), (3, line), (3, "z\n" + line)])).collect()
    assert sorted((x.doc_id, x.text) for x in rows) == [(1, ""), (1, ""), (2, ""), (3, line), (3, "z\n" + line)]


def test_exact_dedup_of_very_long_texts(spark, frame):
    long = "so very long " * 200_000
    rows = {x.doc_id: x for x in exact_dedup.decide(frame([(1, long), (2, long + "."), (3, long), (4, "short")])).collect()}
    assert [(i, rows[i].keep_id, rows[i].group_size) for i in sorted(rows)] == [(1, 3, 2), (2, 2, 1), (3, 3, 2), (4, 4, 1)]
    assert rows[2].text_sha256 == hashlib.sha256((long + ".").encode()).hexdigest()
