import hashlib
import random

from millrace.llm import common as C
from millrace.llm import fingerprints as P


def _texts(n=400, seed=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    out = [" ".join(r.choice(words) for _ in range(r.randrange(0, 300))) for _ in range(n)]
    out[5], out[6], out[7], out[8] = None, "", "one two", out[4]
    out[9] = "é" * 50_001
    return out


def test_edited_texts_and_likeness(spark, frame):
    texts = _texts()
    ids = random.Random(1).sample(range(-50, 10_000), len(texts))
    rows = {r.doc_id: r for r in P.compare_edited(frame(list(zip(ids, texts))).repartition(5)).collect()}
    order = sorted(zip(ids, texts))
    assert len(rows) == len(ids)
    errors = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = rows[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for other, near in ((edited, r.near_edited), (after, r.near_next)):
            a, b = C.shingle_set(t), C.shingle_set(other)
            exact = len(a & b) / len(a | b) if a | b else 1.0
            errors.append(abs(exact - near))
    assert max(errors) < 0.15 and sum(errors) / len(errors) < 0.03


def test_equal_texts_have_equal_fingerprints_wherever_they_are(spark, frame):
    texts = _texts(100)
    a = {r.doc_id: r.fingerprint for r in P.fingerprint(frame(list(enumerate(texts)))).collect()}
    b = {r.doc_id: r.fingerprint for r in P.fingerprint(frame(list(enumerate(texts))[::-1]).repartition(7)).collect()}
    assert a == b and a[4] == a[8] and a[5] == a[6] == ""
    assert all(len(x) in (0, P.BINS * P.BITS // 4) for x in a.values())


def test_repeated_rows_null_ids_and_empty_tables(spark, frame):
    assert P.compare_edited(frame([])).collect() == []
    got = P.compare_edited(frame([(None, "a b c d e"), (1, "x"), (1, "x"), (1, "y")])).collect()
    assert sorted((r.doc_id is None, r.n_chars) for r in got) == [(False, 1), (False, 1), (False, 1), (True, 9)]
    only = P.compare_edited(frame([(3, "abcd")])).collect()[0]
    assert only.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_an_id_that_many_rows_share_has_ranges_of_its_own(spark, frame):
    r = random.Random(7)
    text = lambda: " ".join(f"w{r.randrange(40)}" for _ in range(r.randrange(12)))
    for common in (None, 50, -(2**63)):
        rows = [(common, text()) for _ in range(200)] + [(i, text()) for i in range(100)] + [(2**63 - 1, text())]
        dealt = P.in_order(C.text_frame(frame(rows)), 16)
        own = dealt.filter("guest = 0")
        sizes = [x["count"] for x in own.groupBy("bucket").count().collect()]
        assert sum(sizes) == len(rows) and max(sizes) < 80
        found = P.compare_edited(frame(rows).repartition(5)).collect()
        assert len(found) == len(rows)
        # a row's edited text ends with the beginning of exactly one other row's text, and every row is followed once
        texts = sorted(((i is not None, i or 0), t) for i, t in rows)
        wanted = sorted((i, len(t)) for (_, i), t in texts)
        assert sorted((x.doc_id or 0, x.n_chars) for x in found) == wanted
    for x in P.compare_edited(frame([(7, "one two three")] * 30)).collect():
        assert x.near_next == 1.0
