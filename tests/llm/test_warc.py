import base64
import gzip
import hashlib
import json
import random

import pytest

from millrace.llm import warc

SCHEMA = "page_id long, url string, html string, shard string"


def _pages(n=300, seed=6):
    r = random.Random(seed)
    bodies = ["", "<p>same</p>" * 50, "é\r\n\r\nWARC/1.1\r\n"] + [f"<html>{r.random()}</html>" * r.randrange(1, 40) for _ in range(60)]
    return [(i * 7 - 100, r.choice([f"http://x/{i}", None, "http://x/a b\nc"]), r.choice([*bodies, None]), "s") for i in range(n)] + [(10**12, "http://far", "y" * 500_000, "s")]


def _expected(rows):
    winner = {}
    for i, _, h, _ in rows:
        winner[h or ""] = max(winner.get(h or "", i), i)
    return {i: (len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if winner[h or ""] == i else "revisit", None if winner[h or ""] == i else winner[h or ""]) for i, _, h, _ in rows}


def test_round_trip_over_shards_and_rolled_files(spark, tmp_path):
    rows = _pages()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    done = warc.write(df, str(tmp_path / "a"), shard_bytes=60_000, roll_bytes=4_000)
    manifest = warc.manifest(spark, str(tmp_path / "a"))[0].collect()
    assert done == {"shards": len({f["shard"] for f in manifest}), "files": len(manifest), "records": len(rows)}
    assert len({f["shard"] for f in manifest}) > 3 and len(manifest) > len({f["shard"] for f in manifest})
    assert sum(f["records"] for f in manifest) == len(rows)
    got = {r.page_id: r for r in warc.read(spark, str(tmp_path / "a"), payloads=True).collect()}
    assert {i: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for i, r in got.items()} == _expected(rows)
    bodies = {i: (h or "").encode() for i, _, h, _ in rows}
    assert all(bytes(r.payload) == bodies[i] for i, r in got.items() if r.record_type == "response")


def test_files_do_not_depend_on_the_partitions(spark, tmp_path):
    rows = _pages(120)
    for name, parts in (("a", 2), ("b", 9)):
        warc.write(spark.createDataFrame(rows, SCHEMA).repartition(parts), str(tmp_path / name), shard_bytes=50_000, roll_bytes=9_000)
    a, b = ({p.name: p.read_bytes() for p in (tmp_path / x).rglob("*") if p.is_file() and not p.name.startswith(".")} for x in "ab")
    assert a == b and warc.MANIFEST in a
    previous = -(10**9)
    files = [json.loads(x) for name in sorted(a) if name.endswith(".json") and name != warc.MANIFEST for x in a[name].splitlines()]
    assert len(files) == json.loads(a[warc.MANIFEST])["files"]
    for f in files:
        ids = [int(x.split(b": ")[1]) for x in gzip.decompress(a[f["file"]]).split(b"\r\n") if x.startswith(b"Page-ID: ")]
        assert ids == sorted(ids) and ids[0] > previous and hashlib.sha256(a[f["file"]]).hexdigest() == f["sha256"]
        previous = ids[-1]


def test_damage_is_told(spark, tmp_path):
    warc.write(spark.createDataFrame(_pages(30), SCHEMA), str(tmp_path / "a"))
    with pytest.raises(FileExistsError):
        warc.write(spark.createDataFrame(_pages(30), SCHEMA), str(tmp_path / "a"))
    path = tmp_path / "a" / warc.manifest(spark, str(tmp_path / "a"))[0].first()["file"]
    data = gzip.decompress(path.read_bytes()).replace(b"<p>same</p>", b"<p>sAme</p>", 1)
    path.write_bytes(gzip.compress(data))
    with pytest.raises(Exception, match="digest|bytes|record"):
        warc.read(spark, str(tmp_path / "a")).collect()


def test_repeated_rows_null_ids_and_empty_tables(spark, tmp_path):
    rows = [(1, "u", "a", "s"), (1, "u", "a", "s"), (None, "u", "a", "s"), (None, "u", "only", "s"), (2, None, None, "s")]
    warc.write(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "a"))
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in warc.read(spark, str(tmp_path / "a")).collect())
    assert got == [(0, 1, "revisit", 1), (0, 4, "response", 0), (1, 1, "response", 0), (1, 1, "revisit", 1), (2, 0, "response", 0)]
    assert warc.write(spark.createDataFrame([], SCHEMA), str(tmp_path / "b")) == {"shards": 0, "files": 0, "records": 0}
    assert warc.read(spark, str(tmp_path / "b")).collect() == []


def test_any_long_is_a_page_id(spark, tmp_path):
    r = random.Random(4)
    top, low = 2**63 - 1, -(2**63)
    ids = [top - 3 * k for k in range(40)] + [low + k for k in range(40)] + [2**53 + k for k in range(20)] + [0, -1, 1]
    rows = [(i, "u", r.choice(["a", "b", "c" * 900, str(i) * 40]), "s") for i in ids] + [(top - 1, None, "z" * 2_000_000, "s")]
    warc.write(spark.createDataFrame(rows, SCHEMA).repartition(4), str(tmp_path / "a"), shard_bytes=8_000)
    files, shards = warc.manifest(spark, str(tmp_path / "a"))
    assert shards > 5 and files.agg({"records": "sum"}).first()[0] == len(rows)
    got = {x.page_id: (x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in warc.read(spark, str(tmp_path / "a")).collect()}
    assert got == _expected(rows)
