import gzip
import hashlib
import json
import random
import zlib

from tidemark.llm import warc


def rows():
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("abcé <>\r\n") for _ in range(rnd.choice([0, 20, 99, 150, 3000]))) for _ in range(60)]
    out = [(i, f"http://h/{i} ü\r\nx", t) for i, t in enumerate(texts)]
    out += [(100 + i, None, texts[i % 7]) for i in range(200)]
    return out + [(300, "u", None), (300, "u", None), (0, "again", texts[0]), (None, None, texts[3]),
                  (None, "n", "only null ids " * 20), (None, "n", "only null ids " * 20),
                  (400, "long", "word " * 400_000), (401, "long", "word " * 400_000)]


def test_round_trip(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    data = rows()
    df = spark.createDataFrame([(*r, "x") for r in data], "page_id long, url string, html string, digest string")
    got = sorted(((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                  for r in warc.round_trip(spark, df.repartition(3), f"file://{tmp_path}/w").collect()), key=str)
    payloads = [(p, (h or "").encode()) for p, _, h in data]
    first = {}
    for p, b in payloads:
        if len(b) >= 100 and p is not None:
            first[b] = min(p, first.get(b, p))
    want = []
    for p, b in payloads:
        other = first.get(b) if len(b) >= 100 else None
        again = other is not None and other != p
        want.append((p is None, p or 0, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response",
                     other if again else None))
    assert got == sorted(want, key=str)


def test_members_stand_alone_and_monolith_is_one_stream(spark, tmp_path):
    df = spark.createDataFrame(rows()[:50], "page_id long, url string, html string").coalesce(1)
    root = str(tmp_path / "w")
    manifest = warc.write(df, root)
    listing = warc.normalise(manifest, root)
    name = manifest.first().archive
    whole = open(f"{root}/{name}", "rb").read()
    d = zlib.decompressobj(warc.GZIP)
    text = d.decompress(whole)
    assert d.eof and not d.unused_data and text.count(b"WARC/1.1\r\n") == 50
    entry = listing.first()
    data = open(f"{root}/{entry.warc}", "rb").read()
    index = [json.loads(x) for x in open(f"{root}/{entry['index']}")]
    assert len(index) == entry.records == 50 and sum(e["length"] for e in index) == len(data)
    for e in reversed(index):
        assert gzip.decompress(data[e["offset"]:e["offset"] + e["length"]]).startswith(b"WARC/1.1\r\nWARC-Type: " + e["type"].encode())
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 50


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(spark, df, str(tmp_path / "w")).count() == 0


def test_later_members_are_read_and_broken_ones_are_errors():
    import io

    import pytest
    body = b"".join(b"line %d\n" % k for k in range(5000))
    parts = gzip.compress(body[:20_000]) + b"\0" * 600_000 + gzip.compress(body[20_000:]) + b"\0" * 7
    lines, s = [], warc.Inflated(io.BytesIO(parts))
    while (line := s.until(b"\n")) is not None:
        lines.append(line)
    assert b"\n".join(lines) + b"\n" == body
    assert warc.Inflated(io.BytesIO(b"")).until(b"x") is None
    with pytest.raises(EOFError):
        warc.Inflated(io.BytesIO(gzip.compress(body)[:-9])).until(b"nowhere")
