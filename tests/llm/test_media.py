import hashlib
import zlib

import numpy as np
import pytest
from spanloom.llm import media as M


def test_png_round_trip():
    r = np.random.default_rng(0)
    for n in (0, 1, 63, 64, 65, 128, 5000):
        text = r.integers(0, 256, n, dtype=np.uint8).tobytes()
        p = M.payload_of(text)
        assert len(p) % 64 == 0 and len(p) >= 64 and len(p) - n < 64 + (n == 0) and p.startswith(text) and not any(p[n:])
        assert M.from_png(M.to_png(p)).tobytes() == p
    png = bytearray(M.to_png(bytes(64)))
    png[45] ^= 1
    with pytest.raises(ValueError):
        M.from_png(bytes(png))


def test_parse_keeps_order_and_captions():
    page = """<p>One &amp; two</p><figure><img src="sha256:aa" data-bytes="5"><figcaption>First <b>cap</b></figcaption></figure>
    <!-- no --><p>mid</p><img src="x.png" alt="alt text">tail<figure><img src='sha256:bb'><img src='sha256:cc'><figcaption>Both</figcaption></figure>"""
    got = [(p["pos"], p["kind"], p["text"] or p["digest"], p["caption"]) for p in M.parse(page)]
    assert got == [(0, "text", "One & two", None), (1, "media", "aa", "First cap"), (2, "text", "mid", None), (3, "media", None, "alt text"), (4, "text", "tail", None), (5, "media", "bb", "Both"), (6, "media", "cc", "Both")]
    for odd in (None, "", "<", "<img", "<figure>", "</figure></p>", "<figcaption>x"):
        assert isinstance(M.parse(odd), list)


def test_frame_against_brute_force(spark):
    rows = [(1, "héllo"), (2, None), (3, ""), (4, "x" * 64), (5, "y" * 300_000), (6, "héllo"), (6, "héllo"), (None, "z")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, digest string").repartition(3)
    got = M.document_media(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        raw = (t or "").encode()
        p = raw + bytes((64 - len(raw) % 64) % 64 or (0 if raw else 64))
        r = by[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r.media_sha256 == hashlib.sha256(M.to_png(p)).hexdigest() and r.position == 1 and r.caption == f"Text of document {i}"
    assert by[1].feature == by[6].feature and by[2].feature == by[3].feature
    assert M.document_media(df.limit(0)).count() == 0


def test_interleave_restores_places(spark):
    docs = spark.createDataFrame([(1, "one"), (2, "two")], "doc_id long, text string")
    media = M.read_back(M.store(docs))
    d = [hashlib.sha256(M.payload_of(t)).hexdigest() for t in (b"one", b"two")]
    pages = spark.createDataFrame([(1, f"<p>a</p><img src='sha256:{d[1]}'><p>b</p><img src='sha256:{d[0]}'><img src='sha256:none'>"), (2, ""), (3, None)], "id long, html string")
    got = {r.id: r.seq for r in M.interleave(M.sequences(pages, "id"), media, "id").collect()}
    assert [p.piece.kind for p in got[1]] == ["text", "media", "text", "media", "media"]
    assert got[1][1].medium.payload_sha256 == d[1] and got[1][3].medium.payload_sha256 == d[0] and got[1][4].medium is None or got[1][4].medium.feature is None
    assert got[2] == [] and got[3] == []
