import hashlib
import random
import zlib

import pytest

from leafmill.llm import media as m


def test_vint_widths():
    for n in (0, 126, 127, 16382, 16383, 1 << 20, (1 << 28) - 2, (1 << 28) - 1, (1 << 56) - 2):
        made = m.size_bytes(n)
        assert m._vint(made, 0)[:2] == (n, len(made)) and not m._vint(made, 0)[2]
    assert m._vint(b"\xff", 0)[2] and m._vint(m.id_bytes(m.EBML), 0, keep=True)[0] == m.EBML
    for bad in (b"\0", b"\x40"):
        with pytest.raises((ValueError, IndexError)):
            m._vint(bad, 0)


@pytest.mark.parametrize("lacing", [0, 1, 2, 3])
def test_lacing(lacing):
    rng = random.Random(lacing)
    for _ in range(200):
        n = 1 if lacing == 0 else rng.randint(1, 12)
        size = rng.choice([0, 1, 254, 255, 256, 510, 3000])
        frames = [rng.randbytes(size if lacing == 2 else rng.choice([0, 3, 254, 255, 256, 510, 700, 20000])) for _ in range(n)]
        track = rng.choice([1, 126, 127, 300])
        body = m.block(track, -5, frames, lacing, key=False)
        at = len(m.size_bytes(track)) + 3
        assert [body[a : a + k] for a, k in m._frames(body, at, len(body), lacing)] == frames


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 576 * 16, 576 * 16 + 1, 576 * 256, 576 * 256 + 7, 700_000])
def test_round_trip(n):
    raw = random.Random(n).randbytes(n)
    for payload in (raw + b"\xff" * (-n % 576), raw):
        found = m.parse(data := m.mux(payload))
        assert b"".join(data[p.start : p.start + p.length] for p in found) == payload
        assert [p.timestamp_ns for p in found] == [72_000_000 * i for i in range(len(found))]
        assert all(p.cued and p.track == 1 and p.key for p in found)


def test_other_layouts():
    """Block groups, unknown sizes, several tracks, other scales, and elements that are passed over."""
    track = lambda n, d: m.element(m.TRACK_ENTRY, m.unsigned(m.TRACK_NUMBER, n) + m.unsigned(m.DEFAULT_DURATION, d))
    first = m.unsigned(m.TIMESTAMP, 10) + m.element(0xEC, b"void") + m.element(m.SIMPLE_BLOCK, m.block(1, 2, [b"a", b"bc"], 1))
    second = m.unsigned(m.TIMESTAMP, 20) + m.element(m.BLOCK_GROUP, m.element(m.BLOCK, m.block(2, -3, [b"xyz"])) + m.element(m.REFERENCE_BLOCK, b"\xff"))
    body = m.element(m.INFO, m.unsigned(m.TIMESTAMP_SCALE, 500_000)) + m.element(m.TRACKS, track(1, 7) + track(2, 9))
    body += m.id_bytes(m.CLUSTER) + b"\xff" + first + m.element(m.CLUSTER, second)
    data = m.id_bytes(m.SEGMENT) + b"\x01" + b"\xff" * 7 + body
    found = m.parse(data)
    assert [(p.track, p.timestamp_ns, data[p.start : p.start + p.length], p.key, p.cued) for p in found] == [(1, 6_000_000, b"a", True, False), (1, 6_000_007, b"bc", True, False), (2, 8_500_000, b"xyz", False, False)]


def test_tables(spark, edge):
    files = m.to_media(edge)
    broken = files.limit(1).selectExpr("cast(-99 as bigint) as doc_id", "substring(media, 1, 80) as media").union(spark.createDataFrame([(-98, None)], "doc_id long, media binary"))
    table = m.packets(files.unionByName(broken))
    assert table.where("doc_id = -99").select("error").first()[0] and table.where("doc_id = -98").count() == 0
    sizes = {r.doc_id: r.n for r in table.where("doc_id in (4, 6)").groupBy("doc_id").agg({"length": "sum"}).toDF("doc_id", "n").collect()}
    assert sizes[6] == -(-200_000 // 576) * 576
    want = []
    for r in edge.collect():
        p = m.payload_of(r.text or "")
        want.append((len((r.text or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m.mux(p))))
    got = [(r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes) for r in m.digest(edge).collect()]
    assert sorted(got) == sorted(want) and m.digest(edge.limit(0)).count() == 0
    same = m.digest(edge.where("doc_id = 5")).drop("doc_id").distinct().count()
    assert same == 1 and m.feature(b"\x80" * 576, m.parse(m.mux(b"\x80" * 576))).endswith("energy=0;crossings=0")
