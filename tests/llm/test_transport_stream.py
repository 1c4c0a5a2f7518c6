import hashlib
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shoebox.llm import common as c
from shoebox.llm.transport_stream import MEDIA, MEDIA_PID, PACKET, STREAM_TYPE, _section, demux, describe, media_round_trip, mux, padded, seek, seek_packet


def test_round_trip(spark, sf):
    docs = c.documents(spark, sf)
    for r in media_round_trip(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        whole = padded(r.text.encode())
        assert r.payload_sha256 == hashlib.sha256(whole).hexdigest() and r.tail_crc32 == zlib.crc32(whole[-64:])
        assert r.n_bytes == len(r.text.encode()) and r.payload_bytes == len(whole) and r.media_sha256 == hashlib.sha256(mux(whole)).hexdigest()
        assert ";gaps=0;bad=0;duplicates=0;" in r.feature


def test_odd_rows(odd_docs, no_docs):
    got = media_round_trip(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert all(r.payload_bytes == 64 and r.n_bytes == 0 for r in got if r.doc_id in (4, 5))
    assert len({tuple(r)[1:] for r in got if r.doc_id in (1, 3)}) == 1
    assert media_round_trip(no_docs).collect() == []


@given(st.binary(max_size=3000), st.integers(1, 700))
def test_any_bytes(payload, unit):
    media = mux(payload, unit)
    s = demux(media)
    assert s.payload == payload and s.gaps == s.bad == 0 and len(media) == PACKET * s.packets
    assert s.stream_pid == MEDIA_PID and s.units == len(s.pts) == len(s.access_points) == -(-len(payload) // unit)
    assert s.pts == sorted(s.pts)


def packets_of(media):
    return [media[i : i + PACKET] for i in range(0, len(media), PACKET)]


def test_faults():
    payload = bytes(range(256)) * 60
    media = mux(payload)
    packets = packets_of(media)
    lost = demux(b"".join(packets[:9] + packets[10:]))
    assert lost.gaps == 1 and lost.bad == 1 and len(lost.payload) == len(payload) - 184  # one unit is shorter than it says
    twice = demux(b"".join(packets[:9] + packets[8:]))
    assert twice.payload == payload and (twice.gaps, twice.bad, twice.duplicates) == (0, 0, 1)
    assert demux(media + b"G123").bad == 1
    assert demux(b"").packets == 0
    damaged = bytearray(media)
    damaged[10] ^= 1  # inside the program association section
    assert demux(bytes(damaged)).stream_pid == -1
    wide = bytearray(media)
    wide[3], wide[4] = 0x30, 255  # an adaptation field longer than its packet
    assert demux(bytes(wide)).stream_pid == -1 and demux(bytes(wide)).bad == 1
    marked = bytearray(media)
    marked[5 * PACKET + 1] |= 0x80  # the error flag
    assert demux(bytes(marked)).bad == 2 and demux(bytes(marked)).gaps == 1
    later = demux(b"".join(packets[:2] + packets[4:]))
    assert later.bad == 1 and later.units == 1  # no unit starts before the second one


def test_tables_over_packets_repeated_and_of_several_streams():
    payload = b"sample" * 3000
    body = (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00"
    streams = [(STREAM_TYPE, MEDIA_PID), *((0x80 + k % 9, 0x200 + k) for k in range(60))]
    for kind, pid in streams:
        body += bytes([kind]) + (0xE000 | pid).to_bytes(2, "big") + b"\xf0\x02\x0a\x00"
    section = _section(2, 1, body)
    assert len(section) > 2 * PACKET
    first, rest = section[:183], section[183:]
    table = [bytes([0x47, 0x50, 0, 0x10, 0]) + first]
    for k in range(0, len(rest), 184):
        table.append((bytes([0x47, 0x10, 0, 0x11 + k // 184]) + rest[k : k + 184]).ljust(PACKET, b"\xff"))
    media = packets_of(mux(payload))
    found = demux(b"".join([media[0], *table, *media[2:9], media[0], *table, *media[9:]]))
    assert found.streams == streams and found.payload == payload and found.gaps == found.bad == 0


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=900), st.lists(st.tuples(st.integers(0, 10**6), st.integers(0, 255)), max_size=25), st.lists(st.tuples(st.sampled_from(["cut", "copy", "swap"]), st.integers(0, 30), st.integers(0, 30)), max_size=4))
def test_damaged_streams_never_raise(noise, bytes_, moves):
    media = packets_of(mux(b"0123456789" * 250, 700))
    for how, i, j in moves:
        i, j = i % len(media), j % len(media)
        if how == "cut" and len(media) > 1:
            del media[i]
        elif how == "copy":
            media.insert(j, media[i])
        else:
            media[i], media[j] = media[j], media[i]
    raw = bytearray(b"".join(media))
    for at, value in bytes_:
        raw[at % len(raw)] = value
    for data in (bytes(raw), noise, bytes(raw) + noise):
        s = demux(data)
        assert s.units >= 0 and s.bad >= 0 and describe(s)
        demux(data, start=3, pid=MEDIA_PID)


def test_seek_over_stored_points(spark, tmp_path):
    media = mux(b"x" * 40_000)
    s = demux(media)
    stamp, packet = s.access_points[3]
    assert seek(s.access_points, stamp) == seek(s.access_points, stamp + 1) == packet and seek(s.access_points, -1) == s.access_points[0][1] and seek([], 5) == 0
    assert s.pts == [90_000 * k for k in range(5)]
    rest = demux(media, start=packet, pid=s.stream_pid)
    assert rest.payload == b"x" * 16_000 and rest.access_points == s.access_points[3:] and rest.gaps == rest.bad == 0
    docs = spark.createDataFrame([(1, "x" * 40_000), (2, None)], "doc_id long, text string")
    path = f"file://{tmp_path}/media"
    media_round_trip(docs, path).collect()
    stored = spark.read.schema(MEDIA).parquet(path)
    for t in (-1, 0, stamp - 1, stamp, 10**9):
        got = {r.doc_id: r for r in stored.select("doc_id", "pts", seek_packet(F.lit(t)).alias("packet")).collect()}
        assert got[1].packet == seek(s.access_points, t) and got[1].pts == s.pts and got[2].packet == 2
