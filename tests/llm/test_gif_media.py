import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest

from quarryflow.llm import gif_media as G


def test_any_payload_survives():
    rnd = random.Random(3)
    for n in (1, 2, 100, 2000):
        data = bytes(rnd.choice((7, 8, rnd.randrange(256))) for _ in range(64 * n))
        frames = list(G.decode_gif(G.encode_gif(data, 64, 300)))
        assert b"".join(f.samples for f in frames) == data and len(frames) == -(-n // 300)
        assert all((f.canvas[: f.height, :, 0].tobytes() == f.samples) for f in frames)


def _image(x, y, w, h, samples, flags=0, palette=b"", root=2):
    stream = G.lzw_encode(bytes(samples), root)
    return struct.pack("<BHHHHB", 0x2C, x, y, w, h, flags) + palette + bytes([root, len(stream)]) + stream + b"\0"


def _control(disposal, delay, transparent=None):
    return struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (transparent is not None), delay, transparent or 0, 0)


def test_disposal_transparency_palettes_interlace():
    head = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x81, 0, 0) + bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    data = head + b"\x21\xfe\x02hi\x00" + _control(1, 5) + _image(0, 0, 2, 2, [1, 1, 1, 1]) + _control(2, 6, 0) + _image(0, 0, 1, 2, [2, 0]) + _control(3, 7) + _image(1, 1, 1, 1, [3]) + _image(0, 0, 2, 2, [0, 1, 1, 0], 0x80 | 0x40, bytes([9, 9, 9, 8, 8, 8])) + b"\x3b"
    a, b, c, d = G.decode_gif(data)
    assert (a.delay_cs, b.disposal, b.transparent, c.delay_cs) == (5, 2, 0, 7)
    assert b.canvas[0, 0].tolist() == [0, 255, 0, 255] and b.canvas[1, 0].tolist() == [255, 0, 0, 255]  # index 0 is seen through
    assert c.canvas[0, 0].tolist() == [0, 0, 0, 0] and c.canvas[1, 1].tolist() == [0, 0, 255, 255]  # cleared; drawn
    assert d.canvas[:, :, 0].tolist() == [[9, 8], [8, 9]] and d.delay_cs == 0
    assert sum(G.histogram(c.canvas)[:16]) == 2


def test_broken_files_are_reported(spark):
    good = G.encode_gif(bytes(range(64)))
    rows = [(1, good), (2, None), (3, b""), (4, good[:830]), (5, b"PNG"), (6, good[:-1])]
    got = {r["doc_id"]: r for r in G.media_columns(spark.createDataFrame(rows, "doc_id long, m binary"), "doc_id", "m").collect()}
    assert got[1]["n_frames"] == 1 and got[1]["frames"][0]["delay_ms"] == 100 and sum(got[1]["frames"][0]["histogram"]) == 3 * 64
    assert got[2]["error"] is None and got[2]["frames"] is None and all(got[k]["error"] for k in (3, 4, 5)) and got[6]["n_frames"] == 1
    with pytest.raises(ValueError):
        G.lzw_decode(bytes([0xFF, 0xFF, 0xFF]), 8, 10)


def test_short_streams_and_strange_indices_are_errors():
    short = struct.pack("<BHHHHB", 0x2C, 0, 0, 16, 16, 0) + b"\x08" + bytes([len(s := G.lzw_encode(bytes(10)))]) + s + b"\0\x3b"
    with pytest.raises(ValueError, match="ends before"):
        list(G.decode_gif(G.encode_gif(bytes(64))[: 13 + 768] + short))
    head = b"GIF89a" + struct.pack("<HHBBB", 2, 1, 0x80, 0, 0) + bytes(6)
    with pytest.raises(ValueError, match="palette"):
        list(G.decode_gif(head + _image(0, 0, 2, 1, [1, 3]) + b"\x3b"))


def _plain_decode(data, root, limit):
    """The textbook decoder, a code at a time."""
    clear, width, value, bits, out, table, last = 1 << root, root + 1, 0, 0, [], {}, None
    for byte in data:
        value, bits = value | byte << bits, bits + 8
        while bits >= width:
            code, value, bits = value & ((1 << width) - 1), value >> width, bits - width
            if code == clear:
                table, last, width = {i: [i] for i in range(clear)} | {clear: [], clear + 1: []}, None, root + 1
                continue
            if code == clear + 1:
                return bytes(out[:limit])
            s = table.get(code) or last + last[:1]
            if last is not None and len(table) < 4096:
                table[len(table)] = last + s[:1]
            out, last = out + s, s
            width = min(12, max(root + 1, len(table).bit_length()))
    return bytes(out[:limit])


def test_codes_are_read_as_the_textbook_does():
    rnd = random.Random(8)
    for root, n in ((2, 50), (3, 900), (8, 1), (8, 9000), (5, 7000)):
        samples = bytes(rnd.choice((0, 1, rnd.randrange(1 << root))) for _ in range(n))
        data = G.lzw_encode(samples, root)
        assert G.lzw_decode(data, root, n) == samples == _plain_decode(data, root, n)


def test_query_columns(corpus, nothing):
    rows = {(r["doc_id"], r["text"]) for r in corpus.collect()}
    got = {(r["doc_id"], r["payload_sha256"]): r for r in G.media_digest(G.text_media(corpus)).collect()}
    for i, text in rows:
        raw = (text or "").encode()
        data = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        r = got[(i, hashlib.sha256(data).hexdigest())]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(raw), len(data), zlib.crc32(data[-64:]))
        assert all(sum(map(int, part.split(","))) == len(data) and part.count(",") == 15 for part in re.findall("(?:red|green|blue)=([0-9,]+)", r["feature"]))
        times = [(f["start_ms"], f["delay_ms"], f["frame"]) for f in r["frames"]]
        assert times == [(100 * i, 100, i) for i in range(-(-len(data) // 65536))] and f"frames={len(times)};ms={100 * len(times)};" in r["feature"]
        assert sum(sum(f["histogram"]) for f in r["frames"]) == 3 * len(data)
    assert G.media_digest(G.text_media(nothing)).count() == 0


def test_widths_follow_the_table():
    assert G.code_widths(0, 300, 8)[[0, 1, 254, 255, 256]].tolist() == [9, 9, 9, 10, 10] and int(G.code_widths(3000, 1, 8)[0]) == 12
    assert np.all(np.diff(G.code_widths(0, 4200, 2)) >= 0)
