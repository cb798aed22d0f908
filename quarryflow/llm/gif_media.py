"""Operator 2: GIF media columns: LZW decoding, palettes, disposal, transparency, timed frames, colour histograms.

`decode_gif` reads any GIF87a/GIF89a: it unpacks the LZW codes, looks palettes up, and composes every frame on the
canvas by its transparency index and the disposal method of the frame before. `encode_gif` writes samples of 8 bits
losslessly as the palette indices of frames, so any payload can be stored as a picture and read back.

Code streams are unpacked with array operations: between clear codes the width of the i-th code is a function of i
alone, so thousands of codes are cut out of the bits at once. Every LZW entry equals a stretch of the output (the string
of one code and the first sample after it), so decoding is following references within the output.

Defined results: null text is empty; an empty payload is padded to one block; broken streams raise ValueError in
`decode_gif` and give null media columns with a reason in `error`; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_limits, map_rows

WIDTH, FRAME_ROWS, DELAY_CS = 64, 1024, 10
#: Codes after a clear code until the table of 4096 entries is full.
TABLE_CODES = 3837
HISTOGRAM_BINS = 16


def code_widths(first: int, n: int, root: int) -> np.ndarray:
    """Bits of the codes number first, first + 1, ... after a clear code, for samples of `root` bits."""
    entries = (1 << root) + 2 + np.maximum(np.arange(first, first + n) - 1, 0)
    return np.clip(np.floor(np.log2(entries)).astype(np.int64) + 1, root + 1, 12)


def unpack(bits: np.ndarray, at: int, widths: np.ndarray) -> np.ndarray:
    """Codes that start at bit `at`; bits: bytes with three zeros after the end."""
    starts = at + np.concatenate(([0], np.cumsum(widths[:-1])))
    byte = starts >> 3
    word = bits[byte] | bits[byte + 1].astype(np.int64) << 8 | bits[byte + 2].astype(np.int64) << 16
    return word >> (starts & 7) & ((1 << widths) - 1)


def _expand(codes: np.ndarray, root: int) -> np.ndarray:
    """Samples of the codes between two clear codes. Entry e of the table is the string of code number e and the sample
    after it, so a code for entry e repeats the output from where code e began. Chains of such references are followed
    by pointer doubling, first for the codes' lengths, then for the samples."""
    n, end, every = len(codes), (1 << root) + 1, np.arange(len(codes))
    entry = codes - end - 1
    literal = codes < end - 1
    if (~literal & ((entry < 0) | (entry >= every))).any():
        raise ValueError("a code without an entry")
    to = np.where(literal, every, entry)
    length = (~literal).astype(np.int64)
    at = to
    while not literal[at].all():
        length += length[at]
        at = at[at]
    length += 1
    start = np.cumsum(length) - length
    own = np.arange(int(start[-1] + length[-1]))
    source = own + np.repeat(start[to] - start, length)
    while len(moving := np.flatnonzero(source[source] != source)):
        source[moving] = source[source[moving]]
    out = np.zeros(len(own), np.uint8)
    out[start[literal]] = codes[literal]
    return out[source]


def lzw_decode(data: bytes, root: int, limit: int) -> bytes:
    """Samples of a code stream, at most `limit`. Raises ValueError for a code that no entry can have."""
    clear, end = 1 << root, (1 << root) + 1
    bits, n_bits, at = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.int64), len(data) * 8, 0
    out, made, parts, held = [], 0, [], 0  # parts: the codes since the last clear code
    while at < n_bits and made + held < limit:
        widths = code_widths(held, min(4096, (n_bits - at) // (root + 1) + 1), root)
        ends = at + np.cumsum(widths)
        widths = widths[: int(np.searchsorted(ends, n_bits, side="right"))]
        if not len(widths):
            break
        codes = unpack(bits, at, widths)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        n = int(stops[0]) if len(stops) else len(codes)
        parts.append(codes[:n])
        held += n
        at += int(widths[: n + 1].sum())
        if len(stops):
            if held:
                out.append(_expand(np.concatenate(parts), root))
                made += len(out[-1])
            parts, held = [], 0
            if codes[n] == end:
                break
    if held:
        out.append(_expand(np.concatenate(parts), root))
    return np.concatenate(out)[:limit].tobytes() if out else b""


def lzw_encode(samples: bytes, root: int = 8) -> bytes:
    """Greedy LZW with a clear code whenever the table is full. Codes are held shifted, so that a string and the sample
    after it are one number."""
    clear, end = 1 << root, (1 << root) + 1
    codes, segment, table, spare = [clear << root], [1], {}, end + 1 << root
    get, put, most, step = table.get, codes.append, clear + TABLE_CODES << root, 1 << root
    prefix = samples[0] << root if samples else None
    for c in samples[1:]:
        if found := get(prefix | c):
            prefix = found
            continue
        put(prefix)
        table[prefix | c] = spare
        spare += step
        prefix = c << root
        if spare > most:
            put(clear << root)
            segment.append(len(codes))
            table.clear()
            spare = end + 1 << root
    if prefix is not None:
        put(prefix)
    put(end << root)
    local = np.arange(len(codes)) - np.repeat([0, *segment], np.diff([0, *segment, len(codes)]))
    widths = code_widths(0, int(local.max()) + 1, root)[local]
    widths[0] = root + 1
    packed = np.frombuffer((np.array(codes) >> root).astype("<u2").tobytes(), np.uint8).reshape(-1, 2)
    bits = np.unpackbits(packed, axis=1, bitorder="little")[:, :12]
    return np.packbits(bits[np.arange(12) < widths[:, None]], bitorder="little").tobytes()


@dataclass
class Frame:
    """Samples are the palette indices as stored; canvas is the whole picture after this frame was composed."""

    left: int
    top: int
    width: int
    height: int
    delay_cs: int
    disposal: int
    transparent: int | None
    samples: bytes
    canvas: np.ndarray


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(data):
            raise ValueError("the file ends inside a block")
        n = data[at]
        if not n:
            return b"".join(parts), at + 1
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    n = 2 << (flags & 7)
    if at + 3 * n > len(data):
        raise ValueError("the file ends inside a palette")
    return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n


def _rows(height: int, interlaced: bool) -> np.ndarray:
    if not interlaced:
        return np.arange(height)
    return np.concatenate([np.arange(a, height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode_gif(data: bytes) -> Iterator[Frame]:
    """Frames in order. Disposal 2 clears a frame's area to transparent, 3 brings back what was there before it."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF file")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    common, at = _palette(data, 13, flags)
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, transparent = 0, 0, None
    while at < len(data):
        kind, at = data[at], at + 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at]
            body, at = _blocks(data, at + 1)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, body[1] | body[2] << 8
                transparent = body[3] if body[0] & 1 else None
        elif kind == 0x2C:
            x, y, w, h, flags = struct.unpack_from("<HHHHB", data, at)
            own, at = _palette(data, at + 9, flags)
            palette, root = (common if own is None else own), data[at]
            if palette is None or not 1 < root < 9:
                raise ValueError("no palette" if palette is None else "sample size out of range")
            stream, at = _blocks(data, at + 1)
            samples = lzw_decode(stream, root, w * h)
            if len(samples) < w * h:
                raise ValueError("the code stream ends before its picture")
            index = np.frombuffer(samples, np.uint8).reshape(h, w)
            if index.size and int(index.max()) >= len(palette):
                raise ValueError("an index beyond the palette")
            if flags & 0x40:
                index = index[np.argsort(_rows(h, True))]
            before = canvas.copy() if disposal == 3 else None
            shown = index[: max(0, height - y), : max(0, width - x)]
            area = canvas[y : y + shown.shape[0], x : x + shown.shape[1]]
            full = np.zeros((256, 4), np.uint8)
            full[: len(palette), :3], full[: len(palette), 3] = palette, 255
            if transparent is None:
                area[:] = full[shown]
            else:
                solid = shown != transparent
                area[solid] = full[shown[solid]]
            yield Frame(x, y, w, h, delay, disposal, transparent, samples, canvas.copy())
            if disposal == 2:
                area[:] = 0
            elif disposal == 3:
                canvas = before
            delay, disposal, transparent = 0, 0, None
        else:
            raise ValueError("unknown block")


def encode_gif(payload: bytes, width: int = WIDTH, frame_rows: int = FRAME_ROWS, delay_cs: int = DELAY_CS) -> bytes:
    """A payload whose length is a multiple of width, as frames of at most frame_rows rows. Index i is the grey level i,
    so samples survive both as indices and as colours; a frame's area is cleared before the next one."""
    if not payload or len(payload) % width:
        raise ValueError("the payload must be a positive multiple of the width")
    rows = len(payload) // width
    grey = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, frame_rows), 0xF7, 0, 0), grey]
    for top in range(0, rows, frame_rows):
        h = min(frame_rows, rows - top)
        stream = lzw_encode(payload[top * width : (top + h) * width])
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 2 << 2, delay_cs, 0, 0) + struct.pack("<BHHHHB", 0x2C, 0, 0, width, h, 0) + b"\x08")
        out += [bytes([len(part)]) + part for i in range(0, len(stream), 255) if (part := stream[i : i + 255])]
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


def histogram(canvas: np.ndarray, bins: int = HISTOGRAM_BINS) -> list[int]:
    """Visible pixels by level, for red, green and blue in turn."""
    level = canvas[canvas[..., 3] > 0, :3] // np.uint8(256 // bins) + np.arange(0, 3 * bins, bins, dtype=np.uint8)
    return np.bincount(level.ravel(), minlength=3 * bins).tolist()


#: Frames as stored in a column, in Arrow's and in Spark's words.
FRAME = pa.struct([("frame", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int32()), ("disposal", pa.int32()), ("transparent", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("histogram", pa.list_(pa.int64()))])
FRAMES = "frames array<struct<frame:int,start_ms:long,delay_ms:int,disposal:int,transparent:int,width:int,height:int,histogram:array<long>>>"


def timed_frames(data: bytes) -> Iterator[tuple[Frame, dict]]:
    """Each frame with its row: number, start (the delays before it), delay, disposal, transparency, size, histogram of
    the canvas while it shows."""
    start = 0
    for i, f in enumerate(decode_gif(data)):
        yield f, {"frame": i, "start_ms": start, "delay_ms": 10 * f.delay_cs, "disposal": f.disposal, "transparent": f.transparent, "width": f.width, "height": f.height, "histogram": histogram(f.canvas)}
        start += 10 * f.delay_cs


def media_columns(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """id, frames array<struct>: position, time, size, disposal and colour histogram of every frame of a GIF column, and
    width, height, n_frames, duration_ms, error. Null media: all null; a broken file: error says why."""
    arrow_limits(df.sparkSession)
    kind = df.select(id_col).schema[0].dataType.simpleString()

    def one(data: bytes | None) -> tuple:
        if data is None:
            return None, None, None, None, None, None
        try:
            made = [row for _, row in timed_frames(bytes(data))]
        except (ValueError, IndexError, struct.error) as e:
            return None, None, None, None, None, str(e) or type(e).__name__
        w, h = struct.unpack_from("<HH", data, 6)
        return made, w, h, len(made), sum(f["delay_ms"] for f in made), None

    def run(c: dict[str, list]) -> dict[str, list]:
        names = ("frames", "width", "height", "n_frames", "duration_ms", "error")
        return {id_col: c["id"]} | dict(zip(names, map(list, zip(*map(one, c["media"])))))

    schema = pa.schema([(id_col, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]), ("frames", pa.list_(FRAME)), ("width", pa.int32()), ("height", pa.int32()), ("n_frames", pa.int32()), ("duration_ms", pa.int64()), ("error", pa.string())])
    return map_rows(df.select(id_col, media_col).toDF("id", "media"), run, f"{id_col} {kind}, {FRAMES}, width int, height int, n_frames int, duration_ms long, error string", schema)


def text_payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b"\0")


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media: each whole text stored as a GIF of 8-bit samples."""
    arrow_limits(df.sparkSession)
    kind = df.select(id_col).schema[0].dataType.simpleString()

    def run(c: dict[str, list]) -> dict[str, list]:
        sizes, payloads = zip(*map(text_payload, c["text"]))
        return {id_col: c["id"], "n_bytes": sizes, "media": [encode_gif(p) for p in payloads]}

    schema = pa.schema([(id_col, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]), ("n_bytes", pa.int64()), ("media", pa.binary())])
    return map_rows(df.select(id_col, text_col).toDF("id", "text"), run, f"{id_col} {kind}, n_bytes long, media binary", schema)


def media_digest(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What is read back from the stored media of `text_media`: digests of samples and file, the timed frames with their
    colour histograms, and these summed up as `feature`."""
    arrow_limits(df.sparkSession)
    kind = df.select(id_col).schema[0].dataType.simpleString()

    def one(media: bytes) -> tuple:
        sha, size, tail, frames = hashlib.sha256(), 0, b"", []
        for f, row in timed_frames(media):
            sha.update(f.samples)
            size, tail = size + len(f.samples), f.samples[-64:]
            frames.append(row)
        colours = np.sum([f["histogram"] for f in frames], axis=0).reshape(3, -1)
        shown = ";".join(f"{name}=" + ",".join(map(str, level)) for name, level in zip(("red", "green", "blue"), colours))
        feature = f"frames={len(frames)};ms={sum(f['delay_ms'] for f in frames)};{shown}"
        return size, sha.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature, frames

    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames")
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(FRAME))
    run = lambda c: {id_col: c["id"], "n_bytes": c["n_bytes"]} | dict(zip(names, map(list, zip(*map(one, c["media"])))))
    schema = pa.schema([(id_col, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]), ("n_bytes", pa.int64()), *zip(names, types)])
    return map_rows(df.select(id_col, "n_bytes", "media").toDF("id", "n_bytes", "media"), run, f"{id_col} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, {FRAMES}", schema)
