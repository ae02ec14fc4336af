"""Media columns: payloads in AVI motion-JPEG, and timed clips by shot detection.

``encode`` stores bytes without loss as the quantised coefficients of baseline
JPEG frames, 64 bytes for each block of 8 x 8 samples, in zigzag order; byte
``b`` is the coefficient ``b - 128``, or ``b - 127`` from 128 on, so none is
zero.  The frames carry Huffman tables in which a coefficient's code and its
magnitude bits are nine bits together, and a restart marker after every block,
so a block is 72 bytes and coding is array arithmetic.  These are ordinary
tables and markers: any baseline decoder reads the frames.

``decode`` parses the RIFF chunks, follows the index to the frames and decodes
them.  Frames with those tables are decoded as arrays; all other baseline
frames (any tables, sampling factors and restart intervals) bit by bit.
The inverse transform uses integer coefficients, so samples do not depend on
the machine.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Blocks in a row of a frame, rows of a frame, frames a second.
ACROSS, DOWN, FPS = 16, 4, 25
BINS = 16
#: Samples that are decoded at a time.
SAMPLED = 1 << 20
UNIT = 64
_SCALE = 12

#: Fixed by the JPEG standard: the order in which coefficients are coded.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))


def _transform() -> np.ndarray:
    """Row k: what coefficient k of the zigzag order adds to the 64 samples, in units of 2^-12."""
    k, x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    one = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(0.5), 1) / 2
    return np.rint(np.kron(one, one)[ZIGZAG] * (1 << _SCALE))


_BASIS = _transform()


def samples(coefficients: np.ndarray) -> np.ndarray:
    """``(n, 64)`` dequantised coefficients in zigzag order -> ``(n, 64)`` samples 0 to 255.

    The products are of integers and their sums below 2^53, hence exact.
    """
    total = coefficients.astype(np.float64) @ _BASIS
    return np.clip(np.floor((total + (1 << (_SCALE - 1))) / (1 << _SCALE)) + 128, 0, 255).astype(np.uint8)


def _words() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte -> its nine bits, nine bits -> byte, byte -> coefficient."""
    code, back = np.zeros(256, np.uint16), np.zeros(512, np.uint8)
    value = np.where(np.arange(256) < 128, np.arange(256) - 128, np.arange(256) - 127)
    for b, v in enumerate(value.tolist()):
        size = abs(v).bit_length()
        code[b] = (((1 << (9 - size)) - 2) << size) | (v if v > 0 else v + (1 << size) - 1)
        back[code[b]] = b
    return code, back, value.astype(np.int16)


_CODE, _BACK, _VALUE = _words()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_TABLE = bytes([1] * 8 + [0] * 8) + bytes(range(8, 0, -1))
_HEAD = b"\xff\xd8" + _segment(0xDB, b"\0" + b"\1" * 64)
_TABLES = (
    _segment(0xC4, b"\x00" + _TABLE)
    + _segment(0xC4, b"\x10" + _TABLE)
    + _segment(0xDD, b"\0\1")
    + _segment(0xDA, b"\1\1\0\0\x3f\0")
)


def encode_frame(blocks: np.ndarray, across: int) -> bytes:
    """``(n, 64)`` bytes -> a baseline JPEG of ``across`` blocks a row."""
    n = len(blocks)
    w = _CODE[blocks].reshape(-1, 8)
    out = np.empty((n * 8, 9), np.uint8)
    out[:, 0] = w[:, 0] >> 1
    for j in range(1, 8):
        out[:, j] = ((w[:, j - 1] & ((1 << j) - 1)) << (8 - j)) | (w[:, j] >> (j + 1))
    out[:, 8] = w[:, 7] & 0xFF
    rows = np.empty((n, 74), np.uint8)
    rows[:, :72] = out.reshape(n, 72)
    rows[:, 72] = 0xFF
    rows[:, 73] = 0xD0 + np.arange(n) % 8
    rows[-1, 73] = 0xD9
    full = rows == 0xFF
    full[:, 72:] = False
    scan = rows.reshape(-1)
    at = np.flatnonzero(full.reshape(-1))
    if len(at):
        scan = np.insert(scan, at + 1, 0)
    frame = _segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * (n // across), 8 * across, 1, 1, 0x11, 0))
    return _HEAD + frame + _TABLES + scan.tobytes()


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def encode(payload: bytes, fps: int = FPS) -> bytes:
    """Bytes, a positive multiple of 64 of them, as an AVI file of motion-JPEG frames."""
    if not payload or len(payload) % UNIT:
        raise ValueError("a payload is a positive multiple of 64 bytes")
    blocks = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    across = min(len(blocks), ACROSS)
    rows = -(-len(blocks) // across)
    number = -(-rows // DOWN)
    down = -(-rows // number)
    each = across * down
    if len(blocks) < each * number:
        blocks = np.concatenate((blocks, np.zeros((each * number - len(blocks), UNIT), np.uint8)))
    frames = [encode_frame(blocks[i * each : (i + 1) * each], across) for i in range(number)]
    w, h, largest = 8 * across, 8 * down, max(map(len, frames))
    main = struct.pack("<14I", 10**6 // fps, largest * fps, 0, 0x10, number, 0, 1, largest, w, h, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, number, largest, 0xFFFFFFFF, 0, 0, 0, w, h)
    image = struct.pack("<IiiHH4sIiiII", 40, w, h, 1, 24, b"MJPG", w * h * 3, 0, 0, 0, 0)
    header = b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", image))
    info = b"INFO" + _chunk(b"ICMT", b"payload=%d\0" % len(payload))
    movie, index = [b"movi"], []
    at = 4
    for f in frames:
        c = _chunk(b"00dc", f)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movie.append(c)
        at += len(c)
    body = b"AVI " + _chunk(b"LIST", header) + _chunk(b"LIST", info) + _chunk(b"LIST", b"".join(movie)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


@dataclass
class Video:
    """What ``parse`` finds: the frames' bytes in order, the frame rate, the payload's length if noted."""

    frames: list[bytes] = field(default_factory=list)
    fps: float = FPS
    payload: int | None = None


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        yield name, at + 8, min(at + 8 + size, end)
        at += 8 + size + size % 2


def parse(data: bytes) -> Video:
    """Parse RIFF: headers, the frames by the index, or by their chunks if there is no index."""
    out = Video()
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movie = index = None
    todo = [(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))]
    while todo:
        for name, a, b in _chunks(data, *todo.pop()):
            if name == b"LIST" and data[a : a + 4] == b"movi":
                movie = (a, b)
            elif name == b"LIST":
                todo.append((a + 4, b))
            elif name == b"avih":
                micro = struct.unpack_from("<I", data, a)[0]
                out.fps = 1e6 / micro if micro else FPS
            elif name == b"ICMT" and data[a : a + 8] == b"payload=":
                out.payload = int(data[a + 8 : b].rstrip(b"\0"))
            elif name == b"idx1":
                index = (a, b)
    if movie and index:
        entries = [struct.unpack_from("<4sIII", data, i) for i in range(index[0], index[1] - 15, 16)]
        entries = [e for e in entries if e[0][2:] in (b"dc", b"db")]
        # Offsets count from the list's name, or in some files from the file's start.
        base = movie[0] if entries and data[movie[0] + entries[0][2] : movie[0] + entries[0][2] + 4] == entries[0][0] else 0
        out.frames = [data[base + o + 8 : base + o + 8 + size] for _, _, o, size in entries]
    elif movie:
        out.frames = [data[a:b] for n, a, b in _chunks(data, movie[0] + 4, movie[1]) if n[2:] in (b"dc", b"db")]
    return out


def _fast(frame: bytes) -> tuple[np.ndarray, int] | None:
    """The blocks' bytes and blocks in a row, if the frame has the tables of ``encode_frame``."""
    n, tables = len(_HEAD), len(_HEAD) + 13
    if frame[:n] != _HEAD or frame[tables : tables + len(_TABLES)] != _TABLES or frame[n : n + 2] != b"\xff\xc0":
        return None
    h, w = struct.unpack_from(">HH", frame, n + 5)
    scan = np.frombuffer(frame, np.uint8)[tables + len(_TABLES) :]
    stuffed = np.flatnonzero((scan[:-1] == 0xFF) & (scan[1:] == 0)) + 1
    if len(stuffed):
        scan = np.delete(scan, stuffed)
    across, blocks = w // 8, (w // 8) * (h // 8)
    b = scan[: blocks * 74].reshape(blocks, 74)[:, :72].reshape(-1, 9).astype(np.uint16)
    words = np.empty((len(b), 8), np.uint16)
    for i in range(8):
        words[:, i] = ((b[:, i] & ((1 << (8 - i)) - 1)) << (i + 1)) | (b[:, i + 1] >> (7 - i))
    return _BACK[words].reshape(blocks, UNIT), across


class _Bits:
    """Bits of a scan, read from where it stands; what one read costs does not depend on the scan's length."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + b"\0" * 4, 0, 8 * len(data)

    def take(self, n: int) -> int:
        at = self.at
        self.at += n
        if self.at > self.end:
            raise ValueError("the scan ends too early")
        word = int.from_bytes(self.data[at >> 3 : (at >> 3) + 4], "big")
        return word >> (32 - (at & 7) - n) & ((1 << n) - 1)

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("no such Huffman code")

    def signed(self, size: int) -> int:
        v = self.take(size) if size else 0
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


def decode_frame(frame: bytes) -> np.ndarray:
    """The luminance samples of a baseline JPEG, ``(height, width)``."""
    quick = _fast(frame)
    if quick:
        blocks, across = quick
        px = samples(_VALUE[blocks]).reshape(-1, across, 8, 8)
        return px.transpose(0, 2, 1, 3).reshape(-1, across * 8)
    tables: dict[int, dict] = {}
    quants: dict[int, np.ndarray] = {}
    at, restart, parts = 2, 0, []
    while True:
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quants[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC0:
            h, w, n = struct.unpack_from(">HHB", body, 1)
            parts = [[body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]] for i in range(n)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline frames are decoded")
        elif marker == 0xC4:
            while body:
                counts, code, k, table = body[1:17], 0, 17, {}
                for length, count in enumerate(counts, 1):
                    for _ in range(count):
                        table[length, code] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                tables[body[0]], body = table, body[k:]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            chosen = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, 16 + (body[2 + 2 * i] & 15)) for i in range(body[0])}
            break
    raw, pieces, start, i = frame[at:], [], 0, 0
    while (i := raw.find(b"\xff", i)) >= 0 and i + 1 < len(raw):
        if raw[i + 1] != 0:
            pieces.append(raw[start:i].replace(b"\xff\0", b"\xff"))
            start = i + 2
            if not 0xD0 <= raw[i + 1] <= 0xD7:
                break
        i += 2
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    if len(parts) == 1:
        parts[0][1] = parts[0][2] = most_h = most_v = 1
    wide, high = -(-w // (8 * most_h)), -(-h // (8 * most_v))
    first = parts[0]
    luma = np.zeros((high * first[2], wide * first[1], 64), np.int64)
    bits, last = None, [0] * len(parts)
    for m in range(wide * high):
        if bits is None or (restart and m % restart == 0):
            bits, last = _Bits(pieces.pop(0)), [0] * len(parts)
        for c, (name, sx, sy, quant) in enumerate(parts):
            dc, ac = chosen[name]
            for v in range(sy):
                for u in range(sx):
                    block = np.zeros(64, np.int64)
                    last[c] += bits.signed(bits.symbol(tables[dc]))
                    block[0], k = last[c], 1
                    while k < 64:
                        s = bits.symbol(tables[ac])
                        if s == 0:
                            break
                        k += s >> 4
                        if s & 15:
                            block[k] = bits.signed(s & 15)
                        k += 1
                    if c == 0:
                        luma[m // wide * sy + v, m % wide * sx + u] = block * quants[quant]
    px = samples(luma.reshape(-1, 64)).reshape(luma.shape[0], luma.shape[1], 8, 8)
    return px.transpose(0, 2, 1, 3).reshape(luma.shape[0] * 8, -1)[:h, :w]


def payload_of(video: Video) -> bytes:
    """The bytes that ``encode`` stored."""
    blocks = [_fast(f) for f in video.frames]
    if video.payload is None or any(b is None for b in blocks):
        raise ValueError("this file holds no payload")
    return b"".join(b[0].tobytes() for b in blocks)[: video.payload]


def shots(histograms: np.ndarray, least: float = 0.25, times: float = 2.5, window: int = 8) -> list[tuple[int, int]]:
    """Cuts frames where histograms differ by more than the shot's recent differences suggest.

    A cut needs a difference over ``least`` of its maximum, and over ``times``
    the mean of the last ``window`` differences within the shot.
    """
    if not len(histograms):
        return []
    most = 2 * histograms[0].sum()
    diff = np.abs(np.diff(histograms.astype(np.int64), axis=0)).sum(1)
    cuts, recent = [0], []
    for i, d in enumerate(diff.tolist(), 1):
        if d > least * most and d * len(recent) > times * sum(recent):
            cuts.append(i)
            recent = []
        else:
            recent = [*recent, d][-window:]
    return list(zip(cuts, [*cuts[1:], len(histograms)]))


def features(data: bytes) -> tuple[list[tuple[int, int]], float, str, bytes | None]:
    """Shots, frame rate, a summary of the decoded frames, and the payload if there is one."""
    video = parse(data)
    quick = [_fast(f) for f in video.frames]
    payload = None
    if video.frames and all(q is not None for q in quick):
        each, across = len(quick[0][0]), quick[0][1] * 8
        down = each // quick[0][1] * 8
        hist = np.zeros((len(quick), BINS), np.int64)
        at_once = max(1, SAMPLED // (each * UNIT))  # samples are eight bytes each, so some frames at a time
        for lo in range(0, len(quick), at_once):
            some = quick[lo : lo + at_once]
            px = samples(_VALUE[np.concatenate([q[0] for q in some])]) >> 4
            of = np.repeat(np.arange(len(some)) * BINS, [len(q[0]) * UNIT for q in some])
            hist[lo : lo + at_once] = np.bincount(of + px.reshape(-1), minlength=len(some) * BINS).reshape(-1, BINS)
        if video.payload is not None:
            payload = b"".join(q[0].tobytes() for q in quick)[: video.payload]
    else:
        frames = (decode_frame(f) for f in video.frames)
        hist, down, across = [], 0, 0
        for f in frames:
            hist.append(np.bincount((f >> 4).reshape(-1), minlength=BINS))
            if len(hist) == 1:
                down, across = f.shape
        hist = np.array(hist, np.int64).reshape(-1, BINS)
    found = shots(hist)
    text = f"mjpeg {across}x{down} frames={len(hist)} shots={','.join(f'{a}-{b}' for a, b in found)} hist={','.join(map(str, hist.sum(0)))}"
    return found, video.fps, text, payload


def with_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, media)``: every whole text, padded with bytes 0 to a positive multiple of 64, as AVI.

    A null text is an empty one, and has a file of one block.  Null ids and
    repeated rows stay as they are; an empty table gives no rows.  Other columns
    of ``docs`` are not read, whatever their names.  A file is as large as nine
    eighths of its text, and one text is encoded at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, media, held = [], [], [], 0
            for key, value in zip(batch.column(0), batch.column(1)):
                text = value.as_buffer().to_pybytes() if value.is_valid else b""
                ids.append(key.as_py())
                sizes.append(len(text))
                media.append(encode(text + b"\0" * (-len(text) % UNIT or (0 if text else UNIT))))
                held += len(media[-1])
                if held > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names)
                    ids, sizes, media, held = [], [], [], 0
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names)

    names = ["id", "n_bytes", "media"]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, "id long, n_bytes long, media binary")


_READ = (
    "id long, n_bytes long, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, "
    "tail_crc32 long, feature string, clips array<struct<first:int,end:int,start_s:double,end_s:double>>"
)


def read_media(media: DataFrame) -> DataFrame:
    """``(id, n_bytes, media)`` -> digests, the payload's if the file holds one, the feature and timed clips.

    A null medium, and one that is no AVI file of baseline frames, has a null
    feature and no clips.  Null ids and repeated rows stay as they are; an empty
    table gives no rows.  Other columns of ``media`` are not read.
    """

    def one(data: bytes | None) -> tuple:
        if data is None:
            return None, None, None, None, None, None, []
        whole = len(data), hashlib.sha256(data).hexdigest()
        try:
            found, fps, text, payload = features(data)
        except (ValueError, IndexError, KeyError, struct.error):
            return *whole, None, None, None, None, []
        clips = [{"first": a, "end": b, "start_s": round(a / fps, 6), "end_s": round(b / fps, 6)} for a, b in found]
        if payload is None:
            return *whole, None, None, None, text, clips
        return *whole, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), text, clips

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [one(m.as_buffer().to_pybytes() if m.is_valid else None) for m in batch.column(2)]
            cols = [pa.array(c, t) for c, t in zip(zip(*got), types)] if got else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names)

    clip = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())]))
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), clip]
    names = [c.split()[0] for c in _READ.split(", ")]
    return media.select("id", "n_bytes", "media").mapInArrow(run, _READ)


def clips(read: DataFrame) -> DataFrame:
    """One row for each clip: ``(id, clip, first, end, start_s, end_s)``, frames half-open."""
    return read.select("id", F.posexplode("clips").alias("clip", "c")).select("id", "clip", "c.*")
