"""Motion-JPEG in AVI: lossless payload frames, RIFF indexes, intra decoding and shot detection.

A payload is cut into frames of 24 x 24 grey pixels, nine 8 x 8 blocks of 64 quantised coefficients each.
The format's unit is the coefficient: every payload byte is the 8 extra bits of one coefficient of size
category 8 (values -255..-128 and 128..255), coded by one-bit Huffman codes and with a restart marker after
each block, so entropy coding keeps all bytes. Reading back parses the RIFF chunks and the index. A frame
that begins with this module's own header is unpacked directly: byte stuffing is undone and the bits are
the coefficients; pixels come from dequantisation and the inverse DCT. For frames by other encoders (baseline, any
Huffman tables) a general decoder walks the JPEG markers.
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

from vacantia.llm._util import column, slices

FRAME = 576
SIDE = 24
FPS = 25
PAD = 255
BINS = 16
#: Bytes of stored files that are decoded at once; one larger file forms a slice of its own.
MEDIA_BYTES = 1 << 21
#: A cut needs a histogram difference over this floor and over mean + DEVIATIONS deviations of the differences before it.
FLOOR, DEVIATIONS, WINDOW = 0.12, 2.0, 12

#: Fixed by ITU T.81: the order in which the coefficients of a block are coded.
ZIGZAG = np.array([r * 8 + c for _, _, r, c in sorted((r + c, r if (r + c) % 2 else c, r, c) for r in range(8) for c in range(8))])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _one_code(kind: int) -> bytes:
    """A Huffman table with one code, of one bit, for size category 8 (run 0)."""
    return bytes([kind, 1] + [0] * 15 + [8])


#: Everything before a frame's scan: quantisation by 1, grey baseline frame, tables, restart after each block.
HEADER = (
    b"\xff\xd8"
    + _segment(0xDB, b"\0" + b"\1" * 64)
    + _segment(0xC0, struct.pack(">BHHB", 8, SIDE, SIDE, 1) + b"\1\x11\0")
    + _segment(0xC4, _one_code(0x00))
    + _segment(0xC4, _one_code(0x10))
    + _segment(0xDD, b"\0\1")
    + _segment(0xDA, b"\1\1\0\0\x3f\0")
)
EOI = b"\xff\xd9"


def pack_scans(payload: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of all frames of ``payload`` (a multiple of 576 bytes) and their offsets."""
    b = payload.reshape(-1, 8).astype(np.uint16)
    coded = np.empty((len(b), 9), np.uint8)
    coded[:, 0] = b[:, 0] >> 1
    for k in range(1, 8):
        coded[:, k] = ((b[:, k - 1] & ((1 << k) - 1)) << (8 - k)) | (b[:, k] >> (k + 1))
    coded[:, 8] = b[:, 7] & 255
    frames = coded.reshape(-1, 9, 72)
    room = np.empty((len(frames), 9, 74), np.uint8)
    room[:, :, :72] = frames
    room[:, :, 72] = 0xFF
    room[:, :, 73] = 0xD0 + np.arange(9) % 8
    flat = room.reshape(-1)
    stuffed = np.zeros(room.shape, np.int64)
    stuffed[:, :, :72] = frames == 0xFF
    width = 1 + stuffed
    width[:, 8, 72:] = 0  # no restart marker after the last block
    width = width.reshape(-1)
    ends = np.cumsum(width)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    real = width > 0
    out[(ends - width)[real]] = flat[real]
    return out, np.concatenate(([0], ends[9 * 74 - 1 :: 9 * 74]))


def unpack_scans(scans: np.ndarray) -> np.ndarray | None:
    """The payload of concatenated scans of this module's own frames; None if they are of another coder."""
    marker = np.zeros(len(scans), bool)
    after = scans[:-1] == 0xFF
    marker[1:] = after & ((scans[1:] == 0) | ((scans[1:] >= 0xD0) & (scans[1:] <= 0xD7)))
    restart = marker.copy()
    restart[1:] &= scans[1:] != 0
    drop = marker.copy()
    drop[:-1] |= restart[1:]
    coded = scans[~drop]
    if len(coded) % 648:
        return None
    c = coded.reshape(-1, 9).astype(np.uint16)
    out = np.empty((len(c), 8), np.uint8)
    prefix = c[:, 0] >> 7
    for k in range(8):
        both = (c[:, k] << 8) | c[:, k + 1]
        out[:, k] = (both >> (7 - k)) & 255
        prefix |= (both >> (15 - k)) & 1
    return None if prefix.any() else out.reshape(-1)


def write_avi(scans: list[bytes], width: int = SIDE, height: int = SIDE, fps: int = FPS) -> bytes:
    """An AVI file of JPEG frames, each already complete without its header where it is this module's own."""
    chunks, index, at = [], [], 4
    for s in scans:
        size = len(s)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, size))
        chunks.append(struct.pack("<4sI", b"00dc", size) + s + b"\0" * (size & 1))
        at += 8 + size + (size & 1)
    most = max(map(len, scans), default=0)
    main = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(scans), 0, 1, most, width, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(scans), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    form = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    chunk = lambda tag, body: struct.pack("<4sI", tag, len(body)) + body + b"\0" * (len(body) & 1)
    strl = b"strl" + chunk(b"strh", stream) + chunk(b"strf", form)
    hdrl = b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", strl)
    body = b"AVI " + chunk(b"LIST", hdrl) + chunk(b"LIST", b"movi" + b"".join(chunks)) + chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_avi(media: bytes) -> tuple[list[bytes], float]:
    """The video frames that the RIFF index names (all ``##dc`` chunks if there is none) and seconds a frame."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, index, micros = -1, b"", 1_000_000 // FPS
    ends = [(12, min(len(media), 8 + struct.unpack_from("<I", media, 4)[0]))]
    span = (0, 0)
    while ends:
        at, end = ends.pop()
        while at + 8 <= end:
            tag, size = struct.unpack_from("<4sI", media, at)
            if tag == b"LIST":
                if media[at + 8 : at + 12] == b"movi":
                    movi, span = at + 8, (at + 12, at + 8 + size)
                else:
                    ends.append((at + 12, at + 8 + size))
            elif tag == b"idx1":
                index = media[at + 8 : at + 8 + size]
            elif tag == b"avih":
                micros = struct.unpack_from("<I", media, at + 8)[0]
            at += 8 + size + (size & 1)
    frames = []
    if index:
        rows = np.frombuffer(index, np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]))
        base = movi if len(rows) and media[movi + int(rows["at"][0]) :][:4] == rows["id"][0] else 0
        for tag, at, size in zip(rows["id"].tolist(), (rows["at"].astype(np.int64) + base).tolist(), rows["size"].tolist(), strict=True):
            if tag.endswith((b"dc", b"db")):
                frames.append(media[at + 8 : at + 8 + size])
    elif movi >= 0:
        at, end = span
        while at + 8 <= end:
            tag, size = struct.unpack_from("<4sI", media, at)
            if tag.endswith((b"dc", b"db")):
                frames.append(media[at + 8 : at + 8 + size])
            at += 8 + size + (size & 1)
    return frames, micros / 1e6


def _transform() -> np.ndarray:
    k = np.arange(8)
    m = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) / 2
    m[0] /= np.sqrt(2)
    return m.astype(np.float32)


_DCT = _transform()


def _inverse(blocks: np.ndarray) -> np.ndarray:
    """Pixels of dequantised blocks (n, 8, 8)."""
    half = (blocks.reshape(-1, 8) @ _DCT).reshape(-1, 8, 8).transpose(0, 2, 1)
    full = (np.ascontiguousarray(half).reshape(-1, 8) @ _DCT).reshape(-1, 8, 8).transpose(0, 2, 1)
    return np.clip(np.rint(full + 128), 0, 255).astype(np.uint8)


def own_pixels(payload: np.ndarray) -> np.ndarray:
    """Pixels (frames, 576) of this module's own frames; block order, which histograms don't mind."""
    v = payload.astype(np.int16)
    v = np.where(v < 128, v - 255, v).astype(np.float32).reshape(-1, 64)
    blocks = np.empty_like(v)
    blocks[:, ZIGZAG] = v
    return _inverse(blocks.reshape(-1, 8, 8)).reshape(-1, FRAME)


@dataclass
class Jpeg:
    width: int
    height: int
    tables: dict[int, np.ndarray]
    huffman: dict[int, dict[tuple[int, int], int]]
    parts: list[tuple[int, int, int, int]]
    scan: list[tuple[int, int, int]]
    restart: int
    data: bytes


def parse_jpeg(frame: bytes) -> Jpeg:
    """Markers of a baseline frame; the standard restrictions of motion JPEG (one scan) apply."""
    out = Jpeg(0, 0, {}, {}, [], [], 0, b"")
    at = 2
    while at + 4 <= len(frame):
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        if marker == 0xDB:
            i = 0
            while i < len(body):
                wide = body[i] >> 4
                out.tables[body[i] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, i + 1).astype(np.float32)
                i += 1 + 64 * (1 + wide)
        elif marker in (0xC0, 0xC1):
            out.height, out.width, n = struct.unpack_from(">HHB", body, 1)
            out.parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif marker in (0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC)):
            raise ValueError("only baseline JPEG frames are decoded")
        elif marker == 0xC4:
            i = 0
            while i < len(body):
                counts, codes, code, j = body[i + 1 : i + 17], {}, 0, i + 17
                for length, n in enumerate(counts, 1):
                    for _ in range(n):
                        codes[length, code] = body[j]
                        code, j = code + 1, j + 1
                    code <<= 1
                out.huffman[body[i]] = codes
                i = j
        elif marker == 0xDD:
            out.restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            out.scan = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
            end = frame.rfind(EOI)
            out.data = frame[at + 2 + size : end if end > 0 else len(frame)]
            return out
        at += 2 + size
    raise ValueError("a JPEG frame without a scan")


def decode_frame(frame: bytes) -> np.ndarray:
    """Luma pixels (height, width) of any baseline frame, bit by bit; the general, slower way."""
    jpeg = parse_jpeg(frame)
    pieces, start = [], 0
    data = jpeg.data
    i = data.find(b"\xff")
    while i >= 0 and i + 1 < len(data):
        if 0xD0 <= data[i + 1] <= 0xD7:
            pieces.append(data[start:i])
            start = i + 2
        i = data.find(b"\xff", i + 2)
    pieces.append(data[start:])
    most_h, most_v = max(p[1] for p in jpeg.parts), max(p[2] for p in jpeg.parts)
    across, down = -(-jpeg.width // (8 * most_h)), -(-jpeg.height // (8 * most_v))
    luma = jpeg.parts[0]
    plane = np.zeros((down * luma[2], across * luma[1], 64), np.float32)
    mcu, total = 0, across * down
    for piece in pieces:
        bits = np.unpackbits(np.frombuffer(piece.replace(b"\xff\0", b"\xff"), np.uint8)).tolist()
        at, dc = 0, {p[0]: 0 for p in jpeg.parts}

        def symbol(table: dict[tuple[int, int], int]) -> int:
            nonlocal at
            code = 0
            for length in range(1, 17):
                code = code << 1 | bits[at]
                at += 1
                if (length, code) in table:
                    return table[length, code]
            raise ValueError("no such Huffman code")

        def value(size: int) -> int:
            nonlocal at
            v = 0
            for _ in range(size):
                v = v << 1 | bits[at]
                at += 1
            return v if not size or v >> (size - 1) else v - (1 << size) + 1

        for _ in range(jpeg.restart or total):
            if mcu >= total:
                break
            row, col = divmod(mcu, across)
            for name, dc_table, ac_table in jpeg.scan:
                _, h, v, q = next(p for p in jpeg.parts if p[0] == name)
                for block in range(h * v):
                    coef = np.zeros(64, np.float32)
                    dc[name] += value(symbol(jpeg.huffman[dc_table]))
                    coef[0] = dc[name]
                    k = 1
                    while k < 64:
                        s = symbol(jpeg.huffman[0x10 | ac_table])
                        if s == 0:
                            break
                        k += s >> 4
                        if s & 15:
                            coef[k] = value(s & 15)
                        k += 1
                    if name == luma[0]:
                        y, x = divmod(block, h)
                        flat = np.zeros(64, np.float32)
                        flat[ZIGZAG] = coef * jpeg.tables[q]
                        plane[row * v + y, col * h + x] = flat
            mcu += 1
    pixels = _inverse(plane.reshape(-1, 8, 8)).reshape(plane.shape[0], plane.shape[1], 8, 8)
    return pixels.transpose(0, 2, 1, 3).reshape(plane.shape[0] * 8, -1)[: jpeg.height, : jpeg.width]


def histograms(pixels: np.ndarray) -> np.ndarray:
    """Shares of ``BINS`` grey levels for each frame (rows of pixels)."""
    n, size = pixels.shape
    key = (pixels >> 4).astype(np.int64) + (np.arange(n) * BINS)[:, None]
    return np.bincount(key.ravel(), minlength=n * BINS).reshape(n, BINS) / size


def cuts(hist: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut before frame? and the histogram difference to the frame before; ``first``: frame opens a clip's media.

    The threshold adapts to the mean and deviation of up to ``WINDOW`` differences before, in the same media.
    """
    n = len(hist)
    diff = np.zeros(n)
    diff[1:] = np.abs(np.diff(hist, axis=0)).sum(1) / 2
    diff[first] = 0
    opened = np.maximum.accumulate(np.where(first, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    low = np.maximum(opened + 1, np.arange(n) - WINDOW)
    have = np.arange(n) - low
    s1, s2 = (np.concatenate(([0.0], np.cumsum(d))) for d in (diff, diff * diff))
    some = np.maximum(have, 1)
    low = np.minimum(low, np.arange(n))
    mean = (s1[np.arange(n)] - s1[low]) / some
    spread = np.sqrt(np.maximum((s2[np.arange(n)] - s2[low]) / some - mean * mean, 0))
    cut = (diff > FLOOR) & (have >= 3) & (diff > mean + DEVIATIONS * spread)
    return cut & ~first, diff


def pad_payload(data: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of 576."""
    return data + bytes([PAD]) * (-len(data) % FRAME if data else FRAME)


def encode_media(payloads: list[bytes]) -> list[bytes]:
    """An AVI file for each padded payload; all frames are coded at once."""
    joined = np.frombuffer(b"".join(payloads), np.uint8)
    scans, offsets = pack_scans(joined)
    raw = scans.tobytes()
    bounds = offsets.tolist()
    frames = [HEADER + raw[a:b] + EOI for a, b in zip(bounds, bounds[1:], strict=False)]
    out, at = [], 0
    for p in payloads:
        n = len(p) // FRAME
        out.append(write_avi(frames[at : at + n]))
        at += n
    return out


def decode_media(media: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Payloads (empty for other coders' files), histograms of all frames, frames and seconds a frame of each file."""
    scans, counts, every, micros = [], [], [], []
    tail = len(HEADER)
    for m in media:
        frames, step = read_avi(m)
        every.append(frames)
        counts.append(len(frames))
        micros.append(step)
    own = [bool(f) and all(x.startswith(HEADER) and x.endswith(EOI) for x in f) for f in every]
    scans = [x[tail:-2] for f, o in zip(every, own, strict=True) if o for x in f]
    joined = unpack_scans(np.frombuffer(b"".join(scans), np.uint8)) if scans else np.zeros(0, np.uint8)
    if joined is None or len(joined) != FRAME * len(scans):
        raise ValueError("a frame's scan is damaged")
    pixels = own_pixels(joined)
    raw, at, payloads, hists = joined.tobytes(), 0, [], []
    own_hist = histograms(pixels)
    for f, o in zip(every, own, strict=True):
        if o:
            payloads.append(raw[at * FRAME : (at + len(f)) * FRAME])
            hists.append(own_hist[at : at + len(f)])
            at += len(f)
        else:
            payloads.append(b"")
            hists += [histograms(decode_frame(x).reshape(1, -1)) for x in f]
    return payloads, np.concatenate(hists) if hists else np.zeros((0, BINS)), np.array(counts, np.int64), np.array(micros)


def store_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_bytes`` (unpadded) and ``media``, the text's bytes as an AVI file.

    Null counts as empty, an empty text is one frame of padding; texts of any length are stored whole; rows that repeat
    get equal files; null ids are kept, other columns are ignored; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [(t or "").encode() for t in column(part, "text").to_pylist()]
                media = encode_media([pad_payload(t) for t in texts])
                yield pa.RecordBatch.from_arrays([column(part, "id"), pa.array(list(map(len, texts)), pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def clips(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each shot: id, ``clip``, ``start_s``, ``end_s``, ``first_frame``, ``frames``, ``cut_difference``.

    A null file gives no rows. A file that is not AVI or holds damaged frames fails the job.
    """
    kind = media.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media", MEDIA_BYTES):
                both = [(i, m) for i, m in zip(column(part, "id").to_pylist(), column(part, "media").to_pylist(), strict=True) if m is not None]
                if not both:
                    continue
                _, hist, counts, step = decode_media([m for _, m in both])
                owner = np.repeat(np.arange(len(both)), counts)
                first = np.zeros(len(owner), bool)
                opens = np.cumsum(counts) - counts
                first[opens[counts > 0]] = True
                cut, diff = cuts(hist, first)
                begin = np.flatnonzero(cut | first)
                size = np.diff(np.concatenate((begin, [len(owner)])))
                who = owner[begin]
                rank = np.arange(len(begin)) - np.searchsorted(who, who)
                start = begin - opens[who]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([both[w][0] for w in who], column(part, "id").type), pa.array(rank.astype(np.int32)), pa.array(start * step[who]), pa.array((start + size) * step[who]), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(diff[begin])],
                    ["id", "clip", "start_s", "end_s", "first_frame", "frames", "cut_difference"],
                )

    return media.selectExpr(f"`{id_col}` AS id", f"`{media_col}` AS media").mapInArrow(run, f"id {kind}, clip int, start_s double, end_s double, first_frame int, frames int, cut_difference double").withColumnRenamed("id", id_col)


def media_digests(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests of stored files and of the payloads read back from them, with the shots as ``feature``.

    Rows that repeat get equal results; null ids are kept, other columns are ignored; an empty table gives no rows.
    Files are read in slices of about ``MEDIA_BYTES``, so a task's memory follows the largest file.
    """
    kind = stored.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media", MEDIA_BYTES):
                media = column(part, "media").to_pylist()
                payloads, hist, counts, step = decode_media(media)
                first = np.zeros(int(counts.sum()), bool)
                opens = np.cumsum(counts) - counts
                first[opens] = True
                cut, diff = cuts(hist, first)
                begin = np.flatnonzero(cut)
                lo, hi = np.searchsorted(begin, opens), np.searchsorted(begin, opens + counts)
                mean = np.add.reduceat(diff, opens) / counts if len(opens) else diff
                features = []
                for a, b, o, n, s, d in zip(lo, hi, opens, counts, step, mean, strict=True):
                    times = ",".join(f"{(f - o) * s:.2f}" for f in begin[a:b])
                    features.append(f"frames={n};shots={b - a + 1};difference={d:.4f};cuts={times}")
                sha = lambda x: hashlib.sha256(x).hexdigest()
                yield pa.RecordBatch.from_arrays(
                    [column(part, "id"), column(part, "n_bytes"), pa.array(list(map(len, payloads)), pa.int64()), pa.array(list(map(sha, payloads))), pa.array([zlib.crc32(p[-32:]) for p in payloads], pa.int64()), pa.array(list(map(len, media)), pa.int64()), pa.array(list(map(sha, media))), pa.array(features)],
                    ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )

    return stored.selectExpr(f"`{id_col}` AS id", "n_bytes", "media").mapInArrow(run, schema).withColumnRenamed("id", id_col)
