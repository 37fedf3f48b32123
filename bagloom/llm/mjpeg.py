"""AVI motion-JPEG columns: bytes to lossless intra frames and back, shots and clip rows.

A payload is cut into frames of 24 x 24 samples of 8 bits (576 bytes). Each frame is a
JPEG of the lossless process (SOF3, one component, predictor 1), so any byte string
survives the round trip; a frame's entropy-coded data uses one prefix code of four bits
per difference class. The frames are the `00dc` chunks of a RIFF AVI file with an `idx1`
index. Reading parses the RIFF chunks, takes the frames from the index and decodes all
frames of a batch together, sample by sample across frames.

Shots: histograms of 16 bins per frame; a cut lies where the distance of neighbouring
histograms exceeds both a floor and the mean of the preceding distances (up to 12) by three
of their deviations. Each shot is a clip row with start and end in seconds.

Defined results: null or empty texts are one frame of bytes 255. Equal texts give equal
files, hence equal values; repeated rows are kept. Extra columns are ignored. A file
raises ValueError if its length or index is broken, if a frame has other tables than these,
an unknown code, or a scan longer or shorter than its codes, or if the `crc ` chunk at its
end (CRC-32 of all bytes before that chunk) differs. Files without that chunk, as other
programs write them, are read without the last check.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagloom.llm.common import lean, slices, utf8

SIDE, FPS = 24, 25
FRAME = SIDE * SIDE
CLASSES = 9  # differences of 8-bit samples have 0 to 8 extra bits


def frame_header() -> bytes:
    table = struct.pack(">HB", 2 + 1 + 16 + CLASSES, 0x00) + bytes([0, 0, 0, CLASSES] + [0] * 12) + bytes(range(CLASSES))
    start = struct.pack(">HBHHB3B", 11, 8, SIDE, SIDE, 1, 1, 0x11, 0)
    scan = struct.pack(">HB2B3B", 8, 1, 1, 0x00, 1, 0, 0)
    return b"\xff\xd8" + b"\xff\xc3" + start + b"\xff\xc4" + table + b"\xff\xda" + scan


HEADER = frame_header()
#: marker segments that a frame may hold, as they must be: start of frame, table, start of scan
SEGMENTS = {0xC3: HEADER[4:15], 0xC4: HEADER[17 : 17 + 2 + 1 + 16 + CLASSES], 0xDA: HEADER[-8:]}


def differences(frames: np.ndarray) -> np.ndarray:
    """Left-neighbour differences; the first column predicts from above, the first sample from 128."""
    x = frames.reshape(-1, SIDE, SIDE).astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    return d.reshape(-1, FRAME)


BITS = np.array([int(v).bit_length() for v in range(512)], np.uint8)


def encode_frames(frames: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(JPEG bytes of all frames, offsets). frames: rows of 576 samples."""
    n = len(frames)
    d = differences(frames)
    size = BITS[np.abs(d)]
    code = np.where(d < 0, d + (1 << size.astype(np.int16)) - 1, d).astype(np.uint32) | (size.astype(np.uint32) << size)
    width = (size + 4).astype(np.int64)
    ends = np.cumsum(width, axis=1)
    bits = ends[:, -1]
    length = (bits + 7) // 8
    base = np.cumsum(length) - length
    at = (base[:, None] * 8 + ends - width).ravel()
    # each code touches at most 3 bytes; codes never overlap, so sums are ors
    shifted = code.ravel() << (24 - width.ravel() - (at & 7)).astype(np.uint32)
    total = int(length.sum())
    first = at >> 3
    out = np.zeros(total + 3, np.float64)
    for k in range(3):
        out[k : k + total + 1] += np.bincount(first, weights=(shifted >> (16 - 8 * k)) & 255, minlength=total + 1)[: total + 1]
    raw = out[:total].astype(np.uint8)
    pad = (length * 8 - bits).astype(np.int64)
    raw[base + length - 1] |= ((1 << pad) - 1).astype(np.uint8)
    # byte stuffing: a zero follows each 255
    full = raw == 255
    before = np.cumsum(full) - full
    stuffed_before = np.append(before, full.sum())[np.append(base, total)]
    head, tail = len(HEADER), 2
    begin = np.append(base, total) + stuffed_before + np.arange(n + 1) * (head + tail)
    data = np.zeros(int(begin[-1]), np.uint8)
    frame_of = np.repeat(np.arange(n), length)
    where = np.arange(total) + before + frame_of * (head + tail) + head
    data[where] = raw
    data[(begin[:-1, None] + np.arange(head)).ravel()] = np.tile(np.frombuffer(HEADER, np.uint8), n)
    data[begin[1:] - 2], data[begin[1:] - 1] = 255, 0xD9
    return data, begin


def avi(frames: list[bytes]) -> bytes:
    """One RIFF AVI file with an idx1 index."""
    pads = [f + b"\0" * (len(f) & 1) for f in frames]
    head = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, len(frames), 0, 1, max(map(len, frames)), SIDE, SIDE, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, len(frames), max(map(len, frames)), 0, 0, 0, 0, SIDE, SIDE)
    form = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body
    lists = lambda name, body: b"LIST" + struct.pack("<I", len(body) + 4) + name + body
    header = lists(b"hdrl", chunk(b"avih", head) + lists(b"strl", chunk(b"strh", stream) + chunk(b"strf", form)))
    movie, index, at = [], [], 4
    for f, p in zip(frames, pads, strict=True):
        movie += [b"00dc", struct.pack("<I", len(f)), p]
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += 8 + len(p)
    body = b"AVI " + header + lists(b"movi", b"".join(movie)) + chunk(b"idx1", b"".join(index))
    media = b"RIFF" + struct.pack("<I", len(body) + 12) + body
    return media + chunk(b"crc ", struct.pack("<I", zlib.crc32(media)))


def frame_places(media: bytes) -> list[tuple[int, int]]:
    """(place, length) of each frame, by the file's own index."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    if int.from_bytes(media[4:8], "little") + 8 != len(media):
        raise ValueError("a file of another length than it says")
    if media[-12:-4] == b"crc \4\0\0\0" and zlib.crc32(media[:-12]) != int.from_bytes(media[-4:], "little"):
        raise ValueError("a checksum that differs")
    at, movie, index = 12, None, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"LIST" and media[at + 8 : at + 12] == b"movi":
            movie = at + 8
        elif name == b"idx1" and at + 8 + size <= len(media):
            index = np.frombuffer(media, np.dtype([("name", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]), size // 16, at + 8)
        at += 8 + size + (size & 1)
    if movie is None or index is None:
        raise ValueError("no frames or no index")
    places = [(movie + a + 8, s) for name, a, s in zip(index["name"].tolist(), index["at"].tolist(), index["size"].tolist(), strict=True) if name == b"00dc"]
    if any(a + s > len(media) for a, s in places):
        raise ValueError("an index that points behind the file")
    return places


def scan_start(media: bytes, at: int, known: dict[bytes, int]) -> int:
    """Where a frame's entropy-coded data begins, after checking its marker segments."""
    if known and media[at : at + len(HEADER)] in known:
        return at + len(HEADER)
    i = at + 2
    if media[at:i] != b"\xff\xd8":
        raise ValueError("a frame without a start marker")
    while True:
        mark, size = media[i + 1 : i + 2], int.from_bytes(media[i + 2 : i + 4], "big")
        if media[i : i + 1] != b"\xff" or size < 2 or not mark or SEGMENTS.get(mark[0]) != media[i + 2 : i + 2 + size]:
            raise ValueError("a frame of another kind")
        i += 2 + size
        if mark == b"\xda":
            known[media[at:i]] = i - at
            return i


def decode_frames(parts: list[bytes]) -> np.ndarray:
    """Samples of frames from their entropy-coded data (with stuffing), all frames at once."""
    raw = np.frombuffer(b"".join(parts) + b"\0" * 8, np.uint8)
    sizes = np.array([len(p) for p in parts], np.int64)
    keep = np.ones(len(raw), bool)
    keep[1:] = ~((raw[1:] == 0) & (raw[:-1] == 255))
    keep[-8:] = True
    place = np.cumsum(keep) - keep
    ends = np.cumsum(sizes)
    starts, stops = place[ends - sizes], place[ends]
    data = raw[keep]
    # the 32 bits from each byte on, so that one look-up a sample suffices
    wide = data[:-3].astype(np.uint32)
    for k in (1, 2, 3):
        wide = (wide << np.uint32(8)) | data[k : len(data) - 3 + k]
    bit = starts * 8
    out = np.empty((FRAME, len(parts)), np.int16)
    for i in range(FRAME):
        word = wide[bit >> 3] << (bit & 7).astype(np.uint32)
        size = (word >> np.uint32(28)).astype(np.int64)
        if len(size) and size.max() >= CLASSES:
            raise ValueError("a frame with an unknown code")
        extra = ((word << np.uint32(4)) >> (np.uint32(31) - size.astype(np.uint32)) >> np.uint32(1)).astype(np.int16)
        half = ((1 << size) >> 1).astype(np.int16)
        out[i] = np.where(extra < half, extra - (1 << size).astype(np.int16) + 1, extra)
        # a broken scan may run on, but not beyond the buffer
        bit = np.minimum(bit + 4 + size, len(wide) * 8 - 1)
    if ((bit + 7) >> 3 != stops).any():
        raise ValueError("a scan of another length than its codes")
    d = np.ascontiguousarray(out.T).reshape(-1, SIDE, SIDE)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
    return (np.cumsum(d, axis=2) & 255).astype(np.uint8).reshape(-1, FRAME)


def histograms(frames: np.ndarray) -> np.ndarray:
    n = len(frames)
    key = (np.arange(n)[:, None] * 16 + (frames >> 4)).ravel()
    return np.bincount(key, minlength=16 * n).reshape(n, 16)


def cuts(distance: np.ndarray, floor: float = 0.2, span: int = 12) -> list[int]:
    """Frames at which a new shot begins; distance[i] lies between frames i and i + 1, from 0 to 1."""
    out, seen = [], distance.tolist()
    for i, x in enumerate(seen):
        past = seen[max(0, i - span) : i]
        mean = sum(past) / len(past) if past else 0.0
        spread = (sum((y - mean) ** 2 for y in past) / len(past)) ** 0.5 if past else 0.0
        if x > max(floor, mean + 3 * spread):
            out.append(i + 1)
    return out


def store(payloads: list[np.ndarray]) -> list[bytes]:
    """One AVI file for each payload (a positive multiple of 576 bytes)."""
    data, begin = encode_frames(np.concatenate(payloads).reshape(-1, FRAME))
    raw, out, at = data.tobytes(), [], 0
    b = begin.tolist()
    for p in payloads:
        k = len(p) // FRAME
        out.append(avi([raw[b[i] : b[i + 1]] for i in range(at, at + k)]))
        at += k
    return out


def load(files: list[bytes]) -> list[np.ndarray]:
    """The frames of each file, as rows of 576 samples."""
    known: dict[bytes, int] = {}
    parts, counts = [], []
    for media in files:
        places = frame_places(media)
        counts.append(len(places))
        for at, size in places:
            if media[at + size - 2 : at + size] != b"\xff\xd9":
                raise ValueError("a frame without an end marker")
            parts.append(media[scan_start(media, at, known) : at + size - 2])
    frames = decode_frames(parts) if parts else np.zeros((0, FRAME), np.uint8)
    return np.split(frames, np.cumsum(counts)[:-1]) if counts else []


def padded_payload(raw: bytes) -> np.ndarray:
    n = max(1, -(-len(raw) // FRAME)) * FRAME
    out = np.full(n, 255, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out


def shots(frames: list[np.ndarray]) -> list[list[tuple[int, int]]]:
    """(first, end) frames of the shots of each file."""
    out = []
    counts = [len(f) for f in frames]
    all_hist = histograms(np.concatenate(frames)) if frames else np.zeros((0, 16), np.int64)
    gap = np.abs(np.diff(all_hist, axis=0)).sum(axis=1) / (2 * FRAME) if len(all_hist) else np.zeros(0)
    at = 0
    for n in counts:
        found = cuts(gap[at : at + n - 1]) if n else []
        out.append(list(zip([0, *found], [*found, n], strict=True)) if n else [])
        at += n
    return out


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def text_batches(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list, list[bytes]]]:
    for whole in batches:
        for i, j in slices(whole.column(1), limit):
            part = whole.slice(i, j - i)
            data, offsets = utf8(part.column(1))
            raw, o = data.tobytes(), offsets.tolist()
            yield part.column(0).to_pylist(), [raw[o[k] : o[k + 1]] for k in range(j - i)]


def digests(docs: DataFrame, text: str = "text", key: str = "doc_id", batch_bytes: int = 2 << 20) -> DataFrame:
    """Stores each text as AVI, reads it back and describes both; feature lists the shots as first-end frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, raws in text_batches(batches, batch_bytes):
            files = store([padded_payload(r) for r in raws])
            frames = load(files)
            rows = []
            for doc, raw, media, own, found in zip(ids, raws, files, frames, shots(frames), strict=True):
                back = own.tobytes()
                feature = f"frames={len(own)};shots={len(found)};clips=" + ",".join(f"{a}-{b}" for a, b in found)
                rows.append((doc, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            names = [x.split()[0] for x in DIGEST.split(", ")]
            kinds = [pa.string() if x.endswith("string") else pa.int64() for x in DIGEST.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(lean(run), DIGEST)


def to_avi(docs: DataFrame, text: str = "text", key: str = "doc_id", batch_bytes: int = 2 << 20) -> DataFrame:
    """doc_id, n_bytes, media (the AVI file)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, raws in text_batches(batches, batch_bytes):
            files = store([padded_payload(r) for r in raws])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(r) for r in raws], pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, n_bytes long, media binary")


def clips(media: DataFrame) -> DataFrame:
    """One row per shot of each AVI file in (doc_id, media): clip, first_frame, end_frame, start_s, end_s. Null media give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(whole.num_rows):
                doc, blob = whole.column(0)[k].as_py(), whole.column(1)[k].as_py()
                if blob is None:
                    continue
                found = shots(load([blob]))[0]
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(found), pa.int64()), pa.array(range(len(found)), pa.int64()), pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64()), pa.array([a / FPS for a, _ in found], pa.float64()), pa.array([b / FPS for _, b in found], pa.float64())], names=["doc_id", "clip", "first_frame", "end_frame", "start_s", "end_s"])

    return media.select(F.col("doc_id").cast("long").alias("doc_id"), "media").mapInArrow(lean(run), "doc_id long, clip long, first_frame long, end_frame long, start_s double, end_s double")
