"""Baseline JPEG as a media column: a reader that parses markers, Huffman-decodes scans and reconstructs the DC-only
luminance thumbnail in numpy, and a writer that stores 8-bit samples so that this thumbnail gives them back exactly.

Writer: each sample is one 8x8 block of a grey image that has only its DC coefficient; the DC quantiser is 8, so the
block's mean is the sample itself. An image is 24 blocks wide with a restart interval of one row of blocks; a payload
beyond one image's height goes on in further images, one after the other. Reader: baseline sequential (SOF0), 8 bits,
1 to 3 components in one interleaved scan, any tables and sampling factors; anything else is a ValueError. Restart
intervals of all images with the same tables are decoded side by side, so the work is vectorised across them.

Null text is empty. Equal texts give equal media, thumbnails and hashes; rows are handled each for itself.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

UNIT = 576
_WIDE = 24  # blocks in a row
_ROWS = 8184  # rows of blocks of one image at most: 8 * 8184 < 2^16, a multiple of 24
_ZIGZAG_END = 63


def padded(raw: bytes) -> bytes:
    """raw with bytes 255 up to a positive multiple of 576."""
    return raw + b"\xff" * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


# --- writer ---------------------------------------------------------------------------------------------------------
# A DC category s has a code of 9 - s bits (s ones short of the all-ones code), then s bits of the difference; the only
# AC symbol, end of block, has the 1-bit code 0. Every block is 10 bits, and a row of 24 blocks 30 bytes.


def _fields() -> np.ndarray:
    """The 10 bits of a block by its DC difference + 255."""
    found = []
    for diff in range(-255, 256):
        s = abs(diff).bit_length()
        low = diff if diff >= 0 else diff + (1 << s) - 1
        found.append(((((1 << (9 - s)) - 2) << s) | low) << 1)
    return np.array(found, np.uint64)


_FIELDS = _fields()


def _marker(code: int, body: bytes) -> bytes:
    return bytes((0xFF, code)) + (len(body) + 2).to_bytes(2, "big") + body


def _head(rows: int) -> bytes:
    return (
        b"\xff\xd8"
        + _marker(0xE0, b"JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00")
        + _marker(0xDB, b"\x00" + b"\x08" * 64)
        + _marker(0xC0, b"\x08" + (8 * rows).to_bytes(2, "big") + (8 * _WIDE).to_bytes(2, "big") + b"\x01\x01\x11\x00")
        + _marker(0xC4, b"\x00" + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1)))
        + _marker(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\x00")
        + _marker(0xDD, _WIDE.to_bytes(2, "big"))
        + _marker(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    )


def _images(samples: np.ndarray, rows: list[int]) -> list[bytes]:
    """Images of so many rows of blocks each, from their samples one after the other."""
    grid = samples.reshape(-1, _WIDE).astype(np.int16)
    diff = grid + 255
    diff[:, 0] -= 128
    diff[:, 1:] -= grid[:, :-1]
    four = _FIELDS[diff].reshape(-1, 6, 4)
    word = (four[..., 0] << np.uint64(30)) | (four[..., 1] << np.uint64(20)) | (four[..., 2] << np.uint64(10)) | four[..., 3]
    begin = np.r_[0, np.cumsum(rows)]
    scan = np.empty((len(grid), 32), np.uint8)
    scan[:, :30] = word.astype(">u8").view(np.uint8).reshape(-1, 6, 8)[..., 3:].reshape(-1, 30)
    scan[:, 30] = 0xFF
    scan[:, 31] = 0xD0 + (np.arange(len(grid)) - np.repeat(begin[:-1], rows)) % 8
    full = np.flatnonzero(scan[:, :30].ravel() == 0xFF)
    full = full + full // 30 * 2 + 1  # a zero goes before here
    flat = np.insert(scan.ravel(), full, 0).tobytes()
    ends = (begin * 32 + np.searchsorted(full, begin * 32)).tolist()
    return [_head(n) + flat[ends[i] : ends[i + 1] - 2] + b"\xff\xd9" for i, n in enumerate(rows)]  # no marker after the last row


def encode_all(payloads: list[bytes]) -> list[bytes]:
    """Stored forms of payloads whose lengths are positive multiples of 576."""
    most = _ROWS * _WIDE
    rows = [[min(most, len(p) - i) // _WIDE for i in range(0, len(p), most)] for p in payloads]
    images = iter(_images(np.frombuffer(b"".join(payloads), np.uint8), [n for own in rows for n in own]))
    return [b"".join(next(images) for _ in own) for own in rows]


def encode(payload: bytes) -> bytes:
    return encode_all([payload])[0]


# --- reader ---------------------------------------------------------------------------------------------------------


@dataclass
class Frame:
    """A parsed image: its size, components (id, h, v, quantiser, DC table, AC table) and restart intervals."""

    width: int = 0
    height: int = 0
    parts: list[list[int]] = field(default_factory=list)
    quantisers: dict[int, int] = field(default_factory=dict)  # of the DC coefficient
    tables: dict[int, bytes] = field(default_factory=dict)
    interval: int = 0
    size: tuple[int, int] = (0, 0)  # width and height as the frame says them
    scan: np.ndarray | None = None  # without stuffing and markers
    starts: np.ndarray | None = None  # of the restart intervals in it

    @property
    def mcus(self) -> tuple[int, int]:
        h, v = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        if len(self.parts) == 1:
            h = v = 1
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(f"not a baseline JPEG that can be read: {what}")


def _entropy_coded(data: bytes, at: int) -> tuple[np.ndarray, np.ndarray, int]:
    """A scan without stuffing and markers, where its restart intervals begin in it, and where the next marker is."""
    rest = np.frombuffer(data, np.uint8, offset=at)
    full = np.flatnonzero(rest[:-1] == 0xFF)
    after = rest[full + 1]
    restart = (after & 0xF8) == 0xD0
    ends = full[(after != 0) & ~restart & (after != 0xFF)]
    _need(len(ends) > 0, "no end of image")
    end = int(ends[0])
    full, after, restart = full[full < end], after[full < end], restart[full < end]
    keep = np.ones(end, bool)
    keep[full[after == 0] + 1] = False
    marks = full[restart]
    keep[marks] = keep[marks + 1] = False
    kept = np.cumsum(keep)
    return rest[:end][keep], np.r_[0, kept[marks + 1]], at + end


def parse(data: bytes, at: int = 0) -> tuple[Frame, int]:
    """The image that begins at a position, and where it ends. Of several scans the one with the first component (luminance)
    counts; it holds all components or this one alone. What can't be read is a ValueError."""
    try:
        return _parsed(data, at)
    except (IndexError, KeyError) as error:
        raise ValueError("not a baseline JPEG that can be read: a segment is too short") from error


def _parsed(data: bytes, at: int) -> tuple[Frame, int]:
    _need(data[at : at + 2] == b"\xff\xd8", "no start of image")
    frame, at = Frame(), at + 2
    while True:
        _need(at + 2 <= len(data) and data[at] == 0xFF, "a marker is missing")
        code = data[at + 1]
        if code == 0xFF:
            at += 1
            continue
        if code == 0xD9:
            _need(frame.scan is not None, "no scan with luminance")
            return frame, at + 2
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        _need(size >= 2 and len(body) == size - 2, "a segment is cut off")
        at += 2 + size
        done = frame.scan is not None  # later tables are for later scans
        if code == 0xDB and not done:
            while body:
                wide = 1 + (body[0] >> 4)
                _need(len(body) >= 1 + 64 * wide, "a quantiser is cut off")
                frame.quantisers[body[0] & 15] = int.from_bytes(body[1 : 1 + wide], "big")
                body = body[1 + 64 * wide :]
        elif code == 0xC4 and not done:
            while body:
                n = sum(body[1:17])
                _need(len(body) >= 17 + n and sum(c << (15 - i) for i, c in enumerate(body[1:17])) <= 1 << 16, "a table of codes")
                frame.tables[body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif code == 0xC0:
            _need(body[0] == 8 and not frame.parts, "samples aren't of 8 bits, or two frames")
            frame.height, frame.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            frame.size = frame.width, frame.height
            _need(frame.height > 0 and frame.width > 0 and 1 <= body[5] <= 3, "size or components")
            frame.parts = [[body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2], 0, 0] for i in range(6, 6 + 3 * body[5], 3)]
            _need(all(1 <= p[1] <= 4 and 1 <= p[2] <= 4 for p in frame.parts), "sampling factors")
        elif 0xC1 <= code <= 0xCF and code not in (0xC4, 0xC8):
            _need(False, "another coding process")
        elif code == 0xDD and not done:
            _need(len(body) == 2, "a restart interval")
            frame.interval = int.from_bytes(body, "big")
        elif code == 0xDA:
            _need(bool(frame.parts), "a scan before its frame")
            named = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            scan, starts, at = _entropy_coded(data, at)
            if done or frame.parts[0][0] not in named:
                continue
            _need(len(named) == 1 or list(named) == [p[0] for p in frame.parts], "a scan with some of the components")
            if len(named) == 1 and len(frame.parts) > 1:  # blocks of this component alone, row by row
                top_h, top_v = max(p[1] for p in frame.parts), max(p[2] for p in frame.parts)
                part = frame.parts[0]
                frame.width, frame.height = -(-frame.width * part[1] // top_h), -(-frame.height * part[2] // top_v)
                frame.parts = [part]
            for part in frame.parts:
                part[4], part[5] = named[part[0]] >> 4, 16 + (named[part[0]] & 15)
                _need(part[4] in frame.tables and part[5] in frame.tables, "a table of codes is missing")
            _need(frame.parts[0][3] in frame.quantisers, "a quantiser is missing")
            frame.scan, frame.starts = scan, starts


@functools.lru_cache(64)
def _lookup(table: bytes) -> np.ndarray:
    """(bits << 8 | symbol) by the next 16 bits; 0 where no code begins so."""
    found, code, symbols = np.zeros(1 << 16, np.uint64), 0, table[16:]
    for bits, n in enumerate(table[:16], 1):
        for _ in range(n):
            found[code << (16 - bits) : (code + 1) << (16 - bits)] = bits << 8 | symbols[0]
            code, symbols = code + 1, symbols[1:]
        code <<= 1
    return found


def _decode(frames: list[Frame]) -> list[np.ndarray]:
    """DC values (dequantised, before level shift) of the first component of frames that share tables and layout."""
    first = frames[0]
    tables = {i: _lookup(first.tables[i]) for p in first.parts for i in (p[4], p[5])}
    blocks = [(c, p) for c, p in enumerate(first.parts) for _ in range(p[1] * p[2] if len(first.parts) > 1 else 1)]
    counts, begins, base = [], [], 0
    for f in frames:
        total = f.mcus[0] * f.mcus[1]
        step = f.interval or total
        n = -(-total // step)
        _need(len(f.starts) == n, "restart intervals are missing")
        counts += [step] * (n - 1) + [total - step * (n - 1)]
        begins.append((f.starts + base) * 8)
        base += len(f.scan)
    raw = np.concatenate([f.scan for f in frames] + [np.zeros(16, np.uint8)]).astype(np.uint32)
    window = (raw[:-3] << np.uint32(24)) | (raw[1:-2] << np.uint32(16)) | (raw[2:-1] << np.uint32(8)) | raw[3:]
    window = (window[:-4].astype(np.uint64) << np.uint64(32)) | window[4:]  # the next 64 bits from each byte on
    at, counts = np.concatenate(begins).astype(np.uint64), np.array(counts)
    order = np.argsort(-counts, kind="stable")  # lanes that end first are last
    at, most = at[order], counts[order]
    first_blocks = sum(c == 0 for c, _ in blocks)
    dc = np.zeros((int(most[0]), len(at), first_blocks), np.int32)
    level = np.zeros((len(first.parts), len(at)), np.int32)
    one, byte, top, bits = np.uint64(1), np.uint64(8), np.uint64(63), np.uint64(48)

    def ahead(p: np.ndarray) -> np.ndarray:
        return window[p >> np.uint64(3)] << (p & np.uint64(7))

    for step in range(int(most[0])):
        live = int(np.searchsorted(-most, -step, "left"))  # lanes with more than `step` units
        p, k = at[:live], 0
        for c, part in blocks:
            w = ahead(p)  # 57 bits at least: a DC code, its difference and an AC code are 43 at most
            got = tables[part[4]][w >> bits]
            _need(bool(got.min() >= 256), "a DC code")
            size, length = got & np.uint64(255), got >> byte
            w = w << length
            value = ((w >> one) >> (top - size)).astype(np.int32)
            half = (one << size >> one).astype(np.int32)
            level[c, :live] += value - np.where(value < half, 2 * half - 1, 0)
            if c == 0:
                dc[step, :live, k] = level[0, :live]
                k += 1
            got = tables[part[5]][(w << size) >> bits]
            p = p + (length + size + (got >> byte))
            todo = np.flatnonzero(got != np.uint64(256))  # what isn't a 1-bit end of block
            if len(todo):
                got, seen = got[todo], np.zeros(len(todo), np.int64)
                while len(todo):
                    _need(bool(got.min() >= 256), "an AC code")
                    p[todo] += got & np.uint64(15)
                    seen += ((got >> np.uint64(4)) & np.uint64(15)).astype(np.int64) + 1
                    going = ((got & np.uint64(255)) != 0) & (seen < _ZIGZAG_END)
                    todo, seen = todo[going], seen[going]
                    if len(todo):
                        got = tables[part[5]][ahead(p[todo]) >> bits]
                        p[todo] += got >> byte
        at[:live] = p
    _need(bool((at[np.argsort(order)] <= np.r_[np.concatenate(begins)[1:], base * 8]).all()), "a scan is too short")
    values, out, lane = np.empty_like(dc), [], 0
    values[:, order] = dc
    for f in frames:
        total, n = f.mcus[0] * f.mcus[1], len(f.starts)
        own = values[:, lane : lane + n].transpose(1, 0, 2).reshape(-1, first_blocks)
        own = own[(np.arange(dc.shape[0])[None, :] < counts[lane : lane + n, None]).ravel()]
        lane += n
        out.append(own[:total] * f.quantisers[f.parts[0][3]])
    return out


def _raster(f: Frame, dc: np.ndarray) -> np.ndarray:
    """The thumbnail: a sample per 8x8 block of luminance."""
    across, down = f.mcus
    h, v = (f.parts[0][1], f.parts[0][2]) if len(f.parts) > 1 else (1, 1)
    grid = dc.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    top_h, top_v = (max(p[1] for p in f.parts), max(p[2] for p in f.parts)) if len(f.parts) > 1 else (1, 1)
    grid = grid[: -(-f.height * v // (8 * top_v)), : -(-f.width * h // (8 * top_h))]
    return np.clip((grid + 4) // 8 + 128, 0, 255).astype(np.uint8)


def images(media: list[bytes], most_samples: int = 1 << 18) -> list[list[tuple[np.ndarray, int, int]]]:
    """For each stored form its images: DC-only luminance thumbnail, width and height. Images follow each other; what follows the last
    one and doesn't begin another is passed over."""
    frames: list[Frame] = []
    owner: list[int] = []
    for i, data in enumerate(media):
        at = 0
        while at < len(data) and (not at or data[at : at + 2] == b"\xff\xd8"):
            frame, at = parse(data, at)
            frames.append(frame)
            owner.append(i)
    alike: dict[tuple, list[int]] = {}
    for k, f in enumerate(frames):
        kind = (tuple(tuple(p[1:3] + p[4:]) for p in f.parts), tuple(sorted(f.tables.items())))
        alike.setdefault(kind, []).append(k)
    made: dict[int, np.ndarray] = {}
    for own in alike.values():
        # lanes of a pool are laid out as wide as the longest, so those of a length go together
        longest = {k: min(frames[k].interval or 1 << 40, frames[k].mcus[0] * frames[k].mcus[1]) for k in own}
        pool: list[int] = []
        lanes = 0
        for k in [*sorted(own, key=longest.get), None]:
            if pool and (k is None or longest[k] * (lanes + len(frames[k].starts)) > most_samples):
                try:
                    found = _decode([frames[j] for j in pool])
                except IndexError as error:  # of a window behind the last byte
                    raise ValueError("not a baseline JPEG that can be read: a scan is too short") from error
                made.update((j, _raster(frames[j], dc)) for j, dc in zip(pool, found, strict=True))
                pool, lanes = [], 0
            if k is not None:
                pool.append(k)
                lanes += len(frames[k].starts)
    out: list[list[tuple[np.ndarray, int, int]]] = [[] for _ in media]
    for k, i in enumerate(owner):
        out[i].append((made[k], *frames[k].size))
    return out


def thumbnails(media: list[bytes], most_samples: int = 1 << 18) -> list[list[np.ndarray]]:
    """The thumbnails of images()."""
    return [[thumb for thumb, _, _ in found] for found in images(media, most_samples)]


def average_hash(thumb: np.ndarray) -> str:
    """64 bits: which cells of an 8x8 grid over the thumbnail are brighter than their mean."""
    down, across = thumb.shape
    if down % 8 == 0 and across % 8 == 0:
        cell = thumb.reshape(8, down // 8, 8 * (across // 8)).sum(1, dtype=np.int64).reshape(8, 8, across // 8).sum(2)
        return np.packbits(cell * 64 > cell.sum()).tobytes().hex()
    rows, cols = (np.linspace(0, n, 9).astype(int) for n in thumb.shape)
    total = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1), np.int64)
    total[1:, 1:] = thumb.astype(np.int64).cumsum(0).cumsum(1)
    low_r, low_c = np.minimum(rows[:-1], thumb.shape[0] - 1), np.minimum(cols[:-1], thumb.shape[1] - 1)
    high_r, high_c = np.maximum(rows[1:], low_r + 1), np.maximum(cols[1:], low_c + 1)
    cell = total[high_r][:, high_c] - total[low_r][:, high_c] - total[high_r][:, low_c] + total[low_r][:, low_c]
    mean = cell / ((high_r - low_r)[:, None] * (high_c - low_c)[None, :])
    return np.packbits(mean > mean.mean()).tobytes().hex()


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, 1, 2 << 20, 1000):
        raws = common.byte_values(batch.column(1))
        media = encode_all([padded(raw) for raw in raws])
        rows = []
        for raw, stored, thumbs in zip(raws, media, thumbnails(media), strict=True):
            payload = b"".join(t.tobytes() for t in thumbs)  # as read back from the stored bytes
            sizes = "+".join(f"{8 * t.shape[1]}x{8 * t.shape[0]}" for t in thumbs)
            rows.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), f"{sizes}:{'+'.join(map(average_hash, thumbs))}"))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        yield pa.record_batch([batch.column(0), *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)


def media_features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store each text as JPEG, read the stored bytes back, and give sizes, digests and the thumbnail's hash."""
    kind = common.ddl(docs.schema[key].dataType)
    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(F.col(key), F.col(text)).transform(common.in_arrow, _features, schema).withColumnRenamed("id", key)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, 1, 4 << 20):
        yield pa.record_batch([batch.column(0), pa.array(encode_all([padded(x) for x in common.byte_values(batch.column(1))]), pa.binary())], ["id", "media"])


def media_column(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, media): the stored form of each text, as a binary column to write where one likes."""
    return docs.select(F.col(key), F.col(text)).transform(common.in_arrow, _stored, f"id {common.ddl(docs.schema[key].dataType)}, media binary").withColumnRenamed("id", key)


def _images_or_fault(data: bytes) -> tuple[list[tuple[np.ndarray, int, int]], str | None]:
    try:
        return images([data])[0], None
    except ValueError as error:
        return [], str(error)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, 1, 4 << 20):
        at, rows = [], []
        values = common.byte_values(batch.column(1))
        try:
            found = [(own, None) for own in images(values)]
        except ValueError:  # one of them can't be read: each for itself
            found = [_images_or_fault(x) for x in values]
        for i, (own, fault) in enumerate(found):
            if fault:
                at.append(i)
                rows.append((None, None, None, None, None, fault))
            for image, (t, width, height) in enumerate(own):
                at.append(i)
                rows.append((image, width, height, t.tobytes(), average_hash(t), None))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())
        yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int32())), *(pa.array(x, k) for x, k in zip(cols, kinds, strict=True))], ["id", "image", "width", "height", "thumbnail", "hash", "error"])


def read_media(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """(key, image, width, height, thumbnail, hash, error): a row per image of each stored form, with the size that its
    frame says (the thumbnail has a sample per block of 8 x 8, begun ones included); a null or empty value has none. A value that can't be read has one row, with an error and nothing else."""
    kind = common.ddl(media.schema[key].dataType)
    return media.select(F.col(key), F.col(column)).transform(common.in_arrow, _read, f"id {kind}, image int, width int, height int, thumbnail binary, hash string, error string").withColumnRenamed("id", key)
