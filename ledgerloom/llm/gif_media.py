"""GIF media columns: LZW code streams, palettes, disposal and transparency, timed frames with colour histograms.

``encode`` stores a payload as frames of 24 by 24 samples (576 bytes a frame, grey palette). Each frame is an LZW stream whose codes
grow from 9 bits on as the table of repeated runs grows. A frame stays on the canvas for the next one (disposal 1), which writes its
transparent index where the canvas already shows the right sample, provided that the frame leaves an index unused.
``decode`` reads any GIF87a/89a stream: global and local palettes, interlacing, transparency, disposal methods and
frame delays; its frames are full canvases, after the rules for what stays of earlier frames. ``media`` reads its payload
from these canvases, and ``frames`` gives one row for each timed frame.

The widths of the codes between two clear codes follow from their number, so codes are packed and unpacked as arrays. Frames whose table
can't fill up are encoded and decoded side by side, one pixel or code of all of them at a time, with a table of runs for each; other
frames and streams, and streams that turn out to be damaged, go one by one through ``lzw_encode`` and ``lzw_decode``.

Defined cases: a null or empty text is one frame of 255; frames are never dropped; a stream that ends
early or holds a code outside its table raises ValueError instead of giving fewer or other pixels; an empty table gives
an empty result; rows with one doc_id are stored one by one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = 24
FRAME = SIDE * SIDE
#: The payload bytes at its end that have a checksum of their own.
TAIL = 32
DELAY = 4  # hundredths of a second
_GREY = bytes(v for i in range(256) for v in (i, i, i))
_FULL = 4096  # entries of a table that grows no further
#: Frames that are worked on side by side, and the pixels of which a table of 8-bit samples can't fill up.
ABREAST, _MOST = 2048, _FULL - 258
#: Codes that one step unpacks.
_STEP = 1 << 14


@dataclass
class Frame:
    delay: int  # hundredths of a second
    disposal: int
    rgb: np.ndarray  # height, width, 3: the canvas as shown
    index: np.ndarray  # height, width: the frame's own palette indexes


# --- LZW -------------------------------------------------------------------------------------------------

_widths: dict[int, np.ndarray] = {}


def _width(size: int, n: int, since: int = 0) -> np.ndarray:
    """The widths of n codes, of which ``since`` came before them since the last clear code.

    A reader's table has 2**size + 2 entries when it reads the first code and the second, and one more before each later one.
    """
    if size not in _widths:
        table = (1 << size) + 1 + np.maximum(np.arange(_FULL), 1)
        _widths[size] = np.clip(np.floor(np.log2(table)).astype(np.int64) + 1, size + 1, 12)
    return _widths[size][np.minimum(np.arange(since, since + n), _FULL - 1)]


def _places(size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First bit and width of the first n codes of a stream that starts with its only clear code."""
    width = np.concatenate([_width(size, 1), _width(size, n)])[:n]
    return np.cumsum(width) - width, width


def lzw_encode(pixels: bytes, size: int) -> bytes:
    """The code stream of pixels below 2**size: a clear code first, and again whenever the table is full; a stop code last."""
    clear = 1 << size
    codes: list[int] = [clear]
    starts = [0, 1]  # codes since the last clear code are counted from here
    at, n = 0, len(pixels)
    while at < n:
        table: dict[int, int] = {}
        get, add, top, now = table.get, codes.append, clear + 2, pixels[at]
        for at, b in enumerate(pixels[at + 1 :], at + 1):
            run = now << 8 | b
            if code := get(run):
                now = code
                continue
            add(now)
            if top == _FULL:
                add(clear)
                starts.append(len(codes))
                break
            table[run] = top
            top += 1
            now = b
        else:
            add(now)
            break
    codes.append(clear + 1)
    ends = [*starts[1:], len(codes)]
    width = np.concatenate([_width(size, b - a) for a, b in zip(starts, ends, strict=True)])
    end = np.cumsum(width)
    at = end - width
    value = np.array(codes, dtype=np.int64) << (at & 7)
    out = np.zeros(int(end[-1] + 7 >> 3) + 2, dtype=np.int64)
    for k in range(3):  # a code reaches into three bytes at most; no two codes share a bit, so sums are unions
        out += np.bincount((at >> 3) + k, weights=(value >> 8 * k) & 255, minlength=len(out)).astype(np.int64)
    return out[:-2].astype(np.uint8).tobytes()


def _code_runs(data: bytes, size: int) -> Iterator[tuple[list[int], bool]]:
    """The codes of a stream in runs, and whether a clear code came before a run; a stop code or the stream's end ends it."""
    raw = np.zeros(len(data) + 3, dtype=np.int64)
    raw[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    bit, since, cleared, clear, bits, step = 0, 0, True, 1 << size, 8 * len(data), 1024
    while True:
        width = _width(size, min(step, bits - bit), since)
        end = bit + np.cumsum(width)
        end, width = end[end <= bits], width[: int(np.searchsorted(end, bits, side="right"))]
        at = end - width
        codes = ((raw[at >> 3] | raw[(at >> 3) + 1] << 8 | raw[(at >> 3) + 2] << 16) >> (at & 7)) & ((1 << width) - 1)
        marks = np.flatnonzero((codes == clear) | (codes == clear + 1))
        n = int(marks[0]) if len(marks) else len(codes)
        if n:
            yield codes[:n].tolist(), cleared
        if n == len(codes):
            if not n:
                return
            bit, since, cleared, step = int(end[-1]), since + n, False, min(2 * step, _STEP)
        elif codes[n] == clear:
            bit, since, cleared, step = int(end[n]), 0, True, 1024
        else:
            return


def lzw_decode(data: bytes, size: int, pixels: int) -> np.ndarray:
    """The pixels of a code stream: codes of growing width, clear and stop codes, and codes that are defined while read."""
    base = [bytes([i]) for i in range(1 << size)] + [b"", b""]
    table, out, last, made = base, [], b"", 0
    for codes, cleared in _code_runs(data, size):
        if cleared:
            if codes[0] >> size:
                raise ValueError("a code outside the table")
            table, last = list(base), base[codes[0]]
            out.append(last)
            del codes[0]
        room = _FULL - len(table)
        define, show = table.append, out.append
        for code in codes[:room]:
            try:
                entry = table[code]
                define(last + entry[:1])
            except IndexError:  # the entry that this very code defines
                if code != len(table):
                    raise ValueError("a code outside the table") from None
                entry = last + last[:1]
                define(entry)
            show(entry)
            last = entry
        out += [table[code] for code in codes[room:]]
        made = sum(map(len, out))
        if made >= pixels:
            break
    if made < pixels:
        raise ValueError(f"the code stream holds {made} of {pixels} pixels")
    return np.frombuffer(b"".join(out)[:pixels], dtype=np.uint8)


def _encode_abreast(pixels: np.ndarray) -> list[bytes]:
    """The code streams of rows of at most ``_MOST`` 8-bit pixels."""
    n, m = pixels.shape
    slots = 1 << max(4, (4 * m).bit_length() - 1)
    runs = np.zeros(n * slots, dtype=np.uint32)  # of each row: run << 12 | code, at a place by the run's hash or the next free one
    home = np.arange(n, dtype=np.int64) * slots
    codes = np.full((m + 2, n), 257, dtype=np.int64)  # a row of codes by number
    codes[0] = 256
    made, top, now = np.ones(n, dtype=np.int64), np.full(n, 258, dtype=np.int64), pixels[:, 0].astype(np.int64)
    for b in pixels.T[1:].astype(np.int64):
        run = now << 8 | b
        slot = home + ((run * 0x9E3779B1 >> 12) & (slots - 1))
        found = runs[slot].astype(np.int64)
        other = np.flatnonzero((found != 0) & (found >> 12 != run))
        while len(other):  # taken by another run: on to the next place
            slot[other] = home[other] + ((slot[other] + 1) & (slots - 1))
            found[other] = there = runs[slot[other]].astype(np.int64)
            other = other[(there != 0) & (there >> 12 != run[other])]
        new = np.flatnonzero(found == 0)
        codes[made[new], new] = now[new]
        runs[slot[new]] = run[new] << 12 | top[new]
        made[new] += 1
        top[new] += 1
        now = np.where(found == 0, b, found & 0xFFF)
    codes[made, np.arange(n)] = now
    made += 2  # the last run and the stop code
    first, width = _places(8, m + 2)
    used = int(made.max())
    out = np.zeros((int(first[used - 1] + width[used - 1] >> 3) + 3, n), dtype=np.int64)
    for k in range(used):  # codes after the stop code lie beyond the row's last byte, or are shifted out of it below
        value = np.where(k < made, codes[k], 0) << int(first[k] & 7)
        at = int(first[k] >> 3)
        out[at : at + 3] |= np.stack([value & 255, value >> 8 & 255, value >> 16])
    size = (first[made - 1] + width[made - 1] + 7) >> 3
    rows = np.ascontiguousarray(out.T.astype(np.uint8))
    return [row[:k].tobytes() for row, k in zip(rows, size.tolist(), strict=True)]


def _decode_abreast(streams: list[bytes], m: int) -> list[np.ndarray | None]:
    """The m 8-bit pixels of each stream; None for those that are not one clear code, codes of exactly m pixels, and a stop code."""
    n = len(streams)
    out: list[np.ndarray | None] = [None] * n
    first, width = _places(8, m + 2)
    raw = np.zeros((n, int(first[-1] + width[-1] >> 3) + 3), dtype=np.int64)
    for row, stream in zip(raw, streams, strict=True):
        row[: len(stream)] = np.frombuffer(stream, dtype=np.uint8)[: raw.shape[1]]
    raw = np.ascontiguousarray(raw.T)
    at = first >> 3
    codes = ((raw[at] | raw[at + 1] << 8 | raw[at + 2] << 16) >> (first & 7)[:, None]) & ((1 << width) - 1)[:, None]
    stop = np.argmax(codes == 257, axis=0)
    ends = np.array([8 * len(x) for x in streams])
    good = (codes[0] == 256) & (stop > 1) & (first[stop] + width[stop] <= ends)
    codes = codes[1 : int(stop.max(initial=1)) + 1]
    within = np.arange(len(codes))[:, None] < stop - 1
    entry, plain = codes - 258, codes < 256
    # Code j stands for a sample or for an entry below j: the codes before it define as many.
    good &= (~within | plain | ((entry >= 0) & (entry < np.arange(len(codes))[:, None]))).all(axis=0)
    keep = np.flatnonzero(good)
    codes, entry, plain, within = (x[:, keep] for x in (codes, np.maximum(entry, 0), plain, within))
    rows = np.arange(len(keep))
    length = np.zeros(codes.shape, dtype=np.int64)
    for j in range(len(codes)):  # an entry is the run of its code and the first pixel after it
        length[j] = np.where(plain[j], 1, length[np.minimum(entry[j], max(j - 1, 0)), rows] + 1) * within[j]
    whole = length.sum(axis=0) == m
    keep, codes, entry, plain, length = keep[whole], codes[:, whole], entry[:, whole], plain[:, whole], length[:, whole]
    if not len(keep):
        return out
    start = np.cumsum(length, axis=0) - length
    rows = np.arange(len(keep))
    # Each pixel is a sample, or equals an earlier pixel of its row: where the entry's run was shown first.
    source = np.where(plain, -1, start[np.minimum(entry, len(start) - 1), rows] - start)
    number = np.repeat(np.tile(np.arange(len(codes)), len(keep)), length.T.ravel()).reshape(len(keep), m).T
    source, sample = source[number, rows] + np.arange(m)[:, None] * ~plain[number, rows], codes[number, rows].astype(np.uint8)
    shown = np.empty((m, len(keep)), dtype=np.uint8)
    for k in range(m):
        shown[k] = np.where(source[k] < 0, sample[k], shown[np.maximum(source[k], 0), rows])
    for i, pixels in zip(keep.tolist(), np.ascontiguousarray(shown.T), strict=True):
        out[i] = pixels
    return out


# --- whole files -----------------------------------------------------------------------------------------


def encode_all(payloads: list[np.ndarray], side: int = SIDE) -> list[bytes]:
    """Each payload, of a positive multiple of side * side bytes, as one animated GIF."""
    size = side * side
    samples = np.concatenate(payloads).reshape(-1, size)
    frames = np.cumsum([0, *(len(x) // size for x in payloads)])
    n = len(samples)
    same = np.zeros(samples.shape, dtype=bool)
    same[1:] = samples[1:] == samples[:-1]
    same[frames[:-1]] = False
    free, clear = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    for at in range(0, n, ABREAST):
        part = samples[at : at + ABREAST]
        used = np.zeros((len(part), 256), dtype=bool)
        used[np.arange(len(part))[:, None], part] = True
        free[at : at + ABREAST] = np.argmin(used, axis=1)
        clear[at : at + ABREAST] = ~used.all(axis=1) & same[at : at + ABREAST].any(axis=1)
    index = np.where(same & clear[:, None], free[:, None], samples).astype(np.uint8)
    if size > _MOST:
        streams = [lzw_encode(row.tobytes(), 8) for row in index]
    else:
        streams = [x for at in range(0, n, ABREAST) for x in _encode_abreast(index[at : at + ABREAST])]
    head = b"GIF89a" + struct.pack("<HHBBB", side, side, 0b11110111, 0, 0) + _GREY
    image = b"\x00\x2c" + struct.pack("<HHHHB", 0, 0, side, side, 0) + b"\x08"
    out = []
    for a, b in zip(frames, frames[1:], strict=False):
        parts = [head]
        for codes, transparent, t in zip(streams[a:b], clear[a:b].tolist(), free[a:b].tolist(), strict=True):
            parts.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2 | transparent, DELAY, t if transparent else 0) + image)
            for at in range(0, len(codes), 255):
                parts += [bytes([min(255, len(codes) - at)]), codes[at : at + 255]]
            parts.append(b"\x00")
        out.append(b"".join(parts) + b"\x3b")
    return out


def encode(payload: np.ndarray, side: int = SIDE) -> bytes:
    return encode_all([payload], side)[0]


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def parse(data: bytes) -> tuple[int, int, bytes | None, int, list[dict]]:
    """Width, height, global palette, background index, and the image records with their control values."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, background, _ = struct.unpack("<HHBBB", data[6:13])
    at, palette = 13, None
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        palette, at = data[at : at + n], at + n
    images, control = [], (0, 0, None)
    while data[at] != 0x3B:
        if data[at] == 0x21:
            if data[at + 1] == 0xF9:
                f, delay, transparent = struct.unpack("<BHB", data[at + 3 : at + 7])
                control = ((f >> 2) & 7, delay, transparent if f & 1 else None)
            _, at = _sub_blocks(data, at + 2)
        elif data[at] == 0x2C:
            x, y, w, h, f = struct.unpack("<HHHHB", data[at + 1 : at + 10])
            at, own = at + 10, None
            if f & 0x80:
                n = 3 << ((f & 7) + 1)
                own, at = data[at : at + n], at + n
            size = data[at]
            codes, at = _sub_blocks(data, at + 1)
            images.append({"box": (x, y, w, h), "interlaced": bool(f & 0x40), "palette": own, "size": size, "codes": codes, "disposal": control[0], "delay": control[1], "transparent": control[2]})
            control = (0, 0, None)
        else:
            raise ValueError("an unknown block")
    return width, height, palette, background, images


def indexes(images: Iterable[dict]) -> Iterator[np.ndarray]:
    """The palette indexes of each image, in rows."""
    for part in batched(images, ABREAST):
        found: list[np.ndarray | None] = [None] * len(part)
        alike: dict[int, list[int]] = {}
        for i, m in enumerate(part):
            pixels = m["box"][2] * m["box"][3]
            if m["size"] == 8 and 0 < pixels <= _MOST:
                alike.setdefault(pixels, []).append(i)
        for pixels, which in alike.items():
            for i, index in zip(which, _decode_abreast([part[i]["codes"] for i in which], pixels), strict=True):
                found[i] = index
        for m, index in zip(part, found, strict=True):
            _, _, w, h = m["box"]
            index = (lzw_decode(m["codes"], m["size"], w * h) if index is None else index).reshape(h, w)
            if m["interlaced"]:
                rows = [r for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(start, h, step)]
                index = index[np.argsort(rows)]
            yield index


def _colours(palette: bytes) -> np.ndarray:
    out = np.zeros((256, 3), dtype=np.uint8)
    out[: len(palette) // 3] = np.frombuffer(palette, dtype=np.uint8).reshape(-1, 3)
    return out


def decode(data: bytes) -> Iterator[Frame]:
    """The timed frames of a file as shown."""
    file = parse(data)
    return shown(file, indexes(file[4]))


def shown(file: tuple, found: Iterator[np.ndarray]) -> Iterator[Frame]:
    """The frames of a parsed file: palettes, transparency, and what each disposal method leaves of the frame before."""
    width, height, shared, _, images = file
    canvas = np.zeros((height, width, 3), dtype=np.uint8)
    of_all = _colours(shared) if shared is not None else None
    for m in images:
        index = next(found)
        x, y, w, h = m["box"]
        colours = _colours(m["palette"]) if m["palette"] is not None else of_all
        if colours is None:
            raise ValueError("an image without a palette")
        before = canvas.copy() if m["disposal"] == 3 else None
        place = canvas[y : y + h, x : x + w]
        if m["transparent"] is None:
            place[:] = colours[index]
        else:
            np.copyto(place, colours[index], where=(index != m["transparent"])[:, :, None])
        yield Frame(m["delay"], m["disposal"], canvas.copy(), index)
        if m["disposal"] == 2:
            place[:] = 0
        elif before is not None:
            canvas = before


def histogram(rgb: np.ndarray) -> np.ndarray:
    """Counts of 16 equal ranges of each of the channels red, green and blue: 48 numbers."""
    return np.bincount(((rgb >> 4) + np.array([0, 16, 32], dtype=np.uint8)).ravel(), minlength=48)


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, duration_ms long"


def media(docs: DataFrame, with_bytes: bool = False) -> DataFrame:
    """Each text stored as a GIF and read back from its canvases: digests, frame timing and the colour histogram of all frames as a feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            sizes = [max(1, -(-len(x) // FRAME)) for x in texts]
            at = 0
            while at < len(texts):  # files of about ABREAST frames in all at a time
                to, held = at + 1, sizes[at]
                while to < len(texts) and held + sizes[to] <= ABREAST:
                    held, to = held + sizes[to], to + 1
                part = texts[at:to]
                stored = encode_all([np.frombuffer(x.ljust(n * FRAME, b"\xff"), dtype=np.uint8) for x, n in zip(part, sizes[at:to], strict=True)])
                files = [parse(x) for x in stored]
                found, rows = indexes(m for f in files for m in f[4]), []
                for doc_id, raw, data, file in zip(ids[at:to], part, stored, files, strict=True):
                    digest, counts, n, last, duration = hashlib.sha256(), np.zeros(48, dtype=np.int64), 0, b"", 0
                    for frame in shown(file, found):
                        last = frame.rgb[:, :, 0].tobytes()
                        digest.update(last)
                        counts += histogram(frame.rgb)
                        n, duration = n + 1, duration + 10 * frame.delay
                    row = (doc_id, len(raw), n * len(last), digest.hexdigest(), zlib.crc32(last[-TAIL:]), len(data), hashlib.sha256(data).hexdigest(), ",".join(map(str, counts)), n, duration)
                    rows.append((*row, data) if with_bytes else row)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                at = to

    names = [c.split()[0] for c in SCHEMA.split(", ")] + ["media"] * with_bytes
    types = [pa.string() if c.endswith("string") else pa.int64() for c in SCHEMA.split(", ")] + [pa.binary()] * with_bytes
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA + ", media binary" * with_bytes)


FRAMES = "doc_id long, frame long, at_ms long, delay_ms long, disposal long, width long, height long, red array<long>, green array<long>, blue array<long>, rgb binary"


def frames(stored: DataFrame) -> DataFrame:
    """One row for each timed frame of stored(doc_id, media): when it is shown, its colour histogram by channel, and the canvas."""
    longs = pa.list_(pa.int64())
    types = [pa.int64()] * 7 + [longs] * 3 + [pa.binary()]
    names = [c.split()[0] for c in FRAMES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            rows: list[tuple] = []
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True):
                at = 0
                for k, frame in enumerate(decode(data)):
                    red, green, blue = histogram(frame.rgb).reshape(3, 16).tolist()
                    rows.append((doc_id, k, at, 10 * frame.delay, frame.disposal, frame.rgb.shape[1], frame.rgb.shape[0], red, green, blue, frame.rgb.tobytes()))
                    at += 10 * frame.delay
                    if len(rows) == 256:
                        yield made(rows)
                        rows = []
            if rows:
                yield made(rows)

    return stored.where("media is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("media").cast("binary").alias("media")).mapInArrow(run, FRAMES)
