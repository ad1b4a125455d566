"""GIF columns: LZW code streams, palettes, disposal, transparency and timed frames, with colour histograms.

`parse` reads a file's blocks, `lzw_decode` its code streams, `frames` composes the canvas as a viewer would: each frame
is drawn through its palette, leaving transparent samples as they were, and is disposed of before the next (kept, cleared
to nothing, or undone). `write` makes files whose frames hold samples losslessly.

LZW decoding works on whole runs between clear codes: a code's string is a slice of what has been written already (the
string of the code before the entry was made, and one more sample), so lengths and places are found first and samples
are then copied by following each place back to a literal, all at once.

Results for odd input: a null or empty file, one that isn't a GIF, or one cut short has status `error: ...` and the
frames read before that point; one whose canvas is over MOST_CANVAS samples has such a status and no frames; a null text is an empty one; rows are handled one by one, so repeated rows, null ids and
ties have no effect on each other; an empty table gives none; columns other than those named are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from proselens.llm import shared, tokens

MOST_CODES = 4096
#: Rows of samples in one frame of a payload's file.
FRAME_ROWS = 1024
WIDTH = 64
#: Samples of a canvas or a frame, at most: a header may claim 65,535 by 65,535 in a file of 30 bytes. A larger one has a
#: status that says so.
MOST_CANVAS = 1 << 26


def _code_bits(min_size: int, n: int) -> np.ndarray:
    """Bits of each of `n` codes after a clear code, as a reader counts them: entry k is known once k + 1 codes are read."""
    free = (1 << min_size) + 2 + np.maximum(np.arange(n) - 1, 0)  # the width grows with the next free entry
    return np.minimum(np.maximum(np.ceil(np.log2(free + 1)).astype(np.int64), min_size + 1), 12)


_bits_kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_SPAN = MOST_CODES + 512
_FULL_WIDTH, _FULL_STARTS = np.full(_SPAN, 12), 12 * np.arange(_SPAN + 1)


def _bits(min_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths of codes after a clear code, and the bit at which each starts."""
    if min_size not in _bits_kept:
        width = _code_bits(min_size, _SPAN)
        _bits_kept[min_size] = width, np.concatenate([[0], np.cumsum(width)])
    return _bits_kept[min_size]


def _read_codes(padded: np.ndarray, at: np.ndarray, width: np.ndarray) -> np.ndarray:
    byte = at >> 3
    word = padded[byte].astype(np.uint32) | padded[byte + 1].astype(np.uint32) << 8 | padded[byte + 2].astype(np.uint32) << 16
    return (word >> (at & 7).astype(np.uint32) & ((1 << width) - 1).astype(np.uint32)).astype(np.int64)


def _expand(codes: np.ndarray, min_size: int) -> np.ndarray:
    """Samples of the codes of one run between clear codes."""
    n, first = len(codes), (1 << min_size) + 2
    made = codes - first  # the entry's index: made by codes `made` and `made + 1`
    if (made >= np.arange(n)).any() or ((codes >= first - 2) & (codes < first)).any():
        raise ValueError("a code that isn't known yet")
    literal = made < 0
    # a code's length is one more than that of code `made`; follow the chain by doubling
    parent = np.where(literal, np.arange(n), made)
    depth = (~literal).astype(np.int64)
    while True:
        step = depth[parent]
        if not step.any():
            break
        depth = depth + step
        parent = parent[parent]
    length = depth + 1
    place = np.concatenate([[0], np.cumsum(length)])
    total = int(place[-1])
    owner = np.repeat(np.arange(n), length)
    source = np.arange(total)
    back = ~literal[owner]
    source[back] = place[made[owner[back]]] + source[back] - place[owner[back]]
    while True:
        following = source[source]
        if (following == source).all():
            break
        source = following
    out = np.zeros(total, dtype=np.uint8)
    out[place[:-1][literal]] = codes[literal]
    return out[source]


def lzw_decode(data: bytes, min_size: int, most: int) -> np.ndarray:
    """Up to `most` samples of a code stream. A full table that isn't cleared stays as it is: its codes of 12 bits are read
    in windows, each expanded behind the codes that made the table."""
    if not 1 <= min_size <= 11:
        raise ValueError("code size out of range")
    clear, end = 1 << min_size, (1 << min_size) + 1
    width, starts = _bits(min_size)
    padded = np.frombuffer(data + b"\0\0\0\0", dtype=np.uint8)
    bits, at, parts, have = 8 * len(data), 0, [], 0
    full, behind = np.zeros(0, dtype=np.int64), 0  # the codes that made a table that is full, and their samples
    while have < most:
        begins, wide = (_FULL_STARTS, _FULL_WIDTH) if len(full) else (starts, width)
        n = min(int(np.searchsorted(begins, bits - at, side="right")) - 1, _SPAN)
        if n <= 0:
            break
        codes = _read_codes(padded, at + begins[:n], wide[:n])
        stops = np.flatnonzero((codes == clear) | (codes == end))
        run = codes[: stops[0]] if len(stops) else codes
        if len(run):
            if (run >= MOST_CODES).any():
                raise ValueError("a code that isn't known yet")
            parts.append(_expand(np.concatenate([full, run]), min_size)[behind:])
            have += len(parts[-1])
        if not len(stops):
            if n < _SPAN:
                break
            at += int(begins[n])
            if not len(full):
                full, behind = run, len(parts[-1])
            continue
        at += int(begins[stops[0] + 1])
        full, behind = full[:0], 0
        if codes[stops[0]] == end:
            break
    out = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint8)
    return out[:most]


def lzw_encode(samples: bytes, min_size: int = 8) -> bytes:
    """A code stream for `samples`; the table is cleared when full."""
    clear, end = 1 << min_size, (1 << min_size) + 1
    codes, width = [clear], []
    table: dict[int, int] = {}
    runs, at, free = [], 1, end + 1
    held = -1
    put, get = codes.append, table.get
    for c in samples:
        if held < 0:
            held = c
            continue
        key = held << 8 | c
        known = get(key)
        if known is not None:
            held = known
            continue
        put(held)
        table[key] = free
        free += 1
        held = c
        if free == MOST_CODES:
            put(held)
            put(clear)
            runs.append(len(codes) - at)
            at = len(codes)
            table.clear()
            free, held = end + 1, -1
    if held >= 0:
        put(held)
    put(end)
    runs.append(len(codes) - at)
    widths = _bits(min_size)[0]
    width = np.concatenate([[min_size + 1], *[widths[:r] for r in runs]])
    value = np.array(codes, dtype=np.uint32)
    lit = (value[:, None] >> np.arange(12, dtype=np.uint32) & 1).astype(np.uint8)
    return np.packbits(lit[np.arange(12) < width[:, None]], bitorder="little").tobytes()


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    transparent: int  # -1: none
    palette: np.ndarray
    samples: np.ndarray  # (height, width) indices


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        n = data[at]
        if not n:
            return b"".join(parts), at + 1
        if at + 1 + n >= len(data):
            raise ValueError("cut short")
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n


def parse(data: bytes | None) -> tuple[int, int, list[Frame], str]:
    """Canvas width and height, the frames, and `ok` or what is wrong."""
    found: list[Frame] = []
    if not data or data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        return 0, 0, found, "error: not a GIF"
    width, height, flags = struct.unpack("<HHB", data[6:11])
    at, whole = 13, np.zeros((0, 3), dtype=np.uint8)
    try:
        if flags & 128:
            n = 2 << (flags & 7)
            whole = np.frombuffer(data, np.uint8, 3 * n, at).reshape(-1, 3)
            at += 3 * n
        delay, disposal, transparent = 0, 0, -1
        while True:
            kind = data[at]
            if kind == 0x3B:
                return width, height, found, "ok"
            if kind == 0x21:
                label = data[at + 1]
                body, at = _sub_blocks(data, at + 2)
                if label == 0xF9 and len(body) >= 4:
                    delay, disposal = struct.unpack("<H", body[1:3])[0] * 10, body[0] >> 2 & 7
                    transparent = body[3] if body[0] & 1 else -1
                continue
            if kind != 0x2C:
                raise ValueError("an unknown block")
            left, top, w, h, local = struct.unpack("<HHHHB", data[at + 1 : at + 10])
            at += 10
            palette = whole
            if local & 128:
                n = 2 << (local & 7)
                palette = np.frombuffer(data, np.uint8, 3 * n, at).reshape(-1, 3)
                at += 3 * n
            min_size = data[at]
            stream, at = _sub_blocks(data, at + 1)
            if w * h > MOST_CANVAS:
                raise ValueError("a frame is too large")
            flat = lzw_decode(stream, min_size, w * h)
            if len(flat) < w * h:
                raise ValueError("cut short")
            rows = flat.reshape(h, w)
            if local & 64:
                order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
                straight = np.empty_like(rows)
                straight[order] = rows
                rows = straight
            found.append(Frame(left, top, w, h, delay, disposal, transparent, palette, rows))
            delay, disposal, transparent = 0, 0, -1
    except (ValueError, IndexError, struct.error) as e:
        return width, height, found, f"error: {e if isinstance(e, ValueError) else 'cut short'}"


def composed(width: int, height: int, found: list[Frame]):
    """The canvas (height, width, RGBA) as shown with each frame."""
    canvas = np.zeros((height, width, 4), dtype=np.uint8)
    for f in found:
        before = canvas.copy() if f.disposal == 3 else None
        h, w = max(0, min(f.height, height - f.top)), max(0, min(f.width, width - f.left))
        samples = f.samples[:h, :w]
        colours = np.zeros((256, 4), dtype=np.uint8)
        colours[: len(f.palette), :3] = f.palette[:256]
        colours[:, 3] = 255
        drawn = samples != f.transparent
        region = canvas[f.top : f.top + h, f.left : f.left + w]
        region[drawn] = colours[samples[drawn]]
        yield canvas
        if f.disposal == 2:
            canvas[f.top : f.top + h, f.left : f.left + w] = 0
        elif before is not None:
            canvas = before


def histogram(rgba: np.ndarray) -> list[int]:
    """Counts of opaque samples in 64 colours (two bits a channel), then of transparent ones."""
    seen = rgba.reshape(-1, 4)
    opaque = seen[seen[:, 3] > 0] >> 6
    index = opaque[:, 0].astype(np.int64) << 4 | opaque[:, 1] << 2 | opaque[:, 2]
    return [*np.bincount(index, minlength=64).tolist(), int(len(seen) - len(opaque))]


_GREY = bytes(x for v in range(256) for x in (v, v, v))


def write(samples: list[np.ndarray], palette: bytes = _GREY, delay_ms: int = 100, disposal: int = 1) -> bytes:
    """A GIF of 8-bit frames, each an array (rows, columns) drawn at the upper left."""
    height, width = max(s.shape[0] for s in samples), max(s.shape[1] for s in samples)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette]
    if len(samples) > 1:
        out.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00")
    for s in samples:
        out += [b"\x21\xf9\x04", struct.pack("<BHB", disposal << 2, delay_ms // 10, 0), b"\0", struct.pack("<BHHHHB", 0x2C, 0, 0, s.shape[1], s.shape[0], 0), b"\x08"]
        stream = lzw_encode(s.tobytes())
        for at in range(0, len(stream), 255):
            piece = stream[at : at + 255]
            out += [bytes([len(piece)]), piece]
        out.append(b"\0")
    out.append(b";")
    return b"".join(out)


def payload(text: str) -> tuple[bytes, int]:
    data = text.encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH)), len(data)


def stored(data: bytes) -> bytes:
    """A payload (a multiple of WIDTH bytes) as the grey samples of a GIF, FRAME_ROWS rows a frame."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    return write([rows[a : a + FRAME_ROWS] for a in range(0, len(rows), FRAME_ROWS)])


def read_back(media: bytes) -> bytes:
    """The payload of a file of `stored`: each frame's part of the composed canvas, as grey."""
    width, height, found, status = parse(media)
    if status != "ok":
        raise ValueError(status)
    return b"".join(canvas[f.top : f.top + f.height, f.left : f.left + f.width, 0].tobytes() for f, canvas in zip(found, composed(width, height, found)))


def texts_as_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the GIF of each text's payload."""

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in tokens.in_bytes(texts, 1 << 21):
                made = [(n, stored(data)) for data, n in map(payload, texts[a:b])]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array([n for n, _ in made], pa.int64()), pa.array([m for _, m in made], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return shared.id_text(docs).mapInArrow(rows, "doc_id long, n_bytes long, media binary")


FRAME_SCHEMA = "media_id long, status string, frame int, start_ms long, delay_ms int, left int, top int, width int, height int, disposal int, transparent int, rgba binary, histogram array<long>"


def frames(files: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """A row a frame of every GIF: its place, its time, the canvas as shown (RGBA) and its colour histogram. A file
    without frames has one row, whose frame is null."""

    def rows(batches):
        import pyarrow as pa

        i32, i64 = pa.int32(), pa.int64()
        schema = pa.schema([("media_id", i64), ("status", pa.string()), ("frame", i32), ("start_ms", i64), *[(x, i32) for x in ("delay_ms", "left", "top", "width", "height", "disposal", "transparent")], ("rgba", pa.binary()), ("histogram", pa.list_(i64))])
        for batch in batches:
            for media_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                width, height, found, status = parse(data)
                if width * height > MOST_CANVAS:
                    found, status = [], "error: the canvas is too large"
                if not found:
                    yield pa.RecordBatch.from_pylist([{"media_id": media_id, "status": status}], schema=schema)
                start = 0
                for k, (f, canvas) in enumerate(zip(found, composed(width, height, found))):
                    yield pa.RecordBatch.from_pylist([{"media_id": media_id, "status": status, "frame": k, "start_ms": start, "delay_ms": f.delay_ms, "left": f.left, "top": f.top, "width": f.width, "height": f.height, "disposal": f.disposal, "transparent": f.transparent, "rgba": canvas.tobytes(), "histogram": histogram(canvas)}], schema=schema)
                    start += f.delay_ms

    return files.select(files[id_col].cast("long").alias("media_id"), files[media_col].alias("media")).mapInArrow(rows, FRAME_SCHEMA)


def digests(media: DataFrame) -> DataFrame:
    """Digest columns of files made by `texts_as_media`, from the samples read back."""

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            ids, n_bytes, files = (batch.column(i) for i in range(3))
            out = []
            for gif in files.to_pylist():
                width, height, found, status = parse(gif)
                if status != "ok":
                    raise ValueError(status)
                parts, counts = [], np.zeros(16, dtype=np.int64)
                for f, canvas in zip(found, composed(width, height, found)):
                    grey = canvas[f.top : f.top + f.height, f.left : f.left + f.width, 0]
                    parts.append(grey.tobytes())
                    counts += np.bincount(grey.reshape(-1) >> 4, minlength=16)
                data = b"".join(parts)
                feature = f"{len(found)}f;{sum(f.delay_ms for f in found)}ms;" + ",".join(map(str, counts.tolist()))
                out.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(gif), hashlib.sha256(gif).hexdigest(), feature))
            cells = list(zip(*out)) or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([ids, n_bytes, *[pa.array(list(c), k) for c, k in zip(cells, kinds)]], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(rows, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
