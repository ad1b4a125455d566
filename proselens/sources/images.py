"""Front end for images: metadata fields of PNG, JPEG and WebP, and luma crops of PNG, as rows."""

from __future__ import annotations

import re
import struct
import zlib

from pyspark.sql import DataFrame

MOST_FIELDS, MOST_BYTES = 256, 64 << 10
SCHEMA = "path string, format string, k int, key string, value string, offset long, compressed boolean"
_RUNS = re.compile(rb"[\x20-\x7e]{4,}")


def printable(data: bytes) -> str:
    return b"\n".join(_RUNS.findall(data))[:MOST_BYTES].decode("ascii")


def sniff(data: bytes) -> str | None:
    """The format by its first bytes, whatever the name says."""
    if data.startswith(b"RIFF"):
        return "webp" if data[8:12] == b"WEBP" else None
    return next((kind for kind, first in (("jpeg", b"\xff\xd8\xff"), ("png", b"\x89PNG\r\n\x1a\n")) if data.startswith(first)), None)


def png_chunks(data: bytes):
    at = 8
    while at + 12 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if not kind.isalpha() or at + 12 + size > len(data):
            return
        yield kind, data[at + 8 : at + 8 + size], at
        if kind == b"IEND":
            return
        at += 12 + size


def fields(data: bytes) -> tuple[str | None, list[tuple[str, str, int, bool]]]:
    """The format and (key, value, offset, compressed) of each field. A cut record ends the scan."""
    kind, out = sniff(data), []
    text = lambda b: b[:MOST_BYTES].decode("utf-8", "replace")
    if kind == "png":
        for name, body, at in png_chunks(data):
            key, _, rest = body.partition(b"\0")
            if name == b"tEXt":
                out.append((text(key), text(rest), at, False))
            elif name == b"zTXt":
                out.append((text(key), "", at, True))
            elif name == b"iTXt" and len(rest) >= 2:
                parts = rest[2:].split(b"\0", 2)
                out.append((text(key), "" if rest[0] else text(parts[-1]), at, bool(rest[0])))
            elif name in (b"caBX", b"eXIf"):
                out.append((name.decode(), printable(body), at, False))
    elif kind == "jpeg":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF:
            mark = data[at + 1]
            if mark == 0xFF:
                at += 1
                continue
            if mark == 0xDA:
                break
            if mark == 1 or 0xD0 <= mark <= 0xD8:
                at += 2
                continue
            size = struct.unpack(">H", data[at + 2 : at + 4])[0]
            body = data[at + 4 : at + 2 + size]
            if size < 2 or at + 2 + size > len(data):
                break
            if mark == 0xE1 and body.startswith(b"Exif\0\0"):
                out.append(("exif", printable(body[6:]), at, False))
            elif mark == 0xE1 and body.startswith(b"http://ns.adobe.com/xap/1.0/\0"):
                out.append(("xmp", text(body[29:]), at, False))
            elif mark == 0xEB and (b"jumb" in body or b"c2pa" in body):
                out.append(("c2pa", printable(body), at, False))
            elif mark == 0xED and body.startswith(b"Photoshop 3.0\0"):
                out.append(("iptc", printable(body[14:]), at, False))
            at += 2 + size
    elif kind == "webp":
        at = 12
        while at + 8 <= len(data):
            name, size = struct.unpack("<4sI", data[at : at + 8])
            body = data[at + 8 : at + 8 + size]
            if len(body) < size:
                break
            if name == b"EXIF":
                out.append(("exif", printable(body), at, False))
            elif name == b"XMP ":
                out.append(("xmp", text(body), at, False))
            at += 8 + size + (size & 1)
    return kind, out[:MOST_FIELDS]


def luma(data: bytes, side: int = 256):
    """The centre of an 8-bit PNG as luma, `side` square; None where it is smaller, not a PNG, or another kind of one."""
    import numpy as np

    if sniff(data) != "png":
        return None
    head, body = None, b""
    for name, chunk, _ in png_chunks(data):
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif name == b"IDAT":
            body += chunk
    if not head or head[2] != 8 or head[3] not in (0, 2, 4, 6) or head[6] or min(head[:2]) < side or head[0] * head[1] > 64_000_000:
        return None
    width, height, channels = head[0], head[1], {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    try:
        raw = np.frombuffer(zlib.decompress(body), np.uint8)[: height * (width * channels + 1)].reshape(height, -1)
    except (zlib.error, ValueError):
        return None
    done = np.zeros((height, width * channels), dtype=np.uint8)
    for y in range(height):
        how, row = int(raw[y, 0]), raw[y, 1:].astype(np.int64)
        up = done[y - 1].astype(np.int64) if y else np.zeros_like(row)
        if how == 0:
            done[y] = row
        elif how == 2:
            done[y] = row + up & 255
        elif how == 1:
            done[y] = (np.cumsum(row.reshape(width, channels), axis=0) & 255).reshape(-1)
        else:
            line = np.zeros(width * channels + channels, dtype=np.int64)
            above = np.concatenate([np.zeros(channels, dtype=np.int64), up])
            for x in range(channels, len(line)):
                a, b, c = int(line[x - channels]), int(above[x]), int(above[x - channels])
                if how == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
                line[x] = row[x - channels] + guess & 255
            done[y] = line[channels:]
    pixels = done.reshape(height, width, channels).astype(float)
    grey = pixels[..., 0] if channels < 3 else pixels[..., :3] @ np.array([0.299, 0.587, 0.114])
    top, left = (height - side) // 2, (width - side) // 2
    return grey[top : top + side, left : left + side]


def ridge(square) -> float:
    """Height (log10) of the highest ridge in the outer half of a luma square's spectrum, over its neighbourhood."""
    import numpy as np

    side = len(square)
    window = np.hanning(side)
    power = np.abs(np.fft.fftshift(np.fft.fft2((square - square.mean()) * np.outer(window, window)))) ** 2
    y, x = np.indices(power.shape) - side // 2
    radius = np.hypot(x, y).astype(int).reshape(-1)
    mean = np.bincount(radius, power.reshape(-1)) / np.maximum(np.bincount(radius), 1)
    level = np.log10(np.maximum(mean[: side // 2], 1.0))
    high = [level[r] - np.median(np.concatenate([level[max(0, r - 4) : r], level[r + 1 : r + 5]])) for r in range(side // 4, side // 2 - 4)]
    return float(max(high, default=0.0))


def metadata(files: DataFrame) -> DataFrame:
    """A row a metadata field of files(path, content)."""

    def read(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                kind, found = fields(data or b"")
                if found:
                    rows = [(path, kind, k, *f) for k, f in enumerate(found)]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=["path", "format", "k", "key", "value", "offset", "compressed"])

    return files.select("path", "content").mapInArrow(read, SCHEMA)


def ridges(files: DataFrame) -> DataFrame:
    """path, ridge of images whose pixels can be read; asked for only where the spectrum rule is enabled."""

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            out = [(p, ridge(s)) for p, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (s := luma(d or b"")) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.string()), pa.array([r for _, r in out], pa.float64())], names=["path", "ridge"])

    return files.select("path", "content").mapInArrow(read, "path string, ridge double")
