"""Secret scans: an Aho-Corasick keyword prefilter, anchored regular expressions only at its hits, checksums last.

One pass of the automaton over the text (its bytes, with A-Z lowered) finds every keyword's place. Each kind's pattern is
then tried at that place alone, as `match`, never as a search; a hit inside the previous match of its kind is passed
over, which is what a left-to-right search does. The kind `hex` has no keyword: a byte map turns the text into digits and
others, and a run of 16 digits is looked for as a substring. Kinds whose tokens carry a checksum (GitHub's and npm's:
six base-62 digits of the CRC-32 of the thirty characters before) are reported only where it is right.

Offsets are in code points. Results for odd input: a null text is an empty one, which has no spans; rows are scanned one
by one, so repeated rows, null ids and ties have no effect on each other; an empty table gives none; columns other than
the two named are ignored by `scan`, and kept as they are by `redacted`.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proselens.llm import shared, tokens

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_DIGITS = bytes(1 if c in b"0123456789abcdef" else 0 for c in range(256))
_ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]+")
_CHECKED = re.compile(rb"(gh[pousr]_|npm_)([0-9A-Za-z]{36})(?![0-9A-Za-z_])")
#: Kinds in the order in which spans with one start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "github", "npm")
BASE = 3
_KEYWORDS = {**dict.fromkeys(("password", "passwd", "secret", "token", "apikey", "api_key"), "assign"), "akia": "access", **dict.fromkeys(("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"), "checked")}
_BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum(body: bytes) -> bytes:
    """Six base-62 digits of the CRC-32."""
    n, out = zlib.crc32(body), b""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = _BASE62[digit : digit + 1] + out
    return out


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in _KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


_kept: list = []


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's index, end) of every secret in `text`, in order."""
    if not _kept:
        _kept.append(_automaton())
    data = text.encode("utf-8", "surrogatepass")
    found: list[tuple[int, int, int]] = []
    past = {"assign": 0, "access": 0, "checked": 0}
    hits = sorted((end - n + 1, kind) for end, (n, kind) in _kept[0].iter(data.translate(_LOWER).decode("latin-1")))
    for start, kind in hits:
        if start < past[kind]:
            continue
        if kind == "assign":
            if m := _ASSIGN.match(data, start):
                past[kind] = m.end()
                if len(m[2]) >= 12:
                    found.append((start, 0, m.end()))
        elif kind == "access":
            if m := _ACCESS.match(data, start):
                past[kind] = m.end()
                if m.end() - start >= 18:
                    found.append((start, 1, m.end()))
        elif m := _CHECKED.match(data, start):
            if checksum(m[2][:30]) == m[2][30:]:
                past[kind] = m.end()
                found.append((start, 4 if m[1] == b"npm_" else 3, m.end()))
    digits = data.translate(_DIGITS)
    at = digits.find(_RUN)
    while at >= 0:
        end = _HEX.match(data, at).end()
        found.append((at, 2, end))
        at = digits.find(_RUN, end)
    found.sort()
    if found and len(data) != len(text):
        places = sorted({x for s, _, e in found for x in (s, e)})
        to, byte, char = {}, 0, 0
        for p in places:
            char += len(data[byte:p].decode("utf-8", "surrogatepass"))
            byte = p
            to[p] = char
        found = [(to[s], k, to[e]) for s, k, e in found]
    return found


_RUN = b"\x01" * 16
SCHEMA = "doc_id long, spans array<struct<start:int,end:int,kind:string,base:boolean>>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and the spans of every row, in order of start and then of kind."""

    def rows(batches):
        import pyarrow as pa

        kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_())])
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in tokens.in_bytes(texts, 1 << 22):
                got = [[{"start": s, "end": e, "kind": KINDS[k], "base": k < BASE} for s, k, e in spans(t)] for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(got, pa.list_(kind))], names=["doc_id", "spans"])

    return shared.id_text(docs).mapInArrow(rows, SCHEMA)


def redacted(docs: DataFrame, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """`docs` with every secret in `text_col` replaced by `mask`; overlapping spans are one. Null texts stay null."""

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: None if t is None else masked(t, mask))

    return docs.withColumn(text_col, clean(F.col(f"`{text_col}`")))


def masked(text: str, mask: str) -> str:
    out, at = [], 0
    for start, _, end in spans(text):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join(out) + text[at:] if out else text


def listed(which: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(which, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
