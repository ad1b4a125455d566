"""Source files, style sheets, pages and images made from the documents table, with the findings that they must give.

Each document becomes one file: its text as a comment that holds nothing to find, after one of a few seeded bodies chosen
by doc_id. The findings of a body were worked out by hand from the rules' definitions.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselens.sources.scan import spread

PYTHON = '''import json


def load(path):
    try:
        return json.load(open(path))
    except Exception:
        pass


def todo(x):
    raise NotImplementedError


def wrap(a, b):
    return other(a, b)


# Increment the counter
counter = increment(counter)
KEY = "YOUR_API_KEY"
for i in range(len(KEY)):
    print(i)
# ... rest of the code unchanged
'''
TYPESCRIPT = """import leftPad from 'left-pad';
// Generated by ChatGPT
try { go(); } catch (e) { console.log(e); }
try { go(); } catch (e) { /* expected here */ }
const a = b as any;
// @ts-ignore
interface Shape { area(): number }
class Square implements Shape { area() { return 1; } }
function f(x) { return g(x); }
function later() { throw new Error('not implemented'); }
// Certainly! Here is the code
// in a real application this would call the service
// Example usage
"""
GO = 'package a\nimport "io/ioutil"\nfunc F() {\n\tif err != nil {\n\t}\n\tioutil.ReadAll(r)\n}\n```\n'
RUST = "fn a() { todo!() }\nfn b() { match x { Ok(v) => v, Err(_) => {} } }\n"
#: (extension, language, body, comment mark, [(code, line)])
CODE = [
    ("py", "python", PYTHON, "#", [("PL006", 7), ("PL008", 11), ("PL039", 15), ("PL042", 19), ("PL009", 21), ("PL037", 22), ("PL001", 24)]),
    ("ts", "ts", TYPESCRIPT, "//", [("PL038", 1), ("PL004", 2), ("PL005", 3), ("PL007", 5), ("PL007", 6), ("PL040", 7), ("PL039", 9), ("PL008", 10), ("PL002", 11), ("PL050", 12), ("PL051", 13)]),
    ("go", "go", GO, "//", [("PL005", 4), ("PL037", 6), ("PL003", 8)]),
    ("rs", "rust", RUST, "//", [("PL008", 1), ("PL005", 2)]),
    ("py", "python", "x = 1\ny = x + 1\n", "#", []),
]
CSS = ".a { background: linear-gradient(#4f46e5, #8b5cf6); -webkit-background-clip: text }\n.b { color: #8b5cf6 }\n:root { --background: 0 0% 100%; --primary: 262 83% 58%; --card: 0 0% 100% }\n.c { background: linear-gradient(#fff, #000) }"
PAGE = '<p class="bg-clip-text bg-gradient-to-r from-blue-500 to-purple-600">x</p>\n<b class="hover:bg-violet-600 p-1">y</b>'
STYLE = [
    ("css", "css", CSS, [("PL052", 1), ("PL053", 1), ("PL054", 2), ("PL056", 3)]),
    ("html", "html", PAGE, [("PL052", 1), ("PL053", 1), ("PL055", 2)]),
    ("css", "css", ".a { color: red }", []),
]


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(*chunks: tuple[bytes, bytes]) -> bytes:
    head = struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + b"".join(_chunk(*c) for c in [(b"IHDR", head), *chunks, (b"IDAT", zlib.compress(b"\0\0")), (b"IEND", b"")])


_XMP = b"http://ns.adobe.com/xap/1.0/\0<x>trainedAlgorithmicMedia</x>"
IMAGES = [
    (png((b"tEXt", b"parameters\0a cat, Midjourney")), ["PL046"]),
    (b"\xff\xd8\xff\xe1" + struct.pack(">H", len(_XMP) + 2) + _XMP + b"\xff\xda", ["PL047"]),
    (b"RIFF\0\0\0\0WEBP" + b"EXIF" + struct.pack("<I", 9) + b"ComfyUI 1\0", ["PL048"]),
    (png((b"tEXt", b"Software\0medalled by hand")), []),
]


def _chosen(column: str, values: list):
    out = F.when(F.lit(False), F.lit(values[0]))
    for k, v in enumerate(values):
        out = out.when(F.col(column) % len(values) == k, F.lit(v))
    return out


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id")
    said = F.concat(_chosen("doc_id", [m for *_, m, _ in CODE]), F.lit(" "), F.regexp_replace("text", r"[^\p{L}\p{N} ]+", " "))
    files = docs.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit("."), _chosen("doc_id", [x[0] for x in CODE])).alias("path"), _chosen("doc_id", [x[1] for x in CODE]).alias("lang"), F.concat(_chosen("doc_id", [x[2] for x in CODE]), F.lit("\n"), said, F.lit("\n")).alias("text"))
    return files.select(F.inline(F.array(F.struct("path", "lang", "text"))))  # filters stay above, so a text is made once


def style_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit("."), _chosen("doc_id", [x[0] for x in STYLE])).alias("path"), _chosen("doc_id", [x[1] for x in STYLE]).alias("lang"), _chosen("doc_id", [x[2] for x in STYLE]).alias("text"))


def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".img")).alias("path"), F.unhex(_chosen("doc_id", [x[0].hex() for x in IMAGES])).alias("content"))


def _expected(n: int, rows: list[tuple], suffix: list[str]) -> str:
    values = ", ".join(f"({k}, '{code}', {line}, '{suffix[k]}')" for k, code, line in rows)
    return f"WITH e(k, code, line, suffix) AS (VALUES {values}) SELECT code, 'doc/' || doc_id || suffix AS path, line FROM documents JOIN e ON doc_id % {n} = k"


def oracles() -> dict[str, str]:
    # the document's own comment runs long where it has more than forty words, is no notice and mostly letters; Go's
    # stands outside any function
    ends = ", ".join(f"({k}, {x[2].count(chr(10)) + 2}, '.{x[0]}', '{x[3]} ')" for k, x in enumerate(CODE) if x[1] != "go")
    clean = "regexp_replace(text, '[^\\p{L}\\p{N} ]+', ' ', 'g')"
    long = f" UNION ALL SELECT 'PL043', 'doc/' || doc_id || ext, at_line FROM (SELECT doc_id, ext, at_line, mark || {clean} AS t FROM documents JOIN (VALUES {ends}) v(k, at_line, ext, mark) ON doc_id % {len(CODE)} = k) WHERE len(list_filter(string_split_regex(t[3:], '\\s+'), lambda w: regexp_matches(w, '\\w'))) > 40 AND NOT regexp_matches(t, '(?i)copyright|licen[cs]e|spdx') AND length(regexp_replace(t, '[\\w\\s]', '', 'g')) <= 0.25 * length(t)"
    return {
        "rules_code": _expected(len(CODE), [(k, c, line) for k, x in enumerate(CODE) for c, line in x[4]], ["." + x[0] for x in CODE]) + long,
        "rules_design": _expected(len(STYLE), [(k, c, line) for k, x in enumerate(STYLE) for c, line in x[3]], ["." + x[0] for x in STYLE]),
        "rules_provenance": _expected(len(IMAGES), [(k, c, 1) for k, x in enumerate(IMAGES) for c in x[1]], [".img"] * len(IMAGES)),
        "stream_event_counts": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    }
