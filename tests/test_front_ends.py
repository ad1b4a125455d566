import struct
import zlib

import numpy as np

from proselens.functions import color
from proselens.operators import code, design, provenance
from proselens.plans.lint import lint
from proselens.sources import code as front
from proselens.sources import images, markup, style
from proselens.sources.config import Config, declared

PY = '''"""Doc."""
import missing_pkg
import json

# ... rest of the code unchanged


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
'''
TS = """import leftPad from 'left-pad';
// Generated by ChatGPT
try { go(); } catch (e) { console.log(e); }
try { go(); } catch (e) { /* expected here */ }
const a = b as any;
// @ts-ignore
interface Shape { area(): number }
class Square implements Shape { area() { return 1; } }
function f(x) { return g(x); }
function later() { throw new Error('not implemented'); }
"""
GO = 'package a\nimport "io/ioutil"\nfunc F() {\n\tif err != nil {\n\t}\n\tioutil.ReadAll(r)\n}\n'
RS = "fn a() { todo!() }\nfn b() { match x { Ok(v) => v, Err(_) => {} } }\n"


def _codes(rows):
    return sorted({(r.path, r.code, r.line) for r in rows})


def test_code_rules(spark):
    docs = spark.createDataFrame([("a.py", "python", PY), ("b.ts", "ts", TS), ("c.go", "go", GO), ("d.rs", "rust", RS), ("tests/e.py", "python", PY)], "path string, lang string, text string")
    known = spark.createDataFrame(declared({"pyproject.toml": "[project]\ndependencies=['requests']", "package.json": '{"dependencies": {"left-pad": "1"}}'}), "ecosystem string, name string")
    got = _codes(code.all_rules(docs, front.nodes(docs), known).collect())
    assert [x[1:] for x in got if x[0] == "a.py"] == [("PL001", 5), ("PL006", 11), ("PL008", 15), ("PL009", 25), ("PL010", 2), ("PL037", 26), ("PL039", 19), ("PL042", 23)]
    assert [x[1:] for x in got if x[0] == "b.ts"] == [("PL004", 2), ("PL005", 3), ("PL007", 5), ("PL007", 6), ("PL008", 10), ("PL038", 1), ("PL039", 9), ("PL040", 7)]
    assert [x[1:] for x in got if x[0] == "c.go"] == [("PL005", 4), ("PL037", 6)]
    assert [x[1:] for x in got if x[0] == "d.rs"] == [("PL005", 2), ("PL008", 1)]
    assert [x[1:] for x in got if x[0] == "tests/e.py"] == [("PL001", 5)]


def test_broken_code_has_no_facts(spark):
    docs = spark.createDataFrame([("a.py", "python", "def ("), ("b.ts", "ts", "/* open"), ("c.py", "python", None), ("d.go", "go", "")], "path string, lang string, text string")
    assert code.all_rules(docs, front.nodes(docs)).collect() == []


def test_long_comment_and_uniform_code(spark):
    body = "\n".join(f"# {' '.join(['word'] * 15)}" for _ in range(3))
    block = "\n".join(["def fun_one_two():", "    value = 123456", "        abcdef = 1234"])
    docs = spark.createDataFrame([("a.py", "python", body + "\nx = 1\n"), ("b.py", "python", "\n\n".join([block] * 25))], "path string, lang string, text string")
    assert _codes(code.long_comments(front.nodes(docs)).collect()) == [("a.py", "PL043", 1)]
    assert _codes(code.uniform_code(docs).collect()) == [("b.py", "PL045", 1)]


def test_design_rules(spark):
    css = ".a { background: linear-gradient(#4f46e5, #8b5cf6); -webkit-background-clip: text }\n.b { color: #8b5cf6 }\n:root { --background: 0 0% 100%; --primary: 262 83% 58%; --card: 0 0% 100% }\n.c { background: linear-gradient(#fff, #000) }"
    page = '<p class="bg-clip-text bg-gradient-to-r from-blue-500 to-purple-600">x</p>\n<b class="hover:bg-violet-600 p-1">y</b>'
    docs = spark.createDataFrame([("a.css", "css", css), ("b.html", "html", page)], "path string, lang string, text string")
    got = _codes(design.all_rules(style.declarations(docs)).collect())
    assert got == [("a.css", "PL052", 1), ("a.css", "PL053", 1), ("a.css", "PL054", 2), ("a.css", "PL056", 3), ("b.html", "PL052", 1), ("b.html", "PL053", 1), ("b.html", "PL055", 2)]


def test_colours():
    assert color.parse("#fff") == (1, 1, 1, 1)
    assert color.parse("rgb(0 0 255 / 50%)") == (0, 0, 1, 0.5)
    assert abs(color.hsl(color.parse("hsl(262, 83%, 58%)"))[0] - 262) < 1e-6
    assert color.parse("oklch(0.6 0.25 290)")[2] > 0.8
    assert color.parse("nothing") is None and color.parse("#12") is None


def _chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _png(*chunks, pixels=None):
    grey = pixels if pixels is not None else np.zeros((1, 1), np.uint8)
    head = struct.pack(">IIBBBBB", grey.shape[1], grey.shape[0], 8, 0, 0, 0, 0)
    data = zlib.compress(b"".join(b"\0" + r.tobytes() for r in grey))
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + b"".join(chunks) + _chunk(b"IDAT", data) + _chunk(b"IEND", b"")


def test_image_rules(spark):
    jpeg_body = b"http://ns.adobe.com/xap/1.0/\0<x>trainedAlgorithmicMedia</x>"
    files = [
        ("a.png", _png(_chunk(b"tEXt", b"parameters\0a cat, Midjourney"))),
        ("b.jpg", b"\xff\xd8\xff\xe1" + struct.pack(">H", len(jpeg_body) + 2) + jpeg_body + b"\xff\xda"),
        ("c.webp", b"RIFF\0\0\0\0WEBP" + b"EXIF" + struct.pack("<I", 9) + b"ComfyUI 1\0"),
        ("d.png", _png(_chunk(b"tEXt", b"Software\0medalled by hand"))),
        ("e.png", b"\x89PNG\r\n\x1a\n\0\0"), ("f.png", None), ("g.png", _png(_chunk(b"zTXt", b"prompt\0\0zz"))),
    ]
    table = spark.createDataFrame(files, "path string, content binary")
    assert _codes(provenance.rules(images.metadata(table)).collect()) == [("a.png", "PL046", 1), ("b.jpg", "PL047", 1), ("c.webp", "PL048", 1), ("g.png", "PL046", 1)]


def test_spectrum(spark):
    rng = np.random.default_rng(0)
    plain = rng.integers(100, 156, (256, 256)).astype(np.uint8)
    y, x = np.indices((256, 256)) - 128
    ring = np.zeros((256, 256), complex)
    ring[np.abs(np.hypot(x, y) - 90) < 0.5] = 4000
    wave = np.fft.ifft2(np.fft.ifftshift(ring * np.exp(2j * np.pi * rng.random((256, 256))))).real
    ridged = np.clip(plain + wave / np.abs(wave).max() * 60, 0, 255).astype(np.uint8)
    table = spark.createDataFrame([("plain.png", _png(pixels=plain)), ("ridged.png", _png(pixels=ridged))], "path string, content binary")
    assert [r.path for r in provenance.spectrum(images.ridges(table)).collect()] == ["ridged.png"]


def test_masks_keep_places():
    text = "---\na: b\n---\nWord `code here` [x](http://a.b) end\n```py\ndelve\n```\nafter\n\n    indented\n"
    got = markup.markdown(text)
    assert len(got) == len(text) and got.count("\n") == text.count("\n")
    assert "code here" not in got and "delve" not in got and "indented" not in got and "http" not in got and "after" in got
    page = "<html><head><title>t</title></head><body><p>Hello <b>you</b></p><script>delve()</script></body>"
    got = markup.html_text(page)
    assert len(got) == len(page) and "Hello" in got and "delve" not in got and got.index("Hello") == page.index("Hello")


def test_lint(spark):
    docs = spark.createDataFrame([
        ("a.md", "md", "# Title\n\nIt is a testament to care.\n\n<!-- proselens: ignore[PL014] -->\nIt is a testament to care.\n\n```\nIt is a testament to care.\n```\n"),
        ("b.html", "html", '<html><head><title></title></head><body><p>a — b</p><a href="http://example.com">x</a></body></html>'),
        ("c.py", "python", PY),
        ("docs/d.txt", "txt", "It is a testament to care."),
    ], "path string, lang string, text string")
    config = Config.of({"per-file-ignores": {"docs/**": ["rhetoric"]}, "ignore": ["PL041"], "custom-rule": [{"phrase": "care", "files": "a.md"}]})
    got = [(r.path, r.code, r.line) for r in lint(docs, config).collect()]
    assert got.count(("a.md", "PL014", 3)) == 1 and ("a.md", "PL014", 6) not in got and ("a.md", "PL014", 9) not in got
    assert {("b.html", "PL044", 1), ("b.html", "PL018", 1), ("b.html", "PL009", 1), ("c.py", "PL006", 11), ("a.md", "PL900", 3)} <= set(got)
    assert not [x for x in got if x[0] == "docs/d.txt"]


def test_code_rules_read_files_once_and_shuffle_nothing(spark):
    docs = spark.createDataFrame([("a.py", "python", PY), ("b.ts", "ts", TS)], "path string, lang string, text string")
    plan = code.all_rules(docs, front.nodes(docs))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and "Window" not in plan and "Aggregate" not in plan


def test_long_comments_of_a_file():
    def found(text, lang="ts"):
        return [r[2:4] for r in front.rows_of(text, lang) if r[0] == "long"]

    assert found("//" + " word" * 41) == [(1, 1)] and found("//" + " word" * 40) == []
    assert found("x;\n  //" + " word" * 21 + "\n  //" + " word" * 20) == [(2, 3)]
    assert found("//" + " word" * 21 + "\nx;\n//" + " word" * 20) == []
    assert found("// Licence" + " word" * 41) == [] and found("// @generated\n//" + " word" * 41) == []
    assert found("//" + " w ~~~~~" * 41) == [] and found("/**" + " word" * 41 + " */") == []
    assert found("//" + " word" * 41, "go") == [] and found("func f() {\n//" + " word" * 41 + "\n}", "go") == [(2, 1)]


def test_places_on_a_long_line_are_linear():
    import time

    text = "x = ['é', " + "'a', " * 200_000 + "]"
    for lang in ("ts", "python"):
        began = time.time()
        rows = [r for r in front.rows_of(text, lang) if r[0] == "string"]
        assert len(rows) == 200_001 and [r[3] for r in rows[:3]] == [6, 12, 17] and time.time() - began < 30
