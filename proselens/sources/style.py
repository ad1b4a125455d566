"""Front end for style sheets, pages and TSX: declarations and class tokens, with colours worked out, as rows.

(path, kind, block, property, value, start, line, col, hues, sats, alphas): kind `decl` has the colours of the value in order;
kind `class` has the list's tokens in `value`, a space between them, and no colours unless bracketed ones.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from proselens.functions import color

SCHEMA = "path string, lang string, kind string, block int, property string, value string, line int, col int, hues array<double>, sats array<double>, alphas array<double>"


def _declarations(css: str):
    """(block, property, value, start) of a style sheet: `;` and `}` inside quotes or brackets don't end a value."""
    css = re.sub(r"/\*.*?(?:\*/|\Z)|(?m:(?<![:\w])//[^\n]*)", lambda m: re.sub(r"[^\n]", " ", m[0]), css, flags=re.S)
    block, depth, quote, start = 0, 0, "", 0
    stack, last = [0], 0
    for i, c in enumerate(css):
        if quote:
            quote = "" if c == quote and css[i - 1] != "\\" else quote
        elif c in "\"'":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth = max(0, depth - 1)
        elif not depth and c in ";{}":
            said = css[start:i]
            if c == "{":
                last += 1
                stack.append(last)
            elif ":" in said:
                name, value = said.split(":", 1)
                block = stack[-1]
                if re.fullmatch(r"\s*[\w-]+\s*", name):
                    yield block, name.strip().lower(), value.strip(), start + len(name) - len(name.lstrip()) if name.strip() else start
            if c == "}" and len(stack) > 1:
                stack.pop()
            start = i + 1
    said = css[start:]
    if ":" in said and re.fullmatch(r"\s*[\w-]+\s*", said.split(":", 1)[0]):
        name, value = said.split(":", 1)
        yield stack[-1], name.strip().lower(), value.strip(), start + len(name) - len(name.lstrip())


def _scan(value: str):
    shown = re.sub(r"(?:var|url)\([^()]*\)", lambda m: " " * len(m[0]), value)
    return [(c, m.start()) for m in color.FIND.finditer(shown) if (c := color.parse(m[0])) and not (m.start() and re.match(r"[\w-]", shown[m.start() - 1]))]


def split_token(token: str) -> tuple[str, str]:
    """A class token's variant and utility: cut at the last colon outside brackets."""
    depth, cut = 0, -1
    for i, c in enumerate(token):
        depth += (c in "[(") - (c in "])")
        if c == ":" and not depth:
            cut = i
    return (token[:cut] if cut > 0 else ""), token[cut + 1 :].strip("!")


def rows_of(text: str, lang: str) -> list[tuple]:
    from proselens.sources.code import Source

    src, out, blocks = Source(text), [], 0

    def place(at: int) -> tuple[int, int]:
        line, _ = src.place(at)
        return line, at - src.starts[line - 1] + 1

    def declared(css: str, at: int, base: int) -> int:
        most = base
        for block, name, value, start in _declarations(css):
            found = [(c, *color.hsl(c)) for c, _ in _scan(value)]
            bare = color.triplet(value)
            if bare:
                found.append(((0, 0, 0, 1.0), *bare))
            out.append(("decl", base + block, name, value, *place(at + start), [h for _, h, _, _ in found], [s for _, _, s, _ in found], [c[3] for c, *_ in found]))
            most = max(most, base + block)
        return most + 1

    if lang in ("css", "scss"):
        declared(text, 0, 0)
        return out
    for m in re.finditer(r"(?is)<style[^>]*>(.*?)</style", text):
        blocks = declared(m[1], m.start(1), blocks)
    for m in re.finditer(r"""(?s)\bstyle\s*=\s*(?:"([^"]*)"|'([^']*)')""", text):
        k = 1 if m[1] is not None else 2
        blocks = declared(m[k], m.start(k), blocks)
    for m in re.finditer(r"(?s)\bstyle\s*=\s*\{\{(.*?)\}\}", text):
        css = re.sub(r"(\w+)\s*:\s*(['\"])(.*?)\2\s*,?", lambda x: re.sub(r"([A-Z])", lambda y: "-" + y[1].lower(), x[1]) + ":" + x[3] + ";", m[1])
        blocks = declared(css, m.start(1), blocks)
    for m in re.finditer(r"""(?s)\bclass(?:Name)?\s*=\s*(?:"([^"]*)"|'([^']*)'|\{\s*["'`]([^"'`]*)["'`])""", text):
        k = next(i for i in (1, 2, 3) if m[i] is not None)
        tokens = [t for t in m[k].split() if not set(t) & set("{}$")]
        if tokens:
            found = [(c, *color.hsl(c)) for t in tokens for b in re.findall(r"\[([^\]]*)\]", t) for c, _ in _scan(b.replace("_", " "))]
            out.append(("class", blocks, "", " ".join(tokens), *place(m.start(k)), [h for _, h, _, _ in found], [s for _, _, s, _ in found], [c[3] for c, *_ in found]))
            blocks += 1
    return out


def declarations(docs: DataFrame) -> DataFrame:
    """Style rows of documents(path, lang, text)."""

    def read(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), *[pa.list_(pa.float64())] * 3]
        names = ["path", "lang", "kind", "block", "property", "value", "line", "col", "hues", "sats", "alphas"]
        for batch in batches:
            for path, lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                rows = rows_of(text or "", lang)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([[path] * len(rows), [lang] * len(rows), *map(list, zip(*rows))], kinds)], names=names)

    return docs.where(docs["lang"].isin("css", "scss", "html", "tsx")).select("path", "lang", "text").mapInArrow(read, SCHEMA)
