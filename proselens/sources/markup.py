"""Front end for prose: texts of the same length with what isn't prose blanked, so that places stay right.

Markdown loses front matter (for the rules that pass it over), fenced and indented code, inline code and URLs; HTML keeps
its text nodes, with scripts, styles and tags blanked. Plain text is taken as it is and never enters Python.
"""

from __future__ import annotations

import html.parser
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
_INLINE = re.compile(r"(?<!`)(`{1,2})(?!`)([^\n]*?[^`\n])\1(?!`)")
_URL = re.compile(r"<https?://[^>\s]+>|(?<=\]\()[^)\s]+(?=[)\s])|(?m:^ {0,3}\[[^\]\n]+\]:\s*\S+)|https?://[^\s)>\]]+")
_SKIP = frozenset({"script", "style", "pre", "code", "textarea", "noscript", "svg", "template", "head"})


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def front_matter(text: str) -> int:
    """Where the front matter ends; 0 where there is none."""
    m = re.match(r"---[ \t]*\n.*?\n(?:---|\.\.\.)[ \t]*(?:\n|\Z)", text, re.S)
    return m.end() if m else 0


def markdown(text: str) -> str:
    out, fence, before_blank, listed = [], "", True, False
    for line in text.split("\n"):
        m = _FENCE.match(line)
        if fence:
            closed = m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not line.strip().strip(m[1][0])
            out.append(_blank(line))
            fence = "" if closed else fence
        elif m:
            fence = m[1]
            out.append(_blank(line))
        elif before_blank and not listed and re.match(r"(?: {4}|\t)\s*\S", line):
            out.append(_blank(line))
            continue  # the next indented line is code too
        else:
            out.append(line)
        before_blank = not line.strip()
        if line.strip():
            listed = bool(re.match(r"\s*(?:[-*+]|\d+[.)])\s", line)) or listed and line[:1] in " \t"
    masked = "\n".join(out)
    masked = _INLINE.sub(lambda m: _blank(m[0]), masked)
    masked = _URL.sub(lambda m: _blank(m[0]), masked)
    end = front_matter(text)
    return _blank(text[:end]) + masked[end:]


class _Text(html.parser.HTMLParser):
    def __init__(self, text: str):
        super().__init__(convert_charrefs=False)
        self.kept, self.skipping, self.starts, self.source = [" " if c != "\n" else c for c in text], [], [0], text
        self.starts += [m.end() for m in re.finditer("\n", text)]
        self.attrs: list[tuple[str, int]] = []

    def _at(self) -> int:
        line, col = self.getpos()
        return self.starts[line - 1] + col

    def _keep(self, said: str) -> None:
        if not self.skipping:
            at = self._at()
            self.kept[at : at + len(said)] = said

    def handle_starttag(self, tag, attrs):
        self.attrs += [(f'{k}="{v}"', self._at()) for k, v in attrs if v]
        if tag in _SKIP:
            self.skipping.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.attrs += [(f'{k}="{v}"', self._at()) for k, v in attrs if v]

    def handle_endtag(self, tag):
        if tag in self.skipping:
            del self.skipping[self.skipping.index(tag) :]

    def handle_data(self, data):
        self._keep(data)

    def handle_entityref(self, name):
        self._keep(f"&{name};" if self.source[self._at() :].startswith(f"&{name};") else f"&{name}")

    def handle_charref(self, name):
        self._keep(f"&#{name};")


def html_text(text: str) -> str:
    blanked = re.sub(r"\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\}", lambda m: _blank(m[0]), text, flags=re.S)
    p = _Text(blanked)
    p.feed(blanked)
    p.close()
    return "".join(p.kept)


def masked(docs: DataFrame) -> DataFrame:
    """documents(path, lang, text) with `text` masked. Only Markdown and HTML rows go through Python."""

    @F.pandas_udf("string")
    def mask(lang, text):
        import pandas as pd

        return pd.Series([None if t is None else (html_text(t) if k == "html" else markdown(t)) for k, t in zip(lang, text)])

    rich = F.col("lang").isin("md", "mdx", "html")
    return docs.where(~rich | F.col("lang").isNull()).unionByName(docs.where(rich).withColumn("text", mask("lang", "text")))


def attributes(docs: DataFrame) -> DataFrame:
    """Attribute values of HTML documents as rows of the same shape as code strings."""
    from proselens.sources.code import SCHEMA

    def read(batches):
        import pyarrow as pa

        from proselens.sources.code import Source

        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_()]
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                p, src = _Text(text or ""), Source(text or "")
                p.feed(text or "")
                if p.attrs:
                    rows = [(path, "html", "attr", "", *src.place(at), said, False) for said, at in p.attrs]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=["path", "lang", "kind", "name", "line", "col", "text", "flag"])

    return docs.where("lang = 'html'").select("path", "text").mapInArrow(read, SCHEMA)
