"""Front end for source code: comments, strings and facts about statements, as rows.

Python is read with `ast` and `tokenize`; TypeScript, Go and Rust by a lexer that knows comments, strings and brackets.
What can't be parsed has its comments and strings only. Rows are (kind, name, line, col, text, flag): `col` counts bytes from
1, as parsers do; `flag` is true of a comment alone on its line that isn't documentation, and of a string that is one.
"""

from __future__ import annotations

import ast
import bisect
import io
import re
import tokenize
from collections import defaultdict
from itertools import chain, islice

from pyspark.sql import DataFrame

#: Characters of files whose rows are sent together.
SENT = 1 << 20
SCHEMA = "path string, lang string, kind string, name string, line int, col int, text string, flag boolean"
_COMMENT_OR_STRING = {
    "c": re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"|`(?:\\.|[^`\\])*`|'(?:\\.|[^'\\\n])*'""", re.S),
    "rust": re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|r(#*)".*?"\1|"(?:\\.|[^"\\])*"|'(?:\\.[^']*|[^'\\])'""", re.S),
}
_TELLING = re.compile(r"\S")
_NOT_IMPLEMENTED = re.compile(r"not.?implemented", re.I)
INTENT = re.compile("|".join(("best.?effort", "deliberate", "expected", "ignore", "intentional", "no[- ]?op", "on purpose", "swallow")), re.I)
STDLIB_FIXES = {"left-pad": "padStart", "is-array": "Array.isArray", "object-assign": "Object.assign", "array-flatten": "flat", "node-fetch": "fetch", "uuid": "crypto.randomUUID", "rimraf": "fs.rm", "mkdirp": "fs.mkdir", "querystring": "URLSearchParams", "lodash.clonedeep": "structuredClone", "moment": "Intl.DateTimeFormat"}


class Source:
    """A text with the places of its lines. Places asked for in rising order cost what stands between them, however long
    their line is."""

    def __init__(self, text: str):
        self.text = text
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self._last, self._line, self._col = 0, 1, 1
        self._blank: tuple[int, int] = (0, 0)  # a line and where its first telling character stands

    def place(self, at: int) -> tuple[int, int]:
        line = bisect.bisect_right(self.starts, at)
        if line != self._line or at < self._last:
            self._last, self._line, self._col = self.starts[line - 1], line, 1
        self._col += len(self.text[self._last : at].encode())
        self._last = at
        return line, self._col

    def leads(self, at: int) -> bool:
        line = bisect.bisect_right(self.starts, at)
        if line != self._blank[0]:
            first = _TELLING.search(self.text, self.starts[line - 1])
            self._blank = line, first.start() if first else len(self.text)
        return self._blank[1] >= at


def _covered(text: str, by: str) -> str:
    return "\n".join(by * len(line) for line in text.split("\n"))


def lexed(text: str, lang: str) -> tuple[list[tuple], str]:
    """Comments and strings of a brace language, and the code with both blanked."""
    src, rows, code, at, depth = Source(text), [], [], 0, 0
    for m in _COMMENT_OR_STRING["rust" if lang == "rust" else "c"].finditer(text):
        said = m[0]
        comment = said.startswith(("//", "/*"))
        line, col = src.place(m.start())
        doc = comment and (said.startswith(("///", "//!", "/**")) or lang == "go" and bool(re.match(r"\n(?:func|type|package|var|const)\b", text[m.end() : m.end() + 9])))
        if lang == "go":  # comments outside functions are told apart
            depth += text[at : m.start()].count("{") - text[at : m.start()].count("}")
        rows.append(("comment" if comment else "string", "doc" if doc else "top" if comment and lang == "go" and depth <= 0 else "", line, col, said, comment and not doc and src.leads(m.start())))
        code += [text[at : m.start()], _covered(said, " ") if comment else said[0] + _covered(said[1:-1], "_") + said[-1:]]
        at = m.end()
    return rows, "".join([*code, text[at:]])


def _block(code: str, at: int) -> tuple[str, int]:
    """What stands between the braces that open at `at`, and where they close."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(code, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return code[at + 1 : m.start()], m.end()
    return code[at + 1 :], len(code)


def _arguments(text: str) -> list[str]:
    return [re.sub(r"[:=].*", "", a, flags=re.S).strip().removeprefix("mut ").split(" ")[0] for a in text.split(",") if a.strip()]


def brace_facts(text: str, code: str, lang: str) -> list[tuple]:
    src, rows = Source(text), []

    def put(kind: str, name: str, at: int, said: str = "") -> None:
        rows.append((kind, name, *src.place(at), said, False))

    if lang in ("ts", "tsx"):
        for m in re.finditer(r"\bcatch\s*(?:\([^)]*\))?\s*\{", code):
            body, end = _block(code, m.end() - 1)
            raw = text[m.end() : end - 1]
            statements = [s.strip() for s in re.split(r";|\n", body) if s.strip()]
            if (not statements and not INTENT.search(raw)) or (statements and all(re.match(r"console\.(?:log|warn|error|info|debug)\(", s) for s in statements)):
                put("catch", "", m.start())
        for m in re.finditer(r"\bas\s+any\b|\bas\s+unknown\s+as\b", code):
            put("cast", m[0].split()[1], m.start())
        for m in re.finditer(r"""^[^\S\n]*import\s+(?:[^'"\n]*?\s+from\s+)?(['"])|\brequire\(\s*(['"])""", code, re.M):
            said = re.match(r"[^'\"]*", text[m.end() :])[0]
            put("import", said, m.start() + len(m[0]) - len(m[0].lstrip()), said)
        for m in re.finditer(r"JSON\.parse\(\s*JSON\.stringify\(|Math\.random\(\)\.toString\(36\)|new\s+Promise\([^)]*=>\s*(?:\{\s*)?setTimeout\(", code):
            put("reinvent", m[0].split("(")[0], m.start())
        for m in re.finditer(r"\b(?:interface|abstract\s+class)\s+(\w+)", code):
            put("abstract", m[1], m.start())
        for m in re.finditer(r"\bclass\s+(\w+)[^{]*?\b(?:implements|extends)\s+([\w, ]+)", code):
            for name in re.findall(r"\w+", m[2]):
                put("implements", name, m.start(), m[1])
        functions = re.finditer(r"(?:\bfunction\s+(\w+)|\b(?:const|let)\s+(\w+)\s*=)\s*(?:async\s*)?\(([^)]*)\)[^{;=]*(?:=>\s*)?\{", code)
    elif lang == "go":
        for m in re.finditer(r"\bif\b[^{\n]*(?:\berr\b[^{\n]*!=\s*nil|\brecover\()[^{\n]*\{", code):
            body, end = _block(code, m.end() - 1)
            if not body.strip() and not INTENT.search(text[m.end() : end]):
                put("catch", "", m.start())
        for m in re.finditer(r"\bioutil\.\w+", code):
            put("reinvent", m[0], m.start())
        opened = closed = -1
        seen = 0
        for m in re.finditer(r'^[^\S\n]*(?:import\s+)?(?:\w+\s+)?"', code, re.M):
            opened = max(opened, code.rfind("import (", max(seen - 8, 0), m.start()))
            closed = max(closed, code.rfind(")", seen, m.start()))
            seen = m.start()
            if "import" in m[0] or opened > closed:
                said = re.match(r"[^\"]*", text[m.end() :])[0]
                put("import", said, m.end() - 1, said)
        functions = re.finditer(r"\bfunc\s+(\w+)()\s*\(([^)]*)\)[^{\n]*\{", code)
    else:
        for m in re.finditer(r"\bErr\([^)]*\)\s*=>\s*(?:\{\s*\}|\(\))", code):
            if not INTENT.search(text[m.start() : text.find("\n", m.end()) if "\n" in text[m.end() :] else None]):
                put("catch", "", m.start())
        for m in re.finditer(r"^[^\S\n]*(?:pub\s+)?(?:use|extern\s+crate)\s+(\w+)", code, re.M):
            put("import", m[1], m.start(1), m[1])
        functions = re.finditer(r"\bfn\s+(\w+)()\s*(?:<[^>]*>)?\(([^)]*)\)[^{;]*\{", code)
    for m in functions:
        body, end = _block(code, m.end() - 1)
        raw, name = text[m.end() : end - 1].strip(), m[1] or m[2]
        stripped = body.strip().rstrip(";").strip()
        stub = (lang == "rust" and re.fullmatch(r"(?:todo|unimplemented)!\(.*\)", stripped, re.S)) or (lang in ("ts", "tsx") and re.fullmatch(r"throw\s+new\s+Error\(.*\)", stripped, re.S) and _NOT_IMPLEMENTED.search(raw)) or (lang == "go" and (not raw or re.fullmatch(r"panic\(.*\)", stripped, re.S) and _NOT_IMPLEMENTED.search(raw)))
        if stub:
            put("stub", name, m.start())
        call = re.fullmatch(r"(?:return\s+)?(\w+)\(([^()]*)\)", stripped)
        given = _arguments(m[3])
        if call and given and call[1] != name and [a.strip() for a in call[2].split(",")] == given:
            put("wrapper", name, m.start())
    return rows


def python_rows(text: str) -> list[tuple]:
    rows: list[tuple] = []
    src = Source(text)
    byte = lambda line, col: src.place(min(src.starts[line - 1] + col, len(text)))[1]
    docs: set[tuple[int, int]] = set()
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        tree = None
    if tree is not None:
        for node in ast.walk(tree):
            if isinstance(node, (ast.Module, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) and node.body and isinstance(node.body[0], ast.Expr) and isinstance(node.body[0].value, ast.Constant) and isinstance(node.body[0].value.value, str):
                docs.add((node.body[0].lineno, node.body[0].col_offset))
        rows += python_facts(tree)
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type == tokenize.COMMENT:
                rows.append(("comment", "", t.start[0], byte(*t.start), t.string, not t.line[: t.start[1]].strip()))
            elif t.type == tokenize.STRING:
                rows.append(("string", "doc" if t.start in docs else "", t.start[0], byte(*t.start), t.string, t.start in docs))
    except (tokenize.TokenError, IndentationError, SyntaxError):
        pass
    return rows


def python_facts(tree: ast.Module) -> list[tuple]:
    rows: list[tuple] = []

    def put(kind: str, name: str, node, said: str = "") -> None:
        rows.append((kind, name, node.lineno, node.col_offset + 1, said, False))

    def named(node) -> str:
        return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else ""

    def quiet(statement) -> bool:
        if isinstance(statement, ast.Pass) or isinstance(statement, ast.Expr) and isinstance(statement.value, ast.Constant) and statement.value.value is ...:
            return True
        return isinstance(statement, ast.Expr) and isinstance(statement.value, ast.Call) and bool(re.fullmatch(r"print|(?:log|logger|logging)\.\w+", ast.unparse(statement.value.func)))

    parents = {child: node for node in ast.walk(tree) for child in ast.iter_child_nodes(node)}
    for node in ast.walk(tree):
        if isinstance(node, ast.ExceptHandler):
            kinds = [named(x) for x in node.type.elts] if isinstance(node.type, ast.Tuple) else [named(node.type)] if node.type else [""]
            if any(k in ("", "Exception", "BaseException") for k in kinds) and all(map(quiet, node.body)):
                put("except", kinds[0], node)
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            guarded = any(isinstance(h.type, (ast.Name, ast.Tuple)) and "Import" in ast.unparse(h.type) for p in [parents.get(node)] if isinstance(p, ast.Try) for h in p.handlers)
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if not node.level else []
            for name in names:
                if name and not guarded:
                    put("import", name.split(".")[0], node, name)
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            body = node.body[1:] if node.body and isinstance(node.body[0], ast.Expr) and isinstance(node.body[0].value, ast.Constant) and isinstance(node.body[0].value.value, str) else node.body
            holder = parents.get(node)
            decorated = [ast.unparse(d).split("(")[0].split(".")[-1] for d in node.decorator_list]
            open_class = isinstance(holder, ast.ClassDef) and (any(re.search(r"Protocol|ABC", ast.unparse(b)) for b in holder.bases) or re.search(r"Base|Mixin", holder.name))
            if not {"abstractmethod", "overload"} & set(decorated) and not open_class:
                raised = body[0] if len(body) == 1 and isinstance(body[0], ast.Raise) and body[0].exc else None
                bare = len(body) == 1 and quiet(body[0]) and not (isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Call))
                told = raised is not None and isinstance(raised.exc, ast.Call) and raised.exc.args and isinstance(holder, ast.ClassDef)
                if (bare and len(body) == len(node.body)) or (raised is not None and "NotImplementedError" in ast.unparse(raised.exc) and not told):
                    put("stub", node.name, node)
            given = [a.arg for a in node.args.args]
            if len(body) == 1 and isinstance(body[0], ast.Return) and isinstance(body[0].value, ast.Call) and isinstance(body[0].value.func, ast.Name) and not decorated and given and given[0] not in ("self", "cls"):
                call = body[0].value
                if call.func.id != node.name and not call.keywords and [named(a) for a in call.args] == given and not (node.args.vararg or node.args.kwarg or node.args.kwonlyargs):
                    put("wrapper", node.name, node)
        elif isinstance(node, ast.ClassDef):
            bases = [named(b) for b in node.bases]
            if any(b in ("ABC", "Protocol") for b in bases):
                put("abstract", node.name, node)
            for b in bases:
                put("implements", b, node, node.name)
        elif isinstance(node, (ast.For, ast.comprehension)) and isinstance(node.iter, ast.Call) and named(node.iter.func) == "range" and len(node.iter.args) == 1 and isinstance(node.iter.args[0], ast.Call) and named(node.iter.args[0].func) == "len":
            put("reinvent", "range(len)", node.iter)
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr == "read" and isinstance(node.func.value, ast.Call) and named(node.func.value.func) == "open":
            put("reinvent", "open().read()", node)
    return rows


_SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_STOP = frozenset("a an and the of to in on for with by from is are be this that it its as at into o a os as um uma de do da e em para com".split())
_VERBS = frozenset("add append assign build call check clear close compute convert copy create declare decrement define delete do fetch get handle import increment init initialize iterate load log loop make open parse print process push read remove reset return run save send set start stop store sum update use validate write cria define retorna verifica".split())
_WHY = frozenset("because since so otherwise avoid ensure must should workaround hack fixme todo note why unless until porque senão evita".split())


def _stem(word: str) -> str:
    word = word.lower()
    for end in ("ing", "es", "ed", "s"):
        if word.endswith(end) and len(word) - len(end) >= 3:
            return word[: -len(end)].rstrip("e")
    return word.rstrip("e")


_WORD = re.compile(r"[^\W\d_]+")


def restating(text: str, comments: list[tuple]) -> list[tuple]:
    """Plain comments of 2 to 12 words whose telling words are all in the statement below."""
    lines, out = text.split("\n"), []
    at = {c[2] for c in comments}
    for kind, name, line, col, said, flag in comments:
        words = [m[0] for m in islice(_WORD.finditer(said), 13)]
        if kind != "comment" or not flag or not 2 <= len(words) <= 12 or re.search(r"https?:|#\d|[=<>`?]|^\W*(?:TODO|FIXME|noqa|eslint|type:|!|-{3})", said) or line - 1 in at or line + 1 in at or line >= len(lines):
            continue
        telling = [w for w in words if w.lower() not in _STOP]
        if not telling or any(w.lower() in _WHY for w in words):
            continue
        below = {_stem(p) for w in re.findall(r"\w+", lines[line]) for p in _SPLIT.findall(w)}
        literal = sum(_stem(w) in below for w in telling)
        if all(_stem(w) in below or w.lower() in _VERBS or _stem(w) in {_stem(v) for v in _VERBS} for w in telling) and 2 * literal > len(telling):
            out.append(("restate", "", line, col, said, False))
    return out


def fences(text: str, rows: list[tuple]) -> list[tuple]:
    """Lines that are a bare code fence, outside comments and strings that span them."""
    inside = {k for kind, _, line, _, said, _ in rows for k in range(line, line + said.count("\n") + 1) if kind in ("comment", "string") and "\n" in said}
    return [("fence", "", k + 1, len(s) - len(s.lstrip()) + 1, s.strip(), False) for k, s in enumerate(text.split("\n")) if "```" in s and re.fullmatch(r"\s*```[\w+-]*\s*", s) and k + 1 not in inside]


#: Words of a comment that runs long.
LONG = 40
_TOKEN, _PLAIN = re.compile(r"\w\S*", re.A), re.compile(r"[\w\s]+", re.A)
_NOTICE, _MADE = re.compile("copyright|licen[cs]e|spdx", re.I | re.A), re.compile("do not edit|@generated", re.I | re.A)


def long_comments(comments: list[tuple], most: int = LONG) -> list[tuple]:
    """Plain comments on lines that follow each other, of more than `most` words together; not a licence, not mostly
    signs, not in generated files; in Go only inside functions."""
    plain = sorted((line, col, said) for _, name, line, col, said, flag in comments if flag and name not in ("doc", "top"))
    if any(line <= 5 and _MADE.search(said) for line, _, said in plain):
        return []
    out, island = [], []
    for k, (line, col, said) in enumerate(plain):
        island.append((line, col, said))
        if k + 1 < len(plain) and plain[k + 1][0] == line + 1:
            continue
        said = [x for *_, x in island]
        if len(list(islice(chain.from_iterable(map(_TOKEN.finditer, said)), most + 1))) > most and not any(map(_NOTICE.search, said)) and sum(len(_PLAIN.sub("", x)) for x in said) <= 0.25 * sum(map(len, said)):
            out.append(("long", "", *island[0][:2], "", False))
        island = []
    return out


def single_implementation(rows: list[tuple]) -> list[tuple]:
    """Abstractions with exactly one implementor in their file."""
    by = defaultdict(set)
    for kind, name, _, _, said, _ in rows:
        if kind == "implements":
            by[name].add(said)
    return [("single", name, line, col, "", False) for kind, name, line, col, *_ in rows if kind == "abstract" and len(by.get(name, ())) == 1]


def rows_of(text: str, lang: str) -> list[tuple]:
    if lang == "python":
        rows = python_rows(text)
    else:
        rows, code = lexed(text, lang)
        rows += brace_facts(text, code, lang)
    comments = [r for r in rows if r[0] == "comment"]
    return [*rows, *restating(text, comments), *fences(text, rows), *long_comments(comments), *single_implementation(rows)]


def nodes(docs: DataFrame) -> DataFrame:
    """Rows of documents(path, lang, text) in a code language. A file that breaks the front end has a row `error`."""
    from proselens.plans.catalog import CODE

    def read(batches):
        import pyarrow as pa

        schema = pa.schema([("path", pa.string()), ("lang", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("line", pa.int32()), ("col", pa.int32()), ("text", pa.string()), ("flag", pa.bool_())])
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        for batch in batches:
            out, size = [], 0
            for path, lang, text in zip(*batch.columns):
                path, lang, text = path.as_py(), lang.as_py(), text.as_py()
                try:
                    rows = rows_of(text or "", lang)
                except Exception as e:  # one file's failure isn't the job's
                    rows = [("error", type(e).__name__, 1, 1, str(e), False)]
                out += [(path, lang, *row) for row in rows]
                size += len(text or "")
                if size > SENT:
                    if out:
                        yield made(out)
                    out, size = [], 0
            if out:
                yield made(out)

    return docs.where(docs["lang"].isin(*CODE)).select("path", "lang", "text").mapInArrow(read, SCHEMA)
