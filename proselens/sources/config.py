"""Configuration: a TOML file of known keys, and manifests of declared packages."""

from __future__ import annotations

import json
import re
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

NAME = "proselens.toml"
LANGUAGES = {"en": "en", "pt": "pt"}


@dataclass
class Config:
    select: list[str] = field(default_factory=list)
    extend_select: list[str] = field(default_factory=list)
    ignore: list[str] = field(default_factory=list)
    extend_ignore: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    per_file_ignores: dict[str, list[str]] = field(default_factory=dict)
    fail_on_tier: str | None = None
    language: list[str] = field(default_factory=lambda: ["en", "pt"])
    custom_rule: list[dict] = field(default_factory=list)

    @classmethod
    def of(cls, table: dict) -> Config:
        known = {f.name.replace("_", "-"): f.name for f in fields(cls)}
        for key in table:
            if key not in known:
                raise ValueError(f"unknown key: {key}")
        made = cls(**{known[k]: v for k, v in table.items()})
        if isinstance(made.language, str):
            made.language = [made.language]
        tags = [LANGUAGES.get(t.split("-")[0].lower()) for t in made.language]
        if None in tags:
            raise ValueError(f"unknown language: {made.language}")
        made.language = list(dict.fromkeys(tags))
        if made.fail_on_tier not in (None, "A", "B", "C"):
            raise ValueError(f"unknown tier: {made.fail_on_tier}")
        for rule in made.custom_rule:
            kinds = [k for k in ("phrase", "max-lines", "forbid", "require") if k in rule]
            if len(kinds) != 1 or set(rule) - {*kinds, "message", "fix", "tier", "files", "name"}:
                raise ValueError(f"a rule needs one of phrase, max-lines, forbid and require: {rule}")
            for k in {"phrase", "forbid", "require"} & set(rule):
                re.compile(rule[k])
        return made

    @classmethod
    def find(cls, start: str = ".", home: str | None = None) -> Config:
        """The nearest file upwards, else the user's, else the defaults. Files are never merged."""
        here = Path(start).resolve()
        for place in [*(p / NAME for p in [here, *here.parents]), *([Path(home) / NAME] if home else [])]:
            if place.is_file():
                return cls.of(tomllib.loads(place.read_text()))
        return cls()


def declared(manifests: dict[str, str]) -> list[tuple[str, str]]:
    """(ecosystem, package) of manifests by file name; built-in modules of Python and Node included where declared."""
    import sys

    out: set[tuple[str, str]] = set()
    for path, text in manifests.items():
        name = Path(path).name
        if name == "package.json":
            table = json.loads(text)
            for key in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"):
                out |= {("node", p) for p in table.get(key, {})}
            out |= {("node", p) for p in "assert buffer child_process crypto events fs http https net os path process querystring readline stream timers url util zlib".split()}
        elif name == "pyproject.toml":
            table = tomllib.loads(text)
            listed = [*table.get("project", {}).get("dependencies", []), *(d for ds in table.get("project", {}).get("optional-dependencies", {}).values() for d in ds), *table.get("tool", {}).get("poetry", {}).get("dependencies", {})]
            out |= {("python", re.match(r"[\w.-]+", d)[0]) for d in listed if re.match(r"[\w.-]+", d)}
        elif re.fullmatch(r"requirements.*\.txt", name):
            out |= {("python", m[0]) for line in text.split("\n") if (m := re.match(r"[A-Za-z][\w.-]*", line.strip()))}
        elif name == "go.mod":
            out |= {("go", m[1]) for m in re.finditer(r"(?m)^\s*(?:require\s+)?([\w.-]+\.[\w.-]+/\S+|[\w.-]+\.[a-z]+)\s+v\d", text)}
        elif name == "Cargo.toml":
            table = tomllib.loads(text)
            out |= {("rust", p.replace("-", "_")) for k in ("dependencies", "dev-dependencies", "build-dependencies") for p in table.get(k, {})}
            out |= {("rust", p) for p in ("std", "core", "alloc", "crate", "self", "super")}
    if any(e == "python" for e, _ in out):
        out |= {("python", m) for m in sys.stdlib_module_names}
    return sorted(out)
