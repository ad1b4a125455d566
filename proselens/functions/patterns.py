"""A small notation for phrases, and its two regular-expression dialects: java.util.regex for Spark, RE2 for the oracle.

A phrase is words with one space between them. `a/b` is either word (`_` stands for a space in one); `(a)` may be absent;
`#` is any word; `<n>` is up to n characters of the same sentence; `~` after a stem takes e, es, ed or ing, `+` nothing,
s, ed or ing, and `^` y, ies, ied or ying; an apostrophe may be absent; an accented letter also matches the plain one.

Word boundaries are ASCII ones in either dialect: Java's own are wider, so it gets look-arounds.
"""

from __future__ import annotations

import re
import unicodedata

OPEN, CLOSE = "«", "»"  # a boundary before a word, and after one
AHEAD, END_AHEAD = "‹[", "›"  # a look at the first letter, which RE2 does without
_ENDINGS = {"~": "(?:e|es|ed|ing)", "+": "(?:s|ed|ing)?", "^": "(?:y|ies|ied|ying)"}


def _letters(text: str) -> str:
    out = []
    for c in text:
        plain = unicodedata.normalize("NFD", c)[0]
        if c in _ENDINGS:
            out.append(_ENDINGS[c])
        elif c == "'":
            out.append("'?")
        elif c == "#":
            out.append(r"\w+")
        elif plain != c:
            out.append(f"[{c}{plain}]")
        elif c == "_":
            out.append(" ")
        elif c in ".?[]{}()|\\*$":
            out.append("\\" + c)
        else:
            out.append(c)
    return "".join(out)


def _either(token: str) -> str:
    parts = sorted(token.split("/"), key=len, reverse=True)
    return _letters(parts[0]) if len(parts) == 1 else "(?:" + "|".join(map(_letters, parts)) + ")"


def phrase(text: str, bounded: bool = True) -> str:
    out, first = [], True
    for token in text.split(" "):
        if token.startswith("<"):
            n = token.strip("<>,")
            out.append(rf"[^.!?\n]{{0,{n}}}?" + (r",\s*" if token.endswith(",") else r"\s*" if token.endswith(">") else ""))
            first = True
            continue
        gap = "" if first else " "
        if token.startswith("(") and token.endswith(")"):
            out.append(f"(?:{gap}{_either(token[1:-1])})?" if not first else f"(?:{_either(token[1:-1])} )?")
            first = first and not gap
            continue
        out.append(gap + _either(token))
        first = False
    body = "".join(out)
    if not bounded:
        return body
    head = "" if ord(text.lstrip("(")[0]) > 127 else OPEN
    return head + body + CLOSE


class Panel(str):
    """A pattern that knows `needles`: lower-case strings of which every match has one. A text without any is passed over
    before the pattern is tried."""

    needles: frozenset[str]

    @classmethod
    def of(cls, pattern: str, needles) -> Panel:
        made = cls(pattern)
        made.needles = frozenset(needles)
        return made


def needles(text: str) -> set[str]:
    """Lower-case strings of which every match of a phrase has one: the longest run of plain words that it can't do
    without, or the longest plain parts of the alternatives of a word."""
    best: tuple[int, set[str]] = (0, set())
    run: list[str] = []

    def offer(found: set[str]) -> None:
        nonlocal best
        if min(map(len, found), default=0) >= best[0]:
            best = min(map(len, found), default=0), found

    for token in [*text.split(" "), ""]:
        if token and re.fullmatch(r"[a-z0-9,:_-]+", token):
            run.append(token.replace("_", " "))
            offer({" ".join(run)})
            continue
        run = []
        if token and token[0] not in "(<#":
            offer({max(re.findall(r"[a-z0-9 -]+", x.lower().rstrip("~+^").replace("_", " ")) or [""], key=len) for x in token.split("/")})
    return best[1] if best[0] else set()


def panel(*phrases: str) -> Panel:
    """One pattern for all phrases. The boundary and the possible first letters are tried once a place, before any
    phrase is: most places of a text then cost a look at two characters."""
    plain = [p for p in phrases if ord(p.lstrip("(")[0]) < 128]
    other = [phrase(p) for p in phrases if ord(p.lstrip("(")[0]) >= 128]
    out = []
    if plain:
        firsts = set()
        for p in plain:
            for token in p.split(" "):
                firsts |= {x.lower()[0] for x in token.strip("()").split("/")}
                if not token.startswith("("):
                    break
        head = OPEN + (f"{AHEAD}{''.join(sorted(firsts))}]" if all(c.isalpha() for c in firsts) else "")
        out.append(head + ("" if head == OPEN else END_AHEAD) + "(?:" + "|".join(phrase(p, False) for p in plain) + ")" + CLOSE)
    found = [needles(p) for p in phrases]
    return Panel.of("(?:" + "|".join(out + other) + ")", set().union(*found) if all(found) else ())


def java(pattern: str) -> str:
    return "(?iu)" + exact_java(pattern)


def exact_java(pattern: str) -> str:
    return pattern.replace(OPEN, "(?<![A-Za-z0-9_])").replace(CLOSE, "(?![A-Za-z0-9_])").replace("‹", "(?=").replace(END_AHEAD, ")")


def re2(pattern: str) -> str:
    return "(?i)" + exact_re2(pattern)


def exact_re2(pattern: str) -> str:
    return re.sub("‹[^›]*›", "", pattern).replace(OPEN, r"\b").replace(CLOSE, r"\b")
