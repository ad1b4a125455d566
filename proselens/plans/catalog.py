"""The catalogue of rules, their groups and tiers, and the algebra that selects among them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from proselens.plans.messages import MESSAGES

CODE, PROSE, STYLE = ("ts", "tsx", "python", "go", "rust"), ("md", "mdx", "txt", "rst", "html"), ("css", "html", "tsx")
BOTH, EN = ("en", "pt"), ("en",)
_RAW = """
001 artifact A on code+html both elision comment
002 artifact A on code both chat preamble in code
003 artifact A on code all stray code fence
004 artifact A on code both tool attribution
005 structure A on ts,tsx,go,rust all gate empty or log-only handler
006 structure A on python all gate broad except
007 structure A on ts,tsx all type escape
008 structure A on code all gate stub body
009 structure A on code+html both gate sample value
010 structure B off code all gate unresolved import
011 artifact A on prose both assistant residue
012 artifact A on prose all tool tokens
013 artifact A on prose both unfilled template
014 rhetoric B on prose en cliche
015 verbosity B on prose both hedging density
016 verbosity B on prose en vocabulary density
017 rhetoric B on prose both parallelism density
018 format B on prose all mid-prose dash
019 format B on md,mdx,html all boldface overuse
020 format B off prose all smart quotes
021 format B on md,mdx,html both heading style
022 rhetoric B on prose both formulaic opener
023 rhetoric B on prose both binary contrast
024 rhetoric B on prose both puffery
025 sourcing B on prose both unsourced attribution
026 rhetoric B on prose both colon reveal
027 verbosity B on prose both filler density
028 verbosity B on prose both weak verbs
029 rhetoric B on prose both recap ending
030 rhetoric B on prose all fragmentation
031 rhetoric B on prose both promotion
032 verbosity B on prose en hyphenated compounds
033 verbosity B on prose all overlong sentence
034 verbosity B on prose both synonym rotation
035 rhetoric B on prose both outline section
036 rhetoric B on prose both diff-anchored prose
037 stdlib B on code all gate reinvented standard function
038 stdlib B on ts,tsx all gate redundant dependency
039 structure B on code all gate pass-through wrapper
040 structure B on ts,tsx,python all gate single implementation
041 verbosity B on prose all mechanical uniformity
042 verbosity B on code both gate restating comment
043 verbosity B off ts,tsx,python,go,rust all gate long comment
044 artifact B on html all page title
045 format C off ts,tsx,python,rust all gate uniform code
046 provenance A on image all generation prompt
047 provenance A on image all declared source type
048 provenance B on image all generator name
049 provenance C off image all spectrum ridge
050 artifact B on code en stand-in comment
051 artifact B on code en demo comment
052 design B on style all gradient text
053 design B on style all purple gradient
054 design C off style all violet hex
055 design B on html,tsx all violet accent
056 design B on css,html all violet theme
057 format B on tsx,html all decorative separator
"""


@dataclass(frozen=True)
class Rule:
    code: str
    name: str
    group: str
    tier: str
    default_on: bool
    langs: tuple[str, ...]
    natlangs: tuple[str, ...]
    path_gated: bool


def _langs(text: str) -> tuple[str, ...]:
    named = {"code": CODE, "prose": PROSE, "style": STYLE, "code+html": (*CODE, "html")}
    return named.get(text, tuple(text.split(",")))


def _parsed(line: str) -> Rule:
    number, group, tier, on, langs, natlangs, *rest = line.split()
    gated = rest[0] == "gate"
    return Rule(f"PL{number}", " ".join(rest[gated:]), group, tier, on == "on", _langs(langs), {"both": BOTH, "en": EN, "all": ()}[natlangs], gated)


RULES = {r.code: r for r in map(_parsed, _RAW.strip().split("\n"))}
GROUPS: dict[str, list[str]] = {}
for _r in RULES.values():
    GROUPS.setdefault(_r.group, []).append(_r.code)
TIERS = {"A": 0, "B": 1, "C": 2}


def expanded(patterns, known) -> tuple[set[str], list[str]]:
    """Codes that the patterns name (a code, the start of one, a group, or ALL), and patterns that name none."""
    found, unmatched = set(), []
    for p in patterns:
        hit = set(known) if p.upper() == "ALL" else {c for c in GROUPS.get(p.lower(), ()) if c in known} or {c for c in known if c.startswith(p.upper())}
        found |= hit
        if not hit:
            unmatched.append(p)
    return found, unmatched


def enabled(select=(), extend_select=(), ignore=(), extend_ignore=(), check_imports: bool = False, custom: tuple[str, ...] = ()) -> tuple[set[str], list[str]]:
    """The enabled codes, and the patterns that matched none. `select` replaces the defaults, `extend_select` adds,
    the two ignores take away last; unresolved imports are on with `check_imports` and off without it."""
    known = [*RULES, *custom]
    chosen, bad = expanded(select, known) if select else ({c for c, r in RULES.items() if r.default_on} | set(custom), [])
    more, bad2 = expanded(extend_select, known)
    chosen |= more
    if check_imports:
        chosen.add("PL010")
    else:
        chosen.discard("PL010")
    less, bad3 = expanded([*ignore, *extend_ignore], known)
    chosen -= less
    if not chosen:
        raise ValueError("no rule is left to run")
    return chosen, [*bad, *bad2, *bad3]


def frame(spark: SparkSession, custom: dict[str, dict] | None = None) -> DataFrame:
    """The catalogue as a table, with the user's rules (code to rule) after it."""
    rows = [(r.code, r.group, r.name, r.tier, list(r.langs), list(r.natlangs), r.default_on, r.path_gated, *MESSAGES[r.code]) for r in RULES.values()]
    for code, rule in (custom or {}).items():
        name = rule.get("name", code)
        rows.append((code, "custom", name, rule.get("tier", "B"), [], [], True, "files" in rule, rule.get("message", name), rule.get("fix")))
    return spark.createDataFrame(rows, "code string, grp string, name string, tier string, langs array<string>, natlangs array<string>, default_on boolean, path_gated boolean, message string, fix string")


def fails(worst_tiers, floor: str | None) -> bool:
    """Whether findings of these tiers fail a gate at `floor` (all of them, where it is None)."""
    return any(TIERS[t] <= TIERS[floor or "C"] for t in worst_tiers)
