"""Rules over code, from the rows of `sources.code`: filters, patterns, joins and islands as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proselens.functions import lexicon as L
from proselens.functions.patterns import java
from proselens.sources.code import STDLIB_FIXES

#: Test, vendored and example files, which gated rules pass over.
GATED = r"(?i)(?:^|/)(?:tests?|__tests__|spec|mocks?|__mocks__|fixtures?|testdata|vendor|node_modules|examples?|samples?|third_party|stories)/|(?:^|/)(?:test_[^/]*|[^/]*_test\.\w+|[^/]*\.(?:test|spec|stories)\.\w+|conftest\.py)$"


def _out(rows: DataFrame, code: str) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), "path", "line", "col")


def _open(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("path").rlike(GATED))


def _kind(rows: DataFrame, *kinds: str) -> DataFrame:
    return rows.where(F.col("kind").isin(*kinds))


#: What opens a comment, before a pattern that is anchored at its first word.
OPENING = r"^(?:(?:/\*+|//+|#+|<!--)\s*)?"


#: Facts that the front end has established, by the rule they are findings of.
FACTS = {"fence": "PL003", "catch": "PL005", "except": "PL006", "cast": "PL007", "stub": "PL008", "long": "PL043", "reinvent": "PL037", "single": "PL040", "wrapper": "PL039", "restate": "PL042"}


def row_rules(rows: DataFrame) -> DataFrame:
    """All rules that look at one row: the front end runs once for them, and each row tells the rules it breaks."""
    kind, text, lang = F.col("kind"), F.col("text"), F.col("lang")
    comment = (kind == "comment") & (F.col("name") != "doc")
    free = ~F.col("path").rlike(GATED)
    value = kind.isin("string", "attr") & (F.col("name") != "doc")
    conditions = [
        ("PL001", comment & F.col("flag") & text.rlike(java(L.ELISION))),
        ("PL002", comment & text.rlike(java(L.PREAMBLE))),
        ("PL004", comment & text.rlike(java(L.ATTRIBUTION))),
        ("PL050", comment & text.rlike(java(L.STAND_IN))),
        ("PL051", comment & text.rlike(java(OPENING + L.DEMO.removeprefix("^")))),
        ("PL007", comment & lang.isin("ts", "tsx") & text.rlike(r"@ts-(?:ignore|nocheck)(?!\s*\[)")),
        ("PL009", value & free & (text.rlike(java(L.SAMPLE_VALUE)) | text.rlike(L.SECRET_SHAPE) | text.rlike(L.PLACEHOLDER_HOST))),
        ("PL037", (kind == "string") & free & text.contains("@") & text.rlike(r"\[[^\]]*a-z[^\]]*\]\+?.*@.*\[[^\]]*a-z")),
        ("PL038", (kind == "import") & free & lang.isin("ts", "tsx") & F.col("name").isin(*STDLIB_FIXES)),
    ]
    conditions += [(code, (kind == fact) & (F.lit(fact in ("fence", "cast")) | free) & (F.lit(fact != "stub") | ~F.col("path").endswith(".pyi"))) for fact, code in FACTS.items()]
    broken = F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in conditions]))
    return rows.select(F.explode(broken).alias("code"), "path", "line", "col")


def unresolved(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Imports whose package is in none of `known`(ecosystem, name): declared, built in or beside the file. Ecosystems
    without any declared package are silent."""
    eco = F.create_map(*[F.lit(x) for x in ("python", "python", "ts", "node", "tsx", "node", "go", "go", "rust", "rust")])[F.col("lang")]
    package = F.when(eco == "node", F.regexp_extract("name", r"^(@[^/]+/[^/]+|[^/]+)", 1)).when(eco == "python", F.translate(F.lower("name"), "-.", "__")).otherwise(F.col("name"))
    imports = _open(_kind(rows, "import")).withColumn("ecosystem", eco).withColumn("package", package).where(~F.col("name").rlike(r"^[./]|^node:")).where((eco != "go") | F.regexp_extract("name", "^[^/]+", 0).contains("."))
    live = F.broadcast(known.select("ecosystem").distinct())  # four of them
    names = known.select("ecosystem", F.when(F.col("ecosystem") == "python", F.translate(F.lower("name"), "-.", "__")).otherwise(F.col("name")).alias("package")).distinct()
    return _out(imports.join(live, "ecosystem", "left_semi").join(names, ["ecosystem", "package"], "left_anti"), "PL010")


def long_comments(rows: DataFrame) -> DataFrame:
    """The files' long comments alone; `row_rules` has them too."""
    return _out(_open(_kind(rows, "long")), "PL043")


def uniform_code(docs: DataFrame) -> DataFrame:
    """Sixty lines of code or more, of even lengths in even blocks: variation of line lengths under 0.30 and of block
    lengths under 0.25, with three indents and five blocks, and no white space at line ends."""
    many = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"))) >= 59
    rows = _open(docs.where(F.col("lang").isin("ts", "tsx", "python", "rust") & many & ~F.col("text").rlike(r"[ \t]\n|(?i)@generated|do not edit"))).withColumn("l", F.split("text", "\n", -1))
    full = F.filter("l", lambda s: F.length(F.trim(s)) >= 4)
    lengths = F.transform(full, lambda s: F.length(F.rtrim(s)).cast("double"))
    blocks = F.transform(F.filter(F.split("text", r"\n(?:[ \t]*\n)+", -1), lambda b: b.rlike(r"\S")), lambda b: F.size(F.split(b, "\n")).cast("double"))
    indents = F.size(F.array_distinct(F.transform(full, lambda s: F.length(s) - F.length(F.ltrim(s)))))

    def cv(a: Column) -> Column:
        total = F.aggregate(a, F.lit(0.0), lambda t, x: t + x)
        squares = F.aggregate(a, F.lit(0.0), lambda t, x: t + x * x)
        mean = F.try_divide(total, F.size(a))
        return F.try_divide(F.sqrt(F.greatest(F.try_divide(squares, F.size(a)) - mean * mean, F.lit(0.0))), mean)

    hit = rows.where((F.size(full) >= 60) & (F.size(blocks) >= 5) & (indents >= 3)).where((cv(lengths) < 0.30) & (cv(blocks) < 0.25))
    return hit.select(F.lit("PL045").alias("code"), "path", F.lit(1).alias("line"), F.lit(1).alias("col"))


def all_rules(docs: DataFrame, rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The front end's rows are read once, file by file, and nothing is shuffled (but for `known`)."""
    out = row_rules(rows).unionByName(uniform_code(docs))
    return out.unionByName(unresolved(rows, known)) if known is not None else out
