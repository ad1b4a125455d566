"""Design rules over style rows: declarations by block, class lists by token arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VIOLET_HEX = r"(?i)#(?:8b5cf6|7c3aed|6d28d9|a78bfa|6366f1|4f46e5|818cf8|a855f7|9333ea)(?![0-9a-f])"
ACCENT = r"^(?:bg|text|border|ring|from|via|to|fill|stroke|outline|decoration|shadow|accent|caret)-(?:violet|purple|indigo)-[4-7]00(?:/\d+)?$"
MARKERS = ("--background", "--foreground", "--card", "--popover", "--primary", "--secondary", "--muted", "--accent", "--destructive", "--border", "--input", "--ring", "--radius")


def _out(rows: DataFrame, code: str) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), "path", "line", "col")


def _utilities() -> Column:
    """The list's utilities, without variants and emphasis."""
    return F.transform(F.split("value", " "), lambda t: F.regexp_replace(F.regexp_replace(t, r"^(?:[^\[\]:]|\[[^\]]*\])*:(?=[^\]]*$)", ""), "^!|!$", ""))


def gradient_text(rows: DataFrame) -> DataFrame:
    clip = (F.col("property").rlike("^(?:-webkit-)?background-clip$")) & F.col("value").rlike(r"\btext\b")
    blocks = rows.where("kind = 'decl'").groupBy("path", "block").agg(F.max(clip).alias("a"), F.max(F.col("property").rlike("^background(?:-image)?$") & F.col("value").contains("gradient(")).alias("b"), F.min_by(F.struct("line", "col"), F.when(clip, F.struct("line", "col"))).alias("at"))
    css = blocks.where("a and b").select("path", F.col("at.line").alias("line"), F.col("at.col").alias("col"))
    u = _utilities()
    lists = rows.where((F.col("kind") == "class") & F.array_contains(u, "bg-clip-text") & F.exists(u, lambda t: t.rlike(r"^bg-(?:gradient-to-|linear-|\[linear-gradient)")))
    return _out(css, "PL052").unionByName(_out(lists, "PL052"))


def _purple(hues: Column, sats: Column, alphas: Column) -> Column:
    """Opaque stops, all saturated and between blue and pink, one blue and one purple."""
    z = F.filter(F.arrays_zip(hues.alias("h"), sats.alias("s"), alphas.alias("a")), lambda x: x["a"] >= 0.5)
    return (F.size(z) >= 2) & F.forall(z, lambda x: (x["s"] >= 0.35) & x["h"].between(225, 330)) & F.exists(z, lambda x: x["h"].between(225, 255)) & F.exists(z, lambda x: x["h"].between(255, 290))


def purple_gradient(rows: DataFrame) -> DataFrame:
    own = _purple(F.col("hues"), F.col("sats"), F.col("alphas"))
    css = rows.where((F.col("kind") == "decl") & F.col("value").contains("gradient(") & own)
    u = _utilities()
    start = F.exists(u, lambda t: t.rlike(r"^from-(?:blue|indigo)-[4-7]00$"))
    end = F.exists(u, lambda t: t.rlike(r"^(?:via|to)-(?:purple|violet|fuchsia)-[4-7]00$"))
    back = F.exists(u, lambda t: t.rlike(r"^from-(?:purple|violet)-[4-7]00$")) & F.exists(u, lambda t: t.rlike(r"^(?:via|to)-(?:blue|indigo)-[4-7]00$"))
    lists = rows.where((F.col("kind") == "class") & ((start & end) | back | (F.exists(u, lambda t: t.startswith("from-[")) & own)))
    return _out(css, "PL053").unionByName(_out(lists, "PL053"))


def violet_hex(rows: DataFrame) -> DataFrame:
    hit = F.col("value").rlike(VIOLET_HEX) & ~F.col("value").contains("gradient(") & ~F.coalesce(F.col("property"), F.lit("")).startswith("--") & ~F.col("value").rlike(r"(?:from|via|to)-\[#")
    return _out(rows.where(hit), "PL054")


def violet_accent(rows: DataFrame) -> DataFrame:
    u = _utilities()
    return _out(rows.where((F.col("kind") == "class") & F.col("lang").isin("html", "tsx") & F.exists(u, lambda t: t.rlike(ACCENT)) & ~F.array_contains(u, "bg-clip-text")), "PL055")


def violet_theme(rows: DataFrame) -> DataFrame:
    violet = F.col("property").isin("--primary", "--accent", "--ring") & (F.size("hues") > 0) & F.get("hues", F.lit(0)).between(248, 285) & (F.get("sats", F.lit(0)) >= 0.35)
    blocks = rows.where((F.col("kind") == "decl") & F.col("lang").isin("css", "scss", "html")).groupBy("path", "block").agg(F.count_distinct(F.when(F.col("property").isin(*MARKERS), F.col("property"))).alias("n"), F.min(F.when(violet, F.struct("line", "col"))).alias("at"))
    return _out(blocks.where("n >= 2 and at is not null").select("path", F.col("at.line").alias("line"), F.col("at.col").alias("col")), "PL056")


def all_rules(rows: DataFrame) -> DataFrame:
    out = gradient_text(rows)
    for rule in (purple_gradient, violet_hex, violet_accent, violet_theme):
        out = out.unionByName(rule(rows))
    return out
