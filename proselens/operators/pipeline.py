"""What happens to findings: suppression, ignores by path, baselines, custom rules, statistics and rendering."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A directive opens a comment: `proselens: ignore`, with codes in brackets or none, or `ignore-file`.
DIRECTIVE = r"(?:^|\s)(?:<!--|//|#|/\*)\s*proselens:\s*(ignore-file|ignore)(?:\[([A-Za-z0-9, ]*)\])?"


def suppressions(docs: DataFrame) -> DataFrame:
    """path, line (of the comment), file_wide, scope (codes; null: all)."""
    rows = docs.where(F.col("text").contains("proselens:")).select("path", F.posexplode(F.split("text", "\n", -1)).alias("i", "s")).where(F.col("s").rlike(DIRECTIVE))
    codes = F.regexp_extract("s", DIRECTIVE, 2)
    scope = F.when(F.trim(codes) != "", F.transform(F.split(codes, ","), lambda c: F.upper(F.trim(c))))
    return rows.select("path", (F.col("i") + 1).alias("line"), (F.regexp_extract("s", DIRECTIVE, 1) == "ignore-file").alias("file_wide"), scope.alias("scope"))


def suppressed(findings: DataFrame, which: DataFrame) -> DataFrame:
    """Findings that no directive covers: two equality joins, one by file and one by line, rather than a join on `or`.
    A line's directive covers its own line and the next."""
    scope = lambda rows: rows.groupBy(*[c for c in rows.columns if c != "scope"]).agg(F.max(F.col("scope").isNull()).alias("every"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("scope", F.array().cast("array<string>"))))).alias("codes"))
    files = scope(which.where("file_wide").select("path", "scope"))
    near = scope(which.where("not file_wide").select("path", F.explode(F.array(F.col("line"), F.col("line") + 1)).alias("line"), "scope"))
    covers = lambda t: t["every"] | F.array_contains(t["codes"], findings["code"])
    kept = findings.join(files, (findings["path"] == files["path"]) & covers(files), "left_anti")
    return kept.join(near, (findings["path"] == near["path"]) & (findings["line"] == near["line"]) & covers(near), "left_anti")


def dead_suppressions(findings: DataFrame, which: DataFrame) -> DataFrame:
    """Directives that cover no finding."""
    hit = (findings["path"] == which["path"]) & (which["file_wide"] | (findings["line"] == which["line"]) | (findings["line"] == which["line"] + 1)) & (which["scope"].isNull() | F.array_contains(which["scope"], findings["code"]))
    return which.join(findings, hit, "left_anti")


def glob_regex(glob: str) -> str:
    """A path glob as a regular expression: `**` crosses folders, `*` and `?` don't."""
    out, i = "", 0
    glob = glob.removeprefix("./")
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out, i = out + "(?:" + "|".join(map(re.escape, glob[i + 1 : end].split(","))) + ")", end + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^(?:\\./)?{out}$"


def path_ignored(findings: DataFrame, ignores: dict[str, list[str]]) -> DataFrame:
    """Findings without those whose path matches a glob that ignores their code. The config is a handful of globs, so
    they are one predicate."""
    from proselens.plans.catalog import RULES, expanded

    for glob, patterns in ignores.items():
        codes = sorted(expanded(patterns, RULES)[0] | set(patterns))
        findings = findings.where(~(F.col("path").rlike(glob_regex(glob)) & F.col("code").isin(codes)))
    return findings


def fingerprint() -> Column:
    """Path, code and message with digits masked: what a baseline counts."""
    return F.concat_ws("|", F.regexp_replace("path", r"^\./", ""), "code", F.regexp_replace("message", "[0-9]", "#"))


def baseline_of(findings: DataFrame) -> DataFrame:
    return findings.groupBy(fingerprint().alias("fingerprint")).agg(F.count(F.lit(1)).cast("int").alias("accepted"))


def beyond_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings beyond the accepted number of each fingerprint, in order of place."""
    rank = F.row_number().over(Window.partitionBy("fingerprint").orderBy("path", "line", "col"))
    ranked = findings.withColumn("fingerprint", fingerprint()).withColumn("rank", rank)
    return ranked.join(baseline, "fingerprint", "left").where(F.col("rank") > F.coalesce("accepted", F.lit(0))).select(*findings.columns)


def with_catalog(findings: DataFrame, custom: dict[str, dict] | None = None) -> DataFrame:
    """Findings with name, tier, message and fix; the catalogue has 57 rows and one for each rule of the user's."""
    from proselens.plans import catalog

    rules = catalog.frame(findings.sparkSession, custom).select("code", "name", "tier", "message", "fix")
    return findings.join(F.broadcast(rules), "code", "left")


def stats(findings: DataFrame) -> DataFrame:
    """Count and distinct files of each rule, most first."""
    return findings.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("path").alias("files")).orderBy(F.desc("n"), "code")


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy("path", "line", "col", "code")


def as_text(findings: DataFrame) -> DataFrame:
    """A line a finding, and what may be done about it on a line below."""
    said = F.concat_ws(" ", F.concat_ws(":", "path", F.col("line").cast("string"), F.col("col").cast("string")), "code", "message")
    return findings.select(F.concat_ws("\n    fix: ", said, "fix").alias("value"))


def as_json(findings: DataFrame) -> DataFrame:
    return findings.select(F.to_json(F.struct("code", "name", "tier", "path", "line", "col", "message", "fix")).alias("value"))


def as_markdown(findings: DataFrame) -> DataFrame:
    """A section a tier: its findings as list items, in order."""
    item = F.concat(F.lit("- `"), F.concat_ws(":", "path", F.col("line").cast("string"), F.col("col").cast("string")), F.lit("` "), F.col("code"), F.lit(" "), F.col("message"))
    return findings.select("tier", "path", "line", "col", "code", item.alias("value")).orderBy("tier", "path", "line", "col", "code").select("tier", "value")


def as_sarif(findings: DataFrame) -> DataFrame:
    """One SARIF 2.1.0 result a finding, as JSON; `sinks.write_sarif` wraps them."""
    level = F.create_map(*[F.lit(x) for x in ("A", "error", "B", "warning", "C", "note")])[F.col("tier")]
    region = F.struct(F.col("line").alias("startLine"), F.col("col").alias("startColumn"))
    where = F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))
    return findings.select(F.to_json(F.struct(F.col("code").alias("ruleId"), level.alias("level"), F.struct(F.concat_ws(". Fix: ", "message", "fix").alias("text")).alias("message"), where.alias("locations"))).alias("value"))


def custom(docs: DataFrame, code: str, kind: str, value: str | int, files: str | None = None) -> DataFrame:
    """Findings of a user's rule: `phrase` (every match), `max-lines` (the line after), `forbid` (the first match) or
    `require` (1:1 where it is missing)."""
    from proselens.operators.prose import at_match, each_match

    rows = docs.where(F.col("path").rlike(glob_regex(files))) if files else docs
    whole = lambda r, line: r.select(F.lit(code).alias("code"), "path", F.lit(line).cast("int").alias("line"), F.lit(1).alias("col"))
    if kind == "phrase":
        return each_match(rows, code, str(value))
    if kind == "max-lines":
        return whole(rows.where(F.size(F.split("text", "\n", -1)) > int(value)), int(value) + 1)
    if kind == "forbid":
        return at_match(rows.where(F.col("text").rlike(str(value))), code, str(value))
    if kind == "require":
        return whole(rows.where(~F.col("text").rlike(str(value))), 1)
    raise ValueError(f"unknown kind of rule: {kind}")


def write_baseline(findings: DataFrame, path: str) -> None:
    """The baseline of `findings` as one JSON object a line: fingerprint and accepted."""
    baseline_of(findings).write.mode("overwrite").json(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("fingerprint string, accepted int").json(path)
