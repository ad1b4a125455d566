"""The whole run: documents and images to findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proselens.operators import code, design, pipeline, prose, provenance
from proselens.plans import catalog
from proselens.sources import code as front_code
from proselens.sources import images as front_images
from proselens.sources import markup, style
from proselens.sources.config import Config

EMPTY = "code string, path string, line int, col int"


def _empty(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], EMPTY)


def prose_findings(docs: DataFrame, codes: set[str], natlangs) -> DataFrame:
    """Each enabled rule reads the masked texts of its languages. The masked table is shared by all of them: Python masks
    a document once however many rules there are, if the caller's session keeps it (see `lint`)."""
    out = []
    for c, rule in prose.RULES.items():
        if c in codes:
            out.append(rule(docs.where(F.col("lang").isin(*catalog.RULES[c].langs)), natlangs))
            if c == "PL015":
                out.append(prose.hedge_stack(docs.where(F.col("lang").isin(*catalog.RULES[c].langs)), natlangs))
    return reduce(DataFrame.unionByName, out) if out else _empty(docs)


def code_findings(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    rows = front_code.nodes(docs).persist()
    found = code.all_rules(docs, rows, known)
    return found.unionByName(code.row_rules(markup.attributes(docs)))


def lint(docs: DataFrame, config: Config | None = None, known: DataFrame | None = None, images: DataFrame | None = None, baseline: DataFrame | None = None) -> DataFrame:
    """Findings (code, name, tier, path, line, col, message, fix) of documents(path, lang, text): rules, then suppression, then
    ignores by path, then the baseline. Only derivations that an enabled rule needs are planned."""
    config = config or Config()
    custom = {f"PL{900 + k}": rule for k, rule in enumerate(config.custom_rule)}
    codes, _ = catalog.enabled(config.select, config.extend_select, config.ignore, config.extend_ignore, known is not None, tuple(custom))
    parts = []
    needs = lambda names: bool(codes & set(names))
    if needs(prose.RULES):
        masked = markup.masked(docs.where(F.col("lang").isin(*catalog.PROSE)).select("path", "lang", "text")).persist()
        parts.append(prose_findings(masked, codes, tuple(config.language)))
    if "PL044" in codes:
        parts.append(prose.page_title(docs.where("lang = 'html'")))
    if "PL057" in codes:
        parts.append(prose.separators(docs.where("lang in ('html', 'tsx')")))
    if needs(c for c, r in catalog.RULES.items() if set(r.langs) & set(catalog.CODE) and r.group != "design"):
        parts.append(code_findings(docs, known))
    if needs(catalog.GROUPS["design"]):
        parts.append(design.all_rules(style.declarations(docs).persist()))
    if images is not None and needs(("PL046", "PL047", "PL048")):
        parts.append(provenance.rules(front_images.metadata(images)))
    if images is not None and "PL049" in codes:
        parts.append(provenance.spectrum(front_images.ridges(images)))
    for c, rule in custom.items():
        if c in codes:
            kind = next(k for k in ("phrase", "max-lines", "forbid", "require") if k in rule)
            parts.append(pipeline.custom(docs, c, kind, rule[kind], rule.get("files")))
    found = reduce(DataFrame.unionByName, parts, _empty(docs)).where(F.col("code").isin(sorted(codes)))
    found = pipeline.suppressed(found, pipeline.suppressions(docs))
    full = pipeline.with_catalog(pipeline.path_ignored(found, config.per_file_ignores), custom).select("code", "name", "tier", "path", "line", "col", "message", "fix")
    return pipeline.beyond_baseline(full, baseline) if baseline is not None else full
