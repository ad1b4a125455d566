"""Named queries and the SQL they are held against."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselens.operators import code, corpus, design, pipeline, prose, provenance
from proselens.plans import catalog, fixtures, seeds
from proselens.plans import oracles as O
from proselens.sources import code as front_code
from proselens.sources import images, style
from proselens.streaming import lint as streams

#: Rules whose findings the corpus and pipeline queries read.
USED = ("PL012", "PL018", "PL020", "PL033")
NAMES = {code: f"rule_{code[2:]}_{f.__name__}" for code, f in prose.RULES.items()}
IGNORES = {"doc/1*": ["PL018"], "doc/{2,3}?": ["format"]}


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = seeds.seeded(spark, sf_dir)
    return reduce(DataFrame.unionByName, [prose.RULES[c](docs) for c in USED])


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text, dataset, label, words of every document: quality 1 counts as human, 0 as AI."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    docs = seeds.seeded(spark, sf_dir).join(labels, "doc_id", "left")
    label = F.when(F.col("quality") == 1, "human").when(F.col("quality") == 0, "ai").otherwise("none")
    return docs.select("path", "text", F.col("source").alias("dataset"), label.alias("label"), prose.n_words(F.col("text")).alias("words"))


def directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded texts with a directive before some."""
    head = F.when(F.col("doc_id") % 5 == 0, "<!-- proselens: ignore-file[PL018] -->\n").when(F.col("doc_id") % 5 == 1, "# proselens: ignore-file\n").when(F.col("doc_id") % 5 == 2, "// proselens: ignore[PL033, PL020]\n").otherwise("")
    return seeds.seeded(spark, sf_dir).withColumn("text", F.concat(head, F.col("text")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = seeds.seeded(spark, sf_dir)
    return prose.overlong(docs).unionByName(prose.hedging(docs))


def suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = directed(spark, sf_dir)
    found = reduce(DataFrame.unionByName, [prose.RULES[c](docs) for c in USED])
    return pipeline.suppressed(found, pipeline.suppressions(docs))


def dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = directed(spark, sf_dir)
    found = reduce(DataFrame.unionByName, [prose.RULES[c](docs) for c in USED])
    return pipeline.dead_suppressions(found, pipeline.suppressions(docs)).select("path", "line", "file_wide")


def baselined(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pipeline.with_catalog(findings(spark, sf_dir)).select("code", "path", "line", "col", "message")
    return pipeline.beyond_baseline(found, pipeline.baseline_of(found.where("col % 2 = 0"))).drop("message")


def custom_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = seeds.seeded(spark, sf_dir)
    parts = [("PL900", "phrase", "ing ", "doc/1*"), ("PL901", "max-lines", 12, None), ("PL902", "forbid", "\\bof\\b", None), ("PL903", "require", "[.]", "doc/**")]
    return reduce(DataFrame.unionByName, [pipeline.custom(docs, *p) for p in parts])


def code_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fixtures.code_files(spark, sf_dir)
    return code.all_rules(docs, front_code.nodes(docs)).select("code", "path", "line")


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream that ends where they do, counted by hour and kind."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    name = "events_" + uuid.uuid4().hex
    query = streams.counts(events).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).select("start", "event_type", "n")


def queries() -> dict:
    out = {NAMES[code]: (lambda spark, sf_dir, f=f: f(seeds.seeded(spark, sf_dir))) for code, f in prose.RULES.items()}
    full = lambda s, d: pipeline.with_catalog(findings(s, d))
    out |= {
        "rules_code": code_rules,
        "rules_design": lambda s, d: design.all_rules(style.declarations(fixtures.style_files(s, d))).select("code", "path", "line"),
        "rules_provenance": lambda s, d: provenance.rules(images.metadata(fixtures.image_files(s, d))).select("code", "path", "line"),
        "stream_event_counts": event_counts,
        "rule_015_hedge_stack": lambda s, d: prose.hedge_stack(seeds.seeded(s, d)),
        "rule_044_page_title": lambda s, d: prose.page_title(seeds.pages(s, d)),
        "rule_057_separators": lambda s, d: prose.separators(seeds.pages(s, d)),
        "derive_lines": lambda s, d: prose.lines(seeds.seeded(s, d)),
        "derive_paragraphs": lambda s, d: prose.paragraphs(seeds.seeded(s, d)),
        "derive_sentences": lambda s, d: seeds.seeded(s, d).select("path", F.posexplode(prose.sentences(F.col("text"))).alias("k", "s")).select("path", "k", F.trim("s").alias("s"), prose.n_words(F.col("s")).alias("words")),
        "catalog_rules": lambda s, d: catalog.frame(s).select("code", "grp", "name", "tier", "default_on", "path_gated", "message", "fix"),
        "pipeline_select": lambda s, d: findings(s, d).where(F.col("code").isin(sorted(catalog.enabled(select=["format", "PL033"], ignore=["PL020"])[0]))),
        "pipeline_suppression": suppression,
        "pipeline_dead_suppressions": dead,
        "pipeline_path_ignores": lambda s, d: pipeline.path_ignored(findings(s, d), IGNORES),
        "pipeline_baseline": baselined,
        "pipeline_stats": lambda s, d: pipeline.stats(findings(s, d)),
        "pipeline_sorted": lambda s, d: pipeline.ordered(findings(s, d)),
        "pipeline_custom_rules": custom_rules,
        "sink_text": lambda s, d: pipeline.as_text(full(s, d)),
        "sink_json": lambda s, d: pipeline.as_json(full(s, d)),
        "sink_markdown": lambda s, d: pipeline.as_markdown(full(s, d)),
        "sink_sarif": lambda s, d: pipeline.as_sarif(full(s, d)),
        "corpus_cells": lambda s, d: corpus.cells(files(s, d), findings(s, d)),
        "corpus_scoreboard": lambda s, d: corpus.scoreboard(files(s, d), findings(s, d)),
        "corpus_pooled": lambda s, d: corpus.pooled(files(s, d), findings(s, d)),
        "corpus_matrix": lambda s, d: corpus.matrix(files(s, d), findings(s, d)),
        "corpus_generators": lambda s, d: corpus.generators(files(s, d), findings(s, d)),
        "corpus_paired": lambda s, d: corpus.paired(files(s, d)),
        "corpus_message_shapes": lambda s, d: corpus.message_shapes(full(s, d)),
        "corpus_spread_sample": lambda s, d: corpus.spread_sample(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "source"), "doc_id", 40),
        "corpus_phrases": lambda s, d: corpus.phrase_differential(files(s, d)),
        "corpus_candidates": lambda s, d: corpus.candidates(files(s, d)),
    }
    return out


def oracles() -> dict:
    sql = O.sql()
    out = {NAMES[code]: sql[code] for code in prose.RULES}
    out |= {"rule_015_hedge_stack": sql["stack"], "rule_044_page_title": sql["PL044"], "rule_057_separators": sql["PL057"]}
    return out | O.others(sql) | fixtures.oracles()
