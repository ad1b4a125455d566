"""Corpus analytics: how findings are spread over labelled texts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least files of the AI class, hit rate and lifts of a verdict; files of a generator's row; files of a phrase.
LEAST_FILES, LEAST_RATE, STRONG, WEAK, INVERSE, GENERATOR_FILES, SUPPORT = 15, 0.01, 3.0, 1.5, 0.67, 20, 15


def hits(files: DataFrame, findings: DataFrame) -> DataFrame:
    """A row for each code and file with a finding: the file's dataset, label and number of findings. Findings are
    counted by file before they are joined."""
    return findings.groupBy("code", "path").agg(F.count(F.lit(1)).alias("n")).join(files, "path")


def cells(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Per code, dataset and label: files, files with a hit, findings, share of files, findings a thousand words."""
    totals = files.groupBy("dataset", "label").agg(F.count(F.lit(1)).alias("files"), F.sum("words").alias("words"))
    found = hits(files, findings).groupBy("code", "dataset", "label").agg(F.count(F.lit(1)).alias("hit_files"), F.sum("n").alias("findings"))
    return found.join(totals, ["dataset", "label"]).select("code", "dataset", "label", "files", "hit_files", "findings", F.round(F.col("hit_files") / F.col("files"), 6).alias("hit_rate"), F.round(F.try_divide(1000 * F.col("findings"), F.col("words")), 6).alias("per_1k_words"))


def scoreboard(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Cells and their sums by label and over all, in one pass by grouping sets."""
    found = hits(files, findings).groupBy("code", "dataset", "label").agg(F.count(F.lit(1)).alias("hit_files"), F.sum("n").alias("findings"))
    return found.groupingSets([[F.col("code"), F.col("dataset"), F.col("label")], [F.col("code"), F.col("label")], [F.col("code")]], "code", "dataset", "label").agg(F.sum("hit_files").alias("hit_files"), F.sum("findings").alias("findings"))


def _rate(n: Column, of: Column) -> Column:
    return F.try_divide(n, of)


def pooled(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Per code: hit rates of human and AI files, precision with both classes alike, lift and verdict."""
    n_human, n_ai = files.agg(F.count_if(F.col("label") == "human"), F.count_if(F.col("label") == "ai")).first()
    rows = hits(files, findings).groupBy("code").pivot("label", ["human", "ai"]).agg(F.count(F.lit(1))).na.fill(0).withColumn("human_files", F.lit(n_human)).withColumn("ai_files", F.lit(n_ai))
    h, a = _rate(F.col("human"), F.col("human_files")), _rate(F.col("ai"), F.col("ai_files"))
    lift = F.try_divide(a, h)
    verdict = F.when(F.col("ai_files") < LEAST_FILES, "nodata").when(F.coalesce(h, F.lit(0.0)) == 0, F.when(a >= LEAST_RATE, "sep").otherwise("chance")).when((lift >= STRONG) & (a >= LEAST_RATE), "sep").when(lift >= WEAK, "weak").when(lift < INVERSE, "inv").otherwise("chance")
    shown = F.when(h > 0, F.format_string("%.2f", F.round(F.try_divide(a, h), 2))).when(a > 0, F.lit("inf")).otherwise(F.lit("n/a"))
    return rows.select("code", F.round(h, 6).alias("human_rate"), F.round(a, 6).alias("ai_rate"), F.round(F.try_divide(a, h + a), 6).alias("precision"), shown.alias("lift"), verdict.alias("verdict"))


def matrix(files: DataFrame, findings: DataFrame, labels=("human", "ai", "none")) -> DataFrame:
    """Codes by label: files with a hit."""
    return hits(files, findings).groupBy("code").pivot("label", list(labels)).agg(F.count(F.lit(1))).na.fill(0)


def generators(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Datasets with enough files, and the share of their files that have any finding."""
    any_hit = findings.select("path").distinct().withColumn("hit", F.lit(1))
    return files.join(any_hit, "path", "left").groupBy("dataset").agg(F.count(F.lit(1)).alias("files"), F.count("hit").alias("hit_files")).where(F.col("files") >= GENERATOR_FILES).withColumn("share", F.round(F.col("hit_files") / F.col("files"), 6))


def paired(files: DataFrame) -> DataFrame:
    """Datasets that have files of both classes."""
    return files.groupBy("dataset").agg(F.count_if(F.col("label") == "human").alias("human"), F.count_if(F.col("label") == "ai").alias("ai")).where("human > 0 and ai > 0")


def message_shapes(findings: DataFrame) -> DataFrame:
    """Messages with identifiers in backticks as X and numbers as N, counted."""
    shape = F.regexp_replace(F.regexp_replace("message", "`[^`]*`", "`X`"), "[0-9]+", "N")
    return findings.groupBy("code", shape.alias("shape")).agg(F.count(F.lit(1)).alias("n"))


def spread_sample(rows: DataFrame, by: str, limit: int) -> DataFrame:
    """`limit` rows evenly spread over the order of `by`: those at i * n / limit. Ranks are the sum of a range's offset and
    the place in it, so that no task orders all rows."""
    spark = rows.sparkSession
    n = rows.count()
    if n <= limit:
        return rows
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(rows.agg(F.percentile_approx(by, [k / parts for k in range(1, parts)] or [0.5], 10_000)).first()[0]))
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(by)))
    ranged = rows.withColumn("_part", part)
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = counts.select("_part", before.alias("_before"))  # a row a part
    ranked = ranged.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(by)) - 1).join(F.broadcast(offset), "_part").withColumn("_rank", F.col("_in") + F.col("_before"))
    # rank r is taken where it is floor(i * n / limit) for i = ceil(r * limit / n)
    i = F.ceil(F.col("_rank") * limit / n)
    return ranked.where((F.floor(i * n / limit) == F.col("_rank")) & (i < limit)).select(*rows.columns)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}']+", -1), lambda x: x != "")


def grams(w: Column, n: int) -> Column:
    """The different runs of `n` of the words `w`, joined by spaces."""
    if n == 1:
        return F.array_distinct(w)
    shifted = [F.slice(w, k + 1, 1 << 30).alias(f"w{k}") for k in range(n)]
    zipped = F.slice(F.arrays_zip(*shifted), F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(0)))
    return F.array_distinct(F.transform(zipped, lambda z: F.concat_ws(" ", *[z[f"w{k}"] for k in range(n)])))


#: Bits of a sieve: 4 MB, whatever the number of phrases.
SIEVE_BITS = 1 << 25


def _sieve(hashes: DataFrame) -> Callable[[Column], Column]:
    """A test that is true of every value of `hashes.h` and of few others. Its bitmap has a fixed size: with very many values
    it lets more pass, and the counting does the work."""
    bit = F.pmod("h", F.lit(SIEVE_BITS))
    words = hashes.groupBy(F.shiftright(bit, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(h, {SIEVE_BITS}) & 63 AS int))")).alias("b")).toArrow()
    bits = np.zeros(SIEVE_BITS // 64, dtype=np.int64)
    bits[words["w"].to_numpy()] = words["b"].to_numpy()
    known = hashes.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def passes(at):
        import pandas as pd

        at = at.to_numpy()
        return pd.Series((known.value[at >> 6] >> (at & 63)) & 1 == 1)

    return lambda h: passes(F.pmod(h, F.lit(SIEVE_BITS)))


def phrase_differential(files: DataFrame, most: int = 4, support: int = SUPPORT, top: int = 150) -> DataFrame:
    """Phrases of up to `most` words that are in `support` AI files or more, by smoothed ratio of class rates: the first
    `top`. The AI files' phrases are counted by hash first, which can't give a phrase less than its files; what may have the
    support is then counted in all files, so that no other phrase moves."""
    sizes = {r.label: r["count"] for r in files.groupBy("label").count().collect()}
    human, ai = sizes.get("human", 0), sizes.get("ai", 0)

    def phrases(*labels: str) -> DataFrame:
        words = files.where(F.col("label").isin(*labels)).select("label", words_of(F.col("text")).alias("w"))
        return words.select("label", F.explode(F.concat(*[grams(F.col("w"), n) for n in range(1, most + 1)])).alias("phrase"))

    hashed = phrases(*(["ai"] if support > 0 else ["human", "ai"])).groupBy(F.xxhash64("phrase").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    passes = _sieve(hashed.where(F.col("n") >= support).select("h"))
    rows = phrases("human", "ai").where(passes(F.xxhash64("phrase")))
    counted = rows.groupBy("phrase").agg(F.count_if(F.col("label") == "ai").alias("ai_files"), F.count_if(F.col("label") == "human").alias("human_files")).where(F.col("ai_files") >= support)
    ratio = ((F.col("ai_files") + 1) / (ai + 2)) / ((F.col("human_files") + 1) / (human + 2))
    return counted.withColumn("n", F.size(F.split("phrase", " "))).withColumn("ratio", F.round(ratio, 6)).orderBy(F.desc("ratio"), "phrase").limit(top)


_COMMENT = r"(?im)^\s*(?://+|#+|\*+|<!--)\s*"
_VIOLET = "(?:fuchsia|indigo|purple|violet)"
#: Candidate patterns: name, scope (line, file, first-line or last-block) and pattern. A comment is a line that begins as one.
CANDIDATES = [
    ("advisory hedge", "line", r"(?i)it is always (?:essential|important|recommended) to \w+"),
    ("literal line break", "line", r"\\n\\n"),
    ("middle dot", "line", r"\S · \S"),
    ("agent footer", "line", r"(?i)generated with \[?[a-z]+"),
    ("recap at the end", "last-block", r"(?i)^(?:in conclusion|overall|ultimately)"),
    ("label at the head", "first-line", r"(?i)^(?:title|t[íi]tulo|subject):"),
    ("long file, 300 lines", "file", "300"), ("long file, 500 lines", "file", "500"), ("long file, 1000 lines", "file", "1000"),
    ("stand-in comment", "line", _COMMENT + r"(?:this is (?:just )?a (?:placeholder|stub|mock)|in (?:a real|production)|simulat(?:e|ed|es|ing)\b|for (?:demo|demonstration)\b)"),
    ("example usage comment", "line", _COMMENT + r"(?:example|sample) usage\b"),
    ("residue in other words", "line", r"(?i)(?:let me know if (?:anything|there)|here is your (?:revised|updated)|segue (?:abaixo )?a vers[ãa]o (?:corrigida|revisada))"),
    ("necessity in Portuguese", "line", r"(?i)(?:[ée] (?:fundamental|essencial|necess[áa]rio|imprescind[íi]vel) que)"),
    ("fence tag at the head", "first-line", r"(?i)^\s*(?:python|javascript|typescript|tsx|go|rust|html|css)\s*$"),
    ("chat prose in code", "line", r"(?im)^\s*(?:sure|certainly|of course)[,!] (?:here|below)"),
    ("demo data comment", "line", _COMMENT + r"(?:generate|create|build|define) (?:some )?(?:dummy|fake|mock|sample) \w+"),
    ("simulation comment", "line", _COMMENT + r"simulat(?:e|es|ing) (?:a|an|the|some)\b"),
    ("category comment", "line", _COMMENT + r"(?:helper|utility|main) function\b"),
    ("constructor comment", "line", _COMMENT + r"\w+ (?:creates and )?initiali[sz]es a new \w+"),
    ("invitation to extend", "line", _COMMENT + r"(?:more|additional|other) \w+ can be added\b"),
    ("tutorial comment", "line", _COMMENT + r"(?:you can|feel free to|make sure (?:to|you)|don't forget to)\b"),
    ("represents the structure", "line", _COMMENT + r"\w+ represents (?:the structure of|an?|the)\b"),
    ("file name comment", "first-line", r"(?i)^\s*//\s*[\w./-]+\.(?:ts|tsx|js|jsx)\s*$"),
    ("function to comment", "line", _COMMENT + r"function to \w+"),
    ("import comment", "line", _COMMENT + r"import (?:the )?(?:necessary|required|needed)\b"),
    ("output comment", "line", r"(?im)//\s*(?:output|expected|prints|logs):\s*\S"),
    ("self-labelled deliverable", "first-line", r"(?i)^(?:relat[óo]rio|resumo|reda[çc][ãa]o|artigo|texto revisado)\s*:"),
    ("given source material", "line", r"(?i)(?:o texto|o documento|o material) (?:fornecido|apresentado|enviado)"),
    ("assurance clause", "line", r"(?i), (?:garantindo|assegurando) (?:que|assim)\b"),
    ("role hedge", "line", r"(?i)desempenh(?:a|am|ou|ar) um papel (?:fundamental|ativo|central|crucial|de destaque)"),
    ("invitation to reflect", "line", r"(?i)nos convid(?:a|am) a (?:refletir|repensar)"),
    ("unattributed perception", "line", r"(?i)pode(?:m)? ser vist[oa]s? como"),
    ("gradient text", "line", r"(?i)(?:background-clip:\s*text|bg-clip-text)"),
    ("violet gradient", "line", r"(?:from|via|to)-" + _VIOLET + r"-\d{2,3}"),
    ("violet hex", "line", r"(?i)#(?:8b5cf6|7c3aed|a855f7|6366f1|6d28d9)\b"),
    ("violet accent", "line", r"(?:bg|text|border|ring)-" + _VIOLET + r"-\d{2,3}"),
    ("violet theme", "line", r"--(?:primary|accent):\s*2(?:5[0-9]|6[0-9]|7[0-9])\b"),
    ("separator glyph", "line", r"[A-Za-z0-9)] (?:•|→|&middot;|&bull;) [A-Za-z0-9(]"),
]


def candidates(files: DataFrame) -> DataFrame:
    """Files of each label that a candidate hits. All candidates are columns of one pass over the texts."""
    text = F.col("text")
    last = F.element_at(F.filter(F.split(text, r"\n[ \t]*\n", -1), lambda b: b.rlike(r"\S")), -1)

    def hit(scope: str, pattern: str) -> Column:
        if scope == "file":
            return F.size(F.filter(F.split(text, "\n", -1), lambda s: s.rlike(r"\S"))) >= int(pattern)
        return {"line": text, "first-line": F.substring_index(text, "\n", 1), "last-block": F.ltrim(last)}[scope].rlike(pattern)

    counts = files.groupBy("label").agg(*[F.count_if(hit(s, p)).alias(f"c{k}") for k, (_, s, p) in enumerate(CANDIDATES)])
    pairs = ", ".join(f"'{n}', c{k}" for k, (n, _, _) in enumerate(CANDIDATES))
    return counts.select("label", F.expr(f"stack({len(CANDIDATES)}, {pairs}) AS (candidate, files)"))
