"""Scans: folders and file lists to documents(path, lang, text) and files(path, content)."""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proselens.operators.pipeline import glob_regex

LANGS = {"ts": "ts", "mts": "ts", "cts": "ts", "tsx": "tsx", "jsx": "tsx", "py": "python", "pyi": "python", "go": "go", "rs": "rust", "md": "md", "markdown": "md", "mdx": "mdx", "txt": "txt", "rst": "rst", "html": "html", "htm": "html", "css": "css", "scss": "css", "png": "image", "jpg": "image", "jpeg": "image", "webp": "image"}
#: Larger files are passed over.
MOST_BYTES = 64 << 20


def lang_of(path: Column) -> Column:
    """The language by extension, in its case; null for others and for minified style sheets."""
    known = F.create_map(*[F.lit(x) for kv in LANGS.items() for x in kv])
    return F.when(~path.endswith(".min.css"), known[F.regexp_extract(path, r"\.([^./]+)$", 1)])


def scan(spark: SparkSession, roots: list[str], exclude: list[str] = ()) -> DataFrame:
    """path, lang, content, length of every file under the roots, hidden ones too, but for excluded globs."""
    if not roots:
        return spark.createDataFrame([], "path string, lang string, content binary, length long")
    for r in roots:
        if "://" not in r and not Path(r).exists():
            raise FileNotFoundError(r)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(sorted({str(Path(r).resolve()) if "://" not in r else r for r in roots}))
    rows = rows.where(F.col("length") <= MOST_BYTES).withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    for glob in exclude:
        rows = rows.where(~F.col("path").rlike(glob_regex("**/" + glob)))
    return rows.select("path", lang_of(F.col("path")).alias("lang"), "content", "length")


def documents(files: DataFrame) -> DataFrame:
    """Text files that are valid UTF-8."""
    return files.where((F.col("lang") != "image") & F.is_valid_utf8(F.col("content").cast("string"))).select("path", "lang", F.col("content").cast("string").alias("text"))


def images(files: DataFrame) -> DataFrame:
    return files.where("lang = 'image'").select("path", "content")


def skipped(files: DataFrame) -> DataFrame:
    """Files that no front end takes, and why."""
    why = F.when(F.col("lang").isNull(), "unknown kind").when((F.col("lang") != "image") & ~F.is_valid_utf8(F.col("content").cast("string")), "not UTF-8")
    return files.select("path", why.alias("why")).where("why is not null")


def git_paths(repo: str, scope: str, ref: str | None = None) -> list[str]:
    """Paths that git names: `staged`, `changed`, or `since` a reference's merge base. Runs on the driver."""
    args = {"staged": ["--cached"], "changed": ["HEAD"], "since": [f"{ref}...HEAD"]}[scope]
    said = subprocess.run(["git", "-C", repo, "diff", "--name-only", "--diff-filter=ACMR", "-z", *args], capture_output=True, check=True).stdout
    return [x for x in said.decode().split("\0") if x]


#: Bytes of a row group, as writers make them by default: a scan can't be read by more tasks than it has row groups.
ROW_GROUP = 128 << 20


def spread(table: DataFrame, key: str) -> DataFrame:
    """`table` (a scan) over all cores: where its files hold fewer row groups than there are cores, rows are dealt out by
    `key`; a scan with enough of them stays as it is."""
    spark = table.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if max(len(table.inputFiles()), size // ROW_GROUP) >= cores:
        return table
    # filters are pushed below an exchange, back into the few tasks of the scan, but not below a generator
    return table.repartition(cores, key).select(F.inline(F.array(F.struct(*table.columns))))
