"""What the operators of this subpackage share: the shared folder, written tables and safe column names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefix of every column that an operator adds for its own use; `free_name` keeps it clear of the input's columns.
OWN = "_pl_"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir`, or the context's checkpoint folder.

    Where neither is set, a local session (as in tests) gets a temporary folder; a cluster's has no folder that all of its
    machines could be known to share, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="proselens-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """`df` as a table in the shared folder: cuts lineage and fixes what non-repeatable steps decided."""
    return written_at(df, what)[0]


def written_at(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """As `written`, with the table's path, for `removed`."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


#: Bytes of a batch of rows that is sent to a Python worker where `small_batches` holds; the last row may exceed it.
SENT_BYTES = 4 << 20
_SENT = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is written inside sends batches of about SENT_BYTES to Python, or of the session's limit where that is less.
    By Spark's defaults a batch has up to 10,000 rows or 64 MB, and a task and its worker hold all of it."""
    before = spark.conf.get(_SENT)
    limit = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)
    spark.conf.set(_SENT, f"{min(limit, SENT_BYTES)}b")
    try:
        yield
    finally:
        spark.conf.set(_SENT, before)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that no later plan reads."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Bits of a sieve: 4 MB, whatever the number of ids.
SIEVE_BITS = 1 << 25


def sieve(ids: DataFrame, col: str) -> Callable[[Column], Column]:
    """A test that is true of every value of `ids[col]` and of few others, so that rows which a semi or anti join can't meet
    needn't move. Its bitmap has a fixed size: with very many ids it lets all pass, and the join then does the work."""
    spark = ids.sparkSession
    bit = F.pmod(F.xxhash64(F.col(col)), F.lit(SIEVE_BITS))
    words = ids.groupBy(F.shiftright(bit, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{col}`), {SIEVE_BITS}) & 63 AS int))")).alias("b"))
    bits = np.zeros(SIEVE_BITS // 64, dtype=np.int64)
    for r in words.toLocalIterator():
        bits[r.w] = r.b
    known = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def passes(hashes):
        import pandas as pd

        at = hashes.to_numpy()
        return pd.Series((known.value[at >> 6] >> (at & 63)) & 1 == 1)

    return lambda x: passes(F.pmod(F.xxhash64(x), F.lit(SIEVE_BITS)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have in any case spelling."""
    have = {c.lower() for c in df.columns}
    name = OWN + name
    while name.lower() in have:
        name += "_"
    return name


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text): other columns, whatever their names, can't clash with an operator's own."""
    return df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col], F.lit("")).alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
