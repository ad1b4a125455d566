"""Packing token sequences: shortest-pack-first over the length histogram.

1. `cut` cuts every document into pieces of at most `capacity` ids: whole sequences first, then the remainder. The
   pieces, with their ids, go to the shared folder; each carries its task's number and its rank among that task's pieces
   of one length.
2. The histogram of lengths has at most `capacity` rows whatever the corpus; `plan` places it on the driver, longest
   length first, always into the pattern with the most room, splitting pattern counts where a length has fewer pieces
   than the pattern has sequences.
3. `pack` turns a piece's rank among all pieces of its length into its sequence and offset through the plan's ranges.

Results for odd input: a null text is an empty one (one piece that holds the end id alone, where one is asked for, else
no piece); repeated rows are packed as often as they occur; a null doc_id stays null; an empty table has no pieces;
columns other than the two named are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proselens.llm import shared, tokens

CAPACITY = 1024
CUT_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, task int, task_rank long"


@dataclass
class Run:
    """Pieces of `length` with ranks from `rank` on: `copies` of them in each of `count` sequences from `sequence` on."""

    length: int
    rank: int
    count: int
    copies: int
    sequence: int
    offset: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Run], int]:
    """Runs that place every piece of the histogram, and the number of sequences.

    A pattern is (room, count, [(length, copies)]). Each length splits at most one pattern, so there are at most two
    patterns a length; a pattern holds distinct lengths that sum to `capacity` at most. The plan is therefore bounded by
    the capacity alone.
    """
    by_room: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    for length in sorted((x for x, n in histogram.items() if n > 0), reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r, p in by_room.items() if p), default=0)
            if room < length:
                fit = capacity // length
                if left >= fit:
                    by_room.setdefault(capacity - fit * length, []).append((left // fit, [(length, fit)]))
                    left %= fit
                else:
                    by_room.setdefault(capacity - left * length, []).append((1, [(length, left)]))
                    left = 0
                continue
            count, held = by_room[room].pop()
            use = min(count, left)
            if use < count:
                by_room[room].append((count - use, held))
            last = held[-1]
            grown = [*held[:-1], (length, last[1] + 1)] if last[0] == length else [*held, (length, 1)]
            by_room.setdefault(room - length, []).append((use, grown))
            left -= use
    runs, sequence, placed = [], 0, dict.fromkeys(histogram, 0)
    for room in sorted(by_room):
        for count, held in by_room[room]:
            offset = 0
            for length, copies in held:
                runs.append(Run(length, placed[length], count, copies, sequence, offset))
                placed[length] += count * copies
                offset += length * copies
            sequence += count
    return runs, sequence


def cut(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int | None = 0) -> DataFrame:
    """Pieces of every document's ids, as a table of the shared folder."""

    def pieces(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, ranks, coder = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64), tokens.encoder(tokenizer)
        names = [x.split(" ")[0] for x in CUT_SCHEMA.split(", ")]
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in tokens.slices(texts):
                got, bounds = tokens.with_end(*coder.encode(texts.slice(a, b - a)), end_id)
                total = np.diff(bounds)
                n = -(-total // capacity)  # pieces of each document
                doc = np.repeat(np.arange(b - a), n)
                start = capacity * (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n))
                length = np.minimum(capacity, total[doc] - start)
                order = np.argsort(length, kind="stable")
                sizes, first, count = np.unique(length[order], return_index=True, return_counts=True)
                rank = np.empty(len(doc), dtype=np.int64)
                rank[order] = np.arange(len(doc)) + np.repeat(ranks[sizes] - first, count)
                ranks[sizes] += count
                cells = tokens.binaries(got.astype("<u4").view(np.uint8), 4 * np.concatenate([bounds[doc] + start, bounds[-1:]]))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a + doc)), pa.array(start), pa.array(length), cells, pa.array(total[doc]), pa.array(np.full(len(doc), task, dtype=np.int32)), pa.array(rank)], names=names)

    with shared.small_batches(docs.sparkSession):
        return shared.written(shared.id_text(docs).mapInArrow(pieces, CUT_SCHEMA), "pieces")


#: Rows of (task, length) that may be sent to every task, some 24 bytes each; beyond, they are joined by a shuffle.
OFFSET_ROWS = 200_000


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` of `cut` with sequence_id and offset. Sequences are numbered from 0; offsets are gapless in each."""
    spark: SparkSession = pieces.sparkSession
    by_task = shared.written(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = plan(histogram, capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = by_task.select("task", "length", F.coalesce(before, F.lit(0)).alias("before"))
    if by_task.count() <= OFFSET_ROWS:
        offsets = F.broadcast(offsets)
    by_length: dict[int, list[Run]] = {}
    for run in runs:
        by_length.setdefault(run.length, []).append(run)
    table = spark.sparkContext.broadcast({length: np.array([[r.rank, r.count, r.sequence, r.offset] for r in rs], dtype=np.int64) for length, rs in by_length.items()})

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        n, r = length.to_numpy(), rank.to_numpy()
        sequence, offset = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)
        for x in np.unique(n):
            at = np.flatnonzero(n == x)
            runs = table.value[int(x)]
            run = runs[np.searchsorted(runs[:, 0], r[at], side="right") - 1]
            inside = r[at] - run[:, 0]
            sequence[at] = run[:, 2] + inside % run[:, 1]
            offset[at] = run[:, 3] + inside // run[:, 1] * x
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    ranked = pieces.join(offsets, ["task", "length"]).withColumn("rank", F.col("before") + F.col("task_rank"))
    return ranked.withColumn("placed", place("length", "rank")).select("doc_id", "start", "length", "ids", "doc_tokens", F.col("placed.sequence_id").alias("sequence_id"), F.col("placed.offset").alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: ids in offset order (at most a capacity of them), doc ids and piece starts."""
    held = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "start", "ids")))
    return packed.groupBy("sequence_id").agg(held.alias("p")).select(
        "sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.start").alias("starts"), F.col("p.length").alias("lengths")
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int | None = 0) -> DataFrame:
    return pack(cut(docs, tokenizer, capacity, end_id), capacity)
