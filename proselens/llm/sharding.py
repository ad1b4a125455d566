"""Uniform shuffling into shards of exact sizes, by a hypergeometric communication matrix.

Law `rows`: shard sizes differ by a row at most. Every assignment of rows to (shard, slot) is as likely as any other:

1. The rows are written with their task's number and their place in it, which fixes both for whatever follows.
2. A target is a part of a shard, as large as an input task or so; its size is exact. The matrix of rows that each task
   sends to each target has the multivariate hypergeometric law. It isn't held anywhere: halving the range of tasks
   again and again, with a generator seeded by the half's place, a task draws its own row of it from the tasks' counts
   alone, and every task that walks through the same half draws the same numbers.
3. A task sends its rows by a permutation of its own; after the exchange each target permutes what it got.

Results for odd input: null texts and ids move like any others; repeated rows are separate rows; an empty table gives
none; further columns are kept, whatever their names: the two added ones replace columns of those names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proselens.llm import shared


def _generator(*key: int) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(np.random.SeedSequence(list(key))))


#: numpy's own samplers take populations below this; larger ones are drawn by `_by_inversion`, from the same law.
NUMPY_MOST = 1_000_000_000


def drawn(generator: np.random.Generator, room: np.ndarray, take: int) -> np.ndarray:
    """How many of `take` rows, drawn without replacement from columns that hold `room`, come from each column."""
    left = int(room.sum())
    if left < NUMPY_MOST:
        return generator.multivariate_hypergeometric(room, take, method="marginals") if len(room) else room
    out = np.zeros(len(room), dtype=np.int64)
    for k, have in enumerate(room.tolist()):
        if not take:
            break
        if left < NUMPY_MOST:
            out[k:] = generator.multivariate_hypergeometric(room[k:], take, method="marginals")
            break
        left -= have
        out[k] = _by_inversion(generator, have, left, take)
        take -= int(out[k])
    return out


def _stirling_error(n: float) -> float:
    """log(n!) less Stirling's formula."""
    if n < 16:
        return math.lgamma(n + 1) - ((n + 0.5) * math.log(n) - n + 0.5 * math.log(2 * math.pi)) if n else 0.0
    s = n * n
    return (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / (1188 * s)) / s) / s) / s) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x, without the loss of figures that this form has near the mean."""
    if abs(x - mean) < 0.1 * (x + mean):
        v = (x - mean) / (x + mean)
        total, term, k = (x - mean) * v, 2 * x * v, 1
        while True:
            term *= v * v
            more = total + term / (2 * k + 1)
            if more == total:
                return total
            total, k = more, k + 1
    return x * math.log(x / mean) + mean - x


def _binomial(x: int, n: int, p: float) -> float:
    """Chance of x out of n, to nearly all figures of a double (a saddle-point expansion)."""
    if not 0 < x < n:
        return math.exp(n * math.log1p(-p)) if x == 0 else math.exp(n * math.log(p))
    log = _stirling_error(n) - _stirling_error(x) - _stirling_error(n - x) - _deviance(x, n * p) - _deviance(n - x, n * (1 - p))
    return math.exp(log) * math.sqrt(n / (2 * math.pi * x * (n - x)))


def _by_inversion(generator: np.random.Generator, good: int, bad: int, take: int, step: int = 4096) -> int:
    """A hypergeometric draw by inversion, going out from the mode on both sides, `step` counts at a time."""
    low, high = max(0, take - bad), min(good, take)
    if low == high:
        return low
    mode = min(max((take + 1) * (good + 1) // (good + bad + 2), low), high)
    p = take / (good + bad)
    peak = _binomial(mode, good, p) * _binomial(take - mode, bad, p) / _binomial(take, good + bad, p)
    left, up, down, p_up, p_down = generator.random(), mode, mode - 1, peak, peak
    while up <= high or down >= low:
        if up <= high:
            k = np.arange(up, min(up + step, high + 1), dtype=np.float64)
            ratio = (good - k) * (take - k) / ((k + 1) * (bad - take + k + 1))  # of k + 1 to k
            chance = p_up * np.concatenate([[1.0], np.cumprod(ratio[:-1])])
            sums = np.cumsum(chance)
            if left < sums[-1]:
                return up + int(np.searchsorted(sums, left, side="right"))
            left, p_up, up = left - float(sums[-1]), float(chance[-1] * ratio[-1]), up + len(k)
        if down >= low:
            k = np.arange(down, max(down - step, low - 1), -1, dtype=np.float64)
            ratio = (k + 1) * (bad - take + k + 1) / ((good - k) * (take - k))  # of k to k + 1
            chance = p_down * np.cumprod(ratio)
            sums = np.cumsum(chance)
            if left < sums[-1]:
                return down - int(np.searchsorted(sums, left, side="right"))
            left, p_down, down = left - float(sums[-1]), float(chance[-1]), down - len(k)
        if p_up < 1e-300 and p_down < 1e-300:
            break
    return mode  # what rounding left over


def matrix_row(counts: np.ndarray, targets: np.ndarray, task: int, seed: int) -> np.ndarray:
    """Row `task` of the communication matrix with row sums `counts` and column sums `targets`."""
    before = np.concatenate([[0], np.cumsum(counts)])
    low, high, room = 0, len(counts), targets
    while high - low > 1:
        middle = (low + high) // 2
        left = drawn(_generator(seed, low, high), room, int(before[middle] - before[low]))
        if task < middle:
            high, room = middle, left
        else:
            low, room = middle, room - left
    return room


def even(total: int, parts: int) -> np.ndarray:
    """`parts` sizes, at most one apart, that sum to `total`."""
    return total // parts + (np.arange(parts) < total % parts).astype(np.int64)


def sharded(docs: DataFrame, shards: int = 8, seed: int = 20) -> DataFrame:
    """`docs` with shard (int) and slot (long, gapless from 0 in each shard) added."""
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    mid, task, place, target, rank = (shared.free_name(docs, x) for x in ("mid", "task", "place", "target", "rank"))
    fixed = shared.written(docs.withColumn(mid, F.monotonically_increasing_id()), "rows")
    fixed = fixed.withColumn(task, F.shiftright(mid, 33)).withColumn(place, F.col(mid).bitwiseAND(F.lit((1 << 33) - 1)))
    found = fixed.groupBy(task).agg(F.count(F.lit(1)).alias("n")).collect()  # a number a task
    counts = np.zeros(max((r[0] for r in found), default=-1) + 1, dtype=np.int64)
    for r in found:
        counts[r[0]] = r[1]
    parts = max(1, -(-len(found) // shards))
    sizes = np.concatenate([even(int(n), parts) for n in even(int(counts.sum()), shards)])
    known = spark.sparkContext.broadcast((counts, sizes, seed))
    drawn_for: dict = {}

    @F.pandas_udf("int")
    def send(tasks, places):
        import pandas as pd

        counts, sizes, seed = known.value
        out = np.zeros(len(tasks), dtype=np.int32)
        t, p = tasks.to_numpy(), places.to_numpy()
        for x in np.unique(t).tolist():
            if x not in drawn_for:
                drawn_for.clear()
                row = matrix_row(counts, sizes, x, seed)
                drawn_for[x] = _generator(seed, x, 0, 0, 1).permutation(np.repeat(np.arange(len(sizes), dtype=np.int32), row))
            at = np.flatnonzero(t == x)
            out[at] = drawn_for[x][p[at]]
        return pd.Series(out)

    sent = fixed.withColumn(target, send(task, place))
    # target k is partition k: no two targets share a task
    sent = sent.repartitionById(max(1, len(sizes)), F.col(target))
    order = Window.partitionBy(target).orderBy(F.xxhash64(F.lit(seed), task, place), F.col(mid))
    ranked = sent.withColumn(rank, F.row_number().over(order).cast("long") - 1)
    # sizes within a shard differ by one at most, the first ones being the larger
    part, of_shard = F.col(target) % parts, F.floor(F.col(target) / parts).cast("int")
    n = F.element_at(F.array(*[F.lit(int(x)) for x in even(int(counts.sum()), shards)]), of_shard + 1)
    first = part * F.floor(n / parts) + F.least(part, n % parts)
    return ranked.withColumn("slot", (first + F.col(rank)).cast("long")).withColumn("shard", of_shard).drop(mid, task, place, target, rank)
