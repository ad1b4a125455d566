"""Quality classifier: a weak-label model over overlapping heuristics, whose posteriors train a hashed linear scorer.

1. Nine heuristics vote on every text: good, bad or no opinion. The votes of one text are a pattern, of which there are
   3^9 at most; the patterns' counts over all texts are what expectation-maximisation reads. It estimates the share of
   good texts and, for every heuristic and class, how often it votes which way.
2. The posterior of each pattern labels texts. A bounded sample of distinct texts of either label (`SAMPLE` each, those of
   least hash) trains a logistic scorer over hashed byte trigrams and votes.
3. Every text is scored; those whose probability of being good is under `REJECT_UNDER` are rejected.

Results for odd input: a null text is an empty one; a text without words is scored and never rejected, the scorer decides
on all others however short; equal texts have equal scores; rows are otherwise handled one by one; an empty table gives
none and fits a model that keeps everything, as one label alone does; columns other than the two named are ignored by
`scored`, and kept as they are by `kept`.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proselens.llm import shared, tokens

#: Distinct texts of either label that the scorer is trained on, at most.
SAMPLE = 1500
#: Buckets of the hashed features.
BUCKETS = 4096
REJECT_UNDER = 0.5
#: Bytes from which a text of under five words is long enough for the heuristics that look at letters.
LONG_WORDS = 120
#: Prior share of good texts on which a heuristic votes bad, and its weight in texts of the corpus.
PRIOR_FALSE, PRIOR_TEXTS = 0.002, 5
#: Share of good texts among as many imagined ones: it decides where the corpus is a few texts, and is nothing beyond.
PRIOR_GOOD, PRIOR_COUNT = 0.8, 10
GOOD, BAD, NONE = 2, 1, 0
_SENTENCE = re.compile(r"[.?](?:\s|$)")
_MARKS = [ord(c) for c in "#$%&*+/<=>@\\^_`{|}~"]


def _between(value: float, bad_low: float, good_low: float, good_high: float, bad_high: float) -> int:
    return BAD if value < bad_low or value > bad_high else GOOD if good_low <= value <= good_high else NONE


def votes(text: str) -> list[int]:
    """The heuristics' votes on `text`."""
    words = text.split()
    n = len(words)
    if not n:
        return [NONE] * 9
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    total = int(counts.sum())
    often = Counter(words)
    top = often.most_common(1)[0][1] / n
    same = sum(map(str.__eq__, words, words[1:])) / max(1, n - 1)
    lines = [x for x in text.split("\n") if x.strip()]
    again = 1 - len(set(lines)) / len(lines)
    sentences = len(_SENTENCE.findall(text)) / n
    # few words tell by their letters only where there are many of these
    enough = n >= 5 or total >= LONG_WORDS
    return [
        _between(counts[_MARKS].sum() / total, 0, 0, 0.01, 0.04) if enough else NONE,
        _between(upper / max(1, upper + lower), 0, 0, 0.15, 0.5) if enough else NONE,
        _between(top, 0, 0, 0.15, 0.3) if n >= 20 else NONE,
        _between(same, 0, 0, 0.05, 0.2) if n >= 20 else NONE,
        _between(counts[124] / n, 0, 0, 0.03, 0.1) if n >= 5 else NONE,
        _between(sentences, 0.005, 0.02, 0.3, 0.6) if n >= 40 else NONE,
        _between(counts[33] / n, 0, 0, 0.1, 0.4) if n >= 5 else NONE,
        _between(sum(map(len, words)) / n, 2, 3, 9, 14) if enough else NONE,
        _between(again, 0, 0, 0.3, 0.6) if len(lines) >= 4 else NONE,
    ]


def pattern(which: list[int]) -> int:
    return sum(v * 3**k for k, v in enumerate(which))


def unpacked(code: int, n: int = 9) -> list[int]:
    return [code // 3**k % 3 for k in range(n)]


@dataclass
class LabelModel:
    """Share of good texts, and for each heuristic that votes the chances of a bad and of a good vote given either class
    (bad, good). No opinion says nothing of the class: what makes a heuristic hold back is a text's length."""

    good: float = 0.5
    chances: np.ndarray = field(default_factory=lambda: np.full((9, 2, 2), 1 / 2))

    def posterior(self, which: list[int]) -> float:
        """Chance that a text with these votes is good."""
        odds = math.log(max(self.good, 1e-9)) - math.log(max(1 - self.good, 1e-9))
        for k, v in enumerate(which):
            if v != NONE:
                odds += math.log(self.chances[k, 1, v - 1]) - math.log(self.chances[k, 0, v - 1])
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))

    def accuracies(self) -> list[float]:
        """How often each heuristic is right where it votes."""
        w = np.array([1 - self.good, self.good])
        return (w[0] * self.chances[:, 0, BAD - 1] + w[1] * self.chances[:, 1, GOOD - 1]).tolist()


def expectation_maximisation(counted: dict[int, int], rounds: int = 100) -> LabelModel:
    """Fit to the counts of vote patterns. A text begins as bad where any heuristic says so."""
    model = LabelModel()
    if not counted:
        return model
    codes = sorted(counted)
    n = np.array([counted[c] for c in codes], dtype=float)
    v = np.array([unpacked(c) for c in codes])
    good = np.where((v == BAD).any(axis=1), 0.1, 0.9)
    for _ in range(rounds):
        share = float(((n * good).sum() + PRIOR_GOOD * PRIOR_COUNT) / (n.sum() + PRIOR_COUNT))
        chances = np.empty((v.shape[1], 2, 2))
        for vote in (BAD, GOOD):
            hit = (v == vote).astype(float)
            # one imagined text a cell keeps every chance above nothing
            chances[:, 1, vote - 1] = (hit * (n * good)[:, None]).sum(axis=0) + 1
            chances[:, 0, vote - 1] = (hit * (n * (1 - good))[:, None]).sum(axis=0) + 1
        # the heuristics are made to be precise: that prior holds for bad votes on good texts
        chances[:, 1, BAD - 1] += PRIOR_TEXTS * n.sum() * PRIOR_FALSE
        chances[:, 1, GOOD - 1] += PRIOR_TEXTS * n.sum() * (1 - PRIOR_FALSE)
        chances /= chances.sum(axis=2, keepdims=True)
        model = LabelModel(share, chances)
        now = np.array([model.posterior(list(row)) for row in v])
        if np.abs(now - good).max() < 1e-6:
            break
        good = now
    return model


def features(text: str, which: list[int]) -> np.ndarray:
    """Hashed byte trigrams (square roots of counts, of unit length) and hashed votes."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    out = np.zeros(BUCKETS, dtype=np.float32)
    if len(data) >= 3:
        h = (data[:-2] * np.uint32(2654435761)) ^ (data[1:-1] * np.uint32(2246822519)) ^ (data[2:] * np.uint32(3266489917))
        out += np.sqrt(np.bincount(h >> np.uint32(20), minlength=BUCKETS)).astype(np.float32)
        out /= np.linalg.norm(out)
    for k, v in enumerate(which):
        out[(k * 3 + v) * 2654435761 % BUCKETS] += 0.5
    return out


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def probability(self, x: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, float(x @ self.weights) + self.bias))))


def train(x: np.ndarray, y: np.ndarray, rounds: int = 150, penalty: float = 1e-4) -> Scorer:
    """Logistic regression on soft labels, both classes weighted alike, by accelerated gradient steps."""
    if not len(x) or y.min() > 0.5 or y.max() <= 0.5:
        return Scorer(np.zeros(BUCKETS, dtype=np.float32), 5.0)
    bad = y <= 0.5
    weight = np.where(bad, 0.5 / bad.sum(), 0.5 / (~bad).sum())
    x, y, weight = x.astype(np.float32), y.astype(np.float32), weight.astype(np.float32)
    w, b = np.zeros(x.shape[1], dtype=np.float32), np.float32(0)
    ahead_w, ahead_b, step = w, b, np.float32(4.0 / (1 + float((x * x).sum(axis=1).max())))
    for t in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead_w + ahead_b, -50, 50)))
        g = weight * (p - y)
        new_w, new_b = ahead_w - step * (g @ x + penalty * ahead_w), ahead_b - step * g.sum()
        m = np.float32(t / (t + 3))
        ahead_w, ahead_b = new_w + m * (new_w - w), new_b + m * (new_b - b)
        w, b = new_w, new_b
    return Scorer(w.astype(np.float32), float(b))


def fitted(docs: DataFrame, sample: int = SAMPLE) -> tuple[LabelModel, Scorer]:
    """The label model from all texts' votes, and the scorer from at most `sample` distinct texts of either label."""
    spark = docs.sparkSession

    def voted(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pattern(votes(t)) for t in texts], pa.int32())], names=["hash", "pattern"])

    hashed = shared.id_text(docs).select(F.xxhash64("text").alias("hash"), "text")
    table = shared.written(hashed.mapInArrow(voted, "hash long, pattern int"), "votes")
    model = expectation_maximisation({r.pattern: r["count"] for r in table.groupBy("pattern").count().collect()})
    patterns = [r.pattern for r in table.select("pattern").distinct().collect()]
    good = {p: model.posterior(unpacked(p)) for p in patterns}
    chosen: dict[int, float] = {}
    for which in (True, False):
        own = [p for p in patterns if (good[p] > 0.5) == which]
        if own:
            for r in table.where(F.col("pattern").isin(own)).select("hash", "pattern").distinct().orderBy("hash").limit(sample).collect():
                chosen[r["hash"]] = good[r.pattern]
    if not chosen:
        return model, train(np.zeros((0, BUCKETS)), np.zeros(0))
    wanted = spark.createDataFrame([(h,) for h in chosen], "hash long")

    def made(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t, votes(t)).tobytes() for t in texts], pa.binary())], names=["hash", "x"])

    # at most 2 * sample rows of 8 bytes are sent; copies of a text become one before its features are made
    found = hashed.join(F.broadcast(wanted), "hash").groupBy("hash").agg(F.min("text").alias("text")).mapInArrow(made, "hash long, x binary").collect()
    found.sort(key=lambda r: r["hash"])
    x = np.stack([np.frombuffer(bytes(r.x), np.float32) for r in found])
    return model, train(x, np.array([chosen[r["hash"]] for r in found]))


def _judge(model: LabelModel, scorer: Scorer):
    known: dict[int, float] = {}

    def one(text: str) -> tuple[int, float, float]:
        which = votes(text)
        code = pattern(which)
        if code not in known:
            known[code] = model.posterior(which)
        return code, known[code], scorer.probability(features(text, which))

    return one


def scored(docs: DataFrame, models: tuple[LabelModel, Scorer] | None = None, reject_under: float = REJECT_UNDER) -> DataFrame:
    """doc_id, pattern of votes, posterior, score (the scorer's probability of good) and kept."""
    known = docs.sparkSession.sparkContext.broadcast(models or fitted(docs))

    def rows(batches):
        import pyarrow as pa

        judge = _judge(*known.value)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in tokens.in_bytes(texts, 1 << 22):
                got = [judge(t) for t in texts[a:b]]
                code, posterior, score = zip(*got)
                keep = [s >= reject_under or not t.strip() for t, s in zip(texts[a:b], score)]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(code, pa.int32()), pa.array(posterior, pa.float64()), pa.array(score, pa.float64()), pa.array(keep)], names=["doc_id", "pattern", "posterior", "score", "kept"])

    return shared.id_text(docs).mapInArrow(rows, "doc_id long, pattern int, posterior double, score double, kept boolean")


def kept(docs: DataFrame, reject_under: float = REJECT_UNDER) -> DataFrame:
    """The rows of `docs` (with a column `text`) that aren't rejected, as they are."""
    known = docs.sparkSession.sparkContext.broadcast(fitted(docs))
    cache: list = []

    @F.pandas_udf("boolean")
    def good(texts):
        if not cache:
            cache.append(_judge(*known.value))
        return texts.map(lambda t: not t or not t.strip() or cache[0](t)[2] >= reject_under).astype(bool)

    return docs.where(good(docs["text"]))


def names() -> list[str]:
    return ["marks", "capitals", "top word", "repeats", "bars", "sentences", "exclamations", "word length", "lines"]


def listed_votes(code: Column) -> Column:
    """A pattern as nine letters: g, b or -."""
    return F.concat(*[F.substring(F.lit("-bg"), (F.floor(code / 3**k) % 3 + 1).cast("int"), F.lit(1)) for k in range(9)])
