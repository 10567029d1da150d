"""Toxicity by class-conditional Kneser-Ney models.

Two models over the letters of words, one of toxic and one of ordinary labelled texts, share their
backoff: each class discounts its own counts of an expression (a letter after up to ORDER - 1
letters of its word) and gives the rest, with STRENGTH more, to one pooled Kneser-Ney model of both
classes. Rare expressions therefore weigh alike in both, and the ratio speaks only where counts do.
A word's log-likelihood ratio is the sum over its letters; ratios below MARGIN are noise of the
estimates and count nothing. A text's evidence is the sum of the rest by its number of words (and PADDING more), and a
logistic curve fitted on texts that the fitted models have not seen turns it into a probability.

The classifier is fitted on at most SAMPLE labelled rows, the first by a hash of the id; that bounds
the model, which is broadcast. Scoring reads every whole text in one pass without a shuffle.

Missing texts count as empty and get the score of no evidence. Labels that are missing, or whose
document is missing, are not used; of contradicting labels of one id the toxic one counts. Without
labels of both classes every score is the share of toxic ones. Rows are scored by themselves, so
repeated rows and ties need no rule. Added columns replace input columns of the same name.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.session import materialize

SAMPLE = 10_000
ORDER, DISCOUNT, STRENGTH, MARGIN = 6, 0.75, 5.0, 3.0
PADDING = 40  # words added to a text's length, so one odd word does not condemn a short text
REMEMBERED = 500_000  # words whose ratio a worker remembers at once
WORDS = re.compile(r"[^\W\d_]+")
START, END = "\x02", "\x03"
LONGEST = 64  # letters of a word that are scored at once; longer words are scored in pieces

_BASE = 0x9E3779B97F4A7C15
_POWERS = [pow(_BASE, k, 1 << 64) for k in range(ORDER + 1)]


def words_of(text: str | None) -> list[str]:
    found = WORDS.findall((text or "").lower())
    if any(len(w) > LONGEST for w in found):
        found = [w[i : i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]
    return found


def held_out(doc_id: Column | str) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


# --- training


def grams_of(word: str) -> Iterator[str]:
    """Each letter of a word, and its end, after up to ORDER - 1 letters."""
    marked = START + word + END
    for i in range(1, len(marked)):
        yield marked[max(0, i - ORDER + 1) : i + 1]


def labelled(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """(text, toxic, fold) of at most ``limit`` labelled documents that are not held out."""
    known = labels.dropna(subset=["doc_id", "toxic"]).filter(~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = F.xxhash64(F.lit("sample"), "doc_id")
    chosen = known.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(2)).cast("int")).orderBy(order, "doc_id").limit(limit)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``limit`` rows of three numbers
    one = texts.groupBy("doc_id").agg(F.min(F.struct("text", "toxic", "fold")).alias("row"))
    return one.select("row.*")


def gram_counts(texts: DataFrame) -> DataFrame:
    """(gram, c00, c01, c10, c11): counts by class and fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: tuple[Counter, ...] = (Counter(), Counter(), Counter(), Counter())
            for text, toxic, fold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words[2 * toxic + fold].update(words_of(text))
            counts: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
            for k, found in enumerate(words):
                for word, n in found.items():
                    for gram in grams_of(word):
                        counts[gram][k] += n
            columns = [pa.array(list(counts), pa.string())] + [pa.array([c[k] for c in counts.values()], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays(columns, names=["gram", "c00", "c01", "c10", "c11"])

    found = texts.mapInArrow(run, "gram string, c00 bigint, c01 bigint, c10 bigint, c11 bigint")
    return found.groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("c00", "c01", "c10", "c11")])


@dataclass
class Ratios:
    """Log ratio of each known expression, and of an unknown letter after each known beginning, by hash."""

    keys: np.ndarray
    values: np.ndarray
    other_keys: np.ndarray
    others: np.ndarray


class _Shared:
    """Pooled interpolated Kneser-Ney model: P(letter | letters before it)."""

    def __init__(self, pooled: dict[str, int]):
        self.memo: dict[str, float] = {}
        self.count: dict[str, int] = dict(pooled)  # longest expressions by count, their endings by distinct beginnings
        seen = list(pooled)
        while seen:
            shorter = Counter(g[1:] for g in seen if len(g) > 1)
            fresh = [g for g in shorter if g not in self.count]
            for g, n in shorter.items():
                if g not in pooled:
                    self.count[g] = self.count.get(g, 0) + n
            seen = fresh
        self.total: Counter = Counter()
        self.kinds: Counter = Counter()
        for g, n in self.count.items():
            self.total[g[:-1]] += n
            self.kinds[g[:-1]] += 1
        self.letters = self.kinds[""] + 1

    def chance(self, gram: str) -> float:
        p = self.memo.get(gram)
        if p is None:
            less = self.chance(gram[1:]) if len(gram) > 1 else 1 / self.letters
            total = self.total.get(gram[:-1], 0)
            p = less
            if total:
                p = (max(self.count.get(gram, 0) - DISCOUNT, 0) + DISCOUNT * self.kinds[gram[:-1]] * less) / total
            self.memo[gram] = p
        return p


def gram_hash(grams: list[str]) -> np.ndarray:
    """Hash of each expression, as ``word_ratios`` makes them from letters."""
    out = np.empty(len(grams), np.uint64)
    for i, g in enumerate(grams):
        h = 0
        for c in g:
            h = (h * _BASE + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        out[i] = h
    return out


def ratios(counts: dict[str, tuple[int, int]]) -> Ratios:
    """Ratios from (ordinary, toxic) counts of the longest expressions."""
    shared = _Shared({g: a + b for g, (a, b) in counts.items() if a + b})
    total, kinds = ([Counter(), Counter()] for _ in range(2))
    for g, pair in counts.items():
        for y in (0, 1):
            if pair[y]:
                total[y][g[:-1]] += pair[y]
                kinds[y][g[:-1]] += 1

    def logs(before: str, own: tuple[int, int], p: float) -> float:
        a, b = (
            (max(own[y] - DISCOUNT, 0) + (DISCOUNT * kinds[y][before] + STRENGTH) * p) / (total[y][before] + STRENGTH) for y in (0, 1)
        )
        return math.log(b / a)

    known = [g for g, pair in counts.items() if sum(pair)]
    starts = list({g[:-1] for g in known})
    values = np.array([logs(g[:-1], counts[g], shared.chance(g)) for g in known], np.float32)
    others = np.array([logs(b, (0, 0), 1.0) for b in starts], np.float32)
    keys, other_keys = gram_hash(known), gram_hash(starts)
    by, other_by = np.argsort(keys), np.argsort(other_keys)
    return Ratios(keys[by], values[by], other_keys[other_by], others[other_by])


# --- scoring


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def word_ratios(words: list[str], model: Ratios) -> np.ndarray:
    """Log-likelihood ratio of each word."""
    if not words:
        return np.empty(0)
    marked = START + (END + START).join(words) + END
    letters = np.frombuffer(marked.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    begins = np.flatnonzero(letters == ord(START) + 1)
    size = np.diff(np.append(begins, len(letters)))
    place = np.arange(len(letters)) - np.repeat(begins, size)
    before = np.zeros(len(letters), np.uint64)  # hash of up to ORDER - 1 letters before
    for back in range(1, ORDER):
        reach = np.flatnonzero(place >= back)
        before[reach] += letters[reach - back] * np.uint64(_POWERS[back - 1])
    gram = before * np.uint64(_BASE) + letters
    at, hit = _found(model.keys, gram)
    other_at, other_hit = _found(model.other_keys, before)
    value = np.zeros(len(letters))
    value[other_hit] = model.others[other_at[other_hit]]
    value[hit] = model.values[at[hit]]
    value[begins] = 0
    return np.add.reduceat(value, begins)


class Scorer:
    """Evidence of texts under one model; remembers words."""

    def __init__(self, model: Ratios):
        self.model, self.known = model, {}

    def evidence(self, texts: list[str | None]) -> list[float]:
        split = [words_of(t) for t in texts]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        fresh = list({w for words in split for w in words if w not in known})
        for at in range(0, len(fresh), 50_000):
            part = fresh[at : at + 50_000]
            value = word_ratios(part, self.model)
            known.update(zip(part, np.where(value > MARGIN, value, 0.0).tolist(), strict=True))
        return [math.fsum([known[w] for w in words]) / (len(words) + PADDING) for words in split]


def _feature(evidence: np.ndarray) -> np.ndarray:
    return np.log1p(1000 * evidence)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope (never negative) and intercept by damped Newton steps with a small ridge."""
    design = np.stack([x, np.ones_like(x)], axis=1)

    def loss(w: np.ndarray) -> float:
        z = design @ w
        return float((np.logaddexp(0, z) - y * z).sum() + ridge * (w @ w) / 2)

    weights = np.array([0.0, math.log((y.sum() + 1) / (len(y) - y.sum() + 1))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-(design @ weights)))
        gradient = design.T @ (p - y) + ridge * weights
        step = np.linalg.solve((design.T * (p * (1 - p))) @ design + ridge * np.eye(2), gradient)
        size = 1.0
        while size > 1e-6 and loss(weights - size * step) > loss(weights):
            size /= 2
        weights = weights - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return max(0.0, float(weights[0])), float(weights[1])


@dataclass
class Model:
    ratios: Ratios
    slope: float
    intercept: float


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Model:
    """Fit on a bounded sample: two half models score each other's half for the curve, the whole one is kept."""
    spark = docs.sparkSession
    texts = materialize(labelled(docs, labels, limit), "toxic-sample")
    table = gram_counts(texts).toPandas()  # bounded by the sample
    counts = {g: (a, b, c, d) for g, a, b, c, d in table.itertuples(index=False, name=None)}
    halves = [ratios({g: (c[1 - f], c[3 - f]) for g, c in counts.items()}) for f in (0, 1)]
    shared = spark.sparkContext.broadcast(halves)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(m) for m in shared.value]
        for batch in batches:
            text, toxic, fold = (c.to_pylist() for c in batch.columns)
            both = [s.evidence(text) for s in scorers]
            own = [both[f][i] for i, f in enumerate(fold)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.float64()), pa.array(toxic, pa.int32())], names=["x", "y"])

    seen = texts.mapInArrow(score, "x double, y int").toPandas().sort_values(["x", "y"])
    x, y = _feature(seen["x"].to_numpy()), seen["y"].to_numpy(float)
    if len(y) and 0 < y.sum() < len(y):
        slope, intercept = logistic(x, y)
    else:
        slope, intercept = 0.0, math.log((y.sum() + 1e-3) / (len(y) - y.sum() + 1e-3))
    return Model(ratios({g: (c[0] + c[1], c[2] + c[3]) for g, c in counts.items()}), slope, intercept)


_SCORERS: dict[int, tuple[Model, Scorer]] = {}


def score(docs: DataFrame, model: Model, threshold: float, text: str = "text") -> DataFrame:
    """The input with ``score`` (0 to 1) and ``predicted`` (1 from the threshold on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    added = {"score": T.DoubleType(), "predicted": T.IntegerType()}
    kept = [c for c in docs.columns if c not in added]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(k, v) for k, v in added.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = shared.value
        if id(value) not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[id(value)] = (value, Scorer(value.ratios))
        scorer = _SCORERS[id(value)][1]
        for batch in batches:
            evidence: list[float] = []
            for at in range(0, batch.num_rows, 256):
                evidence += scorer.evidence(batch.column(batch.num_columns - 1).slice(at, 256).to_pylist())
            chance = 1 / (1 + np.exp(-(value.slope * _feature(np.array(evidence, float)) + value.intercept)))
            made = [pa.array(chance, pa.float64()), pa.array((chance >= threshold).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*kept, *added])

    return docs.select(*[docs[c] for c in kept], F.col(text).alias("_text")).mapInArrow(run, schema)
