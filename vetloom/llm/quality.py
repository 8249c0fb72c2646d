"""A quality classifier: ordinal cumulative-link regression on graded ratings.

``P(grade <= j) = 1 / (1 + exp(s - t_j))`` with one score ``s`` for a text and
ordered thresholds ``t_0 < t_1 < ...``.  The score adds up weights that all
grades share, one for each hashed feature of the text:

* each distinct lower-cased word, and each distinct beginning of
  :data:`PREFIX` bytes of a word;
* each distinct ending of a word that has neither letters nor digits;
* shares of the words: with capitals only, that repeat the word before, and
  with each such ending.

The model is fitted on a bounded sample of the rated texts: of the
:data:`SAMPLE` ids with the smallest hashes as many, in that order, as have
:data:`FEATURES` features together.  Every text is scored over its whole length.

Contract: null text has no features.  All columns are kept; input columns named
like an output column are replaced.  Ratings are whole numbers from 0; rows
with a null id or grade are not learned from.  Of ratings that repeat an id the
largest counts, and of texts that do the one with the smallest hash.  Without
ratings all grades are 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays as A
from . import frames

PLACE_BITS = 18
PLACES = 1 << PLACE_BITS
PREFIX = 5
#: Rated texts that the model is fitted on, and features of them all, at most; texts that a feature needs among them.
SAMPLE, FEATURES, LEAST_TEXTS = 6000, 4_000_000, 4
STEP_BYTES = 2 << 20
#: Steps and pace of the fit, and its two penalties: on squares, and on absolute values, which keeps few weights.
ROUNDS, RATE, DECAY, SPARSE = 300, 0.05, 1e-5, 3e-4
#: What a share of all words counts.
_SHARE = 4.0
#: Texts whose tail probability is less are rejected.
KEEP = 0.5

_UPPER, _PLAIN = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
for _a, _b in (("A", "Z"), ("a", "z"), ("0", "9")):
    _PLAIN[ord(_a) : ord(_b) + 1] = True
_PLAIN[128:] = True
_SALTS = np.array([3, 5, 7, 11, 13, 17], np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place and value of each feature, ordered by text."""
    norm, starts, ends, first = A.normal_words(column)
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), n)
    if not len(starts):
        return text, text, np.zeros(0)
    lower = A.LOWER[norm]
    last_plain = np.maximum.accumulate(np.where(_PLAIN[norm], np.arange(len(norm)), -1))
    stop = np.maximum(np.minimum(last_plain[ends - 1] + 1, ends), starts)  # behind the last letter or digit
    words = A.span_hashes(lower, starts, stop)
    prefixes = A.span_hashes(lower, starts, np.minimum(stop, starts + PREFIX))
    tail = stop < ends
    tails = A.span_hashes(norm, stop[tail], ends[tail])
    plain = np.append(0, np.cumsum(_PLAIN[norm]))
    upper = np.append(0, np.cumsum(_UPPER[norm] | (norm >= 128)))
    some = (plain[stop] - plain[starts]) > 1
    capitals = some & (upper[stop] - upper[starts] == plain[stop] - plain[starts]) & _UPPER[norm[np.minimum(starts, len(norm) - 1)]]
    whole = A.span_hashes(norm, starts, ends)
    again = np.append(False, (whole[1:] == whole[:-1]) & (text[1:] == text[:-1]))
    texts = [text, text, text[tail]]
    keys = [A.mix(words + _SALTS[0]), A.mix(prefixes + _SALTS[1]), A.mix(tails + _SALTS[2])]
    distinct = np.unique(np.concatenate(texts).astype(np.uint64) << np.uint64(PLACE_BITS) | np.concatenate(keys) >> np.uint64(64 - PLACE_BITS))
    shares = [(text[tail], A.mix(tails + _SALTS[3])), (text[capitals], np.full(int(capitals.sum()), A.mix(_SALTS[4:5])[0])), (text[again], np.full(int(again.sum()), A.mix(_SALTS[5:6])[0]))]
    parts, number = np.unique(np.concatenate([t.astype(np.uint64) << np.uint64(PLACE_BITS) | k >> np.uint64(64 - PLACE_BITS) for t, k in shares]), return_inverse=True)
    share = np.bincount(number, minlength=len(parts)) / n[(parts >> np.uint64(PLACE_BITS)).astype(np.int64)] * _SHARE
    key, value = np.concatenate([distinct, parts]), np.concatenate([np.ones(len(distinct)), share])
    order = np.argsort(key, kind="stable")
    key = key[order]
    return (key >> np.uint64(PLACE_BITS)).astype(np.int64), (key & np.uint64(PLACES - 1)).astype(np.int64), value[order]


@dataclass
class Model:
    """Weights by place, and thresholds between the grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def grades(self, score: np.ndarray) -> np.ndarray:
        """The probability of each grade from 1 on, or a higher one."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))


def fit_arrays(text: np.ndarray, place: np.ndarray, value: np.ndarray, grade: np.ndarray) -> Model:
    """The weights and thresholds of largest likelihood, with small penalties, by proximal Adam."""
    top = int(grade.max(initial=0))
    if not len(grade) or top == 0:
        return Model(np.zeros(PLACES, np.float32), np.full(top, 50.0))
    seen = np.bincount(place, minlength=PLACES)
    used = np.flatnonzero(seen >= min(LEAST_TEXTS, len(grade)))
    keep = seen[place] >= min(LEAST_TEXTS, len(grade))
    text, column, value = text[keep], np.searchsorted(used, place[keep]), value[keep]
    above = np.array([np.mean(grade > j) for j in range(top)]).clip(0.01, 0.99)
    start = -np.log(above / (1 - above))
    # thresholds are a first one and the logarithms of the gaps
    theta = np.concatenate([np.zeros(len(used)), start[:1], np.log(np.maximum(np.diff(start), 0.05))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, ROUNDS + 1):
        w, gaps = theta[: len(used)], np.exp(theta[len(used) + 1 :])
        cut = theta[len(used)] + np.append(0, np.cumsum(gaps))
        score = np.bincount(text, w[column] * value, len(grade))
        below = 1 / (1 + np.exp(np.clip(score[:, None] - cut[None, :], -30, 30)))  # P(grade <= j)
        full = np.concatenate([np.zeros((len(grade), 1)), below, np.ones((len(grade), 1))], axis=1)
        slope = full * (1 - full)
        at = np.arange(len(grade))
        p = np.maximum(full[at, grade + 1] - full[at, grade], 1e-12)
        by_score = -(slope[at, grade + 1] - slope[at, grade]) / p  # of the log-likelihood
        by_cut = np.array([((grade == j) * slope[:, j + 1] / p - (grade == j + 1) * slope[:, j + 1] / p).mean() for j in range(top)])
        tail = np.cumsum(by_cut[::-1])[::-1]
        gradient = np.concatenate([np.bincount(column, by_score[text] * value, len(used)) / len(grade) - DECAY * w, tail[:1], tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        pace = RATE / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        theta += pace * m / (1 - 0.9**step)
        w = theta[: len(used)]
        theta[: len(used)] = np.sign(w) * np.maximum(np.abs(w) - np.minimum(SPARSE * pace[: len(used)], RATE), 0)
    weights = np.zeros(PLACES, np.float32)
    weights[used] = theta[: len(used)]
    return Model(weights, theta[len(used)] + np.append(0, np.cumsum(np.exp(theta[len(used) + 1 :]))))


def _extractor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in A.text_steps(batch.column(2), STEP_BYTES):
            text, place, value = features(batch.column(2).slice(a, b - a))
            edges = np.searchsorted(text, np.arange(b - a + 1))
            blobs = [A.pack(place[i:j].astype(np.uint32), value[i:j].astype(np.float32)) for i, j in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:2]), pa.array(np.diff(edges)), pa.array(blobs, pa.binary())], ["h", "grade", "n", "blob"])


def fit(docs: DataFrame, ratings: DataFrame, grade: Column, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, most: int = FEATURES) -> Model:
    """Learns from the texts of a bounded number of rated ids."""
    rated = ratings.select(F.col(id_col).cast("long").alias("_id"), grade.cast("int").alias("grade")).filter("_id is not null and grade is not null").groupBy("_id").agg(F.max("grade").alias("grade"))
    chosen = rated.withColumn("h", F.xxhash64("_id")).orderBy("h", "_id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))
    # `sample` rows of three numbers, whatever the input
    one = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "h", "grade").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    seen = frames.checkpointed(one.select("h", "grade", "text").mapInArrow(A.tidy(_extractor), "h long, grade int, n long, blob binary"))
    sizes = seen.select("h", "n").toPandas().sort_values("h")
    within = sizes["h"][sizes["n"].cumsum() <= most]
    rows = seen.filter(F.col("h") <= (int(within.iloc[-1]) if len(within) else -(1 << 63))).toPandas().sort_values(["h", "grade"])
    parts = [A.unpack(b) for b in rows["blob"]]
    text = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts]) if parts else np.zeros(0, np.int64)
    place, value = (np.concatenate([np.zeros(0), *(p[i] for p in parts)]) for i in (0, 1))
    return fit_arrays(text, place.astype(np.int64), value, rows["grade"].to_numpy(np.int64))


def score(docs: DataFrame, model: Model, text_col: str = "text", tail: int | None = None) -> DataFrame:
    """All columns, then ``expected_grade`` and ``tail_probability``, of the grade ``tail`` (the highest if none) or more."""
    added = ["expected_grade", "tail_probability"]
    rest = [c for c in docs.columns if c not in added]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for a, b in A.text_steps(column, STEP_BYTES):
                text, place, value = features(column.slice(a, b - a))
                above = m.grades(np.bincount(text, m.weights[place] * value, b - a))
                at = len(m.thresholds) if tail is None else tail
                tails = above[:, at - 1] if 0 < at <= above.shape[1] else np.full(b - a, float(at == 0))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), pa.array(above.sum(axis=1)), pa.array(tails)], [*rest, *added])

    kept = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text_col}`").cast("string").alias("_text"))
    return kept.mapInArrow(A.tidy(run), T.StructType([*(docs.schema[c] for c in rest), *(T.StructField(c, T.DoubleType()) for c in added)]))


def graded(labels: DataFrame) -> Column:
    """A grade from 0 to 2: a point for good quality and one for not being toxic; null if both are unknown."""
    quality, toxic = F.col("quality").cast("int"), F.col("toxic").cast("int")
    return F.when(quality.isNotNull() | toxic.isNotNull(), F.coalesce(quality, F.lit(1)) + 1 - F.coalesce(toxic, F.lit(0)))
