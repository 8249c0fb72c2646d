"""Language identification by nearest centroids.

A text's vector has the TF-IDF weights of its lower-cased byte n-grams (1 to 3
bytes with a letter among them) in ``DIMS`` hashed places, at unit length.

* Document frequencies are counted over all training texts.
* Centroids are fitted on a bounded sample: of each language, the ``SAMPLE``
  distinct training texts with the smallest hashes, or all if it has fewer.
  Every language is learned; where there are more than ``LANGUAGES``, each has
  fewer texts (``LEAST`` at least) and centroids instead.  Spherical k-means
  gives up to ``CLUSTERS`` centroids for each language.  A centroid whose texts
  mostly carry another language's label (mislabelled texts make such ones) goes.
* A text gets the language of the centroid with the largest cosine.  It is
  *rejected* if that is under the language's limit.  The limit lies ``MARGIN``
  of the way from what unlearned languages reach to the 1 % quantile of the
  language's own cosines in the sample.  The former is measured by leaving out
  each language in turn: the 90 % quantile of its texts' cosines with the other
  languages' centroids, and of these the median over languages.  Texts nearest
  to another language than their label's count in neither.

Contract: null text, and text without a letter, is ``und`` with score 0 and
rejected.  So is any text where nothing was learned.  All columns are kept;
input columns named like an output column are replaced.  Rows with a null
language or fold are not learned from.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays as A
from . import frames

DIMS = 4096
GRAMS = 3
#: Bounds of the sample: texts of each language, languages that have so many, and texts of each of more languages.
SAMPLE, LANGUAGES, LEAST = 300, 200, 10
CLUSTERS = 6
MARGIN = 0.2
#: Where one language is learned, what unlearned ones reach is taken as this part of its own quantile.
ALONE = 1 / 3
#: Bytes and texts that are handled together.
STEP_BYTES, STEP_TEXTS = 1 << 20, 128
SEGMENT = 1 << 20
#: Bytes of letters in lower-cased text: a to z and all of longer sequences.
_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = _LETTER[128:] = True
UNKNOWN = "und"


@dataclass
class Model:
    """``labels`` and ``limits`` by centroid (rows of ``centroids``)."""

    idf: np.ndarray
    labels: list[str]
    limits: np.ndarray
    centroids: np.ndarray


def counts(column: pa.Array) -> np.ndarray:
    """How often each text has an n-gram of each place (texts x DIMS)."""
    data, offsets = A.text_buffer(pc.utf8_lower(pc.fill_null(column.cast(pa.string()), "")))
    n = np.diff(offsets)
    total = np.zeros(len(n) * DIMS, np.int64)
    for start in range(0, len(data), SEGMENT):  # n-grams that start in a segment
        part = data[start : start + SEGMENT + GRAMS - 1]
        text = np.searchsorted(offsets, np.arange(start, start + len(part)), side="right") - 1
        letter = _LETTER[part]
        plain = np.where(letter, part, np.uint8(0x20))
        hashed, some = np.zeros(len(part), np.uint64), np.zeros(len(part), bool)
        for size in range(1, GRAMS + 1):
            m = len(part) - size + 1
            if m <= 0:
                break
            hashed = hashed[:m] * np.uint64(257) + plain[size - 1 :].astype(np.uint64) + np.uint64(1)
            some = some[:m] | letter[size - 1 :]
            inside = some & (text[:m] == text[size - 1 :])
            inside[SEGMENT:] = False
            place = ((hashed[inside] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 12)).astype(np.int64)
            total += np.bincount(text[:m][inside] * DIMS + place, minlength=len(total))
    return total.reshape(len(n), DIMS)


def vectors(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.log1p(count).astype(np.float32) * idf
    return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-12)


def _steps(column: pa.Array) -> Iterator[tuple[int, int]]:
    for a, b in A.text_steps(column, STEP_BYTES):
        for c in range(a, b, STEP_TEXTS):
            yield c, min(b, c + STEP_TEXTS)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, seen = np.zeros(DIMS, np.int64), 0
    for batch in batches:
        for a, b in _steps(batch.column(0)):
            total += (counts(batch.column(0).slice(a, b - a)) > 0).sum(axis=0)
            seen += b - a
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMS)), pa.array(np.append(seen, total))], ["place", "n"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places and counts of each text, packed."""
    for batch in batches:
        for a, b in _steps(batch.column(2)):
            rows = []
            for row in counts(batch.column(2).slice(a, b - a)):
                at = np.flatnonzero(row)
                rows.append(A.pack(at.astype(np.uint16), row[at].astype(np.uint32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(rows, pa.binary())], ["lang", "h", "blob"])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids by cosine, starting from texts far from each other."""
    centres = _unit(x.mean(axis=0, keepdims=True))
    while len(centres) < min(k, len(x)):
        centres = np.vstack([centres, x[np.argmin((x @ centres.T).max(axis=1))]])
    for _ in range(rounds):
        nearest = np.argmax(x @ centres.T, axis=1)
        centres = _unit(np.array([x[nearest == i].mean(axis=0) for i in range(len(centres)) if (nearest == i).any()]))
    return centres


def _below(most: int, m: int) -> int:
    """A bound that over ``most`` of ``m`` hashes are under, but for odds of about 1 in 10^9; all are if there are few."""
    wanted = most + math.ceil(6 * math.sqrt(most)) + 20
    return (1 << 63) - 1 if m <= wanted else (wanted << 64) // m - (1 << 63)


def _dense(blobs: list[bytes], idf: np.ndarray) -> np.ndarray:
    """The vectors of sampled texts that have an n-gram."""
    count = np.zeros((len(blobs), DIMS), np.int64)
    for i, blob in enumerate(blobs):
        at, n = A.unpack(blob)
        count[i, at] = n
    return vectors(count[count.any(axis=1)], idf)


def _clustered(idf: np.ndarray, k: int, most: int):
    """The ``most`` texts of a language with the smallest hashes, and its centroids."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("h").slice(0, most)
        x = _dense(table["blob"].to_pylist(), idf)
        centres = kmeans(x, k) if len(x) else x
        lang = table["lang"][0].as_py()
        return pa.table({"lang": [lang] * len(centres), "centroid": pa.array([c.astype(np.float32).tobytes() for c in centres], pa.binary())})

    return run


def _voting(idf: np.ndarray, model, most: int):
    """How many of a language's texts are nearest to each centroid."""

    def run(table: pa.Table) -> pa.Table:
        x = _dense(table.sort_by("h").slice(0, most)["blob"].to_pylist(), idf)
        near, n = np.unique(np.argmax(x @ model.value.centroids.T, axis=1), return_counts=True)
        return pa.table({"lang": [table["lang"][0].as_py()] * len(near), "near": near, "n": n})

    return run


def _reaching(idf: np.ndarray, model, most: int):
    """What a language's own texts reach, and what they reach with other languages' centroids."""

    def run(table: pa.Table) -> pa.Table:
        m, lang = model.value, table["lang"][0].as_py()
        cosine = _dense(table.sort_by("h").slice(0, most)["blob"].to_pylist(), idf) @ m.centroids.T
        mine = np.array(m.labels, object) == lang
        right = mine[np.argmax(cosine, axis=1)]
        some = cosine[right] if right.any() else cosine
        own = float(np.quantile(some[:, mine].max(axis=1), 0.01))
        foreign = float(np.quantile(some[:, ~mine].max(axis=1), 0.9)) if right.any() and not mine.all() else None
        return pa.table({"lang": [lang], "own": pa.array([own]), "foreign": pa.array([foreign], pa.float64())})

    return run


def _kept(labels: np.ndarray, votes: dict[tuple[int, str], float]) -> np.ndarray:
    """The centroids whose texts mostly carry their own language's label, and one of each language at least."""
    best = np.zeros(len(labels))
    for (i, _), n in votes.items():
        best[i] = max(best[i], n)
    own = np.array([votes.get((i, lang), 0.0) for i, lang in enumerate(labels)])
    keep = (own > 0) & (own >= best)
    for lang in np.unique(labels):
        mine = np.flatnonzero(labels == lang)
        if not keep[mine].any():
            keep[mine[np.argmax(own[mine])]] = True
    return np.flatnonzero(keep)


def _limits(own: dict[str, float], foreign: list[float]) -> dict[str, float]:
    """MARGIN of the way from what unlearned languages reach to what a language's own texts do."""
    middle = np.median(foreign) if foreign else None
    return {lang: q - (1 - MARGIN) * max(0, q - (ALONE * q if middle is None else middle)) for lang, q in own.items()}


def fit(train: DataFrame, text_col: str, lang_col: str) -> Model:
    """Learns from the rows of ``train`` with a language.

    The sample stays on the executors, a group for each language.  The driver
    has the centroids, 16 kB each, and some numbers of each language.
    """
    context = train.sparkSession.sparkContext
    rows = train.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    frequency = rows.select("text").mapInArrow(A.tidy(_frequencies), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    found = dict(zip(frequency["place"].tolist(), frequency["n"].tolist(), strict=True))
    n = found.get(-1, 0)
    idf = np.array([np.log((1 + n) / (1 + found.get(i, 0))) + 1 for i in range(DIMS)], np.float32)
    nothing = Model(idf, [], np.zeros(0), np.zeros((0, DIMS), np.float32))
    # texts that repeat share a hash, so a group of copies counts once
    hashed = rows.filter(has_letter(F.col("text"))).withColumn("h", F.xxhash64("text"))
    of = {r["lang"]: r["n"] for r in hashed.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not of:
        return nothing
    most = max(LEAST, min(SAMPLE, SAMPLE * LANGUAGES // len(of)))
    below = train.sparkSession.createDataFrame([(lang, _below(most, m)) for lang, m in of.items()], "lang string, below long")
    chosen = hashed.join(F.broadcast(below), "lang").filter("h <= below")
    sample = frames.checkpointed(chosen.groupBy("lang", "h").agg(F.first("text").alias("text")).mapInArrow(A.tidy(_sampled), "lang string, h long, blob binary"))
    groups = sample.groupBy("lang")
    clustered = groups.applyInArrow(A.tidy_group(_clustered(idf, max(1, CLUSTERS * most // SAMPLE), most)), "lang string, centroid binary").toArrow().sort_by("lang")
    if not len(clustered):
        return nothing
    labels = np.array(clustered["lang"].to_pylist(), object)
    centroids = np.frombuffer(b"".join(clustered["centroid"].to_pylist()), np.float32).reshape(len(labels), DIMS)
    told = groups.applyInArrow(A.tidy_group(_voting(idf, context.broadcast(Model(idf, labels.tolist(), np.zeros(0), centroids)), most)), "lang string, near long, n long").toPandas()
    size = told.groupby("lang")["n"].sum()
    votes = {(i, lang): c * of[lang] / size[lang] for lang, i, c in zip(told["lang"], told["near"], told["n"], strict=True)}
    at = _kept(labels, votes)
    labels, centroids = labels[at].tolist(), centroids[at]
    reached = groups.applyInArrow(A.tidy_group(_reaching(idf, context.broadcast(Model(idf, labels, np.zeros(0), centroids)), most)), "lang string, own double, foreign double").toPandas()
    limit = _limits(dict(zip(reached["lang"], reached["own"], strict=True)), reached["foreign"].dropna().tolist())
    return Model(idf, labels, np.array([limit[lang] for lang in labels]), centroids)


def has_letter(column: Column) -> Column:
    return F.coalesce(column.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns, then ``lang_pred``, ``score`` (the cosine) and ``rejected``."""
    added = {"lang_pred": T.StringType(), "score": T.DoubleType(), "rejected": T.BooleanType()}
    rest = [c for c in docs.columns if c not in added]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a number of centroids that the sample bounds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        labels = np.array([*m.labels, UNKNOWN], object)
        for batch in batches:
            letters = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            column = batch.column(batch.num_columns - 2)
            for a, b in _steps(column):
                if m.labels:
                    cosine = vectors(counts(column.slice(a, b - a)), m.idf) @ m.centroids.T
                    nearest = np.argmax(cosine, axis=1)
                    best = np.clip(cosine[np.arange(b - a), nearest].astype(float), 0, 1)
                    rejected = best < m.limits[nearest]
                else:
                    nearest, best, rejected = np.full(b - a, -1), np.zeros(b - a), np.ones(b - a, bool)
                none = ~letters[a:b]
                nearest = np.where(none, -1, nearest)
                new = [pa.array(labels[nearest], pa.string()), pa.array(np.where(none, 0.0, best)), pa.array(rejected | none)]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-2]), *new], [*rest, *added])

    kept = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text_col}`").cast("string").alias("_text"), has_letter(F.col(f"`{text_col}`")).alias("_letter"))
    return kept.mapInArrow(A.tidy(run), T.StructType([*(docs.schema[c] for c in rest), *(T.StructField(k, v) for k, v in added.items())]))


def fold(id_: Column, folds: int = 4) -> Column:
    """The checksum of the id's digits modulo ``folds``, null for a null id."""
    return F.pmod(F.crc32(id_.cast("long").cast("string").cast("binary")), F.lit(folds))


def identify(docs: DataFrame, train: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, left_out: int = 2) -> DataFrame:
    """Learns from the rows of ``train`` (``docs`` if there is none) outside the left-out fold, and predicts all of ``docs``."""
    source = docs if train is None else train
    model = fit(source.filter(fold(F.col(id_col), folds) != left_out), text_col, lang_col)
    return predict(docs.withColumn("held_out", F.coalesce(fold(F.col(id_col), folds) == left_out, F.lit(False))), model, text_col)
