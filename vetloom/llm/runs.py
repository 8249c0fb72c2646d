"""Runs of words that repeat with a period, and texts without the repeats.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q``
apart are the same) that has at least ``max(LEAST, TIMES * q)`` words and that
no neighbouring word extends with that period.  Such a run has ``length - q``
pairs of equal words ``q`` apart, one behind the other, so a lag can only have
one where as many pairs are found:

* pairs are counted for every lag up to a quarter of the text.  A frequent word
  is counted by the Fourier transform of its places (its autocorrelation, whole
  numbers after rounding), a rare one by the differences between its places.  A
  word is frequent where its pairs would cost more than the transform;
* only lags with enough pairs are scanned for islands of equal words.  The scan
  tests every few words first, so dense that no island slips through, and then
  looks at the neighbourhood of what is left;
* lags go from small to large.  The pairs of a run are taken off the counts of
  all multiples of its period, since the run cannot hold another with one of
  these periods: texts of one repeated word are scanned once.

Texts are independent, so there is no shuffle, and a task holds the arrays of
some megabytes of text, or of one longer text.

Contract: words are the maximal parts without white space (space and 0x09 to
0x0D).  Null and empty texts have no words.  Repeated rows are judged each, an
empty table gives an empty result, and all other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays as A
from . import frames

#: A run has at least LEAST words and TIMES periods.
LEAST, TIMES = 6, 4
#: Bytes of text that share one set of arrays.
STEP = 1 << 20
#: Probes that an island of equal words holds at least.
_PROBES = 8
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def _needed(lag: np.ndarray | int) -> np.ndarray | int:
    """Equal words one behind the other that a run of this period has at least."""
    return np.maximum(LEAST - lag, (TIMES - 1) * lag)


def _transform_size(n: int) -> int:
    """The smallest size of a fast transform from ``n`` on."""
    power = 1 << max(n - 1, 1).bit_length()
    return next(s for s in (power * 5 // 8, power * 3 // 4, power) if s >= n)


def _by_transform(places: list[np.ndarray], n: int, lags: int) -> np.ndarray:
    """Pairs at lags 1 to ``lags`` of the words that are at these places of ``n``."""
    size = _transform_size(n + lags)
    power = np.zeros(size // 2 + 1)
    for at in places:
        mark = np.zeros(size)
        mark[at] = 1
        spectrum = np.fft.rfft(mark)
        power += spectrum.real**2 + spectrum.imag**2
    return np.rint(np.fft.irfft(power, size)[1 : lags + 1]).astype(np.int64)


def _by_differences(place: np.ndarray, group: np.ndarray, most: np.ndarray, cell: np.ndarray, count: np.ndarray) -> None:
    """Adds the pairs within each group of places, which are in order, to ``count[cell + lag]``."""
    alive, k, wait, held = np.arange(len(place) - 1), 1, [], 0
    while len(alive):
        lag = place[alive + k] - place[alive]
        near = (group[alive + k] == group[alive]) & (lag <= most[alive])
        alive, lag = alive[near], lag[near]
        wait.append(cell[alive] + lag)
        held += len(lag)
        if held > len(count):
            count += np.bincount(np.concatenate(wait), minlength=len(count))
            wait, held = [], 0
        k += 1
        alive = alive[alive + k < len(place)]
    if wait:
        count += np.bincount(np.concatenate(wait), minlength=len(count))


def lag_counts(code: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts of words ``code[first[i]:first[i + 1]]``: pairs of equal words at each lag, and where a text's lag 1 stands less one."""
    n = np.diff(first)
    lags = n // TIMES
    base = np.cumsum(lags) - lags - 1
    count = np.zeros(int(lags.sum()), np.int64)
    if not len(count):
        return count, base
    text = np.repeat(np.arange(len(n)), n)
    key = text * (int(code.max()) + 1) + code
    order = np.argsort(key, kind="stable")
    group = np.cumsum(np.diff(key[order], prepend=key[order[0]]) != 0)
    often = np.bincount(group)
    size = n + lags
    frequent = often.astype(float) ** 2 > (size * np.log2(np.maximum(size, 2)))[text[order[np.cumsum(often) - often]]]
    place = order - first[text[order]]
    edges = np.append(0, np.cumsum(often))
    of: dict[int, list[np.ndarray]] = {}
    for g in np.flatnonzero(frequent).tolist():
        of.setdefault(int(text[order[edges[g]]]), []).append(place[edges[g] : edges[g + 1]])
    for t, places in of.items():
        count[base[t] + 1 : base[t] + 1 + lags[t]] += _by_transform(places, int(n[t]), int(lags[t]))
    rare = ~frequent[group]
    mine = text[order[rare]]
    _by_differences(place[rare], group[rare], lags[mine], base[mine], count)
    return count, base


def _islands(word: np.ndarray, lag: int) -> Iterator[tuple[int, int]]:
    """The maximal stretches of places whose word is that ``lag`` places on, if long enough for a run."""
    need, last = int(_needed(lag)), len(word) - lag
    step = max(1, need // _PROBES)
    probe = word[:last:step] == word[lag::step]
    edge = np.flatnonzero(np.diff(probe.astype(np.int8), prepend=0, append=0))
    low, high = edge[::2], edge[1::2]
    for a, b in zip(low.tolist(), high.tolist(), strict=True):
        if b - a < need // step:
            continue
        left, right = max(0, (a - 1) * step + 1), min(last, b * step)
        same = word[left:right] == word[left + lag : right + lag]
        inner = np.flatnonzero(np.diff(same.astype(np.int8), prepend=0, append=0))
        for x, y in zip(inner[::2].tolist(), inner[1::2].tolist(), strict=True):
            if y - x >= need:
                yield left + x, left + y


def runs_of(word: np.ndarray, pairs: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text, by start and period; ``pairs`` has the number at lag ``i + 1`` and is used up."""
    found, lags = {}, len(pairs)
    for lag in (np.flatnonzero(pairs >= _needed(np.arange(1, lags + 1))) + 1).tolist():
        if pairs[lag - 1] < _needed(lag):
            continue
        for a, b in _islands(word, lag):
            run = a, b - a + lag
            if run not in found:
                found[run] = lag
                multiples = np.arange(lag, min(lags, run[1] - 1) + 1, lag)
                pairs[multiples - 1] -= run[1] - multiples
    return sorted((start, length, lag) for (start, length), lag in found.items())


def _judged(column: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Numbers of words, runs and texts without repeats."""
    norm, starts, ends, first = A.normal_words(column)
    width = ends - starts
    packed = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(0, np.cumsum(width))), pa.py_buffer(norm[norm != 0x20])])
    code = packed.dictionary_encode().indices.to_numpy().astype(np.int64)
    count, base = lag_counts(code, first)
    n = np.diff(first)
    rows: list[tuple[int, int, int]] = []
    many = np.zeros(len(n), np.int64)
    keep = np.ones(len(code), bool)
    lag = np.arange(len(count)) - np.repeat(base, n // TIMES)
    texts = np.unique(np.repeat(np.arange(len(n)), n // TIMES)[count >= _needed(lag)])
    for t in texts.tolist():
        mine = runs_of(code[first[t] : first[t + 1]], count[base[t] + 1 : base[t] + 1 + n[t] // TIMES])
        many[t] = len(mine)
        rows += mine
        for start, length, period in mine:
            keep[first[t] + start + period : first[t] + start + length] = False
    fields = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ([], [], []))]
    runs = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)).astype(np.int32)), pa.StructArray.from_arrays(fields, RUN.names))
    # a kept word travels with the space behind it, but for a text's last one
    size = np.where(keep, width + 1, 0)
    left = np.append(0, np.cumsum(size))[first]
    body = norm[np.repeat(keep, width + 1)] if len(norm) else norm
    some = np.diff(left) > 0
    inner = np.ones(len(body), bool)
    inner[left[1:][some] - 1] = False
    offsets = np.append(0, np.cumsum(np.diff(left) - some))
    text = pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(body[inner])])
    return n, runs, text.cast(pa.string())


def periodic_runs(docs: DataFrame, text_col: str = "text", step: int = STEP) -> DataFrame:
    """All columns but the text, then ``n_words``, ``runs`` (start, length and period in words, by start and period) and ``collapsed_text``: the words, one space between two, without those that a run repeats after its first period."""
    new = ["n_words", "runs", "collapsed_text"]
    names = [c for c in docs.columns if c not in (text_col, *new)]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in A.text_steps(batch.column(0), step):
                n, runs, text = _judged(batch.column(0).slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array(n, pa.int64()), runs, text], ["_row", *new])

    rows = docs.select(F.col(text_col).cast("string").alias("_text"), frames.others(docs, text_col, *new).alias("_row"))
    kind = T.StructType([rows.schema["_row"], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed_text", T.StringType())])
    done = rows.mapInArrow(A.tidy(judge), kind)
    return done.select(*[F.col(f"_row.`{c}`").alias(c) for c in names], *new)
