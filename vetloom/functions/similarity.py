"""Similarity of short strings by matching blocks, as expressions.

The longest common block of two strings is found (of several the first in the
one, and then in the other string), then those left and right of it, and so on.
The ratio is twice the length of all blocks over both lengths.  Spark evaluates
this beside the data, without Python: a loop over a list of pairs of parts that
are still to be compared.  What two lengths, and the characters that two strings
share, leave possible is tested first, so that few pairs come to the loop.  Only
the keywords of lines are found in Arrow batches, since a batch repeats its words.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetloom.session import checkpointed

ANCHOR_CUTOFF, SNAP_CUTOFF = 0.75, 0.6
#: Characters that words are split at, and what is dropped from them.
SPACE, NO_LETTER = r"[\s\x1c-\x1f\x85\p{Z}]+", r"[^\p{L}\p{N}_]"
#: Words that each other word is compared with; more of them meet by the substrings that they share.
FEW = 1024


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """An expression in which a value occurs more than once, but is computed once."""
    return F.transform(F.array(value), body)[0]


def _upto(n: Column) -> Column:
    return F.sequence(F.lit(1), n)


def _block(a: Column, b: Column) -> Column:
    """(length, minus the place in ``a``) of the longest common block of two strings that are not empty."""
    longest = lambda i: F.size(F.filter(_upto(F.length(a) - i + 1), lambda n: F.instr(b, F.substr(a, i, n)) > 0))
    return F.array_max(F.transform(_upto(F.length(a)), lambda i: F.struct(longest(i).alias("n"), (-i).alias("i"))))


def _parts(x: Column, n: Column, i: Column) -> Column:
    """What lies left and right of a block, where both strings have something."""
    both = lambda j: F.array(F.struct(F.substr(x["a"], F.lit(1), i - 1).alias("a"), F.substr(x["b"], F.lit(1), j - 1).alias("b")), F.struct(F.substr(x["a"], i + n).alias("a"), F.substr(x["b"], j + n).alias("b")))
    return F.filter(_let(F.instr(x["b"], F.substr(x["a"], i, n)), both), lambda y: (F.length(y["a"]) > 0) & (F.length(y["b"]) > 0))


def matched(a: Column, b: Column) -> Column:
    """The length of all matching blocks."""

    def step(state: Column) -> Column:
        x, rest = state["todo"][0], F.slice(state["todo"], F.lit(2), F.size(state["todo"]))
        done = lambda t: F.struct((state["m"] + t["n"]).alias("m"), F.when(t["n"] > 0, F.concat(rest, _parts(x, t["n"], -t["i"]))).otherwise(rest).alias("todo"))
        return _let(_block(x["a"], x["b"]), done)

    # a block takes at least a character of each, and leaves two parts at most
    rounds = _upto(2 * F.least(F.length(a), F.length(b)) + 1)
    start = F.struct(F.lit(0).alias("m"), F.array(F.struct(a.alias("a"), b.alias("b"))).alias("todo"))
    looped = F.aggregate(rounds, start, lambda state, _: F.when(F.size(state["todo"]) > 0, step(state)).otherwise(state), lambda state: state["m"])
    return F.when((F.length(a) > 0) & (F.length(b) > 0), looped).otherwise(0)


def ratio(a: Column, b: Column) -> Column:
    """Twice the matched length over both lengths; 1 for two empty strings."""
    both = F.length(a) + F.length(b)
    return F.when(both > 0, F.lit(2.0) * matched(a, b) / both).otherwise(1.0)


def _possible(a: Column, b: Column, cutoff: float) -> Column:
    """Whether lengths and shared characters leave a ratio of the cutoff possible."""
    least = F.lit(cutoff) * (F.length(a) + F.length(b))
    without = lambda x, y: F.length(F.call_function("translate", x, y, F.lit("")))
    shared = F.least(F.length(a) - without(a, b), F.length(b) - without(b, a))
    return (2 * F.least(F.length(a), F.length(b)) >= least) & (2 * shared >= least)


def similar(a: Column, b: Column, cutoff: float) -> Column:
    """Whether the ratio of the two reaches the cutoff."""
    return F.when(a == b, True).when(_possible(a, b, cutoff), ratio(a, b) >= cutoff).otherwise(False)


def words(text: Column) -> Column:
    """The words of a line in upper case, without punctuation; some may be empty."""
    return F.transform(F.split(F.upper(text), SPACE), lambda w: F.regexp_replace(w, NO_LETTER, ""))


@lru_cache(1 << 16)
def _reaches(word: str, key: str, cutoff: float) -> bool:
    return SequenceMatcher(None, word, key, autojunk=False).ratio() >= cutoff


def near_keywords(keywords: Sequence[str], cutoff: float = ANCHOR_CUTOFF) -> Callable[[Column], Column]:
    """A function of a page's lines: for each line, the keywords that one of its words is similar to.

    Papers share their words, so this looks at the distinct words of a batch of
    pages.  Lengths and shared characters, counted for all of them at once, leave
    few pairs to compare.
    """
    keys = sorted(set(keywords))
    chars = sorted(set("".join(keys)))

    def of_words(distinct: list[str]) -> np.ndarray:
        """For each word and keyword, whether they are similar."""
        counts = np.array([[w.count(c) for c in chars] for w in distinct], dtype=np.int64).reshape(-1, len(chars))
        sizes = np.array([len(w) for w in distinct], dtype=np.int64)
        out = np.zeros((len(distinct), len(keys)), dtype=bool)
        for j, key in enumerate(keys):
            shared = np.minimum(counts, [key.count(c) for c in chars]).sum(axis=1)
            for i in np.flatnonzero((2 * shared >= cutoff * (sizes + len(key)) - 1e-6) & (shared > 0)):
                out[i, j] = _reaches(distinct[i], key, cutoff)
        return out

    def near(pages: pa.Array) -> pa.Array:
        lines = pages.flatten()
        coded = lines.flatten().dictionary_encode()
        fits = of_words(coded.dictionary.to_pylist())
        codes = coded.indices.to_numpy(zero_copy_only=False)
        line = np.repeat(np.arange(len(lines)), lines.value_lengths().to_numpy(zero_copy_only=False))
        some = fits.any(axis=1)[codes] if len(codes) else np.zeros(0, dtype=bool)
        at, key = np.nonzero(fits[codes[some]])
        found = np.unique(line[some][at] * len(keys) + key)
        ends = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
        of_line = pa.ListArray.from_arrays(ends(np.bincount(found // len(keys), minlength=len(lines))), pa.array(keys).take(pa.array(found % len(keys))))
        return pa.ListArray.from_arrays(ends(pages.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), of_line, mask=pages.is_null())

    near.__annotations__ = {"pages": pa.Array, "return": pa.Array}  # objects, not their names: Spark reads them
    by_batch = F.arrow_udf(near, "array<array<string>>")
    return lambda lines: by_batch(F.transform(lines, lambda t: words(F.coalesce(t, F.lit("")))))


def closest(domain: Sequence[str], cutoff: float = SNAP_CUTOFF) -> Callable[[Column], Column]:
    """A function of a value: the most similar member of a domain (of several the last by the alphabet), null below the cutoff."""
    members = F.array(*[F.lit(m) for m in domain])

    def snap(value: Column) -> Column:
        rated = F.transform(F.filter(members, lambda m: _possible(m, value, cutoff)), lambda m: F.struct(ratio(m, value).alias("r"), m.alias("m")))
        return F.array_max(F.filter(rated, lambda x: x["r"] >= cutoff))["m"]

    return snap


def _marks(text: Column) -> Column:
    """64 bits of a word: of each of 32 sorts of characters, whether it has one, and whether it has two."""

    def mark(held: Column, char: Column) -> Column:
        shift = lambda bit, n: F.call_function("shiftleft", bit, n)
        once = shift(F.lit(1).cast("long"), F.pmod(F.ascii(char), F.lit(32)).cast("int"))
        return held.bitwiseOR(F.when(held.bitwiseAND(once) != 0, shift(once, F.lit(32))).otherwise(once))

    # never null, and so told: of a join on marks the optimizer would make a filter for all that words are derived from
    return F.coalesce(F.aggregate(F.split(text, ""), F.lit(0).cast("long"), mark), F.lit(0).cast("long"))


def similar_pairs(left: DataFrame, right: DataFrame, cutoff: float = ANCHOR_CUTOFF, few: int = FEW) -> DataFrame:
    """(word, other, ratio) of all pairs of distinct words (column ``word`` of ``left``, ``other`` of ``right``) whose ratio reaches the cutoff.

    In such a pair of n and o characters at least m match.  So a word has n - m
    characters at most that the other has not, and no more bits of its marks.
    Where ``right`` has few words, each word of ``left`` is tried with all of them:
    two lengths and two numbers to compare.

    Where it has more, words meet first.  Two blocks have a character between them
    that does not match, in one word or the other, so there are ``n + o - 2m + 1``
    blocks at most, and one has ``m / (n + o - 2m + 1)`` characters: an equi-join
    on both lengths and a substring of that length.  Few pairs are left for the
    loop.  Null and empty words are left out.
    """
    # lengths that leave the ratio possible, and one more on each side for the rounding of doubles
    near = lambda n: F.sequence(F.greatest(F.lit(1), F.floor(n * F.lit(cutoff / (2 - cutoff))).cast("int")), F.ceil(n * F.lit((2 - cutoff) / cutoff)).cast("int"))
    one = left.select("word").filter("word <> ''").distinct().withColumn("n", F.length("word")).withColumn("_a", _marks(F.col("word")))
    two = checkpointed(right.select("other").filter("other <> ''").distinct().withColumn("o", F.length("other")).withColumn("_b", _marks(F.col("other"))))
    least = F.lit(cutoff) * (F.col("n") + F.col("o")) / 2 - 1e-6  # for the rounding of doubles
    without = lambda a, b: F.bit_count(F.col(a).bitwiseAND(F.bitwise_not(F.col(b))))
    close = (F.least("n", "o") >= least) & (F.col("n") - without("_a", "_b") >= least) & (F.col("o") - without("_b", "_a") >= least)

    def block(n: Column, o: Column) -> Column:
        m = F.ceil(F.lit(cutoff) * (n + o) / 2)
        return F.greatest(F.lit(1), F.ceil(m / F.greatest(F.lit(1), n + o - 2 * m + 1))).cast("int")

    grams = lambda text, size: F.when(size <= F.length(text), F.array_distinct(F.transform(_upto(F.greatest(F.lit(1), F.length(text) - size + 1)), lambda i: F.substr(text, i, size))))
    cut = lambda rows, word, length, other: rows.withColumn(other, F.explode(near(F.col(length)))).withColumn("gram", F.explode(grams(F.col(word), block(F.col("n"), F.col("o")))))
    if two.count() <= few:
        pairs = one.join(F.broadcast(two), close).select("word", "other")
    else:  # the sizes of substrings are not foreseen: neither side is to be broadcast by a guess
        pairs = cut(one, "word", "n", "o").hint("merge").join(cut(two, "other", "o", "n"), ["n", "o", "gram"]).filter(close).select("word", "other").distinct()
    # the loop is dear, and pairs are few bytes: a filter for its outcome would be made part of the join, and run for each
    # substring, and without a number of tasks one would take all pairs
    tasks = 2 * left.sparkSession.sparkContext.defaultParallelism
    pairs = checkpointed(pairs.repartition(tasks, "word", "other")).filter(_possible(F.col("word"), F.col("other"), cutoff))
    return pairs.withColumn("ratio", ratio(F.col("word"), F.col("other"))).filter(F.col("ratio") >= cutoff)
