"""From tokens to pages: lines, the page's text, anchors, and label/value pairs.

A page is one row.  Its lines are an array in geometric order (top to bottom,
then left to right); its text has the tokens in the order of recognition.  All
grouping is by (doc_id, page_no): the window and the aggregation share one
shuffle, and a group holds the tokens of one page.

Contract: a token without a box or text is left out.  A page's tokens with the
same place keep the order of ``tok_idx``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vetloom.functions.similarity import near_keywords
from vetloom.functions.text import has_any

#: Tokens whose tops differ by less than this from the token before are on its line.
LINE_GAP = 10.0
PAGE = ["doc_id", "page_no"]
#: What marks a tax number's label (fixed values).
GSTIN_LABELS = ("GSTIN", "GSTIN/UIN", "GST NUMBER")


def bounds(box: Column) -> Column:
    """The box's extent and centre."""
    xs, ys = F.transform(box, lambda p: p["x"]), F.transform(box, lambda p: p["y"])
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / 4
    return F.struct(F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"), mean(xs).alias("xc"), mean(ys).alias("yc"))


def right_of(label: Column, value: Column) -> Column:
    return (value["x0"] > label["x1"]) & value["yc"].between(label["y0"] - 10, label["y1"] + 10)


def below(label: Column, value: Column) -> Column:
    near = (value["y0"] > label["y1"]) & (value["y0"] <= label["y1"] + 100)
    return near & value["xc"].between(label["x0"] - 20, label["x1"] + 100)


def cleaned(text: Column) -> Column:
    """Upper-case letters and digits only."""
    return F.regexp_replace(F.upper(text), "[^A-Z0-9]", "")


def has_place() -> Column:
    """Whether a token counts: it has a page, a text and a box."""
    return F.col("page_no").isNotNull() & F.col("text").isNotNull() & (F.size("box") > 0)


def placed(tokens: DataFrame) -> DataFrame:
    """The tokens with their corner and the number of their line (from 0)."""
    corner = F.get("box", F.lit(0))
    rows = tokens.filter(has_place()).select(*PAGE, "tok_idx", "box", "text", "conf", corner["x"].alias("x"), corner["y"].alias("y"))
    order = Window.partitionBy(*PAGE).orderBy("y", "x", "tok_idx")
    jump = F.coalesce((F.abs(F.col("y") - F.lag("y").over(order)) >= LINE_GAP).cast("int"), F.lit(0))
    flagged = rows.withColumn("_jump", jump)
    return flagged.withColumn("line_no", F.sum("_jump").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_jump")


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)


def _merged(parts: Column) -> Column:
    return F.struct(F.array_join(parts["text"], " ").alias("text"), _mean(parts["conf"]).alias("confidence"), F.get(parts["box"], F.lit(0)).alias("box"))


def _by_line(tokens: DataFrame) -> DataFrame:
    """A row for each line with its tokens from left to right.  Lines lie where their page does, so this needs no shuffle of its own."""
    parts = F.array_sort(F.collect_list(F.struct("x", "y", "tok_idx", "text", "conf", "box")))
    return placed(tokens).groupBy(*PAGE, "line_no").agg(parts.alias("_parts"))


def lines(tokens: DataFrame) -> DataFrame:
    """A row for each line: text, confidence (the mean) and the leftmost token's box."""
    return _by_line(tokens).select(*PAGE, "line_no", _merged(F.col("_parts")).alias("_line")).select(*PAGE, "line_no", "_line.*")


def pages(tokens: DataFrame) -> DataFrame:
    """A row for each page: ``text``, ``tokens`` and ``lines``."""
    rows = _by_line(tokens).select(*PAGE, "line_no", _merged(F.col("_parts")).alias("_line"), "_parts").groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("line_no", "_line", "_parts"))).alias("_lines"))
    recognised = F.array_sort(F.transform(F.flatten("_lines._parts"), lambda t: F.struct(t["tok_idx"].alias("tok_idx"), t["text"].alias("text"), t["conf"].alias("conf"), t["box"].alias("box"))))
    return rows.select(*PAGE, recognised.alias("tokens"), F.col("_lines._line").alias("lines")).withColumn("text", F.array_join(F.col("tokens.text"), "\n"))


def marked(pages_: DataFrame, keywords: list[str], fuzzy: bool = True) -> DataFrame:
    """Adds ``marks``: for each line, the keywords that occur in it or, if fuzzy, that a word of it is similar to."""
    words = F.array(*[F.lit(k) for k in keywords])
    upper = F.transform("lines", lambda line: F.upper(line["text"]))  # once for a line, not for each keyword
    inside = F.transform(upper, lambda text: F.filter(words, lambda k: F.contains(text, k)))
    if not fuzzy:
        return pages_.withColumn("marks", inside)
    near = pages_.withColumn("_near", near_keywords(keywords)(F.col("lines.text")))
    return near.withColumn("marks", F.zip_with(inside, "_near", lambda a, b: F.array_union(a, b))).drop("_near")


def anchors(*sets: list[str]) -> Column:
    """For each set of keywords, the number (from 0) of the first line with all of them, null if there is none.

    This is one expression over all sets: a struct of them would be taken
    apart by the optimizer and repeated wherever a rule uses an anchor.
    """
    wanted = F.array(*[F.array(*[F.lit(k) for k in some]) for some in sets])
    first = lambda some: F.array_position(F.transform("marks", lambda m: F.size(F.array_intersect(m, some)) == F.size(some)), F.lit(True))
    return F.transform(wanted, lambda some: F.nullif(first(some), F.lit(0)).cast("int") - 1)


def label_value_pairs(tokens: DataFrame, labels: tuple[str, ...] = GSTIN_LABELS, least: int = 14) -> DataFrame:
    """Each label token with each long token right of it or below it on its page, by an equi-join on the page."""
    rows = tokens.select(*PAGE, "tok_idx", "text", "conf", bounds(F.col("box")).alias("b"))
    label = rows.filter(has_any(F.upper("text"), labels)).select(*PAGE, F.col("tok_idx").alias("label_idx"), F.col("b").alias("l"))
    value = rows.withColumn("clean", cleaned(F.col("text"))).filter(F.length("clean") >= least).select(*PAGE, F.col("tok_idx").alias("value_idx"), "clean", "conf", "b")
    both = label.join(value, PAGE).filter("label_idx <> value_idx")
    right, under = right_of(F.col("l"), F.col("b")), below(F.col("l"), F.col("b"))
    return both.filter(right | under).select(*PAGE, "label_idx", "value_idx", F.when(right, "right").otherwise("below").alias("relation"), "clean", "conf")
