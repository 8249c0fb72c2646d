"""Confidence of a find, from the recogniser's and the pattern's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def exact(recognised: Column | float) -> Column:
    """For a strict match: three fifths pattern, at least 0.9."""
    c = F.lit(recognised) if isinstance(recognised, float) else recognised
    return F.greatest(F.lit(0.6) * F.lit(0.98) + F.lit(0.4) * c, F.lit(0.9))


def repaired(recognised: Column | float) -> Column:
    """For a repaired match: half pattern, at least 0.91, which is more than a poor exact one gets."""
    c = F.lit(recognised) if isinstance(recognised, float) else recognised
    return F.greatest(F.lit(0.5) * F.lit(0.85) + F.lit(0.5) * c, F.lit(0.91))


def hit(value: Column, confidence: Column | float) -> Column:
    """A field, null if there is no value."""
    c = F.lit(confidence) if isinstance(confidence, float) else confidence
    return let(value, lambda v: F.when(v.isNotNull(), F.struct(v.alias("value"), c.cast("double").alias("confidence"))))
