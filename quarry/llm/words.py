"""Words as the SQL contracts define them: runs of anything but ASCII white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text, as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """The first n words of a text, joined by single spaces."""
    parts = F.filter(F.split(text, SPACE), lambda w: w != "")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(n, F.lit(0)).cast("int")), " ")
