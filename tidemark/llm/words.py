"""Words and white space as every operator of this package reads them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: A white-space run that is not already one blank; replacing only these gives the same text.
_ODD_SPACE = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def squeezed(col: Column) -> Column:
    """Each run of white space as one blank; null counts as empty."""
    return F.regexp_replace(text_or_empty(col), _ODD_SPACE, " ")


def n_words(col: Column) -> Column:
    return F.regexp_count(text_or_empty(col), F.lit(WORD)).cast("long")
