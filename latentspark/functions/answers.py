"""Column expressions that read survey answers; all stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n\u00a0"

# The accepted spellings of gender, after lower case and without outer blanks.
GENDERS = {"female": "female", "f": "female", "male": "male", "m": "male", "diverse": "diverse", "d": "diverse"}


def gender(c: Column) -> Column:
    """'female', 'male', 'diverse', or NULL for anything that is no answer."""
    word = F.lower(F.trim(c.cast("string"), F.lit(BLANKS)))
    out = F.when(word.isin("female", "f"), "female").when(word.isin("male", "m"), "male")
    return out.when(word.isin("diverse", "d"), "diverse")


def on_scale(c: Column, low: int, high: int) -> Column:
    """The number if it lies on the scale, else NULL (NULL stays NULL)."""
    return F.when(c.between(low, high), c)


def finite(c: Column) -> Column:
    """The double, with NaN and infinities read as NULL."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)
