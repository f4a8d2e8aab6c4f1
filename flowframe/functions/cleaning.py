"""Column expressions for missing values, numbers in strings, scaling and text states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endpoint texts that mean none.
NO_ENDPOINT = ("nan", "none", "<na>")
#: The characters that count as white space.
WHITE = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
DAY_FIRST = "dd/MM/yyyy HH:mm:ss"
#: States, and the words that tell them, first match wins.
STATES = (
    ("running", ("running",)),
    ("queued", ("queued", "pending")),
    ("complete", ("complete",)),
    ("cancelled", ("cancelled", "canceled")),
    ("error", ("error", "failed", "failure")),
)


def finite(c: Column) -> Column:
    """The value, or null for NaN and infinities."""
    d = c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def is_infinite(c: Column) -> Column:
    return F.abs(c.cast("double")) == float("inf")


def number(c: Column) -> Column:
    """A finite double, or null where the text is none."""
    return finite(c.try_cast("double"))


def unparsable(c: Column) -> Column:
    return c.isNotNull() & c.try_cast("double").isNull()


def day_first(c: Column) -> Column:
    """A timestamp from day-first text; null where it does not parse."""
    return F.try_to_timestamp(c, F.lit(DAY_FIRST))


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(WHITE))


def valid_endpoint(c: Column) -> Column:
    trimmed = stripped(c)
    return F.coalesce((trimmed != "") & ~F.lower(trimmed).isin(*NO_ENDPOINT), F.lit(False))


def min_max(c: Column, low: Column, high: Column, to_low: float = 0.0, to_high: float = 1.0, clip: bool = False) -> Column:
    """Linear scaling of [low, high]; a constant goes to ``to_low``."""
    scale = F.when(high == low, F.lit(to_high - to_low)).otherwise(F.lit(to_high - to_low) / F.nullif(high - low, F.lit(0.0)))
    scaled = c * scale + (F.lit(to_low) - low * scale)
    return F.least(F.greatest(scaled, F.lit(to_low)), F.lit(to_high)) if clip else scaled


def state_of(text: Column) -> Column:
    lower, out = F.lower(text), F
    for state, words in STATES:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(lower, F.lit(w))
        out = out.when(hit, state)
    return out.otherwise("unknown")
