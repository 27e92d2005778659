"""Danish or English by function words; anything unsure is the default, as the question generator expects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeloom.functions import text as T

# Function words.
DANISH = "og i at det er en til af på som med den for de ikke der et har kan fra hvis eller når bliver efter hos din dit skal".split()
ENGLISH = "the of and to in is that for it as was with be by on not are this have from or an they which you".split()
# End of fixed values.


def votes(text: Column, words: list[str]) -> Column:
    known = F.array(*map(F.lit, words))
    return F.size(F.filter(T.tokens(text), lambda w: F.array_contains(known, w)))


def detected(text: Column, default: str = "da") -> Column:
    """`da` or `en`, whichever has more function words; the default for a tie, a blank or a null text."""
    lead = F.array(votes(text, DANISH) - votes(text, ENGLISH))  # bound by a lambda, so that it is worked out once
    return F.get(F.transform(lead, lambda d: F.when(d > 0, "da").when(d < 0, "en").otherwise(default)), F.lit(0))
