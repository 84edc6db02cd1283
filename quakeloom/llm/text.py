"""Column expressions for words, shared by the operators without Python workers."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Between words of lower-cased text: all of ASCII but a-z and 0-9.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same, and words, in text as it stands.
BETWEEN_CASED = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD_CASED = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Characters beyond A-Z that may have a lower-case form: capitals up to U+07FF, and
#: all above, as the two libraries behind these expressions differ in their newest letters.
CASED = r"[\x{800}-\x{10FFFF}[\p{Lu}\p{Lt}&&[^A-Z]]]"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; ``lower`` does so in one pass unless other capitals occur."""
    return F.when(text.rlike(CASED), F.translate(text, ascii_uppercase, ascii_lowercase)).otherwise(F.lower(text))


def word_list(text: Column) -> Column:
    """All lower-cased words in order; null has none."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), BETWEEN), ""), F.array().cast("array<string>"))
