"""Words and row identities shared by the operators on documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Everything that is neither an ASCII letter or digit nor beyond ASCII parts two words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` also turns other scripts' capitals; texts in which it would do so
    take the slower ``translate``.
    """
    beyond = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    return F.when(F.lower(beyond) == beyond, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def alnum_words(text: Column) -> Column:
    """Words of ASCII letters, digits and anything beyond ASCII, A-Z lower-cased;
    an empty array for null."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS)
    return F.array_remove(parts, "")


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (long) and the text (string), whatever else the table holds."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                     F.col(f"`{text_col}`").cast("string").alias("text"))
