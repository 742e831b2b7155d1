"""Pieces shared by the corpus operators: text expressions, and the tables of the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.sources.shared import Saved
from orrery.sources.tables import table

__all__ = ["LOWER", "SPACE", "SPACE_CHARS", "UPPER", "Saved", "ascii_lower", "integral_id", "nested", "table", "unnested"]

#: The ASCII white space of the contracts, as a Java/Python regular expression class.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def nested(docs: DataFrame) -> Column:
    """All columns but ``text`` in one struct ``row``, so that no name of an operator's own can clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"] or [F.lit(0).alias("none")]).alias("row")


def unnested(names: list[str], text: Column, **changed: Column) -> list[Column]:
    """The columns ``names`` out of ``row``, with this text and these columns in place of the old ones."""
    new = {"text": text, **changed}
    return [(new[c] if c in new else F.col("row")[c]).alias(c) for c in names]


def integral_id(docs: DataFrame, name: str = "doc_id") -> DataFrame:
    """``docs``, if its ids are whole numbers; others would silently link with nothing."""
    if (kind := docs.schema[name].dataType.simpleString()) not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{name} is {kind}, not a whole number")
    return docs
