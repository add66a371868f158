"""Text functions as Spark columns."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII tokens, the form that SQL oracles can repeat; and Unicode words with underscores.
ASCII_TOKEN, WORD_TOKEN = "[a-z0-9]+", r"(?U)[\w]+"


def tokens(text: Column, pattern: str = WORD_TOKEN) -> Column:
    """Lower-cased tokens of a text; null gives an empty list."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends (Spark's trim takes spaces only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def count_of(text: Column, piece: str) -> Column:
    """How often a one-character piece stands in a text."""
    return F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))


def decode_text(content: Column) -> Column:
    """Bytes as UTF-8, undecodable ones dropped (Spark's own casts raise or substitute)."""

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))

    return F.pandas_udf(each, "string")(content)


def slug(text: str | None) -> str:
    """Anchor form of a heading: no accents, lower case, hyphens between words."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c))
    words = re.sub(r"[\s_]+", "-", bare.lower())
    return re.sub("-{2,}", "-", re.sub("[^a-z0-9-]", "", words)).strip("-")


def slugify(text: Column) -> Column:
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(slug)

    return F.pandas_udf(each, "string")(text)
