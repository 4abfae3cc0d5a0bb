"""Text functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logscan.model import UNITS

# What the short encoding writes, without closing semicolons.
SHORT_ENTITIES = {"&": "&amp", "<": "&lt", ">": "&gt", '"': "&quot"}


def _replaced(text: Column, by: dict[str, str]) -> Column:
    for a, b in by.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def html_encode(text: Column) -> Column:
    return _replaced(text, SHORT_ENTITIES)


def html_escape(text: Column) -> Column:
    """For report tables: only the brackets."""
    return _replaced(text, {"<": "&lt;", ">": "&gt;"})


def url_decode(text: Column) -> Column:
    """%XX decoded; a plus stays."""
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def duration_seconds(text: Column) -> Column:
    """Seconds of a duration such as 5m; null for other texts."""
    unit = F.regexp_extract(text, r"^(\d+)([smhd]?)$", 2)
    factor = F.lit(1)
    for u, n in UNITS.items():
        factor = F.when(unit == u, n).otherwise(factor)
    return F.nullif(F.regexp_extract(text, r"^(\d+)([smhd]?)$", 1), F.lit("")).cast("long") * factor


def squeeze(text: Column) -> Column:
    """Line feeds become blanks, carriage returns go, trailing blanks too."""
    return F.rtrim(F.translate(text, "\n\r", " "))
