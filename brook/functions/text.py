"""String helpers used by the feed parsers and the clean step."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tag pattern replaced by one space, and the separator of the
# stable id (ASCII unit separator 0x1f); the id is the first 16 hex digits of
# SHA-1 over the parts joined by it, a NULL part counting as ''.
HTML_TAG = r"<[^>]+>"
ID_SEPARATOR = "\x1f"
ID_HEX_DIGITS = 16


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_html(col) -> Column:
    """Each tag becomes one space; NULL stays NULL."""
    return F.regexp_replace(as_col(col), HTML_TAG, " ")


def stable_id(*cols) -> Column:
    parts = [F.coalesce(as_col(c).cast("string"), F.lit("")) for c in cols]
    return F.substring(F.sha1(F.concat_ws(ID_SEPARATOR, *parts).cast("binary")), 1, ID_HEX_DIGITS)


def blank_to_null(col) -> Column:
    """Trim (spaces) and turn an empty result into NULL."""
    return F.nullif(F.trim(as_col(col)), F.lit(""))


def normalise_key(name: str) -> str:
    """Header names are matched lower-cased and stripped."""
    return (name or "").strip().lower()
