"""Multi-format date parsing without the legacy parser and with ANSI on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brook.functions.text import as_col

# The five textual date forms the feeds deliver, in the order
# they are tried.  1 ISO date "yyyy-MM-dd"; 2 ISO timestamp with offset;
# 3 ISO timestamp with a literal Z; 4 RFC-822 "EEE, dd MMM yyyy HH:mm:ss Z";
# 5 year only "yyyy".
RFC822_PATTERN = "d MMM yyyy HH:mm:ss Z"
ISO_DATE_PREFIX = r"^\s*(\d{4}-\d{1,2}-\d{1,2})"
RFC822_WEEKDAY = r"^\s*[A-Za-z]{3},\s*"
RFC822_ZONE_NAMES = r"\s+(GMT|UTC|UT|Z)\s*$"
# The North American zone names of RFC 822 and their offsets.
RFC822_ZONES = {"EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500",
                "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}
YEAR_ONLY = r"^\d{4}$"


def parse_date(col) -> Column:
    """First matching form wins; a value matching none gives NULL (never an error).

    * ISO forms: the calendar date written in the string (a timestamp with an
      offset keeps its *local* date, as a prefix parse does).
    * RFC-822, with an offset or a zone name: the instant is converted to the session zone (UTC) first, so
      ``Fri, 05 Jun 2026 23:30:00 -0500`` gives 2026-06-06.  The weekday is
      not checked.
    * year only: 1 January of that year.
    """
    v = as_col(col)
    iso = F.regexp_extract(v, ISO_DATE_PREFIX, 1)
    iso_date = F.try_to_timestamp(F.nullif(iso, F.lit("")), F.lit("yyyy-M-d")).cast("date")
    rfc_text = F.regexp_replace(F.regexp_replace(v, RFC822_WEEKDAY, ""), RFC822_ZONE_NAMES, " +0000")
    name = F.regexp_extract(rfc_text, r"\s([A-Z]{3})\s*$", 1)
    offset = F.try_element_at(F.create_map(*[F.lit(x) for kv in RFC822_ZONES.items() for x in kv]), name)
    rfc_text = F.when(offset.isNotNull(), F.concat(F.regexp_replace(rfc_text, r"[A-Z]{3}\s*$", ""), offset)).otherwise(rfc_text)
    rfc_date = F.try_to_timestamp(F.trim(rfc_text), F.lit(RFC822_PATTERN)).cast("date")
    year_date = F.when(F.trim(v).rlike(YEAR_ONLY),
                       F.try_to_timestamp(F.trim(v), F.lit("yyyy")).cast("date"))
    return F.coalesce(iso_date, rfc_date, year_date)
