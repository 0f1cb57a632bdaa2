"""Column-level functions: every one returns a built-in Spark expression, so it
stays inside whole-stage codegen and runs JVM-side."""

from brook.functions.dates import parse_date
from brook.functions.text import normalise_key, stable_id, strip_html, blank_to_null

__all__ = ["parse_date", "stable_id", "strip_html", "normalise_key", "blank_to_null"]
