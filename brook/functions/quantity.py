"""Resource quantities ("500m", "2Gi", "1G") as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brook.functions.text import as_col

# Quantity suffixes and their multipliers (binary and decimal SI).
SUFFIX_FACTORS = {
    "": "1", "n": "0.000000001", "u": "0.000001", "m": "0.001",
    "k": "1000", "M": "1000000", "G": "1000000000", "T": "1000000000000", "P": "1000000000000000", "E": "1000000000000000000",
    "Ki": "1024", "Mi": "1048576", "Gi": "1073741824", "Ti": "1099511627776", "Pi": "1125899906842624",
    "Ei": "1152921504606846976",
}
QUANTITY = r"^\s*([+-]?[0-9]+(?:\.[0-9]*)?|[+-]?\.[0-9]+)([eE][+-]?[0-9]+|[a-zA-Z]*)\s*$"
MI = 1048576
GI = 1073741824


def quantity_value(col) -> Column:
    """Decimal value of a quantity; NULL when it does not parse."""
    c = as_col(col)
    num = F.regexp_extract(c, QUANTITY, 1)
    suf = F.regexp_extract(c, QUANTITY, 2)
    factors = F.create_map(*[x for k, v in SUFFIX_FACTORS.items() for x in (F.lit(k), F.lit(v))])
    # "1e3" is an exponent, "1E" the suffix.
    factor = F.when(suf.rlike("[0-9]"), F.concat(F.lit("1"), suf).try_cast("decimal(38,9)")) \
        .otherwise(F.try_element_at(factors, suf).cast("decimal(38,9)"))
    ok = c.rlike(QUANTITY) & factor.isNotNull()
    return F.when(ok, F.try_multiply(num.cast("decimal(38,9)"), factor))


def millicores(col) -> Column:
    """Milli-units rounded up, as a quantity's MilliValue."""
    return F.ceil(quantity_value(col) * 1000).cast("bigint")


def byte_value(col) -> Column:
    return F.ceil(quantity_value(col)).cast("bigint")


def whole_cores(col) -> Column:
    """Spark wants whole cores >= 1: millicores rounded up to a core."""
    return F.greatest(F.floor((millicores(col) + 999) / 1000), F.lit(1)).cast("bigint")


def spark_memory(col) -> Column:
    """"Ng" when a whole number of GiB, else "Nm" (MiB, rounded down)."""
    b = byte_value(col)
    return F.when(b % GI == 0, F.concat((b / GI).cast("bigint").cast("string"), F.lit("g"))) \
            .otherwise(F.concat(F.floor(b / MI).cast("bigint").cast("string"), F.lit("m")))
