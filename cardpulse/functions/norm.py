"""Column-level cleaning expressions (all JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numbers the reference's coercing parser accepts: optional sign, digits with an
# optional fraction (or a bare fraction) and an optional exponent.  Spark alone
# would also accept Java suffixes such as "1.0d" which the reference rejects.
NUMERIC_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

# Text the reference's CSV reader turns into a missing value.
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
               "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
               "n/a", "nan", "null"]

# A date column has one declared format; this one unless another is declared.
ISO_DATE = "yyyy-MM-dd"
ISO_TIMESTAMPS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd"]

EXCEL_EPOCH = "1899-12-30 00:00:00"  # day 0 of spreadsheet serial dates
EXCEL_SERIAL_LIMIT = 132321  # first serial past the reference's datetime range


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Characters a text strip removes at both ends: ASCII blanks and controls, the
# Unicode white space (no-break space, ideographic space, ...).
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
              "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(c) -> Column:
    """Remove leading/trailing white space including tabs and no-break spaces
    (native ``btrim`` over the white-space set, no regular expression)."""
    return F.btrim(_c(c), F.lit(WHITESPACE))


def null_tokens(c) -> Column:
    """Map the CSV null markers to SQL null (exact text: blanks alone are text)."""
    col = _c(c)
    return F.when(col.isin(NULL_TOKENS), F.lit(None)).otherwise(col)


def norm_code(c) -> Column:
    """Flag/status code: trimmed and upper case; null stays null."""
    return F.upper(strip(c))


def norm_id(c) -> Column:
    """Canonical text id: trimmed, thousands separators dropped, leading zeros and a
    trailing ``.0`` removed from all-digit ids, blank -> null."""
    x = F.translate(strip(F.col(c).cast("string") if isinstance(c, str) else c.cast("string")), ",", "")
    return once(x, _canonical_id)


def once(x: Column, make) -> Column:
    """``make(x)`` with ``x`` worked out once a row, however often ``make`` names it.  A filter on a column made by nested
    ``when``s works out each mention by itself, and every level doubles them."""
    return F.get(F.transform(F.array(x), make), 0)


def _canonical_id(x: Column) -> Column:
    # the regular expressions only run on the rare ids that need them
    x = F.when(F.instr(x, ".") > 0, F.regexp_replace(x, r"^(\d+)\.0+$", "$1")).otherwise(x)
    x = F.when(F.startswith(x, F.lit("0")), F.regexp_replace(x, r"^0+(\d)", "$1")).otherwise(x)
    return F.nullif(x, F.lit(""))


def numeric_id(c) -> Column:
    """An id that is all digits, else null: surrogate numbering and transaction mapping know
    numeric ids only."""
    return once(_c(c), lambda x: F.when(x.rlike(r"^\d+$"), x))


def try_double(c) -> Column:
    """Strip, drop commas, accept plain decimal/exponent numbers only, else null."""
    x = F.translate(strip(_c(c).cast("string")), ",", "")
    return F.when(x.rlike(NUMERIC_PATTERN), x.try_cast("double"))


def try_long(c) -> Column:
    """Integer parse through double: ``"12.0"`` -> 12, ``"12.5"`` -> null."""
    d = try_double(c)
    return F.when(d == F.floor(d), d.try_cast("bigint"))


def parse_int(c) -> Column:
    """Trim, drop commas and a trailing ``.00``; integer text only, else null."""
    x = F.translate(strip(_c(c).cast("string")), ",", "")
    x = F.when(F.endswith(x, F.lit(".00")), F.regexp_replace(x, r"\.00$", "")).otherwise(x)
    return F.when(x.rlike(r"^\s*[+-]?\d+\s*$"), x.try_cast("bigint"))


def parse_float(c) -> Column:
    return try_double(c)


_SHAPES = {"yyyy": "[0-9]{4}", "MMM": "[A-Za-z]{3}", "MM": "[0-9]{2}", "dd": "[0-9]{2}", "HH": "[0-9]{2}", "mm": "[0-9]{2}", "ss": "[0-9]{2}"}


def shape_of(fmt: str) -> str | None:
    """A pattern of all texts that the date format can take, for formats of fixed-width fields; None for others."""
    out = ""
    for quoted, field, mark in re.findall(r"'([^']*)'|([A-Za-z]+)|([^A-Za-z'])", fmt):
        if field and field not in _SHAPES:
            return None
        out += re.escape(quoted) if quoted else _SHAPES[field] if field else re.escape(mark)
    return f"^{out}$"


def read_as(x: Column, fmt: str) -> Column:
    """Text as a timestamp of one format, else null.  Texts of another shape are turned away by a pattern, which
    costs far less than a parser that fails."""
    shape, parsed = shape_of(fmt), F.try_to_timestamp(x, F.lit(fmt))
    return parsed if shape is None else F.when(x.rlike(shape), parsed)


def parse_date(c, formats: list[str] | None = None) -> Column:
    """Text in one of the declared ``formats`` (ISO unless given) -> date; anything else -> null."""
    x = strip(_c(c).cast("string"))
    return F.coalesce(*[read_as(x, f).cast("date") for f in (formats or [ISO_DATE])])


def parse_timestamp(c, formats: list[str] | None = None) -> Column:
    """As ``parse_date``, with the time of day."""
    x = strip(_c(c).cast("string"))
    return F.coalesce(*[read_as(x, f) for f in (formats or ISO_TIMESTAMPS)]).cast("timestamp_ntz")


def excel_serial_to_timestamp(c) -> Column:
    """Spreadsheet serial day number (origin 1899-12-30, fractions kept) -> timestamp.
    Negative, non-numeric or out-of-range serials -> null."""
    d = try_double(c)
    ok = (d >= 0) & (d < EXCEL_SERIAL_LIMIT)
    micros = F.round(d * F.lit(86400 * 1_000_000)).cast("bigint")
    # timestamp_ntz arithmetic: independent of the session time zone
    return F.when(ok, F.timestamp_add("MICROSECOND", micros, F.lit(EXCEL_EPOCH).cast("timestamp_ntz")))


def days_between(later, earlier) -> Column:
    """Whole days (floor) between two dates/timestamps, on time-zone-free timestamps."""
    a, b = _c(later).cast("timestamp_ntz"), _c(earlier).cast("timestamp_ntz")
    return F.floor(F.timestamp_diff("MICROSECOND", b, a) / F.lit(86_400_000_000)).cast("bigint")
