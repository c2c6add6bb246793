"""Scalar and aggregate expression builders.

All helpers return ``pyspark.sql.Column`` objects made of built-in functions,
so they stay inside whole-stage code generation.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must equal the analysis being reproduced, do not edit.
# Raw column names dropped before header normalisation (absent ones ignored).
DROPPED_RAW_COLUMNS = (
    "Unnamed: 22",
    "promotion-ids",
    "Courier Status",
    "ship-city",
    "ship-postal-code",
    "ship-country",
)
# Order statuses (compared after lower-casing, without trimming) that count as a completed sale.
COMPLETED_STATUSES = ("shipped", "shipped - delivered to buyer")
# Elasticity classes: right-closed bins (-inf, -1], (-1, 0], (0, inf).
ELASTICITY_EDGES = (-1.0, 0.0)
ELASTICITY_LABELS = ("Elastic", "Inelastic", "Positive Elasticity")
# ---------------------------------------------------------------------------

# Text that a numeric coercion accepts (case-insensitive); anything else is missing, whatever a cast would make of it.
NUMBER_PATTERN = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf(inity)?|nan)\s*$"
# Dates: month and day (or day and month) before the year, or the year first; an optional time after a blank or T.
# The last alternative takes any other text, so that every text is one match and its parts come from one pass.
DATE_PATTERN = (r"(?s)^(?:\s*(?:(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})|(\d{4})[-/.](\d{1,2})[-/.](\d{1,2}))"
                r"(?:[ T]+(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d{1,6})?)\d*)?)?\s*$|.*)")
# Two-digit years from here on belong to the 20th century.
TWO_DIGIT_PIVOT = 69

# Exact sums: 29 digits before the point and nine behind it, so that prices from quantities such as 32 keep all their digits.
EXACT = T.DecimalType(38, 9)

# Every character Python's str.strip() removes (derived from str.isspace, not listed by hand).
WHITESPACE = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace())


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_name(name: str) -> str:
    """Header normalisation: strip, lower-case, blanks and hyphens to underscores."""
    return name.strip().lower().replace(" ", "_").replace("-", "_")


def nan_to_null(c: str | Column) -> Column:
    """NaN is a value in Spark but 'missing' in the source semantics: map it to NULL."""
    x = _col(c)
    return F.when(~F.isnan(x), x)


def lenient_double(c: str | Column, dtype: T.DataType | None = None) -> Column:
    """Numeric coercion where failures become NULL (never an error under ANSI mode)."""
    x = _col(c)
    if isinstance(dtype, T.DoubleType):
        return nan_to_null(x)
    if dtype is None or isinstance(dtype, T.StringType):
        x = F.when(x.cast("string").rlike(NUMBER_PATTERN), F.trim(x.cast("string")))
    # NaN to NULL with the parsed text named once: an expression named twice is parsed twice in a filter
    return F.nanvl(x.try_cast("double"), F.lit(None).cast("double"))


def _text_timestamp(x: Column) -> Column:
    # one match cuts the text into its parts; the one-element array has them cut once, however often they are named
    parts = F.split(F.regexp_replace(x, DATE_PATTERN, ",".join(f"${k}" for k in range(1, 10)) + ","), ",")
    return F.element_at(F.transform(F.array(parts), _timestamp_of), 1)


def _timestamp_of(parts: Column) -> Column:
    def part(k: int, dtype: str) -> Column:
        # an absent part is empty text; casting that would build and drop an exception for each row
        text = F.get(parts, F.lit(k - 1))
        return F.when(text != "", text.try_cast(dtype))

    time = [F.coalesce(part(7, "int"), F.lit(0)), F.coalesce(part(8, "int"), F.lit(0)), F.coalesce(part(9, "decimal(16,6)"), F.lit(0).cast("decimal(16,6)"))]
    one, two, year = part(1, "int"), part(2, "int"), part(3, "int")
    short = F.length(F.get(parts, F.lit(2))) == 2
    year = year + F.when(short, F.when(year >= TWO_DIGIT_PIVOT, 1900).otherwise(2000)).otherwise(0)
    month_first = F.when(one <= 12, F.try_make_timestamp_ntz(year, one, two, *time))
    day_first = F.when(two <= 12, F.try_make_timestamp_ntz(year, two, one, *time))
    iso = F.when(part(4, "int").isNotNull(), F.try_make_timestamp_ntz(*(part(k, "int") for k in (4, 5, 6)), *time))
    return F.coalesce(month_first, day_first, iso)


def lenient_timestamp(c: str | Column, dtype: T.DataType | None = None, formats: Sequence[str] = ()) -> Column:
    """Date coercion where unparsable text becomes NULL.

    Text with the year last is read month first, or day first where that is no date; two-digit
    years are 1969 to 2068; the year may come first; a time may follow.  ``formats`` are tried before.
    The result is a wall-clock TIMESTAMP_NTZ, so calendar parts do not depend on the session zone.
    Existing timestamp / date columns are only re-typed.
    """
    x = _col(c)
    if isinstance(dtype, T.TimestampNTZType):
        return x
    if isinstance(dtype, (T.TimestampType, T.DateType)):
        return x.cast("timestamp_ntz")
    given = [F.try_to_timestamp(x, F.lit(fmt)).cast("timestamp_ntz") for fmt in formats]
    return F.coalesce(*given, _text_timestamp(x.cast("string")))


def strip_lower(c: str | Column) -> Column:
    """``str.strip().str.lower()``: trims every kind of edge white space, not only blanks."""
    return F.lower(F.btrim(_col(c), F.lit(WHITESPACE)))


def calendar_columns(date: str | Column) -> dict[str, Column]:
    """Calendar parts of a date: calendar year/month/day, full English day name, ISO week."""
    d = _col(date)
    return {
        "year": F.year(d),
        "month": F.month(d),
        "day": F.dayofmonth(d),
        "weekday": F.date_format(d, "EEEE"),
        "weekofyear": F.weekofyear(d),
    }


def snap_zero(c: str | Column, eps: float = 1e-12) -> Column:
    """Treat |x| < eps as exactly 0 so solver noise cannot flip a class at the 0 edge."""
    x = _col(c)
    return F.when(F.abs(x) < F.lit(eps), F.lit(0.0)).otherwise(x)


def bin_label(c: str | Column, edges: Sequence[float] = ELASTICITY_EDGES,
              labels: Sequence[str] = ELASTICITY_LABELS) -> Column:
    """Right-closed binning ``(-inf, e0], (e0, e1], ..., (e_last, inf)``; NULL/NaN stay NULL."""
    if len(labels) != len(edges) + 1:
        raise ValueError("need exactly one more label than edges")
    x = _col(c)
    out = F.when(x.isNull() | F.isnan(x), F.lit(None).cast("string"))
    for edge, label in zip(edges, labels):
        out = out.when(x <= F.lit(float(edge)), F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def pct_change(new: str | Column, base: str | Column) -> Column:
    """``(new - base) / base * 100``; NULL when the base is 0."""
    return F.try_divide(_col(new) - _col(base), _col(base)) * F.lit(100)


def exact_total(c: str | Column) -> Column:
    """Decimal sum that raises where a value or the total does not fit, in every ANSI setting."""
    x = _col(c)
    exact = x.cast(EXACT)
    total = F.sum(exact)
    lost = (F.count(exact) != F.count(x)) | (total.isNull() & (F.count(x) > 0))
    return F.when(lost, F.raise_error(F.lit("a value or a sum is outside DECIMAL(38,9)")).cast(EXACT)).otherwise(total)


def exact_sum(c: str | Column) -> Column:
    """Sum of values rounded to nine decimals, added exactly as DECIMAL(38,9).

    Unlike a floating-point sum, the result does not depend on the order rows
    arrive in, so it is identical across partitionings, retries and engines.
    Values or totals beyond 29 digits before the point raise; nothing is clamped.
    """
    return exact_total(_col(c)).cast("double")


def exact_mean(c: str | Column) -> Column:
    """Mean of values rounded to nine decimals, summed exactly (see :func:`exact_sum`)."""
    x = _col(c)
    return F.try_divide(exact_total(x).cast("double"), F.count(x).cast("double"))
