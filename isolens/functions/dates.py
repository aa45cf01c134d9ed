"""Years and periods out of free-text dates."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_text, col

# Date layouts tried in this order after separators are unified.
DATE_FORMATS = (
    "yyyyMMdd", "yyyy-M-d", "yyyy/M/d",
    "MMddyyyy", "M/d/yyyy", "M-d-yyyy",
    "ddMMyyyy", "d/M/yyyy", "d-M-yyyy",
    "MMM d yyyy", "d MMM yyyy", "MMMM d yyyy", "d MMMM yyyy",
    "yyyy MMM d", "yyyy MMMM d", "MMM yyyy", "MMMM yyyy", "yyyy MMM", "yyyy MMMM", "yyyy",
)
# Five-year bins by upper bound.
FIVE_YEAR_BINS = ((2000, "<=2000"), (2005, "2001-2005"), (2010, "2006-2010"),
                  (2015, "2011-2015"), (2020, "2016-2020"), (2025, "2021-2025"))
# Reporting periods (label, first year, last year).
PERIODS = (("Pre-2018", None, 2017), ("2018-2020", 2018, 2020), ("2021-2025", 2021, 2025))


def clean_date(c: Column | str) -> Column:
    """Squished date text with ``_`` read as ``-`` and ``.`` read as ``/``."""
    return F.replace(F.replace(clean_text(c), F.lit("_"), F.lit("-")), F.lit("."), F.lit("/"))


def format_shape(fmt: str) -> str:
    """Regular expression of the texts a date layout can read."""
    parts = {"yyyy": r"\d{4}", "MMMM": "[A-Za-z]+", "MMM": "[A-Za-z]{3}", "MM": r"\d{2}", "dd": r"\d{2}", "M": r"\d{1,2}", "d": r"\d{1,2}"}
    return "^" + re.sub("yyyy|MMMM|MMM|MM|dd|M|d", lambda m: parts[m.group(0)], fmt) + "$"


def parse_date(c: Column | str, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """First layout that parses.  A layout is tried only on texts of its shape: a failed parse costs
    an exception, a shape test does not."""
    z = clean_date(c)
    return F.coalesce(*[F.when(z.rlike(format_shape(f)), F.try_to_date(z, f)) for f in formats])


def derive_year(c: Column | str, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Year of the first layout that parses, else any plausible four-digit year in the text."""
    fallback = F.nullif(F.regexp_extract(clean_date(c), r"((?:19|20)\d{2})", 1), F.lit(""))
    return F.coalesce(F.year(parse_date(c, formats)), fallback.cast("int"))


def year_bin(c: Column | str, bins=FIVE_YEAR_BINS, unknown: str = "Unknown") -> Column:
    y = F.try_cast(col(c), "int") if hasattr(F, "try_cast") else col(c).try_cast("int")
    expr = F.when(y.isNull(), F.lit(unknown))
    for upper, label in bins:
        expr = expr.when(y <= upper, F.lit(label))
    return expr.otherwise(F.lit(unknown))


def period(c: Column | str, specs=PERIODS, missing: str | None = None) -> Column:
    """Label of the first period that holds the year; ``missing`` names the null stratum."""
    y = col(c)
    expr = F.when(y.isNull(), F.lit(missing))
    for label, lo, hi in specs:
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (y >= lo)
        if hi is not None:
            cond = cond & (y <= hi)
        expr = expr.when(cond, F.lit(label))
    return expr


def eligible(c: Column | str, lo: int, hi: int, keep_null: bool = False) -> Column:
    y = col(c)
    inside = F.coalesce(y.between(lo, hi), F.lit(False))
    return inside | y.isNull() if keep_null else inside


def assign_bin(c: Column | str, edges: Sequence[float], labels: Sequence[str], right: bool = False) -> Column:
    """Numeric bins; half-open ``[a, b)`` by default, ``(a, b]`` with ``right``.

    ``edges`` are the inner boundaries plus, for a bounded first bin, its lower bound:
    with ``len(labels) == len(edges)`` values below ``edges[0]`` get null, with
    ``len(labels) == len(edges) + 1`` they get ``labels[0]``.
    """
    v = col(c)
    below = len(labels) == len(edges) + 1
    expr = F.when(v.isNull() | F.isnan(v.cast("double")), F.lit(None).cast("string"))
    above = list(zip(edges, labels[1:] if below else labels))
    for edge, label in reversed(above):
        expr = expr.when((v > edge) if right else (v >= edge), F.lit(label))
    return expr.otherwise(F.lit(labels[0])) if below else expr
