"""Resistance-marker tokens: extraction, naming, families and per-isolate groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_text, col

# How a token is cut out of "tok=KIND,tok=KIND".
TOKEN_PATTERN = r"[^,=\s]+(?==)"
# Narrow marker pattern used for calls, broad pattern used for reporting.
CALL_PATTERN = (
    r"^(gyr[a-b]_.+|par[c-e]_.+|qnr[a-z0-9._-]*|aac\(6'\)-ib-cr|qep[a-z0-9._-]*|oqx[a-b]|"
    r"qnrvc[a-z0-9._-]*|crpp|acr[a-b]_.+|tolc_.+|ram[ar]_.+|mar[ar]_.+|sox[rs]_.+)$"
)
BROAD_PATTERN = (
    r"^((gyr[a-b](?:_.+)?|par[c-e](?:_.+)?|grla(?:_.+)?)(?:$)|(qnr(as|[a-z0-9._-]*))(?:$)|"
    r"(qnrvc[a-z0-9._-]*)(?:$)|(qep[a-z0-9._-]*)(?:$)|"
    r"(nfxb(?:_.+)?|emrr(?:_.+)?|norm(?:_.+)?|pmra(?:_.+)?|acrb(?:_.+)?|smef(?:_.+)?)(?:$)|"
    r"(aac\(6'\)-ib-cr(?:_.+)?|oqx[a-b](?:_.+)?|crpp(?:_.+)?|acr[a-b](?:_.+)?|tolc(?:_.+)?|"
    r"ram[ar](?:_.+)?|mar[ar](?:_.+)?|sox[rs](?:_.+)?)(?:$))"
)
# Gene families and their display casing (prefix of the lower-cased token).
FAMILY_CASING = (
    "gyrA", "gyrB", "parC", "parD", "parE", "grlA", "qnrVC", "qnrA", "qnrB", "qnrC", "qnrD", "qnrE", "qnrS",
    "qepA", "oqxA", "oqxB", "crpP", "acrA", "acrB", "tolC", "ramA", "ramR", "marA", "marR", "soxR", "soxS",
)
# The five major markers in priority order.
MAJOR_MARKERS = ("gyrA_D87Y", "gyrA_D87N", "gyrA_S83Y", "gyrA_D87G", "qnrB19")
# Pattern → resistance pattern label, first match wins.
AMR_PATTERNS = (
    (r"gyra[_-]?d87y", "gyrA_D87Y"), (r"gyra[_-]?d87n", "gyrA_D87N"), (r"gyra[_-]?s83y", "gyrA_S83Y"),
    (r"gyra[_-]?d87g", "gyrA_D87G"), (r"qnrb19", "qnrB19"),
)
# Token pattern → marker family, first match wins.
FAMILY_RULES = (
    (r"^gyra_", "gyra_others"), (r"^gyrb_", "gyrb_all"), (r"^parc_", "parc_all"), (r"^pard_", "pard_all"),
    (r"^pare_", "pare_all"), (r"^qnrvc", "qnrvc_all"), (r"^qnr", "qnr_all"), (r"^aac\(6'\)-ib-cr$", "aac(6')-ib-cr"),
    (r"^qep", "qep_all"), (r"^oqxa$", "oqxa"), (r"^oqxb$", "oqxb"), (r"^crpp$", "crpp"), (r"^acra_", "acra_all"),
    (r"^acrb_", "acrb_all"), (r"^tolc_", "tolc_all"), (r"^rama_", "rama_all"), (r"^ramr_", "ramr_all"),
    (r"^mara_", "mara_all"), (r"^marr_", "marr_all"), (r"^soxr_", "soxr_all"), (r"^soxs_", "soxs_all"),
)
# Label → pattern of the clade report, in primary order, and its catch-all pattern.
REPORT_MARKERS = (
    ("S83Y", r"\bGYRA_S83Y(?:=POINT)?\b"), ("D87Y", r"\bGYRA_D87Y(?:=POINT)?\b"),
    ("D87N", r"\bGYRA_D87N(?:=POINT)?\b"), ("D87G", r"\bGYRA_D87G(?:=POINT)?\b"),
    ("qnrB19", r"\bQNRB19(?:=COMPLETE)?\b"),
)
REPORT_ANY = r"\b(?:GYRA|GYRB|PARC|PARE)_[A-Z]\d+[A-Z](?:=POINT)?\b|\bQNR[A-Z0-9]+(?:=COMPLETE)?\b"


def extract_tokens(c: Column | str, pattern: str = TOKEN_PATTERN) -> Column:
    """Every token of a marker string, in order (empty array for null)."""
    return F.regexp_extract_all(F.coalesce(col(c).cast("string"), F.lit("")), F.lit(pattern), F.lit(0))


def filter_tokens(tokens: Column | str, pattern: str = CALL_PATTERN) -> Column:
    """Tokens whose lower-cased form matches the pattern."""
    return F.filter(col(tokens), lambda t: F.lower(t).rlike(pattern))


def extract_markers(c: Column | str, pattern: str = CALL_PATTERN) -> Column:
    """Distinct marker tokens of a marker string."""
    return F.array_distinct(filter_tokens(extract_tokens(c), pattern))



def pretty_tokens(tokens: Column | str) -> Column:
    """Display forms of an array of tokens: family casing, then the upper-cased part after the first underscore.

    Each step is its own ``transform``, so a step's result is computed once and not once per use.
    """
    families = "^(" + "|".join(f.lower() for f in FAMILY_CASING) + ")"
    casing = F.create_map(*[F.lit(v) for f in FAMILY_CASING for v in (f.lower(), f)])
    plain = F.transform(col(tokens), lambda t: F.replace(F.lower(F.regexp_replace(t, r"\s+", "")), F.lit("-"), F.lit("_")))
    found = F.transform(plain, lambda x: F.struct(x.alias("x"), F.regexp_extract(x, families, 1).alias("f")))
    cased = F.transform(found, lambda s: F.when(s["f"] == "", F.regexp_replace(s["x"], r"^aac\(6'\)_ib_cr", "aac(6')-Ib-cr")).otherwise(
        F.concat(F.try_element_at(casing, s["f"]), F.substring(s["x"], F.length(s["f"]) + 1, F.length(s["x"])))))
    parts = F.transform(cased, lambda x: F.split(x, "_", 2))
    return F.transform(parts, lambda p: F.when(F.size(p) < 2, p[0]).when(p[1] == "", p[0]).otherwise(
        F.concat_ws("_", p[0], F.upper(p[1]))))


def pretty_token(c: Column | str) -> Column:
    return F.element_at(pretty_tokens(F.array(col(c))), 1)


def pretty_markers(c: Column | str, pattern: str = CALL_PATTERN) -> Column:
    """Sorted distinct display names of the markers of one marker string."""
    return F.array_sort(F.array_distinct(pretty_tokens(extract_markers(c, pattern))))



def assign_pattern(c: Column | str, rules=AMR_PATTERNS, default: str = "others") -> Column:
    text = F.lower(F.coalesce(col(c), F.lit("")))
    return first_match(text, rules, default)


def marker_family(token: Column | str, top: Sequence[str] = (), rules=FAMILY_RULES, default="other_qr") -> Column:
    """The token itself when it is one of the kept ones, else its family label."""
    t = col(token)
    label = first_match(t, rules, default)
    return F.when(t.isin(*top), t).otherwise(label) if top else label


def first_match(text: Column, rules, default: str) -> Column:
    expr = None
    for pattern, label in rules:
        cond = text.rlike(pattern)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))


def _major_hits(tokens: Column, major: Sequence[str]) -> Column:
    lowered = F.transform(tokens, F.lower)
    return F.filter(F.array(*[F.lit(m) for m in major]), lambda m: F.array_contains(lowered, F.lower(m)))


def exclusive_group(
    tokens: Column | str,
    major: Sequence[str] = MAJOR_MARKERS,
    none: str = "QS/FQS (no marker)",
    multiple: str = "Multiple major QR/FQR markers",
    other: str = "Other QR/FQR marker(s)",
) -> Column:
    """Exactly one group per genome: none, one major marker, several majors, or other."""
    t = col(tokens)
    hits = _major_hits(t, major)
    return (
        F.when(F.size(t) == 0, F.lit(none))
        .when(F.size(hits) > 1, F.lit(multiple))
        .when(F.size(hits) == 1, F.try_element_at(hits, F.lit(1)))
        .otherwise(F.lit(other))
    )


def priority_bucket(
    tokens: Column | str, major: Sequence[str] = MAJOR_MARKERS, none: str = "QS/FQS", other: str = "Others"
) -> Column:
    """First major marker in list order, else ``other``; ``none`` without markers."""
    t = col(tokens)
    return F.when(F.size(t) == 0, F.lit(none)).otherwise(
        F.coalesce(F.try_element_at(_major_hits(t, major), F.lit(1)), F.lit(other))
    )


def report_markers(
    text: Column | str,
    override: Column | None = None,
    named=REPORT_MARKERS,
    any_pattern: str = REPORT_ANY,
    other: str = "Others",
) -> Column:
    """Ordered labels of the clade report as an array; empty when none or overridden.

    A catch-all match that lies inside a named match does not count, so named matches are blanked
    out first (with a word character boundary kept) and the catch-all runs on what is left.
    """
    raw = F.upper(F.trim(F.coalesce(col(text), F.lit(""))))
    rest = raw
    for _, pattern in named:
        rest = F.regexp_replace(rest, pattern, " ")
    labels = [F.when(raw.rlike(pattern), F.lit(label)) for label, pattern in named]
    labels.append(F.when(rest.rlike(any_pattern), F.lit(other)))
    found = F.array_compact(F.array(*labels))
    blank = raw.isin("", "NAN", "NA", "NONE")
    if override is not None:
        blank = blank | F.coalesce(override, F.lit(False))
    return F.when(blank, F.array().cast("array<string>")).otherwise(found)


def indicator_columns(packed: Column | str, labels: Sequence[str], sep: str = ";", prefix: str = "has_") -> list[Column]:
    """0/1 column per label of a packed list."""
    parts = F.split(clean_text(packed), sep)
    return [F.array_contains(parts, label).cast("int").alias(f"{prefix}{label}") for label in labels]
