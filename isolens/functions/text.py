"""Text cleaning as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens read as "no value".
NA_TOKENS = ("", "na", "n/a", "none", "null", "nan")
# Suffixes removed from sample names.
FILE_SUFFIXES = ("tsv", "txt", "csv", "fa", "fasta", "gff")
SAMPLE_TAGS = ("_trimmed", "_pure")
SAMPLE_PATTERN = r"SRR\d+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squish(c: Column | str) -> Column:
    """Trim and collapse runs of whitespace; null stays null."""
    return F.trim(F.regexp_replace(col(c).cast("string"), r"\s+", " "))


def clean_text(c: Column | str) -> Column:
    """Squish whitespace and turn null into the empty string."""
    return F.coalesce(squish(c), F.lit(""))


def clean_na(c: Column | str, tokens=NA_TOKENS) -> Column:
    """Squish and turn missing-value tokens (any case) into null."""
    s = squish(c)
    return F.when(~F.lower(s).isin(*tokens), s)



def normalize_id(
    c: Column | str,
    suffixes=FILE_SUFFIXES,
    tags=SAMPLE_TAGS,
    pattern: str = SAMPLE_PATTERN,
    upper: bool = False,
) -> Column:
    """Sample id from a path-like name: the first id that matches, else the cleaned base name."""
    base = F.element_at(F.split(F.trim(col(c).cast("string")), "/"), -1)
    for tag in tags:
        base = F.regexp_replace(base, tag, "")
    if suffixes:
        base = F.regexp_replace(base, r"(?i)\.(" + "|".join(suffixes) + r")$", "")
    base = F.regexp_replace(base, r"^_+|_+$", "")
    found = F.nullif(F.regexp_extract(base, f"(?i)({pattern})" if upper else f"({pattern})", 1), F.lit(""))
    out = F.coalesce(found, base)
    return F.upper(out) if upper else out


def clean_source(c: Column | str, marker: str = "NON-US", label: str = "International") -> Column:
    """Blank → Unknown, anything that holds ``marker`` → ``label``, else the trimmed text."""
    s = F.trim(col(c).cast("string"))
    return (
        F.when(s.isNull() | (s == ""), F.lit("Unknown"))
        .when(F.upper(s).contains(marker), F.lit(label))
        .otherwise(s)
    )


def canonical_list(c: Column | str, sep: str = ";", empty: str = "NA") -> Column:
    """Split a packed list, trim its parts, drop blanks, sort, and pack again."""
    parts = F.filter(
        F.transform(F.split(F.coalesce(col(c), F.lit("")), F.lit("\\Q" + sep + "\\E")), lambda x: F.trim(x)), lambda p: p != ""
    )
    return F.when(F.size(parts) == 0, F.lit(empty)).otherwise(F.array_join(F.array_sort(parts), sep))


def bracket_category(c: Column | str, default: str = "Uncategorized") -> Column:
    """Text inside the first ``[...]``."""
    inner = F.regexp_extract(col(c), r"\[([^\]]+)\]", 1)
    return F.when(col(c).isNull() | (inner == ""), F.lit(default)).otherwise(F.trim(inner))


def gene_class(c: Column | str, locus_pattern: str = r"^SEN_RS\d+$") -> Column:
    """Kind of gene name: blank, intergenic, hypothetical, locus tag or named."""
    s = F.trim(F.coalesce(col(c).cast("string"), F.lit("")))
    k = F.regexp_replace(F.lower(s), r"\s+", " ")
    return (
        # Names read as missing.
        F.when(k.isin("", "nan", "none", ".", "-", "na", "n/a"), F.lit("Blank_or_missing"))
        .when(k == "intergenic", F.lit("Intergenic"))
        .when(k == "hypothetical protein", F.lit("Hypothetical_protein"))
        .when(s.rlike(locus_pattern), F.lit("Locus_tag_like"))
        .otherwise(F.lit("Named_gene"))
    )
