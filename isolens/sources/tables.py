"""Delimited sources: strict, repaired, typed and ragged tables, per-sample reports, header aliases."""

from __future__ import annotations

import csv
import re
import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalize_id
from ..operators.relations import expect
from .formats import without_header

PLACEHOLDER = "__LITERAL_COMMA__"
# A comma escaped inside a quoted field, read as a plain comma after parsing.
ESCAPED_COMMA = "\\,"
# Separator rows of concatenated reports, and test-run samples.
NOISE_PATTERNS = (r"==>|<==", r"^_SMOKE_")


def text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), True) for c in columns])


def expect_shape(df: DataFrame, n_rows: int | None = None, n_cols: int | None = None, unique: Sequence[str] = ()) -> DataFrame:
    """Check column count, row count and unique columns (one aggregate job); returns the table."""
    if n_cols is not None and len(df.columns) != n_cols:
        raise ValueError(f"table has {len(df.columns)} columns, expected {n_cols}")
    if n_rows is not None or unique:
        got = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(F.col(f"`{c}`")).alias(f"u{i}") for i, c in enumerate(unique)]).first()
        if n_rows is not None and got["n"] != n_rows:
            raise ValueError(f"table has {got['n']} rows, expected {n_rows}")
        for i, c in enumerate(unique):
            if got[f"u{i}"] != got["n"]:
                raise ValueError(f"column {c} is not unique and complete")
    return df


def read_table(spark: SparkSession, path, sep: str = ",", schema=None, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV / TSV with header; text columns unless a schema is given.  Projection reaches the scan."""
    reader = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
    df = (reader.schema(schema).option("enforceSchema", False) if schema is not None else reader.option("inferSchema", False)).csv(path)
    return df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df


def read_master(spark: SparkSession, path, n_rows: int | None = None, n_cols: int | None = None, unique: Sequence[str] = ()) -> DataFrame:
    """All-text table; a row that does not parse fails the job.  Empty text and null stay apart."""
    header = spark.read.option("header", True).csv(path).columns
    df = (spark.read.option("header", True).option("quote", '"').option("escape", '"').option("mode", "FAILFAST")
          .option("nullValue", None).option("emptyValue", "").option("multiLine", False).schema(text_schema(header)).csv(path))
    return expect_shape(df, n_rows, n_cols, unique)


def repair_lines(lines: DataFrame, repairs: Sequence[tuple[str, str]] = (), placeholder: str = PLACEHOLDER) -> DataFrame:
    """Repair raw lines (column ``value``): escaped commas become a placeholder, literal patterns are replaced.

    Fails when the placeholder occurs already.  Counts of both repairs are kept per line.
    """
    def times(text: str) -> Column:
        return F.regexp_count("value", F.lit(re.escape(text)))

    fixed = F.replace(F.col("value"), F.lit(ESCAPED_COMMA), F.lit(placeholder))
    found = F.lit(0)
    for old, new in repairs:
        found = found + times(old)
        fixed = F.replace(fixed, F.lit(old), F.lit(new))
    safe = expect(lines, ~F.col("value").contains(placeholder), "reserved placeholder already occurs in the input")
    return safe.select(*[c for c in lines.columns if c != "value"], fixed.alias("value"),
                       times(ESCAPED_COMMA).alias("n_escaped"), found.alias("n_repaired"))


def parse_lines(lines: DataFrame, schema: T.StructType, sep: str = ",", placeholder: str | None = PLACEHOLDER) -> DataFrame:
    """Parse a column of CSV text with ``from_csv``; the placeholder is turned back into a comma."""
    opts = {"sep": sep, "quote": '"', "escape": '"', "mode": "FAILFAST"}
    row = F.from_csv("value", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), opts)
    out = lines.select(*[c for c in lines.columns if c != "value"], row.alias("__r"))
    fields = [F.col("__r")[f.name] for f in schema]
    if placeholder:
        fields = [F.replace(f, F.lit(placeholder), F.lit(",")) for f in fields]
    return out.select(*[c for c in out.columns if c != "__r"], *[f.alias(s.name) for f, s in zip(fields, schema)])


def read_repaired_csv(spark: SparkSession, path, repairs: Sequence[tuple[str, str]] = (), placeholder: str = PLACEHOLDER) -> DataFrame:
    """CSV whose lines are repaired before parsing, with n_escaped and n_repaired of each record; one record per line.

    The header is the first line of each file, not every line that reads like it.
    """
    header, lines = without_header(spark, path)
    names = next(csv.reader([header]))
    fixed = repair_lines(lines.where("value <> ''").select("value"), repairs, placeholder)
    rows = parse_lines(fixed, text_schema(names), placeholder=placeholder)
    return rows.select(*[f"`{c}`" for c in names], F.col("n_escaped").cast("int"), F.col("n_repaired").cast("int"))


def split_ragged(lines: DataFrame, header: Sequence[str], sep: str = "\t", keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Good rows as a table and bad lines with their field count, from raw lines (column ``value``)."""
    n = len(header)
    d = lines.withColumn("__p", F.split("value", sep, -1))
    size = F.size("__p")
    good = d.where(size == n).select(*[F.col("__p")[i].alias(c) for i, c in enumerate(header)])
    bad = d.where(size != n).select(*keep, "value", size.alias("fields"), F.lit(n).alias("expected"))
    return good, bad


def read_tsv_tolerant(spark: SparkSession, path, sep: str = "\t") -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad lines with their file, line number (from 0, header included) and field counts."""
    header, lines = without_header(spark, path)
    good, bad = split_ragged(lines, header.split(sep), sep, keep=["path", "line_no"])
    return good, bad


def drop_noise_rows(df: DataFrame, column: str, patterns: Sequence[str] = NOISE_PATTERNS) -> DataFrame:
    """Drop separator rows and test-run rows; a null name is kept."""
    return df.where(~F.coalesce(F.col(column).rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False)))


def sample_of_path(path: Column, suffix_pattern: str = r"_[A-Za-z0-9]+$", level: int = -1) -> Column:
    """Sample id out of a report path; the ``column=`` of partitioned writes is left out."""
    base = F.regexp_replace(F.regexp_replace(F.element_at(F.split(path, "/"), level), "^[A-Za-z_]+=", ""), r"\.[^.]+$", "")
    return normalize_id(F.regexp_replace(base, suffix_pattern, ""))


def read_reports(spark: SparkSession, paths, manifest: DataFrame | None = None, sample: str = "sample", sep: str = "\t",
                 suffix_pattern: str = r"_[A-Za-z0-9]+$", level: int = -1) -> DataFrame:
    """One table out of per-sample reports with a leading sample column from the file name.

    ``level`` is the part of the path that names the sample, counted from the end: -1 the file, -2 its folder.
    With a manifest, every listed sample must have a report.
    """
    df = spark.read.option("header", True).option("sep", sep).csv(paths)
    df = df.select(sample_of_path(F.col("_metadata.file_path"), suffix_pattern, level).alias(sample), *[F.col(f"`{c}`") for c in df.columns])
    if manifest is not None:
        missing = missing_reports(df, manifest, sample).limit(5).collect()
        if missing:
            raise ValueError(f"no report for sample(s): {[r[0] for r in missing]}")
    return df


def missing_reports(df: DataFrame, manifest: DataFrame, sample: str = "sample") -> DataFrame:
    return manifest.select(sample).distinct().join(df.select(sample), sample, "left_anti")


def resolve_column(df: DataFrame, candidates: Sequence[str], what: str | None = None) -> str | None:
    """Name of the first candidate present (any case, trimmed); None with a warning when absent."""
    by_name = {c.strip().lower(): c for c in df.columns}
    for c in candidates:
        if c.strip().lower() in by_name:
            return by_name[c.strip().lower()]
    if what:
        warnings.warn(f"no {what} column found; its filter is skipped", stacklevel=2)
    return None
