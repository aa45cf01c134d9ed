"""Line formats of the field: variant files, interval files, annotation tables, colour strips, id lists, FASTA.

Every parser takes a DataFrame of lines (column ``value``), so it works on ``spark.read.text`` of any
number of files and on lines that another job derived.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import SAMPLE_PATTERN, normalize_id
from ..session import cut_lineage

#: Counts of splits are broadcast up to this many (some 100 bytes each).
MOST_SPLITS = 200_000


def read_lines(spark: SparkSession, path, whole: bool = False) -> DataFrame:
    """Lines with the path they came from."""
    df = spark.read.text(path, wholetext=whole)
    return df.select("value", F.col("_metadata.file_path").alias("path"))


def placed_lines(spark: SparkSession, path) -> DataFrame:
    """Lines with their file and their number in it, counted from 0 (columns value, path, line_no).

    A large file is read in several splits. Each split's lines are counted once, which tells the number
    its first line has; rows are neither sorted nor moved. Should a file be cut differently in
    the second reading, the job fails rather than number lines wrongly.
    """
    raw = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__id"))
    splits = raw.groupBy("path", "__start").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy("path").orderBy("__start").rowsBetween(W.unboundedPreceding, -1)
    splits = cut_lineage(splits.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0))))
    if splits.count() <= MOST_SPLITS:
        splits = F.broadcast(splits)
    inside = F.col("__id") - F.col("__first")
    number = F.when((inside >= 0) & (inside < F.col("__n")), inside + F.col("__off")).otherwise(
        F.raise_error(F.lit("the file was cut into other splits than before")).cast("long"))
    return raw.join(splits, ["path", "__start"], "left").select("value", "path", number.alias("line_no"))


def without_header(spark: SparkSession, path) -> tuple[str, DataFrame]:
    """The first line of the first file, and all lines of all files but the first of each; a data line that repeats the header stays."""
    lines = placed_lines(spark, path)
    first = lines.where("line_no = 0").agg(F.min(F.struct("path", "value")).alias("f")).first().f
    return "" if first is None else first.value, lines.where("line_no > 0")


def parent_folder(path: Column) -> Column:
    """Name of the folder that holds a file, without the ``column=`` of partitioned writes."""
    return F.regexp_replace(F.try_element_at(F.split(path, "/"), F.lit(-2)), "^[A-Za-z_]+=", "")


def parse_vcf(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Position, alleles and INFO of variant lines; comment lines and short lines are skipped."""
    d = lines.where(~F.col("value").startswith("#")).withColumn("__p", F.split(F.trim("value"), "\t")).where(F.size("__p") >= 8)
    return d.select(*keep, F.col("__p")[1].cast("int").alias("pos"), F.col("__p")[3].alias("ref"), F.col("__p")[4].alias("alt"),
                    F.col("__p")[7].alias("info"))


def read_vcf(spark: SparkSession, path) -> DataFrame:
    """Variants of many files, the sample being the folder of each file."""
    return parse_vcf(read_lines(spark, path).withColumn("sample", parent_folder(F.col("path"))), ["sample"])


def parse_ann(variants: DataFrame, info: str = "info") -> DataFrame:
    """Effect, gene and protein change of the first annotation in ``ANN=``, with defaults."""
    # the fields are cut once, in their own projection, and read several times below
    rest = [c for c in variants.columns if c != info]
    d = variants.select(*rest, F.split(F.regexp_extract(info, r"ANN=([^;,]+)", 1), r"\|").alias("__a"))

    def field(i: int) -> Column:
        return F.nullif(F.try_element_at("__a", F.lit(i + 1)), F.lit(""))

    none = (F.size("__a") == 1) & (F.col("__a")[0] == "")
    second = F.try_element_at("__a", F.lit(2))
    return d.select(
        *rest,
        F.when(none, F.lit("unannotated")).otherwise(F.coalesce(field(3), field(4), F.lit("intergenic"))).alias("gene"),
        F.when(none, F.lit("unknown")).otherwise(F.coalesce(second, F.lit("unknown"))).alias("effect"),
        F.when(none, F.lit(".")).otherwise(F.coalesce(field(10), F.lit("."))).alias("aa_change"))


def parse_intervals(lines: DataFrame) -> DataFrame:
    """Start, end and one row per listed taxon of interval lines."""
    d = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).withColumn("__p", F.split("value", "\t"))
    d = d.where(F.size("__p") >= 9)
    taxa = F.split(F.trim(F.replace(F.regexp_extract(F.col("__p")[8], r'taxa="([^"]*)"', 1), F.lit(";"), F.lit(" "))), r"\s+")
    return d.select(F.col("__p")[3].cast("int").alias("start_pos"), F.col("__p")[4].cast("int").alias("end_pos"),
                    F.explode(taxa).alias("__t")).where("__t <> ''").select(normalize_id("__t").alias("sample"), "start_pos", "end_pos")


def read_intervals(spark: SparkSession, path) -> DataFrame:
    return parse_intervals(read_lines(spark, path))


def parse_hash_header(lines: DataFrame, columns: Sequence[str], sep: str = "\t", drop: Sequence[str] = ()) -> DataFrame:
    """Table lines of a file whose header hides among the comments."""
    d = lines.where(~F.col("value").startswith("#") & (F.col("value") != "")).withColumn("__p", F.split("value", sep))
    return d.select(*[F.try_element_at("__p", F.lit(i + 1)).alias(c) for i, c in enumerate(columns) if c not in drop])


def hash_header(lines: DataFrame, pattern: str = r"^#\s*query(_name)?\b", sep: str = "\t", order: Sequence[str] = ()) -> list[str]:
    """Column names from the header-like comment line that comes first in ``order`` (one row reaches the driver)."""
    row = lines.where(F.col("value").rlike(pattern)).agg(F.min(F.struct(*order, "value")).alias("f")).first()
    if row.f is None:
        raise ValueError("no header line starting with #query")
    return row.f.value.lstrip("#").strip().split(sep)


def read_hash_header_tsv(spark: SparkSession, path) -> DataFrame:
    """Table of files whose header is the first ``#query`` line; rows equal to it in a data line stay data."""
    lines = placed_lines(spark, path)
    return parse_hash_header(lines, hash_header(lines, order=["path", "line_no"]))


def parse_colorstrip(lines: DataFrame, order: Sequence[str]) -> DataFrame:
    """First (id, colour, label) per id among the lines after ``DATA``.

    ``order`` are the columns that give the line order inside a file (for example path and line
    number); header lines have fewer than three fields or no id and fall away without a line state.
    """
    p = F.transform(F.split("value", ","), lambda x: F.trim(x))
    # Keywords of the header block.
    header = F.upper(p[0]).isin("DATASET_COLORSTRIP", "SEPARATOR COMMA", "DATASET_LABEL", "COLOR", "DATA", "")
    d = lines.where((F.size(p) >= 3) & ~header).select(normalize_id(p[0]).alias("sample"), p[1].alias("color"), p[2].alias("label"), *order)
    g = d.where("sample <> ''").groupBy("sample").agg(F.min(F.struct(*order, "color", "label")).alias("f"))
    return g.select("sample", "f.color", "f.label")


def read_colorstrip(spark: SparkSession, path) -> DataFrame:
    """First (colour, label) of each id in the lines after each file's ``DATA`` line; files count in the order of their paths.

    A file without such a line has no entries. Whatever stands before it is header, also if it looks like an entry.
    """
    lines = placed_lines(spark, path)
    begin = lines.where(F.upper(F.trim("value")) == "DATA").groupBy("path").agg(F.min("line_no").alias("__data"))
    body = lines.join(begin, "path").where(F.col("line_no") > F.col("__data"))
    return parse_colorstrip(body.drop("__data"), ["path", "line_no"])


def write_colorstrip(df: DataFrame, path: str, sample: str, label: str, title: str, color: str = "#000000", per_file: int = 100_000) -> None:
    """Colour-strip files of up to about ``per_file`` entries, each with its own header, one label for each id (the smallest)."""
    lines = colorstrip_lines(df, sample, label, title, color)
    files = max(1, -(-lines.count() // per_file))
    entry = F.col("line_no") >= 5
    part = F.when(entry, F.array((F.pmod(F.xxhash64("value"), F.lit(files))).cast("int"))).otherwise(F.sequence(F.lit(0), F.lit(files - 1)))
    placed = lines.withColumn("file", F.explode(part)).repartition(files, "file").sortWithinPartitions("file", "line_no", "value")
    placed.select("value", "file").write.mode("overwrite").partitionBy("file").text(path)


def colorstrip_lines(df: DataFrame, sample: str, label: str, title: str, color: str = "#000000") -> DataFrame:
    """Lines of a colour-strip file: one per sample, header first (column ``line_no`` orders them)."""
    head = ["DATASET_COLORSTRIP", "SEPARATOR COMMA", f"DATASET_LABEL,{title}", f"COLOR,{color}", "DATA"]
    top = df.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(h) for h in head])).alias("line_no", "value"))
    rows = df.groupBy(sample).agg(F.min(label).alias("__l")).select(
        F.lit(len(head)).alias("line_no"), F.concat_ws(",", sample, F.lit(color), F.coalesce("__l", F.lit("Unknown"))).alias("value"))
    return top.unionByName(rows)


def extract_ids(texts: DataFrame, column: str = "value", pattern: str = SAMPLE_PATTERN) -> DataFrame:
    """Distinct ids that occur anywhere in the text."""
    return texts.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(0))).alias("id")).distinct()


def tree_tips(texts: DataFrame, column: str = "value", pattern: str = SAMPLE_PATTERN, reference: str | None = None) -> DataFrame:
    """Tip ids of tree text, with the reference name when it stands alone as a label."""
    tips = extract_ids(texts, column, pattern)
    if reference:
        whole = r"(?<![A-Za-z0-9_.-])\Q" + reference + r"\E(?![A-Za-z0-9_.-])"
        tips = tips.unionByName(texts.where(F.col(column).rlike(whole)).select(F.lit(reference).alias("id")).distinct())
    return tips


# --- FASTA -----------------------------------------------------------------------------------


def to_fasta(df: DataFrame, header_cols: Sequence[str], seq_col: str, width: int = 80, sep: str = " | ") -> DataFrame:
    """One text value per record: ``>k=v | k=v`` and the wrapped sequence; blank sequences are skipped."""
    seq = F.trim(F.col(seq_col).cast("string"))
    head = F.concat_ws(sep, *[F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(f"{c.lower()}="), F.trim(F.col(c).cast("string"))))
                              for c in header_cols])
    body = F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", "")
    return df.where((seq != "") & (seq != "N/A")).select(F.concat(F.lit(">"), head, F.lit("\n"), body).alias("value"))


def parse_fasta(records: DataFrame) -> DataFrame:
    """Id, header and sequence of FASTA records (one record per row, without the leading ``>``)."""
    lines = F.split(F.regexp_replace("value", "^>", ""), "\n")
    head = lines[0]
    return records.where(F.trim("value") != "").select(
        F.element_at(F.split(F.trim(head), r"\s+"), 1).alias("id"), head.alias("header"),
        F.array_join(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.trim(x)), "").alias("seq"))


def read_fasta(spark: SparkSession, path) -> DataFrame:
    """Records are split by Spark at ``>``, so a large alignment is read in parallel."""
    return parse_fasta(spark.read.text(path, lineSep=">"))


def fasta_filter(records: DataFrame, ids: DataFrame) -> DataFrame:
    """Drop the listed records from an alignment."""
    return records.join(ids.select("id"), "id", "left_anti")
