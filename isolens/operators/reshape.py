"""Long / wide reshaping, unpacking of packed lists and run dimensions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import impact_class
from .relations import as_list

# Labels of the two grouping schemes and the merged label.
SCHEMES = {"Combined_Clade1": {"Clade 1A": "Clade 1", "Clade 1B": "Clade 1"}, "Split_Clade1A1B": {}}
MODES = ("with_unassigned", "without_unassigned")


def pivot_metrics(df: DataFrame, keys, pattern: str) -> DataFrame:
    """``metric_stat`` columns to one row per metric with a column per stat."""
    keys = as_list(keys)
    found: dict[str, dict[str, str]] = {}
    for c in df.columns:
        m = re.match(pattern, c)
        if m:
            found.setdefault(m.group(1), {})[m.group(2)] = c
    stat_names = list(dict.fromkeys(s for stats in found.values() for s in stats))
    rows = [F.struct(F.lit(metric).alias("metric"), *[(F.col(cols[s]) if s in cols else F.lit(None)).cast("double").alias(s)
                                                       for s in stat_names]) for metric, cols in found.items()]
    return df.select(*keys, F.inline(F.array(*rows)))


def to_long(df: DataFrame, keys, cols: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(as_list(keys), list(cols), name, value)


def to_wide(df: DataFrame, keys, name: str, value: str, levels: Sequence[str], fill=0) -> DataFrame:
    """Fixed levels keep the result schema stable and spare the extra pass that finds them."""
    w = df.groupBy(*as_list(keys)).pivot(name, list(levels)).agg(F.first(value))
    return w if fill is None else w.fillna(fill, subset=list(levels))


def recode_groups(df: DataFrame, label: str, scheme: str | dict, valid: Sequence[str] = (), unknown: str = "Unassigned",
                  drop: Sequence[str] = ("Reference",)) -> DataFrame:
    """Merge labels by scheme, unknown labels to ``unknown``, reference rows dropped."""
    mapping = SCHEMES[scheme] if isinstance(scheme, str) else scheme
    d = df.where(F.col(label).isNotNull() & ~F.col(label).isin(*drop))
    if valid:
        d = d.withColumn(label, F.when(F.col(label).isin(*valid), F.col(label)).otherwise(F.lit(unknown)))
    return d.replace(mapping, subset=[label]) if mapping else d


def with_runs(groups: DataFrame, label: str, schemes: dict[str, dict] = SCHEMES, modes: Sequence[str] = MODES,
              unknown: str = "Unassigned") -> DataFrame:
    """Every sample once per scheme and mode, as columns, so one grouped job covers all runs."""
    def recoded(mapping: dict) -> Column:
        expr = None
        for old, new in mapping.items():
            hit = F.col(label) == old
            expr = F.when(hit, F.lit(new)) if expr is None else expr.when(hit, F.lit(new))
        return F.col(label) if expr is None else expr.otherwise(F.col(label))

    runs = F.array(*[F.struct(F.lit(s).alias("scheme"), F.lit(m).alias("mode"), recoded(mapping).alias("run_label"))
                     for s, mapping in schemes.items() for m in modes])
    out = groups.select("*", F.explode(runs).alias("__r")).where(
        (F.col("__r.mode") != "without_unassigned") | (F.col("__r.run_label") != unknown))
    return out.select(*[c for c in groups.columns if c != label], F.col("__r.scheme").alias("scheme"),
                      F.col("__r.mode").alias("mode"), F.col("__r.run_label").alias(label))



def canonical_slice(df: DataFrame, specs: Sequence[dict[str, object]]) -> DataFrame:
    """Rows that belong to the published combination of runs: one filter per part, read in one pass."""
    cond = None
    for spec in specs:
        part = None
        for c, v in spec.items():
            one = F.col(c).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(c) == v
            part = one if part is None else part & one
        cond = part if cond is None else cond | part
    return df.where(cond)


def unpack_rows(df: DataFrame, list_cols: dict[str, str], n_col: str, sep: str = ";", index: str = "item_index") -> DataFrame:
    """One row per packed item.  A single value serves all items; any other length must match."""
    def parts(c):
        text = F.coalesce(F.col(c), F.lit(""))
        return F.when(F.trim(text) == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(text, sep), lambda x: F.trim(x)))

    n = F.greatest(F.coalesce(F.col(n_col).cast("int"), F.lit(0)),
                   F.when(F.coalesce(F.col(n_col).cast("int"), F.lit(0)) < 1,
                          F.greatest(*[F.size(parts(c)) for c in list_cols], F.lit(1))).otherwise(F.lit(0)))
    d = df.withColumn("__n", n)

    def sized(c):
        p = parts(c)
        return (F.when(F.size(p) == F.col("__n"), p)
                .when(F.size(p) == 1, F.array_repeat(F.element_at(p, 1), F.col("__n")))
                .when(F.size(p) == 0, F.array_repeat(F.lit(None).cast("string"), F.col("__n")))
                .otherwise(F.raise_error(F.concat(F.lit(f"cannot expand {c}: expected "), F.col("__n").cast("string"),
                                                  F.lit(" values, found "), F.size(p).cast("string"))).cast("array<string>")))

    zipped = F.arrays_zip(*[sized(c).alias(out) for c, out in list_cols.items()])
    d = d.select("*", F.posexplode(zipped).alias("__i", "__z")).drop("__n")
    return d.select("*", (F.col("__i") + 1).alias(index),
                    *[F.col("__z")[out].alias(out) for out in list_cols.values()]).drop("__i", "__z")


def unpack_gene_rows(df: DataFrame) -> DataFrame:
    """Gene roll-up back to one row per variant, with its impact class."""
    out = unpack_rows(df, {"variant_ids": "variant_id", "effects": "effect", "bins": "coverage_bin"}, "n_variants")
    return out.withColumn("impact_class", impact_class("effect"))


def explode_letters(df: DataFrame, col: str, out: str = "letter", none: str = "NO_PROTEIN",
                    blank: Sequence[str] = ("", "-", "NO_PROTEIN")) -> DataFrame:
    """One row per distinct letter of a category string; blank strings give one ``none`` row."""
    c = F.col(col)
    letters = F.when(c.isNull() | c.isin(*blank), F.array(F.lit(none))).otherwise(
        F.array_distinct(F.filter(F.split(c, ""), lambda x: x != "")))
    return df.withColumn(out, F.explode(letters))


def complete_schema(df: DataFrame, fields: dict[str, Sequence[Column | str]], keep: Sequence[str] = ()) -> DataFrame:
    """Add each field from the first candidate that is a column (or expression), else null.

    Fields named in ``keep`` that already exist are authoritative and stay as they are.
    """
    out = {}
    for name, candidates in fields.items():
        if name in keep and name in df.columns:
            continue
        usable = [F.col(f"`{c}`") if isinstance(c, str) else c for c in candidates if not isinstance(c, str) or c in df.columns]
        out[name] = F.coalesce(*[u.cast("string") for u in usable]) if usable else F.lit(None).cast("string")
    return df.withColumns(out) if out else df


def prefix_columns(df: DataFrame, keys, prefix: str) -> DataFrame:
    keys = as_list(keys)
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c not in keys})


def coverage_wide(long: DataFrame, keys, bins: Sequence[str], name: str = "coverage_bin", value: str = "n") -> DataFrame:
    return to_wide(long, keys, name, value, bins)
