"""Functional roll-ups of defining variants: genes, COG letters, impact classes, row accounting."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import by_size, saved
from .ranking import exact_rank
from .relations import as_list, null_safe_join

# Category strings that mean "no protein".
NO_PROTEIN = ("", "-", "NO_PROTEIN")
#: Records or names packed in one row.
CHUNK = 10_000


def in_chunks(df: DataFrame, keys, item: str, size: int = CHUNK, out: str = "chunk") -> DataFrame:
    """Rows numbered by ``item`` within a key, in chunks of ``size`` (column ``out``, from 0).

    Items with the same first letters are ordered together, so a key with very many rows is numbered by several tasks.
    """
    ranked = exact_rank(df, keys, [F.col(item)], _beginning(item, 6), "__r")
    return ranked.withColumn(out, F.expr(f"(__r - 1) DIV {size}").cast("long")).drop("__r")


def _ranges(rows: DataFrame, whole: DataFrame, keys, item: str, size: int) -> tuple[DataFrame, int]:
    """Where the items with one beginning ``__b`` stand within their key: rows ``(*keys, __b, __g, __off, __n)``, and the letters of a beginning.

    As many letters are taken beyond those that all items share as leave no more than ``size`` items of a key together,
    up to eight; this sets the cost only.
    """
    text = F.col(item).cast("string")
    shared = len(os.path.commonprefix([x or "" for x in rows.agg(F.min(text), F.max(text)).first()]))
    for letters in range(shared + 2, shared + 9):
        sizes = rows.groupBy(*keys, _beginning(item, letters).alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
        sizes = saved(null_safe_join(sizes, whole.select(*keys, "__g"), keys, "inner"), "sizes")
        if (sizes.agg(F.max("__n")).first()[0] or 0) <= size:
            break
    before = W.partitionBy("__g").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    return saved(sizes.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0))), "ranges"), letters


def _beginning(item: str, letters: int) -> Column:
    return F.coalesce(F.substring(F.col(item).cast("string"), 1, letters), F.lit(""))


def gene_rollup(df: DataFrame, keys, variant: str, effect: str, bin_col: str, pct_in: str, pct_out: str, size: int = CHUNK) -> DataFrame:
    """Genes with variant count, packed ids, effects and bins, percent ranges.

    ``variants`` keeps the aligned records and ``variant_ids`` their ids as text, up to ``size`` in a row: a
    gene with more has further rows, numbered by ``chunk``, that repeat what holds for the whole gene.

    The input is evaluated once and saved. Ids with the same first letters mostly fall into one chunk, which their number
    and place tells without an order; only where a chunk ends among them are they ranked. What is shuffled after that
    are a number for the gene and what the caller takes, ids or records.
    """
    keys = as_list(keys)

    def packed(c):
        return F.array_join(F.array_sort(F.collect_set(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)))), ";")

    rows = saved(df.select(*keys, variant, effect, bin_col, pct_in, pct_out), "rows", large=True)
    # sets are gathered from the distinct values
    per = rows.groupBy(*keys, effect, bin_col).agg(
        F.count(F.lit(1)).alias("__n"), F.min(pct_in).alias("__min_in"), F.max(pct_in).alias("__max_in"), F.min(pct_out).alias("__min_out"),
        F.max(pct_out).alias("__max_out"))
    whole = per.groupBy(*keys).agg(
        F.sum("__n").alias("n_variants"), packed(effect).alias("effects"), packed(bin_col).alias("bins"), F.min("__min_in").alias("min_in"),
        F.max("__max_in").alias("max_in"), F.min("__min_out").alias("min_out"), F.max("__max_out").alias("max_out"))
    whole = saved(whole.withColumn("__g", F.monotonically_increasing_id()), "genes")
    ranges, letters = _ranges(rows, whole, keys, variant, size)
    placed = null_safe_join(rows.withColumn("__b", _beginning(variant, letters)), ranges, [*keys, "__b"], "inner")
    one_chunk = F.expr(f"__off DIV {size} = (__off + __n - 1) DIV {size}")
    record = [variant, effect, bin_col]
    known = placed.where(one_chunk).select("__g", F.expr(f"__off DIV {size}").alias("chunk"), *record)
    rank = F.row_number().over(W.partitionBy("__g", "__b").orderBy(variant))
    cut = placed.where(~one_chunk).withColumn("__r", rank + F.col("__off") - 1).select("__g", F.expr(f"__r DIV {size}").alias("chunk"), *record)
    parts = by_size(known.unionByName(cut), "__g", "chunk").groupBy("__g", "chunk").agg(
        F.array_sort(F.collect_list(F.struct(F.col(variant).alias("id"), F.col(effect).alias("effect"), F.col(bin_col).alias("bin")))).alias("variants"),
        F.array_join(F.array_sort(F.collect_list(variant)), ";").alias("variant_ids"))
    # a row for each chunk, so the packed rows stay where they are
    heads = whole.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_variants - 1) DIV {size}"))))
    return parts.join(heads, ["__g", "chunk"]).select(*keys, "chunk", "variants", *[c for c in whole.columns if c not in keys and not c.startswith("__")], "variant_ids")


def collapse_cog(df: DataFrame, gene: str, cog: str, order: Column) -> DataFrame:
    """Distinct category letters per gene, in order of first appearance (row order, then position)."""
    value = F.when(~F.coalesce(F.col(cog), F.lit("")).isin("", "-"), F.col(cog))
    letters = df.select(gene, order.alias("__o"), F.posexplode_outer(F.filter(F.split(value, ""), lambda x: x != "")).alias("__p", "__l"))
    # first place of each letter, so the packed list is bounded by the alphabet
    first = letters.groupBy(gene, "__l").agg(F.min(F.struct("__o", "__p")).alias("__f"))
    g = first.groupBy(gene).agg(F.array_sort(F.collect_list(F.when(F.col("__l").isNotNull(), F.struct("__f", "__l")))).alias("__x"))
    text = F.array_join(F.transform("__x", lambda s: s["__l"]), "")
    return g.select(gene, F.when(text != "", text).alias(cog))


def letter_array(cog: str, none: str = "NO_PROTEIN") -> Column:
    """Distinct letters of a category string, one ``none`` entry when there are none."""
    c = F.coalesce(F.col(cog), F.lit(""))
    return F.when(c.isin(*NO_PROTEIN), F.array(F.lit(none))).otherwise(F.array_distinct(F.filter(F.split(c, ""), lambda x: x != "")))


def functional_summary(df: DataFrame, keys, cog: str, variant: str, gene: str, letter: str = "letter") -> DataFrame:
    """Counts per key and category letter, next to the counts per key.

    Rows are not exploded by letter before they are shuffled, and letters travel as one short text. Genes, of which
    there are few, combine before the shuffle; variants, which hardly repeat, are dealt out by the size of the rows, so
    no map side fills up with them. Only the counts of equal sets of letters are expanded.
    """
    keys = as_list(keys)
    letters = letter_array(cog)
    none = F.coalesce(F.col(cog), F.lit("")).isin(*NO_PROTEIN)
    d = saved(df.select(*keys, F.when(~none, F.array_join(F.array_sort(letters), "")).alias("__s"), F.col(variant).cast("string").alias("__v"), F.col(gene).cast("string").alias("__g")), "rows")

    def spelled(s: Column) -> Column:
        return F.when(s.isNull(), F.array(F.lit("NO_PROTEIN"))).otherwise(F.split(s, ""))

    assigned = d.groupBy(*keys, "__s").agg(F.count(F.lit(1)).alias("__n")).select(*keys, F.explode(spelled(F.col("__s"))).alias(letter), "__n").groupBy(*keys, letter).agg(F.sum("__n").alias("letter_n"))
    assigned = assigned.withColumn("assignments", F.sum("letter_n").over(W.partitionBy(*keys)))

    def per_letter(ids: DataFrame, id_col: str, out: str) -> DataFrame:
        # sets of letters of one id, and how many ids have them; a null text is the none entry
        sets = ids.groupBy(*keys, id_col).agg(F.array_sort(F.collect_set(F.coalesce("__s", F.lit("")))).alias("__x"))
        n = sets.groupBy(*keys, "__x").agg(F.count(id_col).alias("__n"))
        every = F.array_distinct(F.flatten(F.transform("__x", lambda s: spelled(F.nullif(s, F.lit(""))))))
        # the null letter stands for the key as a whole
        return n.select(*keys, F.explode(F.array_append(every, F.lit(None).cast("string"))).alias(letter), "__n").groupBy(*keys, letter).agg(F.sum("__n").alias(out))

    genes = per_letter(d.select(*keys, "__g", "__s").distinct(), "__g", "genes_in_letter")
    variants = per_letter(by_size(d.select(*keys, "__v", "__s"), *keys, "__v"), "__v", "variants_in_letter")
    per = null_safe_join(variants, genes, [*keys, letter], "inner")
    w, whole = W.partitionBy(*keys), F.col(letter).isNull()
    per = per.withColumn("unique_variants", F.max(F.when(whole, F.col("variants_in_letter"))).over(w)).withColumn(
        "unique_genes", F.max(F.when(whole, F.col("genes_in_letter"))).over(w)).where(~whole)
    per = per.select(*keys, letter, "variants_in_letter", "genes_in_letter", "unique_variants", "unique_genes")
    return null_safe_join(per, assigned, [*keys, letter], "inner")


def clade_overview(df: DataFrame, group: str, cog: str, variant: str, gene: str, impact: str) -> DataFrame:
    """Distinct variants, genes and variants per impact class, and variant × letter assignments."""
    d = df.select(group, F.size(letter_array(cog)).alias("__n"), F.col(variant).cast("string").alias("__v"), F.col(gene).cast("string").alias("__g"), impact)
    ids = d.select(group, impact, F.inline(F.array(
        F.struct(F.lit("v").alias("__t"), F.col("__v").alias("__id"), F.col("__n").alias("__n")),
        F.struct(F.lit("g").alias("__t"), F.col("__g").alias("__id"), F.lit(0).alias("__n")))))
    one = ids.groupBy(group, "__t", "__id").agg(F.sum("__n").alias("__n"), *[
        F.bool_or(F.col(impact) == c).alias(f"__{c}") for c in ("High", "Moderate", "Low")])
    v, g = F.col("__t") == "v", F.col("__t") == "g"
    known = F.col("__id").isNotNull()
    return one.groupBy(group).agg(
        F.count_if(v & known).alias("unique_variants"), F.count_if(g & known).alias("unique_genes"), F.sum("__n").alias("assignments"),
        *[F.count_if(v & known & F.col(f"__{c}")).alias(c.lower()) for c in ("High", "Moderate", "Low")])


def cog_summary(df: DataFrame, group: str, gene: str, cog: str, has_protein: str, size: int = CHUNK) -> DataFrame:
    """Genes, available proteins, distinct letters per group, and genes with several letters as text.

    The text lists up to ``size`` genes of a number of letters; a group with more has further rows, numbered by
    ``chunk``, with the next genes of each number.
    """
    g = df.select(group, gene, has_protein, F.when(F.coalesce(F.col(cog), F.lit("")).isin(*NO_PROTEIN), F.lit("NO_PROTEIN"))
                  .otherwise(F.col(cog)).alias("__c")).distinct()
    n = F.when(F.col("__c") == "NO_PROTEIN", 0).otherwise(F.length("__c"))
    letters = F.array_distinct(F.flatten(F.collect_set(F.when(n > 0, F.filter(F.split("__c", ""), lambda x: x != "")))))
    summary = g.groupBy(group).agg(F.count_distinct(gene).alias("n_genes"), F.count_if(F.col(has_protein)).alias("n_proteins"),
                                   F.size(letters).alias("n_letters"))
    multi = g.where(n >= 2).select(group, n.alias("k"), F.format_string("%s (%d COG)", gene, n).alias("t"))
    sizes = multi.groupBy(group, "k").agg(F.count(F.lit(1)).alias("m"))
    parts = in_chunks(multi, [group, "k"], "t", size).groupBy(group, "k", "chunk").agg(F.array_join(F.array_sort(F.collect_list("t")), "; ").alias("t"))
    parts = null_safe_join(parts, sizes, [group, "k"], "inner")
    # few numbers of letters, one text each
    text = parts.groupBy(group, "chunk").agg(F.array_sort(F.collect_list(F.struct("k", F.format_string("%d proteins (%d COG): %s", "m", "k", "t").alias("t")))).alias("x"))
    text = text.select(group, "chunk", F.array_join(F.transform("x", lambda s: s["t"]), " | ").alias("multi"))
    return null_safe_join(summary, text, [group], "left").fillna("None", subset=["multi"]).fillna(0, subset=["chunk"])


def row_accounting(genes: DataFrame, variants: DataFrame, by, n_col: str, gene: str, cog: str) -> DataFrame:
    """Expected against recovered rows per run, before and after expansion by category letters."""
    by = as_list(by)
    n_letters = F.when(F.coalesce(F.col(cog), F.lit("")).isin(*NO_PROTEIN), 1).otherwise(
        F.size(F.array_distinct(F.filter(F.split(cog, ""), lambda x: x != ""))))
    g = genes.groupBy(*by).agg(F.count(F.lit(1)).alias("gene_rows"), F.count_distinct(gene).alias("unique_genes"),
                               F.sum(n_col).cast("bigint").alias("expected_variants"), F.sum(n_letters).cast("bigint").alias("gene_cog_rows"))
    v = variants.groupBy(*by).agg(F.count(F.lit(1)).alias("recovered_variants"), F.sum(n_letters).cast("bigint").alias("variant_cog_rows"))
    return g.join(v, by, "left").select(
        "*", (F.col("gene_cog_rows") - F.col("gene_rows")).alias("extra_gene_rows"),
        (F.col("variant_cog_rows") - F.col("recovered_variants")).alias("extra_variant_rows"),
        (F.col("expected_variants") == F.col("recovered_variants")).alias("balanced"))
