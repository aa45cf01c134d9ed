"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, text_key, text_of

#: Positions that a mask looks at. Any 15 tokens with at most two substitutions contain one of them intact.
MASKS = [(0, 1, 2, 3, 5, 6, 7), (0, 1, 2, 4, 7, 8, 9)]
WINDOW, SUBSTITUTIONS = 15, 2
#: ASCII punctuation, blanks and controls separate tokens.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def token_codes(text: Column) -> Column:
    """XXH64 of each token: lower case, ASCII punctuation and blanks separate."""
    return F.transform(F.array_remove(F.split(F.lower(text), BETWEEN), ""), lambda w: F.xxhash64(w))


def _seeds(rows: DataFrame, keys: list[str], masks: list[tuple[int, ...]]) -> DataFrame:
    """One row ``(*keys, pos, mask, hash)`` for each mask at each position where it fits.

    ``rows`` has the token codes in ``codes``. The shifted arrays are zipped once; all masks hash
    their tokens from the same row.
    """
    offsets = sorted({o for m in masks for o in m})
    shifted = [F.slice("codes", o + 1, F.size("codes")).alias(f"t{o}") for o in offsets]
    at = rows.select(*keys, F.posexplode(F.arrays_zip(*shifted)).alias("pos", "t"))
    hashes = [F.when(F.col(f"t.t{max(m)}").isNotNull(), F.xxhash64(F.lit(k), *[F.col(f"t.t{o}") for o in m])) for k, m in enumerate(masks)]
    each = at.select(*keys, "pos", F.posexplode(F.array(*hashes)).alias("mask", "hash"))
    return each.where("hash is not null")


def find_overlaps(docs: DataFrame, benchmark: DataFrame, broadcast_seeds: int = 1_000_000) -> DataFrame:
    """Pairs of a document and a benchmark item that share a passage up to substitutions.

    A document overlaps an item if 15 aligned tokens agree in all but at most two places. Each mask
    is hashed at every position of texts and items, and equal hashes are joined; the mask family is
    lossless, so every such passage gives a hit. A hit names a diagonal, along which the whole item
    is laid over the text and every window of 15 is counted. Items shorter than 15 tokens must occur
    as a whole and exactly; they get a mask of their own length.

    The table of distinct seed hashes is sent to all executors only if it has at most
    ``broadcast_seeds`` rows (it is counted), else the positions are shuffled by hash. Texts are
    read twice, whole; the second time only those with hits are compared.

    Returns ``doc_id, h1, h2, n`` (text key), ``item_id, matches`` (most agreeing tokens in a window)
    and ``start, end`` (token range of the item in the text, cut to the text). Null or empty texts
    and items overlap nothing. Documents that repeat id and text give one row per item, as do items
    that repeat id and text. Empty tables give an empty result; further columns are ignored.
    """
    items = benchmark.select("item_id", token_codes(text_of()).alias("item")).where("size(item) > 0").distinct()
    items = save(items, "items")
    short = [r.n for r in items.where(F.size("item") < WINDOW).select(F.size("item").alias("n")).distinct().orderBy("n").collect()]
    masks = [*MASKS, *[tuple(range(n)) for n in short]]
    seeds = _seeds(items.select("item_id", F.col("item"), F.col("item").alias("codes")), ["item_id", "item"], masks)
    # a mask for short items is used for items of that very length
    length = F.array(*[F.lit(0)] * len(MASKS), *[F.lit(n) for n in short])[F.col("mask")]
    fits = F.when(length == 0, F.size("item") >= WINDOW).otherwise(F.size("item") == length)
    seeds = save(seeds.where(fits).select("item_id", "item", F.col("pos").alias("item_pos"), "mask", "hash"), "seeds")
    known = seeds.select("mask", "hash").distinct()
    if known.count() <= broadcast_seeds:
        known = F.broadcast(known)

    texts = docs.select("doc_id", text_of().alias("text")).select("doc_id", text_key(F.col("text")).alias("k"), "text")
    coded = texts.select("doc_id", "k.*", token_codes(F.col("text")).alias("codes"))
    key = ["doc_id", "h1", "h2", "n"]
    hits = save(_seeds(coded, key, masks).join(known, ["mask", "hash"], "left_semi"), "hits")
    diagonal = (F.col("pos") - F.col("item_pos")).alias("shift")
    found = hits.join(seeds, ["mask", "hash"]).select(*key, "item_id", "item", diagonal).distinct()
    found = save(found.groupBy(*key).agg(F.collect_list(F.struct("item_id", "item", "shift")).alias("found")), "found")

    # whole texts meet their hits by key, with one plan for all sizes; only texts with hits are tokenised again
    renamed = found.select(*[F.col(c).alias(f"f_{c}") for c in key], "found").hint("merge")
    plain = texts.select("doc_id", "k.*", "text")
    on = [plain[c].eqNullSafe(renamed[f"f_{c}"]) if c == "doc_id" else plain[c] == renamed[f"f_{c}"] for c in key]
    both = plain.join(renamed, on).select(*key, token_codes(F.col("text")).alias("codes"), "found")
    # the part of the text that the item covers when it is laid along the diagonal
    both = both.select(*key, F.expr("""transform(found, x -> struct(x.item_id AS item_id, x.item AS item, x.shift AS shift,
        slice(codes, greatest(0, x.shift) + 1, size(x.item) - greatest(0, -x.shift)) AS lain))""").alias("found"))
    one = both.select(*key, F.explode("found").alias("x")).select(*key, "x.*").distinct()
    own = F.slice("item", F.greatest(F.lit(0), -F.col("shift")) + 1, F.size("lain"))
    same = F.zip_with(own, "lain", lambda a, b: (a == b).cast("int"))
    one = one.withColumn("same", same).withColumn("w", F.least(F.lit(WINDOW), F.size("item")))
    windows = F.when(F.size("same") >= F.col("w"), F.expr(
        "array_max(transform(sequence(1, size(same) - w + 1), i -> aggregate(slice(same, i, w), 0, (a, b) -> a + b)))"))
    need = F.when(F.size("item") >= WINDOW, WINDOW - SUBSTITUTIONS).otherwise(F.size("item"))
    start = F.greatest(F.lit(0), F.col("shift"))
    ok = one.withColumn("matches", windows).where(F.col("matches") >= need).select(
        *key, "item_id", "matches", start.alias("start"), (start + F.size("lain")).alias("end"))
    best = F.max(F.struct("matches", (-F.col("start")).alias("before"), "end")).alias("b")
    return ok.groupBy(*key, "item_id").agg(best).select(
        *key, "item_id", F.col("b.matches").alias("matches"), (-F.col("b.before")).alias("start"), F.col("b.end").alias("end"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that overlap an item; all columns stay, whatever their names.

    A null or empty text overlaps nothing; rows that repeat id and text go or stay together; an empty table of
    documents or items changes nothing.
    """
    found = find_overlaps(docs, benchmark).select(F.col("doc_id").alias("d"), F.struct("h1", "h2", "n").alias("k")).distinct()
    full = docs.select(F.struct("*").alias("doc"), "doc_id", text_key(text_of()).alias("tk"))
    return full.join(found, full.doc_id.eqNullSafe(found.d) & (full.tk == found.k), "left_anti").select("doc.*")
