"""Mixing of sources to target weights by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, save, text_of

WEIGHTS = [5, 2, 1]


def source_targets(sizes: DataFrame, weights: list[int], share: int, cap: int) -> DataFrame:
    """Target of each source: ``share`` per cent of all sizes by weight, none above ``cap`` times its size.

    ``sizes`` has one row per source (``source, source_size``). Weights repeat over the sources in
    code-point order, null last. Sources are ordered by the level at which they reach their cap; the
    level of the others follows from cumulative sums.
    """
    named = F.array(*[F.lit(w) for w in weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", named[F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))].cast("long"))
    full = F.col("source_size") * cap
    by_level = Window.orderBy((full / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(0, Window.unboundedFollowing)
    w = w.select(
        "*", full.alias("full"), F.row_number().over(by_level).alias("at"),
        # hundredths of words left for this source and those after it
        (F.sum("source_size").over(everything) * share - 100 * F.coalesce(F.sum(full).over(before), F.lit(0))).alias("left"),
        F.sum("weight").over(onward).alias("open"))
    fits = F.col("left") * F.col("weight") <= F.col("full") * F.col("open") * 100
    first = F.min(F.when(fits, F.struct("at", "left", "open"))).over(everything)
    w = w.withColumn("cut", first)
    target = F.when(F.col("at") < F.col("cut.at"), F.col("full").cast("double")).otherwise(
        (F.col("cut.left") * F.col("weight")).cast("double") / (F.lit(100.0) * F.col("cut.open")))
    return w.select("source", "source_size", target.alias("target"))


def _split_tree(quotas: DataFrame, depth: int, seed: str) -> DataFrame:
    """Leaf quotas: ``(source, units)`` to ``(source, shard, quota)``.

    At each node of a binary tree, half of the node's units go left. Which ones, a seeded order of
    the units decides, so the number of units of each source that goes left is a draw from the
    multivariate hypergeometric distribution, and quotas stay exact.
    """
    units = quotas.select("source", F.explode(F.sequence(F.lit(1), F.col("units").cast("int"))).alias("unit"), F.lit(1).alias("node"))
    for level in range(depth):
        draw = F.md5(F.concat_ws("|", F.lit(f"{seed}-tree-{level}"), F.coalesce("source", F.lit("")), F.col("unit").cast("string")))
        node = Window.partitionBy("node")
        rank = F.row_number().over(node.orderBy(draw, F.col("source").asc_nulls_last(), "unit"))
        right = rank > F.ceil(F.count("*").over(node) / 2)
        units = units.withColumn("node", F.col("node") * 2 + right.cast("int"))
    return units.groupBy("source", (F.col("node") - 2**depth).alias("shard")).agg(F.count("*").alias("quota"))


def mix(docs: DataFrame, weights: list[int] | None = None, share: int = 150, cap: int = 2, shard_bits: int = 4,
        blocks: int = 16384, seed: str = "mix") -> DataFrame:
    """Draw a mix of all sources and lay it out over ``2 ** shard_bits`` output shards.

    A source's documents are dealt to blocks by a hash; a source has its share of ``blocks``, one at
    least. A source takes whole passes over its blocks, then blocks in a seeded order until its
    target is met; in the block that crosses the target, documents follow in hash order, and the last
    one gives only the words still needed, so each source meets its rounded target. The units drawn
    (block copies) are divided among the shards by a splitting tree, and each shard then gets the
    next blocks of the source's seeded order: shards are disjoint in block copies.

    Tables of blocks, quotas and shards have at most about ``2 * blocks + sources`` rows whatever
    the input, so ordering them in one task is safe; documents are only grouped, joined by block,
    and ordered inside the one crossing block of each source.

    Returns one row per input row: ``doc_id, source, rank, size, source_size, target, taken,
    shards``. ``shards`` lists the shard of each copy as text, in order of the copies. Null texts and
    texts without words have size 0 and nothing is taken. Null sources form one source, null ids are
    told apart by text. Rows that repeat id, source and text are ordered arbitrarily but taken as one
    set. An empty table gives an empty result; further columns are ignored.
    """
    text = text_of()
    rank = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.encode(text, "UTF-8"))))
    rows = save(docs.select("doc_id", "source", rank.alias("rank"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size")), "sizes")
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    share_of = F.ceil(F.col("n") * blocks / F.sum("n").over(Window.partitionBy())).cast("long")
    targets = source_targets(per_source.select("source", "source_size"), weights or WEIGHTS, share, cap)
    plan = per_source.select(F.col("source").alias("s"), share_of.alias("n_blocks"))
    plan = targets.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    words = F.floor(F.col("target") + 0.5)
    passes = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(F.lit(0))
    plan = save(plan.select("*", passes.alias("passes"), (words - passes * F.col("source_size")).alias("rest")), "plan")

    to_plan = plan.select(F.col("source").alias("s"), "n_blocks", "source_size", "target", "passes", "rest")
    placed = rows.join(to_plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    block = F.pmod(F.conv(F.substring("rank", 1, 8), 16, 10).cast("long"), F.col("n_blocks"))
    placed = placed.withColumn("block", block)

    source_order = F.md5(F.concat_ws("|", F.lit(f"{seed}-block"), F.coalesce("source", F.lit("")), F.col("block").cast("string")))
    in_source = Window.partitionBy("source").orderBy(source_order, "block")
    b = placed.groupBy("source", "block").agg(F.sum("size").alias("words"), F.first("passes").alias("passes"), F.first("rest").alias("rest"))
    b = b.withColumns({"end": F.sum("words").over(in_source), "ord": F.row_number().over(in_source)})
    extra = F.least("words", F.greatest(F.lit(0), F.col("rest") - F.col("end") + F.col("words")))
    b = b.withColumn("extra", extra)
    copies = F.col("passes") + (F.col("extra") > 0).cast("long")
    b = save(b.withColumn("copies", F.when(F.col("words") > 0, copies).otherwise(0)), "blocks")

    # one row per block copy, numbered per source: pass by pass in the source's order
    pass_order = Window.partitionBy("source").orderBy("copy", "ord")
    drawn = b.where("copies > 0").select("source", "block", "ord", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    drawn = drawn.withColumn("k", F.row_number().over(pass_order))
    quotas = _split_tree(drawn.groupBy("source").agg(F.count("*").alias("units")), shard_bits, seed)
    upto = F.sum("quota").over(Window.partitionBy("source").orderBy("shard"))
    seats = quotas.withColumn("upto", upto).select(
        F.col("source").alias("s"), "shard", F.explode(F.sequence(F.col("upto") - F.col("quota") + 1, F.col("upto"))).alias("seat"))
    drawn = drawn.join(seats, F.col("source").eqNullSafe(F.col("s")) & (F.col("k") == F.col("seat")))
    shards = drawn.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("copy", "shard"))).alias("places"))
    decided = b.join(shards.select(F.col("source").alias("s"), F.col("block").alias("bl"), "places"),
                     F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("bl")), "left")
    decided = save(decided.select(F.col("source").alias("s"), F.col("block").alias("bl"), "words", "extra", "places"), "decided")

    out = placed.join(decided, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("bl")))
    crossing = (F.col("extra") > 0) & (F.col("extra") < F.col("words"))
    columns = ["doc_id", "source", "rank", "size", "source_size", "target", "taken", "shards"]

    def finish(df: DataFrame, more) -> DataFrame:
        taken = F.col("passes") * F.col("size") + more
        n = F.when(F.col("size") > 0, F.col("passes") + (more > 0).cast("long")).otherwise(0)
        listed = F.transform(F.slice(F.coalesce("places", F.array()), F.lit(1), n.cast("int")), lambda p: p["shard"].cast("string"))
        return df.withColumns({"taken": taken, "shards": F.concat_ws(",", listed)}).select(columns)

    inside = Window.partitionBy("source", "block").orderBy("rank", F.col("doc_id").asc_nulls_last())
    cut = out.where(crossing).withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    part = F.least("size", F.greatest(F.lit(0), F.col("extra") - F.col("upto") + F.col("size")))
    whole = finish(out.where(~crossing), F.when(F.col("extra") > 0, F.col("size")).otherwise(F.lit(0)))
    return whole.unionByName(finish(cut, part))


def write_shards(docs: DataFrame, mixed: DataFrame, path: str, seed: str = "mix") -> None:
    """Write the copies of ``docs`` that ``mix`` drew, one folder per shard, shuffled inside each file.

    Rows meet their decision by id, source and text rank; a shard is spread over many files. The
    document that fills its source up is written whole, with ``taken`` beside it. Documents without words are in no
    shard; repeated rows are written as often as they occur; an empty table writes no row.
    """
    text = text_of()
    rank = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.encode(text, "UTF-8"))))
    d = docs.select(F.struct("*").alias("doc"), rank.alias("r"), F.col("source").alias("s"))
    m = mixed.where("taken > 0").select("rank", "source", "taken", "shards").distinct()
    both = d.join(m, (d.r == m["rank"]) & d.s.eqNullSafe(m["source"]))
    copies = both.select("doc", "taken", "rank", F.posexplode(F.split("shards", ",")).alias("copy", "shard"))
    place = F.md5(F.concat_ws("|", F.lit(f"{seed}-place"), "shard", "copy", "rank"))
    copies.withColumn("place", place).hint("rebalance", "shard").sortWithinPartitions("shard", "place").write.partitionBy("shard").parquet(path)
