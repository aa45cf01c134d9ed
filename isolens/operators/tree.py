"""Distances on a tree given as an edge table (child, parent, length)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage, saved
from .ranking import exact_rank, hash_bucket, hash_order
from .relations import unique_or_fail


def ancestor_paths(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, ancestor, dist, hops) for every ancestor, by path doubling; 2^rounds levels are reached.

    Each round joins the paths that end at the frontier with all known paths and is checkpointed,
    so lineage stays short and a lost executor does not replay the climb.
    """
    step = edges.select(F.col("child").alias("node"), F.col("parent").alias("anc"), F.col("length").alias("dist"), F.lit(1).alias("hops"))
    known, reach = step, 1
    for _ in range(max_rounds):
        tails = known.select(F.col("node").alias("anc"), F.col("anc").alias("anc2"), F.col("dist").alias("d2"), F.col("hops").alias("h2"))
        longer = known.where(F.col("hops") == reach).join(tails, "anc").select(
            "node", F.col("anc2").alias("anc"), (F.col("dist") + F.col("d2")).alias("dist"), (F.col("hops") + F.col("h2")).alias("hops"))
        longer = cut_lineage(longer)
        if longer.isEmpty():
            return known
        known, reach = cut_lineage(known.unionByName(longer)), reach * 2
    raise ValueError("tree deeper than 2^max_rounds levels, or not a tree")


@dataclass(frozen=True)
class TreeIndex:
    """Jump tables of a tree: ``levels[j]`` has (node, up), the ancestor 2^j steps up; ``nodes`` has (node, parent, depth, dist) with the distance from the root."""

    levels: tuple[DataFrame, ...]
    nodes: DataFrame


def tree_index(edges: DataFrame, max_rounds: int = 40) -> TreeIndex:
    """Jump tables by doubling: log2(depth) rounds, and as many rows a node at most.

    Each round joins the last level with itself and every node's climb with the climb of the node it
    has reached; both are checkpointed. A child with two parents fails.
    """
    edges = unique_or_fail(edges.select(F.col("child").alias("node"), F.col("parent").alias("up"), "length"), "node", "edges")
    edges = saved(edges, "edges")
    levels = [edges.select("node", "up")]
    roots = edges.select(F.col("up").alias("node")).distinct().join(edges.select("node"), "node", "left_anti")
    zero = F.lit(0).cast(edges.schema["length"].dataType)
    climb = edges.select("node", F.col("up").alias("top"), F.lit(1).cast("long").alias("hops"), F.col("length").alias("dist"))
    while True:
        last = levels[-1]
        longer = saved(last.join(last.select(F.col("node").alias("up"), F.col("up").alias("up2")), "up").select("node", F.col("up2").alias("up")), "level")
        climb = saved(_doubled(climb), "climb")
        if longer.isEmpty():
            break
        if len(levels) >= max_rounds:
            raise ValueError("tree deeper than 2^max_rounds levels, or not a tree")
        levels.append(longer)
    nodes = climb.join(edges.select("node", F.col("up").alias("parent")), "node").select("node", "parent", F.col("hops").alias("depth"), "dist")
    nodes = nodes.unionByName(roots.select("node", F.lit(None).cast(edges.schema["up"].dataType).alias("parent"), F.lit(0).cast("long").alias("depth"), zero.alias("dist")))
    return TreeIndex(tuple(levels), saved(nodes, "nodes"))


def _doubled(climb: DataFrame) -> DataFrame:
    """Each (node, top, hops, dist) goes on from where its top has come to."""
    on = climb.select(F.col("node").alias("top"), F.col("top").alias("top2"), F.col("hops").alias("hops2"), F.col("dist").alias("dist2"))
    zero = F.lit(0).cast(climb.schema["dist"].dataType)
    return climb.join(on, "top", "left").select(
        "node", F.coalesce("top2", "top").alias("top"), (F.col("hops") + F.coalesce("hops2", F.lit(0).cast("long"))).alias("hops"), (F.col("dist") + F.coalesce("dist2", zero)).alias("dist"))


def pairwise_tree_distance(index: TreeIndex, pairs: DataFrame, scale: float = 1.0) -> DataFrame:
    """Path length between the two nodes of each given pair (columns a, b).

    The deeper node is lifted to the other's depth, then both climb together below their lowest common
    ancestor, by jumps of falling size. Pairs without a common root, or with an unknown node, are left out.
    """
    side = {c: index.nodes.select(F.col("node").alias(c), F.col("depth").alias(f"d{c}"), F.col("dist").alias(f"r{c}")) for c in "ab"}
    p = pairs.select("a", "b").distinct().join(side["a"], "a").join(side["b"], "b")
    deep = F.col("da") >= F.col("db")
    p = p.select("a", "b", (F.col("ra") + F.col("rb")).alias("sum"), F.when(deep, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(deep, F.col("b")).otherwise(F.col("a")).alias("y"),
                 F.abs(F.col("da") - F.col("db")).alias("gap"), F.least("da", "db").alias("depth"))

    def jump(j: int, c: str) -> DataFrame:
        return index.levels[j].select(F.col("node").alias(c), F.col("up").alias(f"{c}2"))

    for j in reversed(range(len(index.levels))):
        bit = F.shiftright("gap", j) % 2 == 1
        lifted = p.where(bit).join(jump(j, "x"), "x").select("a", "b", "sum", F.col("x2").alias("x"), "y", "gap", "depth")
        p = lifted.unionByName(p.where(~bit))
        p = saved(p, "pairs")
    for j in reversed(range(len(index.levels))):
        climbs = (F.col("x") != F.col("y")) & (F.col("depth") >= 1 << j)
        up = p.where(climbs).join(jump(j, "x"), "x").join(jump(j, "y"), "y")
        moved = F.col("x2") != F.col("y2")
        up = up.select("a", "b", "sum", *[F.when(moved, F.col(f"{c}2")).otherwise(F.col(c)).alias(c) for c in "xy"], "gap",
                       F.when(moved, F.col("depth") - (1 << j)).otherwise(F.col("depth")).alias("depth"))
        p = up.unionByName(p.where(~climbs))
        p = saved(p, "pairs")
    met = p.where("x = y").select("a", "b", "sum", F.col("x").alias("node"))
    apart = p.where("x <> y").join(index.levels[0].select(F.col("node").alias("x"), F.col("up").alias("node")), "x")
    apart = apart.join(index.levels[0].select(F.col("node").alias("y"), F.col("up").alias("other")), "y").where("node = other").select("a", "b", "sum", "node")
    both = met.unionByName(apart).join(index.nodes.select("node", "dist"), "node")
    return both.select("a", "b", ((F.col("sum") - 2 * F.col("dist")) * scale).alias("distance"))


def distance_summary(paths: DataFrame, tips: DataFrame, group: str) -> DataFrame:
    """Per group: tips, pairs, smallest, median and largest distance over all pairs inside the group.

    No pair is ever formed.  Below every ancestor the tips are counted by depth; two depth
    histograms give the number of pairs at each distance, minus the pairs that already met lower
    down.  Needs whole-number edge lengths (sites), which bounds a histogram by the tree height.
    """
    t = tips.select(F.col("tip").alias("node"), group)
    up = paths.join(t, "node")
    # depth histogram below each ancestor, and below each child of it (the branch the tip came by)
    own = t.select("node", group, F.col("node").alias("anc"), F.lit(0).cast(paths.schema["dist"].dataType).alias("dist"))
    hist = (up.select(group, "anc", "dist").unionByName(own.select(group, "anc", "dist"))
            .groupBy(group, "anc", "dist").agg(F.count(F.lit(1)).alias("c")))
    parent = paths.where("hops = 1").select(F.col("node").alias("anc"), F.col("anc").alias("up"), F.col("dist").alias("edge"))
    branch = hist.join(parent, "anc").select(group, F.col("up").alias("anc"), F.col("anc").alias("via"), (F.col("dist") + F.col("edge")).alias("dist"), "c")

    def sums(h: DataFrame, key: list[str]) -> DataFrame:
        x = h.select(*key, F.col("dist").alias("d1"), F.col("c").alias("c1"))
        y = h.select(*key, F.col("dist").alias("d2"), F.col("c").alias("c2"))
        return x.join(y, key).groupBy(group, (F.col("d1") + F.col("d2")).alias("distance")).agg(F.sum(F.col("c1") * F.col("c2")).alias("n"))

    ordered = sums(hist, [group, "anc"]).unionByName(sums(branch, [group, "anc", "via"]).withColumn("n", -F.col("n")))
    d = ordered.groupBy(group, "distance").agg(F.sum("n").alias("n"))
    # what is left at each tip itself is its distance 0 to itself; every other pair is counted twice
    n_tips = t.groupBy(group).agg(F.count(F.lit(1)).alias("n_tips"))
    d = d.join(n_tips, group).withColumn("n", F.when(F.col("distance") == 0, F.col("n") - F.col("n_tips")).otherwise(F.col("n")))
    d = d.withColumn("n", F.floor(F.col("n") / 2).cast("bigint")).where("n > 0")
    run = W.partitionBy(group).orderBy("distance").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("cum", F.sum("n").over(run)).withColumn("pairs", F.sum("n").over(W.partitionBy(group)))
    lo, hi = F.floor((F.col("pairs") + 1) / 2), F.floor(F.col("pairs") / 2) + 1
    return d.groupBy(group).agg(
        F.first("n_tips").alias("n_tips"), F.first("pairs").alias("n_pairs"), F.min("distance").alias("min_distance"),
        ((F.min(F.when(F.col("cum") >= lo, F.col("distance"))) + F.min(F.when(F.col("cum") >= hi, F.col("distance")))) / 2.0).alias("median_distance"),
        F.max("distance").alias("max_distance"))


# --- order statistics over all pairs, for lengths of any kind ----------------------------------

#: Steps of the fixed-point scale of real lengths, as powers of two of the largest distance from the root.
SCALE_BITS = 50
#: A group's pairs are listed once no more than this many are left; and how many are drawn for pivots before that.
LISTED, DRAWN = 200_000, 1 << 16
#: Pivots lie so many standard deviations of a drawn rank from the median's.
AWAY = 4.0
BINS = 4096


def _kept(df: DataFrame) -> DataFrame:
    return saved(df, "tree")


def _heavy_paths(index: TreeIndex, tips: DataFrame) -> DataFrame:
    """(node, head, pos, dist, above): the heavy path that each node over a tip is on, its place on it, and the node above the path's head."""
    size = _kept(tips.select(F.col("tip").alias("node")).distinct().join(index.nodes.select("node"), "node").withColumn("n", F.lit(1).cast("long")))
    for level in index.levels:
        below = level.join(size, "node").select(F.col("up").alias("node"), "n")
        size = _kept(size.unionByName(below).groupBy("node").agg(F.sum("n").alias("n")))
    over = index.nodes.join(size, "node")
    heavy = over.where("parent IS NOT NULL").groupBy("parent").agg(F.max_by("node", F.struct("n", "node")).alias("node"))
    path = _kept(heavy.select("node", F.col("parent").alias("top"), F.lit(1).cast("long").alias("hops"), F.lit(0).cast("long").alias("dist")))
    for _ in index.levels:
        path = _kept(_doubled(path))
    on = over.select("node", "dist").join(path.select("node", "top", "hops"), "node", "left").select(
        "node", F.coalesce("top", "node").alias("head"), F.coalesce("hops", F.lit(0).cast("long")).alias("pos"), "dist")
    return _kept(on.join(index.nodes.select(F.col("node").alias("head"), F.col("parent").alias("above")), "head", "left"))


def _pair_cells(index: TreeIndex, tips: DataFrame, group: str) -> tuple[DataFrame, DataFrame, float]:
    """Cells of left and right values so that each pair of tips of a group is one left and one right row of one cell, its distance their sum.

    On its way to the root a tip passes few heavy paths. On a path, tips enter in an order of slots (place,
    branch); two tips of different slots part at the upper one's place, so their distance is a value of the
    upper tip plus one of the lower. Slot numbers that first differ in some bit make the cell, the bit the side.
    """
    way = _heavy_paths(index, tips)
    whole = index.nodes.schema["dist"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    top = index.nodes.agg(F.max("dist")).first()[0]
    scale = 1.0 if whole else 2.0**SCALE_BITS / max(float(top or 0), 1e-300)
    fixed = F.col("dist") if whole else F.round(F.col("dist") * scale)
    way = way.withColumn("dist", fixed.cast("long"))
    at = tips.select("tip", group).distinct().join(way.select(F.col("node").alias("tip"), F.col("dist").alias("dt")), "tip")
    at = at.select("tip", group, "dt", F.col("tip").alias("node"), F.col("tip").alias("via"))
    parts = []
    while not at.isEmpty():
        entered = _kept(at.join(way, "node").select("tip", group, "dt", F.col("head").alias("path"), "pos", "via", F.col("dist").alias("di"), "above"))
        parts.append(entered.drop("above"))
        at = entered.where("above IS NOT NULL").select("tip", group, "dt", F.col("above").alias("node"), F.col("path").alias("via"))
    rows = reduce(DataFrame.unionByName, parts)
    slots = rows.select("path", "pos", "via").distinct()
    h = hash_order("via", 7)
    slots = exact_rank(slots.withColumn("__h", h), "path", [F.col("pos"), F.col("__h"), F.col("via")], F.struct("pos", hash_bucket(F.col("__h"))), "slot")
    slots = _kept(slots.select("path", "pos", "via", (F.col("slot") - 1).alias("slot")))
    last = slots.groupBy("path").agg(F.max("slot").alias("last")).where("last > 0")
    rows = rows.join(slots, ["path", "pos", "via"]).join(last, "path")
    bits = F.sequence(F.lit(0), F.length(F.bin("last")) - 1)
    rows = rows.select(group, "path", "slot", "dt", "di", F.explode(bits).alias("bit"))
    side = F.expr("shiftright(slot, bit)") % 2
    rows = rows.select(group, "path", "bit", F.expr("shiftright(slot, bit + 1)").alias("block"), side.alias("side"), F.when(side == 0, F.col("dt") - 2 * F.col("di")).otherwise(F.col("dt")).alias("v"))
    rows = _kept(rows)
    key = [group, "path", "bit", "block"]
    left, right = F.col("side") == 0, F.col("side") == 1
    cells = rows.groupBy(*key).agg(
        F.count_if(left).alias("n_left"), F.count_if(right).alias("n_right"),
        *[f(F.when(c, F.col("v"))).alias(n) for n, f, c in (("low_left", F.min, left), ("low_right", F.min, right), ("high_left", F.max, left), ("high_right", F.max, right))])
    cells = _kept(cells.where("n_left > 0 AND n_right > 0").withColumn("cell", F.monotonically_increasing_id()))
    rows = _kept(rows.join(cells.select(*key, "cell", "n_right"), key).select("cell", group, "side", "v", "n_right"))
    return cells, rows, scale


def _counted(rights: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """``queries`` (cell, x, ...) with ``cnt``: right values of the cell up to x. Values are counted by bin, and ordered within one bin of one cell only."""
    width = top // BINS + 1

    def binned(v: str) -> Column:
        return F.floor(F.least(F.greatest(F.col(v), F.lit(-1)), F.lit(top)) / width)

    names = [c for c in queries.columns if c not in ("cell", "x")]
    u = rights.select("cell", F.col("v").alias("x"), binned("v").alias("b"), F.lit(1).alias("is"), *[F.lit(None).cast(queries.schema[c].dataType).alias(c) for c in names])
    u = u.unionByName(queries.select("cell", "x", binned("x").alias("b"), F.lit(0).alias("is"), *names))
    sizes = u.groupBy("cell", "b").agg(F.sum("is").alias("n"))
    before = W.partitionBy("cell").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("cell", "b", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("before"))
    upto = W.partitionBy("cell", "b").orderBy("x", F.desc("is")).rowsBetween(W.unboundedPreceding, 0)
    return u.join(sizes, ["cell", "b"]).withColumn("cnt", F.sum("is").over(upto) + F.col("before")).where("is = 0").select(*queries.columns, "cnt")


def distance_order_summary(index: TreeIndex, tips: DataFrame, group: str) -> DataFrame:
    """Per group: tips, pairs, smallest, median and largest distance over all pairs inside the group, for lengths of any kind and trees of any depth.

    No pair is formed beyond ``LISTED`` of a group. Pairs up to a value are counted by sorted merges in each
    cell; pivots from pairs drawn near the median narrow the range that holds it by a factor of some
    sixty a round, and ties end on a range of one value. Whole lengths are exact; real ones are rounded to 2^-50
    of the tree's height. Groups of one tip, and pairs in different trees, have no distance.
    """
    cells, rows, scale = _pair_cells(index, tips, group)
    totals = cells.groupBy(group).agg(
        F.sum(F.col("n_left") * F.col("n_right")).alias("pairs"), F.min(F.col("low_left") + F.col("low_right")).alias("low"), F.max(F.col("high_left") + F.col("high_right")).alias("high"))
    totals = saved(totals.withColumns({"k1": F.expr("(pairs + 1) DIV 2"), "k2": F.expr("pairs DIV 2 + 1")}), "totals")
    top = cells.agg(F.coalesce(F.max("high_right"), F.lit(0))).first()[0]
    rights = rows.where("side = 1").select("cell", "v")
    rights = _kept(exact_rank(rights, "cell", [F.col("v")], F.floor(F.col("v") / (top // BINS + 1)), "idx").withColumn("idx", (F.col("idx") - 1).cast("long")))
    lefts = rows.where("side = 0").select(group, "cell", "v", F.lit(0).cast("long").alias("lo"), F.col("n_right").alias("hi"))
    lefts = every = _kept(lefts.withColumn("lid", F.monotonically_increasing_id()))
    # pairs up to ``vlo`` are c_lo < k1, pairs up to ``vhi`` c_hi >= k1
    range_ = totals.select(group, "k1", "k2", F.lit(0).cast("long").alias("c_lo"), F.col("pairs").alias("c_hi"), (F.col("low") - 1).alias("vlo"), F.col("high").alias("vhi"))
    turn = 0
    while True:
        range_ = saved(range_, "range")
        opened = range_.where((F.col("vhi") - F.col("vlo") > 1) & (F.col("c_hi") - F.col("c_lo") > LISTED))
        if opened.isEmpty():
            break
        turn += 1
        here = lefts.join(opened, group)
        want = (F.col("hi") - F.col("lo")) * F.lit(float(DRAWN)) / (F.col("c_hi") - F.col("c_lo"))
        n = (F.floor(want) + (F.pmod(F.xxhash64("lid", F.lit(turn)), F.lit(1 << 20)) < (want - F.floor(want)) * (1 << 20)).cast("long")).cast("int")
        drawn = here.where(n > 0).select(group, "cell", "v", "lo", "hi", "lid", F.explode(F.sequence(F.lit(1), n)).alias("i"))
        drawn = drawn.select(group, "cell", F.col("v").alias("left"), (F.col("lo") + F.pmod(F.xxhash64("lid", "i", F.lit(turn)), F.col("hi") - F.col("lo"))).alias("idx"))
        drawn = saved(drawn, "drawn")  # a small table, so the right values stay where they are
        found = drawn.join(rights, ["cell", "idx"]).groupBy(group).agg(F.array_sort(F.collect_list(F.col("left") + F.col("v"))).alias("d"))
        share = (F.col("k1") - F.col("c_lo")) / (F.col("c_hi") - F.col("c_lo"))
        at = F.transform(F.array(F.lit(-AWAY), F.lit(AWAY)), lambda x: F.greatest(F.lit(1), F.least(F.size("d"), (share * F.size("d") + x * F.sqrt(F.size("d") * share * (1 - share))).cast("int"))))
        near = F.flatten(F.transform(at, lambda i: F.array(F.element_at("d", i) - 1, F.element_at("d", i))))
        middle = F.expr("vlo + (vhi - vlo) DIV 2")
        pivots = opened.join(found, group, "left").select(group, "vlo", "vhi", "k1", "c_lo", F.explode(F.array_distinct(F.array_append(F.coalesce(near, F.array().cast("array<bigint>")), middle))).alias("p"))
        pivots = saved(pivots.where("p > vlo AND p < vhi").select(group, "p"), "pivots")
        queries = lefts.join(pivots, group).select("cell", (F.col("p") - F.col("v")).alias("x"), group, "p", "lid", "lo")
        counts = _kept(_counted(rights, queries, top))
        sums = counts.groupBy(group, "p").agg(F.sum(F.col("cnt") - F.col("lo")).alias("more")).join(opened, group).withColumn("c", F.col("c_lo") + F.col("more"))
        low = F.col("c") < F.col("k1")
        cut = saved(sums.groupBy(group).agg(
            F.max(F.when(low, F.struct("p", "c"))).alias("a"), F.min(F.when(~low, F.struct("p", "c"))).alias("b")), "cut")
        range_ = range_.join(cut, group, "left").select(
            group, "k1", "k2", F.coalesce("a.c", "c_lo").alias("c_lo"), F.coalesce("b.c", "c_hi").alias("c_hi"), F.coalesce("a.p", "vlo").alias("vlo"), F.coalesce("b.p", "vhi").alias("vhi"))
        new = counts.join(cut, group).groupBy("lid").agg(
            F.max(F.when(F.col("p") == F.col("a.p"), F.col("cnt"))).alias("lo2"), F.max(F.when(F.col("p") == F.col("b.p"), F.col("cnt"))).alias("hi2"))
        lefts = lefts.join(new, "lid", "left").select("lid", group, "cell", "v", F.coalesce("lo2", "lo").alias("lo"), F.coalesce("hi2", "hi").alias("hi"))
        lefts = _kept(lefts.where("hi > lo"))

    few = range_.where((F.col("vhi") - F.col("vlo") > 1) & (F.col("c_hi") > F.col("c_lo")))
    listed = lefts.join(few, group).select(group, "cell", "k1", "k2", "c_lo", F.col("v").alias("left"), F.explode(F.sequence("lo", F.col("hi") - 1)).alias("idx"))
    listed = listed.join(rights, ["cell", "idx"]).select(group, "k1", "k2", "c_lo", (F.col("left") + F.col("v")).alias("d"))
    listed = listed.withColumn("k", F.row_number().over(W.partitionBy(group).orderBy("d")) + F.col("c_lo"))
    listed = listed.groupBy(group).agg(F.min(F.when(F.col("k") == F.col("k1"), F.col("d"))).alias("x1"), F.min(F.when(F.col("k") == F.col("k2"), F.col("d"))).alias("x2"))
    one = (F.col("vhi") - F.col("vlo") == 1).alias("one")
    done = range_.join(listed, group, "left").select(
        group, "k1", "k2", F.when(one, F.col("vhi")).otherwise(F.col("x1")).alias("x1"), F.when(one & (F.col("c_hi") >= F.col("k2")), F.col("vhi")).otherwise(F.col("x2")).alias("x2"))
    done = saved(done, "done")
    # the upper median lies beyond the range: the next value above the lower one
    short = done.where("x2 IS NULL").select(group, "x1")
    if not short.isEmpty():
        queries = every.join(short, group).select("cell", (F.col("x1") - F.col("v")).alias("x"), group, "v")
        after = _counted(rights, queries, top).select(group, "cell", F.col("v").alias("left"), F.col("cnt").alias("idx"))
        after = after.join(rights, ["cell", "idx"]).groupBy(group).agg(F.min(F.col("left") + F.col("v")).alias("after"))
        done = done.join(after, group, "left").withColumn("x2", F.coalesce("x2", "after")).drop("after")
    n_tips = tips.select("tip", group).distinct().groupBy(group).agg(F.count(F.lit(1)).alias("n_tips"))
    out = totals.select(group, "pairs", "low", "high").join(done, group).join(n_tips, group)
    return out.select(group, "n_tips", F.col("pairs").alias("n_pairs"), (F.col("low") / scale).alias("min_distance"),
                      ((F.col("x1") + F.col("x2")) / (2.0 * scale)).alias("median_distance"), (F.col("high") / scale).alias("max_distance"))
