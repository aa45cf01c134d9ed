"""The prefix trie of conversations, by ROLLUP over columns of turn ids.

A conversation is laid out in blocks of ``WIDTH`` turns: one row with a column for each turn, keyed by
the node that the block before it ends in. One ROLLUP over (key, first turn, second turn, ...) then
aggregates all prefixes of all blocks together, and grouping_id tells how many turns a row covers. A
node's key follows from its turns alone (XOR of 128-bit hashes of each turn and its place), so the
blocks of long conversations need no rounds one after another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ranking import exact_rank
from .common import save

WIDTH = 4
#: Blocks of a conversation whose keys are found in one window.
SPAN = 1024
#: Ends of a node that are listed in one row.
CHUNK = 4096


def turn_ids(conversations: DataFrame) -> DataFrame:
    """``(conv_id, pos, t)``: the turns of each conversation in order, numbered from 1, as an id and a length.

    The order is that of ``turn``, null first; turns that tie in it are ordered by their ids. The id is 128 bits of
    XXH64 over role and text, null counting as empty; the length is that of the text in code points.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    t = F.struct(F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(1), role, text).alias("h2"), F.length(text).cast("long").alias("n"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), t.alias("t"))
    bucket = F.coalesce(F.shiftright("turn", 10), F.lit(-(1 << 62)))  # a conversation of any length is numbered in parts
    return exact_rank(rows, "conv_id", [F.asc_nulls_first("turn"), F.col("t")], bucket, "pos").select("conv_id", F.col("pos").cast("long").alias("pos"), "t")


def grafted(turns: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """Conversations whose first turns are another's: ``(conv_id, pos, t)``, with one row of null ``t`` for a conversation without turns.

    Conversation c begins with the first h turns of conversation c - c % every (all if it has fewer,
    none if it is absent), h being crc32 of c's decimals modulo ``heads``; its own turns after its first h follow.
    """
    turns = save(turns, "turns")  # read four times; ids and lengths only
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    base = F.col("conv_id") - F.col("conv_id") % every
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("own")).select("conv_id", h.alias("h"), base.alias("base"), "own")
    sizes = convs.select(F.col("conv_id").alias("base"), F.least("own", F.lit(heads - 1)).alias("there"))
    convs = convs.join(sizes.where(F.col("base") % every == 0), "base", "left").withColumn("head", F.least("h", F.coalesce("there", F.lit(0).cast("long"))))
    first = turns.where((F.col("conv_id") % every == 0) & (F.col("pos") < heads)).select(F.col("conv_id").alias("base"), "pos", "t")
    taken = convs.join(first, "base").where(F.col("pos") <= F.col("h")).select("conv_id", "pos", "t")
    rest = turns.join(convs.select("conv_id", "h", "head"), "conv_id").where(F.col("pos") > F.col("h")).select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "t")
    bare = convs.where((F.col("head") == 0) & (F.col("own") <= F.col("h"))).select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast(turns.schema["t"].dataType).alias("t"))
    return taken.unionByName(rest).unionByName(bare)


def _salted(t: Column, pos: Column) -> list[Column]:
    return [F.xxhash64(pos, t["h1"], t["h2"], t["n"]), F.xxhash64(F.lit(1), pos, t["h1"], t["h2"], t["n"])]


def _blocks(turns: DataFrame, width: int) -> DataFrame:
    """One row for each block: conv_id, prior (block, key of the node before it, code points up to there), t1 .. t<width>, turns and points of the whole conversation."""
    place = F.greatest(F.col("pos") - 1, F.lit(0).cast("long"))
    rows = turns.withColumns({"block": F.floor(place / width).cast("long"), "j": place % width})
    s1, s2 = _salted(F.col("t"), F.col("pos"))
    rows = rows.groupBy("conv_id", "block").agg(
        *[F.max(F.when(F.col("j") == j, F.col("t"))).alias(f"t{j + 1}") for j in range(width)],
        F.bit_xor(F.when(F.col("t").isNotNull(), s1)).alias("x1"), F.bit_xor(F.when(F.col("t").isNotNull(), s2)).alias("x2"),
        F.count("t").alias("n"), F.coalesce(F.sum("t.n"), F.lit(0).cast("long")).alias("points"))
    zero = F.lit(0).cast("long")
    sums = {"x1": F.bit_xor, "x2": F.bit_xor, "points": F.sum}
    spans = rows.withColumn("span", F.floor(F.col("block") / SPAN).cast("long")).groupBy("conv_id", "span").agg(
        *[f(c).alias(f"s_{c}") for c, f in sums.items()], F.sum("n").alias("s_n"))
    before = W.partitionBy("conv_id").orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("conv_id")
    spans = spans.select("conv_id", "span", *[F.coalesce(f(f"s_{c}").over(before), zero).alias(f"b_{c}") for c, f in sums.items()],
                         F.sum("s_n").over(whole).alias("turns"), F.sum("s_points").over(whole).alias("all_points"))
    inner = W.partitionBy("conv_id", "span").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("span", F.floor(F.col("block") / SPAN).cast("long")).join(spans, ["conv_id", "span"])
    key = [F.coalesce(F.bit_xor(c).over(inner), zero).bitwiseXOR(F.col(f"b_{c}")).alias(c.replace("x", "k")) for c in ("x1", "x2")]
    upto = (F.coalesce(F.sum("points").over(inner), zero) + F.col("b_points")).alias("points")
    return rows.select("conv_id", F.struct("block", *key, upto).alias("prior"), *[f"t{j + 1}" for j in range(width)], "turns", F.col("all_points").alias("points"))


def _rollup(blocks: DataFrame, width: int, *aggs: Column) -> DataFrame:
    """All prefixes: prior, t1 .. t<width> (null beyond the prefix), j (turns of the block that it covers), and the aggregates."""
    names = [f"t{j + 1}" for j in range(width)]
    rows = blocks.rollup("prior", *names).agg(F.grouping_id().alias("gid"), *aggs).where(F.col("gid") < (1 << width))
    rows = rows.withColumn("j", F.lit(width) - F.bit_count("gid"))
    last = F.element_at(F.array(*[F.col(n).isNotNull() for n in names]), F.greatest("j", F.lit(1)))
    # a block without turns ends in null columns: those groups are no prefixes; a block's start is the end of the one before it
    return rows.where(F.when(F.col("j") == 0, F.col("prior.block") == 0).otherwise(last))


def _key(width: int, upto: Column) -> list[Column]:
    """Both words of the key of the node that covers the first ``upto`` turns of the block."""
    start = F.col("prior.block") * width
    out = []
    for i, name in enumerate(("k1", "k2")):
        key = F.col(f"prior.{name}")
        for j in range(width):
            key = F.when(upto > j, key.bitwiseXOR(_salted(F.col(f"t{j + 1}"), start + (j + 1))[i])).otherwise(key)
        out.append(key)
    return out


def prefix_trie(turns: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """The nodes of the trie of all conversations, and where each conversation ends.

    ``turns`` has ``(conv_id, pos, t)`` as ``turn_ids`` and ``grafted`` give it. A node of depth d is a distinct sequence of d
    first turns, the root that of none; its members are the conversations that start with it. Nodes:
    conv_id (smallest member), depth, parent_conv_id (the parent's conv_id, null at the root), n_convs, n_children,
    n_leaves (childless nodes in the subtree, the node itself included), saved_tokens (over the subtree,
    members but one times the code points of the last text). A node is named by (depth, conv_id).
    Ends: ``(conv_id, depth, node)``, node being the conv_id of the node that the conversation ends in. No conversation
    at all: no node.

    Subtree sums need no walk over the tree. A conversation owns the nodes whose smallest member it is,
    which are the last ones on its path; so sums over distinct nodes below v are sums over v's members
    of what they own, which a second ROLLUP adds up.
    """
    blocks = save(_blocks(turns, width), "blocks")
    lengths = [F.coalesce(F.col(f"t{j + 1}.n"), F.lit(0).cast("long")) for j in range(width)]
    nodes = _rollup(blocks, width, F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("turns").alias("deepest"), F.sum("points").alias("all_points"))
    j = F.col("j")
    depth = F.col("prior.block") * width + j
    last = F.coalesce(F.element_at(F.array(*lengths), F.when(j > 0, j)), F.lit(0).cast("long"))
    upto = F.col("prior.points")
    for i in range(width - 1):
        upto = upto + F.when(j > i + 1, lengths[i]).otherwise(0)
    k1, k2 = _key(width, j)
    p1, p2 = _key(width, j - 1)
    nodes = nodes.select("conv_id", depth.alias("depth"), k1.alias("k1"), k2.alias("k2"), p1.alias("p1"), p2.alias("p2"), "n_convs", "all_points",
                         (F.col("deepest") == depth).alias("leaf"), last.alias("last"), upto.alias("upto"))
    nodes = save(nodes, "nodes")

    owned = nodes.groupBy("conv_id").agg(F.sum("last").alias("own"), F.min("upto").alias("base"), F.sum(F.col("leaf").cast("long")).alias("leaves"))
    owned = save(owned, "owned")
    below = _rollup(blocks.join(owned, "conv_id"), width, F.min("conv_id").alias("conv_id"), F.sum("own").alias("own_points"), F.sum("leaves").alias("n_leaves"))
    below = below.select("conv_id", depth.alias("depth"), "own_points", "n_leaves")

    child = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    parent = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    # of the points of all members, those before the node count for none of the subtree; of the distinct nodes, each owner's
    saved = F.col("all_points") - F.col("n_convs") * F.col("upto") - (F.col("own_points") + F.col("base") - F.col("upto"))
    out = (nodes.join(below, ["conv_id", "depth"]).join(owned.select("conv_id", "base"), "conv_id")
           .join(child, ["depth", "k1", "k2"], "left").join(parent, ["depth", "p1", "p2"], "left"))
    out = out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves", saved.alias("saved_tokens"))

    final = blocks.where(F.floor(F.greatest(F.col("turns") - 1, F.lit(0).cast("long")) / width) == F.col("prior.block"))
    e1, e2 = _key(width, F.col("turns") - F.col("prior.block") * width)
    final = final.select(F.col("conv_id"), F.col("turns").alias("depth"), e1.alias("k1"), e2.alias("k2"))
    ends = final.join(nodes.select("depth", "k1", "k2", F.col("conv_id").alias("node")), ["depth", "k1", "k2"])
    return out, ends.select("conv_id", "depth", "node")


def with_end_digest(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """``nodes`` with ends_sha256: SHA-256 of the conv_ids, ascending and comma-joined, that end in the node.

    Ends are first joined by range of ids, at most ``CHUNK`` of them in a row; a node with more streams its
    rows in order through one digest, so memory does not grow with it.
    """
    import hashlib
    from collections.abc import Iterator

    import pandas as pd

    chunks = ends.groupBy("node", "depth", F.floor(F.col("conv_id") / CHUNK).cast("long").alias("chunk")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    chunks = chunks.select("node", "depth", "chunk", F.array_join(F.col("ids").cast("array<string>"), ",").alias("part"))

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sha = None, None
        for f in frames:
            out = []
            for node, depth, part in zip(f["node"], f["depth"], f["part"], strict=True):
                if (node, depth) == now:
                    sha.update(b"," + part.encode())
                    continue
                if now is not None:
                    out.append((*now, sha.hexdigest()))
                now, sha = (node, depth), hashlib.sha256(part.encode())
            yield pd.DataFrame(out, columns=["conv_id", "depth", "ends_sha256"])
        if now is not None:
            yield pd.DataFrame([(*now, sha.hexdigest())], columns=["conv_id", "depth", "ends_sha256"])

    ordered = chunks.repartition("node", "depth").sortWithinPartitions("node", "depth", "chunk").select("node", "depth", "part")
    found = ordered.mapInPandas(digest, "conv_id long, depth long, ends_sha256 string")
    return nodes.join(found, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
