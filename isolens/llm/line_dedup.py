"""Line deduplication by an exact set-similarity join over line tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, WORD, discard, save, sent_if_small, text_key, text_of

BUCKETS = 1 << 20
CODE_BITS = 47
KEY = ["doc_id", "h1", "h2", "n"]
#: Sets of more tokens are too many for 64 bits of parity; their pairs are bounded by whole prefixes too.
LONG = 64
#: Lists of lines per document go to the texts if they are for at most so many documents (some 100 bytes each), else both are shuffled.
BROADCAST_DOCS = 500_000


def _codes(line: Column) -> Column:
    """Distinct XXH64 codes of a line's tokens."""
    codes = F.array_distinct(F.transform(F.split(line, BLANKS), lambda w: F.xxhash64(w)))
    return F.array_remove(codes, F.xxhash64(F.lit("")))


def _lines(docs: DataFrame) -> DataFrame:
    texts = docs.select("doc_id", text_of().alias("text")).select("doc_id", text_key(F.col("text")).alias("k"), F.lower("text").alias("text"))
    return texts.select("doc_id", "k.*", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _bucket(code: Column) -> Column:
    return code.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def _rarity(docs: DataFrame) -> Column:
    """Scalar array: for each bucket of codes, its place on a logarithmic scale of frequency (0: one token or none), as the high bits of a key."""
    tokens = docs.select(F.explode(F.split(F.lower(text_of()), BLANKS)).alias("token"))
    counts = tokens.groupBy(_bucket(F.xxhash64("token")).alias("b")).agg(F.count("*").alias("n"))
    every = docs.sparkSession.range(0, BUCKETS, 1, 8).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left")
    scale = F.shiftleft(F.floor(F.log2(F.coalesce("n", F.lit(1)).cast("double")) * 1000).cast("long"), CODE_BITS).alias("r")
    listed = every.agg(F.sort_array(F.collect_list(F.struct("b", scale))).alias("a"))
    return save(listed.select(F.transform("a", lambda x: x["r"]).alias("a")), "rarity").scalar()


def _ordered(codes: str, rarity: str) -> Column:
    """Codes as sortable keys, rarest first: the scale above the code. No key is null, so they are sorted as plain numbers."""
    low = (1 << CODE_BITS) - 1
    scale = lambda c: F.coalesce(F.get(rarity, _bucket(c)), F.lit(0).cast("long"))
    return F.sort_array(F.transform(codes, lambda c: scale(c).bitwiseOR(c.bitwiseAND(F.lit(low)))))


def duplicate_lines(docs: DataFrame, similarity: float = 0.8, crowd: int = 64) -> DataFrame:
    """Lines that match an earlier line: ``doc_id, h1, h2, n`` (text key) and ``line_no``.

    A line is the set of its lower-cased tokens; two lines match at a Jaccard similarity of at least
    ``similarity``; lines are in order of doc_id (null last), text hash and line number. A line goes
    if any earlier line matches it. Lines without tokens never match.

    Lines with the same set form a class first, so copies cost one row. Tokens are ordered by rarity
    over all lines (all occurrences are counted, in 2 ** 20 hash buckets, so the table has a fixed
    size; ties follow the code, so the order is total and the filters are exact). Classes meet on
    the tokens of their prefixes, pass the length filter, the positional filter and the parity filter
    (each token flips one of 64 bits, so the bits in which two sets differ are no more than the tokens
    in which they do) and, if they are long, a bound by all tokens of both prefixes, and are then compared by their whole sets, the nearest by parity first. For tokens
    in more than ``crowd`` prefixes, each class is before that compared with the earliest one there, so that
    the lines of near copies find a match at once; only what is left is compared with all others.
    """
    t = similarity
    # blank lines go by a pattern: a filter on the codes would compute them twice
    lines = _lines(docs).where(F.col("line").rlike(WORD)).select(*KEY, "line_no", _codes(F.col("line")).alias("codes")).withColumn("rarity", _rarity(docs))
    lines = lines.select(*KEY, "line_no", _ordered("codes", "rarity").alias("set"))
    size = F.size("set")
    parity = F.expr("aggregate(set, 0L, (bits, key) -> bits ^ shiftleft(1L, cast(key & 63 AS int)))")
    prefix = F.slice("set", F.lit(1), size - F.ceil(F.lit(t) * size - 1e-9).cast("int") + 1)
    lines = save(lines.select(*KEY, "line_no", F.xxhash64("set").alias("s1"), F.xxhash64(F.lit(1), "set").alias("s2"), size.alias("size"), parity.alias("parity"), prefix.alias("prefix")), "lines")

    place = F.struct(F.col("doc_id").isNull().alias("late"), *KEY, "line_no")
    classes = lines.groupBy("s1", "s2").agg(F.min(place).alias("first"), F.count("*").alias("copies"), *[F.first(k).alias(k) for k in ("size", "parity", "prefix")])
    # ids follow the order of the lines
    classes = save(classes.orderBy("first").withColumn("id", F.monotonically_increasing_id()), "classes")
    fat, lines = lines, save(lines.select(*KEY, "line_no", "s1", "s2"), "thin")
    discard(fat)

    alone = 1 << CODE_BITS  # keys below this have a token that occurs once
    by_key = Window.partitionBy("key")

    half = F.floor(F.col("size") * (1 - t) / (2 * t) + 1e-9)

    def entries(of: DataFrame, *more: str, head: bool = False) -> DataFrame:
        each = of.select("id", "size", "parity", *more, F.posexplode("prefix").alias("pos", "key")).where(F.col("key") >= alone)
        each = each.where(F.col("pos") <= half) if head else each
        return each.withColumn("n", F.count("*").over(by_key)).where("n > 1")

    def may_match(a: str, b: str) -> Column:
        size_a, size_b = c(f"{a}size"), c(f"{b}size")
        need = F.ceil((size_a + size_b) * F.lit(t / (1 + t)) - 1e-9)
        long, short = F.greatest(size_a, size_b), F.least(size_a, size_b)
        return (short >= long * t - 1e-9) & (c(f"{a}pos") <= size_a - need) & (c(f"{b}pos") <= size_b - need) & (apart(a, b) <= size_a + size_b - 2 * need)

    def apart(a: str, b: str) -> Column:
        return F.bit_count(c(f"{a}parity").bitwiseXOR(c(f"{b}parity")))

    c = F.col
    crowded = entries(classes, head=True).where(c("n") > crowd).withColumn("head", F.min(F.struct("id", "size", "pos", "parity")).over(by_key))
    crowded = crowded.where((c("id") != c("head.id")) & may_match("", "head."))
    first_try = crowded.select(c("id").alias("b"), c("head.id").alias("a")).distinct()
    found = _verify(docs, classes, first_try, t).select("b").distinct()

    # a pair is of use if its later class has no match yet
    open_too = classes.join(found.select(c("b").alias("id"), F.lit(True).alias("done")), "id", "left").withColumn("done", F.coalesce("done", F.lit(False)))
    each = entries(open_too, "done")
    left, right = (of.select("key", *[c(k).alias(f"{x}_{k}") for k in ("id", "size", "parity", "pos", "done")]) for x, of in (("x", each.where(c("pos") <= half)), ("y", each)))
    first_pos = (c("x_pos") < c("y_pos")) | ((c("x_pos") == c("y_pos")) & (c("x_id") < c("y_id")))
    of_use = ~F.when(c("x_id") > c("y_id"), c("x_done")).otherwise(c("y_done"))
    met = left.join(right, "key").where(first_pos & of_use & (c("x_id") != c("y_id")) & may_match("x_", "y_"))
    met = met.select(F.greatest("x_id", "y_id").alias("b"), F.least("x_id", "y_id").alias("a"), apart("x_", "y_").alias("apart"), (F.greatest("x_size", "y_size") > LONG).alias("long"))
    first_met = save(met.distinct(), "met")
    met = save(first_met.where(~c("long")).drop("long").union(_bounded(classes, first_met.where("long").drop("long"), t)), "near")
    discard(first_met)
    # one match is enough for a line: its nearest candidate is read first, the others where that is none
    nearest = met.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("m")).select("b", "m.a")
    near = _verify(docs, classes, nearest, t).select("b").distinct()
    rest = met.join(near, "b", "left_anti").join(nearest, ["b", "a"], "left_anti")
    gone = found.union(near).union(_verify(docs, classes, rest, t).select("b")).distinct()

    marks = classes.join(gone.withColumnRenamed("b", "id").withColumn("gone", F.lit(True)), "id", "left")
    marks = save(marks.where(c("gone") | (c("copies") > 1)).select("s1", "s2", "first", F.coalesce("gone", F.lit(False)).alias("gone")), "marks")
    discard(classes, met)
    marked = lines.select(*KEY, "line_no", "s1", "s2", place.alias("place")).join(marks, ["s1", "s2"])
    return marked.where(c("gone") | (c("place") != c("first"))).select(*KEY, "line_no")


def _bounded(classes: DataFrame, pairs: DataFrame, t: float) -> DataFrame:
    """The ``pairs`` of long sets that may still match by their whole prefixes: up to the end of the shorter prefix all
    common tokens are known, and beyond it there are no more than the smaller rest."""
    wide = classes.where(F.col("size") >= LONG * t - 1e-9).select("id", "size", "prefix", F.element_at("prefix", -1).alias("last"))
    both = pairs.join(wide.toDF("a", "a_size", "a_prefix", "a_last"), "a").join(wide.toDF("b", "b_size", "b_prefix", "b_last"), "b")
    rest = [F.expr(f"{x}_size - size(filter({x}_prefix, key -> key <= least(a_last, b_last)))") for x in "ab"]
    need = F.ceil((F.col("a_size") + F.col("b_size")) * F.lit(t / (1 + t)) - 1e-9)
    return both.where(F.size(F.array_intersect("a_prefix", "b_prefix")) + F.least(*rest) >= need).select(pairs.columns)


def _verify(docs: DataFrame, classes: DataFrame, pairs: DataFrame, t: float) -> DataFrame:
    """Pairs ``(a, b)`` of class ids whose sets reach the similarity; only their lines are read again.

    Lines travel as text, which is half the size of their codes, and are cut into tokens where a pair meets.
    """
    pairs = save(pairs.select("a", "b"), "pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    wanted = classes.join(ids, "id").select("id", "first.*").groupBy(*KEY).agg(F.collect_list(F.struct("line_no", "id")).alias("wanted"))
    wanted = sent_if_small(wanted.select(*[F.col(k).alias(f"w_{k}") for k in KEY], "wanted"), BROADCAST_DOCS, "wanted")
    texts = docs.select("doc_id", text_of().alias("text")).select("doc_id", text_key(F.col("text")).alias("k"), F.lower("text").alias("text")).select("doc_id", "k.*", "text")
    on = [texts[k].eqNullSafe(wanted[f"w_{k}"]) if k == "doc_id" else texts[k] == wanted[f"w_{k}"] for k in KEY]
    rows = texts.join(wanted, on).select(F.split("text", "\n").alias("all"), "wanted")
    rows = rows.select(F.explode(F.expr("transform(wanted, w -> struct(w.id AS id, all[w.line_no] AS line))")).alias("w"))
    found = rows.select("w.id", "w.line").dropDuplicates(["id"])  # dealt out by id once, which serves both joins
    both = pairs.join(found.select(F.col("id").alias("a"), F.col("line").alias("a_line")), "a").join(found.select(F.col("id").alias("b"), F.col("line").alias("b_line")), "b")
    # arrays of one element name what would be computed again at each mention
    sets = F.array(F.struct(*[F.array_remove(F.array_distinct(F.split(f"{x}_line", BLANKS)), "").alias(x) for x in "ab"]))
    reached = F.exists(sets, lambda s: F.exists(
        F.array(F.size(F.array_intersect(s["a"], s["b"]))), lambda common: common >= (F.size(s["a"]) + F.size(s["b"]) - common) * t - 1e-9))
    linked = save(both.where(reached).select("a", "b"), "linked")
    discard(pairs, wanted)
    return linked


def _stripped(docs: DataFrame, similarity: float) -> DataFrame:
    """Every row as ``doc``, with its lines ``parts``, the numbers ``gone``, and the text ``kept``."""
    gone = duplicate_lines(docs, similarity).distinct().groupBy(*KEY).agg(F.collect_list("line_no").alias("gone"))
    gone = sent_if_small(gone.select(*[F.col(k).alias(f"g_{k}") for k in KEY], "gone"), BROADCAST_DOCS, "gone")
    packed = docs.select(F.struct("*").alias("doc"), "doc_id", text_key(text_of()).alias("k")).select("doc", "doc_id", "k.*")
    on = [packed[k].eqNullSafe(gone[f"g_{k}"]) if k == "doc_id" else packed[k] == gone[f"g_{k}"] for k in KEY]
    rows = packed.join(gone, on, "left").select("doc", "gone", F.split("doc.text", "\n").alias("parts"))
    rest = F.expr("transform(array_except(sequence(0, size(parts) - 1), gone), i -> parts[i])")
    return rows.withColumn("kept", F.when(F.col("gone").isNull(), F.col("doc.text")).otherwise(F.concat_ws("\n", rest)))


def dedup_lines(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``docs`` with the texts rid of lines that match an earlier line; all columns and rows stay.

    What is left is joined by line breaks again; a text that loses all lines is empty, a null text
    stays null. If ``docs`` has ``n_chars``, it is counted anew where lines went. Rows that repeat
    doc_id and text are one document here: they keep and lose the same lines. Null ids, empty
    tables and columns of any other name are fine.
    """
    rows, columns = _stripped(docs, similarity), []
    for name in docs.columns:
        own = F.col("doc").getField(name)
        if name == "text":
            own = F.col("kept")
        elif name == "n_chars":
            own = F.when(F.col("gone").isNull(), own).otherwise(F.length("kept").cast(docs.schema[name].dataType))
        columns.append(own.alias(name))
    return rows.select(*columns)


def line_report(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """One row per input row: ``doc_id, n_lines, n_removed`` and the ``text`` that is left."""
    rows = _stripped(docs.select("doc_id", "text"), similarity)
    lines = F.when(F.col("doc.text").isNull(), 0).otherwise(F.size("parts"))
    removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    return rows.select("doc.doc_id", lines.alias("n_lines"), removed.alias("n_removed"), F.col("kept").alias("text"))
