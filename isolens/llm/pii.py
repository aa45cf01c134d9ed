"""Personal data: base patterns and information-theoretic sanitisation of the terms around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, text_key, text_of

#: Base patterns. Possessive repeats and look-behinds find the same matches as the plain patterns, in
#: time linear in the text: a run that fails from its start is not tried again from its middle.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "generalise", "remove"]
TERM = r"[\p{L}\p{N}]++"
NO_TERM = r"[^\p{L}\p{N}]++"
SPAN = "struct<start:int,kind_at:int,kind:string,end:int,value:string>"


def _placed(text: Column, pattern: str) -> Column:
    """Matches of a pattern with their positions in code points, ``array<struct<start, end, value>>``.

    The text between matches comes from splitting at the same matches; running sums of the lengths
    give the positions.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    steps = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m).alias("n"), m.alias("m")))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin, end = acc["at"] + x["gap"], acc["at"] + x["gap"] + x["n"]
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["m"].alias("value")))).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(steps, start, step, lambda acc: acc["out"])).otherwise(empty)


def _luhn(digits: Column) -> Column:
    def value(c: Column, i: Column) -> Column:
        d = c.cast("int") * (1 + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        def small(part: Column) -> Column:
            number = F.regexp_replace(part, "^0+", "")
            return (F.length(number) < 3) | ((F.length(number) == 3) & (number <= "255"))

        return F.forall(F.split(value, r"\."), small)
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All valid base spans of a text, by start and then kind."""
    def spans(at: int, kind: str) -> Column:
        valid = F.filter(_placed(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))
        return F.transform(valid, lambda s: F.struct(
            s["start"].alias("start"), F.lit(at).alias("kind_at"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))

    return F.sort_array(F.concat(*[spans(at, kind) for at, kind in enumerate(PATTERNS)]))


def _contexts(words: int, reach: int) -> Column:
    """For each span of ``spans``: the entity and the terms around it that lie outside of all base spans."""
    text, spans = F.col("text"), F.col("spans")

    def around(s: Column, i: Column) -> Column:
        left = F.substr(text, F.greatest(F.lit(1), s["start"] - reach + 1), F.least(F.lit(reach), s["start"]))
        right = F.substr(text, s["end"] + 1, F.lit(reach))
        # a term that the window cuts is left out
        before = F.filter(_placed(left, TERM), lambda t: (t["start"] > 0) | (s["start"] <= reach))
        after = F.filter(_placed(right, TERM), lambda t: t["end"] < reach)
        shift = F.greatest(F.lit(0), s["start"] - reach)
        before = F.transform(F.slice(before, F.greatest(F.lit(1), F.size(before) - words + 1), F.lit(words)), lambda t: F.struct(
            (t["start"] + shift).alias("start"), (t["end"] + shift).alias("end"), F.lower(t["value"]).alias("term")))
        after = F.transform(F.slice(after, 1, words), lambda t: F.struct(
            (t["start"] + s["end"]).alias("start"), (t["end"] + s["end"]).alias("end"), F.lower(t["value"]).alias("term")))
        near = F.slice(spans, F.greatest(F.lit(1), i - reach), F.lit(2 * reach + 1))
        free = F.filter(F.concat(before, after), lambda t: ~F.exists(near, lambda o: (o["start"] < t["end"]) & (o["end"] > t["start"])))
        return F.struct(F.concat_ws(":", s["kind"], F.lower(s["value"])).alias("entity"), free.alias("terms"))

    return F.transform(spans, around)


def find_pii(docs: DataFrame, words: int = 4, reach: int = 64, generalise: float = 0.9, remove: float = 0.97, least: int = 2) -> DataFrame:
    """Base spans of every text, and the terms near them that disclose what the spans hide.

    An entity is the lower-cased value of a base span; a term is a run of letters and digits among
    the ``words`` on either side of a span, within ``reach`` code points. Counts over the whole
    corpus estimate probabilities: of an entity (its spans), of a term (all its occurrences in all
    texts), and of both (occurrences of the term beside the entity). A term discloses
    PMI(entity, term) / IC(entity) = 1 + log P(entity | term) / IC(entity) of the entity's
    information content. If that reaches ``remove``, the occurrence beside the entity is to be
    removed, and from ``generalise`` on to be generalised; pairs seen fewer than ``least`` times give
    no estimate. Base spans always stay.

    Returns one row per input row: ``doc_id, h1, h2, n`` (text key), ``base`` and ``spans``, both
    ``array<struct<start, kind_at, kind, end, value>>`` by start and kind, positions in code points. A
    null or empty text has no spans. Null ids and repeated rows keep their rows; rows that repeat id
    and text share their spans; empty tables give an empty result; further columns are ignored. Texts
    are read whole, twice: for spans, and for the counts of terms.
    """
    key = ["doc_id", "h1", "h2", "n"]
    texts = docs.select("doc_id", text_of().alias("text"))
    placed = texts.select("doc_id", text_key(F.col("text")).alias("k"), "text", base_spans(F.col("text")).alias("spans"))
    rows = save(placed.select("doc_id", "k.*", F.col("spans").alias("base"), _contexts(words, reach).alias("contexts")), "base")
    beside = rows.where("size(base) > 0").select(*key, F.explode("contexts").alias("c"))
    entities = beside.groupBy(F.col("c.entity").alias("entity")).agg(F.count("*").alias("n_entity"))
    near = beside.select(*key, F.col("c.entity").alias("entity"), F.explode("c.terms").alias("t")).select(*key, "entity", "t.*").distinct()
    near = save(near, "near")
    pairs = near.groupBy("entity", "term").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= least)
    counts = texts.select(F.explode(F.split(F.lower("text"), NO_TERM)).alias("term")).where("term != ''").groupBy("term").agg(F.count("*").alias("n_term"))
    counts = save(counts, "terms")
    total = counts.select(F.coalesce(F.sum("n_term"), F.lit(0)).alias("t")).first().t
    known = pairs.join(counts, "term", "left").join(entities, "entity")
    share = F.least(F.lit(1.0), F.col("n_both") / F.coalesce("n_term", "n_both"))
    content = F.log2(F.greatest(F.lit(2.0), F.lit(float(total)) / F.col("n_entity")))
    strong = known.select("entity", "term", (1 + F.log2(share) / content).alias("disclosed")).where(F.col("disclosed") >= generalise)
    kind_at = F.when(F.col("disclosed") >= remove, 5).otherwise(4)
    more = near.join(strong, ["entity", "term"]).groupBy(*key, "start", "end", "term").agg(F.max(kind_at).alias("kind_at"))
    kind = F.when(F.col("kind_at") == 5, "remove").otherwise("generalise")
    more = more.groupBy(*key).agg(F.collect_list(F.struct("start", "kind_at", kind.alias("kind"), "end", F.col("term").alias("value"))).alias("more"))
    more = more.select(*[F.col(c).alias(f"m_{c}") for c in key], "more")
    on = [rows[c].eqNullSafe(more[f"m_{c}"]) if c == "doc_id" else rows[c] == more[f"m_{c}"] for c in key]
    added = F.coalesce(F.col("more").cast(f"array<{SPAN}>"), F.array().cast(f"array<{SPAN}>"))
    return rows.join(more, on, "left").select(*key, "base", F.sort_array(F.concat(F.col("base").cast(f"array<{SPAN}>"), added)).alias("spans"))


def listed(spans: str) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def sanitise(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``doc_id`` and the text with each span replaced by its kind in brackets; removed terms leave nothing.

    Of overlapping spans, the one that starts first is replaced and the rest of the others with it. A null text comes
    back empty; rows that repeat id and text share their spans; an empty table gives none, and other columns are left out.
    """
    key = ["doc_id", "h1", "h2", "n"]
    texts = docs.select("doc_id", text_of().alias("text")).select("doc_id", text_key(F.col("text")).alias("k"), "text").select("doc_id", "k.*", "text")
    f = found.select(*[F.col(c).alias(f"f_{c}") for c in key], "spans").dropDuplicates([f"f_{c}" for c in key])
    on = [texts[c].eqNullSafe(f[f"f_{c}"]) if c == "doc_id" else texts[c] == f[f"f_{c}"] for c in key]
    text = F.col("text")

    def step(acc: Column, s: Column) -> Column:
        sign = F.when(s["kind"] == "remove", "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        fresh = s["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), sign)).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("spans", begin, step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1)))
    return texts.join(f, on).select("doc_id", clean.alias("text"))
