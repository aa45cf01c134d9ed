"""Queries of the operators of this folder, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from . import alignment, decontaminate, exact_dedup, line_dedup, lm, mixing, packing, pii, prefix_trie, simhash, toxicity, url_filter, vocab, warc
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def _held_out(folds: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 2, F.lit(False))


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~_held_out(4)))
    found = toxicity.classify(docs, model, least=0.3)
    spans = F.concat_ws(",", F.transform("sentences", lambda s: F.concat_ws(":", s["start"], s["end"])))
    return found.select("doc_id", _held_out(4).alias("held_out"), "score", "predicted", spans.alias("sentences"))


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


#: Rules of the URL query (fixed values).
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([(h + p, h, p, v) for h, p, v in URL_RULES], "rule string, host string, path string, verdict string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules)


_RULES_SQL = ", ".join(f"('{h}{p}', '{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
_LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["op3_url_filter"] = f"""
WITH rules(rule, r_host, r_path, verdict) AS (VALUES {_RULES_SQL}),
rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, {_LOWER_SQL.format("regexp_extract(r, '^([^/?#]*)', 1)")} AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fits AS (SELECT page_id, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS k FROM parts, rules
  WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.k = 1"""


@query
def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), ngram=4, most=4)


@query
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


ORACLES["op5_exact_dedup"] = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY ALL)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)"""


@query
def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, learn = table(spark, sf_dir, "documents"), ~_held_out(7)
    words = lm.count_words(docs, learn)
    scored = lm.score(docs, words, lm.train(docs, words, learn))
    return scored.withColumn("held_out", _held_out(7))


@query
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.PATTERNS]
    return found.select("doc_id", *counts, F.sha2(pii.listed("base"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


@query
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "matches", "start", "end")


@query
def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "shards")


def _mix_sql(documents: str, blocks: int = 16384, depth: int = 4, seed: str = "mix") -> str:
    """WITH clauses up to ``mixed(doc_id, rank, source, size, source_size, target, taken, shards)``."""
    levels = "".join(f""",
t{k + 1} AS (SELECT source, unit, 2 * node + (row_number() OVER (PARTITION BY node ORDER BY md5('{seed}-tree-{k}|' || coalesce(source, '') || '|' || unit), source NULLS LAST, unit)
    > ceil(count(*) OVER (PARTITION BY node) / 2))::INT AS node FROM t{k})""" for k in range(depth))
    return f"""
sized AS (SELECT *, md5('{seed}|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS rank,
  length(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM {documents}),
per_source AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM sized GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight,
  ceil(n * {blocks} / sum(n) OVER ())::BIGINT AS n_blocks FROM per_source),
lv AS (SELECT *, row_number() OVER o AS pos, sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
  150 * sum(source_size) OVER () - 100 * coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_words
  FROM w WINDOW o AS (ORDER BY 2 * source_size / weight, source NULLS LAST)),
cut AS (SELECT pos AS c_at, rest_words AS c_left, open AS c_open FROM lv WHERE rest_words * weight <= 200 * source_size * open ORDER BY pos LIMIT 1),
tg AS (SELECT source, source_size, n_blocks, CASE WHEN c_at IS NULL THEN NULL WHEN pos < c_at THEN (2 * source_size)::DOUBLE ELSE (c_left * weight)::DOUBLE / (100.0::DOUBLE * c_open::DOUBLE) END AS target FROM lv LEFT JOIN cut ON true),
pl AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS passes FROM tg),
pl2 AS (SELECT *, floor(target + 0.5)::BIGINT - passes * source_size AS rest FROM pl),
placed AS (SELECT s.*, p.source_size, p.target, p.passes, p.rest, ('0x' || substr(rank, 1, 8))::BIGINT % p.n_blocks AS block
  FROM sized s JOIN pl2 p ON s.source IS NOT DISTINCT FROM p.source),
b0 AS (SELECT source, block, sum(size)::BIGINT AS words, first(passes) AS passes, first(rest) AS rest FROM placed GROUP BY source, block),
b1 AS (SELECT *, sum(words) OVER o AS upto, row_number() OVER o AS ord FROM b0
  WINDOW o AS (PARTITION BY source ORDER BY md5('{seed}-block|' || coalesce(source, '') || '|' || block), block ROWS UNBOUNDED PRECEDING)),
b2 AS (SELECT *, least(words, greatest(0, rest - upto + words))::BIGINT AS extra FROM b1),
b3 AS (SELECT *, CASE WHEN words > 0 THEN passes + (extra > 0)::INT ELSE 0 END AS copies FROM b2),
drawn AS (SELECT source, block, copy, row_number() OVER (PARTITION BY source ORDER BY copy, ord) AS k
  FROM (SELECT *, unnest(range(1, copies::BIGINT + 1)) AS copy FROM b3)),
t0 AS (SELECT source, k AS unit, 1 AS node FROM drawn){levels},
quotas AS (SELECT source, node - {2**depth} AS shard, count(*) AS quota FROM t{depth} GROUP BY ALL),
upto AS (SELECT *, sum(quota) OVER (PARTITION BY source ORDER BY shard) AS q FROM quotas),
places AS (SELECT d.source, d.block, list(u.shard ORDER BY d.copy) AS places FROM drawn d JOIN upto u
  ON d.source IS NOT DISTINCT FROM u.source AND d.k > u.q - u.quota AND d.k <= u.q GROUP BY ALL),
joined AS (SELECT p.*, b.words, b.extra, l.places, sum(p.size) OVER (PARTITION BY p.source, p.block ORDER BY p.rank, p.doc_id NULLS LAST ROWS UNBOUNDED PRECEDING) AS inside
  FROM placed p JOIN b3 b ON p.source IS NOT DISTINCT FROM b.source AND p.block = b.block
  LEFT JOIN places l ON p.source IS NOT DISTINCT FROM l.source AND p.block = l.block),
more AS (SELECT *, CASE WHEN extra = 0 THEN 0 WHEN extra = words THEN size ELSE least(size, greatest(0, extra - inside + size)) END AS m FROM joined),
mixed AS (SELECT * EXCLUDE (m), (passes * size + m)::BIGINT AS taken,
  CASE WHEN size = 0 THEN '' ELSE array_to_string(coalesce(places, [])[1:(passes + (m > 0)::INT)::BIGINT], ',') END AS shards FROM more)"""


ORACLES["op9_source_mix"] = f"WITH {_mix_sql('documents')} SELECT doc_id, size, source_size, target, taken, shards FROM mixed"


@query
def op10_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    folder = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}/archive"
    warc.write_archive(table(spark, sf_dir, "pages"), folder)
    fields = warc.parse_records(warc.read_archive(spark, folder))
    return fields.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op10_warc_archive"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS response FROM p GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> response THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> response THEN response END AS refers_to
FROM p JOIN m USING (payload_digest)"""


#: Tokenizer files of the queries (parameters of the operators).
BYTE_TABLE, PIECE_TABLE = "byte_bpe_50k.json", "piece_bpe_32k.model"


@query
def op11_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), vocab.public_path(BYTE_TABLE), packing.Limits(tokens=2048, segments=64))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), F.col("tokens").alias("doc_tokens"), "sequence_id", "offset")


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.link_support(table(spark, sf_dir, "documents"), vocab.public_path(BYTE_TABLE), vocab.public_path(PIECE_TABLE))
    return found.withColumnRenamed("groups", "groups_sha256")


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turn_ids(table(spark, sf_dir, "conversations"))
    return prefix_trie.with_end_digest(*prefix_trie.prefix_trie(prefix_trie.grafted(turns)))


ORACLES["op13_prefix_trie"] = """
WITH crc AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]),
  lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
own AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, conv_id::VARCHAR AS s FROM own GROUP BY conv_id),
heads AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(s) + 1), lambda i: ascii(s[i]))),
  lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 6 AS h FROM ids, crc),
turns AS (SELECT h.conv_id, 0 AS part, o.pos, o.role, o.text FROM heads h JOIN own o ON o.conv_id = h.base AND o.pos <= h.h
  UNION ALL SELECT h.conv_id, 1, o.pos, o.role, o.text FROM heads h JOIN own o ON o.conv_id = h.conv_id AND o.pos > h.h),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS d, sha256(length(role) || ':' || role || text) AS id FROM turns),
paths AS (SELECT conv_id, d AS depth, length(text) AS n, list(id) OVER (PARTITION BY conv_id ORDER BY d) AS path FROM numbered
  UNION ALL SELECT conv_id, 0, 0, [] FROM heads),
stops AS (SELECT conv_id, max(depth) AS stop FROM paths GROUP BY conv_id),
nodes AS (SELECT sha256(array_to_string(path, '')) AS node, any_value(path) AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n, max(stop) = depth AS leaf,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (stop = depth), '')) AS ends_sha256
  FROM paths JOIN stops USING (conv_id) GROUP BY sha256(array_to_string(path, '')), depth),
over AS (SELECT *, sha256(array_to_string(path[:unnest(range(0, depth + 1))], '')) AS top FROM nodes),
trees AS (SELECT top AS node, sum(leaf::INT)::BIGINT AS n_leaves, sum((n_convs - 1) * n)::BIGINT AS saved_tokens FROM over GROUP BY top),
kids AS (SELECT sha256(array_to_string(path[:depth - 1], '')) AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, t.n_leaves, t.saved_tokens, n.ends_sha256
FROM nodes n JOIN trees t USING (node) LEFT JOIN kids k USING (node) LEFT JOIN nodes p ON n.depth > 0 AND p.node = sha256(array_to_string(n.path[:n.depth - 1], ''))"""
