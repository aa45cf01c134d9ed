"""URL filters: host-suffix and path-prefix expressions joined on short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower


def url_parts(url: Column) -> dict[str, Column]:
    """Host (ASCII letters lower-cased) and path of a URL; both empty without ``://``."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substr(url, start + 3))
    rest = F.substring_index(F.substring_index(rest, "#", 1), "?", 1)
    host = F.substring_index(rest, "/", 1)
    return {"host": F.coalesce(ascii_lower(host), F.lit("")), "path": F.coalesce(F.substr(rest, F.length(host) + 1), F.lit(""))}


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", prefix_bytes: int = 4) -> DataFrame:
    """Verdict for every page by the longest rule that fits its url.

    ``rules`` has ``rule, host, path, verdict``; a rule fits its host and all subdomains where the
    path starts with the rule's. Each distinct (host, path) is expanded into its host suffixes at
    label borders and its path prefixes at the lengths that rules have; the expressions join the
    rules on the first bytes of their SHA-256, then the whole digest and the strings must agree. The
    longest rule wins (host and path together), then block before allow, then the smaller rule.

    Returns one row per input row: ``page_id, host, path, rule, verdict``; without a fitting rule,
    ``rule`` is null and ``verdict`` is ``default``. A null url or one without ``://`` has empty host
    and path. Repeated rows and null ids keep their own rows; an empty table or an empty rule list is
    fine; further columns are ignored. Hot hosts are judged once per distinct (host, path). The only
    unbounded table that is joined with pages is split by the skew-join rule.
    """
    parts = url_parts(F.col("url"))
    rows = pages.select("page_id", "url").select("page_id", parts["host"].alias("host"), parts["path"].alias("path"))
    r = rules.where("host is not null and path is not null").select(
        "rule", F.col("host").alias("r_host"), F.col("path").alias("r_path"), "verdict", F.sha2(F.concat("host", "path"), 256).alias("r_digest"))
    r = r.withColumn("r_short", F.substring("r_digest", 1, 2 * prefix_bytes))
    lengths = r.select(F.sort_array(F.collect_set(F.length("r_path"))).alias("ls")).scalar()

    urls = rows.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    at = F.sequence(F.lit(1), F.size(labels))
    suffixes = F.transform(at, lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    cuts = F.array_intersect(lengths, F.sequence(F.lit(0), F.length("path")))
    e = urls.select("host", "path", F.explode(suffixes).alias("e_host"), cuts.alias("cuts"))
    e = e.select("host", "path", "e_host", F.explode("cuts").alias("n")).select("host", "path", "e_host", F.expr("substring(path, 1, n)").alias("e_path"))
    e = e.withColumn("e_digest", F.sha2(F.concat("e_host", "e_path"), 256))
    e = e.withColumn("short", F.substring("e_digest", 1, 2 * prefix_bytes))
    hit = e.join(r, F.col("short") == F.col("r_short")).where("e_digest = r_digest and e_host = r_host and e_path = r_path")
    length = F.length("r_host") + F.length("r_path")
    best = hit.groupBy("host", "path").agg(F.min(F.struct(
        (-length).alias("l"), (F.col("verdict") != "block").alias("v"), "rule", "verdict")).alias("best"))
    best = best.select(F.col("host").alias("b_host"), F.col("path").alias("b_path"), "best")
    out = rows.join(best, (F.col("host") == F.col("b_host")) & (F.col("path") == F.col("b_path")), "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
