"""Registry of queries: one entry per operator, with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markers
from . import bindings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SURVEY: dict[str, str] = {}

# Marker pattern of the checks (same fixed values as the call pattern, written for RE2).
CALL = markers.CALL_PATTERN.replace("'", "''")
PRETTY = """(CASE WHEN lower(tok) LIKE 'aac(6'')-ib-cr%' THEN 'aac(6'')-Ib-cr' ELSE
  lower(substr(tok, 1, 3)) || upper(substr(tok, 4, 1)) || lower(substr(split_part(tok, '_', 1), 5)) ||
  CASE WHEN split_part(tok, '_', 2) <> '' THEN '_' || upper(split_part(tok, '_', 2)) ELSE '' END END)"""

# Extra named tables for the checks only.
CHECK_TABLES = {
    "o_flags": "SELECT *, priority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS selected, "
               "priority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND status = 'F' AS analyzed FROM {cohort}",
    "o_tokens": r"SELECT * EXCLUDE (amr), unnest(regexp_extract_all(coalesce(amr, ''), '([^,=\s]+)=', 1)) AS tok FROM {o_flags}",
    "o_markers": f"SELECT DISTINCT * EXCLUDE (tok), {PRETTY} AS marker FROM {{o_tokens}} WHERE regexp_matches(lower(tok), '{CALL}')",
    "o_packed": "SELECT f.*, coalesce(m.n, 0) AS n_markers, coalesce(m.packed, '') AS packed FROM {o_flags} f LEFT JOIN "
                "(SELECT run, count(*) AS n, string_agg(marker, ';' ORDER BY marker) AS packed FROM {o_markers} GROUP BY run) m USING (run)",
}
bindings.BINDINGS.update(CHECK_TABLES)


class Entities:
    """Bound entities of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return bindings.bind(self.spark, self.sf_dir, name)

    @cached_property
    def flagged(self) -> DataFrame:
        sel = F.col("priority").isin("1-URGENT", "2-HIGH", "3-MEDIUM")
        return self("isolates").withColumn("selected", sel).withColumn("analyzed", sel & (F.col("status") == "F"))

    @cached_property
    def cohort(self) -> DataFrame:
        """Isolates with their marker text, raw and display markers, and selection flags."""
        sel = F.col("priority").isin("1-URGENT", "2-HIGH", "3-MEDIUM")
        return self("cohort").select(
            "*", sel.alias("selected"), (sel & (F.col("status") == "F")).alias("analyzed"),
            markers.extract_markers("amr").alias("raw_markers"), markers.pretty_markers("amr").alias("markers"))


def query(name: str, survey: str, sql: str | None = None):
    def register(fn: Callable[[Entities], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: fn(Entities(spark, sf_dir))
        SURVEY[name] = survey
        if sql:
            ORACLES[name] = bindings.oracle(sql)
        return fn

    return register


def r6(c, name: str | None = None, digits: int = 6):
    c = F.col(c) if isinstance(c, str) else c
    out = F.round(c, digits)
    return out.alias(name) if name else out


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


def load() -> None:
    from . import q_clean, q_joins, q_reports, q_sources, q_stats  # noqa: F401
