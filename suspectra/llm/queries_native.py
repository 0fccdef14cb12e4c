"""Thin queries of the operators that SQL can express, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses, mixing, secrets, urls
from .shared import read_table


def op1_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents arrive in two versions of the corpus; the second scans only blobs that the ledger of the first lacks."""
    docs = read_table(spark, sf_dir, "documents")
    ledger = secrets.Ledger.temporary(spark)
    version = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    first, second = (ledger.update(docs.filter(version == k), rules=secrets.WHOLE) for k in (0, 1))
    found = ledger.findings(first.unionAll(second), secrets.WHOLE)
    base = F.filter("spans", lambda x: x["kind"].isin(*secrets.BASE))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("path").alias("doc_id"), *[count(k) for k in secrets.BASE], F.sha2(secrets.digest(base), 256).alias("base_sha256"), secrets.digest(F.col("spans")).alias("spans"))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def op1_sql() -> str:
    parts = []
    for k, r in enumerate(secrets.RULES):
        p = _sql_text(r.pattern)
        parts.append(f"""
SELECT t, '{r.kind}' AS kind, {k} AS rank, upto - m AS start, upto AS stop FROM (
  SELECT t, g, m, sum(p + m) OVER (PARTITION BY t ORDER BY i)::BIGINT AS upto FROM (
    SELECT t, unnest(range(len(ms))) AS i, unnest(list_transform(ms, lambda x: length(x))) AS m, unnest(list_transform(gs, lambda x: length(x))) AS g,
           unnest(list_transform(ps[1:len(ms)], lambda x: length(x))) AS p
    FROM (SELECT t, regexp_extract_all(t, {p}) AS ms, regexp_extract_all(t, {p}, {r.group}) AS gs, regexp_split_to_array(t, {p}) AS ps FROM texts))) WHERE g >= {r.least}""")
    return f"""
WITH texts AS (SELECT DISTINCT coalesce(text, '') AS t FROM documents),
hits AS ({' UNION ALL '.join(parts)}),
each AS (SELECT t, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM hits GROUP BY t)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN each ON t = coalesce(text, '')"""


def op2_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(read_table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read_table(spark, sf_dir, "pages").select("page_id", "url"), urls.rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


def op9_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op1_secret_ledger": op1_secret_ledger, "op2_license_rules": op2_license_rules, "op4_url_filter": op4_url_filter, "op9_fair_mix": op9_fair_mix}


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_ledger": op1_sql(), "op2_license_rules": licenses.sql(), "op4_url_filter": urls.sql(), "op9_fair_mix": mixing.SQL}
