"""URL filters: hashed host-suffix and path-prefix expressions.

Each URL expands into (host suffix + path prefix) expressions, no more labels or
levels than the rules have, and into its host's words. Expressions meet rules on short
prefixes of their SHA-256; full digests confirm; the longest rule wins. Rules on a word
of a host, as ``~word``, are the method's own: they settle what no other rule fits.
DataFrame functions only.

Defined cases: a null URL or one without ``://`` has empty host and path and no
rule; null and repeated page ids keep their own rows; equal rules count once, and
of rules with one host and path that disagree, block wins; other columns are kept,
clashing ones replaced; very long URLs expand no further than the rules reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Words of a host's labels that the method itself blocks where no rule fits; further ones are rows of the table of rules.
BAD_WORDS = ("spam", "casino", "pills", "porn", "xxx", "viagra", "betting", "warez", "phishing", "malware")
PREFIX = 8
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules=RULES, words=BAD_WORDS) -> DataFrame:
    """verdict and rule: expressions, and words of hosts as ``~word``."""
    return spark.createDataFrame([(v, r) for v, r in rules] + [("block", f"~{w}") for w in words], "verdict string, rule string")


def prepared(rules: DataFrame) -> DataFrame:
    """Rules with digests; one row per expression."""
    split = rules.withColumn("rule_host", F.substring_index("rule", "/", 1)).withColumn("rule_path", F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)"))
    full = F.sha2(F.col("rule"), 256)
    return split.groupBy("rule", "rule_host", "rule_path").agg(F.max("verdict").alias("verdict")).withColumn("full", full).withColumn("short", F.substring("full", 1, PREFIX))


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    there = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWERED)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(there, host).otherwise(""), F.when(there, path).otherwise("")


def expressions(host: Column, path: Column, labels: int, lengths: list[int], levels: int) -> Column:
    """Host suffixes of up to ``labels`` labels, each with the path's prefixes: at the first ``levels`` slashes, and of the given lengths."""
    cells = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(cells), F.lit(max(labels, 1)))), lambda n: F.array_join(F.slice(cells, -n, n), "."))
    steps = F.slice(F.split(path, "/"), 1, levels + 1)
    at_slash = F.when(F.size(F.split(path, "/")) > 1, F.transform(F.sequence(F.lit(1), F.least(F.size(F.split(path, "/")) - 1, F.lit(max(levels, 1)))), lambda n: F.concat(F.array_join(F.slice(steps, F.lit(1), n), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    others = F.array(*[F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>")
    prefixes = F.array_distinct(F.concat(at_slash, F.filter(others, lambda p: p.isNotNull())))
    return F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages' columns (clashing ones replaced) with host, path, rule and verdict."""
    table = prepared(rules)
    # The rules' own reach: a few numbers, whatever their count. Rules without a closing slash need prefixes of their lengths.
    own = ~F.col("rule").startswith("~")
    reach = table.filter(own).agg(F.max(F.size(F.split("rule_host", r"\."))).alias("labels"), F.max(F.size(F.split("rule_path", "/")) - 1).alias("levels"), F.array_sort(F.collect_set(F.when(~F.col("rule_path").endswith("/"), F.char_length("rule_path")))).alias("lengths")).first()
    host, path = parts(F.col(url))
    ours = ("host", "path", "rule", "verdict")
    keep = [c for c in pages.columns if c not in ours]
    # Columns of pages travel as one struct, so that no name of theirs meets one of the steps'.
    base = pages.select(F.struct(*keep).alias("page"), F.monotonically_increasing_id().alias("row"), host.alias("host"), path.alias("path"))
    words = F.transform(F.array_distinct(F.split("host", "[.-]")), lambda w: F.concat(F.lit("~"), w))
    each = F.concat(expressions(F.col("host"), F.col("path"), reach["labels"] or 0, list(reach["lengths"] or []), reach["levels"] or 0), words)
    wide = base.select("page", "row", "host", "path", F.posexplode_outer(each).alias("pos", "x")).withColumn("full", F.sha2(F.col("x"), 256)).withColumn("short", F.substring("full", 1, PREFIX)).drop("x")
    hits = F.struct(own.alias("own"), F.char_length("rule").alias("n"), F.col("verdict").alias("v"), F.col("rule").alias("r"))
    met = wide.join(table.select(F.col("short").alias("rule_short"), F.col("full").alias("rule_full"), hits.alias("hit")), F.col("short") == F.col("rule_short"), "left")
    # What met nothing stops here; each page's first expression carries it on.
    met = met.withColumn("hit", F.when(F.col("full") == F.col("rule_full"), F.col("hit"))).filter(F.col("hit").isNotNull() | (F.coalesce("pos", F.lit(0)) == 0))
    best = met.groupBy("row").agg(*[F.first(c).alias(c) for c in ("page", "host", "path")], F.max("hit").alias("hit"))
    return best.select("page.*", "host", "path", F.when(F.col("hit.own"), F.col("hit.r")).alias("rule"), F.coalesce("hit.v", F.lit(default)).alias("verdict"))


def sql() -> str:
    fits = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES)
    words = ", ".join(f"'{w}'" for w in BAD_WORDS)
    return f"""
WITH rules(verdict, rule, h, p) AS (VALUES {fits}),
cut AS (SELECT row_number() OVER () AS row, page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT row, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWERED}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
best AS (SELECT row, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY row)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN list_has_any(regexp_split_to_array(host, '[.-]'), [{words}]) THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN best USING (row)"""
