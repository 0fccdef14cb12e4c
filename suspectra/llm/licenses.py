"""Licence scans: ordered signature rules over words, gated by keywords.

Hundreds of patterns see a text only if it holds their keyword. A detection that
lies within one of a better priority class, or within a larger or earlier one of
its own class, is suppressed. DataFrame functions only.

Defined cases: a null text has no words; empty tables give empty results; ids are
only carried (null and repeated ids keep a row for each row); other columns are
ignored; very long texts take memory in proportion to their words, and a row for each
match.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .license_rules import BASE, rules

RULES = rules()
CLASSES = 4
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def gate(key: str, pattern: str) -> str:
    """A substring of every match: the rule's keyword if it is one, else the longest literal word part (the first of them).

    Groups, classes and optional characters are taken as gaps, so what is left is in every match.
    """
    bare, less = pattern, None
    while bare != less:
        less, bare = bare, re.sub(r"\(\?:[^()]*\)(?:\?|\{\d+,\d+\})?", "\n", bare)
    bare = re.sub(r"\\S\+?|\[[^\]]*\]|.\?", "\n", bare)
    parts = re.findall(r"[^\s]+", bare)
    return key if any(key in part for part in parts) else max(parts, key=len)


def opener(key: str, pattern: str) -> str:
    """The rare substring whose absence rules a pattern out: ``licen`` where every match has it, else the gate."""
    bare = pattern
    while (less := re.sub(r"\(\?:[^()]*\)(?:\?|\{0,\d+\})", "", bare)) != bare:
        bare = less
    return "licen" if "licen" in bare and "|" not in bare else gate(key, pattern)


def padded(pattern: str) -> str:
    """A rule's pattern over words that have a space on each side, two between neighbours."""
    return " " + pattern.replace(" ", "  ").replace("m?  ?", "(?:m  )?").replace("share  ?alike", "share(?:  )?alike").replace("non  ?commercial", "non(?:  )?commercial").replace("no  ?deriv", "no(?:  )?deriv").replace("beer  ?ware", "beer(?:  )?ware") + " "


def _cells(norm: Column, pattern: Column) -> Column:
    """For each match of one rule, in order: how many words lie between it and the one before, and how many it has."""
    n_words = lambda s: ((F.char_length(s) - F.char_length(F.replace(s, F.lit(" ")))) / 2).cast("int")
    matches = F.regexp_extract_all(norm, pattern, F.lit(0))
    return F.transform(F.arrays_zip(F.slice(F.split(norm, pattern), F.lit(1), F.size(matches)).alias("p"), matches.alias("m")), lambda x: F.struct(n_words(x["p"]).alias("p"), n_words(x["m"]).alias("m")))


def detections(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row for each detection of each row of docs (one with nulls for none), with docs' columns but the text.

    Adds ``row`` (its row of docs), ``n_words``, ``start``, ``end`` (words, end
    exclusive), ``rank`` (index in RULES), ``cls`` and ``kept``.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    # One JSON literal, folded once: a literal for each field of each rule would make a plan of thousands of nodes.
    rows_json = json.dumps([{"rank": k, "cls": cls, "key": gate(key, pattern), "pattern": padded(pattern)} for k, (_, cls, key, pattern) in enumerate(RULES)])
    table = F.from_json(F.lit(rows_json), "array<struct<rank:int,cls:int,key:string,pattern:string>>")
    keys = sorted({opener(key, pattern) for _, _, key, pattern in RULES})
    opens = F.lit(False)
    for key in keys:
        opens = opens | F.contains(F.col("__low"), F.lit(key))
    norm = F.concat(F.lit(" "), F.array_join(F.filter(F.split(F.translate(body, UPPER, LOWERED), BREAK), lambda w: w != ""), "  "), F.lit(" "))
    tried = F.transform(F.filter(F.col("__rules"), lambda r: F.contains(F.col("__norm"), r["key"])), lambda r: F.struct(r["rank"].alias("rank"), r["cls"].alias("cls"), _cells(F.col("__norm"), r["pattern"]).alias("cells")))
    each = F.filter(tried, lambda x: F.size(x["cells"]) > 0)
    rows = (
        docs.withColumn("row", F.monotonically_increasing_id())
        .withColumn("n_words", F.regexp_count(body, F.lit(WORD)).cast("long"))
        .withColumn("__low", F.lower(body))
        .withColumn("__norm", F.when(opens, norm))
        .withColumn("__rules", table)
        .withColumn("__found", F.when(F.col("__norm").isNotNull(), each))
        .drop(text, "__low", "__norm", "__rules")
    )
    keep = [*[c for c in docs.columns if c != text], "row", "n_words"]
    # Each generator's row holds nothing but what is named: not the array of all matches.
    rules_of = rows.select(*keep, F.explode_outer("__found").alias("__d")).select(*keep, F.col("__d.rank").alias("rank"), F.col("__d.cls").alias("cls"), F.col("__d.cells").alias("__cells"))
    cells = rules_of.select(*keep, "rank", "cls", F.posexplode_outer("__cells").alias("__pos", "__cell")).repartition("row")
    # A match's place is the running sum of the words before it.
    end = F.sum(F.col("__cell.p") + F.col("__cell.m")).over(Window.partitionBy("row", "rank").orderBy("__pos")).cast("int")
    flat = cells.withColumn("end", end).withColumn("start", F.col("end") - F.col("__cell.m")).drop("__pos", "__cell")
    before = Window.partitionBy("row").orderBy(F.col("start"), F.col("end").desc(), F.col("cls"), F.col("rank")).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.lit(None).cast("int")
    for c in reversed(range(CLASSES)):
        reach = F.when(F.col("cls") == c, F.max(F.when(F.col("cls") <= c, F.col("end"))).over(before)).otherwise(reach)
    return flat.withColumn("kept", F.col("rank").isNotNull() & (F.coalesce(reach, F.lit(-1)) < F.col("end")))


def summary(docs: DataFrame) -> DataFrame:
    """A row per document: counts and places of the base phrases, labels, and the kept detections' words per word, 1 at most (where detections overlap, words count for each)."""
    names = F.split(F.lit(",".join(label for label, *_ in RULES)), ",")
    slim = docs.select("doc_id", "text")
    found = detections(slim).withColumn("label", F.get(names, F.col("rank")))
    base = F.col("rank") < len(BASE)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined(F.when(base | F.col("kept"), F.col("label"))).alias("labels"),
        F.least(F.lit(1.0), F.coalesce(F.sum(F.when(F.col("kept"), F.col("end") - F.col("start"))) / F.first("n_words"), F.lit(0.0))).alias("score"),
    ).drop("row")


def sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    table = ", ".join(f"({k}, {q(label)}, {cls}, {q(key)}, {q(padded(pattern))})" for k, (label, cls, key, pattern) in enumerate(RULES))
    return f"""
WITH rules(rank, label, cls, key, pattern) AS (VALUES {table}),
docs AS (SELECT row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWERED}') AS low FROM documents),
words AS (SELECT row, doc_id, low, list_filter(regexp_split_to_array(low, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM docs),
normed AS (SELECT row, low, ' ' || array_to_string(w, '  ') || ' ' AS norm FROM words),
tried AS (SELECT row, rank, label, cls, regexp_extract_all(norm, pattern) AS ms, regexp_split_to_array(norm, pattern) AS ps FROM normed JOIN rules ON contains(norm, key)),
cells AS (SELECT row, rank, label, cls, unnest(range(len(ms))) AS i,
  unnest(list_transform(ms, lambda s: (length(s) - length(replace(s, ' ', ''))) // 2)) AS m, unnest(list_transform(ps[1:len(ms)], lambda s: (length(s) - length(replace(s, ' ', ''))) // 2)) AS p FROM tried),
placed AS (SELECT row, rank, label, cls, m, sum(m + p) OVER (PARTITION BY row, rank ORDER BY i)::BIGINT AS stop FROM cells),
dets AS (SELECT row, rank, label, cls, stop - m AS start, stop FROM placed),
kept AS (SELECT *, NOT EXISTS (SELECT 1 FROM dets e WHERE e.row = d.row AND e.start <= d.start AND e.stop >= d.stop AND
  (e.cls < d.cls OR (e.cls = d.cls AND (e.stop - e.start > d.stop - d.start OR (e.start = d.start AND e.stop = d.stop AND e.rank < d.rank))))) AS kept FROM dets d),
each AS (SELECT row, count(*) FILTER (rank < 3) AS n_base, min(start) FILTER (rank < 3) AS first_word, max(start) FILTER (rank < 3) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (rank < 3) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (rank < 3 OR kept) AS labels,
  sum(stop - start) FILTER (kept)::BIGINT AS covered FROM kept GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  least(1.0::DOUBLE, CASE WHEN len(w) > 0 THEN coalesce(covered, 0)::DOUBLE / len(w)::DOUBLE ELSE 0.0 END) AS score
FROM words LEFT JOIN each USING (row)"""
