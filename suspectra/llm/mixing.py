"""Mixing sources to target weights by weighted fair queueing.

Each source's documents, shuffled by a hash, queue for up to ``repeats`` rounds.
A copy's virtual finish time is its source's words up to and including it, divided
by the source's target. Copies are taken in the order of finish time over all
sources until the total budget is spent. DataFrame functions only.

No window spans a source: cumulative sums run within hash ranges of about
``BLOCK`` rows (the square root of a source's rows, where that is more) and start from the sums of the ranges before, so a source with a
third of all rows is spread like the others. The same holds for the global order. Null
ids have one hash, so their rows are cut into ranges by size.

Defined cases: a null text has 0 words and is never taken; a null source is a
source, weighed last; null and repeated ids keep their own rows (equal rows are
interchangeable); an empty table gives an empty mix; other columns are kept,
clashing ones replaced.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage_table

WORDS = r"[^\x20\x09-\x0D]+"
REPEATS = 3
BLOCK = 2_000
SEED = "mix"


def targets(sizes: DataFrame, budget: int | None = None, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size) with ``weight`` and ``target``: shares of the budget by weight, none above repeats * source_size.

    Water filling in closed form: in the order of cap / weight, a source is capped
    iff its cap is below what the rest would give it. One row per source, so the
    ordered windows see sources, not documents.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1).withColumn("cap", F.col("source_size") * repeats)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    total = F.lit(budget).cast("long") if budget is not None else F.sum("source_size").over(everything)
    level = ranked.withColumn("left", total - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    full = level.withColumn("full", F.col("cap") * F.col("weights") <= F.col("left") * F.col("weight"))
    # Capped sources are a prefix of this order; the first that isn't sets the level for all after it.
    first = F.first(F.when(~F.col("full"), F.struct("left", "weights")), ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, 0))
    more = [c for c in sizes.columns if c not in ("source", "source_size")]
    return full.withColumn("first", first).select("source", "source_size", *more, "weight", F.when(F.col("first").isNull(), F.col("cap").cast("double")).otherwise(F.col("first.left") * F.col("weight") / F.col("first.weights")).alias("target"))


def _hash(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def _within(doc_id: Column, size: Column, h: Column) -> Column:
    """A range's part, in the order of hash, id and size: before, by size among, and behind the rows with a null id."""
    at = int(hashlib.md5(f"{SEED}:".encode()).hexdigest()[:15], 16)
    return F.when(doc_id.isNull(), size + 1).when(h < at, F.lit(0)).otherwise(F.lit(1 << 62)).cast("long")


def mix(docs: DataFrame, repeats: int = REPEATS, budget: int | None = None) -> DataFrame:
    """docs' columns but the text, with size, source_size, target, taken (words, repeats counted)."""
    keep = [c for c in docs.columns if c not in ("text", "size", "source_size", "target", "taken")]
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORDS)), F.lit(0)).cast("long")
    sized = stage_table(docs.select(*keep, size.alias("size")).withColumn("__h", _hash(F.col("doc_id"))), "mix")
    per = stage_table(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("__n")), budget, repeats), "targets")
    # Hash ranges of a source: as many as hold BLOCK rows each. Ranges are few, so their running sums are cheap.
    known = per.select(F.col("source").alias("__s"), "source_size", "target", F.ceil(F.col("__n") / F.greatest(F.lit(float(BLOCK)), F.sqrt("__n"))).cast("long").alias("__k"))
    placed = sized.join(known, sized["source"].eqNullSafe(known["__s"])).drop("__s").withColumn("__r", F.floor(F.col("__h") / F.lit(float(1 << 60)) * F.col("__k")).cast("long")).withColumn("__in", _within(F.col("doc_id"), F.col("size"), F.col("__h")))
    sums = placed.groupBy(F.col("source").alias("__s"), F.col("__r").alias("__r2"), F.col("__in").alias("__in2")).agg(F.sum("size").alias("__sum"))
    starts = sums.withColumn("__from", F.sum("__sum").over(Window.partitionBy("__s").orderBy("__r2", "__in2")) - F.col("__sum")).drop("__sum")
    inner = Window.partitionBy("source", "__r", "__in").orderBy("__h", F.col("doc_id"), "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = placed.join(starts, placed["source"].eqNullSafe(starts["__s"]) & (F.col("__r") == F.col("__r2")) & (F.col("__in") == F.col("__in2"))).drop("__s", "__r2", "__in2").withColumn("__cum", F.sum("size").over(inner) + F.col("__from"))
    # Each copy's finish time, of the copies that may be taken: none of a source without words.
    finish = lambda e: (F.col("__cum") + F.lit(e) * F.col("source_size")) / F.col("target")
    timed = stage_table(queued.withColumn("__t", F.when((F.col("target") > 0) & (F.col("size") > 0), F.array(*[finish(e) for e in range(repeats)]))), "queue")
    copies = timed.select("doc_id", "source", "size", "__h", F.posexplode("__t").alias("__e", "__at"))
    facts = timed.agg(F.sum("size").alias("all"), F.count("*").alias("n")).first()
    limit = int(budget if budget is not None else facts["all"] or 0)
    slots = max(256, math.isqrt(facts["n"]))
    slot = F.floor(F.col("__at") * slots).cast("long")
    # The global range sort: slots of finish time in order, then the exact order within the slot where the budget ends.
    filled = copies.groupBy(slot.alias("__slot")).agg(F.sum("size").alias("__w")).withColumn("__upto", F.sum("__w").over(Window.orderBy("__slot")))
    edge = filled.filter(F.col("__upto") >= limit).orderBy("__slot").limit(1).first()
    at, spent = (edge["__slot"], edge["__upto"] - edge["__w"]) if edge else (None, 0)
    early = F.size(F.filter("__t", lambda t: F.floor(t * slots).cast("long") < F.lit(at))) if at is not None else F.coalesce(F.size("__t"), F.lit(0))
    keys = ["source", "__h", "doc_id", "size"]
    if at is None:
        out = timed.withColumn("taken", F.when(F.col("__t").isNotNull(), F.col("size") * F.size("__t")).otherwise(F.lit(0)).cast("long"))
    else:
        line = Window.orderBy("__at", F.col("source").isNull(), "source", "__h", "doc_id", "size", "__e").rowsBetween(Window.unboundedPreceding, 0)
        last = copies.filter(slot == at).withColumn("__run", F.sum("size").over(line)).filter(F.col("__run") <= limit - spent)
        marks = last.select(*[F.col(k).alias(f"__2{k}") for k in keys], F.col("__at").alias("__last"))
        same = F.lit(True)
        for k in keys:
            same = same & timed[k].eqNullSafe(marks[f"__2{k}"])
        # Rounds of a document are at least 1 / repeats apart, so at most one of its copies is in the last slot.
        hit = timed.join(marks, same & F.array_contains("__t", F.col("__last")), "left")
        out = hit.withColumn("taken", F.when(F.col("__t").isNotNull(), F.col("size") * (early + F.col("__last").isNotNull().cast("int"))).otherwise(F.lit(0)).cast("long"))
    return out.select(*keep, "size", "source_size", "target", "taken")


SQL = f"""
WITH sized AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(len(regexp_extract_all(text, '{WORDS}')), 0)::BIGINT AS size, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, {REPEATS} * source_size AS cap FROM sources),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER f, 0))::BIGINT AS rest, (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0))::BIGINT AS weights,
  row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS pos FROM ranked WINDOW f AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stop AS (SELECT rest, weights, pos FROM levels WHERE cap * weights > rest * weight ORDER BY pos LIMIT 1),
aims AS (SELECT l.source, l.source_size, l.weight, CASE WHEN s.pos IS NULL OR l.pos < s.pos THEN cap::DOUBLE ELSE (s.rest * l.weight)::DOUBLE / s.weights::DOUBLE END AS target FROM levels l LEFT JOIN stop s ON true),
queued AS (SELECT z.rid, z.doc_id, z.source, z.size, z.h, a.source_size, a.target, sum(z.size) OVER (PARTITION BY z.source ORDER BY z.h, z.doc_id, z.size ROWS UNBOUNDED PRECEDING)::BIGINT AS cum
  FROM sized z JOIN aims a ON z.source IS NOT DISTINCT FROM a.source),
copies AS (SELECT *, (cum + e * source_size)::DOUBLE / target AS finish FROM queued, range({REPEATS}) t(e) WHERE target > 0 AND size > 0),
line AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, h, doc_id, size, e ROWS UNBOUNDED PRECEDING) AS run FROM copies),
got AS (SELECT rid, sum(size)::BIGINT AS taken FROM line WHERE run <= (SELECT sum(size) FROM sized) GROUP BY rid)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(g.taken, 0)::BIGINT AS taken FROM queued q
LEFT JOIN got g USING (rid)"""
