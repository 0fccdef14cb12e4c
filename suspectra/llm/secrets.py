"""Secret scans: an incremental blob ledger.

Every version of a text is addressed by its SHA-256. A ledger holds which (blob,
rule, rule version) triples have been scanned and what was found; only triples
that it lacks are scanned, each blob once however many paths hold it. What was
found is appended to the ledger, and findings are read from the ledger and joined
back to every path: no pattern is tried on a path. DataFrame functions only.

A match's position is the running sum of the lengths before it, by a window over the
matches of one text; so a text with a million matches is a million narrow rows, and
nothing grows with the square of their number.

Defined cases: a null text is the empty text; a null id is kept as a path of its
own (null-safe joins); repeated rows keep their own result rows; an empty table
gives empty results; other columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import exists, new_folder, sized, stage_table


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``pattern``'s matches are taken leftmost and non-overlapping; those whose
    group ``group`` has fewer than ``least`` characters are dropped. ``gate``: a cheap pattern
    that every text with a match contains."""

    kind: str
    version: int
    pattern: str
    gate: str
    group: int = 0
    least: int = 1


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either("api") + "_?" + _either("key")

#: Base kinds first; the order breaks ties between spans with one start.
RULES = (
    Rule("assign", 1, rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", rf"({_KEYS})", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]+", r"AKIA", 0, 16),
    Rule("hex", 1, r"[0-9a-f]+", r"[0-9a-f]{32}", 0, 32),
    Rule("bearer", 1, r"[Bb]earer\x20+[A-Za-z0-9._~+/-]+=*", r"[Bb]earer\x20", 0, 27),
    Rule("github", 1, r"(?:gh[opsur]_|github_pat_)[A-Za-z0-9_]+", r"gh[opsur]_|github_pat_", 0, 36),
    Rule("google", 1, r"AIza[A-Za-z0-9_-]+", r"AIza", 0, 39),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", r"eyJ", 0, 40),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"PRIVATE KEY-----", 0, 1),
    Rule("slack", 1, r"xox[abeoprs]-[A-Za-z0-9-]+", r"xox[abeoprs]-", 0, 15),
    Rule("stripe", 1, r"[rs]k_live_[A-Za-z0-9]+", r"_live_", 0, 24),
    Rule("url", 1, r"[a-z]+://[A-Za-z0-9._-]+:[^\x00-\x20/@:]+@[A-Za-z0-9.-]+", r"://[^\x00-\x20/@:]+:[^\x00-\x20/@:]+@", 0, 12),
)
BASE = ("assign", "access", "hex")
#: A private key: from its BEGIN to its END line, whatever stands between but five dashes; without an END line, the
#: lines of an encrypted key's head and those of base64 alone, and long runs of base64 behind a few other characters.
#: All loops are possessive, so that long keys need no stack.
_PEM = r"""-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[^-]++|-{1,4}+(?!-))*+-?-----END [A-Z ]*PRIVATE KEY-----|\
(?:\s*+(?:Proc-Type|DEK-Info):[^\r\n]*+)*+(?:(?:\r?\n){1,2}+[\x20\t>]*+[A-Za-z0-9+/]++={0,2}+[\x20\t]*+(?=[\r\n]|\z)|[^A-Za-z0-9+/=]{0,16}+[A-Za-z0-9+/]{24,}+={0,2}+)*+)""".replace("\\\n", "")
#: Patterns that leave out matches which are too short. A run is taken whole from its start, so matches are the same.
_LONG = {"access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}
#: RULES with private keys up to their ends, for redaction and op1. RULES itself is what op1's SQL is made of.
WHOLE = tuple(replace(r, version=2, pattern=_PEM) if r.kind == "pem" else replace(r, pattern=_LONG.get(r.kind, r.pattern)) for r in RULES)
#: Cheap substrings of the lower-cased text, one of which every match of a kind contains.
_HINTS = {"assign": ("passw", "secret", "token", "apikey", "api_key"), "access": ("akia",), "bearer": ("bearer",), "github": ("gh",), "google": ("aiza",), "jwt": ("eyj",), "pem": ("private key-----",), "slack": ("xox",), "stripe": ("_live_",), "url": ("://",)}
SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"
#: A ledger in memory: a row for each blob, rule and version.
LEDGER = "blob string, rule string, version int, spans array<struct<start:int,end:int>>"
#: A ledger in a folder: a row for each blob and scan.
BOOK = f"blob string, done array<struct<rule:string,version:int>>, spans {SPANS}"
#: Blobs, of about 100 bytes each, up to which a table of them is broadcast.
FEW = 100_000
BLOCK = 8192


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _pair(r: Rule) -> Column:
    return F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"))


def _cells(text: Column, low: Column, rule: Rule) -> Column:
    """For each match, in order: the length of what lies between it and the one before, its own, and whether it counts."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    pieces = F.slice(F.split(text, rule.pattern), F.lit(1), F.size(whole))
    cells = F.transform(F.arrays_zip(pieces.alias("p"), whole.alias("m"), part.alias("g")), lambda x: F.struct(F.char_length(x["p"]).alias("p"), F.char_length(x["m"]).alias("m"), (F.char_length(x["g"]) >= rule.least).alias("ok")))
    may = F.lit(rule.kind not in _HINTS)
    for hint in _HINTS.get(rule.kind, ()):
        may = may | F.contains(low, F.lit(hint))
    return F.when(may & text.rlike(rule.gate), cells)


def _todo(paths: DataFrame, seen: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """of (blob), rep (a path that has it) and todo (pairs of rule and version that ``seen``, blob and done, lacks)."""
    blobs = paths.groupBy("blob").agg(F.min("path").alias("rep")).withColumn("todo", F.array(*[_pair(r) for r in rules]))
    if seen is not None:
        blobs = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except("todo", F.coalesce("done", F.array().cast("array<struct<rule:string,version:int>>")))).drop("done")
    return blobs.filter(F.size("todo") > 0).withColumnRenamed("blob", "of")


def _scanned(versions: DataFrame, todo: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """BOOK rows: each blob of ``todo`` scanned for its rules. versions: path, text, blob."""
    content = versions.join(todo, (F.col("blob") == F.col("of")) & F.col("path").eqNullSafe(F.col("rep"))).select("blob", F.coalesce("text", F.lit("")).alias("text"), "todo")
    # A repeated row of a path is a row of its own until its matches are counted.
    rows = content.withColumn("row", F.monotonically_increasing_id()).withColumn("low", F.lower("text"))
    tried = [F.struct(F.lit(k).alias("rank"), F.when(F.array_contains("todo", _pair(r)), _cells(F.col("text"), F.col("low"), r)).alias("cells")) for k, r in enumerate(rules)]
    hits = rows.select("blob", "row", F.col("todo").alias("done"), F.filter(F.array(*tried), lambda x: F.size(x["cells"]) > 0).alias("hits"))
    # The generator's row holds nothing but what is named: not the array of all matches.
    flat = hits.select("blob", "row", "done", F.explode_outer("hits").alias("hit")).select("blob", "row", "done", F.col("hit.rank").alias("rank"), F.col("hit.cells").alias("cells"))
    each = flat.select("blob", "row", "done", "rank", F.posexplode_outer("cells").alias("pos", "cell"))
    placed = each.repartition("blob").withColumn("end", F.sum(F.col("cell.p") + F.col("cell.m")).over(Window.partitionBy("blob", "row", "rank").orderBy("pos")).cast("int"))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    span = F.when(F.col("cell.ok"), F.struct((F.col("end") - F.col("cell.m")).alias("start"), "rank", "end", F.get(kinds, F.col("rank")).alias("kind")))
    return placed.groupBy("blob", "row").agg(F.first("done").alias("done"), F.array_sort(F.collect_list(span)).cast(SPANS).alias("spans")).groupBy("blob").agg(F.first("done").alias("done"), F.max("spans").alias("spans"))


def _found(book: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blob and spans of blobs with a finding of the rules' present versions, by start and then rule order."""
    now = F.array(*[_pair(r) for r in rules])
    order = F.array(*[F.lit(r.kind) for r in rules])
    mine = F.filter("spans", lambda x: F.exists("done", lambda d: (d["rule"] == x["kind"]) & F.array_contains(now, d)))
    ranked = F.transform(mine, lambda x: F.struct(x["start"].alias("start"), (F.array_position(order, x["kind"]) - 1).cast("int").alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))
    each = book.filter(F.size("spans") > 0).select("blob", ranked.alias("spans")).filter(F.size("spans") > 0)
    sorted_ = each.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    # Equal neighbours go: a blob that was scanned twice has its spans once.
    return sorted_.select("blob", F.filter("spans", lambda x, k: (k == 0) | (x != F.get("spans", k - 1))).alias("spans"))


def _joined(paths: DataFrame, found: DataFrame) -> DataFrame:
    return paths.join(sized(found, FEW), "blob", "left").select("path", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def _addressed(versions: DataFrame, path: str, text: str) -> DataFrame:
    return versions.select(F.col(path).alias("path"), F.col(text).alias("text")).withColumn("blob", blob_id(F.col("text")))


class Ledger:
    """A ledger in a folder that all executors see; scans append to it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @classmethod
    def temporary(cls, spark: SparkSession) -> Ledger:
        return cls(spark, new_folder(spark, "ledger"))

    def begun(self) -> bool:
        return exists(self.spark, f"{self.folder}/_SUCCESS")

    def read(self) -> DataFrame:
        return self.spark.read.schema(BOOK).parquet(self.folder) if self.begun() else self.spark.createDataFrame([], BOOK)

    def update(self, versions: DataFrame, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scan what the ledger lacks of a version of the paths; returns path and blob of each of its rows."""
        texts = _addressed(versions, path, text)
        paths = stage_table(texts.drop("text"), "paths")
        seen = self.read().groupBy("blob").agg(F.flatten(F.collect_list("done")).alias("done")) if self.begun() else None
        todo = stage_table(_todo(paths, seen, rules), "todo").hint("shuffle_hash")
        _scanned(texts, todo, rules).write.mode("append").parquet(self.folder)
        return paths

    def findings(self, paths: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """path, blob and spans of each row of paths (path, blob)."""
        return _joined(paths, _found(self.read(), rules))


def scan(versions: DataFrame, path: str = "doc_id", text: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Scan what the ledger lacks.

    versions: a row for each version of each path. ledger: rows of earlier calls
    (LEDGER); None: none. Returns (findings, entries): findings has ``path``,
    ``blob`` and ``spans``, an array<struct<start,rank,end,kind>> by start and then
    rule order, one row per row of versions; entries are this call's additions to
    the ledger, blobs without findings included.
    """
    texts = _addressed(versions, path, text)
    paths = stage_table(texts.drop("text"), "paths")
    seen = old = None
    if ledger is not None:
        kinds = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), F.lit(0).alias("rank"), x["end"].alias("end"), F.col("rule").alias("kind")))
        old = ledger.select("blob", F.array(F.struct("rule", "version")).alias("done"), kinds.cast(SPANS).alias("spans"))
        seen = old.groupBy("blob").agg(F.flatten(F.collect_list("done")).alias("done"))
    todo = stage_table(_todo(paths, seen, rules), "todo").hint("shuffle_hash")
    fresh = stage_table(_scanned(texts, todo, rules), "scanned")
    book = fresh if old is None else fresh.unionByName(old)
    of = lambda d: F.transform(F.filter("spans", lambda x: x["kind"] == d["rule"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    entries = fresh.select("blob", F.explode(F.transform("done", lambda d: F.struct(d["rule"].alias("rule"), d["version"].alias("version"), of(d).alias("spans")))).alias("e")).select("blob", "e.*")
    return _joined(paths, _found(book, rules)), entries


def digest(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))


def _cuts(found: DataFrame) -> DataFrame:
    """blob and cuts: overlapping spans merged and clipped to blocks of BLOCK characters; by block, where to cut and whether a mark goes there."""
    rows = found.select("blob", F.explode("spans").alias("x")).select("blob", "x.start", "x.end")
    order = Window.partitionBy("blob").orderBy("start", F.col("end").desc())
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    grouped = rows.withColumn("apart", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int")).withColumn("at", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = grouped.groupBy("blob", "at").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    block = F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("end") - 1) / BLOCK))).alias("block")
    clipped = merged.select("blob", "start", "end", block).select("blob", "block", F.struct(F.greatest(F.col("start") - F.col("block") * BLOCK, F.lit(0)).cast("int").alias("start"), F.least(F.col("end") - F.col("block") * BLOCK, F.lit(BLOCK)).cast("int").alias("end"), (F.col("start") >= F.col("block") * BLOCK).alias("mark")).alias("cut"))
    return clipped.groupBy("blob", "block").agg(F.array_sort(F.collect_list("cut")).alias("cuts")).groupBy("blob").agg(F.map_from_entries(F.collect_list(F.struct(F.col("block").cast("int"), "cuts"))).alias("cuts"))


def _without(block: Column, cuts: Column, mark: str) -> Column:
    """A block of text with its cuts replaced."""
    before = lambda k: F.coalesce(F.get(cuts, k - 1)["end"], F.lit(0))
    pieces = F.transform(cuts, lambda x, k: F.concat(F.substring(block, before(k) + 1, x["start"] - before(k)), F.when(x["mark"], F.lit(mark)).otherwise("")))
    return F.concat(F.array_join(pieces, ""), F.substring(block, F.get(cuts, F.size(cuts) - 1)["end"] + 1, F.lit(BLOCK)))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = WHOLE, mark: str = "[REDACTED]", ledger: Ledger | None = None) -> DataFrame:
    """Documents with every span of the ledger replaced by ``mark``, overlapping ones by one; only texts with a finding change.

    Joined by blob. ``n_chars`` follows the text. ledger: None for one of its own.
    """
    book = ledger or Ledger.temporary(docs.sparkSession)
    paths = book.update(docs, rules=rules)
    found = book.findings(paths.select("path", "blob"), rules).filter(F.size("spans") > 0).select("blob", "spans").dropDuplicates(["blob"])
    hit = stage_table(_cuts(found), "cuts").withColumnsRenamed({"blob": "__hit", "cuts": "__cuts"})
    blocks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    # A transform over an array of one binds a block's cuts once.
    one = lambda b, k: F.get(F.transform(F.array(F.col("__cuts")[k]), lambda c: _without(b, c, mark)), F.lit(0))
    cut = F.array_join(F.transform(blocks, lambda b, k: F.coalesce(one(b, k), b)), "")
    out = docs.withColumn("__blob", blob_id(F.col("text"))).join(sized(hit, FEW // 4), F.col("__blob") == F.col("__hit"), "left").withColumn("__clean", F.when(F.col("__hit").isNotNull(), cut).otherwise(F.col("text")))
    return out.select(*[F.col("__clean").alias("text") if c == "text" else (F.when(F.col("__hit").isNotNull(), F.char_length("__clean").cast("long")).otherwise(F.col("n_chars")).alias("n_chars") if c == "n_chars" else F.col(c)) for c in docs.columns])
