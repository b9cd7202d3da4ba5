"""Secrets in texts: a ledger of content-addressed blobs, of which only unseen (blob, rule version) pairs are scanned. Expressions only.

A version of a path is addressed by the SHA-256 of its text, its blob. Equal texts, under whatever path or at whatever time, are one
blob, which is scanned once for each version of each rule. The ledger has one row for each blob and scan: `blob`, `scanned` (the rules as
`kind@version`) and `spans` (kind, version, start, end in code points). Findings are joined back to all versions of all paths by blob.

Copies meet before the exchange (partial aggregates), so a text that a third of all paths have is sent once by each task. The join back is
a left join of versions with one ledger row per blob; a common blob's versions are split by Spark's skew join. A ledger is any DataFrame of
that shape; `update` appends to one in a folder.

A null text is empty. Null or repeated paths keep their rows. Columns of versions other than the text are kept; `blob` and `spans` are
added and must not be there. An empty table, or one without secrets, has no spans; a blob without spans is in the ledger all the same.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEDGER = "blob binary, scanned array<string>, spans array<struct<kind:string,version:int,start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of `pattern` whose `group` has at least `least` characters. A text has none without one of the `hints`."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1
    hints: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


def either_case(words: str) -> str:
    """A pattern with every ASCII letter in both cases."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isascii() and c.isalpha() else c for c in words)


ASSIGNED = either_case("(password|passwd|secret|token|api_?key)") + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE_RULES = [Rule("assign", ASSIGNED, 2, 6), Rule("access", "AKIA[A-Z0-9]+", 0, 20, hints=("AKIA",)), Rule("hex", "[0-9a-f]{24,}", 0, 24)]
#: Formats that name themselves.
MORE_RULES = [
    Rule("private", "-----BEGIN [A-Z ]*PRIVATE KEY-----", hints=("PRIVATE KEY-----",)),
    Rule("forge", "gh[pousr]_[A-Za-z0-9]{36,}", hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("signed", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hints=(".eyJ",)),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}", hints=("xox",)),
]
RULES = BASE_RULES + MORE_RULES


def addressed(versions: DataFrame, text: str = "text") -> DataFrame:
    """`versions` with the blob of each text."""
    return versions.withColumn("blob", F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)))


def empty_ledger(spark: SparkSession) -> DataFrame:
    kinds = (column.split(" ") for column in LEDGER.split(", "))
    return spark.range(0).select(*(F.lit(None).cast(kind).alias(name) for name, kind in kinds))


def unseen(versions: DataFrame, rules: list[Rule], ledger: DataFrame | None = None, text: str = "text") -> DataFrame:
    """(blob, text, todo): each blob that the ledger lacks for some of the `rules` (kind@version), once."""
    blobs = addressed(versions.select(text), text).groupBy("blob").agg(F.first(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    wanted = F.array(*(F.lit(r.name) for r in rules))
    if ledger is None:
        return blobs.withColumn("todo", wanted)
    seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("seen"))
    left = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))))
    return left.filter(F.size("todo") > 0).select("blob", "text", "todo")


def _matches(rule: Rule, text: Column) -> Column:
    """Array of (gap before a match, length of the match, length of its group), or null where there is none."""
    pattern = F.lit(rule.pattern)
    hits, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, rule.pattern, -1)
    groups = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else hits
    found = F.transform(F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), groups.alias("group")), lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("size"), F.length(x["group"]).alias("checked")))
    there = F.rlike(text, pattern)
    if rule.hints:
        there = F.reduce(F.array(*(F.contains(text, F.lit(h)) for h in rule.hints)), F.lit(False), lambda a, b: a | b) & there
    return F.when(there, F.filter(found, lambda x: x["size"].isNotNull()))


def scan(blobs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Ledger rows of `blobs` (blob, text, todo). A match's place is the sum of all gaps and matches before it, so that a long text with many matches stays linear."""
    kinds = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(r.least).alias("least"), F.when(F.array_contains("todo", r.name), _matches(r, F.col("text"))).alias("matches")) for r in rules))
    rows = blobs.select("blob", "todo", F.filter(kinds, lambda k: F.size(k["matches"]) > 0).alias("kinds"))
    rows = rows.select("blob", "todo", F.explode_outer("kinds").alias("k")).select("blob", "todo", "k.kind", "k.version", "k.least", F.posexplode_outer("k.matches").alias("at", "m"))
    # the blobs are already together: neither the windows nor the groups below exchange anything
    so_far = Window.partitionBy("blob", "kind", "version").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("m.gap") + F.col("m.size")).over(so_far).cast("int"))
    span = F.struct("kind", "version", (F.col("end") - F.col("m.size")).alias("start"), "end")
    return rows.groupBy("blob").agg(F.first("todo").alias("scanned"), F.collect_list(F.when(F.col("m.checked") >= F.col("least"), span)).alias("spans"))


def findings(versions: DataFrame, ledger: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """`versions` without their text, with blob and `spans` of the given rule versions (ordered by start, then by the rules' order, then end)."""
    names = F.array(*(F.lit(r.name) for r in rules))
    rank = lambda s: F.array_position(names, F.concat(s["kind"], F.lit("@"), s["version"].cast("string")))
    asked = F.filter(F.flatten(F.collect_list("spans")), lambda s: rank(s) > 0)
    ordered = F.array_sort(F.transform(asked, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["version"].alias("version"))))
    found = ledger.filter(F.size("spans") > 0).groupBy("blob").agg(ordered.alias("spans"))
    rows = addressed(versions, text).drop(text).join(found, "blob", "left")
    return rows.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,rank:bigint,end:int,kind:string,version:int>>")))


def update(versions: DataFrame, rules: list[Rule], folder: str, text: str = "text") -> DataFrame:
    """Scan what the ledger in `folder` lacks, append it there, and return the ledger. The folder may be new; it must be one that all executors share."""
    spark = versions.sparkSession
    empty_ledger(spark).write.mode("append").parquet(folder)
    ledger = spark.read.schema(LEDGER).parquet(folder)
    scan(unseen(versions, rules, ledger, text), rules).write.mode("append").parquet(folder)
    return spark.read.schema(LEDGER).parquet(folder)


def as_text(spans: Column, kinds: list[str]) -> Column:
    """`kind:start:end` of the spans of some kinds, comma-joined."""
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def number_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
