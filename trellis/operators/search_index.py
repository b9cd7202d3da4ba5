"""A stored index of grams for searching names and aliases: postings in blocks, read from the shortest names on, no further than the answer needs.

An entry is one thing that a node is called, in lower case. Its grams (runs of one, two and three characters) and the name as a whole have
postings; those of one gram are cut into blocks of BLOCK entries in the order in which answers are ranked, with the length of the first name
of each block. A search takes the rarest gram of what is asked for, of the longest kind that fits. It reads a few blocks, then four times as
many, until the next block's names are longer than the last answer's, or none is left: the answers are those of a scan of all nodes.

An index is made of segments, one for each `add`, so new nodes cost what they need themselves. `follow` adds the nodes that a graph store
has got since the last time. A batch of questions is one plan for each round, for all questions that are not answered yet.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import stored
from ..sources.store import Files, GraphStore

SIZES, BLOCK, FIRST, FASTER = (1, 2, 3), 128, 2, 4
#: Entries of one gram that one task orders, about; a gram with more is cut by ranges of lengths before.
ENTRIES_A_TASK = 100_000
_ENTRY = "struct<name_len:int,name:string,label:string,said:string,own:boolean>"
_SCHEMA = f"gram string, part int, block int, low int, n int, entries array<{_ENTRY}>"


def grams_of(said: Column, sizes: tuple[int, ...] = SIZES) -> Column:
    """The distinct grams of a string, and the whole of it under a mark of its own."""
    runs = [F.when(F.length(said) >= q, F.transform(F.sequence(F.lit(1), F.length(said) - (q - 1)), _cut(said, q))).otherwise(F.array().cast("array<string>")) for q in sizes]
    return F.array_distinct(F.concat(*runs, F.array(F.concat(F.lit("\u0000"), said))))


def _cut(said: Column, q: int):
    return lambda i: F.substring(said, i, F.lit(q))


def entries_of(nodes: DataFrame) -> DataFrame:
    """(name_len, name, label, said, own) for each thing that a node is called, once; `own` if that is its name."""
    rows = nodes.filter("name is not null").select("name", "label", F.explode(F.concat(F.array(F.struct(F.lower("name").alias("said"), F.lit(True).alias("own"))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(F.lower(a).alias("said"), F.lit(False).alias("own"))))).alias("x"))
    return rows.filter("x.said is not null").groupBy(F.length("name").alias("name_len"), "name", "label", "x.said").agg(F.max("x.own").alias("own"))


@dataclass
class SearchIndex:
    """An index in the folder `path`, which all executors must see; `read_entries` counts what searches have read."""

    spark: SparkSession
    path: str
    sizes: tuple[int, ...] = SIZES
    block: int = BLOCK
    read_entries: int = 0
    files: Files = field(init=False)

    def __post_init__(self):
        self.files = Files(self.spark, self.path)

    # --- building

    def log(self) -> list[dict]:
        names = sorted((n for n in self.files.names("log") if n.endswith(".json")), key=lambda n: int(n[:-5]))
        return [json.loads(self.files.read(f"log/{n}")) for n in names]

    def add(self, nodes: DataFrame, store_version: int | None = None) -> int:
        """A segment for nodes that the index has not yet; the number of segments then. It is there as a whole or not at all."""
        done, name = self.log(), uuid.uuid4().hex
        entry = F.struct("name_len", "name", "label", "said", "own")
        rows = entries_of(nodes).select(F.explode(grams_of(F.col("said"), self.sizes)).alias("gram"), entry.alias("e"))
        # a common gram's entries are ordered in several tasks, each of a range of lengths: blocks of a later part have longer names
        sizes = rows.groupBy("gram", "e.name_len").agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("gram").orderBy("name_len").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        parts = sizes.select("gram", "name_len", F.floor(before / ENTRIES_A_TASK).cast("int").alias("part"))
        rows = rows.withColumn("name_len", F.col("e.name_len")).join(parts, ["gram", "name_len"]).drop("name_len")
        at = F.row_number().over(Window.partitionBy("gram", "part").orderBy("e")) - 1
        blocks = rows.withColumn("block", F.floor(at / self.block).cast("int")).groupBy("gram", "part", "block").agg(F.sort_array(F.collect_list("e")).alias("entries"))
        blocks = blocks.select("gram", "part", "block", F.col("entries")[0]["name_len"].alias("low"), F.size("entries").alias("n"), "entries")
        blocks.sortWithinPartitions("gram", "part", "block").write.parquet(f"{self.path}/segments/{name}")
        if not self.files.put_new(f"log/{len(done)}.json", json.dumps({"segment": name, "store_version": store_version})):
            raise ValueError(f"another writer has changed the index: {self.path}")
        return len(done) + 1

    def follow(self, store: GraphStore) -> int:
        """Add the nodes that a store has got since the version that this index knows; the version that it knows then."""
        known = max([e["store_version"] for e in self.log() if e["store_version"] is not None], default=None)
        last = store.versions()[-1]
        if known != last:
            nodes = store.read(last).nodes
            if known is not None:
                key = F.col("label").eqNullSafe(F.col("old_label")) & (F.col("name") == F.col("old_name"))
                nodes = store.nodes_rewritten(known, last).join(store.read(known).nodes.select(F.col("label").alias("old_label"), F.col("name").alias("old_name")), key, "left_anti")
            self.add(nodes, last)
        return last

    def blocks(self) -> DataFrame:
        paths = [f"{self.path}/segments/{e['segment']}" for e in self.log()]
        if not paths:
            return self.spark.range(0).select(*(F.lit(None).cast(kind).alias(name) for name, kind in (c.split(" ", 1) for c in _SCHEMA.split(", "))), F.lit("").alias("file"))
        frames = [self.spark.read.schema(_SCHEMA).parquet(p).withColumn("file", F.lit(i)) for i, p in enumerate(paths)]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    # --- searching

    def search(self, asked: str, limit: int = 10, label: str | None = None) -> DataFrame:
        """(name, label, match_type, name_len) of nodes called something with `asked` in it, as `Graph.search` ranks them."""
        rows = self.search_batch(self.spark.range(1).select(F.lit(asked).alias("asked")), limit, label)
        return rows.drop("asked").orderBy("match_type", "name_len", "name", "label")

    def search_batch(self, questions: DataFrame, limit: int = 10, label: str | None = None) -> DataFrame:
        """(asked, name, label, match_type, name_len) for distinct `asked` of questions: the first `limit` of each. Nulls and empty strings have no answers."""
        asked = stored(questions.select("asked").filter("asked <> ''").distinct().withColumn("q", F.lower("asked")), "asked")
        blocks, size = self.blocks(), F.least(F.length("q"), F.lit(max(self.sizes)))
        heads = blocks.select("gram", "file", "part", "block", "low", "n")
        # the rarest gram, and where its blocks stand in the order of lengths
        own = asked.select("asked", "q", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("q") - size + 1), lambda i: F.substring("q", i, size)))).alias("gram"))
        counts = heads.join(own.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.sum("n").alias("n"))
        best = own.join(counts, "gram", "left").groupBy("asked", "q").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best")).filter("best.n > 0").select("asked", "q", "best.gram")
        order = Window.partitionBy("gram").orderBy("low", "file", "part", "block")
        places = heads.join(best.select("gram").distinct(), "gram", "left_semi").select("gram", "file", "part", "block", "low", F.row_number().over(order).alias("place"), F.lead("low").over(order).alias("next"))
        places, left = stored(places, "places"), stored(best, "questions")
        # a name that is just what was asked for comes first, however long it is
        wanted = (lambda e: e["label"] == label) if label else (lambda e: F.lit(True))
        exact = asked.select("asked", "q", F.concat(F.lit("\u0000"), "q").alias("gram"))
        hits = self._hits(blocks.join(exact, "gram"), wanted).filter("own")
        hits = stored(self._first(hits.select("asked", F.lit(0).alias("match_type"), "name_len", "name", "label"), limit), "hits")
        low, high = 1, FIRST
        while True:
            due = left.join(places.filter(F.col("place").between(low, high)), "gram")
            read = stored(due.join(blocks.select("gram", "file", "part", "block", "n", "entries"), ["gram", "file", "part", "block"]).select("asked", "q", "place", "next", "n", "entries"), "read")
            self.read_entries += read.agg(F.sum("n")).first()[0] or 0
            found = self._hits(read, wanted).select("asked", F.when(F.col("own") & (F.col("said") == F.col("q")), 0).otherwise(1).alias("match_type"), "name_len", "name", "label")
            hits = stored(self._first(hits.unionByName(found), limit), "hits")
            # a question stays while it lacks answers, or the next block may have a name as short as its last answer's
            ends = read.groupBy("asked").agg(F.max_by("next", "place").alias("next"))
            had = hits.groupBy("asked").agg(F.count("*").alias("had"), F.max(F.when(F.col("match_type") == 1, F.col("name_len"))).alias("longest"))
            open_ = ends.filter("next is not null").join(had, "asked", "left").filter((F.coalesce("had", F.lit(0)) < limit) | (F.coalesce("longest", F.lit(-1)) >= F.col("next")))
            left = stored(left.join(open_.select("asked"), "asked", "left_semi"), "questions")
            if left.isEmpty():
                return hits.select("asked", "name", "label", "match_type", "name_len")
            low, high = high + 1, high * FASTER

    @staticmethod
    def _hits(rows: DataFrame, wanted) -> DataFrame:
        found = F.filter("entries", lambda e: F.contains(e["said"], F.col("q")) & wanted(e))
        return rows.select("asked", "q", F.explode(found).alias("e")).select("asked", "q", "e.*")

    @staticmethod
    def _first(hits: DataFrame, limit: int) -> DataFrame:
        """The first answers of each question; a node that several of its names lead to counts once."""
        hits = hits.groupBy("asked", "name_len", "name", "label").agg(F.min("match_type").alias("match_type"))
        place = F.row_number().over(Window.partitionBy("asked").orderBy("match_type", "name_len", "name", "label"))
        return hits.withColumn("at", place).filter(F.col("at") <= limit).select("asked", "match_type", "name_len", "name", "label")
