"""A graph in a folder, version by version: bucketed Parquet files, a manifest for each version, upserts that rewrite only what they touch.

A version is one manifest, `log/<number>.json`, which says for each table and bucket in which write's folder its rows are. A change writes
the new rows of the buckets it touches to a folder of its own, then renames a finished manifest to the next number, which fails if that
number is taken. So a reader always sees a whole version, a write that dies leaves the last one, and a graph that was read can be changed
and written back to where it came from: nothing that a version names is ever changed. Past versions can be read until `vacuum`.

Nodes lie in buckets by label and name, edges by all of their key, so that no hub makes a large bucket. The number of buckets is fixed when
a store is made; a bucket is written by `tasks_a_bucket` tasks, its rows in order of type and source, which gives readers' filters tight
bounds in each file. A manifest has one line for each bucket, whatever the number of rows.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.graph import Graph, is_property, label_inference, property_rows
from ..runtime import removed, stored

NODE_KEY, EDGE_KEY = ["label", "name"], ["src_label", "src", "rel_type", "dst_label", "dst"]
TABLES = {"nodes": (schemas.NODES, NODE_KEY), "edges": (schemas.EDGES, EDGE_KEY)}


class ConcurrentWrite(Exception):
    """Another writer made the version that this one was about to make; read again and repeat."""


def _now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S.%f")


@dataclass
class Files:
    """The few operations on a folder that a log needs, on any file system that Spark reads."""

    spark: SparkSession
    root: str

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root.rstrip('/')}/{name}")

    def _system(self):
        path = self._path("")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self, name: str) -> list[str]:
        fs, path = self._system(), self._path(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def read(self, name: str) -> str:
        stream = self._system().open(self._path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> bool:
        """A new file with all of its text, or none at all; False if it is there already."""
        jvm = self.spark._jvm
        fs, draft, path = self._system(), self._path(f"{name}.{uuid.uuid4().hex}.draft"), self._path(name)
        stream = fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if fs.exists(path):
                return False
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration())
            context.rename(draft, path, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            fs.delete(draft, False)

    def delete(self, name: str) -> None:
        self._system().delete(self._path(name), True)


@dataclass
class GraphStore:
    """The versions of a graph in the folder `path`, which all executors must see. `create` makes one."""

    spark: SparkSession
    path: str
    tasks_a_bucket: int = 1
    files: Files = field(init=False)

    def __post_init__(self):
        self.files = Files(self.spark, self.path)

    @classmethod
    def create(cls, spark: SparkSession, path: str, buckets: int = 64, now: str | None = None, tasks_a_bucket: int = 1) -> GraphStore:
        """An empty store. Take as many buckets as leave about a gigabyte in each."""
        store = cls(spark, path, tasks_a_bucket)
        first = {"version": 0, "operation": "create", "at": now or _now(), "buckets": buckets, "rewritten": {}, "tables": {t: {} for t in TABLES}}
        if not store.files.put_new("log/0.json", json.dumps(first)):
            raise ValueError(f"there is a store already: {path}")
        return store

    # --- reading

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names("log") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, of the last one by default."""
        known = self.versions()
        if not known or version is not None and version not in known:
            raise ValueError(f"no such version: {version}")
        return json.loads(self.files.read(f"log/{known[-1] if version is None else version}.json"))

    def read(self, version: int | None = None) -> Graph:
        found = self.manifest(version)
        return Graph(*(self._rows(found, t) for t in TABLES))

    def read_at(self, time: str) -> Graph:
        """The last version made at or before a time."""
        of = [m["version"] for m in map(self.manifest, self.versions()) if m["at"] <= time]
        if not of:
            raise ValueError(f"no version at {time}")
        return self.read(max(of))

    def history(self) -> list[dict]:
        """version, operation, time and numbers of rewritten buckets, newest first."""
        found = [self.manifest(v) for v in reversed(self.versions())]
        return [{"version": m["version"], "operation": m["operation"], "at": m["at"]} | {t: len(m["rewritten"].get(t, [])) for t in TABLES} for m in found]

    def nodes_rewritten(self, since: int, version: int) -> DataFrame:
        """The nodes of a version that lie in buckets written after version `since`."""
        old, new = self.manifest(since)["tables"]["nodes"], self.manifest(version)
        return self._rows(new, "nodes", {int(b) for b, w in new["tables"]["nodes"].items() if old.get(b) != w})

    def node_bucket(self, label: str | None, name: str) -> int:
        """Where a node is: a lookup by key reads one bucket."""
        return self.spark.range(1).select(self._bucket(self.manifest()["buckets"], [F.lit(label), F.lit(name)])).first()[0]

    def _rows(self, manifest: dict, table: str, buckets: set[int] | None = None) -> DataFrame:
        schema = TABLES[table][0]
        paths = [f"{self.path}/data/{table}/{write}/bucket={b}" for b, write in manifest["tables"][table].items() if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
        return self.spark.read.schema(schema).parquet(*paths)

    @staticmethod
    def _bucket(n: int, key: list) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")

    # --- writing

    def overwrite(self, graph: Graph, now: str | None = None) -> int:
        """A version with just this graph."""
        base = self.manifest()
        every = set(range(base["buckets"]))
        return self._commit(base, "overwrite", now, {t: (getattr(graph, t), every) for t in TABLES})

    def clear(self, now: str | None = None) -> int:
        base = self.manifest()
        return self._commit(base, "clear", now, {t: (None, set(range(base["buckets"]))) for t in TABLES})

    def merge(self, triples: DataFrame, aliases: DataFrame | None = None, now: str | None = None, base: dict | None = None) -> int:
        """Upsert fused triples (see `Graph.upsert_triples`) into the last version; only the buckets of their nodes and edges are read and rewritten."""
        base = base or self.manifest()
        batch = stored(triples, "merge")
        rels = label_inference(batch.filter(~is_property(F.col("relation")) & (F.col("head") != "") & (F.col("tail") != "")))
        ends = property_rows(batch).select("label", "name").union(rels.select("src_label", "head")).union(rels.select("dst_label", "tail"))
        keys = rels.select("src_label", F.col("head").alias("src"), "rel_type", "dst_label", F.col("tail").alias("dst"))
        touched = {"nodes": self._touched(base, ends.toDF(*NODE_KEY), NODE_KEY), "edges": self._touched(base, keys, EDGE_KEY)}
        part = Graph(*(self._rows(base, t, touched[t]) for t in TABLES)).upsert_triples(batch, aliases, now)
        version = self._commit(base, "merge", now, {t: (getattr(part, t), touched[t]) for t in TABLES})
        removed(batch)
        return version

    def delete_edges(self, keys: DataFrame, now: str | None = None) -> int:
        """A version without the edges of these keys."""
        base = self.manifest()
        touched = self._touched(base, keys, EDGE_KEY)
        same = [F.col(k).eqNullSafe(F.col(f"gone_{k}")) for k in EDGE_KEY]
        gone = keys.select(*(F.col(k).alias(f"gone_{k}") for k in EDGE_KEY))
        return self._commit(base, "delete", now, {"edges": (self._rows(base, "edges", touched).join(gone, same, "left_anti"), touched)})

    def _touched(self, base: dict, keys: DataFrame, names: list[str]) -> set[int]:
        """Buckets of keys: at most as many numbers as there are buckets."""
        return {r[0] for r in keys.select(self._bucket(base["buckets"], [F.col(n) for n in names]).alias("b")).distinct().collect()}

    def _commit(self, base: dict, operation: str, now: str, changes: dict[str, tuple[DataFrame | None, set[int]]]) -> int:
        now = now or _now()
        version, write = base["version"] + 1, f"{base['version'] + 1}-{uuid.uuid4().hex}"
        tables = {t: dict(base["tables"][t]) for t in TABLES}
        for table, (rows, buckets) in changes.items():
            schema, key = TABLES[table]
            tables[table] = {b: w for b, w in tables[table].items() if int(b) not in buckets}
            if rows is None or not buckets:
                continue
            rows = rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
            rows = rows.withColumn("bucket", self._bucket(base["buckets"], [F.col(k) for k in key]))
            order = ["rel_type", "src"] if table == "edges" else ["label", "name"]
            spread = F.pmod(F.hash(*key), F.lit(self.tasks_a_bucket))
            rows = rows.repartition(min(len(buckets) * self.tasks_a_bucket, 10_000), "bucket", spread).sortWithinPartitions("bucket", *order)
            rows.write.partitionBy("bucket").parquet(f"{self.path}/data/{table}/{write}")
            tables[table] |= {n[7:]: write for n in self.files.names(f"data/{table}/{write}") if n.startswith("bucket=")}
        made = {"version": version, "operation": operation, "at": now, "buckets": base["buckets"], "rewritten": {t: sorted(b) for t, (_, b) in changes.items()}, "tables": tables}
        if not self.files.put_new(f"log/{version}.json", json.dumps(made)):
            for table in changes:
                self.files.delete(f"data/{table}/{write}")
            raise ConcurrentWrite(f"version {version} of {self.path}")
        return version

    def vacuum(self, keep: int = 1) -> list[str]:
        """Forget all but the last `keep` versions and delete the folders that none of those names, also those of writes that died. No write may run meanwhile."""
        known = self.versions()
        kept = [self.manifest(v) for v in known[-keep:]]
        for v in known[:-keep]:
            self.files.delete(f"log/{v}.json")
        gone = []
        for table in TABLES:
            named = {w for m in kept for w in m["tables"][table].values()}
            for write in self.files.names(f"data/{table}"):
                if write not in named:
                    self.files.delete(f"data/{table}/{write}")
                    gone.append(write)
        return gone
