"""Streams with keyed state, restarted from their checkpoint between files, against the batch queries."""

import pytest
from pyspark.sql import functions as F

from trellis.operators import versioning
from trellis.streaming import state

SCHEMA = "head string, relation string, tail string, ts timestamp, event_id long"


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """Events in three files, neighbours in time shuffled across file borders, and a last file that only moves the time on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts").limit(240)
    rows = events.select(F.concat(F.lit("user"), F.col("user_id") % 7).alias("head"), F.upper("event_type").alias("relation"), (F.col("event_id") % 3).cast("string").alias("tail"), F.col("ts").cast("timestamp").alias("ts"), "event_id").collect()
    rows = sorted(rows, key=lambda r: r["ts"].timestamp() + (r["event_id"] * 7919 % 100) * 36)
    folder = tmp_path_factory.mktemp("events")
    parts = [rows[i * 80 : i * 80 + 80] for i in range(3)] + [[("end", "END", "end", max(r["ts"] for r in rows).replace(year=2030), -1)]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(folder / f"all/{i}"))
    yield spark.createDataFrame(rows, SCHEMA), folder / "all", len(parts)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def streamed(spark, files, tmp_path, plan, restarts=True):
    """Run the plan over the files, each put there after the query before has ended."""
    _, folder, n = files
    arrived = tmp_path / "in"
    arrived.mkdir()
    for i in range(n):
        for f in (folder / str(i)).glob("part-*"):
            (arrived / f"{i}-{f.name}").write_bytes(f.read_bytes())
        if restarts or i == n - 1:
            source = spark.readStream.schema(SCHEMA).parquet(str(arrived))
            query = plan(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            query.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


@pytest.mark.parametrize("restarts", [True, False])
def test_revisions_as_in_a_batch(spark, files, tmp_path, restarts):
    got = streamed(spark, files, tmp_path, lambda s: state.revisions(s, "ts", ["event_id"], late="2 hours"), restarts)
    none = spark.createDataFrame([], "src string, rel_type string, dst string, revision int")
    want = versioning.next_revisions(files[0].withColumn("seq", F.struct("ts", "event_id")), none)
    columns = ["head", "relation", "tail", "event_id", "ts", "revision"]
    assert sorted(map(tuple, got.filter("head <> 'end'").select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_first_wins(spark, files, tmp_path):
    got = streamed(spark, files, tmp_path, lambda s: state.first_of_each(s, ["head", "relation"], "ts", ["event_id"], late="2 hours"))
    want = files[0].groupBy("head", "relation").agg(F.min(F.struct("ts", "event_id"))["event_id"].alias("event_id"))
    assert sorted(map(tuple, got.filter("head <> 'end'").select("head", "relation", "event_id").collect())) == sorted(map(tuple, want.collect()))


def test_quiet_keys_are_forgotten(spark, files, tmp_path):
    got = streamed(spark, files, tmp_path, lambda s: state.revisions(s, "ts", ["event_id"], late="2 hours", forget="20 hours"))
    last, want = {}, []
    for r in sorted(files[0].collect(), key=lambda r: (r["ts"], r["event_id"])):
        key = r["head"], r["relation"], r["tail"]
        before, n = last.get(key, (None, 0))
        n = 1 if before is None or (r["ts"] - before).total_seconds() > 20 * 3600 else n + 1
        last[key] = r["ts"], n
        want.append((r["event_id"], n))
    assert sorted(map(tuple, got.filter("head <> 'end'").select("event_id", "revision").collect())) == sorted(want)
    assert len({n for _, n in want}) > 1 and sum(n == 1 for _, n in want) > len(last)


def test_needs_a_time_zone(spark, files):
    source = spark.readStream.schema(SCHEMA.replace("timestamp", "timestamp_ntz")).parquet(str(files[1] / "0"))
    with pytest.raises(ValueError, match="time zone"):
        state.revisions(source, "ts", ["event_id"])
