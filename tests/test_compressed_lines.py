"""Fused triples as compressed JSON lines are read as what was written."""

from trellis.sources import files


def test_compressed(spark, tmp_path):
    row = ("h", "R", "t", 2, 1.0, 0.5, 0.9, False, ["a", "b"])
    fused = spark.createDataFrame([(*row, 1)], "head string, relation string, tail string, frequency int, source_score double, confidence double, edge_score double, conflict boolean, sources array<string>, seq int")
    files.write_fused(fused, str(tmp_path / "plain"), "2024-01-01")
    files.write_fused(fused, str(tmp_path / "small"), "2024-01-01", compression="gzip")
    assert [f.name for f in (tmp_path / "small").glob("part-*.json.gz")] and list((tmp_path / "plain").glob("part-*.json"))
    assert files.read_fused(spark, str(tmp_path / "small")).drop("seq").collect() == files.read_fused(spark, str(tmp_path / "plain")).drop("seq").collect()
