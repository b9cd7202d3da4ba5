"""Span functions over spans that another Python function of the same stage computes."""

import pytest
from pyspark.sql import functions as F

from trellis.operators import extract

TEXT = "on the other theory"


@pytest.fixture()
def texts(spark):
    return spark.createDataFrame([(1, TEXT), (2, None), (3, "")], "k int, text string")


def spans(df):
    return {r["k"]: r["s"] and [(s["text"], s["start"], s["end"], s["label"]) for s in r["s"]] for r in df.collect()}


def test_folds_over_computed_and_stored_spans(spark, texts, tmp_path):
    found = extract.dictionary_spans(F.col("text"), {"A": ["th", "the", "er"], "B": ["other"]})
    texts.select("k", found.alias("s")).write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    for fold in (extract.merge_adjacent, lambda c: extract.remove_overlaps(c, ["B", "A"]), lambda c: extract.merge_adjacent(extract.remove_overlaps(c, []))):
        assert spans(texts.select("k", fold(found).alias("s"))) == spans(stored.select("k", fold(F.col("s")).alias("s")))
    merged = spans(texts.select("k", extract.merge_adjacent(found).alias("s")))
    assert merged[1] == [("the", 3, 6, "A"), ("other", 7, 12, "B"), ("the", 13, 16, "A")] and merged[2] == merged[3] == []


@pytest.mark.parametrize("label", [None, lambda c: F.upper(c)])
@pytest.mark.parametrize("fails", [False, True])
def test_model_spans_with_and_without_labels(spark, texts, label, fails):
    def model(batch):
        if fails:
            raise RuntimeError("no model")
        return [[{"word": "##on", "start": 0, "end": 2, "label": "a", "score": 0.9}, {"word": "the", "start": 3, "end": 6, "label": "a", "score": 0.7}, {"word": "x", "start": 9, "end": 10, "label": "a", "score": 0.1}] for _ in batch]

    extractor = extract.model_spans(model, label, fallback=lambda text: extract.dictionary_spans(text, {"D": ["theory"]}))
    got = spans(extract.with_spans(texts, extractor).select("k", F.col("spans").alias("s")))
    assert got == {1: [("theory", 13, 19, "D")] if fails else [("onthe", 0, 6, "A" if label else "a")], 2: [], 3: []}
