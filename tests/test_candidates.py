"""How much a similarity join and a dictionary search look at, and that nothing is lost."""

import random

import pytest
from pyspark.sql import functions as F

from trellis.functions import text
from trellis.operators import extract, linking

SF = "/root/testdata/sf0.01"


def names_like(rng, bases, letters, longest):
    out = set()
    for _ in range(bases):
        base = "".join(rng.choice(letters) for _ in range(rng.randint(1, longest))).strip()
        for _ in range(4):
            s = list(base)
            for _ in range(rng.randint(0, max(2, len(s) // 12))):
                s.insert(rng.randint(0, len(s)), rng.choice(letters))
            out.add(" ".join("".join(s).split()))
    return sorted(n for n in out if n)


@pytest.mark.parametrize(("threshold", "longest", "block"), [(45.0, 12, 1_000), (60.0, 30, 3), (85.0, 90, 2), (95.0, 200, 1_000)])
def test_no_pair_is_lost(spark, monkeypatch, threshold, longest, block):
    monkeypatch.setattr(linking, "NAMES_A_BLOCK", block)
    names = names_like(random.Random(threshold), 15, "abcdefgh ijé東", longest)
    got = [tuple(r) for r in linking.similar_edges(spark.createDataFrame([(n,) for n in names], "name string"), threshold).collect()]
    assert sorted(got) == sorted((a, b) for i, a in enumerate(names) for b in names[i + 1 :] if text.indel_ratio(a, b) >= threshold)


def test_few_pairs_are_verified(spark):
    """Names made of the same few words: one in twenty of all pairs is verified at most."""
    part = spark.read.parquet(f"{SF}/part.parquet").select(F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("name"))
    n = part.distinct().count()
    assert linking.candidates(part, 90.0).count() < 0.05 * n * (n - 1) / 2
    assert linking.candidates(part.limit(0), 90.0).count() == 0


WORDS = [("A", "the"), ("A", "theory"), ("B", "other"), ("B", "y a"), ("C", "é🙂"), ("C", "x" * 40), ("D", "the")]


def test_spans_in_windows(spark, monkeypatch):
    monkeypatch.setattr(extract, "WINDOW", 7)
    monkeypatch.setattr(extract, "FOUND", 3)
    rows = [(1, "the other theory and é🙂 y a the"), (2, None), (3, ""), (4, "x" * 100), (5, "zé🙂" * 9)]
    texts, words = spark.createDataFrame(rows, "doc_id int, text string"), spark.createDataFrame(WORDS, "label string, name string")
    got = {r["doc_id"]: [(s["text"], s["start"], s["label"]) for s in r["spans"]] for r in extract.joined_spans(texts, words, "doc_id").collect()}
    for key, said in rows:
        every = sorted((i, -len(name), label, name) for label, name in WORDS for i in range(len(said or "")) if said.startswith(name, i))
        kept, end = [], 0
        for i, n, label, name in every:
            if i >= end:
                kept.append((name, i, label))
                end = i - n
        assert got[key] == kept
    assert extract.joined_spans(texts, words.limit(0), "doc_id").filter(F.size("spans") > 0).count() == 0


def test_only_hits_are_shuffled(spark):
    """What leaves the texts for the join is little more than what the join finds."""
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    brands = spark.read.parquet(f"{SF}/documents.parquet").select(F.explode(F.split("text", r"\s+")).alias("name")).filter(F.length("name").between(2, 20)).groupBy("name").count().filter("count between 3 and 8").select(F.lit("W").alias("label"), "name")
    lengths = [r[0] for r in brands.select(F.length("name").alias("n")).distinct().orderBy("n").collect()]
    sent = extract.passing(texts, brands, "doc_id", lengths, brands.count())
    hits = sent.join(brands, "name").count()
    assert hits > 10_000 and sent.count() <= 1.5 * hits
