"""The positional index: made once for any number of searches, and matches that name sets of items instead of items."""

from pyspark.sql import functions as F
from test_contracts import SF

from trellis.llm import decontaminate

PASSAGE = "a passage that every item and every document of this table has in common with all others"
WINDOWS = len(PASSAGE.split()) - decontaminate.WINDOW + 1


def ids(rows):
    return sorted((r["doc_id"], r["n_hit"], tuple(r["items"])) for r in rows.select("doc_id", "n_hit", "items").collect())


def test_one_index_for_many_blocks(spark, monkeypatch):
    """The texts are read and indexed once, however many blocks the items come in, and blocks change no result."""
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    made = []
    store = decontaminate.stored
    monkeypatch.setattr(decontaminate, "stored", lambda df, label: made.append(label) or store(df, label))
    index = decontaminate.index_texts(docs)
    assert all("documents.parquet" not in f for f in index.inputFiles())
    results = []
    for block_words in (decontaminate.BLOCK_WORDS, 2_000):
        rows, sets = decontaminate.search_sets(index, bench, block_words=block_words)
        results.append(ids(decontaminate.with_items(rows.withColumn("n_hit", decontaminate.hit_words(F.col("matches"))), sets)))
    assert made.count("postings") == 1 and made.count("matches") > 5
    plain = decontaminate.search_index(index, bench).select("doc_id", decontaminate.hit_words(F.col("matches")).alias("n_hit"), decontaminate.item_ids(F.col("matches")).alias("items"))
    assert results[0] == results[1] == ids(plain) and any(n for _, n, _ in results[0])


def test_the_index_holds_all_words(spark):
    """A later benchmark with words that no earlier one had is searched in the same index."""
    index = decontaminate.index_texts(spark.createDataFrame([(1, "north of the river"), (2, "south of the wood")], "doc_id long, text string"), segment_words=4)
    for text, hit in (("of the wood", 2), ("north of", 1), ("of the sea", None)):
        rows = decontaminate.search_index(index, spark.createDataFrame([(5, text)], "item_id long, text string"))
        assert [r["doc_id"] for r in rows.filter(F.size("matches") > 0).collect()] == ([] if hit is None else [hit])


def test_a_shared_passage_is_no_product(spark):
    """40 documents with a passage that 60 items have: a match for each place, not for each place and item."""
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("x "), F.lit(PASSAGE), F.lit(" y")).alias("text"))
    bench = spark.createDataFrame([(i, f"{PASSAGE} {'z ' * (i % 3)}") for i in range(59)] + [(None, PASSAGE)], "item_id long, text string")
    rows, sets = decontaminate.search_sets(decontaminate.index_texts(docs), bench)
    assert {len(r["matches"]) for r in rows.collect()} == {WINDOWS}
    assert sets.select("items").distinct().count() <= 3 and sets.count() <= 3 * 60
    got = decontaminate.with_items(rows, sets).collect()
    assert len(got) == 40 and all(r["items"] == sorted(map(str, range(59))) + [None] for r in got)


def test_no_items_and_no_texts(spark):
    docs = spark.createDataFrame([(1, "one two"), (None, None), (None, "one two"), (1, "one two")], "doc_id long, text string")
    bench = spark.createDataFrame([(3, "one two"), (4, None)], "item_id long, text string")
    rows, sets = decontaminate.search_sets(decontaminate.index_texts(docs), bench.limit(0))
    assert sets.count() == 0 and [r["items"] for r in decontaminate.with_items(rows, sets).collect()] == [[]] * 4
    found = decontaminate.with_items(*decontaminate.search_sets(decontaminate.index_texts(docs), bench)).collect()
    assert sorted((r["doc_id"] or 0, tuple(r["items"])) for r in found) == [(0, ()), (0, ("3",)), (1, ("3",)), (1, ("3",))]
    rows, sets = decontaminate.search_sets(decontaminate.index_texts(docs.limit(0)), bench)
    assert decontaminate.with_items(rows, sets).count() == 0
