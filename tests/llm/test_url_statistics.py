"""Suffix statistics of the URL filter cover all rows, whatever the bound of the fitting sample; a rare class still gives trees."""

from trellis.llm import url_filter


def test_statistics_cover_all_rows(spark):
    rows = [(f"http://www.host{i % 200}.org/page{i}", i % 200 == 7) for i in range(2_000)]
    labelled = spark.createDataFrame(rows, "url string, blocked boolean")
    model = url_filter.fit_url_filter(labelled, bound=20)
    assert model.trees is not None and model.rate == 0.005
    own = {r["suffix"]: (r["hits"], r["seen"]) for r in model.suffixes.filter("size = 3").collect()}
    assert own == {f"www.host{k}.org": (10.0 if k == 7 else 0.0, 10.0) for k in range(200)}
    assert model.suffixes.filter("size = 1").select("hits", "seen").collect() == [(10.0, 2_000.0)]
    assert url_filter.judge_urls(labelled, [("allow", "elsewhere.net/")], model).count() == 2_000
