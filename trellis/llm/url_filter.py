"""URL verdicts: host and path rules first, gradient-boosted trees on lexical features for the rest.

The trees are Spark's own and everything else is expressions, so no Python runs on executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import stored

FEATURES = [
    "url_chars", "host_chars", "path_chars", "depth", "labels", "digit_share", "host_digit_share", "entropy", "host_entropy",
    "n_params", "hyphens", "longest_label", "suffix_rate_1", "suffix_rate_2", "suffix_rate_3", "suffix_seen_3",
]


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for a null."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest of `rules` (verdict, host/path) that fits, or null.

    A rule fits its host and all subdomains, for paths that start with its path. Of rules of one length the last by
    name wins. `rules` is a parameter, not data: it becomes part of the plan.
    """
    found = [
        F.when(
            ((host == name.partition("/")[0]) | host.endswith("." + name.partition("/")[0])) & path.startswith("/" + name.partition("/")[2]),
            F.struct(F.lit(len(name)).alias("size"), F.lit(name).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for verdict, name in rules
    ]
    found = F.array(*found) if found else F.array().cast("array<struct<size:int,rule:string,verdict:string>>")
    return F.array_max(F.filter(found, lambda r: r.isNotNull()))


def _suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def _entropy(text: Column) -> Column:
    """Bits per character over the 40 characters that hosts and paths mostly have; others count as one more."""
    known = "abcdefghijklmnopqrstuvwxyz0123456789-./_"
    n = F.greatest(F.length(text), F.lit(1))
    low = F.lower(text)
    counts = [F.length(low) - F.length(F.replace(low, F.lit(c), F.lit(""))) for c in known]
    counts.append(F.length(F.translate(low, known, "")))
    return F.aggregate(F.array(*counts), F.lit(0.0), lambda s, c: s - F.when(c > 0, c / n * F.log2(c / n)).otherwise(0.0))


def lexical(df: DataFrame, url: str = "url") -> DataFrame:
    """`df` with f_host, f_path and the lexical features of its URLs; a null URL counts as empty."""
    u = F.coalesce(F.col(url), F.lit(""))
    df = df.withColumns({"f_url": u, "f_host": host_of(u), "f_path": path_of(u)})
    digits = lambda c: F.length(c) - F.length(F.translate(c, "0123456789", ""))
    share = lambda c: digits(c) / F.greatest(F.length(c), F.lit(1))
    h, p, u = F.col("f_host"), F.col("f_path"), F.col("f_url")
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    return df.withColumns({
        "url_chars": F.length(u), "host_chars": F.length(h), "path_chars": F.length(p),
        "depth": F.size(F.filter(F.split(p, "/"), lambda x: x != "")), "labels": F.size(F.split(h, r"\.")),
        "digit_share": share(u), "host_digit_share": share(h), "entropy": _entropy(u), "host_entropy": _entropy(h),
        "n_params": F.when(query == "", 0).otherwise(F.size(F.split(query, "[&;]"))),
        "hyphens": F.length(h) - F.length(F.translate(h, "-", "")),
        "longest_label": F.array_max(F.transform(F.split(h, r"\."), lambda x: F.length(x))),
        "suffix_1": _suffix(h, 1), "suffix_2": _suffix(h, 2), "suffix_3": _suffix(h, 3),
    })


@dataclass
class UrlFilter:
    """A fitted filter: the trees (None where the labels had one class only), suffix statistics, and the share of blocked URLs."""

    trees: GBTClassificationModel | None
    suffixes: DataFrame
    rate: float

    def features(self, df: DataFrame) -> DataFrame:
        df = df.withColumn("known_3", _suffix(host_of(F.col("url")), 3))
        # each suffix of three labels once, so that the shorter ones are looked up for hosts rather than for rows
        hosts = df.select(F.col("known_3").alias("suffix_3")).distinct()
        hosts = hosts.withColumns({"suffix_1": _suffix(F.col("suffix_3"), 1), "suffix_2": _suffix(F.col("suffix_3"), 2)})
        for k in (1, 2, 3):
            own = self.suffixes.filter(F.col("size") == k).select(F.col("suffix").alias(f"suffix_{k}"), F.col("rate").alias(f"suffix_rate_{k}"), F.col("seen").alias(f"suffix_seen_{k}"))
            hosts = hosts.join(own, f"suffix_{k}", "left")
        hosts = hosts.drop("suffix_1", "suffix_2").withColumnRenamed("suffix_3", "known_3")
        df = lexical(df.join(hosts, "known_3", "left"))
        df = df.fillna({f"suffix_rate_{k}": self.rate for k in (1, 2, 3)}).fillna({f"suffix_seen_{k}": 0.0 for k in (1, 2, 3)})
        return df.withColumns({c: F.col(c).cast("double") for c in FEATURES})

    def probability(self, df: DataFrame) -> DataFrame:
        """`df` with column p_block, its other columns as they were. Rows keep their number, repeated ones too."""
        columns = [c for c in df.columns if c != "p_block"]
        kept = df.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("kept"), F.col("url").alias("url"))
        rows = self.features(kept)
        if self.trees is None:
            return rows.select("kept.*", F.lit(self.rate).alias("p_block"))
        rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
        rows = self.trees.transform(rows)
        return rows.select("kept.*", vector_to_array("probability")[1].alias("p_block"))


def fit_url_filter(labelled: DataFrame, bound: int = 10_000, trees: int = 12, depth: int = 4, seed: int = 7) -> UrlFilter:
    """Fit on `labelled` (url, blocked boolean).

    Suffix statistics are smoothed shares of blocked URLs among those that end in the same one, two or three host
    labels, counted over all rows. The trees are fitted on at most `bound` rows, those of each class with the smallest hashes:
    up to half of `bound` of the rarer class, the rest of the other, weighted so that the classes keep their shares. A row's own label is left out of its own
    statistics. Rows without label are ignored; with no rows, or one class only, the filter answers with the share of blocked URLs.
    """
    rows = labelled.filter("blocked is not null").select(F.coalesce("url", F.lit("")).alias("url"), F.col("blocked").cast("double").alias("label"))
    totals = {label: count for label, count in rows.groupBy("label").count().collect()}
    n, blocked = sum(totals.values()), totals.get(1.0, 0)
    rate = blocked / n if n else 0.0
    host = host_of(F.col("url"))
    pairs = rows.select(F.explode(F.array(*(F.struct(F.lit(k).alias("size"), _suffix(host, k).alias("suffix")) for k in (1, 2, 3)))).alias("s"), "label")
    suffixes = pairs.groupBy("s.size", "s.suffix").agg(F.sum("label").alias("hits"), F.count("*").cast("double").alias("seen"))
    table = stored(suffixes.withColumn("rate", (F.col("hits") + rate) / (F.col("seen") + 1)), "suffixes")
    if blocked in (0, n):
        return UrlFilter(None, table, rate)  # nothing to tell apart
    least = min(min(totals.values()), bound // 2)
    rare = min(totals, key=lambda label: (totals[label], label))
    wanted = {label: least if label == rare else min(totals[label], bound - least) for label in totals}
    drawn = []
    for label, most in wanted.items():
        # about as many as are wanted pass this filter, so that tasks send few more to the driver
        low = -(1 << 63) + min((1 << 64) - 1, (3 * most << 63) // totals[label])
        some = rows.filter((F.col("label") == label) & (F.xxhash64("url") <= low)).orderBy(F.xxhash64("url"), "url").limit(most)
        drawn.append(some.withColumn("h", F.xxhash64("url")))
    # bounded by `bound`: one small table that all fitting jobs read
    sample = drawn[0].union(drawn[1]).toPandas().sort_values(["h", "url", "label"])
    taken = sample["label"].value_counts()
    sample["weight"] = sample["label"].map({label: totals[label] / taken[label] for label in taken.index})
    spark = labelled.sparkSession
    sample = spark.createDataFrame(sample[["url", "label", "weight"]].astype({"url": "str"}), "url string, label double, weight double").coalesce(1).cache()
    rows = lexical(sample)
    for k in (1, 2, 3):
        own = table.filter(F.col("size") == k).select(F.col("suffix").alias(f"suffix_{k}"), F.col("hits").alias(f"hits_{k}"), F.col("seen").alias(f"all_{k}"))
        # at most as many rows as the sample has
        own = own.join(F.broadcast(rows.select(f"suffix_{k}").distinct()), f"suffix_{k}", "left_semi")
        rows = rows.join(F.broadcast(own), f"suffix_{k}", "left")
        rows = rows.withColumns({f"suffix_rate_{k}": (F.col(f"hits_{k}") - F.col("label") + rate) / F.col(f"all_{k}"), f"suffix_seen_{k}": F.col(f"all_{k}") - 1})
    rows = rows.select("label", "weight", *(F.col(c).cast("double").alias(c) for c in FEATURES))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("label", "weight", "features")
    model = GBTClassifier(labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed).fit(rows)
    sample.unpersist()
    return UrlFilter(model, table, rate)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], model: UrlFilter, cut: float = 0.5) -> DataFrame:
    """`pages` (any columns, with url) with host, path, rule, verdict and p_block: the rule's verdict where one fits, else the trees'.

    A null URL or one without `://` has empty host and path and no rule. Columns of these five names are replaced, others stay; repeated
    rows stay; without rules the trees judge all; an empty table gives no rows.
    """
    pages = pages.drop("host", "path", "rule", "verdict", "p_block")
    rows = model.probability(pages)
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    fit = fitting_rule(F.col("host"), F.col("path"), rules)
    by_trees = F.when(F.col("p_block") >= cut, "block").otherwise("allow")
    return rows.withColumns({"rule": fit["rule"], "verdict": F.coalesce(fit["verdict"], by_trees)})
