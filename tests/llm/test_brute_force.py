"""Learned and searched results against plain versions written without the operators."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_contracts import crc, docs, lower, result, sha  # noqa: F401

from trellis.llm import pieces, queries, url_filter


def tokens(text):
    return [w for w in lower(text).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w] + [" "]


def test_scores_of_deleted_interpolation(spark, docs):  # noqa: F811
    """Maximum-likelihood estimates, buckets by powers of two of the context's count, weights by expectation-maximisation on the deleted fold."""
    texts = {d["doc_id"]: tokens(d["text"] or "") for d in docs}
    role = {i: {2: "scored", 5: "deleted"}.get(crc(i, 7), "core") for i in texts}
    pairs = {i: list(zip([" ", *t], t, strict=False)) for i, t in texts.items()}

    def counted(roles):
        uni, bi = Counter(), Counter()
        for i, p in pairs.items():
            if role[i] in roles:
                uni.update(texts[i])
                bi.update(p)
        return uni, bi, sum(uni.values())

    def bucket(n):
        return n.bit_length()

    # the fold's estimates, on the grid of eighths of the natural logarithm
    grid = lambda p: math.exp(round(8 * math.log(p)) / 8) if p else 0.0
    uni, bi, n = counted({"core"})
    cells = defaultdict(Counter)
    for i, own in pairs.items():
        if role[i] == "deleted":
            for v, w in own:
                cells[bucket(uni[v])][grid(bi[v, w] / max(uni[v], 1)), grid(uni[w] / n), 1 / (len(uni) + 1)] += 1
    weights = {b: (0.4, 0.5, 0.1) if b else (0.0, 0.9, 0.1) for b in range(64)}
    for b, seen in cells.items():
        w = weights[b]
        for _ in range(60):
            share = [0.0] * 3
            for p, k in seen.items():
                parts = [a * x for a, x in zip(w, p, strict=True)]
                for j in range(3):
                    share[j] += k * parts[j] / sum(parts)
            w = [x / sum(seen.values()) for x in share]
        w = [max(x, 1e-6) for x in w]
        weights[b] = [x / sum(w) for x in w]
    weights[0] = (0.0, weights[0][1] + weights[0][0], weights[0][2])
    uni, bi, n = counted({"core", "deleted"})
    got = result(spark, "op1_lm_scoring")
    for i, own in pairs.items():
        score = 0.0
        for v, w in own:
            a = weights[bucket(uni[v])]
            score += math.log10(a[0] * bi[v, w] / max(uni[v], 1) + a[1] * uni[w] / n + a[2] / (len(uni) + 1))
        assert got[i]["score"] == pytest.approx(score, rel=1e-6), i


def test_pieces_are_a_best_path(spark, docs):  # noqa: F811
    """One uncut Viterbi pass over whole texts with the real vocabulary."""
    encoder = pieces.Pieces(queries.vocabulary())
    ordinary = [(i, p, s) for i, (p, s, kind) in enumerate(encoder.vocabulary) if kind == -1 and p]
    value = {p: -math.log(r + 2) for r, (_, p, _) in enumerate(sorted((-s, p, i) for i, p, s in ordinary))}
    by_id = {i: value[p] for i, p, _ in ordinary}
    longest = max(map(len, value))
    got = result(spark, "op6_pieces")
    for d in docs[:120]:
        text = (d["text"] or "").replace(" ", pieces.SPACE)
        if pieces.SPACE in (d["text"] or ""):
            continue
        best = [0.0] + [-math.inf] * len(text)
        for end in range(1, len(text) + 1):
            best[end] = best[end - 1] + encoder.fallback * len(text[end - 1].encode())
            for size in range(1, min(longest, end) + 1):
                if text[end - size : end] in value:
                    best[end] = max(best[end], best[end - size] + value[text[end - size : end]])
        ids = encoder.encode(d["text"] or "")
        assert math.isclose(sum(by_id.get(i, encoder.fallback) for i in ids), best[-1], rel_tol=1e-9, abs_tol=1e-9)
        assert (got[d["doc_id"]]["n_pieces"], got[d["doc_id"]]["ids_sha256"]) == (len(ids), sha(",".join(map(str, ids))))


def test_trees_tell_unseen_hosts(spark):
    """Fitted without every second host of both kinds, the trees judge the URLs of the others."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    host = url_filter.host_of(F.col("url"))
    pages = pages.select("*", host.alias("h"), F.arrays_overlap(F.split(host, "[.-]"), F.array(*map(F.lit, queries.UNWANTED))).alias("blocked"))
    hosts = {kind: sorted(r[0] for r in pages.filter(F.col("blocked") == kind).select("h").distinct().collect()) for kind in (True, False)}
    unseen = hosts[True][::2] + hosts[False][::2]
    model = url_filter.fit_url_filter(pages.filter(~F.col("h").isin(unseen)).select("url", "blocked"))
    judged = url_filter.judge_urls(pages.filter(F.col("h").isin(unseen)), [], model).groupBy("blocked").agg(F.count("*"), F.count_if(F.col("verdict") == "block")).collect()
    share = {r[0]: r[2] / r[1] for r in judged}
    assert len(hosts[True]) >= 4 and share[True] > 0.9 and share[False] < 0.05
