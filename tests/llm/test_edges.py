"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for each operator."""

import math
import random

import pytest
from pyspark.sql import functions as F

from trellis.llm import chat_format, decontaminate, fingerprints, html_extract, language_id, line_dedup, lm_scoring, pieces, queries, simhash, url_filter

ODD = "doc_id long, text string, lang string, segment int, ids string, score string, key int, block int, root int, n_lines string"
random.seed(5)
LONG = " ".join(random.choice(["alpha", "beta", "gamma", "delta", "the", "of"]) + str(random.randrange(3000)) for _ in range(60_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog", "en"), (2, None, "en"), (3, "", None), (None, "no id here at all", "en"), (None, None, None),
    (4, LONG, "en"), (5, "the quick brown fox jumps over the lazy dog", "fr"), (5, "the quick brown fox jumps over the lazy dog", "fr"), (6, " \n\t ", "fr"),
    (7, "▁ <s> ~1 \u0000 naïve 漢字 🎈\r\n", "fr"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, "x", "y", 2, 3, 4, "z") for r in ROWS], ODD)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], ODD)


def test_lm_scoring(spark, odd, none):
    never = F.lit(False)
    rows = lm_scoring.score_texts(odd, never, F.col("doc_id") == 4).collect()
    assert len(rows) == len(ROWS)
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by_id[2]["n_tokens"] == by_id[3]["n_tokens"] == by_id[6]["n_tokens"] == 1
    assert by_id[4]["n_tokens"] == 60_001
    assert all(r["score"] <= 0 for r in rows)
    assert lm_scoring.score_texts(none, never, never).count() == 0
    alone = lm_scoring.score_texts(odd, F.lit(True), never).collect()
    assert {r["train_tokens"] for r in alone} == {0} and all(r["held_out"] and r["score"] <= 0 for r in alone)


def test_lm_weights(spark):
    """Every text over a small vocabulary has a probability; the weights of a bucket sum to one and follow the deleted counts."""
    text = "a b a c a b . b c a"
    words = sorted(set(text.split()))
    tries = [(100 + i, f"{c} {w}") for i, (c, w) in enumerate((c, w) for c in [*words, "zz"] for w in [*words, "zz"])]
    first = [(300 + i, c) for i, c in enumerate([*words, "zz"])]
    docs = spark.createDataFrame([(i, text) for i in range(4)] + tries + first, "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in lm_scoring.score_texts(docs, F.col("doc_id") >= 100, F.col("doc_id") == 3).collect()}
    assert all(x < 0 for x in score.values())
    cells = [(3, 0, -8, 50), (3, lm_scoring.NONE, -16, 10)]
    w = lm_scoring.learn_weights(cells, 10)
    assert w.sum(axis=1) == pytest.approx([1.0] * lm_scoring.BUCKETS) and w[3, 0] > 0.5 and w[0, 0] == 0


def test_fingerprints(spark, odd, none):
    rows = fingerprints.fingerprint_pairs(odd)
    own = [r for r in rows.select("doc_id", "edited", fingerprints.as_text(F.col("sketch")).alias("f"), fingerprints.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near")).collect()]
    assert len(own) == len(ROWS) and all(0 <= r["near"] <= 1 for r in own)
    assert len({r["f"] for r in own if r["doc_id"] in (2, 3, 6)}) == 1
    assert fingerprints.fingerprint_pairs(none).count() == 0
    # very far apart ids, and a single row
    far = spark.createDataFrame([(i, f"text {i} of many words here") for i in (-(1 << 62), -7, 0, 5_000_000, 1 << 62)], "doc_id long, text string")
    follow = {r["doc_id"]: r["next_text"] for r in fingerprints.with_next(far).collect()}
    assert follow == {r["doc_id"]: r["next_text"] for r in fingerprints.with_next(far, broadcast_blocks=0).collect()}
    assert follow[-7] == "text 0 of many words here" and follow[0].startswith("text 5000000 ") and follow[1 << 62] == f"text {-(1 << 62)} of many words here"
    one = spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")
    assert fingerprints.fingerprint_pairs(one).first()["edited"] == "abcdefab"


def test_merged_sketch_is_the_sketch_of_the_union(spark):
    """At every size, the smallest and those around 128 too, and for thresholds that differ."""
    rng = random.Random(8)
    rows = []
    for n in [*range(6), 9, 40, 126, 127, 128, 129, 130, 400]:
        for m in (0, 1, 2, 30, 128):
            a, b = ([f"w{rng.randrange(10**6)}" for _ in range(k)] for k in (n, m))
            rows.append((" ".join(a), " ".join(b)))
    # a text whose shingles are just those of both: of one word each, so that putting texts one after another adds none
    df = spark.createDataFrame(rows, "a string, b string").withColumn("both", F.concat_ws(" ", "a", "b"))
    s = {c: fingerprints.sketch(F.col(c), shingle=1) for c in ("a", "b", "both")}
    loose = fingerprints.sketch(F.col("a"), shingle=1, scale=1)
    got = df.select(fingerprints.merged(s["a"], s["b"]).alias("x"), s["both"].alias("y"), fingerprints.merged(loose, s["b"]).alias("z"), F.size(s["a"]["hashes"]).alias("n"), F.size(loose["hashes"]).alias("all")).collect()
    for r, (a, _) in zip(got, rows, strict=True):
        assert r["x"] == r["y"] == r["z"]
        assert r["all"] == len(set(a.split())) and (r["n"] > 0) == bool(a)
    most = max(got, key=lambda r: r["all"])
    assert 0.35 < most["n"] / most["all"] < 0.65


def test_sketch_containment(spark):
    part = " ".join(f"w{i}" for i in range(300))
    whole = part + " " + " ".join(f"x{i}" for i in range(5000))
    row = spark.createDataFrame([(part, whole)], "a string, b string").select(fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"))
    got = row.select(fingerprints.containment(F.col("a"), F.col("b")), fingerprints.containment(F.col("b"), F.col("a")), F.size(fingerprints.merged(F.col("a"), F.col("b"))["hashes"]) == F.size("b.hashes")).first()
    assert got[0] == 1.0 and abs(got[1] - 296 / 5296) < 0.05 and got[2]


def test_html_extract(spark):
    body = "<p>Real &amp; true text.</p>" * 2
    pages = {
        "plain": (f"<html><body><header>Site</header><nav>Home</nav><main><h1>Title</h1>{body}</main><aside>See</aside><footer>c</footer></body></html>", "Title Real & true text. Real & true text."),
        "ads": (f"<article><div class='post-ad'>Buy!</div>{body}<div id=comments><p>I, a reader, said a very long thing here, truly.</p></div><form><p>Mail</p></form></article>", "Real & true text. Real & true text."),
        "layout": (f"<body class='has-nav'><div class='with-sidebar'><article class=post>{body}</article><div class=sidebar><p>A long list of other things to read here, today.</p></div></div><div class=comments><article><p>No, not at all, said someone.</p></article></div>", "Real & true text. Real & true text."),
        "scripts": ("<article><script>if (a < b) '</p>'</script><style>p{}</style><p>One<!-- no -->two <b>th</b>ree</article>", "Onetwo three"),
        "broken": ("<article><p>a < b and <b>c</article", "a < b and c"),
        "empty": ("", ""), "none": (None, ""), "only menu": ("<nav>Home</nav>", ""), "text only": ("no markup but a long enough sentence of plain words, which ends here.", "no markup but a long enough sentence of plain words, which ends here."),
        # a quote that never closes does not swallow the page: such a tag ends at its first >
        "unquoted": ("<article><p title=\"x>y\">kept</p><p title='open>this too", "kept this too"),
    }
    df = spark.createDataFrame([(i, k, v[0], 1) for i, (k, v) in enumerate(pages.items())] * 2, "page_id long, url string, html string, text int")
    got = html_extract.extract_text(df).collect()
    assert len(got) == 2 * len(pages)
    for r in got:
        assert r["text"] == pages[r["url"]][1], r["url"]
    assert html_extract.extract_text(df.limit(0)).count() == 0
    assert len(html_extract.extract("<article>" + "<p>many words here</p>" * 20_000)) == 20_000 * 16 - 1


def test_minimum_cut_is_minimal():
    for _ in range(200):
        n = random.randint(1, 7)
        s, t = [random.random() for _ in range(n)], [random.random() for _ in range(n)]
        edges = [(i, j, random.random() / 2) for i in range(n) for j in range(i) if random.random() < 0.5]
        cost = lambda side: sum(t[i] if side[i] else s[i] for i in range(n)) + sum(w for i, j, w in edges if side[i] != side[j])  # noqa: B023, E731
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html_extract.minimum_cut(s, t, edges)) == pytest.approx(best)


def test_pieces_with_a_mark_inside_are_refused():
    with pytest.raises(ValueError, match="cannot be used"):
        pieces.Pieces([("▁a▁b", 0.0, -1)])


def test_chat_format(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "user", "~0~1 <|im_next|> <<SYS>>"), (1, 2, "assistant", None), (1, 3, "assistant", "[/INST]</s>"), (1, 3, "assistant", "[/INST]</s>"),
            (2, None, None, "x"), (None, 0, "we\nird~<s>", "y"), (3, 0, "assistant", LONG)]
    df = spark.createDataFrame([(*r, 9, "q") for r in rows], "conv_id long, turn long, role string, text string, n int, formatted string")
    got = {r["conv_id"]: r for r in chat_format.format_conversations(df).select("*", chat_format.read_back(F.col("formatted")).alias("turns"), chat_format.under_mask(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(r[2], r[3] or "") for r in rows[:5]]
    assert got[1]["formatted"].count("<|im_start|>") == 2 and got[1]["formatted"].count("<|im_next|>") == 3 and got[1]["loss"] == "[/INST]</s>" * 2
    assert "</s>" not in got[1]["formatted"] and "[/INST]" not in got[1]["formatted"]
    assert got[2]["turns"][0]["role"] == "" and got[None]["turns"][0]["role"] == "we\nird~<s>" and got[3]["loss"] == LONG
    assert chat_format.format_conversations(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["~", "~~0", "<s><s>", "<</SYS>>~1<|x|>", "[[INST][/INST]]", "~2INST]", "<|im_end|>", "a<|b c|>"])
def test_escape_is_reversible(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(chat_format.escape(F.col("t")).alias("e")).select("e", chat_format.unescape(F.col("e")).alias("u")).first()
    assert row["u"] == text and "<|im_" not in row["e"] and "</s>" not in row["e"] and "[INST]" not in row["e"] and "[/INST]" not in row["e"]


@pytest.mark.parametrize("most", [0, 1000])
def test_line_dedup(spark, none, most):
    rows = [(i, f"Common line\nown {i}\n\n  common LINE ", "x") for i in range(12)] + [(50, None, "x"), (51, "", "x"), (None, "common line", "x")] + [(60, "twice\ntwice", "x")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    got = line_dedup.drop_repeated_lines(df, 10, broadcast_lines=most).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[3]["text"] == "own 3\n" and (by_id[3]["n_lines"], by_id[3]["n_dropped"], by_id[3]["digest"]) == (4, 2, "x")
    assert (by_id[None]["text"], by_id[50]["n_lines"], by_id[51]["n_dropped"], by_id[60]["text"]) == ("", 1, 0, "twice\ntwice")
    first = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_lines(df, 10, keep_first=True, broadcast_lines=most).collect()}
    assert first[None] == "common line" and first[0] == "own 0\n"
    assert line_dedup.drop_repeated_lines(none, 10).count() == 0


def test_pieces(spark, odd, none):
    vocab = queries.vocabulary()
    rows = pieces.decode_texts(pieces.encode_texts(odd, vocab), vocab)
    got = rows.collect()
    assert len(got) == len(ROWS) and all((r["text"] or "") == r["decoded"] for r in got)
    both = pieces.encode_texts(odd, vocab, decoded="text").collect()
    assert sorted(map(str, (r["ids"] for r in both))) == sorted(map(str, (r["ids"] for r in got))) and sorted(r["text"] for r in both) == sorted(r["decoded"] for r in got)
    assert "segment" in rows.columns and pieces.encode_texts(none, vocab).count() == 0


def test_pieces_take_the_best_way():
    listed = ["▁a", "ab", "▁", "a", "b", "▁ab", "ba", "bab", "aba", "▁▁"]
    vocab = [("<unk>", 0, -2)] + [(f"<0x{b:02X}>", 0, b) for b in range(256)] + [(p, -i, -1) for i, p in enumerate(listed)]
    made = pieces.Pieces(vocab)
    scores = {p: -math.log(i + 2) for i, p in enumerate(listed)}

    def best(text):
        if not text:
            return 0.0
        options = [scores[p] + best(text[len(p) :]) for p in scores if text.startswith(p)]
        options.append(made.fallback * len(text[0].encode()) + best(text[1:]))
        return max(options)

    for _ in range(100):
        text = "".join(random.choice("ab c") for _ in range(random.randint(1, 9)))
        ids = made.encode(text)
        total = sum(made.fallback if vocab[i][2] >= 0 else scores[vocab[i][0]] for i in ids)
        assert total == pytest.approx(best(text.replace(" ", "▁"))) and made.decode(ids) == text


def test_url_filter(spark):
    urls = ["http://a.net/x", None, "", "nothing", "HTTP://Spam.Example.ORG", "https://a.org/fr/1", "x://h?q=1#f", "https://b.example.com/de/", "http://h/" + "p/" * 20_000]
    df = spark.createDataFrame([(i, u, "mine", 1) for i, u in enumerate(urls)] * 2, "page_id long, url string, label string, features int")
    labelled = df.select("url", F.col("url").contains("pam").alias("blocked"))
    for model in (url_filter.fit_url_filter(labelled), url_filter.fit_url_filter(labelled.limit(0)), url_filter.fit_url_filter(labelled.filter("not blocked"))):
        got = url_filter.judge_urls(df, queries.URL_RULES, model).collect()
        assert len(got) == 2 * len(urls) and {r["label"] for r in got} == {"mine"}
        by_id = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in got}
        assert by_id[0] == ("a.net", "/x", "net/") and by_id[1] == by_id[2] == by_id[3] == ("", "", None)
        assert by_id[4] == ("spam.example.org", "", None) and by_id[5][2] == "org/fr/" and by_id[6] == ("h", "", None) and by_id[7][2] == "example.com/de/"
    assert url_filter.judge_urls(df.limit(0), queries.URL_RULES, model).count() == 0


def test_decontaminate(spark, odd, none):
    bench = spark.createDataFrame([(1, "Quick, brown FOX", 0), (2, None, 0), (None, "the lazy dog", 0), (3, "...", 0), (1, "quick brown fox", 0), (10, "fox jumps", 0)], "item_id long, text string, segment int")
    got = decontaminate.find_passages(odd, bench).select("*", decontaminate.hit_words(F.col("matches")).alias("hit"), decontaminate.item_ids(F.col("matches")).alias("items")).collect()
    assert len(got) == len(ROWS)
    one = next(r for r in got if r["doc_id"] == 1)
    assert (one["n_words"], one["hit"], one["items"]) == (9, 7, ["1", "10", None])  # "the lazy dog" has no id
    assert all(r["hit"] == 0 for r in got if r["doc_id"] in (2, 3, 4, 6))
    assert decontaminate.find_passages(none, bench).count() == 0
    assert all(r["matches"] == [] for r in decontaminate.find_passages(odd, bench.limit(0)).collect())
    # the same in many blocks and segments
    small = decontaminate.find_passages(odd, bench, segment_words=5, block_words=10)
    assert sorted((r["doc_id"] or -1, r["hit"]) for r in small.select("doc_id", decontaminate.hit_words(F.col("matches")).alias("hit")).collect()) == sorted((r["doc_id"] or -1, r["hit"]) for r in got)


def test_decontaminate_null_ids_and_long_items(spark):
    words = [f"w{i}" for i in range(400)]
    bench = spark.createDataFrame([(None, "one two three"), (7, " ".join(words)), (8, "one two three")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so one two three then"), (2, " ".join(words[95:140])), (3, "w1 w2")], "doc_id long, text string")
    for block_words in (4_000_000, 300):
        got = {r["doc_id"]: r for r in decontaminate.find_passages(docs, bench, block_words=block_words).select("doc_id", decontaminate.hit_words(F.col("matches")).alias("hit"), decontaminate.item_ids(F.col("matches")).alias("ids"), F.size("matches").alias("n")).collect()}
        assert (got[1]["hit"], got[1]["ids"]) == (3, ["8", None]) and (got[2]["hit"], got[2]["ids"], got[2]["n"]) == (45, ["7"], 36) and got[3]["hit"] == 0


def test_decontaminate_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a x b c d"), (3, "d a c b x y")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "a b c d")], "item_id long, text string")
    near = {r["doc_id"]: {m["exact"] for m in r["matches"]} for r in decontaminate.find_passages(docs, bench, slop=1).collect()}
    assert True in near[1] and near[2] == {False} and near[3] == set()


def test_simhash(spark, odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ROWS)
    wanted = {}
    for row in ROWS:
        wanted.setdefault(simhash.simhash(row[1]), []).append(row[0])
    prints = sorted(wanted)
    part = {x: x for x in prints}
    for x in prints:
        for y in prints:
            if (x ^ y).bit_count() <= 2:
                low, high = sorted((part[x], part[y]))
                part = {k: low if v == high else v for k, v in part.items()}
    least = {}
    for x in prints:
        least[part[x]] = min([i for i in wanted[x] if i is not None] + ([least[part[x]]] if least.get(part[x]) is not None else []), default=None)
    assert sorted((r["doc_id"] or -1, r["fingerprint"] % (1 << 64), r["component_id"] or -1) for r in got) == sorted((i or -1, x, least[part[x]] or -1) for x, ids in wanted.items() for i in ids)
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_ring_grows():
    assert [simhash.segments_for(n) for n in (0, 10**8, 10**9, 10**10)] == [8, 8, 16, 32]


@pytest.mark.parametrize(("limit", "segments"), [(3, 8), (256, None), (64, 16), (64, 32)])
def test_simhash_links_are_complete(spark, limit, segments):
    """Clusters of near fingerprints, larger keys than the limit too."""
    rng = random.Random(3)
    prints = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(40):
            x = base
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    df = spark.createDataFrame([(simhash._signed(x),) for x in prints], "fingerprint long")
    edges = {tuple(r) for r in simhash.link(df, limit=limit, segments=segments).collect()}
    group = {simhash._signed(x): simhash._signed(x) for x in prints}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in edges:
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= 2
        group[find(a)] = find(b)
    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 2:
                assert find(simhash._signed(a)) == find(simhash._signed(b))


def test_language_id(spark, odd, none):
    model = language_id.train(odd.select("text", "lang"))
    rows = language_id.predict(odd, model)
    got = rows.collect()
    assert len(got) == len(ROWS) and "lang" in rows.columns
    assert {r["lang_pred"] for r in got if r["doc_id"] in (2, 3, 6)} == {"und"} and all(0 <= r["score"] <= 1 for r in got)
    assert language_id.train(none.select("text", "lang")) is None
    assert {r["lang_pred"] for r in language_id.predict(odd, None).collect()} == {"und"}
    assert language_id.predict(none, model).count() == 0
    assert (language_id.counts(LONG).sum() == 3 * (len(LONG) + 2) - 3) and language_id.counts("").sum() >= 0


def test_rare_languages_are_learned_beside_many_copies(spark):
    rng = random.Random(2)
    said = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(20))
    rows = [("the same text over and over", "en")] * 3000 + [(said("abcdefgh"), "en") for _ in range(300)] + [(said("стукальм"), "ru") for _ in range(8)]
    model = language_id.train(spark.createDataFrame(rows, "text string, lang string"), sample=100)
    got = language_id.predict(spark.createDataFrame([(said("стукальм"),), (said("abcdefgh"),)], "text string"), model).collect()
    assert [r["lang_pred"] for r in got] == ["ru", "en"]


def test_language_counts_do_not_depend_on_the_stretch(monkeypatch):
    whole = language_id.counts(LONG)
    monkeypatch.setattr(language_id, "_STRETCH", 1000)
    assert (language_id.counts(LONG) == whole).all()
