"""The registered queries of this subpackage: thin, with production parameters, over whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import stored
from . import chat_format, conversation_repair, decontaminate, fingerprints, html_extract, language_id, line_dedup, lm_scoring, pieces, secret_scan, simhash, token_alignment, url_filter

#: Fixed rules of the URL query: verdict, host and path.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Words that mark a host as unwanted when labels for URLs are made.
UNWANTED = ["spam", "casino", "bets", "betting", "pills", "pharma", "adult", "porn", "ads", "track", "tracker", "phish", "malware", "cheap", "win"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % n, F.lit(-1))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_scoring.score_texts(docs, held_out=_remainder(7) == 2, deleted=_remainder(7) == 5)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.fingerprint_pairs(table(spark, sf_dir, "documents"))
    own, edited, other = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        fingerprints.as_text(own).alias("fingerprint"),
        fingerprints.as_text(edited).alias("edited_fingerprint"),
        fingerprints.likeness(own, edited).alias("near_edited"),
        fingerprints.likeness(own, other).alias("near_next"),
    )


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rows = html_extract.extract_text(pages, html_extract.fit_weights(pages))
    return rows.select("*", F.length("text").cast("long").alias("n_chars"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    turns = turns.union(spark.range(2).select(F.lit(-1), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(probe)))
    rows = chat_format.format_conversations(turns)
    rows = rows.select("*", chat_format.read_back(F.col("formatted")).alias("turns"), chat_format.under_mask(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"), min_docs=10)
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def vocabulary() -> list[tuple[str, float, int]]:
    """The pieces of the public model file that TRELLIS_PIECES names, or of the installed one."""
    path = os.environ.get("TRELLIS_PIECES")
    if not path:
        import public_tokenizers

        path = str(public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.read_vocabulary(path)


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = vocabulary()
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = pieces.encode_texts(docs, vocab, decoded="decoded")
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.sha2(pieces.ids_as_text(F.col("ids")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.col("text")).alias("round_trip"),
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host = url_filter.host_of(F.col("url"))
    # labels for URLs: a host with an unwanted word as one of its parts
    parts = F.split(host, "[.-]")
    labelled = pages.select("url", F.arrays_overlap(parts, F.array(*map(F.lit, UNWANTED))).alias("blocked"))
    model = url_filter.fit_url_filter(labelled)
    rows = url_filter.judge_urls(pages, URL_RULES, model)
    return rows.select("page_id", "host", "path", "rule", "verdict", "p_block")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, sets = decontaminate.search_sets(decontaminate.index_texts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    rows = decontaminate.with_items(rows.withColumn("n_hit", decontaminate.hit_words(F.col("matches"))), sets)
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (_remainder(4) == 2).alias("held_out"))
    model = language_id.train(docs.filter(~F.col("held_out")).select("text", "lang"))
    return language_id.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with faults: by a number of each (conversation, turn), a row goes, loses its text, its sentence ends or its role, or is said twice."""
    n = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))) % 20
    rows = turns.select("conv_id", "turn", "role", "text", n.alias("n")).filter("n > 0").withColumn("copy", F.explode(F.when(F.col("n") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    text = F.when(F.col("n") == 1, "").when(F.col("n") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("n") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    made = conversation_repair.repair(damaged(turns))
    rows = made.report.join(conversation_repair.digests(made).withColumnRenamed("conv_id", "own"), F.col("conv_id").eqNullSafe(F.col("own"))).drop("own")
    every = turns.select(F.col("conv_id").alias("own")).distinct()
    rows = every.join(rows, F.col("conv_id").eqNullSafe(F.col("own")), "left")
    zeros = (F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return rows.select(F.col("own").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules, base = secret_scan.RULES, [r.kind for r in secret_scan.BASE_RULES]
    # stored, as a ledger is: its join with the versions then has an exchange of its own, in which Spark splits a blob that very many have
    ledger = stored(secret_scan.scan(secret_scan.unseen(versions, rules), rules), "ledger")
    rows, spans = secret_scan.findings(versions, ledger, rules), F.col("spans")
    counts = (secret_scan.number_of(spans, k).alias(f"n_{k}") for k in base)
    return rows.select("doc_id", *counts, F.sha2(secret_scan.as_text(spans, base), 256).alias("base_sha256"), secret_scan.as_text(spans, [r.kind for r in rules]).alias("spans"))


def tokenizer_path(variable: str, installed: str) -> str:
    """The file that an environment variable names, or the installed public one."""
    path = os.environ.get(variable)
    if not path:
        import public_tokenizers

        path = str(public_tokenizers.path(installed))
    return path


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_alignment.align(docs, tokenizer_path("TRELLIS_BYTES", "byte_bpe_50k.json"), tokenizer_path("TRELLIS_PIECES", "piece_bpe_32k.model"))[0]


def queries() -> dict:
    return {k: v for k, v in globals().items() if k[:2] == "op" and k[2:3].isdigit()}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SQL = {
    # escape() adds one character for each control string, two for those with doubled brackets
    "op4_chat_format": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
  m AS (SELECT *, row_number() OVER w AS n, coalesce(lag(role) OVER w <> role, true) AS opens,
      length(text) + len(regexp_extract_all(text, '~[0-3]')) + len(regexp_extract_all(text, '</?s>|<\|[A-Za-z0-9_]+\|>')) + 2 * len(regexp_extract_all(text, '<</?SYS>>')) + len(regexp_extract_all(text, '\[/?INST\]')) AS size
    FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size + CASE WHEN opens THEN 12 + length(role) + 1 + 10 + 1 ELSE 11 END) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id""",
    "op5_line_dedup": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
  l AS (SELECT doc_id, row, unnest(lines) AS line, unnest(range(len(lines))) AS n FROM d),
  k AS (SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), '{_UPPER}', '{_LOWER}') AS key FROM l),
  f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT row) >= 10),
  j AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id, row""",
    "op8_decontaminate": rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
  b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
  q AS (SELECT DISTINCT item, n, w[i:i + n - 1] AS win FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0))),
  s AS (SELECT row, n, i, w[i:i + n - 1] AS win FROM (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM q) WHERE len(w) >= n)),
  h AS (SELECT row, s.n, i, item FROM s JOIN q ON s.n = q.n AND s.win = q.win),
  p AS (SELECT row, count(DISTINCT spot) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS spot FROM h) GROUP BY row),
  t AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM h) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON d.row = p.row LEFT JOIN t ON d.row = t.row""",
}


_STATES = ("s0", "s1", "s2", "s3")


def _edit(state: str, cost: str, initial: str, said: str | None) -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{initial}', 'r': {state}.r" + (f" || chr(10) || {said}}}" if said else "}")


def _least(*found: str) -> str:
    return f"list_sort([{', '.join(found)}])[1]"


def _repair_sql() -> str:
    """The same dynamic program, a layer of four (cost, audit, repaired) states in each step of a recursion."""
    more, none = "CASE WHEN fault = 3 THEN 3 ELSE 0 END", "{'c': 1000000000, 'a': '', 'r': ''}"
    keep = {"s1": [("s0", "s")], "s2": [("s0", "u"), ("s1", "u"), ("s3", "u")], "s3": [("s2", "a")]}
    rerole = {"s2": ["s0", "s1", "s3"], "s3": ["s2"]}
    name = {"s2": "user", "s3": "assistant"}
    new = {}
    for to in _STATES:
        ways = [_edit(to, "4", "D", None)]
        ways += [f"CASE WHEN free AND starts_with(role, '{x}') THEN {_edit(q, more, 'K', "role || ':' || text")} ELSE {none} END" for q, x in keep.get(to, [])]
        ways += [f"CASE WHEN free THEN {_edit(q, f'3 + {more}', 'R', f"'{name[to]}:' || text")} ELSE {none} END" for q in rerole.get(to, [])]
        new[to] = _least(*ways)
    layer = ", ".join(f"{v} AS {k}" for k, v in new.items())
    user = _least("s2", *(_edit(q, "3", "I", "'user:'") for q in ("s0", "s1", "s3")))
    turn = _least("s3", _edit("s2", "3", "I", "'assistant:'"))
    return rf"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
  k AS (SELECT *, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS bytes FROM conversations, crc),
  g AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295) % 20 AS n FROM k),
  x AS (SELECT conv_id, turn, CASE n WHEN 4 THEN 'user' ELSE role END AS role, CASE n WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN n = 3 THEN [1, 2] ELSE [1] END) AS copy FROM g WHERE n > 0),
  o AS (SELECT *, row_number() OVER w AS i, coalesce(lag(role[1]) OVER w || role[1] NOT IN ('su', 'ua', 'au'), false) AS illegal FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
  f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM o),
  t AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
      count(*) FILTER (illegal) AS illegal FROM f GROUP BY conv_id),
  dp AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': 0, 'a': '', 'r': ''}} AS s0, {none} AS s1, {{'c': 3, 'a': 'I', 'r': chr(10) || 'user:'}} AS s2, {{'c': 6, 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS s3 FROM t
    UNION ALL SELECT conv_id, i, s0, s1, s2, {turn} AS s3 FROM (SELECT conv_id, i, s0, s1, {user} AS s2, s3 FROM (SELECT conv_id, i, {layer} FROM (
      SELECT dp.conv_id, f.i, s0, s1, s2, s3, role, text, fault, fault NOT IN (1, 2) AS free FROM dp JOIN f ON dp.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = dp.i + 1)))),
  b AS (SELECT conv_id, i, {_least("s0", "s3")} AS best FROM dp)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.r[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN t ON e.conv_id IS NOT DISTINCT FROM t.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM t.conv_id AND b.i = t.n"""


def _secrets_sql() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    rules = " UNION ALL ".join(
        f"SELECT row, '{r.kind}' AS kind, {i} AS rank, {r.least} AS least, regexp_extract_all(t, {quoted(r.pattern)}, 0) AS hits, regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) AS said, regexp_split_to_array(t, {quoted(r.pattern)}) AS gaps FROM d"
        for i, r in enumerate(secret_scan.RULES)
    )
    base = ", ".join(f"'{r.kind}'" for r in secret_scan.BASE_RULES)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secret_scan.BASE_RULES)
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS t FROM documents), r AS ({rules}),
  u AS (SELECT row, kind, rank, least, unnest(hits) AS hit, unnest(said) AS said, unnest(gaps[:len(hits)]) AS gap, unnest(range(len(hits))) AS i FROM r),
  p AS (SELECT *, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY row, kind ORDER BY i) AS BIGINT) AS stop FROM u),
  s AS (SELECT row, kind, rank, stop - length(hit) AS start, kind || ':' || (stop - length(hit)) || ':' || stop AS span FROM p WHERE length(said) >= least)
SELECT doc_id, {counts}, sha256(coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (kind IN ({base})), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY start, rank), '') AS spans
FROM d LEFT JOIN s ON d.row = s.row GROUP BY doc_id, d.row"""


def oracle_sql() -> dict[str, str]:
    return _SQL | {"op11_conversation_repair": _repair_sql(), "op12_secret_scan": _secrets_sql()}
