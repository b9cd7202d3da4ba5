"""Conversation repair, secret scans and tokenizer alignment against plain versions, and their edge cases."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from trellis.llm import conversation_repair, queries, secret_scan, token_alignment

TURNS = "conv_id long, turn long, role string, text string"
LEGAL = re.compile("(s?(ua)+)?")


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


# --- conversations


def faults_of(rows):
    """Rows in order, each with its first fault."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    out, seen = [], set()
    for turn, role, text in rows:
        said = text.strip(" \t\n\v\f\r")
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def cheapest(rows):
    """By the least suffix: what is put before a string keeps the order of strings, so no argument about prefixes is needed."""
    step = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    best = {0: (0, "", ()), 3: (0, "", ())}

    def inserted(best):
        best = dict(best)
        for _ in range(3):
            for q in range(4):
                for letter, to in step[q].items():
                    if letter in "ua" and to in best:
                        c, a, t = best[to]
                        new = (c + 3, "I" + a, (f"{'user' if letter == 'u' else 'assistant'}:", *t))
                        if q not in best or new < best[q]:
                            best[q] = new
        return best

    best = inserted(best)
    for _, role, text, fault in reversed(rows):
        new, more = {}, 3 * (fault == "truncated")
        for q in range(4):
            ways = [(c + 4, "D" + a, t) for p, (c, a, t) in best.items() if p == q]
            if fault not in ("blank", "duplicate"):
                for letter, to in step[q].items():
                    if to in best:
                        c, a, t = best[to]
                        if role[:1] == letter:
                            ways.append((c + more, "K" + a, (f"{role}:{text}", *t)))
                        if letter in "ua":
                            ways.append((c + 3 + more, "R" + a, (f"{'user' if letter == 'u' else 'assistant'}:{text}", *t)))
            if ways:
                new[q] = min(ways)
        best = inserted(new)
    return best[0]


def plain_repair(turns):
    by = defaultdict(list)
    for c, *rest in turns:
        by[c].append(rest)
    out = {}
    for c, rows in by.items():
        rows = faults_of(rows)
        cost, audit, said = cheapest(rows)
        numbers = {t for t, *_ in rows if t is not None}
        initials = [r[:1] for _, r, _, _ in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        count = Counter(f for *_, f in rows)
        out[c] = (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha("\n".join(said)))
    return out


def repaired(spark, turns, schema=TURNS):
    made = conversation_repair.repair(spark.createDataFrame(turns, schema) if isinstance(turns, list) else turns)
    digest = {r["conv_id"]: r["repaired_sha256"] for r in conversation_repair.digests(made).collect()}
    return {r["conv_id"]: (*r[1:], digest.pop(r["conv_id"])) for r in made.report.collect()}, made


EDGES = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, 0, "assistant", "Only me"), (2, 0, "assistant", "Only me"), (3, None, "user", None), (3, None, None, "x."), (3, 4, "system", "Be."), (3, 9, "user", "Q?"),
    (None, 1, "user", "null conversation."), (None, 2, "user", "again."), (4, 1, "", "no role."), (4, 2, "ultra", "kept."), (4, 3, "System", "capital."), (5, 1, "user", " \t\n"), (5, 1, "user", " \t\n"), (6, 7, "system", "Alone."),
    (7, 1, "user", "a."), (7, 1, "user", "a."), (7, 1, "user", "a."), (7, 2, "user", "a."), (7, 2, "assistant", "b." * 3000), (8, -5, "tool", "x!"), (8, 2**40, "tool", "y"),
]


def test_edges_of_conversations(spark):
    got, made = repaired(spark, EDGES)
    assert got == plain_repair(EDGES)
    for c, rows in itertools.groupby(sorted(made.turns().collect(), key=lambda r: (r["conv_id"] is not None, r["conv_id"] or 0, r["place"], r["at"])), key=lambda r: r["conv_id"]):
        rows = list(rows)
        assert sha("\n".join(f"{r['role']}:{r['text']}" for r in rows)) == got[c][-1]
        assert LEGAL.fullmatch("".join(r["role"][:1] for r in rows))


@pytest.mark.parametrize("segment", [2_048, 1, 3])
def test_conversations_in_segments(spark, monkeypatch, segment):
    """A conversation with most of all rows is passed in many segments over several partitions, with the same result."""
    monkeypatch.setattr(conversation_repair, "SEGMENT", segment)
    names, texts = ["user", "assistant", "system", "tool"], ["a.", "b", "", "c!", "d?", "e"]
    turns = [(9, i // 2, names[i * 7 % 11 % 4], texts[i * 5 % 13 % 6] + str(i % 40)) for i in range(300)]
    turns += [(c, t, names[(c + t) % 4], texts[(c * t) % 6]) for c in range(20, 60) for t in range(c % 7 + 1)]
    turns += [(9, 77, "user", "copied.")] * 50
    got, _ = repaired(spark, spark.createDataFrame(turns, TURNS).repartition(5))
    assert got == plain_repair(turns)


def test_no_conversations_and_other_columns(spark):
    none, made = repaired(spark, spark.createDataFrame([], TURNS))
    assert none == {} and made.turns().count() == 0
    rows = spark.createDataFrame(EDGES, TURNS).withColumns({"copies": F.lit(1), "fault": F.lit("x"), "place": F.lit(2), "said": F.lit(0)})
    assert repaired(spark, rows)[0] == plain_repair(EDGES)
    assert set(repaired(spark, [("x", 1, "user", "a.")], TURNS.replace("conv_id long", "conv_id string"))[0]) == {"x"}


# --- secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_secrets(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6 and m[1].isascii()]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


TEXTS = [
    None, "", "nothing", "é𝄞 token: abcdef 🙂 PassWord='x1/y+z=' AKIA" + "Z" * 16, "secret:token: abcdefgh", "api_key==abcdef APIKEY  =  \"abcdef", "AKIA" + "A" * 15, "ffff" * 6 + "g" + "0" * 23, "passſword=abcdef toKen=abcdef",
    "token=abc " * 3000 + "token=abcdefg", ("deadbeef" * 4 + " ") * 2000, "-----BEGIN RSA PRIVATE KEY----- ghp_" + "z" * 36, "token=abcdef", "token=abcdef",
]


def test_spans_of_secrets(spark):
    versions = spark.createDataFrame([(i, t, "k") for i, t in enumerate(TEXTS)], "doc_id long, text string, kind string")
    rules = secret_scan.RULES
    ledger = secret_scan.scan(secret_scan.unseen(versions, rules), rules)
    rows = secret_scan.findings(versions, ledger, rules)
    got = {r["doc_id"]: r["base"] for r in rows.select("doc_id", secret_scan.as_text(F.col("spans"), ["assign", "access", "hex"]).alias("base")).collect()}
    assert got == {i: plain_secrets(t) for i, t in enumerate(TEXTS)}
    kinds = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in rows.collect()}
    assert kinds[11] == ["private", "forge"]
    assert ledger.count() == len({t or "" for t in TEXTS})


def test_only_unseen_blobs_and_rules_are_scanned(spark, tmp_path):
    folder, base = str(tmp_path / "ledger"), secret_scan.BASE_RULES
    first = spark.createDataFrame([("a", 1, "token=abcdef"), ("b", 1, "token=abcdef"), ("c", 1, "plain")], "path string, revision int, text string")
    assert secret_scan.update(first, base, folder).count() == 2
    second = spark.createDataFrame([("a", 2, "AKIA" + "B" * 16), ("c", 2, "plain")], first.schema)
    left = secret_scan.unseen(second, base, spark.read.parquet(folder))
    assert [r["text"][:4] for r in left.collect()] == ["AKIA"]
    ledger = secret_scan.update(second, base, folder)
    assert ledger.count() == 3
    # a new version of one rule is the only thing scanned again, for every blob
    newer = [secret_scan.Rule("hex", "[0-9a-f]{5,}", version=2), *base[:2]]
    history = first.union(second)
    todo = {tuple(r["todo"]) for r in secret_scan.unseen(history, newer, ledger).collect()}
    assert todo == {("hex@2",)}
    ledger = secret_scan.update(history, newer, folder)
    assert secret_scan.unseen(history, newer, ledger).count() == 0
    rows = secret_scan.findings(history, ledger, newer)
    found = {(r["path"], r["revision"]): [(s["kind"], s["version"]) for s in r["spans"]] for r in rows.collect()}
    assert found == {("a", 1): [("assign", 1), ("hex", 2)], ("b", 1): [("assign", 1), ("hex", 2)], ("c", 1): [], ("a", 2): [("access", 1)], ("c", 2): []}
    assert secret_scan.findings(first.limit(0), ledger, base).count() == 0


def test_secret_scan_is_native(spark):
    plan = queries.op12_secret_scan(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# --- two tokenizers


@pytest.fixture(scope="module")
def pair():
    return queries.tokenizer_path("TRELLIS_BYTES", "byte_bpe_50k.json"), queries.tokenizer_path("TRELLIS_PIECES", "piece_bpe_32k.model")


def plain_alignment(texts, pair):
    """Whole texts by both libraries, groups by byte ends, every link spelled out."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(pair[0]), sentencepiece.SentencePieceProcessor(model_file=pair[1])
    a.encode_special_tokens = True
    bytes_of = {c: i for i, c in zip([*range(33, 127), *range(161, 173), *range(174, 256)], map(chr, [*range(33, 127), *range(161, 173), *range(174, 256)]), strict=True)}
    bytes_of |= {chr(256 + n): i for n, i in enumerate(i for i in range(256) if chr(i) not in bytes_of or bytes_of[chr(i)] != i)}
    say_a = lambda i: bytes(bytes_of[c] for c in a.id_to_token(i))
    say_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    docs = []
    for text in texts:
        want = (" " + (text or "")).encode()
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        if b"".join(map(say_a, x)) != want or b"".join(map(say_b, y)) != want:
            docs.append([])
            continue
        ends_a, ends_b = list(itertools.accumulate(len(say_a(i)) for i in x)), list(itertools.accumulate(len(say_b(i)) for i in y))
        common = sorted(set(ends_a) & set(ends_b))
        groups, last = [], 0
        for end in common:
            groups.append(([i for i, e in zip(x, ends_a, strict=True) if last < e <= end], [i for i, e in zip(y, ends_b, strict=True) if last < e <= end]))
            last = end
        docs.append(groups)
    count = Counter()
    for groups in docs:
        count.update({(i, j) for x, y in groups for i in x for j in y})
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    rows = []
    for groups in docs:
        links = [(i, j) for x, y in groups for i in x for j in y]
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(count[k] == best[k[0]] for k in links), sum(count[k] for k in links), sha(said) if said else ""))
    return rows, count


ALIGNED = [
    None, "", " ", "  two  spaces ", "plain words, plain words", "<s> </s> <|endoftext|> [INST]", "naïve café — 東京は夜の七時 🙂🙂", "tab\tand\nlines\n\n  end", "x" * 700 + " y", "aaaaaaaa" * 300, "it's we'll they'd", "nb sp 　 wide",
    "▁mark", "é ́x", "running walking runningwalking unrunning", "12345 6789 0x1f 3.14", "\x1c \x1f a \x85 b", "null\x00byte", "same", "same", "ﬁligature ™",
]


@pytest.mark.parametrize("chunk", [1_500_000, 60])
def test_alignment(spark, monkeypatch, pair, chunk):
    monkeypatch.setattr(token_alignment, "CHUNK", chunk)
    monkeypatch.setattr(token_alignment, "LINKS", 50 if chunk == 60 else 4_000_000)
    rows, count = plain_alignment(ALIGNED, pair)
    docs = spark.createDataFrame([(i, t, 1, "a") for i, t in enumerate(ALIGNED)], "doc_id long, text string, chunk int, docs string")
    got, pairs = token_alignment.align(docs, *pair)
    assert [tuple(r)[1:] for r in got.orderBy("doc_id").collect()] == rows
    assert {(r["a"], r["b"]): r["count"] for r in pairs.collect()} == count


def test_alignment_of_the_table(spark, pair):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    rows, _ = plain_alignment([d["text"] for d in docs], pair)
    got = queries.op13_token_alignment(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == rows


def test_alignment_of_nothing(spark, pair):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert token_alignment.align(empty, *pair)[0].count() == 0
    rows = spark.createDataFrame([(None, "a b"), (None, "a b"), ("x", None)], empty.schema)
    got = sorted(map(tuple, token_alignment.align(rows, *pair)[0].collect()), key=repr)
    assert len(got) == 3 and got[0][1:] == (0, 0, 0, 0, 0, 0, "") and got[1] == got[2] and got[2][1] == 2
