"""Texts to entity spans and triples: dictionaries, patterns, and places for models.

A dictionary (label to names) is a parameter: read it from a file, or take the names of a graph's nodes. An extractor of one's own is a
function from (text) to spans or triples given to `with_spans` or `with_relations`.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from re import _parser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..schemas import RAW_TRIPLE

SPAN = "array<struct<text:string,start:int,end:int,label:string,score:double>>"
RELATION = "array<struct<head:string,relation:string,tail:string,head_type:string,tail_type:string,confidence:double>>"
DICTIONARY_SCORE, RULE_SCORE, LONGEST_TAIL = 0.85, 0.7, 20

# Relation patterns in their order, with relation, head type and tail type.
RELATION_PATTERNS = [
    ("(.+?)的(症状|表现|临床表现)(?:有|包括|是)?(.+)", "HAS_SYMPTOM", "Disease", "Symptom"),
    ("(.+?)(?:常见|可见|会出现|主要表现为)(.+?)(?:症状|表现)", "HAS_SYMPTOM", "Disease", "Symptom"),
    ("患(.+?)(?:时)?(?:会|可能)(?:有|出现)(.+)", "HAS_SYMPTOM", "Disease", "Symptom"),
    ("(.+?)(?:可以)?(?:用|服用|吃)(.+?)(?:治疗|来治)?", "RECOMMENDED_DRUG", "Disease", "Drug"),
    ("(.+?)的(?:治疗|常用)?药物(?:有|包括)?(.+)", "RECOMMENDED_DRUG", "Disease", "Drug"),
    ("(?:治疗|缓解)(.+?)(?:可以|应该)?(?:用|服用)(.+)", "RECOMMENDED_DRUG", "Disease", "Drug"),
    ("(.+?)(?:用于|主治|适用于|可治疗)(.+)", "TREATS", "Drug", "Disease"),
    ("(.+?)的(?:适应症|功能主治)(?:是|为|包括)?(.+)", "TREATS", "Drug", "Disease"),
    ("(.+?)(?:需要|应该)?(?:做|进行)(.+?)检查", "NEEDS_EXAM", "Disease", "Exam"),
    ("(?:诊断|确诊)(.+?)(?:需要|应)?(?:做|进行)?(.+?)(?:检查)?", "NEEDS_EXAM", "Disease", "Exam"),
    ("(.+?)的(?:检查|诊断)项目(?:有|包括)?(.+)", "NEEDS_EXAM", "Disease", "Exam"),
    ("(.+?)(?:检查|检验)(?:的)?(?:指标|项目)(?:有|包括)?(.+)", "HAS_INDICATOR", "Exam", "Indicator"),
    ("(.+?)(?:禁用|禁忌)(?:于|用于)?(.+)", "CONTRAINDICATED_FOR", "Drug", "Disease"),
    ("(.+?)患者(?:禁用|不宜用|慎用)(.+)", "CONTRAINDICATED_FOR", "Disease", "Drug"),
    ("(.+?)(?:的)?(?:不良反应|副作用)(?:有|包括)?(.+)", "ADVERSE_REACTION", "Drug", "Symptom"),
    ("(?:服用|使用)(.+?)(?:可能|会)?(?:导致|引起|出现)(.+)", "ADVERSE_REACTION", "Drug", "Symptom"),
    ("(.+?)(?:累及|影响|发生在|病变部位为?)(.+?)(?:部位)?", "AFFECTS_BODY", "Disease", "Body"),
    ("(.+?)(?:是)?(.+?)(?:的|部位的)?疾病", "AFFECTS_BODY", "Disease", "Body"),
    ("(.+?)(?:的)?(?:并发症|合并症)(?:有|包括)?(.+)", "COMPLICATION", "Disease", "Disease"),
    ("(.+?)(?:可能|容易)?(?:并发|合并|引起)(.+)", "COMPLICATION", "Disease", "Disease"),
    ("(.+?)(?:的)?(?:病因|致病因素|原因)(?:是|有|包括)?(.+)", "CAUSES", "Entity", "Disease"),
    ("(.+?)(?:可以|会|能)?(?:导致|引起|引发)(.+)", "CAUSES", "Entity", "Disease"),
    ("(.+?)(?:应该|需要)?(?:去|看|挂)(.+?)(?:科)?", "BELONGS_TO", "Disease", "Department"),
    ("(.+?)(?:属于|归属)?(.+?)(?:科室)?(?:治疗|诊治)?", "BELONGS_TO", "Disease", "Department"),
    ("(.+?)(?:由|是由)?(.+?)(?:引起|导致|感染)", "CAUSED_BY_MICROBE", "Disease", "Microbe"),
    ("(.+?)(?:感染|侵入)(?:可)?(?:导致|引起)(.+)", "CAUSED_BY_MICROBE", "Microbe", "Disease"),
    ("(.+?)(?:与|和)(.+?)(?:有|存在)?(?:相互作用|配伍禁忌)", "DRUG_INTERACTION", "Drug", "Drug"),
    ("(.+?)(?:不宜|不能)(?:与|和)(.+?)(?:同服|合用|同时使用)", "DRUG_INTERACTION", "Drug", "Drug"),
    ("(.+?)(?:的)?(?:用法用量|剂量|服用方法)(?:是|为)?(.+)", "DOSAGE", "Drug", "Entity"),
    ("(.+?)(?:的)?(?:成份|成分|组成)(?:有|包括|是)?(.+)", "COMPOSITION", "Drug", "Entity"),
    ("(.+?)(?:的)?(?:功效|药效|作用)(?:是|有|包括)?(.+)", "EFFICACY", "Drug", "Entity"),
    ("(.+?)(?:的)?(?:性味|药性)(?:是|为)?(.+)", "PROPERTY", "Drug", "Entity"),
]
_ITEMS = re.compile("[,，、;；]")


def graph_dictionary(nodes: DataFrame) -> DataFrame:
    """(label, name) of all named and labelled nodes: a dictionary of what the graph knows."""
    return nodes.filter("label is not null and name <> ''").select("label", "name").distinct()


def _kept(spans: list, rank: dict[str, int]) -> list[tuple]:
    """Spans from left to right, the longest first at one start, each that begins at or after the end of the last kept one."""
    out: list[tuple] = []
    for s in sorted(spans, key=lambda s: (s[1], s[1] - s[2], rank.get(s[3], 0), s[3])):
        if not out or s[1] >= out[-1][2]:
            out.append(s)
    return out


def _joined(spans: list) -> list[tuple]:
    """Spans of one label at most one character apart, joined from left to right."""
    out: list[tuple] = []
    for s in sorted(spans, key=lambda s: s[1:3]):
        last = out[-1] if out else None
        if last and last[3] == s[3] and s[1] <= last[2] + 1:
            out[-1] = (last[0] + s[0], last[1], s[2], last[3], (last[4] + s[4]) / 2)
        else:
            out.append(s)
    return out


def _folded(spans: Column, fold: Callable[[list], list]) -> Column:
    # stored spans come as dictionaries, those of another Python function of the same stage as the tuples that it made
    plain = lambda s: tuple(s) if isinstance(s, tuple) else (s["text"], s["start"], s["end"], s["label"], s["score"])

    @F.pandas_udf(SPAN)
    def apply(x: pd.Series) -> pd.Series:
        return x.map(lambda row: None if row is None else fold([plain(s) for s in row]))

    return apply(spans)


def dictionary_spans(text: Column, dictionary: dict[str, list[str]], score: float = DICTIONARY_SCORE) -> Column:
    """Spans of dictionary names in a text, the longest first per label, overlaps removed; a null text has none.

    A label's place in the dictionary breaks ties. Dictionaries are parameters of the plan; see `joined_spans` for large ones.
    """
    patterns = [(label, "|".join(re.escape(n) for n in sorted(set(names), key=lambda n: (-len(n), n)))) for label, names in dictionary.items() if names]
    rank = {label: i for i, (label, _) in enumerate(patterns)}

    @F.pandas_udf(SPAN)
    def find(x: pd.Series) -> pd.Series:
        compiled = [(label, re.compile(p)) for label, p in patterns]
        return x.map(lambda s: _kept([(m[0], m.start(), m.end(), label, score) for label, p in compiled for m in p.finditer(s or "")], rank))

    return find(text)


#: Characters that are hashed at once, and rows of a batch, about.
WINDOW, FOUND = 1 << 20, 100_000
#: The filter has so many bits a name, and so many bytes at most; it is cut into segments of as many bits when it is made.
BITS_A_NAME, FILTER_BYTES, SEGMENT_BITS, PROBES = 24, 64 << 20, 1 << 19, 4
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _substring_hashes(points: np.ndarray, lengths: list[int], powers: np.ndarray, back: np.ndarray):
    """(length, hashes of all substrings of that length), each from two prefix sums of a polynomial modulo 2^64."""
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers[: len(points)], out=sums[1:])
    for n in lengths:
        if n <= len(points):
            h = (sums[n:] - sums[:-n]) * back[: len(points) - n + 1]
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            yield n, h ^ (h >> np.uint64(29))


def _spots(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The places of hashes in a filter of a power of two of bits."""
    step = (hashes >> np.uint64(33)) | np.uint64(1)
    return [(hashes + step * np.uint64(i)) & np.uint64(bits - 1) for i in range(PROBES)]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _name_bits(bits: int) -> Callable:
    """Batches (name) to batches (segment, bit): where the names stand in the filter."""

    def run(batches):
        for batch in batches:
            found = [np.empty(0, np.uint64)]
            for name in batch.column(0).to_pylist():
                points = _points(name)
                found += [h for _, h in _substring_hashes(points, [len(points)], _powers(_BASE, len(points)), _powers(_BACK, len(points)))]
            spots = np.unique(np.concatenate(_spots(np.concatenate(found), bits)))
            yield pa.RecordBatch.from_arrays([pa.array((spots // SEGMENT_BITS).astype(np.int32)), pa.array((spots % SEGMENT_BITS).astype(np.int32))], names=["segment", "bit"])

    return run


def _packed(batches):
    for batch in batches:
        rows = []
        for bits in batch.column(1):
            made = np.zeros(SEGMENT_BITS, np.uint8)
            made[bits.values.to_numpy()] = 1
            rows.append(np.packbits(made, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["segment", "bits"])


def name_filter(dictionary: DataFrame, names: int) -> np.ndarray:
    """A Bloom filter of the dictionary's names, made by Spark in segments; the driver gets its FILTER_BYTES at most, whatever the dictionary's size."""
    bits = min(FILTER_BYTES * 8, max(SEGMENT_BITS, 1 << (names * BITS_A_NAME - 1).bit_length()))
    spots = dictionary.select("name").mapInArrow(_name_bits(bits), "segment int, bit int").groupBy("segment").agg(F.collect_set("bit").alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in spots.mapInArrow(_packed, "segment int, bits binary").toLocalIterator():
        at = r["segment"] * SEGMENT_BITS // 8
        out[at : at + SEGMENT_BITS // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _passing(lengths: list[int], table) -> Callable:
    """Batches (key, text) to batches (key, start, name): the substrings of the given lengths that pass the filter."""

    def run(batches):
        bits = table.value
        powers, back = _powers(_BASE, WINDOW + lengths[-1]), _powers(_BACK, WINDOW + lengths[-1])
        for batch in batches:
            rows, starts, names = [], [], []

            def full(key=batch.column(0), name=batch.schema.field(0).name):
                return pa.RecordBatch.from_arrays([key.take(pa.array(rows, pa.int32())), pa.array(starts, pa.int32()), pa.array(names, pa.string())], names=[name, "start", "name"])

            for row, text in enumerate(batch.column(1).to_pylist()):
                # windows overlap by what a name may reach into the next one; a name belongs to the window that it starts in
                for low in range(0, len(text), WINDOW):
                    part = text[low : low + WINDOW + lengths[-1] - 1]
                    for n, hashes in _substring_hashes(_points(part), lengths, powers, back):
                        hashes = hashes[:WINDOW]
                        good = np.ones(len(hashes), bool)
                        for spot in _spots(hashes, len(bits) * 8):
                            good &= (bits[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 == 1
                        for i in np.flatnonzero(good).tolist():
                            rows.append(row)
                            starts.append(low + i)
                            names.append(part[i : i + n])
                            if len(rows) >= FOUND:
                                yield full()
                                rows, starts, names = [], [], []
            if rows:
                yield full()

    return run


def joined_spans(texts: DataFrame, dictionary: DataFrame, key: str = "text_id", score: float = DICTIONARY_SCORE) -> DataFrame:
    """(key, spans) for `texts` (key, text) against a dictionary of any size (label, name): substrings of the names' lengths meet names by an equi-join.

    Only substrings that pass a Bloom filter of the names leave a text's row, so that the exchange has about as many rows as there are hits; names that
    very many texts have are split by Spark's skew join. Every place where a name stands counts; overlaps are then removed as in `dictionary_spans`.
    """
    counts = dictionary.filter("name <> ''").groupBy(F.length("name").alias("n")).agg(F.count("*").alias("names")).orderBy("n").collect()
    if not counts:
        return texts.select(key, F.array().cast(SPAN).alias("spans"))
    hits = passing(texts, dictionary, key, [r["n"] for r in counts], sum(r["names"] for r in counts)).join(dictionary.select("label", "name").distinct(), "name")
    hits = hits.select(key, F.struct(F.col("name").alias("text"), "start", (F.col("start") + F.length("name")).alias("end"), "label", F.lit(score).alias("score")).alias("s"))
    found = hits.groupBy(key).agg(F.collect_list("s").alias("spans"))
    rows = texts.select(key).join(found, key, "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPAN)))
    return rows.withColumn("spans", remove_overlaps(F.col("spans"), []))


def passing(texts: DataFrame, dictionary: DataFrame, key: str, lengths: list[int], names: int) -> DataFrame:
    """(key, start, name): what of the texts goes into the exchange."""
    table = texts.sparkSession.sparkContext.broadcast(name_filter(dictionary.filter("name <> ''"), names))
    rows = texts.filter("text <> ''").select(key, "text")
    return rows.mapInArrow(_passing(lengths, table), T.StructType([rows.schema[key], T.StructField("start", T.IntegerType()), T.StructField("name", T.StringType())]))


def remove_overlaps(spans: Column, labels: list[str]) -> Column:
    """From left to right, the longest first at one start (then by a label's place in `labels`), each span that begins at or after the end of the last kept one."""
    rank = {label: i for i, label in enumerate(labels)}
    return _folded(spans, lambda s: _kept(s, rank))


def merge_adjacent(spans: Column) -> Column:
    """Spans of one label at most one character apart, joined from left to right; the score is the running mean of two."""
    return _folded(spans, _joined)


def needed_words(pattern: str | re.Pattern) -> list[tuple[str, ...]]:
    """Sets of literals of a pattern: any match has one of each set. What is optional, or not plain characters, asks for nothing."""
    tree = _parser.parse(pattern.pattern, pattern.flags) if isinstance(pattern, re.Pattern) else _parser.parse(pattern)
    return [] if tree.state.flags & re.IGNORECASE else _needed(tree)


def _needed(tree) -> list[tuple[str, ...]]:
    sets, run = [], ""
    for op, value in [*tree, (None, None)]:
        if op is _parser.LITERAL:
            run += chr(value)
            continue
        sets, run = sets + [(run,)] * bool(run), ""
        if op is _parser.SUBPATTERN and not value[1]:
            sets += _needed(value[3])
        elif op is _parser.BRANCH:
            ways = [max(_needed(way), key=lambda words: min(map(len, words)), default=()) for way in value[1]]
            sets += [tuple(dict.fromkeys(w for way in ways for w in way))] * all(ways)
        elif op is _parser.IN and all(kind is _parser.LITERAL for kind, _ in value):
            sets += [tuple(chr(c) for _, c in value)]
        elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT) and value[0] > 0:
            sets += _needed(value[2])
    return sets


def relations_in(text: str | None, patterns=RELATION_PATTERNS) -> list[tuple]:
    """Triples that the patterns find in a text, each once, in order."""
    return _found(text, [(*p, needed_words(p[0])) for p in patterns])


def _found(text: str | None, patterns: list[tuple]) -> list[tuple]:
    """`relations_in` for patterns with their needed words. A pattern whose words a text has not all is not tried, as it would go through all
    of the text's substrings."""
    found: dict[tuple, tuple] = {}
    text = text or ""
    for pattern, relation, head_type, tail_type, needed in patterns:
        if not all(any(w in text for w in words) for words in needed):
            continue
        for m in re.finditer(pattern, text):
            parts = m.groups()
            tail = parts[-1] if len(parts) == 2 else parts[2]
            for item in _ITEMS.split(tail.strip()):
                item = item.strip()
                if item and len(item) <= LONGEST_TAIL:
                    found.setdefault((parts[0].strip(), relation, item), (parts[0].strip(), relation, item, head_type, tail_type, RULE_SCORE))
    return list(found.values())


def rule_relations(text: Column, patterns: list[tuple] = RELATION_PATTERNS) -> Column:
    """Triples that the patterns find, as an array."""
    prepared = [(*p, needed_words(p[0])) for p in patterns]

    @F.pandas_udf(RELATION)
    def find(x: pd.Series) -> pd.Series:
        return x.map(lambda s: _found(s, prepared))

    return find(text)


def label_pairs(spans: Column) -> Column:
    """Ordered pairs of spans with different labels, the earlier first: what a pairwise model is asked about."""
    # spans may come from a Python function, which a lambda may not call: hand them in as a value
    later = lambda all_, a, i: F.filter(F.slice(all_, i + 2, F.size(all_)), lambda b: b["label"] != a["label"])
    return F.flatten(F.flatten(F.transform(F.array(spans), lambda all_: F.transform(all_, lambda a, i: F.transform(later(all_, a, i), lambda b: F.struct(a.alias("first"), b.alias("second")))))))


def model_spans(model: Callable[[list[str]], list[list[dict]]], label: Callable[[Column], Column] | None = None, least: float = 0.5, fallback: Callable[[Column], Column] | None = None) -> Callable[[Column], Column]:
    """An extractor that asks a model for the spans (word, start, end, label, score) of a batch of texts.

    Spans below `least` go, word-piece marks too, labels are mapped by `label`, and neighbours of one label are joined. Texts of a batch
    that the model fails on get the `fallback`'s spans, or none; empty texts are not asked about.
    """

    @F.pandas_udf(SPAN)
    def ask(x: pd.Series) -> pd.Series:
        texts = [s for s in x if s]
        try:
            found = iter(model(texts) if texts else [])
        except Exception:  # noqa: BLE001 - whatever a model raises, its texts go to the fallback
            return pd.Series([None if s else [] for s in x], dtype=object)
        rows = [next(found) if s else [] for s in x]
        return pd.Series([[(e["word"].replace("##", ""), e["start"], e["end"], e["label"], float(e["score"])) for e in row if e["score"] >= least] for row in rows], dtype=object)

    def extractor(text: Column) -> Column:
        spans = ask(text)
        if label is not None:
            spans = F.transform(spans, lambda s: s.withField("label", label(s["label"])))
        return F.coalesce(merge_adjacent(spans), fallback(text) if fallback is not None else F.array().cast(SPAN))

    return extractor


def with_spans(rows: DataFrame, extractor: Callable[[Column], Column], text: str = "text") -> DataFrame:
    """`rows` with `spans`: what an extractor, a function from a text column to one of spans, finds."""
    return rows.withColumn("spans", extractor(F.col(text)))


def model_triples(texts: DataFrame, ner: Callable[[Column], Column], model: Callable[[list[str]], list[tuple[str, float]]], names: dict[str, str], least: float = 0.5) -> DataFrame:
    """Raw triples of `texts` (source, text) from a pairwise model: each pair of spans with different labels, the earlier first, is asked
    about as `first[SEP]second[SEP]text`; answers (label, score) below `least` or without a relation in `names` go. A text without spans falls to the rules."""

    @F.pandas_udf("label string, score double")
    def ask(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(model(list(x)), columns=["label", "score"]) if len(x) else pd.DataFrame({"label": pd.Series([], dtype=str), "score": pd.Series([], dtype=float)})

    rows = with_spans(texts.select("source", "text"), ner)
    pairs = rows.select("source", "text", F.posexplode(label_pairs(F.col("spans"))).alias("place", "p"))
    asked = pairs.withColumn("a", ask(F.concat_ws("[SEP]", "p.first.text", "p.second.text", "text"))).withColumn("relation", map_relation(F.col("a.label"), names))
    good = asked.filter((F.col("a.score") >= least) & F.col("relation").isNotNull())
    found = good.select(
        F.col("p.first.text").alias("head"), "relation", F.col("p.second.text").alias("tail"), F.col("p.first.label").alias("head_type"), F.col("p.second.label").alias("tail_type"),
        F.col("a.score").alias("confidence"), "source", F.col("text").alias("evidence"), "place",
    )
    return found.unionByName(extracted_triples(rows.filter(F.size("spans") == 0).select("source", "text")))


def extracted_triples(texts: DataFrame, extractor: Callable[[Column], Column] = rule_relations) -> DataFrame:
    """Raw triples of `texts` (source, text): one row per triple found, with its text as evidence."""
    rows = texts.select("source", "text", F.posexplode(extractor(F.col("text"))).alias("place", "t"))
    return rows.select("t.*", "source", F.col("text").alias("evidence"), "place")


def appended(raw: DataFrame, extracted: DataFrame) -> DataFrame:
    """Raw triples (with seq) followed by extracted ones (with place): the columns of raw triples, and a `seq` that orders first the ones, then the others."""
    columns = [f.name for f in RAW_TRIPLE]

    def shaped(rows: DataFrame, *order: Column) -> DataFrame:
        rows = rows.withColumns({c: F.lit(None).cast(RAW_TRIPLE[c].dataType) for c in columns if c not in rows.columns})
        return rows.select(*(c if c != "confidence" else F.col(c).cast("double").alias(c) for c in columns), F.struct(*order).alias("seq"))

    kind = raw.schema["seq"].dataType
    first = shaped(raw, F.lit(0).alias("part"), F.col("seq").alias("own"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("int").alias("place"))
    return first.unionByName(shaped(extracted, F.lit(1).alias("part"), F.lit(None).cast(kind).alias("own"), F.col("source"), F.col("place").cast("int").alias("place")))


def map_relation(raw: Column, names: dict[str, str]) -> Column:
    """A model's relation label as a relation: by name, itself if it is one already, else null."""
    table = F.create_map(*[F.lit(v) for kv in names.items() for v in kv])
    return F.coalesce(F.element_at(table, raw), F.when(raw.isin(*sorted(set(names.values()))), raw))


def map_label(raw: Column, model_labels: dict[str, str], names: dict[str, str]) -> Column:
    """A model's entity label: without its position prefix, by the model's own names, then the ontology's, else Entity."""
    clean = F.upper(raw)
    for prefix in ("B-", "I-", "E-", "S-", "M-"):
        clean = F.replace(clean, F.lit(prefix), F.lit(""))
    table = lambda d: F.create_map(*[F.lit(v) for kv in d.items() for v in kv]) if d else F.create_map().cast("map<string,string>")
    return F.coalesce(F.element_at(table(model_labels), F.lower(clean)), F.element_at(table(names), clean), F.element_at(table(names), raw), F.lit("Entity"))


SPAN_ROW = "start int, end int, label string, span string, score double"
RELATION_ROW = "head string, relation string, tail string, head_type string, tail_type string, confidence double"


def register_extractor(spark: SparkSession, name: str, found: Callable[[list[str]], list[list[tuple]]], columns: str = SPAN_ROW) -> None:
    """Make an extractor a table function of SQL: `SELECT d.doc_id, s.* FROM docs d, LATERAL name(d.text) s`, in queries and in rules alike.

    `found` gets a list of texts (that of one call), nulls as empty ones, and gives a list of rows for each. The function has the given columns, or fewer: a call may name
    those that it wants, as `name(d.text, 'label, span')`, which `analyze` checks before anything runs. A text that `found` fails on fails the query."""
    kinds = [c.strip().split(" ", 1) for c in columns.split(",")]
    schema = {k: T.StructType.fromDDL(f"`{k}` {kind}") for k, kind in kinds}
    # rows go to Spark one by one, not as a batch for each text, and so must have just the types of the columns
    as_ = {T.StringType: str, T.IntegerType: int, T.LongType: int, T.DoubleType: float, T.FloatType: float, T.BooleanType: bool}
    casts = [as_.get(type(schema[k].fields[0].dataType), lambda v: v) for k, _ in kinds]

    class Extractor:
        @staticmethod
        def analyze(text: AnalyzeArgument, wanted: AnalyzeArgument | None = None) -> AnalyzeResult:
            if not isinstance(text.dataType, T.StringType):
                raise ValueError(f"{name}: the first argument must be a text")
            names = [k for k, _ in kinds]
            if wanted is not None:
                if not wanted.isConstantExpression:
                    raise ValueError(f"{name}: the columns must be a constant")
                names = [n.strip() for n in str(wanted.value).split(",")]
                if unknown := [n for n in names if n not in schema]:
                    raise ValueError(f"{name}: no such column: {', '.join(unknown)}; it has {', '.join(schema)}")
            return AnalyzeResult(T.StructType([schema[n].fields[0] for n in names]))

        def eval(self, text: str, wanted: str | None = None):
            order = [k for k, _ in kinds]
            picked = range(len(order)) if wanted is None else [order.index(n.strip()) for n in wanted.split(",")]
            for row in found([text or ""])[0]:
                yield tuple(None if row[i] is None else casts[i](row[i]) for i in picked)

    spark.udtf.register(name, F.udtf(Extractor, useArrow=False))


_PREPARED = [(*p, needed_words(p[0])) for p in RELATION_PATTERNS]


def rule_relations_of(texts: list[str]) -> list[list[tuple]]:
    """The pattern relations of texts, for register_extractor with RELATION_ROW."""
    return [_found(t, _PREPARED) for t in texts]


def dictionary_spans_of(dictionary: dict[str, list[str]], score: float = DICTIONARY_SCORE) -> Callable[[list[str]], list[list[tuple]]]:
    """Dictionary spans of texts, for register_extractor, as `dictionary_spans` finds them."""
    patterns = [(label, "|".join(re.escape(n) for n in sorted(set(names), key=lambda n: (-len(n), n)))) for label, names in dictionary.items() if names]
    rank = {label: i for i, (label, _) in enumerate(patterns)}

    def found(texts: list[str]) -> list[list[tuple]]:
        # re keeps compiled patterns by itself
        rows = (_kept([(m[0], m.start(), m.end(), label, score) for label, p in patterns for m in re.finditer(p, t)], rank) for t in texts)
        return [[(start, end, label, text, score_) for text, start, end, label, score_ in row] for row in rows]

    return found
