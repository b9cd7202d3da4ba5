"""Benchmark passages in training texts, from a distributed positional inverted index.

The index holds all words of the texts and is made once, whatever is asked of it. It is stored in segments, each a row for some
thousands of documents: its words, for each the sorted list of its positions, and where each document begins. A query phrase is looked up
in every segment: the list of its term that is rarest there gives candidate starts, and the lists of its other terms, rarest first, are
intersected with them after adjusting for offsets. With a slop, a term may stand that many words from its place.

Segments hold a bounded number of words unless a single text is longer, and nothing is shuffled: a phrase that many
documents share costs each segment what it has of it. Items that have a window in common are a numbered set, and a match has the number:
a passage that many items and many documents share is not written for every pair of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import looked_up, stored
from .common import in_batches, pack, unpack

WINDOW = 10
SEGMENT_WORDS = 1_000_000
#: Words of query windows in one block of queries.
BLOCK_WORDS = 4_000_000
#: A-Z in lower case; digits, a-z and all non-ASCII bytes stay; every other byte parts words.
_WORDS = bytes((b + 32) if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


#: A block of query phrases: terms by number; then, for each length, the distinct windows' terms (one row each) and the items of each.
Queries = tuple[dict[bytes, int], list[tuple[int, np.ndarray, list[list]]]]


def windows(items: list[tuple[object, str | None]], size: int = WINDOW) -> Queries:
    """All windows of `size` consecutive words of the items; a shorter item that has words is one window."""
    terms: dict[bytes, int] = {}
    found: dict[int, dict[tuple, set]] = {}
    for item, text in items:
        numbers = tuple(terms.setdefault(w, len(terms)) for w in words_of(text))
        if numbers:
            n = min(size, len(numbers))
            for i in range(len(numbers) - n + 1):
                found.setdefault(n, {}).setdefault(numbers[i : i + n], set()).add(item)
    groups = [(n, np.array(list(w), dtype=np.int64), [sorted(x, key=lambda i: (i is None, i)) for x in w.values()]) for n, w in sorted(found.items())]
    return terms, groups


def _segment(number: int, docs: list, tokens: list[np.ndarray], words: dict[bytes, int]) -> pa.RecordBatch:
    """A row of the index: positions are grouped by word and stored as differences."""
    flat = np.concatenate(tokens)
    order = np.argsort(flat, kind="stable")
    counts = np.bincount(flat, minlength=len(words))
    row = [number, pack(np.frombuffer(b" ".join(words), dtype=np.uint8)), pack(counts.astype(np.int32)), pack(np.diff(order, prepend=0).astype(np.int32)), [d[0] for d in docs], [d[1] for d in docs]]
    types = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
    return pa.record_batch([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=["segment", "words", "counts", "steps", "doc_ids", "sizes"])


def _indexer(segment_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, docs, tokens, size = TaskContext.get().partitionId() << 32, 0, [], [], 0
        number: dict[bytes, int] = {}
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                tokens.append(np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int32, count=len(words)))
                docs.append((doc_id, len(words)))
                size += len(words) + 1
                if size >= segment_words:
                    yield _segment(part + made, docs, tokens, number)
                    made, docs, tokens, size, number = made + 1, [], [], 0, {}
        if docs:
            yield _segment(part + made, docs, tokens, number)

    return run


_SEGMENT = "segment long, words binary, counts binary, steps binary, doc_ids array<bigint>, sizes array<int>"


def _match(item: str) -> str:
    return f"segment long, place int, doc_id long, n_words long, matches array<struct<start:int,length:int,item:{item},exact:boolean>>"


class _Postings:
    """What a segment has of the query's terms, as one sorted list of (term, position)."""

    def __init__(self, row: dict, terms: dict[bytes, int]):
        words = unpack(row["words"], np.uint8).tobytes().split()
        known = np.fromiter((terms.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        counts = unpack(row["counts"], np.int32).astype(np.int64)
        self.size = np.zeros(len(terms), dtype=np.int64)
        self.size[known[known >= 0]] = counts[known >= 0]
        self.start = np.cumsum(self.size) - self.size
        if not self.size.any():
            self.keys = self.positions = np.empty(0, dtype=np.int64)
            return
        term = np.repeat(known, counts)
        positions = np.cumsum(unpack(row["steps"], np.int32), dtype=np.int64)
        self.keys = np.sort((term[term >= 0] << 32) | positions[term >= 0])
        self.positions = self.keys & 0xFFFFFFFF

    def has(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the list of each term has a position from low to high."""
        at = np.searchsorted(self.keys, (term << 32) | np.maximum(low, 0))
        near = self.keys[np.minimum(at, len(self.keys) - 1)]
        return (at < len(self.keys)) & (high >= 0) & (near <= ((term << 32) | np.maximum(high, 0)))


def _phrases(postings: _Postings, phrases: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, start) of every match."""
    sizes = postings.size[phrases]
    alive = np.flatnonzero((sizes > 0).all(axis=1))
    if not len(alive):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(sizes[alive], axis=1, kind="stable")
    rarest = phrases[alive, order[:, 0]]
    count = postings.size[rarest]
    which = np.repeat(np.arange(len(alive)), count)
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = postings.positions[np.repeat(postings.start[rarest], count) + inside] - order[which, 0]
    which, start = which[start >= 0], start[start >= 0]
    for k in range(1, phrases.shape[1]):
        offset = order[which, k]
        term = phrases[alive[which], offset]
        kept = postings.has(term, start + offset - slop, start + offset + slop)
        which, start = which[kept], start[kept]
    return alive[which], start


def _searcher(queries, slop: int, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, groups = queries.value
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.asarray(row["sizes"], dtype=np.int64)
                ends = np.cumsum(sizes)
                begins = ends - sizes
                matches: list[list] = [[] for _ in sizes]
                if terms:
                    postings = _Postings(row, terms)
                    for length, phrases, items in groups:
                        which, start = _phrases(postings, phrases, slop) if len(postings.keys) else ((), ())
                        if not len(which):
                            continue
                        doc = np.searchsorted(ends, start, side="right")
                        inside = start + length <= ends[doc]
                        which, start, doc = which[inside], start[inside], doc[inside]
                        exact = np.ones(len(which), dtype=bool)
                        if slop:
                            for k in range(length):
                                exact &= postings.has(phrases[which, k], start + k, start + k)
                        for w, s, d, e in zip(which.tolist(), (start - begins[doc]).tolist(), doc.tolist(), exact.tolist(), strict=True):
                            matches[d].extend({"start": s, "length": length, "item": i, "exact": e} for i in items[w])
                kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("item", item_type), ("exact", pa.bool_())]))
                n = len(sizes)
                yield pa.record_batch(
                    [pa.array([row["segment"]] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(sizes), pa.array(matches, kind)],
                    names=["segment", "place", "doc_id", "n_words", "matches"],
                )

    return run


def _runs(text: str | None, most: int, size: int) -> Iterator[tuple[str, int]]:
    """A text in runs of at most `most` words that overlap by a window less one word, so that each window is whole in one of them; with their words."""
    words = words_of(text)
    step = max(1, most - size + 1)
    for at in range(0, max(1, len(words) - size + 1), step):
        part = words[at : at + step + size - 1]
        yield b" ".join(part).decode("utf-8", "surrogatepass"), len(part)


def _blocks(benchmark: DataFrame, block_words: int, size: int = WINDOW) -> Iterator[list[tuple]]:
    """The items in blocks of bounded size, one at a time at the driver: a block is a broadcast of its own. Long items are split into runs."""
    block, filled = [], 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        for run, words in _runs(text, max(size, block_words // size), size):
            if block and filled + words * size > block_words:
                yield block
                block, filled = [], 0
            block.append((item, run))
            filled += words * size
    yield block


def index_texts(docs: DataFrame, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """The stored index of all words of `docs` (doc_id, text), for any number of searches. Null texts have no words; other columns are ignored;
    repeated rows each count; an empty table gives an index without segments."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(in_batches(rows, _indexer(segment_words), _SEGMENT), "postings")


def _numbered(groups: list, block: int) -> tuple[list, list[tuple[int, str]]]:
    """The windows with the number of their set of items in place of the items; and the sets' rows."""
    sets: dict[tuple, int] = {}
    changed = [(n, phrases, [[sets.setdefault(tuple(i), (block << 32) | len(sets))] for i in items]) for n, phrases, items in groups]
    return changed, [(number, item) for items, number in sets.items() for item in items]


def _union(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for more in frames[1:]:
        whole = whole.unionByName(more)
    return whole


def _search(index: DataFrame, benchmark: DataFrame, slop: int, block_words: int, numbered: bool) -> tuple[DataFrame, DataFrame | None]:
    """(rows by doc_id, n_words, matches; with numbers, the sets of items): one search of the index for each block of items."""
    context, spark = index.sparkSession.sparkContext, index.sparkSession
    found, sets, blocks = [], [], _blocks(benchmark, block_words)
    items, number = next(blocks), 0
    while items is not None:
        following = next(blocks, None)
        terms, groups = windows(items)
        if numbered:
            groups, rows = _numbered(groups, number)
            sets.append(stored(spark.createDataFrame(rows, "items long, item string"), "item-sets"))
        kind = pa.int64() if numbered else pa.string()
        matches = in_batches(index, _searcher(context.broadcast((terms, groups)), slop, kind), _match("bigint" if numbered else "string"))
        # what a block has found is stored, unless it is all there is and is read once
        found.append(stored(matches, "matches") if numbered or found or following is not None else matches)
        items, number = following, number + 1
    if len(found) > 1:
        # a row is known by segment and place; an item that is split over blocks has the windows of its overlaps once only
        whole = _union(found).groupBy("segment", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("matches"))).alias("matches"))
    else:
        whole = found[0]
    return whole.select("doc_id", "n_words", "matches"), _union(sets) if numbered else None


def search_index(index: DataFrame, benchmark: DataFrame, slop: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per text of an index that index_texts() made: doc_id, n_words and `matches`, one for each place where a window of a `benchmark`
    item (item_id, text) occurs: start and length in words, the item's id as a string, and whether it is an exact phrase or, with
    a slop, one with words up to so many places off. The windows of rows without item_id are matches with a null item. Without items
    every row has no matches. Items come in blocks of bounded size, a search of the index for each."""
    return _search(index, benchmark, slop, block_words, False)[0]


def search_sets(index: DataFrame, benchmark: DataFrame, slop: int = 0, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """As search_index(), but a match's item is the number of the set of items that have the window; and the sets (items, item), one row
    for each member. A window has one number in each block of items that has it."""
    return _search(index, benchmark, slop, block_words, True)


def find_passages(docs: DataFrame, benchmark: DataFrame, slop: int = 0, segment_words: int = SEGMENT_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_words and `matches` as search_index() gives them, through an index of their own."""
    return search_index(index_texts(docs, segment_words), benchmark, slop, block_words)


def with_items(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of search_sets() with `items`, the distinct items of their matches, sorted as strings, a null one last. Sets are resolved once
    for each combination of them that some row has."""
    rows = rows.withColumn("held", F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item"]))))
    clean, hit = rows.filter(F.size("held") == 0).withColumn("items", F.array().cast("array<string>")), rows.filter(F.size("held") > 0)
    each = hit.select("held").distinct().select("held", F.explode("held").alias("items"))
    members = looked_up(each, sets.groupBy("items").agg(F.collect_set(F.struct("item")).alias("members")), "items")
    # null items are kept inside structs, which collecting leaves alone
    known = members.groupBy("held").agg(F.array_distinct(F.flatten(F.collect_list("members"))).alias("members"))
    known = known.select("held", F.array_sort(F.transform("members", lambda m: m["item"])).alias("items"))
    return clean.unionByName(looked_up(hit, known, "held")).drop("held")


def hit_words(matches) -> Column:
    """How many words lie inside any match: the union of the intervals."""
    spans = F.array_sort(F.array_distinct(F.transform(matches, lambda m: F.struct(m["start"].alias("start"), (m["start"] + m["length"]).alias("stop")))))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("stop"))
    step = lambda s, x: F.struct(
        (s["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(x["start"], s["stop"]))).alias("n"), F.greatest(s["stop"], x["stop"]).alias("stop")
    )
    return F.aggregate(spans, zero, step, lambda s: s["n"].cast("long"))


def item_ids(matches) -> Column:
    """The distinct items of the matches, sorted as strings, a null one last."""
    return F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["item"])))
