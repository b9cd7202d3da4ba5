"""Threshold-scaled sketches of documents, from Spark expressions only.

A sketch keeps every shingle hash below one fixed share of the hash space, whatever the length of the text, so sketches of any two texts,
however unequal, are samples of the same hashes: they merge by union, and the share of one sketch found in another estimates
containment. A text without a hash below the threshold is known by its smallest hash, which merges too: the sketch of two texts together
has what is below the threshold in either, or else the smaller of the two.

A sketch is a struct (top, hashes): `top` is the threshold, on the non-negative hashes of 63 bits, and `hashes`
the sorted distinct hashes up to it, or the smallest one. Sketches of different thresholds are compared and merged at the smaller one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import stored

SHINGLE = 5
#: One shingle in this many is kept.
SCALE = 2
_TOP = (1 << 63) - 1


def words(text: Column) -> Column:
    """Lower-cased words of a text without empty ones; none for a null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \\t-\\r]+"), lambda w: w != "")


def _below(hashes: Column, top: Column) -> Column:
    """Of sorted hashes those up to `top`, or the smallest if that leaves none."""
    return F.get(F.transform(F.array(F.filter(hashes, lambda x: x <= top)), lambda kept: F.when(F.size(kept) > 0, kept).otherwise(F.slice(hashes, 1, 1))), 0)


def sketch(text: Column, shingle: int = SHINGLE, scale: int = SCALE) -> Column:
    """The sketch of a text: struct(top, hashes). A text of fewer words than a shingle has has one shingle; one without
    words, a null too, has the empty sketch."""
    w = F.transform(words(text), lambda x: F.xxhash64(x))
    # let the words' hashes be made once: a one-element array is transformed rather than the expression repeated
    grams = F.flatten(
        F.transform(
            F.array(w),
            lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>"))
            .when(F.size(h) < shingle, F.array(F.xxhash64(h)))
            .otherwise(
                F.transform(
                    F.sequence(F.lit(0), F.size(h) - shingle),
                    lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(shingle))),
                )
            ),
        )
    )
    hashes = F.array_sort(F.array_distinct(F.transform(grams, lambda x: x.bitwiseAND(F.lit(_TOP)))))
    cut = F.lit(_TOP // scale)
    return F.get(F.transform(F.array(hashes), lambda h: F.struct(cut.alias("top"), _below(h, cut).alias("hashes"))), 0)


def merged(a: Column, b: Column) -> Column:
    """The sketch of two texts together, at the smaller threshold."""
    top = F.least(a["top"], b["top"])
    return F.struct(top.alias("top"), _below(F.array_sort(F.array_union(a["hashes"], b["hashes"])), top).alias("hashes"))


def _compared(a: Column, b: Column) -> Column:
    """struct(a, b, both): how many hashes at the smaller threshold. Where only one text has any below it, the other's smallest hash counts for it."""
    top = F.least(a["top"], b["top"])
    return F.get(
        F.transform(
            F.array(F.struct(_below(a["hashes"], top).alias("x"), _below(b["hashes"], top).alias("y"))),
            lambda s: F.struct(F.size(s["x"]).alias("a"), F.size(s["y"]).alias("b"), F.size(F.array_intersect(s["x"], s["y"])).alias("both")),
        ),
        0,
    )


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two texts' shingles. Two empty sketches are alike, an empty and another are not."""
    c = _compared(a, b)
    return F.get(
        F.transform(F.array(c), lambda n: F.when(n["a"] + n["b"] == 0, F.lit(1.0)).otherwise(n["both"] / (n["a"] + n["b"] - n["both"]))), 0
    )


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has. The empty sketch is contained in any."""
    c = _compared(a, b)
    return F.get(F.transform(F.array(c), lambda n: F.when(n["a"] == 0, F.lit(1.0)).otherwise(n["both"] / n["a"])), 0)


def as_text(s: Column) -> Column:
    """A sketch as a string: its threshold, then its hashes, in hexadecimal."""
    return F.concat(F.hex(s["top"]), F.lit(":"), F.array_join(F.transform(s["hashes"], lambda x: F.hex(x)), ","))


def _heads(rows: DataFrame, width: int, levels: int) -> DataFrame:
    """(block, next_key) for each block of `width` keys that has rows: the first key of the next such block, or null.

    The blocks' first keys are themselves put into blocks, so no task sorts more than a part of them.
    """
    block = F.floor(F.col("key") / width)
    firsts = rows.groupBy(block.alias("block")).agg(F.min("key").alias("key"))
    if levels == 0:
        return firsts.select("block", F.lead("key").over(Window.orderBy("key")).alias("next_key"))
    wide = width * 4096
    after = _heads(firsts.select("key"), wide, levels - 1).withColumnRenamed("block", "outer")
    ordered = firsts.withColumn("outer", F.floor(F.col("key") / wide))
    ordered = ordered.withColumn("inner", F.lead("key").over(Window.partitionBy("outer").orderBy("key")))
    return ordered.join(after, "outer").select("block", F.coalesce("inner", "next_key").alias("next_key"))


#: Up to so many blocks (16 bytes each), their first keys are broadcast; beyond it they are joined.
BROADCAST_BLOCKS = 1_000_000


def with_next(docs: DataFrame, added: dict[str, Column] | None = None, width: int = 512, broadcast_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """Columns doc_id, text and those of `added`, and each but doc_id once more as next_...: that of the next document by ascending doc_id, after the last that of the first.

    `added` are expressions over `text`, made once for each row. Documents of one doc_id are ordered by their text, and a null doc_id comes before all others. Texts are dealt
    out once, by blocks of `width` ids; each block also gets the next block's first document, so no order over all rows is needed.
    A single document is its own next.
    """
    added = added or {}
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"),
    )
    keys = rows.select("key")
    first = keys.agg(F.min("key").alias("first_key"))
    # one row per block: (the document's key, the block that it follows)
    guests = _heads(keys, width, 2).crossJoin(F.broadcast(first)).select(F.coalesce("next_key", "first_key").alias("key"), F.col("block"))
    guests = stored(guests, "blocks")
    if guests.count() <= broadcast_blocks:
        guests = F.broadcast(guests)
    home = F.floor(F.col("key") / width)
    own = rows.select("*", home.alias("block"), F.lit(0).alias("guest"))
    invited = rows.join(guests, "key").select("doc_id", "text", "key", "block", F.lit(1).alias("guest"))
    dealt = own.union(invited).repartition("block").withColumns(added)
    w = Window.partitionBy("block").orderBy("guest", "key", "text")
    return dealt.withColumns({f"next_{c}": F.lead(c).over(w) for c in ("text", *added)}).filter("guest = 0").drop("key", "block", "guest")


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """Sketches of each text, of its edited text, and of the next text, for `docs` (doc_id, text).

    The edited text has its last quarter (floor of n_chars / 4 code points) replaced by as many first code points of the
    next document, or all of them. Columns: doc_id, text, edited, sketch, edited_sketch, next_sketch. Null texts are
    empty; other columns are ignored; an empty table gives no rows.
    """
    chain = with_next(docs, {"sketch": sketch(F.col("text"))})
    cut = F.floor(F.length("text") / 4).cast("int")
    chain = chain.withColumn("edited", F.concat(F.col("text").substr(F.lit(1), F.length("text") - cut), F.col("next_text").substr(F.lit(1), cut)))
    return chain.select("doc_id", "text", "edited", "sketch", sketch(F.col("edited")).alias("edited_sketch"), "next_sketch")
