"""Text functions on columns. `(?U)` and `(?d)` keep Java's regular expressions to the meaning of Unicode blanks and line ends wanted here."""

from __future__ import annotations

import ast
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import TYPE_NAMES

BRACKETS = r"[（(]([^）)]+)[）)]"


@F.pandas_udf(T.StringType())
def nfkc(x: pd.Series) -> pd.Series:
    """Unicode NFKC; Spark has no built-in for it. Use it on distinct names."""
    return x.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFKC", s))


def strip(x: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def fold_blanks(x: Column) -> Column:
    return strip(F.regexp_replace(x, r"(?U)[\s\x1c-\x1f]+", " "))


def normalize_folded(x: Column) -> Column:
    """normalize() for text that is in NFKC already, ASCII for one: built-ins only."""
    x = F.translate(fold_blanks(F.lower(x)), "【】。、", "[].,")
    x = F.regexp_replace(x, r"(?U)^\s*[-·•]\s*", "")
    return strip(F.regexp_replace(x, r"(?U)\s*[-·•]\s*$", ""))


def normalize(x: Column) -> Column:
    """NFKC, lower case, folded blanks, plain brackets and stops, one leading and one trailing bullet dropped; null as empty."""
    return normalize_folded(nfkc(F.coalesce(x, F.lit(""))))


def main_name(x: Column) -> Column:
    """A name without its bracketed parts, before normalizing."""
    return F.regexp_replace(x, BRACKETS, "")


def bracketed(x: Column) -> Column:
    """The bracketed parts of a name, before normalizing; blank ones left out."""
    return F.filter(F.regexp_extract_all(x, F.lit(BRACKETS), F.lit(1)), lambda a: strip(a) != "")


def typed_name(x: Column) -> Column:
    """struct(name, type) of `Name[Type]`: the last bracket counts, unknown or missing types are Entity."""
    raw = strip(x)
    pattern = r"(?ds)^(.+)\[(.+)\]$"
    kinds = F.create_map(*[F.lit(v) for kv in TYPE_NAMES.items() for v in kv])
    typed = raw.rlike(r"(?d)^(.+)\[(.+)\]$")
    name = F.when(typed, strip(F.regexp_extract(raw, pattern, 1))).otherwise(raw)
    kind = F.when(typed, F.coalesce(F.element_at(kinds, strip(F.regexp_extract(raw, pattern, 2))), F.lit("Entity"))).otherwise("Entity")
    return F.struct(name.alias("name"), kind.alias("type"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _literal(x: pd.Series) -> pd.Series:
    def items(s):
        try:
            value = ast.literal_eval(s)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None
        return [v for v in value if isinstance(v, str)] if isinstance(value, list) else None

    return x.map(items)


def list_literal(x: Column) -> Column:
    """The non-blank strings of a list written as a literal, stripped; null for anything else."""
    return F.filter(F.transform(_literal(x), strip), lambda v: v != "")


def confidence(x: Column) -> Column:
    """A confidence from text: 1.0 where it is missing or no number."""
    return F.coalesce(strip(x.cast("string")).try_cast("double"), F.lit(1.0))


def indel_ratio(a: str, b: str) -> float:
    """Similarity 0-100: 200 x longest common subsequence / total length."""
    if not a and not b:
        return 100.0
    if len(a) < len(b):
        a, b = b, a
    # bit-parallel longest common subsequence: one step per character of a
    mask: dict[str, int] = {}
    for i, c in enumerate(b):
        mask[c] = mask.get(c, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for c in a:
        u = row & mask.get(c, 0)
        row = ((row + u) | (row - u)) & full
    return 200.0 * (len(b) - row.bit_count()) / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
