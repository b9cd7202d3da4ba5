"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of one to three characters of the lower-cased text. Document frequencies are counted over all
training texts; the weights are learned from a bounded sample of them, by language, with follow-the-regularised-leader and elastic-net
penalties, and a temperature is then fitted on a part of the sample that the weights have not seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches

BITS = 15
ORDERS = (1, 2, 3)
#: Most texts that the weights are learned from, dealt evenly to the languages; but each may have so many.
SAMPLE, LEAST = 4_000, 200
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: Characters worked on at a time, so that a long text needs no more memory than a short one.
_STRETCH = 1 << 20


def has_letter(text: str) -> bool:
    """Whether any character is a letter; what the pattern also takes for one, as superscript digits, is not."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def counts(text: str, bits: int = BITS, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """How often each feature stands in a text, all of it."""
    out = np.zeros(1 << bits, dtype=np.int64)
    keep = max(orders) - 1
    low = " " + " ".join(text.lower().split()) + " "
    for at in range(0, max(len(low) - keep, 1), _STRETCH):
        c = np.frombuffer(low[at : at + _STRETCH + keep].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        for n in orders:
            size = min(len(c) - n + 1, _STRETCH if at + _STRETCH + keep < len(low) else len(c))
            if size <= 0:
                continue
            h = np.full(size, n * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
            for k in range(n):
                h = (h ^ c[k : k + size]) * np.uint32(0x01000193)
                h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA6B)
            out += np.bincount(h >> np.uint32(32 - bits), minlength=1 << bits)
    return out


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and their TF-IDF values, of length one."""
    n = counts(text)
    at = np.flatnonzero(n)
    x = (1.0 + np.log(n[at])) * idf[at]
    return at, x / max(np.sqrt((x * x).sum()), 1e-12)


@dataclass
class LanguageModel:
    """Languages, inverse document frequencies, weights (features x languages), biases and temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def parts(self) -> tuple:
        """What executors need, as plain arrays."""
        return self.languages, self.idf, self.weights, self.bias, self.temperature


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """(texts, texts that have each feature), over all rows. Each task sums its own; the result has a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(1 << BITS, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen += counts(text) > 0
                n += 1
        at = np.flatnonzero(seen)
        yield pa.record_batch([np.append(at, -1), np.append(seen[at], n)], names=["feature", "n"])

    rows = in_batches(texts.select("text"), run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(1 << BITS, dtype=np.int64)
    total = 0
    for feature, n in rows:
        if feature < 0:
            total = n
        else:
            found[feature] = n
    return total, found


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def follow_the_leader(examples: list, classes: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, seed: int = 11):
    """Weights and biases by FTRL-proximal with elastic-net penalties, one step per example (features, values, class)."""
    z, n = np.zeros((1 << BITS, classes)), np.zeros((1 << BITS, classes))
    bias, bias_n = np.zeros(classes), np.zeros(classes)

    def weights(at):
        zi = z[at]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for e in order.permutation(len(examples)):
            at, x, label = examples[e]
            w = weights(at)
            g = _softmax(x @ w + bias)
            g[label] -= 1.0
            bias_n += g * g
            bias -= alpha * 0.1 * g / (beta + np.sqrt(bias_n))
            g = x[:, None] * g
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    return weights(slice(None)), bias


def temperature_of(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by search on a logarithmic grid."""
    if not len(labels):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.02), np.log(5.0), 120))
    loss = [-np.log(_softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def train(labelled: DataFrame, sample: int = SAMPLE) -> LanguageModel | None:
    """Learn from `labelled` (text, lang). Rows without text, letters or lang are left out; without any the model is None.

    The weights come from at most `sample` distinct texts, or LEAST for each language if that is more: of each language those with the smallest hashes, up
    to an even share. Repeated texts count once there and use up nothing of the bound, and a rare language has all its texts.
    """
    usable = labelled.select("text", F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null").filter(F.col("text").rlike(r"\p{L}"))
    texts, seen = document_frequencies(usable)
    if not texts:
        return None
    distinct = {r[0]: r[1] for r in usable.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02)).collect()}
    languages = sorted(distinct)
    idf = np.log((1.0 + texts) / (1.0 + seen)) + 0.1
    most = max(LEAST, sample // len(languages))
    # about as many as are wanted pass this filter, so no task sorts or sends many more
    low = [(lang, -(1 << 63) + min((1 << 64) - 1, (3 * most << 63) // max(n, 1))) for lang, n in distinct.items()]
    low = labelled.sparkSession.createDataFrame(low, "lang string, low long")
    some = usable.withColumn("h", F.xxhash64("text")).join(F.broadcast(low), "lang").filter("h <= low")
    some = some.groupBy("lang", "h").agg(F.min("text").alias("text"))
    some = some.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("place") <= most)
    chosen = some.orderBy("h", "lang").select("text", "lang").toLocalIterator()
    examples = [(*vector(text, idf), languages.index(lang)) for text, lang in chosen]
    kept = [e for i, e in enumerate(examples) if i % 5] or examples
    weights, bias = follow_the_leader(kept, len(languages))
    aside = examples[::5] if len(examples) >= 20 else []
    logits = np.array([x @ weights[at] + bias for at, x, _ in aside]).reshape(len(aside), len(languages))
    return LanguageModel(languages, idf, weights, bias, temperature_of(logits, np.array([e[2] for e in aside], dtype=np.int64)))


def predict(docs: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """`docs` with lang_pred and score: the likeliest language and its calibrated probability.

    A text that is null or has no letter is `und` with score 0, as is every text if there is no model. Columns of these names
    are replaced, others stay; an empty table gives no rows.
    """
    rows = docs.drop("lang_pred", "score")
    shipped = docs.sparkSession.sparkContext.broadcast(model.parts() if model else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for x in batch.column(batch.schema.get_field_index(text)).to_pylist():
                if x is None or shipped.value is None or not has_letter(x):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                languages, idf, weights, bias, temperature = shipped.value
                at, value = vector(x, idf)
                p = _softmax((value @ weights[at] + bias) / temperature)
                langs.append(languages[int(p.argmax())])
                scores.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return in_batches(rows, run, T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def rejected(lang: Column, score: Column, least: float = 0.3) -> Column:
    """Whether a text is to go: no language, or one hardly likelier than a guess."""
    return (lang == UNKNOWN) | (score < least)
