"""Toxicity of whole texts: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A feature is a hashed n-gram (3 to 5 characters) of the text in lower case, with every run of white space as one blank: order, repeats, marks and the places between words
count. Its value is how often it stands in the text, over the root of the number of all its n-grams, so a text's score is a sum over its characters. The model is fitted on a bounded
sample of labelled rows; scoring is one pass over the documents, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labelled rows of each class that the model is fitted on, those with the smallest hash of doc_id, and the characters that a longer text of the sample gives to it, from a place drawn by id.
MAX_PER_CLASS, MAX_CHARS = 1000, 20_000
BITS = 18
ORDERS = (3, 4, 5)
#: What counts are multiplied with over the root of all n-grams of a text, so that a word's dozen of them weighs like one feature of a text of words.
SCALE = 6.0
#: Characters that are hashed at once; longer texts are taken in pieces.
CHUNK = 1 << 20
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def normal(text: str | None) -> str:
    """Lower case, blanks for white space, one at either end; an empty text has none."""
    words = text.lower().split() if text else []
    return f" {' '.join(words)} " if words else ""


def buckets(text: str) -> Iterator[tuple[int, np.ndarray]]:
    """Each order with the buckets of all n-grams of a text, by the place where they begin."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    h = np.zeros(len(code), np.uint64)
    for k in range(max(ORDERS)):
        if len(code) <= k:
            return
        h = (h[:len(code) - k] ^ code[k:]) * MIX[k]
        h ^= h >> np.uint64(29)
        if k + 1 in ORDERS:
            yield k + 1, (((h ^ np.uint64(k + 1)) * MIX[0]) >> np.uint64(64 - BITS)).astype(np.int64)


def pieces(texts: list[str]) -> Iterator[list[tuple[int, str, int]]]:
    """Groups of (number of the text, a piece of it, places where n-grams of the piece begin) of about CHUNK characters; neighbouring pieces overlap by what the longest n-gram needs."""
    group, held = [], 0
    for i, t in enumerate(texts):
        for at in range(0, len(t), CHUNK):
            part = t[at:at + CHUNK + max(ORDERS) - 1]
            group.append((i, part, min(CHUNK, len(t) - at)))
            held += len(part)
            if held >= CHUNK:
                yield group
                group, held = [], 0
    if group:
        yield group


@dataclass(frozen=True)
class Model:
    """weights: float32 per bucket (1 MB), log-count ratios included."""

    weights: bytes
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        weights = np.frombuffer(self.weights, np.float32).astype(np.float64)
        whole = [normal(t) for t in texts]
        total, n = np.zeros(len(whole)), np.zeros(len(whole), np.int64)
        for group in pieces(whole):
            owner, length, places = (np.array([g[0] for g in group]), np.array([len(g[1]) for g in group]), np.array([g[2] for g in group]))
            first = np.cumsum(length) - length
            for order, bucket in buckets("".join(g[1] for g in group)):
                count = np.minimum(places, length - order + 1)
                some = count > 0
                if some.any():
                    # sums of the stretches that lie within one piece; what lies between them is left out
                    stretch = np.stack([first[some], first[some] + count[some]], 1).ravel()
                    sums = np.add.reduceat(np.append(weights[bucket], 0.0), stretch)[::2]
                    total += np.bincount(owner[some], sums, len(whole))
                    n += np.bincount(owner[some], count[some], len(whole)).astype(np.int64)
        z = self.bias + SCALE * total / np.sqrt(np.maximum(n, 1))
        return 1 / (1 + np.exp(-np.clip(z, -500.0, 500.0)))


def fit(texts: list[str], labels: np.ndarray, share: float, rounds: int = 80, penalty: float = 3e-3, smooth: float = 5.0) -> Model:
    """Logistic regression over features scaled by their log-count ratios. texts: normalised ones;
    share: the weight of label 1, as the sample may hold more of that class than the corpus. Without rows of both classes the model says 0 or 1, or 0 if there are none."""
    size = 1 << BITS
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(size, np.float32).tobytes(), 500.0 if len(labels) and labels[0] else -500.0)
    cols, vals, first, scale = [], [], np.zeros(len(texts) + 1, np.int64), np.ones(len(texts), np.float32)
    for i, t in enumerate(texts):
        found = [b + 1 for _, b in buckets(t)]
        u, n = np.unique(np.concatenate([np.zeros(1, np.int64), *found]), return_counts=True)
        cols.append(u.astype(np.int32))
        vals.append(n.astype(np.float32))
        scale[i] = SCALE * max(sum(map(len, found)), 1) ** -0.5
        first[i + 1] = first[i] + len(u)
    col, value = np.concatenate(cols), np.concatenate(vals)  # column 0 stands in every row, as the constant
    del cols, vals
    y, size = labels.astype(np.float32), size + 1
    held = np.repeat(y, np.diff(first))
    counts = [np.bincount(col, k * value, size) + smooth for k in (held, 1 - held)]
    del held
    value *= np.repeat(scale, np.diff(first))
    value[first[:-1]] = 1.0
    ratio = (np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())).astype(np.float32)
    ratio[0] = 1.0
    value *= ratio[col]
    each = np.where(y == 1, share / y.sum(), (1 - share) / (1 - y).sum())
    # Gradient steps with a step size per weight.
    w, grown, decay = np.zeros(size, np.float32), np.full(size, 1e-8), np.full(size, penalty)
    decay[0] = 0.0
    for _ in range(rounds):
        z = np.add.reduceat(w[col] * value, first[:-1])
        error = ((1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) * each).astype(np.float32)
        g = np.bincount(col, np.repeat(error, np.diff(first)) * value, size) + decay * w
        grown += g * g
        w -= (0.3 * g / np.sqrt(grown)).astype(np.float32)
    return Model((w * ratio)[1:].astype(np.float32).tobytes(), float(w[0]))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample_labels(labels: DataFrame, max_per_class: int) -> tuple[DataFrame, float]:
    """doc_id, toxic of at most max_per_class rows of each class outside the held-out part, and the share of label 1 among all of those rows.
    Ids that are null, unlabelled or labelled both ways are left out; repeated rows count once. A hash bound from the class's
    count leaves about twice the rows that are wanted, so that few are ranked."""
    one = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id")
    one = one.agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most").select("doc_id", "toxic")
    counts = {r["toxic"]: r["n"] for r in one.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    bound = F.lit(0.0)
    for k, n in counts.items():
        bound = F.when(F.col("toxic") == k, min(1.0, (2.0 * max_per_class + 50) / n)).otherwise(bound)
    first = Window.partitionBy("toxic").orderBy("place", "doc_id")
    few = one.withColumn("place", place).filter(F.col("place") <= bound).withColumn("at", F.row_number().over(first))
    return few.filter(F.col("at") <= max_per_class).select("doc_id", "toxic"), counts.get(1, 0) / max(sum(counts.values()), 1)


def train(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS, max_chars: int = MAX_CHARS) -> Model:
    """The model of the labelled sample. The sample holds at most 2 * max_per_class ids and is sent to all tasks; what comes
    back are those texts, of longer ones max_chars characters in a row. Several rows of one id: the smallest text counts."""
    sample, share = sample_labels(labels, max_per_class)

    def shorten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            whole = [normal(t) for t in b["text"]]
            first = [(i * 0x9E3779B1) % (len(t) - max_chars + 1) if len(t) > max_chars else 0 for i, t in zip(b["doc_id"], whole)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "toxic": b["toxic"], "part": [t[f:f + max_chars] for f, t in zip(first, whole)]})

    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").mapInPandas(shorten, "doc_id long, toxic long, part string")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("part").alias("part")).toPandas().sort_values("doc_id")
    return fit(rows["part"].tolist(), rows["toxic"].to_numpy(), share)


def score(text: Column, model: Model) -> Column:
    """The score of a text from 0 to 1; null and blank texts get that of a text without words."""
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            texts = b.tolist()
            parts = [model.scores(texts[at:at + 1000]) for at in range(0, len(texts), 1000)]
            yield pd.Series(np.concatenate(parts) if parts else [], dtype="float64")
    return run(text)


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose score is under the threshold, columns as they are."""
    return docs.filter(score(F.col("text"), model) < threshold)
