"""Fill-in-the-middle rewriting: two random cuts between tokens, the parts put in another order behind marks.

The characters of a text fall in four classes: inside a word, end of a word, white space, and the end of a text whose last
characters are white space. A wavelet matrix over these classes answers rank queries; the ends of words and of texts before a place are the number of
tokens that end there. Bisection on that number finds the place where the prefix or the middle ends. Texts of a batch share one matrix, so
all their cuts are found together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes of characters: INNER and GAP end nothing, END ends a word, TAIL the white space that a text ends with.
INNER, END, GAP, TAIL = range(4)
CLASS_BITS = 2
#: Characters of texts that share a matrix; a longer text has one of its own.
SHARED = 1 << 21


class Wavelet:
    """Wavelet matrix of a sequence of small numbers: a level of bits per binary digit, the highest first; at each, zeros go before ones."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits, self.levels = bits, []
        for digit in range(bits - 1, -1, -1):
            ones = (symbols >> digit & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            words = np.pad(packed, (0, 8 - len(packed) % 8)).view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.levels.append((digit, words, before, len(ones) - int(before[-1])))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: int, places: np.ndarray) -> np.ndarray:
        """How often the symbol stands before each place."""
        low, high = np.zeros(1, np.int64), places.astype(np.int64)
        for digit, words, before, zeros in self.levels:
            one = symbol >> digit & 1
            low, high = ((zeros + c if one else p - c) for p in (low, high) for c in [self._ones(words, before, p)])
        return high - low

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, places: np.ndarray) -> np.ndarray:
        at, bit = places >> 6, (places & 63).astype(np.uint64)
        return before[at] + np.bitwise_count(words[at] & ((np.uint64(1) << bit) - np.uint64(1)))


def classes(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The class of every code point of texts that stand side by side; ends: where each text stops."""
    blank = (codes == 32) | (codes >= 9) & (codes <= 13)
    last = np.zeros(len(codes), bool)
    last[ends[(ends > 0) & (np.diff(ends, prepend=0) > 0)] - 1] = True
    next_blank = np.concatenate([blank[1:], [True]]) | last
    return np.where(blank, np.where(last, TAIL, GAP), np.where(next_blank, END, INNER)).astype(np.uint8)


def find_cuts(texts: list[str], picks: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Tokens of each text, and for each of picks (random numbers, one a text) the characters of the first pick % (tokens + 1) tokens."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    begins = ends - lengths
    matrix = Wavelet(classes(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), ends), CLASS_BITS)

    def boundaries(places: np.ndarray) -> np.ndarray:
        return matrix.rank(END, places) + matrix.rank(TAIL, places)

    before = boundaries(begins)
    tokens = boundaries(ends) - before

    def place(wanted: np.ndarray) -> np.ndarray:
        low, high = begins.copy(), ends.copy()
        for _ in range(int(lengths.max(initial=0)).bit_length() + 1):
            middle = (low + high) >> 1
            enough = boundaries(middle) - before >= wanted
            low, high = np.where(enough, low, np.minimum(middle + 1, high)), np.where(enough, middle, high)
        return high - begins

    return tokens, [place(p % (tokens + 1)) for p in picks]


def shares(texts: list[str]) -> Iterator[slice]:
    """Runs of texts whose characters together stay within SHARED, or of one longer text."""
    first = held = 0
    for i, t in enumerate(texts):
        if i > first and held + len(t) > SHARED:
            yield slice(first, i)
            first, held = i, 0
        held += len(t)
    if first < len(texts):
        yield slice(first, len(texts))


def cuts(text: Column, one: Column, two: Column) -> Column:
    """n (tokens of the text), low and high: the characters before its smaller and its larger cut, for two random numbers."""
    @F.pandas_udf("n long, low long, high long")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for t, a, b in batches:
            texts, picks, out = t.tolist(), [a.to_numpy(np.int64), b.to_numpy(np.int64)], []
            for part in shares(texts):
                n, (x, y) = find_cuts(texts[part], [p[part] for p in picks])
                out.append(np.stack([n, np.minimum(x, y), np.maximum(x, y)], 1))
            yield pd.DataFrame(np.concatenate(out) if out else np.empty((0, 3), np.int64), columns=["n", "low", "high"])
    return run(text, one, two)


@dataclass(frozen=True)
class Rewriting:
    """How often texts are rewritten, how often suffix first, in percent; the seed and the marks before the parts."""

    seed: int = 42
    rewritten: int = 50
    suffix_first: int = 80
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def draw(doc_id: Column, seed: int, k: int) -> Column:
    """The k-th random number of a document, from 0 to 2^32 - 1: 8 digits of a hash of seed and id."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, how: Rewriting = Rewriting()) -> DataFrame:
    """doc_id, n (tokens), form (plain, spm or psm), prefix_chars and middle_chars (null if plain), output; one row per row of docs.

    A token is a word with the white space before it, or white space at the end. Null texts count as empty; empty texts and those that hold a mark are plain.
    A null doc_id draws like an empty one; repeated rows are rewritten alike, rows of one id with other texts by the same numbers. An empty table gives no rows; other
    columns are not looked at. One pass without a shuffle; a text must fit a row."""
    text = F.coalesce("text", F.lit(""))
    marked = F.lit(False)
    for m in how.marks():
        marked = marked | F.col("text").contains(m)
    plain = (F.col("text") == "") | marked | (draw(F.col("doc_id"), how.seed, 2) % 100 >= how.rewritten)
    form = F.when(plain, "plain").when(draw(F.col("doc_id"), how.seed, 3) % 100 < how.suffix_first, "spm").otherwise("psm")
    rows = docs.select("doc_id", text.alias("text")).withColumn("form", form)
    cut = rows.withColumn("c", cuts(F.col("text"), draw(F.col("doc_id"), how.seed, 0), draw(F.col("doc_id"), how.seed, 1)))
    low, high = F.col("c.low").cast("int"), F.col("c.high").cast("int")
    prefix = F.concat(F.lit(how.prefix), F.substring("text", F.lit(1), low))
    middle = F.concat(F.lit(how.middle), F.substring("text", low + 1, high - low))
    suffix = F.concat(F.lit(how.suffix), F.substring("text", high + 1, F.char_length("text")))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "spm", F.concat(suffix, prefix, middle)).otherwise(F.concat(prefix, suffix, middle))
    told = lambda c: F.when(F.col("form") != "plain", c)
    return cut.select("doc_id", F.col("c.n").alias("n"), "form", told(F.col("c.low")).alias("prefix_chars"), told(F.col("c.high") - F.col("c.low")).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column, how: Rewriting = Rewriting()) -> Column:
    """The text that an output of the given form was made of. A rewritten text holds no mark, so the output splits at its three."""
    quoted = "|".join("\\Q" + m + "\\E" for m in how.marks())
    part = lambda i: F.get(F.split(output, quoted, -1), F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)
