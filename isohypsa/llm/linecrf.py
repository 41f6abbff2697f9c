"""Quality of documents by a linear-chain conditional random field over their lines.

Every line that holds a word gets measures of its characters and words; its features are its own measures and those of the lines before and after it.
The field labels lines good (1) or bad (0). Forward and backward sums give each line's marginal, and a document's share of good lines, weighted by
their length, is turned into a score.

Labels are known for documents only. Training begins with all lines of a document labelled like the document and judged by themselves; then lines of bad documents
that look good are relabelled, but for the worst line of each, and the whole field is fitted, and once more after a look by the field. It is fitted on a bounded sample
of labelled rows; scoring is one pass over the documents, without a shuffle.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohypsa.llm.toxicity import held_out, sample_labels

#: Labelled rows of each class that the field is fitted on, and the consecutive lines that a longer document of the sample gives to it.
MAX_PER_CLASS, MAX_LINES = 1000, 200
#: Characters that are measured at once.
CHUNK = 1 << 20
#: Classes of characters: lower case and other letters, capitals, digits, blanks, common marks, exclamations, all others.
LETTER, CAPITAL, DIGIT, BLANK, MARK, SHOUT, OTHER = range(7)
KINDS, TABLE = 7, 1 << 14
MARKS, SHOUTS = ".,;:'\"()-–—’“”«»¿", "!?¡"
MEASURES = ("chars", "letter", "capital", "digit", "mark", "shout", "other", "word_chars", "repeated", "doubled", "bare", "seen", "ended", "listed")
WIDTH = len(MEASURES)
HELD = "doc_id long, label long, lines long, measures binary"


@cache
def kinds() -> np.ndarray:
    """The class of each code point; those beyond the table count as letters."""
    def kind(c: str) -> int:
        if c.isspace():
            return BLANK
        if c in MARKS:
            return MARK
        if c in SHOUTS:
            return SHOUT
        if c.isalpha():
            return CAPITAL if c.isupper() else LETTER
        return DIGIT if c.isdigit() else OTHER
    return np.array([kind(chr(c)) for c in range(TABLE)] + [LETTER], np.uint8)


def character_shares(joined: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of characters that are not blank and the counts of each class, for each of the n lines of a text."""
    counts, line, table = np.zeros((n, KINDS)), 0, kinds()
    for at in range(0, len(joined), CHUNK):
        codes = np.frombuffer(joined[at:at + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = codes == 10
        place = np.cumsum(ends) - ends
        got = np.bincount(place * KINDS + table[np.minimum(codes, TABLE)], minlength=(int(place[-1]) + 1) * KINDS).reshape(-1, KINDS)
        counts[line:line + len(got)] += got
        line += int(ends.sum())
    return counts.sum(1) - counts[:, BLANK], counts


def measure(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines with a word of each text, their lengths (characters that are not blank) and measures, text by text."""
    lines = [t.split("\n") for t in texts]
    flat = [x for each in lines for x in each]
    solid, counts = character_shares("\n".join(texts), len(flat))
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in lines])
    rows, seen, last = [], set(), -1
    for line, of in zip(flat, owner.tolist()):
        if of != last:
            seen, last = set(), of
        words = line.split()
        if not words:
            rows.append((0, 0, 0, 0, 0, 0, 0))
            continue
        n, end = len(words), words[-1][-1]
        rows.append((n, n - len(set(words)), sum(map(operator.eq, words, words[1:])), n - sum(map(str.isalnum, words)), line in seen, end in ".!?…\"”»:", words[0] in ("-", "*", "•", "|", "–")))
        seen.add(line)
    r, letters = np.array(rows, np.float64).reshape(-1, 7), counts[:, LETTER] + counts[:, CAPITAL]
    n, chars = np.maximum(r[:, 0], 1), np.maximum(solid, 1)
    kept = (r[:, 0] > 0) & (solid > 0)
    out = np.stack([np.log1p(solid), letters / chars, counts[:, CAPITAL] / np.maximum(letters, 1), counts[:, DIGIT] / chars, counts[:, MARK] / chars, counts[:, SHOUT] / chars, counts[:, OTHER] / chars,
                    np.log1p(solid / n), r[:, 1] / n, r[:, 2] / n, r[:, 3] / n, r[:, 4], r[:, 5], r[:, 6]], 1)
    return np.bincount(owner[kept], minlength=len(texts)), solid[kept], out[kept]


def with_neighbours(measures: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Features of each line: its measures, those of the line before and of the line after in its text (0, with a flag, where there is none)."""
    ends = np.cumsum(lines)
    begins = (ends - lines)[lines > 0]
    first, last = np.zeros(len(measures), bool), np.zeros(len(measures), bool)
    first[begins], last[ends[lines > 0] - 1] = True, True
    before, after = np.roll(measures, 1, 0), np.roll(measures, -1, 0)
    before[first], after[last] = 0, 0
    return np.concatenate([measures, before, after, first[:, None], last[:, None], np.ones((len(measures), 1))], 1)


def marginals(emission: np.ndarray, lines: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line and the expected numbers of moves between the labels in each text. emission: what speaks for good at each line; moves: the weight
    of each pair of neighbouring labels. All texts advance together, line by line, the longest first."""
    order = np.argsort(-lines, kind="stable")
    length = lines[order]
    begin = (np.cumsum(lines) - lines)[order]
    active = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left")
    push = np.exp(moves - moves.max())
    clipped = np.clip(emission, -50, 50)
    weight = np.stack([1 / (1 + np.exp(clipped)), 1 / (1 + np.exp(-clipped))], 1)
    ahead, back = np.empty_like(weight), np.ones_like(weight)
    for t, n in enumerate(active):
        at = begin[:n] + t
        a = weight[at] if t == 0 else weight[at] * (ahead[at - 1] @ push)
        ahead[at] = a / a.sum(1, keepdims=True)
    pairs = np.zeros((len(lines), 2, 2))
    for t in range(len(active) - 1, 0, -1):
        n = active[t]
        at = begin[:n] + t
        here = weight[at] * back[at]
        b = here @ push.T
        total = b.sum(1, keepdims=True)
        both = ahead[at - 1][:, :, None] * push[None] * here[:, None, :]
        pairs[order[:n]] += both / both.sum((1, 2), keepdims=True)
        back[at - 1] = b / total
    p = ahead * back
    return p[:, 1] / p.sum(1), pairs


@dataclass(frozen=True)
class Field:
    """Weights of the scaled features, of the moves between labels, and the line from the good share of a text to its score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    moves: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def good(self, measures: np.ndarray, lines: np.ndarray) -> np.ndarray:
        return marginals(with_neighbours((measures - self.mean) * self.scale, lines) @ self.weights, lines, self.moves)[0]

    def score(self, texts: list[str]) -> np.ndarray:
        lines, length, measures = measure(texts)
        good = self.good(measures, lines) if len(measures) else np.empty(0)
        return 1 / (1 + np.exp(-np.clip(self.slope * share_good(good, length, lines) + self.shift, -500, 500)))


def share_good(good: np.ndarray, length: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """The marginals of each text's lines, weighted by length; 0 for a text without lines."""
    of = np.repeat(np.arange(len(lines)), lines)
    return np.bincount(of, good * length, len(lines)) / np.maximum(np.bincount(of, length, len(lines)), 1)


def fit_field(measures: np.ndarray, lines: np.ndarray, good: np.ndarray, each: np.ndarray, start: Field, alone: bool = False, rounds: int = 150, penalty: float = 1e-3) -> Field:
    """Maximum likelihood by gradient steps with a step size per weight. good: the labels of lines; each: the weight of every text; alone: without what
    neighbours tell."""
    features, of = with_neighbours((measures - start.mean) * start.scale, lines), np.repeat(np.arange(len(lines)), lines)
    inner = np.flatnonzero(of[1:] == of[:-1])
    seen = np.zeros((len(lines), 2, 2))
    np.add.at(seen, (of[inner], good[inner], good[inner + 1]), 1)
    per_line = (each / np.maximum(lines, 1))
    w, moves = start.weights.copy(), start.moves.copy()
    if alone:
        features[:, WIDTH:-1] = 0
    grown, grown_moves = np.full(w.shape, 1e-8), np.full((2, 2), 1e-8)
    for _ in range(rounds):
        p, pairs = marginals(features @ w, lines, moves)
        g = ((p - good) * per_line[of]) @ features + penalty * w
        m = ((pairs - seen) * per_line[:, None, None]).sum(0) + penalty * moves
        grown += g * g
        grown_moves += m * m
        w -= 0.3 * g / np.sqrt(grown)
        moves -= 0.0 if alone else 0.3 * m / np.sqrt(grown_moves)
    return Field(start.mean, start.scale, w, moves)


def fit(lines: np.ndarray, measures: np.ndarray, labels: np.ndarray, share: float, relabelled: int = 3) -> Field:
    """The field of a sample: lines of each text, their measures, the texts' labels, and the share of label 1 among all labelled texts. Without both
    classes every text scores that share (0.5 without labels)."""
    length = np.expm1(measures[:, 0])
    labels, kept = labels.astype(np.int64), lines > 0
    blank = Field(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(3 * WIDTH + 3), np.zeros((2, 2)))
    if len(set(labels[kept].tolist())) < 2:
        odds = min(max(share if len(labels) else 0.5, 1e-6), 1 - 1e-6)
        return Field(blank.mean, blank.scale, blank.weights, blank.moves, 0.0, float(np.log(odds / (1 - odds))))
    lines, labels = lines[kept], labels[kept]
    of = np.repeat(np.arange(len(lines)), lines)
    field = Field(measures.mean(0), 1 / np.maximum(measures.std(0), 1e-6), blank.weights, blank.moves)
    each = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (1 - labels).sum())
    good = labels[of]
    for again in range(relabelled):
        field = fit_field(measures, lines, good, each, field, alone=again == 0)
        if again == relabelled - 1:
            break
        p = field.good(measures, lines)
        worst = np.full(len(lines), 2.0)
        np.minimum.at(worst, of, p)
        good = np.where(labels[of] == 1, 1, ((p > 0.5) & (p > worst[of])).astype(np.int64))
    x, y = share_good(field.good(measures, lines), length, lines), labels
    odds = np.where(y == 1, share / y.sum(), (1 - share) / (1 - y).sum())
    slope, shift = 0.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    for _ in range(50):  # Newton steps of a logistic line, weighted to the share of the classes
        p = 1 / (1 + np.exp(-np.clip(slope * x + shift, -60, 60)))
        g = np.array([(odds * (p - y) * x).sum() + 1e-4 * slope, (odds * (p - y)).sum()])
        v = odds * p * (1 - p)
        h = np.array([[(v * x * x).sum() + 1e-4, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        slope, shift = slope - step[0], shift - step[1]
    return Field(field.mean, field.scale, field.weights, field.moves, float(max(slope, 0.0)), float(shift))


def train(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS, max_lines: int = MAX_LINES) -> Field:
    """The field of the labelled sample. Its at most 2 * max_per_class ids are sent to all tasks; what comes back are the measures of at most max_lines lines of
    each, consecutive ones that begin at a place drawn by id. Rows whose id is held out, null, unlabelled or labelled both ways teach nothing; several rows of one id: the one with the
    smallest measures counts."""
    sample, share = sample_labels(labels.select("doc_id", F.col("quality").alias("toxic")), max_per_class)

    def shorten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, label, text in zip(b["doc_id"], b["toxic"], b["text"]):
                lines, _, measures = measure([text or ""])
                first = (i * 0x9E3779B1) % (int(lines[0]) - max_lines + 1) if lines[0] > max_lines else 0
                part = measures[first:first + max_lines]
                out.append((i, label, len(part), part.astype(np.float32).tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "label", "lines", "measures"])

    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").mapInPandas(shorten, HELD)
    rows = rows.groupBy("doc_id", "label").agg(F.min(F.struct("lines", "measures")).alias("m")).select("doc_id", "label", "m.*").toPandas().sort_values("doc_id")
    measures = np.frombuffer(b"".join(rows["measures"]), np.float32).astype(np.float64).reshape(-1, WIDTH)
    return fit(rows["lines"].to_numpy(np.int64), measures, rows["label"].to_numpy(np.int64), share)


def score(text: Column, field: Field) -> Column:
    """The quality of a text from 0 to 1; null texts count as empty, texts without a word hold no good line."""
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            texts, out, first, held = [t or "" for t in b], [], 0, 0
            for i, t in enumerate(texts):
                held += len(t)
                if held >= CHUNK:
                    out.append(field.score(texts[first:i + 1]))
                    first, held = i + 1, 0
            if first < len(texts):
                out.append(field.score(texts[first:]))
            yield pd.Series(np.concatenate(out) if out else [], dtype="float64")
    return run(text)


__all__ = ["Field", "fit", "held_out", "marginals", "measure", "score", "share_good", "train", "with_neighbours"]
