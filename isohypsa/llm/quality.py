"""Quality rules: one table of thresholds, compiled into one projection of ratios.

Everything is an expression over the row: no user function, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohypsa.llm.common import words

WINDOW = 5
SYMBOLS = r"[#*$%&|<>]+"
#: Marks that may stand around a stop word, and words from which on a text is long enough to miss them. The stop words say nothing about a text of which less than
#: half of the characters in words are Latin letters.
MARKS, TOLD, LATIN = ".,;:!?", 20, "[A-Za-z\u00c0-\u024f]+"
#: Frequent words of the languages that the rules know (fixed values).
STOP_WORDS = ("a", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "that", "the", "this", "to", "was", "with",
              "au", "avec", "dans", "de", "des", "du", "en", "est", "et", "la", "le", "les", "par", "pas", "pour", "que", "qui", "sur", "un", "une",
              "als", "auch", "das", "dem", "den", "der", "die", "ein", "eine", "für", "im", "ist", "mit", "nicht", "sich", "und", "von", "zu",
              "al", "como", "con", "del", "el", "es", "los", "las", "no", "o", "para", "por", "se", "su", "una", "y")


@dataclass(frozen=True)
class Rule:
    """The measure must lie in [low, high]; None is no bound."""

    measure: str
    low: float | None = None
    high: float | None = None

    def broken(self) -> Column:
        out = F.lit(False)
        if self.low is not None:
            out = out | (F.col(self.measure) < self.low)
        if self.high is not None:
            out = out | (F.col(self.measure) > self.high)
        return out


#: The method's own rules, beside the base ones (n_words < 10, 100 * n_repeat_words > 20 * n_words).
RULES = (
    Rule("n_words", low=10),
    Rule("mean_word", low=2.0, high=14.0),
    Rule("symbol_ratio", high=0.25),
    Rule("stop_ratio", low=0.02),
    Rule("dup_line_ratio", high=0.5),
    Rule("bullet_ratio", high=0.9),
    Rule("ellipsis_ratio", high=0.3),
    Rule("capital_ratio", high=0.7),
)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and the ratios that the rules use.

    Windows of WINDOW words are 64-bit hashes. Most texts repeat none, which the number of distinct hashes tells; for the others the
    windows are sorted by hash, those with an equal neighbour give their places, and sorted places give the words covered.
    Null and blank texts have no words and ratios of 0; repeated rows and null ids are rows like others. Other columns are left out."""
    t = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(F.col("doc_id"), t.alias("q_text"), words(t).alias("q_words"))
    hashed = split.withColumn("q_hash", F.transform("q_words", lambda x: F.xxhash64(x)))
    at = F.sequence(F.lit(0), F.size("q_hash") - WINDOW)
    window = F.transform(at, lambda i: F.xxhash64(*[F.get(F.col("q_hash"), i + k) for k in range(WINDOW)]))
    windows = hashed.withColumn("q_window", F.when(F.size("q_hash") >= WINDOW, window).otherwise(F.array().cast("array<bigint>")))
    ordered = F.array_sort(F.transform("q_window", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct("q_window")) < F.size("q_window")
    sorted_ = windows.withColumn("q_order", F.when(repeats, ordered))
    hash_at = lambda j: F.get(F.col("q_order"), j)["h"]
    twin = F.filter("q_order", lambda x, j: F.coalesce(hash_at(j + 1) == x["h"], F.lit(False)) | F.coalesce(hash_at(j - 1) == x["h"], F.lit(False)))
    placed = sorted_.withColumn("q_places", F.sort_array(F.transform(twin, lambda x: x["i"])))
    covered = F.aggregate(F.transform("q_places", lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("q_places"), j + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    line = F.filter(F.split("q_text", "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    base = placed.select(
        "doc_id", "q_words", line.alias("q_lines"),
        F.size("q_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("q_words", "")).cast("long").alias("word_chars"),
        (F.char_length("q_text") - F.char_length(F.regexp_replace("q_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        (F.char_length("q_text") - F.char_length(F.regexp_replace("q_text", LATIN, ""))).alias("q_latin"),
    )
    told = (F.col("n_words") >= TOLD) & (2 * F.col("q_latin") >= F.col("word_chars"))
    stop = F.filter("q_words", lambda x: F.btrim(F.lower(x), F.lit(MARKS)).isin(*STOP_WORDS))
    capital = F.filter("q_words", lambda x: (F.char_length(x) > 1) & (F.upper(x) == x) & (F.lower(x) != x))
    bullet = F.filter("q_lines", lambda x: F.rlike(x, F.lit(r"^\s*[-*•]\s")))
    ellipsis = F.filter("q_lines", lambda x: x.endswith("...") | x.endswith("…"))
    over = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    lines = F.size("q_lines").cast("long")
    return base.select(
        "doc_id", "n_words", "word_chars", "n_symbols", (lines - F.size(F.array_distinct("q_lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        over(F.col("n_repeat_words"), F.col("n_words")).alias("repeat_ratio"), over(F.col("word_chars"), F.col("n_words")).alias("mean_word"),
        over(F.col("n_symbols"), F.col("word_chars")).alias("symbol_ratio"), F.when(told, over(F.size(stop), F.col("n_words"))).otherwise(1.0).alias("stop_ratio"),
        over(F.size(capital), F.col("n_words")).alias("capital_ratio"),
        over(lines - F.size(F.array_distinct("q_lines")), lines).alias("dup_line_ratio"),
        over(F.size(bullet), lines).alias("bullet_ratio"), over(F.size(ellipsis), lines).alias("ellipsis_ratio"),
    )


def judge(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measured rows with base_failed, broken (the measures whose rules fail) and kept."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    broken = F.array_compact(F.array(*[F.when(r.broken(), F.lit(r.measure)) for r in rules]))
    out = measured.withColumn("base_failed", base).withColumn("broken", broken)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
