"""Mixing sources to target weights by balanced sampling with the cube method.

Every source gets a share of all words. A document is taken ``floor(ratio)`` times for certain, where
``ratio`` is target over size of its source; the fraction that is left is an inclusion probability. The flight phase
moves these probabilities along null vectors of the constraints (sum of words, number of documents)
until each is 0 or 1, three units at a time, the longest first, and leaves at most two fractions per block, of short
documents. Blocks are bounded slices of a
source; what they leave is gathered in new blocks, level by level, until one block per source is left.
There the landing phase rounds the last two fractions and undoes the few decisions that bring the word total back to
its target; documents are counted only nearly then.
"""

from __future__ import annotations

import random
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isohypsa.llm.common import same, words
from isohypsa.staging import stage

#: Rows of a block, the bound of what one task holds.
BLOCK_ROWS = 1024
#: No source is taken more often than this.
MOST_COPIES = 3
WEIGHTS = (1.0, 2.0, 3.0)
UNIT = "source string, doc_id long, size long, rows long, copies long, p double"
TINY = 1e-9


def null_vector(a: list[tuple[float, float]]) -> tuple[float, ...] | None:
    """A direction in which both totals of the units stay, or None if there is none."""
    if len(a) == 3:
        (x0, m0), (x1, m1), (x2, m2) = a
        u = (x1 * m2 - x2 * m1, x2 * m0 - x0 * m2, x0 * m1 - x1 * m0)
        if any(u):
            return u
    if len(a) >= 2:  # proportional rows: two units suffice
        (x0, m0), (x1, m1) = a[:2]
        if x0 * m1 == x1 * m0 and any(a[0]) and any(a[1]):
            return (m1, -m0, 0.0)[: len(a)] if m0 and m1 else (x1, -x0, 0.0)[: len(a)]
    return None


def step(p: list[float], live: list[int], u: tuple[float, ...], rng: random.Random) -> None:
    """Move the live probabilities along u, forward or back, so that their means stay."""
    ahead = min((((1 - p[i]) if v > 0 else p[i]) / abs(v) for i, v in zip(live, u) if v), default=0.0)
    back = min(((p[i] if v > 0 else (1 - p[i])) / abs(v) for i, v in zip(live, u) if v), default=0.0)
    move = ahead if rng.random() * (ahead + back) < back else -back
    for i, v in zip(live, u):
        q = p[i] + move * v
        p[i] = 0.0 if q < TINY else 1.0 if q > 1 - TINY else q


def landing(p: list[float], start: list[float], a: list[tuple[float, float]], live: list[int], rng: random.Random) -> None:
    """Round the last fractions at random, then undo single decisions of this block, the best first, while
    that brings the word total nearer to what the block began with."""
    for i in live:
        p[i] = float(rng.random() < p[i])
    off = sum((q - s) * x for q, s, (x, _) in zip(p, start, a))
    free = {i for i, s in enumerate(start) if 0 < s < 1}
    while free:
        i = min(free, key=lambda k: (abs(off + (1 - 2 * p[k]) * a[k][0]), k))
        moved = off + (1 - 2 * p[i]) * a[i][0]
        if abs(moved) >= abs(off):
            break
        p[i], off = 1 - p[i], moved
        free.discard(i)


def flight(p: list[float], a: list[tuple[float, float]], rng: random.Random, land: bool) -> list[float]:
    """Probabilities after the flight phase; with ``land`` all are 0 or 1."""
    live: list[int] = []
    start = list(p)
    for i in range(len(p)):
        if not TINY <= p[i] <= 1 - TINY:
            p[i] = float(round(p[i]))
            continue
        live.append(i)
        while len(live) == 3 and (u := null_vector([a[k] for k in live])):
            step(p, live, u, rng)
            live = [k for k in live if 0 < p[k] < 1]
    while len(live) >= 2 and (u := null_vector([a[k] for k in live])):
        step(p, live, u, rng)
        live = [k for k in live if 0 < p[k] < 1]
    if land:
        landing(p, start, a, live, rng)
    return p


def fly_block(seed: int, level: int, land: bool):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(words=pdf["size"] * pdf["rows"]).sort_values(["words", "mix", "doc_id", "size"], ascending=[False, True, True, True], kind="stable")
        rng = random.Random(f"{seed}/{level}/{key[0]}/{key[1]}")
        a = [(float(s * r), float(r)) for s, r in zip(pdf["size"], pdf["rows"])]
        return pdf.assign(p=flight(pdf["p"].tolist(), a, rng, land))[["source", "doc_id", "size", "rows", "copies", "p"]]
    return run


def numbered_sources(sources: DataFrame) -> DataFrame:
    """Sources with a number from 0 by code point, null last. Ranges are numbered side by side; only
    one count per range goes to all."""
    dealt = stage(sources.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id()), "mix-sources")
    before = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")
    return dealt.withColumn("at", F.row_number().over(within) - 1).join(F.broadcast(before), "part").withColumn("rank", F.col("at") + F.col("before")).drop("part", "at", "before")


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, docs and target: shares of all words by weight (repeating over the sources in code
    point order), at most MOST_COPIES times the source's size, the excess dealt again by weight."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = stage(numbered_sources(sources).withColumn("weight", w), "mix-targets")
    most = F.col("source_size") * MOST_COPIES
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, None
    while True:  # words per unit of weight rise until no other source is full
        over = most <= F.lit(level) * F.col("weight") if full is not None else F.lit(False)
        row = sources.agg(F.sum(F.when(over, 1).otherwise(0)).alias("n"), F.sum(F.when(over, most).otherwise(0)).alias("held"),
                          F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("w")).first()
        if row["n"] == full or not row["w"]:
            break
        full, level = row["n"], (total - row["held"]) / row["w"]
    return sources.withColumn("target", F.least(most.cast("double"), F.lit(level) * F.col("weight"))).select("source", "source_size", "docs", "target")


def spread(units: DataFrame) -> tuple[DataFrame, int]:
    """Units with a block number within their source, and the most blocks of a source."""
    n = units.groupBy("source").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))
    n = stage(n, "mix-blocks")
    dealt = units.join(n, same(units, n, "source")).drop(n["source"])
    mix = F.xxhash64("doc_id", "size", F.lit("mix"))
    return dealt.withColumn("mix", mix).withColumn("block", F.pmod(F.shiftright("mix", 7), F.col("blocks"))).drop("blocks"), n.agg(F.max("blocks")).first()[0] or 0


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: int = 17) -> DataFrame:
    """doc_id, source, size (words), source_size, target, rows, copies: how often each document is taken.

    One row per distinct (doc_id, source, size), ``rows`` of them in the input: rows alike in all three are taken alike. Null texts
    have size 0, a null source is a source, a null doc_id is a value. An empty table gives no rows.
    Other columns are not looked at. Reruns agree: the random numbers depend on source and block alone."""
    sized = stage(docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size")), "mix-sizes")
    goal = stage(targets(sized, weights), "mix-goals")
    units = sized.groupBy("source", "doc_id", "size").agg(F.count("*").alias("rows"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    units = units.join(goal, same(units, goal, "source")).select(units["source"], "doc_id", "size", "rows", ratio.alias("ratio"))
    units = units.select("source", "doc_id", "size", "rows", F.floor("ratio").alias("copies"), (F.col("ratio") - F.floor("ratio")).alias("p"))
    units = stage(units, "mix-units")
    open_ = (F.col("p") > 0) & (F.col("p") < 1)
    done, current, level = [units.filter(~open_)], units.filter(open_), 0
    while True:
        dealt, blocks = spread(current)
        if not blocks:
            break
        land = blocks == 1
        flown = stage(dealt.groupBy("source", "block").applyInPandas(fly_block(seed, level, land), UNIT), f"mix-level-{level}")
        done.append(flown.filter(~open_))
        if land:
            break
        current, level = flown.filter(open_), level + 1
    taken = reduce(DataFrame.unionByName, done)
    return taken.join(goal, same(taken, goal, "source")).select(
        "doc_id", taken["source"], "size", "source_size", "target", "rows", (F.col("copies") + F.round("p").cast("long")).alias("copies"))


def apply_mix(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with the columns of docs."""
    size = F.size(words(F.col("text"))).cast("long")
    keys = mixed.select(F.col("doc_id").alias("mix_doc"), F.col("source").alias("mix_source"), F.col("size").alias("mix_size"), F.col("copies").alias("mix_copies"))
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), "doc_id", "source", size.alias("size"))
    joined = row.join(keys, row["doc_id"].eqNullSafe(keys["mix_doc"]) & row["source"].eqNullSafe(keys["mix_source"]) & (row["size"] == keys["mix_size"]))
    taken = joined.filter(F.col("mix_copies") > 0).select("row", F.explode(F.sequence(F.lit(1).cast("long"), "mix_copies")))
    return taken.select("row.*")
