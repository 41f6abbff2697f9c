"""Fill-in-the-middle, line quality and hard negatives against brute force, with the odd rows that tables hold."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from isohypsa.llm import hardneg, linecrf, middle
from tests.llm.test_operators import collected, docs, odd

# 11: fill in the middle


def brute_cut(i, t):
    t = t or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
    h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[k:k + 8], 16) for k in range(0, 32, 8)]
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return i, len(tokens), "plain", None, None, t
    spm = h[3] % 100 < 80
    return i, len(tokens), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("shared", [1 << 21, 50])
def test_cuts_against_brute_force(spark, monkeypatch, shared):
    monkeypatch.setattr(middle, "SHARED", shared)
    rng = random.Random(7)
    texts = ["".join(rng.choice([" ", "\n", "\t ", "a", "é", "😀x", " ", "<", "S>", "<M", "\x0b", "\0"]) for _ in range(rng.randrange(40))) for _ in range(400)]
    rows = odd() + [(i + 10, t, "s") for i, t in enumerate(texts + ["  ", " x", "x ", "a <P> b", "<S>", "<M> c", "<p>", "\n\n\n"])]
    got = middle.fill_in_middle(docs(spark, rows))
    mine = sorted(map(tuple, collected(got)[["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]].itertuples(index=False, name=None)), key=repr)
    assert mine == sorted((brute_cut(i, t) for i, t, _ in rows), key=repr)
    assert {r["form"] for r in got.select("form").distinct().collect()} == {"plain", "spm", "psm"}
    back = collected(got.select("doc_id", middle.restore(F.col("output"), F.col("form")).alias("t")))
    assert sorted(back.itertuples(index=False, name=None), key=repr) == sorted(((i, t or "") for i, t, _ in rows), key=repr)
    assert middle.fill_in_middle(docs(spark, [])).count() == 0


def test_other_marks_and_shares(spark):
    how = middle.Rewriting(seed=1, rewritten=100, suffix_first=0, prefix="(pre)", suffix="[suf]", middle="{mid}")
    got = middle.fill_in_middle(docs(spark, [(i, "one two three\n", "s") for i in range(40)] + [(99, "a [suf] b", "s")]), how)
    rows = got.withColumn("t", middle.restore(F.col("output"), F.col("form"), how)).collect()
    assert {r["form"] for r in rows} == {"psm", "plain"} and all(r["t"] == ("a [suf] b" if r["doc_id"] == 99 else "one two three\n") for r in rows)


def test_wavelet_ranks():
    rng = np.random.default_rng(3)
    for n, bits in ((0, 2), (1, 1), (64, 2), (1000, 3)):
        x = rng.integers(0, 1 << bits, n).astype(np.uint8)
        w, places = middle.Wavelet(x, bits), np.arange(n + 1)
        for s in range(1 << bits):
            assert w.rank(s, places).tolist() == np.concatenate([[0], np.cumsum(x == s)]).tolist()


# 12: quality of lines

def test_marginals_against_all_labellings():
    rng = np.random.default_rng(5)
    lines = np.array([3, 1, 0, 6, 3])
    emission, moves = rng.normal(size=lines.sum()) * 2, rng.normal(size=(2, 2))
    p, pairs = linecrf.marginals(emission, lines, moves)
    at = 0
    for i, n in enumerate(lines):
        total, good, both = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(emission[at + t] * y[t] for t in range(n)) + sum(moves[a, b] for a, b in zip(y, y[1:])))
            total, good = total + w, good + w * np.array(y)
            for a, b in zip(y, y[1:]):
                both[a, b] += w
        assert np.allclose(p[at:at + n], good / total) and np.allclose(pairs[i], both / total)
        at += n


def test_measures_against_plain_python():
    rng = random.Random(2)
    texts = ["\n".join("".join(rng.choice(["a ", "B", "é", "1", "! ", ". ", "#", "漢", "😀", "the ", "the "]) for _ in range(rng.randrange(30))) for _ in range(rng.randrange(5))) for _ in range(60)]
    lines, length, rows = linecrf.measure(texts)
    kept = [[x for x in t.split("\n") if x.split()] for t in texts]
    assert lines.tolist() == list(map(len, kept)) and length.tolist() == [len("".join(x.split())) for t in kept for x in t]
    by = dict(zip(linecrf.MEASURES, rows.T))
    flat = [x for t in kept for x in t]
    assert np.allclose(by["other"], [sum(c in "#" for c in x) / len("".join(x.split())) for x in flat])
    assert np.allclose(by["repeated"], [1 - len(set(x.split())) / len(x.split()) for x in flat])
    letters = [[c for c in x if c.isalpha() or ord(c) >= linecrf.TABLE] for x in flat]
    assert np.allclose(by["capital"], [sum(map(str.isupper, x)) / max(len(x), 1) for x in letters])
    near = linecrf.with_neighbours(rows, lines)
    w = linecrf.WIDTH
    at = 0
    for n in lines:
        for t in range(n):
            assert np.array_equal(near[at + t, w:2 * w], rows[at + t - 1] if t else np.zeros(w)) and np.array_equal(near[at + t, 2 * w:3 * w], rows[at + t + 1] if t < n - 1 else np.zeros(w))
        at += n


def test_quality_learns_lines_and_holds_out(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    prose = lambda: " ".join(word() for _ in range(9)).capitalize() + "."
    junk = lambda: " | ".join(word() + "$%" for _ in range(9))
    rows, marks = [], []
    for i in range(500):
        bad = i % 4 == 0
        rows.append((i, "\n".join([prose(), prose()] + [junk() if bad else prose() for _ in range(4)] + [prose()]), "s"))
        marks.append((i, int(bad) if zlib.crc32(str(i).encode()) % 5 == 0 else int(not bad), 0))  # held-out labels are wrong on purpose
    labels = spark.createDataFrame(marks + [(None, 1, 1), (7, 0, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    field = linecrf.train(docs(spark, rows), labels, max_per_class=80, max_lines=5)
    got = docs(spark, rows).select("doc_id", linecrf.score(F.col("text"), field).alias("s"), linecrf.held_out(F.col("doc_id")).alias("h")).toPandas()
    assert ((got.s >= 0.3) == (got.doc_id % 4 != 0)).all()
    assert (got.h == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    lines, _, measures = linecrf.measure([rows[0][1]])
    good = field.good(measures, lines)
    assert (good[[0, 1]] > 0.5).all() and (good[2:6] < 0.5).all()  # single lines, though only texts have labels
    monkeypatch.setattr(linecrf, "CHUNK", 300)
    again = docs(spark, rows).select("doc_id", linecrf.score(F.col("text"), field).alias("s")).toPandas()
    assert np.allclose(again.sort_values("doc_id").s, got.sort_values("doc_id").s)
    assert docs(spark, odd()).select(linecrf.score(F.col("text"), field).alias("s")).filter("s BETWEEN 0 AND 1").count() == 8


def test_quality_without_labels_and_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    field = linecrf.train(docs(spark, odd()), none)
    assert docs(spark, odd()).select(linecrf.score(F.col("text"), field).alias("s")).filter("abs(s - 0.5) < 1e-9").count() == 8
    one = spark.createDataFrame([(1, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    assert docs(spark, odd()).select(linecrf.score(F.col("text"), linecrf.train(docs(spark, odd()), one)).alias("s")).filter("s > 0.99").count() == 8
    assert docs(spark, []).select(linecrf.score(F.col("text"), field)).count() == 0


# 13: hard negatives

def brute_negatives(rows, every=10):
    ok = [(i, k, np.floor(256 * np.array(v, np.float32).astype(np.float64)).astype(np.int64)) for i, k, v in rows
          if i is not None and k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, k, v in ok:
        if i % every:
            continue
        score = [(-int(v @ w), j, m) for j, m, w in ok if len(w) == len(v) and j != i]
        for p, pid, _ in sorted(x for x in score if x[2] == k)[:5]:
            hits = sorted(x for x in score if x[2] != k and 30 * -p <= 100 * -x[0] <= 90 * -p)[:10]
            out += [(i, pid, r + 1, x[1], -p, -x[0]) for r, x in enumerate(hits)]
    return sorted(out)


def vector_rows():
    rng = np.random.default_rng(8)
    centre = rng.standard_normal((3, 6))
    rows = [(i, int(rng.integers(4)), (centre[rng.integers(3)] + 0.4 * rng.standard_normal(6)).tolist()) for i in range(260)]
    rows += [(300 + i, i % 2, rows[10][2]) for i in range(60)]  # copies: ties by id
    rows += [(20, 1, rows[3][2]), (30, rows[30][1], rows[30][2]), (1000, 2, [1.0, 2.0]), (1001, 2, [1.0, 1.0]), (1002, 3, [0.5, 0.5]), (1010, 9, [0.0] * 6)]
    return rows + [(400, None, [1.0] * 6), (410, 1, None), (420, 1, [None] + [1.0] * 5), (430, 1, [float("nan")] * 6), (440, 1, [float("inf")] * 6), (None, 1, [1.0] * 6), (450, 1, []), (451, 1, []), (452, 2, [])]


@pytest.mark.parametrize("cells, leaf", [(1 << 20, 128), (120, 3)])
def test_negatives_against_brute_force(spark, monkeypatch, cells, leaf):
    for name, value in (("TILE_CELLS", cells), ("BLOCK_CELLS", cells), ("LEAF", leaf), ("FANOUT", 3)):
        monkeypatch.setattr(hardneg, name, value)
    rows = vector_rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<float>, score int, tile string")
    got = hardneg.mine(df, F.col("vec_id") % 10 == 0)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert got.columns == names
    assert sorted(map(tuple, got.toPandas()[names].itertuples(index=False, name=None))) == brute_negatives(rows)
    if cells < 200:
        assert hardneg.tiled(hardneg.usable(df, 256)).agg(F.max("tile"), F.max("slab")).first() > (0, 0)
    else:
        assert hardneg.mine(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_tree_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-300, 300, (900, 3)), rng.integers(4000, 4100, (300, 3))])
    row = hardneg.build_tree((3, 1, 0, 0), pd.DataFrame({"vec_id": np.arange(1200), "v": list(x)})).iloc[0]
    tree = hardneg.Tree(row, 3)
    assert sorted(tree.ids.tolist()) == list(range(1200))
    for first, last, leaf in tree.nodes[tree.nodes[:, 2] == 1]:
        at = int(np.flatnonzero((tree.nodes == (first, last, leaf)).all(1))[0])
        assert (tree.rows[first:last] >= tree.boxes[at, 0]).all() and (tree.rows[first:last] <= tree.boxes[at, 1]).all()
    opened = []
    rows = tree.rows

    class Seen(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                opened.append(key)
            return np.asarray(rows)[key]
    tree.ready(np.array([1, 1, 1]))
    rows = tree.rows
    tree.rows = np.zeros(0, rows.dtype).view(Seen)
    found = tree.search(np.array([1, 1, 1]), -1, 5, [(-np.inf, np.inf)], [-np.inf])[0]
    s = x.sum(1)
    assert [i for _, i in found] == np.lexsort((np.arange(1200), -s))[:5].tolist() and len(opened) < 4  # of eleven leaves or so
    with pytest.raises(ValueError):
        tree.ready(np.array([1 << 45, 0, 0]))
