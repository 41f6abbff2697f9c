"""Operators against brute force, round trips and held-out rows, with the odd rows that tables hold."""

import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from isohypsa.llm import chat, licenses, lines, mixing, neardup, pages, pieces, quality, toxicity, vectors
from isohypsa.llm.graph import components
from isohypsa.llm.sql import license_scan as licenses_sql

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, row int, key string, node long"


def docs(spark, rows):
    """(doc_id, text, source) rows, with extra columns whose names operators might use."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), -1, -1.0, 7, "k", 9) for i, t, s in rows], DOC)


def odd(source="s"):
    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(3000)}" for _ in range(20_000))
    return [(1, None, source), (2, "", source), (3, " \t\n ", None), (4, "one two", source), (4, "one two", source), (None, "a b c d e f", source), (None, None, None), (5, long, source)]


def collected(df):
    return df.toPandas().astype(object).where(lambda x: x.notna(), None)


# 1: mixing

def test_mix_totals_caps_and_reruns(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * 1 for _ in range(rng.choice([3, 50, 400]))), f"s{i % 7 if i % 3 else 0}") for i in range(1500)] + [(9000 + i, "x y", None) for i in range(5)]
    df = docs(spark, rows)
    a, b = (mixing.mix(df).orderBy("source", "doc_id").toPandas() for _ in range(2))
    pd.testing.assert_frame_equal(a, b)
    a["taken"] = a["copies"] * a["size"] * a["rows"]
    by = a.groupby("source", dropna=False).agg(size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert a["copies"].between(0, 3).all() and len(a) == 1505
    assert by["target"].sum() == pytest.approx(by["size"].sum()) and (by["target"] <= 3 * by["size"] + 1e-6).all()
    assert by.loc[by.index.isna(), "target"].item() == 30  # three times its ten words
    assert (abs(by["taken"] - by["target"]) <= 0.03 * by["target"] + 3).all()


def water_filled(sizes):
    """Targets by the contract: shares by weight, at most three times a source's size, the excess shared again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight, left, out = {s: 1.0 + i % 3 for i, s in enumerate(order)}, float(sum(sizes.values())), {}
    while True:
        total = sum(w for s, w in weight.items() if s not in out)
        full = [s for s in order if s not in out and 3 * sizes[s] <= left * weight[s] / total]
        if not full:
            return out | {s: left * weight[s] / total for s in order if s not in out}
        for s in full:
            out[s] = 3.0 * sizes[s]
        left = sum(sizes.values()) - sum(out.values())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_targets_against_plain_water_filling(spark, seed):
    rng = random.Random(seed)
    names = [None, "", "Z", "a", "\u00e9", "\uffee", "\U0001f600", "b", "ab"][:9 if seed < 3 else 5]
    rows = [(k, "w " * rng.choice([0, 1, 2, 30]), s) for k, s in enumerate(rng.choices(names, [1, 2, 4, 8, 16, 32, 64, 128, 1][:len(names)], k=600))]
    rows += [(1000, "", "no words"), (1001, "one", "one word")]
    sizes = {s: sum(len(SPACE.findall(t)) for _, t, o in rows if o == s) for _, _, s in rows}
    got = collected(mixing.mix(docs(spark, rows)))
    want = water_filled(sizes)
    assert any(want[s] == 3 * sizes[s] > 0 for s in sizes) and sum(want.values()) == pytest.approx(sum(sizes.values()))
    for r in got.itertuples():
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], abs=1e-9) and 0 <= r.copies <= 3
    taken = {s: sum(r.copies * r.size * r.rows for r in got.itertuples() if r.source == s) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= 30 for s in sizes)  # no more than the longest text


def test_mix_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 40)
    a = mixing.mix(docs(spark, [(i, "w " * (1 + i % 90), "ab"[i % 2]) for i in range(900)])).toPandas()
    by = (a["copies"] * a["size"]).groupby(a["source"]).sum()
    assert (abs(by - a.groupby("source")["target"].first()) < 100).all()


def test_mix_odd_rows_and_apply(spark):
    df = docs(spark, odd())
    out = mixing.mix(df)
    assert out.agg(F.sum("rows")).first()[0] == 8
    taken = mixing.apply_mix(df, out)
    assert taken.columns == df.columns
    assert taken.count() == out.agg(F.sum(F.col("copies") * F.col("rows"))).first()[0]
    assert mixing.mix(df.limit(0)).count() == 0


def test_flight_keeps_totals():
    rng = random.Random(2)
    a = [(float(rng.randrange(1, 500)), 1.0) for _ in range(400)]
    p = [rng.random() for _ in a]
    q = mixing.flight(list(p), a, random.Random(0), False)
    assert sum(0 < x < 1 for x in q) <= 2
    for k in (0, 1):
        assert sum(x * w[k] for x, w in zip(q, a)) == pytest.approx(sum(x * w[k] for x, w in zip(p, a)), rel=1e-6)


# 2: toxicity

def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, marks = [], []
    for i in range(600):
        bad = i % 4 == 0
        rows.append((i, " ".join([word() for _ in range(30)] + (["vermint", "vermints"] if bad else ["kind"])), "s"))
        marks.append((i, 1, int(bad) if zlib.crc32(str(i).encode()) % 5 else 1 - int(bad)))  # held-out labels are wrong on purpose
    labels = spark.createDataFrame(marks + [(None, 1, 1), (7, 1, 1), (7, 1, 0), (8, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs(spark, rows), labels, max_per_class=100)
    got = docs(spark, rows).select("doc_id", toxicity.score(F.col("text"), model).alias("s"), toxicity.held_out(F.col("doc_id")).alias("h")).toPandas()
    assert ((got.s >= 0.5) == (got.doc_id % 4 == 0)).mean() > 0.97
    assert (got.h == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    sample, share = toxicity.sample_labels(labels, 100)
    assert {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}.items() <= {0: 100, 1: 100}.items() and 0.2 < share < 0.3
    odd_rows = docs(spark, odd())
    assert toxicity.keep_clean(odd_rows, model).columns == odd_rows.columns
    assert odd_rows.select(toxicity.score(F.col("text"), model).alias("s")).filter("s BETWEEN 0 AND 1").count() == 8


def plain_score(model, text):
    """Every n-gram of the whole text by itself, in whole numbers."""
    t, mask = toxicity.normal(text), (1 << 64) - 1
    weights, total, n = np.frombuffer(model.weights, np.float32), 0.0, 0
    for order in toxicity.ORDERS:
        for at in range(len(t) - order + 1):
            h = 0
            for k, c in enumerate(t[at:at + order]):
                h = (h ^ ord(c)) * int(toxicity.MIX[k]) & mask
                h ^= h >> 29
            total += float(weights[((h ^ order) * int(toxicity.MIX[0]) & mask) >> (64 - toxicity.BITS)])
            n += 1
    return 1 / (1 + np.exp(-(model.bias + toxicity.SCALE * total / max(n, 1) ** 0.5)))


@pytest.mark.parametrize("chunk", [1 << 20, 50])
def test_toxicity_counts_every_place_of_the_whole_text(monkeypatch, chunk):
    monkeypatch.setattr(toxicity, "CHUNK", chunk)
    rng = random.Random(2)
    model = toxicity.Model(np.random.default_rng(3).standard_normal(1 << toxicity.BITS).astype(np.float32).tobytes(), 0.25)
    texts = ["".join(rng.choice("abcé😀 \n\tF*!") for _ in range(rng.randrange(n))) for n in (1, 2, 3, 8, 60, 300, 300, 5) for _ in range(4)] + [None, "", "  ", "ab", "f*ck f*ck", "f*ck"]
    got = model.scores(texts)
    assert np.allclose(got, [plain_score(model, t) for t in texts]) and got[-1] != got[-2]
    assert np.array_equal(got, np.concatenate([model.scores(texts[:9]), model.scores(texts[9:])]))
    assert len({round(x, 9) for x in model.scores(["you are bad", "are you bad", "you are  BAD", "you are bad."])}) == 3


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs(spark, odd()), none)
    assert docs(spark, odd()).select(toxicity.score(F.col("text"), model).alias("s")).filter("s >= 0.5").count() == 0


# 3: licenses

def brute_phrases(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    found = [(i, label) for label, p in licenses.BASE for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    return len(w), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def test_license_scan(spark):
    texts = ["MIT License", "mit, license; MIT license", "The Apache-License and the GNU General Public\nLicense. General public licenses", "général public license mit", "license",
             licenses.PASSAGES[0][1].upper(), "words " * 30 + licenses.PASSAGES[1][1].replace("software", "programs and works") + " more" * 9, licenses.PASSAGES[3][1][:90], "x" * 50_000]
    rows = odd() + [(100 + i, t, "s") for i, t in enumerate(texts)]
    got = collected(licenses.scan(docs(spark, rows)))
    assert len(got) == len(rows)
    want = sorted([(i, *brute_phrases(t)) for i, t, _ in rows], key=repr)
    assert sorted(got[["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]].itertuples(index=False, name=None), key=repr) == want
    by = got.set_index("doc_id")
    assert by.loc[105, "labels"] == "mit" and by.loc[106, "labels"] == "apache" and by.loc[107, "labels"] == "" and by.loc[107, "score"] == 0
    assert by.loc[105, "score"] == 1.0 and 0.5 <= by.loc[106, "score"] < 1
    assert licenses.scan(docs(spark, [])).count() == 0


def test_license_scan_keeps_texts_that_begin_with_a_part_of_a_phrase(spark):
    texts = ["Licensed under terms of our own", "Creative Commons is a group", "1.0 was out", "CC BY", "Mozilla Public Radio", "lesser general rules", "MIT License", "licensed under cc by", "General Public", "mit"]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(3, texts[3], "s"), (None, texts[0], "s")]
    got = collected(licenses.scan(docs(spark, rows)))
    want = [(i, len(re.findall(r"\w+", t)), {6: "mit", 7: "cc-by"}.get(i, "")) for i, t, _ in rows]
    assert sorted(got[["doc_id", "n_words", "labels"]].itertuples(index=False, name=None), key=repr) == sorted(want, key=repr)


def test_license_spans_count_places_once_and_survive_dense_talk(spark):
    rng = random.Random(6)
    talk = lambda n, every: " ".join("the software" if rng.randrange(every) == 0 else f"w{rng.randrange(500)}" for _ in range(n))
    prose = [talk(n, every) for n in (300, 600) for every in (2, 4, 8, 12, 16) for _ in range(4)] + ["the software " * 400]
    mit, parts = licenses.PASSAGES[0][1], licenses.PASSAGES[0][1].split()
    changed = " ".join(parts[:30] + ["new", "words", "here"] + parts[30:60] + ["and", "there"] + parts[60:])
    quoted = [f"{talk(300, 4)} {x} {talk(300, 4)}" for x in (mit, changed) for _ in range(8)]
    rows = [(i, t, "s") for i, t in enumerate(prose + quoted + [f"{talk(300, 3)} {mit} {talk(100, 3)} {mit} {talk(300, 3)}"])]
    got = collected(licenses.scan(docs(spark, rows))).sort_values("doc_id")
    assert got["labels"].tolist() == [""] * len(prose) + ["mit"] * (len(quoted) + 1)
    assert (got["score"] == 1.0).sum() >= 9 and got["score"].max() == 1.0
    assert licenses.spans(docs(spark, rows[-1:])).filter("label IS NOT NULL").count() == 2


def test_license_sql_counts_places_and_spans(spark, duck):
    rng = random.Random(6)
    talk = lambda n, every: " ".join("the software" if rng.randrange(every) == 0 else f"w{rng.randrange(500)}" for _ in range(n))
    mit, gpl = licenses.PASSAGES[0][1], licenses.PASSAGES[2][1]
    texts = [talk(n, every) for n in (300, 600) for every in (2, 4, 8, 12)] + ["the software " * 400, "Mit license \u212a MIT Licen\u017fe"]
    texts += [f"{talk(200, 4)} {mit} {talk(100, k)} {mit[:400]} {talk(200, 3)} {gpl}" for k in (2, 3, 5)] + [mit[40:600] + " other words " + mit[620:], gpl.replace("software", "the software")]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    duck.register("license_docs", pd.DataFrame(rows, columns=["doc_id", "text", "source"]))
    want = duck.execute(licenses_sql("license_docs")).df()
    got = licenses.scan(docs(spark, rows)).toPandas()
    key = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    want, got = (x[key].astype(object).where(x[key].notna(), None).sort_values("doc_id").values.tolist() for x in (want, got))
    assert [[round(v, 9) if isinstance(v, float) else v for v in r] for r in got] == [[round(v, 9) if isinstance(v, float) else v for v in r] for r in want]
    assert {r[6] for r in got} >= {"", "gpl,mit", "mit"}


# 4: chats

def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "<|end|>\n<|begin|>user<|text|>", "<\\|x <\\\\|", "<", "|end|>", "", None, "[\\/INST] \\ $1 \\E", "<<SYS>> <</SYS>>", "a<|", "漢字😀"]
    rows = [(c, i, role, t) for c, order in ((1, hard), (2, hard[::-1])) for i, (t, role) in enumerate(zip(order, ["user", "assistant", "assistant", "system", None, "us<|text|>er", "assistant", "user", "user", "assistant", "assistant"]))]
    rows += [(None, None, None, None), (3, 0, "assistant", "x"), (3, 0, "assistant", "x"), (4, 0, "user", "no answer")]
    turns = spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, t string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(turns)).collect()}
    for c in (1, 2, 3, 4, None):
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=lambda r: r[1] or 0)]
        assert [tuple(t) for t in got[c]["turns"]] == want
        assert got[c]["loss_text"] == "".join(t for role, t in want if role == "assistant")
    assert got[3]["formatted"].count("<|begin|>") == 1  # neighbours of one role are one block
    assert chat.format_chats(turns.limit(0)).count() == 0


# 5: lines


@pytest.mark.parametrize("turns_of_a_role", [1, 7, 5000])
def test_chat_of_many_turns_against_plain_python(spark, turns_of_a_role):
    roles = ["user", "assistant"]
    rows = [(1, t, roles[(t // turns_of_a_role + 1) % 2], "é\U0001f600\n" * (t % 5) + ("<|end|>" if t % 3 == 0 else "") + "x" * (3000 if t == 700 else 0))
            for t in range(2500)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    read = chat.read_back(chat.format_chats(turns)).first()
    assert [(x.role, x.text) for x in read.turns] == [(role, text) for _, _, role, text in rows]
    assert read.loss_text == "".join(text for _, _, role, text in rows if role == "assistant")


def test_line_spread(spark):
    foot = "This line stands on every site there is."
    rows = [(100 + i, f"own line number {i} of this document\n{foot}\nshort", f"s{i}") for i in range(8)] + [(120, f"{foot}", "s1"), (121, foot + "\n" + foot, None)]
    rows += [(130 + i, "A line on only four sites of all.", f"s{i % 4}") for i in range(9)]
    df = docs(spark, rows + odd())
    got = collected(lines.remove_spread_lines(df)).set_index("doc_id")
    assert list(got.columns)[-3:] == ["l_lines", "l_removed", "l_emptied"] and len(got) == len(rows) + 8
    assert got.loc[100, "text"] == rows[0][1] and got.loc[103, "text"] == "own line number 3 of this document\nshort"
    assert got.loc[120, "l_emptied"] and got.loc[121, "text"] == "" and got.loc[121, "l_removed"] == 2
    assert got.loc[130, "text"] == rows[10][1] and got.loc[130, "l_removed"] == 0
    assert lines.remove_spread_lines(df.limit(0)).count() == 0


def test_sketch_and_exact_agree_far_from_the_threshold(spark):
    rows = [(i * 1000 + k, f"line with a spread of {k} sites or so", f"site{i}") for k in (4, 5, 6, 40, 300) for i in range(k)]
    got = lines.spread(lines.lines(docs(spark, rows))).count()
    assert got == 4


# 6: vectors

def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1200, 20)).astype(np.float32)
    x[300:340] = x[7]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5050, [0.0] * 20), (5100, [float("nan")] + [1.0] * 19), (5150, [None] + [1.0] * 19), (5200, [float("inf")] * 20), (None, [1.0] * 20), (5250, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    got = vectors.nearest(df, F.col("vec_id") % 50 == 0).toPandas()
    d = x.astype(np.float64)
    n = np.sqrt((d * d).sum(1))
    hits = 0
    for q in range(0, 1200, 50):
        s = (d * d[q]).sum(1) / (n * n[q])
        s[q] = -9
        want = np.lexsort((np.arange(1200), -s))[:5]
        mine = got[got.query_id == q].sort_values("rank")
        hits += len(set(want) & set(mine.vec_id))
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5] and np.allclose(mine.score, s[mine.vec_id], atol=1e-12)
    assert hits >= 0.97 * 120 and set(got.query_id) == set(range(0, 1200, 50))
    assert vectors.nearest(df.filter("vec_id < 3"), F.col("vec_id") == 0).count() == 2
    assert vectors.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_vectors_in_blocks(spark, monkeypatch):
    x = np.random.default_rng(6).standard_normal((300, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    one = vectors.nearest(df, F.col("vec_id") % 10 == 0, sigmas=99.0).toPandas()
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 15)
    monkeypatch.setattr(vectors, "ROW_BLOCK", 80)
    monkeypatch.setattr(vectors, "PACK", 7)
    two = vectors.nearest(df, F.col("vec_id") % 10 == 0, sigmas=99.0).toPandas()
    key = ["query_id", "rank", "vec_id"]
    pd.testing.assert_frame_equal(one.sort_values(key)[key].reset_index(drop=True), two.sort_values(key)[key].reset_index(drop=True))


@pytest.mark.parametrize("kind, width", [("float", 4), ("double", 8)])
def test_vectors_travel_in_packs(spark, kind, width):
    x = np.random.default_rng(8).standard_normal((500, 40)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>").coalesce(1)
    dtype = f"<f{width}"
    packs = vectors.usable(df).mapInPandas(vectors.pack(200, dtype), vectors.PACKED).toPandas()
    assert packs["ids"].map(len).tolist() == [1600, 1600, 800]
    moved = sum(packs[c].map(len).sum() for c in ("ids", "vectors", "codes", "scalars"))
    assert moved == 500 * (8 + 40 * width + 8 + 8)
    ids, back, codes, scalar = vectors.unpack(packs.iloc[::-1], dtype)
    assert ids.tolist() == list(range(500)) and (back == x).all()
    unit = x / np.sqrt((x.astype(np.float64) ** 2).sum(1))[:, None]
    want, cosine = vectors.encode(unit.astype(np.float64), vectors.rotation(40))
    assert (codes == want).mean() > 0.99 and np.allclose(scalar, cosine)


# 7: pieces

@pytest.fixture(scope="module")
def model():
    tokenizers = pytest.importorskip("public_tokenizers")
    return pieces.PieceModel.load(tokenizers.path("piece_bpe_32k.model"))


def test_pieces_match_the_library(spark, model):
    import public_tokenizers
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdeth  \n\t▁éß漢😀\0<s></s>0A19.,") for _ in range(rng.randrange(60))) for _ in range(400)]
    rows = odd() + [(1000 + i, t, "s") for i, t in enumerate(texts)]
    got = pieces.encode(docs(spark, rows), model).toPandas()
    assert len(got) == len(rows)
    want = {i: t for i, t, _ in rows if i is not None}
    for r in got.dropna(subset=["doc_id"]).itertuples():
        text = want[int(r.doc_id)] or ""
        assert list(r.ids) == lib.encode(text, add_bos=True, add_eos=True)
        data = text.encode()
        spans = [(b, e) for b, e in zip(r.begins, r.ends)]
        assert b"".join(data[b:e] for b, e in spans) == data and all(b <= e for b, e in spans)
        assert all(p[1] == q[0] for p, q in zip(spans, spans[1:]))
    digest = pieces.encode(docs(spark, rows), model, digests=True).toPandas().dropna().set_index("doc_id")
    ids = lib.encode(texts[3], add_bos=True, add_eos=True)
    assert digest.loc[1003, "ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert digest.loc[1003, "decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    back = pieces.decode(spark.createDataFrame([(1, ids), (2, None)], "doc_id long, ids array<int>"), model).collect()
    assert [r["text"] for r in back] == [lib.decode(ids), ""]
    assert pieces.encode(docs(spark, []), model).count() == 0


def test_decode_of_any_ids(model):
    import public_tokenizers
    import sentencepiece

    lib, enc, rng = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), pieces.Encoder(model), random.Random(9)
    for _ in range(2000):
        ids = [rng.randrange(300 if rng.random() < 0.6 else 32000) for _ in range(10)]
        assert enc.decode(ids) == lib.decode(ids)


def test_longest_prefix_and_alignment(model):
    """A trie of "a" -> "x" and "ab" -> "yz" with units placed by hand: root at 0, its children around 256."""
    import dataclasses
    import struct

    units = [0] * 1024
    units[0] = 256 << 10
    a = 256 ^ ord("a")
    units[a] = (a ^ 512) << 10 | 1 << 8 | ord("a")
    units[512] = 1 << 31 | 0  # "x"
    b = 512 ^ ord("b")
    units[b] = (b ^ 768) << 10 | 1 << 8 | ord("b")
    units[768] = 1 << 31 | 2  # "yz"
    data = struct.pack("<1024I", *units)
    blob = struct.pack("<I", len(data)) + data + b"x\0yz\0"
    charmap = pieces.CharMap(blob)
    assert charmap.longest(b"abc", 0) == (2, b"yz") and charmap.longest(b"ac", 0) == (1, b"x") and charmap.longest(b"c", 0) is None
    enc = pieces.Encoder(dataclasses.replace(model, charmap=blob, trim=True))
    text, source = enc.normalise("  a  ab\u00e9 ")
    assert text == "▁x▁yzé" and source.tolist() == [2, 2, 2, 2, 3, 3, 3, 5, 5, 7, 8, 9]


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("trim, prefix, escape", [(True, True, True), (False, True, True), (True, False, False), (False, False, True)])
def test_normaliser_and_offsets_match_the_library(model, rule, trim, prefix, escape):
    """A compiled map of real size: the library's own rules, held against its normaliser and its offsets."""
    import dataclasses

    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    lib = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, escape_whitespaces=escape, remove_extra_whitespaces=trim)
    proto = pb.ModelProto()
    proto.ParseFromString(lib.serialized_model_proto())
    blob = proto.normalizer_spec.precompiled_charsmap
    assert len(blob) > 100_000
    enc = pieces.Encoder(dataclasses.replace(model, charmap=blob, trim=trim, dummy_prefix=prefix, escape=escape))
    rng = random.Random(14)
    parts = [" ", "  ", "\t", "\n", "\u3000", "\u00a0", "\u200b", "\u00ad", "\ufb01", "\u00bd", "\u338f", "\uff21", "e\u0301", "\u00e9\u0323", "\u1112\u1161\u11ab", "\ufdfa", "\uff76\uff9e", "\u2460",
             "\U0001d400", "\U0001f600", "\u2581", "a", "Z", "stra\u00dfe", "\u212a", "x\u0308\u0301", "\u0344", "\ufeff", "\x00", "\x7f"]
    for _ in range(600):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        normal, source = enc.normalise(text)
        want, offsets = lib.normalize(text, with_offsets=True)
        assert normal == want, text
        begins = np.cumsum([0, *(len(c.encode()) for c in normal)])
        places = {b: i for i, b in enumerate(np.cumsum([0, *(len(c.encode()) for c in text)]).tolist())}
        assert [places[int(source[b])] for b in begins] == list(offsets), text


def test_plain_road_is_the_map_road(model):
    """The shortcut for a model without a map against the walk that other texts take."""
    walk = pieces.Encoder(model)
    assert walk.plain
    walk.__dict__["plain"] = False
    rng, short = random.Random(15), pieces.Encoder(model)
    for _ in range(500):
        text = "".join(rng.choice("ab  \n\u00e9\u6f22\U0001f600\u2581\0") for _ in range(rng.randrange(30)))
        (a, at), (b, bt) = short.normalise(text), walk.normalise(text)
        assert a == b and at.tolist() == bt.tolist()


# 8: near duplicates

def brute_components(rows, n=5):
    sets = []
    for _, t, _ in rows:
        w = SPACE.findall((t or "").translate(neardup.LOWER))
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    root = {i: i for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and both and 100 * both >= 85 * len(sets[i] | sets[j]):
                a, b = find(rows[i][0]), find(rows[j][0])
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for (i, _, _), s in zip(rows, sets)}


def near_rows():
    rng = random.Random(12)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(160):  # a group with distances on both sides of the threshold
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "s"))
    passage = " ".join(f"p{k}" for k in range(60))
    rows += [(300 + i, f"{passage} " + " ".join(f"q{i}-{k}" for k in range(90)), "s") for i in range(40)]
    rows += [(400 + i, "Same  text\nhere AND there for all of us", "s") for i in range(30)] + [(500, "a b", "s"), (501, "A\tB", "s"), (502, "a b c", "s"), (503, "", "s"), (504, None, "s")]
    return rows


@pytest.mark.parametrize("short, block", [(24, 1024), (4, 30), (4, 7)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, short, block):
    monkeypatch.setattr(neardup, "SHORT_LIST", short)
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = near_rows()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_long_lists_move_in_step_with_their_size(spark, monkeypatch):
    """Near copies of one text: rows that meet in blocks double when the group does."""
    monkeypatch.setattr(neardup, "BLOCK", 40)
    moved = []
    run = neardup.compare_blocks, neardup.compare_pivots
    for size in (400, 800):
        seen = spark.sparkContext.accumulator(0)

        def counting(f, seen=seen):
            def call(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
                seen.add(len(pdf))
                return f(key, pdf)
            return call
        monkeypatch.setattr(neardup, "compare_blocks", counting(run[0]))
        monkeypatch.setattr(neardup, "compare_pivots", counting(run[1]))
        base = [f"w{k}" for k in range(300)]
        rows = [(i, " ".join(base[:150] + [f"x{i}"] + base[150:]), "s") for i in range(size)]
        rows += [(5000 + i, " ".join(base[:150] + [f"y{i}{k}" for k in range(90)] + base[150:]), "s") for i in range(3)]
        found = neardup.near_duplicates(docs(spark, rows)).collect()
        assert {r["component_id"] for r in found if r["doc_id"] < 5000} == {0}
        assert all(r["component_id"] == r["doc_id"] for r in found if r["doc_id"] >= 5000)
        moved.append(seen.value)
    assert 0 < moved[1] < 2.6 * moved[0], moved


def test_near_duplicates_odd_rows(spark):
    df = docs(spark, odd())
    got = collected(neardup.near_duplicates(df))
    assert len(got) == 8 and got[got.doc_id.isna()].component_id.isna().all()
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns and kept.count() == 8
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_a_text_is_not_dropped_for_its_id(spark):
    text = "one two three four five six seven"
    rows = [(1, text, "s"), (2, text, "t"), (2, "quite another text of some more words here", "t"), (3, None, "s"), (2, None, "s")]
    kept = neardup.keep_one(docs(spark, rows))
    assert sorted(((r.doc_id, r.text, r.source) for r in kept.collect()), key=repr) == sorted([rows[0], rows[2], rows[3], rows[4]], key=repr)


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for p in pairs if p[0] != p[1] for x in p}


# 9: quality

def brute_quality(text):
    text = text or ""
    w = SPACE.findall(text)
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    twice = {x for x in windows if windows.count(x) > 1} if len(windows) < 5000 else set()
    covered = {i + k for i, x in enumerate(windows) if x in twice for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_quality_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice(["a ", "b ", "c\n", "the ", "of\t", "#", "x|y ", "é😀 "]) for _ in range(rng.randrange(120))), "s") for i in range(150)]
    rows += [(900, "one two three four five " * 9, "s"), (901, "a b c d e f a b c d e g h i j k l m n o p q r s t u v w x y z", "s")] + odd()[:7]
    got = collected(quality.judge(quality.measures(docs(spark, rows))))
    mine = sorted(got[["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]].itertuples(index=False, name=None), key=repr)
    assert mine == sorted([(i, *brute_quality(t)) for i, t, _ in rows], key=repr)
    assert not (got.kept.astype(bool) & got.base_failed.astype(bool)).any()
    clean = docs(spark, [(1, "The quick brown fox of the old farm is in the yard, and it was with us for a day by the river bank.\nThat is all.", "s")])
    assert quality.judge(quality.measures(clean)).first()["kept"]
    more = docs(spark, [(1, "Быстрая лиса старой фермы была сегодня во дворе и видела нас весь день у самого берега широкой тихой реки а потом ушла домой", "s"),
                        (2, "Nothing useful here because every single sentence avoids ordinary little words entirely whatever somebody might actually expect seeing inside longer English passages", "s"),
                        (3, " ".join(f"the word{i}" for i in range(120_000)), "s")])
    assert {r["doc_id"]: r["kept"] for r in quality.judge(quality.measures(more)).collect()} == {1: True, 2: False, 3: True}
    assert quality.measures(docs(spark, [])).count() == 0


# 10: pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header><a href=/>Site</a></header><nav><ul><li><a href="/a">A</a></ul></nav>
<div class="top">Welcome to our host</div><div class="body"><h1>Head {0}</h1><p>First &lt;b&gt; of {0}<br>line<p>Second   <b>bo</b>ld&nbsp;{0}</div><div class="links"><a href=x>more {0}</a> <a href=y>less {0}</a></div>
<div id="comments"><p>I agree</p></div><script>var t="</p>";</script><footer>&copy; {0}</footer></body></html>"""


def test_pages(spark):
    rows = [(i, f"https://Host.example/{i}?x", PAGE.format(i)) for i in range(6)]
    rows += [(10, "http://one.example", "<body><nav>n</nav><article><h1>A</h1><p>B <i>c</i>d<div class=ad>buy</div><aside>s</aside><ul><li>x<li>y</ul></article>tail"), (11, None, None), (12, "u", ""),
             (13, "http://one.example", "plain & simple < text"), (13, "http://one.example", "plain & simple < text"), (None, "http://one.example", "<p>x" + "y" * 50_000), (14, "http://m.example", "<div>no</div><main><p>yes</main>")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, host string")
    got = collected(pages.extract(df))
    assert len(got) == len(rows)
    by = got.dropna(subset=["page_id"]).set_index("page_id")["text"]
    assert by.loc[3] == "Head 3\nFirst <b> of 3 line\nSecond bold 3"
    assert by.loc[10] == "A\nB cd\nx\ny" and by.loc[11] == "" and by.loc[12] == "" and by.loc[13].tolist() == ["plain & simple < text"] * 2 and by.loc[14] == "yes"
    assert pages.extract(df.limit(0)).count() == 0
    found = pages.templates(df).filter("host = 'host.example'").toPandas()
    assert len(found) > 10 and (found.token == "/html/body/div.body").sum() == 1
    inner = found[found.token == "/html/body/div.body/h1"].iloc[0]
    assert inner["parent"] == found[found.token == "/html/body/div.body"].iloc[0]["class"]


@pytest.mark.parametrize("begin, end", [("<div class='content has-sidebar'>", "</div>"), ("<div class='layout no-sidebar'>", "</div>"), ("<div id='page' class='header-fixed'>", "</div>"),
                                        ("<div class='post tag-linux'>", "</div>"), ("<div class='has-sidebar'><article>", "</article></div>"), ("<article class='post category-advice'>", "</article>"), ("<article class='author-adam'>", "</article>")])
def test_names_leave_the_main_text(begin, end):
    page = f"<body><nav>menu</nav>{begin}<p>{'Long words of a post. ' * 9}</p><p>More.</p><div class='tags'>linux</div><div class=ad>buy</div>{end}<div class='sidebar'>{'side ' * 9}</div></body>"
    assert pages.main_text(pages.parse(page)) == ("Long words of a post. " * 9).strip() + "\nMore."


def test_names_of_many_elements_and_of_articles():
    posts = "".join(f"<div class='post tag-t{i}'><p>post {i} of the list</p></div>" for i in range(9))
    assert pages.main_text(pages.parse(f"<body>{posts}<div class=ad>buy</div></body>")) == "\n".join(f"post {i} of the list" for i in range(9))
    assert pages.main_text(pages.parse("<div class=has-sidebar><article><p>The main article</p><article class='comment'>I agree</article></article></div><div class=related><article>Other</article></div>"
                                       f"<div class=links><p>{'x' * 99}</p></div>")) == "The main article"


def test_templates_judge_articles_too(spark):
    page = "<body><div class=x>Top</div><{0}><p>Read this first</p><h1>Head {1}</h1><p>Text {1}</p><div class=more><a href=1>Next {1}</a></div><p>All rights reserved</p></{0}></body>"
    rows = [(i, f"http://{tag}.example/{i}", page.format(tag, i)) for tag in ("article", "main") for i in range(5)]
    rows += [(90 + i, "http://same.example", f"<body><article><p>One text</p></article><!-- {i} --></body>") for i in range(4)]
    got = collected(pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")))
    assert sorted(got["text"]) == sorted([f"Head {i}\nText {i}" for i in range(5)] * 2 + ["One text"] * 4)


def test_templates_of_layouts(spark):
    a = "<body><div class=post><div class=hint><p>Please read on</p></div><p>Post {0}</p><div class=go><a href=1>Go {0}</a></div></div></body>"
    b = "<body><table class=list><tr><td class=t>Our list<td class=e>Entry {0}</table></body>"
    rows = [(i, f"http://two.example/{i}", (a, b)[i % 2].format(i)) for i in range(10)] + [(10 + i, "http://few.example", a.format(i)) for i in range(2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    by = collected(pages.extract(df)).set_index("page_id")["text"]
    assert [by.loc[i] for i in range(10)] == [("Post", "Entry")[i % 2] + f" {i}" for i in range(10)]
    assert by.loc[10] == "Please read on\nPost 0\nGo 0"
    found = pages.classes(df).filter("kind = 'tag'").toPandas().set_index("token")
    assert found.loc["/body/div.post/div.hint", "pages"] == 5


def test_unclosed_and_quoted_elements_keep_the_text():
    text = lambda x: pages.main_text(pages.parse(x))
    assert text("<article><p>Before</p><video src=x controls><p>After the video</p></article>") == "Before\nAfter the video"
    assert text("<article><p>Before</p><video src=x>no player</video><audio><source src=y></audio><p>After</p></article>") == "Before\nAfter"
    assert text("<article><p>The sum <math><mi>x</mi></math> is five</p><xmp>if a < b & c</xmp></article>") == "The sum x is five\nif a < b & c"
    assert text("<article><object><object>in</object>still in</object><p>Out</p><svg><title>t</title><text>no</text></svg></article>") == "Out"
    assert text("<article><p>One<svg/> two<canvas></p><p>Three</p></article>") == "One two\nThree"


def brute_template(rows):
    """Which blocks and slots of a host's pages its template takes, by plain counting over the pages of one host."""
    parsed = {html: pages.parse(html) for _, _, html in rows}
    holds, runs, slots = {}, {}, {}
    for html, page in parsed.items():
        for path, (n, _) in page.tags.items():
            holds.setdefault(path, {})[html] = n
        free = [r for r in page.runs if not r.outside]
        for path, text in pages.blocks(free):
            runs.setdefault((path, text), {}).setdefault(html, 0)
            runs[path, text][html] += 1
        for r in free:
            n = len("".join(r.text.split()))
            if n:
                s = slots.setdefault(r.path, {}).setdefault(html, [0, 0])
                s[0] += n
                s[1] += n * r.link
    everywhere = dict.fromkeys(parsed, 1)
    vector = lambda held: frozenset(held.items())
    tokens = [("tag", t, pages.element(t.rsplit("/", 1)[0]), vector(h)) for t, h in holds.items()]
    tokens += [("run", k, pages.element(k[0]), vector(h)) for k, h in runs.items()] + [("slot", p, pages.element(p), vector(dict.fromkeys(h, 1))) for p, h in slots.items()]
    most = lambda around, v: len(v) >= pages.LEAST_PAGES and len(v) >= pages.SHARE * len(holds.get(around, everywhere))
    valid = {v for _, _, around, v in tokens if most(around, v)}
    linked = {p for p, h in slots.items() if sum(k for _, k in h.values()) >= pages.LINKS * sum(c for c, _ in h.values())}
    return {html: pages.main_text(page, frozenset(pages.slot_key(p) for k, p, _, v in tokens if k == "slot" and p in linked and v in valid),
                                  frozenset(pages.run_key(*r) for k, r, _, v in tokens if k == "run" and v in valid)) for html, page in parsed.items()}


@pytest.mark.parametrize("hot_share", [500, 2])
def test_templates_against_plain_counting(spark, monkeypatch, hot_share):
    monkeypatch.setattr(pages, "SALTED", hot_share)
    rng = random.Random(9)
    rows = []
    for host in "abc":
        for i in range(14 if host == "a" else 7):
            bits = ["<div class=note><p>Please log in</p></div>" if rng.random() < 0.5 else "", f"<article><h1>Title {rng.randrange(99)}</h1>" if host == "b" else "<div class=text>",
                    "".join(f"<p>words {rng.randrange(5)} of <a href=x>page</a> {i}</p>" for _ in range(rng.randrange(4))), "<p>All rights</p>" if rng.random() < 0.7 else "",
                    "<div class=more>" + "".join(f"<a href={k}>link {rng.randrange(9)}</a> " for k in range(3)) + "</div>" if rng.random() < 0.8 else "", "</article>" if host == "b" else "</div>"]
            html = f"<body><div class=top>Site {host}</div>{''.join(bits)}<div class='end/x'>bye</div></body>"
            rows += [(len(rows) + k, f"http://{host}.example/{i}", html) for k in range(1 if rng.random() < 0.7 else 3)]
    got = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {}
    for host in "abc":
        own = [r for r in rows if f"//{host}." in r[1]]
        told = brute_template(own)
        want |= {i: told[html] for i, _, html in own}
    assert got == want and len({t for t in want.values()}) > 10


# the pipeline

def test_pipeline_stages_keep_the_columns_of_documents(spark, tmp_path):
    import corpus_pipeline
    from isohypsa.staging import stage

    src = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{src}/documents.parquet")
    for name, apply in corpus_pipeline.STAGES[:-1]:
        after = stage(apply(spark, docs, src), "t")
        assert after.dtypes == docs.dtypes, name
        assert after.select("doc_id").distinct().join(docs, "doc_id", "left_anti").isEmpty()
        if name == "near_duplicates":
            left = neardup.near_duplicates(after)
            assert left.filter("doc_id <> component_id").isEmpty()
        docs = after
    got = corpus_pipeline.run(spark, src)
    assert got.columns == ["doc_id", "n_tokens", "ids"] and got.count() == docs.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "mixing", "sentencepiece"]
    empty = spark.read.parquet(f"{src}/documents.parquet").limit(0)
    for _, apply in corpus_pipeline.STAGES:
        assert apply(spark, empty, src).count() == 0


def brute_lines(rows):
    """doc_id to the text without lines that stand on five sources or more, but for their first place; without texts that this empties."""
    from isohypsa.llm.common import SPACES

    at = {}
    for i, t, s in rows:
        for no, line in enumerate((t or "").split("\n")):
            if len(line.strip(SPACES)) >= 20:
                at.setdefault(line.strip(SPACES), []).append((i, no, s or ""))
    away = {p[:2] for places in at.values() if len({s for _, _, s in places}) >= 5 for p in sorted(places)[1:]}
    out = {}
    for i, t, _ in rows:
        left = None if t is None else "\n".join(x for no, x in enumerate(t.split("\n")) if (i, no) not in away)
        if left == t or left.strip(SPACES):
            out[i] = left
    return out


def test_pipeline_against_plain_python(spark):
    """Each stage on what the one before kept; what the first one keeps is what scores under 0.5. Made rows join after it, as its model has seen nothing like them."""
    import corpus_pipeline
    import public_tokenizers
    import sentencepiece

    from isohypsa.staging import stage

    src, rng = "/root/testdata/sf0.001", random.Random(21)
    given = spark.read.parquet(f"{src}/documents.parquet").dropDuplicates(["doc_id"]).filter("doc_id IS NOT NULL")
    common = [f"Line number {k} that many of these sites have in common" for k in range(6)]
    base = [f"word{rng.randrange(900)}" for _ in range(90)]
    extra = []
    for i in range(120):
        w = list(base) if i % 3 else [f"other{rng.randrange(900)}" for _ in range(90)]
        for _ in range(rng.randrange(4)):
            w[rng.randrange(90)] = f"x{rng.randrange(10**6)}"
        at = rng.randrange(1, 89)
        extra.append((100_000 + i, "\n".join([" ".join(w[:at]), *rng.sample(common, rng.randrange(3)), " ".join(w[at:])]) if i % 11 else common[i % 6], f"site{rng.randrange(9)}"))
    more = spark.createDataFrame(extra, "doc_id long, text string, source string").withColumn("lang", F.lit("en")).withColumn("n_chars", F.char_length("text"))
    docs, more = stage(given, "t"), more.select(*[F.col(f.name).cast(f.dataType) for f in given.schema])
    steps = dict(corpus_pipeline.STAGES)
    rows = lambda df: [(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").orderBy("doc_id").collect()]
    clean = stage(steps["toxicity"](spark, docs, src), "t")
    model = toxicity.train(docs, spark.read.parquet(f"{src}/labels.parquet"))
    scored = docs.select("doc_id", toxicity.score(F.col("text"), model).alias("score")).collect()
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in scored if r.score < 0.5}
    clean = stage(clean.unionByName(more), "t")
    lined = stage(steps["line_dedup"](spark, clean, src), "t")
    want = brute_lines(rows(clean))
    assert {i: t for i, t, _ in rows(lined)} == want and len(want) < clean.count() and any(want[i] != t for i, t, _ in rows(clean) if i in want)
    single = stage(steps["near_duplicates"](spark, lined, src), "t")
    groups = brute_components(rows(lined))
    assert rows(single) == [r for r in rows(lined) if groups[r[0]][1] == r[0]] and single.count() < lined.count() - 40
    mixed = stage(steps["mixing"](spark, single, src), "t")
    size = {i: len(SPACE.findall(t or "")) for i, t, _ in rows(single)}
    by = {}
    for i, _, s in rows(single):
        by.setdefault(s, []).append(i)
    total = {s: sum(size[i] for i in ids) for s, ids in by.items()}
    goal, taken = water_filled(total), {i: 0 for i in size}
    for i, _, _ in rows(mixed):
        taken[i] += 1
    assert set(rows(mixed)) <= set(rows(single)) and max(taken.values()) <= 3
    for s, ids in by.items():
        assert abs(sum(taken[i] * size[i] for i in ids) - goal[s]) <= max(size[i] for i in ids)
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = sorted((r.doc_id, r.n_tokens, list(r.ids)) for r in steps["sentencepiece"](spark, mixed, src).collect())
    ids = {i: lib.encode(t or "", add_bos=True, add_eos=True) for i, t, _ in rows(mixed)}
    assert got == sorted((i, len(ids[i]), ids[i]) for i, _, _ in rows(mixed))
