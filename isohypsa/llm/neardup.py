"""Near-duplicate documents by an inverted join over MinHash coordinates.

Texts with the same set of word shingles are one class. Each class has a signature of COORDINATES minima and is posted under
coordinate-value pairs. Two sets of the wanted similarity agree in at least MATCHES coordinates (but for odds of 2.4 in
a million at the threshold itself, less for nearer pairs), so in any common order of all pairs they share one of the
first COORDINATES - MATCHES + 1 of each: only that prefix, the rarest pairs first, is joined. Pairs that one class alone has
fill the prefix without being posted, so texts that share a passage but little else meet nowhere.

Short lists are joined to pairs of classes, which count their collisions over the whole signature; what reaches MATCHES is
confirmed on the full sets. Long lists, of groups of many copies, are compared as matrices in blocks, and only the components
they form leave the task, never all pairs. A list of several blocks first meets PIVOTS of its own classes: those that link with the
best of them are one component already, so only the others are still compared with each other and with these. What moves
grows with the list, and with its square only as far as classes link with no pivot.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohypsa.llm.graph import components
from isohypsa.staging import stage

WORDS, SIMILAR = 5, 85
#: 64 minima; a pair with a similarity of 0.85 agrees in 54 of them on average, with a deviation of 2.9.
COORDINATES, MATCHES = 64, 40
PREFIX = COORDINATES - MATCHES + 1
#: Classes of a list up to which all of its pairs become rows, and classes of a block beyond that.
SHORT_LIST, BLOCK = 24, 1024
#: Classes of a list of several blocks that all of its classes are compared with first.
PIVOTS = 8
#: Parts into which the rows of a long list are dealt where its key alone would bring them to one task.
SALTS = 32
SET = "n_shingles long, set1 long, set2 long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
_rng = np.random.default_rng(20240601)
SALT, FACTOR = (_rng.integers(0, 2**64, COORDINATES, dtype=np.uint64) for _ in range(2))
FACTOR |= np.uint64(1)
STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def class_node() -> Column:
    """A class, by 64 bits of its set."""
    return F.xxhash64("n_shingles", "set1", "set2")


def shingles(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; of the whole sequence if it is shorter than one."""
    found = WORD.findall(text.translate(LOWER)) if text else []
    if not found:
        return np.empty(0, np.uint64)
    h = pd.util.hash_array(np.array(found, dtype=object), categorize=False)
    n = min(WORDS, len(h))
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        out = (out ^ h[k:len(h) - n + 1 + k]) * STEP[k]
        out ^= out >> np.uint64(31)
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    """The minima as 32-bit integers."""
    low = np.full(COORDINATES, 2**64 - 1, np.uint64)
    for at in range(0, len(s), 4096):
        low = np.minimum(low, ((s[at:at + 4096, None] ^ SALT) * FACTOR).min(0))
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def fingerprint(sets: list[np.ndarray]) -> dict[str, list[int]]:
    """The size of each set and 128 bits of its content."""
    mixed = [s * STEP[0] for s in sets]
    return {"n_shingles": [len(s) for s in sets], "set1": [int(s.sum(dtype=np.uint64).view(np.int64)) for s in sets],
            "set2": [int((m ^ (m >> np.uint64(29))).sum(dtype=np.uint64).view(np.int64)) for m in mixed]}


def profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        sets = [shingles(t) for t in b["text"]]
        yield pd.DataFrame({c: b[c] for c in b.columns if c != "text"} | fingerprint(sets) | {"sig": [signature(s).tobytes() if len(s) else None for s in sets]})


def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in (batch.iloc[at:at + 256] for batch in batches for at in range(0, len(batch), 256)):
        sets = [shingles(t) for t in b["text"]]
        yield pd.DataFrame(fingerprint(sets) | {"shingles": [s.view(np.int64) for s in sets]})


def linked(sigs: tuple[np.ndarray, np.ndarray], sets: tuple[list[np.ndarray], list[np.ndarray]]) -> np.ndarray:
    """Which rows of one block link with which of another: collisions first, then full sets, counted as a product of matrices."""
    hits = np.zeros((len(sigs[0]), len(sigs[1])), np.uint8)
    for c in range(COORDINATES):
        hits += sigs[0][:, c, None] == sigs[1][None, :, c]
    rows, cols = np.flatnonzero((hits >= MATCHES).any(1)), np.flatnonzero((hits >= MATCHES).any(0))
    out = np.zeros(hits.shape, bool)
    if not len(rows):
        return out
    a, b = [sets[0][i] for i in rows], [sets[1][i] for i in cols]
    vocabulary = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)), assume_unique=True)
    common = np.zeros((len(rows), len(cols)), np.float32)
    for at in range(0, len(vocabulary), 8192):
        part = vocabulary[at:at + 8192]
        common += member(a, part) @ member(b, part).T
    total = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :] - common
    out[np.ix_(rows, cols)] = (100 * common >= SIMILAR * total) & (hits[np.ix_(rows, cols)] >= MATCHES)
    return out


def member(sets: list[np.ndarray], vocabulary: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(vocabulary)), np.float32)
    for i, s in enumerate(sets):
        at = np.searchsorted(vocabulary, s)
        at = at[at < len(vocabulary)] if len(at) and at[-1] >= len(vocabulary) else at
        out[i, at[vocabulary[at] == s[:len(at)]]] = 1
    return out


def roots(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest member of each of n places' components."""
    root = np.arange(n)
    pairs = [p for p in links if len(p[0])]
    while pairs:
        before = root.copy()
        for a, b in pairs:
            low = np.minimum(root[a], root[b])
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def compare_pivots(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The classes of one block of a list that link with its pivots."""
    node, is_pivot = pdf["node"].to_numpy(), pdf["is_pivot"].to_numpy(bool)
    sig = np.stack([np.frombuffer(x, np.int32) for x in pdf["sig"]])
    sets = [np.asarray(x).view(np.uint64) for x in pdf["shingles"]]
    i, j = np.flatnonzero(~is_pivot), np.flatnonzero(is_pivot)
    x, y = np.nonzero(linked((sig[i], sig[j]), ([sets[k] for k in i], [sets[k] for k in j])))
    return pd.DataFrame({"key": key[0], "block": key[1], "node": node[i[x]], "pivot": node[j[y]]})


def compare_blocks(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Links (a, b) that join the components of two blocks of a list: one per class that is not the smallest of its component."""
    pdf = pdf.sort_values("node", kind="stable")
    node = pdf["node"].to_numpy()
    sig = np.stack([np.frombuffer(x, np.int32) for x in pdf["sig"]])
    sets = [np.asarray(x).view(np.uint64) for x in pdf["shingles"]]
    i, j = (np.flatnonzero((pdf["block"] == k).to_numpy()) for k in key[-2:])
    links = linked((sig[i], sig[j]), ([sets[k] for k in i], [sets[k] for k in j]))
    x, y = np.nonzero(links)
    root = roots(len(node), [(i[x], j[y])])
    away = root != np.arange(len(node))
    return pd.DataFrame({"a": node[away], "b": node[root[away]]})


def posted(classes: DataFrame) -> DataFrame:
    """node, key of every class's prefix: its rarest coordinate-value pairs, of those that other classes have too."""
    coordinate = F.sequence(F.lit(0), F.lit(COORDINATES - 1))
    each = classes.select("node", F.explode(F.transform(coordinate, lambda c: F.xxhash64(c, F.substring("sig", c * 4 + 1, F.lit(4))))).alias("key"))
    common = each.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1")
    listed = each.join(common, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("keys"))
    few = F.slice("keys", 1, F.greatest(F.size("keys") - (COORDINATES - PREFIX), F.lit(0)))
    return listed.select("node", F.explode(few).alias("k")).select("node", "k.key")


def text_key() -> list[Column]:
    """128 bits of a row's text."""
    return [F.xxhash64("text").alias("near_text1"), F.xxhash64(F.lit("text"), "text").alias("near_text2")]


def near_duplicates(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable over links, itself included), one row per row of docs; if keyed, with near_text1 and near_text2,
    which tell rows of one id apart.

    Documents without words have no shingles and are linked with nothing; rows with a null doc_id are linked with nothing either and have a null
    component. Repeated rows are one class; rows of one id with other texts are judged by their own text. An empty table gives no rows; other
    columns are not looked at."""
    key, key_schema = (text_key(), "near_text1 long, near_text2 long, ") if keyed else ([], "")
    profiles = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *key, "text").mapInPandas(profile, f"doc_id long, {key_schema}{SET}, sig binary")
    rows = stage(profiles.withColumn("node", F.when(F.col("n_shingles") > 0, class_node())), "shingle-profiles")
    full = rows.filter(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
    classes = stage(full.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.any_value("sig").alias("sig")), "shingle-classes")
    post = stage(posted(classes), "postings")
    lists = stage(post.groupBy("key").agg(F.count("*").alias("size"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who")).filter("size > 1"), "lists")
    alike = lists.groupBy("size", "who").agg(F.min("key").alias("key"))  # lists of the same classes count once
    short = post.join(alike.filter(F.col("size") <= SHORT_LIST).select("key"), "key")
    pairs = short.alias("x").join(short.alias("y"), "key").filter("x.node < y.node").select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    sig = lambda name, to: classes.select(F.col("node").alias(name), F.col("sig").alias(to))
    matched = stage(pairs.join(sig("a", "sa"), "a").join(sig("b", "sb"), "b").filter(collisions("sa", "sb") >= MATCHES).select("a", "b"), "matches")
    salted = alike.filter(F.col("size") > SHORT_LIST).select("key", "size", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    long = post.withColumn("salt", F.pmod(F.xxhash64("node", F.lit("salt")), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"])
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    long = stage(long.select("key", "node", blocks.alias("blocks"), F.pmod(F.xxhash64("node", F.lit("block")), blocks).cast("int").alias("block")), "long-lists")
    wanted = matched.select(F.explode(F.array("a", "b")).alias("node")).unionByName(long.select("node")).distinct()
    chosen = stage(full_sets(docs, classes.join(wanted, "node")), "shingle-sets")
    found = stage(confirmed(matched, chosen).unionByName(block_links(long, chosen)), "near-links")
    parts = components(found)
    low = classes.join(parts, "node").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = parts.join(low, "component").select(F.col("node"), "component_id").unionByName(
        classes.join(parts, "node", "left_anti").select("node", F.col("doc_id").alias("component_id")))
    out = rows.join(named, "node", "left")
    return out.select("doc_id", *(["near_text1", "near_text2"] if keyed else []), "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def collisions(a: str, b: str) -> Column:
    """Coordinates in which two signatures agree."""
    at = F.sequence(F.lit(0), F.lit(COORDINATES - 1))
    return F.size(F.filter(at, lambda c: F.substring(F.col(a), c * 4 + 1, F.lit(4)) == F.substring(F.col(b), c * 4 + 1, F.lit(4))))


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, sig, shingles of the wanted classes, from the texts of their smallest ids."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = texts.select("text").mapInPandas(sets_of, f"{SET}, shingles array<long>").select(class_node().alias("node"), "shingles")
    return sets.groupBy("node").agg(F.any_value("shingles").alias("shingles")).join(wanted.select("node", "sig"), "node")


def confirmed(matched: DataFrame, chosen: DataFrame) -> DataFrame:
    one = lambda name, to: chosen.select(F.col("node").alias(name), F.col("shingles").alias(to))
    both = matched.join(one("a", "ta"), "a").join(one("b", "tb"), "b").select("a", "b", F.size(F.array_intersect("ta", "tb")).alias("both"), (F.size("ta") + F.size("tb")).alias("n"))
    return both.filter(100 * F.col("both") >= SIMILAR * (F.col("n") - F.col("both"))).select("a", "b")


def pivot_links(many: DataFrame, chosen: DataFrame) -> DataFrame:
    """key, block, node, pivot: the classes of each list that link with the best of its pivots, itself included. The best is the one with most links."""
    part = F.pmod(F.xxhash64("node", F.lit("pivot")), F.lit(PIVOTS))
    pivots = many.groupBy("key", part.alias("part")).agg(F.min("node").alias("node"), F.max("blocks").alias("blocks"))
    pivots = pivots.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "node", F.lit(True).alias("is_pivot"))
    members = many.select("key", "block", "node", F.lit(False).alias("is_pivot"))
    met = members.unionByName(pivots).join(chosen, "node").groupBy("key", "block")
    met = stage(met.applyInPandas(compare_pivots, "key long, block int, node long, pivot long"), "pivot-links")
    best = met.groupBy("key", "pivot").agg(F.count("*").alias("n"), F.max("block").alias("last")).groupBy("key").agg(
        F.max_by("pivot", F.struct("n", "pivot")).alias("pivot"), F.max("last").alias("last"))
    return met.join(in_blocks(best, "last"), ["key", "block", "pivot"])


def in_blocks(lists: DataFrame, last: str) -> DataFrame:
    """A row per block of every list, so that rows of a list are met block by block and not in one task."""
    return lists.withColumn("block", F.explode(F.sequence(F.lit(0), last))).drop(last)


def block_links(long: DataFrame, chosen: DataFrame) -> DataFrame:
    """Links (a, b) within the lists. Of lists of several blocks, classes that link with the best pivot are dealt into blocks below 0, the others into
    blocks from 0 on, and blocks below 0 are not compared with each other."""
    many = long.filter("blocks > 1")
    core = stage(pivot_links(many, chosen), "cores")
    split = many.select("key", "block", "node").join(core.select("key", "node", F.lit(True).alias("core")), ["key", "node"], "left")
    inside = F.coalesce("core", F.lit(False))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = split.groupBy("key").agg(blocks(F.count("core")).alias("cores"), blocks(F.count("*") - F.count("core")).alias("others"), F.max("block").alias("last"))
    dealt = lambda n: F.pmod(F.xxhash64("node", F.lit("split")), n).cast("int")
    rest = split.join(in_blocks(sizes.filter("others > 0"), "last"), ["key", "block"]).select(
        "key", "node", F.when(inside, -1 - dealt(F.col("cores"))).otherwise(dealt(F.col("others"))).alias("block"),
        F.sequence(F.when(inside, 0).otherwise(-F.col("cores")), F.col("others") - 1).alias("partners"))
    whole = long.filter("blocks = 1").select("key", "node", "block", F.array(F.lit(0)).alias("partners"))
    met = whole.unionByName(rest).join(chosen, "node").withColumn("other", F.explode("partners"))
    met = met.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "sig", "shingles")
    joined = core.filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    return met.groupBy("key", "i", "j").applyInPandas(compare_blocks, "a long, b long").unionByName(joined)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs whose id is the smallest of its group, columns as they are. Rows are told by id and text, so that one of several texts of an id goes
    without the others. Rows with a null id stay."""
    away = near_duplicates(docs, keyed=True).filter("doc_id <> component_id").select(F.col("doc_id").alias("away"), "near_text1", "near_text2").distinct()
    text1, text2 = text_key()
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", text1, text2)
    kept = rows.join(away, (rows["doc_id"] == away["away"]) & (rows["near_text1"] == away["near_text1"]) & (rows["near_text2"] == away["near_text2"]), "left_anti")
    return kept.select("row.*")
