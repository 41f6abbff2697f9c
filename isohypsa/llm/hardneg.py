"""Hard negatives by an STR-packed R-tree.

Components become whole numbers, and the score of a row is its inner product with the anchor. Rows of one label are packed by sort-tile-recursive: sorted by the first
component and cut into slabs, each slab sorted by the second and cut into tiles (global range sorts, ties by id, so that copies of one vector are cut like others);
inside a tile one task goes on down to leaves. Every node has the box that bounds its rows, and a box gives an interval of the inner product, component by component.

Upper nodes are tables: anchors go down by joins, from labels to slabs to tiles, and only to nodes whose interval can hold what they look for. Inside a tile a queue takes the
box with the highest bound first and leaves out boxes outside of the score windows or strictly below the k-th score found. Tiles stay
one row each and are copied only for the blocks of anchors that reach them.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isohypsa.staging import stage

#: Components that a tile and a block of anchors hold; rows of a leaf and children of a node.
TILE_CELLS, BLOCK_CELLS, LEAF, FANOUT = 1 << 20, 1 << 20, 128, 8
CLASS = ["dim", "label"]
SLAB = [*CLASS, "slab"]
TILE = [*SLAB, "tile"]
TREE = "dim int, label int, slab long, tile long, low array<long>, high array<long>, ids binary, rows binary, nodes binary, boxes binary"
HITS = "anchor long, wanted long, vec_id long, score long"


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, dim, v (whole components) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.size("embedding").alias("dim"), F.transform(x, lambda c: F.floor(scale * c)).alias("v"))


def numbered(rows: DataFrame, group: list[str], by: Column, name: str) -> DataFrame:
    """rows with at: their place from 0 in their group by a value, then id. Ranges are numbered side by side; only counts per range and group are put in order."""
    order = [F.col("by"), F.col("vec_id"), F.xxhash64("v")]
    dealt = stage(rows.withColumn("by", by).repartitionByRange(*[F.col(g) for g in group], *order).withColumn("part", F.spark_partition_id()), name)
    counts = dealt.groupBy(*group, "part").agg(F.count("*").alias("n"))
    before = counts.select(*group, "part", (F.sum("n").over(Window.partitionBy(*group).orderBy("part")) - F.col("n")).alias("before"))
    within = Window.partitionBy(*group, "part").orderBy(*order)
    return dealt.withColumn("at", F.row_number().over(within) - 1).join(before, [*group, "part"]).withColumn("at", F.col("at") + F.col("before")).drop("by", "part", "before")


def tiled(rows: DataFrame) -> DataFrame:
    """rows with their slab and tile."""
    size = F.greatest(F.lit(1), F.floor(F.lit(TILE_CELLS) / F.greatest("dim", F.lit(1))))
    counts = rows.groupBy(*CLASS).agg(F.count("*").alias("n")).withColumn("size", size)
    counts = counts.select(*CLASS, "size", F.ceil(F.sqrt(F.ceil(F.col("n") / F.col("size")))).alias("across"))
    component = lambda k: F.coalesce(F.get("v", F.lit(k)), F.lit(0).cast("long"))
    slabs = numbered(rows, CLASS, component(0), "vector-slabs").join(counts, CLASS).withColumn("slab", F.floor(F.col("at") / (F.col("size") * F.col("across")))).drop("at", "across")
    return numbered(slabs, SLAB, component(1), "vector-tiles").withColumn("tile", F.floor(F.col("at") / F.col("size"))).drop("at", "size")


def smallest_type(x: np.ndarray) -> np.ndarray:
    return x.astype(np.result_type(np.min_scalar_type(int(x.min(initial=0))), np.min_scalar_type(-1 - int(x.max(initial=0))))) if x.dtype == np.int64 else x


def pack(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of rows in the tree, its nodes (first, last, 1 for a leaf: rows or children in [first, last)) and their boxes (low, high). Node 0 is the root;
    a node with more rows than a leaf is sorted along its widest component, ties by id, and cut into runs."""
    nodes, boxes, order = [None], [None], []
    queue = [(0, np.arange(len(x)))]
    while queue:
        later = []
        for at, rows in queue:
            part = x[rows]
            boxes[at] = (part.min(0), part.max(0))
            if len(rows) <= LEAF:
                nodes[at] = (len(order), len(order) + len(rows), 1)
                order.extend(rows.tolist())
                continue
            wide = int(np.argmax(boxes[at][1].astype(np.float64) - boxes[at][0])) if x.shape[1] else None
            ranked = rows[np.lexsort((ids[rows], part[:, wide]) if wide is not None else (ids[rows],))]
            runs = [r for r in np.array_split(ranked, min(FANOUT, -(-len(rows) // LEAF))) if len(r)]
            nodes[at] = (len(nodes), len(nodes) + len(runs), 0)
            later += [(len(nodes) + k, r) for k, r in enumerate(runs)]
            nodes += [None] * len(runs)
            boxes += [None] * len(runs)
        queue = later
    return np.array(order, np.int64), np.array(nodes, np.int64), np.array(boxes, np.int64).reshape(len(nodes), 2, x.shape[1])


def build_tree(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """One row for a tile: its box and its packed tree."""
    pdf = pdf.sort_values("vec_id", kind="stable")
    ids, x = pdf["vec_id"].to_numpy(np.int64), np.array(pdf["v"].tolist(), np.int64).reshape(len(pdf), key[0])
    order, nodes, boxes = pack(ids, x)
    rows = smallest_type(x[order])
    return pd.DataFrame([(*key, boxes[0, 0], boxes[0, 1], ids[order].tobytes(), rows.dtype.char.encode() + rows.tobytes(), nodes.tobytes(), boxes.tobytes())], columns=[c.split()[0] for c in TREE.split(", ")])


def interval(q: np.ndarray, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest inner product with q of what lies in each box: per component, one end of the box's side gives each."""
    ends = boxes * q
    return ends.min(1).sum(1), ends.max(1).sum(1)


class Tree:
    def __init__(self, row: pd.Series, dim: int) -> None:
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.rows = np.frombuffer(row["rows"][1:], np.dtype(row["rows"][:1].decode())).reshape(len(self.ids), dim)
        self.nodes = np.frombuffer(row["nodes"], np.int64).reshape(-1, 3)
        self.boxes = np.frombuffer(row["boxes"], np.int64).reshape(len(self.nodes), 2, dim)
        self.reach = float(np.abs(self.boxes[0].astype(np.float64)).max(initial=0))

    def ready(self, q: np.ndarray) -> np.ndarray:
        """q in a type that adds products exactly."""
        most = self.reach * float(np.abs(q.astype(np.float64)).sum())
        if most >= 2.0**55:
            raise ValueError("inner products do not fit whole numbers of 64 bits")
        kind = np.float64 if most < 2.0**52 else np.int64
        if self.rows.dtype != kind:
            self.rows, self.boxes = self.rows.astype(kind), self.boxes.astype(kind)
        return q.astype(kind)

    def search(self, q: np.ndarray, own: int, k: int, windows: list[tuple[float, float]], floors: list[float]) -> list[list[tuple[int, int]]]:
        """For each window (low <= 100 * score <= high) the k best (score, id), ties to smaller ids, without rows of the id own; what is strictly below a window's floor is left out."""
        q = self.ready(q)
        found: list[list[tuple[int, int]]] = [[] for _ in windows]  # (-score, id), best first
        floors = list(floors)
        low, high = interval(q, self.boxes[:1])
        heap = [(-high[0], 0, low[0])]
        while heap:
            up, at, down = heapq.heappop(heap)
            up = -up
            open_ = [i for i, (a, b) in enumerate(windows) if 100 * up >= a and up >= floors[i] and 100 * down <= b]
            if not open_:
                if all(up < floors[i] or 100 * up < a for i, (a, _) in enumerate(windows)):
                    break  # so are all boxes that are left
                continue
            first, last, leaf = self.nodes[at]
            if not leaf:
                low, high = interval(q, self.boxes[first:last])
                for i in range(last - first):
                    heapq.heappush(heap, (-high[i], int(first) + i, low[i]))
                continue
            score = self.rows[first:last] @ q
            for i in open_:
                a, b = windows[i]
                hit = np.flatnonzero((score >= floors[i]) & (100 * score >= a) & (100 * score <= b))
                if len(hit):
                    more = [(-int(score[h]), int(self.ids[first + h])) for h in hit if self.ids[first + h] != own]
                    found[i] = heapq.nsmallest(k, found[i] + more)
                    if len(found[i]) == k:
                        floors[i] = max(floors[i], -found[i][-1][0])
        return [[(-s, i) for s, i in f] for f in found]


def search_tile(k: int, low: int, high: int):
    """The k best rows of a tile for every anchor of a block: in its window for each of its wanted scores, or at all, without wanted scores."""
    def run(key: tuple, anchors: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(anchors) and len(trees):
            tree = Tree(trees.iloc[0], key[0])
            for anchor, own, q, wanted, floor in zip(anchors["anchor"], anchors["anchor_id"], anchors["q"], anchors["wanted"], anchors["floor"]):
                each = [int(w) for w in wanted] if wanted is not None else [None]
                windows = [(low * w, high * w) if w is not None else (-np.inf, np.inf) for w in each]
                floors = [-np.inf if floor is None or floor != floor else float(floor)] * len(each)
                for w, hits in zip(each, tree.search(np.asarray(q, np.int64), own, k, windows, floors)):
                    out += [(anchor, w or 0, i, s) for s, i in hits]
        return pd.DataFrame(out, columns=["anchor", "wanted", "vec_id", "score"]).astype("int64")
    return run


def bound(q: str, upper: bool) -> Column:
    """The greatest or least inner product of q with what lies in the box low..high."""
    pick = F.greatest if upper else F.least
    sides = F.zip_with(F.col("low"), F.col("high"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.aggregate(F.zip_with(F.col(q), sides, lambda c, s: pick(c * s["a"], c * s["b"])), F.lit(0).cast("long"), lambda a, c: a + c)


def enclosing(boxes: DataFrame, by: list[str]) -> DataFrame:
    """The boxes around all boxes of a group."""
    side = boxes.select(*by, F.posexplode_outer(F.arrays_zip("low", "high")).alias("at", "s")).groupBy(*by, "at").agg(F.min("s.low").alias("low"), F.max("s.high").alias("high"))
    return side.groupBy(*by).agg(F.sort_array(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "low", "high")))).alias("s")).select(*by, F.col("s.low").alias("low"), F.col("s.high").alias("high"))


def reached(anchors: DataFrame, trees: DataFrame, blocks: DataFrame, fits: Column, own: bool) -> DataFrame:
    """Anchors with the tiles whose intervals fit, label by label, slab by slab, tile by tile. own: in the anchor's label, else in all others. Labels and
    their boxes are copied for each block of anchors; no step is a product of two tables."""
    tiles = trees.select(*TILE, "low", "high")
    slabs = stage(enclosing(tiles, SLAB), "vector-slab-boxes")
    labels = enclosing(slabs, CLASS)
    asks = anchors.withColumnRenamed("label", "anchor_label")
    if own:
        down = asks.join(labels, (asks["dim"] == labels["dim"]) & (asks["anchor_label"] == labels["label"])).drop(labels["dim"])
    else:
        dealt = labels.join(blocks, "dim").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        down = asks.join(dealt, ["dim", "block"]).filter("label <> anchor_label")
    down = down.filter(fits).drop("low", "high").join(slabs, CLASS).filter(fits).drop("low", "high")
    return down.join(tiles, SLAB).filter(fits)


def searched(asked: DataFrame, anchors: DataFrame, trees: DataFrame, k: int, low: int = 0, high: int = 0) -> DataFrame:
    """anchor, wanted, vec_id, score: the k best of every tile that an anchor (anchor_id, q, wanted, floor) asks. A tile goes once to each block of anchors, an anchor once to each tile."""
    asked = stage(asked.select(*TILE, "block", "anchor"), "asked-tiles")
    copied = trees.drop("low", "high").join(asked.select(*[F.col(c).alias(f"t_{c}") for c in TILE], F.col("block").alias("t_block")).distinct(), [F.col(c) == F.col(f"t_{c}") for c in TILE])
    copied = copied.drop(*TILE)
    told = asked.join(anchors.select("anchor", "anchor_id", "q", "wanted", "floor"), "anchor")
    keys = [*TILE, "block"]
    return told.groupBy(*keys).cogroup(copied.groupBy(*[f"t_{c}" for c in keys])).applyInPandas(search_tile(k, low, high), HITS)


def best(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits of each anchor and wanted score, with their rank."""
    order = Window.partitionBy("anchor", "wanted").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows for which is_anchor is true; a score is the inner product of components floor(scale * x). An anchor's positives are its first other rows of
    its label, by score, ties by vec_id; each positive gets the first rows of other labels with low * positive_score <= 100 * score <= high * positive_score. Rows with a null id,
    label or vector, or with a null or non-finite component, take no part; vectors meet those of their own length only. Rows with the anchor's id are never its positives or negatives; repeated rows
    count each. Scores beyond 2^55 are an error. Fewer rows give them all, an empty table none; other columns are not looked at."""
    rows = stage(tiled(usable(vectors, scale)), "vector-rows")
    trees = stage(rows.groupBy(*TILE).applyInPandas(build_tree, TREE), "vector-trees")
    anchors = rows.filter(is_anchor).select(*TILE, F.col("vec_id").alias("anchor_id"), F.col("v").alias("q"), F.monotonically_increasing_id().alias("anchor"))
    anchors = stage(anchors, "anchors")
    blocks = stage(anchors.groupBy("dim").agg(F.ceil(F.count("*") * F.greatest("dim", F.lit(1)) / BLOCK_CELLS).cast("int").alias("blocks")), "anchor-blocks")
    asks = anchors.join(blocks, "dim").withColumn("block", F.pmod(F.xxhash64("anchor", F.lit("block")), F.col("blocks")).cast("int")).drop("blocks")
    # Positives: the anchor's own tile first, which says what the others must reach.
    ask = asks.withColumn("wanted", F.lit(None).cast("array<long>")).withColumn("floor", F.lit(None).cast("long"))
    home = stage(searched(ask, ask, trees, positives), "home-hits")
    floor = home.groupBy("anchor").agg(F.when(F.count("*") >= positives, F.min("score")).alias("floor"))
    ask = stage(ask.drop("floor").join(floor, "anchor", "left"), "floored-anchors")
    fits = F.col("floor").isNull() | (bound("q", True) >= F.col("floor"))
    away = reached(ask.withColumnsRenamed({"slab": "home_slab", "tile": "home_tile"}), trees, blocks, fits, True).filter("slab <> home_slab OR tile <> home_tile")
    near = best(home.unionByName(searched(away, ask, trees, positives)), positives)
    near = stage(near.select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # Negatives: one window for each distinct score of a positive.
    wanted = near.groupBy("anchor").agg(F.sort_array(F.collect_set("positive_score")).alias("wanted"))
    seek = stage(ask.select("anchor", "anchor_id", "dim", "label", "block", "q").join(wanted, "anchor").withColumn("floor", F.lit(None).cast("long")), "seeking-anchors")
    up, down = bound("q", True), bound("q", False)
    fits = (100 * up >= low * F.array_min("wanted")) & (100 * down <= high * F.array_max("wanted"))
    hits = best(searched(reached(seek, trees, blocks, fits, False), seek, trees, negatives, low, high), negatives)
    hits = hits.select("anchor", F.col("wanted").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    told = near.join(hits, ["anchor", "positive_score"]).join(anchors.select("anchor", "anchor_id"), "anchor")
    return told.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
