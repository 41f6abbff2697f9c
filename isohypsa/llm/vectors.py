"""Approximate nearest neighbours by randomly rotated one-bit codes.

Vectors are scaled to length one and rotated; the signs of the result are the code. For a query q and a vector o with code x
the inner product is estimated as <x, q> / <x, o>, where <x, o> is a scalar kept with the code, and it lies within
``SIGMAS * sqrt((1 - <x, o>^2) / (<x, o>^2 (D - 1)))`` of the truth but for rare cases. <x, q> comes from counts of common bits of
the packed code with the bit planes of the query in whole numbers. Vectors whose upper bound reaches the k-th best exact score are compared in
full, so the result differs from brute force only where a bound fails.

Vectors are coded once, where they are read, and travel in packs: a row of bytes for up to PACK vectors, with codes and scalars, in the
width they are stored in. Packs of queries and of candidates are dealt into blocks and every pair of blocks is one group: the work is queries
times candidates, as asked, but nothing is sent to all tasks and no pair is a row. A pack of candidates moves once per QUERY_BLOCK queries. A block returns its
k best per query. Pairs chosen by codes alone are not sent to a second step that fetches their vectors: where vectors have little structure a bound of three deviations leaves
more than a fifth of all pairs at 64 dimensions, as rows many times the bytes of the packs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

#: Rows of a block of queries, of a block of candidates and of a pack, about.
QUERY_BLOCK, ROW_BLOCK, PACK = 16384, 8192, 1024
#: Width of the error bound in standard deviations, and bits of a query's components.
SIGMAS, PLANES = 3.0, 6
#: Partitions over which groups are dealt at most.
MOST_TASKS = 20000
FOUND = "query_id long, vec_id long, score double"
PACKED = "dim int, ids binary, vectors binary, codes binary, scalars binary"


@lru_cache(maxsize=8)
def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits (uint64 words) of unit rows, and <x, o>."""
    y = unit @ turn
    bits = np.packbits(y > 0, axis=1)
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)))
    return np.ascontiguousarray(bits).view(np.uint64), np.abs(y).sum(1) / np.sqrt(y.shape[1])


def ones_of(words: np.ndarray) -> np.ndarray:
    """Set bits of each column of words (words of a code x rows)."""
    return np.bitwise_count(words).sum(0, dtype=np.int32)


def estimate(unit: np.ndarray, turn: np.ndarray, words: np.ndarray, ones: np.ndarray, scalar: np.ndarray) -> tuple[np.ndarray, float]:
    """Estimated inner products of one unit query with all coded rows, and how much the rounding of the query may add."""
    y = unit @ turn
    low, step = y.min(), max((y.max() - y.min()) / ((1 << PLANES) - 1), 1e-30)
    level = np.rint((y - low) / step).astype(np.int64)
    common = np.zeros(words.shape[1], np.int32)
    for b in range(PLANES):
        plane = np.packbits((level >> b & 1).astype(bool))
        plane = np.pad(plane, (0, -len(plane) % 8)).view(np.uint64)
        common += ones_of(words & plane[:, None]) << b
    d = len(y)
    product = (2 * step * common + 2 * low * ones - (step * level.sum() + low * d)) / np.sqrt(d)
    return product / scalar, step / 2 * np.sqrt(d)


def exact(rows: np.ndarray, norms: np.ndarray, query: np.ndarray, norm: float) -> np.ndarray:
    """Cosines in double precision; equal rows get equal scores."""
    return (rows * query).sum(1) / (norms * norm)


def pack(limit: int, dtype: str):
    """Rows vec_id, embedding, dim as packs of up to limit vectors of one dimension."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                ids = part["vec_id"].to_numpy(np.int64)
                for at in range(0, len(part), limit):
                    x = np.stack(part["embedding"].iloc[at:at + limit]).astype(np.float64)
                    codes, scalar = encode(x / np.sqrt((x * x).sum(1))[:, None], rotation(int(dim)))
                    packed = (ids[at:at + limit], x.astype(dtype), codes, scalar)
                    yield pd.DataFrame([(dim, *(a.tobytes() for a in packed))], columns=["dim", "ids", "vectors", "codes", "scalars"])
    return run


def unpack(packs: pd.DataFrame, dtype: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, vectors, codes and scalars of all packs of a block, by id."""
    dim = int(packs["dim"].iloc[0])
    read = lambda column, kind: np.frombuffer(b"".join(packs[column]), kind)
    ids, x = read("ids", np.int64), read("vectors", dtype).reshape(-1, dim).astype(np.float64)
    order = np.argsort(ids, kind="stable")
    return ids[order], x[order], read("codes", np.uint64).reshape(len(ids), -1)[order], read("scalars", np.float64)[order]


def search_block(k: int, sigmas: float, dtype: str):
    """The k best rows of one block for every query of another, ties to the smaller id; a query's own rows are left out."""
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        ids, x, codes, scalar = unpack(rows, dtype)
        norms = np.sqrt((x * x).sum(1))
        turn, words = rotation(x.shape[1]), np.ascontiguousarray(codes.T)
        ones = ones_of(words)
        spread = sigmas * np.sqrt(np.maximum(1 - scalar**2, 0) / (scalar**2 * max(x.shape[1] - 1, 1)))
        out = []
        for qid, q in zip(*unpack(queries, dtype)[:2]):
            norm = np.sqrt((q * q).sum())
            guess, blur = estimate(q / norm, turn, words, ones, scalar)
            other = ids != qid
            guess[~other] = -np.inf
            first = np.argpartition(-guess, min(4 * k, len(guess)) - 1)[:4 * k]
            first = first[other[first]]
            if not len(first):
                continue
            known = np.sort(exact(x[first], norms[first], q, norm))[::-1]
            floor = known[k - 1] if len(known) >= k else -np.inf
            near = other & (guess + spread + blur / scalar >= floor)
            near[first] = True
            rest = np.flatnonzero(near)
            score = exact(x[rest], norms[rest], q, norm)
            best = np.lexsort((ids[rest], -score))[:k]
            out += zip([int(qid)] * len(best), ids[rest][best].tolist(), score[best].tolist())
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])
    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (array of double), dim of the vectors that take part: not null, not zero, of finite components only."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", v.alias("embedding")).filter(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)).withColumn("dim", F.size("embedding"))


def each(n: int) -> Column:
    """A row for each of n blocks."""
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def nearest(vectors: DataFrame, is_query, k: int = 5, sigmas: float = SIGMAS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest rows of the same dimension by cosine, but its own.

    Queries are the rows for which the column is_query is true. Rows that are null, zero or hold null or non-finite components take no part; fewer than k
    rows give them all; equal scores rank by vec_id. Repeated ids: each row counts, and a query id is looked up once per row of it.
    Other columns are not looked at."""
    element = vectors.schema["embedding"].dataType
    dtype = "<f4" if isinstance(element, ArrayType) and isinstance(element.elementType, FloatType) else "<f8"
    rows = usable(vectors)
    n_rows, n_queries = rows.agg(F.count("*"), F.count_if(is_query)).first()
    row_blocks, query_blocks = max(1, -(-n_rows // ROW_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    packs = lambda df: df.mapInPandas(pack(PACK, dtype), PACKED)
    dealt = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")
    left = packs(rows.filter(is_query)).withColumn("qb", dealt(query_blocks)).withColumn("rb", each(row_blocks))
    right = packs(rows).withColumn("rb", dealt(row_blocks)).withColumn("qb", each(query_blocks))
    key = ["dim", "qb", "rb"]
    parts = min(2 * row_blocks * query_blocks, MOST_TASKS)  # by number: few bytes are much work here, and would be merged by size
    grouped = lambda df: df.repartition(parts, *key).groupBy(*key)
    found = grouped(left).cogroup(grouped(right)).applyInPandas(search_block(k, sigmas, dtype), FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
