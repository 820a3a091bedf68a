"""Exact top-k by inner product: exhaustive term-at-a-time accumulation.

A dimension is a term, its postings the candidates' weights in a block, and a query a sparse list of weighted
terms.  Each term of a query scatters its weighted postings into the query's dense array of scores; a partition
of the array selects a block's best, and the blocks' lists are merged in rounds.  Every query meets every block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 8192
#: Queries that meet a block in one task; the candidates are copied once for each such part.
QUERY_ROWS = 8192
#: Blocks whose lists are merged in one round.
MERGED = 64
OUT = "block int, query_id long, vec_id long, score long"
#: Sums of products up to this size are exact as doubles.
EXACT = 2.0**53


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and v = floor(scale x) of each vector without null, NaN or infinite components."""
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & good).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def packed(rows: pa.Table, ids: str = "vec_id", v: str = "v") -> tuple[np.ndarray, np.ndarray]:
    """Ids and a dense matrix; missing trailing components are 0."""
    ids = rows[ids].to_numpy()
    lists = rows[v].combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
    size = lists.value_lengths().to_numpy()
    out = np.zeros((len(ids), int(size.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(ids)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy()
    return ids, out


def accumulate(query: np.ndarray, postings: np.ndarray, scores: np.ndarray) -> None:
    """Adds every term of a query to the dense scores; postings has a row for each term."""
    scores[:] = 0
    for term in np.flatnonzero(query[: len(postings)]).tolist():
        scores += query[term] * postings[term]


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id, in that order."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)  # with all ties at the edge
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 10, scale: int = 1024, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The k rows of highest integer inner product for each query row, itself left out: query_id, rank, vec_id, score.

    Components become floor(scale x).  Vectors that are null or hold a null, NaN or infinite component take no part;
    vectors of unequal length are compared as if padded by zeros.  Ties go to the smaller vec_id.  Fewer than k other
    rows give all of them.  Repeated vec_ids: rows of the query's own id are left out of its candidates, and equal rows
    count each.  An empty table gives no rows.  Scores are exact for sums below 2^63.
    """
    rows = quantised(vectors, scale)
    total = rows.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    blocks, parts = max(1, -(-total["n"] // block_rows)), max(1, -(-total["q"] // query_rows))
    deal = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    # under other names, so that the two sides share no column
    candidates = rows.select(F.col("vec_id").alias("own_id"), F.col("v").alias("own_v"), deal(blocks, 1).alias("block"))
    asked = rows.where(is_query).select("vec_id", "v", deal(parts, 2).alias("part"))
    # a task for each query part and candidate block: the stated queries against all rows, in blocks
    left = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = candidates.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def work(queries: pa.Table, block: pa.Table) -> pa.Table:
        if not queries.num_rows or not block.num_rows:  # a block or part that got no row
            return pa.table({"block": pa.array([], pa.int32())} | {c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
        qid, q = packed(queries)
        order = np.argsort(block["own_id"].to_numpy(), kind="stable")
        ids, dense = packed(block, "own_id", "own_v")
        ids, postings = ids[order], np.ascontiguousarray(dense[order].T)
        low, high = np.searchsorted(ids, qid, "left"), np.searchsorted(ids, qid, "right")
        bound = float(np.abs(q).max(initial=0)) * float(np.abs(postings).max(initial=0)) * max(1, q.shape[1])
        kind = np.float64 if bound < EXACT else np.int64
        q, postings = q.astype(kind), postings.astype(kind)
        scores = np.empty(len(ids), kind)
        out = []
        for r in range(len(qid)):
            accumulate(q[r], postings, scores)
            own = np.concatenate([scores[: low[r]], scores[high[r] :]])
            other = np.concatenate([ids[: low[r]], ids[high[r] :]])
            at = best(other, own, k)
            out.append((np.full(len(at), qid[r]), other[at], own[at].astype(np.int64)))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table({"block": pa.array(np.full(len(cols[0]), block["block"][0].as_py()), pa.int32())} | dict(zip(("query_id", "vec_id", "score"), cols, strict=True)))

    lists = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(work, OUT)
    # a round merges the lists of up to MERGED blocks of a query, so no list holds more than that many times k entries
    entry = F.struct((-F.col("score")).alias("s"), "vec_id")
    best_of = lambda rows, *keys: rows.groupBy("query_id", *keys).agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k).alias("top"))
    while blocks > MERGED:
        blocks = -(-blocks // MERGED)
        some = best_of(lists, F.floor(F.col("block") / MERGED).cast("int").alias("block")).select("block", "query_id", F.explode("top").alias("e"))
        lists = some.select("block", "query_id", F.col("e.vec_id").alias("vec_id"), (-F.col("e.s")).alias("score"))
    merged = best_of(lists)
    return merged.select("query_id", F.posexplode("top").alias("pos", "e")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), (-F.col("e.s")).alias("score"))
