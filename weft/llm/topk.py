"""Exact top-k inner products by no-random-access aggregation over sorted lists.

The dimensions are cut into a few runs. For a query and a block of vectors, each run gives a list: the vectors by their inner
product over these dimensions. The lists are read in step from their best ends. A vector's score is known within bounds: what was
read of it so far, plus, for each list in which it wasn't met, the least and the most that list can still give. Reading stops when
few vectors are left whose upper bound reaches the k-th best lower bound; no other, seen or unseen, can be among the k best, and the
scores of those left are resolved from the rest of the lists.

Scores are integer inner products of floor(scale * x), so bounds and sums are exact. Vectors and queries are cut into blocks and each
pair of blocks is one group; only the k best of a block pair leave it. The query set is stated by the caller; every vector of its
dimension is a candidate except the query's own row.

Defined cases: vectors that are null, empty, or hold a null or non-finite component take no part, nor do null ids; rows with equal
ids are candidates of their own, and a query excludes all rows with its id (query rows of one id with
different vectors are one query, scored by the better of them); ties go to the smaller id; with fewer than k
candidates all are returned; vectors of different dimensions aren't compared; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import table, written

TOP = 10
SCALE = 1024
#: Vectors are copied once a query block, and each block pair gives k rows a query, so both blocks are as large as a task's memory
#: allows (8 bytes a component), and the rows are reduced MERGED blocks at a time.
VECTOR_BLOCK = 16_384
QUERY_BLOCK = 8_192
MERGED = 64
#: Lists, each by the inner product over so many equal runs of dimensions. A list for each single dimension was tried: at 64
#: dimensions its bounds never closed before the lists' ends.
PARTS = 4
#: Queries whose lists are held at once.
AT_ONCE = 32
#: Shares of the lists after which the bounds are compared.
STEPS = (1 / 64, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 1)


def sub_scores(x: np.ndarray, queries: np.ndarray, parts: int) -> np.ndarray:
    """parts x queries x n: the inner products over each of `parts` runs of dimensions, exactly."""
    d = x.shape[1]
    cuts = np.linspace(0, d, min(parts, d) + 1).astype(int)
    largest = float(np.abs(x).max(initial=0)) * float(np.abs(queries).max(initial=0)) * d
    kind = np.float64 if largest < 2**53 else np.int64  # float64 sums of integers are exact up to there
    return np.stack([(queries[:, a:z].astype(kind) @ x[:, a:z].T.astype(kind)).astype(np.int64) for a, z in zip(cuts, cuts[1:])])


def nra(lists: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Places and exact scores of a superset of the k best of n candidates, and the share of the lists that was read.

    lists: m x n, each list's score of each candidate. The lists are read in descending order, a step's share at once, so only the
    steps' bounds need their places in the order."""
    m, n = lists.shape
    bounds = sorted({max(1, int(n * share)) for share in STEPS} | {n})
    order = np.argpartition(-lists, [b - 1 for b in bounds], axis=1)
    least = lists.min(1)
    read, seen = np.zeros(n, np.int64), np.zeros((m, n), bool)
    alive, depth = np.arange(n), 0
    for to in bounds:
        for j in range(m):
            part = order[j, depth:to]
            read[part] += lists[j, part]
            seen[j, part] = True
        depth = to
        if depth >= n:
            break
        most = lists[np.arange(m), order[:, depth - 1]]  # what any list can still give
        unseen = ~seen[:, alive]
        low, high = read[alive] + least @ unseen, read[alive] + most @ unseen
        bar = np.partition(low, len(low) - k)[len(low) - k]
        alive = alive[high >= bar]  # one that no list has shown yet is bounded by the sum of what all can still give
        if len(alive) <= max(4 * k, n // 64):
            break
    scores = read[alive]
    if depth < n:  # resolve: the ones that are left, from the rest of the lists
        scores = scores + (lists[:, alive] * ~seen[:, alive]).sum(0)
    return alive, scores, depth / n


def best_of_block(queries: pd.DataFrame, vectors: pd.DataFrame, k: int, parts: int = PARTS) -> pd.DataFrame:
    if not len(queries) or not len(vectors):  # a block pair of one side alone
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
    out = []
    for dim, vs in vectors.groupby(vectors["v"].map(len)):
        qs = queries[queries["v"].map(len) == dim]
        x, ids = np.array(vs["v"].tolist(), np.int64).reshape(-1, dim), vs["vec_id"].to_numpy(np.int64)
        for start in range(0, len(qs), AT_ONCE):
            some = qs.iloc[start : start + AT_ONCE]
            lists = sub_scores(x, np.array(some["v"].tolist(), np.int64).reshape(-1, dim), parts)
            for j, q in enumerate(some["vec_id"].to_numpy(np.int64)):
                own = int((ids == q).sum())
                at, scores, _ = nra(lists[:, j], min(k + own, len(x)))
                keep = ids[at] != q
                at, scores = at[keep], scores[keep]
                first = np.lexsort((ids[at], -scores))[:k]
                out.append(pd.DataFrame({"query_id": q, "vec_id": ids[at][first], "score": scores[first]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.where(v.isNotNull() & F.col(id_col).isNotNull()).where((F.size(v) > 0) & ~bad)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def top_k(vectors: DataFrame, is_query: F.Column, k: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which is_query (over vec_id) holds, its k best others. Equal query rows are one query."""
    rows = written(integers(vectors, id_col, vector_col, scale), "vectors")
    n, n_queries = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    v_blocks, q_blocks = max(1, -(-n // VECTOR_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    queries = rows.where(is_query).dropDuplicates(["vec_id", "v"])
    split = lambda blocks: F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = queries.withColumns({"qb": split(q_blocks), "vb": every(v_blocks)}).groupBy("qb", "vb")
    right = rows.withColumns({"vb": F.pmod(F.monotonically_increasing_id(), F.lit(v_blocks)).cast("int"), "qb": every(q_blocks)}).groupBy("qb", "vb")
    found = left.cogroup(right).applyInPandas(lambda a, b: best_of_block(a, b, k), "query_id long, vec_id long, score long")
    found = written(found, "block-best")  # the dear part, once
    first = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best")
    parts = F.pmod(F.xxhash64("vec_id"), F.lit(-(-v_blocks // MERGED)))  # k a block, so some k x MERGED rows meet
    best = found.groupBy("query_id", parts.alias("part")).agg(first).select("query_id", F.explode("best").alias("b")).select("query_id", (-F.col("b.s")).alias("score"), "b.vec_id").groupBy("query_id").agg(first)
    out = best.select("query_id", F.posexplode("best").alias("rank", "b"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
