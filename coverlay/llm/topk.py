"""Exact top-k by inner product: columnar branch and bound.

Candidates lie in blocks, one row of numbers per dimension, the dimensions with the largest
squares first.  A query walks the dimensions a few at a time and adds up partial scores; what
a candidate can still gain is at most the product of the two vectors' remaining norms.  At
each look the most promising candidates are scored in full, which raises the query's floor,
and its own list of candidates is compacted to those whose bound reaches the floor.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coverlay.operators.lineage import settle

#: Rows of a block of candidates and of queries, about.
CANDIDATES, QUERIES = 16_384, 1_024
#: Queries whose first partial scores are computed together.
GROUP = 64
#: Dimensions added between two looks at the bounds.
STEP = 16


def scan_block(
    queries: np.ndarray, columns: np.ndarray, skip: np.ndarray, ids: np.ndarray, k: int, step: int = STEP, seen: list[int] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best candidates of each query as ``query row, candidate row, score``.

    ``queries``: one row each; ``columns``: one row per dimension; integers.  ``skip``: a
    candidate id that a query must not return.  Ties go to the smaller id.  Bounds are
    doubles, widened by their rounding; scores are 64-bit integers.  ``seen`` receives how
    many candidates each look adds up, all queries together.
    """
    dims, n = columns.shape
    by_energy = np.argsort(-(columns.astype(np.float64) ** 2).sum(1), kind="stable")
    whole_c, whole_q = columns[by_energy], queries[:, by_energy]
    c, q = whole_c.astype(np.float64), whole_q.astype(np.float64)
    looks = list(range(0, dims, step))
    rest = [np.sqrt((c[d:] ** 2).sum(0)) for d in looks] + [np.zeros(n)]
    left = [np.sqrt((q[:, d:] ** 2).sum(1)) for d in looks] + [np.zeros(len(q))]
    # Rounding of a sum of products, on both sides of a comparison.
    slack = 0.5 + dims * 2.0**-50 * (left[0] * rest[0].max(initial=0.0))
    counts = [0] * len(looks)
    rows_out, cands_out, scores_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for first in range(0, len(q), GROUP):
        partial = q[first : first + GROUP, :step] @ c[:step]
        for i in range(first, min(first + GROUP, len(q))):
            alive = np.flatnonzero(ids != skip[i])
            score, floor = partial[i - first, alive], -np.inf
            for turn, d in enumerate(looks):
                counts[turn] += len(alive)
                if turn:
                    part = c[d : d + step]
                    score = score + (q[i, d : d + step] @ part[:, alive] if 2 * len(alive) < n else (q[i, d : d + step] @ part)[alive])
                if len(alive) > k:
                    reach = score + left[turn + 1][i] * rest[turn + 1][alive]
                    hopeful = alive[np.argpartition(-reach, k - 1)[:k]]
                    floor = max(floor, (q[i] @ c[:, hopeful]).min())
                    keep = reach >= floor - slack[i]
                    alive, score = alive[keep], score[keep]
            exact = whole_q[i] @ whole_c[:, alive]
            best = np.lexsort((ids[alive], -exact))[:k]
            rows_out.append(np.full(len(best), i))
            cands_out.append(alive[best])
            scores_out.append(exact[best])
    if seen is not None:
        seen.extend(counts)
    return np.concatenate(rows_out), np.concatenate(cands_out), np.concatenate(scores_out)


def _searcher(k: int):
    def search(key: tuple, queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or candidates.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        q = np.array(queries["v"].tolist(), dtype=np.int64).reshape(len(queries), -1)
        columns = np.ascontiguousarray(np.array(candidates["v"].tolist(), dtype=np.int64).reshape(len(candidates), -1).T)
        q_ids, ids = queries["id"].to_numpy(), candidates["id"].to_numpy()
        rows, cands, scores = scan_block(q, columns, q_ids, ids, k)
        return pd.DataFrame({"query_id": q_ids[rows], "vec_id": ids[cands], "score": scores})

    return search


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows with the largest inner product.

    Components become ``floor(scale * x)``, computed in double precision.  All rows but the
    query's own are candidates; ties go to the smaller id; fewer rows than ``k`` are all
    returned.  Null vectors, vectors with a null, NaN or infinite component and rows with a
    null id take no part.  Scaled components and scores must fit 64-bit integers; they are exact
    to that range.  Vectors are compared with those of their own length.  Blocks are
    bounded however many rows there are; the work is queries times candidates less what the
    bounds cut.  An empty table gives no rows.  ``key`` must be unique.
    """
    spark = vectors.sparkSession
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    usable = vectors.filter(F.col(key).isNotNull() & x.isNotNull() & finite)
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * scale))
    rows = settle(usable.select(F.col(key).cast("long").alias("id"), whole.alias("v"), F.size(whole).alias("dims"), F.coalesce(is_query, F.lit(False)).alias("asks")))
    count = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("asks").cast("int")), F.lit(0)).alias("q")).first()
    blocks, groups = -(-max(count["n"], 1) // CANDIDATES), -(-max(count["q"], 1) // QUERIES)
    blocks = max(blocks, min(-(-count["n"] // 2048), spark.sparkContext.defaultParallelism))
    side = rows.withColumn("_block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int"))
    ask = rows.filter("asks").withColumn("_group", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(groups)).cast("int"))
    candidates = side.select("dims", "_block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_group"), "id", "v")
    queries = ask.select("dims", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"), "_group", "id", "v")
    pair = ["dims", "_block", "_group"]
    found = queries.groupBy(*pair).cogroup(candidates.groupBy(*pair)).applyInPandas(_searcher(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
