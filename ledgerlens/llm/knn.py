"""Exact k nearest neighbours by inner product: a Voronoi join.

With ``m`` the largest norm of the data, a vector ``x`` becomes ``(x, sqrt(m^2 - |x|^2))`` and a query ``q`` becomes
``(q, 0)``. Then ``|q - x|^2 = |q|^2 + m^2 - 2 q.x``: the nearest points have the largest inner products, and the
triangle inequality holds. Every point belongs to the cell of its nearest pivot.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import need
from ledgerlens.scratch import save

# at most this many pivots go to the driver and to every task, and so many vector lengths get pivots of their own
PIVOTS, LENGTHS = 64, 64
# whole numbers up to this are exact doubles, and so are all sums of products if the squared norms stay below it
EXACT = 2.0**53
# queries that one group holds, data vectors that one block of a group holds, and queries scored at a time
GROUP_QUERIES, BLOCK_ROWS, SLAB_QUERIES = 2_048, 16_384, 128


def quantised(embedding: str, scale: int) -> F.Column:
    """floor(scale * x) of every component as integers; null for vectors with null or non-finite components."""
    c = F.col(embedding).cast("array<double>")
    usable = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(usable, F.transform(c, lambda x: F.floor(x * scale).cast("double")))


def _cells(points: DataFrame, pivots: np.ndarray, top: float, is_query: bool) -> DataFrame:
    """id, vector, cell and the distance to the cell's pivot."""
    square = (pivots * pivots).sum(axis=1)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column(1).to_pylist(), np.float64)
            norm = (x * x).sum(axis=1)
            lift = np.zeros(len(x)) if is_query else np.sqrt(np.maximum(top - norm, 0))
            full = np.concatenate([x, lift[:, None]], axis=1)
            far = (full * full).sum(axis=1)[:, None] + square - 2 * full @ pivots.T
            cell = far.argmin(axis=1)
            d = np.sqrt(np.maximum(far[np.arange(len(x)), cell], 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(d)], ["id", "v", "cell", "d"])

    return points.mapInArrow(per_batch, "id long, v array<double>, cell int, d double")


def _bounds(pivots: np.ndarray, radius: dict[int, float], nearest: dict[int, list[float]], k: int) -> dict:
    """For every query cell: distances of its pivot to all, its radius, and a bound on the k-th distance.

    The bound rests on the summaries only: a data point at distance ``d`` from pivot ``j`` is at most
    ``radius + |p_i - p_j| + d`` from any query of cell ``i``. One more than ``k`` points allow for the query itself.
    """
    out = {}
    for i, u in radius.items():
        gap = np.sqrt(((pivots - pivots[i]) ** 2).sum(axis=1))
        ends = sorted(u + gap[j] + d for j, ds in nearest.items() for d in ds)
        out[i] = (gap, u, ends[k] if len(ends) > k else math.inf)
    return out


def _numbers(vectors: pd.Series, exact: bool) -> np.ndarray:
    x = np.array(vectors.tolist(), np.float64)
    return x if exact else np.vectorize(int, otypes=[object])(x)


def _local(queries: pd.DataFrame, data: pd.DataFrame, k: int, exact: bool) -> pd.DataFrame:
    """The k best of a block for every query of the group; ties go to the smaller id. Without ``exact`` doubles, with
    Python's whole numbers."""
    if queries.empty or data.empty:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
    data = data.sort_values("id")
    ids, x = data["id"].to_numpy(), _numbers(data["v"], exact)
    asked, q = queries["id"].to_numpy(), _numbers(queries["v"], exact)
    out = []
    for at in range(0, len(q), SLAB_QUERIES):
        scores = q[at:at + SLAB_QUERIES] @ x.T
        for own, row in zip(asked[at:at + SLAB_QUERIES], scores):
            row[ids == own] = -np.inf
            floor = np.partition(row, -k)[-k] if len(row) > k else -np.inf
            best = np.flatnonzero(row > floor)
            best = np.concatenate([best, np.flatnonzero((row == floor) & (row > -np.inf))[:k - len(best)]])
            out.append((np.full(len(best), own), ids[best], row[best]))
    query, vec, score = (np.concatenate(c) for c in zip(*out))
    return pd.DataFrame({"query_id": query, "vec_id": vec, "score": score.astype("int64")})


def nearest_by_product(vectors: DataFrame, k: int, scale: int, query: F.Column) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` largest inner products of quantised vectors.

    Rows of ``vectors`` (vec_id long, embedding) for which ``query`` holds ask; all rows with other ids answer. Ties go to
    the smaller vec_id; a query gets all there are if there are fewer. Null vectors, those with null or non-finite
    components, and rows without vec_id take no part; vectors of another length than the query's do not answer it.
    Rows with equal vec_id and (quantised) vector are one; rows that repeat a vec_id with other vectors all answer, and all
    ask: such a query has the best answers to any of its vectors. An empty table gives an empty one. Scores are exact: with squared norms from 2^53 on they are
    computed with whole numbers of any size, and a score beyond 64 bits, or a norm beyond doubles, is an error.
    """
    rows = need(vectors, "vec_id", "embedding").select(
        F.col("vec_id").cast("long").alias("id"), quantised("embedding", scale).alias("v"), F.coalesce(query, F.lit(False)).alias("q"),
    ).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    rows = save(rows.groupBy("id", "v").agg(F.max("q").alias("q")), "quantised")
    by_length = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n")
    usual = [r["n"] for r in by_length.limit(LENGTHS + 1).collect()]
    parts = [_one_length(rows.where(F.size("v") == n), k) for n in usual[:LENGTHS]]
    if len(usual) > LENGTHS:
        parts.append(_rare_lengths(rows.where(~F.size("v").isin(usual[:LENGTHS])), by_length, k))
    if not parts:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.col("id").alias("score")).limit(0)
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def _top(rows: DataFrame) -> float:
    """The largest squared norm."""
    top = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0] or 0.0
    if not math.isfinite(top):
        raise ValueError("a vector's norm is beyond the range of doubles")
    return top


def _spread(blocks: Column) -> Column:
    """A block for every row; equal rows spread, too."""
    return F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), blocks).cast("int")


def _rare_lengths(rows: DataFrame, by_length: DataFrame, k: int) -> DataFrame:
    """Answers among the vectors of each length that few have: queries meet all blocks of their length."""
    exact = _top(rows) < EXACT
    sized = rows.withColumn("n", F.size("v")).join(by_length, "n").withColumn("blocks", F.ceil(F.col("rows") / BLOCK_ROWS).cast("long"))
    data = sized.select("n", "id", "v", _spread(F.col("blocks")).alias("s"))
    asked = save(sized.where("q").withColumn("g", _spread(F.ceil(F.col("rows") / GROUP_QUERIES).cast("long"))).select(
        "n", "g", "id", "v", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("s")), "rare-queries")
    data = save(data.join(asked.select("n", "g").distinct(), "n"), "rare-data")
    return asked.groupBy("n", "g", "s").cogroup(data.groupBy("n", "g", "s")).applyInPandas(
        lambda q, x: _local(q, x, k, exact), "query_id long, vec_id long, score long")


def _one_length(rows: DataFrame, k: int) -> DataFrame:
    n, top = rows.count(), _top(rows)
    # components of a norm below 2^31 fit short integers, which halves the shuffle
    exact, number = top < EXACT, "int" if top < 2.0**62 else "double"
    count = max(1, min(PIVOTS, math.isqrt(n) // 4))
    # any sample will do: answers do not depend on the pivots
    chosen = rows.orderBy(F.xxhash64("id", F.monotonically_increasing_id())).limit(count).select("v").collect()
    p = np.unique(np.array([r[0] for r in chosen], np.float64), axis=0)
    pivots = np.concatenate([p, np.sqrt(np.maximum(top - (p * p).sum(axis=1), 0))[:, None]], axis=1)
    data = save(_cells(rows.select("id", "v"), pivots, top, False), "cells")
    queries = save(_cells(rows.where("q").select("id", "v"), pivots, top, True), "query-cells")

    def smallest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = pd.DataFrame({"cell": [], "d": []})
        for batch in batches:
            kept = pd.concat([kept, batch]).sort_values("d").groupby("cell").head(k + 1)
        yield kept.astype({"cell": "int32", "d": "float64"})

    by_cell = Window.partitionBy("cell").orderBy("d")
    near = data.select("cell", "d").mapInPandas(smallest, "cell int, d double").withColumn(
        "r", F.row_number().over(by_cell)).where(F.col("r") <= k + 1)
    nearest: dict[int, list[float]] = {}
    for r in near.collect():
        nearest.setdefault(r["cell"], []).append(r["d"])
    cells = {r["cell"]: (r["u"], r["n"]) for r in queries.groupBy("cell").agg(F.max("d").alias("u"), F.count(F.lit(1)).alias("n")).collect()}
    bounds = _bounds(pivots, {i: u for i, (u, _) in cells.items()}, nearest, k)
    slack = 1e-6 * (1 + math.sqrt(top or 0))

    # cells of queries share a group until it is full; a large cell takes several groups
    groups, group, room = {}, -1, 0
    for i, (_, m) in sorted(cells.items()):
        need_groups = math.ceil(m / GROUP_QUERIES)
        if need_groups > 1 or m > room:
            first, group, room = group + 1, group + need_groups, GROUP_QUERIES if need_groups == 1 else 0
            groups[i] = list(range(first, group + 1))
        else:
            groups[i] = [group]
        room -= m
    users: dict[int, list[int]] = {}
    for i, gs in groups.items():
        for g in gs:
            users.setdefault(g, []).append(i)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Every data vector once for each group that may need it."""
        for batch in batches:
            cell, d = batch["cell"].to_numpy(), batch["d"].to_numpy()
            for g, members in users.items():
                wanted = np.zeros(len(batch), bool)
                for i in members:
                    gap, u, limit = bounds[i]
                    least = np.maximum(gap[cell] - u - d, d - gap[cell] - u)
                    wanted |= least <= limit + slack
                if wanted.any():
                    yield pd.DataFrame({"g": g, "id": batch["id"][wanted], "v": batch["v"][wanted]})

    blocks = max(1, math.ceil(n / BLOCK_ROWS))
    data = data.mapInPandas(spread, f"g int, id long, v array<{number}>")
    data = data.withColumn("s", _spread(F.lit(blocks)))
    table = F.create_map(*[F.lit(x) for i, gs in groups.items() for x in (i, gs)]) if groups else None
    if table is None:
        return rows.select(F.col("id").alias("query_id"), F.col("id").alias("vec_id"), F.col("id").alias("score")).limit(0)
    options = table[F.col("cell")]
    # a query has one group, chosen before it is copied to the blocks
    asked = queries.withColumn("g", F.element_at(options, _spread(F.size(options)) + 1)).select(
        "g", "id", "v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("s"))
    return asked.groupBy("g", "s").cogroup(data.groupBy("g", "s")).applyInPandas(
        lambda q, x: _local(q, x, k, exact), "query_id long, vec_id long, score long")
