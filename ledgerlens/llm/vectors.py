"""Near-duplicate vectors: random-hyperplane sign hashing, exact cosines in buckets, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import need
from ledgerlens.llm.components import components
from ledgerlens.scratch import save

COSINE, MISS = 0.98, 1e-6
# unrelated vectors that a bucket is meant to hold
BUCKET = 256
# vectors in one chunk of a bucket; a block compares two chunks
CHUNK_VECTORS = 1_024
SEED = 17


def table_plan(rows: int, cosine: float, miss: float) -> tuple[int, int]:
    """(bits, tables): bits grow with the logarithm of the rows, so that buckets of unrelated vectors stay small;
    there are as many tables as it takes to miss a pair at ``cosine`` with a probability below ``miss``."""
    bits = max(4, math.ceil(math.log2(max(rows, 1) / BUCKET + 1)))
    same = (1 - math.acos(min(1.0, max(-1.0, cosine))) / math.pi) ** bits
    return bits, 1 if same >= 1 else math.ceil(math.log(miss) / math.log1p(-same))


def _planes(size: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, size]).standard_normal((size, bits * tables))


def _codes(vectors: DataFrame, bits: int, tables: int) -> DataFrame:
    """vec_id, label, embedding and its bucket in every table; codes are null for vectors that link with nothing."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            codes = []
            for x, label in zip(batch.column(1), batch.column(2)):
                x, code = x.as_py(), None
                if x and label.is_valid and None not in x:
                    v = np.array(x, np.float64)
                    top = np.abs(v).max()
                    if np.isfinite(top) and top > 0:
                        if len(x) not in planes:
                            planes[len(x)] = _planes(len(x), bits, tables)
                        code = ((v / top @ planes[len(x)] > 0).reshape(tables, bits) @ weights).tolist()
                codes.append(code)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(codes, pa.list_(pa.int64()))], ["vec_id", "embedding", "label", "codes"])

    return vectors.mapInArrow(per_batch, "vec_id long, embedding array<double>, label long, codes array<long>")


def _compare(block: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """For every vector of the block with a link: how many vectors it links with, and one vector of its component.

    A pair counts in the first table in which it shares a bucket.
    """
    i, j, table = (int(block[c].iloc[0]) for c in ("i", "j", "t"))
    x = np.array(block["embedding"].tolist(), np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    chunk, codes = block["chunk"].to_numpy(), np.array(block["codes"].tolist())
    hit = np.triu(x @ x.T >= cosine, 1)
    if i != j:
        hit &= chunk[:, None] != chunk[None, :]
    a, b = np.nonzero(hit)
    if table and len(a):
        seen = np.zeros(len(a), bool)
        for t in range(table):
            seen |= codes[a, t] == codes[b, t]
        a, b = a[~seen], b[~seen]
    if not len(a):
        return pd.DataFrame({"rep": [], "n": [], "root": []}, dtype="int64")
    copies = block["copies"].to_numpy()
    links = np.bincount(a, copies[b], len(x)) + np.bincount(b, copies[a], len(x))
    ids = block["rep"].to_numpy()
    root = np.arange(len(x))
    while True:  # hook every component to a neighbour, then shorten paths
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (shorter := new[new] != new).any():
            new[shorter] = new[new[shorter]]
        if (new == root).all():
            break
        root = new
    linked = links > 0
    return pd.DataFrame({"rep": ids[linked], "n": links[linked].astype("int64"), "root": ids[root[linked]]})


def near_vectors(vectors: DataFrame, cosine: float = COSINE, miss: float = MISS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id long, embedding, label integer).

    Vectors of one label and length are linked at a cosine of at least ``cosine``, in double precision. A null label,
    and a null, empty or zero vector or one with null or non-finite components, links with nothing. Equal vectors of a
    label are compared as one and counted as many. Rows without vec_id have no links, a null component, and are kept.
    Equal rows are one vector. Rows that repeat a vec_id with other vectors (or labels) are one node: their links are
    added up, those between them included. An empty table gives an empty one. Other columns are not read.
    """
    rows = need(vectors, "vec_id", "embedding", "label").select(
        F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.col("label").cast("long"))
    coded = save(_codes(rows, *table_plan(rows.count(), cosine, miss)), "codes")
    known = coded.where("vec_id IS NOT NULL AND codes IS NOT NULL").withColumn("print", F.sha2(F.to_json(F.struct("embedding")), 256))
    # every different vector of a label has a number of its own, as the rows of an id may hold several
    classes = save(known.groupBy("label", "print").agg(
        F.min("vec_id").alias("first"), F.countDistinct("vec_id").alias("copies"),
    ).withColumn("rep", F.monotonically_increasing_id()), "classes")
    reps = save(
        known.join(classes.withColumn("vec_id", F.col("first")), ["label", "print", "vec_id"])
        .dropDuplicates(["label", "print"]).select("rep", "copies", "label", "embedding", "codes"), "representatives")

    # buckets with one vector say nothing; large ones are cut into chunks
    places = reps.select("rep", "label", F.size("embedding").alias("d"), F.posexplode("codes").alias("t", "code"))
    key = ["label", "d", "t", "code"]
    buckets = places.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").withColumn(
        "chunks", F.ceil(F.col("_n") / F.lit(CHUNK_VECTORS)).cast("int"))
    placed = places.join(buckets, key).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    at = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda c: F.struct(F.least(c, "chunk").alias("i"), F.greatest(c, "chunk").alias("j")))
    placed = placed.select("rep", *key, "chunk", F.explode(at).alias("_at")).select("rep", "t", "code", "chunk", "_at.i", "_at.j")
    blocks = placed.join(reps.withColumn("d", F.size("embedding")), "rep")
    # blocks are small and many: a task takes the ones of its partition in their order
    block = [*key, "i", "j"]

    def per_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            names = batch[block].to_numpy()
            cuts = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
            starts = [0, *cuts.tolist()]
            done = [_compare(batch.iloc[a:b], cosine) for a, b in zip(starts, cuts.tolist())]
            rest = batch.iloc[starts[-1]:] if len(batch) else None
            if done:
                yield pd.concat(done)
        if rest is not None and len(rest):
            yield _compare(rest, cosine)

    found = save(
        blocks.repartition(*block).sortWithinPartitions(*block)
        .select(*block, "rep", "copies", "embedding", "codes", "chunk")
        .mapInPandas(per_partition, "rep long, n long, root long"), "vector-links")

    members = save(known.join(classes, ["label", "print"]).select("vec_id", "rep", "first", "copies").distinct(), "members")
    ends = classes.select("rep", "first")
    linked = found.select("rep", "root").where("rep <> root").distinct().join(ends.toDF("rep", "a"), "rep").join(ends.toDF("root", "b"), "root")
    edges = linked.select("a", "b").union(members.select("vec_id", "first"))
    others = found.groupBy("rep").agg(F.sum("n").alias("n"))
    links = members.join(others, "rep", "left").groupBy("vec_id").agg(
        F.sum(F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    labels = components(edges, "a", "b").withColumnRenamed("node", "vec_id")
    out = rows.select("vec_id").join(links, "vec_id", "left").join(labels, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
