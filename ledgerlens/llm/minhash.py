"""Near-duplicate documents: MinHash signatures joined through an inverted index of their coordinates.

Every document's word shingles get a MinHash signature. A (coordinate, value) pair is a posting list of the
documents that have it. Two documents whose shingle sets have a Jaccard similarity ``s`` agree on a coordinate with
probability ``s``, so pairs with at least ``matches`` agreements are kept and then decided on the full sets.

* Equal sets first become one node with a number of its own, so copies cost one row each, and an id that is repeated
  with other texts has a node for each of its sets. Nodes become ids again when their links are known.
* Lists with one document cannot produce a pair. A document with fewer than ``matches`` longer lists is out.
* Prefix: with one global order of the lists, shortest first, two documents that agree on ``matches`` coordinates
  share a list among their first ``live - matches + 1``. Only these lists are merged.
* Skip: the other lists of a document, its longest ones (passages that many documents share), are never merged;
  they only count when a candidate's signature is compared.
* A list is not expanded into its pairs. Each of its documents is first compared with the list's smallest one.
  Documents that agree with it form families, documents that are linked to it form components. Inside a family only
  pairs of different components are left: they meet in blocks of bounded size whose links are counted as a
  matrix. Last come pairs of different families in one list. Every pair with enough agreements that no path of
  links joins is decided on the full sets.

With 64 coordinates and 32 matches a pair at a similarity of exactly 0.8 is missed with a probability below 1e-6;
more similar ones with less.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import need, own_name
from ledgerlens.llm.components import components
from ledgerlens.scratch import save

COORDINATES, MATCHES = 64, 32
WORDS, SIMILARITY = 5, 80

# odd multipliers: one for each word position, and two that mix the sum
_ODD = np.random.default_rng(7).integers(1, 2**63, 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = np.random.default_rng(11).integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.random.default_rng(13).integers(1, 2**63, COORDINATES, dtype=np.uint64)
_COORDINATE_BITS = 6
_CACHED_WORDS = 200_000
_CHUNK = 32_768
# documents of one chunk of a block, and shingles that are counted at a time
_CHUNK_DOCS, _SLAB = 256, 4_096


class _Hashes(dict):
    """64-bit hashes of words; frequent ones are computed once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, words: int, hashes: _Hashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; a shorter text is one shingle, no words none."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    width = min(words, len(codes))
    mixed = np.full(len(codes) - width + 1, width, np.uint64)
    for i in range(width):
        mixed += codes[i:len(codes) - width + 1 + i] * _ODD[i]
    mixed ^= mixed >> np.uint64(32)
    mixed *= _ODD[-1]
    mixed ^= mixed >> np.uint64(29)
    mixed *= _ODD[-2]
    return np.unique(mixed)


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of packed (coordinate, value) pairs for every non-empty set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), COORDINATES), np.uint64)
    for i in range(COORDINATES):
        out[:, i] = np.minimum.reduceat(flat * _A[i] + _B[i], starts)
    out >>= np.uint64(_COORDINATE_BITS)
    out |= np.arange(COORDINATES, dtype=np.uint64) << np.uint64(64 - _COORDINATE_BITS)
    return out.view(np.int64)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, two hashes of the text, n_shingles, two halves of a 128-bit hash of the set, and its signature (null for
    an empty set)."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(ids):
                sets, size, start = [], 0, at
                while at < len(ids) and size < _CHUNK:
                    sets.append(shingle_set(texts[at].as_py(), words, hashes))
                    size += len(sets[-1])
                    at += 1
                full = [s for s in sets if len(s)]
                rows = iter(_signatures(full) if full else ())
                prints = [np.frombuffer(blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays([
                    *[c.slice(start, at - start) for c in (ids, *batch.columns[2:])], pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()),
                    pa.array([next(rows) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ], ["doc_id", "h1", "h2", "n_shingles", "f1", "f2", "tokens"])

    return need(docs, "doc_id", "text").select("doc_id", "text", *_text_hashes()).mapInArrow(
        per_batch, "doc_id long, h1 long, h2 int, n_shingles long, f1 long, f2 long, tokens array<long>"
    )


def _text_hashes(one: str = "h1", other: str = "h2") -> list[Column]:
    """They tell the texts of one id apart."""
    return [F.xxhash64("text").alias(one), F.hash("text").alias(other)]


def _decide(pairs: DataFrame, texts: DataFrame, words: int, similarity: int) -> DataFrame:
    """The pairs (a, b) of ``pairs`` that reach the similarity on their full sets."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, left = _Hashes(), None, None
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                a, one, other = (batch.column(c)[i].as_py() for c in (0, 2, 3))
                if last != (a, one):
                    last, left = (a, one), shingle_set(one, words, hashes)
                right = shingle_set(other, words, hashes)
                same = len(np.intersect1d(left, right, assume_unique=True))
                if same and 100 * same >= similarity * (len(left) + len(right) - same):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    both = pairs.join(texts.toDF("b", "_other"), "b").join(texts.toDF("a", "_one"), "a")
    return both.select("a", "b", "_one", "_other").mapInArrow(per_batch, "a long, b long")


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, as a matrix, by slabs of the shingles that repeat."""
    ids, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    repeated = times > 1
    column = np.cumsum(repeated) - 1
    keep = repeated[inverse]
    owner, inverse = owner[keep], column[inverse[keep]]
    order = np.argsort(inverse, kind="stable")
    owner, inverse = owner[order], inverse[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(repeated.sum()), _SLAB):
        lo, hi = np.searchsorted(inverse, [start, start + _SLAB])
        slab = np.zeros((len(sets), _SLAB), np.float32)
        slab[owner[lo:hi], inverse[lo:hi] - start] = 1
        out += slab @ slab.T
    return out


def _block_links(block: pd.DataFrame, words: int, similarity: int) -> pd.DataFrame:
    """Links of one block between different components, as many as join them."""
    hashes = _Hashes()
    sets = [shingle_set(t, words, hashes) for t in block["text"]]
    same, size = _shared(sets), np.array([len(s) for s in sets])
    left, right = np.nonzero(np.triu(100.0 * same >= similarity * (size[:, None] + size[None, :] - same), 1))
    node, label, side = (block[c].tolist() for c in ("rep", "comp", "side"))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    found = []
    for i, j in zip(left.tolist(), right.tolist()):
        if same[i, j] and (side[i] != side[j] or side[i] == 0):
            a, b = root(label[i]), root(label[j])
            if a != b:
                parent[max(a, b)] = min(a, b)
                found.append((node[i], node[j]))
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def _live(reps: DataFrame, matches: int) -> DataFrame:
    """rep and its lists with at least two documents, shortest first: (df, token, first). At most one per coordinate."""
    posts = reps.select("rep", F.explode("tokens").alias("token"))
    lists = posts.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("rep").alias("first")).where("df > 1")
    live = posts.join(lists, "token").groupBy("rep").agg(
        F.array_sort(F.collect_list(F.struct("df", "token", "first"))).alias("lists")
    )
    return live.where(F.size("lists") >= matches)


def near_duplicates(
    docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY, matches: int = MATCHES,
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id that links lead to, itself included), kept.

    ``docs`` needs doc_id (long) and text; its other columns are not read. Two documents are linked if
    ``100 * |A & B| >= similarity * |A | B|`` for their sets of ``words``-word shingles. One row comes out for every
    row that goes in. A null or empty text, or one without words, has no shingles and no links. A row without
    doc_id takes no part in links: its component is null and it is kept. Rows that repeat an id are one document:
    what any of their texts links counts for all. An empty table gives an empty one.
    """
    sketch, nodes, links = _linked_sets(docs, words, similarity, matches)
    ids = nodes.select("node", "doc_id")
    named = links.join(ids.toDF("a", "_a"), "a").join(ids.toDF("b", "_b"), "b").select(
        F.col("_a").alias("a"), F.col("_b").alias("b"))
    # copies of a set are linked to its smallest id
    copies = _known(sketch).join(nodes.select("f1", "f2", F.col("doc_id").alias("_first")), ["f1", "f2"]).where(
        "doc_id <> _first").select(F.col("doc_id").alias("a"), F.col("_first").alias("b"))
    found = components(named.union(copies), "a", "b")
    out = sketch.select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def _known(sketch: DataFrame) -> DataFrame:
    return sketch.where("doc_id IS NOT NULL AND n_shingles > 0")


def _linked_sets(docs: DataFrame, words: int, similarity: int, matches: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sketches, nodes, links). A node is a distinct set: its number, hash, and first (doc_id, h1, h2). Links (a, b)
    join the node numbers of every component."""
    source = need(docs, "doc_id", "text")
    sketch = save(sketches(source, words), "sketches")
    known = _known(sketch)
    classes = known.groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "h1", "h2")).alias("at"))
    # written once: a second evaluation may number them otherwise
    nodes = save(classes.select(F.monotonically_increasing_id().alias("node"), "f1", "f2", "at.*"), "nodes")
    # the key holds the id, so a large group of copies is not one key here
    reps = known.join(nodes, ["f1", "f2", "doc_id", "h1", "h2"]).select(F.col("node").alias("rep"), "tokens")
    live = save(_live(reps.dropDuplicates(["rep"]), matches), "live")
    wanted = nodes.join(live.select(F.col("rep").alias("node")), "node", "left_semi")
    texts = source.select("doc_id", "text", *_text_hashes()).join(
        wanted.select("doc_id", "h1", "h2", F.col("node").alias("rep")), ["doc_id", "h1", "h2"])
    # a row that is repeated as it is counts once
    texts = texts.groupBy("doc_id", "h1", "h2", "rep").agg(F.first("text").alias("text")).select("rep", "text")
    return sketch, nodes, _links(texts, live, words, similarity, matches)


def without_near_duplicates(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each group of sets that links join: the one with the smallest id. Rows without
    doc_id stay. Rows that repeat an id are judged each by its own text: different texts of an id both stay, the same
    text, and texts without words, stay once."""
    sketch, nodes, links = _linked_sets(docs, words, similarity, MATCHES)
    group = F.coalesce("component_id", "node").alias("group")
    grouped = nodes.join(components(links, "a", "b"), "node", "left").select("f1", "f2", "doc_id", "h1", "h2", group)
    best = grouped.groupBy("group").agg(F.min(F.struct("doc_id", "h1", "h2")).alias("best"))
    best = grouped.select("f1", "f2", "group").join(best, "group").drop("group")
    at = F.struct("doc_id", "h1", "h2")
    gone = _known(sketch).join(best, ["f1", "f2"]).where(at != F.col("best")).select("doc_id", "h1", "h2")
    bare = sketch.where("doc_id IS NOT NULL AND n_shingles = 0").select("doc_id", "h1", "h2")
    first = bare.groupBy("doc_id").agg(F.min(at).alias("best"))
    gone = gone.union(bare.join(first, "doc_id").where(at != F.col("best")).select("doc_id", "h1", "h2"))
    one, other = own_name(docs, "_h1"), own_name(docs, "_h2")
    keys = ["doc_id", one, other]
    left = docs.select("*", *_text_hashes(one, other)).join(gone.distinct().toDF(*keys), keys, "left_anti")
    known = sketch.where("doc_id IS NOT NULL").groupBy("doc_id", "h1", "h2")
    if not known.agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        order = Window.partitionBy(*keys).orderBy("text", *[c for c in docs.columns if c not in ("doc_id", "text")])
        number = own_name(docs, "_number")
        once = left.where("doc_id IS NOT NULL").withColumn(number, F.row_number().over(order)).where(F.col(number) == 1)
        left = once.drop(number).union(left.where("doc_id IS NULL").select(*once.drop(number).columns))
    return left.select(*docs.columns)


def _links(texts: DataFrame, live: DataFrame, words: int, similarity: int, matches: int) -> DataFrame:
    """Verified links (a, b) between nodes that join every component. ``texts`` has rep and text, one row a live node."""
    prefix = F.slice("lists", 1, F.size("lists") - (matches - 1))
    tokens = live.select("rep", F.col("lists.token").alias("tokens"))
    texts = save(texts, "texts")

    # 1: every document against the smallest one of each of its prefix lists
    firsts = F.explode(F.array_distinct(F.transform(prefix, lambda x: x["first"])))
    stars = live.select(F.col("rep").alias("b"), firsts.alias("a")).where("a <> b")
    alike = save(
        stars.join(tokens.toDF("b", "_other"), "b").join(tokens.toDF("a", "_one"), "a")
        .where(F.size(F.array_intersect("_one", "_other")) >= matches).select("a", "b"), "alike")
    links = save(_decide(alike, texts, words, similarity), "links")

    # 2: inside a family (documents that agree, directly or along a path), pairs of different components
    family = save(components(alike, "a", "b").toDF("rep", "family"), "families")
    comp = components(links, "a", "b").toDF("rep", "comp")
    member = save(family.join(comp, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")), "members")
    inside = _blocks(member).join(texts, "rep")
    more = inside.groupBy("family", "i", "j").applyInPandas(
        lambda block: _block_links(block, words, similarity), "a long, b long")

    # 3: documents of different families that share a prefix list
    posts = live.select(
        "rep", F.explode(F.transform(prefix, lambda x: x["token"])).alias("token"), F.col("lists.token").alias("tokens"),
    ).join(family, "rep", "left").withColumn("family", F.coalesce("family", "rep"))
    mixed = posts.groupBy("token").agg(F.min("family").alias("_x"), F.max("family").alias("_y")).where("_x <> _y")
    posts = posts.join(mixed.select("token"), "token", "left_semi")
    one = posts.select("token", F.col("rep").alias("a"), F.col("tokens").alias("_one"), F.col("family").alias("_f"))
    other = posts.select("token", F.col("rep").alias("b"), F.col("tokens").alias("_other"), F.col("family").alias("_g"))
    agree = F.size(F.array_intersect("_one", "_other")) >= matches
    across = one.join(other, (one["token"] == other["token"]) & F.expr("a < b AND _f <> _g") & agree)
    across = save(across.select("a", "b").distinct(), "across")
    return links.union(save(more.union(_decide(across, texts, words, similarity)), "links"))


def _blocks(member: DataFrame) -> DataFrame:
    """(rep, comp, family, i, j, side): the blocks in which a document meets those of other components.

    A family's largest component is side 1: its documents meet only the others, never each other. Both parts are cut
    into chunks of about ``_CHUNK_DOCS`` documents, and a block holds one chunk of each or two of the others.
    """
    sizes = member.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("family").agg(
        F.max_by("comp", F.struct("n", "comp")).alias("largest"), F.max("n").alias("n_large"), F.sum("n").alias("n_all"),
    ).where("n_all > n_large")
    chunks = lambda n: F.ceil(n / F.lit(_CHUNK_DOCS)).cast("int")
    rows = member.join(sizes, "family").select(
        "family", "rep", "comp", (F.col("comp") == F.col("largest")).cast("int").alias("side"),
        chunks(F.col("n_all") - F.col("n_large")).alias("q"), chunks(F.col("n_large")).alias("p"),
    )
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("side") == 1, F.col("p")).otherwise(F.col("q"))).cast("int")
    rows = rows.withColumn("own", own)
    # side 1: chunk p of the largest component with every chunk q; written as (-1 - p, q)
    with_large = F.when(
        F.col("side") == 1,
        F.transform(F.sequence(F.lit(0), F.col("q") - 1), lambda j: F.struct((-1 - F.col("own")).alias("i"), j.alias("j"))),
    ).otherwise(F.concat(
        F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda i: F.struct((-1 - i).alias("i"), F.col("own").alias("j"))),
        F.transform(
            F.sequence(F.lit(0), F.col("q") - 1),
            lambda j: F.struct(F.least(j, F.col("own")).alias("i"), F.greatest(j, F.col("own")).alias("j"))),
    ))
    return rows.select("family", "rep", "comp", "side", F.explode(with_large).alias("_at")).select(
        "family", "rep", "comp", "side", "_at.i", "_at.j")
