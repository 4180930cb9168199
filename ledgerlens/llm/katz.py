"""Katz backoff language model of word pairs, and the log probability of every document.

``P(w | v)`` is the discounted count of the pair over the count of ``v`` if training has the pair, else the backoff
weight of ``v`` times ``P(w)``; ``P(w)`` is the discounted count over all tokens, and what the discounts leave is the
probability of one event, the unknown word. Discounts are Good-Turing's: ``r* = (r + 1) n(r + 1) / n(r)`` with ``n(r)`` from
the line that fits its logarithm, so that ``r* / r = (1 + 1 / r)^(slope + 1)`` is between 0 and 1 for every count. The backoff
weight is what a history's discounts leave, over the unigram probability of all that was not seen after it: the
probabilities after each history add up to 1.

A boundary ends every text and is the history of its first word. So the histories of a text are its tokens.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.tokens import pack, slices, split, unpack
from ledgerlens.scratch import save

# no word is empty
BOUNDARY = ""
# texts of a slice, as a part of SLICE_BYTES: a worker also holds the pairs of a slice, and some ten arrays as long as they are
SLICE_SHARE = 2
# pairs that one part of the tables gets
PART_PAIRS = 2_000_000
# pairs of a part that are counted at a time
PASS_PAIRS = 300_000
# rows of a part that go to Spark at a time: it holds them outside its heap
BATCH_ROWS = 2_000
# words with more than this share of all tokens are dealt to the parts pair by pair; there are at most 1 / share of them
HOT_SHARE = 1e-3
# counts of counts that the line is fitted to
FITTED = 100
# slope without at least two different counts, and the largest slope: a steeper line leaves more to unseen events
SLOPE, MAX_SLOPE = -2.0, -1.05


def fitted_slope(counts: list[tuple[int, int]]) -> float:
    """Slope of log n(r) over log r, each n(r) spread over the gap to the neighbouring counts."""
    counts = sorted(counts)
    if len(counts) < 2:
        return SLOPE
    r = np.array([c[0] for c in counts], float)
    n = np.array([c[1] for c in counts], float)
    low = np.concatenate([[0.0], r[:-1]])
    high = np.concatenate([r[1:], [2 * r[-1] - r[-2]]])
    return min(MAX_SLOPE, float(np.polyfit(np.log(r), np.log(2 * n / (high - low)), 1)[0]))


def discounted(count, slope: float):
    """Good-Turing's ``r*`` of counts."""
    return count * (1 + 1 / count) ** (slope + 1)


def counts_of_counts(table: DataFrame, count: Column) -> list[tuple[int, int]]:
    rows = table.select(count.alias("r")).where(F.col("r").between(1, FITTED)).groupBy("r").agg(F.count(F.lit(1)).alias("n"))
    return [(r["r"], r["n"]) for r in rows.collect()]


def release() -> None:
    """Gives back what Arrow freed and holds: Spark keeps its workers, and an idle one would keep that memory."""
    pa.default_memory_pool().release_unused()


def squeeze(*columns: np.ndarray) -> bytes:
    """Columns of numbers from 0 on, without the head of an Arrow message: there are many short ones.

    A column takes as few bytes a number as its largest one needs, first bytes before second ones.
    """
    columns = [c.astype(np.min_scalar_type(int(c.max(initial=0)))) for c in columns]
    head = np.array([len(columns), *(x for c in columns for x in (len(c), c.itemsize))], np.int64)
    raw = b"".join([head.tobytes(), *(c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns)])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unsqueeze(block: pa.Buffer) -> list[np.ndarray]:
    size = int.from_bytes(block.slice(0, 8).to_pybytes(), "little")
    raw = np.frombuffer(pa.decompress(block.slice(8), size, "zstd"), np.uint8)
    at = 8 * (1 + 2 * int(raw[:8].view(np.int64)[0]))
    columns = []
    for length, width in raw[8:at].view(np.int64).reshape(-1, 2).tolist():
        columns.append(raw[at:at + length * width].reshape(width, length).T.copy().view(f"u{width}").ravel())
        at += length * width
    return columns


def spelt(words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and bytes of strings."""
    _, places, blob = words.buffers()
    ends = np.frombuffer(places, np.int64)[words.offset:words.offset + len(words) + 1]
    return np.diff(ends), np.frombuffer(blob, np.uint8)[ends[0]:ends[-1]] if blob else np.zeros(0, np.uint8)


def strings(lengths: np.ndarray, blob: np.ndarray) -> pa.LargeStringArray:
    ends = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=ends[1:])
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(ends), pa.py_buffer(blob))


@dataclass
class Unigrams:
    """Totals of the words: tokens, distinct words, slope of the discounts, probability of the unknown word."""

    tokens: int
    distinct: int
    slope: float
    unknown: float


def sliced(docs: DataFrame, train: Column) -> DataFrame:
    """slice, block: the documents, some megabytes of text together, as numbers into the words of the slice.

    The words are in order, so the boundary is word 0. Written once: a slice's number and content are fixed from here on.
    """

    def block(part: pa.RecordBatch) -> bytes:
        found = split(part.column(2), lower=True)
        order = pc.sort_indices(found.vocabulary).to_numpy()
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(1, len(order) + 1)
        ends = np.diff(found.bounds) + 1
        words = pa.concat_arrays([pa.array([BOUNDARY], found.vocabulary.type), found.vocabulary.take(pa.array(order))])
        codes = np.insert(rank[found.codes], found.bounds[1:], 0)
        return pack({
            "doc_id": part.column(0), "train": part.column(1), "tokens": ends.astype(np.int32),
            "texts": np.frombuffer(squeeze(codes, *spelt(words)), np.uint8),
        })

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, SLICE_SHARE):
                yield pa.RecordBatch.from_arrays([pa.array([block(part)], pa.binary())], ["block"])
                release()

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(train, F.lit(False)).alias("train"), "text")
    return save(rows.mapInArrow(per_batch, "block binary").withColumn("slice", F.monotonically_increasing_id()), "slices")


class Slice:
    """A slice of documents, and its different pairs of words, each in the part of the tables that it belongs to."""

    def __init__(self, block: pa.Scalar, parts: int = 1, hot: frozenset[str] = frozenset()) -> None:
        found = unpack(block)
        codes, *words = unsqueeze(pa.py_buffer(found["texts"].to_numpy()))
        self.doc_id, self.words, self.codes = found["doc_id"], strings(*words), codes.astype(np.int32)
        self.tokens, self.train = found["tokens"].to_numpy(), found["train"].to_numpy(zero_copy_only=False)
        self.learnt = np.repeat(self.train, self.tokens)
        self.parts, self.hot = parts, hot

    def pair_up(self) -> None:
        """The boundary before a text is that of the text before."""
        size = len(self.words)
        pairs = self.codes * np.int64(size)
        pairs[1:] += self.codes[:-1]
        pairs, self.at = np.unique(pairs, return_inverse=True)
        self.w, self.v = pairs // size, pairs % size
        words = self.words.to_pylist()
        place = np.array([zlib.crc32(s.encode()) for s in words], np.int64)
        hot = np.array([s in self.hot for s in words])
        part = (place[self.w] + np.where(hot[self.w], place[self.v] * 31 + 7, 0)) % self.parts
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(self.parts + 1))
        # the pairs of every part, by word and history
        self.of_part = {p: order[cuts[p]:cuts[p + 1]] for p in np.flatnonzero(np.diff(cuts)).tolist()}


def vocabulary(blocks: DataFrame) -> DataFrame:
    """word, count in training; the boundary is the empty word."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0):
                own = Slice(block)
                count = np.bincount(own.codes[own.learnt])
                seen = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays(
                    [own.words.take(pa.array(seen)).cast(pa.string()), pa.array(count[seen], pa.int64())], ["word", "count"])

    return blocks.select("block").mapInArrow(per_batch, "word string, count long").groupBy("word").agg(F.sum("count").alias("count"))


def unigrams(words: DataFrame) -> Unigrams:
    tokens, distinct = words.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1))).first()
    slope = fitted_slope(counts_of_counts(words, F.col("count")))
    if not tokens:
        return Unigrams(0, 0, slope, 1.0)
    left = words.agg(F.sum(F.col("count") - F.col("count") * F.pow(1 + 1 / F.col("count"), F.lit(slope + 1)))).first()[0]
    return Unigrams(tokens, distinct, slope, left / tokens)


def _asked(blocks: DataFrame, parts: int, hot: frozenset[str]) -> DataFrame:
    """part, slice, block: the different pairs of a slice that belong to a part of the tables, and their counts in training.

    A block has the words, how many pairs each has, the histories, and of every pair, by word, the place of its history and its count.
    """

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, block in zip(batch.column(0), batch.column(1)):
                own = Slice(block, parts, hot)
                own.pair_up()
                n = np.bincount(own.at[own.learnt], minlength=len(own.w))
                asked = []
                for pairs in own.of_part.values():
                    w, w_pairs = np.unique(own.w[pairs], return_counts=True)
                    v, v_at = np.unique(own.v[pairs], return_inverse=True)
                    asked.append(squeeze(
                        *spelt(own.words.take(pa.array(w))), w_pairs, *spelt(own.words.take(pa.array(v))), v_at, n[pairs]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(own.of_part), pa.int32()), pa.array([number.as_py()] * len(asked), pa.int64()), pa.array(asked, pa.binary())],
                    ["part", "slice", "block"])
                del own, n, asked
                release()

    return blocks.select("slice", "block").mapInArrow(per_batch, "part int, slice long, block binary")


TABLES = pa.schema([
    ("kind", pa.string()), ("word", pa.string()), ("count", pa.int64()), ("histories", pa.list_(pa.string())),
    ("counts", pa.list_(pa.int64())), ("part", pa.int32()), ("slice", pa.int64()), ("block", pa.binary())])
TABLES_DDL = "kind string, word string, count long, histories array<string>, counts array<long>, part int, slice long, block binary"


def _rows(kind: str, size: int, given: dict[str, pa.Array]) -> pa.Table:
    given = given | {"kind": pa.array([kind] * size, pa.string())}
    return pa.table({f.name: given[f.name].cast(f.type) if f.name in given else pa.nulls(size, f.type) for f in TABLES})


def _part(group: pa.Table, hot: dict[str, int]) -> pa.Table:
    """A part of the tables: a row for each of its words, and for each slice the counts that it asked for."""
    asked = [unsqueeze(b.as_buffer()) for b in group.column("block").combine_chunks()]
    sizes, places, n = [a[2] for a in asked], [a[5] for a in asked], np.concatenate([a[6] for a in asked])

    def joined(k: int) -> tuple[list[np.ndarray], pa.Array]:
        """Of every block, the places of its strings among those of all blocks; and these."""
        coded = pa.concat_arrays([strings(a[k], a[k + 1]) for a in asked]).dictionary_encode()
        return np.split(coded.indices.to_numpy(), np.cumsum([len(a[k]) for a in asked])[:-1]), coded.dictionary

    asked_words, words = joined(0)
    asked_histories, histories = joined(3)
    del asked
    edges = np.cumsum([0] + [len(x) for x in places])
    passes = math.ceil(edges[-1] / PASS_PAIRS)
    keys, turn = np.empty(edges[-1], np.int64), np.empty(edges[-1], np.int32)
    for w, size, v, place, s, e in zip(asked_words, sizes, asked_histories, places, edges, edges[1:]):
        keys[s:e] = np.repeat(w, size)
        turn[s:e] = keys[s:e] % passes
        keys[s:e] *= len(histories)
        keys[s:e] += v[place]
    del sizes, places, asked_histories

    count = np.zeros(len(words), np.int64)
    known = pc.index_in(pa.array(list(hot), words.type), words).to_pylist()
    total = {at: n for at, n in zip(known, hot.values()) if at is not None}
    found, both = [], np.empty(len(keys), np.int64)
    for k in range(passes):
        mine = np.flatnonzero(turn == k)
        pairs, at = np.unique(keys[mine], return_inverse=True)
        sums = np.bincount(at, n[mine], len(pairs)).astype(np.int64)
        both[mine] = sums[at]
        owners, history = np.divmod(pairs, len(histories))
        count += np.bincount(owners, sums, len(words)).astype(np.int64)
        for at in total:
            count[at] = total[at]
        kept = np.flatnonzero(sums)
        owners, first = np.unique(owners[kept], return_index=True)
        ends = pa.array(np.append(first, len(kept)), pa.int32())
        before = histories.take(pa.array(history[kept])).cast(pa.string())
        found.append(_rows("gram", len(owners), {
            "word": words.take(pa.array(owners)), "count": pa.array(count[owners]),
            "histories": pa.ListArray.from_arrays(ends, before), "counts": pa.ListArray.from_arrays(ends, pa.array(sums[kept]))}))
    answers = [squeeze(count[x], both[s:e]) for x, s, e in zip(asked_words, edges, edges[1:])]
    found.append(_rows("answer", len(answers), {
        "part": group.column("part").combine_chunks(), "slice": group.column("slice").combine_chunks(), "block": pa.array(answers, pa.binary())}))
    return pa.Table.from_batches(pa.concat_tables(found).to_batches(BATCH_ROWS), TABLES)


def _held_out(blocks: DataFrame) -> DataFrame:
    """slice, word: the histories of the documents that the model does not learn from."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, block in zip(batch.column(0), batch.column(1)):
                own = Slice(block)
                used = np.unique(own.codes[~own.learnt])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number.as_py()] * len(used), pa.int64()), own.words.take(pa.array(used)).cast(pa.string())], ["slice", "word"])

    return blocks.select("slice", "block").mapInArrow(per_batch, "slice long, word string")


def _scores(own: Slice, answers: pa.Table, about: Unigrams, slope: float) -> pa.Table:
    """A row for every document of the slice, from the counts and weights that answer it."""
    own.pair_up()
    count, both = np.zeros(len(own.words), np.int64), np.zeros(len(own.w), np.int64)
    weight = np.ones(len(own.words))
    told = answers.filter(pc.is_valid(answers.column("part")))
    for part, block in zip(told.column("part").to_pylist(), told.column("block").combine_chunks()):
        pairs = own.of_part[part]
        count[np.unique(own.w[pairs])], both[pairs] = unsqueeze(block.as_buffer())
    weights = answers.filter(pc.is_valid(answers.column("word")))
    weight[pc.index_in(weights.column("word").combine_chunks(), own.words.cast(pa.string())).to_numpy()] = weights.column("weight").to_numpy()

    known = count > 0
    single = np.where(known, discounted(np.maximum(count, 1), about.slope) / max(about.tokens, 1), about.unknown)
    seen, least = both > 0, np.maximum(both, 1)
    pair = np.where(seen, discounted(least, slope) / np.maximum(count[own.v], 1), weight[own.v] * single[own.w])
    base = np.log10((count + 0.1) / (about.tokens + 0.1 * (about.distinct + 1)))
    starts = np.cumsum(own.tokens) - own.tokens

    def per_doc(tokens: np.ndarray) -> pa.Array:
        return pa.array(np.add.reduceat(tokens, starts) if len(starts) else tokens)

    return pa.table({
        "doc_id": own.doc_id, "held_out": pa.array(~own.train), "n_tokens": pa.array(own.tokens, pa.int64()),
        "n_known": per_doc(known[own.codes].astype(np.int64)), "base_score": per_doc(base[own.codes]), "score": per_doc(np.log10(pair)[own.at])})


def histories(grams: DataFrame, about: Unigrams, slope: float) -> DataFrame:
    """history, total (its count) and weight (its backoff weight) of every history of training."""
    tokens, star = max(about.tokens, 1), lambda c, b: c * F.pow(1 + 1 / c, F.lit(b + 1))
    pairs = grams.select(
        (star(F.col("count"), about.slope) / tokens).alias("p"), F.explode(F.arrays_zip("histories", "counts")).alias("_h"))
    count = F.col("_h.counts")
    per = pairs.groupBy(F.col("_h.histories").alias("history")).agg(
        F.sum(count).alias("total"), F.sum(star(count, slope)).alias("kept"), F.sum("p").alias("p"))
    return per.select("history", "total", ((1 - F.col("kept") / F.col("total")) / (1 - F.col("p"))).alias("weight"))


@dataclass
class Model:
    """The tables of a corpus: words and their pairs (``grams``), histories, and what the fit says about single words."""

    grams: DataFrame
    histories: DataFrame
    about: Unigrams
    slope: float


def score_corpus(docs: DataFrame, train: Column) -> tuple[DataFrame, Model]:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``; the model).

    ``docs`` needs doc_id and text; other columns are only read by ``train``, which says of every row whether the model
    learns from it (null: it does not). Tokens are the words of the text with A-Z in lower case, and the boundary: a null
    or empty text is the boundary alone. Scores are base-10 logarithms. Rows with a null or repeated doc_id are documents
    of their own. Without training rows every word is unknown and ``score`` is 0. An empty table gives an empty one.

    Pairs are counted, and tokens scored, in parts dealt by the word (hot words: by the pair); a pair is one entry of a
    text, however often it occurs. A token whose pair training lacks backs off through its history's row.
    """
    blocks = sliced(docs, train)
    words = save(vocabulary(blocks), "vocabulary")
    about = unigrams(words)
    hot = {r["word"]: r["count"] for r in words.where(F.col("count") > HOT_SHARE * about.tokens).collect()}
    parts = max(1, math.ceil(about.tokens / PART_PAIRS))
    asked = _asked(blocks, parts, frozenset(hot))

    def per_part(group: pa.Table) -> pa.Table:
        release()
        return _part(group, hot)

    # one folder for both kinds: folders for each would have every task sort its rows by kind
    tables = save(asked.groupBy("part").applyInArrow(per_part, TABLES_DDL), "katz")
    grams = tables.where("kind = 'gram'").select("word", "count", "histories", "counts")
    slope = fitted_slope(counts_of_counts(grams.select(F.explode("counts").alias("count")), F.col("count")))
    model = Model(grams, save(histories(grams, about, slope), "histories"), about, slope)

    weights = _held_out(blocks).join(model.histories.select(F.col("history").alias("word"), "weight"), "word")
    answers = tables.where("kind = 'answer'").select("slice", "part", "block").unionByName(weights, allowMissingColumns=True)

    def per_slice(own: pa.Table, answers: pa.Table) -> pa.Table:
        release()
        block = own.column("block").combine_chunks()[0]
        return _scores(Slice(block, parts, frozenset(hot)), answers, about, slope)

    scored = blocks.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(
        per_slice, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(about.tokens).cast("long").alias("train_tokens"), "base_score", "score"), model
