"""Collocations: phrases whose words meet more often than chance, counted over a prefix-free parse.

A text's words, with a mark for every break between its pieces, are parsed into chunks: a window of ``OVERLAP`` words
whose hash is divisible by ``CHUNK_WORDS`` ends a chunk and starts the next, so that equal passages have equal chunks
wherever they stand. The dictionary holds every different chunk of a language with its frequency in the parse. Phrases
are counted inside the chunks of the dictionary, weighted; a phrase belongs to the chunk in which it starts before the
last ``OVERLAP`` words, so that overlaps count once. Longer phrases are counted only where both their shorter parts may
be frequent, as a Bloom filter of bounded size says; it has false positives only, so nothing is missed.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import need
from ledgerlens.llm.tokens import pack, slices, split, unpack
from ledgerlens.scratch import save

MAX_WORDS = 5
# words of a window; a phrase of one word more still lies in one chunk
OVERLAP = MAX_WORDS - 1
CHUNK_WORDS = 32
# breaks between pieces, and what else separates words
BREAKS, SPACES = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
BREAK = "\n"
UNKNOWN = "und"
# bits of the Bloom filter for every frequent phrase, and the most there ever are (8 MB)
BITS_PER_PHRASE, MAX_BITS = 16, 2**26


def _mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash: every bit of the input reaches every bit of the result."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _print(strings: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(s.encode()) for s in strings], np.uint64)


def _longer(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of phrases with one word more."""
    return _mixed(h * np.uint64(0x9E3779B97F4A7C15) + word + np.uint64(1))


def _probes(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(h % np.uint64(bits)).astype(np.int64), ((h >> np.uint64(20)) * np.uint64(0x9E3779B1) % np.uint64(bits)).astype(np.int64)]


def parse(docs: DataFrame, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """lang, chunk, last, freq: the dictionary of chunks with the frequencies of the parse.

    A chunk is its words, joined by single spaces, with a line feed for every break; ``last`` ones end a text.
    """

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                words = split(part.column(1), SPACES, BREAKS, lower=True)
                if not len(words.codes):
                    continue
                size, text = len(words.vocabulary), words.text
                inner = np.flatnonzero((text[1:] == text[:-1]) & (words.piece[1:] != words.piece[:-1])) + 1
                codes, text = np.insert(words.codes, inner, size), np.insert(text, inner, text[inner])
                vocabulary = pa.concat_arrays([words.vocabulary, pa.array([BREAK], words.vocabulary.type)])
                prints, n = _print(vocabulary.to_pylist())[codes], len(codes)
                h = np.zeros(max(0, n - OVERLAP + 1), np.uint64)
                for j in range(OVERLAP):
                    h = _longer(h, prints[j:j + len(h)])
                windows = np.flatnonzero((h % np.uint64(chunk_words) == 0) & (text[:len(h)] == text[OVERLAP - 1:]))
                begins = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
                starts = np.union1d(windows, begins)
                stops = np.append(starts[1:], n)
                last = np.isin(stops, np.append(begins, n))
                stops = np.where(last, stops, stops + OVERLAP)
                sizes = stops - starts
                edges = np.concatenate([[0], np.cumsum(sizes)])
                places = np.arange(edges[-1]) + np.repeat(starts - edges[:-1], sizes)
                spelt = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), vocabulary.take(pa.array(codes[places])))
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(text[starts])),
                    pc.binary_join(spelt, pa.scalar(" ", vocabulary.type)).cast(pa.string()), pa.array(last)], ["lang", "chunk", "last"])

    texts = need(docs, "lang", "text").select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    return texts.mapInArrow(per_batch, "lang string, chunk string, last boolean").groupBy("lang", "chunk", "last").agg(
        F.count(F.lit(1)).alias("freq"))


def numbered(chunks: DataFrame) -> DataFrame:
    """block: the dictionary in slices, as numbers into the words of each, so that the passes over it split no text."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = []
            for part in slices(batch, 1):
                found, lang = split(part.column(1), b" "), part.column(0).dictionary_encode()
                blocks.append(pack({
                    "codes": found.codes.astype(np.int32), "sizes": np.diff(found.bounds).astype(np.int32), "words": found.vocabulary,
                    "lang": lang.indices, "langs": lang.dictionary, "last": part.column(2), "freq": part.column(3)}))
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.binary())], ["block"])

    return chunks.select("lang", "chunk", "last", "freq").mapInArrow(per_batch, "block binary")


def count_phrases(blocks: DataFrame, words: int, shorter: np.ndarray | None) -> DataFrame:
    """lang, phrase, f: occurrences of the phrases of ``words`` words, combined in every slice of the dictionary.

    ``shorter`` is the Bloom filter of the phrases with a word less that are frequent. Of single words, all are
    counted, and the empty phrase stands for all of them together.
    """

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0):
                found = unpack(block)
                codes, sizes = found["codes"].to_numpy().astype(np.int64), found["sizes"].to_numpy()
                n, size, vocabulary, langs = len(codes), len(found["words"]), found["words"], found["langs"]
                chunk, ends = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes)
                plain = (pc.not_equal(vocabulary, pa.scalar(BREAK, vocabulary.type))).to_numpy(zero_copy_only=False)[codes]
                stop = np.where(found["last"].to_numpy(zero_copy_only=False), ends, ends - OVERLAP)[chunk]
                weight, lang = found["freq"].to_numpy()[chunk], found["lang"].to_numpy()[chunk].astype(np.int64)

                def whole(ok: np.ndarray, k: int) -> np.ndarray:
                    """Where ``k`` words stand in one piece of a chunk, given where ``k - 1`` do."""
                    out, m = np.zeros(n, bool), max(0, n - k + 1)
                    out[:m] = ok[:m] & plain[k - 1:] & (chunk[:m] == chunk[k - 1:])
                    return out

                ok = plain
                if shorter is not None:
                    prints = _print(vocabulary.to_pylist())[codes]
                    h = _longer(_print(langs.to_pylist())[lang], prints)
                    for k in range(2, words):
                        ok = whole(ok, k)
                        m = max(0, n - k + 1)
                        h[:m] = _longer(h[:m], prints[k - 1:])
                    for probe in _probes(h, len(shorter) * 64):
                        ok = ok & (shorter[probe >> 6] >> (probe & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
                    frequent, ok = ok, whole(ok, words)
                    ok[:n - 1] &= frequent[1:]
                at = np.flatnonzero(ok & (np.arange(n) < stop))
                if not len(at):
                    continue
                group = lang[at]
                for k in range(words):
                    group, different = pd.factorize(group * size + codes[at + k])
                first = np.empty(len(different), np.int64)
                first[group[::-1]] = np.arange(len(at))[::-1]
                f = np.bincount(group, weight[at]).astype(np.int64)
                edges = np.arange(0, len(first) * words + 1, words)
                used = codes[(at[first][:, None] + np.arange(words)).ravel()]
                names = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), vocabulary.take(pa.array(used)))
                rows = [langs.take(pa.array(lang[at[first]])), pc.binary_join(names, pa.scalar(" ", vocabulary.type)).cast(pa.string()), pa.array(f)]
                yield pa.RecordBatch.from_arrays(rows, ["lang", "phrase", "f"])
                if words == 1:
                    total = np.bincount(lang[at], weight[at], len(langs)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([langs, pa.array([""] * len(total)), pa.array(total)], ["lang", "phrase", "f"])

    return blocks.select("block").mapInArrow(per_batch, "lang string, phrase string, f long").groupBy(
        "lang", "phrase").agg(F.sum("f").alias("f"))


def bloom(phrases: DataFrame, entries: int) -> np.ndarray:
    """64-bit words of a Bloom filter of (lang, phrase); its size is bounded whatever the number of entries."""
    bits = min(MAX_BITS, 2 ** max(10, math.ceil(math.log2(max(1, entries * BITS_PER_PHRASE)))))

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [phrase.split(" ") for phrase in batch.column(1).to_pylist()]
            h = _print(batch.column(0).to_pylist())
            for k in range(len(rows[0]) if rows else 0):
                h = _longer(h, _print([words[k] for words in rows]))
            at = np.concatenate(_probes(h, bits))
            masks = np.uint64(1) << (at & 63).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(masks.view(np.int64))], ["place", "mask"])

    out = np.zeros(bits // 64, np.uint64)
    found = phrases.select("lang", "phrase").mapInArrow(per_batch, "place long, mask long").groupBy("place").agg(
        F.bit_or("mask").alias("mask")).toPandas()
    out[found["place"].to_numpy(np.int64)] = found["mask"].to_numpy(np.int64).view(np.uint64)
    return out


def collocations(
    docs: DataFrame, least: int = 100, top: int = 2_000, max_words: int = MAX_WORDS, covered: int = 100, chunk_words: int = CHUNK_WORDS,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of every language.

    ``docs`` needs lang and text; other columns are not read. Words have A-Z in lower case and are separated by spaces,
    tabs and breaks; no phrase crosses a break. A null language is ``und``, a null text is empty. ``n`` counts all words of
    the language, ``a`` the occurrences of the phrase (``least`` of them at least, 2 to ``max_words`` words). Cutting it after
    its first k words gives two parts that occur ``l`` and ``r`` times and a score of floor(1000 a n / (l r)); the cut with the
    lowest score counts, then that with the smallest k. A phrase inside a longer one that has at least ``covered``
    percent of its occurrences is dropped. Order: score and a descending, then the phrase's bytes. Repeated
    rows are texts of their own. An empty table gives an empty one.
    """
    if not 2 <= max_words <= MAX_WORDS:
        raise ValueError(f"phrases have 2 to {MAX_WORDS} words")
    blocks = save(numbered(parse(docs, chunk_words)), "chunks")
    frequent = save(count_phrases(blocks, 1, None).where((F.col("f") >= least) | (F.col("phrase") == "")), "phrases")
    totals = frequent.where("phrase = ''").select("lang", F.col("f").alias("n"))
    levels = [frequent.where(f"phrase <> '' AND f >= {int(least)}")]
    for words in range(2, max_words + 1):
        entries = levels[-1].count()
        if not entries:
            break
        levels.append(save(count_phrases(blocks, words, bloom(levels[-1], entries)).where(F.col("f") >= least), "phrases"))
    counted = levels[0].withColumn("words", F.lit(1))
    for i, level in enumerate(levels[1:]):
        counted = counted.union(level.withColumn("words", F.lit(i + 2)))

    candidates = counted.where("words > 1").withColumn("_w", F.split("phrase", " "))
    joined = lambda start, size: F.array_join(F.slice("_w", start, size), " ")
    cuts = candidates.select("lang", "phrase", "f", "words", "_w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "lang", "phrase", "f", "k", joined(F.lit(1), F.col("k")).alias("_left"), joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("_right"))
    left = counted.select("lang", F.col("phrase").alias("_left"), F.col("f").alias("l"))
    right = counted.select("lang", F.col("phrase").alias("_right"), F.col("f").alias("r"))
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    scored = cuts.join(left, ["lang", "_left"]).join(right, ["lang", "_right"]).join(totals, "lang").withColumn(
        "_up", (F.col("f") * 1000).cast("decimal(19,0)") * exact("n")).withColumn("_down", exact("l") * exact("r"))
    lowest = scored.groupBy("lang", "phrase", "f", "n").agg(
        F.min(F.struct(F.expr("_up div _down").alias("score"), F.col("k"), F.col("l"), F.col("r"))).alias("_cut"))

    inner = candidates.where("words > 2").select("lang", "f", "words", "_w", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("_n")).select(
        "lang", "f", "_w", "_n", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("_n") + 1)).alias("_at")).select(
        "lang", joined(F.col("_at"), F.col("_n")).alias("phrase"), "f")
    inside = inner.groupBy("lang", "phrase").agg(F.max("f").alias("_longer"))
    kept = lowest.join(inside, ["lang", "phrase"], "left").where(
        F.col("_longer").isNull() | (100 * F.col("_longer") < covered * F.col("f")))
    order = Window.partitionBy("lang").orderBy(F.desc("_cut.score"), F.desc("f"), "phrase")
    return kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top).select(
        "lang", "rank", "phrase", F.col("f").alias("a"), "_cut.l", "_cut.r", "n", "_cut.score")
