"""Periodic runs of words: Lyndon arrays from the first phase of Baier's suffix sorter, roots extended into runs.

Baier's first phase groups suffixes by the longest Lyndon word at their start. Groups are taken from the highest to the
lowest; the members of a group are absorbed by the suffix before them that is not yet absorbed, whose Lyndon word grows
by theirs, so that it moves to a group just above its own. The word that a suffix has when its group's turn comes is the
longest Lyndon word there. Every run has a root among the Lyndon words of the order of the words or of the
opposite order; how far the run goes is the longest common extension of the root's place and the place one period later.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import need
from ledgerlens.llm.tokens import slices, split

MIN_LENGTH, MIN_EXPONENT = 24, 3
# how often a sequence is cut at words that no run can hold
CUTS = 8


def lyndon_lengths(codes: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at every place, in the order of the numbers ``codes``."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    cuts = np.flatnonzero(np.diff(codes[order])) + 1
    members = [part.tolist() for part in np.split(order, cuts)]
    group = [0] * n
    for g, part in enumerate(members):
        for i in part:
            group[i] = g
    size = [len(part) for part in members]
    below, above = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    out = [0] * n

    def raise_group(low: int, part: list[int]) -> None:
        """Move ``part`` of the group ``low`` to a new group right above it."""
        new, high = len(members), above[low]
        members.append(part)
        size.append(len(part))
        size[low] -= len(part)
        below.append(low)
        above.append(high)
        above[low] = new
        below[high] = new
        for p in part:
            group[p] = new

    g = len(members) - 1
    below.append(g)  # the end above all groups is only a sentinel: its number is that of a group to come
    members.append([])
    size.append(0)
    above.append(-1)
    while g >= 0:
        own = members[g]
        if len(own) != size[g]:
            own = [i for i in own if group[i] == g]
        for i in own:
            out[i] = after[i] - i
        grown: dict[tuple[int, int], list[int]] = {}
        for i in own:
            p = before[i]
            if p >= 0 and group[p] == g:
                continue
            times, j = 1, after[i]
            while j < n and group[j] == g:
                times, j = times + 1, after[j]
            if j < n:
                before[j] = p
            if p >= 0:
                after[p] = j
                if size[group[p]] > 1:
                    grown.setdefault((group[p], times), []).append(p)
        # more repeats are a higher group; the part that would empty a group stays in it
        for (low, _), part in sorted(grown.items(), key=lambda x: -x[0][1]):
            if len(part) < size[low]:
                raise_group(low, part)
        members[g] = []
        g = below[g]
    return np.array(out, np.int64)


def _agreeing(codes: np.ndarray, at: int, period: int, step: int) -> int:
    """From ``at`` on, in steps of ``step``, how many words equal the ones a period later: whole stretches at a time."""
    stretch, done = 32, 0
    room = len(codes) - period - at if step > 0 else at + 1
    while done < room:
        k = min(stretch, room - done)
        low = at + done if step > 0 else at - done - k + 1
        unequal = codes[low:low + k] != codes[low + period:low + period + k]
        if unequal.any():
            return done + int((unequal if step > 0 else unequal[::-1]).argmax())
        done, stretch = done + k, stretch * 2
    return done


def _runs(codes: np.ndarray, min_length: int, min_exponent: int) -> set[tuple[int, int, int]]:
    """(start, length, period) of every run of ``codes``."""
    n, found = len(codes), set()
    for ordered in (codes, -codes):
        roots = lyndon_lengths(ordered)
        # the first root of a run agrees with the next period in at least so many words
        check = min(max(min_length - 2 * q, (min_exponent - 2) * q) for q in range(1, min_length + 1))
        at = np.flatnonzero(roots * min_exponent <= n)
        for t in range(min(check, 16)):
            at = at[at + roots[at] + t < n]
            at = at[codes[at + t] == codes[at + roots[at] + t]]
        covered: dict[int, int] = {}
        for i, period in zip(at.tolist(), roots[at].tolist()):
            if i < covered.get(period, 0):
                continue
            stop = i + _agreeing(codes, i, period, 1)
            start = i - _agreeing(codes, i - 1, period, -1)
            covered[period] = stop
            length = stop + period - start
            if length >= max(min_length, min_exponent * period):
                found.add((start, length, period))
    return found


def word_runs(codes: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence, by start and period.

    A word of a run occurs again within a third (``1 / min_exponent``) of the run's length. So no run holds a word whose
    nearest equal ones are farther away than this share of the sequence, and the sequence is cut there first.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    near = np.full(n, n + 1, np.int64)
    same = codes[order][1:] == codes[order][:-1]
    gap = np.where(same, np.diff(order), n + 1)
    near[order[1:]] = gap
    near[order[:-1]] = np.minimum(near[order[:-1]], gap)
    parts = [(0, n)]
    for _ in range(CUTS):
        cut = []
        for a, b in parts:
            ok = np.concatenate([[False], near[a:b] * min_exponent <= b - a, [False]])
            edges = np.flatnonzero(ok[1:] != ok[:-1]) + a
            cut += [(x, y) for x, y in zip(edges[::2].tolist(), edges[1::2].tolist()) if y - x >= min_length]
        if cut == parts:
            break
        parts = cut
    found = [(a + start, length, q) for a, b in parts for start, length, q in _runs(codes[a:b], min_length, min_exponent)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """doc_id, runs (start, length, period, by start and period) and collapsed text of every row of ``docs``.

    ``docs`` needs doc_id and text; other columns are not read. Words are numbered from 0. A run is a stretch with a
    smallest period q and at least ``min_length`` and ``min_exponent`` times q words that no neighbour extends. ``collapsed`` joins
    the words that no run holds after its first q words with single spaces. A null or empty text has no run
    and an empty collapsed text. Rows with a null or repeated doc_id are documents of their own. An empty table gives an
    empty one. A task holds one slice of texts, or one longer text, at a time.
    """
    if min_length < 2 or min_exponent < 2:
        raise ValueError("a run has at least two words and two periods")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                words = split(part.column(1))
                found, keep = [], np.ones(len(words.codes), bool)
                for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
                    runs = word_runs(words.codes[a:b], min_length, min_exponent) if b - a >= min_length else []
                    for start, length, period in runs:
                        keep[a + start + period:a + start + length] = False
                    found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                ends = np.concatenate([[0], np.cumsum(keep)])[words.bounds]
                kept = words.vocabulary.take(pa.array(words.codes[keep]))
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), kept), pa.scalar(" ", kept.type))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(found, kind), joined.cast(pa.string())], ["doc_id", "runs", "collapsed"])

    rows = need(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(per_batch, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
