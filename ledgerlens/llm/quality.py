"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

Random Fourier features approximate a Gaussian kernel on the standardised statistics. Partitions sum the normal
equations, the driver solves one small system, and a monotone curve from held-back rows turns its output into a share
of label 1.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import need
from ledgerlens.scratch import save

STATISTICS = (
    "log_chars", "log_words", "word_length", "letters", "upper", "digits", "marks", "symbols", "bars", "spaces", "other_script",
    "distinct_words", "most_common_word", "repeated_neighbours", "log_lines", "line_length", "distinct_lines",
    "words_with_symbols", "upper_words",
)
FOURIER, RIDGE, BANDWIDTH, SEED = 320, 1e-3, 1.0, 5
CURVE_BINS = 1_024
THRESHOLD = 0.3
MARKS, SYMBOLS = ".,;:!?'\"()-", "#$%&*+/<=>@[\\]^_`{}~"


def _classes() -> np.ndarray:
    """Class of every code point of the basic plane: 0 other, 1 lower or caseless letter, 2 upper, 3 digit, 4 mark, 5 symbol, 6 bar, 7 space."""
    out = np.zeros(0x10000, np.uint8)
    for i in range(0x10000):
        c = chr(i)
        out[i] = (
            4 if c in MARKS else 5 if c in SYMBOLS else 6 if c == "|" else 7 if c.isspace() else 3 if c.isdigit()
            else 2 if c.isupper() else 1 if c.isalpha() else 0)
    return out


def statistics(text: str | None, classes: np.ndarray) -> list[float]:
    """Statistics of a whole text; all zero for a null or empty one."""
    if not text:
        return [0.0] * len(STATISTICS)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = classes[np.minimum(codes, 0xFFFF)]
    share = np.bincount(kind, minlength=8) / len(codes)
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    counts = Counter(words)
    pairs = sum(map(str.__eq__, words, words[1:]))
    # a symbol behind a letter: words with something stuck to them
    stuck = np.count_nonzero((kind[1:] >= 5) & (kind[1:] <= 6) & (kind[:-1] >= 1) & (kind[:-1] <= 4)) if len(kind) > 1 else 0
    shouted = sum(map(str.isupper, words))
    return [
        np.log1p(len(codes)), np.log1p(len(words)), np.log1p(len(codes) / n), share[1] + share[2], share[2], share[3], share[4],
        share[5], share[6], share[7], share[0], len(counts) / n, max(counts.values(), default=0) / n, pairs / n,
        np.log1p(len(lines)), np.log1p(len(codes) / len(lines)), len(set(lines)) / len(lines), stuck / n, shouted / n,
    ]


def statistics_of(docs: DataFrame) -> DataFrame:
    """``docs`` with the array ``x`` of statistics in place of text."""
    kept = [c for c in docs.columns if c not in ("text", "x")]

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = _classes()
        for batch in batches:
            rows = [statistics(t.as_py(), classes) for t in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, pa.list_(pa.float64()))], [*kept, "x"])

    kind = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in kept)
    return docs.select(*[f"`{c}`" for c in kept], "text").mapInArrow(per_batch, kind + "x array<double>")


@dataclass
class Model:
    """Standardisation, Fourier features, ridge weights and the calibration curve."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None = None
    curve: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.waves + self.phases
        return np.concatenate([np.cos(z) * np.sqrt(2 / len(self.phases)), np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), *self.curve)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of the monotone curve that fits the means ``y`` of ``n`` rows at ``x`` best."""
    blocks: list[list[float]] = []
    for a, b, w in zip(x, y, n):
        blocks.append([a * w, b * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(rows: DataFrame, fourier: int = FOURIER, ridge: float = RIDGE, bandwidth: float = BANDWIDTH, seed: int = SEED) -> Model | None:
    """A model from rows of ``x`` (statistics), ``y`` (0 or 1) and ``curve`` (true: only for the calibration).

    None if there are no rows to learn from. All rows are used; what reaches the driver depends on the number of
    features, not on that of the rows.
    """
    d = len(STATISTICS)
    moments = rows.agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("y"),
        *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(d)], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(d)],
    ).first()
    if not moments["n"]:
        return None
    random = np.random.default_rng(seed)
    mean, scale = (np.array([moments[f"{p}{i}"] for i in range(d)]) for p in "ms")
    # the median squared distance of standardised rows is about 2 d
    waves = random.standard_normal((d, fourier)) / (bandwidth * np.sqrt(d))
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), waves, random.uniform(0, 2 * np.pi, fourier))

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = fourier + 1
        left, right = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                z = model.features(np.array(batch.column(0).to_pylist()))
                left += z.T @ z
                right += z.T @ np.array(batch.column(1).to_pylist(), float)
        cells = np.concatenate([left[np.triu_indices(size)], right])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells)], ["cell", "value"])

    size = fourier + 1
    cells = np.zeros(size * (size + 1) // 2 + size)
    sums = rows.where("NOT curve").select("x", "y").mapInArrow(equations, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    for r in sums.collect():
        cells[r["cell"]] = r["value"]
    left = np.zeros((size, size))
    left[np.triu_indices(size)] = cells[:-size]
    left = left + np.triu(left, 1).T
    used = max(1.0, left[-1, -1])
    penalty = np.full(size, ridge * used)
    penalty[-1] = 1e-9 * used
    model.weights = np.linalg.solve(left + np.diag(penalty), cells[-size:])

    def outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.raw(np.array(batch.column(0).to_pylist()).reshape(-1, d))
            at = np.floor(np.clip((raw + 0.5) / 2, 0, 1 - 1e-9) * CURVE_BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw), batch.column(1)], ["at", "raw", "y"])

    curve = rows.where("curve").select("x", F.col("y").cast("double")).mapInArrow(outputs, "at int, raw double, y double")
    points = sorted(
        (r["at"], r["raw"], r["y"], r["n"]) for r in curve.groupBy("at").agg(
            F.avg("raw").alias("raw"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).collect())
    if points:
        model.curve = isotonic(*(np.array(c, float) for c in list(zip(*points))[1:]))
    else:
        model.curve = (np.array([0.0]), np.array([float(moments["y"])]))
    return model


def filter_texts(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, unchanged; without a model, all."""
    if model is None:
        return docs
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, learnt = _classes(), shared.value
        for batch in batches:
            if batch.num_rows:
                x = np.array([statistics(t.as_py(), classes) for t in batch.column(at)])
                yield batch.filter(pa.array(np.clip(learnt.score(x), 0, 1) >= threshold))

    return docs.mapInArrow(per_batch, docs.schema)


def score(stats: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """``stats`` with score (0 to 1) and predicted (1 from ``threshold`` on) in place of ``x``; without a model the score is 0.5."""
    kept = [c for c in stats.columns if c not in ("x", "score", "predicted")]
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt = shared.value
        for batch in batches:
            x = np.array(batch.column(len(kept)).to_pylist()).reshape(-1, len(STATISTICS))
            y = np.clip(learnt.score(x), 0, 1) if learnt else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(y, pa.float64()), pa.array((y >= threshold).astype(np.int32))], [*kept, "score", "predicted"])

    kind = "".join(f"`{c}` {stats.schema[c].dataType.simpleString()}, " for c in kept)
    return stats.select(*[f"`{c}`" for c in kept], "x").mapInArrow(per_batch, kind + "score double, predicted int")


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """x, y and curve of the rows of ``stats`` (doc_id, x) that ``labels`` (doc_id, quality) marks 0 or 1.

    A document with several labels counts once with each. A fourth of the documents draws the calibration curve.
    """
    marks = need(labels, "doc_id", "quality").where("quality IN (0, 1)").dropDuplicates(["doc_id", "quality"])
    curve = F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(4)) == 0
    return need(stats, "doc_id", "x").join(marks, "doc_id").select("x", F.col("quality").cast("double").alias("y"), curve.alias("curve"))


def classify(docs: DataFrame, labels: DataFrame, learn, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (doc_id, text and other columns) with score and predicted in place of text.

    Learns from the rows for which the condition ``learn`` holds and that ``labels`` marks. A null text counts as an empty one,
    and an empty one has a score like any other. Rows with a null doc_id are scored, but teach nothing; repeated rows teach as
    often as they occur. Empty tables give empty ones, and without labels every score is 0.5.
    """
    stats = save(statistics_of(docs), "statistics")
    model = fit(labelled(stats.where(learn), labels))
    return score(stats, model, threshold)
