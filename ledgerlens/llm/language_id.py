"""Language identification: nearest of several centroids per language, with rejection by distance.

A text is a vector of hashed letter n-grams (one to three letters, word boundaries included), weighted by
(1 + log tf) * idf and normalised. Each language has several centroids, found by spherical k-means. The nearest centroid by
cosine gives the language, unless even that one is too far away.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import need

FEATURES = 4_096
CENTROIDS, ROUNDS = 4, 10
# the k-means of a language uses about so many of its documents, chosen by a hash of their ids
SAMPLE_PER_LANGUAGE = 2_000
MAX_LANGUAGES = 1_000
# a text whose nearest centroid has a lower cosine is of no known language
MIN_COSINE = 0.05
# a learned limit is this share of a low quantile of the cosines that labelled texts have with the centroids of others
QUANTILE, MARGIN = 0.01, 0.65
# with fewer such texts a language takes the lowest limit of the other ones
LEAST_TEXTS = 20
UNKNOWN = "und"
_ROWS = 256
_MULTIPLIERS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def _letters() -> np.ndarray:
    """For every code point of the basic plane: itself if it is a letter, else a space."""
    return np.array([i if chr(i).isalpha() else 32 for i in range(0x10000)], np.uint32)


def ngram_counts(text: str | None, letters: np.ndarray) -> np.ndarray | None:
    """Counts of the hashed n-grams of the whole text; None without a letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    high = codes > 0xFFFF
    plain = letters[np.where(high, 32, codes)]
    if high.any():
        plain = np.where(high & np.isin(codes, [c for c in np.unique(codes[high]) if chr(c).isalpha()]), codes, plain)
    space = plain == 32
    if space.all():
        return None
    keep = ~(space & np.append(True, space[:-1]))
    a = plain[keep].astype(np.uint32)
    shift = np.uint32(32 - FEATURES.bit_length() + 1)
    h = a * _MULTIPLIERS[0]
    pairs = h[:-1] ^ (a[1:] * _MULTIPLIERS[1])
    triples = pairs[:-1] ^ (a[2:] * _MULTIPLIERS[2])
    out = np.zeros(FEATURES, np.int64)
    for i, grams in enumerate((h, pairs, triples)):
        mixed = (grams ^ (grams >> np.uint32(15))) * _MULTIPLIERS[i]
        out += np.bincount(mixed >> shift, minlength=FEATURES)
    return out


def _vectors(counts: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    x = np.stack(counts).astype(np.float32)
    np.log(x, out=x, where=x > 0)
    x += np.stack([c > 0 for c in counts])
    x *= idf
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _spherical_k_means(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Centroids of unit length; starts with the vector nearest to the mean and then the farthest ones."""
    mean = x.mean(axis=0)
    chosen = [int((x @ mean).argmax())]
    near = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    centres = x[chosen].copy()
    for _ in range(rounds):
        owner = (x @ centres.T).argmax(axis=1)
        for j in range(len(centres)):
            if (owner == j).any():
                centre = x[owner == j].sum(axis=0)
                centres[j] = centre / np.linalg.norm(centre)
    return centres


def _limit(x: np.ndarray, k: int, rounds: int) -> float | None:
    """A cosine that nearly all texts of the language reach with centroids that were found without them."""
    if len(x) < LEAST_TEXTS:
        return None
    halves = x[0::2], x[1::2]
    cosines = [(b @ _spherical_k_means(a, k, rounds).T).max(axis=1) for a, b in (halves, halves[::-1])]
    return float(np.quantile(np.concatenate(cosines), QUANTILE)) * MARGIN


Model = tuple[np.ndarray, list[str], np.ndarray, np.ndarray]


def fit(docs: DataFrame, sample: int = SAMPLE_PER_LANGUAGE, centroids: int = CENTROIDS) -> Model:
    """(idf, language of every centroid, centroids, lowest cosine of every centroid) from doc_id, text and lang. Rows without lang or letters are left out.

    Document frequencies cover all rows; the centroids and limits rest on about ``sample`` rows per language.
    """
    known = need(docs, "doc_id", "text", "lang").where("lang IS NOT NULL")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, seen, rows = _letters(), np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                counts = ngram_counts(text.as_py(), letters)
                if counts is not None:
                    seen += counts > 0
                    rows += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, FEATURES, dtype=np.int32)), pa.array(np.append(rows, seen))], ["feature", "df"])

    df = np.zeros(FEATURES + 1, np.int64)
    for r in known.select("text").mapInArrow(frequencies, "feature int, df long").groupBy("feature").agg(F.sum("df").alias("df")).collect():
        df[r["feature"] + 1] = r["df"]
    idf = (np.log((1 + df[0]) / (1 + df[1:])) + 1).astype(np.float32)

    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return idf, [], np.zeros((0, FEATURES), np.float32), np.zeros(0)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, sample / r["n"]))])
    lottery = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        letters = _letters()
        counts = [c for c in (ngram_counts(t, letters) for t in group.sort_values("doc_id")["text"]) if c is not None]
        if not counts:
            return pd.DataFrame({"lang": [], "centre": [], "least": []})
        x = _vectors(counts, idf)
        centres = _spherical_k_means(x, centroids, ROUNDS)
        rows = [c.astype(float).tolist() for c in centres]
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centre": rows, "least": [_limit(x, centroids, ROUNDS)] * len(rows)})

    found = known.where(lottery).groupBy("lang").applyInPandas(cluster, "lang string, centre array<double>, least double").collect()
    found.sort(key=lambda r: (r["lang"], r["centre"]))
    centres = np.array([r["centre"] for r in found], np.float32).reshape(len(found), FEATURES)
    lowest = min((r["least"] for r in found if r["least"] is not None), default=MIN_COSINE)
    limits = np.array([lowest if r["least"] is None else r["least"] for r in found])
    return idf, [r["lang"] for r in found], centres, limits


def predict(
    docs: DataFrame, model: Model, min_cosine: float | None = MIN_COSINE, keep_text: bool = False,
) -> DataFrame:
    """The columns of ``docs``, text only with ``keep_text``, and lang_pred and score: one row for every row.

    ``docs`` needs text. ``lang_pred`` is ``und`` with score 0 for a text that is null, empty or without letters, or whose
    best cosine is below ``min_cosine``, or below the limit that was learned for this centroid if that is None. Of equally near centroids the one of the first language in code-point
    order wins. Columns of the names lang_pred and score are replaced.
    """
    kept = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, (idf, names, centres, limits) = _letters(), shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                counts = [ngram_counts(t.as_py(), letters) for t in batch.column(len(kept))]
                label, score = [UNKNOWN] * len(counts), np.zeros(len(counts))
                rows = [i for i, c in enumerate(counts) if c is not None]
                if rows and names:
                    cosine = _vectors([counts[i] for i in rows], idf) @ centres.T
                    best = cosine.argmax(axis=1)
                    for i, j, c in zip(rows, best, cosine.max(axis=1)):
                        if c >= (limits[j] if min_cosine is None else min_cosine):
                            label[i], score[i] = names[j], min(1.0, float(c))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:len(names_out)], pa.array(label, pa.string()), pa.array(score)], [*names_out, "lang_pred", "score"])

    names_out = [*kept, "text"] if keep_text else kept
    kind = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in names_out)
    return docs.select(*[f"`{c}`" for c in kept], "text").mapInArrow(per_batch, kind + "lang_pred string, score double")
