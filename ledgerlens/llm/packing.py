"""Packing tokenised documents into sequences: vector best-fit under three capacities.

A sequence has room for a number of tokens, of documents, and of attention cost (the sum of squared lengths). Pieces
are taken longest first. Among the open sequences in which a piece keeps every capacity, the one with the best weighted
score of the remaining room wins: the smallest norm of what would be left, or the largest dot product of room and need.
"""

from __future__ import annotations

import base64
import functools
import math
import pathlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import need
from ledgerlens.scratch import save

MAX_TOKENS, MAX_DOCUMENTS = 2_048, 2_048
END_ID = 0
# importance of the room in tokens, documents and cost
WEIGHTS = (1.0, 0.01, 0.01)
# pieces that one task packs; each group ends with a few open sequences, which so many pieces make negligible
GROUP_PIECES = 16_384


def encoding(vocabulary: str):
    """The byte-level BPE whose ranks are in the file ``vocabulary``; a Python worker keeps it for its next tasks."""
    import public_tokenizers
    import tiktoken
    from tiktoken.registry import ENCODINGS

    if vocabulary not in ENCODINGS:
        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        ENCODINGS[vocabulary] = tiktoken.Encoding(
            vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return ENCODINGS[vocabulary]


@functools.cache
def tokenizer(vocabulary: str):
    """The same vocabulary as a ``tokenizers`` file, next to the ranks. Control strings in a text are ordinary text."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(str(pathlib.Path(vocabulary).with_suffix(".json")))
    found.encode_special_tokens = True
    return found


def token_ids(text: str, vocabulary: str) -> np.ndarray:
    """Ids of a text. The regular expressions of ``tiktoken`` give up on very long runs of blanks; ``tokenizers``, which is
    slower, gives the same ids for any text."""
    try:
        return encoding(vocabulary).encode_to_numpy(text, disallowed_special=())
    except ValueError:
        return np.array(tokenizer(vocabulary).encode(text, add_special_tokens=False).ids, np.uint32)


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def cut(length: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, and a shorter one only at the front."""
    head = length % limit or limit
    starts = [0, *range(head, length, limit)] if length else []
    return [(s, (starts + [length])[i + 1] - s) for i, s in enumerate(starts)]


def pieces(
    docs: DataFrame, max_tokens: int, vocabulary: str | None, end_id: int, with_ids: bool, carry: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, what is carried and, if asked for, the ids of every piece."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = vocabulary or default_vocabulary()
        names = ["piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        for batch in batches:
            rows, owner = [], []
            for at, text in enumerate(batch.column(1)):
                ids = np.append(token_ids(text.as_py() or "", ranks), end_id).astype("<u4")
                for i, (start, length) in enumerate(cut(len(ids), max_tokens)):
                    own = ids[start:start + length]
                    owner.append(at)
                    rows.append((i, start, length, zlib.crc32(own.tobytes()), *([own.astype(np.int32)] * with_ids)))
            columns = list(zip(*rows)) or [()] * len(names)
            docs_ = batch.select([0, *range(2, batch.num_columns)]).take(pa.array(owner, pa.int64()))
            found = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(
                [docs_.column(0), *found[:4], *docs_.columns[1:], *found[4:]], ["doc_id", *names[:4], *carry, *names[4:]])

    rows = need(docs, "doc_id", "text", *carry).withColumn("doc_id", F.col("doc_id").cast("long"))
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long"
    kind += "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(per_batch, kind + ", ids array<int>" * with_ids)


def best_fit(
    lengths: np.ndarray, capacity: tuple[float, float, float], weights: tuple[float, ...], score: str = "norm",
) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of every piece."""
    limit, weight = np.array(capacity, float), np.array(weights, float)
    room = np.empty((len(lengths), 3))
    used = 0
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        n = float(lengths[i])
        want = np.array([n, 1.0, n * n])
        fits = np.flatnonzero((room[:used] >= want).all(axis=1)) if n < limit[0] else ()
        if len(fits):
            left = room[fits]
            if score == "dot":
                value = -((left / limit) * (want / limit) * weight).sum(axis=1)
            else:
                value = ((((left - want) / limit) ** 2) * weight).sum(axis=1)
            at = fits[value.argmin()]
        else:
            at, used = used, used + 1
            room[at] = limit
        sequence[i], offset[i] = at, limit[0] - room[at, 0]
        room[at] -= want
    return sequence, offset


def pack(
    docs: DataFrame, max_tokens: int = MAX_TOKENS, max_documents: int = MAX_DOCUMENTS, max_cost: float | None = None,
    vocabulary: str | None = None, end_id: int = END_ID, with_ids: bool = False, score: str = "norm",
    weights: tuple[float, float, float] = WEIGHTS, carry: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids): one row per piece of a document.

    ``docs`` needs doc_id and text; of its other columns only those in ``carry`` are read, which every piece repeats. A document's ids end with ``end_id``; a null or empty text
    is that id alone. Only documents over ``max_tokens`` are cut, and only their first piece may be shorter. Every row is a
    document of its own, whether its id is null or repeats. ``max_cost`` (default: that of one full piece) limits the
    sum of squared lengths of a sequence and cannot be below the cost of a full piece. An empty table gives an empty one.
    """
    full = float(max_tokens) ** 2
    cost = full if max_cost is None else float(max_cost)
    if max_tokens < 1 or max_documents < 1 or cost < full:
        raise ValueError("a full piece must fit the capacities of a sequence")
    rows = save(pieces(docs, max_tokens, vocabulary, end_id, with_ids, carry), "pieces")
    groups = max(1, math.ceil(rows.count() / GROUP_PIECES))

    def per_group(group: pd.DataFrame) -> pd.DataFrame:
        sequence, offset = best_fit(group["length"].to_numpy(), (max_tokens, max_documents, cost), weights, score)
        first = int(group["_group"].iloc[0]) << 32
        return group.drop(columns="_group").assign(sequence_id=first + sequence, offset=offset)

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id long, offset long"
    # the number of a row of the written table spreads repeated documents, too
    dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int")
    return rows.withColumn("_group", dealt).groupBy("_group").applyInPandas(per_group, kind)
