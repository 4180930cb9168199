"""Words of many texts at once, as numbers into a vocabulary: the byte work of the operators on word sequences."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# bytes of text that are split at a time; a longer text is a slice of its own
SLICE_BYTES = 8 * 2**20
SPACES = bytes([0x20, *range(0x09, 0x0E)])
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


@dataclass
class Words:
    """``codes[bounds[i]:bounds[i + 1]]`` are the words of text ``i`` as places in ``vocabulary``."""

    codes: np.ndarray
    bounds: np.ndarray
    vocabulary: pa.StringArray
    # number of breaks before each word, if there are breaks
    piece: np.ndarray

    @property
    def text(self) -> np.ndarray:
        """For every word, the number of its text."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def slices(batch: pa.RecordBatch, column: int, share: int = 1) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` whose texts have together at most ``SLICE_BYTES / share``, or that are one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    start, filled = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if filled and filled + size > SLICE_BYTES // share:
            yield batch.slice(start, i - start)
            start, filled = i, 0
        filled += size
    if start < batch.num_rows:
        yield batch.slice(start)


def pack(columns: dict[str, pa.Array | np.ndarray]) -> bytes:
    """One row of lists as a compressed Arrow message."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()]
    lists = [pa.LargeListArray.from_arrays(pa.array([0, len(c)], pa.int64()), c) for c in arrays]
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays(lists, list(columns))
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(block: pa.Scalar) -> dict[str, pa.Array]:
    row = pa.ipc.open_stream(block.as_buffer()).read_all()
    return {name: row.column(name).combine_chunks().flatten() for name in row.column_names}


def split(texts: pa.Array, spaces: bytes = SPACES, breaks: bytes = b"", lower: bool = False) -> Words:
    """The words of ``texts``: stretches without bytes of ``spaces`` or ``breaks``. A null text has none.

    With ``lower``, A-Z become a-z. All given bytes are ASCII, so no character of several bytes is cut.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, places, blob = texts.buffers()
    ends = np.frombuffer(places, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(blob, np.uint8)[ends[0]:ends[-1]] if blob else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    kind = np.zeros(256, np.uint8)
    kind[list(spaces)] = 1
    kind[list(breaks)] = 2
    kinds = kind[data]
    inside = kinds == 0
    # a word starts where the byte before is none of a word, or belongs to another text
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    first = ends[:-1][ends[:-1] < ends[1:]]
    starts[first] = inside[first]
    at = np.flatnonzero(starts)
    kept = data[inside]
    if lower:
        kept = np.frombuffer(LOWER, np.uint8)[kept]
    offsets = np.zeros(len(at) + 1, np.int64)
    if len(at):
        offsets[1:] = np.cumsum(np.add.reduceat(inside, at, dtype=np.int64))
    words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(kept))
    coded = words.dictionary_encode()
    return Words(
        coded.indices.to_numpy().astype(np.int64), np.searchsorted(at, ends), coded.dictionary,
        np.cumsum(kinds == 2, dtype=np.int32)[at] if breaks else np.zeros(len(at), np.int64))
