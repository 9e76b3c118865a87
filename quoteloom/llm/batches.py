"""Arrow batches inside tasks: parts of bounded size, and words as numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 4 << 20


def slices(batch: pa.RecordBatch, column: int, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose values in ``column`` hold about ``size`` bytes."""
    sizes = np.array(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    start = held = 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > size:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def split(texts: pa.Array, lower: bool) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(word numbers, the distinct words, words per text) of a string or binary column, cut at ASCII white space.

    With ``lower``, A-Z become lower case and nothing else does.
    """
    kind = texts.type
    empty = b"" if pa.types.is_binary(kind) else ""
    plain = texts.fill_null(empty).view(pa.string())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(plain) if lower else plain)
    coded = lists.flatten().dictionary_encode()
    numbers = coded.indices.to_numpy()
    lengths = pc.list_value_length(lists).to_numpy().astype(np.int64)
    blank = pc.index(coded.dictionary, "").as_py()
    if blank >= 0:  # stands where a text begins or ends with white space
        gone = numbers == blank
        owner = np.repeat(np.arange(len(lengths)), lengths)
        lengths = lengths - np.bincount(owner[gone], minlength=len(lengths))
        numbers = numbers[~gone]
    return numbers, coded.dictionary.view(kind), lengths
