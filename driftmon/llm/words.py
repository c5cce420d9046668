"""Arrow-side helpers: cutting a batch of texts into words without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batch: pa.RecordBatch, text: int, chars: int = 12_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` of about ``chars`` bytes of text (one row at least), to bound memory."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // chars
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the place of each word among them, and where each text's words end.

    Words are runs of anything but ``[\\x20\\x09-\\x0D]``; null counts as empty.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    cut = pc.ascii_split_whitespace(texts)
    flat = cut.flatten()
    ends = cut.offsets.to_numpy()[1:].astype(np.int64) - cut.offsets[0].as_py()
    keep = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(keep, min_count=0).as_py():
        kept = keep.to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(kept)])[ends]
        flat = flat.filter(keep)
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), ends
