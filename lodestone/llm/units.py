"""Units of a SentencePiece text: pieces never reach over a word's start, so words can be encoded apart.

A normalised text is the dummy-prefix marker, then the text with spaces as
markers.  It is cut before every run of markers that follows another character;
:func:`separable` tells whether a vocabulary allows that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = "▁"


def separable(pieces: list[str]) -> bool:
    """No piece has a marker after another character."""
    return not any(SPACE in p.lstrip(SPACE) for p in pieces)


def units(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """(units, n, plain): each text's units in order, flattened and coded; their number; whether the text has no marker of its own.

    Null and empty texts have none.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    own = pc.match_substring(texts, SPACE)
    plain = ~own.to_numpy(zero_copy_only=False)
    if not plain.all():
        texts = pc.replace_substring(texts, SPACE, " ")
    parts = pc.split_pattern(texts, " ")
    flat = parts.flatten()
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    size = pc.binary_length(flat).to_numpy(zero_copy_only=False)
    full = size > 0
    # a part with e empty ones before it starts with e + 1 markers; a text's last part stays if it is empty (trailing spaces)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    at = np.arange(len(size), dtype=np.int64)
    last_full = np.maximum.accumulate(np.where(full, at, -1)) if len(size) else at
    before = np.concatenate([[-1], last_full[:-1]]) if len(size) else at
    empties = at - np.maximum(before, first[owner] - 1) - 1
    blank = pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0
    closing = np.zeros(len(size), bool)
    closing[first + counts - 1] = True
    keep = full | (closing & ~full & ~blank[owner])
    kept = np.flatnonzero(keep)
    values = pc.binary_join_element_wise(pa.scalar(SPACE, pa.large_string()), flat.take(pa.array(kept)), pa.scalar("", pa.large_string()))
    odd = empties[kept] > 0
    if odd.any():
        some = [SPACE * (int(e) + 1) + v for e, v in zip(empties[kept][odd].tolist(), flat.take(pa.array(kept[odd])).to_pylist(), strict=True)]
        values = pc.replace_with_mask(values, pa.array(odd), pa.array(some, pa.large_string()))
    return values.dictionary_encode(), np.bincount(owner[kept], minlength=len(counts)).astype(np.int64), plain


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges start..start+size."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)
