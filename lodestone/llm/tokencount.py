"""Token counts without tokens: count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates all pieces that end at each character; the
dynamic programme carries, for each position, the best score and the number of
pieces of the path that has it, but no path.  Tie rules are the tokenizer's:
starts are tried from the left and only a strictly better score replaces, so
among equal scores the longest last piece stands; a character without a piece of
its own can be the unknown piece, at the lowest score less 10, and counts as
its UTF-8 bytes with byte fallback.  Words are counted apart (see :mod:`.units`),
each distinct one of a slice once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import release, slices, with_text
from .sentencepieces import parse
from .units import separable, units

CACHE = 100_000
UNKNOWN_PENALTY = 10.0


class Counter:
    def __init__(self, path: str):
        import ahocorasick

        model = parse(path)
        usable = [p for p in model.pieces if p.type in (1, 4)]
        if not separable([p.piece for p in usable]):
            raise ValueError("pieces reach over a word's start; words can't be counted apart")
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only models with the identity normaliser and a dummy prefix are counted")
        highest = max(p.score for p in usable)
        self.matches = ahocorasick.Automaton()
        for p in usable:
            # user-defined pieces always win, as in the tokenizer
            self.matches.add_word(p.piece, (len(p.piece), p.score if p.type == 1 else len(p.piece) * highest - 0.1))
        self.matches.make_automaton()
        self.unknown = min(p.score for p in usable) - UNKNOWN_PENALTY
        self.fallback = model.trainer_spec.byte_fallback
        self.known: dict[str, int] = {}

    def count(self, unit: str) -> int:
        """Pieces of the best segmentation of one unit."""
        n = len(unit)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, match in self.matches.iter(unit):
            ends[last + 1].append(match)
        score, pieces = [0.0] * (n + 1), [0] * (n + 1)
        run = [False] * (n + 1)
        for e in range(1, n + 1):
            best, count, fused = None, 0, False
            single = False
            for size, value in sorted(ends[e], reverse=True):
                single |= size == 1
                s = score[e - size] + value
                if best is None or s > best:
                    best, count, fused = s, pieces[e - size] + 1, False
            if not single:
                s = score[e - 1] + self.unknown
                if best is None or s > best:
                    # without byte fallback, unknown characters in a row are one piece
                    more = len(unit[e - 1].encode("utf-8", "surrogatepass")) if self.fallback else (0 if run[e - 1] else 1)
                    best, count, fused = s, pieces[e - 1] + more, True
            score[e], pieces[e], run[e] = best, count, fused
        return pieces[n]

    def counts(self, some: list[str], uses: np.ndarray) -> np.ndarray:
        """Counts of distinct units; those used more than once in a slice are kept for the next ones."""
        if len(self.known) > CACHE:
            self.known = {}
        out = np.empty(len(some), np.int64)
        for i, (u, n) in enumerate(zip(some, uses.tolist(), strict=True)):
            c = self.known.get(u)
            if c is None:
                c = self.count(u)
                if n > 1:
                    self.known[u] = c
            out[i] = c
        return out


def counting(path: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in slices(batches, text_col):
            coded, n, _ = units(batch.column(batch.schema.get_field_index(text_col)))
            index = coded.indices.to_numpy(zero_copy_only=False)
            own = counter.counts(coded.dictionary.to_pylist(), np.bincount(index, minlength=len(coded.dictionary)))
            total = np.bincount(np.repeat(np.arange(len(n)), n), weights=own[index] if len(own) else None, minlength=len(n)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({c: batch.column(i) for i, c in enumerate(batch.schema.names) if c != "__text"} | {"n_tokens": total})
        del counter
        release()

    return run


def count_tokens(docs: DataFrame, model_path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (columns ``keep``, by default all) with ``n_tokens``, the pieces of the best unigram segmentation of the whole text under the model's scores.

    Null and empty texts have none.  A model of another type is read as a unigram
    model with the scores that it states.  Texts are counted whole, however long;
    repeated rows each get their count; an empty table gives an empty table.  A
    column of this name gives way.
    """
    rows, name = with_text(docs, text_col, keep, ("n_tokens",))
    return rows.mapInArrow(counting(model_path, name), rows.drop("__text").schema.add("n_tokens", "long"))
