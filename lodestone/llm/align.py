"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes.

A static interval index over the B tokens of a text (sorted starts, running
maximum of ends) answers each A token's stabbing query with two bisections: the B
tokens that it overlaps are its links.  Gaps between B tokens that no A token
spans are the boundaries of groups.

Neither tokenizer crosses a space that follows a character other than white space,
so texts are cut there and each distinct unit of a slice is encoded and
aligned once, all units of a slice in one index.  A slice keeps its own dictionary
of id pairs; a document refers to it by place.  Corpus-wide counts come from the
dictionaries (a row for each slice and pair, not for each document and pair) and
go back to the slices the same way.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, release, slices, stored
from .sentencepieces import parse
from .units import SPACE, gather, separable

#: From a space to the next one that follows something other than white space.
UNIT = re.compile(r" [^ ]*(?:(?<=\s) [^ ]*)*")
#: Letters whose classes the two implementations of the byte-level tokenizer surely agree on.
PLAIN = re.compile("[\x00-ɏ]*")
#: The split of byte-level tokenizers (a fixed value).
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RESULTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


class IntervalIndex:
    """Intervals [start, end) by start; which of them any interval overlaps."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray):
        self.order = np.argsort(starts, kind="stable")
        self.starts, self.ends = starts[self.order], ends[self.order]
        self.reach = np.maximum.accumulate(self.ends) if len(ends) else self.ends

    def overlaps(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, interval) numbers of all overlaps, by query and then by start."""
        first = np.searchsorted(self.reach, starts, side="right")
        stop = np.maximum(first, np.searchsorted(self.starts, ends, side="left"))
        query, place = np.repeat(np.arange(len(starts)), stop - first), gather(first, stop - first)
        real = (self.ends[place] > starts[query]) & (starts[query] < ends[query]) & (self.starts[place] < self.ends[place])
        return query[real], self.order[place[real]]


def groups(starts_a: np.ndarray, ends_a: np.ndarray, starts_b: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, group of each A token, group of each B token) of two tokenisations that cover the same bytes in order; a and b: the links."""
    a, b = IntervalIndex(starts_b, ends_b).overlaps(starts_a, ends_a)
    n = len(starts_b)
    cut = np.flatnonzero(np.append(True, a[1:] != a[:-1])[: len(a)])
    first, last = b[cut], b[np.append(cut[1:], len(a))[: len(cut)] - 1]
    # how many A tokens span the gap after each B token
    spans = np.cumsum(np.bincount(first, minlength=n) - np.bincount(last, minlength=n))[: max(0, n - 1)]
    of_b = np.concatenate([[0], np.cumsum(spans == 0)]).astype(np.int64)[:n]
    of_a = of_b[np.searchsorted(ends_b, starts_a, side="right")] if n else np.zeros(len(starts_a), np.int64)
    return a, b, of_a, of_b


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 for itself, the others in order from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A: a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        raw = json.load(open(path, encoding="utf-8"))
        model, split = raw["model"], raw["pre_tokenizer"]
        if model["type"] != "BPE" or raw["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError("A has to be a byte-level BPE tokenizer without normaliser and prefix space")
        letters = byte_letters()
        vocab = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items()}
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = token
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        first = len(vocab) - len(pairs)
        # merges in the order of ids: then ranks are ids, and the faster library gives the same tokens
        ranked = all(model["vocab"].get(a + b) == first + i for i, (a, b) in enumerate(pairs))
        self.fast = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=vocab, special_tokens={}) if ranked else None
        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = True

    def encode(self, some: list[str]) -> list[list[int]]:
        plain = [self.fast is not None and PLAIN.fullmatch(u) is not None for u in some]
        out = [self.fast.encode_ordinary(u) if p else None for u, p in zip(some, plain, strict=True)]
        odd = [i for i, p in enumerate(plain) if not p]
        for i, e in zip(odd, self.full.encode_batch_fast([some[i] for i in odd], add_special_tokens=False) if odd else [], strict=True):
            out[i] = e.ids
        return out


class Pieces:
    """B: a SentencePiece model."""

    def __init__(self, path: str):
        import sentencepiece

        model = parse(path)
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not separable([p.piece for p in model.pieces if p.type in (1, 4)]):
            raise ValueError("B has to be a model with the identity normaliser and a dummy prefix whose pieces don't reach over a word's start")
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.space = self.model.piece_to_id(SPACE)
        self.bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(SPACE, " ").encode() for p in model.pieces]

    def encode(self, some: list[str]) -> list[list[int]]:
        # the model adds the space; it gives nothing for an empty string, which a text's last space leaves
        return [x or [self.space] for x in self.model.encode([u[1:] for u in some], num_threads=1)]


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((x for one in lists for x in one), np.int64, int(sizes.sum())), sizes


class Aligned:
    """The distinct units of a slice: their tokens, links and groups; ``bad`` ones have tokens that don't spell them."""

    def __init__(self, some: list[str], a: ByteLevel, b: Pieces, lengths: tuple[np.ndarray, np.ndarray], values: tuple[pa.Array, pa.Array]):
        raw = [u.encode() for u in some]
        want = np.fromiter(map(len, raw), np.int64, len(raw))
        owner = np.arange(len(some))
        ids, sizes = zip(*(flat(x.encode(some)) for x in (a, b)), strict=True)
        self.bad = np.zeros(len(some), bool)
        of = [np.repeat(owner, n) for n in sizes]
        for i, n, o in zip(ids, lengths, of, strict=True):
            self.bad |= np.bincount(o, weights=n[i], minlength=len(some)).astype(np.int64) != want
        text = np.frombuffer(b"".join(u for u, bad in zip(raw, self.bad, strict=True) if not bad), np.uint8)
        byte_owner = np.repeat(owner[~self.bad], want[~self.bad])
        for i, v, o in zip(ids, values, of, strict=True):
            spelt = np.frombuffer(b"".join(v.take(pa.array(i[~self.bad[o]])).to_pylist()), np.uint8)
            self.bad[byte_owner[spelt != text]] = True
            right = ~self.bad[byte_owner]
            text, byte_owner = text[right], byte_owner[right]
        ids = [i[~self.bad[o]] for i, o in zip(ids, of, strict=True)]
        of = [o[~self.bad[o]] for o in of]
        ends = [np.cumsum(n[i]) for n, i in zip(lengths, ids, strict=True)]
        starts = [e - n[i] for e, n, i in zip(ends, lengths, ids, strict=True)]
        x, y, group_a, group_b = groups(starts[0], ends[0], starts[1], ends[1])
        self.n_a, self.n_b = (np.bincount(o, minlength=len(some)) for o in of)
        self.links = ids[0][x] << 32 | ids[1][y]
        self.n_links = np.bincount(of[0][x], minlength=len(some))
        n_groups = int(group_b[-1]) + 1 if len(group_b) else 0
        first = np.flatnonzero(np.append(True, group_b[1:] != group_b[:-1])) if n_groups else np.zeros(0, np.int64)
        self.n_groups = np.bincount(of[1][first], minlength=len(some))
        self.texts = written(ids, (group_a, group_b), n_groups, self.n_groups)


def lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), values)


def written(ids: list[np.ndarray], of: tuple[np.ndarray, np.ndarray], n: int, by_unit: np.ndarray) -> list[str]:
    """a1,a2|b1;a3|b2,b3 of each unit."""
    sides = [pc.binary_join(lists(pa.array(i).cast(pa.large_string()), np.bincount(g, minlength=n)), pa.scalar(",", pa.large_string())) for i, g in zip(ids, of, strict=True)]
    both = pc.binary_join_element_wise(*sides, pa.scalar("|", pa.large_string()))
    return pc.binary_join(lists(both, by_unit), pa.scalar(";", pa.large_string())).to_pylist()


def aligning(a_path: str, b_path: str, text_col: str, keep: list[str], names: tuple[str, str, str, str, str]):
    """mapInArrow: texts to rows of T (see :func:`align`)."""
    chunk_col, pairs_col, docs_col, step_col, n_col = names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        a, b = ByteLevel(a_path), Pieces(b_path)
        lengths = tuple(np.fromiter(map(len, x.bytes), np.int64, len(x.bytes)) for x in (a, b))
        values = tuple(pa.array(x.bytes, pa.large_binary()) for x in (a, b))
        for batch in slices(batches, text_col):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            known: dict[str, int] = {}
            own: list[list[int]] = [[known.setdefault(u, len(known)) for u in UNIT.findall(" " + t)] if t else [] for t in texts]
            units = Aligned(list(known), a, b, lengths, values)
            index, sizes = flat(own)
            doc = np.repeat(np.arange(len(own)), sizes)
            total = lambda n, doc=doc, index=index, own=own: np.bincount(doc, weights=n[index], minlength=len(own)).astype(np.int64)
            good = total(units.bad) == 0
            digests = [hashlib.sha256(";".join([units.texts[i] for i in o]).encode()).hexdigest() if o and g else "" for o, g in zip(own, good.tolist(), strict=True)]
            pairs, place = np.unique(units.links, return_inverse=True)
            first = np.cumsum(units.n_links) - units.n_links
            use = good[doc]
            index, doc = index[use], doc[use]
            keys = np.repeat(doc, units.n_links[index]) * max(1, len(pairs)) + place[gather(first[index], units.n_links[index])]
            keys, n = np.unique(keys, return_counts=True)
            holder, at = np.divmod(keys, max(1, len(pairs)))
            per = np.bincount(holder, minlength=len(own))
            step = np.diff(at, prepend=0)
            starts = (np.cumsum(per) - per)[per > 0]
            step[starts] = at[starts]
            rows = {c: batch.column(batch.schema.get_field_index(c)) for c in keep}
            out = {k: np.where(good, total(v), 0) for k, v in (("n_a", units.n_a), ("n_b", units.n_b), ("n_groups", units.n_groups), ("n_links", units.n_links))}
            head = lambda x, kind, own=own: pa.array([x, *[None] * (len(own) - 1)], pa.list_(kind))
            yield pa.RecordBatch.from_pydict(
                rows
                | out
                | {
                    "groups_sha256": digests,
                    chunk_col: np.full(len(own), uuid.uuid4().int >> 65, np.int64),
                    pairs_col: head(pairs, pa.int64()),
                    docs_col: head(np.bincount(at, minlength=len(pairs)).astype(np.int32), pa.int32()),
                    step_col: listed(step, per),
                    n_col: listed(n, per),
                }
            )
            del units, keys, own, known
        release()

    return run


def listed(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.astype(np.int32)))


def counted(place: str, names: tuple[str, str, str, str, str]):
    """Cogrouped by slice: its documents, and (place, docs, best) of its pairs."""
    chunk_col, pairs_col, docs_col, step_col, n_col = names

    def run(rows: pa.Table, counts: pa.Table) -> pa.Table:
        rows, counts = rows.combine_chunks(), counts.combine_chunks()
        at = counts[place].to_numpy()
        docs, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        docs[at], best[at] = counts["docs"].to_numpy(), counts["best"].to_numpy()
        step, n = (pc.list_flatten(rows[c]).to_numpy().astype(np.int64) for c in (step_col, n_col))
        sizes = pc.list_value_length(rows[n_col]).to_numpy()
        start = np.cumsum(sizes) - sizes
        upto = np.concatenate([[0], np.cumsum(step)])
        here = upto[1:] - np.repeat(upto[start], sizes)
        rows = rows.drop_columns(list(names))
        for c, weight in (("n_best", best), ("count_sum", docs)):
            sums = np.concatenate([[0], np.cumsum(n * weight[here])])
            rows = rows.append_column(c, pa.array(sums[start + sizes] - sums[start]))
        return rows

    return run


def align(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (columns ``keep``, by default all) with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each whole text.

    A encodes a space and the text, B (which adds the space) the text.  Links: pairs of
    A and B tokens whose bytes overlap; a pair's count is the number of documents that
    hold it linked; n_best: links whose count is the highest of their A id (ties
    included); count_sum: counts over links.  Null and empty texts, and texts whose A or
    B tokens don't spell them (such as those with U+2581), have zeros and an empty digest
    and hold no pairs.  Repeated rows are documents of their own.  Special tokens'
    strings are plain text.  Input columns named like a result give way; other names are
    free.  An empty table gives an empty table.  A slice of 4 MB of text (one longer
    document is one slice) is the most that a task holds.
    """
    own = [c for c in (docs.columns if keep is None else keep) if c not in RESULTS]
    inner = tuple(fresh(own, c) for c in ("chunk", "pairs", "pair_docs", "step", "times"))
    chunk, pairs, pair_docs, step, times = inner
    text = text_col if text_col in own and docs.schema[text_col].dataType == T.StringType() else fresh(own, "text")
    rows = docs.select(*[F.col(f"`{c}`") for c in own], *([] if text in own else [F.col(f"`{text_col}`").cast("string").alias(text)]))
    out = T.StructType([rows.schema[c] for c in own])
    for c in ("n_a", "n_b", "n_groups", "n_links"):
        out = out.add(c, "long")
    out = out.add("groups_sha256", "string")
    held = T.StructType([*out]).add(chunk, "long").add(pairs, T.ArrayType(T.LongType()))
    for c in (pair_docs, step, times):
        held = held.add(c, T.ArrayType(T.IntegerType()))
    # a row for each document; the first of a slice also holds the slice's dictionary
    table = stored(rows.mapInArrow(aligning(a_path, b_path, text, own, inner), held), "aligned")
    words = table.where(F.col(f"`{pairs}`").isNotNull()).select(F.col(f"`{chunk}`").alias("chunk"), F.posexplode(F.arrays_zip(F.col(f"`{pairs}`").alias("pair"), F.col(f"`{pair_docs}`").alias("docs"))).alias("place", "x"))
    words = words.select("chunk", "place", "x.pair", "x.docs")
    counts = words.groupBy("pair").agg(F.sum("docs").alias("docs"))
    # a window holds the pairs of one A id, B's vocabulary at most
    highest = F.max("docs").over(Window.partitionBy(F.shiftright("pair", 32)))
    counts = counts.withColumn("best", (F.col("docs") == highest).cast("long"))
    back = words.select("chunk", "place", "pair").join(counts, "pair").select("chunk", "place", "docs", "best")
    result = T.StructType([*out]).add("n_best", "long").add("count_sum", "long")
    return table.groupBy(F.col(f"`{chunk}`")).cogroup(back.groupBy("chunk")).applyInArrow(counted("place", inner), result)
