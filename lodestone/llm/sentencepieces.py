"""SentencePiece encoding and decoding on the Tokenizers library.

The model's protobuf is parsed; its normaliser, metaspace marker, scores and
byte fallback are rebuilt as a Tokenizers pipeline: a unigram model keeps its
scores, a BPE model's merges follow from the scores of its pieces.  Units of a
slice of texts (see :mod:`.units`) are encoded once each, in one multithreaded
batch, and parity with the SentencePiece library is verified on every distinct
unit; should one differ, its ids are taken from that library and the texts that
hold it are reported (``parity`` false).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, slices, with_text
from .units import SPACE, gather, separable, units

#: Units whose ids a worker keeps.
CACHE = 100_000
#: Units that the libraries encode in one batch; bounds what their results take.
BATCH = 16_384
UNIGRAM, BPE = 1, 2


def parse(path: str):
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return model


def build(model):
    """The Tokenizers pipeline of a parsed model."""
    from tokenizers import Tokenizer, decoders, models, normalizers

    pieces = [(p.piece, p.score) for p in model.pieces]
    unknown = next(i for i, p in enumerate(model.pieces) if p.type == 2)
    if model.trainer_spec.model_type == UNIGRAM:
        core = models.Unigram(pieces, unknown, model.trainer_spec.byte_fallback)
    elif model.trainer_spec.model_type == BPE:
        ids = {p: i for i, (p, _) in enumerate(pieces)}
        merges = []
        for piece, score in pieces:
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                if left in ids and right in ids:
                    merges.append((-score, len(right) - len(left), ids[left], left, right))
        merges.sort()
        core = models.BPE(ids, [(m[3], m[4]) for m in merges], unk_token=pieces[unknown][0], fuse_unk=True, byte_fallback=model.trainer_spec.byte_fallback)
    else:
        raise ValueError("only unigram and BPE models can be rebuilt")
    out = Tokenizer(core)
    spec = model.normalizer_spec
    steps = [normalizers.Precompiled(spec.precompiled_charsmap)] if spec.precompiled_charsmap else []
    if spec.remove_extra_whitespaces:
        from tokenizers import Regex

        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.add_dummy_prefix:
        steps.append(normalizers.Prepend(SPACE))
    out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", SPACE)])
    out.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), decoders.Strip(" ", 1, 0)])
    return out


class Coder:
    """Encodes and decodes slices of texts; one for each worker."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = parse(path)
        self.check = SentencePieceProcessor(model_file=path)
        spec = model.normalizer_spec
        self.simple = not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and spec.add_dummy_prefix
        if not separable([p.piece for p in model.pieces if p.type in (1, 4)]):
            raise ValueError("pieces reach over a word's start; units can't be encoded apart")
        from tokenizers import normalizers

        self.bare = build(model)
        self.normalizer, self.bare.normalizer = self.bare.normalizer, normalizers.Sequence([])
        # bytes that each id stands for
        table = []
        for p in model.pieces:
            if p.type == 6:
                table.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == 3:
                table.append(b"")
            elif p.type == 2:
                table.append(" ⁇ ".encode())
            else:
                table.append(p.piece.replace(SPACE, " ").encode())
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        self.sizes = np.array([len(b) for b in table], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.known: dict[str, int] = {}
        self.unit_start, self.unit_size, self.unit_same = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.ids = np.zeros(0, np.int32)

    def learn(self, fresh: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, n, same) of units: all ids, their number for each unit, whether both libraries agree."""
        parts = [self.learned(fresh[i : i + BATCH]) for i in range(0, len(fresh), BATCH)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def learned(self, fresh: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        got = [e.ids for e in self.bare.encode_batch_fast(fresh, add_special_tokens=False)]
        # a lone marker can't be asked for by itself: with the dummy prefix it is no text
        asked = [i for i, u in enumerate(fresh) if u != SPACE] if SPACE in fresh else range(len(fresh))
        wanted = self.check.encode([fresh[i][1:].replace(SPACE, " ") for i in asked], num_threads=2)
        same = np.ones(len(fresh), bool)
        if (got if len(asked) == len(got) else [got[i] for i in asked]) != wanted:
            for i, ids in zip(asked, wanted, strict=True):
                if got[i] != ids:
                    got[i], same[i] = ids, False
        n = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.int32, int(n.sum())), n, same

    def normalised(self, texts: pa.Array) -> pa.Array:
        """Texts as the units expect them: without the marker of the dummy prefix."""
        if self.simple:
            return texts
        n = self.normalizer
        return pa.array([None if t is None else n.normalize_str(t).replace(SPACE, " ")[1:] for t in texts.to_pylist()], pa.large_string())

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, n, parity): all ids, their number for each text, and whether all its units agreed with the SentencePiece library."""
        coded, counts, _ = units(self.normalised(texts))
        if len(self.known) > CACHE:
            self.known = {}
            self.unit_start, self.unit_size, self.unit_same, self.ids = self.unit_start[:0], self.unit_size[:0], self.unit_same[:0], self.ids[:0]
        some, index = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        row = np.fromiter((self.known.get(u, -1) for u in some), np.int64, len(some))
        new = np.flatnonzero(row < 0)
        starts, sizes, same, ids = self.unit_start, self.unit_size, self.unit_same, self.ids
        if len(new):
            fresh = [some[i] for i in new.tolist()]
            got, n, agree = self.learn(fresh)
            row[new] = len(sizes) + np.arange(len(new))
            first = len(ids) + np.cumsum(n) - n
            # units that recur in a slice are worth keeping for the next ones
            keep = np.flatnonzero(np.bincount(index, minlength=len(some))[new] > 1)
            self.known.update(zip([fresh[i] for i in keep.tolist()], range(len(sizes), len(sizes) + len(keep)), strict=True))
            self.unit_start = np.concatenate([starts, len(ids) + np.cumsum(n[keep]) - n[keep]])
            self.unit_size, self.unit_same = np.concatenate([sizes, n[keep]]), np.concatenate([same, agree[keep]])
            self.ids = np.concatenate([ids, got[gather(first[keep] - len(ids), n[keep])]])
            starts, sizes, same, ids = np.concatenate([starts, first]), np.concatenate([sizes, n]), np.concatenate([same, agree]), np.concatenate([ids, got])
        row = row[index]
        owner = np.repeat(np.arange(len(counts)), counts)
        total = np.bincount(owner, weights=sizes[row], minlength=len(counts)).astype(np.int64)
        parity = np.ones(len(counts), bool) if same.all() else np.bincount(owner, weights=~same[row], minlength=len(counts)) == 0
        return ids[gather(starts[row], sizes[row])], total, parity

    def decode(self, ids: np.ndarray, n: np.ndarray) -> list[str]:
        """Texts of runs of ids: markers are spaces, the dummy prefix goes, byte pieces join to characters (U+FFFD where they can't)."""
        data = self.bytes[gather(self.starts[ids], self.sizes[ids])].tobytes()
        ends = np.cumsum(np.concatenate([[0], self.sizes[ids]]))[np.concatenate([[0], np.cumsum(n)])]
        out = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if b > a and data[a] == 32:
                a += 1
            out.append(data[a:b].decode("utf-8", "replace"))
        return out


@lru_cache(maxsize=1)
def coder(path: str) -> Coder:
    """The worker's coder: tasks that follow on one another share it and what it has learned."""
    return Coder(path)


def encoder(path: str, check: bool, text_col: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in slices(batches, text_col, 2 << 20):
            texts = batch.column(batch.schema.get_field_index(text_col))
            ids, n, same = own.encode(texts)
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
            out = {c: batch.column(i) for i, c in enumerate(batch.schema.names) if c != "__text"}
            out |= {"ids": pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), "n_tokens": pa.array(n, pa.int64()), "parity": same}
            if check:
                back = pa.array(own.decode(ids, n), pa.large_string())
                out["round_trip"] = pc.equal(back, pc.fill_null(texts.cast(pa.large_string()), ""))
            yield pa.RecordBatch.from_pydict(out)
        release()

    return encode


RESULTS = ("ids", "n_tokens", "parity", "round_trip")


def encode(docs: DataFrame, model_path: str, text_col: str = "text", check: bool = True, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (columns ``keep``, by default all) with ids, n_tokens, parity and, with ``check``, round_trip: whether decoding the ids gives the text again.

    Null and empty texts have no ids.  A text that holds the marker U+2581 itself
    can't come back as it was.  Texts are encoded whole, however long; repeated rows
    each get their ids; an empty table gives an empty table.  Columns of these names
    give way to the results.
    """
    rows, name = with_text(docs, text_col, keep, RESULTS)
    schema = rows.drop("__text").schema.add("ids", T.ArrayType(T.IntegerType())).add("n_tokens", "long").add("parity", "boolean")
    return rows.mapInArrow(encoder(model_path, check, name), schema.add("round_trip", "boolean") if check else schema)


def decode(coded: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """``coded`` with ``decoded``, the text of each row's ids (null: null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(model_path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("__ids"))
            n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            text = own.decode(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), n)
            text = [t if ok else None for t, ok in zip(text, column.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({c: batch.column(i) for i, c in enumerate(batch.schema.names) if c != "__ids"} | {"decoded": pa.array(text, pa.string())})

    rows = coded.withColumn("__ids", F.col(f"`{ids_col}`")).drop(*({"decoded"} & set(coded.columns)))
    return rows.mapInArrow(run, rows.drop("__ids").schema.add("decoded", "string"))
