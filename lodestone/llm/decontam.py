"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by document.  Each segment (some megabytes of text)
is one row: for every stored term its sorted word positions, on one axis for
the whole segment on which documents stand further apart than a phrase is
long.  A phrase is found by intersecting offset-adjusted lists, from the term
that is rarest in the whole corpus to the commonest; most phrases end at an
empty list.  Segments are stored in the shared folder; nothing is shuffled but
the counts of terms, partially summed by segment.

The index of a decontamination run stores the terms of the test items only.
Items are taken in blocks of ``BLOCK_BYTES`` of text, so what tasks hold of
them is bounded however large the benchmark is; with several blocks the index
stores all terms and hits of the blocks are merged by document.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_GAP, release, slices, stored, tokens

BLOCK_BYTES = 32 << 20
#: Words between documents on a segment's axis; no phrase or proximity may be longer.
GAP = 1 << 10
HITS = "hits array<struct<start:int,end:int>>, items array<string>"


def words_of(text: str | None) -> list[str]:
    return tokens(pa.array([text], pa.large_string()))[0].to_pylist()


def builder(ids: list[str], vocabulary: list[str] | None, schema: pa.Schema | None):
    """mapInArrow: documents (ids..., text) to segments."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if vocabulary is None else pa.array(vocabulary, pa.large_string())
        for batch in slices(batches, "__text"):
            flat, counts = tokens(batch.column(batch.schema.get_field_index("__text")))
            owner = np.repeat(np.arange(len(counts)), counts)
            place = np.arange(len(flat), dtype=np.int64) + owner * GAP
            if known is None:
                coded = flat.dictionary_encode()
                terms, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            else:
                terms, code = known, pc.fill_null(pc.index_in(flat, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                place, code = place[code >= 0], code[code >= 0]
            order = np.argsort(code, kind="stable")
            used, starts = np.unique(code[order], return_index=True)
            one = {"segment": pa.array([uuid.uuid4().hex]), "n_words": pa.array([counts.tolist()], pa.list_(pa.int64())), "terms": pa.array([terms.take(pa.array(used)).to_pylist()], pa.list_(pa.string())), "starts": [starts.astype(np.int64).tobytes()], "positions": [place[order].tobytes()]}
            for c in ids:
                column = batch.column(batch.schema.get_field_index(c))
                one[c] = pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)
            yield pa.RecordBatch.from_pydict(one)
        release()

    return build


def index(docs: DataFrame, ids: list[str], text_col: str = "text", vocabulary: list[str] | None = None) -> DataFrame:
    """A stored positional index of ``docs``; ``ids`` are the columns that name a document in results."""
    source = docs.select(*[F.col(f"`{c}`").alias(f"__id_{i}") for i, c in enumerate(ids)], F.col(f"`{text_col}`").cast("string").alias("__text"))
    names = [f"__id_{i}" for i in range(len(ids))]
    fields = [T.StructField("segment", T.StringType()), T.StructField("n_words", T.ArrayType(T.LongType())), T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("starts", T.BinaryType()), T.StructField("positions", T.BinaryType())]
    fields += [T.StructField(n, T.ArrayType(source.schema[n].dataType)) for n in names]
    return stored(source.mapInArrow(builder(names, vocabulary, None), T.StructType(fields)), "positions")


class Segment:
    """Posting lists of one row of the index."""

    def __init__(self, row: dict):
        self.starts = np.frombuffer(row["starts"], np.int64)
        self.positions = np.frombuffer(row["positions"], np.int64)
        self.ends = np.append(self.starts[1:], len(self.positions))
        self.n_words = np.asarray(row["n_words"], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.n_words)[:-1]]) + np.arange(len(self.n_words)) * GAP if len(self.n_words) else np.zeros(0, np.int64)

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.starts[term] : self.ends[term]]

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, place, side="right") - 1


def holds(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    return sorted_values[at] == wanted


def phrase(segment: Segment, terms: list[int], order: list[int]) -> np.ndarray:
    """Start places of the phrase ``terms`` (local term numbers), intersected in the given order of offsets."""
    found = segment.postings(terms[order[0]]) - order[0]
    for offset in order[1:]:
        if not len(found):
            break
        found = found[holds(segment.postings(terms[offset]), found + offset)]
    return found


def near(segment: Segment, terms: list[int], order: list[int], distance: int) -> np.ndarray:
    """Places of the rarest term that have every other term within ``distance`` words, in any order."""
    found = segment.postings(terms[order[0]])
    for i in order[1:]:
        if not len(found):
            break
        own = segment.postings(terms[i])
        lo = np.searchsorted(own, found - distance)
        found = found[(lo < len(own)) & (own[np.minimum(lo, len(own) - 1)] <= found + distance)]
    return found


class Windows:
    """The distinct windows of test items, as numbers of their distinct words."""

    def __init__(self, items: list[tuple[str, list[str]]], length: int):
        seen: dict[tuple[str, ...], set[str]] = {}
        for name, words in items:
            if not words:
                continue
            n = min(length, len(words))
            for i in range(len(words) - n + 1):
                seen.setdefault(tuple(words[i : i + n]), set()).add(name)
        self.vocabulary = sorted({w for window in seen for w in window})
        number = {w: i for i, w in enumerate(self.vocabulary)}
        self.terms = [np.array([number[w] for w in window], np.int64) for window in seen]
        self.items = [sorted(names) for names in seen.values()]
        self.order: list[list[int]] = []

    def rank(self, counts: dict[str, int]) -> None:
        rarity = np.array([counts.get(w, 0) for w in self.vocabulary], np.int64)
        self.order = [np.argsort(rarity[t], kind="stable").tolist() for t in self.terms]


def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, int] = {}
    for batch in batches:
        for row in batch.to_pylist():
            starts = np.frombuffer(row["starts"], np.int64)
            sizes = np.diff(np.append(starts, len(row["positions"]) // 8))
            for term, n in zip(row["terms"], sizes.tolist(), strict=True):
                total[term] = total.get(term, 0) + n
            if len(total) > 1 << 18:
                yield pa.RecordBatch.from_pydict({"term": list(total), "n": pa.array(list(total.values()), pa.int64())})
                total = {}
    if total:
        yield pa.RecordBatch.from_pydict({"term": list(total), "n": pa.array(list(total.values()), pa.int64())})


def matcher(windows, names: list[str], types: list[pa.DataType] | None = None):
    """mapInArrow: segments to one row for each document: ids, n_words, hits (disjoint runs of hit words), items."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = windows.value
        sizes = np.array([len(t) for t in w.terms], np.int64)
        flat = np.concatenate(w.terms) if w.terms else np.zeros(0, np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if w.terms else np.zeros(0, np.int64)
        known = pa.array(w.vocabulary, pa.string())
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                row = {c: one.column(one.schema.get_field_index(c))[0].as_py() for c in ("segment", "n_words", "starts", "positions")}
                s = Segment(row)
                terms = one.column(one.schema.get_field_index("terms")).flatten()
                local = pc.fill_null(pc.index_in(known, value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64) if len(terms) and len(known) else np.full(len(known), -1, np.int64)
                # windows all of whose terms occur in this segment
                live = np.flatnonzero(np.minimum.reduceat(local[flat], first) >= 0) if len(flat) else []
                places, which = [], []
                for k in live:
                    at = phrase(s, local[w.terms[k]].tolist(), w.order[k])
                    if len(at):
                        places.append(at)
                        which.append(np.full(len(at), k))
                n = len(s.n_words)
                hits: list[list[dict]] = [[] for _ in range(n)]
                items: list[list[str]] = [[] for _ in range(n)]
                if places:
                    place, win = np.concatenate(places), np.concatenate(which)
                    doc = s.document(place)
                    found: dict[int, set[str]] = {}
                    for d, k in set(zip(doc.tolist(), win.tolist(), strict=True)):
                        found.setdefault(d, set()).update(w.items[k])
                    for d, names_of in found.items():
                        items[d] = sorted(names_of)
                    order = np.argsort(place, kind="stable")
                    for d, a, b in zip(doc[order].tolist(), place[order].tolist(), (place + sizes[win])[order].tolist(), strict=True):
                        a, b = a - int(s.first[d]), b - int(s.first[d])
                        if hits[d] and a <= hits[d][-1]["end"]:
                            hits[d][-1]["end"] = max(hits[d][-1]["end"], b)
                        else:
                            hits[d].append({"start": a, "end": b})
                out = {"segment": pa.array([row["segment"]] * n), "ord": pa.array(range(n), pa.int32()), "n_words": pa.array(s.n_words, pa.int64()), "hits": pa.array(hits, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), "items": pa.array(items, pa.list_(pa.string()))}
                for c in names:
                    out[c] = one.column(one.schema.get_field_index(c)).flatten()
                yield pa.RecordBatch.from_pydict(out)

    return match


def prepared(docs: DataFrame, benchmark: DataFrame, ids: list[str], text_col: str, item_col: str, item_text: str, length: int) -> list[tuple]:
    """[(index, windows as a broadcast)]: one for each block of items, all with the same index."""
    spark = docs.sparkSession
    items = benchmark.where(F.col(f"`{item_col}`").isNotNull()).select(F.col(f"`{item_col}`").cast("string").alias("item"), F.coalesce(F.col(f"`{item_text}`"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    table, out = None, []
    for b in range(blocks):
        some = [(r.item, words_of(r.text)) for r in items.where(part == b).collect()]
        windows = Windows(some, length)
        if table is None:
            table = index(docs, ids, text_col, windows.vocabulary if blocks == 1 else None)
        counts = table.mapInArrow(term_counts, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
        if blocks > 1:
            words = spark.createDataFrame([(w,) for w in windows.vocabulary], "term string")
            counts = counts.join(words, "term", "left_semi")
        windows.rank({r.term: r.n for r in counts.collect()})  # no more rows than the block's items have words
        out.append((table, spark.sparkContext.broadcast(windows)))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, ids: list[str], *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", length: int = 13) -> DataFrame:
    """One row per document: ``ids``, n_words, hits (runs of words inside an item's window), items (ids as strings, sorted).

    An item's windows are its runs of ``length`` words; an item of fewer words is one
    window.  Null texts have no words; items without an id or words take no part;
    empty tables give no rows, or rows without hits.  Repeated documents each get a row;
    texts are read whole.  Other columns, whatever their names, take no part; ``ids``
    can't be called like a result.
    """
    if length > GAP:
        raise ValueError(f"windows can have {GAP} words at most")
    checked(ids, ("n_words", "hits", "items"))
    names = [f"__id_{i}" for i in range(len(ids))]
    results = []
    for table, windows in prepared(docs, benchmark, ids, text_col, item_col, item_text, length):
        fields = [T.StructField("segment", T.StringType()), T.StructField("ord", T.IntegerType()), T.StructField("n_words", T.LongType()), *T.StructType.fromDDL(HITS).fields]
        fields += [T.StructField(n, table.schema[n].dataType.elementType) for n in names]
        results.append(table.mapInArrow(matcher(windows, names), T.StructType(fields)))
    out = results[0] if len(results) == 1 else merged(results, names)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, ids, strict=True)], "n_words", "hits", "items")


def checked(ids: list[str], results: tuple[str, ...]) -> None:
    if clash := [c for c in ids if c in results]:
        raise ValueError(f"ids can't be called like results: {clash}")


def finder(windows, names: list[str], distance: int):
    """mapInArrow: segments to one row for each match: ids, item, kind, start, end (words from 0, end exclusive)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = windows.value
        known = pa.array(w.vocabulary, pa.string())
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                s = Segment({c: one.column(one.schema.get_field_index(c))[0].as_py() for c in ("n_words", "starts", "positions")})
                terms = one.column(one.schema.get_field_index("terms")).flatten()
                if not len(terms) or not len(known):
                    continue
                local = pc.fill_null(pc.index_in(known, value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                owners = [one.column(one.schema.get_field_index(c)).flatten() for c in names]
                for window, items, order in zip(w.terms, w.items, w.order, strict=True):
                    own = local[window]
                    if own.min() < 0:
                        continue
                    exact = phrase(s, own.tolist(), order)
                    rare = list(dict.fromkeys(own[order].tolist()))  # each term once, the rarest first
                    close = near(s, rare, list(range(len(rare))), distance)
                    for kind, places, span in (("phrase", exact, len(window)), ("near", close, 1)):
                        for item in items if len(places) else ():
                            doc = s.document(places)
                            start = places - s.first[doc]
                            found = {"item": pa.array([item] * len(places)), "kind": pa.array([kind] * len(places)), "start": pa.array(start, pa.int64()), "end": pa.array(start + span, pa.int64())}
                            yield pa.RecordBatch.from_pydict(found | {c: v.take(pa.array(doc)) for c, v in zip(names, owners, strict=True)})
        release()

    return find


def search(docs: DataFrame, phrases: DataFrame, ids: list[str], *, distance: int = 16, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Every match of whole items as a row: ``ids``, item, kind, start, end.

    kind ``phrase``: the item's words in order at words start..end.  kind ``near``: an occurrence
    (start) of the item's term that is rarest in the corpus with all its other terms within
    ``distance`` words of it, in any order.  Items of more than GAP words are an error; null texts have no
    words; items without an id or words match nothing; empty tables give no rows; repeated
    documents each have their own matches.
    """
    if distance > GAP:
        raise ValueError(f"distances can be {GAP} words at most")
    checked(ids, ("item", "kind", "start", "end"))
    # runs of word characters, by the same definition as words_of()
    longest = phrases.where(F.col(f"`{item_col}`").isNotNull()).agg(F.max(F.size(F.filter(F.split(F.lower(F.col(f"`{item_text}`")), WORD_GAP), lambda w: w != "")))).first()[0]
    if (longest or 0) > GAP:
        raise ValueError(f"items can have {GAP} words at most, one has {longest}")
    names = [f"__id_{i}" for i in range(len(ids))]
    out = None
    for table, windows in prepared(docs, phrases, ids, text_col, item_col, item_text, GAP):
        fields = T.StructType.fromDDL("item string, kind string, start long, end long").fields
        fields += [T.StructField(n, table.schema[n].dataType.elementType) for n in names]
        found = table.mapInArrow(finder(windows, names, distance), T.StructType(fields))
        out = found if out is None else out.unionByName(found)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, ids, strict=True)], "item", "kind", "start", "end")


def merged(results: list[DataFrame], names: list[str]) -> DataFrame:
    """The blocks' rows of each document as one."""
    every = results[0]
    for r in results[1:]:
        every = every.unionByName(r)
    run = "array<struct<start:int,end:int>>"

    def fold(done, h):
        last = F.try_element_at(done, F.lit(-1))
        longer = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], h["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (h["start"] <= last["end"]), longer).otherwise(F.concat(done, F.array(h))).cast(run)

    whole = every.groupBy("segment", "ord").agg(F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("h"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), *[F.first(n).alias(n) for n in names])
    return whole.withColumn("hits", F.aggregate("h", F.expr(f"cast(array() as {run})"), fold)).drop("h")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns of :func:`decontaminate`'s result."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["end"] - h["start"])
    return found.withColumn("n_hit", n_hit).select(
        F.col(id_col),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"),
    )
