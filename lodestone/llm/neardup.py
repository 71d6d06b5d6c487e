"""N-gram Jaccard join with a MinHash LSH forest and exact verification.

Texts are sets of five-word shingles.  Equal sets are one class from the start,
so exact copies cost one row however many there are.  Each distinct set has a
signature of ``TREES`` labels of ``DEPTH`` MinHash values: its paths in the
prefix tries of the forest.  Two sets meet where they share a path's prefix.
Prefixes are shortened until a pair at the similarity threshold meets in some
trie with the target recall; below that node all members are compared, from the
deepest nodes up, and only pairs that aren't tied yet.

What comes of that are ties of sets whose estimated similarity is near the
threshold, at most one for each member of a node, never all pairs.  Their
connected components are small families of really similar texts; within each,
similarities are exact, by products of incidence matrices, and links are
counted without a row for each.  Large nodes and families are dealt out as pairs
of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import letters_digest, release, row_groups, sized, slices, stored, tokens
from .components import components

TREES, DEPTH = 32, 8
#: Members of a node, and sets of a family, that one task compares at once.
NODE_BLOCK, FAMILY_BLOCK = 2048, 1024
#: Shingles of a block of a family.
FAMILY_SHINGLES = 2_000_000
COLUMNS = 4096


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def multipliers() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[: TREES * DEPTH] | np.uint64(1), seeds[TREES * DEPTH :]


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles; a text of fewer words, but not none, is one shingle."""
    import xxhash

    flat, counts = tokens(texts)
    coded = flat.dictionary_encode()
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    word = known[coded.indices.to_numpy(zero_copy_only=False)] if len(known) else np.zeros(0, np.uint64)
    ends = np.cumsum(counts)
    n = len(word) - width + 1
    whole = np.zeros(max(n, 0), np.uint64)
    factor = mix(np.arange(1, width + 1, dtype=np.uint64))  # odd or not, positions differ
    for i in range(width):
        if n > 0:
            whole = mix(whole + word[i : i + n] * (factor[i] | np.uint64(1)))
    out = []
    for start, end in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        if end - start >= width:
            out.append(np.unique(whole[start : end - width + 1]))
        elif end > start:
            short = np.zeros(1, np.uint64) + np.uint64(end - start)
            for w in word[start:end]:
                short = mix(short * np.uint64(31) + w)
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 16-bit label for each MinHash value, trie by trie."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 512):
        np.minimum(low, (shingles[i : i + 512, None] * a[None, :] + b[None, :]).min(axis=0), out=low)
    return (mix(low) >> np.uint64(48)).astype(np.uint16)


def signer(width: int):
    """mapInArrow: (id, text_key, __text) to (id, text_key, set_key, n, sig); sig only with a set's first row in a slice."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = multipliers()
        for batch in slices(batches, "__text"):
            keys, sizes, signs, seen = [], [], [], set()
            for s in shingle_sets(batch.column(batch.schema.get_field_index("__text")), width):
                key = letters_digest(s) if len(s) else None
                keys.append(key)
                sizes.append(len(s))
                signs.append(None if key is None or key in seen else signature(s, a, b).tobytes())
                seen.add(key)
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "text_key": batch.column(1), "set_key": pa.array(keys, pa.binary()), "n": pa.array(sizes, pa.int32()), "sig": pa.array(signs, pa.binary())})
        release()

    return sign


def depth_for(threshold: float, recall: float) -> int:
    """The longest prefix at which a pair of just that similarity meets in some trie with the target recall."""
    for k in range(DEPTH, 1, -1):
        if 1 - (1 - threshold**k) ** TREES >= recall:
            return k
    return 1


def planter(depth: int):
    """mapInArrow: (set_key, sig) to the node at ``depth`` of each trie."""

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = mix(np.arange(1, depth + 1, dtype=np.uint64)) | np.uint64(1)
        salt = mix(np.arange(1, TREES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for batch in batches:
            m = batch.num_rows
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(m, TREES, DEPTH)[:, :, :depth].astype(np.uint64)
            node = np.broadcast_to(salt, (m, TREES)).copy()
            for d in range(depth):
                node = mix(node + (sig[:, :, d] + np.uint64(1)) * factor[d])
            yield pa.RecordBatch.from_pydict({"node": node.reshape(-1).astype(np.int64), "tree": np.tile(np.arange(TREES, dtype=np.int32), m), "set_key": batch.column(0).take(pa.array(np.repeat(np.arange(m), TREES)))})

    return plant


class Ties:
    """Disjoint sets over 0..n-1, the root being the smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def tie(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)

    def roots(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.up))])


def climb(paths: list[bytes], sig: np.ndarray, depth: int, floor: float) -> Ties:
    """Tie members of one node whose estimated similarity is at least ``floor``, from its deepest descendants up."""
    n = len(paths)
    ties = Ties(n)
    order = sorted(range(n), key=lambda i: paths[i])
    least = math.ceil(floor * sig.shape[1])
    for d in range(DEPTH, depth - 1, -1):
        a = 0
        while a < n:
            b = a
            while b < n and paths[order[b]][: 2 * d] == paths[order[a]][: 2 * d]:
                b += 1
            some = np.array(order[a:b])
            roots = np.array([ties.root(i) for i in some.tolist()])
            for x in range(len(some) - 1):
                rest = np.flatnonzero(roots[x + 1 :] != roots[x]) + x + 1
                if not len(rest):
                    continue
                near = rest[(sig[some[rest]] == sig[some[x]]).sum(axis=1) >= least]
                if len(near):
                    for y in near.tolist():
                        ties.tie(int(some[x]), int(some[y]))
                    roots = np.array([ties.root(i) for i in some.tolist()])
            a = b
    return ties


def tier(depth: int, floor: float):
    """mapInArrow over (node, i, j, tree, set_key, sig) sorted by node, i, j: ties (a, b)."""

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in row_groups(batches, ["node", "i", "j"]):
            if table.num_rows < 2:
                continue
            keys, tree = table.column("set_key").to_pylist(), table.column("tree")[0].as_py()
            labels = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(len(keys), TREES, DEPTH)
            # paths in byte order, so that sorting them is the trie's order
            paths = [x.tobytes() for x in labels[:, tree].astype(">u2")]
            roots = climb(paths, labels.reshape(len(keys), -1).astype(np.uint8), depth, floor).roots()
            tied = np.flatnonzero(roots != np.arange(len(keys)))
            if len(tied):
                yield pa.RecordBatch.from_pydict({"a": pa.array([keys[i] for i in tied], pa.binary()), "b": pa.array([keys[r] for r in roots[tied]], pa.binary())})
        release()

    return tie


def blocked(rows: DataFrame, blocks, key: str) -> DataFrame:
    """Each row with the pairs (i, j), i <= j, of blocks that its own block belongs to."""
    own = F.pmod(F.xxhash64(F.col(key)), blocks.cast("long")).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1))
    rows = rows.withColumn("__own", own).select("*", other.alias("__other"))
    return rows.withColumn("i", F.least("__own", "__other")).withColumn("j", F.greatest("__own", "__other")).withColumn("own", F.col("__own")).drop("__own", "__other")


def set_maker(width: int):
    """mapInArrow: texts to (set_key, shingles), each set once for each slice."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in slices(batches, "__text"):
            keys, sets = [], []
            for s in shingle_sets(batch.column(0), width):
                if len(s) and (key := letters_digest(s)) not in seen:
                    seen.add(key)
                    keys.append(key)
                    sets.append(s.tobytes())
            if len(seen) > 100_000:
                seen.clear()
            yield pa.RecordBatch.from_pydict({"set_key": pa.array(keys, pa.binary()), "shingles": pa.array(sets, pa.binary())})
        release()

    return make


def linked(sets: list[np.ndarray], t: Fraction) -> np.ndarray:
    """The boolean matrix of pairs whose exact Jaccard similarity is at least ``t``."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    every, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    shared = np.bincount(code, minlength=len(every)) > 1
    keep = shared[code]
    renamed = np.cumsum(shared) - 1
    code, owner = renamed[code[keep]], owner[keep]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    common = np.zeros((n, n), np.float32)
    for a in range(0, int(shared.sum()), COLUMNS):
        lo, hi = np.searchsorted(code, [a, a + COLUMNS])
        some = np.zeros((n, min(COLUMNS, int(shared.sum()) - a)), np.float32)
        some[owner[lo:hi], code[lo:hi] - a] = 1
        common += some @ some.T
    common = common.astype(np.int64)
    return common * (t.numerator + t.denominator) >= t.numerator * (sizes[:, None] + sizes[None, :])


def counter(t: Fraction):
    """mapInArrow over a family's blocks, sorted by family, i, j: for each set its links there, and its root among them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in row_groups(batches, ["family", "i", "j"]):
            first: dict[bytes, int] = {}
            for at, key in enumerate(table.column("set_key").to_pylist()):
                first.setdefault(key, at)
            table = table.take(pa.array(list(first.values())))
            keys = table.column("set_key").to_pylist()
            order = sorted(range(len(keys)), key=keys.__getitem__)  # the root is the least key
            table, keys = table.take(pa.array(order)), [keys[i] for i in order]
            sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
            match = linked(sets, t)
            np.fill_diagonal(match, False)
            own = table.column("own").to_numpy()
            if table.column("i")[0].as_py() != table.column("j")[0].as_py():
                match &= own[:, None] != own[None, :]  # pairs within a block are counted where it meets itself
            copies = table.column("copies").to_numpy()
            ties = Ties(len(keys))
            for i in range(len(keys)):
                for j in np.flatnonzero(match[i, i + 1 :]).tolist():
                    ties.tie(i, i + 1 + j)
            roots = ties.roots()
            yield pa.RecordBatch.from_pydict({"set_key": pa.array(keys, pa.binary()), "blocks": table.column("blocks").combine_chunks(), "root": pa.array([keys[r] for r in roots], pa.binary()), "set_links": match.sum(axis=1).astype(np.int64), "doc_links": (match * copies[None, :]).sum(axis=1).astype(np.int64)})
        release()

    return count


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5, threshold: float = 0.8, recall: float = 0.99999) -> DataFrame:
    """One row per row of ``docs``: id, class_id, n_links, n_copies, n_set_links.

    class_id: the least id of the connected component under similarity >= ``threshold``;
    n_links: other rows at least so similar to this one (equal sets included);
    n_copies: rows with the same set of shingles, this one included; n_set_links: different
    sets at least so similar.  A text of fewer than ``width`` words is one shingle; a text
    without words (null too) is a class of its own with no links.  Ids may be null or repeated,
    and repeated rows each get a row; texts are read whole, however long; an empty table gives an
    empty table; other columns of ``docs``, whatever their names, play no part.
    """
    text = F.col(f"`{text_col}`").cast("string")
    # the least id wins; a null id is no id
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("text_key"), text.alias("__text"))
    kind = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("text_key", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("sig", T.BinaryType())])
    signed = stored(rows.mapInArrow(signer(width), schema), "near-signed")
    reps = signed.where("set_key is not null").groupBy("set_key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.min("n").alias("n"), F.min("text_key").alias("text_key"), F.first("sig", ignorenulls=True).alias("sig"))
    reps = stored(reps, "near-sets")

    # forest: nodes with more than one member
    depth = depth_for(threshold, recall)
    # a set of n shingles is at most n / (n + 1) similar to another one: the smallest can't have links
    exact = Fraction(str(threshold))
    least = math.ceil(exact / (1 - exact)) if exact < 1 else None
    plants = reps.where(F.col("n") >= least) if least is not None else reps.where("false")
    nodes = plants.select("set_key", "sig").mapInArrow(planter(depth), "node long, tree int, set_key binary")
    full = nodes.groupBy("node").agg(F.count("*").alias("members")).where("members > 1")
    members = nodes.join(full, "node").join(reps.select("set_key", "sig"), "set_key")
    members = blocked(members, F.ceil(F.col("members") / NODE_BLOCK), "set_key").select("node", "i", "j", "tree", "set_key", "sig")
    # by key within a node, so that its ties lead to its least set, the same one in most tries
    members = members.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j", "set_key")
    # four and a half standard errors of the estimate below the threshold
    floor = threshold - 4.5 * math.sqrt(threshold * (1 - threshold) / (TREES * DEPTH))
    found = components(members.mapInArrow(tier(depth, floor), "a binary, b binary"))

    # families of similar sets: exact links within each
    belongs = found.select(F.col("a").alias("set_key"), F.col("b").alias("family")).unionByName(found.select(F.col("b").alias("set_key"), F.col("b").alias("family")).distinct())
    belongs = stored(belongs.join(reps.select("set_key", "copies", "n", "text_key"), "set_key"), "near-families")
    sizes = belongs.groupBy("family").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    sizes = sizes.select("family", F.greatest(F.ceil(F.col("m") / FAMILY_BLOCK), F.ceil(F.col("total") / FAMILY_SHINGLES)).cast("int").alias("blocks"))
    wanted = stored(belongs.select("text_key").distinct(), "near-texts")
    sets = rows.join(sized(wanted), "text_key", "left_semi").select("__text").mapInArrow(set_maker(width), "set_key binary, shingles binary")
    dealt = belongs.select("set_key", "family", "copies").join(sizes, "family").join(sets, "set_key")
    dealt = blocked(dealt, F.col("blocks"), "set_key").repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
    links = stored(dealt.mapInArrow(counter(Fraction(str(threshold))), "set_key binary, blocks int, root binary, set_links long, doc_links long"), "near-links")

    # a family in several blocks: its ties across blocks once more
    split = links.where("blocks > 1")
    total = links.groupBy("set_key").agg(F.sum("set_links").alias("set_links"), F.sum("doc_links").alias("doc_links"), F.min("root").alias("root"))
    if split.limit(1).count():
        joined = components(split.select(F.col("set_key").alias("a"), F.col("root").alias("b")))
        total = total.join(joined.select(F.col("a").alias("set_key"), F.col("b").alias("whole")), "set_key", "left").withColumn("root", F.when(F.col("whole").isNotNull(), F.col("whole")).otherwise(F.col("root"))).drop("whole")
        own = split.select("set_key").distinct().join(joined.select(F.col("a").alias("set_key")), "set_key", "left_anti").withColumn("self", F.col("set_key"))
        total = total.join(own, "set_key", "left").withColumn("root", F.coalesce("self", "root")).drop("self")
    known = reps.select("set_key", "rep", "copies").join(total, "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    least = known.groupBy("root").agg(F.min("rep").alias("class_id"))
    known = known.join(least, "root").select("set_key", "class_id", "copies", F.coalesce("set_links", F.lit(0)).alias("set_links"), F.coalesce("doc_links", F.lit(0)).alias("doc_links"))
    with_words = signed.where("set_key is not null").select("id", "set_key").join(known, "set_key")
    with_words = with_words.select("id", "class_id", (F.col("doc_links") + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"), F.col("set_links").alias("n_set_links"))
    zero = F.lit(0).cast("long")
    without = signed.where("set_key is null").select("id", F.col("id").alias("class_id"), zero.alias("n_links"), F.lit(1).cast("long").alias("n_copies"), zero.alias("n_set_links"))
    return with_words.unionByName(without)
