"""Molecules that grow by fragments: graph unions with renumbered places, checked by valence, and a memo of scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import graphs, smiles
from lodestone.functions.smiles import ATOM, BOND, GRAPH, VALENCES, degree_sum
from lodestone.session import kept, met, spread

from . import beam

#: Kinds of fragments: how a place to attach is chosen.
RING, FIXED, FIRST = "ring", "fixed", "first"


def library(rows: DataFrame) -> DataFrame:
    """Fragments (name, smiles, kind, order, map, stereo) with their graph and ``place``, where they are bonded on.

    kind ``fixed``: at the atom with that map number; ``first``: at the first atom (single
    atoms, alkenes); ``ring``: at the first heavy atom with a hydrogen that is no aromatic
    nitrogen, else at the first heavy atom.  Text that is no SMILES, and fixed fragments
    without their number, go."""
    read = kept(rows.withColumn("fragment", smiles.graph(F.col("smiles")))).where(F.col("fragment").isNotNull())
    atoms = F.col("fragment")["atoms"]
    at = lambda test: F.get(F.filter(F.transform(atoms, lambda x, i: F.when(test(x), (i + 1).cast("int"))), lambda i: i.isNotNull()), 0)
    free = at(lambda x: (x["elem"] != "H") & (x["h"] > 0) & ~(x["aromatic"] & (x["elem"] == "N")))
    place = F.when(F.col("kind") == FIXED, at(lambda x: x["map"] == F.col("map"))).when(F.col("kind") == RING, F.coalesce(free, at(lambda x: x["elem"] != "H"))).otherwise(1)
    return read.withColumn("place", place).where(F.col("place").isNotNull())


def room(atoms: Column, bonds: Column, i: Column, order: Column) -> Column:
    """The hydrogens of atom ``i`` once it has a further bond of ``order``: one less for each, or what the next usual valence asks for; null where there is none."""
    x = F.get(atoms, i - 1)
    usual = F.create_map(*[y for k, v in VALENCES.items() for y in (F.lit(k), F.array(*[F.lit(n) for n in v]))])
    used = degree_sum(bonds, i) + x["aromatic"].cast("int") + order
    some = F.try_element_at(usual, x["elem"])
    some = F.filter(F.when(x["aromatic"], F.slice(some, 1, 1)).otherwise(some), lambda v: v + x["charge"] >= used)
    return F.when(x["h"] >= order, x["h"] - order).otherwise(F.array_min(some) + x["charge"] - used)


def bonded(graph: Column, attach: Column, here: Column, fragment: Column, place: Column, there: Column, order: Column) -> Column:
    """The union of both graphs with a bond from atom ``attach`` of the one to atom ``place`` of the other (places from 1), which keep ``here`` and ``there`` hydrogens (see :func:`room`).

    The fragment's places follow the graph's; map numbers go."""
    n = F.size(graph["atoms"])
    part = lambda atoms, at, left: F.transform(atoms, lambda x, i: F.when(i == at - 1, x.withField("h", left.cast("int"))).otherwise(x).withField("map", F.lit(0)))
    moved = F.transform(fragment["bonds"], lambda b: b.withField("a", b["a"] + n).withField("b", b["b"] + n))
    new = F.struct(attach.cast("int").alias("a"), (place + n).cast("int").alias("b"), order.cast("int").alias("order"), F.lit(False).alias("aromatic")).cast(BOND)
    atoms = F.concat(part(graph["atoms"], attach, here), part(fragment["atoms"], place, there)).cast(f"array<{ATOM}>")
    return F.struct(atoms.alias("atoms"), F.concat(graph["bonds"], F.array(new), moved).cast(f"array<{BOND}>").alias("bonds")).cast(GRAPH)


def seeds(anchors: DataFrame, elem: str = "C") -> DataFrame:
    """Anchors with ``graph``: one atom with all its hydrogens."""
    return anchors.withColumn("graph", smiles.graph(F.lit(elem)))


def grown(states: DataFrame, fragments: DataFrame, group: list[str], max_attach: int, max_frags: int, seed: int) -> DataFrame:
    """Each state (columns ``group`` and graph) at up to ``max_attach`` atoms with hydrogens, by up to ``max_frags`` fragments each, drawn by a seeded digest; products that no valence allows are left out.

    ``fragments``: :func:`library`, a few dozen rows.  Adds name, stereo, attach, the product's graph, key and descriptors."""
    rows = states.withColumn("__graph", F.sha2(F.to_json("graph"), 256))
    return grown_from(rows.drop("graph"), kept(rows.groupBy("__graph").agg(F.first("graph").alias("graph"))), "__graph", fragments, group, max_attach, max_frags, seed).drop("__graph")


def grown_from(states: DataFrame, found: DataFrame, by: str, fragments: DataFrame, group: list[str], max_attach: int, max_frags: int, seed: int) -> DataFrame:
    """:func:`grown` of states whose graphs are in ``found`` (``by``, graph), each once.

    What is drawn are places and names; a product of one graph, place and fragment is built and described once, however many states draw it."""
    parts = kept(fragments.select("name", "fragment", "place", "order", "stereo").withColumn("__part", F.monotonically_increasing_id()))
    free = F.filter(F.transform(F.col("graph")["atoms"], lambda x, i: F.when((x["h"] > 0) & (x["elem"] != "H"), i)), lambda i: i.isNotNull())
    own = [c for c in states.columns if c not in ("key", "graph", "atoms", "bonds", "beside", "rings", "flat", *graphs.descriptors())]
    open_ = met(states.select(*own), kept(found.select(by, free.alias("__free"))), by).select(*own, F.explode("__free").alias("attach"))
    pairs = kept(beam.expansions(open_, parts.select("name", "__part"), group, max_attach, max_frags, seed))
    product = [by, "attach", "__part"]
    wanted = spread(pairs.select(*product).distinct(), *product).join(found.select(by, "graph"), by).join(F.broadcast(parts.drop("name")), "__part")
    g, f, at = F.col("graph"), F.col("fragment"), F.col("attach") + 1
    rows = kept(wanted.withColumns({"__here": room(g["atoms"], g["bonds"], at, F.col("order")), "__there": room(f["atoms"], f["bonds"], F.col("place"), F.col("order"))}))
    rows = rows.where("__here is not null and __there is not null").withColumn("graph", bonded(g, at, F.col("__here"), f, F.col("place"), F.col("__there"), F.col("order")))
    return pairs.join(keyed(kept(rows.select(*product, "stereo", "graph"))), product).drop("__part")


def keyed(states: DataFrame) -> DataFrame:
    """With ``key`` (see :func:`lodestone.functions.graphs.canonical_key`) and the descriptors."""
    described = graphs.descriptors()
    own = [c for c in states.columns if c not in ("key", *described)]
    rows = graphs.perceived(states.select(*own))
    return rows.select(*own, graphs.canonical_key().alias("key"), *[c.alias(n) for n, c in described.items()])


class Memo:
    """Scores by key, each computed once however many steps and groups meet it.

    ``compute`` turns rows (key and the columns that it needs) into (key, value); keys
    that it leaves out, or gives null, are failures, kept as null and never asked for
    again.  The table grows by a written part for each call."""

    def __init__(self, compute: Callable[[DataFrame], DataFrame], columns: list[str], known: DataFrame | None = None):
        self.compute, self.columns, self.table = compute, columns, known
        self.asked = 0

    def scored(self, states: DataFrame, into: str) -> DataFrame:
        need = states.groupBy("key").agg(*[F.first(c).alias(c) for c in self.columns])
        if self.table is not None:
            need = need.join(self.table.select("key"), "key", "left_anti")
        need = kept(need)
        new = kept(need.select("key").join(self.compute(need), "key", "left").select("key", F.col("value").cast("double").alias("value")))
        self.asked += new.count()
        self.table = new if self.table is None else self.table.unionByName(new)
        return states.join(self.table.withColumnRenamed("value", into), "key", "left")


def search(anchors: DataFrame, fragments: DataFrame, memo: Memo, *, group: str, accept: Column, grows: Column, beam_width: int, steps: int, max_output: int, max_attach: int, max_frags: int, seed: int) -> DataFrame:
    """A beam over molecules from one atom an anchor, all anchors in one job: grow, score by the memo, keep one of each key, harvest, truncate.

    States without a score neither grow nor come out; order: score, then key."""
    start = kept(keyed(kept(seeds(anchors.select(group)))))
    start = start.withColumn("score", F.lit(0.0)).withColumn("parent", F.lit(None).cast("string"))
    columns = start.columns

    def expand(states: DataFrame) -> DataFrame:
        states = states.withColumn("parent", F.col("key"))
        out = kept(grown(states.drop("score", "rank"), fragments, [group, "parent"], max_attach, max_frags, seed))
        return memo.scored(out, "score").select(*columns)

    order = [F.desc_nulls_last("score"), F.col("key"), F.col("parent")]
    return beam.beam_search(start, expand, group=group, key="key", order=order, accept=accept & F.col("score").isNotNull(), grows=grows & F.col("score").isNotNull(), beam_width=beam_width, steps=steps, max_output=max_output)
