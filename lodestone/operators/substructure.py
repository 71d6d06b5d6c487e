"""Structural alerts: substructures found by joining bonds, the rarest bond of a pattern first.

Patterns are rows (alert, ord, smiles).  A pattern's bonds are put in an order in which
each hangs on those before, beginning with the one whose type is rarest in the
corpus.  Molecules' bonds meet the first bonds by an equi-join on bond types, map-side,
as the table of patterns is small (its size is checked); every further bond extends
the partial mappings of a row along its neighbour lists.  Mappings never leave the row
of their first bond, and one aggregate counts them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import graphs, smiles
from lodestone.session import kept

#: Patterns are collected, ordered and sent to all tasks; more are an error.
MOST_PATTERNS = 10_000
STEP = "struct<at:int,to:int,kind:string,code:string>"
PLAN = f"alert string, ord int, first string, kind string, second string, steps array<{STEP}>, size int"

# Groups that a design is rejected for, as plain SMILES fragments.
ALERTS = [
    ("nitro", "[N+](=O)[O-]"), ("peroxide", "OO"), ("acyl chloride", "ClC=O"), ("anhydride", "O=COC=O"), ("aldehyde-like enal", "C=CC=O"), ("azo", "N=N"), ("disulfide", "SS"),
    ("thiocarbonyl", "C=S"), ("isocyanate", "N=C=O"), ("alkyl bromide", "CBr"), ("alkyl iodide", "CI"), ("hydrazine", "NN"), ("triple bond", "C#C"), ("imine", "C=N"), ("sulfonyl", "O=S=O"), ("thiol or thioether", "CS"), ("epoxide", "C1OC1"),
]


def code(x: Column) -> Column:
    return F.concat_ws(":", x["elem"], x["aromatic"].cast("int"), x["charge"])


def kind(e: Column) -> Column:
    return F.when(e["aromatic"], "a").otherwise(e["order"].cast("string"))


def directed(rows: DataFrame, *keep: str) -> DataFrame:
    """A row for each bond and direction: (u, v, first, kind, second)."""
    ends = lambda b, u, v: F.struct(b[u].alias("u"), b[v].alias("v"), code(F.get("atoms", b[u] - 1)).alias("first"), kind(b).alias("kind"), code(F.get("atoms", b[v] - 1)).alias("second"))
    return rows.select(*keep, F.explode(F.flatten(F.transform("bonds", lambda b: F.array(ends(b, "a", "b"), ends(b, "b", "a"))))).alias("e")).select(*keep, "e.*")


def ordered_steps(atoms: list[str], bonds: list[tuple[int, int, str]], rarity: dict[tuple[str, str, str], int]) -> tuple[tuple[str, str, str], list[tuple[int, int, str, str]]]:
    """The rarest bond's type, and the others as (slot it hangs on, slot it leads to, kind, code); slots in the order they are met."""
    count = lambda b: rarity.get((atoms[b[0]], b[2], atoms[b[1]]), 0)
    first = min(bonds, key=lambda b: (count(b), b))
    met, left, steps = [first[0], first[1]], [b for b in bonds if b != first], []
    while left:
        hanging = [b for b in left if b[0] in met or b[1] in met]
        if not hanging:
            raise ValueError("a pattern has to be one piece")
        # bonds between atoms that are met first, then the rarest
        b = min(hanging, key=lambda b: (not (b[0] in met and b[1] in met), count(b), b))
        left.remove(b)
        u, v = (b[0], b[1]) if b[0] in met else (b[1], b[0])
        if v not in met:
            met.append(v)
        steps.append((met.index(u), met.index(v), b[2], atoms[v]))
    return (atoms[first[0]], first[2], atoms[first[1]]), steps


def plans(patterns: DataFrame, molecules: DataFrame) -> DataFrame:
    """One small row for each pattern; patterns without bonds or that can't be read are an error."""
    spark = patterns.sparkSession
    read = graphs.perceived(kept(patterns.select("alert", "ord", smiles.graph(F.col("smiles")).alias("graph")))).select("alert", "ord", F.transform("atoms", code).alias("codes"), F.transform("bonds", lambda b: F.struct(b["a"], b["b"], kind(b))).alias("bonds"))
    rows = read.limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns")
    if bad := [r["alert"] for r in rows if not r["bonds"]]:
        raise ValueError(f"no pattern with bonds: {bad[:5]}")
    # a row for each type of bond that there is: elements, charges and orders, not molecules
    rarity = {(r["first"], r["kind"], r["second"]): r["count"] for r in directed(molecules).groupBy("first", "kind", "second").count().collect()}
    out = []
    for r in rows:
        start, steps = ordered_steps(r["codes"], [(b[0] - 1, b[1] - 1, b[2]) for b in r["bonds"]], rarity)
        out.append((r["alert"], r["ord"], *start, steps, len(r["codes"])))
    return spark.createDataFrame(out, PLAN)


def extended(mappings: Column, step: Column) -> Column:
    """Partial mappings (arrays of places, by slot) with one more bond: to an atom that isn't mapped yet, or between two that are."""

    def grow(m: Column) -> Column:
        fits = lambda e: (kind(e) == step["kind"]) & (code(F.get("atoms", e["to"] - 1)) == step["code"])
        near = F.filter(F.get("beside", F.get(m, step["at"]) - 1), fits)
        closing = F.when(F.exists(near, lambda e: e["to"] == F.get(m, step["to"])), F.array(m)).otherwise(F.expr("cast(array() as array<array<int>>)"))
        longer = F.transform(F.filter(near, lambda e: ~F.array_contains(m, e["to"])), lambda e: F.concat(m, F.array(e["to"])))
        return F.when(step["to"] < F.size(m), closing).otherwise(longer)

    return F.flatten(F.transform(mappings, grow))


def matches(molecules: DataFrame, patterns: DataFrame, key: str) -> DataFrame:
    """(key, alert, ord, n_mappings, n_places) of every pattern that a molecule holds: its mappings and the sets of atoms they cover.

    ``molecules``: :func:`lodestone.functions.graphs.perceived` rows; ``patterns``: (alert, ord, smiles).
    An atom matches one of its element, aromaticity and charge, a bond one of its order
    or aromaticity; hydrogens and further neighbours are free."""
    small = F.broadcast(plans(patterns, molecules))  # MOST_PATTERNS rows at most
    edges = directed(molecules.select(F.col(key).alias("k"), "atoms", "beside", "bonds"), "k", "atoms", "beside")
    starts = edges.join(small, ["first", "kind", "second"])
    found = F.aggregate("steps", F.array(F.array("u", "v")), extended)
    rows = starts.select("k", "alert", "ord", F.explode(found).alias("m"))
    # a symmetric first bond is met from both ends; every mapping begins with another pair
    return rows.groupBy("k", "alert", "ord").agg(F.count("*").alias("n_mappings"), F.count_distinct(F.array_sort("m")).alias("n_places")).withColumnRenamed("k", key)


def first_alert(molecules: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, alert, n_alerts): the first alert of each molecule by ``ord``, null if it passes."""
    per = found.groupBy(key).agg(F.min_by("alert", "ord").alias("alert"), F.count("*").alias("n_alerts"))
    return molecules.select(key).join(per, key, "left").withColumn("n_alerts", F.coalesce("n_alerts", F.lit(0)))


