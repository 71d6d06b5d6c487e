"""Molecules as arrays of atoms and bonds, drug-likeness predicates, and the port for a chemistry toolkit."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import geometry

ATOM = "struct<elem:string,x:double,y:double,z:double>"
BOND = "struct<a:int,b:int,order:int>"
#: Average weights of the elements that designs are made of.
WEIGHTS = {"H": 1.008, "B": 10.81, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "Si": 28.085, "P": 30.974, "S": 32.06, "Cl": 35.45, "Br": 79.904, "I": 126.904}
DOCKABLE = ["H", "C", "N", "O", "F", "P", "S", "Cl", "Br", "I"]

DESCRIPTORS = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in ("MW", "LogP", "TPSA", "Fsp3", "QED", "SA")]
    + [T.StructField(n, T.IntegerType()) for n in ("HBD", "HBA", "RotBonds", "Rings", "ArRings", "HAC")]
    + [T.StructField("InChIKey", T.StringType()), T.StructField("canonical", T.StringType()), T.StructField("alert", T.BooleanType())]
)


def heavy_atoms(atoms: Column) -> Column:
    return F.size(F.filter(atoms, lambda a: a["elem"] != "H"))


def weight(atoms: Column) -> Column:
    """Sum of average weights of the atoms that are written out; null with an element that isn't known."""
    table = F.create_map(*[x for k, v in WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    return F.aggregate(atoms, F.lit(0.0), lambda s, a: s + F.try_element_at(table, a["elem"]))


def ring_count(atoms: Column, bonds: Column) -> Column:
    """Independent rings of a connected molecule."""
    return F.greatest(F.lit(0), F.size(bonds) - F.size(atoms) + 1)


def dockable(atoms: Column) -> Column:
    return F.forall(atoms, lambda a: a["elem"].isin(DOCKABLE))


def incompatible(atoms: Column, charges: Column | None = None) -> Column:
    """Why a molecule can't be docked, null if it can: an element that isn't supported, or a charge (array of doubles) that is missing or not finite."""
    bad = F.get(F.filter(atoms, lambda a: ~a["elem"].isin(DOCKABLE)), 0)
    why = F.when(bad.isNotNull(), F.concat(F.lit("unsupported element "), bad["elem"]))
    if charges is None:
        return why
    wrong = F.array_position(F.transform(charges, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), True)
    return why.when(wrong > 0, F.concat(F.lit("non-finite charge on atom "), (wrong - 1).cast("string")))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def fragment_labels(n_atoms: pd.Series, bonds: pd.Series) -> pd.Series:
    """For each atom the place (from 0) of the first atom that it is bonded to, directly or not."""

    def one(n: int, pairs) -> list[int]:
        up = list(range(n))

        def root(i: int) -> int:
            while up[i] != i:
                i = up[i]
            return i

        for b in pairs if pairs is not None else []:
            i, j = root(b["a"] - 1), root(b["b"] - 1)
            up[max(i, j)] = min(i, j)
        return [root(i) for i in range(n)]

    return pd.Series([one(int(n), p) for n, p in zip(n_atoms, bonds, strict=True)])


def largest_fragment(df: DataFrame, atoms: str = "atoms", bonds: str = "bonds") -> DataFrame:
    """With the atoms and bonds of the fragment that has most heavy atoms, then most atoms, then stands first; bonds are renumbered."""
    rows = df.withColumn("__of", fragment_labels(F.size(atoms), F.col(bonds)))
    size = lambda of: F.size(F.filter("__of", lambda x: x == of))
    heavy = lambda of: F.size(F.filter(F.arrays_zip(F.col(atoms).alias("a"), F.col("__of").alias("o")), lambda z: (z["o"] == of) & (z["a"]["elem"] != "H")))
    order = F.transform(F.array_distinct("__of"), lambda of: F.struct((-heavy(of)).alias("h"), (-size(of)).alias("n"), of.alias("of")))
    rows = rows.withColumn("__best", F.array_min(order)["of"])
    own = F.filter(F.sequence(F.lit(0), F.size(atoms) - 1), lambda i: F.get("__of", i) == F.col("__best"))
    rows = rows.withColumn("__own", F.when(F.size(atoms) > 0, own).otherwise(F.expr("cast(array() as array<int>)")))
    number = lambda i: F.array_position("__own", i - 1).cast("int")
    kept = F.filter(F.transform(bonds, lambda b: F.struct(number(b["a"]).alias("a"), number(b["b"]).alias("b"), b["order"].alias("order"))), lambda b: b["a"] > 0)
    return rows.withColumns({bonds: kept, atoms: F.transform("__own", lambda i: F.get(atoms, i))}).drop("__of", "__best", "__own")


def feature_direction(atoms: Column, bonds: Column, ids: Column) -> Column:
    """The unit vector from the neighbours of a feature's atoms (places from 0) to the atoms' centre; null without neighbours."""
    at = lambda i: F.array(F.get(atoms, i)["x"], F.get(atoms, i)["y"], F.get(atoms, i)["z"])
    own = lambda i: F.array_contains(ids, i - 1)
    out = F.flatten(F.transform(bonds, lambda b: F.when(own(b["a"]) & ~own(b["b"]), F.array(b["b"])).when(own(b["b"]) & ~own(b["a"]), F.array(b["a"])).otherwise(F.expr("cast(array() as array<int>)"))))
    away = geometry.centroid(F.transform(out, lambda i: at(i - 1)))
    return geometry.unit_vector(F.zip_with(geometry.centroid(F.transform(ids, at)), away, lambda a, b: a - b))


def ring_plane(atoms: Column, ids: Column) -> Column:
    """struct(centroid, normal) of a ring's atoms (places from 0)."""
    points = F.transform(ids, lambda i: F.array(F.get(atoms, i)["x"], F.get(atoms, i)["y"], F.get(atoms, i)["z"]))
    return F.struct(geometry.centroid(points).alias("centroid"), geometry.plane_normal(points).alias("normal"))


def grown(states: DataFrame, choices: DataFrame, attach: str = "attach") -> DataFrame:
    """States (atoms with free_h, bonds, the place to grow at, a choice's name) with the choice's atom and its extras bonded on.

    ``choices`` has a row for each name, a few dozen: (name, elem, order, free_h, extras array<struct<elem,order,free_h>>).
    A bond of higher order than the atom has free hydrogens is impossible and the state goes.
    Places of new atoms are null until the state is embedded."""
    rows = states.join(F.broadcast(choices.select("name", *[F.col(c).alias(f"__{c}") for c in ("elem", "order", "free_h", "extras")])), "name")
    here = F.get("atoms", F.col(attach))
    rows = rows.where(here["free_h"] >= F.col("__order")).withColumn("__n", F.size("atoms"))
    none = F.lit(None).cast("double")
    atom = lambda elem, free: F.struct(elem.alias("elem"), none.alias("x"), none.alias("y"), none.alias("z"), free.alias("free_h"))
    bond = lambda a, b, order: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), order.alias("order"))
    old = F.transform("atoms", lambda x, i: F.when(i == F.col(attach), x.withField("free_h", x["free_h"] - F.col("__order"))).otherwise(x))
    atoms = F.concat(old, F.array(atom(F.col("__elem"), F.col("__free_h"))), F.transform("__extras", lambda e: atom(e["elem"], e["free_h"])))
    bonds = F.concat("bonds", F.array(bond(F.col(attach) + 1, F.col("__n") + 1, F.col("__order"))), F.transform("__extras", lambda e, i: bond(F.col("__n") + 1, F.col("__n") + 2 + i, e["order"])))
    return rows.withColumns({"atoms": atoms, "bonds": bonds}).drop("__elem", "__order", "__free_h", "__extras", "__n")


def lipinski(mw: Column, logp: Column, hbd: Column, hba: Column) -> Column:
    return (mw <= 500) & (logp <= 5) & (hbd <= 5) & (hba <= 10)


def veber(rotatable: Column, tpsa: Column) -> Column:
    return (rotatable <= 10) & (tpsa <= 140)


def lead_like(mw: Column, logp: Column, rotatable: Column) -> Column:
    return (mw <= 350) & (logp <= 3.5) & (rotatable <= 7)


def canonical_key(smiles: Column) -> Column:
    """The key of a SMILES without a toolkit: its trimmed text, blank for null."""
    return F.trim(F.coalesce(smiles, F.lit("")))


class Port:
    """A chemistry toolkit behind vectorised functions.

    Toolkits register kernels by name (descriptors, fingerprint, canonical, embed,
    grow); each takes a pandas Series of SMILES or molecule blocks and returns one
    row for each.  Without a kernel, columns come out null and the engine works on
    values that are given as columns.
    """

    def __init__(self) -> None:
        self.kernels: dict[str, Callable[[pd.Series], pd.DataFrame]] = {}

    def register(self, name: str, kernel: Callable[[pd.Series], pd.DataFrame]) -> None:
        self.kernels[name] = kernel

    def apply(self, df: DataFrame, name: str, source: str, schema: T.StructType) -> DataFrame:
        """``df`` with the kernel's columns, Arrow batch by batch."""
        kernel = self.kernels.get(name)
        if kernel is None:
            return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema.fields})

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield pd.concat([frame.reset_index(drop=True), kernel(frame[source]).reset_index(drop=True)], axis=1)

        return df.mapInPandas(run, T.StructType([*df.schema.fields, *schema.fields]))

    def canonical(self, df: DataFrame, source: str, into: str = "canonical_smiles") -> DataFrame:
        """A canonical key; without a toolkit the trimmed text."""
        if "canonical" in self.kernels:
            return self.apply(df, "canonical", source, T.StructType([T.StructField(into, T.StringType())]))
        return df.withColumn(into, canonical_key(F.col(source)))


PORT = Port()
