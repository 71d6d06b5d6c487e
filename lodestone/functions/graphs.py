"""Molecule graphs (see :mod:`lodestone.functions.smiles`): rings, aromaticity, descriptors, circular fingerprints, canonical keys.

Everything is a column expression over one row's arrays, so nothing is shuffled.
:func:`perceived` adds what the others read; it stands between two projections, so
that each part is computed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import chemistry
from .smiles import ATOM, BOND, GRAPH, let

#: Rings are looked for up to this size.
LARGEST_RING = 8
#: Rounds of colour refinement: parts of a molecule further apart than this many bonds don't see each other.
ROUNDS = 10
BITS = 2048
#: Polar surface of nitrogen and oxygen by hydrogens, bonds to heavy atoms, whether it is aromatic and its charge (published values of Ertl's method, fixed);
#: multiple bonds: d double, t triple.
SURFACE = {
    "N3": 3.24, "N2d": 12.36, "N1t": 23.79, "N3d+": 3.01, "N4+": 0.0, "N3H1": 12.03, "N2H1d": 23.85, "N3H2": 26.02, "N4H1+": 4.44, "N3H1d+": 13.97, "N2H2d+": 25.59, "N4H2+": 16.61, "N4H3+": 27.64, "N3dd": 11.68, "N2t+": 4.36, "N2dd+": 13.6,
    "N2a": 12.89, "N3a": 4.93, "N3H1a": 15.79, "N3a+": 4.1, "N3H1a+": 14.14, "O2": 9.23, "O1d": 17.07, "O2H1": 20.23, "O1-": 23.06, "O2a": 13.14,
}


def sorted_array(x: Column) -> Column:
    return F.array_sort(x)


def neighbours(atoms: Column, bonds: Column) -> Column:
    """For each atom array<struct<to,order,aromatic>>."""
    end = lambda b, i: F.struct(F.when(b["a"] == i, b["b"]).otherwise(b["a"]).alias("to"), b["order"].alias("order"), b["aromatic"].alias("aromatic"))
    return F.transform(atoms, lambda _, k: F.transform(F.filter(bonds, lambda b: (b["a"] == k + 1) | (b["b"] == k + 1)), lambda b: end(b, k + 1)))


def smallest_rings(bonds: Column, beside: Column, largest: int = LARGEST_RING) -> Column:
    """The smallest rings through each bond (up to ``largest`` atoms), each once, as sorted arrays of places; ``beside``: :func:`neighbours`.

    Paths start along the bond and grow by one atom a step; those that come back to its first atom close a ring."""
    start = lambda b: F.expr("cast(named_struct('paths', array(), 'rings', array()) as struct<paths:array<array<int>>,rings:array<array<int>>>)").withField("paths", F.array(F.array(b["a"], b["b"])))

    def grow(s: Column, size: Column) -> Column:
        step = lambda p: F.transform(F.filter(F.get(beside, F.element_at(p, -1) - 1), lambda e: (~F.array_contains(p, e["to"])) | ((e["to"] == F.get(p, 0)) & (F.size(p) > 2))), lambda e: F.concat(p, F.array(e["to"])))
        longer = F.flatten(F.transform(s["paths"], step))
        # a path that ends where it began is a ring of one atom less
        closed = lambda x: F.transform(F.filter(x, lambda p: F.get(p, 0) == F.element_at(p, -1)), lambda p: sorted_array(F.array_distinct(p)))
        grown = let(longer, lambda x: F.struct(F.filter(x, lambda p: F.get(p, 0) != F.element_at(p, -1)).alias("paths"), closed(x).alias("rings")))
        return F.when((F.size(s["rings"]) > 0) | (F.size(s["paths"]) == 0), s).otherwise(grown)

    of_bond = lambda b: F.aggregate(F.sequence(F.lit(3), F.lit(largest + 1)), start(b), grow)["rings"]
    return F.array_distinct(F.flatten(F.transform(bonds, of_bond)))


def aromatic_rings(atoms: Column, beside: Column, rings: Column) -> Column:
    """Rings of 5 to 7 atoms with 4n + 2 electrons in their plane's system: one from an atom with a double bond in rings,
    two from a lone pair, none from a carbon whose double bond leads out to N, O or S or a cation; other atoms break it."""
    in_ring = F.array_distinct(F.flatten(rings))

    def electrons(i: Column) -> Column:
        x, near = F.get(atoms, i - 1), F.get(beside, i - 1)
        inner = F.exists(near, lambda e: (e["order"] == 2) & F.array_contains(in_ring, e["to"]))
        outer = F.exists(near, lambda e: (e["order"] == 2) & F.get(atoms, e["to"] - 1)["elem"].isin("N", "O", "S"))
        any_double = F.exists(near, lambda e: e["order"] > 1)
        pair = x["elem"].isin("N", "O", "S", "P")
        soft = F.when(x["elem"].isin("O", "S"), 2).when(pair & ((x["h"] > 0) | (F.size(near) > 2)) & (x["charge"] == 0), 2).when(outer, 0).otherwise(1)
        return F.when(x["aromatic"], soft).when(inner, 1).when(outer & (x["elem"] == "C"), 0).when(any_double, None).when(pair & (x["charge"] <= 0), 2).when((x["elem"] == "C") & (x["charge"] == -1), 2).when((x["elem"] == "C") & (x["charge"] == 1), 0)

    def flat(ring: Column) -> Column:
        return let(F.transform(ring, electrons), lambda e: ~F.exists(e, lambda n: n.isNull()) & ((F.aggregate(e, F.lit(0), lambda s, n: s + n) - 2) % 4 == 0))

    return F.filter(rings, lambda r: F.size(r).between(5, 7) & flat(r))


def perceived(df: DataFrame, graph: str = "graph") -> DataFrame:
    """With atoms, bonds, ``beside`` (neighbours), ``rings`` and ``flat`` (the aromatic ones) of a graph column.

    Best read from a written table: an expression for the graph would be planned once for each use of it.
    Atoms and bonds of aromatic rings are marked so whichever way they were written: two spellings give one graph but for its order.
    Columns of these names give way."""
    own = [c for c in df.columns if c not in ("atoms", "bonds", "beside", "rings", "flat")]
    rows = df.select(*own, F.col(graph)["atoms"].alias("atoms"), F.col(graph)["bonds"].alias("bonds"))
    rows = rows.withColumn("beside", neighbours(F.col("atoms"), F.col("bonds")))
    rows = rows.withColumn("rings", smallest_rings(F.col("bonds"), F.col("beside")))
    rows = rows.withColumn("flat", aromatic_rings(F.col("atoms"), F.col("beside"), F.col("rings")))
    inside = F.array_distinct(F.flatten("flat"))
    shared = lambda b: F.exists("flat", lambda r: F.array_contains(r, b["a"]) & F.array_contains(r, b["b"]))
    atoms = F.transform("atoms", lambda x, i: x.withField("aromatic", F.array_contains(inside, i + 1)))
    bonds = F.transform("bonds", lambda b: F.when(shared(b), b.withField("order", F.lit(1)).withField("aromatic", F.lit(True))).otherwise(b.withField("aromatic", F.lit(False))))
    rows = rows.withColumns({"atoms": atoms.cast(f"array<{ATOM}>"), "bonds": bonds.cast(f"array<{BOND}>")})
    return rows.withColumn("beside", neighbours(F.col("atoms"), F.col("bonds"))).withColumn(graph, F.struct("atoms", "bonds").cast(GRAPH))


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda s, x: s + x.cast("int"))


def formula(atoms: Column) -> Column:
    """Elements with their numbers: carbon, hydrogen, then the others by name; charge at the end."""
    h = total(F.transform(atoms, lambda x: x["h"])) + total(F.transform(atoms, lambda x: x["elem"] == "H"))
    count = lambda e: F.size(F.filter(atoms, lambda x: x["elem"] == e))
    part = lambda e, n: F.when(n == 0, "").when(n == 1, e).otherwise(F.concat(e, n.cast("string")))
    rest = sorted_array(F.array_distinct(F.transform(F.filter(atoms, lambda x: ~x["elem"].isin("C", "H")), lambda x: x["elem"])))
    charge = total(F.transform(atoms, lambda x: x["charge"]))
    return F.concat(part(F.lit("C"), count("C")), part(F.lit("H"), h), F.array_join(F.transform(rest, lambda e: part(e, count(e))), ""), F.when(charge > 0, F.concat(F.lit("+"), charge.cast("string"))).when(charge < 0, charge.cast("string")).otherwise(""))


def weight(atoms: Column) -> Column:
    """Average weight with all hydrogens; null with an element that isn't known."""
    table = F.create_map(*[x for k, v in chemistry.WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    return F.aggregate(atoms, F.lit(0.0), lambda s, x: s + F.try_element_at(table, x["elem"]) + x["h"] * chemistry.WEIGHTS["H"])


def surface(atoms: Column, beside: Column) -> Column:
    """Topological polar surface of nitrogen and oxygen; kinds that aren't listed count by how many bonds and hydrogens they have."""
    table = F.create_map(*[x for k, v in SURFACE.items() for x in (F.lit(k), F.lit(v))])

    def part(x: Column, near: Column) -> Column:
        count = lambda n: F.size(F.filter(near, lambda e: e["order"] == n))
        bonds = F.size(near) + x["h"]
        kind = F.concat(
            x["elem"], bonds.cast("string"), F.when((x["h"] > 0), F.concat(F.lit("H"), x["h"].cast("string"))).otherwise(""),
            F.when(x["aromatic"], "a").otherwise(F.concat(F.repeat(F.lit("d"), count(2)), F.repeat(F.lit("t"), count(3)))), F.when(x["charge"] > 0, "+").when(x["charge"] < 0, "-").otherwise(""),
        )
        rough = F.when(x["elem"] == "N", F.greatest(F.lit(0.0), 30.5 - bonds * 8.2 + x["h"] * 1.5)).otherwise(F.greatest(F.lit(0.0), 28.5 - bonds * 8.6 + x["h"] * 1.5))
        return F.when(x["elem"].isin("N", "O"), F.coalesce(F.try_element_at(table, kind), rough)).otherwise(F.lit(0.0))

    return F.aggregate(F.zip_with(atoms, beside, part), F.lit(0.0), lambda s, v: s + v)


def rotatable(atoms: Column, bonds: Column, beside: Column, rings: Column) -> Column:
    """Single bonds outside rings between atoms that each have another heavy neighbour, amide bonds and those beside triple bonds left out."""
    heavy = lambda i: F.size(F.filter(F.get(beside, i - 1), lambda e: F.get(atoms, e["to"] - 1)["elem"] != "H"))
    ringed = lambda b: F.exists(rings, lambda r: F.array_contains(r, b["a"]) & F.array_contains(r, b["b"]))
    tight = lambda i: F.exists(F.get(beside, i - 1), lambda e: e["order"] == 3)
    elem = lambda i: F.get(atoms, i - 1)["elem"]
    acyl = lambda i: (elem(i) == "C") & F.exists(F.get(beside, i - 1), lambda e: (e["order"] == 2) & (elem(e["to"]) == "O"))
    amide = lambda b: (acyl(b["a"]) & (elem(b["b"]) == "N")) | (acyl(b["b"]) & (elem(b["a"]) == "N"))
    return F.size(F.filter(bonds, lambda b: (b["order"] == 1) & ~b["aromatic"] & ~ringed(b) & (heavy(b["a"]) > 1) & (heavy(b["b"]) > 1) & ~tight(b["a"]) & ~tight(b["b"]) & ~amide(b)))


def descriptors() -> dict[str, Column]:
    """Of :func:`perceived` rows."""
    atoms, bonds, beside, rings, flat = (F.col(c) for c in ("atoms", "bonds", "beside", "rings", "flat"))
    count = lambda test: F.size(F.filter(atoms, test))
    polar = lambda x: x["elem"].isin("N", "O")
    carbons = count(lambda x: x["elem"] == "C")
    sp3 = F.size(F.filter(F.arrays_zip(atoms.alias("x"), beside.alias("n")), lambda z: (z["x"]["elem"] == "C") & ~z["x"]["aromatic"] & ~F.exists(z["n"], lambda e: e["order"] > 1)))
    pieces = F.aggregate(F.sequence(F.lit(1), F.size(atoms)), F.transform(atoms, lambda _, i: (i + 1).cast("int")), lambda of, i: let(F.filter(bonds, lambda b: F.get(of, b["a"] - 1) != F.get(of, b["b"] - 1)), lambda some: F.when(F.size(some) == 0, of).otherwise(F.transform(of, lambda x: F.when(x == F.get(of, F.get(some, 0)["b"] - 1), F.get(of, F.get(some, 0)["a"] - 1)).otherwise(x)))))
    return {
        "HAC": count(lambda x: x["elem"] != "H"),
        "MW": weight(atoms),
        "HBD": count(lambda x: polar(x) & (x["h"] > 0)),
        "HBA": count(polar),
        "TPSA": surface(atoms, beside),
        "RotBonds": rotatable(atoms, bonds, beside, rings),
        "Rings": F.size(bonds) - F.size(atoms) + F.size(F.array_distinct(pieces)),
        "ArRings": F.size(flat),
        "Fsp3": F.when(carbons > 0, sp3 / carbons).when(carbons == 0, 0.0),
    }


def colours(atoms: Column, beside: Column, rings: Column | None, rounds: int) -> Column:
    """Each atom's colour after each round (array of arrays, the first without neighbours): 16 hex signs of an MD5 digest of its own and its neighbours' colours before."""
    digest = lambda text: F.substring(F.md5(text.cast("binary")), 1, 16)
    sizes = lambda i: F.lit("") if rings is None else F.array_join(sorted_array(F.transform(F.filter(rings, lambda r: F.array_contains(r, i + 1)), lambda r: F.size(r).cast("string"))), ".")
    first = F.transform(atoms, lambda x, i: digest(F.concat_ws(":", x["elem"], x["aromatic"].cast("int"), x["charge"], x["h"], F.size(F.get(beside, i)), sizes(i))))
    kind = lambda e: F.when(e["aromatic"], "a").otherwise(e["order"].cast("string"))

    def refine(all_: Column, _: Column) -> Column:
        now = F.element_at(all_, -1)
        around = lambda i: F.array_join(sorted_array(F.transform(F.get(beside, i), lambda e: F.concat(kind(e), F.get(now, e["to"] - 1)))), ",")
        return F.concat(all_, F.array(F.transform(now, lambda c, i: digest(F.concat(c, F.lit("|"), around(i))))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.array(first), refine)


def canonical_key(rounds: int = ROUNDS) -> Column:
    """A key of :func:`perceived` rows that doesn't depend on how a molecule was written: formula and a digest of its atoms' colours, which see the sizes of their rings.

    Colours tell all molecules apart but those with atoms that look alike at every distance (some regular graphs)."""
    last = F.element_at(colours(F.col("atoms"), F.col("beside"), F.col("rings"), rounds), -1)
    return F.concat(formula(F.col("atoms")), F.lit("-"), F.substring(F.md5(F.array_join(sorted_array(last), ",").cast("binary")), 1, 16))


def fingerprint_bits(radius: int = 2, bits: int = BITS) -> Column:
    """The circular fingerprint of :func:`perceived` rows as sorted places of set bits: one for each atom's surroundings of up to ``radius`` bonds."""
    every = F.flatten(colours(F.col("atoms"), F.col("beside"), None, radius))
    return sorted_array(F.array_distinct(F.transform(every, lambda c: (F.conv(F.substring(c, 1, 8), 16, 10).cast("long") % bits).cast("int"))))


def words(places: Column, bits: int = BITS) -> Column:
    """Places of set bits as 64-bit words."""
    one = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), p % 64)
    return F.transform(F.sequence(F.lit(0), F.lit(bits // 64 - 1)), lambda w: F.aggregate(F.filter(places, lambda p: F.floor(p / 64) == w), F.lit(0).cast("long"), lambda s, p: s.bitwiseOR(one(p))))
