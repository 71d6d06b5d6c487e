"""Residue classes, atom-to-site rules and direction bases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values that results depend on.
WATERS = ["HOH", "WAT", "H2O", "TIP", "TIP3", "TIP4", "SPC", "SOL", "DOD", "TP3", "OHH"]
POSITIVE = ["LYS", "ARG", "HIS"]
NEGATIVE = ["ASP", "GLU"]
AROMATIC = ["PHE", "TYR", "TRP", "HIS"]
POLAR = ["SER", "THR", "ASN", "GLN", "TYR", "CYS", "HIS", "ASP", "GLU", "LYS", "ARG"]
APOLAR = ["ALA", "VAL", "LEU", "ILE", "MET", "PRO", "GLY", "PHE", "TRP"]
INTERFACE_APOLAR = ["ALA", "VAL", "LEU", "ILE", "MET", "PRO", "GLY", "PHE", "TRP", "TYR"]
INTERFACE_POLAR = ["SER", "THR", "CYS", "ASN", "GLN", "HIS", "LYS", "ARG", "ASP", "GLU", "TYR"]
INTERFACE_AROMATIC = ["PHE", "TRP", "TYR", "HIS"]
INTERFACE_ALIPHATIC = ["ALA", "VAL", "LEU", "ILE", "MET"]
KINDS = ["donor", "acceptor", "pos", "neg", "hydrophobe", "aromatic"]
#: (residue or any, atom): the atoms whose bond gives a site its direction, the first one present counts.
DIRECTION_BASES = [
    ("*", "N", ["CA"]), ("*", "O", ["C"]), ("*", "OXT", ["C"]),
    ("ASP", "OD1", ["CG"]), ("ASP", "OD2", ["CG"]), ("GLU", "OE1", ["CD"]), ("GLU", "OE2", ["CD"]),
    ("ASN", "OD1", ["CG"]), ("ASN", "ND2", ["CG"]), ("GLN", "OE1", ["CD"]), ("GLN", "NE2", ["CD"]),
    ("SER", "OG", ["CB"]), ("THR", "OG1", ["CB"]), ("TYR", "OH", ["CZ"]), ("LYS", "NZ", ["CE"]),
    ("ARG", "NE", ["CZ"]), ("ARG", "NH1", ["CZ"]), ("ARG", "NH2", ["CZ"]),
    ("HIS", "ND1", ["CG", "CE1"]), ("HIS", "NE2", ["CE1", "CD2"]), ("TRP", "NE1", ["CD1"]),
]
RING_ATOMS = {
    "PHE": ["CG", "CD1", "CD2", "CE1", "CE2", "CZ"],
    "TYR": ["CG", "CD1", "CD2", "CE1", "CE2", "CZ"],
    "HIS": ["CG", "ND1", "CD2", "CE1", "NE2"],
    "TRP": ["CG", "CD1", "NE1", "CE2", "CD2", "CE3", "CZ3", "CH2", "CZ2"],
}


def environment_flags(res: Column) -> dict[str, Column]:
    """Classes of the residue environment; they overlap (HIS is positive, polar and aromatic)."""
    res = F.upper(res)
    return {"is_pos": res.isin(POSITIVE), "is_neg": res.isin(NEGATIVE), "is_polar": res.isin(POLAR), "is_apolar": res.isin(APOLAR), "is_aromatic": res.isin(AROMATIC)}


def interface_flags(res: Column) -> dict[str, Column]:
    """Classes of the interface profile; TYR is both apolar and polar here."""
    return {"is_apolar": res.isin(INTERFACE_APOLAR), "is_polar": res.isin(INTERFACE_POLAR), "is_aromatic": res.isin(INTERFACE_AROMATIC), "is_aliphatic": res.isin(INTERFACE_ALIPHATIC)}


#: Which sites an atom is: residues, atoms and elements that a rule is about (blank: any), whether it is about hetero
#: groups only, and the kinds of site it gives (blank: none).  The first rule that applies to an atom decides.
SITE_RULES = [
    ("ASP GLU", "OD1 OD2 OE1 OE2", "", False, "acceptor neg"),
    ("LYS", "NZ", "", False, "donor pos"),
    ("ARG", "NE NH1 NH2", "", False, "donor pos"),
    ("ASN GLN", "OD1 OE1", "", False, "acceptor"),
    ("ASN GLN", "ND2 NE2", "", False, "donor"),
    ("ASN GLN", "", "", False, ""),
    ("SER THR TYR", "OG OG1 OH", "", False, "donor acceptor"),
    ("HIS", "ND1 NE2", "", False, "acceptor aromatic"),
    ("HIS", "CE1 CD2 CG", "", False, "aromatic"),
    ("TRP", "NE1", "C N", False, "aromatic donor"),
    ("TRP", "NE1", "", False, "donor"),
    ("PHE TYR TRP", "", "C N", False, "aromatic"),
    ("PHE TYR TRP", "", "", False, ""),
    ("", "", "O", True, "acceptor"),
    ("", "", "N", True, "donor acceptor"),
    ("", "", "C S", True, "hydrophobe"),
    ("", "", "", True, ""),
    ("ALA VAL LEU ILE MET PRO", "", "C S", False, "hydrophobe"),
    ("", "", "O", False, "acceptor"),
    ("", "", "N", False, "donor"),
    ("", "", "S", False, "hydrophobe"),
]
BACKBONE = "N C O OXT CA"


def site_kinds(resname: Column, atom_name: Column, elem: Column, hetatm: Column, backbone: bool = True) -> Column:
    """The kinds of interaction site that an atom is: array<string>; without ``backbone`` the main chain's atoms are none."""
    parts = (F.upper(resname), F.upper(F.trim(atom_name)), F.upper(F.trim(elem)))
    out = F.expr("cast(array() as array<string>)")
    for *names, hetero_only, kinds in reversed(SITE_RULES):
        applies = hetatm if hetero_only else F.lit(True)
        for value, allowed in zip(parts, names, strict=True):
            applies = applies & value.isin(allowed.split()) if allowed else applies
        given = F.array(*[F.lit(k) for k in kinds.split()]) if kinds else F.expr("cast(array() as array<string>)")
        out = F.when(applies, given).otherwise(out)
    return out if backbone else F.when(~hetatm & parts[1].isin(BACKBONE.split()), F.expr("cast(array() as array<string>)")).otherwise(out)


def direction_bases(spark: SparkSession) -> DataFrame:
    """The direction rules as a table (21 rows): resname, atom_name, bases."""
    return spark.createDataFrame(DIRECTION_BASES, "resname string, atom_name string, bases array<string>")


def direction_bases_of(resname: Column, atom_name: Column) -> Column:
    """The names of the atoms that can give a site its direction, in the order in which they count; the residue's own rule before the general one."""
    rule = F.create_map(*[x for r, a, b in DIRECTION_BASES for x in (F.lit(f"{r}/{a}"), F.array(*[F.lit(n) for n in b]))])
    return F.coalesce(F.try_element_at(rule, F.concat_ws("/", F.upper(resname), F.upper(atom_name))), F.try_element_at(rule, F.concat(F.lit("*/"), F.upper(atom_name))))


def direction_base(resname: Column, atom_name: Column, residue_atoms: Column) -> Column:
    """Of a map atom name -> value, the value of the first base atom that the residue has; see :func:`direction_bases_of`."""
    bases = direction_bases_of(resname, atom_name)
    present = F.filter(bases, lambda n: F.map_contains_key(residue_atoms, n))
    return F.get(F.transform(present, lambda n: F.element_at(residue_atoms, n)), 0)
