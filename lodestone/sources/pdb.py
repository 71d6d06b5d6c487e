"""Fixed-width structure text: lines, atoms, anchors, chain names, pocket tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import geometry
from lodestone.functions.residues import WATERS, site_kinds
from lodestone.operators.spatial import block_pairs, grid_join
from lodestone.session import kept

POLYMER_RESIDUES = ["ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE", "LEU", "LYS", "MET", "MSE", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL"]
CENTRE = r"Geometric pocket center at\s+([-+]?\d+(?:\.\d+)?)\s+([-+]?\d+(?:\.\d+)?)\s+([-+]?\d+(?:\.\d+)?)"


def structure_id(path: Column, header: Column | None = None) -> Column:
    """The four-character id at the start of a file's name, else the one given from its header."""
    stem = F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)
    own = F.upper(F.nullif(F.regexp_extract(stem, r"^([0-9][A-Za-z0-9]{3})", 1), F.lit("")))
    return F.coalesce(own, F.upper(F.nullif(F.trim(header), F.lit("")))) if header is not None else own


def header_id(lines: DataFrame, key: str = "file") -> DataFrame:
    """(key, header): columns 63-66 of the first HEADER line among the first 50 that holds an id there."""
    own = F.trim(F.substring("value", 63, 4))
    hit = lines.where((F.col("line_no") < 50) & F.col("value").startswith("HEADER") & (F.length("value") >= 66) & own.rlike("^[0-9][A-Za-z0-9]{3}$"))
    return hit.groupBy(key).agg(F.min_by(own, "line_no").alias("header"))


def short_id(path: Column) -> Column:
    """The first four letters or digits of a file's name in upper case; null if they aren't."""
    stem = F.substring(F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1), 1, 4)
    return F.when(stem.rlike(r"^[\p{L}\p{N}]{4}$"), F.upper(stem))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): whole files are split, so that line numbers are exact; a file is one structure, not one table."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    return split_lines(whole, "text", "file")


def split_lines(df: DataFrame, text: str, key: str) -> DataFrame:
    return df.select(F.col(key), F.posexplode(F.split(F.col(text), r"\r?\n")).alias("line_no", "value"))


def field(first: int, last: int) -> Column:
    """Columns first..last (from 1) of the line, trimmed."""
    return F.trim(F.substring("value", first, last - first + 1))


def coordinate(first: int) -> Column:
    return field(first, first + 7).try_cast("double")


def atoms(lines: DataFrame) -> DataFrame:
    """Every ATOM and HETATM line of at least 54 columns with readable coordinates, typed; model counts from 0."""
    key = [c for c in lines.columns if c not in ("line_no", "value")]
    model = F.sum(F.when(F.col("value").startswith("MODEL"), 1).otherwise(0)).over(Window.partitionBy(*key).orderBy("line_no"))
    out = lines.withColumn("model", F.greatest(model - 1, F.lit(0)).cast("int")).where(F.col("value").startswith("ATOM  ") | F.col("value").startswith("HETATM"))
    out = out.where(F.length("value") >= 54)
    or_mark = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("?"))
    return out.select(
        *key,
        "line_no",
        "model",
        F.trim(F.substring("value", 1, 6)).alias("record"),
        field(7, 12).try_cast("int").alias("serial"),  # column 12 is blank but for serials beyond 99,999
        field(13, 16).alias("atom_name"),
        field(18, 20).alias("resname"),
        or_mark(field(22, 22)).alias("chain"),
        F.substring("value", 22, 1).alias("raw_chain"),
        or_mark(field(23, 26)).alias("resseq"),
        field(27, 27).alias("icode"),
        coordinate(31).alias("x"),
        coordinate(39).alias("y"),
        coordinate(47).alias("z"),
        field(61, 66).try_cast("double").alias("bfactor"),
        field(77, 78).alias("elem"),
    ).where("x is not null and y is not null and z is not null")


def coordinates(lines: DataFrame, key: str = "file") -> DataFrame:
    """(key, line_no, chain, x, y, z) of every atom line, waters and markers too; the chain is its letter as it stands, a space included."""
    v = F.col("value")
    rows = lines.where((v.startswith("ATOM") | v.startswith("HETATM")) & (F.length(v) >= 54))
    out = rows.select(key, "line_no", F.substring("value", 22, 1).alias("chain"), coordinate(31).alias("x"), coordinate(39).alias("y"), coordinate(47).alias("z"))
    return out.where("x is not null and y is not null and z is not null")


def chain_ids(lines: DataFrame, key: str = "file") -> DataFrame:
    """(key, chains): the letters of the chains that atom lines name, sorted."""
    v = F.col("value")
    named = F.when((v.startswith("ATOM") | v.startswith("HETATM")) & (F.length(v) > 21), F.nullif(field(22, 22), F.lit("")))
    return lines.groupBy(key).agg(F.sort_array(F.collect_set(named)).alias("chains"))


def residue_key() -> Column:
    return F.concat(F.col("chain"), F.lit(":"), F.col("resseq"), F.col("icode"), F.lit(":"), F.col("resname"))


def is_marker() -> Column:
    return (F.col("resname") == "DU") | (F.col("atom_name") == "DU")


def anchors(atom_rows: DataFrame) -> DataFrame:
    """Markers in file order: du_index from 0, label chain/resseq."""
    key = [c for c in atom_rows.columns if c in ("file", "pdb_id")]
    order = Window.partitionBy(*key).orderBy("line_no")
    return atom_rows.where(is_marker()).select(*key, (F.row_number().over(order) - 1).alias("du_index"), F.concat_ws("/", "chain", "resseq").alias("label"), "chain", "resseq", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az"))


def count_markers(lines: DataFrame, key: str = "file") -> DataFrame:
    """Markers per file by their text alone: a marker without readable coordinates counts too."""
    du = (field(18, 20) == "DU") | (field(13, 16) == "DU")
    record = F.col("value").startswith("ATOM") | F.col("value").startswith("HETATM")
    return lines.groupBy(key).agg(F.count_if(record & (F.length("value") >= 54) & du).alias("n_du"))


def protein_atoms(atom_rows: DataFrame, hetatm: bool = True) -> DataFrame:
    """Atoms for residue analysis: no markers, waters or hydrogens; the element falls back to the name's first letter."""
    elem = F.upper(F.when(F.col("elem") != "", F.col("elem")).otherwise(F.substring("atom_name", 1, 1)))
    out = atom_rows.withColumn("elem", elem).where(~(F.upper("resname").isin("DU") | (F.upper("atom_name") == "DU")) & ~F.upper("resname").isin(WATERS) & (F.col("elem") != "H"))
    return out if hetatm else out.where("record = 'ATOM'")


def no_hydrogen() -> Column:
    return ~((F.col("elem") == "H") | ((F.col("elem") == "") & F.col("atom_name").startswith("H")))


def clash_atoms(atom_rows: DataFrame, anchor_rows: DataFrame, radius: float, on: str = "file") -> DataFrame:
    """Atoms that a design can clash with, for each anchor: oxygens of hetero groups strictly inside the radius are left out."""
    rows = atom_rows.where(~is_marker() & ~F.col("resname").isin(WATERS) & no_hydrogen())
    places = anchor_rows.select(on, "du_index", "ax", "ay", "az")
    oxygen = (F.col("record") == "HETATM") & (F.when(F.col("elem") != "", F.col("elem")).otherwise(F.substring("atom_name", 1, 1)) == "O")
    near = grid_join(places, rows.where(oxygen), radius, [on]).where(F.col("d2") < radius * radius).select(on, "du_index", "line_no")
    return rows.join(places, on).join(near, [on, "du_index", "line_no"], "left_anti")


def interaction_sites(atom_rows: DataFrame, anchor_rows: DataFrame, radius: float, backbone: bool = True, on: str = "file") -> DataFrame:
    """One row per atom and kind within the radius (inclusive) of each anchor."""
    rows = atom_rows.where(~is_marker() & ~F.col("resname").isin(WATERS) & no_hydrogen())
    kinds = site_kinds(F.col("resname"), F.col("atom_name"), F.col("elem"), F.col("record") == "HETATM", backbone)
    near = grid_join(anchor_rows.select(on, "du_index", "ax", "ay", "az"), rows, radius, [on])
    return near.select(on, "du_index", "line_no", F.explode(kinds).alias("kind"), "x", "y", "z", "resname", "atom_name", "chain", "resseq", "icode", "record")


#: Anchors and sites of a block of :func:`directional_sites`.
SITES = (512, 1024)


def directional_sites(atom_rows: DataFrame, anchor_rows: DataFrame, radius: float, backbone: bool = True, on: str = "file") -> DataFrame:
    """Donor and acceptor sites with a unit direction from their base atom; a base outside the radius gives none.

    Each site takes along the atoms of its residue that can be its base, in the order in which they count (of one name,
    the last line), so that anchors meet sites only, in blocks, and no pair is shuffled."""
    from lodestone.functions.residues import direction_bases_of

    label = [on, "chain", "resseq", "icode", "resname"]
    solid = atom_rows.where(~is_marker() & no_hydrogen())
    atom = F.struct(F.upper("atom_name").alias("name"), (-F.col("line_no")).alias("back"), F.array("x", "y", "z").alias("p"))
    own = solid.where(~F.upper("resname").isin(WATERS)).groupBy(*label).agg(F.array_sort(F.collect_list(atom)).alias("own"))
    kinds = F.filter(site_kinds(F.col("resname"), F.col("atom_name"), F.col("elem"), F.col("record") == "HETATM", backbone), lambda k: k.isin("donor", "acceptor"))
    sites = solid.where(~F.col("resname").isin(WATERS)).withColumn("kinds", kinds).where(F.size("kinds") > 0).join(own, label)
    bases = F.when(F.col("record") != "HETATM", direction_bases_of(F.col("resname"), F.col("atom_name")))
    bases = F.flatten(F.transform(bases, lambda b: F.transform(F.filter("own", lambda o: o["name"] == b), lambda o: o["p"])))
    sites = kept(sites.select(*label, "line_no", "kinds", "x", "y", "z", "atom_name", "record", bases.alias("bases")))
    places = kept(anchor_rows.select(on, "du_index", "ax", "ay", "az"))
    square = lambda *p: geometry.distance_sq(F.col("ax"), F.col("ay"), F.col("az"), *p)
    near = block_pairs(places, sites, ["du_index"], ["line_no"], [on], SITES).where(square(F.col("x"), F.col("y"), F.col("z")) <= radius * radius)
    near = near.withColumn("base", F.get(F.filter("bases", lambda b: square(*[F.get(b, i) for i in range(3)]) <= radius * radius), 0))
    near = near.withColumns({f"__{c}": F.col(c) - F.get("base", i) for i, c in enumerate("xyz")}).withColumn("__len", F.sqrt(F.col("__x") * F.col("__x") + F.col("__y") * F.col("__y") + F.col("__z") * F.col("__z")))
    near = near.withColumn("dir", F.when(F.col("__len") > 1e-6, F.array(*[F.col(f"__{c}") / F.col("__len") for c in "xyz"])))
    return near.select(*label, "du_index", "line_no", F.explode("kinds").alias("kind"), "x", "y", "z", "atom_name", "record", "dir")


#: Anchors and residues of a block of :func:`ring_planes`; few, as a residue holds all its atoms.
RINGS = (256, 256)


def ring_planes(atom_rows: DataFrame, anchor_rows: DataFrame, radius: float, on: str = "file") -> DataFrame:
    """Centroid and normal of aromatic residues with at least three ring atoms within the radius.

    Of atoms of one name, as residues with one label have, the last line comes first."""
    from lodestone.functions.residues import RING_ATOMS

    names = F.create_map(*[x for r, a in RING_ATOMS.items() for x in (F.lit(r), F.array(*[F.lit(n) for n in a]))])[F.upper("resname")]
    at = F.array_position(names, F.upper("atom_name"))
    label = ["chain", "resseq", "icode", "resname"]
    atom = F.struct(at.alias("at"), (-F.col("line_no")).alias("back"), F.array("x", "y", "z").alias("p"))
    rings = kept(atom_rows.where(F.array_contains(names, F.upper("atom_name"))).groupBy(on, *label).agg(F.array_sort(F.collect_list(atom)).alias("pts")).where(F.size("pts") >= 3))
    places = kept(anchor_rows.select(on, "du_index", "ax", "ay", "az"))
    near = F.filter("pts", lambda s: geometry.distance_sq(F.col("ax"), F.col("ay"), F.col("az"), *[F.get(s["p"], i) for i in range(3)]) <= radius * radius)
    some = F.explode(F.filter(F.array(F.transform(near, lambda s: s["p"])), lambda p: F.size(p) >= 3))  # worked out once; a filter on it would be pushed down
    pairs = block_pairs(places, rings, ["du_index"], label, [on], RINGS).select(on, "du_index", *label, some.alias("points"))
    return geometry.with_planes(pairs, "points").select(on, "du_index", "chain", "resseq", "resname", "centroid", "normal")


def receptor_lines(lines: DataFrame, polymer_hetatm: bool = True) -> DataFrame:
    v = F.col("value")
    polymer = v.startswith("HETATM") & F.upper(field(18, 20)).isin(POLYMER_RESIDUES)
    return lines.where(v.startswith("ATOM") | (F.lit(polymer_hetatm) & polymer) | v.startswith("TER") | v.startswith("END"))


def chain_molecules(lines: DataFrame, key: str = "file") -> DataFrame:
    """(key, chain, molecule) from compound records: continuation lines joined, one block a molecule, the last block of a chain wins."""
    order = Window.partitionBy(key).orderBy("line_no")
    mine = F.col("value").startswith("COMPND")
    seen = F.max(F.when(mine, 1).otherwise(0)).over(order)
    other = F.max(F.when(~mine & (seen == 1) & F.col("value").rlike("^[A-Za-z]"), 1).otherwise(0)).over(order)
    part = lines.withColumn("ended", other).where(mine & (F.col("ended") == 0))
    text = part.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.rtrim(F.substr("value", F.lit(11))).alias("t")))), lambda s: s["t"]), " ").alias("text"))
    blocks = text.select(key, F.posexplode(F.split("text", r"\bMOL_ID:\s*\d+\s*;")).alias("block", "body"))
    found = blocks.select(key, "block", F.trim(F.regexp_extract("body", r"(?i)\bMOLECULE:\s*([^;]+);", 1)).alias("molecule"), F.regexp_extract("body", r"(?i)\bCHAIN:\s*([^;]+);", 1).alias("chains"))
    found = found.where("molecule <> '' and chains <> ''").select(key, "block", "molecule", F.explode(F.split("chains", ",")).alias("chain"))
    return found.withColumn("chain", F.trim("chain")).where("chain <> ''").groupBy(key, "chain").agg(F.max_by("molecule", "block").alias("molecule"))


def pocket_table(lines: DataFrame, key: str = "file") -> DataFrame:
    """(key, pocket_id, volume) of a whitespace table whose header names the columns."""
    rows = lines.where(F.trim("value") != "").withColumn("cols", F.split(F.trim("value"), r"\s+"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("line_no"))
    rows = rows.withColumn("n", rank)
    head = rows.where("n = 1").select(key, F.array_position("cols", "name").alias("name_at"), F.array_position("cols", "volume").alias("volume_at")).where("name_at > 0 and volume_at > 0")
    body = rows.where("n > 1").join(head, key)
    at = lambda c: F.get("cols", (F.col(c) - 1).cast("int"))
    return body.select(key, "n", at("name_at").alias("pocket_id"), at("volume_at").try_cast("double").alias("volume")).where("startswith(pocket_id, 'P_') and volume is not null").groupBy(key, "pocket_id").agg(F.max_by("volume", "n").alias("volume"))


def pocket_centre(lines: DataFrame, key: str = "file") -> DataFrame:
    """The first centre that the first 50 lines state."""
    hit = lines.where((F.col("line_no") < 50) & F.col("value").rlike(CENTRE))
    first = hit.groupBy(key).agg(F.min_by("value", "line_no").alias("value"))
    return first.select(key, *[F.regexp_extract("value", CENTRE, i).cast("double").alias(c) for i, c in ((1, "cx"), (2, "cy"), (3, "cz"))])


def structure(atom_rows: DataFrame) -> DataFrame:
    """Markers of the first model by residue name: the centre is the mean of a marker residue's atoms."""
    du = atom_rows.where("model = 0 and resname = 'DU'")
    key = [c for c in ("file", "pdb_id") if c in atom_rows.columns]
    return du.groupBy(*key, "chain", "resseq", "icode").agg(*[F.avg(c).alias(f"a{c}") for c in ("x", "y", "z")])


def chain_info(atom_rows: DataFrame, molecules: DataFrame, key: str = "file") -> DataFrame:
    """Per chain of the first model: residues with an alpha carbon, whether it holds a marker, its hetero residue names."""
    rows = atom_rows.where("model = 0")
    het = F.array_join(F.sort_array(F.collect_set(F.when((F.col("record") == "HETATM") & ~F.col("resname").isin("HOH", "DU", "WAT", "H2O"), F.col("resname")))), ";")
    ca = F.count_distinct(F.when((F.col("record") == "ATOM") & (F.col("atom_name") == "CA"), F.concat_ws(":", "resseq", "icode")))
    out = rows.groupBy(key, "chain").agg(ca.alias("n_residues_ca"), F.max(F.when(F.col("resname") == "DU", 1).otherwise(0)).alias("has_DU"), het.alias("het_resnames"))
    return out.join(molecules, [key, "chain"], "left")
