"""Queries of the structure readers, site rules and spatial operators on structures as text.

Stand-in: each row of ``embeddings`` is one fixed-width atom line of a structure of FILE_ATOMS atoms,
four to a residue, the second half of a structure its second model; some lines have unreadable coordinates or are cut short.
The SQL states the fields directly and never sees the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import chemistry, geometry, residues, text
from lodestone.operators import enrich, environment, spatial
from lodestone.session import kept
from lodestone.sinks import writers
from lodestone.sources import pdb, tables

from .registry import query, table

#: Residues of the stand-in and their four atoms.
ATOMS = {
    "ALA": "N CA C O", "ARG": "N CZ NE NH1", "ASN": "CG OD1 ND2 CA", "ASP": "CG OD1 OD2 N", "CYS": "N CA CB SG", "GLN": "CD OE1 NE2 O",
    "GLU": "CD OE1 OE2 N", "GLY": "N CA H HA", "HIS": "CG ND1 CE1 NE2", "LEU": "N CA CB CD1", "LYS": "N CA CE NZ", "MET": "CA CG SD CE",
    "PHE": "CG CD1 CD2 CZ", "SER": "N CA CB OG", "TRP": "CG CD1 NE1 CE2", "TYR": "CG CD1 CZ OH", "LIG": "C1 N1 O1 DU", "HOH": "O H1 H2 O", "DU": "DU DU X1 DU",
}
HETERO = ["LIG", "HOH", "DU"]
CHAINS = ["A", "B", "C", " "]
RADIUS = 3.0
#: Atoms of a structure; those of the second half belong to its second model.
FILE_ATOMS = 200
#: Of the ten structures, atoms from this number on belong to the second model.
SECOND = 300
FIRST_MODEL = f"ord % {FILE_ATOMS} < {FILE_ATOMS // 2}"


def lines(spark: SparkSession, sf: str, ten: bool = False) -> DataFrame:
    """(file, line_no, value); with ``ten``, all atoms are those of ten structures, which grow with the table."""
    names = F.array(*[F.array(*[F.lit(a) for a in v.split()]) for v in ATOMS.values()])
    kinds = F.array(*[F.lit(r) for r in ATOMS])
    rows = table(spark, sf, "embeddings").withColumn("resid", F.floor(F.col("vec_id") / 4).cast("int"))
    at = (F.col("resid") % len(ATOMS)).cast("int")
    rows = rows.withColumns({"resname": F.get(kinds, at), "name": F.get(F.get(names, at), (F.col("vec_id") % 4).cast("int"))})
    chain = F.get(F.array(*[F.lit(c) for c in CHAINS]), F.floor(F.col("resid") / 3).cast("int") % 4)
    xyz = [F.when(F.col("vec_id") % 97 == 13, F.lit("     bad")).otherwise(F.format_string("%8.3f", F.round(F.get("embedding", i).cast("double") * 10, 3))) for i in range(3)]
    elem = F.when(F.col("vec_id") % 7 == 0, "").when(F.col("name") == "DU", "DU").otherwise(F.substring("name", 1, 1))
    line = F.format_string(
        "%-6s%5d %-4s %3s %1s%4d%1s   %s%s%s%6.2f%6.2f          %2s",
        F.when(F.col("resname").isin(HETERO), "HETATM").otherwise("ATOM"), F.col("vec_id") % 100_000, "name", "resname", chain, F.col("resid") % 900 + 1,
        F.when(F.col("resid") % 11 == 0, "A").otherwise(" "), *xyz, F.lit(1.0), (F.col("vec_id") % 37) * 1.25, elem,
    )
    line = F.when(F.col("vec_id") % 89 == 5, F.substring(line, 1, 40)).otherwise(line)
    file = F.concat(F.lit("f"), F.floor(F.col("vec_id") / 40) % 10 if ten else F.floor(F.col("vec_id") / FILE_ATOMS))
    body = rows.select(file.alias("file"), (F.col("vec_id") * 2).cast("int").alias("line_no"), line.alias("value"))
    if ten:
        marks = body.select("file").distinct().select("file", F.explode(F.array(F.lit(-1), F.lit(2 * SECOND - 1))).alias("line_no"), F.lit("MODEL").alias("value"))
        return kept(body.unionByName(marks))
    start = F.floor(F.col("vec_id") / FILE_ATOMS) * (2 * FILE_ATOMS)
    marks = rows.select(start.cast("int").alias("at")).distinct().select(F.concat(F.lit("f"), (F.col("at") / (2 * FILE_ATOMS)).cast("int")).alias("file"), F.explode(F.array(F.col("at") - 1, F.col("at") + FILE_ATOMS - 1)).alias("line_no"), F.lit("MODEL").alias("value"))
    return kept(body.unionByName(marks))  # text as a file would have it, not an expression in every column that is cut from it


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


ST = f"""st AS (SELECT *, {_list(list(ATOMS))}[r + 1] AS resname, [{", ".join(_list(v.split()) for v in ATOMS.values())}][r + 1][ord % 4 + 1] AS name, {_list(CHAINS)}[(resid // 3) % 4 + 1] AS raw,
  coalesce(nullif(trim({_list(CHAINS)}[(resid // 3) % 4 + 1]), ''), '?') AS chain, (resid % 900 + 1)::VARCHAR AS resseq, CASE WHEN resid % 11 = 0 THEN 'A' ELSE '' END AS icode
  FROM (SELECT vec_id AS ord, (vec_id * 2)::INT AS line_no, 'f' || vec_id // {FILE_ATOMS} AS file, vec_id // 4 AS resid, (vec_id // 4) % {len(ATOMS)} AS r, vec_id % 97 = 13 AS bad, vec_id % 89 = 5 AS short,
  round(embedding[1]::DOUBLE * 10, 3) AS x, round(embedding[2]::DOUBLE * 10, 3) AS y, round(embedding[3]::DOUBLE * 10, 3) AS z, (vec_id % 37) * 1.25 AS b FROM embeddings)),
 a0 AS (SELECT *, CASE WHEN resname IN {tuple(HETERO)} THEN 'HETATM' ELSE 'ATOM' END AS record, CASE WHEN ord % 7 = 0 THEN '' WHEN name = 'DU' THEN 'DU' ELSE substr(name, 1, 1) END AS elem FROM st WHERE NOT short),
 a AS (SELECT * FROM a0 WHERE NOT bad),
 du AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY line_no) - 1 AS du_index, chain || '/' || resseq AS label, x AS ax, y AS ay, z AS az FROM a WHERE resname = 'DU' OR name = 'DU'),
 solid AS (SELECT * FROM a WHERE NOT (resname = 'DU' OR name = 'DU') AND resname <> 'HOH' AND NOT (elem = 'H' OR elem = '' AND name LIKE 'H%'))"""
#: The same atoms as ten structures, for the queries whose pairs lie within a structure.
TEN = ST.replace(f"'f' || vec_id // {FILE_ATOMS} AS file", "'f' || (vec_id // 40) % 10 AS file")
D2 = "(x - ax) * (x - ax) + (y - ay) * (y - ay) + (z - az) * (z - az)"


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    return pdb.atoms(lines(spark, sf))


def both(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Atoms and markers of the ten structures."""
    rows = pdb.atoms(lines(spark, sf, ten=True))
    return rows, pdb.anchors(rows)


@query(f"WITH {ST} SELECT file, du_index, label, ax, ay, az FROM du", INT="du_index")
def structure_anchors(spark, sf):
    return pdb.anchors(parsed(spark, sf)).select("file", "du_index", "label", "ax", "ay", "az")


@query(f"WITH {ST} SELECT file, count_if(resname = 'DU' OR name = 'DU') AS n_du FROM a0 GROUP BY file", BIGINT="n_du")
def structure_marker_counts(spark, sf):
    return pdb.count_markers(lines(spark, sf))


@query(f"WITH {ST} SELECT file, line_no, upper(CASE WHEN elem <> '' THEN elem ELSE substr(name, 1, 1) END) AS element, record FROM a WHERE resname NOT IN ('DU', 'HOH') AND name <> 'DU' AND upper(CASE WHEN elem <> '' THEN elem ELSE substr(name, 1, 1) END) <> 'H'")
def structure_protein_atoms(spark, sf):
    rows = parsed(spark, sf)
    own = pdb.protein_atoms(rows, hetatm=False).unionByName(pdb.protein_atoms(rows).where("record = 'HETATM'"))
    return own.select("file", "line_no", F.col("elem").alias("element"), "record")


@query(f"WITH {TEN} SELECT file, du_index, count(*) AS n, sum(line_no)::BIGINT AS lines FROM solid JOIN du USING (file) WHERE NOT (record = 'HETATM' AND CASE WHEN elem <> '' THEN elem ELSE substr(name, 1, 1) END = 'O' AND {D2} < 9.0) GROUP BY ALL", INT="du_index")
def structure_clash_atoms(spark, sf):
    rows, marks = both(spark, sf)
    return pdb.clash_atoms(rows, marks, RADIUS).groupBy("file", "du_index").agg(F.count("*").alias("n"), F.sum("line_no").alias("lines"))


#: The kinds of site of one atom; the first rule that applies decides.
KINDS = """CASE WHEN resname IN ('ASP', 'GLU') AND name IN ('OD1', 'OD2', 'OE1', 'OE2') THEN ['acceptor', 'neg'] WHEN resname = 'LYS' AND name = 'NZ' OR resname = 'ARG' AND name IN ('NE', 'NH1', 'NH2') THEN ['donor', 'pos']
 WHEN resname IN ('ASN', 'GLN') THEN CASE WHEN name IN ('OD1', 'OE1') THEN ['acceptor'] WHEN name IN ('ND2', 'NE2') THEN ['donor'] ELSE [] END
 WHEN resname IN ('SER', 'THR', 'TYR') AND name IN ('OG', 'OG1', 'OH') THEN ['donor', 'acceptor'] WHEN resname = 'HIS' AND name IN ('ND1', 'NE2') THEN ['acceptor', 'aromatic'] WHEN resname = 'HIS' AND name IN ('CE1', 'CD2', 'CG') THEN ['aromatic']
 WHEN resname IN ('PHE', 'TYR', 'TRP') THEN CASE WHEN elem IN ('C', 'N') THEN ['aromatic'] ELSE [] END || CASE WHEN resname = 'TRP' AND name = 'NE1' THEN ['donor'] ELSE [] END
 WHEN record = 'HETATM' THEN CASE elem WHEN 'O' THEN ['acceptor'] WHEN 'N' THEN ['donor', 'acceptor'] WHEN 'C' THEN ['hydrophobe'] WHEN 'S' THEN ['hydrophobe'] ELSE [] END
 WHEN resname IN ('ALA', 'VAL', 'LEU', 'ILE', 'MET', 'PRO') AND elem IN ('C', 'S') THEN ['hydrophobe'] WHEN elem = 'O' THEN ['acceptor'] WHEN elem = 'N' THEN ['donor'] WHEN elem = 'S' THEN ['hydrophobe'] ELSE [] END"""
SITES = f"sites AS (SELECT file, du_index, line_no, unnest({KINDS}) AS kind, resname, name, chain, resseq, icode, record, x, y, z FROM solid JOIN du USING (file) WHERE {D2} <= 9.0)"


@query(f"WITH {TEN}, {SITES} SELECT file, du_index, line_no, kind FROM sites", INT="du_index")
def structure_sites(spark, sf):
    rows, marks = both(spark, sf)
    return pdb.interaction_sites(rows, marks, RADIUS).select("file", "du_index", "line_no", "kind")


@query(f"""WITH {ST} SELECT file, line_no, kind FROM (SELECT file, line_no, unnest(CASE WHEN record = 'ATOM' AND name IN ('N', 'C', 'O', 'OXT', 'CA') THEN [] ELSE {KINDS} END) AS kind FROM a)""")
def structure_site_rules(spark, sf):
    """All atoms by the rules alone, main chains left out."""
    kinds = residues.site_kinds(F.col("resname"), F.col("atom_name"), F.col("elem"), F.col("record") == "HETATM", backbone=False)
    return parsed(spark, sf).select("file", "line_no", F.explode(kinds).alias("kind"))


BASES = ", ".join(f"('{r}', '{a}', {_list(b)})" for r, a, b in residues.DIRECTION_BASES)


@query(
    f"""WITH {TEN}, {SITES}, rule(res, atom, bases) AS (VALUES {BASES}),
 near AS (SELECT file, du_index, chain, resseq, icode, resname, name, max(line_no) AS l FROM solid JOIN du USING (file) WHERE {D2} <= 9.0 GROUP BY ALL),
 own AS (SELECT near.*, a.x AS bx, a.y AS by_, a.z AS bz FROM near JOIN a ON a.line_no = near.l AND a.file = near.file),
 dir AS (SELECT s.file, s.du_index, s.line_no, s.kind, CASE WHEN s.record = 'ATOM' THEN (SELECT arg_min([o.bx, o.by_, o.bz], list_position(coalesce(r1.bases, r2.bases), o.name)) FROM own o WHERE o.file = s.file AND o.du_index = s.du_index AND o.chain = s.chain AND o.resseq = s.resseq AND o.icode = s.icode AND o.resname = s.resname AND list_contains(coalesce(r1.bases, r2.bases), o.name)) END AS base, s.x, s.y, s.z
  FROM sites s LEFT JOIN rule r1 ON r1.res = s.resname AND r1.atom = s.name LEFT JOIN rule r2 ON r2.res = '*' AND r2.atom = s.name WHERE s.kind IN ('donor', 'acceptor')),
 v AS (SELECT *, x - base[1] AS dx, y - base[2] AS dy, z - base[3] AS dz FROM dir)
 SELECT file, du_index, line_no, kind, round(dx / sqrt(dx * dx + dy * dy + dz * dz), 6) AS ux, round(dz / sqrt(dx * dx + dy * dy + dz * dz), 6) AS uz FROM v""",
    INT="du_index",
)
def structure_directions(spark, sf):
    rows, marks = both(spark, sf)
    return pdb.directional_sites(rows, marks, RADIUS).select("file", "du_index", "line_no", "kind", F.round(F.get("dir", 0), 6).alias("ux"), F.round(F.get("dir", 2), 6).alias("uz"))


RINGS = ", ".join(f"('{r}', {_list(a)})" for r, a in residues.RING_ATOMS.items())


@query(
    f"""WITH {TEN}, ring(res, names) AS (VALUES {RINGS}),
 p AS (SELECT file, du_index, chain, resseq, icode, resname, list_position(names, name) AS place, x, y, z FROM a JOIN ring ON res = resname AND list_contains(names, name) JOIN du USING (file) WHERE {D2} <= 64.0),
 g AS (SELECT file, du_index, chain, resseq, icode, resname, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, list([x, y, z] ORDER BY place) AS q FROM p GROUP BY ALL HAVING count(*) >= 3),
 e AS (SELECT *, q[1][1] - cx AS a1, q[1][2] - cy AS a2, q[1][3] - cz AS a3, q[2][1] - cx AS b1, q[2][2] - cy AS b2, q[2][3] - cz AS b3 FROM g),
 n AS (SELECT *, a2 * b3 - a3 * b2 AS nx, a3 * b1 - a1 * b3 AS ny, a1 * b2 - a2 * b1 AS nz FROM e)
 SELECT file, du_index, chain, resseq, resname, round(cx, 6) AS cx, round(nx / sqrt(nx * nx + ny * ny + nz * nz), 6) AS nx, round(nz / sqrt(nx * nx + ny * ny + nz * nz), 6) AS nz FROM n""",
    INT="du_index",
)
def structure_rings(spark, sf):
    rows, marks = both(spark, sf)
    out = pdb.ring_planes(rows, marks, 8.0)
    return out.select("file", "du_index", "chain", "resseq", "resname", F.round(F.get("centroid", 0), 6).alias("cx"), F.round(F.get("normal", 0), 6).alias("nx"), F.round(F.get("normal", 2), 6).alias("nz"))


@query(f"WITH {ST} SELECT file, raw AS chain, count(*) AS n, round(sum(x), 3) AS sx, round(sum(z), 3) AS sz FROM a GROUP BY ALL")
def structure_coordinates(spark, sf):
    return pdb.coordinates(lines(spark, sf)).groupBy("file", "chain").agg(F.count("*").alias("n"), F.round(F.sum("x"), 3).alias("sx"), F.round(F.sum("z"), 3).alias("sz"))


@query(f"WITH {ST} SELECT file, string_agg(DISTINCT chain, ';' ORDER BY chain) AS chains FROM st WHERE chain <> '?' GROUP BY file")
def structure_chain_ids(spark, sf):
    return pdb.chain_ids(lines(spark, sf)).select("file", F.array_join("chains", ";").alias("chains"))


@query(f"WITH {ST} SELECT file, count(*) AS n, sum(line_no)::BIGINT AS lines FROM st WHERE resname NOT IN {tuple(HETERO)} GROUP BY file")
def structure_receptor_lines(spark, sf):
    return pdb.receptor_lines(lines(spark, sf)).groupBy("file").agg(F.count("*").alias("n"), F.sum("line_no").alias("lines"))


@query(f"WITH {ST} SELECT file, chain, resseq, icode, round(avg(x), 6) AS ax, round(avg(y), 6) AS ay, round(avg(z), 6) AS az FROM a WHERE resname = 'DU' AND {FIRST_MODEL} GROUP BY ALL")
def structure_centres(spark, sf):
    return pdb.structure(parsed(spark, sf)).select("file", "chain", "resseq", "icode", *[F.round(c, 6).alias(c) for c in ("ax", "ay", "az")])


COMPOUND = ["HEADER    TEST", "COMPND    MOL_ID: 1; MOLECULE: LIGASE {n};", "COMPND   2 CHAIN: A, B; ", "COMPND   3 MOL_ID: 2;", "COMPND   4 MOLECULE: PARTNER, {n};", "COMPND   5 CHAIN: B,C;", "SOURCE    MOL_ID: 1;", "COMPND   6 MOL_ID: 3; MOLECULE: LATE; CHAIN: Z;"]


def compounds(spark: SparkSession, sf: str) -> DataFrame:
    some = F.array(*[F.lit(x) for x in COMPOUND])
    rows = table(spark, sf, "supplier").select(F.concat(F.lit("f"), F.floor(F.col("s_suppkey") / 4)).alias("file"), "s_suppkey").groupBy("file").agg(F.min("s_suppkey").alias("n"))
    rows = rows.select("file", "n", F.posexplode(some).alias("line_no", "value"))
    return rows.select("file", "line_no", F.replace("value", F.lit("{n}"), F.col("n").cast("string")).alias("value"))


COMPOUNDS = "cm AS (SELECT file, unnest(['A', 'B', 'C']) AS chain, unnest(['LIGASE ' || n, 'PARTNER, ' || n, 'PARTNER, ' || n]) AS molecule FROM (SELECT 'f' || s_suppkey // 4 AS file, min(s_suppkey) AS n FROM supplier GROUP BY 1))"


@query(f"WITH {COMPOUNDS} SELECT * FROM cm")
def structure_molecules(spark, sf):
    return pdb.chain_molecules(compounds(spark, sf))


@query(f"WITH {COMPOUNDS} SELECT file, chain, contains(upper(molecule), 'LIGASE') AS is_ligase FROM cm")
def structure_roles(spark, sf):
    return pdb.chain_molecules(compounds(spark, sf)).select("file", "chain", text.role_of(F.col("molecule"), ["ligase", "E3"]).alias("is_ligase"))


@query(
    f"""WITH {ST}, {COMPOUNDS}, i AS (SELECT file, chain, count(DISTINCT CASE WHEN record = 'ATOM' AND name = 'CA' THEN resseq || ':' || icode END) AS n_residues_ca, max(CASE WHEN resname = 'DU' THEN 1 ELSE 0 END)::INT AS "has_DU",
 coalesce(string_agg(DISTINCT CASE WHEN resname = 'LIG' THEN resname END, ';'), '') AS het_resnames FROM a WHERE {FIRST_MODEL} GROUP BY file, chain) SELECT i.*, molecule FROM i LEFT JOIN cm USING (file, chain)"""
)
def structure_chain_info(spark, sf):
    return pdb.chain_info(parsed(spark, sf), pdb.chain_molecules(compounds(spark, sf)))


@query("SELECT p_brand AS file, 'P_' || p_type AS pocket_id, arg_max(p_size, p_partkey)::DOUBLE AS volume FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 GROUP BY ALL")
def pocket_volumes(spark, sf):
    """The last readable row of each pocket counts."""
    kind = F.when(F.col("p_partkey") % 7 == 0, "X_").otherwise("P_")
    size = F.when(F.col("p_partkey") % 5 == 0, "n/a").otherwise(F.col("p_size").cast("string"))
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("file"), (F.col("p_partkey") + 1).cast("int").alias("line_no"), F.concat_ws("  ", F.lit(" "), F.concat(kind, "p_type"), F.lit("0.5"), size).alias("value"))
    head = rows.select("file").distinct().select("file", F.lit(-1).alias("line_no"), F.lit("name\tlig volume").alias("value"))
    return pdb.pocket_table(rows.unionByName(head))


@query("SELECT 'f' || s_suppkey AS file, s_nationkey::DOUBLE AS cx, round(s_acctbal, 2) AS cy, -1.5 AS cz FROM supplier WHERE s_suppkey % 60 < 50", DOUBLE="cz")
def pocket_centres(spark, sf):
    """A centre stated beyond the first fifty lines is none."""
    value = F.format_string("REMARK  Geometric pocket center at %d  %.2f -1.5", F.col("s_nationkey"), F.round("s_acctbal", 2))
    rows = table(spark, sf, "supplier").select(F.concat(F.lit("f"), F.col("s_suppkey")).alias("file"), (F.col("s_suppkey") % 60).cast("int").alias("line_no"), value.alias("value"))
    return pdb.pocket_centre(rows)


@query("SELECT event_id, CASE WHEN user_id % 3 = 0 THEN upper(substr(user_id || 'abc', 1, 4)) WHEN user_id % 3 = 1 AND user_id < 50 THEN '1X' || lpad(upper(to_base(user_id, 16)), 2, '0') END AS pdb_id, upper(substr('ab' || (user_id % 90 + 10), 1, 4)) AS short_id FROM (SELECT event_id, user_id FROM events)")
def structure_ids(spark, sf):
    """From the name where it starts with an id, else from the header among the first fifty lines."""
    e = table(spark, sf, "events").select("event_id", "user_id")
    own = F.substr(F.concat(F.col("user_id").cast("string"), F.lit("abc")), F.lit(1), F.lit(4))
    path = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("d/1/"), own, F.lit("_with_DU.pdb"))).otherwise(F.concat(F.lit("d/x"), F.col("user_id").cast("string"), F.lit(".pdb")))
    header = F.format_string("%-62s1x%s", F.lit("HEADER    LIGASE"), F.lpad(F.hex(F.col("user_id")), 2, "0"))
    heads = e.select(F.col("event_id").alias("file"), F.when(F.col("user_id") < 50, 0).otherwise(50).alias("line_no"), F.when(F.col("user_id") % 3 == 1, header).otherwise("HEADER    NO ID").alias("value"))
    rows = e.withColumn("path", path).join(pdb.header_id(heads).withColumnRenamed("file", "event_id"), "event_id", "left")
    short = pdb.short_id(F.concat(F.lit("d/ab"), (F.col("user_id") % 90 + 10).cast("string"), F.lit("_x.csv")))
    return rows.select("event_id", pdb.structure_id(F.col("path"), F.col("header")).alias("pdb_id"), short.alias("short_id"))


@query("SELECT DISTINCT upper(trim(event_type)) AS pdb_id FROM events")
def structure_id_list(spark, sf):
    return tables.id_list(table(spark, sf, "events").select(F.concat(F.lit(" "), F.col("event_type")).alias("PDB_ID"), "user_id")).select("pdb_id")


@query("SELECT o_orderkey, o_orderstatus IN ('F', 'O') AS is_structure FROM orders")
def structure_sniff(spark, sf):
    body = F.when(F.col("o_orderstatus") == "F", "REMARK\nATOM      1").when(F.col("o_orderstatus") == "O", "HETATM    1").otherwise("an ATOM in words")
    return table(spark, sf, "orders").select("o_orderkey", text.looks_like_structure(body).alias("is_structure"))


# ---- residue classes, spatial operators on structures


def _class(names: list[str]) -> str:
    return f"resname IN {tuple(names)}"


@query(
    f"""WITH {ST} SELECT file, count_if({_class(["LYS", "ARG", "HIS"])}) AS pos, count_if({_class(["ASP", "GLU"])}) AS neg, count_if({_class(["PHE", "TYR", "TRP", "HIS"])}) AS aromatic,
 count_if({_class("SER THR ASN GLN TYR CYS HIS ASP GLU LYS ARG".split())}) AS polar, count_if({_class("ALA VAL LEU ILE MET PRO GLY PHE TRP".split())}) AS apolar,
 count_if({_class("ALA VAL LEU ILE MET PRO GLY PHE TRP TYR".split())}) AS face_apolar, count_if({_class("SER THR CYS ASN GLN HIS LYS ARG ASP GLU TYR".split())}) AS face_polar, count_if({_class(["PHE", "TRP", "TYR", "HIS"])}) AS face_aromatic, count_if({_class("ALA VAL LEU ILE MET".split())}) AS face_aliphatic
 FROM a GROUP BY file""",
    BIGINT="pos neg aromatic polar apolar face_apolar face_polar face_aromatic face_aliphatic",
)
def residue_classes(spark, sf):
    one, two = residues.environment_flags(F.lower("resname")), residues.interface_flags(F.col("resname"))
    named = {k[3:]: v for k, v in one.items()} | {f"face_{k[3:]}": v for k, v in two.items()}
    return parsed(spark, sf).groupBy("file").agg(*[F.count_if(v).alias(k) for k, v in named.items()])


@query(f"WITH {TEN} SELECT file, du_index, count(DISTINCT chain || ':' || resseq || icode || ':' || resname) AS n_residues, round(sqrt(min({D2})), 6) AS nearest FROM a JOIN du USING (file) WHERE record = 'ATOM' AND name = 'CA' AND {D2} <= 9.0 GROUP BY ALL", INT="du_index")
def alpha_carbon_join(spark, sf):
    rows, marks = both(spark, sf)
    near = spatial.alpha_carbons(marks.select("file", "du_index", "ax", "ay", "az"), rows.withColumn("resid", pdb.residue_key()), RADIUS, ["file"])
    return near.groupBy("file", "du_index").agg(F.count_distinct("resid").alias("n_residues"), F.round(F.sqrt(F.min("d2")), 6).alias("nearest"))


@query(
    f"""WITH {TEN}, r AS (SELECT p.file AS file, p.chain AS chain, p.resseq || p.icode AS resi, p.resname AS resname, round(sqrt(min((p.x - l.x) * (p.x - l.x) + (p.y - l.y) * (p.y - l.y) + (p.z - l.z) * (p.z - l.z))), 6) AS distance
 FROM a l JOIN a p ON p.file = l.file AND l.resname = 'LIG' AND p.record = 'ATOM' WHERE (p.x - l.x) * (p.x - l.x) + (p.y - l.y) * (p.y - l.y) + (p.z - l.z) * (p.z - l.z) <= 4.0 GROUP BY ALL)
 SELECT *, row_number() OVER (PARTITION BY file ORDER BY distance, chain, resi, resname) AS place FROM r""",
    INT="place",
)
def cavity_residues(spark, sf):
    """Residues of the protein within 2 of any ligand atom, nearest first."""
    rows = pdb.atoms(lines(spark, sf, ten=True))
    ligand = rows.where("resname = 'LIG'").select("file", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az"))
    protein = rows.where("record = 'ATOM'").select("file", "chain", F.concat("resseq", "icode").alias("resi"), "resname", pdb.residue_key().alias("resid"), "x", "y", "z")
    found = environment.residues(spatial.grid_join(ligand, protein, 2.0, ["file"]), ["file"], ["chain", "resi", "resname"])
    out = found.select("file", "chain", "resi", "resname", F.round(F.sqrt("min_d2"), 6).alias("distance"))
    return spatial.grouped_rank(out, ["file"], [F.col("distance"), F.col("chain"), F.col("resi"), F.col("resname")], "place")


@query(f"WITH {TEN} SELECT file, du_index, CASE WHEN min({D2}) IS NULL THEN 'inf'::DOUBLE ELSE round(sqrt(min({D2})), 6) END AS dist FROM du LEFT JOIN (SELECT * FROM a WHERE resname = 'SER') USING (file) GROUP BY ALL", INT="du_index")
def nearest_serine(spark, sf):
    rows, marks = both(spark, sf)
    points = rows.where("resname = 'SER'").select(F.col("file").alias("__file"), "x", "y", "z").withColumnRenamed("__file", "file")
    out = spatial.min_distances(marks.select("file", "du_index", "ax", "ay", "az"), points, ["file", "du_index"], "file")
    return out.select("file", "du_index", F.round("dist", 6).alias("dist"))


@query(f"WITH {ST}, n AS (SELECT file, chain, count(*) AS k, min(line_no) AS first FROM a GROUP BY ALL) SELECT file, place, chain FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY k DESC, first) AS place FROM n) WHERE place <= 2", INT="place")
def chain_pairs(spark, sf):
    return environment.chain_pair(parsed(spark, sf), "file").select("file", "place", "chain")


@query(f"WITH {ST}, v AS (SELECT ord, [x, y, z] AS v, sqrt(x * x + y * y + z * z) AS n FROM a) SELECT ord, round(v[1] / n, 6) AS ux, round(v[2] / n, 6) AS uy, round(v[3] / n, 6) AS uz FROM v")
def unit_vectors(spark, sf):
    u = geometry.unit_vector(F.array("x", "y", "z"))
    return parsed(spark, sf).select((F.col("line_no") / 2).cast("long").alias("ord"), *[F.round(F.get(u, i), 6).alias(f"u{c}") for i, c in enumerate("xyz")])


@query(
    """WITH u AS (SELECT event_id, (event_id % 17) / 17.0::DOUBLE AS a, (user_id % 13) / 13.0::DOUBLE AS b, (event_id % 11) / 11.0::DOUBLE AS c FROM events),
 q AS (SELECT event_id, sqrt(1 - a) * sin(2 * pi() * b) AS x, sqrt(1 - a) * cos(2 * pi() * b) AS y, sqrt(a) * sin(2 * pi() * c) AS z, sqrt(a) * cos(2 * pi() * c) AS w FROM u)
 SELECT event_id, round(1 - 2 * (y * y + z * z) + 2 * (2 * (x * y - w * z)) + 3 * (2 * (x * z + w * y)), 6) AS rx, round(2 * (x * y + w * z) + 2 * (1 - 2 * (x * x + z * z)) + 3 * (2 * (y * z - w * x)), 6) AS ry, round(2 * (x * z - w * y) + 2 * (2 * (y * z + w * x)) + 3 * (1 - 2 * (x * x + y * y)), 6) AS rz FROM q"""
)
def rotations(spark, sf):
    """The point (1, 2, 3) turned by each row's rotation."""
    u = F.array(*[F.col(c) % n / float(n) for c, n in (("event_id", 17), ("user_id", 13), ("event_id", 11))])
    turned = geometry.rotated(F.array(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))), geometry.rotation(u))
    return table(spark, sf, "events").select("event_id", F.get(turned, 0).alias("p")).select("event_id", *[F.round(F.get("p", i), 6).alias(f"r{c}") for i, c in enumerate("xyz")])


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 0 THEN greatest(0.0, least(1.0, (m - 0.5 * (l_linenumber - m)) / l_linenumber)) ELSE 0.0 END AS ph4,
 coalesce((coalesce(h, 0.0) + coalesce(s, 0.0)) / nullif((h IS NOT NULL)::INT + (s IS NOT NULL)::INT, 0), 0.0) AS total FROM (SELECT l_orderkey, l_linenumber, l_partkey % (l_linenumber + 1) AS m, CASE WHEN l_partkey % 3 = 0 THEN l_discount END AS h, CASE WHEN l_partkey % 4 <> 0 THEN l_tax END AS s FROM lineitem)""",
    DOUBLE="ph4 total",
)
def feature_scores(spark, sf):
    n, m = F.col("l_linenumber"), F.col("l_partkey") % (F.col("l_linenumber") + 1)
    h, s = F.when(F.col("l_partkey") % 3 == 0, F.col("l_discount")), F.when(F.col("l_partkey") % 4 != 0, F.col("l_tax"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", spatial.match_fraction(m, n, 0.5).alias("ph4"), spatial.interaction_total(h, s).alias("total"))


WINDOW = "CASE WHEN d >= 3.5 THEN 0.0 WHEN d <= 2.8 THEN 1.0 ELSE greatest(0.0, (3.5 - d) / 0.7) END"


@query(
    f"""WITH p AS (SELECT event_id, 2 + user_id % 20 / 10.0::DOUBLE AS d, event_id % 5 / 5.0::DOUBLE AS a, user_id % 7 / 7.0::DOUBLE AS b, event_id % 3 = 0 AS no_a, user_id % 4 = 0 AS no_b FROM events)
 SELECT event_id, round({WINDOW} * (0.35 + 0.65 * CASE WHEN no_a THEN 1.0 ELSE a END) * (0.35 + 0.65 * CASE WHEN no_b THEN 1.0 ELSE b END), 6) AS hbond, round(CASE WHEN d + 1.5 >= 5.5 THEN 0.0 WHEN d + 1.5 <= 4.2 THEN 1.0 ELSE (5.5 - d - 1.5) / 1.3 END * a * b, 6) AS stacking FROM p""",
    DOUBLE="hbond stacking",
)
def direction_scores(spark, sf):
    d = 2 + F.col("user_id") % 20 / 10.0
    a, b = F.col("event_id") % 5 / 5.0, F.col("user_id") % 7 / 7.0
    axis = lambda v: F.array(v, F.lit(0.0), F.lit(0.0))
    one = F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))
    hbond = spatial.hydrogen_bond_score(d, F.when(F.col("event_id") % 3 != 0, axis(a)), F.when(F.col("user_id") % 4 != 0, axis(-b)), one, 3.5)
    return table(spark, sf, "events").select("event_id", F.round(hbond, 6).alias("hbond"), F.round(spatial.stacking_score(d + 1.5, axis(a), axis(-b), 5.5), 6).alias("stacking"))


# ---- structures written


@query(
    f"""WITH {ST}, c AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY du_index) AS n, ax FROM du), s AS (SELECT file, max(ord % 100000) AS serial FROM st GROUP BY file)
 SELECT file, n AS place, (serial + n)::INT AS serial, n::INT AS resseq, ax FROM c JOIN s USING (file)""",
    INT="place",
)
def marked_structures(spark, sf):
    """All its markers written into each structure before its end, and read back: their serial and residue numbers, and that they stand after all atoms."""
    whole = lines(spark, sf)
    ends = whole.select("file").distinct().select("file", F.lit(2**31 - 2).alias("line_no"), F.lit("END").alias("value"))
    centres = pdb.anchors(pdb.atoms(whole)).select("file", F.col("du_index").alias("ord"), F.col("ax").alias("x"), F.col("ay").alias("y"), F.col("az").alias("z"))
    out = writers.with_markers(whole.where("value <> 'MODEL'").unionByName(ends), centres)
    order = [F.col("section"), F.col("ord")]
    numbered = spatial.grouped_rank(out, ["file"], order, "line_no").select("file", F.col("line_no").cast("int").alias("line_no"), "value", "section")
    new = pdb.atoms(numbered.where("section = 1").drop("section"))
    own = pdb.anchors(new.where("chain = 'Z'"))
    back = new.select("file", F.col("serial"), F.col("resseq").cast("int").alias("resseq"), F.col("x").alias("ax"))
    return back.join(own.select("file", F.col("resseq").cast("int").alias("resseq"), (F.col("du_index") + 1).alias("place")), ["file", "resseq"]).select("file", "place", "serial", "resseq", "ax")


@query(
    """WITH p AS (SELECT p_brand AS pdb_id, 'P_' || p_partkey AS pocket_id, p_size AS volume, p_size > 20 AS selected, CASE WHEN p_size > 20 THEN '[]' ELSE '["volume"]' END AS why FROM part)
 SELECT pdb_id, '{"pdb_id":"' || pdb_id || '","pockets":[' || string_agg('{"pocket_id":"' || pocket_id || '","volume":' || volume || ',"selected":' || selected || ',"reasons":' || why || '}', ',' ORDER BY pocket_id) || ']}' AS json FROM p GROUP BY pdb_id
 UNION ALL SELECT 'n' || n_nationkey, '{"pdb_id":"n' || n_nationkey || '","error":"no \\"' || n_name || '\\"","type":"ValueError"}' FROM nation"""
)
def pocket_decisions(spark, sf):
    chosen = F.col("p_size") > 20
    why = F.when(chosen, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.lit("volume")))
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("pdb_id"), F.concat(F.lit("P_"), F.col("p_partkey")).alias("pocket_id"), F.col("p_size").alias("volume"), chosen.alias("selected"), why.alias("reasons"))
    failed = table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("pdb_id"), F.concat(F.lit('no "'), F.col("n_name"), F.lit('"')).alias("error"), F.lit("ValueError").alias("type"))
    return writers.decisions_json(rows).unionByName(writers.error_json(failed))


def molecules(spark: SparkSession, sf: str) -> DataFrame:
    """(mol, atoms, bonds): ten atoms of ``embeddings`` each; every third bond is missing, so that molecules fall into fragments."""
    at = lambda i: F.get("embedding", i).cast("double") * 10
    kind = F.when(F.col("vec_id") % 5 == 0, "H").when(F.col("vec_id") % 41 == 7, "Zn").otherwise("C")
    atom = F.struct("vec_id", kind.alias("elem"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))
    rows = table(spark, sf, "embeddings").groupBy(F.floor(F.col("vec_id") / 10).alias("mol")).agg(F.array_sort(F.collect_list(atom)).alias("all"))
    atoms = F.transform("all", lambda s: F.struct(s["elem"].alias("elem"), s["x"].alias("x"), s["y"].alias("y"), s["z"].alias("z")))
    bonds = F.filter(F.sequence(F.lit(1), F.size("all") - 1), lambda i: (i + F.col("mol").cast("int")) % 4 != 0)
    bonds = F.transform(F.when(F.size("all") > 1, bonds).otherwise(F.expr("cast(array() as array<int>)")), lambda i: F.struct(i.alias("a"), (i + 1).alias("b"), F.lit(1).alias("order")))
    return rows.select("mol", atoms.alias("atoms"), bonds.alias("bonds"))


MOLS = """ma AS (SELECT vec_id // 10 AS mol, vec_id % 10 + 1 AS i, CASE WHEN vec_id % 5 = 0 THEN 'H' WHEN vec_id % 41 = 7 THEN 'Zn' ELSE 'C' END AS elem, embedding[1]::DOUBLE * 10 AS x FROM embeddings),
 fr AS (SELECT *, sum(CASE WHEN i > 1 AND (i - 1 + mol) % 4 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY mol ORDER BY i) AS part FROM ma)"""


@query(
    f"""WITH {MOLS}, g AS (SELECT mol, part, count_if(elem <> 'H') AS heavy, count(*) AS n, min(i) AS first, round(sum(x), 6) AS sx FROM fr GROUP BY mol, part), k AS (SELECT *, row_number() OVER (PARTITION BY mol ORDER BY heavy DESC, n DESC, first) AS place FROM g)
 SELECT mol, n::INT AS n_atoms, heavy::INT AS heavy, (n - 1)::INT AS n_bonds, sx FROM k WHERE place = 1"""
)
def largest_fragments(spark, sf):
    out = chemistry.largest_fragment(molecules(spark, sf))
    total = F.aggregate("atoms", F.lit(0.0), lambda s, a: s + a["x"])
    return out.select("mol", F.size("atoms").alias("n_atoms"), chemistry.heavy_atoms(F.col("atoms")).alias("heavy"), F.size("bonds").alias("n_bonds"), F.round(total, 6).alias("sx"))


@query(f"WITH {MOLS} SELECT mol, CASE WHEN count_if(elem = 'Zn') > 0 THEN 'unsupported element Zn' WHEN mol % 3 = 0 THEN 'non-finite charge on atom 1' END AS issue FROM ma GROUP BY mol")
def docking_issues(spark, sf):
    charges = F.transform("atoms", lambda a, i: F.when((i == 1) & (F.col("mol") % 3 == 0), F.lit(float("nan"))).otherwise(F.lit(0.1)))
    return molecules(spark, sf).select("mol", chemistry.incompatible(F.col("atoms"), charges).alias("issue"))


@query(
    """WITH t AS (SELECT mol, x0[1] AS ax, x0[2] AS ay, x0[3] AS az, x0[4] AS bx, x0[5] AS by_, x0[6] AS bz FROM (SELECT vec_id AS mol, list_transform(embedding[1:6], lambda v: v::DOUBLE * 10) AS x0 FROM embeddings)),
 d AS (SELECT *, ax - (bx + 1) / 2 AS dx, ay - (by_ + 1) / 2 AS dy, az - (bz + 1) / 2 AS dz FROM t), n AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS len FROM d)
 SELECT mol, round(dx / len, 6) AS ux, round(dz / len, 6) AS uz, round((ax + bx + 1) / 3, 6) AS cx, true AS upright FROM n"""
)
def ligand_directions(spark, sf):
    """The direction of an atom away from its two neighbours, and the plane through the three."""
    v = lambda i: F.get("embedding", i).cast("double") * 10
    atom = lambda *p: F.struct(F.lit("C").alias("elem"), *[c.alias(n) for c, n in zip(p, "xyz", strict=True)])
    one = F.lit(1.0)
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("mol"), F.array(atom(v(0), v(1), v(2)), atom(v(3), v(4), v(5)), atom(one, one, one)).alias("atoms"), F.expr("array(named_struct('a', 2, 'b', 1, 'order', 1), named_struct('a', 1, 'b', 3, 'order', 1), named_struct('a', 2, 'b', 3, 'order', 1))").alias("bonds"))
    rows = rows.withColumns({"d": chemistry.feature_direction(F.col("atoms"), F.col("bonds"), F.array(F.lit(0))), "p": chemistry.ring_plane(F.col("atoms"), F.array(F.lit(0), F.lit(1), F.lit(2)))})
    arm = F.array(*[F.get("atoms", 1)[c] - F.get("atoms", 0)[c] for c in "xyz"])
    return rows.select("mol", F.round(F.get("d", 0), 6).alias("ux"), F.round(F.get("d", 2), 6).alias("uz"), F.round(F.get("p.centroid", 0), 6).alias("cx"), (F.abs(geometry.dot(F.col("p.normal"), arm)) < 1e-6).alias("upright"))


@query("SELECT c_custkey, 'AA' || c_custkey % 7 AS key, coalesce(upper(n_name), '') AS gene FROM customer LEFT JOIN nation ON n_nationkey = c_custkey % 30")
def gene_lookup(spark, sf):
    """Chain to accession to gene: of several mappings the first counts, and a row stays one row."""
    rows = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 30).alias("chain"))
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("chain"), F.concat(F.lit("U"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("accession"), F.upper("n_name").alias("gene"))
    chains = nation.select("chain", "accession", F.lit(1).alias("no")).unionByName(nation.select("chain", F.lit("A0").alias("accession"), F.lit(2).alias("no")))
    out = enrich.lookup(rows, chains, "chain", ["accession"], [F.col("no")])
    out = enrich.lookup(out, nation.unionByName(nation.withColumn("gene", F.lit("zz"))), "accession", ["gene"])
    return out.select("c_custkey", F.concat(F.lit("AA"), F.col("c_custkey") % 7).alias("key"), F.coalesce("gene", F.lit("")).alias("gene"))


@query("SELECT o_custkey AS pdb_id, string_agg(DISTINCT 'T' || l_suppkey % 20, ';' ORDER BY 'T' || l_suppkey % 20) AS targets FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey")
def target_sets(spark, sf):
    """1 to N to a set: structure to accessions to targets."""
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("pdb_id"), F.col("o_orderkey").alias("accession"))
    links = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("accession"), F.concat(F.lit("T"), F.col("l_suppkey") % 20).alias("target"))
    return enrich.targets(orders.select("pdb_id"), "pdb_id", orders, links).select("pdb_id", F.array_join("targets", ";").alias("targets"))
