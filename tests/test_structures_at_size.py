"""Structures at sizes that the given tables don't reach."""

import duckdb

from lodestone.plans import catalog, structures
from lodestone.sinks import writers
from lodestone.sources import pdb


def test_serials_beyond_five_columns_are_read_back(spark):
    line = "ATOM  99999  CA  SER A   7       1.000   2.000   3.000  1.00  0.00           C"
    lines = spark.createDataFrame([("f", 0, line), ("f", 1, "END")], "file string, line_no int, value string")
    centres = spark.createDataFrame([("f", 0, 1.5, 2.5, 3.5), ("f", 1, 4.5, 5.5, 6.5)], "file string, ord int, x double, y double, z double")
    out = writers.with_markers(lines, centres)
    rows = pdb.atoms(out.where("section = 1").withColumnRenamed("ord", "line_no").drop("section")).orderBy("line_no").collect()
    assert [(r["serial"], r["resname"], r["chain"], r["resseq"], r["x"]) for r in rows] == [(100000, "DU", "Z", "1", 1.5), (100001, "DU", "Z", "2", 4.5)]


def test_pairs_lie_within_ten_structures_that_grow_with_the_table(spark, tmp_path):
    """Structures of bounded size would leave an anchor without most atoms of its structure."""
    spark.range(2400).selectExpr("id as vec_id", "transform(sequence(1, 64), i -> cast(pmod(id * 7 + i * 13, 29) / 29.0 - 0.5 as float)) as embedding", "cast(id % 10 as int) as label").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert structures.pdb.atoms(structures.lines(spark, str(tmp_path), ten=True)).select("file").distinct().count() == 10
    for name in ("structure_sites", "alpha_carbon_join"):
        pairs = spark_rows = {tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()}
        assert pairs == set(con.sql(catalog.ORACLES[name]).fetchall()) and {r[0] for r in spark_rows} == {f"f{i}" for i in range(10)}


def test_ring_atoms_of_one_name_come_last_line_first(spark):
    """Two residues of one label: the plane lies by the last line of the first name, then the line before it."""
    names, places = ["CG", "CD1", "CZ", "CG", "CD1", "CZ"], [(1, 0, 0), (0, 1, 0), (0, 0, 1), (2, 2, 0), (3, 0, 0), (0, 1, 2)]
    rows = spark.createDataFrame([("f", "A", "1", "", "TYR", n, i, *map(float, p)) for i, (n, p) in enumerate(zip(names, places, strict=True))], "file string, chain string, resseq string, icode string, resname string, atom_name string, line_no int, x double, y double, z double")
    marks = spark.createDataFrame([("f", 0, 0.0, 0.0, 0.0)], "file string, du_index int, ax double, ay double, az double")
    (ring,) = pdb.ring_planes(rows, marks, 8.0).collect()
    centre = [sum(p[k] for p in places) / 6 for k in range(3)]
    a, b = ([places[i][k] - centre[k] for k in range(3)] for i in (3, 0))
    n = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    assert all(abs(x - y / sum(v * v for v in n) ** 0.5) < 1e-9 for x, y in zip(ring["normal"], n, strict=True)) and all(abs(x - y) < 1e-9 for x, y in zip(ring["centroid"], centre, strict=True))


def dealt_in_blocks(out):
    """Only the two sides are shuffled, dealt by number; nothing that grows with their pairs."""
    plan = out._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") == 2


def test_rings_and_anchors_meet_in_blocks(spark, sf_dir):
    assert dealt_in_blocks(structures.structure_rings(spark, sf_dir))


def test_sites_and_anchors_meet_in_blocks(spark, sf_dir):
    assert dealt_in_blocks(structures.structure_directions(spark, sf_dir))
