"""Operators on small inputs: hand cases, brute force, properties."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import chemistry, geometry, numeric, residues, text
from lodestone.operators import beam, enrich, pareto, selection, similarity, spatial, sweep
from lodestone.sinks import writers
from lodestone.sources import fragments, pdb, sdf, tables

LINES = """HEADER    TEST                                    01-JAN-00   1ABC
COMPND    MOL_ID: 1; MOLECULE: LIGASE ONE;
COMPND   2 CHAIN: A, B; MOL_ID: 2; MOLECULE: PARTNER, X; CHAIN: C;
ATOM      1  N   MET A   1      10.000   8.000  29.000  1.00 20.00           N
ATOM      2  CA  MET A   1      11.000   8.000  29.900  1.00 22.00           C
ATOM      3  OG  SER B   2A     12.500   8.000  29.900  1.00 10.00           O
ATOM      4  H   SER B   2A     12.600   8.000  29.900  1.00 10.00           H
HETATM    5  O   HOH A 101      10.600   8.000  29.900  1.00  0.00           O
HETATM    6  O1  LIG A 102      10.700   8.000  29.900  1.00  0.00           O
ATOM      7  CA  GLY C   3         bad   8.000  29.900  1.00  0.00           C
ATOM      8  CA  GLY C
HETATM    9  DU  DU  Z   1      10.500   8.000  29.900  1.00  0.00          DU
MASTER        0
END"""


def lines(spark):
    return spark.createDataFrame([("f", i, s) for i, s in enumerate(LINES.split("\n"))], "file string, line_no int, value string")


def test_structure_parsing(spark):
    rows = pdb.atoms(lines(spark))
    assert rows.count() == 7
    mark = pdb.anchors(rows).collect()
    assert [(m.du_index, m.label, m.ax, m.ay, m.az) for m in mark] == [(0, "Z/1", 10.5, 8.0, 29.9)]
    assert pdb.count_markers(lines(spark)).first().n_du == 1
    assert sorted(r.line_no for r in pdb.protein_atoms(rows).collect()) == [3, 4, 5, 8]
    assert sorted(r.line_no for r in pdb.protein_atoms(rows, hetatm=False).collect()) == [3, 4, 5]
    # the ligand's oxygen within the radius is no obstacle, outside it is
    assert sorted(r.line_no for r in pdb.clash_atoms(rows, pdb.anchors(rows), 2.0).collect()) == [3, 4, 5]
    assert sorted(r.line_no for r in pdb.clash_atoms(rows, pdb.anchors(rows), 0.1).collect()) == [3, 4, 5, 8]
    chains = {r.chain: r.molecule for r in pdb.chain_molecules(lines(spark)).collect()}
    assert chains == {"A": "LIGASE ONE", "B": "LIGASE ONE", "C": "PARTNER, X"}
    info = {r.chain: r for r in pdb.chain_info(rows, pdb.chain_molecules(lines(spark))).collect()}
    assert info["A"].n_residues_ca == 1 and info["A"].het_resnames == "LIG" and info["Z"].has_DU == 1
    sites = {(r.line_no, r.kind) for r in pdb.interaction_sites(rows, pdb.anchors(rows), 3.0).collect()}
    assert sites == {(3, "donor"), (4, "hydrophobe"), (5, "donor"), (5, "acceptor"), (8, "acceptor")}
    directed = pdb.directional_sites(rows, pdb.anchors(rows), 3.0).where("line_no = 3").collect()
    assert len(directed) == 1 and directed[0].dir is not None


def test_marker_lines_go_before_the_end(spark):
    centres = spark.createDataFrame([("f", 0, 1.0, 2.0, 3.0), ("f", 1, -1.5, 0.0, 9.25)], "file string, ord int, x double, y double, z double")
    out = writers.with_markers(lines(spark).where("value not like '%DU  DU%'"), centres).orderBy("section", "ord").collect()
    values = [r.value for r in out]
    assert values[-4] == "HETATM    9  DU   DU Z   1       1.000   2.000   3.000  1.00  0.00          DU"
    assert values[-3].startswith("HETATM   10") and values[-2].startswith("MASTER")


def test_pocket_table_and_centre(spark):
    rows = [("f", 0, "name lig volume"), ("f", 1, " P_1  0 120.5"), ("f", 2, "X 1 2"), ("f", 3, "P_2 0 n/a"), ("f", 4, "REMARK Geometric pocket center at  1.5 -2.0 3")]
    df = spark.createDataFrame(rows, "file string, line_no int, value string")
    assert [(r.pocket_id, r.volume) for r in pdb.pocket_table(df).collect()] == [("P_1", 120.5)]
    assert tuple(pdb.pocket_centre(df).first())[1:] == (1.5, -2.0, 3.0)


def test_sdf_round_trip_and_scores(spark):
    block = "lig1\n  x\n\n  2  1  0  0  0  0  0  0  0  0999 V2000\n    1.0000    2.0000    3.0000 C   0  0\n    0.0000    0.0000    0.0000 O   0  0\n  1  2  1  0\nM  END\n>  <SA_score>\n3.5\n\n>  <vina_score>\n-7.25\n\n"
    df = spark.createDataFrame([("f", 0, block), ("f", 1, "broken")], "file string, ord long, block string")
    got = sdf.scored(sdf.parse_sdf(df)).collect()
    assert len(got) == 1 and got[0].title == "lig1" and got[0].props == {"SA_score": "3.5", "vina_score": "-7.25"}
    assert (got[0].score, got[0].score_source) == (-7.25, "vina_score")
    assert got[0].bonds[0].asDict() == {"a": 1, "b": 2, "order": 1}
    texts = spark.createDataFrame([("free energy = -3.5 kcal", {}), ("nothing", {}), ("> <my_score>\n4.25", {}), ("x", {"Dock_Affinity": "2"})], "b string, p map<string,string>")
    out = [tuple(r.s) for r in texts.select(text.score_of(F.col("p"), F.col("b")).alias("s")).collect()]
    assert out == [(-3.5, "inline_text"), (0.0, "default_0.0"), (4.25, "> <my_score>"), (2.0, "Dock_Affinity")]


def test_fragments():
    assert fragments.parse("# c\nc1ccccc1 Ph\nCCO\n") == [("Ph", "c1ccccc1"), ("CCO", "CCO")]
    assert fragments.parse('A1,"C1CC1"\n') == [("A1", "C1CC1")]
    assert fragments.parse("smiles,id\nCCO,x\n") == [("x", "CCO")]
    assert fragments.parse("[N:2](C)C dim 2", fixed=True) == [("dim", "[N:2](C)C", 2)]
    for bad in ("", "smiles,name\n", "a b c", "C1CC Ph"):
        with pytest.raises(ValueError):
            fragments.parse(bad)
    with pytest.raises(ValueError):
        fragments.parse("[N:1]C x 2", fixed=True)


def test_scores_and_casts(spark):
    golden = spark.range(1).select(numeric.composite(F.lit(0.8103), F.lit(3.3840), F.lit(0.2105), F.lit(0.0)).alias("c")).first().c
    assert round(golden, 4) == 0.7198
    df = spark.createDataFrame([(" 2.5 ",), ("",), (None,), ("nan",), ("3.7",), ("x",), ("-3.7",)], "s string")
    assert [r[0] for r in df.select(numeric.lenient_double(F.col("s"))).collect()] == [2.5, None, None, None, 3.7, None, -3.7]
    assert [r[0] for r in df.select(numeric.lenient_int(F.col("s"), True)).collect()] == [2, None, None, None, 3, None, -3]
    d = spark.createDataFrame([(1.0,), (2.8,), (3.15,), (3.5,)], "d double")
    assert [round(r[0], 6) for r in d.select(numeric.window_score(F.col("d"), 2.8, 3.5)).collect()] == [1.0, 1.0, 0.5, 0.0]
    n = spark.range(1).select(numeric.ratio_nan(F.lit(1), F.lit(0)).alias("a"), numeric.ratio_null(F.lit(2), F.lit(3)).alias("b"), numeric.ratio_zero(F.lit(1), F.lit(0)).alias("c")).first()
    assert n.a != n.a and n.b == 0.6667 and n.c == 0.0


def test_site_rules(spark):
    cases = [("HIS", "N", "N", False, ["donor"]), ("HIS", "ND1", "N", False, ["acceptor", "aromatic"]), ("TRP", "NE1", "N", False, ["aromatic", "donor"]), ("ASN", "CB", "C", False, []), ("LIG", "N1", "N", True, ["donor", "acceptor"]), ("LEU", "CD1", "C", False, ["hydrophobe"]), ("CYS", "SG", "S", False, ["hydrophobe"]), ("LYS", "NZ", "N", False, ["donor", "pos"])]
    df = spark.createDataFrame(cases, "r string, a string, e string, h boolean, want array<string>")
    assert all(r.got == r.want for r in df.withColumn("got", residues.site_kinds(F.col("r"), F.col("a"), F.col("e"), F.col("h"))).collect())
    assert spark.range(1).select(residues.site_kinds(F.lit("ALA"), F.lit("CA"), F.lit("C"), F.lit(False), backbone=False).alias("k")).first().k == []


def test_vectors(spark):
    r = spark.range(1).select(geometry.unit_vector(F.array(F.lit(3.0), F.lit(0.0), F.lit(4.0))).alias("u"), geometry.unit_vector(F.array(F.lit(0.0), F.lit(0.0), F.lit(1e-9))).alias("z"), geometry.plane_normal(F.array(*[F.array(*map(F.lit, p)) for p in ([0.0, 0, 0], [1.0, 0, 0], [2.0, 0, 0], [0.0, 1, 0])])).alias("n")).first()
    assert r.u == [0.6, 0.0, 0.8] and r.z is None and [abs(x) for x in r.n] == [0, 0, 1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.one_of(st.integers(0, 6), st.just(float("inf")))), max_size=24))
def test_depth_is_peeling(points):
    high, low = np.array([p[0] for p in points], float), np.array([p[1] for p in points], float)
    got = pareto.depth(high, low)
    left, want, k = set(range(len(points))), {}, 1
    while left:
        front = {i for i in left if not any(high[j] >= high[i] and low[j] <= low[i] and (high[j] > high[i] or low[j] < low[i]) for j in left)}
        want |= dict.fromkeys(front, k)
        left, k = left - front, k + 1
    assert got.tolist() == [want[i] for i in range(len(points))]


def test_first_fronts_agree(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(3), float(rng.randrange(9)), float(rng.randrange(9)) if rng.random() > 0.2 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "ord int, g int, a double, b double")
    one = {r.ord for r in pareto.front1_2d(df, ["g"], "a", "b").collect()}
    two = {r.ord for r in pareto.fronts(df, "g", "a", "b").where("pareto_front = 1").collect()}
    assert one == two
    whole = df.where("b is not null")
    assert {r.ord for r in pareto.front1(whole, ["a"], ["b"]).collect()} == {r.ord for r in pareto.front1_2d(whole.withColumn("k", F.lit(1)), ["k"], "a", "b").collect()}


def test_hand_fronts_and_reasons(spark):
    df = spark.createDataFrame([("g", 1, "a", 3.0, 1.0), ("g", 2, "b", 2.0, 2.0), ("g", 3, "c", 2.0, 0.5), ("g", 4, "d", 1.0, 3.0)], "g string, ord int, name string, composite double, docking double")
    out = pareto.fronts(selection.balanced(df, "g", "composite", "docking"), "g", "composite", "docking")
    assert {r.name: r.pareto_front for r in out.collect()} == {"a": 1, "b": 2, "c": 1, "d": 3}
    picks = {r.name: r.selection_reason for r in selection.representatives(out, "g", "name", 1, 1).collect()}
    assert picks == {"a": "best_composite;best_balanced", "c": "best_vina"}


def test_grid_join_is_the_radius_join(spark):
    rng = random.Random(5)
    pts = spark.createDataFrame([(i, *[rng.uniform(-5, 5) for _ in range(3)]) for i in range(300)], "i int, x double, y double, z double")
    anc = spark.createDataFrame([(i, *[rng.uniform(-5, 5) for _ in range(3)]) for i in range(20)], "anchor int, ax double, ay double, az double")
    pairs = lambda d: sorted((r.anchor, r.i) for r in d.select("anchor", "i").collect())
    assert pairs(spatial.radius_join(anc, pts, 1.7)) == pairs(spatial.grid_join(anc, pts, 1.7))
    near = {r.anchor: r.dist for r in spatial.nearest(anc, pts, "anchor", 0.1).collect()}
    want = {r.anchor: r.dist for r in spatial.min_distances(anc, pts, ["anchor"]).collect()}
    assert near.keys() == want.keys() and all(abs(near[k] - want[k]) < 1e-9 for k in want)


def test_sphere_exclusion_is_sequential(spark):
    rng = random.Random(7)
    words = {i: [rng.getrandbits(12)] for i in range(60)}
    df = spark.createDataFrame([(i, w) for i, w in words.items()], "k int, w array<long>")
    pairs = similarity.similarity_join(df, "k", "w", 0.6)
    sim = lambda a, b: bin(a & b).count("1") / max(1, bin(a | b).count("1"))
    near = {i: {j for j in words if j != i and words[i][0] and words[j][0] and sim(words[i][0], words[j][0]) >= 0.6} for i in words}
    assert {(r.a, r.b) for r in pairs.collect()} == {(i, j) for i in near for j in near[i] if i < j}
    order = sorted(words, key=lambda i: (-len(near[i]), i))
    centre: dict[int, int] = {}
    for i in order:
        if i not in centre:
            centre[i] = i
            for j in near[i]:
                centre.setdefault(j, i)
    assert {r.k: r.centroid for r in similarity.sphere_exclusion(df, "k", pairs).collect()} == centre


def test_selection(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 9.0), ("a", 3, 9.0), ("b", 4, None)], "k string, ord int, s double")
    best = {r.k: (r.ord, r.first_ord) for r in selection.keep_best(df, ["k"], "s", "ord").collect()}
    assert best == {"a": (2, 1), "b": (4, 4)}
    assert {r.ord for r in selection.keep_first(df, ["k"], [F.col("ord")]).collect()} == {1, 4}
    draw = lambda: sorted(r.ord for r in selection.seeded_sample(df, ["k"], "ord", 1, 9).collect())
    assert draw() == draw() and len(draw()) == 2


def test_lookup_cache_and_sets(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (3,), (None,)], "key int")
    cache = spark.createDataFrame([(1, "x", "ok"), (2, None, "miss"), (3, None, "error")], "key int, v string, status string")
    assert [r.key for r in enrich.to_fetch(df, cache, "key").collect()] == [3]
    merged = enrich.merged_cache(cache, spark.createDataFrame([(3, "z", "ok")], "key int, v string, status string"), "key")
    assert {r.key: r.v for r in merged.collect()} == {1: "x", 2: None, 3: "z"}
    facts = spark.createDataFrame([("m", "t2", 7.0), ("m", "t1", 7.0), ("m", "t0", 5.0)], "m string, t string, v double")
    assert tuple(enrich.best_activity(facts, "m", "t", "v").first()) == ("m", 7.0, 3, "t1")


def test_sweep(spark):
    rows = [(1, 10, 4, 5.0, -7.0, "ok", 20.0), (2, 10, 8, 9.0, -8.0, "reused", 24.0), (3, 0, 0, 1.0, None, "failed", None)]
    df = spark.createDataFrame(rows, "run_index int, accepted_molecules int, cluster_count int, duration_sec double, vina_mean double, status string, median_heavy_atoms double")
    got = {r.run_index: (r.eligible, r.composite_score) for r in sweep.enriched(df, "vina_mean", 5, 8.0).collect()}
    assert got[3] == (False, None) and abs(got[2][1] - (0.35 + 0.35 + 0.2 * 0.75)) < 1e-9 and abs(got[1][1] - (0.2 * 0.75 + 0.1)) < 1e-9
    assert {r.composite_score for r in sweep.enriched(df.where("run_index = 3"), "vina_mean", 5, 8.0).collect()} == {0.0}
    assert sweep.grid(spark, {"a": [1, 2], "b": [3, 4, 5]}).count() == 6


def test_candidate_loader_and_writers(spark):
    rows = [("d/X_summary.csv", 0, " C ", "1.5", "", ""), ("d/X_summary.csv", 1, "", "2", "", ""), ("d/X_summary.csv", 2, "N", "0.5", "-3", "n2")]
    df = spark.createDataFrame(rows, "_file string, _ord long, SMILES string, composite_grower string, affinity string, id string")
    got = [(r.cavity_id, r.candidate_id, r.composite_value, r.vina_value) for r in tables.candidates(df).orderBy("_ord").collect()]
    assert got == [("X", "row_0001", 1.5, None), ("X", "n2", 0.5, -3.0)]
    both = writers.union_of_columns([spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2, 3)], "b int, a int")])
    assert both.columns == ["a", "b"] and sorted(tuple(r) for r in both.collect()) == [(1, None), (3, 2)]
    merged = spark.range(1).select(writers.merged_props(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("a"), F.lit("9"))).alias("m")).first().m
    assert merged == {"a": "9", "b": "2"}


def test_chemistry_port(spark):
    import pandas as pd

    port = chemistry.Port()
    df = spark.createDataFrame([(" CCO ",), (None,)], "s string")
    assert [r.canonical_smiles for r in port.canonical(df, "s").collect()] == ["CCO", ""]
    port.register("length", lambda s: pd.DataFrame({"n": s.fillna("").str.len()}))
    from pyspark.sql import types as T

    assert [r.n for r in port.apply(df, "length", "s", T.StructType([T.StructField("n", T.LongType())])).collect()] == [5, 0]


def test_beam_expansions(spark):
    states = spark.createDataFrame([("g", 1, i) for i in range(5)], "g string, state int, attach int")
    frags = spark.createDataFrame([(n,) for n in "abcd"], "name string")
    out = beam.expansions(states, frags, ["g", "state"], 2, 3, 11)
    assert out.count() == 6 and sorted(map(tuple, out.collect())) == sorted(map(tuple, beam.expansions(states, frags, ["g", "state"], 2, 3, 11).collect()))


def test_every_atom_makes_the_round_trip(spark, tmp_path):
    from lodestone.plans import catalog

    rows = [(i, [i % 7 / 8, -0.5, 0.25], i % 2) for i in (0, 1, 8_999, 9_000, 10_001, 99_999, 100_000, 1_234_567)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.chain: (r.n, r.sx, r.sy, r.sz) for r in catalog.pdb_roundtrip(spark, str(tmp_path)).collect()}
    for chain in (0, 1):
        own = [v for i, v, c in rows if c == chain]
        assert got[chain] == (len(own), *[round(sum(round(v[k] * 10, 3) for v in own), 3) for k in range(3)])


def test_lookup_keeps_rows_single(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "key int")
    dim = spark.createDataFrame([(1, "b", 1), (1, "a", 2)], "key int, v string, no int")
    assert sorted((r.key, r.v) for r in enrich.lookup(df, dim, "key", ["v"]).collect()) == [(1, "a"), (1, "a"), (2, None)]
    assert {r.v for r in enrich.lookup(df, dim, "key", ["v"], [F.col("no")]).collect()} == {"b", None}


def test_broken_caches_are_empty(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"namespace": "n", "key": "k", "payload": "p", "ts": 1, "status": "ok"}\n{"namespace": "n", "ke')
    assert [(r.key, r.payload) for r in tables.read_cache(spark, str(tmp_path / "c.json")).collect()] == [("k", "p")]
    (tmp_path / "m.json").write_text('{"a": {"cid": 1}, "b": null')
    assert tables.read_json_map(spark, str(tmp_path / "m.json")).count() == 0
    assert tables.read_cache(spark, str(tmp_path / "none")).count() == tables.read_json_map(spark, str(tmp_path / "none")).count() == 0


def test_front_of_many_rows_is_a_join(spark, monkeypatch):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, *[float(rng.randrange(30)) for _ in range(3)]) for i in range(300)], "i int, a double, b double, c double")
    whole = {r.i for r in pareto.front1(df, ["a"], ["b", "c"]).collect()}
    rows = df.collect()
    beats = lambda x, y: x.a >= y.a and x.b <= y.b and x.c <= y.c and (x.a, x.b, x.c) != (y.a, y.b, y.c)
    assert whole == {y.i for y in rows if not any(beats(x, y) for x in rows)}
    monkeypatch.setattr(pareto, "MERGED", 0)
    assert {r.i for r in pareto.front1(df, ["a"], ["b", "c"]).collect()} == whole


def test_members_go_to_the_first_centroid(spark):
    # 4 is next to the centroids 1 and 3; 1 comes first in the search but is settled later
    pairs = [(1, 2), (1, 4), (3, 4), (3, 5), (3, 6), (2, 7), (2, 8), (7, 9), (7, 10), (7, 11)]
    df = spark.createDataFrame([(i,) for i in range(1, 12)], "k int")
    near = {i: {b for a, b in pairs if a == i} | {a for a, b in pairs if b == i} for i in range(1, 12)}
    centre: dict[int, int] = {}
    for i in sorted(near, key=lambda i: (-len(near[i]), i)):
        if i not in centre:
            centre[i] = i
            for j in near[i]:
                centre.setdefault(j, i)
    got = similarity.sphere_exclusion(df, "k", spark.createDataFrame(pairs, "a int, b int"))
    assert {r.k: r.centroid for r in got.collect()} == centre


def test_global_rank_of_empty_and_tied_rows(spark):
    df = spark.range(0, 500, 1, 7).select("id", (F.col("id") % 3).alias("k"))
    ranks = {r.id: r.rn for r in selection.global_rank(df, [F.col("k"), F.desc("id")]).collect()}
    assert [i for i, _ in sorted(ranks.items(), key=lambda x: x[1])] == sorted(range(500), key=lambda i: (i % 3, -i)) and sorted(ranks.values()) == list(range(1, 501))
    assert selection.global_rank(df.where("false"), [F.col("id")]).count() == 0


def test_nearest_without_points(spark):
    anc = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "anchor int, ax double, ay double, az double")
    pts = spark.createDataFrame([(0.0, 0.0, 900.0)], "x double, y double, z double")
    assert spatial.nearest(anc, pts, "anchor", 0.1).first().dist == 900.0
    assert spatial.nearest(anc, pts.where("false"), "anchor", 0.1).first().dist == float("inf")


def test_rare_bit_join_is_all_pairs(spark):
    rng = random.Random(6)
    base = [sorted(rng.sample(range(256), 18)) for _ in range(12)]
    sets = []
    for i in range(120):
        own = set(base[i % 12]) - set(rng.sample(base[i % 12], rng.randrange(5))) | set(rng.sample(range(256), rng.randrange(4))) | {255}
        sets.append(own if i % 17 else set())
    word = lambda s, k: sum((1 << (b % 64)) for b in s if b // 64 == k)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(i, [signed(word(s, k)) for k in range(4)]) for i, s in enumerate(sets)], "k int, w array<long>")
    for cutoff in (0.4, 0.65, 1.0):
        want = {(i, j) for i in range(120) for j in range(i + 1, 120) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= cutoff * len(sets[i] | sets[j]) - 1e-12}
        assert {(r.a, r.b) for r in similarity.similarity_join(df, "k", "w", cutoff).collect()} == want
        rows = df.select("k", "w", similarity.bits(F.col("w")).alias("n")).where("n > 0")
        assert {(r.a, r.b) for r in similarity.count_join(rows, cutoff).collect()} == want
    assert similarity.similarity_join(df.where("false"), "k", "w", 0.5).count() == 0


def test_kept_tables_keep_all_columns(spark):
    from lodestone.session import kept

    df = spark.range(3).select(F.lit(None).alias("void"), "id", F.col("id").cast("string").alias("a b"))
    back = kept(df)
    assert back.dtypes == df.dtypes and sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert kept(df.where("false")).count() == 0
