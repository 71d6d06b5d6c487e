"""Queries of design tables, filters, selection, caches, runs and growth on the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import chemistry, geometry, numeric, text
from lodestone.operators import beam, enrich, selection, similarity, spatial, sweep
from lodestone.session import shared_folder, spread
from lodestone.sinks import writers
from lodestone.sources import fragments, sdf, tables

from .registry import query, table


#: Of points in order of falling composite and rising docking: how many fronts have a docking as low.
BELOW = "len(list_filter(least, lambda t: t <= p.v))"


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# ---- summaries, files, caches


@query(
    """WITH r AS (SELECT p_brand, p_partkey, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 'S' || p_partkey END AS s, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_size::DOUBLE END AS c, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice END AS v, CASE WHEN p_partkey % 4 = 0 THEN 'id' || p_partkey END AS i FROM part),
 k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM r WHERE s IS NOT NULL AND c IS NOT NULL)
 SELECT p_brand AS cavity_id, coalesce(i, 'row_' || CASE WHEN n < 10000 THEN lpad(n::VARCHAR, 4, '0') ELSE n::VARCHAR END) AS candidate_id, s AS smiles, c AS composite_value, v AS vina_value FROM k"""
)
def candidate_summaries(spark, sf):
    """Header names vary; rows without SMILES or with a composite that is no number go; ids count what is kept."""
    n = F.col("p_partkey")
    rows = table(spark, sf, "part").select(
        F.concat(F.lit("runs/"), F.col("p_brand"), F.lit("_summary.csv")).alias("_file"),
        n.alias("_ord"),
        F.when(n % 11 == 0, "  ").otherwise(F.concat(F.lit(" S"), n)).alias("SMILES"),
        F.when(n % 13 == 0, "n/a").otherwise(F.col("p_size").cast("string")).alias("composite_grower"),
        F.when(n % 3 == 0, F.col("p_retailprice").cast("string")).otherwise("").alias("binding_energy"),
        F.when(n % 4 == 0, F.concat(F.lit("id"), n)).otherwise("").alias("source_id"),
        F.lit("3.0").alias("rank"),
    )
    return tables.candidates(rows).select("cavity_id", "candidate_id", F.col("_smiles").alias("smiles"), "composite_value", "vina_value")


@query("SELECT c_custkey::VARCHAR AS key, c_name AS name, round(c_acctbal, 2) AS balance FROM customer", DOUBLE="balance")
def csv_files(spark, sf):
    """Rows written as CSV and read back as text."""
    path = scratch(spark, "csv")
    writers.write_csv(table(spark, sf, "customer").select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("c_acctbal")), path)
    back = tables.read_csv(spark, path)
    return back.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), numeric.lenient_double(F.col("c_acctbal")).alias("balance"))


@query("SELECT c_custkey::VARCHAR AS key, c_name AS name, 'N' || c_nationkey AS annotation FROM customer")
def csv_rewrite(spark, sf):
    """A CSV table annotated in place, from what it held itself."""
    path = scratch(spark, "csv")
    writers.write_csv(table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey"), path)
    old = tables.read_csv(spark, path)
    writers.rewrite_csv(old.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.concat(F.lit("N"), F.col("c_nationkey")).alias("annotation")), path)
    return tables.read_csv(spark, path).select("key", "name", "annotation")


@query("SELECT DISTINCT 'runs/' || p_brand || '_summary.csv' AS path, 'runs/' || p_brand || '_all_filtered.sdf' AS companion FROM part")
def summary_companions(spark, sf):
    files = tables.newest_files(table(spark, sf, "part").select(F.concat(F.lit("runs/"), F.col("p_brand"), F.lit("_summary.csv")).alias("path")))
    return files.select("path", tables.companion(F.col("path"), "_summary.csv", "_all_filtered.sdf").alias("companion"))


@query(
    """WITH c AS (SELECT DISTINCT 'n' || n_nationkey AS pdb_code FROM nation), f AS (SELECT 'N' || n_nationkey AS code, 'd/N' || n_nationkey || '_DU.pdb' AS path, true AS exact FROM nation WHERE n_nationkey % 3 = 0
 UNION ALL SELECT 'N' || n_nationkey, 'd/n' || n_nationkey || '_DU.pdb', false FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'N' || n_nationkey, 'e/n' || n_nationkey || '_du.pdb', false FROM nation WHERE n_nationkey % 4 = 0)
 SELECT pdb_code, coalesce(max(path) FILTER (exact), CASE WHEN count(path) = 1 THEN max(path) END) AS path, count(path) AS n_matches FROM c LEFT JOIN f ON code = upper(pdb_code) GROUP BY pdb_code"""
)
def structure_files(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"))
    name = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p]).alias("path")
    files = n.where("k % 3 = 0").select(name("d/N", F.col("k"), "_DU.pdb")).unionByName(n.where("k % 2 = 0").select(name("d/n", F.col("k"), "_DU.pdb"))).unionByName(n.where("k % 4 = 0").select(name("e/n", F.col("k"), "_du.pdb")))
    return tables.structure_file(n.select(F.concat(F.lit("n"), F.col("k")).alias("pdb_code")), files)


@query(
    """WITH old AS (SELECT c_custkey AS k, 'v' || c_nationkey AS payload, CASE WHEN c_custkey % 5 = 0 THEN 'error' WHEN c_custkey % 7 = 0 THEN 'miss' ELSE 'ok' END AS status FROM customer WHERE c_custkey % 3 <> 0)
 SELECT 'InChI-' || c_custkey AS key, CASE WHEN status IS NULL OR status = 'error' THEN 'fresh' ELSE payload END AS payload, CASE WHEN status IS NULL OR status = 'error' THEN 'ok' ELSE status END AS status FROM customer LEFT JOIN old ON k = c_custkey"""
)
def cache_files(spark, sf):
    """A cache saved, read, asked for what is missing, merged, saved over itself and read again; misses stay, errors are asked for again."""
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", F.concat(F.lit("InChI-"), F.col("c_custkey")).alias("key"))
    status = F.when(F.col("c_custkey") % 5 == 0, "error").when(F.col("c_custkey") % 7 == 0, "miss").otherwise("ok")
    line = lambda payload, state: [F.lit("pubchem").alias("namespace"), "key", payload.alias("payload"), F.lit(0).cast("long").alias("ts"), state.alias("status")]
    path = scratch(spark, "cache")
    assert tables.read_cache(spark, path).isEmpty()
    writers.save_cache(c.where("c_custkey % 3 <> 0").select(*line(F.concat(F.lit("v"), F.col("c_nationkey")), status)), path)
    old = tables.read_cache(spark, path)
    fresh = enrich.to_fetch(c, old, "key").select(*line(F.lit("fresh"), F.lit("ok")))
    writers.save_cache(enrich.merged_cache(old, fresh, "key"), path)
    return tables.read_cache(spark, path).select("key", "payload", "status")


@query("SELECT 'N' || n_nationkey AS key, '{\"cid\":' || n_regionkey || '}' AS payload FROM nation")
def json_maps(spark, sf):
    """A file that holds one JSON object, and one that is broken."""
    path = scratch(spark, "map")
    entry = F.concat(F.lit('"N'), F.col("n_nationkey"), F.lit('":{"cid":'), F.col("n_regionkey"), F.lit("}"))
    n = table(spark, sf, "nation")
    n.agg(F.concat(F.lit("{"), F.array_join(F.collect_list(entry), ","), F.lit("}")).alias("value")).write.text(path)
    n.limit(1).select(F.lit('{"N1": {').alias("value")).write.mode("append").text(path)
    return tables.read_json_map(spark, path)


# ---- molecules as text


def records(spark: SparkSession, sf: str) -> DataFrame:
    """(ord, block): one molecule of two atoms for each part; scores under varying names."""
    n = F.col("p_partkey")
    atom = lambda e, x: F.struct(F.lit(e).alias("elem"), x.alias("x"), F.lit(0.5).alias("y"), F.lit(-1.0).alias("z"))
    atoms = F.when(n % 3 == 0, F.array(atom("C", n % 50 + 0.25), atom("H", F.lit(2.0)))).otherwise(F.array(atom("C", n % 50 + 0.25), atom("O", F.lit(2.0)), atom("N", F.lit(3.0))))
    bonds = F.array(F.struct(F.lit(1).alias("a"), F.lit(2).alias("b"), F.lit(1).alias("order")))
    name = F.when(n % 4 == 0, "vina_score").when(n % 4 == 1, "my_Affinity").when(n % 4 == 2, "note").otherwise("composite")
    prop = lambda k, v: F.struct(k.alias("name"), v.alias("value"))
    props = F.array(prop(name, F.format_string("%.2f", -F.col("p_retailprice"))), prop(F.lit("SMILES"), F.concat(F.lit("C"), n % 500)))
    part = spread(table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice"), "p_partkey")
    return part.select("p_partkey", "p_brand", writers.mol_block(F.concat(F.lit("m"), n), atoms, bonds, props).alias("block"))


def molecule_files(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "sdf")
    writers.write_sdf(records(spark, sf), path)
    return sdf.read_sdf(spark, path)


SCORE = "CASE WHEN p_partkey % 4 = 2 THEN 0.0 ELSE round(-p_retailprice, 2) END"


@query(f"SELECT 'm' || p_partkey AS title, {SCORE} AS score, CASE p_partkey % 4 WHEN 0 THEN 'vina_score' WHEN 1 THEN 'my_Affinity' WHEN 2 THEN 'default_0.0' ELSE 'composite' END AS score_source, (CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 3 END)::INT AS heavy, p_partkey % 50 + 0.25 AS x FROM part", DOUBLE="score x")
def molecule_scores(spark, sf):
    """Molecules written to files, read back, scored by the names of their properties."""
    out = sdf.scored(molecule_files(spark, sf))
    return out.select("title", F.round("score", 2).alias("score"), "score_source", chemistry.heavy_atoms(F.col("atoms")).alias("heavy"), F.get("atoms", 0)["x"].alias("x"))


@query("SELECT p_brand AS file, median(CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 3 END)::DOUBLE AS median_heavy_atoms, round(median(CASE WHEN p_partkey % 3 = 0 THEN 13.019 ELSE 42.017 END), 6) AS median_mol_wt FROM part GROUP BY 1", DOUBLE="median_mol_wt")
def molecule_sizes(spark, sf):
    raw = records(spark, sf).select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("ord"), F.regexp_replace("block", r"\$\$\$\$$", "").alias("block"))
    return sdf.size_metrics(sdf.parse_sdf(raw)).select("file", F.col("median_heavy_atoms").cast("double").alias("median_heavy_atoms"), F.round("median_mol_wt", 6).alias("median_mol_wt"))


@query(
    """WITH i AS (SELECT 'C' || p_partkey % 500 AS smiles, min(p_partkey) AS first FROM part GROUP BY 1), s AS (SELECT DISTINCT 'C' || o_custkey % 700 AS smiles, o_custkey % 700 AS rank FROM orders)
 SELECT smiles, rank, 'm' || first AS title, 'kept' AS picked, CASE WHEN first % 4 = 0 THEN round(-p_retailprice, 2) END AS vina FROM s JOIN i USING (smiles) JOIN part ON p_partkey = first"""
)
def selected_molecules(spark, sf):
    """Selected candidates joined to the first molecule of their key; the records' properties, those of the selection winning."""
    raw = records(spark, sf).select(F.lit("f").alias("file"), F.col("p_partkey").alias("ord"), F.regexp_replace("block", r"\$\$\$\$$", "").alias("block"))
    index = writers.molecule_index(sdf.parse_sdf(raw), chemistry.canonical_key(F.try_element_at("props", F.lit("SMILES"))))
    picked = table(spark, sf, "orders").select((F.col("o_custkey") % 700).alias("rank")).distinct()
    row = F.create_map(F.lit("SMILES"), F.lit("kept"), F.lit("rank"), F.col("rank").cast("string"), F.lit("blank"), F.lit(""))
    chosen = writers.subset(picked.withColumns({"smiles": F.concat(F.lit("C"), F.col("rank")), "row": row}), index, "smiles", "rank")
    back = sdf.parse_sdf(chosen.select(F.col("smiles").alias("file"), F.col("rank").alias("ord"), F.regexp_replace("block", r"\$\$\$\$$", "").alias("block")))
    return back.select(F.col("file").alias("smiles"), F.col("ord").alias("rank"), "title", F.try_element_at("props", F.lit("SMILES")).alias("picked"), sdf.numeric_prop("vina_score").alias("vina"))


RING_ROWS = ", ".join(f"({i}, '{n}', '{s}')" for i, (n, s) in enumerate(fragments.RINGS))


@query(f"WITH ring(i, name, smiles) AS (VALUES {RING_ROWS}) SELECT name, smiles, count(*) AS n FROM part JOIN ring ON i = p_partkey % {len(fragments.RINGS)} GROUP BY ALL")
def fragment_library(spark, sf):
    """The fragments that the lines of all parts name, each once, with how many lines do."""
    line = F.element_at(F.lit([f"{s} {n}" for n, s in fragments.RINGS]), (F.col("p_partkey") % len(fragments.RINGS) + 1).cast("int"))
    return fragments.read_lines(table(spark, sf, "part").select(line.alias("line")), "line").groupBy("name", "smiles").agg(F.count("*").alias("n"))


# ---- design tables

DESIGN = "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE round(p_retailprice / 7, 4) END"


def designs(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_partkey")
    part = table(spark, sf, "part").withColumn("n", n)
    some = {c: F.col("p_size") / 8 for c in ("QED", "SA_score", "clash_frac", "out_frac", "ph4", "interaction", "hbond_score", "pipi_score")}
    return part.select("n", F.concat(F.lit("C"), n).alias("smiles"), F.when(n % 5 != 0, F.col("p_retailprice") / 7).alias("vina_score"), (F.col("p_size") / 3.0).alias("composite"), F.when(n % 2 == 0, 1).alias("pareto_front"), *[v.alias(k) for k, v in some.items()], *[F.lit(1).alias(c) for c in ("hbond_matches", "pipi_matches", "growth_step")], "p_size")


@query(
    """WITH r AS (SELECT *, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS k FROM part)
 SELECT k::VARCHAR AS rank, 'design_' || CASE WHEN k < 10000 THEN lpad(k::VARCHAR, 4, '0') ELSE k::VARCHAR END AS id, 'C' || p_partkey AS smiles, CASE WHEN p_partkey % 2 = 0 THEN '1' ELSE '' END AS pareto_front, round(p_size / 3.0, 4) AS composite, CASE WHEN p_partkey % 5 <> 0 THEN round(p_retailprice / 7, 4) END AS vina_score FROM r""",
    DOUBLE="composite vina_score",
)
def design_table(spark, sf):
    """The design table; blank where there is no value, numbers at four places (read back as numbers here)."""
    rows = designs(spark, sf).withColumn("heavy_atoms", F.col("p_size"))
    out = writers.design_rows(rows, [F.desc("composite"), F.col("n")])
    return out.select("rank", "id", "smiles", "pareto_front", *[numeric.lenient_double(F.col(c)).alias(c) for c in ("composite", "vina_score")])


@query(
    """SELECT p_partkey AS n, 'smiles=C' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN ';pareto_front=1' ELSE '' END || ';growth_step=1' AS props, CASE WHEN p_partkey % 5 <> 0 THEN round(p_retailprice / 7, 4) END AS vina FROM part""",
    DOUBLE="vina",
)
def design_properties(spark, sf):
    """Properties of design records, as text of four places; optional ones that are null are left out."""
    have = F.filter(writers.design_props(designs(spark, sf)), lambda p: p["value"].isNotNull())
    rows = designs(spark, sf).select("n", have.alias("p"))
    named = F.filter("p", lambda p: p["name"].isin("smiles", "pareto_front", "growth_step"))
    vina = F.get(F.filter("p", lambda p: p["name"] == "vina_score"), 0)["value"]
    return rows.select("n", F.array_join(F.transform(named, lambda p: F.concat_ws("=", p["name"], p["value"])), ";").alias("props"), vina.cast("double").alias("vina"))


@query("SELECT c_custkey::VARCHAR AS c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS c_name, '' AS absent FROM customer")
def projected_table(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("c_name"), "c_acctbal")
    return writers.projected(c, ["c_custkey", "c_name", "absent"])


@query("SELECT n_nationkey, 'a=' || n_name || ';b=2;c=' || n_regionkey AS props FROM nation")
def merged_properties(spark, sf):
    props = writers.merged_props(F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.lit("2")), F.create_map(F.lit("a"), F.col("n_name"), F.lit("c"), F.col("n_regionkey").cast("string")))
    pairs = F.array_sort(F.map_entries(props))
    return table(spark, sf, "nation").select("n_nationkey", F.array_join(F.transform(pairs, lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("props"))


@query(
    """SELECT '# Sweep Analysis Summary' || chr(10) || chr(10) || '- Total runs in summary: 25' || chr(10) || chr(10) || '## Pareto Front' || chr(10) || chr(10) || '| r_regionkey | r_name |' || chr(10) || '| --- | --- |' || chr(10) || (SELECT string_agg('| ' || r_regionkey || ' | ' || r_name || ' |', chr(10) ORDER BY r_regionkey) FROM region)
 || chr(10) || chr(10) || '## Ranked Shortlist' || chr(10) || chr(10) || 'No Ranked Shortlist rows.' AS report"""
)
def sweep_report(spark, sf):
    rows = table(spark, sf, "region").orderBy("r_regionkey")
    return spark.createDataFrame([(writers.sweep_report({"Total runs in summary": 25}, rows, rows.where("false"), ["r_regionkey", "r_name"]),)], "report string")


# ---- scores, filters


@query(
    """SELECT l_orderkey, l_linenumber, round(CASE WHEN l_partkey % 3 = 0 THEN l_tax * 10 ELSE round(0.40 * l_discount * 10 + 0.35 * greatest(0.0, (6.5 - l_linenumber) / 5.5), 4) END, 6) AS composite,
 round(l_tax + 0.2 * CASE WHEN l_partkey % 2 = 0 THEN l_discount ELSE 0 END, 6) AS extended, 'ns' || l_linenumber || '_bw' || l_partkey % 5 AS name FROM lineitem""",
    DOUBLE="composite extended",
)
def composite_variants(spark, sf):
    c = F.col
    stored = F.when(c("l_partkey") % 3 == 0, (c("l_tax") * 10).cast("string")).when(c("l_partkey") % 3 == 1, "n/a")
    extended = numeric.composite_extended(c("l_tax"), F.when(c("l_partkey") % 2 == 0, c("l_discount")), 0.2, c("l_quantity"), 0.0)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(numeric.composite_fallback(stored, c("l_discount") * 10, c("l_linenumber")), 6).alias("composite"), F.round(extended, 6).alias("extended"), text.run_name(("ns", c("l_linenumber")), ("bw", c("l_partkey") % 5)).alias("name"))


LIMITS = """l AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS qed, l_linenumber::DOUBLE AS sa, l_tax * 5 AS clash, l_discount * 4 AS outside, l_quantity::INT AS heavy, l_returnflag = 'R' AS hit FROM lineitem)"""


@query(
    f"""WITH {LIMITS} SELECT l_orderkey, l_linenumber, hit OR (qed >= 0.4 AND sa <= 4) AS passes, true AS unfiltered, clash <= 0.30 AND outside <= 0.25 AS placed, heavy BETWEEN 15 AND 30 AND qed >= 0.4 AND sa <= 4 AS accepted FROM l"""
)
def design_filters(spark, sf):
    c = F.col
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (c("l_discount") * 10).alias("qed"), c("l_linenumber").cast("double").alias("sa"), (c("l_tax") * 5).alias("clash"), (c("l_discount") * 4).alias("outside"), c("l_quantity").cast("int").alias("heavy"), (c("l_returnflag") == "R").alias("hit"))
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        selection.score_filter(c("qed"), c("sa"), 0.4, 4.0, c("hit")).alias("passes"),
        selection.score_filter(c("qed"), c("sa"), 0.0, 9.9).alias("unfiltered"),
        selection.geometry_ok(c("clash"), c("outside")).alias("placed"),
        selection.acceptable(c("heavy"), c("qed"), c("sa"), (15, 30), 0.4, 4.0).alias("accepted"),
    )


@query(
    """WITH d AS (SELECT l_quantity * 12 AS mw, l_discount * 60 AS logp, l_tax >= 0.02 AS scored, l_suppkey % 13 AS rot, l_tax * 2000 AS tpsa, l_linenumber, l_partkey % 12 AS hba FROM lineitem),
 f AS (SELECT *, CASE WHEN NOT (mw <= 500 AND logp <= 5 AND l_linenumber <= 5 AND hba <= 10) THEN 'lipinski' WHEN NOT (rot <= 10 AND tpsa <= 140) THEN 'veber' END AS first_fail FROM d)
 SELECT count(*) AS n_loaded, count_if(scored) AS n_score, count_if(scored AND first_fail IS NULL) AS n_hard, count_if(first_fail = 'lipinski') AS failed_lipinski, count_if(first_fail = 'veber') AS failed_veber FROM f""",
    BIGINT="n_score n_hard failed_lipinski failed_veber",
)
def stage_counters(spark, sf):
    c = F.col
    rules = [("lipinski", ~chemistry.lipinski(c("l_quantity") * 12, c("l_discount") * 60, c("l_linenumber"), c("l_partkey") % 12)), ("veber", ~chemistry.veber(c("l_suppkey") % 13, c("l_tax") * 2000))]
    rows = selection.first_fail(table(spark, sf, "lineitem"), rules)
    return selection.stage_counts(rows, [("loaded", F.lit(True)), ("score", c("l_tax") >= 0.02), ("hard", c("first_fail").isNull())], ["lipinski", "veber"])


@query(
    """WITH j AS (SELECT o_orderpriority AS batch, o_custkey AS structure, CASE WHEN o_orderstatus <> 'P' THEN CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END END AS rc FROM orders),
 p AS (SELECT batch, structure, count(rc) AS a, count_if(rc <> 0) AS f FROM j GROUP BY ALL) SELECT batch, count(*) AS n_scanned, sum(a)::BIGINT AS n_attempted, sum(f)::BIGINT AS n_failed, count_if(a = 0) AS n_skipped FROM p GROUP BY batch""",
    BIGINT="n_skipped",
)
def job_counters(spark, sf):
    code = F.when(F.col("o_orderstatus") != "P", F.when(F.col("o_orderkey") % 4 == 0, 1).otherwise(0))
    jobs = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("batch"), F.col("o_custkey").alias("structure"), code.alias("rc"))
    return selection.job_counts(jobs, ["batch"], "rc", "structure")


@query("SELECT o_orderkey, o_orderstatus IN ('F', 'O') OR o_custkey % 4 = 0 AS hit, CASE WHEN o_custkey % 3 = 0 THEN o_custkey % 10 ELSE o_orderkey % 10 END = 9 AS sure FROM orders")
def hit_tests(spark, sf):
    flag = F.when(F.col("o_orderstatus") == "F", "YES").when(F.col("o_orderstatus") == "O", "1").otherwise("no")
    first = F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey") % 10).cast("string")
    cid = F.when(F.col("o_custkey") % 4 == 0, "cid").otherwise("  ")
    return table(spark, sf, "orders").select("o_orderkey", enrich.is_hit(flag, cid).alias("hit"), enrich.confident(first, (F.col("o_orderkey") % 10).cast("string")).alias("sure"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN -round(value, 2) WHEN 1 THEN round(value, 2) END AS score FROM events", DOUBLE="score")
def docking_logs(spark, sf):
    n = F.col("event_id") % 3
    log = F.when(n == 0, F.format_string("mode\nEstimated Free Energy of Binding   : -%.2f (kcal/mol)\nAffinity: 1.0", "value")).when(n == 1, F.format_string("Affinity: %.2f", "value")).otherwise("failed")
    rows = table(spark, sf, "events").select("event_id", text.docking_score(log).alias("score"))
    return rows.withColumn("score", F.when(F.col("score") == 0, F.lit(0.0)).otherwise(F.col("score")))


@query("SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN '' ELSE 'C' || p_partkey % 100 END AS canonical_smiles FROM part")
def canonical_keys(spark, sf):
    """Without a toolkit the key is the trimmed text; blank and null give a blank one."""
    n = F.col("p_partkey")
    smiles = F.when(n % 6 == 0, F.when(n % 12 == 0, "  ")).otherwise(F.concat(F.lit(" C"), n % 100, F.lit(" ")))
    return chemistry.PORT.canonical(table(spark, sf, "part").select("p_partkey", smiles.alias("smiles")), "smiles").select("p_partkey", "canonical_smiles")


@query(
    """WITH k AS (SELECT c_custkey AS ord, CASE WHEN c_custkey % 3 = 0 THEN 'SM-' || c_nationkey || c_mktsegment ELSE 'IK-' || c_nationkey END AS key FROM customer)
 SELECT key, min(ord) AS ord FROM k GROUP BY key"""
)
def pair_dedup(spark, sf):
    """Keep the first row of each key, which falls back from the InChIKey to the SMILES where that is blank or missing."""
    c = table(spark, sf, "customer")
    n = F.col("c_custkey")
    inchikey = F.when(n % 3 != 0, F.concat(F.lit("IK-"), F.col("c_nationkey"))).when(n % 2 == 0, F.lit("  "))
    rows = c.select(n.alias("ord"), inchikey.alias("InChIKey"), F.concat(F.lit("SM-"), "c_nationkey", "c_mktsegment").alias("SMILES"))
    return selection.keep_first(rows.withColumn("key", selection.identity_key(F.col("InChIKey"), F.col("SMILES"))), ["key"], [F.col("ord")]).select("key", "ord")


# ---- order, clusters


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_custkey % 7 = 0 DESC, round(c_acctbal, 2) DESC, c_custkey) AS priority FROM customer")
def hit_priority(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 7 == 0).alias("hit"), F.round("c_acctbal", 2).alias("composite"))
    return selection.priority(c, "hit", "composite", "c_custkey").select("c_custkey", "priority")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY round(o_totalprice, 2) DESC, o_orderkey) AS rn FROM orders QUALIFY rn > 2 * (SELECT count(*) // 5 FROM orders) AND rn <= 3 * (SELECT count(*) // 5 FROM orders)")
def late_slice(spark, sf):
    """The third fifth of an order: ranks come from sorted ranges and their counts, beyond the head that one task may sort."""
    o = table(spark, sf, "orders").select("o_orderkey", F.round("o_totalprice", 2).alias("price"))
    fifth = o.count() // 5
    ranked = selection.global_rank(o, [F.desc("price"), F.col("o_orderkey")])
    return ranked.where((F.col("rn") > 2 * fifth) & (F.col("rn") <= 3 * fifth)).select("o_orderkey", "rn")


@query("SELECT c_custkey, c_nationkey AS cluster_id, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 7 = 0 DESC, round(c_acctbal, 2) DESC, c_custkey) = 1)::INT AS is_centroid FROM customer")
def cluster_representatives(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("cluster_id"), (F.col("c_custkey") % 7 == 0).alias("hit"), F.round("c_acctbal", 2).alias("composite"))
    return similarity.cluster_representatives(c, "cluster_id", "hit", "composite", "c_custkey").select("c_custkey", "cluster_id", "is_centroid")


@query("SELECT count(DISTINCT c_nationkey) AS clusters FROM customer UNION ALL SELECT 0")
def cluster_counts(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("centroid"))
    return similarity.cluster_count(c).unionByName(similarity.cluster_count(c.where("false")))


def _draw(seed: int, *columns: str) -> str:
    return "md5('" + str(seed) + "' || " + " || ".join(f"chr(0) || {c}" for c in columns) + ")"


@query(f"SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY {_draw(7, 'c_nationkey', 'c_custkey')}, c_custkey) AS n FROM customer) WHERE n <= 5")
def seeded_draws(spark, sf):
    return selection.seeded_sample(table(spark, sf, "customer").select("c_nationkey", "c_custkey"), ["c_nationkey"], "c_custkey", 5, 7)


# ---- growth, runs


@query(
    f"""WITH s AS (SELECT s_suppkey AS state, unnest([0, 1, 2, 3]) AS attach FROM supplier), spots AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY {_draw(11, "state", "attach")}, attach) AS n FROM s) WHERE n <= 2)
 SELECT state, attach, name FROM (SELECT state, attach, r_name AS name, row_number() OVER (PARTITION BY state, attach ORDER BY {_draw(12, "state", "attach", "r_name")}, r_name) AS n FROM spots, region) WHERE n <= 3""",
    INT="attach",
)
def growth_expansions(spark, sf):
    states = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("state"), F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("attach"))
    return beam.expansions(states, table(spark, sf, "region").select(F.col("r_name").alias("name")), ["state"], 2, 3, 11).select("state", "attach", "name")


@query("SELECT s_suppkey AS anchor, 'C' AS smiles, 0 AS attach, s_nationkey::DOUBLE AS x FROM supplier WHERE s_suppkey % 2 = 0", INT="attach")
def growth_seeds(spark, sf):
    """Seed states at each anchor, and the positions at which they grow; a saturated atom has none."""
    a = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("anchor"), F.col("s_nationkey").cast("double").alias("ax"), F.lit(0.0).alias("ay"), F.lit(1.0).alias("az"))
    states = beam.seeds(a, ["anchor"])
    full = F.transform("atoms", lambda s: s.withField("free_h", F.when(F.col("anchor") % 2 == 0, s["free_h"]).otherwise(0)))
    return beam.extendable("atoms", states.withColumn("atoms", full)).select("anchor", "smiles", "attach", F.get("atoms", 0)["x"].alias("x"))


@query(
    """SELECT s_suppkey AS state, attach, name, (2 + 1 + CASE WHEN name = 'carbonyl' THEN 1 ELSE 0 END)::INT AS n_atoms, (1 + 1 + CASE WHEN name = 'carbonyl' THEN 1 ELSE 0 END)::INT AS n_bonds,
 CASE attach WHEN 0 THEN s_suppkey % 4 ELSE 1 END - (CASE WHEN name = 'alkene' THEN 2 ELSE 1 END) AS left_h FROM supplier, (SELECT unnest([0, 1]) AS attach), (SELECT unnest(['methyl', 'alkene', 'carbonyl']) AS name)
 WHERE CASE attach WHEN 0 THEN s_suppkey % 4 ELSE 1 END >= CASE WHEN name = 'alkene' THEN 2 ELSE 1 END""",
    INT="left_h attach",
)
def growth_atoms(spark, sf):
    """Single atoms, double bonds and atoms with an extra one, grown where the valence allows it."""
    atom = lambda e, h: F.struct(F.lit(e).alias("elem"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), h.cast("int").alias("free_h"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("state"), F.array(atom("C", F.col("s_suppkey") % 4), atom("N", F.lit(1))).alias("atoms"), F.expr("array(named_struct('a', 1, 'b', 2, 'order', 1))").alias("bonds"))
    choices = spark.createDataFrame([("methyl", "C", 1, 3, []), ("alkene", "C", 2, 2, []), ("carbonyl", "C", 1, 1, [("O", 2, 0)])], "name string, elem string, order int, free_h int, extras array<struct<elem:string,order:int,free_h:int>>")
    states = s.withColumn("attach", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("name", F.explode(F.array(*[F.lit(n) for n in ("methyl", "alkene", "carbonyl")])))
    out = chemistry.grown(states, choices)
    return out.select("state", "attach", "name", F.size("atoms").alias("n_atoms"), F.size("bonds").alias("n_bonds"), F.get("atoms", F.col("attach"))["free_h"].alias("left_h"))


@query(
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS qed, l_linenumber::DOUBLE AS sa, CASE WHEN l_partkey % 17 <> 0 THEN l_tax * 5 END AS clash, l_discount * 4 AS outside FROM lineitem)
 SELECT l_orderkey, l_linenumber, round(0.40 * qed + 0.35 * greatest(0.0, (6.5 - sa) / 5.5) + 0.25 * (1 - clash) - 0.30 * outside + 0.5 * 0.25, 6) AS composite FROM p WHERE clash <= 0.30 AND outside <= 0.25"""
)
def growth_states(spark, sf):
    c = F.col
    poses = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (c("l_discount") * 10).alias("QED"), c("l_linenumber").cast("double").alias("SA_score"), F.when(c("l_partkey") % 17 != 0, c("l_tax") * 5).alias("clash_frac"), (c("l_discount") * 4).alias("out_frac"), F.lit(0.25).alias("ph4"), F.lit(None).cast("double").alias("interaction"))
    return beam.made(poses, ph4_weight=0.5, interaction_weight=0.1).select("l_orderkey", "l_linenumber", F.round("composite", 6).alias("composite"))


@query(
    f"""WITH RECURSIVE s AS (SELECT c_nationkey AS g, c_custkey AS ord, round(c_acctbal, 2) AS v, c_custkey % 100 AS c FROM customer), pts AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY c DESC, v) AS i FROM (SELECT DISTINCT g, c, v FROM s)),
 step(g, i, least, front) AS (SELECT g, i, [v], 1 FROM pts WHERE i = 1 UNION ALL SELECT p.g, p.i, list_concat(list_append(least[1:{BELOW}], p.v), least[{BELOW} + 2:]), {BELOW} + 1 FROM step JOIN pts p ON p.g = step.g AND p.i = step.i + 1), n AS (SELECT *, count_if(v < 0) OVER (PARTITION BY g) AS neg, row_number() OVER (PARTITION BY g ORDER BY v, c DESC, ord) AS r FROM s)
 SELECT 'composite' AS mode, ord, row_number() OVER (PARTITION BY g ORDER BY c DESC, ord) AS rank FROM s UNION ALL SELECT 'beam', ord, row_number() OVER (PARTITION BY g ORDER BY r) FROM n WHERE neg > 0 AND v < 0 OR neg = 0 AND r <= 10
 UNION ALL SELECT 'final', ord, row_number() OVER (PARTITION BY g ORDER BY front, c DESC, v, ord) FROM (SELECT s.*, step.front FROM s JOIN pts p ON p.g = s.g AND p.c = s.c AND p.v = s.v JOIN step ON step.g = p.g AND step.i = p.i)""",
    INT="rank",
)
def rank_dispatch(spark, sf):
    """By composite; within a beam by docking; at the end by front."""
    s = table(spark, sf, "customer").select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("ord"), F.round("c_acctbal", 2).alias("v"), (F.col("c_custkey") % 100).alias("composite"))
    mode = lambda name, df: df.select(F.lit(name).alias("mode"), "ord", "rank")
    return mode("composite", beam.ranked(s, "g", None, True)).unionByName(mode("beam", beam.ranked(s, "g", "v", True))).unionByName(mode("final", beam.ranked(s, "g", "v", False)))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 1.5 WHEN o_custkey % 5 = 0 THEN NULL ELSE o_custkey / 10.0 END AS score, CASE WHEN o_orderkey % 3 <> 0 AND o_custkey % 5 = 0 THEN 'failed' END AS error,
 row_number() OVER (PARTITION BY o_orderpriority ORDER BY score NULLS LAST, o_orderkey) AS rank FROM orders""",
    INT="rank",
    DOUBLE="score",
)
def bulk_rescoring(spark, sf):
    """Only unscored rows take a new score, once for each key however many share it; failures stay null, with their error."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.when(F.col("o_orderkey") % 3 == 0, 1.5).alias("score"))
    ok = F.col("o_custkey") % 5 != 0
    fresh = enrich.to_fetch(rows.where("score is null"), rows.where("false"), "o_custkey", None).select("o_custkey", F.when(ok, F.col("o_custkey") / 10.0).alias("score"), F.when(~ok, "failed").alias("error"))
    out = enrich.rescored(rows, fresh.unionByName(fresh), "o_custkey", "score")
    return spatial.grouped_rank(out, ["o_orderpriority"], [F.asc_nulls_last("score"), F.col("o_orderkey")], "rank").select("o_orderkey", "score", "error", "rank")


@query(
    """SELECT s_suppkey AS pdb_code, i AS du_index FROM (SELECT s_suppkey, unnest(range(0, s_nationkey)) AS i FROM supplier) WHERE NOT (s_suppkey % 4 = 0 OR s_suppkey % 4 = 1 AND i = 0)""",
    INT="du_index",
)
def pending_jobs(spark, sf):
    """Every structure with every index, without those that are finished; failed ones are run again."""
    planned = sweep.tasks(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("pdb_code"), F.col("s_nationkey").alias("n")), "n").select("pdb_code", "du_index")
    state = F.when(F.col("pdb_code") % 4 == 0, "ok").when((F.col("pdb_code") % 4 == 1) & (F.col("du_index") == 0), "reused").otherwise("failed")
    return sweep.pending(planned, planned.withColumn("status", state), ["pdb_code", "du_index"])


@query(
    """WITH m AS (SELECT 'f' || p_partkey % 40 AS f, median(p_size) AS h FROM part GROUP BY 1) SELECT s_suppkey AS run_index, s_nationkey / 30.0 AS x, s_acctbal AS y, s_nationkey AS size, h AS colour, 'ns4/ne8/bw' || s_suppkey % 3 || '/ma2/mf' || s_nationkey AS label
 FROM supplier LEFT JOIN m ON f = 'f' || s_suppkey % 50 WHERE s_suppkey % 9 <> 0""",
    DOUBLE="x",
)
def sweep_bubbles(spark, sf):
    """Runs joined to the sizes of their molecule files, as the rows behind a bubble chart."""
    s = table(spark, sf, "supplier")
    runs = s.select(F.col("s_suppkey").alias("run_index"), (F.col("s_nationkey") / 30.0).alias("diversity_ratio"), F.when(F.col("s_suppkey") % 9 != 0, F.col("s_acctbal")).alias("vina_mean"), F.col("s_nationkey").alias("accepted_molecules"), F.concat(F.lit("f"), F.col("s_suppkey") % 50).alias("sdf_path"), F.lit(4).alias("n_steps"), F.lit(8).alias("n_embed_attempts"), (F.col("s_suppkey") % 3).alias("beam_width"), F.lit(2).alias("max_attach"), F.col("s_nationkey").alias("max_frags"))
    metrics = table(spark, sf, "part").groupBy(F.concat(F.lit("f"), F.col("p_partkey") % 40).alias("file")).agg(F.median("p_size").alias("median_heavy_atoms"))
    return sweep.bubbles(sweep.with_sizes(runs, metrics), "vina_mean")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN round(c_acctbal / 7, 4) END AS balance, CASE WHEN c_custkey % 4 = 0 THEN 'yes' ELSE 'no' END AS pareto_front, c_custkey % 3 = 0 AS blank FROM customer")
def formatted_rows(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal") / 7).alias("balance"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey") % 4 == 0).alias("pareto_front"))
    out = sweep.formatted(c, ["balance"])
    return out.select("c_custkey", numeric.lenient_double(F.col("balance")).alias("balance"), "pareto_front", (F.col("balance") == "").alias("blank"))


@query("SELECT n_nationkey AS seed, true AS proper FROM nation")
def seeded_rotations(spark, sf):
    """Rotations drawn by seeds keep lengths and are the same in every draw."""
    turn = lambda: geometry.rotation(geometry.seeded(F.col("n_nationkey")))
    point = F.array(F.array(F.lit(3.0), F.lit(0.0), F.lit(4.0)))
    rows = table(spark, sf, "nation").select(F.col("n_nationkey").alias("seed"), F.get(geometry.rotated(point, turn()), 0).alias("p"), F.get(geometry.rotated(point, turn()), 0).alias("q"))
    return rows.select("seed", ((F.abs(geometry.dot(F.col("p"), F.col("p")) - 25) < 1e-9) & (F.col("p") == F.col("q"))).alias("proper"))


def arriving(df: DataFrame, name: str, key: str) -> DataFrame:
    """``df`` written as files dealt by ``key``, and their stream: four batches, however many files there are; as many as cores in each."""
    from lodestone.streaming import front

    spark, folder = df.sparkSession, f"{scratch(df.sparkSession, name)}/in"
    df.repartition(4 * spark.sparkContext.defaultParallelism, key).write.parquet(folder)
    n_files = len(spark.read.schema(df.schema).parquet(folder).inputFiles())
    return front.files(spark, folder, df.schema, -(-n_files // 4))


@query("SELECT user_id || ':' || event_type AS key, count(*) AS n, min(ts)::TIMESTAMP AS first, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def stream_first_seen(spark, sf):
    """Every event goes through a stream of several files; each key's first event and how often it came are kept as state."""
    from lodestone.streaming import front

    events = table(spark, sf, "events").select(F.concat("user_id", F.lit(":"), "event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    seen = front.first_by_key(arriving(events, "seen", "event_id"), "key", "ts", "event_id")
    return front.collected(seen, scratch(spark, "seen-out"), ["key"], "n").select("key", "n", "first", "event_id")


@query(
    """WITH e AS (SELECT event_type AS kind, value, (epoch_us(ts) % 1000003)::DOUBLE AS cost, event_id FROM events)
 SELECT a.kind, a.event_id, a.value, a.cost FROM e a WHERE a.value IS NOT NULL AND NOT EXISTS (SELECT 1 FROM e b WHERE b.kind = a.kind AND b.value >= a.value AND b.cost <= a.cost AND (b.value > a.value OR b.cost < a.cost))"""
)
def stream_fronts(spark, sf):
    """The first front of each kind of event, kept as state while files arrive: changes only, not whole fronts, leave a batch."""
    from lodestone.streaming import front

    cost = (F.unix_micros(F.col("ts").cast("timestamp")) % 1000003).cast("double")
    events = table(spark, sf, "events").where("value is not null").select(F.col("event_type").alias("kind"), "value", cost.alias("cost"), "event_id")
    changes = front.front_by_key(arriving(events, "fronts", "event_id"), "kind", "value", "cost", "event_id")
    return front.standing(changes, scratch(spark, "fronts-out"), "kind", "event_id").select("kind", "event_id", "value", "cost")
