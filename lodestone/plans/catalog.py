"""Registered queries on the driver's tables, each with the SQL that gives the same rows.

Stand-ins: ``embeddings`` are atoms (first three components, scaled, as coordinates;
label as chain; four rows a residue), every 50th an anchor; ``part`` are candidates
(brand as cavity, size as composite, price as docking score, some nulls); ``lineitem``
by supplier are runs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import chemistry, numeric, text
from lodestone.operators import beam, enrich, environment, pareto, selection, similarity, spatial, sweep
from lodestone.session import shared_folder
from lodestone.sinks import writers
from lodestone.sources import pdb, sdf

from .registry import ORACLES, QUERIES, query, table

SCALE = 10.0
RADIUS = 2.0
ATOMS = "atoms AS (SELECT vec_id AS ord, label AS chain, vec_id // 4 AS resid, embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y, embedding[3]::DOUBLE * 10 AS z FROM embeddings)"
ANCHORS = "anchors AS (SELECT ord AS anchor, chain AS kind, x AS ax, y AS ay, z AS az FROM atoms WHERE ord % 50 = 0)"
D2 = "(ax - x) * (ax - x) + (ay - y) * (ay - y) + (az - z) * (az - z)"
NEAR = f"near AS (SELECT anchor, kind, atoms.*, {D2} AS d2 FROM anchors JOIN atoms ON {D2} <= 4.0)"


def atoms(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda i: F.get("embedding", i).cast("double") * SCALE
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("ord"), F.col("label").alias("chain"), F.floor(F.col("vec_id") / 4).alias("resid"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


def anchors(spark: SparkSession, sf: str) -> DataFrame:
    return atoms(spark, sf).where("ord % 50 = 0").select(F.col("ord").alias("anchor"), F.col("chain").alias("kind"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az"))


def near(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.grid_join(anchors(spark, sf), atoms(spark, sf), RADIUS)


def flags(c: str = "chain") -> dict[str, Column]:
    x = F.col(c)
    return {"is_pos": x % 5 == 0, "is_neg": x % 5 == 1, "is_polar": x % 2 == 0, "is_apolar": x % 2 == 1, "is_aromatic": x % 3 == 0}


RES = f"WITH {ATOMS}, {ANCHORS}, {NEAR}, res AS (SELECT anchor, resid, min(d2) AS min_d2, min(chain) AS chain FROM near GROUP BY anchor, resid)"
COUNTS = """count(*) AS n_residues, count_if(chain % 5 = 0) AS n_pos, count_if(chain % 5 = 1) AS n_neg,
 CASE WHEN count_if(chain % 5 = 0) + count_if(chain % 5 = 1) > 0 THEN round(count_if(chain % 5 = 0) / (count_if(chain % 5 = 0) + count_if(chain % 5 = 1)), 4) END AS pos_over_posneg,
 count_if(chain % 2 = 0) AS n_polar, count_if(chain % 2 = 1) AS n_apolar, round(count_if(chain % 2 = 0) / count(*), 4) AS polar_over_polarapolar,
 count_if(chain % 3 = 0) AS n_aromatic, count(*) - count_if(chain % 3 = 0) AS n_nonaromatic, round(count_if(chain % 3 = 0) / count(*), 4) AS aromatic_fraction"""


def nearby_residues(spark: SparkSession, sf: str) -> DataFrame:
    pairs = spatial.block_join(anchors(spark, sf), atoms(spark, sf), RADIUS, ["anchor"], ["resid"])
    return pairs.groupBy("__a", "__p", "anchor", "resid").agg(F.min("d2").alias("min_d2"), F.min("chain").alias("chain")).drop("__a", "__p")


@query(f"WITH {ATOMS}, {ANCHORS} SELECT anchor, count(ord) AS n, round(min({D2}), 6) AS min_d2 FROM anchors JOIN atoms ON {D2} <= 4.0 GROUP BY anchor")
def radius_join_counts(spark, sf):
    pairs = spatial.radius_join(anchors(spark, sf), atoms(spark, sf), RADIUS)
    return pairs.groupBy("anchor").agg(F.count("*").alias("n"), F.round(F.min("d2"), 6).alias("min_d2"))


@query(ORACLES["radius_join_counts"])
def radius_join_grid(spark, sf):
    return near(spark, sf).groupBy("anchor").agg(F.count("*").alias("n"), F.round(F.min("d2"), 6).alias("min_d2"))


@query(f"{RES} SELECT anchor, {COUNTS} FROM res GROUP BY anchor", BIGINT="n_pos n_neg n_polar n_apolar n_aromatic n_nonaromatic")
def residue_env_metrics(spark, sf):
    return environment.profile(nearby_residues(spark, sf), ["anchor"], flags())


@query(f"{RES} SELECT anchor, chain, {COUNTS} FROM res GROUP BY GROUPING SETS ((anchor), (anchor, chain))", BIGINT="n_pos n_neg n_polar n_apolar n_aromatic n_nonaromatic")
def residue_env_by_chain(spark, sf):
    return environment.profile_by_chain(nearby_residues(spark, sf), "anchor", "chain", flags())


@query(f"{RES}, n AS (SELECT anchor, chain, count(*) AS c FROM res GROUP BY 1, 2) SELECT anchor, string_agg(chain || ':' || c, ';' ORDER BY c DESC, chain::VARCHAR) AS residue_hist FROM n GROUP BY anchor")
def residue_histogram(spark, sf):
    return environment.histogram(nearby_residues(spark, sf), ["anchor"], "chain")


@query(f"""{RES}, c AS (SELECT anchor, chain, count(*) AS n_residues, count_if(chain % 5 = 0) AS n_pos FROM res GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY n_residues DESC, chain) AS rn FROM c)
 SELECT anchor, max(CASE WHEN rn = 1 THEN chain END) AS chain1_id, max(CASE WHEN rn = 1 THEN n_residues END) AS chain1_n_residues, max(CASE WHEN rn = 1 THEN n_pos END) AS chain1_n_pos,
 max(CASE WHEN rn = 2 THEN chain END) AS chain2_id, max(CASE WHEN rn = 2 THEN n_residues END) AS chain2_n_residues, max(CASE WHEN rn = 2 THEN n_pos END) AS chain2_n_pos FROM r WHERE rn <= 2 GROUP BY anchor""", BIGINT="chain1_n_pos chain2_n_pos")
def top2_chains_wide(spark, sf):
    by_chain = environment.profile(nearby_residues(spark, sf), ["anchor", "chain"], flags())
    return environment.top_chains(by_chain, "anchor", "chain", ["n_residues", "n_pos"])


@query(f"""{RES} SELECT anchor, count_if(chain % 2 = 0) AS n_even, count_if(chain % 2 = 1) AS n_odd, count_if(chain % 2 = 0 AND resid % 3 = 0) AS apolar_even, count_if(chain % 2 = 1 AND resid % 3 <> 0) AS polar_odd, count_if(chain % 2 = 0 AND resid % 5 = 0) AS aromatic_even,
 CASE WHEN count_if(chain % 2 = 1) > 0 THEN round(count_if(chain % 2 = 0) / count_if(chain % 2 = 1), 3) END AS ratio,
 CASE WHEN count_if(chain % 2 = 1 AND resid % 7 = 0) > 0 THEN round(count_if(chain % 2 = 0 AND resid % 7 = 0) / count_if(chain % 2 = 1 AND resid % 7 = 0), 3) END AS ratio_aliphatic,
 round(avg(CASE WHEN chain % 2 = 0 THEN min_d2 END), 2) AS mean_even, round(avg(CASE WHEN chain % 2 = 1 THEN min_d2 END), 2) AS mean_odd FROM res GROUP BY anchor""", BIGINT="n_even n_odd apolar_even polar_odd aromatic_even")
def interface_two_roles(spark, sf):
    res = nearby_residues(spark, sf).withColumn("role", F.when(F.col("chain") % 2 == 0, "even").otherwise("odd"))
    out = environment.two_roles(res, ["anchor"], "role", "even", "odd", {"is_apolar": F.col("resid") % 3 == 0, "is_polar": F.col("resid") % 3 != 0, "is_aromatic": F.col("resid") % 5 == 0, "is_aliphatic": F.col("resid") % 7 == 0}, "min_d2")
    return out.select("anchor", F.col("N_even").alias("n_even"), F.col("N_odd").alias("n_odd"), "apolar_even", "polar_odd", "aromatic_even", F.col("ratio_N").alias("ratio"), "ratio_aliphatic", F.col("mean_bfactor_even").alias("mean_even"), F.col("mean_bfactor_odd").alias("mean_odd"))


@query(f"""{RES}, c AS (SELECT *, CASE resid % 7 WHEN 0 THEN 'H' WHEN 1 THEN 'G' WHEN 2 THEN 'E' WHEN 3 THEN 'B' WHEN 4 THEN 'T' ELSE '-' END AS code FROM res)
 SELECT anchor, chain, count_if(code IN ('H', 'G', 'I')) AS helix, count_if(code IN ('E', 'B')) AS sheet, count_if(code IS NULL OR code NOT IN ('H', 'G', 'I', 'E', 'B')) AS loop FROM c GROUP BY 1, 2""", BIGINT="helix sheet loop")
def secondary_structure(spark, sf):
    m = F.col("resid") % 7
    code = F.when(m == 0, "H").when(m == 1, "G").when(m == 2, "E").when(m == 3, "B").when(m == 4, "T")
    return environment.secondary_structure(nearby_residues(spark, sf).withColumn("code", code), ["anchor"], "chain", "code")


@query(f"WITH {ATOMS}, {ANCHORS} SELECT anchor, atoms.chain AS kind, round(sqrt(min({D2})), 6) AS dist FROM anchors, atoms WHERE ord <> anchor GROUP BY 1, 2")
def nearest_complement(spark, sf):
    points = atoms(spark, sf).withColumnRenamed("chain", "site")
    kinds = [r.site for r in points.select("site").distinct().orderBy("site").collect()]  # chains, a handful
    found = spatial.nearest_by_kind(anchors(spark, sf).drop("kind"), points, "anchor", "site", kinds, 0.5, F.col("ord") != F.col("anchor"))
    return found.where(F.col("dist") < float("inf")).select("anchor", F.col("site").alias("kind"), F.round("dist", 6).alias("dist"))


@query(f"WITH {ATOMS}, {ANCHORS} SELECT anchor, round(sqrt(min({D2})), 6) AS dist FROM anchors, atoms WHERE ord % 50 <> 0 GROUP BY 1")
def nearest_grid(spark, sf):
    found = spatial.nearest(anchors(spark, sf), atoms(spark, sf).where("ord % 50 <> 0"), "anchor", 0.5)
    return found.select("anchor", F.round("dist", 6).alias("dist"))


@query(f"""WITH {ATOMS}, lig AS (SELECT ord // 50 AS mol, x AS ax, y AS ay, z AS az FROM atoms WHERE ord % 2 = 0), prot AS (SELECT x, y, z FROM atoms WHERE ord % 2 = 1),
 hit AS (SELECT mol, ax, ay, az, EXISTS (SELECT 1 FROM prot WHERE {D2} <= 1.44) AS h FROM lig)
 SELECT mol, count(*) AS n, count_if(h) AS n_hit, round(count_if(h) / count(*), 6) AS clash_frac, round(avg(CASE WHEN ax * ax + ay * ay + az * az > 9.0 THEN 1.0 ELSE 0.0 END), 6) AS out_frac FROM hit GROUP BY mol""", BIGINT="n_hit")
def clash_fraction(spark, sf):
    a = atoms(spark, sf)
    lig = a.where("ord % 2 = 0").select(F.floor(F.col("ord") / 50).alias("mol"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az"))
    clash = spatial.clash_fraction(lig, a.where("ord % 2 = 1"), "mol", 1.2)
    out = clash.join(spatial.outside_fraction(lig, "mol", (0, 0, 0), 3.0), "mol")
    return out.select("mol", "n", "n_hit", F.round("clash_frac", 6).alias("clash_frac"), F.round("out_frac", 6).alias("out_frac"))


SCORED = f"CASE WHEN sqrt({D2}) >= 3.0 THEN 0.0 WHEN sqrt({D2}) <= 1.0 THEN 1.0 ELSE greatest(0.0, (3.0 - sqrt({D2})) / 2.0) END"


@query(f"""WITH {ATOMS}, {ANCHORS}, sites AS (SELECT chain AS kind, x, y, z FROM atoms WHERE ord % 50 <> 0),
 b AS (SELECT anchor, kind, coalesce((SELECT max({SCORED}) FROM sites WHERE sites.kind = anchors.kind AND {D2} < 9.0), 0.0) AS best FROM anchors)
 SELECT kind, count(*) AS n, count_if(best >= 0.25) AS matches, round(avg(best), 6) AS score FROM b GROUP BY kind""", BIGINT="matches")
def pair_best_score(spark, sf):
    sites = atoms(spark, sf).where("ord % 50 <> 0").select(F.col("chain").alias("kind"), "x", "y", "z")
    dist = F.sqrt(spatial.d2())
    best = spatial.best_pairs(anchors(spark, sf), sites, ["anchor", "kind"], "kind", numeric.window_score(dist, 1.0, 3.0), 3.0)
    return best.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("best") >= 0.25).alias("matches"), F.round(F.avg("best"), 6).alias("score"))


@query(f"""WITH {ATOMS}, {ANCHORS}, p AS (SELECT kind, chain FROM anchors JOIN atoms ON {D2} <= 2.25 AND ord <> anchor)
 SELECT count_if(kind % 2 = 0 AND chain % 2 = 1) AS donor_acceptor, count_if(kind % 2 = 1 AND chain % 2 = 0) AS acceptor_donor, count_if(kind % 2 <> chain % 2) AS hbonds FROM p""", BIGINT="donor_acceptor acceptor_donor hbonds")
def cross_pair_count(spark, sf):
    even, other = F.col("kind") % 2, F.col("chain") % 2
    return spatial.cross_counts(anchors(spark, sf), atoms(spark, sf), 1.5, (even == 0, other == 0), (even == 1, other == 1), F.col("ord") != F.col("anchor"))


@query(f"""WITH {ATOMS}, {ANCHORS}, p AS (SELECT anchor, kind, count(DISTINCT CASE WHEN chain % 2 = 0 THEN ord END) AS n_a, count(DISTINCT CASE WHEN chain % 2 = 1 THEN ord END) AS n_b FROM anchors LEFT JOIN atoms ON {D2} <= 2.25 GROUP BY 1, 2)
 SELECT anchor, n_a, n_b, CASE WHEN kind % 4 = 0 THEN 'volume' WHEN n_a < 1 OR n_b < 1 THEN 'not_close_to_both_chains' WHEN n_a < 3 OR n_b < 3 THEN 'not_all_chains_involved' END AS reason,
 NOT (kind % 4 = 0 OR n_a < 3 OR n_b < 3) AS selected FROM p""")
def tolerance_match(spark, sf):
    members = atoms(spark, sf).withColumn("side", F.when(F.col("chain") % 2 == 0, "a").otherwise("b")).withColumnRenamed("ord", "point_id")
    n = spatial.tolerance_match(anchors(spark, sf), members, ["anchor"], "side", 1.5).groupBy("anchor").pivot("side", ["a", "b"]).agg(F.first("n_match"))
    out = anchors(spark, sf).join(n, "anchor", "left").select("anchor", "kind", F.coalesce("a", F.lit(0)).alias("n_a"), F.coalesce("b", F.lit(0)).alias("n_b"))
    few = lambda k: (F.col("n_a") < k) | (F.col("n_b") < k)
    why = text.first_reason(("volume", F.col("kind") % 4 == 0), ("not_close_to_both_chains", few(1)), ("not_all_chains_involved", few(3)))
    return out.withColumn("reason", why).select("anchor", "n_a", "n_b", "reason", F.col("reason").isNull().alias("selected"))


@query("SELECT min(doc_id) AS doc_id, md5(text) AS key FROM documents GROUP BY md5(text)")
def dedup_keep_first(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("key"))
    return selection.keep_first(docs, ["key"], [F.col("doc_id")])


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size DESC, p_partkey) AS rn, min(p_partkey) OVER (PARTITION BY p_brand, p_type) AS first_ord FROM part)
 SELECT p_brand, p_type, p_partkey, p_size, first_ord FROM r WHERE rn = 1""")
def dedup_keep_best(spark, sf):
    part = table(spark, sf, "part").select("p_brand", "p_type", "p_partkey", "p_size")
    return selection.keep_best(part, ["p_brand", "p_type"], "p_size", "p_partkey").select("p_brand", "p_type", "p_partkey", "p_size", "first_ord")


@query("""SELECT l_orderkey, l_linenumber, round(0.40 * (l_discount * 10) + 0.35 * greatest(0.0, (6.5 - least(6.5, 2 + 0.25 * l_linenumber + 0.6 * (l_partkey % 3))) / 5.5) + 0.25 * (1 - l_tax) - 0.30 * (l_quantity / 100), 6) AS composite FROM lineitem""")
def composite_score(spark, sf):
    li = table(spark, sf, "lineitem")
    sa = numeric.sa_heuristic(F.col("l_linenumber"), F.col("l_partkey") % 3)
    return li.select("l_orderkey", "l_linenumber", F.round(numeric.composite(F.col("l_discount") * 10, sa, F.col("l_tax"), F.col("l_quantity") / 100), 6).alias("composite"))


CAND = "cand AS (SELECT p_brand AS cavity, p_partkey AS ord, p_name AS name, p_size AS composite, CASE WHEN p_partkey % 7 <> 0 AND p_brand NOT LIKE '%5' THEN p_retailprice END AS docking FROM part)"
BAL = f"""{CAND}, lim AS (SELECT cavity, min(composite) AS c0, max(composite) AS c1, min(docking) AS v0, max(docking) AS v1 FROM cand GROUP BY cavity),
 bal AS (SELECT cand.*, CASE WHEN v0 IS NULL THEN cn WHEN docking IS NULL THEN 0.5 * cn ELSE 0.5 * (cn + CASE WHEN v1 <= v0 THEN 1.0 ELSE (v1 - docking) / (v1 - v0) END) END AS balanced_score
 FROM cand JOIN lim USING (cavity), LATERAL (SELECT CASE WHEN c1 <= c0 THEN 1.0::DOUBLE ELSE (composite - c0)::DOUBLE / (c1 - c0) END AS cn))"""


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    docking = F.when((F.col("p_partkey") % 7 != 0) & ~F.col("p_brand").endswith("5"), F.col("p_retailprice"))
    return part.select(F.col("p_brand").alias("cavity"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.col("p_size").alias("composite"), docking.alias("docking"))


def ranked(spark: SparkSession, sf: str) -> DataFrame:
    return pareto.fronts(selection.balanced(candidates(spark, sf), "cavity", "composite", "docking"), "cavity", "composite", "docking")


@query(f"WITH {BAL} SELECT cavity, ord, round(balanced_score, 6) AS balanced_score FROM bal")
def minmax_balanced(spark, sf):
    return selection.balanced(candidates(spark, sf), "cavity", "composite", "docking").select("cavity", "ord", F.round("balanced_score", 6).alias("balanced_score"))


RUNS = """runs AS (SELECT l_suppkey AS run_index, count(DISTINCT l_partkey) AS cluster_count, count(*) AS accepted_molecules, round(avg(l_extendedprice), 6) AS vina_mean, round(sum(l_tax), 6) AS duration_sec,
 median(l_quantity) AS median_heavy_atoms, CASE l_suppkey % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'reused' ELSE 'ok' END AS status FROM lineitem GROUP BY l_suppkey)"""
ENRICHED = f"""{RUNS}, a AS (SELECT *, cluster_count / accepted_molecules AS diversity_ratio, (SELECT median(median_heavy_atoms) FROM runs) AS target FROM runs),
 b AS (SELECT *, abs(median_heavy_atoms - target) AS length_gap, greatest(0.0, 1 - abs(median_heavy_atoms - target) / 8.0) AS length_score, status IN ('ok', 'reused') AND accepted_molecules >= 5 AS eligible FROM a),
 l AS (SELECT min(diversity_ratio) AS d0, max(diversity_ratio) AS d1, min(vina_mean) AS v0, max(vina_mean) AS v1, min(duration_sec) AS t0, max(duration_sec) AS t1 FROM b WHERE eligible),
 e AS (SELECT b.*, CASE WHEN eligible THEN 0.35 * CASE WHEN d1 = d0 THEN 1.0 ELSE (diversity_ratio - d0) / (d1 - d0) END + 0.35 * CASE WHEN v1 = v0 THEN 1.0 ELSE (v1 - vina_mean) / (v1 - v0) END + 0.20 * length_score + 0.10 * CASE WHEN t1 = t0 THEN 1.0 ELSE (t1 - duration_sec) / (t1 - t0) END END AS composite_score FROM b, l)"""


def runs(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("run_index") % 5
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_suppkey").alias("run_index"))
        .agg(F.count_distinct("l_partkey").alias("cluster_count"), F.count("*").alias("accepted_molecules"), F.round(F.avg("l_extendedprice"), 6).alias("vina_mean"), F.round(F.sum("l_tax"), 6).alias("duration_sec"), F.median("l_quantity").alias("median_heavy_atoms"))
        .withColumn("status", F.when(s == 0, "failed").when(s == 1, "reused").otherwise("ok"))
    )


def enriched_runs(spark: SparkSession, sf: str) -> DataFrame:
    return sweep.enriched(runs(spark, sf), "vina_mean", 5, 8.0)


@query(f"WITH {ENRICHED} SELECT run_index, eligible, round(length_gap, 4) AS length_gap, round(length_score, 4) AS length_score, round(composite_score, 4) AS composite_score FROM e")
def sweep_score(spark, sf):
    return enriched_runs(spark, sf).select("run_index", "eligible", F.round("length_gap", 4).alias("length_gap"), F.round("length_score", 4).alias("length_score"), F.round("composite_score", 4).alias("composite_score"))


DOM2 = "b.cavity = a.cavity AND b.composite >= a.composite AND coalesce(b.docking, 'inf'::DOUBLE) <= coalesce(a.docking, 'inf'::DOUBLE) AND (b.composite > a.composite OR coalesce(b.docking, 'inf'::DOUBLE) < coalesce(a.docking, 'inf'::DOUBLE))"


@query(f"WITH {CAND} SELECT cavity, ord, composite, round(docking, 4) AS docking FROM cand a WHERE NOT EXISTS (SELECT 1 FROM cand b WHERE {DOM2})")
def pareto_front1_2d(spark, sf):
    return pareto.front1_2d(candidates(spark, sf), ["cavity"], "composite", "docking").select("cavity", "ord", "composite", F.round("docking", 4).alias("docking"))


@query(f"""WITH {ENRICHED} SELECT run_index, cluster_count, round(composite_score, 4) AS composite_score FROM e a WHERE eligible AND NOT EXISTS (SELECT 1 FROM e b WHERE b.eligible
 AND b.diversity_ratio >= a.diversity_ratio AND b.vina_mean <= a.vina_mean AND b.duration_sec <= a.duration_sec AND b.length_gap <= a.length_gap
 AND (b.diversity_ratio > a.diversity_ratio OR b.vina_mean < a.vina_mean OR b.duration_sec < a.duration_sec OR b.length_gap < a.length_gap))""")
def pareto_front1_4d(spark, sf):
    rows = enriched_runs(spark, sf).where("eligible")
    return pareto.front1(rows, ["diversity_ratio"], ["vina_mean", "duration_sec", "length_gap"]).select("run_index", "cluster_count", F.round("composite_score", 4).alias("composite_score"))


def _peel(n: int) -> str:
    parts = []
    for i in range(1, n + 1):
        before = f"r{i - 1}" if i > 1 else "bal"
        parts.append(f"f{i} AS (SELECT * FROM {before} a WHERE NOT EXISTS (SELECT 1 FROM {before} b WHERE {DOM2}))")
        parts.append(f"r{i} AS (SELECT * FROM {before} WHERE ord NOT IN (SELECT ord FROM f{i}))")
    return ", ".join(parts)


FRONTS = f"{BAL}, {_peel(3)}, fr AS (SELECT *, 1 AS pareto_front FROM f1 UNION ALL SELECT *, 2 FROM f2 UNION ALL SELECT *, 3 FROM f3)"
ORDER = "composite DESC, docking ASC NULLS LAST, balanced_score DESC, name"


#: All fronts: points in order of falling composite and rising docking; a point's front is the first whose least docking so far is larger.
BELOW = "len(list_filter(least, lambda t: t <= p.v))"
DEPTHS = f"""{BAL}, pts AS (SELECT *, row_number() OVER (PARTITION BY cavity ORDER BY composite DESC, v) AS i FROM (SELECT DISTINCT cavity, composite, coalesce(docking, 'inf'::DOUBLE) AS v FROM bal)),
 step(cavity, i, least, front) AS (SELECT cavity, i, [v], 1 FROM pts WHERE i = 1 UNION ALL
 SELECT p.cavity, p.i, list_concat(list_append(least[1:{BELOW}], p.v), least[{BELOW} + 2:]), {BELOW} + 1 FROM step JOIN pts p ON p.cavity = step.cavity AND p.i = step.i + 1),
 every AS (SELECT bal.*, step.front AS pareto_front FROM bal JOIN pts ON pts.cavity = bal.cavity AND pts.composite = bal.composite AND pts.v = coalesce(bal.docking, 'inf'::DOUBLE) JOIN step ON step.cavity = pts.cavity AND step.i = pts.i)"""


@query(f"WITH RECURSIVE {DEPTHS} SELECT cavity, ord, pareto_front, row_number() OVER (PARTITION BY cavity, pareto_front ORDER BY {ORDER}, ord) AS pareto_rank FROM every", INT="pareto_rank pareto_front")
def pareto_fronts_full(spark, sf):
    order = [F.desc("composite"), F.asc_nulls_last("docking"), F.desc("balanced_score"), F.col("name"), F.col("ord")]
    return pareto.rank_in_front(ranked(spark, sf), "cavity", order).select("cavity", "ord", "pareto_front", "pareto_rank")


PICKS = f"""{FRONTS}, m AS (SELECT bal.*, fr.pareto_front FROM bal LEFT JOIN fr USING (ord)),
 w AS (SELECT m.*, row_number() OVER (PARTITION BY m.cavity ORDER BY m.composite DESC, ord) AS rc, CASE WHEN m.docking IS NOT NULL THEN row_number() OVER (PARTITION BY m.cavity ORDER BY m.docking NULLS LAST, ord) END AS rv,
 row_number() OVER (PARTITION BY m.cavity ORDER BY m.balanced_score DESC, ord) AS rb, row_number() OVER (PARTITION BY m.cavity ORDER BY pareto_front NULLS LAST, m.composite DESC, m.docking NULLS LAST, m.balanced_score DESC, m.name, ord) AS ro FROM (SELECT bal.*, fr.pareto_front FROM bal LEFT JOIN fr ON bal.ord = fr.ord) m),
 x AS (SELECT *, rc = 1 OR coalesce(rv = 1, false) OR rb = 1 AS forced, CASE WHEN rc = 1 THEN 1 WHEN rv = 1 THEN 2 WHEN rb = 1 THEN 3 ELSE 3 + ro END AS reach FROM w WHERE rc = 1 OR rv = 1 OR rb = 1 OR pareto_front <= 2),
 y AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cavity, name ORDER BY reach) AS k FROM x) WHERE k = 1),
 z AS (SELECT *, row_number() OVER (PARTITION BY cavity ORDER BY forced DESC, reach) AS n FROM y),
 sel AS (SELECT cavity, ord, name, concat_ws(';', CASE WHEN rc = 1 THEN 'best_composite' END, CASE WHEN rv = 1 THEN 'best_vina' END, CASE WHEN rb = 1 THEN 'best_balanced' END, CASE WHEN NOT forced THEN 'front_pick' END) AS selection_reason FROM z WHERE forced OR n <= 5)"""
PICKS = PICKS.replace(" m AS (SELECT bal.*, fr.pareto_front FROM bal LEFT JOIN fr USING (ord)),\n", "\n")


@query(f"WITH {PICKS} SELECT cavity, ord, selection_reason FROM sel")
def pareto_representatives(spark, sf):
    return selection.representatives(ranked(spark, sf), "cavity", "name", 2, 5).select("cavity", "ord", "selection_reason")


@query(f"""WITH {PICKS}, t AS (SELECT cavity, name AS top_name, pareto_front AS top_pareto_front, row_number() OVER (PARTITION BY cavity ORDER BY pareto_front, {ORDER}, ord) AS rn FROM fr)
 SELECT b.cavity, count(*) AS n_input, (SELECT count(*) FROM f1 WHERE f1.cavity = b.cavity) AS n_front1, (SELECT count(*) FROM sel WHERE sel.cavity = b.cavity) AS n_selected, max(composite) AS best_composite, round(min(docking), 4) AS best_vina, any_value(top_name) AS top_name, any_value(top_pareto_front) AS top_pareto_front
 FROM bal b JOIN t ON t.cavity = b.cavity AND rn = 1 GROUP BY b.cavity""")
def pareto_report(spark, sf):
    rows = ranked(spark, sf)
    order = [F.col("pareto_front"), F.desc("composite"), F.asc_nulls_last("docking"), F.desc("balanced_score"), F.col("name"), F.col("ord")]
    out = selection.report(rows, "cavity", selection.representatives(rows, "cavity", "name", 2, 5), "composite", "docking", "name", order)
    return out.withColumn("best_vina", F.round("best_vina", 4))


@query("""WITH w AS (SELECT c_nationkey, c_custkey, round(c_acctbal, 2) AS c_acctbal, count_if(c_acctbal < 0) OVER (PARTITION BY c_nationkey) AS neg, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS rn FROM customer)
 SELECT c_nationkey, c_custkey, c_acctbal FROM w WHERE (neg > 0 AND c_acctbal < 0) OR (neg = 0 AND rn <= 10)""")
def beam_stage_select(spark, sf):
    cust = table(spark, sf, "customer").select("c_nationkey", "c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"))
    return selection.beam_stage(cust, ["c_nationkey"], "c_acctbal", [F.col("c_acctbal"), F.col("c_custkey")])


@query("SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk_global(spark, sf):
    return selection.top_global(table(spark, sf, "orders").select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice")), [F.desc("o_totalprice"), F.col("o_orderkey")], 25)


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 2", INT="rank")
def topk_per_group(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return selection.top_per_group(orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 2).select("o_custkey", "o_orderkey", "rank")


@query(f"WITH {CAND} SELECT cavity, ord, row_number() OVER (PARTITION BY cavity ORDER BY docking ASC NULLS LAST, composite DESC, name, ord) AS rank FROM cand", INT="rank")
def rank_nulls_last(spark, sf):
    order = [F.asc_nulls_last("docking"), F.desc("composite"), F.col("name"), F.col("ord")]
    return spatial.grouped_rank(candidates(spark, sf), ["cavity"], order, "rank").select("cavity", "ord", "rank")


def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", similarity.sign_words(F.col("embedding")).alias("words"))


FP = "fp AS (SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN 1::HUGEINT << (i - 1)::INT ELSE 0::HUGEINT END)) AS w FROM embeddings), fb AS (SELECT vec_id, w::HUGEINT AS w, bit_count(w::HUGEINT) AS n FROM fp)"
CUTOFF = 0.5


@query(f"WITH {FP} SELECT a.vec_id AS a, b.vec_id AS b, round(bit_count(a.w & b.w) / (a.n + b.n - bit_count(a.w & b.w)), 6) AS sim FROM fb a JOIN fb b ON a.vec_id < b.vec_id WHERE bit_count(a.w & b.w) / (a.n + b.n - bit_count(a.w & b.w)) >= {CUTOFF}", DOUBLE="sim")
def similarity_self_join(spark, sf):
    return similarity.similarity_join(fingerprints(spark, sf), "vec_id", "words", CUTOFF).select("a", "b", F.round("sim", 6).alias("sim"))


@query(f"""WITH RECURSIVE {FP}, pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fb a JOIN fb b ON a.vec_id <> b.vec_id WHERE bit_count(a.w & b.w) / (a.n + b.n - bit_count(a.w & b.w)) >= {CUTOFF}),
 o AS (SELECT fb.vec_id, row_number() OVER (ORDER BY count(pairs.b) DESC, fb.vec_id) AS r FROM fb LEFT JOIN pairs ON pairs.a = fb.vec_id GROUP BY fb.vec_id),
 adj AS (SELECT x.r, any_value(x.vec_id) AS vec_id, coalesce(list(y.r) FILTER (y.r IS NOT NULL), []) AS near FROM o x LEFT JOIN pairs ON pairs.a = x.vec_id LEFT JOIN o y ON y.vec_id = pairs.b GROUP BY x.r),
 w(i, centres) AS (SELECT 1::BIGINT, [1::BIGINT] UNION ALL SELECT i + 1, CASE WHEN list_has_any(near, centres) THEN centres ELSE list_append(centres, i + 1) END FROM w JOIN adj ON adj.r = i + 1),
 c AS (SELECT centres FROM w ORDER BY i DESC LIMIT 1)
 SELECT adj.vec_id, o.vec_id AS centroid FROM adj, c, o WHERE o.r = CASE WHEN list_contains(centres, adj.r) THEN adj.r ELSE list_min(list_filter(near, lambda x: list_contains(centres, x))) END""")
def sphere_exclusion(spark, sf):
    return similarity.exclusion_spheres(fingerprints(spark, sf), "vec_id", "words", CUTOFF)


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, l_quantity * 12 AS mw, l_discount * 60 AS logp, l_linenumber AS hbd, l_partkey % 12 AS hba, l_suppkey % 13 AS rot, l_tax * 2000 AS tpsa, l_returnflag = 'R' AS hit FROM lineitem)
 SELECT coalesce(CASE WHEN hit THEN NULL WHEN NOT (mw <= 500 AND logp <= 5 AND hbd <= 5 AND hba <= 10) THEN 'Lipinski' WHEN NOT (rot <= 10 AND tpsa <= 140) THEN 'Veber' WHEN NOT (mw <= 350 AND logp <= 3.5 AND rot <= 7) THEN 'Lead-like' END, 'kept') AS outcome, count(*) AS n FROM d GROUP BY 1""")
def hard_filters_firstfail(spark, sf):
    c = F.col
    d = table(spark, sf, "lineitem").select((c("l_quantity") * 12).alias("mw"), (c("l_discount") * 60).alias("logp"), c("l_linenumber").alias("hbd"), (c("l_partkey") % 12).alias("hba"), (c("l_suppkey") % 13).alias("rot"), (c("l_tax") * 2000).alias("tpsa"), (c("l_returnflag") == "R").alias("hit"))
    rules = [("Lipinski", ~chemistry.lipinski(c("mw"), c("logp"), c("hbd"), c("hba"))), ("Veber", ~chemistry.veber(c("rot"), c("tpsa"))), ("Lead-like", ~chemistry.lead_like(c("mw"), c("logp"), c("rot")))]
    out = selection.first_fail(d, rules, c("hit"))
    return out.groupBy(F.coalesce("first_fail", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, o_custkey, c_name, CASE WHEN c_custkey IS NULL THEN 'fetch' ELSE 'cached' END AS state FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON o_custkey = c_custkey""")
def lookup_with_cache(spark, sf):
    cache = table(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.lit("ok").alias("status"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    missing = enrich.to_fetch(orders, cache, "o_custkey").withColumn("state", F.lit("fetch"))
    out = enrich.lookup(orders, cache, "o_custkey", ["c_name"]).join(missing, "o_custkey", "left")
    return out.select("o_orderkey", "o_custkey", "c_name", F.coalesce("state", F.lit("cached")).alias("state"))


@query("""SELECT c_custkey, round(max(o_totalprice), 2) AS max_value, count(*) AS n, arg_min(o_orderpriority, (-o_totalprice, o_orderpriority)) AS best_target FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def annotate_argmax(spark, sf):
    facts = table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    return enrich.best_activity(facts, "c_custkey", "o_orderpriority", "o_totalprice").withColumn("max_value", F.round("max_value", 2))


@query("""WITH s AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority))) AS p FROM orders GROUP BY o_custkey)
 SELECT o_custkey, array_to_string(p, ';') AS all_ids, array_to_string(list_filter(p, lambda x: x NOT IN ('1-URGENT', '2-HIGH')), ';') AS others, array_to_string(list_filter(['3-MEDIUM', '1-URGENT'], lambda x: list_contains(p, x)), ';') AS both FROM s""")
def id_set_ops(spark, sf):
    s = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderpriority")).alias("p"))
    lits = lambda *x: F.array(*[F.lit(v) for v in x])
    return s.select("o_custkey", F.array_join("p", ";").alias("all_ids"), F.array_join(enrich.set_difference(F.col("p"), lits("1-URGENT", "2-HIGH")), ";").alias("others"), F.array_join(enrich.set_intersection(lits("3-MEDIUM", "1-URGENT"), F.col("p")), ";").alias("both"))


@query("SELECT month(l_shipdate)::INT AS month, round(avg(CASE WHEN l_linestatus = 'F' THEN l_quantity END), 4) AS F, round(avg(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 4) AS O FROM lineitem GROUP BY 1")
def pivot_heatmap(spark, sf):
    li = table(spark, sf, "lineitem").select(F.month("l_shipdate").alias("month"), "l_linestatus", "l_quantity")
    return sweep.heatmap(li, "month", "l_linestatus", "l_quantity", ["F", "O"]).select("month", F.round("F", 4).alias("F"), F.round("O", 4).alias("O"))


@query("""SELECT l_suppkey, count(*) AS n, count(DISTINCT l_partkey) AS n_l_partkey, round(min(l_quantity), 4) AS l_quantity_min, round(median(l_quantity), 4) AS l_quantity_median, round(avg(l_quantity), 4) AS l_quantity_mean, round(max(l_quantity), 4) AS l_quantity_max FROM lineitem GROUP BY 1""")
def metric_summary(spark, sf):
    return sweep.metric_summary(table(spark, sf, "lineitem"), ["l_suppkey"], ["l_quantity"], "l_partkey")


GRID = {"n_steps": [4, 6, 8], "n_embed_attempts": [8], "beam_width": [25, 50], "max_attach": [1, 2, 3], "max_frags": [4, 8, 12, 16, 20]}


@query("""SELECT row_number() OVER (ORDER BY s_suppkey, n_steps, n_embed_attempts, beam_width, max_attach, max_frags) AS run_index, s_suppkey, n_steps, n_embed_attempts, beam_width, max_attach, max_frags
 FROM (SELECT s_suppkey FROM supplier), (SELECT unnest([4, 6, 8])::INT AS n_steps), (SELECT 8::INT AS n_embed_attempts), (SELECT unnest([25, 50])::INT AS beam_width), (SELECT unnest([1, 2, 3])::INT AS max_attach), (SELECT unnest([4, 8, 12, 16, 20])::INT AS max_frags)""")
def param_grid(spark, sf):
    """A sweep's runs: every structure at every combination of parameters."""
    return sweep.sweep(table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey", GRID)


@query("""SELECT event_id, coalesce(nullif(trim(json_extract_string(props, '$.k')), ''), nullif(trim(json_extract_string(props, '$.key')), ''), event_type) AS name, TRY_CAST(json_extract_string(props, '$.v') AS DOUBLE) AS number FROM events""")
def coalesce_alias_cast(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.key").alias("key"), F.get_json_object("props", "$.v").alias("v"))
    return e.select("event_id", numeric.first_present(e, ["k", "key", "absent", "event_type"]).alias("name"), numeric.lenient_double(F.col("v")).alias("number"))


@query("""SELECT page_id, TRY_CAST(nullif(regexp_extract(html, 'track\\(([0-9]+)\\)', 1), '') AS DOUBLE) AS score, TRY_CAST(nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '') AS DOUBLE) AS fallback, coalesce(TRY_CAST(nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '') AS DOUBLE), TRY_CAST(nullif(regexp_extract(html, 'track\\(([0-9]+)\\)', 1), '') AS DOUBLE), 0.0) AS best FROM pages""")
def score_hint_extract(spark, sf):
    score = numeric.lenient_double(F.regexp_extract("html", r"track\(([0-9]+)\)", 1))
    page = numeric.lenient_double(F.regexp_extract("url", r"[?&]page=([0-9]+)", 1))
    return table(spark, sf, "pages").select("page_id", score.alias("score"), page.alias("fallback"), F.coalesce(page, score, F.lit(0.0)).alias("best"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS v, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
 SELECT doc_id, (i - 1)::INT AS line_no, substring(v, 1, 6) AS record, trim(substring(v, 13, 4)) AS name, length(v)::INT AS width FROM l WHERE length(v) >= 54""")
def line_parser(spark, sf):
    lines = pdb.split_lines(table(spark, sf, "documents"), "text", "doc_id")
    rows = lines.withColumn("value", F.col("value")).where(F.length("value") >= 54)
    return rows.select("doc_id", "line_no", F.substring("value", 1, 6).alias("record"), pdb.field(13, 16).alias("name"), F.length("value").alias("width"))


@query(f"WITH {ATOMS} SELECT chain, count(*) AS n, round(sum(round(x, 3)), 3) AS sx, round(sum(round(y, 3)), 3) AS sy, round(sum(round(z, 3)), 3) AS sz FROM atoms GROUP BY chain")
def pdb_roundtrip(spark, sf):
    rows = atoms(spark, sf)
    # lines as a writer would give them, read back by the parser; serial and residue numbers wrap at their columns' width
    line = F.format_string("HETATM%5d  DU  %3s %1s%4d    %8.3f%8.3f%8.3f  1.00  0.00          DU", F.col("ord") % 100_000, F.lit("DU"), F.lit("Z"), F.col("ord") % 10_000, F.round("x", 3), F.round("y", 3), F.round("z", 3))
    lines = rows.select(F.col("chain").alias("pdb_id"), F.col("ord").cast("int").alias("line_no"), line.alias("value"))
    back = pdb.anchors(pdb.atoms(lines))
    return back.groupBy(F.col("pdb_id").alias("chain")).agg(F.count("*").alias("n"), *[F.round(F.sum(c), 3).alias(f"s{c[1]}") for c in ("ax", "ay", "az")])


@query("""SELECT r_regionkey AS key, r_name AS name, NULL::INT AS region, NULL::VARCHAR AS segment FROM region UNION ALL BY NAME SELECT n_nationkey AS key, n_name AS name, n_regionkey AS region FROM nation UNION ALL BY NAME SELECT c_nationkey AS key, c_mktsegment AS segment FROM customer""")
def union_by_name_report(spark, sf):
    region = table(spark, sf, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    cust = table(spark, sf, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_mktsegment").alias("segment"))
    return writers.union_of_columns([region, nation, cust])


def _toy(step: int) -> str:
    before = f"b{step - 1}"
    every = " UNION ALL ".join(f"SELECT root, node, score, {i} AS growth_step FROM k{i} WHERE node % 3 <> 0" for i in range(1, step + 1))
    return f"""e{step} AS (SELECT (node * 7 + k * 13 + 1) % 2000 AS node, root, score + ((node * 7 + k * 13 + 1) % 2000) % 97 AS score FROM {before}, (SELECT unnest([0, 1, 2, 3]) AS k)),
 k{step} AS (SELECT node, root, max(score) AS score FROM e{step} GROUP BY node, root),
 a{step} AS (SELECT root, node, score, growth_step FROM (SELECT *, row_number() OVER (PARTITION BY root, node ORDER BY growth_step) AS f FROM ({every})) WHERE f = 1),
 b{step} AS (SELECT node, root, score FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY score DESC, node) AS rn FROM k{step} WHERE node % 5 <> 0 AND root NOT IN (SELECT root FROM a{step} GROUP BY root HAVING count(*) >= 7)) WHERE rn <= 3)"""


@query(f"""WITH b0 AS (SELECT vec_id AS node, vec_id AS root, 0::BIGINT AS score FROM embeddings WHERE vec_id % 50 = 0), {_toy(1)}, {_toy(2)}, {_toy(3)}
 SELECT root, node, score, growth_step, rank FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY score DESC, node) AS rank FROM a3) WHERE rank <= 7""", INT="rank")
def beam_search_toy(spark, sf):
    seeds = table(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("node"), F.col("vec_id").alias("root"), F.lit(0).cast("long").alias("score"))

    def grow(states: DataFrame) -> DataFrame:
        nxt = states.withColumn("k", F.explode(F.array(*[F.lit(i) for i in range(4)]))).withColumn("node", (F.col("node") * 7 + F.col("k") * 13 + 1) % 2000)
        return nxt.select("node", "root", (F.col("score") + F.col("node") % 97).alias("score"))

    # a group stops once it has 7 states; what is a multiple of 3 is no result, what is one of 5 doesn't grow
    out = beam.beam_search(seeds, grow, group="root", key="node", order=[F.desc("score"), F.col("node")], accept=F.col("node") % 3 != 0, grows=F.col("node") % 5 != 0, beam_width=3, steps=3, max_output=7)
    return out.select("root", "node", "score", "growth_step", "rank")


@query("SELECT user_id, count(*) AS n, max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)::INT AS has_mark, coalesce(string_agg(DISTINCT event_type, ';' ORDER BY event_type), '') AS names FROM events GROUP BY user_id")
def chain_info(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("event_type") == "click", 1).otherwise(0)).alias("has_mark"), F.array_join(F.sort_array(F.collect_set("event_type")), ";").alias("names"))


@query("SELECT o_orderkey, rn::INT AS rn FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) WHERE rn > 100 AND rn <= 150")
def batch_slice(spark, sf):
    return selection.slice_of(table(spark, sf, "orders").select("o_orderkey"), [F.col("o_orderkey")], 50, 3).select("o_orderkey", F.col("rn").cast("int").alias("rn"))


@query("SELECT conv_id, turn, md5(role || chr(0) || text) AS signature, sha256(role || chr(0) || text) AS signature256 FROM conversations")
def content_signature(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", text.content_signature(F.col("role"), F.col("text")).alias("signature"), text.content_signature(F.col("role"), F.col("text"), method="sha256").alias("signature256"))


@query("SELECT l_suppkey, o_orderpriority, count(*) AS n, sum(l_quantity)::BIGINT AS quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY 1, 2")
def companion_join(spark, sf):
    li = table(spark, sf, "lineitem").where(F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz")).select("l_orderkey", "l_suppkey", "l_quantity")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return li.join(orders, "l_orderkey").groupBy("l_suppkey", "o_orderpriority").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


FRONT_4D = """eligible AND NOT EXISTS (SELECT 1 FROM e b WHERE b.eligible AND b.diversity_ratio >= a.diversity_ratio AND b.vina_mean <= a.vina_mean AND b.duration_sec <= a.duration_sec AND b.length_gap <= a.length_gap
 AND (b.diversity_ratio > a.diversity_ratio OR b.vina_mean < a.vina_mean OR b.duration_sec < a.duration_sec OR b.length_gap < a.length_gap))"""


@query(f"""WITH {ENRICHED}, p AS (SELECT * FROM e a WHERE {FRONT_4D}), s AS (SELECT run_index, composite_score, 'front' AS pool FROM p ORDER BY composite_score DESC, run_index LIMIT 10),
 t AS (SELECT run_index, composite_score, 'eligible' AS pool FROM e WHERE eligible ORDER BY composite_score DESC, run_index LIMIT 10)
 SELECT pool, run_index, round(composite_score, 4) AS composite_score FROM (SELECT * FROM s UNION ALL SELECT * FROM t)""")
def shortlist_topk(spark, sf):
    """Of the front's runs, and of all eligible ones as it is when no front is marked."""
    rows = enriched_runs(spark, sf)
    front = pareto.front1(rows.where("eligible"), ["diversity_ratio"], ["vina_mean", "duration_sec", "length_gap"]).select("run_index", F.lit(True).alias("pareto_front"))
    marked = rows.join(front, "run_index", "left").withColumn("pareto_front", F.coalesce("pareto_front", F.lit(False)))
    some = lambda df, name: sweep.shortlist(df, 10).select(F.lit(name).alias("pool"), "run_index", F.round("composite_score", 4).alias("composite_score"))
    return some(marked, "front").unionByName(some(marked.withColumn("pareto_front", F.lit(False)), "eligible"))


@query(f"WITH {ATOMS} SELECT ord // 20 AS mol, count(*) AS n, round(avg(x), 6) AS cx, round(greatest(max(x) - min(x) + 8, 14), 6) AS size_x FROM atoms GROUP BY 1")
def docking_box(spark, sf):
    from lodestone.functions import geometry

    cols = ("x", "y", "z")
    g = atoms(spark, sf).groupBy(F.floor(F.col("ord") / 20).alias("mol"))
    box = geometry.docking_box(F.count("*"), [F.min(c) for c in cols], [F.max(c) for c in cols], [F.avg(c) for c in cols])
    return g.agg(F.count("*").alias("n"), box.alias("box")).select("mol", "n", F.round(F.get("box.center", 0), 6).alias("cx"), F.round(F.get("box.size", 0), 6).alias("size_x"))


@query(f"WITH {ATOMS} SELECT ord // 20 AS mol, count(*) AS n_atoms, count(*) AS heavy, round(sum(CASE WHEN chain % 2 = 0 THEN 12.011 ELSE 15.999 END), 3) AS mw FROM atoms GROUP BY 1", DOUBLE="mw")
def sdf_roundtrip(spark, sf):
    rows = atoms(spark, sf).withColumn("elem", F.when(F.col("chain") % 2 == 0, "C").otherwise("O"))
    own = F.transform(F.array_sort(F.collect_list(F.struct("ord", "elem", "x", "y", "z"))), lambda s: F.struct(s["elem"].alias("elem"), s["x"].alias("x"), s["y"].alias("y"), s["z"].alias("z")))
    mols = rows.groupBy(F.floor(F.col("ord") / 20).alias("mol")).agg(own.alias("atoms"))
    props = F.array(F.struct(F.lit("mol").alias("name"), F.col("mol").cast("string").alias("value")))
    block = writers.mol_block(F.col("mol").cast("string"), F.col("atoms"), F.expr(f"cast(array() as array<{chemistry.BOND}>)"), props)
    back = sdf.parse_sdf(mols.select(F.lit("memory").alias("file"), F.col("mol").alias("ord"), F.regexp_replace(block, r"\$\$\$\$$", "").alias("block")))
    return back.select(F.col("ord").alias("mol"), F.size("atoms").cast("long").alias("n_atoms"), chemistry.heavy_atoms(F.col("atoms")).cast("long").alias("heavy"), F.round(chemistry.weight(F.col("atoms")), 3).alias("mw"))


@query("SELECT p_partkey, p_size, p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size >= a.p_size AND b.p_retailprice <= a.p_retailprice AND (b.p_size > a.p_size OR b.p_retailprice < a.p_retailprice))")
def stream_front1(spark, sf):
    """The first front of ``part`` kept by a stream over its file."""
    from lodestone.streaming import front

    folder = f"{shared_folder(spark)}/front-{uuid.uuid4().hex}"
    part = spark.readStream.schema(table(spark, sf, "part").schema).parquet(f"{sf}/part.parque*").select("p_partkey", "p_size", "p_retailprice")
    front.keep_front(part, f"{folder}/out", f"{folder}/state", ["p_size"], ["p_retailprice"]).awaitTermination()
    return front.current(spark, f"{folder}/out")


from . import designs, molecules, structures  # noqa: E402, F401  registers its queries
