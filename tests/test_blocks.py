"""Joins dealt in blocks of bounded size."""

import random

from pyspark.sql import functions as F

from lodestone.operators import similarity, spatial


def test_block_join_equals_grid_join_and_keeps_keys_together(spark, monkeypatch):
    monkeypatch.setattr(spatial, "ANCHORS", 7)
    monkeypatch.setattr(spatial, "POINTS", 16)
    rng = random.Random(1)
    place = lambda: [rng.uniform(-2, 2) for _ in range(3)]
    anchors = spark.createDataFrame([(i // 2, *place()) for i in range(40)], "anchor int, ax double, ay double, az double")
    points = spark.createDataFrame([(i // 4, i, *place()) for i in range(200)], "resid int, i int, x double, y double, z double")
    pairs = spatial.block_join(anchors, points, 1.5, ["anchor"], ["resid"])
    plain = lambda df: sorted((r["anchor"], r["i"], r["d2"]) for r in df.collect())
    assert plain(pairs) == plain(spatial.grid_join(anchors, points, 1.5)) != []
    dealt = pairs.select("anchor", "resid", "__a", "__p", F.spark_partition_id().alias("task")).distinct()
    assert dealt.groupBy("anchor", "resid").count().where("count > 1").isEmpty() and dealt.select("__a", "__p").distinct().count() > 20


def test_a_crowd_in_one_cell_is_dealt_to_many_tasks(spark, monkeypatch):
    """All rows in one cell: a grid join leaves them to the one task of that cell."""
    monkeypatch.setattr(spatial, "POINTS", 50)
    points = spark.range(1000).selectExpr("id as point_id", "id % 2 as side", "id * 1e-6 as x", "0d as y", "0d as z")
    anchors = spark.range(3).selectExpr("id as anchor", "0d as ax", "0d as ay", "0d as az")
    sizes = spatial.block_join(anchors, points, 1.0, ["anchor"], ["point_id"]).groupBy("__a", "__p").count().collect()
    assert len(sizes) == 20 and max(r["count"] for r in sizes) < 300
    assert sorted((r["anchor"], r["side"], r["n_match"]) for r in spatial.tolerance_match(anchors, points, ["anchor"], "side", 1.0).collect()) == [(a, s, 500) for a in range(3) for s in range(2)]


def test_dense_fingerprints_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 20)
    rng = random.Random(2)
    words = {i: [rng.getrandbits(64) - 2**63 for _ in range(2)] for i in range(150)} | {500: [0, 0]}
    df = spark.createDataFrame(list(words.items()), "i int, w array<long>")
    bits = {i: {(k, j) for k, x in enumerate(w) for j in range(64) if x >> j & 1} for i, w in words.items()}
    pairs = similarity.similarity_join(df, "i", "w", 0.35)
    want = {(a, b): len(x & y) / len(x | y) for a, x in bits.items() for b, y in bits.items() if a < b and x | y and len(x & y) / len(x | y) >= 0.35}
    assert {(r["a"], r["b"]): r["sim"] for r in pairs.collect()} == want and want
    assert pairs.rdd.getNumPartitions() > 20  # one pair of blocks each, not one count of bits


def test_spheres_of_dense_fingerprints_write_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(similarity, "COUNTED", 40)
    monkeypatch.setattr(similarity, "FIRST", 30)
    monkeypatch.setattr(similarity, "similarity_join", None)
    rng = random.Random(3)
    words = {i: [rng.getrandbits(64) - 2**63 for _ in range(2)] for i in range(150)} | {500: [0, 0], 501: [-1, 5], 502: [-1, 5]}
    bits = {i: {(k, j) for k, x in enumerate(w) for j in range(64) if x >> j & 1} for i, w in words.items()}
    near = {i: {j for j in words if i != j and bits[i] | bits[j] and len(bits[i] & bits[j]) / len(bits[i] | bits[j]) >= 0.39} for i in words}
    centre: dict[int, int] = {}
    for i in sorted(words, key=lambda i: (-len(near[i]), i)):
        if i not in centre:
            centre |= {i: i} | {j: i for j in near[i] if j not in centre}
    df = spark.createDataFrame(list(words.items()), "i int, w array<long>")
    got = {r["i"]: r["centroid"] for r in similarity.exclusion_spheres(df, "i", "w", 0.39).collect()}
    assert got == centre and 10 < len(set(got.values())) < 150
