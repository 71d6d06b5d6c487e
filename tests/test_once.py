"""What many rows share is computed once."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import graphs, smiles
from lodestone.operators import growth
from lodestone.plans import designs
from lodestone.plans import molecules as M
from lodestone.session import each_once, met
from lodestone.sources import fragments


def test_each_value_is_computed_once_and_null_meets_null(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "i int, t string")
    found = each_once(rows, "t", lambda some: some.withColumn("n", F.coalesce(F.length("t"), F.lit(-1))))
    assert sorted((r["t"] or "", r["n"]) for r in found.collect()) == [("", -1), ("a", 1), ("b", 1)]
    assert sorted((r["i"], r["n"]) for r in met(rows, found, "t").collect()) == [(1, 1), (2, 1), (3, 1), (4, -1)]


def test_each_spelling_of_the_parts_is_read_once(spark, sf_dir):
    texts = [r["text"] for r in M.spellings(spark, sf_dir).union(M.spellings(spark, sf_dir)).collect()]
    read = [r["text"] for r in M.molecules(spark, sf_dir).select("text").collect()]
    assert sorted(read) == sorted(set(texts)) and len(read) < len(texts)


@pytest.mark.parametrize("copies", [40])
def test_each_product_is_built_once(spark, copies, monkeypatch):
    """States of one graph share its products; before, each state's were perceived anew."""
    lib = [("F", "F", "first", 1, 0, None), ("Cl", "Cl", "first", 1, 0, None)]
    frags = growth.library(spark.createDataFrame(lib, "name string, smiles string, kind string, order int, map int, stereo string"))
    states = spark.createDataFrame([(i, "CC") for i in range(copies)], "id int, s string").select("id", smiles.graph(F.col("s")).alias("graph"))
    sizes, keyed = [], growth.keyed
    monkeypatch.setattr(growth, "keyed", lambda df: (sizes.append(df.count()), keyed(df))[1])
    rows = growth.grown(states, frags, ["id"], 2, 2, 5).collect()
    assert sizes == [4] and len(rows) == 4 * copies
    assert {r["key"] for r in rows} == {r["k"] for r in graphs.perceived(spark.createDataFrame([("CCF",), ("CCCl",)], "s string").select(smiles.graph(F.col("s")).alias("graph"))).select(graphs.canonical_key().alias("k")).collect()}


def test_each_smiles_of_fragment_lines_is_read_once(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(fragments, "each_once", lambda df, column, compute: each_once(df, column, lambda some: (sizes.append(some.count()), compute(some))[1]))
    lines = spark.createDataFrame([(i, t) for i, t in enumerate(["CCO a", "CCO b", "c1cc x", "x,CCO", "CCN"])], "i int, t string")
    rows = sorted((r["i"], r["name"], len(r["graph"]["atoms"])) for r in fragments.read_lines(lines, "t").collect())
    assert rows == [(0, "a", 3), (1, "b", 3), (3, "x", 3), (4, "CCN", 3)] and sizes == [3]


def test_records_are_written_and_parsed_on_all_cores(spark, sf_dir):
    assert designs.records(spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
