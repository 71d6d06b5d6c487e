"""Hot groups: peeling in blocks, skylines in blocks, ranks by ranges; streams with late and repeated rows; tables replaced safely."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import pareto, selection, spatial
from lodestone.sinks import writers
from lodestone.sources import tables
from lodestone.streaming import front


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


SHAPES = {
    "random": lambda r, i: (r.random(), r.random()),
    "ties": lambda r, i: (r.randrange(12), r.randrange(12)),
    "chain": lambda r, i: (-i, float(i)),  # one front for each point
    "stairs": lambda r, i: (i, float(i)),  # one front
    "one high": lambda r, i: (1.0, float(i)),
    "one low": lambda r, i: (float(i), 1.0),
}


@pytest.mark.parametrize("shape", sorted(SHAPES))
def test_peeling_in_blocks_equals_peeling_in_one(spark, shape):
    rng = random.Random(len(shape))
    rows = [("hot", i, float(h), float(v)) for i in range(200) for h, v in [SHAPES[shape](rng, i)]] + [("small", i, float(i % 5), float(i % 3)) for i in range(20)] + [("hot", 1000, 0.5, None)]
    df = frame(spark, rows, "g string, i int, h double, v double")
    small = {(r["g"], r["i"]): r["pareto_front"] for r in pareto.fronts(df, "g", "h", "v").collect()}
    large = {(r["g"], r["i"]): r["pareto_front"] for r in pareto.fronts(df, "g", "h", "v", block=50).collect()}
    assert large == small and len(large) == len(rows)
    hot = [r for r in rows if r[0] == "hot"]
    want = pareto.depth(np.array([r[2] for r in hot]), np.array([np.inf if r[3] is None else r[3] for r in hot]))
    assert [small["hot", r[1]] for r in hot] == want.tolist()


def test_a_hot_group_in_many_blocks(spark):
    rng = random.Random(3)
    points = sorted({(rng.random(), rng.random()) for _ in range(1000)})
    df = frame(spark, [("hot", *p) for p in points], "g string, __h double, __v double")
    got = {(r["__h"], r["__v"]): r["pareto_front"] for r in pareto.peeled(df, "g", 60).collect()}
    want = pareto.depth(np.array([p[0] for p in points]), np.array([p[1] for p in points]))
    assert [got[p] for p in points] == want.tolist()


def test_skyline_in_blocks_equals_skyline_in_one(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(40), rng.randrange(40), rng.random()) for i in range(600)] + [(1000 + i, 39, 0, 0.0) for i in range(3)]
    df = frame(spark, rows, "i int, a int, b int, c double")
    one = sorted(r["i"] for r in pareto.front1(df, ["a"], ["b", "c"]).collect())
    assert sorted(r["i"] for r in pareto.front1(df, ["a"], ["b", "c"], merged=32).collect()) == one
    assert sorted(r["i"] for r in pareto.blockwise(df, ["a"], ["b", "c"], 7).collect()) == one
    worse = lambda x, y: y[1] >= x[1] and y[2] <= x[2] and y[3] <= x[3] and (y[1] > x[1] or y[2] < x[2] or y[3] < x[3])
    assert one == sorted(x[0] for x in rows if not any(worse(x, y) for y in rows))


def test_ranks_by_ranges_equal_ranks_by_window(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice([None, rng.randrange(50)]), i) for i in range(500)]
    df = frame(spark, rows, "g string, v int, i int")
    order = [F.asc_nulls_last("v"), F.col("i")]
    window = sorted((r["i"], r["rn"]) for r in selection.ranks(df, ["g"], order).collect())
    ranges = selection.ranks(df, ["g"], order, largest=50)
    assert sorted((r["i"], r["rn"]) for r in ranges.collect()) == window and ranges.columns == ["g", "v", "i", "rn"]


def test_beam_stage_keeps_binding_rows_or_the_best_ten(spark):
    rows = [(g, i, (-1.0 if g == "bind" and i % 3 == 0 else float(i)) if i % 7 else None) for g in ("bind", "none") for i in range(30)]
    df = frame(spark, rows, "g string, i int, s double")
    got = {}
    for r in selection.beam_stage(df, ["g"], "s", [F.asc_nulls_last("s"), F.col("i")]).collect():
        got.setdefault(r["g"], set()).add(r["i"])
    assert got["bind"] == {i for i in range(30) if i % 7 and i % 3 == 0}
    assert got["none"] == set([i for i in range(30) if i % 7][:10])


def test_least_distances_equal_all_pairs(spark):
    rng = random.Random(6)
    place = lambda: [rng.uniform(-30, 30) for _ in range(3)]
    anchors = [(f"f{i % 3}", i, *place()) for i in range(20)]
    points = [(f"f{i % 2}", *place()) for i in range(60)]
    a, p = frame(spark, anchors, "file string, n int, ax double, ay double, az double"), frame(spark, points, "file string, x double, y double, z double")
    got = {(r["file"], r["n"]): r["dist"] for r in spatial.min_distances(a, p, ["file", "n"], "file").collect()}
    for f, n, *at in anchors:
        want = min((sum((u - v) ** 2 for u, v in zip(at, q, strict=True)) ** 0.5 for g, *q in points if g == f), default=float("inf"))
        assert got[f, n] == pytest.approx(want)


def fill(spark, folder, parts, schema):
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)


def test_stream_counts_duplicates_and_leaves_late_rows_out(spark, tmp_path):
    t = lambda m: f"2024-01-01 00:{m:02d}:00"
    parts = [[("a", t(10), 1), ("a", t(5), 2), ("b", t(6), 3)], [("a", t(7), 4), ("b", t(6), 5)], [("a", t(40), 6)], [("a", t(41), 8)], [("c", t(1), 7), ("b", t(42), 9)]]
    folder = str(tmp_path / "in")
    fill(spark, folder, [[(k, i, s) for k, s, i in p] for p in parts], "key string, event_id long, s string")
    stream = front.files(spark, folder, "key string, event_id long, s string").withColumn("ts", F.col("s").cast("timestamp"))
    every = front.collected(front.first_by_key(stream, "key", "ts", "event_id"), str(tmp_path / "all"), ["key"], "n")
    assert {(r["key"], r["n"], r["event_id"]) for r in every.collect()} == {("a", 5, 2), ("b", 3, 3), ("c", 1, 7)}
    out = front.written(front.first_by_key(stream, "key", "ts", "event_id", "10 minutes"), str(tmp_path / "late"))
    rows = spark.read.parquet(out).collect()
    assert not [r for r in rows if r["key"] == "c"]  # beyond the watermark when it came
    last = {(r["key"], r["batch"]): (r["n"], r["event_id"]) for r in rows}
    assert last["b", 1] == (2, 3) and last["b", 4] == (1, 9)  # its state had gone by then


def test_stream_of_fronts_gives_changes_and_the_front_of_all(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.choice("xy"), float(rng.randrange(20)), float(rng.randrange(20)), i) for i in range(120)]
    folder = str(tmp_path / "in")
    fill(spark, folder, [rows[i : i + 30] for i in range(0, 120, 30)], "k string, h double, v double, i long")
    changes = front.front_by_key(front.files(spark, folder, "k string, h double, v double, i long"), "k", "h", "v", "i")
    got = {r["i"] for r in front.standing(changes, str(tmp_path / "out"), "k", "i").collect()}
    assert got == {x[3] for x in rows if not any(y[0] == x[0] and y[1] >= x[1] and y[2] <= x[2] and (y[1] > x[1] or y[2] < x[2]) for y in rows)}


def test_a_failed_replacement_keeps_the_table(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = spark.createDataFrame([("n", "k", "p", 1, "ok")], "namespace string, key string, payload string, ts long, status string")
    writers.save_cache(rows, path)
    with pytest.raises(Exception):  # noqa: B017
        writers.save_cache(rows.withColumn("payload", F.raise_error(F.lit("no"))), path)
    assert tables.read_cache(spark, path).count() == 1
    writers.save_cache(rows.unionAll(rows), path)
    assert tables.read_cache(spark, path).count() == 2 and [p.name for p in tmp_path.iterdir() if ".old" in p.name] == []


def test_line_breaks_in_quoted_values(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note\n1,"two\nlines"\n2,one\n')
    rows = tables.read_csv(spark, str(tmp_path)).select("id", "note").collect()
    assert {(r["id"], r["note"]) for r in rows} == {("1", "two\nlines"), ("2", "one")}


def test_identity_falls_back_to_smiles(spark):
    df = spark.createDataFrame([("IK", "S"), (" ", "S "), (None, "S"), (None, " "), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(selection.identity_key(F.col("a"), F.col("b"))).collect()] == ["IK", "S", "S", None, None]


def test_records_of_molecule_files_end_at_their_lines_only(spark, tmp_path):
    from lodestone.sources import sdf

    def block(name, value, end="\n"):
        return end.join([name, "  x", "", "  1  0  0  0  0  0  0  0  0  0999 V2000", "    1.0000    2.0000    3.0000 C   0  0", "M  END", "> <note>", value, "", "$$$$", ""])

    (tmp_path / "a.sdf").write_bytes((block("one", "costs $$$$ a lot") + block("two", "$$$$ more") + block("three", "x")).encode())
    (tmp_path / "b.sdf").write_bytes((block("four", "y", "\r\n") + block("five", "$$$$5", "\r\n")).encode())
    (tmp_path / "c.sdf").write_bytes(b"")
    (tmp_path / "d.sdf").write_bytes(b"broken\n$$$$\n" + block("", "no title").encode() + b"\n\n")
    rows = sdf.read_sdf(spark, str(tmp_path)).collect()
    assert sorted((r["title"], r["props"]["note"]) for r in rows) == [("", "no title"), ("five", "$$$$5"), ("four", "y"), ("one", "costs $$$$ a lot"), ("three", "x"), ("two", "$$$$ more")]
    assert all(len(r["atoms"]) == 1 and r["atoms"][0]["z"] == 3.0 for r in rows)
