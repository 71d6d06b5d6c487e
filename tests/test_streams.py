"""Streams without a watermark: plain aggregates over files that all cores read; nulls as in SQL."""

from datetime import datetime
from pathlib import Path

from lodestone.plans import designs
from lodestone.streaming import front


def fill(spark, folder, parts, schema):
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)


def test_stream_without_watermark_is_folded_before_its_shuffle(spark, tmp_path, capsys):
    """Neither a task of all rows of a hot key nor a call of Python for each key; nulls as in SQL: no time comes last, no item is never first."""
    t = lambda m: datetime(2024, 1, 1, 0, m)
    schema = "key string, ts timestamp, event_id long"
    parts = [[("a", None, 1), ("a", t(5), 9), ("b", None, 4)], [("a", t(2), None), ("b", None, 3), (None, t(3), 8)], [("c", t(7), None), (None, t(2), 9)], [("hot", t(i % 50), i) for i in range(5000)]]
    folder = str(tmp_path / "in")
    fill(spark, folder, parts, schema)
    out = front.collected(front.first_by_key(front.files(spark, folder, schema), "key", "ts", "event_id"), str(tmp_path / "out"), ["key"], "n")
    assert {tuple(r) for r in out.select("key", "n", "first", "event_id").collect()} == {("a", 3, t(2), 9), ("b", 2, None, 3), ("c", 1, t(7), None), (None, 2, t(2), 9), ("hot", 5000, t(0), 0)}
    changes = front.first_by_key(front.files(spark, folder, schema), "key", "ts", "event_id")
    run = changes.writeStream.format("noop").outputMode("update").option("checkpointLocation", str(tmp_path / "noop")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert [p["stateOperators"][0]["operatorName"] for p in run.recentProgress] == ["stateStoreSave"] * len(parts)
    capsys.readouterr()
    run.explain()
    plan = capsys.readouterr().out
    assert "InPandas" not in plan and plan.index("StateStoreSave") < plan.index("Exchange") < plan.index("partial_count")


def test_stream_first_seen_has_files_for_all_cores_and_null_keys(spark, tmp_path, monkeypatch):
    rows = [(i, datetime(2024, 1, 1, 0, i % 60), None if i % 5 == 0 else i % 7, None if i % 11 == 0 else "view") for i in range(500)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    read = []
    monkeypatch.setattr(front, "files", lambda s, folder, *rest, own=front.files: read.append((folder, rest[-1])) or own(s, folder, *rest))
    got = {r["key"]: (r["n"], r["event_id"]) for r in designs.stream_first_seen(spark, str(tmp_path)).collect()}
    key = lambda r: None if r[2] is None or r[3] is None else f"{r[2]}:{r[3]}"
    assert got == {k: (len(own), min((r[1], r[0]) for r in own)[1]) for k in map(key, rows) for own in [[r for r in rows if key(r) == k]]}
    (folder, per_trigger), cores = read[0], spark.sparkContext.defaultParallelism
    assert per_trigger == cores and len(list(Path(folder).glob("part-*"))) == 4 * cores


def test_arriving_takes_four_batches_however_many_files_there_are(spark, monkeypatch):
    df = spark.range(2000)
    own = type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda self, n, *columns: own(self, 37, *columns))
    monkeypatch.setattr(front, "files", lambda s, folder, schema, per_trigger: per_trigger)
    assert designs.arriving(df, "many", "id") == 10
