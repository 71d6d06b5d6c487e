"""Parameter grids, run summaries, enrichment and shortlist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import numeric
from lodestone.session import kept

from .selection import global_rank


def placed(df: DataFrame, id_col: str, axes: dict[str, list[int]]) -> DataFrame:
    """With the axes' values at each place (from 0) of their product, the last axis fastest."""
    step = 1
    for values in axes.values():
        step *= len(values)
    for name, values in axes.items():
        step //= len(values)
        at = F.floor(F.col(id_col) / step).cast("int") % len(values)
        df = df.withColumn(name, F.get(F.array(*[F.lit(v) for v in values]), at))
    return df


def combinations(axes: dict[str, list[int]]) -> int:
    n = 1
    for values in axes.values():
        n *= len(values)
    return n


def grid(spark: SparkSession, axes: dict[str, list[int]]) -> DataFrame:
    """The product of the axes with run_index from 1, the last axis fastest."""
    out = spark.range(combinations(axes)).withColumn("run_index", (F.col("id") + 1).cast("int"))
    return placed(out, "id", axes).drop("id")


def sweep(files: DataFrame, key: str, axes: dict[str, list[int]]) -> DataFrame:
    """Every file (column ``key``) at every combination of the axes, with run_index from 1: by file, then the last axis fastest."""
    n = combinations(axes)
    ranked = global_rank(files, [F.col(key)], "__file")
    rows = ranked.withColumn("__at", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    out = placed(rows, "__at", axes).withColumn("run_index", (F.col("__file") - 1) * n + F.col("__at") + 1)
    return out.drop("__file", "__at")


def tasks(files: DataFrame, n_col: str) -> DataFrame:
    """Every file with every index 0..n-1."""
    return files.where(F.col(n_col) > 0).withColumn("du_index", F.explode(F.sequence(F.lit(0), F.col(n_col).cast("int") - 1)))


def pending(planned: DataFrame, finished: DataFrame, keys: list[str]) -> DataFrame:
    """Runs without a finished one: resuming asks for nothing twice."""
    return planned.join(finished.where("status in ('ok', 'reused')").select(*keys).distinct(), keys, "left_anti")


def metric_summary(df: DataFrame, by: list[str], metrics: list[str], distinct: str | None = None) -> DataFrame:
    """count, and min, median, mean and max of each metric at four places; null for none."""
    cols: list[Column] = [F.count("*").alias("n")]
    if distinct:
        cols.append(F.count_distinct(distinct).alias(f"n_{distinct}"))
    for m in metrics:
        for name, f in (("min", F.min), ("median", F.median), ("mean", F.avg), ("max", F.max)):
            cols.append(F.round(f(m), 4).alias(f"{m}_{name}"))
    return df.groupBy(*by).agg(*cols)


def enriched(runs: DataFrame, docking: str, min_accepted: int, tolerance: float, target: float | None = None) -> DataFrame:
    """Runs with diversity, length score, eligibility and composite_score.

    The target length is the median over all runs that have a length, 25 without any.
    Scores are min-max over eligible runs; runs that aren't have none, unless no run is: then all have 0."""
    # read three times below: computed once
    rows = kept(runs.withColumn("diversity_ratio", numeric.ratio_zero(F.col("cluster_count"), F.col("accepted_molecules"))))
    aim = rows.agg(F.coalesce(F.lit(target).cast("double"), F.median("median_heavy_atoms"), F.lit(25.0)).alias("target_length"))
    rows = rows.crossJoin(F.broadcast(aim))  # one row
    m, t = F.col("median_heavy_atoms").cast("double"), F.col("target_length")
    rows = rows.withColumns({"length_gap": numeric.length_gap(m, t), "length_score": numeric.length_score(m, t, tolerance)})
    rows = rows.withColumn("eligible", F.coalesce(F.col("status").isin("ok", "reused") & (F.col("accepted_molecules") >= min_accepted) & F.col(docking).isNotNull() & F.col("length_gap").isNotNull(), F.lit(False)))
    names = ["diversity_ratio", docking, "duration_sec"]
    lim = rows.where("eligible").agg(F.count("*").alias("__n"), *[f(c).alias(f"__{k}{i}") for i, c in enumerate(names) for k, f in (("lo", F.min), ("hi", F.max))])
    rows = rows.crossJoin(F.broadcast(lim))  # one row
    score = lambda i, up: numeric.minmax_score(F.col(names[i]), F.col(f"__lo{i}"), F.col(f"__hi{i}"), up)
    value = numeric.sweep_composite(score(0, True), score(1, False), F.col("length_score"), score(2, False))
    out = rows.withColumn("composite_score", F.when(F.col("__n") == 0, F.lit(0.0)).when(F.col("eligible"), value))
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def shortlist(rows: DataFrame, k: int) -> DataFrame:
    """Front rows if there are any, else eligible ones; best composite first, ``k`` of them."""
    n = rows.agg(F.count_if(F.col("pareto_front")).alias("__n"))
    pool = rows.crossJoin(F.broadcast(n)).where(F.when(F.col("__n") > 0, F.col("pareto_front")).otherwise(F.col("eligible"))).drop("__n")
    return pool.orderBy(F.desc("composite_score"), "run_index").limit(k)


def heatmap(df: DataFrame, y: str, x: str, value: str, xs: list) -> DataFrame:
    """Means as a dense matrix, one column for each x; cells without rows are null."""
    return df.groupBy(y).pivot(x, xs).agg(F.avg(value))


def with_sizes(runs: DataFrame, metrics: DataFrame, path: str = "sdf_path", file: str = "file") -> DataFrame:
    """Runs with the size metrics of their molecule files (null without a file)."""
    return runs.join(metrics.withColumnRenamed(file, path), path, "left")


def bubbles(rows: DataFrame, docking: str) -> DataFrame:
    """What a bubble chart shows: diversity against docking, sized by accepted molecules, coloured by their median size, labelled."""
    label = F.concat_ws("/", *[F.concat(F.lit(n), F.col(c).cast("string")) for n, c in (("ns", "n_steps"), ("ne", "n_embed_attempts"), ("bw", "beam_width"), ("ma", "max_attach"), ("mf", "max_frags"))])
    return rows.where(F.col(docking).isNotNull()).select("run_index", F.col("diversity_ratio").alias("x"), F.col(docking).alias("y"), F.col("accepted_molecules").alias("size"), F.col("median_heavy_atoms").alias("colour"), label.alias("label"))


def formatted(rows: DataFrame, places: list[str], flag: str = "pareto_front") -> DataFrame:
    """Output rows: the given columns rounded to four places or blank, the front as yes or no."""
    out = rows.withColumns({c: numeric.round_or_blank(F.col(c).cast("double")) for c in places})
    return out.withColumn(flag, F.when(F.coalesce(F.col(flag), F.lit(False)), "yes").otherwise("no"))
