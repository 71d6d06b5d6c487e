"""Deduplication, order, top-k, representatives, filters with first-fail counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import numeric
from lodestone.functions.text import first_reason, reasons
from lodestone.session import kept

#: Rows of an order's head that one task may sort.
HEAD = 100_000


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an explicit order (a window group limit, applied before the shuffle too)."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rn", rn).where("__rn = 1").drop("__rn")


def identity_key(inchikey: Column, smiles: Column) -> Column:
    """What a design is told apart by: its InChIKey, or its SMILES where that is missing or blank; null with neither."""
    filled = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.coalesce(filled(inchikey), filled(smiles))


def keep_best(df: DataFrame, keys: list[str], score: str, ord_col: str) -> DataFrame:
    """The row with the highest score of each key; of equal ones the first, and the key's first place in ``first_ord``."""
    w = Window.partitionBy(*keys)
    first = df.groupBy(*keys).agg(F.min(ord_col).alias("first_ord"))
    best = df.withColumn("__rn", F.row_number().over(w.orderBy(F.desc_nulls_last(score), ord_col))).where("__rn = 1").drop("__rn")
    return best.join(first, keys)


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def top_global(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def slice_of(df: DataFrame, order: list[Column], size: int, number: int) -> DataFrame:
    """Rows [(number - 1) * size, number * size) of an order, with their rank ``rn``: an early slice sorts the head of the order only."""
    if size * number <= HEAD:
        head = df.orderBy(*order).limit(size * number)
        ranked = head.withColumn("rn", F.row_number().over(Window.orderBy(*order)))
    else:
        ranked = global_rank(df, order)
    return ranked.where((F.col("rn") > size * (number - 1)) & (F.col("rn") <= size * number))


def global_rank(df: DataFrame, order: list[Column], name: str = "rn") -> DataFrame:
    """With the rank from 1 in a total order: range partitions are sorted, and ranked by their own counts' prefix sums.

    No task holds more than its range; what is sent to all has one row for each partition."""
    place = F.monotonically_increasing_id()
    rows = kept(df.orderBy(*order).withColumns({"__part": F.shiftright(place, 33), "__at": place.bitwiseAND((1 << 33) - 1)}))
    counts = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__part", before.alias("__before"))
    return rows.join(F.broadcast(starts), "__part").withColumn(name, F.col("__before") + F.col("__at") + 1).drop("__part", "__at", "__before")


def priority(df: DataFrame, hit: str, composite: str, ord_col: str) -> DataFrame:
    """With ``priority``: hits first, then the larger composite, then the first row."""
    return global_rank(df, [F.desc(hit), F.desc_nulls_last(composite), F.col(ord_col)], "priority")


def beam_stage(df: DataFrame, by: list[str], score: str, order: list[Column], fallback: int = 10) -> DataFrame:
    """Groups with a negative score keep all rows with one and only those; others their best ``fallback`` rows.

    Which groups have one is an aggregate; only the others are ranked, and no further than ``fallback``."""
    rows = df.where(F.col(score) < 0)
    with_one = rows.select(*by).distinct()
    rest = df.join(with_one, by, "left_anti")
    return rows.unionByName(top_per_group(rest, by, order, fallback, "__rn").drop("__rn"))


#: A group of up to this many rows is ranked by one task.
GROUP_ROWS = 1_000_000


def ranks(df: DataFrame, by: list[str], order: list[Column], name: str = "rn", largest: int = GROUP_ROWS) -> DataFrame:
    """With the rank from 1 within each group, in a total order.

    With a group of more than ``largest`` rows the whole is sorted by ranges, so that such a
    group lies in several; a row's rank is its place in its range plus what its group
    has in the ranges before.  No task holds more than its range, whatever the groups."""
    sizes = df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if (sizes or 0) <= largest:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    place = F.monotonically_increasing_id()
    rows = kept(df.orderBy(*by, *order).withColumns({"__part": F.shiftright(place, 33), "__at": place.bitwiseAND((1 << 33) - 1)}))
    pieces = rows.groupBy(*by, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    # a window holds one row for each range that its group reaches into
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col("__part").alias("__in"), "__first", before.alias("__before"))
    same = F.col("__part") == F.col("__in")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    return rows.join(pieces, same).withColumn(name, (F.col("__before") + F.col("__at") - F.col("__first") + 1).cast("int")).select(*df.columns, name)


def drawn(seed: int, *columns: str) -> Column:
    """A row's place in a seeded random order: the MD5 digest of the seed and the columns as text."""
    return F.md5(F.concat_ws("\x00", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]))


def seeded_sample(df: DataFrame, by: list[str], item: str, n: int, seed: int) -> DataFrame:
    """``n`` rows of each group without replacement, by a seeded digest: the same draw wherever and however often it runs."""
    h = drawn(seed, *by, item)
    return top_per_group(df.withColumn("__h", h), by, [F.col("__h"), F.col(item)], n, "__r").drop("__h", "__r")


def balanced(df: DataFrame, group: str, composite: str, docking: str) -> DataFrame:
    """With ``balanced_score``: the mean of both normalised scores; half the composite's for a row without docking, all of it in a group without any.

    Extremes come from a partial aggregate; a large group isn't gathered."""
    lim = df.groupBy(group).agg(F.min(composite).alias("__c0"), F.max(composite).alias("__c1"), F.min(docking).alias("__v0"), F.max(docking).alias("__v1"))
    c = numeric.normalize_high(F.col(composite), F.col("__c0"), F.col("__c1"))
    v = numeric.normalize_low(F.col(docking), F.col("__v0"), F.col("__v1"))
    score = F.when(F.col("__v0").isNull(), c).when(F.col(docking).isNull(), 0.5 * c).otherwise(0.5 * (c + v))
    return df.join(lim, group).withColumn("balanced_score", score).drop("__c0", "__c1", "__v0", "__v1")


def representatives(df: DataFrame, group: str, key: str, keep_fronts: int, picks: int, composite: str = "composite", docking: str = "docking", ord_col: str = "ord") -> DataFrame:
    """Best composite, best docking and best balanced row of each group, then rows of the first fronts in order up to ``picks``.

    A key is taken once; the three best are taken even if ``picks`` is smaller.  ``selection_reason`` lists why, in that order.
    Needs columns pareto_front and balanced_score."""
    # the three best are aggregates; only they and the first fronts' rows are sorted
    o = F.col(ord_col)
    best = df.groupBy(group).agg(
        F.min_by(o, F.struct((-F.col(composite)).alias("s"), o.alias("o"))).alias("__bc"),
        F.min_by(o, F.when(F.col(docking).isNotNull(), F.struct(F.col(docking).alias("s"), o.alias("o")))).alias("__bv"),
        F.min_by(o, F.struct((-F.col("balanced_score")).alias("s"), o.alias("o"))).alias("__bb"),
    )
    flag = lambda c: F.coalesce(o == F.col(c), F.lit(False))
    marked = df.join(best, group).withColumns({"__c": flag("__bc"), "__v": flag("__bv"), "__b": flag("__bb")}).drop("__bc", "__bv", "__bb")
    forced = F.col("__c") | F.col("__v") | F.col("__b")
    pool = marked.where(forced | (F.col("pareto_front") <= keep_fronts)).withColumn("__forced", forced)
    w = Window.partitionBy(group)
    order = [F.asc_nulls_last("pareto_front"), F.desc(composite), F.asc_nulls_last(docking), F.desc("balanced_score"), F.col(key), o]
    # of a key, the row that is reached first: forced ones in order, then by the front order
    reach = F.when(F.col("__c"), 1).when(F.col("__v"), 2).when(F.col("__b"), 3).otherwise(3 + F.row_number().over(w.orderBy(*order)))
    first = keep_first(pool.withColumn("__reach", reach), [group, key], [F.col("__reach")])
    place = F.row_number().over(w.orderBy(F.desc("__forced"), "__reach"))
    taken = first.withColumn("__n", place).where(F.col("__forced") | (F.col("__n") <= picks))
    why = reasons(("best_composite", F.col("__c")), ("best_vina", F.col("__v")), ("best_balanced", F.col("__b")), ("front_pick", ~F.col("__forced")))
    return taken.withColumn("selection_reason", why).drop("__c", "__v", "__b", "__forced", "__reach", "__n")


def score_filter(qed: Column, sa: Column, qed_min: float, sa_max: float, rescue: Column | None = None) -> Column:
    """Whether a design's scores pass; without thresholds (0, and 9.9 or more) all do; rescued ones do anyway."""
    if qed_min <= 0 and sa_max >= 9.9:
        return F.lit(True)
    ok = F.coalesce((qed >= qed_min) & (sa <= sa_max), F.lit(False))
    return ok if rescue is None else F.coalesce(rescue, F.lit(False)) | ok


def geometry_ok(clash: Column, out: Column, most_clash: float = 0.30, most_out: float = 0.25) -> Column:
    """Whether a pose passes the hard limits, which are still allowed themselves."""
    return (clash <= most_clash) & (out <= most_out)


def acceptable(heavy: Column, qed: Column, sa: Column, window: tuple[int, int], qed_min: float, sa_max: float) -> Column:
    """Whether a state is a finished design: its size within the window, its scores good enough."""
    return heavy.between(*window) & (qed >= qed_min) & (sa <= sa_max)


def stage_counts(df: DataFrame, stages: list[tuple[str, Column]], fails: list[str], first_fail: str = "first_fail") -> DataFrame:
    """One row: how many rows reach each stage (all conditions so far hold), and how many each filter removes first."""
    so_far, cols = F.lit(True), []
    for name, passes in stages:
        so_far = so_far & F.coalesce(passes, F.lit(False))
        cols.append(F.count_if(so_far).alias(f"n_{name}"))
    cols += [F.count_if(F.col(first_fail) == f).alias(f"failed_{f}") for f in fails]
    return df.agg(*cols)


def job_counts(jobs: DataFrame, by: list[str], returncode: str, structure: str) -> DataFrame:
    """Structures scanned, jobs attempted, jobs failed, structures skipped (those with no job)."""
    code = F.col(returncode)
    per = jobs.groupBy(*by, structure).agg(F.count(code).alias("a"), F.count_if(code != 0).alias("f"))
    return per.groupBy(*by).agg(F.count("*").alias("n_scanned"), F.sum("a").alias("n_attempted"), F.sum("f").alias("n_failed"), F.count_if(F.col("a") == 0).alias("n_skipped"))


def first_fail(df: DataFrame, rules: list[tuple[str, Column]], rescue: Column | None = None) -> DataFrame:
    """With ``first_fail``: the first rule a row fails, null if it passes; rescued rows pass."""
    label = first_reason(*rules)
    return df.withColumn("first_fail", F.when(~F.coalesce(rescue, F.lit(False)), label) if rescue is not None else label)


def report(df: DataFrame, group: str, selected: DataFrame, composite: str, docking: str, name: str, order: list[Column]) -> DataFrame:
    """Per group: rows, front 1, selected, best scores, and the first row's name and front."""
    base = df.groupBy(group).agg(F.count("*").alias("n_input"), F.count_if(F.col("pareto_front") == 1).alias("n_front1"), F.max(composite).alias("best_composite"), F.min(docking).alias("best_vina"))
    n = selected.groupBy(group).agg(F.count("*").alias("n_selected"))
    top = top_per_group(df, [group], order, 1).select(group, F.col(name).alias("top_name"), F.col("pareto_front").alias("top_pareto_front"))
    return base.join(n, group, "left").join(top, group, "left").withColumn("n_selected", F.coalesce("n_selected", F.lit(0)))
