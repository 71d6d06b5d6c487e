"""Spatial joins: radius, nearest, semi and anti fractions, best pairs.

All are equi-joins on cells as wide as the radius, whose cost follows the data and
which AQE can split where it is skewed; a side that Spark finds small is broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import geometry, numeric
from lodestone.session import kept

from .selection import ranks

AXES = ("x", "y", "z")
CELLS = ["__cx", "__cy", "__cz"]


def d2(a: tuple[str, str, str] = ("ax", "ay", "az"), b: tuple[str, str, str] = ("x", "y", "z")) -> Column:
    return geometry.distance_sq(*[F.col(c) for c in (*a, *b)])


def in_cells(df: DataFrame, prefix: str, width: float, spread: bool) -> DataFrame:
    """Each row in its cell or, with ``spread``, in that and its 26 neighbours."""
    out = df
    for axis, name in zip(AXES, CELLS, strict=True):
        own = F.floor(F.col(prefix + axis) / F.lit(width)).cast("long")
        out = out.withColumn(name, F.explode(F.sequence(own - 1, own + 1)) if spread else own)
    return out


def grid_join(anchors: DataFrame, points: DataFrame, radius: float, on: list[str] | None = None) -> DataFrame:
    """Pairs with squared distance <= radius squared (inclusive), with ``d2``; ``on``: columns that must be equal too.

    Each anchor goes to its 27 neighbouring cells, each point to one."""
    width = max(radius, 1e-9)
    pairs = in_cells(anchors, "a", width, True).join(in_cells(points, "", width, False), [*(on or []), *CELLS])
    return pairs.withColumn("d2", d2()).where(F.col("d2") <= radius * radius).drop(*CELLS)


radius_join = grid_join

#: Rows of a block of anchors and of a block of points in :func:`block_join`; fewer than Spark's buffer of a merge join holds.
ANCHORS, POINTS = 1024, 2048


def block_join(anchors: DataFrame, points: DataFrame, radius: float, anchor: list[str], point: list[str]) -> DataFrame:
    """The pairs of :func:`grid_join`, for sides so dense that a cell holds a good part of all rows: dealt by blocks of anchors and of points.

    A task holds one pair of blocks, however large the tables and however hot a place is.  All rows of
    one ``anchor`` and one ``point`` (a residue, say) meet in one task; grouping by ``__a``, ``__p`` and these shuffles nothing more."""
    pairs = block_pairs(anchors, points, anchor, point)
    return pairs.withColumn("d2", d2()).where(F.col("d2") <= radius * radius)


def block_pairs(anchors: DataFrame, points: DataFrame, anchor: list[str], point: list[str], on: list[str] | None = None, sizes: tuple[int, int] | None = None) -> DataFrame:
    """Every anchor with every point (of equal ``on``), dealt by blocks of at most about ``sizes`` rows; pairs are never shuffled."""
    keys, sizes = on or [], sizes or (ANCHORS, POINTS)
    each = [df.groupBy(*keys).agg(F.count("*").alias(n)) for df, n in ((anchors, "na"), (points, "np"))]
    blocks = lambda n, size: F.ceil(F.col(n) / F.lit(size))
    met = each[0].join(each[1], keys) if keys else each[0].crossJoin(each[1])
    most = met.agg(F.max(blocks("na", sizes[0])), F.max(blocks("np", sizes[1])), F.sum(blocks("na", sizes[0]) * blocks("np", sizes[1]))).first()
    n = [max(1, int(most[0] or 0)), max(1, int(most[1] or 0))]
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    deal = lambda by, k: F.pmod(F.xxhash64(*by), F.lit(k)).cast("int")
    left = anchors.withColumn("__a", deal(anchor, n[0])).withColumn("__p", every(n[1]))
    right = points.withColumn("__p", deal(point, n[1])).withColumn("__a", every(n[0]))
    tasks = min(max(1, int(most[2] or 0)), 10_000)
    by = [*keys, "__a", "__p"]
    return left.repartition(tasks, *by).join(right.repartition(tasks, *by), by)


def alpha_carbons(anchors: DataFrame, atom_rows: DataFrame, cutoff: float, on: list[str] | None = None) -> DataFrame:
    """The radius join on alpha carbons only."""
    return grid_join(anchors, atom_rows.where("record = 'ATOM' and atom_name = 'CA'"), cutoff, on)


def min_distances(anchors: DataFrame, points: DataFrame, by: list[str], kind: str | None = None) -> DataFrame:
    """The least distance from each anchor (columns ``by``) to any point (of equal ``kind``); +inf without points.

    Grid joins of doubling radius, from a thirty-second of what the data span (see :func:`nearest`)."""
    rows = kept(anchors.withColumn("__anchor", F.struct(*by)))
    others = kept(points)
    out = nearest(rows, others, "__anchor", max(reach(rows, others) / 32, 1e-6), [kind] if kind else None)
    return out.groupBy("__anchor").agg(F.min("dist").alias("dist")).select("__anchor.*", "dist")


def reach(anchors: DataFrame, points: DataFrame) -> float:
    """A distance that no anchor and point exceed; 0 if there are none."""
    ends = lambda df, p: df.agg(*[f(p + c) for c in AXES for f in (F.min, F.max)]).first()
    a, b = ends(anchors, "a"), ends(points, "")
    if a[0] is None or b[0] is None:
        return 0.0
    return math.sqrt(sum(max(a[2 * i + 1] - b[2 * i], b[2 * i + 1] - a[2 * i]) ** 2 for i in range(3)))


def nearest(anchors: DataFrame, points: DataFrame, anchor_id: str, start: float, on: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """(anchor_id, on..., dist) with two large sides: grid joins of doubling radius for the anchors that aren't settled yet.

    Within a radius that holds a point at all, the nearest is exact.  The radius grows until
    it covers all points; an anchor without any then has +inf.  ``where``: what a pair has to meet."""
    keys = [anchor_id, *(on or [])]
    whole, radius = reach(anchors, points), start
    open_, done = anchors, None
    while True:
        pairs = grid_join(open_, points, radius, on)
        found = kept((pairs if where is None else pairs.where(where)).groupBy(*keys).agg(F.sqrt(F.min("d2")).alias("dist")))
        done = found if done is None else done.unionByName(found)
        open_ = kept(open_.join(found.select(*keys), keys, "left_anti"))
        if radius > whole or open_.isEmpty():
            break
        radius *= 2
    return done.unionByName(open_.select(*keys, F.lit(float("inf")).alias("dist")))


def nearest_by_kind(anchors: DataFrame, points: DataFrame, anchor_id: str, kind: str, kinds: list, start: float, where: Column | None = None) -> DataFrame:
    """(anchor_id, kind, dist): the nearest point of each of the given kinds."""
    wanted = anchors.withColumn(kind, F.explode(F.array(*[F.lit(k) for k in kinds])))
    return nearest(wanted, points, anchor_id, start, [kind], where)


def near_any(atoms: DataFrame, obstacles: DataFrame, radius: float) -> DataFrame:
    """Atoms with an obstacle within the radius (inclusive): a semi join on cells, obstacles spread over 27 of them."""
    width = max(radius, 1e-9)
    own = in_cells(atoms.withColumns({c: F.col("a" + c) for c in AXES}), "", width, False).drop(*AXES)
    other = in_cells(obstacles.select(*[F.col(c).alias("a" + c) for c in AXES]), "a", width, True).withColumnsRenamed({"a" + c: c for c in AXES})
    same = [F.col(f"o.{c}") == F.col(f"p.{c}") for c in CELLS]
    dist = geometry.distance_sq(*[F.col(f"o.a{c}") for c in AXES], *[F.col(f"p.{c}") for c in AXES])
    return own.alias("o").join(other.alias("p"), [*same, dist <= radius * radius], "left_semi").drop(*CELLS)


def clash_fraction(atoms: DataFrame, obstacles: DataFrame, by: str, radius: float) -> DataFrame:
    """Share of a molecule's atoms with an obstacle within the radius (inclusive)."""
    hit = near_any(atoms, obstacles, radius).groupBy(by).agg(F.count("*").alias("n_hit"))
    total = atoms.groupBy(by).agg(F.count("*").alias("n"))
    return total.join(hit, by, "left").select(by, "n", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), numeric.ratio_zero(F.coalesce("n_hit", F.lit(0)), F.col("n")).alias("clash_frac"))


def outside_fraction(atoms: DataFrame, by: str, centre: tuple[float, float, float], radius: float) -> DataFrame:
    x, y, z = (F.lit(float(v)) for v in centre)
    away = geometry.distance_sq(F.col("ax"), F.col("ay"), F.col("az"), x, y, z) > radius * radius
    return atoms.groupBy(by).agg(F.avg(F.when(away, 1.0).otherwise(0.0)).alias("out_frac"))


def match_fraction(n_match: Column, n_total: Column, unmatched_weight: float) -> Column:
    """(matched - w * unmatched) / total between 0 and 1; 0 without features."""
    raw = (n_match - unmatched_weight * (n_total - n_match)) / F.nullif(n_total, F.lit(0))
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), F.lit(0.0))


def best_pairs(features: DataFrame, sites: DataFrame, feature_id: list[str], kind: str, score: Column, maximum: float) -> DataFrame:
    """Each feature's best score among the sites of its kind nearer than ``maximum``; 0 if there is none."""
    near = grid_join(features, sites, maximum, [kind]).where(F.col("d2") < maximum * maximum)
    best = near.groupBy(*feature_id).agg(F.max(score).alias("best"))
    return features.select(*feature_id).distinct().join(best, feature_id, "left").select(*feature_id, F.greatest(F.lit(0.0), F.coalesce("best", F.lit(0.0))).alias("best"))


def cross_counts(left: DataFrame, right: DataFrame, radius: float, donor: tuple[Column, Column], acceptor: tuple[Column, Column], where: Column | None = None) -> DataFrame:
    """Pairs within the radius: donor with acceptor, acceptor with donor, and both together (one row).

    ``donor`` and ``acceptor`` say what a row of the left and of the right side is."""
    pairs = grid_join(left, right, radius)
    pairs = pairs if where is None else pairs.where(where)
    one, two = donor[0] & acceptor[1], acceptor[0] & donor[1]
    return pairs.agg(F.count_if(one).alias("donor_acceptor"), F.count_if(two).alias("acceptor_donor"), (F.count_if(one) + F.count_if(two)).alias("hbonds"))


def hydrogen_bond_score(dist: Column, ligand_dir: Column, site_dir: Column, to_site: Column, maximum: float, preferred: float = 2.8) -> Column:
    """Distance window times both alignments; a missing direction aligns fully."""
    ligand = F.when(ligand_dir.isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), geometry.dot(ligand_dir, to_site)))
    site = F.when(site_dir.isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), -geometry.dot(site_dir, to_site)))
    return numeric.window_score(dist, preferred, maximum) * (0.35 + 0.65 * ligand) * (0.35 + 0.65 * site)


def stacking_score(dist: Column, normal_a: Column, normal_b: Column, maximum: float, preferred: float = 4.2) -> Column:
    return numeric.window_score(dist, preferred, maximum) * F.abs(geometry.dot(normal_a, normal_b))


def interaction_total(hbond: Column, stacking: Column) -> Column:
    """The mean of the components that are there."""
    n = F.when(hbond.isNotNull(), 1).otherwise(0) + F.when(stacking.isNotNull(), 1).otherwise(0)
    return F.coalesce((F.coalesce(hbond, F.lit(0.0)) + F.coalesce(stacking, F.lit(0.0))) / F.nullif(n, F.lit(0)), F.lit(0.0))


def tolerance_match(points: DataFrame, members: DataFrame, by: list[str], group: str, tolerance: float) -> DataFrame:
    """Points of each ``by`` that have a member of each group within the tolerance; a point can count for several groups."""
    hit = block_join(points, members, tolerance, by, ["point_id"])
    return hit.select("__a", "__p", *by, "point_id", group).distinct().groupBy(*by, group).agg(F.count("*").alias("n_match"))


def grouped_rank(df: DataFrame, by: list[str], order: list[Column], name: str = "rn") -> DataFrame:
    return ranks(df, by, order, name)
