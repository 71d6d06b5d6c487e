"""Iterative beam search over candidates: expand, keep the best of each key, rank, harvest, truncate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import numeric
from lodestone.session import kept

from . import pareto, selection
from .selection import keep_first, top_per_group


def beam_search(
    seeds: DataFrame,
    expand: Callable[[DataFrame], DataFrame],
    *,
    group: str,
    key: str,
    order: list[Column],
    accept: Column,
    grows: Column,
    beam_width: int,
    steps: int,
    max_output: int,
    stage: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Accepted states of all groups, ``max_output`` of each, with ``growth_step`` and ``rank``.

    All groups grow in one job.  ``expand`` turns the beam into candidates with the same
    columns; of equal keys the best stays; ``stage`` may then drop candidates; what
    ``accept`` holds for and wasn't accepted before is harvested; what ``grows`` holds for
    goes on, ``beam_width`` a group.  A group that has ``max_output`` states after a step
    stops there; its states are ranked before they are cut.
    A step costs one small action, the test whether any state is left."""
    beam, done = seeds.withColumn("growth_step", F.lit(0)), None
    for step in range(1, steps + 1):
        grown = expand(beam.drop("growth_step")).withColumn("growth_step", F.lit(step))
        best = keep_first(grown, [group, key], order)
        best = kept(best if stage is None else stage(best))
        fresh = best.where(accept)
        if done is not None:
            fresh = fresh.join(done.select(group, key), [group, key], "left_anti")
        done = kept(fresh if done is None else done.unionByName(fresh))
        full = done.groupBy(group).agg(F.count("*").alias("__n")).where(F.col("__n") >= max_output).select(group)
        beam = kept(top_per_group(best.where(grows).join(full, group, "left_anti"), [group], order, beam_width, "__n").drop("__n"))
        if beam.isEmpty():
            break
    return top_per_group(done, [group], order, max_output, "rank")


def ranked(states: DataFrame, group: str, docking: str | None, beam_stage: bool, ord_col: str = "ord", composite: str = "composite") -> DataFrame:
    """States with ``rank``: by composite; with docking scores within a beam by those, binding states alone if there are any
    (else the best ten), and at the end by front."""
    by_score = [F.asc_nulls_last(docking), F.desc(composite), F.col(ord_col)] if docking else [F.desc(composite), F.col(ord_col)]
    if docking and beam_stage:
        states = selection.beam_stage(states, [group], docking, by_score)
    elif docking:
        states = pareto.fronts(states, group, composite, docking)
        by_score = [F.col("pareto_front"), F.desc(composite), F.asc_nulls_last(docking), F.col(ord_col)]
    return top_per_group(states, [group], by_score, 2**31 - 1, "rank")


def seeds(anchors: DataFrame, keep: list[str]) -> DataFrame:
    """One state for each anchor: a carbon atom at its place, at step 0."""
    atom = F.struct(F.lit("C").alias("elem"), F.col("ax").alias("x"), F.col("ay").alias("y"), F.col("az").alias("z"), F.lit(4).alias("free_h"))
    return anchors.select(*keep, F.lit("C").alias("smiles"), F.array(atom).alias("atoms"), F.lit(0).alias("growth_step"))


def made(poses: DataFrame, ph4_weight: float = 0.0, interaction_weight: float = 0.0) -> DataFrame:
    """States of embedded poses (QED, SA_score, clash_frac, out_frac, ph4, interaction): hard geometric limits first, then ``composite``.

    A pose that could not be embedded has no clash_frac and goes."""
    base = numeric.composite(F.col("QED"), F.col("SA_score"), F.col("clash_frac"), F.col("out_frac"))
    return poses.where(selection.geometry_ok(F.col("clash_frac"), F.col("out_frac"))).withColumn("composite", numeric.composite_extended(base, F.col("ph4"), ph4_weight, F.col("interaction"), interaction_weight))


def extendable(atoms: str, states: DataFrame) -> DataFrame:
    """One row for each heavy atom with a free hydrogen: (state, attach index)."""
    out = states.select("*", F.posexplode(atoms).alias("attach", "atom"))
    return out.where("atom.free_h > 0 and atom.elem <> 'H'").drop("atom")


def expansions(states: DataFrame, fragments: DataFrame, group: list[str], max_attach: int, max_frags: int, seed: int) -> DataFrame:
    """Each state at up to ``max_attach`` positions with up to ``max_frags`` fragments, drawn by a seeded digest."""
    h = lambda salt, *c: selection.drawn(seed + salt, *c)
    spots = top_per_group(states.withColumn("__h", h(0, *group, "attach")), group, [F.col("__h"), F.col("attach")], max_attach, "__r").drop("__h", "__r")
    pairs = spots.crossJoin(F.broadcast(fragments))  # a library of a few dozen rows
    drawn = pairs.withColumn("__h", h(1, *group, "attach", "name"))
    return top_per_group(drawn, [*group, "attach"], [F.col("__h"), F.col("name")], max_frags, "__r").drop("__h", "__r")
