"""Profiles of what surrounds an anchor: class counts, ratios, histograms, chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.numeric import ratio_nan, ratio_null

METRICS = ["n_residues", "n_pos", "n_neg", "pos_over_posneg", "n_polar", "n_apolar", "polar_over_polarapolar", "n_aromatic", "n_nonaromatic", "aromatic_fraction"]


def residues(near: DataFrame, by: list[str], keep: list[str]) -> DataFrame:
    """Distinct residues of radius-join rows with their least squared distance."""
    return near.groupBy(*by, "resid").agg(F.min("d2").alias("min_d2"), *[F.first(c).alias(c) for c in keep])


def counts(flags: dict[str, Column]) -> list[Column]:
    pos, neg, polar, apolar, aromatic = (F.count_if(flags[k]) for k in ("is_pos", "is_neg", "is_polar", "is_apolar", "is_aromatic"))
    n = F.count("*")
    return [
        n.alias("n_residues"),
        pos.alias("n_pos"),
        neg.alias("n_neg"),
        ratio_null(pos, pos + neg).alias("pos_over_posneg"),
        polar.alias("n_polar"),
        apolar.alias("n_apolar"),
        ratio_null(polar, polar + apolar).alias("polar_over_polarapolar"),
        aromatic.alias("n_aromatic"),
        (n - aromatic).alias("n_nonaromatic"),
        ratio_null(aromatic, n).alias("aromatic_fraction"),
    ]


def profile(res: DataFrame, by: list[str], flags: dict[str, Column]) -> DataFrame:
    return res.groupBy(*by).agg(*counts(flags))


def profile_by_chain(res: DataFrame, by: str, chain: str, flags: dict[str, Column]) -> DataFrame:
    """Whole environments (chain null) and each chain's part, in one pass over the rows."""
    return res.groupingSets([[by], [by, chain]], by, chain).agg(*counts(flags))


def histogram(res: DataFrame, by: list[str], name: str) -> DataFrame:
    """'NAME:n;...' by count descending, then name."""
    n = res.groupBy(*by, name).agg(F.count("*").alias("__n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("__n")).alias("k"), F.col(name).cast("string").alias("name"))))
    return n.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda s: F.concat(s["name"], F.lit(":"), (-s["k"]).cast("string"))), ";").alias("residue_hist"))


def top_chains(by_chain: DataFrame, by: str, chain: str, values: list[str], k: int = 2) -> DataFrame:
    """The ``k`` chains with most residues (ties by chain) side by side: chain1_*, chain2_*, null where there are fewer."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n_residues"), chain))
    ranked = by_chain.where(F.col(chain).isNotNull()).withColumn("__place", place).where(F.col("__place") <= k)
    one = lambda i, c: F.max(F.when(F.col("__place") == i, F.col(c)))
    return ranked.groupBy(by).agg(*[one(i, c).alias(f"chain{i}_{'id' if c == chain else c}") for i in range(1, k + 1) for c in (chain, *values)])


def two_roles(res: DataFrame, by: list[str], role: str, first: str, second: str, flags: dict[str, Column], bfactor: str) -> DataFrame:
    """Counts of two roles side by side, mean of per-residue B-factors, and their ratios (null on 0).

    ``res``: a row for each residue, ``bfactor`` its mean (see :func:`residue_means`)."""
    mine = lambda r, c: F.count_if((F.col(role) == r) & c)
    whole = F.lit(True)
    pairs = {"N": whole, "apolar": flags["is_apolar"], "polar": flags["is_polar"], "aromatic": flags["is_aromatic"], "aliphatic": flags["is_aliphatic"]}
    cols = [mine(r, c).alias(f"{n}_{r}") for r in (first, second) for n, c in pairs.items()]
    cols += [F.round(F.avg(F.when(F.col(role) == r, F.col(bfactor))), 2).alias(f"mean_bfactor_{r}") for r in (first, second)]
    cols += [F.nullif(ratio_nan(mine(first, c), mine(second, c)), F.lit(float("nan"))).alias(f"ratio_{n}") for n, c in pairs.items()]
    return res.groupBy(*by).agg(*cols)


def residue_means(atoms: DataFrame, residue: list[str], bfactor: str, into: str = "bfactor") -> DataFrame:
    """The mean B-factor of each residue's atoms; so a residue counts once whatever its size."""
    return atoms.groupBy(*residue).agg(F.avg(bfactor).alias(into))


def secondary_structure(res: DataFrame, by: list[str], role: str, code: str) -> DataFrame:
    """Helix (H, G, I), sheet (E, B) and loop (anything else, or no code) counts per role."""
    c = F.coalesce(F.col(code), F.lit("-"))
    return res.groupBy(*by, role).agg(F.count_if(c.isin("H", "G", "I")).alias("helix"), F.count_if(c.isin("E", "B")).alias("sheet"), F.count_if(~c.isin("H", "G", "I", "E", "B")).alias("loop"))


def chain_pair(atoms: DataFrame, by: str) -> DataFrame:
    """The two chains with most atoms, ties by first line: (by, place, chain)."""
    n = atoms.groupBy(by, "chain").agg(F.count("*").alias("n"), F.min("line_no").alias("first"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "first"))).where("place <= 2").select(by, "place", "chain")
