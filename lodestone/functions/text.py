"""Reasons, labels, signatures, and scores found in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import lenient_double

# Property names that hold a score, in order of preference, and their direction.
SCORE_HINTS = ["vina_score", "docking_score", "binding_energy", "affinity", "minimizedaffinity", "cnnscore", "delta_g", "composite", "composite_grower", "score", "energy", "SA_score", "SA"]
HIGHER_IS_BETTER = ["cnnscore", "composite", "composite_grower"]
SCORE_WORDS = r"score|affinity|energy"
NUMBER = r"[-+]?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?"


def reasons(*flags: tuple[str, Column]) -> Column:
    """The names of the flags that hold, in the given order, each once, joined by ';'."""
    return F.array_join(F.array_distinct(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in flags]), lambda x: x.isNotNull())), ";")


def first_reason(*rules: tuple[str, Column]) -> Column:
    """The first rule that fails a row, null if none does."""
    out = F.when(rules[0][1], F.lit(rules[0][0]))
    for name, failed in rules[1:]:
        out = out.when(failed, F.lit(name))
    return out


def content_signature(*parts: Column, method: str = "md5") -> Column:
    """A digest of parts joined by a NUL character; null parts count as empty."""
    whole = F.concat_ws("\x00", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.md5(whole) if method == "md5" else F.sha2(whole, 256)


def score_of(props: Column, block: Column) -> Column:
    """struct(score, source): the first hinted property with a number, else any property named like a score, else a number in a line of text that is, else 0."""
    hinted = [F.struct(lenient_double(F.try_element_at(props, F.lit(h))).alias("score"), F.lit(h).alias("source")) for h in SCORE_HINTS]
    numeric = lambda pairs: F.filter(pairs, lambda s: s["score"].isNotNull())
    like = F.transform(F.filter(F.map_entries(props), lambda e: F.lower(e["key"]).rlike(SCORE_WORDS)), lambda e: F.struct(lenient_double(e["value"]).alias("score"), e["key"].alias("source")))
    lines = F.split(block, r"\r?\n")
    # a header line "> <...score...>" gives the next line, any other line its last number
    headed = F.transform(lines, lambda s, i: F.struct(F.when(F.lower(s).rlike(rf"^\s*>.*(?:{SCORE_WORDS})"), lenient_double(F.get(lines, i + 1))).alias("score"), F.trim(s).alias("source")))
    inline = F.transform(
        F.filter(lines, lambda s: F.lower(s).rlike(SCORE_WORDS)),
        lambda s: F.struct(F.get(F.filter(F.transform(F.reverse(F.split(F.trim(F.translate(s, "=:", "  ")), r"\s+")), lenient_double), lambda x: x.isNotNull()), 0).alias("score"), F.lit("inline_text").alias("source")),
    )
    found = numeric(F.concat(F.array(*hinted), like, headed, inline))
    return F.coalesce(F.get(found, 0), F.struct(F.lit(0.0).alias("score"), F.lit("default_0.0").alias("source")))


def docking_score(log: Column) -> Column:
    """The score in a docking log, by two patterns in order."""
    patterns = [r"Estimated Free Energy of Binding\s*:\s*(-?\d+(?:\.\d+)?)", r"Affinity:\s*(-?\d+(?:\.\d+)?)"]
    return F.coalesce(*[lenient_double(F.regexp_extract(log, p, 1)) for p in patterns])


def role_of(molecule: Column, keywords: list[str]) -> Column:
    """Whether a molecule's name holds any keyword, in upper case."""
    return F.exists(F.array(*[F.lit(k.upper()) for k in keywords]), lambda k: F.contains(F.upper(F.coalesce(molecule, F.lit(""))), k))


def looks_like_structure(text: Column) -> Column:
    return text.rlike(r"(?m)^(ATOM  |HETATM)")


def run_name(*parts: tuple[str, Column]) -> Column:
    return F.concat_ws("_", *[F.concat(F.lit(n), c.cast("string")) for n, c in parts])
