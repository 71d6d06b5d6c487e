"""Secret scans with an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text.  A ledger
table holds, for each pair of blob and rule version, the findings; a scan takes
only blobs that have no row for the current rules, each once however many paths
and versions share it, appends their rows and joins findings back to all paths.
Only DataFrame functions run here.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch
from .native import joined, spans

#: The contract's rules.  A whole match is the span; a match that fails its length is dropped without a retry.
BASE = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)""",
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
}
#: Rules that the ledger's rule set has besides: public token formats.
MORE = {
    "pem": r"-----BEGIN (?:[A-Z0-9]{1,20} ){0,4}PRIVATE KEY-----",
    "github": r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}+",
    "slack": r"(?<![A-Za-z0-9_])xox[abprs]-[A-Za-z0-9-]{10,}+",
    "jwt": r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
}
#: A text without this can't match.
NEEDS = {"access": "AKIA", "pem": "PRIVATE KEY-----", "slack": "xox", "jwt": "eyJ", "github": "gh"}
KINDS = [*BASE, *MORE]
#: Group 2 of an assignment has as many characters at least.
SHORTEST = 6
RULES = hashlib.sha256(repr((BASE, MORE, NEEDS, SHORTEST)).encode()).hexdigest()[:16]
FINDINGS = "array<struct<start:int,no:int,end:int,kind:string>>"
LEDGER = f"blob string, rules string, findings {FINDINGS}"


def findings(text: Column) -> Column:
    """All spans of a text, ordered by start, then by kind as listed."""

    def of(kind: str, pattern: str) -> Column:
        found = spans(text, pattern)
        if kind == "assign":
            found = F.filter(found, lambda s: F.length(F.regexp_extract(s["value"], BASE["assign"], 1)) >= SHORTEST)
        no = KINDS.index(kind)
        out = F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("no"), s["end"].alias("end"), F.lit(kind).alias("kind")))
        if kind in NEEDS:
            out = F.when(F.contains(text, F.lit(NEEDS[kind])), out).otherwise(F.expr(f"cast(array() as {FINDINGS})"))
        return out.cast(FINDINGS)

    return F.array_sort(F.flatten(F.array(*[of(k, p) for k, p in (BASE | MORE).items()])))


def scan(versions: DataFrame, text_col: str = "text", ledger: str | None = None) -> DataFrame:
    """``versions`` with the columns blob and findings; other columns stay as they are.

    ``ledger``: folder of the ledger table (created when missing; appended to);
    None: a new one in the shared folder.  A null text is the empty blob.  Repeated
    rows each get their findings.  An empty table gives an empty table.
    """
    spark = versions.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    ledger = ledger or f"{scratch(spark)}/ledger-{uuid.uuid4().hex}"
    # schema given: reading a ledger that holds no file yet is an empty table, not an error
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(ledger)
    seen = spark.read.schema(LEDGER).parquet(ledger).where(F.col("rules") == RULES)
    blobs = versions.select(F.sha2(text, 256).alias("blob"), text.alias("content"))
    unseen = blobs.join(seen.select("blob"), "blob", "left_anti").groupBy("blob").agg(F.first("content").alias("content"))
    unseen.select("blob", F.lit(RULES).alias("rules"), findings(F.col("content")).alias("findings")).write.mode("append").parquet(ledger)
    known = spark.read.schema(LEDGER).parquet(ledger).where((F.col("rules") == RULES) & (F.size("findings") > 0))
    # two scans at once may both append a pair: one row of it counts
    known = known.groupBy(F.col("blob").alias("known")).agg(F.first("findings").alias("of_blob"))
    # the input's columns travel in one, so that none of their names meets one of ours; those named like a result give way
    names = [c for c in versions.columns if c.lower() not in ("blob", "findings")]
    rows = versions.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row") if names else F.lit(None).alias("row"), F.sha2(text, 256).alias("own"))
    out = rows.join(known, F.col("own") == F.col("known"), "left")
    none = F.expr(f"cast(array() as {FINDINGS})")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in names], F.col("own").alias("blob"), F.coalesce("of_blob", none).alias("findings"))


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns of :func:`scan`'s result."""
    base = F.filter("findings", lambda s: s["no"] < len(BASE))
    count = lambda k: F.size(F.filter("findings", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return scanned.select(F.col(id_col), *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))
