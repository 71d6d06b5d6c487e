"""Plain versions of the contracts, and rows with the awkward cases."""

import hashlib
import re

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MODEL = "/opt/tokenizers/piece_bpe_32k.model"

ODD = [
    None,
    "",
    " ",
    "  \n\t ",
    "...!!! 123 ???",
    "a",
    "Ärger im Büro, ÄÖÜ straße",
    "one two three four five six",
    "one two three four five six",
    "ONE TWO THREE FOUR FIVE SIX",
    "x" * 5000,
    "word " * 3000,
    "0 1 2 3 4 5 6 7 8 9 " * 400,
    "tab\tand  double   spaces and ▁ marker ",
    "emoji 😀 and 漢字 and ́ combining",
    "trailing spaces   ",
    "   leading spaces",
    "@" * 300 + "a@b",
    "1.1.1." * 500,
    "+" * 200,
]


def words(text):
    return WORD.findall((text or "").translate(LOW))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def docs(spark, texts=None, extra=True, first=0):
    """Documents with null and repeated ids and, with ``extra``, columns whose names clash with results."""
    texts = ODD if texts is None else texts
    rows = [(first + i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit(i) for i, c in enumerate(["score", "spans", "ids", "n_tokens", "set_key", "blob", "findings", "id", "term", "t", "hits", "shard", "size", "base", "near"])})
    return df
