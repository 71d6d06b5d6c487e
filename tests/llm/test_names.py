"""Input columns called like the operators' own inner names: kept as they are, and no result changes."""

import pytest
from helpers import MODEL, docs
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import align, decontam, langid, neardup, pii, secrets, sentencepieces, sharding, tokencount, toxicity, wrappers

INNER = [
    "__base", "__own", "__free", "__key", "__remove", "__generalise", "__b", "__blob", "__findings", "__copy", "__copies", "__run", "__hash", "__stratum", "__bucket", "__share", "__slice", "__n", "__before", "__rows", "__first",
    "__html", "__host", "__roles", "__lang", "__score", "__uid", "row", "known", "own", "of_blob", "text_key", "c0", "c1", "t", "near", "words", "chunk", "pairs", "key", "uid", "segment", "ord", "item",
]
TEXTS = ["mail bob@example.com now to Bob Miller", "token = abcdefgh1234 here", None, "", "plain words in a row and some more of them", "plain words in a row and some more of them"]


def with_inner(df):
    return df.withColumns({c: F.lit(f"own {c}") for c in INNER})


def same(got, want, columns):
    """Equal rows in the columns of the plain input, and every inner name kept."""
    rows = got.collect()
    assert all(r[c] == f"own {c}" for r in rows for c in INNER if c in got.columns)
    assert set(INNER) <= set(got.columns)
    key = lambda r: str(tuple(r[c] for c in columns))
    assert sorted(map(key, rows)) == sorted(key(r) for r in want.collect())


APPLY = {
    "sanitise": lambda df: pii.sanitise(df),
    "scan": lambda df: secrets.scan(df),
    "shard": lambda df: sharding.shard(df, "source", 3).select(*df.columns, "shard"),
    "align": lambda df: align.align(df, "/opt/tokenizers/byte_bpe_50k.json", MODEL),
    "encode": lambda df: sentencepieces.encode(df, MODEL),
    "count": lambda df: tokencount.count_tokens(df, MODEL),
    "toxicity": lambda df: toxicity.score(df, toxicity.Model({"row": (0.5,)})),
    "extract": lambda df: wrappers.extract(df.withColumn("html", F.concat(F.lit("<p>"), "text")).withColumn("url", F.lit("http://a/b")).drop("text")),
}


@pytest.mark.parametrize("name", sorted(APPLY))
def test_operators_keep_columns_called_like_theirs(spark, name):
    plain = docs(spark, TEXTS, extra=False)
    want = APPLY[name](plain)
    got = APPLY[name](with_inner(plain))
    if name == "shard":  # the draw is over all columns, so only the law holds
        assert sorted(r["shard"] for r in got.collect()) == [0, 0, 1, 1, 2, 2] and set(INNER) <= set(got.columns)
        return
    same(got, want, want.columns)


def test_identify_and_near_duplicates(spark):
    plain = docs(spark, TEXTS, extra=False)
    model = langid.train(plain, MODEL)
    same(langid.identify(with_inner(plain), model), langid.identify(plain, model), [*plain.columns, "lang_pred", "score"])
    ids = neardup.near_duplicates(with_inner(plain), id_col="doc_id")
    assert sorted(map(tuple, ids.collect())) == sorted(map(tuple, neardup.near_duplicates(plain, id_col="doc_id").collect()))


def test_pipeline_stages(spark, tmp_path):
    plain = docs(spark, TEXTS, extra=False).withColumn("n_chars", F.length("text").cast("long"))
    spark.createDataFrame([(1, "plain words in a row and some more of them")], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        want, got = stage(spark, plain, str(tmp_path)), stage(spark, with_inner(plain), str(tmp_path))
        columns = [c for c in want.columns if c not in INNER]
        if name == "near_duplicates":
            columns = ["text"]
        same(got, want, columns)


def test_names_that_results_take_and_phrases_that_are_too_long(spark):
    df, item = docs(spark, ["a b c"], extra=False), spark.createDataFrame([(1, "word " * (decontam.GAP + 1))], "item_id long, text string")
    with pytest.raises(ValueError, match="called like"):
        decontam.decontaminate(df.withColumn("hits", F.lit(1)), item, ["hits"])
    with pytest.raises(ValueError, match="words at most"):
        decontam.search(df, item, ["doc_id"])
