"""Toxicity: the automata against plain edit distances, whole scores against a plain version, held-out accuracy."""

import random
import re
import zlib

import pytest
from helpers import ODD, docs

from lodestone.llm import queries as Q
from lodestone.llm import toxicity as X


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("seed", range(3))
def test_automata_find_what_edit_distances_find(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randrange(0, 9)))
    lexicon = sorted({w for _ in range(120) if (w := word())})
    trie = X.Trie(lexicon)
    for w in [word() for _ in range(80)]:
        for k in (0, 1, 2):
            assert sorted(trie.within(w, k)) == sorted((d, t) for t in lexicon if (d := distance(w, t)) <= k)


def plain_score(text, model):
    """Every word against every term."""
    best, uses = {}, {}
    lower = (text or "").lower()
    whole = [t for t in model.terms if not t.endswith("*")]
    stems = [t for t in model.terms if t.endswith("*")]
    for m in re.finditer(r"[^\W_]+(?:[@$!*]+[^\W_]+)*", lower):
        w = m[0]
        use = model.windows[X.window(lower, m.start(), m.end())]
        direct = [w] if w in whole else sorted((s for s in stems if w.startswith(s[:-1])), key=len)[-1:]
        if direct:
            uses.setdefault(direct[0], []).append(use)
            continue
        squeezed = re.sub(r"(.)\1{2,}", r"\1", w)
        masked = squeezed != w or re.search(r"[0-9@$!*]", w) is not None
        near = []
        for t in whole:
            d = min(distance(w, t), distance(squeezed, t))
            if d <= (2 if len(t) >= 9 else 1 if len(t) >= (4 if masked else 5) else 0):
                near.append((d, t))
        if near:
            t = min(near)[1]
            best[t] = max(best.get(t, 0), model.forms.get(w, model.unseen["masked" if masked else "edited"] * max(model.terms[t])) * use)
    for t, some in uses.items():
        for n in range(1, len(some) + 1):
            best[t] = max(best.get(t, 0), max(model.terms[t][:n]) * sorted(some)[-n])
    clean = 1 - model.none
    for t in sorted(best):
        clean *= 1 - best[t]
    return 1 - clean


MODEL = X.Model(
    {"idiot": (0.9, 0.9, 0.95), "scum": (0.3, 0.6, 0.8), "worthless": (0.95,), "lowei*": (0.7, 0.8, 0.9), "lo*": (0.0, 0.0, 0.6), "trash": (0.6, 0.7, 0.7)},
    {"idion": 0.01, "tr4sh": 0.5}, {"edited": 0.4, "masked": 0.8}, {"plain": 1.0, "cited": 0.6, "quoted": 0.2}, 0.05,
)


def test_scores_equal_plain_version(spark):
    rng = random.Random(1)
    words = ["idiot", "Idiot!", "id1ot", "idion", "ideot", "idiooooot", "scum", "scun", "5cum", "s*cum", "wort_less", "worthles", "wortless", "w0rthl3ss", "loweient", "lo", "lorem", "TRASH", "trasch", "tr4sh", "the", "of", "said", '"idiot"', "“worthless”", "\n", "“"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 12))) for _ in range(400)] + ODD
    df = docs(spark, texts)
    got = X.score(df, MODEL)
    assert set(got.columns) == set(df.columns) | {"score", "predicted", "terms"}
    rows = {r["doc_id"]: r for r in got.collect()}
    for i, t in enumerate(texts):
        assert rows[i]["text"] == t and rows[i]["score"] == pytest.approx(plain_score(t, MODEL), abs=1e-12) and rows[i]["predicted"] == int(rows[i]["score"] >= 0.3)
    assert X.score(df.where("false"), MODEL).count() == 0


def test_windows_tell_quotation_from_abuse():
    def use(text):
        m = re.search("idiot", text)
        return X.window(text, m.start(), m.end())

    assert use("you are an idiot and more") == "plain"
    assert use('he was called "a right idiot" there') == "quoted" and use("« un idiot »") == "quoted" and use("„der idiot“ da") == "quoted"
    assert use('"so" you idiot "there"') == "plain"
    assert use('"open\nidiot" next line') == "plain"
    assert use("they wrote idiot on it") == "cited" and use("swords idiot") == "plain"


def test_training_learns_terms_stems_spellings_and_windows(spark):
    rng = random.Random(2)
    plain = lambda: " ".join("".join(rng.choice(["ka", "lo", "mi", "ter", "un"]) for _ in range(rng.randrange(1, 4))) for _ in range(30))
    rows = []
    for i in range(400):
        toxic = i % 4 == 0
        word = rng.choice(["blarg", "frumph", "snorkle" + rng.choice("abcdefgh"), "bl4rg"]) if toxic else rng.choice(["", 'they said "blarg" once', "frumpy"])
        rows.append((i, f"{plain()} {word} {plain()}", int(toxic)))
    rows += [(1000, None, 1), (1001, "", 0), (None, "blarg", 1), (1002, "x", None), (1003, "y", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = X.train(df.drop("toxic"), df.select("doc_id", "toxic"))
    assert {"blarg", "frumph", "snorkle*"} <= set(model.terms) and model.windows["quoted"] < 0.1
    assert model.forms["frumpy"] < 0.1 and model.none < 0.1
    say = spark.createDataFrame([(1, "oh blarg"), (2, 'she said "blarg" then'), (3, "a frumpy ka"), (4, "snorkles"), (5, "ka lo")], "doc_id long, text string")
    assert [r["predicted"] for r in X.score(say, model).orderBy("doc_id").collect()] == [1, 0, 0, 1, 0]


def test_no_labels_and_one_label(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    none = X.train(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.terms == {} and [r["score"] for r in X.score(df, none).collect()] == [0.0, 0.0]
    one = X.train(df, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert one.terms == {} and one.none == 1.0


def test_held_out_accuracy(spark):
    """Labels of held-out documents of a given table, which the model hasn't seen."""
    sf = "/root/testdata/sf0.1"
    out = {r["doc_id"]: r for r in Q.op13_toxicity(spark, sf).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in Q.table(spark, sf, "labels").collect()}
    assert len(out) == Q.table(spark, sf, "documents").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for i, r in out.items())
    held = [(labels[i], r["predicted"]) for i, r in out.items() if r["held_out"] and i in labels]
    hit, wrong = sum(y and p for y, p in held), sum(not y and p for y, p in held)
    toxic = sum(y for y, _ in held)
    assert hit >= 0.9 * toxic and wrong <= 0.01 * (len(held) - toxic)
