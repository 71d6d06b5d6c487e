"""Alignment of two tokenizers against a plain version on whole texts."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from helpers import MODEL, ODD, docs

from lodestone.llm import align
from lodestone.llm import queries as Q

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain(rows):
    """By the contract's words: whole texts, loops over tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(Q.BYTE_LEVEL)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    letters = align.byte_letters()

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    done, held = [], defaultdict(set)
    for n, (key, text) in enumerate(rows):
        ids = [[], []]
        if text:
            ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)]
        spelt = [[bytes(letters[c] for c in a.id_to_token(i)) for i in ids[0]], [piece(i) for i in ids[1]]]
        if not text or any(b"".join(s) != (" " + text).encode() for s in spelt):
            done.append((key, ids := [[], []], [], 0, ""))
            continue
        ends = [np.cumsum([len(t) for t in s]).tolist() for s in spelt]
        starts = [[0, *e[:-1]] for e in ends]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        links, j = [], 0
        for i, (s, e) in enumerate(zip(starts[0], ends[0], strict=True)):
            while ends[1][j] <= s:
                j += 1
            k = j
            while k < len(ends[1]) and starts[1][k] < e:
                links.append((ids[0][i], ids[1][k]))
                k += 1
        groups = []
        for low, high in zip([0, *cuts[:-1]], cuts, strict=True):
            groups.append("|".join(",".join(str(x) for x, e in zip(ids[side], ends[side], strict=True) if low < e <= high) for side in (0, 1)))
        for p in set(links):
            held[p].add(n)
        done.append((key, ids, links, len(cuts), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = {p: len(d) for p, d in held.items()}
    top = defaultdict(int)
    for (x, _), c in count.items():
        top[x] = max(top[x], c)
    return [(key, len(ids[0]), len(ids[1]), n, len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), digest) for key, ids, links, n, digest in done]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


MORE = ["<|endoftext|> is text", "a <s> b</s> <0x41> <unk>", "\n\n  two  spaces\n and\tlines \n", " \n x", "x\x00y \x01", "don't they'll I'M", "日本語 のテキスト、です。", "ñ é   nbsp  em", "a▁b", "١٢٣ ⅷ ²", "naïve—dash … “quotes”", "\x1c \x85 z", "😀😀 ok"]


def test_rows_equal_plain_version(spark):
    texts = [t for t in ODD if not t or len(t) < 6000] + MORE + MORE[:3]
    df = docs(spark, texts)
    got = align.align(df, Q.BYTE_LEVEL, MODEL)
    assert set(got.columns) == set(df.columns) | set(align.RESULTS)
    want = plain([(i, t) for i, t in enumerate(texts)])
    assert order([tuple(r) for r in got.select(*COLUMNS).collect()]) == order(want)
    assert dict(got.select("doc_id", "text").collect()) == dict(enumerate(texts))


def test_random_texts_of_random_signs(spark):
    rng = random.Random(5)
    signs = "ab éß\n\t .,'!1  　漢ア́😀−Ω  AZ_-<>|"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = align.align(df, Q.BYTE_LEVEL, MODEL, keep=["doc_id"]).select(*COLUMNS)
    assert order([tuple(r) for r in got.collect()]) == order(plain(list(enumerate(texts))))


def test_names_and_empty_tables(spark):
    names = ["chunk", "pairs", "PAIR_DOCS", "step", "times", "_step", "place", "docs", "best", "n_best", "__text"]
    df = spark.createDataFrame([(1, "a b", *range(len(names)))], "doc_id long, body string, " + ", ".join(f"`{n}` int" for n in names))
    row = align.align(df, Q.BYTE_LEVEL, MODEL, text_col="body").first().asDict()
    assert row["body"] == "a b" and row["n_a"] == 2 and all(row[n] == i for i, n in enumerate(names) if n != "n_best")
    assert align.align(df.where("false"), Q.BYTE_LEVEL, MODEL, text_col="body").count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_index_finds_all_overlaps(seed):
    rng = np.random.default_rng(seed)
    s, q = rng.integers(0, 40, 60), rng.integers(0, 40, 50)
    e, f = s + rng.integers(0, 12, 60), q + rng.integers(0, 6, 50)
    query, found = align.IntervalIndex(s, e).overlaps(q, f)
    want = {(i, j) for i in range(50) for j in range(60) if s[j] < e[j] and q[i] < f[i] and s[j] < f[i] and e[j] > q[i]}
    assert set(zip(query.tolist(), found.tolist(), strict=True)) == want and len(query) == len(want)


def test_query_over_given_documents(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in Q.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert order([tuple(r) for r in Q.op12_align(spark, sf_dir).collect()]) == order(plain(rows))


def test_both_byte_level_libraries_agree_on_plain_letters():
    coder = align.ByteLevel(Q.BYTE_LEVEL)
    assert coder.fast is not None
    some = [f" {a}{chr(c)}{b}" for c in range(0x250) for a in ("", "x", "1", " ", "'") for b in ("", "y", "7", "  z", "\n")]
    assert coder.encode(some) == [e.ids for e in coder.full.encode_batch(some, add_special_tokens=False)]
