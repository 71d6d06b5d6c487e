"""Language identification with segmentation-marginalised unigrams.

Pieces of a fixed public vocabulary get a probability per language.  A word's
probability is the sum over all its segmentations into pieces, by the forward
algorithm; expectation-maximisation (forward-backward) fits the piece
probabilities.  No piece reaches over a word's start, so a text's likelihood is
the product of its words', and each distinct word of a slice is scored once.
A run of more than LONGEST letters counts as words of that length, in fitting and
in scoring alike.

Fitting uses a bounded sample of labelled rows: about ``max_docs`` different texts
of each language, chosen by a hash; all their words take part.  Tasks add up the
expected uses of pieces, so the driver holds the model only, never words.  Scoring
covers whole texts.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, slices, split_runs, stored, with_text

SPACE = "▁"
NO_LETTERS = r"\PL+"
#: Letters of a word; a longer run of letters is several words.
LONGEST = 40
#: Words whose lattice is held at once; their lengths are alike.
LATTICE = 4096
#: Expected uses are added up as whole numbers of this part, so that sums don't depend on their order.
PART = 1 << 16
#: Keeps sums over segmentations within the range of a double: every character counts so many times its probability.
LIFT = 32.0
#: Tasks at most that the sample's words are spread over.
SPREAD = 64
#: Words whose scores a worker keeps.
CACHE = 100_000


def vocabulary(path: str) -> list[str]:
    """The ordinary pieces of a SentencePiece model file, lower-cased ones kept once."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return sorted({p.piece.lower() for p in model.pieces if p.type == 1 and len(p.piece) <= LONGEST})


def automaton(pieces: list[str]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, p in enumerate(pieces):
        a.add_word(p, (len(p), i))
    a.make_automaton()
    return a


class Lattice:
    """All matches of pieces in a list of words (each at most LONGEST letters), as edges ordered by end."""

    def __init__(self, words: list[str], matches, unknown: int):
        word, start, end, piece = array("i"), array("i"), array("i"), array("i")
        self.lengths = np.array([len(w) + 1 for w in words], np.int64)
        for i, w in enumerate(words):
            single = set()
            for last, (n, p) in matches.iter(SPACE + w):
                word.append(i)
                start.append(last + 1 - n)
                end.append(last + 1)
                piece.append(p)
                if n == 1:
                    single.add(last)
            for j in range(len(w) + 1):  # a character that is no piece
                if j not in single:
                    word.append(i)
                    start.append(j)
                    end.append(j + 1)
                    piece.append(unknown)
        order = np.argsort(np.frombuffer(end, np.int32), kind="stable") if len(end) else np.zeros(0, np.int64)
        self.word, self.start, self.end, self.piece = (np.frombuffer(x, np.int32)[order] if len(x) else np.zeros(0, np.int32) for x in (word, start, end, piece))
        self.cuts = np.searchsorted(self.end, np.arange(self.lengths.max(initial=0) + 2))
        self.n = len(words)

    def forward(self, p: np.ndarray) -> np.ndarray:
        """alpha[word, position]; p: of each piece, times LIFT for each of its characters."""
        alpha = np.zeros((self.n, len(self.cuts) - 1))
        alpha[:, 0] = 1
        for e in range(1, alpha.shape[1]):
            some = slice(self.cuts[e], self.cuts[e + 1])
            w = self.word[some]
            alpha[:, e] = np.bincount(w, weights=alpha[w, self.start[some]] * p[self.piece[some]], minlength=self.n)
        return alpha

    def backward(self, p: np.ndarray) -> np.ndarray:
        beta = np.zeros((self.n, len(self.cuts) - 1))
        beta[np.arange(self.n), self.lengths] = 1
        for e in range(beta.shape[1] - 1, 0, -1):
            some = slice(self.cuts[e], self.cuts[e + 1])
            w, s = self.word[some], self.start[some]
            np.add.at(beta, (w, s), beta[w, e] * p[self.piece[some]])
        return beta

    def log_likelihood(self, p: np.ndarray) -> np.ndarray:
        z = self.forward(p)[np.arange(self.n), self.lengths]
        return np.log(np.maximum(z, 1e-300)) - self.lengths * np.log(LIFT)

    def expected(self, p: np.ndarray, counts: np.ndarray, size: int, whole: int = 0) -> np.ndarray:
        """Expected uses of each piece, words weighted by ``counts``; with ``whole``, in whole parts of which so many make one."""
        alpha, beta = self.forward(p), self.backward(p)
        z = np.maximum(alpha[np.arange(self.n), self.lengths], 1e-300)
        use = counts[self.word] * alpha[self.word, self.start] * p[self.piece] * beta[self.word, self.end] / z[self.word]
        return np.bincount(self.piece, weights=np.rint(use * whole) if whole else use, minlength=size)

    def matched(self, counts: np.ndarray, size: int) -> np.ndarray:
        """Matches of each piece, words weighted by ``counts``."""
        return np.bincount(self.piece, weights=counts[self.word], minlength=size)


def chunks(some: list[str]) -> Iterator[list[int]]:
    """Places of words of like length, LATTICE at a time."""
    by_length = sorted(range(len(some)), key=lambda i: len(some[i]))
    for a in range(0, len(by_length), LATTICE):
        yield by_length[a : a + LATTICE]


def user(pieces: list[str], p):
    """mapInArrow: (lang, word, n) to (lang, piece, uses): matches of each piece if ``p`` is none, else expected uses under p[lang]."""

    def use(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, matches, known = len(pieces) + 1, automaton(pieces), None if p is None else p.value
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            words_, n = batch.column(1), batch.column(2).to_numpy().astype(float)
            for name in sorted(set(langs)):
                own = np.flatnonzero(langs == name)
                some = words_.take(pa.array(own)).to_pylist()
                uses = total.setdefault(name, np.zeros(size))
                for chunk in chunks(some):
                    lattice = Lattice([some[i] for i in chunk], matches, size - 1)
                    uses += lattice.matched(n[own[chunk]], size) * PART if known is None else lattice.expected(known[name], n[own[chunk]], size, PART)
        for name, uses in total.items():
            at = np.flatnonzero(uses)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(at), pa.string()), "piece": pa.array(at, pa.int32()), "uses": pa.array(uses[at].astype(np.int64))})
        release()

    return use


def fit(counts: DataFrame, pieces: list[str], rounds: int = 3, backing: float = 2000.0) -> dict:
    """{langs, pieces, p}: p[language, piece], the last column for a character that is no piece; ``counts``: (lang, word, n).

    What comes to the driver has at most one row for each language and piece."""
    spark = counts.sparkSession
    size = len(pieces) + 1
    lift = np.array([LIFT ** len(x) for x in pieces] + [LIFT])
    flat = np.full(size, 1.0 / size)

    def uses(p) -> tuple[list[str], np.ndarray]:
        got = counts.mapInArrow(user(pieces, p), "lang string, piece int, uses long").groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).toArrow()
        names = sorted(set(got.column("lang").to_pylist()))
        out = np.zeros((len(names), size))
        row = {k: i for i, k in enumerate(names)}
        out[[row[k] for k in got.column("lang").to_pylist()], got.column("piece").to_numpy()] = got.column("uses").to_numpy() / PART
        return names, out

    def normal(u: np.ndarray) -> np.ndarray:
        shared = (u.sum(axis=0) + flat * 10) / (u.sum() + 10)
        return (u + backing * (0.5 * shared + 0.5 * flat)) / (u.sum(axis=1, keepdims=True) + backing)

    langs, u = uses(None)
    p = normal(u)
    for _ in range(rounds if langs else 0):
        shared = spark.sparkContext.broadcast(dict(zip(langs, p * lift, strict=True)))
        p = normal(uses(shared)[1])
        shared.unpersist()
    return {"langs": langs, "pieces": pieces, "p": p * lift}


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased runs of letters, flattened, and their number in each text."""
    return split_runs(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), NO_LETTERS)


def parts(word: str) -> list[str]:
    return [word[j : j + LONGEST] for j in range(0, len(word), LONGEST)]


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        lang = np.array(batch.column(0).to_pylist(), object)
        flat, counts = words(batch.column(1))
        coded = flat.dictionary_encode()
        index, owner = coded.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(counts)), counts)
        long = pc.greater(pc.utf8_length(coded.dictionary), LONGEST).to_numpy(zero_copy_only=False)
        for name in sorted(set(lang)):
            n = np.bincount(index[(lang == name)[owner]], minlength=len(coded.dictionary))
            used = np.flatnonzero((n > 0) & ~long)
            cut = [(x, n[i]) for i in np.flatnonzero((n > 0) & long).tolist() for x in parts(coded.dictionary[i].as_py())]
            word = pa.concat_arrays([coded.dictionary.take(pa.array(used)).cast(pa.string()), pa.array([w for w, _ in cut], pa.string())])
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(word), pa.string()), "word": word, "n": pa.array([*n[used].tolist(), *[int(k) for _, k in cut]], pa.int64())})


def train(labelled: DataFrame, model_path: str, *, lang_col: str = "lang", text_col: str = "text", max_docs: int = 1500, seed: int = 5) -> dict:
    """A model from rows with a language: about ``max_docs`` different texts of each, all their words.

    Rows with null text or language take no part.  Without any, the model knows no language.
    Copies of one text are one text, so that a large group of them neither swamps nor misses the sample.
    """
    rows = labelled.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text")).where("lang is not null and text is not null")
    hashed = F.xxhash64(F.lit(seed), "text")
    # one row for each language; a sketch, as the bound is about so many
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct(hashed).alias("n")).collect()}
    if not sizes:
        return {"langs": [], "pieces": [], "p": np.zeros((0, 1))}
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, max_docs / max(n, 1))))])[F.col("lang")]
    draw = F.pmod(hashed, F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(draw < share).dropDuplicates(["lang", "text"])
    got = sample.mapInArrow(count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # a small table on which much is done: spread, not coalesced by its bytes
    tasks = min(SPREAD, labelled.sparkSession.sparkContext.defaultParallelism)
    return fit(stored(got.repartition(tasks, "word"), "language-words"), vocabulary(model_path))


class Scorer:
    """Log-likelihoods of words under each language, kept per worker."""

    def __init__(self, model: dict):
        self.p, self.matches = model["p"], automaton(model["pieces"])
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(model["langs"])))

    def fresh(self, some: list[str]) -> np.ndarray:
        cut, owner = [], []
        for i, w in enumerate(some):
            own = parts(w)
            cut.extend(own)
            owner.extend([i] * len(own))
        out = np.zeros((len(some), len(self.p)))
        for chunk in chunks(cut):
            lattice = Lattice([cut[i] for i in chunk], self.matches, self.p.shape[1] - 1)
            for k, p in enumerate(self.p):
                np.add.at(out[:, k], [owner[i] for i in chunk], lattice.log_likelihood(p))
        return out

    def score(self, some: list[str], uses: np.ndarray) -> np.ndarray:
        """Scores of distinct words; those used more than once in a slice are kept for the next ones."""
        if len(self.known) > CACHE:
            self.known, self.rows = {}, self.rows[:0]
        row = np.fromiter((self.known.get(w, -1) for w in some), np.int64, len(some))
        new = np.flatnonzero(row < 0)
        if not len(new):
            return self.rows[row]
        fresh = [some[i] for i in new.tolist()]
        scores = self.fresh(fresh)
        row[new] = len(self.rows) + np.arange(len(new))
        out = np.concatenate([self.rows, scores])[row]
        keep = np.flatnonzero(uses[new] > 1)
        self.known.update(zip([fresh[i] for i in keep.tolist()], range(len(self.rows), len(self.rows) + len(keep)), strict=True))
        self.rows = np.concatenate([self.rows, scores[keep]])
        return out


def predictor(model, into: tuple[str, str], text_col: str):
    """mapInArrow: rows to the same rows with prediction and score; a column __text goes."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        scorer = Scorer(m)
        names = np.array([*m["langs"], "und"], object)
        for batch in slices(batches, text_col):
            flat, counts = words(batch.column(batch.schema.get_field_index(text_col)))
            n = len(counts)
            coded = flat.dictionary_encode()
            best, share = np.full(n, len(names) - 1), np.zeros(n)
            if m["langs"]:
                index = coded.indices.to_numpy(zero_copy_only=False)
                own = scorer.score(coded.dictionary.to_pylist(), np.bincount(index, minlength=len(coded.dictionary)))[index]
                owner = np.repeat(np.arange(n), counts)
                total = np.stack([np.bincount(owner, weights=own[:, k], minlength=n) for k in range(own.shape[1])], axis=1)
                full = counts > 0
                best = np.where(full, total.argmax(axis=1), best)
                rest = np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                share = np.where(full, np.round(1 / rest, 9), 0.0)
            kept = {c: batch.column(i) for i, c in enumerate(batch.schema.names) if c != "__text"}
            yield pa.RecordBatch.from_pydict(kept | {into[0]: pa.array(names[best], pa.string()), into[1]: share})
        del scorer
        release()

    return predict


def identify(docs: DataFrame, model: dict, text_col: str = "text", into: tuple[str, str] = ("lang_pred", "score"), keep: list[str] | None = None) -> DataFrame:
    """``docs`` (columns ``keep``, by default all) with a prediction and its score, the posterior of that language among the learned ones at equal priors.

    Text that is null or has no letter: ``und``, score 0; so is every text if no
    language was learned.  Ties: the first by name.  Equal texts get the same result,
    however long they are; repeated rows each get a row; an empty table gives an
    empty table.  Input columns with the names of ``into`` give way.
    """
    rows, name = with_text(docs, text_col, keep, into)
    schema = rows.drop("__text").schema.add(into[0], "string").add(into[1], "double")
    return rows.mapInArrow(predictor(docs.sparkSession.sparkContext.broadcast(model), into, name), schema)
