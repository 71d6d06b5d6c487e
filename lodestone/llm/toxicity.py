"""Toxicity of whole texts: a lexicon trie intersected with Levenshtein automata, and windows that tell quotation from abuse.

The lexicon is learned from labelled documents: words, and beginnings of words
(stems, written ``abc*``), whose share among toxic documents stands out by a
likelihood ratio that chance doesn't reach among as many candidates.  Each distinct
word of a slice is looked up once: as itself, by its stem, with stretched letters
squeezed, and else as a misspelling.  For the latter an automaton of the word that
accepts what lies within a number of edits walks the trie of the lexicon; masks of
letters rule out most words before.  A hit's weight is what labelled documents say
of its term, of its spelling (known misspellings by themselves, unseen ones by what
those seen once were) and of its window: plain, cited (words such as "said") or in
quotation marks.  Terms combine as independent causes (noisy or).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, release, slices, stored

#: Letters and digits, signs that stand for letters within.
TOKEN = re.compile(r"[^\W_]+(?:[@$!*]+[^\W_]+)*")
MASKED = re.compile(r"[\d@$!*]")
STRETCHED = re.compile(r"(.)\1{2,}")
#: Letters of stems.
SHORTEST, LONGEST = 3, 8
#: Occurrences of a term in a text that are told apart: one, two, three or more.
LEVELS = 3
#: Code points on either side of a hit that tell its use.
WINDOW = 60
OPENING, CLOSING = "\"“«„‘‹", "\"”»“’›"
CITES = re.compile(r"(?<!\w)(?:said|says|wrote|writes|called|calls|quote[ds]?|quoting|word|term|sagte|schrieb|nannte|zitat|wort|dit|écrit|appelé|citation|mot|dijo|escribió|llamó|cita|palabra)(?!\w)")
#: Quotations, which say nothing of the writer's own words.
SPEECH = re.compile("|".join(f"{a}[^{a}{b}\\n]{{1,{2 * WINDOW}}}{b}" for a, b in zip(OPENING, CLOSING, strict=True)))
PLAIN, CITED, QUOTED = "plain", "cited", "quoted"
EXACT, EDITED, MASK = "exact", "edited", "masked"
#: What windows are worth before any label is seen, and how many documents that counts for.
WORTH, TRUST = {PLAIN: 1.0, CITED: 0.7, QUOTED: 0.3}, 8
#: Words held from one slice to the next.
CACHE = 500_000


@dataclass
class Model:
    #: term (stems end in *) -> weights of one, two, ... plain, exact occurrences (the last: or more)
    terms: dict[str, tuple[float, ...]] = field(default_factory=dict)
    #: misspellings seen in labelled documents -> weight
    forms: dict[str, float] = field(default_factory=dict)
    #: weight of misspellings never seen, by kind
    unseen: dict[str, float] = field(default_factory=lambda: {EDITED: 0.5, MASK: 0.7})
    windows: dict[str, float] = field(default_factory=lambda: dict(WORTH))
    #: score of a text without hits
    none: float = 0.0


class Automaton:
    """Accepts the strings within ``edits`` insertions, deletions and substitutions of ``word``; a state is the row of edits to each prefix."""

    def __init__(self, word: str, edits: int):
        self.word, self.edits = word, edits
        self.start = tuple(min(i, edits + 1) for i in range(len(word) + 1))

    def step(self, state: tuple[int, ...], sign: str) -> tuple[int, ...]:
        out = [min(state[0] + 1, self.edits + 1)]
        for i, c in enumerate(self.word):
            out.append(min(out[i] + 1, state[i + 1] + 1, state[i] + (c != sign), self.edits + 1))
        return tuple(out)

    def alive(self, state: tuple[int, ...]) -> bool:
        return min(state) <= self.edits

    def accepts(self, state: tuple[int, ...]) -> int | None:
        return state[-1] if state[-1] <= self.edits else None


class Trie:
    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        for w in words:
            at = 0
            for c in w:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.word.append(None)
                at = self.next[at][c]
            self.word[at] = w

    def within(self, word: str, edits: int) -> Iterator[tuple[int, str]]:
        """(edits, lexicon word) of all words that an automaton accepts."""
        automaton = Automaton(word, edits)
        open_ = [(0, automaton.start)]
        while open_:
            at, state = open_.pop()
            if self.word[at] is not None and (d := automaton.accepts(state)) is not None:
                yield d, self.word[at]
            for c, to in self.next[at].items():
                if automaton.alive(new := automaton.step(state, c)):
                    open_.append((to, new))


def edits_of(word: str, kind: str) -> int:
    """Edits that a lexicon word admits."""
    return 2 if len(word) >= 9 else 1 if len(word) >= 5 or (kind == MASK and len(word) >= 4) else 0


def masks(words: list[str]) -> np.ndarray:
    """64 bits for the letters of each (non-empty) word."""
    signs = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return np.bitwise_or.reduceat(np.uint64(1) << (signs % 61).astype(np.uint64), np.cumsum(sizes) - sizes) if len(words) else np.zeros(0, np.uint64)


class Lexicon:
    """Looks words up; keeps what it found for the next slices."""

    def __init__(self, terms: Iterable[str]):
        self.whole = sorted(t for t in terms if not t.endswith("*"))
        self.known = set(self.whole)
        self.stems = {t[:-1] for t in terms if t.endswith("*")}
        self.sizes = sorted({len(s) for s in self.stems}, reverse=True)
        self.trie = Trie(self.whole)
        self.masks = masks(self.whole)
        self.seen: set[str] = set()
        self.hits: dict[str, tuple[str, str]] = {}

    def direct(self, word: str) -> str | None:
        if word in self.known:
            return word
        for n in self.sizes:
            if word[:n] in self.stems:
                return word[:n] + "*"
        return None

    def misspelt(self, word: str) -> tuple[str, str] | None:
        """(term, kind): the nearest lexicon word within the edits that it admits, the first of equals."""
        squeezed = STRETCHED.sub(r"\1", word)
        kind = MASK if squeezed != word or MASKED.search(word) else EDITED
        found = []
        for form in {word, squeezed}:
            found += [(d, t) for d, t in self.trie.within(form, 2) if d <= edits_of(t, kind)]
        return (min(found)[1], kind) if found else None

    def learn(self, words: set[str]) -> None:
        """Look up the words that weren't seen."""
        if len(self.seen) > CACHE:
            self.seen = set(self.hits)
        new = sorted(words - self.seen)
        if not new:
            return
        self.seen.update(new)
        rest = []
        for w in new:
            if (t := self.direct(w)) is not None:
                self.hits[w] = (t, EXACT)
            else:
                rest.append(w)
        if not rest or not self.whole:
            return
        # an edit changes two letters of the set at most; stretched words are looked at as they are and squeezed
        own, sizes = masks(rest), np.fromiter(map(len, rest), np.int64, len(rest))
        close = np.fromiter((STRETCHED.search(w) is not None for w in rest), bool, len(rest))
        for word, mask in zip(self.whole, self.masks, strict=True):
            k = edits_of(word, MASK)
            if k:
                close |= (np.abs(sizes - len(word)) <= k) & (np.bitwise_count(own ^ mask) <= 2 * k)
        for i in np.flatnonzero(close).tolist():
            if (hit := self.misspelt(rest[i])) is not None:
                self.hits[rest[i]] = hit


def window(text: str, start: int, end: int) -> str:
    """How the words at [start, end) are used."""
    before, after = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    for a, b in zip(OPENING, CLOSING, strict=True):
        opened, closed = before.rfind(a), after.find(b)
        # open before and not closed again, closed behind in the same line
        inside = before.count(a) % 2 == 1 if a == b else before.rfind(b) < opened
        if opened >= 0 and closed >= 0 and inside and "\n" not in before[opened:] and "\n" not in after[:closed]:
            return QUOTED
    return CITED if CITES.search(before) or CITES.search(after) else PLAIN


Hits = Counter[tuple[str, str, str, str]]


def hits_of(text: str, lexicon: Lexicon) -> Hits:
    """How often (term, kind, form, window) occur in a lower-case text whose words the lexicon has learned."""
    out: Hits = Counter()
    for m in TOKEN.finditer(text):
        if (hit := lexicon.hits.get(m[0])) is not None:
            out[(*hit, m[0], window(text, m.start(), m.end()))] += 1
    return out


def scored(hits: Hits, model: Model) -> float:
    """Noisy or over terms, each by its strongest hits: several occurrences count together, at the worth of the least of them."""
    best: dict[str, float] = {}
    exact: dict[str, Counter[float]] = {}
    for (term, kind, form, use), n in hits.items():
        weights, worth = model.terms.get(term, (0.0,)), model.windows[use]
        if kind == EXACT:
            exact.setdefault(term, Counter())[worth] += n
        else:
            best[term] = max(best.get(term, 0.0), model.forms.get(form, model.unseen[kind] * max(weights)) * worth)
    for term, worths in exact.items():
        weights, n = model.terms[term], 0
        for worth in sorted(worths, reverse=True):
            n += worths[worth]
            best[term] = max(best.get(term, 0.0), max(weights[: min(n, len(weights))]) * worth)
    clean = 1.0 - model.none
    for term in sorted(best):
        clean *= 1.0 - best[term]
    return 1.0 - clean


def found(batches: Iterator[pa.RecordBatch], text_col: str, terms: Iterable[str]) -> Iterator[tuple[pa.RecordBatch, list[Hits]]]:
    """Slices and the hits of their texts."""
    lexicon = Lexicon(terms)
    for batch in slices(batches, text_col):
        texts = [(t or "").lower() for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
        words = [set(TOKEN.findall(t)) for t in texts]
        lexicon.learn(set().union(*words))
        yield batch, [hits_of(t, lexicon) if not lexicon.hits.keys().isdisjoint(w) else Counter() for t, w in zip(texts, words, strict=True)]


def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, level, toxic, clean): in how many texts of each label a task meets words and stems that often or oftener; given out in parts."""
    held: tuple[Counter[tuple[str, int]], ...] = (Counter(), Counter())

    def out() -> Iterator[pa.RecordBatch]:
        keys = list(held[0].keys() | held[1].keys())
        yield pa.RecordBatch.from_pydict({"term": pa.array([k[0] for k in keys], pa.string()), "level": pa.array([k[1] for k in keys], pa.int32()), "toxic": pa.array([held[1][k] for k in keys], pa.int64()), "clean": pa.array([held[0][k] for k in keys], pa.int64())})
        for h in held:
            h.clear()

    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            terms: Counter[str] = Counter()
            for w, times in Counter(TOKEN.findall(SPEECH.sub(" ", text.lower()))).items():
                if len(w) >= SHORTEST:
                    terms[w] += times
                    for n in range(SHORTEST, min(len(w), LONGEST) + 1):
                        terms[w[:n] + "*"] += times
            for level in range(1, LEVELS + 1):
                held[label].update([(t, level) for t, times in terms.items() if times >= level])
            if len(held[0]) + len(held[1]) > 400_000:
                yield from out()
    yield from out()
    release()


def ratio(a, b, n_a: int, n_b: int):
    """Half the likelihood-ratio statistic of a of n_a against b of n_b documents (columns)."""
    share = (a + b) / F.lit(float(n_a + n_b))
    part = lambda x, n, p: F.when(x > 0, x * F.log(x / (F.lit(float(n)) * p))).otherwise(F.lit(0.0))
    return part(a, n_a, share) + part(F.lit(n_a) - a, n_a, 1 - share) + part(b, n_b, share) + part(F.lit(n_b) - b, n_b, 1 - share)


def pruned(rows: list[tuple[str, float]], most: int) -> list[str]:
    """The strongest terms (term, ratio) of which none begins another; among equals the longer one, and words before stems."""
    out: list[str] = []
    for term, _ in sorted(rows, key=lambda r: (-round(r[1], 9), -len(r[0].rstrip("*")), r[0].endswith("*"), r[0])):
        own = term.rstrip("*")
        if len(out) < most and not any(own.startswith(k.rstrip("*")) or k.startswith(own) for k in out):
            out.append(term)
    return out


#: Odd factors that make several hash functions of one.
FACTORS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5]
MARKS = [f"mark{i}" for i in range(len(FACTORS))]
SHINGLE = 5


def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the least of their five-word shingles by each hash function."""
    import xxhash

    factors = np.array(FACTORS, np.uint64)
    for batch in slices(batches, "text"):
        marks = []
        for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
            words = TOKEN.findall(text.lower())
            some = [" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))]
            own = np.fromiter(map(xxhash.xxh3_64_intdigest, some), np.uint64, len(some))
            marks.append((own[:, None] * factors[None, :]).min(axis=0).view(np.int64))
        columns = np.array(marks, np.int64).reshape(-1, len(FACTORS))
        yield pa.RecordBatch.from_pydict({c: batch.column(i) for i, c in enumerate(batch.schema.names)} | {m: columns[:, i] for i, m in enumerate(MARKS)})


def thinned(sample: DataFrame) -> DataFrame:
    """The sample with one of each group of near copies: of texts of one label that share a least shingle the longest, by one hash function after the other.

    Words that copies of one toxic document share would else pass for terms."""
    rows = sample.mapInArrow(marked, T.StructType([*sample.schema, *[T.StructField(m, T.LongType()) for m in MARKS]]))
    for mark in MARKS:
        best = F.max_by(F.struct("text", *[m for m in MARKS if m != mark]), F.struct(F.length("text"), "text")).alias("best")
        rows = rows.groupBy("label", mark).agg(best).select("label", mark, "best.*")
    return rows.select("text", "label")


def sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_docs: int) -> tuple[DataFrame, tuple[int, int]]:
    """(text, label) of up to ``max_docs`` documents of each label, each different text once, and how many documents have each label."""
    label, key = F.col(f"`{label_col}`"), F.col(f"`{id_col}`")
    rows = labels.where(label.isin(0, 1) & key.isNotNull()).select(key.alias("id"), label.cast("int").alias("label")).distinct()
    totals = dict(rows.groupBy("label").count().collect())  # two rows
    draw = F.xxhash64("id")
    some = [rows.where(F.col("label") == x).orderBy(draw, "id").limit(max_docs) for x in (0, 1)]
    texts = docs.where(F.length(F.col(f"`{text_col}`")) > 0).select(key.alias("id"), F.col(f"`{text_col}`").alias("text"))
    chosen = F.broadcast(some[0].unionAll(some[1]))  # 2 * max_docs ids
    # a text with both labels counts as toxic
    out = texts.join(chosen, "id").groupBy("text").agg(F.max("label").alias("label"))
    return out, (totals.get(0, 0), totals.get(1, 0))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = 4000, max_terms: int = 200) -> Model:
    """A model of ``labels`` (id, 0 or 1; others and null ids are ignored) over ``docs``.

    Learned from at most ``max_docs`` documents of each label, drawn by a hash of the
    id, whole texts, one of each group of equal or nearly equal texts; at most ``max_terms`` terms.  Without
    toxic or without clean documents the model has no terms."""
    spark = docs.sparkSession
    rows, (n_clean, n_toxic) = sampled(docs, labels, id_col, text_col, label_col, max_docs)
    tasks = max(1, min(64, spark.sparkContext.defaultParallelism * 2))
    sample = stored(thinned(rows.repartition(tasks)), "labelled")
    count = dict(sample.groupBy("label").count().collect())
    clean, toxic = count.get(0, 0), count.get(1, 0)
    prior = n_toxic / max(1, n_clean + n_toxic)
    if not clean or not toxic:
        return Model(none=prior)
    spread = sample.repartition(tasks)
    terms = spread.mapInArrow(term_counts, "term string, level int, toxic long, clean long").groupBy("term", "level").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    terms = stored(terms.where("toxic >= 3"), "toxic-terms")
    # as many candidates may reach this by chance as there are: none, but with luck
    bar = math.log(max(2, terms.count())) + 1
    more = F.col("toxic") * clean > F.col("clean") * toxic
    strongest = terms.where(more).groupBy("term").agg(F.max(ratio(F.col("toxic"), F.col("clean"), toxic, clean)).alias("ratio"))
    strongest = strongest.where(F.col("ratio") > bar).orderBy(F.desc("ratio"), "term").limit(40 * max_terms).collect()  # stems of one word come together
    lexicon = pruned([tuple(r) for r in strongest], max_terms)

    def posterior(t: float, c: float, mean: float, trust: float) -> float:
        """Probability of toxic where t toxic and c clean texts of the sample had it, at the labels' own shares."""
        a, b = t / toxic * prior, c / clean * (1 - prior)
        unit = prior / toxic + (1 - prior) / clean
        return (a + trust * unit / 2 * mean) / (a + b + trust * unit / 2)

    at_least = {(r["term"], r["level"]): (r["toxic"], r["clean"]) for r in terms.where(F.col("term").isin(lexicon)).collect()}  # LEVELS rows a term
    # being picked among so many takes as much evidence as this many toxic documents hold
    spent = bar / math.log(1 / prior) if prior < 1 else 0.0
    model = Model()
    for t in lexicon:
        counts = [at_least.get((t, level), (0, 0)) for level in range(1, LEVELS + 2)]
        weights: list[float] = []
        for (a, b), (a_next, b_next) in zip(counts, counts[1:], strict=False):
            # more occurrences never count for less
            weights.append(max([posterior(a - a_next, b - b_next, prior, spent) if a - a_next + b - b_next > 0 else 0.0, *weights[-1:]]))
        model.terms[t] = tuple(weights)

    def hit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(what, name, toxic, clean) counted over a task's texts."""
        held: dict[tuple[str, str], list[int]] = {}
        for batch, hits in found(batches, "text", lexicon):
            for label, some in zip(batch.column(batch.schema.get_field_index("label")).to_pylist(), hits, strict=True):
                uses = {use for _, kind, _, use in some if kind == EXACT}
                # a misspelling beside a term that is spelt right tells nothing of itself
                keys = {(kind, form) for _, kind, form, _ in some} if not uses else set()
                if PLAIN not in uses and uses:
                    keys.add(("window", CITED if CITED in uses else QUOTED))
                if not some:
                    keys.add(("none", ""))
                for k in keys:
                    held.setdefault(k, [0, 0])[label] += 1
        yield pa.RecordBatch.from_pydict({"what": [k[0] for k in held], "name": [k[1] for k in held], "clean": pa.array([v[0] for v in held.values()], pa.int64()), "toxic": pa.array([v[1] for v in held.values()], pa.int64())})
        release()

    seen = spread.mapInArrow(hit_rows, "what string, name string, clean long, toxic long").groupBy("what", "name").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).collect()  # misspellings in the sample
    once = {EDITED: [0, 0], MASK: [0, 0]}
    for r in seen:
        if r["what"] in once and r["toxic"] + r["clean"] == 1:
            once[r["what"]][0] += r["toxic"]
            once[r["what"]][1] += r["clean"]
    model.unseen = {k: posterior(t, c, {EDITED: 0.5, MASK: 0.7}[k], 2) for k, (t, c) in once.items()}
    for r in seen:
        if r["what"] in once:
            model.forms[r["name"]] = posterior(r["toxic"], r["clean"], model.unseen[r["what"]], 2)
        elif r["what"] == "window":
            model.windows[r["name"]] = posterior(r["toxic"], r["clean"], WORTH[r["name"]], TRUST)
        elif r["what"] == "none":
            model.none = posterior(r["toxic"], r["clean"], prior, 2)
    model.none = min(model.none, prior)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, threshold: float = 0.3) -> DataFrame:
    """``docs`` (columns ``keep``, by default all) with ``score`` (0 to 1, of the whole text), ``predicted`` (1 from ``threshold`` on) and ``terms``, the lexicon terms found.

    Null and empty texts score as texts without hits.  Texts of any length are read
    whole; repeated rows score alike; an empty table gives an empty table.  Input
    columns named like a result give way."""
    own = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted", "terms")]
    text = text_col if text_col in own and docs.schema[text_col].dataType == T.StringType() else fresh(own, "text")
    rows = docs.select(*[F.col(f"`{c}`") for c in own], *([] if text in own else [F.col(f"`{text_col}`").cast("string").alias(text)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, hits in found(batches, text, model.terms):
            values = [scored(h, model) for h in hits]
            names = [sorted({term for term, *_ in h}) for h in hits]
            out = {c: batch.column(batch.schema.get_field_index(c)) for c in own}
            yield pa.RecordBatch.from_pydict(out | {"score": pa.array(values, pa.float64()), "predicted": pa.array([int(v >= threshold) for v in values], pa.int32()), "terms": pa.array(names, pa.list_(pa.string()))})
        release()

    schema = T.StructType([rows.schema[c] for c in own]).add("score", "double").add("predicted", "integer").add("terms", T.ArrayType(T.StringType()))
    return rows.mapInArrow(run, schema)
