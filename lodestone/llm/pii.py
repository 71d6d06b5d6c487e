"""Personal data: base patterns and information-theoretic sanitisation.

Base spans (e-mail, IP, card, phone) are the protected entities.  Corpus
co-occurrence then tells how strongly other terms reveal them.  For a term t
of the documents that hold an entity e,

    disclosure(t, e) = PMI(t; e) / IC(e),   IC(e) = -log2 p(e)

which is 1 when t occurs only where e does.  p counts documents of the whole
corpus, and so does t stand with e: anywhere in the same document, outside base
spans.  A term is any run of letters.  A pair needs ``support`` different
neighbourhoods of the entity (the terms among the ``near_words`` words within ``room``
code points on either side), so that copies of one document are no evidence; candidates
and counts know no window.  Terms at or above ``remove`` are removed, those at or above
``generalise`` become their class (an acronym, a name or a word, by their letters),
wherever they stand in the documents that hold the entity; documents without base spans
stay as they are.

Only DataFrame functions run here.  Counts are partial aggregates; exact copies
of a text are one row with a weight before anything is exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sized, stored
from .native import joined, replaced, spans

#: The contract's patterns; failing matches are dropped, never retried.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(BASE)
#: Kinds of the method's spans.
DERIVED = ["remove", "generalise"]
TERM = r"\p{L}++"
FOUND = "array<struct<no:int,start:int,end:int,kind:string,entity:string>>"
NEAR = "array<struct<entity:string,term:string,start:int,end:int>>"
TERMS = "array<struct<no:int,start:int,end:int,kind:string>>"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]+", "")


def luhn(number: Column) -> Column:
    """The Luhn test of a string of digits."""
    at = F.transform(F.split(F.reverse(number), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    doubled = F.transform(at, lambda d, i: F.when(i % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.length(F.regexp_replace(p, r"^0+", "")) < 4
        return F.forall(F.split(value, r"\."), lambda p: part(p) & (F.when(part(p), F.substring(p, -3, 3).cast("int")).otherwise(999) <= 255))
    if kind == "card":
        return F.length(digits(value)).between(16, 19) & luhn(F.substring(digits(value), 1, 19))
    if kind == "phone":
        return F.length(digits(value)).between(8, 15)
    return F.lit(True)


def raw_spans(text: Column, room: int = 0) -> dict[str, Column]:
    """Per kind, the passing matches with ``room`` code points on either side."""
    needs = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "ip": F.lit(True), "card": F.lit(True)}
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string,before:string,after:string>>)")

    def passing(kind: str) -> Column:
        return spans(text, BASE[kind], room, lambda v: passes(kind, v))

    return {k: F.when(needs[k], passing(k)).otherwise(none) for k in BASE}


def base_spans(text: Column) -> Column:
    """All base spans, by kind as listed, then by start, with the entity they name."""

    def of(no: int, kind: str, found: Column) -> Column:
        name = (lambda v: F.lower(v)) if kind in ("email", "ip") else digits
        return F.transform(found, lambda s: F.struct(F.lit(no).alias("no"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.concat_ws(":", F.lit(kind), name(s["value"])).alias("entity"))).cast(FOUND)

    return F.flatten(F.array(*[of(i, k, c) for i, (k, c) in enumerate(raw_spans(text).items())]))


def outside(rows: DataFrame, text: Column, base: str, name: str) -> DataFrame:
    """``rows`` with a column ``name``: the text with blanks for its base spans, code point by code point, so that positions stay."""

    def blanked(kind: str) -> Column:
        own = F.filter(base, lambda b: b["kind"] == kind)
        changes = F.transform(own, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), F.repeat(F.lit(" "), b["end"] - b["start"]).alias("label")))
        return F.when(F.col(name) != "", replaced(F.col(name), changes)).otherwise("")

    rows = rows.withColumn(name, text)
    for kind in KINDS:  # spans of one kind don't overlap
        rows = rows.withColumn(name, blanked(kind))
    return rows


def terms_of(text: Column) -> Column:
    """Its different terms in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda w: F.lower(w)))


def neighbours(text: Column, near_words: int, room: int) -> Column:
    """Terms among the nearest words on either side of each base span: array<struct<entity,term,start,end>>."""

    def of(kind: str, found: Column) -> Column:
        name = (lambda v: F.lower(v)) if kind in ("email", "ip") else digits

        def around(s: Column) -> Column:
            entity = F.concat_ws(":", F.lit(kind), name(s["value"]))
            # a word at the cut edge may be a part of one
            left = F.filter(spans(s["before"], TERM), lambda w: (w["start"] > 0) | (F.length(s["before"]) < room))
            right = F.filter(spans(s["after"], TERM), lambda w: (w["end"] < F.length(s["after"])) | (F.length(s["after"]) < room))
            left = F.slice(F.reverse(left), 1, near_words)
            right = F.slice(right, 1, near_words)
            put = lambda base: lambda w: F.struct(entity.alias("entity"), F.lower(w["value"]).alias("term"), (base + w["start"]).cast("int").alias("start"), (base + w["end"]).cast("int").alias("end"))
            return F.concat(F.transform(left, put(s["start"] - F.length(s["before"]))), F.transform(right, put(s["end"]))).cast(NEAR)

        return F.flatten(F.transform(found, around))

    return F.flatten(F.array(*[of(k, c) for k, c in raw_spans(text, room).items()]))


def disclosures(docs: DataFrame, text_col: str = "text", support: int = 3, generalise: float = 0.8, remove: float = 0.95, near_words: int = 8, room: int = 96) -> tuple[DataFrame, DataFrame]:
    """(pairs, contexts): the disclosing pairs (entity, term, kind, no, disclosure), and the neighbours of base spans for each distinct text."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(text.alias("t"))
    near = rows.withColumn("base", base_spans(F.col("t"))).where(F.size("base") > 0)
    near = outside(near, F.col("t"), "base", "free")
    words = terms_of(F.col("t"))
    near = near.select(F.sha2("t", 256).alias("text_key"), neighbours(F.col("t"), near_words, room).alias("near"), "base", words.alias("words"), F.array_intersect(terms_of(F.col("free")), words).alias("own"))  # what a base span cuts off a word is none
    clear = F.filter("near", lambda w: ~F.exists("base", lambda b: (w["start"] < b["end"]) & (b["start"] < w["end"])))
    near = near.select("text_key", "words", "own", clear.alias("near"), F.array_distinct(F.transform("base", lambda b: b["entity"])).alias("entities"))
    contexts = stored(near.groupBy("text_key").agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("near", "words", "own", "entities")]), "pii-contexts")
    one = contexts.select("text_key", "copies", "near", F.explode("entities").alias("entity"))
    around = F.xxhash64(F.array_sort(F.array_distinct(F.transform(F.filter("near", lambda w: w["entity"] == F.col("entity")), lambda w: w["term"]))))
    one = stored(one.select("text_key", "copies", "entity", around.alias("around")), "pii-neighbourhoods")
    by_around = one.groupBy("entity", "around").agg(F.sum("copies").alias("copies"))
    # an entity with fewer neighbourhoods than a pair needs has no pair
    by_entity = stored(by_around.groupBy("entity").agg(F.sum("copies").alias("n_entity"), F.count("*").alias("n_around")).where(F.col("n_around") >= support).drop("n_around"), "pii-entities")
    # candidates are all terms of the documents that hold the entity, outside its spans
    one = one.join(sized(by_entity.select("entity")), "entity", "left_semi")
    one = one.join(contexts.select("text_key", "own"), "text_key").select("copies", "entity", "around", F.explode("own").alias("term"))
    # first by neighbourhood, so that the exact count of them is a plain count
    both = one.groupBy("entity", "term", "around").agg(F.sum("copies").alias("copies")).groupBy("entity", "term").agg(F.sum("copies").alias("n_both"), F.count("*").alias("n_around"))
    # A term occurs in at least as many documents as hold an entity and it.  From there on its
    # disclosure only falls with further documents, so pairs that are below the threshold already
    # need no count over the corpus: an exact bound that leaves out common words.
    by_term = contexts.select("copies", F.explode("words").alias("term")).groupBy("term").agg(F.sum("copies").alias("n_held"))
    n = float(docs.count())
    best = F.col("n_both") * F.pow(F.lit(n) / F.col("n_entity"), F.lit(1.0 - min(generalise, remove)))
    pairs = both.where(F.col("n_around") >= support).join(by_entity, "entity").join(by_term, "term").where(F.col("n_held") <= best * 1.000001).drop("n_held")
    pairs = stored(pairs, "pii-pairs")
    schema = "entity string, term string, kind string, no int, disclosure double"
    if not pairs.limit(1).count():
        return docs.sparkSession.createDataFrame([], schema), contexts
    # counted before they meet the pairs, so that tasks add up a common word first (a semi join would be moved below the count)
    counts = rows.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    information = F.log2(F.lit(n) / F.col("n_entity"))
    pmi = F.log2(F.col("n_both") * n / (F.col("n_entity") * F.col("n_term")))
    scored = pairs.join(counts, "term").where(F.col("n_entity") < n).withColumn("disclosure", pmi / information)
    kind = F.when(F.col("disclosure") >= remove, DERIVED[0]).when(F.col("disclosure") >= generalise, DERIVED[1])
    found = scored.select("entity", "term", kind.alias("kind"), F.when(F.col("disclosure") >= remove, 4).otherwise(5).alias("no"), "disclosure").where("kind is not null")
    return stored(found, "pii-disclosing"), contexts


def sanitise(docs: DataFrame, text_col: str = "text", **thresholds) -> DataFrame:
    """``docs`` with ``spans`` (base spans, then the method's, each with kind, start, end) and ``sanitised``, the text without them.

    Base spans become <EMAIL>, <IP>, <CARD>, <PHONE>; removed terms vanish,
    generalised ones become <ACRONYM>, <NAME> or <WORD>.  Null text has no spans and stays null; rows
    that share a text get the same result; an empty table gives an empty table.
    Input columns named like a result give way to it.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    pairs, contexts = disclosures(docs, text_col, **thresholds)
    # a row for each word of a document that holds an entity and that some entity is disclosed by; never all terms of an entity at once
    words = contexts.select("text_key", "entities", F.explode("words").alias("term")).join(sized(pairs.select("term", "entity", "kind")), "term")
    words = words.where(F.array_contains("entities", F.col("entity")))
    hit = words.groupBy("text_key").agg(*[F.collect_set(F.when(F.col("kind") == k, F.col("term"))).alias(f"__{k}") for k in DERIVED])
    hit = sized(stored(hit.where(" or ".join(f"size(__{k}) > 0" for k in DERIVED)), "pii-terms-by-text")).withColumnRenamed("text_key", "__key")
    # the input's columns travel in one, so that none of their names meets one of ours
    names = [c for c in docs.columns if c.lower() not in ("spans", "sanitised")]
    rest = [c for c in names if c != text_col]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row") if rest else F.lit(None).alias("row"), F.col(f"`{text_col}`").alias("text"))
    text = F.coalesce("text", F.lit(""))
    rows = rows.withColumn("__base", base_spans(text))
    rows = rows.withColumn("__own", F.when(F.size("__base") > 0, F.sha2(text, 256)))
    rows = rows.join(hit, F.col("__own") == F.col("__key"), "left")
    plain = F.transform("__base", lambda b: F.struct(b["no"].alias("no"), b["start"].alias("start"), b["end"].alias("end"), b["kind"].alias("kind"))).cast(TERMS)
    # a term can disclose several entities: the stronger measure counts
    kind_of = lambda w: F.when(F.array_contains(f"__{DERIVED[0]}", w), 4).when(F.array_contains(f"__{DERIVED[1]}", w), 5)
    # every occurrence in the document, wherever its entities stand
    rows = outside(rows, F.when(F.col("__key").isNotNull(), text).otherwise(""), "__base", "__free")
    every = F.transform(spans(F.col("__free"), TERM), lambda w: F.struct(kind_of(F.lower(w["value"])).alias("no"), w["start"].alias("start"), w["end"].alias("end")))
    every = F.filter(every, lambda w: w["no"].isNotNull())
    terms = F.array_sort(F.transform(every, lambda w: F.struct(w["no"].alias("no"), w["start"].alias("start"), w["end"].alias("end"), F.when(w["no"] == 4, DERIVED[0]).otherwise(DERIVED[1]).alias("kind")))).cast(TERMS)
    found = F.concat(plain, F.when(F.col("__key").isNotNull(), terms).otherwise(F.expr(f"cast(array() as {TERMS})")))
    rows = rows.withColumn("spans", found)
    word = lambda s: F.substr(text, s["start"] + 1, s["end"] - s["start"])
    shape = lambda w: F.when(w.rlike(r"^\p{Lu}{2,}$"), "<ACRONYM>").when(w.rlike(r"^\p{Lu}"), "<NAME>").otherwise("<WORD>")
    label = lambda s: F.when(s["kind"] == DERIVED[0], "").when(s["kind"] == DERIVED[1], shape(word(s))).otherwise(F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))
    changes = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), label(s).alias("label")))
    done = F.when(F.col("text").isNotNull(), replaced(text, changes))
    return rows.select(*[F.col("text" if c == text_col else f"row.`{c}`").alias(c) for c in names], "spans", done.alias("sanitised"))


def digest(sanitised: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns of :func:`sanitise`'s result."""
    base = F.filter("spans", lambda s: s["no"] < len(KINDS))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return sanitised.select(F.col(id_col), *[count(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
