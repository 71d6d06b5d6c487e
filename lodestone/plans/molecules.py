"""Queries of molecule graphs: every part is a ring, a chain and a group, written as SMILES."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import graphs, smiles
from lodestone.operators import growth, similarity, substructure
from lodestone.session import each_once, kept, met
from lodestone.sources import fragments

from .registry import query, table

GROUPS = ["O", "N", "C(=O)N", "OC", "N(C)C", "C(=O)O", "C#N", "F", "Cl", "S(=O)(=O)N", "[N+](=O)[O-]"]
RINGS = [s for _, s in fragments.RINGS]
CHAIN = 7


def choice(values: list[str], i):
    return F.element_at(F.lit(values), (i + 1).cast("int"))


def spelt(spark: SparkSession, sf: str) -> DataFrame:
    """(id, smiles, other): two spellings; the second has other ring numbers, a branch, and benzene with written double bonds."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), choice(RINGS, F.col("p_partkey") % len(RINGS)).alias("ring"), F.concat(F.repeat(F.lit("C"), F.col("p_size") % CHAIN), choice(GROUPS, F.col("p_partkey") % len(GROUPS))).alias("tail"))
    written = F.translate(F.when(F.col("ring") == "c1ccccc1", "C1=CC=CC=C1").otherwise(F.col("ring")), "12", "57")
    return p.select("id", F.concat("ring", "tail").alias("smiles"), F.concat(F.lit(" "), written, F.lit("("), "tail", F.lit(")")).alias("other"))


def spellings(spark: SparkSession, sf: str) -> DataFrame:
    """(id, text): every other part in its second spelling."""
    return spelt(spark, sf).select("id", F.when(F.col("id") % 2 == 0, F.col("smiles")).otherwise(F.col("other")).alias("text"))


def read(texts: DataFrame, column: str) -> DataFrame:
    """(column, graph and what :func:`graphs.perceived` adds) of each different text, read once however many parts have it; written."""
    return each_once(texts, column, lambda some: graphs.perceived(kept(some.select(column, smiles.graph(F.col(column)).alias("graph")))))


def molecules(spark: SparkSession, sf: str) -> DataFrame:
    """The spellings of all parts as molecules, by ``text``; what is found of them goes back to the parts by :func:`of_parts`."""
    return read(spellings(spark, sf), "text")


def of_parts(spark: SparkSession, sf: str, found: DataFrame) -> DataFrame:
    """(id and what was found of its text)"""
    return met(spellings(spark, sf), kept(found), "text").drop("text")


# ---- the same molecules in SQL: graphs of rings and groups as tables, put together by joins


def drawn_graph(text: str) -> tuple[list[tuple], list[tuple]]:
    """Atoms (elem, aromatic, charge, h) and bonds (a, b, order, aromatic) of a fragment, for the SQL's tables."""
    atoms, bonds, stack, open_, last, order = [], [], [], {}, 0, 0
    for t in re.findall(r"\[[^]]+\]|Cl|Br|.", text):
        if t in "()":
            last = stack.pop() if t == ")" else (stack.append(last) or last)
        elif t in "=#":
            order = "-=#".index(t) + 1
        elif t.isdigit():
            if t not in open_:
                open_[t] = last
                continue
            bonds.append((open_.pop(t), last, order))
            order = 0
        else:
            bare = t.strip("[]")
            elem = re.match(r"Cl|Br|[A-Za-z]", bare)[0]
            atoms.append((elem.capitalize(), int(elem.islower()), bare.count("+") - bare.count("-"), (1 if "H" in bare else 0) if t[0] == "[" else None))
            if last:
                bonds.append((last, len(atoms), order))
            last, order = len(atoms), 0
    return atoms, [(a, b, o or 1, int(not o and atoms[a - 1][1] and atoms[b - 1][1])) for a, b, o in bonds]


def values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def fragment_tables(name: str, texts: list[str]) -> str:
    read = [drawn_graph(t) for t in texts]
    atoms = [(f, i, *a) for f, (some, _) in enumerate(read) for i, a in enumerate(some, 1)]
    bonds = [(f, *b) for f, (_, some) in enumerate(read) for b in some]
    sizes = [(f, len(some)) for f, (some, _) in enumerate(read)]
    bond_rows = values(bonds) if bonds else "(-1, 0, 0, 0, 0)"
    return f"""{name}_atom(f, i, elem, aromatic, charge, given) AS (VALUES {values(atoms)}), {name}_bond(f, a, b, ord, aromatic) AS (VALUES {bond_rows}), {name}_size(f, n) AS (VALUES {values(sizes)})"""


VALENCE_ROWS = values([(e, v, int(i == 0)) for e, some in smiles.VALENCES.items() for i, v in enumerate(some)])
GRAPHS = f"""{fragment_tables("ring", RINGS)}, {fragment_tables("tail", GROUPS)},
 mol AS (SELECT p_partkey AS id, p_partkey % {len(RINGS)} AS r, p_size % {CHAIN} AS c, p_partkey % {len(GROUPS)} AS g, s.n AS nr FROM part JOIN ring_size s ON s.f = p_partkey % {len(RINGS)}),
 raw_atom AS (SELECT id, i, elem, aromatic, charge, given FROM mol JOIN ring_atom ON f = r UNION ALL SELECT id, nr + j, 'C', 0, 0, NULL FROM mol, range(1, {CHAIN}) t(j) WHERE j <= c UNION ALL SELECT id, nr + c + i, elem, aromatic, charge, given FROM mol JOIN tail_atom ON f = g),
 bond AS (SELECT id, a, b, ord, aromatic, 1 AS in_ring FROM mol JOIN ring_bond ON f = r UNION ALL SELECT id, nr + j, nr + j + 1, 1, 0, 0 FROM mol, range(0, {CHAIN}) t(j) WHERE j <= c UNION ALL SELECT id, nr + c + a, nr + c + b, ord, aromatic, 0 FROM mol JOIN tail_bond ON f = g),
 edge AS (SELECT id, a AS u, b AS v, ord, aromatic, in_ring FROM bond UNION ALL SELECT id, b, a, ord, aromatic, in_ring FROM bond),
 valence(elem, v, least) AS (VALUES {VALENCE_ROWS}),
 used AS (SELECT id, u AS i, sum(ord)::INT AS s, count(*)::INT AS deg FROM edge GROUP BY ALL),
 atom AS (SELECT x.id, x.i, x.elem, x.aromatic, x.charge, deg, coalesce(given, (SELECT min(v - s - x.aromatic) FROM valence w WHERE w.elem = x.elem AND v >= s + x.aromatic AND (least = 1 OR x.aromatic = 0)), 0)::INT AS h FROM raw_atom x JOIN used USING (id, i))"""

WEIGHT = "CASE elem " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in {"C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "S": 32.06, "Cl": 35.45}.items()) + " END"


@query(
    f"""WITH {GRAPHS}, part_of AS (SELECT id, elem, count(*) AS n FROM atom GROUP BY ALL UNION ALL SELECT id, 'H', sum(h) FROM atom GROUP BY ALL),
 text AS (SELECT id, string_agg(elem || CASE WHEN n = 1 THEN '' ELSE n::VARCHAR END, '' ORDER BY CASE elem WHEN 'C' THEN 0 WHEN 'H' THEN 1 ELSE 2 END, elem) AS formula FROM part_of WHERE n > 0 GROUP BY id)
 SELECT id, count(*)::INT AS n_atoms, (SELECT count(*) FROM bond b WHERE b.id = atom.id)::INT AS n_bonds, any_value(formula) AS formula, round(sum({WEIGHT} + h * 1.008), 3) AS weight FROM atom JOIN text USING (id) GROUP BY id""",
    DOUBLE="weight",
)
def molecule_graphs(spark, sf):
    """SMILES read as graphs; hydrogens from valences."""
    m = molecules(spark, sf)
    return of_parts(spark, sf, m.select("text", F.size("atoms").alias("n_atoms"), F.size("bonds").alias("n_bonds"), graphs.formula(F.col("atoms")).alias("formula"), F.round(graphs.weight(F.col("atoms")), 3).alias("weight")))


SURFACE_ROWS = values(list(graphs.SURFACE.items()))


@query(
    f"""WITH {GRAPHS}, surface(kind, area) AS (VALUES {SURFACE_ROWS}),
 near AS (SELECT e.id, e.u AS i, count(*) FILTER (ord = 2) AS d, count(*) FILTER (ord = 3) AS t, count(*) FILTER (x.elem = 'O' AND ord = 2) AS oxo, count(*) FILTER (ord > 1 OR e.aromatic = 1) AS soft FROM edge e JOIN atom x ON x.id = e.id AND x.i = e.v GROUP BY ALL),
 kinds AS (SELECT *, elem || (deg + h) || CASE WHEN h > 0 THEN 'H' || h ELSE '' END || CASE WHEN aromatic = 1 THEN 'a' ELSE repeat('d', d) || repeat('t', t) END || CASE WHEN charge > 0 THEN '+' WHEN charge < 0 THEN '-' ELSE '' END AS kind FROM atom JOIN near USING (id, i)),
 tpsa AS (SELECT id, sum(coalesce(area, CASE elem WHEN 'N' THEN greatest(0, 30.5 - (deg + h) * 8.2 + h * 1.5) ELSE greatest(0, 28.5 - (deg + h) * 8.6 + h * 1.5) END)) FILTER (elem IN ('N', 'O')) AS s FROM kinds LEFT JOIN surface USING (kind) GROUP BY id),
 turn AS (SELECT b.id, count(*) AS n FROM bond b JOIN kinds x ON x.id = b.id AND x.i = b.a JOIN kinds y ON y.id = b.id AND y.i = b.b
   WHERE b.ord = 1 AND b.aromatic = 0 AND in_ring = 0 AND x.deg > 1 AND y.deg > 1 AND x.t = 0 AND y.t = 0 AND NOT (x.elem = 'C' AND x.oxo > 0 AND y.elem = 'N') AND NOT (y.elem = 'C' AND y.oxo > 0 AND x.elem = 'N') GROUP BY b.id),
 flat(r, n) AS (VALUES {values([(i, {"Ph": 1, "Nap": 2, "Ind": 2, "Qui": 2, "iQui": 2, "Bzt": 2, "Indn": 1, "Tet": 1}.get(n, 1 if s.islower() or "nH" in s else 0)) for i, (n, s) in enumerate(fragments.RINGS)])})
 SELECT id, count(*)::INT AS hac, count(*) FILTER (elem IN ('N', 'O') AND h > 0)::INT AS hbd, count(*) FILTER (elem IN ('N', 'O'))::INT AS hba, round(coalesce(any_value(s), 0), 2) AS tpsa, coalesce(any_value(turn.n), 0)::INT AS rotatable,
  ((SELECT count(*) FROM bond b WHERE b.id = kinds.id) - count(*) + 1)::INT AS rings, any_value(flat.n)::INT AS aromatic_rings, round(coalesce(count(*) FILTER (elem = 'C' AND soft = 0) / nullif(count(*) FILTER (elem = 'C'), 0), 0), 6) AS fsp3
 FROM kinds JOIN tpsa USING (id) LEFT JOIN turn USING (id) JOIN mol USING (id) JOIN flat USING (r) GROUP BY id""",
    DOUBLE="tpsa fsp3",
)
def molecule_descriptors(spark, sf):
    d = graphs.descriptors()
    names = {"HAC": "hac", "HBD": "hbd", "HBA": "hba", "RotBonds": "rotatable", "Rings": "rings", "ArRings": "aromatic_rings"}
    found = molecules(spark, sf).select("text", *[d[k].alias(v) for k, v in names.items()], F.round(d["TPSA"], 2).alias("tpsa"), F.round(d["Fsp3"], 6).alias("fsp3"))
    return of_parts(spark, sf, found)


SEEN = """c0 AS (SELECT id, i, substr(md5(concat_ws(':', elem, aromatic, charge, h, deg, '')), 1, 16) AS c FROM atom),
 c1 AS (SELECT e.id, e.u AS i, substr(md5(any_value(o.c) || '|' || string_agg(k || n.c, ',' ORDER BY k || n.c)), 1, 16) AS c FROM (SELECT *, CASE WHEN aromatic = 1 THEN 'a' ELSE ord::VARCHAR END AS k FROM edge) e JOIN c0 o ON o.id = e.id AND o.i = e.u JOIN c0 n ON n.id = e.id AND n.i = e.v GROUP BY ALL),
 c2 AS (SELECT e.id, e.u AS i, substr(md5(any_value(o.c) || '|' || string_agg(k || n.c, ',' ORDER BY k || n.c)), 1, 16) AS c FROM (SELECT *, CASE WHEN aromatic = 1 THEN 'a' ELSE ord::VARCHAR END AS k FROM edge) e JOIN c1 o ON o.id = e.id AND o.i = e.u JOIN c1 n ON n.id = e.id AND n.i = e.v GROUP BY ALL),
 bits AS (SELECT DISTINCT id, (('0x' || substr(c, 1, 8))::BIGINT % 2048)::INT AS bit FROM (FROM c0 UNION ALL FROM c1 UNION ALL FROM c2))"""


@query(f"WITH {GRAPHS}, {SEEN} SELECT id, count(*)::INT AS n_bits, string_agg(bit, ',' ORDER BY bit) AS bits FROM bits GROUP BY id")
def molecule_fingerprints(spark, sf):
    """Circular fingerprints of radius 2 as places of 2,048 bits."""
    m = kept(molecules(spark, sf).select("text", graphs.fingerprint_bits().alias("bits")))
    return of_parts(spark, sf, m.select("text", F.size("bits").alias("n_bits"), F.array_join("bits", ",").alias("bits")))


@query(
    f"""WITH {GRAPHS}, {SEEN}, one AS (SELECT r, c, g, min(id) AS id FROM mol GROUP BY ALL), own AS (SELECT id, count(*) AS n FROM bits JOIN one USING (id) GROUP BY id),
 common AS (SELECT x.id AS a, y.id AS b, count(*) AS n FROM bits x JOIN one o ON o.id = x.id JOIN bits y ON y.bit = x.bit AND x.id < y.id JOIN one p ON p.id = y.id GROUP BY ALL)
 SELECT a, b, round(c.n / (x.n + y.n - c.n), 6) AS sim FROM common c JOIN own x ON x.id = a JOIN own y ON y.id = b WHERE c.n / (x.n + y.n - c.n) >= 0.8""",
    DOUBLE="sim",
)
def similar_molecules(spark, sf):
    """Pairs of different molecules whose circular fingerprints are 0.8 alike or more; they meet on their rarest bits."""
    first = spellings(spark, sf).groupBy("text").agg(F.min("id").alias("id"))
    keyed = met(first, kept(molecules(spark, sf).select("text", graphs.canonical_key().alias("key"), graphs.fingerprint_bits().alias("bits"))), "text")
    one = kept(keyed.groupBy("key").agg(F.min("id").alias("id"), F.min_by("bits", "id").alias("bits")).select("id", graphs.words(F.col("bits")).alias("words")))
    return similarity.similarity_join(one, "id", "words", 0.8).select("a", "b", F.round("sim", 6).alias("sim"))


@query("WITH c AS (SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY p_partkey % 28, p_size % 7, p_partkey % 11) AS class_id FROM part) SELECT id, class_id, count(*) OVER (PARTITION BY class_id) AS n FROM c")
def canonical_molecules(spark, sf):
    """Two spellings of one molecule meet: the class of each part's, by canonical key; classes are met by an aggregate of texts, not one window a class."""
    texts = spellings(spark, sf).groupBy("text").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    keyed = kept(met(texts, kept(molecules(spark, sf).select("text", graphs.canonical_key().alias("key"))), "text"))
    classes = keyed.groupBy("key").agg(F.min("first").alias("class_id"), F.sum("n").alias("n"))
    return of_parts(spark, sf, keyed.select("text", "key").join(classes, "key").select("text", "class_id", "n"))


def pattern_sql(ord_: int, name: str, text: str) -> str:
    """All mappings of a pattern by one join for each of its bonds, in the order they are written."""
    atoms, bonds = drawn_graph(text)
    tables, where = [], []
    for i, (elem, aromatic, charge, _) in enumerate(atoms, 1):
        tables.append(f"atom x{i}")
        where += [f"x{i}.id = x1.id"] * (i > 1) + [f"x{i}.elem = '{elem}'", f"x{i}.aromatic = {aromatic}", f"x{i}.charge = {charge}"] + [f"x{i}.i <> x{j}.i" for j in range(1, i)]
    for k, (a, b, order, aromatic) in enumerate(bonds):
        tables.append(f"edge e{k}")
        where += [f"e{k}.id = x1.id", f"e{k}.u = x{a}.i", f"e{k}.v = x{b}.i", f"e{k}.ord = {order}", f"e{k}.aromatic = {aromatic}"]
    places = ", ".join(f"x{i}.i" for i in range(1, len(atoms) + 1))
    return f"SELECT x1.id, {ord_} AS ord, '{name}' AS alert, count(*) AS n_mappings, count(DISTINCT list_sort([{places}])) AS n_places FROM {', '.join(tables)} WHERE {' AND '.join(where)} GROUP BY x1.id"


ALERT_SQL = " UNION ALL ".join(pattern_sql(i, n, s) for i, (n, s) in enumerate(substructure.ALERTS))


def alerts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, i, s) for i, (n, s) in enumerate(substructure.ALERTS)], "alert string, ord int, smiles string")


@query(f"WITH {GRAPHS} SELECT id, alert, n_mappings, n_places FROM ({ALERT_SQL})")
def structural_alerts(spark, sf):
    found = substructure.matches(molecules(spark, sf), alerts(spark), "text")
    return of_parts(spark, sf, found.select("text", "alert", "n_mappings", "n_places"))


@query(f"WITH {GRAPHS}, found AS ({ALERT_SQL}) SELECT p_partkey AS id, arg_min(alert, ord) AS alert, count(alert) AS n_alerts FROM part LEFT JOIN found ON id = p_partkey GROUP BY p_partkey")
def first_alerts(spark, sf):
    """Which alert rejects a molecule first."""
    m = molecules(spark, sf)
    return of_parts(spark, sf, substructure.first_alert(m, substructure.matches(m, alerts(spark), "text"), "text"))


# ---- growth


@query(
    """SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'F' || p_partkey WHEN 1 THEN 'F' || p_partkey WHEN 2 THEN 'amide' WHEN 3 THEN 'C1CCNCC1' ELSE 'ring' END AS name,
 CASE p_partkey % 6 WHEN 0 THEN 'c1ccccc1' WHEN 1 THEN 'CC(=O)N' WHEN 2 THEN '[C:1](=O)N' WHEN 3 THEN 'C1CCNCC1' ELSE 'c1ccncc1' END AS smiles, CASE p_partkey % 6 WHEN 2 THEN 1 END AS map, CASE p_partkey % 6 WHEN 0 THEN 6 WHEN 1 THEN 4 WHEN 2 THEN 3 ELSE 6 END AS n_atoms FROM part WHERE p_partkey % 6 < 5""",
    INT="map n_atoms",
)
def fragment_rows(spark, sf):
    """Lines of fragment files, one of each part: tabs, commas, map numbers, a bare SMILES, comments and text that is none."""
    n = F.col("p_partkey")
    k = n % 6
    line = F.when(k == 0, F.concat(F.lit("c1ccccc1\tF"), n)).when(k == 1, F.concat(F.lit("F"), n, F.lit(',"CC(=O)N"'))).when(k == 2, "[C:1](=O)N amide 1").when(k == 3, " C1CCNCC1 ").when(k == 4, "c1ccncc1  ring").otherwise(F.when(n % 12 == 5, "# comment").otherwise("c1cc broken("))
    return fragments.read_lines(table(spark, sf, "part").select(n.alias("id"), line.alias("line")), "line").select("id", "name", "smiles", "map", F.size("graph.atoms").alias("n_atoms"))


def fragment_table(spark: SparkSession, sf: str) -> DataFrame:
    """A fragment library from the distinct brands of the given parts (25), one fragment each: rings, fixed fragments, single atoms and alkenes in turn."""
    kinds = [(n, s, growth.RING, 1, 0, None) for n, s in fragments.RINGS[:8]] + [(n, s, growth.FIXED, 1, m, None) for n, s, m in fragments.FIXED] + [(n, n, growth.FIRST, 1, 0, None) for n, *_ in fragments.SINGLE_ATOMS] + [(n, "C=CC", growth.FIRST, 1, 0, e) for n, e in fragments.ALKENES]
    every = spark.createDataFrame([(i, *k) for i, k in enumerate(kinds)], "i int, name string, smiles string, kind string, order int, map int, stereo string")
    brands = table(spark, sf, "part").select(F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("b")).distinct()
    used = brands.select(F.pmod(F.col("b"), F.lit(len(kinds))).alias("i")).distinct()
    return growth.library(every.join(F.broadcast(used), "i", "left_semi").drop("i"))


def fragment_values() -> str:
    """Of each fragment: name, index, atoms, bonds, weight without the hydrogen that the new bond replaces (null: no room)."""
    rows = []
    kinds = [(n, s, "ring", 0) for n, s in fragments.RINGS[:8]] + [(n, s, "fixed", m) for n, s, m in fragments.FIXED] + [(n, n, "first", 0) for n, *_ in fragments.SINGLE_ATOMS] + [(n, "C=CC", "first", 0) for n, _ in fragments.ALKENES]
    weights = {"C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "S": 32.06, "Cl": 35.45, "Br": 79.904}
    for i, (name, text, kind, _) in enumerate(kinds):
        atoms, bonds = drawn_graph(re.sub(r"\[([A-Z]):\d\]", r"\1", text))
        h = []
        for j, (elem, aromatic, _, given) in enumerate(atoms, 1):
            used = sum(o for a, b, o, _ in bonds if j in (a, b)) + aromatic
            h.append(given if given is not None else min((v - used for v in smiles.VALENCES[elem][: 1 if aromatic else None] if v >= used), default=0))
        # the new bond takes a hydrogen of the atom it is made at; one without turns to its next valence
        at = 0 if kind != "ring" else next(j for j, (elem, aromatic, *_) in enumerate(atoms) if h[j] and not (elem == "N" and aromatic))
        used = sum(o for a, b, o, _ in bonds if at + 1 in (a, b)) + 1
        h[at] = h[at] - 1 if h[at] else min(v - used for v in smiles.VALENCES[atoms[at][0]] if v >= used)
        rows.append((name, i, len(atoms), len(bonds), round(sum(weights[a[0]] for a in atoms) + 1.008 * sum(h), 6)))
    return values(rows)


@query(
    f"""WITH {GRAPHS}, frag(name, i, n, m, w) AS (VALUES {fragment_values()}), lib AS (SELECT DISTINCT frag.* FROM part JOIN frag ON i = regexp_extract(p_brand, '(\\d+)', 1)::INT % 29),
 own AS (SELECT id, count(*) AS n, sum({WEIGHT} + h * 1.008) AS w FROM atom GROUP BY id), nb AS (SELECT id, count(*) AS m FROM bond GROUP BY id),
 spot AS (SELECT id, i - 1 AS attach FROM atom WHERE h > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY md5('7' || chr(0) || id || chr(0) || (i - 1)), i) <= 2),
 pick AS (SELECT id, attach, lib.* FROM spot, lib QUALIFY row_number() OVER (PARTITION BY id, attach ORDER BY md5('8' || chr(0) || id || chr(0) || attach || chr(0) || name), name) <= 3)
 SELECT id, attach, name, (own.n + pick.n)::INT AS n_atoms, (nb.m + pick.m + 1)::INT AS n_bonds, round(own.w - 1.008 + pick.w, 3) AS weight FROM pick JOIN own USING (id) JOIN nb USING (id)""",
    DOUBLE="weight",
    INT="attach",
)
def grown_products(spark, sf):
    """Every molecule grown at two places by three fragments of the library each."""
    states = spelt(spark, sf).select("id", "smiles")
    out = growth.grown_from(states, read(states, "smiles").select("smiles", "graph"), "smiles", fragment_table(spark, sf), ["id"], 2, 3, 7)
    return out.select("id", "attach", "name", F.size("graph.atoms").alias("n_atoms"), F.size("graph.bonds").alias("n_bonds"), F.round("MW", 3).alias("weight"))


def scores(rows: DataFrame) -> DataFrame:
    """(key, value): how near a molecule is to 25 heavy atoms, 80 of polar surface and three rings; sulfur with halogens is a failure."""
    near = lambda c, best, width: F.exp(-F.pow((F.col(c) - best) / width, 2))
    value = F.round((near("HAC", 25, 12) + near("TPSA", 80, 60) + near("Rings", 3, 2)) / 3, 6)
    return rows.where(~(F.col("key").rlike("S") & F.col("key").rlike("Cl|Br|F"))).select("key", value.alias("value"))


@query()
def molecule_beam(spark, sf):
    """A beam of molecules at each supplier's anchor, all in one job, scored through one memo."""
    anchors = table(spark, sf, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("anchor"))
    memo = growth.Memo(scores, ["HAC", "TPSA", "Rings"])
    found = growth.search(anchors, kept(fragment_table(spark, sf)), memo, group="anchor", accept=F.col("HAC") >= 8, grows=F.col("HAC") < 30, beam_width=4, steps=3, max_output=10, max_attach=2, max_frags=3, seed=11)
    return found.select("anchor", "rank", "key", "parent", "growth_step", "score", "HAC", F.round("TPSA", 2).alias("TPSA"), "Rings")
