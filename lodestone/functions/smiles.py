"""SMILES text to molecule graphs, as one fold over its tokens.

A graph is a struct of two arrays.  atoms: elem, aromatic, charge, h (hydrogens),
map (atom map number, 0: none); bonds: a, b (places from 1), order (1 to 3) and
aromatic (then order is 1).  Isotopes and marks of stereochemistry are read and
left out; dots separate components.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ATOM = "struct<elem:string,aromatic:boolean,charge:int,h:int,map:int>"
BOND = "struct<a:int,b:int,order:int,aromatic:boolean>"
GRAPH = f"struct<atoms:array<{ATOM}>,bonds:array<{BOND}>>"
STATE = f"struct<atoms:array<{ATOM}>,bonds:array<{BOND}>,last:int,stack:array<int>,sign:string,open:array<struct<label:string,atom:int,sign:string>>,ok:boolean>"
#: Atoms, bonds, branches, ring closures.
TOKEN = r"\[[^\[\]]+\]|Br|Cl|[BCNOPSFI]|[bcnops]|[-=#:/\\.]|[()]|%\d\d|\d"
#: Inside brackets: isotope, element, chirality, hydrogens, charge, map number.
INSIDE = r"^\[\d*([A-Z][a-z]?|[bcnops]|se|as)@*(?:H(\d*))?([+-]*)(\d*)(?::(\d+))?\]$"
#: Usual valences (fixed values); hydrogens fill up to the least that the bonds don't exceed.
VALENCES = {"B": [3], "C": [4], "N": [3, 5], "O": [2], "P": [3, 5], "S": [2, 4, 6], "F": [1], "Cl": [1], "Br": [1], "I": [1]}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def number(text: Column, blank: int) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(blank))


def atom(token: Column) -> Column:
    """An atom token; h is null where the valence tells it; null for brackets that can't be read."""
    part = lambda i: F.regexp_extract(token, INSIDE, i)
    symbol = part(1)
    signs = part(3)
    charge = F.when(signs == "", 0).otherwise(F.when(signs.startswith("-"), -1).otherwise(1) * F.greatest(F.length(signs), number(part(4), 0)))
    h = F.when(~token.rlike(r"^\[\d*(?:[A-Z][a-z]?|[bcnops]|se|as)@*H"), 0).otherwise(number(part(2), 1))
    build = lambda s, charge, h, m: F.struct(F.initcap(s).alias("elem"), s.rlike("^[a-z]").alias("aromatic"), charge.cast("int").alias("charge"), h.cast("int").alias("h"), m.cast("int").alias("map")).cast(ATOM)
    bracket = F.when(symbol != "", build(symbol, charge, h, number(part(5), 0)))
    return F.when(token.startswith("["), bracket).otherwise(build(token, F.lit(0), F.lit(None), F.lit(0)))


def bond(state: Column, a: Column, b: Column, sign: Column, atoms: Column) -> Column:
    soft = F.get(atoms, a - 1)["aromatic"] & F.get(atoms, b - 1)["aromatic"]
    aromatic = (sign == ":") | ((sign == "") & soft)
    order = F.when(sign == "=", 2).when(sign == "#", 3).otherwise(1)
    return F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), order.alias("order"), aromatic.alias("aromatic")).cast(BOND)


def step(s: Column, t: Column) -> Column:
    """The state after one token."""
    none_bonds = F.expr(f"cast(array() as array<{BOND}>)")
    last, sign, n = s["last"], s["sign"], F.size(s["atoms"])
    is_atom, is_ring = t.rlike(r"^[\[A-Za-z]"), t.rlike(r"^[%\d]")
    new = atom(t)
    atoms = F.when(is_atom, F.concat(s["atoms"], F.array(new))).otherwise(s["atoms"])
    partner = F.get(F.filter(s["open"], lambda o: o["label"] == t), 0)
    closes = is_ring & partner.isNotNull()
    own_sign = F.when(sign != "", sign).otherwise(partner["sign"])
    made = F.when(is_atom & (last > 0), F.array(bond(s, last, n + 1, sign, F.concat(s["atoms"], F.array(new))))).when(closes, F.array(bond(s, partner["atom"], last, own_sign, s["atoms"]))).otherwise(none_bonds)
    open_ = F.when(closes, F.filter(s["open"], lambda o: o["label"] != t)).when(is_ring, F.concat(s["open"], F.array(F.struct(t.alias("label"), last.alias("atom"), sign.alias("sign"))))).otherwise(s["open"])
    stack = F.when(t == "(", F.concat(s["stack"], F.array(last))).when(t == ")", F.slice(s["stack"], F.lit(1), F.greatest(F.size(s["stack"]) - 1, F.lit(0)))).otherwise(s["stack"])
    at = F.when(is_atom, n + 1).when(t == ")", F.coalesce(F.get(s["stack"], F.size(s["stack"]) - 1), F.lit(0))).when(t == ".", 0).otherwise(last)
    waits = t.rlike(r"^[-=#:/\\]$")
    right = (
        F.when(is_atom, new.isNotNull())
        .when(is_ring, (last > 0) & (~closes | ((partner["atom"] != last) & ((sign == "") | (partner["sign"] == "") | (sign == partner["sign"])))))
        .when(t == ")", (F.size(s["stack"]) > 0) & (sign == ""))
        .when(t == ".", (sign == "") & (F.size(s["stack"]) == 0))
        .otherwise((last > 0) & (sign == ""))
    )
    mark = F.when(waits, F.when(t.isin("/", "\\"), "-").otherwise(t)).otherwise("")
    # a sign of direction says nothing more than a single bond
    return F.struct(atoms.alias("atoms"), F.concat(s["bonds"], made).alias("bonds"), at.cast("int").alias("last"), stack.alias("stack"), mark.alias("sign"), open_.alias("open"), (s["ok"] & right).alias("ok")).cast(STATE)


def degree_sum(bonds: Column, i: Column) -> Column:
    """Sum of the bond orders at atom ``i``."""
    return F.aggregate(F.filter(bonds, lambda b: (b["a"] == i) | (b["b"] == i)), F.lit(0), lambda s, b: s + b["order"])


def with_hydrogens(atoms: Column, bonds: Column) -> Column:
    """Atoms with the hydrogens that their usual valence leaves; an aromatic atom gives one more bond to its ring."""
    usual = F.create_map(*[x for k, v in VALENCES.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in v]))])

    def filled(x: Column, i: Column) -> Column:
        used = degree_sum(bonds, i + 1) + x["aromatic"].cast("int")
        some = F.try_element_at(usual, x["elem"])
        some = F.when(x["aromatic"], F.slice(some, 1, 1)).otherwise(some)
        free = F.coalesce(F.array_min(F.transform(F.filter(some, lambda v: v >= used), lambda v: v - used)), F.lit(0))
        return x.withField("h", F.coalesce(x["h"], free).cast("int"))

    return F.transform(atoms, filled)


def graph(smiles: Column) -> Column:
    """The graph of a SMILES (white space around it is left out); null for text that is none."""
    start = F.expr(f"cast(named_struct('atoms', array(), 'bonds', array(), 'last', 0, 'stack', array(), 'sign', '', 'open', array(), 'ok', true) as {STATE})")
    whole = lambda s: s["ok"] & (s["sign"] == "") & (F.size(s["open"]) == 0) & (F.size(s["stack"]) == 0) & (F.size(s["atoms"]) > 0)
    built = lambda s: F.struct(with_hydrogens(s["atoms"], s["bonds"]).alias("atoms"), s["bonds"].alias("bonds")).cast(GRAPH)
    read = lambda text, tokens: F.when(F.array_join(tokens, "") == text, F.aggregate(tokens, start, step))
    text = F.trim(smiles)
    return let(let(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda tokens: read(text, tokens)), lambda s: F.when(whole(s), built(s)))
