"""SQL of the training-data queries that SQL can express."""

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"list_filter(regexp_split_to_array({LOWERED}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

NEAR = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS w FROM documents),
sh AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END)) AS s FROM w),
k AS (SELECT s, len(s) AS n, min(doc_id) AS rep, count(*) AS copies FROM sh WHERE len(s) > 0 GROUP BY s),
e AS (SELECT rep, n, unnest(s) AS g FROM k),
p AS (SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.g = b.g AND a.rep <> b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 9 * count(*) >= 4 * (a.n + b.n)),
r(a, b) AS (SELECT rep, rep FROM k UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a AS rep, min(b) AS class_id FROM r GROUP BY a),
l AS (SELECT p.a AS rep, count(*) AS sets, sum(k.copies) AS docs FROM p JOIN k ON k.rep = p.b GROUP BY p.a)
SELECT sh.doc_id, coalesce(c.class_id, sh.doc_id) AS class_id, (coalesce(k.copies, 1) - 1 + coalesce(l.docs, 0))::BIGINT AS n_links, coalesce(k.copies, 1)::BIGINT AS n_copies, coalesce(l.sets, 0)::BIGINT AS n_set_links
FROM sh LEFT JOIN k ON sh.s = k.s AND len(sh.s) > 0 LEFT JOIN c ON c.rep = k.rep LEFT JOIN l ON l.rep = k.rep"""

HITS = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item, n, list_slice(w, i, i + n - 1) AS g FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
grams AS (SELECT r, i, n, list_slice(w, i, i + n - 1) AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT r, i, grams.n AS n, item FROM grams JOIN win ON win.g = grams.g),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)"""

TOP = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS c FROM embeddings
 WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS vec_id, list_sum(list_transform(list_zip(q.c, d.c), lambda z: z[1] * z[2]))::BIGINT AS score FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.c) = len(d.c) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""

#: Kind, leading context (a look-behind elsewhere; its length is no part of the span), pattern, group that must have six characters.
SECRETS = [
    ("assign", "()", r"""((?i:password|passwd|secret|token|api_?key)["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+))""", 3),
    ("access", "()", "(AKIA[A-Z0-9]{16,})", 2),
    ("hex", "()", "([0-9a-f]{24,})", 2),
    ("pem", "()", "(-----BEGIN (?:[A-Z0-9]{1,20} ){0,4}PRIVATE KEY-----)", 2),
    ("github", "(^|[^A-Za-z0-9_])", "(gh[pousr]_[A-Za-z0-9]{36,})", 2),
    ("slack", "(^|[^A-Za-z0-9_])", "(xox[abprs]-[A-Za-z0-9-]{10,})", 2),
    ("jwt", "(^|[^A-Za-z0-9_-])", r"(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 2),
]


def _matches(no: int, kind: str, before: str, pattern: str, group: int) -> str:
    p = "'" + (before + pattern).replace("'", "''") + "'"
    return f"SELECT r, {no} AS no, '{kind}' AS kind, regexp_split_to_array(t, {p}) AS gaps, regexp_extract_all(t, {p}, 0) AS m, regexp_extract_all(t, {p}, 1) AS lead, regexp_extract_all(t, {p}, {group}) AS v FROM d"


LEDGER = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_matches(i, *x) for i, x in enumerate(SECRETS))}),
g AS (SELECT r, no, kind, gaps, m, lead, v, unnest(range(1, len(m) + 1)) AS i FROM f WHERE len(m) > 0),
s AS (SELECT r, no, kind, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a, length(m[i]) AS n, length(lead[i]) AS l, length(v[i]) AS k FROM g),
q AS (SELECT r, no, kind, (a + l)::BIGINT AS s, (a + n)::BIGINT AS e FROM s WHERE k >= 6),
o AS (SELECT r, count_if(kind = 'assign') AS n_assign, count_if(kind = 'access') AS n_access, count_if(kind = 'hex') AS n_hex,
 string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no) FILTER (no < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no) AS spans FROM q GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN o USING (r)"""


DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
LUHN = f"list_sum(list_transform(string_split(reverse({DIGITS}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT WHEN c::INT > 4 THEN c::INT * 2 - 9 ELSE c::INT * 2 END)) % 10 = 0"
#: Kind, pattern, what a match has to meet.
PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(v, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(p AS HUGEINT), 999) > 255)) = 0"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({DIGITS}) BETWEEN 16 AND 19 AND {LUHN}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({DIGITS}) BETWEEN 8 AND 15"),
]
BASE_SPANS = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(f"SELECT r, {no} AS no, '{kind}' AS kind, regexp_split_to_array(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS m FROM d" for no, (kind, p, _) in enumerate(PERSONAL))}),
g AS (SELECT r, no, kind, gaps, m, unnest(range(1, len(m) + 1)) AS i FROM f WHERE len(m) > 0),
s AS (SELECT r, no, kind, m[i] AS v, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a FROM g),
q AS (SELECT r, no, kind, a::BIGINT AS s, (a + length(v))::BIGINT AS e FROM s WHERE CASE no {" ".join(f"WHEN {no} THEN {test}" for no, (_, _, test) in enumerate(PERSONAL))} END),
o AS (SELECT r, {", ".join(f"count_if(no = {no}) AS n_{kind}" for no, (kind, _, _) in enumerate(PERSONAL))}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY no, s) AS base FROM q GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0)::BIGINT AS n_{kind}" for kind, _, _ in PERSONAL)}, sha256(coalesce(base, '')) AS base_sha256 FROM d LEFT JOIN o USING (r)"""


def _remainder(i: int) -> int:
    for _ in range(8):
        i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
    return i


CRC = f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: ('0x' || p)::BIGINT)),
 lambda c, b: xor(c >> 8, {[_remainder(i) for i in range(256)]}[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"""


def _draw(*parts: str) -> str:
    text = " || chr(0) || ".join(f"coalesce({p}::VARCHAR, chr(0))" for p in parts)
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


SHARDS = f"""WITH d AS (SELECT doc_id, source, (octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS size, {CRC} AS crc FROM documents),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size, crc) AS copy FROM d),
h AS (SELECT *, coalesce(source, chr(0)) AS stratum, {_draw("17", "doc_id", "source", "size", "crc", "copy")} AS hash FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY hash, doc_id NULLS FIRST, size, crc, copy) AS rank, count(*) OVER (PARTITION BY stratum) AS rows FROM h),
p AS (SELECT *, row_number() OVER (ORDER BY (rank - 1 + {_draw("18", "stratum")}::DOUBLE / 2.0::DOUBLE ** 60)::DOUBLE / rows, stratum, rank) - 1 AS position, count(*) OVER () AS n FROM k),
s AS (SELECT *, position * 16 // n AS shard FROM p)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, shard::INT AS shard, (position - (shard * n + 15) // 16)::BIGINT AS slot, NULL::INT AS grown_shard, source, rank::BIGINT AS stratum_rank FROM s"""

ORACLES: dict[str, str] = {"op4_neardup": NEAR, "pii_base_spans": BASE_SPANS, "op6_decontaminate": HITS, "op7_interleave": SHARDS, "op9_topk": TOP, "op10_ledger": LEDGER}


def op11_sql(k: int = 40, rounds: int = 5, dim: int = 64) -> str:
    """Lloyd's rounds unrolled; squared distances by scalar products, exact in doubles for components below 2**20."""
    steps = [
        f"""v AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
    WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, x) - 1 AS INTEGER) AS k, x FROM v QUALIFY k < {k})",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (SELECT r, min(s) AS s FROM (
    SELECT v.r, {{'d': list_dot_product(v.x, v.x) - 2 * list_dot_product(v.x, c.x) + list_dot_product(c.x, c.x), 'k': c.k}} AS s FROM v, c{i} c) GROUP BY r)"""
        )
        if i < rounds:
            steps.append(
                f"""m{i} AS (SELECT k, list(m ORDER BY j) AS x FROM (SELECT a.s.k AS k, j, floor(sum(v.x[j]) / count(*)) AS m FROM v JOIN a{i} a USING (r), range(1, {dim + 1}) t(j) GROUP BY ALL) GROUP BY k),
c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m USING (k))"""
            )
    return f"""WITH {", ".join(steps)}
SELECT v.vec_id, a.s.k AS cluster, CAST(a.s.d AS BIGINT) AS distance, CAST(sum(a.s.d) OVER (PARTITION BY a.s.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.s.d) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(list_transform(c.x, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
FROM v JOIN a{rounds} a USING (r) JOIN c{rounds} c ON c.k = a.s.k"""


ORACLES["op11_drake"] = op11_sql()
