"""Centroid clustering against plain Lloyd rounds."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from lodestone.llm import clusters, oracles
from lodestone.llm import queries as Q


def plain(rows, k, rounds, dim):
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    own = lambda: [min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c)) for _, v in kept]
    for _ in range(rounds):
        a = own()
        for c in range(len(centroids)):
            some = [v for (_, v), o in zip(kept, a, strict=True) if o == c]
            if some:
                centroids[c] = [sum(col) // len(some) for col in zip(*some, strict=True)]
    a = own()
    d = [far(v, centroids[c]) for (_, v), c in zip(kept, a, strict=True)]
    out = []
    for (i, _), c, x in zip(kept, a, d, strict=True):
        out.append((i, c, x, sum(y for y, o in zip(d, a, strict=True) if o == c), sum(d), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, distance string")


@pytest.mark.parametrize("seed", range(3))
def test_rows_equal_plain_rounds(spark, seed):
    rng = random.Random(seed)
    spot = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, np.array([c + rng.gauss(0, 0.2) for c in rng.choice(spot)], np.float32).tolist()) for i in range(150)]
    rows += [(500 + i, rows[0][1]) for i in range(30)] + [(500, rows[1][1]), (None, rows[2][1]), (900, None), (901, []), (902, [0.5] * 5), (903, [math.nan] + [0.0] * 5), (904, [math.inf] + [0.0] * 5), (905, [None] + [0.0] * 5)]
    rows += [(1000 + i, [float(x), 0.0, 0.0, 0.0, 0.0, 0.0]) for i, x in enumerate([0, 0, 1, 1, 2, -2])]  # ties
    found = clusters.cluster(vectors(spark, rows), k=12, rounds=5, dim=6)
    got = [tuple(r) for r in clusters.digest(found).collect()]
    assert order(got) == order(plain(rows, 12, 5, 6))
    assert [r[0] for r in found.rounds][0] == 3 and all(r[0] >= 1 for r in found.rounds)
    assert sum(r[2] for r in found.rounds[1:]) < 4 * found.rounds[0][2]  # bounds certify some vectors without a full rescan


def test_few_vectors_wide_components_and_empty_tables(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-300000.0, 300000.5])]
    got = [tuple(r) for r in clusters.digest(clusters.cluster(vectors(spark, rows), k=40, dim=2)).collect()]
    assert order(got) == order(plain(rows, 40, 5, 2))
    none = clusters.digest(clusters.cluster(vectors(spark, [(1, None)])))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from read_parquet('{sf_dir}/embeddings.parquet')")
    rel = con.sql(oracles.ORACLES["op11_drake"])
    df = Q.op11_drake(spark, sf_dir)
    assert df.columns == rel.columns
    assert sorted(map(tuple, df.collect())) == sorted(rel.fetchall())
