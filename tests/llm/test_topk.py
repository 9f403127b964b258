import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tidemill.llm import queries, topk

SCHEMA = "vec_id bigint, embedding array<float>, id int"


def brute(rows, k, every=3):
    own = [(i, np.floor(np.array(v, np.float64) * 1024).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in own:
        if q % every == 0:
            n = lambda w: int((v[: min(len(v), len(w))] * w[: min(len(v), len(w))]).sum())  # noqa: B023, E731
            best = sorted(((-n(w), i) for i, w in own if i != q))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def run(spark, rows, k):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % 3 == 0, k=k).collect())


def as_float(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


def test_random_and_ties(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice((-0.5, 0, 0.25, 1.0)) for _ in range(4)]) for i in range(200)]
    rows += [(1000 + i, [1.0, 1.0, 0.25, 0]) for i in range(100)]
    rows = as_float(rows)
    for k in (1, 10):
        assert run(spark, rows, k) == brute(rows, k)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = as_float([(0, [1, 2]), (1, [3, -1]), (2, None), (3, [nan, 1]), (4, [inf, 0]), (5, [None, 1]), (None, [1, 1]), (6, []), (7, [1]), (9, [1, 2, 3]), (10, [1e5, -1e5])])
    assert run(spark, rows, 10) == brute(rows, 10)
    assert run(spark, [(0, [1.0])], 10) == []
    assert run(spark, [], 10) == []
    assert run(spark, [(1, [1.0])], 10) == []


def test_large_values_and_blocks(spark, monkeypatch):
    rng = random.Random(6)
    rows = as_float([(i, [rng.uniform(-1e5, 1e5) for _ in range(3)]) for i in range(60)])
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    assert run(spark, rows, 5) == brute(rows, 5)


def exact(rows, k, every=3):
    """Like brute(), in Python's integers; scores are cut to 64 bits after ranking."""
    own = [(i, [int(np.floor(np.float64(x) * 1024)) for x in v]) for i, v in rows]
    out = []
    for q, v in own:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in own if i != q)[:k]
            out += [(q, r + 1, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_scores_beyond_64_bits(spark, monkeypatch):
    rng = random.Random(8)
    kind = "vec_id bigint, embedding array<double>, id int"
    find = lambda rows, k: sorted(tuple(r) for r in topk.search(spark.createDataFrame([(*r, 1) for r in rows], kind), F.col("vec_id") % 3 == 0, k=k).collect())
    rows = [(0, [3e16, 1.0]), (1, [3e16, 0.0]), (2, [1.0, 1.0])]
    assert find(rows, 10) == exact(rows, 10) and len(exact(rows, 10)) == 2
    monkeypatch.setattr(topk, "_ROWS", 16)  # small and large slices side by side
    rows = [(i, [rng.choice((-1, 1)) * 10.0 ** rng.uniform(-3, 3 if i < 60 else 30) for _ in range(3)]) for i in range(90)]
    for k in (1, 5):
        assert find(rows, k) == exact(rows, k)
    rows += [(200, [1.7e308, 1.0, 1.0]), (201, [float("inf"), 0.0, 0.0])]  # not finite once scaled: no part
    assert find(rows, 5) == exact(rows[:90], 5)


def test_sql(spark, medium):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{medium}/embeddings.parquet'")
    got = queries.op9_top_k(spark, medium)
    want = con.execute(queries.oracle_sql()["op9_top_k"])
    assert [c[0] for c in want.description] == got.columns
    assert sorted(want.fetchall()) == sorted(tuple(r) for r in got.collect())
