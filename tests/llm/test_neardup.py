import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import brute
from tidemill.llm import neardup, textops
from tidemill.llm.graph import components


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def got(df):
    return {r.doc_id: r.class_id for r in df.collect()}


def test_equals_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    assert got(neardup.near_duplicates(docs)) == brute.classes([tuple(r) for r in docs.collect()])


def test_edges(spark):
    rng = random.Random(1)
    base = [rng.choice("abcdefghij") * rng.randint(1, 6) for _ in range(120)]
    near = base.copy()
    near[60] = "changed"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base).upper() + "!"), (4, None), (5, ""), (6, "..."), (7, "one two"), (8, "One, two."), (9, "one two three"), (1, " ".join(base)), (None, " ".join(base)), (None, None)]
    out = neardup.near_duplicates(table(spark, rows))
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.class_id if r.class_id is not None else -1) for r in out.collect())
    assert found == sorted([(1, 1), (1, 1), (2, 1), (3, 1), (-1, 1), (4, 4), (5, 5), (6, 6), (7, 7), (8, 7), (9, 9), (-1, -1)])
    kept = neardup.deduplicate(table(spark, rows))
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == [-1, 1, 4, 5, 6, 7, 9]
    assert neardup.near_duplicates(table(spark, [])).count() == 0
    assert neardup.deduplicate(table(spark, [])).count() == 0


def test_hot_groups(spark):
    """A large group of near copies with one changed word each, and one of exact copies, in split buckets."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 700):
        own = base.copy()
        own[rng.randrange(150)] = word()
        rows.append((i, " ".join(own)))
    rows += [(i, " ".join(base[:80])) for i in range(1000, 1200)]
    rows += [(i, " ".join(word() for _ in range(100))) for i in range(2000, 2040)]
    out = got(neardup.near_duplicates(table(spark, rows)))
    assert {out[i] for i in range(700)} == {0}
    assert {out[i] for i in range(1000, 1200)} == {1000}
    assert all(out[i] == i for i in range(2000, 2040))


def test_heavy_keys_are_dealt(spark, monkeypatch):
    """With a low bar for heavy keys, texts, buckets, units and nodes of all kinds are salted."""
    monkeypatch.setattr("tidemill.llm.common.HEAVY_ROWS", 20)
    monkeypatch.setattr("tidemill.llm.common.HEAVY", 8)
    monkeypatch.setattr(neardup, "BUCKET_CHUNK", 30)
    rows = family(120, 300, 45, 11) + [(1000 + i, "one text that many rows have in common, all of them") for i in range(100)]
    want = brute.classes(rows[:120]) | {i: 1000 for i in range(1000, 1100)}
    assert got(neardup.near_duplicates(table(spark, rows))) == want
    star = [(0, i) for i in range(1, 300)] + [(i, 1000) for i in range(400, 500)] + [(500, 501)]
    out = {r.node: r.root for r in components(spark.createDataFrame(star, "a bigint, b bigint")).collect()}
    assert {out[i] for i in range(300)} == {0} and {out[i] for i in (*range(400, 500), 1000)} == {400} and out[501] == 500


@pytest.mark.parametrize("few", [0, 10**6])
def test_prefix_join_in_large_buckets(spark, monkeypatch, few):
    """Families just below the threshold in split buckets, with texts of unequal sizes: the groups are the brute-force ones,
    whether pairs are compared one by one or in their blocks."""
    monkeypatch.setattr(neardup, "FEW", few)
    monkeypatch.setattr(neardup, "BUCKET_CHUNK", 20)
    monkeypatch.setattr(neardup, "STRAYS", 7)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, base = [], [word() for _ in range(260)]
    for i in range(130):
        own = base + [word() for _ in range(rng.randint(40, 70))]
        rows.append((2 * i, " ".join(own)))
        rows.append((2 * i + 1, " ".join(own[: len(own) - rng.randint(0, 30)] + [word() for _ in range(rng.randint(0, 25))])))
    want = brute.classes(rows)
    assert 60 < len(set(want.values())) < 260
    assert got(neardup.near_duplicates(table(spark, rows))) == want


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x", 2, [1], "r")], "doc_id bigint, text string, text_key string, key int, row array<int>, sig string")
    assert neardup.deduplicate(df).columns == df.columns
    assert neardup.deduplicate(df).count() == 1


def test_signature_estimates_weighted_similarity():
    rng = np.random.default_rng(0)
    for share in (0.2, 0.5, 0.8, 0.95):
        both = int(1000 * share)
        a = rng.integers(0, 1 << 62, 1000).astype(np.uint64)
        b = np.concatenate([a[:both], rng.integers(0, 1 << 62, 1000 - both).astype(np.uint64)])
        sig = neardup.dart_signatures(np.concatenate([a, b]), np.repeat([0, 1], 1000), 3, 1024)
        assert abs((sig[0] == sig[1]).mean() - both / (2000 - both)) < 0.06
        assert (sig[2] == np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def test_signature_depends_on_its_text_only():
    column = pa.array(["a b c d e f g", "short", None, "x y z " * 50])
    whole = list(neardup._sketch(iter([pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), column], names=["id", "text"])])))[0]
    for i in range(4):
        alone = list(neardup._sketch(iter([pa.RecordBatch.from_arrays([pa.array([i + 1]), column.slice(i, 1)], names=["id", "text"])])))[0]
        assert alone.to_pylist()[0] == whole.to_pylist()[i]


def test_shingles():
    w = textops.words(pa.array(["A b, C d E f", "", "x", None, "b c d e f"]))
    s = textops.shingles(w)
    assert w.counts.tolist() == [6, 0, 1, 0, 5] and s.counts.tolist() == [2, 0, 1, 0, 1]
    assert s.hashes[1] == s.hashes[3] and s.hashes[0] != s.hashes[1]
    assert textops.occurrences(np.array([0, 0, 0, 1]), np.array([5, 7, 5, 5], np.uint64)).tolist() == [0, 0, 1, 0]


def test_components(spark):
    chain = [(i, i + 1) for i in range(100)] + [(200, 201), (300, 300)]
    out = {r.node: r.root for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert {out[i] for i in range(101)} == {0} and out[201] == out[200] == 200
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def family(n, shared, own, same):
    """n texts with a passage of `shared` shingles and `own` of their own, `same` of them like those of the next text."""
    passage = [f"p{i}" for i in range(shared + 4)]
    return [(i, " ".join([*passage, *(f"s{i // 2}x{j}" for j in range(same)), *(f"o{i}x{j}" for j in range(own - same))])) for i in range(n)]


def test_pairs_in_a_family_below_the_threshold(spark):
    """200 texts at 0.77 to each other, 100 pairs at 0.82, in buckets of one chunk: none outranks the true partner."""
    rows = family(200, 300, 45, 11)
    assert brute.classes(rows) == {i: i // 2 * 2 for i, _ in rows}
    assert got(neardup.near_duplicates(table(spark, rows))) == {i: i // 2 * 2 for i, _ in rows}


def test_many_pairs_in_split_buckets(spark):
    """2,400 texts at 0.77 to each other, 1,200 pairs at 0.82: more strays in a bucket than meet a chunk together."""
    rows = family(2400, 60, 9, 2)
    assert brute.classes(rows[:40]) == {i: i // 2 * 2 for i in range(40)}
    assert got(neardup.near_duplicates(table(spark, rows))) == {i: i // 2 * 2 for i, _ in rows}
