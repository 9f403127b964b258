import random

from tests.llm import brute
from tidemill.llm import decontam


def tables(spark, rows, items):
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")


def found(df):
    return {(r.doc_id, r.item_id) for r in df.collect()}


def test_equals_brute_force(spark, small):
    docs, items = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute.leaks([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in items.collect()])
    out = decontam.contaminated(docs, items)
    assert want and found(out) == want
    clean = decontam.decontaminate(docs, items)
    assert clean.schema == docs.schema
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_near_leaks(spark):
    """Items with one changed word anywhere, within other text: similar ones are found, others are not."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randint(15, 80)))) for i in range(40)]
    rows, n = [], 0
    for _, text in items:
        for _ in range(6):
            own = text.split()
            for _ in range(rng.choice((0, 1, 1, 2))):
                own[rng.randrange(len(own))] = word()
            rows.append((n, " ".join([word() for _ in range(30)]) + ". " + " ".join(own).upper() + ", " + " ".join([word() for _ in range(20)])))
            n += 1
    want = brute.leaks(rows, items)
    out = found(decontam.contaminated(*tables(spark, rows, items)))
    assert len(want) > 100
    assert out == want  # shingles of these items are all equally rare, so weights change nothing


def test_edges(spark):
    items = [(1, "one two three four five six seven eight nine ten"), (2, None), (3, ""), (4, "tiny item"), (None, "a b c d e f g h i j k")]
    rows = [(1, "one two three four five six seven eight nine ten"), (1, "x ONE two three, four five six seven eight nine ten y"), (2, None), (3, ""), (4, "one two three four"), (5, "Tiny item!"), (6, "a tiny item"), (None, "a b c d e f g h i j k")]
    df, bench = tables(spark, rows, items)
    out = decontam.contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in out} == {(1, 1), (5, 4), (None, None)} and len(out) == 3
    best = next(r for r in out if r.doc_id == 1)
    assert (best.similarity, best.word, best.words) == (1.0, 0, 10)
    assert sorted(r.doc_id for r in decontam.decontaminate(df, bench).collect()) == [2, 3, 4, 6]
    assert decontam.contaminated(df.limit(0), bench).count() == 0
    assert decontam.contaminated(df, bench.limit(0)).count() == 0
    assert decontam.decontaminate(df, bench.limit(0)).count() == len(rows)


def test_multi_index_is_complete():
    import numpy as np

    rng = np.random.default_rng(4)
    items = decontam.Items([0, 1], ["a b c d e f g h", "q r s t u v w x"], {}, 1)
    prints = np.repeat(items.prints[:1], 300, axis=0)
    for i in range(300):
        prints[i, rng.choice(128, i % 60, replace=False)] ^= True
    near = {tuple(x) for x in items.near(prints, 8).tolist()}
    assert near == {(i, j) for i in range(300) for j in (0, 1) if (prints[i] != items.prints[j]).sum() <= decontam.RADIUS}


def test_blocks_of_items_change_nothing(spark, small, monkeypatch):
    docs, items = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(tuple, decontam.contaminated(docs, items).collect()))
    clean = sorted(r.doc_id for r in decontam.decontaminate(docs, items).collect())
    monkeypatch.setattr(decontam, "ITEM_BLOCK", 9)
    assert len(decontam._item_blocks(decontam._with_text(items, "item_id", "text"))) > 2
    assert sorted(map(tuple, decontam.contaminated(docs, items).collect())) == whole
    got = decontam.decontaminate(docs.withColumn("holds", docs.doc_id), items)
    assert got.columns == [*docs.columns, "holds"] and sorted(r.doc_id for r in got.collect()) == clean


def test_edges_with_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "ITEM_BLOCK", 1)
    test_edges(spark)
