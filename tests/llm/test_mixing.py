import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import mixing


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [200.0, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    assert mixing.targets([0, 10], [5, 2]) == [0.0, 15.0]
    assert mixing.targets([0, 0], [5, 2]) == [0.0, 0.0]


def test_split_is_exact():
    quotas = np.array([1000, 3, 0, 517])
    for shards in (1, 2, 7, 16):
        out = mixing.split(quotas, shards, 1)
        assert (out.sum(axis=0) == quotas).all() and (out >= 0).all()
        assert out.sum(axis=1).max() - out.sum(axis=1).min() <= shards.bit_length()
    assert (mixing.split(quotas, 8, 1) == mixing.split(quotas, 8, 1)).all()


def test_whole_mixture(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    out = mixing.taken_words(docs).toPandas()
    own = docs.select("doc_id", "source", F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")).alias("n")).toPandas().set_index("doc_id")
    assert (out.set_index("doc_id")["size"].sort_index() == own["n"].sort_index()).all()
    assert (out.taken <= 2 * out["size"]).all() and (out.taken % out["size"].clip(lower=1) == 0).all()
    out["source"] = out.doc_id.map(own.source)
    by = out.groupby("source").agg(size=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by.source_size).all()
    weight = np.array([(5, 2, 1)[i % 3] for i in range(len(by))])
    assert by.target.tolist() == pytest.approx(mixing.targets(by["size"].tolist(), weight.tolist()))
    assert by.target.sum() == pytest.approx(1.5 * by["size"].sum())
    assert ((by.taken - by.target).abs() <= 0.01 * by.target).all()
    again = mixing.taken_words(docs.repartition(5)).toPandas()
    assert out.set_index("doc_id").taken.sort_index().tolist() == again.set_index("doc_id").taken.sort_index().tolist()


def test_mix_agrees_and_shards_are_disjoint(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    mixed = mixing.mix(docs, shards=4)
    assert mixed.columns == [*docs.columns, "mix_shard", "mix_turn", "mix_place"]
    taken = {r.doc_id: r.taken for r in mixing.taken_words(docs).collect()}
    words = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in words.items() if v}
    assert mixed.groupBy("doc_id", "mix_turn").count().where("count > 1").count() == 0


def plain(pieces, room, target):
    """What a partial turn takes, block after block: {piece: rows taken} of (piece, position, size, rows, hash)."""
    blocks, out = {}, {}
    for p, position, size, rows, hash_ in pieces:
        blocks.setdefault(position, []).append((p, size, rows, hash_))
    limit, short = 1 << 62, max(0, mixing.TOLERANCE * target)
    for position in sorted(blocks):
        if room <= (0 if limit == 1 << 62 else short):
            break
        own = [x for x in blocks[position] if x[1] <= limit]
        if sum(s * n for _, s, n, _ in own) <= room:
            out |= {p: n for p, _, n, _ in own}
            room -= sum(s * n for _, s, n, _ in own)
            continue
        for p, s, n, _ in sorted((x for x in own if x[1]), key=lambda x: (-x[1], x[3])):
            k = min(n, room // s)
            if k:
                out[p] = k
                room -= k * s
        limit = room
    if room > short:
        left = [(s, h, p) for p, _, s, n, h in pieces if s and out.get(p, 0) < n and s < 2 * room]
        if left:
            out[min(left)[2]] = out.get(min(left)[2], 0) + 1
    return out


def check_plan(docs, **how):
    """The plan's partial turns are the plain ones'; returns the plan."""
    plan = mixing.Plan(docs, **how)
    pieces = plan.pieces.collect()
    assert len({(r.k1, r.k2, r.piece) for r in pieces}) == len(pieces)
    assert sum(r.rows for r in pieces) == docs.count()
    for t in plan.table:
        own = [((r.k1, r.k2, r.piece), r.position, r["size"], r.rows, r.hash) for r in pieces if r.s == t["s"]]
        assert sum(x[2] * x[3] for x in own) == t["source_size"] and all(0 <= x[1] < t["blocks"] for x in own)
        room = int(t["target"] - t["turns"] * t["source_size"] + 1e-6)
        want = {p: n for p, n in plain(own, room, t["target"]).items() if t["source_size"] and any(p == x[0] and x[2] for x in own)}
        assert {(r.k1, r.k2, r.piece): r.part for r in pieces if r.s == t["s"] and r.part and r["size"]} == want
    return plan


def corpus(spark, sizes, source="a"):
    return spark.createDataFrame([(i, "w " * n, source, 1) for i, n in enumerate(sizes)], "doc_id bigint, text string, source string, n_chars bigint")


def total(out):
    return out.agg(F.sum("taken")).first()[0]


def test_equals_the_plain_version(spark, medium):
    check_plan(spark.read.parquet(f"{medium}/documents.parquet"))
    for seed in (1, 2):
        check_plan(corpus(spark, [seed + i * i % 97 for i in range(700)]).unionByName(corpus(spark, [3000, 5, 5, 5, 0], "b")), seed=seed)


def test_a_giant_and_many_small_ones(spark):
    """1,000 documents of 20 words and one of half the source's words: 30,000 of 20,000 words can be met exactly."""
    for seed in range(4):
        docs = corpus(spark, [10] * 1000 + [10_000])
        check_plan(docs, seed=seed)
        out = mixing.taken_words(docs, seed=seed)
        assert out.first().target == 30_000 and abs(total(out) - 30_000) <= 15
        assert out.where("taken > 2 * size").count() == 0


def test_repeats_and_tiny_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_HEAVY_ROWS", 128)
    same = spark.createDataFrame([(7, "x y z", "a", 1)] * 1000 + [(8, "x " * 500, "a", 1)], "doc_id bigint, text string, source string, n_chars bigint")
    check_plan(same)
    assert abs(total(mixing.taken_words(same)) - 5250) <= 3
    mixed = mixing.mix(same, shards=3)
    assert mixed.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == total(mixing.taken_words(same))
    assert mixed.groupBy("doc_id", "mix_turn").count().where("mix_turn > 1").count() == 0
    assert mixed.where("doc_id = 7").select("mix_place").distinct().count() > 1000
    # three of 1000 words and a target of 4500: one more or one less is as near; of 1000, 1, 1: 1002 and 500
    assert total(mixing.taken_words(corpus(spark, [1000] * 3))) in (4000, 5000)
    assert total(mixing.taken_words(corpus(spark, [1000, 1, 1]))) in (1004, 2002)
    # what is missing is more than half of the only document
    assert total(mixing.taken_words(corpus(spark, [100]), share=1.7)) == 200


def test_places_are_shuffled_inside_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "LOCAL_BLOCKS", 4)
    docs = corpus(spark, [3] * 3000)
    mixed = mixing.mix(docs, shards=2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one task
    mixing.write_shards(mixed, f"{tmp_path}/mixed")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = spark.read.parquet(f"{tmp_path}/mixed").withColumn("file", F.input_file_name()).withColumn("chunk", F.shiftright("mix_place", 32)).withColumn("at", F.monotonically_increasing_id())
    rows = back.orderBy("at").collect()
    assert len(rows) == mixed.count() == 4500
    assert {r.mix_shard for r in rows} == {0, 1}
    files = {}
    for r in rows:
        files.setdefault((r.mix_shard, r.file), []).append(r)
    assert len(files) > 2
    chunks = [c for own in files.values() for c in {(r.mix_shard, r.chunk) for r in own}]
    assert len(chunks) == len(set(chunks)) > 8  # a chunk is in one file
    for own in files.values():
        assert [r.mix_place for r in own] == sorted(r.mix_place for r in own)
        assert len(own) < 50 or [r.doc_id for r in own] != sorted(r.doc_id for r in own)
    half = mixed.groupBy("mix_shard").count().collect()
    assert all(abs(r["count"] - 2250) < 300 for r in half)


def test_hypergeometric_beyond_the_generators_reach():
    rng = np.random.default_rng(3)
    exact = np.array([mixing.hypergeometric(rng, 300, 700, 500, direct=0) for _ in range(4000)])
    assert abs(exact.mean() - 150) < 0.7 and abs(exact.std() - (500 * 0.3 * 0.7 * 500 / 999) ** 0.5) < 0.4
    big = mixing.hypergeometric(rng, 3 * 10**10, 7 * 10**10, 10**10)
    assert abs(big - 3 * 10**9) < 10**6
    assert mixing.hypergeometric(rng, 0, 5, 3) == 0 and mixing.hypergeometric(rng, 5, 0, 3) == 3
    left = np.array([mixing.split(np.array([40, 60, 20]), 2, seed)[0] for seed in range(2000)])
    assert (left.sum(axis=1) == 60).all() and np.abs(left.mean(axis=0) - [20, 30, 10]).max() < 0.3
    assert np.abs(left.var(axis=0) - [60 * 40 / 120 * 80 / 120 * 60 / 119, 60 * 0.5 * 0.5 * 60 / 119, 60 * 20 / 120 * 100 / 120 * 60 / 119]).max() < 0.6


def test_edges(spark, tmp_path):
    kind = "doc_id bigint, text string, source string, mix_key int, size int, draws int"
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y z", "a"), (3, "x y z", "a"), (None, "p q", None), (5, "only  five\twords\nin here", "é"), (6, "u v", "")]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], kind)
    out = mixing.taken_words(df).collect()
    assert sorted((r.doc_id if r.doc_id else 0, r["size"], r.source_size) for r in out) == [(0, 2, 2), (1, 0, 6), (2, 0, 6), (3, 3, 6), (3, 3, 6), (5, 5, 5), (6, 2, 2)]
    assert mixing.mix(df).columns[:6] == df.columns
    mixing.write_shards(mixing.mix(df), f"{tmp_path}/mixed")
    assert spark.read.parquet(f"{tmp_path}/mixed").count() == mixing.mix(df).count()
    assert mixing.taken_words(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0
    odd = df.withColumns({"m": F.create_map("doc_id", "text"), "mix_shard": F.lit(1)}).where("doc_id IS NOT NULL")
    assert mixing.mix(odd).columns == [*odd.columns, "_mix_shard", "mix_turn", "mix_place"] and mixing.mix(odd).count() > 0


def test_taken_words_are_what_the_tree_deals(spark, monkeypatch):
    """Every taken row lies in a block that the tree gave to a shard; a block that no shard gets is not taken."""
    docs = corpus(spark, [1 + i % 40 for i in range(3000)]).unionByName(corpus(spark, [5] * 700 + [0], "b")).unionByName(corpus(spark, [0, 0], "c"))
    whole = mixing.taken_words(docs)
    assert whole.count() == docs.count()
    one = {(r.doc_id, r["size"], r.source_size): r.taken for r in whole.collect()}
    assert one == {(r.doc_id, r["size"], r.source_size): r.taken for r in mixing.taken_words(docs, shards=5).collect()}
    split, seen = mixing.split, []

    def without_the_last(quotas, shards, seed):
        out = split(quotas, shards, seed)
        seen.append(int(out[-1].sum()))
        out[-1] = 0
        return out

    monkeypatch.setattr(mixing, "split", without_the_last)
    less = mixing.taken_words(docs, shards=4)
    lost, rows = total(less) / total(whole), mixing.mix(docs, shards=4)
    assert seen[0] and 0.7 < lost < 0.8 and less.count() == docs.count()
    assert rows.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == total(less)
    assert {r.mix_shard for r in rows.select("mix_shard").distinct().collect()} == {0, 1, 2}
