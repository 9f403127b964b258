"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

The rows of each source lie in blocks of about BLOCK_ROWS rows, by a hash, and a source's blocks have a
seeded permuted order. A source's target is a number of whole turns through that order and a last,
partial one. The partial turn takes whole blocks while they fit; of the block that doesn't, rows from the
largest down as long as there is room; then it goes on behind that block with the rows that still fit,
and so on. Each such round at least halves the room, so it ends when the room is within TOLERANCE of the
target or nothing fits; then the smallest row left is taken too if that comes closer to the target.

A tree then splits all drawn blocks among the output shards: a node halves its shards, draws how many
blocks of each source and turn go to the left half from a multivariate hypergeometric distribution seeded
by its place, and gives the right half the rest. At the leaves stand exact quotas; each shard takes the
next blocks of each source's order, so shards are disjoint. A shard's blocks are dealt into chunks of
about LOCAL_BLOCKS, and rows are shuffled inside of a chunk.

Only a row for each source is brought to the driver, and never more than MAX_SOURCES of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import cut, free_name

BLOCK_ROWS = 64
#: Repeats of a row that lie in one block together.
PIECE_ROWS = 64
LOCAL_BLOCKS = 64
MAX_SOURCES = 100_000
#: Sources times turns times shards: quotas that the driver holds.
MAX_QUOTAS = 8_000_000
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
#: The share of its target by which a source may be short while there are rows that fit.
TOLERANCE = 0.0005
#: Blocks that are summed together when a turn's end is looked for.
_GROUP = 1024
#: Repeats of one row over which its rows are made by several tasks, if they are also this part of all rows.
_HEAVY_ROWS, _HEAVY = 1 << 16, 512
_SALTS = 64


def word_count(text) -> F.Column:
    """The number of runs of characters other than space and U+0009 to U+000D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """What each source is to give: `share` of all sizes by weight, none over `most` times its size; what
    is over that is shared again among the others by weight, until none is over."""
    total, out = share * sum(sizes), [0.0] * len(sizes)
    capped = [w <= 0 for w in weights]
    while True:
        left = total - sum(most * s for s, c in zip(sizes, capped, strict=True) if c)
        weight = sum(w for w, c in zip(weights, capped, strict=True) if not c)
        out = [most * s if c else left * w / weight for s, w, c in zip(sizes, weights, capped, strict=True)]
        over = [not c and o > most * s for o, s, c in zip(out, sizes, capped, strict=True)]
        if not any(over):
            return [float(x) for x in out]
        capped = [c or o for c, o in zip(capped, over, strict=True)]


def split(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """shards x sources: how many of each source's blocks each shard gets; the columns add up to `quotas`."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def node(at: int, n: int, own: np.ndarray, place: int) -> None:
        if n == 1:
            out[at] = own
            return
        half = n // 2
        take = int(own.sum()) * half // n
        left = np.zeros_like(own)
        if take:
            rng, rest, wanted = np.random.default_rng([seed, place]), int(own.sum()), take
            # one source after the other: the marginals of the multivariate distribution
            for i in np.flatnonzero(own):
                rest -= int(own[i])
                left[i] = hypergeometric(rng, int(own[i]), rest, wanted)
                wanted -= int(left[i])
        node(at, half, left, 2 * place)
        node(at + half, n - half, own - left, 2 * place + 1)

    node(0, shards, quotas.astype(np.int64), 1)
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, wanted: int, direct: int = 1_000_000_000) -> int:
    """How many of `wanted` draws without replacement are good. The generator takes up to `direct`; beyond
    that, each ball is in the draw with the same chance, and draws of another size than wanted are thrown away,
    which leaves the same distribution."""
    if wanted <= 0 or good <= 0:
        return 0
    if bad <= 0:
        return min(good, wanted)
    if good + bad < direct:
        return int(rng.hypergeometric(good, bad, wanted))
    while True:
        a = rng.binomial(good, wanted / (good + bad), 1 << 16)
        hit = np.flatnonzero(a + rng.binomial(bad, wanted / (good + bad), 1 << 16) == wanted)
        if len(hit):
            return int(a[hit[0]])


def _step(blocks: int, seed: int) -> int:
    """A factor without a common divisor with `blocks`, so that steps of it reach every block once."""
    at = (seed * 0x9E3779B1 + blocks * 0x85EBCA6B) % max(1, blocks)
    while math.gcd(at, blocks) != 1:
        at += 1
    return at


def _hashed(docs: DataFrame) -> tuple[F.Column, F.Column]:
    """128 bits of all columns; rows that repeat each other share them."""
    columns = [F.to_json(F.struct(c)) if any(x in kind for x in ("map<", "variant")) else F.col(f"`{c}`") for c, kind in docs.dtypes]
    return F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)


class Plan:
    """What the mix takes. pieces: a row for up to PIECE_ROWS rows that repeat each other, with k1 and k2 (which
    tell the rows), piece, id, size (words of one), rows, s (the source's place), position (of its block),
    whole (the turns that take all rows) and part (rows that the turn behind those takes). sources: a row for each
    source with source_size, target, blocks, turns (whole ones) and drawn (blocks of the partial turn)."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, seed: int = 17, share: float = SHARE, most: int = MOST):
        self.seed, self.spark = seed, docs.sparkSession
        k1, k2 = _hashed(docs)
        units = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), k1.alias("k1"), k2.alias("k2"))
        units = cut(units.groupBy("k1", "k2", "id", "source", "size").agg(F.count("*").alias("copies")))
        rows = units.groupBy("source").agg(F.sum("copies").alias("rows"), F.sum(F.col("size") * F.col("copies")).alias("words")).limit(MAX_SOURCES + 1).collect()
        if len(rows) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        rows.sort(key=lambda r: (r["source"] is None, str(r["source"]).encode()))
        want = targets([r["words"] for r in rows], [float(weights[i % len(weights)]) for i in range(len(rows))], share, most) if rows else []
        self.kind = docs.schema[source_col].dataType.simpleString()
        self.table = []
        for i, (r, t) in enumerate(zip(rows, want, strict=True)):
            blocks, turns = -(-r["rows"] // BLOCK_ROWS), min(most, int(t // r["words"])) if r["words"] else 0
            room = int(t - turns * r["words"] + 1e-6)
            self.table.append({"s": i, "name": r["source"], "source_size": r["words"], "target": t, "blocks": blocks, "step": _step(blocks, seed + i), "turns": turns, "room": room, "from": 0, "rules": []})
        # at most _HEAVY of them
        bar = max(_HEAVY_ROWS, sum(r["rows"] for r in rows) / _HEAVY)
        self.heavy = [(r["k1"], r["k2"]) for r in units.where(F.col("copies") >= bar).select("k1", "k2").collect()]
        sources = self._broadcast("s int, name {kind}, source_size bigint, target double, blocks bigint, step bigint, turns int", "s", "name", "source_size", "target", "blocks", "step", "turns")
        # repeats of one row are dealt over many blocks
        pieces = units.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 1) / PIECE_ROWS))))
        pieces = pieces.withColumns({"rows": F.least(F.lit(PIECE_ROWS), F.col("copies") - F.col("piece") * PIECE_ROWS), "hash": F.xxhash64("k1", "k2", "piece", F.lit(seed))})
        pieces = pieces.join(sources, F.col("source").eqNullSafe(F.col("name"))).drop("name", "source")
        position = F.expr("CAST(pmod(CAST(pmod(hash, blocks) AS DECIMAL(20,0)) * step, CAST(blocks AS DECIMAL(20,0))) AS BIGINT)")
        self.pieces = cut(pieces.withColumn("position", position).drop("blocks", "step"))
        self._fill()

    def _broadcast(self, ddl: str, *names: str) -> DataFrame:
        rows = [tuple(t[n] for n in names) for t in self.table]
        return F.broadcast(self.spark.createDataFrame(rows, ddl.replace("{kind}", self.kind)))

    def _fill(self) -> None:
        """Fills the partial turns: sets each source's rules (from, to, limit: rows of these blocks, of that size
        at most, are taken) and drawn, and the pieces' part."""
        parts = []
        for t in self.table:
            t["limit"] = 1 << 62  # the first round takes whole blocks
            t["open"] = t["room"] > 0
        while any(t["open"] for t in self.table):
            now = [(t["s"], t["room"], t["from"], t["limit"]) for t in self.table if t["open"]]
            state = F.broadcast(self.spark.createDataFrame(now, "s int, room bigint, lo bigint, most bigint"))
            own = self.pieces.join(state, "s").where((F.col("position") >= F.col("lo")) & (F.col("size") <= F.col("most")) & (F.col("size") > 0))
            own = own.withColumn("words", F.col("size") * F.col("rows")).withColumn("g", F.floor(F.col("position") / _GROUP))
            order = Window.partitionBy("s").orderBy("g").rowsBetween(Window.unboundedPreceding, 0)
            groups = own.groupBy("s", "g").agg(F.sum("words").alias("words"), F.first("room").alias("room")).withColumn("to", F.sum("words").over(order))
            # for each source the group of blocks in which the room ends, or none if all fits
            ends = groups.groupBy("s").agg(F.min(F.when(F.col("to") > F.col("room"), F.struct("g", (F.col("to") - F.col("words")).alias("before")))).alias("end"), F.max("to").alias("all")).collect()
            ends = {r["s"]: r for r in ends}
            crossing = []
            for t in self.table:
                if not t["open"]:
                    continue
                r = ends.get(t["s"])
                if r is None or r["end"] is None:  # all that is left fits
                    t["rules"].append((t["from"], t["blocks"], t["limit"]))
                    t["room"] -= r["all"] if r else 0
                    t["from"], t["open"] = t["blocks"], False
                else:
                    crossing.append((t["s"], r["end"]["g"], t["room"] - r["end"]["before"]))
            if not crossing:
                break
            at = F.broadcast(self.spark.createDataFrame(crossing, "s int, at bigint, left bigint"))
            order = Window.partitionBy("s").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
            each = F.struct((-F.col("size")).alias("less"), "hash", "k1", "k2", "piece", "rows")
            blocks = own.drop("room").join(at, "s").where(F.col("g") == F.col("at")).groupBy("s", "position").agg(F.sum("words").alias("words"), F.first("left").alias("left"), F.array_sort(F.collect_list(each)).alias("own"))
            blocks = blocks.withColumn("to", F.sum("words").over(order)).where(F.col("to") > F.col("left"))
            last = blocks.groupBy("s").agg(F.min_by(F.struct("position", "own", (F.col("left") - F.col("to") + F.col("words")).alias("room")), "position").alias("b")).select("s", "b.*")
            # of the block in which it ends: from the largest down, as many repeats of each as fit
            taken = lambda acc, d: F.least(d["rows"], F.floor(acc["room"] / -d["less"]))
            filled = F.aggregate(
                "own",
                F.struct(F.col("room").alias("room"), F.expr("CAST(array() AS ARRAY<STRUCT<k1: BIGINT, k2: BIGINT, piece: BIGINT, part: BIGINT>>)").alias("part")),
                lambda acc, d: F.struct((acc["room"] + taken(acc, d) * d["less"]).alias("room"), F.when(taken(acc, d) > 0, F.concat(acc["part"], F.array(F.struct(d["k1"].alias("k1"), d["k2"].alias("k2"), d["piece"].alias("piece"), taken(acc, d).alias("part"))))).otherwise(acc["part"]).alias("part")),
            )
            last = cut(last.select("s", "position", filled.alias("f")))
            parts.append(last.select(F.explode("f.part").alias("p")).select("p.*"))
            for r in last.select("s", "position", F.col("f.room").alias("room")).collect():
                t = self.table[r["s"]]
                t["rules"].append((t["from"], r["position"], t["limit"]))
                t["room"], t["from"], t["limit"] = r["room"], r["position"] + 1, r["room"]
                t["open"] = r["room"] > max(0, TOLERANCE * t["target"]) and t["from"] < t["blocks"]
        kind = "ARRAY<STRUCT<lo: BIGINT, hi: BIGINT, most: BIGINT>>"
        rules = self._broadcast(f"s int, rules {kind}", "s", "rules")
        part = "k1 bigint, k2 bigint, piece bigint, part bigint"
        parts = cut(self._union(parts, part))
        pieces = self.pieces.join(rules, "s").join(parts, ["k1", "k2", "piece"], "left")
        all_ = F.exists("rules", lambda r: (F.col("position") >= r["lo"]) & (F.col("position") < r["hi"]) & (F.col("size") <= r["most"]))
        self.pieces = cut(pieces.withColumn("part", F.when(all_, F.col("rows")).otherwise(F.coalesce("part", F.lit(0)))).withColumnRenamed("turns", "whole").drop("rules"))
        # a source that is short although nothing fits: one more row, if that is closer
        short = [(t["s"], t["room"]) for t in self.table if t["room"] > max(0, TOLERANCE * t["target"])]
        if short:
            left = self.pieces.join(F.broadcast(self.spark.createDataFrame(short, "s int, room bigint")), "s").where("size > 0 AND part < rows AND size < 2 * room")
            more = left.groupBy("s").agg(F.min(F.struct("size", "hash", "k1", "k2", "piece")).alias("m")).select("m.k1", "m.k2", "m.piece", F.lit(1).alias("more"))
            self.pieces = cut(self.pieces.join(more, ["k1", "k2", "piece"], "left").withColumn("part", F.col("part") + F.coalesce("more", F.lit(0))).drop("more"))
        for t in self.table:
            t["drawn"] = t["from"]

    def _union(self, parts: list[DataFrame], ddl: str) -> DataFrame:
        out = self.spark.createDataFrame([], ddl)
        for p in parts:
            out = out.unionByName(p)
        return out

    def shards(self, n: int) -> tuple[DataFrame, F.Column]:
        """(s, starts), by turn the first block of each shard and the end of the last one, for each source that is
        drawn; and the number of chunks of each shard, as an array."""
        columns = [(t["s"], turn, t["blocks"] if turn < t["turns"] else t["drawn"]) for t in self.table for turn in range(t["turns"] + 1) if turn < t["turns"] or t["drawn"]]
        if len(columns) * n > MAX_QUOTAS:
            raise ValueError(f"{len(columns)} sources and turns by {n} shards are more than {MAX_QUOTAS} quotas")
        given = split(np.array([c[2] for c in columns], np.int64), n, self.seed)
        start = np.ascontiguousarray(np.vstack([np.zeros((1, len(columns)), np.int64), np.cumsum(given, axis=0)]).T)
        chunks = np.maximum(1, -(-given.sum(axis=1) // LOCAL_BLOCKS)).tolist()
        starts = pa.ListArray.from_arrays(pa.array(np.arange(len(columns) + 1, dtype=np.int32) * (n + 1)), pa.array(start.ravel()))
        own, at = np.unique(np.array([c[0] for c in columns], np.int32), return_index=True)
        rows = pa.table([pa.array(own), pa.ListArray.from_arrays(pa.array(np.append(at, len(columns)).astype(np.int32)), starts)], names=["s", "starts"])
        shards = F.broadcast(self.spark.createDataFrame(rows))
        return shards, F.array(*[F.lit(int(c)) for c in chunks])

    def draws(self, n: int) -> tuple[DataFrame, F.Column]:
        """The pieces with draws: a (turn, rows, shard) for each turn that takes rows of them, where the tree has given
        their block to a shard; and the number of chunks of each of the `n` shards."""
        starts, chunks = self.shards(n)
        each = lambda own, t: F.struct(t.cast("int").alias("turn"), F.when(t < F.col("whole"), F.col("rows")).otherwise(F.col("part")).alias("rows"), (F.size(F.filter(own, lambda x: x <= F.col("position"))) - 1).alias("shard"))
        own = F.filter(F.transform(F.coalesce("starts", F.array().cast("array<array<bigint>>")), each), lambda d: (d["rows"] > 0) & (d["shard"] < n))
        return self.pieces.join(starts, "s", "left").withColumn("draws", own).drop("starts"), chunks


def taken_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = 16, **how) -> DataFrame:
    """For each row of `docs` its id, size, source_size, target and taken: the words that the mix takes of it, in the
    blocks that the tree deals to the shards; what no shard gets is not taken.

    Sources follow each other by code point, null last, with the given weights in turn. Blocks and their
    order depend on the rows and the seed alone, so reruns agree. Rows that repeat each other in all columns
    are taken one by one, none more than `most` times. A null or empty text has size 0. An empty table gives
    an empty one. A source whose rows are all larger than what is missing is taken as near to its target as
    one row more or less allows.
    """
    p = Plan(docs, id_col, text_col, source_col, **how)
    rows = p.draws(shards)[0].withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))))
    taken = F.col("size") * F.size(F.filter("draws", lambda d: F.col("copy") <= d["rows"])).cast("bigint")
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = 16, **how) -> DataFrame:
    """The mixed documents: the columns of `docs`, and mix_shard, mix_turn (0 for a row's first time) and
    mix_place. Partitions hold whole chunks of shards, and a shard's rows stand there in the order of
    mix_place, which is random inside of a chunk. See taken_words() for weights and the rest."""
    p = Plan(docs, id_col, text_col, source_col, **how)
    pieces, chunks = p.draws(shards)
    names = [free_name(docs.columns, x) for x in ("mix_shard", "mix_turn", "mix_place")]
    row, k1, k2, salt = (free_name([*docs.columns, *names], x) for x in ("mix_row", "mix_k1", "mix_k2", "mix_salt"))
    # one row for each text; those of many repeats once for each of the tasks that make them
    a, b = _hashed(docs)
    known = docs.select(a.alias(k1), b.alias(k2), F.struct(*(f"`{c}`" for c in docs.columns)).alias(row)).groupBy(k1, k2).agg(F.first(row).alias(row))
    on, salted = [k1, k2], F.lit(0)
    if p.heavy:
        hot = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y")).isin([F.struct(F.lit(i).cast("bigint").alias("x"), F.lit(j).cast("bigint").alias("y")) for i, j in p.heavy])
        known = known.withColumn(salt, F.explode(F.when(hot(k1, k2), F.sequence(F.lit(0), F.lit(_SALTS - 1))).otherwise(F.array(F.lit(0)))))
        on, salted = [k1, k2, salt], F.when(hot("k1", "k2"), F.pmod("piece", F.lit(_SALTS)).cast("int")).otherwise(0)
    times = F.flatten(F.transform("draws", lambda d: F.transform(F.sequence(F.lit(1), d["rows"].cast("int")), lambda i: F.struct(d["turn"].alias("turn"), d["shard"].alias("shard"), i.alias("i")))))
    drawn = pieces.withColumn("t", F.explode(times)).drop("draws").select("*", "t.turn", "t.shard")
    drawn = drawn.withColumn("chunk", F.pmod(F.xxhash64("s", "turn", "position", F.lit(p.seed + 2)), F.element_at(chunks, F.col("shard") + 1)).cast("bigint"))
    place = F.shiftleft("chunk", 32) + F.pmod(F.xxhash64("hash", "turn", "t.i"), F.lit(1 << 32))
    drawn = drawn.select(F.col("k1").alias(k1), F.col("k2").alias(k2), salted.alias(salt), F.col("shard").alias(names[0]), F.col("turn").alias(names[1]), place.alias(names[2]))
    mixed = known.join(drawn, on).select(f"{row}.*", *names)
    return mixed.repartition(names[0], F.shiftright(names[2], 32)).sortWithinPartitions(names[0], names[2])


def write_shards(mixed: DataFrame, path: str, shard: str = "mix_shard") -> None:
    """The result of mix(): each shard as a folder of Parquet files under `path`, one from each task that
    holds chunks of it, with its rows in their order."""
    mixed.write.partitionBy(shard).parquet(path)
