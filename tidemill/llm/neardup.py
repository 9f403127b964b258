"""MinHash near-duplicate groups from DartMinHash signatures.

Every shingle is an element whose weight is the number of its occurrences; a unit of weight is a
strip on which hashed darts arrive, one after the other, at exponential distances (a Poisson process
that any text with that unit sees alike). A dart belongs to one of the signature's coordinates; the
earliest dart of each coordinate is kept. Two texts keep the same dart at a coordinate with a chance
equal to their weighted Jaccard similarity. A text throws only as many darts as it needs to fill its
coordinates, about k (ln k + 2), however long it is.

Signatures are joined by bands. Within a bucket (split into chunks of bounded size when it is large)
a maximum spanning forest over the signatures' agreement, and each member's closest partners, are
the candidates; an exact weighted Jaccard of the stored units confirms each. Components of the
confirmed links are the groups. In a second round, all pairs of a bucket that these links don't connect
are looked at, without a limit on their number: one by one in a small bucket, by an exact prefix join in others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import textops
from tidemill.llm.common import Work, chunks, cut, free_name, join_skewed
from tidemill.llm.graph import components

COORDINATES = 128
ROWS = 5
BANDS = COORDINATES // ROWS
#: Members of a bucket that are compared together; larger buckets are split.
BUCKET_CHUNK = 240
#: Members that all chunks of a split bucket share, each the first of a hashed eighth of the bucket.
ANCHORS = 8
#: Parts into which a group's texts are dealt when they learn its class.
SALTS = 16
#: Strays of a unit that meet a chunk together in the second round; more are dealt into parts.
STRAYS = 960
#: Counters by which the second round tells rare units from frequent ones.
SLOTS = 1 << 18
#: Pairs for each text of a block that are compared one by one; in a block with more, the texts are brought together.
FEW = 2
#: Closest partners that are candidates besides the forest.
PARTNERS = 6
#: How far, in over four standard deviations, agreement may be from similarity.
SLACK = 0.14


def dart_signatures(unit: np.ndarray, text: np.ndarray, n_texts: int, k: int = COORDINATES) -> np.ndarray:
    """n_texts x k ranks (as ordered uint64) of the earliest dart of each coordinate; texts without units keep the largest value."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    sig = np.full(n_texts * k, empty, np.uint64)
    weight = np.bincount(text, minlength=n_texts)
    reach = np.zeros(n_texts)
    reach[weight > 0] = k * (np.log(k) + 2) / weight[weight > 0]
    todo = np.ones(len(unit), bool)
    shift = np.uint64(64 - int(k).bit_length() + 1)
    while True:
        u, t = unit[todo], text[todo]
        arrival, r = np.zeros(len(u)), 0
        while len(u):
            x = textops.mix(u + np.uint64((0x9E3779B97F4A7C15 * (2 * r + 1)) & 0xFFFFFFFFFFFFFFFF))
            arrival = arrival - np.log((x >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54)
            hit = arrival <= reach[t]
            u, t, arrival, x = u[hit], t[hit], arrival[hit], x[hit]
            coordinate = textops.mix(x ^ np.uint64(0xA0761D6478BD642F)) >> shift
            np.minimum.at(sig, t * k + coordinate.astype(np.int64), arrival.view(np.uint64))
            r += 1
        open_ = (sig.reshape(n_texts, k) == empty).any(axis=1) & (weight > 0)
        if not open_.any():
            return sig.reshape(n_texts, k)
        reach[open_] *= 2
        todo = open_[text]


def _units(column: pa.Array) -> tuple[textops.Words, np.ndarray, np.ndarray]:
    w = textops.words(column)
    s = textops.shingles(w)
    text = s.text
    return w, textops.mix(s.hashes + textops.occurrences(text, s.hashes).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)), text


def _keys(w: textops.Words, ids: list[str]) -> list[bytes]:
    """16 bytes for each text; a text without words is known by its id."""
    raw = textops.text_keys(w).tobytes()
    return [raw[16 * i : 16 * i + 16] if n else hashlib.blake2b(str(x).encode(), digest_size=16).digest() for i, (n, x) in enumerate(zip(w.counts.tolist(), ids, strict=True))]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    q = np.array([pow(textops._Q, j, 1 << 64) for j in range(ROWS)], np.uint64)
    for b in chunks(batches, "text"):
        w, unit, text = _units(b.column("text"))
        n = b.num_rows
        sig = textops.mix(dart_signatures(unit, text, n))
        bands = textops.mix((sig[:, : BANDS * ROWS].reshape(n, BANDS, ROWS) * q).sum(axis=2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB)).view(np.int64)
        short = (sig >> np.uint64(56)).astype(np.uint8)
        order = np.lexsort((unit >> np.uint64(32), text))
        packed = (unit[order] >> np.uint64(32)).astype(np.uint32)
        ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))])
        has = w.counts > 0
        yield pa.RecordBatch.from_arrays(
            [
                b.column("id"),
                pa.array(_keys(w, b.column("id").to_pylist()), pa.binary()),
                pa.array([short[i].tobytes() if has[i] else b"" for i in range(n)], pa.binary()),
                pa.array([bands[i] if has[i] else [] for i in range(n)], pa.list_(pa.int64())),
                pa.array([packed[ends[i] : ends[i + 1]].tobytes() for i in range(n)], pa.binary()),
            ],
            names=["id", "key", "sig", "bands", "units"],
        )


def _forest(sig: np.ndarray, least: int, sure: int) -> list[tuple[int, int, int]]:
    """Candidates (i, j, agreement): a maximum spanning forest, which connects whatever is connected by pairs
    that agree as much; and, since close to the threshold agreement only estimates similarity, each
    member's closest partners among those that pairs over `sure` don't connect it to."""
    m = len(sig)
    agree = np.zeros((m, m), np.int16)
    for at in range(0, m, 64):
        agree[at : at + 64] = (sig[at : at + 64, None, :] == sig[None, :, :]).sum(axis=2)
    np.fill_diagonal(agree, -1)
    out, label = set(), np.zeros(m, np.int64)
    best, via, inside = agree[0].copy(), np.zeros(m, np.int64), np.zeros(m, bool)
    inside[0] = True
    for _ in range(m - 1):
        j = int(np.argmax(np.where(inside, -2, best)))
        out.add((min(j, int(via[j])), max(j, int(via[j]))))
        label[j] = label[via[j]] if best[j] >= sure else label.max() + 1
        inside[j] = True
        closer = agree[j] > best
        best[closer], via[closer] = agree[j][closer], j
    if label.max():
        other = np.where(label[:, None] != label[None, :], agree, -1)
        near = np.argsort(-other, axis=1, kind="stable")[:, :PARTNERS]
        out.update((min(i, j), max(i, j)) for i, row in enumerate(near.tolist()) for j in row if other[i, j] >= least)
    return [(i, j, int(agree[i, j])) for i, j in sorted(out) if agree[i, j] >= least]


def _edge_batch(rows: list[tuple[bytes, bytes, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int32())], names=["a", "b", "agree"])


def _edges(least: int, sure: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def group(keys: list[bytes], sigs: list[bytes]) -> list[tuple[bytes, bytes, int]]:
            own = dict(sorted(zip(keys, sigs, strict=True)))  # an anchor may also be a member
            keys = list(own)
            if len(keys) < 2:
                return []
            sig = np.frombuffer(b"".join(own.values()), np.uint8).reshape(len(keys), COORDINATES)
            if len(keys) == 2:
                n = int((sig[0] == sig[1]).sum())
                return [(*sorted(keys), n)] if n >= least else []
            return [(*sorted((keys[i], keys[j])), n) for i, j, n in _forest(sig, least, sure)]

        last, keys, sigs = None, [], []
        for b in batches:
            out = []
            for g, c, k, s in zip(*(b.column(x).to_pylist() for x in ("bucket", "chunk", "key", "sig")), strict=True):
                if (g, c) != last:
                    out += group(keys, sigs)
                    last, keys, sigs = (g, c), [], []
                keys.append(k)
                sigs.append(s)
            if out:
                yield _edge_batch(out)
        if out := group(keys, sigs):
            yield _edge_batch(out)

    return run


def _groups(rows: list[tuple], at: int) -> np.ndarray:
    return np.unique([r[at] for r in rows], return_inverse=True)[1]


def _runs(batches: Iterator[pa.RecordBatch], by: tuple[str, ...], fields: tuple[str, ...]) -> Iterator[list[tuple]]:
    """The rows (`fields`) of each run of equal values of `by`, in their own order."""
    last, rows = None, []
    for b in batches:
        for at, row in zip(zip(*(b.column(x).to_pylist() for x in by), strict=True), zip(*(b.column(x).to_pylist() for x in fields), strict=True), strict=True):
            if at != last:
                if rows:
                    yield sorted(rows)
                last, rows = at, []
            rows.append(row)
    if rows:
        yield sorted(rows)


#: A text in a block: its size and whether the block's unit is among its first ones, whether it is a stray, of the block's part, of its chunk.
ROLES = ("words", "first", "stray", "asks", "asked")
BLOCK = ("unit", "part", "chunk")


def _partners(rows: list[tuple], root: np.ndarray, least: int, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """Each stray i of a block's part and all j of its chunk that are of other groups, of a size that can be similar
    enough, with the unit among the first ones of the smaller, and that agree as much; two strays meet in one of their
    two blocks. Groups that are joined in `root` meanwhile count as one."""
    sig = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(len(rows), COORDINATES)
    size, first, stray, asks, asked = (np.array([r[k] for r in rows]) for k in range(3, 8))
    at = np.arange(len(rows))
    for i in np.flatnonzero(asks).tolist():
        ok = asked & (root != root[i]) & (~stray | (at > i)) & (np.minimum(size, size[i]) >= threshold * np.maximum(size, size[i]))
        other = np.flatnonzero(ok & ((first & (size <= size[i])) | (first[i] & (size[i] <= size))))
        other = other[(sig[other] == sig[i]).sum(axis=1) >= least]
        if len(other):
            yield i, other


def _candidates(least: int, threshold: float):
    """Pairs (a, b) of a block, if there are few for its texts; else the texts (b is null) that have partners, whose
    units are then compared in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, BLOCK, ("key", "sig", "root", *ROLES, *BLOCK)):
            found = list(_partners(rows, _groups(rows, 2), least, threshold))
            if not found:
                continue
            if sum(len(other) for _, other in found) <= FEW * len(rows):
                out = [(min(rows[i][0], rows[j][0]), max(rows[i][0], rows[j][0]), None, *rows[i][3:]) for i, other in found for j in other.tolist()]
            else:
                out = [(rows[i][0], None, *rows[i][2:]) for i in sorted({i for i, _ in found}.union(*(other.tolist() for _, other in found)))]
            kinds = [*[pa.binary()] * 3, pa.int32(), *[pa.bool_()] * 4, pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=["a", "b", "root", *ROLES, *BLOCK])

    return run


def _exact(least: int, threshold: float):
    """Links (a, b) between groups of a block: every pair of partners is compared by its units, unless links connect it already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, BLOCK, ("key", "sig", "root", *ROLES, "units")):
            root = _groups(rows, 2)
            units = [np.frombuffer(r[-1], np.uint32) for r in rows]
            size = np.array([len(u) for u in units])
            known, place = np.unique(np.concatenate(units), return_inverse=True)
            place = np.split(place.astype(np.int32), np.cumsum(size)[:-1])
            mark, out = np.zeros(len(known), np.uint8), []
            for i, other in _partners(rows, root, least, threshold):
                mark[place[i]] = 1
                for at in range(0, len(other), 256):
                    js = other[at : at + 256]
                    both = np.add.reduceat(mark[np.concatenate([place[j] for j in js])], np.cumsum(size[js]) - size[js], dtype=np.int64)
                    for j in js[both >= threshold * (size[i] + size[js] - both)].tolist():
                        if root[j] != root[i]:
                            out.append((rows[i][0], rows[j][0]))
                            root[root == root[j]] = root[i]
                mark[place[i]] = 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return run


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often units fall into each of the SLOTS."""
    total = np.zeros(SLOTS, np.int64)
    for b in batches:
        for u in b.column("units").to_pylist():
            total += np.bincount(np.frombuffer(u, np.uint32) // np.uint32((1 << 32) // SLOTS), minlength=SLOTS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["slot", "n"])


def _postings(often, threshold: float):
    """(unit, key, root, words, first) for the rarest units of each text, as many as a text of the same size or a
    smaller one must share one of; `first`: those of which a text of the same size or a larger one must share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = often.value
        for b in chunks(batches, "units"):
            units = [np.frombuffer(u, np.uint32) for u in b.column("units").to_pylist()]
            size = np.array([len(u) for u in units])
            unit, text = np.concatenate(units), np.repeat(np.arange(len(units)), size)
            unit = unit[np.lexsort((unit, slots[unit // np.uint32((1 << 32) // SLOTS)], text))]
            rank = np.arange(len(unit)) - np.repeat(np.cumsum(size) - size, size)
            least = lambda share: (size - np.ceil(share * size - 1e-9).astype(np.int64) + 1)[text]  # noqa: B023, E731
            own = rank < least(threshold)
            first = (rank < least(2 * threshold / (1 + threshold)))[own]
            text = text[own]
            yield pa.RecordBatch.from_arrays([pa.array(unit[own].astype(np.int64)), b.column("key").take(pa.array(text)), b.column("root").take(pa.array(text)), pa.array(size[text].astype(np.int32)), pa.array(first)], names=["unit", "key", "root", "words", "first"])

    return run


def _confirm(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "ua"):
            keep = []
            for x, y in zip(b.column("ua").to_pylist(), b.column("ub").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= threshold * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _only_keys(batches: Iterator[pa.RecordBatch], name: str, id_col: str, text_col: str) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches, text_col):
        keys = _keys(textops.words(b.column(text_col)), b.column(id_col).to_pylist())
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.binary())], names=[*b.schema.names, name])


def with_key(docs: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of `docs` and the key of the text's words in `name`."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    schema = StructType([*docs.schema.fields, StructField(name, BinaryType())])
    return docs.mapInArrow(lambda it: _only_keys(it, name, id_col, text_col), schema)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row for each different word sequence: key, rows (that have it), class_id (smallest id of its group),
    class_rows (rows of the group) and first_key (whether it is the text that stands for the group)."""
    spark = docs.sparkSession
    work = Work(spark)
    try:
        sketches = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_sketch, f"id {docs.schema[id_col].dataType.simpleString()}, key binary, sig binary, bands array<bigint>, units binary")
        texts = work.store(sketches.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.first("units").alias("units")), "texts")
        bands = texts.select(F.explode("bands").alias("bucket"), "key", "id")
        shared = work.store(bands.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "shared")
        members = join_skewed(bands, shared, "bucket", "size")
        members = work.store(members.withColumn("pieces", F.ceil(F.col("size") / BUCKET_CHUNK).cast("int")).drop("size"), "members")
        work.forget("shared")
        anchor = [F.min(F.when(F.pmod(F.xxhash64("key"), F.lit(ANCHORS)) == i, F.struct("id", "key"))) for i in range(ANCHORS)]
        anchors = members.where("pieces > 1").groupBy("bucket").agg(F.first("pieces").alias("pieces"), F.array(*anchor).alias("at"))
        anchors = anchors.select("bucket", "pieces", F.explode("at").alias("at")).where("at IS NOT NULL").select("bucket", "at.key", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("chunk"))
        chunked = members.select("bucket", "key", F.pmod(F.xxhash64("key", "bucket"), F.col("pieces")).cast("int").alias("chunk")).unionByName(anchors)
        chunked = chunked.join(texts.select("key", "sig"), "key")
        least, sure = int(np.floor(COORDINATES * (threshold - SLACK))), int(np.ceil(COORDINATES * min(1, threshold + SLACK)))
        found = chunked.repartition("bucket", "chunk").sortWithinPartitions("bucket", "chunk").mapInArrow(_edges(least, sure), "a binary, b binary, agree int")
        found = work.store(found.groupBy("a", "b").agg(F.max("agree").alias("agree")), "found")
        wanted = found.select(F.col("a").alias("key")).unionByName(found.select(F.col("b").alias("key"))).unionByName(members.where("pieces > 1").select("key")).distinct()
        units = work.store(texts.select("key", "sig", "units").join(wanted, "key", "left_semi"), "units")
        roots = components(_links(found, units, threshold))
        work.forget("found")
        roots = _second_round(work, members, units, roots, least, threshold)
        slim = texts.select("key", "id", "n").join(roots.withColumnRenamed("node", "key"), "key", "left")
        alone = slim.where("root IS NULL").select("key", F.col("n").alias("rows"), F.col("id").alias("class_id"), F.col("n").alias("class_rows"), F.lit(True).alias("first_key"))
        # a group may hold a large part of all texts: its row is dealt out with a salt
        linked = slim.where("root IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
        groups = linked.groupBy("root").agg(F.min("id").alias("class_id"), F.sum("n").alias("class_rows"), F.min(F.struct(F.col("id").isNull().alias("no"), "id", "key")).alias("first"))
        groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        linked = linked.join(groups, ["root", "salt"]).select("key", F.col("n").alias("rows"), "class_id", "class_rows", (F.col("first.key") == F.col("key")).alias("first_key"))
        return cut(alone.unionByName(linked))
    finally:
        work.drop()


def _links(found: DataFrame, units: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of `found` whose units are similar enough."""
    pairs = found.join(units.select(F.col("key").alias("a"), F.col("units").alias("ua")), "a").join(units.select(F.col("key").alias("b"), F.col("units").alias("ub")), "b")
    return pairs.select("a", "b", "ua", "ub").mapInArrow(_confirm(threshold), "a binary, b binary")


def _second_round(work: Work, members: DataFrame, units: DataFrame, roots: DataFrame, least: int, threshold: float) -> DataFrame:
    """`roots` after a look at all pairs of a bucket that are still in different groups, so that no link is lost.

    In a bucket of one chunk they are compared one by one. The members of larger buckets are joined by prefixes: of two
    similar texts, the smaller one's rarest units (a ninth, for 0.8) and the larger one's (a fifth) must have one
    in common, whatever order of units is taken for that of rareness. What many texts share is not rare, so a
    page template of any number of texts costs each text a list of its own units only.
    """
    rooted = work.store(members.join(roots.withColumnRenamed("node", "key"), "key", "left").select("bucket", "key", "pieces", F.coalesce("root", "key").alias("root")), "rooted")
    work.forget("members")
    several = work.store(rooted.groupBy("bucket").agg(F.count("*").alias("n"), (F.min("root") != F.max("root")).alias("open")), "several")
    rooted = work.store(join_skewed(rooted, several, "bucket", "n", only="open").select("bucket", "key", "root", "pieces"), "open")
    work.forget("rooted", "several")
    always = {"words": F.lit(0), "first": F.lit(True), "stray": F.lit(True), "asks": F.lit(True), "asked": F.lit(True), "part": F.lit(0), "chunk": F.lit(0)}
    blocks = rooted.where("pieces = 1").withColumnRenamed("bucket", "unit").withColumns(always).select("key", "root", *ROLES, *BLOCK)
    blocks = blocks.unionByName(_prefix_blocks(work, rooted.where("pieces > 1").select("key", "root").distinct(), units, threshold))
    blocks = blocks.join(units.select("key", "sig"), "key").repartition(*BLOCK).sortWithinPartitions(*BLOCK)
    found = work.store(blocks.mapInArrow(_candidates(least, threshold), "a binary, b binary, root binary, words int, first boolean, stray boolean, asks boolean, asked boolean, unit bigint, part int, chunk int"), "candidates")
    work.forget("postings", "live", "open")
    dense = found.where("b IS NULL").drop("b").withColumnRenamed("a", "key").join(units, "key").repartition(*BLOCK).sortWithinPartitions(*BLOCK)
    links = _links(found.where("b IS NOT NULL").select("a", "b").distinct(), units, threshold)
    links = work.store(links.unionByName(dense.mapInArrow(_exact(least, threshold), "a binary, b binary")).distinct(), "links")
    if links.isEmpty():
        return roots
    # groups take the place of their texts
    for end in ("a", "b"):
        links = links.join(roots.select(F.col("node").alias(end), "root"), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    joined = components(links)
    old = roots.join(joined.select(F.col("node").alias("root"), F.col("root").alias("newer")), "root", "left").select("node", F.coalesce("newer", "root").alias("root"))
    return cut(old.unionByName(joined.join(roots, "node", "left_anti").select("node", "root")))


def _prefix_blocks(work: Work, texts: DataFrame, units: DataFrame, threshold: float) -> DataFrame:
    """Blocks (unit, part, chunk) in which any two similar `texts` (key, root) of different groups meet.

    A unit's strays are the texts outside of the largest group that holds it. They are dealt into parts of STRAYS, all
    texts of the unit into chunks, and each part meets each chunk in a block.
    """
    spark = texts.sparkSession
    own = work.store(texts.join(units.select("key", "units"), "key"), "own")
    # SLOTS numbers, whatever the size of the corpus
    often = np.zeros(SLOTS, np.int64)
    for r in own.select("units").mapInArrow(_slots, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow().to_batches():
        often[r.column("slot").to_numpy()] = r.column("n").to_numpy()
    postings = work.store(own.mapInArrow(_postings(spark.sparkContext.broadcast(often), threshold), "unit bigint, key binary, root binary, words int, first boolean"), "postings")
    work.forget("own")
    groups = postings.groupBy("unit", "root").agg(F.count("*").alias("n"), F.max("first").alias("first"))
    units_ = groups.groupBy("unit").agg(F.sum("n").alias("size"), F.max_by("root", F.struct("n", "root")).alias("largest"), (F.sum("n") - F.max("n")).alias("strays"), F.max("first").alias("first"))
    units_ = work.store(units_.withColumn("live", F.col("first") & (F.col("strays") > 0)).drop("first"), "live")
    rows = join_skewed(postings, units_, "unit", "size", only="live").drop("live")
    rows = rows.withColumns({"stray": F.col("root") != F.col("largest"), "parts": F.ceil(F.col("strays") / STRAYS).cast("int"), "pieces": F.ceil(F.col("size") / BUCKET_CHUNK).cast("int")})
    rows = rows.withColumns({"own_part": F.pmod(F.xxhash64("key", F.lit("part")), "parts").cast("int"), "own_chunk": F.pmod(F.xxhash64("unit", "key"), "pieces").cast("int")})
    as_asked = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(p.alias("part"), F.col("own_chunk").alias("chunk")))
    as_stray = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda c: F.struct(F.col("own_part").alias("part"), c.alias("chunk")))
    rows = rows.withColumn("block", F.explode(F.when(F.col("stray"), F.array_union(as_asked, as_stray)).otherwise(as_asked)))
    return rows.select("key", "root", "words", "first", "stray", (F.col("stray") & (F.col("block.part") == F.col("own_part"))).alias("asks"), (F.col("block.chunk") == F.col("own_chunk")).alias("asked"), "unit", "block.part", "block.chunk")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row for each row of `docs`: its id, class_id (the smallest id of its group), class_rows (rows
    of the group) and kept (whether its id is class_id).

    Two rows are linked when their words are equal in equal order, or the weighted Jaccard similarity of
    their five-word shingles is at least `threshold`; groups are connected components. A text without
    words (or null) is a group by itself. Repeated rows share a group. An empty table gives none.
    """
    rows = with_key(docs.select(F.col(id_col).alias("own_id"), F.col(text_col).alias("text")), "key", "own_id").select("own_id", "key")
    joined = join_skewed(rows, classes(docs, id_col, text_col, threshold), "key", "rows")
    return joined.select(F.col("own_id").alias(id_col), "class_id", "class_rows", F.col("own_id").eqNullSafe(F.col("class_id")).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """The rows of `docs`, with one row of each group: that with the smallest id (null ids last; among
    rows that repeat an id and its words, that with the smallest hash of all columns)."""
    key, row, order = (free_name(docs.columns, x) for x in ("text_key", "row", "order"))
    stay = classes(docs, id_col, text_col, threshold).where("first_key").select(F.col("key").alias(key))
    rows = with_key(docs, key, id_col, text_col)
    simple = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    first = F.min_by(F.struct(*docs.columns), F.struct(F.col(id_col).isNull(), F.col(id_col), F.xxhash64(*simple)))
    return rows.groupBy(key).agg(first.alias(row)).join(stay, key, "left_semi").select(f"{row}.*")
