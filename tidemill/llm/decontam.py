"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check.

Every item of n words has a 128-bit SimHash of its weighted five-word shingles (weight: how rare the
shingle is among the items). In a text, every window of n words that holds at least one shingle of an
item of n words (any other window has similarity 0) gets the same fingerprint from prefix sums. The
fingerprints are cut into 12 blocks; two that differ in at most 35 bits differ in at most 2 bits of
some block, so looking up each block among the items' blocks with all their neighbours of up to 2 bits
finds every item within that radius. Pairs within the radius are then compared exactly: the weighted
Jaccard similarity of the multisets of shingles must reach the threshold.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tidemill.llm import textops
from tidemill.llm.common import chunks, cut, free_name

RADIUS = 35
_WIDTHS = (11,) * 8 + (10,) * 4
_NEAR = RADIUS // len(_WIDTHS)
#: Items, and bytes of their texts, that are searched for together. If there are more, one pass over the documents finds
#: those with a shingle of any item, and only these are searched for one block after the other.
ITEM_BLOCK = 8192
BLOCK_BYTES = 4 << 20
_GATE_BITS = 22
#: Of the gate for all items, 8 MB.
_WIDE_GATE_BITS = 26


def _bits(shingle: np.ndarray) -> np.ndarray:
    """n x 128 signs (+1, -1) of the shingles' hashes."""
    both = np.stack([textops.mix(shingle + np.uint64(0x8CB92BA72F3D8DD7)), textops.mix(shingle ^ np.uint64(0x5851F42D4C957F2D))], axis=1)
    return (np.unpackbits(both.view(np.uint8).reshape(len(shingle), 16), axis=1).astype(np.int8) << 1) - 1


def _blocks(fingerprint: np.ndarray) -> list[np.ndarray]:
    """The 12 blocks of n x 128 bits as integers."""
    out, at = [], 0
    for width in _WIDTHS:
        out.append(fingerprint[:, at : at + width].astype(np.int64) @ (1 << np.arange(width)))
        at += width
    return out


class Items:
    """The items of one pass: their shingles, weights, fingerprints and block tables by item size."""

    def __init__(self, ids: list, texts: list[str], weights: dict[int, int], default: int):
        self.default = default
        w = textops.words(pa.array(texts, pa.large_string()))
        s = textops.shingles(w)
        self.ids, self.n_words = ids, w.counts
        self.bags = [Counter(s.hashes[s.first[i] : s.first[i + 1]].tolist()) for i in range(len(ids))]
        self.known = np.array(sorted(weights), np.uint64)
        self.weight = np.array([weights[x] for x in self.known.tolist()], np.int32)
        self.gate = np.zeros(1 << _GATE_BITS, bool)
        self.sizes = defaultdict(list)  # words: items
        for i, n in enumerate(self.n_words.tolist()):
            if n:
                self.sizes[n].append(i)
        own = np.unique(s.hashes)
        self.gate[(own >> np.uint64(64 - _GATE_BITS)).astype(np.int64)] = True
        # sizes of the items in which a shingle stands, as (shingle, size) in order
        pairs = sorted({(int(h), int(self.n_words[t])) for h, t in zip(s.hashes.tolist(), s.text.tolist(), strict=True)})
        self.pair_shingle, self.pair_size = np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs], np.int64)
        self.prints = np.zeros((len(ids), 128), bool)
        for i, bag in enumerate(self.bags):
            if bag:
                h = np.array(list(bag), np.uint64)
                self.prints[i] = (_bits(h).astype(np.int64) * (self.weights(h) * np.array(list(bag.values())))[:, None]).sum(axis=0) > 0
        self.tables = {n: self._table(np.array(own)) for n, own in self.sizes.items()}

    def weights(self, shingle: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(shingle), self.default, np.int64)
        at = np.minimum(np.searchsorted(self.known, shingle), len(self.known) - 1)
        return np.where(self.known[at] == shingle, self.weight[at], self.default).astype(np.int64)

    def _table(self, items: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each block the values within 2 bits of an item's, in order, and the items."""
        out = []
        for width, own in zip(_WIDTHS, _blocks(self.prints[items]), strict=True):
            flips = np.array([sum(1 << b for b in c) for r in range(_NEAR + 1) for c in combinations(range(width), r)])
            value, item = (own[:, None] ^ flips).ravel(), np.repeat(items, len(flips))
            order = np.argsort(value, kind="stable")
            out.append((value[order].astype(np.uint16), item[order].astype(np.int32)))
        return out

    def near(self, prints: np.ndarray, size: int) -> np.ndarray:
        """All pairs (window, item) of fingerprints within RADIUS, as m x 2."""
        found = []
        n_items = len(self.ids)
        for (value, item), block in zip(self.tables[size], _blocks(prints), strict=True):
            block = block.astype(np.uint16)
            lo, hi = np.searchsorted(value, block), np.searchsorted(value, block, side="right")
            n = hi - lo
            window = np.repeat(np.arange(len(prints)), n)
            at = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            found.append(window * n_items + item[at])
        pair = np.unique(np.concatenate(found))
        window, item = pair // n_items, pair % n_items
        close = np.zeros(len(pair), bool)
        for at in range(0, len(pair), 1 << 14):
            part = slice(at, at + (1 << 14))
            close[part] = (prints[window[part]] != self.prints[item[part]]).sum(axis=1) <= RADIUS
        return np.stack([window[close], item[close]], axis=1)

    def similarity(self, window: np.ndarray, item: int) -> float:
        bag, own = Counter(window.tolist()), self.bags[item]
        shingle = list(bag.keys() | own.keys())
        w = self.weights(np.array(shingle, np.uint64)).tolist()
        low = sum(x * min(bag[g], own[g]) for g, x in zip(shingle, w, strict=True))
        return low / sum(x * max(bag[g], own[g]) for g, x in zip(shingle, w, strict=True))


def _windows(items: Items, s: textops.Shingles, n_words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(size, texts, first shingle of each window, shingles in a window): windows with a shingle of an item of that size."""
    maybe = np.flatnonzero(items.gate[(s.hashes >> np.uint64(64 - _GATE_BITS)).astype(np.int64)])
    lo, hi = (np.searchsorted(items.pair_shingle, s.hashes[maybe], side=x) for x in ("left", "right"))
    n = hi - lo
    hit = np.repeat(maybe, n)
    if not len(hit):
        return
    size = items.pair_size[np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
    text = np.searchsorted(s.first, hit, side="right") - 1
    for words in np.unique(size).tolist():
        m = max(1, words - textops.SHINGLE + 1)
        own, t = hit[size == words], text[size == words]
        if words < textops.SHINGLE:  # the shingle is a whole text of so few words
            yield words, t, own, 1
            continue
        first, last = np.maximum(own - m + 1, s.first[t]), np.minimum(own, s.first[t + 1] - m)
        # a text that is shorter than the item is one window
        short = s.first[t + 1] - s.first[t] < m
        first, last = np.where(short, s.first[t], first), np.where(short, s.first[t], last)
        count = np.maximum(0, last - first + 1)
        start = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = np.unique(start)
        yield words, np.searchsorted(s.first, start, side="right") - 1, start, m


def _search(items: Items, column: pa.Array, threshold: float) -> list[tuple[int, int, float, int]]:
    """(text, item, similarity, word of the text at which the window starts): the best window of each pair."""
    w = textops.words(column)
    s = textops.shingles(w)
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for size, text, start, m in _windows(items, s, w.counts):
        for at in range(0, len(start), 4096):  # windows of bounded number together
            part, t = start[at : at + 4096], text[at : at + 4096]
            length = np.minimum(m, s.first[t + 1] - part)
            # shingles of all these windows, each once, in order; runs of neighbours share prefix sums
            cover = np.zeros(int(part[-1] + length[-1] - part[0]) + 1, np.int32)
            np.add.at(cover, part - part[0], 1)
            np.add.at(cover, part + length - part[0], -1)
            used = np.flatnonzero(np.cumsum(cover)[:-1] > 0) + part[0]
            h = s.hashes[used]
            sums = np.zeros((len(used) + 1, 128), np.int32)
            np.cumsum(_bits(h) * items.weights(h)[:, None].astype(np.int32), axis=0, out=sums[1:])
            lo = np.searchsorted(used, part)
            prints = sums[lo + length] - sums[lo] > 0
            for i, item in items.near(prints, size).tolist():
                sim = items.similarity(s.hashes[part[i] : part[i] + length[i]], item)
                pair, word = (int(t[i]), item), int(s.word[part[i]] - w.first[t[i]])
                if sim >= threshold and (pair not in best or sim > best[pair][0]):
                    best[pair] = (sim, word)
    return [(t, i, sim, word) for (t, i), (sim, word) in best.items()]


#: The items of the last blocks that this worker has seen, by the block's name.
_known: dict[str, Items] = {}
_KNOWN = 2


def _items_of(block: Broadcast) -> Items:
    """The tables of a block, built once in a worker."""
    name, *parts = block.value
    if name not in _known:
        while len(_known) >= _KNOWN:
            del _known[next(iter(_known))]
        _known[name] = Items(*parts)
    return _known[name]


def _matcher(block: Broadcast, threshold: float, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _items_of(block)
        for b in chunks(batches, "text"):
            if found := _search(items, b.column("text"), threshold):
                rows = b.column("id").take(pa.array([f[0] for f in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([rows.cast(schema.field(0).type), pa.array([items.ids[f[1]] for f in found], schema.field(1).type), pa.array([f[2] for f in found]), pa.array([f[3] for f in found], pa.int64()), pa.array([int(items.n_words[f[1]]) for f in found], pa.int64())], schema=schema)

    return run


def _cleaner(block: Broadcast, threshold: float, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _items_of(block)
        for b in chunks(batches, text_col):
            dirty = {f[0] for f in _search(items, b.column(text_col), threshold)}
            yield b.filter(pa.array([i not in dirty for i in range(b.num_rows)], pa.bool_())) if dirty else b

    return run


def _gate(items: DataFrame) -> Broadcast:
    """A bit for each value of the first _WIDE_GATE_BITS bits of the items' shingles, however many items there are."""
    slot = F.shiftrightunsigned("shingle", 64 - _WIDE_GATE_BITS)
    words = items.select("text").mapInArrow(_item_shingles, "shingle bigint").select((slot / 64).cast("bigint").alias("word"), F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(shingle, {64 - _WIDE_GATE_BITS}) % 64 AS INT))").alias("bit"))
    words = words.groupBy("word").agg(F.expr("bit_or(bit)").alias("bits")).toArrow()
    out = np.zeros((1 << _WIDE_GATE_BITS) // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return items.sparkSession.sparkContext.broadcast(out)


def _holds_item_words(gate: Broadcast, text_col: str, name: str):
    """All columns and, called `name`, whether a shingle of the text may be one of an item's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = gate.value.view(np.uint64)
        for b in chunks(batches, text_col):
            s = textops.shingles(textops.words(b.column(text_col)))
            slot = s.hashes >> np.uint64(64 - _WIDE_GATE_BITS)
            hit = (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)
            holds = np.zeros(b.num_rows, bool)
            holds[s.text[hit == 1]] = True
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(holds)], names=[*b.schema.names, name])

    return run


def _flagged(docs: DataFrame, items: DataFrame, text_col: str) -> tuple[DataFrame, str]:
    name = free_name(docs.columns, "holds")
    schema = StructType([*docs.schema.fields, StructField(name, BooleanType())])
    return docs.mapInArrow(_holds_item_words(_gate(items), text_col, name), schema), name


def _item_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different shingles of each item."""
    for b in chunks(batches, "text"):
        s = textops.shingles(textops.words(b.column("text")))
        yield pa.RecordBatch.from_arrays([pa.array(s.hashes[textops.occurrences(s.text, s.hashes) == 0].view(np.int64))], names=["shingle"])


def _with_text(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")


def _item_blocks(items: DataFrame) -> list[Callable[[], Broadcast | None]]:
    """Blocks of items, of about ITEM_BLOCK items and BLOCK_BYTES bytes at most, with the weights of their
    shingles: 16 times ln(1 + items / items that hold it), counted over all items. Each is made when it is called for."""
    n, size = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    pieces = max(-(-n // ITEM_BLOCK), -(-(size or 0) // BLOCK_BYTES))
    holders = items.select("text").mapInArrow(_item_shingles, "shingle bigint").groupBy("shingle").agg(F.count("*").alias("n"))
    if pieces > 1:
        holders = cut(holders)

    def block(i: int) -> Broadcast | None:
        own = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(pieces)) == i)
        rows = own.collect()
        if not rows:
            return None
        mine = own.select("text").mapInArrow(_item_shingles, "shingle bigint").distinct()
        counts = holders.join(mine, "shingle", "left_semi").toArrow()
        weights = np.maximum(1, np.round(16 * np.log1p(n / counts["n"].to_numpy()))).astype(int).tolist()
        known = dict(zip(counts["shingle"].to_numpy().view(np.uint64).tolist(), weights, strict=True))
        return items.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [r["id"] for r in rows], [r["text"] for r in rows], known, max(1, round(16 * float(np.log1p(n))))))

    return [lambda i=i: block(i) for i in range(pieces)]


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and item with a window of similarity `threshold` or more: the
    document's id, item_id, similarity (of the best window; the first if several), word (its place,
    from 0) and words (its length).

    A document shorter than an item is one window. An item or text of one to four words is one shingle;
    such an item matches only a text of just those words. Null or wordless texts and items match
    nothing. Rows of one id that match the same item give one row. Empty tables give none.
    """
    docs, benchmark = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("id", to_arrow_type(docs.schema["id"].dataType)), ("item_id", to_arrow_type(benchmark.schema["item_id"].dataType)), ("similarity", pa.float64()), ("word", pa.int64()), ("words", pa.int64())])
    ddl = f"id {docs.schema['id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, similarity double, word bigint, words bigint"
    items = _with_text(benchmark, "item_id", "text")
    blocks = _item_blocks(items)
    if len(blocks) > 1:
        docs, holds = _flagged(docs, items, "text")
        docs = cut(docs.where(holds).drop(holds))
    parts = [docs.mapInArrow(_matcher(block, threshold, schema), ddl) for make in blocks if (block := make())]
    found = reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], ddl)
    best = F.max(F.struct("similarity", (-F.col("word")).alias("word"), "words")).alias("best")
    return found.groupBy("id", "item_id").agg(best).select(F.col("id").alias(id_col), "item_id", "best.similarity", (-F.col("best.word")).alias("word"), "best.words")


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose text has no window similar to an item. Decided for each row by its own
    text, so repeated ids and null ids are no matter; null texts stay."""
    items = _with_text(benchmark, "item_id", "text")
    blocks = _item_blocks(items)
    if len(blocks) <= 1:
        block = blocks[0]() if blocks else None
        return docs.mapInArrow(_cleaner(block, threshold, text_col), docs.schema) if block else docs
    rows, holds = _flagged(docs, items, text_col)
    suspects = cut(rows.where(holds))
    for make in blocks:
        if block := make():
            suspects = cut(suspects.mapInArrow(_cleaner(block, threshold, text_col), suspects.schema))
    return rows.where(~F.col(holds)).unionByName(suspects).drop(holds)
