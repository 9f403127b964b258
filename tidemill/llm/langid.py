"""Language identification by prediction by partial matching.

For each language, a byte context tree of order 3 is counted on a bounded sample of labelled texts and
then frozen. A byte's probability in a context that has seen it is count / (total + distinct); the
escape probability, distinct / (total + distinct), leads to the next shorter context without the bytes that the
longer one has seen, and below order 0 all 256 bytes are equally likely. A context is a node of a language's tree only
if it was seen often enough (NODE_MIN), so the order varies. The code length of a text is the sum of its bytes' code
lengths; the language with the shortest one is predicted.

To score fast, all trees are laid over each other: a node has a row of code lengths, one for each language, for every
byte that any language has seen there, and a row of what an escape costs. A byte without a row in the
deepest node goes on in the node's parent. Bytes that no sample holds have equal chances everywhere and share a symbol.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidemill.llm import textops
from tidemill.llm.common import chunks, free_name

ORDER = 3
BYTES = 256
NODE_MIN = 16
#: The sample: so many labelled texts of each language are expected (all, if there are fewer), and of
#: those only texts of up to so many bytes.
SAMPLE_TEXTS = 1200
SAMPLE_BYTES = 1 << 15
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    symbol: np.ndarray  # byte -> symbol; the last symbol is that of bytes never seen
    symbols: int
    below: list[np.ndarray]  # by order: (node, symbol before) -> node one order deeper, or -1, flat
    place: np.ndarray  # (node, symbol) -> row of bits, or -1, flat
    parent: np.ndarray
    escape: np.ndarray  # (node, language) -> code length of the step to the parent
    bits: np.ndarray  # (row, language) -> code length


def _symbols(column: pa.Array, symbol: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(symbols, the symbols 1, 2 ... ORDER places before each, offsets); before a text stand spaces."""
    b, offsets = textops.raw_bytes(pc.utf8_lower(column))
    s = symbol[b].astype(np.int32)
    space = int(symbol[32])
    length, before = np.diff(offsets), []
    for j in range(1, ORDER + 1):
        own = np.full(len(s), space, np.int32)
        own[j:] = s[:-j] if len(s) > j else s[:0]
        for i in range(j):  # the first bytes of each text
            own[offsets[:-1][length > i] + i] = space
        before.append(own)
    return s, before, offsets


def train(texts: dict[str, list[str]]) -> Model:
    """A model of the languages' sample texts; languages in the order of their names."""
    languages = sorted(texts)
    columns = [pa.array(texts[x], pa.large_string()) for x in languages]
    seen = np.zeros(BYTES, bool)
    seen[32] = True
    for c in columns:
        seen[np.unique(textops.raw_bytes(pc.utf8_lower(c))[0])] = True
    n_seen = int(seen.sum())
    symbol = np.full(BYTES, n_seen, np.int16)
    symbol[seen] = np.arange(n_seen)
    size = n_seen + 1
    # for each order and language: the (context, symbol) seen, in order, their counts
    counts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER + 1)]
    for c in columns:
        s, before, _ = _symbols(c, symbol)
        code, power = np.zeros(len(s), np.int64), 1
        for k in range(ORDER + 1):  # the nearest symbol is the lowest digit
            if k:
                code, power = code + before[k - 1].astype(np.int64) * power, power * size
            counts[k].append(np.unique(code * size + s, return_counts=True))
    n = len(languages)
    # order 0: all symbols have a row
    p = np.zeros((size, n))
    for i, (pair, count) in enumerate(counts[0]):
        distinct = len(pair)
        escape = distinct if distinct < BYTES else 0
        p[:, i] = escape / (count.sum() + escape) / (BYTES - distinct) if distinct and escape else 1 / BYTES
        p[pair, i] = count / (count.sum() + escape) if distinct else 1 / BYTES
    contexts, rows, chances, escapes, parents = [np.zeros(1, np.int64)], [np.arange(size)], [p], [np.zeros((1, n))], [np.zeros(1, np.int64)]
    below, first = [], [0]
    for k in range(1, ORDER + 1):
        nodes = [np.zeros(0, np.int64)]
        for pair, count in counts[k]:
            own, at = np.unique(pair // size, return_inverse=True)
            nodes.append(own[np.bincount(at, count, len(own)) >= NODE_MIN])
        nodes = np.unique(np.concatenate(nodes))
        up = np.searchsorted(contexts[-1], nodes % size ** (k - 1)) if len(nodes) else np.zeros(0, np.int64)
        pairs = [pair[np.isin(pair // size, nodes)] for pair, _ in counts[k]]
        row = np.unique(np.concatenate(pairs)) if len(nodes) else np.zeros(0, np.int64)
        node_of = np.searchsorted(nodes, row // size)
        # what the parent says of the same symbol: it has a row, for it has seen all that its extensions have
        lower = chances[-1][np.searchsorted(rows[-1], contexts[-1][up[node_of]] * size + row % size)] if len(row) else np.zeros((0, n))
        chance, step = np.zeros((len(row), n)), np.ones((len(nodes), n))
        for i, (pair, count) in enumerate(counts[k]):
            at = np.minimum(np.searchsorted(pair, row), max(0, len(pair) - 1))
            here = np.where(pair[at] == row, count[at], 0) if len(pair) else np.zeros(len(row))
            total = np.bincount(node_of, here, len(nodes))
            distinct = np.bincount(node_of, here > 0, len(nodes))
            rest = 1 - np.bincount(node_of, np.where(here > 0, lower[:, i], 0), len(nodes))
            escape = np.where(rest > 1e-9, distinct, 0)
            use = total >= NODE_MIN
            factor = np.where(rest > 1e-9, escape / np.maximum(total + escape, 1) / np.maximum(rest, 1e-9), 1e-12)
            step[:, i] = np.where(use, factor, 1)
            own = np.where(here > 0, here / np.maximum(total + escape, 1)[node_of], factor[node_of] * lower[:, i])
            chance[:, i] = np.where(use[node_of], own, lower[:, i])
        deeper = np.full(len(contexts[-1]) * size, -1, np.int32)
        deeper[up * size + nodes // size ** (k - 1)] = np.arange(len(nodes))
        below.append(deeper)
        parents.append(up + first[-1])
        first.append(first[-1] + len(contexts[-1]))
        contexts.append(nodes)
        rows.append(row)
        chances.append(chance)
        escapes.append(step)
    place, at = [], 0
    for nodes, row in zip(contexts, rows, strict=True):
        own = np.full(len(nodes) * size, -1, np.int32)
        own[np.searchsorted(nodes, row // size) * size + row % size] = np.arange(at, at + len(row))
        place.append(own)
        at += len(row)
    # nodes of all orders in one list
    below = [np.where(d >= 0, d + first[k + 1], -1).astype(np.int32) for k, d in enumerate(below)]
    log = lambda x: -np.log2(np.maximum(x, 1e-12)).astype(np.float32)
    return Model(languages, symbol, size, below, np.concatenate(place), np.concatenate(parents).astype(np.int32), log(np.concatenate(escapes)), log(np.concatenate(chances)))


def code_lengths(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(byte x language, offsets of the texts): the code length of each byte."""
    s, before, offsets = _symbols(column, model.symbol)
    node, start = np.zeros(len(s), np.int32), 0
    for k in range(ORDER):  # down to the deepest node; `start` is the first node of the order
        table = model.below[k]
        open_ = np.flatnonzero(node >= start)
        step = table[(node[open_] - start).astype(np.int64) * model.symbols + before[k][open_]] if len(table) else np.full(len(open_), -1)
        node[open_[step >= 0]] = step[step >= 0]
        start += len(table) // model.symbols
    row = model.place[node.astype(np.int64) * model.symbols + s]
    out = model.bits[np.maximum(row, 0)].astype(np.float64)
    left = np.flatnonzero(row < 0)
    if len(left):
        out[left] = 0
        at, node = left, node[left]
        while len(at):
            out[at] += model.escape[node]
            node = model.parent[node]
            row = model.place[node.astype(np.int64) * model.symbols + s[at]]
            done = row >= 0
            out[at[done]] += model.bits[row[done]]
            at, node = at[~done], node[~done]
    return out, offsets


def score(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """The predicted language of each text and the share of its code's weight, 2**-bits, among all languages'."""
    bits, offsets = code_lengths(model, column)
    n = len(offsets) - 1
    length = np.diff(offsets)
    total = np.zeros((n, len(model.languages)))
    has = np.flatnonzero(length > 0)
    if len(has):
        total[has] = np.add.reduceat(bits, offsets[:-1][has], axis=0)
    least = total.min(axis=1, keepdims=True)
    share = np.exp2(-np.minimum(total - least, 1000))
    best = share.argmax(axis=1)
    value = share[np.arange(n), best] / share.sum(axis=1)
    letter = np.zeros(n, bool)
    if len(has):
        b, raw = textops.raw_bytes(column)
        ascii_letter = ((b | 32) >= 97) & ((b | 32) <= 122)
        own = np.flatnonzero(np.diff(raw) > 0)
        letter[own] = np.add.reduceat(ascii_letter, raw[:-1][own], dtype=np.int64) > 0
        for i in np.flatnonzero(~letter & (length > 0)).tolist():
            letter[i] = any(ch.isalpha() for ch in column[i].as_py())
    return [model.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), letter.tolist(), strict=True)], np.where(letter, value, 0.0)


def sample(labelled: DataFrame, text_col: str, label_col: str, id_col: str, texts: int = SAMPLE_TEXTS, most_bytes: int = SAMPLE_BYTES) -> dict[str, list[str]]:
    """About `texts` texts of each label, the same in each run: a label's rows are taken by a hash of their id."""
    rows = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    counts = rows.groupBy(label_col).agg(F.count("*").alias("n")).collect()
    share = F.coalesce(*[F.when(F.col(label_col) == r[0], F.lit(min(1.0, texts / r["n"]))) for r in counts]) if counts else F.lit(0.0)
    chance = F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.where((chance < share) & (F.octet_length(text_col) <= most_bytes)).select(label_col, text_col).collect()
    out: dict[str, list[str]] = {r[0]: [] for r in counts}
    for label, text in picked:
        out[label].append(text)
    return {k: sorted(v) for k, v in out.items() if v}


def _predict(model, text_col: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in chunks(batches, text_col):
            if m is None:
                lang, value = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows)
            else:
                lang, value = score(m, b.column(text_col))
            keep = [(c, b.column(i)) for i, c in enumerate(b.schema.names) if c != text_col]
            yield pa.RecordBatch.from_arrays([*(x for _, x in keep), pa.array(lang, pa.string()), pa.array(value)], names=[*(c for c, _ in keep), *names])

    return run


def identify(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """The columns of `docs` besides the text, lang_pred and score, for each row.

    The trees are learnt from a bounded sample of `labelled` (columns id, text, label). A text that is
    null, empty or without a letter is `und` with score 0, and so is every text if nothing is labelled.
    Ties go to the language that comes first by name. Repeated rows are judged one by one. An empty table gives none.
    Where `docs` has columns of these names, the new ones have underscores before them.
    """
    texts = sample(labelled, text_col, label_col, id_col)
    model = docs.sparkSession.sparkContext.broadcast(train(texts) if texts else None)
    kept = [f for f in docs.schema if f.name != text_col]
    names = [free_name([f.name for f in kept], x) for x in ("lang_pred", "score")]
    return docs.mapInArrow(_predict(model, text_col, names), StructType([*kept, StructField(names[0], StringType()), StructField(names[1], DoubleType())]))
